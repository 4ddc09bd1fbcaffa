"""Places and helpers that the operators of this folder share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``.

    Only where the session names none and runs on this machine alone, as in tests, a local temporary folder is set; on a
    cluster that is an error, as each executor would write to a disk of its own.
    """
    sc = spark.sparkContext
    place = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not place:
        place = sc._jsc.sc().getCheckpointDir()
        place = place.get() if place.isDefined() else None
    if not place:
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        place = "file://" + tempfile.mkdtemp(prefix="strandweave-")
        sc.setCheckpointDir(place)
    return place.rstrip("/")


def new_folder(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/strandweave/{label}-{uuid.uuid4().hex}"


def staged(df: DataFrame, label: str) -> DataFrame:
    """Writes ``df`` as a Parquet table into the shared folder and reads it back.

    This cuts the lineage, so a lost executor costs no more than the reading of a file; columns that later steps do
    not want stay unread, and the new plan knows how large the table is.
    """
    spark = df.sparkSession
    path = new_folder(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Deletes tables made by ``staged`` that nothing reads any more."""
    for t in tables:
        for f in t.inputFiles()[:1]:
            jvm = t.sparkSession._jvm
            path = jvm.org.apache.hadoop.fs.Path(f).getParent()
            path.getFileSystem(t.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


#: Keys that hold more than one in so many rows are joined by broadcast; there are fewer of them than this.
HEAVY = 1000


def join_by_size(rows: DataFrame, table: DataFrame, keys: list[str], count: str, total: int, how: str = "left") -> DataFrame:
    """``rows`` joined to ``table``, which has one row for each of its keys and in ``count`` how many of ``rows`` have it.

    Of ``total`` rows, fewer than HEAVY keys can each hold more than a HEAVY-th: that bounds what is broadcast. No other
    key can make the shuffle join of the rest uneven. ``rows`` is read twice, so it should be a stored table.
    """
    heavy = table.where(F.col(count) * HEAVY > total)
    light = table.where(F.col(count) * HEAVY <= total)
    found = rows.join(F.broadcast(heavy), keys)
    rest = rows.join(F.broadcast(heavy.select(*keys)), keys, "left_anti").join(light, keys, how)
    return found.unionByName(rest)


def filled(text: Column | str = "text") -> Column:
    """The text, empty where it is null."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def row_key(text: Column | str = "text") -> Column:
    """Tells rows apart that have one id but different texts."""
    return F.xxhash64(filled(text))

"""The functions under names that SQL text can use.

They are SQL functions, which Spark inlines into the plan that calls them; only the bucket of a k-mer, whose arithmetic
wraps, is an Arrow function. ``kmers(seq, k, stride)`` is a table: ``SELECT * FROM reads, LATERAL kmers(seq, 24, 24)``.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import IntegerType

from . import codec, hashing

_BASES = f"{codec.BASES}U"
FUNCTIONS = {
    "dna_encode(s STRING) RETURNS BIGINT": f"CASE WHEN upper(s) RLIKE '^[{_BASES}]{{1,{codec.MAX_K}}}$' THEN CAST(conv(translate(upper(s), '{_BASES}', '{codec.DIGITS}2'), 4, 10) AS BIGINT) END",
    "dna_decode(code BIGINT, k INT) RETURNS STRING": f"translate(lpad(conv(CAST(code AS STRING), 10, 4), k, '0'), '{codec.DIGITS}', '{codec.BASES}')",
    "dna_revcomp(s STRING) RETURNS STRING": "reverse(translate(s, 'ACGTU', 'TGCAA'))",
    "dna_sanitize(s STRING) RETURNS STRING": "regexp_replace(replace(upper(s), 'U', 'T'), '[^ACGTN]', '')",
    "dna_entropy(s STRING, n INT) RETURNS DOUBLE": """aggregate(transform(array_distinct(filter(split(s, ''), x -> x <> '')), x -> length(s) - length(replace(s, x, ''))),
        0D, (a, c) -> a - (c / length(s)) * ln(c / length(s)) / ln(n))""",
    "kmers(seq STRING, k INT, stride INT) RETURNS TABLE(pos INT, kmer STRING)": """SELECT at AS pos, substring(seq, at + 1, k) AS kmer
        FROM (SELECT explode(CASE WHEN length(seq) >= k THEN sequence(0, length(seq) - k, stride) ELSE CAST(array() AS ARRAY<INT>) END) AS at)""",
}


@pandas_udf(IntegerType())
def kmer_bucket(kmers: pd.Series, k: pd.Series, w: pd.Series, buckets: pd.Series) -> pd.Series:
    """The bucket of each k-mer; k, w and buckets are the same in a batch."""
    if not len(kmers):
        return pd.Series([], dtype="int32")
    out = hashing.signatures(kmers.to_numpy(np.int64), int(k.iloc[0]), int(w.iloc[0])) % np.uint64(buckets.iloc[0])
    return pd.Series(out.astype(np.int32))


def register(spark: SparkSession) -> None:
    for head, body in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}")
    spark.udf.register("kmer_bucket", kmer_bucket)

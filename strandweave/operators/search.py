"""Search: which cells hold k-mers or sequences, and how strongly."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions import codec
from . import postings as P


def abundant(count_at_least: int = 10, count_at_most: int = 10_000) -> Column:
    """Strict on both sides."""
    return (F.col("n_cells") > count_at_least) & (F.col("n_cells") < count_at_most)


def find_kmer(kmers: DataFrame, postings: DataFrame, stats: DataFrame, count_at_least: int = 10, count_at_most: int = 10_000) -> DataFrame:
    """kmer, cells: of the k-mers asked for that are neither too rare nor too common. These are chosen by the stats, so
    that long posting lists aren't read."""
    wanted = kmers.select("kmer").distinct().join(stats.where(abundant(count_at_least, count_at_most)), "kmer").select("kmer")
    return postings.join(wanted, "kmer").groupBy("kmer").agg(F.sort_array(F.collect_set("cell_id")).alias("cells"))


def vote_threshold(w: int, k: int, pct: float) -> int:
    """Votes that a window needs: one more than the truncated share, in single precision, of its k-mers; all at most."""
    if not 0 <= pct <= 1:
        raise ValueError("pct_threshold must be between 0 and 1")
    return min(int(np.float32(w // k) * np.float32(pct)) + 1, w // k)


def usable_window(w: int, k: int, shortest: int | None) -> tuple[int, str | None]:
    """The window length for sequences of at least ``shortest`` bases, and a warning if it had to be cut down to that.
    It must hold a k-mer."""
    if w < k:
        raise ValueError(f"a window of {w} bases holds no k-mer of {k}")
    if shortest is None or shortest >= w:
        return w, None
    if shortest < k:
        raise ValueError(f"a sequence of {shortest} bases holds no k-mer of {k}")
    return shortest, f"windows of {w} bases are cut down to the shortest sequence, {shortest}"


def distinct_windows(queries: DataFrame, w: int) -> DataFrame:
    """group_id, win: the distinct windows of length w of each group's sequences, at each place."""
    long = queries.select("group_id", "seq").where(F.length("seq") >= w)
    placed = long.select("group_id", "seq", F.explode(F.sequence(F.lit(1), F.length("seq") - w + 1)).alias("at"))
    return placed.select("group_id", F.substring(F.col("seq"), F.col("at"), F.lit(w)).alias("win")).distinct()


def window_kmers(windows: DataFrame, w: int, k: int, drop_homopolymers: bool = False) -> DataFrame:
    """group_id, w1, w2, at, kmer: the k-mers side by side in each window, without those that hold other letters. w1 and
    w2, 128 bits of hashes, stand for the window, whose letters go no further."""
    numbered = windows.select("group_id", F.xxhash64("win").alias("w1"), F.xxhash64("win", F.lit(1)).alias("w2"), "win")
    cut = numbered.select("group_id", "w1", "w2", "win", F.explode(F.sequence(F.lit(0), F.lit(w // k - 1))).alias("at"))
    coded = cut.select("group_id", "w1", "w2", "at", codec.encode(F.substring(F.col("win"), F.col("at") * k + 1, F.lit(k))).alias("kmer")).where("kmer is not null")
    if drop_homopolymers:
        ones = (4**k - 1) // 3
        coded = coded.where(~F.col("kmer").isin([d * ones for d in range(4)]))
    return coded


def where(
    queries: DataFrame, postings: DataFrame, stats: DataFrame, k: int, sliding_size: int = 128, pct_threshold: float = 0.65,
    count_at_least: int = 10, count_at_most: int = 10_000, single_count: bool = False, background: DataFrame | None = None, drop_homopolymers: bool = False,
) -> DataFrame:
    """group_id, cell_id, score: how many distinct windows of a group's sequences match a cell; with ``single_count`` 1.

    ``queries``: group_id, seq. A window matches a cell that enough of its k-mers are posted for. ``background`` (kmer,
    n_genes) takes out k-mers of more than one gene. The k-mers asked for are made distinct and cut down by the stats
    before they meet the postings. A sample_id in the postings is kept.

    Up to HELD windows that can match are sent to all tasks, which see a cell's hits together: hits, one for each k-mer and
    cell and not for each window too, are packed by cells and shuffled as parts. More windows are joined with the hits.
    """
    if sliding_size < k:
        raise ValueError("sliding_size must be at least k")
    need = vote_threshold(sliding_size, k, pct_threshold)
    cells = [c for c in ("sample_id", "cell_id") if c in postings.columns]
    asked = window_kmers(distinct_windows(queries, sliding_size), sliding_size, k, drop_homopolymers)
    if background is not None:
        asked = asked.join(background.where("n_genes > 1").select("kmer"), "kmer", "left_anti")
    usable = asked.select("kmer").distinct().join(stats.where(abundant(count_at_least, count_at_most)), "kmer").select("kmer")
    windows = asked.join(usable, "kmer", "left_semi").groupBy("group_id", "w1", "w2").agg(F.collect_list("kmer").alias("kmers")).where(F.size("kmers") >= need)
    held = windows.select("group_id", "kmers").limit(HELD + 1).toArrow()
    if held.num_rows <= HELD:
        return scored(postings, held, need, cells, single_count, queries.schema["group_id"].dataType)
    hits = postings.join(usable, "kmer", "left_semi")
    # one shuffle serves votes and scores: no two tasks see the same group and cell
    met = asked.join(hits, "kmer").repartition("group_id", *cells)
    votes = met.groupBy("group_id", "w1", "w2", *cells).agg(F.count("*").alias("votes")).where(F.col("votes") >= need)
    score = F.lit(1).cast("long") if single_count else F.count("*")
    return votes.groupBy("group_id", *cells).agg(score.alias("score"))


#: Windows that are held by each task of a search, and how many of their k-mers times cells are looked up at once.
HELD, LOOKED_UP = 200_000, 1 << 23


def scored(postings: DataFrame, windows: pa.Table, need: int, cells: list[str], single_count: bool, group_type: T.DataType) -> DataFrame:
    """group_id, cells, score of windows (group_id, kmers), a row each."""
    lists = windows["kmers"].combine_chunks()
    lengths = np.asarray(lists.value_lengths(), np.int64) if len(lists) else np.zeros(0, np.int64)
    kmers, flat = np.unique(lists.flatten().to_numpy(zero_copy_only=False), return_inverse=True) if len(lists) else (np.zeros(0, np.int64), np.zeros(0, np.int64))
    coded = windows["group_id"].combine_chunks().dictionary_encode("encode")
    groups, number = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    # a row a window, in order of groups: the places of its k-mers, filled up with one that no cell has
    table = np.full((len(number), max(lengths, default=1)), len(kmers), np.int32)
    table[np.repeat(np.arange(len(number)), lengths), np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = flat
    order = np.argsort(number, kind="stable")
    table, number = np.ascontiguousarray(table[order].T), number[order]
    kind = np.uint8 if len(table) < 256 else np.uint32
    many = max(1, min(256, LOOKED_UP // max(table.size, 1)))

    def scores(keys: list, at: np.ndarray, cell: np.ndarray):
        """Of hits of at most ``many`` cells: places of k-mers, and of cells in ``keys``."""
        has = np.zeros((len(kmers) + 1, len(keys[0])), kind)
        has[at, cell] = 1
        votes = has[table[0]]
        for row in table[1:]:
            votes += has[row]
        won, n = np.flatnonzero(votes >= need), len(keys[0])
        score = np.bincount(number[won // n] * n + won % n, minlength=len(groups) * n)
        found = np.flatnonzero(score)
        value = np.ones(len(found), np.int64) if single_count else score[found].astype(np.int64)
        taken = pa.array(found % n)
        return pa.RecordBatch.from_arrays([groups.take(pa.array(found // n)), *(x.take(taken) for x in keys), pa.array(value)], names=["group_id", *cells, "score"])

    def pack(batches):
        """Hits by the part of their cell, with the places of k-mers for k-mers."""
        for hits in P.gathered(batches):
            at = pa.array(np.searchsorted(kmers, hits["kmer"].to_numpy()))
            yield P.packed(pa.table([at, *(hits[c] for c in cells)], schema=packed), hits["part"].to_numpy())

    def run(batches):
        for held in P.parts(batches):
            hits = P.unpacked(held, packed)
            if isinstance(hits, pa.Table):  # numbers stand for what aren't whole numbers
                at, columns = hits["at"].to_numpy(), [hits[c].combine_chunks() for c in cells]
                keys = [x.dictionary_encode("encode").indices.to_numpy() for x in columns]
            else:
                at, *keys = hits
                columns = [x.combine_chunks() for x in P.table_of(hits, packed).columns[1:]]
            order = np.lexsort(keys[::-1]) if len(keys) > 1 else np.argsort(keys[0], kind="stable")
            new = P.new_rows(*(x[order] for x in keys))
            starts, cell, at = np.append(np.flatnonzero(new), len(at)), np.cumsum(new) - 1, at[order]
            for i in range(0, len(starts) - 1, many):
                j = min(i + many, len(starts) - 1)
                a, b = starts[i], starts[j]
                firsts = pa.array(order[starts[i:j]])
                yield scores([x.take(firsts) for x in columns], at[a:b], cell[a:b] - i)

    of_cells = [T.StructField(c, postings.schema[c].dataType) for c in cells]
    types = T.StructType([T.StructField("group_id", group_type), *of_cells, T.StructField("score", T.LongType())])
    if not len(number):
        return postings.sparkSession.createDataFrame([], types)
    packed = to_arrow_schema(T.StructType([T.StructField("at", T.LongType()), *of_cells]))
    wanted = postings.sparkSession.createDataFrame(pa.table({"kmer": kmers}))
    hits = postings.join(F.broadcast(wanted), "kmer", "left_semi").select(*cells, "kmer", F.pmod(F.xxhash64(*cells), F.lit(P.PARTS)).cast("int").alias("part"))
    return P.deal(hits.mapInArrow(pack, P.PACKED)).mapInArrow(run, types)


def with_cells(scores: DataFrame, cells: DataFrame) -> DataFrame:
    """All of ``cells``, with score 0 where nothing matched."""
    return cells.join(scores, "cell_id", "left").fillna(0, ["score"])


def display(scores: DataFrame, shown: int = 5) -> DataFrame:
    """group_id, line: the first cells of a result and how many there are more. Each task drops what can't be shown, so a
    group of any size is a few cells and a count."""
    rank = F.row_number().over(Window.partitionBy("group_id").orderBy("cell_id"))
    few = scores.select("group_id", "cell_id").withColumn("rank", rank).where(F.col("rank") <= shown)
    listed = few.groupBy("group_id").agg(F.sort_array(F.collect_list("cell_id")).alias("cells"))
    counted = listed.join(scores.groupBy("group_id").agg(F.count("*").alias("n")), "group_id")
    first = F.concat_ws(", ", "cells")
    more = F.col("n") - shown
    return counted.select("group_id", F.when(more > 0, F.concat(first, F.lit(" … and "), more, F.lit(" more"))).otherwise(first).alias("line"))

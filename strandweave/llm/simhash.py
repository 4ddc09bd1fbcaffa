"""SimHash near-deduplication by the generalised pigeonhole principle.

Fingerprints link if they differ in few bits. The 64 bits are grouped, correlated ones together, into partitions; the
partitions get unequal thresholds t_i with sum(t_i + 1) = limit + 1, so that a linked pair differs in at most t_i bits of
some partition i. Groupings and thresholds are chosen by dynamic programming on candidate counts, which are estimated
from the bit statistics of all fingerprints. Probing takes, for each partition, its value with each choice of t_i bits
blanked out: two values within t_i bits share one of these keys. Fingerprints that share a key are verified against each
other, and what links is returned as a spanning forest, never as all pairs. A key with very many fingerprints is cut into
blocks, and each two blocks are verified by a task of their own; so no group is collected that could grow with the data,
and no link is lost.

With wide limits, texts that have nothing in common meet by accident once there are billions. A second fingerprint of the
same shingles, by other hashes, then takes part in the verification.
"""

from __future__ import annotations

from itertools import combinations
from math import comb, inf

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import connected
from .exact_dedup import without
from .shared import discard, filled, join_by_size, row_key, staged

BITS = 64
#: Fingerprints of one key that a task verifies against each other; keys with more are cut into blocks of half as many.
GROUP_LIMIT = 1 << 16
#: Partitions beyond limit + 1 that are tried, which leave some without a key.
SPARE_PARTS = 1
#: What a key costs to make, shuffle and gather, about a microsecond, in comparisons of about a nanosecond.
KEY_COST = 1000.0
#: Comparisons that are made at once; they should stay in a processor's cache.
COMPARED = 1 << 18
#: Shingles whose bits are counted at once.
BLOCK = 1 << 14


def _majority(hashes: np.ndarray) -> np.ndarray:
    """How many of the hashes have each bit."""
    return np.unpackbits(hashes.view(np.uint8), bitorder="little").reshape(-1, BITS).sum(axis=0, dtype=np.int64)


def _other(hashes: np.ndarray) -> np.ndarray:
    """Hashes of hashes, as if by another seed."""
    h = (hashes ^ (hashes >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def fingerprints(text: bytes, size: int = 3, seed: int = 42, second: bool = False) -> tuple[int, int]:
    """SimHash of a text's word shingles, and a second one if asked for; 0 for a text without words."""
    words = text.lower().split()  # bytes: lower-cases A-Z, splits at 20 and 09-0D
    if not words:
        return 0, 0
    if len(words) < size:
        words = [b" ".join(words)]
        size = 1
    digest, join = xxhash.xxh64_intdigest, b" ".join
    ones, others, n = np.zeros(BITS, np.int64), np.zeros(BITS, np.int64), len(words) - size + 1
    for start in range(0, n, BLOCK):
        part = words[start : start + BLOCK + size - 1]
        grams = map(join, zip(*(part[i:] for i in range(size)), strict=False)) if size > 1 else part
        hashes = np.array([digest(g, seed) for g in grams], np.uint64)
        ones += _majority(hashes)
        if second:
            others += _majority(_other(hashes))
    packed = lambda x: int.from_bytes(np.packbits(2 * x > n, bitorder="little").tobytes(), "little")
    return packed(ones), packed(others)


def fingerprint(text: bytes, size: int = 3, seed: int = 42) -> int:
    return fingerprints(text, size, seed)[0]


def _fingerprints(size: int, second: bool):
    def run(batches):
        for batch in batches:
            prints = np.array([fingerprints(t, size, second=second) for t in batch.column("text").cast(pa.binary()).to_pylist()], np.uint64).reshape(-1, 2).view(np.int64)
            fp, other = (pa.array(np.ascontiguousarray(prints[:, i])) for i in (0, 1))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("key"), fp, other], names=["doc_id", "key", "fp", "other"])

    return run


def _bits(batches):
    total, n = np.zeros((BITS, BITS)), 0
    for batch in batches:
        for start in range(0, len(batch), 4096):
            fps = np.ascontiguousarray(batch.column("fp").slice(start, 4096).to_numpy())
            x = np.unpackbits(fps.view(np.uint8), bitorder="little").reshape(-1, BITS).astype(np.float32)
            total += x.T @ x
            n += len(x)
    if n:
        i, j = np.triu_indices(BITS)
        yield pa.RecordBatch.from_arrays([pa.array([*i.tolist(), -1]), pa.array([*j.tolist(), -1]), pa.array([*total[i, j].astype(np.int64).tolist(), n])], names=["i", "j", "n"])


def bit_statistics(prints: DataFrame) -> tuple[int, np.ndarray]:
    """Rows, and how often each two bits are both set, over all of column ``fp``; 2081 sums whatever the input."""
    sums = prints.select("fp").mapInArrow(_bits, "i long, j long, n long").groupBy("i", "j").agg(F.sum("n").alias("n")).collect()
    both, n = np.zeros((BITS, BITS)), 0
    for i, j, x in sums:
        if i < 0:
            n = x
        else:
            both[i, j] = both[j, i] = x
    return n, both


def _agreement(n: int, both: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For two random fingerprints: the chance that they agree in bit i, and in both of i and j; and correlations."""
    p = both / max(n, 1)
    q = np.diag(p)
    p10, p01 = q[:, None] - p, q[None, :] - p
    p00 = 1 - p - p10 - p01
    pair = p**2 + p10**2 + p01**2 + p00**2
    spread = np.sqrt(np.maximum(q * (1 - q), 1e-9))
    return pair, np.abs((p - np.outer(q, q)) / np.outer(spread, spread))


def group_bits(correlation: np.ndarray, parts: int) -> list[list[int]]:
    """Partitions of about equal width; each grows by the bit most correlated with those that it has."""
    left, out = set(range(BITS)), []
    for k in range(parts):
        width = len(left) // (parts - k)
        if k == parts - 1:
            own = sorted(left)
        else:
            ids = sorted(left)
            sub = correlation[np.ix_(ids, ids)] - np.eye(len(ids))
            own = [ids[int(np.argmax(sub.max(axis=1)))]]
            while len(own) < width:
                rest = sorted(left - set(own))
                own.append(rest[int(np.argmax(correlation[np.ix_(rest, own)].mean(axis=1)))])
        out.append(own)
        left -= set(own)
    return out


def within(pair: np.ndarray, bits: list[int], most: int) -> list[float]:
    """For each d up to ``most``: the chance that two random fingerprints differ in at most d of these bits.

    Bits follow one another in a chain in which each depends on the one before, as observed.
    """
    one = np.diag(pair)
    state = np.zeros((most + 1, 2))  # differences so far; whether the last bit agreed
    state[0, 1] = one[bits[0]]
    if most:
        state[1, 0] = 1 - one[bits[0]]
    for a, b in zip(bits, bits[1:], strict=False):
        after_same = min(1.0, pair[a, b] / max(one[a], 1e-12))
        after_other = min(1.0, max(0.0, (one[b] - pair[a, b]) / max(1 - one[a], 1e-12)))
        new = np.zeros_like(state)
        new[:, 1] = state[:, 1] * after_same + state[:, 0] * after_other
        new[1:, 0] = state[:-1, 1] * (1 - after_same) + state[:-1, 0] * (1 - after_other)
        state = new
    return np.cumsum(state.sum(axis=1)).tolist()


def allocate(costs: list[list[float]], total: int) -> tuple[float, list[int]]:
    """Thresholds, from -1 up, of which the sum of (t + 1) is ``total``, at the least sum of costs[i][t + 1]."""
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for cost in costs:
        step: dict[int, tuple[float, list[int]]] = {}
        for used, (c, chosen) in best.items():
            for t in range(min(len(cost), total - used + 1)):
                if used + t not in step or c + cost[t] < step[used + t][0]:
                    step[used + t] = (c + cost[t], [*chosen, t - 1])
        best = step
    return best.get(total, (inf, []))


def probe_masks(n: int, both: np.ndarray, limit: int) -> list[int]:
    """The bits that each key keeps, for the cheapest grouping and thresholds at this many fingerprints."""
    pair, correlation = _agreement(n, both)
    chosen = (inf, [], [])
    for parts in range(1, limit + 2 + SPARE_PARTS):
        groups = group_bits(correlation, parts)
        costs = []
        for bits in groups:
            near = within(pair, bits, limit)
            costs.append([0.0, *(KEY_COST * n * comb(len(bits), min(t, len(bits))) + n * n / 2 * near[t] for t in range(limit + 1))])
        cost, thresholds = allocate(costs, limit + 1)
        if cost < chosen[0]:
            chosen = (cost, groups, thresholds)
    masks = []
    for bits, t in zip(*chosen[1:], strict=True):
        for gone in combinations(bits, min(t, len(bits))) if t >= 0 else ():
            masks.append(sum(1 << b for b in bits if b not in gone))
    return masks


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def _keys(fps: DataFrame, masks: list[int]) -> DataFrame:
    """fp, other, probe, value: one row for each fingerprint and mask."""
    kept = F.array(*[F.lit(_signed(m)).cast("long") for m in masks])
    spread = fps.select("fp", "other", F.posexplode(kept).alias("probe", "mask"))
    return spread.select("fp", "other", "probe", F.col("fp").bitwiseAND(F.col("mask")).alias("value"))


def forest(fps: np.ndarray, limit: int, others: np.ndarray | None = None, total: int = 2 * BITS) -> list[tuple[int, int]]:
    """Edges that connect what links among these distinct fingerprints, at most one less than there are.

    Links are at most ``limit`` bits of ``fps`` and, with ``others``, ``total`` bits of both. Fingerprints are joined to
    a few pivots first; what these gather is one component, within which nothing is left to find out. Only the others
    are compared with all.
    """
    n, root, edges = len(fps), np.arange(len(fps)), []

    def top(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    def near(block: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        away = np.bitwise_count(fps[block, None] ^ fps[None])
        i, j = np.nonzero(away <= limit)
        i_of = block[i]
        if others is not None:
            linked = away[i, j] + np.bitwise_count(others[i_of] ^ others[j]) <= total
            i_of, j = i_of[linked], j[linked]
        return i_of, j

    def join(i: int, j: int) -> None:
        a, b = top(i), top(j)
        if a != b:
            root[max(a, b)] = min(a, b)
            edges.append((int(fps[i]), int(fps[j])))

    pivots = 16 if n > 512 else 0
    alone = np.arange(n)
    for _ in range(pivots):
        if not len(alone):
            break
        pivot = alone[len(alone) // 2]
        for j in near(np.array([pivot]))[1].tolist():
            join(int(pivot), j)
        tops = np.array([top(i) for i in range(n)])
        values, sizes = np.unique(tops, return_counts=True)
        alone = np.flatnonzero(tops != values[np.argmax(sizes)])
    step = max(1, COMPARED // max(n, 1))
    for start in range(0, len(alone), step):
        i, j = near(alone[start : start + step])
        for a, b in zip(i[i != j].tolist(), j[i != j].tolist(), strict=True):
            join(a, b)
    return edges


def _verify(limit: int, total: int | None):
    def run(batches):
        for batch in batches:
            found = []
            for group in batch.column("found"):
                fps, others = (group.values.field(c).to_numpy().view(np.uint64) for c in ("fp", "other"))
                found += forest(np.unique(fps), limit) if total is None else forest(fps, limit, others, total)
            pairs = np.array(found, np.uint64).reshape(-1, 2).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(pairs[:, 0])), pa.array(np.ascontiguousarray(pairs[:, 1]))], names=["a", "b"])

    return run


def links(fps: DataFrame, limit: int = 2, group_limit: int = GROUP_LIMIT, total: int | None = None) -> DataFrame:
    """a, b: edges that connect all fingerprints within ``limit`` bits of each other and, if ``total`` is given, within
    ``total`` bits of both fingerprints. ``fps``: distinct rows of fp and other. Empty without any."""
    n, both = bit_statistics(fps)
    if n < 2:
        return fps.select(F.col("fp").alias("a"), F.col("fp").alias("b")).where(F.lit(False))
    masks = probe_masks(n, both, limit)
    keys = _keys(fps, masks)
    gathered = F.collect_list(F.struct("fp", "other")).alias("found")
    verify = _verify(limit, total)
    crowded = staged(keys.groupBy("probe", "value").agg(F.count("*").alias("n")).where(F.col("n") > group_limit), "crowded")
    if crowded.isEmpty():
        small = keys.groupBy("probe", "value").agg(gathered).where(F.size("found") > 1).select("found")
        return small.mapInArrow(verify, "a long, b long")
    met = join_by_size(keys, crowded, ["probe", "value"], "n", n * len(masks))
    small = met.where("n is null").groupBy("probe", "value").agg(gathered).where(F.size("found") > 1).select("found")
    # each two blocks meet in one group
    hot = met.where("n is not null").withColumn("blocks", F.ceil(F.col("n") * 2 / group_limit).cast("int"))
    paired = hot.withColumn("own", F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")).withColumn("peer", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).where("own != peer")
    large = paired.groupBy("probe", "value", F.least("own", "peer").alias("low"), F.greatest("own", "peer").alias("high")).agg(gathered).select("found")
    return small.mapInArrow(verify, "a long, b long").union(large.mapInArrow(verify, "a long, b long"))


def near_duplicates(docs: DataFrame, limit: int = 2, size: int = 3, group_limit: int = GROUP_LIMIT, total: int | None = None) -> DataFrame:
    """doc_id, fingerprint, component_id, key: one row for each row of ``docs`` (doc_id, text).

    component_id is the smallest doc_id that can be reached over links of at most ``limit`` differing bits (and, if
    ``total`` is given, of at most so many of the 128 bits of two fingerprints), the row's own included; rows of one
    first fingerprint always link. It is null where no row of the component has an id. Null texts count as empty; texts without words have fingerprint 0 and link like
    any other; long texts are hashed in blocks. Repeated rows get the same values. An empty input gives an empty result.
    Further columns, whatever their names, are not looked at. ``key`` tells rows apart that have one id but other texts.
    """
    rows = docs.select("doc_id", row_key().alias("key"), filled().alias("text"))
    table = staged(rows.mapInArrow(_fingerprints(size, total is not None), "doc_id long, key long, fp long, other long"), "fingerprints")
    found = table.groupBy("fp").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n"))
    fps = staged(found, "distinct")
    pairs = staged(table.select("fp", "other").distinct(), "pairs")
    edges = staged(links(pairs, limit, group_limit, total), "links")
    roots = connected(edges)
    joined = fps.join(roots, fps["fp"] == roots["node"], "left").select("fp", "first_id", "n", F.coalesce("root", "fp").alias("root"))
    labels = staged(joined, "roots")
    sizes = labels.groupBy("root").agg(F.min("first_id").alias("component_id"), F.count("*").alias("members"))
    named = staged(join_by_size(labels, sizes, ["root"], "members", labels.count()).select("fp", "n", "component_id"), "components")
    discard(fps, pairs, edges, labels)
    out = join_by_size(table, named, ["fp"], "n", table.count())
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id", "key")


def keep_one(docs: DataFrame, limit: int = 2, size: int = 3, total: int | None = None) -> DataFrame:
    """``docs``, all columns, with the row of the smallest doc_id of each component. Rows without an id stay only in
    components that have no id at all."""
    found = near_duplicates(docs, limit, size, total=total)
    return without(docs, staged(found.where(~F.col("doc_id").eqNullSafe(F.col("component_id"))).select("doc_id", "key"), "near"))

"""Mixing sources to target weights by Poisson replication, with DataFrame functions only.

The weights and sizes of the sources give each a mean repetition rate. Each document draws its number of copies from a
Poisson distribution of that mean by inverting its cumulative function at a number hashed from seed and id, is exploded
by the count, and the copies are dealt over all partitions in the order of a second hash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import filled

#: Larger means are the sum of several draws of at most this mean, as exp(-mean) must not vanish.
MAX_DRAW_MEAN = 32


def uniform(*parts: Column) -> Column:
    """A number in [0, 1) from 52 bits of the MD5 of the parts."""
    digits = F.substring(F.md5(F.concat_ws("|", *parts)), 1, 13)
    return F.conv(digits, 16, 10).cast("long") / F.lit(float(1 << 52))


def poisson_inverse(mean: Column, u: Column) -> Column:
    """How many k have a cumulative probability of at most ``u``; 0 where the mean is 0."""
    most = F.ceil(mean + 12 * F.sqrt(mean) + 30).cast("int")
    start = F.exp(-mean)
    zero = F.struct(start.alias("p"), start.alias("c"), F.when(u >= start, 1).otherwise(0).cast("long").alias("n"))

    def step(acc, k):
        p = acc["p"] * mean / k
        c = acc["c"] + p
        return F.struct(p.alias("p"), c.alias("c"), (acc["n"] + F.when(u >= c, 1).otherwise(0)).cast("long").alias("n"))

    return F.aggregate(F.sequence(F.lit(1), most), zero, step, lambda acc: acc["n"])


def repetition_rates(docs: DataFrame, weights: dict[str, float], key: str = "source", text: str = "text") -> DataFrame:
    """source_group, rate: at most len(weights) + 1 rows. The rate brings the group's expected share of the mixed
    characters to its weight, while their total stays what it is. Sources without a weight are one group (null) that
    shares what the weights leave."""
    group = F.when(F.col(key).isin(list(weights)), F.col(key))
    sizes = docs.groupBy(group.alias("source_group")).agg(F.sum(F.length(filled(text))).alias("chars"))
    total = sizes.agg(F.sum("chars").alias("total"))
    rest = max(0.0, 1.0 - sum(weights.values()))
    wanted = F.lit(rest)
    for name, w in weights.items():
        wanted = F.when(F.col("source_group") == name, F.lit(float(w))).otherwise(wanted)
    # one row, joined to at most len(weights) + 1 rows
    sized = sizes.join(F.broadcast(total), F.lit(True))
    rate = F.when(F.col("chars") > 0, wanted * F.col("total") / F.col("chars")).otherwise(F.lit(1.0))
    return sized.select("source_group", rate.alias("rate"))


def mix(docs: DataFrame, weights: dict[str, float], seed: int = 17, key: str = "source", text: str = "text", id_column: str = "doc_id") -> DataFrame:
    """``docs``, all columns, each row as often as its draw says, with copy (1, 2, ...) and shuffle_key.

    Rows of one id and source get the same draw; a null id is the string "null"; a null source has no weight, like any
    source not in ``weights``. A group without characters keeps the rate 1. If the input has columns copy or
    shuffle_key, these give way. An empty input gives an empty result. The rates are at most len(weights) + 1 rows, so
    they are broadcast; documents are shuffled once, by a key that no skew can touch.
    """
    taken = {"copy", "shuffle_key"}
    docs = docs.select(*[docs[c] for c in docs.columns if c not in taken])
    rates = repetition_rates(docs, weights, key, text)
    group = F.when(F.col(key).isin(list(weights)), F.col(key))
    rated = docs.join(F.broadcast(rates), group.eqNullSafe(F.col("source_group")))
    ident = F.coalesce(F.col(id_column).cast("string"), F.lit("null"))
    draws = F.greatest(F.ceil(F.col("rate") / MAX_DRAW_MEAN).cast("int"), F.lit(1))
    one = lambda j: poisson_inverse(F.col("rate") / draws, uniform(F.lit(str(seed)), ident, j.cast("string")))
    copies = F.aggregate(F.transform(F.sequence(F.lit(1), draws), one), F.lit(0).cast("long"), lambda a, x: a + x)
    counted = rated.withColumn("copy", copies).where("copy > 0")
    spread = counted.select(*[docs[c] for c in docs.columns], F.explode(F.sequence(F.lit(1).cast("long"), F.col("copy"))).alias("copy"))
    keyed = spread.withColumn("shuffle_key", F.md5(F.concat_ws("|", F.lit(f"{seed}s"), ident, F.col("copy").cast("string"))))
    return keyed.repartition("shuffle_key").sortWithinPartitions("shuffle_key")


def mix_sql(weights: dict[str, float], seed: int = 17) -> str:
    """DuckDB SQL for ``mix`` over the view documents, ordered by nothing."""
    listed = ", ".join(f"('{k}', {float(w)!r}::DOUBLE)" for k, w in weights.items())
    rest = max(0.0, 1.0 - sum(weights.values()))
    return f"""
WITH wanted(name, w) AS (VALUES {listed}),
docs AS (SELECT d.*, coalesce(CAST(doc_id AS VARCHAR), 'null') AS ident, w.name AS grp FROM documents d LEFT JOIN wanted w ON d.source = w.name),
sizes AS (SELECT grp, sum(length(coalesce(text, ''))) AS chars FROM docs GROUP BY grp),
rates AS (SELECT s.grp, CASE WHEN chars > 0 THEN coalesce(w.w, {rest!r}::DOUBLE) * (SELECT sum(chars) FROM sizes) / chars ELSE 1.0::DOUBLE END AS rate
          FROM sizes s LEFT JOIN wanted w ON s.grp = w.name),
drawn AS (SELECT grp, rate, greatest(CAST(ceil(rate / {MAX_DRAW_MEAN}) AS INTEGER), 1) AS draws FROM rates),
means AS (SELECT grp, draws, rate / draws AS mean FROM drawn),
cdf AS (
  WITH RECURSIVE r(grp, draws, mean, k, p, c) AS (
    SELECT grp, draws, mean, 0, exp(-mean), exp(-mean) FROM means
    UNION ALL SELECT grp, draws, mean, k + 1, p * mean / (k + 1), c + p * mean / (k + 1) FROM r WHERE k < ceil(mean + 12 * sqrt(mean) + 30))
  SELECT * FROM r),
draw AS (
  SELECT d.ident, m.grp, j.j, CAST(CAST('0x' || substr(md5('{seed}|' || d.ident || '|' || j.j), 1, 13) AS BIGINT) AS DOUBLE) / {float(1 << 52)!r} AS u
  FROM (SELECT DISTINCT ident, grp FROM docs) d JOIN means m ON d.grp IS NOT DISTINCT FROM m.grp, LATERAL (SELECT unnest(range(1, m.draws + 1)) AS j) j),
counts AS (
  SELECT x.ident, x.grp, count(c.k) AS n FROM draw x JOIN cdf c ON x.grp IS NOT DISTINCT FROM c.grp AND x.u >= c.c GROUP BY x.ident, x.grp)
SELECT d.doc_id, d.text, d.lang, d.source, d.n_chars, k.k AS copy, md5('{seed}s|' || d.ident || '|' || k.k) AS shuffle_key
FROM docs d JOIN counts n ON d.ident = n.ident AND d.grp IS NOT DISTINCT FROM n.grp, LATERAL (SELECT unnest(range(1, n.n + 1)) AS k) k
"""

"""Quality rules with DataFrame functions only: figures of each text, and line frequency across a host's documents.

Lines are normalised and hashed together with their host; the distinct documents that hold a line are counted, lines
above the host's limit are removed, and a document that little is left of is rejected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import discard, filled, join_by_size, staged

#: A line in more than this share of its host's distinct documents, and in more documents than this, is boilerplate.
LINE_SHARE, LINE_DOCS = 0.05, 5
#: Rows that each host's size is repeated in, so that no task has all lines of one host.
SALTS = 32
#: A document is depleted if fewer words, or a smaller share of its words, are left.
LEAST_WORDS, LEAST_SHARE = 20, 0.4
#: Words of the windows that are looked for twice.
WINDOW = 8
_SPACE = r"[\x20\x09-\x0D]+"
_OTHER_SPACE = r"\x20[\x20\x09-\x0D]+|[\x09-\x0D][\x20\x09-\x0D]*"  # any white space but one space
_WORD = r"[^\x20\x09-\x0D]"


def words(text: Column) -> Column:
    return F.array_remove(F.split(text, _SPACE), "")


def window_hashes(hashes: Column, n: Column) -> Column:
    """A hash of each 8 words in a row, of ``n`` word hashes that are an input column. Needs 8 words or more."""
    return F.transform(F.slice(hashes, 1, n - (WINDOW - 1)), lambda h, i: F.xxhash64(h, *[F.get(hashes, i + k) for k in range(1, WINDOW)]))


def repeated_words(windows: Column) -> Column:
    """How many words the windows cover that occur twice or more."""
    ordered = F.array_sort(F.zip_with(windows, F.sequence(F.lit(0), F.size(windows) - 1), lambda h, i: F.struct(h.alias("h"), i.alias("at"))))

    def starts(s: Column) -> Column:
        own = F.sequence(F.lit(0), F.size(s) - 1)
        twice = F.filter(own, lambda i: F.when(i > 0, s[i]["h"] == s[i - 1]["h"]).otherwise(False) | F.when(i + 1 < F.size(s), s[i]["h"] == s[i + 1]["h"]).otherwise(False))
        return F.array_sort(F.transform(twice, lambda i: s[i]["at"]))

    zero = F.struct(F.lit(-WINDOW).alias("at"), F.lit(0).cast("long").alias("n"))
    step = lambda a, i: F.struct(i.alias("at"), (a["n"] + F.least(F.lit(WINDOW), i - a["at"])).alias("n"))
    covered = F.transform(F.array(ordered), lambda s: F.aggregate(starts(s), zero, step, lambda a: a["n"]))
    return covered[0]


def text_figures(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id, text, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, row: of each whole text; and ``more``."""
    # each select makes an array that the next one refers to several times, so that it is computed once
    tokens = docs.select("doc_id", filled().alias("text"), row_of().alias("row"), words(filled()).alias("tokens"), *more)
    n = F.size("tokens")
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(_WORD))
    figures = tokens.select(
        "doc_id",
        "text",
        "row",
        n.cast("long").alias("n_words"),
        F.length(F.concat_ws("", "tokens")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace("text", r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        lines.alias("lines"),
        F.when(n > WINDOW, F.transform("tokens", lambda w: F.xxhash64(w))).alias("hashes"),
        *more,
    )
    first = figures.withColumn("windows", F.when(F.col("n_words") > WINDOW, window_hashes(F.col("hashes"), F.size("hashes"))))
    twice = F.size(F.array_distinct("windows")) < F.size("windows")
    return first.select(
        "doc_id",
        "text",
        "n_words",
        "word_chars",
        "n_symbols",
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.when(twice, repeated_words(F.col("windows"))).otherwise(F.lit(0)).cast("long").alias("n_repeat_words"),
        "row",
        *more,
    )


def row_of() -> Column:
    """Names a text on a host. What is removed from a text depends on both, and on nothing else."""
    return F.xxhash64(F.col("source"), filled())


def normal_line(line: Column) -> Column:
    """Lower case, digits as 0, white space of any kind and length as one space, none at the ends."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(line), "[1-9]", "0"), _OTHER_SPACE, " "))


def document_lines(docs: DataFrame) -> DataFrame:
    """host, row, at, line, n: each line with a word; ``line`` hashes host and normalised line, ``n`` counts its words."""
    # the text is hashed and left behind before its lines are spread
    split = docs.select("source", row_of().alias("row"), F.split(filled(), "\n").alias("raws")).select("source", "row", F.posexplode("raws").alias("at", "raw")).where(F.col("raw").rlike(_WORD))
    normal = split.select("source", "row", "at", normal_line(F.col("raw")).alias("normal"))
    spaces = F.length("normal") - F.length(F.replace("normal", F.lit(" "), F.lit("")))
    return normal.select(F.xxhash64("source").alias("host"), "row", "at", F.xxhash64("source", "normal").alias("line"), (spaces + 1).alias("n"))


def frequent_lines(lines: DataFrame, share: float, docs: int) -> DataFrame:
    """line, rows: in more distinct documents of its host than ``docs`` and than ``share`` of all that have a line, and
    how many rows of ``lines`` hold it. Copies of one text count once.

    The first aggregation is by line and document, which a common line can't make uneven; the others add partial counts.
    """
    held = lines.groupBy("host", "line", "row").agg(F.count("*").alias("rows"))
    common = held.groupBy("host", "line").agg(F.count("*").alias("docs"), F.sum("rows").alias("rows")).where(F.col("docs") > docs)
    sizes = lines.select("host", "row").distinct().groupBy("host").agg(F.count("*").alias("size"))
    sizes = sizes.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = common.withColumn("salt", F.pmod("line", F.lit(SALTS)).cast("int"))
    return salted.join(sizes, ["host", "salt"]).where(F.col("docs") > F.col("size") * F.lit(share)).select("line", "rows")


def removals(docs: DataFrame, share: float, least_docs: int) -> DataFrame:
    """row, frequent, n_removed, copies: of each text that loses lines their places and how many words they have, and how
    many rows of ``docs`` hold the text. A stored table."""
    lines = staged(document_lines(docs), "lines")
    frequent = staged(frequent_lines(lines, share, least_docs), "frequent")
    hits = join_by_size(lines, frequent, ["line"], "rows", lines.count(), how="inner")
    places = hits.groupBy("row", "at").agg(F.first("n").alias("n"), F.count("*").alias("copies"))  # copies of a text are one row
    out = staged(places.groupBy("row").agg(F.collect_set("at").alias("frequent"), F.sum("n").alias("n_removed"), F.max("copies").alias("copies")), "removals")
    discard(lines, frequent)
    return out


def stripped(text: Column, frequent: Column) -> Column:
    """The text without the lines at the places of the array ``frequent``; the others as they are, in order."""
    return F.array_join(F.filter(F.split(text, "\n"), lambda _, i: ~F.array_contains(frequent, i)), "\n")


def _verdict(figures: DataFrame, left: Column, least_words: int, least_share: float, *more: str) -> DataFrame:
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    rest = figures.withColumn("left", left.cast("long")).withColumn("failed", failed)
    whole = F.col("left") == F.col("n_words")
    kept = ~F.col("failed") & (whole | (F.col("left") >= least_words) & (F.col("left") >= least_share * F.col("n_words")))
    return rest.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", F.col("failed").alias("base_failed"), kept.alias("kept"),
        (F.col("n_words") - F.col("left")).alias("n_removed_words"), *more,
    )


def cleaned(docs: DataFrame, share: float = LINE_SHARE, least_docs: int = LINE_DOCS, least_words: int = LEAST_WORDS, least_share: float = LEAST_SHARE) -> DataFrame:
    """The columns of ``judge``, and text: without its frequent lines, the other lines in order, of kept rows or not.

    Words are counted on what is left. Texts meet their frequent lines by a hash of text and host; only texts held by very
    many rows are matched by broadcast."""
    base = docs.select("doc_id", "text", "source")
    removed = removals(base, share, least_docs)
    marked = join_by_size(base.withColumn("row", row_of()), removed, ["row"], "copies", base.count())
    rest = F.when(F.col("frequent").isNull(), filled()).otherwise(stripped(filled(), F.col("frequent")))
    figures = text_figures(marked.withColumn("rest", rest), "rest", "frequent")
    left = F.when(F.col("frequent").isNull(), F.col("n_words")).otherwise(F.size(words(F.col("rest"))))
    return _verdict(figures, left, least_words, least_share, "rest").withColumnRenamed("rest", "text")


def clean(docs: DataFrame, share: float = LINE_SHARE, least_docs: int = LINE_DOCS, least_words: int = LEAST_WORDS, least_share: float = LEAST_SHARE) -> DataFrame:
    """doc_id, text: the texts that are kept, without their frequent lines. Texts that fail or are depleted are left out,
    so an empty table stays empty; null and empty texts fail. Else as ``judge``."""
    return cleaned(docs, share, least_docs, least_words, least_share).where("kept").select("doc_id", "text")


def judge(docs: DataFrame, share: float = LINE_SHARE, least_docs: int = LINE_DOCS, least_words: int = LEAST_WORDS, least_share: float = LEAST_SHARE) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, n_removed_words.

    One row for each row of ``docs`` (doc_id, text, source; the source is the host), none for an empty table. A null text
    is empty and fails; a null source is a host of its own; texts are read whole, however long; ids play no part, and
    repeated rows get equal values. Further columns, whatever their names, are not looked at. The words of the lines that
    ``cleaned`` takes out are added up, as they are just those that a text loses; so no text is shuffled.
    """
    base = docs.select("doc_id", "text", "source")
    figures = staged(text_figures(base).drop("text"), "figures")
    removed = removals(base, share, least_docs)
    marked = join_by_size(figures, removed.drop("frequent"), ["row"], "copies", figures.count())
    return _verdict(marked, F.col("n_words") - F.coalesce("n_removed", F.lit(0)), least_words, least_share)


def judge_sql(share: float = LINE_SHARE, least_docs: int = LINE_DOCS, least_words: int = LEAST_WORDS, least_share: float = LEAST_SHARE) -> str:
    """DuckDB SQL for ``judge`` over the view documents."""
    space = r"[\x20\x09-\x0D]+"
    return rf"""
WITH docs AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text, coalesce(source, chr(1)) AS source FROM documents),
split AS (SELECT rid, doc_id, text, source, list_filter(regexp_split_to_array(text, '{space}'), lambda x: x <> '') AS w,
  list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM docs),
base AS (SELECT rid, doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
  CAST(length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols,
  CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines FROM split),
windows AS (SELECT rid, p.p, array_to_string(w[p.p : p.p + {WINDOW - 1}], ' ') AS win FROM split, LATERAL (SELECT unnest(range(1, len(w) - {WINDOW - 2})) AS p) p),
twice AS (SELECT rid, p FROM (SELECT rid, p, count(*) OVER (PARTITION BY rid, win) AS n FROM windows) WHERE n > 1),
covered AS (SELECT rid, count(DISTINCT p + j) AS n FROM twice, (SELECT unnest(range({WINDOW})) AS j) GROUP BY rid),
normal AS (SELECT rid, source, text, trim(regexp_replace(regexp_replace(lower(l), '[0-9]', '0', 'g'), '{space}', ' ', 'g')) AS line
  FROM (SELECT rid, source, text, unnest(lines) AS l FROM split)),
hosts AS (SELECT source, count(DISTINCT text) AS size FROM normal GROUP BY source),
frequent AS (SELECT source, line FROM normal JOIN hosts USING (source) GROUP BY source, line, size HAVING count(DISTINCT text) > {least_docs} AND count(DISTINCT text) > size * {share!r}::DOUBLE),
removed AS (SELECT rid, CAST(sum(len(string_split(line, ' '))) AS BIGINT) AS n FROM normal SEMI JOIN frequent USING (source, line) GROUP BY rid),
figures AS (SELECT b.*, coalesce(c.n, 0) AS n_repeat_words, coalesce(r.n, 0) AS n_removed_words FROM base b LEFT JOIN covered c USING (rid) LEFT JOIN removed r USING (rid)),
judged AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM figures)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND (n_removed_words = 0 OR n_words - n_removed_words >= {least_words} AND n_words - n_removed_words >= {least_share} * n_words) AS kept, n_removed_words FROM judged
"""

"""DNA strings: cleaning, reverse complements, the query grammar, and sequence complexity."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The complement of each base, and what stands for a gene identifier.
COMPLEMENT = ("ACGTU", "TGCAA")
ENSEMBL = r"^ENS[A-Z]*[GTPE][0-9]+(\.[0-9]+)?$"
SERVER_SEQUENCE = r"^[ACGTNU]+$"


def sanitize(seq: Column) -> Column:
    """Upper case, U as T, and only A, C, G, T and N of what is left."""
    return F.regexp_replace(F.replace(F.upper(seq), F.lit("U"), F.lit("T")), "[^ACGTN]+", "")


def bases_only(seq: Column) -> Column:
    """Like ``sanitize``, without N."""
    return F.regexp_replace(F.replace(F.upper(seq), F.lit("U"), F.lit("T")), "[^ACGT]+", "")


def with_bases(rows: DataFrame, text: str = "text", seq: str = "seq") -> DataFrame:
    """``rows`` with ``seq``, the ``bases_only`` of ``text``, in its place as the last column. Each text is gone over once,
    whereas a column is computed again by every filter on it."""
    others = [c for c in rows.columns if c != text]
    no_bases = bytes(i for i in range(256) if i not in b"ACGT")

    def clean(x):
        upper = x.upper() if x.isascii() else x.decode().upper().encode()
        return upper.replace(b"U", b"T").translate(None, no_bases)

    def run(batches):
        for batch in batches:
            texts = batch.column(len(others)).cast(pa.large_binary()).to_pylist()
            seqs = pa.array([None if x is None else clean(x) for x in texts], pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], seqs], names=[*others, seq])

    fields = [T.StructField(c, rows.schema[c].dataType) for c in others]
    return rows.select(*others, text).mapInArrow(run, T.StructType([*fields, T.StructField(seq, T.StringType())]))


def reverse_complement(seq: Column) -> Column:
    return F.reverse(F.translate(seq, *COMPLEMENT))


def split_range(seq: Column, a: Column, b: Column) -> Column:
    """seq[a:b]; if a > b, [b:a] of the reverse complement. A null b is the end."""
    end = F.coalesce(b, F.length(seq))
    forward = F.substring(seq, a + 1, F.greatest(end - a, F.lit(0)))
    return F.when(a > end, F.substring(reverse_complement(seq), end + 1, a - end)).otherwise(forward)


def parse_multifasta(text: Column) -> Column:
    """The sanitised sequences of a text of FASTA records; a text without ">" is one sequence."""
    records = F.slice(F.split(text, ">"), 2, F.greatest(F.size(F.split(text, ">")) - 1, F.lit(0)))
    bodies = F.transform(records, lambda r: sanitize(F.regexp_replace(r, r"^[^\n]*\n?", "")))
    return F.filter(F.when(F.contains(text, F.lit(">")), bodies).otherwise(F.array(sanitize(text))), lambda s: s != "")


def classify_query(text: Column) -> Column:
    """dna, ensembl, gene or error, by the first line that isn't empty; of FASTA the first line of sequence."""
    lines = F.filter(F.transform(F.split(text, "\n"), lambda x: F.trim(x)), lambda x: x != "")
    first = F.get(lines, F.lit(0))
    kind = (
        F.when(first.isNull(), "error")
        .when(first.startswith(">"), "dna")
        .when(F.upper(first).rlike(SERVER_SEQUENCE), "dna")
        .when(F.upper(first).rlike(ENSEMBL) | F.lower(first).startswith("ensembl:"), "ensembl")
        .when(first.rlike(r"^(gene:)?[A-Za-z0-9_.\-]+(;.*)?$"), "gene")
        .otherwise("error")
    )
    return kind


def query_part(text: Column, key: str, default: str | None = None) -> Column:
    """The value of ``key:value`` among parts separated by ";"."""
    value = F.regexp_extract(text, rf"(?:^|;){key}:([^;]*)", 1)
    return F.when(value != "", F.trim(value)).otherwise(F.lit(default))


def parse_gene_query(text: Column) -> Column:
    """gene:ID;species:S;type:T;split:a,b as a struct of id, species, type, start, end."""
    split = query_part(text, "split")
    bad = split.isNotNull() & ~F.coalesce(split.rlike(r"^[0-9]+,[0-9]+$"), F.lit(True))
    twice = F.size(F.regexp_extract_all(text, F.lit(r"(?:^|;)gene:"), F.lit(0))) > 1
    part = lambda i: F.get(F.split(split, ","), F.lit(i)).try_cast("int")
    start = F.when(bad | twice, F.raise_error(F.concat(F.lit("not a gene query: "), text)).cast("int")).when(split.isNull(), 0).otherwise(part(0))
    return F.struct(
        query_part(text, "gene").alias("id"), query_part(text, "species", "homo_sapiens").alias("species"), query_part(text, "type", "genomic").alias("type"),
        start.alias("start"), part(1).alias("end"),
    )


def parse_ensembl_query(text: Column) -> Column:
    """ensembl:ID;type:T;split:a,b as a struct of id, type, start, end."""
    as_gene = parse_gene_query(F.regexp_replace(text, "(^|;)ensembl:", "$1gene:"))
    return F.struct(as_gene["id"].alias("id"), as_gene["type"].alias("type"), as_gene["start"].alias("start"), as_gene["end"].alias("end"))


def tokenise_query(text: Column) -> Column:
    """A search box's text as queries: FASTA records, or words; a word that is no sequence is ``gene:word;type:cdna``."""
    words = F.filter(F.split(F.trim(text), r"[,\s]+"), lambda w: w != "")
    named = F.transform(words, lambda w: F.when(F.upper(w).rlike(SERVER_SEQUENCE), F.upper(w)).otherwise(F.concat(F.lit("gene:"), w, F.lit(";type:cdna"))))
    return F.when(F.contains(text, F.lit(">")), parse_multifasta(text)).otherwise(named)


def parse_gene_lists(text: Column) -> Column:
    """The first two bracketed lists of quoted names in a text, as arrays."""
    found = F.slice(F.regexp_extract_all(text, F.lit(r"\[[^\[\]]*\]"), F.lit(0)), 1, 2)
    return F.transform(found, lambda s: F.regexp_extract_all(s, F.lit(r"""["']([^"']*)["']"""), F.lit(1)))


def wrap_fasta(header: Column, seq: Column, width: int = 60) -> Column:
    return F.concat(F.lit(">"), header, F.lit("\n"), F.regexp_replace(seq, rf"(.{{{width}}})(?=.)", "$1\n"))


def residue_counts(seq: Column, n: int) -> Column:
    """How often the first ``n`` distinct residues occur, padded with 0 to ``n``, in descending order."""
    letters = F.filter(F.split(seq, ""), lambda c: c != "")
    kinds = F.slice(F.array_distinct(letters), 1, n)
    counts = F.transform(kinds, lambda c: F.size(F.filter(letters, lambda x: x == c)))
    return F.sort_array(F.slice(F.concat(counts, F.array_repeat(F.lit(0), n)), 1, n), asc=False)


def complexity(seq: Column, n: int) -> Column:
    """Shannon entropy, to base ``n``, of the residues; 0 for an empty sequence."""
    counts = residue_counts(seq, n)
    total = F.aggregate(counts, F.lit(0), lambda a, c: a + c)
    term = lambda a, c: a + F.when(c > 0, -(c / total) * F.log(c / total) / F.log(F.lit(float(n)))).otherwise(0.0)
    return F.when(total > 0, F.aggregate(counts, F.lit(0.0), term)).otherwise(F.lit(0.0))


def counts_complexity(counts: Column, n: int) -> Column:
    """The entropy of residue counts taken as a sequence of ``n`` letters themselves: of how often each count occurs, for
    the first ``n`` kinds of count, against the length ``n``."""
    kinds = F.slice(F.array_distinct(counts), 1, n)
    often = F.transform(kinds, lambda c: F.size(F.filter(counts, lambda x: x == c)))
    return F.aggregate(often, F.lit(0.0), lambda a, c: a - (c / n) * F.log(c / n) / F.log(F.lit(float(n))))


def mask_low_complexity(seq: Column, mask: str = "N", n: int = 20, window: int = 12, mode: str = "entropy") -> Column:
    """The sequence with ``mask`` where more than three windows of low complexity lie, or where the first window over a
    base is low. A window is low below the mean less one standard deviation of all. Shorter sequences stay as they are.

    A window's complexity is the entropy of its residues or, with ``mode`` "reference", that of the counts of its residues
    taken as letters."""
    if mode not in ("entropy", "reference"):
        raise ValueError("mode must be entropy or reference")
    last = F.length(seq) - window
    score = (lambda w: complexity(w, n)) if mode == "entropy" else (lambda w: counts_complexity(residue_counts(w, n), n))
    scores = F.transform(sliding_windows(seq, window), score)

    def cut(s: Column) -> Column:
        mean = F.aggregate(s, F.lit(0.0), lambda a, x: a + x) / F.size(s)
        return once(mean, lambda m: m - F.sqrt(F.aggregate(s, F.lit(0.0), lambda a, x: a + (x - m) * (x - m)) / F.size(s)) - 1e-12)

    def letters(low: Column) -> Column:
        def letter(i: Column) -> Column:
            first = F.greatest(i - window + 1, F.lit(0))
            over = F.slice(low, first + 1, F.least(i, last) - first + 1)
            masked = once(over, lambda o: (F.size(F.filter(o, lambda x: x)) > 3) | o[0])
            return F.when(masked, F.lit(mask)).otherwise(F.substring(seq, i + 1, F.lit(1)))

        return F.concat_ws("", F.transform(F.sequence(F.lit(0), F.length(seq) - 1), letter))

    result = once(scores, lambda s: once(cut(s), lambda c: once(F.transform(s, lambda x: x < c), letters)))
    return F.when(last >= 0, result).otherwise(seq)


def once(value: Column, use) -> Column:
    """``use(value)``, with the value computed once however often it is referred to."""
    return F.transform(F.array(value), use)[0]


def sliding_windows(seq: Column, length: int) -> Column:
    from .codec import sliding

    return sliding(seq, length)


def has_unsafe(text: Column) -> Column:
    """Whether a text holds one of the characters that must not reach an evaluator."""
    return text.rlike(r"[();.]")


def bytes_of(text: Column) -> Column:
    """"1.5K" or "2G" as bytes; null for an empty text."""
    number, unit = F.regexp_extract(text, r"^\s*([0-9.]+)\s*([KMGT]?)B?\s*$", 1), F.upper(F.regexp_extract(text, r"(?i)^\s*([0-9.]+)\s*([KMGT]?)B?\s*$", 2))
    scale = F.element_at(F.create_map(*[F.lit(x) for p in (("", 1), ("K", 1 << 10), ("M", 1 << 20), ("G", 1 << 30), ("T", 1 << 40)) for x in (p[0], float(p[1]))]), unit)
    return F.when(F.trim(text) != "", F.floor(F.regexp_extract(F.upper(text), r"^\s*([0-9.]+)", 1).try_cast("double") * scale).cast("long"))


def cell_spec(text: Column) -> Column:
    """``r1[2:27]`` as a struct of read, start, end; anything else is an error."""
    form = r"^\s*r([12])\[([0-9]+):([0-9]+)\]\s*$"
    part = lambda i: F.regexp_extract(text, form, i).try_cast("int")
    ok = F.when(text.rlike(form), part(1)).otherwise(F.raise_error(F.concat(F.lit("not a cell position: "), text)).cast("int"))
    return F.struct(ok.alias("read"), part(2).alias("start"), part(3).alias("end"))


def bam_tag(text: Column) -> Column:
    """The tag of ``CB:{cell}``; CB if there is none."""
    tag = F.regexp_extract(text, r"([A-Za-z0-9]{2}):\{cell\}", 1)
    return F.when(tag != "", tag).otherwise("CB")

"""Two bits a base: columns that encode, decode and cut k-mers (A 0, C 1, T 2, G 3; the first base is the highest)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BASES, DIGITS = "ACTG", "0123"
MAX_K = 31
#: Bits of the cell in a composite of sample and cell.
CELL_BITS = 23


def check_k(k: int) -> int:
    if not 1 <= k <= MAX_K:
        raise ValueError(f"k must be between 1 and {MAX_K}")
    return k


def digits(dna: Column) -> Column:
    """The bases as digits of base four; what isn't a base, a digit too, as N."""
    return F.translate(F.regexp_replace(F.upper(dna), f"[^{BASES}U]", "N"), BASES + "U", DIGITS + "2")


def encode(dna: Column) -> Column:
    """A DNA string of 1 to 31 bases, of either case, as a long; null if it holds anything else, or nothing."""
    bases = F.upper(dna)
    code = F.conv(F.translate(bases, BASES + "U", DIGITS + "2"), 4, 10).cast("long")
    return F.when(bases.rlike(f"^[{BASES}U]{{1,{MAX_K}}}$"), code)


def decode(code: Column, k: int) -> Column:
    """The DNA of length ``k`` that a long stands for; 0 is all A."""
    return F.translate(F.lpad(F.conv(code.cast("string"), 10, 4), k, "0"), DIGITS, BASES)


def sliding(seq: Column, k: int) -> Column:
    """All substrings of length k, in order; none if the sequence is shorter."""
    n = F.length(seq)
    return F.when(n >= k, F.transform(F.sequence(F.lit(1), n - k + 1), lambda i: F.substring(seq, i, F.lit(k)))).otherwise(F.array().cast("array<string>"))


def tiled(seq: Column, k: int) -> Column:
    """Substrings of length k at 0, k, 2k, ...; the last one ends at the end. None if the sequence is shorter."""
    n = F.length(seq)
    at = lambda j: F.least(j * k, n - k) + 1
    return F.when(n >= k, F.transform(F.sequence(F.lit(0), F.ceil(n / k).cast("int") - 1), lambda j: F.substring(seq, at(j), F.lit(k)))).otherwise(F.array().cast("array<string>"))


def window_kmers(window: Column, w: int, k: int) -> Column:
    """The w // k substrings of length k of a window, side by side from its start."""
    return F.transform(F.sequence(F.lit(0), F.lit(w // k - 1)), lambda j: F.substring(window, j * k + 1, F.lit(k)))


def prefix(kmer: Column, suffix_bases: int) -> Column:
    return F.shiftright(kmer, 2 * suffix_bases)


def suffix(kmer: Column, suffix_bases: int) -> Column:
    return kmer.bitwiseAND(F.lit((1 << 2 * suffix_bases) - 1))


def composite(sample_id: Column, cell_id: Column) -> Column:
    """One number for sample (9 bits) and cell (23 bits)."""
    return F.shiftleft(sample_id.cast("long"), CELL_BITS).bitwiseOR(cell_id.cast("long").bitwiseAND(F.lit((1 << CELL_BITS) - 1)))


def composite_sample(code: Column) -> Column:
    return F.shiftright(code, CELL_BITS)


def composite_cell(code: Column) -> Column:
    return code.bitwiseAND(F.lit((1 << CELL_BITS) - 1))


def reverse_barcode(code: Column, length: int) -> Column:
    """The code of the same bases in reverse order."""
    return encode(F.reverse(decode(code, length)))

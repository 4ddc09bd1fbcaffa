"""Token counts: batch encoding in Arrow functions that return lengths only.

A text is split at safe boundaries: single spaces between characters that aren't white space. No token of a byte-level or
word-level pre-tokenizer spans such a place, since a space can only begin a word, so the counts of the pieces add up to
that of the text. Pieces that the worker has not met yet are encoded together, in batches of about equal bytes; the
counts of the others are known.
"""

from __future__ import annotations

import os
import re
from functools import lru_cache
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import filled

#: Bytes of text that are encoded at once.
BATCH_BYTES = 1 << 20
#: Pieces that a worker remembers; beyond it forgets all.
REMEMBERED = 400_000
#: White space beside a space: such a space is no safe boundary.
_UNSAFE = re.compile(r"\s | \s")
_SAFE = re.compile(r"(?<=\S) (?=\S)")


@lru_cache(maxsize=4)
def load_tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    if path.endswith(".model"):
        import sentencepiece

        return sentencepiece.SentencePieceProcessor(model_file=path)
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


def _batches(texts, size: int):
    """Lists of texts of ``size`` bytes or little more, or of one text that is longer."""
    batch, n = [], 0
    for t in texts:
        batch.append(t)
        n += 4 * len(t) if not t.isascii() else len(t)
        if n >= size:
            yield batch
            batch, n = [], 0
    if batch:
        yield batch


def library_counts(tokenizer, texts) -> list[int]:
    out: list[int] = []
    for batch in _batches(texts, BATCH_BYTES):
        if hasattr(tokenizer, "encode_batch_fast"):
            out += map(len, tokenizer.encode_batch_fast(batch, add_special_tokens=False))
        else:
            out += map(len, tokenizer.encode(batch, num_threads=1))
    return out


class Counter:
    """Counts tokens; remembers pieces across texts. ``pieces``: whether texts may be split (not for sentencepiece)."""

    def __init__(self, path: str):
        self.tokenizer = load_tokenizer(path)
        self.pieces = not path.endswith(".model") and self._splits()
        self.known: dict[str, int] = {}

    def _splits(self) -> bool:
        """Whether the tokenizer keeps a space with the word after it and so may be fed in pieces."""
        import json

        spec = json.loads(self.tokenizer.to_str())
        pre = spec.get("pre_tokenizer") or {}
        plain = not any(x["lstrip"] or x["rstrip"] or " " in x["content"] for x in spec.get("added_tokens", []))
        return pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space") and spec.get("normalizer") is None and plain

    def __call__(self, texts: list[str]) -> list[int]:
        if not self.pieces:
            return library_counts(self.tokenizer, texts)
        split = [t.split(" ") if not _UNSAFE.search(t) else _SAFE.split(t) for t in texts]
        known = self.known
        fresh = list({p for parts in split for p in islice(parts, 1, None)}.difference(known))
        if len(known) + len(fresh) > REMEMBERED:
            known.clear()
            fresh = list({p for parts in split for p in islice(parts, 1, None)})
        known.update(zip(fresh, library_counts(self.tokenizer, (" " + p for p in fresh)), strict=True))
        heads = library_counts(self.tokenizer, [parts[0] for parts in split])
        return [h + sum(map(known.__getitem__, islice(parts, 1, None))) for h, parts in zip(heads, split, strict=True)]


def _count(path: str):
    def run(batches):
        count = Counter(path)
        for batch in batches:
            data = batch.column("text")
            sizes = pa.compute.binary_length(data).to_numpy()
            n = [0] * len(data)
            start = total = 0
            for i, size in enumerate(sizes.tolist()):  # slices of about equal bytes bound what is split at once
                total += size
                if total >= 8 * BATCH_BYTES or i == len(data) - 1:
                    n[start : i + 1] = count(data.slice(start, i + 1 - start).to_pylist())
                    start, total = i + 1, 0
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(n, pa.int64())], names=["doc_id", "n_bytes", "n_tokens"])

    import pyarrow.compute  # noqa: F401

    return run


def count_tokens(docs: DataFrame, tokenizer_path: str, limit: int = 1024) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit: one row for each row of ``docs`` (doc_id, text).

    Counts are those of the library that reads ``tokenizer_path``, for the whole text, without begin, end or padding
    tokens. A null text counts as empty (0, 0, false). Null or repeated ids don't matter: every row is on its own.
    Further columns of the input, whatever their names, are not looked at.
    """
    rows = docs.select("doc_id", filled().alias("text"))
    counted = rows.mapInArrow(_count(tokenizer_path), "doc_id long, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)

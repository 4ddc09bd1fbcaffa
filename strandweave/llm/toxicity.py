"""Toxicity by a weighted lexicon, matched by Aho-Corasick on folded text.

Folding undoes homoglyphs and digits or symbols written for letters. Entries are whole words or word beginnings (stems of
inflected words), each with a weight. Matches inside exception phrases don't count. The sum of the weights is normalised
by the text's length and mapped to a score by a logistic curve. Entries, weights, exceptions and the curve are learnt from
a bounded sample of labelled rows.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from .shared import filled, staged

#: Labelled rows that the lexicon is learnt from: those of the smallest hashes of doc_id.
SAMPLE_ROWS = 20_000
#: Entries need this share of the distinct toxic texts, and these at least.
LEAST_SHARE, LEAST_TEXTS = 0.01, 3
#: Least log-odds of an entry.
LEAST_WEIGHT = 3.0
STEM_LENGTHS = range(4, 9)

# Characters written for Latin letters (Cyrillic, Greek, digits, symbols). i and l, and the signs for
# either, become i.
HOMOGLYPHS = {
    "а": "a", "в": "b", "с": "c", "е": "e", "н": "h", "і": "i", "ј": "j", "к": "k", "м": "m", "о": "o", "р": "p", "ѕ": "s", "т": "t", "у": "y", "х": "x",
    "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ı": "i", "ɑ": "a", "ɡ": "g",
    "0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "|": "i", "l": "i",
}
#: Characters that don't show.
INVISIBLE = "­​‌‍⁠﻿"
_TABLE = str.maketrans(HOMOGLYPHS | dict.fromkeys(INVISIBLE, ""))
_COMPATIBLE = re.compile("[℀-⅏①-⓿＀-￯\U0001d400-\U0001d7ff]")
_WORD = re.compile(r"[^\W_]+")


def fold(text: str) -> str:
    if not text.isascii() and _COMPATIBLE.search(text):
        text = unicodedata.normalize("NFKC", text)
    return text.lower().translate(_TABLE)


@dataclass
class Lexicon:
    """``entries``: "word$" for a whole word or "stem" for a beginning, in folded form, to its weight. ``exceptions``:
    folded phrases in which matches don't count. ``bias``, ``slope``: the curve's."""

    entries: dict[str, float]
    exceptions: list[str] = field(default_factory=list)
    bias: float = -4.0
    slope: float = 3.0

    def __post_init__(self):
        self._built = None

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "_built"} | {"_built": None}

    def _automata(self):
        if self._built is None:
            import ahocorasick

            out = []
            for words in (self.entries, dict.fromkeys(self.exceptions, 0.0)):
                finder = ahocorasick.Automaton()
                for w, x in words.items():
                    old = finder.get(w.rstrip("$"), [])
                    finder.add_word(w.rstrip("$"), [*old, (len(w.rstrip("$")), w.endswith("$"), x)])
                if words:
                    finder.make_automaton()
                out.append(finder if words else None)
            self._built = out
        return self._built

    def matches(self, folded: str) -> list[tuple[int, int, float]]:
        """start, end, weight; of entries that begin at one place, the one that weighs most counts."""
        entries, exceptions = self._automata()
        best: dict[int, tuple[int, float]] = {}
        for end, found in entries.iter(folded) if entries else ():
            end += 1
            for n, whole, weight in found:
                start = end - n
                if start and folded[start - 1].isalnum() or whole and end < len(folded) and folded[end].isalnum():
                    continue
                if start not in best or best[start][1] < weight:
                    best[start] = (end, weight)
        if best and exceptions:
            for end, found in exceptions.iter(folded):
                for n, _, _ in found:
                    start = end + 1 - n
                    if (not start or not folded[start - 1].isalnum()) and (end + 1 == len(folded) or not folded[end + 1].isalnum()):
                        best = {k: v for k, v in best.items() if not start <= k <= end}
        return [(k, *v) for k, v in sorted(best.items())]

    def density(self, text: str) -> float:
        folded = fold(text)
        weight = sum(w for _, _, w in self.matches(folded))
        return math.log1p(100 * weight / (folded.count(" ") + folded.count("\n") + 20)) if weight else 0.0

    def score(self, text: str) -> float:
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, self.bias + self.slope * self.density(text)))))


def features(text: str) -> set[str]:
    """Whole words and word beginnings of a text, folded."""
    out = set()
    for w in set(_WORD.findall(fold(text))):
        if len(w) >= 3:
            out.add(w + "$")
            out.update(w[:k] for k in STEM_LENGTHS if len(w) > k)
    return out


def _counts(of, wanted: int, only: frozenset | None):
    def run(batches):
        seen: Counter = Counter()
        for batch in batches:
            for text, label in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist(), strict=True):
                if label == wanted:
                    seen.update(of(text) & only if only is not None else of(text))
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], names=["feature", "n"])

    return run


def _count(train: DataFrame, of, label: int, only=None) -> DataFrame:
    return train.mapInArrow(_counts(of, label, only), "feature string, n long").groupBy("feature").agg(F.sum("n").alias("n"))


def choose_entries(toxic: dict[str, int], clean: dict[str, int], n_toxic: int, n_clean: int) -> dict[str, float]:
    """Entries by log-odds. Of nested ones that cover about the same toxic texts the longest is taken, else the shortest
    that is about as pure."""
    weight = {f: math.log((n + 0.5) / (n_toxic + 1)) - math.log((clean.get(f, 0) + 0.5) / (n_clean + 1)) for f, n in toxic.items()}
    # by chance alone no feature of this many should be met in so many toxic texts and hardly a clean one
    surprise = math.log((n_toxic + n_clean) / max(n_toxic, 1)) if n_clean else 0.0
    enough = (math.log(max(len(toxic), 1000)) + 2) / max(surprise, 1e-9)
    good = {f: w for f, w in weight.items() if w >= LEAST_WEIGHT and toxic[f] >= enough and clean.get(f, 0) * 20 <= toxic[f]}
    out: dict[str, float] = {}
    for f in sorted(good, key=lambda f: (len(f), f)):
        stem = f.rstrip("$")
        shorter = next((s for k in range(len(stem) + 1) if (s := stem[:k]) in out and s != f), None)
        if shorter is None:
            out[f] = good[f]
        elif toxic[f] >= 0.98 * toxic[shorter] and good[f] >= out[shorter]:
            del out[shorter]
            out[f] = good[f]
    return out


def _phrases(lexicon: Lexicon):
    """The phrases of a text that a match makes with the word before or after it."""

    def of(text: str) -> set[str]:
        folded, out = fold(text), set()
        for start, end, _ in lexicon.matches(folded):
            while end < len(folded) and folded[end].isalnum():
                end += 1
            low, high = start - 1, end + 1
            while low > 0 and folded[low - 1].isalnum():
                low -= 1
            while high < len(folded) and folded[high].isalnum():
                high += 1
            if start > 1 and folded[start - 1] == " " and low < start - 1:
                out.add(folded[low:end])
            if folded[end : end + 1] == " " and high > end + 1:
                out.add(folded[start:high])
        return out

    return of


def _fit_curve(bins: list[tuple[float, int, int]]) -> tuple[float, float]:
    """bias and slope of a logistic curve through (density, label, rows), by Newton's method with a slight ridge."""
    if not bins:
        return -4.0, 3.0
    x, y, n = (np.array(v, float) for v in zip(*bins, strict=True))
    design, w, ridge = np.stack([np.ones_like(x), x], 1), np.array([-1.0, 1.0]), np.array([0.05, 0.05])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        gradient = design.T @ (n * (y - p)) - ridge * w
        hessian = (design * (n * p * (1 - p))[:, None]).T @ design + np.diag(ridge)
        step = np.linalg.solve(hessian, gradient)
        w += np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return float(w[0]), float(max(w[1], 0.0))


def held_out(doc_id: Column) -> Column:
    """Whether a row is kept from learning: crc32 of the id as text is a multiple of 5. A null id counts as held out."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(5)) == 0, F.lit(True))


def learn(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, exceptions: tuple[str, ...] = ()) -> Lexicon:
    """A lexicon from ``docs`` (doc_id, text) and ``labels`` (doc_id, toxic), of rows that aren't held out.

    At most ``sample_rows`` labelled ids are used, those of the smallest hashes; being so few, they are broadcast. Equal
    texts count once. Features that reach the driver are in LEAST_SHARE of the toxic texts, so there are at most
    1 / LEAST_SHARE times those of one text; exception phrases, matches with a word beside, are in LEAST_TEXTS of the
    sample's. ``exceptions`` are phrases to add to the learnt ones. Without toxic rows the lexicon is empty.
    """
    usable = labels.select("doc_id", F.col("toxic").cast("int").alias("toxic")).where(F.col("toxic").isNotNull() & ~held_out(F.col("doc_id")))
    chosen = usable.orderBy(F.xxhash64("doc_id"), "doc_id", "toxic").limit(sample_rows)
    rows = docs.select("doc_id", filled().alias("text")).join(F.broadcast(chosen), "doc_id")
    train = staged(rows.groupBy(F.xxhash64("text").alias("h")).agg(F.min("text").alias("text"), F.max("toxic").alias("toxic")).select("text", "toxic"), "labelled")
    sizes = dict(train.groupBy("toxic").count().collect())
    n_toxic, n_clean = sizes.get(1, 0), sizes.get(0, 0)
    least = max(LEAST_TEXTS, math.ceil(LEAST_SHARE * n_toxic))
    toxic = dict(_count(train, features, 1).where(F.col("n") >= least).collect())
    clean = dict(_count(train, features, 0, frozenset(toxic)).collect()) if toxic else {}
    lexicon = Lexicon(choose_entries(toxic, clean, n_toxic, n_clean))
    if lexicon.entries:
        in_clean = _count(train, _phrases(lexicon), 0).where(F.col("n") >= LEAST_TEXTS).orderBy("feature").collect()
        if in_clean:
            in_toxic = dict(_count(train, _phrases(lexicon), 1, frozenset(f for f, _ in in_clean)).collect())
            lexicon.exceptions = [f for f, n in in_clean if n >= 4 * in_toxic.get(f, 0)]
    lexicon.exceptions += [fold(x) for x in exceptions]
    measured = train.select(F.round(density(lexicon)("text") * 20, 0).alias("d"), "toxic").groupBy("d", "toxic").count().collect()
    lexicon.bias, lexicon.slope = _fit_curve([(d / 20, t, n) for d, t, n in measured])
    return lexicon


def density(lexicon: Lexicon):
    @pandas_udf("double")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([lexicon.density(t) for t in texts], dtype="float64")

    return run


def scorer(lexicon: Lexicon):
    """A column function: the score, 0 to 1, of a text that isn't null."""

    @pandas_udf("double")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([lexicon.score(t) for t in texts], dtype="float64")

    return run


def score(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """doc_id, held_out, score, predicted: one row for each row of ``docs`` (doc_id, text).

    The score looks at the whole text, however long, and nothing else. A null text counts as empty and gets the score of
    a text without matches. Repeated rows get equal scores; further columns, whatever their names, are not looked at. An
    empty table gives an empty result; without labels all scores are those of an empty lexicon. Labels that disagree on
    one text make it toxic.
    """
    lexicon = learn(docs, labels, sample_rows)
    scored = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), scorer(lexicon)(filled()).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def without_toxic(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """``docs``, all columns, without the rows of a score of 0.5 or more."""
    return docs.where(scorer(learn(docs, labels, sample_rows))(filled(docs["text"])) < 0.5)

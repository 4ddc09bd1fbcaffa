"""BPE encoding and decoding by a tokenization automaton.

The merges of a byte-pair vocabulary are compiled, one gadget after another, into a deterministic automaton over tokens.
It starts as one state that loops on every single byte. The gadget of the merge (u, v) takes the state q that all arcs
labelled u lead to, makes a copy of q without the arc v, leads all u arcs to the copy, and gives each state with a u arc
an arc labelled uv to where v led from q. What the automaton accepts are exactly the token sequences that the merges
produce. All arcs of one label lead to one state, so the target of an arc is a table by label; whether a state has an arc
follows from the chain of copies it came from, and is entered into a transition table when first asked for.

A word's tokens are the one path that spells the word. From the first state on, the arc of the longest label that spells
what follows is taken; where none leads on, the path goes back by one arc and tries the next shorter one. Since one path
alone spells each beginning of a word, a place that led nowhere is never entered twice. Decoding emits the arcs' labels.
"""

from __future__ import annotations

import hashlib
import json
from functools import lru_cache
from itertools import chain

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .shared import filled

#: Words that a worker remembers at most, and a quarter of the transitions.
REMEMBERED = 400_000


def byte_alphabet() -> dict[str, int]:
    """The printable stand-ins of the byte-level vocabulary, by character: the byte that each stands for."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class TokenizationAutomaton:
    """``labels``: the bytes of each token id; ``merges``: pairs of ids and the id of their result, by rank."""

    def __init__(self, labels: dict[int, bytes], merges: list[tuple[int, int, int]]):
        self.labels = labels
        self.made: dict[int, tuple[int, int, int]] = {}  # token: rank of its gadget, left part, right part
        self.target = dict.fromkeys(labels, 0)  # label: the state that its arcs lead to
        self.parent, self.removed, self.born = [-1], [-1], [-1]  # of each state
        for rank, (u, v, uv) in enumerate(merges):
            after = self.target[v]
            self.parent.append(self.target[u])
            self.removed.append(v)
            self.born.append(rank)
            self.target[u] = len(self.parent) - 1
            self.target[uv] = after
            self.made[uv] = (rank, u, v)
        self._gone: dict[int, dict[int, int]] = {0: {}}
        self._arcs: dict[int, bool] = {}
        import ahocorasick

        # what is neither a byte nor made by a merge is on no path
        self.ids = {b.decode("latin-1"): t for t, b in labels.items() if len(b) == 1 or t in self.made}
        self.longest = max(map(len, self.ids))
        self.trie = ahocorasick.Automaton()
        for b in self.ids:
            self.trie.add_word(b, True)
        # label: the longest one that it begins with, and its length
        self.shorter = {t: next(((self.ids[b[:i]], i) for i in range(len(b) - 1, 0, -1) if b[:i] in self.ids), (-1, 0)) for b, t in self.ids.items()}

    def _removals(self, state: int) -> dict[int, int]:
        """label: rank of the gadget that took its arc away, over the chain of copies that ends in ``state``."""
        got = self._gone.get(state)
        if got is None:
            todo, at = [], state
            while at not in self._gone:
                todo.append(at)
                at = self.parent[at]
            got = self._gone[at]
            for s in reversed(todo):
                got = {self.removed[s]: self.born[s]} | got
            if len(self._gone) > REMEMBERED // 20:
                self._gone = {0: {}}
            self._gone[state] = got
        return got

    def has_arc(self, state: int, label: int) -> bool:
        """Whether the finished automaton has the arc. An arc uv was given when its gadget ran to each state that then
        had the arc u, so u must not have been taken away up to that rank; what went later doesn't matter."""
        key = state << 32 | label
        got = self._arcs.get(key)
        if got is None:
            gone, got, until, at = self._removals(state), True, 1 << 60, label
            while True:
                if gone.get(at, 1 << 61) <= until:
                    got = False
                    break
                if at not in self.made:
                    break
                until, at, _ = self.made[at]
            if len(self._arcs) > 4 * REMEMBERED:
                self._arcs.clear()
            self._arcs[key] = got
        return got

    def encode_word(self, word: bytes) -> list[int]:
        n, text, reach = len(word), word.decode("latin-1"), self.longest
        ids, arcs, target, shorter, deepest = self.ids, self._arcs, self.target, self.shorter, self.trie.longest_prefix
        path: list[tuple[int, int]] = []  # labels and their lengths
        dead: set[int] = set()  # places from which no path leads to the end
        at, state, size = 0, 0, -1
        while at < n:
            if size < 0:  # a new place
                rest = text[at : at + reach]
                size = deepest(rest)
                while (token := ids.get(rest[:size], -1)) < 0:
                    size -= 1
            while size:
                if at + size not in dead:
                    ok = arcs.get(state << 32 | token)
                    if ok or ok is None and self.has_arc(state, token):
                        break
                token, size = shorter[token]
            if size:
                path.append((token, size))
                at, state, size = at + size, target[token], -1
            else:
                dead.add(at)
                token, size = path.pop()
                at -= size
                state = target[path[-1][0]] if path else 0
                token, size = shorter[token]
        return [t for t, _ in path]


class _Words(dict):
    """Ids of words, and these as text; made when first asked for. Of two generations the older one is forgotten once
    the younger one is full, so frequent words stay."""

    def __init__(self, automaton: TokenizationAutomaton):
        super().__init__()
        self.automaton, self.older = automaton, {}

    def __missing__(self, word: str) -> tuple[tuple[int, ...], str]:
        got = self.older.get(word)
        if got is None:
            ids = tuple(self.automaton.encode_word(word.encode()))
            got = (ids, ",".join(map(str, ids)))
        if len(word) <= 64:
            if len(self) >= REMEMBERED // 2:
                self.older = self.copy()
                self.clear()
            self[word] = got
        return got


class ByteLevelBPE:
    """Encodes as the vocabulary file says: special strings first, then pre-split words by the automaton."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, self.path = spec["model"]["vocab"], path
        stands = byte_alphabet()
        spell = {t: bytes(stands[c] for c in t) for t in vocab}
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
        self.automaton = TokenizationAutomaton({i: spell[t] for t, i in vocab.items()}, [(vocab[a], vocab[b], vocab[a + b]) for a, b in pairs])
        self.special = {x["content"]: x["id"] for x in spec.get("added_tokens", [])}
        self.labels = self.automaton.labels | {i: s.encode() for s, i in self.special.items()}
        self._special = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        # Fixed value: how the byte-level pre-tokenizer splits.
        self._words = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
        self._kinds = [("a", regex.compile(r"\p{L}")), ("1", regex.compile(r"\p{N}"))]
        self._stand_in: dict[str, str] = {}
        self.words = _Words(self.automaton)

    def _as_library(self, c: str) -> str:
        """A character of the class that the library gives to ``c``, as its Unicode tables may be of another year."""
        got = self._stand_in.get(c)
        if got is None:
            from .token_count import load_tokenizer

            one = lambda s: len(load_tokenizer(self.path).pre_tokenizer.pre_tokenize_str(s)) == 1
            ours = next((k for k, r in self._kinds if r.match(c)), " " if regex.match(r"\s", c) else "!")
            theirs = next((k for k in "a1!" if one(c + k)), "　")
            got = self._stand_in[c] = c if ours == theirs or ours == " " and theirs == "　" else theirs
        return got

    def split(self, text: str) -> list[str]:
        """The words of a text without special strings."""
        if not text.isascii():
            odd = {ord(c): s for c in set(text) if c >= "԰" and (s := self._as_library(c)) != c}
            if odd:
                return [text[m.start() : m.end()] for m in self._words.finditer(text.translate(odd))]
        return self._words.findall(text)

    def _entries(self, text: str) -> list[tuple[tuple[int, ...], str]]:
        out, word = [], self.words.__getitem__
        parts = self._special.split(text) if self._special else [text]
        for i, part in enumerate(parts):
            if i % 2:
                t = self.special[part]
                out.append(((t,), str(t)))
            elif part:
                out += map(word, self.split(part))
        return out

    def encode(self, text: str) -> list[int]:
        return list(chain.from_iterable(x[0] for x in self._entries(text)))

    def encode_listed(self, text: str) -> tuple[list[int], str]:
        """The ids, and as decimal numbers joined by commas."""
        entries = self._entries(text)
        return list(chain.from_iterable([x[0] for x in entries])), ",".join([x[1] for x in entries])

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.labels.__getitem__, ids)).decode("utf-8", errors="replace")


@lru_cache(maxsize=2)
def load_bpe(path: str) -> ByteLevelBPE:
    return ByteLevelBPE(path)


def _encode(path: str):
    def run(batches):
        bpe = load_bpe(path)
        for batch in batches:
            for start in range(0, len(batch), 256):  # ids of few texts at a time
                part = batch.slice(start, 256)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([bpe.encode(t) for t in part.column("text").to_pylist()], pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return run


def _decode(path: str):
    def run(batches):
        bpe = load_bpe(path)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([bpe.decode(x or []) for x in batch.column("ids").to_pylist()], pa.string())], names=["doc_id", "text"])

    return run


def _digest(path: str):
    def run(batches):
        bpe = load_bpe(path)
        for batch in batches:
            counts, ids_sha, text_sha = [], [], []
            for text in batch.column("text").to_pylist():
                ids, listed = bpe.encode_listed(text)
                counts.append(len(ids))
                ids_sha.append(hashlib.sha256(listed.encode()).hexdigest())
                text_sha.append(hashlib.sha256(bpe.decode(ids).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return run


def encode(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """doc_id, ids: the token ids of each row's whole text, however long; a null text is empty and has none. Rows are
    independent, so repeated ones stay; further columns, whatever their names, are not looked at; no rows give none."""
    return docs.select("doc_id", filled().alias("text")).mapInArrow(_encode(tokenizer_path), "doc_id long, ids array<int>")


def decode(encoded: DataFrame, tokenizer_path: str) -> DataFrame:
    """doc_id, text: of rows of doc_id, ids. Null ids give an empty text; bytes that aren't UTF-8 give U+FFFD. No rows
    give none."""
    return encoded.select("doc_id", "ids").mapInArrow(_decode(tokenizer_path), "doc_id long, text string")


def round_trip(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: encodes and decodes each row's whole text in one pass.

    One row for each row of ``docs`` (doc_id, text), whatever its id; a null text counts as empty. The ids themselves,
    several times the text, never leave the worker. Texts are of any length; repeated rows get equal values; further
    columns are not looked at, whatever their names. An empty table gives an empty result.
    """
    return docs.select("doc_id", filled().alias("text")).mapInArrow(_digest(tokenizer_path), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")

"""Secret scans: patterns, and a linear-chain conditional random field.

Tokens are runs of the characters that secrets are made of, or single other characters. A chunk is what stands between
white space; every chunk's tokens are tagged as beginning a secret, inside one, or outside, from their shapes, the
neighbouring words and features of the whole file, and decoded by Viterbi. Any token can begin a secret: digits, length
and symbols are weighted features. A chunk's best gain over tagging nothing is kept by its text, so that paths are only
traced where, with the gain of the words before it, it can be above zero; that leaves out no path that would win.

There are no labelled secrets, so the field is trained, once in a process, on generated lines that hold secrets of many
forms, and numbers, dates, addresses and identifiers that aren't secrets.
"""

from __future__ import annotations

import hashlib
import random
import re
import string
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .shared import filled

LEAST_LENGTH = 8
# The patterns of the base kinds, and the least length of what each must hold.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex", "crf")
_CLUE = re.compile(r"passw|secret|token|api_?key", re.ASCII | re.IGNORECASE)
_TOKEN = re.compile(r"""[A-Za-z0-9+/_.\-]+(?:={1,2}(?=["'),;.\]}>]|$))?|[^\sA-Za-z0-9+/_.\-]""")
_CLUE_WORDS = frozenset(("key", "auth", "authorization", "bearer", "credential", "credentials", "pwd", "passphrase"))
_HINT = re.compile(r"[pstakbc](?:assw|assphrase|ecret|oken|pi_?key|ey|uth|earer|redential|wd)", re.ASCII | re.IGNORECASE)
#: What stands before the value in a chunk: a name with a sign of assignment, and opening quotes or brackets.
_LEAD = re.compile(r"""(?:["'(\[{<]*[\w.\-]+["'\])]*[:=]+)?["'(\[{<]*""", re.ASCII)
_KNOWN = re.compile(r"ghp_|gho_|sk-|sk_live_|xoxb-|pk_test_|glpat-|AIza|eyJ|AKIA")
_EDGE = "\"'=:,.()[]{}<>"
_OUT, _BEGIN, _INSIDE = range(3)


def mentions(text: str) -> bool:
    """Whether a text has what _CLUE looks for, without looking at each place."""
    low = text.lower()
    return any(x in low for x in ("passw", "secret", "token", "apikey", "api_key"))


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """start, end, kind of what the patterns match, whole matches, by start and then kind."""
    out = []
    if mentions(text):
        out += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        out += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return sorted(out, key=lambda x: (x[0], KINDS.index(x[2])))


def _class(c: str) -> str:
    return "d" if c.isdigit() else "u" if c.isupper() else "l" if c.isalpha() else "p"


def shape(token: str) -> list[str]:
    n = len(token)
    if n == 1 and not token.isalnum():
        return ["one=" + token]
    kinds = "".join(map(_class, token))
    runs = re.sub(r"(.)\1+", r"\1", kinds)
    charset = next((k for k, r in (("digits", r"[0-9]+"), ("number", r"[0-9.\-+/]+"), ("hex", r"[0-9a-f]+"), ("HEX", r"[0-9A-F]+"), ("alnum", r"[A-Za-z0-9]+")) if re.fullmatch(r, token)), "mixed")
    out = [f"set={charset}", f"len={min(n // 4, 12)}", f"turns={min(len(runs) // 3, 8)}", f"classes={''.join(sorted(set(kinds)))}"]
    out.append(f"head={re.sub(r'[0-9]', '0', token[:4])}" if n >= LEAST_LENGTH else "short")
    out.append(f"digits={round(4 * kinds.count('d') / n)}")
    out.append(f"dense={charset}-{min(len(runs) * 4 // n, 4)}-{min(n // 8, 5)}")
    if "." in token[:-1] or "/" in token or "-" in token:
        out.append(f"parts={min(max(map(len, re.split(r'[./-]', token))) // 4, 6)}")
    return out


def file_features(text: str) -> list[str]:
    digits = sum(map(text.count, string.digits))
    return [f"file_clue={mentions(text)}", f"file_digits={min(int(20 * digits / max(len(text), 1)), 3)}", f"file_code={any(x in text for x in ('();', '{', 'export ', '= '))}"]


class _Outline(dict):
    """Letters as a or b, vowels and consonants of their case, and those beyond ASCII as consonants; all else as it is."""

    def __init__(self, plain: bool):
        self.plain = plain

    def __missing__(self, code: int) -> int:
        c = chr(code)
        keep = not c.isalpha() or not self.plain and code < 128
        self[code] = out = code if keep else ord("A" if c in "AEIOU" else "B" if c.isupper() else "a" if c in "aeiou" else "b")
        return out


_PLAIN, _BEYOND = _Outline(True), _Outline(False)
_DIGIT = re.compile(r"[0-9]")
_LETTER = re.compile(r"[A-Za-z]")


def outline(chunk: str) -> tuple[str, int, bool]:
    """What the features see of a chunk: its characters, how many vowels, and whether letters beyond ASCII.

    Of chunks without ASCII digits, letters are seen as b or B; of those without ASCII letters, digits as 0."""
    beyond = not chunk.isascii()
    if _DIGIT.search(chunk):
        seen = chunk.translate(_BEYOND) if beyond else chunk
        if not _LETTER.search(seen):
            return _DIGIT.sub("0", seen), 0, beyond
        return seen, sum(map(seen.count, "aeiouAEIOU")), beyond
    seen = chunk.translate(_PLAIN)
    return seen.replace("a", "b").replace("A", "B"), seen.count("a") + seen.count("A"), beyond


def is_clue(word: str) -> bool:
    return bool(_CLUE.search(word)) or word in _CLUE_WORDS


def named(chunk: str) -> bool:
    """Whether the name before the value in a chunk is a clue."""
    return bool(_HINT.search(chunk)) and any(is_clue(w) or is_clue(w.rsplit("_", 1)[-1]) for w in [chunk[: _LEAD.match(chunk).end()].strip(_EDGE).lower()])


def known_head(chunk: str) -> str:
    m = _KNOWN.match(chunk, _LEAD.match(chunk).end())
    return m[0] if m else ""


def form(value: str, beyond: bool) -> str:
    """How letters are capitalised, digits, joints and symbols."""
    letters = re.sub(r"[^A-Za-z]+", "", value)
    case = "-" if not letters else "l" if letters.islower() else "U" if letters.isupper() else "C" if letters[1:].islower() else "H" if re.fullmatch(r"(?:[A-Z]?[a-z]{2,}+[^A-Za-z]*+)++", value) else "M"
    digits = len(_DIGIT.findall(value))
    symbols = len(set(re.findall(r"[!-~]", re.sub(r"[A-Za-z0-9+/_=.\-]+", "", value.rstrip("!?")))))
    return f"{case}{'0' if not digits else 'd' if letters else 'D'}{'j' if re.search(r'[+/_=.-]', value) else ''}{'s' * min(symbols, 3)}{'x' if beyond else ''}"


def chunk_features(seen: str, vowels: int, beyond: bool, head: str, clue: str) -> tuple[list[tuple[int, int]], list[list[str]], int]:
    """Places and features of the tokens of an outline, and the number of the token that its value starts with, or -1.

    ``clue`` says where a word like password is: in the chunk's lead, near before the chunk, or none."""
    places = [(m.start(), m.end()) for m in _TOKEN.finditer(seen)]
    low = _LEAD.match(seen).end()
    opened = seen[low - 1 : low] if low and seen[low - 1] in "\"'" else ""
    high = seen.rfind(opened, low) if opened else -1
    if high <= low:
        high = low + len(seen[low:].rstrip("\"')]}>,;:."))
    value = seen[low:high]
    start = next((i for i, (a, _) in enumerate(places) if low <= a < high), -1)
    how = f"{'=' if re.search('[:=]', seen[:low]) else ''}{'q' if opened else ''}"
    kind, n = form(value, beyond), len(value)
    rows = []
    for i, (a, b) in enumerate(places):
        token = seen[a:b]
        part = "start" if i == start else "lead" if a < low else "in" if a < high else "end"
        row = ["bias", f"part={part}", f"part={part}-{clue}"]
        row += [f"{part}:{f}" for f in shape(token)]
        if part == "start":
            letters = len(_LETTER.findall(seen))
            runs = len(re.sub(r"(.)\1+", r"\1", "".join(map(_class, value))))
            row += [f"form={kind}", f"size={min(n // 3, 10)}", f"how={how}", f"how={how}-{clue}", f"head={head}", f"form={kind}-{clue}", f"form={kind}-{clue}-{how}", f"size={clue}-{min(n // 4, 6)}-{kind}"]
            row += [f"vowels={round(5 * vowels / letters) if letters else '-'}-{min(n // 5, 4)}", f"mixed={min(runs * 4 // n, 4)}-{min(n // 5, 5)}-{kind[:2]}"]
            row += [f"after={seen[high : high + 1]}", f"call={'(' in value}"]
        elif part == "in":
            # as between a colon and an at sign of an address with a password
            row += [f"between={seen[a - 1]}{seen[b : b + 1]}", f"between={seen[a - 1]}{seen[b : b + 1]}-{'://' in seen}-{'@' in seen[b:]}", f"reach={seen.rfind('@', b) > 0}-{seen.find(':', low, a) > 0}"]
            row += [f"in={kind}", f"in={kind}-{clue}", f"in={how}-{clue}", f"last={i == len(places) - 1 or places[i + 1][0] >= high}"]
        rows.append(row)
    return places, rows, start


def word_features(chunk: str) -> tuple[list[str], list[str]]:
    """Features of the chunk that comes next, and of the one after that; for the lack of a chunk, of an empty one."""
    word = chunk.strip(_EDGE).lower()
    tail = chunk[-1:]
    return [f"before={word}", f"last={word}", f"ends={'a' if tail.isalnum() else tail}", f"clue1={is_clue(word)}"], [f"before={word}", f"clue2={is_clue(word)}"]


class Field:
    """Weights by feature and label, and by pairs of labels."""

    #: Chunks, and characters of chunks, whose gains are kept at once.
    MOST, MOST_CHARS = 1 << 19, 1 << 25

    def __init__(self, names: list[str]):
        self.names = {n: i for i, n in enumerate(names)}
        self.weights = np.zeros((len(names) + 1, 3))  # the last is for what training hasn't seen
        self.moves = np.zeros((3, 3))

    def ready(self) -> Field:
        """Weights are final: those of beginning and inside a secret, less those of outside, by feature."""
        gains = (self.weights[:, 1:] - self.weights[:, :1]).tolist()
        self.gains = {n: tuple(gains[i]) for n, i in self.names.items()}
        self.words = {w: (*self.gain([f"before={w}", f"last={w}"]), *self.gain([f"before={w}"])) for n in self.names if n.startswith(("before=", "last=")) for w in [n.split("=", 1)[1]]}
        self.ends = {n[5:]: self.gains[n] for n in self.names if n.startswith("ends=")}
        self.clues = [(*self.gain([f"clue1={x}"]), *self.gain([f"clue2={x}"])) for x in (False, True)]
        self.steps = [[float(x) for x in row] for row in self.moves]
        self.forget()
        return self

    def __getstate__(self) -> dict:
        return {"names": self.names, "weights": self.weights, "moves": self.moves}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self.ready()

    def forget(self) -> None:
        self.seen: dict[tuple, tuple[float, bool]] = {}
        self.table, self.filled, self.fresh = np.zeros((4096, 7)), 0, []
        self.chars, self.known = 0, _Known(self)
        self.known[""]  # no chunk is number 0

    def gain(self, features: list[str]) -> tuple[float, float]:
        begin = inside = 0.0
        for f in features:
            g = self.gains.get(f)
            if g:
                begin += g[0]
                inside += g[1]
        return begin, inside

    def outlook(self, chunk: str, lead: bool) -> tuple[float, bool]:
        """How much the best path with a secret gains over none, without the words before; whether it is one token."""
        key = *outline(chunk), known_head(chunk), lead
        out = self.seen.get(key)
        if out is None:
            places, rows, start = chunk_features(*key[:4], "lead" if lead else "none")
            out = self.seen[key] = self.best_gain([self.gain(r) for r in rows]), len(places) == 1 and start == 0
        return out

    def context(self, chunk: str) -> tuple[float, float, float, float, bool]:
        """The gains of ``word_features``, and whether the chunk is a clue."""
        word = chunk.strip(_EDGE).lower()
        clue = bool(_HINT.search(word)) and is_clue(word)
        a, b, c, d = self.words.get(word, (0.0, 0.0, 0.0, 0.0))
        e, f = self.ends.get("a" if chunk[-1:].isalnum() else chunk[-1:], (0.0, 0.0))
        g, h, i, j = self.clues[clue]
        return a + e + g, b + f + h, c + i, d + j, clue

    def numbers(self, chunks: list[str]) -> np.ndarray:
        """The rows of the chunks in the table, which is filled up."""
        ids = np.fromiter(map(self.known.__getitem__, chunks), np.int64, len(chunks))
        need = self.filled + len(self.fresh)
        while need > len(self.table):
            self.table = np.concatenate([self.table, np.zeros_like(self.table)])
        if self.fresh:
            self.table[self.filled : need] = self.fresh
            self.filled, self.fresh = need, []
        return ids

    def best_gain(self, gains: list[tuple[float, float]]) -> float:
        (oo, ob, _), (bo, bb, bi), (io, ib, ii) = self.steps
        none, after, begin, inside = 0.0, -1e9, gains[0][0] if gains else -1e9, -1e9
        for b, i in gains[1:]:
            none, after, begin, inside = none + oo, max(after + oo, begin + bo, inside + io), max(none + ob, after + ob, begin + bb, inside + ib) + b, max(begin + bi, inside + ii) + i
        return max(after, begin, inside) - none

    def viterbi(self, gains: list[tuple[float, float]]) -> list[int]:
        steps = [row[:] for row in self.steps]
        steps[_OUT][_INSIDE] = -1e9
        best, back = [0.0, gains[0][0], -1e9], []
        for b, i in gains[1:]:
            origin = [max(range(3), key=lambda x, to=to: best[x] + steps[x][to]) for to in range(3)]
            best = [best[x] + steps[x][to] + g for to, (x, g) in enumerate(zip(origin, (0.0, b, i), strict=True))]
            back.append(origin)
        out = [max(range(3), key=best.__getitem__)]
        for origin in reversed(back):
            out.append(origin[out[-1]])
        return out[::-1]


class _Known(dict):
    """Chunks' rows of the field's table: gain, whether one token, what it adds to the next two chunks, if it is a clue."""

    def __init__(self, field: Field):
        self.field = field

    def __missing__(self, chunk: str) -> int:
        field = self.field
        field.fresh.append((*(field.outlook(chunk, named(chunk)) if chunk else (-1e9, False)), *field.context(chunk)))
        field.chars += len(chunk)
        self[chunk] = at = len(self)
        return at


def _forward_backward(emissions: np.ndarray, moves: np.ndarray, lengths: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Marginals of labels (sequence, place, label) and of moves (summed, each sequence so many times), when padded."""
    count, most, _ = emissions.shape
    add = lambda x, axis: (m := x.max(axis=axis, keepdims=True)).squeeze(axis) + np.log(np.exp(x - m).sum(axis=axis))
    ahead = np.zeros_like(emissions)
    ahead[:, 0] = emissions[:, 0]
    for t in range(1, most):
        ahead[:, t] = add(ahead[:, t - 1][:, :, None] + moves[None], 1) + emissions[:, t]
    behind = np.zeros_like(emissions)
    for t in range(most - 2, -1, -1):
        step = add(moves[None] + (emissions[:, t + 1] + behind[:, t + 1])[:, None, :], 2)
        behind[:, t] = np.where((t + 1 < lengths)[:, None], step, 0)
    total = add(ahead[np.arange(count), lengths - 1], 1)
    labels = np.exp(ahead + behind - total[:, None, None])
    pairs = np.zeros((3, 3))
    for t in range(most - 1):
        joint = ahead[:, t][:, :, None] + moves[None] + (emissions[:, t + 1] + behind[:, t + 1])[:, None, :] - total[:, None, None]
        pairs += (np.exp(joint[t + 1 < lengths]) * times[t + 1 < lengths, None, None]).sum(axis=0)
    return labels, pairs


def generated_lines(count: int, seed: int) -> list[tuple[str, list[tuple[int, int]]]]:
    """Lines and the spans of the secrets in them."""
    r = random.Random(seed)
    alnum, lower = string.ascii_letters + string.digits, string.ascii_lowercase
    pick = lambda chars, a, b: "".join(r.choices(chars, k=r.randint(a, b)))
    syllables = lambda a, b: "".join(r.choice(["", *"bcdfghjklmnprstvwz", "ch", "st", "tr"]) + r.choice(beyond if r.random() < 0.08 else "aeiou") + r.choice(["", "", *"nrst"]) for _ in range(r.randint(a, b)))
    beyond = "äöüßéèêçñóí"
    camel = lambda a, b: "".join(syllables(1, 2).capitalize() for _ in range(r.randint(a, b)))
    spoken = lambda: syllables(1, 4) if r.random() < 0.75 else r.choice([lambda: syllables(1, 4).capitalize(), lambda: syllables(1, 4).upper(), lambda: syllables(1, 2) + "-" + syllables(1, 2), lambda: syllables(1, 2) + "'" + r.choice("ts"), lambda: camel(2, 3), lambda: syllables(1, 3) + "_" + syllables(1, 3), lambda: syllables(1, 2) + camel(1, 2) + "();", lambda: "(" + syllables(1, 3) + ")", lambda: '"' + syllables(1, 4) + '"', lambda: str(r.randint(0, 99999)), lambda: syllables(1, 3) + r.choice("$%*#&|") * 3, lambda: r.choice(["|", "-", "=", "{", "}", "##", "--", "...", "é", "//"]), lambda: "".join(r.choices("$%*#&|!?@", k=r.randint(1, 12)))])()
    word = lambda: (pick(lower, 2, 9) if r.random() < 0.2 else spoken()) + r.choice(["", "", "", "", ",", ".", "!", ":"])
    marks = "!@#$%^&*?~"
    riddled = lambda k: "".join((r.choice(marks) if r.random() < 0.25 else r.choice(alnum)) for _ in range(k))
    plainly = str.maketrans(beyond, "aouseeecnoi")
    secrets = [
        lambda: pick(alnum, 16, 44), lambda: pick(alnum + "+/", 38, 44), lambda: pick(alnum + "+/", 30, 60) + r.choice(["=", "=="]), lambda: pick(string.digits + "abcdef", 20, 64),
        lambda: r.choice(["ghp_", "gho_", "sk-", "sk_live_", "xoxb-", "pk_test_", "glpat-", "AIza"]) + pick(alnum, 20, 40), lambda: "eyJ" + pick(alnum + "_-", 15, 40) + "." + pick(alnum + "_-", 20, 60) + "." + pick(alnum + "_-", 20, 43),
        lambda: "AKIA" + pick(string.ascii_uppercase + string.digits, 16, 16), lambda: pick(string.ascii_uppercase + string.digits, 20, 32), lambda: pick(alnum, 8, 12) + pick(string.digits, 2, 3), lambda: pick(alnum, 10, 20) + ":" + pick(alnum, 20, 36),
        # letters only, rich in symbols, short: only ever after a name that tells
        lambda: pick(string.ascii_letters, 12, 40), lambda: camel(2, 4).translate(plainly) + r.choice(["", "-", "_"]) + camel(1, 3).translate(plainly), lambda: r.choice("-_.").join(syllables(1, 3).translate(plainly) for _ in range(r.randint(3, 5))),
        lambda: r.choice(alnum) + riddled(r.randint(6, 22)) + r.choice(marks) + r.choice(alnum), lambda: syllables(2, 3).translate(plainly).replace("a", "@").replace("o", "0").replace("e", "3").capitalize() + r.choice(marks) + pick(string.digits + lower, 1, 4),
        lambda: syllables(1, 2).translate(plainly).replace("e", "3").replace("o", "0") + pick(lower + string.digits, 1, 4) + r.choice(string.digits), lambda: camel(1, 2).translate(plainly) + r.choice(marks) + pick(string.digits, 2, 4),
    ]
    plain = [
        lambda: pick(string.digits, 8, 19), lambda: f"+{r.randint(1, 99)}-{r.randint(200, 999)}-{r.randint(100, 999)}-{r.randint(1000, 9999)}", lambda: f"{r.randint(1900, 2099)}-{r.randint(1, 12):02}-{r.randint(1, 28):02}",
        lambda: f"{r.randint(1900, 2099)}-{r.randint(1, 12):02}-{r.randint(1, 28):02}T{r.randint(0, 23):02}:{r.randint(0, 59):02}:{r.randint(0, 59):02}", lambda: f"{pick(lower, 3, 9)}.{pick(lower + '.', 3, 9)}{r.randint(1, 999)}@{pick(lower, 3, 9)}{r.choice(['', '2'])}.example.com",
        lambda: f"https://{pick(lower, 4, 12)}.example.com/{pick(lower, 3, 9)}/{r.randint(1, 99999)}", lambda: f"{pick(lower, 4, 14)}{r.randint(1, 99)}", lambda: f"{pick(lower, 4, 12)}_{pick(lower, 3, 9)}_{r.randint(1, 9999)}.{r.choice(['jpg', 'txt', 'csv', 'py'])}",
        lambda: ".".join(str(r.randint(0, 255)) for _ in range(4)) + r.choice(["", ":8080"]), lambda: f"{pick(lower, 4, 12)}-{r.randint(0, 9)}.{r.randint(0, 30)}.{r.randint(0, 30)}", lambda: f"{r.randint(1, 999)},{r.randint(100, 999)}.{r.randint(10, 99)}",
        lambda: "-".join([pick("0123456789abcdef", k, k) for k in (8, 4, 4, 4, 12)]), lambda: f"{pick(lower, 3, 8)}/{pick(lower, 3, 8)}/{pick(lower, 3, 8)}{r.randint(0, 99)}", lambda: f"CC-BY-NC-{r.randint(1, 4)}.0", lambda: f"DE{pick(string.digits, 20, 20)}",
        lambda: f"{pick(string.digits, 4, 4)}-{pick(string.digits, 4, 4)}-{pick(string.digits, 4, 4)}-{pick(string.digits, 4, 4)}", lambda: pick(lower, 2, 6) + "".join(r.choice(["2", "4"]) + pick(lower, 2, 5) for _ in range(2)), lambda: pick(string.ascii_uppercase, 3, 8) + pick(string.digits, 4, 6),
    ]
    names = ["password", "passwd", "secret", "token", "api_key", "apikey", "key", "auth", "credential", "pwd", "access_token", "client_secret", "AWS_SECRET_ACCESS_KEY", "bearer", "Authorization: Bearer", "db_password", "passphrase"]
    schemes = ["postgres", "postgresql", "mysql", "mongodb", "redis", "amqp", "https", "ftp", "smtp", "mongodb+srv"]
    host = lambda: r.choice([lambda: f"{syllables(1, 3).translate(plainly)}.example.{r.choice(['com', 'net', 'org'])}", lambda: "localhost", lambda: f"{syllables(1, 2).translate(plainly)}-{r.randint(1, 9)}", lambda: ".".join(str(r.randint(0, 255)) for _ in range(4))])() + r.choice(["", "", f":{r.randint(80, 65000)}"])
    user = lambda: r.choice(["admin", "root", "user", "app", "git", syllables(1, 3).translate(plainly), syllables(1, 2).translate(plainly) + str(r.randint(1, 99))])
    path = lambda: r.choice(["", "/", f"/{syllables(1, 2).translate(plainly)}", f"/{syllables(1, 2).translate(plainly)}?x={r.randint(1, 9)}"])
    # names that tell, before what is no secret
    idle = ["none", "null", "true", "false", "required", "string", "value", "changed", "is", "was", "for", "and", "empty", "expired", "<token>", "${TOKEN}", "****", "the", "count", "of", "read", "get_password()", "input()", "{", "("]
    other = ["id", "date", "version", "phone", "call", "order", "see", "at", "mail", "number", "price", "build", "file", "sku", "class", "name", "title", "type"]
    out = []
    for _ in range(count):
        words = [word() for _ in range(r.randint(0, 6))]
        line, spans = " ".join(words) + (" " if words else ""), []
        for _ in range(r.randint(1, 2)):
            hidden = r.random() < 0.5
            body = r.choice(secrets)() if hidden else r.choice(plain)()
            quote = r.choice(["", "", '"', "'"])
            style = r.random()
            if r.random() < 0.12:  # addresses, with a password or without
                lead, tail = f"{r.choice(['', '', 'url=', 'see '])}{r.choice(schemes)}://", host() + path()
                if hidden:
                    body = r.choice([lambda: pick(alnum, 6, 24), lambda: r.choice(alnum) + "".join(r.choice("!#$%^&*?~") if r.random() < 0.15 else r.choice(alnum) for _ in range(r.randint(6, 18))), lambda: syllables(2, 3).translate(plainly) + pick(string.digits, 1, 4)])()
                    lead += user() + ":"
                    line += lead
                    spans.append((len(line), len(line) + len(body)))
                    line += body + "@" + tail + " " + word() + " "
                else:
                    line += lead + r.choice(["", "", user() + "@"]) + tail + " " + word() + " "
                continue
            if hidden:
                name = r.choice(names)
                lead = f"{name}{r.choice(['=', ' = ', ': ', ':'])}" if style < 0.6 else f"{name} {r.choice(['is ', '', ''])}" if style < 0.85 else ""
                if name.endswith("Bearer"):
                    lead = name + " "
                if not lead and (len(body) < 20 or body.isdigit()):
                    lead = name + " "
                telling = any(c in marks for c in body) or not _DIGIT.search(body) or len(body) < 10
                if telling and not re.search("[:=]|Bearer", lead):
                    lead = name + r.choice(["=", " = ", ": ", ":"])
                if not lead.strip() and not re.match(r"ghp_|gho_|sk|xoxb|pk_|glpat|AIza|eyJ|AKIA", body):
                    lead = name + "="
            elif style > 0.8:
                name = r.choice(names)
                lead = f"{name}{r.choice(['=', ' = ', ': ', ' ', ' '])}"
                body, quote = r.choice(idle) if style > 0.88 else syllables(1, 4), ""
            else:
                if style < 0.1:
                    body = r.choice([lambda: syllables(2, 4), lambda: camel(2, 4), lambda: syllables(1, 3) + "-" + syllables(1, 3), lambda: syllables(1, 2) + "_" + syllables(1, 2)])()
                lead = f"{r.choice(other)}{r.choice(['=', ': ', ' '])}" if style < 0.4 else ""
                quote = quote if style < 0.2 else ""
            if "bearer" in lead.lower() or lead.startswith("auth "):
                quote = ""
            line += lead + quote
            if hidden:
                spans.append((len(line), len(line) + len(body)))
            line += body + quote + r.choice([" ", " ", ", ", ". "]) + word() + " "
        out.append((line, spans))
    return out


def _sequences(lines: list) -> list[tuple[list[list[str]], list[int]]]:
    """Features and true labels of the tokens of each chunk."""
    out = []
    for text, spans in lines:
        of_file = file_features(text)
        chunks = list(re.finditer(r"\S+", text))
        for k, m in enumerate(chunks):
            one, two = (chunks[k - d][0] if k >= d else "" for d in (1, 2))
            places, rows, start = chunk_features(*outline(m[0]), known_head(m[0]), _clue_of(m[0], one, two))
            if start >= 0:
                rows[start] += word_features(one)[0] + word_features(two)[1] + of_file
            at = m.start()
            inside = [next(((s, a + at <= s) for s, e in spans if a + at < e and s < b + at), None) for a, b in places]
            out.append((rows, [_OUT if x is None else _BEGIN if x[1] else _INSIDE for x in inside]))
    return out


def _clue_of(chunk: str, one: str, two: str) -> str:
    return "lead" if named(chunk) else "near" if any(is_clue(w.strip(_EDGE).lower()) for w in (one, two)) else "none"


@lru_cache(maxsize=1)
def trained_field(lines: int = 2000, rounds: int = 100, seed: int = 7) -> Field:
    """Maximum likelihood with a ridge, by Adam over all sequences at once. The same weights in each process."""
    counts: dict = {}  # equal sequences are one, with a weight
    for rows, labels in _sequences(generated_lines(lines, seed)):
        key = tuple(map(tuple, rows)), tuple(labels)
        counts[key] = counts.get(key, 0) + 1
    sequences = sorted(counts, key=lambda x: len(x[1]))
    seen: dict[str, int] = {}
    for key in sequences:
        for row in key[0]:
            for f in row:
                seen[f] = seen.get(f, 0) + counts[key]
    field = Field(sorted(f for f, n in seen.items() if n >= 3))
    unseen = len(field.names)
    wide = max(len(row) for rows, _ in sequences for row in rows)
    lengths = np.array([len(x) for _, x in sequences])
    first = np.concatenate([[0], np.cumsum(lengths)])
    ids = np.full((first[-1], wide), unseen)
    for at, row in enumerate(row for rows, _ in sequences for row in rows):
        ids[at, : len(row)] = [field.names.get(f, unseen) for f in row]
    gold = np.eye(3)[np.array([x for _, labels in sequences for x in labels])]
    times = np.array([counts[k] for k in sequences], float)
    gold_moves = np.zeros((3, 3))
    for key in sequences:
        for a, b in zip(key[1], key[1][1:], strict=False):
            gold_moves[a, b] += counts[key]
    # sequences of like lengths are padded together
    cuts = [0, *(np.flatnonzero(np.diff(np.ceil(np.log2(lengths)))) + 1), len(lengths)]
    groups = []
    for low, high in zip(cuts, cuts[1:], strict=False):
        most = lengths[high - 1]
        inside = np.arange(most)[None] < lengths[low:high, None]
        groups.append((low, high, inside, (first[low:high, None] + np.arange(most)[None])[inside]))
    state = [[np.zeros_like(p), np.zeros_like(p)] for p in (field.weights, field.moves)]
    bar = np.zeros((3, 3))
    bar[_OUT, _INSIDE] = -1e4
    for step in range(1, rounds + 1):
        emissions = field.weights[ids].sum(axis=1)
        error, pairs = np.empty_like(gold), np.zeros((3, 3))
        for low, high, inside, places in groups:
            padded = np.zeros((*inside.shape, 3))
            padded[inside] = emissions[places]
            padded[:, 0, _INSIDE] -= 1e4
            marginals, joint = _forward_backward(padded, field.moves + bar, lengths[low:high], times[low:high])
            error[places] = ((gold[places] - marginals[inside]).T * np.repeat(times[low:high], lengths[low:high])).T
            pairs += joint
        gradient = np.stack([np.bincount(ids.ravel(), np.repeat(error[:, j], wide), unseen + 1) for j in range(3)], 1)
        gradient[unseen] = 0
        for (mean, spread), value, g in zip(state, (field.weights, field.moves), (gradient - 0.2 * field.weights, gold_moves - pairs - 0.2 * field.moves), strict=True):
            mean += 0.1 * (g - mean)
            spread += 0.001 * (g * g - spread)
            value += 0.1 * (mean / (1 - 0.9**step)) / (np.sqrt(spread / (1 - 0.999**step)) + 1e-8)
    return field.ready()


def crf_spans(text: str, field: Field) -> list[tuple[int, int, str]]:
    """start, end, "crf" of what the field tags in the chunks of a text."""
    chunks = text.split()
    if not chunks:
        return []
    if len(field.known) > field.MOST or field.chars > field.MOST_CHARS:
        field.forget()
    ids = field.numbers(chunks)
    one, two = np.concatenate([[0], ids[:-1]]), np.concatenate([[0, 0], ids[:-2]])[: len(ids)]
    of_file = file_features(text)
    table = field.table
    context = table[one, 2:4] + table[two, 4:6] + field.gain(of_file)
    near = (table[one, 6] + table[two, 6]) > 0
    # the words before count for the token that a value starts with; one token can't be inside
    bound = table[ids, 0] + np.where(table[ids, 1] > 0, context[:, 0], np.maximum(context.max(axis=1), 0))
    hits = np.flatnonzero((bound > -1e-6) | near)
    if not len(hits):
        return []
    out, places = [], [m.start() for m in re.finditer(r"\S+", text)]
    for k in hits.tolist():
        chunk, at = chunks[k], places[k]
        tokens, rows, start = chunk_features(*outline(chunk), known_head(chunk), "lead" if named(chunk) else "near" if near[k] else "none")
        gains = [field.gain(r) for r in rows]
        if start >= 0:
            gains[start] = gains[start][0] + context[k, 0], gains[start][1] + context[k, 1]
        for (a, b), label in zip(tokens, field.viterbi(gains), strict=True):
            if label == _BEGIN:
                out.append([at + a, at + b])
            elif label == _INSIDE:
                out[-1][1] = at + b
    return [(a, a + len(text[a:b].rstrip(".")), "crf") for a, b in out]


def all_spans(text: str, field: Field) -> tuple[list, list]:
    """The base spans; and those with the field's that no base span holds whole."""
    base = base_spans(text)
    added = [x for x in crf_spans(text, field) if not any(s <= x[0] and x[1] <= e for s, e, _ in base)]
    return base, sorted(base + added, key=lambda x: (x[0], KINDS.index(x[2]))) if added else base


def _listed(spans) -> str:
    return ",".join(f"{k}:{s}:{e}" for s, e, k in spans)


_fields: dict[bytes, Field] = {}


def _scan(field: Field):
    name = hashlib.sha256(field.weights.tobytes() + field.moves.tobytes()).digest()

    def run(batches):
        own = _fields.setdefault(name, field)  # tasks of one worker go on with what it keeps of chunks
        for batch in batches:
            rows = [all_spans(t, own) for t in batch.column("text").to_pylist()]
            counts = [pa.array([sum(k == kind for _, _, k in b) for b, _ in rows], pa.int64()) for kind in KINDS[:3]]
            digests = [hashlib.sha256(_listed(b).encode()).hexdigest() for b, _ in rows]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *counts, pa.array(digests, pa.string()), pa.array([_listed(s) for _, s in rows], pa.string())],
                names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"],
            )

    return run


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans: one row for each row of ``docs`` (doc_id, text).

    spans lists kind:start:end in code points, by start and then kind: the pattern's, and of kind crf what the field adds.
    A null text counts as empty and has no spans; texts are scanned whole, however long. Of overlapping matches of
    different kinds all are listed. Rows are independent, whatever their ids, and repeated ones get equal values; further
    columns, whatever their names, are not looked at. An empty table gives an empty result.
    """
    return docs.select("doc_id", filled().alias("text")).mapInArrow(_scan(trained_field()), "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def redact(text: str, field: Field | None = None, mark: str = "[secret]") -> str:
    """The text with a mark for each span; of overlapping spans, one mark."""
    out, at = [], 0
    for s, e, _ in all_spans(text, field or trained_field())[1]:
        if s >= at:
            out += [text[at:s], mark]
        at = max(at, e)
    return "".join([*out, text[at:]])

"""Arrow functions for what Spark has no expression for: Unicode normal form,
long ordered rule cascades, sequence matching and alignment."""

from __future__ import annotations

import difflib
import re
import unicodedata
from bisect import bisect_left
from collections import Counter
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillstone.functions import values as V


@F.pandas_udf(T.StringType())
def nfc(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else unicodedata.normalize("NFC", x))


@F.pandas_udf(T.DoubleType())
def similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    """difflib's ratio, the first text first; it is not symmetric."""
    return pd.Series([None if x is None or y is None else difflib.SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b)], dtype="float64")


def _indexed(a, b) -> tuple[dict, list]:
    """Where ``b`` has each item, without those that difflib leaves out as too
    frequent in it, and where ``a`` has any of these."""
    n = len(b)
    counts = Counter(b)
    if n >= 200:
        counts = {x: k for x, k in counts.items() if k <= n // 100 + 1}
    places: dict = {x: [] for x in counts}
    for j, x in enumerate(b):
        if x in places:
            places[x].append(j)
    return places, [i for i, x in enumerate(a) if x in places]


def opcodes(a, b) -> list[tuple]:
    """``difflib.SequenceMatcher(a=a, b=b).get_opcodes()``.

    Equal parts are found at once, and the search for the longest common run
    visits only items that ``b`` has and that are not too frequent, which in a
    long text of characters are few.
    """
    places, visited = _indexed(a, b)
    todo, found = [(0, len(a), 0, len(b))], []
    while todo:
        alo, ahi, blo, bhi = todo.pop()
        if a[alo:ahi] == b[blo:bhi]:  # then the first longest run grows to all of it
            found.append((alo, blo, ahi - alo))
            continue
        besti, bestj, size = alo, blo, 0
        runs: dict = {}
        before = -2
        for at in range(bisect_left(visited, alo), bisect_left(visited, ahi)):
            i = visited[at]
            if i != before + 1:
                runs = {}
            before, longer = i, {}
            get = runs.get
            for j in places[a[i]]:
                if j < blo:
                    continue
                if j >= bhi:
                    break
                k = longer[j] = get(j - 1, 0) + 1
                if k > size:
                    besti, bestj, size = i - k + 1, j - k + 1, k
            runs = longer
        while besti > alo and bestj > blo and a[besti - 1] == b[bestj - 1]:
            besti, bestj, size = besti - 1, bestj - 1, size + 1
        while besti + size < ahi and bestj + size < bhi and a[besti + size] == b[bestj + size]:
            size += 1
        if size:
            found.append((besti, bestj, size))
            if alo < besti and blo < bestj:
                todo.append((alo, besti, blo, bestj))
            if besti + size < ahi and bestj + size < bhi:
                todo.append((besti + size, ahi, bestj + size, bhi))
    found.sort()
    whole: list[list] = []
    for i, j, size in found:
        if whole and whole[-1][0] + whole[-1][2] == i and whole[-1][1] + whole[-1][2] == j:
            whole[-1][2] += size
        elif size:
            whole.append([i, j, size])
    out, i, j = [], 0, 0
    for ai, bj, size in [*whole, (len(a), len(b), 0)]:
        if i < ai and j < bj:
            out.append(("replace", i, ai, j, bj))
        elif i < ai:
            out.append(("delete", i, ai, j, bj))
        elif j < bj:
            out.append(("insert", i, ai, j, bj))
        i, j = ai + size, bj + size
        if size:
            out.append(("equal", ai, i, bj, j))
    return out


def align(ref, other) -> list:
    """For each item of ``ref`` the item of ``other`` in its place, or None.
    An insertion only fills a gap right before it."""
    out: list = []
    for tag, i1, i2, j1, j2 in opcodes(ref, other):
        if tag == "insert":
            if out and out[-1] is None:
                out[-1] = other[j1]
            continue
        own = list(other[j1:j2])[: i2 - i1]
        out += own + [None] * (i2 - i1 - len(own))
    return out


@F.pandas_udf(T.ArrayType(T.StringType()))
def align_words(ref: pd.Series, other: pd.Series) -> pd.Series:
    return pd.Series([align((a or "").split(), (b or "").split()) for a, b in zip(ref, other)])


def fuse(texts: list[str], confidences: list[float], by_char: bool) -> str:
    """Votes position by position along the longest text."""
    parts = [t.strip() if by_char else t.split() for t in texts]
    if not parts:
        return ""
    ref = max(parts, key=len)
    rows = zip(*[align(ref, p) for p in parts])
    out = []
    for own, seen in zip(ref, rows):
        if seen.count(own) == len(seen):
            out.append(own)
            continue
        votes: dict[str, list[float]] = {}
        for x, conf in zip(seen, confidences):
            if x is not None:
                votes.setdefault(x, []).append(conf)
        if not votes:
            out.append(own)
        elif by_char:
            out.append(max(votes, key=lambda v: (sum(votes[v]), v)))
        else:
            out.append(max(votes, key=lambda v: (len(votes[v]), sum(votes[v]) / len(votes[v]))))
    return ("" if by_char else " ").join(out)


def _fused(by_char: bool):
    @F.pandas_udf(T.StringType())
    def run(texts: pd.Series, confidences: pd.Series) -> pd.Series:
        return pd.Series([fuse(list(t), list(c), by_char) for t, c in zip(texts, confidences)])

    return run


fuse_words, fuse_chars = _fused(False), _fused(True)


def distance(a: str, b: str, most: int) -> int:
    """The edit distance, or any number over ``most`` if it is over that."""
    while a and b and a[0] == b[0]:
        a, b = a[1:], b[1:]
    while a and b and a[-1] == b[-1]:
        a, b = a[:-1], b[:-1]
    if not a or not b or abs(len(a) - len(b)) > most or (most == 1 and max(len(a), len(b)) > 1):
        return max(len(a), len(b))
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return row[-1]


class Nearest(dict):
    """The known word nearest to a word by edit distance, of equally near ones
    the first by code point; the word itself if none is near enough.  So many
    words are remembered, which is a matter of speed only."""

    MOST = 200_000

    def __init__(self, known: list[str], least: float):
        self.known, self.least = sorted(known), least
        self.own = set(known)
        self.by_length: dict[int, list] = {}

    def fitting(self, n: int) -> list:
        """(word, greatest length) of those that the lengths do not rule out."""
        if n not in self.by_length:
            pairs = [(k, max(n, len(k))) for k in self.known]
            self.by_length[n] = [(k, m) for k, m in pairs if m and 1 - max(abs(n - len(k)), 1) / m >= self.least]
        return self.by_length[n]

    def __missing__(self, word: str) -> str:
        best, found = -1.0, word
        if word not in self.own:
            for k, m in self.fitting(len(word)):
                most = int((1 - self.least) * m + 1e-6)
                s = 1 - distance(word, k, most) / m
                if s >= self.least and s > best:
                    best, found = s, k
        if len(word) < 64:
            if len(self) >= self.MOST:
                self.clear()
            self[word] = found
        return found


@lru_cache(maxsize=8)
def _nearest(known: tuple, least: float) -> Nearest:
    return Nearest(list(known), least)


def nearest_words(text, known: list[str], least: float):
    """``text``, words with spaces between, with each word's nearest known one."""
    fixed = tuple(known)

    @F.pandas_udf(T.StringType())
    def run(s: pd.Series) -> pd.Series:
        near = _nearest(fixed, least).__getitem__
        return s.map(lambda x: None if x is None else " ".join(map(near, filter(None, x.split(" ")))))

    return run(text)


@lru_cache(maxsize=8)
def _compiled(rules: tuple) -> list:
    """(gate, pattern, replacement); a gate is a literal that must be there."""
    out = []
    for kind, pattern, new in rules:
        if kind == "regex":
            out.append((None, re.compile(pattern, re.IGNORECASE), new))
        else:
            word = re.compile(rf"\b{re.escape(pattern)}\b", re.IGNORECASE)
            out.append((pattern.lower(), word, new.replace("\\", r"\\")))
    return out


def cascade(text: str, rules: tuple) -> str:
    """All rules in order, then white space and the spaces around marks."""
    text = unicodedata.normalize("NFC", text)
    low = text.lower()
    for gate, pattern, new in _compiled(rules):
        if gate is None or gate in low:
            changed = pattern.sub(new, text)
            if changed != text:
                text, low = changed, changed.lower()
    text = re.sub(r"\s+", " ", text).strip()
    text = re.sub(r"\s+([,.!?;:])", r"\1", text)
    return re.sub(r"([,.!?;:])(?!\s|$)", r"\1 ", text)


def staged(text: str, rules: tuple) -> str:
    """The older correction: context patterns, errors anywhere in a word, split
    patterns, wrong marks, white space, last replacements, each in order.

    Kinds are ``context`` and ``split`` (patterns, ignoring case), ``error`` (a
    literal, ignoring case) and ``final`` (a literal).
    """
    by: dict[str, list] = {"context": [], "error": [], "split": [], "final": []}
    for kind, pattern, new in rules:
        by[kind].append((pattern, new))
    for kind in ("context", "error", "split"):
        for pattern, new in by[kind]:
            if kind == "error":
                text = re.sub(re.escape(pattern), lambda _, new=new: new, text, flags=re.IGNORECASE)
            else:
                text = re.sub(pattern, new, text, flags=re.IGNORECASE)
    for old, new in V.WRONG_MARKS.items():
        text = text.replace(old, new)
    text = re.sub(r"\s+", " ", text).strip()
    for old, new in by["final"]:
        text = text.replace(old, new)
    return text


def correct_lines(df: DataFrame, rules: list[tuple[str, str, str]], text: str = "text", out: str = "corrected") -> DataFrame:
    """``df`` with ``out``: the older correction of each non-blank line."""
    fixed = tuple(tuple(r) for r in rules)

    def one(x: str) -> str:
        return "\n".join(staged(line, fixed) for line in map(str.strip, x.split("\n")) if line)

    @F.pandas_udf(T.StringType())
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else one(x))

    return df.withColumn(out, run(F.col(text)))


def ordered(rules: list[tuple[str, str, str]]) -> tuple:
    """Regular expressions as given, then phrases, then words, both longest
    first; of equal length as given."""
    kinds = ["regex", "phrase", "word"]
    return tuple(sorted((tuple(r) for r in rules), key=lambda r: (kinds.index(r[0]), 0 if r[0] == "regex" else -len(r[1]))))


def correct(df: DataFrame, rules: list[tuple[str, str, str]], text: str = "text", out: str = "corrected") -> DataFrame:
    """``df`` with ``out``: ``text`` after all ``rules`` (kind, pattern, new).

    ``rules`` are the caller's tables; see ``operators.rules`` for reading
    them from a table and for adding to them.
    """
    fixed = ordered(rules)

    @F.pandas_udf(T.StringType())
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else cascade(x, fixed))

    return df.withColumn(out, run(F.col(text)))


def register(spark) -> None:
    """The functions under SQL names."""
    for name, f in (("nfc", nfc), ("similarity", similarity), ("align_words", align_words)):
        spark.udf.register(name, f)


"""Document fingerprints: invertible Bloom lookup sketches of paragraphs.

A fingerprint files the 64-bit digest of every paragraph in three cells, one
in each third of a fixed-size table.  A cell holds a count, the XOR of its
digests and the XOR of their checks.  Two versions' tables subtract cell by
cell; equal paragraphs cancel, and peeling cells that hold one digest recovers
the paragraphs that differ.  If peeling stalls, both versions are filed again
in larger tables: one of the size that a sample of the digests suggests, then
ones twice as large, until a table has several cells for each paragraph; then
the sorted digests are compared.  Large tables are numpy arrays.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillstone.llm.common import materialize, ranges

CELLS = 24
#: Tables from this many cells or digests on are numpy arrays.
WIDE = 768
#: Cells beyond which sorting all digests is cheaper than peeling.
MOST = 1 << 19
#: Of the digests one in so many tells how many differ.
SAMPLE = 64
#: Cells for each paragraph of both versions beyond which no larger table is tried.
ENOUGH = 4
_MASK = (1 << 64) - 1
_GOLD = 0x9E3779B97F4A7C15
#: Odd factors whose products place a digest in the three thirds.
_MIX = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93)
_CHECK = 0xA0761D6478BD642F


def paragraph_digests(text: str) -> np.ndarray:
    """A digest for each line; the k-th repeat of a line has its own, so that
    repeats count.  An empty text has none."""
    if not text:
        return np.zeros(0, np.uint64)
    lines = Counter(text.split("\n"))
    times = np.fromiter(lines.values(), np.int64, len(lines))
    own = np.fromiter((xxhash.xxh64_intdigest(x.encode("utf-8", "surrogatepass")) for x in lines), np.uint64, len(lines))
    if len(own) == times.sum():
        return own
    ends = np.cumsum(times)
    k = np.arange(ends[-1]) - np.repeat(ends - times, times)
    first = k == 0
    z = np.repeat(own, times) + k.astype(np.uint64) * np.uint64(_GOLD)
    mixed = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    mixed = (mixed ^ (mixed >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return np.where(first, z, mixed ^ (mixed >> np.uint64(31)))


def _check(digest: int) -> int:
    return ((digest * _CHECK) & _MASK) >> 48


class Sketch:
    """A table of ``cells`` cells, a multiple of three."""

    __slots__ = ("third", "counts", "keys", "checks")

    def __init__(self, cells: int = CELLS, digests: np.ndarray | list[int] = ()):
        self.third = cells // 3
        if len(digests) >= WIDE:
            self.counts, self.keys, self.checks = (x.tolist() for x in wide_table(np.asarray(digests, np.uint64), self.third))
            return
        self.counts, self.keys, self.checks = [0] * cells, [0] * cells, [0] * cells
        for d in digests.tolist() if isinstance(digests, np.ndarray) else digests:
            self.add(d, 1)

    def places(self, digest: int) -> tuple[int, int, int]:
        third = self.third
        return tuple(k * third + (((((digest * m) & _MASK) >> 32) * third) >> 32) for k, m in enumerate(_MIX))

    def add(self, digest: int, sign: int) -> None:
        check = _check(digest)
        for at in self.places(digest):
            self.counts[at] += sign
            self.keys[at] ^= digest
            self.checks[at] ^= check

    def to_bytes(self) -> bytes:
        return b"".join(struct.pack("<HQH", n & 0xFFFF, k, c) for n, k, c in zip(self.counts, self.keys, self.checks))

    @classmethod
    def from_bytes(cls, data: bytes) -> Sketch:
        made = cls(len(data) // 12)
        for at, (n, k, c) in enumerate(struct.iter_unpack("<HQH", data)):
            made.counts[at], made.keys[at], made.checks[at] = n - (n >> 15 << 16), k, c
        return made

    def minus(self, other: Sketch) -> Sketch:
        made = Sketch(3 * self.third)
        made.counts = [a - b for a, b in zip(self.counts, other.counts)]
        made.keys = [a ^ b for a, b in zip(self.keys, other.keys)]
        made.checks = [a ^ b for a, b in zip(self.checks, other.checks)]
        return made

    def peel(self) -> tuple[list[int], list[int]] | None:
        """The digests of the left only and of the right only; None if the
        table holds more than peeling can take apart.  Empties the table."""
        left, right = [], []
        todo = list(range(3 * self.third))
        most = 3 * self.third
        while todo:
            at = todo.pop()
            n = self.counts[at]
            if n not in (1, -1) or _check(d := self.keys[at]) != self.checks[at] or at not in self.places(d):
                continue
            (left if n == 1 else right).append(d)
            if len(left) + len(right) > most:
                return None
            self.add(d, -n)
            todo.extend(self.places(d))
        if any(self.counts) or any(self.keys) or any(self.checks):
            return None
        return left, right


def wide_places(digests: np.ndarray, third: int) -> np.ndarray:
    """``Sketch.places`` of many digests, a row for each third."""
    return np.stack([(((digests * np.uint64(m)) >> np.uint64(32)) * np.uint64(third) >> np.uint64(32)).astype(np.int64) + k * third for k, m in enumerate(_MIX)])


def _file(table: tuple, digests: np.ndarray, signs: np.ndarray) -> None:
    """Add the digests to their cells, cell by cell in order."""
    if not len(digests):
        return
    counts, keys, checks = table
    own = (digests * np.uint64(_CHECK)) >> np.uint64(48)
    for at in wide_places(digests, len(counts) // 3):
        order = np.argsort(at, kind="stable")
        at = at[order]
        firsts = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
        cells = at[firsts]
        counts[cells] += np.add.reduceat(signs[order], firsts)
        keys[cells] ^= np.bitwise_xor.reduceat(digests[order], firsts)
        checks[cells] ^= np.bitwise_xor.reduceat(own[order], firsts)


def wide_table(digests: np.ndarray, third: int) -> tuple:
    """Counts, keys and checks of a table, as arrays."""
    table = np.zeros(3 * third, np.int64), np.zeros(3 * third, np.uint64), np.zeros(3 * third, np.uint64)
    _file(table, digests, np.ones(len(digests), np.int64))
    return table


def wide_peel(a: np.ndarray, b: np.ndarray, cells: int) -> tuple[np.ndarray, np.ndarray] | None:
    """The digests only in ``a`` and only in ``b`` by a table of ``cells``
    cells; None if peeling stalls.  All cells that hold one digest go at once."""
    third = cells // 3
    table = counts, keys, checks = wide_table(a, third)
    _file(table, b, np.full(len(b), -1, np.int64))
    only, todo = [], np.arange(3 * third)
    while len(todo):
        one = todo[(np.abs(counts[todo]) == 1)]
        d = keys[one]
        one = one[((d * np.uint64(_CHECK)) >> np.uint64(48)) == checks[one]]
        at = wide_places(keys[one], third)
        one = one[(at == one).any(0)]
        if not len(one):
            break
        d, first = np.unique(keys[one], return_index=True)
        signs = counts[one[first]]
        only.append((d, signs))
        if sum(len(x) for x, _ in only) > 3 * third:
            return None
        _file(table, d, -signs)
        todo = np.sort(wide_places(d, third), axis=None)
        todo = todo[np.concatenate([[True], todo[1:] != todo[:-1]])]
    if counts.any() or keys.any() or checks.any():
        return None
    d, signs = (np.concatenate([x[i] for x in only]) if only else np.zeros(0, np.int64) for i in (0, 1))
    return d[signs == 1], d[signs == -1]


def _likely(a: np.ndarray, b: np.ndarray) -> int:
    """About how many digests are in one version only, by a sample of them."""
    left, right = (x[x % np.uint64(SAMPLE) == 0] for x in (a, b))
    return max(abs(len(a) - len(b)), SAMPLE * len(np.setxor1d(left, right, True)))


def differing(a: np.ndarray, b: np.ndarray, first: Sketch | None = None, second: Sketch | None = None, cells: int = CELLS) -> tuple:
    """The digests only in ``a`` and only in ``b``, by sketches that grow until
    they peel, and by comparing all if ample tables do not.  The first table's
    sketches may be given."""
    if first is None:
        first, second = Sketch(cells, a), Sketch(cells, b)
    found = first.minus(second).peel()
    if found is not None:
        return found
    if len(a) + len(b) >= WIDE:  # the next table is one that should do
        while cells < 1.5 * _likely(a, b):
            cells *= 2
    most = min(MOST, max(cells, ENOUGH * (len(a) + len(b))))
    while (cells := 2 * cells) <= most:
        if cells < WIDE and len(a) + len(b) < WIDE:
            found = Sketch(cells, a).minus(Sketch(cells, b)).peel()
        else:
            found = wide_peel(a, b, cells)
        if found is not None:
            return found
    return np.setdiff1d(a, b, True), np.setdiff1d(b, a, True)


def likeness(a: np.ndarray, b: np.ndarray, only_a, only_b) -> float:
    """Shared paragraphs over all paragraphs; 1 if neither text has any."""
    union = len(b) + len(only_a)
    return (len(a) - len(only_a)) / union if union else 1.0


def edited(text: str, following: str) -> str:
    """``text`` with its last half replaced by the start of the next text."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def compare(text: str, following: str, cells: int = CELLS) -> tuple:
    """n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next."""
    other = edited(text, following)
    sha = hashlib.sha256(other.encode("utf-8", "surrogatepass")).hexdigest()
    own, changed, after = map(paragraph_digests, (text, other, following))
    a, b, c = (Sketch(cells, x) for x in (own, changed, after))
    near = [likeness(own, x, *differing(own, x, a, s, cells)) for x, s in ((changed, b), (after, c))]
    code = [base64.b64encode(s.to_bytes()).decode() for s in (a, b)]
    return len(text), sha, *code, *near


_COLUMNS = T.StructType(
    [
        T.StructField("n_chars", T.LongType()),
        T.StructField("edited_sha256", T.StringType()),
        T.StructField("fingerprint", T.StringType()),
        T.StructField("edited_fingerprint", T.StringType()),
        T.StructField("near_edited", T.DoubleType()),
        T.StructField("near_next", T.DoubleType()),
    ]
)


_NULL = -(1 << 63)


def _ordered(docs: DataFrame) -> tuple[Column, Column]:
    """What documents are ordered by: the id, null as the least, and a hash of
    the text."""
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(_NULL)), F.xxhash64("text", F.col("text").isNull())


def with_following(docs: DataFrame, n: int | None = None) -> DataFrame:
    """Rows ``_bucket, doc_id, text, _ghost``, a partition for each bucket.

    Buckets are ranges of (id, hash of the text).  They begin at rows that
    occur, so the first row of a bucket is known: it is also sent, as a ghost,
    to the end of the bucket before it.  The driver holds the first row's id
    and hash of each bucket, 16 bytes for about 48 MB of text.
    """
    n = n or ranges(docs)
    key, h = _ordered(docs)
    ids = docs.select(key.alias("key"), h.alias("h")).repartitionByRange(n, "key", "h")
    lows = ids.groupBy(F.spark_partition_id().alias("p")).agg(F.min(F.struct("key", "h")).alias("low")).select("low.key", "low.h")
    firsts = sorted(map(tuple, materialize(lows, "lows").collect()))
    m = max(1, len(firsts))
    keys, hashes = (np.array([x[i] for x in firsts], np.int64) for i in (0, 1))

    @F.pandas_udf(T.LongType())
    def place(key: pd.Series, h: pd.Series) -> pd.Series:
        """Twice the bucket, and one more for the first row of it."""
        k, h = key.to_numpy(), h.to_numpy()
        low, high = np.searchsorted(keys, k, "left"), np.searchsorted(keys, k, "right")
        own = high - 1
        for i in np.flatnonzero(high - low > 0):  # ids at which a bucket begins
            own[i] = low[i] + np.searchsorted(hashes[low[i] : high[i]], h[i], "right") - 1
        own = np.maximum(own, 0)
        return pd.Series(2 * own + ((keys[own] == k) & (hashes[own] == h)))

    placed = docs.select("doc_id", "text", place(key, h).alias("_at"))
    own, starts = F.shiftright("_at", 1).cast("int"), F.col("_at") % 2 == 1
    before = F.when(own == 0, F.lit(m - 1)).otherwise(own - 1)
    here = F.struct(own.alias("b"), F.lit(False).alias("g"))
    places = F.when(starts, F.array(here, F.struct(before.alias("b"), F.lit(True).alias("g")))).otherwise(F.array(here))
    rows = placed.select("doc_id", "text", F.explode(places).alias("_p"))
    rows = rows.select(F.col("_p.b").alias("_bucket"), "doc_id", "text", F.col("_p.g").alias("_ghost"))
    # rows of one id and text may be many; of its ghosts only the first counts
    return rows.repartitionById(m, "_bucket").sortWithinPartitions("_bucket", "_ghost", *_ordered(rows), "text")


def fingerprints(docs: DataFrame, cells: int = CELLS, n: int | None = None) -> DataFrame:
    """Fingerprints of every text and of its edited version, and how like the
    edited and the next text they are.

    ``docs`` needs a ``doc_id`` that casts to long (text ids fail) and
    ``text``; other columns are not read.  A null text counts as empty.  Null
    ids come first; repeated ids are in order of a hash of their texts, then of
    the texts; the text after the last is the first.  An empty table gives an
    empty result.  A task holds one bucket's rows and, while it works, two
    texts; only rows with the same id and the same text cannot be split.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # a row that waits for the text after it

        def made(rows: list[tuple]) -> pa.RecordBatch:
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], ["doc_id", *_COLUMNS.names])

        for batch in batches:
            out = []
            for bucket, doc_id, text, ghost in zip(*(batch.column(i) for i in range(4))):
                bucket, ghost, text = bucket.as_py(), ghost.as_py(), text.as_py() or ""
                if held and held[0] == bucket:
                    out.append((held[1], *compare(held[2], text, cells)))
                held = None if ghost else (bucket, doc_id.as_py(), text)
                if len(out) >= 256:
                    yield made(out)
                    out = []
            if out:
                yield made(out)

    rows = with_following(docs, n)
    return rows.mapInArrow(run, T.StructType([T.StructField("doc_id", T.LongType()), *_COLUMNS.fields]))

"""SimHash near-duplicate detection by multi-index hashing.

Every distinct fingerprint is filed under each of its segments.  It then looks
up, in every segment's table, all values in a small Hamming ball around its own
segment: if two fingerprints differ in at most ``distance`` bits, some segment
of theirs differs in at most ``distance // segments`` bits, so no link is lost.
Matches are verified on the whole fingerprint inside the join.

Scale: copies collapse to one fingerprint before any search, so a group of
exact copies costs one row whatever its size.  In a crowded table slot the most
frequent fingerprint stands for the slot; two members that both link to it are
already connected and are not paired again.  Components come from alternating
large-star and small-star rounds on written edge tables.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillstone.llm.common import materialize

#: A slot with this many fingerprints gets a representative.
CROWDED = 16
#: Tasks that the rows of one fingerprint or node go to.
SALTS = 8
#: A fingerprint or component with this part of the rows is joined apart.
HOT = 1000
#: More distinct fingerprints than this are searched with two wide segments,
#: as the chance matches within narrow ones grow with the table's fill.
WIDE_ABOVE = 1 << 26

_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def fingerprint(text: str | None, shingle: int = 4, seed: int = 42) -> int:
    """The 64-bit SimHash of ``text``, unsigned; 0 for a text without words."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not words:
        return 0
    joined = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if len(words) <= shingle:
        hashes = [digest(joined, seed)]
    else:
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        ends = np.cumsum(sizes + 1) - 1
        firsts = (ends - sizes)[: len(words) - shingle + 1].tolist()
        hashes = [digest(joined[a:b], seed) for a, b in zip(firsts, ends[shingle - 1 :].tolist())]
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):  # bounded memory for very long texts
        part = np.array(hashes[at : at + (1 << 16)], dtype="<u8")
        bits = np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = 4, seed: int = 42) -> DataFrame:
    """``doc_id, fp`` (signed 64 bits) of every row; null texts count as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [fingerprint(t.as_py(), shingle, seed) for t in batch.column(1)]
            fps = pa.array(np.array(found, dtype=np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), fps], ["doc_id", "fp"])

    schema = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("fp", T.LongType())])
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def _segments(n: int, bits: int = 64) -> list[tuple[int, int]]:
    """(offset, width) of ``n`` segments that cover all bits."""
    cuts = [round(i * bits / n) for i in range(n + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:])]


def _ball(width: int, radius: int) -> list[int]:
    """All masks with at most ``radius`` of ``width`` bits set."""
    return [sum(1 << b for b in bits) for r in range(radius + 1) for bits in combinations(range(width), r)]


def _slots(k: int, own):
    return lambda mask: F.struct(F.lit(k).alias("k"), own.bitwiseXOR(mask).alias("slot"))


def links(prints: DataFrame, distance: int = 4, segments: int = 3) -> DataFrame:
    """Edges ``u, v`` whose components are those of all pairs of different
    fingerprints within ``distance`` bits.  ``prints`` has distinct ``fp`` and
    the number of documents ``n`` that have it."""
    entries, probes = [], []
    for k, (offset, width) in enumerate(_segments(segments)):
        mask = -1 if width == 64 else (1 << width) - 1
        own = F.shiftrightunsigned("fp", offset).bitwiseAND(F.lit(mask).cast("long"))
        entries.append(F.struct(F.lit(k).alias("k"), own.alias("slot")))
        balls = F.array(*[F.lit(m).cast("long") for m in _ball(width, distance // segments)])
        probes.append(F.transform(balls, _slots(k, own)))
    table = prints.select("fp", "n", F.explode(F.array(*entries)).alias("e")).select("e.k", "e.slot", "fp", "n")
    crowded = (
        table.groupBy("k", "slot")
        .agg(F.count(F.lit(1)).alias("m"), F.max(F.struct("n", "fp")).getField("fp").alias("rep"))
        .filter(F.col("m") >= CROWDED)
        .select("k", "slot", "rep")
    )
    table = table.drop("n").withColumnRenamed("fp", "v").join(crowded, ["k", "slot"], "left")
    probe = prints.select(F.col("fp").alias("u"), F.explode(F.flatten(F.array(*probes))).alias("e")).select("e.k", "e.slot", "u")

    def apart(a: str, b: str):
        return F.bit_count(F.col(a).bitwiseXOR(F.col(b)))

    p, t = probe.alias("p"), table.alias("t")
    near = (
        (F.col("p.k") == F.col("t.k"))
        & (F.col("p.slot") == F.col("t.slot"))
        & (F.col("u") != F.col("v"))
        & (apart("u", "v") <= distance)
        & (F.col("rep").isNull() | (F.col("v") == F.col("rep")) | (apart("u", "rep") > distance) | (apart("v", "rep") > distance))
    )
    # a planner's size estimate misses the explosion, so broadcasting is ruled out
    found = p.hint("merge").join(t, near).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    return found.distinct()


def _salted(edges: DataFrame, per: DataFrame) -> DataFrame:
    """``edges`` (u, v) joined with what ``per`` has for their ``u``; the edges
    of one node, of a star's hub too, meet it in many tasks."""
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
    return edges.withColumn("_salt", F.pmod(F.xxhash64("v"), F.lit(SALTS)).cast("int")).join(per.withColumn("_salt", salts), ["u", "_salt"]).drop("_salt")


def components(edges: DataFrame, rounds: int = 100) -> DataFrame:
    """``node, root`` for every node of ``edges`` (u, v); root is the least
    node of its component.  Every round is a written table."""
    edges = materialize(edges, "edges")
    mark = None
    for _ in range(rounds):
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = _salted(both, least).filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.filter(F.col("u") != F.col("v")).distinct()
        low = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        least = low.groupBy("u").agg(F.min("v").alias("m"))
        small = _salted(low, least)
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
        edges = materialize(small.filter(F.col("u") != F.col("v")).distinct(), "edges")
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == mark:
            break
        mark = now
    else:
        raise RuntimeError("components did not converge")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))


def near_duplicates(docs: DataFrame, shingle: int = 4, distance: int = 4, segments: int | None = None) -> DataFrame:
    """``doc_id, fingerprint, component_id`` for every row of ``docs``.

    ``docs`` needs ``doc_id`` and ``text``; other columns, whatever their
    names, are not read.  A null or blank text has fingerprint zero and links
    like any other.  ``component_id`` is the least non-null doc_id of the
    component, null only if all its ids are null.  Repeated rows are returned
    as often as they come in; an empty table gives an empty result.
    """
    kind = docs.schema["doc_id"].dataType
    prints = materialize(fingerprints(docs, shingle), "prints")
    distinct = materialize(prints.groupBy("fp").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first_id")), "distinct")
    if segments is None:
        segments = 3 if distinct.count() <= WIDE_ABOVE else 2
    roots = components(links(distinct, distance, segments))
    # only fingerprints with links have another root than themselves
    rooted = materialize(distinct.join(roots, F.col("fp") == F.col("node")).select("fp", "n", "first_id", "root"), "rooted")
    firsts = distinct.select(F.col("fp").alias("root"), "first_id").join(rooted.select("root").distinct(), "root", "left_semi")
    least = rooted.select("root", "first_id").union(firsts).groupBy("root").agg(F.min("first_id").alias("component_id"))
    moved = rooted.select(F.col("root").alias("u"), F.col("fp").alias("v"))
    moved = _salted(moved, least.withColumnRenamed("root", "u")).select(F.col("v").alias("fp"), "component_id")
    moved = moved.union(least.select(F.col("root").alias("fp"), "component_id"))
    labels = distinct.join(moved, "fp", "left").select("fp", "n", F.coalesce("component_id", "first_id").alias("component_id"))
    labels = materialize(labels, "labels")
    total = prints.count()
    hot = labels.filter((F.col("n") * HOT >= total) & (F.col("n") > 1))  # at most HOT rows
    apart = prints.join(F.broadcast(hot.select("fp", "component_id")), "fp")
    rest = prints.join(F.broadcast(hot.select("fp")), "fp", "left_anti").join(labels.select("fp", "component_id"), "fp")
    return apart.unionByName(rest).select(
        "doc_id",
        F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"),
        F.col("component_id").cast(kind),
    )

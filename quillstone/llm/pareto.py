"""Mixing sources to target weights by Pareto order sampling.

Every source gets a target: its weight's share of all words, at most ``cap``
times its own size, the excess going to the others by weight.  A document
expects copies in proportion to its importance, at most ``cap``; what the cap
cuts goes to the source's other documents.  It is taken in as many whole copies
as are certain; for the part of a copy that remains, documents are ranked by
random odds divided by inclusion odds, and a source's sample is the longest
prefix of that ranking whose words fit what its target leaves.  A long document
that does not fit any more would leave a gap: documents next in the ranking
that do fit fill it, in a few passes.

All of it is DataFrame operations.  The ranking is never sorted as a whole: two
rounds of sums over 256 slots each find the slot in which a source's prefix
ends, and only that slot's rows, a 65,536th of them, and the next thousand or so
are put in order.  So a source that holds a third of all rows costs no task more
than its share.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillstone.llm.common import WORD, fresh, materialize, small

WEIGHTS = (1, 2, 3)
CAP = 3
SLOTS = 256
SALTS = 16
SEED = 7
#: Documents next in the ranking that may fill what a source's prefix leaves, and
#: in how many passes.
FILL = 1000
PASSES = 8
#: An importance column is rounded to so many levels in each power of two.
LEVELS = 16


def word_count(text: Column) -> Column:
    """Words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def uniform(key: Column, seed: int = SEED) -> Column:
    """A number between 0 and 1 that depends on the key and the seed alone."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("null")))
    drawn = F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("double")
    return (drawn + 0.5) / float(1 << 52)


def targets(sizes: DataFrame, weights: tuple = WEIGHTS, cap: float = CAP) -> DataFrame:
    """``source, source_size, target`` of every source of ``source, size`` rows.

    Weights are dealt by code point of the source, null last, and repeat.
    Sources in the order of size over weight are the ones that stop at the cap
    first, so running sums give the level at which the others meet.
    """
    each = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1  # one row a source
    weight = F.get(F.array(*[F.lit(float(w)) for w in weights]), F.pmod(place, F.lit(len(weights))))
    each = each.select("source", "source_size", place.alias("place"), weight.alias("weight"))
    each = each.withColumn("most", F.col("source_size") * float(cap))
    before = Window.orderBy(F.col("most") / F.col("weight"), "place").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    left = F.sum("source_size").over(whole).cast("double") - F.coalesce(F.sum("most").over(before), F.lit(0.0))
    open_ = F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    each = each.withColumn("level", left / open_)
    free = F.when(F.col("most") >= F.col("level") * F.col("weight"), F.struct(F.col("most") / F.col("weight"), F.col("place"), F.col("level")))
    each = each.withColumn("level", F.min(free).over(whole).getField("level"))
    target = F.when(F.col("level").isNull(), F.col("most")).otherwise(F.least(F.col("most"), F.col("level") * F.col("weight")))
    return each.select("source", "source_size", target.alias("target"))


def _joined(rows: DataFrame, per: DataFrame) -> DataFrame:
    """``rows`` with what ``per`` has for their ``key``.  Each key's row is
    repeated for every salt, so a hot source's rows meet in many tasks."""
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int"))
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
    return salted.join(per.withColumn("_salt", salts), ["key", "_salt"]).drop("_salt")


def digits(size: Column) -> Column:
    """Importance of a document by its size: its binary digits, so that long
    documents are likelier, but far from in proportion."""
    return F.length(F.bin(size)).cast("double")


def rates(rows: DataFrame, goal: DataFrame, cap: float) -> DataFrame:
    """``key, source_size, target, rate`` of each source: a document expects
    rate times importance copies, at most ``cap``; the rate is null where all
    documents are at the cap.

    Levels of importance are few, and in falling order the first that stays
    below the cap gives the rate, as all before it are at the cap.
    """
    sums = rows.groupBy("source", "importance").agg(F.sum("size").alias("words"))
    each = goal.join(sums.withColumnRenamed("source", "_s"), goal["source"].eqNullSafe(F.col("_s")))
    each = each.select(key_of(F.col("source")).alias("key"), "source_size", "target", "importance", "words")
    order = Window.partitionBy("key").orderBy(F.col("importance").desc())
    before = F.coalesce(F.sum("words").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    open_ = F.sum(F.col("words") * F.col("importance")).over(order.rowsBetween(0, Window.unboundedFollowing))
    each = each.withColumn("rate", F.try_divide(F.col("target") - float(cap) * before, open_))
    fits = F.when(F.col("importance") * F.col("rate") <= float(cap), F.struct((-F.col("importance")).alias("i"), F.col("rate").alias("rate")))
    return each.groupBy("key").agg(F.first("source_size").alias("source_size"), F.first("target").alias("target"), F.min(fits).getField("rate").alias("rate"))


def _ranked(rows: DataFrame, per: DataFrame, cap: float, seed: int) -> DataFrame:
    """``rows`` with the certain copies, the odds and the slot of the odds; the
    odds are null where no part of a copy remains."""
    drawn = uniform(F.col("doc_id"), seed)
    each = _joined(rows.withColumn("key", key_of(F.col("source"))), per)
    most = F.when(F.col("importance") > 0, F.lit(float(cap))).otherwise(0.0)
    each = each.withColumn("expected", F.when(F.col("rate").isNull(), most).otherwise(F.least(F.lit(float(cap)), F.col("rate") * F.col("importance"))))
    each = each.withColumn("sure", F.floor("expected"))
    chance = F.col("expected") - F.col("sure")
    each = each.withColumn("odds", F.when(chance > 0, (drawn / (1 - drawn)) / (chance / (1 - chance))))
    slot = F.floor(F.col("odds") / (1 + F.col("odds")) * float(SLOTS * SLOTS)).cast("long")
    return each.withColumn("slot", F.least(slot, F.lit(SLOTS * SLOTS - 1)))


def _ending(sums: DataFrame, state: DataFrame, last: int) -> DataFrame:
    """``key, part, until, before, rest``: the first part (part, size, n) at
    which a key's running sum reaches its rest, and the part by which ``FILL``
    rows come after it."""
    running = Window.partitionBy("key").orderBy("part").rowsBetween(Window.unboundedPreceding, 0)
    rows = sums.withColumns({"sum": F.sum("size").over(running), "held": F.sum("n").over(running)}).join(state, "key")
    rows = rows.filter(F.col("before") + F.col("sum") >= F.col("rest"))
    rows = rows.withColumn("least", F.min("held").over(Window.partitionBy("key")))
    until = F.min(F.when(F.col("held") - F.col("least") >= FILL, F.col("part")))
    end = F.min(F.struct("part", (F.col("before") + F.col("sum") - F.col("size")).alias("before"), "rest")).alias("m")
    return rows.groupBy("key").agg(end, F.coalesce(until, F.lit(last)).alias("until")).select("key", "m.part", "until", "m.before", "m.rest")


def _fill(tail: DataFrame) -> DataFrame:
    """The rows of ``tail`` (key, odds, doc_id, size, n, before, rest) with
    ``prefix``, if they are in the prefix, and ``filled``, if they fill what it
    leaves: pass by pass the prefix of those that fit what is still left."""
    order = Window.partitionBy("key").orderBy("odds", "doc_id", "size")
    until, whole = order.rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy("key")
    words = F.col("size") * F.col("n")
    rows = tail.withColumn("words", words).withColumn("sum", F.col("before") + F.sum("words").over(until))
    rows = rows.withColumn("prefix", F.col("sum") <= F.col("rest"))
    rows = rows.withColumn("left", F.col("rest") - F.coalesce(F.max(F.when(F.col("prefix"), F.col("sum"))).over(whole), F.col("before")))
    rows = rows.withColumn("after", F.sum((~F.col("prefix")).cast("int")).over(until))
    rows = rows.filter(F.col("after") <= FILL).withColumn("filled", F.lit(False))
    for _ in range(PASSES):
        fits = ~F.col("prefix") & ~F.col("filled") & (F.col("words") <= F.col("left"))
        rows = rows.withColumn("now", F.when(fits, F.col("words")).otherwise(0))
        rows = rows.withColumn("now", F.when(fits & (F.sum("now").over(until) <= F.col("left")), F.col("words")).otherwise(0))
        rows = rows.withColumn("filled", F.col("filled") | ((F.col("now") > 0) & fits)).withColumn("left", F.col("left") - F.sum("now").over(whole))
    return rows


def _mark() -> Column:
    return F.xxhash64("key", "odds", "doc_id", "size")


def plan(rows: DataFrame, weights: tuple = WEIGHTS, cap: float = CAP, seed: int = SEED) -> tuple[DataFrame, DataFrame]:
    """One row a source: its target, its rate and where its prefix ends; and
    the marks of the rows that fill.

    ``rows`` has ``doc_id, source, size, importance`` and is read a few times:
    give a written table.
    """
    per = materialize(rates(rows, targets(rows, weights, cap), cap), "rates")
    each = materialize(_ranked(rows, per, cap, seed).select("doc_id", "key", "size", "target", "sure", "odds", "slot"), "ranked")
    sure = each.groupBy("key").agg((F.max("target") - F.sum(F.col("sure") * F.col("size"))).alias("rest"))
    open_rows = each.filter(F.col("slot").isNotNull()).select("doc_id", "key", "size", "odds", "slot")

    def sums(found: DataFrame, part: Column) -> DataFrame:
        return found.groupBy("key", part.alias("part")).agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("n"))

    coarse = F.floor(F.col("slot") / SLOTS)
    first = materialize(_ending(sums(open_rows, coarse), sure.withColumn("before", F.lit(0).cast("long")), SLOTS - 1), "coarse")
    within = _joined(open_rows, first.select("key", F.col("part").alias("_a"), F.col("until").alias("_b"))).filter(coarse.between(F.col("_a"), F.col("_b")))
    last = _ending(sums(within, F.col("slot")), first.select("key", "before", "rest"), SLOTS * SLOTS - 1)
    last = materialize(last, "ends")
    tail = _joined(open_rows, last).filter(F.col("slot").between(F.col("part"), F.col("until")))
    tail = tail.groupBy("key", "odds", "doc_id", "size").agg(F.count(F.lit(1)).alias("n"), F.first("before").alias("before"), F.first("rest").alias("rest"))
    tail = materialize(_fill(tail).select("key", "odds", "doc_id", "size", "prefix", "filled"), "tail")
    limit = tail.filter("prefix").groupBy("key").agg(F.max(F.struct("odds", "doc_id", "size")).alias("limit"))
    whole = per.join(last.select("key", F.col("part").alias("end_slot")), "key", "left").join(limit, "key", "left")
    marks = tail.filter("filled").select(_mark().alias("_mark"), F.lit(True).alias("_fills")).distinct()
    return materialize(whole, "plan"), materialize(marks, "marks")


def with_copies(rows: DataFrame, planned: tuple[DataFrame, DataFrame], cap: float = CAP, seed: int = SEED) -> DataFrame:
    """``rows``, with ``size`` and ``importance``, and their ``copies``.

    Without an end slot a source's whole ranking is taken; without a limit
    nothing of its end slot is.
    """
    per, marks = planned
    each = _ranked(rows, per, cap, seed)
    within = F.coalesce(F.struct("odds", "doc_id", "size") <= F.col("limit"), F.lit(False))
    chosen = F.col("end_slot").isNull() | (F.col("slot") < F.col("end_slot")) | ((F.col("slot") == F.col("end_slot")) & within)
    each = each.withColumn("_mark", F.when(F.col("slot").isNotNull() & ~chosen, _mark())).withColumn("_chosen", chosen)
    each = each.join(small(marks), "_mark", "left")
    taken = F.col("slot").isNotNull() & (F.col("_chosen") | F.coalesce("_fills", F.lit(False)))
    return each.withColumn("copies", F.col("sure") + taken.cast("long"))


def key_of(source: Column) -> Column:
    """A text that stands for a source, null included."""
    return F.coalesce(F.concat(F.lit("s"), source), F.lit("n"))


Importance = str | Callable[[Column], Column] | None


def sized(docs: DataFrame, importance: Importance = None, *more: Column) -> DataFrame:
    size = word_count(F.col("text"))
    if importance is None:
        weight = F.lit(1.0)
    elif callable(importance):
        weight = importance(size)
    else:
        given = F.col(f"`{importance}`").cast("double")
        level = F.round(F.log2(F.when(given > 0, given)) * LEVELS) / LEVELS
        weight = F.coalesce(F.pow(F.lit(2.0), F.least(F.greatest(level, F.lit(-64.0)), F.lit(64.0))), F.lit(0.0))
    return docs.select("doc_id", "source", size.alias("size"), weight.alias("importance"), *more)


def mix(docs: DataFrame, weights: tuple = WEIGHTS, cap: float = CAP, seed: int = SEED, importance: Importance = digits) -> DataFrame:
    """``doc_id, size, source_size, target, taken`` of every document.

    ``docs`` needs ``doc_id``, ``source`` and ``text``; other columns are not
    read but for one that ``importance`` names (null, zero or negative: never
    taken); it can also be a function of the size, or None for equal odds.  A
    source whose documents of positive importance hold less than its target
    over the cap falls short.  A null text has size 0; null sources are one
    source.  Reruns agree: the random numbers come from doc_ids, so repeated
    rows are taken alike.  A source without words has target 0.  An empty
    table gives an empty result.
    """
    rows = materialize(sized(docs, importance), "sizes")
    out = with_copies(rows, plan(rows, weights, cap, seed), cap, seed)
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "source", "copies")


def take(docs: DataFrame, weights: tuple = WEIGHTS, cap: float = CAP, seed: int = SEED, importance: Importance = digits) -> DataFrame:
    """The mix itself: rows of ``docs``, all columns, as often as they are taken.

    Texts are not shuffled: each row decides from its source's row of the plan.
    """
    planned = plan(materialize(sized(docs, importance), "sizes"), weights, cap, seed)
    row = fresh("_row", docs.columns)
    kept = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias(row)
    found = with_copies(sized(docs, importance, kept), planned, cap, seed)
    found = found.filter(F.col("copies") > 0).withColumn("_each", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return found.select(*[F.col(row)[c].alias(c) for c in docs.columns])


def oracle(weights: tuple = WEIGHTS, cap: float = CAP, seed: int = SEED) -> str:
    """``mix`` with importance by digits in DuckDB SQL."""
    listed = ", ".join(str(float(w)) for w in weights)
    order = "(PARTITION BY source ORDER BY odds, doc_id NULLS FIRST, size ROWS UNBOUNDED PRECEDING)"
    passes, before = [], "p0"
    for i in range(1, PASSES + 1):
        fits = "NOT prefix AND NOT filled AND words <= remains"
        passes += [
            f"n{i} AS (SELECT *, CAST(sum(CASE WHEN {fits} THEN words ELSE 0 END) OVER {order} AS DOUBLE) AS run FROM {before})",
            f"m{i} AS (SELECT * EXCLUDE (run), ({fits} AND run <= remains AND words > 0) AS now FROM n{i})",
            f"p{i} AS (SELECT * EXCLUDE (now, filled, remains), (filled OR now) AS filled, remains - CAST(sum(CASE WHEN now THEN words ELSE 0 END) OVER (PARTITION BY source) AS DOUBLE) AS remains FROM m{i})",
        ]
        before = f"p{i}"
    return f"""
WITH d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '{WORD}')), 0) AS BIGINT) AS size,
         (CAST(CAST('0x' || substr(md5('{seed}:' || coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 13) AS BIGINT) AS DOUBLE) + 0.5) / 4503599627370496.0::DOUBLE AS u
  FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS place FROM d GROUP BY source),
w AS (SELECT *, CAST(([{listed}])[1 + place % {len(weights)}] AS DOUBLE) AS weight, CAST(source_size AS DOUBLE) * {float(cap)}::DOUBLE AS most FROM s),
o AS (SELECT *, (CAST(sum(source_size) OVER () AS DOUBLE) - coalesce(sum(most) OVER b, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER b, 0)) AS level
  FROM w WINDOW b AS (ORDER BY most / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (SELECT level FROM o WHERE most >= level * weight ORDER BY most / weight, place LIMIT 1),
t AS (SELECT source, source_size, CASE WHEN (SELECT level FROM l) IS NULL THEN most ELSE least(most, (SELECT level FROM l) * weight) END AS target FROM w),
i AS (SELECT d.*, source_size, target, CAST(greatest(1, length(ltrim(bin(size), '0'))) AS DOUBLE) AS importance FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
g AS (SELECT source, importance, any_value(target) AS target, CAST(sum(size) AS DOUBLE) AS words FROM i GROUP BY source, importance),
h AS (SELECT *, (target - {float(cap)}::DOUBLE * coalesce(sum(words) OVER (PARTITION BY source ORDER BY importance DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / nullif(sum(words * importance) OVER (PARTITION BY source ORDER BY importance DESC ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 0) AS rate FROM g),
j AS (SELECT source, arg_max(rate, importance) FILTER (WHERE importance * rate <= {float(cap)}) AS rate FROM h GROUP BY source),
e AS (SELECT i.*, CASE WHEN rate IS NULL THEN {float(cap)}::DOUBLE ELSE least({float(cap)}::DOUBLE, rate * importance) END AS expected
  FROM i JOIN j ON i.source IS NOT DISTINCT FROM j.source),
f AS (SELECT *, CAST(floor(expected) AS BIGINT) AS sure, expected - floor(expected) AS chance FROM e),
q AS (SELECT *, CASE WHEN chance > 0 THEN (u / (1 - u)) / (chance / (1 - chance)) END AS odds, target - CAST(sum(sure * size) OVER (PARTITION BY source) AS DOUBLE) AS rest FROM f),
k AS (SELECT source, odds, doc_id, size, CAST(size * count(*) AS DOUBLE) AS words, any_value(rest) AS rest FROM q WHERE odds IS NOT NULL GROUP BY source, odds, doc_id, size),
r AS (SELECT *, sum(words) OVER {order} AS run FROM k),
a AS (SELECT *, run <= rest AS prefix, sum(CASE WHEN run > rest THEN 1 ELSE 0 END) OVER {order} AS after,
  rest - coalesce(max(CASE WHEN run <= rest THEN run END) OVER (PARTITION BY source), 0) AS remains FROM r),
p0 AS (SELECT * EXCLUDE (run, after), FALSE AS filled FROM a WHERE after <= {FILL}),
{", ".join(passes)},
c AS (SELECT q.*, sure + CASE WHEN coalesce({before}.prefix OR {before}.filled, FALSE) THEN 1 ELSE 0 END AS copies
  FROM q LEFT JOIN {before} ON q.source IS NOT DISTINCT FROM {before}.source AND q.odds = {before}.odds AND q.doc_id IS NOT DISTINCT FROM {before}.doc_id AND q.size = {before}.size)
SELECT doc_id, size, source_size, target, CAST(size * copies AS BIGINT) AS taken, source, CAST(copies AS BIGINT) AS copies FROM c"""

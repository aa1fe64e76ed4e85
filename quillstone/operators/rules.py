"""Rule tables and suggestions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def merge(base: DataFrame, more: DataFrame) -> DataFrame:
    """``base`` rules and the further ones of ``more``, whose replacements win.
    Columns ``ord, pattern, new``; a key keeps the place where it first came."""
    rows = base.select(F.lit(0).alias("src"), "ord", "pattern", "new").unionByName(more.select(F.lit(1).alias("src"), "ord", "pattern", "new"))
    place = F.min(F.struct("src", "ord"))
    last = F.max(F.struct("src", "ord", "new"))
    found = rows.groupBy("pattern").agg(place.alias("p"), last.alias("l"))
    return found.select("pattern", F.col("l.new").alias("new"), F.col("p.src").alias("src"), F.col("p.ord").alias("ord"))


def merge_missing(base: DataFrame, more: DataFrame) -> DataFrame:
    """``base`` and the rules of ``more`` whose pattern it lacks."""
    return base.unionByName(more.join(base, "pattern", "left_anti").select(base.columns))


def read(spark, path: str) -> list[tuple[str, str, str]]:
    """Rules ``kind, ord, pattern, new`` of a CSV or Parquet table, in order,
    for ``functions.udf.correct``.  A rule table is what a user maintains by
    hand; it is read to the driver because its order is the program."""
    table = spark.read.parquet(path) if path.endswith(".parquet") else spark.read.csv(path, header=True)
    return [(r["kind"], r["pattern"], r["new"]) for r in table.orderBy(F.col("ord").cast("long")).collect()]


def jaccard(a: Column, b: Column) -> Column:
    """Shared characters over all characters of two words."""
    x = F.array_distinct(F.filter(F.split(a, ""), lambda c: c != ""))
    y = F.array_distinct(F.filter(F.split(b, ""), lambda c: c != ""))
    union = F.size(F.array_union(x, y))
    return F.when(union == 0, 0.0).otherwise(F.size(F.array_intersect(x, y)) / union)


def suggest(words: DataFrame, known: list[str], least: float = 0.7, k: int = 5, exact: dict[str, str] | None = None) -> DataFrame:
    """Up to ``k`` known words for each word by shared characters, likest
    first, then by code point; before them what ``exact`` has for the word,
    with a likeness of 2.  The known words travel as one literal."""
    words = words.select("word").distinct()
    rows = words.select("word", F.explode(F.array(*[F.lit(w) for w in known])).alias("known"))
    rows = rows.withColumn("s", jaccard(F.col("word"), F.col("known"))).filter(F.col("s") > least)
    if exact:
        table = F.create_map(*[F.lit(x) for pair in exact.items() for x in pair])
        hits = words.select("word", F.try_element_at(table, F.lower("word")).alias("known"), F.lit(2.0).alias("s"))
        hits = hits.filter(F.col("known").isNotNull())
        rows = rows.join(hits.select("word", "known"), ["word", "known"], "left_anti").unionByName(hits)
    w = Window.partitionBy("word").orderBy(F.desc("s"), "known")
    return rows.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def fuzzy(words: DataFrame, known: list[str], least: float = 0.8, k: int = 3) -> DataFrame:
    """Up to ``k`` known words for each word by edit distance."""
    words = words.select("word").distinct()
    rows = words.select("word", F.explode(F.array(*[F.lit(w) for w in known])).alias("known"))
    s = 1 - F.levenshtein("word", "known") / F.greatest(F.length("word"), F.length("known"))
    rows = rows.withColumn("s", s).filter(F.col("s") >= least)
    w = Window.partitionBy("word").orderBy(F.desc("s"), "known")
    return rows.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)

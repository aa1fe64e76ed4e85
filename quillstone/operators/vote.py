"""Choosing among the candidates that several engines propose for one image.

A candidate table has ``image_id, ord, engine, text, confidence``; ``ord`` is
the order in which engines ran and settles all ties, so no result depends on
partitioning.
"""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillstone.functions import score, udf
from quillstone.functions import text as T
from quillstone.functions import values as V


def first_by(df: DataFrame, key: str, *order: Column) -> DataFrame:
    """The first row of each key.  The planner keeps one row a key and task
    before the shuffle."""
    ranked = df.withColumn("_rank", F.row_number().over(Window.partitionBy(key).orderBy(*order)))
    return ranked.filter(F.col("_rank") == 1).drop("_rank")


def only(cands: DataFrame, engines: list[str]) -> DataFrame:
    """The candidates of some engines."""
    return cands.filter(F.col("engine").isin(engines))


def best(cands: DataFrame) -> DataFrame:
    """The most confident candidate; consensus is 1."""
    return first_by(cands, "image_id", F.desc("confidence"), F.col("ord")).withColumn("consensus", F.lit(1.0))


def weighted(cands: DataFrame) -> DataFrame:
    """The most confident candidate that is no artifact, else the longest; the
    confidence is the mean of all."""
    text = T.strip("text")
    bad = (F.length(text) == 0) | T.is_artifact("text")
    rows = cands.withColumn("_bad", bad).withColumn("_len", F.length(text))
    rows = rows.withColumn("mean_conf", F.avg("confidence").over(Window.partitionBy("image_id")))
    order = [F.col("_bad"), F.when(~F.col("_bad"), F.col("confidence")).desc_nulls_last(), F.desc("_len"), F.col("ord")]
    return first_by(rows, "image_id", *order).select("image_id", "engine", "text", "mean_conf")


def _voters(cands: DataFrame) -> DataFrame:
    return cands.withColumn("t", T.strip("text")).filter(~T.is_artifact("text"))


def majority_exact(cands: DataFrame) -> DataFrame:
    """The text that at least two candidates share, first seen on ties."""
    votes = _voters(cands).groupBy("image_id", "t").agg(F.count(F.lit(1)).alias("votes"), F.min("ord").alias("first_ord"))
    return first_by(votes.filter(F.col("votes") >= 2), "image_id", F.desc("votes"), F.col("first_ord")).select("image_id", F.col("t").alias("text"), "votes")


def majority(cands: DataFrame, alike: float = 0.75) -> DataFrame:
    """Shared text, else the surest of the largest group of similar texts, else
    the longest.  An image's few candidates are grouped in its own row."""
    @F.pandas_udf("string")
    def pick(texts: pd.Series, confs: pd.Series) -> pd.Series:
        def one(texts, confs):
            texts, confs = list(texts), list(confs)
            valid = [(t.strip(), c, t) for t, c in zip(texts, confs) if t.strip() not in V.ARTIFACTS]
            if not valid:
                return max(texts, key=lambda t: len(t.strip())).strip()
            stripped = [v[0] for v in valid]
            top = max(dict.fromkeys(stripped), key=stripped.count)
            if stripped.count(top) >= 2:
                return top
            groups: list[list] = []
            for v in valid:
                for g in groups:
                    if difflib.SequenceMatcher(None, v[0], g[0][0]).ratio() >= alike:
                        g.append(v)
                        break
                else:
                    groups.append([v])
            largest = max(groups, key=len)
            if len(largest) >= 2:
                return max(largest, key=lambda v: v[1])[0]
            return max(valid, key=lambda v: (len(v[0]), v[1]))[2]

        return pd.Series([one(t, c) for t, c in zip(texts, confs)])

    return gathered(cands).select("image_id", pick("texts", "confs").alias("text"))


def gathered(cands: DataFrame) -> DataFrame:
    """One row an image: its candidates' texts and confidences in order."""
    one = F.array_sort(F.collect_list(F.struct("ord", "text", "confidence")))
    rows = cands.groupBy("image_id").agg(one.alias("c"))
    return rows.select("image_id", F.col("c.text").alias("texts"), F.col("c.confidence").alias("confs"))


def consensus(cands: DataFrame) -> DataFrame:
    """Mean similarity of all pairs of an image's candidates; 1 for a single one."""
    a = cands.select("image_id", F.col("ord").alias("i"), F.col("text").alias("a"))
    b = cands.select("image_id", F.col("ord").alias("j"), F.col("text").alias("b"))
    pairs = a.join(b, "image_id").filter(F.col("i") < F.col("j")).withColumn("s", udf.similarity("a", "b"))
    mean = pairs.groupBy("image_id").agg(F.avg("s").alias("s"))
    ids = cands.select("image_id").distinct()
    return ids.join(mean, "image_id", "left").select("image_id", F.coalesce("s", F.lit(1.0)).alias("consensus"))


def low_consensus(cands: DataFrame, least: float = 0.2) -> DataFrame:
    return consensus(cands).withColumn("low", F.col("consensus") < least)


def select_best(cands: DataFrame) -> DataFrame:
    """The most confident, of equal ones the longest."""
    return first_by(cands, "image_id", F.desc("confidence"), F.desc(F.length("text")), F.col("ord"))


def drop_hallucinations(cands: DataFrame) -> DataFrame:
    """Without short unsure and repetitive candidates; where none is left the
    longest stays."""
    t = T.strip("text")
    bad = ((F.length(t) < 3) & (F.col("confidence") < 0.95)) | T.hallucinates(t)
    rows = cands.withColumn("_bad", bad)
    w = Window.partitionBy("image_id")
    rows = rows.withColumn("_none", F.min(F.col("_bad").cast("int")).over(w) == 1)
    rows = rows.withColumn("_long", F.row_number().over(w.orderBy(F.desc(F.length(t)), "ord")))
    return rows.filter(~F.col("_bad") | (F.col("_none") & (F.col("_long") == 1))).drop("_bad", "_none", "_long")


def engine_wins(lines: DataFrame) -> DataFrame:
    """How many lines each engine wins by line score."""
    won = first_by(lines.withColumn("s", score.line_score("text", "confidence")), "image_id", F.desc("s"), F.col("ord"))
    return won.groupBy("engine").agg(F.count(F.lit(1)).alias("wins"))


def variant_best(cands: DataFrame) -> DataFrame:
    """The best variant by score among valid ones, else the longest."""
    rows = cands.withColumn("_ok", T.is_valid_variant("text")).withColumn("s", score.variant_score("text", "confidence"))
    order = [F.desc("_ok"), F.when(F.col("_ok"), F.col("s")).desc_nulls_last(), F.desc(F.length("text")), F.col("ord")]
    return first_by(rows, "image_id", *order).select("image_id", "engine", "text", "confidence")


def cascade_choose(cands: DataFrame, stages: list[tuple[str, Column]]) -> DataFrame:
    """The candidate of the first stage (engine and condition) that holds."""
    at = F.lit(None).cast("int")
    for k, (engine, holds) in reversed(list(enumerate(stages))):
        at = F.when((F.col("engine") == engine) & holds, k).otherwise(at)
    rows = cands.withColumn("stage", at).filter(F.col("stage").isNotNull())
    return first_by(rows, "image_id", F.col("stage"), F.col("ord"))


def fallback_first(cands: DataFrame) -> DataFrame:
    """The first candidate with any text; images without one have null text."""
    ids = cands.select("image_id").distinct()
    found = first_by(cands.filter(T.strip("text") != ""), "image_id", F.col("ord")).select("image_id", "engine", "text")
    return ids.join(found, "image_id", "left")


def fuse(cands: DataFrame, by_char: bool = False) -> DataFrame:
    """The text that position-wise votes make of an image's candidates."""
    run = udf.fuse_chars if by_char else udf.fuse_words
    return gathered(cands).select("image_id", run("texts", "confs").alias("text"))

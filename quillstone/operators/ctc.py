"""Decoding of per-step class scores (connectionist temporal classification)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstone.functions import text as T
from quillstone.functions import values as V


def softmax(m: Column | str) -> Column:
    """Each step's scores as probabilities."""

    def step(row: Column) -> Column:
        e = F.transform(row, lambda x: F.exp(x.cast("double") - F.array_max(row).cast("double")))
        return F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0).cast("double"), lambda a, y: a + y))

    return F.transform(T.col(m), step)


def best_path(m: Column | str, floor: float | None = None) -> Column:
    """The class of each step: the first with the greatest score, scores under
    ``floor`` counting as it."""

    def step(row: Column) -> Column:
        row = row if floor is None else F.transform(row, lambda x: F.greatest(x.cast("double"), F.lit(floor)))
        return (F.array_position(row, F.array_max(row)) - 1).cast("int")

    return F.transform(T.col(m), step)


def collapse(path: Column) -> Column:
    """Without repeats and then without blanks (class 0).  The path is bound, as
    each use of it would compute it anew."""

    def once(own: Column) -> Column:
        kept = F.zip_with(own, F.concat(F.array(F.lit(-1)), own), lambda x, before: F.when((x != 0) & (x != before), x))
        return F.filter(kept, lambda x: x.isNotNull())

    return T.let(path, once)


def greedy(m: Column | str) -> Column:
    return collapse(best_path(m))


def beam(m: Column | str) -> Column:
    """What a beam over probabilities finds: the scores of steps only add up,
    so it is the best path with probabilities floored at 1e-12."""
    return collapse(best_path(m, 1e-12))


def decoded(classes: Column, alphabet: str = V.ALPHABET) -> Column:
    return F.array_join(F.transform(classes, lambda i: F.substring(F.lit(alphabet), i, F.lit(1))), "")


def lm(df: DataFrame, m: Column | str, out: str = "text") -> DataFrame:
    """``df`` with ``out``: the beam's text after language-model correction.

    The beam's text is generated as a column of its own.  Else it would be put
    into the call of the Arrow function, which Spark then may not find again:
    it looks for a normal form that orders operands by their hashes, and these
    differ from copy to copy of a lambda's variable.
    """
    own = "_beam"
    while own in df.columns:
        own += "_"
    rows = df.select("*", F.explode(F.array(decoded(beam(m)))).alias(own))
    return rows.withColumn(out, T.lm_correct(own)).drop(own)

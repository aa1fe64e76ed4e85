"""Helpers that the training-data operators share."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Used only where the session names no shared folder (tests, local runs).
LOCAL_CHECKPOINTS = "file:///tmp/checkpoints/quillstone"

#: The byte class of white space that the word definitions share: space and
#: the controls 9 to 13.
WORD = r"[^\x20\x09-\x0D]+"


#: Bytes of text that a worker handles at a time; a longer text goes alone.
AT_ONCE = 5 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = LOCAL_CHECKPOINTS
    return found.rstrip("/")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it again.

    This cuts the lineage: a lost executor costs the reread of a file and no
    recomputation, and several readers share one computation.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def ranges(df: DataFrame, each: int = 48 << 20) -> int:
    """How many ranges to cut ``df`` into: the session's shuffle partitions, or
    more where the planner's size estimate would give each over ``each`` bytes."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    estimate = size if size < 1 << 60 else 0  # a plan of unknown size says so by a huge number
    return max(partitions(df.sparkSession), -(-estimate // each))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def fresh(name: str, taken: list[str]) -> str:
    """``name``, made longer until no column is called so."""
    lower = {c.lower() for c in taken}
    while name.lower() in lower:
        name += "_"
    return name


def small(rows: DataFrame, most: int = 1_000_000) -> DataFrame:
    """``rows``, a written table, marked for broadcasting if they are counted
    to be at most ``most``, and else for a merge of both sides."""
    return F.broadcast(rows) if rows.count() <= most else rows.hint("merge")


#: A key with this part of all rows is joined apart.
HOT = 1000


def joined(rows: DataFrame, per: DataFrame, keys: list[str], heavy: Column, how: str = "inner") -> DataFrame:
    """``rows`` with what ``per`` has for their ``keys``, which are not null.

    ``heavy`` marks those rows of ``per``, at most about ``HOT``, whose keys
    hold many of ``rows``: they are broadcast, all others are merged, so no
    task gets the rows of a hot key.  ``per`` has a row a key at most and is a
    written table; ``how`` is ``inner`` or ``left``.
    """
    hot = per.filter(heavy)
    apart = rows.join(F.broadcast(hot), keys)
    rest = rows.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(per.hint("merge"), keys, how)
    return apart.unionByName(rest)


def slices(batch: pa.RecordBatch, text: int, most: int = AT_ONCE) -> Iterator[pa.RecordBatch]:
    """Runs of rows with at most about ``most`` bytes of text."""
    sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < batch.num_rows:
        before = sizes[at - 1] if at else 0
        end = max(at + 1, int(np.searchsorted(sizes, before + most, "right")))
        yield batch.slice(at, end - at)
        at = end

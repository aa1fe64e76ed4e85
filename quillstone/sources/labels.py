"""Labelled samples: TSV lines, synthetic lines and ordered splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillstone.functions import values as V


def label_lines(lines: DataFrame, value: str = "value") -> DataFrame:
    """``filename, text`` of tab-separated lines; lines without a tab are left out."""
    parts = F.split(F.col(value), "\t", 2)
    return lines.filter(F.contains(F.col(value), F.lit("\t"))).withColumns({"filename": parts[0], "text": parts[1]}).drop(value)


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    return label_lines(spark.read.text(path))


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """``path, modificationTime, length, content`` of image or PDF files."""
    return spark.read.format("binaryFile").load(path)


def split_90_10(rows: DataFrame, order: str, key: str | None = None) -> DataFrame:
    """``part`` of each row: the first nine tenths, at least one row, are
    ``train``, the others ``val``.  Without a key the rows are cut into ranges
    of ``order``, so that no task sorts them all; rows of equal ``order`` go
    by their range's order."""
    if key:
        ranked = rows.withColumn("_place", F.row_number().over(Window.partitionBy(key).orderBy(order)))
        ranked = ranked.join(rows.groupBy(key).agg(F.count(F.lit(1)).alias("_n")), key)
    else:
        n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        tasks = rows.select(order).repartitionByRange(n, order).groupBy(F.spark_partition_id().alias("_p"))
        least = [r[0] for r in tasks.agg(F.min(order).alias("m")).filter("m IS NOT NULL").orderBy("m").collect()]  # a value a range
        cut = sum((F.coalesce((F.col(order) >= F.lit(x)).cast("int"), F.lit(0)) for x in least), F.lit(0))
        ranged = rows.withColumn("_range", cut)
        sizes = ranged.groupBy("_range").agg(F.count(F.lit(1)).alias("_held"))
        whole = Window.partitionBy().orderBy("_range")  # a row a range
        sizes = sizes.select("_range", (F.sum("_held").over(whole) - F.col("_held")).alias("_before"), F.sum("_held").over(Window.partitionBy()).alias("_n"))
        ranged = ranged.withColumn("_own", F.row_number().over(Window.partitionBy("_range").orderBy(order)))
        ranked = ranged.join(F.broadcast(sizes), "_range").withColumn("_place", F.col("_before") + F.col("_own")).drop("_range", "_own", "_before")
    last = F.greatest(F.lit(1), F.floor(F.col("_n") * 0.9))
    return ranked.withColumn("part", F.when(F.col("_place") <= last, "train").otherwise("val")).drop("_n", "_place")


def synthetic_text(spark: SparkSession, n: int = 2000, least: int = 3, most: int = 12, seed: int = 1) -> DataFrame:
    """``n`` random strings over the alphabet; the same for the same seed."""
    size = F.floor(F.rand(seed) * (most - least + 1) + least).cast("int")
    chars = F.transform(F.sequence(F.lit(1), F.col("n_chars")), lambda i: F.substring(F.lit(V.ALPHABET), (F.pmod(F.xxhash64(F.col("id"), i, F.lit(seed)), F.lit(len(V.ALPHABET))) + 1).cast("int"), F.lit(1)))
    return spark.range(n).withColumn("n_chars", size).select("id", F.array_join(chars, "").alias("text"))


def class_numbers(text: Column) -> Column:
    from quillstone.functions.text import vocab_encode

    return vocab_encode(text)

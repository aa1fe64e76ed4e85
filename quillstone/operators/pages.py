"""Pages: strategies, summaries and texts put together."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstone.functions import score
from quillstone.functions import text as T


def strategy(text_len: Column | str, image_len: Column | str, callback: bool = True) -> Column:
    """How a page is read, from the lengths of its text and of its images' text."""
    n, m = T.col(text_len), T.col(image_len)
    return (
        F.when(n >= 120, F.when(m >= 20, "mixed").otherwise("direct_text"))
        .when(n >= 40, "ocr_fallback" if callback else "direct_text")
        .when(m >= 80, "mixed")
        .otherwise("scanned_ocr" if callback else "direct_text")
    )


def must_recognize(c: Column | str, callback: bool = True) -> Column:
    """If a page's text is too poor to be used."""
    text = T.normalize(c)
    return F.coalesce(F.lit(callback) & (F.length(text) >= 80) & (score.text_quality(text) < 0.45), F.lit(False))


def page_range(pages: DataFrame, start: int = 0, end: int | None = None) -> DataFrame:
    """Pages ``start`` (from 0) up to but not including ``end``."""
    rows = pages.filter(F.col("page_num") > start)
    return rows if end is None else rows.filter(F.col("page_num") <= end)


def ordered_text(parts: DataFrame, key: str, order: list[str], value: str, between: str = "\n\n") -> DataFrame:
    """The non-blank values of each key in order, stripped and joined."""
    rows = parts.filter(T.strip(value) != "")
    one = F.array_sort(F.collect_list(F.struct(*order, T.strip(value).alias("v"))))
    return rows.groupBy(key).agg(one.alias("p")).select(key, F.array_join(F.col("p.v"), between).alias("text"))


def pages_to_text(blocks: DataFrame, tables: DataFrame) -> DataFrame:
    """``doc_id, text``: blocks and tables of each page by their top edge, text
    before tables where they share it; pages in order.

    ``doc_id, page_num, y1, ord, val`` in both.
    """
    rows = blocks.select("doc_id", "page_num", "y1", F.lit(0).alias("k"), "ord", "val")
    rows = rows.unionByName(tables.select("doc_id", "page_num", "y1", F.lit(1).alias("k"), "ord", "val"))
    return ordered_text(rows, "doc_id", ["page_num", "y1", "k", "ord"], "val")


def assemble(pages: DataFrame, markers: bool = False) -> DataFrame:
    """``doc_id, text``: the parts of each page by line, pages by blank line; a
    page without text says so."""
    one = F.array_sort(F.collect_list(F.struct("ord", "val")))
    rows = pages.groupBy("doc_id", "page_num").agg(one.alias("p"))
    own = F.filter(F.col("p.val"), lambda v: T.strip(v) != "")
    text = F.when(F.size(own) > 0, F.array_join(own, "\n")).otherwise("[No text recognized]")
    if markers:
        text = F.concat(F.lit("=== PAGE "), F.col("page_num").cast("string"), F.lit(" ===\n"), text)
    rows = rows.withColumn("t", text).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("page_num", "t"))).alias("q"))
    return rows.select("doc_id", F.array_join(F.col("q.t"), "\n\n").alias("text"))


def doc_summary(pages: DataFrame) -> DataFrame:
    """Pages, recognised pages, tables and method of each document.  ``doc_id,
    used_ocr, n_tables``."""
    found = pages.groupBy("doc_id").agg(F.count(F.lit(1)).alias("pages"), F.count_if("used_ocr").alias("ocr_pages"), F.sum("n_tables").alias("tables"))
    return found.withColumn("method", F.when(F.col("ocr_pages") > 0, "hybrid").otherwise("direct"))


def batch_report(rows: DataFrame, key: str, order: str) -> DataFrame:
    """One text a key: ``=== file ===`` and the text of each file."""
    part = F.concat(F.lit("=== "), F.col("file"), F.lit(" ===\n"), F.col("text"))
    one = F.array_sort(F.collect_list(F.struct(order, part.alias("v"))))
    return rows.groupBy(key).agg(one.alias("p")).select(key, F.array_join(F.col("p.v"), "\n\n").alias("report"))


def cli_json(text: Column, source: Column, success: Column) -> Column:
    return F.to_json(F.struct(text.alias("text"), source.alias("source"), success.alias("success")))

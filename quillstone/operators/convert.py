"""Lines of pages to the text of documents, page by page.

A line table has ``doc_id, page_num, ord, x1, y1, x2, y2, text, font_size,
is_bold``; tables ``doc_id, page_num, ord, x1, y1, x2, y2, rows``; recognised
texts, of images or whole pages, ``doc_id, page_num, image_text, page_text``.
Recognition is costly, so it is not called here: ask for the pages that need it
(``needed``), recognise those, and convert with their texts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T_

from quillstone.functions import text as T
from quillstone.operators import layout, pages, tables


def _keyed(df: DataFrame) -> DataFrame:
    """A page of a document as one key for the page operators."""
    return df.withColumn("page_id", F.struct("doc_id", "page_num"))


def blocks(lines: DataFrame, found: DataFrame | None, width: float) -> DataFrame:
    """Merged blocks of the lines that no table covers, page by page."""
    rows = _keyed(lines)
    if found is not None:
        rows = layout.outside(rows, _keyed(found))
    # both ids as one text, which tells any two pages apart
    kind = T_.StructType([rows.schema["doc_id"], rows.schema["page_num"]])
    keyed = rows.withColumn("page_id", F.to_json("page_id")).drop("doc_id", "page_num")
    merged = layout.merge_lines(keyed, width).withColumn("page_id", F.from_json("page_id", kind))
    return merged.select("page_id.*", F.col("block").alias("ord"), *layout.BOX, "text", "font_size", "is_bold", "kind")


def strategies(lines: DataFrame, seen: DataFrame, recognized: DataFrame | None = None, callback: bool = True) -> DataFrame:
    """``doc_id, page_num, strategy`` of every page of ``seen``."""
    text = F.array_join(F.array_sort(F.collect_list(F.struct("ord", "text"))).getField("text"), "\n")
    own = lines.groupBy("doc_id", "page_num").agg(F.sum(F.length(T.strip("text"))).alias("n"), text.alias("whole"))
    rows = seen.select("doc_id", "page_num").distinct().join(own, ["doc_id", "page_num"], "left")
    if recognized is not None:
        rows = rows.join(recognized.select("doc_id", "page_num", "image_text"), ["doc_id", "page_num"], "left")
    else:
        rows = rows.withColumn("image_text", F.lit(""))
    m = F.coalesce(F.length(T.strip("image_text")), F.lit(0))
    poor = pages.must_recognize(F.coalesce("whole", F.lit("")), callback)
    chosen = F.when(poor, "garbled_text_ocr").otherwise(pages.strategy(F.coalesce("n", F.lit(0)), m, callback))
    return rows.select("doc_id", "page_num", chosen.alias("strategy"))


def needed(strategy: DataFrame) -> DataFrame:
    """The pages whose image has to be recognised."""
    return strategy.filter(F.col("strategy").isin("scanned_ocr", "garbled_text_ocr", "ocr_fallback"))


def convert(lines: DataFrame, seen: DataFrame, width: float, found: DataFrame | None = None, recognized: DataFrame | None = None, callback: bool = True) -> tuple[DataFrame, DataFrame]:
    """(texts, pages): ``doc_id, text`` and ``doc_id, page_num, strategy,
    used_ocr, n_tables``.

    A page to be recognised takes its recognised text where there is one;
    scanned pages lose their tables, others keep them.
    """
    key = ["doc_id", "page_num"]
    plan = strategies(lines, seen, recognized, callback)
    if recognized is not None:
        plan = plan.join(recognized.select(*key, "page_text"), key, "left")
    else:
        plan = plan.withColumn("page_text", F.lit(None).cast("string"))
    wants = F.col("strategy").isin("scanned_ocr", "garbled_text_ocr", "ocr_fallback")
    plan = plan.withColumn("used_ocr", wants & (F.coalesce(T.strip("page_text"), F.lit("")) != ""))
    texts = blocks(lines, found, width).join(plan.filter(~F.col("used_ocr")).select(*key), key)
    texts = texts.select(*key, "y1", "ord", F.col("text").alias("val"))
    seen_texts = plan.filter("used_ocr").select(*key, F.lit(0.0).alias("y1"), F.lit(0).cast("long").alias("ord"), F.col("page_text").alias("val"))
    if found is not None:
        kept = found.join(plan.filter(~(F.col("used_ocr") & (F.col("strategy") == "scanned_ocr"))).select(*key), key)
        cells = kept.select(*key, "y1", F.col("ord").cast("long").alias("ord"), tables.tsv("rows").alias("val"))
        counts = kept.groupBy(*key).agg(F.count(F.lit(1)).alias("n_tables"))
        plan = plan.join(counts, key, "left")
    else:
        cells = texts.limit(0)
        plan = plan.withColumn("n_tables", F.lit(0).cast("long"))
    made = pages.pages_to_text(texts.unionByName(seen_texts), cells)
    return made, plan.select(*key, "strategy", "used_ocr", F.coalesce("n_tables", F.lit(0)).alias("n_tables"))

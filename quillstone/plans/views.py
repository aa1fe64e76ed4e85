"""Views of the shared tables that the queries read, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

WIDTH, HEIGHT = 700.0, 900.0  # of the pages in the box view
LINES = 1_000_000  # more than any document has; a line's image is numbered by both


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "text")


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = docs(spark, sf_dir).select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "text"))
    return rows.select("doc_id", F.col("pos").cast("long").alias("line_no"), "text")


def images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line of every document as the text of an image."""
    return lines(spark, sf_dir).select((F.col("doc_id") * LINES + F.col("line_no")).alias("image_id"), "text")


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What three engines read in each image: the line itself, the line in
    lower case but for every third, and the line with a letter confused, or for
    every fifth a single stroke."""
    d = images(spark, sf_dir)
    i, t = F.col("image_id"), F.col("text")

    def conf(k: int):
        return (50 + (i * k) % 41).cast("double") / 100

    made = [
        (0, "tesseract", t, conf(7)),
        (1, "easyocr", F.when(i % 3 == 0, t).otherwise(F.lower(t)), conf(11)),
        (2, "paddleocr", F.when(i % 5 == 0, "l").otherwise(F.replace(t, F.lit("e"), F.lit("c"))), conf(7)),
    ]
    each = F.array(*[F.struct(F.lit(k).alias("ord"), F.lit(e).alias("engine"), x.alias("text"), c.alias("confidence")) for k, e, x, c in made])
    return d.select("image_id", F.explode(each).alias("c")).select("image_id", "c.*")


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line item as a box; four orders make a page."""
    rows = table(spark, sf_dir, "lineitem")
    x, y = F.col("l_partkey") * 37 % 500, F.col("l_suppkey") * 53 % 700
    rows = rows.select(
        F.shiftright("l_orderkey", 2).alias("page_id"), x.cast("double").alias("x1"), y.cast("double").alias("y1"),
        (x + 20 + F.col("l_quantity") * 2).cast("double").alias("x2"), (y + 10 + F.col("l_linenumber") * 6).cast("double").alias("y2"),
        F.col("l_discount").cast("double").alias("conf"),
    ).distinct()
    order = Window.partitionBy("page_id").orderBy("x1", "y1", "x2", "y2", "conf")
    return rows.withColumn("ord", F.row_number().over(order).cast("long"))


def logits(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda t: F.slice("embedding", t * 8 + 1, F.lit(8)))
    return table(spark, sf_dir, "embeddings").select("vec_id", m.alias("m"))


def table_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every ten customers as the text of a table."""
    rows = table(spark, sf_dir, "customer").groupBy(F.floor(F.col("c_custkey") / 10).alias("doc_id")).agg(F.array_sort(F.collect_list(F.struct("c_custkey", "c_name", "c_mktsegment"))).alias("r"))

    def line(r):
        return F.concat(r["c_name"], F.lit("  "), r["c_custkey"].cast("string"), F.lit("  "), r["c_mktsegment"])

    return rows.select("doc_id", F.concat(F.lit("Tên  Số  Loại\n"), F.array_join(F.transform("r", line), "\n")).alias("text"))


def garbled(spark: SparkSession, sf_dir: str) -> DataFrame:
    i, t = F.col("doc_id") % 4, F.col("text")
    text = F.when(i == 0, F.replace(t, F.lit("e"), F.lit("3"))).when(i == 1, F.replace(t, F.lit(" t"), F.lit("t"))).when(i == 2, F.replace(t, F.lit("a"), F.lit("'"))).otherwise(t)
    return docs(spark, sf_dir).select("doc_id", text.alias("text"))


def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes as text blocks of a page, with texts, fonts and kinds."""
    b = boxes(spark, sf_dir)
    k = F.col("ord") % 6
    text = (
        F.when(k == 0, F.concat(F.lit("- item "), F.col("ord").cast("string"))).when(k == 1, F.lit("CHAPTER HEAD"))
        .when(k == 2, F.concat(F.lit("2. Part "), F.col("ord").cast("string"))).when(k == 3, F.lit("Some words that go on and on, until the line is long enough to justify it"))
        .when(k == 4, F.lit("con-\ntinued\n now")).otherwise(F.lit("ends here."))
    )
    return b.select(
        "*", text.alias("text"), (F.col("ord") % 9 + 9).cast("double").alias("font_size"), (F.col("ord") % 2 == 0).alias("is_bold"),
        F.when(k == 1, "title").otherwise("text").alias("kind"), F.array(F.col("x1") + 20, F.col("x1"), F.col("x1") + 3).alias("line_lefts"),
    )


def spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words of every line as its spans."""
    rows = images(spark, sf_dir).select(F.col("image_id").alias("line_id"), F.posexplode(F.split("text", " ")).alias("ord", "text"))
    x = (F.col("ord") * 50).cast("double")
    return rows.select("line_id", "ord", "text", x.alias("x1"), (x + 47 + F.col("ord") % 4).cast("double").alias("x2"), F.lit(11.0).alias("size"))


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's lines as pages of four, with sizes of text and images."""
    rows = lines(spark, sf_dir).withColumn("page_num", F.floor(F.col("line_no") / 4) + 1)
    return rows.withColumn("ord", F.col("line_no") % 4)


#: Parts of words of the texts, from which rules are made.
PARTS = ["an", "and", "at", "ble", "con", "de", "ed", "ent", "er", "es", "ha", "he", "in", "ing", "la", "le", "ly", "nd", "nt", "on", "ou", "re", "sh", "st", "th", "the", "ti", "tion", "was", "wh"]


def rules() -> list[tuple[str, str, str]]:
    """About 600 rules as users keep them: patterns, phrases and words, with
    chains (a rule's result is a later rule's pattern), overlaps (patterns
    inside others) and ties (patterns of equal length)."""
    n = len(PARTS)
    words = [(PARTS[i] + PARTS[j], PARTS[j] + PARTS[(i + j) % n]) for i in range(n) for j in range(n) if (i + 2 * j) % 3 == 0 and i != j]
    phrases = [(f"{PARTS[i]} {PARTS[(3 * i + k) % n]}", f"{PARTS[(3 * i + k) % n]}{PARTS[i]} {PARTS[k]}") for i in range(n) for k in range(5)]
    patterns = [(rf"\b({p})({q})\b", rf"\2{p}") for p, q in zip(PARTS, PARTS[7:] + PARTS[:7])] + [(rf"{p}{p}+", p) for p in PARTS[::2]]
    patterns += [(rf"\b{p}\s+{q}\b", f"{p}{q}") for p, q in zip(PARTS[1::2], PARTS[::2])]
    made = [("word", *w) for w in words] + [("phrase", *p) for p in phrases] + [("regex", *r) for r in patterns]
    return made


def history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("ts", F.col("event_type").alias("engine"), (F.col("value") / 1000).alias("confidence"))


_CONF = "CAST(50 + (image_id*{k})%41 AS DOUBLE)/100"
_BOX_X, _BOX_Y = "l_partkey*37 % 500", "l_suppkey*53 % 700"
_LINES = "SELECT doc_id, CAST(generate_subscripts(l, 1) - 1 AS BIGINT) AS line_no, unnest(l) AS text FROM (SELECT doc_id, str_split(text, chr(10)) AS l FROM documents) ls"
_IMAGES = f"SELECT doc_id * {LINES} + line_no AS image_id, text FROM ({_LINES}) li"

#: The same views in DuckDB SQL.
SQL = {
    "docs": "SELECT doc_id, text FROM documents",
    "lines": _LINES,
    "cands": f"SELECT image_id, 0 AS ord, 'tesseract' AS engine, text, {_CONF.format(k=7)} AS confidence FROM ({_IMAGES}) i0 "
    f"UNION ALL SELECT image_id, 1, 'easyocr', CASE WHEN image_id%3=0 THEN text ELSE lower(text) END, {_CONF.format(k=11)} FROM ({_IMAGES}) i1 "
    f"UNION ALL SELECT image_id, 2, 'paddleocr', CASE WHEN image_id%5=0 THEN 'l' ELSE replace(text, 'e', 'c') END, {_CONF.format(k=7)} FROM ({_IMAGES}) i2",
    "boxes": "SELECT page_id, CAST(row_number() OVER (PARTITION BY page_id ORDER BY x1, y1, x2, y2, conf) AS BIGINT) AS ord, x1, y1, x2, y2, conf FROM "
    f"(SELECT DISTINCT l_orderkey // 4 AS page_id, CAST({_BOX_X} AS DOUBLE) AS x1, CAST({_BOX_Y} AS DOUBLE) AS y1, CAST({_BOX_X} + 20 + l_quantity*2 AS DOUBLE) AS x2, "
    f"CAST({_BOX_Y} + 10 + l_linenumber*6 AS DOUBLE) AS y2, CAST(l_discount AS DOUBLE) AS conf FROM lineitem) q",
    "logits": "SELECT vec_id, list_transform(range(0,8), lambda t: embedding[t*8+1 : t*8+8]) AS m FROM embeddings",
    "texts": "SELECT c_custkey // 10 AS doc_id, 'Tên  Số  Loại'||chr(10)||string_agg(c_name||'  '||c_custkey||'  '||c_mktsegment, chr(10) ORDER BY c_custkey) AS text FROM customer GROUP BY 1",
    "garbled": "SELECT doc_id, CASE doc_id%4 WHEN 0 THEN replace(text,'e','3') WHEN 1 THEN replace(text,' t','t') WHEN 2 THEN replace(text,'a',chr(39)) ELSE text END AS text FROM documents",
    "history": "SELECT ts, event_type AS engine, value/1000 AS confidence FROM events",
}
SQL["blocks"] = (
    "SELECT *, CASE ord%6 WHEN 0 THEN '- item '||ord WHEN 1 THEN 'CHAPTER HEAD' WHEN 2 THEN '2. Part '||ord WHEN 3 THEN 'Some words that go on and on, until the line is long enough to justify it' "
    "WHEN 4 THEN 'con-'||chr(10)||'tinued'||chr(10)||' now' ELSE 'ends here.' END AS text, CAST(ord%9+9 AS DOUBLE) AS font_size, ord%2=0 AS is_bold, "
    f"CASE WHEN ord%6=1 THEN 'title' ELSE 'text' END AS kind, [x1+20, x1, x1+3] AS line_lefts FROM ({SQL['boxes']}) bx"
)
SQL["spans"] = (
    "SELECT line_id, ord, text, CAST(ord*50 AS DOUBLE) AS x1, CAST(ord*50+47+ord%4 AS DOUBLE) AS x2, 11.0::DOUBLE AS size FROM "
    f"(SELECT image_id AS line_id, CAST(generate_subscripts(l, 1) - 1 AS INTEGER) AS ord, unnest(l) AS text FROM (SELECT image_id, str_split(text, ' ') AS l FROM ({_IMAGES}) im) sl) sp"
)
SQL["pages"] = f"SELECT *, CAST(line_no//4 + 1 AS BIGINT) AS page_num, line_no%4 AS ord FROM ({SQL['lines']}) ln"


def with_views(*names: str) -> str:
    """A WITH clause of the named views, each under its name and ``_v``."""
    return "WITH " + ", ".join(f"{n}_v AS ({SQL[n]})" for n in names) + " "

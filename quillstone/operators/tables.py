"""Tables in plain text: finding, cleaning, parsing, writing and locating them.

A table is a column ``array<array<string>>`` of rows and cells; lines are a
column ``array<string>``.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types

from quillstone.functions import text as T
from quillstone.functions import values as V

EMPTY = "[Empty table]"


def is_table_line(c: Column | str) -> Column:
    """If a line looks like a row of a table: keywords, digits, or few words."""
    return T.let(T.strip(c), lambda x: T.let(F.size(T.words(x)), lambda n: _row_like(x, n)))


def _row_like(c: Column, n: Column) -> Column:
    low = F.lower(c)
    never = c.rlike(r"^[-•*]") | (F.length(c) < 2) | ((n == 1) & (F.length(c) > 20)) | (n > 25) | (n < 1)
    likely = (
        T.any_of(low, V.LINE_KEYWORDS) | T.any_of(low, V.PLACES) | T.any_of(low, V.JOBS) | c.rlike(r"\p{Nd}")
        | ((n <= 2) & T.starts_upper(c)) | ((n >= 2) & (n <= 10))
    )
    return ~never & likely


def is_table_block(lines: Column | str) -> Column:
    """If lines look like a table: header words, like lengths, columns or numbers."""
    return T.let(T.col(lines), _block_like)


def _block_like(lines: Column) -> Column:
    n = F.size(lines)
    low = F.lower(F.array_join(lines, "\n"))
    sizes = F.transform(lines, F.length)
    mean = F.aggregate(sizes, F.lit(0), lambda a, x: a + x) / n
    columns = F.size(F.filter(lines, lambda x: F.size(T.words(x)).between(2, 10)))

    def like_lengths(mean: Column) -> Column:
        return (mean < 200) & (F.size(F.filter(sizes, lambda x: (x >= mean * 0.4) & (x <= mean * 1.6))) >= n * 0.5)

    def by_text(low: Column) -> Column:
        headers = sum((F.contains(low, F.lit(k)).cast("int") for k in V.HEADER_KEYWORDS), F.lit(0))
        numbers = F.regexp_count(low, F.lit("[0-9]+"))
        share = numbers / F.greatest(F.lit(1), F.size(T.words(low)))
        return (headers >= 2) | ((numbers > 0) & share.between(0.15, 0.8) & (n >= 3))

    return (n >= 2) & (T.let(mean, like_lengths) | (columns >= n * 0.6) | T.let(low, by_text))


def clean_block(lines: Column | str) -> Column:
    """Without lines that repeat one of the three before them in whole or in
    part; the first line stays.  Each line is split into words once."""

    def alike(cur: Column, prev: Column) -> Column:
        a, b = cur["w"], prev["w"]
        shared = F.size(F.filter(a, lambda w: F.array_contains(b, w)))
        part = F.contains(F.array_join(b, " "), F.array_join(a, " ")) | (shared >= F.greatest(F.lit(2), F.size(a) - 1))
        return (cur["s"] == prev["s"]) | ((F.size(a) > 0) & (F.size(a) <= F.size(b)) & part)

    def clean(rows: Column) -> Column:
        def keep(x: Column, i: Column) -> Column:
            before = F.slice(rows, F.greatest(i - 2, F.lit(1)), F.least(i, F.lit(3)))
            return (i == 0) | ~F.exists(before, lambda p: alike(x, p))

        return F.transform(F.filter(rows, keep), lambda x: x["x"])

    rows = F.transform(T.col(lines), lambda x: F.struct(x.alias("x"), T.strip(x).alias("s"), T.words(x).alias("w")))
    return T.let(rows, clean)


def table_islands(docs: DataFrame, key: str = "doc_id", least: int = 3) -> DataFrame:
    """Runs of at least ``least`` table lines within a paragraph:
    ``key, para, island, first_line, lines``.

    Runs are found within the document's own row, so no line is shuffled.
    """
    paras = docs.select(key, F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n\n")).alias("para", "p"))
    paras = paras.select(key, "para", T.lines("p").alias("lines")).filter(F.size("lines") >= least)
    none = F.array().cast("array<struct<start:int,stop:int>>")
    state = F.struct(F.lit(0).alias("k"), F.lit(0).alias("start"), none.alias("out"))

    def closed(acc: Column) -> Column:
        run = F.array(F.struct(acc["start"].alias("start"), acc["k"].alias("stop")))
        return F.when(acc["k"] - acc["start"] >= least, F.concat(acc["out"], run)).otherwise(acc["out"])

    def step(acc: Column, x: Column) -> Column:
        k = acc["k"] + 1
        on = F.struct(k.alias("k"), acc["start"].alias("start"), acc["out"].alias("out"))
        return F.when(is_table_line(x), on).otherwise(F.struct(k.alias("k"), k.alias("start"), closed(acc).alias("out")))

    runs = F.aggregate("lines", state, step, closed)
    found = paras.select(key, "para", "lines", F.posexplode(runs).alias("island", "r"))
    return found.select(key, "para", "island", F.col("r.start").alias("first_line"), F.slice("lines", F.col("r.start") + 1, F.col("r.stop") - F.col("r.start")).alias("lines"))


def find_tables(docs: DataFrame, key: str = "doc_id", least: int = 3) -> DataFrame:
    """The texts of the tables in a document; ``index`` restarts in each paragraph."""
    found = table_islands(docs, key, least).filter(is_table_block("lines"))
    found = found.withColumn("lines", clean_block("lines")).filter(F.size("lines") >= least)
    order = Window.partitionBy(key, "para").orderBy("island")
    return found.select(key, "para", (F.row_number().over(order) - 1).alias("index"), F.array_join("lines", "\n").alias("table_text"))


def tabbed(c: Column | str) -> Column:
    """Lines with runs of spaces as tabs."""
    c = T.col(c)
    return F.when(T.strip(c) == "", EMPTY).otherwise(F.array_join(F.transform(T.lines(c), lambda x: F.regexp_replace(x, r"\s{2,}", "\t")), "\n"))


def parse_rows(c: Column | str) -> Column:
    """Rows and cells of an inline table, cells parted by two spaces or a tab."""
    cells = F.transform(T.lines(c), lambda x: F.filter(F.transform(F.split(x, r"\s{2,}|\t"), T.strip), lambda v: v != ""))
    return F.filter(cells, lambda r: F.size(r) > 0)


def parse_kind(c: Column | str) -> Column:
    """``empty``, ``structured`` (at most two widths, the first above one) or ``list``."""
    rows = parse_rows(c)
    widths = F.array_distinct(F.transform(rows, F.size))
    good = (F.size(rows) > 1) & (F.size(widths) <= 2) & (F.size(F.get(rows, F.lit(0))) > 1)
    return F.when(F.size(rows) == 0, "empty").when(good, "structured").otherwise("list")


def is_column_header(c: Column | str) -> Column:
    """If a cell looks like the head of a column."""
    c = T.strip(c)
    n = F.length(c)
    letters, digits = F.length(T.letters_only(c)), F.length(F.regexp_replace(c, r"[^\p{Nd}]", ""))
    count = F.size(T.words(c))
    one = F.lower(c).isin(V.COLUMN_HEADERS) | (n > 5)
    return n.between(2, 50) & (letters >= n * 0.5) & (digits <= n * 0.3) & ((count >= 2) | ((count == 1) & one))


def vertical_width(lines: Column) -> Column:
    """Columns of a table with one cell a line: the heads that come first, else
    a usual number whose first cells are heads, else 4."""
    n = F.size(lines)
    heads = F.transform(lines, is_column_header)
    start = F.struct(F.lit(0).alias("i"), F.lit(0).alias("count"), F.lit(False).alias("done"))

    def step(acc: Column, head: Column) -> Column:
        over = acc["done"] | (~head & ((acc["count"] >= 2) | (acc["i"] > 5)))
        return F.struct((acc["i"] + 1).alias("i"), (acc["count"] + F.when(~over & head, 1).otherwise(0)).alias("count"), over.alias("done"))

    def chosen(heads: Column) -> Column:
        usual = F.lit(4)
        for k in reversed([4, 3, 5, 6, 2, 7]):
            found = F.size(F.filter(F.slice(heads, 1, k), lambda h: h))
            usual = F.when((n % k == 0) & (found >= k * 0.8), k).otherwise(usual)
        count = F.aggregate(heads, start, step, lambda a: a["count"])
        return T.let(count, lambda c: F.when(c >= 2, c).otherwise(usual))

    return T.let(heads, chosen)


def vertical_rows(c: Column | str) -> Column:
    """Rows of a table with one cell a line; null if the text is none."""

    def label(v: Column) -> Column:
        digits = F.length(F.regexp_replace(v, r"[^\p{Nd}]", ""))
        return (digits <= F.length(v) * 0.5) & v.rlike(r"\p{L}")

    def of(lines: Column, width: Column) -> Column:
        count = F.floor(F.size(lines) / F.greatest(width, F.lit(1))).cast("int")
        whole = width.between(2, 10) & (F.size(lines) >= 2) & (F.pmod(F.size(lines), F.greatest(width, F.lit(1))) == 0) & (count >= 2)
        rows = F.transform(F.sequence(F.lit(0), F.greatest(count, F.lit(1)) - 1), lambda k: F.slice(lines, k * width + 1, width))
        return F.when(whole, T.let(rows, lambda r: F.when(fits(r, width), r)))

    def fits(rows: Column, width: Column) -> Column:
        head = F.get(rows, F.lit(0))
        heads = ~F.exists(head, lambda v: F.length(v) > 50) & (F.size(F.filter(head, label)) >= width * 0.7)
        data = F.slice(rows, 2, 5)
        good = F.size(F.filter(data, lambda r: F.exists(r, lambda v: v != "") & ~F.exists(r, lambda v: F.length(v) > 200)))
        return heads & ((F.size(rows) < 3) | (good >= F.size(data) / 2))

    return T.let(T.lines(c), lambda lines: T.let(vertical_width(lines), lambda w: of(lines, w)))


def parse(c: Column | str) -> Column:
    """Rows of a table's text: one cell a line if it reads like that, else inline."""
    return F.coalesce(vertical_rows(c), parse_rows(c))


def tsv(rows: Column | str) -> Column:
    return F.array_join(F.transform(T.col(rows), lambda r: F.array_join(r, "\t")), "\n")


def csv_text(rows: Column | str) -> Column:
    """Comma-separated lines; a cell with a comma or quote is quoted and its
    line breaks are spaces."""

    def cell(v: Column) -> Column:
        v = T.strip(F.replace(v, F.lit("\n"), F.lit(" ")))
        return F.when(v.rlike('[",]'), F.concat(F.lit('"'), F.replace(v, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(v)

    return F.array_join(F.transform(T.col(rows), lambda r: F.array_join(F.transform(r, cell), ",")), "\r\n")


def compact(rows: Column | str) -> Column:
    """Cells cleaned; no empty rows or columns; short rows filled up."""
    clean = F.transform(T.col(rows), lambda r: F.transform(r, T.clean_cell))
    clean = F.filter(clean, lambda r: F.exists(r, lambda v: v != ""))
    width = F.coalesce(F.array_max(F.transform(clean, F.size)), F.lit(0))
    at = F.when(width > 0, F.sequence(F.lit(0), width - 1)).otherwise(F.array().cast("array<int>"))
    kept = F.filter(at, lambda i: F.exists(clean, lambda r: F.coalesce(F.get(r, i), F.lit("")) != ""))
    return F.transform(clean, lambda r: F.transform(kept, lambda i: F.coalesce(F.get(r, i), F.lit(""))))


def dedupe_tables(tables: DataFrame, key: str = "page_id") -> DataFrame:
    """The first of the tables with the same rounded box and shape."""
    box = [F.bround(c, 1) for c in ("x1", "y1", "x2", "y2")]
    w = Window.partitionBy(key, *box, "n_rows", "n_cols").orderBy("ord")
    return tables.withColumn("_k", F.row_number().over(w)).filter("_k = 1").drop("_k")


def _widths(rows: Column, more: int) -> Column:
    at = F.sequence(F.lit(0), F.size(F.get(rows, F.lit(0))) - 1)
    return F.transform(at, lambda i: F.array_max(F.transform(rows, lambda r: F.length(F.coalesce(F.get(r, i), F.lit(""))))) + more)


def _rule(widths: Column, left: str, mid: str, right: str) -> Column:
    return F.concat(F.lit(left), F.array_join(F.transform(widths, lambda w: F.repeat(F.lit("─"), w)), mid), F.lit(right))


def _left(v: Column, w: Column) -> Column:
    return F.concat(v, F.repeat(F.lit(" "), w - F.length(v)))


def _middle(v: Column, w: Column) -> Column:
    """Centred; an odd space goes left if the width is odd, else right."""
    room = w - F.length(v)
    left = F.floor(room / 2).cast("int") + F.when((room % 2 == 1) & (w % 2 == 1), 1).otherwise(0)
    return F.concat(F.repeat(F.lit(" "), left), v, F.repeat(F.lit(" "), room - left))


def _row(r: Column, widths: Column, pad) -> Column:
    return F.transform(widths, lambda w, i: pad(F.coalesce(F.get(r, i), F.lit("")), w))


def _blank(rows: Column) -> Column:
    return F.coalesce((F.size(rows) == 0) | (F.size(F.get(rows, F.lit(0))) == 0), F.lit(True))


def as_markdown(rows: Column | str) -> Column:
    rows = T.col(rows)
    line = F.transform(rows, lambda r: F.concat(F.lit("| "), F.array_join(r, " | "), F.lit(" |")))
    bar = F.concat(F.lit("|"), F.repeat(F.lit("---|"), F.size(F.get(rows, F.lit(0)))))
    body = F.concat(F.slice(line, 1, 1), F.array(bar), F.slice(line, F.lit(2), F.greatest(F.size(line) - 1, F.lit(0))))
    return F.when(_blank(rows), EMPTY).otherwise(F.array_join(body, "\n"))


def as_simple(rows: Column | str) -> Column:
    rows = T.col(rows)
    widths = _widths(rows, 0)
    return F.when(_blank(rows), EMPTY).otherwise(F.array_join(F.transform(rows, lambda r: F.array_join(_row(r, widths, _left), "  ")), "\n"))


def as_grid(rows: Column | str) -> Column:
    rows = T.col(rows)
    widths = _widths(rows, 2)
    line = F.transform(rows, lambda r: F.concat(F.lit("│"), F.array_join(_row(r, widths, _middle), "│"), F.lit("│")))
    between = F.concat(F.lit("\n"), _rule(widths, "├", "┼", "┤"), F.lit("\n"))
    body = F.call_function("array_join", line, between)
    return F.when(_blank(rows), EMPTY).otherwise(F.concat_ws("\n", _rule(widths, "┌", "┬", "┐"), body, _rule(widths, "└", "┴", "┘")))


def as_box(rows: Column | str) -> Column:
    rows = T.col(rows)
    widths = _widths(rows, 2)

    def left(v: Column, w: Column) -> Column:
        return F.concat(F.lit(" "), _left(v, w - 1))

    head = F.concat(F.lit("│"), F.array_join(_row(F.get(rows, F.lit(0)), widths, _middle), "│"), F.lit("│"))
    rest = F.slice(rows, F.lit(2), F.greatest(F.size(rows) - 1, F.lit(0)))
    body = F.transform(rest, lambda r: F.concat(F.lit("│"), F.array_join(_row(r, widths, left), "│"), F.lit("│")))
    lines = F.concat(F.array(_rule(widths, "┌", "┬", "┐"), head, _rule(widths, "├", "┼", "┤")), body, F.array(_rule(widths, "└", "┴", "┘")))
    return F.when(_blank(rows), EMPTY).otherwise(F.array_join(lines, "\n"))


# Styles of a written table (fixed values of the format).
_TABLE = "border-collapse: collapse; border: 2px solid #333; width: 100%; margin: 10px 0;"
_HEAD = '  <thead>\n    <tr style="background-color: #4CAF50; color: white;">\n'
_TH = "border: 1px solid #ddd; padding: 12px; text-align: left; font-weight: bold;"
_TD = "border: 1px solid #ddd; padding: 10px;"


def as_html(rows: Column | str) -> Column:
    """A styled table; only ``<`` and ``>`` of cells are escaped."""
    rows = T.col(rows)

    def cells(r: Column, tag: str, style: str) -> Column:
        def one(v: Column) -> Column:
            v = F.replace(F.replace(v, F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
            return F.concat(F.lit(f'      <{tag} style="{style}">'), v, F.lit(f"</{tag}>\n"))

        return F.array_join(F.transform(r, one), "")

    def line(r: Column, i: Column) -> Column:
        shade = F.when((i + 1) % 2 == 0, "#f9f9f9").otherwise("white")
        return F.concat(F.lit('    <tr style="background-color: '), shade, F.lit(';">\n'), cells(r, "td", _TD), F.lit("    </tr>\n"))

    rest = F.slice(rows, F.lit(2), F.greatest(F.size(rows) - 1, F.lit(0)))
    made = F.concat(
        F.lit(f'<table style="{_TABLE}">\n{_HEAD}'), cells(F.get(rows, F.lit(0)), "th", _TH), F.lit("    </tr>\n  </thead>\n  <tbody>\n"),
        F.array_join(F.transform(rest, line), ""), F.lit("  </tbody>\n</table>"),
    )
    return F.when(_blank(rows), f"<p>{EMPTY}</p>").otherwise(made)


def bordered(c: Column | str, form: str = "simple") -> Column:
    """A table's text parsed and written again; an empty one says so."""
    rows = parse(c)
    made = {"markdown": as_markdown, "grid": as_grid}.get(form, as_simple)(rows)
    return F.when(parse_kind(c) == "empty", EMPTY).otherwise(made)


def append_tables(docs: DataFrame, tables: DataFrame, key: str = "doc_id") -> DataFrame:
    """Each text with its tables after it, page by page.

    ``tables`` has ``key, page, index, table_text``; pages are numbered in the
    order they come.  A document without tables keeps its text.
    """
    line = F.lit("=" * 60 + "\n")
    one = F.concat(F.lit("\n📋 Table "), (F.col("index") + 1).cast("string"), F.lit(":\n" + "-" * 40 + "\n"), bordered("table_text"), F.lit("\n"))
    pages = tables.withColumn("_one", one).groupBy(key, "page").agg(F.array_sort(F.collect_list(F.struct("index", "_one"))).alias("t"))
    page = F.concat(F.lit("\n--- PAGE "), (F.col("page") + 1).cast("string"), F.lit(" ---\n"), F.array_join(F.col("t._one"), ""))
    whole = pages.withColumn("_page", page).groupBy(key).agg(F.array_sort(F.collect_list(F.struct("page", "_page"))).alias("p"))
    head = F.concat(F.lit("\n\n"), line, F.lit("📊 EXTRACTED TABLES\n"), line)
    return docs.join(whole, key, "left").select(key, F.concat("text", F.coalesce(F.concat(head, F.array_join(F.col("p._page"), "")), F.lit(""))).alias("text"))


def locate(text: str, tables: list[str]) -> list[tuple[int, int, int]]:
    """(start, end, table) of tables found one after the other in a text."""
    out, since = [], 0
    for k, table in enumerate(tables):
        rows = [x.strip() for x in table.split("\n")]
        start = text.find(rows[0], since)
        if start < 0:
            continue
        end = start + len(rows[0])
        for row in filter(None, rows[1:]):
            at = text.find(row, end)
            if at < 0:
                break
            end = at + len(row)
        while end < len(text) and text[end] in "\n\r\t ":
            end += 1
        out.append((start, end, k))
        since = end
    return sorted(out)


def segments(text: str, tables: list[str]) -> list[tuple[str, str]]:
    """A text as alternating ('text' or 'table', content)."""
    out, last = [], 0
    for start, end, k in locate(text, tables):
        if (before := text[last:start].strip()):
            out.append(("text", before))
        out.append(("table", tables[k]))
        last = end
    if (rest := text[last:].strip()) or not tables:
        out.append(("text", rest if tables else text))
    return out


_PLACES = types.ArrayType(types.StructType([types.StructField(n, types.IntegerType()) for n in ("start", "stop", "idx")]))
_SEGMENTS = types.ArrayType(types.StructType([types.StructField(n, types.StringType()) for n in ("kind", "content")]))


@F.pandas_udf(_PLACES)
def locate_tables(text: pd.Series, tables: pd.Series) -> pd.Series:
    return pd.Series([[{"start": a, "stop": b, "idx": k} for a, b, k in locate(t or "", list(s))] for t, s in zip(text, tables)])


@F.pandas_udf(_SEGMENTS)
def segment_text(text: pd.Series, tables: pd.Series) -> pd.Series:
    return pd.Series([[{"kind": k, "content": c} for k, c in segments(t or "", list(s))] for t, s in zip(text, tables)])


def with_tables(docs: DataFrame, tables: DataFrame, key: str = "doc_id") -> DataFrame:
    """``docs`` with ``tables``, the table texts of each in order."""
    one = tables.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("para", "index", "table_text"))).alias("t"))
    return docs.join(one.select(key, F.col("t.table_text").alias("tables")), key, "left").withColumn("tables", F.coalesce("tables", F.array().cast("array<string>")))

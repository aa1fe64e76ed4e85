"""Boxes on pages: overlap, order, grouping and merging.

A box table has ``page_id, ord, x1, y1, x2, y2`` and perhaps ``conf``.  Folds
whose test reads what was merged so far run over a page's sorted boxes in one
row, or in one group of a page; a page's boxes fit a task.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T_

from quillstone.functions import text as T
from quillstone.functions import values as V

BOX = ["x1", "y1", "x2", "y2"]


def _corners(a: str, b: str) -> tuple[Column, Column]:
    w = F.least(f"{a}.x2", f"{b}.x2") - F.greatest(f"{a}.x1", f"{b}.x1")
    h = F.least(f"{a}.y2", f"{b}.y2") - F.greatest(f"{a}.y1", f"{b}.y1")
    return w, h


def _area(a: str) -> Column:
    return (F.col(f"{a}.x2") - F.col(f"{a}.x1")) * (F.col(f"{a}.y2") - F.col(f"{a}.y1"))


def overlap_ratio(a: str, b: str) -> Column:
    """Shared area over the first box's area, which counts as 1 at least."""
    w, h = _corners(a, b)
    return F.when((w <= 0) | (h <= 0), 0.0).otherwise(w * h / F.greatest(F.lit(1.0), _area(a)))


def iou(a: str, b: str) -> Column:
    """Shared area over the area of both."""
    w, h = _corners(a, b)
    union = _area(a) + _area(b) - w * h
    return F.when((w < 0) | (h < 0) | (union <= 0), 0.0).otherwise(w * h / union)


def pairs(boxes: DataFrame) -> DataFrame:
    """Each two boxes of a page once, as structs ``a`` and ``b``."""
    one = boxes.select("page_id", F.struct("ord", *BOX).alias("a"))
    other = boxes.select("page_id", F.struct("ord", *BOX).alias("b"))
    return one.join(other, "page_id").filter(F.col("a.ord") < F.col("b.ord"))


def outside(lines: DataFrame, tables: DataFrame, most: float = 0.55) -> DataFrame:
    """Lines that no table of their page covers by more than ``most``."""
    a, b = lines.alias("a"), tables.alias("b")
    return a.join(b, (F.col("a.page_id") == F.col("b.page_id")) & (overlap_ratio("a", "b") > most), "left_anti")


def reading_order(boxes: DataFrame) -> DataFrame:
    w = Window.partitionBy("page_id").orderBy("y1", "x1", "ord")
    return boxes.withColumn("pos", F.row_number().over(w))


def column_order(boxes: DataFrame, width: float) -> DataFrame:
    """Left column before right where a page has two, else by bands of 12.
    In two columns, boxes in the middle are left out."""
    w = Window.partitionBy("page_id")
    mid = (F.col("x1") + F.col("x2")) / 2
    side = F.when(mid < width * 0.48, 0).when(mid >= width * 0.52, 1)
    rows = boxes.withColumn("_side", side)
    two = (F.sum((F.col("_side") == 0).cast("int")).over(w) >= 3) & (F.sum((F.col("_side") == 1).cast("int")).over(w) >= 3)
    rows = rows.withColumn("two", F.coalesce(two & (F.avg(F.col("x2") - F.col("x1")).over(w) < width * 0.42), F.lit(False)))
    rows = rows.filter(~F.col("two") | F.col("_side").isNotNull())
    band = F.when(F.col("two"), F.col("_side")).otherwise(F.bround(F.col("y1") / 12))
    order = [band, F.when(F.col("two"), F.col("y1")), F.col("x1"), F.col("y1"), F.col("ord")]
    return rows.withColumn("pos", F.row_number().over(w.orderBy(*order))).drop("_side")


def region_topk(boxes: DataFrame, k: int = 20) -> DataFrame:
    """The first ``k`` boxes of a page, then by area."""
    w = Window.partitionBy("page_id")
    rows = boxes.withColumn("_k", F.row_number().over(w.orderBy("ord"))).filter(F.col("_k") <= k).drop("_k")
    rows = rows.withColumn("area", (F.col("x2") - F.col("x1")) * (F.col("y2") - F.col("y1")))
    return rows.withColumn("pos", F.row_number().over(w.orderBy(F.desc("area"), "ord")))


def region_valid(width: float, height: float) -> Column:
    """Within the image, at least 10 by 8, neither too flat nor too tall."""
    w, h = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    inside = (F.col("x1") >= 0) & (F.col("y1") >= 0) & (F.col("x2") <= width) & (F.col("y2") <= height)
    return inside & (w >= 10) & (h >= 8) & (w >= 0.1 * h) & (w <= 50 * h)


def gap_cluster(points: DataFrame, key: str, value: str, gap: float = 5) -> DataFrame:
    """Clusters of sorted values no two neighbours of which are over ``gap``
    apart; the value is their mean, cut to a whole number."""
    w = Window.partitionBy(key).orderBy(value)
    new = F.coalesce((F.col(value) - F.lag(value).over(w) > gap).cast("int"), F.lit(1))
    rows = points.withColumn("_new", new).withColumn("cluster", F.sum("_new").over(w))  # equal values share a cluster
    return rows.groupBy(key, "cluster").agg(F.avg(value).cast("long").alias("center"), F.count(F.lit(1)).alias("n"))


def _sorted_boxes(boxes: DataFrame, *order: str) -> DataFrame:
    one = F.array_sort(F.collect_list(F.struct(*order)))
    return boxes.groupBy("page_id").agg(one.alias("boxes"))


def anchor_rows(boxes: DataFrame, most: float = 10) -> DataFrame:
    """``row`` of each box: a box over ``most`` from its row's first begins the
    next row.  Within a row boxes are sorted by x."""
    rows = _sorted_boxes(boxes, "y1", "x1", "ord")
    start = F.struct(F.lit(None).cast("double").alias("y"), F.lit(-1).alias("row"), F.array().cast("array<struct<row:int,ord:bigint,x1:double,y1:double>>").alias("out"))

    def step(acc: Column, b: Column) -> Column:
        new = acc["y"].isNull() | (F.abs(b["y1"] - acc["y"]) > most)
        row = acc["row"] + F.when(new, 1).otherwise(0)
        own = F.struct(row.alias("row"), b["ord"].alias("ord"), b["x1"].alias("x1"), b["y1"].alias("y1"))
        return F.struct(F.when(new, b["y1"]).otherwise(acc["y"]).alias("y"), row.alias("row"), F.concat(acc["out"], F.array(own)).alias("out"))

    found = rows.select("page_id", F.explode(F.aggregate("boxes", start, step, lambda a: a["out"])).alias("b")).select("page_id", "b.*")
    return found.withColumn("col", F.row_number().over(Window.partitionBy("page_id", "row").orderBy("x1", "y1", "ord")))


def merge_ocr_blocks(boxes: DataFrame) -> DataFrame:
    """Blocks of boxes in order: a box joins the block before it if it starts
    in the same column, a small gap below, and is about as wide."""
    rows = _sorted_boxes(boxes, "ord", *BOX)
    kind = "array<struct<x1:double,y1:double,x2:double,y2:double,n:int>>"

    def step(acc: Column, b: Column) -> Column:
        p = F.get(acc, F.size(acc) - 1)
        gap = b["y1"] - p["y2"]
        joins = (
            (F.abs(p["x1"] - b["x1"]) <= 24) & (gap >= 0) & (gap <= 10)
            & (F.abs((p["x2"] - p["x1"]) - (b["x2"] - b["x1"])) <= 80)
        )
        both = F.struct(
            F.least(p["x1"], b["x1"]).alias("x1"), F.least(p["y1"], b["y1"]).alias("y1"),
            F.greatest(p["x2"], b["x2"]).alias("x2"), F.greatest(p["y2"], b["y2"]).alias("y2"), (p["n"] + 1).alias("n"),
        )
        own = F.struct(*[b[c].alias(c) for c in BOX], F.lit(1).alias("n"))
        return F.when(F.coalesce(joins, F.lit(False)), F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(both))).otherwise(F.concat(acc, F.array(own)))

    blocks = F.aggregate("boxes", F.array().cast(kind), step)
    return rows.select("page_id", F.posexplode(blocks).alias("block", "b")).select("page_id", "block", "b.*")


def _iou(a: list, b: list):
    """``iou`` of boxes whose corners are numbers or arrays; a box without a
    corner overlaps none."""
    w, h = np.minimum(a[2], b[2]) - np.maximum(a[0], b[0]), np.minimum(a[3], b[3]) - np.maximum(a[1], b[1])
    both = w * h
    union = (a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - both
    return np.where((w >= 0) & (h >= 0) & (union > 0), both / np.where(union > 0, union, 1.0), 0.0)


#: Pages of up to so many boxes are folded together, step by step; a larger
#: page is folded alone.  Boxes that are folded at a time.
TOGETHER, AT_ONCE = 64, 1 << 18


def _steps(sizes: np.ndarray) -> Iterator[np.ndarray]:
    """Pages that are folded together, of about equal size."""
    order = np.argsort(sizes, kind="stable")
    at = 0
    while at < len(order):
        n = sizes[order[at]]
        most = n if n > TOGETHER else n + n // 8
        end = at + 1 if n > TOGETHER else min(int(np.searchsorted(sizes, most, "right", sorter=order)), at + AT_ONCE // max(1, int(most)))
        yield order[at:end]
        at = end


def _folded(rows: DataFrame, order: list[Column], together, alone) -> DataFrame:
    """``rows`` (page_id, ord, corners, conf) after a fold over each page's
    boxes in ``order``.

    ``alone`` maps the corners and conf of a page, as arrays, to the positions
    that stay and their new values; ``together`` does so for several pages, whose
    boxes are in columns and beyond a page's size are not ``there``, and gives
    what stays as a mask.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            offsets = batch.column(1).offsets.to_numpy().astype(np.int64)
            sizes, starts = np.diff(offsets), offsets[:-1] - offsets[0]
            parts = dict(zip((f.name for f in batch.column(1).type.value_type), batch.column(1).flatten().flatten()))
            values = [parts[c].to_numpy(zero_copy_only=False).astype(np.float64) for c in (*BOX, "conf")]
            stay = np.zeros(len(values[0]), bool)
            for pages in _steps(sizes):
                n = int(sizes[pages[-1]])
                if len(pages) == 1:
                    own = slice(int(starts[pages[0]]), int(starts[pages[0]]) + n)
                    kept, new = alone([v[own] for v in values])
                    at = own.start + kept
                else:
                    k = np.arange(n)[:, None]
                    there = k < sizes[pages][None, :]
                    place = np.where(there, starts[pages][None, :] + k, 0)
                    mask, new = together([v[place] for v in values], there)
                    at, new = place[mask], [x[mask] for x in new]
                stay[at] = True
                for v, x in zip(values, new):
                    v[at] = x
            kept = pa.array(np.flatnonzero(stay))
            page = pa.array(np.repeat(np.arange(len(sizes)), sizes)[stay])
            nulls = [parts[c].take(kept).is_null() for c in (*BOX, "conf")]
            made = [pc.if_else(no, None, pa.array(v[stay])) for v, no in zip(values, nulls)]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(page), parts["ord"].take(kept), *made], ["page_id", "ord", *BOX, "conf"])

    one = F.array_sort(F.collect_list(F.struct(*[c.alias(f"_{i}") for i, c in enumerate(order)], "ord", *BOX, "conf")))
    doubles = [T_.StructField(c, T_.DoubleType()) for c in (*BOX, "conf")]
    schema = T_.StructType([rows.schema["page_id"], rows.schema["ord"], *doubles])
    return rows.groupBy("page_id").agg(one.alias("boxes")).mapInArrow(run, schema)


def nms(boxes: DataFrame, most: float = 0.3) -> DataFrame:
    """Boxes by confidence, without those that overlap one kept before."""

    def together(b: list[np.ndarray], there: np.ndarray):
        left = there.copy()
        for i in range(len(left) - 1):
            left[i + 1 :] &= ~(left[i] & (_iou([x[i] for x in b], [x[i + 1 :] for x in b]) > most))
        return left, b

    def alone(b: list[np.ndarray]):
        left, kept = np.arange(len(b[0])), []
        while len(left):
            i, left = left[0], left[1:]
            kept.append(i)
            left = left[~(_iou([x[i] for x in b], [x[left] for x in b]) > most)]
        kept = np.array(kept, np.int64)
        return kept, [x[kept] for x in b]

    rows = boxes.select("page_id", "ord", *BOX, "conf")
    return _folded(rows, [F.col("conf").isNull(), -F.col("conf"), F.col("ord")], together, alone)


def region_merge(boxes: DataFrame, least: float = 0.3) -> DataFrame:
    """One pass over a page's boxes: each takes in the later ones that overlap
    it, growing as it does."""

    def takes(a: list, b: list):
        w, h = np.minimum(a[2], b[2]) - np.maximum(a[0], b[0]), np.minimum(a[3], b[3]) - np.maximum(a[1], b[1])
        return (w > 0) & (h > 0) & (_iou(a, b) >= least)

    def grown(a: list, b: list) -> list:
        return [np.minimum(a[0], b[0]), np.minimum(a[1], b[1]), np.maximum(a[2], b[2]), np.maximum(a[3], b[3]), np.where(b[4] > a[4], b[4], a[4])]

    def together(b: list[np.ndarray], there: np.ndarray):
        left = there.copy()
        for i in range(len(left) - 1):
            box = [x[i] for x in b]
            for j in range(i + 1, len(left)):
                other = [x[j] for x in b]
                joins = np.flatnonzero(left[i] & left[j] & takes(box, other))
                if len(joins):
                    for x, y in zip(box, grown([x[joins] for x in box], [x[joins] for x in other])):
                        x[joins] = y  # a view of the page's box
                    left[j, joins] = False
        return left, b

    def alone(b: list[np.ndarray]):
        left, kept, out = np.arange(len(b[0])), [], []
        while len(left):
            i, left = left[0], left[1:]
            box, stays, at = [x[i] for x in b], np.ones(len(left), bool), 0
            while at < len(left):
                joins = takes(box, [x[left[at:]] for x in b])
                k = int(joins.argmax())
                if not joins[k]:
                    break
                box = grown(box, [x[left[at + k]] for x in b])
                stays[at + k] = False
                at += k + 1
            kept.append(i)
            out.append(box)
            left = left[stays]
        return np.array(kept, np.int64), [np.array(x) for x in zip(*out)]

    rows = boxes.select("page_id", "ord", *BOX, "conf")
    return _folded(rows, [F.col("ord")], together, alone)


def text_layer(words: DataFrame, height: float, dpi: float = 150) -> DataFrame:
    """Where an invisible text goes on a page in points: the left lower corner
    of each word, counted from the page's lower edge, and a font of its height,
    6 at least.  Words without text are left out."""
    points = 72.0 / dpi
    rows = words.filter(F.coalesce("text", F.lit("")) != "")
    size = F.greatest(F.lit(6.0), (F.col("y2") - F.col("y1")) * points)
    return rows.withColumns({"x_pt": F.col("x1") * points, "y_pt": (F.lit(height) - F.col("y2")) * points, "font_pt": size})


def center(prefix: str = "") -> tuple[Column, Column]:
    """The whole-number centre of a box."""
    return tuple(F.floor((F.col(f"{prefix}{a}1") + F.col(f"{prefix}{a}2")) / 2) for a in "xy")


def profile_runs(profile: DataFrame, key: str, pos: str, value: str, least: int = 15) -> DataFrame:
    """Runs of positions whose value is above a tenth of the key's maximum; a
    run over ``least`` long, or the last up to the end, is a line."""
    w = Window.partitionBy(key)
    rows = profile.withColumn("_on", F.col(value) > F.max(value).over(w) * 0.1).withColumn("_end", F.max(pos).over(w) + 1)
    run = F.col(pos) - F.row_number().over(Window.partitionBy(key, "_on").orderBy(pos))
    rows = rows.withColumn("_run", run).filter("_on")
    found = rows.groupBy(key, "_run", "_end").agg(F.min(pos).alias("start"), (F.max(pos) + 1).alias("stop"))
    return found.filter((F.col("stop") - F.col("start") > least) | (F.col("stop") == F.col("_end"))).select(key, "start", "stop")


def page_bounds(blocks: DataFrame, width: float) -> DataFrame:
    """Left and right edge of a page's text: of wide blocks that are no titles,
    else of all."""
    wide = (F.col("kind") != "title") & (F.col("x2") - F.col("x1") >= width * 0.35)
    found = blocks.groupBy("page_id").agg(
        F.coalesce(F.min(F.when(wide, F.col("x1"))), F.min("x1")).alias("l"),
        F.coalesce(F.max(F.when(wide, F.col("x2"))), F.max("x2")).alias("r"),
    )
    empty = F.col("r") <= F.col("l")
    return found.select("page_id", F.when(empty, 0.0).otherwise(F.col("l")).alias("left_ref"), F.when(empty, width).otherwise(F.col("r")).alias("right_ref"))


def grid_cells(seps: DataFrame, width: float, height: float, least: float = 10) -> DataFrame:
    """Cells between the separators ``page_id, axis ('x' or 'y'), center`` and
    the edges; those under ``least`` in either direction are left out."""
    edges = seps.select("page_id").distinct().select("page_id", F.explode(F.expr(f"array(struct('x' axis, 0D center), struct('x' axis, {float(width)}D center), struct('y' axis, 0D center), struct('y' axis, {float(height)}D center))")).alias("e")).select("page_id", "e.*")
    rows = seps.select("page_id", "axis", F.col("center").cast("double").alias("center")).unionByName(edges)
    w = Window.partitionBy("page_id", "axis").orderBy("center")
    spans = rows.withColumn("to", F.lead("center").over(w)).withColumn("k", F.row_number().over(w) - 1).filter(F.col("to").isNotNull())
    xs = spans.filter("axis = 'x'").select("page_id", F.col("k").alias("col"), F.col("center").alias("x1"), F.col("to").alias("x2"))
    ys = spans.filter("axis = 'y'").select("page_id", F.col("k").alias("row"), F.col("center").alias("y1"), F.col("to").alias("y2"))
    cells = ys.join(xs, "page_id")
    return cells.filter((F.col("x2") - F.col("x1") >= least) & (F.col("y2") - F.col("y1") >= least))


def join_spans(spans: DataFrame) -> DataFrame:
    """A line's spans as one text, with a space where a gap between letters or
    digits is wide.  ``line_id, ord, text, x1, x2, size``."""
    w = Window.partitionBy("line_id").orderBy("ord")
    rows = spans.filter(F.col("text") != "")
    gap = F.col("x1") - F.lag("x2").over(w)
    word = r"[\p{L}\p{Nd}]"
    needs = (gap > F.greatest(F.lit(1.5), F.col("size") * 0.18)) & F.lag("text").over(w).rlike(f"{word}$") & F.col("text").rlike(f"^{word}")
    rows = rows.withColumn("piece", F.concat(F.when(needs, " ").otherwise(""), F.col("text")))
    one = F.array_sort(F.collect_list(F.struct("ord", "piece")))
    return rows.groupBy("line_id").agg(one.alias("p")).select("line_id", T.normalize(F.array_join(F.col("p.piece"), "")).alias("text"))


def centred(width: float, kind: str = "kind") -> Column:
    """If a title block stands in the middle of its page."""
    lines, text = T.lines("text"), T.strip("text")
    w = F.greatest(F.lit(1.0), F.col("x2") - F.col("x1"))
    shift = F.abs((F.col("x1") + F.col("x2")) / 2 - width / 2)
    margins = F.abs(F.col("x1") - F.greatest(F.lit(0.0), width - F.col("x2")))
    return (
        (F.col(kind) == "title") & (F.size(lines) >= 1) & (F.size(lines) <= 2) & (F.length(text) <= 140)
        & ~T.is_list("text") & ~T.ends_like_heading("text")
        & (w <= width * 0.72) & (shift <= width * 0.08) & (margins <= width * 0.12)
    )


def is_heading(width: float, kind: str = "kind") -> Column:
    text = T.strip("text")
    numbered = F.coalesce(F.get(T.lines("text"), F.lit(0)).rlike(V.NUMBERED), F.lit(False))
    by_form = (
        ((F.col("font_size") >= 15) & (F.length(text) <= 220))
        | (centred(width, kind) & (T.is_mostly_upper(text) | (F.col("font_size") >= 13)))
        | (numbered & (F.col("is_bold") | (F.col("font_size") >= 12)))
    )
    return (text != "") & ~T.is_list("text") & ~T.ends_like_heading("text") & by_form


def block_kind(width: float) -> Column:
    return F.when(T.is_list("text"), "list").when(is_heading(width), "title").otherwise("text")


def paragraph_alignment(width: float) -> Column:
    text = T.strip("text")
    return (
        F.when(text == "", "left").when(centred(width), "center").when(T.is_list("text"), "left")
        .when((F.length(text) >= 60) & ~T.ends_like_heading("text"), "justify").otherwise("left")
    )


def looks_like_title() -> Column:
    text = T.strip("text")
    numbered = text.rlike(r"^[0-9]+(?:[.)][0-9]*)*\s+")
    by_form = (F.col("font_size") >= 15) | (T.is_mostly_upper(text) & (F.length(text) <= 180)) | (F.col("is_bold") & (F.length(text) <= 80) & numbered)
    return (text != "") & ~text.rlike(V.LIST_ITEM) & ~T.ends_like_heading("text") & by_form


def content_points(axis: str) -> float:
    a, b, whole = ("left", "right", "width") if axis == "x" else ("top", "bottom", "height")
    return (V.PAGE_CM[whole] - V.PAGE_CM[a] - V.PAGE_CM[b]) * V.POINTS_PER_CM


def paragraph_geometry(blocks: DataFrame, width: float, height: float) -> DataFrame:
    """Indents and space before each block, in points, from its place on the
    page.  ``blocks`` has ``page_id, ord, x1, y1, x2, y2, text, kind,
    line_lefts, left_ref, right_ref``."""
    wide, tall = content_points("x"), content_points("y")

    def scaled(v: Column, whole: float, points: float) -> Column:
        return F.greatest(F.lit(0.0), v / whole) * points

    mid = centred(width)
    left = F.least(scaled(F.greatest(F.lit(0.0), F.col("x1") - F.col("left_ref")), width, wide), F.lit(wide * 0.35))
    right = F.least(scaled(F.greatest(F.lit(0.0), F.col("right_ref") - F.col("x2")), width, wide), F.lit(wide * 0.35))
    lefts = F.col("line_lefts")
    delta = F.get(lefts, F.lit(0)) - F.array_min(F.slice(lefts, 2, F.greatest(F.size(lefts) - 1, F.lit(0))))
    flat = (F.col("kind") == "title") | T.is_list("text") | (F.size(lefts) < 2) | (F.abs(delta) < width * 0.01)
    first = F.greatest(F.lit(-wide * 0.12), F.least(F.lit(wide * 0.12), scaled(delta, width, wide)))
    gap = F.greatest(F.lit(0.0), F.col("y1") - F.lag("y2").over(Window.partitionBy("page_id").orderBy("ord")))
    return blocks.select(
        "page_id", "ord",
        F.when(mid, 0.0).otherwise(left).alias("left_indent"),
        F.when(mid, 0.0).otherwise(right).alias("right_indent"),
        F.when(F.coalesce(flat, F.lit(True)), 0.0).otherwise(first).alias("first_indent"),
        F.coalesce(F.least(F.lit(18.0), scaled(gap, height, tall) * 0.85), F.lit(0.0)).alias("space_before"),
    )


def _list_item(text: str) -> bool:
    return bool(re.match(V.LIST_ITEM, text))


@lru_cache(maxsize=4096)
def _form(text: str | None) -> tuple:
    """What the merge asks of a line's text: if it has any, begins as a list
    item, has one, if its last line is one, is numbered, ends like no heading,
    ends like a sentence; its length, blanks before and blanks after."""
    text = text or ""
    bare = text.strip()
    own = [x.strip() for x in bare.split("\n") if x.strip()]
    if not own:
        return False, False, False, False, False, False, False, len(text), 0, 0
    numbered = bool(re.match(V.NUMBERED, own[0]))
    ends = bare.endswith(tuple(V.HEADING_STOPS)), own[-1].endswith(tuple(V.SENTENCE_ENDS))
    before = len(text) - len(text.lstrip())
    return True, _list_item(bare), any(map(_list_item, own)), _list_item(own[-1]), numbered, *ends, len(text), before, len(text) - before - len(bare)


class _Block:
    """The lines of a page merged so far into one block."""

    __slots__ = ("texts", "x1", "y1", "x2", "y2", "size", "bold", "left", "last", "items", "first", "n")

    def __init__(self, line: tuple, form: tuple):
        self.y1, self.x1, _, self.x2, self.y2, text, self.size, self.bold = line
        self.texts, self.n, self.items = [text], form[7], form[2]
        self.first, self.last, self.left = form, (form, self.x1, self.x2), self.x1

    def heading(self) -> bool:
        form = self.last[0]
        if not form[0] or self.items or form[5]:
            return False
        if self.size >= 15 and self.n - self.first[8] - form[9] <= 220:
            return True
        return self.first[4] and (self.bold or self.size >= 12)

    def joins(self, line: tuple, form: tuple, width: float) -> bool:
        y1, x1, _, x2, y2, _, size, bold = line
        last, x1_before, x2_before = self.last
        if not last[0] or not form[0] or last[3] or form[1] or self.heading():
            return False
        if not form[2] and not form[5] and ((size >= 15 and form[7] - form[8] - form[9] <= 220) or (form[4] and (bold or size >= 12))):
            return False
        if y1 - self.y2 > max(5.0, min(self.size, size) * 0.9):
            return False
        if abs(x1 - self.left) > max(14.0, width * 0.025) or abs(self.size - size) > 1.6:
            return False
        narrow = (x2_before - x1_before) / max(1.0, width) < 0.58
        return not (last[6] and narrow)

    def add(self, line: tuple, form: tuple) -> None:
        y1, x1, _, x2, y2, text, size, bold = line
        self.texts.append(text)
        self.x1, self.y1, self.x2, self.y2 = min(self.x1, x1), min(self.y1, y1), max(self.x2, x2), max(self.y2, y2)
        self.size, self.bold, self.left = max(self.size, size), self.bold and bold, min(self.left, x1)
        self.last, self.items, self.n = (form, x1, x2), self.items or form[2], self.n + 1 + form[7]


def merge_lines(lines: DataFrame, width: float) -> DataFrame:
    """Blocks of a page's lines: a line joins the block before it unless a
    list, a heading, a gap, an indent, a font or a sentence's end parts them.

    ``lines`` has ``page_id, ord, x1, y1, x2, y2, text, font_size, is_bold``.
    What counts is the block merged so far, so a page is one row; what it asks
    of a block is kept as lines join, so a block costs as much as its lines.
    """
    columns = ["y1", "x1", "ord", "x2", "y2", "text", "font_size", "is_bold"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            offsets = batch.column(1).offsets.to_numpy()
            fields = dict(zip((f.name for f in batch.column(1).type.value_type), batch.column(1).flatten().flatten()))
            rows = list(zip(*[fields[c].to_pylist() for c in columns]))
            pages, numbers, blocks = [], [], []
            for page, at in enumerate((offsets - offsets[0])[:-1].tolist()):
                block, first = None, len(blocks)
                for line in rows[at : at + int(offsets[page + 1] - offsets[page])]:
                    form = _form(line[5]) if len(line[5] or "") < 256 else _form.__wrapped__(line[5])  # no long text is remembered
                    if block is not None and block.joins(line, form, width):
                        block.add(line, form)
                    else:
                        block = _Block(line, form)
                        blocks.append(block)
                pages += [page] * (len(blocks) - first)
                numbers += range(len(blocks) - first)
            made = [pa.array([getattr(b, c) for b in blocks], pa.float64()) for c in BOX]
            text = pa.array([b.texts[0] if len(b.texts) == 1 else "\n".join(b.texts) for b in blocks], pa.string())
            size, bold = pa.array([b.size for b in blocks], pa.float64()), pa.array([b.bold for b in blocks], pa.bool_())
            kind = pa.array(["list" if b.items else "title" if b.heading() else "text" for b in blocks], pa.string())
            count = pa.array([len(b.texts) for b in blocks], pa.int64())
            own = [batch.column(0).take(pa.array(pages, pa.int64())), pa.array(numbers, pa.int64()), *made, text, size, bold, kind, count]
            yield pa.RecordBatch.from_arrays(own, ["page_id", "block", *BOX, "text", "font_size", "is_bold", "kind", "n_lines"])

    one = F.array_sort(F.collect_list(F.struct(*columns)))
    kind = lines.schema["page_id"].dataType.simpleString()
    schema = f"page_id {kind}, block long, x1 double, y1 double, x2 double, y2 double, text string, font_size double, is_bold boolean, kind string, n_lines long"
    return lines.groupBy("page_id").agg(one.alias("lines")).mapInArrow(run, schema)

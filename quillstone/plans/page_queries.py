"""Queries on candidates, boxes, tables, pages and logits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillstone.functions import text as T
from quillstone.functions import udf
from quillstone.functions import values as V
from quillstone.operators import convert, ctc, layout, pages, tables, vote
from quillstone.plans import sql as S
from quillstone.plans import views
from quillstone.plans.sql import q
from quillstone.plans.views import HEIGHT, WIDTH, with_views

QUERIES: dict = {}
ORACLES: dict = {}


def _add(name: str, run, sql: str | None = None) -> None:
    QUERIES[name] = run
    if sql:
        ORACLES[name] = sql


# Votes.
_C = with_views("cands")
_TOP = "row_number() OVER (PARTITION BY image_id ORDER BY {})"


def _first(order: str, cols: str, src: str = "cands_v") -> str:
    return f"SELECT {cols} FROM (SELECT *, {_TOP.format(order)} AS rk FROM {src}) r WHERE rk = 1"


_len = f"length({S.strip('text')})"
_bad = f"({_len} = 0 OR {S.artifact('text')})"
_add("vote_best", lambda s, d: vote.best(views.candidates(s, d)), _C + _first("confidence DESC, ord", "image_id, ord, engine, text, confidence, 1.0::DOUBLE AS consensus"))
_add(
    "vote_weighted",
    lambda s, d: vote.weighted(views.candidates(s, d)).withColumn("mean_conf", F.round("mean_conf", 6)),
    _C + _first(f"bad, CASE WHEN NOT bad THEN confidence END DESC NULLS LAST, {_len} DESC, ord", "image_id, engine, text, round(mean_conf, 6) AS mean_conf", f"(SELECT *, {_bad} AS bad, avg(confidence) OVER (PARTITION BY image_id) AS mean_conf FROM cands_v) b"),
)
_add(
    "vote_majority_exact",
    lambda s, d: vote.majority_exact(views.candidates(s, d)),
    _C + f"SELECT image_id, t AS text, votes FROM (SELECT *, {_TOP.format('votes DESC, fo')} AS rk FROM (SELECT image_id, {S.strip('text')} AS t, count(*) AS votes, min(ord) AS fo FROM cands_v WHERE NOT {S.artifact('text')} GROUP BY 1, 2 HAVING count(*) >= 2) v) r WHERE rk = 1",
)
_add("vote_majority", lambda s, d: vote.majority(views.candidates(s, d)))
_add("consensus", lambda s, d: vote.consensus(views.candidates(s, d)).withColumn("consensus", F.round("consensus", 6)))
_add("low_consensus", lambda s, d: vote.low_consensus(views.candidates(s, d)).select("image_id", "low"))
_add("select_best", lambda s, d: vote.select_best(views.candidates(s, d)), _C + _first("confidence DESC, length(text) DESC, ord", "image_id, ord, engine, text, confidence"))
_hall = f"(({_len} < 3 AND confidence < 0.95) OR {S.hallucinates(S.strip('text'))})"
_add(
    "hallucination_filter",
    lambda s, d: vote.drop_hallucinations(views.candidates(s, d)),
    _C + f"SELECT image_id, ord, engine, text, confidence FROM (SELECT *, bool_and(bad) OVER (PARTITION BY image_id) AS none_left, row_number() OVER (PARTITION BY image_id ORDER BY {_len} DESC, ord) AS lg FROM (SELECT *, {_hall} AS bad FROM cands_v) a) b WHERE NOT bad OR (none_left AND lg = 1)",
)
from quillstone.plans.text_queries import _line, _variant  # noqa: E402

_add(
    "engine_wins",
    lambda s, d: vote.engine_wins(views.candidates(s, d)),
    _C + "SELECT engine, count(*) AS wins FROM (" + _first("s DESC, ord", "*", f"(SELECT *, {_line} AS s FROM cands_v) z") + ") w GROUP BY engine",
)
_valid = f"coalesce(length({S.strip('text')}) >= 2 AND NOT {S.any_of('lower(text)', V.VARIANT_GARBAGE)} AND length({S.letters('text')}) / nullif(length(replace(text, ' ', '')), 0) > 0.6, FALSE)"
_add(
    "variant_best",
    lambda s, d: vote.variant_best(views.candidates(s, d)),
    _C + _first("ok DESC, CASE WHEN ok THEN s END DESC NULLS LAST, length(text) DESC, ord", "image_id, engine, text, confidence", f"(SELECT *, {_valid} AS ok, {_variant} AS s FROM cands_v) z"),
)
_add("engine_subset", lambda s, d: vote.only(views.candidates(s, d), ["easyocr", "paddleocr"]).select("image_id", "engine"), _C + "SELECT image_id, engine FROM cands_v WHERE engine IN ('easyocr', 'paddleocr')")
_add("mean_conf", lambda s, d: views.candidates(s, d).groupBy("engine").agg(F.round(F.avg("confidence"), 6).alias("mean_conf")), _C + "SELECT engine, round(avg(confidence), 6) AS mean_conf FROM cands_v GROUP BY engine")


def _cascade(s: SparkSession, d: str) -> DataFrame:
    stages = [("paddleocr", F.length("text") > 20), ("easyocr", (F.col("confidence") > 0.6) & (F.length("text") > 20)), ("tesseract", T.is_vietnamese("text")), ("paddleocr", F.lit(True))]
    return vote.cascade_choose(views.candidates(s, d), stages).select("image_id", "engine", "stage")


from quillstone.plans.text_queries import _shout, _vi  # noqa: E402

_isvi = f"(length(text) >= 3 AND NOT ({_shout}) AND ({_vi} OR {S.any_of('lower(text)', V.GATE_WORDS)} OR length(text) > 20))"
_stage = f"CASE WHEN engine = 'paddleocr' AND length(text) > 20 THEN 0 WHEN engine = 'easyocr' AND confidence > 0.6 AND length(text) > 20 THEN 1 WHEN engine = 'tesseract' AND {_isvi} THEN 2 WHEN engine = 'paddleocr' THEN 3 END"
_add("cascade_choose", _cascade, _C + _first("stage, ord", "image_id, engine, stage", f"(SELECT *, {_stage} AS stage FROM cands_v) z WHERE stage IS NOT NULL"))
_add(
    "fallback_first",
    lambda s, d: vote.fallback_first(views.candidates(s, d).filter(F.col("ord") + F.col("image_id") % 2 >= 1)),
    _C + f"SELECT i.image_id, engine, text FROM (SELECT DISTINCT image_id FROM cands_v WHERE ord + image_id % 2 >= 1) i LEFT JOIN ({_first('ord', 'image_id, engine, text', '(SELECT * FROM cands_v WHERE ord + image_id % 2 >= 1) c ' + 'WHERE ' + S.strip('text') + " <> ''")}) f USING (image_id)",
)


def _aligned(s: SparkSession, d: str) -> DataFrame:
    c = views.candidates(s, d)
    a, b = (c.filter(F.col("ord") == k).select("image_id", F.col("text").alias(n)) for k, n in ((0, "a"), (1, "b")))
    return a.join(b, "image_id").select("image_id", udf.align_words("a", "b").alias("aligned"))


_add("align_words", _aligned)
_add("fuse_words", lambda s, d: vote.fuse(views.candidates(s, d)))
_add("fuse_chars", lambda s, d: vote.fuse(views.candidates(s, d), True))

# Boxes.
_B = with_views("boxes")
_PAIR = "boxes_v a JOIN boxes_v b ON a.page_id = b.page_id AND a.ord < b.ord"


def _ratios(s: SparkSession, d: str) -> DataFrame:
    return layout.pairs(views.boxes(s, d)).select("page_id", F.col("a.ord").alias("i"), F.col("b.ord").alias("j"), F.round(layout.overlap_ratio("a", "b"), 6).alias("ratio")).filter("ratio > 0")


def _ious(s: SparkSession, d: str) -> DataFrame:
    return layout.pairs(views.boxes(s, d)).select("page_id", F.col("a.ord").alias("i"), F.col("b.ord").alias("j"), F.round(layout.iou("a", "b"), 6).alias("iou")).filter("iou > 0")


_add("overlap_ratio", _ratios, _B + f"SELECT * FROM (SELECT a.page_id, a.ord AS i, b.ord AS j, round({S.ratio('a', 'b')}, 6) AS ratio FROM {_PAIR}) z WHERE ratio > 0")
_add("iou_pairs", _ious, _B + f"SELECT * FROM (SELECT a.page_id, a.ord AS i, b.ord AS j, round({S.iou('a', 'b')}, 6) AS iou FROM {_PAIR}) z WHERE iou > 0")


def _outside(s: SparkSession, d: str) -> DataFrame:
    b = views.boxes(s, d)
    return layout.outside(b.filter("ord % 4 <> 0"), b.filter("ord % 4 = 0")).select("page_id", "ord")


_add("line_not_in_table", _outside, _B + f"SELECT page_id, ord FROM boxes_v a WHERE ord % 4 <> 0 AND NOT EXISTS (SELECT 1 FROM boxes_v b WHERE b.page_id = a.page_id AND b.ord % 4 = 0 AND {S.ratio('a', 'b')} > 0.55)")
_add("reading_order", lambda s, d: layout.reading_order(views.boxes(s, d)).select("page_id", "ord", F.col("pos").cast("long").alias("pos")), _B + "SELECT page_id, ord, row_number() OVER (PARTITION BY page_id ORDER BY y1, x1, ord) AS pos FROM boxes_v")
_side = f"CASE WHEN (x1 + x2) / 2 < {WIDTH * 0.48} THEN 0 WHEN (x1 + x2) / 2 >= {WIDTH * 0.52} THEN 1 END"
_add(
    "column_order",
    lambda s, d: layout.column_order(views.boxes(s, d), WIDTH).select("page_id", "ord", "two", F.col("pos").cast("long").alias("pos")),
    _B + f"SELECT page_id, ord, two, row_number() OVER (PARTITION BY page_id ORDER BY CASE WHEN two THEN side ELSE round_even(y1 / 12, 0) END, CASE WHEN two THEN y1 END, x1, y1, ord) AS pos FROM (SELECT *, coalesce(sum((side = 0)::INT) OVER w >= 3 AND sum((side = 1)::INT) OVER w >= 3 AND avg(x2 - x1) OVER w < {WIDTH * 0.42}, FALSE) AS two FROM (SELECT *, {_side} AS side FROM boxes_v) s WINDOW w AS (PARTITION BY page_id)) t WHERE NOT two OR side IS NOT NULL",
)
_add(
    "region_topk",
    lambda s, d: layout.region_topk(views.boxes(s, d), 10).select("page_id", "ord", "area", F.col("pos").cast("long").alias("pos")),
    _B + "SELECT page_id, ord, (x2 - x1) * (y2 - y1) AS area, row_number() OVER (PARTITION BY page_id ORDER BY (x2 - x1) * (y2 - y1) DESC, ord) AS pos FROM boxes_v WHERE ord <= 10",
)
_add("box_filter", lambda s, d: views.boxes(s, d).filter("x2 - x1 >= 50 AND y2 - y1 >= 20").select("page_id", "ord"), _B + "SELECT page_id, ord FROM boxes_v WHERE x2 - x1 >= 50 AND y2 - y1 >= 20")
_add("region_valid", lambda s, d: views.boxes(s, d).select("page_id", "ord", layout.region_valid(500.0, 600.0).alias("valid")), _B + "SELECT page_id, ord, (x1 >= 0 AND y1 >= 0 AND x2 <= 500 AND y2 <= 600 AND x2 - x1 >= 10 AND y2 - y1 >= 8 AND x2 - x1 >= 0.1 * (y2 - y1) AND x2 - x1 <= 50 * (y2 - y1)) AS valid FROM boxes_v")
_gaps = "SELECT page_id, {v} AS v, sum(CASE WHEN {v} - lag_v > 5 OR lag_v IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY page_id ORDER BY {v}) AS cluster FROM (SELECT page_id, {v}, lag({v}) OVER (PARTITION BY page_id ORDER BY {v}) AS lag_v FROM boxes_v) g"
_add(
    "gap_cluster",
    lambda s, d: layout.gap_cluster(views.boxes(s, d), "page_id", "y1").select("page_id", F.col("cluster").cast("long").alias("cluster"), "center", "n"),
    _B + f"SELECT page_id, CAST(cluster AS BIGINT) AS cluster, CAST(floor(avg(v)) AS BIGINT) AS center, count(*) AS n FROM ({_gaps.format(v='y1')}) c GROUP BY 1, 2",
)
_add(
    "anchor_rows",
    lambda s, d: layout.anchor_rows(views.boxes(s, d)).select("page_id", "ord", "row", F.col("col").cast("long").alias("col")),
    "WITH RECURSIVE boxes_v AS (" + views.SQL["boxes"] + "), o AS (SELECT page_id, ord, x1, y1, row_number() OVER (PARTITION BY page_id ORDER BY y1, x1, ord) AS k FROM boxes_v), "
    "f AS (SELECT page_id, ord, x1, y1, k, 0 AS row, y1 AS anchor FROM o WHERE k = 1 UNION ALL SELECT o.page_id, o.ord, o.x1, o.y1, o.k, f.row + CASE WHEN abs(o.y1 - f.anchor) > 10 THEN 1 ELSE 0 END, CASE WHEN abs(o.y1 - f.anchor) > 10 THEN o.y1 ELSE f.anchor END FROM f JOIN o ON o.page_id = f.page_id AND o.k = f.k + 1) "
    "SELECT page_id, ord, row, row_number() OVER (PARTITION BY page_id, row ORDER BY x1, y1, ord) AS col FROM f",
)
_add(
    "merge_ocr_blocks",
    lambda s, d: layout.merge_ocr_blocks(views.boxes(s, d)),
    "WITH RECURSIVE boxes_v AS (" + views.SQL["boxes"] + "), f AS (SELECT page_id, ord, 0 AS block, x1, y1, x2, y2, 1 AS n FROM boxes_v WHERE ord = 1 UNION ALL "
    "SELECT page_id, ord, block + CASE WHEN j THEN 0 ELSE 1 END, CASE WHEN j THEN least(px1, x1) ELSE x1 END, CASE WHEN j THEN least(py1, y1) ELSE y1 END, CASE WHEN j THEN greatest(px2, x2) ELSE x2 END, CASE WHEN j THEN greatest(py2, y2) ELSE y2 END, CASE WHEN j THEN n + 1 ELSE 1 END FROM "
    "(SELECT b.*, f.block, f.x1 AS px1, f.y1 AS py1, f.x2 AS px2, f.y2 AS py2, f.n, (abs(f.x1 - b.x1) <= 24 AND b.y1 - f.y2 BETWEEN 0 AND 10 AND abs((f.x2 - f.x1) - (b.x2 - b.x1)) <= 80) AS j FROM f JOIN boxes_v b ON b.page_id = f.page_id AND b.ord = f.ord + 1) z) "
    "SELECT page_id, block, x1, y1, x2, y2, n FROM (SELECT *, row_number() OVER (PARTITION BY page_id, block ORDER BY ord DESC) AS rk FROM f) l WHERE rk = 1",
)
_apart = f"len(list_filter(acc, lambda a: list_transform([x[1]], lambda b: {S.iou('a', 'b')})[1] > 0.3)) = 0"
_add(
    "nms",
    lambda s, d: layout.nms(views.boxes(s, d)).select("page_id", "ord"),
    _B + f"SELECT page_id, unnest(kept).ord AS ord FROM (SELECT page_id, list_reduce(l, lambda acc, x: CASE WHEN {_apart} THEN list_concat(acc, x) ELSE acc END) AS kept FROM (SELECT page_id, list([bx] ORDER BY bx.conf DESC, bx.ord) AS l FROM (SELECT page_id, {{'ord': ord, 'x1': x1, 'y1': y1, 'x2': x2, 'y2': y2, 'conf': conf}} AS bx FROM boxes_v) z GROUP BY page_id) y) k",
)
_add("region_merge", lambda s, d: layout.region_merge(views.boxes(s, d)))


def _profile(s: SparkSession, d: str) -> DataFrame:
    """Each document's lengths of lines as a profile."""
    return views.lines(s, d).select("doc_id", "line_no", F.length("text").alias("v"))


_add(
    "profile_runs",
    lambda s, d: layout.profile_runs(_profile(s, d), "doc_id", "line_no", "v", 2),
    with_views("lines") + "SELECT doc_id, start, stop FROM (SELECT doc_id, e, min(line_no) AS start, max(line_no) + 1 AS stop FROM (SELECT *, line_no - row_number() OVER (PARTITION BY doc_id, o ORDER BY line_no) AS run FROM (SELECT doc_id, line_no, length(text) > max(length(text)) OVER (PARTITION BY doc_id) * 0.1 AS o, max(line_no) OVER (PARTITION BY doc_id) + 1 AS e FROM lines_v) a) b WHERE o GROUP BY doc_id, e, run) c WHERE stop - start > 2 OR stop = e",
)
_K = with_views("blocks")
_centre = f"(kind = 'title' AND len({S.lines('text')}) BETWEEN 1 AND 2 AND length({S.strip('text')}) <= 140 AND NOT ({S.is_list('text')}) AND NOT {S.ends_heading('text')} AND greatest(1.0, x2 - x1) <= {WIDTH * 0.72} AND abs((x1 + x2) / 2 - {WIDTH / 2}) <= {WIDTH * 0.08} AND abs(x1 - greatest(0.0, {WIDTH} - x2)) <= {WIDTH * 0.12})"
_numbered = f"coalesce(regexp_matches({S.lines('text')}[1], {q(V.NUMBERED)}), FALSE)"
_heading = f"({S.strip('text')} <> '' AND NOT ({S.is_list('text')}) AND NOT {S.ends_heading('text')} AND ((font_size >= 15 AND length({S.strip('text')}) <= 220) OR ({_centre} AND ({S.mostly_upper(S.strip('text'))} OR font_size >= 13)) OR ({_numbered} AND (is_bold OR font_size >= 12))))"
_add("block_kind", lambda s, d: views.blocks(s, d).select("page_id", "ord", layout.block_kind(WIDTH).alias("block_kind")), _K + f"SELECT page_id, ord, CASE WHEN {S.is_list('text')} THEN 'list' WHEN {_heading} THEN 'title' ELSE 'text' END AS block_kind FROM blocks_v")
_add(
    "para_align",
    lambda s, d: views.blocks(s, d).select("page_id", "ord", layout.paragraph_alignment(WIDTH).alias("align")),
    _K + f"SELECT page_id, ord, CASE WHEN {S.strip('text')} = '' THEN 'left' WHEN {_centre} THEN 'center' WHEN {S.is_list('text')} THEN 'left' WHEN length({S.strip('text')}) >= 60 AND NOT {S.ends_heading('text')} THEN 'justify' ELSE 'left' END AS align FROM blocks_v",
)
_tt = S.strip("text")
_add(
    "looks_like_title",
    lambda s, d: views.blocks(s, d).select("page_id", "ord", layout.looks_like_title().alias("title")),
    _K + f"SELECT page_id, ord, ({_tt} <> '' AND NOT regexp_matches({_tt}, {q(V.LIST_ITEM)}) AND NOT {S.ends_heading('text')} AND (font_size >= 15 OR ({S.mostly_upper(_tt)} AND length({_tt}) <= 180) OR (is_bold AND length({_tt}) <= 80 AND regexp_matches({_tt}, '^[0-9]+(?:[.)][0-9]*)*\\s+')))) AS title FROM blocks_v",
)
_bounds = f"SELECT page_id, CASE WHEN r <= l THEN 0.0 ELSE l END AS left_ref, CASE WHEN r <= l THEN {WIDTH} ELSE r END AS right_ref FROM (SELECT page_id, coalesce(min(x1) FILTER (WHERE kind <> 'title' AND x2 - x1 >= {WIDTH * 0.15}), min(x1)) AS l, coalesce(max(x2) FILTER (WHERE kind <> 'title' AND x2 - x1 >= {WIDTH * 0.15}), max(x2)) AS r FROM blocks_v GROUP BY page_id) z"
_add(
    "page_bounds",
    lambda s, d: layout.page_bounds(views.blocks(s, d), WIDTH).select("page_id", "left_ref", "right_ref"),
    _K + _bounds.replace(str(WIDTH * 0.15), str(WIDTH * 0.35)),
)


def _geometry(s: SparkSession, d: str) -> DataFrame:
    b = views.blocks(s, d)
    made = layout.paragraph_geometry(b.join(layout.page_bounds(b, WIDTH), "page_id"), WIDTH, HEIGHT)
    return made.select("page_id", "ord", *[F.round(c, 4).alias(c) for c in ("left_indent", "right_indent", "first_indent", "space_before")])


_wx, _hy = layout.content_points("x"), layout.content_points("y")
_add(
    "para_geometry",
    _geometry,
    _K + f", bounds AS ({_bounds.replace(str(WIDTH * 0.15), str(WIDTH * 0.35))}) SELECT page_id, ord, round(CASE WHEN {_centre} THEN 0.0 ELSE least(greatest(0.0, greatest(0.0, x1 - left_ref) / {WIDTH}) * {_wx}, {_wx * 0.35}) END, 4) AS left_indent, "
    f"round(CASE WHEN {_centre} THEN 0.0 ELSE least(greatest(0.0, greatest(0.0, right_ref - x2) / {WIDTH}) * {_wx}, {_wx * 0.35}) END, 4) AS right_indent, "
    f"round(CASE WHEN kind = 'title' OR {S.is_list('text')} OR abs(line_lefts[1] - list_min(line_lefts[2:])) < {WIDTH * 0.01} THEN 0.0 ELSE greatest({-_wx * 0.12}, least({_wx * 0.12}, greatest(0.0, (line_lefts[1] - list_min(line_lefts[2:])) / {WIDTH}) * {_wx})) END, 4) AS first_indent, "
    f"round(coalesce(least(18.0, greatest(0.0, greatest(0.0, y1 - lag(y2) OVER (PARTITION BY page_id ORDER BY ord)) / {HEIGHT}) * {_hy} * 0.85), 0.0), 4) AS space_before FROM blocks_v JOIN bounds USING (page_id)",
)
_add(
    "join_spans",
    lambda s, d: layout.join_spans(views.spans(s, d)),
    with_views("spans") + r"SELECT line_id, " + S.normalize("string_agg(piece, '' ORDER BY ord)") + r" AS text FROM (SELECT line_id, ord, CASE WHEN x1 - lag(x2) OVER w > greatest(1.5, size * 0.18) AND regexp_matches(lag(text) OVER w, '[\p{L}\p{Nd}]$') AND regexp_matches(text, '^[\p{L}\p{Nd}]') THEN ' ' || text ELSE text END AS piece FROM spans_v WHERE text <> '' WINDOW w AS (PARTITION BY line_id ORDER BY ord)) p GROUP BY line_id",
)
_add(
    "text_layer",
    lambda s, d: layout.text_layer(views.blocks(s, d), HEIGHT).select("page_id", "ord", *[F.round(c, 6).alias(c) for c in ("x_pt", "y_pt", "font_pt")]),
    _K + f"SELECT page_id, ord, round(x1 * {72.0 / 150}, 6) AS x_pt, round(({HEIGHT} - y2) * {72.0 / 150}, 6) AS y_pt, round(greatest(6.0, (y2 - y1) * {72.0 / 150}), 6) AS font_pt FROM blocks_v WHERE text <> ''",
)
_add("box_center", lambda s, d: views.boxes(s, d).select("page_id", "ord", *[c.alias(n) for c, n in zip(layout.center(), ("cx", "cy"))]), _B + "SELECT page_id, ord, CAST(floor((x1 + x2) / 2) AS BIGINT) AS cx, CAST(floor((y1 + y2) / 2) AS BIGINT) AS cy FROM boxes_v")
_add("merge_lines", lambda s, d: layout.merge_lines(views.blocks(s, d).drop("line_lefts"), WIDTH))


def _separators(s: SparkSession, d: str) -> DataFrame:
    b = views.boxes(s, d)
    both = [layout.gap_cluster(b, "page_id", v).select("page_id", F.lit(a).alias("axis"), "center") for a, v in (("x", "x1"), ("y", "y1"))]
    return both[0].unionByName(both[1]).filter("center > 0")


_seps = " UNION ALL ".join(f"SELECT page_id, '{a}' AS axis, CAST(floor(avg(v)) AS DOUBLE) AS center FROM ({_gaps.format(v=v)}) c{a} GROUP BY page_id, cluster HAVING floor(avg(v)) > 0" for a, v in (("x", "x1"), ("y", "y1")))
_edges = f"SELECT DISTINCT page_id, unnest(['x', 'x', 'y', 'y']) AS axis, unnest([0.0, {WIDTH}, 0.0, {HEIGHT}])::DOUBLE AS center FROM boxes_v"
_add(
    "grid_cells",
    lambda s, d: layout.grid_cells(_separators(s, d), WIDTH, HEIGHT).select("page_id", F.col("row").cast("long").alias("row"), F.col("col").cast("long").alias("col"), "x1", "y1", "x2", "y2"),
    _B + f", seps AS ({_seps}), alls AS (SELECT * FROM seps UNION ALL {_edges}), sp AS (SELECT *, lead(center) OVER w AS nxt, row_number() OVER w - 1 AS k FROM alls WINDOW w AS (PARTITION BY page_id, axis ORDER BY center)) SELECT y.page_id, y.k AS row, x.k AS col, x.center AS x1, y.center AS y1, x.nxt AS x2, y.nxt AS y2 FROM sp y JOIN sp x ON x.page_id = y.page_id AND x.axis = 'x' AND y.axis = 'y' WHERE x.nxt - x.center >= 10 AND y.nxt - y.center >= 10",
)


def _cells_of(s: SparkSession, d: str) -> DataFrame:
    """Each row of a page with its cells, as many as it has, by their columns."""
    found = layout.anchor_rows(views.boxes(s, d)).groupBy("page_id", "row").agg(F.array_sort(F.collect_list(F.struct("col", "ord"))).alias("c"))
    return found.select("page_id", "row", F.array_join(F.transform("c", lambda c: F.concat_ws(":", c["col"], c["ord"])), ",").alias("cells"))


_add(
    "cell_grid",
    _cells_of,
    ORACLES["anchor_rows"].replace("SELECT page_id, ord, row, row_number()", "SELECT page_id, row, string_agg(col || ':' || ord, ',' ORDER BY col) AS cells FROM (SELECT page_id, ord, row, row_number()") + ") z GROUP BY page_id, row",
)


def _tables(s: SparkSession, d: str) -> DataFrame:
    """Boxes as tables on a page; every box comes twice."""
    b = views.boxes(s, d).select("page_id", "ord", *[(F.col(c) + 0.25).alias(c) for c in layout.BOX], (F.col("ord") % 3).alias("n_rows"), F.lit(2).alias("n_cols"))
    return b.unionByName(b.withColumn("ord", F.col("ord") + 1000))


_TAB = "SELECT page_id, ord, x1 + 0.25 AS x1, y1 + 0.25 AS y1, x2 + 0.25 AS x2, y2 + 0.25 AS y2, ord % 3 AS n_rows, 2 AS n_cols FROM boxes_v"
_add(
    "table_dedupe",
    lambda s, d: tables.dedupe_tables(_tables(s, d)).select("page_id", "ord"),
    _B + f"SELECT page_id, ord FROM (SELECT *, row_number() OVER (PARTITION BY page_id, round_even(x1, 1), round_even(y1, 1), round_even(x2, 1), round_even(y2, 1), n_rows, n_cols ORDER BY ord) AS k FROM ({_TAB} UNION ALL SELECT page_id, ord + 1000, x1, y1, x2, y2, n_rows, n_cols FROM ({_TAB}) a) u) z WHERE k = 1",
)

# Tables in text.
_low = f"lower({S.strip('text')})"
_wl = f"len({S.words('text')})"
_tline = (
    f"(NOT (regexp_matches({_tt}, '^[-•*]') OR length({_tt}) < 2 OR ({_wl} = 1 AND length({_tt}) > 20) OR {_wl} > 25 OR {_wl} < 1) AND ({S.any_of(_low, V.LINE_KEYWORDS)} OR {S.any_of(_low, V.PLACES)} OR {S.any_of(_low, V.JOBS)} "
    rf"OR regexp_matches({_tt}, '\p{{Nd}}') OR ({_wl} <= 2 AND regexp_matches({_tt}, '^\p{{Lu}}')) OR {_wl} BETWEEN 2 AND 10))"
)
_add("is_table_line", lambda s, d: views.lines(s, d).select("doc_id", "line_no", tables.is_table_line("text").alias("result")), with_views("lines") + f"SELECT doc_id, line_no, {_tline} AS result FROM lines_v")


def _mixed(s: SparkSession, d: str) -> DataFrame:
    """Whole texts with each fourth word on a line of its own, and a table."""
    t = F.regexp_replace(F.col("text"), r"(\S+ \S+ \S+) ", "$1\n")
    return views.docs(s, d).select("doc_id", F.concat(t, F.lit("\nA 1\nA 1\nB 2\nTên  Số\n1 Hà Nội\n\nthe end")).alias("text"))


_MIX = r"SELECT doc_id, regexp_replace(text, '(\S+ \S+ \S+) ', '\1' || chr(10), 'g') || chr(10) || array_to_string(['A 1', 'A 1', 'B 2', 'Tên  Số', '1 Hà Nội', '', 'the end'], chr(10)) AS text FROM documents"
_para = f"SELECT doc_id, para, generate_subscripts(l, 1) - 1 AS k, unnest(l) AS text FROM (SELECT doc_id, para, {S.lines('p')} AS l FROM (SELECT doc_id, CAST(generate_subscripts(p, 1) - 1 AS INTEGER) AS para, unnest(p) AS p FROM (SELECT doc_id, str_split(text, chr(10)||chr(10)) AS p FROM ({_MIX}) mx) a) b) c WHERE len(l) >= 3"
_run = "PARTITION BY doc_id, para, run"
_isl = f"SELECT * FROM (SELECT *, count(*) OVER ({_run}) AS cnt, CAST(min(k) OVER ({_run}) AS INTEGER) AS first_line, CAST(sum(length(text)) OVER ({_run}) AS DOUBLE) / count(*) OVER ({_run}) AS mean, lag(text, 1) OVER w AS p1, lag(text, 2) OVER w AS p2, lag(text, 3) OVER w AS p3 FROM (SELECT *, k - row_number() OVER (PARTITION BY doc_id, para, tl ORDER BY k) AS run FROM (SELECT *, {_tline} AS tl FROM ({_para}) d) e) f WHERE tl WINDOW w AS ({_run} ORDER BY k)) g WHERE cnt >= 3"
_a = S.words("text")


def _repeats(prev: str) -> str:
    b = S.words(prev)
    return f"coalesce({S.strip('text')} = {S.strip(prev)} OR (len({_a}) > 0 AND len({_a}) <= len({b}) AND (contains({S.join(b)}, {S.join(_a)}) OR len(list_filter({_a}, lambda w: list_contains({b}, w))) >= greatest(2, len({_a}) - 1))), FALSE)"


_rep = " OR ".join(map(_repeats, ("p1", "p2", "p3")))
_islands = f"SELECT doc_id, para, first_line, any_value(mean) AS mean, count(*) AS n, string_agg(text, chr(10) ORDER BY k) AS j, count(*) FILTER (WHERE length(text) >= mean * 0.4 AND length(text) <= mean * 1.6) AS near, count(*) FILTER (WHERE len({_a}) BETWEEN 2 AND 10) AS cols, string_agg(text, chr(10) ORDER BY k) FILTER (WHERE NOT ({_rep})) AS cleaned, count(*) FILTER (WHERE NOT ({_rep})) AS kept FROM ({_isl}) i GROUP BY doc_id, para, first_line"
_add(
    "table_islands",
    lambda s, d: tables.table_islands(_mixed(s, d)).select("doc_id", "para", "first_line", F.array_join("lines", "\n").alias("block")),
    f"SELECT doc_id, para, first_line, string_agg(text, chr(10) ORDER BY k) AS block FROM ({_isl}) i GROUP BY doc_id, para, first_line",
)
_hdr = " + ".join(f"contains(lower(j), {q(k)})::INT" for k in V.HEADER_KEYWORDS)
_num = "len(regexp_extract_all(lower(j), '[0-9]+'))"
_block = f"(n >= 2 AND (({_hdr}) >= 2 OR (near >= n * 0.5 AND mean < 200) OR cols >= n * 0.6 OR ({_num} > 0 AND {_num} / greatest(1, len({S.words('j')})) BETWEEN 0.15 AND 0.8 AND n >= 3)))"
_add(
    "is_table_block",
    lambda s, d: tables.table_islands(_mixed(s, d)).select("doc_id", "para", "first_line", tables.is_table_block("lines").alias("result")),
    f"SELECT doc_id, para, first_line, {_block} AS result FROM ({_islands}) g",
)
_add(
    "table_row_dedupe",
    lambda s, d: tables.table_islands(_mixed(s, d)).select("doc_id", "para", "first_line", F.array_join(tables.clean_block("lines"), "\n").alias("block")),
    f"SELECT doc_id, para, first_line, cleaned AS block FROM ({_islands}) g",
)
_add(
    "find_tables",
    lambda s, d: tables.find_tables(_mixed(s, d)).select("doc_id", "para", F.col("index").cast("long").alias("index"), "table_text"),
    f"SELECT doc_id, para, row_number() OVER (PARTITION BY doc_id, para ORDER BY first_line) - 1 AS index, cleaned AS table_text FROM ({_islands}) g WHERE {_block} AND kept >= 3",
)


def _located(s: SparkSession, d: str, fn) -> DataFrame:
    m = _mixed(s, d)
    return tables.with_tables(m, tables.find_tables(m)).select("doc_id", fn("text", "tables").alias("found"))


_add("table_locate", lambda s, d: _located(s, d, tables.locate_tables))
_add("segment_text", lambda s, d: _located(s, d, tables.segment_text))

_T = with_views("texts")
_cells = rf"list_filter(list_transform({S.lines('text')}, lambda x: list_filter(list_transform(regexp_split_to_array(x, '\s{{2,}}|\t'), lambda v: {S.strip('v')}), lambda v: v <> '')), lambda r: len(r) > 0)"
_R = _T + f", p AS (SELECT doc_id, text, {_cells} AS r FROM texts_v) "


def _parsed(s: SparkSession, d: str) -> DataFrame:
    return views.table_texts(s, d).withColumn("r", tables.parse_rows("text"))


_add("table_text", lambda s, d: views.table_texts(s, d).select("doc_id", tables.tabbed("text").alias("result")), _T + rf"SELECT doc_id, array_to_string(list_transform({S.lines('text')}, lambda x: regexp_replace(x, '\s{{2,}}', chr(9), 'g')), chr(10)) AS result FROM texts_v")
_add(
    "table_parse",
    lambda s, d: _parsed(s, d).select("doc_id", F.size("r").alias("n_rows"), tables.tsv("r").alias("tsv"), tables.parse_kind("text").alias("kind")),
    _R + "SELECT doc_id, CAST(len(r) AS INTEGER) AS n_rows, array_to_string(list_transform(r, lambda x: array_to_string(x, chr(9))), chr(10)) AS tsv, CASE WHEN len(r) = 0 THEN 'empty' WHEN len(r) > 1 AND len(list_distinct(list_transform(r, lambda x: len(x)))) <= 2 AND len(r[1]) > 1 THEN 'structured' ELSE 'list' END AS kind FROM p",
)
def _vertical(s: SparkSession, d: str) -> DataFrame:
    """Each table with one cell a line."""
    t = views.table_texts(s, d).select("doc_id", F.regexp_replace("text", r" {2,}", "\n").alias("text"))
    return t.select("doc_id", tables.tsv(tables.vertical_rows("text")).alias("tsv"), F.size(tables.parse("text")).alias("n_rows"))


_add("table_vertical", _vertical)
_add("table_tsv", lambda s, d: _parsed(s, d).select("doc_id", tables.tsv("r").alias("tsv")), _R + "SELECT doc_id, array_to_string(list_transform(r, lambda x: array_to_string(x, chr(9))), chr(10)) AS tsv FROM p")
_add("table_csv", lambda s, d: _parsed(s, d).select("doc_id", tables.csv_text("r").alias("csv")), _R + "SELECT doc_id, array_to_string(list_transform(r, lambda x: array_to_string(x, ',')), chr(13)||chr(10)) AS csv FROM p")


def _ragged(s: SparkSession, d: str) -> DataFrame:
    r = F.transform(F.col("r"), lambda x, i: F.when(i % 3 == 1, F.slice(x, 1, 2)).when(i % 3 == 2, F.array(F.lit("  "), F.lit(""))).otherwise(F.array(F.get(x, F.lit(0)), F.lit(" "), F.get(x, F.lit(2)), F.lit(None))))
    return _parsed(s, d).select("doc_id", r.alias("r"))


_RAG = "list_transform(range(1, len(r) + 1), lambda i: CASE (i - 1) % 3 WHEN 1 THEN r[i][1:2] WHEN 2 THEN ['  ', ''] ELSE [r[i][1], ' ', r[i][3], NULL] END)"
_cl = f"list_filter(list_transform({_RAG}, lambda x: list_transform(x, lambda v: {S.normalize('coalesce(v, ' + q('') + ')')})), lambda x: len(list_filter(x, lambda v: v <> '')) > 0)"
_add(
    "table_compact",
    lambda s, d: _ragged(s, d).select("doc_id", tables.tsv(tables.compact("r")).alias("tsv")),
    _R + f", cl AS (SELECT doc_id, {_cl} AS c FROM p), kc AS (SELECT doc_id, c, list_filter(range(1, 5), lambda i: len(list_filter(c, lambda x: coalesce(x[i], '') <> '')) > 0) AS kp FROM cl) SELECT doc_id, array_to_string(list_transform(c, lambda x: array_to_string(list_transform(kp, lambda i: coalesce(x[i], '')), chr(9))), chr(10)) AS tsv FROM kc",
)
_wd = "list_transform(range(1, len(r[1]) + 1), lambda i: list_max(list_transform(r, lambda x: length(coalesce(x[i], '')))) + {})"
_W0, _W2 = _R + f", s AS (SELECT *, {_wd.format(0)} AS w FROM p) ", _R + f", s AS (SELECT *, {_wd.format(2)} AS w FROM p) "
_ix = "range(1, len(w) + 1)"


def _rule(a: str, m: str, b: str) -> str:
    return f"'{a}' || array_to_string(list_transform(w, lambda n: repeat('─', n)), '{m}') || '{b}'"


def _mid(v: str, n: str) -> str:
    left = f"(({n} - length({v})) // 2 + CASE WHEN ({n} - length({v})) % 2 = 1 AND {n} % 2 = 1 THEN 1 ELSE 0 END)"
    return f"repeat(' ', {left}) || {v} || repeat(' ', {n} - length({v}) - {left})"


_v, _n = "coalesce(x[i], '')", "w[i]"
_cellmid = f"'│' || array_to_string(list_transform({_ix}, lambda i: {_mid(_v, _n)}), '│') || '│'"
_cellleft = f"'│' || array_to_string(list_transform({_ix}, lambda i: ' ' || {_v} || repeat(' ', {_n} - 1 - length({_v}))), '│') || '│'"
_add("fmt_markdown", lambda s, d: _parsed(s, d).select("doc_id", tables.as_markdown("r").alias("result")), _R + "SELECT doc_id, array_to_string(list_concat(['| ' || array_to_string(r[1], ' | ') || ' |', '|' || repeat('---|', len(r[1]))], list_transform(r[2:], lambda x: '| ' || array_to_string(x, ' | ') || ' |')), chr(10)) AS result FROM p")
_add("fmt_simple", lambda s, d: _parsed(s, d).select("doc_id", tables.as_simple("r").alias("result")), _W0 + f"SELECT doc_id, array_to_string(list_transform(r, lambda x: array_to_string(list_transform({_ix}, lambda i: {_v} || repeat(' ', {_n} - length({_v}))), '  ')), chr(10)) AS result FROM s")
_add("fmt_grid", lambda s, d: _parsed(s, d).select("doc_id", tables.as_grid("r").alias("result")), _W2 + f"SELECT doc_id, {_rule('┌', '┬', '┐')} || chr(10) || array_to_string(list_transform(range(1, len(r) + 1), lambda k: list_transform([r[k]], lambda x: {_cellmid})[1] || CASE WHEN k < len(r) THEN chr(10) || {_rule('├', '┼', '┤')} ELSE '' END), chr(10)) || chr(10) || {_rule('└', '┴', '┘')} AS result FROM s")
_add(
    "fmt_box",
    lambda s, d: _parsed(s, d).select("doc_id", tables.as_box("r").alias("result")),
    _W2 + f"SELECT doc_id, array_to_string(list_concat(list_concat([{_rule('┌', '┬', '┐')}], list_concat(list_transform(r[1:1], lambda x: {_cellmid}), [{_rule('├', '┼', '┤')}])), list_concat(list_transform(r[2:], lambda x: {_cellleft}), [{_rule('└', '┴', '┘')}])), chr(10)) AS result FROM s",
)


def _esc(x: str) -> str:
    return f"replace(replace({x}, '<', '&lt;'), '>', '&gt;')"


_th = f"array_to_string(list_transform(r[1], lambda v: '      <th style=\"{tables._TH}\">' || {_esc('v')} || '</th>' || chr(10)), '')"
_td = f"array_to_string(list_transform(r[i], lambda v: '      <td style=\"{tables._TD}\">' || {_esc('v')} || '</td>' || chr(10)), '')"
_add(
    "fmt_html",
    lambda s, d: _parsed(s, d).select("doc_id", tables.as_html("r").alias("result")),
    _R + "SELECT doc_id, replace('<table style=\"" + tables._TABLE + "\">~" + tables._HEAD.replace("\n", "~") + "', '~', chr(10)) || " + _th + " || replace('    </tr>~  </thead>~  <tbody>~', '~', chr(10)) || array_to_string(list_transform(range(2, len(r) + 1), lambda i: "
    "'    <tr style=\"background-color: ' || CASE WHEN (i - 1) % 2 = 0 THEN '#f9f9f9' ELSE 'white' END || ';\">' || chr(10) || " + _td + " || '    </tr>' || chr(10)), '') || replace('  </tbody>~</table>', '~', chr(10)) AS result FROM p",
)


def _appended(s: SparkSession, d: str) -> DataFrame:
    t = views.table_texts(s, d)
    return tables.append_tables(t, t.filter("doc_id % 2 = 0").select("doc_id", F.lit(0).alias("page"), F.lit(0).alias("index"), F.col("text").alias("table_text")))


_simple = f"array_to_string(list_transform(r, lambda x: array_to_string(list_transform({_ix}, lambda i: {_v} || repeat(' ', {_n} - length({_v}))), '  ')), chr(10))"
_eq, _nl = "repeat('=', 60)", "chr(10)"
_add(
    "append_tables",
    _appended,
    _W0 + f"SELECT doc_id, text || CASE WHEN doc_id % 2 = 0 THEN {_nl}||{_nl}||{_eq}||{_nl}||'📊 EXTRACTED TABLES'||{_nl}||{_eq}||{_nl}||{_nl}||'--- PAGE 1 ---'||{_nl}||{_nl}||'📋 Table 1:'||{_nl}||repeat('-', 40)||{_nl}||{_simple}||{_nl} ELSE '' END AS text FROM s",
)

# Logits.
_L = with_views("logits")


def _path(row: str) -> str:
    return f"list_transform({row}, lambda s: CAST(list_position(s, list_max(s)) - 1 AS INTEGER))"


def _collapse(p: str) -> str:
    return f"list_transform(list_filter(range(1, len({p}) + 1), lambda i: {p}[i] <> 0 AND (i = 1 OR {p}[i] <> {p}[i - 1])), lambda i: {p}[i])"


_floored = "list_transform(m, lambda s: list_transform(s, lambda x: greatest(CAST(x AS DOUBLE), 1e-12::DOUBLE)))"
_add("ctc_greedy", lambda s, d: views.logits(s, d).select("vec_id", F.array_join(ctc.greedy("m"), ",").alias("classes")), _L + f"SELECT vec_id, {S.join(_collapse('p'), q(','))} AS classes FROM (SELECT vec_id, {_path('m')} AS p FROM logits_v) z")
_add("ctc_beam", lambda s, d: views.logits(s, d).select("vec_id", F.array_join(ctc.beam("m"), ",").alias("classes")), _L + f"SELECT vec_id, {S.join(_collapse('p'), q(','))} AS classes FROM (SELECT vec_id, {_path(_floored)} AS p FROM logits_v) z")
_add("ctc_lm", lambda s, d: ctc.lm(views.logits(s, d), ctc.softmax("m")).select("vec_id", "text"))

# Pages and reports.
_P = with_views("pages")
_add("page_range", lambda s, d: pages.page_range(views.pages(s, d), 1, 3).select("doc_id", "line_no", "page_num"), _P + "SELECT doc_id, line_no, page_num FROM pages_v WHERE page_num > 1 AND page_num <= 3")
_add(
    "page_assemble",
    lambda s, d: pages.assemble(views.pages(s, d).select("doc_id", "page_num", "ord", F.col("text").alias("val")), True),
    _P + f"SELECT doc_id, string_agg('=== PAGE ' || page_num || ' ===' || chr(10) || t, chr(10)||chr(10) ORDER BY page_num) AS text FROM (SELECT doc_id, page_num, coalesce(string_agg(CASE WHEN {S.strip('text')} <> '' THEN text END, chr(10) ORDER BY ord), '[No text recognized]') AS t FROM pages_v GROUP BY doc_id, page_num) z GROUP BY doc_id",
)


def _texted(s: SparkSession, d: str) -> DataFrame:
    p = views.pages(s, d).withColumn("y1", ((F.col("ord") * 7 + 3) % 5).cast("double")).withColumn("val", F.col("text"))
    return pages.pages_to_text(p.filter("ord <> 1"), p.filter("ord = 1"))


_add(
    "pages_to_text",
    _texted,
    _P + f"SELECT doc_id, string_agg({S.strip('text')}, chr(10)||chr(10) ORDER BY page_num, (ord * 7 + 3) % 5, CASE WHEN ord = 1 THEN 1 ELSE 0 END, ord) AS text FROM pages_v WHERE {S.strip('text')} <> '' GROUP BY doc_id",
)
_add(
    "doc_summary",
    lambda s, d: pages.doc_summary(views.pages(s, d).groupBy("doc_id", "page_num").agg((F.max(F.length("text")) < 60).alias("used_ocr"), F.count_if(F.col("text").rlike("[0-9]")).alias("n_tables"))),
    _P + "SELECT doc_id, count(*) AS pages, count(*) FILTER (WHERE used_ocr) AS ocr_pages, CAST(sum(n_tables) AS BIGINT) AS tables, CASE WHEN count(*) FILTER (WHERE used_ocr) > 0 THEN 'hybrid' ELSE 'direct' END AS method FROM (SELECT doc_id, page_num, max(length(text)) < 60 AS used_ocr, count(*) FILTER (WHERE regexp_matches(text, '[0-9]')) AS n_tables FROM pages_v GROUP BY doc_id, page_num) z GROUP BY doc_id",
)
_add(
    "batch_report",
    lambda s, d: pages.batch_report(views.candidates(s, d).withColumn("file", F.concat("engine", F.lit(".png"))), "image_id", "ord"),
    _C + "SELECT image_id, string_agg('=== ' || engine || '.png ===' || chr(10) || text, chr(10)||chr(10) ORDER BY ord) AS report FROM cands_v GROUP BY image_id",
)


def _docx(s: SparkSession, d: str) -> DataFrame:
    """Paragraphs first, then tables, whatever their order in the document."""
    p = views.pages(s, d).withColumn("k", (F.col("line_no") % 3 == 0).cast("int"))
    return pages.ordered_text(p, "doc_id", ["k", "line_no"], "text", "\n")


_add("docx_text_order", _docx, _P + f"SELECT doc_id, string_agg({S.strip('text')}, chr(10) ORDER BY (line_no % 3 = 0)::INT, line_no) AS text FROM pages_v WHERE {S.strip('text')} <> '' GROUP BY doc_id")



def _converted(s: SparkSession, d: str) -> DataFrame:
    """Every document's lines set on pages of forty and converted."""
    p = views.lines(s, d)
    y = ((F.col("line_no") % 40) * 14).cast("double")
    rows = p.select(
        "doc_id", F.floor(F.col("line_no") / 40).alias("page_num"), F.col("line_no").alias("ord"), F.lit(50.0).alias("x1"), y.alias("y1"),
        (F.lit(50.0) + F.least(F.length("text"), F.lit(90)) * 6).alias("x2"), (y + 11).alias("y2"), "text", F.lit(11.0).alias("font_size"), F.lit(False).alias("is_bold"),
    )
    return convert.convert(rows, rows, WIDTH)[0]


_add("convert", _converted)

from quillstone.streaming.history import windowed  # noqa: E402

_add(
    "history_windows",
    lambda s, d: windowed(views.history(s, d)).withColumn("mean_conf", F.round("mean_conf", 9)),
    with_views("history") + "SELECT date_trunc('day', ts)::TIMESTAMP AS window_start, engine, count(*) AS n, round(avg(confidence), 9) AS mean_conf FROM history_v GROUP BY 1, 2",
)

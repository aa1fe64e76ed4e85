"""Queries on cleaning, correcting, gating and scoring texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.functions import score as SC
from quillstone.functions import text as T
from quillstone.functions import udf
from quillstone.functions import values as V
from quillstone.operators import pages, rules
from quillstone.plans import sql as S
from quillstone.plans import views
from quillstone.plans.sql import q
from quillstone.plans.views import with_views
from quillstone.sources import labels

QUERIES: dict = {}
ORACLES: dict = {}


def _add(name: str, run, sql: str | None = None) -> None:
    QUERIES[name] = run
    if sql:
        ORACLES[name] = sql


def _scalar(name: str, made, sql: str | None, view=views.lines, table: str = "lines", keys: tuple = ("doc_id", "line_no"), out: str = "result") -> None:
    """A query that maps the text of each row of a view."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return view(spark, sf_dir).select(*keys, made("text").alias(out))

    listed = ", ".join(keys)
    _add(name, run, with_views(table) + f"SELECT {listed}, {sql} AS {out} FROM {table}_v" if sql else None)


_DOC = {"view": views.docs, "table": "docs", "keys": ("doc_id",)}
_GARBLED = {"view": views.garbled, "table": "garbled", "keys": ("doc_id",)}
_CAND = {"view": views.candidates, "table": "cands", "keys": ("image_id", "ord")}

# Cleaning and correcting.
_scalar("normalize_text", T.normalize, S.normalize("text"), **_DOC)
_scalar("clean_cell", T.clean_cell, S.normalize("coalesce(text, '')"))
_scalar("line_clean", T.line_clean, S.join(S.lines("text"), "chr(10)"), **_DOC)
_scalar("dehyphenate", T.dehyphenate, S.strip(f"replace(replace({S.join(S.lines('text'), 'chr(10)')}, '-'||chr(10), ''), chr(10), ' ')"), **_DOC)
_scalar("bench_normalize", lambda c: T.benchmark_form(udf.nfc(F.col(c))), S.strip(rf"regexp_replace({S.join(S.lines('nfc_normalize(text)'), 'chr(10)')}, '\s+', ' ', 'g')"), **_DOC)
_scalar("char_confusion", T.char_confusion, S.chain("text", V.CONFUSIONS))
_scalar("phrase_merge", T.phrase_merge, S.phrases("text"))
_scalar("restore_exact", T.restore_exact, S.restore_exact("text"))
_scalar("restore_prefix", T.restore_prefix, S.restore_prefix("text"))
_scalar("postprocess", T.postprocess, S.strip(rf"regexp_replace({S.restore_exact(S.phrases(S.chain('text', V.CONFUSIONS)))}, '\s+', ' ', 'g')"))
_spaced = S.strip(r"regexp_replace(text, '\s+', ' ', 'g')")
_no_space = rf"regexp_replace({_spaced}, '\s+([,.!?;:])', '\1', 'g')"
# without lookahead: a mark that another character follows gets a space, twice
# as marks may follow each other
_after = rf"regexp_replace(regexp_replace({_no_space}, '([,.!?;:])([^\s])', '\1 \2', 'g'), '([,.!?;:])([^\s])', '\1 \2', 'g')"
_scalar("punct_spacing", T.punct_spacing, _after)
_parts = r"regexp_extract_all(text, '[^.!?]+|[.!?]\s*')"
_sentence = f"CASE WHEN regexp_matches(p, '^[.!?]') OR {S.strip('p')} = '' THEN p ELSE {S.upper_first(S.strip('p'))} END"
_scalar("capitalize", T.capitalize, S.join(f"list_transform({_parts}, lambda p: {_sentence})", "''"))
_scalar("vocab_encode", T.vocab_encode, f"list_filter(list_transform(list_filter(str_split(lower(text), ''), lambda c: c <> ''), lambda c: CAST(instr({q(V.ALPHABET)}, c) AS INTEGER)), lambda i: i > 0)")

# Predicates.
_scalar("mostly_upper", T.is_mostly_upper, S.mostly_upper("text"))
_scalar("is_garbage", T.is_garbage, S.garbage("text"))
_scalar("hallucination", T.hallucinates, S.hallucinates("text"))
_vi = f"{S.count_in('lower(text)', V.VIETNAMESE_LOWER)} > 0"
_shout = rf"regexp_matches(text, '\p{{Lu}}') AND NOT regexp_matches(text, '\p{{Ll}}') AND NOT {_vi}"
_scalar("is_vi_text", T.is_vietnamese, f"(length(text) >= 3 AND NOT ({_shout}) AND ({_vi} OR {S.any_of('lower(text)', V.GATE_WORDS)} OR length(text) > 20))")
_scalar(
    "is_vi_valid",
    T.is_valid_variant,
    f"coalesce(length({S.strip('text')}) >= 2 AND NOT {S.any_of('lower(text)', V.VARIANT_GARBAGE)} AND length({S.letters('text')}) / nullif(length(replace(text, ' ', '')), 0) > 0.6, FALSE)",
)


# Scores.
def _quality(view):
    return lambda spark, sf_dir: view(spark, sf_dir).select("doc_id", F.round(SC.text_quality("text"), 6).alias("quality"))


_add("text_quality", _quality(views.docs), with_views("docs") + f"SELECT doc_id, round(quality, 6) AS quality FROM ({S.quality('docs_v')}) z")
_add("text_quality_garbled", _quality(views.garbled), with_views("garbled") + f"SELECT doc_id, round(quality, 6) AS quality FROM ({S.quality('garbled_v')}) z")


def _scored(name: str, made, sql: str) -> None:
    _scalar(name, lambda c: F.round(made(c, "confidence"), 6), f"round({sql}, 6)", **_CAND, out="score")


_n, _t = "length(tt)", S.strip("text")
_share = f"({S.count_in(_t, S.ALL_VI)} / greatest(length({_t}), 1))"
_line = (
    f"CASE WHEN {S.garbage(_t)} THEN -1000.0 WHEN confidence < 0.2 THEN -500.0 ELSE CAST("
    f"CASE WHEN length({_t}) < 3 THEN -20 WHEN length({_t}) < 5 THEN length({_t}) ELSE least(length({_t}), 50) * 2 END + confidence * 50"
    f" + CASE WHEN {_share} >= 0.05 AND {_share} <= 0.6 THEN {S.count_in(_t, S.ALL_VI)} * 5 WHEN {_share} > 0.8 THEN -20 ELSE 0 END"
    f" + CASE WHEN {S.distinct_chars(_t)} < length({_t}) / 3 THEN -40 ELSE 0 END + CASE WHEN contains({_t}, ' ') THEN 10 ELSE 0 END AS DOUBLE) END"
)
_scored("line_score", SC.line_score, _line)
_ratio = f"({S.letters('text')})"
_alpha = f"(length({S.letters('text')}) / greatest(length(text), 1))"
_dense = "length(replace(text, ' ', ''))"
_vis = (
    f"CASE WHEN coalesce(text, '') = '' THEN -1000.0 ELSE CAST(confidence * 20 + {S.count_in('text', S.ALL_VI)} * 5"
    f" + CASE WHEN {_dense} BETWEEN 10 AND 100 THEN {_dense} * 0.5 WHEN {_dense} < 5 THEN -20 ELSE 0 END"
    f" + CASE WHEN contains(text, ' ') AND len({S.words('text')}) BETWEEN 2 AND 20 THEN len({S.words('text')}) * 3 ELSE 0 END"
    f" + CASE WHEN {_alpha} > 0.7 THEN 15 WHEN {_alpha} < 0.4 THEN -30 ELSE 0 END"
    + "".join(f" - CASE WHEN contains(lower(text), {q(g)}) THEN 100 ELSE 0 END" for g in V.GARBAGE)
    + f" - CASE WHEN {S.distinct_chars('lower(text)')} / greatest(length(text), 1) < 0.3 THEN 50 ELSE 0 END AS DOUBLE) END"
)
_scored("vi_score", SC.vi_score, _vis)
_variant = (
    f"confidence + {S.count_in('lower(text)', V.VIETNAMESE_LOWER)} * 0.05 + CASE WHEN length(text) BETWEEN 5 AND 200 THEN 0.1 ELSE 0.0 END"
    f" + CASE WHEN contains(text, ' ') THEN 0.1 ELSE 0.0 END - CASE WHEN {_alpha} < 0.5 THEN 0.2 ELSE 0.0 END"
)
_scored("variant_score", SC.variant_score, f"CAST({_variant} AS DOUBLE)")
_w = S.words("lower(text)")
_known = f"len(list_filter({_w}, lambda w: list_contains({S.listed(V.MODEL_WORDS)}, w)))"
_scalar(
    "lm_confidence",
    lambda c: F.round(SC.lm_confidence(c), 6),
    f"round(CASE WHEN len({_w}) > 0 THEN CAST({_known} / len({_w}) * 0.6 + {S.count_in('lower(text)', V.VIETNAMESE_LOWER)} / length(text) * 0.4 AS DOUBLE) ELSE 0.0::DOUBLE END, 6)",
    **_GARBLED,
)
_add(
    "pseudo_conf",
    lambda spark, sf_dir: views.candidates(spark, sf_dir).select("image_id", "ord", F.round(SC.pseudo_confidence("text", F.when(F.col("ord") == 0, "vietocr").when(F.col("ord") == 1, "trocr").otherwise("crnn")), 6).alias("conf")),
    with_views("cands") + "SELECT image_id, ord, round(CAST(CASE ord WHEN 0 THEN least(0.95, 0.75 + length(text) / 100) WHEN 1 THEN least(0.90, 0.70 + length(text) / 100) ELSE 0.65 END AS DOUBLE), 6) AS conf FROM cands_v",
)


# Edit distances line by line, without marks: DuckDB counts bytes.
def _plain(c: str):
    return F.regexp_replace(F.lower(F.col(c)), "[^a-z ]", "")


def _cased(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = views.lines(spark, sf_dir)
    return d.select("doc_id", "line_no", _plain("text").alias("a"), F.replace(_plain("text"), F.lit("e"), F.lit("o")).alias("b"))


_PLAIN = f"SELECT doc_id, line_no, a, replace(a, 'e', 'o') AS b FROM (SELECT doc_id, line_no, regexp_replace(lower(text), '[^a-z ]', '', 'g') AS a FROM ({views.SQL['lines']}) l0) p0"
_add("levenshtein", lambda s, d: _cased(s, d).select("doc_id", "line_no", F.levenshtein("a", "b").cast("long").alias("distance")), f"SELECT doc_id, line_no, levenshtein(a, b) AS distance FROM ({_PLAIN}) p")
_add("cer", lambda s, d: _cased(s, d).select("doc_id", "line_no", F.round(SC.cer("b", "a"), 6).alias("cer")), f"SELECT doc_id, line_no, round(CASE WHEN length(a) = 0 THEN CASE WHEN length(b) > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END ELSE levenshtein(b, a) / length(a) END, 6) AS cer FROM ({_PLAIN}) p")
_wa, _wb = S.words("a"), S.words("b")
_add("wer_compat", lambda s, d: _cased(s, d).select("doc_id", "line_no", F.round(SC.wer_compat("b", "a"), 6).alias("wer")), f"SELECT doc_id, line_no, round(CASE WHEN len({_wa}) = 0 THEN CASE WHEN len({_wb}) > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END ELSE levenshtein({S.join(_wb)}, {S.join(_wa)}) / len({_wa}) END, 6) AS wer FROM ({_PLAIN}) p")
_add("similarity", lambda s, d: _cased(s, d).select("doc_id", "line_no", F.round(udf.similarity("a", "b"), 6).alias("ratio")))


# Words against word lists.
def _words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.docs(spark, sf_dir).select(F.explode(F.filter(F.split(_plain("text"), " "), lambda w: F.length(w) >= 2)).alias("word"))


_WORDS = "SELECT DISTINCT word FROM (SELECT unnest(str_split(a, ' ')) AS word FROM (SELECT regexp_replace(lower(text), '[^a-z ]', '', 'g') AS a FROM documents) p0) p1 WHERE length(word) >= 2"
#: Known words without marks.
PLAIN_WORDS = ["and", "been", "con", "estand", "for", "gia", "mente", "nay", "other", "sao", "thanes", "there", "tion", "und", "vers", "with"]
_LIST = f"SELECT unnest({S.listed(PLAIN_WORDS)}) AS known"
_chars = "list_distinct(str_split({}, ''))"
_jac = f"len(list_intersect({_chars.format('word')}, {_chars.format('known')})) / len(list_distinct(list_concat({_chars.format('word')}, {_chars.format('known')})))"
_rank = "row_number() OVER (PARTITION BY word ORDER BY s DESC, known)"
_add(
    "suggest_jaccard",
    lambda s, d: rules.suggest(_words(s, d), PLAIN_WORDS).select("word", "known", F.col("rank").cast("long").alias("rank"), F.round("s", 6).alias("s")),
    f"SELECT word, known, rank, round(s, 6) AS s FROM (SELECT *, {_rank} AS rank FROM (SELECT word, known, {_jac} AS s FROM ({_WORDS}) w, ({_LIST}) k) x WHERE s > 0.7) y WHERE rank <= 5",
)
_add(
    "fuzzy_word",
    lambda s, d: rules.fuzzy(_words(s, d), PLAIN_WORDS, 0.6).select("word", "known", F.col("rank").cast("long").alias("rank"), F.round("s", 6).alias("s")),
    f"SELECT word, known, rank, round(s, 6) AS s FROM (SELECT *, {_rank} AS rank FROM (SELECT word, known, 1 - levenshtein(word, known) / greatest(length(word), length(known)) AS s FROM ({_WORDS}) w, ({_LIST}) k) x WHERE s >= 0.6) y WHERE rank <= 3",
)
_add("lm_correct", lambda s, d: views.candidates(s, d).select("image_id", "ord", T.lm_correct("text").alias("result")))
_add("vi_correct", lambda s, d: udf.correct(views.lines(s, d), views.rules()).select("doc_id", "line_no", "corrected"))
_OLD_RULES = [("context", r"\bof\s+the\b", "of the"), ("error", "tion", "tions"), ("split", r"\b(in)(the)\b", r"\1 \2"), ("final", " and ", " & ")]
_add("legacy_spell", lambda s, d: udf.correct_lines(views.docs(s, d), _OLD_RULES).select("doc_id", "corrected"))


def _rule_rows(spark: SparkSession, sf_dir: str, k: int) -> DataFrame:
    n = views.table(spark, sf_dir, "nation")
    return n.filter(F.col("n_nationkey") % k == 0).select(F.col("n_nationkey").cast("long").alias("ord"), F.substring("n_name", 1, 7 + k).alias("pattern"), F.concat(F.col("n_name"), F.lit(f"-{k}")).alias("new"))


_RULES = "SELECT CAST(n_nationkey AS BIGINT) AS ord, substr(n_name, 1, {w}) AS pattern, n_name || '-{k}' AS new FROM nation WHERE n_nationkey % {k} = 0"
_add(
    "dict_merge",
    lambda s, d: rules.merge(_rule_rows(s, d, 2), _rule_rows(s, d, 3)).select("pattern", "new", "src", "ord"),
    f"SELECT pattern, arg_max(new, src * 1000 + ord) AS new, CAST(min(src * 1000 + ord) // 1000 AS INTEGER) AS src, CAST(min(src * 1000 + ord) % 1000 AS BIGINT) AS ord FROM (SELECT 0 AS src, * FROM ({_RULES.format(k=2, w=9)}) a UNION ALL SELECT 1, * FROM ({_RULES.format(k=3, w=10)}) b) u GROUP BY pattern",
)

# Strategies, with every line as a page.
def _paged(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = views.lines(spark, sf_dir)
    return d.select("doc_id", "line_no", F.length(T.strip("text")).alias("n"), ((F.col("doc_id") * 13 + F.col("line_no")) % 100).alias("m"))


_PAGED = f"SELECT doc_id, line_no, length({S.strip('text')}) AS n, (doc_id * 13 + line_no) % 100 AS m FROM ({views.SQL['lines']}) l"
_STRATEGY = "CASE WHEN n >= 120 THEN CASE WHEN m >= 20 THEN 'mixed' ELSE 'direct_text' END WHEN n >= 40 THEN 'ocr_fallback' WHEN m >= 80 THEN 'mixed' ELSE 'scanned_ocr' END"
_add("page_strategy", lambda s, d: _paged(s, d).select("doc_id", "line_no", pages.strategy("n", "m").alias("strategy")), f"SELECT doc_id, line_no, {_STRATEGY} AS strategy FROM ({_PAGED}) p")
_add(
    "strategy_hist",
    lambda s, d: _paged(s, d).groupBy(pages.strategy("n", "m").alias("strategy")).agg(F.count(F.lit(1)).alias("n")),
    f"SELECT {_STRATEGY} AS strategy, count(*) AS n FROM ({_PAGED}) p GROUP BY 1",
)
_add(
    "force_ocr",
    lambda s, d: views.garbled(s, d).select("doc_id", pages.must_recognize("text").alias("forced")),
    with_views("garbled") + f"SELECT doc_id, (length(nt) >= 80 AND quality < 0.45) AS forced FROM ({S.quality('garbled_v')}) z",
)

# Samples.
_add(
    "labels_tsv",
    lambda s, d: labels.label_lines(views.lines(s, d).select(F.when(F.col("line_no") % 3 == 0, F.col("text")).otherwise(F.concat_ws("\t", F.concat(F.lit("img"), F.col("doc_id")), "text", F.lit("more"))).alias("value"))),
    with_views("lines") + "SELECT substr(v, 1, instr(v, chr(9)) - 1) AS filename, substr(v, instr(v, chr(9)) + 1) AS text FROM (SELECT CASE WHEN line_no % 3 = 0 THEN text ELSE 'img' || doc_id || chr(9) || text || chr(9) || 'more' END AS v FROM lines_v) l WHERE contains(v, chr(9))",
)
_add(
    "split_90_10",
    lambda s, d: labels.split_90_10(views.lines(s, d).select("doc_id", "line_no"), "line_no", "doc_id"),
    with_views("lines") + "SELECT doc_id, line_no, CASE WHEN row_number() OVER (PARTITION BY doc_id ORDER BY line_no) <= greatest(1, floor(count(*) OVER (PARTITION BY doc_id) * 0.9)) THEN 'train' ELSE 'val' END AS part FROM lines_v",
)
_add("synthetic_text", lambda s, d: labels.synthetic_text(s, 500))
_add(
    "cli_json",
    lambda s, d: views.candidates(s, d).select("image_id", "ord", pages.cli_json(F.col("text"), F.col("engine"), F.length("text") > 1).alias("json")),
    with_views("cands") + "SELECT image_id, ord, CAST(to_json({'text': text, 'source': engine, 'success': length(text) > 1}) AS VARCHAR) AS json FROM cands_v",
)

import random
import re

import pytest
from pyspark.sql import functions as F

from quillstone.functions import text
from quillstone.functions import values as V
from quillstone.operators import convert, ctc, layout, pages, rules, tables, vote
from quillstone.sources import labels

CANDS = "image_id long, ord int, engine string, text string, confidence double"
BOXES = "page_id long, ord long, x1 double, y1 double, x2 double, y2 double, conf double"


def cands(spark, *rows):
    return spark.createDataFrame([(1, i, f"e{i}", t, c) for i, (t, c) in enumerate(rows)], CANDS)


def boxes(spark, *rows):
    return spark.createDataFrame([(1, i, *map(float, r), 0.5) for i, r in enumerate(rows)], BOXES)


def test_votes(spark):
    assert vote.best(cands(spark, ("a", 0.8), ("b", 0.8))).first().text == "a"
    assert vote.weighted(cands(spark, ("l", 0.9), ("word", 0.5))).first().text == "word"
    assert vote.weighted(cands(spark, ("l", 0.9), ("1", 0.5))).first().text == "l"
    assert vote.majority_exact(cands(spark, ("x y", 0.9), ("word", 0.5), (" word", 0.1))).first().text == "word"
    assert vote.majority(cands(spark, ("hello world", 0.5), ("hello w0rld", 0.7), ("zzz", 0.9))).first().text == "hello w0rld"
    assert vote.majority(cands(spark, ("abc", 0.5), ("wxyz", 0.7))).first().text == "wxyz"
    assert vote.select_best(cands(spark, ("a", 0.8), ("bb", 0.8))).first().text == "bb"
    assert vote.consensus(cands(spark, ("a", 0.8))).first().consensus == 1.0
    assert vote.low_consensus(cands(spark, ("abc", 0.8), ("xyz", 0.8))).first().low is True
    assert vote.fallback_first(cands(spark, (" ", 0.8), ("b", 0.1))).first().text == "b"
    assert vote.fuse(cands(spark, ("the cat", 0.8), ("the bat", 0.1), ("the bat", 0.1))).first().text == "the bat"


def test_hallucinations(spark):
    kept = vote.drop_hallucinations(cands(spark, ("a a a b", 0.9), ("one two three four", 0.5), ("ab", 0.5))).collect()
    assert [r.text for r in kept] == ["one two three four"]
    kept = vote.drop_hallucinations(cands(spark, ("a a a b", 0.9), ("ab", 0.5))).collect()
    assert [r.text for r in kept] == ["a a a b"]


def test_results_do_not_depend_on_partitions(spark):
    rows = [(i % 50, i // 50, f"e{i % 3}", f"t{i % 7} words", 0.5) for i in range(150)]
    df = spark.createDataFrame(rows, CANDS)
    for f in (vote.best, vote.weighted, vote.select_best, vote.majority_exact, vote.engine_wins):
        assert sorted(f(df).collect()) == sorted(f(df.repartition(7)).collect())


def test_overlap(spark):
    pair = layout.pairs(boxes(spark, (0, 0, 10, 10), (5, 0, 15, 10))).select(layout.overlap_ratio("a", "b").alias("r"), layout.iou("a", "b").alias("i")).first()
    assert pair.r == 0.5 and pair.i == pytest.approx(1 / 3)


def test_orders(spark):
    two = boxes(spark, *[(0, y, 100, y + 5) for y in (0, 20, 40)], *[(600, y, 700, y + 5) for y in (1, 21, 41)], (300, 0, 400, 5))
    got = layout.column_order(two, 700).orderBy("pos").collect()
    assert [r.ord for r in got] == [0, 1, 2, 3, 4, 5]  # the box in the middle is left out
    one = layout.reading_order(boxes(spark, (5, 9, 6, 10), (0, 9, 1, 10), (9, 0, 10, 1))).orderBy("pos").collect()
    assert [r.ord for r in one] == [2, 1, 0]


def test_gap_cluster(spark):
    df = spark.createDataFrame([(1, float(v)) for v in (1, 2, 3, 20, 22)], "k long, v double")
    assert [r.center for r in layout.gap_cluster(df, "k", "v").orderBy("cluster").collect()] == [2, 21]


def test_anchor_rows(spark):
    got = layout.anchor_rows(boxes(spark, *[(0, y, 5, y + 5) for y in (0, 6, 12, 18, 30)])).orderBy("ord").collect()
    assert [r.row for r in got] == [0, 0, 1, 1, 2]


def greedy_nms(rows, most=0.3):
    kept = []
    for i, r in sorted(enumerate(rows), key=lambda x: (-x[1][4], x[0])):
        if all(layout._iou(r[:4], rows[k][:4]) <= most for k in kept):
            kept.append(i)
    return sorted(kept)


def test_nms(spark):
    made = random.Random(1)
    rows = []
    for _ in range(60):
        x, y = made.randint(0, 80), made.randint(0, 80)
        rows.append((float(x), float(y), float(x + made.randint(5, 30)), float(y + made.randint(5, 30)), made.randint(0, 5) / 10))
    df = spark.createDataFrame([(1, i, *r) for i, r in enumerate(rows)], BOXES)
    assert sorted(r.ord for r in layout.nms(df).collect()) == greedy_nms(rows)


def test_region_merge(spark):
    got = layout.region_merge(boxes(spark, (0, 0, 10, 10), (1, 0, 11, 10), (50, 50, 60, 60))).orderBy("ord").collect()
    assert [(r.x1, r.x2) for r in got] == [(0, 11), (50, 60)]


def test_merge_ocr_blocks(spark):
    got = layout.merge_ocr_blocks(boxes(spark, (0, 0, 100, 10), (4, 15, 100, 25), (4, 50, 100, 60))).orderBy("block").collect()
    assert [(r.y1, r.y2, r.n) for r in got] == [(0, 25, 2), (50, 60, 1)]


def test_merge_lines(spark):
    rows = [
        (1, 0, 50.0, 0.0, 400.0, 10.0, "First line of text", 11.0, False),
        (1, 1, 50.0, 12.0, 400.0, 22.0, "goes on here.", 11.0, False),
        (1, 2, 50.0, 24.0, 400.0, 34.0, "- an item", 11.0, False),
        (1, 3, 50.0, 36.0, 400.0, 46.0, "A large title", 18.0, True),
        (1, 4, 50.0, 90.0, 200.0, 100.0, "Short end.", 11.0, False),
        (1, 5, 50.0, 102.0, 200.0, 112.0, "Not joined", 11.0, False),
    ]
    df = spark.createDataFrame(rows, "page_id long, ord long, x1 double, y1 double, x2 double, y2 double, text string, font_size double, is_bold boolean")
    got = layout.merge_lines(df, 600.0).orderBy("block").collect()
    assert [(r.text, r.kind) for r in got] == [
        ("First line of text\ngoes on here.", "text"), ("- an item", "list"), ("A large title", "title"), ("Short end.", "text"), ("Not joined", "text"),
    ]


def test_join_spans(spark):
    rows = [(1, 0, "ab", 0.0, 10.0, 10.0), (1, 1, "cd", 13.0, 20.0, 10.0), (1, 2, "ef", 21.0, 25.0, 10.0), (1, 3, ".", 40.0, 41.0, 10.0), (1, 4, "", 50.0, 60.0, 10.0)]
    df = spark.createDataFrame(rows, "line_id long, ord int, text string, x1 double, x2 double, size double")
    assert layout.join_spans(df).first().text == "ab cdef."


def test_profile_runs(spark):
    values = [0] * 2 + [9] * 20 + [0] * 3 + [9] * 5 + [0] + [9] * 4
    df = spark.createDataFrame([(1, i, v) for i, v in enumerate(values)], "k long, p long, v long")
    assert sorted((r.start, r.stop) for r in layout.profile_runs(df, "k", "p", "v").collect()) == [(2, 22), (31, 35)]


ROWS = [["Tên", "Số"], ["An <b>", "1"], ["Bình", "22"]]


def test_writers(value, spark):
    df = spark.createDataFrame([(ROWS,), ([],)], "r array<array<string>>")

    def made(f):
        return [r.v for r in df.select(f("r").alias("v")).collect()]

    assert made(tables.as_markdown) == ["| Tên | Số |\n|---|---|\n| An <b> | 1 |\n| Bình | 22 |", "[Empty table]"]
    assert made(tables.as_simple)[0] == "Tên     Số\nAn <b>  1 \nBình    22"
    width = [max(len(r[i]) for r in ROWS) + 2 for i in (0, 1)]
    grid = made(tables.as_grid)[0].split("\n")
    assert grid[1] == "│" + "│".join(c.center(w) for c, w in zip(ROWS[0], width)) + "│"
    assert len(grid) == 7 and grid[-1][0] == "└"
    box = made(tables.as_box)[0].split("\n")
    assert box[3] == "│" + "│".join(" " + c.ljust(w - 1) for c, w in zip(ROWS[1], width)) + "│"
    assert "An &lt;b&gt;" in made(tables.as_html)[0] and made(tables.as_html)[1] == "<p>[Empty table]</p>"
    assert made(tables.tsv)[0] == "Tên\tSố\nAn <b>\t1\nBình\t22"


def test_center_is_pythons(spark):
    pairs = [("x" * n, w) for n in range(6) for w in range(n, 9)]
    df = spark.createDataFrame(pairs, "v string, w int")
    assert [r.c for r in df.select(tables._middle(F.col("v"), F.col("w")).alias("c")).collect()] == [v.center(w) for v, w in pairs]


def test_compact(spark):
    df = spark.createDataFrame([([["a ", None, ""], ["", " "], ["b"]],)], "r array<array<string>>")
    assert df.select(tables.compact("r").alias("v")).first().v == [["a"], ["b"]]


@pytest.mark.parametrize(
    ("line", "expected"),
    [("- x", False), ("x", False), ("Tuổi", True), ("a" * 21, False), ("Hello", True), ("hello", False), ("abc 1", True), ("two words", True), (" ".join(["w"] * 11), False), (" ".join(["w"] * 26), False)],
)
def test_table_line(value, line, expected):
    assert value(tables.is_table_line("t"), t=line) is expected


def test_find_tables(spark):
    text = "Tên  Số\nAn  1\nAn  1\nBình  2\n\nlong " + "words " * 30
    df = spark.createDataFrame([(1, text), (2, ""), (3, None)], "doc_id long, text string")
    assert [(r.doc_id, r.table_text) for r in tables.find_tables(df).collect()] == [(1, "Tên  Số\nAn  1\nBình  2")]


def test_vertical(spark):
    text = "Họ và tên\nThành phố\nNghề nghiệp\nAn\nHuế\nKỹ\nBo\nVinh\nY"
    df = spark.createDataFrame([(text,), ("a\nb\nc",), ("",)], "t string")
    got = [r.v for r in df.select(tables.vertical_rows("t").alias("v")).collect()]
    assert got[0] == [["Họ và tên", "Thành phố", "Nghề nghiệp"], ["An", "Huế", "Kỹ"], ["Bo", "Vinh", "Y"]]
    assert got[1] is None and got[2] is None


def test_locate():
    text = "before\nTên Số\nAn 1\nafter\nTên Số\nBo 2\n"
    found = tables.locate(text, ["Tên Số\nAn 1", "Tên Số\nBo 2"])
    assert [text[a:b].strip() for a, b, _ in found] == ["Tên Số\nAn 1", "Tên Số\nBo 2"]
    assert tables.segments(text, ["Tên Số\nAn 1"]) == [("text", "before"), ("table", "Tên Số\nAn 1"), ("text", "after\nTên Số\nBo 2")]
    assert tables.segments("x", []) == [("text", "x")]


def test_ctc(spark):
    path = [1, 1, 0, 1, 2, 2]
    m = [[1.0 if i == k else 0.0 for i in range(3)] for k in path]
    df = spark.createDataFrame([(m,)], "m array<array<float>>")
    assert df.select(ctc.greedy("m").alias("v")).first().v == [1, 1, 2]
    made = random.Random(2)
    rows = [([[made.random() for _ in range(5)] for _ in range(8)],) for _ in range(50)]
    df = spark.createDataFrame(rows, "m array<array<double>>")
    for r in df.select(ctc.greedy("m").alias("g"), ctc.beam("m").alias("b")).collect():
        assert r.g == r.b
    raw = spark.createDataFrame([([[-1.0, -0.5], [-2.0, 3.0]],)], "m array<array<double>>")
    assert raw.select(ctc.greedy("m").alias("g"), ctc.beam("m").alias("b")).first() == ([1], [1])


def test_ctc_lm(spark):
    """Correction over probabilities, against a plain decoder."""
    made = random.Random(4)
    words = ["xin chào", "tôi họcc bài", "thương  gian", "rnùa ch0ng"]
    paths = [[V.ALPHABET.index(c) + 1 for c in w] for w in words] + [[made.randrange(len(V.ALPHABET) + 1) for _ in range(12)] for _ in range(20)]
    rows = [(i, [[5.0 if k == at else made.random() for k in range(len(V.ALPHABET) + 1)] for at in path]) for i, path in enumerate(paths)]
    df = spark.createDataFrame(rows, "i long, m array<array<float>>")
    plain = ["".join(V.ALPHABET[k - 1] for j, k in enumerate(p) if k and (j == 0 or k != p[j - 1])) for p in paths]
    want = spark.createDataFrame(list(enumerate(plain)), "i long, t string").select("i", text.lm_correct("t").alias("r"))
    got = ctc.lm(df, ctc.softmax("m"), "r")
    assert {r.i: r.r for r in got.collect()} == {r.i: r.r for r in want.collect()}


def test_strategy(value):
    def of(n, m, callback=True):
        return value(pages.strategy("n", "m", callback), n=n, m=m)

    assert [of(119, 0), of(120, 20), of(39, 80), of(39, 79)] == ["ocr_fallback", "mixed", "mixed", "scanned_ocr"]
    assert of(39, 0, False) == "direct_text"


def test_pages(spark):
    b = spark.createDataFrame([(1, 1, 5.0, 0, "text"), (1, 2, 0.0, 0, "last")], "doc_id long, page_num int, y1 double, ord int, val string")
    t = spark.createDataFrame([(1, 1, 5.0, 0, "table"), (1, 1, 1.0, 1, "top"), (1, 1, 2.0, 2, " ")], b.schema)
    assert pages.pages_to_text(b, t).first().text == "top\n\ntext\n\ntable\n\nlast"
    p = spark.createDataFrame([(1, 1, 0, " "), (1, 2, 0, "x")], "doc_id long, page_num int, ord int, val string")
    assert pages.assemble(p, True).first().text == "=== PAGE 1 ===\n[No text recognized]\n\n=== PAGE 2 ===\nx"


def test_rules(spark):
    base = spark.createDataFrame([(0, "a", "1"), (1, "b", "2")], "ord long, pattern string, new string")
    more = spark.createDataFrame([(0, "b", "3"), (1, "c", "4")], base.schema)
    got = {r.pattern: (r.new, r.src, r.ord) for r in rules.merge(base, more).collect()}
    assert got == {"a": ("1", 0, 0), "b": ("3", 0, 1), "c": ("4", 1, 1)}
    assert sorted(r.pattern for r in rules.merge_missing(base, more).collect()) == ["a", "b", "c"]
    words = spark.createDataFrame([("thuong",), ("zzz",)], "word string")
    assert [r.known for r in rules.suggest(words, ["thuong", "thuon", "abc"]).orderBy("rank").collect()] == ["thuong", "thuon"]
    got = rules.suggest(words, ["thuong", "thuon"], exact={"thuong": "thương", "zzz": "zz"}).orderBy("word", "rank").collect()
    assert [(r.word, r.known) for r in got] == [("thuong", "thương"), ("thuong", "thuong"), ("thuong", "thuon"), ("zzz", "zz")]
    assert [r.known for r in rules.fuzzy(words, ["thuong", "thuongx", "abc"]).orderBy("rank").collect()] == ["thuong", "thuongx"]


def test_labels(spark, tmp_path):
    (tmp_path / "l.tsv").write_text("a.png\tone\nskipped\nb.png\ttwo\tthree\n")
    got = labels.read_labels(spark, str(tmp_path / "l.tsv")).collect()
    assert [(r.filename, r.text) for r in got] == [("a.png", "one"), ("b.png", "two\tthree")]
    parts = labels.split_90_10(spark.range(20), "id").groupBy("part").count().collect()
    assert dict(parts) == {"train": 18, "val": 2}
    one = labels.synthetic_text(spark, 50)
    assert one.collect() == labels.synthetic_text(spark, 50).collect()
    assert all(3 <= len(r.text) <= 12 for r in one.collect())


def test_history_stream(spark, tmp_path):
    from quillstone.streaming import history

    rows = spark.createDataFrame([("2024-01-01 10:00:00", "a", 0.5), ("2024-01-01 12:00:00", "a", 0.7)], "ts string, engine string, confidence double")
    rows = rows.withColumn("ts", F.to_timestamp("ts"))
    rows.write.parquet(str(tmp_path / "in"))
    stream = history.read_stream(spark, str(tmp_path / "in"), rows.schema)
    history.append(stream, str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination(60)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2
    assert history.windowed(rows).first().mean_conf == pytest.approx(0.6)


def test_sinks(spark, tmp_path):
    from quillstone.sources import sinks

    df = spark.createDataFrame([(1, [["a,b", 'c"d'], ["x\ny", ""]])], "table_id long, rows array<array<string>>")
    sinks.write_table_csv(df, str(tmp_path / "csv"))
    assert "".join(r.value + "\n" for r in spark.read.text(str(tmp_path / "csv" / "table_id=1")).collect()).replace("\r", "") == '"a,b","c""d"\nx y,\n'
    sinks.write_texts(spark.createDataFrame([("t",)], "text string"), str(tmp_path / "txt"))
    assert spark.read.text(str(tmp_path / "txt")).first().value == "t"


def test_convert(spark):
    from quillstone.operators import convert

    def line(doc, page, k, text):
        return (doc, page, k, 50.0, 14.0 * k, 500.0, 14.0 * k + 11, text, 11.0, False)

    schema = "doc_id long, page_num int, ord long, x1 double, y1 double, x2 double, y2 double, text string, font_size double, is_bold boolean"
    long = "plain words that go on for a while and then some more of the same"
    lines = spark.createDataFrame([line(1, 0, 0, long), line(1, 0, 1, long), line(1, 0, 9, "in table"), line(2, 0, 0, "w0rd x1y z2w " * 9)], schema)
    seen = spark.createDataFrame([(1, 0), (1, 1), (2, 0)], "doc_id long, page_num int")
    found = spark.createDataFrame([(1, 0, 0, 40.0, 120.0, 520.0, 140.0, [["a", "b"]]), (1, 1, 0, 0.0, 0.0, 9.0, 9.0, [["lost"]])], "doc_id long, page_num int, ord long, x1 double, y1 double, x2 double, y2 double, rows array<array<string>>")
    recognized = spark.createDataFrame([(1, 1, "", "seen page"), (2, 0, "", "clear text")], "doc_id long, page_num int, image_text string, page_text string")
    texts, plan = convert.convert(lines, seen, 600.0, found, recognized)
    assert {r.doc_id: r.text for r in texts.collect()} == {1: f"{long}\n{long}\n\na\tb\n\nseen page", 2: "clear text"}
    got = {(r.doc_id, r.page_num): (r.strategy, r.used_ocr, r.n_tables) for r in plan.collect()}
    assert got == {(1, 0): ("direct_text", False, 1), (1, 1): ("scanned_ocr", True, 0), (2, 0): ("garbled_text_ocr", True, 0)}
    assert convert.needed(convert.strategies(lines, seen)).count() == 2


def test_older_correction(spark):
    from quillstone.functions import udf

    rules = [("context", r"mọi\s+thí\b", "mọi thứ"), ("error", "khăm", "khăn"), ("split", r"\b(xin)(hãy)\b", r"\1 \2"), ("final", "dung hoà", "dung hòa")]
    df = spark.createDataFrame([("mọi  thí KHĂM\n\n xinhãy thé\ndung  hoà",), (None,)], "text string")
    assert [r.corrected for r in udf.correct_lines(df, rules).collect()] == ["mọi thứ khăn\nxin hãy thế\ndung hòa", None]


def test_split_without_a_key(spark):
    """Ranges give the same split as one sorted task."""
    for n in (1, 2, 9, 10, 57):
        rows = spark.createDataFrame([((i * 37) % 101,) for i in range(n)], "k long").repartition(3)
        got = sorted((r.k, r.part) for r in labels.split_90_10(rows, "k").collect())
        assert [p for _, p in got] == ["train"] * max(1, n * 9 // 10) + ["val"] * (n - max(1, n * 9 // 10))
    assert labels.split_90_10(spark.createDataFrame([], "k long"), "k").count() == 0


def test_converted_pages_keep_their_keys(spark):
    """Pages are told apart by both ids, texts as ids included."""
    rows = [(d, p, 0, 10.0, 10.0, 300.0, 21.0, f"text {d} {p}", 11.0, False) for d in ("a", "a:1", "1") for p in (0, 1, 10)]
    lines = spark.createDataFrame(rows, "doc_id string, page_num long, ord long, x1 double, y1 double, x2 double, y2 double, text string, font_size double, is_bold boolean")
    got = {(r.doc_id, r.page_num): r.text for r in convert.blocks(lines, None, 700.0).collect()}
    assert got == {(d, p): f"text {d} {p}" for d, p, *_ in rows}


def test_six_hundred_rules_are_a_plain_fold(spark):
    """The gate and the compiled cascade change nothing, chains and ties included."""
    import re
    import unicodedata

    from quillstone.functions import udf
    from quillstone.plans import views

    rules = views.rules()
    assert len(rules) > 450
    assert len({new for _, _, new in rules} & {pattern for _, pattern, _ in rules}) > 20  # chains

    def plain(text):
        text = unicodedata.normalize("NFC", text)
        for kind in ("regex", "phrase", "word"):
            own = [r for r in rules if r[0] == kind]
            if kind != "regex":
                own = sorted(own, key=lambda r: -len(r[1]))
            for _, pattern, new in own:
                if kind == "regex":
                    text = re.sub(pattern, new, text, flags=re.IGNORECASE)
                else:
                    text = re.sub(r"\b" + re.escape(pattern) + r"\b", lambda m, new=new: new, text, flags=re.IGNORECASE)
        text = re.sub(r"\s+", " ", text).strip()
        text = re.sub(r"\s+([,.!?;:])", r"\1", text)
        return re.sub(r"([,.!?;:])(?!\s|$)", r"\1 ", text)

    lines = views.lines(spark, "/root/testdata/sf0.001").limit(300)
    made = [(p, q) for _, p, q in rules if _ != "regex"]
    extra = spark.createDataFrame([(-1, i, f"{p.upper()} ,x {q} {p}.{p}") for i, (p, q) in enumerate(made)], "doc_id long, line_no long, text string")
    got = udf.correct(lines.union(extra), rules).collect()
    changed = 0
    for r in got:
        assert r.corrected == plain(r.text)
        changed += r.corrected != r.text
    assert changed > len(made) // 2


def many_boxes(spark, seed):
    """Pages of 1 to 200 boxes, in confusion, and the rows of each."""
    rng = random.Random(seed)
    pages = {}
    for page in range(150):
        n = rng.choice([1, 2, 3, 7, 16, 17, 64, 65, 200] if page % 10 == 0 else [1, 2, 5, 9, 16])
        made = [(rng.randint(0, 90), rng.randint(0, 90), rng.randint(1, 40), rng.randint(1, 40)) for _ in range(n)]
        pages[page] = [(page, k, float(x), float(y), float(x + w), float(y + h), rng.randint(0, 9) / 10) for k, (x, y, w, h) in enumerate(made)]
    rows = [r for p in pages.values() for r in p]
    rng.shuffle(rows)
    return pages, spark.createDataFrame(rows, BOXES).repartition(3)


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_nms_of_many_pages(spark):
    pages, df = many_boxes(spark, 1)
    got = layout.nms(df)
    want = sorted((p, k) for p, rows in pages.items() for k in greedy_nms([r[2:] for r in rows]))
    assert sorted((r.page_id, r.ord) for r in got.collect()) == want
    assert "InPandas" not in plan_of(got)  # a call of Python for each page takes minutes for millions


def plain_iou(a, b):
    w, h = min(a[2], b[2]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[1], b[1])
    if w < 0 or h < 0:
        return 0.0
    return w * h / ((a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - w * h)


def test_region_merge_of_many_pages(spark):
    pages, df = many_boxes(spark, 2)
    got = layout.region_merge(df)
    want = []
    for page, rows in pages.items():
        left = [list(r[1:]) for r in rows]
        while left:
            box, rest = left[0], []
            for b in left[1:]:
                meets = min(box[3], b[3]) > max(box[1], b[1]) and min(box[4], b[4]) > max(box[2], b[2])
                if meets and plain_iou(box[1:5], b[1:5]) >= 0.3:
                    box = [box[0], min(box[1], b[1]), min(box[2], b[2]), max(box[3], b[3]), max(box[4], b[4]), max(box[5], b[5])]
                else:
                    rest.append(b)
            want.append((page, *box))
            left = rest
    assert sorted(map(tuple, got.collect())) == sorted(want)
    assert "InPandas" not in plan_of(got)


def plain_merge(lines, width):
    """The merge as a plain fold that looks at a whole block each time."""

    def own(text):
        return [x.strip() for x in text.split("\n") if x.strip()]

    def item(text):
        return bool(re.match(V.LIST_ITEM, text))

    def heading(b):
        text, rows = b["text"].strip(), own(b["text"])
        if not rows or any(map(item, rows)) or text.endswith(tuple(V.HEADING_STOPS)):
            return False
        return (b["size"] >= 15 and len(text) <= 220) or bool(re.match(V.NUMBERED, rows[0])) and (b["bold"] or b["size"] >= 12)

    def joins(b, x):
        before, text = own(b["text"]), x["text"].strip()
        if not before or not text or item(before[-1]) or item(text) or heading(b) or heading(x):
            return False
        if x["box"][1] - b["box"][3] > max(5.0, min(b["size"], x["size"]) * 0.9):
            return False
        if abs(x["lefts"][0] - min(b["lefts"])) > max(14.0, width * 0.025) or abs(b["size"] - x["size"]) > 1.6:
            return False
        return not (before[-1].endswith(tuple(V.SENTENCE_ENDS)) and (b["rights"][-1] - b["lefts"][-1]) / max(1.0, width) < 0.58)

    blocks = []
    for _, _, x1, y1, x2, y2, text, size, bold in sorted(lines, key=lambda r: (r[3], r[2], r[1])):
        x = {"text": text, "box": [x1, y1, x2, y2], "size": size, "bold": bold, "lefts": [x1], "rights": [x2]}
        if blocks and joins(blocks[-1], x):
            b = blocks[-1]
            b["text"] += "\n" + text
            b["box"] = [f(u, v) for f, u, v in zip((min, min, max, max), b["box"], x["box"])]
            b["size"], b["bold"] = max(b["size"], size), b["bold"] and bold
            b["lefts"] += x["lefts"]
            b["rights"] += x["rights"]
        else:
            blocks.append(x)
    return [(lines[0][0], k, *b["box"], b["text"], b["size"], b["bold"], "list" if any(map(item, own(b["text"]))) else "title" if heading(b) else "text", len(b["lefts"])) for k, b in enumerate(blocks)]


def test_merge_lines_of_many_pages(spark):
    rng = random.Random(3)
    texts = ["words go on", "  words with blanks \t", "end.", "- item", "1.\n next line", "2. Part", "", " \n ", "a\n- b", "IV. Title", "long " * 20, "12 numbered", "stop:", "x\n\n y"]
    pages = []
    for page in range(200):
        y, rows = 0.0, []
        for k in range(rng.choice([1, 2, 5, 20, 60])):
            y += rng.choice([0.0, 8.0, 11.0, 11.0, 11.0, 11.0, 11.0, 40.0])
            x = rng.choice([50.0, 50.0, 50.0, 50.0, 55.0, 90.0])
            text = rng.choice([*texts, *["words go on"] * (page % 3 * 30)])
            rows.append((page, k, x, y, x + rng.choice([100.0, 300.0, 400.0]), y + 10, text, rng.choice([*[11.0] * 9, 12.0, 16.0]), rng.random() < 0.3))
        pages.append(rows)
    kinds = "page_id long, ord long, x1 double, y1 double, x2 double, y2 double, text string, font_size double, is_bold boolean"
    got = layout.merge_lines(spark.createDataFrame([r for p in pages for r in p], kinds).repartition(5), 600.0)
    want = [b for p in pages for b in plain_merge(p, 600.0)]
    assert max(b[-1] for b in want) > 5
    assert sorted(map(tuple, got.collect())) == want
    assert "InPandas" not in plan_of(got)

import difflib

import pytest
from pyspark.sql import functions as F

from quillstone.functions import score, udf
from quillstone.functions import text as T


@pytest.mark.parametrize(
    ("f", "text", "expected"),
    [
        (T.normalize, "a\t\tb\r\n\n\n\nc ", "a b\n\nc"),
        (T.normalize, "", ""),
        (T.normalize, None, None),
        (T.clean_cell, None, ""),
        (T.line_clean, " a \n\n  b\n ", "a\nb"),
        (T.char_confusion, "c1 rn", "cI m"),
        (T.char_confusion, "0l1cl", "OIIcI"),
        (T.phrase_merge, "NHAN  vien", "nhân viên"),
        (T.restore_exact, "Hang ban", "Hàng bản"),
        (T.restore_exact, "  x  y ", "x ý"),
        (T.restore_prefix, "hangar Tim", "hàng Tìm"),
        (T.postprocess, "mang lan", "mang Ian"),
        (T.postprocess, "nhan vien cong viec he thong may tinh", "nhân viên công việc hệ thống máy tính"),
        (T.dehyphenate, "con-\ntinue\nnow", "continue now"),
        (T.punct_spacing, "3.14", "3. 14"),
        (T.punct_spacing, "xong ,đi", "xong, đi"),
        (T.punct_spacing, "a..b !", "a. . b!"),
        (T.capitalize, "one. two! three", "One. Two! Three"),
        (T.lm_correct, "  Xin ch0ng. bạn ", "Xin chong. Bạn"),
        (T.benchmark_form, "a \n\n b\tc", "a b c"),
    ],
)
def test_texts(value, f, text, expected):
    assert value(f("t"), t=text) == expected


@pytest.mark.parametrize(
    ("f", "text", "expected"),
    [
        (T.is_mostly_upper, "ABCd", True),
        (T.is_mostly_upper, "123", False),
        (T.is_list, "x\n- item", True),
        (T.is_list, "a-b", False),
        (T.ends_like_heading, "a: ", True),
        (T.is_vietnamese, "HELLO WORLD AND SO ON AND ON", False),
        (T.is_vietnamese, "đi", False),
        (T.is_vietnamese, "đi về", True),
        (T.is_vietnamese, None, False),
        (T.is_valid_variant, "http://x", False),
        (T.is_valid_variant, "good text", True),
        (T.is_garbage, "aaaa", True),
        (T.is_garbage, "12 34", True),
        (T.is_garbage, "......a", True),
        (T.is_garbage, "fine", False),
        (T.is_garbage, None, True),
        (T.hallucinates, "a a b c", True),
        (T.hallucinates, "a a a", False),
        (T.hallucinates, "a b c d", False),
        (T.is_artifact, " l ", True),
    ],
)
def test_predicates(value, f, text, expected):
    assert value(f("t"), t=text) is expected


def test_vocab_encode(value):
    assert value(T.vocab_encode("t"), t="Aà#b") == [1, 2, 19]


def test_quality(value):
    assert value(score.text_quality("t"), t="") == 0.0
    assert value(score.text_quality("t"), t="12 34") == 0.2
    assert value(score.text_quality("t"), t="plain words") == 1.0
    # one of two tokens is mixed: 1 - 0.5 * 1.2 - 0.5 * 1.4, at least 0
    assert value(score.text_quality("t"), t="w0rd plain") == 0.0
    assert value(score.text_quality("t"), t="w0rd " + "plain " * 9) == pytest.approx(1 - 0.12 - 0.14)


def test_rates(value):
    assert value(score.cer("a", "b"), a="abd", b="abc") == pytest.approx(1 / 3)
    assert value(score.cer("a", "b"), a="x", b="") == 1.0
    assert value(score.wer_compat("a", "b"), a="a b", b="a c") == 0.5
    assert value(score.pseudo_confidence("a", "b"), a="x" * 50, b="vietocr") == 0.95


def test_line_score(value):
    assert value(score.line_score("t", "c"), t="aaaa", c=0.9) == -1000.0
    assert value(score.line_score("t", "c"), t="good line", c=0.1) == -500.0
    assert value(score.line_score("t", "c"), t="good line", c=0.5) == 9 * 2 + 25 + 10


RULES = [
    ("regex", r"\bguủi\b", "gửi"),
    ("phrase", "phái dung hoà", "phải dung hòa"),
    ("word", "tố", "tớ"),
    ("word", "thĩ", "thỉ"),
    ("word", "di", "đi"),
    ("word", "sử", "sự"),
]


@pytest.mark.parametrize(
    ("text", "expected"),
    [
        ("guủi tố, việc phái dung hoà", "gửi tớ, việc phải dung hòa"),
        ("xong ,di", "xong, đi"),
        ("sửa sử", "sửa sự"),
        ("a\n b", "a b"),
        ("3.14", "3. 14"),
        ("GUỦI", "gửi"),
        ("", ""),
    ],
)
def test_correct(spark, text, expected):
    df = spark.createDataFrame([(text,), (None,)], "text string")
    assert [r.corrected for r in udf.correct(df, RULES).collect()] == [expected, None]


def test_longest_rule_comes_first(spark):
    df = spark.createDataFrame([("ab abc",)], "text string")
    assert udf.correct(df, [("word", "ab", "x"), ("word", "abc", "y"), ("phrase", "ab abc", "z")]).first().corrected == "z"


def test_similarity(spark):
    pairs = [("abcd", "bcde"), ("", ""), ("x" * 300, "x" * 299 + "y")]
    df = spark.createDataFrame([*pairs, (None, "a")], "a string, b string")
    got = [r.s for r in df.select(udf.similarity("a", "b").alias("s")).collect()]
    assert got[:3] == [difflib.SequenceMatcher(None, a, b).ratio() for a, b in pairs]
    assert got[3] is None


def test_align():
    assert udf.align("a b c".split(), "a x c d".split()) == ["a", "x", "c"]
    assert udf.align(["a", "b"], ["b"]) == [None, "b"]
    assert udf.align(["a", "b"], []) == [None, None]


def test_fuse():
    assert udf.fuse(["the cat sat", "the bat sat", "the cat"], [0.5, 0.9, 0.5], False) == "the cat sat"
    assert udf.fuse(["abc", "abd"], [0.4, 0.6], True) == "abd"
    assert udf.fuse([], [], True) == ""


def test_nfc(spark):
    df = spark.createDataFrame([("é",), (None,)], "t string")
    assert [r.n for r in df.select(udf.nfc(F.col("t")).alias("n")).collect()] == ["é", None]


def test_upper_case_of_one_character(spark):
    """Each letter's first upper case has one character, as DuckDB gives it."""
    import duckdb

    letters = [chr(c) for c in range(0x21, 0x20000) if not 0xD800 <= c < 0xE000 and (chr(c).isalpha() or chr(c).upper() != chr(c))]
    df = spark.createDataFrame([(c + "x",) for c in letters], "t string")
    got = [r.u for r in df.coalesce(1).select(T.upper_first(F.col("t")).alias("u")).collect()]
    con = duckdb.connect()
    sql = "SELECT list_transform(?, lambda t: upper(substr(t, 1, 1)) || substr(t, 2))"
    assert got == con.execute(sql, [[c + "x" for c in letters]]).fetchone()[0]


def test_capitalize_sharp_s(value):
    assert value(T.capitalize("t"), t="ßen. ŉa! ﬁn") == "ẞen. ŉa! ﬁn"


def test_nearest_words(spark):
    """The remembered search gives what edit distances to all words give."""
    import random

    from quillstone.functions import values as V

    rng = random.Random(5)
    words = [w for k in V.MODEL_WORDS for w in (k, k[1:], k[:-1], k + "n", "t" + k, k[:2] + "x" + k[3:], k[::-1], k + k)]
    words += ["".join(rng.choice("cđhgnoườpư") for _ in range(rng.randint(1, 12))) for _ in range(500)]
    for least in (0.8, 0.6):
        df = spark.createDataFrame([(i, w) for i, w in enumerate(words)], "i long, w string")
        pairs = df.crossJoin(spark.createDataFrame([(k,) for k in V.MODEL_WORDS], "k string"))
        s = 1 - F.levenshtein("w", "k") / F.greatest(F.length("w"), F.length("k"))
        want: dict = {}
        for r in pairs.withColumn("s", s).filter(F.col("s") >= least).collect():
            if r.i not in want or (-r.s, r.k) < want[r.i]:
                want[r.i] = (-r.s, r.k)
        got = udf.Nearest(V.MODEL_WORDS, least)
        assert [got[w] for w in words] == [w if w in V.MODEL_WORDS else want.get(i, (0, w))[1] for i, w in enumerate(words)]


def test_lm_correct_remembers_words(spark):
    df = spark.createDataFrame([(1, " Thưong  gian\u00a0nguời, x. "), (2, None), (3, "")], "i long, t string")
    made = df.select("i", T.lm_correct("t").alias("r"))
    assert [r.r for r in made.orderBy("i").collect()] == ["Thương gian nguời, x.", None, ""]
    assert "levenshtein" not in made._jdf.queryExecution().executedPlan().toString()


def test_opcodes_are_those_of_difflib():
    import random
    import time

    rng = random.Random(9)
    took = {"plain": 0.0, "own": 0.0}
    for round_ in range(400):
        letters = rng.choice(["ab", "abcde ", "etaoinshrdlucmfwypvbgkjqxz     "])
        a = "".join(rng.choice(letters) for _ in range(rng.choice([0, 1, 5, 30, 150, 199, 200, 260, 900])))
        b = rng.choice([a, a.replace("e", "c"), a.upper(), "".join(x for x in a if rng.random() > 0.1), a[len(a) // 2 :] + a[: len(a) // 3], "l", "".join(rng.choice(letters) + x if rng.random() < 0.1 else x for x in a)])
        for x, y in ((a, b), (a.split(), b.split())):
            started = time.perf_counter()
            want = difflib.SequenceMatcher(a=x, b=y).get_opcodes()
            middle = time.perf_counter()
            assert udf.opcodes(x, y) == want
            took["plain"] += middle - started
            took["own"] += time.perf_counter() - middle
    assert took["own"] < took["plain"]


def test_fuse_without_confidences():
    assert udf.fuse(["abc", "abc"], [0.4, 0.6], True) == "abc"
    assert udf.fuse(["a b", "a b c"], [0.4, 0.6], False) == "a b c"

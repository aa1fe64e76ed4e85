import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quillstone.llm import pareto, pieces, tokenfile

DOCS = "doc_id long, text string, source string, doc_id_extra long, size string, key string, copies string"


def docs(spark, rows):
    """Rows with extra columns whose names the operators use themselves."""
    return spark.createDataFrame([(i, t, s, 1, "x", "y", "z") for i, t, s in rows], DOCS)


def water(sizes: dict, weights=(1, 2, 3), cap=3.0) -> dict:
    """Targets by repeated resharing."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    target, total = {}, float(sum(sizes.values()))
    open_ = set(order)
    while open_:
        left = total - sum(target.values())
        level = left / sum(weight[s] for s in open_)
        over = [s for s in open_ if level * weight[s] > cap * sizes[s]]
        if not over:
            return target | {s: level * weight[s] for s in open_}
        for s in over:
            target[s] = cap * sizes[s]
            open_.remove(s)
    return target


def test_mix(spark):
    made = random.Random(4)
    rows = [(i, " ".join(["w"] * made.randint(0, 40)), made.choice(["a", "b", "c", "d", None])) for i in range(600)]
    rows += [(600 + i, "big " * 9, "hot") for i in range(300)] + [(900, None, "a"), (901, "", None), (None, "no id", "b")]
    got = pareto.mix(docs(spark, rows)).collect()
    assert len(got) == len(rows)
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len((t or "").split())
    expected = water(sizes)
    taken = {}
    for r in got:
        assert r.source_size == sizes[r.source]
        assert r.target == pytest.approx(expected[r.source])
        assert r.taken % r["size"] == 0 if r["size"] else r.taken == 0
        assert r.taken <= 3 * r["size"]
        taken[r.source] = taken.get(r.source, 0) + r.taken
    for s in sizes:
        assert 0 <= expected[s] - taken[s] <= max(1, 0.01 * expected[s]), s
    again = pareto.mix(docs(spark, rows).repartition(5)).collect()
    key = lambda r: (str(r.doc_id), r["size"], r.taken)
    assert sorted(map(key, got)) == sorted(map(key, again))


def test_sample_is_the_head_of_the_ranking(spark):
    rows = [(i, "w w w", "a" if i % 3 else "b") for i in range(200)]
    got = pareto.mix(docs(spark, rows), importance=None).collect()
    for s in ("a", "b"):
        own = [r for r in got if r.source == s]
        base = min(r.copies for r in own)
        from hashlib import md5

        def u(i):
            return (int(md5(f"7:{i}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52

        picked = {r.doc_id for r in own if r.copies > base}
        if picked and len(picked) < len(own):
            assert max(u(i) for i in picked) < min(u(r.doc_id) for r in own if r.doc_id not in picked)


def test_mix_importance_and_take(spark):
    rows = [(i, "w w w", "a") for i in range(40)] + [(40 + i, "w w w", "b") for i in range(40)]
    df = docs(spark, rows).selectExpr("*", "CASE WHEN doc_id % 4 = 0 THEN 3.0 ELSE 1.0 END AS importance_score")
    got = pareto.mix(df, importance="importance_score").collect()
    often = sum(r.copies for r in got if r.doc_id % 4 == 0) / 20
    seldom = sum(r.copies for r in got if r.doc_id % 4) / 60
    assert often > seldom
    assert all(r.copies <= 3 for r in got)
    plan = {r.doc_id: r.copies for r in pareto.mix(docs(spark, rows)).collect()}
    out = pareto.take(docs(spark, rows))
    assert out.columns == docs(spark, rows).columns
    counts = {r.doc_id: r["count"] for r in out.groupBy("doc_id").count().collect()}
    assert counts == {k: v for k, v in plan.items() if v}


def brute_mix(rows, targets, weigh, cap=3.0, seed=7):
    """Copies by a plain walk down each source's ranking."""
    from hashlib import md5

    copies = {}
    for source, target in targets.items():
        own = [(i, len((t or "").split())) for i, t, s in rows if s == source]
        weight = {i: weigh(n) for i, n in own}
        low, high = 0.0, 1e9
        for _ in range(200):  # the rate by halving
            rate = (low + high) / 2
            if sum(n * min(cap, rate * weight[i]) for i, n in own) < target:
                low = rate
            else:
                high = rate
        ranking = []
        rest = target
        for i, n in own:
            expected = min(cap, high * weight[i])
            sure = int(expected + 1e-9)
            copies[i] = sure
            rest -= sure * n
            chance = expected - sure
            if chance > 1e-9:
                u = (int(md5(f"{seed}:{i}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52
                ranking.append((u / (1 - u) / (chance / (1 - chance)), i, n))
        ranking.sort()
        whole = True
        for _, i, n in ranking:
            if whole and n <= rest + 1e-6:
                copies[i], rest = copies[i] + 1, rest - n
            else:
                whole = False
                break
        for _ in range(8):
            left, total = rest, 0
            for _, i, n in ranking:
                expected = min(cap, high * weight[i])
                if copies[i] == int(expected + 1e-9) and 0 < n <= left + 1e-6:
                    total += n
                    if total <= left + 1e-6:
                        copies[i], rest = copies[i] + 1, rest - n
    return copies


def test_mix_by_brute_force(spark):
    """Unequal odds: long documents are likelier; targets are met."""
    made = random.Random(14)
    rows = [(i, " ".join(["w"] * int(made.lognormvariate(3, 1.2))), made.choice("aabc")) for i in range(900)]
    got = {r.doc_id: r for r in pareto.mix(docs(spark, rows)).collect()}
    targets = {r.source: r.target for r in got.values()}
    expected = brute_mix(rows, targets, lambda n: float(n.bit_length() or 1))
    assert {i: r.copies for i, r in got.items()} == expected
    for s, t in targets.items():
        taken = sum(r.taken for r in got.values() if r.source == s)
        assert 0.99 * t <= taken <= t + 1e-6
        own = [r for r in got.values() if r.source == s]
        long_, short = ([r.copies for r in own if r["size"] > 60], [r.copies for r in own if 0 < r["size"] < 8])
        assert t >= 2.9 * own[0].source_size or sum(long_) / len(long_) > sum(short) / len(short)


def test_excess_over_the_cap_is_shared(spark):
    """What the cap cuts from important documents others of the source get."""
    rows = [(i, "w w w w", "a" if i < 60 else "b") for i in range(120)]
    df = docs(spark, rows).selectExpr("*", "CASE WHEN doc_id % 6 = 0 THEN 100.0 WHEN doc_id % 6 = 1 THEN -1.0 WHEN doc_id % 6 = 2 THEN CAST(NULL AS DOUBLE) ELSE 1.0 END AS odd_weight")
    got = pareto.mix(df, importance="odd_weight").collect()
    for s in "ab":
        own = [r for r in got if r.source == s]
        assert abs(sum(r.taken for r in own) - own[0].target) <= 4
        assert all(r.copies == 3 for r in own if r.doc_id % 6 == 0)
        assert all(r.copies == 0 for r in own if r.doc_id % 6 in (1, 2))


def test_clashing_names_in_take(spark):
    df = spark.createDataFrame([(1, "a b", "s", 3, 4, 5)], "doc_id long, text string, source string, _row long, rate long, copies long")
    assert [tuple(r) for r in pareto.take(df).collect()] == [(1, "a b", "s", 3, 4, 5)]


def test_mix_of_nothing(spark):
    assert pareto.mix(docs(spark, [])).count() == 0
    assert pareto.take(docs(spark, [])).count() == 0
    got = pareto.mix(docs(spark, [(1, None, None), (2, " ", "a")])).collect()
    assert [(r["size"], r.target, r.taken) for r in got] == [(0, 0.0, 0)] * 2


TEXTS = ["", "a", " ", "  ", " a", "a ", "a  b", "x\n y", "\n", "a\n\n b c ", "don't it's x", "foo.\nBar, x!!\nY's", "日本 b", "<|endoftext|> a", "a　 \xa0b", "ªº, µ² ʰ.", "\x02 \x03", "x" * 5000, "word " * 3000]


def plain(encoder, text):
    return [*encoder.library.encode(text, add_special_tokens=False).ids, 0]


@pytest.fixture(scope="module")
def encoder():
    return tokenfile.Encoder("byte_bpe_50k.json")


def split(flat, sizes):
    cuts = np.concatenate([[0], np.cumsum(sizes)])
    return [flat[a:b].tolist() for a, b in zip(cuts, cuts[1:])]


def test_encoder(encoder):
    assert split(*encoder(pa.array(TEXTS), 0)) == [plain(encoder, t) for t in TEXTS]
    small = tokenfile.Encoder("byte_bpe_50k.json", memo=2)
    assert split(*small(pa.array(TEXTS * 2), 0)) == [plain(encoder, t) for t in TEXTS * 2]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet="abC.,!'|éß1² \n\t\u3000日-", max_size=40), min_size=1, max_size=5))
def test_encoder_is_the_librarys(encoder, texts):
    assert split(*encoder(pa.array(texts), 0)) == [plain(encoder, t) for t in texts]


def test_token_file(spark, encoder, tmp_path):
    rows = [(7, "seven words"), (3, None), (None, "no id"), (3, "three"), (5, TEXTS[11]), (2, "x" * 5000)]
    df = spark.createDataFrame([(i, t, 1, "f") for i, t in rows], "doc_id long, text string, row_start long, file string")
    path = str(tmp_path / "tokens")
    tokenfile.write_tokens(df, path, n=3)
    got = sorted(tokenfile.digests(spark, path).collect(), key=lambda r: r.start)
    hashed = {r.text: r.h for r in df.selectExpr("text", "xxhash64(text, text IS NULL) AS h").collect()}
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, hashed[r[1]]))
    start = 0
    for r, (i, t) in zip(got, order, strict=True):
        ids = np.array(plain(encoder, t or ""), dtype="<u4")
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (i, start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    assert [r.ids for r in tokenfile.read_tokens(spark, path, [7]).collect()] == [plain(encoder, "seven words")]
    assert tokenfile.round_trip(df.limit(0), path=str(tmp_path / "none")).count() == 0


def test_files_are_ordered_by_number(spark, tmp_path):
    """Beyond 100,000 files the names as texts have another order."""
    df = spark.range(400).selectExpr("id AS doc_id", "repeat('w ', CAST(id % 7 AS INT)) AS text")
    path = tmp_path / "tokens"
    tokenfile.write_tokens(df, str(path), n=4)
    want = {r.doc_id: r.start for r in tokenfile.digests(spark, str(path)).collect()}
    for old, new in ((3, 100_001), (2, 100_000), (1, 99_999), (0, 10_001)):
        for f in path.glob(f"*part-{old:05d}-*"):
            f.rename(f.with_name(f.name.replace(f"part-{old:05d}-", f"part-{new:05d}-")))
    assert {r.doc_id: r.start for r in tokenfile.digests(spark, str(path)).collect()} == want
    start = 0
    for i, r in sorted((r.doc_id, r) for r in tokenfile.digests(spark, str(path)).collect()):
        assert r.start == start
        start += r.n_tokens


def test_file_has_indexes_and_bloom_filters(spark, tmp_path):
    from pyarrow import orc

    df = spark.range(3000).selectExpr("id AS doc_id", "concat('text ', id) AS text")
    path = tmp_path / "tokens"
    tokenfile.write_tokens(df, str(path), n=2)
    files = sorted(path.glob("*.orc"))
    assert len(files) == 2
    last = -1
    for f in files:
        read = orc.ORCFile(str(f))
        assert read.row_index_stride == 1000
        ids = read.read(["doc_id"])["doc_id"].to_pylist()
        assert ids == sorted(ids) and ids[0] > last
        last = ids[-1]


@pytest.fixture(scope="module")
def codec():
    return pieces.Codec()


def brute(v, text):
    """The best path over the whole text at once."""
    if not text:
        return []
    s = pieces.MARK + text.replace(pieces.MARK, pieces._LITERAL).replace(" ", pieces.MARK)
    best, back = [0.0] + [float("-inf")] * len(s), [None] * (len(s) + 1)
    for e in range(1, len(s) + 1):
        for b in range(max(0, e - v.longest), e):
            found = v.pieces.get(s[b:e])
            if found and best[b] + found[1] > best[e]:
                best[e], back[e] = best[b] + found[1], (b, found[0])
        if not v.pieces.get(s[e - 1]) and best[e - 1] + v.unknown > best[e]:
            best[e], back[e] = best[e - 1] + v.unknown, (e - 1, -1)
    out, e = [], len(s)
    while e:
        b, i = back[e]
        out.append(v.fallback(s[b]) if i < 0 else [i])
        e = b
    return [x for part in reversed(out) for x in part]


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="abcdehingto   \n.▁日é€", max_size=90))
def test_codec(codec, text):
    ids = np.frombuffer(codec.encode(text), "<u4").tolist()
    assert ids == brute(codec.v, text)
    assert codec.decode(ids) == text
    flat, sizes = codec.encode_batch(pa.array([text, "a b", text]))
    assert split(flat, sizes) == [ids, np.frombuffer(codec.encode("a b"), "<u4").tolist(), ids]


def test_weights_follow_zipfs_law():
    got = pieces.log_weights([-3.0, -1.0, -1e9])
    assert got[1] > got[0] > got[2]
    assert sum(np.exp(got)) == pytest.approx(1)
    assert pieces.log_weights([-1.5, -2.0]) == [-1.5, -2.0]


def test_paths_are_near_the_librarys(spark, codec):
    """Not its ids, as those come from merges, but about as many and mostly the same."""
    import public_tokenizers
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()
    words = [w for r in docs for w in (r.text or "").split()]
    own = [np.frombuffer(codec.encode(w), "<u4").tolist() for w in words]
    other = library.encode(words)
    assert sum(map(len, own)) <= 1.01 * sum(map(len, other))
    assert sum(a == b for a, b in zip(own, other)) >= 0.8 * len(words)


def test_stream_keeps_a_small_window(codec):
    made = random.Random(5)
    text = pieces.MARK + "".join(made.choice("abcdehingto") for _ in range(20_000))
    search, ids, most = pieces.StreamingViterbi(codec.v), [], 0
    for at in range(0, len(text), 7):
        ids += search.feed(text[at : at + 7])
        most = max(most, search.most)
    ids += search.finish()
    assert ids == brute(codec.v, text[1:])
    assert most < 200
    assert list(pieces.stream_encode(codec.v, [text[:9], "", text[9:]])) == ids


def test_codec_columns(spark):
    rows = [(1, "two words", "k"), (2, None, "k"), (3, "", None), (3, "", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    coded = pieces.encode_column(df)
    back = pieces.decode_column(coded).collect()
    assert coded.columns == ["doc_id", "text", "ids", "piece_ids"]
    assert [r.decoded for r in back] == [t for _, t, _ in rows]
    assert pieces.encode_column(coded).columns == coded.columns
    got = pieces.round_trip(df).collect()
    assert [r.exact for r in got] == [True] * 4 and [r.n_pieces for r in got][1:] == [0, 0, 0]
    assert pieces.round_trip(df.limit(0)).count() == 0

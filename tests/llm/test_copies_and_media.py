import hashlib
import random
import struct
import time
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash

from quillstone.llm import audio, fingerprint, simhash


def naive_print(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words, word = [], ""
    for c in low + " ":
        if c in " \t\n\x0b\x0c\r":
            words += [word] if word else []
            word = ""
        else:
            word += c
    if not words:
        return 0
    grams = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def roots_of(prints, ids, distance=4):
    parent = list(range(len(prints)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= distance:
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    groups = {}
    for i in range(len(prints)):
        groups.setdefault(find(i), []).append(ids[i])
    return [min((x for x in groups[find(i)] if x is not None), default=None) for i in range(len(prints))]


def test_fingerprint():
    for t in (None, "", " \t", "One", "a b c d", "A b C d E f", "a\xa0b c", "日本 Éa b c d", "w " * 500, "x" * 9000):
        assert simhash.fingerprint(t) == naive_print(t)


def test_near_duplicates(spark):
    made = random.Random(7)
    base = [made.choice(["alpha", "beta", "gamma", "delta", "eps", "zeta", "eta"]) + str(made.randint(0, 9)) for _ in range(400)]
    texts = []
    for _ in range(40):
        copy = list(base)
        copy[made.randrange(400)] = "edit"
        texts.append(" ".join(copy))
    texts += [" ".join(made.choice("abcdefgh") for _ in range(made.randint(1, 30))) for _ in range(60)]
    texts += [None, "", "  ", "one two", "one two"]
    ids = list(range(100, 100 + len(texts)))
    made.shuffle(ids)
    ids[3], ids[50] = None, None
    df = spark.createDataFrame([(i, t, "c", 5) for i, t in zip(ids, texts)], "doc_id long, text string, fp string, root long")
    got = simhash.near_duplicates(df).collect()
    prints = [naive_print(t) for t in texts]
    roots = roots_of(prints, ids)
    expected = Counter((i, f"{p:016x}", r) for i, p, r in zip(ids, prints, roots))
    assert Counter((r.doc_id, r.fingerprint, r.component_id) for r in got) == expected
    for segments in (2, 4):
        again = simhash.near_duplicates(df, segments=segments).collect()
        assert Counter(map(tuple, again)) == Counter(map(tuple, got))
    assert simhash.near_duplicates(df.limit(0)).count() == 0


def test_crowded_slots_lose_no_link(spark):
    """Many fingerprints around a centre, some out of its reach."""
    made = random.Random(8)
    centre, prints = made.getrandbits(64), set()
    while len(prints) < 300:
        p = centre
        for _ in range(made.randint(0, 7)):
            p ^= 1 << made.randrange(64)
        prints.add(p)
    prints = sorted(prints)
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    df = spark.createDataFrame([(p, 1 + k % 5) for k, p in enumerate(signed)], "fp long, n long")
    found = simhash.components(simhash.links(df)).collect()
    got = {r.node: r.root for r in found}
    groups, expected = {}, {}
    for p in signed:
        groups.setdefault(got.get(p, p), set()).add(p)
    for p, root in zip(signed, roots_of(prints, list(range(len(prints))))):
        expected.setdefault(root, set()).add(p)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, expected.values()))


def test_sketch():
    made = random.Random(9)
    for n in (0, 1, 5, 12, 40, 400, 3000):
        shared = [made.getrandbits(64) for _ in range(made.randint(0, 300))]
        a, b = ([made.getrandbits(64) for _ in range(n)] for _ in range(2))
        only_a, only_b = fingerprint.differing(np.array(shared + a, np.uint64), np.array(b + shared, np.uint64))
        assert sorted(map(int, only_a)) == sorted(a) and sorted(map(int, only_b)) == sorted(b)
    s = fingerprint.Sketch(24, [1, 2, 3])
    assert fingerprint.Sketch.from_bytes(s.to_bytes()).minus(s).peel() == ([], [])
    assert fingerprint.Sketch(6, [made.getrandbits(64) for _ in range(50)]).peel() is None


def test_places_are_the_same_in_both_forms():
    digests = np.random.default_rng(1).integers(0, 1 << 63, 2000, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    for cells in (24, 3 << 22):
        s = fingerprint.Sketch(3)
        s.third = cells // 3
        assert fingerprint.wide_places(digests, s.third).T.tolist() == [list(s.places(d)) for d in digests.tolist()]
    assert len(np.unique(fingerprint.wide_places(digests, 1 << 22) % 2)) == 2  # odd places too


def test_tables_that_never_peel_end(monkeypatch):
    """Without a table that peels all digests are compared."""
    monkeypatch.setattr(fingerprint, "wide_peel", lambda a, b, cells: None)
    a, b = np.arange(2000, dtype=np.uint64), np.arange(1500, 4000, dtype=np.uint64)
    only_a, only_b = fingerprint.differing(a, b)
    assert only_a.tolist() == list(range(1500)) and only_b.tolist() == list(range(2000, 4000))


def test_six_million_line_breaks():
    began = time.time()
    own = "\n" * 6_000_000
    n, _, _, _, near, next_ = fingerprint.compare(own, "x")
    assert n == 6_000_000 and next_ == 0 and near == pytest.approx(0.5, abs=1e-6)
    assert time.time() - began < 120


def like(a, b):
    x, y = (Counter(t.split("\n")) if t else Counter() for t in (a, b))
    union = sum((x | y).values())
    return sum((x & y).values()) / union if union else 1.0


def test_fingerprints(spark):
    made = random.Random(10)
    rows = [(i * 3, "\n".join(made.choice(["p", "q", "日本", "", "long line"]) + str(made.randint(0, 30)) for _ in range(made.randint(0, 40)))) for i in range(200)]
    rows += [(-5, None), (None, "no id"), (None, None), (9, "again"), (9, "again"), (1 << 40, "x" * 50_000)]
    df = spark.createDataFrame([(i, t, 1, "f") for i, t in rows], "doc_id long, text string, _bucket int, fingerprint string")
    hashed = {r.text: r.h for r in df.selectExpr("text", "xxhash64(text, text IS NULL) AS h").collect()}
    for n in (1, 7):
        got = fingerprint.fingerprints(df, n=n).collect()
        order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, hashed[r[1]]))
        expected = Counter()
        for (i, t), (_, after) in zip(order, order[1:] + order[:1]):
            t, after = t or "", after or ""
            half = len(t) // 2
            other = t[: len(t) - half] + after[:half]
            expected[i, len(t), hashlib.sha256(other.encode()).hexdigest(), round(like(t, other), 9), round(like(t, after), 9)] += 1
        assert Counter((r.doc_id, r.n_chars, r.edited_sha256, round(r.near_edited, 9), round(r.near_next, 9)) for r in got) == expected
    assert len({r.fingerprint for r in got if r.doc_id == 9 and r.n_chars == 5}) == 1
    assert fingerprint.fingerprints(df.limit(0)).count() == 0


def test_audio_tables():
    assert audio.MULAW_PCM[[0x00, 0x7F, 0x80, 0xFF]].tolist() == [-32124, 0, 32124, 0]
    assert audio.ALAW_PCM[[0x55, 0xD5, 0x2A, 0xAA]].tolist() == [-8, 8, -32256, 32256]


def naive_adpcm(block):
    value = int.from_bytes(block[:2], "little", signed=True)
    index, out = min(block[2], 88), [value]
    for byte in block[4:]:
        for code in (byte & 15, byte >> 4):
            step = int(audio.STEPS[index])
            move = (step >> 3) + (step if code & 4 else 0) + (step >> 1 if code & 2 else 0) + (step >> 2 if code & 1 else 0)
            value = max(-32768, min(32767, value - move if code & 8 else value + move))
            index = max(0, min(88, index + int(audio.INDEX_MOVES[code])))
            out.append(value)
    return out


def test_adpcm():
    blocks = np.random.default_rng(3).integers(0, 256, (20, 64), dtype=np.uint8)
    assert audio.decode_adpcm(blocks).tolist() == [naive_adpcm(bytes(b)) for b in blocks]
    wave = (8000 * np.sin(np.arange(2000) / 20)).astype(np.int16)
    back = audio.decode_adpcm(audio.encode_adpcm(wave)).ravel()[:2000]
    assert np.abs(back.astype(int) - wave)[200:].mean() < 300


@pytest.mark.parametrize("kind", [audio.PCM, audio.ALAW, audio.MULAW, audio.ADPCM])
def test_wave(kind):
    data = bytes(range(256)) * 2
    wave = audio.read_wave(audio.wave_file(data, kind))
    assert (wave.kind, wave.channels, wave.rate, wave.data) == (kind, 1, 8000, data)
    assert len(audio.decode(audio.wave_file(data, kind))[1])


def test_decode_column(spark):
    df = spark.createDataFrame([(1, audio.wave_file(b"\xff" * 80)), (2, None), (3, b"junk")], "k long, media binary")
    got = audio.decode_column(df).collect()
    wave = audio.read_wave(bytes(got[0].pcm_media))
    assert (wave.kind, wave.rate, len(wave.data)) == (audio.PCM, 16000, 320)
    assert got[1].pcm_media is None and got[2].pcm_media is None


def form_of(data, kind, channels, rate, align, bits):
    form = struct.pack("<HHIIHH", kind, channels, rate, rate * align, align, bits)
    body = b"WAVE" + struct.pack("<4sI", b"fmt ", len(form)) + form + struct.pack("<4sI", b"data", len(data)) + data
    return struct.pack("<4sI", b"RIFF", len(body)) + body


def test_malformed_media_are_null(spark):
    good = audio.wave_file(b"\x00" * 128, audio.ADPCM)
    bad = [form_of(b"\1" * 64, audio.ADPCM, 1, 8000, 0, 4), form_of(b"\1" * 64, audio.ADPCM, 1, 8000, 3, 4), form_of(b"\1" * 8, audio.MULAW, 1, 0, 1, 8)]
    bad += [form_of(b"\1" * 8, audio.MULAW, 0, 8000, 1, 8), form_of(b"\1" * 8, audio.PCM, 1, 8000, 2, 12), form_of(b"\1" * 8, 3, 1, 8000, 4, 32)]
    bad += [good[:k] for k in (0, 3, 11, 14, 30)] + [good[:12] + good[-136:], b"RIFF\0\0\0\0WAVEfmt \2\0\0\0ab", form_of(b"\1" * 66, audio.ADPCM, 2, 8000, 66, 4)]
    rows = [(i, x) for i, x in enumerate([good, *bad])]
    got = {r.k: r.pcm_media for r in audio.decode_column(spark.createDataFrame(rows, "k long, media binary")).collect()}
    assert got[0] is not None
    assert [k for k, x in got.items() if x is not None] == [0]
    assert audio.to_pcm(good[:-70], 8000) is not None  # data that ends early


def test_channels_and_depths():
    left, right = np.array([1000, -2000, 32767, 5], "<i2"), np.array([3000, -2000, 32767, 6], "<i2")
    both = np.stack([left, right], 1)
    assert audio.decode(form_of(both.tobytes(), audio.PCM, 2, 8000, 4, 16))[1].tolist() == [2000, -2000, 32767, 5]
    assert audio.decode(form_of(bytes([0, 128, 255]), audio.PCM, 1, 8000, 1, 8))[1].tolist() == [-32768, 0, 32512]
    deep = np.array([-(1 << 23), 0x123456, -1], "<i4").view(np.uint8).reshape(-1, 4)
    assert audio.decode(form_of(deep[:, :3].tobytes(), audio.PCM, 1, 8000, 3, 24))[1].tolist() == [-32768, 0x1234, -1]
    assert audio.decode(form_of((deep.view("<i4") << 8).tobytes(), audio.PCM, 1, 8000, 4, 32))[1].tolist() == [-32768, 0x1234, -1]
    codes = bytes(range(0, 250, 5))
    assert audio.decode(form_of(codes, audio.MULAW, 2, 8000, 2, 8))[1].tolist() == [(int(a) + int(b)) // 2 for a, b in audio.MULAW_PCM[np.frombuffer(codes, np.uint8)].reshape(-1, 2)]
    made = np.random.default_rng(4).integers(0, 256, (2, 3, 64), dtype=np.uint8)  # two channels, three blocks
    mixed = b"".join(made[c, b, 4 * g : 4 * g + 4].tobytes() for b in range(3) for g in range(16) for c in range(2))
    own = [[x for b in made[c] for x in naive_adpcm(bytes(b))] for c in range(2)]
    assert audio.decode(form_of(mixed, audio.ADPCM, 2, 8000, 128, 4))[1].tolist() == [(a + b) // 2 for a, b in zip(*own)]


def test_resampling(monkeypatch):
    at = np.arange(16000)
    low, high = (10000 * np.sin(2 * np.pi * f * at / 16000) for f in (300, 7000))
    down = audio.resample((low + high).astype(np.int16), 16000, 8000)
    assert len(down) == 8000
    assert np.abs(down[100:-100] - low[::2][100:-100]).max() < 300  # 7 kHz does not come back as 1 kHz
    whole = [audio.resample(low.astype(np.int16), 16000, to) for to in (8000, 11025, 22050)]
    monkeypatch.setattr(audio, "PIECE", 1000)
    assert [audio.resample(low.astype(np.int16), 16000, to).tolist() for to in (8000, 11025, 22050)] == [x.tolist() for x in whole]
    assert audio.resample(np.zeros(0, np.int16), 8000, 16000).tolist() == []


def naive_feature(payload):
    """The feature of a payload, sample by sample."""
    out = []
    blocks = [x for i in range(0, len(payload), 64) for x in naive_adpcm(payload[i : i + 64])]
    mulaw = [int(audio.MULAW_PCM[x]) for x in payload]
    for pcm in (mulaw, [int(audio.ALAW_PCM[x]) for x in payload], blocks):
        out += [int((sum(x * x for x in pcm) / len(pcm)) ** 0.5), sum((a >= 0) != (b >= 0) for a, b in zip(pcm, pcm[1:])), max(map(abs, pcm))]
    up = [y for a, b in zip(mulaw, [*mulaw[1:], mulaw[-1]]) for y in (a, (a + b) >> 1)]
    return ":".join(map(str, [*out, zlib.crc32(np.array(up, "<i2").tobytes())]))


def test_text_media(spark):
    texts = [None, "", "a", "é" * 32, "x" * 64, "x" * 65, "long " * 300_000, "a"]
    df = spark.createDataFrame([(i, t, "z") for i, t in enumerate(texts)] + [(None, "q", "z")], "doc_id long, text string, feature string")
    got = {r.doc_id: r for r in audio.text_media(df).collect()}
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        payload = raw + b"\0" * ((-len(raw)) % 64 or (0 if raw else 64))
        r = got[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        assert r.media_bytes > r.payload_bytes
        assert r.pcm_bytes == 44 + 4 * r.payload_bytes
        if len(payload) < 100_000:
            assert r.feature == naive_feature(payload)
    assert got[2][1:] == got[7][1:] and got[0][1:] == got[1][1:]
    assert audio.text_media(df.limit(0)).count() == 0


def test_pipeline(spark):
    import corpus_pipeline

    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    assert out.columns == [*docs.columns, "piece_ids"]
    assert 0 < out.select("doc_id").distinct().count() < docs.count()
    assert out.filter("text RLIKE '[a-z]@[a-z0-9]+[.]'").count() == 0
    assert len(corpus_pipeline.STAGES) == 5

"""SentencePiece encoding and decoding by streaming Viterbi.

The best segmentation of a text maximises the sum of its pieces' scores.  The
search keeps a window of positions no longer than the longest piece plus what
is not yet decided: as soon as the backpointers of all live positions meet in
one boundary, the ids up to there are final and leave the window.

The scores of a BPE vocabulary are ranks of merges and no likelihoods.  There
a piece weighs what Zipf's law (with Mandelbrot's offset) gives its rank, so the
best path is the likeliest under that law; nothing is trained.

No piece of the vocabulary has a space mark after another character, so every
path has a boundary before a space mark; what lies between two such boundaries
is remembered by each worker.
"""

from __future__ import annotations

import hashlib
import math
import re
import struct
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillstone.llm.common import slices

MARK = "▁"  # stands for a space
_LITERAL = "\ud800"  # a MARK that is part of a text; no valid text has this
#: Chunks whose ids a worker remembers; what does not fit is searched anew.
MEMO = 150_000
#: What a character without a piece costs, below the lowest score.
UNKNOWN_BELOW = 10.0
#: What is added to a rank before its logarithm is taken.
OFFSET = 30


def log_weights(scores: list[float]) -> list[float]:
    """The scores themselves, or the logarithms of Zipf's law for ranks: whole
    scores are ranks, as hardly any logarithm is whole."""
    if any(s != int(s) for s in scores):
        return scores
    order = sorted(range(len(scores)), key=lambda i: (-scores[i], i))
    whole = math.log(sum(1 / (r + OFFSET) for r in range(1, len(scores) + 1)))
    out = [0.0] * len(scores)
    for r, i in enumerate(order, 1):
        out[i] = -math.log(r + OFFSET) - whole
    return out


class Vocabulary:
    """Pieces, log weights and byte pieces of a SentencePiece model file."""

    def __init__(self, model: str):
        import public_tokenizers
        import sentencepiece

        m = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(model))
        self.bytes_of: list[bytes] = []
        self.byte_id = [m.unk_id()] * 256
        self.pieces: dict[str, tuple[int, float] | None] = {}
        for i in range(m.get_piece_size()):
            piece = m.id_to_piece(i)
            if m.is_byte(i):
                self.byte_id[int(piece[3:5], 16)] = i
                self.bytes_of.append(bytes([int(piece[3:5], 16)]))
            elif m.is_control(i) or m.is_unknown(i) or m.is_unused(i):
                self.bytes_of.append(b"")
            else:
                self.pieces[piece] = (i, m.get_score(i))
                self.bytes_of.append(piece.replace(MARK, " ").encode())
        if any(MARK in p.lstrip(MARK) for p in self.pieces):
            raise ValueError("a piece has a space mark after another character")
        for piece, weight in zip(list(self.pieces), log_weights([x[1] for x in self.pieces.values()])):
            self.pieces[piece] = (self.pieces[piece][0], weight)
        self.longest = max(map(len, self.pieces))
        self.unknown = min(s for _, s in self.pieces.values()) - UNKNOWN_BELOW
        for piece in list(self.pieces):
            for k in range(1, len(piece)):
                self.pieces.setdefault(piece[:k], None)

    def fallback(self, char: str) -> list[int]:
        char = MARK if char == _LITERAL else char
        return [self.byte_id[b] for b in char.encode("utf-8", "surrogatepass")]


class StreamingViterbi:
    """Feed characters, get ids as soon as they are final.

    Of equal scores the path whose last piece is longest wins.
    """

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self.text = ""  # what is not final, from the last boundary on
        self.score = [0.0]  # of the best path to each position of the text
        self.back: list[tuple[int, int]] = [(0, -1)]  # start and id of its last piece
        self.done = 0  # positions whose pieces were tried as starts
        self.most = 0  # the longest window there was

    def feed(self, chars: str) -> list[int]:
        self.text += chars
        n = len(self.text)
        self.score += [-np.inf] * (n + 1 - len(self.score))
        self.back += [(0, -1)] * (n + 1 - len(self.back))
        self.most = max(self.most, n)
        # a start is tried once all its pieces could be in the text
        self._advance(n - self.v.longest + 1)
        return self._commit() if len(self.text) >= 2 * self.v.longest else []

    def finish(self) -> list[int]:
        """The ids of what is left; the search is over."""
        self._advance(len(self.text))
        return self._path(len(self.text))

    def _advance(self, until: int) -> None:
        look, text, score, back, n = self.v.pieces.get, self.text, self.score, self.back, len(self.text)
        for s in range(self.done, until):
            base, alone = score[s], True
            for e in range(s + 1, n + 1):
                found = look(text[s:e], 0)
                if not found:
                    if found is None:  # the start of a piece
                        continue
                    break
                if e == s + 1:
                    alone = False
                at = base + found[1]
                if at > score[e]:
                    score[e], back[e] = at, (s, found[0])
            if alone and base + self.v.unknown > score[s + 1]:
                score[s + 1], back[s + 1] = base + self.v.unknown, (s, -1)
        self.done = max(self.done, until)

    def _commit(self) -> list[int]:
        """The ids before the boundary in which all live paths meet."""
        live = {p for p in range(max(0, self.done), len(self.text) + 1) if self.score[p] > -np.inf}
        while len(live) > 1:
            last = max(live)
            live.remove(last)
            live.add(self.back[last][0])
        at = live.pop()
        if not at:
            return []
        ids = self._path(at)
        least = self.score[at]
        self.text, self.done = self.text[at:], self.done - at
        self.score = [x - least for x in self.score[at:]]
        self.back = [(max(0, s - at), i) for s, i in self.back[at:]]
        return ids

    def _path(self, end: int) -> list[int]:
        ids, back = [], self.back
        while end:
            start, piece = back[end]
            if piece < 0:
                ids.extend(reversed(self.v.fallback(self.text[start])))
            else:
                ids.append(piece)
            end = start
        ids.reverse()
        return ids


def stream_encode(v: Vocabulary, parts: Iterable[str]) -> Iterator[int]:
    """Ids of the text that ``parts`` make up, with space marks in place."""
    search = StreamingViterbi(v)
    for part in parts:
        for at in range(0, len(part), 4 * v.longest):
            yield from search.feed(part[at : at + 4 * v.longest])
    yield from search.finish()


_codecs: dict[str, "Codec"] = {}


def codec(model: str) -> "Codec":
    """The worker's own codec, kept between tasks."""
    if model not in _codecs:
        _codecs[model] = Codec(model)
    return _codecs[model]


class Codec:
    def __init__(self, model: str = "piece_bpe_32k.model", memo: int = MEMO):
        self.v = Vocabulary(model)
        self.memo: dict[str, bytes] = {}  # of a word after one space mark
        self.most = memo

    def _chunk(self, chunk: str) -> bytes:
        if len(chunk) > 4 * self.v.longest:
            return np.fromiter(stream_encode(self.v, [chunk]), dtype="<u4").tobytes()
        search = StreamingViterbi(self.v)
        ids = search.feed(chunk) + search.finish()
        return struct.pack(f"<{len(ids)}I", *ids)

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers; none for an empty text."""
        if not text:
            return b""
        text = MARK + text.replace(MARK, _LITERAL).replace(" ", MARK)
        return b"".join(map(self._chunk, re.findall(f"{MARK}+[^{MARK}]*", text)))

    def encode_batch(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids one after the other, and how many each text has.

        Each different word of the batch is looked up or searched once; texts
        with other than single spaces between words are encoded alone.
        """
        apart = pc.match_substring_regex(texts, f"^$|  |^ | $|{MARK}")
        alone = np.flatnonzero(apart.to_numpy(zero_copy_only=False)).tolist()
        lists = pc.split_pattern(pc.if_else(apart, "", texts), " ")
        cuts = lists.offsets.to_numpy()
        coded = lists.values.slice(cuts[0], cuts[-1] - cuts[0]).dictionary_encode()
        cuts = (cuts - cuts[0]).astype(np.int64)
        at = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        words, memo = coded.dictionary.to_pylist(), self.memo
        table = list(map(memo.get, words))
        for k, ids in enumerate(table):
            if ids is None:
                table[k] = ids = self._chunk(MARK + words[k])
                if len(memo) < self.most and len(words[k]) <= 40:
                    memo[words[k]] = ids
        at[cuts[alone]] = len(words) + np.arange(len(alone))
        table += [self.encode(texts[i].as_py()) for i in alone]
        sizes = np.fromiter(map(len, table), np.int64, len(table)) // 4
        pool = np.frombuffer(b"".join(table), dtype="<u4")
        each = sizes[at]
        ends = np.cumsum(each)
        take = np.repeat(((np.cumsum(sizes) - sizes)[at] - (ends - each)).astype(np.int32), each)
        take += np.arange(len(take), dtype=np.int32)
        return pool[take], np.diff(np.concatenate([[0], ends[cuts[1:] - 1]]))

    def decode(self, ids: Iterable[int]) -> str:
        data = b"".join(map(self.v.bytes_of.__getitem__, ids))
        return data.removeprefix(b" ").decode("utf-8", "surrogatepass")


def encode_column(docs: DataFrame, text: str = "text", out: str = "piece_ids", model: str = "piece_bpe_32k.model") -> DataFrame:
    """``docs`` with ``out``, the ids of ``text``; null texts give null, empty
    ones an empty list.  All other columns and rows stay as they are; a column
    already named ``out`` is replaced."""
    names = [c for c in docs.columns if c != out]
    at = names.index(text)
    schema = T.StructType([*docs.select(*names).schema.fields, T.StructField(out, T.ArrayType(T.IntegerType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(model)
        for batch in batches:
            for part in slices(batch, at):
                flat, sizes = own.encode_batch(pc.fill_null(part.column(at), ""))
                offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
                ids = pa.ListArray.from_arrays(offsets, pa.array(flat.view("<i4")), mask=pc.is_null(part.column(at)))
                yield pa.RecordBatch.from_arrays([*part.columns, ids], [*names, out])

    return docs.select(*names).mapInArrow(run, schema)


def decode_column(df: DataFrame, ids: str = "piece_ids", out: str = "decoded", model: str = "piece_bpe_32k.model") -> DataFrame:
    """``df`` with ``out``, the text of ``ids``; null ids give null."""
    names = [c for c in df.columns if c != out]
    at = names.index(ids)
    schema = T.StructType([*df.select(*names).schema.fields, T.StructField(out, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(model)
        for batch in batches:
            texts = [None if x is None else own.decode(x) for x in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*names, out])

    return df.select(*names).mapInArrow(run, schema)


def round_trip(docs: DataFrame, model: str = "piece_bpe_32k.model") -> DataFrame:
    """``doc_id, n_pieces, ids_crc32, decoded_sha256, exact`` of every text.

    A null text counts as empty, which has no pieces.  ``docs`` needs
    ``doc_id`` and ``text``; other columns are not read.  An empty table gives
    an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(model)
        names = ["doc_id", "n_pieces", "ids_crc32", "decoded_sha256", "exact"]
        kinds = [pa.int64(), pa.string(), pa.bool_()]
        for batch in batches:
            for part in slices(batch, 1):
                texts = pc.fill_null(part.column(1), "")
                flat, sizes = own.encode_batch(texts)
                out, at = [], 0
                for text, size in zip(texts.to_pylist(), sizes.tolist()):
                    ids = flat[at : at + size]
                    at += size
                    back = own.decode(ids.tolist())
                    sha = hashlib.sha256(back.encode("utf-8", "surrogatepass")).hexdigest()
                    out.append((zlib.crc32(ids), sha, back == text))
                columns = [pa.array(c, k) for c, k in zip(zip(*out), kinds)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sizes), *columns], names)

    schema = T.StructType(
        [
            T.StructField("doc_id", docs.schema["doc_id"].dataType),
            T.StructField("n_pieces", T.LongType()),
            T.StructField("ids_crc32", T.LongType()),
            T.StructField("decoded_sha256", T.StringType()),
            T.StructField("exact", T.BooleanType()),
        ]
    )
    return docs.select("doc_id", "text").mapInArrow(run, schema)

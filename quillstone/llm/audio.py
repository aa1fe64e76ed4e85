"""Telephony audio columns: mu-law, A-law and ADPCM to resampled PCM.

G.711 codes expand through tables of 256 entries made from the companding
rules.  IMA ADPCM blocks decode in lockstep: one numpy step per sample position
advances all blocks of a batch.  Channels are averaged; resampling is linear,
after a low-pass where the rate falls.  Stored forms are WAVE files, so a payload
stored as codes is read back byte for byte.  Long signals go in pieces.
"""

from __future__ import annotations

import hashlib
import math
import struct
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

PCM, ALAW, MULAW, ADPCM = 1, 6, 7, 0x11
#: An ADPCM block: predictor, step index and a zero byte, then two codes a byte.
BLOCK = 64
EXTENSIBLE = 0xFFFE
#: Samples that are worked on at a time.
PIECE = 1 << 20
FASTEST = 1 << 20  # samples a second that a file may claim


def mulaw_table() -> np.ndarray:
    """PCM of all 256 mu-law codes (ITU-T G.711)."""
    code = ~np.arange(256, dtype=np.int64) & 0xFF
    size = (((code & 0x0F) << 3) + 0x84) << ((code & 0x70) >> 4)
    return np.where(code & 0x80, 0x84 - size, size - 0x84).astype(np.int16)


def alaw_table() -> np.ndarray:
    """PCM of all 256 A-law codes (ITU-T G.711)."""
    code = np.arange(256, dtype=np.int64) ^ 0x55
    part, low = (code & 0x70) >> 4, (code & 0x0F) << 4
    size = np.where(part == 0, low + 8, (low + 0x108) << np.maximum(part - 1, 0))
    return np.where(code & 0x80, size, -size).astype(np.int16)


def step_table() -> np.ndarray:
    """The 89 step sizes of IMA ADPCM (fixed values of the format)."""
    # fmt: off
    return np.array([
        7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45,
        50, 55, 60, 66, 73, 80, 88, 97, 107, 118, 130, 143, 157, 173, 190, 209, 230,
        253, 279, 307, 337, 371, 408, 449, 494, 544, 598, 658, 724, 796, 876, 963,
        1060, 1166, 1282, 1411, 1552, 1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327,
        3660, 4026, 4428, 4871, 5358, 5894, 6484, 7132, 7845, 8630, 9493, 10442,
        11487, 12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794,
        32767], dtype=np.int32)
    # fmt: on


#: How a code moves the step index (fixed values of the format).
INDEX_MOVES = np.array([-1, -1, -1, -1, 2, 4, 6, 8] * 2, dtype=np.int32)

MULAW_PCM, ALAW_PCM, STEPS = mulaw_table(), alaw_table(), step_table()


def _adpcm_moves() -> np.ndarray:
    """The signed difference of every (step index, code)."""
    step, code = STEPS[:, None], np.arange(16, dtype=np.int32)[None, :]
    size = (step >> 3) + np.where(code & 4, step, 0) + np.where(code & 2, step >> 1, 0) + np.where(code & 1, step >> 2, 0)
    return np.where(code & 8, -size, size).astype(np.int32)


ADPCM_MOVES = _adpcm_moves()
_FLAT_MOVES = ADPCM_MOVES.ravel()
_NEXT_INDEX = np.clip(np.arange(89, dtype=np.int32)[:, None] + INDEX_MOVES[None, :], 0, 88).astype(np.int32).ravel()


def decode_adpcm(blocks: np.ndarray) -> np.ndarray:
    """PCM of ``blocks`` (n, block bytes): one sample from each header and two
    from each byte after it.  An index beyond the table counts as its end."""
    n, width = blocks.shape
    value = blocks[:, 0].astype(np.int32) | (blocks[:, 1].astype(np.int32) << 8)
    value = np.where(value >= 32768, value - 65536, value).astype(np.int32)
    index = np.minimum(blocks[:, 2], 88).astype(np.int32)
    out = np.empty((2 * (width - 4) + 1, n), dtype=np.int16)
    out[0] = value
    codes = np.ascontiguousarray(blocks[:, 4:].T)
    for k in range(width - 4):
        for half, code in enumerate((codes[k] & 15, codes[k] >> 4)):
            at = (index << 4) + code
            value = np.clip(value + _FLAT_MOVES[at], -32768, 32767)
            index = _NEXT_INDEX[at]
            out[2 * k + half + 1] = value
    return np.ascontiguousarray(out.T)


def encode_adpcm(pcm: np.ndarray, width: int = BLOCK) -> np.ndarray:
    """Blocks of ``width`` bytes that decode to about ``pcm``; the last sample
    is repeated to fill the last block."""
    per = 2 * (width - 4) + 1
    n = max(1, -(-len(pcm) // per))
    full = np.zeros(n * per, np.int32) if not len(pcm) else np.concatenate([pcm, np.repeat(pcm[-1:], n * per - len(pcm))]).astype(np.int32)
    rows = full.reshape(n, per)
    blocks = np.zeros((n, width), np.uint8)
    value, index = rows[:, 0].copy(), np.full(n, 40, np.int32)
    blocks[:, 0], blocks[:, 1], blocks[:, 2] = value & 255, (value >> 8) & 255, index
    for k in range(1, per):
        guess = value[:, None] + ADPCM_MOVES[index]
        code = np.abs(guess - rows[:, k, None]).argmin(1).astype(np.int32)
        at = (index << 4) + code
        value, index = np.clip(value + _FLAT_MOVES[at], -32768, 32767), _NEXT_INDEX[at]
        blocks[:, 4 + (k - 1) // 2] |= (code << (4 * ((k - 1) % 2))).astype(np.uint8)
    return blocks


def wave_file(data: bytes, kind: int = MULAW, rate: int = 8000, width: int = BLOCK) -> bytes:
    """A one-channel WAVE file of ``data`` in the stored form ``kind``."""
    bits = {PCM: 16, ADPCM: 4}.get(kind, 8)
    align = {PCM: 2, ADPCM: width}.get(kind, 1)
    per = 2 * (width - 4) + 1
    speed = rate * align // per if kind == ADPCM else rate * align
    more = struct.pack("<HH", 2, per) if kind == ADPCM else b"" if kind == PCM else struct.pack("<H", 0)
    form = struct.pack("<HHIIHH", kind, 1, rate, speed, align, bits) + more
    n = len(data) // align * (per if kind == ADPCM else 1)
    fact = b"" if kind == PCM else struct.pack("<4sII", b"fact", 4, n)
    body = b"WAVE" + struct.pack("<4sI", b"fmt ", len(form)) + form + fact + struct.pack("<4sI", b"data", len(data)) + data + b"\0" * (len(data) % 2)
    return struct.pack("<4sI", b"RIFF", len(body)) + body


class Wave(NamedTuple):
    kind: int
    channels: int
    rate: int
    align: int  # bytes of a frame or an ADPCM block
    bits: int
    data: bytes


def read_wave(media: bytes) -> Wave:
    """The form and the data of a WAVE file; data that ends early is what there is."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a WAVE file")
    at, form = 12, None
    while at + 8 <= len(media):
        name, size = struct.unpack_from("<4sI", media, at)
        if name == b"fmt ":
            kind, channels, rate, _, align, bits = struct.unpack_from("<HHIIHH", media, at + 8)
            if kind == EXTENSIBLE and size >= 40:
                kind = struct.unpack_from("<H", media, at + 32)[0]
            form = kind, channels, rate, align, bits
        elif name == b"data":
            if form is None:
                raise ValueError("data before their form")
            return Wave(*form, media[at + 8 : at + 8 + size])
        at += 8 + size + size % 2
    raise ValueError("no data in the WAVE file")


def _linear(raw: np.ndarray, bits: int) -> np.ndarray:
    """16-bit samples of little-endian PCM bytes: 8 bits are unsigned, of more
    than 16 the upper ones count."""
    width = bits // 8
    if bits not in (8, 16, 24, 32):
        raise ValueError(f"{bits} bits a sample")
    if width == 1:
        return ((raw.astype(np.int16) - 128) << 8).astype(np.int16)
    own = raw[: len(raw) // width * width].reshape(-1, width)
    return np.ascontiguousarray(own[:, -2:]).view("<i2").ravel()


def _apart(raw: np.ndarray, align: int, channels: int) -> np.ndarray:
    """One channel's ADPCM blocks after the other's: of each block the headers,
    then four bytes of each channel in turn."""
    each = align // channels
    if align < 4 * channels or align != each * channels or channels > 1 and each % 4:
        raise ValueError(f"ADPCM blocks of {align} bytes for {channels} channels")
    blocks = raw[: len(raw) // align * align].reshape(-1, align // (4 if channels > 1 else 1) // channels, channels, 4 if channels > 1 else 1)
    return np.ascontiguousarray(blocks.transpose(2, 0, 1, 3)).reshape(channels, -1, each)


def decode(media: bytes) -> tuple[int, np.ndarray]:
    """Rate and PCM samples of a WAVE file of any of the four forms; several
    channels are averaged.  ValueError if it is no such file."""
    kind, channels, rate, align, bits, data = read_wave(media)
    if not channels or not 0 < rate <= FASTEST:
        raise ValueError(f"{channels} channels at rate {rate}")
    raw = np.frombuffer(data, np.uint8)
    if kind == ADPCM:
        own = _apart(raw, align, channels)
        pcm = np.stack([decode_adpcm(blocks).ravel() for blocks in own], 1)
    elif kind in (MULAW, ALAW, PCM):
        pcm = _linear(raw, bits) if kind == PCM else (MULAW_PCM if kind == MULAW else ALAW_PCM)[raw]
        pcm = pcm[: len(pcm) // channels * channels].reshape(-1, channels)
    else:
        raise ValueError(f"unknown form {kind}")
    if channels == 1:
        return rate, pcm[:, 0]
    return rate, (pcm.sum(1, dtype=np.int64) // channels).astype(np.int16)


def _smooth(pcm: np.ndarray, rate: int, to: int) -> np.ndarray:
    """``pcm`` without what is above half of the lower rate ``to``, by a
    windowed sinc; float32."""
    half = 16 * -(-rate // to)
    n = np.arange(-half, half + 1)
    taps = np.sinc(n * to / rate) * np.hanning(2 * half + 3)[1:-1]
    taps /= taps.sum()
    out = np.empty(len(pcm), np.float32)
    for at in range(0, len(pcm), PIECE):
        part = np.pad(pcm[max(0, at - half) : at + PIECE + half].astype(np.float64), (max(0, half - at), max(0, at + PIECE + half - len(pcm))), "edge")
        own = np.convolve(part, taps, "valid")
        out[at : at + PIECE] = own[: len(out) - at]
    return out


def resample(pcm: np.ndarray, rate: int, to: int) -> np.ndarray:
    """``pcm`` at the rate ``to``, by linear interpolation, after a low-pass if
    that is lower."""
    if rate == to or not len(pcm):
        return pcm.astype(np.int16)
    if to == 2 * rate:
        out = np.empty(2 * len(pcm), np.int16)
        out[::2] = pcm
        out[1:-1:2] = (pcm[:-1].astype(np.int32) + pcm[1:]) >> 1
        out[-1] = pcm[-1]
        return out
    source = _smooth(pcm, rate, to) if to < rate else pcm
    out = np.empty(len(pcm) * to // rate, np.int16)
    for at in range(0, len(out), PIECE):
        where = np.arange(at, min(len(out), at + PIECE)) * (rate / to)
        low = np.minimum(where.astype(np.int64), len(pcm) - 1)
        high = np.minimum(low + 1, len(pcm) - 1)
        mixed = source[low] + (source[high].astype(np.float64) - source[low]) * (where - low)
        out[at : at + PIECE] = np.clip(mixed.round(), -32768, 32767)
    return out


def decode_column(df: DataFrame, media: str = "media", out: str = "pcm_media", rate: int = 16000) -> DataFrame:
    """``df`` with ``out``: the binary column ``media`` as a PCM WAVE file at
    ``rate``, one channel of 16 bits.  Null or unreadable media, malformed ones
    of any kind, give null; other columns stay."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for part in batches:
            yield pa.array([to_pcm(x.as_py(), rate) for x in part], pa.binary())

    return df.withColumn(out, F.arrow_udf(run, T.BinaryType())(media))


def to_pcm(media: bytes | None, rate: int) -> bytes | None:
    """A PCM WAVE file of a WAVE file; None if it cannot be read."""
    if media is None:
        return None
    try:
        own, pcm = decode(bytes(media))
    except (ValueError, struct.error):
        return None
    return wave_file(resample(pcm, own, rate).tobytes(), PCM, rate)


def features(payload: np.ndarray, adpcm: np.ndarray, stored: bytes) -> str:
    """Integers over the three readings of a payload: root mean square, sign
    changes and peak of its mu-law and A-law PCM and of its ADPCM blocks, and
    the crc32 of the samples in its stored PCM."""
    out = []
    for source, table in ((payload, MULAW_PCM), (payload, ALAW_PCM), (adpcm, None)):
        squares, changes, peak, last = 0, 0, 0, None
        for at in range(0, len(source), PIECE):
            pcm = source[at : at + PIECE] if table is None else table[source[at : at + PIECE]]
            wide = pcm.astype(np.float64)  # squares of whole numbers add up exactly
            up = pcm >= 0
            squares += int(np.dot(wide, wide))
            changes += int(np.count_nonzero(up[1:] != up[:-1])) + (last is not None and bool(up[0]) != last)
            peak, last = max(peak, -int(pcm.min()), int(pcm.max())), bool(up[-1])
        out += [int(math.sqrt(squares / len(source))), int(changes), peak]
    out.append(zlib.crc32(read_wave(stored).data))
    return ":".join(map(str, out))


def text_media(docs: DataFrame) -> DataFrame:
    """Every text as a mu-law WAVE file, read back, stored as PCM at 16 kHz and
    measured.

    The payload is the text's UTF-8, filled with zero bytes to a positive
    multiple of 64.  ``docs`` needs ``doc_id``, of any type, and ``text``;
    other columns are not read.  A null text counts as empty; an empty table
    gives an empty result; equal texts give equal values.  ``pcm_bytes`` and
    ``pcm_crc32`` are of the stored PCM file.  ADPCM blocks of about a megabyte
    of texts decode together; a longer text decodes alone.
    """

    def rows(group: list[tuple]) -> pa.RecordBatch:
        media, sizes, kept = [], [], []
        for doc_id, text in group:
            data = (text or "").encode("utf-8", "surrogatepass")
            payload = data + b"\0" * (-len(data) % 64 or (0 if data else 64))
            media.append(wave_file(payload))
            sizes.append(len(data))
            kept.append(doc_id)
        back = [read_wave(m).data for m in media]
        flat = np.frombuffer(b"".join(back), np.uint8)
        pcm = decode_adpcm(flat.reshape(-1, BLOCK))
        out, at = [], 0
        for doc_id, size, stored, data in zip(kept, sizes, media, back):
            n = len(data) // BLOCK
            own = pcm[at : at + n].reshape(-1)
            at += n
            codes, linear = np.frombuffer(data, np.uint8), to_pcm(stored, 16000)
            digests = hashlib.sha256(data).hexdigest(), zlib.crc32(data[-64:]), len(stored), hashlib.sha256(stored).hexdigest()
            out.append((doc_id, size, len(data), *digests, features(codes, own, linear), len(linear), zlib.crc32(linear)))
        columns = list(zip(*out))
        return pa.RecordBatch.from_arrays([pa.concat_arrays(columns[0]), *[pa.array(c, k) for c, k in zip(columns[1:], kinds)]], names)

    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64()]
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "pcm_bytes", "pcm_crc32"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            group, held = [], 0
            for i, text in enumerate(batch.column(1)):
                group.append((batch.column(0).slice(i, 1), text.as_py()))
                held += len(group[-1][1] or "")
                if held >= 1 << 20:
                    yield rows(group)
                    group, held = [], 0
            if group:
                yield rows(group)

    texts, longs = ("payload_sha256", "media_sha256", "feature"), T.LongType()
    schema = T.StructType([docs.schema["doc_id"], *[T.StructField(x, T.StringType() if x in texts else longs) for x in names[1:]]])
    return docs.select("doc_id", "text").mapInArrow(run, schema)

"""Language identification by multilingual mixture inference.

Each language is a multinomial over hashed letter trigrams.  A document is a
mixture of languages whose proportions come from expectation-maximisation;
languages enter one at a time, and the set with the best penalised likelihood
is chosen.  Documents of a batch are inferred together as dense matrices.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

BINS = 4096
SMOOTH = 0.5
ROUNDS = 12
#: A further language must raise the log likelihood by this times log(trigrams).
PENALTY = 2.0
#: Partial sums meet in so many tasks before the driver adds them up.
MEETS = 16

_letters: np.ndarray | None = None


def _letter_table() -> np.ndarray:
    """For each code point of the basic plane if it is a letter; the last
    entry stands for all above."""
    global _letters
    if _letters is None:
        _letters = np.array([chr(i).isalpha() for i in range(0x10000)] + [True])
    return _letters


def trigram_counts(text: str | None, bins: int = BINS) -> np.ndarray | None:
    """Counts of hashed trigrams of letters and gaps; None if no letter is in
    the text."""
    codes = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    letter = _letter_table()[np.minimum(codes, 0x10000)]
    if not letter.any():
        return None
    c = np.full(len(codes) + 2, 32, np.uint32)
    c[1:-1] = np.where(letter, codes, 32)
    mixed = c[:-2] * np.uint32(0x9E3779B1) + c[1:-1] * np.uint32(0x85EBCA77) + c[2:] * np.uint32(0xC2B2AE3D)
    mixed ^= mixed >> np.uint32(15)
    mixed *= np.uint32(0x2C1B3C6D)
    mixed ^= mixed >> np.uint32(13)
    kept = mixed[(c[1:-1] != 32) | ((c[:-2] != 32) & (c[2:] != 32))]
    return np.bincount(kept & np.uint32(bins - 1), minlength=bins)


def fit(docs: DataFrame, bins: int = BINS) -> tuple[list[str], np.ndarray]:
    """Languages in code point order and their trigram probabilities.

    ``docs`` has ``text`` and ``lang``; rows with a null in either are left
    out.  What reaches the driver is languages x bins x MEETS numbers,
    whatever the number of rows.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, text in zip(batch.column(0), batch.column(1)):
                found = trigram_counts(text.as_py(), bins)
                if found is not None:
                    sums[lang.as_py()] = sums.get(lang.as_py(), 0) + found
        if sums:
            yield pa.RecordBatch.from_pydict({"lang": list(sums), "counts": [v.astype("<i8").tobytes() for v in sums.values()]})

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, part in zip(batch.column(0).to_pylist(), batch.column(1)):
                sums[lang] = sums.get(lang, 0) + np.frombuffer(part.as_py(), "<i8")
        if sums:
            yield pa.RecordBatch.from_pydict({"lang": list(sums), "counts": [v.tobytes() for v in sums.values()]})

    schema = "lang string, counts binary"
    rows = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("lang", "text")
    parts = rows.mapInArrow(count, schema).repartition(MEETS).mapInArrow(add, schema).collect()
    total: dict[str, np.ndarray] = {}
    for lang, part in parts:
        total[lang] = total.get(lang, 0) + np.frombuffer(part, "<i8")
    langs = sorted(total)
    table = np.array([total[x] for x in langs], dtype=np.float64).reshape(len(langs), bins) + SMOOTH
    return langs, table / table.sum(1, keepdims=True)


def mixtures(counts: np.ndarray, table: np.ndarray, rounds: int = ROUNDS, penalty: float = PENALTY) -> np.ndarray:
    """Proportions of the languages in each row of ``counts``.

    Languages are tried in the order of their proportions in a mixture of all;
    of the nested sets the one with the best penalised likelihood is kept, and
    growing a row's set ends when the next language does not pay.
    """
    counts = counts.astype(np.float32)
    table = table.astype(np.float32)
    total = counts.sum(1)
    price = penalty * np.log(np.maximum(total, 2.0))

    def em(c: np.ndarray, weights: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        for _ in range(rounds):
            share = c / (weights @ table + np.float32(1e-12))
            weights = weights * (share @ table.T) / n[:, None]
        mixed = np.log(weights @ table + np.float32(1e-12))
        return weights, np.einsum("ij,ij->i", c, mixed)

    alone = counts @ np.log(table).T
    order = np.argsort(-alone, axis=1, kind="stable")
    best = np.zeros((len(counts), len(table)), np.float32)
    best[np.arange(len(counts)), order[:, 0]] = 1
    if len(table) < 2:
        return best
    full, _ = em(counts, np.full_like(best, 1 / len(table)), total)
    full[np.arange(len(counts)), order[:, 0]] += 2  # the best single language is in every set
    order = np.argsort(-full, axis=1, kind="stable")
    value = alone.max(1) - price
    open_rows = np.arange(len(counts))
    for size in range(2, len(table) + 1):
        start = np.zeros((len(open_rows), len(table)), np.float32)
        np.put_along_axis(start, order[open_rows, :size], 1 / size, axis=1)
        weights, fit_ = em(counts[open_rows], start, total[open_rows])
        now = fit_ - size * price[open_rows]
        pays = now > value[open_rows]
        open_rows = open_rows[pays]
        if not len(open_rows):
            break
        best[open_rows], value[open_rows] = weights[pays], now[pays]
    return best / best.sum(1, keepdims=True)


def predict(docs: DataFrame, langs: list[str], table: np.ndarray, keep: list[str] = ()) -> DataFrame:
    """``keep`` columns and ``lang_pred``, ``score``, ``languages`` of each text.

    ``lang_pred`` has the largest proportion, of equal ones the first by code
    point; ``und`` with score 0 where the text is null or has no letter, or no
    language was learned.  ``languages`` lists the chosen set with proportions.
    """
    table = np.asarray(table, dtype=np.float32)
    bins = table.shape[1] if len(langs) else BINS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                found = [trigram_counts(t.as_py(), bins) for t in part.column(0)]
                rows = [i for i, x in enumerate(found) if x is not None and langs]
                pred, score, listed = ["und"] * len(found), [0.0] * len(found), [""] * len(found)
                if rows:
                    shares = mixtures(np.array([found[i] for i in rows]), table)
                    for i, share in zip(rows, shares):
                        k = int(share.argmax())
                        pred[i], score[i] = langs[k], min(1.0, float(share[k]))
                        chosen = sorted((j for j in range(len(langs)) if share[j] > 0), key=lambda j: (-share[j], j))
                        listed[i] = ",".join(f"{langs[j]}:{share[j]:.3f}" for j in chosen)
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[1:], pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(listed, pa.string())],
                    [*keep, "lang_pred", "score", "languages"],
                )

    schema = T.StructType(
        [
            *[docs.schema[c] for c in keep],
            T.StructField("lang_pred", T.StringType()),
            T.StructField("score", T.DoubleType()),
            T.StructField("languages", T.StringType()),
        ]
    )
    return docs.select("text", *keep).mapInArrow(run, schema)


def identify(docs: DataFrame) -> DataFrame:
    """``doc_id, held_out, lang_pred, score, languages`` of every document.

    Learns from the rows that are not held out (crc32 of the doc_id as text,
    modulo 3, is 1 for those held out; a null id is not held out).  Extra
    columns are not read; an empty table gives an empty result.
    """
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))
    langs, table = fit(docs.filter(~held))
    rows = docs.select("doc_id", "text", held.alias("held_out"))
    return predict(rows, langs, table, ["doc_id", "held_out"]).select("doc_id", "held_out", "lang_pred", "score", "languages")

"""Token ids in ORC: integer run-length encoding, row indexes and Bloom filters.

A document's ids are one ``array<int>`` row.  Rows are range-partitioned and
sorted by doc_id, so each file holds one ascending id range, its stripe and
row-index statistics prune ranges, and its Bloom filters prune point reads.
Stripes are the unit of parallel reading.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillstone.llm.common import ranges, shared_dir, slices

#: Words whose ids a worker remembers; what does not fit is encoded anew.
MEMO = 500_000
#: Files whose ids are summed up together.
FILES = 1000
#: New words that the library encodes as one text.
TOGETHER = 10_000

#: A space that does not begin a piece: white space comes after it, or comes
#: before it at the end of the text.
_WHITE = r"[\t-\r\x{1c}-\x{1f}\x{85}\p{Z}]"
_UNSPLIT = f" {_WHITE}|{_WHITE} $|[\\x02\\x03]"

#: The pre-tokeniser also cuts between a letter and marks after it, and at a
#: line break between lines.  There chunks end too: \\x02 begins one of marks,
#: \\x03 a word that begins a line.  Only letters whose kind no Unicode version
#: disputes count; an apostrophe may join what follows it.
_LETTER, _MARK = "[A-Za-zÀ-ÖØ-öø-ɏ]", "[!-&(-/:-@\\[-`{-~]"
_AT_LINES = f"({_LETTER})({_MARK}*\n)({_LETTER})", "\\1 \x02\\2 \x03\\3"
_AT_MARKS = f"({_LETTER})({_MARK}+) ", "\\1 \x02\\2 "

_encoders: dict[str, "Encoder"] = {}


def encoder(vocabulary: str) -> "Encoder":
    """The worker's own encoder, kept between tasks."""
    if vocabulary not in _encoders:
        _encoders[vocabulary] = Encoder(vocabulary)
    return _encoders[vocabulary]


class Encoder:
    """Ids of whole texts with a byte-level BPE file of the tokenizers library.

    Its pre-tokeniser starts a new piece at every space that no other white
    space follows, so a text whose spaces are all like that is the sequence of
    its words' ids.  Each different word of a batch is looked up or encoded once;
    new words go to the library as one text and are told apart by the pieces
    that begin with a space.  Other texts are encoded as they are.  Strings of
    special tokens in a text are ordinary text.
    """

    def __init__(self, vocabulary: str, memo: int = MEMO):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark deals out the cores
        import public_tokenizers
        from tokenizers import Tokenizer

        self.library = made = Tokenizer.from_file(public_tokenizers.path(vocabulary))
        made.encode_special_tokens = True
        space = made.encode(" ", add_special_tokens=False).tokens[0]
        self.spaced = np.array([(made.id_to_token(i) or "").startswith(space) for i in range(made.get_vocab_size())])
        self.memo: dict[str, bytes] = {}  # of a chunk
        self.first: dict[str, bytes] = {}  # of a word that begins a text
        self.line = int(np.frombuffer(self.whole("\n"), dtype="<u4")[0])
        self.most = memo

    def whole(self, text: str) -> bytes:
        (made,) = self.library.encode_batch_fast([text], add_special_tokens=False)
        return np.array(made.ids, dtype="<u4").tobytes()

    def _together(self, words: list[str], lead: str) -> list[bytes]:
        """The ids of each word after ``lead``, a space or a line break, which
        begins a piece of its own before it; without those of a line break."""
        out: list[bytes] = []
        skip = 0 if lead == " " else 4
        for at in range(0, len(words), TOGETHER):
            part = words[at : at + TOGETHER]
            ids = np.frombuffer(self.whole(lead + lead.join(part)), dtype="<u4")
            cuts = np.flatnonzero(self.spaced[ids] if lead == " " else ids == self.line)
            if len(cuts) != len(part):  # a vocabulary that does not split there
                out += [self.whole(" " + w if lead == " " else w) for w in part]
                continue
            raw, ends = ids.tobytes(), [*(cuts * 4).tolist(), len(ids) * 4]
            out += [raw[a + skip : b] for a, b in zip(ends, ends[1:])]
        return out

    def _coded(self, words: list[str]) -> list[bytes]:
        """The ids of each chunk: marks, a word at a line's start, or a word
        after a space."""
        memo = self.memo
        out = list(map(memo.get, words))
        where = [k for k, ids in enumerate(out) if ids is None]
        spaced, lined = [], []
        for k in where:
            w = words[k]
            if w[:1] == "\x02" or (w[:1] == "\x03" and "\n" in w):
                out[k] = self.whole(w[1:])
            elif w[:1] == "\x03":
                lined.append(k)
            else:
                spaced.append(k)
        for k, ids in zip(spaced, self._together([words[k] for k in spaced], " ")):
            out[k] = ids
        for k, ids in zip(lined, self._together([words[k][1:] for k in lined], "\n")):
            out[k] = ids
        if len(memo) < self.most:
            memo.update((words[k], out[k]) for k in where if len(words[k]) <= 40)
        return out

    def _starting(self, words: list[str]) -> list[bytes]:
        out, memo = [], self.first
        for w in words:
            ids = memo.get(w)
            if ids is None:
                ids = self.whole(w)
                if len(memo) < self.most // 4 and len(w) <= 40:
                    memo[w] = ids
            out.append(ids)
        return out

    def __call__(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """All ids one after the other, and how many each text has; each text
        ends with ``end_id``."""
        n = len(texts)
        unsplit = pc.match_substring_regex(texts, _UNSPLIT)
        apart = np.flatnonzero(unsplit.to_numpy(zero_copy_only=False))
        marked = pc.replace_substring_regex(pc.if_else(unsplit, "", texts), *_AT_LINES)
        lists = pc.split_pattern(pc.replace_substring_regex(marked, *_AT_MARKS), " ")
        cuts = lists.offsets.to_numpy()
        coded = lists.values.slice(cuts[0], cuts[-1] - cuts[0]).dictionary_encode()
        cuts = cuts - cuts[0]
        at = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        words = coded.dictionary.to_pylist()
        starts = [words[k] for k in at[cuts[:-1]].tolist()]
        later = np.ones(len(at), bool)
        later[cuts[:-1]] = False
        later = np.bincount(at[later], minlength=len(words)) > 0
        which = np.flatnonzero(later).tolist()
        ids = [b""] * len(words)
        for k, found in zip(which, self._coded([words[k] for k in which])):
            ids[k] = found
        heads = self._starting(starts)
        for i in apart.tolist():
            heads[i] = self.whole(texts[i].as_py())
        at[cuts[:-1]] = len(words) + np.arange(n)
        at = np.insert(at, cuts[1:], len(words) + n)
        table = [*ids, *heads, np.array([end_id], dtype="<u4").tobytes()]
        sizes = np.fromiter(map(len, table), np.int64, len(table)) // 4
        pool = np.frombuffer(b"".join(table), dtype="<u4")
        begins = np.cumsum(sizes) - sizes
        each = sizes[at]
        ends = np.cumsum(each)
        take = np.repeat((begins[at] - (ends - each)).astype(np.int32), each)
        take += np.arange(len(take), dtype=np.int32)
        rows = cuts[1:] + np.arange(1, n + 1)  # a text's end in ``at``
        totals = np.diff(np.concatenate([[0], ends[rows - 1]]))
        return pool[take], totals


def encode(docs: DataFrame, vocabulary: str = "byte_bpe_50k.json", end_id: int = 0) -> DataFrame:
    """``doc_id, row_start, n_tokens, ids`` in the order of the input partitions.

    ``row_start`` counts the ids before the row in its partition.  A null text
    counts as empty; every row ends with ``end_id``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, before = encoder(vocabulary), 0
        for batch in batches:
            for part in slices(batch, 1):
                flat, sizes = code(pc.fill_null(part.column(1), ""), end_id)
                ends = np.cumsum(sizes)
                offsets = pa.array(np.concatenate([[0], ends]).astype(np.int32))
                starts = before + ends - sizes
                before += int(ends[-1])
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(starts), pa.array(sizes), pa.ListArray.from_arrays(offsets, pa.array(flat.view("<i4")))],
                    ["doc_id", "row_start", "n_tokens", "ids"],
                )

    return docs.select("doc_id", "text").mapInArrow(run, file_schema(docs.schema["doc_id"].dataType))


def write_tokens(docs: DataFrame, path: str, vocabulary: str = "byte_bpe_50k.json", end_id: int = 0, stripe_bytes: int = 16 << 20, n: int | None = None) -> None:
    """Write the token file of ``docs`` to the folder ``path``.

    Documents are in ascending doc_id order over the files in the order of
    their numbers; null ids come first, repeated ids in order of a hash of
    their texts, then of the texts.  Rows of one id may be in several files.
    """
    spark = docs.sparkSession
    n = n or ranges(docs)
    h = F.xxhash64("text", F.col("text").isNull())
    ordered = docs.select("doc_id", "text").repartitionByRange(n, "doc_id", h).sortWithinPartitions("doc_id", h, "text")
    rows = spark.conf.get(_BATCH)
    spark.conf.set(_BATCH, "2000")  # long texts: smaller batches in both processes
    try:
        _save(encode(ordered, vocabulary, end_id), path, stripe_bytes)
    finally:
        spark.conf.set(_BATCH, rows)


def _save(rows: DataFrame, path: str, stripe_bytes: int) -> None:
    (
        rows.write.format("orc")
        .option("compression", "zstd")
        .option("orc.stripe.size", stripe_bytes)
        .option("orc.create.index", "true")
        .option("orc.row.index.stride", 1000)
        .option("orc.bloom.filter.columns", "doc_id")
        .option("orc.bloom.filter.fpp", "0.01")
        .save(path)
    )


_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def file_schema(id_type: T.DataType) -> T.StructType:
    return T.StructType(
        [
            T.StructField("doc_id", id_type),
            T.StructField("row_start", T.LongType()),
            T.StructField("n_tokens", T.LongType()),
            T.StructField("ids", T.ArrayType(T.IntegerType())),
        ]
    )


def read_tokens(spark: SparkSession, path: str, doc_ids: list | None = None, id_type: T.DataType | None = None) -> DataFrame:
    """Rows of a token file; ``doc_ids`` prunes stripes by statistics and
    Bloom filters before any ids are decoded."""
    found = spark.read.schema(file_schema(id_type or T.LongType())).orc(path)
    return found if doc_ids is None else found.filter(F.col("doc_id").isin(list(doc_ids)))


def bases(totals: DataFrame) -> DataFrame:
    """``file, base``: the ids before each of the files (file, held).

    Files are in the order of the number in their names, which has more than
    five digits beyond 100,000 files.  Sums by runs of files first, so that no
    task sorts them all.
    """
    number = F.regexp_extract("file", r"^part-(\d+)", 1).cast("long")
    rows = totals.select("file", "held", number.alias("no"), F.floor(number / FILES).alias("run"))
    earlier = (Window.unboundedPreceding, -1)
    runs = rows.groupBy("run").agg(F.sum("held").alias("sum"))
    over = Window.orderBy("run").rowsBetween(*earlier)  # a row for each run of files
    runs = runs.select("run", F.coalesce(F.sum("sum").over(over), F.lit(0)).alias("before"))
    within = Window.partitionBy("run").orderBy("no", "file").rowsBetween(*earlier)
    rows = rows.withColumn("inside", F.coalesce(F.sum("held").over(within), F.lit(0)))
    return rows.join(runs, "run").select("file", (F.col("before") + F.col("inside")).alias("base"))


def digests(spark: SparkSession, path: str, id_type: T.DataType | None = None) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every document of a token file."""
    rows = read_tokens(spark, path, id_type=id_type).withColumn("file", F.col("_metadata.file_name"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(3)
            flat = ids.values.to_numpy(zero_copy_only=False).astype("<u4", copy=False)
            cuts = ids.offsets.to_numpy().tolist()
            sums = [zlib.crc32(flat[a:b]) for a, b in zip(cuts, cuts[1:])]
            sizes = pa.array(np.diff(cuts).astype(np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), batch.column(2), sizes, pa.array(sums, pa.int64())],
                ["doc_id", "file", "row_start", "n_tokens", "ids_crc32"],
            )

    schema = T.StructType(
        [
            rows.schema["doc_id"],
            T.StructField("file", T.StringType()),
            T.StructField("row_start", T.LongType()),
            T.StructField("n_tokens", T.LongType()),
            T.StructField("ids_crc32", T.LongType()),
        ]
    )
    each = rows.select("doc_id", "file", "row_start", "ids").mapInArrow(run, schema)
    totals = rows.groupBy("file").agg(F.sum("n_tokens").alias("held"))
    joined = each.join(bases(totals), "file")
    return joined.select("doc_id", (F.col("base") + F.col("row_start")).alias("start"), "n_tokens", "ids_crc32")


def round_trip(docs: DataFrame, vocabulary: str = "byte_bpe_50k.json", end_id: int = 0, path: str | None = None) -> DataFrame:
    """Write ``docs`` as a token file and return the digests read back from it."""
    spark = docs.sparkSession
    path = path or f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
    write_tokens(docs, path, vocabulary, end_id)
    return digests(spark, path, docs.schema["doc_id"].dataType)

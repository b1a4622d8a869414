"""Token ids as binary files: frequency-ranked ids in byte-aligned variable-length code with separate control bytes.

Two passes over ids, one over texts: texts are dealt by doc_id range and encoded once into a scratch table of
16- or 32-bit ids; counting that table ranks the ids by frequency (rank 0 is the most frequent), so most ranks
fit a byte; each range is then coded in order. The files are Parquet used as a container, one row for each
block of documents, so that Spark's committer makes them whole even if executors are lost:

    part int, block int      place of the block; files in order of (part, block) hold ascending doc_ids
    doc_ids, null_ids, counts  of its documents, in order
    n_ids long               ids in the block
    control binary           two bits for each id, four ids to a byte, lowest bits first: its bytes less one
    data binary              the ranks' bytes, little-endian, without gaps

beside ``ranks`` (rank int, id int), which has a row for each id in use, no more than the vocabulary has.
"""

from __future__ import annotations

import json
import string
import uuid
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Memo, per_worker, shared_folder, shuffle_partitions, slices

_LENGTHS = (np.arange(256)[:, None] >> np.array([0, 2, 4, 6]) & 3) + 1  # by control byte: bytes of its four ids


def encode_ranks(values: np.ndarray) -> tuple[bytes, bytes]:
    """(control, data) of non-negative integers below 2**32."""
    v = np.ascontiguousarray(values, "<u4")
    size = 1 + (v > 0xFF).astype(np.uint8) + (v > 0xFFFF) + (v > 0xFFFFFF)
    codes = np.zeros(-(-len(v) // 4) * 4, np.uint8)
    codes[: len(v)] = size - 1
    control = (codes.reshape(-1, 4) << np.array([0, 2, 4, 6], np.uint8)).sum(axis=1, dtype=np.uint8)
    most = int(size.max(initial=1))
    data = v.view(np.uint8).reshape(-1, 4)[:, :most][np.arange(most) < size[:, None]]
    return control.tobytes(), data.tobytes()


def decode_ranks(control: bytes, data: bytes, n: int) -> np.ndarray:
    """The inverse: a table gives the lengths by control byte, a running sum the offsets."""
    size = _LENGTHS[np.frombuffer(control, np.uint8)].reshape(-1)[:n]
    at = np.cumsum(size) - size
    raw = np.frombuffer(data + b"\0\0\0", np.uint8)
    out = raw[at].astype(np.uint32)
    for k in range(1, 4):
        longer = np.flatnonzero(size > k)
        if not len(longer):
            break
        out[longer] |= raw[at[longer] + k].astype(np.uint32) << np.uint32(8 * k)
    return out


#: What may follow a word as one pre-token: ASCII marks, but for the apostrophe, with which contractions start.
_MARKS = string.punctuation.replace("'", "")


def _byte_letters() -> dict[int, str]:
    """The letters that stand for bytes in a byte-level vocabulary: printable ones for themselves, the others from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(sorted(set(range(256)) - set(plain)))}


class TextEncoder:
    """Whole-text byte-level BPE ids by the tokenizers library, with a bounded memo of pieces between spaces.

    The pre-tokenizer always cuts between a non-space and a single space before a non-space, and around a
    single line feed between non-spaces; in a text where all white space is of that kind the pieces between
    these cuts are encoded once each. Any other text goes to the library whole. A piece of Latin letters, or of
    these and marks after them, has no further cuts but that one, so its parts go to the library's model. A tokenizer
    of another kind is refused, as these cuts would not be its own.
    """

    def __init__(self, path: str, limit: int = 900_000):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        told = json.loads(self.tokenizer.to_str())
        cuts, model = told["pre_tokenizer"] or {}, told["model"]
        plain = not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback"))
        if (told["normalizer"], cuts.get("type"), cuts.get("add_prefix_space"), cuts.get("use_regex", True), model["type"], plain) != (None, "ByteLevel", False, True, "BPE", True):
            raise ValueError(f"{path} is no plain byte-level BPE tokenizer")
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]  # matched in texts before any cut
        self.spaces = [c for c in map(chr, range(0x3001)) if c.isspace() and c not in " \n"]
        self.tokenize, self.letters = self.tokenizer.model.tokenize, _byte_letters()
        self.known, self.parts = Memo(self.piece, limit), Memo(self.part, limit // 4)

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)

    def odd(self, text: str) -> bool:
        """True unless all white space is single spaces and line feeds between other characters (and for U+0000, the cuts' mark, and for added tokens)."""
        if not text or text[0] in " \n" or text[-1] in " \n" or any(x in text for x in ("  ", " \n", "\n ", "\n\n", "\0")):
            return True
        return any(c in text for c in self.spaces) or any(t in text for t in self.added)

    def part(self, token: str) -> bytes:
        """Ids of one pre-token."""
        if token.isascii():
            mapped = "\u0120" + token[1:] if token[0] == " " else token
        else:
            mapped = token.encode().decode("latin-1").translate(self.letters)
        return array("I", [t.id for t in self.tokenize(mapped)]).tobytes()

    def piece(self, text: str) -> bytes:
        word = text.rstrip(_MARKS)
        core = word[1:] if word[:1] == " " else word
        if core.isalpha() and (core.isascii() or max(core) < "\u0250"):
            return self.part(text) if len(word) == len(text) else self.parts[word] + self.parts[text[len(word) :]]
        return self.whole(text).tobytes()

    def __call__(self, texts: list[str]) -> list[np.ndarray]:
        get = self.known.__getitem__
        return [self.whole(t) if self.odd(t) else np.frombuffer(b"".join(map(get, t.replace(" ", "\0 ").replace("\n", "\0\n\0").split("\0"))), np.uint32) for t in texts]


def _scratch(docs: DataFrame, tokenizer: str, end_id: int, path: str) -> None:
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    dealt = rows.repartitionByRange(shuffle_partitions(spark), F.col("doc_id").asc_nulls_first(), F.xxhash64("text")).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.xxhash64("text"), "text")
    dealt = dealt.select("doc_id", "text", F.spark_partition_id().alias("part"))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, end = per_worker(TextEncoder, tokenizer), np.array([end_id], np.uint32)
        row = 0
        for batch in slices(batches, limit=2 << 20):
            ids = encoder(batch.column("text").to_pylist())
            n = len(ids)
            if not n:
                continue
            flat = np.concatenate([y for x in ids for y in (x, end)])
            ends = np.cumsum(np.fromiter(map(len, ids), np.int64, n) + 1)
            kind = "<u2" if flat.max() < 65536 else "<u4"
            offsets = (np.r_[0, ends] * np.dtype(kind).itemsize).astype(np.int32)  # a batch holds some MB of text
            packed, none = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(offsets), pa.py_buffer(flat.astype(kind))]), pa.array([b""] * n, pa.binary())
            at = pa.array(np.arange(row, row + n))
            row += n
            yield pa.RecordBatch.from_arrays([batch.column("part"), at, batch.column("doc_id"), *((packed, none) if kind == "<u2" else (none, packed))], ["part", "row", "doc_id", "narrow", "wide"])

    dealt.mapInArrow(encode, "part int, row long, doc_id long, narrow binary, wide binary").write.parquet(path)


def _ids(narrow: bytes, wide: bytes) -> np.ndarray:
    return np.frombuffer(narrow, "<u2").astype(np.uint32) if narrow else np.frombuffer(wide, "<u4")


def write_token_files(docs: DataFrame, path: str, tokenizer: str, end_id: int = 2, block_ids: int = 1 << 16) -> None:
    """Writes ``docs`` (doc_id, text) to ``path``: every whole text and ``end_id``, in ascending doc_id order.

    A null text counts as empty; null doc_ids come first; rows that share a doc_id are ordered by their texts'
    hash and then text, and repeated rows are all written; an empty table gives files without blocks; further
    columns are ignored. A block ends with the document that fills it: it holds ``block_ids`` ids and one text
    at most.
    """
    spark = docs.sparkSession
    scratch = f"{shared_folder(spark)}/logloom-ids-{uuid.uuid4().hex}"
    _scratch(docs, tokenizer, end_id, scratch)
    ids = spark.read.parquet(scratch)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for batch in batches:
            for column, kind in (("narrow", "<u2"), ("wide", "<u4")):
                c = np.bincount(np.frombuffer(b"".join(batch.column(column).to_pylist()), kind))
                size = max(len(c), len(total))
                total = np.pad(total, (0, size - len(total))) + np.pad(c, (0, size - len(c)))
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(total[used])], ["id", "n"])

    counted = ids.select("narrow", "wide").mapInArrow(count, "id int, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()  # one row for each id of the vocabulary at most
    order = [r.id for r in sorted(counted, key=lambda r: (-r.n, r.id))]
    spark.createDataFrame(list(enumerate(order)), "rank int, id int").coalesce(1).write.parquet(f"{path}/ranks")
    rank = np.zeros(max(order, default=0) + 1, np.uint32)
    rank[order] = np.arange(len(order), dtype=np.uint32)

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        total = 0

        def block() -> pa.RecordBatch:
            values = np.concatenate([x for *_, x in held])
            control, data = encode_ranks(rank[values])
            part, first = held[0][:2]
            row = {"part": part, "first_row": first, "doc_ids": [h[2] for h in held], "counts": [len(h[3]) for h in held], "n_ids": len(values), "control": control, "data": data}
            return pa.RecordBatch.from_pylist([row], schema=_BLOCK)

        for batch in batches:
            for part, row, doc, n, w in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and (part, row) != (held[-1][0], held[-1][1] + 1):
                    yield block()
                    held, total = [], 0
                held.append((part, row, doc, _ids(n, w)))
                total += len(held[-1][3])
                if total >= block_ids:
                    yield block()
                    held, total = [], 0
        if held:
            yield block()

    ids.select("part", "row", "doc_id", "narrow", "wide").mapInArrow(code, _BLOCK_DDL).write.parquet(f"{path}/blocks")
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(scratch)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


_BLOCK_DDL = "part int, first_row long, doc_ids array<long>, counts array<long>, n_ids long, control binary, data binary"
_BLOCK = pa.schema([("part", pa.int32()), ("first_row", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("counts", pa.list_(pa.int64())), ("n_ids", pa.int64()), ("control", pa.binary()), ("data", pa.binary())])


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, ids binary): the ids of every document as little-endian unsigned 32-bit integers, and the number of ids of all documents before it."""
    order = [r.id for r in spark.read.parquet(f"{path}/ranks").orderBy("rank").collect()]  # bounded by the vocabulary
    ids = np.array(order or [0], "<u4")
    blocks = spark.read.parquet(f"{path}/blocks")
    # a running sum over blocks inside each part, and one over the parts, of which there are as many as shuffle partitions
    sizes = blocks.groupBy("part").agg(F.sum("n_ids").alias("n"))
    starts = sizes.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("part_start"))
    placed = blocks.select("part", "first_row", "n_ids").withColumn("s", F.sum("n_ids").over(Window.partitionBy("part").orderBy("first_row")) - F.col("n_ids"))
    placed = placed.join(starts, "part").select("part", "first_row", (F.col("s") + F.col("part_start")).alias("start"))

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                docs, counts, n, control, data, start = (batch.column(k)[i].as_py() for k in ("doc_ids", "counts", "n_ids", "control", "data", "start"))
                values = ids[decode_ranks(control, data, n)]
                ends = np.cumsum(counts)
                parts = [values[a:b].tobytes() for a, b in zip(np.r_[0, ends[:-1]], ends, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(start + np.r_[0, ends[:-1]].astype(np.int64)), pa.array(parts, pa.binary())], ["doc_id", "start", "ids"])

    return blocks.join(placed, ["part", "first_row"]).mapInArrow(decode, "doc_id long, start long, ids binary")


def with_crc(read: DataFrame) -> DataFrame:
    """Adds n_tokens and ids_crc32, in Spark's own functions, to what read_token_files returns."""
    return read.select("doc_id", "start", F.expr("cast(octet_length(ids) / 4 as long)").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))


def crc_of(ids: np.ndarray) -> int:
    return zlib.crc32(np.ascontiguousarray(ids, "<u4").tobytes())

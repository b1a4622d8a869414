"""Exact removal of repeated word windows by recompression.

Texts are parsed bottom-up as recompression does it: in every round maximal runs of equal symbols get one name, then
adjacent symbols of a left and a right class (a bit of the symbol's hash) are paired and the pair gets a name. Names are
hashes of what they stand for, so that all tasks give the same name to the same run or pair without a dictionary, and
equal passages are parsed alike but for their edges. How far the edges reach is known for each symbol: ``lo`` and ``hi``
bound the words that decided on its ends. A symbol that occurs once in all texts therefore proves that every window
over these words occurs once; what is left are windows whose symbols are all shared.

Three rounds go through Spark, each of them a table of entries (block, piece, bucket of the name, packed names) that is
grouped by bucket and answered with one bit an entry:

    texts    the name of a whole text: a copy of a text with a smaller doc_id goes as a whole and is parsed no further;
    symbols  which names are shared, that is occur twice or more;
    windows  names of 128 bits of the windows that are left, with the smallest doc_id: which of them start earlier.

Texts are written once, in blocks bucketed by the block's id, so the answers come to the texts and the texts are never
sent again. A block sends a name once, so what a frequent passage sends grows with the blocks and not with its
occurrences, and buckets are spread by hash. Nothing is collected; a text longer than a block is worked on piece by piece.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, shared_folder, shuffle_partitions, slices

U = np.uint64
#: Contexts that reach beyond the known words: such a symbol proves nothing.
BEFORE, BEYOND = -(1 << 40), 1 << 40
#: A null doc_id comes after all others.
LAST = (1 << 63) - 1
SPACE = re.compile(rb"[\x20\x09-\x0D]")
BITS = 39  # of a symbol's name, beside its bucket


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads all bits (constants of the public SplitMix64 generator)."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


class Parse:
    """Symbols of consecutive units (texts): names, first word, words that decided (lo to hi), and the unit of each.

    All arrays are as long as there are symbols; a fresh parse has a symbol for each word.
    """

    def __init__(self, words: np.ndarray, unit: np.ndarray):
        self.name, self.unit, self.start = words, unit, np.arange(len(words))
        self.lo, self.hi = self.start, self.start + 1

    def _edges(self) -> tuple[np.ndarray, np.ndarray]:
        change = self.unit[1:] != self.unit[:-1]
        return np.r_[True, change], np.r_[change, True]

    def _around(self) -> tuple[np.ndarray, np.ndarray]:
        """lo of the symbol before and hi of the one after; without such a neighbour the context has no end."""
        first, last = self._edges()
        return np.where(first, BEFORE, np.r_[0, self.lo[:-1]]), np.where(last, BEYOND, np.r_[self.hi[1:], 0])

    def runs(self, level: int) -> None:
        """A maximal run of k equal symbols becomes one. That it ends shows in its neighbours, so they are context."""
        if not len(self.name):
            return
        head = np.flatnonzero(self._edges()[0] | np.r_[True, self.name[1:] != self.name[:-1]])
        k = np.diff(np.r_[head, len(self.name)])
        before, after = self._around()
        self.lo, self.hi = before[head], after[head + k - 1]
        name = self.name[head]
        self.name = np.where(k > 1, mixed(name + mixed(k.astype(U) + U(level << 32))), name)
        self.unit, self.start = self.unit[head], self.start[head]

    def pairs(self, level: int) -> None:
        """A symbol of the left class and a symbol of the right class after it become one.

        Such a pair depends on its two members only; a single left symbol depends on the one after it, a single right one on the one before it.
        """
        if not len(self.name):
            return
        right = (mixed(self.name ^ U(2 * level + 1)) >> U(63)).astype(bool)
        first, _ = self._edges()
        pair = np.r_[~right[:-1] & right[1:] & ~first[1:], False]
        before, after = self._around()
        lo, hi = np.where(right, before, self.lo), np.where(right, self.hi, after)
        kept = np.flatnonzero(~np.r_[False, pair[:-1]])
        two, second = pair[kept], np.minimum(kept + 1, len(pair) - 1)
        self.lo, self.hi = np.where(two, self.lo[kept], lo[kept]), np.where(two, self.hi[second], hi[kept])
        self.name = np.where(two, mixed(mixed(self.name[kept] + U(level + 1)) + self.name[second]), self.name[kept])
        self.unit, self.start = self.unit[kept], self.start[kept]

    def rounds(self, n: int) -> Parse:
        for level in range(n):
            self.runs(level)
            self.pairs(level)
        return self


def window_names(words: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """128 bits for every run of ``width`` words, as two polynomials over the words' names, built by doubling."""
    if len(words) < width:
        return np.empty(0, U), np.empty(0, U)
    out = []
    for w, base in ((words, 0x9E3779B97F4A7C15), (mixed(words ^ U(0xA5A5A5A5)), 0xD6E8FEB86659FD93)):
        n, power, done, length = len(w) - width + 1, w, np.zeros(len(w) - width + 1, U), 0
        size = 1
        while size <= width:
            if width & size:
                done = done + U(pow(base, length, 1 << 64)) * power[length : length + n]
                length += size
            if size * 2 <= width:
                power = power[: len(power) - size] + U(pow(base, size, 1 << 64)) * power[size:]
            size *= 2
        out.append(mixed(done))
    return out[0], out[1]


def word_slices(text: bytes, limit: int) -> Iterator[list[bytes]]:
    """The words of a text, in slices of about ``limit`` bytes."""
    at = 0
    while at < len(text):
        cut = SPACE.search(text, at + limit) if at + limit < len(text) else None
        end = cut.start() if cut else len(text)
        yield text[at:end].split()
        at = end


def names_of(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), U, len(words))


class Piece:
    """Words of a block that are worked on together: whole texts, or a part of one long text with the words around it."""

    def __init__(self, number: int, words: np.ndarray, unit: np.ndarray, ids: np.ndarray, begin: int, end: int, at: int):
        self.number, self.words, self.unit, self.ids = number, words, unit, ids
        self.begin, self.end, self.at = begin, end, at  # begin to end: its own words; at: the place of the first of them in the block


class Block:
    """Texts of a row of the written table."""

    def __init__(self, row: dict, width: int, limit: int):
        self.id, self.width, self.limit = row["block"], width, limit
        self.null = np.array([x is None for x in row["ids"]], bool)
        self.ids = np.array([LAST if x is None else x for x in row["ids"]], np.int64)
        self.n_words, self.sizes, self.blob = np.array(row["n_words"], np.int64), row["sizes"], row.get("blob")
        self.digests = np.frombuffer(row["digests"], "<u8").reshape(-1, 2)

    def texts(self) -> Iterator[bytes]:
        raw, at = zstandard.ZstdDecompressor().decompress(self.blob), 0
        for n in self.sizes:
            yield raw[at : at + n]
            at += n

    def pieces(self, left_out: np.ndarray) -> Iterator[Piece]:
        """Texts with a window that are not left out. Every window starts in one piece, and is there in full."""
        chosen = (self.n_words >= self.width) & ~left_out
        if len(self.sizes) > 1 or sum(self.sizes) <= self.limit:
            parts, units = [], []
            for i, text in enumerate(self.texts()):
                if chosen[i]:
                    parts.append(names_of(text.split()))
                    units.append(np.full(len(parts[-1]), i, np.int32))
            if parts:
                words = np.concatenate(parts)
                yield Piece(0, words, np.concatenate(units), self.ids, 0, len(words), 0)
            return
        if not chosen[0]:
            return
        around, before, now, at = 2 * self.width, np.empty(0, U), None, 0
        for k, following in enumerate([*map(names_of, word_slices(next(self.texts()), self.limit)), np.empty(0, U)]):
            if now is not None and len(now) < around and len(following):  # too short to show the next piece what came before
                now = np.concatenate([now, following])
                continue
            if now is not None:
                words = np.concatenate([before, now, following[:around]])
                yield Piece(k - 1, words, np.zeros(len(words), np.int32), self.ids, len(before), len(before) + len(now), at)
                before, at = now[-around:], at + len(now)
            now = following


# ---- entries of the three rounds, and what the answers mean


def earliest(high: np.ndarray, low: np.ndarray, ids: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct names of 128 bits ordered by bucket, each with its smallest id: (bucket, short, low, id), and for every given name which of them it is."""
    place = (high >> U(32)) * U(buckets) >> U(32)
    key = place << U(32) | high & U(0xFFFFFFFF)
    order = np.lexsort((low, key))
    k, w = key[order], low[order]
    new = np.r_[True, (k[1:] != k[:-1]) | (w[1:] != w[:-1])] if len(k) else np.empty(0, bool)
    which = np.empty(len(k), np.int64)
    which[order] = np.cumsum(new) - 1
    heads = np.flatnonzero(new)
    least = np.minimum.reduceat(ids[order], heads) if len(heads) else np.empty(0, np.int64)
    return (k[heads] >> U(32)).astype(np.int64), (k[heads] & U(0xFFFFFFFF)).astype("<u4"), w[heads], least, which


def symbol_entries(parse: Parse, piece: Piece, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct names of the piece's own symbols ordered by bucket: (bucket, name with one bit for "twice or more here"), for every own symbol its place among them, and which symbols are its own."""
    own = np.flatnonzero((parse.start >= piece.begin) & (parse.start < piece.end))
    name = mixed(parse.name[own])
    key = ((name >> U(32)) * U(buckets) >> U(32)) << U(BITS) | name & U((1 << BITS) - 1)
    distinct, which, count = np.unique(key, return_inverse=True, return_counts=True)
    return (distinct >> U(BITS)).astype(np.int64), (distinct & U((1 << BITS) - 1)) << U(1) | (count > 1).astype(U), which, own


def alive(parse: Parse, piece: Piece, own: np.ndarray, shared: np.ndarray, width: int) -> np.ndarray:
    """Starts of the windows in which no symbol proves that the window occurs once. ``shared``: for each own symbol."""
    single = own[~shared]
    lo, hi = parse.lo[single], parse.hi[single]
    good = (lo >= 0) & (hi - lo <= width)
    marks = np.zeros(len(piece.words) + 1, np.int32)
    np.add.at(marks, np.maximum(hi[good] - width, 0), 1)
    np.add.at(marks, lo[good] + 1, -1)
    starts = np.arange(piece.begin, min(piece.end, len(piece.words) - width + 1))
    return starts[(np.cumsum(marks)[starts] == 0) & (piece.unit[starts] == piece.unit[starts + width - 1])]


def _five(x: np.ndarray) -> bytes:
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5]).tobytes()


def _from_five(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // 5, 8), np.uint8)
    out[:, :5] = np.frombuffer(data, np.uint8).reshape(-1, 5)
    return out.view("<u8").ravel()


def answer_symbols(rows: list[dict]) -> list[np.ndarray]:
    """For each entry of a bucket: is its name there twice or more?"""
    found = [_from_five(r["names"]) for r in rows]
    every = np.concatenate(found)
    _, which, count = np.unique(every >> U(1), return_inverse=True, return_counts=True)
    return np.split((every & U(1)).astype(bool) | (count[which] > 1), np.cumsum([len(x) for x in found])[:-1])


def answer_earliest(rows: list[dict]) -> list[np.ndarray]:
    """For each entry of a bucket: is its name there with a smaller id, or in an earlier piece of its own block?"""
    short = [np.frombuffer(r["names"], "<u4", len(r["ids"]) // 8) for r in rows]
    low = np.concatenate([np.frombuffer(r["names"], "<u8", offset=len(r["ids"]) // 2) for r in rows])
    ids = np.concatenate([np.frombuffer(r["ids"], "<i8") for r in rows])
    sizes = [len(x) for x in short]
    block, piece = np.repeat([r["block"] for r in rows], sizes), np.repeat([r["piece"] for r in rows], sizes)
    names = np.concatenate(short)
    order = np.lexsort((piece, block, ids, names, low))
    same = np.r_[False, (low[order][1:] == low[order][:-1]) & (names[order][1:] == names[order][:-1])]
    head = np.flatnonzero(~same)
    least = np.repeat(ids[order][head], np.diff(np.r_[head, len(order)]))
    later = (ids[order] > least) | same & (block[order] == np.r_[0, block[order][:-1]]) & (ids[order] == np.r_[0, ids[order][:-1]])
    out = np.empty(len(order), bool)
    out[order] = later
    return np.split(out, np.cumsum(sizes)[:-1])


ENTRY = pa.schema([("block", pa.int64()), ("piece", pa.int32()), ("bucket", pa.int32()), ("names", pa.binary()), ("ids", pa.binary())])
ANSWER = pa.schema([("block", pa.int64()), ("piece", pa.int32()), ("bucket", pa.int32()), ("bits", pa.binary())])
ENTRY_SQL, ANSWER_SQL = "block long, piece int, bucket int, names binary, ids binary", "block long, piece int, bucket int, bits binary"


def _by_bucket(block: int, piece: int, bucket: np.ndarray, pack) -> pa.RecordBatch:
    """A row for each bucket in use; ``pack(a, b)``: names and ids of the entries from a to b."""
    cuts = np.r_[np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]]), len(bucket)] if len(bucket) else np.zeros(1, int)
    packed = [pack(a, b) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
    n = len(packed)
    return pa.RecordBatch.from_arrays([pa.array([block] * n, pa.int64()), pa.array([piece] * n, pa.int32()), pa.array(bucket[cuts[:-1]].astype(np.int32)), pa.array([p[0] for p in packed], pa.binary()), pa.array([p[1] for p in packed], pa.binary())], schema=ENTRY)


def answered(entries: DataFrame, answer, name: str) -> DataFrame:
    """(block, answers): the bits of every block, ordered by piece and bucket. A bucket is one group, spread by hash and of a size that ``parts`` bounds."""

    def reply(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        bits = [np.packbits(x).tobytes() for x in answer(rows)]
        return pa.Table.from_arrays([table.column("block"), table.column("piece"), table.column("bucket"), pa.array(bits, pa.binary())], schema=ANSWER)

    bits = materialise(entries.groupBy("bucket").applyInArrow(reply, ANSWER_SQL), name)
    return bits.groupBy("block").agg(F.array_sort(F.collect_list(F.struct("piece", "bucket", "bits"))).alias(name))


class Answers:
    """The bits of a block in the order in which its entries were sent."""

    def __init__(self, rows: list[dict] | None):
        self.of: dict[int, list[bytes]] = {}
        for r in rows or []:
            self.of.setdefault(r["piece"], []).append(r["bits"])

    def bits(self, piece: int, bucket: np.ndarray) -> np.ndarray:
        if not len(bucket):
            return np.empty(0, bool)
        sizes = np.diff(np.r_[np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]]), len(bucket)])
        return np.concatenate([np.unpackbits(np.frombuffer(x, np.uint8), count=n) for x, n in zip(self.of[piece], sizes, strict=True)]).astype(bool)


def _copies(block: Block, answers: Answers, buckets: int) -> np.ndarray:
    """Texts of the block that are copies of a text with a smaller doc_id."""
    bucket, _, _, least, which, long = _text_entries(block, buckets)
    out = np.zeros(len(block.ids), bool)
    out[long] = answers.bits(0, bucket)[which] | (block.ids[long] > least[which])
    return out


def _text_entries(block: Block, buckets: int):
    long = np.flatnonzero(block.n_words >= block.width)
    return *earliest(block.digests[long, 0], block.digests[long, 1], block.ids[long], buckets), long


class Windows:
    """The windows of a piece that are left after the symbols' answers, as entries."""

    def __init__(self, piece: Piece, width: int, levels: int, buckets: int, answers: Answers):
        parse = Parse(piece.words, piece.unit).rounds(levels)
        bucket, _, which, own = symbol_entries(parse, piece, buckets)
        self.starts = alive(parse, piece, own, answers.bits(piece.number, bucket)[which], width)
        high, low = window_names(piece.words, width)
        self.ids = piece.ids[piece.unit[self.starts]]
        self.bucket, self.short, self.low, self.least, self.which = earliest(high[self.starts], low[self.starts], self.ids, buckets)

    def later(self, piece: Piece, answers: Answers) -> np.ndarray:
        """Which of them start earlier elsewhere: by the answer, in this piece with a smaller doc_id, or before in the same text."""
        out = answers.bits(piece.number, self.bucket)[self.which] | (self.ids > self.least[self.which])
        unit = piece.unit[self.starts]
        order = np.lexsort((self.starts, unit, self.which))
        w, u = self.which[order], unit[order]
        out[order[1:]] |= (w[1:] == w[:-1]) & (u[1:] == u[:-1])
        return out


def _results(block: Block, removed: np.ndarray, copies: np.ndarray, begin: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Rows of results; ``removed``: by word of the texts that were worked on, whose first words are at ``begin``."""
    n_removed, kept = [], []
    for i, text in enumerate(block.texts()):
        if copies[i] or begin[i] >= 0 and removed[begin[i] : begin[i] + block.n_words[i]].all():
            n_removed.append(int(block.n_words[i]))
            kept.append(b"")
            continue
        at, out, gone = int(begin[i]), [], 0
        for words in word_slices(text, block.limit):
            mask = removed[at : at + len(words)] if begin[i] >= 0 else None
            if mask is not None and mask.any():
                gone += int(mask.sum())
                words = [w for w, m in zip(words, mask.tolist(), strict=True) if not m]
            at += len(mask) if mask is not None else 0
            if words:
                out.append(b" ".join(words))
        n_removed.append(gone)
        kept.append(b" ".join(out))
    ids = pa.array([None if null else int(x) for x, null in zip(block.ids, block.null, strict=True)], pa.int64())
    yield pa.RecordBatch.from_arrays([ids, pa.array(block.n_words), pa.array(n_removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())], ["doc_id", "n_words", "n_removed", "kept"])


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield batch.slice(i, 1).to_pylist()[0]


def _blocked(docs: DataFrame, width: int, limit: int) -> DataFrame:
    """Texts in blocks of about ``limit`` bytes (a longer text is a block of its own), with counts of words and names of whole texts."""

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, n = TaskContext.get().partitionId() << 32, 0
        ids, counts, digests, texts, held = [], [], [], [], 0

        def block():
            nonlocal n, ids, counts, digests, texts, held
            row = {"block": base + n, "ids": ids, "n_words": counts, "sizes": [len(t) for t in texts], "digests": b"".join(digests), "blob": zstandard.ZstdCompressor(3).compress(b"".join(texts))}
            n, ids, counts, digests, texts, held = n + 1, [], [], [], [], 0
            return pa.RecordBatch.from_pylist([row], pa.schema([("block", pa.int64()), ("ids", pa.list_(pa.int64())), ("n_words", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int64())), ("digests", pa.binary()), ("blob", pa.binary())]))

        for batch in slices(batches, limit=limit):
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                raw = (text or "").encode("utf-8", "surrogatepass")
                if texts and held + len(raw) > limit:
                    yield block()
                digest, count = hashlib.blake2b(digest_size=16), 0
                for words in word_slices(raw, limit):
                    if words:
                        digest.update(b" " * (count > 0) + b" ".join(words))
                        count += len(words)
                ids.append(doc_id)
                counts.append(count)
                digests.append(digest.digest())
                texts.append(raw)
                held += len(raw)
        if texts:
            yield block()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(packed, "block long, ids array<long>, n_words array<long>, sizes array<long>, digests binary, blob binary")


def _bucketed(rows: DataFrame, by: str, parts: int) -> DataFrame:
    """Writes ``rows`` once in the shared folder, bucketed: what joins on ``by`` comes to these rows without sending them."""
    spark, name = rows.sparkSession, f"logloom_blocks_{uuid.uuid4().hex}"
    rows.write.format("parquet").option("path", f"{shared_folder(spark)}/{name}").bucketBy(parts, by).saveAsTable(name)
    table = spark.table(name)
    table.schema  # resolved now: the files stay, the name goes
    spark.sql(f"DROP TABLE {name}")
    return table


def remove_repeats(docs: DataFrame, width: int = 20, levels: int = 2, limit: int = 8 << 20, bucket_bytes: int = 8 << 20) -> DataFrame:
    """(doc_id, n_words, n_removed, kept) for every row of ``docs``: its text without the words of repeated windows.

    Words are runs of anything but ASCII white space, unchanged. A window is ``width`` consecutive words of a text; every
    word of a window whose words also start earlier (in a text with a smaller doc_id, or before in the same text) is
    removed, judged on the input; ``kept`` has the others, joined by single blanks. A null text has no words, a text under
    ``width`` words keeps all, a text is worked on as a whole however long it is, a null doc_id comes after all others, and
    rows that share a doc_id are not earlier than each other (so repeated rows give equal rows). An empty table gives no
    rows; further columns of ``docs`` are ignored, whatever their names.

    ``levels`` rounds of recompression name the symbols; ``limit`` bounds the bytes of texts that a task works on at once,
    ``bucket_bytes`` about the bytes of names that a group gets.
    """
    spark = docs.sparkSession
    total = docs.agg(F.sum(F.octet_length(F.col("text").cast("string")))).first()[0] or 0
    parts = max(shuffle_partitions(spark), total // (4 * limit) + 1)
    buckets = max(2 * shuffle_partitions(spark), total // bucket_bytes + 1)  # a word is some six bytes of text, and sends five bytes at most
    blocks = _bucketed(_blocked(docs, width, limit), "block", parts)

    def text_round(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            block = Block(row, width, limit)
            bucket, short, low, least, _, _ = _text_entries(block, buckets)
            yield _by_bucket(block.id, 0, bucket, lambda a, b, s=short, w=low, d=least: (s[a:b].tobytes() + w[a:b].astype("<u8").tobytes(), d[a:b].astype("<i8").tobytes()))

    def symbol_round(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            block = Block(row, width, limit)
            for piece in block.pieces(_copies(block, Answers(row["texts"]), buckets)):
                bucket, names, _, _ = symbol_entries(Parse(piece.words, piece.unit).rounds(levels), piece, buckets)
                yield _by_bucket(block.id, piece.number, bucket, lambda a, b, x=names: (_five(x[a:b]), b""))

    def window_round(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            block, symbols = Block(row, width, limit), Answers(row["symbols"])
            for piece in block.pieces(_copies(block, Answers(row["texts"]), buckets)):
                w = Windows(piece, width, levels, buckets, symbols)
                yield _by_bucket(block.id, piece.number, w.bucket, lambda a, b, w=w: (w.short[a:b].tobytes() + w.low[a:b].astype("<u8").tobytes(), w.least[a:b].astype("<i8").tobytes()))

    def results(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            block, symbols, windows = Block(row, width, limit), Answers(row["symbols"]), Answers(row["windows"])
            copies = _copies(block, Answers(row["texts"]), buckets)
            worked = np.where((block.n_words >= width) & ~copies, block.n_words, 0)
            begin = np.where(worked > 0, np.cumsum(worked) - worked, -1)
            marks = np.zeros(int(worked.sum()) + width + 1, np.int32)
            for piece in block.pieces(copies):
                w = Windows(piece, width, levels, buckets, symbols)
                starts = w.starts[w.later(piece, windows)] - piece.begin + piece.at
                np.add.at(marks, starts, 1)
                np.add.at(marks, starts + width, -1)
            yield from _results(block, np.cumsum(marks)[: int(worked.sum())] > 0, copies, begin)

    ids = blocks.select("block", "ids", "n_words", F.lit(None).cast("array<long>").alias("sizes"), "digests")
    texts = answered(ids.mapInArrow(text_round, ENTRY_SQL), answer_earliest, "texts")
    held = blocks.join(texts.hint("shuffle_hash"), "block", "left")
    symbols = answered(held.mapInArrow(symbol_round, ENTRY_SQL), answer_symbols, "symbols")
    held = held.join(symbols.hint("shuffle_hash"), "block", "left")
    windows = answered(held.mapInArrow(window_round, ENTRY_SQL), answer_earliest, "windows")
    return held.join(windows.hint("shuffle_hash"), "block", "left").mapInArrow(results, "doc_id long, n_words long, n_removed long, kept string")

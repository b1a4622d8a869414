"""SentencePiece encoding and decoding by suffix-array matching.

What a batch of texts adds in new stretches (a run of spaces with the letters after it; no piece crosses their
edges) is concatenated and indexed by a suffix array; every piece of the vocabulary is found in it by binary
search, and its occurrences are edges over the text. Edges, sorted by where they end, are relaxed for all
stretches together. The vocabulary is a merge (BPE) model, whose result is not a path of highest score but the
one path on which every two neighbours merge to themselves alone: a prefix has exactly one such path, so an
edge is taken if it is compatible with the piece that ends where it starts. Compatibility of two pieces is
settled once by merging their letters, and remembered. Characters that no piece has become byte pieces.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import per_worker, slices

SPACE = "▁"
_GAP = 0x110000  # above all code points
_STRETCH = re.compile(f"{SPACE}+[^{SPACE}]*")


def suffix_array(codes: np.ndarray, depth: int) -> np.ndarray:
    """Positions sorted by the ``depth`` code points from there on, by doubling."""
    letters, rank = np.unique(codes, return_inverse=True)
    n, bits, length = len(codes), int(len(letters)).bit_length(), 1
    key = rank.astype(np.int64) + 1
    for k in range(1, max(1, min(depth, 62 // bits, n))):  # as many letters as a word holds are sorted at once
        key <<= bits
        key[: n - k] += rank[k:] + 1
        length = k + 1
    order = np.argsort(key, kind="stable")
    rank = np.empty(n, np.int64)
    rank[order] = np.r_[0, np.cumsum(key[order][1:] != key[order][:-1])]
    while length < depth:
        after = np.zeros(n, np.int64)
        after[: n - length] = rank[length:] + 1
        key = rank * (n + 1) + after
        order = np.argsort(key, kind="stable")
        change = np.r_[0, np.cumsum(key[order][1:] != key[order][:-1])]
        rank = np.empty(n, np.int64)
        rank[order] = change
        length *= 2
    return order


class PieceCoder:
    """Encodes and decodes with the pieces of a SentencePiece BPE model, which must add a space in front and keep spaces as they are."""

    def __init__(self, model: str, limit: int = 120_000):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model)
        n = sp.get_piece_size()
        every = [sp.id_to_piece(i) for i in range(n)]
        special = [sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i) for i in range(n)]
        self.byte = {int(p[3:5], 16): i for i, p in enumerate(every) if sp.is_byte(i)}
        self.id = {p: i for i, p in enumerate(every) if not special[i] and not sp.is_byte(i)}
        self.score = {p: sp.get_score(i) for p, i in self.id.items()}
        letters = {c for p in self.id for c in p}
        if any(SPACE in p.lstrip(SPACE) for p in self.id) or letters - self.id.keys() or len(self.byte) != 256:
            raise ValueError("a piece crosses a space, has a letter that is no piece, or bytes are missing")
        self.raw = [b"" if special[i] else bytes([int(p[3:5], 16)]) if sp.is_byte(i) else p.replace(SPACE, " ").encode() for i, p in enumerate(every)]
        self.unknown = n  # stands for a character without a piece
        self.pieces = sorted(p for p in self.id if self.merged(p) == [p])
        self.ids = np.array([self.id[p] for p in self.pieces])
        self.size = np.array([len(p) for p in self.pieces])
        self.text = dict(zip(self.ids.tolist(), self.pieces, strict=True))
        self.depth = int(self.size.max())
        self.table = np.full((len(self.pieces), self.depth), -1, np.int64)
        for i, p in enumerate(self.pieces):
            self.table[i, : len(p)] = [ord(c) for c in p]
        self.agree: dict[int, bool] = {}
        self.known: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.limit = limit

    def merged(self, text: str) -> list[str]:
        """The pieces of a short text: the best pair merges first, the leftmost of equals."""
        parts, score = list(text), self.score
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = score.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def compatible(self, keys: np.ndarray) -> np.ndarray:
        distinct, where = np.unique(keys, return_inverse=True)
        agree, out = self.agree, np.empty(len(distinct), bool)
        for i, k in enumerate(distinct.tolist()):
            v = agree.get(k)
            if v is None:
                a, b = divmod(k, self.unknown + 1)
                v = agree[k] = a == self.unknown or b == self.unknown or self.merged(self.text[a] + self.text[b]) == [self.text[a], self.text[b]]
            out[i] = v
        if len(agree) > 500_000:
            agree.clear()
        return out[where]

    def ranges(self, codes: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of every piece, the stretch of the suffix array that starts with it."""
        padded = np.r_[codes, np.full(self.depth, _GAP)]

        def search(after: bool) -> np.ndarray:
            low, high = np.zeros(len(self.table), np.int64), np.full(len(self.table), len(order))
            while (open_ := low < high).any():
                k = np.flatnonzero(open_)
                mid = (low[k] + high[k]) >> 1
                at, less, equal = order[mid], np.zeros(len(k), bool), np.ones(len(k), bool)
                for c in range(self.depth):
                    want = self.table[k, c]
                    live = equal & (want >= 0)
                    if not live.any():
                        break
                    have = padded[at + c]
                    less |= live & (have < want)
                    equal &= (have == want) | (want < 0)
                right = less | equal if after else less
                low[k[right]] = mid[right] + 1
                high[k[~right]] = mid[~right]
            return low

        return search(False), search(True)

    def add(self, stretches: list[str]) -> None:
        """Encodes new stretches together."""
        if not stretches:
            return
        sizes = np.fromiter(map(len, stretches), np.int64, len(stretches))
        codes = np.frombuffer(("\0".join(stretches) + "\0").encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
        begin = np.cumsum(sizes + 1) - sizes - 1
        codes[begin + sizes] = _GAP
        order = suffix_array(codes, self.depth)
        low, high = self.ranges(codes, order)
        n = high - low
        which = np.repeat(np.arange(len(n)), n)
        start = order[np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low, n)]
        length, piece = self.size[which], self.ids[which]
        letter = np.zeros(len(codes), bool)
        letter[start[length == 1]] = True
        lone = np.flatnonzero(~letter & (codes != _GAP))
        start, length, piece = np.r_[start, lone], np.r_[length, np.ones(len(lone), np.int64)], np.r_[piece, np.full(len(lone), self.unknown)]
        # relax by the place of the end in the stretch, for all stretches at once
        owner = np.repeat(begin, sizes + 1)
        end = start + length
        place = end - owner[start]
        by = np.argsort(place.astype(np.uint16) if place.max(initial=0) < 1 << 16 else place, kind="stable")
        start, end, piece = start[by], end[by], piece[by]
        last, came = np.full(len(codes) + 1, -1), np.zeros(len(codes) + 1, np.int64)
        cuts = np.r_[0, np.flatnonzero(np.diff(place[by])) + 1, len(by)]
        first = np.zeros(len(codes) + 1, bool)
        first[begin] = True
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            s, e, p = start[a:b], end[a:b], piece[a:b]
            ok = first[s].copy()
            rest = np.flatnonzero(~ok & (last[s] >= 0))
            ok[rest] = self.compatible(last[s[rest]] * (self.unknown + 1) + p[rest])
            last[e[ok]], came[e[ok]] = p[ok], s[ok]
        # back from the ends
        node, steps, open_ = begin + sizes, [], sizes > 0
        while open_.any():
            k = np.flatnonzero(open_)
            steps.append((k, last[node[k]], came[node[k]]))
            node = node.copy()
            node[k] = came[node[k]]
            open_ = node > begin
        own, pieces, where = (np.concatenate(x) for x in zip(*reversed(steps), strict=True)) if steps else (np.empty(0, np.int64),) * 3
        by = np.argsort(own, kind="stable")
        own, pieces, where = own[by], pieces[by], where[by]
        ends = np.cumsum(np.bincount(own, minlength=len(stretches)))
        odd = set(own[pieces == self.unknown].tolist())
        raw = pieces.astype("<u4").tobytes()
        for i, (t, a, b) in enumerate(zip(stretches, np.r_[0, ends[:-1]].tolist(), ends.tolist(), strict=True)):
            if i in odd:
                self.known[t] = np.array([y for x, at in zip(pieces[a:b], where[a:b], strict=True) for y in (self.bytes_of(codes[at]) if x == self.unknown else (x,))], "<u4").tobytes()
            else:
                self.known[t] = raw[4 * a : 4 * b]

    def bytes_of(self, code: int) -> list[int]:
        return [self.byte[y] for y in chr(code).encode("utf-8", "surrogatepass")]

    @staticmethod
    def stretches(text: str) -> list[str]:
        if not text:
            return []
        marked = SPACE + text.replace(" ", SPACE)
        if "\0" in marked or SPACE + SPACE in marked:
            return _STRETCH.findall(marked)
        return [SPACE + x for x in marked.split(SPACE)[1:]]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        cut = [self.stretches(t) for t in texts]
        distinct = {x: None for c in cut for x in c}
        if len(self.known) > self.limit:  # two generations: what is still in use moves to the young one
            self.old, self.known = self.known, {}
        new = []
        for x in distinct:
            if x not in self.known:
                if x in self.old:
                    self.known[x] = self.old[x]
                else:
                    new.append(x)
        self.add(new)
        return [np.frombuffer(b"".join(map(self.known.__getitem__, c)), "<u4") for c in cut]

    def decode(self, ids: np.ndarray) -> str:
        raw = b"".join(map(self.raw.__getitem__, ids.tolist()))
        return (raw[1:] if raw[:1] == b" " else raw).decode("utf-8", "replace")


def encode_pieces(docs: DataFrame, model: str) -> DataFrame:
    """(doc_id, ids binary: little-endian unsigned 32-bit): one row for each row of ``docs`` (doc_id, text).

    A null text counts as empty and has no ids; very long texts are encoded whole; repeated rows and null ids are
    kept; an empty table gives no rows; further columns are ignored. One pass, no shuffle.
    """

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = per_worker(PieceCoder, model)
        for batch in slices(batches, limit=4 << 20):
            ids = coder.encode([t or "" for t in batch.column("text").to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([x.tobytes() for x in ids], pa.binary())], ["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(mapped, "doc_id long, ids binary")


def round_trip(docs: DataFrame, model: str) -> DataFrame:
    """The rows of ``docs`` with n_pieces, ids_crc32, decoded_crc32, decoded_chars and same: whether decoding the ids gives the text.

    A null text counts as empty; a text that itself holds U+2581 gets a space there, and is not the same. Very
    long texts are encoded whole, repeated rows are rows each, an empty table gives no rows. A column of
    ``docs`` that has the name of one of the five, in either case, is replaced by it; all others are kept.
    """

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = per_worker(PieceCoder, model)
        for batch in slices(batches, limit=4 << 20):
            texts = [t or "" for t in batch.column("text").to_pylist()]
            ids = coder.encode(texts)
            back = [coder.decode(x) for x in ids]
            added = {
                "n_pieces": pa.array([len(x) for x in ids], pa.int64()),
                "ids_crc32": pa.array([zlib.crc32(x.tobytes()) for x in ids], pa.int64()),
                "decoded_crc32": pa.array([zlib.crc32(x.encode("utf-8", "surrogatepass")) for x in back], pa.int64()),
                "decoded_chars": pa.array([len(x) for x in back], pa.int64()),
                "same": pa.array([a == b for a, b in zip(texts, back, strict=True)], pa.bool_()),
            }
            kept = [c for c in batch.schema.names if c not in added]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *added.values()], [*kept, *added])

    added = ("n_pieces", "ids_crc32", "decoded_crc32", "decoded_chars", "same")
    kept = docs.select(*[docs[f"`{c}`"] for c in docs.columns if c.lower() not in added])
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema) + ", n_pieces long, ids_crc32 long, decoded_crc32 long, decoded_chars long, same boolean"
    return kept.mapInArrow(mapped, schema)

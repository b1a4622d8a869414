"""A hashed maximum-entropy language model, and texts' log-probabilities under it and under a unigram base.

The softmax is factored by classes nested in classes: a code by frequency with ARITY members a class leads to
every hot token, and to ``buckets`` classes into which all other tokens are dealt by hash; inside such a class
the unigram counts decide. P(token) is the product of the softmaxes along its way, each over sums of hashed
features: the previous token, the previous two, and the one before the previous (a skip). Offsets are the
logarithms of the members' shares of the counts; what the features add is trained by distributed, synchronous
gradient updates, a kind or two of features a round: each task runs over all its texts with the shared weights
and returns how often features occur and what the model expects; the sums over all tasks are compared, and every
weight of these kinds moves along its gradient (observed less expected) by the logarithm of their ratio, as in
iterative scaling. The next round starts from the model so far.

Texts are turned into codes once, in a table of the shared folder, from which rounds and scoring read. Counts of
the most frequent tokens, ``hot`` at most, are sent to every task; all rarer tokens are joined with the table of
counts, so base scores are exact whatever the vocabulary's size. Weights grow with the number of distinct
tokens up to MOST rows for each kind of feature.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, shuffle_partitions, slices

ARITY = 8
LEAST, MOST = 1 << 12, 1 << 16
#: Rounds of training: kinds of features (0 previous, 1 previous two, 2 skip) and how far their weights move.
ROUNDS = (((0,), 0.9), ((1, 2), 0.6))
BLOCKS, SALTS, STEP, SEEN = 128, 2, 8192, 1 << 20
_MULTIPLIERS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)


@dataclass(frozen=True)
class Vocabulary:
    """tokens: the hot ones, most frequent first, the end (the empty word) before them; counts: theirs; rest: by bucket, the mass of all other tokens; total, distinct: of all training tokens."""

    tokens: list[bytes]
    counts: np.ndarray
    rest: np.ndarray
    total: int
    distinct: int

    @property
    def hot(self) -> int:
        return len(self.tokens)

    @property
    def denominator(self) -> float:
        return self.total + 0.5 * (self.distinct + 1)

    @property
    def rows(self) -> int:
        """Rows of weights for a kind of feature: the power of two above a quarter of the distinct tokens, within bounds."""
        return min(MOST, max(LEAST, 1 << (self.distinct >> 2).bit_length()))

    @cached_property
    def tree(self) -> Tree:
        return Tree(np.r_[self.counts + 0.5, self.rest])


class Tree:
    """Nested classes of ARITY members. A leaf's way is ``size`` steps from ``start`` on in node (the class) and slot (its member there)."""

    def __init__(self, mass: np.ndarray):
        n = len(mass)
        heap = [(m, i) for i, m in enumerate(mass.tolist())]
        heapq.heapify(heap)
        members: list[list[tuple[float, int]]] = []
        take = (max(0, n - 2) % (ARITY - 1)) + 2
        while not members or len(heap) > 1:
            found = [heapq.heappop(heap) for _ in range(min(take, len(heap)))]
            heapq.heappush(heap, (sum(m for m, _ in found), n + len(members)))
            members.append(found)
            take = ARITY
        up, slot = np.full(n + len(members), -1), np.zeros(n + len(members), np.int32)
        self.offset = np.full((len(members), ARITY), -30.0, np.float32)
        for k, found in enumerate(members):
            for j, (m, i) in enumerate(found):
                up[i], slot[i] = k, j
            share = np.array([m for m, _ in found])
            self.offset[k, : len(found)] = np.log(share / share.sum())
        steps, at = [], np.arange(n)
        while (on := np.flatnonzero(up[at] >= 0)).size:
            steps.append((on, up[at[on]], slot[at[on]]))
            at[on] = n + up[at[on]]
        leaf, node, member = (np.concatenate(x) for x in zip(*steps, strict=True))
        order = np.argsort(leaf, kind="stable")
        self.size = np.bincount(leaf, minlength=n)
        self.start = np.cumsum(self.size) - self.size
        self.node, self.slot = node[order], member[order]


class Net:
    """Hashed weights (kind of feature, row, member) over the classes of a tree."""

    def __init__(self, vocabulary: Vocabulary, weights: np.ndarray):
        self.tree, self.weights = vocabulary.tree, weights
        self.used = [k for k in range(3) if weights[k].any()]
        self.shift = np.uint64(64 - (weights.shape[1] - 1).bit_length())
        self.start = len(vocabulary.counts) + len(vocabulary.rest)
        self.shares = np.exp(self.tree.offset.T.astype(np.float64))
        self.marks = (np.arange(len(self.tree.offset), dtype=np.uint64) + np.uint64(1)) * np.uint64(0x632BE59BD9B4E019)

    def contexts(self, codes: np.ndarray, first: np.ndarray) -> np.ndarray:
        """(3, tokens): hashes of the features; ``first`` marks the texts' first tokens, before which stands a code of its own."""
        one, two = np.r_[self.start, codes[:-1]], np.r_[self.start, self.start, codes[:-2]][: len(codes)]
        one[first] = self.start
        two[first] = self.start
        two[1:][first[:-1]] = self.start
        p, q = one.astype(np.uint64), two.astype(np.uint64)
        x = np.stack([p + np.uint64(1), p * np.uint64(1000003) + q + np.uint64(7), q + np.uint64(3 << 40)]) * _MULTIPLIERS[:, None]
        return x ^ (x >> np.uint64(29))

    def ways(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All steps on the ways of the tokens, one token after the other: how many each has; classes and members."""
        size = self.tree.size[codes]
        at = np.repeat(self.tree.start[codes] - np.cumsum(size) + size, size) + np.arange(size.sum())
        return size, self.tree.node[at], self.tree.slot[at]

    def rows(self, hashes: np.ndarray, size: np.ndarray, node: np.ndarray) -> np.ndarray:
        """The weights' rows of one kind of feature."""
        rows = np.repeat(hashes, size)
        rows += self.marks[node]
        rows *= np.uint64(0xFF51AFD7ED558CCD)
        rows >>= self.shift
        return rows.view(np.int64)

    def members(self, node: np.ndarray, rows: dict[int, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Of classes, the members' probabilities times a number, and that number."""
        z = np.take(self.tree.offset, node, axis=0)
        for k in self.used:
            z += np.take(self.weights[k], rows[k], axis=0)
        np.exp(z, out=z)
        return z, np.einsum("ij->i", z)

    def log_probabilities(self, codes: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        """Natural logarithms of the tokens' (or buckets') probabilities."""
        out = [np.empty(0)]
        for a in range(0, len(codes), STEP):
            size, node, slot = self.ways(codes[a : a + STEP])
            z, total = self.members(node, {k: self.rows(hashes[k, a : a + STEP], size, node) for k in self.used})
            out.append(np.add.reduceat(np.log(z[np.arange(len(z)), slot] / total), np.cumsum(size) - size, dtype=np.float64))
        return np.concatenate(out)

    def gradient(self, codes: np.ndarray, hashes: np.ndarray, kinds: tuple[int, ...]) -> np.ndarray:
        """(kinds, 2, members, weights' rows): what the model expects of every feature, and how often it occurs.

        Both are summed at once: an occurrence adds SEEN, more than a piece of texts can expect.
        """
        where, found, n = {k: [] for k in kinds}, [], self.weights.shape[1]
        for a in range(0, len(codes), STEP):
            size, node, slot = self.ways(codes[a : a + STEP])
            rows = {k: self.rows(hashes[k, a : a + STEP], size, node) for k in {*self.used, *kinds}}
            if self.used:
                z, total = self.members(node, rows)
                z = np.divide(z.T, total, dtype=np.float64)
            else:
                z = np.take(self.shares, node, axis=1)
            z[slot, np.arange(len(slot))] += SEEN
            found.append(z)
            for k in kinds:
                where[k].append(rows[k])
        z = np.concatenate(found, axis=1)
        sums = np.stack([[np.bincount(at, c, n) for c in z] for at in (np.concatenate(where[k]) for k in kinds)])
        times = np.floor(sums / SEEN)
        return np.stack([sums - times * SEEN, times], axis=1)


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of texts one after the other, A-Z lower-cased, and how many each text has; white space is ASCII's."""
    cut = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    flat, size = cut.flatten(), np.diff(cut.offsets.to_numpy()).astype(np.int64)
    some = pc.binary_length(flat).to_numpy(zero_copy_only=False) > 0  # at the ends of a text the cut leaves empty words
    if not some.all():
        size = np.bincount(np.repeat(np.arange(len(size)), size)[some], minlength=len(size))
        flat = flat.filter(pa.array(some))
    return flat, size


def count_tokens(train: DataFrame) -> DataFrame:
    """(token binary, n): counts over all texts; the end of a text is the empty token."""

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ends = 0
        for batch in slices(batches, limit=16 << 20):
            flat, size = words_of(batch.column("text"))
            counted, ends = flat.value_counts(), ends + len(size)
            yield pa.RecordBatch.from_arrays([counted.field("values").cast(pa.binary()), counted.field("counts")], ["token", "n"])
        if ends:
            yield pa.RecordBatch.from_arrays([pa.array([b""], pa.binary()), pa.array([ends], pa.int64())], ["token", "n"])

    return train.select("text").mapInArrow(mapped, "token binary, n long").groupBy("token").agg(F.sum("n").alias("n"))


def vocabulary(counts: DataFrame, hot: int, buckets: int) -> tuple[Vocabulary, int]:
    """The vocabulary and the least count of its tokens; tokens below that, and those never seen, are known by bucket only.

    How many tokens a count has is read from a histogram of a few hundred steps, so what is collected is
    ``hot`` rows at most (and the end), and a row for each bucket. Tokens of equal counts go together.
    """
    told = counts.agg(F.sum("n").alias("total"), F.count("*").alias("distinct")).first()
    step = F.floor(F.log2("n") * 16).cast("int")
    held, least = 0, None
    for r in sorted(counts.groupBy(step.alias("s")).agg(F.count("*").alias("c"), F.min("n").alias("m")).collect(), key=lambda r: -r.s):
        if held + r.c > hot:
            break
        held, least = held + r.c, r.m
    least = least if least is not None else (1 << 62)
    chosen = (F.col("n") >= least) | (F.col("token") == F.lit(b""))
    found = [(bytes(r.token), r.n) for r in counts.where(chosen).collect()]
    found.sort(key=lambda x: (x[0] != b"", -x[1], x[0]))
    rest = np.full(buckets, 0.5)  # a half for what was never seen
    for r in counts.where(~chosen).groupBy((F.crc32("token") % buckets).alias("b")).agg(F.sum(F.col("n") + 0.5).alias("m")).collect():
        rest[r.b] += r.m
    return Vocabulary([w for w, _ in found], np.array([n for _, n in found], np.int64), rest, int(told.total or 0), int(told.distinct or 0)), least


def _pieces(codes: list[bytes], size: int = 65536) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """Codes of texts one after the other, with marks of first tokens, in pieces of ``size``, each after (third) so many tokens of the piece before."""
    every = np.frombuffer(b"".join(codes), np.int32)
    first = np.zeros(len(every), bool)
    first[np.cumsum([0, *(len(c) // 4 for c in codes[:-1])])] = True
    for a in range(0, len(every), size):
        b = max(0, a - 2)
        yield every[b : a + size], first[b : a + size], a - b


def coded_texts(docs: DataFrame, words: Broadcast) -> DataFrame:
    """(uid, doc_id, n_tokens, n_known, base, codes, rare, times) of all texts, written once; base and n_known are of the hot tokens, the others and how often they occur are in rare and times."""

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, row = words.value, TaskContext.get().partitionId() << 40
        hot, buckets, known_words = v.hot, len(v.rest), pa.array(v.tokens[1:], pa.binary())
        logs = np.r_[np.log10(v.counts + 0.5), np.zeros(buckets)]
        for batch in slices(batches, limit=8 << 20):
            n = batch.num_rows
            if not n:
                continue
            flat, size = words_of(batch.column("text"))
            flat = flat.cast(pa.binary())
            at = pc.index_in(flat, known_words).fill_null(-1).to_numpy() + 1
            ends = np.cumsum(size + 1) - 1
            place = np.ones(len(at) + n, bool)
            place[ends] = False
            # rare words: a bucket by hash, and how often each occurs in its text
            away = np.flatnonzero(at == 0)
            named = flat.take(pa.array(away)).dictionary_encode()
            index, values = named.indices.to_numpy(), named.dictionary
            bucket = np.fromiter((zlib.crc32(w) % buckets for w in values.to_pylist()), np.int64, len(values))
            at[away] = hot + bucket[index]
            codes = np.zeros(len(at) + n, np.int32)  # 0: the end
            codes[place] = at
            owner = np.repeat(np.arange(n), size)[away]
            pairs, times = np.unique(owner * (len(values) + 1) + index, return_counts=True)
            offsets = np.searchsorted(pairs // (len(values) + 1), np.arange(n + 1)).astype(np.int32)
            starts = ends - size
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.arange(row, row + n)), batch.column("doc_id"), pa.array(size + 1), pa.array(np.add.reduceat(codes < hot, starts, dtype=np.int64)), pa.array(np.add.reduceat(logs[codes], starts)),
                    pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer((np.r_[0, ends + 1] * 4).astype(np.int32)), pa.py_buffer(codes)]),
                    pa.ListArray.from_arrays(pa.array(offsets), values.take(pa.array(pairs % (len(values) + 1)))), pa.ListArray.from_arrays(pa.array(offsets), pa.array(times)),
                ],
                ["uid", "doc_id", "n_tokens", "n_known", "base", "codes", "rare", "times"],
            )
            row += n

    return materialise(docs.mapInArrow(mapped, "uid long, doc_id long, n_tokens long, n_known long, base double, codes binary, rare array<binary>, times array<long>"), "codes")


_SUM, _SUM_DDL = ["block", "salt", "x"], "block int, salt int, x binary"


def _summed(texts: DataFrame, words: Broadcast, weights: np.ndarray, kinds: tuple[int, ...]) -> np.ndarray:
    """The sums over all texts of Net.gradient; every task returns BLOCKS rows, added up by tasks and then on the driver, BLOCKS * SALTS rows whatever the input."""
    spark = texts.sparkSession
    shared = spark.sparkContext.broadcast(weights)
    shape = (len(kinds), 2, ARITY, weights.shape[1])

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net, total = Net(words.value, shared.value), np.zeros(shape)
        for batch in slices(batches, "codes", 4 << 20):
            for codes, first, skip in _pieces(batch.column("codes").to_pylist()) if batch.num_rows else ():
                total += net.gradient(codes[skip:], net.contexts(codes, first)[:, skip:], kinds)
        if total.any():
            salt = TaskContext.get().partitionId() % SALTS
            cut = np.array_split(total.ravel().astype(np.float32), BLOCKS)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(BLOCKS, dtype=np.int32)), pa.array(np.full(BLOCKS, salt, np.int32)), pa.array([x.tobytes() for x in cut], pa.binary())], _SUM)

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, x in zip(batch.column("block").to_pylist(), batch.column("x").to_pylist(), strict=True):
                sums[block] = sums.get(block, 0.0) + np.frombuffer(x, np.float32).astype(np.float64)
        for block, x in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([0], pa.int32()), pa.array([x.astype(np.float32).tobytes()], pa.binary())], _SUM)

    sums = texts.select("codes").mapInArrow(mapped, _SUM_DDL).repartition(max(BLOCKS, shuffle_partitions(spark)), "block", "salt").mapInArrow(added, _SUM_DDL)
    total = [np.zeros(len(x)) for x in np.array_split(np.empty(int(np.prod(shape))), BLOCKS)]
    for r in sums.collect():
        total[r.block] += np.frombuffer(r.x, np.float32)
    shared.unpersist()
    return np.concatenate(total).reshape(shape)


def train(texts: DataFrame, words: Broadcast, rounds=ROUNDS, smoothing: float = 20.0) -> np.ndarray:
    """Weights after ``rounds``, each over all ``texts`` (codes); ``smoothing`` is added to what was observed and expected, so rare features move little."""
    v = words.value
    weights = np.zeros((3, v.rows, ARITY), np.float32)
    for kinds, rate in rounds if v.total else ():
        for k, (expected, observed) in zip(kinds, _summed(texts, words, weights, kinds), strict=True):
            weights[k] = np.clip(weights[k] + rate * np.log((observed + smoothing) / (expected + smoothing)).T, -9, 9)
    return weights


def score_texts(docs: DataFrame, training, hot: int = 150_000, buckets: int = 1024, rounds=ROUNDS) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) for every row of ``docs`` (doc_id, text).

    ``training`` is a boolean column of doc_id: the rows to learn from; held_out is its opposite. Tokens are the
    words of the text, A-Z lower-cased, and one end. base_score sums log10((c + 0.5) / (N + 0.5 * (V + 1))) over
    tokens with the counts of all training texts; score is the model's log10 probability. A null text counts as
    empty: it has its end. Null and repeated ids are rows like others; very long texts are scored whole; tokens
    whose counts tie at the edge of the hot ones are all hot or all not; without training texts all tokens are
    unknown and both scores are those of the counts; an empty table gives no rows; further columns are ignored.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    counts = materialise(count_tokens(docs.where(training)), "counts")
    v, least = vocabulary(counts, hot, buckets)
    if not v.total:  # nothing was learnt: the end is a token without a count
        v = Vocabulary([b""], np.zeros(1, np.int64), v.rest, 0, 0)
    v.tree  # made once, here, and sent with the vocabulary: ``hot`` tokens and ``buckets`` at most
    words = spark.sparkContext.broadcast(v)
    texts = coded_texts(docs, words)
    learnt = spark.sparkContext.broadcast(train(texts.where(training), words, rounds))

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = Net(words.value, learnt.value)
        inside = np.r_[np.zeros(words.value.hot), -np.log10(words.value.rest)]
        for batch in slices(batches, "codes", 4 << 20):
            codes = batch.column("codes").to_pylist()
            if not codes:
                continue
            model = np.concatenate([net.log_probabilities(c[skip:], net.contexts(c, first)[:, skip:]) / np.log(10) + inside[c[skip:]] for c, first, skip in _pieces(codes)])
            starts = np.cumsum([0, *(len(c) // 4 for c in codes[:-1])])
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("uid", "doc_id", "n_tokens", "n_known", "base")), pa.array(np.add.reduceat(model, starts))], ["uid", "doc_id", "n_tokens", "n_known", "base", "model"])

    scored = texts.select("uid", "doc_id", "n_tokens", "n_known", "base", "codes").mapInArrow(mapped, "uid long, doc_id long, n_tokens long, n_known long, base double, model double")
    if not v.total:
        scored = scored.withColumn("n_known", F.lit(0).cast("long"))
    rare = texts.where(F.size("rare") > 0).select("uid", F.explode(F.arrays_zip("rare", "times")).alias("r")).select("uid", F.col("r.rare").alias("token"), F.col("r.times").alias("k"))
    rare = rare.join(counts.where(F.col("n") < least), "token", "left")
    logs = F.col("k") * F.log10(F.coalesce("n", F.lit(0)) + 0.5)
    zero = F.lit(0).cast("long")
    rare = rare.select("uid", F.lit(None).cast("long").alias("doc_id"), zero.alias("n_tokens"), F.when(F.col("n").isNotNull(), F.col("k")).otherwise(zero).alias("n_known"), logs.alias("base"), logs.alias("model"))
    both = scored.union(rare).groupBy("uid")
    out = both.agg(F.max("doc_id").alias("doc_id"), *[F.sum(c).alias(c) for c in ("n_tokens", "n_known", "base", "model")])
    return out.select("doc_id", (~training).alias("held_out"), "n_tokens", "n_known", F.lit(v.total).cast("long").alias("train_tokens"), (F.col("base") - F.col("n_tokens") * float(np.log10(v.denominator))).alias("base_score"), F.col("model").alias("score"))

"""Approximate nearest neighbours by largest inner product: inverted lists with product-quantised residuals.

Coarse centroids, about the square root of the rows in number, and the codebooks of the residuals are learnt on
a bounded sample; every vector is then indexed: it goes to the list of its nearest centroid with one byte for
each part of its residual, in units of its list's spread, and the length of what the code leaves out. How many
lists a query probes follows from the data: if residuals are normal with their list's spread and the residuals'
common shape, each list has an expected number of vectors above the query's k-th nearest, and lists are probed,
the most promising first, until ``share`` of that number is covered and ``floor`` codes are met. Where vectors are
not so distributed (norms with heavy tails, say), that is too few: a bounded number of the queries is answered by
brute force, and lists are probed as deep as these need to meet all but ``miss`` of their neighbours. There the
query's table of inner products with the codebooks (asymmetric distances) ranks the codes. Codes that can be among
the ``k`` nearest by what they leave out, and the best ``rerank`` of a query over all its lists, are joined with
their original vectors and scored in double precision; of copies, which no code tells apart, those of the smallest ids.

Codes travel in blocks of whole lists (a list above the size of a block is cut into several), queries in blocks
of neighbours; a block of queries goes to the blocks that hold a list it probes, and every such meeting is a
row of its own, so a list with a third of all rows is work for many tasks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, shuffle_partitions
from .vectors import kind_of, matrix, rows_of, sample

#: Deviations by which a code may understate an inner product and still be looked at.
MARGIN = 2.5


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    half = (centres**2).sum(1) / 2
    return np.concatenate([np.argmin(half - x[a : a + 2048] @ centres.T, axis=1) for a in range(0, max(1, len(x)), 2048)])


def kmeans(x: np.ndarray, k: int, rounds: int = 12, seed: int = 8) -> np.ndarray:
    rng = np.random.default_rng(seed)
    centres = x[rng.permutation(len(x))[:k]].copy()
    for _ in range(rounds):
        nearest = _nearest(x, centres)
        n = np.bincount(nearest, minlength=len(centres))
        sums = np.stack([np.bincount(nearest, c, len(centres)) for c in x.T], axis=1)
        centres[n > 0] = sums[n > 0] / n[n > 0, None]
        if (n == 0).any():
            centres[n == 0] = x[rng.integers(0, len(x), (n == 0).sum())]
    return centres


@dataclass(frozen=True)
class Index:
    """coarse: centroids; spread: of each list, the residuals' standard deviation in a direction; books[m]: codewords of part m of the residuals.

    scale: of each list, the unit of its residuals' codes; shape, blur: second moments of the directions of residuals and of what codes leave out, 1 in a direction on average.
    """

    coarse: np.ndarray
    spread: np.ndarray
    books: np.ndarray
    scale: np.ndarray
    shape: np.ndarray
    blur: np.ndarray

    def lists(self, x: np.ndarray) -> np.ndarray:
        return _nearest(x, self.coarse)

    def parts(self, x: np.ndarray) -> np.ndarray:
        """Components, padded with zeros to equal parts: (part, row, component)."""
        m, _, width = self.books.shape
        padded = np.zeros((len(x), m * width))
        padded[:, : x.shape[1]] = x
        return padded.reshape(len(x), m, width).transpose(1, 0, 2)

    def codes(self, x: np.ndarray, lists: np.ndarray) -> np.ndarray:
        r = self.parts((x - self.coarse[lists]) / self.scale[lists, None])
        return np.stack([_nearest(p, b) for p, b in zip(r, self.books, strict=True)], axis=1).astype(np.uint8)

    def left_out(self, x: np.ndarray, lists: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """What the codes leave out of the vectors."""
        told = np.concatenate([b[c] for b, c in zip(self.books, codes.T, strict=True)], axis=1)[:, : x.shape[1]]
        return x - self.coarse[lists] - told * self.scale[lists, None]

    def tables(self, q: np.ndarray) -> np.ndarray:
        """Inner products of the queries' parts with the codewords: (query, part, codeword)."""
        return np.einsum("mqw,mcw->qmc", self.parts(q), self.books).astype(np.float32)

    def left(self, q: np.ndarray, sizes: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(query, list) each: the share of its ``k`` nearest that a query can expect in this list and all less promising ones, and the codes in more promising ones."""
        mean, deviation = q @ self.coarse.T, _along(q, self.shape)[:, None] * self.spread + 1e-12
        low, high = (mean - 9 * deviation).min(axis=1), (mean + 9 * deviation).max(axis=1)

        def above(t: np.ndarray) -> np.ndarray:
            z = np.clip((t[:, None] - mean) / deviation, -9, 9)
            return sizes / (1 + np.exp(1.5976 * z + 0.07056 * z**3))  # the normal tail

        for _ in range(40):  # where k vectors are expected above
            middle = (low + high) / 2
            many = above(middle).sum(axis=1) > k
            low, high = np.where(many, middle, low), np.where(many, high, middle)
        expected = above(low)
        order = np.argsort(-expected, axis=1, kind="stable")
        ranked = np.take_along_axis(expected, order, 1)
        left, before = np.empty_like(expected), np.empty(expected.shape, np.int64)
        # summed from the least, so that shares far below 1 are told apart
        np.put_along_axis(left, order, np.cumsum(ranked[:, ::-1], axis=1)[:, ::-1] / ranked.sum(axis=1, keepdims=True), 1)
        np.put_along_axis(before, order, np.cumsum(sizes[order], axis=1) - sizes[order], 1)
        return left, before

    def probed(self, q: np.ndarray, sizes: np.ndarray, k: int, share: float, floor: int, least: float = 1.0) -> np.ndarray:
        """(query, list): the lists to probe, from the lists' ``sizes``; those with ``least`` left or more are probed too."""
        left, before = self.left(q, sizes, k)
        return ((left >= min(1 - share, least)) | (before < floor)) & (sizes > 0)


def _along(q: np.ndarray, shape: np.ndarray) -> np.ndarray:
    """The deviation along each query of vectors of this shape, if it is 1 in a direction on average."""
    return np.sqrt(np.maximum(((q @ shape) * q).sum(axis=1), 0))


def _shape(x: np.ndarray) -> np.ndarray:
    """Second moments of the directions of ``x``, 1 in a direction on average."""
    u = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
    return u.T @ u * (x.shape[1] / max(1, np.count_nonzero(u.any(axis=1))))


def learn(x: np.ndarray, lists: int, parts: int) -> Index:
    d = x.shape[1]
    coarse = kmeans(x, min(lists, len(x)))
    width = -(-d // parts)
    ones = np.ones(len(coarse))
    empty = Index(coarse, ones, np.zeros((parts, 1, width)), ones, np.eye(d), np.eye(d))
    at = empty.lists(x)
    residual = x - coarse[at]
    n, square = np.bincount(at, minlength=len(coarse)), np.bincount(at, (residual**2).sum(axis=1), len(coarse))
    # a list of few sampled rows borrows from all: their own centroid fits them too well
    spread = np.sqrt((square + 8 * square.sum() / len(x)) / (np.maximum(1, n - 1) + 8) / d)
    scale = spread / (np.sqrt((spread**2).mean()) or 1.0)
    scale[scale == 0] = 1.0
    books = np.stack([kmeans(p, min(256, len(p)), seed=9 + i) for i, p in enumerate(empty.parts(residual / scale[at, None]))])
    index = Index(coarse, spread, books, scale, _shape(residual), np.eye(d))
    return replace(index, blur=_shape(index.left_out(x, at, index.codes(x, at))))


def search(table: DataFrame, k: int = 20, every: int = 20, share: float = 0.985, floor: int = 1024, parts: int | None = None, rerank: int = 80, block: int | None = None, bound: int = 8192, lists: int | None = None, miss: float = 0.02, tried: int = 128) -> DataFrame:
    """(query_id, rank, vec_id, score) of the rows of ``table`` (vec_id, embedding) whose vec_id is divisible by ``every``.

    score is the inner product in double precision on the original vectors, rank counts from 1, the nearest first, ties to
    the smaller vec_id; a query never finds rows of its own id; with fewer than ``k`` candidates all are
    returned that the probed lists hold. Vectors that are null, empty, zero or hold null or non-finite
    components, those of another length than most of the sample, and rows without an id take no part.
    Rows that share a vec_id are searched each and the best of them is returned. An empty table gives no rows;
    further columns are ignored. There are ``lists`` lists (by default the square root of the rows, 1,024 at most),
    learnt on ``bound`` rows; a block holds ``block`` codes (by default an eighth of the rows, 131,072 at most). A part is two
    components by default. ``tried`` queries, those with the smallest hashes of their ids, are answered by brute force.
    """
    rows = rows_of(table).where("v is not null and vec_id is not null")
    x, n = sample(rows, bound), rows.count()
    d, kind = x.shape[1], kind_of(table)
    index = learn(x, lists or min(1024, max(8, round(n**0.5))), min(parts or -(-d // 2), d)) if len(x) else Index(np.zeros((1, 1)), np.zeros(1), np.zeros((1, 1, 1)), np.ones(1), np.eye(1), np.eye(1))
    block = block or min(131072, max(1024, -(-n // 8)))
    shared = table.sparkSession.sparkContext.broadcast(index)  # 1,024 centroids and 256 codewords for each part at most

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        for batch in batches:
            v, ok = matrix(batch.column("v"), d)
            ids, v = batch.column("vec_id").filter(pa.array(ok)), v[ok]
            if not len(v):
                continue
            at = index.lists(v)
            codes = index.codes(v, at)
            out = np.linalg.norm(index.left_out(v, at, codes), axis=1).astype(np.float32)
            square = ((v - index.coarse[at]) ** 2).sum(axis=1)
            yield pa.RecordBatch.from_arrays([ids, pa.array(at.astype(np.int32)), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(out), pa.array(square)], ["vec_id", "list", "code", "out", "square"])

    indexed = materialise(rows.mapInArrow(assign, "vec_id long, list int, code binary, out float, square double"), "ivf")
    sizes, square = np.zeros(len(index.coarse), np.int64), np.zeros(len(index.coarse))
    for r in indexed.groupBy("list").agg(F.count("*").alias("c"), F.sum("square").alias("s")).collect():  # a row for each list
        sizes[r.list], square[r.list] = r.c, r.s
    if d:  # the spread of all rows, not of the sample
        index = replace(index, spread=np.sqrt((square + 8 * square.sum() / max(1, sizes.sum())) / (sizes + 8) / d))
        shared = table.sparkSession.sparkContext.broadcast(index)
    least = _least(rows, shared, sizes, k, every, miss, tried, d)
    # lists in order fill blocks; a list above a block has blocks of its own
    first, pieces, at, room = np.zeros(len(sizes), np.int64), np.maximum(1, -(-sizes // block)), -1, 0
    for i, c in enumerate(sizes.tolist()):
        if pieces[i] > 1 or c > room:
            at, room = at + 1, block
        first[i] = at
        at, room = at + int(pieces[i]) - 1, room - c if pieces[i] == 1 else 0
    lookup = lambda values: F.array(*map(F.lit, values.tolist()))[F.col("list")]
    place = (lookup(first) + F.pmod(F.xxhash64("vec_id"), lookup(pieces))).cast("int")
    codes = indexed.withColumn("block", place).groupBy("block").agg(F.sort_array(F.collect_list(F.struct("list", "vec_id", "code", "out"))).alias("r"))
    codes = codes.select("block", F.col("r.vec_id").alias("ids"), F.col("r.list").alias("lists"), F.col("r.code").alias("codes"), F.col("r.out").alias("outs"))

    # queries with neighbours beside them, in blocks
    asked = rows.where(F.col("vec_id") % every == 0).mapInArrow(_packed(shared, d, kind), "query_id long, list int, q binary")
    many = max(1, block // 32)
    per = lookup(np.maximum(1, -(-np.add.reduceat(sizes, np.arange(0, len(sizes), 8)).repeat(8)[: len(sizes)] // (every * many))))
    asked = asked.withColumn("part", F.pmod(F.xxhash64("query_id"), per)).groupBy(F.floor(F.col("list") / 8).alias("g"), "part").agg(F.sort_array(F.collect_list(F.struct("query_id", "q"))).alias("r"))

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        for batch in batches:
            for r in batch.column("r").to_pylist():
                q = np.frombuffer(b"".join(x["q"] for x in r), kind).astype(np.float64).reshape(-1, d)
                probed = index.probed(q, sizes, k, share, floor, least)
                goes: dict[int, np.ndarray] = {}
                for i in np.flatnonzero(probed.any(axis=0)):
                    for b in range(first[i], first[i] + pieces[i]):
                        goes[b] = goes.get(b, False) | probed[:, i]
                for b, who in goes.items():
                    chosen = np.flatnonzero(who)
                    yield pa.RecordBatch.from_arrays([pa.array([b], pa.int32()), pa.array([[r[i]["query_id"] for i in chosen]], pa.list_(pa.int64())), pa.array([q[chosen].astype(kind).tobytes()], pa.binary()), pa.array([np.packbits(probed[chosen], axis=1).tobytes()], pa.binary())], ["block", "qids", "qs", "probed"])

    met = asked.select("r").mapInArrow(meet, "block int, qids array<long>, qs binary, probed binary").join(codes, "block")
    met = met.repartition(max(shuffle_partitions(table.sparkSession), 1), F.xxhash64("block", "qids"))

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        for batch in batches:
            for i in range(batch.num_rows):
                qids, ids, lists_, outs = (np.asarray(batch.column(c)[i].values) for c in ("qids", "ids", "lists", "outs"))
                q = np.frombuffer(batch.column("qs")[i].as_py(), kind).astype(np.float64).reshape(-1, d)
                code = np.frombuffer(b"".join(batch.column("codes")[i].as_py()), np.uint8).reshape(len(ids), -1).T.astype(np.intp)
                probed = np.unpackbits(np.frombuffer(batch.column("probed")[i].as_py(), np.uint8).reshape(len(q), -1), axis=1)[:, : len(index.coarse)].astype(bool)
                offset, blur, scale, found = (q @ index.coarse.T).astype(np.float32), _along(q, index.blur), index.scale.astype(np.float32)[lists_], []
                for j in range(len(q)):
                    table_ = index.tables(q[j : j + 1])[0]
                    mine = np.flatnonzero(probed[j][lists_] & (ids != qids[j]))
                    chosen = code[:, mine] if len(mine) < len(ids) else code
                    promise = np.zeros(len(mine), np.float32)
                    for t, c in zip(table_, chosen, strict=True):
                        promise += t[c]
                    promise = promise * scale[mine] + offset[j][lists_[mine]]
                    # by chance what a code leaves out adds MARGIN deviations or more to few
                    reach = promise + np.float32(MARGIN * blur[j] / np.sqrt(d)) * outs[mine]
                    near = np.arange(len(mine))
                    if len(mine) > rerank:
                        top = -np.partition(-promise, (k - 1, rerank - 1))
                        near = np.flatnonzero((promise >= top[rerank - 1]) | (reach >= top[k - 1]))
                    near = near[np.lexsort((ids[mine[near]], outs[mine[near]], -promise[near]))]
                    # of codes that are alike in all, so of copies too, only the smallest ids can be found
                    first_ = np.r_[True, (promise[near][1:] != promise[near][:-1]) | (outs[mine[near]][1:] != outs[mine[near]][:-1])][: len(near)]
                    run = np.arange(len(near)) - np.maximum.accumulate(np.where(first_, np.arange(len(near)), 0))
                    near = near[run < rerank]
                    found.append((np.full(len(near), qids[j]), ids[mine[near]], promise[near], reach[near]))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(z)) for z in zip(*found, strict=True)], ["query_id", "vec_id", "promise", "reach"])

    best, by = met.mapInArrow(answer, "query_id long, vec_id long, promise float, reach float"), Window.partitionBy("query_id")
    best = best.withColumn("r", F.row_number().over(by.orderBy(F.col("promise").desc(), "vec_id"))).withColumn("least", F.min(F.when(F.col("r") <= k, F.col("promise"))).over(by))
    best = best.where((F.col("r") <= rerank) | (F.col("reach") >= F.col("least"))).select("query_id", "vec_id")
    # originals of the survivors, then their queries
    queries = rows.where(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("query_id"), F.col("v").alias("q"))
    pairs = best.distinct().join(rows, "vec_id").join(queries, "query_id")

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            (x, ok), (q, _) = matrix(batch.column("v"), d), matrix(batch.column("q"), d)
            keep = pa.array(ok)
            yield pa.RecordBatch.from_arrays([batch.column("query_id").filter(keep), batch.column("vec_id").filter(keep), pa.array((x[ok] * q[ok]).sum(axis=1))], ["query_id", "vec_id", "score"])

    scored = pairs.mapInArrow(exact, "query_id long, vec_id long, score double").groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    ranked = scored.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _least(rows: DataFrame, shared, sizes: np.ndarray, k: int, every: int, miss: float, tried: int, d: int) -> float:
    """The share left (see Index.left) down to which lists must be probed for all but ``miss`` of the ``k`` nearest of ``tried`` queries, by brute force over all rows."""
    asked = [(r.vec_id, r.v) for r in rows.where(F.col("vec_id") % every == 0).orderBy(F.xxhash64("vec_id", F.lit(8)), "vec_id").limit(tried).collect() if len(r.v) == d]
    if not asked:
        return 1.0
    qids, q = np.array([i for i, _ in asked]), np.array([v for _, v in asked], np.float64)

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [(np.zeros(0), np.zeros(0, np.int64), np.zeros(0, np.int32))] * len(q)
        for batch in batches:
            v, ok = matrix(batch.column("v"), d)
            ids, v = np.asarray(batch.column("vec_id"))[ok], v[ok]
            at = shared.value.lists(v).astype(np.int32) if len(v) else np.zeros(0, np.int32)
            for j, s in enumerate(q @ v.T):
                mine = np.flatnonzero(ids != qids[j])
                if len(mine) > k:
                    mine = mine[np.argpartition(-s[mine], k - 1)[:k]]
                s, i, a = (np.concatenate(z) for z in zip(best[j], (s[mine], ids[mine], at[mine]), strict=True))
                top = np.lexsort((i, -s))[:k]
                best[j] = s[top], i[top], a[top]
        if best:
            s, i, a = (np.concatenate(z) for z in zip(*best, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(len(q), dtype=np.int32), [len(b[0]) for b in best])), pa.array(s), pa.array(i), pa.array(a)], ["q", "score", "vec_id", "list"])

    found = rows.mapInArrow(near, "q int, score double, vec_id long, list int")
    found = found.withColumn("r", F.row_number().over(Window.partitionBy("q").orderBy(F.col("score").desc(), "vec_id"))).where(F.col("r") <= k).select("q", "list").collect()
    left, _ = shared.value.left(q, sizes, k)
    needed = np.sort([left[r.q, r.list] for r in found])
    return float(needed[int(miss * len(needed))]) if len(needed) else 1.0


def _packed(shared, d: int, kind: str):
    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v, ok = matrix(batch.column("v"), d)
            ids, v = batch.column("vec_id").filter(pa.array(ok)), v[ok]
            if len(v):
                yield pa.RecordBatch.from_arrays([ids, pa.array(shared.value.lists(v).astype(np.int32)), pa.array([x.tobytes() for x in v.astype(kind)], pa.binary())], ["query_id", "list", "q"])

    return mapped

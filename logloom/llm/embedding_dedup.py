"""Near-duplicate embeddings by iterative quantisation and multi-index Hamming tables.

A rotation learnt on a bounded sample (principal axes about the mean, then rounds of signs and Procrustes) gives
every vector a balanced 64-bit code. The tables are seeded sets of bits of the code: vectors that agree on a set
are in one bucket and are compared there by their original vectors, in double precision. A pair that shares
several buckets is taken in the first of them only, so links are counted once. Equal vectors are one vector with
a count. A bucket with more than ``tile`` rows is dealt into tiles that meet two by two, in as many tasks. Tasks
return link counts and a spanning forest, not pairs, so a group of n near copies costs rows in proportion to its
tiles and not n squared.

A set has about as many bits as the logarithm of the rows, so that buckets stay small. From the spread of the
sample along the axes follows with what probability p a pair at the wanted cosine differs in a bit; there are as
many tables as make 1 - (1 - (1 - p) ** width) ** tables reach ``recall``, and narrower sets where that would
take more than MOST tables.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Forest, materialise, runs, shuffle_partitions
from .components import components
from .vectors import kind_of, matrix, rows_of, sample

MOST = 64


def learn_rotation(x: np.ndarray, bits: int = 64, rounds: int = 40, seed: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(mean, axes): the code of v is the signs of (v / |v| - mean) @ axes. Fewer components than bits are first spread over a seeded orthonormal frame."""
    rng, d = np.random.default_rng(seed), x.shape[1]
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    mean = x.mean(axis=0)
    x = x - mean
    if d >= bits:
        values, vectors = np.linalg.eigh(x.T @ x)
        base = vectors[:, np.argsort(-values)[:bits]]
    else:
        base = np.linalg.qr(rng.standard_normal((bits, d)))[0].T
    y = x @ base
    r = np.linalg.qr(rng.standard_normal((bits, bits)))[0]
    for _ in range(rounds):
        u, _, w = np.linalg.svd(np.where(y @ r >= 0, 1.0, -1.0).T @ y)
        r = (u @ w).T
    return mean, base @ r


def codes(v: np.ndarray, mean: np.ndarray, axes: np.ndarray) -> np.ndarray:
    unit = v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), np.finfo(float).tiny)
    return np.packbits((unit - mean) @ axes >= 0, axis=1, bitorder="little").view("<u8").ravel()


def differing(x: np.ndarray, mean: np.ndarray, axes: np.ndarray, cosine: float) -> float:
    """The probability that two vectors at ``cosine`` differ in a bit, for a difference in no special direction."""
    spread = ((x / np.linalg.norm(x, axis=1, keepdims=True) - mean) @ axes).var(axis=0).mean()
    along = 2 * (1 - cosine) * (axes**2).sum(axis=0).mean() / len(axes)
    return float(np.arccos(np.clip(1 - along / max(2 * spread, 1e-12), -1, 1)) / np.pi)


def tables(rows: int, p: float, recall: float, bits: int = 64, seed: int = 7) -> np.ndarray:
    """Masks of the tables: disjoint sets of bits of a seeded order, then of a further one, and so on."""
    width = min(24, max(8, round(np.log2(max(1, rows) / 16))))
    need = lambda w: np.log(1 - recall) / np.log1p(-min(1 - 1e-9, max(1e-12, (1 - p) ** w)))
    while width > 1 and need(width) > MOST:
        width -= 1
    rng, masks = np.random.default_rng(seed), []
    for _ in range(max(1, int(np.ceil(min(MOST, need(width)))))):
        if len(masks) % (bits // width) == 0:
            order = rng.permutation(bits)
        at = len(masks) % (bits // width) * width
        masks.append(sum(1 << int(b) for b in order[at : at + width]))
    return np.array(masks, np.uint64)


def near_links(rows: DataFrame, kind: str, cosine: float, recall: float, tile: int, bound: int) -> DataFrame:
    """(node, other, n) from ``rows`` (node, c, v), c equal vectors each: per task, n links that each of a node's vectors has; or, with n = 0, an edge of a spanning forest."""
    learnt = sample(rows.withColumnRenamed("node", "vec_id"), bound)
    d = learnt.shape[1]
    mean, axes = learn_rotation(learnt) if len(learnt) else (np.zeros(d), np.zeros((d, 64)))
    masks = tables(rows.count(), differing(learnt, mean, axes, cosine) if len(learnt) else 0.5, recall)
    scheme = "node long, c long, tab int, win long, code long, x binary"

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 2048):
                batch = whole.slice(at, 2048)
                v, ok = matrix(batch.column("v"), d)
                keep, v = pa.array(ok), v[ok]
                code, n, t = codes(v, mean, axes), len(v), len(masks)
                packed = pa.array([x.tobytes() for x in v.astype(kind)], pa.binary())
                again = pa.array(np.repeat(np.arange(n), t))
                yield pa.RecordBatch.from_arrays([batch.column("node").filter(keep).take(again), batch.column("c").filter(keep).take(again), pa.array(np.tile(np.arange(t, dtype=np.int32), n)), pa.array((code[:, None] & masks[None, :]).astype(np.uint64).view(np.int64).ravel()), pa.array(np.repeat(code.view(np.int64), t)), packed.take(again)], ["node", "c", "tab", "win", "code", "x"])

    table = materialise(rows.mapInArrow(index, scheme), "index")
    sizes = table.groupBy("tab", "win").agg(F.count("*").alias("m")).where("m > 1").select("tab", "win", F.expr(f"cast((m + {tile - 1}) div {tile} as int)").alias("parts"))
    # of a large bucket, every row goes to the meetings of its own tile with each tile; a row alone in its bucket meets nobody
    dealt = table.join(sizes, ["tab", "win"]).withColumn("own", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    dealt = dealt.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    dealt = dealt.select("tab", "win", F.least("own", "o").alias("i"), F.greatest("own", "o").alias("j"), "own", "node", "c", "code", "x")
    dealt = dealt.repartition(shuffle_partitions(rows.sparkSession), "tab", "win", "i", "j").sortWithinPartitions("tab", "win", "i", "j", "own")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for tab, i, j, own, node, c, code, v in _buckets(batches, d, kind):
            unit = v / np.linalg.norm(v, axis=1, keepdims=True)
            forest, counts = Forest(len(v)), np.zeros(len(v), np.int64)
            left = np.flatnonzero(own == i)
            right = left if i == j else np.flatnonzero(own == j)
            for at in range(0, len(left), 512):
                a = left[at : at + 512]
                p, q = np.nonzero(unit[a] @ unit[right].T >= cosine - 1e-9)
                p, q = a[p], right[q]
                once = p < q if i == j else np.ones(len(p), bool)
                p, q = p[once], q[once]
                if len(p):
                    differ, first = code[p] ^ code[q], np.ones(len(p), bool)
                    for m in masks[:tab]:
                        first &= (differ & m) != 0
                    p, q = p[first], q[first]
                    exact = np.einsum("ij,ij->i", v[p], v[q]) / (np.linalg.norm(v[p], axis=1) * np.linalg.norm(v[q], axis=1)) >= cosine
                    p, q = p[exact], q[exact]
                    np.add.at(counts, p, c[q])
                    np.add.at(counts, q, c[p])
                    forest.link(p, q)
            roots = forest.roots()
            hung, linked = np.flatnonzero(roots != np.arange(len(roots))), np.flatnonzero(counts)
            if len(linked):
                yield pa.RecordBatch.from_arrays([pa.array(np.r_[node[linked], node[hung]]), pa.array(np.r_[node[linked], node[roots[hung]]]), pa.array(np.r_[counts[linked], np.zeros(len(hung), np.int64)])], ["node", "other", "n"])

    return dealt.mapInArrow(compare, "node long, other long, n long")


def _buckets(batches: Iterator[pa.RecordBatch], d: int, kind: str) -> Iterator[tuple]:
    """Meetings of two rows or more, one after the other; rows arrive sorted and a meeting may span batches."""
    held: list[pa.RecordBatch] = []

    def whole(parts: list[pa.RecordBatch]) -> Iterator[tuple]:
        t = pa.Table.from_batches(parts).combine_chunks()
        tab, win, i, j, own, node, n, code = (t.column(c).to_numpy() for c in ("tab", "win", "i", "j", "own", "node", "c", "code"))
        x = t.column("x")
        for a, b in zip(*_spans(tab, win, i, j), strict=True):
            if b - a > 1:
                v = np.frombuffer(b"".join(x.slice(a, b - a).to_pylist()), kind).astype(np.float64).reshape(-1, d)
                yield int(tab[a]), int(i[a]), int(j[a]), own[a:b], node[a:b], n[a:b], code[a:b].view(np.uint64), v

    for batch in batches:
        if not batch.num_rows:
            continue
        tab, win, i, j = (batch.column(c).to_numpy() for c in ("tab", "win", "i", "j"))
        starts, _ = _spans(tab, win, i, j)
        last = int(starts[-1])
        if held and last == 0 and all(held[-1].column(c)[-1] == batch.column(c)[0] for c in ("tab", "win", "i", "j")):
            held.append(batch)
            continue
        yield from whole([*held, batch.slice(0, last)])
        held = [batch.slice(last)]
    if held:
        yield from whole(held)


def _spans(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(keys[0]):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    change = np.zeros(len(keys[0]), np.int64)
    for k in keys:
        change[1:] |= k[1:] != k[:-1]
    return runs(np.cumsum(change))


def near_duplicates(table: DataFrame, cosine: float = 0.95, recall: float = 0.97, tile: int = 4096, bound: int = 10000) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of ``table`` (vec_id, embedding: array of float or double).

    n_links counts the other vectors linked directly (cosine of ``cosine`` or more in double precision),
    component_id is the smallest vec_id that links reach. Vectors that are null, empty, zero or hold null or
    non-finite components, and rows without a vec_id, link with nothing; so do vectors of another length than
    the sample's most frequent one. Rows with one vec_id are taken as one vector if they are alike; otherwise the first in the
    order of components stands for the id. Every row comes back, with a component of itself if it has no link;
    an empty table gives no rows; further columns are ignored.
    """
    rows = materialise(rows_of(table), "vectors")
    ids = rows.where("v is not null and vec_id is not null").groupBy("vec_id").agg(F.min("v").alias("v"))
    # equal vectors are one node, named by the smallest of their ids; they link with each other
    member = materialise(ids.select("vec_id", F.sha2(F.to_json(F.struct("v")), 256).alias("same"), "v"), "members")
    nodes = materialise(member.groupBy("same").agg(F.min("vec_id").alias("node"), F.count("*").alias("c"), F.first("v").alias("v")), "nodes")
    found = materialise(near_links(nodes.select("node", "c", "v"), kind_of(table), cosine, recall, tile, bound), "links")
    counts = found.where("n > 0").groupBy("node").agg(F.sum("n").alias("n"))
    roots = components(found.where("n = 0").select(F.col("node").alias("u"), F.col("other").alias("v"))).withColumnRenamed("node", "r")
    named = nodes.select("same", "node", "c").join(counts, "node", "left").join(roots, F.col("node") == F.col("r"), "left")
    told = member.select("vec_id", "same").join(named.select("same", (F.coalesce("n", F.lit(0)) + F.col("c") - 1).alias("n"), F.coalesce("root", "node").alias("root")), "same")
    out = rows.select("vec_id").join(told.select(F.col("vec_id").alias("id"), "n", "root"), F.col("vec_id") == F.col("id"), "left")
    component = F.coalesce("root", "vec_id")
    return out.select("vec_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))

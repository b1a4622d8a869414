"""SimHash near-duplicates: fingerprints of word shingles, linked by a tiled exact comparison.

Every text gets a 64-bit fingerprint. Distinct fingerprints are dealt into tiles of equal population
count; two tiles meet only if their population counts differ by the radius at most (a difference of k bits
changes the count by k at most), so the skipped pairs cannot hold a link. Within a pair of tiles the rows
are ordered by the population counts of their four 16-bit words, which skips blocks in the same exact way,
and what remains is compared by numpy exclusive-or and bit counts. A task returns a spanning forest of the
links that it finds, not the links, so a group of n near copies costs n rows and not n squared.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Forest, ascii_words, fresh, materialise, slices
from .components import components

#: Fixed value: the seed of the shingles' XXH64.
SEED = 42


def shingle_hashes(text: str | None, width: int = 4) -> np.ndarray:
    """XXH64 of every word shingle, repeats included; a text of fewer words is one shingle, one without words has none."""
    words = ascii_words(text)
    if not words:
        return np.empty(0, np.uint64)
    joined, n = b" ".join(words), max(1, len(words) - width + 1)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    first, last = np.r_[0, ends[:-1] + 1][:n].tolist(), ends[-n:].tolist()
    digest = xxhash.xxh64_intdigest
    return np.fromiter([digest(joined[a:b], SEED) for a, b in zip(first, last, strict=True)], np.uint64, n)


def fingerprint(hashes: np.ndarray) -> int:
    """A bit is 1 if it is set in over half of the hashes; zero without hashes."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 4096):
        part = hashes[at : at + 4096].astype(">u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(hashes)).tobytes(), "big")


def with_fingerprint(docs: DataFrame, width: int = 4) -> DataFrame:
    """(doc_id, print, fp): one row for each row of ``docs``; print is a hash of the text, fp the fingerprint as a signed 64-bit integer."""

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            fps = np.array([fingerprint(shingle_hashes(t, width)) for t in batch.column("text").to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("print"), pa.array(fps.view(np.int64))], ["doc_id", "print", "fp"])

    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("print"), text.alias("text")).mapInArrow(mapped, "doc_id long, print long, fp long")


def _words16(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x.view(np.uint16).reshape(-1, 4)).astype(np.int8)


def _ordered(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    counts = _words16(x)
    order = np.lexsort(counts.T)
    return x[order], counts[order]


def tile_links(a: np.ndarray, b: np.ndarray, radius: int, same: bool, block: int = 256) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest (pairs of fingerprints) of all links between two tiles of distinct fingerprints, or inside one."""
    (x, cx), (y, cy) = _ordered(a), _ordered(b)
    n = len(x)
    forest = Forest(n if same else n + len(y))
    cuts = np.arange(0, len(y), block)
    lows, highs = np.minimum.reduceat(cy, cuts, axis=0).astype(np.int16), np.maximum.reduceat(cy, cuts, axis=0).astype(np.int16)
    for i in range(0, n, block):
        part = x[i : i + block]
        low, high = cx[i : i + block].min(axis=0).astype(np.int16), cx[i : i + block].max(axis=0).astype(np.int16)
        apart = np.maximum(0, np.maximum(lows - high, low - highs)).sum(axis=1)
        found = []
        for k in np.flatnonzero(apart <= radius):
            j = int(cuts[k])
            if same and j < i:
                continue
            near = np.flatnonzero(np.bitwise_count(part[:, None] ^ y[None, j : j + block]) <= radius)
            p, q = np.divmod(near, len(y[j : j + block]))
            p, q = p + i, q + j + (0 if same else n)
            found.append((p[p != q], q[p != q]))
        p, q = (np.concatenate(z) for z in zip(*found, strict=True)) if found else ([], [])
        if len(p):
            forest.link(p, q)
    roots, every = forest.roots(), x if same else np.concatenate([x, y])
    hung = np.flatnonzero(roots != np.arange(len(roots)))
    return every[hung], every[roots[hung]]


def links(distinct: DataFrame, radius: int = 4, tile: int = 8192) -> DataFrame:
    """(u, v): a spanning forest of the pairs in ``distinct`` (fp: distinct, not null) that differ in ``radius`` bits at most.

    A population count with more than ``tile`` rows is dealt into several tiles by hash; the table of tiles has
    one row for each of the 65 counts, so its broadcast is bounded whatever the input.
    """
    rows = distinct.select("fp", F.bit_count("fp").alias("p"))
    counted = rows.groupBy("p").agg(F.count("*").alias("c")).collect()  # 65 rows at most
    parts = [0] * (65 + radius)
    for r in counted:
        parts[r.p] = -(-r.c // tile)
    many = F.array(*map(F.lit, parts))
    tiles = rows.withColumn("b", F.pmod(F.xxhash64("fp"), F.greatest(F.lit(1), many[F.col("p")])).cast("int"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.column("fps")
            packed = [np.asarray(x.values.to_numpy(zero_copy_only=False), np.int64).tobytes() for x in rows]
            yield pa.RecordBatch.from_arrays([batch.column("p"), batch.column("b"), pa.array(packed, pa.binary())], ["p", "b", "x"])

    packed = materialise(tiles.groupBy("p", "b").agg(F.collect_list("fp").alias("fps")).mapInArrow(pack, "p int, b int, x binary"), "tiles")
    # each tile meets itself, the later tiles of its count and all tiles of the next `radius` counts
    partners = F.flatten(F.transform(F.sequence(F.lit(0), F.lit(radius)), lambda d: F.when(many[F.col("p") + d] > 0, F.transform(F.sequence(F.lit(0), many[F.col("p") + d] - 1), lambda c: F.struct((F.col("p") + d).alias("q"), c.cast("int").alias("c")))).otherwise(F.array().cast("array<struct<q:int,c:int>>"))))
    pairs = packed.select("p", "b", F.col("x"), F.explode(F.filter(partners, lambda s: (s.q > F.col("p")) | (s.c >= F.col("b")))).alias("o"))
    other = packed.select(F.col("p").alias("q"), F.col("b").alias("c"), F.col("x").alias("y"))
    met = pairs.select("p", "b", F.col("o.q").alias("q"), F.col("o.c").alias("c"), "x").join(other.hint("shuffle_merge"), ["q", "c"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for p, b, q, c, x, y in zip(*(batch.column(k).to_pylist() for k in ("p", "b", "q", "c", "x", "y")), strict=True):
                u, v = tile_links(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), radius, (p, b) == (q, c))
                if len(u):
                    yield pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], ["u", "v"])

    spread = met.repartition(max(1, met.sparkSession.sparkContext.defaultParallelism * 4, int(met.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    return spread.mapInArrow(compare, "u long, v long")


def grouped(docs: DataFrame, radius: int = 4, width: int = 4, tile: int = 8192) -> DataFrame:
    """(doc_id, print, fp, root, component_id) for every row of ``docs``; root names the component by its smallest fingerprint."""
    fps = materialise(with_fingerprint(docs, width), "fps")
    classes = materialise(fps.groupBy("fp").agg(F.min("doc_id").alias("first")), "classes")
    roots = components(links(classes.select("fp"), radius, tile))
    named = classes.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    named = materialise(named, "named")
    least = named.groupBy("root").agg(F.min("first").alias("component_id"))
    return fps.join(named.join(least, "root").select("fp", "root", "component_id"), "fp")


def simhash_groups(docs: DataFrame, radius: int = 4, width: int = 4, tile: int = 8192) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row of ``docs``.

    component_id is the smallest doc_id that links reach. A null text counts as one without words
    (fingerprint zero, linked like any other); a null doc_id is kept and joins its component but never names
    it, unless the component has no other (then component_id is null); repeated doc_ids give a row each; an
    empty table gives no rows; further columns of ``docs`` are ignored.
    """
    return grouped(docs, radius, width, tile).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_first(docs: DataFrame, radius: int = 4) -> DataFrame:
    """Of each component of near copies one document, that with the smallest doc_id, with all its columns.

    Of rows that share that doc_id the one with the smallest hash of its text stays, of repeated rows one; a row
    without a doc_id stays only in a component that has no other. A null text counts as one without words, very
    long texts are compared whole, an empty table gives no rows, and columns may have any names.
    """
    rows = grouped(docs, radius).groupBy("root", "doc_id", "print").agg(F.count("*").alias("n"))
    first = rows.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "print", "n")).alias("k"))
    d, p, n = fresh(docs, "kept_id", "kept_print", "kept_n")
    kept = materialise(first.select(F.col("k.doc_id").alias(d), F.col("k.print").alias(p), F.col("k.n").alias(n)), "kept")
    on = F.col("doc_id").cast("long").eqNullSafe(F.col(d)) & (F.xxhash64(F.col("text").cast("string")) == F.col(p))
    out = docs.join(kept.where(F.col(n) == 1), on, "left_semi")
    if kept.where(F.col(n) > 1).limit(1).count():
        out = out.union(docs.join(kept.where(F.col(n) > 1), on, "left_semi").dropDuplicates(["doc_id", "text"]))
    return out

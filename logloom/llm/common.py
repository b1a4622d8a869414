"""Helpers shared by the training-data operators of this subpackage."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed value: the word pattern of the contracts, a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``. Where it is unset, a temporary one is made in local mode (one machine); on a cluster that is an error."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = f"file://{tempfile.mkdtemp(prefix='logloom-')}"
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def written(df: DataFrame, name: str = "stage") -> tuple[DataFrame, str]:
    """Writes ``df`` once as Parquet in the shared folder: what was written, and where. The lineage ends there, and a lost executor costs no recomputation."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/logloom-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def materialise(df: DataFrame, name: str = "stage") -> DataFrame:
    return written(df, name)[0]


def removed(spark: SparkSession, path: str) -> None:
    """Deletes a folder of the shared folder that nothing reads any more."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, longer where ``df`` has a column of that name already."""
    taken, out = {c.lower() for c in df.columns}, []
    for n in names:
        while n.lower() in taken:
            n += "_"
        out.append(n)
    return out


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def is_fold(doc_id, k: int):
    """True where crc32(doc_id as text) mod 5 is k; a null doc_id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(5)) == k


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Cuts Arrow batches so that the texts of a piece hold about ``limit`` bytes at most (a longer text stands alone): memory stays bounded with very long texts."""
    for batch in batches:
        sizes = batch.column(column).nbytes
        if sizes <= limit:
            yield batch
            continue
        lengths = pa.compute.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False)
        ends, start, total = [], 0, 0
        for i, n in enumerate(lengths):
            if total and total + n > limit:
                ends.append(i)
                total = 0
            total += int(n)
        for end in [*ends, batch.num_rows]:
            if end > start:
                yield batch.slice(start, end - start)
            start = end


def ascii_words(text: str | None) -> list[bytes]:
    """Words of the lower-cased (A-Z only) text as UTF-8: bytes.lower and bytes.split know ASCII only, which is what the contracts ask."""
    return [] if text is None else text.encode("utf-8", "surrogatepass").lower().split()


class Memo(dict):
    """A bounded memo of two generations: when the young one is full it becomes the old one, from which entries in use are taken over."""

    def __init__(self, compute, limit: int = 120_000):
        super().__init__()
        self.compute, self.limit, self.old = compute, limit, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.compute(key)
        if len(self) >= self.limit:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value


def runs(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of equal neighbours."""
    if not len(keys):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    cut = np.flatnonzero(keys[1:] != keys[:-1]) + 1
    return np.r_[0, cut], np.r_[cut, len(keys)]


class Forest:
    """Union-find over positions 0..n-1 that takes links in numpy batches; the root is the smallest position."""

    def __init__(self, n: int):
        self.parent = np.arange(n)

    def roots(self) -> np.ndarray:
        p = self.parent
        while True:
            q = p[p]
            if np.array_equal(p, q):
                self.parent = p
                return p
            p = q

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            r = self.roots()
            low, high = np.minimum(r[a], r[b]), np.maximum(r[a], r[b])
            apart = low != high
            if not apart.any():
                return
            low, high, a, b = low[apart], high[apart], a[apart], b[apart]
            np.minimum.at(self.parent, high, low)


_KEPT: dict = {}


def per_worker(make, *key):
    """``make(*key)``, made once in a Python worker and kept for its later tasks, with the memos that it has filled."""
    if (make, key) not in _KEPT:
        _KEPT[make, key] = make(*key)
    return _KEPT[make, key]

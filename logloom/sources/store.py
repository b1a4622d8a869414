"""Tables on disk: replacing a dataset, upserts by id, tables merged on read, exports, lookups by id."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def create(spark: SparkSession, path: str, schema: StructType | str, partition: str | None = None) -> None:
    """An empty table with this schema; what the path held is gone."""
    writer = spark.createDataFrame([], schema).write.mode("overwrite")
    (writer.partitionBy(partition) if partition else writer).parquet(path)


def replace(rows: DataFrame, path: str, partition: str = "dataset_id") -> None:
    """Writes ``rows``; of every value of ``partition`` among them the earlier rows are gone, other values stay."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition).parquet(path)


def _files(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _removed(spark: SparkSession, path: str) -> None:
    where, files = _files(spark, path)
    files.delete(where, True)


def upsert(rows: DataFrame, path: str, key: str, partition: str = "dataset_id") -> None:
    """Writes ``rows``, in place of those with the same ``key``, wherever these are; of repeated keys among ``rows`` one is taken.

    Partitions that get rows or lose one are written anew; columns that only the table or only ``rows`` have are null in
    the others. The merged partitions are written beside the table first, since a table cannot be overwritten while it
    is read; they are moved partition by partition, so a job that is lost on the way is run again with the same rows.
    For many small batches see Merged, which does not rewrite what it holds.
    """
    spark = rows.sparkSession
    new = rows.dropDuplicates([key])
    staged = f"{path.rstrip('/')}-staged-{uuid.uuid4().hex}"
    where, files = _files(spark, path)
    held = files.exists(where) and any(not f.getPath().getName().startswith(("_", ".")) for f in files.listStatus(where))
    # an empty partitioned table has no file that tells its schema
    old = spark.read.option("mergeSchema", True).parquet(path) if held else spark.createDataFrame([], rows.schema)
    if partition in old.columns and partition in new.columns:
        old = old.withColumn(partition, F.col(partition).cast(new.schema[partition].dataType))
    losing = old.join(new.select(key), key, "left_semi").select(partition)
    touched = old.join(losing.union(new.select(partition)).distinct(), partition, "left_semi")
    merged = touched.join(new.select(key), key, "left_anti").unionByName(new, allowMissingColumns=True)
    merged.write.partitionBy(partition).parquet(staged)
    kept = spark.read.schema(merged.schema).parquet(staged)
    emptied = losing.distinct().join(kept.select(partition).distinct(), partition, "left_anti").collect()  # partitions, at most as many as the table has
    replace(kept, path, partition)
    for r in emptied:
        _removed(spark, f"{path.rstrip('/')}/{partition}={r[0]}")
    _removed(spark, staged)


class Merged:
    """A table that takes batches of rows by key and is merged as it is read.

    A batch is a folder of its own (``batch=<number>``), complete when Spark's committer has left its mark in it, so it
    costs what its rows cost; a batch that is complete is not written again. Of a key the row of the highest batch counts,
    whole, and rows without a column that others have get null there. ``compact`` merges all that is complete into a base
    (``base=<number of its last batch>``) once the batches hold a share of it, so a row is rewritten a number of times that
    grows with the logarithm of the table; readers go on with the older base until the new one is complete.
    """

    def __init__(self, spark: SparkSession, path: str, key: str):
        self.spark, self.path, self.key = spark, path.rstrip("/"), key

    def _complete(self) -> tuple[int | None, list[int]]:
        """The number of the base (None without one), and of the batches after it."""
        where, files = _files(self.spark, self.path)
        names = [f.getPath().getName() for f in files.listStatus(where)] if files.exists(where) else []
        found = {"base": [], "batch": []}
        for n in names:
            m = re.fullmatch(r"(base|batch)=(\d+)", n)
            if m and files.exists(_files(self.spark, f"{self.path}/{n}/_SUCCESS")[0]):
                found[m[1]].append(int(m[2]))
        base = max(found["base"], default=None)
        return base, sorted(b for b in found["batch"] if base is None or b > base)

    def _folder(self, kind: str, number: int) -> str:
        return f"{self.path}/{kind}={number}"

    def holds(self, batch: int) -> bool:
        base, batches = self._complete()
        return batch in batches or (base is not None and batch <= base)

    def next_batch(self) -> int:
        base, batches = self._complete()
        return max([-1 if base is None else base, *batches]) + 1

    def write(self, rows: DataFrame, batch: int) -> bool:
        """Adds ``rows`` as batch number ``batch``; of repeated keys one is taken. A batch that the table holds already changes nothing (then the result is False)."""
        if self.holds(batch):
            return False
        rows.dropDuplicates([self.key]).withColumn("_gone", F.lit(False)).write.mode("overwrite").parquet(self._folder("batch", batch))
        return True

    def delete(self, keys: DataFrame, batch: int) -> bool:
        """Adds a batch that takes the rows with these keys away."""
        if self.holds(batch):
            return False
        keys.select(self.key).distinct().withColumn("_gone", F.lit(True)).write.mode("overwrite").parquet(self._folder("batch", batch))
        return True

    def _read(self, folders: list[str], name: str) -> DataFrame:
        rows = self.spark.read.option("mergeSchema", True).option("basePath", self.path).parquet(*folders)
        return rows.withColumnRenamed(name, "_batch")

    def read(self) -> DataFrame | None:
        """The latest row of every key, None if nothing was ever written. Rows of the base are passed on unless a batch has their key; only the batches are grouped."""
        base, batches = self._complete()
        if base is None and not batches:
            return None
        old = self._read([self._folder("base", base)], "base").drop("_batch") if base is not None else None
        if not batches:
            return old
        new = self._read([self._folder("batch", b) for b in batches], "batch")
        latest = new.groupBy(self.key).agg(F.max_by(F.struct(*[F.col(f"`{c}`") for c in new.columns if c != self.key]), "_batch").alias("_row"))
        rows = latest.where("not _row._gone").select(self.key, "_row.*").drop("_batch", "_gone")
        if old is None:
            return rows
        return old.join(latest.select(self.key), self.key, "left_anti").unionByName(rows, allowMissingColumns=True)

    def compact(self, share: float = 0.5) -> bool:
        """Merges base and batches if the batches' bytes are ``share`` of the base's at least; then older folders go."""
        base, batches = self._complete()
        if not batches:
            return False
        size = lambda kind, n: (lambda w, f: f.getContentSummary(w).getLength())(*_files(self.spark, self._folder(kind, n)))
        if base is not None and sum(size("batch", b) for b in batches) < share * size("base", base):
            return False
        self.read().write.mode("overwrite").parquet(self._folder("base", batches[-1]))
        for b in batches:
            _removed(self.spark, self._folder("batch", b))
        if base is not None:
            _removed(self.spark, self._folder("base", base))
        return True


def export_json(rows: DataFrame, path: str) -> None:
    """A JSON object a line, nulls left out."""
    rows.write.mode("overwrite").option("ignoreNullFields", True).json(path)


def get(rows: DataFrame, key: str, value: str) -> DataFrame:
    """The row with this id, or none; the filter reaches the scan."""
    return rows.where(F.col(key) == value).limit(1)


def exists(rows: DataFrame, key: str, value: str) -> bool:
    return get(rows.select(key), key, value).count() > 0

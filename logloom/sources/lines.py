"""Reading log files as numbered lines, and dataset manifests."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

LINE = "dataset_id string, source_file string, line_no int, text string"
_MANIFEST = {"dataset_id", "description", "created_at", "oracle", "log_format", "code", "files", "notes"}


#: Splits of files whose counts are sent to every task; with more of them lines are joined by shuffling.
MOST_SENT = 1 << 20


def read_lines(spark: SparkSession, paths: list[str] | str, dataset_id: str, root: str = "") -> DataFrame:
    """(dataset_id, source_file, line_no, text): UTF-8 text or gzip by suffix; line numbers from 1, CR before LF dropped.

    A plain file is read by many tasks, in the splits of Spark's text source, each of which starts after a line end (a gzip
    file cannot be split). Lines are counted for each split first, and a small table of the splits, a row for each
    ``spark.sql.files.maxPartitionBytes`` of text, gives the lines before it.
    """
    text = spark.read.option("lineSep", "\n").text(paths)
    rows = text.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("split"), F.regexp_replace("value", r"\r\z", "").alias("text"), F.monotonically_increasing_id().alias("id"))
    splits = rows.groupBy("path", "split").agg(F.min("id").alias("first"), F.count("*").alias("lines"))
    splits = splits.select("path", "split", (F.sum("lines").over(Window.partitionBy("path").orderBy("split")) - F.col("lines") - F.col("first")).alias("before"))
    if splits.count() <= MOST_SENT:
        splits = F.broadcast(splits)
    rows = rows.join(splits, ["path", "split"])
    named = F.regexp_replace("path", "^.*" + root + "/", "") if root else F.regexp_replace("path", "^.*/", "")
    return rows.select(F.lit(dataset_id).alias("dataset_id"), named.alias("source_file"), (F.col("id") + F.col("before") + 1).cast("int").alias("line_no"), "text")


def dataset_path(spark: SparkSession, dataset: str, base: str = "datasets") -> str:
    """The folder of a dataset: ``dataset`` itself if it is a folder, else the one of that name in ``base``, on any file system of Spark's; an error if neither is there."""
    if not dataset.strip():
        raise ValueError("a dataset's id or folder is needed")
    for path in (dataset, f"{base}/{dataset}"):
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        files = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        if files.exists(where) and files.getFileStatus(where).isDirectory():
            return path
    raise FileNotFoundError(f"no dataset {dataset}, neither as a folder nor in {base}")


def manifest(spark: SparkSession, text: str) -> DataFrame:
    """(path, service, module, dataset_id, log_format, oracle, code) of a manifest in JSON (YAML, where a parser is installed); an unknown key is an error."""
    try:
        told = json.loads(text)
    except ValueError:
        import yaml

        told = yaml.safe_load(text)
    if unknown := set(told) - _MANIFEST:
        raise ValueError(f"unknown keys: {', '.join(sorted(unknown))}")
    for key in ("dataset_id", "files"):
        if not told.get(key):
            raise ValueError(f"{key} is missing")
    code = told.get("code") or {}
    rows = [(f["path"], f["service"], f.get("module"), told["dataset_id"], told.get("log_format", "spring-boot-default"), bool(told.get("oracle")), (code.get("name"), code.get("version"))) for f in told["files"]]
    return spark.createDataFrame(rows, "path string, service string, module string, dataset_id string, log_format string, oracle boolean, code struct<name:string,version:string>")

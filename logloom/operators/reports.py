"""Reports as Markdown and JSON, breakdowns in their order, and the mark of a validated dataset."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .evaluate import breakdown, csv_ready


def breakdown_places(rows: DataFrame, dimensions: list[str]) -> DataFrame:
    """``breakdown`` with the place of every value in its dimension: most events first, ties by value."""
    order = Window.partitionBy("dimension").orderBy(F.col("events").desc(), "value")
    return breakdown(rows, dimensions).withColumn("place", F.row_number().over(order))


def markdown_lines(rows: DataFrame, order: list[Column | str]) -> DataFrame:
    """(n, line): ``rows`` as a Markdown table, with its head at 0 and the rule at 1; cells as in CSV, with pipes and line ends escaped."""
    cells = [F.regexp_replace(F.replace(F.col(f"`{c}`"), F.lit("|"), F.lit("\\|")), r"\r\n|\r|\n", "<br>") for c in rows.columns]
    numbered = rows.withColumn("_n", F.row_number().over(Window.orderBy(*order)))  # a report's rows are few
    body = csv_ready(numbered).select((F.col("_n").cast("int") + 1).alias("n"), F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |")).alias("line"))
    head = [(0, "| " + " | ".join(rows.columns) + " |"), (1, "|" + " --- |" * len(rows.columns))]
    return rows.sparkSession.createDataFrame(head, "n int, line string").union(body)


def write_markdown(sections: list[tuple[str, DataFrame, list[Column | str]]], path: str) -> None:
    """One text file in the folder ``path``: for each section its heading and its table."""
    out = None
    for k, (title, rows, order) in enumerate(sections):
        table = markdown_lines(rows, order).withColumn("n", F.col("n") + 2)
        told = rows.sparkSession.createDataFrame([(0, f"## {title}"), (1, "")], "n int, line string").union(table)
        told = told.union(told.agg((F.max("n") + 1).alias("n"), F.lit("").alias("line"))).withColumn("k", F.lit(k))
        out = told if out is None else out.union(told)
    out.coalesce(1).sortWithinPartitions("k", "n").select("line").write.mode("overwrite").text(path)


def write_metrics(metrics: DataFrame, path: str) -> None:
    """The row of metrics as a JSON object, nulls kept."""
    metrics.coalesce(1).write.mode("overwrite").option("ignoreNullFields", False).json(path)


def validate_once(spark: SparkSession, folder: str, dataset: str, run) -> DataFrame:
    """What ``run()`` gives, a row of results, kept as the mark that ``dataset`` was validated; a dataset that has a mark is refused.

    A test dataset is evaluated once with the final weights. The mark is the written result, so a run that fails leaves none.
    """
    path = f"{folder.rstrip('/')}/{dataset}/validation"
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
        raise ValueError(f"{dataset} was validated already ({path}); delete the folder only if that run gave no result")
    run().coalesce(1).write.mode("overwrite").option("ignoreNullFields", False).json(path)
    return spark.read.json(path)

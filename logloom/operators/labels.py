"""Verdicts on logs, as a table that is only appended to: the latest counts, a null verdict takes a label back."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VERDICTS = ("correct", "incorrect", "not_in_catalog")


def checked(labels: DataFrame) -> DataFrame:
    """``labels``; a verdict outside the three fails the job that reads it."""
    return labels.withColumn("verdict", F.when(F.col("verdict").isNull() | F.col("verdict").isin(*VERDICTS), F.col("verdict")).otherwise(F.raise_error(F.concat(F.lit("no such verdict: "), F.col("verdict")))))


def latest(labels: DataFrame) -> DataFrame:
    """The label of each log_id with the latest labeled_at; deleted ones are gone."""
    others = [c for c in labels.columns if c not in ("log_id", "labeled_at")]
    last = labels.groupBy("log_id").agg(F.max(F.struct("labeled_at", *others)).alias("l"))
    return last.select("log_id", "l.labeled_at", *[F.col(f"l.{c}").alias(c) for c in others]).where("verdict is not null")


def listed(labels: DataFrame, dataset: str | None = None, verdict: str | None = None, size: int = 100) -> DataFrame:
    out = latest(labels)
    if dataset:
        out = out.where(F.col("dataset_id") == dataset)
    if verdict:
        if verdict not in VERDICTS:
            raise ValueError(f"no such verdict: {verdict}")
        out = out.where(F.col("verdict") == verdict)
    return out.orderBy(F.col("labeled_at").desc(), F.col("log_id").desc()).limit(min(size, 500))


def snapshot(rows: DataFrame, logs: DataFrame) -> DataFrame:
    """New labels (log_id, verdict, correct_statement_id, note) with the log's dataset and predicted statement, and the time."""
    seen = logs.select("log_id", "dataset_id", F.col("match.statement_id").alias("predicted_statement_id"))
    return checked(rows).join(seen, "log_id").withColumn("labeled_at", F.current_timestamp())


def to_review(logs: DataFrame, labels: DataFrame) -> DataFrame:
    """Logs worth a look (unreliable truth, ambiguous or low) that have no label."""
    worth = F.coalesce(~F.col("ground_truth.reliable"), F.lit(False)) | F.coalesce(F.col("match.status") == "ambiguous", F.lit(False)) | F.coalesce(F.col("match.confidence_level") == "low", F.lit(False))
    return logs.where(worth).join(latest(labels).select("log_id"), "log_id", "left_anti")


def review_queue(logs: DataFrame, labels: DataFrame, size: int = 50, seed: int = 1) -> DataFrame:
    """``size`` (500 at most) of them in a seeded order."""
    return to_review(logs, labels).orderBy(F.md5(F.concat_ws("|", F.lit(str(seed)), "log_id")), "log_id").limit(min(size, 500))

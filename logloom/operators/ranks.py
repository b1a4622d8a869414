"""Places in a total order, without bringing the rows of a group to one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import written


def ranked(rows: DataFrame, by: list[str], name: str = "n", parts: int | None = None) -> DataFrame:
    """``rows`` with their place (from 1) in the order of ``by``, nulls last, as column ``name``; rows of a group that ``by`` starts with have places in a row.

    Ranges between sampled splitters are sorted each by a task and numbered as they are written; a table with a row for
    each range adds up what comes before it. Rows that are equal in ``by`` share a range, so it should end in a key.
    """
    order = [F.col(c).asc_nulls_last() for c in by]
    parts = parts or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = written(rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("_m", F.monotonically_increasing_id()), "ranges")
    range_ = F.shiftright("_m", 33)
    before = dealt.groupBy(range_.alias("_p")).agg(F.count("*").alias("c"))
    before = before.select("_p", (F.sum("c").over(Window.orderBy("_p")) - F.col("c")).alias("_before"))
    return dealt.join(F.broadcast(before), range_ == F.col("_p")).withColumn(name, F.col("_before") + F.col("_m") - F.shiftleft(range_, 33) + 1).drop("_m", "_p", "_before")

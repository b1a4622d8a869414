"""Stack frames resolved against known types."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import catalog as c


def frame_types(types: DataFrame, modules: DataFrame, sources: DataFrame) -> DataFrame:
    """(service, class, type_unit, in_project, file_id): by class name or binary name; a dependency's file only if its source is there."""
    t = c.applicable_types(types, modules).select("service", F.explode(F.array_distinct(F.array_compact(F.array("class_fqn", "class_binary")))).alias("class"), "code_unit", "file_id", "type_id")
    there = sources.select(F.col("file_id").alias("_f")).distinct()
    known = t.join(there, F.col("file_id") == F.col("_f"), "left")
    kept = F.when((F.col("code_unit.type") == "project") | F.col("_f").isNotNull(), F.col("file_id"))
    one = known.groupBy("service", "class").agg(F.max_by(F.struct(F.concat_ws(":", "code_unit.name", "code_unit.version").alias("code_unit"), (F.col("code_unit.type") == "project").alias("in_project"), kept.alias("file_id")), "type_id").alias("t"))
    return one.select("service", "class", "t.code_unit", "t.in_project", "t.file_id")


def resolve_frames(events: DataFrame, known: DataFrame) -> DataFrame:
    """(log_id, frames): the frames of every event with an exception, in order, each with in_project, code_unit and file_id."""
    rows = events.where("exception is not null").select("log_id", "service", F.posexplode("exception.frames").alias("place", "f"))
    joined = rows.join(known, (rows["service"] == known["service"]) & (F.col("f.class") == known["class"]), "left").select("log_id", "place", F.struct(F.col("f.class").alias("class"), F.col("f.method").alias("method"), F.col("f.file").alias("file"), F.col("f.line").alias("line"), F.coalesce("in_project", F.lit(False)).alias("in_project"), "code_unit", "file_id").alias("f"))
    return joined.groupBy("log_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("place", "f"))), lambda x: x.f).alias("frames"))

"""Links to statements' lines by a mapping of code units to repositories, and their refresh."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import source_link


@dataclass(frozen=True)
class Mapping:
    """Where the sources of a code unit are. ``name``: of a project, or a pattern of ``group:artifact`` in which * is any run of characters; ``ref`` and ``path`` may hold {version}, {file_path} and, for dependencies, {artifactId}."""

    name: str
    repo: str | None
    ref: str | None
    path: str | None


def _glob(pattern: str) -> str:
    return "(?s)^" + ".*".join(re.escape(p) for p in pattern.split("*")) + r"\z"


def link(projects: list[Mapping], dependencies: list[Mapping], remote: str | None = None) -> Column:
    """The link of a statement (code_unit with type, name, version; file_path, line, end_line); null without a mapping, repository, ref or path.

    A project is looked up by its name, and has ``remote`` as repository where its mapping names none; of the dependencies'
    patterns the first that fits counts, even if it gives no link.
    """
    name, version = F.col("code_unit.name"), F.col("code_unit.version")
    place = (version, F.col("file_path"), F.col("line"), F.col("end_line"))
    artifact = F.when(name.contains(":"), F.substring(name, F.locate(":", name) + 1, F.length(name))).otherwise(name)
    text = lambda x: F.lit(x).cast("string")
    own = other = None
    for m in reversed(projects):
        own = F.when(name == m.name, source_link(text(m.repo if m.repo is not None else remote), text(m.ref), text(m.path), *place)).otherwise(own)
    for m in reversed(dependencies):
        other = F.when(name.rlike(_glob(m.name)), source_link(text(m.repo), text(m.ref), text(m.path), *place, artifact)).otherwise(other)
    none = F.lit(None).cast("string")
    return F.when(F.col("code_unit.type") == "project", none if own is None else own).otherwise(none if other is None else other)


def refreshed(statements: DataFrame, new: Column, column: str = "link") -> DataFrame:
    """The statements whose link is no longer ``column``, with the new one."""
    return statements.withColumn("_new", new).where(~F.col("_new").eqNullSafe(F.col(column))).withColumn(column, F.col("_new")).drop("_new")


def refresh_counts(statements: DataFrame, new: Column, column: str = "link") -> DataFrame:
    """One row: (total, changed, linked)."""
    return statements.agg(F.count("*").alias("total"), F.count_if(~new.eqNullSafe(F.col(column))).alias("changed"), F.count(new).alias("linked"))

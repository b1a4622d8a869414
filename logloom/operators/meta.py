"""What there is: datasets, services, runs, code units; reports over ingested logs, catalogs and call graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def datasets(logs: DataFrame, most: int = 500) -> DataFrame:
    """(dataset_id, logs), sorted by id."""
    return logs.groupBy("dataset_id").agg(F.count("*").alias("logs")).orderBy("dataset_id").limit(most)


def dataset_services(logs: DataFrame) -> DataFrame:
    """(dataset_id, service, logs, first, lines) of every service of a dataset."""
    return logs.groupBy("dataset_id", "service").agg(F.count("*").alias("logs"), F.min("ts").cast("string").alias("first"), F.max("line_number").alias("lines"))


def services(logs: DataFrame, dataset: str | None = None, most: int = 500) -> DataFrame:
    """(service): distinct ones, of one dataset or all, sorted."""
    rows = logs.where(F.col("dataset_id") == dataset) if dataset and dataset.strip() else logs
    return rows.where("service is not null").select("service").distinct().orderBy("service").limit(most)


def code_units(runs: DataFrame, most: int = 500) -> DataFrame:
    """(kind, name, version, finished_at) of every run, sorted by name and version."""
    return runs.select("kind", F.col("code_unit.name").alias("name"), F.col("code_unit.version").alias("version"), "finished_at").orderBy("name", "version").limit(most)


def dashboard(logs: DataFrame, most: int = 20) -> DataFrame:
    """(service, matched, ambiguous, unmatched) of the services with most logs."""
    n = logs.groupBy("service").agg(F.count("*").alias("_n"), *[F.count_if(F.col("match.status") == s).alias(s) for s in ("matched", "ambiguous", "unmatched")])
    return n.orderBy(F.col("_n").desc(), "service").limit(most).drop("_n")


def ingest_report(logs: DataFrame, milliseconds: int | None = None) -> DataFrame:
    """(dimension, value, n): total, by status, confidence, service and level, with exception, with trace, and events a second where ``milliseconds`` is given (the total if it is 0)."""
    rows = logs.select("match.status", F.col("match.confidence_level").alias("confidence"), "service", "level", F.col("exception").isNotNull().alias("e"), F.col("trace_id").isNotNull().alias("t"))
    cells = F.array(*[F.struct(F.lit(d).alias("dimension"), F.col(d).alias("value")) for d in ("status", "confidence", "service", "level")], *[F.when(c, F.struct(F.lit(d).alias("dimension"), F.lit(None).cast("string").alias("value"))) for d, c in (("total", F.lit(True)), ("with_exception", F.col("e")), ("with_trace", F.col("t")))])
    n = rows.select(F.explode(F.filter(cells, lambda c: c.isNotNull() & (c.value.isNotNull() | c.dimension.isin("total", "with_exception", "with_trace")))).alias("c")).groupBy("c.dimension", "c.value").agg(F.count("*").cast("double").alias("n"))
    if milliseconds is None:
        return n
    rate = n.where("dimension = 'total'").select(F.lit("events_per_second").alias("dimension"), "value", (F.col("n") * (1000.0 / milliseconds if milliseconds else 1.0)).alias("n"))
    return n.union(rate)


def count_where(rows: DataFrame, **terms) -> DataFrame:
    """(n): how many rows have all these values."""
    for name, value in terms.items():
        rows = rows.where(F.col(name) == value)
    return rows.agg(F.count("*").alias("n"))


def latest_runs(runs: DataFrame, kind: str = "project") -> DataFrame:
    """Of every code unit of the kind, the run that started last."""
    columns = runs.columns
    last = runs.where(F.col("kind") == kind).groupBy(F.col("code_unit.name").alias("_n"), F.col("code_unit.version").alias("_v")).agg(F.max_by(F.struct(*columns), F.struct("started_at", "run_id")).alias("r"))
    return last.select(*[F.col(f"r.{c}").alias(c) for c in columns])


def run_units(runs: DataFrame) -> DataFrame:
    """(run_id, name, version): the code unit of each run, and every dependency that one of its modules has selected (``group:artifact:version``)."""
    own = runs.select("run_id", F.col("code_unit.name").alias("name"), F.col("code_unit.version").alias("version"))
    taken = runs.select("run_id", F.explode("modules").alias("m")).select("run_id", F.explode("m.selected_dependencies").alias("d"))
    cut = taken.select("run_id", F.regexp_extract("d", r"^([^:]*:[^:]*):(.*)$", 1).alias("name"), F.regexp_extract("d", r"^([^:]*:[^:]*):(.*)$", 2).alias("version"))
    return own.union(cut).distinct()


def run_catalog(catalog: DataFrame, runs: DataFrame, unsupported: bool = False) -> DataFrame:
    """(run_id, and the catalog's columns): the statements of each run's code units; those that cannot be matched only with ``unsupported``, as evaluation wants them."""
    rows = catalog if unsupported else catalog.where("template_kind <> 'unsupported'")
    units = run_units(runs)
    return rows.join(units, (rows["code_unit.name"] == units["name"]) & (rows["code_unit.version"] == units["version"])).select("run_id", *[rows[c] for c in rows.columns])


def dataset_events(logs: DataFrame, dataset: str) -> DataFrame:
    """The logs of a dataset by source file and line."""
    return logs.where(F.col("dataset_id") == dataset).orderBy("source_file", "line_number")


def catalog_statistics(statements: DataFrame) -> DataFrame:
    """(dimension, value, n): statements, and how many by logging API, kind of template, detection and reason why one is unsupported."""
    why = F.when(F.col("template_kind") == "unsupported", F.col("unsupported_reason"))
    cells = F.array(F.struct(F.lit("statements").alias("dimension"), F.lit(None).cast("string").alias("value")), *[F.struct(F.lit(d).alias("dimension"), c.alias("value")) for d, c in (("api", F.col("logging_api")), ("kind", F.col("template_kind")), ("detection", F.col("detection")))], F.when(F.col("template_kind") == "unsupported", F.struct(F.lit("reason").alias("dimension"), why.alias("value"))))
    return statements.select(F.explode(F.array_compact(cells)).alias("c")).groupBy("c.dimension", "c.value").agg(F.count("*").alias("n"))


def call_statistics(edges: DataFrame) -> DataFrame:
    """One row: calls, resolved ones, those of the project's own methods, and both in percent (0 without calls)."""
    n = edges.agg(F.count("*").alias("calls"), F.count_if("resolved").alias("resolved"), F.count_if(F.col("target_method_id").isNotNull()).alias("own"))
    percent = lambda c: F.coalesce(F.try_divide(100.0 * F.col(c), F.col("calls")), F.lit(0.0))
    return n.select("*", percent("resolved").alias("resolved_percent"), percent("own").alias("own_percent"))


def ordinals(statements: DataFrame) -> DataFrame:
    """``statements`` with ordinal: the place, from 0, among those of a file with the same class, method signature and template, in the order of ``place``."""
    w = Window.partitionBy("file_path", "class_fqn", "method_signature", "template").orderBy("place")
    return statements.withColumn("ordinal", F.row_number().over(w) - 1)


def merged_modules(new: DataFrame, prior: DataFrame) -> DataFrame:
    """``new`` modules; where the prior run has selected dependencies for a module, its dependencies and selection are kept."""
    kept = prior.where(F.size(F.coalesce("selected_dependencies", F.array().cast("array<string>"))) > 0).groupBy("module").agg(F.first(F.struct("dependencies", "selected_dependencies")).alias("_p"))
    out = new.join(kept, "module", "left")
    told = {c: F.when(F.col("_p").isNotNull(), F.col(f"_p.{c}")).otherwise(F.col(c)) for c in ("dependencies", "selected_dependencies")}
    return out.withColumns(told).select(*new.columns)


def dependency_report(statements: DataFrame) -> DataFrame:
    """(artifact, statements, supported, total): a row for each artifact, and one for all with total = 1."""
    n = statements.rollup("artifact").agg(F.count("*").alias("statements"), F.count_if("supported").alias("supported"), F.grouping("artifact").cast("int").alias("total"))
    return n.select(F.when(F.col("total") == 1, F.lit("TOTAL")).otherwise(F.col("artifact")).alias("artifact"), "statements", "supported", "total")


def to_analyse(units: DataFrame, runs: DataFrame, version: str, force: bool = False) -> DataFrame:
    """The code units of ``units`` (run_id, ...) without a run of this analyser version; all with ``force``."""
    return units if force else units.join(runs.where(F.col("analyzer_version") == version).select("run_id"), "run_id", "left_anti")


def primary_truths(rows: DataFrame, catalog: DataFrame) -> DataFrame:
    """(log_id, statement_id, and the catalog's columns) of evaluable events: the predicted statement if it is true, else the first true one; unknown ones have nulls."""
    first = F.when(F.array_contains("ids", F.col("match.statement_id")), F.col("match.statement_id")).otherwise(F.get("ids", F.lit(0)))
    return rows.where("evaluable").select("log_id", first.alias("statement_id")).join(catalog, "statement_id", "left").select("log_id", "statement_id", *[c for c in catalog.columns if c != "statement_id"])


def one_code_version(logs: DataFrame, dataset: str):
    """The code version of a dataset's logs; an error without logs, without a version, or with several."""
    found = logs.where(F.col("dataset_id") == dataset).select("code").distinct().limit(3).collect()
    if not found:
        raise ValueError(f"{dataset}: no events")
    if len(found) > 1 or found[0].code is None:
        raise ValueError(f"{dataset}: exactly one code version is needed, found {[r.code for r in found]}")
    return found[0].code

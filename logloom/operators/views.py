"""What a reader of logs, statements and methods is shown: projections, folded traces, explanations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import stable_id

#: The parts of a score in the order in which they are shown.
PARTS = ("regex_full", "regex_prefix", "specificity", "logger_exact", "logger_hierarchy", "logger_abbrev_multi", "logger_conflict", "level_equal", "level_dynamic", "level_conflict", "throwable_consistent", "throwable_inconsistent")

_FRAMES = "array<struct<class:string,method:string,file:string,line:int>>"
#: The columns of a log in the order in which they are shown, each with the type that it has where a table lacks it.
DETAIL = {
    "log_id": "string", "ts": "timestamp", "timestamp_raw": "string", "dataset_id": "string", "source_file": "string", "line_number": "int", "line_count": "int", "sequence": "bigint",
    "service": "string", "module": "string", "app_name": "string", "pid": "string", "thread": "string", "level": "string", "logger_raw": "string", "logger": "string", "message": "string", "raw": "string",
    "trace_id": "string", "span_id": "string",
    "exception": f"struct<class:string,root_class:string,message:string,frames:{_FRAMES},caused_by:array<struct<class:string,message:string,frames:{_FRAMES}>>>",
    "code": "struct<name:string,version:string>",
    "match": "struct<status:string,statement_id:string,confidence:double,confidence_level:string,candidates:array<struct<statement_id:string,score:double>>,score_breakdown:map<string,double>,args:array<string>>",
    "ground_truth": "struct<class:string,method:string,line:int,reliable:boolean>", "parser_format": "string", "ingester_version": "string", "ingested_at": "timestamp",
}


def log_summary(logs: DataFrame, most: int = 500) -> DataFrame:
    """Fifteen columns of a log for lists; the message is cut to ``most`` characters."""
    place = [F.col(f"match.{c}").alias(c) for c in ("class_fqn", "method_name", "line")]
    return logs.select("log_id", "ts", "service", "level", "thread", "logger_raw", F.substring("message", 1, most).alias("message"), F.col("match.status").alias("status"), F.col("match.confidence").alias("confidence"), F.col("match.confidence_level").alias("confidence_level"), F.col("exception").isNotNull().alias("has_exception"), "trace_id", *place)


def log_detail(logs: DataFrame) -> DataFrame:
    """All columns of a log, nested as they are; those that the table lacks are null, of their own type."""
    return logs.select(*[F.col(c) if c in logs.columns else F.lit(None).cast(t).alias(c) for c, t in DETAIL.items()])


def statement_detail(catalog: DataFrame) -> DataFrame:
    """A statement without its regular expressions."""
    return catalog.drop("regex", "regex_full", "regex_prefix")


def method_detail(methods: DataFrame) -> DataFrame:
    """A method; missing lists are empty."""
    lists = {c: F.coalesce(c, F.array().cast(t)) for c, t in methods.dtypes if t.startswith("array")}
    return methods.withColumns(lists) if lists else methods


def callers_of(methods: DataFrame, called_by: DataFrame) -> DataFrame:
    """(method_id, place, caller_id, line, class_fqn, method_name, annotations, caller_count): every caller of a method with what is known of it, in order."""
    each = called_by.select("method_id", F.posexplode("called_by").alias("place", "c")).select("method_id", "place", F.col("c.method_id").alias("caller_id"), F.col("c.line").alias("line"))
    known = methods.select(F.col("method_id").alias("caller_id"), "class_fqn", "method_name", "annotations")
    count = called_by.select(F.col("method_id").alias("caller_id"), "caller_count")
    return each.join(known, "caller_id", "left").join(count, "caller_id", "left").select("method_id", "place", "caller_id", "line", "class_fqn", "method_name", "annotations", F.coalesce("caller_count", F.lit(0)).alias("caller_count"))


def find_sources(wanted: DataFrame, sources: DataFrame) -> DataFrame:
    """(code_unit, version, path, file_id): the file's id where ``sources`` has it; others are left out."""
    named = wanted.withColumn("file_id", stable_id(F.lit("file"), "code_unit", "version", "path"))
    return named.join(sources.select("file_id"), "file_id", "left_semi").select("code_unit", "version", "path", "file_id")


def folded(frames: Column, least: int = 2) -> Column:
    """Items (kind, start, end) of a trace: frames of the project one by one, runs of ``least`` or more others folded.

    An item starts at every frame of the project and at every other frame that follows one, and lasts to the next start.
    """
    own = lambda i: F.coalesce(F.get(frames, i)["in_project"], F.lit(False))
    n = F.size(frames)
    places = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    starts = F.filter(places, lambda i: (i == 0) | own(i) | own(i - 1))
    cut = F.transform(starts, lambda s, k: F.struct(s.alias("start"), F.coalesce(F.get(starts, k + 1), n).alias("end")))
    one = lambda x: F.when(x["end"] - x.start >= least, F.array(x)).otherwise(F.transform(F.sequence(x.start, x["end"] - 1), lambda i: F.struct(i.alias("start"), (i + 1).alias("end"))))
    return F.transform(F.flatten(F.transform(cut, one)), lambda x: F.struct(F.when(x["end"] - x.start >= least, F.lit("folded")).otherwise(F.lit("frame")).alias("kind"), x.start.alias("start"), x["end"].alias("end")))


def frame_text(frame: Column) -> Column:
    """A frame as Java prints it."""
    place = F.when(frame["file"].isNull(), F.lit("Unknown Source")).when(frame["line"] > 0, F.concat(frame["file"], F.lit(":"), frame["line"].cast("string"))).otherwise(frame["file"])
    return F.concat(F.coalesce(frame["class"], F.lit("?")), F.lit("."), F.coalesce(frame["method"], F.lit("?")), F.lit("("), place, F.lit(")"))


def breakdown_rows(breakdown: Column) -> Column:
    """(key, points) of a score's parts in the order of PARTS, unknown ones after them by name."""
    order = F.array(*map(F.lit, PARTS))
    keyed = F.transform(F.map_entries(breakdown), lambda e: F.struct(F.when(F.array_contains(order, e.key), F.array_position(order, e.key)).otherwise(F.lit(len(PARTS) + 1)).alias("place"), e.key.alias("key"), e.value.alias("points")))
    return F.transform(F.array_sort(F.filter(keyed, lambda x: x.points.isNotNull() & ~F.isnan(x.points))), lambda x: F.struct(x.key.alias("key"), x.points.alias("points")))


def points_text(points: Column) -> Column:
    """Signed, two decimals, with a minus sign proper."""
    r = F.round(points, 2)
    return F.when(r == 0, F.lit("0.00")).otherwise(F.concat(F.when(r > 0, F.lit("+")).otherwise(F.lit("−")), F.format_string("%.2f", F.abs(r))))


def offset_text(start: Column, at: Column) -> Column:
    """How long after ``start``: ``+12 ms``, ``+1.234 s``, ``+2 min 3.4 s``; empty where a time is missing."""
    ms = F.unix_millis(at) - F.unix_millis(start)
    sign, size = F.when(ms < 0, F.lit("−")).otherwise(F.lit("+")), F.abs(ms)
    told = F.when(size < 1000, F.concat(size.cast("string"), F.lit(" ms"))).when(size < 60000, F.concat(F.format_string("%.3f", size / 1000), F.lit(" s"))).otherwise(F.concat(F.floor(size / 60000).cast("string"), F.lit(" min "), F.format_string("%.1f", (size % 60000) / 1000), F.lit(" s")))
    return F.coalesce(F.concat(sign, told), F.lit(""))


def mismatches(dataset: str | None = None, service=(), level=(), status=(), confidence=(), since=None, until=None, trace: str | None = None, has_exception: bool = False) -> Column:
    """Names of the filters that a log does not meet, in a fixed order; the text query is not among them."""
    among = lambda c, values: ~F.coalesce(F.col(c).isin(*values), F.lit(False))
    late = F.lit(False)
    if since is not None:
        late = late | ~F.coalesce(F.col("ts") >= F.lit(since).cast("timestamp"), F.lit(False))
    if until is not None:
        late = late | ~F.coalesce(F.col("ts") <= F.lit(until).cast("timestamp"), F.lit(False))
    checks = [("dataset", ~F.coalesce(F.col("dataset_id") == dataset, F.lit(False)) if dataset else None)]
    checks += [(name, among(c, values) if values else None) for name, c, values in (("service", "service", service), ("level", "level", level), ("status", "match.status", status), ("confidence", "match.confidence_level", confidence))]
    checks += [("time", late if since is not None or until is not None else None), ("trace", ~F.coalesce(F.col("trace_id") == trace, F.lit(False)) if trace else None), ("exceptions", F.col("exception").isNull() if has_exception else None)]
    named = [F.when(c, F.lit(n)) for n, c in checks if c is not None]
    return F.array_compact(F.array(*named)) if named else F.array().cast("array<string>")


def events_at(events: DataFrame, places: DataFrame) -> DataFrame:
    """(source_file, line, and the event's columns): the event that spans each line of ``places`` (source_file, line), the first of several.

    Events of a file do not overlap, so the event is the one with the greatest first line up to the wanted one: one
    sorted pass over both by file, no join by range.
    """
    from pyspark.sql import Window

    every = [c for c in events.columns if c != "source_file"]
    rows = events.select("source_file", F.col("line_number").alias("_at"), F.lit(0).alias("_kind"), F.struct(*every).alias("_e"))
    asked = places.select("source_file", F.col("line").alias("_at"), F.lit(1).alias("_kind"), F.lit(None).cast(rows.schema["_e"].dataType).alias("_e"))
    w = Window.partitionBy("source_file").orderBy("_at", "_kind")
    held = rows.union(asked).withColumn("_h", F.last("_e", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return held.where((F.col("_kind") == 1) & (F.col("_at") < F.col("_h.line_number") + F.col("_h.line_count"))).select("source_file", F.col("_at").alias("line"), "_h.*")


def explained(matched: DataFrame) -> DataFrame:
    """(log_id, text): how an event was linked: decision, statement, parts of the score, candidates."""
    parts = F.array_join(F.transform(breakdown_rows(F.col("match.score_breakdown")), lambda x: F.concat(F.lit("  "), x.key, F.lit(" "), points_text(x.points))), "\n")
    shown = F.array_join(F.transform("match.candidates", lambda x: F.concat(F.lit("  "), x.statement_id, F.lit(" "), F.format_string("%.2f", x.score))), "\n")
    return matched.select("log_id", F.concat_ws("\n", F.concat(F.col("match.status"), F.coalesce(F.concat(F.lit(" "), F.col("match.statement_id")), F.lit(""))), F.when(parts != "", parts), F.when(shown != "", shown)).alias("text"))

"""All that is known about a log in one row: itself, its match, statement and method, callers, exception with code, neighbours and trace."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import line_range, snippet
from .search import neighbours, trace, untraced

#: How many callers and logs of a trace are shown, and the lines around a place.
CALLERS, TRACE, RADIUS = 10, 50, 3


def _key(file_id: Column, line: Column) -> Column:
    return F.concat_ws(":", line.cast("string"), file_id)


def _snippets(places: DataFrame, sources: DataFrame) -> DataFrame:
    """(owner, shown): the snippets of each owner's places (owner, file_id, line) by place. A place is cut once, whoever asks for it."""
    asked = places.where("file_id is not null and line is not null").distinct()
    cut = asked.select("file_id", "line").distinct().join(sources.select("file_id", "content"), "file_id")
    cut = cut.select("file_id", "line", snippet(F.col("content"), F.col("line"), RADIUS).alias("snippet")).where("snippet is not null")
    entry = F.struct(_key(F.col("file_id"), F.col("line")).alias("key"), F.col("snippet").alias("value"))
    return asked.join(cut, ["file_id", "line"]).groupBy("owner").agg(F.map_from_entries(F.collect_list(entry)).alias("shown"))


def _with_snippet(frames: Column, shown: Column) -> Column:
    return F.transform(frames, lambda f: f.withField("snippet", F.when(f.in_project, F.try_element_at(shown, _key(f.file_id, f.line)))))


def bundles(logs: DataFrame, anchors: DataFrame, catalog: DataFrame, sources: DataFrame, methods: DataFrame, around: int = 10) -> DataFrame:
    """A row for each log of ``anchors``: log_id, log, match, statement, code, callers, exception, before, after, trace, trace_reason.

    ``code`` has the source of the statement's method and the statement's own snippet; ``callers`` the first CALLERS of the
    method, and exception frames in the project, with the lines around their places; ``before`` and ``after`` the
    ``around`` logs of the same file in order; ``trace`` the first TRACE logs of the trace, or a reason. Parts that are not
    there are null, lists empty.
    """
    one = logs.join(anchors.select("log_id").distinct(), "log_id", "left_semi")
    linked = one.select("log_id", F.col("match.statement_id").alias("statement_id")).where("statement_id is not null")
    known = catalog.join(linked.select("statement_id").distinct(), "statement_id", "left_semi").join(sources.select("file_id", F.col("content").alias("_content")), "file_id", "left")
    source = line_range(F.col("_content"), F.col("method_start_line"), F.col("method_end_line"))
    optional = lambda df, c, kind: F.col(c) if c in df.columns else F.lit(None).cast(kind)
    code = F.struct("file_path", optional(catalog, "link", "string").alias("link"), source.alias("method_source"), "method_start_line", optional(catalog, "snippet", "string").alias("snippet"), optional(catalog, "snippet_start_line", "int").alias("snippet_start_line"))
    said = known.select("statement_id", "method_id", F.struct(*[c for c in catalog.columns]).alias("statement"), code.alias("code"))

    refs = methods.join(said.select("method_id").distinct(), "method_id", "left_semi").select(F.col("method_id").alias("owner"), F.posexplode(F.slice("called_by", 1, CALLERS)).alias("k", "r"))
    refs = refs.join(methods.select(F.col("method_id").alias("_of"), "file_path", "file_id"), F.col("r.method_id") == F.col("_of"), "left").select("owner", "k", "r", "file_path", "file_id", F.col("r.line").alias("line"))
    refs = refs.join(_snippets(refs.select("owner", "file_id", "line"), sources), "owner", "left")
    caller = F.struct("k", F.struct(F.col("r.class_fqn").alias("class_fqn"), F.col("r.method_name").alias("method_name"), "file_path", "line", F.try_element_at("shown", _key(F.col("file_id"), F.col("line"))).alias("snippet")).alias("c"))
    called = refs.groupBy("owner").agg(F.transform(F.array_sort(F.collect_list(caller)), lambda x: x.c).alias("callers"))

    frames = F.concat(F.coalesce("exception.frames", F.array()), F.flatten(F.transform(F.coalesce("exception.caused_by", F.array()), lambda c: F.coalesce(c.frames, F.array()))))
    places = one.where("exception is not null").select(F.col("log_id").alias("owner"), F.explode(F.filter(frames, lambda f: f.in_project)).alias("f")).select("owner", "f.file_id", "f.line")
    shown = _snippets(places, sources).select(F.col("owner").alias("log_id"), "shown")
    told = F.when(F.col("exception").isNotNull(), F.col("exception").withField("frames", _with_snippet(F.col("exception.frames"), F.col("shown"))).withField("caused_by", F.transform("exception.caused_by", lambda c: c.withField("frames", _with_snippet(c.frames, F.col("shown"))))))

    near = neighbours(logs, anchors, "service", around, around).groupBy(F.col("anchor_id").alias("log_id")).agg(F.array_sort(F.collect_list(F.struct("offset", F.col("log_id").alias("id")))).alias("near"))
    side = lambda after: F.transform(F.filter(F.coalesce("near", F.array()), lambda x: (x.offset > 0) if after else (x.offset < 0)), lambda x: x.id)
    same = trace(logs, anchors, TRACE).groupBy(F.col("anchor_id").alias("log_id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("place", F.col("log_id").alias("id")))), lambda x: x.id).alias("trace"))
    why = untraced(logs, anchors).select(F.col("anchor_id").alias("log_id"), F.col("reason").alias("trace_reason"))

    row = one.select("log_id", F.struct(*[c for c in logs.columns if c not in ("match", "exception")]).alias("log"), "match", "exception")
    row = row.join(linked.join(said, "statement_id"), "log_id", "left").join(called, F.col("method_id") == F.col("owner"), "left").join(shown, "log_id", "left").join(near, "log_id", "left").join(same, "log_id", "left").join(why, "log_id", "left")
    none = F.array().cast(dict(called.dtypes)["callers"])
    return row.select("log_id", "log", "match", "statement", "code", F.coalesce("callers", none).alias("callers"), told.alias("exception"), side(False).alias("before"), side(True).alias("after"), F.coalesce("trace", F.array().cast("array<string>")).alias("trace"), "trace_reason")

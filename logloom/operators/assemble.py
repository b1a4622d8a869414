"""Lines to events: a header line opens an event, other lines extend it; stack traces are taken apart."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import blank_to_null, log_id, strip_ansi
from ..sources.formats import Parser

#: Lines of a Java stack trace.
CLASS_LINE = r"^([\w$]+\.)+[\w$]+(: .*)?$"
FRAME = r"^\s*at\s+(?:[\w.]+/)?([\w.$]+)\(([^)]*)\)(?:\s+~?\[[^\]]*\])?\s*$"
MORE = r"^\s*\.\.\.\s+\d+\s+(?:more|common frames omitted)\s*$"
CAUSE = r"^Caused by:\s?(.*)$"
MARKER = r"(?s)^@@L2C\[([^|\]]*)\|([^|\]]*)\|([^|\]]*)\]@@ (.*)$"
CORRELATION = r"^([0-9a-fA-F]{32})-([0-9a-fA-F]{16})$"

#: Lines of a file that are numbered together.
CHUNK = 1 << 16


def frame_of(line: Column) -> Column:
    """A line that matches FRAME, in parts."""
    def of(parts: Column) -> Column:
        called, place = F.get(parts, 0), F.get(parts, 1)
        named = ~place.isin("Native Method", "Unknown Source")
        colon, method = F.length(F.substring_index(place, ":", -1)), F.substring_index(called, ".", -1)
        file = F.when(place.contains(":"), F.substring(place, F.lit(1), F.length(place) - colon - 1)).otherwise(place)
        cls = F.when(called.contains("."), F.substring(called, F.lit(1), F.length(called) - F.length(method) - 1)).otherwise(F.lit(""))
        number = F.when(named & place.contains(":"), F.substring_index(place, ":", -1).try_cast("int"))
        return F.struct(F.nullif(cls, F.lit("")).alias("class"), method.alias("method"), F.when(named, F.nullif(file, F.lit(""))).alias("file"), number.alias("line"))

    # the called method holds no parenthesis, so the first one in what the expression leaves parts the two
    parts = F.split(F.regexp_replace(line, FRAME, "$1($2"), r"\(", 2)
    return F.get(F.transform(F.array(parts), of), 0)


def _class_and_message(text: Column) -> tuple[Column, Column]:
    at = F.locate(": ", text)
    cls = F.when(at > 0, F.substring(text, F.lit(1), at - 1)).otherwise(text)
    return F.nullif(F.trim(cls), F.lit("")), F.when(at > 0, F.nullif(F.substring(text, at + 2, F.length(text)), F.lit("")))


def kinds_of(lines: Column) -> Column:
    """A letter for each line: F a frame, M "... more", C a cause, K the first line if it is a class line, X any other."""
    frame = lambda x: x.contains("at ") & x.contains("(") & x.rlike(FRAME)
    return F.transform(lines, lambda x, i: F.when(frame(x), "F").when(x.contains("...") & x.rlike(MORE), "M").when(x.startswith("Caused by:"), "C").when((i == 0) & x.rlike(CLASS_LINE), "K").otherwise("X"))


def exception_of(lines: Column) -> Column:
    """The exception that ``lines`` (its own lines and what follows) show, in parts: the thrown one and its causes.

    A trace is a class line, frames and perhaps a "... more", then causes with the same after them; any other line ends
    it. So its kinds, as letters, are matched by one expression, and the parts start at its causes.
    """
    def of(kinds: Column) -> Column:
        n = F.length(F.regexp_extract(F.array_join(kinds, ""), "^K?F*M?(?:CF*M?)*", 0))
        kind = lambda i: F.get(kinds, i)
        places = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
        starts = F.filter(places, lambda i: (i == 0) | (kind(i) == "C"))

        def part(start: Column, k: Column) -> Column:
            end = F.coalesce(F.get(starts, k + 1), n)
            line = F.get(lines, start)
            head = F.when(kind(start) == "K", line).when(kind(start) == "C", F.regexp_extract(line, CAUSE, 1))
            frames = F.transform(F.filter(F.sequence(start, end - 1), lambda i: kind(i) == "F"), lambda i: frame_of(F.get(lines, i)))
            cls, message = _class_and_message(head)
            return F.struct(cls.alias("class"), message.alias("message"), frames.alias("frames"))

        return F.transform(starts, part)

    return F.get(F.transform(F.array(kinds_of(lines)), of), 0)


def exception_start(lines: Column) -> Column:
    """Place (from 1) of the first line of an exception, 0 without one: the first frame, or a class line right before it."""
    at = F.array_position(F.transform(lines, lambda x: x.contains("at ") & x.contains("(") & x.rlike(FRAME)), True).cast("int")
    before = F.try_element_at(lines, F.greatest(at - 1, F.lit(1)))
    return F.when(at > 1, at - before.rlike(CLASS_LINE).cast("int")).otherwise(at)


def assemble(lines: DataFrame, parser: Parser, files: DataFrame | None = None, unreliable: tuple[str, ...] = ()) -> DataFrame:
    """Events of ``lines`` (dataset_id, source_file, line_no, text); ``files`` adds service, module, code and oracle by path.

    The running count of header lines in a file numbers its events, one grouping gathers their lines. Lines
    before the first header are one event without header, of level UNKNOWN. Files are dealt over tasks in stretches
    of CHUNK lines: headers are counted inside a stretch, and a small table of the stretches gives the counts before it.
    """
    spot = ["dataset_id", "source_file", "chunk"]
    headed = lines.withColumn("h", parser(F.col("text"))).withColumn("chunk", F.expr(f"cast((line_no - 1) div {CHUNK} as int)"))
    headed = headed.repartition(*spot)
    # reads all columns, as the lines below do, so that both use one shuffle
    counted = headed.groupBy(*spot).agg(F.count("h").alias("c"), F.min_by(F.col("h").isNull(), "line_no").alias("orphan"), F.max(F.length("text")).alias("longest"))
    file = Window.partitionBy("dataset_id", "source_file").orderBy("chunk")
    before = counted.where("longest is null or longest >= 0").select(*spot, (F.sum("c").over(file) - F.col("c")).alias("before"), F.first("orphan").over(file).alias("orphan"))
    headed = headed.withColumn("e", F.count("h").over(Window.partitionBy(*spot).orderBy("line_no"))).join(before, spot).withColumn("e", F.col("e") + F.col("before"))
    body = F.when(F.col("h").isNotNull(), F.col("h.message")).otherwise(strip_ansi(F.col("text")))
    gathered = headed.groupBy("dataset_id", "source_file", "e").agg(
        F.min("line_no").alias("line_number"), F.count("*").cast("int").alias("line_count"), F.first("h", ignorenulls=True).alias("h"), F.first("orphan").alias("orphan"),
        F.sort_array(F.collect_list(F.struct("line_no", F.col("text").alias("raw"), body.alias("text")))).alias("rows"),
    )
    events = gathered.withColumn("sequence", F.col("e") - 1 + F.col("orphan").cast("int"))
    if files is not None:
        events = events.join(files.select(F.col("path").alias("source_file"), "service", "module", "code", "oracle", "log_format"), "source_file", "left")
    else:
        events = events.withColumns({"service": F.lit(None).cast("string"), "module": F.lit(None).cast("string"), "code": F.lit(None).cast("struct<name:string,version:string>"), "oracle": F.lit(False), "log_format": F.lit(None).cast("string")})
    text = F.col("rows.text")
    marked = F.coalesce(F.col("oracle"), F.lit(False)) & F.element_at(text, 1).rlike(MARKER)
    g = [F.regexp_extract(F.element_at(text, 1), MARKER, i) for i in range(5)]
    told = [F.when(~F.trim(x).isin("", "?"), F.trim(x)) for x in g[1:4]]
    caller, line = told[0], told[2].try_cast("int")
    vague = F.exists(F.array(*map(F.lit, unreliable)), lambda u: (caller == u) | (u.endswith(".*") & caller.startswith(F.regexp_replace(u, r"\*$", "")))) if unreliable else F.lit(False)
    truth = F.when(marked, F.struct(caller.alias("class"), told[1].alias("method"), line.alias("line"), (caller.isNotNull() & line.isNotNull() & ~F.coalesce(vague, F.lit(False))).alias("reliable")))
    events = events.withColumn("ground_truth", truth).withColumn("t", F.when(marked, F.concat(F.array(g[4]), F.slice(text, 2, F.greatest(F.size(text) - 1, F.lit(0))))).otherwise(text))
    # a header's message is a line, but a JSON message may hold several
    events = events.withColumn("t", F.flatten(F.transform("t", lambda x: F.split(F.coalesce(x, F.lit("")), "\n", -1))))
    framed = (F.size("t") > 1) | F.ltrim(F.get("t", F.lit(0))).startswith("at ")
    events = events.withColumn("at", F.when(framed, exception_start(F.col("t"))).otherwise(0))
    parts = F.get(F.transform(F.array(F.slice("t", F.greatest(F.col("at"), F.lit(1)), F.size("t"))), exception_of), 0)
    events = events.withColumn("parts", F.when(F.col("at") > 0, parts))
    first, final = F.element_at("parts", 1), F.element_at("parts", -1)
    exception = F.when(F.col("at") > 0, F.struct(first["class"].alias("class"), final["class"].alias("root_class"), first["message"].alias("message"), first["frames"].alias("frames"), F.slice("parts", 2, F.greatest(F.size("parts") - 1, F.lit(0))).alias("caused_by")))
    kept = F.when(F.col("at") > 0, F.slice("t", 1, F.greatest(F.col("at") - 1, F.lit(0)))).otherwise(F.col("t"))
    message = F.regexp_replace(F.array_join(kept, "\n"), r"(?s)^\s+|\s+\z", "")
    own_trace, own_span = blank_to_null(F.col("h.trace_id")), blank_to_null(F.col("h.span_id"))
    split = own_trace.isNull() & own_span.isNull() & F.trim(F.col("h.correlation_raw")).rlike(CORRELATION)
    return events.select(
        log_id(F.col("dataset_id"), F.col("source_file"), F.col("line_number")).alias("log_id"), "dataset_id", "source_file", "line_number", "line_count", F.col("sequence").cast("long").alias("sequence"),
        F.col("h.instant").alias("ts"), F.col("h.timestamp_raw").alias("timestamp_raw"), "service", "module", F.col("h.app_name").alias("app_name"), F.col("h.pid").alias("pid"), F.col("h.thread").alias("thread"),
        F.coalesce("h.level", F.lit("UNKNOWN")).alias("level"), F.col("h.logger_raw").alias("logger_raw"), message.alias("message"), F.array_join("rows.raw", "\n").alias("raw"),
        F.when(split, F.regexp_extract(F.trim("h.correlation_raw"), CORRELATION, 1)).otherwise(own_trace).alias("trace_id"), F.when(split, F.regexp_extract(F.trim("h.correlation_raw"), CORRELATION, 2)).otherwise(own_span).alias("span_id"),
        exception.alias("exception"), "code", "ground_truth", F.col("log_format").alias("parser_format"),
    )

"""Prompts that explain a log: its parts by level, why parts are absent, and the text within a budget of characters.

Level 0 is the log and its exception; 1 adds the statement and its method, 2 the flow to it and the code of stack frames, 3
its callers, 4 callers of callers and the neighbouring logs. Code is cut once for each statement, frame and method that any
of the asked logs needs, not once for each log, and joined by key. Parts are gathered once for all asked levels, with their
lengths, so a prompt is one concatenation of them.
"""

from __future__ import annotations

from functools import reduce
from operator import add
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import clock_offset, focus_window, numbered, stack_trace_text
from ..sources.scratch import written
from .ranks import ranked
from .search import SCOPES

#: Limits of the parts.
METHOD, FRAME_RADIUS, FRAMES, CALLER, CALLERS_A_LEVEL, CALLERS, DEPTH, SIDE = (150, 60), 3, 10, (80, 40), 5, 12, {3: 1, 4: 3}, 5
BUDGET = 60_000

#: Fixed value: places in a block of logs whose neighbours are looked up together.
BLOCK = 1 << 12

#: The words of the prompt, in the language that it is written in.
CLOSING = "Objasni ovaj log zapis prema uputstvu."
CUT = "// … (skraćeno)"
FIELDS = (("Servis", "service"), ("Vreme", "timestamp_raw"), ("Nivo", "level"), ("Logger", "logger_name"), ("Nit", "thread"), ("Trace ID", "trace_id"), ("Poruka", "message"))
SECTIONS = ("log", "exception", "statement", "method", "flow", "stackCode", "callers", "neighbors")


def _flat(text: Column, most: int) -> Column:
    """On one line, ``most`` characters at most."""
    flat = F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " ")
    flat = F.trim(flat)
    return F.when(F.length(flat) <= most, flat).otherwise(F.concat(F.substring(flat, 1, most - 1), F.lit("…")))


def _fenced(language: str, body: Column) -> Column:
    return F.concat(F.lit(f"```{language}\n"), body, F.lit("\n```"))


def _code(window: Column) -> Column:
    """A window of code with line numbers, and marks where it was cut."""
    lines = F.concat_ws("\n", F.when(window.cut_before, CUT), numbered(window.text, window.first), F.when(window.cut_after, CUT))
    return F.when(window.isNotNull(), _fenced("java", lines))


def _units(text: Column) -> Column:
    """Length in UTF-16 units, in which the budget is counted."""
    return (F.octet_length(F.encode(text, "UTF-16BE")) / 2).cast("int")


def callers_of(methods: DataFrame, roots: DataFrame, depth: int) -> DataFrame:
    """(root, place, depth, method_id, class_fqn, method_name, line): callers of the methods ``roots`` (root), breadth first.

    ``methods`` (method_id, called_by: method_id, class_fqn, method_name, line). A level has the callers of the methods kept on
    the level before, each method once, ordered by class, method and line: CALLERS_A_LEVEL at most, CALLERS in all. All roots
    go a level further in one join; what a level keeps is written, so only the methods kept are looked up among all.
    """
    calls = methods.select(F.col("method_id").alias("of"), "called_by")
    order = [F.coalesce("class_fqn", F.lit("")), F.coalesce("method_name", F.lit("")), F.col("line"), F.col("method_id")]
    start = roots.select("root").distinct()
    last = written(start.select("root", F.col("root").alias("method_id"), F.lit(0).alias("depth"), F.lit(None).cast("string").alias("class_fqn"), F.lit(None).cast("string").alias("method_name"), F.lit(None).cast("int").alias("line"), F.lit(0).alias("place")), "roots")
    seen = last
    for d in range(1, depth + 1):
        found = last.select("root", F.col("method_id").alias("of")).join(calls, "of").select("root", F.explode("called_by").alias("r")).where("r.method_id is not null").select("root", "r.*")
        found = found.join(seen.select("root", "method_id"), ["root", "method_id"], "left_anti")
        once = found.withColumn("k", F.row_number().over(Window.partitionBy("root", "method_id").orderBy(*order))).where("k = 1")
        had = seen.groupBy("root").agg(F.max("place").alias("had"))
        ranked = once.withColumn("k", F.row_number().over(Window.partitionBy("root").orderBy(*order))).join(had, "root")
        last = written(ranked.where((F.col("k") <= CALLERS_A_LEVEL) & (F.col("k") + F.col("had") <= CALLERS)).select("root", "method_id", F.lit(d).alias("depth"), "class_fqn", "method_name", F.col("line").cast("int").alias("line"), (F.col("k") + F.col("had")).alias("place")), "level")
        seen = seen.unionByName(last)
    return seen.where("depth > 0").select("root", "place", "depth", "method_id", "class_fqn", "method_name", "line")


def _statements(known: DataFrame, sources: DataFrame) -> DataFrame:
    """(statement_id, said, said_n, code, flow, flow_n, library, root): what the catalog tells of statements, as blocks of text with their lengths; ``said`` follows the line on the link."""
    s = known.join(sources.select("file_id", "content"), "file_id", "left")
    window = focus_window(F.col("content"), F.col("method_start_line"), F.col("method_end_line"), F.col("line"), *METHOD)
    unit = F.when(F.col("code_unit.type") == "project", F.concat(F.lit("projekat "), F.col("code_unit.name"), F.lit(" @ "), F.substring(F.coalesce("code_unit.version", F.lit("")), 1, 7))).otherwise(F.concat(F.lit("biblioteka "), F.col("code_unit.name"), F.lit(":"), F.col("code_unit.version")))
    said = F.concat_ws("", *[F.concat(F.lit("\n"), x) for x in (F.when(F.col("code_unit").isNotNull(), F.concat(F.lit("- Kod: "), unit)), F.concat(F.lit("- Fajl: "), F.col("file_path"), F.lit(", linija "), F.col("line").cast("string")), F.concat(F.lit("- Klasa i metoda: "), F.col("class_fqn"), F.lit("#"), F.col("method_signature")), F.concat(F.lit("- Šablon poruke: "), F.col("template")))], F.concat(F.lit("\n\n## Metoda u kojoj je log\n"), F.col("code")))
    at = lambda x: F.concat(F.lit(" (linija "), x.line.cast("string"))

    def condition(c: Column) -> Column:
        t = _flat(c.text, 200)
        named = F.when(c.kind == "if", F.concat(F.lit("if ("), t, F.lit(")"))).when(c.kind == "else", F.concat(F.lit("NE: "), t)).when(c.kind == "catch", F.concat(F.lit("catch ("), t, F.lit(")"))).when(c.kind == "switch_case", F.when(t == "", "case").otherwise(F.concat(F.lit("case "), t)))
        return F.concat(F.lit("- Unutar: "), named.otherwise(F.when(t == "", c.kind).otherwise(F.concat(c.kind, F.lit(" ("), t, F.lit(")")))), at(c), F.lit(")"))

    def listed(label: str, items: str) -> Column:
        lines = F.transform(items, lambda x: F.concat(F.lit("  - "), _flat(x.text, 200), at(x), F.lit(")")))
        return F.when(F.size(items) > 0, F.concat(F.lit(f"- {label}:\n"), F.array_join(lines, "\n")))

    exits = F.transform("control.early_exits", lambda x: F.concat(F.lit("- Stiže se samo ako NIJE: "), _flat(x.text, 200), at(x), F.lit(", "), x.exit_kind, F.lit(")")))
    block = lambda items: F.when(F.size(items) > 0, F.array_join(items, "\n"))
    flow = F.concat_ws("\n", block(F.transform("control.conditions", condition)), block(exits), listed("Prethodne naredbe (od najbliže)", "control.preceding"), listed("Pozivi pre loga", "control.calls_before"))
    s = s.withColumns({"code": _code(window), "flow": F.when(flow != "", F.concat(F.lit("# Uslovi i tok do loga\n"), flow))}).withColumn("said", said)
    return s.select("statement_id", "said", _units(F.col("said")).alias("said_n"), F.col("code").isNotNull().alias("code"), "flow", _units(F.col("flow")).alias("flow_n"), (F.coalesce(F.col("code_unit.type"), F.lit("")) == "dependency").alias("library"), "root")


def _stack_code(first: DataFrame, sources: DataFrame) -> DataFrame:
    """(log_id, stack, stack_n): the code around the first FRAMES that can be shown of the frames ``first`` (log_id, k, f, file_id, line)."""
    shown = first.select("file_id", "line").distinct().join(sources.select("file_id", "content", F.col("file_path").alias("path")), "file_id")
    window = focus_window(F.col("content"), F.greatest(F.lit(1), F.col("line") - FRAME_RADIUS), F.col("line") + FRAME_RADIUS, F.col("line"), 1 << 30, 0)
    shown = shown.withColumn("w", window).where(F.col("line") <= F.col("w.first") + F.size(F.split("w.text", "\n", -1)) - 1).select("file_id", "line", "path", _code(F.col("w")).alias("code"))
    known = first.join(written(shown, "shown"), ["file_id", "line"]).withColumn("r", F.row_number().over(Window.partitionBy("log_id").orderBy("k"))).where(F.col("r") <= FRAMES)
    title = F.concat(F.lit("### "), F.substring_index(F.coalesce("f.class", F.lit("")), ".", -1), F.lit("."), F.col("f.method"), F.lit(" — "), F.coalesce("f.file", "path"), F.lit(":"), F.col("line").cast("string"))
    blocks = known.groupBy("log_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", F.concat(title, F.lit("\n"), F.col("code")).alias("b")))), lambda x: x.b), "\n\n").alias("b"))
    return blocks.select("log_id", F.concat(F.lit("# Kod iz stack trace-a\n\n"), F.col("b")).alias("stack")).withColumn("stack_n", _units(F.col("stack")))


def _upto(callers: Column) -> Column:
    """(depth, text, n): for every depth the text of the callers to it, and how many units it and what parts it from the head take."""
    depths = F.array_sort(F.array_distinct(F.transform(callers, lambda c: c.depth)))
    text = lambda d: F.concat(F.lit("# Pozivaoci\n\n"), F.array_join(F.transform(F.filter(callers, lambda c: c.depth <= d), lambda c: c.text), "\n\n"))
    return F.transform(F.transform(depths, lambda d: F.struct(d.alias("depth"), text(d).alias("text"))), lambda u: F.struct(u.depth.alias("depth"), u.text.alias("text"), (_units(u.text) + 2).alias("n")))


def _caller_blocks(found: DataFrame, there: DataFrame, sources: DataFrame) -> DataFrame:
    """(root, upto) of the callers ``found``, of which ``there`` has those that are methods of the catalog."""
    told = there.select("method_id", F.col("class_fqn").alias("c"), "method_signature", F.col("file_path").alias("path"), "file_id", "start_line", "end_line", "annotations", F.lit(True).alias("there"))
    rows = found.join(told, "method_id", "left").join(sources.select("file_id", "content"), "file_id", "left")
    line = F.concat(F.lit(", poziv u liniji "), F.col("line").cast("string"))
    entries = F.transform(F.filter(F.coalesce("annotations", F.array().cast("array<string>")), lambda a: a.endswith("Mapping")), lambda a: F.concat(F.lit("@"), a))
    rest = F.when(F.size(entries) > 0, F.concat(F.lit(", REST ulaz ("), F.array_join(entries, ", "), F.lit(")"))).otherwise("")
    title = F.when(F.col("there"), F.concat("c", F.lit("#"), "method_signature", F.lit(" — "), "path", line, rest)).otherwise(F.concat("class_fqn", F.lit("#"), "method_name", line))
    code = _code(focus_window(F.col("content"), F.col("start_line"), F.col("end_line"), F.col("line"), *CALLER))
    text = F.concat_ws("\n", F.concat(F.lit("### Nivo "), F.col("depth").cast("string"), F.lit(": "), title), code)
    rows = rows.select("root", "place", F.struct("depth", text.alias("text")).alias("b"))
    blocks = rows.groupBy("root").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "b"))), lambda x: x.b).alias("blocks"))
    return blocks.select("root", _upto(F.col("blocks")).alias("upto"))


def _with_near(logs: DataFrame, wanted: DataFrame, columns: list[str]) -> DataFrame:
    """``columns`` of the logs ``wanted`` (log_id), and ``near``: the lines of the logs around, the log itself marked; null for logs without neighbours.

    Logs with their places in the order of scope and time (see ranks) are dealt into blocks that overlap by SIDE places a side,
    so that the lines around a log stand beside it in its block.
    """
    by, order = SCOPES["service"]
    keys = [*by, *order, "log_id"]
    scopes = written(logs.join(wanted, "log_id", "left_semi").select(*by).distinct(), "scopes")
    rows = logs.alias("l").join(scopes.alias("s"), [F.col(f"l.{c}").eqNullSafe(F.col(f"s.{c}")) for c in by], "left_semi")
    rows = rows.join(wanted.withColumn("asked", F.lit(True)), "log_id", "left")
    own = F.when(F.col("asked"), F.struct(*columns))
    placed = ranked(rows.select(*keys, "ts", "level", "logger_raw", "message", own.alias("own")), keys)
    at, block = F.col("n") % BLOCK, F.floor(F.col("n") / BLOCK)
    dealt = F.array_compact(F.array(block, F.when(at < SIDE, block - 1), F.when(at >= BLOCK - SIDE, block + 1)))
    tail = F.concat(F.lit(" "), F.coalesce("level", F.lit("")), F.lit(" "), F.coalesce("logger_raw", F.lit("")), F.lit(" — "), _flat(F.col("message"), 300))
    placed = placed.select(*by, "n", block.alias("home"), F.struct("ts", tail.alias("tail")).alias("line"), "own", F.explode(dealt).alias("block"))
    inside = Window.partitionBy(*by, "block").orderBy("n")
    around = {f"_{k}": F.lead("line", k).over(inside) for k in range(-SIDE, SIDE + 1) if k}
    placed = placed.withColumns(around).where("own is not null and home = block").withColumn("ahead", clock_offset(F.col("own.timestamp_raw"), F.col("line.ts")).cast("long"))

    def shown(line: Column, mark: str) -> Column:
        time = F.coalesce(F.date_format(F.timestamp_micros(F.unix_micros(F.to_utc_timestamp(line.ts, "UTC")) + F.col("ahead") * 1_000_000), "HH:mm:ss.SSS"), F.lit("??:??:??.???"))
        return F.when(line.isNotNull(), F.concat(F.lit(mark), time, line.tail))

    lines = F.concat_ws("\n", *[shown(F.col(f"_{k}" if k else "line"), "" if k else "▶ ") for k in range(-SIDE, SIDE + 1)])
    some = F.coalesce(*[F.col(c) for c in around]).isNotNull() & F.concat(*by).isNotNull()
    return placed.select("own.*", F.when(some, F.concat(F.lit("# Susedni logovi istog servisa\n"), _fenced("text", lines))).alias("near"))


class Gathered(NamedTuple):
    """What prompts are put together from, each a table: ``asked``, a row a log; ``told``, a row a statement; ``stack``, a row a log with code of its frames."""

    asked: DataFrame
    told: DataFrame | None = None
    stack: DataFrame | None = None


def gathered(logs: DataFrame, anchors: DataFrame, level: int, catalog: DataFrame, sources: DataFrame, methods: DataFrame) -> Gathered:
    """The parts of prompts up to ``level``, gathered once for all levels. Files are read once, for those that statements, frames and callers name."""
    logs = logs.withColumn("raw", F.when(F.col("exception").isNotNull(), F.col("raw")))
    wanted, columns = anchors.select("log_id").distinct(), ["log_id", "logger", *[c for _, c in FIELDS if c != "logger_name"], "logger_raw", "exception", "raw", "match"]
    a = _with_near(logs, wanted, columns) if level >= 4 else logs.join(wanted, "log_id", "left_semi").select(*columns, F.lit(None).cast("string").alias("near"))
    a = a.withColumn("logger_name", F.coalesce("logger", "logger_raw")).withColumn("trace_id", F.when(F.trim("trace_id") != "", F.col("trace_id")))
    a = a.withColumn("trace", F.when(F.col("exception").isNotNull(), stack_trace_text(F.col("raw"), F.col("exception.class"))))
    log = F.concat(F.lit("# Log zapis\n"), F.concat_ws("\n", *[F.concat(F.lit(f"- {name}: "), F.col(c)) for name, c in FIELDS]))
    log = F.concat_ws("\n\n", log, F.concat(F.lit("## Izuzetak\n"), _fenced("text", F.col("trace"))))
    linked = F.col("match.statement_id").isNotNull() & (F.coalesce(F.col("match.status"), F.lit("")) != "unmatched")
    sure = F.coalesce(F.concat(F.lit(" ("), F.format_string("%.2f", F.col("match.confidence")), F.lit(")")), F.lit(""))
    bound = F.concat(F.lit("# Mesto u kodu koje je napisalo ovaj log\n- Povezivanje: "), F.coalesce("match.status", F.lit("null")), F.lit(", pouzdanost "), F.coalesce("match.confidence_level", F.lit("null")), sure)
    inner = F.flatten(F.transform(F.coalesce(F.col("exception.caused_by"), F.array()), lambda c: c.frames))
    frames = F.filter(F.concat(F.coalesce("exception.frames", F.array()), inner), lambda f: f.in_project & f.file_id.isNotNull() & f.line.isNotNull())
    a = a.select("log_id", log.alias("log"), bound.alias("bound"), "near", F.col("trace").isNotNull().alias("traced"), F.col("exception").isNotNull().alias("excepted"), F.when(linked, F.col("match.statement_id")).alias("linked"), F.when(F.col("exception").isNotNull() & (F.size(frames) > 0), frames).alias("frames"))
    a = written(a.withColumns({f"{c}_n": _units(F.col(c)) for c in ("log", "bound", "near")}), "asked")
    if not level:
        return Gathered(a)
    known = written(catalog.join(a.select(F.col("linked").alias("statement_id")).where("statement_id is not null").distinct(), "statement_id", "left_semi"), "known")
    there = written(methods.join(known.select("method_id").distinct(), "method_id", "left_semi").select(F.col("method_id").alias("root")).distinct(), "there")
    known = known.join(there, F.col("method_id") == F.col("root"), "left")
    files = known.select("file_id")
    if level >= 2:
        each = a.where("frames is not null").select("log_id", F.posexplode("frames").alias("k", "f"))
        first = written(each.groupBy("log_id", "f.file_id", "f.line").agg(F.min_by("f", "k").alias("f"), F.min("k").alias("k")), "frames")
        files = files.union(first.select("file_id"))
    if level >= 3:
        found = written(callers_of(methods, known.where("root is not null and coalesce(code_unit.type, '') <> 'dependency'").select("root"), DEPTH[level]), "callers")
        calling = written(methods.drop("called_by").join(found.select("method_id").distinct(), "method_id", "left_semi"), "calling")
        files = files.union(calling.select("file_id"))
    sources = written(sources.join(written(files.distinct(), "files"), "file_id", "left_semi").select("file_id", "file_path", "content"), "sources")
    told = written(_statements(known, sources), "statements")
    if level >= 3:
        told = written(told.join(written(_caller_blocks(found, calling, sources), "blocks"), "root", "left"), "told")
    return Gathered(a, told, written(_stack_code(first, sources), "stack") if level >= 2 else None)


def contexts(parts: Gathered, level: int) -> DataFrame:
    """(log_id, head, head_n, upto, near, near_n, sections): the parts of each prompt and their lengths. ``head`` is all that is never left out; ``upto`` see _upto; ``sections`` (id, included, reason) in the prompt's order."""
    a = parts.asked if level >= 4 else parts.asked.withColumns({"near": F.lit(None).cast("string"), "near_n": F.lit(None).cast("int")})
    here = lambda name, there, reason: F.struct(F.lit(name).alias("id"), there.alias("included"), F.when(~there, reason).alias("reason"))
    sections = [here("log", F.lit(True), F.lit(None)), here("exception", F.col("traced"), F.lit("noException"))]
    blocks = {"log": F.col("log_n")}
    if level >= 2:
        none = {"stack": F.lit(None).cast("string"), "stack_n": F.lit(None).cast("int")}
        a = a.where("frames is not null").join(parts.stack, "log_id", "left").unionByName(a.where("frames is null").withColumns(none))
    if level >= 1:
        a = a.join(parts.told, F.col("linked") == F.col("statement_id"), "left")
        entry = F.col("said").isNotNull()
        why = F.when(F.col("linked").isNull(), "unmatched").when(~entry, "unavailable")
        a = a.withColumns({"place": F.concat("bound", "said"), "place_n": F.col("bound_n") + F.col("said_n")})
        blocks["place"] = F.col("place_n")
        sections += [here("statement", entry, why), here("method", F.coalesce("code", F.lit(False)), F.coalesce(why, F.lit("unavailable")))]
    if level >= 2:
        blocks |= {"flow": F.col("flow_n"), "stack": F.col("stack_n")}
        sections += [here("flow", F.col("flow").isNotNull(), F.coalesce(why, F.lit("noControl"))), here("stackCode", F.col("stack").isNotNull(), F.when(~F.col("excepted"), "noException").when(F.col("frames").isNull(), "noProjectFrames").otherwise("unavailable"))]
    upto = F.array().cast("array<struct<depth:int,text:string,n:int>>")
    if level >= 3:
        upto = F.coalesce(F.filter("upto", lambda u: u.depth <= DEPTH[level]), upto)
        upto = F.when(~F.coalesce("library", F.lit(False)), upto).otherwise(F.array().cast("array<struct<depth:int,text:string,n:int>>"))
        sections.append(here("callers", F.size(upto) > 0, F.coalesce(why, F.when(F.col("library"), "library").when(F.col("root").isNull(), "unavailable").otherwise("noCallers"))))
    if level >= 4:
        sections.append(here("neighbors", F.col("near").isNotNull(), F.lit("noNeighbors")))
    sections += [here(n, F.lit(False), F.lit("level")) for n in SECTIONS[len(sections) :]]
    length = reduce(add, [F.coalesce(n + 2, F.lit(0)) for n in blocks.values()]) - 2
    return a.select("log_id", F.concat_ws("\n\n", *blocks).alias("head"), length.alias("head_n"), upto.alias("upto"), "near", "near_n", F.array(*sections).alias("sections"))


def rendered(parts: DataFrame, budget: int = BUDGET) -> DataFrame:
    """``fitted`` for parts (log_id, head, callers, near, sections) that are not measured yet; ``callers`` (depth, text)."""
    return fitted(parts.select("log_id", "head", _units(F.col("head")).alias("head_n"), _upto(F.col("callers")).alias("upto"), "near", _units(F.col("near")).alias("near_n"), "sections"), budget)


def fitted(parts: DataFrame, budget: int = BUDGET) -> DataFrame:
    """(log_id, text, chars, sections) of ``contexts``, cut to ``budget`` UTF-16 units: neighbours go first, then the deepest callers, level by level, until the text fits or nothing more can go.

    The lengths of all that may stay are known, so the cut is found without rendering, and ``chars`` is their sum.
    """
    p = parts.withColumn("most", F.try_element_at("upto", F.lit(-1))).withColumn("base", F.col("head_n") + len("\n\n") + len(CLOSING))
    p = p.withColumn("all", F.col("base") + F.coalesce("most.n", F.lit(0)) + F.coalesce(F.col("near_n") + 2, F.lit(0)) <= budget)
    p = p.withColumn("kept", F.when(F.col("all"), F.col("most")).otherwise(F.try_element_at(F.filter("upto", lambda u: F.col("base") + u.n <= budget), F.lit(-1))))
    text = F.concat_ws("\n\n", "head", "kept.text", F.when(F.col("all"), F.col("near")), F.lit(CLOSING))
    chars = F.col("base") + F.coalesce("kept.n", F.lit(0)) + F.coalesce(F.when(F.col("all"), F.col("near_n") + 2), F.lit(0))

    def told(s: Column) -> Column:
        less = F.coalesce("kept.depth", F.lit(0)) < F.coalesce("most.depth", F.lit(0))
        gone = F.struct(s.id.alias("id"), ((s.id == "callers") & F.col("kept").isNotNull()).alias("included"), F.lit("truncated").alias("reason"))
        return F.when(((s.id == "callers") & less) | ((s.id == "neighbors") & F.col("near").isNotNull() & ~F.col("all")), gone).otherwise(s)

    return p.select("log_id", text.alias("text"), chars.cast("int").alias("chars"), F.transform("sections", told).alias("sections"))


def prompts_by_level(logs: DataFrame, anchors: DataFrame, levels: list[int], catalog: DataFrame, sources: DataFrame, methods: DataFrame, budget: int = BUDGET) -> DataFrame:
    """(level, log_id, text, chars, sections): the prompts of every log of ``anchors``, one for each level, of parts that are gathered once."""
    if not levels or any(level not in range(5) for level in levels):
        raise ValueError("levels must be 0 to 4")
    parts = gathered(logs, anchors, max(levels), catalog, sources, methods)
    return reduce(DataFrame.union, [fitted(contexts(parts, level), budget).select(F.lit(level).alias("level"), "*") for level in levels])


def prompts(logs: DataFrame, anchors: DataFrame, level: int, catalog: DataFrame, sources: DataFrame, methods: DataFrame, budget: int = BUDGET) -> DataFrame:
    """(log_id, text, chars, sections): the prompt of every log of ``anchors``."""
    return prompts_by_level(logs, anchors, [level], catalog, sources, methods, budget).drop("level")

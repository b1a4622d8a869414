"""Questions over enriched logs: filters, pages, neighbours, traces, context."""

from __future__ import annotations

import base64
import json
import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import tokens
from .ranks import ranked

IN = {"service": "service", "level": "level", "status": "match.status", "confidence": "match.confidence_level"}
EQUAL = {"dataset": "dataset_id", "trace": "trace_id", "statement": "match.statement_id", "log": "log_id"}
ORDER = ("ts", "sequence", "log_id")


#: A word of a message or query: letters, digits and underscores; between letters or digits also the marks that Unicode's word rules keep inside.
TERM = r"[\p{L}\p{M}\p{N}_]+(?:(?:(?<=\p{L})[.:'’·](?=\p{L})|(?<=\p{N})[.,;'](?=\p{N}))[\p{L}\p{M}\p{N}_]+)*"
_TOKEN = re.compile(r'''\s+|(?P<op>[+|()])|-(?P<no>)|"(?P<phrase>(?:[^"\\]|\\.)*)"(?:~\d+)?|(?P<word>(?:[^\s+|()"\\]|\\.)+)|.''', re.S)


def terms_of(column: Column) -> Column:
    """Words of a text, lower-cased, in order."""
    return F.regexp_extract_all(F.lower(F.coalesce(column, F.lit(""))), F.lit(TERM), F.lit(0))


def parse_query(q: str):
    """The tree of a query: ("term" | "prefix" | "phrase", text), ("fuzzy", text, edits), ("not", x), ("and" | "or", x, y), ("all",) or None for nothing.

    Terms beside each other are alternatives; ``+`` between two means both, ``|`` either; operators bind from left to right and
    parentheses group; ``-`` before a term or group negates it; ``"..."`` is a phrase, ``word*`` a prefix, ``word~1`` allows edits; a
    backslash takes a character as it is. An open parenthesis or quote without its end is ignored.
    """
    tokens = [m for m in _TOKEN.finditer(q) if not m[0].isspace()]
    closing, open_ = {}, []
    for i, m in enumerate(tokens):
        if m["op"] == "(":
            open_.append(i)
        elif m["op"] == ")" and open_:
            closing[open_.pop()] = i

    def plain(text: str) -> str:
        return re.sub(r"\\(.)", r"\1", text)

    def leaf(m):
        if m["phrase"] is not None:
            return ("phrase", plain(m["phrase"])) if re.search(r"\w", m["phrase"]) else None
        word = m["word"]
        if not re.search(r"\w", word):
            return ("all",) if word == "*" else None
        fuzzy = re.fullmatch(r"(.*[^\\])~(\d*)", word)
        if fuzzy:
            return ("fuzzy", plain(fuzzy[1]), min(2, int(fuzzy[2] or 2)))
        return ("prefix", plain(word[:-1])) if word.endswith("*") and not word.endswith("\\*") else ("term", plain(word))

    def tree(first: int, last: int):
        top, op, negated, i = None, None, False, first
        while i < last:
            m, branch = tokens[i], None
            i += 1
            if m["op"] in ("+", "|"):
                op = op or ("and" if m["op"] == "+" else "or") if top is not None else None
                continue
            if m["no"] is not None:
                negated = not negated
                continue
            if m["op"] == "(" and i - 1 in closing:
                branch = tree(i, closing[i - 1])
                i = closing[i - 1] + 1
            elif m["phrase"] is not None or m["word"] is not None:
                branch = leaf(m)
            else:
                continue
            if branch is not None:
                branch = ("not", branch) if negated else branch
                top = branch if top is None else (op or "or", top, branch)
                op = None
            negated = False
        return top

    return tree(0, len(tokens))


def text_query(q: str, column: Column, words: Column | None = None) -> Column:
    """Whether the words of ``column`` (``words``, where a column has them already) meet a query (see parse_query). A term that holds several words is met by any of them; a query without terms is met by nothing."""
    have = terms_of(column) if words is None else words
    spaced = lambda words: F.concat(F.lit(" "), F.array_join(words, " "), F.lit(" "))

    def met(x) -> Column:
        if x[0] == "all":
            return F.lit(True)
        if x[0] == "not":
            return ~met(x[1])
        if x[0] in ("and", "or"):
            return met(x[1]) & met(x[2]) if x[0] == "and" else met(x[1]) | met(x[2])
        if x[0] == "prefix":
            return F.exists(have, lambda t: t.startswith(x[1].lower()))
        if x[0] == "fuzzy":
            return F.exists(have, lambda t: F.levenshtein(t, F.lit(x[1].lower()), x[2]) >= 0)
        wanted = terms_of(F.lit(x[1]))
        return spaced(have).contains(spaced(wanted)) if x[0] == "phrase" else F.arrays_overlap(have, wanted)

    parsed = parse_query(q)
    return met(parsed) if parsed is not None else F.lit(False)


def search(logs: DataFrame, q: str | None = None, since=None, until=None, has_exception: bool | None = None, **wanted) -> DataFrame:
    """Logs for which all hold; without conditions all logs. service, level, status, confidence take lists; dataset, trace, statement, log a value. has_exception asks for the exception's class."""
    out = logs
    for name, value in wanted.items():
        if value is None:
            continue
        if name in IN:
            out = out.where(F.col(IN[name]).isin(*([value] if isinstance(value, str) else value)))
        elif name in EQUAL:
            out = out.where(F.col(EQUAL[name]) == value)
        else:
            raise ValueError(f"no such filter: {name}")
    if since is not None:
        out = out.where(F.col("ts") >= F.lit(since).cast("timestamp"))
    if until is not None:
        out = out.where(F.col("ts") <= F.lit(until).cast("timestamp"))
    if has_exception is not None:
        out = out.where(F.col("exception.class").isNotNull() if has_exception else F.col("exception.class").isNull())
    return out.where(text_query(q, F.col("message"))) if q and q.strip() else out


def page(logs: DataFrame, size: int = 100, order: str = "desc", cursor: str | None = None) -> DataFrame:
    """The next ``size`` (500 at most) logs by (ts, sequence, log_id), missing times last, after the log that the cursor names."""
    if size <= 0 or order not in ("asc", "desc"):
        raise ValueError("size must be positive, order asc or desc")
    size, down = min(size, 500), order == "desc"
    if cursor:
        values = decode_cursor(cursor)
        keys = [F.col("ts"), F.col("sequence"), F.col("log_id")]
        marks = [F.lit(values[0]).cast("timestamp"), F.lit(values[1]).cast("long"), F.lit(values[2])]
        beyond = F.lit(False)
        same = F.lit(True)
        for k, m in zip(keys, marks, strict=True):
            later = (k < m) if down else (k > m)
            later = later | (k.isNull() & m.isNotNull())
            beyond = beyond | (same & F.coalesce(later, F.lit(False)))
            same = same & k.eqNullSafe(m)
        logs = logs.where(beyond)
    by = [F.col(c).desc_nulls_last() if down else F.col(c).asc_nulls_last() for c in ORDER]
    return logs.orderBy(*by).limit(size)


def page_end(found: DataFrame, shown: DataFrame, order: str = "desc") -> DataFrame:
    """One row (total, cursor): how many logs ``found`` holds, and the cursor after the last log of the page ``shown`` (null for an empty page); nulls rank in each key as ``page`` has them."""
    down = order == "desc"
    place = F.struct(*[x for c in ORDER for x in ((F.col(c).isNotNull() if down else F.col(c).isNull()).alias(f"{c}_rank"), F.col(c))])
    last = shown.agg((F.min_by if down else F.max_by)(F.to_json(F.array(*[F.col(c).cast("string") for c in ORDER]), {"ignoreNullFields": "false"}), place).alias("k"))
    both = found.agg(F.count("*").alias("n")).select("n", F.lit(None).cast("string").alias("k")).union(last.select(F.lit(0).cast("long"), "k"))
    return both.agg(F.max("n").alias("total"), F.max("k").alias("k")).select("total", F.base64(F.col("k").cast("binary")).alias("cursor"))


def encode_cursor(values: list) -> str:
    return base64.urlsafe_b64encode(json.dumps([None if v is None else str(v) for v in values]).encode()).decode()


def decode_cursor(cursor: str) -> list:
    values = json.loads(base64.b64decode(cursor.replace("-", "+").replace("_", "/")))
    if not isinstance(values, list) or len(values) != len(ORDER):
        raise ValueError("not a cursor")
    return values


SCOPES = {"service": (["dataset_id", "source_file"], ["sequence"]), "thread": (["dataset_id", "service", "thread"], list(ORDER)), "dataset": (["dataset_id"], list(ORDER))}


#: Most neighbours a side, and most logs of a trace.
MOST = 500


def neighbours(logs: DataFrame, anchors: DataFrame, scope: str = "service", before: int = 20, after: int = 20) -> DataFrame:
    """(anchor_id, offset, log_id): for every log_id of ``anchors`` the logs before (negative offsets) and after it in its scope, MOST a side at most; an unknown scope and negative numbers are errors.

    Logs get places in the order of scope and time (see ranks), and an anchor asks for the places around its own: a
    scope of any size, a whole dataset too, is sorted by many tasks.
    """
    if scope not in SCOPES:
        raise ValueError(f"no such scope: {scope}")
    if before < 0 or after < 0:
        raise ValueError("before and after must not be negative")
    before, after = min(before, MOST), min(after, MOST)
    by, order = SCOPES[scope]
    keys = [*by, *[c for c in order if c not in by], *(["log_id"] if "log_id" not in order else [])]
    mine = logs.join(anchors.select("log_id"), "log_id", "left_semi").select(*by).distinct()
    placed = ranked(logs.select(*keys).join(mine, by, "left_semi"), keys).select("log_id", F.struct(*by).alias("scope"), "n")
    around = F.filter(F.sequence(F.lit(-before), F.lit(after)), lambda k: k != 0)
    at = placed.join(anchors.select("log_id"), "log_id", "left_semi").select(F.col("log_id").alias("anchor_id"), F.col("scope").alias("own"), F.col("n").alias("own_n"), F.explode(around).alias("offset"))
    at = at.withColumn("n", F.col("own_n") + F.col("offset"))
    return at.join(placed, "n").where(F.col("own") == F.col("scope")).select("anchor_id", F.col("offset").cast("int").alias("offset"), "log_id")


def adjacent(logs: DataFrame, scope: str = "service") -> DataFrame:
    """(log_id, previous_id, next_id) for all logs at once: one window, no join."""
    by, order = SCOPES[scope]
    w = Window.partitionBy(*by).orderBy(*[F.col(c).asc_nulls_last() for c in order])
    return logs.select("log_id", F.lag("log_id").over(w).alias("previous_id"), F.lead("log_id").over(w).alias("next_id"))


def trace(logs: DataFrame, anchors: DataFrame, most: int = 200) -> DataFrame:
    """(anchor_id, place, log_id): the first ``most`` (MOST at most) logs of the anchor's trace in its dataset, by time; a blank trace id is none (see untraced).

    A trace is numbered and cut once, whatever the number of its anchors, and a trace of any length by many tasks.
    """
    if most <= 0:
        raise ValueError("most must be positive")
    key = ["dataset_id", "trace_id"]
    at = logs.join(anchors.select("log_id"), "log_id", "left_semi").where("trim(trace_id) <> ''").select(F.col("log_id").alias("anchor_id"), *key)
    placed = ranked(logs.select(*key, *ORDER).join(at.select(*key).distinct(), key, "left_semi"), [*key, *ORDER])
    first = placed.groupBy(*key).agg(F.min("n").alias("first"))
    cut = placed.join(first, key).withColumn("place", (F.col("n") - F.col("first") + 1).cast("int")).where(F.col("place") <= min(most, MOST))
    return at.join(cut.select(*key, "place", "log_id"), key).select("anchor_id", "place", "log_id")


def untraced(logs: DataFrame, anchors: DataFrame) -> DataFrame:
    """(anchor_id, reason): anchors for which ``trace`` has no logs since they carry no trace id."""
    return logs.join(anchors.select("log_id"), "log_id", "left_semi").where("coalesce(trim(trace_id), '') = ''").select(F.col("log_id").alias("anchor_id"), F.lit("no-trace-id").alias("reason"))


def candidate_details(logs: DataFrame, catalog: DataFrame) -> DataFrame:
    """(log_id, place, statement_id, score, class_fqn, line, template): every candidate, in order; unknown statements have nulls."""
    rows = logs.select("log_id", F.posexplode("match.candidates").alias("place", "c")).select("log_id", "place", "c.statement_id", "c.score")
    return rows.join(catalog.select("statement_id", "class_fqn", "line", "template"), "statement_id", "left").select("log_id", "place", "statement_id", "score", "class_fqn", "line", "template")


def context(logs: DataFrame, anchors: DataFrame, catalog: DataFrame, sources: DataFrame, called_by: DataFrame, radius: int = 3) -> DataFrame:
    """One row for each anchor: the log, its statement with a snippet, its method's first ten callers, ten neighbours a side and 50 logs of its trace."""
    from ..functions.text import snippet

    one = logs.join(anchors.select("log_id"), "log_id", "left_semi")
    said = catalog.select("statement_id", "file_id", F.col("line").alias("at"), "method_id", F.col("template").alias("said"))
    one = one.withColumn("statement_id", F.col("match.statement_id")).join(said, "statement_id", "left")
    one = one.join(sources.select("file_id", "content"), "file_id", "left").withColumn("snippet", snippet(F.col("content"), F.col("at"), radius)).drop("content")
    one = one.join(called_by.select("method_id", F.slice("called_by", 1, 10).alias("callers"), "caller_count"), "method_id", "left")
    near = neighbours(logs, anchors, "service", 10, 10).groupBy("anchor_id").agg(F.sort_array(F.collect_list(F.struct("offset", "log_id"))).alias("neighbours"))
    same = trace(logs, anchors, 50).groupBy("anchor_id").agg(F.sort_array(F.collect_list(F.struct("place", "log_id"))).alias("trace"))
    return one.join(near.withColumnRenamed("anchor_id", "log_id"), "log_id", "left").join(same.withColumnRenamed("anchor_id", "log_id"), "log_id", "left")


def statistics(logs: DataFrame) -> DataFrame:
    """(dimension, value, n): the total, and counts by status, confidence, service and level, with exceptions and traces: one pass by grouping sets."""
    rows = logs.select("match.status", F.col("match.confidence_level").alias("confidence"), "service", "level", F.col("exception.class").isNotNull().alias("e"), F.col("trace_id").isNotNull().alias("t"))
    sets = rows.groupingSets([[], [F.col("status")], [F.col("confidence")], [F.col("service")], [F.col("level")]], F.col("status"), F.col("confidence"), F.col("service"), F.col("level"))
    g = sets.agg(F.grouping_id().alias("g"), F.count("*").alias("n"), F.count_if("e").alias("e"), F.count_if("t").alias("t"))
    name = F.when(F.col("g") == 15, "total").when(F.col("g") == 7, "status").when(F.col("g") == 11, "confidence").when(F.col("g") == 13, "service").otherwise("level")
    value = F.when(F.col("g") == 7, F.col("status")).when(F.col("g") == 11, F.col("confidence")).when(F.col("g") == 13, F.col("service")).when(F.col("g") == 14, F.col("level"))
    main = g.select(name.alias("dimension"), value.alias("value"), "n")
    total = g.where("g = 15").select(F.explode(F.array(F.struct(F.lit("with_exception").alias("dimension"), F.col("e").alias("n")), F.struct(F.lit("with_trace").alias("dimension"), F.col("t").alias("n")))).alias("x")).select("x.dimension", F.lit(None).cast("string").alias("value"), "x.n")
    return main.union(total)


def words_of(logs: DataFrame) -> DataFrame:
    """(log_id, token) for an index of messages."""
    return logs.select("log_id", F.explode(tokens(F.col("message"))).alias("token"))

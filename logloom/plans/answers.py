"""Queries over places in an order, the text index, and the choice of dependencies."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import tokens
from ..operators import deps, evaluate, links, prompt, reports, search, textindex, tokentop, views
from ..sources.scratch import new_folder, written
from .more_sql import ORACLE_SQL as _MORE
from .oracle import _J, _L, _TOKENS, ORACLE_SQL as _FIRST_SQL
from .queries import _judged, _logs, _sql

#: Queries by name: hyphens, groups, negation, prefixes and phrases.
ASKED = {"hyphen": "x-17", "group": "(failed | clicked) + item", "negated": "failed -clicked", "prefix": "acc* + twice", "phrase": '"order 1" | "created twice"', "joined": "user_id + -user + placed"}


def log_text_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All messages with the event's number after a hyphen, indexed in two batches and asked by way of the index."""
    logs = _logs(spark, sf_dir).withColumn("message", F.concat("message", F.lit(" (no-"), F.col("event_id").cast("string"), F.lit(") user_id")))
    logs = written(logs.select("log_id", "event_id", "message"), "messages")  # read by both batches and every query
    path = new_folder(spark, "index")
    for batch in (0, 1):
        textindex.add(logs.where(F.col("event_id") % 2 == batch), path, batch)
    index = textindex.read(spark, path)
    return reduce(DataFrame.union, [textindex.search_text(logs, index, q).select(F.lit(name).alias("query"), "event_id") for name, q in ASKED.items()])


def log_neighbour_scopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three neighbours a side of every 50th log, in all scopes."""
    needed = {"log_id", "event_id", *search.ORDER, *(c for by, _ in search.SCOPES.values() for c in by)}
    logs = written(_logs(spark, sf_dir).select(*sorted(needed)), "places")  # read by every scope, thrice each
    anchors = logs.where("event_id % 50 = 0").select("log_id")
    return reduce(DataFrame.union, [search.neighbours(logs, anchors, s, 3, 2).select(F.lit(s).alias("scope"), "anchor_id", "offset", "log_id") for s in search.SCOPES])


def log_traces_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first four logs of the traces of every 20th log, or why there are none."""
    logs = _logs(spark, sf_dir).withColumn("trace_id", F.when(F.col("event_id") % 60 == 0, " ").when(F.col("event_id") % 100 > 0, F.col("trace_id")))
    anchors = logs.where("event_id % 20 = 0").select("log_id")
    found = search.trace(logs, anchors, 4).withColumn("reason", F.lit(None).cast("string"))
    return found.unionByName(search.untraced(logs, anchors), allowMissingColumns=True)


def log_pages_with_nulls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second page of 40, up and down, of logs of which some lack times or sequences: the cursor is taken from the first page's end."""
    logs = _logs(spark, sf_dir).where("event_id % 10 < 3").withColumn("ts", F.when(F.col("event_id") % 3 == 0, F.col("ts"))).withColumn("sequence", F.when(F.col("event_id") % 4 == 0, F.col("sequence")))
    logs = logs.where("event_id < 200")
    out = None
    for order in ("asc", "desc"):
        cursor = search.page_end(logs, search.page(logs, 40, order), order).first().cursor
        more = search.page(logs, 40, order, cursor).select(F.lit(order).alias("page"), "event_id")
        out = more if out is None else out.union(more)
    return out


def _cover(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Customers as loggers of priorities; artifacts have classes by remainders of the customer's number; every 17th is the project's."""
    loggers = _sql(spark, sf_dir, "SELECT o_orderpriority AS service, concat(CASE WHEN o_custkey % 23 = 0 THEN 'host ' ELSE 'com.shop.C' END, cast(o_custkey AS string)) AS logger, o_custkey, count(*) AS n FROM orders GROUP BY 1, 2, 3", "orders")
    artifacts = F.filter(F.array(*[F.concat(F.lit(f"a{m}-"), (F.col("o_custkey") % m).cast("string")) for m in (7, 11, 13)]), lambda a: ~a.isin("a7-0", "a11-3", "a13-5"))
    classes = loggers.where("o_custkey % 23 > 0").select("service", "logger", F.explode(artifacts).alias("artifact"))
    return loggers.drop("o_custkey"), classes, loggers.where("o_custkey % 17 = 0").select("service", "logger")


def dependency_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deps.select_dependencies(*_cover(spark, sf_dir))


def dependency_choice_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the choice covers, as the report counts it."""
    loggers, classes, own = _cover(spark, sf_dir)
    states = deps.logger_states(loggers, classes, own, deps.select_dependencies(loggers, classes, own))
    return evaluate.logger_coverage(states).withColumn("percent", F.round("percent", 9))


def prompt_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What prompts of three levels hold, or why not, and how long they are, for every tenth log: documents as source files, customers as methods that call each other by orders."""
    logs = _logs(spark, sf_dir)
    frame = F.struct(F.lit("a.B").alias("class"), F.lit("c").alias("method"), F.lit("B.java").alias("file"), F.lit(1).alias("line"), (F.col("event_id") % 2 == 0).alias("in_project"), F.concat(F.lit("d"), (F.col("event_id") % 400).cast("string")).alias("file_id"))
    told = F.struct(F.lit("java.io.IOException").alias("class"), F.array(frame).alias("frames"), F.array().cast("array<struct<frames:array<struct<class:string,method:string,file:string,line:int,in_project:boolean,file_id:string>>>>").alias("caused_by"))
    logs = logs.withColumn("exception", F.when((F.col("service") == "error") & (F.col("event_id") % 9 > 0), told)).withColumn("raw", F.concat("message", F.lit("\njava.io.IOException: x\n\tat a.B.c(B.java:1)"))).withColumn("match", F.col("match").withField("confidence", F.lit(0.5)))
    logs = logs.withColumns({"logger": F.lit(None).cast("string"), "logger_raw": F.lit("com.shop.Web"), "timestamp_raw": F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")})
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    sources = docs.select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("file_id"), F.concat(F.lit("f"), F.col("doc_id").cast("string")).alias("file_path"), F.col("text").alias("content"))
    control = "struct(CASE WHEN id % 2 = 0 THEN array(struct('if' AS kind, 'x > 0' AS text, 2 AS line)) ELSE array() END AS conditions, cast(array() AS array<struct<text:string,line:int,exit_kind:string>>) AS early_exits, cast(array() AS array<struct<text:string,line:int>>) AS preceding, cast(array() AS array<struct<text:string,line:int>>) AS calls_before)"
    catalog = spark.sql(f"""SELECT concat('s', cast(id AS string)) AS statement_id, struct(CASE WHEN id = 4 THEN 'dependency' ELSE 'project' END AS type, 'shop' AS name, '1' AS version) AS code_unit, 'A.java' AS file_path, 1 AS line, 'a.A' AS class_fqn, 'run()' AS method_signature, 'x' AS template,
      concat('d', cast(id AS string)) AS file_id, CASE WHEN id <> 3 THEN concat('m', cast(id AS string)) END AS method_id, 1 AS method_start_line, 1 AS method_end_line, {control} AS control FROM range(0, 5)""")
    calls = _sql(spark, sf_dir, "SELECT concat('m', cast(o_custkey % 50 AS string)) AS method_id, concat('m', cast(o_custkey AS string)) AS caller, concat('c', cast(o_custkey AS string)) AS class_fqn FROM (SELECT DISTINCT o_custkey FROM orders)", "orders")
    calls = calls.groupBy("method_id").agg(F.collect_list(F.struct(F.col("caller").alias("method_id"), "class_fqn", F.lit("run").alias("method_name"), F.lit(1).alias("line"))).alias("called_by"))
    methods = _sql(spark, sf_dir, "SELECT concat('m', cast(c_custkey AS string)) AS method_id, concat('c', cast(c_custkey AS string)) AS class_fqn, 'run()' AS method_signature, 'C.java' AS file_path, concat('d', cast(c_custkey AS string)) AS file_id, 1 AS start_line, 1 AS end_line, cast(NULL AS array<string>) AS annotations FROM customer UNION ALL SELECT 'm0', 'c0', 'run()', 'C.java', 'd0', 1, 1, NULL", "customer").dropDuplicates(["method_id"]).join(calls, "method_id", "left")
    p = prompt.prompts_by_level(logs, logs.where("event_id % 10 = 0").select("log_id"), [0, 2, 4], written(catalog, "catalog"), sources, written(methods, "methods"))
    said = F.array_join(F.transform("sections", lambda s: F.concat(s.id, F.lit(":"), F.coalesce(s.reason, F.lit("+")))), " ")
    mark = "\n### Nivo "
    callers = ((F.length("text") - F.length(F.replace("text", F.lit(mark), F.lit("")))) / len(mark)).cast("int")
    return p.select("log_id", "level", said.alias("sections"), callers.alias("callers"), (F.length("text") == F.col("chars")).alias("counted"))


def document_neighbours_by_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every conversation's turns as messages the five documents of the corpus with the weightiest shared tokens."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.lit("all").alias("service"), F.col("doc_id").cast("string").alias("statement_id"), tokens(F.col("text")).alias("constant_tokens"))
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").where("text is not null")
    said = turns.select(F.concat_ws("-", "conv_id", "turn").alias("key"), F.lit("all").alias("service"), tokens(F.col("text")).alias("tokens"))
    found = tokentop.top_by_statements(written(said, "turns"), docs.where("statement_id is not null"), 5)
    return found.select("key", "statement_id", F.round("idf", 6).alias("idf"), "r")


#: Two projects, one without a repository of its own, and patterns of which the first that fits counts.
_PROJECTS = [links.Mapping("Brand#11", "https://git.example/a", "v{version}", "src/{file_path}"), links.Mapping("Brand#12", None, "main", "{file_path}"), links.Mapping("Brand#13", "https://git.example/c", None, "x")]
_LIBRARIES = [links.Mapping("org:Brand#2*", "https://git.example/{two}", "{artifactId}-{version}", "lib/{file_path}"), links.Mapping("org:Brand#3?", "https://no", "x", "x"), links.Mapping("*#3*", " ", "x", "x"), links.Mapping("*", "https://git.example/rest", "{version}", "{artifactId}/{file_path}")]


def _linked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as statements of their brands: project brands begin with 1, the others are dependencies."""
    p = spark.read.parquet(f"{sf_dir}/part.parquet")
    own = F.col("p_brand").startswith("Brand#1")
    unit = F.struct(F.when(own, "project").otherwise("dependency").alias("type"), F.when(own, F.col("p_brand")).otherwise(F.concat(F.lit("org:"), F.col("p_brand"))).alias("name"), F.col("p_size").cast("string").alias("version"))
    rows = p.select("p_partkey", unit.alias("code_unit"), F.concat(F.col("p_partkey").cast("string"), F.lit(".java")).alias("file_path"), F.col("p_size").alias("line"), (F.col("p_size") + F.col("p_partkey") % 2 * 4).cast("int").alias("end_line"))
    return rows.withColumn("link", F.when(F.col("p_partkey") % 3 == 0, links.link(_PROJECTS, _LIBRARIES, "https://git.example/remote")).when(F.col("p_partkey") % 3 == 1, "old"))


def refreshed_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the statements, a third of which have their link already, those whose link changes."""
    rows = _linked(spark, sf_dir)
    return links.refreshed(rows, links.link(_PROJECTS, _LIBRARIES, "https://git.example/remote")).select("p_partkey", "link")


def eval_breakdown_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.breakdown_places(_judged(spark, sf_dir), ["service", "level", "thread"]).select("dimension", "value", "events", "place")


def eval_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The levels of confidence as a Markdown table."""
    return reports.markdown_lines(evaluate.per_level(_judged(spark, sf_dir)).select("confidence_level", "events", "precision"), ["confidence_level"])


def log_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every log with all its columns: those that these logs have, and nulls with fields for the others."""
    d = views.log_detail(_logs(spark, sf_dir))
    absent = [F.col(c).isNull() for c in ("module", "pid", "code.version", "line_count", "ingested_at", "raw")]
    return d.select("log_id", "source_file", "sequence", "line_number", "thread", "level", "message", "trace_id", F.col("exception.class").alias("exception_class"), "match.status", "match.statement_id", F.col("ground_truth.reliable").alias("reliable"), F.array_join(F.transform(F.array(*absent), lambda x: x.cast("string")), " ").alias("absent"), F.lit(len(d.columns)).alias("width"))


QUERIES = {f.__name__: f for f in (log_details, log_text_index, log_neighbour_scopes, log_traces_cut, log_pages_with_nulls, dependency_choice, dependency_choice_coverage, prompt_sections, document_neighbours_by_tokens, refreshed_links, eval_breakdown_places, eval_markdown)}

_PLACES = """SELECT '{scope}' AS scope, log_id, event_id, {key} AS k, row_number() OVER (PARTITION BY {key} ORDER BY {order}) AS n FROM l"""
_SCOPES = " UNION ALL ".join(_PLACES.format(scope=s, key=k, order=o) for s, k, o in (("service", "source_file", "sequence"), ("thread", "concat(service, '|', thread)", "ts, sequence, log_id"), ("dataset", "dataset_id", "ts, sequence, log_id")))

_COVER = """WITH RECURSIVE g AS (SELECT o_orderpriority AS service, concat(CASE WHEN o_custkey % 23 = 0 THEN 'host ' ELSE 'com.shop.C' END, cast(o_custkey AS varchar)) AS logger, o_custkey AS c, count(*) AS n FROM orders GROUP BY 1, 2, 3),
  o AS (SELECT *, list_filter([concat('a7-', c % 7), concat('a11-', c % 11), concat('a13-', c % 13)], lambda a: NOT list_contains(['a7-0', 'a11-3', 'a13-5'], a)) AS owners FROM g WHERE c % 23 > 0),
  v AS (SELECT service, logger, n, owners, unnest(owners) AS artifact FROM o WHERE c % 17 > 0),
  r(service, done, artifact, hits, place) AS (SELECT DISTINCT service, cast([] AS varchar[]), cast(NULL AS varchar), cast(0 AS bigint), cast(0 AS integer) FROM g
    UNION ALL SELECT service, list_append(done, artifact), artifact, hits, place + 1 FROM (SELECT r.service, r.done, r.place, v.artifact, cast(sum(v.n) AS bigint) AS hits, row_number() OVER (PARTITION BY r.service ORDER BY sum(v.n) DESC, v.artifact) AS p
      FROM r JOIN v ON v.service = r.service WHERE NOT list_has_any(v.owners, r.done) GROUP BY r.service, r.done, r.place, v.artifact) WHERE p = 1)"""

#: Tokens in order of their first occurrence.
_FIRST = _TOKENS.replace("list_distinct(", "(")

ORACLE_SQL = {
    "log_details": f"""{_L} SELECT log_id, source_file, sequence, cast(sequence + 1 AS integer) AS line_number, thread, level, message, trace_id, CASE WHEN service = 'error' AND event_id % 9 > 0 THEN 'java.io.IOException' END AS exception_class,
      status, CASE WHEN status <> 'unmatched' THEN predicted END AS statement_id, event_id % 5 > 0 AS reliable, 'true true true true true true' AS absent, 27 AS width FROM l""",
    "log_text_index": _MORE["log_text_search"],
    "log_neighbour_scopes": f"{_L}, p AS ({_SCOPES}) SELECT a.scope, a.log_id AS anchor_id, cast(b.n - a.n AS integer) AS \"offset\", b.log_id FROM p a JOIN p b ON a.scope = b.scope AND a.k = b.k AND b.n BETWEEN a.n - 3 AND a.n + 2 AND b.n <> a.n WHERE a.event_id % 50 = 0",
    "log_traces_cut": f"""{_L}, t AS (SELECT *, CASE WHEN event_id % 60 = 0 THEN NULL WHEN event_id % 100 > 0 THEN trace_id END AS tr FROM l), p AS (SELECT *, row_number() OVER (PARTITION BY tr ORDER BY ts, sequence, log_id) AS place FROM t WHERE tr IS NOT NULL)
      SELECT a.log_id AS anchor_id, cast(p.place AS integer) AS place, p.log_id, CASE WHEN a.tr IS NULL THEN 'no-trace-id' END AS reason FROM t a LEFT JOIN p ON p.tr = a.tr AND p.place <= 4 WHERE a.event_id % 20 = 0""",
    "log_pages_with_nulls": f"""{_L}, t AS (SELECT event_id, log_id, CASE WHEN event_id % 3 = 0 THEN ts END AS ts, CASE WHEN event_id % 4 = 0 THEN sequence END AS sequence FROM l WHERE event_id % 10 < 3 AND event_id < 200)
      SELECT 'asc' AS page, event_id FROM (SELECT event_id, row_number() OVER (ORDER BY ts NULLS LAST, sequence NULLS LAST, log_id) AS n FROM t) WHERE n BETWEEN 41 AND 80
      UNION ALL SELECT 'desc', event_id FROM (SELECT event_id, row_number() OVER (ORDER BY ts DESC NULLS LAST, sequence DESC NULLS LAST, log_id DESC) AS n FROM t) WHERE n BETWEEN 41 AND 80""",
    "prompt_sections": f"""{_L}, a AS (SELECT *, CASE WHEN status = 'unmatched' THEN NULL ELSE cast(substring(predicted, 2) AS integer) END AS s, service = 'error' AND event_id % 9 > 0 AS e FROM l WHERE event_id % 10 = 0), v AS (SELECT unnest([0, 2, 4]) AS lv),
      c AS (SELECT o_custkey % 50 AS k, least(5, count(DISTINCT o_custkey)) AS n FROM orders WHERE o_custkey >= 50 GROUP BY 1), d AS (SELECT doc_id, text <> '' AS shown FROM documents WHERE text IS NOT NULL), near AS (SELECT source_file, count(*) AS logs FROM l GROUP BY 1),
      w AS (SELECT a.*, lv, coalesce(c.n, 0) AS n, CASE WHEN s IS NULL THEN 'unmatched' WHEN s > 4 THEN 'unavailable' END AS why, d.shown IS NOT NULL AS has_file, f.shown IS NOT NULL AS has_frame, logs FROM a CROSS JOIN v LEFT JOIN c ON c.k = s AND s < 3 LEFT JOIN d ON d.doc_id = s LEFT JOIN d f ON f.doc_id = event_id % 400 LEFT JOIN near USING (source_file))
      SELECT log_id, cast(lv AS integer) AS level, concat_ws(' ', 'log:+', concat('exception:', CASE WHEN e THEN '+' ELSE 'noException' END), concat('statement:', CASE WHEN lv < 1 THEN 'level' ELSE coalesce(why, '+') END), concat('method:', CASE WHEN lv < 1 THEN 'level' ELSE coalesce(why, CASE WHEN has_file THEN '+' ELSE 'unavailable' END) END),
        concat('flow:', CASE WHEN lv < 2 THEN 'level' ELSE coalesce(why, CASE WHEN s % 2 = 0 THEN '+' ELSE 'noControl' END) END), concat('stackCode:', CASE WHEN lv < 2 THEN 'level' WHEN NOT e THEN 'noException' WHEN event_id % 2 = 1 THEN 'noProjectFrames' WHEN has_frame THEN '+' ELSE 'unavailable' END),
        concat('callers:', CASE WHEN lv < 3 THEN 'level' ELSE coalesce(why, CASE WHEN s = 4 THEN 'library' WHEN s = 3 THEN 'unavailable' WHEN n = 0 THEN 'noCallers' ELSE '+' END) END), concat('neighbors:', CASE WHEN lv < 4 THEN 'level' WHEN logs > 1 THEN '+' ELSE 'noNeighbors' END)) AS sections,
        cast(CASE WHEN lv < 3 OR why IS NOT NULL THEN 0 ELSE n END AS integer) AS callers, true AS counted FROM w""",
    "document_neighbours_by_tokens": f"""WITH d AS (SELECT cast(doc_id AS varchar) AS statement_id, unnest({_TOKENS}) AS token FROM documents), n AS (SELECT token, ln((SELECT count(*) FROM documents) / count(*)::double) AS idf FROM d GROUP BY 1),
      w AS (SELECT concat_ws('-', conv_id, turn) AS key, t AS ts, unnest(t) AS token FROM (SELECT conv_id, turn, {_TOKENS} AS t FROM conversations WHERE text IS NOT NULL)),
      p AS (SELECT key, statement_id, sum(idf) AS idf, min(list_position(o, token)) AS first FROM (SELECT w.key, w.token, x.o FROM w JOIN (SELECT concat_ws('-', conv_id, turn) AS key, {_FIRST} AS o FROM conversations WHERE text IS NOT NULL) x USING (key)) JOIN n USING (token) JOIN d USING (token) GROUP BY 1, 2),
      r AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY round(idf, 9) DESC, first, statement_id) AS r FROM p) SELECT key, statement_id, round(idf, 6) AS idf, cast(r AS integer) AS r FROM r WHERE r <= 5""",
    "refreshed_links": """WITH p AS (SELECT p_partkey, p_brand AS b, cast(p_size AS varchar) AS v, concat(p_partkey, '.java') AS f, concat('#L', p_size, CASE WHEN p_partkey % 2 = 1 THEN concat('-L', p_size + 4) ELSE '' END) AS a FROM part),
      l AS (SELECT p_partkey, CASE WHEN b = 'Brand#11' THEN concat('https://git.example/a/blob/v', v, '/src/', f, a) WHEN b = 'Brand#12' THEN concat('https://git.example/remote/blob/main/', f, a) WHEN b LIKE 'Brand#1%' THEN NULL WHEN b LIKE 'Brand#2%' THEN concat('https://git.example/{two}/blob/', b, '-', v, '/lib/', f, a)
        WHEN b LIKE '%#3%' THEN NULL ELSE concat('https://git.example/rest/blob/', v, '/', b, '/', f, a) END AS link FROM p) SELECT p_partkey, link FROM l WHERE p_partkey % 3 = 1 OR (p_partkey % 3 = 2 AND link IS NOT NULL)""",
    "eval_breakdown_places": f"""{_J}, d AS (SELECT 'service' AS dimension, service AS value FROM j UNION ALL SELECT 'level', level FROM j UNION ALL SELECT 'thread', thread FROM j), n AS (SELECT dimension, value, count(*) AS events FROM d GROUP BY 1, 2)
      SELECT dimension, value, events, cast(row_number() OVER (PARTITION BY dimension ORDER BY events DESC, value) AS integer) AS place FROM n""",
    "eval_markdown": f"""WITH q AS ({_FIRST_SQL["eval_per_level"]}), r AS (SELECT row_number() OVER (ORDER BY confidence_level) + 1 AS n, concat('| ', confidence_level, ' | ', events, ' | ', coalesce(printf('%.4f', precision), ''), ' |') AS line FROM q)
      SELECT 0 AS n, '| confidence_level | events | precision |' AS line UNION ALL SELECT 1, '| --- | --- | --- |' UNION ALL SELECT cast(n AS integer), line FROM r""",
    "dependency_choice": f"{_COVER} SELECT service, place, artifact, hits FROM r WHERE place > 0",
    "dependency_choice_coverage": """WITH g AS (SELECT DISTINCT o_custkey AS c FROM orders), s AS (SELECT c % 23 = 0 AND c % 17 > 0 AS excluded, c % 17 = 0 OR (c % 23 > 0 AND NOT (c % 7 = 0 AND c % 11 = 3 AND c % 13 = 5)) AS mapped FROM g),
      n AS (SELECT count(*) AS loggers, count(*) FILTER (excluded AND NOT mapped) AS excluded, count(*) FILTER (mapped) AS mapped, count(*) FILTER (NOT mapped AND NOT excluded) AS unmapped FROM s)
      SELECT *, loggers - excluded AS eligible, CASE WHEN loggers = excluded THEN 100.0::double ELSE round(100.0::double * mapped / (loggers - excluded), 9) END AS percent FROM n""",
}

"""Queries over the star-schema tables that apply every operator to the whole of its table."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text
from ..operators import assemble, catalog, evaluate, labels, match, meta, search
from ..sources.formats import json_lines, logback, spring_boot
from .derive import LOGS, PLACED_LOGS, STATEMENTS


def _sql(spark: SparkSession, sf_dir: str, query: str, *tables: str) -> DataFrame:
    for t in tables:
        query = re.sub(rf"\b(FROM|JOIN) {t}\b", rf"\1 {{{t}}}", query)
    return spark.sql(query, **{t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in tables})


#: Fixed value: a stretch of event ids, numbered by one task.
STRETCH = 1 << 16


def _placed_events(events: DataFrame) -> DataFrame:
    """``events`` with ``place``, from 0, in their type by event_id: the places in a stretch of ids, after the counts of the stretches before it, so that a type is numbered by many tasks."""
    events = events.withColumn("stretch", F.floor(F.col("event_id") / STRETCH))
    counts = events.groupBy("event_type", "stretch").agg(F.count("*").alias("c"))
    before = counts.select(F.col("event_type").alias("t"), F.col("stretch").alias("s"), (F.sum("c").over(Window.partitionBy("event_type").orderBy("stretch")) - F.col("c")).alias("before"))
    own = F.row_number().over(Window.partitionBy("event_type", "stretch").orderBy("event_id"))
    rows = events.withColumn("own", own).join(F.broadcast(before), F.col("event_type").eqNullSafe(F.col("t")) & F.col("stretch").eqNullSafe(F.col("s")))
    return rows.withColumn("place", F.col("before") + F.col("own") - 1).drop("stretch", "t", "s", "before", "own")


def _logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The derived logs as enriched logs."""
    rows = spark.sql(PLACED_LOGS, events=_placed_events(spark.read.parquet(f"{sf_dir}/events.parquet")))
    place = text.log_id(F.col("dataset_id"), F.col("source_file"), F.col("sequence") + 1)
    shown = F.when(F.col("status") != "unmatched", F.col("predicted"))
    candidates = F.transform(F.array(F.col("predicted"), F.concat(F.lit("s"), ((F.substring("predicted", 2, 9).cast("long") + 1) % 7).cast("string"))), lambda s, i: F.struct(s.alias("statement_id"), (F.lit(0.9) - i * 0.2).alias("score")))
    return rows.select(place.alias("log_id"), "*", F.when(F.col("service") == "error", F.struct(F.when(F.col("event_id") % 9 > 0, F.lit("java.io.IOException")).alias("class"))).alias("exception"), F.struct("status", shown.alias("statement_id"), F.col("confidence").alias("confidence_level"), candidates.alias("candidates")).alias("match"), F.struct((F.col("event_id") % 5 > 0).alias("reliable")).alias("ground_truth"), (F.col("sequence") + 1).cast("int").alias("line_number"))


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw lines: a header for each event, and a class line, two frames, a cause and its frame for errors."""
    rows = spark.sql(PLACED_LOGS, events=_placed_events(spark.read.parquet(f"{sf_dir}/events.parquet")))
    pad = lambda c, n: F.rpad(F.substring(c, 1, n), n, " ")
    head = F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSS"), F.lit("Z "), F.lpad("level", 5, " "), F.lit(" 1 --- ["), pad(F.col("thread"), 15), F.lit("] "), pad(F.concat(F.lit("com.shop."), F.col("service")), 40), F.lit(" : "), F.col("message"))
    more = [F.concat(F.lit("java.lang.IllegalStateException: user "), F.col("thread")), F.lit("\tat com.shop.web.ErrorAdvice.handle(ErrorAdvice.java:50)"), F.lit("\tat java.base/java.lang.Thread.run(Thread.java:1)"), F.lit("Caused by: java.io.IOException: closed"), F.lit("\tat com.shop.io.Pipe.read(Pipe.java:7) ~[na:na]")]
    own = F.when(F.col("service") == "error", F.array(head, *more)).otherwise(F.array(head))
    # all events of a file have equally many lines
    return rows.withColumn("own", own).select("dataset_id", "source_file", "sequence", F.size("own").alias("n"), F.posexplode("own").alias("k", "text")).select("dataset_id", "source_file", (F.col("sequence") * F.col("n") + F.col("k") + 1).cast("int").alias("line_no"), "text")


def event_assembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = assemble.assemble(_lines(spark, sf_dir), spring_boot)
    return e.select("source_file", "line_number", "line_count", "sequence", F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSS").alias("ts"), "level", "pid", "thread", "logger_raw", "message", F.col("exception.class").alias("exception_class"), F.col("exception.root_class").alias("root_class"), F.coalesce(F.size("exception.frames"), F.lit(0)).cast("int").alias("frames"), F.col("exception.frames")[0]["line"].alias("first_frame_line"), "log_id")


def logback_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _sql(spark, sf_dir, LOGS, "events").select("event_id", F.concat(F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSS"), F.lit(" "), F.rpad("level", 5, " "), F.lit(" ["), F.col("thread"), F.lit("] com.shop."), F.col("service"), F.lit(" - "), F.col("message")).alias("line"))
    h = rows.withColumn("h", logback("%d{yyyy-MM-dd HH:mm:ss.SSS} %-5level [%thread] %logger{36} - %msg%n")(F.col("line")))
    return h.select("event_id", F.date_format("h.instant", "yyyy-MM-dd HH:mm:ss.SSS").alias("ts"), "h.level", "h.thread", "h.logger_raw", "h.message")


def json_log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _sql(spark, sf_dir, LOGS, "events").select("event_id", F.to_json(F.struct(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias("@timestamp"), F.lower("level").alias("level"), F.array("message", "thread").alias("message"), F.col("service").alias("logger_name"))).alias("line"))
    h = rows.withColumn("h", json_lines({"timestamp": "@timestamp", "message": "message", "level": "level", "logger": "logger_name"})(F.col("line")))
    return h.select("event_id", F.date_format("h.instant", "yyyy-MM-dd HH:mm:ss.SSS").alias("ts"), "h.level", "h.logger_raw", "h.message")


def _catalog(spark: SparkSession) -> tuple[DataFrame, DataFrame, DataFrame]:
    unit = F.struct(F.lit("project").alias("type"), F.lit("shop").alias("name"), F.lit("1").alias("version"))
    s = spark.sql(STATEMENTS).select("*", unit.alias("code_unit"), F.lit("m").alias("module"), F.col("class_fqn").alias("logger_name"), F.lit("class_literal").alias("logger_name_kind"), F.lit("run").alias("method_name"), F.lit("A.java").alias("file_path"), F.lit(False).alias("level_dynamic"), F.lit(False).alias("has_throwable_arg"))
    modules = s.select(F.lit("m").alias("module"), "service", F.array().cast("array<string>").alias("selected_dependencies")).distinct()
    types = s.select(F.col("class_fqn").alias("type_id"), "code_unit", "module", "class_fqn", F.col("class_fqn").alias("class_binary"), F.lit(None).cast("string").alias("superclass_fqn")).distinct()
    return s, modules, types


def match_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, modules, types = _catalog(spark)
    short = F.create_map(*[F.lit(x) for x in ("click", "c.s.w.ClickController", "view", "c.s.w.PageController", "purchase", "c.s.o.OrderService", "error", "c.s.w.ErrorAdvice", "signup", "c.s.a.AccountService")])
    logs = _sql(spark, sf_dir, LOGS, "events").select("event_id", "service", short[F.col("service")].alias("logger_raw"), "level", "message", F.lit(False).alias("has_exception"))
    m = match.match(logs, s, modules, types, cached=[])
    return m.select("event_id", "match.status", "match.statement_id", F.round("match.confidence", 6).alias("confidence"), "match.confidence_level", F.array_join("match.args", "|").alias("args"), F.size("match.candidates").alias("candidates"), "logger")


def log_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.statistics(_logs(spark, sf_dir))


def ingest_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return meta.ingest_report(_logs(spark, sf_dir), 2000)


def log_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = search.search(_logs(spark, sf_dir), q="failed + -created", service=["error", "signup"], since="2024-01-02 00:00:00")
    first = search.page(found, 50, "desc").select("ts", "sequence", "log_id")
    last = first.orderBy("ts", "sequence", "log_id").limit(1).collect()
    cursor = search.encode_cursor([last[0].ts, last[0].sequence, last[0].log_id]) if last else None
    return search.page(found, 50, "desc", cursor).select("event_id", "log_id", "sequence", "level")


def log_adjacent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.adjacent(_logs(spark, sf_dir))


def log_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    logs = _logs(spark, sf_dir)
    return search.neighbours(logs, logs.select("log_id"), "thread", 2, 2)


def log_trace_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    logs = _logs(spark, sf_dir)
    first = logs.groupBy("trace_id").agg(F.min("log_id").alias("log_id")).select("log_id")
    return search.trace(logs, first, 200)


def candidate_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = spark.sql("SELECT concat('s', cast(id AS string)) AS statement_id, concat('c', cast(id AS string)) AS class_fqn, cast(id * 10 AS int) AS line, 'x' AS template FROM range(0, 5)")
    return search.candidate_details(_logs(spark, sf_dir), known).select("log_id", "place", "statement_id", F.round("score", 3).alias("score"), "class_fqn", "line")


def level_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _sql(spark, sf_dir, "SELECT o_orderkey, CASE o_orderkey % 9 WHEN 0 THEN 'finest' WHEN 1 THEN ' Fine ' WHEN 2 THEN 'FINER' WHEN 3 THEN 'config' WHEN 4 THEN 'Warning' WHEN 5 THEN 'SEVERE' WHEN 6 THEN 'error' WHEN 7 THEN 'notice' END AS raw FROM orders", "orders")
    level = text.normal_level(F.col("raw"))
    return rows.select("o_orderkey", level.alias("level"), text.compatible_level(level, F.lit("FATAL")).alias("like_fatal"))


def token_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").withColumn("t", text.tokens(F.col("text")))
    return rows.select("doc_id", F.size("t").cast("long").alias("n"), F.md5(F.array_join(F.array_sort("t"), " ")).alias("digest"))


def token_idf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """IDF of tokens by source, each document standing for a statement."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").cast("string").alias("statement_id"), F.col("source").alias("service"), text.tokens(F.col("text")).alias("constant_tokens"))
    return catalog.token_weights(docs.select("statement_id", "constant_tokens"), docs.select("service", "statement_id")).withColumn("idf", F.round("idf", 9))


def stable_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sql(spark, sf_dir, "SELECT l_orderkey, l_linenumber, l_returnflag, nullif(l_linestatus, 'O') AS s FROM lineitem", "lineitem").select("l_orderkey", "l_linenumber", text.stable_id(F.lit("log"), "l_returnflag", "s", "l_orderkey", "l_linenumber").alias("id"))


def snippets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return docs.select("doc_id", F.md5(text.snippet(F.col("text"), F.lit(3), 2)).alias("around_three"), text.numbered(text.line_range(F.col("text"), F.lit(2), F.lit(2)), F.lit(2)).alias("second"))


def one_line_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", text.one_line(F.col("text"), 40).alias("line"))


def source_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = spark.read.parquet(f"{sf_dir}/part.parquet")
    c = lambda x: F.lit(x)
    repo = F.when(F.col("p_size") % 4 == 0, F.lit("")).otherwise(F.lit("https://example.org/r"))
    return p.select("p_partkey", text.source_link(repo, c("v{version}"), c("src/{file_path}"), F.col("p_size").cast("string"), F.col("p_brand"), F.col("p_size"), F.col("p_size") + F.when(F.col("p_size") % 2 == 0, 0).otherwise(3)).alias("link"))


def logger_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers' cities as packages: every nation's name, shortened, against all full names."""
    names = _sql(spark, sf_dir, "SELECT r_name AS service, concat('com.', lower(replace(n_name, ' ', '')), '.svc.', 'Handler', cast(n_nationkey % 3 AS string)) AS name FROM nation JOIN region ON n_regionkey = r_regionkey", "nation", "region")
    raw = names.select("service", F.explode(F.array(F.col("name"), F.regexp_replace("name", r"^com\.(.)[^.]*\.svc", "c.$1.s"), F.substring(F.col("name"), F.length("name") - 12, F.lit(13)), F.lit("other.Thing"))).alias("logger_raw"))
    return match.resolve_loggers(raw, names).select("service", "logger_raw", "kind", F.array_join("names", ",").alias("names"))


def _judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    logs = _logs(spark, sf_dir)
    truth = logs.select("log_id", F.col("truth_state").alias("state"), F.when(F.col("truth_state") == "known", F.array("truth")).otherwise(F.array().cast("array<string>")).alias("ids"))
    return evaluate.judged(logs, truth)


def eval_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = evaluate.metrics(_judged(spark, sf_dir))
    return m.select(*[F.round(c, 9).alias(c) if t == "double" else F.col(c) for c, t in m.dtypes])


def eval_per_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.per_level(_judged(spark, sf_dir)).withColumn("precision", F.round("precision", 9))


def eval_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.breakdown(_judged(spark, sf_dir), ["service", "level", "confidence"])


def eval_top_threads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.top_and_others(_judged(spark, sf_dir), "thread", 15, "(other threads)")


def eval_statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.per_statement(_judged(spark, sf_dir))


def eval_unique_statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = evaluate.unique_statements(evaluate.per_statement(_judged(spark, sf_dir)))
    return u.select(*[F.round(c, 9).alias(c) if t == "double" else F.col(c) for c, t in u.dtypes])


def eval_error_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.error_kinds(_judged(spark, sf_dir)).select("predicted", "truth_key", "n", "log_id")


def ground_truth_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as places in files of their suppliers, parts' sizes as ranges of lines."""
    logs = _sql(spark, sf_dir, "SELECT concat(cast(l_orderkey AS string), '-', cast(l_linenumber AS string), '-', cast(l_partkey AS string), '-', cast(l_suppkey AS string), '-', cast(cast(l_quantity AS int) AS string)) AS log_id, cast(l_suppkey % 5 AS string) AS service, cast(floor(l_partkey / 20) AS string) AS class, cast(l_quantity AS int) AS line FROM lineitem", "lineitem")
    logs = logs.select("log_id", "service", F.struct(F.lit(None).cast("string").alias("statement_id")).alias("match"), F.struct("class", "line", F.lit(True).alias("reliable")).alias("ground_truth")).distinct()
    said = _sql(spark, sf_dir, "SELECT cast(p_partkey % 5 AS string) AS service, cast(floor(p_partkey / 20) AS string) AS class_fqn, cast(p_partkey AS string) AS statement_id, p_size AS line, p_size + 9 AS end_line FROM part", "part")
    none = spark.createDataFrame([], "log_id string, verdict string, correct_statement_id string, predicted_statement_id string")
    t = evaluate.truths(logs, said, none)
    return t.select("log_id", "state", F.array_join("ids", "+").alias("truth_key"))


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = """SELECT concat('d', cast(doc_id % 97 AS string)) AS log_id, 'ev' AS dataset_id, CASE WHEN doc_id % 10 = 9 THEN NULL WHEN toxic = 1 THEN 'not_in_catalog' WHEN quality = 1 THEN 'correct' ELSE 'incorrect' END AS verdict,
      doc_id AS labeled_at FROM labels"""
    return _sql(spark, sf_dir, q, "labels")


def labels_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labels.latest(labels.checked(_labels(spark, sf_dir)))


def review_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    logs = _logs(spark, sf_dir).withColumn("log_id", F.concat(F.lit("d"), F.col("event_id").cast("string")))
    return labels.to_review(logs, _labels(spark, sf_dir)).select("log_id", "status", "confidence")


def class_ancestors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as classes, each below the part of half its number."""
    types = _sql(spark, sf_dir, "SELECT cast(p_partkey AS string) AS class_fqn, cast(p_partkey AS string) AS type_id, nullif(cast(floor(p_partkey / 2) AS bigint), 0) AS up FROM part", "part").select("class_fqn", "type_id", F.col("up").cast("string").alias("superclass_fqn"))
    return catalog.ancestors(types)


def _edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sql(spark, sf_dir, "SELECT cast(o_custkey AS string) AS caller_id, cast(o_custkey % 50 AS string) AS target_id, cast(o_orderkey % 100 AS int) AS line FROM orders", "orders")


def method_reverse_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.reverse_edges(_edges(spark, sf_dir)).select("method_id", "caller_count", F.col("called_by")[0]["method_id"].alias("first_caller"), F.col("called_by")[0]["line"].alias("first_line"))


def method_callers(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _edges(spark, sf_dir)
    return catalog.callers(e, e.select(F.col("target_id").alias("root")).distinct(), 2, 5, 12)


def interface_implementors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers are classes, nations interfaces, regions interfaces above them."""
    types = _sql(spark, sf_dir, """SELECT s_name AS class_fqn, s_name AS type_id, array(n_name) AS interfaces, cast(NULL AS string) AS superclass_fqn, 'class' AS kind FROM supplier JOIN nation ON s_nationkey = n_nationkey
      UNION ALL SELECT n_name, n_name, array(concat('R ', r_name)), NULL, 'interface' FROM nation JOIN region ON n_regionkey = r_regionkey UNION ALL SELECT concat('R ', r_name), r_name, NULL, NULL, 'interface' FROM region""", "supplier", "nation", "region")
    return catalog.implementors(types)


def dependency_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as statements of their brands, the larger ones supported."""
    p = spark.read.parquet(f"{sf_dir}/part.parquet")
    return meta.dependency_report(p.select(F.col("p_brand").alias("artifact"), (F.col("p_size") > 25).alias("supported")))


def datasets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return meta.dataset_services(_logs(spark, sf_dir))


def eval_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With equal scores of both candidates in every fourth log."""
    rows = _judged(spark, sf_dir)
    even = F.transform("match.candidates", lambda c: c.withField("score", F.lit(0.9)))
    rows = rows.withColumn("match", F.col("match").withField("candidates", F.when(F.col("event_id") % 4 == 0, even).otherwise(F.col("match.candidates"))))
    n = evaluate.score_counts(rows)
    return n.select(*[F.round(c, 9).alias(c) if t == "double" else F.col(c) for c, t in n.dtypes])


def eval_report_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.csv_ready(evaluate.per_level(_judged(spark, sf_dir)))


def logger_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Market segments of nations as loggers, customers as what modules say of them."""
    rows = _sql(spark, sf_dir, "SELECT concat(c_mktsegment, cast(c_nationkey AS string)) AS logger, CASE WHEN c_custkey % 50 = 0 THEN 'mapped' WHEN c_nationkey % 4 = 0 THEN 'excluded' ELSE 'unmapped' END AS state FROM customer", "customer")
    n = evaluate.logger_coverage(rows)
    return n.withColumn("percent", F.round("percent", 9))


def call_site_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as call sites of their customers, finished orders as the customers' edges."""
    sites = _sql(spark, sf_dir, "SELECT o_orderkey AS statement_id, o_custkey AS method_id, cast(o_orderkey % 5 AS int) AS line, o_orderpriority AS text, cast(NULL AS string) AS target_method_id, false AS resolved FROM orders", "orders")
    edges = _sql(spark, sf_dir, "SELECT o_custkey AS method_id, o_orderkey AS place, cast(o_orderkey % 5 AS int) AS line, o_orderpriority AS text, CASE WHEN o_orderkey % 3 > 0 THEN concat('m', cast(o_orderkey AS string)) END AS target_method_id, o_orderkey % 3 > 0 AS resolved FROM orders WHERE o_orderstatus = 'F'", "orders")
    return catalog.resolved_sites(sites, edges)


def focus_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines 2 to 40 of every text, or five about the third."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").withColumn("w", text.focus_window(F.col("text"), F.lit(2), F.lit(40), F.lit(3), 6, 2))
    return docs.select("doc_id", "w.first", F.md5("w.text").alias("digest"), "w.cut_before", "w.cut_after")


def stack_trace_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text as a raw event whose exception's class is how its third line starts."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    name = F.substring(F.get(F.split("text", r"\r\n|\r|\n", -1), F.lit(2)), 1, 5)
    return docs.select("doc_id", F.md5(text.stack_trace_text(F.col("text"), name, 4)).alias("digest"))


def clock_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _sql(spark, sf_dir, LOGS, "events").select("event_id", "ts")
    iso = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSS")
    behind = F.date_format(F.col("ts") + F.expr("interval -210 minutes"), "yyyy-MM-dd HH:mm:ss,SSS")
    raw = F.element_at(F.array(F.concat(iso, F.lit("Z")), F.concat(iso, F.lit("+02:00")), F.concat(iso, F.lit("-03:30")), behind, F.lit("noon"), F.lit("2001-01-01 00:00:00")), (F.col("event_id") % 6 + 1).cast("int"))
    return rows.select("event_id", text.clock_offset(raw, F.col("ts")).alias("seconds"))


QUERIES = {f.__name__: f for f in (event_assembly, logback_lines, json_log_lines, match_logs, log_statistics, ingest_report, log_page, log_adjacent, log_neighbours, log_trace_places, candidate_details, level_normalise, token_sets, token_idf, stable_ids, snippets, one_line_texts, source_links, logger_resolution, eval_metrics, eval_per_level, eval_breakdown, eval_top_threads, eval_statements, eval_unique_statements, eval_error_kinds, ground_truth_places, labels_latest, review_candidates, class_ancestors, method_reverse_edges, method_callers, interface_implementors, dependency_rollup, datasets, eval_score, eval_report_rows, logger_coverage, call_site_edges, focus_windows, stack_trace_texts, clock_offsets)}

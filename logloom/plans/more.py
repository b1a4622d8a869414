"""Queries that apply the operators on views, metadata, search and matching's rarer branches to the whole of their tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import catalog, enrich, evaluate, labels, match, meta, search, views
from .queries import _edges, _judged, _labels, _logs, _sql


def log_text_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hyphens, groups, negation, prefixes and phrases, each over all messages with the event's number after a hyphen."""
    logs = _logs(spark, sf_dir).withColumn("message", F.concat("message", F.lit(" (no-"), F.col("event_id").cast("string"), F.lit(") user_id")))
    asked = {"hyphen": "x-17", "group": "(failed | clicked) + item", "negated": "failed -clicked", "prefix": "acc* + twice", "phrase": '"order 1" | "created twice"', "joined": "user_id + -user + placed"}
    # all queries in one pass over the words of a message
    met = F.filter(F.array(*[F.when(search.text_query(q, F.col("message"), F.col("words")), name) for name, q in asked.items()]), lambda x: x.isNotNull())
    return logs.select("event_id", "message", search.terms_of(F.col("message")).alias("words")).select(F.explode(met).alias("query"), "event_id")


def log_exceptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    logs = _logs(spark, sf_dir)
    with_, without = (search.search(logs, has_exception=x, service=["error", "view"], trace="t7").select(F.lit(x).alias("has_exception"), "event_id") for x in (True, False))
    return with_.union(without)


def log_page_end(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = search.search(_logs(spark, sf_dir), level=["ERROR"])
    e = search.page_end(found, search.page(found, 20, "asc"), "asc")
    return e.select("total", F.from_json(F.unbase64("cursor").cast("string"), "array<string>")[2].alias("last_id"))


def log_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    logs = _logs(spark, sf_dir).withColumn("logger_raw", F.lit(None).cast("string")).withColumn("match", F.col("match").withField("confidence", F.lit(0.5)).withField("class_fqn", F.col("service")).withField("method_name", F.lit("run")).withField("line", F.lit(3)))
    return views.log_summary(logs.withColumn("message", F.repeat("message", 40))).select("log_id", F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSS").alias("ts"), "service", "level", "thread", F.md5("message").alias("digest"), "status", "confidence", "has_exception", "class_fqn", "line")


def method_callers_known(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _edges(spark, sf_dir).where("caller_id <> target_id").withColumn("line", F.col("line") % 2)
    methods = e.select(F.col("caller_id").alias("method_id"), F.concat(F.lit("c"), "caller_id").alias("class_fqn"), F.lit("run").alias("method_name"), F.lit(None).cast("array<string>").alias("annotations")).distinct()
    return views.callers_of(views.method_detail(methods), catalog.reverse_edges(e)).select("method_id", "place", "caller_id", "line", "class_fqn", F.size("annotations").alias("annotations"), "caller_count")


def source_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as files of their brands; every third one is there."""
    from ..functions.text import stable_id

    p = _sql(spark, sf_dir, "SELECT p_brand AS code_unit, cast(p_size AS string) AS version, p_name AS path, p_partkey FROM part", "part")
    there = p.where("p_partkey % 3 = 0").select(stable_id(F.lit("file"), "code_unit", "version", "path").alias("file_id"))
    return views.find_sources(p.select("code_unit", "version", "path").distinct(), there)


def folded_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of an order as frames: returned ones are the project's."""
    o = _sql(spark, sf_dir, "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_returnflag FROM lineitem", "lineitem")
    frame = F.struct((F.col("l_returnflag") == "R").alias("in_project"), F.lit("C").alias("class"), F.lit("m").alias("method"), F.lit("C.java").alias("file"), F.col("l_linenumber").alias("line"))
    one = o.groupBy("l_orderkey").agg(F.transform(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", frame.alias("f")))), lambda x: x.f).alias("frames"))
    items = F.transform(views.folded(F.col("frames")), lambda x: F.concat(x.kind, F.lit(":"), x.start.cast("string"), F.lit("-"), x["end"].cast("string")))
    return one.select("l_orderkey", F.array_join(items, " ").alias("items"), views.frame_text(F.col("frames")[0]).alias("first"))


def score_breakdowns(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _sql(spark, sf_dir, "SELECT p_partkey, p_size FROM part", "part")
    m = F.map_from_arrays(F.array(*map(F.lit, ("level_equal", "odd", "regex_full", "aside", "logger_conflict"))), F.array(F.lit(0.1), F.lit(0.0), F.col("p_size") / 100, F.lit(0.5), -F.col("p_size") / 200))
    rows = F.transform(views.breakdown_rows(m), lambda x: F.concat(x.key, F.lit(" "), views.points_text(F.round(x.points, 6))))
    return p.where("p_size % 4 <> 1 and p_size % 4 <> 3").select("p_partkey", F.array_join(rows, "|").alias("rows"))


def time_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    logs = _logs(spark, sf_dir)
    first = logs.groupBy("trace_id").agg(F.min("ts").alias("start"))
    step = (F.col("event_id") % 3 * F.col("event_id") * 40).cast("long")
    return logs.join(first, "trace_id").select("event_id", views.offset_text(F.col("start"), F.timestamp_millis(F.unix_millis("start") + step)).alias("offset"))


def filter_mismatches(spark: SparkSession, sf_dir: str) -> DataFrame:
    why = views.mismatches("ev", ["error", "view"], ["ERROR"], ["matched"], ["high", "medium"], "2024-01-02 00:00:00", "2024-01-20 00:00:00", "t7", True)
    return _logs(spark, sf_dir).select("event_id", F.array_join(why, ",").alias("filters"))


def events_at_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every log as an event of three lines from four times its sequence on; lines 0, 1, 2, ... of each file are asked for."""
    logs = _logs(spark, sf_dir)
    events = logs.select("source_file", (F.col("sequence") * 4).cast("int").alias("line_number"), F.lit(3).alias("line_count"), "event_id")
    asked = logs.select("source_file", F.col("sequence").cast("int").alias("line"))
    return views.events_at(events, asked).select("source_file", "line", "event_id")


def explained_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    logs = _logs(spark, sf_dir)
    told = logs.withColumn("match", F.col("match").withField("score_breakdown", F.when(F.col("status") != "unmatched", F.create_map(F.lit("level_equal"), F.lit(0.1), F.lit("regex_full"), F.lit(0.45)))))
    return views.explained(told)


def services_known(spark: SparkSession, sf_dir: str) -> DataFrame:
    return meta.services(_logs(spark, sf_dir), "ev")


def dataset_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    logs = _logs(spark, sf_dir).withColumn("dataset_id", F.concat(F.lit("d"), (F.col("event_id") % 4).cast("string")))
    return meta.datasets(logs)


def status_dashboard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return meta.dashboard(_logs(spark, sf_dir), 3)


def term_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return meta.count_where(_logs(spark, sf_dir), service="error", **{"match.status": "matched"})


def _runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as runs of their customers' versions; every run selects two dependencies."""
    q = """SELECT cast(o_orderkey AS string) AS run_id, CASE WHEN o_orderstatus = 'P' THEN 'dependency' ELSE 'project' END AS kind, named_struct('name', concat('g:a', cast(o_custkey % 40 AS string)), 'version', cast(o_custkey % 3 AS string)) AS code_unit,
      cast(o_orderdate AS string) AS started_at, cast(o_orderdate AS string) AS finished_at, cast(o_orderkey % 2 AS string) AS analyzer_version, array(named_struct('selected_dependencies', array(concat('g:d', cast(o_orderkey % 5 AS string), ':1:x'), 'g:e:2'))) AS modules FROM orders"""
    return _sql(spark, sf_dir, q, "orders")


def latest_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return meta.latest_runs(_runs(spark, sf_dir)).select("run_id", "code_unit.name", "code_unit.version", "started_at")


def code_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    return meta.code_units(_runs(spark, sf_dir).groupBy("kind", "code_unit").agg(F.max("finished_at").alias("finished_at")))


def run_catalogs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statements of the newest runs: parts as statements of units g:a0 to g:a39, g:d0 to g:d4 and g:e; every seventh cannot be matched."""
    q = """SELECT cast(p_partkey AS string) AS statement_id, named_struct('name', concat('g:', element_at(array('a', 'd', 'e'), cast(p_partkey % 3 AS int) + 1), CASE p_partkey % 3 WHEN 0 THEN cast(p_size % 40 AS string) WHEN 1 THEN cast(p_size % 5 AS string) ELSE '' END),
      'version', CASE p_partkey % 3 WHEN 1 THEN '1:x' WHEN 2 THEN '2' ELSE cast(p_partkey % 2 AS string) END) AS code_unit, CASE WHEN p_partkey % 7 = 0 THEN 'unsupported' ELSE 'literal' END AS template_kind FROM part"""
    runs, said = meta.latest_runs(_runs(spark, sf_dir)), _sql(spark, sf_dir, q, "part")
    some, every = (meta.run_catalog(said, runs, x).groupBy("run_id").agg(F.count("*").alias("n")) for x in (False, True))
    return every.join(some.withColumnRenamed("n", "m"), "run_id", "left").select("run_id", F.col("n").alias("statements"), F.coalesce("m", F.lit(0)).alias("matchable"))


def runs_to_do(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = _runs(spark, sf_dir)
    return meta.to_analyse(runs.select("run_id"), runs, "1")


def eval_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return meta.dataset_events(_logs(spark, sf_dir), "ev").select("source_file", "line_number", "event_id")


def catalog_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as statements: brands as logging APIs and kinds, types as detections, small ones unsupported."""
    q = "SELECT p_brand AS logging_api, CASE WHEN p_size < 10 THEN 'unsupported' ELSE p_brand END AS template_kind, p_type AS detection, CASE WHEN p_size < 5 THEN 'small' WHEN p_size < 10 THEN 'short' END AS unsupported_reason FROM part"
    return meta.catalog_statistics(_sql(spark, sf_dir, q, "part"))


def call_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = meta.call_statistics(_sql(spark, sf_dir, "SELECT o_orderstatus <> 'O' AS resolved, CASE WHEN o_orderstatus = 'F' THEN o_custkey END AS target_method_id FROM orders", "orders"))
    return n.select("calls", "resolved", "own", *[F.round(c, 9).alias(c) for c in ("resolved_percent", "own_percent")])


def statement_ordinals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return meta.ordinals(_sql(spark, sf_dir, "SELECT o_orderkey AS place, o_orderpriority AS file_path, o_orderstatus AS class_fqn, cast(o_custkey % 3 AS string) AS method_signature, nullif(o_custkey % 2, 1) AS template FROM orders", "orders")).select("place", "ordinal")


def merged_modules(spark: SparkSession, sf_dir: str) -> DataFrame:
    new = _sql(spark, sf_dir, "SELECT n_name AS module, n_name AS service, array('new') AS dependencies, cast(array() AS array<string>) AS selected_dependencies FROM nation", "nation")
    prior = _sql(spark, sf_dir, "SELECT n_name AS module, array('old') AS dependencies, CASE WHEN n_nationkey % 3 = 0 THEN array('a', n_name) WHEN n_nationkey % 3 = 1 THEN cast(array() AS array<string>) END AS selected_dependencies FROM nation WHERE n_nationkey < 20", "nation")
    return meta.merged_modules(new, prior).select("module", F.array_join("dependencies", ",").alias("dependencies"), F.array_join("selected_dependencies", ",").alias("selected"))


def primary_truths(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = spark.sql("SELECT concat('s', cast(id AS string)) AS statement_id, concat('c', cast(id AS string)) AS class_fqn FROM range(0, 5)")
    return meta.primary_truths(_judged(spark, sf_dir), known)


def eval_per_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.per_status(_judged(spark, sf_dir)).withColumns({c: F.round(c, 9) for c in ("acc_at1", "acc_at3")})


def eval_all_dimensions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _judged(spark, sf_dir).withColumn("hour", F.hour("ts")).withColumn("kind", F.when(F.col("event_id") % 4 > 0, F.col("level")))
    return evaluate.breakdown(rows, ["service", "level", "confidence", "thread", "hour", "kind"])


def labelled_truths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels that say correct, incorrect with and without a statement, and not in the catalog; no label, with a reliable place or not."""
    logs = _logs(spark, sf_dir).withColumn("ground_truth", F.struct(F.concat(F.lit("c"), (F.col("event_id") % 6).cast("string")).alias("class"), (F.col("event_id") % 20).cast("int").alias("line"), (F.col("event_id") % 5 > 0).alias("reliable")))
    said = spark.sql("SELECT concat('s', cast(id AS string)) AS statement_id, concat('c', cast(id % 4 AS string)) AS class_fqn, cast(id AS int) AS line, cast(id + 6 AS int) AS end_line FROM range(0, 12)")
    said = said.join(logs.select("service").distinct())
    told = logs.where("event_id % 2 = 0").select("log_id", F.element_at(F.array(*map(F.lit, ("correct", "incorrect", "incorrect", "not_in_catalog"))), (F.col("event_id") % 8 / 2 + 1).cast("int")).alias("verdict"), F.when(F.col("event_id") % 8 == 2, F.lit("s3")).alias("correct_statement_id"), F.when(F.col("event_id") % 3 == 0, F.lit("s9")).alias("predicted_statement_id"))
    t = evaluate.truths(logs, said, told)
    return t.join(logs.select("log_id", "event_id"), "log_id").select("event_id", "state", F.array_join("ids", "+").alias("truth_key"))


def listed_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labels.listed(_labels(spark, sf_dir), "ev", "correct", 25).select("log_id", "labeled_at")


def label_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    logs = _logs(spark, sf_dir)
    return labels.snapshot(logs.where("event_id % 5 = 0").select("log_id", F.lit("correct").alias("verdict")), logs).select("log_id", "dataset_id", "predicted_statement_id", F.col("labeled_at").isNotNull().alias("dated"))


def unique_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as interfaces of their suppliers; customers call their nation."""
    edges = _sql(spark, sf_dir, "SELECT c_name AS caller_id, n_name AS target_class, 'run' AS method, cast(c_custkey % 90 AS int) AS line FROM customer JOIN nation ON c_nationkey = n_nationkey", "customer", "nation")
    classes = _sql(spark, sf_dir, "SELECT n_name AS interface, s_name AS class_fqn FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE n_nationkey > 12 OR s_suppkey <= 12", "supplier", "nation")
    return catalog.unique_implementor_edges(edges, classes)


def resolved_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames of orders: classes of the project, of a selected dependency with and without its source, of one not selected, and unknown ones."""
    types = spark.sql("""SELECT * FROM VALUES ('t1', named_struct('type', 'project', 'name', 'p', 'version', '1'), 'm', 'C0', 'C0', 'f0'), ('t2', named_struct('type', 'dependency', 'name', 'g:a', 'version', '1'), NULL, 'C1', 'C1$', 'f1'),
      ('t3', named_struct('type', 'dependency', 'name', 'g:a', 'version', '1'), NULL, 'C2', 'C2', 'f2'), ('t4', named_struct('type', 'dependency', 'name', 'g:b', 'version', '1'), NULL, 'C3', 'C3', 'f3') t(type_id, code_unit, module, class_fqn, class_binary, file_id)""")
    modules = spark.sql("SELECT 'm' AS module, 'svc' AS service, array('g:a:1') AS selected_dependencies")
    sources = spark.sql("SELECT * FROM VALUES ('f0'), ('f1') t(file_id)")
    q = "SELECT cast(l_orderkey AS string) AS log_id, l_linenumber, l_partkey, l_suppkey, concat('C', cast(l_partkey % 5 AS string), CASE WHEN l_partkey % 5 = 1 AND l_suppkey % 2 = 0 THEN '$' ELSE '' END) AS class FROM lineitem"
    rows = _sql(spark, sf_dir, q, "lineitem").groupBy("log_id").agg(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", "class"))).alias("x"))
    frame = lambda x: F.struct(x["class"].alias("class"), F.lit("m").alias("method"), F.lit("F").alias("file"), x.l_linenumber.alias("line"))
    events = rows.select("log_id", F.lit("svc").alias("service"), F.struct(F.transform("x", frame).alias("frames")).alias("exception"))
    found = enrich.resolve_frames(events, enrich.frame_types(types, modules, sources))
    told = F.transform("frames", lambda f: F.concat_ws("/", f["class"], f.in_project.cast("string"), F.coalesce(f.code_unit, F.lit("-")), F.coalesce(f.file_id, F.lit("-"))))
    return found.select("log_id", F.array_join(told, " ").alias("frames"))


#: Statements, loggers and events that reach the branches of matching: hierarchy, several names, conflict, dynamic and other levels, throwables, prefixes, tokens only, nothing at all.
BRANCH_STATEMENTS = """
SELECT * FROM (VALUES
  ('b-direct', 'com.shop.A', 'com.shop.A', 'class_literal', 'INFO', false, false, 'Alpha {} done', 'placeholders'),
  ('b-parent', 'com.shop.Base', 'com.shop.Base', 'get_class', 'INFO', false, false, 'Base says {}', 'placeholders'),
  ('b-multi1', 'com.shop.x.M', 'com.shop.x.M', 'class_literal', 'WARN', false, true, 'Multi {}', 'placeholders'),
  ('b-multi2', 'com.shop.xy.M', 'com.shop.xy.M', 'class_literal', 'WARN', true, false, 'Multi {}', 'placeholders'),
  ('b-token', 'com.shop.T', 'com.shop.T', 'class_literal', 'ERROR', false, false, 'Unusual zebra {} crossing', 'placeholders'),
  ('b-any', 'com.shop.D', 'com.shop.D', 'class_literal', 'INFO', false, false, '{}', 'dynamic')
) t(statement_id, class_fqn, logger_name, logger_name_kind, level, level_dynamic, has_throwable_arg, template, template_kind)"""

BRANCH_EVENTS = """
SELECT event_id, event_id % 12 AS k, element_at(array('com.shop.A', 'com.shop.Child', 'c.s.x.M', 'com.shop.Zed', 'com.shop.A', 'com.shop.A', 'com.shop.A', 'com.shop.D', 'com.shop.A', 'com.shop.x.M', NULL, 'com.shop.D'), cast(event_id % 12 AS int) + 1) AS logger_raw,
  element_at(array('INFO', 'INFO', 'WARN', 'ERROR', 'WARN', 'INFO', 'INFO', 'INFO', 'ERROR', 'DEBUG', 'ERROR', 'WARN'), cast(event_id % 12 AS int) + 1) AS level, event_id % 12 IN (2, 6) AS has_exception,
  element_at(array('Alpha 1 done', 'Base says 2', 'Multi 3', 'Unusual zebra 4 crossing', 'Alpha 5 done', 'Alpha 6 done and more', 'Alpha 7 done', 'whatever 8', 'Unusual zebra 9 crossing', 'Multi 10', 'Unusual zebra 11 crossing', 'whatever 12'), cast(event_id % 12 AS int) + 1) AS message FROM events"""


def match_branches(spark: SparkSession, sf_dir: str) -> DataFrame:
    unit = F.struct(F.lit("project").alias("type"), F.lit("shop").alias("name"), F.lit("1").alias("version"))
    s = spark.sql(BRANCH_STATEMENTS).select("*", unit.alias("code_unit"), F.lit("m").alias("module"), F.lit("svc").alias("service"), F.lit("run").alias("method_name"), F.lit("A.java").alias("file_path"), F.lit(1).alias("line"))
    modules = spark.sql("SELECT 'm' AS module, 'svc' AS service, cast(array() AS array<string>) AS selected_dependencies")
    own = s.select(F.col("class_fqn").alias("type_id"), "code_unit", "module", "class_fqn", F.col("class_fqn").alias("class_binary"), F.lit(None).cast("string").alias("superclass_fqn"))
    child = spark.sql("SELECT 'child' AS type_id, 'com.shop.Child' AS class_fqn, 'com.shop.Child' AS class_binary, 'com.shop.Base' AS superclass_fqn").select("type_id", unit.alias("code_unit"), F.lit("m").alias("module"), "class_fqn", "class_binary", "superclass_fqn")
    events = _sql(spark, sf_dir, BRANCH_EVENTS, "events").withColumn("service", F.lit("svc"))
    m = match.match(events, s, modules, own.union(child), cached=[])
    parts = F.transform(views.breakdown_rows(F.map_filter("match.score_breakdown", lambda k, v: k != "specificity")), lambda x: F.concat(x.key, F.format_string(" %.2f", x.points)))
    shown = F.transform("match.candidates", lambda c: F.concat(c.statement_id, F.format_string(" %.6f", c.score)))
    return m.select("event_id", "match.status", "match.statement_id", F.round("match.confidence", 6).alias("confidence"), "match.confidence_level", F.array_join("match.args", "|").alias("args"), F.array_join(shown, "|").alias("candidates"), F.array_join(parts, "|").alias("parts"), "match.class_fqn", "match.template", "logger")


QUERIES = {f.__name__: f for f in (log_text_search, log_exceptions, log_page_end, log_summaries, method_callers_known, source_lookup, folded_frames, score_breakdowns, time_offsets, filter_mismatches, events_at_lines, explained_links, services_known, dataset_counts, status_dashboard, term_counts, latest_runs, code_units, run_catalogs, runs_to_do, eval_events, catalog_statistics, call_statistics, statement_ordinals, merged_modules, primary_truths, eval_per_status, eval_all_dimensions, labelled_truths, listed_labels, label_snapshots, unique_edges, resolved_frames, match_branches)}

"""Queries over tables and files that Spark writes from the given tables first, and over configurations of matching."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import evaluate, labels, match
from ..sources import lines, store
from ..sources.scratch import new_folder, written
from .derive import LOGS, STATEMENTS
from .oracle import _L, ORACLE_SQL as _FIRST_SQL
from .queries import _catalog, _judged, _labels, _lines, _logs, _sql


def merged_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders in a table merged on read: all of them, then new prices with a column more, deletions, a batch that is repeated, a compaction, and late rows."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_orderstatus", "o_totalprice")
    table = store.Merged(spark, new_folder(spark, "orders"), "o_orderkey")
    table.write(orders, 0)
    table.write(orders.where("o_orderkey % 5 = 0").withColumn("o_totalprice", F.col("o_totalprice") + 1).withColumn("remark", F.lit("raised")), 1)
    table.delete(orders.where("o_orderkey % 7 = 0"), 2)
    table.write(orders.withColumn("o_orderstatus", F.lit("never")), 1)
    table.compact(0)
    table.write(orders.where("o_orderkey % 35 = 0").withColumn("remark", F.lit("back")), table.next_batch())
    return table.read().select("o_orderkey", "o_orderstatus", "o_totalprice", "remark")


def upserted_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers by market segment: some move to another segment, some are new, and one segment is replaced as a whole."""
    rows = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", "c_acctbal", "c_mktsegment")
    path = new_folder(spark, "customers")
    store.create(spark, path, rows.schema, "c_mktsegment")
    store.replace(rows.where("c_custkey % 10 > 0"), path, "c_mktsegment")
    moved = rows.where("c_custkey % 6 = 0").withColumn("c_mktsegment", F.lit("MOVED")).withColumn("since", F.col("c_custkey").cast("string"))
    store.upsert(moved, path, "c_custkey", "c_mktsegment")
    store.replace(rows.where("c_mktsegment = 'BUILDING' and c_custkey % 2 = 1").withColumn("since", F.lit("replaced")), path, "c_mktsegment")
    kept = "c_custkey bigint, c_acctbal double, since string, c_mktsegment string"
    return spark.read.schema(kept).parquet(path)


def scanned_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The logs' lines in text files of 5,000 lines, every other one compressed, and what a scan of them gives."""
    number = F.floor((F.col("line_no") - 1) / 5000)
    each = _lines(spark, sf_dir).select(F.concat(F.regexp_extract("source_file", r"^(.*)\.log$", 1), F.lit("-"), number).alias("file"), (number % 2).alias("odd"), "line_no", "text")
    path = new_folder(spark, "files")
    for odd, codec in ((0, "none"), (1, "gzip")):
        some = each.where(F.col("odd") == odd).repartition("file").sortWithinPartitions("file", "line_no")
        some.select("file", "text").write.mode("append").partitionBy("file").option("compression", codec).text(path)
    found = lines.read_lines(spark, f"{path}/file=*", "d", path.rsplit("/", 1)[1])
    return found.select(F.regexp_extract("source_file", "^file=([^/]+)/", 1).alias("file"), "line_no", "text")


def exported_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as a JSON object a line, nulls left out, and read from these lines again."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    rows = orders.select("o_orderkey", F.when(F.col("o_orderkey") % 4 > 0, F.col("o_orderpriority")).alias("priority"), F.struct(F.when(F.col("o_orderkey") % 3 > 0, F.col("o_orderstatus")).alias("status"), "o_totalprice").alias("state"))
    path = new_folder(spark, "export")
    store.export_json(rows, path)
    told = spark.read.text(path).select(F.size(F.json_object_keys("value")).alias("keys"), F.from_json("value", rows.schema).alias("r"))
    return told.select("r.o_orderkey", "r.priority", "r.state.status", "r.state.o_totalprice", "keys")


def review_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The review queue of two seeds."""
    logs, told = _logs(spark, sf_dir).withColumn("log_id", F.concat(F.lit("d"), F.col("event_id").cast("string"))), _labels(spark, sf_dir)
    queue = lambda seed: labels.review_queue(logs, told, 40, seed).select(F.lit(seed).alias("seed"), "log_id")
    return queue(1).union(queue(2))


def error_kind_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.error_sample(evaluate.error_kinds(_judged(spark, sf_dir)), 5, 3).select("predicted", "truth_key", "n", "log_id")


#: Events of which some have a logger that is not known, another level, or a message that only the dynamic statement fits; and their truths.
_TRIED = f"""SELECT event_id, service, message, level, CASE WHEN event_id % 5 = 0 THEN 'org.other.Thing' ELSE logger END AS logger_raw, false AS has_exception, truth
FROM (SELECT event_id, service, CASE WHEN service = 'error' AND event_id % 7 = 0 THEN 'Gateway down' ELSE message END AS message, CASE WHEN event_id % 4 = 0 THEN 'TRACE' ELSE level END AS level,
  CASE service WHEN 'click' THEN 'c.s.w.ClickController' WHEN 'view' THEN 'c.s.w.PageController' WHEN 'purchase' THEN 'c.s.o.OrderService' WHEN 'error' THEN 'c.s.w.ErrorAdvice' ELSE 'c.s.a.AccountService' END AS logger,
  CASE WHEN event_id % 11 = 0 THEN NULL WHEN service = 'error' AND event_id % 7 = 0 THEN 's-any' WHEN service = 'purchase' AND event_id % 3 = 0 THEN 's-order2'
    ELSE CASE service WHEN 'click' THEN 's-click' WHEN 'view' THEN 's-open' WHEN 'purchase' THEN 's-order' WHEN 'error' THEN 's-fail' ELSE 's-account' END END AS truth FROM ({LOGS}) AS l) AS t"""

#: Configurations beside the ablations: other weights and thresholds over the same features.
_TRIALS = {"base": {}, "short": {"specificity_k": 40.0, "specificity_max": 0.3}, "strict": {"min_score": 0.55, "high": 0.9}, "wide": {"ambiguity_margin": 0.0}, "prefix": {"regex_prefix": 0.35, "level_conflict": -0.05, "medium": 0.4}}


def _tried(spark: SparkSession, sf_dir: str) -> tuple:
    events = _sql(spark, sf_dir, _TRIED, "events")
    keys = events.select(match.key_of(events).alias("key"), F.col("event_id").alias("log_id"))
    truth = events.where("truth is not null").select(F.col("event_id").alias("log_id"), F.array("truth").alias("ids"))
    return match.keys_of(events), keys, truth


def ablation_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The seven variants over all events; variants with the same candidates share their features, which do not depend on weights."""
    distinct, keys, truth = _tried(spark, sf_dir)
    modes = {mode: written(match.features(distinct, *_catalog(spark), mode=mode), "features") for mode in sorted({m for _, m in match.variants().values()})}
    rows = {name: modes[mode] for name, (_, mode) in match.variants().items()}
    return evaluate.ablate(rows, keys, truth, {name: config for name, (config, _) in match.variants().items()})


def trial_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Configurations tried over one table of features."""
    distinct, keys, truth = _tried(spark, sf_dir)
    trials = [replace(match.Config(), **told) for told in _TRIALS.values()]
    found = evaluate.score_trials(match.features(distinct, *_catalog(spark)), keys, truth, trials)
    return spark.createDataFrame([(name, r["at1"], r["high"], r["high_correct"]) for name, r in zip(_TRIALS, found, strict=True)], "trial string, at1 long, high long, high_correct long")


QUERIES = {f.__name__: f for f in (merged_orders, upserted_customers, scanned_lines, exported_orders, review_sample, error_kind_sample, ablation_variants, trial_scores)}

#: Of each variant: the weights that differ among them, and which candidates it takes.
_VARIANTS = """v(variant, full_w, prefix_w, spec, k, logger_w, equal_w, conflict_w, thrown_w, least, margin, high, mode) AS (VALUES
  ('full', 0.45, 0.2, 0.2, 15, 0.2, 0.1, -0.3, 0.05, 0.35, 0.05, 0.75, 'both'), ('no_logger', 0.45, 0.2, 0.2, 15, 0, 0.1, -0.3, 0.05, 0.35, 0.05, 0.75, 'both'), ('no_level', 0.45, 0.2, 0.2, 15, 0.2, 0, 0, 0.05, 0.35, 0.05, 0.75, 'both'),
  ('logger_candidates_only', 0.45, 0.2, 0.2, 15, 0.2, 0.1, -0.3, 0.05, 0.35, 0.05, 0.75, 'logger'), ('token_candidates_only', 0.45, 0.2, 0.2, 15, 0.2, 0.1, -0.3, 0.05, 0.35, 0.05, 0.75, 'tokens'),
  ('no_specificity', 0.45, 0.2, 0, 15, 0.2, 0.1, -0.3, 0.05, 0.35, 0.05, 0.75, 'both'), ('regex_only', 0.45, 0.2, 0.2, 15, 0, 0, 0, 0, 0.35, 0.05, 0.75, 'both'))"""
_TRIAL_VALUES = """v(variant, full_w, prefix_w, spec, k, logger_w, equal_w, conflict_w, thrown_w, least, margin, high, mode) AS (VALUES
  ('base', 0.45, 0.2, 0.2, 15, 0.2, 0.1, -0.3, 0.05, 0.35, 0.05, 0.75, 'both'), ('short', 0.45, 0.2, 0.3, 40, 0.2, 0.1, -0.3, 0.05, 0.35, 0.05, 0.75, 'both'), ('strict', 0.45, 0.2, 0.2, 15, 0.2, 0.1, -0.3, 0.05, 0.55, 0.05, 0.9, 'both'),
  ('wide', 0.45, 0.2, 0.2, 15, 0.2, 0.1, -0.3, 0.05, 0.35, 0.0, 0.75, 'both'), ('prefix', 0.45, 0.35, 0.2, 15, 0.2, 0.1, -0.05, 0.05, 0.35, 0.05, 0.75, 'both'))"""

_DECIDED = f"""e AS ({_TRIED}), s AS ({STATEMENTS}), c AS (SELECT e.*, s.statement_id, s.level AS own, template_kind = 'dynamic' AS dyn, length(replace(replace(template, '{{}}', ''), ' ', '')) AS len, logger_raw <> 'org.other.Thing' AS named, split_part(template, '{{}}', 1) AS head, split_part(template, '{{}}', 2) AS rest FROM e JOIN s USING (service)),
  f AS (SELECT *, NOT dyn AND starts_with(message, head) AS fits, NOT dyn AND starts_with(message, head) AND (rest = '' OR ends_with(message, rest)) AS whole FROM c),
  g AS (SELECT variant, event_id, truth, statement_id, least, margin, high, round(greatest(0, least(1, CASE WHEN dyn THEN 0 ELSE CASE WHEN whole THEN full_w ELSE prefix_w END + spec::double * len / (len + k) END
    + CASE WHEN named THEN logger_w ELSE 0 END + CASE WHEN level = own THEN equal_w ELSE conflict_w END + thrown_w))::double, 9) AS sc FROM f CROSS JOIN v WHERE (dyn OR fits) AND CASE mode WHEN 'logger' THEN named WHEN 'tokens' THEN fits ELSE named OR fits END),
  o AS (SELECT *, row_number() OVER w AS n, lead(sc) OVER w AS second FROM g WINDOW w AS (PARTITION BY variant, event_id ORDER BY sc DESC, statement_id)),
  d AS (SELECT variant, event_id, statement_id, truth, CASE WHEN round(sc - second, 9) < margin THEN round(sc * 0.6, 9) ELSE sc END >= high AS high FROM o WHERE n = 1 AND sc >= least AND truth IS NOT NULL)"""

ORACLE_SQL = {
    "merged_orders": """SELECT o_orderkey, o_orderstatus, CASE WHEN o_orderkey % 5 = 0 AND o_orderkey % 7 > 0 THEN o_totalprice + 1 ELSE o_totalprice END AS o_totalprice, CASE WHEN o_orderkey % 35 = 0 THEN 'back' WHEN o_orderkey % 5 = 0 THEN 'raised' END AS remark
      FROM orders WHERE o_orderkey % 7 > 0 OR o_orderkey % 35 = 0""",
    "upserted_customers": """SELECT c_custkey, c_acctbal, cast(c_custkey AS varchar) AS since, 'MOVED' AS c_mktsegment FROM customer WHERE c_custkey % 6 = 0
      UNION ALL SELECT c_custkey, c_acctbal, NULL, c_mktsegment FROM customer WHERE c_custkey % 6 > 0 AND c_custkey % 10 > 0 AND c_mktsegment <> 'BUILDING'
      UNION ALL SELECT c_custkey, c_acctbal, 'replaced', c_mktsegment FROM customer WHERE c_mktsegment = 'BUILDING' AND c_custkey % 2 = 1""",
    "scanned_lines": f"""{_L}, t AS (SELECT service, event_id, unnest(x) AS text, generate_subscripts(x, 1) AS k FROM (SELECT *, list_concat([concat(strftime(ts, '%Y-%m-%dT%H:%M:%S.%g'), 'Z ', lpad(level, 5, ' '), ' 1 --- [', rpad(thread, 15, ' '), '] ', rpad(concat('com.shop.', service), 40, ' '), ' : ', message)],
        CASE WHEN service = 'error' THEN [concat('java.lang.IllegalStateException: user ', thread), concat(chr(9), 'at com.shop.web.ErrorAdvice.handle(ErrorAdvice.java:50)'), concat(chr(9), 'at java.base/java.lang.Thread.run(Thread.java:1)'), 'Caused by: java.io.IOException: closed', concat(chr(9), 'at com.shop.io.Pipe.read(Pipe.java:7) ~[na:na]')] ELSE [] END) AS x FROM l)),
      n AS (SELECT service, text, row_number() OVER (PARTITION BY service ORDER BY event_id, k) - 1 AS n FROM t)
      SELECT concat(service, '-', n // 5000) AS file, cast(n % 5000 + 1 AS integer) AS line_no, text FROM n""",
    "exported_orders": """SELECT o_orderkey, CASE WHEN o_orderkey % 4 > 0 THEN o_orderpriority END AS priority, CASE WHEN o_orderkey % 3 > 0 THEN o_orderstatus END AS status, o_totalprice, CASE WHEN o_orderkey % 4 > 0 THEN 3 ELSE 2 END AS keys FROM orders""",
    "review_sample": f"""{_L}, v AS (SELECT concat('d', doc_id % 97) AS k, CASE WHEN doc_id % 10 = 9 THEN NULL ELSE 1 END AS verdict FROM labels QUALIFY row_number() OVER (PARTITION BY doc_id % 97 ORDER BY doc_id DESC) = 1),
      r AS (SELECT seed, log_id, row_number() OVER (PARTITION BY seed ORDER BY md5(concat(seed, '|', log_id)), log_id) AS n FROM (SELECT * REPLACE (concat('d', event_id) AS log_id) FROM l) CROSS JOIN (VALUES (1), (2)) s(seed) WHERE (event_id % 5 = 0 OR status = 'ambiguous' OR confidence = 'low') AND log_id NOT IN (SELECT k FROM v WHERE verdict IS NOT NULL))
      SELECT cast(seed AS integer) AS seed, log_id FROM r WHERE n <= 40""",
    "error_kind_sample": f"WITH k AS ({_FIRST_SQL['eval_error_kinds']}) SELECT * FROM k ORDER BY md5(concat('3|', predicted, '|', truth_key)), predicted, truth_key LIMIT 5",
    "ablation_variants": f"WITH {_VARIANTS}, {_DECIDED} SELECT variant, (SELECT count(*) FROM e WHERE truth IS NOT NULL) AS events, count(*) FILTER (statement_id = truth) AS at1 FROM v LEFT JOIN d USING (variant) GROUP BY 1",
    "trial_scores": f"WITH {_TRIAL_VALUES}, {_DECIDED} SELECT variant AS trial, count(*) FILTER (statement_id = truth) AS at1, count(*) FILTER (d.high) AS high, count(*) FILTER (d.high AND statement_id = truth) AS high_correct FROM v LEFT JOIN d USING (variant) GROUP BY 1",
}

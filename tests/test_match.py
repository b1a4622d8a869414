from pyspark.sql import functions as F

from logloom.operators import evaluate
from logloom.operators.match import features, key_of, keys_of, match, resolve_loggers, variants

UNIT = "named_struct('type', 'project', 'name', 'p', 'version', '1')"


def tables(spark):
    s = spark.sql(f"""SELECT *, {UNIT} AS code_unit, 'm' AS module, 'svc' AS service, class_fqn AS logger_name, 'class_literal' AS logger_name_kind, 'f' AS method_name, 'p' AS file_path, 'INFO' AS level, false AS level_dynamic, false AS has_throwable_arg
      FROM VALUES ('s1', 'com.acme.A', 'Saving {{}}', 'placeholders', 10), ('s2', 'com.acme.B', 'Saving {{}}', 'placeholders', 20), ('s3', 'com.acme.C', '{{}}', 'dynamic', 30) t(statement_id, class_fqn, template, template_kind, line)""")
    m = spark.createDataFrame([("m", "svc", [])], "module string, service string, selected_dependencies array<string>")
    t = s.select(F.col("class_fqn").alias("type_id"), "code_unit", "module", "class_fqn", F.col("class_fqn").alias("class_binary"), F.lit(None).cast("string").alias("superclass_fqn"))
    e = spark.createDataFrame([("1", "svc", "com.acme.A", "INFO", "Saving x", False, "s1"), ("2", "svc", "com.acme.B", "INFO", "Saving y", False, "s2"), ("3", "svc", "com.acme.C", "INFO", "whatever", False, "s3"), ("4", "svc", None, "INFO", None, False, None)], "log_id string, service string, logger_raw string, level string, message string, has_exception boolean, truth string")
    return s, m, t, e


def test_match(spark):
    s, m, t, e = tables(spark)
    got = {r.log_id: r for r in match(e, s, m, t).collect()}
    assert [got[k].match.statement_id for k in "1234"] == ["s1", "s2", "s3", None]
    assert got["1"].match.args == ["x"] and got["1"].match.confidence_level == "high" and got["1"].logger == "com.acme.A"
    assert (got["3"].match.confidence, got["3"].match.status) == (0.35, "matched") and got["4"].match.status == "unmatched"


def test_loggers(spark):
    names = spark.createDataFrame([("s", x) for x in ("net.harbour.dock.crane.LoadScheduler", "net.harbour.store.bin.ShelfInventory", "net.harbour.dock.berth.assign.AutomaticBerthAssignmentService")], "service string, name string")
    raw = spark.createDataFrame([("s", x) for x in ("n.h.d.c.LoadScheduler", ".h.s.b.ShelfInventory", "icBerthAssignmentService", "x.Y", None)], "service string, logger_raw string")
    assert {r.logger_raw: r.kind for r in resolve_loggers(raw, names).collect()} == {"n.h.d.c.LoadScheduler": "ABBREV_UNIQUE", ".h.s.b.ShelfInventory": "TRUNCATED", "icBerthAssignmentService": "TRUNCATED", "x.Y": "UNKNOWN"}


def test_tuning_over_cached_features(spark):
    s, m, t, e = tables(spark)
    e = e.where("truth is not null")
    keys = keys_of(e)
    joined, truth = e.select(key_of(e).alias("key"), "log_id"), e.select("log_id", F.array("truth").alias("ids"))
    f = features(keys, s, m, t).cache()
    best, tried = evaluate.tune(f, joined, truth, trials=9)
    assert tried[0][1]["at1"] == 3 and max(x["at1"] for _, x in tried) == 3 and len(tried) <= 9
    assert "full" in variants()

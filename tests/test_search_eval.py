from pyspark.sql import functions as F

from logloom.operators import catalog, evaluate, labels, search
from logloom.plans.queries import _judged, _logs

SF = "/root/testdata/sf0.001"


def test_pages_cover_all_logs_once(spark):
    logs, cursor, seen = _logs(spark, SF).where("service = 'error'").cache(), None, []
    for _ in range(20):
        rows = search.page(logs, 60, "asc", cursor).collect()
        if not rows:
            break
        seen += [r.log_id for r in rows]
        cursor = search.encode_cursor([rows[-1].ts, rows[-1].sequence, rows[-1].log_id])
    assert len(seen) == len(set(seen)) == logs.count()


def test_text_query(spark):
    d = spark.createDataFrame([("Saving owner 42",), ("owner saved",), ("nothing of order-42",), ("user_id is 7",), ("net.harbour.Crane failed",), ("alpha beta",), ("alpha",)], "message string")
    every = [r.message for r in d.collect()]

    def hit(q):
        return [every.index(r.message) for r in d.where(search.text_query(q, F.col("message"))).collect()]

    assert hit("saving saved") == [0, 1] and hit("sav*") == [0, 1] and hit('"owner 42"') == [0] and hit("+owner + -42") == [1]
    assert hit("order-42") == [0, 2] and hit("user_id") == [3] and hit("user") == [] and hit("net.harbour.crane") == [4] and hit("harbour") == []
    assert hit("alpha +beta") == [5] and hit("alpha beta") == [5, 6] and hit("alpha | owner + 42") == [0] and hit("alpha | (owner + 42)") == [0, 5, 6]
    assert hit("failed -alpha") == [0, 1, 2, 3, 4] and hit("-(alpha | owner)") == [2, 3, 4] and hit("svd~1") == [] and hit("savet~1") == [1]
    assert hit("*") == list(range(7)) and hit("+ | -") == [] and hit('"owner') == [0, 1] and hit("(owner") == [0, 1] and hit(r"\+owner") == [0, 1]


def test_exceptions_are_those_with_a_class(spark):
    logs = spark.createDataFrame([("a", ("X",)), ("b", (None,)), ("c", None)], "log_id string, exception struct<class:string>")
    found = lambda x: sorted(r.log_id for r in search.search(logs, has_exception=x).collect())
    assert found(True) == ["a"] and found(False) == ["b", "c"]


def test_parameter_space_and_test_sets():
    from dataclasses import asdict, replace
    from random import Random

    import pytest

    base = evaluate.Config()
    assert evaluate.repaired(base) == base and evaluate.distance(base, base) == 0.0 and len(evaluate.SPACE) == 18
    for seed in range(20):
        c = evaluate.random_config(Random(seed), base)
        for k, (low, high, unit, _) in evaluate.SPACE.items():
            v = asdict(c)[k]
            assert low - 1e-12 <= v <= high + 1e-12 and abs(v / unit - round(v / unit)) < 1e-6, k
        assert c.regex_prefix <= c.regex_full and c.medium <= c.high - 0.05 + 1e-9
    assert evaluate.repaired(replace(base, regex_full=9, regex_prefix=9, high=0.6, medium=0.7)) == replace(base, regex_full=0.6, regex_prefix=0.35, high=0.6, medium=0.55)
    assert evaluate.for_tuning("dev-01") == "dev-01"
    with pytest.raises(ValueError):
        evaluate.for_tuning("Test-02")


def test_metrics(spark):
    spec = [("E1", "a", "matched", "high", "abc"), ("E2", "a", "matched", "high", "a"), ("E3", "b", "matched", "high", "cba"), ("E4", "c", "matched", "medium", "c"), ("E5", "d", "ambiguous", "low", "efd"), ("E6", "e", "ambiguous", "low", "ed"), ("E7", "f", "unmatched", None, "df"), ("E8", "a", "unmatched", None, "bcdef"), ("E9", "b", "matched", "low", "acdeb"), ("E10", "x", "matched", "high", "x"), ("E11", None, "matched", "high", "a"), ("E12", "", "matched", "medium", "a")]
    logs = spark.createDataFrame([(i, (s, c[0] if s != "unmatched" else None, lv, [(x, 1.0) for x in c])) for i, _, s, lv, c in spec], "log_id string, match struct<status:string,statement_id:string,confidence_level:string,candidates:array<struct<statement_id:string,score:double>>>")
    truth = spark.createDataFrame([(i, "unknown" if t is None else "known" if t else "not_in_catalog", [t] if t else []) for i, t, *_ in spec], "log_id string, state string, ids array<string>")
    rows = evaluate.judged(logs, truth)
    m = evaluate.metrics(rows).first()
    assert (m.total, m.matched, m.ambiguous, m.unmatched, m.evaluable, m.not_in_catalog) == (12, 8, 2, 2, 10, 1)
    assert (m.coverage, m.coverage_with_truth, m.acc_at1, m.acc_at3, m.acc_at3_covered, m.precision_covered, m.ambiguous_evaluable, m.false_match_rate) == (10 / 12, 9 / 11, 0.5, 0.8, 7 / 8, 5 / 8, 0.2, 1.0)
    assert evaluate.metrics(rows.limit(0)).first().coverage == 0.0 and evaluate.metrics(rows.limit(0)).first().acc_at1 is None
    assert {r.confidence_level: r.events for r in evaluate.per_level(rows).collect()} == {"high": 5, "medium": 2, "low": 3}


def test_scores_leave_frequent_statements_out(spark, tmp_path):
    spec = [("a", "matched", "high", [("a", 0.9)])] * 3 + [("b", "matched", "high", [("c", 0.8), ("b", 0.8)]), ("b", "unmatched", None, [("b", 0.1)]), ("c", "matched", "low", [("d", 0.7), ("c", 0.7)]), ("c", "ambiguous", "low", [("c", 0.5), ("d", 0.4)]), ("", "matched", "low", [("a", 0.5)]), (None, "matched", None, [])]
    logs = spark.createDataFrame([(str(i), (s, c[0][0] if c and s != "unmatched" else None, lv, c)) for i, (_, s, lv, c) in enumerate(spec)], "log_id string, match struct<status:string,statement_id:string,confidence_level:string,candidates:array<struct<statement_id:string,score:double>>>")
    truth = spark.createDataFrame([(str(i), "unknown" if t is None else "known" if t else "not_in_catalog", [t] if t else []) for i, (t, *_) in enumerate(spec)], "log_id string, state string, ids array<string>")
    rows = evaluate.judged(logs, truth)
    n = evaluate.score_counts(rows).first()
    assert (n.events, n.evaluable, n.covered, n.at1, n.at3, n.high_covered, n.high_at1, n.low_covered, n.low_at1) == (9, 7, 8, 4, 7, 4, 3, 2, 1)
    assert (n.false_links, n.tied_errors, n.unmatched_errors, n.statements, n.statements_hit, n.macro_at1) == (1, 2, 1, 3, 2, 0.5)
    assert (n.control_evaluable, n.control_at1, n.control_tied_errors, n.control_acc_at1) == (2, 1, 1, 0.5)  # a and b are the most frequent, b before c
    none = evaluate.score_counts(rows.limit(0)).first()
    assert (none.events, none.coverage, none.acc_at1, none.macro_at1) == (0, 0.0, None, 0.0)
    evaluate.write_report(evaluate.per_level(rows), f"file://{tmp_path}/r")
    assert sorted(r.value for r in spark.read.text(f"file://{tmp_path}/r").distinct().collect()) == ["confidence_level,events,evaluable,at1,precision", "high,4,4,3,0.7500", "low,3,2,1,0.5000", "medium,0,0,0,"]


def test_coverage_of_loggers(spark):
    d = spark.createDataFrame([("a", "unmapped"), ("a", "mapped"), ("b", "excluded"), ("c", "unmapped"), ("d", "excluded"), ("d", "mapped")], "logger string, state string")
    assert tuple(evaluate.logger_coverage(d).first()) == (4, 1, 2, 1, 3, 100 * 2 / 3)
    assert evaluate.logger_coverage(d.limit(0)).first().percent == 100.0


def test_labels(spark):
    d = spark.createDataFrame([("a", "correct", 1), ("a", "incorrect", 2), ("b", "correct", 1), ("b", None, 2)], "log_id string, verdict string, labeled_at int")
    assert [(r.log_id, r.verdict) for r in labels.latest(d).collect()] == [("a", "incorrect")]


def test_ancestors_stop_at_cycles(spark):
    t = spark.createDataFrame([("a", "a", "b"), ("b", "b", "a"), ("c", "c", None)], "class_fqn string, type_id string, superclass_fqn string")
    assert {(r.class_fqn, r.ancestor, r.depth) for r in catalog.ancestors(t).collect()} == {("a", "a", 0), ("a", "b", 1), ("b", "b", 0), ("b", "a", 1), ("c", "c", 0)}


def test_closures_that_do_not_settle_are_errors(spark):
    import pytest

    chain = spark.createDataFrame([(f"c{i}", f"c{i}", [f"c{i + 1}"], None, "class" if i == 0 else "interface") for i in range(9)], "class_fqn string, type_id string, interfaces array<string>, superclass_fqn string, kind string")
    assert {r.interface for r in catalog.implementors(chain).collect()} == {f"c{i}" for i in range(1, 9)}
    with pytest.raises(Exception, match="longer than 2"):
        catalog.implementors(chain, rounds=2).collect()


def test_tables_on_disk(spark, tmp_path):
    from logloom.sources import store

    path = f"file://{tmp_path}/logs"
    schema = "log_id string, n int, dataset_id string"
    rows = lambda *r: spark.createDataFrame(list(r), schema)
    read = lambda: sorted(tuple(r) for r in spark.read.parquet(path).select("log_id", "n", "dataset_id").collect())
    store.create(spark, path, schema, "dataset_id")
    store.replace(rows(("a", 1, "x"), ("b", 1, "x"), ("c", 1, "y")), path)
    store.upsert(rows(("b", 2, "x"), ("d", 2, "x")), path, "log_id")
    assert read() == [("a", 1, "x"), ("b", 2, "x"), ("c", 1, "y"), ("d", 2, "x")]
    store.replace(rows(("e", 3, "x")), path)
    assert read() == [("c", 1, "y"), ("e", 3, "x")]
    assert store.exists(spark.read.parquet(path), "log_id", "e") and not store.exists(spark.read.parquet(path), "log_id", "a")
    store.export_json(rows(("a", None, "x")), f"file://{tmp_path}/j")
    assert [r.value for r in spark.read.text(f"file://{tmp_path}/j").collect()] == ['{"log_id":"a","dataset_id":"x"}']


def test_one_code_version(spark):
    import pytest

    from logloom.operators import meta

    logs = spark.createDataFrame([("a", ("p", "1")), ("b", ("p", "1")), ("b", ("p", "2")), ("c", None)], "dataset_id string, code struct<name:string,version:string>")
    assert meta.one_code_version(logs, "a") == ("p", "1")
    for d in "bcd":
        with pytest.raises(ValueError):
            meta.one_code_version(logs, d)


def test_context_of_a_log(spark):
    logs = _logs(spark, SF)
    anchor = logs.where("event_id = 5").select("log_id")
    said = spark.sql("SELECT concat('s', cast(id AS string)) AS statement_id, 'f' AS file_id, 2 AS line, 'm' AS method_id, 't' AS template FROM range(0, 7)")
    files = spark.createDataFrame([("f", "a\nb\nc\nd")], "file_id string, content string")
    called = spark.createDataFrame([("m", [("x", 1)], 1)], "method_id string, called_by array<struct<method_id:string,line:int>>, caller_count int")
    r = search.context(logs, anchor, said, files, called, 1).first()
    assert len(r.neighbours) >= 10 and 1 <= len(r.trace) <= 50 and (r.snippet is None or r.snippet == "a\nb\nc")


def test_seeded_queues_and_samples(spark):
    logs = _logs(spark, SF)
    told = spark.createDataFrame([], "log_id string, dataset_id string, verdict string, labeled_at int")
    one, again, other = ([r.log_id for r in labels.review_queue(logs, told, 20, s).collect()] for s in (1, 1, 2))
    assert one == again != other and len(set(one)) == 20
    kinds = evaluate.error_kinds(_judged(spark, SF))
    some = [r.n for r in evaluate.error_sample(kinds, 5, 3).collect()]
    assert len(some) == 5 and some == sorted(some, reverse=True)

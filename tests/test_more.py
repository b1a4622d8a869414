"""Links, reports, manifests, details, modes of candidates and ablations."""

import pytest
from pyspark.sql import functions as F

from logloom.operators import catalog, evaluate, links, match, reports, views
from logloom.sources.lines import manifest

from test_match import tables


def test_links_of_odd_names(spark):
    rows = [("dependency", "g:a.b", "1"), ("dependency", "gXa", "1"), ("dependency", "plain", "2"), ("project", "none", "3"), ("other", "g:a", "4")]
    d = spark.createDataFrame([((t, n, v), "f.java", 1, 1) for t, n, v in rows], "code_unit struct<type:string,name:string,version:string>, file_path string, line int, end_line int")
    to = links.link([], [links.Mapping("g:a.*", "r1", "{artifactId}", "{file_path}"), links.Mapping("g*", "r2", "{version}", "p")])
    assert [r.x for r in d.select(to.alias("x")).collect()] == ["r1/blob/a.b/f.java#L1", "r2/blob/1/p#L1", None, None, "r2/blob/4/p#L1"]
    assert d.select(links.link([], []).alias("x")).distinct().collect()[0].x is None
    n = links.refresh_counts(d.withColumn("link", F.lit(None).cast("string")), to).first()
    assert tuple(n) == (5, 3, 3)


def test_reports_as_files(spark, tmp_path):
    rows = spark.createDataFrame([("b|c", 0.5, None), ("a\nd", 1.0, 2)], "name string, share double, n int")
    path = f"file://{tmp_path}/r"
    reports.write_markdown([("One", rows, ["name"]), ("Two", rows.where("n = 2"), ["name"])], path)
    text = "\n".join(r.value for r in spark.read.text(path).collect())
    table = "| name | share | n |\n| --- | --- | --- |\n| a<br>d | 1.0000 | 2 |\n"
    assert text == "## One\n\n" + table + "| b\\|c | 0.5000 |  |\n\n## Two\n\n" + table
    reports.write_metrics(rows.where("n is null"), f"file://{tmp_path}/m")
    assert [r.value for r in spark.read.text(f"file://{tmp_path}/m").collect()] == ['{"name":"b|c","share":0.5,"n":null}']


def test_a_dataset_is_validated_once(spark, tmp_path):
    folder, result = f"file://{tmp_path}", spark.createDataFrame([("BETTER", 3)], "verdict string, at1 long")

    def fails():
        raise RuntimeError("no result")

    with pytest.raises(RuntimeError):
        reports.validate_once(spark, folder, "t", fails)
    assert reports.validate_once(spark, folder, "t", lambda: result).first().verdict == "BETTER"
    with pytest.raises(ValueError, match="already"):
        reports.validate_once(spark, folder, "t", lambda: result)
    assert reports.validate_once(spark, folder, "u", lambda: result).first().at1 == 3


def test_manifests(spark):
    got = manifest(spark, '{"dataset_id": "d", "oracle": true, "code": {"name": "p", "version": "1"}, "files": [{"path": "a.log", "service": "s", "module": "m"}, {"path": "b.log", "service": "s"}]}').collect()
    assert [(r.path, r.module, r.dataset_id, r.log_format, r.oracle, r.code.version) for r in got] == [("a.log", "m", "d", "spring-boot-default", True, "1"), ("b.log", None, "d", "spring-boot-default", True, "1")]
    for bad in ('{"dataset_id": "d"}', '{"files": [], "dataset_id": "d"}', '{"dataset_id": "d", "files": [{"path": "a", "service": "s"}], "odd": 1}'):
        with pytest.raises(ValueError):
            manifest(spark, bad)


def test_detail_has_all_columns(spark):
    d = views.log_detail(spark.createDataFrame([("l", ("matched",))], "log_id string, match struct<status:string>"))
    assert d.columns == list(views.DETAIL) and d.first().log_id == "l" and d.first()["match"].status == "matched" and d.first().message is None
    assert {c: t for c, t in d.dtypes if c != "match"} == {c: t for c, t in views.DETAIL.items() if c != "match"}


def test_statements_of_chosen_dependencies_apply(spark):
    unit = lambda kind, name: F.struct(F.lit(kind).alias("type"), F.lit(name).alias("name"), F.lit("1").alias("version"))
    rows = spark.createDataFrame([("own", "web")], "statement_id string, service string").withColumn("code_unit", unit("project", "p"))
    for n in ("g:a", "g:b"):
        rows = rows.union(spark.createDataFrame([(n, None)], "statement_id string, service string").withColumn("code_unit", unit("dependency", n)))
    modules = spark.createDataFrame([("m", "web", ["g:a:1", "g:b:2"]), ("n", "api", ["g:b:1"]), ("o", None, ["g:a:1"])], "module string, service string, selected_dependencies array<string>")
    assert {tuple(r) for r in catalog.applicable(rows, modules).collect()} == {("web", "own"), ("web", "g:a"), ("api", "g:b")}


def test_modes_and_ablations(spark):
    s, m, t, e = tables(spark)
    keys = match.keys_of(e)
    found = {mode: {(r.key, r.statement_id) for r in match.features(keys, s, m, t, mode=mode).collect()} for mode in ("both", "logger", "tokens")}
    assert found["both"] == found["logger"] | found["tokens"] and found["logger"] != found["tokens"] and found["tokens"]
    joined, truth = e.select(match.key_of(e).alias("key"), "log_id"), e.where("truth is not null").select("log_id", F.array("truth").alias("ids"))
    configs = {k: c for k, (c, _) in match.variants().items()}
    rows = {k: match.features(keys, s, m, t, c, mode) for k, (c, mode) in match.variants().items()}
    got = {r.variant: (r.events, r.at1) for r in evaluate.ablate(rows, joined, truth, configs).collect()}
    assert len(got) == 7 and got["full"] == (3, 3) and all(n == 3 and k <= 3 for n, k in got.values()) and got["token_candidates_only"][1] < 3

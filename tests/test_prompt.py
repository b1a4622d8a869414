"""Prompts: callers against a walk by hand, the budget against cutting one part after the other, and the text itself."""

import random

import pytest
from pyspark.sql import functions as F

from logloom.operators import prompt
from logloom.operators.prompt import CLOSING, callers_of, prompts, rendered
from logloom.plans import answers, queries


def test_callers_level_by_level(spark):
    rng = random.Random(4)
    edges = {f"m{i}": [(f"m{rng.randrange(40)}", rng.choice("ab") + "C", rng.choice("fg"), rng.randrange(9)) for _ in range(rng.randrange(8))] for i in range(40)}
    methods = spark.createDataFrame([(m, refs) for m, refs in edges.items()], "method_id string, called_by array<struct<method_id:string,class_fqn:string,method_name:string,line:int>>")
    want = []
    for root in edges:
        seen, frontier, kept = {root}, [root], []
        for depth in (1, 2, 3):
            refs, level = sorted({r for m in frontier for r in edges[m]}, key=lambda r: (r[1], r[2], r[3], r[0])), []
            for r in refs:
                if r[0] not in seen and len(level) < 5 and len(kept) < 12:
                    seen.add(r[0])
                    level.append(r[0])
                    kept.append((root, len(kept) + 1, depth, *r))
            frontier = level
        want += kept
    got = callers_of(methods, methods.select(F.col("method_id").alias("root")), 3)
    assert sorted(map(tuple, got.collect())) == sorted(want)


@pytest.mark.parametrize("budget", [0, 60, 90, 130, 170, 250, 10_000])
def test_budget_against_one_part_after_the_other(spark, budget):
    rng, rows = random.Random(budget), []
    for i in range(40):
        callers = sorted((rng.randrange(1, 4), rng.choice("xé😀") * rng.randrange(40)) for _ in range(rng.randrange(5)))
        rows.append((f"l{i}", "h" * rng.randrange(60), callers, rng.choice([None, "n" * rng.randrange(50)]), [("callers", bool(callers), None if callers else "noCallers"), ("neighbors", True, None)]))
    parts = spark.createDataFrame(rows, "log_id string, head string, callers array<struct<depth:int,text:string>>, near string, sections array<struct<id:string,included:boolean,reason:string>>")
    units = lambda t: len(t.encode("utf-16-be")) // 2

    def text(head, callers, near):
        return "\n\n".join([head, *(["\n\n".join(["# Pozivaoci", *(t for _, t in callers)])] if callers else []), *([near] if near is not None else []), CLOSING])

    for r in rendered(parts, budget).collect():
        _, head, callers, near, sections = next(x for x in rows if x[0] == r.log_id)
        told = {k: (i, w) for k, i, w in sections}
        if units(text(head, callers, near)) > budget and near is not None:
            near, told["neighbors"] = None, (False, "truncated")
        while units(text(head, callers, near)) > budget and callers:
            callers = [c for c in callers if c[0] < max(d for d, _ in callers)]
            told["callers"] = (bool(callers), "truncated")
        assert r.text == text(head, callers, near) and r.chars == units(r.text)
        assert {s.id: (s.included, s.reason) for s in r.sections} == told


def test_a_whole_prompt(spark):
    frames = "array<struct<class:string,method:string,file:string,line:int,in_project:boolean,file_id:string>>"
    logs = spark.createDataFrame(
        [("l1", "d", "web", "web.log", 1, "WARN", "a.Web", "a.Web", "main", " ", "slow  call", "2026-01-05 08:00:00,500 slow call\na.Odd: x\n\tat a.Web.go(Web.java:2)\n", ("a.Odd", [("a.Web", "go", None, 2, True, "f1"), ("a.Web", "go", None, 2, True, "f1")], []), ("matched", "s1", "high", 0.876)), ("l0", "d", "web", "web.log", 0, "INFO", None, "a.Io", "main", None, "x\ny", "raw", None, None)],
        f"log_id string, dataset_id string, service string, source_file string, sequence long, level string, logger string, logger_raw string, thread string, trace_id string, message string, raw string, exception struct<class:string,frames:{frames},caused_by:array<struct<frames:{frames}>>>, match struct<status:string,statement_id:string,confidence_level:string,confidence:double>",
    ).withColumn("ts", F.timestamp_millis(1767596400500 + F.col("sequence"))).withColumn("timestamp_raw", F.lit("2026-01-05 08:00:00,500"))
    catalog = spark.createDataFrame(
        [("s1", ("project", "shop", "0123456789"), "Web.java", 2, "a.Web", "go()", "slow {}", "f1", "m1", 1, 3, ([("if", "a  > b", 1), ("else", "c", 1), ("loop", "", 2)], [("return;", 1, "return")], [("int x;", 1)], []))],
        "statement_id string, code_unit struct<type:string,name:string,version:string>, file_path string, line int, class_fqn string, method_signature string, template string, file_id string, method_id string, method_start_line int, method_end_line int, control struct<conditions:array<struct<kind:string,text:string,line:int>>,early_exits:array<struct<text:string,line:int,exit_kind:string>>,preceding:array<struct<text:string,line:int>>,calls_before:array<struct<text:string,line:int>>>",
    )
    sources = spark.createDataFrame([("f1", "src/Web.java", "one\ntwo\nthree\nfour\n")], "file_id string, file_path string, content string")
    refs = "array<struct<method_id:string,class_fqn:string,method_name:string,line:int>>"
    methods = spark.createDataFrame([("m1", "a.Web", "go()", "Web.java", "f1", 1, 3, None, [("m2", "a.Api", "get", 4), ("m9", "x.Far", "call", 7)]), ("m2", "a.Api", "get(int)", "Api.java", "f1", 4, 4, ["GetMapping", "Deprecated"], None)], f"method_id string, class_fqn string, method_signature string, file_path string, file_id string, start_line int, end_line int, annotations array<string>, called_by {refs}")
    anchor = logs.where("log_id = 'l1'").select("log_id")
    one = prompts(logs, anchor, 4, catalog, sources, methods).first()
    assert one.text.split("\n\n") == [
        "# Log zapis\n- Servis: web\n- Vreme: 2026-01-05 08:00:00,500\n- Nivo: WARN\n- Logger: a.Web\n- Nit: main\n- Poruka: slow  call",
        "## Izuzetak\n```text\na.Odd: x\n\tat a.Web.go(Web.java:2)\n```",
        "# Mesto u kodu koje je napisalo ovaj log\n- Povezivanje: matched, pouzdanost high (0.88)\n- Kod: projekat shop @ 0123456\n- Fajl: Web.java, linija 2\n- Klasa i metoda: a.Web#go()\n- Šablon poruke: slow {}",
        "## Metoda u kojoj je log\n```java\n   1 | one\n   2 | two\n   3 | three\n```",
        "# Uslovi i tok do loga\n- Unutar: if (a > b) (linija 1)\n- Unutar: NE: c (linija 1)\n- Unutar: loop (linija 2)\n- Stiže se samo ako NIJE: return; (linija 1, return)\n- Prethodne naredbe (od najbliže):\n  - int x; (linija 1)",
        "# Kod iz stack trace-a",
        "### Web.go — src/Web.java:2\n```java\n   1 | one\n   2 | two\n   3 | three\n   4 | four\n```",
        "# Pozivaoci",
        "### Nivo 1: a.Api#get(int) — Api.java, poziv u liniji 4, REST ulaz (@GetMapping)\n```java\n   4 | four\n```",
        "### Nivo 1: x.Far#call, poziv u liniji 7",
        "# Susedni logovi istog servisa\n```text\n08:00:00.500 INFO a.Io — x y\n▶ 08:00:00.501 WARN a.Web — slow call\n```",
        CLOSING,
    ]
    assert {(s.id, s.included, s.reason) for s in one.sections} == {(k, True, None) for k in ("log", "exception", "statement", "method", "flow", "stackCode", "callers", "neighbors")}
    low = prompts(logs, logs.select("log_id"), 0, catalog, sources, methods).collect()
    assert {s.reason for r in low for s in r.sections} == {None, "level", "noException"}
    with pytest.raises(ValueError):
        prompts(logs, anchor, 5, catalog, sources, methods)


def test_levels_are_gathered_once(spark, monkeypatch):
    """The query's three levels read logs and files once, whatever the number of levels, and look neighbours up without a join of logs."""
    kept, made = prompt.written, []
    monkeypatch.setattr(prompt, "written", lambda rows, name="stage": made.append((name, rows.columns)) or kept(rows, name))
    rows = answers.prompt_sections(spark, "/root/testdata/sf0.001")
    assert [n for n, columns in made if "content" in columns or "near" in columns] == ["asked", "sources"]
    assert rows.count() == 300


@pytest.mark.parametrize("block", [10, 16, 4096])
def test_lines_around_a_log_across_blocks(spark, monkeypatch, block):
    monkeypatch.setattr(prompt, "BLOCK", block)
    rows = [("d", None if i % 17 == 0 else f"f{i % 3}", None if i % 13 == 0 else i // 2, f"l{i:03d}", None if i % 7 == 0 else f"m {i}", i % 5 == 0) for i in range(150)]
    logs = spark.createDataFrame(rows, "dataset_id string, source_file string, sequence int, log_id string, message string, wanted boolean").withColumns({"ts": F.timestamp_seconds(F.lit(0)), "level": F.lit("INFO"), "logger_raw": F.lit("a.B"), "timestamp_raw": F.lit("1970-01-01T02:00:00+02:00")})
    got = {r.log_id: r.near for r in prompt._with_near(logs, logs.where("wanted").select("log_id"), ["log_id", "timestamp_raw"]).collect()}
    want = {}
    for _, file, _, log_id, _, wanted in rows:
        if wanted:
            scope = sorted((r for r in rows if r[1] == file), key=lambda r: (r[2] is None, r[2] or 0, r[3]))
            at = next(i for i, r in enumerate(scope) if r[3] == log_id)
            lines = "\n".join(f"{'▶ ' if r[3] == log_id else ''}02:00:00.000 INFO a.B — {r[4] or ''}" for r in scope[max(0, at - 5) : at + 6])
            want[log_id] = None if file is None else f"# Susedni logovi istog servisa\n```text\n{lines}\n```"
    assert got == want


def test_places_of_events_by_stretches(spark, monkeypatch):
    """Places are those of one window over a type, and no task has a whole type."""
    monkeypatch.setattr(queries, "STRETCH", 8)
    events = spark.createDataFrame([(i * i % 97 + 100 * i, "ab"[i % 2] if i % 5 else None) for i in range(90)], "event_id long, event_type string")
    got = queries._placed_events(events)
    want = events.selectExpr("event_id", "event_type", "cast(row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1 AS bigint) AS place")
    assert sorted(map(str, got.select(*want.columns).collect())) == sorted(map(str, want.collect()))
    plan = queries._logs(spark, "/root/testdata/sf0.001").select("sequence")._jdf.queryExecution().optimizedPlan().toString()
    numbered = [line for line in plan.splitlines() if "row_number" in line]
    assert numbered and all("stretch" in line for line in numbered)

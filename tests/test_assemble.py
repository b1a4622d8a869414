import pytest
from pyspark.sql import functions as F

from logloom.operators.assemble import assemble
from logloom.sources.formats import LogbackPattern, json_lines, logback, registry, spring_boot

LOGGER = "n.h.dock.CraneControl".ljust(40)


def test_events_and_exceptions(spark):
    text = ["orphan", f"2026-09-24T10:00:00.000Z  INFO 1 --- [dock-worker-003] {LOGGER} : Lifting crate 17", f"2026-09-24T10:00:01.000Z  ERROR 1 --- [dock-worker-003] {LOGGER} : jammed", "java.io.UncheckedIOException: jammed", "\tat net.harbour.CraneControl.lift(CraneControl.java:31)", "\tat a.B.<init>(B.java:1)"]
    lines = spark.createDataFrame([("d", "f", i, x) for i, x in enumerate(text, 1)], "dataset_id string, source_file string, line_no int, text string")
    a, b, c = assemble(lines, spring_boot).orderBy("line_number").collect()
    assert (a.level, a.message, a.ts, a.sequence) == ("UNKNOWN", "orphan", None, 0)
    assert (b.line_number, b.line_count, b.message, b.exception, b.thread) == (2, 1, "Lifting crate 17", None, "dock-worker-003")
    assert (c.line_number, c.line_count, c.message) == (3, 4, "jammed")
    assert c.exception["class"] == "java.io.UncheckedIOException" and len(c.exception.frames) == 1 and c.exception.frames[0].line == 31


def test_formats(spark):
    p = logback("%d{yyyy-MM-dd HH:mm:ss.SSS} %-5level [%thread] %logger{36} - %msg%n", "Europe/Belgrade")
    row = spark.createDataFrame([("2026-01-02 10:00:00.123 WARN  [main] a.b.C - hello",)], "t string").select(p(F.col("t")).alias("h"), F.date_format(p(F.col("t"))["instant"], "HH:mm").alias("i")).first()
    assert (row.h.level, row.h.thread, row.h.logger_raw, row.h.message, row.i) == ("WARN", "main", "a.b.C", "hello", "09:00")
    j = json_lines({"timestamp": "ts", "message": "m", "level": "l"})
    got = spark.createDataFrame([('{"ts":1767348000000,"m":["a","b"],"l":"severe"}',), ('{"m":"x"}',), ("[1]",), ("no",)], "t string").select(j(F.col("t")).alias("h")).collect()
    assert (got[0].h.message, got[0].h.level) == ("a\nb", "ERROR") and [r.h for r in got[1:]] == [None] * 3
    for bad in ("%d %nope", "%m", "%d", "%d %m %X"):
        with pytest.raises(ValueError):
            LogbackPattern(bad)
    with pytest.raises(ValueError):
        registry({"x": {"type": "odd"}})


def test_traces(spark):
    """Kinds of lines: native and unknown places, module prefixes, constructors, more, causes, and what follows a trace."""
    from logloom.operators.assemble import exception_of, exception_start

    texts = [
        ["x.Y: m: n", "\tat a.B.c(Native Method)", "\tat app/d.E.f(Unknown Source) ~[na:na]", "\t... 3 more", "\tat z.Z.z(Z.java:1)"],
        ["said", "x.Y", "at a.B.c(B.java)", "Caused by: q.R: deep", "at q.R.s(R.java:9)", "... 1 common frames omitted", "Caused by: t.U", "other", "at q.R.s(R.java:9)"],
        ["only text", "at a.B.<init>(B.java:1)"],
        ["  at lone.frame(F.kt:x)"],
    ]
    d = spark.createDataFrame([(t,) for t in texts], "t array<string>").withColumn("at", exception_start(F.col("t")))
    got = d.select("at", exception_of(F.slice("t", F.greatest("at", F.lit(1)), F.size("t"))).alias("p")).collect()
    assert [r.at for r in got] == [1, 2, 0, 1]
    one = [(p["class"], p.message, [tuple(f) for f in p.frames]) for p in got[0].p]
    assert one == [("x.Y", "m: n", [("a.B", "c", None, None), ("d.E", "f", None, None)])]
    two = [(p["class"], p.message, [tuple(f) for f in p.frames]) for p in got[1].p]
    assert two == [("x.Y", None, [("a.B", "c", "B.java", None)]), ("q.R", "deep", [("q.R", "s", "R.java", 9)]), ("t.U", None, [])]
    assert [(p["class"], [tuple(f) for f in p.frames]) for p in got[3].p] == [(None, [("lone", "frame", "F.kt", None)])]


def test_events_over_the_edges_of_stretches(spark, monkeypatch):
    from logloom.operators import assemble as a

    monkeypatch.setattr(a, "CHUNK", 3)
    head = f"2026-09-24T10:00:00.000Z  INFO 1 --- [dock-worker-003] {LOGGER} : m"
    shape = [0, 0, 1, 0, 0, 0, 0, 1, 1, 0]  # 1: a header
    lines = spark.createDataFrame([("d", f, i, f"{head}{i}" if h else f"line {i}") for f, s in (("f", shape), ("g", shape[2:])) for i, h in enumerate(s, 1)], "dataset_id string, source_file string, line_no int, text string")
    got = [(r.source_file, r.sequence, r.line_number, r.line_count) for r in assemble(lines, spring_boot).orderBy("source_file", "line_number").collect()]
    assert got == [("f", 0, 1, 2), ("f", 1, 3, 5), ("f", 2, 8, 1), ("f", 3, 9, 2), ("g", 0, 1, 5), ("g", 1, 6, 1), ("g", 2, 7, 2)]

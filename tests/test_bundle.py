"""The bundle of a log, part by part."""

from pyspark.sql import functions as F

from logloom.operators.bundle import bundles


def test_bundle(spark):
    frame = "struct<class:string,method:string,file:string,line:int,in_project:boolean,file_id:string>"
    trouble = ("x.E", [("a.A", "go", "A.java", 4, True, "f1"), ("lib.L", "l", "L.java", 2, False, "f1"), ("a.A", "gone", "A.java", 99, True, "f1")], [("y.F", [("a.A", "deep", "A.java", 1, True, "f1")])])
    rows = [(f"l{i}", "d", "s", "a.log", i, "t" if i % 2 else None, "q" if i < 3 else " ", trouble if i == 2 else None, ("matched", "s1") if i == 2 else ("unmatched", None)) for i in range(6)]
    logs = spark.createDataFrame(rows, f"log_id string, dataset_id string, service string, source_file string, sequence long, thread string, trace_id string, exception struct<class:string,frames:array<{frame}>,caused_by:array<struct<class:string,frames:array<{frame}>>>>, match struct<status:string,statement_id:string>").withColumn("ts", F.timestamp_seconds("sequence"))
    catalog = spark.createDataFrame([("s1", "f1", "A.java", 3, "m1", 2, 5, "own")], "statement_id string, file_id string, file_path string, line int, method_id string, method_start_line int, method_end_line int, snippet string")
    sources = spark.createDataFrame([("f1", "\n".join(f"line {i}" for i in range(1, 11))), ("f2", "x\ny")], "file_id string, content string")
    called = [("m2", "b.B", "call", 2), ("m9", "c.C", "far", 1), *((f"n{i}", "z", "z", 1) for i in range(20))]
    methods = spark.createDataFrame([("m1", "A.java", "f1", called), ("m2", "B.java", "f2", None)], "method_id string, file_path string, file_id string, called_by array<struct<method_id:string,class_fqn:string,method_name:string,line:int>>")
    got = {r.log_id: r for r in bundles(logs, spark.createDataFrame([("l2",), ("l5",), ("l2",)], "log_id string"), catalog, sources, methods, 2).collect()}
    assert set(got) == {"l2", "l5"}
    b = got["l2"]
    lines = lambda a, z: "\n".join(f"line {i}" for i in range(a, z + 1))
    assert (b.log.sequence, b.match.status, b.statement.line, b.code.file_path, b.code.method_source, b.code.method_start_line, b.code.snippet) == (2, "matched", 3, "A.java", lines(2, 5), 2, "own")
    assert [tuple(c) for c in b.callers[:2]] == [("b.B", "call", "B.java", 2, "x\ny"), ("c.C", "far", None, 1, None)] and len(b.callers) == 10
    assert [f.snippet for f in b.exception.frames] == [lines(1, 7), None, None] and [f.snippet for f in b.exception.caused_by[0].frames] == [lines(1, 4)]
    assert (b.before, b.after, b.trace, b.trace_reason) == (["l0", "l1"], ["l3", "l4"], ["l0", "l1", "l2"], None)
    b = got["l5"]
    assert (b.statement, b.code, b.callers, b.exception, b.before, b.after, b.trace, b.trace_reason) == (None, None, [], None, ["l3", "l4"], [], [], "no-trace-id")

from pyspark.sql import functions as F

from logloom.functions import templates, text


def test_golden_ids(spark):
    row = spark.range(1).select(text.log_id(F.lit("smoke-01"), F.lit("logs/customers-service.log.gz"), F.lit(42)).alias("a"), text.stable_id(F.lit("x"), F.lit(None)).alias("b"), text.stable_id(F.lit("x"), F.lit("")).alias("c")).first()
    assert row.a == "dc37f71b0143613a6549a96547a324ad" and row.b == row.c


def test_tokens(spark):
    got = spark.createDataFrame([("Saving owner-42 x Owner Ђак 2024 ab",), (None,)], "t string").select(text.tokens(F.col("t")).alias("t")).collect()
    assert [r.t for r in got] == [["saving", "owner", "ђак", "ab"], []]


def test_levels(spark):
    got = spark.createDataFrame([(" warning",), ("FINER",), ("odd",), (None,)], "t string").select(text.normal_level(F.col("t")).alias("t")).collect()
    assert [r.t for r in got] == ["WARN", "DEBUG", "UNKNOWN", "UNKNOWN"]


def plain_parts(text):
    """Literals and holes (None) of a template, character by character."""
    parts, i = [], 0
    while i < len(text):
        if text[i] == "\\" and text[i + 1 : i + 2] in ("{", "\\"):
            piece, i = text[i + 1], i + 2
        elif text[i : i + 2] == "{}":
            piece, i = None, i + 2
        else:
            piece, i = text[i], i + 1
        if piece is None:
            parts += [None] if not parts or parts[-1] is not None else []
        elif parts and parts[-1] is not None:
            parts[-1] += piece
        else:
            parts.append(piece)
    if parts and parts[0] is not None:
        parts[0] = parts[0].lstrip()
    if parts and parts[-1] is not None:
        parts[-1] = parts[-1].rstrip()
    return [p for p in parts if p != ""]


def test_templates(spark):
    texts = ["Value={} end", r"map=\{} size={}{} ", "", "  ", "{}", " {} ", "{} {}", r"\\{} x", r"a\\\{b {}", "a\nb {} c\t", "x \\E {} y"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", templates.template_features(F.col("t")).alias("f")).collect()
    for t, f in rows:
        parts = plain_parts(t)
        literals = [p for p in parts if p is not None]
        assert (f.holes, f.literal_length, f.literals) == (len(parts) - len(literals), sum(not c.isspace() for p in literals for c in p), "\n".join(literals)), t
        assert f.template == "".join("{}" if p is None else p.replace("\\", "\\\\").replace("{", "\\{") for p in parts)
        sample = "".join("7" if p is None else p for p in parts)
        d = spark.createDataFrame([(sample, f.regex_full, f.regex_prefix)], "m string, a string, b string")
        assert d.select(F.rlike("m", F.col("a")), F.rlike("m", F.col("b"))).first()[:] == (True, True)
    f = rows[0].f
    checks = [("Value=42 end", f.regex_full), ("Value=42 end extra", f.regex_full), ("Value=42 end extra", f.regex_prefix), ("Value=42 end\n", f.regex_full)]
    got = spark.createDataFrame(checks, "m string, r string").select(F.rlike("m", F.col("r")).alias("ok"), templates.arguments(F.col("m"), F.col("r"), F.lit(1)).alias("a")).collect()
    assert [r.ok for r in got] == [True, False, True, False] and got[2].a == ["42"]


def test_parts_for_prompts(spark):
    from pyspark.sql import functions as F

    from logloom.functions import text

    rows = [("a\nb\nc\nd\ne\n", "m\nX: boom\n\tat a\n\n"), ("a", "m\n  \n"), (None, None)]
    d = spark.createDataFrame(rows, "content string, raw string")
    w = [r.w for r in d.select(text.focus_window(F.col("content"), F.lit(1), F.lit(9), F.lit(4), 3, 1).alias("w")).collect()]
    assert [tuple(x) if x else None for x in w] == [(3, "c\nd\ne", True, False), (1, "a", False, False), None]
    s = [r.s for r in d.select(text.stack_trace_text(F.col("raw"), F.lit("X"), 1).alias("s")).collect()]
    assert s == ["X: boom\n… (još 1 linija)", None, None]
    c = spark.createDataFrame([("2024-01-01T02:00:00+02:00",), ("2024-01-01 02:00:00,000",), ("2024-01-01 02:00:07",), ("2024-01-05 00:00:00",), ("",), (None,)], "raw string")
    got = c.select(text.clock_offset(F.col("raw"), F.to_timestamp(F.lit("2024-01-01T00:00:00Z"))).alias("o")).collect()
    assert [r.o for r in got] == [7200, 7200, 0, 0, 0, 0]

"""Date patterns, layouts and JSON times, value by value."""

import pytest
from pyspark.sql import functions as F

from logloom.sources.dates import DatePattern, iso_instant
from logloom.sources.formats import LogbackPattern, json_lines, logback

DATES = [
    ("dd MMM yyyy HH:mm", "05 Jan 2026 07:08", "2026-01-05 07:08:00.000"),
    ("dd MMM yyyy HH:mm", "5 Jan 2026 07:08", None),
    ("d LLLL uuuu H:m:s", "5 January 2026 7:8:9", "2026-01-05 07:08:09.000"),
    ("d MMM yyyy HH:mm", "5 Janv 2026 07:08", None),
    ("M/d/yy h:mm a", "1/5/26 12:30 AM", "2026-01-05 00:30:00.000"),
    ("M/d/yy K:mm a", "1/5/26 0:30 PM", "2026-01-05 12:30:00.000"),
    ("M/d/yy h:mm a", "1/5/26 0:30 AM", None),
    ("M/d/yy h:mm", "1/5/26 1:30", None),
    ("M/d/y k:mm", "1/5/2026 24:30", "2026-01-05 00:30:00.000"),
    ("yyyy-MM-dd HH:mm:ss", "2026-01-05 24:00:00", "2026-01-06 00:00:00.000"),
    ("yyyy-MM-dd HH:mm:ss", "2026-01-05 25:00:00", None),
    ("yyyy-MM-dd HH:mm:ss", "2025-02-30 01:02:03", "2025-02-28 01:02:03.000"),
    ("yyyy-MM-dd HH:mm:ss", "2024-02-30 01:02:03", "2024-02-29 01:02:03.000"),
    ("yyyy-MM-dd HH:mm:ss", "2024-02-32 01:02:03", None),
    ("EEE, d MMM yyyy HH", "Mon, 5 Jan 2026 07", "2026-01-05 07:00:00.000"),
    ("EEE, d MMM yyyy HH", "Tue, 5 Jan 2026 07", None),
    ("EEEE d MMM yyyy HH", "Monday 5 Jan 2026 07", "2026-01-05 07:00:00.000"),
    ("yyyyMMddHHmmssSSSSSSSSS", "20260105070809123456789", "2026-01-05 07:08:09.123"),
    ("yyyy-MM-dd'T'HH:mm:ssXXX", "2026-01-05T07:08:09+02:00", "2026-01-05 05:08:09.000"),
    ("yyyy-MM-dd'T'HH:mm:ssXXX", "2026-01-05T07:08:09Z", "2026-01-05 07:08:09.000"),
    ("yyyy-MM-dd'T'HH:mm:ssxxx", "2026-01-05T07:08:09Z", None),
    ("yyyy-MM-dd'T'HH:mm:ssX", "2026-01-05T07:08:09-0330", "2026-01-05 10:38:09.000"),
    ("yyyy-MM-dd HH:mm O", "2026-01-05 07:08 GMT+2", "2026-01-05 05:08:00.000"),
    ("yyyy-MM-dd HH:mm VV", "2026-01-05 07:08 Europe/Belgrade", "2026-01-05 06:08:00.000"),
    ("yyyy-MM-dd HH:mm z", "2026-01-05 07:08 Nowhere/Town", None),
    ("yyyy HH:mm", "2026 07:08", None),
    ("h''mm 'on' dd.MM.yyyy a", "7'05 on 05.01.2026 PM", "2026-01-05 19:05:00.000"),
]


def test_dates(spark):
    got = []
    for pattern in dict.fromkeys(p for p, _, _ in DATES):
        d, texts = DatePattern(pattern), [(t,) for p, t, _ in DATES if p == pattern]
        rows = spark.createDataFrame(texts, "t string").coalesce(1)
        groups = [F.regexp_extract("t", f"^{d.regex}$", k + 1) for k in range(len(d.fields))]
        at = F.when(F.col("t").rlike(f"^{d.regex}$"), d.instant(groups))
        got += [(pattern, r.t, r.at) for r in rows.select("t", F.date_format(at, "yyyy-MM-dd HH:mm:ss.SSS").alias("at")).collect()]
    assert sorted(got, key=str) == sorted(DATES, key=str)


@pytest.mark.parametrize("bad", ["yyyy-MM-dd HH:mm:ss Q", "yyyy 'open", "yyyy-MM-dd w"])
def test_bad_dates(bad):
    with pytest.raises(ValueError):
        DatePattern(bad)


def test_layouts(spark):
    cases = [
        ("%d{HH:mm:ss dd.MM.yyyy} %clr(%5p %clr([%t]){red}){blue} ${PID:-?} %msgs", "07:08:09 05.01.2026  WARN [a b] 12 hellos", ("WARN", "a b", None, "12", "hello")),
        ("%d %m %p", "2026-01-05 07:08:09,123 it's 5 %% up ERROR", ("ERROR", None, None, None, "it's 5 %% up")),
        ("%d %-20.20logger|%m", "2026-01-05 07:08:09,123 com.shop.Web        |x", ("UNKNOWN", None, "com.shop.Web", None, "x")),
        ("%d [%10thread] %m", "2026-01-05 07:08:09,123 [      main] x", ("UNKNOWN", "main", None, None, "x")),
        ("%d %C.%M:%L %X{id} %pid - %m%n", "2026-01-05 07:08:09,123 a.B.run:7 u-1 44 - x", ("UNKNOWN", None, None, "44", "x")),
    ]
    for pattern, line, want in cases:
        h = spark.createDataFrame([(line,), ("other",)], "t string").select(logback(pattern)(F.col("t")).alias("h")).collect()
        assert (h[0].h.level, h[0].h.thread, h[0].h.logger_raw, h[0].h.pid, h[0].h.message) == want and h[1].h is None
    for bad in ("%d %m ${HOME}", "%d %m %clr(x", "%d %m %.x", "%d{yyyy %m", ""):
        with pytest.raises(ValueError):
            LogbackPattern(bad)


def test_json_times(spark):
    parse = json_lines({"timestamp": "t", "message": "m"})
    rows = [("1", "1970-01-01 00:00:00.001"), ("-5", "1969-12-31 23:59:59.995"), ("1767596889123.9", "2026-01-05 07:08:09.123"), ('"2026-01-05T07:08:09.5Z"', "2026-01-05 07:08:09.500"), ('"2026-01-05T07:08+02"', "2026-01-05 05:08:00.000"), ('"2026-01-05T07:08:09"', None), ('"1767596889123"', None), ('"2026-02-30T07:08:09Z"', None), ("true", None), ("null", None), ("{}", None)]
    d = spark.createDataFrame([(i, f'{{"t": {t}, "m": "x"}}') for i, (t, _) in enumerate(rows)], "i int, t string").select("i", parse(F.col("t")).alias("h"))
    assert [r.at for r in d.select("i", F.date_format("h.instant", "yyyy-MM-dd HH:mm:ss.SSS").alias("at")).orderBy("i").collect()] == [w for _, w in rows]


def test_instants_do_not_depend_on_the_session(spark):
    before = spark.conf.get("spark.sql.session.timeZone")
    try:
        seen = []
        for zone in ("UTC", "America/New_York"):
            spark.conf.set("spark.sql.session.timeZone", zone)
            row = spark.createDataFrame([("2026-01-05T07:08:09+02:00", "2026-01-05 07:08:09,123 x")], "a string, b string")
            seen.append(row.select(F.unix_millis(iso_instant(F.col("a"))), F.unix_millis(logback("%d %m", "Europe/Belgrade")(F.col("b"))["instant"])).first())
        assert seen[0] == seen[1]
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


def test_json_of_a_line_is_parsed_once(spark):
    from logloom.sources.formats import json_lines

    h = json_lines({"timestamp": "t", "message": "m", "level": "l"})(F.col("line"))
    rows = spark.createDataFrame([('{"t": "2024-01-02T03:04:05Z", "m": ["a", "b"], "l": "warn"}',), ('{"t": 1.5, "m": "x"}',), ('{"t": "1", "m": "x"}',)], "line string").select(h.alias("h"))
    assert rows._jdf.queryExecution().optimizedPlan().toString().lower().count("parsejson") + rows._jdf.queryExecution().optimizedPlan().toString().lower().count("parse_json") <= 2
    assert [r.h and (r.h.message, r.h.level) for r in rows.collect()] == [("a\nb", "WARN"), ("x", "UNKNOWN"), None]

"""Queries that read lines of many layouts: Logback patterns, JSON times, and the branches of assembly."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.templates import message_format_template, printf_template, template_features
from ..operators import assemble
from ..sources.formats import json_lines, logback, spring_boot
from .derive import LOGS
from .queries import _sql

#: Layouts: the pattern, how Spark prints its date, and how the rest of a line is made of an event.
PATTERNS = [
    ("%d{dd MMM yyyy HH:mm:ss.SSS} %-5level [%15.15t] %logger{36} - %msg%n", "dd MMM yyyy HH:mm:ss.SSS", "concat(' ', rpad(level, 5, ' '), ' [', rpad(thread, 15, ' '), '] com.shop.', service, ' - ', message)"),
    ("%d{MM/dd/yyyy hh:mm:ss a} %p %c{1} %m%n", "MM/dd/yyyy hh:mm:ss a", "concat(' ', lower(level), ' com.shop.', service, ' ', message)"),
    ("%d{uuuu-MM-dd'T'HH:mm:ss,SSSxxx} %pid --- [%thread] %logger : %msg", "yyyy-MM-dd'T'HH:mm:ss,SSSxxx", "concat(' 77 --- [', thread, '] com.shop.', service, ' : ', message)"),
    ("%date{d/M/yy H:m:s} %level ${PID:- } %logger %msg", "d/M/yy H:m:s", "concat(' ', level, ' 8 com.shop.', service, ' ', message)"),
    ("%d{EEE, d MMMM yyyy HH:mm:ss Z} %clr(%5p){faint} %clr([%t]){blue} %msg", "EEE, d MMMM yyyy HH:mm:ss Z", "concat(' ', lpad(level, 5, ' '), ' [', thread, '] ', message)"),
    ("%d{yyyyMMdd HHmmssSSS VV} %le %lo{0} 100%% %message", "yyyyMMdd HHmmssSSS VV", "concat(' ', level, ' com.shop.', service, ' 100% ', message)"),
    ("%d %p %X{user} %m", "yyyy-MM-dd HH:mm:ss,SSS", "concat(' ', level, ' ', thread, ' ', message)"),
    ("%d{dd/MM/yyyy HH:mm} %p %m", "d/MM/yyyy HH:mm", "concat(' ', level, ' ', message)"),
    ("%d{EEEE dd MMM yyyy kk:mm:ss} %p %m", "'Monday' dd MMM yyyy kk:mm:ss", "concat(' ', level, ' ', message)"),
]


def logback_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A line of each layout in turn. The last two are met only by days of two digits, and by Mondays."""
    rows = _sql(spark, sf_dir, LOGS, "events").withColumn("k", (F.col("event_id") % len(PATTERNS)).cast("int"))
    line, header = F.lit(None).cast("string"), None
    for k, (_, date, rest) in enumerate(PATTERNS):
        line = F.when(F.col("k") == k, F.concat(F.date_format("ts", date), F.expr(rest))).otherwise(line)
    rows = rows.select("event_id", "k", line.alias("line"))
    for k, (pattern, _, _) in enumerate(PATTERNS):
        found = F.when(F.col("k") == k, logback(pattern)(F.col("line")))
        header = found if header is None else F.coalesce(header, found)
    h = rows.select("event_id", "k", header.alias("h"))
    return h.select("event_id", "k", F.date_format("h.instant", "yyyy-MM-dd HH:mm:ss.SSS").alias("ts"), "h.level", "h.thread", "h.logger_raw", "h.pid", "h.message")


def json_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Times as numbers, with and without offsets, as digits in a string, as dates."""
    stamp = """CASE event_id % 9 WHEN 0 THEN cast(unix_millis(ts) AS string) WHEN 1 THEN concat('"', date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSS"), 'Z"') WHEN 2 THEN concat('"', date_format(ts, "yyyy-MM-dd'T'HH:mm:ss"), '+02:00"')
      WHEN 3 THEN concat('"', date_format(ts, "yyyy-MM-dd'T'HH:mm:ss"), '"') WHEN 4 THEN concat('"', cast(unix_millis(ts) AS string), '"') WHEN 5 THEN concat('"', date_format(ts, 'yyyy-MM-dd'), '"') WHEN 6 THEN cast(-event_id AS string)
      WHEN 7 THEN concat('"', date_format(ts, "yyyy-MM-dd't'HH:mm"), '-0330"') ELSE 'true' END"""
    rows = _sql(spark, sf_dir, LOGS, "events").select("event_id", F.concat(F.lit('{"at": '), F.expr(stamp), F.lit(', "text": "'), F.col("message"), F.lit('"}')).alias("line"))
    h = rows.withColumn("h", json_lines({"timestamp": "at", "message": "text"})(F.col("line")))
    return h.select("event_id", F.date_format("h.instant", "yyyy-MM-dd HH:mm:ss.SSS").alias("ts"), "h.level", "h.message")


def _pad(c: Column, n: int) -> Column:
    return F.rpad(F.substring(c, 1, n), n, " ")


def assembly_branches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of files with colours, application names, correlation ids in either case, and marks of the truth in files that are known to have them."""
    rows = _sql(spark, sf_dir, LOGS, "events").withColumn("file", F.concat(F.lit("f"), (F.col("event_id") % 40).cast("string"), F.lit(".log")))
    digits = F.md5(F.col("event_id").cast("string"))
    digits = F.concat(digits, F.lit("-"), F.substring(digits, 1, 16))
    group = F.element_at(F.array(F.upper(digits), digits, F.lit("not ids"), F.lit("")), (F.col("event_id") % 4 + 1).cast("int"))
    mark = F.concat(F.lit("@@L2C["), F.element_at(F.array(F.concat(F.lit("com.shop."), F.col("service")), F.lit("com.shop.Proxy"), F.lit("?")), (F.col("event_id") % 3 + 1).cast("int")), F.lit("|run|"), F.when(F.col("event_id") % 5 == 0, "?").otherwise((F.col("event_id") % 90).cast("string")), F.lit("]@@ "))
    told = F.concat(mark, F.col("message"))
    level = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("\u001b[32m"), F.lpad("level", 5, " "), F.lit("\u001b[0;39m"))).otherwise(F.lpad("level", 5, " "))
    line = F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSS"), F.lit("Z "), level, F.lit(" 9 --- [shop] ["), _pad(F.col("thread"), 15), F.lit("] ["), _pad(group, 49), F.lit("] "), _pad(F.concat(F.lit("com.shop."), F.col("service")), 40), F.lit(" : "), told)
    order = Window.partitionBy("file").orderBy("event_id")
    lines = rows.select("dataset_id", F.col("file").alias("source_file"), F.row_number().over(order).alias("line_no"), line.alias("text"))
    files = rows.select(F.col("file").alias("path")).distinct()
    number = F.regexp_extract("path", r"\d+", 0).cast("int")
    files = files.where(number < 30).select("path", F.concat(F.lit("svc"), (number % 3).cast("string")).alias("service"), F.lit("m").alias("module"), F.struct(F.lit("shop").alias("name"), F.lit("1").alias("version")).alias("code"), (number % 2 == 1).alias("oracle"), F.lit("spring-boot-default").alias("log_format"))
    e = assemble.assemble(lines, spring_boot, files, ("com.shop.Proxy",))
    truth = F.col("ground_truth")
    return e.select("source_file", "line_number", "sequence", "service", "module", F.col("code.version").alias("version"), "app_name", "level", "trace_id", "span_id", "message", truth["class"].alias("truth_class"), truth["method"].alias("truth_method"), truth["line"].alias("truth_line"), truth["reliable"].alias("reliable"), F.col("parser_format").alias("format"))


def format_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of parts inside printf and MessageFormat templates: their form with holes, and the size of their text."""
    n, size = F.col("p_name"), F.col("p_size").cast("string")
    texts = [
        F.concat(F.lit("100%% of %s in "), n, F.lit(" at %5.2f%n")),
        F.concat(F.lit("%d%-3s "), n, F.lit(" %"), size, F.lit("$s")),
        F.concat(n, F.lit(" %tH:%tM %q %, 50% off")),
        F.concat(F.lit("It''s {0,number,#.##} of "), n, F.lit(" {x} {1}")),
        F.concat(F.lit("'{0}' {"), n, F.lit("} {2,choice,0#none|1#one}{3}")),
        F.concat(n, F.lit(" \\ {10} {,} {1,{2}}")),
    ]
    k = (F.col("p_partkey") % 6).cast("int")
    p = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", k.alias("k"), F.element_at(F.array(*texts), k + 1).alias("raw"))
    p = p.withColumn("f", template_features(F.when(F.col("k") < 3, printf_template(F.col("raw"))).otherwise(message_format_template(F.col("raw")))))
    return p.select("p_partkey", "f.template", F.col("f.holes").cast("int").alias("holes"), F.col("f.literal_length").cast("int").alias("literal_length"))


QUERIES = {f.__name__: f for f in (logback_patterns, json_times, assembly_branches, format_templates)}

_E = f"WITH l AS ({LOGS.replace(' AS string)', ' AS varchar)')})"
_MS, _S = "strftime({}, '%Y-%m-%d %H:%M:%S.%g')", "date_trunc('second', ts)"

ORACLE_SQL = {
    "logback_patterns": f"""{_E}, k AS (SELECT *, cast(event_id % 9 AS integer) AS k FROM l), h AS (SELECT *, CASE WHEN k = 7 THEN extract(day FROM ts) >= 10 WHEN k = 8 THEN dayofweek(ts) = 1 ELSE true END AS ok FROM k)
      SELECT event_id, k, CASE WHEN ok THEN {_MS.format(f"CASE WHEN k IN (0, 2, 5, 6) THEN ts WHEN k = 7 THEN date_trunc('minute', ts) ELSE {_S} END")} END AS ts, CASE WHEN ok THEN CASE WHEN k = 2 THEN 'UNKNOWN' ELSE level END END AS level,
        CASE WHEN k IN (0, 2, 4) THEN thread END AS thread, CASE WHEN k IN (0, 1, 2, 3, 5) THEN concat('com.shop.', service) END AS logger_raw, CASE k WHEN 2 THEN '77' WHEN 3 THEN '8' END AS pid, CASE WHEN ok THEN message END AS message FROM h""",
    "format_templates": r"""WITH t AS (SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN concat('100% of {} in ', p_name, ' at {}') WHEN 1 THEN concat('{} ', p_name, ' {}') WHEN 2 THEN concat(p_name, ' {}:{} {} %, 50{}ff')
        WHEN 3 THEN concat('It''s {} of ', p_name, ' \{x} {}') WHEN 4 THEN concat(chr(39), '{}', chr(39), ' \{', p_name, '} {}') ELSE concat(p_name, ' \\ {} \{,} \{1,{}}') END AS template FROM part)
      SELECT p_partkey, template, cast(len(string_split(template, '{}')) - 1 AS integer) AS holes, cast(length(regexp_replace(regexp_replace(replace(template, '{}', ''), '\\(.)', '\1', 'g'), '\s', '', 'g')) AS integer) AS literal_length FROM t""",
    "json_times": f"""{_E}, t AS (SELECT event_id, message, CASE event_id % 9 WHEN 0 THEN ts WHEN 1 THEN ts WHEN 2 THEN {_S} - INTERVAL 2 HOUR WHEN 6 THEN TIMESTAMP '1970-01-01 00:00:00' - to_milliseconds(event_id) WHEN 7 THEN date_trunc('minute', ts) + INTERVAL 210 MINUTE END AS ts FROM l)
      SELECT event_id, {_MS.format("ts")} AS ts, CASE WHEN ts IS NOT NULL THEN 'UNKNOWN' END AS level, CASE WHEN ts IS NOT NULL THEN message END AS message FROM t""",
    "assembly_branches": f"""{_E}, f AS (SELECT *, cast(event_id % 40 AS integer) AS f, row_number() OVER (PARTITION BY event_id % 40 ORDER BY event_id) AS n, md5(cast(event_id AS varchar)) AS d,
        CASE event_id % 3 WHEN 0 THEN concat('com.shop.', service) WHEN 1 THEN 'com.shop.Proxy' ELSE '?' END AS c, CASE WHEN event_id % 5 = 0 THEN '?' ELSE cast(event_id % 90 AS varchar) END AS w FROM l),
      g AS (SELECT *, f < 30 AS known, f < 30 AND f % 2 = 1 AS marked, CASE WHEN event_id % 4 = 0 THEN upper(d) WHEN event_id % 4 = 1 THEN d END AS t FROM f)
      SELECT concat('f', f, '.log') AS source_file, cast(n AS integer) AS line_number, n - 1 AS sequence, CASE WHEN known THEN concat('svc', f % 3) END AS service, CASE WHEN known THEN 'm' END AS module, CASE WHEN known THEN '1' END AS version, 'shop' AS app_name, level, t AS trace_id, t[1:16] AS span_id,
        CASE WHEN marked THEN message ELSE concat('@@L2C[', c, '|run|', w, ']@@ ', message) END AS message, CASE WHEN marked THEN nullif(c, '?') END AS truth_class, CASE WHEN marked THEN 'run' END AS truth_method, CASE WHEN marked THEN try_cast(w AS integer) END AS truth_line,
        CASE WHEN marked THEN c NOT IN ('?', 'com.shop.Proxy') AND w <> '?' END AS reliable, CASE WHEN known THEN 'spring-boot-default' END AS format FROM g""",
}

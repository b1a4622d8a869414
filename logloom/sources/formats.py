"""Log line formats: each gives a function from a line to a header struct, null for lines that open no event."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import blank_to_null, normal_level, once, strip_ansi
from .dates import DatePattern, iso_instant

FIELDS = ("timestamp_raw", "instant", "level", "pid", "app_name", "thread", "correlation_raw", "logger_raw", "message", "stack_trace", "trace_id", "span_id")

#: Fixed value: the default console layout of Spring Boot.
SPRING_BOOT = r"^(\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}\.\d{3}(?:Z|[+-]\d{2}:\d{2})) +([A-Z]+) (\d+) --- (?:\[([^\]]*)\] )?\[(.{15})\] (?:\[(.{49})\] )?(.{40}) : (.*)$"

#: Fields of a header that JSON configurations name otherwise.
FIELD_OF = {"logger": "logger_raw"}

Parser = Callable[[Column], Column]


def _header(ok: Column, **fields: Column) -> Column:
    return F.when(ok, F.struct(*[fields.get(f, F.lit(None).cast("timestamp" if f == "instant" else "string")).alias(f) for f in FIELDS]))


#: Stands between the groups of a line that was taken apart; a line that holds it is no header.
_CUT = "\u0001\u0002"


def _taken_apart(line: Column, regex: str, groups: int, header: Callable[[list[Column]], Column]) -> Column:
    """``header`` of the groups of an anchored expression, null where it does not match: the expression runs once over a line, and the groups are cut from what it leaves."""
    plain = strip_ansi(line)
    parts = F.split(F.regexp_replace(plain, regex, _CUT.join(f"${i + 1}" for i in range(groups))), _CUT, groups)
    found = F.when(~plain.contains(_CUT), parts)
    return F.get(F.transform(F.array(found), lambda p: F.when(F.size(p) == groups, header([F.get(p, i) for i in range(groups)]))), 0)


def spring_boot(line: Column) -> Column:
    def header(g: list[Column]) -> Column:
        instant = F.try_to_timestamp(g[0], F.lit("yyyy-MM-dd'T'HH:mm:ss.SSSXXX"))
        return _header(instant.isNotNull(), timestamp_raw=g[0], instant=instant, level=normal_level(g[1]), pid=g[2], app_name=blank_to_null(g[3]), thread=F.trim(g[4]), correlation_raw=F.nullif(g[5], F.lit("")), logger_raw=F.trim(g[6]), message=g[7])

    # a header has these characters at fixed places: most other lines are told apart without the expression
    likely = (F.substring(strip_ansi(line), 5, 1) == "-") & (F.substring(strip_ansi(line), 11, 1) == "T")
    return F.when(likely, _taken_apart(line, SPRING_BOOT, 8, header))


# ---- Logback patterns: compiled once on the driver to one regular expression

#: Conversion words by field, and the expressions of their values.
WORDS = {"d": "date", "date": "date", "p": "level", "le": "level", "level": "level", "t": "thread", "thread": "thread", "c": "logger", "lo": "logger", "logger": "logger", "C": "class", "class": "class", "M": "method", "method": "method", "L": "line", "line": "line", "m": "message", "msg": "message", "message": "message", "pid": "pid", "X": "mdc", "n": "newline"}
VALUES = {"level": "[A-Za-z]+", "thread": ".+?", "logger": ".+?", "class": ".+?", "method": ".+?", "line": r"\d+", "pid": r"\d+", "mdc": r"\S*", "message": ".*"}
DEFAULT_DATE = "yyyy-MM-dd HH:mm:ss,SSS"

#: The longest word that the letters start with is meant; what follows it is text.
_WORD = "|".join(sorted(WORDS, key=len, reverse=True))
_CONVERSION = re.compile(rf"%-?(?P<min>\d+)?(?:\.(?P<max>\d+))?(?P<word>{_WORD})(?:\{{(?P<option>(?:'[^']*'|[^}}'])*)\}})?")
_WRAPPED = re.compile(r"%-?\d*(?:\.\d+)?(?:clr|highlight|black|red|green|yellow|blue|magenta|cyan|white|gray|bold\w*)\(")


def _tokens(pattern: str) -> list[re.Match | str]:
    """Conversions, PID properties (as the string %pid) and characters, without the colour words around their contents."""
    out, at = [], 0
    while at < len(pattern):
        if pattern.startswith("%%", at):
            out.append("%")
            at += 2
        elif pattern.startswith("${", at):
            end = pattern.find("}", at)
            if end < 0 or pattern[at + 2 : end].split(":")[0].upper() != "PID":
                raise ValueError(f"no such property: {pattern[at : at + 20]}")
            out.append(_CONVERSION.match("%pid"))
            at = end + 1
        elif m := _WRAPPED.match(pattern, at):
            end, depth = m.end(), 1
            while depth and end < len(pattern):
                depth += {"(": 1, ")": -1}.get(pattern[end], 0)
                end += 1
            if depth:
                raise ValueError(f"a parenthesis is not closed: {pattern[at:]}")
            out += _tokens(pattern[m.end() : end - 1])
            colour = re.compile(r"\{[^}]*\}").match(pattern, end)
            at = colour.end() if colour else end
        elif pattern[at] == "%":
            m = _CONVERSION.match(pattern, at)
            if m is None or pattern.startswith("{", m.end()):
                raise ValueError(f"no such conversion word: {pattern[at : at + 12]}")
            out.append(m)
            at = m.end()
        else:
            out.append(pattern[at])
            at += 1
    return out


class LogbackPattern:
    """``regex`` with groups; ``places``: field, first of its groups, and whether its width is fixed (then padding is trimmed).

    Unknown words, properties other than PID, an MDC word without a key, and patterns without date or message are errors.
    """

    def __init__(self, pattern: str):
        out, self.places, self.groups, self.date = [], [], 0, None
        for t in _tokens(pattern):
            if isinstance(t, str):
                out.append(re.escape(t))
                continue
            field = WORDS[t["word"]]
            if field == "newline":
                continue
            if field == "mdc" and t["option"] is None:
                raise ValueError("%X needs a key")
            low, high = (int(t[k]) if t[k] else 0 for k in ("min", "max"))
            fixed, inner = low > 0 and low == high, 0
            if field == "date":
                self.date = DatePattern(DEFAULT_DATE if t["option"] is None else t["option"])
                value, inner = self.date.regex, len(self.date.fields)
            else:
                value = f".{{{low}}}" if fixed else VALUES[field]
            pad = r"\s*" if low and not fixed and field != "date" else ""
            out.append(f"{pad}({value}){pad}")
            self.places.append((field, self.groups, fixed))
            self.groups += 1 + inner
        if self.date is None or "message" not in [p[0] for p in self.places]:
            raise ValueError("a pattern needs a date and a message")
        self.regex = "^" + "".join(out) + "$"


def logback(pattern: str, zone: str = "UTC") -> Parser:
    """Header lines of a Logback pattern; times without a zone of their own are in ``zone``. Of a repeated field the last one counts."""
    compiled = LogbackPattern(pattern)

    def header(g: list[Column]) -> Column:
        raw, dates = {}, None
        for field, at, fixed in compiled.places:
            raw[field] = F.trim(g[at]) if fixed else g[at]
            dates = g[at + 1 : at + 1 + len(compiled.date.fields)] if field == "date" else dates
        instant = compiled.date.instant(dates, zone)
        told = {"timestamp_raw": raw["date"], "instant": instant, "message": raw["message"], "level": normal_level(raw.get("level", F.lit(None).cast("string")))}
        told |= {k: raw[f] for k, f in (("thread", "thread"), ("logger_raw", "logger"), ("pid", "pid")) if f in raw}
        return _header(instant.isNotNull(), **told)

    return lambda line: _taken_apart(line, compiled.regex, compiled.groups, header)


def json_lines(fields: dict[str, str]) -> Parser:
    """``fields`` names the JSON field of timestamp and message, which every event needs, and of the others where there are any."""
    if not {"timestamp", "message"} <= fields.keys():
        raise ValueError("timestamp and message are needed")

    texts = [f for f in ("thread", "logger", "message", "stack_trace", "trace_id", "span_id") if f in fields]

    def parse(line: Column) -> Column:
        # each step is a struct that is made once a line: the JSON is parsed once, and each field is taken once
        def taken(variant: Column) -> Column:
            def get(name: str, kind: str = "string") -> Column:
                return F.try_variant_get(variant, f"$['{fields[name]}']", kind) if name in fields else F.lit(None).cast(kind)

            stamp = get("timestamp", "variant")
            own = [F.schema_of_variant(variant).startswith("OBJECT").alias("object"), get("timestamp").alias("stamp"), F.schema_of_variant(stamp).alias("kind"), get("level").alias("level")]
            own.append(stamp.alias("value"))
            return F.struct(*own, *[x for f in texts for x in (get(f, "array<string>").alias(f"{f}_list"), get(f).alias(f))])

        def read(p: Column) -> Column:
            def text(name: str) -> Column:
                many = p[f"{name}_list"]
                return F.when(many.isNull(), p[name]).when(F.size(many) > 0, F.array_join(many, "\n"))

            # a number of any size is milliseconds of the epoch, a string must be an ISO time with an offset
            double = F.try_variant_get(p["value"], "$", "double")
            millis = F.coalesce(F.try_variant_get(p["value"], "$", "long"), F.when(F.abs(double) < 9.2e15, double.cast("long")))
            number = F.when(F.abs(millis) < 9_200_000_000_000_000, F.timestamp_millis(millis))
            instant = F.when(p["kind"].rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)"), number).when(p["kind"] == "STRING", iso_instant(p["stamp"]))
            level = F.when(p["level"].isNotNull(), normal_level(p["level"])).otherwise(F.lit("UNKNOWN"))
            return F.struct(F.coalesce(p["object"], F.lit(False)).alias("object"), p["stamp"].alias("timestamp_raw"), instant.alias("instant"), level.alias("level"), *[text(f).alias(FIELD_OF.get(f, f)) for f in texts])

        def header(h: Column) -> Column:
            names = ["timestamp_raw", "instant", "level", *[FIELD_OF.get(f, f) for f in texts]]
            return _header(h["object"] & h["instant"].isNotNull() & h["message"].isNotNull(), **{f: h[f] for f in names})

        return once(once(once(F.try_parse_json(line), taken), read), header)

    return parse


def registry(formats: dict[str, dict]) -> dict[str, Parser]:
    """Parsers by name from a configuration: type preset, logback-pattern (pattern, timezone) or json (fields)."""
    made = {}
    for name, f in formats.items():
        kind = f.get("type")
        if kind == "preset":
            made[name] = spring_boot
        elif kind == "logback-pattern":
            made[name] = logback(f["pattern"], f.get("timezone", "UTC"))
        elif kind == "json":
            made[name] = json_lines(f["fields"])
        else:
            raise ValueError(f"{name}: no such type: {kind}")
    return made

"""Date patterns of log layouts as one regular expression with a group for each field, and timestamps out of these groups.

Every field of a pattern is cut out by its own group and put together by Spark's functions, so the letters that Spark's
own date parser refuses (names of days, zones of several forms) are read, and results depend on no session setting. A
value must be what the pattern would print: ``dd`` has two digits and ``d`` one or two, ``MMM`` is ``Jan`` and ``MMMM``
``January``, ``hh`` needs ``a``. Days that a month does not have become its last day; a name of a day must fit the date.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import once

#: Names in the neutral locale; the short ones are their first three letters.
MONTHS = ("January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December")
DAYS = ("Sunday", "Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday")

#: A letter of a date pattern: its field. A second field of the same kind is only matched.
FIELDS = {"y": "year", "u": "year", "M": "month", "L": "month", "d": "day", "H": "hour", "k": "hour24", "h": "hour12", "K": "hour11", "m": "minute", "s": "second", "S": "fraction", "a": "half", "E": "weekday", "e": "weekday", "c": "weekday", "z": "zone", "Z": "offset", "X": "offset", "x": "offset", "O": "gmt", "V": "zone"}

_NEVER = "(?!)"


def _names(names: tuple[str, ...], count: int) -> str:
    return "|".join(n[:3] if count == 3 else n for n in names) if count in (3, 4) else _NEVER


def _value(letter: str, n: int) -> str:
    kind = FIELDS[letter]
    if kind == "year":
        return rf"\d{{{n}}}" if n >= 2 else r"\d{1,4}"
    if kind == "month" and n > 2:
        return _names(MONTHS, n)
    if kind in ("month", "day", "minute", "second") or kind.startswith("hour"):
        return {1: r"\d{1,2}", 2: r"\d{2}"}.get(n, _NEVER)
    if kind == "fraction":
        return rf"\d{{{n}}}"
    if kind == "half":
        return "AM|PM"
    if kind == "weekday":
        return _names(DAYS, 3 if letter == "E" and n < 3 else n)
    if kind == "offset":
        told = {"Z": {1: r"[+-]\d{4}", 2: r"[+-]\d{4}", 3: r"[+-]\d{4}"}, "X": {1: r"[+-]\d{2}(?:\d{2})?", 2: r"[+-]\d{4}", 3: r"[+-]\d{2}:\d{2}"}}["Z" if letter == "Z" else "X"].get(n, _NEVER)
        return f"Z|{told}" if letter == "X" else told
    if kind == "gmt":
        return r"GMT(?:[+-]\d{1,2}(?::\d{2})?)?"
    return "[A-Za-z0-9+:/ ]+" if letter == "z" else "Z|[A-Za-z0-9+:/_-]+"


class DatePattern:
    """``regex`` has a group for each entry of ``fields``: (field, number of letters). An unknown letter or an open quote is an error."""

    def __init__(self, pattern: str):
        self.fields: list[tuple[str, int]] = []
        out = []
        for m in re.finditer(r"''|'([^']*)'|(([A-Za-z])\3*)|(.)", pattern, re.S):
            if m[2]:
                letter, n = m[2][0], len(m[2])
                if letter not in FIELDS:
                    raise ValueError(f"date pattern {pattern!r}: no such letter: {letter}")
                out.append(f"({_value(letter, n)})")
                self.fields.append((FIELDS[letter], n))
            elif m[4] == "'":
                raise ValueError(f"date pattern {pattern!r}: a quote is not closed")
            else:
                out.append(re.escape("'" if m[0] == "''" else m[1] if m[1] is not None else m[4]))
        self.regex = "".join(out)

    def instant(self, groups: list[Column], zone: str = "UTC") -> Column:
        """The timestamp of the groups' values; in ``zone`` if the pattern names none. Null where they are no time, and for patterns without a whole date and an hour."""
        raw, count = {}, {}
        for (kind, n), g in zip(self.fields, groups, strict=True):
            raw.setdefault(kind, g)
            count.setdefault(kind, n)
        number = {k: raw[k].try_cast("int") for k in raw if k not in ("half", "weekday", "zone", "offset", "gmt", "fraction")}
        none = F.lit(None).cast("timestamp")
        if not {"year", "month", "day"} <= raw.keys():
            return none
        year = number["year"] + 2000 if count["year"] == 2 else number["year"]
        names = [n[:3] if count["month"] == 3 else n for n in MONTHS]
        month = F.nullif(F.array_position(F.array(*map(F.lit, names)), raw["month"]), F.lit(0)).cast("int") if count["month"] > 2 else number["month"]
        leap = (year % 4 == 0) & ((year % 100 != 0) | (year % 400 == 0))
        last = F.when(month.isin(4, 6, 9, 11), 30).when(month == 2, F.when(leap, 29).otherwise(28)).otherwise(31)
        day = F.when(number["day"] <= 31, F.least(number["day"], last))
        if "hour" in raw:
            hour = number["hour"]
        elif "hour24" in raw:
            hour = F.when(number["hour24"].between(1, 24), number["hour24"] % 24)
        elif "half" in raw and ("hour12" in raw or "hour11" in raw):
            short = F.when(number["hour12"].between(1, 12), number["hour12"] % 12) if "hour12" in raw else F.when(number["hour11"] < 12, number["hour11"])
            hour = short + F.when(raw["half"] == "PM", 12).otherwise(0)
        else:
            return none
        minute, second = number.get("minute", F.lit(0)), number.get("second", F.lit(0))
        seconds = F.concat_ws(".", second.cast("string"), F.substring(raw["fraction"], 1, 6) if "fraction" in raw else F.lit("0")).try_cast("decimal(16,6)")
        midnight = (hour == 24) & (minute == 0) & (seconds == 0)
        place = zone_of(raw["offset"]) if "offset" in raw else gmt_of(raw["gmt"]) if "gmt" in raw else F.when(raw["zone"] == "Z", "UTC").otherwise(raw["zone"]) if "zone" in raw else F.lit(zone)
        at = F.try_make_timestamp(year, month, day, F.when(midnight, 0).otherwise(hour), minute, seconds, place)
        at = F.when(second < 60, at + F.when(midnight, F.expr("interval 1 day")).otherwise(F.expr("interval 0 day")))
        if "weekday" in raw:
            date = F.concat_ws("-", F.lpad(year.cast("string"), 4, "0"), F.lpad(month.cast("string"), 2, "0"), F.lpad(day.cast("string"), 2, "0")).try_cast("date")
            at = F.when(F.substring(raw["weekday"], 1, 3) == F.get(F.array(*(F.lit(d[:3]) for d in DAYS)), F.dayofweek(date) - 1), at)
        return at


def zone_of(offset: Column) -> Column:
    """An offset (Z, +hh, +hhmm or +hh:mm) as +hh:mm."""
    digits = F.regexp_replace(offset, "[^0-9]", "")
    return F.when(F.upper(offset) == "Z", "+00:00").otherwise(F.concat(F.substring(offset, 1, 1), F.substring(digits, 1, 2), F.lit(":"), F.rpad(F.substring(digits, 3, 2), 2, "0")))


def gmt_of(text: Column) -> Column:
    """GMT, GMT+h or GMT+hh:mm as +hh:mm."""
    hours, minutes = F.regexp_extract(text, r"[+-](\d+)", 1), F.regexp_extract(text, r":(\d+)", 1)
    return F.when(text == "GMT", "+00:00").otherwise(F.concat(F.substring(text, 4, 1), F.lpad(hours, 2, "0"), F.lit(":"), F.rpad(minutes, 2, "0")))


#: Fixed value: an ISO date and time with an offset, as JSON log lines carry it.
ISO = r"^(\d{4})-(\d{2})-(\d{2})[Tt](\d{2}):(\d{2})(?::(\d{2})(?:\.(\d{0,9}))?)?([Zz]|[+-]\d{2}(?::?\d{2})?)$"


def iso_instant(text: Column) -> Column:
    """The instant of an ISO date and time with offset, null for anything else."""
    # the expression runs once, and its groups are cut from what it leaves
    parts = F.split(F.regexp_replace(text, ISO, "\u0001".join(f"${i}" for i in range(1, 9))), "\u0001", -1)
    return once(F.when(~text.contains("\u0001"), parts), lambda g: F.when(F.size(g) == 8, _iso([F.get(g, i) for i in range(8)])))


def _iso(g: list[Column]) -> Column:
    n = [x.try_cast("int") for x in g[:6]]
    seconds = F.concat_ws(".", F.coalesce(n[5], F.lit(0)).cast("string"), F.coalesce(F.nullif(F.substring(g[6], 1, 6), F.lit("")), F.lit("0"))).try_cast("decimal(16,6)")
    return F.when((n[3] < 24) & (F.coalesce(n[5], F.lit(0)) < 60), F.try_make_timestamp(n[0], n[1], n[2], n[3], n[4], seconds, zone_of(g[7])))

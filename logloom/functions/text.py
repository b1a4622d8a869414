"""Column functions on log text: all of them Spark built-ins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Level names as other logging frameworks spell them.
LEVELS = {"FINEST": "TRACE", "FINER": "DEBUG", "FINE": "DEBUG", "CONFIG": "INFO", "WARNING": "WARN", "SEVERE": "ERROR"}
KNOWN_LEVELS = ("TRACE", "DEBUG", "INFO", "WARN", "ERROR", "FATAL")


def stable_id(*parts: Column | str) -> Column:
    """First 32 hex digits of SHA-256 over the parts joined by U+001F; a null part counts as empty."""
    texts = [F.coalesce((F.col(p) if isinstance(p, str) else p).cast("string"), F.lit("")) for p in parts]
    return F.substring(F.sha2(F.concat_ws("\u001f", *texts), 256), 1, 32)


def log_id(dataset: Column, file: Column, line: Column) -> Column:
    return stable_id(F.lit("log"), dataset, file, line)


def normal_level(level: Column) -> Column:
    up = F.upper(F.trim(level))
    named = F.coalesce(*[F.when(up == k, F.lit(v)) for k, v in LEVELS.items()], F.when(up.isin(*KNOWN_LEVELS), up))
    return F.coalesce(named, F.lit("UNKNOWN"))


def compatible_level(observed: Column, catalogued: Column) -> Column:
    """An observed UNKNOWN is no wildcard, a catalogued one is; FATAL and ERROR are alike."""
    return (observed == catalogued) | (catalogued == "UNKNOWN") | (observed.isin("FATAL", "ERROR") & catalogued.isin("FATAL", "ERROR"))


def tokens(text: Column) -> Column:
    """Distinct lower-case runs of letters and digits, two characters or more and not all digits, in order of first occurrence."""
    parts = F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+")
    return F.array_distinct(F.filter(parts, lambda t: (F.length(t) >= 2) & ~t.rlike(r"^\p{Nd}+$")))


def strip_ansi(text: Column) -> Column:
    return F.when(text.contains("\u001b"), F.regexp_replace(text, "\u001b\\[[0-9;?]*[ -/]*[A-Za-z]", "")).otherwise(text)


def blank_to_null(text: Column) -> Column:
    return F.when(F.trim(text) != "", text)


def line_range(content: Column, first: Column, last: Column) -> Column:
    """Lines first..last (from 1), clamped; null where nothing is left."""
    lines = F.split(content, "\n", -1)
    low, high = F.greatest(first, F.lit(1)), F.least(last, F.size(lines))
    return F.when(low <= high, F.array_join(F.slice(lines, low, F.greatest(high - low + 1, F.lit(0))), "\n"))


def snippet(content: Column, line: Column, radius: int) -> Column:
    """The line with ``radius`` lines around it; null where the text has no such line."""
    inside = (line >= 1) & (line <= F.size(F.split(content, "\n", -1)))
    return F.when(inside, line_range(content, line - radius, line + radius))


def numbered(text: Column, first: Column) -> Column:
    """Lines as ``NNNN | text``, numbered from ``first``, at least four wide."""
    def one(line: Column, i: Column) -> Column:
        number = (first + i).cast("string")
        return F.concat(F.lpad(number, F.greatest(F.lit(4), F.length(number)), F.lit(" ")), F.lit(" | "), line)

    return F.array_join(F.transform(F.split(text, "\n", -1), one), "\n")


def one_line(text: Column, most: int) -> Column:
    flat = F.trim(F.regexp_replace(text, r"\s+", " "))
    return F.when(F.length(flat) > most, F.concat(F.rtrim(F.substring(flat, 1, most - 1)), F.lit("…"))).otherwise(flat)


def source_link(repo: Column, ref: Column, path: Column, version: Column, file_path: Column, line: Column, end_line: Column, artifact: Column | None = None) -> Column:
    """A link to lines of a file; null where the repository, ref or path is missing."""
    def filled(template: Column) -> Column:
        out = F.replace(F.replace(template, F.lit("{version}"), version), F.lit("{file_path}"), file_path)
        return out if artifact is None else F.replace(out, F.lit("{artifactId}"), artifact)

    anchor = F.when(line == end_line, F.concat(F.lit("L"), line.cast("string"))).otherwise(F.concat(F.lit("L"), line.cast("string"), F.lit("-L"), end_line.cast("string")))
    return F.concat(blank_to_null(repo), F.lit("/blob/"), filled(ref), F.lit("/"), filled(path), F.lit("#"), anchor)


#: Fixed value: the note under a stack trace that was cut, around the number of lines left out.
CUT = ("\n… (još ", " linija)")


def once(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of a value that is computed once, however often ``f`` names it, also inside its functions of elements."""
    return F.get(F.transform(F.array(value), f), 0)


def text_lines(content: Column) -> Column:
    """Lines by any line end; an end after the last line starts no further one."""
    return once(F.split(content, r"\r\n|\r|\n", -1), lambda lines: F.when(F.element_at(lines, -1) == "", F.slice(lines, 1, F.size(lines) - 1)).otherwise(lines))


def focus_window(content: Column, first: Column, last: Column, focus: Column, most: int, radius: int) -> Column:
    """(first, text, cut_before, cut_after): lines first..last, or, of more than ``most``, those around ``focus``; null where the text has no such lines."""
    def window(lines: Column) -> Column:
        end = F.least(last, F.size(lines))
        whole = end - first + 1 <= most
        middle = F.greatest(first, F.least(end, focus))
        low = F.when(whole, first).otherwise(F.greatest(first, middle - radius))
        high = F.when(whole, end).otherwise(F.least(end, middle + radius))
        inside = lines.isNotNull() & (first >= 1) & (first <= end)
        shown = F.array_join(F.slice(lines, F.greatest(low, F.lit(1)), F.greatest(high - low + 1, F.lit(0))), "\n")
        return F.when(inside, F.struct(low.cast("int").alias("first"), shown.alias("text"), (low > first).alias("cut_before"), (high < end).alias("cut_after")))

    return once(text_lines(content), window)


def stack_trace_text(raw: Column, class_name: Column, most: int = 60) -> Column:
    """The exception's lines: from the first line after the first that starts with its class (else the second line), without blank ones at the end, ``most`` of them; null without any."""
    def places(p: Column) -> Column:
        first = F.coalesce(F.array_min(F.transform(p["lines"], lambda x, i: F.when((i >= 1) & x.startswith(p["name"]), i + 1))), F.lit(2))
        last = F.array_max(F.transform(p["lines"], lambda x, i: F.when(x.rlike(r"\S"), i + 1)))
        return F.struct(p["lines"].alias("lines"), first.alias("first"), (last - first + 1).alias("n"))

    def shown(p: Column) -> Column:
        text = F.array_join(F.slice(p["lines"], p["first"], F.greatest(F.least(p["n"], F.lit(most)), F.lit(0))), "\n")
        return F.when(p["n"] > most, F.concat(text, F.lit(CUT[0]), (p["n"] - most).cast("string"), F.lit(CUT[1]))).when(p["n"] > 0, text)

    return once(once(F.struct(text_lines(raw).alias("lines"), class_name.alias("name")), places), shown)


def clock_offset(raw: Column, instant: Column) -> Column:
    """Seconds that the clock of a written time is ahead of UTC: its own offset, else its distance from ``instant`` if that is 18 hours at most and whole minutes, else 0."""
    text = F.trim(raw)
    day = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}(?::\d{2}(?:\.\d{1,9})?)?"
    own = F.regexp_extract(text, day + r"(Z|[+-]\d{2}:\d{2})$", 1)
    told = (F.substring(own, 2, 2).cast("int") * 3600 + F.substring(own, 5, 2).cast("int") * 60) * F.when(own.startswith("-"), -1).otherwise(1)
    local = F.translate(text, " ,", "T.")
    away = F.unix_seconds(F.when(local.rlike(day + "$"), F.try_to_timestamp(F.concat(local, F.lit("Z"))))) - F.unix_seconds(instant)
    plausible = (F.abs(away) <= 18 * 3600) & (away % 60 == 0)
    return F.when(own == "Z", F.lit(0)).when(own != "", told).when(plausible, away).otherwise(F.lit(0)).cast("int")

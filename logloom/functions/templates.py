"""Message templates: literals and holes. Columns only, so a catalog of any size is prepared by the same plan."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Stand for an escaped backslash and an escaped brace while a template is cut at its holes.
_BACKSLASH, _BRACE = "\ue000", "\ue001"


def _each(parts: Column, f) -> Column:
    return F.transform(parts, f)


def literals_of(text: Column) -> Column:
    """The literals around a template's holes, one more than it has holes: neighbouring holes are one, the outer white space of outer literals is dropped, and a literal may be empty."""
    held = F.replace(F.replace(text, F.lit("\\\\"), F.lit(_BACKSLASH)), F.lit("\\{"), F.lit(_BRACE))
    parts = _each(F.split(held, r"(?:\{\})+", -1), lambda p: F.replace(F.replace(p, F.lit(_BACKSLASH), F.lit("\\")), F.lit(_BRACE), F.lit("{")))
    return F.transform(parts, lambda p, i: F.when(i == F.size(parts) - 1, F.regexp_replace(F.when(i == 0, F.regexp_replace(p, r"(?U)^\s+", "")).otherwise(p), r"(?U)\s+\z", "")).when(i == 0, F.regexp_replace(p, r"(?U)^\s+", "")).otherwise(p))


#: A conversion of java.util.Formatter, a placeholder of java.text.MessageFormat; what else a template has is text.
CONVERSION = r"%(?:\d+\$)?[-#+ 0,(]*(?:\d+)?(?:\.\d+)?(?:[tT][a-zA-Z]|[a-zA-Z])"
PLACEHOLDER = r"\{\d+(?:,[^{}]*)?\}"


def _normalised(text: Column, pattern: str, hole: str, told: dict[str, str]) -> Column:
    """A template in the form with {}: the automaton's tokens in turn, holes (which ``hole`` tells) as {}, ``told`` tokens as their text, others as they are with backslash and brace escaped."""
    def of(token: Column) -> Column:
        plain = F.replace(F.replace(token, F.lit("\\"), F.lit("\\\\")), F.lit("{"), F.lit("\\{"))
        for k, v in told.items():
            plain = F.when(token == k, F.lit(v)).otherwise(plain)
        return F.when(~token.isin(*told) & token.rlike(f"^(?:{hole})$"), "{}").otherwise(plain)

    return F.array_join(F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), of), "")


def printf_template(text: Column) -> Column:
    """A printf template (``%s``, ``%2$-5.1f``, ``%tY``; ``%%`` and ``%n`` are text) as a template with {}."""
    return _normalised(text, f"%%|%n|{CONVERSION}|[^%]+|%", CONVERSION, {"%%": "%", "%n": "\n"})


def message_format_template(text: Column) -> Column:
    """A MessageFormat template (``{0}``, ``{1,number,#.#}``; two quotes are one, a single quote is text) as a template with {}."""
    return _normalised(text, PLACEHOLDER + r"|''|[^'{]+|['{]", PLACEHOLDER, {"''": "'"})


def quoted(literal: Column) -> Column:
    return F.when(literal == "", literal).otherwise(F.concat(F.lit("\\Q"), F.replace(literal, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E")))


def template_features(text: Column) -> Column:
    """(template, regex_full, regex_prefix, literal_length, holes, literals) of a template; null for null."""
    def of(parts: Column) -> Column:
        body = F.concat(F.lit("(?s)^"), F.array_join(_each(parts, quoted), "(.*?)"))
        shown = F.array_join(_each(parts, lambda p: F.replace(F.replace(p, F.lit("\\"), F.lit("\\\\")), F.lit("{"), F.lit("\\{"))), "{}")
        size = F.aggregate(parts, F.lit(0), lambda n, p: n + F.length(F.regexp_replace(p, r"(?U)\s", "")))
        return F.struct(shown.alias("template"), F.concat(body, F.lit("\\z")).alias("regex_full"), body.alias("regex_prefix"), size.alias("literal_length"), (F.size(parts) - 1).alias("holes"), F.array_join(F.filter(parts, lambda p: p != ""), "\n").alias("literals"))

    # through an array of one, so that the parts are made once
    return F.when(text.isNotNull(), F.get(F.transform(F.array(literals_of(text)), of), 0))


def arguments(message: Column, regex: Column, holes: Column) -> Column:
    """What the holes of a matching template hold; null (as in a shared CASE) where holes is 0."""
    return F.when(holes > 0, F.transform(F.sequence(F.lit(1), holes), lambda i: F.call_function("regexp_extract", message, regex, i))).otherwise(F.array().cast("array<string>"))

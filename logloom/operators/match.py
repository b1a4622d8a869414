"""Linking events to the statements that wrote them: loggers, candidates, features, scores, decisions.

Matching depends on five fields of an event, so distinct keys are matched and the results joined back by a hash of the five. The
features of a key and a candidate do not depend on weights; scoring is arithmetic over them, so other weights
reuse the same table.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.templates import arguments
from ..functions.text import compatible_level, tokens
from . import catalog as c
from .tokentop import COMMON, top_by_tokens


@dataclass(frozen=True)
class Config:
    """Weights of a score's parts, thresholds of a decision, and caps of the candidates, as published defaults."""

    regex_full: float = 0.45
    regex_prefix: float = 0.20
    specificity_max: float = 0.20
    specificity_k: float = 15
    logger_exact: float = 0.20
    logger_hierarchy: float = 0.15
    logger_abbrev_multi: float = 0.12
    logger_conflict: float = -0.25
    level_equal: float = 0.10
    level_dynamic: float = 0.03
    level_conflict: float = -0.30
    throwable_consistent: float = 0.05
    throwable_inconsistent: float = -0.05
    min_score: float = 0.35
    ambiguity_margin: float = 0.05
    ambiguous_penalty: float = 0.6
    high: float = 0.75
    medium: float = 0.50
    top_k_tokens: int = 50
    max_candidates: int = 200


def _short(segments: Column) -> Column:
    """A name with all segments but the last cut to their first letter."""
    return F.concat_ws(".", F.concat(F.transform(F.slice(segments, 1, F.size(segments) - 1), lambda x: F.substring(x, 1, 1)), F.array(F.element_at(segments, -1))))


def resolve_loggers(observed: DataFrame, names: DataFrame) -> DataFrame:
    """(service, logger_raw, kind, names): the names that an observed logger may stand for.

    exact wins alone, else all that it abbreviates, else all that end with it (ten characters at least); kind is EXACT,
    ABBREV_UNIQUE, ABBREV_MULTI, TRUNCATED or UNKNOWN. One equi-join on keys: the whole name; its last segment and the
    number of segments, which an abbreviation keeps; the last ten characters of the name and of its shortest
    abbreviation, one of which a truncated logger keeps.
    """
    key = lambda kind, value: F.struct(F.lit(kind).alias("rank"), value.alias("key"))
    sized = lambda x: F.concat_ws("#", F.element_at(x, -1), F.size(x).cast("string"))
    seen = observed.where("logger_raw is not null and trim(logger_raw) <> ''").select("service", "logger_raw").distinct()
    p, n = F.split("logger_raw", r"\.", -1), F.split("name", r"\.", -1)
    raw = seen.withColumn("p", p).withColumn("k", F.explode(F.array_compact(F.array(key(1, F.col("logger_raw")), key(2, sized(F.col("p"))), F.when(F.length("logger_raw") >= 10, key(3, F.right("logger_raw", F.lit(10))))))))
    full = names.withColumn("s", n).withColumn("short", _short(F.col("s")))
    full = full.withColumn("k", F.explode(F.array_distinct(F.array(key(1, F.col("name")), key(2, sized(F.col("s"))), key(3, F.right("name", F.lit(10))), key(3, F.right("short", F.lit(10)))))))
    both = raw.select("service", "logger_raw", "p", "k.rank", "k.key").join(full.select("service", "name", "s", "short", "k.rank", "k.key"), ["service", "rank", "key"], "left")
    prefixes = F.forall(F.zip_with(F.slice("p", 1, F.size("p") - 1), F.slice("s", 1, F.size("s") - 1), lambda a, b: (a != "") & b.startswith(a)), lambda x: x)
    fits = F.when(F.col("rank") == 1, F.lit(True)).when(F.col("rank") == 2, (F.size("p") == 1) | prefixes).otherwise(F.col("name").endswith(F.col("logger_raw")) | F.col("short").endswith(F.col("logger_raw")))
    hit = F.when(F.col("name").isNotNull() & fits, F.struct("rank", "name"))
    best = both.groupBy("service", "logger_raw").agg(F.collect_set(hit).alias("hits"), F.min(F.when(hit.isNotNull(), F.col("rank"))).alias("rank"))
    best = best.withColumn("names", F.array_sort(F.transform(F.filter("hits", lambda h: h.rank == F.col("rank")), lambda h: h["name"])))
    kind = F.when(F.col("rank") == 1, "EXACT").when((F.col("rank") == 2) & (F.size("names") == 1), "ABBREV_UNIQUE").when(F.col("rank") == 2, "ABBREV_MULTI").when(F.col("rank") == 3, "TRUNCATED").otherwise("UNKNOWN")
    return best.select("service", "logger_raw", kind.alias("kind"), F.coalesce("names", F.array().cast("array<string>")).alias("names"))


def _has_exception(events: DataFrame) -> Column:
    return F.col("exception").isNotNull() if "exception" in events.columns else F.col("has_exception")


def key_of(events: DataFrame) -> Column:
    """A hash of the five fields that a match depends on; a null message counts as empty."""
    parts = ["service", "logger_raw", "level", F.coalesce("message", F.lit("")).alias("message"), _has_exception(events).alias("has_exception")]
    return F.sha2(F.to_json(F.struct(*parts), {"ignoreNullFields": "false"}), 256)


def keys_of(events: DataFrame) -> DataFrame:
    """(key, and its five fields): each combination once."""
    return events.select(key_of(events).alias("key"), "service", "logger_raw", "level", F.coalesce("message", F.lit("")).alias("message"), _has_exception(events).alias("has_exception")).dropDuplicates(["key"])


def _resolved(keys: DataFrame, catalog: DataFrame, modules: DataFrame, types: DataFrame) -> DataFrame:
    return resolve_loggers(keys, c.logger_names(catalog, types, modules))


def features(keys: DataFrame, catalog: DataFrame, modules: DataFrame, types: DataFrame, config: Config = Config(), mode: str = "both", resolved: DataFrame | None = None, ready: DataFrame | None = None) -> DataFrame:
    """(key, statement_id, regex, length, dynamic, logger, level, throwable): what scoring needs of every candidate; mode is both, logger or tokens.

    Candidates by logger are found for each distinct logger, not for each key. Rows are sorted by statement before
    their messages are tried, so a statement's pattern is compiled once in a task.
    """
    ready = c.prepared(catalog) if ready is None else ready
    usable = c.applicable(ready, modules)
    resolved = _resolved(keys, ready, modules, types) if resolved is None else resolved
    each = resolved.select("service", "logger_raw", F.explode("names").alias("name"))
    mine = usable.join(ready, "statement_id").select(usable["service"].alias("service"), "statement_id", "class_fqn", "logger_name", "logger_name_kind")
    # of each statement, the names under which a logger finds it: its own (0), or, if it logs under its object's class, those below its class (1)
    below = c.ancestors(types).where("depth > 0").select(F.col("ancestor").alias("class_fqn"), F.col("class_fqn").alias("name"))
    found = mine.select("service", "statement_id", "class_fqn", F.col("logger_name_kind") == "get_class", F.array_distinct(F.array_compact(F.array("logger_name", "class_fqn"))).alias("own")).toDF("service", "statement_id", "class_fqn", "inherits", "own")
    found = found.join(below.groupBy("class_fqn").agg(F.collect_set("name").alias("below")), "class_fqn", "left")
    under = F.concat(F.transform("own", lambda x: F.struct(x.alias("name"), F.lit(0).alias("reason"))), F.when(F.col("inherits"), F.transform(F.coalesce("below", F.array().cast("array<string>")), lambda x: F.struct(x.alias("name"), F.lit(1).alias("reason")))).otherwise(F.array().cast("array<struct<name:string,reason:int>>")))
    found = found.select("service", "statement_id", F.explode(under).alias("u")).select("service", "statement_id", "u.name", "u.reason")
    by_logger = each.join(found, ["service", "name"]).groupBy("service", "logger_raw", "statement_id").agg(F.min("reason").alias("reason"))
    # source 0: by logger, 1: by tokens, 9: of the logger, but not asked for
    named = keys.join(by_logger, ["service", "logger_raw"]).select("key", "statement_id", "reason", F.lit(9 if mode == "tokens" else 0).alias("source"), F.lit(0).alias("r"))
    pool = named
    if mode != "logger":
        words = keys.select("key", "service", F.posexplode(tokens(F.col("message"))).alias("pos", "token"))
        few = ready.limit(COMMON + 1).count() <= COMMON  # so small a catalog has no common tokens
        ranked = top_by_tokens(words, c.postings(ready, usable), config.top_k_tokens, few=few)
        pool = named.union(ranked.select("key", "statement_id", F.lit(None).cast("int").alias("reason"), F.lit(1).alias("source"), "r"))
    pool = pool.groupBy("key", "statement_id").agg(F.min("reason").alias("reason"), F.min(F.struct("source", "r")).alias("o"), F.min(F.when(F.col("source") < 9, F.struct("source", "r"))).alias("place")).where("place is not null")
    pool = pool.withColumn("n", F.row_number().over(Window.partitionBy("key").orderBy("place", "statement_id"))).where(F.col("n") <= config.max_candidates).select("key", "statement_id", "reason")
    rows = pool.join(keys, "key").join(resolved.select("service", "logger_raw", "kind", F.size("names").alias("names")), ["service", "logger_raw"], "left").join(ready.select("statement_id", "regex_full", "regex_prefix", "literal_length", "holes", "template_kind", F.col("level").alias("own_level"), "level_dynamic", "has_throwable_arg"), "statement_id")
    rows = rows.sortWithinPartitions("statement_id")
    text = F.substring("message", 1, 4096)
    found = lambda regex: F.regexp_instr(text, F.col(regex)) > 0
    regex = F.when(found("regex_full"), "full").when(found("regex_prefix"), "prefix")
    dynamic = F.col("template_kind") == "dynamic"
    rows = rows.withColumn("regex", regex).where(dynamic | F.col("regex").isNotNull())
    logger = F.when(F.col("reason") == 1, "hierarchy").when((F.col("reason") == 0) & (F.col("names") == 1), "exact").when(F.col("reason") == 0, "multi").when(F.coalesce(F.col("kind"), F.lit("UNKNOWN")) != "UNKNOWN", "conflict")
    level = F.when(F.col("level_dynamic"), "dynamic").when(compatible_level(F.col("level"), F.col("own_level")), "equal").otherwise("conflict")
    used = F.when(F.col("regex") == "full", F.col("regex_full")).when(F.col("regex") == "prefix", F.col("regex_prefix"))
    args = F.when(used.isNotNull(), arguments(text, used, F.col("holes"))).otherwise(F.array().cast("array<string>"))
    return rows.select("key", "statement_id", "regex", F.col("literal_length").alias("length"), dynamic.alias("dynamic"), logger.alias("logger"), level.alias("level"), (F.col("has_exception") == F.col("has_throwable_arg")).alias("throwable"), args.alias("args"))


def score(config: dict[str, Column], get: Callable[[str], Column] = F.col) -> tuple[Column, Column]:
    """(score, breakdown) over the features; ``config`` holds a column or literal for each weight, ``get`` gives a feature."""
    w = config
    logger, level = get("logger"), get("level")
    parts = {
        "regex_full": F.when(~get("dynamic") & (get("regex") == "full"), w["regex_full"]),
        "regex_prefix": F.when(~get("dynamic") & (get("regex") == "prefix"), w["regex_prefix"]),
        "specificity": F.when(~get("dynamic"), w["specificity_max"] * get("length") / (get("length") + w["specificity_k"])),
        **{f"logger_{k}": F.when(logger == v, w[f"logger_{k}"]) for k, v in (("exact", "exact"), ("hierarchy", "hierarchy"), ("abbrev_multi", "multi"), ("conflict", "conflict"))},
        **{f"level_{k}": F.when(level == k, w[f"level_{k}"]) for k in ("dynamic", "equal", "conflict")},
        "throwable_consistent": F.when(get("throwable"), w["throwable_consistent"]),
        "throwable_inconsistent": F.when(~get("throwable"), w["throwable_inconsistent"]),
    }
    total = sum((F.coalesce(p, F.lit(0.0)) for p in parts.values()), F.lit(0.0))
    breakdown = F.map_filter(F.create_map(*[x for k, p in parts.items() for x in (F.lit(k), p.cast("double"))]), lambda k, v: v.isNotNull())
    return F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), total)), 9), breakdown


def weights(config: Config) -> dict[str, Column]:
    return {k: F.lit(float(v)) for k, v in asdict(config).items()}


def decide(rows: DataFrame, by: list[str], config: dict[str, Column], lean: bool = False) -> DataFrame:
    """One row for each value of ``by``: status, statement_id, confidence, confidence_level, candidates (five at most), score_breakdown, args; ``lean``: breakdown and args are left empty, and neither is shuffled."""
    total, breakdown = score(config)
    if lean:
        rows, breakdown = rows.withColumn("args", F.array().cast("array<string>")), F.create_map().cast("map<string,double>")
    scored = rows.withColumn("score", total).withColumn("breakdown", breakdown)
    w = Window.partitionBy(*by).orderBy(F.col("score").desc(), "statement_id")
    top = scored.withColumn("n", F.row_number().over(w)).withColumn("second", F.lead("score").over(w)).where("n <= 5")
    own = [F.first(v).alias(f"_{k}") for k, v in config.items() if k in ("min_score", "ambiguity_margin", "ambiguous_penalty", "high", "medium")]
    best = top.groupBy(*by).agg(F.first(F.when(F.col("n") == 1, F.struct("statement_id", "score", "second", "breakdown", "args")), ignorenulls=True).alias("b"), F.transform(F.sort_array(F.collect_list(F.struct("n", "statement_id", "score"))), lambda x: F.struct(x.statement_id.alias("statement_id"), x.score.alias("score"))).alias("candidates"), *own)
    linked = F.col("b.score") >= F.col("_min_score")
    close = F.round(F.col("b.score") - F.col("b.second"), 9) < F.col("_ambiguity_margin")
    status = F.when(~linked, "unmatched").when(F.coalesce(close, F.lit(False)), "ambiguous").otherwise("matched")
    out = best.withColumn("status", status).withColumn("confidence", F.when(F.col("status") == "matched", F.col("b.score")).when(F.col("status") == "ambiguous", F.round(F.col("b.score") * F.col("_ambiguous_penalty"), 9)))
    level = F.when(F.col("confidence") >= F.col("_high"), "high").when(F.col("confidence") >= F.col("_medium"), "medium").when(F.col("confidence").isNotNull(), "low")
    return out.select(*by, "status", F.when(linked, F.col("b.statement_id")).alias("statement_id"), "confidence", level.alias("confidence_level"), "candidates", F.when(linked, F.col("b.breakdown")).otherwise(F.create_map().cast("map<string,double>")).alias("score_breakdown"), F.when(linked, F.col("b.args")).otherwise(F.array().cast("array<string>")).alias("args"))


def match(events: DataFrame, catalog: DataFrame, modules: DataFrame, types: DataFrame, config: Config = Config(), mode: str = "both", cached: list[DataFrame] | None = None) -> DataFrame:
    """``events`` with match (a struct) and logger (where the observed one stands for a single name).

    Keys, resolved loggers and the prepared catalog are read by several joins. A caller who passes a list as ``cached``
    has them cached, and finds them there to unpersist when the result has been used; without it they are computed where
    they are read.
    """
    keep = (lambda df: df) if cached is None else (lambda df: (cached.append(df.cache()), cached[-1])[1])
    keys, ready = keep(keys_of(events)), keep(c.prepared(catalog))
    resolved = keep(_resolved(keys, ready, modules, types))
    decided = decide(features(keys, catalog, modules, types, config, mode, resolved, ready), ["key"], weights(config))
    shown = catalog.select(F.col("statement_id"), F.concat_ws(":", "code_unit.name", "code_unit.version").alias("code_unit"), "module", "class_fqn", "method_name", "file_path", "template_kind", "line", "template")
    full = decided.join(shown, "statement_id", "left")
    none = F.struct(F.lit("unmatched").alias("status"), *[F.lit(None).cast(t).alias(n) for n, t in full.drop("key", "status").dtypes])
    told = full.select(F.col("key").alias("_key"), F.struct("status", *[n for n in full.columns if n not in ("key", "status")]).alias("match"))
    names = resolved.where(F.size("names") == 1).select(F.col("service").alias("_service"), F.col("logger_raw").alias("_logger_raw"), F.element_at("names", 1).alias("logger"))
    out = events.drop("logger", "match").withColumn("_key", key_of(events)).join(told, "_key", "left").join(names, (F.col("service") == F.col("_service")) & (F.col("logger_raw") == F.col("_logger_raw")), "left")
    return out.withColumn("match", F.coalesce("match", none)).drop("_key", "_service", "_logger_raw")


def variants() -> dict[str, tuple[Config, str]]:
    """Configurations that leave a part out, with the candidates' mode."""
    base = Config()
    less = lambda **k: Config(**(asdict(base) | k))
    no_logger = {k: 0.0 for k in ("logger_exact", "logger_hierarchy", "logger_abbrev_multi", "logger_conflict")}
    no_level = {k: 0.0 for k in ("level_equal", "level_dynamic", "level_conflict")}
    throwable = {k: 0.0 for k in ("throwable_consistent", "throwable_inconsistent")}
    return {"full": (base, "both"), "no_logger": (less(**no_logger), "both"), "no_level": (less(**no_level), "both"), "logger_candidates_only": (base, "logger"), "token_candidates_only": (base, "tokens"), "no_specificity": (less(specificity_max=0.0), "both"), "regex_only": (less(**no_logger, **no_level, **throwable), "both")}

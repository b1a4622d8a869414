"""Accuracy against ground truth: truths, metrics, breakdowns, statements, errors, ablations, tuning."""

from __future__ import annotations

import math
import random
from dataclasses import asdict, replace
from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import written
from ..sources.scratch import written
from .match import Config, decide, score, weights


def truths(logs: DataFrame, statements: DataFrame, labels: DataFrame) -> DataFrame:
    """(log_id, state, ids): state is known, not_in_catalog or unknown; ids are sorted and distinct.

    A label decides first: correct stands for the statement predicted then (or now), incorrect for the one it
    names (or, without one, nothing), not_in_catalog for none. Otherwise a reliable place in the source does: statements
    of the service whose class has that name (or it with $ for .) and whose lines hold it.
    """
    spot = ["service", "_class", "_line"]
    place = [F.when(F.col("ground_truth.reliable"), F.col(f"ground_truth.{k}")).alias(f"_{k}") for k in ("class", "line")]
    rows = logs.select("log_id", "service", *place, F.col("match.statement_id").alias("now"), F.coalesce("ground_truth.reliable", F.lit(False)).alias("reliable"))
    # distinct places meet the statements, so that a place's logs are not sent to be grouped again
    places = rows.where("_class is not null and _line is not null").select(*spot).distinct()
    named = places.select(*spot, F.explode(F.array_distinct(F.array("_class", F.replace(F.col("_class"), F.lit("$"), F.lit("."))))).alias("class_fqn"))
    lines = statements.select("service", "class_fqn", "statement_id", "line", F.coalesce("end_line", "line").alias("end_line"))
    hits = named.join(lines, ["service", "class_fqn"]).where("_line between line and end_line").groupBy(*spot).agg(F.sort_array(F.collect_set("statement_id")).alias("found"))
    rows = rows.join(hits, spot, "left").join(labels.select("log_id", "verdict", "correct_statement_id", "predicted_statement_id"), "log_id", "left")
    told = F.when(F.col("verdict") == "correct", F.coalesce("predicted_statement_id", "now")).when(F.col("verdict") == "incorrect", F.col("correct_statement_id"))
    ids = F.when(told.isNotNull(), F.array(told)).when(F.coalesce(F.col("verdict") == "not_in_catalog", F.lit(False)), F.array().cast("array<string>")).when(F.col("reliable"), F.coalesce("found", F.array().cast("array<string>")))
    return rows.select("log_id", ids.alias("ids")).select("log_id", F.when(F.col("ids").isNull(), "unknown").when(F.size("ids") == 0, "not_in_catalog").otherwise("known").alias("state"), F.coalesce("ids", F.array().cast("array<string>")).alias("ids"))


def judged(logs: DataFrame, truth: DataFrame) -> DataFrame:
    """``logs`` with truth_key, known, evaluable, covered, rank (from 1, 0: not among the candidates), at1 and at3."""
    rows = logs.join(truth, "log_id")
    known = F.col("state") == "known"
    place = F.coalesce(F.array_min(F.filter(F.transform("match.candidates", lambda c, i: F.when(F.array_contains("ids", c.statement_id), i + 1)), lambda x: x.isNotNull())), F.lit(0))
    rows = rows.withColumn("truth_key", F.when(known, F.array_join("ids", "+"))).withColumn("known", F.col("state") != "unknown").withColumn("evaluable", known).withColumn("covered", F.col("match.status") != "unmatched")
    rows = rows.withColumn("rank", F.when(known, place).otherwise(0))
    first = F.coalesce(F.array_contains("ids", F.col("match.statement_id")), F.lit(False))
    return rows.withColumn("at1", F.col("evaluable") & F.col("covered") & first).withColumn("at3", F.col("evaluable") & F.col("rank").between(1, 3))


def _ratio(a: Column, b: Column, empty: float | None = None) -> Column:
    r = F.try_divide(a.cast("double"), b.cast("double"))
    return r if empty is None else F.coalesce(r, F.lit(empty))


def metrics(rows: DataFrame) -> DataFrame:
    """One row: counts and ratios. A ratio over nothing is null, but coverage and the share of ambiguous events are 0."""
    e, cov, amb = F.col("evaluable"), F.col("covered"), F.col("match.status") == "ambiguous"
    absent = F.col("state") == "not_in_catalog"
    n = rows.agg(
        F.count("*").alias("total"), *[F.count_if(F.col("match.status") == s).alias(s) for s in ("matched", "ambiguous", "unmatched")], F.count_if(e).alias("evaluable"), F.count_if(absent).alias("not_in_catalog"), F.count_if("known").alias("with_truth"),
        F.count_if("covered").alias("covered"), F.count_if(F.col("known") & cov).alias("covered_with_truth"), F.count_if(e & cov).alias("evaluable_covered"), F.count_if("at1").alias("at1"), F.count_if("at3").alias("at3"), F.count_if(F.col("at3") & cov).alias("at3_covered"), F.count_if(e & amb).alias("evaluable_ambiguous"), F.count_if(absent & cov).alias("false_matches"),
    )
    return n.select("*", _ratio(F.col("covered"), F.col("total"), 0.0).alias("coverage"), _ratio(F.col("covered_with_truth"), F.col("with_truth")).alias("coverage_with_truth"), _ratio(F.col("at1"), F.col("evaluable")).alias("acc_at1"), _ratio(F.col("at3"), F.col("evaluable")).alias("acc_at3"), _ratio(F.col("at3_covered"), F.col("evaluable_covered")).alias("acc_at3_covered"), _ratio(F.col("at1"), F.col("evaluable_covered")).alias("precision_covered"), _ratio(F.col("ambiguous"), F.col("total"), 0.0).alias("ambiguous_share"), _ratio(F.col("evaluable_ambiguous"), F.col("evaluable")).alias("ambiguous_evaluable"), _ratio(F.col("not_in_catalog"), F.col("with_truth")).alias("not_in_catalog_share"), _ratio(F.col("false_matches"), F.col("not_in_catalog")).alias("false_match_rate"))


def per_level(rows: DataFrame) -> DataFrame:
    """(confidence_level, events, evaluable, at1, precision): always high, medium and low, covered events only."""
    levels = rows.sparkSession.createDataFrame([("high", 1), ("medium", 2), ("low", 3)], "confidence_level string, place int")
    n = rows.where("covered").groupBy(F.col("match.confidence_level").alias("confidence_level")).agg(F.count("*").alias("events"), F.count_if("evaluable").alias("evaluable"), F.count_if("at1").alias("at1"))
    out = levels.join(n, "confidence_level", "left").select("confidence_level", "place", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("events", "evaluable", "at1")])
    return out.withColumn("precision", _ratio(F.col("at1"), F.col("evaluable"))).drop("place")


def per_status(rows: DataFrame) -> DataFrame:
    """(status, events, at1, at3, acc_at1, acc_at3) over evaluable events: always matched, ambiguous and unmatched."""
    fixed = rows.sparkSession.createDataFrame([("matched",), ("ambiguous",), ("unmatched",)], "status string")
    n = rows.where("evaluable").groupBy(F.col("match.status").alias("status")).agg(F.count("*").alias("events"), F.count_if("at1").alias("at1"), F.count_if("at3").alias("at3"))
    out = fixed.join(n, "status", "left").select("status", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("events", "at1", "at3")])
    return out.select("*", *[_ratio(F.col(c), F.col("events")).alias(f"acc_{c}") for c in ("at1", "at3")])


def breakdown(rows: DataFrame, dimensions: list[str]) -> DataFrame:
    """(dimension, value, events, evaluable, at1, statements, hit): all dimensions in one pass; nulls are ``unknown``. Events are counted by all values and the truth before they are taken apart by dimension."""
    values = [F.coalesce(F.col(d).cast("string"), F.lit("unknown")).alias(f"_{i}") for i, d in enumerate(dimensions)]
    sums = {"events": F.lit(True), "evaluable": F.col("evaluable"), "at1": F.col("at1")}
    counted = rows.groupBy(*values, "truth_key").agg(*[F.count_if(c).alias(k) for k, c in sums.items()])
    pairs = F.array(*[F.struct(F.lit(d).alias("dimension"), F.col(f"_{i}").alias("value")) for i, d in enumerate(dimensions)])
    each = counted.withColumn("p", F.explode(pairs)).groupBy("p.dimension", "p.value", "truth_key").agg(*[F.sum(k).alias(k) for k in sums])
    return each.groupBy("dimension", "value").agg(*[F.sum(k).alias(k) for k in sums], F.count("truth_key").alias("statements"), F.count(F.when(F.col("at1") > 0, F.col("truth_key"))).alias("hit"))


def top_and_others(rows: DataFrame, column: str, top: int, others: str) -> DataFrame:
    """(value, events, statements) of the ``top`` most frequent values and, counted again over the rest, the others."""
    value = F.coalesce(column, F.lit("unknown"))
    counts = rows.groupBy(value.alias("value")).agg(F.count("*").alias("n"))
    best = counts.orderBy(F.col("n").desc(), "value").limit(top).select("value", F.lit(True).alias("top"))
    named = rows.withColumn("value", value).join(best, "value", "left").withColumn("value", F.when(F.col("top"), F.col("value")).otherwise(F.lit(others)))
    return named.groupBy("value").agg(F.count("*").alias("events"), F.count_distinct("truth_key").alias("statements"))


def per_statement(rows: DataFrame) -> DataFrame:
    """(truth_key, events, at1, at3, covered, most_predicted): the most frequent prediction, '' where not covered, ties to the smaller id."""
    e = rows.where("evaluable").withColumn("predicted", F.when(F.col("covered"), F.coalesce("match.statement_id", F.lit(""))).otherwise(F.lit("")))
    n = e.groupBy("truth_key", "predicted").agg(F.count("*").alias("n"), F.count_if("at1").alias("at1"), F.count_if("at3").alias("at3"), F.count_if("covered").alias("covered"))
    return n.groupBy("truth_key").agg(F.sum("n").alias("events"), F.sum("at1").alias("at1"), F.sum("at3").alias("at3"), F.sum("covered").alias("covered"), F.min_by("predicted", F.struct(-F.col("n"), "predicted")).alias("most_predicted"))


def unique_statements(statements: DataFrame) -> DataFrame:
    """One row over what per_statement returns: how many, share hit, mean accuracies, share of the most frequent."""
    return statements.agg(F.count("*").alias("statements"), _ratio(F.count_if(F.col("at1") > 0), F.count("*")).alias("hit_rate"), F.avg(F.col("at1") / F.col("events")).alias("macro_at1"), F.avg(F.col("at3") / F.col("events")).alias("macro_at3"), _ratio(F.max("events"), F.sum("events")).alias("top_share"))


def error_kinds(rows: DataFrame) -> DataFrame:
    """(predicted, truth_key, n, log_id): kinds of error with a first example by (source_file, line_number)."""
    wrong = rows.where("evaluable and not at1").withColumn("predicted", F.when(F.col("covered"), F.coalesce("match.statement_id", F.lit(""))).otherwise(F.lit("")))
    return wrong.groupBy("predicted", "truth_key").agg(F.count("*").alias("n"), F.min_by("log_id", F.struct("source_file", "line_number", "log_id")).alias("log_id"))


def error_sample(kinds: DataFrame, size: int, seed: int) -> DataFrame:
    """A seeded sample of kinds, most frequent first."""
    drawn = kinds.orderBy(F.md5(F.concat_ws("|", F.lit(str(seed)), "predicted", "truth_key")), "predicted", "truth_key").limit(size)
    return drawn.orderBy(F.col("n").desc(), "predicted", "truth_key")


def score_counts(rows: DataFrame, top: int = 2) -> DataFrame:
    """One row: what a configuration gets right and wrong, over what judged returns.

    The control set leaves out the ``top`` most frequent true statements (ties to the smaller key), whose events
    would outweigh all others. An error is tied if the true statement is a candidate with the first one's score.
    Counters are summed by true statement before anything else, so a frequent statement is one row.
    """
    covered, wrong, amb = F.col("covered"), F.col("evaluable") & ~F.col("at1"), F.col("match.status") == "ambiguous"
    own = F.try_element_at("match.candidates", F.greatest(F.col("rank"), F.lit(1)))["score"]
    first = F.try_element_at("match.candidates", F.lit(1))["score"]
    tied = wrong & covered & (F.col("rank") >= 1) & F.coalesce(F.abs(own - first) < 1e-12, F.lit(False))
    seen = F.col("evaluable") & covered
    at_level = lambda level: seen & F.coalesce(F.col("match.confidence_level") == level, F.lit(False))
    counted = {"events": F.lit(True), "evaluable": F.col("evaluable"), "covered": covered, "at1": F.col("at1"), "at3": F.col("at3"), "ambiguous": amb}
    for level in ("high", "medium", "low"):
        counted |= {f"{level}_covered": at_level(level), f"{level}_at1": at_level(level) & F.col("at1")}
    absent = F.col("state") == "not_in_catalog"
    counted |= {"not_in_catalog": absent, "false_links": absent & covered, "tied_errors": tied, "unmatched_errors": wrong & ~covered}
    each = rows.groupBy(F.when(F.col("evaluable"), F.col("truth_key")).alias("key")).agg(*[F.count_if(c).alias(k) for k, c in counted.items()])
    best = each.where("evaluable > 0").orderBy(F.col("evaluable").desc(), "key").limit(top).select("key", F.lit(True).alias("frequent"))
    each = each.join(best, "key", "left").withColumn("control", F.col("frequent").isNull() & (F.col("evaluable") > 0))
    sums = [F.coalesce(F.sum(k), F.lit(0)).alias(k) for k in counted]
    part = [F.coalesce(F.sum(F.when(F.col("control"), F.col(k))), F.lit(0)).alias(f"control_{k}") for k in ("evaluable", "at1", "tied_errors")]
    true = F.col("evaluable") > 0
    n = each.agg(*sums, F.count_if(true).alias("statements"), F.count_if(true & (F.col("at1") > 0)).alias("statements_hit"), F.coalesce(F.avg(F.when(true, F.col("at1") / F.col("evaluable"))), F.lit(0.0)).alias("macro_at1"), *part)
    ratios = {"acc_at1": ("at1", "evaluable"), "acc_at3": ("at3", "evaluable"), "precision_high": ("high_at1", "high_covered"), "precision_medium": ("medium_at1", "medium_covered"), "precision_low": ("low_at1", "low_covered"), "control_acc_at1": ("control_at1", "control_evaluable"), "false_link_share": ("false_links", "not_in_catalog"), "statement_hit_rate": ("statements_hit", "statements")}
    shares = [_ratio(F.col(k), F.col("events"), 0.0).alias(name) for name, k in (("coverage", "covered"), ("ambiguous_share", "ambiguous"))]
    return n.select("*", *shares, *[_ratio(F.col(a), F.col(b)).alias(k) for k, (a, b) in ratios.items()], (F.col("evaluable") - F.col("at1")).alias("errors"), (F.col("control_evaluable") - F.col("control_at1")).alias("control_errors"))


def logger_coverage(loggers: DataFrame) -> DataFrame:
    """One row over (logger, state) of all modules, state mapped, unmapped or excluded: mapped in one module wins; 100 % where none is eligible."""
    has = lambda s: F.bool_or(F.col("state") == s)
    one = loggers.groupBy("logger").agg(has("mapped").alias("mapped"), (has("excluded") & ~has("mapped")).alias("excluded"), (has("unmapped") & ~has("mapped")).alias("unmapped"))
    n = one.agg(F.count("*").alias("loggers"), *[F.count_if(k).alias(k) for k in ("excluded", "mapped", "unmapped")]).withColumn("eligible", F.col("loggers") - F.col("excluded"))
    return n.withColumn("percent", _ratio(100 * F.col("mapped"), F.col("eligible"), 100.0))


def csv_ready(rows: DataFrame) -> DataFrame:
    """``rows`` as a report's cells: doubles with four decimals, all else as text, nulls empty."""
    cell = lambda c, t: F.format_string("%.4f", F.col(c)) if t in ("double", "float") else F.col(c).cast("string")
    return rows.select(*[F.coalesce(F.when(F.col(c).isNotNull(), cell(c, t)), F.lit("")).alias(c) for c, t in rows.dtypes])


def write_report(rows: DataFrame, path: str) -> None:
    """A report as CSV with a header; quotes stand only where a cell needs them."""
    csv_ready(rows).write.csv(path, header=True, escape='"', emptyValue="")


def config_text(config: Config, comment: str = "") -> str:
    """Weights as YAML, a line each, below the comment's lines."""
    head = [f"# {line}".rstrip() for line in comment.splitlines()]
    return "\n".join([*head, *(f"{k}: {v}" for k, v in asdict(config).items())]) + "\n"


def config_of(text: str) -> Config:
    """What ``config_text`` wrote; weights that are not named keep their defaults, an unknown name is an error."""
    defaults = asdict(Config())
    pairs = [line.split(":", 1) for line in text.splitlines() if line.strip() and not line.startswith("#")]
    told = {k.strip(): v.strip() for k, v in pairs}
    if unknown := set(told) - set(defaults):
        raise ValueError(f"unknown weights: {', '.join(sorted(unknown))}")
    return replace(Config(), **{k: type(defaults[k])(float(v)) for k, v in told.items()})


def trial_rows(spark, tried: list[tuple[Config, dict]]) -> DataFrame:
    """(trial, n_at1, n_high, n_high_correct, distance, and the weights) of what ``tune`` tried, in its order, for ``write_report``."""
    names = list(asdict(Config()))
    rows = [(i, t["at1"], t["high"], t["high_correct"], float(distance(c, tried[0][0])), *map(float, asdict(c).values())) for i, (c, t) in enumerate(tried)]
    return spark.createDataFrame(rows, "trial int, n_at1 long, n_high long, n_high_correct long, distance double, " + ", ".join(f"{k} double" for k in names))


# ---- other weights over the same features

#: Fixed values, by parameter: least, most, unit of the grid, and step of a move.
SPACE = {
    "regex_full": (0.30, 0.60, 0.01, 0.05),
    "regex_prefix": (0.05, 0.35, 0.01, 0.05),
    "specificity_max": (0.00, 0.30, 0.01, 0.05),
    "specificity_k": (5, 40, 1, 5),
    "logger_exact": (0.05, 0.35, 0.01, 0.05),
    "logger_hierarchy": (0.05, 0.30, 0.01, 0.05),
    "logger_abbrev_multi": (0.02, 0.25, 0.01, 0.05),
    "logger_conflict": (-0.50, 0.00, 0.01, 0.05),
    "level_equal": (0.00, 0.25, 0.01, 0.05),
    "level_dynamic": (0.00, 0.10, 0.005, 0.02),
    "level_conflict": (-0.50, 0.00, 0.01, 0.05),
    "throwable_consistent": (0.00, 0.15, 0.005, 0.025),
    "throwable_inconsistent": (-0.15, 0.00, 0.005, 0.025),
    "min_score": (0.15, 0.55, 0.01, 0.05),
    "ambiguity_margin": (0.00, 0.15, 0.005, 0.025),
    "ambiguous_penalty": (0.40, 0.90, 0.01, 0.05),
    "high": (0.60, 0.90, 0.01, 0.05),
    "medium": (0.35, 0.70, 0.01, 0.05),
}
LEVEL_GAP = 0.05


def on_grid(value: float, unit: float) -> float:
    """The nearest multiple of ``unit``, halves upwards, without binary noise."""
    return float(math.floor(value / unit + 0.5) * Decimal(str(unit)))


def repaired(c: Config) -> Config:
    """Every parameter in its range and on its grid; the prefix weighs no more than the full match, and medium stays below high by LEVEL_GAP."""
    told = {k: on_grid(min(high, max(low, getattr(c, k))), unit) for k, (low, high, unit, _) in SPACE.items()}
    told["regex_prefix"] = min(told["regex_prefix"], told["regex_full"])
    if told["medium"] > told["high"] - LEVEL_GAP:
        low, _, unit, _ = SPACE["medium"]
        told["medium"] = on_grid(max(low, told["high"] - LEVEL_GAP), unit)
    return replace(c, **told)


def random_config(rng: random.Random, base: Config) -> Config:
    return repaired(replace(base, **{k: low + rng.randrange(round((high - low) / unit) + 1) * unit for k, (low, high, unit, _) in SPACE.items()}))


def distance(a: Config, b: Config) -> float:
    """The mean over parameters of the difference in parts of the range."""
    x, y = asdict(a), asdict(b)
    return sum(abs(x[k] - y[k]) / (high - low) for k, (low, high, _, _) in SPACE.items()) / len(SPACE)


def for_tuning(dataset: str) -> str:
    """The dataset's id; test datasets must not be tuned on and are refused."""
    if dataset.lower().startswith("test-"):
        raise ValueError(f"{dataset} is a test dataset")
    return dataset


def score_trials(features: DataFrame, keys: DataFrame, truth: DataFrame, trials: list[Config]) -> list[dict]:
    """at1, high and high_correct of every configuration: all of them in one job over the same features.

    ``keys`` is (key, log_id), ``truth`` (log_id, ids). The trials are a small table; a key's candidates (a
    bounded number) are gathered once and scored in place for every trial, so trials multiply no shuffle.
    """
    spark = features.sparkSession
    kinds = ", ".join(f"{k} double" for k in asdict(Config()))
    table = spark.createDataFrame([(i, *map(float, asdict(t).values())) for i, t in enumerate(trials)], f"trial int, {kinds}")
    weight = {k: F.col(k) for k in asdict(Config())}
    best, second = F.get("top", F.lit(0)), F.get("top", F.lit(1))
    each = features.groupBy("key").agg(F.collect_list(F.struct(*[c for c in features.columns if c not in ("key", "args")])).alias("candidates"))
    # of each key and set of true ids how many events there are: decisions meet these, not the events
    asked = keys.join(truth, "log_id").groupBy("key", "ids").agg(F.count("*").alias("n"))
    rows = each.join(asked, "key").join(F.broadcast(table)).withColumn("top", F.array_sort(F.transform("candidates", lambda c: F.struct((-score(weight, lambda k: c[k])[0]).alias("minus"), c.statement_id.alias("statement_id")))))
    rows = rows.where(-best.minus >= F.col("min_score"))
    close = F.coalesce(F.round(second.minus - best.minus, 9) < F.col("ambiguity_margin"), F.lit(False))
    confidence = F.when(close, F.round(-best.minus * F.col("ambiguous_penalty"), 9)).otherwise(-best.minus)
    found = rows.select("trial", "n", F.array_contains("ids", best.statement_id).alias("right"), (confidence >= F.col("high")).alias("high"))
    total = lambda c: F.sum(F.when(c, F.col("n")).otherwise(0))
    got = {r.trial: r for r in found.groupBy("trial").agg(total(F.col("right")).alias("at1"), total(F.col("high")).alias("high"), total(F.col("high") & F.col("right")).alias("high_correct")).collect()}
    return [{"at1": got[i].at1, "high": got[i].high, "high_correct": got[i].high_correct} if i in got else {"at1": 0, "high": 0, "high_correct": 0} for i in range(len(trials))]


def tune(features: DataFrame, keys: DataFrame, truth: DataFrame, trials: int = 200, seed: int = 1, floor: float = 0.95) -> tuple[Config, list[tuple[Config, dict]]]:
    """The best configuration found, and all that were tried: the base, random ones in one job, then moves along one parameter at a time by its step and by half of it, as long as they help; all moves from one place are one job.

    Better: the precision of high confidence is ``floor`` or more (below that, higher), then more right, then nearer to the base, then more right ones of high confidence.
    """
    rng, base = random.Random(seed), Config()
    first = [base]
    for _ in range((trials - 1) // 2):
        c = random_config(rng, base)
        if c not in first:
            first.append(c)
    tried = list(zip(first, score_trials(features, keys, truth, first), strict=True))

    def order(x) -> tuple:
        precision = x[1]["high_correct"] / x[1]["high"] if x[1]["high"] else -1.0
        good = precision >= floor
        return good, 0.0 if good else precision, x[1]["at1"], -distance(x[0], base), x[1]["high_correct"]

    for factor in (1.0, 0.5):
        while True:
            best = max(tried, key=order)
            moves = []
            for k, (_, _, _, step) in SPACE.items():
                for sign in (-1, 1):
                    c = repaired(replace(best[0], **{k: getattr(best[0], k) + sign * factor * step}))
                    if c not in [t for t, _ in tried] and c not in moves and len(tried) + len(moves) < trials:
                        moves.append(c)
            if moves:
                tried += zip(moves, score_trials(features, keys, truth, moves), strict=True)
            if not moves or max(tried, key=order) is best:
                break
    return max(tried, key=order)[0], tried


def verdict(baseline: dict, proposed: dict, floor: float = 0.95) -> str:
    """BETTER, EQUAL or WORSE by right answers; a proposal below the floor is WORSE."""
    if proposed["high"] and proposed["high_correct"] < floor * proposed["high"]:
        return "WORSE"
    return "BETTER" if proposed["at1"] > baseline["at1"] else "EQUAL" if proposed["at1"] == baseline["at1"] else "WORSE"


def ablate(per_variant: dict[str, DataFrame], keys: DataFrame, truth: DataFrame, configs: dict[str, Config]) -> DataFrame:
    """(variant, events, at1): ``per_variant`` holds the features under each variant's candidates."""
    parts = []
    # of each key and set of true ids how many events there are, once for all variants
    asked = written(keys.join(truth, "log_id").groupBy("key", "ids").agg(F.count("*").alias("n")), "asked")
    for name, rows in per_variant.items():
        d = decide(rows, ["key"], weights(configs[name]), lean=True).select("key", "status", "statement_id")
        right = (F.col("status") != "unmatched") & F.array_contains("ids", F.col("statement_id"))
        hits = asked.join(d, "key", "left").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("events"), F.coalesce(F.sum(F.when(right, F.col("n"))), F.lit(0)).alias("at1"))
        parts.append(hits.select(F.lit(name).alias("variant"), "events", "at1"))
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out

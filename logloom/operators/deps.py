"""Choice of dependencies by the loggers that logs show: weighted greedy cover, in rounds over all services at once."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import written


def select_dependencies(loggers: DataFrame, classes: DataFrame, own: DataFrame | None = None, rounds: int = 1000) -> DataFrame:
    """(service, place, artifact, hits): which artifacts to analyse for each service, in the order in which a greedy choice takes them.

    ``loggers`` (service, logger, n): how often a logger occurs; ``classes`` (service, artifact, logger): which of them an
    artifact's classes are, among the artifacts of the service's modules; ``own`` (service, logger): those that the project
    itself has, which need no artifact. The next artifact is always the one whose loggers that none has covered yet occur
    most often (``hits``), ties to the smaller name, until no artifact adds any.

    One round takes every artifact that wins all its open loggers against the artifacts it shares them with: no later
    choice can change its hits, so the rounds (each a table) together give the greedy order; they are as many as the
    longest chain of artifacts that wait for each other.
    """
    known = loggers.where("logger is not null and n > 0").groupBy("service", "logger").agg(F.sum("n").alias("n"))
    if own is not None:
        known = known.join(own.select("service", "logger").distinct(), ["service", "logger"], "left_anti")
    open_ = written(known.join(classes.select("service", "artifact", "logger").distinct(), ["service", "logger"]), "cover")
    taken = None
    for _ in range(rounds):
        hits = open_.groupBy("service", "artifact").agg(F.sum("n").alias("hits"))
        rows = open_.join(hits, ["service", "artifact"])
        best = rows.groupBy("service", "logger").agg(F.min(F.struct((-F.col("hits")).alias("h"), "artifact")).alias("best"))
        won = rows.join(best, ["service", "logger"]).groupBy("service", "artifact", "hits").agg(F.bool_and(F.col("best.artifact") == F.col("artifact")).alias("wins")).where("wins").drop("wins")
        won = written(won, "chosen")
        taken = won if taken is None else taken.union(won)
        covered = open_.join(won.select("service", "artifact"), ["service", "artifact"], "left_semi").select("service", "logger").distinct()
        open_ = written(open_.join(covered, ["service", "logger"], "left_anti"), "cover")
        if open_.isEmpty():
            break
    else:
        raise RuntimeError(f"the choice did not end in {rounds} rounds")
    place = F.row_number().over(Window.partitionBy("service").orderBy(F.col("hits").desc(), "artifact"))
    return taken.select("service", place.alias("place"), "artifact", "hits")


def logger_states(loggers: DataFrame, classes: DataFrame, own: DataFrame | None, chosen: DataFrame) -> DataFrame:
    """(service, logger, state) as evaluate.logger_coverage takes it: mapped to the project or a chosen artifact, excluded if it is not shaped like a class, else unmapped."""
    found = classes.join(chosen.select("service", "artifact"), ["service", "artifact"], "left_semi").select("service", "logger")
    if own is not None:
        found = found.union(own.select("service", "logger"))
    rows = loggers.where("logger is not null").select("service", "logger").distinct().join(found.distinct().withColumn("mapped", F.lit(True)), ["service", "logger"], "left")
    shaped = F.col("logger").rlike(r"^(?:[\p{L}_$][\p{L}\p{N}_$]*\.)*\p{Lu}[\p{L}\p{N}_$]*$")
    return rows.select("service", "logger", F.when(F.col("mapped"), "mapped").when(~shaped, "excluded").otherwise("unmapped").alias("state"))

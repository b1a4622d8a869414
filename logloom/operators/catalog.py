"""The catalog of log statements: what applies to a service, its tokens, and the graphs of types and methods."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.templates import template_features
from ..functions.text import tokens
from ..sources.scratch import written


def prepared(catalog: DataFrame) -> DataFrame:
    """``catalog`` with what matching needs of its templates; statements whose template is unsupported are left out."""
    t = catalog.where("template_kind <> 'unsupported'").withColumn("f", template_features(F.col("template")))
    return t.withColumns({"regex_full": F.col("f.regex_full"), "regex_prefix": F.col("f.regex_prefix"), "literal_length": F.col("f.literal_length"), "holes": F.col("f.holes"), "constant_tokens": tokens(F.col("f.literals"))}).drop("f")


def services(modules: DataFrame) -> DataFrame:
    """(service, module, dependency): of modules (module, service, selected_dependencies) that have a service."""
    return modules.where("service is not null").select("service", "module", F.explode_outer("selected_dependencies").alias("dependency"))


def applicable(catalog: DataFrame, modules: DataFrame) -> DataFrame:
    """(service, statement_id): project statements of the same service, and statements of a dependency that the service has selected at that version."""
    unit = F.concat_ws(":", "code_unit.name", "code_unit.version")
    own = catalog.where("code_unit.type = 'project'").join(services(modules).select("service").distinct(), "service").select("service", "statement_id")
    taken = services(modules).where("dependency is not null").select("service", "dependency").distinct()
    other = catalog.where("code_unit.type = 'dependency'").select("statement_id", unit.alias("dependency")).join(taken, "dependency").select("service", "statement_id")
    return own.union(other).distinct()


def applicable_types(types: DataFrame, modules: DataFrame) -> DataFrame:
    unit = F.concat_ws(":", "code_unit.name", "code_unit.version")
    s = services(modules)
    own = types.where("code_unit.type = 'project'").join(s.select("service", "module").distinct(), "module")
    other = types.where("code_unit.type = 'dependency'").withColumn("dependency", unit).join(s.where("dependency is not null").select("service", "dependency").distinct(), "dependency")
    columns = [F.col("service"), *[F.col(c) for c in types.columns]]
    return own.select(*columns).union(other.select(*columns)).distinct()


def logger_names(catalog: DataFrame, types: DataFrame, modules: DataFrame) -> DataFrame:
    """(service, name): every name that a logger of the service can have."""
    own = applicable(catalog, modules).join(catalog.select("statement_id", "logger_name"), "statement_id").select("service", F.col("logger_name").alias("name"))
    t = applicable_types(types, modules)
    return own.union(t.select("service", F.explode(F.array_distinct(F.array_compact(F.array("class_fqn", "class_binary")))))).where("name is not null").distinct()


def token_weights(catalog: DataFrame, usable: DataFrame) -> DataFrame:
    """(service, token, df, idf): idf is ln(statements of the service / statements with the token). Counted before anything is joined."""
    rows = usable.join(catalog.select("statement_id", "constant_tokens"), "statement_id")
    # one pass: the empty token stands for the statement itself
    every = rows.select("service", F.explode(F.concat(F.array(F.lit("")), "constant_tokens")).alias("token")).groupBy("service", "token").agg(F.count("*").alias("df"))
    n = every.where("token = ''").select("service", F.col("df").alias("n"))
    return every.where("token <> ''").join(n, "service").select("service", "token", "df", F.log(F.col("n") / F.col("df")).alias("idf"))


def postings(catalog: DataFrame, usable: DataFrame) -> DataFrame:
    """(service, token, statement_id, idf): the tokens of every statement with their weights."""
    rows = usable.join(catalog.select("statement_id", F.explode("constant_tokens").alias("token")), "statement_id")
    return rows.join(token_weights(catalog, usable).drop("df"), ["service", "token"]).select("service", "token", "statement_id", "idf")


def ancestors(types: DataFrame, levels: int = 20) -> DataFrame:
    """(class_fqn, ancestor, depth): the class itself at 0 and its superclasses, ``levels`` at most; a cycle is walked once.

    The first type of a class name (by type_id) counts. Chains grow by doubling: a class whose chain is still open takes
    on that of its last ancestor, a join (without broadcasts) and a table each round, the logarithm of ``levels`` at most.
    """
    above = F.when(F.col("class_fqn").isNotNull() & F.col("superclass_fqn").isNotNull(), F.array("superclass_fqn")).otherwise(F.array().cast("array<string>"))
    chains = written(types.groupBy("class_fqn").agg(F.min_by("superclass_fqn", "type_id").alias("superclass_fqn")).select("class_fqn", above.alias("chain")), "chains")
    length = 1
    while length < levels:
        open_ = F.size("chain") == length
        on = chains.where("size(chain) > 0").select(F.col("class_fqn").alias("last"), F.col("chain").alias("more"))
        longer = chains.where(open_).withColumn("last", F.element_at("chain", -1)).join(on.hint("merge"), "last", "left")
        longer = longer.select("class_fqn", F.concat("chain", F.coalesce("more", F.array().cast("array<string>"))).alias("chain"))
        chains, length = written(longer.union(chains.where(~open_)), "chains"), 2 * length
        if chains.where(F.size("chain") == length).isEmpty():
            break
    # up to the first class that has been met
    first = F.array_min(F.transform("chain", lambda c, i: F.when(F.array_contains(F.concat(F.array("class_fqn"), F.slice("chain", F.lit(1), i)), c), i)))
    whole = F.size(F.array_distinct(F.concat(F.array("class_fqn"), "chain"))) == F.size("chain") + 1
    cut = F.slice("chain", F.lit(1), F.least(F.when(whole, F.size("chain")).otherwise(first), F.lit(levels)))
    return chains.select("class_fqn", F.posexplode(F.concat(F.array("class_fqn"), cut)).alias("depth", "ancestor")).select("class_fqn", "ancestor", "depth")


def implementors(types: DataFrame, rounds: int = 100) -> DataFrame:
    """(interface, class_fqn): classes that implement an interface, directly or through superclasses and other interfaces; an error if a chain is longer than ``rounds``. A cycle is walked once.

    The closure is grown by doubling over distinct pairs, each with its shortest chain, so a class that reaches an
    interface on many ways is one row, and the rounds (each a table) are as many as the logarithm of the longest chain.
    """
    up = types.select("class_fqn", F.explode(F.array_compact(F.concat(F.coalesce("interfaces", F.array().cast("array<string>")), F.array("superclass_fqn")))).alias("above")).distinct()
    reach, pairs = written(up.withColumn("depth", F.lit(1)), "reach"), -1
    while True:
        told = reach.agg(F.count("*").alias("n"), F.max("depth").alias("depth")).first()
        if (told.depth or 0) > rounds:
            raise ValueError(f"chains of interfaces are longer than {rounds}")
        if told.n == pairs:
            break
        pairs = told.n
        on = reach.select(F.col("class_fqn").alias("above"), F.col("above").alias("top"), F.col("depth").alias("more"))
        longer = reach.join(on, "above").where("class_fqn <> top").select("class_fqn", F.col("top").alias("above"), (F.col("depth") + F.col("more")).alias("depth"))
        reach = written(reach.union(longer).groupBy("class_fqn", "above").agg(F.min("depth").alias("depth")), "reach")
    kinds = types.groupBy("class_fqn").agg(F.min_by("kind", "type_id").alias("kind"))
    above = kinds.where("kind = 'interface'").select(F.col("class_fqn").alias("above"))
    return reach.join(above, "above").join(kinds.where("kind <> 'interface'").select("class_fqn"), "class_fqn").select(F.col("above").alias("interface"), "class_fqn")


def reverse_edges(edges: DataFrame) -> DataFrame:
    """(method_id, called_by, caller_count) from call edges (caller_id, target_id, line); callers sorted."""
    called = edges.where("target_id is not null").select("caller_id", "target_id", "line").distinct()
    return called.groupBy(F.col("target_id").alias("method_id")).agg(F.sort_array(F.collect_list(F.struct(F.col("caller_id").alias("method_id"), "line"))).alias("called_by"), F.count("*").alias("caller_count"))


def unique_implementor_edges(edges: DataFrame, classes: DataFrame) -> DataFrame:
    """``edges`` (caller_id, target_class, method, line) and, for calls of an interface with exactly one implementor, the same call of that class, marked via_interface."""
    one = classes.groupBy("interface").agg(F.count("*").alias("n"), F.min("class_fqn").alias("only")).where("n = 1")
    more = edges.join(one, F.col("target_class") == F.col("interface")).select("caller_id", F.col("only").alias("target_class"), "method", "line", F.lit(True).alias("via_interface"))
    return edges.select("caller_id", "target_class", "method", "line", F.lit(False).alias("via_interface")).union(more)


def resolved_sites(sites: DataFrame, edges: DataFrame) -> DataFrame:
    """``sites`` (method_id, line, text, target_method_id, resolved, ...) with target and resolution of the method's edge at the same line and text, the first by place."""
    first = edges.groupBy("method_id", "line", "text").agg(F.min_by(F.struct("target_method_id", "resolved"), "place").alias("edge"))
    found = F.col("edge").isNotNull()
    keep = [F.when(found, F.col(f"edge.{c}")).otherwise(F.col(c)).alias(c) if c in ("target_method_id", "resolved") else F.col(c) for c in sites.columns]
    return sites.join(first, ["method_id", "line", "text"], "left").select(*keep)


def callers(edges: DataFrame, start: DataFrame, depth: int = 3, per_level: int = 5, most: int = 12) -> DataFrame:
    """(root, caller_id, level): callers of every method in ``start`` (root), nearest levels first, new ones only, at most ``per_level`` a level and ``most`` in all."""
    seen = start.select("root", F.col("root").alias("caller_id"), F.lit(0).alias("level"))
    level = seen
    plain = edges.where("target_id is not null").select(F.col("target_id").alias("t"), F.col("caller_id").alias("c")).distinct()
    for k in range(1, depth + 1):
        found = level.join(plain, level["caller_id"] == F.col("t")).select("root", F.col("c").alias("caller_id")).distinct().join(seen.select("root", "caller_id"), ["root", "caller_id"], "left_anti")
        first = F.row_number().over(Window.partitionBy("root").orderBy("caller_id"))
        level = found.withColumn("r", first).where(F.col("r") <= per_level).select("root", "caller_id", F.lit(k).alias("level"))
        seen = seen.union(level)
    ranked = seen.where("level > 0").withColumn("r", F.row_number().over(Window.partitionBy("root").orderBy("level", "caller_id")))
    return ranked.where(F.col("r") <= most).drop("r")

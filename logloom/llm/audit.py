"""Filter interaction audit: what every order of a set of filters keeps, from one count for each combination of failures.

A document's failures are a mask of bits. Counting documents by part and mask is the only work that grows with the
data; the subset-zeta transform of a part's counts (a pass for each bit that adds the counts without the bit) gives, for
every set of filters, how many documents fail nothing outside it, hence the survivors of every subset of filters. A step
of an order is the difference of two neighbouring subsets, for documents and for those with a label alike.
"""

from __future__ import annotations

from functools import reduce
from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise


def with_bit(counts: Column, b: int) -> Column:
    """One pass of the transform: to every mask that has bit ``b`` comes the entry without it."""
    return F.transform(counts, lambda x, i: x + F.when(F.pmod(F.floor(i / (1 << b)), F.lit(2)) == 1, F.get(counts, i - (1 << b))).otherwise(F.lit(0)))


def survivors(masked: DataFrame, bits: int, labels: list[str]) -> DataFrame:
    """(part, s_all, s_<label>...): arrays with an entry for each set of filters, how many documents it keeps; ``masked``: part, mask, and a boolean a label."""
    sums = masked.groupBy("part", "mask").agg(F.count("*").alias("all"), *(F.sum(F.col(n).cast("long")).alias(n) for n in labels))
    by_part = sums.groupBy("part").agg(F.map_from_entries(F.collect_list(F.struct("mask", F.struct("all", *labels)))).alias("m"))  # 2 ** bits entries at most
    full, names = (1 << bits) - 1, ["all", *labels]
    masks = F.sequence(F.lit(0), F.lit(full))

    def by_mask(n: str) -> Column:
        return F.transform(masks, lambda mask: F.coalesce(F.try_element_at("m", mask)[n], F.lit(0).cast("long"))).alias(f"s_{n}")

    out = by_part.select("part", *map(by_mask, names))
    for b in range(bits):
        out = out.select("part", *(with_bit(F.col(f"s_{n}"), b).alias(f"s_{n}") for n in names))
    # what the filters of a set keep fails nothing but filters outside it
    return out.select("part", *(F.reverse(f"s_{n}").alias(f"s_{n}") for n in names))


def audit(masked: DataFrame, names: str, labels: dict[str, str]) -> DataFrame:
    """A row for each part, order of the filters and step: filter_order, step, kept, removed, redundant, unique_fails, a column for each label's losses, shapley.

    ``masked`` has ``part`` (string), ``mask`` (bit i: fails the filter of the i-th letter of ``names``) and a boolean
    column for each key of ``labels``; its value names the column of losses. ``shapley`` is the sum over all orders of
    what the step's filter removes, which needs the subsets and not the orders. An empty table gives no rows.
    """
    k = len(names)
    full, bit = (1 << k) - 1, {c: 1 << i for i, c in enumerate(names)}
    kept = lambda column, s: F.get(F.col(column), s)

    def of_filter(c: str) -> Column:
        """What does not depend on the order, for one filter."""
        others = [s for s in range(1 << k) if not s & bit[c]]
        shapley = reduce(lambda a, b: a + b, [(kept("s_all", F.lit(s)) - kept("s_all", F.lit(s | bit[c]))) * (factorial(bin(s).count("1")) * factorial(k - 1 - bin(s).count("1"))) for s in others])
        fails = kept("s_all", F.lit(0)) - kept("s_all", F.lit(bit[c]))
        unique = kept("s_all", F.lit(full - bit[c])) - kept("s_all", F.lit(full))
        return F.struct(F.lit(bit[c]).alias("bit"), fails.alias("fails"), unique.alias("unique_fails"), shapley.alias("shapley"))

    by_part = survivors(masked, k, list(labels)).withColumn("by_filter", F.array(*map(of_filter, names)))
    # all orders and steps are a literal of k! * k entries, whatever the data
    steps = [(("".join(o)), i + 1, sum(bit[c] for c in o[:i]), names.index(c)) for o in permutations(names) for i, c in enumerate(o)]
    table = F.from_json(F.lit("[" + ",".join(f'{{"o":"{o}","i":{i},"s":{s},"f":{f}}}' for o, i, s, f in steps) + "]"), "array<struct<o:string,i:int,s:int,f:int>>")
    rows = by_part.withColumn("x", F.explode(table)).withColumn("f", F.get(F.col("by_filter"), F.col("x.f")))
    before, after = F.col("x.s"), F.col("x.s") + F.col("f.bit")
    removed = kept("s_all", before) - kept("s_all", after)
    losses = [(kept(f"s_{n}", before) - kept(f"s_{n}", after)).alias(lost) for n, lost in labels.items()]
    return rows.select("part", F.col("x.o").alias("filter_order"), F.col("x.i").alias("step"), kept("s_all", after).alias("kept"), removed.alias("removed"), (F.col("f.fails") - removed).alias("redundant"), F.col("f.unique_fails").alias("unique_fails"), *losses, F.col("f.shapley").alias("shapley"))


def document_masks(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, good, toxic) for every row of ``docs`` under five filters, bits 0 to 4.

    A: under 200 words (runs of anything but ASCII white space). B: under half of the words distinct. C: over 3 % of the
    code points are A-Z. D: one of ``#$%&*|``. E: the text of a smaller doc_id. A null text counts as empty, a null lang
    as the empty part; a null doc_id has no smaller one and is none, so neither fails E by it nor makes others fail;
    rows that share a doc_id and a text are not smaller than each other. A document is good (toxic) if any label row of
    its doc_id says so. Texts are whole; texts are compared by their sha256, counted before they are shuffled, so a text
    that most documents share is one row a task; the copies are found without sending texts.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    words = F.array_remove(F.split(F.col("t"), r"[\x20\x09-\x0D]+"), "")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"), text.alias("t"))
    fails = {1: F.size("w") < 200, 2: 100 * F.size(F.array_distinct("w")) < 50 * F.size("w"), 4: 100 * F.length(F.regexp_replace("t", "[^A-Z]+", "")) > 3 * F.length("t"), 8: F.col("t").rlike(r"[#$%&*|]")}
    rows = rows.withColumn("w", words).select("doc_id", "part", F.unhex(F.sha2("t", 256)).alias("digest"), reduce(lambda a, b: a + b, [F.when(c, v).otherwise(0) for v, c in fails.items()]).alias("mask"))
    marked = labels.groupBy(F.col("doc_id").cast("long").alias("label_id")).agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    rows = rows.join(marked, F.col("doc_id") == F.col("label_id"), "left").select("doc_id", "part", "digest", "mask", *(F.coalesce(F.col(c) == 1, F.lit(False)).alias(c) for c in ("good", "toxic")))
    rows = materialise(rows, "masks")
    copied = rows.groupBy("digest").agg(F.count("*").alias("n"), F.min("doc_id").alias("first")).where("n > 1").select(F.col("digest").alias("copied"), "first")
    copy = F.coalesce(F.col("doc_id") > F.col("first"), F.lit(False))
    return rows.join(copied, F.col("digest") == F.col("copied"), "left").select("doc_id", "part", (F.col("mask") + F.when(copy, 16).otherwise(0)).alias("mask"), "good", "toxic")

"""Mixing sources to target weights by Sainte-Lague apportionment of equal-token blocks.

The documents of a source, in a seeded order, form a stream of words that is cut into blocks of equal length;
runs of blocks are shards. Blocks are apportioned to sources by the highest quotients target / (2 k + 1), then
the blocks of a source to its shards in the same way, so every shard has an integer quota; inside a shard the
quota selects every block as often as it goes and, for the rest, the blocks with the smallest seeded hashes.
A document takes the words that it shares with selected blocks. Only Spark's own functions are used.

The length of a block goes with the source's target (a 256th of it, a power of two from 1 to 2048 words), and sources
whose blocks are equal compete for the blocks of their common target; so a tiny source is met to the word and does not
make the blocks of others short. Streams are numbered in two levels (hash buckets of a source, then offsets of the
buckets), and shards get their quotas from stretches of FAN times as many, so a source that holds most rows is worked on
by many tasks. Tables of sources and shards are joined, never collected: what reaches the driver is two numbers. Sources
themselves, a short row each, are ranked in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, fresh, materialise

SHARD_BLOCKS = 16
UNIT = 1 << 20
#: Parts into which a stretch of shards is cut at a time.
FAN = 1024


def sainte_lague(table: DataFrame, group: str, key: str, weight: str, seats: str) -> DataFrame:
    """(group, key, seats_won): in every group its ``seats`` go to the highest quotients weight / (2 k + 1), k = 0, 1, ...; ties to the smaller key.

    Only quotients near a key's proportional share can be in doubt: with n keys and N seats the share is off
    by 1/2 + share * n / (2 N) seats at most. Those below are won, those above are lost, the rest is ranked.
    Groups without weight or seats win nothing.
    """
    w = Window.partitionBy(group)
    t = table.withColumn("_w", F.sum(weight).over(w)).withColumn("_n", F.count("*").over(w))
    share = F.when((F.col("_w") > 0) & (F.col(seats) > 0), F.col(seats) * F.col(weight) / F.col("_w")).otherwise(F.lit(0.0))
    t = t.withColumn("_share", share).withColumn("_slack", F.ceil(1.5 + F.col("_share") * F.col("_n") / (2 * F.greatest(F.lit(1), F.col(seats)))))
    t = t.withColumn("_sure", F.greatest(F.lit(0), F.floor("_share") - F.col("_slack")))
    left = F.col(seats) - F.sum("_sure").over(w)
    doubtful = t.withColumn("_left", left).where(F.col("_share") > 0).select(group, key, weight, "_left", F.explode(F.sequence(F.col("_sure"), (F.floor("_share") + F.col("_slack")).cast("long"))).alias("_k"))
    order = Window.partitionBy(group).orderBy((F.col(weight) / (2 * F.col("_k") + 1)).desc(), key, "_k")
    won = doubtful.withColumn("_r", F.row_number().over(order)).groupBy(group, key).agg(F.count(F.when(F.col("_r") <= F.col("_left"), 1)).alias("_more"))
    return t.select(group, key, "_sure").join(won, [group, key], "left").select(group, key, (F.col("_sure") + F.coalesce("_more", F.lit(0))).cast("long").alias("seats_won"))


def targets(sizes: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """Adds target to ``sizes`` (skey, source_size): ``share`` of all sizes by weight, repeating in the order of skey, no source above ``most`` times its size, the excess reshared by weight.

    Ordered by the ratio at which a source is full, the full ones are a prefix; the level of the others is the
    rest divided by their weights.
    """
    every = Window.partitionBy("_all")
    ranked = sizes.withColumn("_all", F.lit(0)).withColumn("_w", F.array(*[F.lit(float(w)) for w in weights])[(F.row_number().over(every.orderBy("skey")) - 1) % len(weights)])
    ranked = ranked.withColumn("_cap", F.col("source_size") * most).withColumn("_full", F.col("_cap") / F.col("_w"))
    order = every.orderBy("_full", "skey")
    before, after = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    ranked = ranked.withColumn("_level", (F.sum("source_size").over(every) * share - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))) / F.sum("_w").over(after))
    level = F.min_by(F.when(F.col("_level") < F.col("_full"), F.col("_level")), F.when(F.col("_level") < F.col("_full"), F.struct("_full", "skey"))).over(every)
    return ranked.withColumn("target", F.least("_cap", F.coalesce(level, F.lit(float("inf"))) * F.col("_w"))).drop("_all", "_w", "_cap", "_full", "_level")


def _key(source: Column) -> Column:
    """Sorts by code point, null last."""
    return F.when(source.isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), source.cast("string")))


def shard_quotas(sources: DataFrame, most_shards: int, fan: int = FAN) -> DataFrame:
    """(skey, shard, words, quota) for ``sources`` (skey, source_size, length, seats): the seats of each source among its shards of ``length`` words.

    Seats go to stretches of shards, then inside each stretch to shorter ones, at most ``fan`` at a time; a row makes
    ``fan`` rows at most, and a window ranks as many. ``most_shards``: those of the source with the most.
    """
    levels = 1
    while fan**levels < most_shards:
        levels += 1
    parts = sources.where("source_size > 0").select("skey", "length", F.lit(0).cast("long").alias("at"), F.col("source_size").alias("words"), "seats")
    for level in reversed(range(levels)):
        unit = F.col("length") * fan**level
        inner = parts.select(F.struct("skey", "at").alias("stretch"), "length", "seats", F.col("words").alias("whole"), F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(words - 1) div (length * {fan**level})"))).alias("k"))
        inner = materialise(inner.withColumn("words", F.least(unit, F.col("whole") - F.col("k") * unit)), "stretches")
        won = sainte_lague(inner, "stretch", "k", "words", "seats")
        parts = inner.join(won, ["stretch", "k"]).select(F.col("stretch.skey").alias("skey"), "length", (F.col("stretch.at") + F.col("k") * fan**level).alias("at"), "words", F.col("seats_won").alias("seats"))
    return parts.select("skey", F.col("at").alias("shard"), "words", F.col("seats").alias("quota"))


def mix(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0, seed: int = 9) -> DataFrame:
    """(doc_id, print, skey, size, source_size, target, taken) for every row of ``docs`` (doc_id, text, source).

    size is the number of words of the text (null: 0), taken the words that the mix takes, repeats counted,
    between 0 and twice the size; print is a hash of the text. A null source is a source of its own. A row of
    size 0 takes nothing; a table without words has targets of 0. Rows are ordered by seeded hashes of doc_id
    and text, so reruns agree; repeated rows are interchangeable. Further columns are ignored.
    """
    if most != int(most):
        raise ValueError("most must be a whole number")
    id_, text = F.col("doc_id").cast("long"), F.col("text").cast("string")
    rows = docs.select(id_.alias("doc_id"), _key(F.col("source")).alias("skey"), F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long").alias("size"), F.xxhash64(text).alias("print"))
    rows = materialise(rows, "sizes")
    sources = targets(rows.groupBy("skey").agg(F.sum("size").alias("source_size")), weights, share, most)
    power = F.greatest(F.lit(0), F.least(F.lit(11), F.floor(F.log2(F.greatest(F.lit(1.0), F.col("target") / 256)))))
    sources = materialise(sources.withColumn("block", F.pow(F.lit(2), power).cast("long")), "sources")
    told = sources.agg(F.sum("source_size").alias("words"), F.max(F.expr(f"source_size div (block * {SHARD_BLOCKS}) + 1")).alias("shards")).first()
    total = told.words or 0
    buckets = max(16, min(1 << 16, total >> 15))

    # places in the streams
    order = F.xxhash64(F.lit(seed), F.coalesce("doc_id", F.lit(0)), F.col("print"))
    dealt = rows.where("size > 0").withColumn("h", order).withColumn("bucket", F.pmod(F.xxhash64(F.lit(seed + 1), "h"), F.lit(buckets)))
    sums = dealt.groupBy("skey", "bucket").agg(F.sum("size").alias("n"))
    offsets = sums.join(sources.select("skey", "block"), "skey").select("skey", "block", "bucket", (F.sum("n").over(Window.partitionBy("skey").orderBy("bucket")) - F.col("n")).alias("offset"))
    inside = F.sum("size").over(Window.partitionBy("skey", "bucket").orderBy("h", F.col("doc_id").asc_nulls_first(), "print", "size").rowsBetween(Window.unboundedPreceding, 0))
    placed = dealt.withColumn("b", inside).join(offsets, ["skey", "bucket"])
    placed = placed.select("skey", "block", "doc_id", "print", "size", (F.col("b") + F.col("offset") - F.col("size")).alias("a"), (F.col("b") + F.col("offset")).alias("b"))

    # quotas of sources whose blocks are equal, then of shards
    common = F.round(F.sum("target").over(Window.partitionBy("block")) / F.col("block")).cast("long")
    quotas = sainte_lague(sources.withColumn("_seats", common), "block", "skey", "target", "_seats")
    sources = sources.join(quotas.select("skey", F.col("seats_won").alias("seats")), "skey").withColumn("length", F.col("block") * SHARD_BLOCKS)
    shards = shard_quotas(sources, told.shards or 1).join(sources.select("skey", "block", "source_size", "target"), "skey")
    shards = materialise(shards, "shards").withColumn("n", F.expr("(words + block - 1) div block"))
    shards = shards.withColumn("quota", F.least(F.col("quota"), F.col("n") * int(most)))
    seeded = F.array_sort(F.transform(F.sequence(F.lit(0).cast("long"), F.col("n") - 1), lambda i: F.struct(F.xxhash64(F.lit(seed + 2), "skey", "shard", i).alias("h"), i.alias("i"))))
    shards = shards.select("skey", "shard", "source_size", "target", F.expr("quota div n").alias("every"), F.transform(F.slice(seeded, F.lit(1), (F.col("quota") % F.col("n")).cast("int")), lambda s: s.i).alias("once"))

    # words shared with selected blocks
    spread = placed.withColumn("shard", F.explode(F.sequence(F.expr(f"a div (block * {SHARD_BLOCKS})"), F.expr(f"(b - 1) div (block * {SHARD_BLOCKS})")))).join(shards, ["skey", "shard"])
    first, last = F.expr(f"greatest(a div block, shard * {SHARD_BLOCKS})"), F.expr(f"least((b - 1) div block, shard * {SHARD_BLOCKS} + {SHARD_BLOCKS - 1})")
    words = F.aggregate(F.sequence(first, last), F.lit(0).cast("long"), lambda t, k: t + (F.least(F.col("b"), (k + 1) * F.col("block")) - F.greatest(F.col("a"), k * F.col("block"))) * (F.col("every") + F.array_contains("once", k - F.col("shard") * SHARD_BLOCKS).cast("long")))
    taken = spread.withColumn("t", words).groupBy("skey", "a", "doc_id", "print", "size").agg(F.max("source_size").alias("source_size"), F.max("target").alias("target"), F.sum("t").alias("taken"))
    empty = rows.where("size = 0").join(sources, "skey").withColumn("taken", F.lit(0).cast("long"))
    columns = ("doc_id", "print", "skey", "size", "source_size", "target", "taken")
    return taken.select(*columns).union(empty.select(*columns))


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that the mix takes, each as often as its taken words fill its text: none, one or two copies with all columns.

    Fractions are rounded by systematic sampling: the documents of a source, in the order of their sizes, form a
    stream of fractions, and a document gets the whole numbers that its part of the stream passes. A document gets
    its fraction rounded down or up; the kept words of a source differ from its taken words by about one long
    document. Fractions are whole numbers of 1 / UNIT, so reruns agree. Rows equal in source, doc_id and text get the same copies.
    Null or empty texts take nothing and go, an empty table gives no rows, and further columns may have any names.
    """
    seed = options.get("seed", 9)
    taken = mix(docs, **options).groupBy("skey", "doc_id", "print").agg(F.max("size").alias("size"), F.expr(f"sum(taken) * {UNIT} div greatest(1, sum(size))").alias("f"))
    taken = materialise(taken.where("f > 0").withColumn("h", F.xxhash64(F.lit(seed + 3), F.coalesce("doc_id", F.lit(0)), "print")), "fractions")
    parts = max(1, min(1 << 12, taken.count() >> 10))
    taken = taken.withColumn("rank", F.floor(F.log2("size") * 8).cast("int")).withColumn("part", F.pmod(F.xxhash64(F.lit(seed + 4), "h"), F.lit(parts)))
    sums = taken.groupBy("skey", "rank", "part").agg(F.sum("f").alias("n"))
    start = F.pmod(F.xxhash64(F.lit(seed + 5), "skey"), F.lit(UNIT))
    offsets = sums.select("skey", "rank", "part", (start + F.sum("n").over(Window.partitionBy("skey").orderBy("rank", "part")) - F.col("n")).alias("offset"))
    inside = F.sum("f").over(Window.partitionBy("skey", "rank", "part").orderBy("size", "h", F.col("doc_id").asc_nulls_first(), "print").rowsBetween(Window.unboundedPreceding, 0))
    taken = taken.withColumn("b", inside).join(offsets, ["skey", "rank", "part"]).withColumn("b", F.col("b") + F.col("offset"))
    k, d, p, copies, copy = fresh(docs, "mix_source", "mix_id", "mix_print", "mix_copies", "mix_copy")
    taken = taken.withColumn("copies", F.expr(f"b div {UNIT} - (b - f) div {UNIT}").cast("int")).where("copies > 0").select(F.col("skey").alias(k), F.col("doc_id").alias(d), F.col("print").alias(p), F.col("copies").alias(copies))
    on = F.col("doc_id").cast("long").eqNullSafe(F.col(d)) & (F.xxhash64(F.col("text").cast("string")) == F.col(p)) & (_key(F.col("source")) == F.col(k))
    return docs.join(taken, on).select(*[docs[f"`{c}`"] for c in docs.columns], F.explode(F.sequence(F.lit(1), F.col(copies))).alias(copy)).drop(copy)

import random
import re

import pytest
from pyspark.sql import functions as F

from logloom.llm import mixing


def plain_seats(weights, seats):
    """One seat after the other."""
    won = {k: 0 for k in weights}
    for _ in range(seats if sum(weights.values()) > 0 else 0):
        best = max((k for k in sorted(weights) if weights[k] > 0), key=lambda k: (weights[k] / (2 * won[k] + 1), [-ord(c) for c in k]))
        won[best] += 1
    return won


@pytest.mark.parametrize("seats", [0, 1, 2, 7, 100, 333])
def test_sainte_lague_against_one_by_one(spark, seats):
    rng = random.Random(seats)
    groups = {g: {f"k{i:02d}": rng.choice([0.0, 1.0, 3.0, 3.0, 10.5, 250.0]) for i in range(n)} for g, n in (("a", 1), ("b", 3), ("c", 12))}
    table = spark.createDataFrame([(g, k, w, seats) for g, ws in groups.items() for k, w in ws.items()], "g string, k string, w double, s long")
    got = {(r.g, r.k): r.seats_won for r in mixing.sainte_lague(table, "g", "k", "w", "s").collect()}
    for g, ws in groups.items():
        assert {k: got[g, k] for k in ws} == plain_seats(ws, seats)


def plain_targets(sizes):
    keys = sorted(sizes)
    weight = {k: (5, 2, 1)[i % 3] for i, k in enumerate(keys)}
    target, left, open_ = {}, 1.5 * sum(sizes.values()), set(keys)
    while open_:
        per = left / sum(weight[k] for k in open_)
        full = [k for k in open_ if per * weight[k] > 2 * sizes[k]]
        if not full:
            target |= {k: per * weight[k] for k in open_}
            break
        for k in full:
            target[k] = 2.0 * sizes[k]
            left -= target[k]
            open_.remove(k)
    return target


@pytest.mark.parametrize("sizes", [[100, 100, 100], [1, 1000, 5], [10], [0, 10, 20, 5, 500, 3, 3, 9], [0, 0]])
def test_targets_against_water_filling(spark, sizes):
    table = {f"0{chr(97 + i)}": n for i, n in enumerate(sizes)}
    got = {r.skey: r.target for r in mixing.targets(spark.createDataFrame(list(table.items()), "skey string, source_size long")).collect()}
    for k, v in plain_targets(table).items():
        assert got[k] == pytest.approx(v, rel=1e-9, abs=1e-9)


def docs_of(spark, n=400):
    rng = random.Random(5)
    rows = [(i, " ".join(rng.choices(["ab", "c", "déf"], k=rng.choice([0, 1, 5, 40, 300]))), rng.choice(["hot", "hot", "hot", "a", "b", None])) for i in range(n)]
    rows += [(1000, None, "a"), (1001, "", "b"), (1002, "long one " * 5000, "hot"), (None, "no id here", "a"), (None, "no id here", "a"), (5, "again 5", "a"), (5, "again 5", "a"), (1003, "x y", "")]
    return spark.createDataFrame([(*r, 1, 2.0) for r in rows], "doc_id long, text string, source string, size int, target double"), rows


def test_mix_keeps_rows_sizes_and_targets(spark):
    docs, rows = docs_of(spark)
    got = mixing.mix(docs).collect()
    count = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    key = lambda s: "1" if s is None else f"0{s}"
    assert sorted(((r.doc_id is None, r.doc_id or 0), r.size, r.skey) for r in got) == sorted(((d is None, d or 0), count(t), key(s)) for d, t, s in rows)
    sizes = {}
    for _, t, s in rows:
        sizes[key(s)] = sizes.get(key(s), 0) + count(t)
    target = plain_targets(sizes)
    taken = {}
    for r in got:
        assert r.source_size == sizes[r.skey] and r.target == pytest.approx(target[r.skey])
        assert 0 <= r.taken <= 2 * r.size
        taken[r.skey] = taken.get(r.skey, 0) + r.taken
    for k, want in target.items():
        assert abs(taken[k] - want) <= max(1, 0.05 * want), k


def test_mix_does_not_depend_on_the_order_of_rows(spark):
    docs, _ = docs_of(spark)
    sig = lambda d: sorted(((r.doc_id is None, r.doc_id or 0), r.skey, r.size, r.taken) for r in mixing.mix(d).collect())
    assert sig(docs.repartition(3)) == sig(docs.orderBy(F.rand(1)).repartition(11))


def test_mixed_repeats_rows_with_all_columns(spark):
    docs, _ = docs_of(spark)
    out = mixing.mixed(docs)
    assert out.schema == docs.schema
    most = out.where("doc_id is not null and doc_id <> 5").groupBy("doc_id").count().agg(F.max("count")).first()[0]
    assert most <= 2
    assert out.exceptAll(docs.union(docs)).count() == 0


def test_mixed_keeps_quotas_of_long_documents_beside_a_tiny_source(spark):
    rng = random.Random(5)
    rows = [(None, "one two three four five six", None), (1, "seven eight nine ten", None)]
    rows += [(10 + i, " ".join(f"w{rng.randrange(99)}" for _ in range(rng.randrange(100, 900))), f"s{i % 5 if i < 240 else 2}") for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    size, key = F.size(F.split("text", " ")), F.coalesce("source", F.lit(""))
    kept = {r.k: r.n for r in mixing.mixed(docs).groupBy(key.alias("k")).agg(F.sum(size).alias("n")).collect()}
    told = {r.skey[1:]: (r.target, r.taken, r.most) for r in mixing.mix(docs).groupBy("skey").agg(F.max("target").alias("target"), F.sum("taken").alias("taken"), F.max("size").alias("most")).collect()}
    assert 0.2 < told["s2"][0] / sum(len(t.split()) for _, t, s in rows if s == "s2") < 0.9
    for k, (target, taken, most) in told.items():
        assert abs(kept.get(k, 0) - taken) <= 1.5 * most and abs(kept.get(k, 0) - target) <= max(2 * most, 0.05 * target), k  # two short rows are taken in blocks of 8 words
    again = mixing.mixed(docs.repartition(7))
    assert again.exceptAll(mixing.mixed(docs)).count() == 0


def test_mix_of_empty_tables(spark):
    assert mixing.mix(spark.createDataFrame([], "doc_id long, text string, source string")).count() == 0
    got = mixing.mix(spark.createDataFrame([(1, None, None), (2, " ", "a")], "doc_id long, text string, source string")).collect()
    assert sorted((r.doc_id, r.size, r.target, r.taken) for r in got) == [(1, 0, 0.0, 0), (2, 0, 0.0, 0)]


def test_no_python_in_the_main_path(spark):
    plan = mixing.mix(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_a_tiny_source_is_met_and_makes_no_blocks_short(spark):
    rows = [(0, "lone", "b")] + [(i, "word " * 900, "a") for i in range(1, 120)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).groupBy("skey").agg(F.max("target").alias("target"), F.sum("taken").alias("taken")).collect()
    assert sorted((r.skey, r.target, r.taken) for r in got) == [("0a", 1.5 * 107_101 - 2, pytest.approx(1.5 * 107_101 - 2, abs=512)), ("0b", 2.0, 2)]


@pytest.mark.parametrize(("shards", "fan"), [(1, 1024), (37, 4), (1_000_000, 1024)])
def test_quotas_of_many_shards(spark, shards, fan):
    """A million shards of one source: no row makes more than ``fan`` rows, and quotas are even and sum up."""
    sources = spark.createDataFrame([("0a", shards * 32 - 5, 32, shards * 24), ("0b", 7, 32, 3)], "skey string, source_size long, length long, seats long")
    got = mixing.shard_quotas(sources, shards, fan).groupBy("skey").agg(F.count("*").alias("n"), F.countDistinct("shard").alias("d"), F.sum("quota").alias("q"), F.sum("words").alias("w"), F.min("quota").alias("low"), F.max("quota").alias("high")).orderBy("skey").collect()
    assert tuple(got[1]) == ("0b", 1, 1, 3, 7, 3, 3)
    assert tuple(got[0])[1:5] == (shards, shards, shards * 24, shards * 32 - 5) and got[0].high - got[0].low <= 5


def plain_mix(spark, rows, seed=9):
    """Word by word: streams, blocks, quotas one seat after the other, and the blocks that each shard selects."""
    docs = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "n int, doc_id long, text string, source string")
    total = sum(len((t or "").split()) for _, t, _ in rows)
    buckets = max(16, min(1 << 16, total >> 15))
    h = F.xxhash64(F.lit(seed), F.coalesce("doc_id", F.lit(0)), F.xxhash64("text"))
    told = {r.n: (r.bucket, r.h, r.doc_id is not None, r.doc_id or 0, r.print) for r in docs.select("n", "doc_id", h.alias("h"), F.xxhash64("text").alias("print"), F.pmod(F.xxhash64(F.lit(seed + 1), h), F.lit(buckets)).alias("bucket")).collect()}
    streams = {}
    for n in sorted(told, key=told.get):
        key = "1" if rows[n][2] is None else f"0{rows[n][2]}"
        streams.setdefault(key, []).extend([n] * len((rows[n][1] or "").split()))
    target = plain_targets({k: len(v) for k, v in streams.items()})
    block = {}
    for k, t in target.items():
        block[k] = 1
        while block[k] < 2048 and block[k] * 2 <= t / 256:
            block[k] *= 2
    taken = dict.fromkeys(range(len(rows)), 0)
    for b in set(block.values()):
        mine = {k: target[k] for k in target if block[k] == b and streams[k]}
        seats = plain_seats(mine, round(sum(mine.values()) / b))
        for k in mine:
            shards = [streams[k][a : a + 16 * b] for a in range(0, len(streams[k]), 16 * b)]
            won = plain_seats({f"{i:06d}": len(s) for i, s in enumerate(shards)}, seats[k])
            for i, s in enumerate(shards):
                blocks = [s[a : a + b] for a in range(0, len(s), b)]
                quota = min(won[f"{i:06d}"], 2 * len(blocks))
                hashed = [tuple(r) for r in spark.range(len(blocks)).select(F.xxhash64(F.lit(seed + 2), F.lit(k), F.lit(i).cast("long"), "id"), "id").collect()]
                once = {j for _, j in sorted(hashed)[: quota % len(blocks)]}
                for j, words in enumerate(blocks):
                    for n in words:
                        taken[n] += quota // len(blocks) + (j in once)
    return sorted((rows[n][0], t) for n, t in taken.items())


def test_mix_against_word_by_word(spark):
    rng = random.Random(3)
    rows = [(i, " ".join(["w"] * rng.choice([0, 1, 7, 60, 400])), rng.choice(["a", "a", "a", "b", "c", None])) for i in range(60)] + [(100, "one two", "tiny"), (101, None, "a")]
    got = sorted((r.doc_id, r.taken) for r in mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect())
    assert got == plain_mix(spark, rows)

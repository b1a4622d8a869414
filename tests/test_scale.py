"""Work that is spread: splits of files, places in an order, closures, covers, and the text index."""

import gzip
import random
import re
import time

import pytest
from pyspark.sql import functions as F

from logloom.operators import catalog, deps, search, textindex
from logloom.operators.ranks import ranked
from logloom.sources.lines import read_lines


def test_lines_of_splits(spark, tmp_path):
    rng, want = random.Random(3), set()
    for name, n in (("a.log", 200), ("b.log", 1), ("c.log", 0), ("d.log.gz", 40)):
        lines = ["".join(rng.choice("abé\t ") for _ in range(rng.randrange(12))) for _ in range(n)]
        data = "".join(x + rng.choice(("\n", "\r\n")) for x in lines).encode()
        if name == "a.log":
            data, lines = data + b"cr\rinside\n\nopen", [*lines, "cr\rinside", "", "open"]
        (tmp_path / name).write_bytes(gzip.compress(data) if name.endswith("gz") else data)
        want |= {("d", name, i, x) for i, x in enumerate(lines, 1)}
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in ("64", "1m"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            got = read_lines(spark, f"file://{tmp_path}/*", "d")
            assert {tuple(r) for r in got.collect()} == want
            if size == "64":
                assert got.select(F.spark_partition_id()).distinct().count() > 5
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_places_are_those_of_a_sort(spark):
    rng = random.Random(1)
    rows = [(rng.choice("ab"), rng.choice([None, 1, 2, 3]), i) for i in range(500)]
    got = ranked(spark.createDataFrame(rows, "s string, t int, k int").repartition(7), ["s", "t", "k"], parts=9)
    assert got.select("_metadata.file_path").distinct().count() > 5  # one sorted file a range
    want = sorted(rows, key=lambda r: (r[0], r[1] is None, r[1] or 0, r[2]))
    assert [(r.s, r.t, r.k) for r in got.orderBy("n").collect()] == want and [r.n for r in got.orderBy("n").collect()] == list(range(1, 501))


def logs(spark, n=40):
    rows = [("d", "s", "f", f"l{i:03d}", i // 3 if i % 5 else None, i % 4, "t" if i % 2 else None, "q" if i % 3 else " ") for i in range(n)]
    return spark.createDataFrame(rows, "dataset_id string, service string, source_file string, log_id string, ts int, sequence int, thread string, trace_id string").withColumn("ts", F.timestamp_seconds("ts"))


def test_neighbours_of_a_dataset(spark):
    d = logs(spark)
    order = [r.log_id for r in d.orderBy(F.col("ts").asc_nulls_last(), "sequence", "log_id").collect()]
    got = search.neighbours(d, d.select("log_id"), "dataset", 2, 1).collect()
    assert {(r.anchor_id, r.offset, r.log_id) for r in got} == {(a, o, order[i + o]) for i, a in enumerate(order) for o in (-2, -1, 1) if 0 <= i + o < len(order)}
    one = spark.createDataFrame([("l007",)], "log_id string")
    assert search.neighbours(d, one, "dataset", 9999, 9999).count() == 39 and search.neighbours(d, one, "thread", 0, 0).count() == 0
    for bad in ({"scope": "host"}, {"before": -1}, {"after": -2}):
        with pytest.raises(ValueError):
            search.neighbours(d, one, **bad)


def test_traces_are_cut_before_they_meet_anchors(spark):
    d = logs(spark)
    order = [r.log_id for r in d.where("trace_id = 'q'").orderBy(F.col("ts").asc_nulls_last(), "sequence", "log_id").collect()]
    got = search.trace(d, d.select("log_id"), 3).collect()
    assert {(r.anchor_id, r.place, r.log_id) for r in got} == {(a, i + 1, x) for a in order for i, x in enumerate(order[:3])}
    assert {r.anchor_id for r in search.untraced(d, d.select("log_id")).collect()} == {f"l{i:03d}" for i in range(0, 40, 3)}
    with pytest.raises(ValueError):
        search.trace(d, d.select("log_id"), 0)


def test_pages_over_missing_times_and_sequences(spark):
    d = logs(spark).withColumn("sequence", F.when(F.col("sequence") > 1, F.col("sequence")))
    for order in ("asc", "desc"):
        seen, cursor = [], None
        while rows := (shown := search.page(d, 7, order, cursor)).collect():
            seen += [r.log_id for r in rows]
            cursor = search.page_end(d, shown, order).first().cursor
        assert sorted(seen) == [f"l{i:03d}" for i in range(40)]


def test_stacked_diamonds_are_a_row_a_pair(spark):
    rows = [("c", ["t0"], "class")]
    for k in range(40):
        rows += [(f"t{k}", [f"a{k}", f"b{k}"], "interface"), (f"a{k}", [f"t{k + 1}"], "interface"), (f"b{k}", [f"t{k + 1}"], "interface")]
    d = spark.createDataFrame([(c, c, above, None, kind) for c, above, kind in rows], "class_fqn string, type_id string, interfaces array<string>, superclass_fqn string, kind string")
    began = time.time()
    assert catalog.implementors(d).count() == 120 and time.time() - began < 120


def test_choice_of_dependencies_is_the_greedy_one(spark):
    rng = random.Random(8)
    loggers = [(s, f"L{i}", rng.randrange(1, 6)) for s in "xy" for i in range(40)]
    classes = sorted({(s, f"a{rng.randrange(12)}", n) for s, n, _ in loggers for _ in range(rng.randrange(4))})
    own = [("x", "L1"), ("x", "L2")]
    got = deps.select_dependencies(spark.createDataFrame([*loggers, ("x", None, 9), ("x", "L3", 1)], "service string, logger string, n long"), spark.createDataFrame(classes, "service string, artifact string, logger string"), spark.createDataFrame(own, "service string, logger string"))
    want = []
    for s in "xy":
        left, place = {n: c + (1 if (s, n) == ("x", "L3") else 0) for t, n, c in loggers if t == s and (s, n) not in own}, 0
        while True:
            hits = {}
            for t, a, n in classes:
                if t == s and n in left:
                    hits[a] = hits.get(a, 0) + left[n]
            if not hits:
                break
            best, place = min(hits, key=lambda a: (-hits[a], a)), place + 1
            want.append((s, place, best, hits[best]))
            left = {n: c for n, c in left.items() if (s, best, n) not in classes}
    assert sorted(map(tuple, got.collect())) == sorted(want) and len(want) > 6
    assert deps.select_dependencies(spark.createDataFrame([], "service string, logger string, n long"), spark.createDataFrame(classes, "service string, artifact string, logger string")).collect() == []


def test_text_index_answers_as_the_scan(spark, tmp_path):
    words = ["order", "orders", "42", "failed", "user_id", "Fail", "net.harbour.Crane", "x-1"]
    rng = random.Random(2)
    d = spark.createDataFrame([(f"l{i}", " ".join(rng.choice(words) for _ in range(rng.randrange(6)))) for i in range(80)] + [("none", None)], "log_id string, message string")
    path = f"file://{tmp_path}/index"
    textindex.add(d.where("log_id < 'l4'"), path, 0)
    textindex.add(d.where("log_id >= 'l4'"), path, 1)
    textindex.add(d.where("log_id >= 'l4'"), path, 1)  # again, in place of itself
    textindex.add(spark.createDataFrame([("l1", "failed failed orders of old")], "log_id string, message string"), path, 2)  # a message that was replaced since
    index = textindex.read(spark, path)
    for q in ("order", "order + 42", "failed | x", "-order", "order + -42", '"order 42"', '"42 failed failed"', "ord*", "o*", "ordr~1", "(order | fail) + user_id", "*", "", "order-42", '"x 1"'):
        want = {r.log_id for r in search.search(d, q=q).collect()} if q else set()
        assert {r.log_id for r in textindex.search_text(d, index, q).collect()} == want, q
    plan = textindex.candidates(index, "order + 42")._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[\(*bucket", plan), plan
    assert "EqualTo(token,order)" in plan or "In(token" in plan


@pytest.mark.parametrize("common", [0, 2, 5, 1000])
def test_top_by_tokens_is_that_of_the_full_sums(spark, common):
    from logloom.operators.tokentop import top_by_tokens, touched

    rng = random.Random(common)
    said = {f"s{i:02d}": {f"t{min(int(rng.expovariate(0.12)), 39)}" for _ in range(6)} for i in range(60)}
    rows = [(service, t, s, 8.0 / (1 + sum(t in x for x in said.values()))) for service in ("a", "b") for s, own in said.items() for t in own if service == "a" or s < "s30"]
    words = [(f"k{i}", "ab"[i % 2], f"t{t}", p) for i in range(30) for p, t in enumerate(rng.sample(range(45), rng.randrange(1, 9)))]
    w, p = spark.createDataFrame(words, "key string, service string, token string, pos int"), spark.createDataFrame(rows, "service string, token string, statement_id string, idf double")
    want = []
    for key in {x[0] for x in words}:
        sums, first = {}, {}
        for _, service, t, pos in sorted(x for x in words if x[0] == key):
            for s, token, statement, idf in rows:
                if (s, token) == (service, t):
                    sums[statement] = sums.get(statement, 0) + idf
                    first[statement] = min(first.get(statement, 99), pos)
        best = sorted(sums, key=lambda s: (-round(sums[s], 9), first[s], s))[:4]
        want += [(key, s, round(sums[s], 9), i + 1) for i, s in enumerate(best)]
    got = top_by_tokens(w, p, 4, common).collect()
    assert sorted((r.key, r.statement_id, round(r.idf, 9), r.r) for r in got) == sorted(want)
    n = touched(w, p, 4, common).agg(F.sum("walked").alias("a"), F.sum("whole").alias("b")).first()
    assert n.a <= n.b and (common not in (2, 5) or n.a < n.b)


def test_ancestors_grow_by_joins_without_broadcasts(spark):
    """Chains of 3 to 30 classes, two cycles and a missing superclass; the levels are no recursion that the driver collects and broadcasts."""
    up = {f"a{i}": f"a{i + 1}" for i in range(30)} | {"c": "c", "x": "y", "y": "z", "z": "y", "m": "gone", "n": None}
    types = spark.createDataFrame([(c, c, u) for c, u in up.items()] + [("n", "o", "x")], "class_fqn string, type_id string, superclass_fqn string")
    for levels in (1, 5, 20):
        want = set()
        for c in up:
            at, seen = c, [c]
            want.add((c, c, 0))
            while up.get(at) and up[at] not in seen and len(seen) <= levels:
                at = up[at]
                want.add((c, at, len(seen)))
                seen.append(at)
        got = catalog.ancestors(types, levels)
        assert "UnionLoop" not in got._jdf.queryExecution().optimizedPlan().toString()
        assert sorted(map(tuple, got.collect())) == sorted(want)


def test_lines_of_a_text_are_cut_once(spark):
    """Not once for each line: the class's name and the lines are computed before they are compared."""
    from logloom.functions import text

    name = F.substring(F.get(F.split("t", r"\r\n|\r|\n", -1), F.lit(2)), 1, 5)
    rows = spark.createDataFrame([("a\nb\nxc\nxc 1\n2\n \n",), (None,), ("",)], "t string")
    for made in (text.stack_trace_text(F.col("t"), name, 4), text.focus_window(F.col("t"), F.lit(1), F.lit(2), F.lit(1), 6, 2)):
        assert rows.select(made.alias("x"))._jdf.queryExecution().optimizedPlan().toString().count("split(") <= 2
    assert [r[0] for r in rows.select(text.stack_trace_text(F.col("t"), name, 4)).collect()] == ["xc\nxc 1\n2", None, None]


def test_common_tokens_are_added_up_in_blocks(spark):
    """Keys that common tokens decide: the full sums, but no row for each key and statement, in several blocks."""
    from logloom.operators import tokentop

    rng = random.Random(5)
    names = [f"t{i}" for i in range(12)]
    postings = [(s, t, f"{s}{i:03d}", 0.0 if t == "t0" else names.index(t) / 7) for s in "ab" for i in range(150) for t in names if rng.random() < (1 if t == "t0" else 0.5)]
    words = [(f"k{i}", rng.choice("ab"), t, p) for i in range(30) for p, t in enumerate(rng.sample([*names, "none"], 5))]
    w, p = spark.createDataFrame(words, "key string, service string, token string, pos int"), spark.createDataFrame(postings, "service string, token string, statement_id string, idf double")
    want, of = set(), {}
    for s, t, i, idf in postings:
        of.setdefault((s, t), []).append((i, idf))
    service = {}
    for k, _, _, _ in words:
        service.setdefault(k, next(s for a, s, _, _ in words if a == k))
    words = [(k, service[k], t, p) for k, _, t, p in words]
    w = spark.createDataFrame(words, w.schema)
    for k in service:
        sums = {}
        for a, s, t, pos in words:
            for i, idf in of.get((s, t), []) if a == k else []:
                x, y = sums.get(i, (0.0, 99))
                sums[i] = x + idf, min(y, pos)
        best = sorted(sums.items(), key=lambda x: (-round(x[1][0], 9), x[1][1], x[0]))[:6]
        want |= {(k, i, round(x, 6), r) for r, (i, (x, _)) in enumerate(best, 1)}
    seen = []
    plain, tokentop._sums = tokentop._sums, lambda a, b: seen.append(plain(a, b)) or seen[-1]
    try:
        got = {(r.key, r.statement_id, round(r.idf, 6), r.r) for r in tokentop.top_by_tokens(w, p, 6, 20, block=40).collect()}
    finally:
        tokentop._sums = plain
    assert got == want and all(x.count() == 0 for x in seen)


def test_light_tokens_are_not_walked():
    """A key's heavy tokens settle which statements can be among its best: of the light ones' postings, most of all, hardly any are walked."""
    import numpy as np
    import pyarrow as pa

    from logloom.operators import tokentop

    rng = np.random.default_rng(7)
    share = 0.5 / (1 + np.arange(300) / 4)
    has = rng.random((4000, 300)) < share
    has[:60] |= rng.random((60, 300)) < 0.6
    names, tokens = [f"s{i:04d}" for i in range(4000)], [f"t{i}" for i in range(300)]
    idf = np.log(4000 / has.sum(0))
    table = pa.table({"service": ["a"] * 4000, "statement_id": names, "constant_tokens": [[tokens[t] for t in np.flatnonzero(x)] for x in has]})
    every = np.ones(tokentop.ASKED, np.uint8)
    asked = pa.table({"service": ["a"], "unit": [0], "tokens": [tokens], "idf": [idf.tolist()]})
    rows = lambda *units: pa.concat_tables([*map(lambda x: pa.Table.from_batches([x]), units), asked], promote_options="default")
    said = [rng.choice(300, 40, replace=False, p=share / share.sum()) for _ in range(60)]
    keys = pa.table({"key": [f"k{i}" for i in range(60)], "service": ["a"] * 60, "tokens": [[tokens[t] for t in x] for x in said]})
    keys = tokentop._least(keys, rows(tokentop._unit(table.slice(0, 60), 0, True, every)), 4)
    assert keys["least"].null_count == 0
    walked, plain = [], tokentop._Index.lists
    try:
        tokentop._Index.lists = lambda self, t: walked.append(self.df[t].sum()) or plain(self, t)
        got = tokentop._best(keys, rows(tokentop._unit(table.slice(0, 1500), 1, False, every), tokentop._unit(table.slice(1500), 2, False, every)), 4).to_pylist()
    finally:
        tokentop._Index.lists = plain
    for i, x in enumerate(said):
        sums = (has[:, x] * idf[x]).sum(1)
        first = np.where(has[:, x].any(1), has[:, x].argmax(1), 99)
        best = np.lexsort((np.arange(4000), first, -np.round(sums, 9)))[:4]
        mine = sorted((r for r in got if r["key"] == f"k{i}"), key=lambda r: (-round(r["idf"], 9), r["first"], r["statement_id"]))[:4]
        assert [r["statement_id"] for r in mine] == [names[b] for b in best] and np.allclose([r["idf"] for r in mine], sums[best])
        assert [r["first"] for r in mine] == first[best].tolist()
    assert sum(walked) * 4 < sum(has[:, x].sum() for x in said)


def test_top_by_statements_is_that_of_the_full_sums(spark):
    """Two services, several blocks, a token of every statement (weight 0), copies, statements and messages without tokens, and fewer statements than asked for."""
    import math

    from logloom.operators import tokentop

    rng = random.Random(8)
    own = {("ab"[i % 2], f"s{i:03d}"): ["all", *sorted({f"t{min(int(rng.expovariate(0.1)), 60)}é" for _ in range(rng.choice((2, 6, 25)))})] for i in range(160)}
    own |= {("a", f"u{i}"): own["a", "s004"] for i in range(30)} | {("c", "s1"): ["all", "x"], ("c", "s2"): ["all"], ("d", "none"): []}
    said = {f"k{i}": (rng.choice("aabbce"), rng.sample([f"t{j}é" for j in range(63)], rng.randrange(0, 20)) + ["all"] * (i % 3 > 0)) for i in range(60)}
    df, n, want = {}, {}, set()
    for (service, _), tokens in own.items():
        n[service] = n.get(service, 0) + 1
        for t in tokens:
            df[service, t] = df.get((service, t), 0) + 1
    for key, (service, tokens) in said.items():
        sums = {}
        for (other, s), has in own.items():
            if service == other and set(has) & set(tokens):
                sums[s] = sum(math.log(n[service] / df[service, t]) for t in tokens if t in has), min(tokens.index(t) for t in has if t in tokens)
        best = sorted(sums, key=lambda s: (-round(sums[s][0], 9), sums[s][1], s))[:5]
        want |= {(key, s, round(sums[s][0], 6) + 0.0, r) for r, s in enumerate(best, 1)}
    keys = spark.createDataFrame([(k, *x) for k, x in said.items()], "key string, service string, tokens array<string>")
    statements = spark.createDataFrame([(*k, x) for k, x in own.items()], "service string, statement_id string, constant_tokens array<string>")
    for block in (40, tokentop.BLOCK):
        assert {(r.key, r.statement_id, round(r.idf, 6), r.r) for r in tokentop.top_by_statements(keys, statements, 5, block).collect()} == want
    assert tokentop.top_by_statements(keys.where("false"), statements, 5).isEmpty() and tokentop.top_by_statements(keys, statements.where("false"), 5).isEmpty()

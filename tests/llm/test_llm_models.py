import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from logloom.llm import licenses, lm, quality
from logloom.llm.common import is_fold
from logloom.llm.queries import op4_quality_classifier

SF = "/root/testdata/sf0.01"
ODD = [(1, None), (2, ""), (3, " \n"), (None, "a b"), (None, "a b"), (4, "word " * 50_000), (5, "x" * 100_000), (6, "Ü ü É")]


def fold(d):
    return zlib.crc32(("" if d is None else str(d)).encode()) % 5


# ---- quality


def area(scores, y):
    order = np.argsort(scores, kind="stable")
    rank = np.empty(len(y))
    rank[order] = np.arange(1, len(y) + 1)
    return (rank[y == 1].sum() - (y == 1).sum() * ((y == 1).sum() + 1) / 2) / ((y == 1).sum() * (y == 0).sum())


def test_held_out_accuracy(spark):
    got = {r.doc_id: r for r in op4_quality_classifier(spark, SF).collect()}
    assert len(got) == spark.read.parquet(f"{SF}/documents.parquet").count()
    assert all(r.held_out == (fold(d) == 0) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for d, r in got.items())
    told = [(got[r.doc_id].score, r.quality) for r in spark.read.parquet(f"{SF}/labels.parquet").collect() if fold(r.doc_id) == 0 and r.doc_id in got and r.quality is not None]
    s, y = np.array([t[0] for t in told]), np.array([t[1] for t in told])
    assert area(s, y) > 0.9


def test_scores_do_not_read_held_out_labels(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    flipped = labels.withColumn("quality", F.when(is_fold(F.col("doc_id"), 0), 1 - F.col("quality")).otherwise(F.col("quality")))
    train = docs.where(~is_fold(F.col("doc_id"), 0))
    a, b = quality.fit(train, labels), quality.fit(train, flipped)
    assert np.array_equal(a.weights, b.weights) and (a.bias, a.slope, a.shift) == (b.bias, b.slope, b.shift)


def test_quality_of_odd_rows_and_labels(spark):
    docs = spark.createDataFrame([(d, t, 9, "s") for d, t in ODD], "doc_id long, text string, y int, score string")
    schema = "doc_id long, quality int"
    for told in ([], [(1, 1)], [(1, None), (None, 1), (4, 7)]):
        model = quality.fit(docs, spark.createDataFrame(told, schema))
        got = quality.score(docs, model).collect()
        assert len(got) == len(ODD) and len({r.score for r in got}) == 1
    model = quality.fit(docs, spark.createDataFrame([(4, 1), (5, 0), (6, 0), (6, 1), (6, 1)], schema))
    assert sorted(((r.doc_id is None, r.doc_id or 0) for r in quality.score(docs, model).collect())) == sorted((d is None, d or 0) for d, _ in ODD)
    assert quality.keep_good(docs, model, 0.0).schema == docs.schema and quality.keep_good(docs, model, 0.0).count() == len(ODD)
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert quality.score(empty, quality.fit(empty, spark.createDataFrame([], schema))).count() == 0


def test_scores_do_not_move_with_the_sample(spark):
    rng = np.random.default_rng(3)
    words = np.array([f"w{i}" for i in range(80)])
    tilt = np.linspace(0.6, 1.4, 80)
    rows = [(i, int(i % 7 > 0), " ".join(rng.choice(words, 30, p=(p := tilt if i % 7 else tilt[::-1]) / p.sum()))) for i in range(2800)]
    docs, labels = spark.createDataFrame([(d, t) for d, _, t in rows], "doc_id long, text string"), spark.createDataFrame([(d, y) for d, y, _ in rows], "doc_id long, quality int")
    whole, capped = (np.array([r.score for r in quality.score(docs, quality.fit(docs, labels, sample=n)).orderBy("doc_id").collect()]) for n in (3000, 400))
    logit = [np.log(x / (1 - x)) for x in (whole, capped)]
    assert abs(whole.mean() - 6 / 7) < 0.05 and abs(capped.mean() - 6 / 7) < 0.05
    assert abs(logit[0].mean() - logit[1].mean()) < 0.6  # uncorrected shares of the sample: ln 6


def test_an_id_of_very_many_rows_sends_no_more_than_the_sample(spark, monkeypatch):
    seen = []
    real = quality.dual_descent
    monkeypatch.setattr(quality, "dual_descent", lambda xs, *rest: (seen.append(len(xs)), real(xs, *rest))[1])
    docs = spark.range(4000).select(F.lit(7).alias("doc_id"), F.concat(F.lit("some words "), F.col("id").cast("string")).alias("text")).union(spark.createDataFrame([(8, "other words")], "doc_id int, text string"))
    quality.fit(docs, spark.createDataFrame([(7, 1), (8, 0)], "doc_id long, quality int"), sample=10)
    assert seen and max(seen) <= 20


def test_scores_against_plain_loops_of_the_whole_model(spark):
    """Counts, ratios, hinge loss and probabilities by loops over all labelled rows, without blocks, samples or arrays."""
    import math
    import random

    rng = random.Random(2)
    docs = [(i, " ".join(rng.choice(["good", "fine", "Text,", "prose"] if i % 2 else ["BUY", "now!!", "text", "$$$"]) + rng.choice(["", "", "x"]) for _ in range(rng.randrange(3, 30)))) for i in range(60)]
    told = [(i, i % 2) for i in range(40)]
    model = quality.fit(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(told, "doc_id long, quality int"))
    features, rows = quality.Features(), []
    for d, y in told:
        rows.append((y, features(docs[d][1])))
    n = [sum(y == k for y, _ in rows) for k in (0, 1)]
    count = [Counter(f for y, x in rows if y == k for f in x.tolist()) for k in (0, 1)]
    ratio = {f: math.log((count[1][f] + 1) / (n[1] + 2) / ((count[0][f] + 1) / (n[0] + 2))) for f in count[0] | count[1]}
    rows.sort(key=lambda r: (r[0], r[1].tobytes()))
    order = np.random.default_rng(4).permutation(len(rows))
    fitted, held = [rows[i] for k, i in enumerate(order) if k % 5], [rows[i] for k, i in enumerate(order) if k % 5 == 0]
    share = {y: sum(r[0] == y for r in fitted) / len(fitted) for y in (0, 1)}
    w, bias, alpha = Counter(), 0.0, [0.0] * len(fitted)
    for _ in range(300):
        for i, (y, x) in enumerate(fitted):
            v = {f: ratio[f] / math.sqrt(len(x)) for f in x.tolist()}
            s = 2 * y - 1
            g = s * (sum(w[f] * a for f, a in v.items()) + bias) - 1
            new = min(max(alpha[i] - g / (sum(a * a for a in v.values()) + 1), 0), 0.5 / share[y])
            for f, a in v.items():
                w[f] += (new - alpha[i]) * s * a
            bias += (new - alpha[i]) * s
            alpha[i] = new
    margin = lambda x: sum(w[f] * ratio.get(f, 0) for f in x.tolist()) / math.sqrt(max(1, len(x))) + bias
    weight = {y: n[y] / sum(r[0] == y for r in held) for y in (0, 1)}
    up, down = sum(r[0] for r in held), sum(1 - r[0] for r in held)
    mean, a, b = sum(weight[y] for y, _ in held) / len(held), 1.0, 0.0

    def loss(a, b):
        out = 0.0
        for y, x in held:
            t, p = ((up + 1) / (up + 2) if y else 1 / (down + 2)), 1 / (1 + math.exp(-a * margin(x) - b))
            out -= weight[y] / mean * (t * math.log(p) + (1 - t) * math.log(1 - p))
        return out

    step = 1.0
    while step > 1e-4:
        best = min((loss(a + i * step, b + j * step), a + i * step, b + j * step) for i in (-1, 0, 1) for j in (-1, 0, 1))
        step, a, b = (step / 2, a, b) if best[1:] == (a, b) else (step, *best[1:])
    got = {r.doc_id: r.score for r in quality.score(spark.createDataFrame(docs, "doc_id long, text string"), model).collect()}
    for d, t in docs:
        assert got[d] == pytest.approx(1 / (1 + math.exp(-a * margin(features(t)) - b)), abs=0.01)


def test_features_are_distinct_and_whole():
    f = quality.Features()
    long = "some words here " * 100_000 + "ending"
    assert len(f(None)) == 0 and len(f("")) == 0
    assert np.array_equal(f(long), np.unique(f(long))) and set(f("ending")) <= set(f(long))
    assert np.array_equal(f("a b a b"), f("a b a b a b"))


# ---- language model


def plain_base(rows):
    words = {i: [*bytes(c + 32 if 65 <= c <= 90 else c for c in (t or "").encode()).split(), b""] for i, (_, t) in enumerate(rows)}
    counts = Counter(w for i, (d, _) in enumerate(rows) if fold(d) != 1 for w in words[i])
    n, v = sum(counts.values()), len(counts)
    return [(d, fold(d) == 1, len(words[i]), sum(w in counts for w in words[i]), n, sum(np.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in words[i])) for i, (d, _) in enumerate(rows)]


@pytest.mark.parametrize("hot", [50, 150_000])
def test_base_against_counting(spark, hot):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()] + [(None if d is None else 10_000 + d, t) for d, t in ODD]
    docs = spark.createDataFrame([(d, t, "x") for d, t in rows], "doc_id long, text string, n string")
    got = lm.score_texts(docs, ~is_fold(F.col("doc_id"), 1), hot=hot).collect()
    order = lambda r: (r[0] is None, r[0] or 0)
    got, want = sorted(got, key=order), sorted(plain_base(rows), key=order)
    assert len(got) == len(want)
    for g, w in zip(got, want, strict=True):
        assert (g.doc_id, g.held_out, g.n_tokens, g.n_known, g.train_tokens) == w[:5]
        assert g.base_score == pytest.approx(w[5], rel=1e-9)
        assert np.isfinite(g.score) and g.score < 0


def test_model_beats_the_base_on_held_out_texts(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    r = lm.score_texts(docs, ~is_fold(F.col("doc_id"), 1)).where("held_out").agg(F.sum("score").alias("s"), F.sum("base_score").alias("b")).first()
    assert r.s > r.b


def small_vocabulary(n=600, buckets=16):
    rng = np.random.default_rng(0)
    counts = np.r_[50, np.sort(rng.integers(1, 1000, n))[::-1]]
    return lm.Vocabulary([b"", *[f"w{i}".encode() for i in range(n)]], counts, rng.random(buckets) * 20 + 0.5, 400_000, 9000)


def test_probabilities_sum_to_one():
    v = small_vocabulary()
    net, leaves = lm.Net(v, np.random.default_rng(1).normal(0, 0.3, (3, v.rows, lm.ARITY)).astype(np.float32)), len(v.counts) + len(v.rest)
    total = 0.0
    for code in range(leaves):
        codes = np.array([3, 90, code], np.int32)
        total += float(np.exp(net.log_probabilities(codes, net.contexts(codes, np.array([True, False, False])))[-1]))
    assert total == pytest.approx(1.0, abs=1e-4)


def test_no_hot_token_is_left_to_its_count():
    """Every leaf's probability depends on the token before it."""
    v = small_vocabulary()
    net = lm.Net(v, np.random.default_rng(1).normal(0, 0.3, (3, v.rows, lm.ARITY)).astype(np.float32))
    told = [net.log_probabilities(c, net.contexts(c, np.arange(len(c)) % 2 == 0))[1::2] for c in (np.stack([np.full(616, k), np.arange(616)], 1).ravel().astype(np.int32) for k in (5, 6))]
    assert (np.abs(told[0] - told[1]) > 1e-6).all()


def plain_model(texts, v, rounds, smoothing):
    """Scores (log10) of texts by plain loops: the ways through the tree, features, updates, and unigrams inside buckets."""
    mask = (1 << 64) - 1
    start = len(v.counts) + len(v.rest)
    shift = 64 - (v.rows - 1).bit_length()

    def features(codes, i):
        p, q = codes[i - 1] if i else start, codes[i - 2] if i > 1 else start
        x = [((k * m) & mask) for k, m in zip((p + 1, p * 1000003 + q + 7, q + (3 << 40)), (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9), strict=True)]
        return [y ^ (y >> 29) for y in x]

    def way(codes, i):
        c = codes[i]
        for k in range(v.tree.start[c], v.tree.start[c] + v.tree.size[c]):
            node = int(v.tree.node[k])
            yield node, int(v.tree.slot[k]), [((((f + (node + 1) * 0x632BE59BD9B4E019) & mask) * 0xFF51AFD7ED558CCD) & mask) >> shift for f in features(codes, i)]

    def shares(w, node, rows):
        z = np.exp(sum(w[k, r] for k, r in enumerate(rows)) + v.tree.offset[node])
        return z / z.sum()

    w = np.zeros((3, v.rows, lm.ARITY))
    train = [c for c, learn in texts if learn]
    for kinds, rate in rounds:
        seen, meant = np.zeros(w.shape), np.zeros(w.shape)
        for codes in train:
            for i in range(len(codes)):
                for node, slot, rows in way(codes, i):
                    p = shares(w, node, rows)
                    for k in kinds:
                        seen[k, rows[k], slot] += 1
                        meant[k, rows[k]] += p
        w = w + rate * np.log((seen + smoothing) / (meant + smoothing))
    return [sum(np.log10(shares(w, n, r)[s]) for i in range(len(c)) for n, s, r in way(c, i)) for c, _ in texts]


@pytest.mark.parametrize("hot", [20, 1000])
def test_scores_against_plain_loops(spark, hot):
    rng = np.random.default_rng(2)
    rows = [(d, " ".join(f"w{k}" for k in (rng.zipf(1.5, 12) % 40).tolist())) for d in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.score for r in lm.score_texts(docs, ~is_fold(F.col("doc_id"), 1), hot=hot, buckets=4).collect()}
    counts = Counter(w for d, t in rows if fold(d) != 1 for w in [*t.encode().split(), b""])
    kept = sorted((w for w in counts if w), key=lambda w: (-counts[w], w))
    if hot < len(counts):  # the operator takes whole steps of equal counts; the same edge here
        v_, least = lm.vocabulary(spark.createDataFrame([(bytearray(w), n) for w, n in counts.items()], "token binary, n long"), hot, 4)
        kept = [w for w in kept if counts[w] >= least]
        assert 0 < len(kept) < len(counts) - 1
    tokens = [b"", *kept]
    rest = np.full(4, 0.5)
    for w, n in counts.items():
        if w not in tokens:
            rest[zlib.crc32(w) % 4] += n + 0.5
    v = lm.Vocabulary(tokens, np.array([counts[w] for w in tokens]), rest, sum(counts.values()), len(counts))
    place = {w: i for i, w in enumerate(tokens)}
    words = [[*t.encode().split(), b""] for _, t in rows]
    codes = [[place.get(w, len(tokens) + zlib.crc32(w) % 4) for w in t] for t in words]
    inside = [sum(np.log10((counts[w] + 0.5) / rest[zlib.crc32(w) % 4]) for w in t if w not in place) for t in words]
    want = plain_model([(c, fold(d) != 1) for c, (d, _) in zip(codes, rows, strict=True)], v, lm.ROUNDS, 20.0)
    for (d, _), a, b in zip(rows, want, inside, strict=True):
        assert got[d] == pytest.approx(a + b, rel=1e-4)


def test_words_are_cut_at_ascii_white_space_only():
    from logloom.llm.common import ascii_words

    texts = ["", " ", "a", "  A b\t\x0bc\x0c\r\n", "x\u00a0y \u2003z", "ÀÉ İ\x1cq\x85r", "word " * 3]
    flat, size = lm.words_of(__import__("pyarrow").array(texts))
    assert size.tolist() == [len(ascii_words(x)) for x in texts]
    assert [w.encode() for w in flat.to_pylist()] == [w for x in texts for w in ascii_words(x)]


def test_language_model_of_nothing(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert lm.score_texts(empty, ~is_fold(F.col("doc_id"), 1)).count() == 0
    unseen = spark.createDataFrame([(d, "a b") for d in range(40) if fold(d) == 1], "doc_id long, text string")
    got = lm.score_texts(unseen, ~is_fold(F.col("doc_id"), 1)).collect()
    assert all((r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (True, 3, 0, 0) for r in got)


# ---- licenses


def subsequence(a, b):
    """Length of the longest common subsequence."""
    row = [0] * (len(b) + 1)
    for x in a:
        last = row[:]
        for j, y in enumerate(b):
            row[j + 1] = last[j] + 1 if x == y else max(last[j + 1], row[j])
    return row[-1]


def test_alignment_is_a_common_subsequence():
    rng = np.random.default_rng(1)
    for _ in range(200):
        a, b = (rng.choice(list("abcdefghij"), rng.integers(0, 25)).tolist() for _ in range(2))
        found = licenses.align(a, b)
        assert all(a[i] == b[j] for i, j in found) and len(found) <= subsequence(a, b)
        assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(found, found[1:]))
    words = licenses.words_of(licenses.NOTICES["MIT-grant"])
    assert len(licenses.align(words, words)) == len(words)
    assert len(licenses.align([w for i, w in enumerate(words) if i % 9], words)) == len([i for i in range(len(words)) if i % 9])


def test_planted_notices_are_found(spark):
    mit, gpl = licenses.NOTICES["MIT-grant"], licenses.NOTICES["GPL-header"]
    worn = " ".join(w for i, w in enumerate(mit.split()) if i % 11)
    prose = "nothing of the kind is written in these lines and that is all there is to it " * 40
    rows = [(1, f"{prose}{mit} {prose}{gpl}"), (2, f"/* {worn.upper()} */"), (3, prose), (4, None), (5, ""), (6, f"{gpl} {gpl}"), (None, mit), (7, prose * 300 + mit)]
    got = {r.doc_id: r.found for r in licenses.scan_licenses(spark.createDataFrame([(d, t, "c") for d, t in rows], "doc_id long, text string, found string")).collect()}
    assert [f.license for f in got[1]] == ["MIT-grant", "GPL-header"] and [f.coverage for f in got[1]] == [1.0, 1.0]
    assert rows[0][1][got[1][0].start : got[1][0].end] == mit
    assert [f.license for f in got[2]] == ["MIT-grant"] and 0.8 <= got[2][0].coverage < 1
    assert [got[d] for d in (3, 4, 5)] == [[], [], []]
    assert [f.license for f in got[6]] == ["GPL-header"] * 2 and len(got[None]) == 1
    assert [(f.license, f.end) for f in got[7]] == [("MIT-grant", len(rows[7][1]))]


def plain_scan(text, least=0.8):
    """Names whose notice some stretch of words covers, by longest common subsequences over every stretch that starts with one of its words."""
    words, out = [w.lower() for w in licenses._WORD.findall(text or "")], set()
    joined = f" {' '.join(words)} "
    for name, notice in licenses.NOTICES.items():
        own = licenses.words_of(notice)
        bound = 1.0 if len(own) < licenses.SHORT else least
        have, want = Counter(words), Counter(own)
        if sum(min(have[w], n) for w, n in want.items()) < bound * len(own):
            continue
        named = licenses.NAMES.get(name)
        if named and name != "CC-BY" and f" {' '.join(licenses.words_of(named))} " not in joined:
            continue
        if any(w in want and subsequence(words[i : i + 2 * len(own)], own) >= bound * len(own) for i, w in enumerate(words)):
            out.add(name)
    return out


def test_query_against_brute_force(spark):
    from logloom.llm.queries import op3_license_scan

    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()
    got = {r.doc_id: r for r in op3_license_scan(spark, "/root/testdata/sf0.001").collect()}
    want = {r.doc_id: plain_scan(r.text) for r in rows}
    assert len(got) == len(rows) and any(want.values())
    for d, names in want.items():
        assert set(filter(None, got[d].licenses.split(","))) <= names and bool(got[d].n_found) == bool(names)


def test_whole_texts_and_look_alikes():
    scan = licenses.Scanner(licenses.NOTICES, 0.8)
    for name in ("MIT-text", "BSD-2-Clause-text", "BSD-3-Clause-text", "ISC-text", "zlib", "Apache-header"):
        found = scan(f"before\n{licenses.NOTICES[name]}\nafter it")
        assert [(f["license"], f["coverage"]) for f in found] == [(name, 1.0)]
    for text in ("Released under the Apache License", "Licensed under the BSD License", "under CC BY", "GNU Public License"):
        assert scan(text) == []
    assert [f["license"] for f in scan("This work is licensed under the GNU Lesser General Public License, version 2")] == ["LGPL"]


def test_of_two_finds_on_one_span_the_smaller_name_stays():
    found = licenses.Scanner({"b": "one two three", "a": "one two three"}, 0.8)("say one two three now")
    assert [f["license"] for f in found] == ["a"]


@pytest.mark.parametrize(
    "text, names",
    [
        ("Released under the MIT License", ["MIT"]),
        ("Released under the BSD License.", ["BSD-line"]),
        ("Released under the Zope License", []),
        ("Licensed under CC BY-NC 4.0", ["CC-BY-NC"]),
        ("Licensed under CC BY 4.0", ["CC-BY-line"]),
        ("Licensed under CC BY-NC-SA 4.0", ["CC-BY-NC-SA"]),
        ("Licensed under the Apache License, Version 2.0", ["Apache"]),
        ("Licensed under the Mozilla License, Version 2", []),
        ("This work is licensed under the GNU General Public License, version 3", ["GPL"]),
        ("This work is licensed under the GNU Lesser General Public License, version 3", ["LGPL"]),
        ("This work is licensed under the GNU Affero General Public License, version 3", ["AGPL"]),
        ("This work is licensed under a Creative Commons Attribution 4.0 International License", ["CC-BY"]),
    ],
)
def test_short_notices_need_their_names(text, names):
    assert [f["license"] for f in licenses.Scanner(licenses.NOTICES, 0.8)(f"before it {text} and after it")] == names


def test_licenses_of_an_empty_table(spark):
    assert licenses.scan_licenses(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    got = licenses.scan_licenses(spark.createDataFrame([(1, "x")], "doc_id long, text string"), notices={}).collect()
    assert [tuple(r) for r in got] == [(1, [])]

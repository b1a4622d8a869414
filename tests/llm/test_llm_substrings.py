"""Repeated windows against brute force, the parse's promise, and odd tables."""

import random

import numpy as np
import pytest

from logloom.llm.substrings import Parse, names_of, remove_repeats, window_names

LAST = 1 << 63


def brute(rows, width=20):
    words = [(LAST if d is None else d, d, (t or "").encode().split()) for d, t in rows]
    first = {}
    for k, _, w in words:
        for a in range(len(w) - width + 1):
            x = tuple(w[a : a + width])
            first[x] = min(first.get(x, LAST + 1), k)
    out = []
    for k, d, w in words:
        seen, gone = set(), [False] * len(w)
        for a in range(len(w) - width + 1):
            x = tuple(w[a : a + width])
            if first[x] < k or x in seen:
                gone[a : a + width] = [True] * width
            seen.add(x)
        out.append((d, len(w), sum(gone), b" ".join(x for x, g in zip(w, gone, strict=True) if not g).decode()))
    return out


def ordered(rows):
    return sorted(map(tuple, rows), key=lambda r: (r[0] is None, r[0] or 0, r[3]))


def text(rng, n, letters="abcdefghijklmnop", many=40):
    return " ".join(rng.choice(letters) + str(rng.randrange(many)) for _ in range(n))


def table(seed):
    rng = random.Random(seed)
    passages, rows = [text(rng, 60) for _ in range(5)], []
    for d in range(100):
        w = text(rng, rng.randrange(150)).split()
        for _ in range(rng.randrange(3)):
            at, a = rng.randrange(len(w) + 1), rng.randrange(40)
            w[at:at] = rng.choice(passages).split()[a : a + rng.randrange(10, 60)]
        rows.append((d, " ".join(w)))
    rows += [(200, "a " * 300), (201, "b a " * 100), (202, None), (203, ""), (None, passages[0]), (None, text(rng, 100, "ab", 2)), (5, passages[1]), (5, passages[1])]
    rows += [(204, " \t ".join([passages[2]] * 30)), (205, "a\n" * 25), (206, rows[3][1]), (207, rows[3][1] + " x"), (208, "é ü " * 40), (-3, passages[4])]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize(("seed", "limit", "levels"), [(1, 8 << 20, 2), (2, 500, 2), (3, 3000, 3), (4, 200, 1)])
def test_like_brute_force(spark, seed, limit, levels):
    rows = table(seed)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert ordered(remove_repeats(docs, limit=limit, levels=levels).collect()) == ordered(brute(rows))


def test_other_widths(spark):
    rows = table(5)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert ordered(remove_repeats(docs, width=7, limit=900).collect()) == ordered(brute(rows, 7))


def test_equal_words_are_parsed_alike_within_their_contexts():
    rng = random.Random(9)
    shared = [rng.choice("abcdefg") for _ in range(200)]
    one, two = ([rng.choice("abcdefg") for _ in range(n)] for n in (37, 64))
    parses = [Parse(names_of([x.encode() for x in w]), np.zeros(len(w), int)).rounds(3) for w in (one + shared + two, two + shared + one)]
    inner = []
    for p, before in zip(parses, (37, 64), strict=True):
        good = (p.lo >= before) & (p.hi <= before + 200)
        inner.append({(int(a) - before, int(n)) for a, n in zip(p.start[good], p.name[good], strict=True)})
    assert inner[0] == inner[1] and len(inner[0]) > 40


def test_windows_by_doubling_tell_windows_apart():
    words = names_of([str(i % 50).encode() for i in range(400)])
    high, low = window_names(words, 13)
    assert len(high) == 388 and len(set(zip(high.tolist(), low.tolist(), strict=True))) == 50
    assert len(window_names(words[:5], 13)[0]) == 0


def test_empty_table_and_clashing_columns(spark):
    rows = [(1, text(random.Random(1), 30), "x"), (2, text(random.Random(1), 30), "y")]
    docs = spark.createDataFrame([(*r, 0, 0) for r in rows], "doc_id long, text string, n_words string, block int, KEPT int")
    assert [r.n_removed for r in remove_repeats(docs).orderBy("doc_id").collect()] == [0, 30]
    assert remove_repeats(docs.where("doc_id > 5")).collect() == []


def test_texts_are_written_once_and_not_sent_again(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    plan = remove_repeats(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Bucketed: true" in plan and "Exchange" in plan
    for part in plan.split("Exchange")[1:]:
        assert "blob" not in part.split("\n")[0]

"""The audit against filters that are applied one after the other."""

import random
import re
from itertools import permutations

from logloom.llm.audit import audit, document_masks

LABELS = "doc_id long, quality int, toxic int"


def failures(rows):
    first = {}
    for d, t, _ in rows:
        if d is not None:
            first[t or ""] = min(first.get(t or "", d), d)
    out = []
    for d, t, lang in rows:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        told = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 3 * len(t), "D": bool(re.search(r"[#$%&*|]", t)), "E": d is not None and first[t] < d}
        out.append((d, lang or "", {k for k, v in told.items() if v}))
    return out


def by_hand(failed, good, toxic, names):
    parts, rows = sorted({p for _, p, _ in failed}), []
    for part in parts:
        mine = [(d, f) for d, p, f in failed if p == part]
        total = dict.fromkeys(names, 0)
        found = []
        for order in permutations(names):
            left = mine
            for i, c in enumerate(order):
                gone = [x for x in left if c in x[1]]
                left = [x for x in left if c not in x[1]]
                total[c] += len(gone)
                failing = sum(c in f for _, f in mine)
                found.append((part, "".join(order), i + 1, len(left), len(gone), failing - len(gone), sum(f == {c} for _, f in mine), sum(d in good for d, _ in gone), sum(d in toxic for d, _ in gone), c))
        rows += [(*r[:-1], total[r[-1]]) for r in found]
    return sorted(rows)


def table(seed):
    rng, rows = random.Random(seed), []
    for d in range(120):
        n = rng.choice((3, 150, 220, 400))
        t = rng.choice((" ", "\n\t", "  ")).join(rng.choice(("w", "W", "é", "#x", "y|", "z")[: rng.choice((2, 4, 6))]) + str(rng.randrange(rng.choice((5, 500)))) for _ in range(n))
        rows.append((d, t, rng.choice(("en", "de", None, ""))))
    rows += [(200 + i, rows[3][1], "en") for i in range(60)] + [(3, rows[3][1], "fr"), (3, rows[3][1], "fr"), (None, rows[3][1], "en"), (None, "alone", "xx"), (300, None, "yy"), (301, "", "yy"), (302, "word " * 50_000, "yy")]
    rng.shuffle(rows)
    return rows, [(d, rng.randrange(2), rng.randrange(2)) for d in range(0, 260, 2)] + [(4, 1, 1), (4, 0, None), (None, 1, 1), (3, None, None)]


def test_like_filters_in_turn(spark):
    rows, told = table(1)
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, lang string, mask string, GOOD int").repartition(4)
    masks = document_masks(docs, spark.createDataFrame(told, LABELS))
    assert masks.count() == len(rows)
    good, toxic = ({d for d, *q in told if q[k] == 1 and d is not None} for k in (0, 1))
    want = by_hand(failures(rows), good, toxic, "ABCDE")
    assert sorted(map(tuple, audit(masks, "ABCDE", {"good": "good_lost", "toxic": "toxic_lost"}).collect())) == want


def test_other_sets_of_filters(spark):
    failed = [(i, "p" if i % 3 else "q", {c for c, b in zip("xyz", f"{i * 7 % 8:03b}", strict=True) if b == "1"}) for i in range(50)]
    masked = spark.createDataFrame([(p, sum(1 << "xyz".index(c) for c in f), d < 9) for d, p, f in failed], "part string, mask int, odd boolean")
    got = audit(masked, "xyz", {"odd": "odd_lost"}).collect()
    assert sorted((r.part, r.filter_order, r.step, r.kept, r.removed, r.redundant, r.unique_fails, r.odd_lost, 0, r.shapley) for r in got) == by_hand(failed, set(range(9)), set(), "xyz")


def test_no_labels_and_no_documents(spark):
    docs = spark.createDataFrame([(1, "A", None)], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([], LABELS)
    out = audit(document_masks(docs, labels), "ABCDE", {"good": "good_lost"})
    assert out.count() == 600 and {r.part for r in out.collect()} == {""}
    assert audit(document_masks(docs.where("doc_id = 2"), labels), "ABCDE", {"good": "good_lost"}).collect() == []

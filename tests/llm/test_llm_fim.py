"""Cuts of the automaton scan against the expression itself, pieces of long texts, exact restoration."""

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from logloom.llm.fim import MARKS, automaton, chunks, cuts, fill_in_middle, restored

UNIT = re.compile(r"[A-Za-z]+|[^A-Za-z]", re.S)


def by_hand(doc_id, text):
    text = text or ""
    digits = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digits[8 * k : 8 * k + 8], 16) for k in range(4)]
    units = UNIT.findall(text)
    n = len(units)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(x in text for x in MARKS) or h[2] % 100 >= 90:
        return doc_id, n, "plain", None, None, text
    if h[3] % 100 < 20:
        return doc_id, n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return doc_id, n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def texts(seed, n=150):
    rng = random.Random(seed)
    alphabet = ["a", "Bc", "zz", " ", "\n", "é", "漢", "😀", "<", "<P", "P>", "9", "\x00", "--", "<<"]
    rows = [(i, "".join(rng.choice(alphabet) for _ in range(rng.randrange(rng.choice((5, 80, 900)))))) for i in range(n)]
    return rows + [(None, "no id"), (901, None), (902, ""), (903, "a<M>b"), (904, "<<S>"), (905, "x" * 3000), (7, rows[7][1]), (7, "another"), (-5, "minus five"), (906, "<P" + "<S" * 40)]


def plain(rows):
    return sorted(map(tuple, rows), key=repr)


@pytest.mark.parametrize(("giant", "limit"), [(1 << 20, 4 << 20), (64, 100), (1000, 1500)])
def test_like_the_expression(spark, giant, limit):
    rows = texts(giant)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    out = fill_in_middle(docs, giant=giant, limit=limit)
    assert plain(out.collect()) == plain(by_hand(*r) for r in rows)
    again = out.select("doc_id", restored(F.col("form"), F.col("output")))
    assert plain(again.collect()) == plain((d, t or "") for d, t in rows)


def test_functions_compose_to_the_whole_scan():
    machine, data = automaton(MARKS), np.frombuffer("ab<c <P><S>é xyz<M".encode() * 7, np.uint8)
    whole = machine.functions(data, np.array([0]), np.array([len(data)]))
    for size in (1, 3, 8, 50):
        start, end, _, index = chunks(np.array([0, len(data)]), size)
        state, count = machine.resolved(machine.functions(data, start, end), index)
        assert (state[-1] == whole[0][0]).all() and (count[-1] == whole[1][0]).all()


def test_cuts_of_many_texts_at_once():
    rng, rows = random.Random(4), [t or "" for _, t in texts(4)]
    raw = [t.encode() for t in rows]
    draws = np.array([[rng.randrange(1 << 32) for _ in range(2)] for _ in rows])
    units, met, at = cuts(np.frombuffer(b"".join(raw), np.uint8), np.r_[0, np.cumsum([len(x) for x in raw])], draws, automaton(MARKS), 16)
    for i, t in enumerate(rows):
        parts = UNIT.findall(t)
        assert units[i] == len(parts) and met[i] == any(m in t for m in MARKS)
        assert list(at[i]) == [len("".join(parts[:k])) for k in sorted(d % (len(parts) + 1) for d in draws[i])]


def test_empty_table_and_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "one two", 5, 6)], "doc_id long, text string, n int, Found int")
    assert tuple(fill_in_middle(docs).first()) == by_hand(1, "one two")
    assert fill_in_middle(docs.where("doc_id = 2")).collect() == []

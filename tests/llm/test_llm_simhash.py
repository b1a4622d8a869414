import random

import numpy as np
import pytest
import xxhash

from logloom.llm import simhash
from logloom.llm.components import components


def plain_fingerprint(text):
    words = bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode()).split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(rows, radius=4):
    """component by (position of the row): every pair is compared."""
    prints = [plain_fingerprint(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= radius:
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return [(d, f"{prints[i]:016x}", least.get(find(i))) for i, (d, _) in enumerate(rows)]


def some_rows():
    rng = random.Random(1)
    words = [f"w{i}" for i in range(300)]
    base = [" ".join(rng.choices(words, k=rng.randint(1, 200))) for _ in range(60)]
    rows = [(i, t) for i, t in enumerate(base)]
    rows += [(100 + i, t) for i, t in enumerate(base[:10])]  # copies
    rows += [(200 + i, f"{t} more") for i, t in enumerate(base[:30])]  # near copies
    rows += [(300, None), (301, ""), (302, " \n\t"), (303, "Two one three"), (304, "É É é"), (None, base[0]), (None, "only here and nowhere"), (7, base[7]), (305, "word " * 40_000)]
    return rows


def test_groups_against_all_pairs(spark):
    rows = some_rows()
    got = simhash.simhash_groups(spark.createDataFrame(rows, "doc_id long, text string"), tile=16).collect()
    order = lambda r: tuple((x is None, x) for x in r)
    assert sorted(map(tuple, got), key=order) == sorted(plain_components(rows), key=order)


@pytest.mark.parametrize("tile", [8, 8192])
def test_links_do_not_depend_on_tiles(spark, tile):
    rng = np.random.default_rng(2)
    x = rng.integers(0, 1 << 63, 300, dtype=np.uint64)
    near = x ^ (np.uint64(1) << rng.integers(0, 64, 300).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 300).astype(np.uint64))
    every = np.unique(np.r_[x, near, near ^ np.uint64(15)]).view(np.int64).tolist()
    root = {r.node: r.root for r in components(simhash.links(spark.createDataFrame([(v,) for v in every], "fp long"), 4, tile)).collect()}
    a = np.array(every, np.int64).view(np.uint64)
    p, q = np.nonzero(np.bitwise_count(a[:, None] ^ a[None, :]) <= 4)
    assert all(root[every[i]] == root[every[j]] for i, j in zip(p.tolist(), q.tolist()) if i != j)
    assert len(set(root.values())) == len(_plain_roots(len(every), p, q)) - sum(v not in root for v in every)


def _plain_roots(n, p, q):
    root = list(range(n))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in zip(p.tolist(), q.tolist()):
        root[find(i)] = find(j)
    return {find(i) for i in range(n)}


def test_empty_and_clashing_columns(spark):
    assert simhash.simhash_groups(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    rows = [(2, "a b c d e", 1, "x"), (1, "a b c d e", 2, "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp int, component_id string")
    assert sorted((r.doc_id, r.component_id) for r in simhash.simhash_groups(docs).collect()) == [(1, 1), (2, 1)]
    kept = simhash.keep_first(docs).collect()
    assert [tuple(r) for r in kept] == [(1, "a b c d e", 2, "y")]


def test_keep_first_keeps_one_of_each_group(spark):
    rows = some_rows()
    kept = simhash.keep_first(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    groups = plain_components(rows)
    assert sorted(r.doc_id for r in kept if r.doc_id is not None) == sorted({c for _, _, c in groups if c is not None})
    assert [r.text for r in kept if r.doc_id is None] == ["only here and nowhere"]


def test_repeated_rows_leave_one(spark):
    kept = simhash.keep_first(spark.createDataFrame([(1, "a b c")] * 3 + [(None, "a b c")], "doc_id long, text string"))
    assert [tuple(r) for r in kept.collect()] == [(1, "a b c")]


def test_components_of_a_long_chain_and_a_hub(spark):
    edges = [(i, i + 1) for i in range(200)] + [(1000, 1000 + i) for i in range(1, 300)] + [(5000, 5000)]
    root = {r.node: r.root for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert set(root) == set(range(201)) | set(range(1000, 1300))
    assert all(v == (0 if k < 1000 else 1000) for k, v in root.items())
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0

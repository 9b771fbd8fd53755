import random

import pytest
import xxhash

from gradespark.llm import simhash


def brute(rows, words=3, radius=3):
    def fp(text):
        w = [x for x in "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").replace("\t", " ").replace("\n", " ").split(" ") if x]
        if not w:
            return 0
        sh = [" ".join(w[i : i + words]) for i in range(max(1, len(w) - words + 1))]
        hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
        return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))

    fps = [fp(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= radius:
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return sorted(((d, f"{fps[i]:016x}", least.get(find(i))) for i, (d, _) in enumerate(rows)), key=str)


def corpus():
    rng = random.Random(5)
    words = ["w%d" % i for i in range(300)]
    rows = []
    for i in range(60):
        base = [rng.choice(words) for _ in range(rng.choice([1, 2, 3, 50, 400]))]
        for k in range(rng.choice([1, 1, 4])):
            own = list(base)
            if k:
                own[rng.randrange(len(own))] = rng.choice(words)
            rows.append((i * 10 + k, " ".join(own).title() if k % 2 else "\t".join(own)))
    return rows + [(900, None), (901, ""), (902, " \n"), (None, rows[0][1]), rows[3], (903, "x " * 70000)]


@pytest.mark.parametrize("tile", [8192, 4])
def test_classes_equal_brute_force(spark, tile):
    rows = corpus()
    df = spark.createDataFrame([(d, t, 1, "x") for d, t in rows], "doc_id long, text string, fp int, component_id string")
    mine = [tuple(r) for r in simhash.simhash_classes(df.repartition(5), tile=tile).collect()]
    assert sorted(mine, key=str) == brute(rows)


def test_every_tile_size_finds_the_same_links(spark):
    rng = random.Random(1)
    base = [rng.getrandbits(64) for _ in range(12)]
    fps = {b ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for b in base for _ in range(60)}
    signed = [(f - (1 << 64) if f >> 63 else f,) for f in fps]
    df = spark.createDataFrame(signed, "fp long")
    found = []
    for tile in (8192, 50, 7):
        member = {r.node: r.root for r in simhash.components(simhash.links(df, tile=tile)).collect()}
        found.append(sorted((f, member.get(f, f)) for (f,) in signed))
    assert found[0] == found[1] == found[2]


def test_long_chain_is_one_class(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(500, 400)], "a long, b long")
    member = {r.node: r.root for r in simhash.components(edges).collect()}
    assert member == {i: 0 for i in range(201)} | {400: 400, 500: 400}


@pytest.mark.parametrize("given", [{}, {"hub": 2}, {"hub": 0, "hubs": 10}])
def test_hubs_are_spread(spark, given):
    rng = random.Random(3)
    edges = [(1, i) for i in range(2, 3000)] + [(9000, i) for i in range(5000, 6000)] + [(2999, 9000)] + [(7000 + i, 7001 + i) for i in range(0, 90, 2)] + [(-4, 8000), (8000, -9)]
    rng.shuffle(edges)
    member = {r.node: r.root for r in simhash.components(spark.createDataFrame(edges + edges[:50], "a long, b long"), **given).collect()}
    want = {i: 1 for i in [*range(1, 3000), *range(5000, 6000), 9000]} | {n: n - n % 2 for n in range(7000, 7090)} | {n: -9 for n in (-9, -4, 8000)}
    assert member == want


def test_empty_table_and_stage(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.simhash_classes(df).collect() == []
    rows = [(3, "a b c d"), (1, "a b c d"), (1, "a b c d"), (None, "a b c d"), (7, "totally other words here now")]
    kept = simhash.one_of_each_class(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(r.doc_id or -1 for r in kept.collect()) == [-1, 1, 7]

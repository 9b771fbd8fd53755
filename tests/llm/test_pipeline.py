import random
from collections import Counter

import pytest

import corpus_pipeline
from gradespark.llm import mixing
from tests.llm.test_mixing import tokens
from tests.llm.test_nearcopies import brute
from tests.llm.test_tokens import check_packing

LETTERS = {"aa": ["tra", "len", "mo", "ki", "dor"], "bb": ["öş", "ğu", "yı", "çek", "zen"]}


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(9)
    rows, labels, junk = [], [], set()
    for i in range(400):
        lang = rng.choice(["aa", "aa", "bb"])
        words = ["".join(rng.choice(LETTERS[lang]) for _ in range(rng.randint(2, 4))) for _ in range(rng.randint(40, 120))]
        if i % 9 == 4:
            words, _ = [w + "###" for w in words], junk.add(i)
        rows.append([i, " ".join(words), lang, rng.choice(["big"] * 8 + ["small", None]), 0])
        if i % 2:
            labels.append((i, int(i % 9 != 4), 0))
    for i in range(0, 90, 3):  # exact copies but for case
        text = rows[i][1]
        rows.append([1000 + i, text if i % 2 else text.upper().title(), rows[i][2], "small", 0])
    for i in range(1, 90, 3):  # one or two words changed: near-copies where the text is long enough, on either side of the similarity
        if i not in junk:
            words = rows[i][1].split()
            for at in rng.sample(range(len(words)), 1 + i % 2):
                words[at] = rng.choice(words) + words[0]
            rows.append([1100 + i, " ".join(words), rows[i][2], "small", 0])
    rows += [[2000, None, None, None, None], [2001, "", "aa", "big", 0], [2002, "12 -- 34 ###", "aa", "big", 12], rows[7], rows[7]]
    for r in rows:
        r[4] = len(r[1] or "")
    path = tmp_path_factory.mktemp("tables")
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(5).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return str(path), [tuple(r) for r in rows], junk


def test_stages_against_brute_force(spark, folder, tmp_path):
    path, rows, junk = folder
    docs, kept = spark.read.parquet(f"{path}/documents.parquet"), []
    for number, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, path).write.parquet(f"{tmp_path}/{number}")
        docs = spark.read.parquet(f"{tmp_path}/{number}")
        if number < 4:
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        kept.append([tuple(r) for r in docs.collect()])
    language, quality, single, mixed, packed = kept
    # Of these texts only those without a letter go (no score is too low); all other rows stay, repeated ones too.
    assert Counter(language) == Counter(r for r in rows if r[1] and any(c.isalpha() for c in r[1]))
    gone = {r[0] for r in language} - {r[0] for r in quality}
    assert len(gone - junk) <= 2 and len(junk - gone) <= 2
    # One of each class: the smallest id, once.
    classes = brute([r[:2] for r in quality])
    assert Counter(r[0] for r in single) == Counter({d for d, c in classes if d == c})
    near = [d for d, c in classes if 1100 <= d < 1200]
    alone = sum(d == c for d, c in classes if d in near)
    assert min(alone, len(near) - alone) >= 3  # the planted copies lie on both sides of the similarity
    # Every document is read at least once, none more often than the limit; sources follow their weights.
    times = Counter(mixed)
    assert set(times) == set(single)
    share = tokens([r[:2] + (r[3],) for r in single])
    exponent = mixing.plan_mixture(spark.read.parquet(f"{tmp_path}/2"))[2]
    weight = {s: n**exponent for s, n in share.items()}
    read = tokens([r[:2] + (r[3],) for r in mixed])
    least = min(share, key=lambda s: weight[s] / share[s])
    assert read[least] == share[least]
    for s in share:
        assert read[s] == pytest.approx(share[least] * weight[s] / weight[least], abs=200)
        assert read[s] <= mixing.REPEATS * share[s] + 200
    used, most = check_packing([r[:2] for r in mixed], docs.collect(), 4096, 1)
    assert used == most
    assert Counter(packed) and len(packed) >= len(mixed)


def test_run_gives_the_stages_result(spark, folder):
    path, _, _ = folder
    first, again = corpus_pipeline.run(spark, path), corpus_pipeline.run(spark, path)
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert Counter(map(tuple, first.select(*columns).collect())) == Counter(map(tuple, again.select(*columns).collect()))


def test_empty_tables(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from gradespark.llm import language, quality

SYLLABLES = {"aa": ["tra", "len", "mo", "ki"], "ab": ["tre", "lan", "mo", "ku"], "zz": ["öş", "ğu", "yı", "çek"], "zy": ["öş", "ğü", "yi", "çak"]}


def texts(rng, lang, n):
    return ["".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randint(1, 3))) for _ in range(n)]


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(2)
    rows = [(i, " ".join(texts(rng, lang, rng.randint(3, 40))).title(), lang) for i, lang in enumerate(rng.choices(sorted(SYLLABLES), k=600))]
    rows += [(5000, None, "aa"), (5001, "", "aa"), (5002, "12 34 ... ###", "zz"), (None, "tra len", "aa"), (5003, "traleN " * 40000, None), rows[7], (5004, "lan", None)]
    return spark.createDataFrame([(*r, "x", 1.0) for r in rows], "doc_id long, text string, lang string, lang_pred string, score double").repartition(4)


def test_held_out_accuracy_and_cases(spark, docs):
    model = language.learn(docs)
    assert sorted(map(len, model.families)) == [2, 2]
    found = language.identify(docs, model).collect()
    assert len(found) == docs.count()
    by_id = {r.doc_id: r for r in found}
    for i in (5000, 5001, 5002):
        assert (by_id[i].lang_pred, by_id[i].score) == ("und", 0.0)
    assert by_id[5003].lang_pred == "aa" and by_id[5004].lang_pred == "ab" and not by_id[None].held_out
    truth = {r.doc_id: r.lang for r in docs.collect()}
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in found if r.doc_id is not None)
    held = [r for r in found if r.held_out and truth[r.doc_id] and r.lang_pred != "und"]
    assert len(held) > 100 and np.mean([truth[r.doc_id] == r.lang_pred for r in held]) > 0.97
    assert all(0 <= r.score <= 1 for r in found)


def test_inputs_of_a_prediction(spark, docs):
    """Languages of held-out documents, and everything but the text, change no prediction."""
    model = language.learn(docs)
    lied = docs.withColumn("lang", F.when(language.held_out(), F.lit("zz")).otherwise(F.col("lang"))).withColumn("score", F.lit(9.0))
    again = language.learn(lied)
    assert np.array_equal(model.pair_weights, again.pair_weights)
    a = sorted(map(tuple, language.identify(docs, model).collect()), key=str)
    assert a == sorted(map(tuple, language.identify(lied, again).collect()), key=str)


def test_language_without_examples_and_stage(spark, docs):
    assert language.learn(docs.limit(0)) is None
    assert {r.lang_pred for r in language.identify(docs, None).collect()} == {"und"}
    kept = language.keep_identified(docs, language.learn(docs))
    assert kept.columns == docs.columns and kept.count() == docs.count() - 3
    assert language.identify(docs.limit(0), None).collect() == []


def test_bound_of_the_training_rows(spark, monkeypatch):
    """300 languages and repeated ids stay within twice the sample; the same rows are taken whatever the order of the table."""
    rows = [(i, f"{chr(97 + i % 300 % 26)}{chr(97 + i % 300 // 26)} lan", f"l{i % 300:03}") for i in range(3000)]
    df = spark.createDataFrame(rows + rows[:900] + [(7, f"twice {k}", "l007") for k in range(900)], "doc_id long, text string, lang string")
    seen = []
    monkeypatch.setattr(language, "fit", lambda x, names: seen.append((x.tobytes(), names)))
    for sample, least in ((1600, 300), (200, 300), (100, 150)):
        for table in (df.repartition(3), df.orderBy(F.desc("text"))):
            language.learn(table, sample=sample)
        (a, names), (b, again) = seen[-2:]
        assert a == b and names == again and len(names) <= 2 * sample
        assert len(set(names)) > 0.5 * least


def test_stage_drops_languages_never_learned(spark, docs):
    rng = random.Random(6)
    alphabets = {"cyrillic": "абвгдежзиклмнопрст", "kana": "かきくけこさしすせそたちつてと"}
    foreign = [(7000 + i, " ".join("".join(rng.choice(a) for _ in range(rng.randint(2, 8))) for _ in range(60)), "aa", "x", 1.0) for i, a in enumerate(list(alphabets.values()) * 50)]
    model = language.learn(docs)
    kept = language.keep_identified(docs.unionByName(spark.createDataFrame(foreign, docs.schema)), model)
    assert kept.where("doc_id >= 7000").count() == 0
    assert kept.count() == docs.count() - 3
    assert 0.5 < model.needed <= language.NEEDED


@pytest.fixture(scope="module")
def marked(spark):
    rng = random.Random(4)
    rows, labels = [], []
    for i in range(500):
        words, good = texts(rng, "aa", rng.randint(5, 60)), rng.random() < 0.7
        if not good:
            words = rng.choice([[w + "###" for w in words], words[:1] * 50, [w.upper() + "!!" for w in words]])
        # The source tells something too, but not always.
        source = rng.choice(["s1", "s2"] if good or rng.random() < 0.3 else ["bad"])
        rows.append((i, " ".join(words), "aa", source, len(" ".join(words))))
        if i % 2:
            labels.append((i, int(good), 0))
    truth = dict((r[0], not any(x in r[1] for x in "#!") and len(set(r[1].split())) > 1) for r in rows)
    rows += [(900, None, None, None, None), (901, "", "aa", "s1", 0), (902, "tra " * 50000, "aa", "bad", None), (None, "tra len mo", "aa", "s1", -4)]
    labels += [(1, 1 - int(truth[1]), 0), (3, None, 1), (None, 1, 0), (7, int(truth[7]), 0)]
    df = spark.createDataFrame([(*r, 0.5, True) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, score double, keep boolean")
    return df.repartition(3), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), truth


def test_quality_on_documents_without_a_label(spark, marked):
    docs, labels, truth = marked
    model = quality.learn(docs, labels)
    found = {r.doc_id: r for r in quality.score_quality(docs, model).collect()}
    assert len(found) == docs.count()
    assert found[900].score == 0 and found[901].score == 0 and not found[900].keep
    assert not found[902].keep
    free = [i for i in truth if i % 2 == 0]
    assert np.mean([found[i].keep == truth[i] for i in free]) > 0.95
    assert all(0 <= r.score <= 1 for r in found.values())
    kept = quality.keep_good(docs, model)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id or -1 for r in kept.collect()) == sorted(r.doc_id or -1 for r in found.values() if r.keep)


def test_quality_without_labels(spark, marked):
    docs, labels, _ = marked
    assert quality.learn(docs, labels.limit(0)) == 0.5
    assert quality.learn(docs, labels.where("quality = 1")) > 0.9
    rows = quality.score_quality(docs, 0.5).collect()
    assert {r.score for r in rows} == {0.0, 0.5}
    assert quality.score_quality(docs.limit(0), 0.5).collect() == []


def test_views_hand_guesses_to_each_other():
    """Unlabelled documents improve a view that has few labels to start from."""
    rng = np.random.default_rng(0)
    y = (rng.random(3000) < 0.5).astype(float)
    one = np.hstack([y[:, None] * 2 - 1 + rng.normal(0, 0.4, (3000, 1)), np.ones((3000, 1))])
    two = np.hstack([(y[:, None] * 2 - 1) * 0.5 + rng.normal(0, 1, (3000, 30)), np.ones((3000, 1))])
    lab, pool, test = slice(0, 24), slice(24, 1500), slice(1500, 3000)
    right = []

    def choose(model):
        text, meta, _ = model.views(one[pool], two[pool])
        found = []
        for p in (meta, text):
            order = np.argsort(-p, kind="stable")
            rows = [(r, 1.0) for r in order[:200] if p[r] >= 0.9] + [(r, 0.0) for r in order[::-1][:200] if p[r] <= 0.1]
            at = [r for r, _ in rows]
            found.append((np.array([g for _, g in rows]), one[pool][at], two[pool][at]))
        return found

    for rounds in (0, 4):
        model = quality.co_train(one[lab], two[lab], y[lab], quality.Metadata({}, {}), choose, rounds=rounds)
        right.append(((two[test] @ model.meta_weights > 0) == (y[test] > 0.5)).mean())
    assert right[1] > right[0]


def brute_learn(docs, labels, labelled, rounds, sure, handed):
    """Co-training of plain rows ``(doc_id, text, source, lang, n_chars)``, all of them looked at in every round."""
    marks = {}
    for doc, y in labels:
        marks.setdefault(doc, set()).add(y)
    order = lambda doc: (zlib.crc32(str(doc).encode()), doc)
    known = {d: float(*y) for d, y in marks.items() if len(y) == 1}
    assert len(known) <= labelled
    usable, features = {d[0]: d for d in docs if d[0] is not None and d[1]}, quality.text_features()
    got = sorted((d for d in usable if d in known), key=order)
    names = quality.Metadata(quality._names([usable[d][2] for d in got], quality.SOURCES), quality._names([usable[d][3] for d in got], quality.LANGS))
    text = lambda ids: np.array([features(usable[d][1]).astype(np.float32) for d in ids], float).reshape(len(ids), -1)
    meta = lambda ids: np.array([names.features(*usable[d][2:]) for d in ids]).reshape(len(ids), -1)
    free, rounds_seen = [d for d in usable if d not in known], []

    def choose(model):
        exact = np.array([features(usable[d][1]) for d in free])
        a, b, _ = model.views(exact, meta(free))
        found = []
        for p in (b, a):
            best = {}
            for d, q in zip(free, p):
                for y, s in ((1, q), (0, 1 - q)):
                    if s >= sure:
                        best.setdefault((y, quality.stratum_of(usable[d][2])), []).append((-s, *order(d)))
            pairs = sorted(((r[-1], y) for (y, _), rows in best.items() for r in sorted(rows)[:handed]), key=lambda r: (*order(r[0]), r[1]))
            ids = [d for d, _ in pairs]
            found.append((np.array([y for _, y in pairs], float), text(ids), meta(ids)))
        rounds_seen.append({d for d in free for g in found for x in g[1] if np.array_equal(x, text([d])[0])})
        return found

    model = quality.co_train(text(got), meta(got), np.array([known[d] for d in got]), names, choose, rounds)
    return model, rounds_seen


def test_co_training_equals_brute_force_and_reaches_rare_sources(spark, marked):
    docs, labels, _ = marked
    rows = [(r.doc_id, r.text, r.source, r.lang, r.n_chars) for r in docs.select("doc_id", "text", "source", "lang", "n_chars").collect()]
    counts = {r[0]: 0 for r in rows}
    for r in rows:
        counts[r[0]] += 1
    rows = [r for r in rows if counts[r[0]] == 1 and r[0] is not None]
    marks = [(r.doc_id, r.quality) for r in labels.collect() if r.quality in (0, 1)]
    held = {d for d, _ in marks}
    rare = [(90_000 + i, t, "rare", g, n) for i, (_, t, _, g, n) in enumerate([r for r in rows if r[1] and r[0] not in held][:12])]
    rows += rare
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, n_chars long").repartition(5)
    given = {"rounds": 2, "sure": 0.8, "handed": 4}
    model = quality.learn(df, labels, **given)
    want, seen = brute_learn(rows, marks, 4000, **given)
    assert np.allclose(model.text_weights, want.text_weights) and np.allclose(model.meta_weights, want.meta_weights)
    assert np.allclose(model.mix, want.mix) and model.names == want.names
    assert any(d >= 90_000 for some in seen for d in some)


def test_views_that_are_sure_of_nothing(spark, marked):
    docs, labels, _ = marked
    none = quality.learn(docs, labels, sure=1.1)
    assert np.allclose(none.text_weights, quality.learn(docs, labels, rounds=0).text_weights)
    one = quality.learn(docs, labels, rounds=1, sure=0.999)
    assert one.meta_weights.shape == (one.names.width,)


def test_metadata_by_name():
    names = quality.Metadata(quality._names(["a", "b", "a", None], 2), quality._names(["de", "es"], 63))
    assert names.sources == {"a": 1, "b": 2}
    vectors = [names.features(s, g, 9).tolist() for s, g in (("a", "de"), ("b", "de"), ("a", "es"), ("never", None), (None, "fr"))]
    assert len({tuple(v) for v in vectors}) == 4 and vectors[3] == vectors[4]


def test_learning_gives_the_drivers_memory_back(spark, monkeypatch):
    from gradespark.llm import common

    calls = []
    monkeypatch.setattr(common, "release", lambda: calls.append(1))
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    assert language.learn(docs) is None and calls == [1]
    assert quality.learn(docs, spark.createDataFrame([], "doc_id long, quality int, toxic int")) == 0.5 and calls == [1, 1]
    with pytest.raises(AttributeError):
        language.learn(None)
    assert calls == [1, 1, 1]

"""What fits take of the driver's memory."""

import random
import tracemalloc

import numpy as np
import pytest

from gradespark.llm import language, quality


def peak(run) -> tuple[object, int]:
    """The result of a call and the most bytes that it held at once in Python and numpy."""
    tracemalloc.start()
    try:
        return run(), tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(4)
    words = {"aa": ["tra", "len", "mo", "ki"], "bb": ["öş", "ğu", "yı", "çek"], "cc": ["wer", "sta", "ung", "ich"]}
    text = lambda lang: " ".join("".join(rng.choice(words[lang]) for _ in range(3)) for _ in range(60))
    rows = [(i, text(lang), lang, f"s{i % 3}", 0) for i in range(600) for lang in [rng.choice(sorted(words))]]
    rows = [(*r[:1], r[1] if r[0] % 2 else r[1] + " ###" * 20, *r[2:]) for r in rows]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(4)


def test_language_fit_holds_its_rows_once(docs):
    """One matrix, and none more for collected rows, for training or for a machine."""
    model, most = peak(lambda: language.learn(docs))
    assert model.languages == ["aa", "bb", "cc"]
    rows = docs.where(~language.held_out()).count()
    assert most < 2.2 * rows * language.FEATURES * 4


def test_quality_fit_holds_its_rows_in_single_precision(spark, docs):
    many = docs.crossJoin(spark.range(6)).selectExpr("doc_id + 600 * id as doc_id", "text", "lang", "source", "n_chars")
    labels = many.selectExpr("doc_id", "cast(doc_id % 2 as int) as quality", "0 as toxic")
    model, most = peak(lambda: quality.learn(many, labels, rounds=0))
    assert isinstance(model, quality.Model)
    rows, square = many.count() * quality.TEXT_WIDTH * 4, quality.TEXT_WIDTH**2 * 8
    assert most < 2.5 * rows + 3 * square


def test_logistic_fit_goes_by_blocks():
    rng = np.random.default_rng(1)
    x, y = rng.random((20_000, 40), np.float32), (rng.random(20_000) < 0.4).astype(float)
    weights, most = peak(lambda: quality._logistic(x, y, 1.0))
    assert most < x.nbytes / 4
    whole = x.astype(float)
    p = 1 / (1 + np.exp(-(whole @ weights)))
    assert np.abs(whole.T @ (p - y) + weights).max() < 1e-6


def test_packed_profiles_are_whole_and_sort_alike():
    rng = np.random.default_rng(2)
    profiles = [np.where(rng.random(language.FEATURES) < share, rng.random(language.FEATURES), 0) for share in (0, 0.001, 0.2, 1) for _ in range(20)]
    for k in range(0, 40, 2):  # equal up to one place
        profiles[40 + k] = profiles[41 + k].copy()
        profiles[40 + k][rng.integers(language.FEATURES)] = rng.choice([0, 0.5])
    whole, few = [p.astype(np.float32).tobytes() for p in profiles], [language.packed(p) for p in profiles]
    assert sorted(range(len(few)), key=few.__getitem__) == sorted(range(len(whole)), key=whole.__getitem__)
    rows = language.unpacked(few)
    assert [r.tobytes() for r in np.ascontiguousarray(rows[:, :-1])] == whole and (rows[:, -1] == 1).all()

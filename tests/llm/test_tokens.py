import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer, models, pre_tokenizers

from gradespark.llm import packing, tokencount

JSON = open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf8").read()
VOCABULARY = tokencount.vocabulary_of(public_tokenizers.path("piece_bpe_32k.model"))


def exact(vocabulary, byte_fallback):
    t = Tokenizer(models.Unigram(vocabulary, unk_id=0, byte_fallback=byte_fallback))
    t.pre_tokenizer = pre_tokenizers.Metaspace(replacement="▁", prepend_scheme="always")
    return lambda text: len(t.encode(text, add_special_tokens=False).ids)


full, counter = exact(VOCABULARY, True), tokencount.UnigramCounter(VOCABULARY)
TEXTS = ["", " ", "  two  blanks ", "Hello world", "naïve café über\nnew\tline", "梦 ң 🙂🙂 ▁x▁▁y", "<s> <0x41> <unk>", "aaaa" * 500, "\u0000​"]


def test_counts_equal_the_tokenizer():
    assert [counter.text(t)[0] for t in TEXTS] == [full(t) for t in TEXTS]


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from("the aing▁\n.éñ梦🙂<0x4>"), max_size=60))
def test_counts_equal_the_tokenizer_on_any_text(text):
    assert counter.text(text)[0] == full(text)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="abcd ", max_size=30), st.randoms(use_true_random=False))
def test_ties_follow_the_tokenizer(text, rng):
    pieces = sorted({"".join(rng.choice("abc") for _ in range(rng.randint(1, 4))) for _ in range(12)})
    vocabulary = [("<unk>", 0.0), ("▁", -1.0), ("▁a", -2.0), *[(p, -float(rng.randint(1, 3))) for p in pieces]]
    assert tokencount.UnigramCounter(vocabulary).text(text)[0] == exact(vocabulary, False)(text)


def test_count_table(spark):
    rows = [(1, None), (1, ""), (None, "Hello world"), (2, "x " * 60000), (3, "y" * 100000)] + [(9, t) for t in TEXTS]
    df = spark.createDataFrame([(*r, "z") for r in rows], "doc_id long, text string, n_tokens string")
    found = sorted(((r.doc_id, r.n_tokens) for r in tokencount.count_tokens(df, VOCABULARY).collect()), key=str)
    assert found == sorted(((d, full(t or "")) for d, t in rows), key=str)
    assert tokencount.count_tokens(df.limit(0), VOCABULARY).count() == 0


def check_packing(rows, packed, capacity, end_id):
    t = Tokenizer.from_str(JSON)
    want = []
    for doc, text in rows:
        ids = t.encode(text or "", add_special_tokens=False).ids + [end_id]
        for k, start in enumerate(range(0, len(ids), capacity)):
            part = ids[start : start + capacity]
            want.append((doc, k, start, len(part), zlib.crc32(np.array(part, "<u4").tobytes())))
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in packed), key=str) == sorted(want, key=str)
    bins = defaultdict(list)
    for r in packed:
        bins[r.sequence_id].append((r.offset, r.length))
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(bins), -(-sum(w[3] for w in want) // capacity)


def test_packing_round_trip(spark):
    rng = random.Random(3)
    words = ["alpha", "Beta's", "gamma-ray", "dé", "x1y22", "<|endoftext|>", "🙂", "ΣΑΣ", "İ"]
    rows = [(i, rng.choice([" ", "\n", "\t ", " "]).join(rng.choice(words) for _ in range(rng.randint(0, 60)))) for i in range(300)]
    rows += [(1, None), (None, ""), rows[5], rows[5], (7000, "word " * 9000), (7001, "q" * 5000)]
    df = spark.createDataFrame([(*r, 5, "s") for r in rows], "doc_id long, text string, length int, sequence_id string").repartition(7)
    for chunk in (20_000, 40):
        packed = packing.pack(packing.token_pieces(df, JSON, capacity=64), capacity=64, chunk=chunk).collect()
        used, least = check_packing(rows, packed, 64, 1)
        assert used <= least * 1.02 + 1
    ids = packing.token_pieces(df, JSON, capacity=64, with_ids=True).where("doc_id = 7001").collect()
    assert sum(len(r.ids) for r in ids) == sum(r.length for r in ids)
    empty = packing.pack(packing.token_pieces(df.limit(0), JSON))
    assert empty.collect() == [] and "offset" in empty.columns


def test_local_search_empties_bins():
    # Best fit leaves three bins where two suffice: 6+4, 5+3+2.
    lengths = np.array([6, 5, 4, 3, 2])
    bad = np.array([0, 1, 2, 0, 1])
    better = packing.local_search(lengths, bad, 10)
    assert len(set(better.tolist())) == 2
    rng = np.random.default_rng(0)
    for _ in range(30):
        lengths = rng.integers(1, 60, 200)
        of = packing.best_fit(lengths, 100)
        better = packing.local_search(lengths, of, 100)
        assert np.bincount(better, weights=lengths).max() <= 100
        assert len(set(better.tolist())) <= len(set(of.tolist()))


shared = packing._WordIds(JSON)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from("abAZé19'.,%—´≠̸́\n \t<|ΣςİK№²…"), max_size=12), max_size=12))
def test_word_ids_equal_the_tokenizer(texts):
    joined = [" ".join(texts), "".join(texts), "<|endoftext|>" + "".join(texts), *texts]
    shared.known.clear()
    found = [np.frombuffer(b, "<u4").tolist() for b in shared.texts(joined)]
    assert found == [shared.tokenizer.encode(t, add_special_tokens=False).ids for t in joined]


def test_words_of_a_rich_vocabulary_are_encoded_once(monkeypatch):
    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf8") as file:
        words = packing._WordIds(file.read())
    texts, encoded = [" ".join(f"w{i}x{at}" for i in range(100)) for at in range(1800)], []
    encode = words._encode
    monkeypatch.setattr(words, "_encode", lambda new: (encoded.append(len(new)), encode(new)))
    first = list(words.texts(texts))
    assert sum(encoded) == 180_000 and list(words.texts(texts)) == first and sum(encoded) == 180_000

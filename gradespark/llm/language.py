"""Language identification in two steps: the family first, then the language within it.

A linear support vector machine per family against the others picks a family;
within a family one machine per pair of languages votes. Families are groups of
languages with similar letter n-grams, found on the training sample. The sample
has a stated bound; every whole text is classified, in Arrow batches.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradespark.llm.common import map_texts, narrow, released, settled

UNKNOWN = "und"
FEATURES = 4096
#: Training documents in all (about so many, never more than twice as many; shared out evenly over the languages), and at least for each language where these fit.
SAMPLE, LEAST = 1600, 20
#: Share of the training documents that set the slopes of the scores and train no machine.
CALIBRATION = 0.25
#: The score a text needs to count as identified: so much, or less if more than a share of the calibration documents had none so high.
NEEDED, MISSED = 0.95, 0.005
_MIX = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D], np.uint32)
#: An entry of a profile on its way to the driver; places count down, so that bytes sort as those of the whole profile.
_ENTRY = np.dtype([("back", ">u2"), ("value", "<f4")])


def letter_profile() -> Callable[[str | None], np.ndarray | None]:
    """A function from a whole text to its hashed letter 1- to 3-grams of length 1, None without a letter.

    Letters are lower-cased; all else is a word border, and a row of borders is one.
    """
    alpha = np.frombuffer(bytes(map(str.isalpha, map(chr, range(0x110000)))), bool)
    shift = np.uint32(32 - FEATURES.bit_length() + 1)

    def profile(text: str | None) -> np.ndarray | None:
        codes = np.frombuffer((text or "").lower().encode("utf-32-le", "replace"), np.uint32)
        letter = alpha[codes] if len(codes) else np.zeros(0, bool)
        if not letter.any():
            return None
        border = ~letter
        border[1:] &= letter[:-1]
        codes = np.where(letter, codes, np.uint32(32))[letter | border]
        codes = np.concatenate([np.array([32], np.uint32), codes, np.array([32], np.uint32)])
        one, two = codes * _MIX[0], codes[1:] * _MIX[1]
        pair = one[:-1] + two
        hashed = (one, pair, pair[:-1] + codes[2:] * _MIX[2])
        counts = np.zeros(FEATURES)
        for h in hashed:
            counts += np.bincount(((h ^ (h >> np.uint32(15))) * _MIX[0]) >> shift, minlength=FEATURES)
        counts = np.sqrt(counts)
        return counts / np.sqrt((counts**2).sum())

    return profile


def packed(profile: np.ndarray) -> bytes:
    """The entries of a profile that are not 0, in single precision."""
    single = profile.astype(np.float32)
    places = np.flatnonzero(single)
    out = np.empty(len(places), _ENTRY)
    out["back"], out["value"] = FEATURES - 1 - places, single[places]
    return out.tobytes()


def unpacked(profiles: list[bytes]) -> np.ndarray:
    """Packed profiles as rows, in single precision, with a last column of ones."""
    x = np.zeros((len(profiles), FEATURES + 1), np.float32)
    for row, found in zip(x, profiles):
        entries = np.frombuffer(found, _ENTRY)
        row[FEATURES - 1 - entries["back"].astype(np.int64)] = entries["value"]
    x[:, -1] = 1
    return x


def linear_svm(x: np.ndarray, rows: np.ndarray, y: np.ndarray, cost: float = 4.0, sweeps: int = 12) -> np.ndarray:
    """Weights (the last one is the offset) of a squared-hinge machine on some rows of ``x``, by dual coordinate descent.

    The last column of ``x`` is 1; ``y`` has a value for each of ``rows``. No row is copied.
    """
    norms = np.array([np.einsum("j,j->", x[r], x[r], dtype=float) for r in rows]) + 0.5 / cost
    alpha, w = np.zeros(len(rows)), np.zeros(x.shape[1])
    rng = np.random.default_rng(0)
    for _ in range(sweeps):
        for i in rng.permutation(len(rows)):
            row = x[rows[i]]
            step = y[i] * (row @ w) - 1 + 0.5 / cost * alpha[i]
            new = max(alpha[i] - step / norms[i], 0.0)
            if new != alpha[i]:
                w += (new - alpha[i]) * y[i] * row
                alpha[i] = new
    return w


def _slope(margins: np.ndarray, y: np.ndarray) -> float:
    """The k for which 1 / (1 + exp(-k m)) fits best."""
    if not len(margins):
        return 2.0
    grid = np.geomspace(0.5, 16, 40)
    loss = [np.logaddexp(0, -k * y * margins).sum() for k in grid]
    return float(grid[int(np.argmin(loss))])


@dataclass
class Model:
    languages: list[str]
    families: list[list[int]]
    family_weights: np.ndarray
    family_slope: float
    pairs: list[tuple[int, int]]
    pair_weights: np.ndarray
    pair_slope: float
    #: Texts below this score are of no learned language.
    needed: float = 0.0

    def predict(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Language positions and scores of rows of profiles."""
        x = np.hstack([x, np.ones((len(x), 1))])
        margin = self.family_slope * (x @ self.family_weights)
        share = np.exp(margin - margin.max(1, keepdims=True))
        share /= share.sum(1, keepdims=True)
        votes = 1 / (1 + np.exp(-np.clip(self.pair_slope * (x @ self.pair_weights), -500, 500)))
        best, score, family = np.zeros(len(x), np.int64), np.zeros(len(x)), share.argmax(1)
        for f, members in enumerate(self.families):
            rows = np.nonzero(family == f)[0]
            within = np.zeros((len(rows), len(members)))
            for k, (a, b) in enumerate(self.pairs):
                if a in members and b in members:
                    within[:, members.index(a)] += votes[rows, k]
                    within[:, members.index(b)] += 1 - votes[rows, k]
            within = within / within.sum(1, keepdims=True) if len(members) > 1 else np.ones((len(rows), 1))
            top = within.argmax(1)
            best[rows] = np.array(members)[top]
            score[rows] = share[rows, f] * within[np.arange(len(rows)), top]
        return best, score


def _families(centres: np.ndarray) -> list[list[int]]:
    """Merge the two most alike groups until there are about the square root of the number of languages."""
    groups = [[i] for i in range(len(centres))]
    centred = centres - centres.mean(0)
    alike = centred @ centred.T / np.maximum(np.outer(*[np.linalg.norm(centred, axis=1)] * 2), 1e-12)
    while len(groups) > int(np.ceil(np.sqrt(len(centres)))):
        a, b = max(combinations(range(len(groups)), 2), key=lambda p: alike[np.ix_(groups[p[0]], groups[p[1]])].mean())
        groups[a] = sorted(groups[a] + groups.pop(b))
    return groups


def fit(x: np.ndarray, languages: list[str]) -> Model | None:
    """Fit families, machines and slopes to rows of profiles with a last column of ones; None without any example."""
    names = sorted(set(languages))
    if not names:
        return None
    of = np.array([names.index(n) for n in languages])
    held = np.arange(len(of)) % round(1 / CALIBRATION) == 0
    for n in range(len(names)):
        if not (of[~held] == n).any():
            held[of == n] = False
    families = _families(np.array([x[of == n, :-1].mean(0) for n in range(len(names))]))
    family_of = np.array([next(f for f, m in enumerate(families) if n in m) for n in range(len(names))])
    pairs = [p for m in families for p in combinations(m, 2)]
    train, hx, hy = np.flatnonzero(~held), x[held], of[held]
    sign = lambda positive: np.where(positive, 1.0, -1.0)
    width = x.shape[1]
    family_weights = np.zeros((width, len(families)))
    if len(families) > 1:
        family_weights = np.stack([linear_svm(x, train, sign(family_of[of[train]] == f)) for f in range(len(families))], axis=1)
    pair_weights, margins, truth = np.zeros((width, len(pairs))), [], []
    for k, (a, b) in enumerate(pairs):
        rows, shown = train[np.isin(of[train], (a, b))], np.isin(hy, (a, b))
        pair_weights[:, k] = linear_svm(x, rows, sign(of[rows] == a))
        margins.append(hx[shown] @ pair_weights[:, k])
        truth.append(sign(hy[shown] == a))
    outer = hx @ family_weights
    family_slope = _slope(outer.ravel(), sign(family_of[hy][:, None] == np.arange(len(families))).ravel())
    slope = _slope(np.concatenate(margins), np.concatenate(truth)) if pairs else 1.0
    model = Model(names, families, family_weights, family_slope, pairs, pair_weights, slope)
    if len(hx):
        model.needed = min(NEEDED, float(np.quantile(model.predict(hx[:, :-1])[1], MISSED, method="lower")))
    return model


def held_out(id_col: str | Column = "doc_id") -> Column:
    """The documents nothing is learned from: crc32 of the id as text, modulo 3, is 1."""
    ident = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.coalesce(F.pmod(F.crc32(ident.cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))


@released
def learn(docs: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model | None:
    """Fit on about ``sample`` documents, never more than twice as many, chosen by a hash of their id.

    Each language gets the same share of the sample: ``LEAST`` documents or more
    while that many fit into twice the sample, fewer with more languages. Where
    even one of each would not fit, languages with the fewest documents are not learned.

    Documents that are held out, have no id, no language or no letter are not learned from.
    """
    rows = narrow(docs, {"doc_id": F.col(id_col).cast("bigint"), "text": F.col(text_col).cast("string"), "lang": F.col(lang_col).cast("string")})
    rows = rows.where("doc_id is not null and lang is not null and text is not null").where(~held_out())
    most = 2 * sample
    counts = settled(rows.groupBy("lang").agg(F.count("*").alias("_all")).orderBy(F.desc("_all"), "lang").limit(most))
    kinds = counts.count()
    if not kinds:
        return None
    each = max(sample // kinds, min(LEAST, most // kinds))
    # A language's share of its documents, by a hash of the id; no text is shuffled and none is gathered by language.
    part = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    ids = rows.select("doc_id", "lang").join(counts, "lang").where(part < F.lit(float(each)) / F.col("_all")).select("doc_id").distinct()
    # The order makes the cut the same on every run; repeated ids can bring more rows than ids.
    order = F.xxhash64("doc_id")
    chosen = rows.join(F.broadcast(ids.orderBy(order, "doc_id").limit(most)), "doc_id").join(counts.select("lang"), "lang", "left_semi").select("doc_id", "text", "lang")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        profile = letter_profile()
        for batch in batches:
            found = [(d, n, p) for d, n, t in zip(*(batch.column(c).to_pylist() for c in (0, 2, 1))) if (p := profile(t)) is not None]
            yield pa.RecordBatch.from_arrays(
                [pa.array([d for d, *_ in found], pa.int64()), pa.array([n for _, n, _ in found], pa.string()),
                 pa.array([packed(p) for *_, p in found], pa.binary())], ["doc_id", "lang", "profile"])

    # The first rows meet in a task; only they go to the driver, packed and as Arrow.
    got = map_texts(chosen, run, "doc_id bigint, lang string, profile binary").orderBy(order, "doc_id", "lang", "profile").limit(most).toArrow()
    found = sorted(zip(*(c.to_pylist() for c in got.columns)), key=lambda r: (zlib.crc32(str(r[0]).encode()), *r))
    return fit(unpacked([p for *_, p in found]), [n for _, n, _ in found])


def _predicted(model: Model | None, profile: Callable, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
    names, scores = [UNKNOWN] * len(texts), np.zeros(len(texts))
    for at in range(0, len(texts) if model else 0, 256):
        found = [(k, p) for k in range(at, min(at + 256, len(texts))) if (p := profile(texts[k])) is not None]
        if found:
            best, score = model.predict(np.stack([p for _, p in found]))
            for (k, _), b, s in zip(found, best, score):
                names[k], scores[k] = model.languages[b], s
    return names, np.clip(scores, 0.0, 1.0)


def identify(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, held_out, lang_pred, score)``, one row per input row.

    Null texts and texts without a letter, and all texts if there was nothing to
    learn from, are ``und`` with score 0. A null id is not held out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        profile = letter_profile()
        for batch in batches:
            names, scores = _predicted(model, profile, batch.column(2).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(names, pa.string()), pa.array(scores)],
                                             ["doc_id", "held_out", "lang_pred", "score"])

    rows = narrow(docs, {"doc_id": F.col(id_col).cast("bigint"), "held_out": held_out(id_col), "text": F.col(text_col).cast("string")})
    return map_texts(rows, run, "doc_id bigint, held_out boolean, lang_pred string, score double")


def keep_identified(docs: DataFrame, model: Model | None, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose language could be told, with all their columns.

    Texts that are ``und`` and texts that score below the model's ``needed`` go.
    """
    place = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        profile = letter_profile()
        for batch in batches:
            names, scores = _predicted(model, profile, batch.column(place).to_pylist())
            yield batch.filter(pa.array([n != UNKNOWN and s >= model.needed for n, s in zip(names, scores)], pa.bool_()))

    return map_texts(docs, run, docs.schema)

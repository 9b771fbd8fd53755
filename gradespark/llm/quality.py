"""Document quality by co-training.

Two logistic classifiers see a document from different sides: one its text,
the other what is known about it (source, language, size). They start from a
bounded sample of labelled documents. In each round tasks score all other
documents by both views, and each view hands the other its surest guesses: the
best of each class in each stratum of sources, so that rare sources get some
too. Guesses are made anew in every round. Both views are calibrated on labelled documents that neither
was fitted on, and a last small fit weighs them. Every document is scored from its whole text.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gradespark.llm.common import map_texts, narrow, released, settled

#: Labelled documents to fit on.
LABELLED = 4000
ROUNDS = 3
#: How sure a calibrated view must be to hand a guess on, how many of each class it hands on a round for
#: each stratum, and into how many strata sources are hashed.
SURE, HANDED, STRATA = 0.95, 6, 64
#: Share of the labelled sample that calibrates and fits nothing else.
CALIBRATION = 0.3
KEEP = 0.5
#: Rows of a fit that are in double precision at a time.
_STEP = 256

#: Buckets of hashed letter trigrams; most sources and languages that the metadata view knows by name.
_CLASSES, _LEXICAL, _SIZES, SOURCES, LANGS = 8, 256, 32, 255, 63
TEXT_WIDTH = _CLASSES**3 + _LEXICAL + 6


def text_features() -> Callable[[str], np.ndarray]:
    """A function from a whole text to its text view: shapes of characters, hashed letter trigrams, and how much repeats."""
    kind = np.full(65536, 7, np.uint16)
    for code in range(128):
        c = chr(code)
        kind[code] = 0 if c.islower() else 1 if c.isupper() else 2 if c.isdigit() else 4 if c in "\r\n" else 3 if c.isspace() else 5 if c in ".,;:'\"?-" else 6
    kind[[c for c in range(128, 65536) if chr(c).isupper()]] = 1

    def features(text: str) -> np.ndarray:
        codes = np.minimum(np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32), 65535)
        shape = kind[codes]
        # Letters beyond ASCII count as letters like any other: 7 is lower case then.
        shape = np.where(shape == 7, 0, shape)
        grams = shape[:-2] * 64 + shape[1:-1] * 8 + shape[2:] if len(shape) > 2 else np.zeros(0, np.uint16)
        x = np.zeros(TEXT_WIDTH)
        x[: _CLASSES**3] = np.sqrt(np.bincount(grams, minlength=_CLASSES**3) / max(1, len(grams)))
        letters = np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)
        hashed = (letters[:-2] * np.uint32(2654435761) ^ letters[1:-1] * np.uint32(2246822519) ^ letters[2:] * np.uint32(3266489917)) >> np.uint32(11) if len(letters) > 2 else letters[:0]
        x[_CLASSES**3 : -6] = np.sqrt(np.bincount(hashed % _LEXICAL, minlength=_LEXICAL) / max(1, len(hashed)))
        words, lines = text.split(), [s for s in text.splitlines() if s.strip()]
        half = words[len(words) // 2 :]
        x[-6:] = [
            len(set(words)) / max(1, len(words)) ** 0.9, len(set(lines)) / max(1, len(lines)),
            len(set(zip(words, words[1:], words[2:]))) / max(1, len(words) - 2),
            len(set(half)) / max(1, len(half)), min(sum(map(len, words)) / max(1, len(words)), 40) / 10, 1.0,
        ]
        return x

    return features


def _names(values: list[str | None], most: int) -> dict[str | None, int]:
    """Places of the most frequent values; 0 is left for those that were never seen."""
    counts = Counter(values)
    return {v: i for i, v in enumerate(sorted(counts, key=lambda v: (-counts[v], v is None, v or ""))[:most], 1)}


@dataclass(frozen=True)
class Metadata:
    """The metadata view: sources and languages of the labelled documents by name, and the order of magnitude of the size."""

    sources: dict[str | None, int]
    langs: dict[str | None, int]

    @property
    def width(self) -> int:
        return 2 + len(self.sources) + len(self.langs) + _SIZES

    def features(self, source: str | None, lang: str | None, size: int | None) -> np.ndarray:
        many, x = 1 + len(self.sources), np.zeros(self.width)
        x[self.sources.get(source, 0)] = 1
        x[many + self.langs.get(lang, 0)] = 1
        x[min(_SIZES - 1, int(size).bit_length() if size and size > 0 else 0) - _SIZES] = 1
        return x


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -50, 50)))


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float, steps: int = 25) -> np.ndarray:
    """Weights of a logistic fit with a penalty, by Newton steps; sums are in double precision and go by blocks of rows."""
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        grad, curve = ridge * w, ridge * np.eye(len(w))
        for at in range(0, len(x), _STEP):
            rows = x[at : at + _STEP].astype(float)
            p = _sigmoid(rows @ w)
            grad += rows.T @ (p - y[at : at + _STEP])
            curve += (rows * (p * (1 - p) + 1e-6)[:, None]).T @ rows
        step = np.linalg.solve(curve, grad)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w


def _calibrated(z: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset that turn a view's margin into a probability; smoothed, the slope never below 0."""
    slope, offset = _logistic(np.stack([z, np.ones_like(z)], axis=1), (y * len(y) + 0.5) / (len(y) + 1), 0.05)
    return (slope, offset) if slope > 0 else (0.0, float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1))))


@dataclass
class Model:
    text_weights: np.ndarray
    meta_weights: np.ndarray
    text_scale: tuple[float, float]
    meta_scale: tuple[float, float]
    mix: np.ndarray
    names: Metadata

    def views(self, text: np.ndarray, meta: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Probabilities by text, by metadata and by both."""
        a = self.text_scale[0] * (text @ self.text_weights) + self.text_scale[1]
        b = self.meta_scale[0] * (meta @ self.meta_weights) + self.meta_scale[1]
        return _sigmoid(a), _sigmoid(b), _sigmoid(self.mix[0] * a + self.mix[1] * b + self.mix[2])


#: What a round hands on: for the metadata view and for the text view the guessed classes and both views' features.
Handed = list[tuple[np.ndarray, np.ndarray, np.ndarray]]


def co_train(text: np.ndarray, meta: np.ndarray, y: np.ndarray, names: Metadata, choose: Callable[[Model], Handed], rounds: int = ROUNDS) -> Model:
    """Fit both views on the labelled rows and on the guesses that ``choose`` finds by the model of the round before.

    ``choose`` returns, for the text and for the metadata view, what the other one hands it: ``(classes, text features, metadata features)``.
    """
    held = np.arange(len(y)) % round(1 / CALIBRATION) == 0
    if len(set(y[held])) < 2 or len(set(y[~held])) < 2:
        held[:] = False
    fit_rows, check, views = ~held, held if held.any() else ~held, (text, meta)

    def fit(given: Handed | None) -> Model:
        weights, scales = [], []
        for v in (0, 1):
            x, labels = views[v][fit_rows], y[fit_rows]
            if given and len(given[v][0]):
                x, labels = np.vstack([x, given[v][1 + v]]), np.concatenate([labels, given[v][0]])
            weights.append(_logistic(x, labels, 1.0))
            scales.append(_calibrated(views[v][check] @ weights[v], y[check]))
        a, b = (views[v][check] @ weights[v] * scales[v][0] + scales[v][1] for v in (0, 1))
        mix = _logistic(np.stack([a, b, np.ones_like(a)], axis=1), (y[check] * len(a) + 0.5) / (len(a) + 1), 0.05)
        return Model(*weights, *scales, mix, names)

    model = fit(None)
    for _ in range(rounds):
        given = choose(model)
        if not any(len(g[0]) for g in given):
            break
        model = fit(given)
    return model


def _inputs(docs: DataFrame, id_col: str) -> DataFrame:
    return narrow(docs, {
        "doc_id": F.col(id_col).cast("bigint"), "text": F.col("text").cast("string"), "source": F.col("source").cast("string"),
        "lang": F.col("lang").cast("string"), "n_chars": F.col("n_chars").cast("bigint"),
    })


def _examples(rows: DataFrame, ids: DataFrame, *marks: str) -> list:
    """``(doc_id, marks..., x, source, lang, n_chars)`` of the documents of ``ids (doc_id, marks...)``, the text view made in tasks.

    ``ids`` are few. Of a document with several rows the least by these columns counts.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = text_features()
        for batch in batches:
            x = pa.array([features(t).astype(np.float32).tobytes() for t in batch.column("text").to_pylist()], pa.binary())
            rest = [batch.column(c) for c in ("doc_id", "source", "lang", "n_chars")]
            yield pa.RecordBatch.from_arrays([*rest, x], ["doc_id", "source", "lang", "n_chars", "x"])

    some = rows.join(F.broadcast(ids.select("doc_id").distinct()), "doc_id").select("doc_id", "text", "source", "lang", "n_chars")
    made = map_texts(some, run, "doc_id bigint, source string, lang string, n_chars bigint, x binary")
    one = made.groupBy("doc_id").agg(F.min(F.struct("source", "lang", "n_chars", "x")).alias("e"))
    found = one.join(F.broadcast(ids), "doc_id").select("doc_id", *marks, "e.*").toArrow()
    columns = {c: found.column(c).to_pylist() for c in found.column_names}
    order = sorted(range(found.num_rows), key=lambda k: (zlib.crc32(str(columns["doc_id"][k]).encode()), columns["doc_id"][k], *(columns[m][k] for m in marks)))
    return [{c: columns[c][k] for c in columns} for k in order]


def stratum_of(source: str | None) -> int:
    """The stratum of a source; null is like an empty one."""
    return zlib.crc32((source or "").encode()) % STRATA


def _surest(free: DataFrame, model: Model, sure: float, handed: int) -> DataFrame:
    """``(doc_id, view, y)``: what each view (0 text, 1 metadata) is surest of, over all of ``free``.

    Tasks keep the best of each class and stratum that they have met, and the
    best of these are taken; ties go by a hash of the id, then by the id.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features, best = text_features(), {}
        for batch in batches:
            ids, texts, sources, langs, sizes = (batch.column(c).to_pylist() for c in ("doc_id", "text", "source", "lang", "n_chars"))
            scores = _scores(model, features, texts, sources, langs, sizes)
            for doc, source, row in zip(ids, sources, scores.tolist()):
                for view in (0, 1):
                    for y, p in ((1, row[view]), (0, 1 - row[view])):
                        if p >= sure:
                            kept = best.setdefault((view, y, stratum_of(source)), {})
                            kept[doc] = max(p, kept.get(doc, p))
                            if len(kept) > 64 + 4 * handed:
                                best[view, y, stratum_of(source)] = dict(sorted(kept.items(), key=_rank)[:handed])
        out = [(*key, p, *_rank((doc, p))[1:]) for key, kept in best.items() for doc, p in sorted(kept.items(), key=_rank)[:handed]]
        types = (pa.int32(), pa.int32(), pa.int32(), pa.float64(), pa.int64(), pa.int64())
        columns = zip(*out) if out else [[]] * 6
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], ["view", "y", "stratum", "p", "hash", "doc_id"])

    met = map_texts(free, run, "view int, y int, stratum int, p double, hash bigint, doc_id bigint").groupBy("view", "y", "stratum", "hash", "doc_id").agg(F.max("p").alias("p"))
    rank = F.row_number().over(Window.partitionBy("view", "y", "stratum").orderBy(F.desc("p"), "hash", "doc_id"))
    return met.withColumn("_rank", rank).where(F.col("_rank") <= handed).select("doc_id", "view", "y")


def _rank(found: tuple[int, float]) -> tuple[float, int, int]:
    doc, p = found
    return -p, zlib.crc32(str(doc).encode()), doc


@released
def learn(
    docs: DataFrame, labels: DataFrame, labelled: int = LABELLED, rounds: int = ROUNDS, sure: float = SURE, handed: int = HANDED, id_col: str = "doc_id"
) -> Model | float:
    """Fit on at most ``labelled`` labelled documents, the first by a hash of their id, and co-train over all others.

    A document with contradicting labels, a null label, a null id or no text
    teaches nothing. Those beyond the bound count as unlabelled. A round hands on
    at most ``2 * handed * STRATA`` documents for each view. If fewer than two classes are left there is no model, and the share
    of good labels (one of each added) is returned instead.
    """
    rows = _inputs(docs, id_col).where("doc_id is not null and text is not null and text <> ''")
    marks = narrow(labels, {"doc_id": F.col("doc_id").cast("bigint"), "y": F.col("quality").cast("double")}).where("doc_id is not null and y in (0, 1)")
    marks = marks.groupBy("doc_id").agg(F.min("y").alias("y"), F.max("y").alias("most"))
    # The list of ids is cut to its bound before it is broadcast, and written so that it stays the same.
    few = settled(marks.where("y = most").select("doc_id", "y").orderBy(F.xxhash64("doc_id"), "doc_id").limit(labelled))
    got = _examples(rows, few, "y")
    y = np.array([r["y"] for r in got])
    if len(set(y)) < 2:
        return float((y.sum() + 1) / (len(y) + 2))
    names = Metadata(_names([r["source"] for r in got], SOURCES), _names([r["lang"] for r in got], LANGS))

    def matrices(some: list) -> tuple[np.ndarray, np.ndarray]:
        # In single precision, as the text view comes and as the metadata view is exact.
        text, meta = np.empty((len(some), TEXT_WIDTH), np.float32), np.empty((len(some), names.width), np.float32)
        for k, r in enumerate(some):
            text[k], meta[k] = np.frombuffer(r.pop("x"), np.float32), names.features(r["source"], r["lang"], r["n_chars"])
        return text, meta

    free = rows.join(F.broadcast(few.select("doc_id")), "doc_id", "left_anti").select("doc_id", "text", "source", "lang", "n_chars")

    def choose(model: Model) -> Handed:
        found = _examples(free, settled(_surest(free, model, sure, handed)), "view", "y")
        by_view = [[r for r in found if r["view"] == v] for v in (1, 0)]  # each view learns from the other
        return [(np.array([r["y"] for r in some], float), *matrices(some)) for some in by_view]

    return co_train(*matrices(got), y, names, choose, rounds)


def _scores(model: Model | float, features: Callable, texts: list, sources: list, langs: list, sizes: list) -> np.ndarray:
    """Columns text, metadata and both; rows without text score 0."""
    out = np.zeros((len(texts), 3))
    for at in range(0, len(texts), 256):
        rows = [k for k in range(at, min(at + 256, len(texts))) if texts[k]]
        if not rows:
            continue
        if isinstance(model, float):
            out[rows] = model
        else:
            x = np.stack([features(texts[k]) for k in rows])
            out[rows] = np.stack(model.views(x, np.stack([model.names.features(sources[k], langs[k], sizes[k]) for k in rows])), axis=1)
    return out


def score_quality(docs: DataFrame, model: Model | float, keep: float = KEEP, id_col: str = "doc_id") -> DataFrame:
    """``(doc_id, text_score, meta_score, score, keep)``, one row per input row, scores from 0 to 1.

    Null and empty texts score 0. Null metadata is a value of its own.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = text_features()
        for batch in batches:
            out = _scores(model, features, *(batch.column(k).to_pylist() for k in range(1, 5)))
            columns = [batch.column(0), *(pa.array(out[:, k]) for k in range(3)), pa.array(out[:, 2] >= keep)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "text_score", "meta_score", "score", "keep"])

    return map_texts(_inputs(docs, id_col), run, "doc_id bigint, text_score double, meta_score double, score double, keep boolean")


def keep_good(docs: DataFrame, model: Model | float, keep: float = KEEP) -> DataFrame:
    """The rows of ``docs`` that score at least ``keep``, with all their columns."""
    places = [docs.columns.index(c) for c in ("text", "source", "lang", "n_chars")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = text_features()
        for batch in batches:
            out = _scores(model, features, *(batch.column(k).to_pylist() for k in places))
            yield batch.filter(pa.array(out[:, 2] >= keep))

    return map_texts(docs, run, docs.schema)

"""Short codes of vectors, their nearest codebook entries found by Orchard's search.

A vector is cut into equal parts, and each part is replaced by the index of the
nearest entry in the codebook of its position. Every entry keeps a list of all
entries sorted by their distance from it. A search walks down the list of the
entry it holds; on meeting a nearer one it jumps to that entry's list. Entries
met before are marked and passed over, and the search ends at the first list
member that lies further from the held entry than twice the held distance, as
nothing behind it can be nearer. The rows of a batch take their steps together.

Codebooks are learned in rounds. A round is one scan: tasks assign their rows
and sum the parts of each entry, and only these sums (parts x entries x width
numbers) are added up and come to the driver. All numbers are integers, so
results do not depend on the order of rows, on partitions or on lost tasks.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, FloatType, LongType, StringType, StructField, StructType

from gradespark.llm.blocks import valid
from gradespark.llm.common import narrow, settled

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
#: Rows that one lockstep search holds at a time.
STEP_ROWS = 8192
#: Sums of at most so many labels are sent to every executor.
BROADCAST_LABELS = 65_536
_LONG = 2**63 - 1


@dataclass(frozen=True)
class Codebooks:
    """``entries[part, entry]`` are whole-number vectors; ``scale`` is what made the components whole."""

    entries: np.ndarray
    scale: int = SCALE

    @property
    def width(self) -> int:
        return self.entries.shape[0] * self.entries.shape[2]

    @property
    def sha256(self) -> str:
        """Hash of all components in decimal, by part, entry and position, joined by commas."""
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()


class Orchard:
    """Nearest of a few whole-number entries; of several equally near ones the first."""

    def __init__(self, entries: np.ndarray) -> None:
        self.entries = entries
        apart = ((entries[:, None, :] - entries[None, :, :]) ** 2).sum(2)
        self.lists = np.argsort(apart, axis=1, kind="stable")
        # Further than twice the held distance: a quarter of the square, rounded up, is above the held square.
        self.quarter = np.take_along_axis(-(-apart // 4), self.lists, axis=1)

    def __call__(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Indexes of the nearest entries and squared distances to them."""
        count, size = len(rows), len(self.entries)
        held = np.zeros(count, np.int64)
        square = ((rows - self.entries[0]) ** 2).sum(1)
        marked = np.zeros((count, size), bool)
        marked[:, 0] = True
        place = np.zeros(count, np.int64)
        active = np.arange(count)
        while len(active):
            active = active[place[active] < size]
            active = active[self.quarter[held[active], place[active]] <= square[active]]
            entry = self.lists[held[active], place[active]]
            place[active] += 1
            fresh = ~marked[active, entry]
            met, entry = active[fresh], entry[fresh]
            marked[met, entry] = True
            found = ((rows[met] - self.entries[entry]) ** 2).sum(1)
            nearer = (found < square[met]) | ((found == square[met]) & (entry < held[met]))
            jumps = met[nearer]
            held[jumps], square[jumps], place[jumps] = entry[nearer], found[nearer], 0
        return held, square


def limit(width: int) -> int:
    """Largest component whose squared distances, over a whole vector, a long is sure to hold."""
    return math.isqrt(2**60 // max(1, width))


def whole(values: np.ndarray, width: int, scale: int) -> np.ndarray:
    """``floor(scale * x)``; what lies beyond ``limit`` ends there."""
    most = limit(width)
    return np.clip(np.floor(values * scale), -most, most).astype(np.int64)


def _kept(vectors: pa.Array, width: int, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the vectors that take part, and their whole components."""
    if pa.types.is_large_list(vectors.type):
        vectors = vectors.cast(pa.list_(vectors.type.value_type))
    sizes = pc.fill_null(pc.list_value_length(vectors), 0).to_numpy()
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    bad = np.concatenate([[0], np.cumsum(~np.isfinite(flat))])
    ends = np.cumsum(sizes)
    good = vectors.is_valid().to_numpy(zero_copy_only=False) & (bad[ends] == bad[ends - sizes])
    wrong = good & (sizes != width)
    if wrong.any():
        raise ValueError(f"vectors have {width} and {sizes[wrong][0]} components; all must have as many")
    return np.nonzero(good)[0], whole(flat[np.repeat(good, sizes)].reshape(int(good.sum()), width), width, scale)


def _slices(batches: Iterator[pa.RecordBatch], vector: int, width: int, scale: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """The rows that take part, some at a time, with their whole components."""
    for batch in batches:
        for at in range(0, batch.num_rows, STEP_ROWS):
            piece = batch.slice(at, STEP_ROWS)
            positions, rows = _kept(piece.column(vector), width, scale)
            if len(positions):
                yield piece.take(pa.array(positions)), rows


def _narrowed(vectors: DataFrame, id_col: str, vector_col: str, label_col: str | None) -> DataFrame:
    vector = F.col(vector_col)
    kind = vectors.schema[vector_col].dataType
    if not (isinstance(kind, ArrayType) and isinstance(kind.elementType, (FloatType, DoubleType))):
        vector = vector.cast("array<double>")
    return narrow(vectors, {"vec_id": F.col(id_col).cast("bigint"), "label": F.col(label_col) if label_col else F.lit(None), "vector": vector})


def learn(
    vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE,
    id_col: str = "vec_id", vector_col: str = "embedding",
) -> Codebooks | None:
    """One codebook for each part position, from all vectors that take part; None if there are none.

    A codebook starts as that part of the vectors with the ``entries`` smallest
    ids (null ids last; of one id the smaller vectors first; fewer vectors: as
    many entries). A round replaces each entry by the componentwise
    ``floor(sum / count)`` of the parts nearest to it, and leaves unused ones.
    """
    rows = _narrowed(vectors, id_col, vector_col, None)
    first = rows.where(valid("vector", zero=True)).orderBy(F.asc_nulls_last("vec_id"), "vector").head(entries)
    if not first:
        return None
    width = len(first[0].vector)
    if width % parts or any(len(r.vector) != width for r in first):
        raise ValueError(f"vectors must have as many components each, a multiple of {parts}; found {sorted({len(r.vector) for r in first})}")
    start = whole(np.array([r.vector for r in first], np.float64).reshape(len(first), width), width, scale)
    books = start.reshape(len(first), parts, width // parts).transpose(1, 0, 2)
    for _ in range(rounds):
        found = rows.select("vector").mapInArrow(_summing(books, width, scale), "part int, entry int, place int, total bigint, n bigint")
        totals = found.groupBy("part", "entry", "place").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"), F.sum("n").alias("n"))
        books = books.copy()
        for r in totals.agg(F.collect_list(F.struct("part", "entry", "place", "total", "n")).alias("all")).first()["all"]:
            books[r.part, r.entry, r.place] = int(r.total) // r.n
    return Codebooks(books, scale)


def _summing(books: np.ndarray, width: int, scale: int):
    parts, entries, each = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        searches = [Orchard(book) for book in books]
        totals, counts = np.zeros(books.shape, np.int64), np.zeros((parts, entries), np.int64)
        for _, rows in _slices(batches, 0, width, scale):
            for p, search in enumerate(searches):
                part = rows[:, p * each : (p + 1) * each]
                index, _ = search(part)
                np.add.at(totals[p], index, part)
                counts[p] += np.bincount(index, minlength=entries)
        used = np.broadcast_to(counts[:, :, None] > 0, books.shape)
        part, entry, place = (x.astype(np.int32) for x in np.nonzero(used))
        yield pa.RecordBatch.from_arrays(
            [pa.array(x) for x in (part, entry, place, totals[used], counts[part, entry])], ["part", "entry", "place", "total", "n"])

    return run


def encode(vectors: DataFrame, books: Codebooks, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """``(vec_id, label, code, error)`` of the vectors that take part: entry indexes in part order, two hex digits each, and the squared distance."""
    rows = _narrowed(vectors, id_col, vector_col, label_col)
    parts, entries, each = books.entries.shape
    if entries > 256:
        raise ValueError("an index of more than 256 entries does not fit two hex digits")
    held, width, scale = books.entries, books.width, books.scale

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        searches = [Orchard(book) for book in held]
        for piece, matrix in _slices(batches, 2, width, scale):
            codes, errors = np.zeros((len(matrix), parts), np.uint8), np.zeros(len(matrix), np.int64)
            for p, search in enumerate(searches):
                index, square = search(matrix[:, p * each : (p + 1) * each])
                codes[:, p] = index
                errors += square
            yield pa.RecordBatch.from_arrays(
                [piece.column(0), piece.column(1), pa.array([c.tobytes().hex() for c in codes], pa.string()), pa.array(errors)],
                ["vec_id", "label", "code", "error"])

    return rows.mapInArrow(run, StructType([*rows.schema.fields[:2], StructField("code", StringType()), StructField("error", LongType())]))


def compress(
    vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE,
    id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
) -> DataFrame:
    """``(vec_id, code, error, label_error, codebooks_sha256)`` of every vector that takes part.

    Vectors that are null or hold null or non-finite components take no part;
    zero vectors do. Rows with a null id do too. Repeated rows are rows.
    ``label_error`` is the error summed over equal labels, nulls together, and
    ends at the largest long. Components that scale beyond ``limit(width)``
    (2^27 for 64 components) end there. Vectors of several widths, or of a width
    that ``parts`` does not divide, are an error; an empty table gives no rows.
    Other columns are not read, so their names cannot clash.
    """
    books = learn(vectors, parts, entries, rounds, scale, id_col, vector_col)
    if books is None:
        none = _narrowed(vectors, id_col, vector_col, label_col).where(F.lit(False))
        return none.select("vec_id", F.lit("").alias("code"), *[F.lit(0).cast("bigint").alias(n) for n in ("error", "label_error")], F.lit("").alias("codebooks_sha256"))
    coded = settled(encode(vectors, books, id_col, vector_col, label_col))
    total = F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(_LONG).cast("decimal(38,0)")).cast("bigint")
    sums = settled(coded.groupBy(F.col("label").alias("_label")).agg(total.alias("label_error")))
    if sums.count() <= BROADCAST_LABELS:
        sums = F.broadcast(sums)
    return coded.join(sums, F.col("label").eqNullSafe(F.col("_label"))).select("vec_id", "code", "error", "label_error", F.lit(books.sha256).alias("codebooks_sha256"))


def _oracle() -> str:
    square = "list_sum(list_transform(generate_series(1, len(p.x)), lambda i: (p.x[i] - b.x[i]) * (p.x[i] - b.x[i])))"
    steps = [f"""
v as (
  select row_number() over (order by vec_id nulls last, embedding) as rn, vec_id, label, list_transform(embedding, lambda x: cast(floor({SCALE} * x::double) as bigint)) as x
  from embeddings where embedding is not null and list_bool_and(list_transform(embedding, lambda x: x is not null and isfinite(x)))
), p as (
  select rn, part, x[part * len(x) // {PARTS} + 1 : (part + 1) * len(x) // {PARTS}] as x from v, (select unnest(range({PARTS})) as part)
), b0 as (select part, rn - 1 as entry, x from p where rn <= {ENTRIES})"""]
    for r in range(ROUNDS + 1):
        steps.append(f"""a{r} as materialized (
  select rn, part, x, least_d.entry as entry, least_d.d as d from (
    select p.rn, p.part, any_value(p.x) as x, min({{'d': coalesce({square}, 0)::bigint, 'entry': b.entry}}) as least_d
    from p join b{r} b on p.part = b.part group by p.rn, p.part)
)""")
        if r < ROUNDS:
            steps.append(f"""s{r} as (
  select part, entry, list((s - ((s % n) + n) % n) // n order by i) as x from (
    select part, entry, i, sum(x[i])::bigint as s, count(*) as n from a{r}, unnest(generate_series(1, len(x))) as t(i) group by part, entry, i)
  group by part, entry
), b{r + 1} as materialized (select b.part, b.entry, coalesce(s.x, b.x) as x from b{r} b left join s{r} s on b.part = s.part and b.entry = s.entry)""")
    return f"""
with {", ".join(steps)}, h as (
  select sha256(string_agg(array_to_string(x, ','), ',' order by part, entry)) as codebooks_sha256 from b{ROUNDS}
), c as (
  select rn, string_agg(printf('%02x', entry), '' order by part) as code, sum(d)::bigint as error from a{ROUNDS} group by rn
)
select vec_id, code, error, cast(sum(error) over (partition by label) as bigint) as label_error, codebooks_sha256 from c join v using (rn), h
"""


ORACLE = _oracle()

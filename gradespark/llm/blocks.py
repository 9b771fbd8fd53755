"""Queries meeting blocks of vectors, one block at a time.

Rows and queries for a block are shuffled to one place and sorted so that the
block's rows come first. A task holds one block, whose size is bounded, and
streams the queries past it. Rows travel singly, so no Arrow batch is large.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows of a block.
BLOCK = 4096


def valid(vector: str, zero: bool) -> Column:
    """True for vectors that take part: not null, no null or non-finite component, and not zero unless ``zero``."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    fine = F.col(vector).isNotNull() & ~F.exists(F.col(vector), bad)
    return fine if zero else fine & F.exists(F.col(vector), lambda x: x != 0)


def one_width(rows: DataFrame, vector: str) -> int:
    """The number of components of all vectors (0 for an empty table); vectors of several widths are an error."""
    low, high = rows.agg(F.min(F.size(vector)), F.max(F.size(vector))).first()
    if low != high:
        raise ValueError(f"vectors have from {low} to {high} components; all must have as many")
    return low or 0


def matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)


def visit(
    data: DataFrame, queries: DataFrame, width: int,
    meet: Callable[[np.ndarray, list], Callable[[np.ndarray, np.ndarray, np.ndarray], Iterator[tuple]]], schema: str,
) -> DataFrame:
    """``data`` ``(block, ids, vector)`` met by ``queries`` ``(block, query, query_id, vector, bound)``.

    ``meet(vectors, ids)`` prepares a block; what it returns is called with the
    vectors, ids and bounds of some queries and yields ``(position of the query,
    ids of the row, score)``. Rows of ``schema`` are ``(query, query_id, ids, score)``.
    """
    held = data.select("block", F.lit(0).alias("kind"), F.lit(None).cast("bigint").alias("query"), F.lit(None).cast("bigint").alias("query_id"),
                       "ids", "vector", F.lit(None).cast("double").alias("bound"))
    asked = queries.select("block", F.lit(1).alias("kind"), "query", "query_id", F.lit(None).cast("array<bigint>").alias("ids"), "vector", "bound")
    rows = held.unionByName(asked).repartition("block").sortWithinPartitions("block", "kind")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, vectors, ids, ready = None, [], [], None
        names = ["query", "query_id", "ids", "score"]
        for batch in batches:
            blocks, kinds = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            cuts = np.nonzero((np.diff(blocks) != 0) | (np.diff(kinds) != 0))[0] + 1
            for s, e in zip([0, *cuts], [*cuts, len(blocks)]):
                if s == e:
                    continue
                part = batch.slice(s, e - s)
                if blocks[s] != block:
                    block, vectors, ids, ready = blocks[s], [], [], None
                if kinds[s] == 0:
                    vectors.append(matrix(part.column(5), width))
                    ids += part.column(4).to_pylist()
                    continue
                if ready is None:
                    ready = meet(np.concatenate(vectors) if vectors else np.zeros((0, width)), ids)
                asked_ids = part.column(3).to_numpy()
                found = list(ready(matrix(part.column(5), width), asked_ids, part.column(6).to_numpy(zero_copy_only=False)))
                at = [q for q, *_ in found]
                scores = [x for *_, x in found]
                yield pa.RecordBatch.from_arrays([
                    pa.array(part.column(2).to_numpy()[at], pa.int64()), pa.array(asked_ids[at], pa.int64()),
                    pa.array([i for _, i, _ in found], pa.list_(pa.int64())), pa.array(scores, pa.float64() if "double" in schema else pa.int64()),
                ], names)

    return rows.mapInArrow(run, schema)

"""Folds of groups of any size: of any associative operation by levels, of any other one in order by rounds."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradespark.durable import durable, ensure_checkpoint_dir

#: Parts that a group is folded to on its way to one row: a part of one level is made of at most so many of the level before.
_LEVELS = (1 << 20, 1 << 10, 1)


def tree_reduce(
    rows: DataFrame, keys: Sequence[str], column: str, combine: Callable[[Column, Column], Column], repeat: Callable[[Column, Column], Column] | None = None,
    name: str = "value",
) -> DataFrame:
    """(keys..., value): every group's numbers combined by an associative and commutative operation.

    Equal numbers of a group are counted first, with a map-side combine, and
    ``repeat(number, count)`` is what so many of them combine to (left out: the
    number itself). The different ones are dealt out by hash into parts of a
    group, which become fewer from level to level, so no row ever holds a whole
    group and a hot key is spread out. NULLs are left out; so are groups of nothing else.
    """
    numbers = rows.select(*keys, F.col(column).alias("_value")).where("_value is not null").groupBy(*keys, "_value").agg(F.count("*").alias("_count"))
    value = F.col("_value") if repeat is None else repeat(F.col("_value"), F.col("_count"))
    level = numbers.select(*keys, value.alias("_part"), F.xxhash64("_value").alias("_hash"))
    for parts in _LEVELS:
        folded = F.aggregate(F.slice("_parts", 2, F.size("_parts")), F.get("_parts", F.lit(0)), combine)
        salt = F.pmod("_hash", F.lit(parts)).alias("_hash")
        level = level.select(*keys, "_part", salt).groupBy(*keys, "_hash").agg(F.collect_list("_part").alias("_parts")).select(*keys, folded.alias("_part"), "_hash")
    return level.select(*keys, F.col("_part").alias(name))


def ordered_fold(
    target: DataFrame, updates: DataFrame, order: Sequence[str], apply: Callable[[Column, Column], Column], chunks: int | None = None
) -> DataFrame:
    """``target(idx, value)`` after ``value = apply(value, u)`` for each of ``updates(idx, u, order...)``, one after the other.

    The operation may be neither associative nor commutative. Updates are
    sorted by range of (idx, order, u) and written to the checkpoint folder, one
    directory for each of the partitions, so the run of a hot idx is cut into
    pieces of bounded size. An idx within one partition is folded there. Those
    that span several (at most one begins in each partition) hand their value on
    from partition to partition, in as many rounds as the longest spans; a
    round reads only the directories it is about. NULL updates and ids are left out.
    """
    session, keys = updates.sparkSession, ["idx", *order, "u"]
    ensure_checkpoint_dir(session)
    folder = f"{session.sparkContext.getCheckpointDir()}/fold-{uuid.uuid4().hex}"
    kept = updates.select(*keys).where("idx is not null and u is not null")
    ranged = kept.repartitionByRange(chunks, *keys) if chunks else kept.repartitionByRange(*keys)
    ranged.withColumn("_piece", F.spark_partition_id()).write.partitionBy("_piece").parquet(folder)
    pieces = session.read.schema(ranged.withColumn("_piece", F.lit(0)).schema).parquet(folder)
    ends = pieces.groupBy("idx").agg(F.min("_piece").alias("_first"), F.max("_piece").alias("_last")).where("_first < _last")
    # At most one row for each piece.
    spans = durable(ends)
    found = spans.agg(F.collect_list(F.struct("_first", "_last"))).first()[0]

    def fold(values: DataFrame, some: DataFrame) -> DataFrame:
        runs = some.groupBy("idx").agg(F.sort_array(F.collect_list(F.struct(*order, "u"))).alias("_run"))
        none = F.array().cast(runs.schema["_run"].dataType)
        done = F.aggregate(F.coalesce("_run", none), F.col("value"), lambda x, e: apply(x, e["u"]))
        return values.join(runs, "idx", "left").select("idx", done.alias("value"))

    if not found:
        return fold(target.select("idx", "value"), pieces)
    spans = F.broadcast(spans)
    single = fold(target.select("idx", "value").join(spans, "idx", "left_anti"), pieces.join(spans, "idx", "left_anti"))
    state = durable(target.select("idx", "value").join(spans.select("idx"), "idx", "left_semi"))
    for step in range(1 + max(r["_last"] - r["_first"] for r in found)):
        now = sorted({r["_first"] + step for r in found if r["_first"] + step <= r["_last"]})
        piece = pieces.where(F.col("_piece").isin(now)).join(spans, "idx").where(F.col("_piece") == F.col("_first") + step)
        state = durable(fold(state, piece))
    return single.unionByName(state)

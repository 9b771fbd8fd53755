"""Chains of attempts, pass@k and evaluation results."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gradespark.functions.text import strip


def resolve_chains(attempts: DataFrame, keys: Sequence[str] = ("task_id", "method")) -> DataFrame:
    """One result per chain: the first valid attempt, else the last produced one.

    Needs ``attempt`` (any orderable, unique within a chain), ``code``, ``ok``
    and ``produced``. A round that raised has ``produced`` false and counts
    for nothing; a chain without any produced code gives ``""``. All of it is
    one aggregation with map-side combine, so chain length does not matter.
    """
    valid = F.col("ok") & F.col("produced")
    won = F.when(valid, F.col("attempt"))
    made = F.when(F.col("produced"), F.col("attempt"))
    return (
        attempts.groupBy(*keys)
        .agg(
            F.min_by("code", won).alias("_first"),
            F.max_by("code", made).alias("_last"),
            F.coalesce(F.bool_or(valid), F.lit(False)).alias("solved"),
            F.count("*").alias("attempts"),
        )
        .withColumn(
            "code",
            strip(F.when(F.col("solved"), F.col("_first")).otherwise(F.coalesce("_last", F.lit("")))),
        )
        .drop("_first", "_last")
    )


def pass_at_k(
    attempts: DataFrame,
    ks: Sequence[int] = (1, 5, 10),
    order: Column | str = "attempt",
    tasks: DataFrame | None = None,
) -> DataFrame:
    """Share of all tasks with at least k attempts and a success among the first k.

    Rows: task_id, ``order`` and ``ok``. Only the first max(k) attempts of a
    task can matter; the rank filter is applied before the shuffle as well, so
    a task with very many attempts sends few rows. With ``tasks`` (task_id)
    the tasks nobody attempted count as well.
    """
    order = F.col(order) if isinstance(order, str) else order
    first = (
        attempts.select("task_id", "ok", order.alias("_order"))
        .withColumn("_rank", F.row_number().over(Window.partitionBy("task_id").orderBy("_order")))
        .where(F.col("_rank") <= max(ks))
        .groupBy("task_id")
        # At most max(k) attempts are left, which is all that has to be known of their number.
        .agg(F.min(F.when(F.col("ok"), F.col("_rank"))).alias("_success"), F.count("*").alias("_n"))
    )
    per_task = first
    if tasks is not None:
        per_task = tasks.select("task_id").distinct().join(per_task, "task_id", "left")
    hits = [
        F.count_if((F.col("_n") >= k) & (F.col("_success") <= k)).alias(f"_hits{k}") for k in ks
    ]
    counted = per_task.agg(F.count("*").alias("tasks"), *hits)
    rows = F.array(
        *[F.struct(F.lit(k).alias("k"), F.col(f"_hits{k}").alias("passed")) for k in ks]
    )
    return counted.select("tasks", F.inline(rows)).select(
        "k",
        "tasks",
        "passed",
        F.coalesce(
            F.try_divide(F.col("passed").cast("double"), F.col("tasks")) * 100, F.lit(0.0)
        ).alias("pass_at_k"),
    )


def match_tests(codes: DataFrame, tests: DataFrame, key: str = "example_index") -> DataFrame:
    """Completions beside their tests; surplus completions keep NULL tests."""
    return codes.join(tests, key, "left")


def example_results(verdicts: DataFrame, *keep: str) -> DataFrame:
    """The rows behind an evaluation: example_index, task_id, entry_point, passed.

    Needs ``example_index`` and ``passed`` (missing: failed); ``task_id`` defaults to
    ``task_<index>``, ``entry_point`` may be missing altogether.
    """
    columns = verdicts.columns
    index = F.col("example_index")
    named = F.concat(F.lit("task_"), index.cast("string"))
    task = F.coalesce("task_id", named) if "task_id" in columns else named
    entry = F.col("entry_point") if "entry_point" in columns else F.lit(None).cast("string")
    passed = F.coalesce("passed", F.lit(False))
    return verdicts.select(*keep, "example_index", task.alias("task_id"), entry.alias("entry_point"), passed.alias("passed"))


def evaluate(verdicts: DataFrame, *groups: str) -> DataFrame:
    """Total, passed and pass rate; a row without a verdict counts as failed.

    Without groups an empty table gives no row instead of a division by zero.
    """
    result = (
        verdicts.groupBy(*groups)
        .agg(
            F.count("*").alias("total_examples"),
            F.count_if(F.coalesce("passed", F.lit(False))).alias("passed_examples"),
        )
        .where(F.col("total_examples") > 0)
    )
    return result.withColumn(
        "pass_rate", F.col("passed_examples").cast("double") / F.col("total_examples") * 100
    )

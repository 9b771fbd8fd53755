"""Method-by-test matrices and the reports made from them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradespark.operators.logs import METHODS, last_verdicts, percent_label


def tests_from_tasks(tasks: DataFrame) -> DataFrame:
    """The fixed test order of a suite: task number + 1 and entry point.

    Suites reuse names (six entry points of the 164 occur twice), so a name
    may stand behind several ids and then shares one verdict.
    """
    number = F.regexp_extract("task_id", r"(\d+)\z", 1).cast("bigint")
    return tasks.select((number + 1).alias("test_id"), F.col("entry_point").alias("test_name"))


def verdict_matrix(
    tests: DataFrame,
    verdicts: DataFrame,
    methods: Sequence[str] = METHODS,
    order: Column | str = "line_no",
) -> DataFrame:
    """One row per test, one 0/1 column per method; no verdict counts as 0."""
    wide = (
        verdicts.groupBy("test_name").pivot("method", list(methods)).agg(F.max_by("passed", order))
    )
    return (
        tests.join(wide, "test_name", "left")
        .select("test_id", "test_name", *methods)
        .fillna(0, subset=list(methods))
    )


def melt_matrix(matrix: DataFrame, methods: Sequence[str] = METHODS) -> DataFrame:
    """The matrix as rows (test_id, test_name, method, passed)."""
    return matrix.unpivot(["test_id", "test_name"], list(methods), "method", "passed")


def method_totals(matrix: DataFrame, methods: Sequence[str] = METHODS) -> DataFrame:
    """Passed and listed tests per method."""
    sums = matrix.agg(
        *[F.coalesce(F.sum(m), F.lit(0)).alias(m) for m in methods], F.count("*").alias("total")
    )
    return sums.unpivot(["total"], list(methods), "method", "passed").select(
        "method", "passed", "total"
    )


def leaderboard(
    tests: DataFrame,
    verdicts: DataFrame,
    methods: Sequence[str] = METHODS,
    order: Column | str = "line_no",
) -> DataFrame:
    """Passed tests per method, lowest first, ties by name.

    Same numbers as the totals of the matrix, but only the verdicts that exist
    are joined; tests without a verdict enter through the total.
    """
    spark = tests.sparkSession
    passed = (
        last_verdicts(verdicts.where(F.col("method").isin(*methods)), order)
        .where(F.col("passed") == 1)
        .join(tests.groupBy("test_name").agg(F.count("*").alias("_ids")), "test_name")
        .groupBy("method")
        .agg(F.sum("_ids").alias("passed"))
    )
    names = spark.range(1).select(F.explode(F.array(*map(F.lit, methods))).alias("method"))
    total = tests.agg(F.count("*").alias("n"))
    return (
        names.join(passed, "method", "left")
        .withColumn("passed", F.coalesce("passed", F.lit(0).cast("bigint")))
        .withColumn("total", total.scalar())
        .withColumn("pct", F.try_divide(F.col("passed") * 100.0, F.col("total")))
        .withColumn("label", percent_label(F.col("passed"), F.col("total")))
        .orderBy("passed", "method")
    )


def heatmap_rows(matrix: DataFrame, methods: Sequence[str] = METHODS) -> DataFrame:
    """Matrix cells with the rank of their method, lowest total first."""
    totals = method_totals(matrix, methods)
    # Eleven rows: the rank is counted over an array of (passed, method).
    pairs = F.sort_array(F.collect_list(F.struct("passed", "method")))
    ordered = totals.agg(F.transform(pairs, lambda pair: pair["method"]).alias("methods"))
    position = F.array_position(ordered.scalar(), F.col("method"))
    return melt_matrix(matrix, methods).withColumn("method_rank", position.cast("bigint"))


def base_vs_chain(totals: DataFrame, bases: Sequence[str] = ("AST", "DFG", "CFG", "PDG")) -> DataFrame:
    """Each base method beside its ``_CHAIN`` variant, with the difference in points."""
    base = totals.where(F.col("method").isin(*bases)).select(
        F.col("method"), F.col("passed").alias("base_passed"), F.col("total")
    )
    chain = totals.select(
        F.regexp_replace("method", r"_CHAIN\z", "").alias("method"),
        F.col("passed").alias("chain_passed"),
    ).where(totals["method"].endswith("_CHAIN"))
    share = lambda c: F.try_divide(F.col(c) * 100.0, F.col("total"))
    return base.join(chain, "method").select(
        "method",
        "base_passed",
        "chain_passed",
        "total",
        share("base_passed").alias("base_pct"),
        share("chain_passed").alias("chain_pct"),
        F.try_divide((F.col("chain_passed") - F.col("base_passed")) * 100.0, F.col("total")).alias(
            "delta_points"
        ),
        percent_label(F.col("base_passed"), F.col("total")).alias("base_label"),
        percent_label(F.col("chain_passed"), F.col("total")).alias("chain_label"),
    )

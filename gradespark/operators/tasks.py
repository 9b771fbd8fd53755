"""Task tables: normalising, ordering, lookup and prompts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradespark.functions.text import extract_functions, fill, is_blank
from gradespark.operators.ordering import with_row_index

# The prompt markers (the closing marker repeats the opening one).
SINGLE_SUFFIX = "<prompt><setting>code generation without docstring</setting>"
RUN_PREFIX = (
    "<setting>code generation without docstring</setting>"
    "<setting>don't use List, use list</setting><prompt>"
)

# The texts of a repair prompt.
REPAIR_SOLUTION = "Previous solution:\n"
REPAIR_ERROR = (
    "The last attempt failed during automatic checking with the following error (exact text):\n"
)
REPAIR_REQUEST = (
    "Analyze the code carefully and return a corrected, fully functional, syntactically correct Python function.\n"
    "Keep the same function name and parameters. Fix all indentation and syntax errors and any runtime error "
    "reported above. Do not include any explanations, comments or additional text — return only the updated code.\n"
)

# Errors of rows that cannot be tested, and of unknown tasks.
NO_CODE_ERROR = "Could not extract executable code"
NOT_FOUND_ERROR = "Task ID %s not found"


def _null_string() -> Column:
    return F.lit(None).cast("string")


def normalize_humaneval(raw: DataFrame) -> DataFrame:
    """Standard task rows; the single test text becomes a one-element array."""
    return raw.select(
        "task_id", "prompt", "canonical_solution",
        F.array("test").alias("test_code"), "entry_point",
    )


def _default_ids(rows: DataFrame, prefix: str, order: Column | str) -> DataFrame:
    numbered = with_row_index(rows, order, name="_position")
    return numbered.withColumn(
        "task_id", F.coalesce("task_id", F.concat(F.lit(prefix), F.col("_position").cast("string")))
    ).drop("_position")


def normalize_mbpp(raw: DataFrame, order: Column | str = "id") -> DataFrame:
    """Standard task rows; a missing id becomes ``mbpp_<row position>``.

    Spark rows have no position of their own: ``order`` names the unique
    column that gives it.
    """
    return _default_ids(raw, "mbpp_", order).select(
        F.col("task_id").cast("string").alias("task_id"),
        F.col("text").alias("prompt"),
        F.col("code").alias("canonical_solution"),
        F.col("test_list").alias("test_code"),
        _null_string().alias("entry_point"),
    )


def normalize_generic(raw: DataFrame, order: Column | str) -> DataFrame:
    """Task rows of an unknown suite; absent columns get their defaults."""
    have = set(raw.columns)
    rows = raw if "task_id" in have else raw.withColumn("task_id", _null_string())
    tests = F.col("test_code") if "test_code" in have else _null_string()
    entry = F.col("entry_point") if "entry_point" in have else _null_string()
    solution = F.col("canonical_solution") if "canonical_solution" in have else _null_string()
    if dict(raw.dtypes).get("test_code", "string") == "string":
        tests = F.array(F.coalesce(tests, F.lit("")))
    return _default_ids(rows, "generic_", order).select(
        "task_id", "prompt", solution.alias("canonical_solution"),
        tests.alias("test_code"), entry.alias("entry_point"),
    )


def preprocess(raw: DataFrame, suite: str, order: Column | str = "id") -> DataFrame:
    """The four columns a run needs: id, prompt, tests, entry point."""
    if suite == "humaneval":
        tasks = normalize_humaneval(raw)
    elif suite == "mbpp":
        tasks = normalize_mbpp(raw, order)
    else:
        tasks = normalize_generic(raw, order)
    return tasks.drop("canonical_solution")


def with_example_index(tasks: DataFrame) -> DataFrame:
    """0-based position in task id order."""
    return with_row_index(tasks, "task_id", name="example_index")


def sort_and_limit(tasks: DataFrame, limit: int | None = None) -> DataFrame:
    """Tasks by id, as strings; no limit or 0 keeps all of them."""
    if limit is not None and limit < 0:
        raise ValueError("limit must not be negative")
    ordered = tasks.orderBy("task_id")
    return ordered.limit(limit) if limit else ordered


def lookup_tasks(requests: DataFrame, tasks: DataFrame) -> DataFrame:
    """The task of each requested ``task_id``, or an error for an unknown one."""
    known = tasks.withColumn("_known", F.lit(True))
    return requests.join(known, "task_id", "left").withColumn(
        "error",
        F.when(F.col("_known").isNull(), fill(NOT_FOUND_ERROR, F.col("task_id"))),
    ).drop("_known")


def single_prompt(prompt: Column) -> Column:
    """Prompt of a single-task run."""
    return F.concat(F.lit("<prompt>"), prompt, F.lit(SINGLE_SUFFIX))


def run_prompt(prompt: Column) -> Column:
    """Prompt of a full run."""
    return F.concat(F.lit(RUN_PREFIX), prompt, F.lit("<prompt>"))


def repair_prompt(base: Column, code: Column, error: Column) -> Column:
    """Prompt of the next round, quoting the failed code and its error."""
    return F.concat(
        base, F.lit("\n\n" + REPAIR_SOLUTION), code, F.lit("\n\n" + REPAIR_ERROR + "```\n"),
        error, F.lit("\n```\n\n" + REPAIR_REQUEST),
    )


def testable_code(completions: DataFrame) -> DataFrame:
    """Code to test from ``prompt``, ``completion`` and an optional ``error``.

    A failed generation or an empty extraction gives the code ``""`` and an
    error; such rows stay in the table and fail their tests later.
    """
    extracted = extract_functions(F.concat("prompt", "completion"))
    failed = F.col("error").isNotNull()
    return (
        completions.withColumn("_code", F.when(~failed, extracted))
        .withColumn("error", F.when(~failed & is_blank(F.col("_code")), F.lit(NO_CODE_ERROR)).otherwise(F.col("error")))
        .withColumn("code", F.coalesce("_code", F.lit("")))
        .drop("_code")
    )

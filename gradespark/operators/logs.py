"""Run logs to verdict tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gradespark.functions.numeric import one_decimal
from gradespark.functions.rtf import rtf_to_text
from gradespark.functions.text import fill, let, split_lines, strip
from gradespark.operators.ordering import with_row_index

# The methods in report order.
METHODS = [
    "BASE", "BASE_CHAIN", "AST", "AST_CHAIN", "DFG", "DFG_CHAIN", "CFG", "CFG_CHAIN",
    "PDG", "PDG_CHAIN", "PDG_CHAIN_FEEDBACK",
]

# The log line formats and the patterns that read them.
PASS_LINE = "✅ HumanEval tests for %s passed successfully."
SYNTAX_ERROR_LINE = "❌ SYNTAX ERROR in code for %s"
EXECUTION_ERROR_LINE = "❌ TEST EXECUTION ERROR for %s: %s: %s"
PASS_PATTERN = r"HumanEval tests for (.+?) passed successfully"
FAIL_PATTERNS = {
    "syntax": r"SYNTAX ERROR.*?for (.+)",
    "runtime": r"(?:SYNTAX ERROR|RUNTIME ERROR).+? for (.+)",
}
EXECUTION_PATTERN = r"TEST EXECUTION ERROR for (.+?): (\w+): "


def log_lines(files: DataFrame, text: str = "text", *, rtf: bool = False) -> DataFrame:
    """One row per line of each file: ``line_no`` from 0 and the stripped line."""
    content = rtf_to_text(F.col(text)) if rtf else F.col(text)
    kept = [c for c in files.columns if c != text]
    return files.select(
        *kept, F.posexplode(split_lines(content)).alias("line_no", "line")
    ).withColumn("line", strip("line"))


def emit_line(
    name: Column, passed: Column, error_type: Column | None = None, message: Column | None = None
) -> Column:
    """The log line of a verdict: passed, no valid syntax, or failed while running."""
    empty = F.lit(None).cast("string")
    kind = empty if error_type is None else error_type
    text = F.lit("") if message is None else F.coalesce(message, F.lit(""))
    return (
        F.when(passed, fill(PASS_LINE, name))
        .when(F.coalesce(kind, F.lit("SyntaxError")) == "SyntaxError", fill(SYNTAX_ERROR_LINE, name))
        .otherwise(fill(EXECUTION_ERROR_LINE, name, kind, text))
    )


def _name(line: Column, pattern: str, group: int = 1) -> Column:
    return F.nullif(F.regexp_extract(line, pattern, group), F.lit(""))


def parse_verdicts(lines: DataFrame, grammar: str = "runtime") -> DataFrame:
    """Keep the verdict lines and add ``test_name`` and ``passed`` (1 or 0).

    ``syntax`` and ``runtime`` are the two published grammars, which both skip
    execution errors. ``full`` reads these too and adds ``error_type``.
    """
    line = F.col("line")
    passed_name = _name(line, PASS_PATTERN)
    failed_name = _name(line, FAIL_PATTERNS["runtime" if grammar == "full" else grammar])
    if grammar == "full":
        execution = _name(line, EXECUTION_PATTERN)
        error = F.coalesce(
            F.when(failed_name.isNotNull(), F.regexp_extract(line, r"(SYNTAX|RUNTIME) ERROR", 0)),
            _name(line, EXECUTION_PATTERN, 2),
        )
        failed_name = F.coalesce(failed_name, execution)
    # A substring test is far cheaper than the patterns and drops the chatter.
    parsed = lines.where(
        line.contains("passed successfully") | line.contains(" ERROR")
    ).select("*", passed_name.alias("_ok"), failed_name.alias("_bad"))
    if grammar == "full":
        parsed = parsed.withColumn("error_type", F.when(F.col("_ok").isNull(), error))
    return (
        parsed.where(F.col("_ok").isNotNull() | F.col("_bad").isNotNull())
        .withColumn("test_name", strip(F.coalesce("_ok", "_bad")))
        .withColumn("passed", F.col("_ok").isNotNull().cast("int"))
        .drop("_ok", "_bad")
    )


def file_label(file: Column) -> Column:
    """File name without folder, with the look-alike characters made plain."""
    # No-break space and Cyrillic es occur in some names.
    name = F.translate(F.element_at(F.split(file, "/"), -1), "\u00a0\u0421", " C")
    return strip(F.regexp_replace(F.regexp_replace(name, r" +", " "), r" ?\.(rtf|txt|log)\z", ""))


def method_from_file(file: Column) -> Column:
    """Method of a file called ``<suite> on <model> + AST + CHAIN.rtf``.

    The parts behind the model are the method; no part, or a leading CHAIN,
    stands for the base model.
    """
    def variant(parts: Column) -> Column:
        return F.array_join(F.slice(parts, 2, F.size(parts)), "_")

    def method(name: Column) -> Column:
        chain_only = name.startswith("CHAIN")
        return (
            F.when(name == "", F.lit("BASE"))
            .when(chain_only, F.concat(F.lit("BASE_"), name))
            .otherwise(name)
        )

    return let(let(F.split(F.upper(file_label(file)), r" ?\+ ?"), variant), method)


def method_table(spark: SparkSession, methods: dict[str, str]) -> DataFrame:
    """(file, method) from a dictionary."""
    pairs = F.create_map(*[F.lit(x) for item in methods.items() for x in item])
    return spark.range(1).select(F.explode(pairs).alias("file", "method"))


def attach_method(lines: DataFrame, method_map: DataFrame) -> DataFrame:
    """Replace ``file`` by ``method`` through a (file, method) table.

    The distinct files are labelled, of which there are few; lines meet them by their name as it is.
    """
    named = method_map.select(file_label(F.col("file")).alias("_label"), "method")
    files = lines.select("file").distinct().withColumn("_label", file_label(F.col("file"))).join(named, "_label").drop("_label")
    return lines.join(files, "file").drop("file")


def number_tests(verdicts: DataFrame) -> DataFrame:
    """(test_name, test_id): 1-based rank of the distinct names."""
    names = verdicts.select("test_name").distinct()
    return with_row_index(names, "test_name", name="_i").select(
        "test_name", (F.col("_i") + 1).alias("test_id")
    )


def attach_test_ids(verdicts: DataFrame) -> DataFrame:
    """The long verdict table with its test ids."""
    return verdicts.join(number_tests(verdicts), "test_name")


def last_verdicts(verdicts: DataFrame, order: Column | str = "line_no") -> DataFrame:
    """The verdict of the last line per method and test."""
    return verdicts.groupBy("method", "test_name").agg(F.max_by("passed", order).alias("passed"))


def percent_label(passed: Column, total: Column) -> Column:
    """``12/164 (7.3%)``; an empty total gives NULL."""
    share = F.try_divide(passed.cast("double"), total) * 100
    return F.concat(
        passed.cast("string"), F.lit("/"), total.cast("string"), F.lit(" ("), one_decimal(share), F.lit("%)")
    )


def method_stats(verdicts: DataFrame, order: Column | str = "line_no") -> DataFrame:
    """Passed lines per method over the number of distinct tests.

    Repeated lines count again, so ``pct`` may exceed 100; ``passed_distinct``
    counts each test once, by its last verdict.
    """
    per_test = verdicts.groupBy("method", "test_name").agg(
        F.sum("passed").alias("_lines"), F.max_by("passed", order).alias("_last")
    )
    tests = per_test.agg(F.countDistinct("test_name").alias("n"))
    return (
        per_test.groupBy("method")
        .agg(F.sum("_lines").alias("passed"), F.sum("_last").cast("bigint").alias("passed_distinct"))
        .withColumn("total_tests", tests.scalar())
        .withColumn("pct", F.try_divide(F.col("passed") * 100.0, F.col("total_tests")))
        .withColumn("label", percent_label(F.col("passed"), F.col("total_tests")))
    )


#: log2 of the registers of a sketch, and the relative standard error of its counts (1.04 / sqrt(registers)).
_SKETCH_BITS = 14
SKETCH_ERROR = 0.0082


def test_sketches(verdicts: DataFrame, *keys: str) -> DataFrame:
    """(keys..., tests): a sketch of the distinct tests of each group, of at most some kilobytes, to be kept and united later."""
    return verdicts.groupBy(*keys).agg(F.hll_sketch_agg("test_name", F.lit(_SKETCH_BITS)).alias("tests"))


def distinct_from_sketches(sketches: DataFrame, *keys: str) -> DataFrame:
    """(keys..., approx_tests): distinct tests of the united sketches, without the lines they were made of."""
    return sketches.groupBy(*keys).agg(F.hll_sketch_estimate(F.hll_union_agg("tests")).alias("approx_tests"))

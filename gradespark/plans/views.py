"""The evaluation tables, derived from the tables at hand.

The given tables hold no completions, verdicts or logs. These projections give
every row of them such a role; ``oracles`` says the same in DuckDB's SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gradespark.operators.logs import METHODS
from gradespark.parallel import spread


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def documents(spark: SparkSession, folder: str) -> DataFrame:
    """The texts, spread out: all work on them is heavy per row."""
    return spread(table(spark, folder, "documents"))


def method_of(key: str):
    return F.element_at(F.array(*map(F.lit, METHODS)), (F.col(key) % 11 + 1).cast("int"))


def tasks_raw(spark: SparkSession, folder: str) -> DataFrame:
    """part as a task table of the first suite."""
    number = F.col("p_partkey").cast("string")
    return table(spark, folder, "part").select(
        F.concat(F.lit("HumanEval/"), number).alias("task_id"),
        F.concat(F.lit("def fn_"), number, F.lit("(x):")).alias("prompt"),
        F.col("p_type").alias("canonical_solution"),
        F.col("p_brand").alias("test"),
        F.concat(F.lit("fn_"), number).alias("entry_point"),
    )


def mbpp_raw(spark: SparkSession, folder: str) -> DataFrame:
    """part as a task table of the second suite; every fifth task has no id."""
    number = F.col("p_partkey").cast("string")
    return table(spark, folder, "part").select(
        F.col("p_partkey").alias("id"),
        F.when(F.col("p_partkey") % 5 != 0, F.concat(F.lit("mbpp/"), number)).alias("task_id"),
        F.col("p_name").alias("text"),
        F.col("p_type").alias("code"),
        F.array(
            F.concat(F.lit("assert f("), F.col("p_size").cast("string"), F.lit(")")),
            F.lit("assert True"),
        ).alias("test_list"),
    )


def attempts(spark: SparkSession, folder: str) -> DataFrame:
    """orders as attempts: the customer is the task, time is the order of tries."""
    status = F.col("o_orderstatus")
    return table(spark, folder, "orders").select(
        F.concat(F.lit("HumanEval/"), F.col("o_custkey").cast("string")).alias("task_id"),
        method_of("o_orderkey").alias("method"),
        F.struct("o_orderdate", "o_orderkey").alias("attempt"),
        F.concat(
            F.lit("  def fn(x):\n    return "), F.col("o_orderkey").cast("string"), F.lit("\n")
        ).alias("code"),
        (status == "F").alias("ok"),
        # A round that raised has produced no code.
        (F.col("o_orderpriority") != "1-URGENT").alias("produced"),
        F.when(status == "P", "SyntaxError").when(status == "O", "AssertionError").alias("error"),
    )


def log(spark: SparkSession, folder: str) -> DataFrame:
    """events as log lines of eleven runs."""
    name = F.concat(F.lit("fn_"), F.col("user_id").cast("string"))
    line = (
        F.when(F.col("event_id") % 50 == 0, F.lit("INFO progress"))
        .when(F.col("event_type") == "signup", F.concat(F.lit("❌ SYNTAX ERROR in code for "), name))
        .when(
            F.col("event_type") == "error",
            F.concat(F.lit("❌ TEST EXECUTION ERROR for "), name, F.lit(": ValueError: bad value")),
        )
        .when(
            F.col("event_type") == "view",
            F.concat(F.lit("❌ RUNTIME ERROR raised for "), name, F.lit("  ")),
        )
        .otherwise(F.concat(F.lit("✅ HumanEval tests for "), name, F.lit(" passed successfully.")))
    )
    return table(spark, folder, "events").select(
        method_of("event_id").alias("method"), F.col("event_id").alias("line_no"), line.alias("line")
    )


def tests_dim(spark: SparkSession, folder: str) -> DataFrame:
    """part as the listed tests; two ids share each name."""
    return table(spark, folder, "part").select(
        (F.col("p_partkey") + 1).alias("test_id"),
        F.concat(F.lit("fn_"), F.expr("p_partkey div 2").cast("string")).alias("test_name"),
    )


def completions(spark: SparkSession, folder: str) -> DataFrame:
    """documents as completions: every text in one of the shapes that need cleaning."""
    doc, text = F.col("doc_id").cast("string"), F.col("text")
    shape = F.col("doc_id") % 7
    # What would end a Python string, or escape in it, is blanked out.
    note = F.concat(F.lit("'''"), F.translate("text", "'\"\\`", "    "), F.lit("'''"))
    code = (
        F.when(
            shape == 0,
            F.concat(F.lit("```python\ndef fn_"), doc, F.lit("(x):\n    "), note, F.lit("\n    return "), F.col("n_chars").cast("string"), F.lit("\n```")),
        )
        .when(shape == 1, F.concat(F.lit("  ```PY\nx = 1\ny = "), note, F.lit("\n```  ")))
        .when(shape == 2, F.concat(F.lit("note = "), note, F.lit("\\ndef f(x):\\n\\treturn x")))
        .when(
            shape == 3,
            F.concat(F.lit("    def f(x):\n        return x\n\nnote = "), note, F.lit("\n\nif __name__ == '__main__':\n    print(f(1))")),
        )
        .when(
            shape == 4,
            F.concat(F.lit("<|im_start|>"), text, F.lit("<|im_end|><tool_call><|endoftext|>")),
        )
        .when(shape == 5, F.concat(F.lit("note = "), note, F.lit("\n\nimport doctest\n\n  doctest.testmod()\n")))
        # Of some texts only the blanks are left.
        .when(F.col("doc_id") % 70 == 6, F.regexp_replace("text", r"\S", ""))
        .otherwise(F.concat(F.lit("   "), text, F.lit(" ?\n   ")))
    )
    return documents(spark, folder).select("doc_id", "source", code.alias("code"))


def references(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "benchmark").select(
        F.col("item_id").alias("reference_id"), F.col("text").alias("reference")
    )


def pairs(spark: SparkSession, folder: str) -> DataFrame:
    """Each document as a candidate for one benchmark text."""
    n = table(spark, folder, "benchmark").agg(F.count("*").alias("n")).scalar()
    return documents(spark, folder).select(
        F.col("doc_id").alias("pair_id"), (F.col("doc_id") % n).alias("reference_id"),
        "source", F.col("text").alias("candidate"),
    )


def tool_messages(spark: SparkSession, folder: str) -> DataFrame:
    """conversations with some turns as tool answers and some as tool calls."""
    turn, conv, role = F.col("turn"), F.col("conv_id"), F.col("role")
    new_role = F.when(
        (role != "system") & (turn > 0) & ((turn + conv) % 5 < 2), F.lit("tool")
    ).otherwise(role)
    calls = F.array(
        F.struct(
            F.concat(F.lit("fn_"), turn.cast("string")).alias("name"),
            F.concat(F.lit('{"x": '), conv.cast("string"), F.lit("}")).alias("arguments"),
        ),
        F.struct(F.lit("next").alias("name"), F.lit("{}").alias("arguments")),
    )
    return (
        table(spark, folder, "conversations")
        .withColumn("role", new_role)
        .withColumn("tool_calls", F.when((F.col("role") == "assistant") & (conv % 3 == 1), calls))
        .withColumn("text", F.when((conv % 6 == 1) & F.col("tool_calls").isNotNull(), "").otherwise(F.col("text")))
    )


def bags(spark: SparkSession, folder: str) -> DataFrame:
    """events as bag elements: the user is the bag, ``value`` the weight."""
    n = table(spark, folder, "embeddings").agg(F.count("*").alias("n")).scalar()
    return table(spark, folder, "events").select(
        F.col("user_id").alias("bag_id"), F.col("event_id").alias("element"),
        (F.col("event_id") * 7 % n).alias("vec_id"), F.col("value").alias("weight"),
    )


def embeddings(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "embeddings")


def quantized(spark: SparkSession, folder: str) -> DataFrame:
    """embeddings as 8-bit codes with a scale and bias per row."""
    x = F.col("embedding").cast("array<double>")
    low, high = F.array_min("x"), F.array_max("x")
    coded = embeddings(spark, folder).select("vec_id", x.alias("x")).select(
        "vec_id", "x", low.alias("bias"), ((high - low) / 255).alias("scale")
    )
    return coded.select(
        "vec_id", "bias", "scale",
        F.transform("x", lambda v: F.round((v - F.col("bias")) / F.col("scale")).cast("int")).alias("q"),
    )


def _bits(x, mantissa: int, bias: int, lowest: int):
    """Pattern of |x| cut off after ``mantissa`` bits, as SMALLINT."""
    size = F.abs(x)
    exponent = F.floor(F.log2(F.when(size > 0, size))).cast("int")
    unit = float(1 << mantissa)
    normal = (exponent + bias) * int(unit) + F.floor(
        (size / F.pow(F.lit(2.0), exponent.cast("double")) - 1) * unit
    )
    tiny = F.floor(size * (2.0 ** (mantissa - lowest)))
    bits = F.when(size == 0, F.lit(0)).when(exponent < lowest, tiny).otherwise(normal)
    return F.when(x < 0, bits - 32768).otherwise(bits).cast("smallint")


def half_rows(spark: SparkSession, folder: str) -> DataFrame:
    return embeddings(spark, folder).select(
        "vec_id", F.transform(F.col("embedding").cast("array<double>"), lambda x: _bits(x, 10, 15, -14)).alias("bits")
    )


def bfloat16_rows(spark: SparkSession, folder: str) -> DataFrame:
    return embeddings(spark, folder).select(
        "vec_id", F.transform(F.col("embedding").cast("array<double>"), lambda x: _bits(x, 7, 127, -126)).alias("bits")
    )


def flat_ids(spark: SparkSession, folder: str) -> DataFrame:
    """events as one flat list of ids."""
    n = embeddings(spark, folder).agg(F.count("*").alias("n")).scalar()
    return table(spark, folder, "events").select(
        F.col("event_id").alias("flat"), (F.col("event_id") * 7 % n).alias("vec_id")
    )


def bag_lengths(spark: SparkSession, folder: str) -> DataFrame:
    """The event count of each user as the length of a bag."""
    return table(spark, folder, "events").groupBy(F.col("user_id").alias("bag_id")).agg(F.count("*").alias("length"))

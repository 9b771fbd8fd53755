"""Result documents and CSV tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gradespark.operators.logs import METHODS

# The layout of a result document.
RUN_TYPE = (
    "struct<pass_rate:double,passed_examples:bigint,total_examples:bigint,timestamp:timestamp_ntz,"
    "config:struct<iterations:int,generation_config:map<string,string>,limit:bigint>>"
)
RESULTS_SCHEMA = f"metadata map<string,string>, benchmark_results map<string,{RUN_TYPE}>"

MATRIX_SCHEMA = "test_name string, test_id bigint"
LONG_SCHEMA = "test_name string, method string, passed int, test_id bigint"


def to_documents(runs: DataFrame, metadata: dict[str, str] | None = None, by: Sequence[str] = ()) -> DataFrame:
    """{metadata, benchmark_results}: one entry per benchmark name.

    ``runs`` holds the latest run of each benchmark (per ``by``), with the
    fields of ``RUN_TYPE``; a document has as many entries as benchmarks.
    """
    pairs = [F.lit(x) for item in (metadata or {}).items() for x in item]
    meta = F.create_map(*pairs) if pairs else F.create_map().cast("map<string,string>")
    run = F.struct("pass_rate", "passed_examples", "total_examples", "timestamp", "config").cast(RUN_TYPE)
    entries = F.collect_list(F.struct(F.col("benchmark"), run))
    documents = runs.groupBy(*by).agg(F.map_from_entries(entries).alias("benchmark_results"))
    return documents.select(*by, meta.alias("metadata"), "benchmark_results")


def save_results(runs: DataFrame, path: str, metadata: dict[str, str] | None = None) -> None:
    """Write a result document per run, one on each line, so that no row holds them all."""
    pairs = [F.lit(x) for item in (metadata or {}).items() for x in item]
    meta = F.create_map(*pairs) if pairs else F.create_map().cast("map<string,string>")
    run = F.struct("pass_rate", "passed_examples", "total_examples", "timestamp", "config").cast(RUN_TYPE)
    runs.select(meta.alias("metadata"), F.create_map("benchmark", run).alias("benchmark_results")).write.mode("overwrite").json(path)


def load_results(spark: SparkSession, path: str, whole_files: bool = False) -> DataFrame:
    """One row per document; a missing part is an empty map.

    A document is a line, or with ``whole_files`` a file.
    """
    return _filled(spark.read.schema(RESULTS_SCHEMA).json(path, multiLine=whole_files))


def parse_results(texts: DataFrame, column: str = "document") -> DataFrame:
    """The same from a column of JSON texts; the other columns stay."""
    kept = [c for c in texts.columns if c != column]
    parsed = texts.select(*kept, F.from_json(column, RESULTS_SCHEMA).alias("_d"))
    return _filled(parsed.select(*kept, "_d.*"))


def _filled(raw: DataFrame) -> DataFrame:
    kept = [c for c in raw.columns if c not in ("metadata", "benchmark_results")]
    return raw.select(
        *kept,
        F.coalesce("metadata", F.create_map().cast("map<string,string>")).alias("metadata"),
        F.coalesce("benchmark_results", F.create_map().cast(f"map<string,{RUN_TYPE}>")).alias("benchmark_results"),
    )


def runs_of(results: DataFrame) -> DataFrame:
    """The runs of result documents as rows."""
    kept = [c for c in results.columns if c not in ("metadata", "benchmark_results")]
    return results.select(*kept, F.explode("benchmark_results").alias("benchmark", "run")).select(*kept, "benchmark", "run.*")


def save_detailed_run(summary: DataFrame, config: DataFrame, verdicts: DataFrame, path: str) -> None:
    """Write the summary with its settings, and all verdicts beside it.

    The verdicts are a table of their own: one document could not hold them.
    """
    s = summary.select(F.struct(*summary.columns).alias("summary"))
    c = config.select(F.struct(*config.columns).alias("benchmark_config"))
    # One row each; the scalar subquery fails if there are more.
    s.withColumn("benchmark_config", c.scalar()).write.mode("overwrite").json(f"{path}/summary")
    verdicts.write.mode("overwrite").json(f"{path}/detailed_results")


def write_csv(rows: DataFrame, path: str) -> None:
    """CSV with a header line, in UTF-8."""
    rows.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def read_matrix(spark: SparkSession, path: str, methods: Sequence[str] = METHODS) -> DataFrame:
    """A verdict matrix from CSV."""
    schema = ", ".join([MATRIX_SCHEMA, *[f"{m} int" for m in methods]])
    return spark.read.schema(schema).option("header", True).option("escape", '"').option("enforceSchema", False).csv(path)


def read_long(spark: SparkSession, path: str) -> DataFrame:
    """A long verdict table from CSV."""
    return spark.read.schema(LONG_SCHEMA).option("header", True).option("escape", '"').option("enforceSchema", False).csv(path)

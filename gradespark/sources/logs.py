"""Run logs from files."""

from __future__ import annotations

import logging
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gradespark.functions.rtf import rtf_to_text
from gradespark.functions.text import split_lines, strip

_log = logging.getLogger(__name__)


def existing(spark: SparkSession, paths: Sequence[str]) -> list[str]:
    """The paths that exist; the others are skipped with a warning."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    found = []
    for path in paths:
        hadoop_path = jvm.org.apache.hadoop.fs.Path(path)
        fs = hadoop_path.getFileSystem(conf)
        if fs.exists(hadoop_path) or fs.globStatus(hadoop_path):
            found.append(path)
        else:
            _log.warning("log file not found: %s", path)
    return found


def drop_invalid_bytes(text: Column) -> Column:
    """Text without the bytes that are no UTF-8."""
    mended = F.replace(F.make_valid_utf8(text), F.lit("\ufffd"), F.lit(""))
    return F.when(F.is_valid_utf8(text), text).otherwise(mended)


def read_logs(spark: SparkSession, paths: Sequence[str], *, rtf: bool = False) -> DataFrame:
    """(file, line_no, line) of all files in one table.

    The files are read by line, so a large file is split over many tasks; none
    of the RTF patterns crosses a line end. ``line_no`` orders the lines of a
    file (split offset, row, piece of the row); it is no plain number.
    """
    found = existing(spark, paths)
    if not found:
        return spark.createDataFrame(
            [], "file string, line_no struct<split:bigint,row:bigint,piece:int>, line string"
        )
    raw = spark.read.text(found).select(
        # The name comes percent-encoded; a plus sign stands for itself.
        F.url_decode(F.replace(F.col("_metadata.file_name"), F.lit("+"), F.lit("%2B"))).alias("file"),
        F.col("_metadata.file_block_start").alias("split"),
        F.monotonically_increasing_id().alias("row"),
        drop_invalid_bytes(F.col("value")).alias("text"),
    )
    text = rtf_to_text(F.col("text")) if rtf else F.col("text")
    lines = raw.select("file", "split", "row", F.posexplode(split_lines(text)).alias("piece", "line"))
    return lines.select(
        "file", F.struct("split", "row", "piece").alias("line_no"), strip(F.col("line")).alias("line")
    )

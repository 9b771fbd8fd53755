"""What the operators of this subpackage share: the shared folder and narrow inputs."""

from __future__ import annotations

import ctypes
import tempfile
from collections.abc import Callable, Iterator, Mapping
from functools import wraps

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of an Arrow batch of texts.
TEXT_ROWS = 1000


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the session names it.

    ``spark.checkpoint.dir`` decides. Only a local session without that setting
    gets a folder of its own.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not context.getCheckpointDir():
        if not folder:
            if not context.master.startswith("local["):
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="corpus-")
        context.setCheckpointDir(folder)
    return folder or context.getCheckpointDir()


def settled(df: DataFrame) -> DataFrame:
    """Compute ``df`` once, keep it in the shared folder, and go on from there."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def narrow(df: DataFrame, columns: Mapping[str, str | Column]) -> DataFrame:
    """Only the named columns, under names and types of our own.

    Whatever else the table holds, under whatever name, cannot clash then.
    """
    return df.select(*[(F.col(c) if isinstance(c, str) else c).alias(n) for n, c in columns.items()])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def map_texts(rows: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: object) -> DataFrame:
    """``rows`` mapped by ``run`` in Arrow batches that stay small even where texts are long.

    Lowers the session's limit of rows in a batch to ``TEXT_ROWS``: JVM and worker each hold a whole batch.
    """
    conf, key = rows.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(conf.get(key)) <= TEXT_ROWS:
        conf.set(key, str(TEXT_ROWS))
    return rows.mapInArrow(lean(run), schema)


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], rows: int = 256) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` on small slices of its batches; what the task has allocated goes back to the system at its end.

    Python workers outlive their tasks, and what they keep is lost to the executor.
    """

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batch.slice(at, rows) for batch in batches for at in range(0, batch.num_rows, rows))
        finally:
            release()

    return wrapped


def release() -> None:
    """Give what Arrow and the C library hold free back to the system; neither does so by itself."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def released(learn: Callable) -> Callable:
    """``learn``, a fit on rows brought to the driver, after which the driver is as small as before."""

    @wraps(learn)
    def wrapped(*args, **kwargs):
        try:
            return learn(*args, **kwargs)
        finally:
            release()

    return wrapped

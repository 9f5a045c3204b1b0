"""Helpers common to the text operators: tables, folds and shared storage."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import gc
import os
import re
import tempfile
import uuid
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_written: list[tuple[SparkSession, str]] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``.

    A folder of this machine is set only where Spark runs in one process, as
    in tests; on a cluster a missing setting is an error.
    """
    context = spark.sparkContext
    found = context.getConf().get("spark.checkpoint.dir", None)
    if found is None:
        if context._jsc.sc().getCheckpointDir().isDefined():
            return context._jsc.sc().getCheckpointDir().get()
        if not re.match(r"local(\[|$)", context.master):
            raise ValueError("spark.checkpoint.dir is not set; it names the folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="coinsight-")
        context.setCheckpointDir(found)
    return found


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet into the shared folder and read again.

    This cuts lineage as ``checkpoint()`` does, but columns stay prunable and
    the files are compressed. They are removed when the driver ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/coinsight/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def tidied(run: Callable[[Iterator], Iterator], forget: Callable[[], object] = lambda: None) -> Callable[[Iterator], Iterator]:
    """``run`` that forgets caches and returns free memory when its task ends.

    Python workers outlive their tasks and serve other stages; what one stage
    keeps would be missing in the next.
    """

    def whole(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            forget()
            gc.collect()
            pa.default_memory_pool().release_unused()
            with contextlib.suppress(OSError, AttributeError):
                ctypes.CDLL(None).malloc_trim(0)

    return whole


def drop_stored() -> None:
    """Remove what ``stored`` has written in this process."""
    while _written:
        spark, path = _written.pop()
        try:
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
        except Exception:  # the JVM has ended before this process
            return


atexit.register(drop_stored)


def remainder(column: Column | str, n: int) -> Column:
    """crc32 of the id as decimal text, modulo ``n``; a null id counts as ''."""
    column = F.col(column) if isinstance(column, str) else column
    return F.crc32(F.coalesce(column.cast("string"), F.lit("")).cast("binary")) % n


def py_remainder(doc_id: int | None, n: int) -> int:
    """The same as :func:`remainder`, for a Python value."""
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % n


def map_rows(df: DataFrame, columns: list[str], schema: str, make: Callable[[], Callable]) -> DataFrame:
    """Apply a batch function to the named columns of ``df``.

    ``make()`` runs once per task and returns a function from lists (one per
    column) to lists, one per output column. Batches are Arrow batches, so a
    task holds one batch at a time.
    """
    target = pa_schema(df.sparkSession, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            got = work(*(batch.column(i).to_pylist() for i in range(batch.num_columns)))
            yield pa.RecordBatch.from_arrays([pa.array(x, t.type) for x, t in zip(got, target, strict=True)], schema=target)

    return df.select(*columns).mapInArrow(tidied(run), schema)


def pa_schema(spark: SparkSession, ddl: str) -> pa.Schema:
    """The Arrow schema of a DDL string."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(ddl))


def repository_path() -> str:
    """Where this package stands, for the import path of executors."""
    return os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

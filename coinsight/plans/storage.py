"""Cutting lineage in driver loops."""

from __future__ import annotations

import gc
import re
import tempfile
import uuid

from pyspark.sql import DataFrame


def _shared_folder(spark) -> str:
    """The checkpoint folder of the session, which executors share.

    A folder of this machine is set only where Spark runs in one process, as
    in tests; on a cluster a missing setting is an error.
    """
    context = spark.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        found = context.getConf().get("spark.checkpoint.dir", None)
        if found is None and not re.match(r"local(\[|$)", context.master):
            raise ValueError("spark.checkpoint.dir is not set; it names the folder that all executors share")
        context.setCheckpointDir(found or "file://" + tempfile.mkdtemp(prefix="coinsight-"))
    return context.getConf().get("spark.checkpoint.dir", None) or context._jsc.sc().getCheckpointDir().get()


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` written to the checkpoint folder."""
    _shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def released(spark) -> None:
    """Ask for the removal of what finished jobs have shuffled and broadcast.

    Spark removes it when the driver collects its garbage.
    """
    gc.collect()
    spark._jvm.System.gc()


class Rewritten:
    """A table in the shared folder that a loop writes anew now and then.

    Parquet keeps columns prunable. The version before is removed once the new
    one stands, so at most two are kept.
    """

    def __init__(self, df: DataFrame):
        self.path = None
        self.df = self.write(df)

    def write(self, df: DataFrame) -> DataFrame:
        """``df``, written and read again; it replaces what was written before."""
        spark, old = df.sparkSession, self.path
        self.path = f"{scratch(spark)}/loop-{uuid.uuid4().hex}"
        df.write.parquet(self.path)
        self.df = spark.read.schema(df.schema).parquet(self.path)
        self._remove(spark, old)
        return self.df

    def close(self) -> None:
        """Remove the table."""
        self._remove(self.df.sparkSession, self.path)

    @staticmethod
    def _remove(spark, path: str | None) -> None:
        if path:
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def scratch(spark) -> str:
    """A folder that driver and executors share, for files of a query's own."""
    return f"{_shared_folder(spark).rstrip('/')}/coinsight"

"""Checkpoints in the shared folder of the session."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame


def folder(df: DataFrame) -> str:
    """The folder of this session for what its jobs write on the way."""
    spark = df.sparkSession
    context = spark.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the whole cluster shares")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="orograph-checkpoint-"))
    return context._jsc.sc().getCheckpointDir().get()


def durable(df: DataFrame) -> DataFrame:
    """Write ``df`` to the session's ``spark.checkpoint.dir`` and read it from there.

    Where that setting is unset a local session, as in tests, gets a folder of its
    own; on a cluster it has to be set, since executors share no local folder.
    """
    folder(df)
    return df.checkpoint(eager=True)


class Rounds:
    """The tables of a loop, each written to the shared folder and read again.

    A checkpoint keeps the size that was estimated for its plan, and that of a
    join is the product of its sides': in a loop that joins a table with itself
    the number's digits double each round, until planning takes longer than the
    work. A written table has the size of its files. A loop keeps only what it
    wrote last: ``keep`` drops the table before.
    """

    def __init__(self) -> None:
        self._last = None

    def keep(self, df: DataFrame) -> DataFrame:
        return self.parted(df)

    def parted(self, df: DataFrame, *by: str) -> DataFrame:
        """``keep`` with a folder for each value of ``by``, so that a later filter on these reads no other."""
        path = f"{folder(df)}/rounds-{uuid.uuid4()}"
        df.write.partitionBy(*by).parquet(path)
        self.drop()
        self._last = (df.sparkSession, path)
        return df.sparkSession.read.schema(df.schema).parquet(path)

    def drop(self) -> None:
        if self._last:
            spark, path = self._last
            path = spark._jvm.org.apache.hadoop.fs.Path(path)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
            self._last = None

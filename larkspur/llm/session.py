"""Session settings that the corpus operators share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which all executors share.

    A session on one machine that names none, as in tests, gets a temporary one; on a cluster it must be named.
    """
    sc = spark.sparkContext
    known = sc._jsc.sc().getCheckpointDir()
    if not known.isDefined():
        folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
        if folder is None:
            if not sc.master.startswith("local["):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="larkspur-")
        sc.setCheckpointDir(folder)
        known = sc._jsc.sc().getCheckpointDir()
    return known.get()


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage in the shared folder, so that a lost executor costs no recomputation.

    Spark removes shuffle files, and checkpoints where spark.cleaner.referenceTracking.cleanCheckpoints is set, once
    nothing refers to them any more and the driver has collected its garbage, which it does by itself every half hour;
    the rounds here ask for it, so that those of earlier rounds do not pile up.
    """
    shared_folder(df.sparkSession)
    df.sparkSession.sparkContext._jvm.System.gc()
    return df.checkpoint(eager=True)


class Scratch:
    """Tables written in the shared folder for the time of a ``with`` block.

    A checkpoint carries the size that was estimated for its plan, which joins multiply round by round; a written table
    is read with its true size, and is deleted as soon as a round no longer needs it.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.top, self.n = spark, f"{shared_folder(spark)}/scratch-{uuid.uuid4().hex}", 0
        self.kept_from = 0

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_) -> None:
        self._delete(self.top)

    def _delete(self, path: str) -> None:
        sc = self.spark.sparkContext
        path = sc._jvm.org.apache.hadoop.fs.Path(path)
        path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)

    def written(self, df: DataFrame) -> DataFrame:
        path = f"{self.top}/{self.n}"
        self.n += 1
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop_before(self, n: int) -> None:
        """Deletes the tables before the n-th; nothing unwritten may still read them."""
        for i in range(self.kept_from, n):
            self._delete(f"{self.top}/{i}")
        self.kept_from = n


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))

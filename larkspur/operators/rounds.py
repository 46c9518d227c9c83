"""What iterative operators share: tables written between rounds, and joins in which a frequent key meets in several tasks."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which all executors share; only a session on one machine may leave it unset."""
    sc = spark.sparkContext
    known = sc._jsc.sc().getCheckpointDir()
    if known.isDefined():
        return known.get()
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if folder is None:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="larkspur-")
    sc.setCheckpointDir(folder)
    return sc._jsc.sc().getCheckpointDir().get()


def checkpoint(df: DataFrame) -> DataFrame:
    """Cuts the lineage in the shared folder: a lost executor costs no earlier round."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


class Rounds:
    """Tables written in the shared folder within a ``with`` block; those of earlier rounds go as soon as ``forget`` says so."""

    def __init__(self, spark: SparkSession):
        self.spark, self.top, self.paths = spark, f"{shared_folder(spark)}/rounds-{uuid.uuid4().hex}", []

    def __enter__(self) -> Rounds:
        return self

    def __exit__(self, *_) -> None:
        self._delete(self.top)

    def _delete(self, path: str) -> None:
        sc = self.spark.sparkContext
        path = sc._jvm.org.apache.hadoop.fs.Path(path)
        path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)

    def write(self, df: DataFrame) -> DataFrame:
        """The table as written: its true size and count are known from then on."""
        self.paths.append(f"{self.top}/{uuid.uuid4().hex}")
        df.write.parquet(self.paths[-1])
        return self.spark.read.schema(df.schema).parquet(self.paths[-1])

    def forget(self, keep: int) -> None:
        """Deletes all but the last ``keep`` tables; nothing unwritten may still read them."""
        for path in self.paths[: len(self.paths) - keep]:
            self._delete(path)
        self.paths = self.paths[len(self.paths) - keep :]


#: Rows of a key that one task may meet; a key is split beyond that and one HOT_SHARE-th of all rows, so that at most HOT_SHARE keys are.
SPLIT = 4096
HOT_SHARE = 8192


def spread_join(many: DataFrame, one: DataFrame, keys: list[str], sizes: DataFrame, total: int, by: str) -> DataFrame:
    """many joined with one, which has a row a key; sizes (keys, n) counts many's rows.

    The rows of a frequent key are dealt by the hash of ``by`` to several tasks, each of which gets the key's row.  The list of
    frequent keys has at most HOT_SHARE rows and is broadcast.
    """
    most = max(SPLIT, total // HOT_SHARE)
    if total <= most:
        return many.join(one, keys)
    hot = F.broadcast(sizes.where(F.col("n") > most).select(*keys, F.ceil(F.col("n") / most).cast("int").alias("_parts")))
    parts = F.coalesce("_parts", F.lit(1))
    dealt = many.join(hot, keys, "left").withColumn("_salt", F.pmod(F.xxhash64(by), parts).cast("int")).drop("_parts")
    copies = one.join(hot, keys, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), parts - 1))).drop("_parts")
    return dealt.join(copies, [*keys, "_salt"]).drop("_salt")

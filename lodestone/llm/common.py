"""Small helpers that the training-data operators share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of anything but the space and the five ASCII controls \t \n \v \f \r.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_root(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``.

    Unset, it is a temporary folder where driver and executors are one process (master ``local[...]``); elsewhere
    each executor would write to its own disk and results would be incomplete, so that is an error.
    """
    sc = spark.sparkContext
    root = sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not root:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="lodestone-"))
        root = sc.getCheckpointDir()
    return root.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, deleted when the application ends."""
    path = f"{shared_root(spark)}/lodestone-{name}-{uuid.uuid4().hex}"
    jvm = spark._jvm
    hadoop = jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    return path


def drop_path(spark: SparkSession, path: str) -> None:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write ``df`` as Parquet in the shared folder and read it back.

    Unlike a cached frame it survives the loss of any executor, and it is columnar and compressed.
    """
    return materialize_with_path(df, name)[0]


def materialize_with_path(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


class Scratch:
    """Tables that one operator needs only until its result is written."""

    def __init__(self):
        self.tables: list[tuple[SparkSession, str]] = []

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        out, path = materialize_with_path(df, name)
        self.tables.append((df.sparkSession, path))
        return out

    def drop(self) -> None:
        for spark, path in self.tables:
            drop_path(spark, path)
        self.tables.clear()


def word_count(text) -> F.Column:
    """Number of words of a text column; null counts 0. Counts word starts, which is cheaper than splitting."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def carried(docs: DataFrame, *own: str, name: str = "carried") -> DataFrame:
    """The columns ``own`` of ``docs`` beside all its others in one struct, so that none clashes with an operator's."""
    rest = [docs[c] for c in docs.columns if c not in own]
    return docs.select(*(docs[c] for c in own), (F.struct(*rest) if rest else F.lit(None).cast("struct<none: int>")).alias(name))


def uncarried(rows: DataFrame, columns: list[str], *own: str, name: str = "carried") -> DataFrame:
    """``columns`` in their order: those in ``own`` as they are now, the others out of the struct."""
    return rows.select(*(F.col(c) if c in own else F.col(name)[c].alias(c) for c in columns))

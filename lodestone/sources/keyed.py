"""SK2, SK4, SK5 on a stored table: a change reads and rewrites only the buckets of the keys that it names.

A table is a folder of Parquet files with a folder a bucket, a hash of the key.  A change is joined with its buckets alone, and those alone are written, by
dynamic partition overwrite: files of other buckets keep their names and times.  All three changes give the same table when they are applied again, so one that
broke off while its buckets were put in place is simply repeated.  Changes of one table must not run at the same time.

A bucket is written in as many files as its size asks for (a rebalance by Spark), so a key with a great part of all rows is not one task.  Each bucket holds a
row that only says that it is there: a bucket whose last row goes is written again, too.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.operators import relational as op
from lodestone.sources.files import written

BUCKET, LIVE = "_bucket", "_live"
#: buckets that a table may have; the list of those that a change touches comes to the driver
MOST = 1 << 16


class Keyed:
    """A table at ``path`` whose rows are found by ``keys``."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        about = spark.read.schema("buckets int, keys array<string>, ddl string").json(f"{path}/_about").first()
        self.buckets, self.keys, self.ddl = about["buckets"], list(about["keys"]), about["ddl"]

    @classmethod
    def create(cls, rows: DataFrame, path: str, keys: Sequence[str], buckets: int = 64) -> Keyed:
        """A new table of ``rows``; the path must not be there yet."""
        if not 0 < buckets <= MOST:
            raise ValueError(f"buckets must be between 1 and {MOST}")
        spark = rows.sparkSession
        ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
        about = spark.range(1).select(F.lit(buckets).alias("buckets"), F.array(*(F.lit(k) for k in keys)).alias("keys"), F.lit(ddl).alias("ddl"))
        about.coalesce(1).write.json(f"{path}/_about")
        table = cls(spark, path)
        table._put(table._dealt(rows), spark.range(buckets).select(F.col("id").cast("int").alias(BUCKET)))
        return table

    def load(self) -> DataFrame:
        return self._stored().where(LIVE).drop(LIVE, BUCKET)

    def _stored(self) -> DataFrame:
        return self.spark.read.schema(f"{self.ddl}, {LIVE} boolean, {BUCKET} int").parquet(self.path)

    def _dealt(self, rows: DataFrame) -> DataFrame:
        nulls = F.concat(*(F.col(k).isNull().cast("string") for k in self.keys))  # a hash passes nulls over
        types = {f.name: f.dataType for f in self.spark.createDataFrame([], self.ddl).schema}
        rows = rows.withColumns({k: F.col(k).cast(types[k]) for k in self.keys})  # an int and a long hash differently
        return rows.withColumn(BUCKET, F.pmod(F.xxhash64(nulls, *self.keys), F.lit(self.buckets)).cast("int"))

    def _put(self, rows: DataFrame, touched: DataFrame) -> None:
        own = [f.name for f in self.spark.createDataFrame([], self.ddl).schema]
        live = rows.select(*own, F.lit(True).alias(LIVE), BUCKET)
        there = touched.select(F.lit(False).alias(LIVE), BUCKET)
        both = live.unionByName(there, allowMissingColumns=True).hint("rebalance", BUCKET)
        both.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(BUCKET).parquet(self.path)

    def _change(self, changes: DataFrame, applied) -> list[int]:
        changes = written(self._dealt(changes), "changes")  # read more than once, and alike each time
        touched = changes.select(BUCKET).distinct()
        numbers = sorted(r[0] for r in touched.collect())
        if numbers:
            current = self._stored().where(F.col(BUCKET).isin(numbers)).where(LIVE).drop(LIVE)
            self._put(applied(current, changes), touched)
        return numbers

    def delete(self, gone: DataFrame) -> list[int]:
        """SK2: rows with the keys of ``gone`` go.  Returns the buckets that were rewritten, as all three do."""
        return self._change(gone.select(*self.keys).distinct(), self._without)

    def replace(self, rows: DataFrame) -> list[int]:
        """SK4: all rows of the keys in ``rows`` are replaced by ``rows``."""
        return self._change(rows, lambda old, new: self._without(old, new).unionByName(new.select(*old.columns)))

    def upsert(self, changes: DataFrame, keep_first: Sequence[str] = ()) -> list[int]:
        """SK5: as ``relational.upsert``; a key that comes twice in ``changes`` is an error, as which of both holds is not said."""
        twice = changes.groupBy(*self.keys).count().where("count > 1").select(*self.keys).first()
        if twice is not None:
            raise ValueError(f"{tuple(twice)} comes more than once")
        return self._change(changes, lambda old, new: op.upsert(old, new, [BUCKET, *self.keys], keep_first))

    def _without(self, old: DataFrame, new: DataFrame) -> DataFrame:
        named = new.select(*(F.col(k).alias(f"_k_{k}") for k in self.keys), F.col(BUCKET).alias("_k_bucket")).distinct()
        on = [F.col(BUCKET) == F.col("_k_bucket"), *(F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in self.keys)]
        return old.join(named, on, "left_anti")

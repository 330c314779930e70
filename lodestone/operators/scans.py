"""Running numbers, sums and last values of a key, when one key may have a great part of all rows.

A window by key has all rows of a key in one task.  Here rows are dealt by range of key and order, so a key that is large is in several cells; a
cell's totals of each key are carried to the cells after it (sums add, of last values the later one holds, which is what makes the rule associative), and
a second pass in the cells adds what is carried.  A task has a cell, and of a key's totals one row a cell.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.sources.files import written


def scanned(rows: DataFrame, key: Sequence[str], order: Sequence[str], sums: Mapping[str, Column] | None = None, last: Mapping[str, Column] | None = None, cells: int | None = None, earlier: Mapping[str, Column] | None = None) -> DataFrame:
    """``rows`` with ``position`` (from 1) and ``total`` of their key, each of ``sums`` up to the row, and of ``last`` the last value that is not null up to it, of ``earlier`` before it.

    order: columns that tell the rows of a key apart, ascending, nulls first.  cells: ranges to deal rows into.  Null keys are a key.
    """
    sums, last, earlier = {"position": F.lit(1).cast("long"), **(sums or {})}, last or {}, earlier or {}
    last = {**last, **earlier}
    valued = rows.withColumns({**{f"_s_{n}": c for n, c in sums.items()}, **{f"_l_{n}": c for n, c in last.items()}})
    by = [*key, *order]
    dealt = valued.repartitionByRange(cells, *by) if cells else valued.repartitionByRange(*by)
    dealt = written(dealt.withColumn("_cell", F.spark_partition_id()), "scan-cells")
    place = F.struct(*order)
    totals = dealt.groupBy(*key, "_cell").agg(*(F.sum(f"_s_{n}").alias(f"_s_{n}") for n in sums), *(F.max_by(f"_l_{n}", F.when(F.col(f"_l_{n}").isNotNull(), place)).alias(f"_l_{n}") for n in last))
    before = Window.partitionBy(*key).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select(
        *(F.col(c).alias(f"_k_{c}") for c in key), F.col("_cell").alias("_k_cell"), F.sum("_s_position").over(Window.partitionBy(*key)).alias("total"),
        *(F.coalesce(F.sum(f"_s_{n}").over(before), F.lit(0)).alias(f"_c_{n}") for n in sums), *(F.last(f"_l_{n}", ignorenulls=True).over(before).alias(f"_p_{n}") for n in last),
    )
    on = reduce(Column.__and__, (F.col(c).eqNullSafe(F.col(f"_k_{c}")) for c in key), F.col("_cell") == F.col("_k_cell"))
    upto = Window.partitionBy(*key, "_cell").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    past = upto.rowsBetween(Window.unboundedPreceding, -1)
    found = dealt.join(carried, on)
    found = found.withColumns({
        **{n: F.col(f"_c_{n}") + F.coalesce(F.sum(f"_s_{n}").over(upto), F.lit(0)) for n in sums},
        **{n: F.coalesce(F.last(f"_l_{n}", ignorenulls=True).over(past if n in earlier else upto), F.col(f"_p_{n}")) for n in last},
    })
    return found.select(*rows.columns, "total", *sums, *last)


def link_indices(rows: DataFrame, key: Sequence[str], order: Sequence[str], cells: int | None = None) -> DataFrame:
    """W1 as ``windows.link_indices`` has it: chunk_index from 0, prev_index and next_index with -1 at the ends."""
    found = scanned(rows, key, order, cells=cells)
    at = (F.col("position") - 1).cast("int")
    following = F.when(F.col("position") < F.col("total"), at + 1).otherwise(-1)
    return found.select(*rows.columns, at.alias("chunk_index"), (at - 1).alias("prev_index"), following.alias("next_index"))

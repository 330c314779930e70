"""How two stores differ, by invertible Bloom tables, with data in proportion to the difference.

A row becomes numbers of 32 bits (its identity) and two of a check.  Each store adds every row to three cells of a table, one in each third; a cell holds the
number of its rows and the sums of their numbers.  Tasks add up on their own and send cells, never rows.  The difference of two such tables is the table of
the difference: what both have is gone.  A cell whose sums are a whole multiple of one identity, with a check that agrees, names a row and how many times more
it is on one side; taking it out of its other cells frees further ones.  Rows are dealt to ranges by a hash, and a range is peeled in a task of its own.

How many rows differ is told by a small first table: the rows whose hash ends in k zero bits, for each k (strata), of which the sparse ones can be peeled.
A range that does not come out empty is compared in full by counting, and that alone is.
Sums hold up to 2^31 rows a cell, so some 10^11 rows a store.  Where the stores differ in most rows this is no cheaper than counting them all.
"""

from __future__ import annotations

import struct
from collections.abc import Sequence
from functools import reduce
from math import ceil

import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.sources.files import written

#: cells of a stratum, and strata
STRATUM, STRATA = 96, 40
#: differing rows that a range should have, and cells for each of them
RANGE_ROWS, SPARE = 1024, 2.0
LOW = (1 << 32) - 1


def halves(c: Column) -> list[Column]:
    return [F.shiftrightunsigned(c, 32), c.bitwiseAND(F.lit(LOW))]


def identity(df: DataFrame, columns: Sequence[str]) -> list[Column]:
    """Numbers of 32 bits that tell rows apart: a single column of whole numbers by itself, anything else by 128 bits of hashes."""
    nulls = F.concat(*(F.col(c).isNull().cast("string") for c in columns))  # a hash passes nulls over
    if len(columns) == 1 and isinstance(df.schema[columns[0]].dataType, (T.LongType, T.IntegerType, T.ShortType, T.ByteType)):
        return [*halves(F.coalesce(F.col(columns[0]).cast("long"), F.lit(0))), F.col(columns[0]).isNull().cast("long")]
    return [*halves(F.xxhash64(F.lit(1), nulls, *columns)), *halves(F.xxhash64(F.lit(2), *columns, nulls))]


def hashed(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``columns`` with _id0.., their check _c0 and _c1, and _h, the hash that deals rows to ranges and strata."""
    df = df.select(*columns, *(c.alias(f"_id{k}") for k, c in enumerate(identity(df, columns))))
    df = df.withColumn("_check", F.xxhash64(*(c for c in df.columns if c.startswith("_id"))))
    first, second = halves(F.col("_check"))
    return df.withColumns({"_c0": first, "_c1": second, "_h": F.xxhash64(F.lit(4), "_check")}).drop("_check")


def numbers(df: DataFrame) -> list[str]:
    return [*(c for c in df.columns if c.startswith("_id")), "_c0", "_c1"]


def cells(left: DataFrame, right: DataFrame, part: Column, third: int) -> DataFrame:
    """The difference of both tables: _part, cell, n and the sums; ``third`` cells in each of three thirds.  Cells with nothing in them are left out."""
    names = numbers(left)
    both = left.select(part.alias("_part"), *names, F.lit(1).alias("_sign")).unionByName(right.select(part.alias("_part"), *names, F.lit(-1).alias("_sign")))
    upper = F.shiftright("_c0", 16) + F.shiftright("_c1", 16) * (1 << 16)
    place = F.array(F.pmod("_c0", F.lit(third)), F.pmod("_c1", F.lit(third)) + third, F.pmod(upper, F.lit(third)) + 2 * third)
    summed = both.withColumn("cell", F.explode(place)).groupBy("_part", "cell").agg(F.sum("_sign").alias("n"), *(F.sum(F.col("_sign") * F.col(c)).alias(c) for c in names))
    return summed.where(reduce(Column.__or__, (F.col(c) != 0 for c in ["n", *names])))


def peel(rows: Sequence[Sequence[int]], third: int) -> tuple[list[list[int]], bool]:
    """Of cells (cell, n, sums..) the rows found, each [times, numbers..], and whether nothing is left."""
    table = {r[0]: list(r[1:]) for r in rows}
    width = len(rows[0]) - 1 if rows else 0
    queue, found = list(table), []
    while queue:
        cell = queue.pop()
        n, *sums = table[cell]
        if n == 0 or any(x % n for x in sums):
            continue
        *ids, c0, c1 = one = [x // n for x in sums]
        check = 42  # the hash's own seed
        for x in ids:
            check = xxhash.xxh64_intdigest(struct.pack("<q", x), check)
        if (check >> 32, check & LOW) != (c0, c1):
            continue
        found.append([n, *one])
        for at in (c0 % third, c1 % third + third, ((c0 >> 16) + (c1 >> 16 << 16)) % third + 2 * third):
            old = table.setdefault(at, [0] * width)
            table[at] = [old[0] - n, *(x - n * y for x, y in zip(old[1:], one))]
            queue.append(at)
    return found, not any(any(v) for v in table.values())


def estimate(left: DataFrame, right: DataFrame) -> int:
    """About how many rows differ; ``STRATA * 3 * STRATUM`` cells come to the driver."""
    zeros = F.least(F.lit(STRATA - 1), F.bit_count(F.col("_h").bitwiseAND(-F.col("_h")) - 1))
    strata: dict[int, list[tuple[int, ...]]] = {}
    for part, *rest in cells(left, right, zeros, STRATUM).collect():
        strata.setdefault(part, []).append(tuple(rest))
    seen = 0
    for level in reversed(range(STRATA)):
        found, whole = peel(strata.get(level, []), STRATUM)
        if not whole:
            return max(seen, 1) << (level + 1)
        seen += len(found)
    return seen


def differing(left: DataFrame, right: DataFrame, columns: Sequence[str], expected: int | None = None, share: float = SPARE) -> DataFrame:
    """Rows of ``columns`` that one side has more often: the columns, ``side`` ("left" or "right") and ``times``, how many times more.

    expected: about how many rows differ, where that is known.  share: cells for each of the rows that a range should have; with few, more ranges are counted
    in full.  Nulls equal each other; other columns are not read.  A table that is empty differs in all rows of the other.
    """
    a, b = hashed(left, columns), hashed(right, columns)
    names = numbers(a)
    parts = max(1, ceil(1.5 * (estimate(a, b) if expected is None else expected) / RANGE_ROWS))
    third = ceil(RANGE_ROWS * share / 3) | 1
    part = F.pmod("_h", F.lit(parts))

    def peeled(cells_of_part: pd.DataFrame) -> pd.DataFrame:
        number = int(cells_of_part["_part"].iloc[0])
        found, whole = peel(cells_of_part[["cell", "n", *names]].to_numpy("int64").tolist(), third)
        rows = [[number, True, *r] for r in found] if whole else [[number, False, 0, *([0] * len(names))]]
        return pd.DataFrame(rows, columns=["_part", "whole", "n", *names])

    schema = ", ".join(["_part long", "whole boolean", "n long", *(f"{c} long" for c in names)])
    told = written(cells(a, b, part, third).groupBy("_part").applyInPandas(peeled, schema), "differences")
    out = None
    for side, rows, sign in (("left", a, 1), ("right", b, -1)):
        named = told.where(F.col("whole") & (F.col("n") * sign > 0)).select(*names, (F.col("n") * sign).alias("times"))
        found = rows.join(named, names).select(*columns, F.lit(side).alias("side"), "times").distinct()
        out = found if out is None else out.unionByName(found)
    open_parts = told.where("not whole").select("_part")
    if not open_parts.isEmpty():
        both = a.select(*columns, part.alias("_part"), F.lit(1).alias("_sign")).unionByName(b.select(*columns, part.alias("_part"), F.lit(-1).alias("_sign")))
        counted = both.join(open_parts, "_part", "left_semi").groupBy(*columns).agg(F.sum("_sign").alias("_n")).where("_n <> 0")
        out = out.unionByName(counted.select(*columns, F.when(F.col("_n") > 0, "left").otherwise("right").alias("side"), F.abs("_n").alias("times")))
    return out

"""A page from deep in an ordered list, without ordering the list.

``offset`` with ``limit`` sorts every row before the page.  Here the page is closed in from both sides: of a sample of keys two are taken that should lie
around it, one pass counts the rows before each, and the rows between them are what is left.  A round takes narrow columns only, shuffles nothing but the
sample and the counts, and leaves about a twentieth of the rows; once few are left they alone are sorted.
"""

from __future__ import annotations

from collections.abc import Sequence
from math import sqrt
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: keys that come to the driver in a round, about
SAMPLE = 8192
#: rows between the bounds that are sorted at once
FEW = 1 << 20


class By(NamedTuple):
    """A column of the order.  Nulls are first in ascending and last in descending order unless ``nulls_last`` says otherwise."""

    name: str
    descending: bool = False
    nulls_last: bool | None = None

    @property
    def last(self) -> bool:
        return self.descending if self.nulls_last is None else self.nulls_last

    def sorted(self) -> Column:
        c = F.col(self.name)
        if self.descending:
            return c.desc_nulls_last() if self.last else c.desc_nulls_first()
        return c.asc_nulls_last() if self.last else c.asc_nulls_first()


def told(name: str, kind: T.DataType) -> Column:
    """A column as the driver can hold it exactly; times would pass through the driver's zone."""
    if isinstance(kind, T.TimestampType):
        return F.unix_micros(name).alias(name)
    return F.col(name).cast("string").alias(name) if isinstance(kind, T.TimestampNTZType) else F.col(name)


def literal(value: object, kind: T.DataType) -> Column:
    return F.timestamp_micros(F.lit(value)) if isinstance(kind, T.TimestampType) else F.lit(value).cast(kind)


def before(order: Sequence[By], schema: T.StructType, key: Sequence[object]) -> Column:
    """Whether a row comes before ``key`` (a value for each column of the order)."""
    found, equal = F.lit(False), F.lit(True)
    for by, value in zip(order, key):
        c, kind = F.col(by.name), schema[by.name].dataType
        if value is None:
            ahead, same = (c.isNotNull() if by.last else F.lit(False)), c.isNull()
        else:
            v = literal(value, kind)
            ahead = F.coalesce(c > v if by.descending else c < v, F.lit(not by.last))
            same = c.eqNullSafe(v)
        found, equal = found | (equal & ahead), equal & same
    return found


def deep_page(rows: DataFrame, order: Sequence[By], number: int, size: int, position: str = "position", sample: int = SAMPLE, few: int = FEW) -> DataFrame:
    """Page ``number`` (from 1; below that it is 1) of ``rows``, with the place of each row in the whole list, from 1.

    order: ends in a unique key; of rows that agree in all of it any order is a right one, and they are sorted together.  A page behind the end is empty.
    """
    start = max(number - 1, 0) * size
    schema = rows.schema
    columns = [by.name for by in order]
    low, high, skipped = F.lit(True), F.lit(True), 0
    keys = rows.select(*columns)
    left = keys.count()
    if size < 1 or start >= left:
        return rows.withColumn(position, F.lit(None).cast("long")).where(F.lit(False))
    total, round_ = left, 0
    while left > few and left > 2 * size:
        inside = keys.where(low & high)
        # a key's hash decides, so rows that agree are in the sample together and once
        share = F.pmod(F.xxhash64(F.lit(round_), *columns), F.lit(1 << 30)) < F.lit(int(min(1.0, sample / left) * (1 << 30)))
        told_keys = [told(c, schema[c].dataType) for c in columns]
        picked = [tuple(r) for r in inside.where(share).distinct().orderBy(*(by.sorted() for by in order)).select(*told_keys).collect()]
        margin = 2 * sqrt(len(picked)) + 1
        first, last = len(picked) * (start - skipped) / left - margin, len(picked) * (min(start + size, total) - skipped) / left + margin
        bounds = [picked[int(first)]] if first >= 0 and picked else [None]
        bounds += [picked[int(last) + 1]] if int(last) + 1 < len(picked) else [None]
        tests = [before(order, schema, b) if b else None for b in bounds]
        counts = inside.agg(*(F.count_if(t).alias(f"n{k}") if t is not None else F.lit(-1).alias(f"n{k}") for k, t in enumerate(tests))).first()
        n_low, n_high = skipped + counts[0], skipped + counts[1]
        was, end = left, skipped + left
        if tests[1] is not None and n_high >= min(start + size, total):
            high, end = tests[1], n_high
        elif tests[1] is not None and n_high <= start:  # the page lies behind the upper key
            low, skipped = ~tests[1], n_high
        if tests[0] is not None and skipped <= n_low <= start:
            low, skipped = ~tests[0], n_low
        elif tests[0] is not None and n_low >= min(start + size, total):
            high, end = tests[0], min(end, n_low)
        left = end - skipped
        round_ += 1
        if left == was and round_ > 8:  # rows that agree in the whole order can not be told apart
            break
    place = start - skipped
    found = rows.where(low & high).orderBy(*(by.sorted() for by in order)).offset(place).limit(size)
    alone = Window.partitionBy(F.lit(1)).orderBy(*(by.sorted() for by in order))  # at most ``size`` rows
    return found.withColumn(position, F.row_number().over(alone) + F.lit(start).cast("long"))

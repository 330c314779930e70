"""Roll-ups of the warehouse: counts, status derivation, funnels, latency."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Statuses after which a document does not move (fixed values).
TERMINAL = ("INDEXED", "REVIEW_REJECTED", "CANCELLED", "PARSE_FAILED", "NORMALIZE_FAILED", "CHUNK_FAILED")


def count_if(condition: Column) -> Column:
    return F.count_if(F.coalesce(condition, F.lit(False)))


def status_counts(rows: DataFrame, key: str, status: str = "status") -> DataFrame:
    """Indexed, failed, in progress and waiting for review, by batch."""
    s = F.col(status)
    return rows.groupBy(key).agg(
        F.count("*").alias("total"),
        count_if(s == "INDEXED").alias("indexed"),
        count_if(s.endswith("_FAILED")).alias("failed"),
        count_if((s.endswith("_RUNNING") | s.endswith("_PENDING")) & (s != "REVIEW_PENDING")).alias("in_progress"),
        count_if(s == "REVIEW_PENDING").alias("pending_review"),
    )


def batch_status(status: Column) -> Column:
    """The status of a batch from the bag of its documents' statuses, first rule that holds."""

    def every(c: Column) -> Column:
        return F.bool_and(F.coalesce(c, F.lit(False)))

    def some(c: Column) -> Column:
        return F.bool_or(F.coalesce(c, F.lit(False)))

    failed, terminal = status.endswith("_FAILED"), status.isin(*TERMINAL)
    rules = [
        (F.count(status) == 0, "DRAFT"),
        (every(status == "INDEXED"), "COMPLETE"),
        (every(status == "REVIEW_REJECTED"), "FAILED"),
        (every(status == "CANCELLED"), "CANCELLED"),
        (some(status == "CANCELLED") & every(terminal), "CANCELLED"),
        (every(failed), "FAILED"),
        (every(terminal) & some(status == "INDEXED"), "PARTIALLY_COMPLETE"),
        (some(status == "INDEXED") & some(failed), "PARTIALLY_COMPLETE"),
        (some(status.startswith("CHUNK")), "CHUNKING"),
        (some(status.startswith("REVIEW")), "REVIEW_PENDING"),
        (some(status.startswith("NORMALIZE")), "NORMALIZING"),
        (some(status.startswith("PARSE")), "PARSING"),
    ]
    out = F.lit("SUBMITTED")
    for condition, name in reversed(rules):
        out = F.when(condition, name).otherwise(out)
    return out


def completion_time(old_status: Column, new_status: Column, old_time: Column, now: Column, terminal: Sequence[str]) -> Column:
    """None while open; now when the status changed; else what was there."""
    return F.when(~new_status.isin(*terminal), None).when(old_status != new_status, now).otherwise(F.coalesce(old_time, now))


def kind_label(kind: Column) -> Column:
    """A10: ``mix`` for several kinds, else ``<kind>_docs``."""
    return F.when(F.count_distinct(kind) > 1, "mix").otherwise(F.concat(F.max(kind), F.lit("_docs")))


def has_gap(numbers: Column) -> Column:
    """At least six distinct numbers from 1 or 2 on over a span of five or more, with one missing."""
    low, high = F.array_min(numbers), F.array_max(numbers)
    missing = F.size(F.array_except(F.sequence(low, high), numbers)) > 0
    return F.coalesce((F.size(F.array_distinct(numbers)) >= 6) & low.isin(1, 2) & (high - low >= 5) & missing, F.lit(False))


def latency(ms: Column) -> list[Column]:
    """Least, largest and floored mean time to first token, zeros left out, and how many are quick."""
    real = F.when(ms > 0, ms)
    return [F.min(real).alias("best"), F.max(real).alias("worst"), F.floor(F.avg(real)).alias("mean"), count_if(real <= 5000).alias("within_5s"), count_if(real <= 7000).alias("within_7s")]


def joined_in_order(text: str, order: Sequence[str], separator: str) -> Column:
    """Ordered concatenation."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*order, text))), lambda x: x[text]), separator)

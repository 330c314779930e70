"""Stateful rules over event streams, for streams and for tables.

Each rule has a batch form, a plan over ordered events, and where state is needed a streaming form with the same
results on a stream in order.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.operators import scans


def throttled(events: DataFrame, key: str, time: str, event_id: str, gap_seconds: float) -> DataFrame:
    """ST2: of each key the first event, then each that comes ``gap_seconds`` or more after the last accepted one.

    State changes only on acceptance, so this is a fold over a key's ordered times; the fold holds two longs an event.
    """
    micros = F.unix_micros(F.col(time))
    ordered = F.array_sort(F.collect_list(F.struct(micros.alias("t"), F.col(event_id).alias("id"))))
    start = F.struct(F.lit(None).cast("long").alias("last"), F.array().cast("array<bigint>").alias("taken"))

    def step(s: Column, e: Column) -> Column:
        accept = s["last"].isNull() | (e["t"] - s["last"] >= int(gap_seconds * 1_000_000))
        return F.struct(F.when(accept, e["t"]).otherwise(s["last"]).alias("last"), F.when(accept, F.concat(s["taken"], F.array(e["id"].cast("long")))).otherwise(s["taken"]).alias("taken"))

    folded = events.groupBy(key).agg(F.aggregate(ordered, start, step)["taken"].alias("taken"))
    return folded.select(key, F.explode("taken").alias(event_id))


def throttled_long(events: DataFrame, key: str, time: str, event_id: str, gap_seconds: float) -> DataFrame:
    """ST2 for keys with very many events: rows of a key come sorted and in batches, and only the last accepted time is held."""
    schema = events.select(key, F.col(event_id).cast("long").alias(event_id)).schema
    gap = int(gap_seconds * 1_000_000)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begun, now, last = False, None, None
        for batch in batches:
            keep = []
            for k, t in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
                take = not begun or now != k or last is None or t - last >= gap
                keep.append(take)
                if take:
                    begun, now, last = True, k, t
            yield batch.filter(pa.array(keep, pa.bool_())).select([0, 1])

    rows = events.select(key, F.col(event_id).cast("long").alias(event_id), F.unix_micros(F.col(time)).alias("_t"))
    return rows.repartition(key).sortWithinPartitions(key, "_t", event_id).mapInArrow(run, schema)


def throttled_stream(events: DataFrame, key: str, time: str, event_id: str, gap_seconds: float) -> DataFrame:
    """ST2 over a stream: the last accepted time of each key is its state."""
    schema = events.select(key, event_id).schema

    def run(k: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        keep = []
        for batch in batches:
            for t, i in sorted(zip(batch[time], batch[event_id])):
                now = int(t.value // 1000)
                if last is None or now - last >= gap_seconds * 1e6:
                    last = now
                    keep.append((k[0], i))
        if last is not None:
            state.update((last,))
        yield pd.DataFrame(keep, columns=[key, event_id])

    return events.groupBy(key).applyInPandasWithState(run, schema, "last long", "append", "NoTimeout")


def stable(polls: DataFrame, path: str, attempt: str, size: str, repeats: int = 2) -> DataFrame:
    """ST4: of each path the first attempt at which a size above zero has stood for ``repeats`` repeats in a row; a path with most of the polls is in many tasks."""
    rows = scans.scanned(polls.select(path, attempt, size), [path], [attempt], earlier={"_before": F.struct(F.col(size).alias("s"))})
    rows = rows.select(path, attempt, size, F.col("position").alias("_at"), F.when(~F.col(size).eqNullSafe(F.col("_before.s")), F.col("position")).alias("_change"))
    rows = scans.scanned(rows, [path], [attempt], last={"_begin": F.col("_change")})
    return rows.where((F.col(size) > 0) & (F.col("_at") - F.col("_begin") >= repeats)).groupBy(path).agg(F.min(attempt).alias("stable_at"))


def settled(events: DataFrame, path: str, time: str, event_id: str, size: str, quiet_ms: int) -> DataFrame:
    """ST4: path, size, passed_ms: each size above zero that a file kept for ``quiet_ms`` milliseconds, and when it passed; the last size of a file is kept for ever."""
    w = Window.partitionBy(path).orderBy(time, event_id)
    first = F.row_number().over(w) == 1
    changes = events.where(F.col(time).isNotNull()).withColumn("_new", first & F.col(size).isNotNull() | ~F.col(size).eqNullSafe(F.lag(size).over(w))).where("_new")
    passed = F.unix_millis(F.col(time)) + quiet_ms
    changes = changes.select(path, F.col(size).cast("long").alias("size"), passed.alias("passed_ms"), F.lead(F.unix_micros(F.col(time))).over(w).alias("_next"))
    return changes.where((F.col("size") > 0) & (F.col("_next").isNull() | (F.col("passed_ms") * 1000 <= F.col("_next")))).drop("_next")


def admitted(events: DataFrame, batch: str, time: str, event_id: str, opens: Column, closes: Column, always: Column) -> DataFrame:
    """ST8: an event is shown while its batch is open (from its opening to its closing event), or if it always is; a large batch is in many tasks."""
    rows = scans.scanned(events, [batch], [time, event_id], earlier={"_open": F.when(opens, True).when(closes, False)})
    return rows.where(F.coalesce(F.col("_open"), F.lit(False)) | opens | always).select(*events.columns)


def newest(events: DataFrame, subscriber: str, order: str, n: int) -> DataFrame:
    """ST6: what a bounded queue that drops its oldest still holds."""
    return events.withColumn("_n", F.row_number().over(Window.partitionBy(subscriber).orderBy(F.desc(order)))).where(F.col("_n") <= n).drop("_n")


def node_latency(events: DataFrame, keys: list[str], time: str) -> DataFrame:
    """ST10: first and last event of each node of a request, and the gap in milliseconds; the same plan runs on a stream."""
    return events.groupBy(*keys).agg(F.count("*").alias("events"), (F.unix_millis(F.max(time)) - F.unix_millis(F.min(time))).alias("span_ms"))


def recoverable(jobs: DataFrame, documents: DataFrame) -> DataFrame:
    """ST9: open jobs that nobody cancelled and whose document is still there; running ones start over, one attempt later."""
    open_jobs = jobs.where(F.col("status").isin("QUEUED", "RUNNING") & (F.coalesce(F.col("cancel_requested"), F.lit(0)) == 0)).join(documents.select("document_id").distinct(), "document_id", "left_semi")
    return open_jobs.withColumns({"attempt": F.col("attempt") + F.when(F.col("status") == "RUNNING", 1).otherwise(0), "status": F.lit("QUEUED")})


def tumbling(events: DataFrame, time: str, width: str, keys: list[str], late: str | None = None) -> DataFrame:
    """Extension: counts by window and key; ``late``: how long a stream waits for stragglers."""
    source = events.withWatermark(time, late) if late else events
    return source.groupBy(F.window(time, width), *keys).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), *keys, "n")


def upsert_each_batch(path: str, key: str) -> Callable[[DataFrame, int], None]:
    """SK4, ST3 for streams: a foreachBatch sink that replaces the partitions of the keys in a micro-batch.

    A micro-batch must hold all rows of its keys, as a source that gives a document's chunks together does: rows of a key from
    an earlier one go. Writing a batch again gives the same files, so a replayed batch does no harm.
    """

    def write(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(key).parquet(path)

    return write

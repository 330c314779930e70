"""ST2 for keys of any size: the throttle of one hot key spread over tasks.

Whether an event is accepted depends on the one accepted before, so a key is a chain.  Events are dealt by range of (key, time)
into cells, each sorted.  From any event the chain inside its cell is known without the rest: the last accepted event there, by pointers to the first event that is ``gap``
or more later.  A cell's distinct last events are its nodes; a node leads to the first event ``gap`` later in a further cell of the key and so
to a node of that cell.  Which nodes the chain of a key visits is found by pointer doubling over these links, as many rounds as
the key has cells in binary; then each cell knows where the chain enters it and gives the accepted events.

Which cells a key has comes to the driver for keys with more than one, at most two rows a cell, the number of cells being a parameter.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from lodestone.sources.files import written
from lodestone.streaming.rules import throttled_long

#: Events from which a key is spread over cells.
HOT = 1_000_000


def segments(codes: np.ndarray) -> Iterator[tuple[int, int]]:
    """Begin and end of each stretch of one code."""
    edges = np.r_[0, np.flatnonzero(codes[1:] != codes[:-1]) + 1, len(codes)] if len(codes) else np.zeros(1, np.int64)
    return zip(edges[:-1].tolist(), edges[1:].tolist())


class Cell:
    """The sorted events of a cell, by key."""

    def __init__(self, rows: pa.Table, gap: int):
        coded = rows.column("key").combine_chunks().dictionary_encode()
        names, codes = coded.dictionary.to_pylist(), coded.indices.fill_null(-1).to_numpy(zero_copy_only=False)
        t, ids = rows.column("t").to_numpy(), rows.column("id").to_numpy(zero_copy_only=False)
        order = np.lexsort((ids, t, codes))
        self.gap, self.t, self.order, codes = gap, t[order], order, codes[order]
        self.of = {None if codes[a] < 0 else names[codes[a]]: (a, b) for a, b in segments(codes)}

    def pointers(self, a: int, b: int) -> list[int]:
        """Of each event of a key the first that is ``gap`` later, from a; the end if none is."""
        return np.searchsorted(self.t[a:b], self.t[a:b] + self.gap).tolist()

    def leaves(self, a: int, b: int) -> np.ndarray:
        """Of each event the time of the last one that is accepted here if it is."""
        jump, times = self.pointers(a, b), self.t[a:b].tolist()
        for k in range(b - a - 1, -1, -1):
            if jump[k] < b - a:
                times[k] = times[jump[k]]
        return np.array(times, np.int64)

    def chain(self, a: int, b: int, start: int | None) -> list[int]:
        """Accepted events of a key from the first at or after ``start`` (None: its first)."""
        jump, at = self.pointers(a, b), 0 if start is None else int(np.searchsorted(self.t[a:b], start))
        out = []
        while at < b - a:
            out.append(int(self.order[a + at]))
            at = jump[at]
        return out


def throttled_spread(events: DataFrame, key: str, time: str, event_id: str, gap_seconds: float, cells: int | None = None) -> DataFrame:
    """``key`` and ``event_id`` of the accepted events, as ``throttled_long`` has them; ``cells``: ranges to deal events into."""
    gap = int(gap_seconds * 1_000_000)
    rows = events.select(F.col(key).alias("key"), F.col(event_id).cast("long").alias("id"), F.unix_micros(F.col(time)).alias("t"))
    if gap <= 0:
        return rows.select(F.col("key").alias(key), F.col("id").alias(event_id))
    order = ["key", "t", "id"]
    timed = rows.where("t IS NOT NULL")
    dealt = timed.repartitionByRange(cells, *order) if cells else timed.repartitionByRange(*order)
    dealt = written(dealt.withColumn("cell", F.spark_partition_id().cast("long")), "throttle-cells")
    ranges = written(dealt.groupBy("key", "cell").agg(F.min("t").alias("first"), F.max("t").alias("last")), "throttle-ranges")
    wide = ranges.groupBy(F.col("key").alias("k")).agg(F.count("*").alias("n")).where("n > 1")
    spans: dict = {}
    for r in ranges.join(wide, F.col("key").eqNullSafe(F.col("k"))).select("key", "cell", "first", "last").collect():  # at most two keys of a cell go on in another
        spans.setdefault(r["key"], []).append((r["cell"], r["first"], r["last"]))
    spans = {k: sorted(v) for k, v in spans.items()}
    kind, spark = dealt.schema["key"].dataType, events.sparkSession
    node = [StructField("key", kind), StructField("cell", LongType()), StructField("leave", LongType())]
    aim = [StructField("to", LongType()), StructField("from", LongType())]

    def table(rows_: list[tuple], schema: StructType) -> pa.Table:
        from pyspark.sql.pandas.types import to_arrow_schema

        target = to_arrow_schema(schema)
        return pa.table([pa.array([r[k] for r in rows_], f.type) for k, f in enumerate(target)], schema=target)

    lasts = {k: [last for _, _, last in v] for k, v in spans.items()}

    def next_cell(name, leave: int) -> int | None:
        """The first cell with an event ``gap`` later; a node's own has none."""
        at = bisect_left(lasts[name], leave + gap)
        return spans[name][at][0] if at < len(lasts[name]) else None

    nodes_schema = StructType(node + aim)

    def nodes(rows_: pa.Table) -> pa.Table:
        """Distinct last events, and the cell and time from which each leads on."""
        cell, number, out = Cell(rows_, gap), rows_.column("cell")[0].as_py(), []
        for name, (a, b) in cell.of.items():
            if name in spans:
                for leave in np.unique(cell.leaves(a, b)).tolist():
                    out.append((name, number, leave, next_cell(name, leave), leave + gap))
        return table(out, nodes_schema)

    links_schema = StructType([*node, StructField("to", LongType()), StructField("to_leave", LongType())])

    def linked(rows_: pa.Table, coming: pa.Table) -> pa.Table:
        """Of the nodes that lead into this cell, the node that they lead to."""
        out = []
        if len(rows_) and len(coming):
            cell = Cell(rows_, gap)
            ends = {name: cell.leaves(a, b) for name, (a, b) in cell.of.items() if name in spans}
            for r in coming.to_pylist():
                a, b = cell.of[r["key"]]
                at = int(np.searchsorted(cell.t[a:b], r["from"]))
                out.append((r["key"], r["cell"], r["leave"], r["to"], int(ends[r["key"]][at])))
        return table(out, links_schema)

    entries_schema = StructType([node[0], node[1], StructField("start", LongType())])
    entries = spark.createDataFrame([], entries_schema)
    if spans:
        found = written(dealt.groupBy("cell").applyInArrow(nodes, nodes_schema), "throttle-nodes")
        leading = found.where("to IS NOT NULL")
        links = written(dealt.groupBy("cell").cogroup(leading.groupBy("to")).applyInArrow(linked, links_schema), "throttle-links")
        first = {k: v[0] for k, v in spans.items()}
        begins = spark.createDataFrame([(k, c, t) for k, (c, t, _) in first.items()], entries_schema)
        visited = written(dealt.groupBy("cell").cogroup(begins.groupBy("cell")).applyInArrow(
            lambda x, y: table([(n, x.column("cell")[0].as_py(), int(cell.leaves(*cell.of[n])[0])) for cell in [Cell(x, gap)] for n in y.column("key").to_pylist()] if len(x) and len(y) else [], StructType(node)),
            StructType(node)), "throttle-visited")
        for _ in range(max(len(v) for v in spans.values()).bit_length()):
            a, b = links.alias("a"), links.alias("b")
            same = F.col("a.key").eqNullSafe(F.col("b.key")) & (F.col("a.to") == F.col("b.cell")) & (F.col("a.to_leave") == F.col("b.leave"))
            v = visited.alias("v")
            at = F.col("v.key").eqNullSafe(F.col("a.key")) & (F.col("v.cell") == F.col("a.cell")) & (F.col("v.leave") == F.col("a.leave"))
            more = v.join(a, at).select("a.key", F.col("a.to").alias("cell"), F.col("a.to_leave").alias("leave"))
            visited = written(visited.union(more).distinct(), "throttle-visited")
            links = written(a.join(b, same).select("a.key", "a.cell", "a.leave", "b.to", "b.to_leave"), "throttle-links")
        v, f = visited.alias("v"), leading.alias("f")
        at = F.col("v.key").eqNullSafe(F.col("f.key")) & (F.col("v.cell") == F.col("f.cell")) & (F.col("v.leave") == F.col("f.leave"))
        entries = begins.union(v.join(f, at).select("f.key", F.col("f.to").alias("cell"), F.col("f.from").alias("start")))

    def accepted(rows_: pa.Table, coming: pa.Table) -> pa.Table:
        taken: list[int] = []
        if len(rows_):
            cell = Cell(rows_, gap)
            starts = dict(zip(coming.column("key").to_pylist(), coming.column("start").to_pylist()))
            for name, (a, b) in cell.of.items():
                if name not in spans or name in starts:
                    taken += cell.chain(a, b, starts.get(name))
        return rows_.select(["key", "id"]).take(pa.array(taken, pa.int64()))

    out = dealt.groupBy("cell").cogroup(entries.groupBy("cell")).applyInArrow(accepted, StructType([node[0], StructField("id", LongType())]))
    untimed = rows.where("t IS NULL").select("key", "id")  # accepted, and bound to nothing
    return out.union(untimed).select(F.col("key").alias(key), F.col("id").alias(event_id))


def throttled_any(events: DataFrame, key: str, time: str, event_id: str, gap_seconds: float, hot: int = HOT, cells: int | None = None) -> DataFrame:
    """ST2: keys with more than ``hot`` events are spread over cells, the others are each in one task."""
    counts = written(events.groupBy(F.col(key).alias("_k")).agg(F.count("*").alias("_n")).where(F.col("_n") > hot), "throttle-hot")
    if not counts.count():
        return throttled_long(events, key, time, event_id, gap_seconds)
    on = F.col(key).eqNullSafe(F.col("_k"))
    spread = throttled_spread(events.join(counts, on, "left_semi"), key, time, event_id, gap_seconds, cells)
    return spread.union(throttled_long(events.join(counts, on, "left_anti"), key, time, event_id, gap_seconds))

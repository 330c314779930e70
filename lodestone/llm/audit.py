"""An audit of how filters interact, by decision diagrams over failure masks.

Each document fails some of five filters; its failure mask has a bit for each.  Of each part only the number of documents with
each mask matters, 32 numbers with the labelled good and toxic ones beside them, so parts are audited from counts and no task
sees documents.  Of a part's counts a diagram is built: a level for each filter, a node's two ways are to pass and to fail it,
equal sub-diagrams are one node, and a node's weight is the documents under it.  Filters applied in an order are the
diagram in that order of levels: what goes down the all-pass path is kept, what leaves it at a level is removed there.  All
120 orders are reached from the first by exchanging two adjacent levels, 119 times, each time rebuilding the nodes of those two.

Texts equal to that of a smaller doc_id fail E.  That comes from counts too: (digest, doc_id) pairs are counted, then, of each
digest and part, the smallest doc_id and its rows, both combined before the shuffle, so copies of one text are a row a task.

Defined cases: a null text is empty; a null source is the part ''; rows with a null doc_id never fail E, make no others
fail it and have no labels; rows that repeat a doc_id each count, and do not fail E through each other; of labels that
repeat a doc_id one that says good, or toxic, is enough; of other columns none is read; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LETTERS = "ABCDE"
CUT = r"[\x20\x09-\x0D]+"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
STEPS = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"


def content_mask(text: Column) -> Column:
    """The bits of A to D."""
    words = F.array_remove(F.split(text, CUT), "")
    n = F.size(words)
    fails = [
        n < 200,
        F.size(F.array_distinct(words)) * 100 < n * 50,
        (F.length(text) - F.length(F.translate(text, CAPITALS, ""))) * 100 > F.length(text) * 2,
        text.rlike(r"[#$%&*|]"),
    ]
    return reduce(Column.__add__, (F.when(f, 1 << k).otherwise(0) for k, f in enumerate(fails)))


def mask_counts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, mask, n, good, toxic: the documents of each part with each failure mask."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"),
        F.unhex(F.sha2(text.cast("binary"), 256)).alias("digest"), content_mask(text).alias("mask"),
    )
    judged = labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("labelled")).agg(
        F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic")
    )
    # null ids have no partner; a hash of the text spreads them over the tasks
    spread = F.when(F.col("doc_id").isNull(), F.xxhash64("digest")).otherwise(F.lit(0))
    judged = judged.withColumn("none", F.lit(0).cast("long"))
    rows = rows.withColumn("spread", spread.cast("long")).join(judged, (F.col("doc_id") == F.col("labelled")) & (F.col("spread") == F.col("none")), "left")
    rows = rows.select("digest", "mask", "part", "doc_id", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("good", "toxic")))
    kind = ["digest", "mask", "part", "good", "toxic"]
    ids = rows.groupBy(*kind, "doc_id").agg(F.count("*").alias("n"))
    own = F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "n"))
    kinds = ids.groupBy(*kind).agg(F.min(own).alias("first"), F.sum("n").alias("n"), F.sum(F.when(F.col("doc_id").isNull(), F.col("n")).otherwise(0)).alias("anonymous"))
    smallest = F.min("first.doc_id").over(Window.partitionBy("digest"))
    passes = F.col("anonymous") + F.when(F.col("first.doc_id") == smallest, F.col("first.n")).otherwise(0)
    kinds = kinds.select("part", "mask", "good", "toxic", "n", passes.alias("passes"))
    both = F.explode(F.array(F.struct("mask", F.col("passes").alias("m")), F.struct((F.col("mask") + 16).alias("mask"), (F.col("n") - F.col("passes")).alias("m")))).alias("x")
    split = kinds.select("part", "good", "toxic", both).select("part", "x.mask", F.col("x.m").alias("m"), "good", "toxic")
    return split.groupBy("part", "mask").agg(F.sum("m").alias("n"), F.sum(F.col("m") * F.col("good")).alias("good"), F.sum(F.col("m") * F.col("toxic")).alias("toxic"))


class Diagram:
    """A decision diagram whose ends are counts; every way from the root has a node of each level, equal nodes are one."""

    def __init__(self, counts: dict[int, tuple[int, ...]], letters: str = LETTERS):
        self.order = list(letters)
        self.nodes: dict[tuple, int] = {}
        self.ways: list[tuple[int, int] | None] = []
        self.weight: list[tuple[int, ...]] = []
        width = len(next(iter(counts.values()))) if counts else 1
        level = [self.end(counts.get(mask, (0,) * width)) for mask in range(1 << len(letters))]
        for _ in letters:  # the last letter has the highest bit: halves of the list differ in it, and it is the lowest level
            half = len(level) // 2
            level = [self.node(*pair) for pair in zip(level[:half], level[half:])]
        self.root = level[0]

    def end(self, counts: tuple[int, ...]) -> int:
        return self.known(("end", counts), None, counts)

    def node(self, passes: int, fails: int) -> int:
        return self.known((passes, fails), (passes, fails), tuple(a + b for a, b in zip(self.weight[passes], self.weight[fails])))

    def known(self, key: tuple, ways: tuple[int, int] | None, weight: tuple[int, ...]) -> int:
        if key not in self.nodes:
            self.nodes[key] = len(self.ways)
            self.ways.append(ways)
            self.weight.append(weight)
        return self.nodes[key]

    def exchange(self, level: int) -> None:
        """The filters of ``level`` and of the one below it change places."""
        done: dict[tuple[int, int], int] = {}

        def rebuilt(node: int, depth: int) -> int:
            if (node, depth) not in done:
                p, f = self.ways[node]
                if depth < level:
                    done[node, depth] = self.node(rebuilt(p, depth + 1), rebuilt(f, depth + 1))
                else:
                    (pp, pf), (fp, ff) = self.ways[p], self.ways[f]
                    done[node, depth] = self.node(self.node(pp, fp), self.node(pf, ff))
            return done[node, depth]

        self.root = rebuilt(self.root, 0)
        self.order[level], self.order[level + 1] = self.order[level + 1], self.order[level]

    def all_pass(self) -> Iterator[tuple[str, tuple[int, ...], tuple[int, ...]]]:
        """Filter, counts kept and counts removed of each step of the present order."""
        node = self.root
        for letter in self.order:
            node, fails = self.ways[node]
            yield letter, self.weight[node], self.weight[fails]


def exchanges(n: int) -> list[int]:
    """Levels to exchange so that all orders of n are met once: the last moves through each order of the others, to and fro."""
    if n < 2:
        return []
    out, down = [], True
    for k in [None, *exchanges(n - 1)]:
        if k is not None:
            out.append(k + (not down))  # the last of the first order stands in front of the others, or behind them
        out += range(n - 2, -1, -1) if down else range(n - 1)
        down = not down
    return out


def audited(counts: dict[int, tuple[int, int, int]], letters: str = LETTERS) -> list[tuple]:
    """filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley; every order, step by step."""
    diagram = Diagram(counts, letters)
    zero = (0, 0, 0)
    bit = {c: 1 << k for k, c in enumerate(letters)}
    fails = {c: sum(v[0] for m, v in counts.items() if m & bit[c]) for c in letters}
    alone = {c: counts.get(bit[c], zero)[0] for c in letters}
    rows, shapley = [], dict.fromkeys(letters, 0)
    for k in [None, *exchanges(len(letters))]:
        if k is not None:
            diagram.exchange(k)
        name = "".join(diagram.order)
        for step, (c, kept, removed) in enumerate(diagram.all_pass(), 1):
            shapley[c] += removed[0]
            rows.append((name, step, kept[0], removed[0], fails[c] - removed[0], alone[c], removed[1], removed[2], c))
    return [(*r[:-1], shapley[r[-1]]) for r in rows]


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The contract's rows: of each part, order of the filters and step, what is kept, removed and lost."""

    def one(part: pd.DataFrame) -> pd.DataFrame:
        counts = {int(m): (int(n), int(g), int(t)) for m, n, g, t in zip(part["mask"], part["n"], part["good"], part["toxic"])}
        return pd.DataFrame([(part["part"].iloc[0], *r) for r in audited(counts)], columns=[c.split()[0] for c in STEPS.split(", ")])

    return mask_counts(docs, labels).groupBy("part").applyInPandas(one, STEPS)

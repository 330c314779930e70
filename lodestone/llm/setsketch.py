"""Near-duplicates by SetSketch registers.

A sketch has ``REGISTERS`` values K = floor(1 - log_b(h)), cut to [0, 65535], of the smallest h that any
element sends to the register.  Elements send points of a Poisson process of rate REGISTERS * A, each to a
register drawn at random, so a register's minimum over n elements is exponential of rate n * A, independently of the
others; points beyond the level that all registers are sure to go below need not be drawn, which makes
a sketch cost a few thousand draws however long the text.  Sketches merge by the larger register.

1. Documents with equal shingle sets are one class.
2. ``BANDS`` bands of ``ROWS`` registers send classes to buckets.  Small buckets give all their pairs; larger ones
   pair every member with a few pivots, so a group of copies is a star and not a square.
3. A pair is estimated jointly, by the likelihood of which sketch has the larger register given the two known set
   sizes; only pairs for which the threshold is out of reach by a wide margin are dropped.
4. What is left is verified on the full shingle sets, in exact integers.
5. Links give components by alternating large-star and small-star steps.  In each large bucket, members that
   are outside of the component that most belong to are then held against every member outside of theirs, block by
   block: on the registers first, and pairs that the estimate does not rule out on the full sets, likeliest first,
   as long as they are not joined yet.  So pivots lose no link.

With 40 bands of 5, a pair at the threshold of 0.8 shares no bucket with a probability of about 1e-7.

Defined cases: a null or empty text, or one without words, has an empty set and no links; fewer words than a
shingle are one shingle, the whole sequence; rows with one doc_id are one document, linked by any of their
texts; a null doc_id has no links, a null component, and is kept; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm import chunks as ch
from lodestone.llm.common import Scratch, drop_path, materialize, materialize_with_path
from lodestone.llm.substrings import Words

REGISTERS, BANDS, ROWS = 200, 40, 5
BASE, RATE, TOP = 1.001, 20.0, 65535
SMALL, PIVOTS = 16, 2
#: A pair is dropped before verification only if its log-likelihood at the threshold is lower by this (4.5 sigma).
MARGIN = 10.0
#: Members of a bucket that meet in one task.
BLOCK = 1024
SKETCH = "doc_id long, n_shingles long, set_a long, set_b long, registers binary"
U = np.uint64


class Texts:
    """A column of texts with A-Z in lower case, as blocks of bytes."""

    def __init__(self, column: pa.Array):
        text = column.fill_null("").cast(pa.large_binary())
        offsets = np.frombuffer(text.buffers()[1], np.int64, len(text) + 1, text.offset * 8)
        self.data = np.frombuffer(text.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]].copy()
        self.data[(self.data >= 65) & (self.data <= 90)] += 32
        self.sizes = np.diff(offsets)
        self.ends = np.cumsum(self.sizes)

    blocks = ch.Chunk.blocks


def shingle_sets(column: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text, one text after the other, and where each text's begin."""
    words = Words(Texts(column))
    z, at = words.spans(size)
    doc = words.doc[at]
    short = np.flatnonzero((words.count > 0) & (words.count < size))
    begin = np.cumsum(words.count) - words.count
    whole = []
    for d in short:  # fewer words than a shingle: all of them as one
        h = U(0x2545F4914F6CDD1D)
        for w in words.hash[begin[d] : begin[d] + words.count[d]]:
            h = ch.mixed(np.array([h ^ w], U))[0]
        whole.append(h)
    z, doc = np.concatenate([z, np.array(whole, U)]), np.concatenate([doc, short])
    order = np.lexsort((z, doc))
    z, doc = z[order], doc[order]
    new = np.r_[True, (z[1:] != z[:-1]) | (doc[1:] != doc[:-1])] if len(z) else np.zeros(0, np.bool_)
    z, doc = z[new], doc[new]
    return z, np.searchsorted(doc, np.arange(len(column) + 1))


def sketches(z: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """Registers of each set, a row a set; sets must not be empty."""
    n = np.diff(begin)
    out = np.full((len(n), REGISTERS), -1, np.int32)
    todo, level = np.arange(len(n)), 10.0
    while len(todo):
        limit = level / (RATE * n[todo])
        slot = np.repeat(np.arange(len(todo)), n[todo])
        e = np.concatenate([z[begin[d] : begin[d + 1]] for d in todo])
        x, flat = np.zeros(len(e)), out[todo].ravel()
        step = 0
        while len(e):
            step += 1
            r = ch.mixed(e + U(step * 0x9E3779B97F4A7C15 & (1 << 64) - 1))
            x = x - np.log(((r >> U(11)).astype(np.float64) + 0.5) * 2.0**-53) / (REGISTERS * RATE)
            go = x < limit[slot]
            e, x, slot, r = e[go], x[go], slot[go], r[go]
            register = (ch.mixed(r ^ U(0xD1B54A32D192ED03)) % U(REGISTERS)).astype(np.int64)
            value = np.clip(np.floor(1 - np.log(x) / np.log(BASE)), 0, TOP).astype(np.int32)
            np.maximum.at(flat, slot * REGISTERS + register, value)
        rows = flat.reshape(-1, REGISTERS)
        full = (rows >= 0).all(1)
        out[todo[full]] = rows[full]
        todo, level = todo[~full], level * 4
    return out.astype(np.uint16)


def sketch(docs: DataFrame, size: int) -> DataFrame:
    """doc_id, n_shingles, a 128-bit hash of the set, registers (null for empty sets)."""

    def run(batches):
        for batch in batches:
            for at in range(0, len(batch), 256):
                part = batch.slice(at, 256)
                z, begin = shingle_sets(part.column(1), size)
                n = np.diff(begin)
                full = np.flatnonzero(n)
                a, b = (np.r_[U(0), np.cumsum(ch.mixed(z ^ U(s)), dtype=U)] for s in (0x8BADF00D, 0x1CEB00DA))
                a, b = ((s[begin[1:]] - s[begin[:-1]]).view(np.int64) for s in (a, b))
                registers: list = [None] * len(part)
                if len(full):
                    for d, row in zip(full, sketches(z, np.r_[begin[full], begin[-1]])):
                        registers[d] = row.astype(">u2").tobytes()
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n.astype(np.int64)), pa.array(a), pa.array(b), pa.array(registers, pa.binary())], names=[c.split()[0] for c in SKETCH.split(", ")])

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text")).mapInArrow(run, SKETCH)


def likely(k_a: np.ndarray, k_b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Joint maximum-likelihood Jaccard of pairs of sketches, and whether the threshold is within the margin."""
    more, less = (k_a > k_b).sum(1)[:, None], (k_a < k_b).sum(1)[:, None]
    same = REGISTERS - more - less
    u = (n_a / (n_a + n_b))[:, None]
    v = 1 - u
    j = np.linspace(0, 1, 201)[None, :] * np.minimum(u / v, v / u)

    def share(x: np.ndarray) -> np.ndarray:
        return -np.log(np.maximum(1 - x * (BASE - 1) / BASE, 1e-300)) / np.log(BASE)

    up, down = np.maximum(share(u - v * j), 1e-12), np.maximum(share(v - u * j), 1e-12)
    fit = more * np.log(up) + less * np.log(down) + same * np.log(np.maximum(1 - up - down, 1e-12))
    best = fit.argmax(1)
    reach = np.where(j >= threshold - 1e-9, fit, -np.inf).max(1)
    return np.take_along_axis(j, best[:, None], 1)[:, 0], reach >= fit.max(1) - MARGIN


def estimated(pairs: DataFrame, classes: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) whose joint estimate lets the threshold stand."""
    side = [classes.select(F.col("rep").alias(x), F.col("n").alias(f"n_{x}"), F.col("registers").alias(f"r_{x}")) for x in "ab"]

    def run(batches):
        for batch in batches:
            if len(batch):
                k = [np.frombuffer(b"".join(batch.column(f"r_{x}").to_pylist()), ">u2").reshape(-1, REGISTERS) for x in "ab"]
                n = [batch.column(f"n_{x}").to_numpy().astype(np.float64) for x in "ab"]
                keep = np.concatenate([likely(k[0][s], k[1][s], n[0][s], n[1][s], threshold)[1] for s in (slice(i, i + 2000) for i in range(0, len(batch), 2000))])
                yield batch.select(["a", "b"]).filter(pa.array(keep))

    return pairs.join(side[0], "a").join(side[1], "b").select("a", "b", "n_a", "n_b", "r_a", "r_b").mapInArrow(run, "a long, b long")


def shingled(docs: DataFrame, needed: DataFrame, size: int, scratch: Scratch) -> DataFrame:
    """d, shingles (packed sets) of the documents ``needed`` (d). Texts move once, however many are needed."""
    texts = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))
    found = texts.join(needed.hint("merge"), texts["doc_id"] == needed["d"], "left_semi")

    def sets(batches):
        for batch in batches:
            for at in range(0, len(batch), 256):
                part = batch.slice(at, 256)
                z, begin = shingle_sets(part.column(1), size)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([ch.pack_sorted(z[a:b]) for a, b in zip(begin[:-1], begin[1:])], pa.binary())], names=["d", "shingles"])

    return scratch.keep(found.mapInArrow(sets, "d long, shingles binary"), "shingles")


def linked(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """Whether sorted sets have 100 * shared >= percent * united."""
    shared = int(ch.member(y, x).sum()) if len(x) >= len(y) else int(ch.member(x, y).sum())
    return 100 * shared >= percent * (len(x) + len(y) - shared)


def verified(pairs: DataFrame, given: DataFrame, percent: int) -> DataFrame:
    """The pairs that are linked, counted on full sets."""

    def run(batches):
        for batch in batches:
            keep, last, x = [], None, None
            for a, b in zip(batch.column("s_a"), batch.column("s_b")):
                a = a.as_py()
                if a != last:
                    last, x = a, ch.unpack_sorted(a)
                keep.append(linked(x, ch.unpack_sorted(b.as_py()), percent))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    side = [given.select(F.col("d").alias(x), F.col("shingles").alias(f"s_{x}")) for x in "ab"]
    return pairs.join(side[0], "a").join(side[1], "b").select("a", "b", "s_a", "s_b").mapInArrow(run, "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """node, component (its smallest node) of every node in ``links`` (a, b), by large-star and small-star steps."""
    edges, old = materialize_with_path(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    state = None
    while True:  # the number of rounds is logarithmic in the nodes
        # large star: every larger neighbour of a node, to the node's smallest neighbour
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("m", "a"))
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        # small star: a node's smaller neighbours and itself, to the smallest of them
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("e")).select("e.a", "e.b")
        edges, path = materialize_with_path(small.where("a <> b").distinct(), "edges")
        drop_path(edges.sparkSession, old)
        old = path
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == state:
            break
        state = now
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())


def side_of(rows: pa.Table, name: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Registers, set sizes, components and representatives of a block's rows."""
    registers = np.frombuffer(b"".join(rows.column("registers").to_pylist()), ">u2").astype(np.uint16).reshape(-1, REGISTERS)
    return registers, *(rows.column(c).to_numpy() for c in ("n", "component", name))


def likely_pairs(u: tuple, m: tuple, band: int, threshold: float):
    """For each row of ``u``: its number, the rows of ``m`` that it may be linked with, and the registers they share.

    Only of other components, and only in the first band that a pair shares, so that a pair is met in one bucket.
    """
    (k_u, n_u, c_u, _), (k_m, n_m, c_m, _) = u, m
    least_same = REGISTERS * threshold - 5 * np.sqrt(REGISTERS * threshold * (1 - threshold))
    for k in range(len(k_u)):
        at = np.flatnonzero((c_m != c_u[k]) & (np.minimum(n_m, n_u[k]) >= threshold * np.maximum(n_m, n_u[k])))
        same = k_m[at] == k_u[k]
        here = (same.reshape(len(at), BANDS, ROWS).all(2).argmax(1) == band) & (same.sum(1) >= least_same)
        at, same = at[here], same[here].sum(1)
        if len(at):
            fine = likely(k_m[at], np.repeat(k_u[k : k + 1], len(at), 0), n_m[at].astype(float), np.full(len(at), float(n_u[k])), threshold)[1]
            at, same = at[fine], same[fine]
        yield k, at, same


def apart(large: DataFrame, found: DataFrame, classes: DataFrame, given: DataFrame, percent: int, scratch: Scratch) -> DataFrame | None:
    """Links (a, b) that join components which share a large bucket: of members outside of their bucket's main component with all others."""
    threshold = percent / 100
    placed = scratch.keep(large.join(found, large["rep"] == found["node"], "left").select("bucket", "band", "rep", "members", F.coalesce("component", "rep").alias("component")), "placed")
    tally = placed.groupBy("bucket", "component").count().groupBy("bucket").agg(F.max(F.struct("count", "component")).alias("most"), F.count("*").alias("kinds"), F.sum("count").alias("all")).where("kinds > 1")
    tally = tally.select("bucket", F.col("most.component").alias("main"), (F.col("all") - F.col("most.count")).alias("n_outside"))
    known = scratch.keep(placed.join(tally, "bucket").join(classes.select("rep", "n", "registers"), "rep"), "apart")
    if not known.limit(1).count():
        return None
    rows, cols = F.ceil(F.col("n_outside") / BLOCK).cast("int"), F.ceil(F.col("members") / BLOCK).cast("int")
    common = ["bucket", "band", "rep", "component", "n", "registers"]
    row, col = F.pmod(F.xxhash64("rep"), rows).cast("int"), F.pmod(F.xxhash64("rep", F.lit(1)), cols).cast("int")
    outside = known.where("component <> main").select(*common, row.alias("row"), F.explode(F.sequence(F.lit(0), cols - 1)).alias("col"))
    every = known.select(*common, col.alias("col"), F.explode(F.sequence(F.lit(0), rows - 1)).alias("row"))
    block = ["bucket", "row", "col"]
    kinds = "bucket long, row int, col int, band int, d long, component long, left boolean, right boolean"
    names = [k.split()[0] for k in kinds.split(", ")]

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        """Who has a likely pair in the block: the pairs themselves stay here."""
        if not len(left) or not len(right):
            return pa.table({"bucket": pa.array([], pa.int64()), "row": pa.array([], pa.int32()), "col": pa.array([], pa.int32()), "band": pa.array([], pa.int32()), "d": pa.array([], pa.int64()), "component": pa.array([], pa.int64()), "left": pa.array([], pa.bool_()), "right": pa.array([], pa.bool_())})
        u, m = (side_of(t, "rep") for t in (left, right))
        hit_u, hit_m = np.zeros(len(u[3]), np.bool_), np.zeros(len(m[3]), np.bool_)
        for k, at, _ in likely_pairs(u, m, left.column("band")[0].as_py(), threshold):
            hit_u[k] = len(at) > 0
            hit_m[at] = True
        d, component = np.concatenate([u[3][hit_u], m[3][hit_m]]), np.concatenate([u[2][hit_u], m[2][hit_m]])
        d, at, inverse = np.unique(d, return_index=True, return_inverse=True)
        flags = np.zeros((2, len(d)), np.bool_)
        flags[0, inverse[: hit_u.sum()]] = True
        flags[1, inverse[hit_u.sum() :]] = True
        head = [pa.array(np.full(len(d), left.column(c)[0].as_py()), t) for c, t in (("bucket", pa.int64()), ("row", pa.int32()), ("col", pa.int32()), ("band", pa.int32()))]
        return pa.table([*head, pa.array(d), pa.array(component[at]), pa.array(flags[0]), pa.array(flags[1])], names=names)

    met = scratch.keep(outside.groupBy(*block).cogroup(every.groupBy(*block)).applyInArrow(meet, kinds), "met")
    about = classes.select(F.col("rep").alias("d"), "n", "registers")
    full = met.join(given, "d").join(about, "d").select(*names, "n", "registers", "shingles")

    def confirm(rows: pa.Table) -> pa.Table:
        """The same pairs again, on full sets, likeliest first; components that are joined need no other link."""
        sides = [rows.filter(rows.column(c)) for c in ("left", "right")]
        u, m = (side_of(t, "d") for t in sides)
        first, second, alike = ([np.zeros(0, np.int64)] for _ in range(3))
        for k, at, same in likely_pairs(u, m, rows.column("band")[0].as_py(), threshold):
            first.append(np.full(len(at), k))
            second.append(at)
            alike.append(same)
        first, second, alike = (np.concatenate(x) for x in (first, second, alike))
        order = np.lexsort((m[3][second], u[3][first], -alike))
        packed, open_, up, links = [t.column("shingles") for t in sides], {}, {}, []

        def of(side: int, k: int) -> np.ndarray:
            if (side, k) not in open_:
                if len(open_) >= BLOCK:
                    open_.clear()
                open_[side, k] = ch.unpack_sorted(packed[side][k].as_py())
            return open_[side, k]

        def top(c: int) -> int:
            while c in up:
                c = up[c]
            return c

        for k, j in zip(first[order].tolist(), second[order].tolist()):
            a, b = top(int(u[2][k])), top(int(m[2][j]))
            if a != b and linked(of(0, k), of(1, j), percent):
                up[max(a, b)] = min(a, b)
                links.append((int(u[3][k]), int(m[3][j])))
        return pa.table([pa.array([f(x) for x in links], pa.int64()) for f in (min, max)], names=["a", "b"])

    return full.groupBy(*block).applyInArrow(confirm, "a long, b long")


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row; ``size`` words a shingle, ``percent`` of Jaccard."""
    threshold, scratch = percent / 100, Scratch()
    rows = scratch.keep(sketch(docs, size), "sketches")
    full = rows.where("n_shingles > 0 AND doc_id IS NOT NULL")
    classes = full.groupBy("set_a", "set_b").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n"), F.first("registers").alias("registers"))
    classes = scratch.keep(classes, "classes")
    band = F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda i: F.xxhash64(i, F.substring("registers", i * (2 * ROWS) + 1, F.lit(2 * ROWS))))
    banded = classes.select("rep", F.posexplode(band).alias("band", "bucket"))
    pivots = [F.min(F.struct(F.xxhash64("rep", F.lit(k)).alias("h"), "rep"))["rep"] for k in range(PIVOTS)]
    counts = banded.groupBy("bucket").agg(F.count("*").alias("members"), F.min("rep").alias("first_rep"), F.max("rep").alias("last_rep")).where("first_rep < last_rep")
    members = scratch.keep(banded.join(counts.select("bucket", "members"), "bucket"), "buckets")  # bucket, rep, band, members
    all_classes = classes
    classes = scratch.keep(classes.join(members.select("rep").distinct(), "rep", "left_semi"), "crowd")  # those that meet another
    small, large = members.where(F.col("members") <= SMALL), members.where(F.col("members") > SMALL)
    left, right = small.select("bucket", F.col("rep").alias("a")), small.select("bucket", F.col("rep").alias("b"))
    squares = left.join(right, "bucket").where("a < b").select("a", "b")
    chosen = large.groupBy("bucket").agg(F.array_distinct(F.array(*pivots)).alias("pivots"))
    stars = large.join(chosen, "bucket").select("rep", F.explode("pivots").alias("p")).select(F.least("rep", "p").alias("a"), F.greatest("rep", "p").alias("b")).where("a < b")

    pairs = scratch.keep(estimated(squares.union(stars).distinct(), classes, threshold), "pairs")
    needed = pairs.select(F.explode(F.array("a", "b")).alias("d")).union(large.select("rep")).distinct()
    given = shingled(docs, needed, size, scratch)
    links = scratch.keep(verified(pairs, given, percent), "links")
    found = scratch.keep(components(links), "components")
    more = apart(large, found, classes, given, percent, scratch)
    if more is not None:
        found = scratch.keep(components(links.union(scratch.keep(more, "links"))), "components")
    labels = all_classes.join(found, all_classes["rep"] == found["node"], "left").select("set_a", "set_b", F.coalesce("component", "rep").alias("component"))
    joined = rows.join(labels.withColumnsRenamed({"set_a": "x", "set_b": "y"}), (rows["set_a"] == F.col("x")) & (rows["set_b"] == F.col("y")) & (rows["n_shingles"] > 0) & rows["doc_id"].isNotNull(), "left")
    component = F.coalesce("component", "doc_id")
    out = joined.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"))
    out = materialize(out, "near")  # a few numbers a row; all that it was made from can go
    scratch.drop()
    return out

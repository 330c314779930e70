"""Mixing sources to target weights, with DataFrame functions only.

1. Each source's target: a share by weight of ``ratio`` times all words, stopped at ``cap`` times its
   size, the excess reshared.  Ordered by size over weight, the shares that stop are a prefix, so
   running sums over the table of sources give the final level at once.
2. A source's documents fall by hash into blocks of about ``block_words`` words.  Whole passes take every
   block; the last pass takes blocks in a permuted order up to the target, and of the last block as many
   documents, and words of the last document, as are wanting.  So a source's words come to its rounded target.
3. The blocks that sources give are split among the output shards down a binary tree.  A node draws one half of its blocks
   without replacement, whatever their sources, so what it takes of each source's quota is multivariate
   hypergeometric, exactly: all blocks are ranked by a hash, and the left half of a node has its lower ranks.  A leaf's
   quotas are the blocks of each source that reach it, disjoint from all other shards', and a shard orders its documents
   by a hash.

Ranks and running sums over many rows go in two steps (``running``): sums over cells of a hash, then within a cell, so that
no task holds all blocks, nor all of one source.  Sources are put in order by range likewise (``ordered``).  Windows over a whole
table are over cells only: the ranges of the sources, a thousandth of the blocks.  All choices come from hashes: reruns agree.

Defined cases: a null text has no words; a null source is a source, last in order; documents without
words have target shares only through their source; repeated rows are each mixed; further columns pass through whatever
their names; no rows give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.common import WORD, carried, materialize, uncarried, word_count

WEIGHTS = (3, 1, 2)
BLOCK_WORDS = 1 << 13
LEVELS = 6  # 64 shards
#: Rows that a cell of ``running`` has, about.
CELL_ROWS = 1024


def ordered(rows: DataFrame, order: list[Column], *values: str) -> DataFrame:
    """``rows`` with ``position`` (from 1) in a whole ``order`` without ties, and ``before_<value>``, the sum of each value over the rows ahead.

    Rows are dealt by range, so that a cell is a run of the order; only a row a cell meets in one task.
    """
    cells = materialize(rows.repartitionByRange(*order).withColumn("cell", F.spark_partition_id()), "mix-order")
    cells = cells.withColumn("one", F.lit(1).cast("long"))
    names = {"one": "position", **{v: f"before_{v}" for v in values}}
    earlier = Window.orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    sums = cells.groupBy("cell").agg(*(F.sum(v).alias(f"in_{v}") for v in names))
    sums = sums.select("cell", *(F.coalesce(F.sum(f"in_{v}").over(earlier), F.lit(0)).alias(f"ahead_{v}") for v in names))
    within = Window.partitionBy("cell").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    found = cells.join(sums, "cell")
    found = found.withColumns({n: F.col(f"ahead_{v}") + F.coalesce(F.sum(v).over(within), F.lit(0)) for v, n in names.items()})
    return found.withColumn("position", F.col("position") + 1).select(*rows.columns, *names.values())


def source_targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, ratio: float = 1.5, cap: int = 2) -> DataFrame:
    """source, sid (its place, from 1), source_size, target of each source."""
    by_name, last = [F.col("source").asc_nulls_last()], F.col("source").asc_nulls_last()
    sources = ordered(sized.groupBy("source").agg(F.sum("size").alias("source_size")), by_name).withColumnRenamed("position", "sid")
    weight = F.element_at(F.array(*map(F.lit, weights)), ((F.col("sid") - 1) % len(weights) + 1).cast("int"))
    sources = sources.withColumns({"weight": weight.cast("long"), "most": F.col("source_size") * cap})
    sources = ordered(sources.withColumn("fill", F.col("most") / F.col("weight")), [F.col("fill").asc(), last], "most", "weight")
    want, all_weight = sources.agg(F.sum("source_size") * F.lit(ratio), F.sum("weight")).first()
    level = (F.lit(want).cast("double") - F.col("before_most")) / (F.lit(all_weight).cast("long") - F.col("before_weight"))
    sources = sources.withColumn("level", level)
    # of the sources that do not stop, the first: of several with one fill only its level leaves all of them unstopped
    final = sources.where("fill >= level").agg(F.min_by("level", "position")).first()[0]
    target = F.least(F.col("most").cast("double"), F.coalesce(F.lit(final).cast("double") * F.col("weight"), F.col("most").cast("double")))
    return sources.select("source", "sid", "source_size", target.alias("target"))


def positive(*parts: Column | str) -> Column:
    """A hash of 63 bits."""
    return F.shiftrightunsigned(F.xxhash64(*parts), 1)


def running(rows: DataFrame, group: list[str], order: str, n_rows: Column, value: str, name: str) -> DataFrame:
    """``rows`` with the sum of ``value`` over the rows before each in its ``group``, by ``order`` (a 63-bit hash, then all columns).

    n_rows: about how many rows the group has, the same for all of its rows.
    """
    cells = F.greatest(F.lit(1), F.ceil(n_rows / CELL_ROWS)).cast("long")
    rows = rows.withColumn("cell", F.floor(F.shiftrightunsigned(order, 32) * cells / float(1 << 31)).cast("long"))
    sums = rows.groupBy(*group, "cell").agg(F.sum(value).alias("in_cell"))
    earlier = Window.partitionBy(*group).orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*group, "cell", F.coalesce(F.sum("in_cell").over(earlier), F.lit(0)).alias("ahead"))
    within = Window.partitionBy(*group, "cell").orderBy(order, *(c for c in rows.columns if c not in (*group, order, "cell"))).rowsBetween(Window.unboundedPreceding, -1)
    return rows.join(sums, [*group, "cell"]).withColumn(name, F.col("ahead") + F.coalesce(F.sum(value).over(within), F.lit(0))).drop("cell", "ahead")


def deal(blocks: DataFrame, n_blocks: int, levels: int = LEVELS, seed: int = 0) -> DataFrame:
    """``blocks`` (sid, block, pass) with ``shard``, the leaf of the tree that each is drawn for.

    At each level the lower half of a node's ranks goes left, with the extra block if their number is odd.
    """
    rows = running(blocks.withColumns({"ticket": positive("sid", "block", "pass", F.lit(seed + 3)), "one": F.lit(1)}), [], "ticket", F.lit(n_blocks), "one", "rank")
    rows = rows.withColumns({"among": F.lit(n_blocks).cast("long"), "shard": F.lit(0)})
    for _ in range(levels):
        left = F.floor((F.col("among") + 1) / 2)
        goes = F.col("rank") < left
        rows = rows.withColumns({"rank": F.when(goes, F.col("rank")).otherwise(F.col("rank") - left), "among": F.when(goes, left).otherwise(F.col("among") - left), "shard": F.col("shard") * 2 + F.when(goes, 0).otherwise(1)})
    return rows.drop("ticket", "one", "rank", "among")


def plan(docs: DataFrame, seed: int = 0, block_words: int = BLOCK_WORDS, levels: int = LEVELS) -> DataFrame:
    """doc_id, size, source_size, target, taken, source, text_hash, passes, extra, shards: of each document, what the mix takes and where.

    ``shards`` has the shard of each time that the document is taken, the last of them perhaps in part.
    """
    text = F.col("text").cast("string")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), word_count(text).alias("size"), F.xxhash64(text).alias("text_hash"))
    rows = materialize(rows, "mix-sizes")
    sources = source_targets(rows)
    whole = F.when(F.col("source_size") > 0, F.floor(F.round("target") / F.col("source_size"))).otherwise(0).cast("long")
    sources = sources.withColumns({"passes": whole, "n_blocks": F.greatest(F.lit(1), F.ceil(F.col("source_size") / block_words))})
    sources = materialize(sources.withColumn("rest", F.round("target").cast("long") - F.col("passes") * F.col("source_size")), "mix-sources")
    rows = rows.join(sources.withColumnRenamed("source", "s"), rows.source.eqNullSafe(F.col("s"))).drop("s")
    rows = materialize(rows.withColumn("block", F.pmod(F.xxhash64("doc_id", "size", "text_hash", F.lit(seed)), F.col("n_blocks"))), "mix-rows")

    table = rows.groupBy("sid", "block").agg(F.sum("size").alias("words"), F.first("passes").alias("passes"), F.first("rest").alias("rest"), F.first("n_blocks").alias("n_blocks"))
    table = running(table.withColumn("order", positive("sid", "block", F.lit(seed + 1))), ["sid"], "order", F.col("n_blocks"), "words", "before")
    table = table.withColumn("part", F.greatest(F.lit(0), F.least(F.col("words"), F.col("rest") - F.col("before"))))
    copies = table.select("sid", "block", "part", "passes", F.explode(F.sequence(F.lit(0).cast("long"), F.col("passes"))).alias("pass"))
    copies = materialize(copies.where((F.col("pass") < F.col("passes")) | (F.col("part") > 0)), "mix-blocks")
    dealt = deal(copies.select("sid", "block", "pass", "part"), copies.count(), levels, seed)
    dealt = dealt.groupBy("sid", "block").agg(F.max("part").alias("part"), F.transform(F.array_sort(F.collect_list(F.struct("pass", "shard"))), lambda x: x["shard"]).alias("block_shards"))

    joined = rows.join(dealt, ["sid", "block"], "left")
    within = Window.partitionBy("sid", "block").orderBy(F.xxhash64("doc_id", "text_hash", F.lit(seed + 2)), "doc_id", "size", "text_hash").rowsBetween(Window.unboundedPreceding, -1)
    extra = F.greatest(F.lit(0), F.least(F.col("size"), F.coalesce(F.col("part"), F.lit(0)) - F.coalesce(F.sum("size").over(within), F.lit(0))))
    joined = joined.withColumn("extra", extra)
    times = (F.col("passes") + F.when(F.col("extra") > 0, 1).otherwise(0)).cast("int")
    return joined.select(
        "doc_id", "size", "source_size", "target", (F.col("passes") * F.col("size") + F.col("extra")).alias("taken"),
        "source", "text_hash", "passes", "extra", F.coalesce(F.slice("block_shards", F.lit(1), times), F.array().cast("array<int>")).alias("shards"),
    )


def mixed_documents(docs: DataFrame, seed: int = 0) -> DataFrame:
    """The mix itself, with the columns of ``docs``: a row each time a document is taken, in shard order.

    A document that is taken in part gives its first words, joined by a space.  Documents are matched to
    the plan by doc_id, source and a hash of the text, and by their place among rows that agree in all three; text and n_chars, if it is there, follow what is taken.
    """
    own = [c for c in ("doc_id", "text", "n_chars") if c in docs.columns]
    text = F.col("text").cast("string")
    # a null doc_id and a null source are values like others
    named = {"id_key": F.coalesce(F.col("doc_id").cast("long").cast("string"), F.lit("-")), "source_key": F.coalesce(F.concat(F.lit("="), F.col("source_key")), F.lit("-"))}
    key = ["id_key", "source_key", "text_hash"]
    sized = carried(docs, *own).withColumns({"size": word_count(text), "text_hash": F.xxhash64(text), "source_key": F.col("carried")["source"].cast("string")}).withColumns(named)
    chosen = plan(docs.select("doc_id", "source", "text"), seed).withColumnRenamed("source", "source_key").withColumns(named).select(*key, "passes", "extra", "shards")
    alone = chosen.groupBy(*key).agg(F.count("*").alias("n"), *(F.first(c).alias(c) for c in ("passes", "extra", "shards")))
    met = sized.join(alone, key)
    # rows that agree in all three are numbered on both sides; the join's exchange serves both branches, so texts move once
    among = Window.partitionBy(*key)
    many = met.where("n > 1").drop("passes", "extra", "shards").withColumn("nth", F.row_number().over(among.orderBy("size")))
    numbered = chosen.withColumn("nth", F.row_number().over(among.orderBy("passes", F.col("extra").desc(), "shards")))
    rows = met.where("n = 1").unionByName(many.join(numbered, [*key, "nth"]).drop("nth"))
    rows = rows.where(F.size("shards") > 0).select("*", F.posexplode("shards").alias("copy", "shard"))
    cut = (F.col("copy") >= F.col("passes")) & (F.col("extra") < F.col("size"))
    text = F.when(cut, F.array_join(F.slice(F.regexp_extract_all("text", F.lit(WORD), F.lit(0)), F.lit(1), F.col("extra").cast("int")), " ")).otherwise(F.col("text"))
    rows = rows.withColumn("text", text)
    if "n_chars" in own:
        rows = rows.withColumn("n_chars", F.when(cut, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    rows = rows.select(*own, "carried", "shard", F.xxhash64("doc_id", "text_hash", "copy", F.lit(seed + 3)).alias("local"))
    rows = rows.repartitionByRange("shard", "local").sortWithinPartitions("shard", "local")
    return uncarried(rows, docs.columns, *own)

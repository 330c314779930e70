"""Ranks, links, budgets, and winners of groups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def link_indices(rows: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """chunk_index from 0, prev_index and next_index with -1 at the ends."""
    w = Window.partitionBy(*key).orderBy(*order)
    rows = rows.withColumn("chunk_index", F.row_number().over(w) - 1)
    return rows.withColumns({"prev_index": F.coalesce(F.lag("chunk_index").over(w), F.lit(-1)), "next_index": F.coalesce(F.lead("chunk_index").over(w), F.lit(-1))})


def fragments(rows: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """fragment_index, total_fragments, is_fragment."""
    w = Window.partitionBy(*key)
    return rows.withColumns({"fragment_index": F.row_number().over(w.orderBy(*order)), "total_fragments": F.count("*").over(w)}).withColumn("is_fragment", F.col("total_fragments") > 1)


def top_per_group(rows: DataFrame, key: Sequence[str], order: Sequence[Column], n: int, rank: str = "rank") -> DataFrame:
    """At most ``n`` a group; Spark keeps only so many a task before the shuffle."""
    return rows.withColumn(rank, F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where(F.col(rank) <= n)


def budget_prefix(rows: DataFrame, key: Sequence[str], order: Sequence[str], text: str, budget: int) -> DataFrame:
    """The longest prefix within a token budget; a first text above it is cut to four characters a token."""
    w = Window.partitionBy(*key).orderBy(*order)
    # a text has a token at least, so no more rows than tokens can be in; Spark keeps only so many a task before the shuffle
    rows = rows.withColumn("nth", F.row_number().over(w)).where(F.col("nth") <= budget)
    rows = rows.withColumn("tokens", F.greatest(F.lit(1), F.expr(f"length({text}) div 4")))
    rows = rows.withColumn("upto", F.sum("tokens").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    over = (F.col("nth") == 1) & (F.col("tokens") > budget)
    return rows.where((F.col("upto") <= budget) | over).withColumn(text, F.when(over, F.concat(F.substring(text, 1, 4 * budget), F.lit(" [truncated]"))).otherwise(F.col(text)))


def budget_suffix(rows: DataFrame, key: Sequence[str], order: Sequence[str], text: str, budget: int) -> DataFrame:
    """The latest messages within a budget."""
    latest = Window.partitionBy(*key).orderBy(*(F.desc(c) for c in order))
    rows = rows.withColumn("_nth", F.row_number().over(latest)).where(F.col("_nth") <= budget).drop("_nth")
    w = latest.rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("used", F.sum(F.greatest(F.lit(1), F.expr(f"length({text}) div 4"))).over(w)).where(F.col("used") <= budget)


def keep_best(rows: DataFrame, key: Sequence[str], scores: Sequence[str], arrival: str) -> DataFrame:
    """Of each key the row with the largest scores, the first of equals; ``position`` is the key's first arrival."""
    w = Window.partitionBy(*key)
    best = w.orderBy(*(F.coalesce(F.col(s), F.lit(0)).desc() for s in scores), arrival)
    return rows.withColumns({"position": F.min(arrival).over(w), "_nth": F.row_number().over(best)}).where("_nth = 1").drop("_nth")


def last_before(value: Column, key: Sequence[str], order: Sequence[str], back: int) -> Column:
    """The last non-null value among the ``back`` rows before."""
    return F.last(value, ignorenulls=True).over(Window.partitionBy(*key).orderBy(*order).rowsBetween(-back, -1))


def target_coverage(rows: DataFrame, query: str, target: str, score: str, tie: str, k: int) -> DataFrame:
    """With several targets, the best min(2, max(1, k // targets)) of each come first, then the rest by score; ``k`` a query."""
    # no more than ``k`` of a target can be in, and Spark keeps only so many a task before the shuffle
    best = top_per_group(rows, [query, target], [F.desc(score), F.asc(tie)], k, "_nth")
    n = rows.groupBy(F.col(query).alias("_query")).agg(F.count_distinct(target).alias("_n"))
    rows = best.join(n, F.col(query).eqNullSafe(F.col("_query"))).drop("_query")
    share = F.least(F.lit(2), F.greatest(F.lit(1), F.floor(F.lit(k) / F.col("_n"))))
    rows = rows.withColumn("protected", (F.col("_n") > 1) & F.col(target).isNotNull() & (F.col("_nth") <= share))
    order = [F.desc("protected"), F.when(F.col("protected"), F.col(target)), F.when(F.col("protected"), F.col("_nth")), F.desc(score), F.asc(tie)]
    return top_per_group(rows, [query], order, k).drop("_n", "_nth")


def with_best(rows: DataFrame, key: str, value: str, name: str = "best") -> DataFrame:
    """Rows with the largest value of their key, which is found before anything is moved."""
    best = rows.groupBy(F.col(key).alias("_key")).agg(F.max(value).alias(name))
    return rows.join(best, F.col(key).eqNullSafe(F.col("_key"))).drop("_key")


def source_precision(rows: DataFrame, query: str, source: str, score: str, strong: Column, arrival: str, k: int, slack: float = 0.08) -> DataFrame:
    """Where strong rows name a dominant source, its rows come first and others stay only near its best."""
    strong_rows = rows.where(strong).groupBy(query, source).agg(F.count("*").alias("n"), F.max(score).alias("top"))
    dominant = strong_rows.groupBy(query).agg(F.max_by(F.struct(F.col(source).alias("name"), "top"), F.struct("n", "top", source)).alias("dominant"))
    joined = rows.join(dominant, query, "left").withColumn("_own", F.coalesce(F.col(source) == F.col("dominant.name"), F.lit(False)))
    enough = F.count_if("_own").over(Window.partitionBy(query)) >= min(2, k)
    applies = F.coalesce((F.col("dominant.name") != "") & enough, F.lit(False))
    joined = joined.withColumn("_applies", applies).where(~F.col("_applies") | F.col("_own") | (F.col(score) >= F.col("dominant.top") - slack))
    return top_per_group(joined, [query], [F.when(F.col("_applies") & F.col("_own"), 0).otherwise(1), F.asc(arrival)], k).drop("_own", "_applies", "dominant")


def word_ranks(words: DataFrame, word: str, count: str) -> DataFrame:
    """``words`` with rank, 1 for the largest count, equal ones by word; no task orders more than the words of one count that begin alike."""
    rows = words.withColumn("_head", F.substring(word, 1, 3))
    before = Window.rowsBetween(Window.unboundedPreceding, -1)
    heads = rows.groupBy(count, "_head").agg(F.count("*").alias("_n"))
    # as many rows as there are different counts, so one task may order them
    counts = heads.groupBy(count).agg(F.sum("_n").alias("_all"))
    counts = counts.select(count, F.coalesce(F.sum("_all").over(before.orderBy(F.desc(count))), F.lit(0)).alias("_above"))
    inside = heads.withColumn("_inside", F.coalesce(F.sum("_n").over(before.partitionBy(count).orderBy("_head")), F.lit(0)))
    base = inside.join(counts, count).select(count, "_head", (F.col("_above") + F.col("_inside")).alias("_base"))
    ranked = rows.join(base, [count, "_head"]).withColumn("rank", F.col("_base") + F.row_number().over(Window.partitionBy(count, "_head").orderBy(word)))
    return ranked.select(*words.columns, "rank")

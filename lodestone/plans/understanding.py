"""What a question asks for: files it names, acronyms it uses, how it follows on."""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from lodestone.functions import text as fn

#: Names up to which they are broadcast and held against every question; more are joined by equal pieces of text.
FEW = 1000
#: Needles of an automaton, their characters on average at most, and texts that meet several of them in a task.
SHARD, SHARD_CHARS, TEXTS = 50_000, 200, 20_000


def contained(rows: DataFrame, hay: str, needles: DataFrame, needle: str, shard: int = SHARD, texts: int = TEXTS) -> DataFrame:
    """The rows with each needle that is in their ``hay``, and ``before``, the character ahead of it, if there is one; a row a place.

    Needles are dealt by hash into shards, of each of which a task makes an automaton (Aho-Corasick) that finds all its needles in one pass over
    a text; rows come out for hits only.  A single shard goes to every task as it is; several meet slices of ``texts`` rows as the cells of a
    grid, so a text is read once a shard and no task has more than a shard and a slice.  Empty needles are in nothing, nothing is in a null hay.
    """
    needles = needles.where(F.length(needle) > 0)
    n, chars = needles.agg(F.count("*"), F.coalesce(F.sum(F.length(needle)), F.lit(0))).first()
    rows = rows.where(F.col(hay).isNotNull())
    shards = max(1, -(-n // shard), -(-chars // (shard * SHARD_CHARS)))
    left, right = [c for c in rows.columns if c != hay], [c for c in needles.columns if c != needle]
    schema = StructType([*(rows.schema[c] for c in left), StructField("before", StringType()), *(needles.schema[c] for c in right)])

    def scan(some: pa.Table, known: pa.Table, automaton: ahocorasick.Automaton) -> pa.Table:
        at, found, before = [], [], []
        for k, text in enumerate(some.column(hay).to_pylist()):
            for end, (size, numbers) in automaton.iter(text):
                start = end + 1 - size
                for number in numbers:
                    at.append(k)
                    found.append(number)
                    before.append(text[start - 1] if start else None)
        ours, theirs = some.select(left).take(pa.array(at, pa.int64())), known.select(right).take(pa.array(found, pa.int64()))
        return pa.table([*ours.columns, pa.array(before, pa.string()), *theirs.columns], names=[*left, "before", *right])

    def automaton(known: pa.Table) -> ahocorasick.Automaton:
        numbers: dict[str, list[int]] = {}
        for k, name in enumerate(known.column(needle).to_pylist()):
            numbers.setdefault(name, []).append(k)
        made = ahocorasick.Automaton()
        for name, of in numbers.items():
            made.add_word(name, (len(name), of))
        made.make_automaton()
        return made

    if shards == 1:
        known = needles.toArrow()  # at most a shard

        def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            made = automaton(known) if len(known) else None
            for batch in batches:
                if made is not None:
                    yield from scan(pa.Table.from_batches([batch]), known, made).to_batches()

        return rows.mapInArrow(whole, schema)

    def cell(some: pa.Table, known: pa.Table) -> pa.Table:
        if not len(some) or not len(known):
            return scan(some.slice(0, 0), known.slice(0, 0), ahocorasick.Automaton())
        return scan(some, known, automaton(known))

    slices = max(1, -(-rows.count() // texts))
    every = lambda k: F.explode(F.sequence(F.lit(0), F.lit(k - 1)))
    dealt = rows.withColumn("_slice", F.pmod(F.xxhash64(hay), F.lit(slices)).cast("int")).withColumn("_shard", every(shards))
    kept = needles.withColumn("_shard", F.pmod(F.xxhash64(needle), F.lit(shards)).cast("int")).withColumn("_slice", every(slices))
    return dealt.groupBy("_shard", "_slice").cogroup(kept.groupBy("_shard", "_slice")).applyInArrow(cell, schema)


def mentions(questions: DataFrame, files: DataFrame, few: int = FEW) -> DataFrame:
    """The files a question (``qid`` tells them apart) names by @name, by name, or by stem as whole words; longest names first.

    Up to ``few`` distinct names are broadcast, more are found by ``contained``. An empty name or stem is named by nothing.
    """
    stem = fn.strip(F.regexp_replace(F.regexp_replace(F.lower("filename"), r"\.[a-z0-9]+$", ""), "[^a-z0-9]+", " "))
    names = files.select("filename").where("filename <> ''").distinct().withColumns({"_name": F.lower("filename"), "_stem": stem})
    text = F.lower(F.col("question"))
    if names.limit(few + 1).count() <= few:
        how = (
            F.when(F.contains(text, F.concat(F.lit("@"), "_name")), 1)
            .when(F.contains(text, F.col("_name")), 2)
            .when((F.col("_stem") != "") & fn.has_word(text, F.col("_stem")), 3)
        )
        found = questions.join(F.broadcast(names), how.isNotNull()).select("qid", "filename", how.alias("tier"))
    else:
        whole = contained(questions.select("qid", text.alias("_text")), "_text", names.select("filename", "_name"), "_name")
        spaced = F.concat(F.lit(" "), F.regexp_replace(text, "[^a-z0-9]+", " "), F.lit(" "))
        words = names.where("_stem <> ''").select("filename", F.concat(F.lit(" "), "_stem", F.lit(" ")).alias("_word"))
        by_stem = contained(questions.select("qid", spaced.alias("_text")), "_text", words, "_word")
        tiers = whole.select("qid", "filename", F.when(F.col("before") == "@", 1).otherwise(2).alias("tier")).union(by_stem.select("qid", "filename", F.lit(3)))
        found = tiers.groupBy("qid", "filename").agg(F.min("tier").alias("tier"))
    order = Window.partitionBy("qid").orderBy("tier", F.length("filename").desc(), "filename")
    return found.withColumn("rank", F.row_number().over(order))


def resolve_target(targets: DataFrame, files: DataFrame, few: int = FEW) -> DataFrame:
    """A target as a known file: equal, equal in letters and digits, or contained either way; else as it is.

    Up to ``few`` distinct files are broadcast, more are joined by the names and found by ``contained``.
    """
    def bare(c: str) -> Column:
        return F.regexp_replace(F.lower(F.regexp_replace(F.col(c), r"\.[A-Za-z0-9]+$", "")), "[^a-z0-9]+", "")

    t, f = targets.select("target").distinct().withColumn("_t", bare("target")), files.select("filename").distinct().withColumn("_f", bare("filename"))
    if f.limit(few + 1).count() <= few:
        tier = (
            F.when(F.col("target") == F.col("filename"), 1).when(F.col("_t") == F.col("_f"), 2)
            .when((F.col("_t") != "") & (F.contains("_t", F.col("_f")) | F.contains("_f", F.col("_t"))), 3)
        )
        found = t.join(F.broadcast(f), tier.isNotNull()).select("target", "filename", tier.alias("tier"))
    else:
        nameless = f.where("_f = ''").agg(F.min("filename").alias("filename")).where("filename IS NOT NULL")  # one row: no letter or digit, so in every target
        found = (
            t.join(f, F.col("target") == F.col("filename")).select("target", "filename", F.lit(1).alias("tier"))
            .union(t.join(f, F.col("_t") == F.col("_f")).select("target", "filename", F.lit(2)))
            .union(contained(t, "_t", f, "_f").select("target", "filename", F.lit(3)))
            .union(contained(f, "_f", t, "_t").select("target", "filename", F.lit(3)))
            .union(t.where("_t <> ''").crossJoin(F.broadcast(nameless)).select("target", "filename", F.lit(3)))
        )
    best = found.groupBy("target").agg(F.min_by("filename", F.struct("tier", "filename")).alias("file"))
    return t.join(best, "target", "left").select("target", F.coalesce("file", "target").alias("resolved"))


def indexed_acronyms(rows: DataFrame, text: str) -> DataFrame:
    """All acronyms of the corpus."""
    return rows.select(F.explode(fn.acronyms(text)).alias("acronym")).distinct()


def follow_up(question: Column, previous: Column) -> Column:
    """A question that leans on the one before, put together with it."""
    leans = F.lower(question).rlike(r"\b(it|this|that|they|them|those|these|he|she|above|same|more)\b") | (F.size(fn.tokens(question)) < 4)
    return F.when(leans & previous.isNotNull(), F.concat_ws(" ", previous, question)).otherwise(question)


def variants(question: Column, most: int = 2) -> Column:
    """X11: the question and its keyword form, distinct in any case, at most ``most``."""
    pair = F.array(fn.collapse(question), fn.keyword_query(question))
    distinct = F.when(F.lower(pair[0]) == F.lower(pair[1]), F.slice(pair, 1, 1)).otherwise(pair)
    return F.slice(F.filter(distinct, lambda x: x != ""), 1, most)

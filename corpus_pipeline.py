"""A corpus from raw documents to packed training sequences, a stage at a time.

Each stage takes (spark, docs, sf_dir), works on all that the one before it kept, and returns the columns of
``documents``; the last returns the pieces of the packed sequences.

Defined cases: a null text is an empty one, and is that after the substring stage; a null doc_id is a document of
its own, ranks last and is kept by the near-duplicate stage; rows that repeat a doc_id are one document there, of which
the row with the smallest hash of its text stays; null lang, source or n_chars are values like others; further columns
pass through all stages but the last, whatever their names; empty tables give no rows, and without two classes of
labels the classifier keeps all.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.llm import mixing, packing, quality, setsketch, substrings
from lodestone.llm.common import carried, materialize, table, uncarried


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the quality classifier, fitted on the labels, accepts."""
    return quality.accepted(docs, table(spark, sf_dir, "labels"))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest doc_id of each group of near-duplicates (five words, 0.8); rows that repeat a doc_id go too."""
    found = setsketch.near_duplicates(docs.select("doc_id", "text"))
    extra = found.where("NOT kept").select("doc_id").distinct()
    rows = carried(docs, "doc_id", "text").join(extra, "doc_id", "left_anti")
    text = F.xxhash64("text")
    same = Window.partitionBy("doc_id", F.when(F.col("doc_id").isNull(), text)).orderBy(text)
    rows = rows.withColumn("nth", F.row_number().over(same)).where("nth = 1 OR doc_id IS NULL")
    return uncarried(rows, docs.columns, "doc_id", "text")


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 13 words or more that an earlier document has are cut; documents that lose all their words go."""
    cut = substrings.dedup(carried(docs, "doc_id", "text", "n_chars"), keep_layout=True).where("n_removed = 0 OR n_removed < n_words")
    # a text that loses nothing keeps its n_chars
    cut = cut.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return uncarried(cut, docs.columns, "doc_id", "text", "n_chars")


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources in their target weights; a document taken twice is two rows."""
    return mixing.mixed_documents(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of sequences of at most 2048 tokens."""
    return packing.pack(docs)


STAGES = [
    ("quality classifier", good),
    ("MinHash near-dedup", one_of_each),
    ("substring dedup", without_repeats),
    ("mixing to target weights", mixed),
    ("packing", packed),
]

#: A learned model, sketches and a tokenizer are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), "stage-" + "".join(c if c.isalnum() else "-" for c in name))
    return STAGES[-1][1](spark, docs, sf_dir)

"""Retrieval for a batch of questions: search, merge, score, augment, cover, stitch."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from lodestone.functions import markdown as md
from lodestone.functions import scoring as sc
from lodestone.functions import text as fn
from lodestone.operators import windows as op

#: Rows of a stated set that are broadcast; more go by a grid.
BATCH = 1000


#: Vectors and questions that meet in a cell of the grid.
SLICE, BLOCK = 16_384, 2048


def knn(questions: DataFrame, vectors: DataFrame, k: int, qid: str = "qid", vid: str = "vec_id", keep: Column | None = None, few: int = BATCH) -> DataFrame:
    """The ``k`` nearest by cosine of each question, over vectors that pass ``keep``; exact.

    questions: ``qid``, ``q_vector`` and, if there are targets, ``target`` (null: all); vectors: ``vid``, ``embedding`` and
    ``filename`` where targets are used.  The questions are a stated set and go against all vectors: up to ``few`` are broadcast, more meet
    slices of the vectors as the cells of a grid.  Every task keeps its own best ``k`` a question before anything is shuffled.
    """
    rows = vectors if keep is None else vectors.where(keep)
    if questions.limit(few + 1).count() > few:
        return op.top_per_group(grid(questions, rows, k, qid, vid), [qid], [F.desc("vector_score"), F.asc(vid)], k)
    on = F.col("target").isNull() | (F.col("target") == F.col("filename")) if "target" in questions.columns else F.lit(True)
    sim = F.try_divide(sc.dot("q_vector", "embedding"), F.col("_q_norm") * F.col("_v_norm"))
    pairs = rows.withColumn("_v_norm", sc.norm("embedding")).join(F.broadcast(questions.withColumn("_q_norm", sc.norm("q_vector"))), on)
    scored = pairs.select(*[c for c in questions.columns if c != "q_vector"], *[c for c in vectors.columns if c != "embedding"], F.greatest(F.lit(0.0), sim).alias("vector_score"))
    return op.top_per_group(scored, [qid], [F.desc("vector_score"), F.asc(vid)], k)


def grid(questions: DataFrame, vectors: DataFrame, k: int, qid: str, vid: str, slice_: int = SLICE, block: int = BLOCK) -> DataFrame:
    """The nearest of each question in each slice of the vectors, one cell a task: a product of matrices finds those that may be, their scores are then computed one by one."""
    cuts, turns = max(1, -(-vectors.count() // slice_)), max(1, -(-questions.count() // block))
    left, right = [c for c in questions.columns if c != "q_vector"], [c for c in vectors.columns if c != "embedding"]
    schema = StructType([*(questions.schema[c] for c in left), *(vectors.schema[c] for c in right), StructField("vector_score", DoubleType())])

    def vectors_of(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """All numbers of the vectors in one array, where each starts, how many it has (none if null), and whether one of them is null."""
        lists = column.combine_chunks()
        size = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        flat = lists.flatten()
        start = np.cumsum(size) - size
        holes = np.zeros(len(size), bool)
        if flat.null_count:
            holes[np.repeat(np.arange(len(size)), size)[flat.is_null().to_numpy(zero_copy_only=False)]] = True
        return pc.fill_null(flat, 0).to_numpy(zero_copy_only=False), start, size, holes

    def matrix(given: tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray], rows: np.ndarray, dim: int) -> tuple[np.ndarray, np.ndarray]:
        """A row each and its norm; what has no such vector is zero, and so scores zero."""
        flat, start, size, holes = given
        x, fit = np.zeros((len(rows), dim)), np.flatnonzero((size[rows] == dim) & ~holes[rows])
        if dim:
            x[fit] = flat[start[rows[fit]][:, None] + np.arange(dim)]
        return x, np.sqrt((x * x).sum(1))

    def nearest(asked: pa.Table, some: pa.Table) -> pa.Table:
        at_q: list[int] = []
        at_v: list[np.ndarray] = []
        score: list[np.ndarray] = []
        wanted, given = vectors_of(asked.column("q_vector")), vectors_of(some.column("embedding"))
        ids = some.column(vid).to_numpy()
        names = np.array(some.column("filename").to_pylist(), object) if "target" in left else None
        targets = asked.column("target").to_pylist() if "target" in left else [None] * len(asked)
        for dim in np.unique(wanted[2]).tolist() if len(some) else []:
            v, norm_v = matrix(given, np.arange(len(some)), dim)
            own = np.flatnonzero(wanted[2] == dim)
            for part in (own[n : n + 64] for n in range(0, len(own), 64)):
                q, norm_q = matrix(wanted, part, dim)
                with np.errstate(divide="ignore", invalid="ignore"):
                    rough = np.maximum(0.0, np.nan_to_num((q @ v.T) / (norm_q[:, None] * norm_v)))
                for i, one, norm, line in zip(part, q, norm_q, rough):
                    if targets[i] is not None:
                        line = np.where(names == targets[i], line, -1.0)
                    few = np.flatnonzero(line >= np.partition(line, len(line) - k)[len(line) - k] - 1e-9) if len(line) > k else np.arange(len(line))
                    few = few[line[few] >= 0]
                    with np.errstate(divide="ignore", invalid="ignore"):
                        exact = np.maximum(0.0, np.nan_to_num((one * v[few]).sum(1) / (norm * norm_v[few])))
                    order = np.lexsort((ids[few], -exact))[:k]
                    at_q += [i] * len(order)
                    at_v.append(few[order])
                    score.append(exact[order])
        found, high = (np.concatenate(x) if x else np.zeros(0) for x in (at_v, score))
        ours, theirs = asked.select(left).take(pa.array(at_q, pa.int64())), some.select(right).take(pa.array(found.astype(np.int64)))
        return pa.table([*ours.columns, *theirs.columns, pa.array(high, pa.float64())], names=[*left, *right, "vector_score"])

    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    asked = questions.withColumn("_block", F.pmod(F.xxhash64(qid), F.lit(turns)).cast("int")).withColumn("_slice", every(cuts))
    some = vectors.withColumn("_slice", F.pmod(F.xxhash64(vid), F.lit(cuts)).cast("int")).withColumn("_block", every(turns))
    return asked.groupBy("_block", "_slice").cogroup(some.groupBy("_block", "_slice")).applyInArrow(nearest, schema)


def merge_best(candidates: DataFrame, text: str = "text") -> DataFrame:
    """One row a passage and question, the one with the best scores."""
    keyed = candidates.withColumn("_head", F.substring(text, 1, 160))
    return op.keep_best(keyed, ["qid", "filename", "chunk_index", "_head"], ["lexical_score", "score", "vector_score"], "arrival").drop("_head")


def above_threshold(rows: DataFrame, score: str, targeted: Column, least: float = 0.42) -> DataFrame:
    """a question without targets whose best score is too low loses all its rows; with targets rows stay."""
    return rows.withColumn("_best", F.max(score).over(Window.partitionBy("qid"))).where(targeted | (F.col("_best") >= least)).drop("_best")


def intro_rows(targets: DataFrame, chunks: DataFrame) -> DataFrame:
    """The first two passages of each target."""
    first = op.top_per_group(chunks.where("chunk_index < 2"), ["filename"], [F.asc("chunk_index")], 2)
    return targets.join(first, targets["target"] == first["filename"]).withColumn("score", F.lit(0.35)).drop("rank")


def stitch(rows: DataFrame, key: str = "filename", most: int = 12000) -> DataFrame:
    """Passages with consecutive chunk_index of one file as one text, merged in order; a text beyond ``most`` ends with the passage that took it there.

    Where a question found a table row (``chunk_kind``, if there is one) its passages stay as they are.  Islands are chunk_index less
    the row number; the passages that a question found side by side are few.
    """
    w = Window.partitionBy("qid", key).orderBy("chunk_index")
    rows = rows.withColumn("_island", F.col("chunk_index") - F.row_number().over(w))
    if "chunk_kind" in rows.columns:
        alone = F.max(F.coalesce(F.col("chunk_kind").startswith("table_row"), F.lit(False))).over(Window.partitionBy("qid"))
        rows = rows.withColumn("_island", F.when(alone, F.struct(F.lit(1).alias("k"), F.col("chunk_index").cast("long").alias("n"))).otherwise(F.struct(F.lit(0).alias("k"), F.col("_island").cast("long").alias("n"))))
    parts = F.array_sort(F.collect_list(F.struct("chunk_index", "text")))
    piece = "struct<chunk_index: bigint, n: bigint, text: string>"

    def as_piece(p: Column) -> Column:
        return F.struct(p["chunk_index"].cast("long").alias("chunk_index"), F.lit(1).cast("long").alias("n"), p["text"].alias("text"))

    def step(s: Column, p: Column) -> Column:
        now = s["now"]
        full = (now["n"] > 1) & (F.length(now["text"]) > most)
        more = F.struct(now["chunk_index"].alias("chunk_index"), (now["n"] + 1).alias("n"), md.joined_smartly(now["text"], p["text"]).alias("text"))
        return F.struct(F.when(full, F.concat(s["done"], F.array(now))).otherwise(s["done"]).alias("done"), F.when(full, as_piece(p)).otherwise(more).alias("now"))

    def folded(s: Column) -> Column:
        start = F.struct(F.array().cast(f"array<{piece}>").alias("done"), as_piece(s["parts"][0]).cast(piece).alias("now"))
        return fn.bound(lambda t: F.concat(t["end"]["done"], F.array(t["end"]["now"])), end=F.aggregate(F.slice(s["parts"], F.lit(2), F.size(s["parts"])), start, step))

    runs = rows.groupBy("qid", key, "_island").agg(parts.alias("parts")).select("qid", key, F.explode(fn.bound(folded, parts=F.col("parts"))).alias("x"))
    return runs.select("qid", key, F.col("x.chunk_index").alias("chunk_index"), F.col("x.n").alias("stitched_from"), F.col("x.text").alias("text"))


def stitch_pairs(fragments: DataFrame) -> DataFrame:
    """Fragments of a question-answer pair joined by a blank line."""
    parts = F.array_sort(F.collect_list(F.struct("fragment_index", "text")))
    return fragments.groupBy("qa_pair_id").agg(F.count("*").alias("stitched_from"), F.array_join(F.transform(parts, lambda x: x["text"]), "\n\n").alias("text"))

"""J5, J6 at scale: search over product-quantised vectors, with an exact rerank of a bounded list.

A vector, at length one, is cut into parts of ``WIDTH`` numbers, and each part is replaced by the number of the nearest of 256 centres of that part: a byte for
``WIDTH`` floats.  Centres are learned on at most ``SAMPLE`` vectors; all vectors are coded.  A question becomes a table of its products with all centres,
so the score of a code is a sum of look-ups, and only codes are read: ``bytes_read`` says how many bytes a question reads, against those of the
vectors.  Every task keeps its best ``rerank`` a question; of all these the best ``rerank`` are joined with their vectors and scored exactly.  ``retrieval.knn`` is the exact way.

Defined cases: vectors that are null, zero, of another dimension than most, or hold null or non-finite numbers are not in the index; such questions find nothing; of equal
scores the smaller id comes first; an empty index finds nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, DoubleType, StructField, StructType

from lodestone.functions import scoring as sc
from lodestone.operators import windows as op
from lodestone.sources.files import written

WIDTH, SAMPLE, ROUNDS = 4, 8192, 12
#: Questions whose tables go to every task at once; more go in as many passes over the codes as a grid has blocks.
ASKED = 512


class Index(NamedTuple):
    """codes: id, code; vectors: id, embedding (usable ones, as they were); centres: part, centre, number."""

    codes: DataFrame
    vectors: DataFrame
    centres: np.ndarray
    dim: int


def usable(rows: DataFrame, vector: str) -> DataFrame:
    """Rows whose vector has only finite numbers, and one that is not zero."""
    x = F.col(vector)
    finite = lambda v: v.isNotNull() & (F.abs(v.cast("double")) < float("inf")) & ~F.isnan(v.cast("double"))
    return rows.where(x.isNotNull() & F.forall(x, finite) & F.exists(x, lambda v: v != 0))


def parts(x: np.ndarray) -> np.ndarray:
    """Vectors at length one, by part: row, part, number; the last part is filled up with zeros."""
    x = x / np.sqrt((x * x).sum(1, keepdims=True))
    short = -x.shape[1] % WIDTH
    return np.pad(x, ((0, 0), (0, short))).reshape(len(x), -1, WIDTH)


def nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Of each row the number of the nearest centre."""
    out = np.empty(len(x), np.int64)
    half = (centres * centres).sum(1) / 2
    for a in range(0, len(x), 4096):
        out[a : a + 4096] = np.argmax(x[a : a + 4096] @ centres.T - half, axis=1)
    return out


def learned(x: np.ndarray, k: int = 256, rounds: int = ROUNDS) -> np.ndarray:
    """Centres of rows by Lloyd's steps from a spread start; fewer rows than centres are centres themselves."""
    x = np.unique(x, axis=0)
    if len(x) <= k:
        return np.concatenate([x, np.repeat(x[:1], k - len(x), axis=0)])
    centres = x[np.random.default_rng(0).choice(len(x), k, replace=False)]
    for _ in range(rounds):
        near = nearest(x, centres)
        n = np.bincount(near, minlength=k)
        sums = np.stack([np.bincount(near, x[:, d], k) for d in range(x.shape[1])], 1)
        centres = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centres)
    return centres


def matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    return np.array(column.to_pylist(), np.float64)


def build(vectors: DataFrame, id_: str, vector: str, sample: int = SAMPLE) -> Index:
    """The index of all usable vectors of the most frequent dimension."""
    rows = usable(vectors.select(F.col(id_).alias("id"), F.col(vector).alias("embedding")), "embedding")
    most = rows.groupBy(F.size("embedding").alias("d")).count().orderBy(F.desc("count"), "d").first()
    dim, n = (most["d"], most["count"]) if most else (0, 1)
    rows = rows.where(F.size("embedding") == dim)
    # by a hash below a bound that about four samples pass, so that no task sends more than its share
    h = F.xxhash64("id", "embedding")
    some = rows.select("embedding", h.alias("h")).where(F.col("h") <= min((1 << 63) - 1, (sample << 66) // n - (1 << 63))).groupBy("h").agg(F.min("embedding").alias("embedding"))
    some = some.orderBy("h").limit(sample).toArrow()
    centres = np.zeros((0, 256, WIDTH))
    if len(some):
        cut = parts(matrix(some.column("embedding")))
        centres = np.stack([learned(cut[:, p]) for p in range(cut.shape[1])])

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                cut = parts(matrix(batch.column(1)))
                codes = np.stack([nearest(cut[:, p], centres[p]) for p in range(len(centres))], 1).astype(np.uint8)
                yield pa.record_batch([batch.column(0), pa.array([c.tobytes() for c in codes], pa.binary())], names=["id", "code"])

    codes = rows.mapInArrow(coded, StructType([rows.schema["id"], StructField("code", BinaryType())]))
    return Index(written(codes, "quantised-codes"), rows, centres, dim)


def candidates(index: Index, asked: pa.Table, rerank: int) -> DataFrame:
    """qid, id, rough of the best ``rerank`` codes a task for each of a few questions (qid, q_vector)."""
    tables = np.einsum("qpw,pcw->qpc", parts(matrix(asked.column("q_vector"))), index.centres).astype(np.float32)
    qids, kind = asked.column("qid"), index.codes.schema["id"]
    n_parts = len(index.centres)

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[list[tuple[np.ndarray, list]]] = [[] for _ in range(len(tables))]
        for batch in batches:
            codes = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint8).reshape(-1, n_parts)
            ids = batch.column(0)
            for q, table in enumerate(tables):
                rough = table[np.arange(n_parts), codes].sum(1)
                best = np.argpartition(-rough, rerank - 1)[:rerank] if len(rough) > rerank else np.arange(len(rough))
                kept[q].append((rough[best], ids.take(pa.array(best)).to_pylist()))
        for q, found in enumerate(kept):
            if found:
                rough, ids_ = np.concatenate([r for r, _ in found]), [i for _, some in found for i in some]
                best = np.argsort(-rough, kind="stable")[:rerank]
                yield pa.record_batch([qids.take(pa.array([q] * len(best))).combine_chunks(), pa.array([ids_[i] for i in best], ids.type), pa.array(rough[best].astype(np.float64))], names=["qid", "id", "rough"])

    qid = StructField("qid", index.codes.sparkSession.createDataFrame(asked.slice(0, 1).select(["qid"])).schema["qid"].dataType)
    return index.codes.mapInArrow(look_up, StructType([qid, kind, StructField("rough", DoubleType())]))


def search(index: Index, questions: DataFrame, k: int = 10, rerank: int = 200) -> DataFrame:
    """qid, id, rank, score: about the ``k`` nearest by cosine, with exact scores.

    questions: qid, q_vector; a stated set, which comes to the driver in blocks of ``ASKED`` and is scored by one pass over the codes each.
    """
    rows = usable(questions.select("qid", "q_vector"), "q_vector").where(F.size("q_vector") == index.dim)
    rows = written(rows, "quantised-asked")
    blocks = max(1, -(-rows.count() // ASKED))
    found = None
    for b in range(blocks):
        asked = rows.where(F.pmod(F.xxhash64("qid"), F.lit(blocks)) == b).toArrow()
        if len(asked) and len(index.centres):
            some = written(candidates(index, asked, rerank), "quantised-candidates")
            found = some if found is None else found.unionByName(some)
    if found is None:
        return rows.join(index.vectors, F.lit(False)).select("qid", "id", F.lit(1).alias("rank"), F.lit(0.0).alias("score"))
    short = op.top_per_group(found, ["qid"], [F.desc("rough"), F.asc("id")], rerank).select("qid", "id")
    exact = short.join(index.vectors, "id").join(rows, "qid").select("qid", "id", F.greatest(F.lit(0.0), sc.cosine("q_vector", "embedding")).alias("score"))
    return op.top_per_group(exact, ["qid"], [F.desc("score"), F.asc("id")], k).select("qid", "id", "rank", "score")


def bytes_read(index: Index, rerank: int = 200) -> tuple[int, int]:
    """Bytes that a question reads: of codes and of vectors to rerank; and those of all vectors, which the exact search reads."""
    n = index.codes.count()
    return n * len(index.centres) + min(n, rerank) * 4 * index.dim, n * 4 * index.dim

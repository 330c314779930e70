"""Approximate nearest neighbours over learned partitions.

A bounded sample gives a neighbour graph; its nodes are dealt to partitions of equal size so that few
neighbours are separated (balanced label propagation).  A small network learns the partition from the
vector; it puts every row in its most probable partition and routes a query to several of the most
probable ones, as many as the sample needs for the wanted recall.  There, all vectors are ranked by
exact distances in double precision.

There are as many partitions as the square root of the rows, as long as each has ``SAMPLE_ROWS`` of the sample: 256 with the sample
of 8192, from 65,000 rows on.  Beyond, partitions grow with the rows; a larger ``sample`` gives more.  Partitions are cut into blocks by a hash of vec_id,
and their queries likewise, so no task has more than a block of each, whatever a partition or a vector that a third
of all rows share; each pair of blocks keeps a query's best few, and only those meet.

Defined cases: vectors that are null, empty, zero or hold null or non-finite components take no part, nor do
rows with a null vec_id; vectors of another than the most common dimension are compared with those of their own dimension,
all of them; rows with the query's vec_id are not its candidates; of several query rows with one vec_id one is
taken; ties go to the smaller vec_id; with fewer candidates than ``k`` all are found; an empty table gives no rows; below
``LEAST`` rows there is one partition.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

from lodestone.llm.common import materialize

SAMPLE = 8192
SAMPLE_ROWS = 32
LEAST = 128
BLOCK_ROWS = 4096
BLOCK_QUERIES = 1024
NEIGHBOURS = 12
RECALL = 0.97
FOUND = "query_id long, vec_id long, score double"


def neighbour_graph(x: np.ndarray, k: int = NEIGHBOURS) -> np.ndarray:
    """Indices of each row's ``k`` nearest other rows, nearest first."""
    square, out = (x * x).sum(1), []
    k = min(k, len(x) - 1)
    for at in range(0, len(x), 512):
        d = square[None, :] - 2 * (x[at : at + 512] @ x.T)
        d[np.arange(len(d)), at + np.arange(len(d))] = np.inf
        near = np.argpartition(d, k - 1, axis=1)[:, :k]
        out.append(np.take_along_axis(near, np.argsort(np.take_along_axis(d, near, 1), axis=1), 1))
    return np.concatenate(out)


def balanced_partition(x: np.ndarray, graph: np.ndarray, parts: int, slack: float = 1.1, rounds: int = 12, seed: int = 0) -> np.ndarray:
    """Labels of ``parts`` partitions, none above ``slack`` times the mean, that separate few neighbours."""
    rng = np.random.default_rng(seed)
    n, room = len(x), int(np.ceil(slack * len(x) / parts))
    centres = x[rng.choice(n, parts, replace=False)]
    label = np.zeros(n, np.int64)
    reverse = np.concatenate([graph.ravel(), np.repeat(np.arange(n), graph.shape[1])])
    forward = np.concatenate([np.repeat(np.arange(n), graph.shape[1]), graph.ravel()])
    for step in range(rounds):
        if step < rounds // 2:  # seeds and means first, so that the graph has something to refine
            gain = -(((x * x).sum(1)[:, None] + (centres * centres).sum(1)) - 2 * x @ centres.T)
        else:
            gain = np.bincount(forward * parts + label[reverse], minlength=n * parts).reshape(n, parts).astype(np.float64)
            gain[np.arange(n), label] += 0.5
        best = np.argsort(-gain, axis=1)
        top = np.take_along_axis(gain, best[:, :2], 1)
        free = np.full(parts, room)
        fresh = np.zeros(n, np.int64)
        for i in np.argsort(-(top[:, 0] - top[:, -1]), kind="stable"):
            for p in best[i]:
                if free[p]:
                    free[p] -= 1
                    fresh[i] = p
                    break
        label = fresh
        if step < rounds // 2:
            size = np.maximum(np.bincount(label, minlength=parts), 1)
            centres = np.stack([np.bincount(label, x[:, d], parts) for d in range(x.shape[1])], 1) / size[:, None]
    return label


def train_router(x: np.ndarray, label: np.ndarray, parts: int, hidden: int = 96, epochs: int = 40, seed: int = 0) -> dict:
    """A network with one hidden layer, by Adam on the cross-entropy."""
    rng = np.random.default_rng(seed)
    mean, scale = x.mean(0), max(float(x.std()), 1e-9)
    z = ((x - mean) / scale).astype(np.float32)
    w = [rng.normal(0, np.sqrt(2 / x.shape[1]), (x.shape[1], hidden)), np.zeros(hidden), rng.normal(0, np.sqrt(1 / hidden), (hidden, parts)), np.zeros(parts)]
    w = [a.astype(np.float32) for a in w]
    m, v, t = [np.zeros_like(a) for a in w], [np.zeros_like(a) for a in w], 0
    for epoch in range(epochs):
        order = rng.permutation(len(z))
        for at in range(0, len(z), 256):
            rows = order[at : at + 256]
            h = np.maximum(z[rows] @ w[0] + w[1], 0)
            s = h @ w[2] + w[3]
            p = np.exp(s - s.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(rows)), label[rows]] -= 1
            p /= len(rows)
            back = (p @ w[2].T) * (h > 0)
            t += 1
            for k, g in enumerate((z[rows].T @ back, back.sum(0), h.T @ p, p.sum(0))):
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.999 * v[k] + 0.001 * g * g
                w[k] -= 0.003 * (1 - epoch / epochs) * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)
    return {"mean": mean, "scale": scale, "w": w}


def logits(router: dict, x: np.ndarray) -> np.ndarray:
    w = router["w"]
    return np.maximum(((x - router["mean"]) / router["scale"]).astype(np.float32) @ w[0] + w[1], 0) @ w[2] + w[3]


def learn(x: np.ndarray, parts: int, recall: float = RECALL, k: int = 10) -> tuple[dict, int]:
    """The router, and the number of partitions a query needs: judged on an eighth of the sample that it was not fitted on."""
    test = np.arange(len(x)) % 8 == 0
    train = x[~test]
    label = balanced_partition(train, neighbour_graph(train), parts)
    router = train_router(train, label, parts)
    s = logits(router, x)
    own, order = s.argmax(1), np.argsort(-s[test], axis=1)
    near = neighbour_graph(x, k)[test]
    place = np.argsort(order, axis=1)  # place[q, p]: when query q comes to partition p
    when = np.take_along_axis(place, own[near], 1)
    probes = next((p for p in range(1, parts + 1) if (when < p).mean() >= recall), parts)
    return router, probes


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id, embedding of the rows that take part."""
    x = F.col("embedding")
    fine = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), x.cast("array<double>").alias("embedding")).where(
        F.col("vec_id").isNotNull() & x.isNotNull() & (F.size(x) > 0)
        & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists(x, lambda v: v != 0)
    )
    return fine


def ranked(x: np.ndarray, ids: np.ndarray, q: np.ndarray, own: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """vec_ids and distances of the ``k`` rows nearest to ``q``, without its own; ``ids`` ascend."""
    rough = (x * x).sum(1) - 2 * (x @ q)
    rough[ids == own] = np.inf
    if len(rough) > k:
        edge = np.partition(rough, k - 1)[k - 1]
        at = np.flatnonzero(rough <= edge + 1e-9 * (1 + abs(edge) + q @ q))
    else:
        at = np.arange(len(rough))
    at = at[ids[at] != own]
    score = np.sqrt(((x[at] - q) ** 2).sum(1))
    best = np.lexsort((ids[at], score))[:k]
    return ids[at][best], score[best]


def router_for(rows: DataFrame, n: int, k: int, sample: int) -> tuple[dict | None, int, int]:
    """Router, partitions, and partitions a query needs, from at most ``sample`` of ``n`` vectors chosen by a hash of vec_id."""
    if n < LEAST:
        return None, 1, 1
    # hashes below a bound that about four samples pass, so that partitions send little; equal rows have one hash and are one
    bound = F.lit(min((1 << 63) - 1, (sample << 65) // n - (1 << 63)))
    some = rows.select("embedding", F.xxhash64("vec_id", "embedding").alias("h")).where(F.col("h") <= bound)
    some = some.groupBy("h").agg(F.min("embedding").alias("embedding")).orderBy("h").limit(sample).toPandas()
    x = np.unique(np.stack(some["embedding"].to_numpy()), axis=0)  # copies would fill the graph
    x = x[np.random.default_rng(0).permutation(len(x))]
    parts = min(math.isqrt(n), len(x) // SAMPLE_ROWS)
    if parts < 2:
        return None, 1, 1
    router, probes = learn(x, parts, k=k)
    return router, parts, probes


def search(vectors: DataFrame, every: int = 100, k: int = 10, sample: int = SAMPLE) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` nearest of each row whose vec_id is divisible by ``every``."""
    return with_share(vectors, every, k, sample)[0]


def with_share(vectors: DataFrame, every: int = 100, k: int = 10, sample: int = SAMPLE) -> tuple[DataFrame, int, int]:
    """The result of ``search``, the number of partitions, and how many of them a query is routed to at least."""
    rows = usable(vectors)
    common = rows.groupBy(F.size("embedding").alias("d")).count().orderBy(F.desc("count"), "d").first()
    if common is None:
        return rows.select(F.col("vec_id").alias("query_id"), F.lit(1).alias("rank"), "vec_id", F.lit(0.0).alias("score")).limit(0), 0, 0
    dim, n = common["d"], common["count"]
    router, parts, probes = router_for(rows.where(F.size("embedding") == dim), n, k, sample)

    def likely(v: pd.Series) -> np.ndarray:
        return logits(router, np.stack(v.to_numpy())) if router else np.zeros((len(v), 1))

    @F.pandas_udf(IntegerType())
    def partition(v: pd.Series) -> pd.Series:
        """The most probable partition; vectors of another dimension have one of their own, below zero."""
        size = v.map(len)
        out = -size.astype(np.int32)
        main = size == dim
        if main.any():
            out[main] = likely(v[main]).argmax(1).astype(np.int32)
        return out

    placed = materialize(rows.withColumn("part", partition("embedding")), "ann-rows")
    sizes = placed.groupBy("part").agg(F.count("*").alias("rows"))
    sizes = materialize(sizes.withColumn("cut", F.ceil(F.col("rows") / BLOCK_ROWS).cast("int")), "ann-sizes")
    known = {r["part"]: r["rows"] for r in sizes.where("part >= 0").collect()}  # a row a partition
    held = np.array([known.get(p, 0) for p in range(parts)])

    @F.pandas_udf(ArrayType(IntegerType()))
    def routes(v: pd.Series) -> pd.Series:
        """The most probable partitions: ``probes`` of them, and on until they hold k candidates."""
        size = v.map(len)
        out = (-size).map(lambda p: [p])
        main = np.flatnonzero(size == dim)
        if len(main):
            order = np.argsort(-likely(v.iloc[main]), axis=1)
            need = np.maximum(probes, (np.cumsum(held[order], axis=1) < k + 1).sum(1) + 1)
            for i, o, m in zip(main, order, need):
                out.iloc[i] = o[:m].astype(np.int32).tolist()
        return out

    asked = placed.where(F.pmod("vec_id", F.lit(every)) == 0).groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    asked = materialize(asked.select("vec_id", "embedding", F.explode(routes("embedding")).alias("part")), "ann-asked")
    wanted = asked.groupBy("part").agg(F.ceil(F.count("*") / BLOCK_QUERIES).cast("int").alias("turns"))
    cuts = materialize(sizes.select("part", "cut").join(wanted, "part"), "ann-cuts")

    def dealt(frame: DataFrame, own: str, mine: str, other: str, every_: str) -> DataFrame:
        """Each row in its own block by a hash, beside every block of the other side."""
        joined = frame.join(cuts, "part")
        block = F.pmod(F.xxhash64("vec_id", F.lit(own)), F.col(mine)).cast("int")
        return joined.select("vec_id", "embedding", "part", block.alias(own), F.explode(F.sequence(F.lit(0), F.col(other) - 1)).alias(every_))

    def rank(candidates: pa.Table, queries: pa.Table) -> pa.Table:
        out: list[list] = [[], [], []]
        if len(candidates) and len(queries):
            ids = candidates.column("vec_id").to_numpy()
            order = np.argsort(ids, kind="stable")
            x = candidates.column("embedding").combine_chunks().flatten().to_numpy().reshape(len(ids), -1)[order]
            ids = ids[order]
            qs = queries.column("embedding").combine_chunks().flatten().to_numpy().reshape(len(queries), -1)
            for own, q in zip(queries.column("vec_id").to_pylist(), qs):
                found, score = ranked(x, ids, q, own, k)
                out[0].append(np.full(len(found), own))
                out[1].append(found)
                out[2].append(score)
        merged = [np.concatenate(c) if c else [] for c in out]
        return pa.table([pa.array(merged[0], pa.int64()), pa.array(merged[1], pa.int64()), pa.array(merged[2], pa.float64())], names=["query_id", "vec_id", "score"])

    keys = ["part", "block", "turn"]
    near = dealt(placed, "block", "cut", "turns", "turn").groupBy(*keys).cogroup(dealt(asked, "turn", "turns", "cut", "block").groupBy(*keys)).applyInArrow(rank, FOUND)
    best = Window.partitionBy("query_id").orderBy("score", "vec_id")
    out = near.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
    return out, parts, probes

"""Search over codes: recall against brute force, exact scores, odd vectors."""

import numpy as np
from pyspark.sql import functions as F

from lodestone import registry
from lodestone.plans import quantised


def brute(x, ids, q, k):
    score = np.maximum(0, x @ q / (np.linalg.norm(x, axis=1) * np.linalg.norm(q)))
    best = np.lexsort((ids, -score))[:k]
    return [(int(ids[i]), score[i]) for i in best]


def test_recall_and_bytes(spark, monkeypatch):
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.normal(size=(40, 30))[rng.integers(0, 40, 2500)] + 0.4 * rng.normal(size=(2500, 30)), rng.normal(size=(1500, 30))])
    rows = [(k, v.tolist()) for k, v in enumerate(x)] + [(9001, None), (9002, [0.0] * 30), (9003, [1.0] * 7), (9004, [float("nan")] * 30), (9005, [None] + [1.0] * 29)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(5)
    asked = frame.where("vec_id % 50 = 0 OR vec_id > 9000").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("q_vector"))
    monkeypatch.setattr(quantised, "ASKED", 40)  # several blocks
    index = quantised.build(frame, "vec_id", "embedding", 2000)
    got = {}
    for r in quantised.search(index, asked, 10, 150).collect():
        got.setdefault(r.qid, []).append((r.rank, r.id, r.score))
    assert set(got) == set(range(0, 4000, 50))
    hits = 0
    for q, found in got.items():
        want = brute(x, np.arange(4000), x[q], 10)
        assert [r for r, _, _ in sorted(found)] == list(range(1, 11)) and sorted(found)[0][1] == q
        score = {i: s for i, s in brute(x, np.arange(4000), x[q], 4000)}
        assert all(abs(score[i] - s) < 1e-9 for _, i, s in found)
        hits += len({i for i, _ in want} & {i for _, i, _ in found})
    assert hits / (10 * len(got)) >= 0.9
    read, whole = quantised.bytes_read(index, 150)
    assert index.codes.count() == 4000 and read < whole / 5


def test_recall_of_the_query(spark):
    d = "/root/testdata/sf0.01"
    exact = {(r.qid, r.vec_id) for r in registry.queries()["knn_cosine_topk"](spark, d).collect()}
    found = {(r.qid, r.vec_id) for r in registry.queries()["knn_quantised"](spark, d).collect()}
    assert len(found) == len(exact) and len(exact & found) >= 0.9 * len(exact)


def test_nothing_to_find(spark):
    frame = spark.createDataFrame([(1, [1.0, 2.0]), (2, [2.0, 1.0])], "vec_id long, embedding array<double>")
    asked = frame.select(F.col("vec_id").alias("qid"), F.col("embedding").alias("q_vector"))
    index = quantised.build(frame, "vec_id", "embedding")
    assert [(r.qid, r.id) for r in quantised.search(index, asked, 1).orderBy("qid").collect()] == [(1, 1), (2, 2)]
    assert quantised.search(index, asked.limit(0)).count() == 0
    assert quantised.search(quantised.build(frame.limit(0), "vec_id", "embedding"), asked).count() == 0

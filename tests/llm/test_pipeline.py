import collections
import random

from pyspark.sql import functions as F

import corpus_pipeline
from lodestone.llm import queries


def test_names():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.queries()) == list(range(1, 14))
    assert set(queries.oracle_sql()) <= set(queries.queries())


def test_stages(spark):
    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    kept = docs
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = kept
        kept = stage(spark, before, d).cache()
        if k < 4:
            assert kept.columns == docs.columns, name
        if k < 3:
            assert kept.join(before, "doc_id", "left_anti").count() == 0
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{d}/labels.parquet").collect()}
    good = corpus_pipeline.good(spark, docs, d).select("doc_id").collect()
    left = {r["doc_id"] for r in good}
    assert sum(q == 1 and i not in left for i, q in labels.items()) <= 0.05 * len(labels)
    assert kept.count() > 0
    # where documents are cut follows the partitions that the pieces are made in; what is packed must not
    whole = [sorted(map(tuple, x.groupBy("doc_id", "doc_tokens").agg(F.sum("length")).collect())) for x in (corpus_pipeline.run(spark, d), kept)]
    assert whole[0] == whole[1]


def odd_tables(spark, path, docs, labels, extra=""):
    kinds = "doc_id long, text string, lang string, source string, n_chars long" + extra
    spark.createDataFrame(docs, kinds).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return str(path)


def test_odd_rows_and_clashing_columns(spark, tmp_path):
    rng = random.Random(4)
    words = [f"w{k}" for k in range(500)]

    def prose(n):
        return " ".join(rng.choice(words) for _ in range(n))

    passage, copied = prose(60), prose(80)
    docs = [(k, prose(rng.randrange(20, 120)), "en", "ab"[k % 2], 5) for k in range(60)]
    docs += [(100, copied, "en", "a", 5), (101, copied, "en", "b", 5), (102, prose(30) + " " + passage, None, None, None), (103, passage + " " + prose(30), "en", "a", 1)]
    docs += [(104, None, None, None, None), (105, "", "en", "a", 0), (None, prose(40), "en", "a", 1), (None, prose(40), "en", "a", 1), (106, "long " * 30_000, "en", "b", 9), (7, docs[7][1], "en", "b", 5)]
    clash = (1, "q", 2.5, "s", 3, True, "x", 4)
    names = ", n_words int, quality string, kept double, size string, extra int, passes boolean, shards string, nth int"
    path = odd_tables(spark, tmp_path, [(*r, *clash) for r in docs], [(k, int(k % 9 > 0), 0) for k in range(40)] + [(None, 1, 0), (1, None, 0)], names)
    given = spark.read.parquet(f"{path}/documents.parquet")
    kept = given
    for _, stage in corpus_pipeline.STAGES[1:4]:  # the classifier would judge these texts by chance
        kept = stage(spark, kept, path)
        assert kept.columns == given.columns
        rows = kept.collect()
        assert {tuple(r)[5:] for r in rows} == {clash}
        kept = spark.createDataFrame(rows, given.schema)
    ids = collections.Counter(r["doc_id"] for r in rows)
    assert 101 not in ids and set(ids) <= {r[0] for r in docs}
    left = corpus_pipeline.without_repeats(spark, corpus_pipeline.one_of_each(spark, given, path), path).collect()
    by_id = collections.Counter(r["doc_id"] for r in left)
    assert by_id[None] == 2 and by_id[7] == 1 and by_id[100] == 1 and by_id[101] == 0
    later = next(r["text"] for r in left if r["doc_id"] == 103)
    assert passage not in later and len(later.split()) == 30 and passage in next(r["text"] for r in left if r["doc_id"] == 102)
    assert corpus_pipeline.run(spark, path).where("doc_id IS NOT NULL").count() > 0


def test_empty_tables(spark, tmp_path):
    path = odd_tables(spark, tmp_path, [], [])
    assert corpus_pipeline.run(spark, path).count() == 0
    given = spark.read.parquet(f"{path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, given, path)
        assert out.columns == given.columns and out.count() == 0


def test_near_copies_and_repeats_by_brute_force(spark):
    """Stages two and three against the plain answers, on the rows of the smallest tables."""
    from tests.llm import reference

    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    rows = {r["doc_id"]: r["text"] for r in docs.collect()}
    near = reference.near(rows.items(), 5)
    one = corpus_pipeline.one_of_each(spark, docs, d)
    assert {r["doc_id"] for r in one.select("doc_id").collect()} == {i for i, (_, _, kept) in near.items() if kept}
    left = {i: rows[i] for i, (_, _, kept) in near.items() if kept}
    want = reference.substrings(left.items())
    cut = {r["doc_id"]: r["text"] for r in corpus_pipeline.without_repeats(spark, one, d).collect()}
    assert set(cut) == {i for i, (n, gone, _) in want.items() if gone == 0 or gone < n}
    assert all(cut[i] == left[i] if want[i][1] == 0 else len(cut[i].split()) == want[i][0] - want[i][1] for i in cut)

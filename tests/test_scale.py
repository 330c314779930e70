"""Deep pages, reconciled stores, keyed tables, runs of hot keys, checks of turns."""

import os
import random

import pytest
from pyspark.sql import functions as F

from lodestone.functions import scoring as sc
from lodestone.operators import pages, reconcile
from lodestone.operators.pages import By
from lodestone.sources.keyed import Keyed
from lodestone.streaming import rules


def listing(n=30000):
    rng = random.Random(3)
    return [(rng.choice(["a", "b", None, "c"]), rng.choice([None, float("nan"), -0.0, 0.0, 1.5, rng.random()]), k) for k in range(n)]


@pytest.mark.parametrize("kind_last, value_down", [(None, True), (True, False), (False, True)])
def test_deep_page_is_that_of_the_sorted_list(spark, kind_last, value_down):
    rows = spark.createDataFrame(listing(), "kind string, value double, id long").repartition(7)
    order = [By("kind", False, kind_last), By("value", value_down, not value_down), By("id", True)]
    whole = [r["id"] for r in rows.orderBy(*(b.sorted() for b in order)).collect()]
    for number in (0, 1, 57, 1000, 2999, 3000, 3001):
        got = pages.deep_page(rows, order, number, 10, sample=300, few=500).collect()
        start = max(number - 1, 0) * 10
        assert [(r["id"], r["position"]) for r in sorted(got, key=lambda r: r["position"])] == [(k, start + n + 1) for n, k in enumerate(whole[start : start + 10])]


def test_deep_page_sorts_few_rows(spark):
    rows = spark.range(1 << 18).select(F.xxhash64("id").alias("h"), "id")
    got = pages.deep_page(rows, [By("h"), By("id")], 10000, 10, sample=2000, few=3000)
    plain = rows.orderBy("h", "id").offset(99990).limit(10)
    assert [r["id"] for r in got.orderBy("position").collect()] == [r["id"] for r in plain.collect()]


def test_deep_page_of_times_days_and_rows_that_agree(spark):
    spark.sql("set spark.sql.session.timeZone = America/New_York")
    try:
        times = spark.range(5000).select(F.timestamp_micros(F.lit(1699160000000000) + F.col("id") * 7_000_001).alias("t"), F.to_date(F.timestamp_seconds(F.col("id") * 90000)).alias("d"), (F.col("id") % 3).alias("same"))
        for name in "td":
            got = pages.deep_page(times, [By(name, True)], 300, 10, sample=100, few=50).orderBy("position").select(name).collect()
            assert got == times.orderBy(F.desc(name)).offset(2990).limit(10).select(name).collect()
        tied = pages.deep_page(times, [By("same")], 300, 10, sample=100, few=50)
        assert [r["same"] for r in tied.collect()] == [1] * 10
    finally:
        spark.sql("set spark.sql.session.timeZone = UTC")
    assert pages.deep_page(times.limit(0), [By("t")], 1, 10).count() == 0


def multiset(rows):
    out = {}
    for r in rows:
        out[r] = out.get(r, 0) + 1
    return out


def check_difference(spark, left, right, schema, columns, **given):
    a, b = spark.createDataFrame(left, schema).repartition(5), spark.createDataFrame(right, schema)
    got = {(tuple(r[c] for c in columns), r["side"]): r["times"] for r in reconcile.differing(a, b, columns, **given).collect()}
    at = [[f.split()[0] for f in schema.split(", ")].index(c) for c in columns]
    x, y = multiset(tuple(r[i] for i in at) for r in left), multiset(tuple(r[i] for i in at) for r in right)
    want = {(k, "left" if x.get(k, 0) > y.get(k, 0) else "right"): abs(x.get(k, 0) - y.get(k, 0)) for k in x.keys() | y.keys() if x.get(k, 0) != y.get(k, 0)}
    assert got == want


@pytest.mark.parametrize("given", [{}, {"expected": 4000}, {"share": 0.02}])
def test_differences_of_ids_and_rows(spark, given):
    rng = random.Random(9)
    left = [(k, f"t{k % 50}") for k in range(6000)] + [(-k, None) for k in range(5)] + [(None, "x"), (None, None), (1 << 62, "")]
    right = [r if rng.random() > 0.01 else (r[0], f"{r[1]}!") for r in left if rng.random() > 0.02] + [(10000 + k, None) for k in range(40)] + [(3, "t3")] * 700
    for columns in (["id"], ["id", "text"], ["text"]):
        check_difference(spark, left, right, "id long, text string", columns, **given)


def test_differences_of_equal_and_empty_stores(spark):
    rows = [(k, "t") for k in range(100)] * 2
    for left, right in ((rows, rows), (rows, []), ([], rows), ([], [])):
        check_difference(spark, left, right, "id long, text string", ["id", "text"])


def test_a_table_that_is_too_small_is_counted(spark):
    check_difference(spark, [(k,) for k in range(3000)], [], "id int", ["id"], expected=1)


def files(path):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names in os.walk(path) for f in names if f.endswith(".parquet") and "_bucket=" in d}


def test_changes_touch_only_their_buckets(spark, tmp_path):
    path = str(tmp_path / "keyed")
    rows = [(k % 400 if k % 3 else 7, f"v{k}", k) for k in range(3000)] + [(None, "none", -1)]
    schema = "doc long, text string, at int"
    table = Keyed.create(spark.createDataFrame(rows, schema), path, ["doc"], 32)
    assert sorted(table.load().collect(), key=str) == sorted(spark.createDataFrame(rows, schema).collect(), key=str)

    def apply(change, want):
        old = files(path)
        touched = change()
        new = files(path)
        kept = {p: t for p, t in old.items() if int(p.split("_bucket=")[1].split("/")[0]) not in touched}
        assert kept and all(new.get(p) == t for p, t in kept.items()) and set(new) - set(kept)
        for _ in range(2):  # replay
            got = [tuple(r) for r in Keyed(spark, path).load().collect()]
            assert sorted(got, key=str) == sorted(want, key=str)
            change()

    gone = spark.createDataFrame([(5, "other"), (None, "x"), (5, "twice"), (9999, "new")], "doc int, text string")
    rows = [r for r in rows if r[0] not in (5, None)]
    apply(lambda: table.delete(gone), rows)
    fresh = spark.createDataFrame([("a", 7, 1), ("b", 7, 2), ("c", 5000, 3)], "text string, doc long, at int")
    rows = [r for r in rows if r[0] not in (7, 5000)] + [(7, "a", 1), (7, "b", 2), (5000, "c", 3)]
    apply(lambda: table.replace(fresh), rows)


def test_upsert_into_a_keyed_table(spark, tmp_path):
    path = str(tmp_path / "keyed")
    table = Keyed.create(spark.createDataFrame([(k, k, None if k % 2 else k) for k in range(50)], "id int, n int, first int"), path, ["id"], 8)
    changes = spark.createDataFrame([(3, 300, 30), (4, None, 40), (77, 1, 2)], "id int, n int, first int")
    for _ in range(2):
        table.upsert(changes, ["first"])
        got = {r["id"]: (r["n"], r["first"]) for r in table.load().collect()}
        assert len(got) == 51 and got[3] == (300, 30) and got[4] == (4, 4) and got[77] == (1, 2) and got[5] == (5, None)
    with pytest.raises(ValueError):
        table.upsert(changes.union(changes))


def test_an_emptied_bucket_stays_empty(spark, tmp_path):
    path = str(tmp_path / "keyed")
    table = Keyed.create(spark.createDataFrame([(1, "a")], "id long, text string"), path, ["id"], 4)
    table.delete(table.load())
    assert table.load().count() == 0
    assert table.delete(table.load()) == []
    table.replace(spark.createDataFrame([(1, "b")], "id long, text string"))
    assert [tuple(r) for r in table.load().collect()] == [(1, "b")]


@pytest.mark.parametrize("seed", [1, 2])
def test_stability_and_admission_of_a_hot_key(spark, seed):
    rng = random.Random(seed)
    polls = [("hot" if rng.random() < 0.5 else f"p{rng.randrange(20)}", k, rng.choice([0, 5, 5, 5, 7, None])) for k in range(3000)] + [(None, 3001 + k, 4) for k in range(3)]
    want, runs = {}, {}
    for path, attempt, size in polls:
        before, n = runs.get(path, ((), 0))
        runs[path] = (size, n + 1 if before == size else 1)
        if size and runs[path][1] > 2:
            want.setdefault(path, attempt)
    got = rules.stable(spark.createDataFrame(polls, "path string, attempt long, size long").repartition(6), "path", "attempt", "size")
    assert {r["path"]: r["stable_at"] for r in got.collect()} == want

    kinds = [(p, k, rng.choice(["open", "close", "say", "say", "error"])) for p, k, _ in polls]
    shown, is_open = [], {}
    for batch, k, kind in kinds:
        if kind in ("open", "error") or is_open.get(batch):
            shown.append(k)
        is_open[batch] = {"open": True, "close": False}.get(kind, is_open.get(batch))
    df = spark.createDataFrame(kinds, "batch string, id long, kind string").withColumn("ts", F.timestamp_seconds(F.floor(F.col("id") / 3))).repartition(6)
    kind = F.col("kind")
    got = rules.admitted(df, "batch", "ts", "id", kind == "open", kind == "close", kind == "error")
    assert got.columns == df.columns and sorted(r["id"] for r in got.collect()) == shown


def test_checks_of_a_turn(spark):
    rows = [
        ("  a Long answer about Policies and their limits, more than forty  ", "rag", ["a.pdf"], None, (["rag"], ["a.pdf", "b.pdf"], ["c.pdf", "a.pdf"], ["POLICIES", "zebra"], ["limits", "no"])),
        (None, "chat", None, "", (None, None, None, None, None)),
        ("ten chars.\n", "chat", [], "broken", ([], [], ["x"], ["Ten"], [])),
        ("x" * 39 + "  ", None, [None], None, (["rag"], ["a"], ["a"], [], [""])),
    ]
    spec = "struct<expected_intents: array<string>, expected_sources: array<string>, forbidden_sources: array<string>, required_terms: array<string>, forbidden_terms: array<string>>"
    df = spark.createDataFrame(rows, f"response string, intent string, sources array<string>, error string, spec {spec}")

    def plain(response, intent, sources, error, given):
        intents, wanted, forbidden, must, never = ([] if x is None else x for x in given)
        low, length = (response or "").lower(), len((response or "").strip())
        out = [("no_stream_error", not error), ("non_empty_answer", length >= (10 if intent == "chat" else 40))]
        out += [("expected_intent", intent in intents)] if intents else []
        out += [("expected_source", x in (sources or [])) for x in wanted] + [("forbidden_source_absent", x not in (sources or [])) for x in forbidden]
        return out + [("required_term", x.lower() in low) for x in must] + [("forbidden_term_absent", x.lower() not in low) for x in never]

    got = df.select(sc.turn_checks(*(F.col(c) for c in df.columns)).alias("checks")).collect()
    for row, r in zip(rows, got):
        assert [(c["name"], c["passed"]) for c in r["checks"]] == plain(*row)


def test_cells_of_vectors_are_arrays_of_bounded_size(spark):
    """Odd vectors score as with few questions, and what a cell multiplies at a time stays small."""
    import random

    from lodestone.plans import retrieval

    assert retrieval.SLICE * 64 * 8 <= 8 << 20
    rng = random.Random(3)
    odd = [None, [], [0.0, 0.0, 0.0], [1.0, None, 2.0], [1.0], [None], [0.5, 0.5]]
    rows = [(k, odd[k] if k < len(odd) else [rng.uniform(-1, 1) for _ in range(3)]) for k in range(120)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    asked = vectors.where("vec_id % 3 = 0 AND size(embedding) = 3 AND NOT exists(embedding, x -> x IS NULL)").selectExpr("vec_id AS qid", "embedding AS q_vector")
    fit = vectors.where("size(embedding) = 3 AND NOT exists(embedding, x -> x IS NULL)")
    plain = lambda df: sorted((r.qid, r.rank, r.vec_id, round(r.vector_score, 9)) for r in df.collect())
    assert plain(retrieval.knn(asked, fit, 5, few=2)) == plain(retrieval.knn(asked, fit, 5))
    every = retrieval.grid(vectors.selectExpr("vec_id AS qid", "embedding AS q_vector"), vectors, 200, "qid", "vec_id", 50, 40).collect()
    score = {(r.qid, r.vec_id): r.vector_score for r in every}
    assert len(every) == len(score) == 120 * 120
    assert all(score[q, v] == 0.0 for q in range(3) for v in range(120)) and all(score[50, v] == 0.0 for v in range(7)) and score[3, 3] == 0.0
    assert abs(score[4, 4] - 1) < 1e-9 and abs(score[6, 6] - 1) < 1e-9

"""Streams give what the batch forms give; files go out and come back."""

import json
import random

import pytest
from pyspark.sql import functions as F

from lodestone.sources import files
from lodestone.streaming import rules, throttle

DATA = "/root/testdata/sf0.001"


def events(spark):
    return spark.read.parquet(f"{DATA}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp")).select("event_id", "ts", "user_id", "event_type")


def drained(stream, name, mode="append"):
    q = stream.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.table(name)


def as_stream(spark, df, path):
    df.coalesce(1).write.parquet(str(path))
    return spark.readStream.schema(df.schema).parquet(str(path))


def test_throttle(spark, tmp_path):
    df = events(spark)
    batch = {tuple(r) for r in rules.throttled(df, "user_id", "ts", "event_id", 86400).collect()}
    held = {tuple(r) for r in rules.throttled_long(df, "user_id", "ts", "event_id", 86400).collect()}
    live = {tuple(r) for r in drained(rules.throttled_stream(as_stream(spark, df, tmp_path / "e"), "user_id", "ts", "event_id", 86400), "throttled").collect()}
    assert batch == held == live and 0 < len(batch) < df.count()


def test_throttle_three_events(spark):
    df = spark.createDataFrame([("f", k, t) for k, t in enumerate((0.0, 0.5, 1.9))], "p string, id long, s double").withColumn("ts", F.timestamp_micros((F.col("s") * 1_000_000).cast("long")))
    assert [r.id for r in rules.throttled(df, "p", "ts", "id", 2.0).collect()] == [0]


def test_throttle_query_holds_no_user_whole(spark):
    from lodestone import registry

    df = registry.queries()["throttle_events"](spark, DATA)
    assert "collect_list" not in df._jdf.queryExecution().toString()


def test_throttle_long_null_keys_and_times(spark):
    rows = [(None, 1, 0), (None, 2, 1), (None, 3, 5), (7, 4, 0), (7, 5, None), (7, 6, None), (7, 7, 1), (7, 8, 2), (8, 9, 1)] + [(9, 100 + k, k) for k in range(30_000)]
    df = spark.createDataFrame(rows, "u long, id long, s long").withColumn("ts", F.timestamp_seconds("s"))
    whole = sorted(map(str, rules.throttled(df, "u", "ts", "id", 2).collect()))
    assert sorted(map(str, rules.throttled_long(df, "u", "ts", "id", 2).collect())) == whole and "Row(u=None, id=2)" not in whole and len(whole) > 15_000


@pytest.mark.parametrize("gap, cells", [(0.5, 7), (3.0, 40), (40.0, 13), (100_000.0, 9), (0.0, 3)])
def test_throttle_of_a_hot_key_is_spread(spark, gap, cells):
    """A third of all events is of one user; a chain that is cut by every cell is that of one pass over it."""
    rng = random.Random(int(gap))
    rows = [(5 if k % 3 == 0 else rng.choice([None, *range(40)]), k, rng.randrange(4000) / 4 if rng.random() < 0.99 else None) for k in range(9000)]
    df = spark.createDataFrame(rows, "u long, id long, s double").withColumn("ts", F.timestamp_micros((F.col("s") * 1_000_000).cast("long")))
    want = sorted(map(str, rules.throttled_long(df, "u", "ts", "id", gap).collect()))
    assert sorted(map(str, throttle.throttled_spread(df, "u", "ts", "id", gap, cells).collect())) == want
    assert sorted(map(str, throttle.throttled_any(df, "u", "ts", "id", gap, 1000, cells).collect())) == want


def test_throttle_of_text_keys_and_no_events(spark):
    df = spark.createDataFrame([("a", k, k) for k in range(500)] + [("b", 1000, 3)], "u string, id long, s long").withColumn("ts", F.timestamp_seconds("s"))
    assert sorted(r.id for r in throttle.throttled_spread(df, "u", "ts", "id", 7, 6).collect()) == [*range(0, 500, 7), 1000]
    assert throttle.throttled_spread(df.limit(0), "u", "ts", "id", 7, 6).count() == 0


def test_tumbling(spark, tmp_path):
    df = events(spark)
    batch = sorted(map(tuple, rules.tumbling(df, "ts", "1 day", ["event_type"]).collect()))
    live = drained(rules.tumbling(as_stream(spark, df, tmp_path / "e"), "ts", "1 day", ["event_type"], "2 days"), "tumbled", "complete")
    assert sorted(map(tuple, live.collect())) == batch


def test_latency_on_a_stream(spark, tmp_path):
    df = events(spark)
    batch = sorted(map(tuple, rules.node_latency(df, ["user_id"], "ts").collect()))
    assert sorted(map(tuple, drained(rules.node_latency(as_stream(spark, df, tmp_path / "e"), ["user_id"], "ts"), "latency", "complete").collect())) == batch


def test_stability(spark):
    polls = spark.createDataFrame([("a", k, s) for k, s in enumerate((0, 0, 0, 5, 5, 5))] + [("b", k, s) for k, s in enumerate((1, 2, 2, 3, 3))], "p string, n int, size int")
    assert [tuple(r) for r in rules.stable(polls, "p", "n", "size").collect()] == [("a", 5)]


def test_queue_keeps_newest(spark):
    df = spark.createDataFrame([("s", k) for k in range(12)], "s string, n int")
    assert sorted(r.n for r in rules.newest(df, "s", "n", 10).collect()) == list(range(2, 12))


def test_upsert_sink_replays(spark, tmp_path):
    write = rules.upsert_each_batch(str(tmp_path / "t"), "d")
    one, two = spark.createDataFrame([("x", 1), ("y", 2)], "d string, n int"), spark.createDataFrame([("x", 9)], "d string, n int")
    for batch in (one, two, two):
        write(batch, 0)
    assert sorted((r.d, r.n) for r in spark.read.parquet(str(tmp_path / "t")).collect()) == [("x", 9), ("y", 2)]


def test_files(spark, tmp_path):
    run = tmp_path / "doc" / "parser" / "run"
    run.mkdir(parents=True)
    (run / "chunks.jsonl").write_text('{"text": "a b", "metadata": {"filename": "f", "chunk_index": 0}}\n\nnot json\n{"text": "c"}\n')
    (run / "manifest.json").write_text(json.dumps({"document": "d", "run_id": "r", "chunk_count": 2}))
    (run / "raw.md").write_text("# t\nbody\n")
    (run / "~$raw.md").write_text("x")
    assert sorted((r.text, r.token_count) for r in files.chunk_files(spark, str(tmp_path)).where("text IS NOT NULL").collect()) == [("a b", 2), ("c", 1)]
    assert [(r.document, r.chunk_count) for r in files.manifests(spark, str(tmp_path)).collect()] == [("d", 2)]
    assert [r.path.rsplit("/", 1)[1] for r in files.listing(spark, str(tmp_path), [".md"]).collect()] == ["raw.md"]
    assert [r.text for r in files.text_files(spark, str(run / "raw.md")).collect()] == ["# t\nbody\n"]


def test_write_chunks_replaces_one_document(spark, tmp_path):
    path = str(tmp_path / "out")
    rows = spark.createDataFrame([("d1", "p", "a"), ("d2", "p", "b")], "document string, parser string, text string")
    files.write_chunks(rows, path)
    files.write_chunks(spark.createDataFrame([("d1", "p", "new")], "document string, parser string, text string"), path)
    assert sorted((r.document, r.text) for r in spark.read.json(path).collect()) == [("d1", "new"), ("d2", "b")]


def test_vectors_append_and_clear(spark, tmp_path):
    path = str(tmp_path / "v")
    rows = spark.createDataFrame([(1, [0.1])], "id int, e array<double>")
    files.append_vectors(rows, path)
    files.append_vectors(rows, path)
    assert spark.read.parquet(path).count() == 2
    files.clear(spark, path)
    assert spark.read.parquet(path).count() == 0


def test_new_files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for k in range(3):
        (tmp_path / "in" / f"{k}.md").write_text(f"text {k}\n\nmore\n")
    got = drained(files.once(files.new_files(spark, str(tmp_path / "in"))), "arrived").collect()
    assert sorted(r.text for r in got) == [f"text {k}\n\nmore\n" for k in range(3)]
    assert sorted(r.text[:6] for r in files.drain(files.new_files(spark, str(tmp_path / "in")), str(tmp_path / "out")).collect()) == ["text 0", "text 1", "text 2"]


def test_a_version_of_a_file_comes_through_once(spark, tmp_path):
    rows = [("a", 0, "x"), ("a", 0, "y"), ("b", 5, "z"), ("a", 30, "again"), ("a", 3600, "later"), (None, 1, "m"), (None, 1, "n")]
    df = spark.createDataFrame(rows, "path string, s long, text string").select("path", F.timestamp_seconds(F.col("s") + 10**6).alias("modified"), "text")
    for _, _, text in rows:
        df.where(F.col("text") == text).coalesce(1).write.parquet(str(tmp_path / "in" / f"k={text}"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = drained(files.once(stream.select("path", "modified", "text"), "2 hours"), "passed").collect()
    assert sorted((str(r.path), int(r.modified.timestamp()) - 10**6) for r in got) == [("None", 1), ("a", 0), ("a", 30), ("a", 3600), ("b", 5)]


def test_artifact_runs(spark, tmp_path):
    run = tmp_path / "doc" / "parser" / "run"
    run.mkdir(parents=True)
    (run / "manifest.json").write_text(json.dumps({"document": "d", "run_id": "r", "chunk_count": 2}))
    (run / "chunks.jsonl").write_text("{}\n")
    (run / "notes.txt").write_text("n")
    rows = files.artifact_runs(spark, str(tmp_path), [".json", ".jsonl"], 5).collect()
    assert len(rows) == 1 and rows[0].document == "d" and sorted(rows[0].files) == ["chunks.jsonl", "manifest.json"]


def test_layout_pages(spark):
    rows = [("d", 2, 0.0, 0.0, 0, "last"), ("d", 1, 9.0, 1.04, 1, " right "), ("d", 1, 2.0, 1.01, 2, "left"), ("d", 1, 2.0, 1.0, 3, "left again"), ("d", 1, 0.0, 0.0, 4, "  "), ("d", 1, 5.0, None, 5, "nowhere"), ("e", 1, 0.0, 0.0, 6, None)]
    df = spark.createDataFrame(rows, "k string, p int, x double, y double, n int, t string")
    got = {r.k: r.markdown for r in files.layout_pages(df, "k", "p", "x", "y", "n", "t").collect()}
    assert got == {"d": "<!-- page:1 -->\n\n## Page 1\n\nnowhere\n\nleft\n\nleft again\n\nright\n\n<!-- page:2 -->\n\n## Page 2\n\nlast"}

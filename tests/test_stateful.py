"""Streams with state and timers give what the batch forms give, whatever the order of files, and after a restart."""

import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from lodestone.streaming import rules, stateful

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def live(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, stateful.PROVIDER)
    yield spark
    spark.conf.set(name, before)


def events(spark):
    rows = spark.read.parquet(f"{DATA}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    return rows.select("event_id", "ts", "user_id", "event_type", F.floor(F.round("value").cast("long") / 60).alias("size"))


def shuffled(df, path, parts=3, far=4 * 365):
    """The rows as files in a random order, and one far later event, that moves the watermark past all others."""
    rows = df.toPandas().sample(frac=1, random_state=3)
    end = rows.iloc[[0]].assign(user_id=-1, ts=rows["ts"].max() + pd.Timedelta(days=far), event_id=10**9)
    spark = df.sparkSession
    for k in range(parts):
        spark.createDataFrame(rows.iloc[k::parts], df.schema).coalesce(1).write.parquet(f"{path}/{k}")
    return lambda: spark.createDataFrame(end, df.schema).coalesce(1).write.parquet(f"{path}/end")


def drained(stream_of, path, out, name, df):
    """What comes out, from a query that is stopped and started again between files."""
    finish = shuffled(df, path)
    for last in (False, True):
        if last:
            finish()
        stream = df.sparkSession.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/*")
        q = stream_of(stream).writeStream.format("parquet").option("path", f"{out}/{name}").option("checkpointLocation", f"{out}/{name}-state").trigger(availableNow=True).start()
        q.awaitTermination()
        assert q.exception() is None
    return df.sparkSession.read.parquet(f"{out}/{name}").where("user_id <> -1")


def test_admission(live, tmp_path):
    df, kind = events(live), F.col("event_type")
    want = rules.admitted(df, "user_id", "ts", "event_id", kind == "signup", kind == "purchase", kind == "error").select("user_id", "event_id")
    what = {"opens": kind == "signup", "closes": kind == "purchase", "always": kind == "error", "id": F.col("event_id")}
    got = drained(lambda s: stateful.in_order(s, stateful.Admission(), "user_id", "ts", "event_id", "900 days", what), tmp_path / "in", tmp_path / "out", "admitted", df)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and got.count() > 20


def test_settling_by_a_timer(live, tmp_path):
    df = events(live)
    want = rules.settled(df, "user_id", "ts", "event_id", "size", 3_600_000)
    got = drained(lambda s: stateful.in_order(s, stateful.Settling(3_600_000), "user_id", "ts", "event_id", "900 days", {"size": F.col("size")}), tmp_path / "in", tmp_path / "out", "settled", df)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and got.count() > 20


def test_stable_attempts(live, tmp_path):
    df = events(live).withColumn("ts", F.timestamp_seconds(F.col("event_id") + 10**9)).withColumn("size", F.col("event_id") % 7 % 2)
    want = rules.stable(df, "user_id", "event_id", "size")
    what = {"attempt": F.col("event_id"), "size": F.col("size")}
    got = drained(lambda s: stateful.in_order(s, stateful.Stable(), "user_id", "ts", "event_id", "900 days", what), tmp_path / "in", tmp_path / "out", "stable", df)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and got.count() > 5


def test_queue(live, tmp_path):
    df = events(live)
    shuffled(df, tmp_path / "in")()
    stream = live.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    q = stateful.newest_stream(stream, "user_id", "event_id", 3).writeStream.format("memory").queryName("held").outputMode("update").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    last = live.table("held").groupBy("user_id").agg(F.max_by("held", F.size("held") + F.col("dropped")).alias("held"), F.max("dropped").alias("dropped"))
    want = rules.newest(df, "user_id", "event_id", 3).groupBy("user_id").agg(F.array_sort(F.collect_list("event_id")).alias("held")).join(df.groupBy("user_id").agg((F.count("*")).alias("n")), "user_id")
    assert sorted((r.user_id, r.held, r.dropped) for r in last.where("user_id <> -1").collect()) == sorted((r.user_id, r.held, r.n - len(r.held)) for r in want.collect())


def fold(rule, rows, state=None, wake=None):
    """A rule over one key's events, in plain code; the end of time wakes it too."""
    state, out = state or rule.start, []
    for us, what in [*sorted(rows, key=lambda r: r[0]), (10**18, None)]:
        while wake is not None and wake * 1000 <= us:
            state, more, wake = rule.timer(state, wake)
            out += more
        if what is not None:
            state, more, next_ = rule.event(state, us, what)
            wake = wake if next_ == -1 else next_
            out += more
    return out


def test_jobs_with_an_initial_state(live, tmp_path):
    rng = random.Random(2)
    steps = [(k, j, 10**9 + rng.randrange(5000), rng.choice(["queue", "start", "start", "complete", "fail", "cancel", "?"])) for k, j in enumerate(rng.randrange(12) for _ in range(150))]
    df = live.createDataFrame(steps, "event_id long, user_id long, s long, step string").withColumn("ts", F.timestamp_micros(F.col("s") * 1_000_000 + F.col("event_id"))).drop("s")
    begin = [(0, "RUNNING", 2, 10**12 + 100_000), (1, "QUEUED", 1, None), (50, "RUNNING", 1, 10**12), (51, "FAILED", 3, None)]
    initial = live.createDataFrame(begin, "user_id long, status string, attempt int, wake long")
    rule = stateful.Jobs(600_000)
    got = drained(lambda s: stateful.in_order(s, rule, "user_id", "ts", "event_id", "900 days", {"step": F.col("step")}, initial), tmp_path / "in", tmp_path / "out", "jobs", df)
    want = []
    for key in {j for _, j, _, _ in steps} | {b[0] for b in begin}:
        rows = [(s * 1_000_000 + k, (step,)) for k, j, s, step in steps if j == key]
        first = next((b for b in begin if b[0] == key), None)
        want += [(key, *r) for r in fold(rule, rows, first[1:3] if first else None, first[3] if first and first[1] == "RUNNING" else None)]
    assert sorted(map(tuple, got.collect())) == sorted(want) and (50, "QUEUED", 2, 10**12) in want


def test_in_flight():
    rule = stateful.InFlight(1000)
    rows = [(0, (True, 1)), (500_000, (True, 2)), (600_000, (False, 1)), (700_000, (True, 3)), (1_699_999, (True, 4)), (1_700_000, (True, 5))]
    assert fold(rule, rows) == [(1,), (3,), (5,)]


def test_idle_batches_close():
    rule = stateful.Admission(1000)
    rows = [(0, (True, False, False, 1)), (900_000, (False, False, False, 2)), (1_900_000, (False, False, False, 3)), (2_000_000, (False, False, True, 4)), (2_100_000, (True, True, False, 5)), (2_200_000, (False, True, False, 6)), (2_300_000, (False, False, False, 7))]
    assert fold(rule, rows) == [(1,), (2,), (4,), (5,), (6,)]

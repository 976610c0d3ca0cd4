"""Stream forms equal batch forms."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from shelfworks.operators import ingest
from shelfworks.plans import views
from shelfworks.sources.bucketed import BucketedTable
from shelfworks.streaming import ordered_state as o
from shelfworks.streaming import search_events as s
from shelfworks.streaming.intake import Intake, brands, models

SCHEMA = "event_id bigint, user_id bigint, ts timestamp, text string, latency_s double"


def _files(spark, sf_dir, path, parts=3):
    events = views.events(spark, sf_dir).withColumn("ts", F.col("ts").cast("timestamp")).orderBy("ts", "event_id").toPandas()
    step = -(-len(events) // parts)
    for k in range(parts):
        spark.createDataFrame(events[k * step : (k + 1) * step], SCHEMA).coalesce(1).write.mode("append").parquet(str(path))
    return spark.createDataFrame(events, SCHEMA)


def _run(stream, name, mode):
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).start()
    q.processAllAvailable()
    q.stop()


def test_debounce_stream(spark, sf_dir, tmp_path):
    batch = _files(spark, sf_dir, tmp_path / "in")
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    _run(s.debounce(stream, "6 hours", s.WATERMARK).select("user_id", "event_id", "text"), "debounced", "complete")
    want = s.debounce(batch, "6 hours").select("user_id", "event_id", "text")
    assert sorted(map(tuple, spark.table("debounced").collect())) == sorted(map(tuple, want.collect()))


def test_distinct_until_changed_stream(spark, sf_dir, tmp_path):
    batch = _files(spark, sf_dir, tmp_path / "in")
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(str(tmp_path / "in"))
    _run(s.distinct_until_changed_stream(stream.drop("latency_s")).select("event_id"), "changed", "append")
    want = s.distinct_until_changed(batch).select("event_id")
    assert sorted(map(tuple, spark.table("changed").collect())) == sorted(map(tuple, want.collect()))


def test_search_stream(spark, tmp_path):
    cat = spark.createDataFrame([(1, "Samsung", "Galaxy"), (2, "Apple", "iPhone")], "id_phone bigint, brand string, model string")
    spark.createDataFrame([(1, "galaxy"), (2, " "), (3, "zzz")], "event_id bigint, text string").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("event_id bigint, text string").parquet(str(tmp_path / "in"))
    q = s.search_stream(stream, cat, str(tmp_path / "out"), str(tmp_path / "ck"))
    q.processAllAvailable()
    q.stop()
    got = spark.read.parquet(str(tmp_path / "out")).orderBy("query_id").collect()
    assert [(r.query_id, r.id_phone, r.brand) for r in got] == [(1, 1, "SAMSUNG"), (3, None, None)]


def test_switch_latest_edge(spark):
    rows = [(1, 1, "2024-01-01 00:00:00", "a", 2.0), (2, 1, "2024-01-01 00:00:01", "b", 0.5), (3, 1, "2024-01-01 00:00:02", "c", 9.0)]
    df = spark.createDataFrame(rows, "event_id bigint, user_id bigint, ts string, text string, latency_s double").withColumn("ts", F.col("ts").cast("timestamp"))
    assert sorted(r.event_id for r in s.switch_latest(df).collect()) == [2, 3]


def test_switch_latest_stream(spark, sf_dir, tmp_path):
    slow = lambda df: df.withColumn("latency_s", F.col("latency_s") * 100)
    batch = _files(spark, sf_dir, tmp_path / "in", 4)
    last = batch.agg(F.max("ts").alias("ts")).select(F.lit(-1).cast("bigint").alias("event_id"), F.lit(-1).cast("bigint").alias("user_id"), (F.col("ts") + F.expr("INTERVAL 90 DAYS")).alias("ts"), F.lit("end").alias("text"), F.lit(0.0).alias("latency_s"))
    last.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    _run(s.switch_latest_stream(slow(stream)).select("event_id", "user_id", "text"), "latest", "append")
    want = s.switch_latest(slow(batch)).select("event_id", "user_id", "text")
    assert sorted(map(tuple, spark.table("latest").filter("user_id >= 0").collect())) == sorted(map(tuple, want.collect()))


def test_search_stream_goes_on_where_a_search_fails(spark, tmp_path):
    cat = spark.createDataFrame([(1, "Samsung", "Galaxy")], "id_phone bigint, brand string, model string")
    asked = []

    def source():
        asked.append(1)
        return spark.read.parquet(str(tmp_path / "gone")) if len(asked) == 1 else cat

    for k in range(2):
        spark.createDataFrame([(k, "galaxy")], "event_id bigint, text string").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("event_id bigint, text string").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = s.search_stream(stream, source, str(tmp_path / "out"), str(tmp_path / "ck"))
    q.processAllAvailable()
    q.stop()
    got = {r.query_id: r.id_phone for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert len(got) == 2 and sorted(map(str, got.values())) == ["1", "None"]


def _part_files(spark, rows, path):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(str(path / "in"))
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(path / "in"))


def _events(n=120, users=3, seed=5):
    rng = random.Random(seed)
    start = datetime(2024, 1, 1)
    return sorted(
        ((i, rng.randrange(users) if i % 11 else None, start + timedelta(seconds=rng.randrange(4000), microseconds=rng.randrange(3)), rng.choice(["a", "b", None]), rng.choice([0.0, 1.5, 60.0])) for i in range(n)),
        key=lambda r: (r[2], r[0]),
    )


@pytest.mark.parametrize("kind", ["changes", "latest"])
def test_ordered_state_goes_on_after_a_restart(spark, tmp_path, kind):
    events = _events()
    batch = spark.createDataFrame(events, SCHEMA)
    end = [(-1, -1, datetime(2025, 1, 1), "end", 0.0)]
    late = [(900, 1, datetime(2023, 1, 1), "late", 0.0)]
    make = (lambda s_: o.changes(s_, "2 seconds")) if kind == "changes" else (lambda s_: o.latest_answers(s_, "2 seconds"))
    dropped = 0
    # within a part events come in any order; the stream is stopped after each part, with users' events still open
    for part in (events[:40][::-1], events[40:80], late + events[80:][::-1], end):
        stream = make(_part_files(spark, part, tmp_path))
        dropped += o.run_available(stream, str(tmp_path / "out"), str(tmp_path / "checkpoint"))
    got = spark.read.schema(stream.schema).parquet(str(tmp_path / "out")).filter("user_id IS NULL OR user_id >= 0")
    want = s.distinct_until_changed(batch) if kind == "changes" else s.switch_latest(batch)
    assert dropped == 1
    assert sorted(map(str, got.select("event_id", "user_id", "ts", "text").collect())) == sorted(map(str, want.select("event_id", "user_id", "ts", "text").collect()))


@pytest.mark.parametrize("kind", ["changes", "latest"])
def test_state_lies_by_cells_of_users(spark, tmp_path, kind):
    big = 1 << 60  # user ids that are no doubles, beside null ones
    events = [(i, None if u is None else big + u, t, x, y) for i, u, t, x, y in _events(1500, 400, 6)]
    make = (lambda s_: o.changes(s_, "2 seconds", cells=3)) if kind == "changes" else (lambda s_: o.latest_answers(s_, "2 seconds", cells=3))
    rows = []
    for part in (events[:700], events[700:], [(-1, -1, datetime(2025, 1, 1), "end", 0.0)]):
        stream = make(_part_files(spark, part, tmp_path))
        with o.stream_settings(spark):
            q = stream.writeStream.option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start(str(tmp_path / "out"), "parquet", "append")
        q.awaitTermination()
        rows += [op.numRowsTotal for p in q.recentProgress for op in p.stateOperators]
    got = spark.read.schema(stream.schema).parquet(str(tmp_path / "out")).filter("user_id IS NULL OR user_id >= 0")
    batch = spark.createDataFrame(events, SCHEMA)
    want = s.distinct_until_changed(batch) if kind == "changes" else s.switch_latest(batch)
    assert sorted(map(str, got.select("event_id", "user_id", "ts", "text").collect())) == sorted(map(str, want.select("event_id", "user_id", "ts", "text").collect()))
    assert 0 < max(rows) < 100  # not one or more for each of 400 users


def test_settings_of_a_stream_do_not_stay(spark):
    before = {k: spark.conf.get(k, None) for k in o.SETTINGS}
    with o.stream_settings(spark):
        assert spark.conf.get("spark.sql.streaming.stateStore.providerClass") == o.ROCKSDB
    assert {k: spark.conf.get(k, None) for k in o.SETTINGS} == before


def test_a_user_is_forgotten_after_a_pause(spark, tmp_path):
    at = lambda m: datetime(2024, 1, 1) + timedelta(minutes=m)
    rows = [(1, 1, at(0), "a", 0.0), (2, 1, at(5), "a", 0.0), (3, 1, at(20), "a", 0.0), (4, 1, at(29), "a", 0.0)]
    for part in (rows[:2], rows[2:], [(-1, -1, at(10_000), "end", 0.0)]):
        stream = o.changes(_part_files(spark, part, tmp_path), "1 minute", "10 minutes")
        o.run_available(stream, str(tmp_path / "out"), str(tmp_path / "checkpoint"))
    got = spark.read.schema(stream.schema).parquet(str(tmp_path / "out"))
    assert sorted(r.event_id for r in got.collect() if r.user_id == 1) == [1, 3]


def test_debounce_of_a_hot_user(spark):
    start = datetime(2024, 1, 1)
    rows = [(i, 1 if i % 3 == 0 else i, start + timedelta(seconds=i // 4 * 3), str(i), 0.0) for i in range(300)] + [(400, None, start, "n", 0.0), (401, 1, None, "x", 0.0)]
    df = spark.createDataFrame(rows, SCHEMA)
    for gap in ("2 seconds", "3 seconds", "9 seconds"):
        assert sorted(map(str, s.debounce_batch(df, gap).select("user_id", "event_id", "text", "ts").collect())) == sorted(map(str, s.debounce(df, gap).collect()))


@pytest.mark.parametrize("kind", ["brands", "models"])
def test_intake_equals_one_batch_through_restarts(spark, tmp_path, monkeypatch, kind):
    brand = spark.createDataFrame([(1, "Nokia"), (2, None)], "id_brand bigint, brand_name string")
    model = spark.createDataFrame([(1, "X1", 1)], "id_model bigint, model_name string, id_brand bigint")
    rng = random.Random(2)
    if kind == "brands":
        rows = [(i, rng.choice(["Nokia", "nokia", "LG", "", None, " ", "Sony", f"b{rng.randrange(9)}"])) for i in range(60)]
        schema, given, as_ = "seq bigint, brand_name string", brand, brands()
        table, rejected = ingest.add_brands(given, spark.createDataFrame(rows, schema))
    else:
        rows = [(i, rng.choice(["x1", "Y", "y", None, f"m{rng.randrange(9)}", f"M{rng.randrange(9)}"]), rng.choice([1, 2, 9])) for i in range(60)]
        schema, given, as_ = "seq bigint, model string, brand bigint", model, models(brand)
        table, rejected = ingest.add_models(given, brand, spark.createDataFrame(rows, schema))
    calls, replace = [], BucketedTable.replace

    def lost(self, *a, **k):
        calls.append(1)
        if len(calls) == 2:
            raise RuntimeError("lost")  # after the second batch was judged
        replace(self, *a, **k)
        if len(calls) == 4:
            raise RuntimeError("lost")  # after it was stored, but before the stream has noted it

    monkeypatch.setattr(BucketedTable, "replace", lost)
    for k in range(0, 60, 20):
        spark.createDataFrame(rows[k : k + 20], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    for _ in range(3):
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        intake = Intake(as_, given, str(tmp_path / "store"), 4)
        try:
            intake.start(stream, str(tmp_path / "checkpoint"), True).awaitTermination()
        except Exception as e:
            assert "lost" in str(e)
    text = lambda df, *c: sorted(map(str, df.select(*c).collect()))
    assert len(calls) == 5
    assert text(intake.table(), *given.columns) == text(table, *given.columns)
    assert text(intake.rejected(), "seq", "reason") == text(rejected, "seq", "reason")

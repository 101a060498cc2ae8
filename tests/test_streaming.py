"""Streams give what the same jobs give on the whole table."""

import collections
import os
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from cadenza.operators.recurrences import bilinear, legendre_memory
from cadenza.streaming import jobs as J


def replay(spark, tmp_path, make, mode="append"):
    rows = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select(F.col("user_id").alias("series_id"), F.col("ts").cast("timestamp").alias("ts"), F.col("value").alias("v"))
    rows.orderBy("ts").coalesce(1).write.parquet(f"{tmp_path}/in")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    stream = spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in")
    job = make(stream).writeStream.format("memory").queryName("out").outputMode(mode).option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
    job.awaitTermination()
    return rows, spark.table("out")


def test_tumbling(spark, tmp_path):
    rows, out = replay(spark, tmp_path, lambda s: J.tumbling(s, "1 day"))
    whole = {(r["start"], r["series_id"]): r["high"] for r in J.tumbling(rows, "1 day").collect()}
    found = {(r["start"], r["series_id"]): r["high"] for r in out.collect()}
    assert found and all(whole[k] == v for k, v in found.items())


def test_running_moments(spark, tmp_path):
    rows, out = replay(spark, tmp_path, lambda s: J.running_moments(s.select("series_id", F.col("v").alias("x"), (F.col("v") * 2).alias("y"))), "complete")
    assert {r["series_id"]: r["n"] for r in out.collect()} == {r["series_id"]: r["count"] for r in rows.groupBy("series_id").count().collect()}


def batches(spark, tmp_path, parts, make, first=0):
    """What a job has written after a stream has brought one part (rows series_id, ts, v) after the other; `first`: number of the first part, if it goes on."""
    (tmp_path / "in").mkdir(exist_ok=True)
    for i, part in enumerate(parts, first):
        table(spark, part).coalesce(1).write.parquet(f"{tmp_path}/part{i}")
        file = next(p for p in (tmp_path / f"part{i}").iterdir() if p.suffix == ".parquet")
        file.rename(tmp_path / "in" / f"{i:04d}.parquet")
        os.utime(tmp_path / "in" / f"{i:04d}.parquet", (1_700_000_000 + 10 * i,) * 2)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    stream = spark.readStream.schema("series_id long, ts timestamp, v double").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    job = make(stream).writeStream.format("parquet").option("path", f"{tmp_path}/out").outputMode("append").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
    job.awaitTermination()
    return spark.read.parquet(f"{tmp_path}/out")


def on_time(parts, hours):
    """The rows that are not late: those after the greatest time (in whole milliseconds) of all earlier parts less so many hours; and that bound after the last part."""
    kept, latest = [], None
    for part in parts:
        bound = latest and latest - timedelta(hours=hours)
        kept += [r for r in part if bound is None or datetime.fromisoformat(r[1]) > bound]
        times = [datetime.fromisoformat(r[1][:-3] if '.' in r[1] else r[1]) for r in part]
        latest = max([*times, *([latest] if latest else [])])
    return kept, latest - timedelta(hours=hours)


def plain(rows):
    out = collections.defaultdict(list)
    for r in rows:
        out[r["series_id"]].append((r["ts"], r[2]))
    return {k: sorted(v) for k, v in out.items()}


def table(spark, rows):
    return spark.createDataFrame([(s, datetime.fromisoformat(t), v) for s, t, v in rows], "series_id long, ts timestamp, v double")


def test_differences_wait_for_the_watermark(spark, tmp_path):
    """Rows within the watermark that come a batch later take their place; one that is 8 hours late goes."""
    day = "2024-01-01 "
    parts = [[(1, day + "00:00:00", 1.0), (1, day + "00:10:00", 2.0)], [(1, day + "00:30:00", 6.0)], [(1, day + "00:20:00", 3.0)], [(1, day + "10:00:00", 13.0)], [(1, day + "01:00:00", 99.0)], [(1, day + "10:10:00", 20.0)], [(2, day + "20:00:00", 0.0)]]
    out = batches(spark, tmp_path, parts, J.differences)
    steps = [(r["ts"].strftime("%H:%M"), r["step"]) for r in out.orderBy("ts").collect()]
    assert steps == [("00:10", 1.0), ("00:20", 1.0), ("00:30", 3.0), ("10:00", 7.0), ("10:10", 7.0)]


def shuffled(seed, hours):
    """Frames of several series in about 14 parts, moved by up to three parts, with some far too late and ties of time."""
    draw = random.Random(seed)
    rows = [(s, f"2024-01-{1 + h // 24:02d} {h % 24:02d}:{m:02d}:00.{s:06d}", round(draw.uniform(-5, 5), 3)) for s in range(4) for h in range(hours) for m in (5, 25, 45) if draw.random() < 0.8]
    rows += [(s, t, v + 1) for s, t, v in rows[::17]]
    parts = [[] for _ in range(hours // 3 + 9)]
    for r in rows:
        at = (datetime.fromisoformat(r[1]) - datetime(2024, 1, 1)).total_seconds() / 3600
        parts[int(at // 3) + draw.choice([0, 0, 0, 0, 1, 1, 2, 8])].append(r)
    return [p for p in parts if p] + [[(9, "2024-02-01 00:00:00", 0.0)]]


@pytest.mark.parametrize("forget", [None, "30 minutes"])
def test_shuffled_batches_equal_the_batch_form(spark, tmp_path, forget):
    parts = shuffled(1, 21)
    kept, bound = on_time(parts, 4)
    assert 0.6 < len(kept) / sum(map(len, parts)) < 0.98
    kept = [r for r in kept if datetime.fromisoformat(r[1]) <= bound]
    found = batches(spark, tmp_path, parts, lambda s: J.differences(s, "4 hours", forget))
    want = plain(J.differences(table(spark, kept), forget=forget).collect())
    assert plain(found.collect()) == want and sum(map(len, want.values())) > 60


@pytest.mark.parametrize("forget", [None, "30 minutes"])
def test_shuffled_projection_equals_the_batch_form(spark, tmp_path, forget):
    parts = shuffled(2, 12)
    kept, bound = on_time(parts, 4)
    kept = [r for r in kept if datetime.fromisoformat(r[1]) <= bound]
    a, b = bilinear(*legendre_memory(3), 0.1)
    found = plain(batches(spark, tmp_path, parts, lambda s: J.projected(s, a, b, "4 hours", forget)).collect())
    want = plain(J.projected(table(spark, kept), a, b, forget=forget).collect())
    assert found.keys() == want.keys()
    for key, rows in want.items():
        assert [t for t, _ in rows] == [t for t, _ in found[key]]
        assert max(abs(x - y) for (_, p), (_, q) in zip(rows, found[key]) for x, y in zip(p, q)) < 1e-9


def test_a_restarted_stream_goes_on(spark, tmp_path):
    parts = shuffled(3, 12)
    kept, bound = on_time(parts, 4)
    half = len(parts) // 2
    batches(spark, tmp_path, parts[:half], lambda s: J.differences(s, "4 hours"))
    found = batches(spark, tmp_path, parts[half:], lambda s: J.differences(s, "4 hours"), half)
    assert plain(found.collect()) == plain(J.differences(table(spark, [r for r in kept if datetime.fromisoformat(r[1]) <= bound])).collect())

import datetime as dt
from collections import Counter

from pyspark.sql import functions as F

import __spark_entry__ as entry
from maskframe.streaming.meter import windowed_confusion

EVENTS = "event_id long, ts timestamp, user_id long, event_type string, value double"


def events(spark, base, parts):
    """``parts`` of (day, user, type, value) become one file each of the table of events."""
    n = 0
    for part in parts:
        rows = [(n + i, dt.datetime(2024, 1, day, 12, i % 60), user, kind, value) for i, (day, user, kind, value) in enumerate(part)]
        spark.createDataFrame(rows, EVENTS).coalesce(1).write.mode("append").parquet(f"{base}/events.parquet")
        n += len(rows)


def by_hand(parts):
    want = Counter()
    for day, user, kind, value in (r for part in parts for r in part):
        want[(day, kind)] += 0
        hot, even = value > 50, user % 2 == 0
        for name, hit in (("tp", hot and even), ("fp", hot and not even), ("fn", not hot and even)):
            want[(day, kind, name)] += hit
    return {(day, kind): tuple(want[(day, kind, n)] for n in ("tp", "fp", "fn")) for day, kind in (k for k in want if len(k) == 2)}


def counts(df):
    return {(r.start.day, r.event_type): (r.tp, r.fp, r.fn) for r in df.collect()}


def test_last_windows_and_late_rows_are_counted(spark, tmp_path):
    parts = [[(day, i, kind, 10.0 * i) for day in days for kind in ("view", "click") for i in range(11)] for days in ([1, 2, 30], [28, 29, 30], [3])]
    events(spark, tmp_path, parts)
    df = entry.queries()["streaming_meter"](spark, str(tmp_path))
    assert counts(df) == by_hand(parts) and df.count() == 12
    assert counts(entry.queries()["streaming_meter"](spark, str(tmp_path))) == by_hand(parts)


def test_complete_mode_keeps_rows_behind_the_watermark(spark, tmp_path):
    parts = [[(30, 2, "view", 60.0)], [(29, 3, "view", 60.0)], [(1, 2, "view", 40.0)]]
    events(spark, tmp_path, parts)
    stream = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/events.parquet")
    seen = {}
    q = windowed_confusion(stream, "ts", ["event_type"], F.col("value") > 50, F.col("user_id") % 2 == 0).writeStream.outputMode("complete")
    q = q.foreachBatch(lambda df, i: seen.update({i: counts(df)})).option(
        "checkpointLocation", f"{tmp_path}/state"
    ).trigger(availableNow=True).start()
    q.awaitTermination()
    assert len(seen) >= 3 and seen[max(seen)] == by_hand(parts)


def test_counts_equal_the_batch_confusion(spark):
    base = "/root/testdata/sf0.001"
    hot, even = F.col("value") > 50, F.col("user_id") % 2 == 0
    batch = spark.read.parquet(f"{base}/events.parquet").groupBy(F.date_trunc("day", "ts").alias("start"), "event_type")
    want = batch.agg(F.count_if(hot & even).alias("tp"), F.count_if(hot & ~even).alias("fp"), F.count_if(~hot & even).alias("fn"))
    got = entry.queries()["streaming_meter"](spark, base)
    assert Counter(map(tuple, got.collect())) == Counter(map(tuple, want.select(got.columns).collect()))

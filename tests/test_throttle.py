"""The throttle over a batch: stretch by stretch it gives what one window over the whole of a key gives."""

import datetime
import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from textwarden.operators import review

SCHEMA = "user_id long, event_id long, ts timestamp, failed boolean, ok boolean"
START = datetime.datetime(1969, 12, 20)  # stretches before 1970 have negative numbers
LAST = "interval '86399.999999' second"


def plain(df):
    """One window over all rows of a user."""
    rows = df.withColumn("_since", F.sum(F.when(F.col("ok"), 1).otherwise(0)).over(Window.partitionBy("user_id").orderBy("ts"))).withColumn("_failed", F.col("failed"))
    return rows.withColumn("failures", F.expr(f"sum(cast(_failed as int)) over (partition by user_id, _since order by ts range between {LAST} preceding and current row)")).drop("_since", "_failed")


def judged(df):
    return review.throttled(df, "user_id", "ts", F.col("failed"), F.col("ok"), 3, LAST)


def test_equals_the_window_over_the_whole_key(spark):
    rng = random.Random(11)
    hours = [rng.randrange(24 * 30) if i % 2 else 24 * rng.randrange(30) for i in range(600)]  # many at the very edge of a stretch, many at one time
    rows = [(rng.choice([1, 1, 1, 2, 3, None]), i, START + datetime.timedelta(hours=h), rng.random() < 0.7, rng.random() < 0.06) for i, h in enumerate(hours)]
    rows += [(1, 1000 + i, None, True, i == 2) for i in range(4)] + [(1, 2000, START, None, None), (None, 2001, None, None, None)] + rows[:5]
    df = spark.createDataFrame(rows, SCHEMA)
    got, want = judged(df), plain(df)
    assert got.columns == [*df.columns, "failures", "blocked"]
    assert sorted(map(repr, got.drop("blocked").collect())) == sorted(map(repr, want.collect()))
    assert got.filter("blocked <> (failures >= 3)").count() == 0 and got.filter("blocked").count() > 50


def test_times_without_a_zone_and_with_one_are_counted_alike(spark):
    """Two failures about a change of clocks, a window apart by the times as they stand."""
    rows = spark.createDataFrame([(1, 1, "2024-03-09 12:00:00", True, False), (1, 2, "2024-03-10 11:59:59.999999", True, False), (1, 3, "2024-03-10 12:00:00", True, False)], "user_id long, event_id long, at string, failed boolean, ok boolean")
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        for name, want in (("UTC", [1, 2, 2]), ("America/New_York", [1, 2, 2])):
            spark.conf.set("spark.sql.session.timeZone", name)
            got = judged(rows.withColumn("ts", F.col("at").cast("timestamp_ntz"))).orderBy("event_id").collect()
            assert [r.failures for r in got] == want
        zoned = judged(rows.withColumn("ts", F.col("at").cast("timestamp"))).orderBy("event_id").collect()
        assert [r.failures for r in zoned] == [1, 2, 3]  # the day of the change has 23 hours
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_one_user_is_spread_over_tasks(spark):
    rows = spark.range(4000).select(F.lit(1).cast("long").alias("user_id"), F.col("id").alias("event_id"), F.timestamp_seconds(F.col("id") * 3600).alias("ts"), F.lit(True).alias("failed"), F.lit(False).alias("ok"))
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        tasks = judged(rows).groupBy(F.spark_partition_id()).count().collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    assert len(tasks) == 4 and max(r["count"] for r in tasks) < 2000 and sum(r["count"] for r in tasks) == 4000


def test_without_rows(spark):
    assert judged(spark.createDataFrame([], SCHEMA)).count() == 0

"""The throttle as a stream: any order of arrival, in many triggers, gives what the batch window gives."""

import datetime
import random

from pyspark.sql import functions as F

from textwarden.operators import review
from textwarden.streaming import streams

DAY = datetime.datetime(2024, 1, 1)
SCHEMA = "user_id long, event_id long, ts timestamp, failed boolean, ok boolean"


def batch(spark, rows, limit, span):
    df = spark.createDataFrame(rows, SCHEMA)
    found = review.throttled(df, "user_id", "ts", F.col("failed"), F.col("ok"), limit, f"interval {span - 1} seconds 999999 microseconds")
    return sorted((r.user_id, r.event_id) for r in found.filter("failed and blocked").collect())


def test_shuffled_arrival_in_many_triggers_equals_the_window(spark, tmp_path):
    rng = random.Random(4)
    rows = [(rng.randrange(5), i, DAY + datetime.timedelta(hours=rng.randrange(120)), k < 7, k == 7) for i, k in enumerate(rng.randrange(9) for _ in range(250))]
    want = batch(spark, rows, 3, 86_400)
    assert 20 < len(want) < 200
    shuffled = rng.sample(rows, len(rows))
    end = [(99, 10_000, DAY + datetime.timedelta(days=30), False, False)]  # lets the watermark pass all others
    source = tmp_path / "in"
    for i in range(0, len(shuffled), 50):
        spark.createDataFrame(shuffled[i : i + 50], SCHEMA).coalesce(1).write.mode("append").parquet(str(source))
    spark.createDataFrame(end, SCHEMA).coalesce(1).write.mode("append").parquet(str(source))
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(source))
    found = streams.throttled(stream, str(tmp_path / "out"), limit=3, seconds=86_400, delay="120 hours")
    assert sorted((r.user_id, r.event_id) for r in found.collect()) == want


def test_a_late_row_is_not_judged_by_later_ones(spark):
    day = 86_400_000_000
    out, held = streams.judge([(1, 3 * day, True, False), (2, 3 * day + 10, True, False)], [], 3, 2 * day)
    assert out == []
    assert streams.judge([(3, int(2.5 * day), True, False)], [], 3, 2 * day)[0] == []
    assert streams.judge([(3, 4 * day, True, False)], held, 3, 2 * day) == ([3], [3 * day, 3 * day + 10, 4 * day])


def test_success_clears_and_time_ends_failures():
    judged = streams.judge([(1, 10, True, False), (2, 20, True, False), (3, 30, False, True), (4, 40, True, False), (5, 40, True, False), (6, 41, True, False)], [], 3, 100)
    assert judged == ([6], [40, 40, 41])
    assert streams.judge([(7, 140, True, False)], judged[1], 3, 100) == ([], [41, 140])

import datetime
import random

from textwarden.operators import snapshots

START = datetime.datetime(1969, 12, 28)


def test_as_of_equals_a_plain_search(spark):
    """Versions and events at the same times, at edges of stretches, long before and after one another, without key or time, repeated."""
    rng = random.Random(3)
    time = lambda: START + datetime.timedelta(hours=rng.choice([24 * rng.randrange(20), rng.randrange(480)]))
    versions = [(rng.choice([1, 1, 1, 2, 3]), time(), i, f"v{i}") for i in range(40)] + [(4, START + datetime.timedelta(days=300), 90, "late"), (None, START, 91, "no"), (1, None, 92, "no")]
    events = [(rng.choice([1, 1, 2, 3, 4, 5]), time(), i) for i in range(400)] + [(None, START, 900), (1, None, 901), (4, START + datetime.timedelta(days=500), 902)]
    events += events[:3]
    want = []
    for key, at, i in events:
        valid = [v for v in versions if None not in (key, at, v[0], v[1]) and v[0] == key and v[1] <= at]
        want.append((key, at, i, max(valid, key=lambda v: (v[1], v[2]))[3] if valid else None))
    given = spark.createDataFrame(events, "k long, ts timestamp, id long"), spark.createDataFrame(versions, "k long, ts timestamp, n long, text string")
    for stretch in (snapshots.STRETCH, 5_000_000, 10**15):
        got = snapshots.as_of(*given, "k", "ts", "n", stretch).select("k", "ts", "id", "version.text").collect()
        assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))
    assert {w[3] is None for w in want} == {True, False}
    assert snapshots.as_of(given[0], given[1].limit(0), "k", "ts", "n").filter("version is not null").count() == 0
    assert snapshots.as_of(given[0].limit(0), given[1], "k", "ts", "n").count() == 0


def test_frozen_and_versions_on_disk(spark, tmp_path):
    path = str(tmp_path / "v")
    of = lambda rows: spark.createDataFrame(rows, "case_id long, flagged long")
    snapshots.append(of([(1, 5), (2, 3)]), path, 1)
    snapshots.append(of([(1, 2)]), path, 2)
    snapshots.append(of([(1, 1)]), path, 2)  # the same version again
    snapshots.append(of([(3, 0)]), path, 10)
    now = lambda v=None: sorted((r.case_id, r.flagged) for r in snapshots.read(spark, path, ["case_id"], v).collect())
    assert now(1) == [(1, 5), (2, 3)] and now(2) == now(9) == [(1, 1), (2, 3)] and now() == [(1, 1), (2, 3), (3, 0)]
    both = snapshots.frozen(spark.read.parquet(path), ["case_id"], "version", "flagged").orderBy("case_id").collect()
    assert [(r.case_id, r.draft.flagged, r.now.flagged, r.versions) for r in both] == [(1, 5, 1, 2), (2, 3, 3, 1), (3, 0, 0, 1)]

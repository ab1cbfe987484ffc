"""Frozen states: an append-only table of versions, and what was valid at any time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import times

#: Microseconds of a stretch of time that as_of() works on apart.
STRETCH = 86_400_000_000


def append(rows: DataFrame, path: str, version: int) -> None:
    """Adds rows as a version of their own; the same version written again replaces itself and nothing else, so a job that fails may run again."""
    rows.write.mode("overwrite").parquet(f"{path.rstrip('/')}/version={version:d}")


def read(spark: SparkSession, path: str, keys: list[str], version: int | None = None) -> DataFrame:
    """Of each key the row of its last version up to `version` (None: all); later versions are not read."""
    rows = spark.read.option("basePath", path).parquet(path)
    rows = rows if version is None else rows.filter(F.col("version") <= version)
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rows.columns), "version").alias("_row")).select("_row.*")


def frozen(versions: DataFrame, keys: list[str], at: str, tie: str) -> DataFrame:
    """keys, draft, now, versions: of each key the first version (frozen before anyone edits) and the last, as structs, in the order of at and tie, and how many there are."""
    row, order = F.struct(*[c for c in versions.columns if c not in keys]), F.struct(at, tie)
    return versions.groupBy(*keys).agg(F.min_by(row, order).alias("draft"), F.max_by(row, order).alias("now"), F.count(F.lit(1)).alias("versions"))


def as_of(events: DataFrame, versions: DataFrame, key: str, at: str, tie: str, stretch: int = STRETCH) -> DataFrame:
    """events with `version`: the last row of versions (as a struct) of their key at or before their time, by `tie` if several have that time; null if there is none.

    Both have the columns key and at (timestamps of one kind). Time is cut into stretches: within one, events take the last version before them; an event
    whose stretch has none yet takes the last of the stretches before, of which a row each is enough. So a hot key is as many groups as it has
    stretches, and no two rows are compared. Events without key or time have no version; versions without one are never valid.
    """
    kind = versions.select(F.struct("*").alias("v")).schema["v"].dataType
    whole = lambda df: df.select(F.col(key).alias("_key"), F.col(at).alias("_at"), F.struct("*").alias("_row"))
    said, known = whole(events), whole(versions).filter("_key is not null and _at is not null")
    placed = lambda df: df.withColumn("_us", times.micros(df, "_at")).withColumn("_part", F.expr(f"(_us - pmod(_us, {stretch}L)) div {stretch}L"))
    none = F.lit(None)
    nowhere = said.filter("_key is null or _at is null").select("_row", none.cast(kind).alias("version"))
    said = placed(said.filter("_key is not null and _at is not null")).select("_key", "_part", "_at", F.lit(1).alias("_kind"), "_row", none.cast(kind).alias("_v"))
    known = placed(known).withColumn("_tie", F.col(f"_row.{tie}"))
    as_rows = known.select("_key", "_part", "_at", F.lit(0).alias("_kind"), none.cast(events.select(F.struct("*").alias("r")).schema["r"].dataType).alias("_row"), F.col("_row").alias("_v"), "_tie")
    both = said.withColumn("_tie", none.cast(known.schema["_tie"].dataType)).unionByName(as_rows)
    within = Window.partitionBy("_key", "_part").orderBy("_at", "_kind", "_tie").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = both.withColumn("_near", F.last("_v", ignorenulls=True).over(within)).filter("_kind = 1").select("_key", "_part", "_row", "_near")
    # A row for each stretch of a key that has versions or events: what the versions before it leave valid.
    ends = known.groupBy("_key", "_part").agg(F.max_by("_row", F.struct("_at", "_tie")).alias("_end"))
    asked = said.select("_key", "_part", none.cast(kind).alias("_end"))
    stretches = ends.unionByName(asked.distinct()).groupBy("_key", "_part").agg(F.max_by("_end", F.col("_end").isNotNull()).alias("_end"))
    before = Window.partitionBy("_key").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    carried = stretches.withColumn("_carried", F.last("_end", ignorenulls=True).over(before)).filter("_carried is not null").select("_key", "_part", "_carried")
    found = rows.join(carried, ["_key", "_part"], "left").select("_row", F.coalesce("_near", "_carried").alias("version"))
    return found.unionByName(nowhere).select("_row.*", "version")

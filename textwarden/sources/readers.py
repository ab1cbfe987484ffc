"""Samples, uploads and recorded model outputs."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bounds of an inline text and of an upload.
MAX_CHARS, MAX_BYTES = 30_000, 5_000_000


def samples(spark: SparkSession, path: str) -> DataFrame:
    """Sample documents: one JSON object a file, by name."""
    return spark.read.json(path, multiLine=True).withColumn("file", F.col("_metadata.file_name")).orderBy("file")


def sample(spark: SparkSession, path: str, name: str) -> DataFrame:
    """The one sample `name`.json of a folder: no other file is opened. A name that isn't one file's own, or a missing file, is an error."""
    return spark.read.json(f"{path}/{_plain(name)}.json", multiLine=True)


def _plain(name: str) -> str:
    if not re.fullmatch(r"[A-Za-z0-9_-]+", name):
        raise ValueError(f"not a file's name: {name!r}")
    return name


def ingest(texts: DataFrame, languages: list[str]) -> DataFrame:
    """texts (source, language, patient_name) with `error`: why a row can't be taken, else null."""
    error = (
        F.when(F.length(F.btrim(F.coalesce("source", F.lit("")))) == 0, "empty")
        .when(F.char_length("source") > MAX_CHARS, "too long")
        .when(~F.col("language").isin(*languages) & ~F.col("language").rlike("^[a-z]{2,3}(-[A-Za-z]{2,4})?$"), "language")
        .when(F.char_length("patient_name") > 200, "name")
    )
    return texts.withColumn("error", error)


def uploads(spark: SparkSession, path: str) -> DataFrame:
    """Files as text, with `error`: 'too large' over MAX_BYTES, whose text is null. Bytes that are no UTF-8 become U+FFFD. PDFs are left to a reader of their own (null text)."""
    files = spark.read.format("binaryFile").load(path)
    error = F.when(F.col("length") > MAX_BYTES, "too large")
    text = F.when(error.isNull() & ~F.lower("path").endswith(".pdf"), F.make_valid_utf8(F.col("content").cast("string")))
    return files.select("path", "length", error.alias("error"), text.alias("text"))


def replayable(spark: SparkSession, path: str) -> DataFrame:
    """case_id, source, model, note of recorded outputs, from each file's `_meta`; the run's summary is none of them."""
    files = spark.read.text(path, wholetext=True).select(F.regexp_extract(F.col("_metadata.file_name"), r"^(.*)\.json$", 1).alias("case_id"), F.try_parse_json("value").alias("v"))
    field = lambda name: F.expr(f"try_variant_get(v, '$._meta.{name}', 'string')").alias(name)
    return files.filter("case_id <> 'summary'").select("case_id", field("source"), field("model"), field("note"))


def lenient_json(text: Column) -> Column:
    """VARIANT of a model's answer: inside a code fence, else from the first bracket on; null if that fails too."""
    fenced = F.nullif(F.regexp_extract(text, r"(?s)```(?:json)?\s*(.*?)```", 1), F.lit(""))
    starts = F.array_min(F.filter(F.array(F.instr(text, "{"), F.instr(text, "[")), lambda i: i > 0))
    return F.coalesce(F.try_parse_json(fenced), F.try_parse_json(F.substring(text, starts, F.length(text))))


def replay(spark: SparkSession, path: str) -> DataFrame:
    """case_id, stage, key, payload, seconds: recorded outputs, one JSON file a case, with their timing."""
    files = spark.read.text(path, wholetext=True).select(F.regexp_extract(F.col("_metadata.file_name"), r"^(.*)\.json$", 1).alias("case_id"), F.try_parse_json("value").alias("v"))
    files = files.filter("case_id <> 'summary'")
    stages = files.selectExpr("case_id", "v", "explode(try_variant_get(v, '$', 'map<string, variant>')) as (stage, by_key)").filter(~F.startswith("stage", F.lit("_")))
    rows = stages.selectExpr("case_id", "v", "stage", "explode(try_variant_get(by_key, '$', 'map<string, variant>')) as (key, payload)")
    seconds = "try_variant_get(try_variant_get(v, '$._timings', 'map<string, variant>')[stage || ':' || key], '$.seconds', 'double') as seconds"
    return rows.selectExpr("case_id", "stage", "key", "to_json(payload) as payload", seconds)


def replayed(spark: SparkSession, path: str, case_id: str, stage: str, key: str) -> DataFrame:
    """One recorded output, from its case's file alone. A case without a file is an error at once, a stage or key that it lacks when the row is read."""
    rows = replay(spark, f"{path}/{_plain(case_id)}.json").filter((F.col("stage") == stage) & (F.col("key") == key))
    found = rows.groupBy().agg(F.first(F.struct(*rows.columns)).alias("_row"))
    missing = F.raise_error(F.lit(f"recorded run of {case_id} has no {stage}/{key} output"))
    return found.select(F.when(F.col("_row").isNull(), missing.cast(found.schema["_row"].dataType)).otherwise(F.col("_row")).alias("_row")).select("_row.*")


def merged(runs: DataFrame, keys: list[str], by: list[str]) -> DataFrame:
    """Of each key the row of the last run, in the order of `by`."""
    return runs.groupBy(*keys).agg(F.max_by(F.struct(*runs.columns), F.struct(*by)).alias("_row")).select("_row.*")


def with_timings(run: DataFrame, earlier: DataFrame, keys: list[str]) -> DataFrame:
    """The rows of a run; seconds that it lacks are those of an earlier run."""
    before = earlier.groupBy(*keys).agg(F.max("seconds").alias("_seconds"))
    return run.join(before, keys, "left").withColumn("seconds", F.coalesce("seconds", "_seconds")).drop("_seconds")

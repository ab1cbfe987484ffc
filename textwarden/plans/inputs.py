"""Facts, sentences, verdicts and packets projected from the driver's tables, in Spark and as SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..sources.stores import stored_by

DRUGS = ["lisinopril", "warfarin", "metoprolol", "insulin", "furosemide", "omeprazole", "oxycodone"]
UNITS = ["mg", "mcg", "ml", "units", "tablets"]
ACTIONS = ["new", "changed", "continue", "stop", "hold"]
LABELS = ["NEW", "CHANGED", "CONTINUE", "STOP", "HOLD"]

ERRORS = {0: "number_x10", 1: "wrong_medicine", 2: "flip", 3: "uncited", 4: "other_unit"}


def pick(values: list[str], index: str) -> str:
    """A SQL expression both engines run: the value at index (0-based)."""
    return f"CASE {index} " + " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values)) + " END"


_DOSE = "(p_size + 2)"
_DRUG, _UNIT, _ACTION, _LABEL = pick(DRUGS, "(p_partkey % 7)"), pick(UNITS, "(p_partkey % 5)"), pick(ACTIONS, "(CAST(floor(p_partkey / 5) AS BIGINT) % 5)"), pick(LABELS, "(CAST(floor(p_partkey / 5) AS BIGINT) % 5)")

_FACT = f"""p_partkey, concat('F', CAST(p_partkey AS VARCHAR(20))) AS fact_id, 'medication' AS kind, {_ACTION} AS med_action, {_DRUG} AS drug,
       {_DOSE} AS dose_n, {_UNIT} AS unit, concat(CAST({_DOSE} AS VARCHAR(20)), ' ', {_UNIT}) AS dose, 'twice daily' AS frequency, '' AS detail,
       concat({_LABEL}, ': ', {_DRUG}, ' ', CAST({_DOSE} AS VARCHAR(20)), ' ', {_UNIT}, ' twice daily') AS source_quote"""

#: part as facts: fact_id, p_partkey, kind, med_action, drug, dose_n, unit, dose, frequency, detail, source_quote.
FACTS = f"""
SELECT {_FACT}
FROM part
"""

_K = "((l_orderkey * 7 + l_linenumber) % 13)"
_LINE = f"l_orderkey AS case_id, l_linenumber AS line, {_K} AS k"


def _said(lines: str, more: str = "") -> str:
    return f"""
SELECT {more}case_id, line, p_partkey, fact_id, k, med_action, drug, dose_n, unit,
       concat(
         CASE WHEN k = 2 AND med_action IN ('stop', 'hold') THEN 'Keep taking ' WHEN k = 2 THEN 'Stop taking '
              WHEN med_action IN ('new', 'changed') THEN 'Take ' WHEN med_action = 'continue' THEN 'Keep taking '
              WHEN med_action = 'stop' THEN 'Stop taking ' ELSE 'Hold ' END,
         CASE WHEN k = 1 THEN {pick(DRUGS, "((p_partkey + 1) % 7)")} ELSE drug END, ' ',
         CAST(CASE WHEN k = 0 THEN dose_n * 10 ELSE dose_n END AS VARCHAR(20)), ' ',
         CASE WHEN k = 4 THEN {pick(UNITS, "((p_partkey + 1) % 5)")} ELSE unit END,
         CASE WHEN k = 2 THEN '.' WHEN med_action IN ('stop') THEN '.' WHEN med_action = 'hold' THEN ' until your visit.' ELSE ' twice daily.' END) AS text_en
FROM ({lines}) s
"""


#: lineitem as sentences: each cites its part's fact; of 13, one each has the errors 0 to 4 (column k).
SENTENCES = _said(f"SELECT {_LINE}, f.* FROM lineitem JOIN ({FACTS}) f ON l_partkey = p_partkey")


def load(spark: SparkSession, sf_dir: str, *names: str) -> None:
    for name in names:
        spark.read.parquet(f"{sf_dir}/{name}.parquet").createOrReplaceTempView(name)


def spark_sql(text: str) -> str:
    return text.replace("AS VARCHAR(20)", "AS STRING")


#: Lines that a bucket of lines_by_case() is made for.
BUCKET_LINES = 400_000


def buckets_of(spark: SparkSession, sf_dir: str) -> int:
    """The buckets that lines_by_case() stores lines in."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").count()
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-lines // BUCKET_LINES))


def lines_by_case(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem with its part's size, as keys alone, stored once in buckets of orders: what is made from it by case needs no shuffle.

    l_orderkey, l_linenumber, p_partkey, p_size, n (place among the order's lines) and first (of the order's lines with that part).
    """
    load(spark, sf_dir, "lineitem", "part")
    # Parts are many at size though their file is small: they are not sent through the driver.
    rows = spark.sql("SELECT /*+ MERGE(part) */ l_orderkey, l_linenumber, p_partkey, p_size FROM lineitem JOIN part ON l_partkey = p_partkey")
    buckets = buckets_of(spark, sf_dir)
    rows = rows.repartition(buckets, "l_orderkey").selectExpr(
        "*",
        "row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, p_partkey) AS n",
        "row_number() OVER (PARTITION BY l_orderkey, p_partkey, p_size ORDER BY l_linenumber) = 1 AS first",
    )
    return stored_by(rows, "l_orderkey", buckets)


def facts_of_cases(spark: SparkSession, sf_dir: str, told: Callable[[DataFrame], DataFrame] = lambda own: own, lines: DataFrame | None = None) -> DataFrame:
    """The facts of each order's parts: case_id and what `told` makes of the columns of FACTS (p_partkey kept) where a part's fact is one row.

    lines (lines_by_case): its facts stay by case; `told` isn't asked then.
    """
    if lines is not None:
        return spark.sql(spark_sql(f"SELECT l_orderkey AS case_id, {_FACT} FROM {{lines}} WHERE first"), lines=lines)
    load(spark, sf_dir, "lineitem", "part")
    keys = spark.sql("SELECT DISTINCT l_orderkey AS case_id, l_partkey AS p_partkey FROM lineitem")
    return keys.join(told(spark.sql(spark_sql(FACTS))), "p_partkey")


def sentences(spark: SparkSession, sf_dir: str, lines: DataFrame | None = None) -> DataFrame:
    """case_id, sent_id (place among the order's lines), fact_ids, text_en and the columns of SENTENCES; by case where lines (lines_by_case) are given."""
    if lines is None:
        load(spark, sf_dir, "lineitem", "part")
        # Numbered while they are narrow: lines that are equal in these keys have equal texts.
        numbered = "(SELECT l_orderkey, l_linenumber, l_partkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS n FROM lineitem)"
        rows = spark.sql(spark_sql(_said(f"SELECT n, {_LINE}, f.* FROM {numbered} JOIN ({FACTS}) f ON l_partkey = p_partkey", "n, ")))
    else:
        rows = spark.sql(spark_sql(_said(f"SELECT n, {_LINE}, {_FACT} FROM {{lines}}", "n, ")), lines=lines)
    return rows.selectExpr("* EXCEPT (n)", "concat('S', n) as sent_id", "if(k = 3, cast(array() as array<string>), array(fact_id)) as fact_ids")


#: What the checks of these sentences must say, from the errors alone: no text is read.
EXPECTED = f"""
SELECT s.*,
  CASE WHEN k = 3 THEN 'fail' ELSE 'pass' END AS citation,
  CASE WHEN k IN (0, 3) THEN 'fail' ELSE 'pass' END AS numbers,
  CASE WHEN k = 1 THEN 'fail' WHEN k = 3 THEN 'warn' END AS drug_check,
  CASE WHEN k = 2 AND med_action IN ('stop', 'hold', 'continue') THEN 'fail' WHEN k = 2 THEN 'warn' END AS polarity,
  CASE WHEN k = 4 THEN 'fail' END AS units,
  CASE WHEN k IN (0, 1, 3, 4) OR (k = 2 AND med_action IN ('stop', 'hold', 'continue')) THEN 'red' WHEN k = 2 THEN 'amber' ELSE 'green' END AS status,
  CASE WHEN k <> 3 AND (med_action IN ('stop', 'hold', 'changed') OR drug IN ('warfarin', 'insulin', 'oxycodone')) THEN 'high' ELSE 'normal' END AS risk
FROM ({SENTENCES}) s
"""

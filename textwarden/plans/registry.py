"""Where queries are registered, and how their inputs are made from keys so that SQL can say what must come out."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..sources.shipping import ship

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Cores that are counted on before executors have come: until then a cluster's parallelism reads 2.
CORES = 12


def spread(df: DataFrame) -> DataFrame:
    """df, dealt out evenly where its files give fewer than four tasks for each core: for work that costs far more than a shuffle of its rows.

    A file's parts may be large for such work, few, and hold uneven numbers of row groups.
    """
    least = 4 * max(df.sparkSession.sparkContext.defaultParallelism, CORES)
    return df.repartition(least) if df.rdd.getNumPartitions() < least else df


def written(template: str, values: dict[str, str]) -> str:
    """A SQL expression both engines run: the template with {name} replaced by an expression's value."""
    parts = [p for p in re.split(r"(\{\w+\}|\n|')", template) if p]
    out = ["''"]
    for p in parts:
        out.append({"\n": "chr(10)", "'": "chr(39)"}.get(p) or (f"CAST({values[p[1:-1]]} AS VARCHAR(20))" if re.fullmatch(r"\{\w+\}", p) else f"'{p}'"))
    return f"concat({', '.join(out)})"


def chosen(templates: list[str], index: str, values: dict[str, str] | None = None) -> str:
    """A SQL expression: the template at index (0-based), written."""
    return f"CASE {index} " + " ".join(f"WHEN {i} THEN {written(t, values or {})}" for i, t in enumerate(templates)) + " END"


def rows_of(spark: SparkSession, sf_dir: str, sql: str, *tables: str) -> DataFrame:
    """A projection, written for both engines, of the named tables.

    Its texts are far larger than the files of keys that they are made from, and costly to read: keys are dealt out while they are narrow, and no
    join takes the files' size for that of the texts and sends them through the driver.
    """
    for name in tables:
        spread(table(spark, sf_dir, name)).createOrReplaceTempView(name)
    return spark.sql(sql.replace("AS VARCHAR(20)", "AS STRING")).hint("merge")

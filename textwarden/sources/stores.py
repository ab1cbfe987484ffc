"""Intermediate rows that several later steps read."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame


def stored(df: DataFrame) -> DataFrame:
    """df, computed once: written to a new folder that driver and executors share, and read from there."""
    from ..streaming.streams import new_folder

    path = f"{new_folder(df.sparkSession)}/t"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def stored_by(df: DataFrame, column: str, buckets: int) -> DataFrame:
    """df, dealt out by a column into so many parts, stored() as a table of as many buckets: what groups by the column or meets on it later needs no shuffle of df.

    Buckets should be no fewer than Spark's shuffle partitions, or joins may shuffle them. The files are removed when the driver ends.
    """
    from ..streaming.streams import new_folder

    spark = df.sparkSession
    path = new_folder(spark)
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    name = f"textwarden_{uuid.uuid4().hex}"
    df.write.format("parquet").option("compression", "zstd").option("path", f"{path}/t").bucketBy(buckets, column).sortBy(column).saveAsTable(name)
    hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(hadoop_path)
    return spark.table(name)


def together(column: str, *parts: DataFrame) -> DataFrame:
    """All rows of parts, by name; parts that are there by the column (stored_by) stay so.

    Spark sees that only where the column is named anew in each part.
    """
    new = f"_{column}"
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), (p.withColumnRenamed(column, new) for p in parts)).withColumnRenamed(new, column)

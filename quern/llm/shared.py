"""Work tables in the folder that driver and executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; where it is unset, one under the session's warehouse."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        named = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/quern-work"
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


def place(spark: SparkSession, name: str) -> str:
    """A new path for one work table."""
    return f"{folder(spark)}/quern-{name}-{uuid.uuid4().hex[:12]}"


def saved(df: DataFrame, name: str) -> DataFrame:
    """Writes a work table as Parquet and reads it back: lineage ends here, and no later branch computes it again."""
    path = place(df.sparkSession, name)
    schema = df.schema
    df.write.parquet(path)
    return df.sparkSession.read.schema(schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a work table through the file system that holds it."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)

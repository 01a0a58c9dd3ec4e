"""Session settings used by tests, bench and examples; a running session keeps its own."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = "*", memory: str = "8g") -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("quern")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; where it is unset, one under the session's warehouse.

    Driver and executors share both; a machine-local temporary folder is never used.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    return (named or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/quern-work").rstrip("/")


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """A copy of ``df`` written as Parquet in the shared folder: later plans read the columns they need from it instead
    of computing ``df`` anew. A frame is written once, however often it is asked for.

    Column names go through the file as numbers, so that any name is allowed and names may clash.
    """
    copy = getattr(df, "_quern_copy", None)
    if copy is not None:
        return copy
    kinds = [f.dataType.simpleString() for f in df.schema.fields]
    if any("void" in k or k == "interval" for k in kinds):  # types that Parquet lacks
        copy = cut_lineage(df)
    else:
        path = f"{shared_folder(df.sparkSession)}/quern-stored-{uuid.uuid4().hex[:12]}"
        plain = df.toDF(*[f"c{i}" for i in range(len(kinds))])
        plain.write.parquet(path)
        copy = df.sparkSession.read.schema(plain.schema).parquet(path).toDF(*df.columns)
    df._quern_copy = copy._quern_copy = copy
    return copy

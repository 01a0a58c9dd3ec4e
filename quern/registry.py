"""Query registry: one name, one DataFrame function over the tables, optionally one SQL text to compare with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType, DoubleType, FloatType

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


class Tables:
    """Lazy access to the parquet tables of one folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder.rstrip("/")

    def path(self, name: str) -> str:
        return f"{self.folder}/{name}.parquet"

    def __getattr__(self, name: str) -> DataFrame:
        if name not in TABLES:
            raise AttributeError(name)
        return self.spark.read.parquet(self.path(name))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _single(df: DataFrame, cols: list[str]) -> DataFrame:
    # adding 0.0 turns -0.0 into 0.0
    return df.withColumns({c: F.col(c).cast("float").cast("double") + F.lit(0.0) for c in cols})


def query(name: str, sql: str | None = None, f: str = ""):
    """Register a query.

    ``f`` lists computed fractional columns. Sums of doubles depend on the order of addition, so both sides
    pass these through single precision before they are compared.
    """

    def add(fn: Callable[[Tables], DataFrame]):
        cols = f.split()

        def run(spark: SparkSession, folder: str) -> DataFrame:
            out = fn(Tables(spark, folder))
            return _single(out, cols) if cols else out

        run.__name__ = name
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = run
        if sql is not None:
            text = sql.strip()
            if cols:
                fix = ", ".join(f'CAST(CAST("{c}" AS FLOAT) AS DOUBLE) + 0.0 AS "{c}"' for c in cols)
                text = f"SELECT * REPLACE ({fix}) FROM (\n{text}\n) AS result"
            ORACLES[name] = text
        return fn

    return add


def fractional(df: DataFrame) -> list[str]:
    """Names of float, double and decimal columns."""
    return [x.name for x in df.schema if isinstance(x.dataType, (DoubleType, FloatType, DecimalType))]

"""Readers and writers for the file layouts of tabular projects."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quern.session import shared_folder


_made: list[tuple[SparkSession, str]] = []


def work_folder(spark: SparkSession, name: str) -> str:
    """A new folder name under the shared folder; :func:`clear_work` removes what was made there."""
    path = f"{shared_folder(spark)}/quern-{name}-{uuid.uuid4().hex}"
    _made.append((spark, path))
    return path


def clear_work() -> None:
    """Remove the work folders handed out so far, through the file system that holds them."""
    while _made:
        spark, path = _made.pop()
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def scan_csv(
    spark: SparkSession, path: str | Sequence[str], schema: StructType | str, header: bool = True, encoding: str = "UTF-8",
    names: Sequence[str] | None = None, date_format: str | None = None,
) -> DataFrame:
    """CSV with a declared schema; headerless files get their names from ``names``."""
    reader = spark.read.schema(schema).option("header", header).option("encoding", encoding)
    if date_format:
        reader = reader.option("dateFormat", date_format).option("timestampFormat", date_format)
    df = reader.csv(path)
    return df.toDF(*names) if names else df


def scan_parquet(spark: SparkSession, path: str, columns: Sequence[str]) -> DataFrame:
    """Chosen columns only; the scan reads no others."""
    return spark.read.parquet(path).select(*columns)


def source_name(pattern: str) -> Column:
    """First group of a pattern in the path of the row's file."""
    return F.regexp_extract(F.input_file_name(), pattern, 1)


def scan_multi_split(spark: SparkSession, root: str, name: str, schema: StructType | str) -> DataFrame:
    """The same file name from every split folder under ``root``, with the folder name as ``split``."""
    df = spark.read.schema(schema).option("header", True).csv(f"{root}/*/{name}")
    return df.withColumn("split", source_name(r"/([^/]+)/" + name.replace(".", r"\.") + r"(?:/[^/]*)?$"))


def scan_entity_files(spark: SparkSession, root: str, kind: str, schema: StructType | str) -> DataFrame:
    """One file ``<entity>__<kind>`` per entity; the entity id comes from the file name."""
    df = spark.read.schema(schema).option("header", True).csv(f"{root}/*__{kind}*")
    return df.withColumn("entity", source_name(r"/([^/]+)__" + kind))


def list_files(spark: SparkSession, pattern: str) -> DataFrame:
    """Paths and sizes only: the content column is pruned away."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.csv").load(pattern).select("path", "length")


def entity_inventory(a: DataFrame, b: DataFrame) -> DataFrame:
    """Ids of two file kinds and whether each has both."""
    left = a.groupBy("entity").agg(F.count(F.lit(1)).alias("rows_a"))
    right = b.groupBy("entity").agg(F.count(F.lit(1)).alias("rows_b"))
    j = left.join(right, "entity", "full")
    return j.withColumn("complete", (F.col("rows_a").isNotNull() & F.col("rows_b").isNotNull()).cast("int"))


def pool_listing(spark: SparkSession, root: str, lowest: float = 0.0, highest: float = 1.0) -> DataFrame:
    """Prediction files under ``root``: group = parent folder, score parsed from the file name, reason if rejected."""
    files = list_files(spark, root)
    folder = F.element_at(F.split("path", "/"), -2)
    is_part = F.regexp_like("path", F.lit(r"/part-[^/]*$"))
    name = F.when(is_part, folder).otherwise(F.element_at(F.split("path", "/"), -1))
    group = F.when(is_part, F.element_at(F.split("path", "/"), -3)).otherwise(folder)
    score = F.regexp_extract(name, r"(\d\.\d+)", 1).try_cast("double")
    reason = F.when(score.isNull(), "no_score").when((score < lowest) | (score > highest), "score_range").when(F.col("length") == 0, "empty").otherwise("ok")
    return files.select("path", name.alias("model"), group.alias("group"), score.alias("score"), reason.alias("reason"))


def scan_pool(spark: SparkSession, root: str, lowest: float = 0.0, highest: float = 1.0) -> DataFrame:
    """Accepted prediction files as long rows (group, model, score, id, value).

    The listing (one row per file) comes to the driver as a listing of any scan does; rejected files are not opened.
    """
    listing = pool_listing(spark, root, lowest, highest).where("reason = 'ok'").drop("reason")
    paths = [r["path"] for r in listing.select("path").collect()]
    if not paths:
        return listing.select("group", "model", "score", F.lit(None).cast("long").alias("id"), F.lit(None).cast("double").alias("value")).limit(0)
    rows = spark.read.schema("id long, value double").option("header", True).csv(paths).withColumn("path", F.input_file_name())
    clean = lambda p: F.regexp_replace(p, "^file:/+", "/")
    return rows.withColumn("path", clean("path")).join(listing.withColumn("path", clean("path")), "path").select("group", "model", "score", "id", "value")


def sink_stage(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> DataFrame:
    """Write a stage and hand back a frame that reads it."""
    w = df.write.mode("overwrite")
    (w.partitionBy(*partition_by) if partition_by else w).parquet(path)
    return df.sparkSession.read.parquet(path)


def sink_submission(df: DataFrame, sample: DataFrame, id_col: str, value: str, pos: str, path: str, lo: float = 0.0, hi: float = 1.0) -> DataFrame:
    """Predictions in the sample's order after checks: unique ids, none missing or extra, no nulls, inside the range."""
    p, s = df.select(id_col, value), sample.select(id_col, pos)
    per = p.groupBy(id_col).agg(F.count(F.lit(1)).alias("k"), F.max(value).alias(value))
    j = s.withColumn("_s", F.lit(1)).join(per, id_col, "full")
    n = lambda c: F.coalesce(F.sum(c.cast("int")), F.lit(0))
    bad = j.agg(
        n(F.col("k") > 1).alias("duplicate_ids"), n(F.col("k").isNull()).alias("missing_ids"), n(F.col("_s").isNull()).alias("extra_ids"),
        n(F.col("k").isNotNull() & F.col(value).isNull()).alias("nulls"), n((F.col(value) < lo) | (F.col(value) > hi) | F.isnan(value)).alias("out_of_range"),
    ).first().asDict()
    bad = {k: v for k, v in bad.items() if v}
    if bad:
        raise ValueError(f"submission rejected: {bad}")
    out = s.join(p, id_col, "left").orderBy(pos).select(id_col, value)
    out.write.mode("overwrite").option("header", True).csv(path)
    return df.sparkSession.read.schema(out.schema).option("header", True).csv(path)


def fingerprint(sources: Sequence[DataFrame], parameters: object = None) -> str:
    """Key of a stage: schemas, input files with size and time, and the parameters it was built with."""
    parts = [repr(parameters)]
    for df in sources:
        parts.append(df.schema.json())
        for f in sorted(df.inputFiles()):
            p = df.sparkSession._jvm.org.apache.hadoop.fs.Path(f)
            st = p.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).getFileStatus(p)
            parts.append(f"{f} {st.getLen()} {st.getModificationTime()}")
    return hashlib.sha256("\n".join(parts).encode()).hexdigest()[:32]


def stage_cache(spark: SparkSession, path: str, build: Callable[[], DataFrame], key: str = "") -> DataFrame:
    """Read the stage if it is complete and was built under the same key, else build and write it."""
    full = f"{path}/{key}" if key else path
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(f"{full}/_SUCCESS")
    if not hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
        build().write.mode("overwrite").parquet(full)
    return spark.read.parquet(full)


def load_optional_external(main: DataFrame, external: DataFrame | None, sentinel: Column | None = None) -> DataFrame:
    """Append external rows if there are any: aligned to the main columns, flagged, sentinel rows dropped."""
    base = main.withColumn("is_external", F.lit(0))
    if external is None:
        return base
    ext = external if sentinel is None else external.where(~F.coalesce(sentinel, F.lit(False)))
    ext = ext.select(*[F.col(c).cast(main.schema[c].dataType) for c in main.columns if c in ext.columns]).withColumn("is_external", F.lit(1))
    return base.unionByName(ext, allowMissingColumns=True)

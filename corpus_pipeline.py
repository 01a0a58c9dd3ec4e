"""From raw documents to packed token sequences: language, toxicity, near copies, benchmark passages, packing.

Each stage takes ``(spark, docs, sf_dir)`` and works on all rows that its predecessor kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm import decontam, langid, packing, similar, toxicity
from quern.llm.queries import tokenizer_path
from quern.llm.shared import saved

ABOVE_CHANCE = 0.05  # a language is recognised if its pooled probability is so far from a blind guess towards certainty


def _but(docs: DataFrame, *names: str) -> list:
    return [F.col(f"`{c}`") for c in docs.columns if c not in names]


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents without a letter and those of no recognised language.

    Without a single labelled row to learn from only the former go.
    """
    model = langid.train(langid.sample(docs.where(~langid.held_out()), "text", "lang"))
    if model is None:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    named = langid.predict(docs, model, "text", "__pred", "__score")
    chance = 1 / len(model["names"])
    least = 0.0 if chance == 1 else chance + ABOVE_CHANCE * (1 - chance)
    return named.where((F.col("__pred") != langid.UNKNOWN) & (F.col("__score") >= least)).drop("__pred", "__score")


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents that score one half or more."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = toxicity.train(toxicity.sample(docs, labels, "text", "doc_id", "toxic"))
    return toxicity.score(docs, model, "text", "__score").where("__score < 0.5").drop("__score")


def _keyed(docs: DataFrame) -> DataFrame:
    """Rows with a key of their own, by identifier and text: identifiers may be null or shared by different texts."""
    return docs.withColumn("__key", F.xxhash64(F.col("doc_id").isNull(), "doc_id", F.coalesce("text", F.lit(""))))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group of texts joined by a five-word similarity of 0.8 or more (see ``similar``).

    That with the smallest identifier stays, then the smallest key. Rows without identifier are judged among themselves:
    one of them stays beside the one with. Different texts that share an identifier are documents of their own.
    """
    rows = docs.withColumn("__key", similar.row_key())
    near = saved(similar.near_copies(docs).withColumnRenamed("key", "__key"), "groups")
    first = F.min(F.struct("doc_id", "__key")).alias("first")
    kept = saved(rows.select("doc_id", "__key").join(near, "__key").groupBy("component", F.col("doc_id").isNull()).agg(first).select("first.__key"), "kept")
    return rows.join(kept, "__key", "left_semi").dropDuplicates(["__key"]).select(*_but(docs))


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects rows that hold a benchmark item, each judged by its own text."""
    rows = _keyed(docs)
    found = decontam.flagged(rows, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), doc_id="__key")
    return rows.join(found.select(F.col("doc_id").alias("__key")), "__key", "left_anti").select(*_but(docs))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The kept documents as pieces of sequences."""
    return packing.pack_documents(docs, tokenizer_path())


STAGES = [("language ID", language), ("toxicity", toxic), ("near dedup", near_copies), ("decontamination", clean), ("packing", packed)]

#: Three stages are trained or exact-search operators that SQL cannot express; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = saved(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs

"""Corpus preparation in five stages, each a function (spark, docs, sf_dir) -> DataFrame.

``run`` applies them to the table ``documents``; what a stage returns is written as Parquet
to the shared folder and read again as the next stage's ``docs``. All but the last return the
columns of their input, whatever these are.

1. ``toxicity``: documents that the toxicity model rejects go.
2. ``near_duplicates``: of each class of documents linked by 5-word shingles at a
   Jaccard similarity of 0.8, the one with the smallest id stays.
3. ``decontamination``: spans of benchmark items go; so do documents that consist mostly of them.
4. ``secrets``: secrets are replaced by a mark.
5. ``packing``: the remaining documents as pieces in token sequences.

Rows with a null id count as having the largest id, rows with a null text as empty; rows that
agree in id and text are one document from stage 2 on. Empty tables pass through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from retentio.llm import decontaminate, jaccard_join, packing, secrets, toxicity
from retentio.llm.common import Scratch, fold, prepare, read


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the model, learnt from the labelled rows outside fold 0, does not reject."""
    prepare(spark)
    labels = read(spark, sf_dir, "labels").filter(fold(F.col("doc_id")) != 0)
    return toxicity.keep_clean(docs, toxicity.fit(docs, labels))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates: the one of smallest id, then hash of the text."""
    prepare(spark)
    classed, _ = jaccard_join.classes(docs)
    named = classed.select(F.col("doc_id").alias("_id"), F.col("tkey").alias("_text_key"), F.col("class").alias("_class"))
    # Of each class only the smallest (id, key) goes on; a row without words is a class of its own.
    least = named.filter("_class is not null").groupBy("_class").agg(
        F.min(F.struct(F.col("_id").isNull().alias("none"), "_id", "_text_key")).alias("least"))
    kept = least.select("least._id", "least._text_key").unionByName(
        named.filter("_class is null").select("_id", "_text_key").distinct())
    row_key = lambda name: F.xxhash64(F.coalesce(F.col(name).cast("string"), F.lit("")), F.col(name).isNull())
    keyed = docs.withColumn("_text_key", F.xxhash64("text")).withColumn("_row_key", row_key("doc_id"))
    found = keyed.join(kept.select("_text_key", row_key("_id").alias("_row_key")), ["_row_key", "_text_key"], "left_semi")
    # Repeated rows agree in id and text; one of them stays. The join has put them together already.
    first = Window.partitionBy("_row_key", "_text_key").orderBy(F.lit(1))
    return found.withColumn("_nth", F.row_number().over(first)).filter("_nth = 1").select(*docs.columns)


def remove_benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without benchmark passages; documents of which more than half is such passages go."""
    prepare(spark)
    length = "n_chars" if "n_chars" in docs.columns else None
    return decontaminate.clean(docs, read(spark, sf_dir, "benchmark"), length_col=length)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with every secret replaced by a mark; no document goes."""
    prepare(spark)
    length = "n_chars" if "n_chars" in docs.columns else None
    return secrets.redact(docs, secrets.fit(docs), length_col=length)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents as pieces of at most 2048 ids, and the sequence and place of each."""
    prepare(spark)
    return packing.pack(docs)


STAGES = [
    ("toxicity", reject_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", remove_benchmarks),
    ("secrets", mask_secrets),
    ("packing", pack_sequences),
]

#: Trained models, tokenizers and packing have no SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed pieces of what all stages keep of ``documents``."""
    docs = read(spark, sf_dir, "documents")
    scratch = Scratch(spark, "pipeline")
    for name, stage in STAGES:
        docs = scratch.store(stage(spark, docs, sf_dir), name)
    return docs

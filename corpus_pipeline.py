"""The corpus pipeline: five stages over ``documents``, each one operator whose decisions take effect.

Each stage reads what its predecessor kept, written as Parquet in the folder that all executors share, so a lost executor costs a
stage's tasks and never the stages before.  All stages but the last return the columns of ``documents``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from taxloom.llm import crf_langid, decontaminate, line_dedup, order_minhash, packing
from taxloom.llm.common import load, materialize, shared_dir, small
from taxloom.llm.queries import packing_input

#: A text whose best language has a lower mean marginal than this is in none of the learned languages.
LEAST_LANGUAGE_SCORE = 0.5


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the CRF knows; texts without letters and those it can't tell go."""
    model = crf_langid.fit(docs)
    judged = crf_langid.predict(docs, model, lang="_lang_pred", score="_lang_score")
    known = (F.col("_lang_pred") != crf_langid.UNKNOWN) & (F.col("_lang_score") >= LEAST_LANGUAGE_SCORE)
    return judged.where(known).select(*docs.columns)


def line_cleaning(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the boilerplate lines of their source; ``n_chars`` follows the text.  Documents of nothing else stay whole: copies
    of one text, about which the next stage decides."""
    return line_dedup.drop_boilerplate(docs, keep_whole=True).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each near-duplicate class, one row of it with the text by which it was judged (any, if those rows
    differ in case or white space); rows with a null id stay."""
    classes = materialize(order_minhash.near_duplicates(docs).select("doc_id", "class_id", F.col("text_key").alias("_key")), "classes")
    gone = classes.where("doc_id <> class_id").select("doc_id")
    if classes.count() == docs.where("doc_id is not null").count():  # ids are unique
        return docs.join(small(gone, gone.count()), "doc_id", "left_anti").select(*docs.columns)
    stays = classes.where("doc_id = class_id").select("doc_id", "_key")
    rows = docs.where("doc_id is not null").withColumn("_key", order_minhash.text_key(F.col("text"))).dropDuplicates(["doc_id", "_key"])
    return rows.join(stays, ["doc_id", "_key"], "left_semi").select(*docs.columns).unionByName(docs.where("doc_id is null"))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item is found."""
    return decontaminate.without_benchmark(docs, load(spark, sf_dir, "benchmark"))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents with their bins."""
    return packing.pack_documents(packing_input(docs))


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_cleaning),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("packing", best_fit_packing),
]

#: SQL can't express a conditional random field or best-fit packing.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    where = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{where}/{name}")
        docs = spark.read.parquet(f"{where}/{name}")
    return docs

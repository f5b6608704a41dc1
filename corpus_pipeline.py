"""The corpus pipeline: STAGES, and run(), which applies them to documents.

Each stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept; all but the last return the columns
of documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm import ngram_join, packing, pfair_mix, quality_mil, queries, secret_scan
from textloom.llm.common import discard, scratch, with_row_key

#: The key of a row in drop_near_duplicates.
KEY = "__row_key"


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects (a score below 0.5) go."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = quality_mil.train(docs, labels.where(~quality_mil.held_out("doc_id")))
    scored = quality_mil.score(docs, model, score_col="__score")
    return scored.where("__score >= 0.5").select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents the one with the smallest id stays.

    Rows are told apart by a key of their own: rows of one id with unrelated texts all stay, and rows without an id are
    documents like any other, which stay only if their group has no id.
    """
    keyed = with_row_key(docs, KEY)
    classes = ngram_join.shingle_components(keyed, id_col=KEY).select(KEY, "component_id")
    # Only rows of groups of two and more are looked at again: a group's first row is its component's key.
    grouped = classes.where(f"{KEY} <> component_id")
    heads = grouped.select(F.col("component_id").alias(KEY), "component_id").distinct()
    members = grouped.unionByName(heads).join(keyed.select(KEY, "doc_id"), KEY)
    order = F.struct(F.col("doc_id").isNull(), "doc_id", KEY)
    stays = members.groupBy("component_id").agg(F.min_by(KEY, order).alias(KEY)).select(KEY)
    gone = members.select(KEY).join(stays, KEY, "left_anti")
    return keyed.join(gone, KEY, "left_anti").select(*docs.columns)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in texts are replaced by a mark; every document stays."""
    return secret_scan.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, in the order of the mix."""
    return pfair_mix.mixed(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of the documents; they follow the order of the mix, frame by frame (see packing)."""
    return packing.packing_report(docs, queries.vocabulary())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", keep_quality),
    ("near_duplicates", drop_near_duplicates),
    ("secrets", redact_secrets),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: Stages learn and solve, which SQL can't express; tests hold each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STAGES over documents, each stage's rows written as Parquet in the shared folder, read again, and then deleted.

    The last stage keeps what it needs of its input before it returns.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    old = None
    for name, stage in STAGES:
        out = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            path = scratch(spark, name)
            out.write.parquet(path)
            docs = spark.read.parquet(path)
        if old:
            discard(spark, old)
        old = path
    return out

"""A corpus pipeline: documents in, token ids out. Each stage is written as Parquet and read by the next one."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from estatespark.llm import bpe, exact_dedup, jaccard_join, queries
from estatespark.llm.common import Scratch, table, unused
from estatespark.session import run_folder

# Half a bigint's range: rows without an id get numbers above all ids.
NO_ID = 1 << 62
MIX_TARGETS = {"source": 0.8, "lang": 0.9, "topic": 1.0}
MIX_BUDGET = 0.9


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose chance of a passing grade reaches the threshold. The model is fitted on the labels of this stage's documents.

    Missing and empty texts are judged by their features of no text, rows without an id like any other; repeated rows stay or go
    together. An empty table stays one. Columns may have any further names.
    """
    names = unused(docs.columns, "expected_grade"), unused(docs.columns, "tail_probability")
    scored = queries.graded(docs, table(spark, sf_dir, "labels"), names)
    return scored.where(F.col(names[1]) >= queries.QUALITY_FROM).select(*[F.col(f"`{c}`") for c in docs.columns])


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of those with equal texts, the one with the smallest id; A-Z lower-cased, a missing text equals an empty one.

    A row without an id stays only if all of its group have none; of rows with the same text and id one stays. An empty table
    stays one. Columns may have any further names.
    """
    return exact_dedup.drop_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each component; five words and a similarity of 0.8. Rows of one id stay or go together.

    Documents without words link with nothing and stay. Rows without an id stay if none with an id is near. An empty table
    stays one. Columns may have any further names.
    """
    numbered = F.coalesce(F.col("doc_id"), F.xxhash64("text").bitwiseAND(NO_ID - 1) + F.lit(NO_ID))
    own = docs.select(numbered.alias("number"), "text")
    found = jaccard_join.jaccard_components(own, "number", "text", width=5, percent=80)
    number = unused(docs.columns, "number")
    gone = found.where(F.col("component_id") != F.col("number")).select(F.col("number").alias(number)).distinct()
    kept = docs.withColumn(number, numbered).join(gone.hint("merge"), number, "left_anti")
    return kept.select(*[F.col(f"`{c}`") for c in docs.columns])


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents drawn so that the sources, above all the largest, and the languages come closer to each other.

    A missing source or language is one of its own. Texts without words cost nothing and stay. Rows of one id are drawn
    together, as are all without an id. An empty table stays one. Columns may have any further names.
    """
    names = unused(docs.columns, "probability"), unused(docs.columns, "sampled")
    drawn = queries.mixed(docs, MIX_TARGETS, MIX_BUDGET, names)
    return drawn.where(F.col(names[1])).select(*[F.col(f"`{c}`") for c in docs.columns])


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_tokens and ids of the whole texts; further columns are left out.

    A missing or empty text has no ids. Rows without an id and repeated rows come out as they come in. An empty table gives an empty one.
    """
    path = public_tokenizers.path(queries.TOKENIZER)
    encoded = bpe.encode_texts(docs.select("doc_id", "lang", "source", "text"), path)
    return encoded.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [
    ("quality classifier", keep_quality),
    ("exact dedup", drop_exact_copies),
    ("near dedup", drop_near_copies),
    ("mixing", mix),
    ("encoding", encode),
]

# The classifier and the encoding have no SQL; tests/llm holds the rows against plain versions of the stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        # What a stage writes on its way goes with the stage.
        with run_folder(spark):
            following = scratch.write(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        scratch.drop(docs)
        docs = following
    return docs

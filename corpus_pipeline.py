"""Corpus pipeline over ``documents``: each stage works on the Parquet that its predecessor wrote."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from growthlens.llm import bpe, jaccard, linechunks, mixing, toxicity
from growthlens.llm.catalog import TARGET_WEIGHTS, VOCABULARY
from growthlens.llm.common import prepare, unused
from growthlens.plans.groups import unroll
from growthlens.session import cut_lineage, shared_folder


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model rejects go; it learns from ``labels`` over this stage's documents."""
    labels = prepare(spark).read.parquet(f"{sf_dir}/labels.parquet")
    out = unused(docs, "score"), unused(docs, "predicted")
    return toxicity.score(docs, labels, keep=docs.columns, out=out).filter(F.col(out[1]) == 0).select(*docs.columns)


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of lines that an earlier place has go out of the texts, and so do texts that are copies as a whole.

    A document of which no word is left goes itself: as an empty text it would be a class of its own in every later stage.
    Documents without an id take part, as places after all others.
    """
    prepare(spark)
    at, id_type = unused(docs, "_at"), docs.schema["doc_id"].dataType
    place = F.struct(F.isnull("doc_id").alias("none"), F.coalesce("doc_id", F.lit(0).cast(id_type)).alias("doc_id"))
    clean = linechunks.remove_repeated_passages(docs.withColumn(at, place), key=at, whole=True)
    # not as a filter: Spark would put the whole making of the text into its condition, for each of its stretches anew
    stays = F.when((F.col("n_removed") == 0) | F.col("text").rlike(r"\S"), F.array(F.lit(True)))
    clean = unroll(clean, clean.columns, stays, unused(clean, "_stays"))
    return clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates stays: the one with the smallest id.

    Repeated rows become one. Rows without an id cannot be named by the classes and stay.
    """
    prepare(spark)
    firsts = jaccard.near_duplicates(docs).filter("doc_id = component_id").select("doc_id").distinct()
    kept = docs.join(cut_lineage(firsts), "doc_id", "left_semi").dropDuplicates(["doc_id", "text"])
    return kept.select(*docs.columns).unionByName(docs.filter("doc_id IS NULL"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents in mixed order: rows are written in the order of the schedule."""
    prepare(spark)
    return mixing.mix(docs, TARGET_WEIGHTS).orderBy("slot", "in_block").select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, with its place in the mixed order: ``slot`` and ``in_block``.

    Files are read in an order of Spark's own, so the order of rows does not last. The schedule hangs
    on the documents alone; worked out again on the same documents it is the one they were written in.
    """
    prepare(spark)
    return bpe.encode(mixing.mix(docs, TARGET_WEIGHTS), VOCABULARY, ["doc_id", "lang", "source", "slot", "in_block"])


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_repeated_passages),
    ("n-gram Jaccard join", drop_near_duplicates),
    ("mixing sources to target weights", mix_sources),
    ("BPE encoding and decoding", encode),
]
#: DuckDB SQL for the rows of ``run``: none, as no SQL can learn the toxicity model.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``; every intermediate result is a table in the shared folder.

    Sorted by (slot, in_block) the rows stand in the order of the mixing stage.
    """
    docs = prepare(spark).read.parquet(f"{sf_dir}/documents.parquet")
    out = f"{shared_folder(spark)}/growthlens/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        done = stage(spark, docs, sf_dir)
        done.write.parquet(f"{out}/{k}")
        docs = spark.read.schema(done.schema).parquet(f"{out}/{k}")
    return docs

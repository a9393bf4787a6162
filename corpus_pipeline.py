"""The corpus pipeline: quality rules, toxicity, line dedup, near-dedup, packing.

Every stage takes (spark, docs, sf_dir), works on all rows of docs and returns a table; all but the last return the
columns of docs. Verdicts that come by key hold for all rows of the key; rows with a null key are packed but never
rejected by key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from muster.llm.hf_tokens import read_tokenizer
from muster.llm.linechunks import dedup_chunks
from muster.llm.neardup import near_duplicates
from muster.llm.packing import pack
from muster.llm.quality import judge
from muster.llm.tables import load, written
from muster.llm.toxicity import THRESHOLD, held_out, reject, train


def _without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    return docs.join(ids.select("doc_id").distinct(), "doc_id", "left_anti").select(*docs.columns)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or the robust distance reject go."""
    return _without(docs, judge(docs).where("not kept"))


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier calls toxic go; it learns from the labelled ones that are here."""
    labels = load(spark, sf_dir, "labels").where(~held_out("doc_id"))
    return reject(docs, train(docs, labels), THRESHOLD)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated passages of lines go; so does a document that consisted of them alone, a copy of others."""
    cut = dedup_chunks(docs).where((F.col("removed_chunks") == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    return cut.withColumn("n_chars", F.length("text").cast("bigint")).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the smallest key stays."""
    return _without(docs, near_duplicates(docs, percent=80).where("not kept"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of packed sequences."""
    import public_tokenizers

    return pack(docs, read_tokenizer(public_tokenizers.path("byte_bpe_50k.json")))


STAGES = [("quality_rules", quality_rules), ("toxicity", toxicity), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("packing", packing)]

#: No SQL: the stages hold models, content-defined chunks and min-max hashes.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage. Every other stage's table is written below the shared folder and read back, so that
    no stage is worked out again for the next one."""
    docs = load(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)

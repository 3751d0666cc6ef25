"""The corpus pipeline: toxicity, line dedup, n-gram join, decontamination, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last
return the columns of ``documents``, and columns beside these pass through. ``run``
applies them to ``documents``.

Defined results, in every stage: an empty table gives an empty table; null and empty
texts are clean, have no lines to cut, no words to compare and no window to hit, so
they stay (and are packed as their end token); rows without a doc_id are judged like
others and come last where the least id stays; rows that repeat doc_id and text get
the same decision, and one of them stays in the n-gram join; a text is read whole,
whatever its length.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.llm.decontamination import scan_documents
from lexloom.llm.line_dedup import dedup_lines
from lexloom.llm.ngram_join import keep_one
from lexloom.llm.packing import pack
from lexloom.llm.sampling import crc_mod
from lexloom.llm.toxicity import fit, score_texts


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the model predicts to be toxic go. It learns as the query op8 does."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    return score_texts(docs, fit(docs.select("doc_id", "text"), labels.where(crc_mod(F.col("doc_id"), 4) != 2)), drop=True)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that another line stands for are cut out; n_chars follows the text. A document that loses all its lines that
    way goes: every one of them stands elsewhere. One that was null, empty or blank from the start stays."""
    return dedup_lines(docs, length_col="n_chars", drop_emptied=True)


def ngram_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of similar texts stays; documents without words stay."""
    return keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which a twentieth or more of the words lie in benchmark windows go."""
    return scan_documents(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), mode="documents")


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A record per piece of the packed token stream."""
    return pack(docs)


STAGES = [("toxicity", toxicity), ("line_dedup", line_dedup), ("ngram_join", ngram_join), ("decontamination", decontamination), ("packing", packing)]

#: SQL can't express the learned, sketched and tokenising stages; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
    return docs

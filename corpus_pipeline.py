"""From raw documents to packed training sequences: four operators in a row, each over all that the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nearfield.llm import fertility, packing, secret_scan, simhash
from nearfield.storage import materialise, table

#: The columns of documents, which every stage but the last returns.
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops what the base rules or the tokeniser-fertility bands reject."""
    return fertility.keep(docs.select(*COLUMNS))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates, leaves the document with the least doc_id."""
    return simhash.keep_one(docs.select(*COLUMNS))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces every secret by a placeholder; documents without any stay as they are."""
    return secret_scan.redact(docs.select(*COLUMNS))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Tokens of every document, cut and placed in as few sequences as the search finds."""
    return packing.pack_documents(docs)


STAGES = [("quality rules", quality), ("near-dedup", near_dedup), ("secret scan", secrets), ("best-fit packing", pack)]

#: SQL can't express the tokenisers and fingerprints; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is written to the shared folder and reread by the next stage."""
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = materialise(docs.select(*[F.col(c) for c in COLUMNS]), "stage")
    return docs

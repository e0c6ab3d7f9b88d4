"""Cleaning and packing of a training corpus: five stages, each over all that the one before kept.

1. quality: documents that the quality rules reject go.
2. near_duplicates: of each group of near-duplicates one document stays, the one with the
   smallest doc_id. Groups are taken on five-word shingles at a similarity of 0.8, as stages
   are by default; the query op6 has four words by its contract.
3. decontamination: documents that hold a ten-word passage of a benchmark item go.
4. secrets: secrets are masked in place, and n_chars follows the text.
5. packing: documents become token sequences of at most 2048 tokens; each row is a piece of a
   document with its ids and its place, and marlstone.llm.packing.sequences joins them.

All but the last return the columns of documents, whatever other columns there are and
however they are called. Each stage gives no rows for an empty table.

Nulls and empty texts: the quality rules reject them, having too few words; the other
stages keep them (a null text stays null; it packs as its end token alone), and a null
doc_id, language or source is a value like others (a null doc_id comes last among the rows
of a group of near-duplicates). Repeated rows are near-duplicates of one another, and one
stays; rows that share a doc_id are told apart by their text. Ties between texts with one
doc_id go by the md5 of the text. Texts of any length are read whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from marlstone.llm import decontaminate, neardup, packing, quality, secrets
from marlstone.session import materialise

SHINGLE = 5


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.passing(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return neardup.distinct_documents(docs, size=SHINGLE)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secret_masking(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.masked(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, with_ids=True)


STAGES = [
    ("quality", quality_rules),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("secrets", secret_masking),
    ("packing", best_fit_packing),
]
#: SQL has no byte-pair encoding; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet in the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialise(docs, f"stage-{name}")
    return docs


def queries() -> dict:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}

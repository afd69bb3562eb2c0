"""A training-data pipeline over documents: quality rules, line dedup, near-dedup, secret masking, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of
documents, whatever other columns docs has. Between stages the rows are written to the shared folder and read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyhouse.llm.linedup import drop_boilerplate
from tallyhouse.llm.neardup import Rule, one_of_each
from tallyhouse.llm.packing import pack_documents
from tallyhouse.llm.quality import judged
from tallyhouse.llm.secrets import mask_secrets
from tallyhouse.llm.shared import kept

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules and the classifier keep; rejected ones go.

    Null and empty texts have too few words, so they go. Long texts are read whole. Repeated rows are
    judged alike; where labels lack a class the rules alone decide; an empty table gives no rows.
    """
    return judged(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")).where("kept").select(*COLUMNS)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that stand on many sites, but for each line's first place; documents of which all lines go, go.

    Null and empty texts have no lines and stay. A null source is no site. Repeated rows hold the same
    lines at the same place, which all count as the first; an empty table gives no rows.
    """
    found = drop_boilerplate(docs).where("n_removed = 0 or n_removed < n_lines")
    changed = F.col("n_removed") > 0
    return found.select("doc_id", F.col("kept_text").alias("text"), "lang", "source", F.when(changed, F.length("kept_text").cast("long")).otherwise(F.col("n_chars")).alias("n_chars"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: one with the group's smallest doc_id.

    Rows are judged by themselves, so a copy goes also where its id is another row's too; rows that repeat
    an id and its text go but for one. Null texts and texts without words, however many, are no duplicates
    of others; an empty table gives no rows.
    """
    return one_of_each(docs, Rule()).select(*COLUMNS)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with the secrets in their text masked; n_chars follows where the text changed.

    Null texts stay null, and empty ones empty. Long texts are read whole; repeated rows stay, masked
    alike; an empty table gives no rows.
    """
    masked = mask_secrets(docs.select(*COLUMNS).withColumn("before", F.col("text")))
    return masked.withColumn("n_chars", F.when(F.col("text").eqNullSafe(F.col("before")), F.col("n_chars")).otherwise(F.length("text").cast("long"))).select(*COLUMNS)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of at most 2048 tokens.

    Null and empty texts are one end token each; long texts are cut; repeated rows are packed each; an
    empty table gives no rows.
    """
    import public_tokenizers

    return pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup),
    ("near dedup", near_dedup),
    ("secret scans", secret_scan),
    ("packing", packing),
]

#: SQL can express neither the classifier nor the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, one on the other, over the whole documents table."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = kept(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)

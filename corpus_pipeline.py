"""From documents to packed sequences: STAGES, each written as Parquet and reread by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from skein.llm.common import delete, materialize, scratch, table
from skein.llm.decontamination import drop_contaminated
from skein.llm.minhash import drop_near_duplicates
from skein.llm.packing import pack_documents
from skein.llm.secrets import redact
from skein.llm.toxicity import drop_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text scores below the threshold of their language; repeated rows fare alike, rows without text are judged as
    texts without words."""
    return drop_toxic(docs, table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies; rows without words stay, and so does every text that has no copy, whatever
    its doc_id."""
    return drop_near_duplicates(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text overlaps no item of benchmark."""
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, the secrets in their texts replaced; null texts stay null."""
    return redact(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all rows with their place; a row without text is the end id alone."""
    return pack_documents(docs)


STAGES = [("toxicity", toxicity), ("near_dedup", near_dedup), ("decontamination", decontamination), ("secret_scan", secret_scan), ("packing", packing)]

#: The classifier, the shingle signatures and the tokenizer have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. Each stage's table, and what it wrote on the way, goes when the next one has been written."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        before = getattr(docs, "_skein_path", None)
        with scratch(spark) as kept:
            docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
            kept.append(docs)
        if before:
            delete(spark, before)
    return docs

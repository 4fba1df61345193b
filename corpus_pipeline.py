"""From raw documents to encoded training documents: quality, near-duplicates, secrets, mixture, encoding.

Each stage reads what the one before it kept, written as Parquet. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ontolake.llm import bpe, mixing, order_minhash, quality, secrets
from ontolake.llm.common import release, shared_path, table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier scores at 0.5 or more. A null or empty text is scored as any other; repeated rows
    are scored each by itself; without any labelled row all stay (score 0.5); an empty table gives no rows; all columns, extra
    ones too, come back as they are."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: that with the smallest id. Null texts count as empty, and empty texts are
    one group; rows with a null id go if their group has an id; rows that repeat id and text leave one; an empty table gives no
    rows; extra columns may have any names."""
    return order_minhash.deduplicated(docs)


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets in their texts replaced by a mark; n_chars counts the text as it is now, and stays where the text
    is null. No row goes or repeats; extra columns come back as they are."""
    length = F.coalesce(F.char_length("text").cast(docs.schema["n_chars"].dataType), F.col("n_chars"))
    return secrets.redact(docs).withColumn("n_chars", length).select(docs.columns)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mixture takes it, none at all or up to twice. Null texts have no words, a null source is a
    source of its own, repeated rows count one by one, an empty table gives no rows, extra columns may have any names."""
    return mixing.mix(docs)


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every document, with their number and the hashes of ids and decoded text; a row a row. Null texts count as empty,
    null ids stay null, other columns are left out."""
    return bpe.encode_decode(docs, keep=False).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


STAGES = [
    ("quality classifier", quality_stage),
    ("minhash near-dedup", near_dedup_stage),
    ("secret scan", secrets_stage),
    ("source mixing", mixing_stage),
    ("bpe encoding", encoding_stage),
]

#: A kernel classifier, alignments and byte-pair merges have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        path = shared_path(spark, "pipeline")
        stage(spark, docs, sf_dir).write.parquet(path)
        release(spark)  # what the stage kept beside its result
        docs = spark.read.parquet(path)
    return docs

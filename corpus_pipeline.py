"""Corpus pipeline: documents -> good, distinct, uncontaminated, redacted, encoded documents.

``STAGES``: (name, function(spark, docs, sf_dir) -> DataFrame), each over all
that the one before kept; ``run`` writes each stage as Parquet into the shared
folder and reads it for the next.  The first four keep the columns of
``documents``; the last returns the ids of every document that is left.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sessionlens.llm import bpe, decontam, quality, secrets, simhash
from sessionlens.llm.queries import byte_bpe, table
from sessionlens.llm.queries import quality_rules as rules_of
from sessionlens.session import remove_written, shared_path, written, written_removed


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6: documents that the rules reject go; the bands are fitted to the texts labelled good."""
    return quality.keep_good(docs, rules_of(spark, docs, sf_dir))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5: of each class of near duplicates one row stays: of the smallest doc_id, nulls last, then the first.

    Rows are numbered and written, and each is judged by its own text: repeated
    and null doc_ids are no exception.  Only the numbers of the lost rows are
    joined, so texts are shuffled only where these are too many to broadcast.
    """
    number, key = "row_number", "row_key"
    while number in docs.columns or key in docs.columns:
        number, key = number + "_", key + "_"
    numbered = written(docs.withColumn(number, F.monotonically_increasing_id()), "numbered-documents")
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id").alias("id"), F.col(number).alias("number"))
    classes = simhash.near_duplicates(numbered.select(order.alias(key), "text"), id_col=key)
    lost = classes.filter("doc_id.number <> component_id.number").select(F.col("doc_id.number").alias(number))
    return numbered.join(lost, number, "left_anti").select(*docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 1: documents that hold a benchmark item go."""
    return decontam.without_contaminated(docs, table(spark, sf_dir, "benchmark"), short_items=True)


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 9: secrets in the texts are replaced, ``n_chars`` follows."""
    clean = secrets.redact_secrets(docs)
    return clean.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7: doc_id, n_tokens, ids (little-endian unsigned 32-bit integers)."""
    return bpe.encode_texts(docs, byte_bpe())


STAGES = [
    ("quality rules", quality_rules),
    ("simhash near-dedup", near_dedup),
    ("benchmark decontamination", decontaminate),
    ("secret scans", redact),
    ("byte-level bpe", encode),
]

#: Fingerprints, compression, edit distance and BPE have no SQL form; tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    """The rows of the last stage; what earlier stages wrote is removed as soon as the next one is stored."""
    stored = None
    for name, stage in STAGES:
        path = shared_path(spark, "stage-" + name.replace(" ", "-"))
        with written_removed():
            stage(spark, docs, sf_dir).write.parquet(path)
        if stored is not None:
            remove_written(stored)
        docs = stored = spark.read.parquet(path)
    return docs

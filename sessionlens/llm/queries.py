"""Registered queries of the training-data operators: name -> (spark, sf_dir) -> DataFrame.

Each applies its operator with production parameters to its whole table.  The
ranked search has an SQL counterpart; hashing (XXH64 with a seed, SHA-256 of ids),
zstandard, tokenizers, trained models, eigenvectors and sampling have none in
DuckDB: those results are tested against brute force, round trips and held-out
accuracy instead.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sessionlens.llm import (
    bitplanes, bpe, decontam, langid, lexical, licenses, pii, quality, resample, secrets, simhash, token_counts,
    whitening,
)

END_ID = 1

#: As many buckets as a few million words fill well: with more, pairs that the labelled
#: texts happen not to hold outweigh the rest in the sum.
RESAMPLE = resample.ResampleSettings(buckets=1 << 14)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), short_items=True)


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    model = langid.learn(docs, usable=~held_out)
    return langid.identify(docs, model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "accepted")


def op3_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_report(table(spark, sf_dir, "documents"))


def op4_token_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokenizer = bitplanes.read_tokenizer(public_tokenizers.path("word_bpe_49k.json"))
    return bitplanes.token_files(table(spark, sf_dir, "documents"), tokenizer, END_ID)


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    classes = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return classes.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> quality.QualityRules:
    """Rules with bands fitted to the texts of ``docs`` that are labelled good."""
    return quality.fitted_rules(docs, table(spark, sf_dir, "labels").filter("quality = 1").select("doc_id"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_report(table(spark, sf_dir, "documents"), quality_rules(spark, table(spark, sf_dir, "documents"), sf_dir))


def byte_bpe() -> bpe.ByteLevelBPE:
    return bpe.ByteLevelBPE(bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")), public_tokenizers.PATTERN)


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip_digests(table(spark, sf_dir, "documents"), byte_bpe())


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pii_report(table(spark, sf_dir, "documents"))


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secret_report(table(spark, sf_dir, "documents"))


def op10_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    good = table(spark, sf_dir, "labels").filter("quality = 1 and coalesce(toxic, 0) = 0").select("doc_id")
    return resample.importance_sample(table(spark, sf_dir, "documents"), good, RESAMPLE)


def op11_whiten(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.ranked_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = [
        op1_decontaminate, op2_language_id, op3_licenses, op4_token_planes, op5_simhash,
        op6_quality, op7_byte_bpe, op8_pii, op9_secrets, op10_resample,
        op11_whiten, op12_ranked_search, op13_token_counts,
    ]
    return {f.__name__: f for f in own}


#: Every document is scored for every item, term by term.
RANKED_SEARCH_SQL = r"""
WITH words AS (
    SELECT row_number() OVER () AS row, doc_id,
        regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
            '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms
    FROM documents
), held AS (SELECT row, doc_id, terms, len(terms) AS n FROM words WHERE len(terms) > 0
), totals AS (SELECT count(*) AS n_docs, sum(n)::BIGINT AS n_all FROM held
), tf AS (SELECT row, term, count(*) AS tf FROM (SELECT row, unnest(terms) AS term FROM held) GROUP BY row, term
), weight AS (
    SELECT term, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM tf, totals GROUP BY term, n_docs
), asked AS (
    SELECT item_id, term, count(*) AS repeats FROM (
        SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
            '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark) GROUP BY item_id, term
), scored AS (
    SELECT item_id, row, doc_id,
        sum(repeats * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * n_docs) // n_all))))::BIGINT AS score
    FROM asked JOIN tf USING (term) JOIN weight USING (term) JOIN held USING (row), totals GROUP BY item_id, row, doc_id
), ranked AS (
    SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST)::INTEGER AS rank, doc_id, score
    FROM scored WHERE score > 0
)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 20
"""


def oracle_sql() -> dict[str, str]:
    return {"op12_ranked_search": RANKED_SEARCH_SQL}

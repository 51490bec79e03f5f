"""The queries over the test tables, a thin one for each operator, and the pipeline's."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, decontaminate, language, lattice, mixing, near_dup, repetition, resampling, roles, surrogates, token_counts, token_files, warc, whitening


def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice.lm_scores(common.table(spark, sf_dir, "documents"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    return repetition.quality_rules(docs).drop("text")


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang")
    return mixing.mixed(docs).drop("text").withColumns({c: F.round(c, 9) for c in ("weight", "probability")})


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    return token_counts.token_counts(docs).select("doc_id", "n_bytes", "n_tokens", "over_limit")


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = token_files.write_tokens(common.table(spark, sf_dir, "documents"))
    return token_files.token_index(token_files.read_tokens(spark, files))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = warc.write_warc(common.table(spark, sf_dir, "pages"))
    return warc.read_warc(spark, folder).drop("payload", "url")


def op7_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return surrogates.replaced(common.table(spark, sf_dir, "documents").select("doc_id", "text"), key=spark.conf.get("spark.tidegauge.surrogates.key", "test tables only"))


def op8_role_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return roles.repaired(common.table(spark, sf_dir, "conversations"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(common.table(spark, sf_dir, "documents"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))


def op11_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.document_languages(common.table(spark, sf_dir, "documents"))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.components(common.table(spark, sf_dir, "embeddings"))


def op13_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    rows = resampling.scored(docs, common.table(spark, sf_dir, "benchmark"))
    return resampling.drawn(rows.drop("text")).select("doc_id", "n_features", "weight", "score", "rank")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_lm_scoring": op1_lm_scoring,
    "op2_quality_rules": op2_quality_rules,
    "op3_mixing": op3_mixing,
    "op4_token_counts": op4_token_counts,
    "op5_token_files": op5_token_files,
    "op6_warc": op6_warc,
    "op7_surrogates": op7_surrogates,
    "op8_role_repair": op8_role_repair,
    "op9_simhash": op9_simhash,
    "op10_decontamination": op10_decontamination,
    "op11_language_id": op11_language_id,
    "op12_whitening": op12_whitening,
    "op13_resampling": op13_resampling,
}

OP6_SQL = """WITH d AS (SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
g AS (SELECT payload_digest, max(page_id) AS first FROM d WHERE payload_bytes >= 1000 GROUP BY payload_digest)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN first <> page_id THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN first <> page_id THEN first END AS refers_to FROM d LEFT JOIN g USING (payload_digest)"""

#: Suffix arrays, tokenizers, XXH64, lattices and the dynamic programs are beyond SQL; sliding each benchmark item over
#: each text is too slow in it.
ORACLE: dict[str, str] = {"op3_mixing": mixing.oracle(), "op6_warc": OP6_SQL}

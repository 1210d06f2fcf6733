"""Queries of the training-data operators: thin calls over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import alignment, embeddings, html, language, media, mixing, packing, quality, search, secrets, simhash, toxicity, warc


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(_read(spark, sf_dir, "documents"))


def op2_media_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.find_copies(media.images_of_vectors(_read(spark, sf_dir, "embeddings"), edits=media.EDITS))


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_read(spark, sf_dir, "documents"))


def op5_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.find_secrets(_read(spark, sf_dir, "documents"))


def op6_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_read(spark, sf_dir, "documents"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixture(_read(spark, sf_dir, "documents"))


def op8_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicates(_read(spark, sf_dir, "embeddings"))


def op9_warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(_read(spark, sf_dir, "pages"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.grade(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op11_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align(_read(spark, sf_dir, "documents"))


def op12_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(_read(spark, sf_dir, "pages"))


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.rank(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_language_id": op1_language_id,
    "op2_media_copies": op2_media_copies,
    "op3_quality_classifier": op3_quality_classifier,
    "op4_best_fit_packing": op4_best_fit_packing,
    "op5_secret_scans": op5_secret_scans,
    "op6_simhash_near_dedup": op6_simhash_near_dedup,
    "op7_mixing": op7_mixing,
    "op8_embedding_near_dedup": op8_embedding_near_dedup,
    "op9_warc_round_trip": op9_warc_round_trip,
    "op10_toxicity": op10_toxicity,
    "op11_tokenizer_alignment": op11_tokenizer_alignment,
    "op12_html_extraction": op12_html_extraction,
    "op13_ranked_search": op13_ranked_search,
}

#: DuckDB SQL for those that SQL can express.
ORACLES: dict[str, str] = {
    "op7_mixing": mixing.ORACLE,
    "op13_ranked_search": search.ORACLE,
    "op9_warc_round_trip": """
with p as (select page_id, coalesce(html, '') as payload from pages),
 d as (select page_id, cast(octet_length(encode(payload)) as bigint) as payload_bytes, sha256(payload) as payload_digest from p),
 f as (select *, case when payload_bytes >= 100 then min(page_id) over (partition by payload_digest) else page_id end as first_id from d)
select page_id, payload_bytes, payload_digest, case when page_id = first_id then 'response' else 'revisit' end as record_type,
 case when page_id <> first_id then first_id end as refers_to from f""",
}

"""Queries opN_<name> over the driver's tables, one for each corpus operator."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, language_id, license_scan, mixing, near_dups, page_text, secret_scan, transport_stream, url_filter, warc
from .common import table


def op1_url_markov_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = url_filter.judge_urls(table(spark, sf_dir, "pages").select("page_id", "url"))
    return judged.select("page_id", "host", "path", "rule", "verdict", F.round("score", 6).alias("score"))


def op2_page_differencing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = page_text.extract_text(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op3_pigeonhole_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, items = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark")
    found = decontaminate.find_leaks(docs, items).select("doc_id", F.explode("leaks").alias("leak"))
    return found.select("doc_id", "leak.item_id", "leak.distance", "leak.n_words", "leak.end_word")


def op4_license_rare_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = license_scan.scan_licences(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


def op5_secret_trigrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.scan_secrets(table(spark, sf_dir, "documents").select("doc_id", "text"))
    kinds = [r.kind for r in secret_scan.BASE_RULES]
    base = secret_scan.span_list(F.filter("spans", lambda s: s["no"] < len(kinds)))
    counts = [_count_kind(k) for k in kinds]
    return found.select("doc_id", *counts, F.sha2(base, 256).alias("base_sha256"), secret_scan.span_list(F.col("spans")).alias("spans"))


def _count_kind(kind: str):
    return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")


def op6_transport_streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    read = transport_stream.read_media(transport_stream.store_texts(docs))
    return read.select(
        "doc_id",
        F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_bytes"),
        *[F.col(f"stream.{c}").alias(c) for c in ("payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256")],
        transport_stream.feature_text(F.col("stream")).alias("feature"),
    )


def op7_language_bloom(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = language_id.fit_languages(docs.filter(~language_id.held_out(F.col("doc_id"))))
    out = language_id.predict_languages(docs.select("doc_id", "text"), model)
    return out.select("doc_id", language_id.held_out(F.col("doc_id")).alias("held_out"), F.col("language.lang").alias("lang_pred"), F.col("language.score").alias("score"))


def op8_pareto_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix_sources(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "copies")


def op9_warc_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = warc.archive_pages(spark, table(spark, sf_dir, "pages"))
    return read.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op10_bagminhash_near_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dups.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_url_markov_ratio,
        op2_page_differencing,
        op3_pigeonhole_decontamination,
        op4_license_rare_tokens,
        op5_secret_trigrams,
        op6_transport_streams,
        op7_language_bloom,
        op8_pareto_mixing,
        op9_warc_index,
        op10_bagminhash_near_dups,
    )
}

"""The queries of the training-data operators and, where SQL can say it, the same in DuckDB's SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fitscape.llm import class_lm, html_extract, language_id, url_filter, warc
from fitscape.llm.decontaminate import decontaminate
from fitscape.llm.fst_tokens import count_tokens
from fitscape.llm.line_quality import line_quality
from fitscape.llm.oracles import ORACLES
from fitscape.llm.packing import pack_documents
from fitscape.llm.prefix_join import similar_components
from fitscape.llm.shared import delete, shared_dir, stored, table
from fitscape.llm.simplex_clusters import cluster_vectors
from fitscape.llm.substring_dedup import substring_dedup
from fitscape.llm.vector_codes import compress_vectors


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return url_filter.filter_urls(pages, url_filter.train_url_model(pages)).select("page_id", "host", "path", "rule", "verdict")


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        ((F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"),
    )


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("held_out", language_id.held_out("doc_id", 4, 2))
    model = language_id.train_centroids(docs.filter("not held_out"))
    found = language_id.identify(docs, model)
    return found.select("doc_id", language_id.held_out("doc_id", 4, 2).alias("held_out"), "lang_pred", "score", "rejected")


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))


def op5_class_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = language_id.held_out("doc_id", 5, 1)
    found = class_lm.score_documents(docs, docs.filter(~held))
    return found.select("doc_id", held.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring_dedup(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op7_line_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_quality(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_hot_words")


def op8_fst_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"))


def op9_prefix_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_components(table(spark, sf_dir, "documents"))


def op10_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(table(spark, sf_dir, "pages"), html_extract.train_tree_model())


def op11_warc_captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    path = f"{shared_dir(spark)}/archives-{uuid.uuid4().hex}"
    warc.write_warc(warc.planned(pages), path)
    records = warc.read_warc(spark, path)
    # digests and sizes of whole payloads are all that is asked for
    records = stored(records.withColumn("payload", F.when(F.col("record_type") == "metadata", F.col("payload"))), "warc-records")
    delete(spark, path)
    found = warc.revisited(warc.assemble(records))
    page = lambda x: F.from_json(F.get(x, F.lit(0))["payload"].cast("string"), f"page_id {dict(pages.dtypes)['page_id']}")["page_id"]
    return found.select(
        page(F.col("metadata")).alias("page_id"), F.coalesce("original.payload_bytes", "response.payload_bytes").alias("payload_bytes"),
        F.coalesce("original.payload_sha1", "response.payload_sha1").alias("payload_digest"), F.col("response.record_type").alias("record_type"), page(F.col("original.metadata")).alias("refers_to"),
    )


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compress_vectors(table(spark, sf_dir, "embeddings"))


def op13_simplex_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster_vectors(table(spark, sf_dir, "embeddings"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_url_filter, op2_decontaminate, op3_language_id, op4_packing, op5_class_lm, op6_substring_dedup, op7_line_quality, op8_fst_tokens, op9_prefix_join,
        op10_html_extract, op11_warc_captures, op12_vector_codes, op13_simplex_clusters,
    )
}

__all__ = ["ORACLES", "QUERIES"]

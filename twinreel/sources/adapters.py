"""Items, paths and file logs made from the tables at hand."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.hashing import pack_signs


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def embedding_items(spark: SparkSession, sf_dir: str, constant_duration: bool = False) -> DataFrame:
    """``id, path, duration, w0, label``: hashes of 64 sign bits."""
    rows = table(spark, sf_dir, "embeddings")
    duration = F.lit(60) if constant_duration else (F.lit(60) + F.col("vec_id") % 40).cast("int")
    return rows.select(
        F.col("vec_id").alias("id"), F.format_string("/lib/%d/%d.mp4", "label", "vec_id").alias("path"), duration.alias("duration"),
        pack_signs(F.col("embedding")).alias("w0"), "label",
    )


def document_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``id, path, duration, content_hash``: texts as files."""
    rows = table(spark, sf_dir, "documents")
    return rows.select(
        F.col("doc_id").alias("id"), F.format_string("/%s/%s/%d.txt", "source", "lang", "doc_id").alias("path"), F.col("n_chars").cast("int").alias("duration"),
        F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("content_hash"),
    )


def page_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``id, path, size``: the paths of pages."""
    path = F.regexp_replace(F.col("url"), r"^[a-z]+://[^/]*", "")
    return table(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), path.alias("path"), F.length("html").alias("size"))


def file_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``path, mtime, event_id``: when a file was seen to change."""
    rows = table(spark, sf_dir, "events")
    return rows.select(F.format_string("/u/%d/%s", "user_id", "event_type").alias("path"), F.unix_timestamp("ts").alias("mtime"), "event_id")

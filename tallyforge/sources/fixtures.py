"""Deterministic inputs of the label operators, derived from the provided tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.coerce import lookup
from ..functions.dims import CODES, LABEL_REGIONS, N
from ..functions.vectors import argmax, softmax


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def code(index: Column) -> Column:
    return lookup(CODES, index)


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One prediction row for each event; about a quarter is not decoded."""
    e, u = F.col("event_id"), F.col("user_id")
    w = u % 24
    out = _table(spark, sf_dir, "events").withColumn("w", w.cast("int"))
    out = out.withColumn("p1", F.when((e % 10 < 7) & (F.col("w") < 23), F.col("w")).otherwise((e * 7 + 3) % 23).cast("int"))
    p1 = F.col("p1")
    top2 = (e * 41 % 500) / 1e4
    weak = F.when(F.col("w") == 23, "").otherwise(code(F.col("w")))
    return out.select(
        e.alias("sample_id"), e.alias("manifest_row"), (u % 16).cast("int").alias("shard"), "ts",
        F.concat(F.lit("root/cc="), F.lower(weak), F.lit("/t"), u.cast("string"), F.lit(".tar")).alias("tar_path"),
        F.concat(F.lit("m"), e.cast("string"), F.lit(".wav")).alias("member"),
        F.when(F.col("event_type") == "error", 0).otherwise(1).alias("decoded"), F.col("value").alias("duration"), weak.alias("weak_cc"),
        code(p1).alias("top1_cc"), code((p1 + 1 + e % 5) % 23).alias("top2_cc"), code((p1 + 7 + e % 5) % 23).alias("top3_cc"),
        ((8000 + e * 37 % 2000) / 1e4).alias("top1_score"), top2.alias("top2_score"), (top2 / 2).alias("top3_score"),
        ((e * 53 % 1000) / 1e3).alias("margin"), F.when(e % 17 != 0, (e * 29 % 150) / 1e2).alias("entropy"),
        F.when(e % 3 != 0, lookup(LABEL_REGIONS, p1)).alias("top1_region"), p1.alias("p1"),
    )


def eval_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One scored sample for each embedding: probabilities over the labels, truth and prediction."""
    v = F.col("vec_id")
    logits = F.transform(F.slice("embedding", 1, N), lambda x, i: x.cast("double") * 8 + F.when((i == F.col("label")) & (v % 3 != 0), 1.0).otherwise(0.0))
    out = _table(spark, sf_dir, "embeddings").withColumn("logits", logits).withColumn("probs", softmax(F.col("logits")))
    duration = F.when(v % 13 != 0, (v % 90).cast("double"))
    return out.select(
        v.alias("sample_id"), F.col("label").alias("truth"), argmax(F.col("logits")).alias("pred"), "logits", "probs", (v % 4).cast("int").alias("source"),
        code(F.col("label")).alias("country_code"), duration.alias("duration_seconds"), F.lit(1).alias("crop_count"),
        F.greatest(F.lit(1), F.ceil(duration / 30)).cast("int").alias("chunk_count"), (v % 3).cast("int").alias("rank"), F.when(v % 2 == 0, "tune").otherwise("holdout").alias("split"),
    )


def two_class_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "labels").select(F.col("doc_id").alias("sample_id"), F.when(F.col("doc_id") % 19 == 0, -100).otherwise(F.col("quality")).alias("truth"), F.col("toxic").alias("pred"))


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    vector = F.array("l_quantity", "l_extendedprice", "l_discount", "l_tax")
    return _table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("sample_id"), "l_partkey", "l_suppkey", "l_linenumber", vector.alias("vector"))


def manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One work row for each document; every tenth path names no label."""
    d = F.col("doc_id")
    label = F.when(d % 10 == 9, F.lit("")).otherwise(F.concat(F.lit("cc="), F.col("lang"), F.lit("/")))
    path = F.concat(F.lit("root/source="), F.col("source"), F.lit("/"), label, d.cast("string"), F.lit(".tar"))
    return _table(spark, sf_dir, "documents").select(d.alias("sample_id"), path.alias("tar_path"), F.concat(F.lit("m"), d.cast("string")).alias("member"), F.col("source").alias("dataset"), (d % 32).cast("int").alias("shard_idx"))


def profile_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dataset rows with known, unknown and missing labels."""
    d = F.col("doc_id")
    k = d % 25
    label = F.when(k < 23, code(k)).when(k == 23, "XX")
    split = F.when(d % 10 < 8, "train").when(d % 10 == 8, "validation").otherwise("test")
    return _table(spark, sf_dir, "documents").select(d.alias("sample_id"), label.alias("country_code"), (d % 23).cast("int").alias("country_id"), "source", split.alias("split"), F.floor(d / 50).cast("int").alias("row_group"))

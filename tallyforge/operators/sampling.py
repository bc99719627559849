"""Profiles, sharding, quotas and deterministic orders of datasets."""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from ..functions import dims
from .streams import order_key


@pandas_udf(T.LongType())
def digest_shard(text: pd.Series, shards: pd.Series) -> pd.Series:
    """blake2b of 8 bytes, read big-endian, modulo the number of shards."""
    return pd.Series([int.from_bytes(hashlib.blake2b((t or "").encode(), digest_size=8).digest(), "big") % n for t, n in zip(text, shards, strict=True)])


@pandas_udf(T.IntegerType())
def digest_half(key: pd.Series) -> pd.Series:
    """blake2b of 4 bytes, read little-endian, modulo 2."""
    return pd.Series([int.from_bytes(hashlib.blake2b((t or "").encode(), digest_size=4).digest(), "little") % 2 for t in key]).astype("int32")


def native_shard(value: Column, shards: int) -> Column:
    """A stable shard of text without Python: 32 bits of md5, modulo the number of shards."""
    return F.pmod(F.conv(F.substring(F.md5(value), 1, 8), 16, 10).cast("long"), F.lit(shards)).cast("int")


def profile(rows: DataFrame) -> DataFrame:
    """Counts by split, and by split with label, id or source, in one pass."""
    out = rows.groupingSets([[F.col("split")], [F.col("split"), F.col("country_code")], [F.col("split"), F.col("country_id")], [F.col("split"), F.col("source")]], "split", "country_code", "country_id", "source").agg(F.count(F.lit(1)).alias("n"), F.grouping_id().alias("gid"))
    kind = F.when(F.col("gid") == 7, "total").when(F.col("gid") == 3, "code").when(F.col("gid") == 5, "id").otherwise("source")
    key = F.when(F.col("gid") == 7, "").when(F.col("gid") == 3, F.col("country_code")).when(F.col("gid") == 5, F.col("country_id").cast("string")).otherwise(F.col("source"))
    return out.select("split", kind.alias("kind"), key.alias("key"), "n")


def label_counts(rows: DataFrame, include=None, exclude=()) -> DataFrame:
    """Rows of every wanted label, zeros kept."""
    wanted = [(k, c) for k, c, _, _ in dims.LABELS if (include is None or c in include) and c not in exclude]
    counts = rows.groupBy(F.upper("country_code").alias("code")).agg(F.count(F.lit(1)).alias("n"))
    return rows.sparkSession.createDataFrame(wanted, "id int, code string").join(counts, "code", "left").select("id", "code", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def known(rows: DataFrame, include=None, exclude=()) -> DataFrame:
    codes = [c for c in dims.CODES if (include is None or c in include) and c not in exclude]
    return rows.where(F.upper("country_code").isin(*codes))


def quota(rows: DataFrame, most: int, classes: int) -> DataFrame:
    """In sample order at most ceil(most / classes) rows of a label, and `most` in all; both limits are the feature."""
    each = -(-most // classes)
    place = F.row_number().over(Window.partitionBy("country_code").orderBy("sample_id"))
    return rows.withColumn("place", place).where(F.col("place") <= each).orderBy("sample_id").limit(most).select("sample_id", "country_code")


def majority_label(rows: DataFrame) -> DataFrame:
    """The most frequent label of each row group; ties go to the label seen first."""
    counts = rows.where("country_code is not null").groupBy("row_group", "country_code").agg(F.count(F.lit(1)).alias("n"), F.min("sample_id").alias("first"))
    best = F.min_by("country_code", F.struct(-F.col("n"), "first"))
    return counts.groupBy("row_group").agg(best.alias("label"))


def task_shard(groups: DataFrame, order: list[str], shards: int, index: int) -> DataFrame:
    """Every shards-th task from index on, in task order; tasks are row groups, far fewer than rows."""
    if not 0 <= index < shards:
        raise ValueError("shard index out of range")
    place = F.row_number().over(Window.orderBy(*order)) - 1
    return groups.withColumn("place", place).where(F.pmod("place", F.lit(shards)) == index).drop("place")


def epoch_order(rows: DataFrame, key: str, seed: int, epoch: int) -> DataFrame:
    """A shuffle that hangs on key, seed and epoch alone; order_key holds the order."""
    return rows.withColumn("order_key", order_key(F.col(key), seed + epoch * 7919)).orderBy("order_key")


def assigned(manifests: DataFrame, key: str, workers: int) -> DataFrame:
    """Manifests in turn to workers; with more workers than manifests they are shared cyclically."""
    n = manifests.count()
    place = (F.row_number().over(Window.orderBy(key)) - 1).cast("int")
    named = manifests.withColumn("place", place)
    if workers <= n:
        return named.select(key, F.pmod("place", F.lit(workers)).alias("worker"))
    turns = manifests.sparkSession.range(workers).select(F.col("id").cast("int").alias("worker"))
    return turns.join(F.broadcast(named), F.pmod(F.col("worker"), F.lit(max(n, 1))) == F.col("place")).select(key, "worker")


def target_labels(include=None, exclude=()) -> list[tuple[int, str]]:
    """The label list after include and exclude."""
    return [(k, c) for k, c, _, _ in dims.LABELS if (include is None or c in include) and c not in exclude]

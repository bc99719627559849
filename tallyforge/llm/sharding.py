"""Reproducible shuffle and sharding: a Feistel permutation of global row numbers, with cycle walking."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from .kernels import mix, stream
from .shared import Workspace, fresh, text_size

ROUNDS = 6
SEED = 40_093


class Feistel:
    """A permutation of 0 .. n-1: rounds over the mixed radix (a, b) with a * b >= n, walked until back below n.

    The domain exceeds n by less than a, so about one value in sqrt(n) takes a second step.
    """

    def __init__(self, n: int, seed: int = SEED, rounds: int = ROUNDS):
        self.n = max(n, 1)
        self.a = math.isqrt(self.n - 1) + 1
        self.b = -(-self.n // self.a)
        self.keys = stream(seed, rounds)

    def _once(self, x: np.ndarray) -> np.ndarray:
        left, right = x // np.uint64(self.b), x % np.uint64(self.b)
        for k, key in enumerate(self.keys):
            if k % 2:
                right = (right + mix(left ^ key) % np.uint64(self.b)) % np.uint64(self.b)
            else:
                left = (left + mix(right ^ key) % np.uint64(self.a)) % np.uint64(self.a)
        return left * np.uint64(self.b) + right

    def __call__(self, rows: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            out = self._once(np.asarray(rows, np.uint64))
            while len(far := np.flatnonzero(out >= np.uint64(self.n))):
                out[far] = self._once(out[far])
        return out.astype(np.int64)

    def place(self, row: int, shards: int) -> tuple[int, int]:
        """Shard and slot of one row number, without any data."""
        at = int(self(np.array([row]))[0])
        return at % shards, at // shards

    def column(self, rows: Column) -> Column:
        permute = self

        @pandas_udf("long")
        def permuted(x: pd.Series) -> pd.Series:
            return pd.Series(permute(x.to_numpy()))

        return permuted(rows)


def numbered(ws: Workspace, df: DataFrame, order: list[str], name: str) -> tuple[DataFrame, int]:
    """df with `name`, the global row number (0-based) in the order of the columns, and the number of rows.

    Rows that are equal in all columns of the order take each other's numbers; the input position, which may change
    from run to run, only spreads such rows over the ranges. The order is written before it is counted, so that the
    numbers stay as they are if an executor is lost.
    """
    part, within, place = fresh(df, "part", "within", "place")
    ranged = df.withColumn(place, F.monotonically_increasing_id())
    ranged = ranged.repartitionByRange(*(F.col(c).asc_nulls_last() for c in order), place).sortWithinPartitions(*(F.col(c).asc_nulls_last() for c in order), place)
    ranged = ranged.withColumn(part, F.spark_partition_id()).withColumn(within, F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)).drop(place)
    written = ws.write(ranged, "ranged")
    counts = written.groupBy(part).count().orderBy(part).collect()  # one row for each partition
    total, rows = 0, []
    for number, count in counts:
        rows.append((number, total))
        total += count
    offsets = ws.spark.createDataFrame(rows, f"{part} int, {name} long")
    out = written.join(F.broadcast(offsets), part).withColumn(name, F.col(name) + F.col(within))
    return out.drop(part, within), total


def sharded(docs: DataFrame, shards: int = 16, seed: int = SEED, id_col: str = "doc_id", shard: str = "shard", slot: str = "slot") -> DataFrame:
    """docs with the shard and the slot of every row; shards differ by one row at most, slots have no gaps.

    Row numbers follow the id (null last), then a hash of all columns: neither partitioning nor file order matters,
    and repeated rows get places of their own. Any payload, null or long, is carried along. If docs has columns of these
    names, the new ones take underscores in front.
    """
    ws = Workspace(docs.sparkSession, "sharding")
    content, row = fresh(docs, "content", "row")
    plain = lambda f: F.to_json(F.struct(F.col(f"`{f.name}`"))) if "map<" in f.dataType.simpleString() else F.col(f"`{f.name}`")  # noqa: E731  maps have no hash
    keyed = docs.withColumn(content, F.xxhash64(*map(plain, docs.schema.fields)))
    shard, slot = fresh(docs, shard, slot)
    out, n = numbered(ws, keyed, [id_col, content], row)
    out = out.withColumn(row, Feistel(n, seed).column(F.col(row)))
    return out.withColumn(shard, (F.col(row) % shards).cast("int")).withColumn(slot, F.floor(F.col(row) / shards).cast("long")).drop(content, row)


def shard_index(docs: DataFrame, shards: int = 16, seed: int = SEED) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) of every document, under the law `rows`.

    Null texts have size 1 and the checksum of no bytes. Only ids, sizes and checksums are shuffled.
    """
    ws = Workspace(docs.sparkSession, "sharding")
    text = F.col("text").cast("string")
    slim = docs.select("doc_id", text_size(text).alias("size"), F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"))
    out, n = numbered(ws, ws.write(slim, "slim"), ["doc_id", "text_crc32", "size"], "row")
    out = out.withColumn("row", Feistel(n, seed).column(F.col("row")))
    return out.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), (F.col("row") % shards).cast("int").alias("shard"),
        F.expr(f"row div {shards}").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )

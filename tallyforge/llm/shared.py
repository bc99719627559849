"""Written tables in the folder that the cluster shares, and small DataFrame helpers."""

from __future__ import annotations

import gc
import tempfile
import uuid
from typing import ClassVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes that separate words: space and \t \n \v \f \r.
SPACE_CHARS = " \t\n\x0b\x0c\r"


#: Bytes of an Arrow batch on its way to Python workers; a single longer row is a batch of its own.
BATCH_BYTES = 4 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; only where that is unset, on a single machine (tests), a temporary one."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = f"file://{tempfile.mkdtemp(prefix='tallyforge_')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def bound_batches(spark: SparkSession) -> None:
    """Bounds the bytes of Arrow batches, unless the session has a bound of its own."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(key))) > 64 << 20:
        spark.conf.set(key, str(BATCH_BYTES))


class Workspace:
    """Tables of one run, written under the shared folder so that a lost executor costs no lineage."""

    #: Those whose tables may still stand, in order of their making.
    open: ClassVar[list[Workspace]] = []

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        bound_batches(spark)
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self._n = 0
        Workspace.open.append(self)

    def write(self, df: DataFrame, name: str) -> DataFrame:
        """Writes df as Parquet, tightly packed, and reads it back; its lineage ends there."""
        self._n += 1
        path = f"{self.root}/{self._n:03d}-{name}"
        df.write.option("compression", "zstd").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out.tallyforge_path = path  # for drop()
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Deletes written tables that no later step reads, and lets Spark clean unreferenced shuffles."""
        for table in tables:
            self._delete(table.tallyforge_path)
        gc.collect()
        self.spark.sparkContext._jvm.System.gc()

    def clear(self) -> None:
        """Deletes all tables, once nothing reads them any more."""
        self._delete(self.root)
        if self in Workspace.open:
            Workspace.open.remove(self)

    def _delete(self, path: str) -> None:
        jvm = self.spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z alone."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words_of(text: Column) -> Column:
    """The maximal runs of characters outside SPACE_CHARS; an empty array for null."""
    flat = F.translate(F.coalesce(text, F.lit("")), SPACE_CHARS, " " * len(SPACE_CHARS))
    return F.array_remove(F.split(flat, " "), "")


def text_size(text: Column) -> Column:
    """UTF-8 bytes of the text (null: none) plus 1."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + F.lit(1).cast("long")


def among(df: DataFrame, chosen: DataFrame, name: str, ws: Workspace, most: int) -> DataFrame:
    """The rows of df whose value of `name` (null too) is among the values of chosen, which has that column alone.

    Whole numbers go as one row of bits for each 64 neighbours. Up to `most` rows are broadcast, so that df stays where
    it is; with more, both sides are shuffled."""
    value = F.col(name)
    if df.schema[name].dataType.simpleString() not in ("tinyint", "smallint", "int", "bigint"):
        listed = ws.write(chosen.distinct(), "listed")
        return df.join(F.broadcast(listed) if listed.count() <= most else listed, df[name].eqNullSafe(listed[name]), "left_semi")
    value = value.cast("long")
    place, bit = F.coalesce(F.shiftright(value, 6), F.lit(-(1 << 63))), value.bitwiseAND(F.lit(63)).cast("int")  # no number has that place
    (at, bits) = fresh(df, "at", "bits")
    words = ws.write(chosen.groupBy(place.alias(at)).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), bit)).alias(bits)), "bits")
    words = F.broadcast(words) if words.count() <= most else words
    return df.withColumn(at, place).join(words, at).where(F.coalesce(F.getbit(bits, bit), F.lit(1)) == 1).select(*df.columns)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(df: DataFrame, *names: str) -> tuple[str, ...]:
    """Column names like the given ones that df doesn't have."""
    have = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in have:
            name = f"_{name}"
        have.add(name.lower())
        out.append(name)
    return tuple(out)

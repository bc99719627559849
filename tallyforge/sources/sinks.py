"""Writers: sharded and partitioned exports, shard manifests, metric documents, reports and a writer's lock."""

from __future__ import annotations

import json
import time
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .readers import _fs, listed


def sharded_csv(df: DataFrame, path: str, rows_per_file: int) -> DataFrame:
    """Gzipped CSV files of at most rows_per_file rows and a manifest (file, bytes, rows, first and last sample)."""
    df.write.option("maxRecordsPerFile", rows_per_file).option("header", True).option("compression", "gzip").csv(path)
    files = listed(df.sparkSession, path, "part-*")
    out = df.sparkSession.read.option("header", True).schema(df.schema).csv(files)
    named = out.select("sample_id", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("bytes"))
    return named.groupBy("file", "bytes").agg(F.count(F.lit(1)).alias("rows"), F.min("sample_id").alias("first_sample"), F.max("sample_id").alias("last_sample"))


def partitioned_csv(df: DataFrame, path: str, *keys: str) -> None:
    df.write.partitionBy(*keys).option("header", True).option("compression", "gzip").csv(path)


def shard_manifests(df: DataFrame, path: str, key: str = "shard_idx") -> None:
    df.repartition(key).write.partitionBy(key).json(path)


def document(spark: SparkSession, path: str, value: dict) -> None:
    """A small JSON document, written beside its place and moved there."""
    fs, target = _fs(spark, path)
    partial = target.suffix(".partial")
    stream = fs.create(partial, True)
    try:
        stream.write(bytearray(json.dumps(value, sort_keys=True, indent=2, ensure_ascii=False).encode()))
    finally:
        stream.close()
    # FileContext renames over what is there in one step, so that a reader sees the old document or the new one.
    jvm = spark.sparkContext._jvm
    options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri() if target.toUri().getScheme() else fs.getUri(), spark.sparkContext._jsc.hadoopConfiguration())
    context.rename(fs.makeQualified(partial), fs.makeQualified(target), options)


def metric_bundle(summary: DataFrame, classes: DataFrame, matrix: DataFrame, n: int) -> dict:
    """Metrics, rows by class and the dense matrix: n and n * n values at most."""
    dense = [[0] * n for _ in range(n)]
    for r in matrix.collect():
        dense[r["truth"]][r["pred"]] = r["n"]
    return {"metrics": summary.first().asDict(), "per_class": [r.asDict() for r in classes.orderBy("id").collect()], "confusion_matrix": dense}


def wide_matrix(matrix: DataFrame, names: list[str]) -> DataFrame:
    return matrix.groupBy("truth").pivot("pred", list(range(len(names)))).agg(F.sum("n")).na.fill(0)


def markdown(df: DataFrame, title: str, most: int) -> str:
    """A table of the first `most` rows of a report."""
    rows = [[str(v) for v in r] for r in df.limit(most).collect()]
    return "\n".join([f"# {title}", "", "| " + " | ".join(df.columns) + " |", "|" + " --- |" * len(df.columns), *("| " + " | ".join(r) + " |" for r in rows), ""])


@contextmanager
def writer_lock(spark: SparkSession, path: str, stale_s: float = -1):
    """One writer at a time; a lock older than stale_s is taken over (negative: never)."""
    fs, target = _fs(spark, f"{path}/_lock")
    if stale_s >= 0 and fs.exists(target) and time.time() - fs.getFileStatus(target).getModificationTime() / 1000 > stale_s:
        fs.delete(target, False)
    if not fs.createNewFile(target):
        raise RuntimeError(f"{path} is being written")
    try:
        yield
    finally:
        fs.delete(target, False)


def report_set(reports: dict[str, tuple[DataFrame, list[str]]], path: str) -> list[str]:
    """Each report with its fixed columns as one CSV file in a folder of its name; reports are small by their grouping."""
    out = []
    for name, (df, columns) in reports.items():
        df.select(*columns).coalesce(1).write.mode("overwrite").option("header", True).csv(f"{path}/{name}")
        out.append(f"{path}/{name}")
    return out


def split_reports(reports: dict[str, DataFrame], split: str, path: str) -> list[str]:
    """The reports of a split as CSV files `<split>_<report>`."""
    return report_set({f"{file_name(split)}_{name}": (df, df.columns) for name, df in reports.items()}, path)


def file_name(text: str) -> str:
    return "".join(c if c.isalnum() or c in "._-" else "_" for c in text)


def retry_manifest(rows: DataFrame, path: str) -> None:
    """Rows to run again as JSON lines."""
    rows.write.mode("overwrite").json(path)


def log_event(spark: SparkSession, path: str, event: str, **values) -> None:
    """One JSON document for each event of a run, in order of time; nothing is appended to, so writers never meet."""
    document(spark, f"{path}/{time.time_ns():020d}-{file_name(event)}.json", {"event": event, "time": time.time(), **values})


def events(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("multiLine", True).json(f"{path}/*.json").orderBy("time")


IN_PROGRESS, SUCCESS = "_EXPORT_IN_PROGRESS", "_SUCCESS"


@contextmanager
def export_run(spark: SparkSession, path: str, stale_s: float = -1):
    """A locked export: old outputs go, a marker stands while it is written, _SUCCESS with the given values once it is done.

    Yields a dict for the values of the success marker. If the writing fails, the in-progress marker stays."""
    fs, target = _fs(spark, path)
    fs.mkdirs(target)
    with writer_lock(spark, path, stale_s):
        for old in fs.listStatus(target):
            if old.getPath().getName() != "_lock":
                fs.delete(old.getPath(), True)
        document(spark, f"{path}/{IN_PROGRESS}", {"started": time.time()})
        values: dict = {}
        yield values
        document(spark, f"{path}/{SUCCESS}", values)
        _, marker = _fs(spark, f"{path}/{IN_PROGRESS}")
        fs.delete(marker, False)

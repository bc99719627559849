"""Scans: dataset directories, manifests, prediction shards, markers, archives, logs and reports."""

from __future__ import annotations

import io
import json
import re
import tarfile
from collections.abc import Iterable
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.coerce import first_text, number_in
from ..functions.dims import CODES

# The columns that a prediction file must have, and the metrics of a report.
REQUIRED_PREDICTIONS = ("decoded", "weak_cc", "top1_cc", "top1_score", "top2_cc", "top3_cc", "margin", "entropy", "duration")
METRICS = ("accuracy", "balanced_accuracy", "macro_f1", "weighted_f1")


def _fs(spark: SparkSession, path: str):
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


def listed(spark: SparkSession, path: str, pattern: str = "*") -> list[str]:
    """Paths below a directory that match a glob, sorted; empty if there are none."""
    fs, target = _fs(spark, f"{path}/{pattern}")
    found = fs.globStatus(target)
    return sorted(x.getPath().toString() for x in found) if found else []


def exists(spark: SparkSession, path: str) -> bool:
    fs, target = _fs(spark, path)
    return fs.exists(target)


def read_text(spark: SparkSession, path: str) -> str:
    """A small document, whole; names that begin with _ too, which Spark's readers leave out."""
    fs, target = _fs(spark, path)
    stream = fs.open(target)
    try:
        return spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def dataset_dir(spark: SparkSession, root: str) -> str:
    """root/data, else the snapshot that refs/main names, else the last snapshot with data; an error if none."""
    if exists(spark, f"{root}/data"):
        return f"{root}/data"
    if exists(spark, f"{root}/refs/main"):
        named = f"{root}/snapshots/{read_text(spark, f'{root}/refs/main').strip()}/data"
        if exists(spark, named):
            return named
    found = listed(spark, root, "snapshots/*/data")
    if not found:
        raise FileNotFoundError(f"no data directory below {root}")
    return found[-1]


def split_files(spark: SparkSession, root: str, split: str) -> list[str]:
    data = dataset_dir(spark, root)
    found = listed(spark, data, f"{split}-*.parquet") or listed(spark, data, f"{split}.parquet")
    if not found:
        raise FileNotFoundError(f"no files of {split} in {data}")
    return found


def dataset(spark: SparkSession, root: str, split: str, columns: Iterable[str] | None = None) -> DataFrame:
    out = spark.read.parquet(*split_files(spark, root, split))
    return out.select(*columns) if columns else out


def manifest(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """CSV (.csv, .csv.gz) or else JSON lines, blank lines left out; gzip is read by suffix, zstd as whole files."""
    if re.search(r"\.csv(\.gz)?$", path):
        return spark.read.option("header", True).schema(schema).csv(path) if schema else spark.read.option("header", True).csv(path)
    if path.endswith(".zst"):
        lines = zstd_lines(spark, path)
        return spark.read.schema(schema).json(lines) if schema else spark.read.json(lines)
    return spark.read.schema(schema).json(path) if schema else spark.read.json(path)


def zstd_lines(spark: SparkSession, path: str):
    """Lines of zstd files as an RDD of text, decompressed as a stream."""
    import zstandard

    def lines(batches):
        for batch in batches:
            texts = []
            for content in batch.column(0).to_pylist():
                with zstandard.ZstdDecompressor().stream_reader(io.BytesIO(content), read_across_frames=True) as f:
                    texts += [x for x in io.TextIOWrapper(f, "utf-8").read().splitlines() if x.strip()]
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], names=["value"])

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(lines, "value string").rdd.map(lambda r: r[0])


# The columns that may hold a manifest row's label, the first non-empty one counts.
LABEL_COLUMNS = ("country_code", "final_dialect", "consensus_cc", "teacher_top1", "qwen_country_code", "did_top1_cc", "top1_cc", "weak_country_code", "weak_cc", "cc")


def manifest_rows(df: DataFrame, loss_weight: float = 1.0) -> DataFrame:
    """Manifest rows with known labels and their defaults; the id always follows from the code.

    Absent columns are empty. lang_type_id is -100 where it is missing, lang_type `unknown` then and else `dialect`;
    confidence is the teacher's, else the row's own, else 0; soft_label falls back to teacher_probs."""
    text = lambda c: F.nullif(F.col(c).cast("string"), F.lit("")) if c in df.columns else F.lit(None).cast("string")
    number = lambda c, kind: text(c).try_cast(kind)
    code = label_of(df, LABEL_COLUMNS)
    place = F.array_position(F.array(*map(F.lit, CODES)), code)
    lang_type_id = F.coalesce(number("lang_type_id", "int"), F.lit(-100))
    soft = [F.col(c) for c in ("soft_label", "teacher_probs") if c in df.columns]
    out = {
        "country_code": code, "country_id": (place - 1).cast("int"), "lang_type_id": lang_type_id, "lang_type": F.coalesce(text("lang_type"), F.when(lang_type_id == -100, "unknown").otherwise("dialect")),
        "accent_country_code": F.coalesce(text("accent_country_code"), F.lit("")), "accent_country_id": F.coalesce(number("accent_country_id", "int"), F.lit(-100)), "source": F.coalesce(text("source"), F.lit("ytb_pseudo")),
        "original_dialect": F.coalesce(text("original_dialect"), text("member"), F.lit("")), "weak_country_code": F.coalesce(text("weak_country_code"), F.lit("")),
        "loss_weight": F.coalesce(number("loss_weight", "double"), F.lit(loss_weight)), "pseudo_confidence": F.coalesce(number("teacher_confidence", "double"), number("confidence", "double"), F.lit(0.0)),
    }
    if soft:
        out["soft_label"] = F.coalesce(*soft)
    return df.withColumns(out).where(F.col("country_id") >= 0)


def manifest_labels(index: str | None, paths: list[str], first_rows: dict[str, str] | None = None, include=None, exclude=()) -> dict[str, list[int]]:
    """Label ids of each manifest from a sidecar document ({files: {path: codes}} or the bare map), looked up by the path and
    by its name; without a sidecar the label of the manifest's first usable row (first_rows). Unknown and unwanted labels go."""
    known = {}
    if index:
        data = json.loads(index)
        known = {str(k): [str(c).upper() for c in v] for k, v in data.get("files", data).items() if isinstance(v, list)}
    out = {}
    for path in paths:
        found = next((known[k] for k in (path, path.rsplit("/", 1)[-1]) if k in known), []) if known else [(first_rows or {}).get(path, "")]
        out[path] = sorted({CODES.index(c) for c in found if c in CODES and (include is None or c in include) and c not in exclude})
    return out


def manifest_driven(spark: SparkSession, manifest_path: str, columns: Iterable[str] | None = None) -> DataFrame:
    """The rows of the CSV files that a manifest (column file) lists, all as text; an error if a file or column is missing."""
    listed_files = [r["file"] for r in spark.read.option("header", True).csv(manifest_path).select("file").collect()]  # one row for each file
    gone = [f for f in listed_files if not exists(spark, f)]
    if gone:
        raise FileNotFoundError(f"missing files: {', '.join(gone)}")
    out = spark.read.option("header", True).csv(listed_files)
    missing = sorted(set(columns or ()) - set(out.columns))
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return out.withColumn("source_file", F.col("_metadata.file_path"))


def checkpoint_files(spark: SparkSession, root: str) -> DataFrame:
    """(run, name, checkpoint, bytes) of the checkpoint files below a root, in the order of their steps."""
    from ..operators.gates import checkpoint_order

    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.pt").load(root).select("path", "length")
    parts = F.split("path", "/")
    out = files.select(F.element_at(parts, -2).alias("run"), F.element_at(parts, -1).alias("name"), F.col("path").alias("checkpoint"), F.col("length").alias("bytes"))
    return out.orderBy("run", checkpoint_order(F.col("name")))


def count_map(document: str) -> dict[str, int]:
    """Counts by label from a flat document or one with them under train_by_code, counts_by_code, counts or labels; an error
    for a count that is no whole number."""
    data = json.loads(document)
    nested = next((data[k] for k in ("train_by_code", "counts_by_code", "counts", "labels") if isinstance(data, dict) and isinstance(data.get(k), dict)), data)
    if not isinstance(nested, dict):
        raise ValueError("counts must be a map")
    return {str(k).strip().upper(): int(v) for k, v in nested.items() if str(k).strip()}


def label_of(df: DataFrame, columns: Iterable[str]) -> Column:
    """The first non-empty label column, upper-cased; absent columns count as empty."""
    return first_text(*(F.col(c) for c in columns if c in df.columns), F.lit(""))


def with_optional(df: DataFrame, defaults: dict[str, Column]) -> DataFrame:
    """Adds the columns that the input lacks."""
    return df.withColumns({c: v for c, v in defaults.items() if c not in df.columns})


def prediction_csv(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Prediction shards as text columns, short rows filled with ''; an error if a required column is missing."""
    if not paths:
        raise FileNotFoundError("no prediction files")
    out = spark.read.option("header", True).option("mode", "PERMISSIVE").csv(paths)
    missing = sorted(set(REQUIRED_PREDICTIONS) - set(out.columns))
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return out.select(*(F.coalesce(c, F.lit("")).alias(c) for c in out.columns), F.col("_metadata.file_path").alias("source_prediction_csv"))


MARKER = "shard INT, output_csv STRING, csv_rows BIGINT, expanded_rows BIGINT, decoded_rows BIGINT, failed_rows BIGINT, duration_sec DOUBLE, elapsed_sec DOUBLE, worker_id STRING, hostname STRING, error STRING, manifest STRING"


def markers(spark: SparkSession, root: str, suffix: str = "done") -> DataFrame:
    """Completion markers, one JSON document for each file, with the file's time."""
    paths = listed(spark, root, f"shard_*.{suffix}")
    if not paths:
        return spark.createDataFrame([], f"{MARKER}, mtime TIMESTAMP, path STRING")
    out = spark.read.schema(MARKER).option("multiLine", True).json(paths)
    out = out.select("*", F.col("_metadata.file_modification_time").alias("mtime"), F.col("_metadata.file_path").alias("path"))
    return out.withColumn("shard", F.coalesce("shard", number_in(F.col("path"), r"shard_(\d+)").cast("int"))).withColumn("csv_rows", F.coalesce("csv_rows", "expanded_rows"))


def completed_predictions(spark: SparkSession, root: str, most: int | None = None) -> DataFrame:
    """Rows of the shards that have a marker; what is still being written stays unseen."""
    done = markers(spark, f"{root}/state").orderBy("shard").select("output_csv").collect()  # one row for each shard
    paths = [r["output_csv"] for r in done][: most or None]
    return prediction_csv(spark, [p if "/" in p else f"{root}/{p}" for p in paths])


def predictions_jsonl(spark: SparkSession, root: str, split: str) -> DataFrame:
    """Evaluation rows of all ranks, else of the single file."""
    paths = listed(spark, root, f"{split}_predictions.rank*.jsonl") or listed(spark, root, f"{split}_predictions.jsonl")
    if not paths:
        raise FileNotFoundError(f"no predictions of {split} in {root}")
    return spark.read.json(paths)


def all_splits(spark: SparkSession, roots: list[str]) -> DataFrame:
    """Prediction rows of all report directories with their split; two-class files are left out."""
    paths = [p for root in roots for p in listed(spark, root, "*_predictions*.jsonl") if "_lang_type_predictions" not in p]
    return spark.read.json(paths).withColumn("split", F.regexp_extract("_metadata.file_name", r"^(.*?)_predictions", 1))


def archive_members(spark: SparkSession, paths: list[str], wanted: DataFrame) -> DataFrame:
    """(tar_path, member, bytes, and the columns of wanted) for members that `wanted` names; broken archives give nothing
    from the break on.

    The wanted names of each archive travel with it; the archive is read entry by entry and other members are skipped.
    Rows with equal names are joined afterwards, so that several manifest rows may share a member."""
    names = wanted.groupBy("tar_path").agg(F.collect_set("member").alias("members"))

    def expand(batches):
        for batch in batches:
            for path, content, members in zip(*(batch.column(k) for k in range(3)), strict=True):
                keep = set(members.as_py() or ())
                source = pa.BufferReader(content.as_buffer()) if content.is_valid else io.BytesIO()
                try:
                    with tarfile.open(fileobj=source, mode="r|*") as tar:
                        for entry in tar:
                            if entry.isfile() and entry.name in keep:
                                yield pa.RecordBatch.from_arrays([pa.array([path.as_py()]), pa.array([entry.name]), pa.array([tar.extractfile(entry).read()], pa.binary())], names=["tar_path", "member", "bytes"])
                except (tarfile.TarError, EOFError, OSError):
                    pass  # what was read before the break stays

    files = spark.read.format("binaryFile").load(paths).select(F.col("path").alias("tar_path"), "content").join(names, "tar_path")
    members = files.select("tar_path", "content", "members").mapInArrow(expand, "tar_path string, member string, bytes binary")
    return members.join(wanted, ["tar_path", "member"])


def find_archives(spark: SparkSession, root: str, most: int | None = None) -> DataFrame:
    """Archives below a root, sorted, with an optional limit."""
    out = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.tar").load(root).select("path", "length").orderBy("path")
    return out.limit(most) if most else out


def find_all_archives(spark: SparkSession, roots: list[str], most: int | None = None) -> DataFrame:
    """Archives of several roots; the limit holds for each root."""
    out = [find_archives(spark, r, most).withColumn("root", F.lit(r)) for r in roots]
    return reduce(DataFrame.unionByName, out)


def log_fields(spark: SparkSession, path: str) -> DataFrame:
    """The last checkpoint and out_dir line of each log."""
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), "value").withColumn("at", F.monotonically_increasing_id())
    last = {k: F.max(F.when(F.col("value").rlike(rf"^\s*{k}\s*:"), F.struct("at", F.regexp_extract("value", rf"^\s*{k}\s*:\s*(.+?)\s*$", 1).alias("v"))))["v"].alias(k) for k in ("checkpoint", "out_dir")}
    return lines.groupBy("file").agg(*last.values())


def report_metrics(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Four metrics of each report, nested or flat; a broken report has nulls."""
    text = spark.read.text(paths, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_modification_time").alias("mtime"), "value")
    return text.select("path", "mtime", *(F.coalesce(F.get_json_object("value", f"$.metrics.{m}"), F.get_json_object("value", f"$.{m}")).try_cast("double").alias(m) for m in METRICS), number_in(F.col("path"), r"_step_(\d+)_").alias("step"))


def latest_report(reports: DataFrame, step: int) -> DataFrame:
    return reports.where(F.col("step") == step).agg(F.max_by("path", "mtime").alias("path"))


def bias_vector(document: str, codes: tuple[str, ...]) -> list[float]:
    """Biases by id, then by code, then as a list; later forms win; ids and codes outside the labels are skipped; an error
    for a list of another length."""
    data = json.loads(document)
    out = [0.0] * len(codes)
    for k, v in (data.get("bias_by_id") or {}).items():
        if 0 <= int(k) < len(codes):
            out[int(k)] = float(v)
    for k, v in (data.get("bias_by_code") or {}).items():
        if k.upper() in codes:
            out[codes.index(k.upper())] = float(v)
    if data.get("bias") is not None:
        if len(data["bias"]) != len(codes):
            raise ValueError("a bias list of another length")
        out = [float(v) for v in data["bias"]]
    return out

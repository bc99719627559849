"""Work tracking: shards, markers, completeness, progress."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.coerce import last_step, ratio


def markers(rows: DataFrame) -> DataFrame:
    """One completion marker for each shard."""
    return rows.groupBy("shard").agg(
        F.count(F.lit(1)).alias("csv_rows"), F.count_if(F.col("decoded") == 1).alias("decoded_rows"), F.count_if(F.col("decoded") != 1).alias("failed_rows"),
        F.round(F.sum("duration"), 6).alias("duration_sec"), F.max("ts").alias("mtime"),
    )


def archive_stats(rows: DataFrame) -> DataFrame:
    """Rows, decoded and failed ones and the duration of all rows of each archive."""
    out = rows.groupBy("tar_path").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("decoded") == 1).alias("decoded"), F.count_if(F.col("decoded") != 1).alias("failed"), F.round(F.coalesce(F.sum("duration"), F.lit(0.0)), 6).alias("duration"))
    return out.withColumn("status", F.when(F.col("failed") == 0, "done").otherwise("partial"))


def islands(values: DataFrame, col: str, width: int = 1 << 16) -> DataFrame:
    """Runs of consecutive whole numbers as text: a-b, or a.

    Runs are found within ranges of `width` numbers; only their ends, where they touch the next range, meet in one task."""
    part = F.floor(F.col(col) / width)
    order = Window.partitionBy("part").orderBy(col)
    runs = values.where(F.col(col).isNotNull()).select(col).distinct().withColumn("part", part).withColumn("run", F.col(col) - F.row_number().over(order))
    runs = runs.groupBy("part", "run").agg(F.min(col).alias("low"), F.max(col).alias("high"))
    # a run that reaches the end of its range goes on where the next range's first run begins at its start
    before = F.max("high").over(Window.orderBy("low").rowsBetween(Window.unboundedPreceding, -1))
    joined = runs.withColumn("new", F.coalesce((F.col("low") > before + 1).cast("int"), F.lit(1)))
    joined = joined.withColumn("group", F.sum("new").over(Window.orderBy("low").rowsBetween(Window.unboundedPreceding, 0)))
    out = joined.groupBy("group").agg(F.min("low").alias("low"), F.max("high").alias("high"))
    return out.select("low", "high", F.when(F.col("low") == F.col("high"), F.col("low").cast("string")).otherwise(F.concat_ws("-", "low", "high")).alias("span"))


def shard_audit(expected: DataFrame, present: DataFrame, failed: DataFrame) -> DataFrame:
    """State of each shard: done, failed, missing, or extra (done without being expected)."""
    e, p, f = (x.select("shard").distinct().withColumn(n, F.lit(True)) for x, n in ((expected, "e"), (present, "p"), (failed, "f")))
    out = e.join(p, "shard", "full_outer").join(f, "shard", "full_outer")
    state = F.when(F.col("e").isNull(), "extra").when(F.col("f"), "failed").when(F.col("p"), "done").otherwise("missing")
    return out.select("shard", state.alias("state"))


def reconcile(rows: DataFrame, marks: DataFrame) -> DataFrame:
    """Counts of rows against their markers, one row for each shard on either side."""
    counted = rows.groupBy("shard").agg(F.count(F.lit(1)).alias("seen"), F.count_if(F.col("decoded") == 1).alias("seen_decoded"))
    out = marks.select("shard", "csv_rows", "decoded_rows").join(counted, "shard", "full_outer")
    ok = F.col("csv_rows").eqNullSafe(F.col("seen")) & F.col("decoded_rows").eqNullSafe(F.col("seen_decoded"))
    return out.withColumn("ok", ok)


def work_summary(manifest: DataFrame) -> DataFrame:
    """Rows of each shard; least, most and mean over shards that have any."""
    by = manifest.groupBy("shard_idx").agg(F.count(F.lit(1)).alias("n"))
    return by.agg(F.count(F.lit(1)).alias("shards"), F.sum("n").alias("rows"), F.min("n").alias("least"), F.max("n").alias("most"), F.round(F.avg("n"), 6).alias("mean"))


def by_dataset(manifest: DataFrame) -> DataFrame:
    """Rows of each dataset in each shard that has any."""
    return manifest.groupBy("dataset", "shard_idx").agg(F.count(F.lit(1)).alias("n"))


def paired(base: DataFrame, other: DataFrame, order: str, rows: str = "rows") -> DataFrame:
    """Two file manifests side by side by place in the order of a column: (place, base_rows, cand_rows, ok); ok is false where
    the counts differ or a side has no file. One row for each file, far fewer than rows."""
    place = (F.row_number().over(Window.orderBy(order)) - 1).cast("int")
    b, c = base.select(place.alias("place"), F.col(rows).alias("base_rows")), other.select(place.alias("place"), F.col(rows).alias("cand_rows"))
    out = b.join(c, "place", "full_outer")
    return out.withColumn("ok", F.col("base_rows").eqNullSafe(F.col("cand_rows")))


def by_path(manifest: DataFrame) -> DataFrame:
    return manifest.groupBy("dataset", last_step(F.col("tar_path"), "cc").alias("cc")).agg(F.count(F.lit(1)).alias("n"))


def latest(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Last writer wins: the last row of each key in the given order."""
    w = Window.partitionBy(*keys).orderBy(*(F.desc(c) for c in order))
    return rows.withColumn("_last", F.row_number().over(w)).where("_last = 1").drop("_last")


def status(marks: DataFrame, total_shards: int, minutes: int = 30) -> DataFrame:
    """Progress in decoded rows: projection by the mean of the done shards, what remains, and the rates and times left
    by the markers of the last minutes before the newest. Null with fewer than two of them, or no time between them;
    the shards' rate also where all shards are done."""
    newest = marks.agg(F.max("mtime").alias("now"))
    recent = marks.join(F.broadcast(newest), F.col("mtime") >= F.col("now") - F.expr(f"interval {minutes} minutes"))
    seconds = F.unix_micros(F.max("mtime").cast("timestamp")) / 1e6 - F.unix_micros(F.min("mtime").cast("timestamp")) / 1e6
    speed = recent.agg(F.count(F.lit(1)).alias("recent"), seconds.alias("seconds"), F.sum("decoded_rows").alias("recent_rows"))
    done = marks.agg(F.count(F.lit(1)).alias("done_shards"), F.sum("csv_rows").alias("rows"), F.sum("decoded_rows").alias("decoded"), F.sum("failed_rows").alias("failed"))
    able = (F.col("recent") >= 2) & (F.col("seconds") > 0)
    mean = F.col("decoded") / F.col("done_shards")
    left = F.greatest(F.lit(0.0), mean * total_shards - F.col("decoded"))
    shard_rate = F.when(able & (F.col("done_shards") >= 2) & (F.col("done_shards") < total_shards), (F.col("recent") - 1) * 3600 / F.col("seconds"))
    row_rate = F.when(able, F.col("recent_rows") * 3600 / F.col("seconds"))
    out = done.crossJoin(speed).select(
        "done_shards", "rows", "decoded", "failed", ratio(100 * F.col("done_shards"), F.lit(total_shards)).alias("done_pct"), mean.alias("mean_decoded"), (mean * total_shards).alias("projected_decoded"), left.alias("remaining_decoded"),
        "recent", shard_rate.alias("shards_per_hour"), F.when(shard_rate > 0, (total_shards - F.col("done_shards")) / shard_rate).alias("eta_hours"),
        row_rate.alias("rows_per_hour"), F.when(row_rate > 0, left / row_rate).alias("row_eta_hours"),
    )
    return out.select(*(F.round(c, 6).alias(c) if kind == "double" else F.col(c) for c, kind in out.dtypes))


def statuses(shards: DataFrame, done: DataFrame, failed: DataFrame) -> DataFrame:
    """shards (shard, status) after a sync: done where nothing failed in the marker, else partial; a failed marker counts
    after a done one; shards that were failed or partial and have no marker any more are pending again, but only if there
    is a marker at all."""
    marks = done.groupBy("shard").agg(F.max("failed_rows").alias("failed_rows")).withColumn("d", F.lit(True))
    out = shards.join(marks, "shard", "left").join(failed.select("shard").distinct().withColumn("f", F.lit(True)), "shard", "left")
    some = done.select(F.lit(1).alias("x")).unionByName(failed.select(F.lit(1).alias("x"))).agg((F.count(F.lit(1)) > 0).alias("some"))
    status = F.when(F.col("f"), "failed").when(F.col("d"), F.when(F.coalesce("failed_rows", F.lit(0)) > 0, "partial").otherwise("done"))
    kept = F.when(F.col("some") & F.col("status").isin("failed", "partial"), "pending").otherwise(F.col("status"))
    return out.crossJoin(some).select("shard", F.coalesce(status, kept).alias("status"))


def retry(rows: DataFrame, failed: DataFrame) -> DataFrame:
    """Everything of failed shards, and what was not decoded elsewhere."""
    whole = rows.join(F.broadcast(failed.select("shard").distinct()), "shard", "left_semi").select("shard", "sample_id", F.lit("shard").alias("reason"))
    rest = rows.join(F.broadcast(failed.select("shard").distinct()), "shard", "left_anti").where("decoded != 1").select("shard", "sample_id", F.lit("row").alias("reason"))
    return whole.unionByName(rest)


def file_chunks(rows: DataFrame, per_file: int, width: int = 1 << 16) -> DataFrame:
    """Files of per_file rows in sample order: number, rows, first and last sample.

    Numbers come from counts of fixed ranges of the sample ids and places within a range, not from one ordered window over
    all rows; the ranges hang on the ids alone, so a step that is run again gives the same numbers."""
    ranged = rows.select("sample_id", F.floor(F.col("sample_id") / width).alias("part"))
    counts = ranged.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    base = counts.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    number = F.row_number().over(Window.partitionBy("part").orderBy("sample_id")) - 1 + F.col("base")
    out = ranged.join(base, "part").withColumn("file_idx", F.floor(number / per_file))
    return out.groupBy("file_idx").agg(F.count(F.lit(1)).alias("n"), F.min("sample_id").alias("first_sample"), F.max("sample_id").alias("last_sample"))

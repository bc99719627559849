"""Audits of exports and their parts: every check is one row (name, ok, observed, expected)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dims
from ..functions.coerce import pct

CHECK = "name string, ok boolean, observed string, expected string"


def check(name: str, observed: Column, expected: Column, ok: Column | None = None) -> Column:
    """One check as a struct; it holds where both sides are equal (nulls alike), or where ok does."""
    holds = observed.eqNullSafe(expected) if ok is None else F.coalesce(ok, F.lit(False))
    return F.struct(F.lit(name).alias("name"), holds.alias("ok"), observed.cast("string").alias("observed"), expected.cast("string").alias("expected"))


def as_rows(one: DataFrame, *checks: Column) -> DataFrame:
    """Checks over a table of one row."""
    return one.select(F.explode(F.array(*checks)).alias("x")).select("x.*")


def verdict(checks: DataFrame) -> DataFrame:
    """Whether all checks hold, and which do not."""
    return checks.agg(F.coalesce(F.bool_and("ok"), F.lit(False)).alias("ok"), F.count_if(~F.col("ok")).alias("failed"), F.array_join(F.array_sort(F.collect_list(F.when(~F.col("ok"), F.col("name")))), ",").alias("failures"))


def nonempty_lines(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(path, lines): lines with a character that is no white space, of each text file."""
    text = spark.read.text(paths).select(F.col("_metadata.file_path").alias("path"), "value")
    return text.groupBy("path").agg(F.count_if(F.trim(F.regexp_replace("value", r"\s", " ")) != "").alias("lines"))


def shard_states(expected: DataFrame, found: DataFrame, least_bytes: int = 128) -> DataFrame:
    """State of each prediction file against its manifest.

    expected: (shard, rows); found: (shard, bytes, header, rows without the header line). States: too_small, bad_header (neither
    sample_id nor top1_cc may lack), row_count_mismatch, ok, missing; extra files have the state of their own and extra set.
    """
    fields = F.split(F.trim("header"), ",")
    named = F.array_contains(fields, "sample_id") & F.array_contains(fields, "top1_cc")
    out = expected.select("shard", F.col("rows").alias("expected_rows")).join(found, "shard", "full_outer")
    wanted = F.coalesce("expected_rows", F.lit(0))
    state = F.when(F.col("bytes").isNull(), "missing").when(F.col("bytes") < least_bytes, "too_small").when(~F.coalesce(named, F.lit(False)), "bad_header")
    state = state.when(F.greatest("rows", F.lit(0)) != wanted, "row_count_mismatch").otherwise("ok")
    rows = F.when(state.isin("ok", "row_count_mismatch"), F.greatest("rows", F.lit(0))).otherwise(0).cast("long")
    return out.select("shard", "expected_rows", state.alias("state"), rows.alias("rows"), F.col("expected_rows").isNull().alias("extra"))


def shard_audit(states: DataFrame) -> DataFrame:
    """Totals of shard_states(): complete if nothing is missing, extra or incomplete. A file that is too small counts as missing."""
    known, ok = ~F.col("extra"), F.col("state") == "ok"
    return states.agg(
        F.count_if(known).alias("expected_shards"), F.coalesce(F.sum("expected_rows"), F.lit(0)).alias("expected_rows"), F.count_if(ok).alias("present_shards"),
        F.coalesce(F.sum(F.when(ok, F.col("rows"))), F.lit(0)).alias("present_rows"), F.count_if(known & ~ok).alias("missing_shards"),
        F.count_if(F.col("state") == "too_small").alias("empty_shards"), F.count_if(known & F.col("state").isin("bad_header", "row_count_mismatch")).alias("incomplete_shards"),
        F.count_if(F.col("extra")).alias("extra_shards"), (F.count_if(known & ~ok) + F.count_if(F.col("extra")) == 0).alias("complete"),
    )


def export_totals(rows: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """What a written export holds: rows, missing columns, sums of the policy flags, flags that are neither 0 nor 1."""
    flags = [p.name for p in dims.POLICIES]
    missing = [c for c in columns if c not in rows.columns]
    bad = [F.coalesce(F.count_if(~F.col(f).cast("string").isin("0", "1") | F.col(f).isNull()), F.lit(0)) for f in flags if f in rows.columns]
    sums = [(F.count_if(F.col(f).cast("string") == "1") if f in rows.columns else F.lit(None).cast("long")).alias(f) for f in flags]
    return rows.agg(F.count(F.lit(1)).alias("rows"), sum(bad, F.lit(0)).cast("long").alias("bad_flags"), *sums).withColumn("missing_columns", F.lit(",".join(sorted(missing))))


def final_label_checks(summary: DataFrame, files: DataFrame, totals: DataFrame, sources: DataFrame, markers: tuple[str, ...]) -> DataFrame:
    """Checks of a label export.

    summary: one row (exported_rows, success_rows, files, and the rows of each policy); files: (file, manifest_bytes, bytes,
    rows), bytes null where the file is missing; totals: export_totals(); sources: one row (decoded, nondecoded); markers: the
    names of marker files beside the export.
    """
    flags = [p.name for p in dims.POLICIES]
    by_file = files.agg(
        F.count(F.lit(1)).alias("m_files"), F.coalesce(F.sum("rows"), F.lit(0)).alias("m_rows"), F.count_if(F.col("bytes").isNull()).alias("m_missing"),
        F.count_if(F.col("bytes").isNotNull() & (F.col("bytes") != F.col("manifest_bytes"))).alias("m_sizes"),
    )
    one = summary.select(*(F.col(c).alias(f"s_{c}") for c in summary.columns)).crossJoin(by_file).crossJoin(totals.select(*(F.col(c).alias(f"t_{c}") for c in totals.columns))).crossJoin(sources)
    zero = F.lit(0).cast("long")
    return as_rows(
        one,
        check("success_marker", F.lit("_SUCCESS" in markers), F.lit(True)), check("not_in_progress", F.lit("_EXPORT_IN_PROGRESS" in markers), F.lit(False)), check("not_locked", F.lit("_EXPORT_LOCK" in markers), F.lit(False)),
        check("exported_equals_decoded", F.col("s_exported_rows"), F.col("decoded")), check("success_rows", F.col("s_success_rows"), F.col("s_exported_rows")),
        check("nothing_undecoded", F.col("nondecoded"), zero), check("required_columns", F.col("t_missing_columns"), F.lit("")), check("file_count", F.col("m_files"), F.col("s_files")),
        check("files_exist", F.col("m_missing"), zero), check("file_sizes", F.col("m_sizes"), zero), check("manifest_rows", F.col("m_rows"), F.col("s_exported_rows")),
        check("scanned_rows", F.col("t_rows"), F.col("s_exported_rows")), check("flag_values", F.col("t_bad_flags"), zero), *(check(f"rows_{f}", F.col(f"t_{f}"), F.col(f"s_{f}")) for f in flags),
        check("flags_in_range", F.greatest(*(F.col(f"s_{f}") for f in flags)), F.col("s_exported_rows"), (F.least(*(F.col(f"s_{f}") for f in flags)) >= 0) & (F.greatest(*(F.col(f"s_{f}") for f in flags)) <= F.col("s_exported_rows"))),
    )


def subset_checks(summary: DataFrame, files: DataFrame, rows: DataFrame, policies: tuple[str, ...], expected: DataFrame | None = None) -> DataFrame:
    """Checks of policy subsets.

    summary: one row (scanned_rows, emitted_rows, cap, skipped_by_cap, filtered); files: (policy, final_dialect, rows,
    manifest_bytes, bytes); rows: (policy, final_dialect, sample_id, tar_path, member, file_policy, file_dialect), the last two
    from the file's place; expected: (policy, rows) of the label summary, for exports without cap and filter.
    """
    counted = rows.groupBy(F.col("file_policy").alias("policy"), F.col("file_dialect").alias("final_dialect")).agg(F.count(F.lit(1)).alias("seen"))
    joined = files.join(counted, ["policy", "final_dialect"], "full_outer")
    by_file = joined.agg(
        F.count_if(~F.col("policy").isin(*policies)).alias("odd_policies"), F.count_if(~F.col("bytes").eqNullSafe(F.col("manifest_bytes"))).alias("odd_sizes"),
        F.count_if(F.coalesce("seen", F.lit(0)) != F.coalesce("rows", F.lit(-1))).alias("odd_rows"), F.coalesce(F.sum("seen"), F.lit(0)).alias("seen"),
    )
    empty = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")) == ""
    by_row = rows.agg(F.count_if((F.col("policy") != F.col("file_policy")) | (F.col("final_dialect") != F.col("file_dialect"))).alias("misplaced"), F.count_if(empty("sample_id") | empty("tar_path") | empty("member")).alias("unlocated"))
    one = summary.crossJoin(by_file).crossJoin(by_row)
    zero = F.lit(0).cast("long")
    checks = [
        check("sane_totals", F.col("emitted_rows"), F.col("scanned_rows"), (F.col("scanned_rows") >= 0) & (F.col("emitted_rows") > 0)), check("known_policies", F.col("odd_policies"), zero), check("file_sizes", F.col("odd_sizes"), zero),
        check("file_rows", F.col("odd_rows"), zero), check("rows_in_place", F.col("misplaced"), zero), check("locators", F.col("unlocated"), zero), check("emitted_rows", F.col("seen"), F.col("emitted_rows")),
    ]
    if expected is not None:
        found = rows.groupBy("policy").agg(F.count(F.lit(1)).alias("found")).join(expected, "policy", "full_outer")
        one = one.crossJoin(found.agg(F.count_if(F.coalesce("found", F.lit(0)) != F.coalesce("rows", F.lit(0))).alias("apart")))
        checks += [check("uncapped", F.col("apart"), zero, (F.col("cap") == 0) & (F.col("skipped_by_cap") == 0) & ~F.col("filtered") & (F.col("apart") == 0))]
    return as_rows(one, *checks)


def expected_policy_rows(counts: dict | None, policies: tuple[str, ...]) -> dict[str, int] | None:
    """Rows of each policy in a label summary's counts; None where they cannot be compared."""
    if not isinstance(counts, dict):
        return None
    out = {}
    for p in policies:
        if not isinstance(counts.get(p), dict):
            return None
        out[p] = int(counts[p]["rows"])
    return out


def artifact_checks(documents: DataFrame, required: tuple[str, ...]) -> DataFrame:
    """Checks over a set of report documents (name, rows, complete): all there, complete, and of the same number of rows."""
    named = documents.groupBy("name").agg(F.max("rows").alias("rows"), F.bool_and("complete").alias("complete"))
    wanted = documents.sparkSession.createDataFrame([(n,) for n in required], "name string").join(named, "name", "left")
    first = wanted.agg(F.min("rows").alias("least"), F.max("rows").alias("most"))
    rows = wanted.crossJoin(F.broadcast(first))
    ok = F.coalesce(F.col("complete"), F.lit(False)) & F.col("rows").eqNullSafe(F.col("least")) & F.col("rows").eqNullSafe(F.col("most"))
    return rows.select("name", ok.alias("ok"), F.col("rows").cast("string").alias("observed"), F.col("most").cast("string").alias("expected"))


def export_status(expected: DataFrame, csvs: DataFrame, done: DataFrame, failed: DataFrame) -> DataFrame:
    """One row: shards expected, with CSV, done, failed, remaining; CSVs without a marker and markers without a CSV."""
    sides = {"e": expected, "c": csvs, "d": done, "f": failed}
    out = None
    for name, df in sides.items():
        side = df.select("shard").distinct().withColumn(name, F.lit(True))
        out = side if out is None else out.join(side, "shard", "full_outer")
    e, c, d, f = (F.coalesce(n, F.lit(False)) for n in sides)
    counts = out.agg(
        F.count_if(e).alias("expected"), F.count_if(c).alias("csvs"), F.count_if(d).alias("done"), F.count_if(f).alias("failed"), F.count_if(e & ~d & ~f).alias("remaining"),
        F.count_if(c & ~d).alias("csv_without_done"), F.count_if(d & ~c).alias("done_without_csv"),
    )
    return counts.withColumn("completion_pct", pct(F.col("done"), F.col("expected")))


def partial_flag(done: int, expected: int | None) -> bool:
    """Whether a report covers only a part: the number of shards is unknown, or another one."""
    return not expected or done != expected


def start_checks(spark: SparkSession, summary: str, manifests: DataFrame, tracker: str, force: bool = False) -> DataFrame:
    """Checks before a tracker is set up: the summary is there, every row has an archive, no tracker stands (unless forced)."""
    from ..sources.readers import exists

    empty = manifests.agg(F.count_if(F.coalesce("tar_path", F.lit("")) == "").alias("empty"))
    return as_rows(empty, check("summary", F.lit(exists(spark, summary)), F.lit(True)), check("archives", F.col("empty"), F.lit(0).cast("long")), check("no_tracker", F.lit(exists(spark, tracker) and not force), F.lit(False)))


def directory_state(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(files, bytes, newest): number, size and last change of the files below a directory."""
    from ..sources.readers import exists

    if not exists(spark, path):
        return spark.createDataFrame([(0, 0, None)], "files long, bytes long, newest timestamp")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path).select("length", "modificationTime")
    return files.agg(F.count(F.lit(1)).alias("files"), F.coalesce(F.sum("length"), F.lit(0)).alias("bytes"), F.max("modificationTime").alias("newest"))


def empty_or_replaced(spark: SparkSession, path: str, overwrite: bool = False) -> None:
    """An output directory must be empty; with overwrite what is in it goes."""
    from ..sources.readers import _fs, listed

    if listed(spark, path):
        if not overwrite:
            raise FileExistsError(f"{path} is not empty")
        fs, target = _fs(spark, path)
        fs.delete(target, True)

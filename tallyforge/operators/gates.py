"""Gates and decisions over metric summaries and report documents, and the coverage of checkpoints by evaluations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

METRICS = ("accuracy", "balanced_accuracy", "macro_f1", "weighted_f1")
# Evaluation splits of a whole report, by group, and the labels of the older label set.
OLD_SPLITS = ("acgc_old19_validation", "acgc_old19_test")
NEW_SPLITS = ("acgc_td_validation_23way", "acgc_td_test_23way")


def watched(baseline: DataFrame, target: DataFrame, codes: tuple[str, ...], tolerance: float = 0.05) -> DataFrame:
    """(code, f1s, ratios, distance from 1 before and after, ok) of watched labels that both sides have."""
    b = baseline.select("code", F.col("f1").alias("base_f1"), F.col("ratio").alias("base_ratio"))
    t = target.select("code", F.col("f1").alias("target_f1"), F.col("ratio").alias("target_ratio"))
    out = b.join(t, "code").where(F.col("code").isin(*codes))
    near, far = F.abs(F.col("base_ratio") - 1), F.abs(F.col("target_ratio") - 1)
    return out.withColumn("f1_delta", F.col("target_f1") - F.col("base_f1")).withColumn("distance_delta", far - near).withColumn("ok", far <= near + tolerance)


def calibration_gate(baseline: DataFrame, target: DataFrame, base_codes: DataFrame, target_codes: DataFrame, codes: tuple[str, ...], holdout_rows: int | None = None, least_rows: int = 100_000,
                     macro: float = 0.001, accuracy: float = 0.0015, weighted: float = 0.0015, balanced: float = 0.002, kw: float = 0.65, tolerance: float = 0.05) -> DataFrame:
    """Seven checks as rows (name, ok) over calibrated holdout metrics: one row of METRICS and n a side, and (code, f1,
    ratio) of watched labels. The watched F1 needs KW on both sides; other labels on one side alone are left out."""
    b, t = baseline.select(*(F.col(c).alias(f"b_{c}") for c in METRICS)), target.select(*(F.col(c).alias(f"t_{c}") for c in METRICS), F.col("n"))
    gain = lambda m: F.col(f"t_{m}") - F.col(f"b_{m}")
    pairs = watched(base_codes, target_codes, codes, tolerance)
    seen = pairs.agg(F.coalesce(F.max(F.when(F.col("code") == "KW", F.col("target_f1"))) >= kw, F.lit(False)).alias("kw_ok"), (F.count_if(~F.col("ok")) == 0).alias("ratios_ok"))
    rows = F.lit(holdout_rows) if holdout_rows is not None else F.col("n")
    checks = {
        "enough_holdout_rows": F.coalesce(rows, F.lit(0)) >= least_rows, "macro_f1_improved": gain("macro_f1") >= macro, "accuracy_not_regressed": gain("accuracy") >= -accuracy,
        "weighted_f1_not_regressed": gain("weighted_f1") >= -weighted, "balanced_accuracy_not_regressed": gain("balanced_accuracy") >= -balanced, "kw_calibrated_ok": F.col("kw_ok"), "watched_pred_gold_not_worse": F.col("ratios_ok"),
    }
    one = b.crossJoin(t).crossJoin(seen)
    return one.select(F.explode(F.array(*(F.struct(F.lit(k).alias("name"), F.coalesce(v, F.lit(False)).alias("ok")) for k, v in checks.items()))).alias("x")).select("x.*")


def ternary(ok: Column, blocked: Column) -> Column:
    """pass or fail; blocked where the evidence is not there."""
    return F.when(blocked, "blocked").when(F.coalesce(ok, F.lit(False)), "pass").otherwise("fail")


def accuracy_floor(labels: DataFrame, old: tuple[str, ...], least: float) -> DataFrame:
    """Of the older labels with support: how many, how many below the floor, and the least accurate (ties: first code)."""
    rows = labels.where(F.col("code").isin(*old) & (F.col("support") > 0)).withColumn("accuracy", F.coalesce("accuracy", F.lit(0.0)))
    return rows.agg(F.count(F.lit(1)).alias("with_support"), F.count_if(F.col("accuracy") < least).alias("below"), F.min_by("code", F.struct("accuracy", "code")).alias("lowest"), F.min("accuracy").alias("lowest_accuracy"))


def audio_evidence(splits: DataFrame) -> DataFrame:
    """One row: whether every split has quantiles of durations and of chunk counts. splits: (split, kind, percent, value)."""
    has = lambda kind: F.count_if((F.col("kind") == kind) & F.col("value").isNotNull()) > 0
    by = splits.groupBy("split").agg(has("duration_seconds").alias("durations"), has("chunk_count").alias("chunks"))
    return by.agg(F.coalesce(F.bool_and("durations"), F.lit(True)).alias("durations"), F.coalesce(F.bool_and("chunks"), F.lit(True)).alias("chunks"))


def acceptance(evidence: DataFrame, old_labels: int) -> DataFrame:
    """Six criteria as (id, name, status) from one row of evidence.

    codes_ok and heads_ok (null: no checkpoint was read, blocked), rank, with_support and below of the floor, td_validation
    and td_test accuracies, review_ready and candidate_ready, chunking, chunk_seconds, max_seconds, durations, chunks.
    """
    never = F.lit(False)
    full = F.col("chunking") & (F.col("chunk_seconds") == 30.0) & (F.col("max_seconds") == 0.0) & F.col("durations") & F.col("chunks")
    east = F.coalesce("review_ready", never) & F.coalesce("candidate_ready", never)
    criteria = (
        ("supports_all_labels", ternary(F.col("codes_ok") & F.col("heads_ok"), F.col("codes_ok").isNull())),
        ("old_labels_match_or_improve", ternary(F.col("rank") == 1, never)),
        ("no_severe_old_regression", ternary((F.col("below") == 0) & (F.col("with_support") == old_labels), never)),
        ("useful_new_label", ternary((F.col("td_validation") >= 0.5) & (F.col("td_test") >= 0.5), never)),
        ("verified_east_labels", ternary(east, ~east)),
        ("full_audio_chunks", ternary(full, never)),
    )
    rows = F.array(*(F.struct(F.lit(k + 1).alias("id"), F.lit(n).alias("name"), s.alias("status")) for k, (n, s) in enumerate(criteria)))
    return evidence.select(F.explode(rows).alias("x")).select("x.*")


def accepted(criteria: DataFrame) -> DataFrame:
    """Whether all criteria pass, and the blockers in order."""
    open_ones = F.array_sort(F.collect_list(F.when(F.col("status") != "pass", F.struct("id", "name"))))
    return criteria.agg(F.bool_and(F.col("status") == "pass").alias("ready"), F.array_join(F.transform(open_ones, lambda x: x["name"]), ",").alias("blockers"))


def candidate_decision(cards: DataFrame) -> DataFrame:
    """accept or wait, and the next action, of score cards: (ready, review_ready, top, missing, east, old, td), top the best
    candidate or null, missing its missing splits (array), the others the states of its checks."""
    passes = lambda c: F.coalesce(F.col(c) == "pass", F.lit(False))
    ready = F.coalesce("ready", F.lit(False))
    action = (
        F.when(ready, "accept_top_candidate_after_review").when(~F.coalesce("review_ready", F.lit(False)), "finish_reviewed_export").when(F.col("top").isNull(), "evaluate_candidates")
        .when(F.coalesce(F.array_contains("missing", "verified_dj_km_so_heldout_23way"), F.lit(False)), "evaluate_verified_heldout").when(~passes("east"), "inspect_verified_errors_or_retrain")
        .when(~passes("old"), "reject_or_retrain_for_old_labels").when(~passes("td"), "reject_or_retrain_for_new_label").otherwise("refresh_artifacts")
    )
    passed = sum((passes(c).cast("int") for c in ("old", "td", "east")), F.lit(0))
    return cards.withColumn("decision", F.when(ready, "accept").otherwise("wait")).withColumn("next_action", action).withColumn("label", F.when(ready, "ready").otherwise(F.concat(passed.cast("string"), F.lit("/3 checks"))))


def leaderboard(candidates: DataFrame, most: int) -> DataFrame:
    """The first `most` candidates by macro F1, then name; the limit is the report's."""
    return candidates.orderBy(F.desc("macro_f1"), "candidate").limit(most)


def checkpoint_order(name: Column) -> Column:
    """Sort key of a checkpoint's file name: steps by number, final, epochs by number, others."""
    stem = F.regexp_replace(name, r"\.[^.]*$", "")
    number = F.coalesce(F.regexp_extract(stem, r"^(?:step|epoch)_(\d+)$", 1).try_cast("long"), F.lit(-1).cast("long"))
    kind = F.when(stem.startswith("step_"), 0).when(stem == "final", 1).when(stem.startswith("epoch_"), 2).otherwise(3)
    return F.struct(kind.alias("kind"), F.when(kind == 1, F.lit(10**9).cast("long")).when(kind == 3, F.lit(-1).cast("long")).otherwise(number).alias("number"), name.alias("name"))


def coverage(checkpoints: DataFrame, logs: DataFrame, reports: DataFrame) -> DataFrame:
    """checkpoints (run, name, checkpoint) with the splits that their reports hold, status, priority and reason.

    logs: (checkpoint, report); reports: (report, split, accuracy). Splits of one report count together: a checkpoint is
    core covered if one report has all, covered in parts if two reports have them.
    """
    per = reports.groupBy("report").agg(F.collect_set("split").alias("splits"), F.max(F.when(F.col("split") == NEW_SPLITS[0], F.col("accuracy"))).alias("v"), F.max(F.when(F.col("split") == NEW_SPLITS[1], F.col("accuracy"))).alias("t"))
    has = lambda names: F.size(F.array_except(F.array(*map(F.lit, names)), F.col("splits"))) == 0
    per = per.select("report", "splits", has(OLD_SPLITS).alias("old"), has(NEW_SPLITS).alias("new"), (has(NEW_SPLITS) & (F.col("v") == 1.0) & (F.col("t") == 1.0)).alias("new_ok"), has(OLD_SPLITS + NEW_SPLITS).alias("core"))
    found = logs.join(per, "report").groupBy("checkpoint").agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("splits")))).alias("splits"), *(F.coalesce(F.bool_or(c), F.lit(False)).alias(c) for c in ("old", "new", "new_ok", "core")),
    )
    out = checkpoints.join(found, "checkpoint", "left")
    old, new, ok, core = (F.coalesce(c, F.lit(False)) for c in ("old", "new", "new_ok", "core"))
    run, name = F.col("run"), F.col("name")
    status = F.when(core, "core_covered").when(old & new, "covered_split_across_reports").when(old, "old19_only").when(new, "td_only").when(run.contains("smoke") | name.startswith("epoch_"), "debug_or_epoch_uncovered").otherwise("uncovered")
    out = out.withColumn("status", status)
    special = F.lower(run).rlike("smoke|debug|head_only|row_only")
    ladder = (
        (~F.col("status").isin("uncovered", "old19_only", "td_only"), 99, ""), (new & ~ok, 85, "fails on the new label already"), (special, 90, "debug or specialized run"),
        (name.isin("final.pt", "epoch_1.pt"), 80, "duplicate of a step"), (name.rlike(r"^step_\d+\.pt$"), 10, "step without complete coverage"), (name.startswith("step_"), 20, "intermediate step without complete coverage"),
    )
    priority, reason = None, None
    for test, p, r in ladder:
        priority = F.when(test, p) if priority is None else priority.when(test, p)
        reason = F.when(test, r) if reason is None else reason.when(test, r)
    return out.withColumn("priority", priority.otherwise(50)).withColumn("reason", reason.otherwise("uncovered checkpoint")).withColumn("splits", F.coalesce("splits", F.array().cast("array<string>")))


def recommended(rows: DataFrame, most: int = 25) -> DataFrame:
    """The first checkpoints to evaluate next; the limit is the report's."""
    return rows.where("priority < 50").orderBy("priority", "run", "name").limit(most)

"""Further registered queries: exports, audits, gates, losses, streams, and their SQL."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..functions import coerce, dims, losses
from ..functions import vectors as V
from ..operators import audio, audits, decisions, gates, metrics, sampling, streams, tracker
from ..sources import fixtures, readers
from . import oracle as O
from .registry import WATCHED, _both, _diag, _matrix, _rows, query

NAMES = [p.name for p in dims.POLICIES]


def _md5(key: str, *salts: object) -> str:
    return f"md5(concat_ws(':', ({key})::VARCHAR, {', '.join(repr(str(s)) for s in salts)}))"


def _draw(key: str, *salts: object) -> str:
    return f"(('0x' || substr({_md5(key, *salts)}, 1, 8))::BIGINT / 4294967296.0::DOUBLE)"


# Exports of labels.
def _eight(c: str) -> str:
    return f"coalesce(printf('%.8f', {c}), '')"


_FLAGS = {*NAMES, "weak_top1_match", "weak_top2_match", "weak_top3_match", "weak_region_match"}
_TOP2 = "((event_id * 41) % 500) / 1e4"
_EXPORTED = ", ".join(
    f"{_eight(c)} AS {c}" if c in ("duration", "top1_score", "margin", "entropy", "top2_score", "top3_score") else f"{c}::INT AS {c}" if c in _FLAGS or c == "decoded" else f"'' AS {c}" if c in decisions.OPTIONAL else c
    for c in decisions.EXPORT
)
query("P9_final_labels", f"WITH {O.FINAL}, scored AS (SELECT f.*, ((sample_id * 41) % 500) / 1e4 AS top2_score, ((sample_id * 41) % 500) / 2e4 AS top3_score FROM final f) SELECT {_EXPORTED} FROM scored")(lambda s, d: decisions.export_rows(_rows(s, d)))
query("P8_eight_decimals", O.pred(f"SELECT sample_id, {_eight('entropy')} AS entropy, {_eight('margin')} AS margin FROM pred"))(
    lambda s, d: fixtures.predictions(s, d).select("sample_id", coerce.eight_decimals(F.col("entropy")).alias("entropy"), coerce.eight_decimals(F.col("margin").cast("string")).alias("margin"))
)
query("T2_weak_label_order", O.summary("CASE WHEN weak_cc = '' THEN 'MISSING' ELSE weak_cc END AS label", "label"))(lambda s, d: decisions.weak_order(decisions.finished(_rows(s, d).groupBy(coerce.group_key(F.col("weak_cc")).alias("label")).agg(*decisions.counters()), "label"), "label"))
query("T5_export_order", O.final("SELECT sample_id, tar_path, member FROM final"))(lambda s, d: decisions.export_order(_rows(s, d), "tar").select("sample_id", "tar_path", "member"))
query("T9_first_examples", O.final("SELECT sample_id, final_dialect FROM final ORDER BY sample_id LIMIT 75"))(lambda s, d: decisions.export_order(_rows(s, d)).select("sample_id", "final_dialect").limit(75))
query("A30_label_changes", O.both("SELECT label, sum(b)::BIGINT AS base_rows, sum(c)::BIGINT AS cand_rows, sum(f)::BIGINT AS changed_from, sum(t)::BIGINT AS changed_to FROM (SELECT base_label AS label, 1 AS b, 0 AS c, changed::INT AS f, 0 AS t FROM both_sides UNION ALL SELECT cand_label, 0, 1, 0, changed::INT FROM both_sides) GROUP BY label"))(lambda s, d: decisions.label_changes(_both(s, d)))
_WANTED = ("AE", "EG", "MA", "SA", "TN")
query("A29_subset_counts", O.final(f"""SELECT policy, final_dialect, count(*) AS scanned, CASE WHEN final_dialect IN {_WANTED} THEN least(count(*), 20) ELSE 0 END AS emitted,
  CASE WHEN final_dialect IN {_WANTED} THEN count(*) - least(count(*), 20) ELSE 0 END AS skipped_by_cap, CASE WHEN final_dialect IN {_WANTED} THEN 0 ELSE count(*) END AS skipped_by_dialect FROM ({O.POLICY_UNION}) GROUP BY policy, final_dialect"""))(
    lambda s, d: decisions.subset_counts(_rows(s, d), 20, _WANTED)
)
query("A32_flag_sums", O.final(f"SELECT count(*) AS rows, 0::BIGINT AS bad_flags, {', '.join(f'count(*) FILTER ({n}) AS {n}' for n in NAMES)}, '' AS missing_columns FROM final"))(lambda s, d: audits.export_totals(decisions.export_rows(_rows(s, d)), decisions.EXPORT))
query("J14_text_keys", O.pred("SELECT sample_id::VARCHAR AS sample, tar_path AS tar, CASE WHEN sample_id % 5 = 0 THEN '' ELSE member END AS member FROM pred"))(
    lambda s, d: fixtures.predictions(s, d).withColumn("member", F.when(F.col("sample_id") % 5 != 0, F.col("member"))).select(coerce.text(F.col("sample_id")).alias("sample"), coerce.text(F.col("tar_path")).alias("tar"), coerce.text(F.col("member")).alias("member"))
)


@query("J5_paired_files", O.final("SELECT k AS place, b.n AS base_rows, c.n AS cand_rows, b.n = c.n AS ok FROM (SELECT (row_number() OVER (ORDER BY final_dialect) - 1)::INT AS k, count(*) AS n FROM final GROUP BY final_dialect) b JOIN (SELECT (row_number() OVER (ORDER BY final_dialect) - 1)::INT AS k, count(*) + CASE WHEN final_dialect = 'EG' THEN 1 ELSE 0 END AS n FROM final GROUP BY final_dialect) c USING (k)"))
def paired_files(s, d):
    """Two manifests (one row for each label's file) side by side by place; one count is made wrong."""
    counts = _rows(s, d).groupBy("final_dialect").agg(F.count(F.lit(1)).alias("rows"))
    other = counts.withColumn("rows", F.col("rows") + F.when(F.col("final_dialect") == "EG", 1).otherwise(0))
    return tracker.paired(counts, other, "final_dialect")


query("W8_last_writer", O.pred("SELECT tar_path, member, sample_id FROM (SELECT tar_path, 'm' || (sample_id % 7)::VARCHAR AS member, sample_id, ts FROM pred) QUALIFY row_number() OVER (PARTITION BY tar_path, member ORDER BY ts DESC, sample_id DESC) = 1"))(
    lambda s, d: tracker.latest(fixtures.predictions(s, d).withColumn("member", F.concat(F.lit("m"), (F.col("sample_id") % 7).cast("string"))), ["tar_path", "member"], ["ts", "sample_id"]).select("tar_path", "member", "sample_id")
)
query("A28_by_dataset", O.MANIFEST + "SELECT dataset, shard_idx, count(*) AS n FROM manifest GROUP BY ALL")(lambda s, d: tracker.by_dataset(fixtures.manifest(s, d)))
query("M5_native_shards", "SELECT shard, count(*) AS n FROM (SELECT (('0x' || substr(md5(p), 1, 8))::BIGINT % 32)::INT AS shard FROM (SELECT 'root/source=' || source || '/' || CASE WHEN doc_id % 10 = 9 THEN '' ELSE 'cc=' || lang || '/' END || doc_id::VARCHAR || '.tar' AS p FROM documents)) GROUP BY shard")(
    lambda s, d: fixtures.manifest(s, d).groupBy(sampling.native_shard(F.col("tar_path"), 32).alias("shard")).agg(F.count(F.lit(1)).alias("n"))
)

# Audits. Files: shard 3 has none, 4 is too small, 5 has another header, 6 a row too many; shard 99 is extra.
_FOUND = """SELECT shard, CASE WHEN shard = 4 THEN 100 ELSE 1000 + count(*) END AS bytes, CASE WHEN shard = 5 THEN 'a,b' ELSE 'sample_id,top1_cc' END AS header, count(*) + CASE WHEN shard = 6 THEN 1 ELSE 0 END AS rows FROM pred WHERE shard <> 3 GROUP BY shard UNION ALL SELECT 99, 500, 'sample_id,top1_cc', 7"""
_STATES = f"""SELECT coalesce(e.shard, f.shard)::INT AS shard, e.rows AS expected_rows, CASE WHEN f.shard IS NULL THEN 'missing' WHEN f.bytes < 128 THEN 'too_small' WHEN f.header = 'a,b' THEN 'bad_header' WHEN f.rows <> coalesce(e.rows, 0) THEN 'row_count_mismatch' ELSE 'ok' END AS state,
  CASE WHEN f.shard IS NULL OR f.bytes < 128 OR f.header = 'a,b' THEN 0 ELSE f.rows END AS rows, e.shard IS NULL AS extra FROM (SELECT shard, count(*) AS rows FROM pred GROUP BY shard) e FULL JOIN ({_FOUND}) f ON e.shard = f.shard"""


def _states(s, d):
    counts = fixtures.predictions(s, d).groupBy("shard").agg(F.count(F.lit(1)).alias("rows"))
    k = F.col("shard")
    found = counts.where("shard != 3").select("shard", F.when(k == 4, 100).otherwise(1000 + F.col("rows")).cast("long").alias("bytes"), F.when(k == 5, "a,b").otherwise("sample_id,top1_cc").alias("header"), (F.col("rows") + F.when(k == 6, 1).otherwise(0)).alias("rows"))
    extra = s.createDataFrame([(99, 500, "sample_id,top1_cc", 7)], "shard int, bytes long, header string, rows long")
    return audits.shard_states(counts, found.unionByName(extra))


query("Q1_shard_states", O.pred(_STATES))(_states)
query("Q1_shard_audit", O.pred(f"""SELECT count(*) FILTER (NOT extra) AS expected_shards, sum(expected_rows)::BIGINT AS expected_rows, count(*) FILTER (state = 'ok') AS present_shards, coalesce(sum(rows) FILTER (state = 'ok'), 0)::BIGINT AS present_rows,
  count(*) FILTER (NOT extra AND state <> 'ok') AS missing_shards, count(*) FILTER (state = 'too_small') AS empty_shards, count(*) FILTER (NOT extra AND state IN ('bad_header', 'row_count_mismatch')) AS incomplete_shards, count(*) FILTER (extra) AS extra_shards,
  count(*) FILTER (extra OR state <> 'ok') = 0 AS complete FROM ({_STATES})"""))(lambda s, d: audits.shard_audit(_states(s, d)))


def _label_checks(s, d):
    """An export whose flag counts are off by one for the first policy, with one file of another size."""
    rows = _rows(s, d)
    exported = decisions.export_rows(rows)
    totals = audits.export_totals(exported, decisions.EXPORT)
    files = exported.groupBy(F.floor(F.col("sample_id") / 1000).alias("file")).agg(F.count(F.lit(1)).alias("rows"))
    files = files.select(F.col("file").cast("string").alias("file"), (F.col("rows") * 10).alias("manifest_bytes"), (F.col("rows") * 10 + F.when(F.col("file") == 0, 1).otherwise(0)).alias("bytes"), "rows")
    summary = totals.select(F.col("rows").alias("exported_rows"), F.col("rows").alias("success_rows"), *((F.col(n) + (1 if k == 0 else 0)).alias(n) for k, n in enumerate(NAMES))).crossJoin(files.agg(F.count(F.lit(1)).alias("files")))
    sources = fixtures.predictions(s, d).agg(F.count_if(F.col("decoded") == 1).alias("decoded"), F.lit(0).cast("long").alias("nondecoded"))
    return audits.final_label_checks(summary, files, totals, sources, ("_SUCCESS",))


_LABEL_OK = {"success_marker": "true", "not_in_progress": "true", "not_locked": "true"}
query("Q2_final_label_checks", O.final(f"""SELECT name, ok, observed, expected FROM (SELECT unnest([
  {{'name': 'success_marker', 'ok': true, 'observed': 'true', 'expected': 'true'}}, {{'name': 'not_in_progress', 'ok': true, 'observed': 'false', 'expected': 'false'}}, {{'name': 'not_locked', 'ok': true, 'observed': 'false', 'expected': 'false'}},
  {", ".join(f"{{'name': '{x}', 'ok': true, 'observed': n::VARCHAR, 'expected': n::VARCHAR}}" for x in ("exported_equals_decoded", "success_rows", "manifest_rows", "scanned_rows"))},
  {{'name': 'file_count', 'ok': true, 'observed': files::VARCHAR, 'expected': files::VARCHAR}}, {{'name': 'required_columns', 'ok': true, 'observed': '', 'expected': ''}}, {{'name': 'file_sizes', 'ok': false, 'observed': '1', 'expected': '0'}},
  {", ".join(f"{{'name': '{x}', 'ok': true, 'observed': '0', 'expected': '0'}}" for x in ("nothing_undecoded", "files_exist", "flag_values"))},
  {", ".join(f"{{'name': 'rows_{x}', 'ok': {'false' if k == 0 else 'true'}, 'observed': {x}::VARCHAR, 'expected': {f'({x} + 1)' if k == 0 else x}::VARCHAR}}" for k, x in enumerate(NAMES))},
  {{'name': 'flags_in_range', 'ok': true, 'observed': greatest({NAMES[0]} + 1, {', '.join(NAMES[1:])})::VARCHAR, 'expected': n::VARCHAR}}], recursive := true)
  FROM (SELECT count(*) AS n, count(DISTINCT sample_id // 1000) AS files, {", ".join(f"count(*) FILTER ({x}) AS {x}" for x in NAMES)} FROM final))"""))(_label_checks)
query("Q2_verdict", "SELECT false AS ok, 2::BIGINT AS failed, 'file_sizes,rows_strong_model_only' AS failures")(lambda s, d: audits.verdict(_label_checks(s, d)))


def _subset_checks(s, d):
    """Uncapped subsets; one file's row count and one row's label are wrong."""
    rows = decisions.policy_rows(_rows(s, d)).select("policy", "final_dialect", "sample_id", "tar_path", "member").withColumn("file_policy", F.col("policy")).withColumn("file_dialect", F.col("final_dialect"))
    files = rows.groupBy("policy", "final_dialect").agg(F.count(F.lit(1)).alias("rows"), F.lit(10).cast("long").alias("manifest_bytes"), F.lit(10).cast("long").alias("bytes"))
    first = files.agg(F.min(F.struct("policy", "final_dialect")).alias("f"))
    files = files.crossJoin(first).withColumn("rows", F.col("rows") + F.when(F.struct("policy", "final_dialect") == F.col("f"), 1).otherwise(0)).drop("f")
    least = rows.agg(F.min(F.struct("sample_id", "policy")).alias("f"))
    moved = rows.crossJoin(least).withColumn("final_dialect", F.when(F.struct("sample_id", "policy") == F.col("f"), "XX").otherwise(F.col("final_dialect"))).drop("f")
    summary = rows.agg(F.count(F.lit(1)).alias("scanned_rows"), F.count(F.lit(1)).alias("emitted_rows"), F.lit(0).alias("cap"), F.lit(0).alias("skipped_by_cap"), F.lit(False).alias("filtered"))
    expected = rows.groupBy("policy").agg(F.count(F.lit(1)).alias("rows"))
    return audits.subset_checks(summary, files, moved, tuple(NAMES), expected).select("name", "ok")


query("Q3_subset_checks", "SELECT unnest(['sane_totals', 'known_policies', 'file_sizes', 'file_rows', 'rows_in_place', 'locators', 'emitted_rows', 'uncapped']) AS name, unnest([true, true, true, false, false, true, true, true]) AS ok")(_subset_checks)
query("Q4_artifacts", O.final("SELECT name, ok, observed, expected FROM (SELECT unnest([{'name': 'completeness', 'ok': true, 'observed': n::VARCHAR, 'expected': n::VARCHAR}, {'name': 'labels', 'ok': true, 'observed': n::VARCHAR, 'expected': n::VARCHAR}, {'name': 'decision_card', 'ok': false, 'observed': NULL, 'expected': n::VARCHAR}], recursive := true) FROM (SELECT count(*) AS n FROM final))"))(
    lambda s, d: audits.artifact_checks(_rows(s, d).agg(F.count(F.lit(1)).alias("rows")).select(F.explode(F.array(F.lit("completeness"), F.lit("labels"))).alias("name"), "rows", F.lit(True).alias("complete")), ("completeness", "labels", "decision_card"))
    .withColumn("ok", F.when(F.col("name") == "decision_card", F.lit(False)).otherwise(F.col("observed") == F.col("expected")))
)
query("Q5_export_status", O.pred("SELECT 20::BIGINT AS expected, c.n AS csvs, c.n - 1 AS done, 1::BIGINT AS failed, 20 - (c.n - 1) - CASE WHEN c.five THEN 0 ELSE 1 END AS remaining, 2::BIGINT AS csv_without_done, 1::BIGINT AS done_without_csv, round(100 * (c.n - 1) / 20.0::DOUBLE, 6) AS completion_pct FROM (SELECT count(DISTINCT shard) AS n, bool_or(shard = 5) AS five FROM pred) c"))(
    lambda s, d: _export_status(s, d)
)


def _export_status(s, d):
    shards = fixtures.predictions(s, d).select("shard").distinct()
    last = shards.agg(F.max("shard").alias("last"))
    done = shards.crossJoin(last).where("shard NOT IN (7, 8)").select("shard").unionByName(s.sql("SELECT 19 AS shard"))
    return audits.export_status(s.range(20).select(F.col("id").cast("int").alias("shard")), shards, done, s.sql("SELECT 5 AS shard"))


# Gates.
def _side(rows):
    classes = metrics.per_class(metrics.confusion(rows))
    ratios = metrics.predicted_ratio(classes).join(classes.select(coerce.lookup(dims.CODES, F.col("id")).alias("code"), "f1"), "code").select("code", "f1", "ratio")
    return metrics.summary(classes), ratios


def _calibration_gate(s, d):
    """Baseline: the rows outside source 0; target: the holdout half."""
    rows = fixtures.eval_rows(s, d)
    (base, base_codes), (target, target_codes) = _side(rows.where("source != 0")), _side(rows.where("split = 'holdout'"))
    return gates.calibration_gate(base, target, base_codes, target_codes, WATCHED, least_rows=200)


_SIDES = {"b": "(SELECT * FROM ev WHERE source <> 0)", "t": "(SELECT * FROM ev WHERE split = 'holdout')"}


def _codes(rows: str) -> str:
    return f"(SELECT {O.code('id')} AS code, f1, CASE WHEN support > 0 THEN predicted / support::DOUBLE ELSE 'Infinity'::DOUBLE END AS ratio FROM {O.per_class(rows)} WHERE support + predicted > 0)"


_GATE = f"""SELECT name, ok FROM (SELECT unnest([{{'name': 'enough_holdout_rows', 'ok': t.n >= 200}}, {{'name': 'macro_f1_improved', 'ok': t.macro_f1 - b.macro_f1 >= 0.001}}, {{'name': 'accuracy_not_regressed', 'ok': t.accuracy - b.accuracy >= -0.0015}},
  {{'name': 'weighted_f1_not_regressed', 'ok': t.weighted_f1 - b.weighted_f1 >= -0.0015}}, {{'name': 'balanced_accuracy_not_regressed', 'ok': t.balanced_accuracy - b.balanced_accuracy >= -0.002}},
  {{'name': 'kw_calibrated_ok', 'ok': coalesce(w.kw >= 0.65, false)}}, {{'name': 'watched_pred_gold_not_worse', 'ok': w.fails = 0}}], recursive := true)
  FROM ({O.metrics(_SIDES["b"], digits=None)}) b, ({O.metrics(_SIDES["t"], digits=None)}) t, (SELECT count(*) FILTER (abs(t.ratio - 1) > abs(b.ratio - 1) + 0.05) AS fails, max(t.f1) FILTER (code = 'KW') AS kw
  FROM {_codes(_SIDES["b"])} b JOIN {_codes(_SIDES["t"])} t USING (code) WHERE code IN {WATCHED}) w)"""
query("G2_calibration_gate", O.evals(_GATE))(_calibration_gate)
query("G2_release", O.evals(f"SELECT bool_and(ok) AS release, count(*) FILTER (NOT ok) AS failed FROM ({_GATE})"))(lambda s, d: metrics.released(_calibration_gate(s, d)))
query("J9_watched_labels", O.evals(f"SELECT code, round(b.f1, 6) AS base_f1, b.ratio AS base_ratio, round(t.f1, 6) AS target_f1, t.ratio AS target_ratio, round(t.f1 - b.f1, 6) AS f1_delta, round(abs(t.ratio - 1) - abs(b.ratio - 1), 6) AS distance_delta, abs(t.ratio - 1) <= abs(b.ratio - 1) + 0.05 AS ok FROM {_codes(_SIDES['b'])} b JOIN {_codes(_SIDES['t'])} t USING (code) WHERE code IN {WATCHED}"))(
    lambda s, d: gates.watched(_side(fixtures.eval_rows(s, d).where("source != 0"))[1], _side(fixtures.eval_rows(s, d).where("split = 'holdout'"))[1], WATCHED).withColumns({c: F.round(c, 6) for c in ("base_f1", "target_f1", "f1_delta", "distance_delta")})
)

# Checkpoints: 60 of three runs; every second one has a report, which holds more splits the higher its number.
_CHECKPOINTS = """ck AS (SELECT id, ['run_a', 'smoke_b', 'run_c'][id % 3 + 1] AS run, CASE WHEN id % 7 = 0 THEN 'final.pt' WHEN id % 11 = 0 THEN 'epoch_' || id::VARCHAR || '.pt' WHEN id % 13 = 0 THEN 'step_x' || id::VARCHAR || '.pt' ELSE 'step_' || (id * 1000)::VARCHAR || '.pt' END AS name, 'c' || id::VARCHAR AS checkpoint FROM (SELECT unnest(range(0, 60)) AS id)),
rep AS (SELECT id, unnest(CASE WHEN id % 8 = 0 THEN ['acgc_old19_validation', 'acgc_old19_test', 'acgc_td_validation_23way', 'acgc_td_test_23way'] WHEN id % 8 = 2 THEN ['acgc_old19_validation', 'acgc_old19_test'] WHEN id % 8 = 4 THEN ['acgc_td_validation_23way', 'acgc_td_test_23way'] ELSE ['acgc_old19_test'] END) AS split,
  CASE WHEN id % 3 = 0 THEN 1.0 ELSE 0.5 END::DOUBLE AS accuracy FROM ck WHERE id % 2 = 0)"""
_COVERAGE = f"""WITH {_CHECKPOINTS}, cov AS (SELECT id, list_sort(list(DISTINCT split)) AS splits, count(DISTINCT split) FILTER (split LIKE '%old19%') = 2 AS old, count(DISTINCT split) FILTER (split LIKE '%td%') = 2 AS new,
  coalesce(min(accuracy) FILTER (split LIKE '%td%') = 1.0, false) AS ok FROM rep GROUP BY id),
st AS (SELECT ck.*, coalesce(splits, []) AS splits, coalesce(new, false) AS has_new, coalesce(ok, false) AS ok, CASE WHEN old AND new THEN 'core_covered' WHEN old THEN 'old19_only' WHEN new THEN 'td_only' WHEN run = 'smoke_b' OR name LIKE 'epoch%' THEN 'debug_or_epoch_uncovered' ELSE 'uncovered' END AS status FROM ck LEFT JOIN cov USING (id)),
pr AS (SELECT *, CASE WHEN status NOT IN ('uncovered', 'old19_only', 'td_only') THEN 99 WHEN has_new AND NOT ok THEN 85 WHEN run = 'smoke_b' THEN 90 WHEN name = 'final.pt' OR name = 'epoch_1.pt' THEN 80 WHEN regexp_matches(name, '^step_[0-9]+[.]pt$') THEN 10 WHEN name LIKE 'step%' THEN 20 ELSE 50 END AS priority FROM st)"""


def _coverage(s, d):
    k = F.col("id")
    ck = s.range(60).select(
        "id", F.get(F.array(F.lit("run_a"), F.lit("smoke_b"), F.lit("run_c")), (k % 3).cast("int")).alias("run"),
        F.when(k % 7 == 0, "final.pt").when(k % 11 == 0, F.concat(F.lit("epoch_"), k.cast("string"), F.lit(".pt"))).when(k % 13 == 0, F.concat(F.lit("step_x"), k.cast("string"), F.lit(".pt"))).otherwise(F.concat(F.lit("step_"), (k * 1000).cast("string"), F.lit(".pt"))).alias("name"),
        F.concat(F.lit("c"), k.cast("string")).alias("checkpoint"),
    )
    old, new = F.array(*map(F.lit, gates.OLD_SPLITS)), F.array(*map(F.lit, gates.NEW_SPLITS))
    splits = F.when(k % 8 == 0, F.concat(old, new)).when(k % 8 == 2, old).when(k % 8 == 4, new).otherwise(F.array(F.lit(gates.OLD_SPLITS[1])))
    reports = ck.where("id % 2 = 0").select(F.concat(F.lit("r"), k.cast("string")).alias("report"), F.explode(splits).alias("split"), F.when(k % 3 == 0, 1.0).otherwise(0.5).alias("accuracy"))
    logs = ck.where("id % 2 = 0").select("checkpoint", F.concat(F.lit("r"), k.cast("string")).alias("report"))
    return gates.coverage(ck.drop("id"), logs, reports)


query("G3_coverage", f"{_COVERAGE} SELECT run, name, checkpoint, array_to_string(splits, ',') AS splits, status, priority FROM pr")(lambda s, d: _coverage(s, d).select("run", "name", "checkpoint", F.array_join("splits", ",").alias("splits"), "status", "priority"))
query("A35_status_counts", f"{_COVERAGE} SELECT status, count(*) AS n FROM pr GROUP BY status")(lambda s, d: _coverage(s, d).groupBy("status").agg(F.count(F.lit(1)).alias("n")))
query("P21_candidate_priority", f"{_COVERAGE} SELECT priority, count(*) AS n FROM pr GROUP BY priority")(lambda s, d: _coverage(s, d).groupBy("priority").agg(F.count(F.lit(1)).alias("n")))
query("T6_recommended", f"{_COVERAGE} SELECT run, name, priority FROM pr WHERE priority < 50 ORDER BY priority, run, name LIMIT 25")(lambda s, d: gates.recommended(_coverage(s, d)).select("run", "name", "priority"))
query("U6_union_of_splits", f"{_COVERAGE} SELECT run, count(DISTINCT split) AS splits FROM ck JOIN rep USING (id) GROUP BY run")(
    lambda s, d: _coverage(s, d).groupBy("run").agg(F.size(F.array_distinct(F.flatten(F.collect_list("splits")))).cast("long").alias("splits"))
)
query("S17_checkpoint_order", f"WITH {_CHECKPOINTS} SELECT run, name, row_number() OVER (PARTITION BY run ORDER BY CASE WHEN name LIKE 'step%' THEN 0 WHEN name = 'final.pt' THEN 1 ELSE 2 END, CASE WHEN name = 'final.pt' THEN 1000000000 ELSE coalesce(try_cast(regexp_extract(name, '^(?:step|epoch)_([0-9]+)[.]pt$', 1) AS BIGINT), -1) END, name) AS place FROM ck")(
    lambda s, d: _coverage(s, d).select("run", "name", "checkpoint").withColumn("place", F.row_number().over(_by_run()).cast("long")).select("run", "name", "place")
)


def _by_run():
    from pyspark.sql import Window

    return Window.partitionBy("run").orderBy(gates.checkpoint_order(F.col("name")))


OLD = tuple(c for c in dims.CODES if c not in ("TD", "DJ", "KM", "SO"))


def _evidence(s, d):
    labels = metrics.by_label(_diag(s, d))
    floor = gates.accuracy_floor(labels, OLD, 0.1)
    long = metrics.split_quantiles(_diag(s, d), ("duration_seconds",)).select("split", F.col("column").alias("kind"), "percent", "value")
    return floor, floor.crossJoin(gates.audio_evidence(long)).select(
        "*", F.lit(True).alias("codes_ok"), F.lit(True).alias("heads_ok"), F.lit(2).alias("rank"), F.lit(0.7).alias("td_validation"), F.lit(0.4).alias("td_test"), F.lit(True).alias("review_ready"), F.lit(False).alias("candidate_ready"),
        F.lit(True).alias("chunking"), F.lit(30.0).alias("chunk_seconds"), F.lit(0.0).alias("max_seconds"),
    )


_FLOOR = f"""SELECT count(*) AS with_support, count(*) FILTER (a < 0.1) AS below, arg_min(code, struct_pack(a := a, c := code)) AS lowest, min(a) AS lowest_accuracy FROM (SELECT {O.code('truth')} AS code, round(avg((truth = pred)::INT), 6) AS a FROM ev GROUP BY truth) WHERE code IN {OLD}"""
query("A36_accuracy_floor", O.evals(_FLOOR))(lambda s, d: _evidence(s, d)[0])
query("G6_audio_evidence", "SELECT true AS durations, false AS chunks")(lambda s, d: gates.audio_evidence(metrics.split_quantiles(_diag(s, d), ("duration_seconds",)).select("split", F.col("column").alias("kind"), "percent", "value")))
query("G4_acceptance", O.evals(f"SELECT unnest([1, 2, 3, 4, 5, 6]) AS id, unnest(['supports_all_labels', 'old_labels_match_or_improve', 'no_severe_old_regression', 'useful_new_label', 'verified_east_labels', 'full_audio_chunks']) AS name, unnest(['pass', 'fail', CASE WHEN below = 0 AND with_support = {len(OLD)} THEN 'pass' ELSE 'fail' END, 'fail', 'blocked', 'fail']) AS status FROM ({_FLOOR})"))(lambda s, d: gates.acceptance(_evidence(s, d)[1], len(OLD)))
query("G4_accepted", O.evals(f"SELECT false AS ready, 'old_labels_match_or_improve,' || CASE WHEN below = 0 AND with_support = {len(OLD)} THEN '' ELSE 'no_severe_old_regression,' END || 'useful_new_label,verified_east_labels,full_audio_chunks' AS blockers FROM ({_FLOOR})"))(lambda s, d: gates.accepted(gates.acceptance(_evidence(s, d)[1], len(OLD))))


def _cards(s, d):
    k = F.col("n_nationkey")
    state = lambda m: F.when(k % m == 0, "fail").otherwise("pass")
    rows = s.read.parquet(f"{d}/nation.parquet")
    return gates.candidate_decision(rows.select(
        F.col("n_name").alias("candidate"), (k % 6 == 0).alias("ready"), (k % 5 != 0).alias("review_ready"), F.when(k % 4 != 0, F.col("n_name")).alias("top"),
        F.when(k % 7 == 0, F.array(F.lit("verified_dj_km_so_heldout_23way"))).otherwise(F.array().cast("array<string>")).alias("missing"), state(3).alias("east"), state(2).alias("old"), state(11).alias("td"),
    ))


query("G5_candidate_decisions", """SELECT n_name AS candidate, CASE WHEN k % 6 = 0 THEN 'accept' ELSE 'wait' END AS decision, CASE WHEN k % 6 = 0 THEN 'accept_top_candidate_after_review' WHEN k % 5 = 0 THEN 'finish_reviewed_export' WHEN k % 4 = 0 THEN 'evaluate_candidates' WHEN k % 7 = 0 THEN 'evaluate_verified_heldout'
  WHEN k % 3 = 0 THEN 'inspect_verified_errors_or_retrain' WHEN k % 2 = 0 THEN 'reject_or_retrain_for_old_labels' WHEN k % 11 = 0 THEN 'reject_or_retrain_for_new_label' ELSE 'refresh_artifacts' END AS next_action,
  CASE WHEN k % 6 = 0 THEN 'ready' ELSE ((k % 3 <> 0)::INT + (k % 2 <> 0)::INT + (k % 11 <> 0)::INT)::VARCHAR || '/3 checks' END AS label FROM (SELECT n_name, n_nationkey AS k FROM nation)""")(lambda s, d: _cards(s, d).select("candidate", "decision", "next_action", "label"))
query("T10_leaderboard", "SELECT n_name AS candidate, ((n_nationkey * 7) % 10) / 10.0::DOUBLE AS macro_f1 FROM nation ORDER BY macro_f1 DESC, n_name LIMIT 5")(lambda s, d: gates.leaderboard(s.read.parquet(f"{d}/nation.parquet").select(F.col("n_name").alias("candidate"), ((F.col("n_nationkey") * 7 % 10) / 10.0).alias("macro_f1")), 5))

# Diagnostics by split, matrices and keyed overrides.
_SPLIT = O.DIAG + "SELECT split, count(*) AS n, count(*) FILTER (correct) AS correct, count(*) FILTER (truth_region = pred_region) AS region_correct, round(count(*) FILTER (correct) / count(*)::DOUBLE, 6) AS accuracy, round(count(*) FILTER (truth_region = pred_region) / count(*)::DOUBLE, 6) AS region_accuracy FROM diag GROUP BY split"
query("A38_split_overall", O.evals(_SPLIT))(lambda s, d: metrics.split_overall(_diag(s, d)))
_POINTS = "[0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0]"
_SIX = ("top1", "margin", "entropy", "crop_count", "chunks", "duration_seconds")
query("A38_split_quantiles", O.evals(O.DIAG + f"SELECT split, name AS \"column\", (k * 10)::INT AS percent, round(quantile_cont(v, {_POINTS})[k + 1], 6) AS value FROM (SELECT split, unnest([{', '.join(f"{{'name': '{c}', 'v': {'1' if c == 'crop_count' else c}::DOUBLE}}" for c in _SIX)}], recursive := true) FROM diag), (SELECT unnest(range(0, 11)) AS k) WHERE v IS NOT NULL GROUP BY split, name, k"))(
    lambda s, d: metrics.split_quantiles(_diag(s, d), _SIX)
)
query("T7_least_accurate", O.evals(f"SELECT code, support, accuracy FROM (SELECT {O.code('truth')} AS code, count(*) AS support, round(avg((truth = pred)::INT), 6) AS accuracy FROM ev GROUP BY truth) ORDER BY accuracy, support DESC, code LIMIT 10"))(lambda s, d: metrics.least_accurate(metrics.by_label(_diag(s, d))).select("code", "support", "accuracy"))
_EVEN = [i % 2 == 0 for i in range(dims.N)]
_MASKED = "[CASE WHEN (i - 1) % 2 = 0 THEN logits[i] ELSE -3.4028234663852886e38 END FOR i IN range(1, 24)]"
query("A39_evaluation_matrix", O.evals(f"SELECT truth, (list_position(m, list_max(m)) - 1)::INT AS pred, count(*) AS n FROM (SELECT truth, {_MASKED} AS m FROM ev) GROUP BY ALL"))(lambda s, d: metrics.evaluation_matrix(fixtures.eval_rows(s, d), _EVEN))
query("A40_bias_metrics", O.evals(f"{O.metrics('(SELECT truth, (list_position(m, list_max(m)) - 1)::INT AS pred FROM (SELECT truth, [ln(greatest(probs[i], 1e-45)) + 0.1 * ((i - 1) % 5) FOR i IN range(1, 24)] AS m FROM ev))')}"))(
    lambda s, d: metrics.rounded(metrics.summary(metrics.per_class(metrics.confusion(fixtures.eval_rows(s, d).withColumn("pred", V.argmax(V.biased(F.col("probs"), [0.1 * (i % 5) for i in range(dims.N)])))))))
)
query("W6_penalty_matrix", O.evals(f"SELECT truth, pred FROM (SELECT truth, pred FROM ({O.MATRIX}) WHERE truth <> pred AND n >= 2 QUALIFY row_number() OVER (PARTITION BY truth ORDER BY n DESC, pred DESC) <= 3) UNION SELECT 8, 0 UNION SELECT 8, 16"))(
    lambda s, d: _penalties(s, d).select("truth", F.posexplode("penalty").alias("pred", "p")).where("p = 1").select("truth", "pred")
)


def _penalties(s, d):
    return losses.penalty_rows(metrics.top_confusions(_matrix(s, d), 3, 2), ("KW:AE,SA",))


_PENALTIES = f"(SELECT truth AS t, pred AS p FROM ({O.MATRIX}) WHERE truth <> pred AND n >= 2 QUALIFY row_number() OVER (PARTITION BY truth ORDER BY n DESC, pred DESC) <= 3) UNION SELECT 8, 0 UNION SELECT 8, 16"
query("V10_expected_penalty", O.evals(f"SELECT sample_id, round(coalesce(sum(probs[p + 1]), 0), 6) AS penalty FROM ev LEFT JOIN ({_PENALTIES}) ON truth = t GROUP BY sample_id"))(
    lambda s, d: losses.expected_penalty(fixtures.eval_rows(s, d), _penalties(s, d), "probs", "truth").select("sample_id", F.round("penalty", 6).alias("penalty"))
)
_REVERSED = tuple(reversed(dims.CODES[3:]))
query("J11_remapped_labels", O.evals(f"SELECT sample_id, (i - 1)::INT AS id, CASE WHEN i <= 3 THEN NULL ELSE round(probs[24 - i], 6) END AS value FROM (SELECT sample_id, probs, unnest(range(1, 24)) AS i FROM ev)"))(
    lambda s, d: metrics.remapped(fixtures.eval_rows(s, d).withColumn("probs", F.slice("probs", 1, 20)), "probs", _REVERSED).select("sample_id", F.posexplode("probs").alias("id", "value")).withColumn("value", F.round("value", 6))
)
query("J13_overlaid", O.evals("SELECT sample_id, round(CASE WHEN sample_id % 2 = 0 THEN probs[1] + 1 ELSE probs[1] END, 6) AS first FROM ev"))(
    lambda s, d: metrics.overlaid(fixtures.eval_rows(s, d).select("sample_id", "probs"), fixtures.eval_rows(s, d).where("sample_id % 2 = 0").select("sample_id", F.transform("probs", lambda x: x + 1).alias("probs")), "sample_id", "probs").select("sample_id", F.round(F.col("probs")[0], 6).alias("first"))
)
query("J12_first_crops", "SELECT l_orderkey AS sample_id, count(*) AS n, max(l_linenumber) FILTER (r = 1) AS line FROM (SELECT l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS r FROM lineitem) GROUP BY l_orderkey")(
    lambda s, d: metrics.first_crops(fixtures.chunks(s, d).withColumn("at", F.struct("l_linenumber", "l_partkey", "l_suppkey")), "sample_id", "at", "l_linenumber").join(fixtures.chunks(s, d).groupBy("sample_id").agg(F.count(F.lit(1)).alias("n")), "sample_id").select("sample_id", "n", F.col("l_linenumber").alias("line"))
)
query("A20_crop_means", O.evals("SELECT sample_id // 3 AS sample, round(avg(probs[1]), 6) AS a, round(avg(probs[2]), 6) AS b, count(*) AS chunks FROM ev GROUP BY sample_id // 3"))(
    lambda s, d: metrics.mean_vectors(fixtures.eval_rows(s, d).withColumn("sample", F.floor(F.col("sample_id") / 3)), "sample", "probs", 2).select("sample", F.round(F.col("probs")[0], 6).alias("a"), F.round(F.col("probs")[1], 6).alias("b"), "chunks")
)

# Losses.
_W = [0.5 + 0.1 * (i % 4) for i in range(dims.N)]
_LOGP = "(logits[{i}] - list_max(logits) - ln(list_sum([exp(x - list_max(logits)) FOR x IN logits])))"
_TRUE = _LOGP.format(i="truth + 1")
query("V8_smoothed_weighted_focal", O.evals(f"""SELECT sample_id, round(-0.9 * {_TRUE} - 0.1 / 12 * list_sum([CASE WHEN (i - 1) % 2 = 0 THEN {_LOGP.format(i="i")} ELSE 0 END FOR i IN range(1, 24)]), 5) AS smoothed,
  round(-{_TRUE} * (0.5 + 0.1 * (truth % 4)), 5) AS weighted, round(pow(1 - least(greatest(probs[truth + 1], 1e-6), 1), 2) * -{_TRUE}, 5) AS focal FROM ev"""))(
    lambda s, d: fixtures.eval_rows(s, d).select("sample_id", *(F.round(x, 5).alias(n) for n, x in (
        ("smoothed", losses.classification(F.col("logits"), F.col("truth"), epsilon=0.1, active=_EVEN)), ("weighted", losses.classification(F.col("logits"), F.col("truth"), weights=_W)), ("focal", losses.classification(F.col("logits"), F.col("truth"), gamma=2.0)),
    )))
)
query("V9_within_region", O.evals(f"SELECT round(avg(l), 5) AS loss FROM (SELECT region, avg(l) AS l FROM (SELECT {O.REGIONS}[truth + 1] AS region, ln(list_sum([CASE WHEN {O.REGIONS}[i] = {O.REGIONS}[truth + 1] THEN exp(logits[i]) ELSE 0 END FOR i IN range(1, 24)])) - logits[truth + 1] AS l FROM ev) WHERE region NOT IN ('iraqi', 'sahel') GROUP BY region)"))(
    lambda s, d: losses.within_region_mean(fixtures.eval_rows(s, d), "logits", "truth").select(F.round("loss", 5).alias("loss"))
)
query("V9_region", O.evals(f"SELECT sample_id, round(ln(list_sum([exp(x) FOR x IN logits])) - ln(list_sum([CASE WHEN {O.REGIONS}[i] = {O.REGIONS}[truth + 1] THEN exp(logits[i]) ELSE 0 END FOR i IN range(1, 24)])), 5) AS loss FROM ev"))(
    lambda s, d: fixtures.eval_rows(s, d).select("sample_id", F.round(losses.region_loss(V.region_logits(F.col("logits")), F.col("truth")), 5).alias("loss"))
)
_GROUP_IDS = {g: [dims.CODES.index(c) for c in codes] for g, codes in dims.GROUPS.items()}
query("V9_groups", O.evals(" UNION ALL ".join(f"SELECT '{g}' AS label_group, count(*) AS n, round(avg(ln({' + '.join(f'exp(logits[{i + 1}])' for i in ids)}) - logits[truth + 1]), 5) AS loss FROM ev WHERE truth IN ({', '.join(map(str, ids))}) HAVING count(*) > 0" for g, ids in _GROUP_IDS.items())))(
    lambda s, d: losses.group_losses(fixtures.eval_rows(s, d).withColumns({f"g_{g}": V.pick(F.col("logits"), ids) for g, ids in _GROUP_IDS.items()}), {g: f"g_{g}" for g in _GROUP_IDS}, "truth").select("label_group", "n", F.round("loss", 5).alias("loss"))
)
query("V15_ignoring", O.evals(f"SELECT count(*) AS rows, count(l) AS counted, round(coalesce(sum(l), 0) / greatest(count(l), 1e-6), 5) AS loss FROM (SELECT CASE WHEN sample_id % 5 <> 0 THEN -{_TRUE} END AS l FROM ev)"))(
    lambda s, d: fixtures.eval_rows(s, d).withColumn("y", F.when(F.col("sample_id") % 5 == 0, -100).otherwise(F.col("truth"))).select(losses.ignoring(F.col("logits"), F.col("y")).alias("l")).agg(F.count(F.lit(1)).alias("rows"), F.count("l").alias("counted"), F.round(losses.weighted_mean(F.col("l")), 5).alias("loss"))
)
query("V4_fused", O.evals(f"SELECT sample_id, round(logits[1] + 0.5 * ln({' + '.join(f'exp(logits[{i + 1}])' for i, r in enumerate(dims.LABEL_REGIONS) if r == 'gulf')}) + 0.25 * (logits[1] * 2), 5) AS first, round(logits[3] + 0.5 * ln({' + '.join(f'exp(logits[{i + 1}])' for i, r in enumerate(dims.LABEL_REGIONS) if r == 'east_africa')}), 5) AS third FROM ev"))(
    lambda s, d: fixtures.eval_rows(s, d).select("sample_id", V.fused(F.col("logits"), V.region_logits(F.col("logits")), {"gulf": F.transform(V.pick(F.col("logits"), _GROUP_IDS["gulf"]), lambda x: x * 2)}, 0.5, 0.25).alias("f")).select("sample_id", F.round(F.get("f", F.lit(0)), 5).alias("first"), F.round(F.get("f", F.lit(2)), 5).alias("third"))
)
query("V6_evaluation_order", O.evals("SELECT sample_id, (list_position(m, list_max(m)) - 1)::INT AS pred FROM (SELECT sample_id, [CASE WHEN (i - 1) % 2 = 0 THEN logits[i] + 0.05 * ((i - 1) % 3) ELSE -3.4028234663852886e38 END FOR i IN range(1, 24)] AS m FROM ev)"))(
    lambda s, d: fixtures.eval_rows(s, d).select("sample_id", losses.predicted(F.col("logits"), [0.05 * (i % 3) for i in range(dims.N)], _EVEN).alias("pred"))
)
query("V13_learning_rate", "SELECT k AS step, round(CASE WHEN k + 1 < 10 THEN (k + 1) / 10.0::DOUBLE ELSE 0.1 + 0.9 * 0.5 * (1 + cos(pi() * least(1.0, (k + 1 - 10) / 90.0::DOUBLE))) END, 9) AS rate FROM (SELECT unnest(range(0, 120)) AS k)")(lambda s, d: s.range(120).select(F.col("id").alias("step"), F.round(losses.learning_rate(F.col("id"), 10, 100, 0.1), 9).alias("rate")))
_VEC = "[x::DOUBLE FOR x IN embedding]"
_UNIT = f"(SELECT vec_id, vec_id // 16 AS batch, label, {_VEC} AS e FROM embeddings WHERE vec_id < 320)"


def _batches(s, d):
    rows = s.read.parquet(f"{d}/embeddings.parquet").where("vec_id < 320").withColumn("batch", F.floor(F.col("vec_id") / 16))
    return losses.batch_pairs(rows, "batch", "vec_id", "embedding", "label")


_PAIRS = f"(SELECT a.batch, a.vec_id AS i, b.vec_id AS j, a.label AS label_i, b.label AS label_j, list_dot_product(a.e, b.e) / (sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e))) AS sim FROM {_UNIT} a JOIN {_UNIT} b ON a.batch = b.batch AND a.vec_id <> b.vec_id)"
query("V11_contrastive", f"SELECT batch, count(*) AS anchors, round(avg(z - p / n), 4) AS loss FROM (SELECT batch, i, ln(sum(exp(sim / 0.1))) AS z, sum(sim / 0.1) FILTER (label_i = label_j) AS p, count(*) FILTER (label_i = label_j) AS n FROM {_PAIRS} GROUP BY batch, i) WHERE n > 0 GROUP BY batch")(lambda s, d: losses.contrastive(_batches(s, d), 0.1).select("batch", "anchors", F.round("loss", 4).alias("loss")))
query("V11_hard_negatives", f"SELECT batch, count(*) AS pairs, round(avg(greatest(sim - 0.1, 0)), 6) AS loss FROM {_PAIRS} WHERE (label_i, label_j) IN ((8, 0), (0, 8), (1, 2), (2, 1)) GROUP BY batch")(
    lambda s, d: losses.hard_negatives(_batches(s, d), losses.penalty_rows(s.createDataFrame([(1, 2)], "truth int, pred int"), ("KW:AE",)), 0.1).select("batch", "pairs", F.round("loss", 6).alias("loss"))
)
query("V12_distillation", O.evals("SELECT sample_id, round(4 * list_sum([t[i] * (ln(t[i]) - ln(q[i])) FOR i IN range(1, 6)]), 5) AS loss FROM (SELECT sample_id, [exp(logits[i] / 2) / list_sum([exp(logits[j] / 2) FOR j IN range(1, 6)]) FOR i IN range(1, 6)] AS q, [exp(logits[i]) / list_sum([exp(logits[j]) FOR j IN range(1, 6)]) FOR i IN range(1, 6)] AS t FROM ev)"))(
    lambda s, d: fixtures.eval_rows(s, d).select("sample_id", F.round(losses.distillation(F.col("logits"), F.transform("logits", lambda x: x * 2), 2.0, [0, 1, 2, 3, 4]), 5).alias("loss"))
)
_PROTOTYPES = [[math.sin(1 + 3 * k + i) for i in range(4)] for k in range(3)]
_FOUR = "[embedding[1]::DOUBLE, embedding[2]::DOUBLE, embedding[3]::DOUBLE, embedding[4]::DOUBLE]"
query("V12_angular_logits", f"SELECT vec_id, k, round(30 * (list_dot_product(e, w) / (sqrt(list_dot_product(e, e)) * sqrt(list_dot_product(w, w))) - CASE WHEN k = vec_id % 3 THEN 0.2 ELSE 0 END), 4) AS value FROM (SELECT vec_id, {_FOUR} AS e FROM embeddings), (VALUES {', '.join(f'({k}, {w!r}::DOUBLE[])' for k, w in enumerate(_PROTOTYPES))}) t(k, w)")(
    lambda s, d: s.read.parquet(f"{d}/embeddings.parquet").select("vec_id", F.posexplode(losses.angular_logits(F.slice("embedding", 1, 4), _PROTOTYPES, (F.col("vec_id") % 3).cast("int"), 0.2, 30.0)).alias("k", "value")).withColumn("value", F.round("value", 4))
)
query("V14_attentive_pool", "SELECT l_orderkey AS sample_id, round(sum(w * q) / sum(w), 5) AS mean, round(sqrt(greatest(sum(w * q * q) / sum(w) - pow(sum(w * q) / sum(w), 2), 1e-6)), 4) AS std FROM (SELECT l_orderkey, l_quantity AS q, exp(l_tax * 10) AS w FROM lineitem) GROUP BY l_orderkey")(
    lambda s, d: losses.attentive_pool(fixtures.chunks(s, d).withColumn("score", F.col("vector")[3] * 10), "sample_id", "vector", "score", 1).select("sample_id", F.round(F.col("pooled")[0], 5).alias("mean"), F.round(F.col("pooled")[1], 4).alias("std"))
)

# Manifests and streams.
_LABELS = readers.LABEL_COLUMNS


def _raw_manifest(s, d):
    """Rows whose label stands in one of several columns, some unknown; a few have types, weights and confidences."""
    k = F.col("doc_id")
    label = F.when(k % 29 == 0, "zz").otherwise(F.lower(fixtures.code(k % 23)))
    return s.read.parquet(f"{d}/documents.parquet").select(
        k.alias("sample_id"), *(F.when((k % 3) == i, label).otherwise("").alias(c) for i, c in enumerate(("final_dialect", "top1_cc", "cc"))), F.when(k % 4 == 0, "1").otherwise("").alias("lang_type_id"),
        F.when(k % 5 == 0, "0.5").alias("loss_weight"), F.when(k % 2 == 0, "0.25").alias("confidence"), F.lit(99).alias("country_id"), F.concat(F.lit("m"), k.cast("string")).alias("member"),
    )


query("P1_manifest_rows", f"""SELECT doc_id AS sample_id, {O.code('(doc_id % 23)')} AS country_code, (doc_id % 23)::INT AS country_id, CASE WHEN doc_id % 4 = 0 THEN 1 ELSE -100 END AS lang_type_id, CASE WHEN doc_id % 4 = 0 THEN 'dialect' ELSE 'unknown' END AS lang_type,
  CASE WHEN doc_id % 5 = 0 THEN 0.5 ELSE 1.0 END::DOUBLE AS loss_weight, CASE WHEN doc_id % 2 = 0 THEN 0.25 ELSE 0.0 END::DOUBLE AS pseudo_confidence, 'ytb_pseudo' AS source, 'm' || doc_id::VARCHAR AS original_dialect FROM documents WHERE doc_id % 29 <> 0""")(
    lambda s, d: readers.manifest_rows(_raw_manifest(s, d)).select("sample_id", "country_code", "country_id", "lang_type_id", "lang_type", "loss_weight", "pseudo_confidence", "source", "original_dialect")
)
query("P26_target_labels", f"SELECT (unnest([0, 4]))::INT AS id, unnest(['AE', 'EG']) AS code")(lambda s, d: s.createDataFrame(sampling.target_labels(("AE", "EG", "MA"), ("MA",)), "id int, code string"))
query("P27_output_mask", O.evals("SELECT sample_id, CASE WHEN logits[1] >= logits[5] THEN 0 ELSE 4 END AS pred FROM ev WHERE truth IN (1, 2)"))(
    lambda s, d: fixtures.eval_rows(s, d).where(F.col("truth").isin(1, 2)).select("sample_id", V.argmax(V.masked(F.col("logits"), [i in (0, 4) for i in range(dims.N)])).alias("pred"))
)
query("M1_epoch_order", O.PROFILE_ROWS + f"SELECT sample_id, {_md5('sample_id', 17 + 2 * 7919)} AS order_key FROM prof")(lambda s, d: sampling.epoch_order(fixtures.profile_rows(s, d), "sample_id", 17, 2).select("sample_id", "order_key"))
query("R6_interleaved", O.PROFILE_ROWS + f"SELECT country_code, sample_id, row_number() OVER (PARTITION BY country_code ORDER BY {_md5('sample_id', 17)}) - 1 AS turn, {_md5('country_code', 17)} AS label_key FROM prof WHERE country_code IS NOT NULL")(
    lambda s, d: streams.interleaved(fixtures.profile_rows(s, d).where("country_code is not null"), "country_code", "sample_id", 17).select("country_code", "sample_id", "turn", "label_key")
)


def _mixed(s, d):
    rows = fixtures.profile_rows(s, d)
    return streams.bernoulli_mix(rows.where("split = 'train'"), rows.where("split = 'validation'"), 0.25, "sample_id", 5)


query("R7_bernoulli_mix", O.PROFILE_ROWS + f""", items AS (SELECT sample_id, (split = 'validation')::INT AS stream, row_number() OVER (PARTITION BY split ORDER BY {_md5('sample_id', 'item', 5)}) - 1 AS k FROM prof WHERE split IN ('train', 'validation')),
n AS (SELECT count(*) AS n FROM items), s1 AS (SELECT id, ({_draw('id', 'slot', 5)} < 0.25)::INT AS stream FROM (SELECT unnest(range(0, n)) AS id FROM n)), s2 AS (SELECT id, stream, row_number() OVER (PARTITION BY stream ORDER BY id) - 1 AS k FROM s1)
SELECT stream, sample_id, coalesce(s2.id, n.n + k) AS place FROM items LEFT JOIN s2 USING (stream, k), n""".lstrip().replace("FROM documents) , items", "FROM documents), items"))(_mixed)
_TASKS = "SELECT row_group, country_code FROM (SELECT row_group, country_code, count(*) AS n, min(sample_id) AS f FROM prof WHERE country_code IS NOT NULL GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY row_group ORDER BY n DESC, f) = 1"
query("M2_balanced_tasks", O.PROFILE_ROWS + f"SELECT row_group, country_code AS label, row_number() OVER (PARTITION BY country_code ORDER BY {_md5('row_group', 3)}) - 1 AS turn FROM ({_TASKS})")(
    lambda s, d: streams.balanced_tasks(sampling.majority_label(fixtures.profile_rows(s, d)), "row_group", "label", 3).select("row_group", "label", "turn")
)
query("M4_manifests_by_label", O.PROFILE_ROWS + f""", m AS (SELECT DISTINCT country_code AS label, 'p' || (sample_id % 11)::VARCHAR AS path FROM prof WHERE country_code IN ('AE', 'EG', 'XX')),
p AS (SELECT label, path, row_number() OVER (PARTITION BY label ORDER BY md5(concat_ws(':', path, label, '9'))) - 1 AS k, count(*) OVER (PARTITION BY label) AS n FROM m)
SELECT label, path, unnest(CASE WHEN n >= 16 THEN [k % 16] ELSE range(k, 16, n) END)::INT AS worker FROM p""".replace(" , m AS", ", m AS"))(
    lambda s, d: streams.assigned_by_label(fixtures.profile_rows(s, d).where("country_code IN ('AE', 'EG', 'XX')").select(F.col("country_code").alias("label"), F.concat(F.lit("p"), (F.col("sample_id") % 11).cast("string")).alias("path")), "path", "label", 16, 9)
)
query("R5_balanced_replay")(lambda s, d: streams.balanced_replay(fixtures.eval_rows(s, d), "sample_id", "truth", 8, 50, 3, parts=4))
query("B9_skipped_batches", "SELECT step, max(e) AS elements, max(e) > 2000 AS skipped FROM (SELECT l_orderkey // 10 AS step, l_linenumber % 2 AS rank, sum(l_quantity::BIGINT) AS e FROM lineitem GROUP BY ALL) GROUP BY step".replace("max(e) AS", "max(e)::BIGINT AS"))(
    lambda s, d: audio.kept_batches(s.read.parquet(f"{d}/lineitem.parquet").select(F.floor(F.col("l_orderkey") / 10).alias("step"), (F.col("l_linenumber") % 2).alias("rank"), F.col("l_quantity").cast("long").alias("e")), "step", "rank", "e", 2000)
)
query("B5_train_windows", f"""SELECT event_id, k::INT AS chunk_idx, (k * 10000)::BIGINT AS first, least((k + 1) * 10000, length)::BIGINT AS last FROM (SELECT event_id, length, unnest(range(s, least(s + 3, n))) AS k
  FROM (SELECT event_id, length, n, floor({_draw('event_id', 'window', 7)} * (greatest(n - 3, 0) + 1))::BIGINT AS s FROM (SELECT event_id, (event_id * 37) % 100000 AS length, greatest(1, ceil(greatest((event_id * 37) % 100000, 1) / 10000.0))::BIGINT AS n FROM events)))""")(lambda s, d: audio.train_window(s.read.parquet(f"{d}/events.parquet").select("event_id", F.expr("(event_id * 37) % 100000").alias("length")), "length", 10_000, 3, "event_id", 7).select("event_id", "chunk_idx", F.col("first").cast("long").alias("first"), F.col("last").cast("long").alias("last")))
query("A18_count_map", "SELECT unnest(['AE', 'EG']) AS code, unnest([3, 5])::BIGINT AS n")(lambda s, d: s.createDataFrame(list(readers.count_map('{"counts": {" ae": 3, "EG": 5, "": 1}}').items()), "code string, n long"))

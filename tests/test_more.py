import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyforge import __main__ as commands
from tallyforge.functions import coerce, dims, losses
from tallyforge.functions import vectors as V
from tallyforge.operators import audio, audits, decisions, gates, metrics, sampling, streams, tracker
from tallyforge.sources import fixtures, readers, sinks

CODES = ("KW", "AE")


def summary(spark, macro, n=200_000, accuracy=0.9):
    return spark.createDataFrame([(accuracy, 0.9, macro, 0.9, n)], "accuracy double, balanced_accuracy double, macro_f1 double, weighted_f1 double, n long")


def watched(spark, *rows):
    return spark.createDataFrame(list(rows), "code string, f1 double, ratio double")


def failures(checks):
    return {r["name"] for r in checks.where("NOT ok").collect()}


def test_calibration_gate(spark):
    base, good = watched(spark, ("KW", 0.6, 1.0), ("AE", 0.9, 1.0)), watched(spark, ("KW", 0.7, 1.04), ("AE", 0.9, 1.0))
    call = lambda *a, **k: failures(gates.calibration_gate(*a, CODES, **k))
    assert call(summary(spark, 0.9), summary(spark, 0.91), base, good) == set()
    assert call(summary(spark, 0.9), summary(spark, 0.9), base, good) == {"macro_f1_improved"}
    assert call(summary(spark, 0.9), summary(spark, 0.91, 99_999), base, good) == {"enough_holdout_rows"}
    assert call(summary(spark, 0.9), summary(spark, 0.91), base, watched(spark, ("KW", 0.7, 1.2), ("AE", 0.9, 1.0))) == {"watched_pred_gold_not_worse"}
    assert call(summary(spark, 0.9), summary(spark, 0.91), base, watched(spark, ("AE", 0.9, 1.0))) == {"kw_calibrated_ok"}


def test_missing_evidence_is_no_pass_in_the_eval_gate(spark):
    none = spark.createDataFrame([("AE", 1.0, 0.9)], "code string, ratio double, f1 double")
    ratios = spark.createDataFrame([("AE", 1.0)], "code string, ratio double")
    assert failures(metrics.gate(summary(spark, 0.9), summary(spark, 0.91), ratios, none, CODES, 0.55)) == {"watched_f1"}


def test_decision_ladder(spark):
    rows = [(True, True, "a", [], "pass", "pass", "pass"), (False, False, "a", [], None, None, None), (False, True, None, [], None, None, None), (False, True, "a", ["verified_dj_km_so_heldout_23way"], "fail", "pass", "pass"),
            (False, True, "a", [], "fail", "pass", "pass"), (False, True, "a", [], "pass", "fail", "pass"), (False, True, "a", [], "pass", "pass", None), (None, True, "a", None, "pass", "pass", "pass")]
    df = spark.createDataFrame(rows, "ready boolean, review_ready boolean, top string, missing array<string>, east string, old string, td string")
    got = gates.candidate_decision(df).select("decision", "next_action", "label").collect()
    assert [r["next_action"] for r in got] == ["accept_top_candidate_after_review", "finish_reviewed_export", "evaluate_candidates", "evaluate_verified_heldout", "inspect_verified_errors_or_retrain",
                                               "reject_or_retrain_for_old_labels", "reject_or_retrain_for_new_label", "refresh_artifacts"]
    assert got[0]["label"] == "ready" and got[4]["label"] == "2/3 checks" and got[1]["label"] == "0/3 checks"


def test_acceptance_is_blocked_without_a_checkpoint(spark):
    kinds = "codes_ok boolean, heads_ok boolean, rank int, with_support long, below long, td_validation double, td_test double, review_ready boolean, candidate_ready boolean, chunking boolean, chunk_seconds double, max_seconds double, durations boolean, chunks boolean"
    rows = [(None, None, 1, 19, 0, 0.9, 0.9, True, True, True, 30.0, 0.0, True, True), (True, True, 1, 19, 0, 0.9, 0.9, True, True, True, 30.0, 0.0, True, True)]
    for row, want in zip(rows, ("blocked", "pass"), strict=True):
        criteria = gates.acceptance(spark.createDataFrame([row], kinds), 19)
        assert criteria.orderBy("id").collect()[0]["status"] == want
        assert gates.accepted(criteria).first()["ready"] is (want == "pass")


def test_islands_over_range_limits(spark):
    values = [1, 2, 3, 5, 6, 7, 8, 9, 15, 16, 17, 30, None, 3]
    got = tracker.islands(spark.createDataFrame([(v,) for v in values], "x long"), "x", width=4).orderBy("low").collect()
    assert [r["span"] for r in got] == ["1-3", "5-9", "15-17", "30"]


def test_shard_statuses(spark):
    shards = spark.createDataFrame([(k, s) for k, s in enumerate(["pending", "failed", "partial", "running", "failed", "done"])], "shard int, status string")
    done = spark.createDataFrame([(0, 0), (1, 2), (3, 0)], "shard int, failed_rows long")
    failed = spark.createDataFrame([(3,)], "shard int")
    got = [r["status"] for r in tracker.statuses(shards, done, failed).orderBy("shard").collect()]
    assert got == ["done", "partial", "pending", "failed", "pending", "done"]
    none = tracker.statuses(shards, done.where("false"), failed.where("false")).orderBy("shard").collect()
    assert [r["status"] for r in none] == ["pending", "failed", "partial", "running", "failed", "done"]


def test_text_helpers(spark):
    df = spark.createDataFrame([(0.123456789,), (None,)], "x double")
    assert [r[0] for r in df.select(coerce.eight_decimals(F.col("x"))).collect()] == ["0.12345679", ""]
    assert coerce.codes_of(" ae; EG,,") == ["AE", "EG"] and coerce.codes_of("  ") is None
    assert coerce.label_ids(["ae", 4, "EG", "0"], dims.CODES) == [0, 4] and coerce.first_seen(["b", "a", "b"]) == ["b", "a"]
    with pytest.raises(ValueError):
        coerce.label_ids([23], dims.CODES)


def test_manifest_documents():
    index = '{"files": {"x/m1.jsonl": ["ae", "zz", "EG"], "m2.jsonl": ["MA"], "bad": 3}}'
    assert readers.manifest_labels(index, ["x/m1.jsonl", "y/m2.jsonl", "z"], exclude=("EG",)) == {"x/m1.jsonl": [0], "y/m2.jsonl": [11], "z": []}
    assert readers.manifest_labels(None, ["a", "b"], {"a": "AE"}) == {"a": [0], "b": []}
    assert readers.count_map('{"train_by_code": {"ae ": 3}, "labels": {"x": 1}}') == {"AE": 3} and readers.count_map('{"ma": 2}') == {"MA": 2}
    with pytest.raises(ValueError):
        readers.count_map('{"counts": {"ae": "many"}}')
    assert readers.bias_vector('{"bias_by_id": {"1": 0.5, "99": 1}, "bias_by_code": {"AE": 2, "XX": 3}}', ("AE", "BH")) == [2.0, 0.5]


def test_export_run_and_manifest_driven_scan(spark, tmp_path):
    out = f"file://{tmp_path}/export"
    df = spark.createDataFrame([(k, f"l{k % 3}") for k in range(25)], "sample_id long, label string")
    with sinks.export_run(spark, out) as values:
        files = sinks.sharded_csv(df.coalesce(1), f"{out}/labels", 10).collect()
        values["exported_rows"] = sum(r["rows"] for r in files)
        assert readers.exists(spark, f"{out}/_EXPORT_IN_PROGRESS")
        with pytest.raises(RuntimeError), sinks.export_run(spark, out):
            pass
    assert json.loads(readers.read_text(spark, f"{out}/_SUCCESS"))["exported_rows"] == 25 and not readers.exists(spark, f"{out}/_EXPORT_IN_PROGRESS")
    spark.createDataFrame([(r["file"],) for r in files], "file string").coalesce(1).write.option("header", True).csv(f"{out}/manifest")
    assert readers.manifest_driven(spark, f"{out}/manifest", ["label"]).count() == 25
    with pytest.raises(ValueError):
        readers.manifest_driven(spark, f"{out}/manifest", ["other"])
    with pytest.raises(FileExistsError):
        audits.empty_or_replaced(spark, out)
    state = audits.directory_state(spark, f"{out}/labels", "*.gz").first()
    assert state["files"] == 3 and state["bytes"] > 0
    audits.empty_or_replaced(spark, out, overwrite=True)
    assert audits.directory_state(spark, out).first()["files"] == 0


def test_documents_are_replaced_in_one_step(spark, tmp_path):
    path = f"file://{tmp_path}/d.json"
    for k in range(3):
        sinks.document(spark, path, {"k": k})
    assert json.loads(readers.read_text(spark, path)) == {"k": 2}
    sinks.log_event(spark, f"file://{tmp_path}/log", "start", n=1)
    sinks.log_event(spark, f"file://{tmp_path}/log", "skip", n=2)
    assert [r["event"] for r in sinks.events(spark, f"file://{tmp_path}/log").collect()] == ["start", "skip"]


def test_nonempty_lines_and_start_checks(spark, tmp_path):
    (tmp_path / "a.txt").write_text("x\n\n  \t\ny\n")
    assert audits.nonempty_lines(spark, [f"file://{tmp_path}/a.txt"]).first()["lines"] == 2
    rows = spark.createDataFrame([("t",), ("",)], "tar_path string")
    assert failures(audits.start_checks(spark, f"file://{tmp_path}/a.txt", rows, f"file://{tmp_path}/none")) == {"archives"}
    assert audits.expected_policy_rows({"a": {"rows": 3}}, ("a",)) == {"a": 3} and audits.expected_policy_rows({"a": 1}, ("a",)) is None
    assert audits.partial_flag(3, 4) and audits.partial_flag(3, None) and not audits.partial_flag(3, 3)


def test_bernoulli_mix_draws_and_falls_back(spark):
    first, second = spark.range(400).withColumnRenamed("id", "k"), spark.range(1000, 1100).withColumnRenamed("id", "k")
    out = streams.bernoulli_mix(first, second, 0.4, "k", 3).orderBy("place").collect()
    assert len(out) == 500 and len({r["place"] for r in out}) == 500
    early = [r["stream"] for r in out[:150]]
    assert 35 <= sum(early) <= 85  # 60 expected
    assert [r["stream"] for r in out[-150:]] == [0] * 150  # the second has run out by then


def test_balanced_replay(spark):
    rows = spark.createDataFrame([(k, k % 23 if k % 2 else 0) for k in range(3000)], "k long, y int")
    out = streams.balanced_replay(rows, "k", "y", 4, 200, 1, parts=2).collect()
    again = streams.balanced_replay(rows.repartition(5), "k", "y", 4, 200, 1, parts=2).collect()
    assert sorted(map(tuple, out)) == sorted(map(tuple, again))
    label = {k: (k % 23 if k % 2 else 0) for k in range(3000)}
    assert all(label[r["sampled"]] == r["label"] for r in out) and 2400 <= len(out) <= 2950
    counts = np.bincount([r["label"] for r in out], minlength=23)
    assert counts.max() < 2 * len(out) / 23  # half of the rows have label 0, few of the draws


def test_every_worker_has_a_manifest_of_every_label(spark):
    rows = spark.createDataFrame([(f"p{k}", y) for y in range(3) for k in range(2 + 7 * y)], "path string, label int")
    out = streams.assigned_by_label(rows, "path", "label", 5, 3).collect()
    for y in range(3):
        assert {r["worker"] for r in out if r["label"] == y} == set(range(5))
        assert {r["path"] for r in out if r["label"] == y} == {f"p{k}" for k in range(2 + 7 * y)}
    assert sum(r["label"] == 2 for r in out) == 16


def test_audio_draws_hang_on_keys(spark):
    df = spark.range(24).select("id", F.transform(F.sequence(F.lit(0), F.lit(4999)), lambda i: F.sin(i / 7.0) * 0.5).alias("a"))
    a = df.select("id", audio.augmented(F.col("a"), F.col("id"), 3, 0.5, 0.5, 0.5).alias("b")).collect()
    b = df.repartition(3).select("id", audio.augmented(F.col("a"), F.col("id"), 3, 0.5, 0.5, 0.5).alias("b")).orderBy("id").collect()
    assert a == b and all(len(r["b"]) == 5000 and max(map(abs, r["b"])) <= 1 for r in a)
    silent = sum(max(len(x) for x in "".join("0" if abs(v) < 1e-15 else "1" for v in r["b"]).split("1")) >= 400 for r in a)
    assert 4 <= silent <= 20
    crops = df.select(audio.cropped_and_padded(F.col("a"), 100, 120, F.col("id"), 1).alias("c")).collect()
    assert all(len(r["c"]) == 120 and r["c"][100:] == [0.0] * 20 for r in crops) and len({tuple(r["c"]) for r in crops}) > 12
    two = spark.createDataFrame([(0, [1.0]), (0, [1.0, 2.0]), (1, [3.0])], "batch int, a array<double>")
    assert sorted((r["batch"], r["length"], r["a"]) for r in audio.batch_padded(two, "batch", "a").collect()) == [(0, 1, [1.0, 0.0]), (0, 2, [1.0, 2.0]), (1, 1, [3.0])]


def test_losses_at_their_limits(spark):
    df = spark.createDataFrame([([0.0] * 23, -100), ([0.0] * 23, -100)], "a array<double>, y int")
    assert df.select(losses.weighted_mean(losses.ignoring(F.col("a"), F.col("y")))).first()[0] == 0
    rate = spark.range(3).select(losses.learning_rate(F.col("id"), 2)).collect()
    assert [r[0] for r in rate] == [0.5, 1.0, 1.0]
    with pytest.raises(ValueError):
        losses.penalty_rows(spark.createDataFrame([], "truth int, pred int"), ("KW",))
    one = spark.createDataFrame([([2.0, 1.0], 0)], "p array<double>, y int")
    assert one.select(losses.distillation(F.col("p"), F.col("p"), 2.0)).first()[0] == pytest.approx(0)
    assert V.LOWEST < -1e38


def test_margin_without_a_second_score_is_the_top_score(spark):
    df = spark.createDataFrame([([1.0], 1, None, 0, 0, None)], "probs array<double>, chunk_count int, crop_count int, truth int, pred int, duration_seconds double")
    r = metrics.diagnostics(df).first()
    assert (r["margin"], r["chunks"], r["duration_bucket"]) == (1.0, 1, "missing")


def test_overlays_and_quantiles(spark):
    base = spark.createDataFrame([("a", [1.0, 2.0]), ("b", [1.0, 2.0]), ("c", [0.0] * 23)], "k string, v array<double>")
    over = spark.createDataFrame([("a", [5.0, 6.0]), ("b", [7.0]), ("c", [9.0, 8.0]), ("d", [1.0])], "k string, v array<double>")
    got = {r["k"]: r["v"] for r in metrics.overlaid(base, over, "k", "v", ("EG", "AE")).collect()}
    assert got["a"] == [5.0, 6.0] and got["b"] == [1.0, 2.0] and got["c"][:5] == [8.0, 0.0, 0.0, 0.0, 9.0]
    values = [3.0, 1.0, None, 2.0, 2.0, 10.0]
    got = [r["value"] for r in metrics.quantiles(spark.createDataFrame([(v,) for v in values], "x double"), "x").orderBy("percent").collect()]
    assert got == pytest.approx(np.quantile([1, 2, 2, 3, 10], np.arange(11) / 10).tolist())


def test_known_labels_and_native_shards(spark):
    assert sampling.target_labels(("AE", "EG"), ("EG",)) == [(0, "AE")]
    shards = [r[0] for r in spark.range(300).select(sampling.native_shard(F.col("id").cast("string"), 8)).collect()]
    assert set(shards) == set(range(8))


def test_commands_print_one_line_and_an_exit_code(spark, sf_dir, tmp_path):
    fixtures.predictions(spark, sf_dir).write.parquet(f"{tmp_path}/p")
    fixtures.eval_rows(spark, sf_dir).write.parquet(f"{tmp_path}/e")
    line, code = commands.run(spark, "decisions", {"predictions": f"{tmp_path}/p"})
    assert code == 0 and "\n" not in line and len(json.loads(line)["policies"]) == len(dims.POLICIES)
    line, code = commands.run(spark, "export-labels", {"predictions": f"{tmp_path}/p", "out": f"file://{tmp_path}/out", "rows_per_file": "100"})
    assert code == 0 and json.loads(line)["exported_rows"] == decisions.labelled(fixtures.predictions(spark, sf_dir)).count()
    line, code = commands.run(spark, "eval-gate", {"baseline": f"{tmp_path}/e", "target": f"{tmp_path}/e"})
    assert code == 1 and json.loads(line)["checks"]["macro_f1"] is False
    assert commands.run(spark, "merge-metrics", {"predictions": f"{tmp_path}/e"})[1] == 0
    assert commands.run(spark, "none", {})[1] == 2 and commands.run(spark, "progress", {})[1] == 2

"""Commands: each prints one line of JSON and ends with 0 (done, or a gate that holds), 1 (a check or gate that fails) or 2 (bad input).

python -m tallyforge COMMAND key=value ...; tables are given as paths of Parquet, CSV (.csv, .csv.gz) or JSON lines.
"""

from __future__ import annotations

import json
import sys
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import dims
from .functions.coerce import codes_of
from .operators import audits, calibration, decisions, gates, metrics, sampling, tracker
from .sources import readers, sinks

Command = Callable[[SparkSession, dict[str, str]], tuple[dict, bool]]
COMMANDS: dict[str, Command] = {}


def command(name: str):
    def add(f: Command) -> Command:
        COMMANDS[name] = f
        return f

    return add


def _table(spark: SparkSession, path: str) -> DataFrame:
    if path.endswith((".csv", ".csv.gz")):
        return spark.read.option("header", True).option("inferSchema", True).csv(path)
    return spark.read.json(path) if path.endswith((".json", ".jsonl", ".jsonl.gz")) else spark.read.parquet(path)


def _list(df: DataFrame) -> list[dict]:
    """Rows of a report, which is small by its grouping."""
    return [r.asDict(recursive=True) for r in df.collect()]


def _checked(checks: DataFrame) -> tuple[dict, bool]:
    rows = _list(checks)
    return {"checks": {r["name"]: r["ok"] for r in rows}, "ok": all(r["ok"] for r in rows)}, all(r["ok"] for r in rows)


def _codes(args: dict[str, str]) -> tuple[str, ...]:
    return tuple(codes_of(args.get("watch")) or dims.CODES)


@command("decisions")
def _decisions(spark, args):
    rows = decisions.labelled(_table(spark, args["predictions"]))
    return {"groups": _list(decisions.all_groupings(rows)), "policies": _list(decisions.policy_totals(rows))}, True


@command("export-labels")
def _export(spark, args):
    rows = decisions.export_rows(decisions.labelled(_table(spark, args["predictions"]), strict=args.get("strict") == "1"))
    with sinks.export_run(spark, args["out"], float(args.get("stale", "-1"))) as values:
        files = sinks.sharded_csv(decisions.export_order(rows, args.get("order", "none")), f"{args['out']}/labels", int(args.get("rows_per_file", "1000000")))
        values |= {"files": _list(files), "exported_rows": sum(r["rows"] for r in _list(files)), "columns": list(decisions.EXPORT)}
    return values, True


@command("compare-exports")
def _compare(spark, args):
    both = decisions.compared(*(decisions.with_policies(_table(spark, args[k])) if args.get("policies") == "1" else _table(spark, args[k]) for k in ("base", "candidate")))
    return {"totals": _list(decisions.comparison_totals(both)), "labels": _list(decisions.label_changes(both)), "policies": _list(decisions.policy_transitions(both))}, True


@command("subsets")
def _subsets(spark, args):
    audits.empty_or_replaced(spark, args["out"], args.get("overwrite") == "1")
    rows = decisions.capped(decisions.labelled(_table(spark, args["predictions"])), int(args.get("cap", "0")))
    sinks.partitioned_csv(rows, args["out"], "policy", "final_dialect")
    return {"subsets": _list(decisions.subset_counts(decisions.labelled(_table(spark, args["predictions"])), int(args.get("cap", "0"))))}, True


@command("audit-shards")
def _audit(spark, args):
    out = _list(audits.shard_audit(audits.shard_states(_table(spark, args["expected"]), _table(spark, args["found"]))))[0]
    return out, out["complete"]


@command("export-status")
def _status(spark, args):
    return _list(audits.export_status(*(_table(spark, args[k]) for k in ("expected", "csvs", "done", "failed"))))[0], True


@command("progress")
def _progress(spark, args):
    return _list(tracker.status(_table(spark, args["markers"]), int(args["shards"])))[0], True


@command("sync-tracker")
def _sync(spark, args):
    from .streaming import markers

    markers.sync(spark, args["markers"], args["out"], args["checkpoint"]).awaitTermination()
    return {"rows": spark.read.parquet(args["out"]).count()}, True


@command("prepare")
def _prepare(spark, args):
    rows = _table(spark, args["work"]).withColumn("shard_idx", sampling.native_shard(F.col("tar_path"), int(args.get("shards", "65536"))))
    sinks.shard_manifests(rows, args["out"])
    return _list(tracker.work_summary(rows))[0], True


@command("merge-metrics")
def _merge(spark, args):
    matrix = metrics.confusion(_table(spark, args["predictions"]), on_invalid="raise")
    classes = metrics.per_class(matrix)
    return sinks.metric_bundle(metrics.summary(classes), classes, matrix, dims.N), True


@command("eval-gate")
def _gate(spark, args):
    sides = [metrics.per_class(metrics.confusion(_table(spark, args[k]))) for k in ("baseline", "target")]
    target = metrics.predicted_ratio(sides[1]).join(sides[1].select(F.get(F.array(*map(F.lit, dims.CODES)), F.col("id")).alias("code"), "f1"), "code")
    return _checked(metrics.gate(metrics.summary(sides[0]), metrics.summary(sides[1]), metrics.predicted_ratio(sides[0]), target, _codes(args), float(args.get("kw", "0.55"))))


@command("calibration-gate")
def _calibration_gate(spark, args):
    tables = [_table(spark, args[k]) for k in ("baseline", "target", "baseline_codes", "target_codes")]
    return _checked(gates.calibration_gate(*tables, _codes(args), least_rows=int(args.get("least_rows", "100000"))))


@command("calibrate")
def _calibrate(spark, args):
    bias, score = calibration.descend(_table(spark, args["predictions"]), dims.N, [0.4, 0.2, 0.1], list(range(dims.N)), {"macro_f1": 1.0, "accuracy": 1.0})
    return {"bias_by_code": dict(zip(dims.CODES, bias, strict=True)), "score": score}, True


@command("coverage")
def _coverage(spark, args):
    rows = gates.coverage(*(_table(spark, args[k]) for k in ("checkpoints", "logs", "reports")))
    return {"status": {r["status"]: r["count"] for r in _list(rows.groupBy("status").count())}, "recommended": _list(gates.recommended(rows).select("run", "name", "priority", "reason"))}, True


@command("accept")
def _accept(spark, args):
    criteria = gates.acceptance(_table(spark, args["evidence"]), int(args.get("old_labels", "19")))
    out = _list(gates.accepted(criteria))[0] | {"criteria": _list(criteria)}
    return out, out["ready"]


@command("decide")
def _decide(spark, args):
    out = _list(gates.candidate_decision(_table(spark, args["cards"])))
    return {"decisions": out}, all(r["decision"] == "accept" for r in out)


@command("diagnostics")
def _diagnostics(spark, args):
    diag = metrics.diagnostics(_table(spark, args["predictions"]))
    return {"overall": _list(metrics.split_overall(diag)), "labels": _list(metrics.by_label(diag)), "regions": _list(metrics.by_region(diag)), "confusions": _list(metrics.confusion_shares(metrics.confusion(diag)))}, True


@command("profile")
def _profile(spark, args):
    return {"profile": _list(sampling.profile(readers.dataset(spark, args["root"], args["split"])))}, True


def run(spark: SparkSession, name: str, args: dict[str, str]) -> tuple[str, int]:
    """The line and the exit code of a command."""
    if name not in COMMANDS:
        return json.dumps({"error": f"no command {name!r}", "commands": sorted(COMMANDS)}), 2
    try:
        out, ok = COMMANDS[name](spark, args)
    except (KeyError, ValueError, FileNotFoundError, FileExistsError, RuntimeError) as e:
        return json.dumps({"error": f"{type(e).__name__}: {e}"}), 2
    return json.dumps(out, sort_keys=True, ensure_ascii=False, default=str), 0 if ok else 1


def main(argv: list[str]) -> int:
    name, *pairs = argv or ["help"]
    spark = SparkSession.builder.appName(f"tallyforge-{name}").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    line, code = run(spark, name, dict(p.partition("=")[::2] for p in pairs))
    print(line)
    return code


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))

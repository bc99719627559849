"""Additive class biases: coordinate descent whose candidates of a class are scored in one job."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import vectors as V
from . import metrics


def scored(rows: DataFrame, candidates: list[list[float]], n: int) -> DataFrame:
    """(candidate, accuracy, balanced_accuracy, macro_f1, weighted_f1) for each bias vector, in one pass over the rows."""
    logs = rows.select("truth", F.transform("probs", lambda x: F.log(F.greatest(x, F.lit(1e-45)))).alias("lp"))
    shifted = [F.struct(F.lit(k).alias("candidate"), V.argmax(F.zip_with("lp", F.array(*(F.lit(float(b)) for b in bias)), lambda x, b: x + b)).alias("pred")) for k, bias in enumerate(candidates)]
    predicted = logs.select("truth", F.explode(F.array(*shifted)).alias("x")).select("truth", "x.*")
    matrix = metrics.confusion(predicted, n, keys=("candidate",))
    return metrics.summary(metrics.per_class(matrix, n, ("candidate",)), ("candidate",))


def objective(row, weights: dict[str, float], bias: list[float], l2: float) -> float:
    return sum(w * row[m] for m, w in weights.items()) - l2 * sum(b * b for b in bias)


def descend(rows: DataFrame, n: int, steps: list[float], active: list[int], weights: dict[str, float], passes: int = 3, limit: float = 3.0, l2: float = 1e-4, pinned: int | None = None, least: float = 1e-12) -> tuple[list[float], float]:
    """Best bias and its score: for each step, up to `passes` times over the active classes, both directions of a class
    are scored together and the better one is taken if it gains. Biases are centred over the active classes (or hung on
    a pinned one) and clipped."""
    rows = rows.select("truth", "probs").persist()
    try:
        bias = [0.0] * n
        best = objective(scored(rows, [bias], n).first(), weights, bias, l2)
        for step in steps:
            for _ in range(passes):
                gained = False
                for c in active:
                    tries = []
                    for sign in (1, -1):
                        new = list(bias)
                        new[c] += sign * step
                        base = new[pinned] if pinned is not None else sum(new[k] for k in active) / len(active)
                        tries.append([max(-limit, min(limit, v - base)) if k in active else 0.0 for k, v in enumerate(new)])
                    found = {r["candidate"]: objective(r, weights, tries[r["candidate"]], l2) for r in scored(rows, tries, n).collect()}
                    k = max(found, key=lambda x: (found[x], -x))
                    if found[k] > best + least:
                        bias, best, gained = tries[k], found[k], True
                if not gained:
                    break
        return bias, best
    finally:
        rows.unpersist()

"""Loss formulas as column expressions over arrays of scores, and aggregates over rows of one batch."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .dims import CODES, GROUPS, LABEL_REGIONS, REGIONS, N
from .vectors import argmax, cross_entropy, dot, logsumexp, masked, normalised, one_hot, pick, softmax, total


def scores_of(logits: Column, bias=None, active=None) -> Column:
    """Probabilities in the order of an evaluation: logits, plus a bias, then the mask, then softmax."""
    out = logits if bias is None else F.zip_with(logits, F.array(*(F.lit(float(b)) for b in bias)), lambda x, b: x + b)
    return softmax(out if active is None else masked(out, active))


def smoothed_target(target: Column, epsilon: float, active=None) -> Column:
    """target * (1 - epsilon) plus epsilon spread evenly over the active classes."""
    share = [1.0] * N if active is None else [float(bool(a)) for a in active]
    each = max(sum(share), 1.0)
    even = F.array(*(F.lit(s / each) for s in share))
    return F.zip_with(target, even, lambda t, e: t * (1 - epsilon) + e * epsilon)


def classification(logits: Column, label: Column, n: int = N, target: Column | None = None, epsilon: float = 0.0, active=None, weights=None, gamma: float = 0.0) -> Column:
    """Cross-entropy of a row: against the label or a soft target, smoothed over active classes, weighted by class, focal."""
    hard = one_hot(label, n)
    aim = hard if target is None else target
    if epsilon > 0:
        aim = smoothed_target(aim, epsilon, active)
    loss = cross_entropy(logits, aim)
    if weights is not None:
        loss = loss * total(F.zip_with(aim, F.array(*(F.lit(float(w)) for w in weights)), lambda t, w: t * w))
    if gamma > 0:
        truth = F.greatest(F.least(F.get(softmax(logits), label), F.lit(1.0)), F.lit(1e-6))
        loss = F.pow(1 - truth, F.lit(float(gamma))) * loss
    return loss


def ignoring(logits: Column, label: Column, sentinel: int = -100) -> Column:
    """Cross-entropy against the label; null, which no mean counts, for the sentinel."""
    return F.when(label != sentinel, logsumexp(logits) - F.get(logits, label))


def weighted_mean(loss: Column, weight: Column | None = None) -> Column:
    """Sum of weighted losses over the sum of weights (1e-6 at least) of rows with a loss; 0 where no row has one."""
    w = F.when(loss.isNotNull(), F.lit(1.0) if weight is None else weight)
    return F.coalesce(F.sum(loss * w), F.lit(0.0)) / F.greatest(F.coalesce(F.sum(w), F.lit(0.0)), F.lit(1e-6))


def region_loss(region_logits: Column, label: Column) -> Column:
    """Cross-entropy over regions against the label's region."""
    region = F.get(F.array(*(F.lit(REGIONS.index(r)) for r in LABEL_REGIONS)), label)
    return logsumexp(region_logits) - F.get(region_logits, region)


def within_region(logits: Column, label: Column) -> Column:
    """Cross-entropy among the labels of the label's region; null for regions of one label."""
    out = F.lit(None).cast("double")
    for region in REGIONS:
        ids = [i for i, r in enumerate(LABEL_REGIONS) if r == region]
        if len(ids) > 1:
            out = F.when(label.isin(*ids), logsumexp(pick(logits, ids)) - F.get(logits, label)).otherwise(out)
    return out


def within_region_mean(rows: DataFrame, logits: str, label: str, weight: Column | None = None) -> DataFrame:
    """The mean over regions, of those with rows and more than one label, of the mean within each; 0 without any."""
    region = F.get(F.array(*(F.lit(r) for r in LABEL_REGIONS)), F.col(label))
    loss = rows.select(region.alias("region"), within_region(F.col(logits), F.col(label)).alias("loss"), (weight if weight is not None else F.lit(1.0)).alias("w")).where("loss IS NOT NULL")
    return loss.groupBy("region").agg(weighted_mean(F.col("loss"), F.col("w")).alias("loss")).agg(F.coalesce(F.avg("loss"), F.lit(0.0)).alias("loss"))


def group_losses(rows: DataFrame, group_logits: dict[str, str], label: str) -> DataFrame:
    """(label_group, n, loss) of groups with rows: cross-entropy of each group's own scores among its members."""
    parts = []
    for name, column in group_logits.items():
        codes = GROUPS[name]
        ids = [CODES.index(c) for c in codes]
        local = F.array_position(F.array(*map(F.lit, ids)), F.col(label)) - 1
        inside = rows.where(F.col(label).isin(*ids))
        loss = logsumexp(F.col(column)) - F.get(F.col(column), local.cast("int"))
        parts.append(inside.agg(F.lit(name).alias("label_group"), F.count(F.lit(1)).alias("n"), weighted_mean(loss).alias("loss")).where("n > 0"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def penalty_rows(top_confusions: DataFrame, pairs: tuple[str, ...] = (), n: int = N) -> DataFrame:
    """(truth, penalty) with a 0/1 array: frequent confusions (truth, pred) and pairs written as TRUE:PRED1,PRED2."""
    spark = top_confusions.sparkSession
    said = []
    for spec in pairs:
        truth, colon, preds = spec.partition(":")
        if not colon:
            raise ValueError(f"{spec!r} is not of the form TRUE:PRED1,PRED2")
        said += [(CODES.index(truth.strip().upper()), CODES.index(p.strip().upper())) for p in preds.split(",") if p.strip()]
    both = top_confusions.select(F.col("truth").cast("int").alias("truth"), F.col("pred").cast("int").alias("pred")).unionByName(spark.createDataFrame(said, "truth int, pred int")).where("truth != pred")
    sets = both.groupBy("truth").agg(F.collect_set("pred").alias("preds"))
    bits = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.array_contains("preds", i).cast("double"))
    return sets.select("truth", bits.alias("penalty"))


def expected_penalty(rows: DataFrame, penalties: DataFrame, probs: str, label: str) -> DataFrame:
    """rows with the probability mass on penalised predictions of their label (0 without any); penalties: one row a label."""
    joined = rows.join(F.broadcast(penalties.withColumnRenamed("truth", "_truth")), F.col(label) == F.col("_truth"), "left").drop("_truth")
    return joined.withColumn("penalty", F.when(F.col("penalty").isNull(), F.lit(0.0)).otherwise(dot(F.col(probs), F.col("penalty"))))


def batch_pairs(rows: DataFrame, batch: str, key: str, vector: str, label: str) -> DataFrame:
    """(batch, i, j, label_i, label_j, sim): cosine of all pairs of different rows within a batch. A batch is bounded by
    the caller, as in training; rows of different batches never meet."""
    unit = rows.select(F.col(batch).alias("batch"), F.col(key).alias("i"), F.col(label).alias("label_i"), normalised(F.col(vector)).alias("u"))
    other = unit.select("batch", F.col("i").alias("j"), F.col("label_i").alias("label_j"), F.col("u").alias("v"))
    return unit.join(other, "batch").where("i != j").select("batch", "i", "j", "label_i", "label_j", dot(F.col("u"), F.col("v")).alias("sim"))


def contrastive(pairs: DataFrame, temperature: float) -> DataFrame:
    """(batch, anchors, loss): supervised contrastive loss over the anchors with at least one positive."""
    t = max(temperature, 1e-6)
    same = F.col("label_i") == F.col("label_j")
    one = pairs.groupBy("batch", "i").agg(
        F.max(F.col("sim") / t).alias("top"), F.collect_list(F.col("sim") / t).alias("all"), F.sum(F.when(same, F.col("sim") / t)).alias("positive"), F.count_if(same).alias("positives"))
    log_sum = F.col("top") + F.log(F.greatest(F.aggregate("all", F.lit(0.0), lambda s, x: s + F.exp(x - F.col("top"))), F.lit(1e-12)))
    return one.where("positives > 0").groupBy("batch").agg(F.count(F.lit(1)).alias("anchors"), F.avg(log_sum - F.col("positive") / F.col("positives")).alias("loss"))


def hard_negatives(pairs: DataFrame, penalties: DataFrame, margin: float) -> DataFrame:
    """(batch, pairs, loss): mean of max(0, sim - margin) over pairs whose labels are penalised in either direction."""
    p = penalties.select(F.col("truth").alias("a"), F.explode(F.filter(F.sequence(F.lit(0), F.lit(N - 1)), lambda i: F.get("penalty", i) > 0)).alias("b"))
    both = F.broadcast(p.unionByName(p.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    hit = pairs.join(both, (F.col("label_i") == F.col("a")) & (F.col("label_j") == F.col("b")), "left_semi")
    return hit.groupBy("batch").agg(F.count(F.lit(1)).alias("pairs"), F.avg(F.greatest(F.col("sim") - margin, F.lit(0.0))).alias("loss"))


def angular_logits(vector: Column, weights: list[list[float]], label: Column, margin: float, scale: float) -> Column:
    """Cosines to the class weights, less the margin at the label, times the scale."""
    unit = normalised(vector)
    out = []
    for k, row in enumerate(weights):
        norm = max(math.sqrt(sum(x * x for x in row)), 1e-12)
        cosine = dot(unit, F.array(*(F.lit(x / norm) for x in row)))
        out.append((cosine - F.when(label == k, F.lit(margin)).otherwise(F.lit(0.0))) * scale)
    return F.array(*out)


def distillation(student: Column, teacher: Column, temperature: float, classes=None) -> Column:
    """KL divergence of the softened student from the softened teacher, times the squared temperature, over some classes."""
    t = max(temperature, 1e-6)
    soft = lambda a: softmax(F.transform(a if classes is None else pick(a, classes), lambda x: x / t))
    p, q = soft(teacher), soft(student)
    return total(F.zip_with(p, q, lambda x, y: F.when(x > 0, x * (F.log(x) - F.log(F.greatest(y, F.lit(1e-300))))).otherwise(0.0))) * (t * t)


def learning_rate(step: Column, warmup: int, decay: int = 0, least: float = 0.0) -> Column:
    """Share of the base rate: linear warm-up, then a half cosine down to `least`, else 1."""
    out = F.lit(1.0)
    if decay > warmup:
        progress = F.least(F.lit(1.0), (step + 1 - warmup) / float(decay - warmup))
        out = least + (1 - least) * 0.5 * (1 + F.cos(F.lit(math.pi) * progress))
    return F.when(step + 1 < warmup, (step + 1) / float(warmup)).otherwise(out) if warmup > 0 else out


def attentive_pool(frames: DataFrame, key: str, vector: str, score: str, width: int, valid: str | None = None) -> DataFrame:
    """(key, pooled): softmax-weighted mean and standard deviation (variance 1e-6 at least) of each key's frames, side by side."""
    rows = frames.where(F.col(valid)) if valid else frames
    top = rows.groupBy(key).agg(F.max(score).alias("_top"))
    weighted = rows.join(top, key).withColumn("_w", F.exp(F.col(score) - F.col("_top")))
    sums = weighted.groupBy(key).agg(F.sum("_w").alias("_z"), *(F.sum(F.col("_w") * F.col(vector)[i]).alias(f"_m{i}") for i in range(width)), *(F.sum(F.col("_w") * F.col(vector)[i] * F.col(vector)[i]).alias(f"_s{i}") for i in range(width)))
    mean = [F.col(f"_m{i}") / F.col("_z") for i in range(width)]
    std = [F.sqrt(F.greatest(F.col(f"_s{i}") / F.col("_z") - mean[i] * mean[i], F.lit(1e-6))) for i in range(width)]
    return sums.select(key, F.array(*mean, *std).alias("pooled"))


def predicted(logits: Column, bias=None, active=None) -> Column:
    return argmax(scores_of(logits, bias, active))

"""Confusion matrices in long form, classification metrics and diagnostics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import dims
from ..functions.coerce import bucket, chunk_bucket, lookup, ratio
from ..functions.vectors import argmax, entropy, masked, top_k


def confusion(rows: DataFrame, n: int = dims.N, on_invalid: str = "drop", keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, truth, pred, n); pairs outside 0 .. n-1 are dropped, or an error."""
    inside = F.col("truth").between(0, n - 1) & F.col("pred").between(0, n - 1)
    if on_invalid == "raise":
        rows = rows.withColumn("truth", F.when(inside, F.col("truth")).otherwise(F.raise_error(F.lit("a label is out of range")).cast("int")))
    return rows.where(inside).groupBy(*keys, "truth", "pred").agg(F.count(F.lit(1)).alias("n"))


def merged(*matrices: DataFrame) -> DataFrame:
    out = matrices[0]
    for m in matrices[1:]:
        out = out.unionByName(m)
    return out.groupBy("truth", "pred").agg(F.sum("n").alias("n"))


def per_class(matrix: DataFrame, n: int = dims.N, keys: tuple[str, ...] = ()) -> DataFrame:
    """Support, predicted, precision, recall and F1 of every class, absent ones with zeros."""
    spark = matrix.sparkSession
    ends = matrix.select(*keys, F.explode(F.array(F.struct(F.col("truth").alias("id"), F.col("n").alias("support"), F.lit(0).cast("long").alias("predicted"), F.when(F.col("truth") == F.col("pred"), F.col("n")).otherwise(0).alias("hit")), F.struct(F.col("pred").alias("id"), F.lit(0).cast("long").alias("support"), F.col("n").alias("predicted"), F.lit(0).cast("long").alias("hit")))).alias("x")).select(*keys, "x.*")
    zeros = spark.range(n).select(F.col("id").cast("int").alias("id"), *(F.lit(0).cast("long").alias(c) for c in ("support", "predicted", "hit")))
    if keys:
        zeros = matrix.select(*keys).distinct().crossJoin(F.broadcast(zeros))
    out = ends.unionByName(zeros).groupBy(*keys, "id").agg(*(F.sum(c).alias(c) for c in ("support", "predicted", "hit")))
    precision, recall = ratio(F.col("hit"), F.col("predicted")), ratio(F.col("hit"), F.col("support"))
    f1 = F.when(precision + recall > 0, 2 * precision * recall / (precision + recall)).otherwise(0.0)
    return out.select(*keys, "id", "support", "predicted", "hit", precision.alias("precision"), recall.alias("recall"), f1.alias("f1"))


def summary(classes: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Accuracy over all rows; balanced accuracy and macro F1 over classes with support; F1 weighted by support."""
    has = F.col("support") > 0
    agg = [
        ratio(F.sum("hit"), F.sum("support")).alias("accuracy"), F.coalesce(F.avg(F.when(has, F.col("recall"))), F.lit(0.0)).alias("balanced_accuracy"),
        F.coalesce(F.avg(F.when(has, F.col("f1"))), F.lit(0.0)).alias("macro_f1"), ratio(F.sum(F.col("f1") * F.col("support")), F.sum("support")).alias("weighted_f1"), F.sum("support").alias("n"),
    ]
    return classes.groupBy(*keys).agg(*agg) if keys else classes.agg(*agg)


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*(F.round(c, digits).alias(c) if kind == "double" else F.col(c) for c, kind in df.dtypes))


def two_class(rows: DataFrame) -> DataFrame:
    """Negative truth is ignored (and counted), truth above 1 is an error."""
    bad = F.when(F.col("truth") >= 2, F.raise_error(F.lit("a truth is above 1")).cast("int")).otherwise(F.col("truth"))
    rows = rows.withColumn("truth", bad)
    found = summary(per_class(confusion(rows, 2), 2))
    return found.crossJoin(rows.agg(F.count_if(F.col("truth") < 0).alias("ignored")))


def predicted_ratio(classes: DataFrame, infinite: bool = True) -> DataFrame:
    """Predicted over true counts, false positives; without truth infinity (or null). Classes with neither have no row."""
    classes = classes.where((F.col("support") > 0) | (F.col("predicted") > 0))
    empty = F.lit(float("inf")) if infinite else F.lit(None).cast("double")
    return classes.select(lookup(dims.CODES, F.col("id")).alias("code"), "support", "predicted", (F.col("predicted") - F.col("hit")).alias("false_positives"), F.when(F.col("support") > 0, F.col("predicted") / F.col("support")).otherwise(empty).alias("ratio"))


def off_diagonal(matrix: DataFrame) -> DataFrame:
    return matrix.where("truth != pred").select("truth", "pred", lookup(dims.CODES, F.col("truth")).alias("truth_code"), lookup(dims.CODES, F.col("pred")).alias("pred_code"), "n")


def top_confusions(matrix: DataFrame, k: int, least: int = 1) -> DataFrame:
    """The k most frequent wrong predictions of each truth; ties go to the larger id."""
    order = Window.partitionBy("truth").orderBy(F.desc("n"), F.desc("pred"))
    return off_diagonal(matrix).where(F.col("n") >= least).withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)


def false_positive_sources(matrix: DataFrame, k: int = 8) -> DataFrame:
    order = Window.partitionBy("pred").orderBy(F.desc("n"), F.desc("truth_code"))
    return off_diagonal(matrix).withColumn("place", F.row_number().over(order)).where(F.col("place") <= k).select("pred_code", "truth_code", "n", "place")


def confusion_shares(matrix: DataFrame, top: int = 30) -> DataFrame:
    """Confusions with their share of the truth's rows, most frequent first."""
    shared = matrix.withColumn("support", F.sum("n").over(Window.partitionBy("truth"))).where("truth != pred")
    return shared.select(lookup(dims.CODES, F.col("truth")).alias("truth_code"), lookup(dims.CODES, F.col("pred")).alias("pred_code"), "n", F.round(F.col("n") / F.col("support"), 6).alias("share")).orderBy(F.desc("n"), "truth_code", "pred_code").limit(top)


def diagnostics(rows: DataFrame) -> DataFrame:
    """Per row: top probability, margin, entropy, buckets, regions."""
    top = top_k(F.col("probs"), 5)
    out = rows.withColumn("top", top)
    second = F.coalesce(F.get("top", F.lit(1))["value"], F.lit(0.0))
    chunks = F.coalesce(F.nullif("chunk_count", F.lit(0)), F.nullif("crop_count", F.lit(0)), F.lit(1))
    out = out.withColumn("top1", F.get("top", F.lit(0))["value"]).withColumn("margin", F.col("top1") - second).withColumn("entropy", entropy(F.col("probs")))
    return out.withColumns({
        "confidence_bucket": bucket(F.col("top1"), dims.CONFIDENCE_BUCKETS, "unknown"), "duration_bucket": bucket(F.col("duration_seconds"), dims.DURATION_BUCKETS, "missing"),
        "chunks": chunks, "chunk_bucket": chunk_bucket(chunks),
        "truth_region": lookup(dims.LABEL_REGIONS, F.col("truth")), "pred_region": lookup(dims.LABEL_REGIONS, F.col("pred")), "correct": F.col("truth") == F.col("pred"),
    })


def by_bucket(diag: DataFrame, col: str, order: tuple[str, ...]) -> DataFrame:
    """Averages by bucket, in the declared order, empty ones left out."""
    out = diag.groupBy(F.col(col).alias("bucket")).agg(
        F.count(F.lit(1)).alias("support"), F.count_if("correct").alias("correct"), F.round(F.avg("top1"), 6).alias("mean_top1"), F.round(F.avg("margin"), 6).alias("mean_margin"),
        F.round(F.avg("entropy"), 6).alias("mean_entropy"), F.round(F.avg("crop_count"), 6).alias("mean_crops"), F.round(F.avg("chunks"), 6).alias("mean_chunks"), F.round(F.avg("duration_seconds"), 6).alias("mean_duration"),
    )
    place = F.array_position(F.array(*(F.lit(x) for x in order)), F.col("bucket"))
    return out.withColumn("accuracy", F.round(F.col("correct") / F.col("support"), 6)).orderBy(place)


def by_label(diag: DataFrame) -> DataFrame:
    """Support, accuracy and the five most frequent confusions of every label, absent ones included."""
    pairs = diag.where(~F.col("correct")).groupBy("truth", "pred").agg(F.count(F.lit(1)).alias("k"))
    listed = pairs.groupBy("truth").agg(F.array_sort(F.collect_list(F.struct((-F.col("k")).alias("k"), lookup(dims.CODES, F.col("pred")).alias("c")))).alias("x"))
    listed = listed.select("truth", F.array_join(F.transform(F.slice("x", 1, 5), lambda s: F.concat(s["c"], F.lit(":"), (-s["k"]).cast("string"))), ", ").alias("confusions"))
    counts = diag.groupBy("truth").agg(F.count(F.lit(1)).alias("support"), F.count_if("correct").alias("correct"))
    out = dims.labels(diag.sparkSession).join(counts, F.col("id") == F.col("truth"), "left").drop("truth").join(listed, F.col("id") == F.col("truth"), "left")
    return out.select("code", F.coalesce("support", F.lit(0)).cast("long").alias("support"), F.coalesce("correct", F.lit(0)).cast("long").alias("correct"), F.round(F.col("correct") / F.col("support"), 6).alias("accuracy"), F.coalesce("confusions", F.lit("")).alias("confusions"))


def by_region(diag: DataFrame) -> DataFrame:
    """Per region with rows: exact and region accuracy, and the five most frequent predicted regions."""
    pairs = diag.groupBy("truth_region", "pred_region").agg(F.count(F.lit(1)).alias("k"))
    tops = pairs.groupBy("truth_region").agg(F.array_sort(F.collect_list(F.struct((-F.col("k")).alias("k"), F.col("pred_region").alias("r")))).alias("x"))
    tops = tops.select(F.col("truth_region").alias("region"), F.array_join(F.transform(F.slice("x", 1, 5), lambda s: F.concat(s["r"], F.lit(":"), (-s["k"]).cast("string"))), ", ").alias("predicted"))
    out = diag.groupBy(F.col("truth_region").alias("region")).agg(F.count(F.lit(1)).alias("support"), F.count_if("correct").alias("exact"), F.count_if(F.col("truth_region") == F.col("pred_region")).alias("same_region"))
    out = out.withColumn("accuracy", F.round(F.col("exact") / F.col("support"), 6)).withColumn("region_accuracy", F.round(F.col("same_region") / F.col("support"), 6))
    return out.join(tops, "region").orderBy("region")


def quantiles(diag: DataFrame, col: str) -> DataFrame:
    """Eleven exact quantiles by linear interpolation; (percent, value)."""
    return ranked_quantiles(diag.select(F.lit(0).alias("_all_rows"), col), ["_all_rows"], col).drop("_all_rows")


def mean_vectors(rows: DataFrame, key: str, vector: str, width: int) -> DataFrame:
    """Element-wise mean of the vectors of a key: `width` plain averages, partially aggregated before the shuffle."""
    sums = rows.groupBy(key).agg(*(F.avg(F.col(vector)[i]).alias(f"_{i}") for i in range(width)), F.count(F.lit(1)).alias("chunks"))
    return sums.select(key, F.array(*(f"_{i}" for i in range(width))).alias(vector), "chunks")


def class_weights(counts: DataFrame, mode: str, low: float, high: float) -> DataFrame:
    """Weights of (id, n, active): total / (n * classes) or its square root, over the active classes; mean 1, clamped."""
    active = F.col("active")
    n = F.greatest(F.col("n").cast("double"), F.lit(1.0))
    whole = Window.partitionBy()
    raw = F.sum(F.when(active, n)).over(whole) / (n * F.count_if(active).over(whole))
    raw = F.sqrt(raw) if mode == "sqrt" else raw
    out = counts.withColumn("raw", F.when(active, raw))
    scaled = F.col("raw") / F.avg("raw").over(whole)
    return out.select("id", F.when(active, F.least(F.greatest(scaled, F.lit(low)), F.lit(high))).otherwise(0.0).alias("weight"))


def gate(baseline: DataFrame, target: DataFrame, base_ratio: DataFrame, target_ratio: DataFrame, watched: tuple[str, ...], kw_min: float, macro: float = 0.002, accuracy: float = 0.002, weighted: float = 0.001, tolerance: float = 0.05, strict: bool = False) -> DataFrame:
    """Five checks as rows (name, ok): gains and losses of the summaries, one watched F1, the watched ratios.

    The watched F1 is the target's for KW; without it the check fails. Other watched labels without evidence on a side
    are left out, or fail when strict.
    """
    b, t = baseline.select(*(F.col(c).alias(f"b_{c}") for c in baseline.columns)), target.select(*(F.col(c).alias(f"t_{c}") for c in target.columns))
    both = b.crossJoin(t)
    checks = both.select(F.explode(F.array(
        F.struct(F.lit("macro_f1").alias("name"), (F.col("t_macro_f1") - F.col("b_macro_f1") >= macro).alias("ok")),
        F.struct(F.lit("accuracy").alias("name"), (F.col("t_accuracy") - F.col("b_accuracy") >= -accuracy).alias("ok")),
        F.struct(F.lit("weighted_f1").alias("name"), (F.col("t_weighted_f1") - F.col("b_weighted_f1") >= -weighted).alias("ok")),
    )).alias("x")).select("x.*")
    far = lambda c: F.abs(F.col(c) - 1)
    pairs = base_ratio.select("code", F.col("ratio").alias("b")).join(target_ratio.select("code", F.col("ratio").alias("t"), "f1"), "code").where(F.col("code").isin(*watched))
    fails = F.count_if(far("t") > far("b") + tolerance) + (F.lit(len(watched)) - F.count(F.lit(1)) if strict else F.lit(0))
    watch = pairs.agg((fails == 0).alias("ratios"), F.lit(True).alias("_"))
    kw = target_ratio.agg(F.coalesce(F.max(F.when(F.col("code") == "KW", F.col("f1"))) >= kw_min, F.lit(False)).alias("watched_f1"))
    watch = watch.select("ratios").crossJoin(kw)
    more = watch.select(F.explode(F.array(F.struct(F.lit("ratios").alias("name"), F.col("ratios").alias("ok")), F.struct(F.lit("watched_f1").alias("name"), F.col("watched_f1").alias("ok")))).alias("x")).select("x.*")
    return checks.unionByName(more)


def released(checks: DataFrame) -> DataFrame:
    return checks.agg(F.bool_and("ok").alias("release"), F.count_if(~F.col("ok")).alias("failed"))


def ratio_delta(b: Column, t: Column) -> Column:
    return F.abs(t - 1) - F.abs(b - 1)


def split_overall(diag: DataFrame, split: str = "split") -> DataFrame:
    """Rows, exact and region accuracy of each split; null accuracy without rows cannot occur, as a split has some."""
    same = F.col("truth_region") == F.col("pred_region")
    out = diag.groupBy(split).agg(F.count(F.lit(1)).alias("n"), F.count_if("correct").alias("correct"), F.count_if(same).alias("region_correct"))
    return out.withColumn("accuracy", F.round(F.col("correct") / F.col("n"), 6)).withColumn("region_accuracy", F.round(F.col("region_correct") / F.col("n"), 6))


def split_quantiles(diag: DataFrame, columns: tuple[str, ...], split: str = "split") -> DataFrame:
    """(split, column, percent, value): the eleven exact quantiles of each column in each split, nulls left out."""
    long = diag.select(split, F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("v")) for c in columns))).alias("x")).select(split, "x.column", "x.v").where("v IS NOT NULL")
    return ranked_quantiles(long, [split, "column"], "v")


def ranked_quantiles(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Eleven exact quantiles by linear interpolation for each key, from counts of equal values: values meet in one place
    only as (value, count) pairs, running totals are taken within ranges of the key's values."""
    counts = rows.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_n"))
    order = Window.partitionBy(*keys).orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    places = counts.withColumn("_to", F.sum("_n").over(order)).withColumn("_from", F.col("_to") - F.col("_n"))
    total = counts.groupBy(*keys).agg(F.sum("_n").alias("_all"))
    points = total.withColumn("_step", F.explode(F.sequence(F.lit(0), F.lit(10)))).withColumn("_at", (F.col("_all") - 1) * F.col("_step") / 10.0)
    wanted = points.select(*keys, "_step", "_at", F.explode(F.array(F.floor("_at"), F.ceil("_at"))).alias("_row")).distinct()
    ranged = wanted.join(places, keys).where((F.col("_row") >= F.col("_from")) & (F.col("_row") < F.col("_to")))
    ends = ranged.groupBy(*keys, "_step", "_at").agg(F.min(value).alias("_low"), F.max(value).alias("_high"))
    mixed = F.col("_low") + (F.col("_high") - F.col("_low")) * (F.col("_at") - F.floor("_at"))
    return ends.select(*keys, (F.col("_step") * 10).alias("percent"), F.round(mixed, 6).alias("value"))


def least_accurate(labels: DataFrame, most: int = 10) -> DataFrame:
    """The least accurate labels with rows; ties by support, then code; the limit is the report's."""
    return labels.where("support > 0").orderBy("accuracy", F.desc("support"), "code").limit(most)


def evaluation_matrix(rows: DataFrame, active, n: int = dims.N) -> DataFrame:
    """The matrix of masked predictions; pairs out of range are dropped, shards and ranks add up by the grouping."""
    return confusion(rows.withColumn("pred", argmax(masked(F.col("logits"), active))), n)


def first_crops(rows: DataFrame, key: str, position: str, *values: str) -> DataFrame:
    """The values of the first crop of each sample."""
    return rows.groupBy(key).agg(F.min_by(F.struct(*values), position).alias("_v")).select(key, *(F.col("_v")[v].alias(v) for v in values))


def remapped(rows: DataFrame, vector: str, old_codes: tuple[str, ...], new_codes: tuple[str, ...] = dims.CODES, default: Column | None = None) -> DataFrame:
    """A vector over old label ids in the order of new ones, joined by code; labels that the old ones lack get the default's
    place (a vector column), else null."""
    places = [old_codes.index(c) if c in old_codes else -1 for c in new_codes]
    out = [F.get(F.col(vector), F.lit(p)) if p >= 0 else (F.get(default, F.lit(k)) if default is not None else F.lit(None).cast("double")) for k, p in enumerate(places)]
    return rows.withColumn(vector, F.array(*out))


def overlaid(base: DataFrame, overlay: DataFrame, key: str, value: str, old_codes: tuple[str, ...] | None = None, new_codes: tuple[str, ...] = dims.CODES) -> DataFrame:
    """base with the overlay's vectors where a key has one of the same length; where only the number of labels differs, the
    labels that both have are copied by code. Keys of the overlay alone are left out."""
    joined = base.join(overlay.select(key, F.col(value).alias("_over")), key, "left")
    by_label = remapped(joined, "_over", old_codes, new_codes, F.col(value)).select(key, F.col("_over").alias("_mapped")) if old_codes else None
    if by_label is not None:
        joined = joined.join(by_label, key)
    same = F.size("_over") == F.size(value)
    out = F.when(same, F.col("_over"))
    if by_label is not None:
        out = out.when((F.size("_over") == len(old_codes)) & (F.size(value) == len(new_codes)), F.col("_mapped"))
    return joined.select(*(F.coalesce(out, F.col(value)).alias(value) if c == value else F.col(c) for c in base.columns))

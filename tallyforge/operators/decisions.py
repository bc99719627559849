"""Confidence decisions over prediction rows, and their summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import dims
from ..functions.coerce import at_least, at_most, eight_decimals, first_text, group_key, lookup, pct

MATCHES = ("weak_top1_match", "weak_top2_match", "weak_top3_match", "weak_region_match")


def tier(score: Column, margin: Column, strong=(0.95, 0.50), usable=(0.90, 0.30)) -> Column:
    def reaches(t):
        return at_least(score, t[0]) & at_least(margin, t[1])

    return F.when(reaches(strong), "strong").when(reaches(usable), "usable").otherwise("low")


def policy_flag(p: dims.Policy, score: Column, margin: Column, entropy: Column, region: Column, top1: Column) -> Column:
    out = at_least(score, p.min_score) & at_least(margin, p.min_margin)
    if p.max_entropy is not None:
        out = out & at_most(entropy, p.max_entropy)
    if p.weak_region:
        out = out & region
    return out & top1 if p.weak_top1 else out


def region_of(code: Column) -> Column:
    """The label's region, null for other codes; a fixed map of 23 entries, so no join."""
    table = F.create_map(*(F.lit(x) for pair in zip(dims.CODES, dims.LABEL_REGIONS, strict=True) for x in pair))
    return F.try_element_at(table, F.upper(code))


def country_of(code: Column) -> Column:
    table = F.create_map(*(F.lit(x) for pair in zip(dims.CODES, dims.COUNTRIES, strict=True) for x in pair))
    return F.try_element_at(table, F.upper(code))


def labelled(rows: DataFrame, strict: bool = False) -> DataFrame:
    """Decoded rows with final label, tier, agreement and policy flags; strict: an error if a row isn't decoded."""
    if strict:
        rows = rows.withColumn("decoded", F.when(F.col("decoded") == 1, 1).otherwise(F.raise_error(F.lit("a row is not decoded")).cast("int")))
    weak = first_text(F.col("weak_cc"))
    out = rows.where(F.col("decoded") == 1).withColumn("weak_cc", weak)
    out = out.withColumn("weak_region", F.coalesce(region_of(F.col("weak_cc")), F.lit("unknown")))
    out = out.withColumn("final_dialect", first_text(F.col("top1_cc")))
    out = out.withColumn("final_country", F.coalesce(country_of(F.col("final_dialect")), F.lit("")))
    out = out.withColumn("final_region", F.coalesce(F.nullif("top1_region", F.lit("")), region_of(F.col("final_dialect")), F.lit("unknown")))
    said = F.col("weak_cc") != ""
    out = out.withColumns({
        "confidence_tier": tier(F.col("top1_score"), F.col("margin")),
        "weak_top1_match": said & (F.col("weak_cc") == F.col("top1_cc")),
        "weak_top2_match": said & F.col("weak_cc").isin(F.col("top1_cc"), F.col("top2_cc")),
        "weak_top3_match": said & F.col("weak_cc").isin(F.col("top1_cc"), F.col("top2_cc"), F.col("top3_cc")),
        "weak_region_match": (F.col("weak_region") != "unknown") & (F.col("weak_region") == F.col("final_region")),
    })
    return with_policies(out)


def with_policies(rows: DataFrame) -> DataFrame:
    return rows.withColumns({p.name: policy_flag(p, F.col("top1_score"), F.col("margin"), F.col("entropy"), F.col("weak_region_match"), F.col("weak_top1_match")) for p in dims.POLICIES})


def _count(condition: Column) -> Column:
    return F.count_if(condition)


def counters() -> list[Column]:
    """The accumulator of all summaries."""
    strong = F.col("confidence_tier") == "strong"
    return [
        F.count(F.lit(1)).alias("n"), F.sum("duration").alias("duration"), F.avg("top1_score").alias("mean_score"), F.avg("margin").alias("mean_margin"),
        *(_count(F.col("confidence_tier") == t).alias(t) for t in ("strong", "usable", "low")),
        *(_count(F.col(m)).alias(m.removesuffix("_match")) for m in MATCHES),
        _count(strong & F.col("weak_top1_match")).alias("strong_weak_top1"), _count(strong & F.col("weak_region_match")).alias("strong_weak_region"),
    ]


def finished(rows: DataFrame, *keys: str) -> DataFrame:
    """Hours, means and percentages of counters(); the strong_weak percentages are of the strong rows."""
    return rows.select(
        *keys, "n", F.round(F.col("duration") / 3600, 6).alias("hours"), F.round("mean_score", 6).alias("mean_score"), F.round("mean_margin", 6).alias("mean_margin"),
        "strong", "usable", "low", "weak_top1", "weak_top2", "weak_top3", "weak_region", pct(F.col("strong"), F.col("n")).alias("strong_pct"),
        pct(F.col("weak_top1"), F.col("n")).alias("weak_top1_pct"), pct(F.col("weak_region"), F.col("n")).alias("weak_region_pct"),
        pct(F.col("usable"), F.col("n")).alias("usable_pct"), pct(F.col("low"), F.col("n")).alias("low_pct"),
        pct(F.col("weak_top2"), F.col("n")).alias("weak_top2_pct"), pct(F.col("weak_top3"), F.col("n")).alias("weak_top3_pct"),
        pct(F.col("strong_weak_top1"), F.col("strong")).alias("strong_weak_top1_pct"), pct(F.col("strong_weak_region"), F.col("strong")).alias("strong_weak_region_pct"),
    )


def by_predicted(rows: DataFrame) -> DataFrame:
    out = finished(rows.groupBy(group_key(F.col("final_dialect")).alias("label")).agg(*counters()), "label")
    return out.orderBy(F.desc("strong"), F.desc("n"), "label")


def all_groupings(rows: DataFrame) -> DataFrame:
    """Overall, by predicted label, weak label, weak region and predicted region, in one pass."""
    keyed = rows.select(
        *(c for c in rows.columns if c not in ("weak_region",)),
        group_key(F.col("final_dialect")).alias("predicted"), group_key(F.col("weak_cc")).alias("weak"), F.col("weak_region").alias("weak_area"), F.col("final_region").alias("predicted_area"),
    )
    sets = [[], ["predicted"], ["weak"], ["weak_area"], ["predicted_area"]]
    out = keyed.groupingSets([[F.col(c) for c in s] for s in sets], "predicted", "weak", "weak_area", "predicted_area").agg(*counters(), F.grouping_id().alias("gid"))
    kind = F.when(F.col("gid") == 15, "overall").when(F.col("gid") == 7, "predicted").when(F.col("gid") == 11, "weak").when(F.col("gid") == 13, "weak_region").otherwise("predicted_region")
    key = F.coalesce("predicted", "weak", "weak_area", "predicted_area", F.lit("all"))
    return finished(out.withColumn("grouping", kind).withColumn("key", key), "grouping", "key")


def policy_rows(rows: DataFrame) -> DataFrame:
    """One row for each policy that a row meets."""
    met = F.filter(F.array(*(F.when(F.col(p.name), F.lit(p.name)) for p in dims.POLICIES)), lambda x: x.isNotNull())
    return rows.withColumn("policy", F.explode(met))


def by_policy(rows: DataFrame) -> DataFrame:
    """(policy, label) and (policy, all); policies that no row meets have a row of zeros."""
    spark = rows.sparkSession
    found = policy_rows(rows).groupingSets([[F.col("policy")], [F.col("policy"), F.col("final_dialect")]], "policy", "final_dialect").agg(F.count(F.lit(1)).alias("n"), F.sum("duration").alias("duration"))
    found = found.withColumn("label", F.coalesce("final_dialect", F.lit("all")))
    out = dims.policies(spark).select("position", "policy").join(found, "policy", "left")
    return out.select("position", "policy", F.coalesce("label", F.lit("all")).alias("label"), F.coalesce("n", F.lit(0)).cast("long").alias("n"), F.round(F.coalesce("duration", F.lit(0.0)) / 3600, 6).alias("hours")).orderBy("position", F.desc("n"), "label")


def mismatches(rows: DataFrame, top: int = 50) -> DataFrame:
    """The most frequent pairs of a weak and another predicted label; ties by the pair."""
    apart = rows.where((F.col("weak_cc") != "") & (F.col("final_dialect") != "") & (F.col("weak_cc") != F.col("final_dialect")))
    out = apart.groupBy("weak_cc", "final_dialect").agg(F.count(F.lit(1)).alias("n"), _count(F.col("confidence_tier") == "strong").alias("strong"))
    return out.orderBy(F.desc("n"), "weak_cc", "final_dialect").limit(top)


def tier_crosstab(rows: DataFrame) -> DataFrame:
    out = rows.groupBy(F.col("final_dialect").alias("label")).pivot("confidence_tier", ["strong", "usable", "low"]).agg(F.count(F.lit(1)))
    out = out.na.fill(0).withColumn("n", F.col("strong") + F.col("usable") + F.col("low"))
    return out.withColumn("strong_pct", pct(F.col("strong"), F.col("n")))


def policy_totals(rows: DataFrame) -> DataFrame:
    sums = rows.agg(F.count(F.lit(1)).alias("rows"), *(_count(F.col(p.name)).alias(p.name) for p in dims.POLICIES))
    out = sums.unpivot("rows", [p.name for p in dims.POLICIES], "policy", "n")
    return out.select("policy", "n", pct(F.col("n"), F.col("rows")).alias("pct"))


def expand_by_table(rows: DataFrame, policies: DataFrame) -> DataFrame:
    """The theta join of rows with a policy table (a few rows, broadcast)."""
    p = policies.select(*(F.col(c).alias(f"p_{c}") for c in policies.columns))
    met = (F.col("top1_score") >= F.col("p_min_score")) & (F.col("margin") >= F.col("p_min_margin"))
    met = met & (F.col("p_max_entropy").isNull() | (F.col("entropy") <= F.col("p_max_entropy")))
    met = met & (~F.col("p_weak_region") | F.col("weak_region_match")) & (~F.col("p_weak_top1") | F.col("weak_top1_match"))
    return rows.join(F.broadcast(p), met).withColumnRenamed("p_policy", "policy")


def candidate(rows: DataFrame) -> DataFrame:
    """A second labelling of the same rows that differs on every eleventh sample."""
    changed = F.col("sample_id") % 11 == 0
    out = rows.withColumn("final_dialect", F.when(changed, lookup(dims.CODES, (F.col("p1") + 1) % 23)).otherwise(F.col("final_dialect")))
    out = out.withColumn("top1_score", F.when(changed, F.col("top1_score") - 0.01).otherwise(F.col("top1_score"))).withColumn("margin", F.when(changed, F.col("margin") + 0.02).otherwise(F.col("margin")))
    return with_policies(out)


KEY = ("sample_id", "tar_path", "member")


def compared(base: DataFrame, other: DataFrame) -> DataFrame:
    """Both labellings side by side by key; a key on one side only is an error."""
    cols = ["final_dialect", "top1_score", "margin", *(p.name for p in dims.POLICIES)]
    left = base.select(*KEY, *(F.col(c).alias(f"base_{c}") for c in cols), F.lit(True).alias("in_base"))
    right = other.select(*KEY, *(F.col(c).alias(f"cand_{c}") for c in cols), F.lit(True).alias("in_cand"))
    out = left.join(right, list(KEY), "full_outer")
    whole = F.when(F.col("in_base").isNull() | F.col("in_cand").isNull(), F.raise_error(F.lit("a key stands on one side only")).cast("boolean")).otherwise(F.col("base_final_dialect") != F.col("cand_final_dialect"))
    return out.withColumn("changed", whole).drop("in_base", "in_cand")


def comparison_totals(both: DataFrame) -> DataFrame:
    d_score, d_margin = F.col("cand_top1_score") - F.col("base_top1_score"), F.col("cand_margin") - F.col("base_margin")
    return both.agg(
        F.count(F.lit(1)).alias("n"), _count(F.col("changed")).alias("changed"), _count(~F.col("changed")).alias("same"),
        F.round(F.avg(d_score), 6).alias("mean_score_delta"), F.round(F.avg(d_margin), 6).alias("mean_margin_delta"),
        F.round(F.avg(F.when(F.col("changed"), d_score)), 6).alias("changed_score_delta"), F.round(F.avg(F.when(F.col("changed"), d_margin)), 6).alias("changed_margin_delta"),
    )


def change_pairs(both: DataFrame) -> DataFrame:
    return both.where("changed").groupBy(F.col("base_final_dialect").alias("base_label"), F.col("cand_final_dialect").alias("cand_label")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "base_label", "cand_label")


def policy_transitions(both: DataFrame) -> DataFrame:
    """Per policy how often it held before and after, over all and over changed rows: one aggregate of all counts."""
    counts = []
    for k, p in enumerate(dims.POLICIES):
        b, c = F.col(f"base_{p.name}"), F.col(f"cand_{p.name}")
        cells = {"kept": b & c, "lost": b & ~c, "gained": ~b & c, "neither": ~b & ~c}
        counts.append(F.struct(F.lit(p.name).alias("policy"), *(_count(v).alias(n) for n, v in cells.items()), *(_count(v & F.col("changed")).alias(f"changed_{n}") for n, v in cells.items())).alias(f"p{k}"))
    out = both.agg(*counts).select(F.explode(F.array(*(f"p{k}" for k in range(len(dims.POLICIES))))).alias("x")).select("x.*")
    return out.withColumn("net_gain", F.col("gained") - F.col("lost"))


def capped(rows: DataFrame, cap: int) -> DataFrame:
    """The first `cap` rows (0: all) of each policy and label in sample order; the cap is the feature."""
    out = policy_rows(rows)
    if cap:
        order = Window.partitionBy("policy", "final_dialect").orderBy("sample_id")
        out = out.withColumn("place", F.row_number().over(order)).where(F.col("place") <= cap)
    return out.select("policy", "final_dialect", "sample_id")


def subset_counts(rows: DataFrame, cap: int, wanted: tuple[str, ...] | None = None) -> DataFrame:
    """Rows of each policy and label: scanned, emitted up to the cap, skipped by the cap or because the label isn't wanted."""
    out = policy_rows(rows).groupBy("policy", "final_dialect").agg(F.count(F.lit(1)).alias("scanned"))
    inside = F.col("final_dialect").isin(*wanted) if wanted is not None else F.lit(True)
    able = F.when(inside, F.col("scanned")).otherwise(F.lit(0).cast("long"))
    emitted = F.least(able, F.lit(cap).cast("long")) if cap else able
    return out.withColumn("emitted", emitted).withColumn("skipped_by_cap", able - emitted).withColumn("skipped_by_dialect", F.col("scanned") - able)


def label_changes(both: DataFrame) -> DataFrame:
    """Rows of each label on either side, and changed ones from and to it; labels of both sides."""
    sides = both.select(F.explode(F.array(
        F.struct(F.col("base_final_dialect").alias("label"), F.lit(1).alias("b"), F.lit(0).alias("c"), F.col("changed").cast("int").alias("f"), F.lit(0).alias("t")),
        F.struct(F.col("cand_final_dialect").alias("label"), F.lit(0).alias("b"), F.lit(1).alias("c"), F.lit(0).alias("f"), F.col("changed").cast("int").alias("t")),
    )).alias("x")).select("x.*")
    return sides.groupBy("label").agg(*(F.sum(k).alias(n) for k, n in (("b", "base_rows"), ("c", "cand_rows"), ("f", "changed_from"), ("t", "changed_to"))))


#: The columns of an exported label row, in order, and the optional ones that are empty where the input lacks them.
EXPORT = (
    "sample_id", "manifest_row", "tar_path", "member", "youtube_id", "duration", "decoded", "weak_cc", "weak_region", "pseudo_cc", "teacher_cc", "teacher_confidence", "teacher_margin",
    "pseudo_label_source", "whisper_language", "whisper_language_confidence", "final_dialect", "final_country", "final_region", "confidence_tier", "strong_model_only", "sure_model_only",
    "ultra_sure_model_only", "sure_with_weak_region", "sure_with_weak_top1", "top1_score", "margin", "entropy", "top2_cc", "top2_score", "top3_cc", "top3_score", "weak_top1_match",
    "weak_top2_match", "weak_top3_match", "weak_region_match", "source_prediction_csv",
)
OPTIONAL = ("youtube_id", "pseudo_cc", "teacher_cc", "teacher_confidence", "teacher_margin", "pseudo_label_source", "whisper_language", "whisper_language_confidence", "source_prediction_csv")
DECIMALS = ("duration", "teacher_confidence", "teacher_margin", "whisper_language_confidence", "top1_score", "margin", "entropy", "top2_score", "top3_score")


def export_rows(rows: DataFrame) -> DataFrame:
    """labelled() rows as they are exported: the columns of EXPORT, numbers with eight decimals, flags as 0 and 1, '' for what is missing."""
    flags = {c for c, kind in rows.dtypes if kind == "boolean"}

    def rendered(c: str) -> Column:
        if c not in rows.columns:
            return F.lit("").alias(c)
        if c in DECIMALS:
            return eight_decimals(F.col(c)).alias(c)
        return (F.col(c).cast("int") if c in flags else F.coalesce(F.col(c), F.lit("")) if c in OPTIONAL else F.col(c)).alias(c)

    return rows.select(*map(rendered, EXPORT))


def export_order(rows: DataFrame, by: str = "sample_id") -> DataFrame:
    """Rows in the order of an export: by sample_id, by `tar` and member, or `none`."""
    keys = {"sample_id": ["sample_id"], "tar": ["tar_path", "member"], "none": []}[by]
    return rows.orderBy(*keys) if keys else rows


def weak_order(finished_rows: DataFrame, key: str) -> DataFrame:
    """Rows of finished() by weak label: the best agreement first; ties by size, then name."""
    return finished_rows.orderBy(F.desc("weak_top1_pct"), F.desc("n"), key)

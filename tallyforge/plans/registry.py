"""Registered queries of the label operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import coerce, dims
from ..functions import vectors as V
from ..operators import audio, decisions, metrics, sampling, tracker
from ..sources import fixtures
from . import oracle as O

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

WATCHED = ("AE", "BH", "JO", "KW", "OM", "QA", "SY")


def query(name: str, sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            ORACLE_SQL[name] = sql
        return f

    return add


def _rows(spark, d):
    return decisions.labelled(fixtures.predictions(spark, d))


def _both(spark, d):
    rows = _rows(spark, d)
    return decisions.compared(rows, decisions.candidate(rows))


def _matrix(spark, d):
    return metrics.confusion(fixtures.eval_rows(spark, d))


def _diag(spark, d):
    return metrics.diagnostics(fixtures.eval_rows(spark, d))


# Decisions.
query("A1_decisions_by_predicted", O.summary("final_dialect AS label", "label"))(lambda s, d: decisions.by_predicted(_rows(s, d)))
query("A3_decision_groupings", O.GROUPINGS)(lambda s, d: decisions.all_groupings(_rows(s, d)))
query("A4_policy_by_label", O.BY_POLICY)(lambda s, d: decisions.by_policy(_rows(s, d)))
query("A6_mismatch_pairs", O.MISMATCHES)(lambda s, d: decisions.mismatches(_rows(s, d)))
query("A7_tier_crosstab", O.CROSSTAB)(lambda s, d: decisions.tier_crosstab(_rows(s, d)))
query("A8_policy_totals", O.POLICY_TOTALS)(lambda s, d: decisions.policy_totals(_rows(s, d)))
query("P3_confidence_tiers", O.final("SELECT sample_id, confidence_tier FROM final"))(lambda s, d: _rows(s, d).select("sample_id", "confidence_tier"))
query("P4_policy_flags", O.final(f"SELECT sample_id, {', '.join(p.name for p in dims.POLICIES)} FROM final"))(lambda s, d: _rows(s, d).select("sample_id", *(p.name for p in dims.POLICIES)))
query("P5_weak_agreement", O.final("SELECT sample_id, weak_top1_match, weak_top2_match, weak_top3_match FROM final"))(lambda s, d: _rows(s, d).select("sample_id", *decisions.MATCHES[:3]))
query("P6_region_agreement", O.final("SELECT sample_id, weak_region, final_region, weak_region_match FROM final"))(lambda s, d: _rows(s, d).select("sample_id", "weak_region", "final_region", "weak_region_match"))
query("J1_label_lookup", O.final("SELECT sample_id, final_dialect, final_country FROM final"))(lambda s, d: _rows(s, d).select("sample_id", "final_dialect", "final_country"))
query("J3_policy_expansion", O.final(f"SELECT sample_id, policy FROM ({' UNION ALL '.join(f'''SELECT sample_id, '{p.name}' AS policy FROM final WHERE {p.name}''' for p in dims.POLICIES)})"))(
    lambda s, d: decisions.expand_by_table(_rows(s, d), dims.policies(s)).select("sample_id", "policy")
)


@query("N2_zero_null_policy", O.pred("SELECT count(*) AS n, count(*) FILTER (coalesce(entropy, 0) <= 0.6) AS passes_as_zero, count(*) FILTER (entropy <= 0.6) AS passes_as_null FROM pred WHERE decoded = 1"))
def null_policies(s, d):
    rows = fixtures.predictions(s, d).where("decoded = 1")
    text = F.col("entropy").cast("string")
    return rows.agg(F.count(F.lit(1)).alias("n"), F.count_if(coerce.at_most(coerce.num(text, "zero"), 0.6)).alias("passes_as_zero"), F.count_if(coerce.at_most(coerce.num(text), 0.6)).alias("passes_as_null"))


query("A30_compare_totals", O.both(O.COMPARE_TOTALS))(lambda s, d: decisions.comparison_totals(_both(s, d)))
query("A30_change_pairs", O.both("SELECT base_label, cand_label, count(*) AS n FROM both_sides WHERE changed GROUP BY ALL"))(lambda s, d: decisions.change_pairs(_both(s, d)))
query("A31_policy_transitions", O.both(O.TRANSITIONS))(lambda s, d: decisions.policy_transitions(_both(s, d)))
query("J4_keyed_compare", O.both("SELECT sample_id, base_label, cand_label, changed FROM both_sides"))(lambda s, d: _both(s, d).select("sample_id", F.col("base_final_dialect").alias("base_label"), F.col("cand_final_dialect").alias("cand_label"), "changed"))
query("W1_capped_subsets", O.final(f"SELECT policy, final_dialect, sample_id FROM ({O.POLICY_UNION}) QUALIFY row_number() OVER (PARTITION BY policy, final_dialect ORDER BY sample_id) <= 20"))(lambda s, d: decisions.capped(_rows(s, d), 20))

# Tracking.
query("A27_archive_stats", O.pred("SELECT tar_path, count(*) AS n, count(*) FILTER (decoded = 1) AS decoded, count(*) FILTER (decoded <> 1) AS failed, round(coalesce(sum(duration), 0), 6) AS duration, CASE WHEN count(*) FILTER (decoded <> 1) = 0 THEN 'done' ELSE 'partial' END AS status FROM pred GROUP BY tar_path"))(lambda s, d: tracker.archive_stats(fixtures.predictions(s, d)))
query("R1_shard_markers", O.pred(f"SELECT * FROM ({O.MARKERS})"))(lambda s, d: tracker.markers(fixtures.predictions(s, d)))
query("A33_status", O.pred(O.STATUS))(lambda s, d: tracker.status(tracker.markers(fixtures.predictions(s, d)), 20))


@query("J10_reconcile", O.pred(f"SELECT m.shard, m.csv_rows, m.decoded_rows, c.seen, c.seen_decoded, m.csv_rows = c.seen AND m.decoded_rows = c.seen_decoded AS ok FROM (SELECT shard, csv_rows + CASE WHEN shard = 3 THEN 1 ELSE 0 END AS csv_rows, decoded_rows FROM ({O.MARKERS})) m JOIN (SELECT shard, count(*) AS seen, count(*) FILTER (decoded = 1) AS seen_decoded FROM pred GROUP BY shard) c USING (shard)"))
def reconcile(s, d):
    rows = fixtures.predictions(s, d)
    wrong = tracker.markers(rows).withColumn("csv_rows", F.col("csv_rows") + F.when(F.col("shard") == 3, 1).otherwise(0))
    return tracker.reconcile(rows, wrong)


@query("J8_shard_audit", O.pred("SELECT e.shard, CASE WHEN e.shard = 5 THEN 'failed' WHEN e.shard <> 3 AND e.shard IN (SELECT shard FROM pred) THEN 'done' ELSE 'missing' END AS state FROM (SELECT unnest(range(0, 16))::INT AS shard) e UNION ALL SELECT 99, 'extra'"))
def shard_audit(s, d):
    present = fixtures.predictions(s, d).select("shard").distinct().where("shard != 3").unionByName(s.sql("SELECT 99 AS shard"))
    return tracker.shard_audit(s.range(16).select(F.col("id").cast("int").alias("shard")), present, s.sql("SELECT 5 AS shard"))


query("W2_islands", O.pred("SELECT min(u) AS low, max(u) AS high, CASE WHEN min(u) = max(u) THEN min(u)::VARCHAR ELSE min(u)::VARCHAR || '-' || max(u)::VARCHAR END AS span FROM (SELECT u, u - row_number() OVER (ORDER BY u) AS run FROM (SELECT DISTINCT user_id AS u FROM events)) GROUP BY run"))(
    lambda s, d: tracker.islands(s.read.parquet(f"{d}/events.parquet"), "user_id").select("low", "high", "span")
)
query("W3_file_chunks", O.final("SELECT f AS file_idx, count(*) AS n, min(sample_id) AS first_sample, max(sample_id) AS last_sample FROM (SELECT sample_id, (row_number() OVER (ORDER BY sample_id) - 1) // 1000 AS f FROM final) GROUP BY f"))(lambda s, d: tracker.file_chunks(_rows(s, d), 1000))
query("U5_retry_rows", O.pred("SELECT shard, sample_id, CASE WHEN shard = 5 THEN 'shard' ELSE 'row' END AS reason FROM pred WHERE shard = 5 OR decoded <> 1"))(lambda s, d: tracker.retry(fixtures.predictions(s, d), s.sql("SELECT 5 AS shard")))
query("A28_work_summary", O.MANIFEST + "SELECT count(*) AS shards, sum(n)::BIGINT AS rows, min(n) AS least, max(n) AS most, round(avg(n), 6) AS mean FROM (SELECT shard_idx, count(*) AS n FROM manifest GROUP BY ALL)")(lambda s, d: tracker.work_summary(fixtures.manifest(s, d)))
query("P19_label_from_path", O.MANIFEST + "SELECT dataset, CASE WHEN sample_id % 10 = 9 THEN '' ELSE upper(lang) END AS cc, count(*) AS n FROM manifest GROUP BY ALL")(lambda s, d: tracker.by_path(fixtures.manifest(s, d)))
query("X1_digest_shards")(lambda s, d: fixtures.manifest(s, d).select("sample_id", sampling.digest_shard(F.col("tar_path"), F.lit(32)).alias("shard")))
query("X2_digest_half")(lambda s, d: fixtures.manifest(s, d).select("sample_id", sampling.digest_half(F.concat_ws("|", F.col("sample_id").cast("string"), "dataset")).alias("half")))

# Metrics and diagnostics.
query("A9_confusion", O.evals("SELECT truth, pred, count(*) AS n FROM ev GROUP BY ALL"))(_matrix)


@query("A11_merged_shards", O.evals("SELECT truth, pred, count(*) AS n FROM ev GROUP BY ALL"))
def merged_shards(s, d):
    rows = fixtures.eval_rows(s, d)
    return metrics.merged(*(metrics.confusion(rows.where(F.col("rank") == k), on_invalid="raise") for k in range(3)))


query("A12_metrics", O.evals(O.METRICS))(lambda s, d: metrics.rounded(metrics.summary(metrics.per_class(_matrix(s, d)))))
query("A13_per_class", O.evals(O.PER_CLASS_OUT))(lambda s, d: metrics.rounded(metrics.per_class(_matrix(s, d))))
query("A14_two_class", O.TWO_CLASS)(lambda s, d: metrics.rounded(metrics.two_class(fixtures.two_class_rows(s, d))))
query("A34_predicted_ratio", O.evals(O.RATIO))(lambda s, d: metrics.rounded(metrics.predicted_ratio(metrics.per_class(_matrix(s, d)), infinite=False)))
query("W5_top_five", O.evals("SELECT sample_id, i - 1 AS id, round(probs[i], 6) AS value FROM (SELECT sample_id, probs, unnest(range(1, 24)) AS i FROM ev) QUALIFY row_number() OVER (PARTITION BY sample_id ORDER BY probs[i] DESC, i) <= 5"))(
    lambda s, d: fixtures.eval_rows(s, d).select("sample_id", F.explode(V.top_k(F.col("probs"), 5)).alias("x")).select("sample_id", F.col("x.id").cast("long").alias("id"), F.round("x.value", 6).alias("value"))
)
query("W6_top_confusions", O.evals(f"SELECT truth, pred, n FROM ({O.MATRIX}) WHERE truth <> pred AND n >= 2 QUALIFY row_number() OVER (PARTITION BY truth ORDER BY n DESC, pred DESC) <= 3"))(lambda s, d: metrics.top_confusions(_matrix(s, d), 3, 2).select("truth", "pred", "n"))
query("W7_false_positive_sources", O.evals(f"SELECT {O.code('pred')} AS pred_code, {O.code('truth')} AS truth_code, n, row_number() OVER (PARTITION BY pred ORDER BY n DESC, {O.code('truth')} DESC) AS place FROM ({O.MATRIX}) WHERE truth <> pred QUALIFY place <= 8"))(lambda s, d: metrics.false_positive_sources(_matrix(s, d)).withColumn("place", F.col("place").cast("long")))
query("A25_confusion_shares", O.evals(f"SELECT {O.code('truth')} AS truth_code, {O.code('pred')} AS pred_code, n, round(n / support, 6) AS share FROM (SELECT *, sum(n) OVER (PARTITION BY truth) AS support FROM ({O.MATRIX})) WHERE truth <> pred ORDER BY n DESC, 1, 2 LIMIT 30"))(lambda s, d: metrics.confusion_shares(_matrix(s, d)))
query("A23_by_region", O.evals(O.BY_REGION))(lambda s, d: metrics.by_region(_diag(s, d)))
query("A22_by_label", O.evals(O.BY_LABEL))(lambda s, d: metrics.by_label(_diag(s, d)))
for _col, _names in (("confidence_bucket", tuple(x[2] for x in dims.CONFIDENCE_BUCKETS) + ("unknown",)), ("duration_bucket", tuple(x[2] for x in dims.DURATION_BUCKETS) + ("missing",)), ("chunk_bucket", dims.CHUNK_BUCKETS)):
    query(f"A24_by_{_col}", O.evals(O.by_bucket(_col)))(lambda s, d, c=_col, n=_names: metrics.by_bucket(_diag(s, d), c, n))
query("A26_quantiles", O.evals(O.QUANTILES))(lambda s, d: metrics.quantiles(_diag(s, d), "top1"))
query("P17_row_diagnostics", O.evals(O.DIAG_ROWS))(lambda s, d: metrics.rounded(_diag(s, d).select("sample_id", "top1", "margin", "entropy", "confidence_bucket", "duration_bucket", "chunk_bucket", "correct")))


@query("G1_eval_gate", O.evals(O.GATE))
def eval_gate(s, d):
    """Baseline: the rows outside source 0; target: all rows."""
    rows = fixtures.eval_rows(s, d)
    base, target = (metrics.per_class(metrics.confusion(x)) for x in (rows.where("source != 0"), rows))
    ratios = metrics.predicted_ratio(target).join(target.select(coerce.lookup(dims.CODES, F.col("id")).alias("code"), "f1"), "code")
    return metrics.gate(metrics.summary(base), metrics.summary(target), metrics.predicted_ratio(base), ratios, WATCHED, 0.55)


query("G1_release", O.evals(f"SELECT bool_and(ok) AS release, count(*) FILTER (NOT ok) AS failed FROM ({O.GATE})"))(lambda s, d: metrics.released(eval_gate(s, d)))


@query("C3_bias_before_after", O.evals(O.BIAS))
def bias_before_after(s, d):
    """Accuracy of each split without and with a fixed additive bias."""
    bias = [0.05 * (i % 3) for i in range(dims.N)]
    rows = fixtures.eval_rows(s, d).withColumn("shifted", V.argmax(V.biased(F.col("probs"), bias)))
    return rows.groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg((F.col("pred") == F.col("truth")).cast("double")), 6).alias("before"), F.round(F.avg((F.col("shifted") == F.col("truth")).cast("double")), 6).alias("after"))


# Vectors.
def _round_all(a):
    return F.transform(a, lambda x: F.round(x, 6))


query("V1_region_marginals", O.evals(O.REGION_MARGINALS))(lambda s, d: fixtures.eval_rows(s, d).select("sample_id", F.posexplode(V.softmax(V.region_logits(F.col("logits")))).alias("region", "p")).select("sample_id", coerce.lookup(dims.REGIONS, F.col("region")).alias("region"), F.round("p", 6).alias("p")))
query("V2_active_mask", O.evals("SELECT sample_id, (list_position(m, list_max(m)) - 1)::INT AS pred FROM (SELECT sample_id, [CASE WHEN (i - 1) % 2 = 0 THEN logits[i] ELSE -3.4028234663852886e38 END FOR i IN range(1, 24)] AS m FROM ev)"))(lambda s, d: fixtures.eval_rows(s, d).select("sample_id", V.argmax(V.masked(F.col("logits"), [i % 2 == 0 for i in range(dims.N)])).alias("pred")))
query("V3_masked_target", O.evals("SELECT sample_id, round(list_sum([CASE WHEN (i - 1) % 2 = 0 THEN probs[i] ELSE 0 END FOR i IN range(1, 24)]), 6) AS mass, round(probs[1] / list_sum([CASE WHEN (i - 1) % 2 = 0 THEN probs[i] ELSE 0 END FOR i IN range(1, 24)]), 6) AS first FROM ev"))(
    lambda s, d: fixtures.eval_rows(s, d).select("sample_id", F.round(V.total(F.filter("probs", lambda x, i: i % 2 == 0)), 6).alias("mass"), F.round(F.get(V.masked_target(F.col("probs"), F.col("truth"), [i % 2 == 0 for i in range(dims.N)]), F.lit(0)), 6).alias("first"))
)
query("V5_biased_argmax", O.evals("SELECT sample_id, (list_position(m, list_max(m)) - 1)::INT AS pred FROM (SELECT sample_id, [CASE WHEN i IN (1, 3) THEN -1e30 ELSE ln(greatest(probs[i], 1e-45)) + 0.1 * ((i - 1) % 5) END FOR i IN range(1, 24)] AS m FROM ev)"))(lambda s, d: fixtures.eval_rows(s, d).select("sample_id", V.argmax(V.biased(F.col("probs"), [0.1 * (i % 5) for i in range(dims.N)], (0, 2))).alias("pred")))
query("V8_cross_entropy", O.evals("SELECT sample_id, round(-ln(probs[truth + 1]), 5) AS loss FROM ev"))(lambda s, d: fixtures.eval_rows(s, d).select("sample_id", F.round(V.cross_entropy(F.col("logits"), V.one_hot(F.col("truth"), dims.N)), 5).alias("loss")))
query("A37_weighted_mean_loss", O.evals("SELECT round(sum(w * l) / greatest(sum(w), 1e-6), 5) AS loss FROM (SELECT 1.0 + source AS w, -ln(probs[truth + 1]) AS l FROM ev)"))(
    lambda s, d: fixtures.eval_rows(s, d).select((F.col("source") + 1.0).alias("w"), V.cross_entropy(F.col("logits"), V.one_hot(F.col("truth"), dims.N)).alias("l")).agg(F.round(F.sum(F.col("w") * F.col("l")) / F.greatest(F.sum("w"), F.lit(1e-6)), 5).alias("loss"))
)
query("A19_mean_by_sample", "SELECT l_orderkey AS sample_id, round(avg(l_quantity), 6) AS q, round(avg(l_extendedprice), 6) AS p, round(avg(l_discount), 6) AS d, round(avg(l_tax), 6) AS t, count(*) AS chunks FROM lineitem GROUP BY l_orderkey")(
    lambda s, d: metrics.mean_vectors(fixtures.chunks(s, d), "sample_id", "vector", 4).select("sample_id", *(F.round(F.col("vector")[i], 6).alias(c) for i, c in enumerate("qpdt")), "chunks")
)


@query("A17_class_weights", O.CLASS_WEIGHTS)
def class_weights(s, d):
    counts = sampling.label_counts(fixtures.profile_rows(s, d)).withColumn("active", F.col("id") < 10)
    return metrics.rounded(metrics.class_weights(counts, "balanced", 0.5, 2.0))


# Datasets.
query("A15_profile", O.PROFILE)(lambda s, d: sampling.profile(fixtures.profile_rows(s, d)))
query("A16_label_counts", O.PROFILE_ROWS + f"SELECT l.id, l.code, count(p.sample_id) AS n FROM (SELECT unnest(range(0, 23))::INT AS id, unnest({O.CODES}) AS code) l LEFT JOIN prof p ON p.country_code = l.code GROUP BY ALL")(lambda s, d: sampling.label_counts(fixtures.profile_rows(s, d)))
query("S4_label_filter", O.PROFILE_ROWS + "SELECT sample_id, country_code FROM prof WHERE country_code IN ('AE', 'EG', 'MA')")(lambda s, d: sampling.known(fixtures.profile_rows(s, d), include=("AE", "EG", "MA", "SY"), exclude=("SY",)).select("sample_id", "country_code"))
query("J2_known_labels", O.PROFILE_ROWS + f"SELECT sample_id, country_code FROM prof WHERE list_contains({O.CODES}, country_code)")(lambda s, d: sampling.known(fixtures.profile_rows(s, d)).select("sample_id", "country_code"))
query("A21_majority_label", O.PROFILE_ROWS + "SELECT row_group, country_code AS label FROM (SELECT row_group, country_code, count(*) AS n, min(sample_id) AS f FROM prof WHERE country_code IS NOT NULL GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY row_group ORDER BY n DESC, f) = 1")(lambda s, d: sampling.majority_label(fixtures.profile_rows(s, d)))
query("W4_label_quota", O.PROFILE_ROWS + "SELECT sample_id, country_code FROM (SELECT sample_id, country_code, row_number() OVER (PARTITION BY country_code ORDER BY sample_id) AS r FROM prof WHERE country_code IS NOT NULL) WHERE r <= 5 ORDER BY sample_id LIMIT 100")(lambda s, d: sampling.quota(fixtures.profile_rows(s, d).where("country_code is not null"), 100, 23))
query("S5_task_shard", O.PROFILE_ROWS + "SELECT row_group FROM (SELECT DISTINCT row_group FROM prof) QUALIFY (row_number() OVER (ORDER BY row_group) - 1) % 3 = 1")(lambda s, d: sampling.task_shard(fixtures.profile_rows(s, d).select("row_group").distinct(), ["row_group"], 3, 1))
query("M3_manifest_assignment", O.PROFILE_ROWS + "SELECT source, ((row_number() OVER (ORDER BY source) - 1) % 6)::INT AS worker FROM (SELECT DISTINCT source FROM prof)")(lambda s, d: sampling.assigned(fixtures.profile_rows(s, d).select("source").distinct(), "source", 6))

# Audio geometry, on events' durations as lengths.
_LENGTH = "(event_id * 37) % 100000"


def _lengths(s, d):
    return s.read.parquet(f"{d}/events.parquet").select("event_id", F.expr(_LENGTH).alias("length"))


query("B5_chunk_spans", f"SELECT event_id, k::INT AS chunk_idx, (k * 30000)::BIGINT AS first, least((k + 1) * 30000, length)::BIGINT AS last FROM (SELECT event_id, {_LENGTH} AS length, unnest(range(0, greatest(1, ceil(greatest({_LENGTH}, 1) / 30000.0))::BIGINT)) AS k FROM events)")(
    lambda s, d: audio.chunk_spans(_lengths(s, d), "length", 30000).select("event_id", "chunk_idx", F.col("first").cast("long").alias("first"), F.col("last").cast("long").alias("last"))
)
query("B6_crop_starts", f"SELECT DISTINCT event_id, round_even(greatest({_LENGTH} - 20000, 0) * k / 4.0, 0)::BIGINT AS start FROM events, (SELECT unnest(range(0, 5)) AS k)")(
    lambda s, d: _lengths(s, d).select("event_id", F.explode(audio.crop_starts(F.col("length"), 20000, 5)).alias("start"))
)
query("B7_chunk_counts", f"SELECT n, count(*) AS samples FROM (SELECT greatest(1, ceil(greatest({_LENGTH}, 1) / 30000.0))::INT AS n FROM events) GROUP BY n")(
    lambda s, d: _lengths(s, d).select(audio.chunk_count(F.col("length"), 30000).alias("n")).groupBy("n").agg(F.count(F.lit(1)).alias("samples"))
)

from . import more as _more  # noqa: E402,F401  registers its queries

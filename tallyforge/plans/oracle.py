"""SQL of the registered label queries, in DuckDB's dialect, written apart from the DataFrame code."""

from __future__ import annotations

from ..functions import dims

CODES = "[" + ", ".join(f"'{c}'" for c in dims.CODES) + "]"
REGIONS = "[" + ", ".join(f"'{r}'" for r in dims.LABEL_REGIONS) + "]"
COUNTRIES = "[" + ", ".join(f"'{c}'" for c in dims.COUNTRIES) + "]"


def code(index: str) -> str:
    return f"{CODES}[{index} + 1]"


def region_of(label: str) -> str:
    return f"{REGIONS}[list_position({CODES}, {label})]"


PRED = f"""b AS (SELECT *, (user_id % 24)::INT AS w, CASE WHEN event_id % 10 < 7 AND user_id % 24 < 23 THEN user_id % 24 ELSE (event_id * 7 + 3) % 23 END::INT AS p1 FROM events),
pred AS (SELECT event_id AS sample_id, event_id AS manifest_row, (user_id % 16)::INT AS shard, ts,
  'root/cc=' || lower(CASE WHEN w = 23 THEN '' ELSE {code("w")} END) || '/t' || user_id::VARCHAR || '.tar' AS tar_path, 'm' || event_id::VARCHAR || '.wav' AS member,
  CASE WHEN event_type = 'error' THEN 0 ELSE 1 END AS decoded, value AS duration, CASE WHEN w = 23 THEN '' ELSE {code("w")} END AS weak_cc,
  {code("p1")} AS top1_cc, {code("((p1 + 1 + event_id % 5) % 23)")} AS top2_cc, {code("((p1 + 7 + event_id % 5) % 23)")} AS top3_cc,
  (8000 + (event_id * 37) % 2000) / 1e4 AS top1_score, ((event_id * 53) % 1000) / 1e3 AS margin,
  CASE WHEN event_id % 17 <> 0 THEN ((event_id * 29) % 150) / 1e2 END AS entropy, CASE WHEN event_id % 3 <> 0 THEN {REGIONS}[p1 + 1] END AS top1_region, p1 FROM b)"""


def _flag(p: dims.Policy) -> str:
    terms = [f"top1_score >= {p.min_score!r}::DOUBLE", f"margin >= {p.min_margin!r}::DOUBLE"]
    if p.max_entropy is not None:
        terms.append(f"entropy <= {p.max_entropy!r}::DOUBLE")
    if p.weak_region:
        terms.append("weak_region_match")
    if p.weak_top1:
        terms.append("weak_top1_match")
    return f"coalesce({' AND '.join(terms)}, false) AS {p.name}"


FLAGS = ", ".join(_flag(p) for p in dims.POLICIES)
NAMES = [p.name for p in dims.POLICIES]
FINAL = f"""{PRED}, f1 AS (SELECT *, coalesce({region_of("weak_cc")}, 'unknown') AS weak_region, top1_cc AS final_dialect,
  {COUNTRIES}[list_position({CODES}, top1_cc)] AS final_country, coalesce(top1_region, {region_of("top1_cc")}, 'unknown') AS final_region FROM pred WHERE decoded = 1),
f2 AS (SELECT *, CASE WHEN top1_score >= 0.95::DOUBLE AND margin >= 0.5::DOUBLE THEN 'strong' WHEN top1_score >= 0.9::DOUBLE AND margin >= 0.3::DOUBLE THEN 'usable' ELSE 'low' END AS confidence_tier,
  weak_cc <> '' AND weak_cc = top1_cc AS weak_top1_match, weak_cc <> '' AND weak_cc IN (top1_cc, top2_cc) AS weak_top2_match,
  weak_cc <> '' AND weak_cc IN (top1_cc, top2_cc, top3_cc) AS weak_top3_match, weak_region <> 'unknown' AND weak_region = final_region AS weak_region_match FROM f1),
final AS (SELECT *, {FLAGS} FROM f2)"""


def pred(select: str) -> str:
    return f"WITH {PRED} {select}"


def final(select: str) -> str:
    return f"WITH {FINAL} {select}"


def _pct(n: str, d: str) -> str:
    return f"CASE WHEN {d} = 0 THEN 0::DOUBLE ELSE round(100 * ({n}) / ({d})::DOUBLE, 6) END"


_STRONG = "count(*) FILTER (confidence_tier = 'strong')"
COUNTERS = f"""count(*) AS n, round(sum(duration) / 3600, 6) AS hours, round(avg(top1_score), 6) AS mean_score, round(avg(margin), 6) AS mean_margin,
  {_STRONG} AS strong, count(*) FILTER (confidence_tier = 'usable') AS usable, count(*) FILTER (confidence_tier = 'low') AS low,
  count(*) FILTER (weak_top1_match) AS weak_top1, count(*) FILTER (weak_top2_match) AS weak_top2, count(*) FILTER (weak_top3_match) AS weak_top3,
  count(*) FILTER (weak_region_match) AS weak_region, {_pct(_STRONG, "count(*)")} AS strong_pct,
  {_pct("count(*) FILTER (confidence_tier = 'usable')", "count(*)")} AS usable_pct, {_pct("count(*) FILTER (confidence_tier = 'low')", "count(*)")} AS low_pct,
  {_pct("count(*) FILTER (weak_top2_match)", "count(*)")} AS weak_top2_pct, {_pct("count(*) FILTER (weak_top3_match)", "count(*)")} AS weak_top3_pct,
  {_pct("count(*) FILTER (weak_top1_match)", "count(*)")} AS weak_top1_pct, {_pct("count(*) FILTER (weak_region_match)", "count(*)")} AS weak_region_pct,
  {_pct("count(*) FILTER (confidence_tier = 'strong' AND weak_top1_match)", _STRONG)} AS strong_weak_top1_pct,
  {_pct("count(*) FILTER (confidence_tier = 'strong' AND weak_region_match)", _STRONG)} AS strong_weak_region_pct"""


def summary(keys: str, group: str) -> str:
    return final(f"SELECT {keys}, {COUNTERS} FROM final GROUP BY {group}")


GROUPINGS = final(" UNION ALL ".join(
    f"SELECT '{kind}' AS grouping, {key} AS key, {COUNTERS} FROM final GROUP BY ALL"
    for kind, key in (("overall", "'all'"), ("predicted", "final_dialect"), ("weak", "CASE WHEN weak_cc = '' THEN 'MISSING' ELSE weak_cc END"), ("weak_region", "final.weak_region"), ("predicted_region", "final_region"))
))
POLICY_UNION = " UNION ALL ".join(f"SELECT {k} AS position, '{n}' AS policy, final_dialect, sample_id, duration FROM final WHERE {n}" for k, n in enumerate(NAMES))
BY_POLICY = final(f"""SELECT p.position::INT AS position, p.policy, coalesce(x.label, 'all') AS label, coalesce(x.n, 0) AS n, round(coalesce(x.h, 0) / 3600, 6) AS hours
  FROM (VALUES {", ".join(f"({k}, '{n}')" for k, n in enumerate(NAMES))}) p(position, policy)
  LEFT JOIN (SELECT policy, 'all' AS label, count(*) AS n, sum(duration) AS h FROM ({POLICY_UNION}) GROUP BY policy
    UNION ALL SELECT policy, final_dialect, count(*), sum(duration) FROM ({POLICY_UNION}) GROUP BY policy, final_dialect) x USING (policy)""")
MISMATCHES = final(f"SELECT weak_cc, final_dialect, count(*) AS n, {_STRONG} AS strong FROM final WHERE weak_cc <> '' AND weak_cc <> final_dialect GROUP BY ALL ORDER BY n DESC, weak_cc, final_dialect LIMIT 50")
CROSSTAB = final(f"SELECT final_dialect AS label, {_STRONG} AS strong, count(*) FILTER (confidence_tier = 'usable') AS usable, count(*) FILTER (confidence_tier = 'low') AS low, count(*) AS n, {_pct(_STRONG, 'count(*)')} AS strong_pct FROM final GROUP BY ALL")
POLICY_TOTALS = final(" UNION ALL ".join(f"SELECT '{n}' AS policy, count(*) FILTER ({n}) AS n, {_pct(f'count(*) FILTER ({n})', 'count(*)')} AS pct FROM final" for n in NAMES))

_CAND = ", ".join(_flag(p).replace(f"AS {p.name}", f"AS cand_{p.name}").replace("top1_score", "cand_score").replace("margin", "cand_margin") for p in dims.POLICIES)


def both(select: str) -> str:
    return f"""WITH {FINAL}, c1 AS (SELECT *, sample_id % 11 = 0 AS moved, CASE WHEN sample_id % 11 = 0 THEN top1_score - 0.01::DOUBLE ELSE top1_score END AS cand_score,
  CASE WHEN sample_id % 11 = 0 THEN margin + 0.02::DOUBLE ELSE margin END AS cand_margin FROM final),
both_sides AS (SELECT *, final_dialect AS base_label, CASE WHEN moved THEN {code("((p1 + 1) % 23)")} ELSE final_dialect END AS cand_label, moved AS changed, {_CAND} FROM c1) {select}"""


COMPARE_TOTALS = """SELECT count(*) AS n, count(*) FILTER (changed) AS changed, count(*) FILTER (NOT changed) AS same, round(avg(cand_score - top1_score), 6) AS mean_score_delta, round(avg(cand_margin - margin), 6) AS mean_margin_delta,
  round(avg(cand_score - top1_score) FILTER (changed), 6) AS changed_score_delta, round(avg(cand_margin - margin) FILTER (changed), 6) AS changed_margin_delta FROM both_sides"""
_CELLS = {"kept": "b AND c", "lost": "b AND NOT c", "gained": "NOT b AND c", "neither": "NOT b AND NOT c"}
TRANSITIONS = f"""SELECT policy, {", ".join(f"count(*) FILTER ({v}) AS {k}" for k, v in _CELLS.items())}, {", ".join(f"count(*) FILTER ({v} AND changed) AS changed_{k}" for k, v in _CELLS.items())},
  count(*) FILTER (NOT b AND c) - count(*) FILTER (b AND NOT c) AS net_gain FROM ({" UNION ALL ".join(f"SELECT '{n}' AS policy, changed, {n} AS b, cand_{n} AS c FROM both_sides" for n in NAMES)}) GROUP BY policy"""

MARKERS = "SELECT shard, count(*) AS csv_rows, count(*) FILTER (decoded = 1) AS decoded_rows, count(*) FILTER (decoded <> 1) AS failed_rows, round(sum(duration), 6) AS duration_sec, max(ts) AS mtime FROM pred GROUP BY shard"
STATUS = f"""SELECT done_shards, rows, decoded, failed, round(100 * done_shards / 20::DOUBLE, 6) AS done_pct, round(decoded / done_shards::DOUBLE, 6) AS mean_decoded, round(decoded / done_shards::DOUBLE * 20, 6) AS projected_decoded,
  round(decoded / done_shards::DOUBLE * 20 - decoded, 6) AS remaining_decoded, recent, round(shard_rate, 6) AS shards_per_hour, round((20 - done_shards) / shard_rate, 6) AS eta_hours,
  round(row_rate, 6) AS rows_per_hour, round((decoded / done_shards::DOUBLE * 20 - decoded) / row_rate, 6) AS row_eta_hours
  FROM (SELECT a.*, r.recent, CASE WHEN r.recent >= 2 AND r.s > 0 THEN (r.recent - 1) * 3600 / r.s END AS shard_rate, CASE WHEN r.recent >= 2 AND r.s > 0 THEN r.rows * 3600 / r.s END AS row_rate
  FROM (SELECT count(*) AS done_shards, sum(csv_rows)::BIGINT AS rows, sum(decoded_rows)::BIGINT AS decoded, sum(failed_rows)::BIGINT AS failed FROM ({MARKERS})) a,
  (SELECT count(*) AS recent, epoch_us(max(mtime)) / 1e6 - epoch_us(min(mtime)) / 1e6 AS s, sum(decoded_rows)::BIGINT AS rows FROM ({MARKERS}) WHERE mtime >= (SELECT max(ts) FROM pred) - INTERVAL 30 MINUTE) r)"""
MANIFEST = "WITH manifest AS (SELECT doc_id AS sample_id, lang, source AS dataset, (doc_id % 32)::INT AS shard_idx FROM documents) "

EVALS = """e1 AS (SELECT vec_id, label, [embedding[i]::DOUBLE * 8 + CASE WHEN i - 1 = label AND vec_id % 3 <> 0 THEN 1.0 ELSE 0.0 END::DOUBLE FOR i IN range(1, 24)] AS logits FROM embeddings),
e2 AS (SELECT *, list_sum([exp(x - list_max(logits)) FOR x IN logits]) AS z FROM e1),
ev AS (SELECT vec_id AS sample_id, label AS truth, (list_position(logits, list_max(logits)) - 1)::INT AS pred, logits, [exp(x - list_max(logits)) / z FOR x IN logits] AS probs,
  (vec_id % 4)::INT AS source, CASE WHEN vec_id % 13 <> 0 THEN (vec_id % 90)::DOUBLE END AS duration_seconds, CASE WHEN vec_id % 2 = 0 THEN 'tune' ELSE 'holdout' END AS split FROM e2)"""


def evals(select: str) -> str:
    return f"WITH {EVALS} {select}" if not select.startswith(", ") else f"WITH {EVALS}{select}"


MATRIX = "SELECT truth, pred, count(*) AS n FROM ev GROUP BY ALL"


def per_class(rows: str = "ev", n: int = 23) -> str:
    return f"""(SELECT id, support, predicted, hit, precision, recall, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0::DOUBLE END AS f1 FROM (
  SELECT id, support, predicted, hit, CASE WHEN predicted = 0 THEN 0::DOUBLE ELSE hit / predicted::DOUBLE END AS precision, CASE WHEN support = 0 THEN 0::DOUBLE ELSE hit / support::DOUBLE END AS recall FROM (
  SELECT i.id::INT AS id, count(*) FILTER (r.truth = i.id) AS support, count(*) FILTER (r.pred = i.id) AS predicted, count(*) FILTER (r.truth = i.id AND r.pred = i.id) AS hit
  FROM (SELECT unnest(range(0, {n})) AS id) i, (SELECT truth, pred FROM {rows} WHERE truth BETWEEN 0 AND {n - 1} AND pred BETWEEN 0 AND {n - 1}) r GROUP BY i.id)))"""


def metrics(rows: str = "ev", n: int = 23, digits: int | None = 6) -> str:
    r = (lambda x: f"round({x}, {digits})") if digits else (lambda x: x)
    return f"""SELECT {r("sum(hit) / sum(support)::DOUBLE")} AS accuracy, {r("coalesce(avg(recall) FILTER (support > 0), 0)")} AS balanced_accuracy, {r("coalesce(avg(f1) FILTER (support > 0), 0)")} AS macro_f1,
  {r("sum(f1 * support) / sum(support)")} AS weighted_f1, sum(support)::BIGINT AS n FROM {per_class(rows, n)}"""


METRICS = metrics()
PER_CLASS_OUT = f"SELECT id, support, predicted, hit, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1 FROM {per_class()}"
TWO_CLASS = f"""WITH t AS (SELECT CASE WHEN doc_id % 19 = 0 THEN -100 ELSE quality END AS truth, toxic AS pred FROM labels)
SELECT m.*, i.ignored FROM ({metrics("t", 2)}) m, (SELECT count(*) FILTER (truth < 0) AS ignored FROM t) i"""
RATIO = f"SELECT {code('id')} AS code, support, predicted, predicted - hit AS false_positives, CASE WHEN support > 0 THEN round(predicted / support::DOUBLE, 6) END AS ratio FROM {per_class()} WHERE support + predicted > 0"


def _bucket(value: str, limits, missing: str) -> str:
    cases = " ".join(f"WHEN {value} >= {low!r}::DOUBLE THEN '{name}'" for low, _, name in reversed(limits))
    return f"CASE WHEN {value} IS NULL THEN '{missing}' {cases} ELSE '{missing}' END"


_CHUNKS = "greatest(1, ceil(duration_seconds / 30))::INT"
DIAG = f""", d1 AS (SELECT *, list_sort(probs, 'DESC') AS s, -list_sum([greatest(x, 1e-12) * ln(greatest(x, 1e-12)) FOR x IN probs]) AS entropy, coalesce({_CHUNKS}, 1) AS chunks FROM ev),
diag AS (SELECT *, s[1] AS top1, s[1] - s[2] AS margin, {_bucket("s[1]", dims.CONFIDENCE_BUCKETS, "unknown")} AS confidence_bucket, {_bucket("duration_seconds", dims.DURATION_BUCKETS, "missing")} AS duration_bucket,
  CASE WHEN chunks <= 1 THEN '1' WHEN chunks = 2 THEN '2' WHEN chunks <= 4 THEN '3-4' WHEN chunks <= 8 THEN '5-8' ELSE '9+' END AS chunk_bucket, truth = pred AS correct,
  {REGIONS}[truth + 1] AS truth_region, {REGIONS}[pred + 1] AS pred_region FROM d1) """
DIAG_ROWS = DIAG + "SELECT sample_id, round(top1, 6) AS top1, round(margin, 6) AS margin, round(entropy, 6) AS entropy, confidence_bucket, duration_bucket, chunk_bucket, correct FROM diag"
QUANTILES = DIAG + "SELECT (k * 10)::INT AS percent, round(quantile_cont(top1, [0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0])[k + 1], 6) AS value FROM diag, (SELECT unnest(range(0, 11)) AS k) GROUP BY k"
BY_REGION = DIAG + """SELECT truth_region AS region, count(*) AS support, count(*) FILTER (correct) AS exact, count(*) FILTER (truth_region = pred_region) AS same_region,
  round(count(*) FILTER (correct) / count(*)::DOUBLE, 6) AS accuracy, round(count(*) FILTER (truth_region = pred_region) / count(*)::DOUBLE, 6) AS region_accuracy,
  any_value(tops) AS predicted FROM diag JOIN (SELECT truth_region, string_agg(pred_region || ':' || k::VARCHAR, ', ' ORDER BY k DESC, pred_region) AS tops FROM (
    SELECT truth_region, pred_region, count(*) AS k FROM diag GROUP BY truth_region, pred_region QUALIFY row_number() OVER (PARTITION BY truth_region ORDER BY k DESC, pred_region) <= 5) GROUP BY truth_region) USING (truth_region) GROUP BY truth_region"""
BY_LABEL = DIAG + f""", pairs AS (SELECT truth, {code("pred")} AS c, count(*) AS k FROM diag WHERE NOT correct GROUP BY ALL),
lists AS (SELECT truth, string_agg(c || ':' || k::VARCHAR, ', ' ORDER BY k DESC, c) AS confusions FROM (SELECT * FROM pairs QUALIFY row_number() OVER (PARTITION BY truth ORDER BY k DESC, c) <= 5) GROUP BY truth)
SELECT l.code, count(d.sample_id) AS support, count(*) FILTER (d.correct) AS correct, CASE WHEN count(d.sample_id) > 0 THEN round(count(*) FILTER (d.correct) / count(d.sample_id)::DOUBLE, 6) END AS accuracy, coalesce(any_value(lists.confusions), '') AS confusions
FROM (SELECT unnest(range(0, 23)) AS id, unnest({CODES}) AS code) l LEFT JOIN diag d ON d.truth = l.id LEFT JOIN lists ON lists.truth = l.id GROUP BY l.code""".lstrip()
BY_LABEL = BY_LABEL.replace("FROM d1) , pairs", "FROM d1), pairs")


def by_bucket(col: str) -> str:
    return DIAG + f"""SELECT {col} AS bucket, count(*) AS support, count(*) FILTER (correct) AS correct, round(avg(top1), 6) AS mean_top1, round(avg(margin), 6) AS mean_margin, round(avg(entropy), 6) AS mean_entropy,
  round(avg(1), 6) AS mean_crops, round(avg(chunks), 6) AS mean_chunks, round(avg(duration_seconds), 6) AS mean_duration, round(count(*) FILTER (correct) / count(*)::DOUBLE, 6) AS accuracy FROM diag GROUP BY ALL"""


_WATCHED = "('AE', 'BH', 'JO', 'KW', 'OM', 'QA', 'SY')"
_BASE = per_class("(SELECT * FROM ev WHERE source <> 0)")
GATE = f"""SELECT name, ok FROM (SELECT unnest([{{'name': 'macro_f1', 'ok': t.macro_f1 - b.macro_f1 >= 0.002}}, {{'name': 'accuracy', 'ok': t.accuracy - b.accuracy >= -0.002}},
  {{'name': 'weighted_f1', 'ok': t.weighted_f1 - b.weighted_f1 >= -0.001}}, {{'name': 'ratios', 'ok': w.fails = 0}}, {{'name': 'watched_f1', 'ok': coalesce(w.kw >= 0.55, false)}}], recursive := true)
  FROM ({metrics("(SELECT * FROM ev WHERE source <> 0)", digits=None)}) b, ({metrics(digits=None)}) t,
  (SELECT count(*) FILTER (abs(t.ratio - 1) > abs(b.ratio - 1) + 0.05) AS fails, (SELECT max(f1) FROM {per_class()} WHERE id = 8 AND support + predicted > 0) AS kw
   FROM (SELECT {code("id")} AS code, CASE WHEN support > 0 THEN predicted / support::DOUBLE ELSE 'Infinity'::DOUBLE END AS ratio FROM {_BASE} WHERE support + predicted > 0) b
   JOIN (SELECT {code("id")} AS code, f1, CASE WHEN support > 0 THEN predicted / support::DOUBLE ELSE 'Infinity'::DOUBLE END AS ratio FROM {per_class()} WHERE support + predicted > 0) t USING (code) WHERE code IN {_WATCHED}) w)"""
BIAS = """SELECT split, count(*) AS n, round(avg((pred = truth)::INT), 6) AS before, round(avg((list_position(m, list_max(m)) - 1 = truth)::INT), 6) AS after
FROM (SELECT *, [ln(greatest(probs[i], 1e-45)) + 0.05 * ((i - 1) % 3) FOR i IN range(1, 24)] AS m FROM ev) GROUP BY split"""
REGION_MARGINALS = f"SELECT sample_id, region, round(sum(p), 6) AS p FROM (SELECT sample_id, unnest(probs) AS p, unnest({REGIONS}) AS region FROM ev) GROUP BY ALL"

PROFILE_ROWS = f"""WITH prof AS (SELECT doc_id AS sample_id, CASE WHEN doc_id % 25 < 23 THEN {code("(doc_id % 25)")} WHEN doc_id % 25 = 23 THEN 'XX' END AS country_code, (doc_id % 23)::INT AS country_id, source,
  CASE WHEN doc_id % 10 < 8 THEN 'train' WHEN doc_id % 10 = 8 THEN 'validation' ELSE 'test' END AS split, (doc_id // 50)::INT AS row_group FROM documents) """
PROFILE = PROFILE_ROWS + """SELECT split, 'total' AS kind, '' AS key, count(*) AS n FROM prof GROUP BY split UNION ALL SELECT split, 'code', country_code, count(*) FROM prof GROUP BY split, country_code
UNION ALL SELECT split, 'id', country_id::VARCHAR, count(*) FROM prof GROUP BY split, country_id UNION ALL SELECT split, 'source', source, count(*) FROM prof GROUP BY split, source"""
CLASS_WEIGHTS = PROFILE_ROWS + f"""SELECT id, CASE WHEN id < 10 THEN round(least(greatest(raw / avg(raw) FILTER (id < 10) OVER (), 0.5), 2.0), 6) ELSE 0::DOUBLE END AS weight FROM (
  SELECT id, sum(n) FILTER (id < 10) OVER () / (n * 10) AS raw FROM (SELECT l.id, greatest(count(p.sample_id), 1)::DOUBLE AS n FROM (SELECT unnest(range(0, 23))::INT AS id, unnest({CODES}) AS code) l LEFT JOIN prof p ON p.country_code = l.code GROUP BY l.id))"""

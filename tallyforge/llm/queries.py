"""The registered queries of the subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import cdc, decisionlist, fmindex, langmix, licenses, mixing, sharding, sitetemplates, urlrules
from .minhash import near_duplicates
from .shared import table

#: The stated rules of the URL query, as host and path.
URL_RULES = [
    urlrules.Rule("net", "/", urlrules.BLOCK),
    urlrules.Rule("example.net", "/en/", urlrules.ALLOW),
    urlrules.Rule("example.com", "/de/", urlrules.BLOCK),
    urlrules.Rule("org", "/fr/", urlrules.ALLOW),
]


def op1_minmax_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op2_feistel_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_index(table(spark, sf_dir, "documents"))


def op3_block_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed_words(table(spark, sf_dir, "documents"))


def op4_chunk_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that repeat passages of others, with the spans to remove and the documents that keep them."""
    return cdc.repeated_passages(table(spark, sf_dir, "documents")).where(F.size("spans") > 0)


def op5_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page is labelled bad if the label of its number is toxic or of low quality, or if its host says abuse."""
    pages = table(spark, sf_dir, "pages")
    bad = table(spark, sf_dir, "labels").selectExpr("doc_id AS page_id", "toxic = 1 OR quality = 0 AS bad")
    return urlrules.judge(pages, urlrules.page_labels(pages, bad), URL_RULES)


def op6_site_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sitetemplates.extract(table(spark, sf_dir, "pages"))


def op7_language_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langmix.identify(table(spark, sf_dir, "documents"))


def op8_decision_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decisionlist.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(licenses.document_files(table(spark, sf_dir, "documents")))


def op10_fm_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fmindex.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_minmax_near_dedup, op2_feistel_sharding, op3_block_mixing, op4_chunk_dedup, op5_url_rules, op6_site_templates,
        op7_language_mixture, op8_decision_list, op9_license_scan, op10_fm_decontamination,
    )
}

#: Words are cut at white space after lower-casing A-Z alone.
_LOWER = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLE_SQL: dict[str, str] = {
    "op1_minmax_near_dedup": f"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
u AS (SELECT doc_id, len(ws) AS k, unnest(ws) AS x, generate_subscripts(ws, 1) AS i FROM w),
g AS (SELECT doc_id, k, i, concat_ws(' ', x, lead(x, 1) OVER p, lead(x, 2) OVER p, lead(x, 3) OVER p, lead(x, 4) OVER p) AS g FROM u WINDOW p AS (PARTITION BY doc_id ORDER BY i)),
e AS (SELECT DISTINCT doc_id, CASE WHEN k < 5 THEN 'short ' || k::VARCHAR || ' ' || g ELSE g END AS g FROM g WHERE CASE WHEN k < 5 THEN i = 1 ELSE i <= k - 4 END),
n AS (SELECT w.doc_id, coalesce(c.n, 0)::BIGINT AS n_shingles FROM w LEFT JOIN (SELECT doc_id, count(*) AS n FROM e GROUP BY doc_id) c USING (doc_id)),
b AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM e x JOIN e y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY ALL),
l AS (SELECT b.a, b.b FROM b JOIN n p ON p.doc_id = b.a JOIN n q ON q.doc_id = b.b
      WHERE 100 * b.k >= 85 * (p.n_shingles + q.n_shingles - b.k)),
r(a, b) AS (SELECT doc_id, doc_id FROM n UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b),
c AS (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY a)
SELECT n.doc_id, n.n_shingles, c.component_id, n.doc_id = c.component_id AS kept FROM n JOIN c USING (doc_id)""",
    "op9_license_scan": licenses.oracle(),
    "op10_fm_decontamination": f"""
WITH d AS (SELECT doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS ws FROM documents),
b AS (SELECT item_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS ws FROM benchmark),
p AS (SELECT item_id, least(len(ws), 10) AS k, array_to_string(ws[i:i + least(len(ws), 10) - 1], ' ') AS phrase
  FROM (SELECT *, unnest(range(1, greatest(len(ws) - 9, 1) + 1)) AS i FROM b WHERE len(ws) > 0)),
lengths AS (SELECT DISTINCT k FROM p),
o AS (SELECT d.doc_id, i, k, array_to_string(ws[i:i + k - 1], ' ') AS phrase
  FROM (SELECT doc_id, ws, k, unnest(range(1, len(ws) - k + 2)) AS i FROM d, lengths) d),
hits AS (SELECT o.doc_id, o.i, o.k, p.item_id FROM o JOIN p ON o.phrase = p.phrase AND o.k = p.k),
hit_words AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS j FROM hits) GROUP BY doc_id),
hit_items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM hits) GROUP BY doc_id)
SELECT d.doc_id, len(d.ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit_words USING (doc_id) LEFT JOIN hit_items USING (doc_id)""",
}

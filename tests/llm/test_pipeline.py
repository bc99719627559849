import random

from brute import components, contamination, words

import corpus_pipeline as P


def test_stages_against_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    kind = docs.columns
    rows = {r["doc_id"]: r for r in docs.collect()}

    first = P.language(spark, docs, sf_dir).persist()
    assert first.columns == kind and {r["doc_id"]: r for r in first.collect()}.items() <= rows.items()
    assert first.count() >= 0.97 * len(rows)

    second = P.dedup(spark, first, sf_dir).persist()
    want = {i for i, x in components([(r["doc_id"], r["text"]) for r in first.collect()], 80).items() if x[2]}
    assert second.columns == kind and {r["doc_id"] for r in second.collect()} == want

    third = P.decontaminate(spark, second, sf_dir).persist()
    items = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text").collect()]
    hits = {r[0]: r for r in contamination([(r["doc_id"], r["text"]) for r in second.collect()], items)}
    before = {r["doc_id"]: r["text"] for r in second.collect()}
    after = {r["doc_id"]: r for r in third.collect()}
    assert third.columns == kind and set(after) == want
    for i, r in after.items():
        assert (r["text"] == before[i]) == (not hits[i][5]) and r["n_chars"] == len(r["text"])

    fourth = P.mix(spark, third, sf_dir).persist()
    parts = fourth.collect()
    assert fourth.columns == kind
    size = {i: len(words(r["text"])) for i, r in after.items()}
    taken = dict.fromkeys(size, 0)
    for r in parts:
        assert r["text"] in after[r["doc_id"]]["text"] and r["n_chars"] == len(r["text"])
        taken[r["doc_id"]] += len(words(r["text"]))
    assert all(taken[i] <= 2 * size[i] for i in size)
    assert abs(sum(taken.values()) - 1.5 * sum(size.values())) <= 0.1 * sum(size.values())

    last = P.shard(spark, fourth, sf_dir).collect()
    assert len(last) == len(parts)
    counts = [sorted(r["slot"] for r in last if r["shard"] == s) for s in range(P.SHARDS)]
    assert all(c == list(range(len(c))) for c in counts) and max(map(len, counts)) - min(map(len, counts)) <= 1
    random.seed(0)


def test_dedup_leaves_the_texts_where_they_are(spark, sf_dir):
    """Without a small side to broadcast, as on large tables, the rows that stay are picked without a shuffle of the texts."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
        plan = P.dedup(spark, docs, sf_dir)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "hashpartitioning" not in plan and "SortMergeJoin" not in plan

import random

import pytest
from brute import words
from pyspark.sql import functions as F

from tallyforge.llm import mixing
from tallyforge.llm.shared import Workspace, words_of


def fill(sizes):
    """Targets by sharing the excess again and again."""
    order = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    target, left, open_ = dict.fromkeys(order, 0.0), 1.5 * sum(sizes.values()), set(order)
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if 2 * sizes[s] < level * weight[s]}
        if not full:
            target |= {s: level * weight[s] for s in open_}
            break
        for s in full:
            target[s] = 2.0 * sizes[s]
            left -= target[s]
        open_ -= full
    return target


def corpus():
    rng = random.Random(2)
    rows = []
    for i in range(400):
        source = rng.choice(["b", "b", "b", "a", "é", "Z", None, "empty"])
        n = 0 if source == "empty" else rng.choice([1, 5, 80, 300])
        rows.append((i, " ".join(rng.choice(["x", "yy"]) for _ in range(n)) if n else rng.choice([None, "", " \t"]), source, 5))
    rows.append((1000, "  long\n" * 20_000, "a", 5))
    return rows + [rows[3]] * 4


SCHEMA = "doc_id long, text string, source string, size int"


def test_contract(spark):
    rows = corpus()
    df = spark.createDataFrame(rows, SCHEMA)
    out = mixing.mixed_words(df.repartition(4)).collect()
    again = mixing.mixed_words(df.repartition(3)).collect()
    assert sorted(map(repr, out)) == sorted(map(repr, again))
    sizes, source_of = {}, {}
    for i, t, s, _ in rows:
        sizes[s] = sizes.get(s, 0) + len(words(t))
        source_of[i] = s
    target, taken = fill(sizes), dict.fromkeys(sizes, 0)
    assert len(out) == len(rows)
    for r in out:
        s = source_of[r["doc_id"]]
        assert r["source_size"] == sizes[s] and r["target"] == pytest.approx(target[s])
        assert 0 <= r["taken"] <= 2 * r["size"]
        taken[s] += r["taken"]
    for s in sizes:
        assert abs(taken[s] - target[s]) <= 3 * mixing.BLOCK


def test_permuted_is_a_permutation(spark):
    for n in (1, 2, 3, 11, 101, 1000):
        df = spark.range(n).select(mixing.permuted(F.col("id"), F.lit(n).cast("long"), F.lit(77).cast("long")).alias("p"))
        assert sorted(r["p"] for r in df.collect()) == list(range(n))


def test_documents_hold_the_drawn_words(spark):
    rows = corpus()
    df = spark.createDataFrame(rows, SCHEMA)
    per_doc = {}
    for r in mixing.mixed_words(df).collect():
        per_doc[r["doc_id"]] = per_doc.get(r["doc_id"], 0) + r["taken"]
    out = mixing.mixed_documents(df)
    assert out.columns == df.columns
    got = {}
    source = {i: t for i, t, _, _ in rows}
    for r in out.collect():
        assert r["text"] in source[r["doc_id"]]
        got[r["doc_id"]] = got.get(r["doc_id"], 0) + len(words(r["text"]))
    assert got == {i: n for i, n in per_doc.items() if n}


def drawn(spark, tmp_path, rows, shard_blocks):
    df = spark.createDataFrame(rows, SCHEMA)
    ws = Workspace(spark, "mixtest")
    return mixing.plan(ws, df, F.size(words_of(F.col("text"))), F.col("source"), F.xxhash64("doc_id", "text"), [F.col("doc_id").alias("doc_id")], shard_blocks=shard_blocks)


def test_counts_of_many_shards_are_a_draw_and_meet_the_totals(spark, tmp_path):
    rows = corpus()
    mix = drawn(spark, tmp_path, rows, 64)
    per_shard = max(64, 16 * mix.sources.count())
    sources = {r["sid"]: r for r in mix.sources.collect()}
    counts = {(r["shard"], r["sid"]): r["n"] for r in mixing.counts(mix).collect()}
    shards = sorted({k for k, _ in counts})
    assert len(shards) > 20 and shards == list(range(len(shards)))
    totals = {s: sum(n for (_, x), n in counts.items() if x == s) for s in sources}
    for s, r in sources.items():
        assert abs(totals[s] - r["target"] / mixing.BLOCK) <= 1.01
    everything = sum(totals.values())
    for k in shards[:-1]:
        assert sum(n for (x, _), n in counts.items() if x == k) == per_shard
    # Mean and variance of each source's counts against the multivariate hypergeometric law.
    for s in sources:
        p = totals[s] / everything
        if totals[s] < 200:
            continue
        found = [counts.get((k, s), 0) for k in shards[:-1]]
        mean = sum(found) / len(found)
        law = per_shard * p * (1 - p) * (everything - per_shard) / (everything - 1)
        variance = sum((x - per_shard * p) ** 2 for x in found) / len(found)
        assert abs(mean - per_shard * p) < 4 * (law / len(found)) ** 0.5 + 1 and 0.4 * law < variance < 2.2 * law
    # Brute force: the drawn blocks are 0 .. blocks - 1 again and again, each round a permutation.
    draws = mix.draws.collect()
    for s, r in sources.items():
        blocks = -(-r["source_size"] // mixing.BLOCK)
        mine = sorted((d["draw"], d["block"]) for d in draws if d["sid"] == s)
        assert [d for d, _ in mine] == list(range(len(mine))) and len(mine) <= 2 * blocks
        for a in range(0, len(mine), max(blocks, 1)):
            part = [b for _, b in mine[a : a + blocks]]
            assert len(set(part)) == len(part) and all(0 <= b < blocks for b in part)


def test_offsets_without_a_broadcast_are_the_same(spark, monkeypatch):
    df = spark.createDataFrame(corpus(), SCHEMA)
    usual = sorted(map(repr, mixing.mixed_words(df).collect()))
    monkeypatch.setattr(mixing, "BROADCAST_ROWS", 0)
    assert sorted(map(repr, mixing.mixed_words(df).collect())) == usual


def test_empty(spark):
    assert mixing.mixed_words(spark.createDataFrame([], SCHEMA)).collect() == []

import random

import pytest
from brute import components

from tallyforge.llm import minhash, shared

SCHEMA = "doc_id long, text string, node string, id string"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "x", "y") for i, t in rows], SCHEMA).repartition(3)


def result(df):
    return {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in df.collect()}


def corpus():
    rng = random.Random(5)
    vocabulary = [f"w{k}" for k in range(400)]
    rows = []
    for _ in range(12):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([30, 120, 400]))]
        for _ in range(8):
            copy = list(base)
            for _ in range(rng.randrange(0, 6)):
                copy[rng.randrange(len(copy))] = "edit%d" % rng.randrange(10**6)
            rows.append(" ".join(copy))
        rows.append(" ".join(base).upper())
    rows += [None, "", " \n\t", "one", "One", "two words", "a b c d", "a b c d e", "  a\vb c d e ", "x " * 60_000]
    rng.shuffle(rows)
    return list(enumerate(rows))


def test_components_match_brute_force(spark):
    rows = corpus()
    assert result(minhash.near_duplicates(frame(spark, rows))) == components(rows, 85)


def test_small_blocks_and_no_broadcast_lose_no_link(spark, monkeypatch):
    """Buckets of several blocks, texts joined by id: many components share buckets, as the texts share most of their words."""
    monkeypatch.setattr(minhash, "BLOCK", 2)
    monkeypatch.setattr(minhash, "BROADCAST_IDS", 0)
    rng = random.Random(12)
    base = [f"w{k}" for k in range(120)]
    rows = []
    for k in range(60):
        words = list(base)
        for _ in range(rng.randrange(0, 9)):
            words[rng.randrange(len(words))] = f"e{rng.randrange(40)}"
        rows.append((k, " ".join(words)))
    assert result(minhash.near_duplicates(frame(spark, rows))) == components(rows, 85)
    assert len({c for _, c, _ in components(rows, 85).values()}) > 3


def test_long_texts_and_words_are_hashed_in_pieces():
    import numpy as np
    import pyarrow as pa

    text = " ".join(f"w{k % 5000}x" for k in range(120_000)) + " " + "y" * 700_000 + " end of it all"
    signer = minhash.Signer(minhash.Plan())
    whole = [s for _, part in signer.sets(pa.array(["a b", text, "c"])) for s in part]
    words = text.split()
    hashes = {tuple(words[i : i + 5]) for i in range(len(words) - 4)}
    assert len(whole) == 3 and len(whole[1]) == len(hashes)
    again = next(signer.sets(pa.array(["", " \n" + text.upper()])))[1]
    again = again[1] if len(again) > 1 else [s for _, part in signer.sets(pa.array([" \n" + text.upper()])) for s in part][0]
    assert np.array_equal(whole[1], again)


def test_lower_threshold_matches_brute_force(spark):
    rows = corpus()
    assert result(minhash.near_duplicates(frame(spark, rows), minhash.Plan(percent=80, rows=7))) == components(rows, 80)


def test_chain_links_through_documents_that_are_not_alike(spark):
    words = [f"v{k}" for k in range(200)]
    rows = []
    for step in range(12):
        rows.append((step, " ".join(words[: 200 - 4 * step] + [f"new{step}x{k}" for k in range(0)])))
    assert result(minhash.near_duplicates(frame(spark, rows))) == components(rows, 85)


def test_empty_table(spark):
    assert minhash.near_duplicates(frame(spark, [])).collect() == []


def test_null_ids_and_repeated_rows(spark):
    text = " ".join(f"t{k}" for k in range(50))
    rows = [(None, text), (7, text), (7, text), (None, None), (3, "other words"), (None, "lonely words here")]
    out = sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["n_shingles"], r["component_id"], r["kept"]) for r in minhash.near_duplicates(frame(spark, rows)).collect() if r["n_shingles"] != 0 and r["component_id"] is not None)
    assert out == [(-1, 46, 7, False), (3, 1, 3, True), (7, 46, 7, True), (7, 46, 7, True)]
    assert minhash.near_duplicates(frame(spark, rows)).count() == len(rows)


def test_bands_miss_less_than_stated():
    for plan in (minhash.Plan(), minhash.Plan(percent=80, rows=7)):
        assert (1 - (plan.percent / 100) ** plan.rows) ** plan.bands <= plan.miss


def test_band_keys_are_shuffled_once_and_signatures_stay(spark, monkeypatch):
    """Without a small side to broadcast, as on large tables: one shuffle of keys and numbers, none of the nodes' signatures."""
    plans, write = {}, shared.Workspace.write

    def noted(ws, df, name):
        plans.setdefault(name, df._jdf.queryExecution().executedPlan().toString())
        return write(ws, df, name)

    monkeypatch.setattr(shared.Workspace, "write", noted)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = corpus()
        assert result(minhash.near_duplicates(frame(spark, rows))) == components(rows, 85)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert plans["buckets"].count("Exchange hashpartitioning") == 1
    assert "Exchange hashpartitioning" not in plans["near"]


@pytest.mark.parametrize("most", [0, 1000])
@pytest.mark.parametrize("kind", ["long", "int", "string"])
def test_among_keeps_the_chosen_values_alone(spark, most, kind):
    top = 2**31 - 1 if kind == "int" else 2**63 - 1
    values = [None, 0, 1, 63, 64, -1, -64, -65, 5, 5, top, -top - 1, top - 1, -top]
    chosen = [None, 1, 1, 64, -1, -65, 5, top, -top - 1, 77]
    df = spark.createDataFrame([(v, k) for k, v in enumerate(values)], "id long, at long").selectExpr(f"cast(id as {kind}) AS id", "at")
    ws = shared.Workspace(spark, "among")
    for want in (chosen, chosen[1:], []):
        picked = spark.createDataFrame([(v,) for v in want], "id long").selectExpr(f"cast(id as {kind}) AS id")
        out = shared.among(df, picked, "id", ws, most)
        assert out.schema == df.schema
        assert sorted(r["at"] for r in out.collect()) == [k for k, v in enumerate(values) if v in want]
    ws.clear()

import random

import numpy as np
from brute import contamination

from tallyforge.llm import fmindex


def docs_frame(spark, rows):
    return spark.createDataFrame([(i, t, "n") for i, t in rows], "doc_id long, text string, n_words string").repartition(3)


def items_frame(spark, rows):
    return spark.createDataFrame(rows, "item_id long, text string")


def corpus(seed=3):
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(12)] + ["É", "naïve", "x9"]
    items = [(k, " ".join(rng.choice(vocabulary) for _ in range(rng.choice([1, 3, 9, 10, 25])))) for k in range(30)]
    items += [(100, None), (101, "--- !"), (5, items[5][1])]
    docs = []
    for k in range(60):
        w = [rng.choice([*vocabulary, "out1", "out2"]) for _ in range(rng.randrange(0, 80))]
        if k % 3 == 0:
            w += items[rng.randrange(30)][1].split()
        docs.append((k, rng.choice([" ", ", ", "\n", "--"]).join(w).upper()))
    docs += [(200, None), (201, ""), (202, "w1 " * 50_000), (3, docs[3][1])]
    return docs, items


def test_matches_brute_force(spark, monkeypatch):
    docs, items = corpus()
    out = fmindex.contamination(docs_frame(spark, docs), items_frame(spark, items)).collect()
    assert sorted(map(tuple, out), key=repr) == contamination(docs, items)


def test_several_benchmark_blocks_and_small_shards(spark, monkeypatch):
    docs, items = corpus(9)
    monkeypatch.setattr(fmindex, "BLOCK_WORDS", 40)
    monkeypatch.setattr(fmindex, "SHARD_WORDS", 50)
    out = fmindex.contamination(docs_frame(spark, docs), items_frame(spark, items)).collect()
    assert sorted(map(tuple, out), key=repr) == contamination(docs, items)


def test_cut_leaves_clean_texts_alone(spark):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda"
    docs = [(1, f"Before, {item.upper()}! After."), (2, "Nothing to see: alpha beta."), (3, None)]
    out = dict(fmindex.decontaminate(docs_frame(spark, docs), items_frame(spark, [(1, item)])).select("doc_id", "text").collect())
    assert out == {1: "Before, ! After.", 2: "Nothing to see: alpha beta.", 3: None}


def test_empty_tables(spark):
    assert fmindex.contamination(docs_frame(spark, []), items_frame(spark, [(1, "a")])).collect() == []
    assert fmindex.contamination(docs_frame(spark, [(1, "a b")]), items_frame(spark, [])).first()["n_hit"] == 0


def test_suffix_array_orders_separators_by_position():
    rng = np.random.default_rng(1)
    for _ in range(20):
        text = np.concatenate([[0], rng.integers(0, 4, 200), [0]]).astype(np.int32)
        text[1:-1][::17] = 0
        keys = []
        for i in range(len(text)):
            j = i + int(np.argmax(text[i:] == 0))
            keys.append((*((int(x) + len(text), 0) for x in text[i:j]), (j, 0)))
        assert fmindex.suffix_array(text).tolist() == sorted(range(len(text)), key=keys.__getitem__)

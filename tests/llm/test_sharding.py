import zlib

import numpy as np
import pytest

from tallyforge.llm import sharding


@pytest.mark.parametrize("n", [1, 2, 3, 5, 7, 17, 100, 101, 4096, 99_991])
def test_feistel_is_a_permutation(n):
    out = sharding.Feistel(n)(np.arange(n))
    assert sorted(out.tolist()) == list(range(n))


def test_place_is_computable_without_data():
    f = sharding.Feistel(1000)
    at = f(np.arange(1000))
    assert all(f.place(i, 16) == (at[i] % 16, at[i] // 16) for i in (0, 1, 500, 999))


def check(rows, shards=16):
    counts = [sum(r["shard"] == s for r in rows) for s in range(shards)]
    assert sum(counts) == len(rows) and max(counts) - min(counts) <= 1
    for s in range(shards):
        assert sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(counts[s]))


def test_law_rows_and_reproducible(spark):
    data = [(i, f"text {i % 7}" if i % 5 else None, 1, "a") for i in range(333)] + [(5, "twice", 1, "b")] * 9 + [(None, "x", 0, "c"), (None, None, 0, "c")]
    df = spark.createDataFrame(data, "doc_id long, text string, slot int, part string")
    one = sharding.shard_index(df.repartition(5)).collect()
    two = sharding.shard_index(df.repartition(2)).collect()
    assert sorted(map(repr, one)) == sorted(map(repr, two))
    check(one)
    for r in one:
        assert r["law"] == "rows" and r["grown_shard"] is None
    texts = {(i, t) for i, t, _, _ in data}
    assert {(r["doc_id"], r["size"], r["text_crc32"]) for r in one} == {(i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in texts}


def test_whole_rows_keep_their_columns(spark):
    df = spark.createDataFrame([(i, "t" * i, i % 3) for i in range(50)], "doc_id long, text string, row int")
    out = sharding.sharded(df, 4)
    rows = out.collect()
    assert out.columns == ["doc_id", "text", "row", "shard", "slot"]
    assert sorted((r["doc_id"], r["text"], r["row"]) for r in rows) == sorted(map(tuple, df.collect()))
    check(rows, 4)


def test_empty(spark):
    assert sharding.shard_index(spark.createDataFrame([], "doc_id long, text string")).collect() == []

import random

from tallyforge.llm import cdc

SCHEMA = "doc_id long, text string, ends int"


def sentence(rng, n):
    return " ".join("".join(rng.choice("abcdefghijklmnoprstuvé") for _ in range(rng.randrange(2, 9))) for _ in range(n))


def test_shared_passages_are_found_at_any_offset_and_clean_texts_left_alone(spark):
    rng = random.Random(8)
    rows, expected = [], {}
    for k in range(60):
        passage = sentence(rng, 51)
        for _ in range(2):
            i = len(rows)
            rows.append((i, f"{sentence(rng, rng.randrange(1, 60))}{rng.choice([' ', chr(10)])}{passage} {sentence(rng, rng.randrange(1, 60))}", 0))
        expected[len(rows) - 1] = len(rows) - 2
    clean = [(1000 + k, sentence(rng, 150), 0) for k in range(30)]
    shared = sentence(rng, 8)
    clean += [(2000 + k, f"{sentence(rng, 30)} {shared} {sentence(rng, 30)}", 0) for k in range(10)]
    odd = [(None, rows[0][1], 0), (3000, None, 0), (3001, "", 0), (3002, "x", 0), (3003, "a" * 200_000, 0), (3004, clean[0][1] * 2, 0), (3005, "own " * 400, 0), (7, rows[7][1], 0)]
    out = cdc.repeated_passages(spark.createDataFrame(rows + clean + odd, SCHEMA).repartition(5)).collect()
    assert len(out) == len(rows + clean + odd)
    got = {r["doc_id"]: r for r in out}
    for i, first in expected.items():
        assert got[i]["first_ids"] == [first] and got[i]["removed_bytes"] >= cdc.MIN_BYTES
        assert not got[first]["spans"]
    assert not any(got[i]["spans"] for i, *_ in clean)
    assert got[None]["first_ids"] == [0] and got[3004]["first_ids"] == [1000]
    assert all(got[i]["n_chunks"] == 0 for i in (3000, 3001)) and not got[3003]["spans"] and not got[3005]["spans"]
    texts = {i: t for i, t, _ in rows}
    for i, first in expected.items():
        for a, b in got[i]["spans"]:
            assert texts[i].encode()[a:b] in texts[first].encode()


def test_cuts_hang_on_nearby_bytes_alone():
    import pyarrow as pa

    rng = random.Random(3)
    text = sentence(rng, 400)
    chunker = cdc.Chunker()

    def pieces(*texts):
        out = []
        for i, j, digests, ends in chunker.chunk(pa.array(texts)):
            out += [set(d) for d in digests.to_pylist()]
        return out

    alone, after, moved = pieces(text)[0], pieces("other row", text)[1], pieces("inserted " + text)[0]
    assert alone == after
    assert len(alone - moved) <= 4


def test_without_spans_drops_half_characters():
    assert cdc.without_spans("aéb", [(2, 3)]) == "ab" and cdc.without_spans(None, []) is None


def test_passages_of_fifty_short_words_are_found_whole(spark):
    rng = random.Random(11)
    common = "a an as at be by do go he i if in is it me my no of on or so to up us we the and for are but not you all can had her was one our out day get has him his how man new now old see two way who boy did its let put say she too use".split()
    rows, passages = [], []
    for k in range(200):
        passage = " ".join(rng.choice(common) for _ in range(rng.choice([50, 51, 55, 60])))
        passages.append(passage.encode())
        rows += [(2 * k + d, f"{sentence(rng, rng.randrange(30, 60))} {passage} {sentence(rng, rng.randrange(30, 60))}", 0) for d in range(2)]
    short = " ".join(rng.choice(common) for _ in range(49))
    rows += [(1000 + k, f"{sentence(rng, 40)} {short} {sentence(rng, 40)}", 0) for k in range(2)]
    got = {r["doc_id"]: r for r in cdc.repeated_passages(spark.createDataFrame(rows, SCHEMA).repartition(5)).collect()}
    for k, passage in enumerate(passages):
        at = rows[2 * k + 1][1].encode().index(passage)
        assert any(a <= at and at + len(passage) <= b for a, b in got[2 * k + 1]["spans"])
        assert got[2 * k + 1]["first_ids"] == [2 * k] and not got[2 * k]["spans"]
    assert not got[1000]["spans"]

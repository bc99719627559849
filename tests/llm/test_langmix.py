import random
import zlib

from tallyforge.llm import langmix

LANGS = {"aa": "ka lo mi tur pas", "bb": "shree vond quill zarg thox", "cc": "éla ôno üri ça ñu"}


def text(rng, lang, n):
    return " ".join("".join(rng.choice(LANGS[lang].split()) for _ in range(rng.randrange(1, 4))) for _ in range(n)) + "."


def test_held_out_languages_and_odd_texts(spark):
    rng = random.Random(1)
    rows = [(i, text(rng, lang := rng.choice(list(LANGS)), rng.randrange(5, 80)), lang, 0.5) for i in range(240)]
    truth = {i: lang for i, _, lang, _ in rows}
    odd = [(900, None, "aa", 0.5), (901, "12 34 !?", "bb", 0.5), (902, "", None, 0.5), (None, rows[0][1], "zz", 0.5), (903, text(rng, "aa", 300).upper(), None, 0.5), (904, text(rng, "bb", 20_000), None, 0.5)]
    mixed = [(950, text(rng, "aa", 60) + " " + text(rng, "bb", 40), None, 0.5)]
    df = spark.createDataFrame(rows + odd + mixed + [rows[5]] * 2, "doc_id long, text string, lang string, share double").repartition(4)
    out = {r["doc_id"]: r for r in langmix.identify(df).collect()}
    assert len(out) == 240 + 5 + 1 + 1
    for i, lang in truth.items():
        assert out[i]["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1)
        assert out[i]["lang_pred"] == lang and 0 < out[i]["score"] <= 1
    assert [out[i]["lang_pred"] for i in (900, 901, 902)] == ["und"] * 3 and out[900]["score"] == 0
    assert out[None]["held_out"] is False and out[None]["lang_pred"] != "zz"
    assert out[903]["lang_pred"] == "aa" and out[904]["lang_pred"] == "bb"
    shares = {m["lang"]: m["share"] for m in out[950]["mixture"]}
    assert set(shares) == {"aa", "bb"} and abs(shares["aa"] - 0.6) < 0.06


def test_nothing_to_learn_from(spark):
    df = spark.createDataFrame([(1, "some words", None), (2, None, None)], "doc_id long, text string, lang string")
    assert {r["lang_pred"] for r in langmix.identify(df).collect()} == {"und"}
    assert langmix.identify(df.where("false")).collect() == []

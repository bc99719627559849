import random

from brute import statistics

from tallyforge.llm import decisionlist

NAMES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def texts():
    rng = random.Random(4)
    out = [None, "", " ", "one", "a b c", "a b c a b c", "a a a a", "#x# $ %\n#x# $ %\n\n \nlast", "é ü\né ü", "x\x0by\x0cz\r\n", "q " * 30_000]
    for _ in range(150):
        out.append(rng.choice([" ", "\n", "  "]).join(rng.choice(["the", "of", "a", "to", "in#", "word", "other"]) for _ in range(rng.randrange(0, 120))))
    return out


def test_statistics_match_brute_force(spark):
    rows = list(enumerate(texts()))
    df = spark.createDataFrame([(i, t, 3) for i, t in rows], "doc_id long, text string, extra int")
    out = {r["doc_id"]: tuple(r[n] for n in NAMES) for r in decisionlist.statistics(df).collect()}
    assert out == {i: statistics(t) for i, t in rows}


def test_statistics_are_exact_where_hashes_collide(spark):
    rows = [(i, t) for i, t in enumerate(texts()) if len(t or "") < 10_000]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = {r["doc_id"]: tuple(r[n] for n in NAMES) for r in decisionlist.statistics(df, mask=3).collect()}
    assert out == {i: statistics(t) for i, t in rows}


def labelled(spark, n=1500):
    rng = random.Random(6)
    docs, labels = [], []
    for i in range(n):
        bad = i % 4 == 0
        vocabulary = [f"word{k}" for k in range(3000)]
        w = [rng.choice(vocabulary) + ("##" if bad and rng.random() < 0.5 else "") for _ in range(rng.randrange(60, 90))]
        docs.append((i, " ".join(w)))
        if i % 3:
            labels.append((i, 0 if bad else 1))
    return docs, labels


def test_learned_rules_reject_the_bad_and_keep_the_clean(spark):
    docs, labels = labelled(spark)
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    marks = spark.createDataFrame(labels + [(None, 0), (5, None)], "doc_id long, quality int")
    out = {r["doc_id"]: r["kept"] for r in decisionlist.judge(frame, marks).collect()}
    assert len(out) == len(docs)
    right = sum(out[i] == (i % 4 != 0) for i in out)
    assert right >= 0.98 * len(out)
    rules = decisionlist.learn(decisionlist.statistics(frame), marks)
    assert rules.rules and all(c.feature in decisionlist.FEATURES for r in rules.rules for c in r)


def test_without_labels_only_the_base_rules_reject(spark):
    frame = spark.createDataFrame([(1, "few words"), (2, " ".join(f"w{k}" for k in range(60))), (3, None), (4, "a b " * 40)], "doc_id long, text string")
    marks = spark.createDataFrame([], "doc_id long, quality int")
    out = {r["doc_id"]: (r["base_failed"], r["kept"]) for r in decisionlist.judge(frame, marks).collect()}
    assert out == {1: (True, False), 2: (False, True), 3: (True, False), 4: (True, False)}


def test_empty(spark):
    marks = spark.createDataFrame([], "doc_id long, quality int")
    assert decisionlist.judge(spark.createDataFrame([], "doc_id long, text string"), marks).collect() == []

import math
import random
import re
from collections import Counter

from pyspark.sql import functions as F

from tallyforge.llm import licenses as L


def cosine(text):
    idf, unit, other = L.weights()
    tf = Counter(re.findall(L.TOKEN, text.lower()))
    norm = math.sqrt(sum((n * idf.get(t, other)) ** 2 for t, n in tf.items()))
    scores = {name: round(sum(n * idf[t] * unit.get((name, t), 0) for t, n in tf.items() if t in idf) / norm, 6) if norm else 0 for name in L.TEMPLATES}
    said = {t for t in tf if re.match(L.VERSION, t)}
    scores |= {n: 0.0 for n in scores if said and (own := set(L.versions(L.TEMPLATES[n]))) and not own & said}
    name, score = min(scores.items(), key=lambda x: (-x[1], x[0]))
    return name, score, round(score - max(v for n, v in scores.items() if n != name), 6)


def test_headers_files_and_inheritance(spark):
    body = " ".join(f"word{k}" for k in range(80))
    rows = [
        ("a/LICENSE.txt", "Released under the MIT License."), ("a/x.txt", body), ("a/b/y.txt", body), ("a/b/c/z.txt", f"{body}\n# Licensed under the Apache License, Version 2.0.\n{body}"),
        ("a/b/COPYING", "This work is licensed under the GNU General Public License, version 3.\nThanks."), ("a/b/c/w.txt", None), ("q/r.txt", ""), ("top.txt", body), (None, "All rights reserved."),
        ("q/cc.txt", "Licensed under CC BY-NC 4.0.\n" + "pad " * 200), ("q/said.txt", "he was licensed once"), ("a/x.txt", body), ("a2/x.txt", body),
    ]
    df = spark.createDataFrame([(p, t, 1) for p, t in rows], "path string, text string, license_rank int")
    out = L.scan(df)
    got = {}
    for r in out.collect():
        got.setdefault(r["path"], r)
    assert out.count() == len(rows)
    view = {p: (r["license"], r["effective_license"], r["inherited_from"], r["is_license_file"]) for p, r in got.items()}
    assert view["a/LICENSE.txt"] == ("MIT", "MIT", None, True)
    assert view["a/x.txt"] == (None, "MIT", "a", False)
    assert view["a/b/y.txt"] == view["a/b/c/w.txt"] == (None, "GPL-3.0", "a/b", False)
    assert view["a/b/c/z.txt"] == ("Apache-2.0", "Apache-2.0", None, False)
    assert view["q/cc.txt"][0] == "CC-BY-NC-4.0" and view["q/said.txt"][0] is None
    assert view["q/r.txt"] == view["top.txt"] == view["a2/x.txt"] == (None, None, None, False)
    assert view[None][:2] == ("Proprietary", "Proprietary")
    for p, t in rows:
        if p in ("a/b/COPYING", "a/LICENSE.txt"):
            assert (got[p]["license"], got[p]["score"]) == cosine(t)[:2]


def test_empty(spark):
    assert L.scan(spark.createDataFrame([], "path string, text string")).collect() == []


def test_lines_and_files_without_a_listed_word_are_scored(spark):
    said = ["Redistribution and use in source and binary forms, with or without", "Redistribution and use in source and binary forms are permitted", "Dedicated to the public domain.", "This work is dedicated to the public domain."]
    rows = [(f"d{k}/x{e}", text) for k, line in enumerate(said) for e, text in enumerate([line, f"{line}\n" + "pad " * 200])]
    got = {r["path"]: r for r in L.scan(spark.createDataFrame(rows, "path string, text string")).collect()}
    for k, line in enumerate(said):
        for e in range(2):
            r = got[f"d{k}/x{e}"]
            assert (r["license"], r["score"], r["n_headers"], r["is_license_file"]) == (*cosine(line)[:2], 1, e == 0)


def test_files_that_are_left_out_cannot_reach_the_limit(spark):
    """The bound of every subset of a template's tokens holds for its cosine, and a file at the limit is never left out."""
    rng = random.Random(3)
    scorer = L.Scorer(spark, L.TEMPLATES, 1.0, True)
    vocabulary = sorted({t for _, t in L.weights()[1]})
    rows = []
    for k in range(400):
        tokens = [rng.choice(vocabulary) for _ in range(rng.randrange(1, 14))] + [f"w{x}" for x in range(rng.randrange(0, 12))]
        rows.append((k, " ".join(tokens)))
    df = spark.createDataFrame(rows, "k long, text string").withColumn("tokens", L.tokens(F.col("text")))
    for least in (L.HEADER_COSINE, L.FILE_COSINE):
        passed = {r["k"] for r in scorer.reaches(df, "tokens", least, "ok").where("ok").collect()}
        likely = {r["k"] for r in scorer.likely(df.select("k", "tokens"), least).collect()}
        assert {k for k, text in rows if cosine(text)[1] >= least} <= likely <= passed and len(likely) < len(passed) < len(rows)


def test_scores_match_brute_force(spark):
    rng = random.Random(5)
    scorer = L.Scorer(spark, L.TEMPLATES, 1.0, True)
    rows = [(k, " ".join(rng.sample(text.split(), rng.randrange(2, len(text.split()) + 1)) + ["pad"] * rng.randrange(3))) for k, text in enumerate(list(L.TEMPLATES.values()) * 12)]
    rows += [(len(rows), ""), (len(rows) + 1, "nothing here")]
    df = spark.createDataFrame(rows, "k long, text string").select("k", L.tokens(F.col("text")).alias("tokens"))
    got = {r["k"]: (r["license"], r["score"]) for r in scorer.scored(df, L.HEADER_COSINE).collect()}
    assert len(got) == len(rows)
    for k, text in rows:
        name, score, lead = cosine(text)
        assert got[k] == ((name, score) if score >= L.HEADER_COSINE and lead >= L.MARGIN else (None, None))


def test_names_and_versions_are_told_apart(spark):
    said = {
        "Eclipse Public License, Version 2.0": "EPL-2.0", "ISC License": "ISC", "GNU Lesser General Public License, version 2.1": "LGPL-2.1", "GNU Lesser General Public License, version 3": "LGPL-3.0",
        "This work is licensed under the GNU General Public License, version 2.": "GPL-2.0", "This work is licensed under the GNU General Public License.": None, "MIT License": "MIT",
        "This work is licensed under the GNU General Public License, version 7.": None,
    }
    body = " ".join(f"word{k}" for k in range(80))
    rows = [(f"d{k}/x.txt", f"{line}\n{body}") for k, line in enumerate(said)]
    got = {r["path"]: r["license"] for r in L.scan(spark.createDataFrame(rows, "path string, text string")).collect()}
    assert [got[f"d{k}/x.txt"] for k in range(len(said))] == list(said.values())


def test_clashing_names_and_a_flat_directory(spark):
    rows = [(k, "flat/LICENSE" if k == 7 else f"flat/{k}", "Released under the MIT License." if k == 7 else "x", "theirs", k, 0.5) for k in range(300)]
    out = L.scan(spark.createDataFrame(rows, "uid long, path string, text string, directory string, n_headers long, score double"))
    assert out.columns == ["uid", "path", "directory", "n_headers", "score", "_n_headers", "license", "_score", "is_license_file", "effective_license", "inherited_from"]
    got = out.collect()
    assert len(got) == 300 and all(r["directory"] == "theirs" and r["n_headers"] == r["uid"] and r["effective_license"] == "MIT" for r in got)


def test_licence_texts_and_header_blocks(spark):
    texts, body = L.texts(), " ".join(f"word{k}" for k in range(80))
    rows = [(f"{name}/LICENSE", text) for name, text in texts.items() if "header" not in name]
    rows += [(f"{name}/x.txt", body) for name in texts if "header" not in name]
    notice = "\n".join(f"# {line}" for line in L.BLOCKS["GPL-3.0"].split("\n"))
    rows += [("gpl/a.py", f"# Copyright 2020 Foo Inc.\n#\n{notice}\n\nimport os\n{body}\n")]
    rows += [("apache/b.c", "/*\n" + "\n".join(f" * {line}" for line in L.BLOCKS["Apache-2.0"].split("\n")) + f"\n */\n{body}\n{body}")]
    rows += [("prose/c.txt", "the of and to in a is that it was for on as with his they at be this from " * 300)]
    rows += [("prose/d.txt", "The the of.")]
    got = {r["path"]: r for r in L.scan(spark.createDataFrame(rows, "path string, text string")).collect()}
    for name in (n for n in texts if "header" not in n):
        assert got[f"{name}/LICENSE"]["is_license_file"] and got[f"{name}/LICENSE"]["license"] == name
        assert (got[f"{name}/x.txt"]["effective_license"], got[f"{name}/x.txt"]["inherited_from"]) == (name, name)
    assert (got["gpl/a.py"]["license"], got["apache/b.c"]["license"], got["prose/c.txt"]["license"]) == ("GPL-3.0", "Apache-2.0", None)

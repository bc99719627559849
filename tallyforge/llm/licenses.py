"""Licence scan: TF-IDF cosine of header lines and licence files to templates, and inheritance along directories.

DataFrame expressions only. A file is cut into tokens once; the tokens that templates know bound its cosine to each of
them (a text that shares the set S of a template's tokens has at most the norm of the template's weights in S), so most
files are done with that. Lines, blocks and texts of the others that counts of known and unknown tokens leave are scored
within their rows: sorted tokens, run lengths, and a table of the templates' weights that is part of the plan; no token
is ever shuffled. A file without
a licence of its own takes that of the nearest directory above it with a licence file.
"""

from __future__ import annotations

import json
import math
from collections import Counter
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import Workspace, ascii_lower, fresh

# Short statements of well-known licences.
TEMPLATES = {
    "AGPL-3.0": "This program is licensed under the GNU Affero General Public License, version 3.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "BSD-3-Clause": "Redistribution and use in source and binary forms are permitted under the BSD 3-Clause License.",
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "CC0-1.0": "Dedicated to the public domain under CC0 1.0.",
    "EPL-2.0": "This program is licensed under the Eclipse Public License, version 2.0.",
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "ISC": "Released under the ISC License.",
    "LGPL-2.1": "This library is licensed under the GNU Lesser General Public License, version 2.1.",
    "LGPL-3.0": "This library is licensed under the GNU Lesser General Public License, version 3.",
    "MIT": "Released under the MIT License.",
    "MPL-2.0": "This file is subject to the terms of the Mozilla Public License, version 2.0.",
    "Proprietary": "All rights reserved.",
}
_GNU = """This {0} is free software: you can redistribute it and/or modify it under the terms of the GNU {1} General Public License as published by
the Free Software Foundation, either version {2} of the License, or (at your option) any later version. This {0} is distributed in the hope that it
will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {1}
General Public License for more details. You should have received a copy of the GNU {1} General Public License along with this {0}. If not, see
<https://www.gnu.org/licenses/>."""
#: Standard header blocks, scored against joined blocks of lines; whole texts are in licence_texts.
BLOCKS = {
    "AGPL-3.0": _GNU.format("program", "Affero", 3),
    "Apache-2.0": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may
obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the
License for the specific language governing permissions and limitations under the License.""",
    "GPL-2.0": _GNU.format("program", "", 2),
    "GPL-3.0": _GNU.format("program", "", 3),
    "LGPL-3.0": _GNU.format("library", "Lesser", 3),
    "MPL-2.0": """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this
file, You can obtain one at https://mozilla.org/MPL/2.0/.""",
}
HEADER_COSINE = 0.6
FILE_COSINE = 0.5
#: The best statement must lead the next licence by so much; else the text names none of them.
MARGIN = 0.06
TOKEN = r"[a-z0-9]+(?:\.[0-9]+)*"
#: Successive lines of comment.
COMMENT = r"(?m)(?:^[ \t]*(?:#|//|/?\*|--|;|%)[^\n]*(?:\n|$))+"
#: Empty lines, between which a block stands.
GAP = r"\n[ \t\r]*\n"
#: Tokens that can be a version: no years. A text with versions, none of them a template's own, is not that template's.
VERSION = r"^[0-9]{1,2}(?:\.[0-9]+)*$"


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(ascii_lower(text), F.lit(TOKEN), F.lit(0))


def texts() -> dict[str, str]:
    """Whole licence texts, and header blocks as `<license> header`."""
    whole = {p.stem: p.read_text("utf-8") for p in sorted((Path(__file__).parent / "licence_texts").glob("*.txt"))}
    return whole | {f"{name} header": text for name, text in BLOCKS.items()}


def weights(templates: dict[str, str] = TEMPLATES, least: float = 1.0) -> tuple[dict[str, float], dict[tuple[str, str], float], float]:
    """idf of the templates' tokens, unit TF-IDF weight of (template, token), and the idf of all other tokens.

    least is the idf of a token of all templates; 0 for whole texts, which common words would make alike.
    """
    import re

    counts = {name: Counter(re.findall(TOKEN, text.lower())) for name, text in templates.items()}
    n = len(counts)
    df = Counter(t for c in counts.values() for t in c)
    idf = {t: math.log((1 + n) / (1 + k)) + least for t, k in df.items()}
    unit = {}
    for name, c in counts.items():
        norm = math.sqrt(sum((k * idf[t]) ** 2 for t, k in c.items()))
        unit |= {(name, t): k * idf[t] / norm for t, k in c.items()}
    return idf, unit, math.log(1 + n) + least


def versions(text: str) -> list[str]:
    import re

    return sorted({t for t in re.findall(TOKEN, text.lower()) if re.match(VERSION, t)})


class Scorer:
    """Expressions that score token arrays against a set of templates. Statements tell versions apart, whole texts hold
    numbers of all kinds and do not."""

    def __init__(self, spark: SparkSession, templates: dict[str, str], least: float, told_apart: bool):
        idf, unit, self.other = weights(templates, least)
        self.names = sorted({n for n, _ in unit})
        self.size = 1 << max(4, (2 * len(idf)).bit_length())
        place = {n: k for k, n in enumerate(self.names)}
        by_token: dict[str, list] = {t: [] for t in idf}
        for (n, t), v in unit.items():
            by_token[t].append({"k": place[n], "v": v})
        slots = spark.createDataFrame([(t,) for t in idf], "t string").select("t", F.pmod(F.xxhash64("t"), F.lit(self.size)).alias("h")).collect()  # the templates' vocabulary
        table: list[list] = [[] for _ in range(self.size)]
        for r in slots:
            table[r["h"]].append({"t": r["t"], "i": idf[r["t"]], "m": max(e["v"] ** 2 for e in by_token[r["t"]]), "w": by_token[r["t"]]})
        self.table = F.from_json(F.lit(json.dumps(table)), "array<array<struct<t:string,i:double,m:double,w:array<struct<k:int,v:double>>>>>")
        self.vocabulary = F.split(F.lit(" ".join(sorted(idf))), " ")
        self.margin = MARGIN if told_apart else 0.0
        self.versions = [versions(templates[n]) if told_apart else [] for n in self.names]

    def _entry(self, token: Column) -> Column:
        """The templates' entry of a token, null for others: a hash table lookup."""
        return F.get(F.filter(F.get(self.table, F.pmod(F.xxhash64(token), F.lit(self.size)).cast("int")), lambda x: x["t"] == token), F.lit(0))

    def reaches(self, df: DataFrame, tokens_col: str, least: float, out: str, words: str | None = None) -> DataFrame:
        """Adds whether any text of these tokens can reach the cosine for a template; words: a column of their distinct
        tokens in a larger vocabulary, if there is one already.

        Most texts fail already by the sum of the largest weights of their tokens in any template."""
        known, shared = fresh(df, "known", "shared")
        limit = (least - 1e-5) ** 2
        df = df.withColumn(known, F.filter(F.transform(self._words(tokens_col, words), self._entry), lambda x: x.isNotNull()))
        some = F.aggregate(known, F.lit(0.0), lambda a, x: a + x["m"]) >= limit
        df = df.withColumn(shared, F.when(some, F.flatten(F.transform(known, lambda x: x["w"]))).otherwise(F.array().cast("array<struct<k:int,v:double>>")))
        mass = lambda k: F.aggregate(F.filter(shared, lambda e: e["k"] == k), F.lit(0.0), lambda a, e: a + e["v"] * e["v"])
        reach = F.exists(F.sequence(F.lit(0), F.lit(len(self.names) - 1)), lambda k: mass(k) >= limit)
        return df.withColumn(out, (F.size(shared) > 0) & reach).drop(known, shared)

    def _runs(self, df: DataFrame, tokens_col: str, ends: str, runs: str) -> DataFrame:
        """Adds runs: (tf, x) of each distinct token, x its entry; tokens_col must be sorted."""
        s, n = tokens_col, F.size(tokens_col)
        places = F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))
        df = df.withColumn(ends, F.filter(places, lambda i: (i == n) | (F.get(s, i - 1) != F.get(s, i))))
        run = lambda e, j: F.struct((e - F.coalesce(F.get(ends, j - 1), F.lit(0))).alias("tf"), self._entry(F.get(s, e - 1)).alias("x"))
        return df.withColumn(runs, F.transform(ends, run))

    def _weight(self, run: Column) -> Column:
        return run["tf"] * F.coalesce(run["x"]["i"], F.lit(self.other))

    def _parts(self, runs: Column, more: Column) -> Column:
        """(norm, w): the norm of runs and of `more`, the square of the rest's; products (k, v) of the templates' tokens."""
        norm = F.sqrt(F.aggregate(runs, F.lit(0.0), lambda a, h: a + self._weight(h) * self._weight(h)) + more)
        known = F.filter(runs, lambda h: h["x"].isNotNull())
        shares = F.flatten(F.transform(known, lambda h: F.transform(h["x"]["w"], lambda w: F.struct(w["k"].alias("k"), (self._weight(h) * w["v"]).alias("v")))))
        return F.struct(F.greatest(norm, F.lit(1e-9)).alias("norm"), shares.alias("w"))

    @staticmethod
    def _dot(parts: str, k) -> Column:
        return F.aggregate(F.filter(F.col(parts)["w"], lambda e: e["k"] == k), F.lit(0.0), lambda a, e: a + e["v"])

    def _words(self, tokens_col: str, words: str | None) -> Column:
        return F.array_intersect(tokens_col, self.vocabulary) if words is None else F.col(words)

    def may_reach(self, df: DataFrame, tokens_col: str, least: float, out: str, words: str | None = None) -> DataFrame:
        """Adds whether these tokens can reach the cosine for a template: exact, but for unknown tokens, which count once each.

        Counts are taken for texts alone that reaches() leaves."""
        sound, runs, rest, parts = fresh(df, "sound", "runs", "rest", "parts")
        df = self.reaches(df, tokens_col, least, sound, words)
        count = lambda t: F.size(tokens_col) - F.size(F.array_remove(tokens_col, t))
        known = F.when(F.col(sound), F.filter(self._words(tokens_col, words), lambda t: self._entry(t).isNotNull())).otherwise(F.array().cast("array<string>"))
        df = df.withColumn(runs, F.transform(known, lambda t: F.struct(count(t).alias("tf"), self._entry(t).alias("x"))))
        df = df.withColumn(rest, F.when(F.col(sound), (F.size(F.array_distinct(tokens_col)) - F.size(runs)) * self.other * self.other).otherwise(0.0))
        df = df.withColumn(parts, self._parts(F.col(runs), F.col(rest)))
        reach = F.exists(F.sequence(F.lit(0), F.lit(len(self.names) - 1)), lambda k: self._dot(parts, k) >= (least - 1e-5) * F.col(parts)["norm"])
        return df.withColumn(out, (F.size(F.col(parts)["w"]) > 0) & reach).drop(sound, runs, rest, parts)

    def likely(self, units: DataFrame, least: float) -> DataFrame:
        """The units (..., tokens) that may reach the cosine. An explode drops the others: a filter would be moved below."""
        keys = [c for c in units.columns if c != "tokens"]
        (ok,) = fresh(units, "ok")
        df = self.may_reach(units, "tokens", least, ok)
        return df.select(*keys, F.explode(F.when(F.col(ok), F.array("tokens")).otherwise(F.array().cast("array<array<string>>"))).alias("tokens"))

    def scored(self, units: DataFrame, least: float) -> DataFrame:
        """units (..., tokens) with license and score of the best template, nulls where it doesn't reach `least` or lead.

        Nothing is filtered here: Spark would move a filter below these columns and compute them within it, again and again."""
        keys = [c for c in units.columns if c != "tokens"]
        s, ends, runs, parts, scores = fresh(units, "s", "ends", "runs", "parts", "scores")
        df = self._runs(units.withColumn(s, F.sort_array("tokens")).drop("tokens"), s, ends, runs)
        df = df.withColumn(parts, self._parts(F.col(runs), F.lit(0.0)))
        said = F.filter(F.array_distinct(s), lambda t: t.rlike(VERSION))

        def score(k: int) -> Column:
            value = F.round(self._dot(parts, k) / F.col(parts)["norm"], 6)
            if self.versions[k]:
                own = F.array(*map(F.lit, self.versions[k]))
                value = F.when((F.size(said) == 0) | F.arrays_overlap(said, own), value).otherwise(0.0)
            return F.struct((-value).alias("score"), F.lit(self.names[k].removesuffix(" header")).alias("license"))

        df = df.withColumn(scores, F.array_sort(F.array(*(score(k) for k in range(len(self.names))))))
        first = F.get(scores, F.lit(0))
        after = F.get(F.filter(scores, lambda x: x["license"] != first["license"]), F.lit(0))
        leads = F.round(-first["score"] + F.coalesce(after["score"], F.lit(0.0)), 6) >= self.margin
        named = F.when((-first["score"] >= least) & leads, F.struct(first["license"].alias("license"), (-first["score"]).alias("score")))
        return df.withColumn(s, named).select(*keys, F.col(s)["license"].alias("license"), F.col(s)["score"].alias("score"))


def parents(directory: Column) -> Column:
    """The directory itself and those above it up to '', as (depth, directory)."""
    steps = F.split(directory, "/")
    n = F.when(directory == "", 0).otherwise(F.size(steps))
    return F.transform(F.sequence(F.lit(0), n), lambda k: F.struct(k.alias("depth"), F.array_join(F.slice(steps, 1, k), "/").alias("directory")))


def scan(files: DataFrame) -> DataFrame:
    """files (path, text and others) with n_headers, license, score, is_license_file, effective_license, inherited_from.

    A header is a line whose cosine to a statement reaches HEADER_COSINE, or a block (lines of comment, or lines between
    empty ones) whose cosine to a licence text does, where no line in the file is one; the best one (ties: the first) is
    the file's licence. A file whose whole text reaches FILE_COSINE to a statement, else to a licence text, is a licence
    file and speaks for its directory (best score, then first path). A text between two licences (MARGIN), or whose
    version is another one, names none. Files without a licence inherit from the nearest directory that has one. Null
    texts have no licence of their own; a null path has no directory and inherits nothing. Repeated rows keep their own
    rows; other columns are carried. If files has columns of the new names, the new ones take underscores in front.
    """
    spark = files.sparkSession
    ws = Workspace(spark, "licenses")
    short, long = Scorer(spark, TEMPLATES, 1.0, True), Scorer(spark, texts(), 0.0, False)
    uid, directory, toks, near, held = fresh(files, "uid", "directory", "tokens", "near", "held")
    flags = fresh(files, "in_line", "in_file", "in_block", "in_text")
    names = fresh(files.drop("text"), "n_headers", "license", "score", "is_license_file", "effective_license", "inherited_from")

    # One pass over all texts; rows and their numbers are written, texts only where something may be found in them.
    rows = files.withColumn(uid, F.monotonically_increasing_id()).withColumn(directory, F.regexp_extract("path", r"(?s)^(?:(.*)/)?[^/]*$", 1))
    rows = rows.withColumn(toks, tokens(F.coalesce(F.col("text"), F.lit(""))))
    (words,) = fresh(rows, "words")
    rows = rows.withColumn(words, F.array_intersect(toks, F.array_union(short.vocabulary, long.vocabulary)))  # of either set of templates, once
    rows = short.may_reach(short.reaches(rows, toks, HEADER_COSINE, flags[0], words), toks, FILE_COSINE, flags[1], words)
    rows = long.may_reach(long.reaches(rows, toks, HEADER_COSINE, flags[2], words), toks, FILE_COSINE, flags[3], words)
    some = F.col(flags[0]) | F.col(flags[1]) | F.col(flags[2]) | F.col(flags[3])
    rows = ws.write(rows.withColumn(held, F.when(some, F.col("text"))).drop("text", toks, words), "rows")
    hits = rows.where(F.col(held).isNotNull()).select(F.col(uid).alias("uid"), F.col(held).alias("text"), *(F.col(f).alias(n) for f, n in zip(flags, ("in_line", "in_file", "in_block", "in_text"), strict=True)))

    def units(flag: str, content: Column) -> DataFrame:
        out = hits.where(flag).select("uid", F.posexplode(content).alias("line", "content"))
        return out.select("uid", "line", tokens(F.col("content")).alias("tokens"))

    def best(scorer: Scorer, flag: str, content: Column, least: float, n: str, name: str) -> DataFrame:
        """Of each file the number of units that reach the limit and the best one."""
        found = scorer.scored(scorer.likely(units(flag, content), least), least)
        first = F.min_by(F.struct("license", "score"), F.when(F.col("license").isNotNull(), F.struct(-F.col("score"), "line")))
        return ws.write(found.groupBy("uid").agg(F.count("license").alias(n), first.alias(name)).where(F.col(n) > 0), name)

    blocks = F.concat(F.regexp_extract_all("text", F.lit(COMMENT), F.lit(0)), F.split("text", GAP, -1))
    own = best(short, "in_line", F.split("text", "\n", -1), HEADER_COSINE, "n_headers", "own")
    whole = best(short, "in_file", F.array("text"), FILE_COSINE, "n_whole", "file")
    block = best(long, "in_block", blocks, HEADER_COSINE, "n_blocks", "block")
    entire = best(long, "in_text", F.array("text"), FILE_COSINE, "n_entire", "entire")
    found = own.join(block, "uid", "full_outer").join(whole, "uid", "full_outer").join(entire, "uid", "full_outer")
    count = F.coalesce("n_headers", F.when(F.col("block").isNotNull(), F.lit(1).cast("long")), F.lit(0).cast("long"))
    found = found.select(F.col("uid").alias(uid), F.struct(count.alias("n"), F.coalesce("own", "block").alias("own"), F.coalesce("file", "entire").alias("file")).alias(held))
    rows = ws.write(rows.drop(held, *flags).join(found, uid, "left"), "found")

    file, mine = F.col(held)["file"], F.coalesce(F.col(held)["file"]["license"], F.col(held)["own"]["license"])
    speaks = F.min_by(file["license"], F.struct(-file["score"], "path"))
    licensed = rows.where(file.isNotNull() & F.col(directory).isNotNull()).groupBy(F.col(directory).alias("above")).agg(speaks.alias("dir_license"))
    directories = rows.where(F.col(directory).isNotNull()).select(F.col(directory).alias("directory")).distinct().withColumn("up", F.explode(parents(F.col("directory"))))
    nearest = directories.select("directory", "up.depth", F.col("up.directory").alias("above")).join(licensed, "above")
    nearest = nearest.groupBy("directory").agg(F.max(F.struct("depth", "above", "dir_license")).alias(near)).withColumnRenamed("directory", directory)
    out = rows.join(ws.write(nearest, "nearest"), directory, "left")  # written, so that a flat directory is a skewed join that Spark can split
    values = (
        F.coalesce(F.col(held)["n"], F.lit(0).cast("long")), mine, F.coalesce(file["score"], F.col(held)["own"]["score"]), file.isNotNull(),
        F.coalesce(mine, F.col(near)["dir_license"]), F.when(mine.isNull(), F.col(near)["above"]),
    )
    return out.select(*(F.col(f"`{c}`") for c in files.columns if c != "text"), *(v.alias(n) for v, n in zip(values, names, strict=True)))


def document_files(docs: DataFrame) -> DataFrame:
    """Documents as files (doc_id, path, text): by their number one third each stands in <source>/, <source>/<lang>/ and
    <source>/<lang>/<last digit>/; nulls in a path read `unknown`."""
    step = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("unknown"))
    third = F.coalesce(F.col("doc_id") % 3, F.lit(0))
    lang = F.when(third == 0, F.lit("")).otherwise(F.concat(step("lang"), F.lit("/")))
    digit = F.when(third == 2, F.concat((F.col("doc_id") % 10).cast("string"), F.lit("/"))).otherwise("")
    return docs.select("doc_id", F.concat(step("source"), F.lit("/"), lang, digit, step("doc_id"), F.lit(".txt")).alias("path"), "text")


def oracle() -> str:
    """scan(document_files(documents)) in DuckDB SQL: every line, block and text is scored, none is left out before."""
    lower = lambda x: f"translate({x}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

    def known(templates: dict[str, str], least: float, told_apart: bool) -> tuple[str, str, float, str]:
        idf, unit, other = weights(templates, least)
        table = ", ".join(f"('{a}', '{a.removesuffix(' header')}', '{t}', {v!r}::DOUBLE)" for (a, t), v in unit.items())
        own = ", ".join(f"('{n}', [{', '.join(repr(v) for v in (versions(x) if told_apart else []))}]::VARCHAR[])" for n, x in templates.items())
        return ", ".join(f"('{t}', {v!r}::DOUBLE)" for t, v in idf.items()), table, other, own

    short, long = known(TEMPLATES, 1.0, True), known(texts(), 0.0, False)

    def similar(units: str, which: int, least: float) -> str:
        other = (short, long)[which][2]
        return f"""(WITH t AS (SELECT doc_id, line, token, count(*) AS tf FROM (SELECT doc_id, line, unnest(regexp_extract_all({lower("content")}, '{TOKEN}')) AS token FROM {units}) GROUP BY ALL),
  w AS (SELECT t.*, tf * coalesce(v.idf, {other!r}::DOUBLE) AS w FROM t LEFT JOIN v{which} v USING (token)),
  n AS (SELECT doc_id, line, sqrt(sum(w * w)) AS norm, coalesce(list(token) FILTER (regexp_matches(token, '{VERSION}')), []) AS said FROM w GROUP BY ALL),
  d AS (SELECT doc_id, line, template, any_value(license) AS license, sum(w * weight) AS dot FROM w JOIN x{which} USING (token) GROUP BY doc_id, line, template),
  s AS (SELECT doc_id, line, license, round(dot / norm, 6) AS score FROM d JOIN n USING (doc_id, line) JOIN o{which} USING (template) WHERE len(own) = 0 OR len(said) = 0 OR list_has_any(own, said)),
  m AS (SELECT doc_id, line, license, max(score) AS score FROM s GROUP BY ALL),
  r AS (SELECT *, row_number() OVER p AS place, lead(score, 1, 0) OVER p AS after FROM m WINDOW p AS (PARTITION BY doc_id, line ORDER BY score DESC, license))
  SELECT doc_id, line, license, score FROM r WHERE place = 1 AND score >= {least} AND round(score - after, 6) >= {0.0 if which else MARGIN})"""

    def tables(k: int, t: tuple) -> str:
        return f"v{k}(token, idf) AS (VALUES {t[0]}), x{k}(template, license, token, weight) AS (VALUES {t[1]}), o{k}(template, own) AS (VALUES {t[3]})"

    comment = COMMENT.replace("'", "''")
    return f"""
WITH {tables(0, short)}, {tables(1, long)},
f AS (SELECT doc_id, source || lang || digit AS directory, source || lang || digit || '/' || coalesce(doc_id::VARCHAR, 'unknown') || '.txt' AS path, content,
    [source || lang || digit, source || lang, source] AS above
  FROM (SELECT doc_id, coalesce(source, 'unknown') AS source, CASE WHEN coalesce(doc_id % 3, 0) = 0 THEN '' ELSE '/' || coalesce(lang, 'unknown') END AS lang,
    CASE WHEN doc_id % 3 = 2 THEN '/' || (doc_id % 10)::VARCHAR ELSE '' END AS digit, text AS content FROM documents)),
l AS (SELECT doc_id, generate_subscripts(string_split(content, chr(10)), 1) AS line, unnest(string_split(content, chr(10))) AS content FROM f),
b1 AS (SELECT doc_id, list_concat(regexp_extract_all(content, '{comment}'), string_split_regex(content, '{GAP}')) AS parts FROM f),
b AS (SELECT doc_id, generate_subscripts(parts, 1) AS line, unnest(parts) AS content FROM b1),
h AS (SELECT doc_id, 0 AS line, content FROM f),
heads AS {similar("l", 0, HEADER_COSINE)},
parts AS {similar("b", 1, HEADER_COSINE)},
own AS (SELECT doc_id, count(*) AS n_headers, min_by(license, struct_pack(a := -score, b := line)) AS license, max(score) AS score FROM heads GROUP BY doc_id),
block AS (SELECT doc_id, min_by(license, struct_pack(a := -score, b := line)) AS license, max(score) AS score FROM parts GROUP BY doc_id),
said AS {similar("h", 0, FILE_COSINE)},
entire AS {similar("h", 1, FILE_COSINE)},
whole AS (SELECT doc_id, coalesce(s.license, e.license) AS license, coalesce(s.score, e.score) AS score FROM said s FULL JOIN entire e USING (doc_id)),
dirs AS (SELECT directory, license FROM (SELECT f.directory, w.license, row_number() OVER (PARTITION BY f.directory ORDER BY w.score DESC, f.path) AS r
  FROM whole w JOIN f USING (doc_id)) WHERE r = 1),
near AS (SELECT doc_id, max_by(struct_pack(directory := directory, license := license), strlen(directory)) AS near
  FROM (SELECT doc_id, unnest(above) AS directory FROM f) JOIN dirs USING (directory) GROUP BY doc_id),
found AS (SELECT f.doc_id, f.path, coalesce(own.n_headers, CASE WHEN block.license IS NOT NULL THEN 1 END, 0) AS n_headers, whole.license IS NOT NULL AS is_license_file,
  coalesce(whole.license, own.license, block.license) AS license, coalesce(whole.score, own.score, block.score) AS score, near.near AS near
  FROM f LEFT JOIN own USING (doc_id) LEFT JOIN block USING (doc_id) LEFT JOIN whole USING (doc_id) LEFT JOIN near USING (doc_id))
SELECT doc_id, path, n_headers, license, score, is_license_file, coalesce(license, near.license) AS effective_license,
  CASE WHEN license IS NULL THEN near.directory END AS inherited_from FROM found"""

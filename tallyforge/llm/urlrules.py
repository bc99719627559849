"""URL filters: stated host and path rules, then token combinations mined by FP-growth from labelled pages.

Labels of texts alone say little of URLs; page_labels() adds distant labels, pages of hosts whose names block lists agree on.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from statistics import NormalDist

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import Workspace, ascii_lower

BLOCK, ALLOW = "block", "allow"
#: The item that stands for a page labelled bad; no URL token can contain a space.
BAD = "label bad"
#: A combination must hold in this share of the labelled pages and on so many bad ones, with this share of bad ones among
#: its pages, so many times that of all pages, and surely above it: the lower end of Wilson's interval, at a level that
#: lets all combinations tested together give a false one with FALSE_RULES.
MIN_SUPPORT = 0.0005
MIN_PAGES = 4
MIN_CONFIDENCE = 0.9
MIN_LIFT = 1.5
FALSE_RULES = 0.05
#: Up to this many mined rules are broadcast; with more Spark chooses the join.
BROADCAST_RULES = 50_000
# Words in host names that public block lists agree on.
ABUSE = ("adserver", "ads", "adult", "bets", "betting", "bingo", "casino", "doubleclick", "gambling", "malware", "phishing", "pills", "poker", "porn", "slots", "spam", "tracker", "viagra", "warez", "xxx")


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    verdict: str

    @property
    def name(self) -> str:
        return self.host + self.path


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for null and where there is no ://."""
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)\A.*?://(.*)\z", 1)
    host = F.regexp_extract(rest, r"(?s)\A[^/?#]*", 0)
    path = F.regexp_extract(rest, r"(?s)\A[^/?#]*([^?#]*)", 1)
    return ascii_lower(host), path


def stated(host: Column, path: Column, rules: list[Rule]) -> Column:
    """The longest rule that fits as (rule, verdict), else null."""
    out = None
    for rule in sorted(rules, key=lambda r: (-len(r.name), r.name)):
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        value = F.struct(F.lit(rule.name).alias("rule"), F.lit(rule.verdict).alias("verdict"))
        out = F.when(fits, value) if out is None else out.when(fits, value)
    return F.lit(None).cast("struct<rule:string,verdict:string>") if out is None else out


def tokens(host: Column, path: Column, url: Column) -> Column:
    """Distinct tokens: h:<label> of the host, s:<piece of a label with hyphens>, p:<path step>, k:<query key>; numbers as #."""
    number = lambda c: F.regexp_replace(c, r"[0-9]+", "#")
    some = lambda a: F.filter(a, lambda x: x != "")
    tagged = lambda tag, a: F.transform(some(a), lambda x: F.concat(F.lit(f"{tag}:"), number(x)))
    query = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)\?([^#]*)", 1)
    keys = F.transform(F.split(query, "&"), lambda x: F.substring_index(x, "=", 1))
    labels = F.split(host, r"\.")
    pieces = F.flatten(F.transform(F.filter(labels, lambda x: F.contains(x, F.lit("-"))), lambda x: F.split(x, "-")))
    return F.array_distinct(F.concat(tagged("h", labels), tagged("s", pieces), tagged("p", F.split(path, "/")), tagged("k", keys)))


def says_abuse(host: Column) -> Column:
    """Whether a piece of the host's labels (cut at hyphens) is one of ABUSE."""
    return F.arrays_overlap(F.split(host, r"[.-]"), F.array(*map(F.lit, ABUSE)))


def sigmas(tests: int) -> float:
    return NormalDist().inv_cdf(1 - FALSE_RULES / max(tests, 1))


RULES = "antecedent array<string>, n_bad long, n long, confidence double, lift double, rarest string"


def mine(labelled: DataFrame, ws: Workspace | None = None) -> DataFrame:
    """(antecedent, n_bad, n, confidence, lift, rarest) from (uid, tokens, bad), uid different for each row.

    FP-growth over the tokens of all labelled pages plus one item for the label. Tokens that stand on the same pages
    are one item (so what always comes together makes one itemset, not all its parts), and tokens of every page none.
    A combination that says no more than one of its parts is pruned. antecedent: all tokens of the combination's items;
    rarest: the one on the fewest pages (ties: first). Pages without tokens teach nothing.
    """
    spark = labelled.sparkSession
    ws = ws or Workspace(spark, "urlrules")
    rows = ws.write(labelled.where(F.size("tokens") > 0).select("uid", "bad", F.array_distinct("tokens").alias("tokens")), "labelled")
    n, n_bad = rows.agg(F.count(F.lit(1)), F.count_if("bad")).first()
    if not n_bad:
        return spark.createDataFrame([], RULES)
    least = max(MIN_PAGES, MIN_SUPPORT * n)
    # Items: tokens with the same pages, told by their number and two sums of hashes of the pages. What is on fewer
    # pages than any rule needs, or on all, is left out.
    sums = [F.sum(F.xxhash64("uid", F.lit(k)).cast("decimal(38,0)")).alias(f"s{k}") for k in (1, 2)]
    found = rows.select("uid", F.explode("tokens").alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("pages"), *sums)
    found = found.where((F.col("pages") >= least) & (F.col("pages") < n))
    items = found.groupBy("pages", "s1", "s2").agg(F.array_sort(F.collect_set("token")).alias("members"))
    items = ws.write(items.select(F.col("members")[0].alias("item"), "pages", "members"), "items")
    held = rows.select("uid", F.explode("tokens").alias("item")).join(items.select("item"), "item").groupBy("uid").agg(F.collect_list("item").alias("items"))
    held = rows.select("uid", "bad").join(held, "uid", "left").select(F.coalesce("items", F.array().cast("array<string>")).alias("items"), "bad")
    baskets = held.select(F.when(F.col("bad"), F.concat("items", F.array(F.lit(BAD)))).otherwise(F.col("items")).alias("items"))
    model = FPGrowth(itemsCol="items", minSupport=min(1.0, (least - 0.5) / n), minConfidence=1.0).fit(ws.write(baskets, "baskets"))
    sets = ws.write(model.freqItemsets.select(F.array_sort(F.array_except("items", F.array(F.lit(BAD)))).alias("key"), F.array_contains("items", BAD).alias("bad"), F.col("freq").alias("n")), "itemsets")
    both = sets.where("bad AND size(key) > 0").select("key", F.col("n").alias("n_bad")).join(sets.where("NOT bad").select("key", "n"), "key")
    both = ws.write(both.withColumn("confidence", F.col("n_bad") / F.col("n")), "sets")

    # What a combination's parts say, from the short ones up: every part of a frequent itemset is one itself.
    longest = both.agg(F.max(F.size("key"))).first()[0] or 0
    known = both.where("size(key) = 1").select("key", "confidence", F.lit(0.0).alias("parts"))
    levels = [known]
    for k in range(2, longest + 1):
        own = both.where(F.size("key") == k)
        part = own.select("key", F.explode("key").alias("x")).select("key", F.array_remove("key", F.col("x")).alias("part"))
        reach = levels[-1].select(F.col("key").alias("part"), F.greatest("confidence", "parts").alias("reach"))
        parts = part.join(reach, "part").groupBy("key").agg(F.max("reach").alias("parts"))
        levels.append(ws.write(own.select("key", "confidence").join(parts, "key").select("key", "confidence", "parts"), "level"))
    told = reduce(DataFrame.unionByName, levels).where("confidence > parts").select("key")
    base = n_bad / n
    z = sigmas(both.count())
    z2 = z * z
    lower = (F.col("n_bad") + z2 / 2 - z * F.sqrt(F.col("n_bad") * (F.col("n") - F.col("n_bad")) / F.col("n") + z2 / 4)) / (F.col("n") + z2)
    rules = both.where((F.col("confidence") >= MIN_CONFIDENCE) & (F.col("confidence") >= MIN_LIFT * base) & (lower > base)).join(told, "key", "left_semi")
    listed = rules.select("*", F.explode("key").alias("item")).join(items, "item")
    agg = [F.array_sort(F.flatten(F.collect_list("members"))).alias("antecedent"), F.min(F.struct("pages", "item"))["item"].alias("rarest")]
    out = listed.groupBy("key", "n_bad", "n", "confidence").agg(*agg)
    return out.select("antecedent", "n_bad", "n", "confidence", (F.col("confidence") / base).alias("lift"), "rarest")


def matched(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """(uid, mined) for pages (uid, tokens) that hold all tokens of a rule; mined: the rule of the highest confidence (ties: last).

    Inverted index: a rule stands under its rarest token, and only pages with that token test it.
    """
    index = rules.select(F.col("rarest").alias("token"), "antecedent", "confidence")
    held = pages.select("uid", "tokens", F.explode("tokens").alias("token"))
    hits = held.join(index, "token").where(F.size(F.array_except("antecedent", "tokens")) == 0)
    best = F.max(F.struct("confidence", F.array_join("antecedent", " ").alias("mined")))
    return hits.groupBy("uid").agg(best["mined"].alias("mined"))


def page_labels(pages: DataFrame, labels: DataFrame, id_col: str = "page_id") -> DataFrame:
    """(page_id, bad): pages that `labels` (page_id, bad) names, and pages of hosts that say abuse, which are bad."""
    host, _ = host_and_path(F.col("url"))
    distant = pages.where(says_abuse(host)).select(id_col, F.lit(True).alias("bad"))
    return labels.select(id_col, "bad").unionByName(distant)


def judge(pages: DataFrame, bad: DataFrame, rules: list[Rule]) -> DataFrame:
    """(page_id, host, path, rule, verdict, mined) of every page.

    bad: (page_id, bad) of labelled pages; a page with several labels is bad if one says so, null labels say nothing.
    A stated rule decides where one fits; otherwise a mined combination blocks, and everything else is allowed. Null
    and odd urls have no host, path or token and are allowed. Repeated rows are judged alike, each with its own row.
    """
    ws = Workspace(pages.sparkSession, "urls")
    host, path = host_and_path(F.col("url"))
    rows = pages.select(F.monotonically_increasing_id().alias("uid"), "page_id", "url").withColumn("host", host).withColumn("path", path)
    fit = stated(F.col("host"), F.col("path"), rules)
    rows = rows.select("uid", "page_id", "host", "path", fit.alias("fit"), tokens(F.col("host"), F.col("path"), F.col("url")).alias("tokens"))
    rows = ws.write(rows, "tokens")
    labels = bad.where("bad is not null").groupBy("page_id").agg(F.max("bad").alias("bad"))
    mined = ws.write(mine(rows.select("uid", "page_id", "tokens").join(labels, "page_id").select("uid", "tokens", "bad"), ws), "rules")
    index = F.broadcast(mined) if mined.count() <= BROADCAST_RULES else mined
    found = matched(rows.where("fit is null").select("uid", "tokens"), index)
    out = rows.join(found, "uid", "left")
    verdict = F.coalesce(F.col("fit.verdict"), F.when(F.col("mined").isNotNull(), BLOCK).otherwise(ALLOW))
    return out.select("page_id", "host", "path", F.col("fit.rule").alias("rule"), verdict.alias("verdict"), F.when(F.col("fit").isNull(), F.col("mined")).alias("mined"))

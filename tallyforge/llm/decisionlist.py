"""Quality rules: a decision list learned from labelled text statistics, applied as one Spark conditional.

Everything that touches rows is a DataFrame or SQL expression. Fitting sees all labelled rows as counts of cells, a cell
being the tuple of the bins that a row's features fall into; their number is bounded by the cut points alone.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import SPACE_CHARS, Workspace, words_of

#: Features of the learned conditions, in the order of the cells.
FEATURES = ("n_words", "mean_word", "symbol_share", "dup_lines", "repeat_share")
#: Cut points of each feature are these quantiles over the labelled rows: at most 9 bins, 9^5 cells and 2 folds.
QUANTILES = (0.02, 0.05, 0.15, 0.4, 0.7, 0.9, 0.95, 0.98)
#: A rule must be right on this share of the rows that it was pruned on, and cover so many.
PRECISION = 0.8
COVER = 5
MOST_RULES = 32
MOST_CONDITIONS = 4

_SYMBOLS = "#*$%&|<>"


def statistics(docs: DataFrame, text_col: str = "text", mask: int = -1) -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words (long) of each whole text.

    Null and empty texts have zeros. docs must not have columns of these names or beginning with _q. Write the result
    before filtering on it: Spark would move the filter below the columns and compute them within it, again and again.
    mask: bits of the windows' hashes that are used; results don't hang on it.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    blank = lambda c: F.translate(c, SPACE_CHARS, "")
    lines = F.filter(F.split(text, "\n", -1), lambda x: blank(x) != "")
    out = docs.withColumn("_q_words", words_of(F.col(text_col))).withColumn("_q_lines", lines)
    out = out.withColumns({
        "n_words": F.size("_q_words").cast("long"),
        "word_chars": F.length(blank(text)).cast("long"),
        "n_symbols": (F.length(text) - F.length(F.translate(text, _SYMBOLS, ""))).cast("long"),
        "n_dup_lines": (F.size("_q_lines") - F.size(F.array_distinct("_q_lines"))).cast("long"),
    }).drop("_q_lines")
    # Windows of three words as hash << bits | position in one long, so that a primitive sort brings equal ones together;
    # neighbours count as equal only if their words are. Where two different windows share the bits that are left of the
    # hash, they may part equal ones: such texts, very rare, are sorted by the words themselves.
    out = out.withColumn("_q_bits", F.expr("cast(ceil(log2(n_words + 1)) AS int)"))
    out = out.withColumn("_q_all", F.expr(f"""sort_array(CASE WHEN n_words < 3 THEN cast(array() AS array<bigint>) ELSE
        transform(sequence(0, cast(n_words AS int) - 3),
          i -> shiftleft(xxhash64(_q_words[i], _q_words[i + 1], _q_words[i + 2]) & {mask}L, _q_bits) | cast(i AS bigint)) END)"""))
    out = out.withColumn("_q_mask", F.expr("shiftleft(1L, _q_bits) - 1"))
    shared = "coalesce(shiftright(x, _q_bits) = shiftright(get(_q_all, {0}), _q_bits), false)"
    same = """coalesce(shiftright(x, _q_bits) = shiftright(get(_q_all, {0}), _q_bits)
        AND _q_words[cast(x & _q_mask AS int)] = _q_words[cast(get(_q_all, {0}) & _q_mask AS int)]
        AND _q_words[cast(x & _q_mask AS int) + 1] = _q_words[cast(get(_q_all, {0}) & _q_mask AS int) + 1]
        AND _q_words[cast(x & _q_mask AS int) + 2] = _q_words[cast(get(_q_all, {0}) & _q_mask AS int) + 2], false)"""
    out = out.withColumn("_q_twice", F.expr(f"filter(_q_all, (x, j) -> {same.format('j - 1')} OR {same.format('j + 1')})"))
    out = out.withColumn("_q_clash", F.expr(f"size(filter(_q_all, (x, j) -> {shared.format('j + 1')} AND NOT {same.format('j + 1')})) > 0"))
    out = out.withColumn("_q_texts", F.expr("""CASE WHEN _q_clash THEN array_sort(transform(sequence(0, cast(n_words AS int) - 3),
        i -> struct(_q_words[i] AS a, _q_words[i + 1] AS b, _q_words[i + 2] AS c, cast(i AS bigint) AS at))) END"""))
    equal = "coalesce(x.a = get(_q_texts, {0}).a AND x.b = get(_q_texts, {0}).b AND x.c = get(_q_texts, {0}).c, false)"
    exact = f"transform(filter(_q_texts, (x, j) -> {equal.format('j - 1')} OR {equal.format('j + 1')}), x -> x.at)"
    out = out.withColumn("_q_at", F.expr(f"sort_array(CASE WHEN _q_clash THEN {exact} ELSE transform(_q_twice, x -> x & _q_mask) END)"))
    gaps = "transform(_q_at, (x, j) -> least(3L, coalesce(get(_q_at, j + 1) - x, 3L)))"
    out = out.withColumn("n_repeat_words", F.expr(f"aggregate({gaps}, 0L, (a, x) -> a + x)"))
    return out.drop(*(c for c in out.columns if c.startswith("_q")))


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def features() -> dict[str, Column]:
    n = F.greatest(F.col("n_words"), F.lit(1))
    return {
        "n_words": F.col("n_words").cast("double"),
        "mean_word": F.col("word_chars") / n,
        "symbol_share": F.col("n_symbols") / n,
        "dup_lines": F.col("n_dup_lines").cast("double"),
        "repeat_share": F.col("n_repeat_words") / n,
    }


@dataclass(frozen=True)
class Condition:
    """feature <= cut, or feature > cut."""

    feature: str
    below: bool
    cut: float

    def column(self) -> Column:
        value = features()[self.feature]
        return value <= self.cut if self.below else value > self.cut


@dataclass(frozen=True)
class DecisionList:
    """Ordered conjunctions that reject a row; a row that none matches is kept."""

    rules: tuple[tuple[Condition, ...], ...]

    def keeps(self) -> Column:
        """CASE WHEN rule 1 THEN false WHEN rule 2 THEN false ... ELSE true END."""
        out = None
        for rule in self.rules:
            met = reduce(lambda a, b: a & b, (c.column() for c in rule))
            out = F.when(met, False) if out is None else out.when(met, False)
        return F.lit(True) if out is None else out.otherwise(True)


def _cells(rows: DataFrame, cuts: dict[str, list[float]]) -> list:
    """Counts by fold (0: prune, 1 and 2: grow), label and bins."""
    bins = [reduce(lambda a, b: a + b, ((value > cut).cast("int") for cut in cuts[name]), F.lit(0)).alias(name) for name, value in features().items()]
    return rows.select(F.pmod(F.xxhash64("_key"), F.lit(3)).alias("fold"), "bad", *bins).groupBy("fold", "bad", *FEATURES).count().collect()


def _cover(bins: np.ndarray, good: np.ndarray, bad: np.ndarray, cuts: dict[str, list[float]]) -> tuple[tuple[Condition, ...], ...]:
    """Sequential covering; good and bad: counts of each cell by purpose (column 0 grow, column 1 prune)."""
    tests = [(Condition(name, below, cut), (bins[:, f] <= k) == below) for f, name in enumerate(FEATURES) for k, cut in enumerate(cuts[name]) for below in (True, False)]
    rules: list[tuple[Condition, ...]] = []
    left = np.ones(len(bins), bool)
    while len(rules) < MOST_RULES:
        inside, rule, masks = left.copy(), [], []
        while len(rule) < MOST_CONDITIONS:
            p0, n0 = bad[inside, 0].sum(), good[inside, 0].sum()
            if p0 == 0 or n0 == 0:
                break
            best, gain = None, 1e-9
            for condition, mask in tests:
                both = inside & mask
                p, n = bad[both, 0].sum(), good[both, 0].sum()
                if p >= COVER and (g := p * (np.log2(p / (p + n)) - np.log2(p0 / (p0 + n0)))) > gain:
                    best, gain = (condition, mask), g
            if best is None:
                break
            rule.append(best[0])
            masks.append(best[1])
            inside &= best[1]
        if not rule:
            break

        def worth(k: int) -> tuple[float, float]:
            both = reduce(np.logical_and, masks[:k], left)
            p, n = bad[both, 1].sum(), good[both, 1].sum()
            return (p - n) / max(p + n, 1), -k

        k = max(range(1, len(rule) + 1), key=worth)
        both = reduce(np.logical_and, masks[:k], left)
        p, n = bad[both, 1].sum(), good[both, 1].sum()
        if p < COVER or p < PRECISION * (p + n):
            break
        rules.append(tuple(rule[:k]))
        left &= ~both
    return tuple(rules)


def learn(stats: DataFrame, labels: DataFrame, key: str = "doc_id", label: str = "quality", bad: int = 0) -> DecisionList:
    """The decision list for `label = bad`, from all rows of stats that have a label and do not fail the base rules.

    Rows with a null key or label teach nothing; a key with several labels counts once for each. Without labelled
    rows the list is empty and keeps everything.
    """
    marked = labels.where(F.col(label).isNotNull()).select(F.col(key).alias("_key"), (F.col(label) == bad).alias("bad"))
    rows = stats.select(F.col(key).alias("_key"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words").join(marked, "_key")
    rows = Workspace(stats.sparkSession, "quality").write(rows, "labelled").where(~base_failed()).persist()
    try:
        found = rows.agg(*(F.percentile_approx(value, list(QUANTILES), 10_000).alias(name) for name, value in features().items())).first()
        cuts = {name: sorted(set(found[name] or [])) for name in FEATURES}
        cells: dict[tuple, np.ndarray] = {}
        for row in _cells(rows, cuts):
            cells.setdefault(tuple(row[name] for name in FEATURES), np.zeros((2, 2)))[int(row["bad"]), int(row["fold"] == 0)] += row["count"]
    finally:
        rows.unpersist()
    if not cells:
        return DecisionList(())
    order = sorted(cells)
    counts = np.stack([cells[k] for k in order])
    return DecisionList(_cover(np.array(order), counts[:, 0], counts[:, 1], cuts))


def judge(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, the five statistics, base_failed, kept) of every row; repeated rows are judged alike."""
    ws = Workspace(docs.sparkSession, "quality")
    stats = ws.write(statistics(docs.select("doc_id", "text")).drop("text"), "statistics")
    rules = learn(stats, labels)
    return stats.withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & rules.keeps())

"""Lenient coercions and null rules shared by all operators."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def num(value: Column, null_policy: str = "null") -> Column:
    """Double, or null (`zero`: 0.0) where the text is none; NaN counts as missing, so no threshold holds for it."""
    out = F.nanvl(value.cast("string").try_cast("double"), F.lit(None).cast("double"))
    return F.coalesce(out, F.lit(0.0)) if null_policy == "zero" else out


def whole(value: Column, default: int = 0) -> Column:
    """Whole number written without a point, else the default."""
    text = F.trim(value.cast("string"))
    return F.coalesce(F.when(text.rlike(r"^[+-]?[0-9]+$"), text.try_cast("bigint")), F.lit(default).cast("bigint"))


def flag(value: Column) -> Column:
    """True for the exact text 1 alone."""
    return F.coalesce(value.cast("string") == "1", F.lit(False))


def text(value: Column) -> Column:
    return F.coalesce(value.cast("string"), F.lit(""))


def first_text(*values: Column) -> Column:
    """The first value that is neither null nor empty, upper-cased, else ''."""
    return F.upper(F.coalesce(*(F.nullif(v.cast("string"), F.lit("")) for v in values), F.lit("")))


def group_key(value: Column) -> Column:
    return F.coalesce(F.nullif(F.upper(text(value)), F.lit("")), F.lit("MISSING"))


def ratio(n: Column, d: Column, empty: float | None = 0.0) -> Column:
    return F.when(d == 0, F.lit(empty).cast("double")).otherwise(n.cast("double") / d)


def pct(n: Column, d: Column) -> Column:
    return F.round(100 * ratio(n, d), 6)


def at_least(value: Column, limit: float) -> Column:
    """False, not null, for missing values and NaN."""
    return F.coalesce(F.nanvl(value, F.lit(None).cast("double")) >= limit, F.lit(False))


def at_most(value: Column, limit: float) -> Column:
    return F.coalesce(F.nanvl(value, F.lit(None).cast("double")) <= limit, F.lit(False))


def last_step(path: Column, name: str) -> Column:
    """Value of the last `name=value` directory of a path, upper-cased; '' without one."""
    return F.upper(F.regexp_extract(path, rf"(?:^|.*/){name}=([^/]*)(?:/|$)", 1))


def file_safe(value: Column) -> Column:
    return F.regexp_replace(value, r"[^\p{L}\p{N}._-]", "_")


def number_in(value: Column, pattern: str) -> Column:
    """The first group of a pattern as a number, null where it doesn't match."""
    return F.nullif(F.regexp_extract(value, pattern, 1), F.lit("")).cast("long")


def bucket(value: Column, limits, missing: str) -> Column:
    out = F.when(value.isNull() | F.isnan(value), missing)
    for low, high, name in limits:
        inside = value >= low if high == float("inf") else (value >= low) & (value < high)
        out = out.when(inside, name)
    return out.otherwise(missing)


def chunk_bucket(n: Column) -> Column:
    return F.when(n <= 1, "1").when(n == 2, "2").when(n <= 4, "3-4").when(n <= 8, "5-8").otherwise("9+")


def human_bytes(n: Column) -> Column:
    out = None
    for k, unit in reversed(list(enumerate(("B", "KiB", "MiB", "GiB", "TiB")))):
        value = F.format_string("%.1f" + unit, n / float(1024**k))
        out = F.when(n >= 1024**k, value) if out is None else out.when(n >= 1024**k, value)
    return out.otherwise(F.format_string("%.1fB", n.cast("double")))


def eight_decimals(value: Column) -> Column:
    """A number with eight decimals, '' where there is none (text that is no number included)."""
    return F.when(num(value).isNotNull(), F.format_string("%.8f", num(value))).otherwise("")


def codes_of(text_value: str | None, separators: str = ",;") -> list[str] | None:
    """A list of codes from text, upper-cased, blanks left out; None (no filter) for blank text."""
    found = [x.strip().upper() for x in re.split(f"[{separators}]", text_value or "") if x.strip()]
    return found or None


def label_ids(items, codes: tuple[str, ...]) -> list[int]:
    """Ids of codes or whole numbers, each once, in order; an error for what is neither."""
    out: dict[int, None] = {}
    for x in items:
        word = str(x).strip()
        k = codes.index(word.upper()) if word.upper() in codes else int(word)
        if not 0 <= k < len(codes):
            raise ValueError(f"{x} is no label")
        out[k] = None
    return list(out)


def first_seen(paths) -> list[str]:
    """Each path once, in the order of its first mention."""
    return list(dict.fromkeys(paths))


def literals(values) -> Column:
    return F.array(*(F.lit(v) for v in values))


def lookup(values, index: Column) -> Column:
    """values[index] for a fixed tuple and a 0-based index; null outside."""
    return F.get(literals(values), index.cast("int"))

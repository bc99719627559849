"""Array algebra over score vectors, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .dims import CODES, GROUPS, LABEL_REGIONS, REGIONS

LOWEST = -3.4028234663852886e38


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def softmax(a: Column) -> Column:
    top = F.array_max(a)
    e = F.transform(a, lambda x: F.exp(x - top))
    return F.transform(e, lambda x: x / total(e))


def logsumexp(a: Column) -> Column:
    top = F.array_max(a)
    return top + F.log(F.aggregate(a, F.lit(0.0), lambda s, x: s + F.exp(x - top)))


def argmax(a: Column) -> Column:
    """0-based place of the first largest value."""
    return (F.array_position(a, F.array_max(a)) - 1).cast("int")


def entropy(p: Column) -> Column:
    return -F.aggregate(p, F.lit(0.0), lambda s, x: s + F.greatest(x, F.lit(1e-12)) * F.log(F.greatest(x, F.lit(1e-12))))


def top_k(p: Column, k: int) -> Column:
    """(id, value) of the k largest values, largest first; ties by id."""
    pairs = F.transform(p, lambda x, i: F.struct((-x).alias("n"), i.alias("id")))
    return F.transform(F.slice(F.array_sort(pairs), 1, k), lambda s: F.struct(s["id"].alias("id"), (-s["n"]).alias("value")))


def pick(a: Column, places) -> Column:
    return F.array(*(F.get(a, F.lit(i)) for i in places))


def region_logits(a: Column) -> Column:
    """Per region the log of the summed exponentials of its members."""
    return F.array(*(logsumexp(pick(a, [i for i, r in enumerate(LABEL_REGIONS) if r == region])) for region in REGIONS))


def masked(a: Column, active) -> Column:
    """Inactive places at the smallest float; an error if none is active."""
    if not any(active):
        raise ValueError("no active class")
    return F.transform(a, lambda x, i: F.when(F.get(F.array(*(F.lit(bool(v)) for v in active)), i), x).otherwise(F.lit(LOWEST)))


def one_hot(label: Column, n: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.when(i == label, 1.0).otherwise(0.0))


def soft_target(p: Column, label: Column, n: int) -> Column:
    """Clamped at 0 and normalised; the one-hot label for null and for mass 0."""
    clean = F.transform(p, lambda x: F.greatest(x, F.lit(0.0)))
    return F.when(p.isNull() | (total(clean) <= 0), one_hot(label, n)).otherwise(F.transform(clean, lambda x: x / total(clean)))


def masked_target(p: Column, label: Column, active) -> Column:
    """Active mass alone, normalised; mass up to 1e-6 gives the one-hot label."""
    inside = F.transform(p, lambda x, i: F.when(F.get(F.array(*(F.lit(bool(v)) for v in active)), i), x).otherwise(0.0))
    return F.when(total(inside) <= 1e-6, one_hot(label, len(active))).otherwise(F.transform(inside, lambda x: x / total(inside)))


def fused(a: Column, region: Column, group_values: dict[str, Column], w_region: float, w_group: float) -> Column:
    """Class logits plus the weighted logit of the class's region and the mean over the groups that hold it."""
    out = []
    for i, code in enumerate(CODES):
        value = F.get(a, F.lit(i)) + w_region * F.get(region, F.lit(REGIONS.index(LABEL_REGIONS[i])))
        inside = [F.get(group_values[g], F.lit(codes.index(code))) for g, codes in GROUPS.items() if code in codes and g in group_values]
        if inside:
            value = value + w_group * sum(inside[1:], inside[0]) / len(inside)
        out.append(value)
    return F.array(*out)


def biased(p: Column, bias, excluded=()) -> Column:
    """log of probabilities (at least 1e-45) plus a bias; excluded classes far below all."""
    shifted = F.array(*(F.log(F.greatest(F.get(p, F.lit(i)), F.lit(1e-45))) + F.lit(float(b)) for i, b in enumerate(bias)))
    return F.transform(shifted, lambda x, i: F.when(i.isin(*excluded), -1e30).otherwise(x)) if excluded else shifted


def cross_entropy(a: Column, target: Column) -> Column:
    log_total = logsumexp(a)
    return -total(F.zip_with(target, F.transform(a, lambda x: x - log_total), lambda t, x: t * x))


def smoothed(label: Column, n: int, epsilon: float) -> Column:
    return F.transform(one_hot(label, n), lambda x: x * (1 - epsilon) + F.lit(epsilon / n))


def focal(loss: Column, gamma: float) -> Column:
    return F.pow(1 - F.exp(-loss), F.lit(gamma)) * loss


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def normalised(a: Column) -> Column:
    norm = F.sqrt(dot(a, a))
    return F.transform(a, lambda x: x / F.greatest(norm, F.lit(1e-12)))

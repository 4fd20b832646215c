"""Column expressions; all of them stay inside the JVM."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def euclidean(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))


def cosine_distance(a: Column, b: Column, tiny: float = 1e-8) -> Column:
    """1 - cosine; 1 if a norm is below ``tiny``."""
    na, nb = norm(a), norm(b)
    return F.when((na < tiny) | (nb < tiny), 1.0).otherwise(1 - dot(a, b) / (na * nb))


def weighted_cosine(a: Column, b: Column, floor: float = 0.35) -> Column:
    """Cosine times the smaller norm (1 at most); NULL if that norm is below ``floor``."""
    least = F.least(norm(a), norm(b))
    return F.when(least >= floor, (1 - cosine_distance(a, b)) * F.least(least, F.lit(1.0)))


def rbf(sq: Column, sigma: float) -> Column:
    return F.exp(-sq / (2 * sigma * sigma))


def clr(parts: Column, eps: float = 1e-6) -> Column:
    """Centred log ratio: NULL and NaN to eps, plus eps, renormalised."""
    filled = F.transform(parts, lambda x: F.when(x.isNull() | F.isnan(x), F.lit(eps)).otherwise(x) + eps)
    total = F.aggregate(filled, F.lit(0.0), lambda s, x: s + x)
    logs = F.transform(filled, lambda x: F.ln(x / total))
    mean = F.aggregate(logs, F.lit(0.0), lambda s, x: s + x) / F.size(logs)
    return F.transform(logs, lambda x: x - mean)


def softmax_of_distances(d: Column) -> Column:
    """exp(min - d), normalised."""
    e = F.transform(d, lambda x: F.exp(F.array_min(d) - x))
    return F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda s, y: s + y))


def entropy_bits(p: Column) -> Column:
    return F.aggregate(p, F.lit(0.0), lambda s, x: s - F.when(x > 0, x * F.log2(x)).otherwise(0.0))


def virtual_md(md: Column, ad: Column, rd: Column) -> Column:
    """MD, or (AD + 2 RD) / 3 where only those are known."""
    return F.coalesce(md, (ad + 2 * rd) / 3)


def stars(p: Column) -> Column:
    return F.when(p < 0.001, "***").when(p < 0.01, "**").when(p < 0.05, "*").otherwise("ns")


def bucket(p: Column, high: float = 0.70, medium: float = 0.50) -> Column:
    return F.when(p >= high, "high").when(p >= medium, "medium").otherwise("low")


def base_label(label: Column) -> Column:
    return F.trim(F.element_at(F.split(label, r" \("), 1))


def unlike(a: Column, b: Column) -> Column:
    """Neither text contains the other, in any case."""
    a, b = F.lower(a), F.lower(b)
    return ~F.contains(a, b) & ~F.contains(b, a)


def all_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))

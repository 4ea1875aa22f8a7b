"""Small numeric Column expressions used across the operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from askloom.functions.text import let


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def dot(a, b) -> Column:
    """Dot product in double precision."""
    return F.aggregate(
        F.zip_with(_col(a), _col(b), lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v
    )


def norm(a) -> Column:
    return F.sqrt(F.aggregate(_col(a), F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def l2_normalize(a) -> Column:
    return let(norm(a), lambda n: F.transform(_col(a), lambda x: F.when(n == 0, F.lit(0.0)).otherwise(x.cast("double") / n)))


def clip(x, lo, hi) -> Column:
    lo = lo if isinstance(lo, Column) else F.lit(float(lo))
    hi = hi if isinstance(hi, Column) else F.lit(float(hi))
    return F.least(F.greatest(_col(x), lo), hi)


def sigmoid(x, temperature=1.0) -> Column:
    t = temperature if isinstance(temperature, Column) else F.lit(float(temperature))
    return 1.0 / (1.0 + F.exp(-_col(x) / t))


def logit(p, eps: float = 1e-6) -> Column:
    c = clip(p, eps, 1.0 - eps)
    return F.log(c / (1.0 - c))


def log1p_exp(x) -> Column:
    """log(1 + e^x) without overflow."""
    x = _col(x)
    return F.greatest(x, F.lit(0.0)) + F.log1p(F.exp(-F.abs(x)))


def f1(p, r) -> Column:
    p, r = _col(p), _col(r)
    return F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0))


def softmax(values) -> Column:
    shifted = let(F.array_max(_col(values)), lambda top: F.transform(_col(values), lambda x: F.exp(x - top)))
    return let(shifted, lambda e: let(
        F.aggregate(e, F.lit(0.0), lambda s, x: s + x), lambda total: F.transform(e, lambda x: x / total)))


def overlap(a, b) -> Column:
    """Share of the distinct tokens of ``a`` that occur in ``b``; 0 when either is empty."""
    return let(F.array_distinct(_col(a)), lambda x: let(_col(b), lambda y: F.when(
        (F.size(x) == 0) | (F.size(y) == 0), F.lit(0.0)
    ).otherwise(F.size(F.array_intersect(x, y)) / F.size(x))))


def length_score(n, lo: int = 15, hi: int = 80) -> Column:
    """1 for word counts inside [lo, hi], falling off outside."""
    n = _col(n)
    return F.when(n < lo, n / lo).when(n > hi, F.greatest(F.lit(0.0), 1.0 - (n - hi) / hi)).otherwise(F.lit(1.0))


def bucket_hash(s, buckets: int = 32) -> Column:
    """A string's stable bucket in [0, 1); empty strings go to 0."""
    s = _col(s)
    h = F.conv(F.substring(F.sha2(s, 256), 1, 8), 16, 10).cast("long")
    return F.when(s.isNull() | (s == ""), F.lit(0.0)).otherwise((h % buckets) / float(buckets))


def span_iou(s1, e1, s2, e2) -> Column:
    """Overlap of two spans over their hull; 0 when a span is empty."""
    s1, e1, s2, e2 = map(_col, (s1, e1, s2, e2))
    inter = F.greatest(F.lit(0), F.least(e1, e2) - F.greatest(s1, s2))
    hull = F.greatest(e1, e2) - F.least(s1, s2)
    return F.when((e1 <= s1) | (e2 <= s2), F.lit(0.0)).otherwise(inter / hull)


def recall(retrieved, gold, k: int) -> Column:
    """Share of ``gold`` among the first ``k`` retrieved; repeats in gold stay in the denominator."""
    r, g = _col(retrieved), _col(gold)
    return F.when(F.size(g) == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(F.slice(r, 1, k), g)) / F.size(g))


def hash_order(key, seed: int) -> Column:
    """A stable pseudo-random order: md5 of key and seed (every engine has it)."""
    return F.md5(F.concat(_col(key).cast("string"), F.lit(f"|{seed}")).cast("binary"))


def hash_unit(key, seed: int) -> Column:
    """A stable pseudo-random number in [0, 1) from key and seed."""
    h = F.conv(F.substring(hash_order(key, seed), 1, 8), 16, 10).cast("long")
    return h / F.lit(4294967296.0)


def hash_below(key, seed: int, n) -> Column:
    """A stable pseudo-random whole number below ``n`` from key and seed."""
    return F.floor(hash_unit(key, seed) * n).cast("bigint")

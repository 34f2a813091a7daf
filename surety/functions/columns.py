"""Scalar and array expressions shared by the operators."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

INF = float("inf")

#: p-value modes whose peak is not at the decision boundary; reported, never fused.
BASELINE_MODES = ("symmetric", "entropy")
MODES = ("symmetric", "entropy", "boundary", "log")

#: Self-reported confidence levels as numbers (fixed values).
CONFIDENCE = {"HIGH": 1.0, "MEDIUM": 0.5, "LOW": 0.0}


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` applied to ``value``, which is evaluated once per row.

    Spark evaluates an expression inside a lambda again for every array element, also when it
    does not depend on the element. Binding it outside keeps array work linear.
    """
    return F.transform(F.array(value), body)[0]


def finite(c: Column) -> Column:
    """True for a present, finite number."""
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(INF))


def or_null(c: Column) -> Column:
    """The number if it is finite, else NULL."""
    return F.when(finite(c), c)


def clip(c: Column, lo: float, hi: float) -> Column:
    """Hold a number inside ``[lo, hi]``; a missing one stays missing."""
    lo, hi = F.lit(float(lo)), F.lit(float(hi))
    return F.when(c < lo, lo).when((c > hi) & ~F.isnan(c), hi).otherwise(c)


def ratio(a: Column, b: Column) -> Column:
    """``a / b`` with NULL for an empty denominator."""
    return F.when(b != 0, a / b)


def uniform(seed: int | Column, *keys: Column | str) -> Column:
    """A reproducible uniform number in [0, 1) keyed by the given columns."""
    seed = seed if isinstance(seed, Column) else F.lit(str(seed))
    text = F.concat_ws(":", seed.cast("string"), *[F.col(k).cast("string") if isinstance(k, str) else k.cast("string") for k in keys])
    return (F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double")
            / F.lit(4294967296.0))


def logistic(x: Column) -> Column:
    """``1 / (1 + exp(-x))`` with the exponent held inside the range of a double."""
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-clip(x, -700.0, 700.0)))


def logit(p: Column, eps: float = 1e-9) -> Column:
    p = clip(p, eps, 1.0 - eps)
    return F.log(p / (F.lit(1.0) - p))


def raw_logit(p: Column, eps: float = 1e-9) -> Column:
    """Log-odds with each side floored separately."""
    return F.log(F.greatest(p, F.lit(eps)) / F.greatest(F.lit(1.0) - p, F.lit(eps)))


def binary_entropy(p: Column) -> Column:
    """Bernoulli entropy in bits, clipped away from 0 and 1."""
    p = clip(p, 1e-12, 1.0 - 1e-12)
    q = F.lit(1.0) - p
    return -(p * F.log2(p) + q * F.log2(q))


def pvalue_uncertainty(p: Column, mode: str = "boundary", delta: float = 0.05,
                       tau: float = 1.0) -> Column:
    """Turn a conformal p-value into an uncertainty in [0, 1]."""
    if mode not in MODES:
        raise KeyError(f"unknown p-value uncertainty mode {mode!r}; one of {MODES}")
    if mode == "log" and tau <= 0:
        raise ValueError(f"tau must be positive, got {tau}")
    present = p.isNotNull() & ~F.isnan(p)
    p = clip(p, 1e-12, 1.0 - 1e-12)
    half, one, d = F.lit(0.5), F.lit(1.0), F.lit(float(delta))
    if mode == "entropy":
        value = binary_entropy(p)
    elif mode == "log":
        value = F.exp(-F.abs(F.log(p / d)) / F.lit(float(tau)))
    else:
        if mode == "boundary":
            p = F.when(p <= d, half * p / d).otherwise(half + half * (p - d) / (one - d))
        value = one - F.lit(2.0) * F.abs(p - half)
    return F.when(present, value)


def anomaly_probability(cos_normal: Column, cos_anomaly: Column, tau: float) -> Column:
    """Two-class softmax of cosine similarities at temperature ``tau``."""
    return logistic((cos_anomaly - cos_normal) / F.lit(float(tau)))


def dot(a: Column, b: Column) -> Column:
    """Inner product of two arrays, accumulated in double."""
    return F.aggregate(
        F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")),
        F.lit(0.0), lambda acc, x: acc + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(
        v, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double")))


def l2_normalise(v: Column) -> Column:
    """Unit-length copy of a vector; a vector of length below 1e-8 is divided by 1e-8."""
    length = F.greatest(norm(v), F.lit(1e-8))
    return let(length, lambda n: F.transform(v, lambda x: x.cast("double") / n))


def array_mean(v: Column) -> Column:
    return F.try_divide(F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x), F.size(v))


def array_std(v: Column) -> Column:
    """Population standard deviation of an array (two passes over the array)."""
    return let(v, lambda a: let(array_mean(a), lambda mean: F.sqrt(F.try_divide(F.aggregate(
        a, F.lit(0.0), lambda acc, x: acc + (x - mean) * (x - mean)), F.size(a)))))


def array_range(v: Column) -> Column:
    return F.array_max(v) - F.array_min(v)


def spread(v: Column, stat: str) -> Column:
    """Dispersion over the finite entries of an array; NULL when there are none."""
    if stat not in ("std", "range"):
        raise KeyError(f"unknown stat {stat!r}; 'std' or 'range'")
    kept = F.filter(v, finite)
    return let(kept, lambda a: F.when(
        F.size(a) > 0, array_std(a) if stat == "std" else array_range(a)))


def array_quantile(v: Column, q: float) -> Column:
    """Linearly interpolated quantile of an array."""
    def interpolated(ordered: Column) -> Column:
        position = F.lit(float(q)) * (F.size(ordered) - 1)
        lo = F.element_at(ordered, (F.floor(position) + 1).cast("int")).cast("double")
        hi = F.element_at(ordered, (F.ceil(position) + 1).cast("int")).cast("double")
        return F.when(F.size(ordered) > 0, lo + (hi - lo) * (position - F.floor(position)))

    return let(F.array_sort(v), interpolated)


def log_sum_exp(v: Column) -> Column:
    return let(F.array_max(v), lambda top: top + F.log(F.aggregate(
        v, F.lit(0.0), lambda acc, x: acc + F.exp(x - top))))


def conformal_rank(n: Column, delta: float) -> Column:
    """Rank of the finite-sample-corrected conformal threshold."""
    return F.ceil((n + F.lit(1.0)) * F.lit(1.0 - float(delta)))


def check_delta(deltas: Sequence[float]) -> None:
    for d in deltas:
        if not 0.0 < d < 1.0:
            raise ValueError(f"delta must be in (0, 1), got {d}")


def calibration_sd(n: Column, delta: float) -> Column:
    """Standard deviation of coverage over calibration draws: a Beta(k, n+1-k) law."""
    k = conformal_rank(n, delta).cast("double")
    b = n + F.lit(1.0) - k
    total = k + b
    return F.when((n > 0) & (k <= n), F.sqrt(k * b / (total * total * (total + 1.0))))


def widen(bound: Column, centre: Column, sd: Column, sign: int) -> Column:
    """Fold the calibration-draw sd into a bound, in quadrature."""
    half = F.abs(bound - centre)
    extra = F.lit(1.96) * sd
    wide = clip(centre + F.lit(float(sign)) * F.sqrt(half * half + extra * extra), 0.0, 1.0)
    return F.when(finite(bound) & finite(sd), wide).otherwise(bound)


@F.pandas_udf(T.DoubleType())
def two_sided_p(z: pd.Series) -> pd.Series:
    """Two-sided normal p-value of a z statistic; used on report rows only."""
    return z.map(lambda v: None if v is None or math.isnan(v)
                 else math.erfc(abs(v) / math.sqrt(2.0)))


def on_grid(values: Column, from_h: Column, from_w: Column, h: Column, w: Column) -> Column:
    """A flat image brought to another size by the nearest pixel centre; NULL stays NULL.

    Without ``from_h`` and ``from_w`` the image has to have the size asked for.
    """
    from_h, from_w = F.coalesce(from_h, h), F.coalesce(from_w, w)

    def nearest(p: Column) -> Column:
        r = F.floor((F.floor(p / w) + F.lit(0.5)) * from_h / h)
        c = F.floor((p % w + F.lit(0.5)) * from_w / w)
        return F.get(values, (r * from_w + c).cast("int"))

    cells = F.sequence(F.lit(0), (h * w).cast("int") - 1)
    fits = F.size(values) == from_h * from_w
    return F.when(fits & (from_h == h) & (from_w == w), values).when(
        fits, F.transform(cells, nearest)).when(
        values.isNotNull(), F.raise_error(F.lit("an image does not have the size it claims")).cast("array<tinyint>"))

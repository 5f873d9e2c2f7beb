"""Numeric helper expressions: probabilities, entropies, ratios, p-values."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def clip(c, lo: float, hi: float) -> Column:
    return F.least(F.greatest(_col(c), F.lit(lo)), F.lit(hi))


def safe_prob(c) -> Column:
    """Cast, missing or NaN to 0, clip to [0, 1]."""
    p = F.nanvl(F.coalesce(_col(c).try_cast("double"), F.lit(0.0)), F.lit(0.0))
    return clip(p, 0.0, 1.0)


def safe_logit(c) -> Column:
    p = clip(c, 1e-5, 1 - 1e-5)
    return F.log(p / (1 - p))


def probability_entropy(c) -> Column:
    """Binary entropy in nats."""
    p = clip(c, 1e-6, 1.0 - 1e-6)
    return -(p * F.log(p) + (1 - p) * F.log(1 - p))


def safe_ratio(num, den) -> Column:
    return F.coalesce(F.try_divide(_col(num).cast("double"), _col(den).cast("double")), F.lit(0.0))


def let(value: Column, body) -> Column:
    """Bind an expression once and use it many times in ``body``."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


ERF_SERIES = [(-1) ** n * 2 / math.sqrt(math.pi) / (math.factorial(n) * (2 * n + 1)) for n in range(40)]


def erfc(c) -> Column:
    """Complementary error function for x >= 0, to about 1e-12.

    Power series below 2.5, continued fraction above.
    """

    def body(x: Column) -> Column:
        s = x * x
        poly = F.lit(ERF_SERIES[-1])
        for coef in reversed(ERF_SERIES[:-1]):
            poly = poly * s + F.lit(coef)
        frac = x
        for k in range(40, 0, -1):
            frac = x + F.lit(k / 2.0) / frac
        return F.when(x < 2.5, 1.0 - x * poly).otherwise(F.exp(-s) / (frac * F.lit(math.sqrt(math.pi))))

    return let(_col(c).cast("double"), body)


def two_sided_p(z) -> Column:
    return erfc(F.abs(_col(z)) / F.lit(math.sqrt(2.0)))


def r6(c) -> Column:
    return F.round(_col(c), 6)

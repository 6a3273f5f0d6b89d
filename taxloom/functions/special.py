"""Special functions as plain columns: logarithm of the gamma function, incomplete beta, tails of the binomial distribution.

No tables and no Python on the executors; the work of a value grows with the square root of its parameters.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Coefficients of the Stirling series: fixed values.
STIRLING = (1 / 12, -1 / 360, 1 / 1260, -1 / 1680, 1 / 1188)
#: Arguments are lifted by this many steps, to where the series has some 13 digits.
LIFT = 8


def log_gamma(x: Column) -> Column:
    """The logarithm of the gamma function of a positive number."""
    z = x + LIFT
    low = F.ln(reduce(lambda a, b: a * b, [x + i for i in range(LIFT)]))
    series = sum((c / F.pow(z, F.lit(2 * i + 1)) for i, c in enumerate(STIRLING)), F.lit(0.0))
    return (z - 0.5) * F.ln(z) - z + 0.5 * math.log(2 * math.pi) + series - low


def _fraction(x: Column, a: Column, b: Column) -> Column:
    """The continued fraction of the incomplete beta function, from its far end."""
    terms = (20 + 5 * F.ceil(F.sqrt(F.greatest(a, b)))).cast("int")

    def step(t: Column, m: Column) -> Column:
        # the odd and the even coefficient of one place
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        even = F.when(m > 0, m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))).otherwise(0.0)
        inner = 1 + odd / t
        return F.when(m > 0, 1 + even / inner).otherwise(inner)

    return F.aggregate(F.sequence(terms, F.lit(0), F.lit(-1)), F.lit(1.0), lambda t, m: step(t, m.cast("double")))


def beta_cdf(x: Column | float, a: Column, b: Column) -> Column:
    """The probability of at most ``x`` under the beta distribution with ``a`` and ``b`` above 0: 0 below 0 and 1 from 1 on."""
    x, a, b = F.lit(x).cast("double") if not isinstance(x, Column) else x.cast("double"), a.cast("double"), b.cast("double")
    inside = (x > 0) & (x < 1)
    near = x < (a + 1) / (a + b + 2)
    p, q, y = F.when(near, a).otherwise(b), F.when(near, b).otherwise(a), F.when(near, x).otherwise(1 - x)
    front = F.exp(log_gamma(a + b) - log_gamma(a) - log_gamma(b) + p * F.ln(y) + q * F.ln(1 - y)) / p
    part = front / _fraction(y, p, q)
    return F.when(x <= 0, 0.0).when(x >= 1, 1.0).when(inside, F.when(near, part).otherwise(1 - part))


def binomial_cdf(k: Column, n: Column, p: float) -> Column:
    """The probability of at most ``k`` hits in ``n`` draws of probability ``p``."""
    return F.when(k < 0, 0.0).when(k >= n, 1.0).otherwise(beta_cdf(1 - p, n - k, k + 1))

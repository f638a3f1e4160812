"""The normal distribution as built-in expressions, and its driver-side inverse."""

from __future__ import annotations

import math
from statistics import NormalDist

from pyspark.sql import Column, functions as F

#: Hart's (1968) rational approximation 5666 of the normal tail, from the highest power down.
TAIL_ABOVE = (3.52624965998911e-02, 0.700383064443688, 6.37396220353165, 33.912866078383, 112.079291497871, 221.213596169931, 220.206867912376)
TAIL_BELOW = (8.83883476483184e-02, 1.75566716318264, 16.064177579207, 86.7807322029461, 296.564248779674, 637.333633378831, 793.826512519948, 440.413735824752)
#: From here on a continued fraction takes over.
FAR = 7.07106781186547


def _poly(coefficients: tuple[float, ...], x: Column) -> Column:
    out = F.lit(coefficients[0])
    for c in coefficients[1:]:
        out = out * x + c
    return out


def norm_cdf(z: Column) -> Column:
    """Probability below ``z``, to about 14 digits; no Python runs in it."""
    x = F.abs(z)
    near = _poly(TAIL_ABOVE, x) / _poly(TAIL_BELOW, x)
    far = x + 0.65
    for k in (4, 3, 2, 1):
        far = x + k / far
    tail = F.when(x > 37, 0.0).otherwise(F.exp(-x * x / 2) * F.when(x < FAR, near).otherwise(1 / (far * 2.506628274631)))
    return F.when(z.isNotNull(), F.when(z > 0, 1 - tail).otherwise(tail))


#: Hastings' (1955) first guess of a quantile from sqrt(-2 ln q), numerator and denominator from the highest power down.
GUESS_ABOVE = (0.010328, 0.802853, 2.515517)
GUESS_BELOW = (0.001308, 0.189269, 1.432788, 1.0)


def norm_upper(q: Column) -> Column:
    """The value that a normal variate exceeds with probability ``q``, for 0 < q <= 1/2, to 10 digits or more: a first guess and Newton's steps."""
    t = F.sqrt(-2 * F.log(q))
    guess = F.transform(F.array(t), lambda x: x - _poly(GUESS_ABOVE, x) / _poly(GUESS_BELOW, x))
    density = lambda z: F.exp(-z * z / 2) / math.sqrt(2 * math.pi)
    return F.aggregate(F.array(*(F.lit(0) for _ in range(4))), F.get(guess, F.lit(0)), lambda z, _: z + (norm_cdf(-z) - q) / density(z))


def norm_ppf(p: float) -> float:
    return NormalDist().inv_cdf(p)


def psr_argument(sharpe: Column, n: Column, skew: Column, kurt: Column, benchmark: float | Column = 0.0) -> Column:
    """Argument of the probabilistic Sharpe ratio, kurtosis not in excess; NULL below three rows."""
    below = 1 - skew * sharpe + (kurt - 1) / 4 * sharpe * sharpe
    return F.when((n >= 3) & (below > 0), (sharpe - benchmark) * F.sqrt(n - 1) / F.sqrt(below))

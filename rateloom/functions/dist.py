"""Distributions of counts and amounts: fits and probabilities as column expressions.

A fitted distribution is (family, a, b): ``nb`` (r, p), ``poisson`` (rate, unit), ``bernoulli`` (p, -). Lines are beaten
strictly: P(over line) = P(X > line).
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from . import laws

FLOOR, LEAST_ALPHA, MOST_ALPHA, OVERDISPERSED = 1.05, 1e-3, 1e4, 1.3


def alpha_from_moments(mean: Column, variance: Column, floor: float = 0.02) -> Column:
    """Over-dispersion (v - m) / m²; at least ``floor``; null without a positive mean."""
    return F.when(mean > 0, F.greatest(F.lit(floor), (variance - mean) / (mean * mean)))


def variance_at(mean: Column, alpha: Column, scale: Column) -> Column:
    return F.greatest(F.lit(FLOOR) * mean, (mean + alpha * mean * mean) * scale)


def nb_r(mean: Column, variance: Column) -> Column:
    v = F.greatest(variance, FLOOR * mean)
    return 1 / F.least(F.lit(MOST_ALPHA), F.greatest(F.lit(LEAST_ALPHA), (v - mean) / (mean * mean)))


def nb_p(mean: Column, variance: Column) -> Column:
    r = nb_r(mean, variance)
    return r / (r + mean)


def count_family(mean: Column, variance: Column) -> Column:
    """Negative binomial above a variance ratio of 1.3 (exclusive), else Poisson. The ratio is taken to 12 digits: whether one of
    exactly 1.3 comes out a bit larger depends on the order of a sum."""
    return F.when(F.round(variance / F.nullif(mean, F.lit(0.0)), 12) > OVERDISPERSED, F.lit("nb")).otherwise(F.lit("poisson"))


def anytime(rate: Column) -> Column:
    """Chance of at least one event."""
    return 1 - F.exp(-rate)


def mixture_mean(p: Column, s: Column, mean: Column) -> Column:
    return p * s * mean


def mixture_variance(p: Column, s: Column, mean: Column, variance: Column) -> Column:
    """Of a share s of X with probability p, else 0."""
    return p * (s * s * variance + s * s * mean * mean) - F.pow(p * s * mean, F.lit(2))


def pmf_table(family: str, a: float, b: float) -> np.ndarray:
    """Probabilities of 0, 1, 2 ... until the rest is negligible (below 1e-9), in plain Python: what the expressions are tested against."""
    if family == "bernoulli":
        return np.array([1 - a, a])
    mean, sd = (a, math.sqrt(a)) if family == "poisson" else (a * (1 - b) / b, math.sqrt(a * (1 - b)) / b)
    n = int(mean + 12 * sd + 40 + (0 if family == "poisson" else 30 / -math.log1p(-b)))
    if family == "poisson":
        return np.array([math.exp(k * math.log(max(a, 1e-300)) - a - math.lgamma(k + 1)) for k in range(n)])
    return np.array([math.exp(math.lgamma(k + a) - math.lgamma(a) - math.lgamma(k + 1) + a * math.log(b) + k * math.log1p(-b)) for k in range(n)])


def law(family: str, a: str, b: str) -> tuple[Column, laws.Ratio]:
    """The law of a row: ``nb`` (r, p), ``poisson`` (rate, unit) or ``bernoulli`` (p, -)."""
    f, x, y = F.col(family), F.col(a), F.col(b)
    nb, poisson = laws.negative_binomial(x, y), laws.poisson(x)
    one = F.ln(F.greatest(1 - x, F.lit(laws.TINY)))
    ratio = lambda k: F.when(f == "nb", nb[1](k)).when(f == "poisson", poisson[1](k)).when(k == 1, F.ln(F.greatest(x, F.lit(laws.TINY))) - one).otherwise(F.lit(-1e9))
    return F.when(f == "nb", nb[0]).when(f == "poisson", poisson[0]).otherwise(one), ratio


def unit_of(family: str, b: str) -> Column:
    return F.when((F.col(family) == "poisson") & (F.col(b) > 0), F.col(b)).otherwise(F.lit(1.0))


def p_over(family: str, a: str, b: str, line: Column | str) -> Column:
    """P(X > line). A Poisson with a unit counts units: the line is turned into whole units."""
    line = F.col(line) if isinstance(line, str) else line
    return laws.over(line / unit_of(family, b), law(family, a, b))


def quantiles(family: str, a: str, b: str, levels: Sequence[float]) -> Column:
    """The smallest values whose cumulative probabilities reach the levels, as an array."""
    f, x, y = F.col(family), F.col(a), F.col(b)
    mean = F.when(f == "nb", x * (1 - y) / y).otherwise(x)
    variance = F.when(f == "nb", x * (1 - y) / (y * y)).otherwise(x)
    return F.transform(laws.quantiles(levels, law(family, a, b), mean, variance), lambda q: q * unit_of(family, b))


def longest_over(n: Column, tail: Column) -> Column:
    """P(the largest of a Poisson(n) number of values exceeds a line), where one value exceeds it with probability ``tail``."""
    return 1 - F.exp(-n * tail)

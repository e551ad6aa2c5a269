"""Statistical column expressions that stay inside Spark.

Spark has no ``erf``.  Craig's form (J. W. Craig, 1991; erfc(x) = 2/pi times the
integral of exp(-x^2 / sin^2 t) over 0..pi/2) has a smooth periodic integrand,
so the midpoint rule converges to full precision, far into the tail as well:
there is no subtraction and no fitted table.  It is column arithmetic on the
one row of a test's counts.
"""

from __future__ import annotations

from statistics import NormalDist

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Midpoints of the rule; 256 give about 15 digits up to x = 10 and 7 or more up to where erfc underflows.
MIDPOINTS = 256


def erfc_nonneg(x: Column) -> Column:
    """erfc(x) for x >= 0."""
    step = F.lit(3.141592653589793 / 2 / MIDPOINTS)
    total = F.aggregate(
        F.sequence(F.lit(0), F.lit(MIDPOINTS - 1)), F.lit(0.0),
        lambda acc, k: acc + F.exp(-(x * x) / F.pow(F.sin((k.cast("double") + F.lit(0.5)) * step), F.lit(2.0))))
    return total / F.lit(float(MIDPOINTS))


def two_sided_p(z: Column) -> Column:
    """2 * (1 - Phi(|z|)) = erfc(|z| / sqrt 2)."""
    return erfc_nonneg(F.abs(z) / F.lit(2.0 ** 0.5))


def normal_cdf(z: Column) -> Column:
    """Phi(z)."""
    tail = F.lit(0.5) * erfc_nonneg(F.abs(z) / F.lit(2.0 ** 0.5))
    return F.when(z >= 0, F.lit(1.0) - tail).otherwise(tail)


def chi2_sf_dof1(stat: Column) -> Column:
    """Upper tail of chi-square with one degree of freedom: erfc(sqrt(x / 2))."""
    return erfc_nonneg(F.sqrt(F.greatest(stat, F.lit(0.0)) / F.lit(2.0)))


def z_quantile(p: float) -> float:
    """Normal quantile, computed once on the driver for a scalar parameter."""
    return NormalDist().inv_cdf(p)

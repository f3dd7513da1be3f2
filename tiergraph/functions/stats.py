"""Student-t p-values as column arithmetic."""

from __future__ import annotations

import functools
import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

# The density is flat zero beyond this distance, in units of its width.
REACH = 40.0
PANELS, POINTS = 64, 8


@functools.cache
def _nodes() -> str:
    """Places in [0, 1] and weights of a composite Gauss-Legendre rule, as one literal.

    A thousand calls that build it part by part would take longer than the statistics.
    """
    at, weight = np.polynomial.legendre.leggauss(POINTS)
    rows = (
        f"named_struct('x', {(panel + (x + 1) / 2) / PANELS!r}D, 'w', {w / 2 / PANELS!r}D)"
        for panel in range(PANELS)
        for x, w in zip(at.tolist(), weight.tolist())
    )
    return f"array({', '.join(rows)})"


def _area(nu: Column, low: Column, high: Column) -> Column:
    """Integral of cos(u / sqrt(nu)) ** (nu - 1) between two places."""
    nodes = F.expr(_nodes())

    def density(x: Column) -> Column:
        half = F.sin((low + (high - low) * x) / F.sqrt(nu) / 2)
        return F.exp((nu - 1) * F.log1p(-2 * half * half))

    total = F.aggregate(nodes, F.lit(0.0), lambda acc, n: acc + n["w"] * density(n["x"]))
    return (high - low) * total


def _two_sided(nu: Column, t: Column) -> Column:
    """P(|T| > t): with T = sqrt(nu) tan(u / sqrt(nu)), the share of the area beyond t.

    One quadrature serves every number of degrees of freedom.
    """
    end = F.least(F.sqrt(nu) * (math.pi / 2), F.lit(REACH))
    start = F.least(F.sqrt(nu) * F.atan(t / F.sqrt(nu)), end)
    return _area(nu, start, end) / _area(nu, F.lit(0.0), end)


def t_test_p(n: Column, mean: Column, sd: Column) -> Column:
    """Two-sided p-value of a mean against zero; null for fewer than two values.

    Without any spread the result is 0 for a non-zero mean and null otherwise.
    """
    nu = (n - 1).cast("bigint")
    t = F.abs(mean) / F.nullif(sd / F.sqrt(n.cast("double")), F.lit(0.0))
    p = _two_sided(nu.cast("double"), t)
    return (
        F.when(n < 2, F.lit(None).cast("double"))
        .when((sd == 0.0) & (mean != 0.0), F.lit(0.0))
        .when(sd == 0.0, F.lit(None).cast("double"))
        .otherwise(F.greatest(p, F.lit(0.0)))
    )

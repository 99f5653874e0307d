"""Student's t distribution as column expressions, for the one-row results of a fit.

With ``u = sqrt(dof) * tan(a)`` the two-sided tail beyond ``t`` is ``S(atan(t / sqrt(dof))) / S(0)``, where ``S(a)`` is
the integral of ``cos^(dof - 1)`` from ``a`` to the right angle. Simpson's rule evaluates it up to the point where
the integrand has lost a factor of ``exp(40)``. No gamma function is needed, and no Python worker.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

STEPS = 2000      # even number of Simpson intervals
HALVINGS = 60     # of the bisection for a quantile


def _tail(angle: Column, dof: Column) -> Column:
    power = dof - 1.0
    reach = F.sqrt(angle * angle + F.lit(80.0) / F.greatest(power, F.lit(1e-9)))
    width = (F.least(F.lit(math.pi / 2), reach) - angle) / float(STEPS)

    def weighted(total: Column, i: Column) -> Column:
        weight = F.when((i == 0) | (i == STEPS), 1.0).when(i % 2 == 1, 4.0).otherwise(2.0)
        return total + weight * F.exp(power * F.log(F.cos(angle + width * i)))

    return F.aggregate(F.sequence(F.lit(0), F.lit(STEPS)), F.lit(0.0), weighted) * width / 3.0


def p_value(t: Column, dof: Column) -> Column:
    """Probability of a value at least as far from 0 as ``t``."""
    return F.when(dof > 0, _tail(F.atan(F.abs(t) / F.sqrt(dof)), dof) / _tail(F.lit(0.0), dof))


def t_quantile(two_sided: float, dof: Column) -> Column:
    """The ``t`` whose two-sided tail probability is ``two_sided``, by bisection on the angle."""
    target = _tail(F.lit(0.0), dof) * two_sided

    def halve(span: Column, _: Column) -> Column:
        mid = (span["lo"] + span["hi"]) / 2.0
        beyond = _tail(mid, dof) > span["target"]
        return F.struct(F.when(beyond, mid).otherwise(span["lo"]).alias("lo"),
                        F.when(beyond, span["hi"]).otherwise(mid).alias("hi"), span["target"].alias("target"))

    start = F.struct(F.lit(0.0).alias("lo"), F.lit(math.pi / 2).alias("hi"), target.alias("target"))
    last = F.aggregate(F.sequence(F.lit(1), F.lit(HALVINGS)), start, halve,
                       lambda span: F.tan((span["lo"] + span["hi"]) / 2.0))
    return F.when(dof > 0, last * F.sqrt(dof))

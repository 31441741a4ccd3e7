"""Conditional column rules: ladders of bands, two-way branches, clamps and domains."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from stepframe.functions.missing import _col, _val, missing_gt, missing_lt


def strictly_between(c, low, high, missing_low: bool = True) -> Column:
    """The chained comparison ``low < c < high``; both bounds are excluded."""
    c = _col(c)
    if missing_low:
        return missing_gt(c, low) & missing_lt(c, high)
    return (c > _val(low)) & (c < _val(high))


def band_ladder(c, bounds: Sequence[float], values: Sequence, missing_low: bool = True) -> Column:
    """Band number by strict bounds: below the first, between neighbours, above the last.

    A value equal to a bound is in no band and stays missing.  With ``missing_low`` a missing
    value falls in the first band.  ``values`` has one entry more than ``bounds``.
    """
    if len(values) != len(bounds) + 1:
        raise ValueError("a ladder needs one value more than it has bounds")
    c = _col(c)
    lowest = missing_lt(c, bounds[0]) if missing_low else c < bounds[0]
    ladder = F.when(lowest, F.lit(values[0]))
    for low, high, value in zip(bounds, bounds[1:], values[1:]):
        ladder = ladder.when((c > low) & (c < high), F.lit(value))
    return ladder.when(c > bounds[-1], F.lit(values[-1]))


def binary_branch(condition: Column, if_true: str, if_false: str) -> Column:
    """Two-way text branch; the first literal fixes the width, a missing test takes the second."""
    width = len(if_true)
    return F.when(condition, F.lit(if_true)).otherwise(F.lit(if_false[:width]))


def ifc(condition: Column, if_true, if_false) -> Column:
    """Text conditional; a test that is NULL counts as false."""
    return F.when(condition, _val(if_true)).otherwise(_val(if_false))


def clamp(c, low, high) -> Column:
    """Value held inside ``[low, high]``; a missing value stays missing."""
    c = _col(c)
    return F.when(c.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), c)))


def in_domain(c, domain: Sequence[str]) -> Column:
    """True where a non-missing value is one of the allowed ones; never NULL."""
    return F.coalesce(_col(c).isin(list(domain)), F.lit(False))


def has_text(c) -> Column:
    """Flag for "some text is stored here"; an empty or missing text gives false."""
    return F.length(F.coalesce(_col(c), F.lit(""))) > 0


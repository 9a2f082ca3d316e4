"""Air-quality index as native column expressions.

The index is a step function of a truncated concentration, so single-precision
arithmetic is part of its definition: every literal and every intermediate value
below is FLOAT, and divisions (which Spark evaluates in double) are cast back.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hazemeter.functions import sums
from hazemeter.params import DEFAULTS

# Concentration (µg/m³) → index, for particles below 2.5 µm.
PM25_BREAKPOINTS = (
    (0.0, 0), (12.0, 50),
    (12.1, 51), (35.4, 100),
    (35.5, 101), (55.4, 150),
    (55.5, 151), (150.4, 200),
    (150.5, 201), (250.4, 300),
    (250.5, 301), (350.4, 400),
    (350.5, 401), (500.4, 500),
    (500.5, 501), (99999.9, 999),
)

# Concentration (µg/m³) → index, for particles below 10 µm.
PM10_BREAKPOINTS = (
    (0.0, 0), (54.0, 50),
    (55.0, 51), (154.0, 100),
    (155.0, 101), (254.0, 150),
    (255.0, 151), (354.0, 200),
    (355.0, 201), (424.0, 300),
    (425.0, 301), (504.0, 400),
    (505.0, 401), (604.0, 500),
    (605.0, 501), (99999.0, 999),
)


def f32(value: float | Column) -> Column:
    """FLOAT literal or cast."""
    return (value if isinstance(value, Column) else F.lit(float(value))).cast("float")


def round_half_up(value: Column) -> Column:
    """Nearest integer, halves towards positive infinity (``F.round`` differs below zero)."""
    return F.floor(value.cast("double") + F.lit(0.5))


def milli(value: Column) -> Column:
    """Value in thousandths as INT."""
    return round_half_up(value.cast("double") * F.lit(1000.0)).cast("int")


def _single(value: object) -> str:
    return f"cast({value} as float)"


def piecewise(value: str, breakpoints: tuple[tuple[float, int], ...]) -> Column:
    """Linear interpolation between ``breakpoints``, flat outside, rounded half up to INT.

    ``value`` is a FLOAT column name or SQL expression. It occurs in every branch,
    so it should be a column where rows are many.
    """
    return F.expr(_piecewise(value, breakpoints))


def _piecewise(value: str, breakpoints: tuple[tuple[float, int], ...]) -> str:
    (x_first, y_first), (x_last, y_last) = breakpoints[0], breakpoints[-1]
    branches = [f"when {value} <= {_single(x_first)} then {_single(y_first)}"]
    for (x0, y0), (x1, y1) in zip(breakpoints, breakpoints[1:]):
        slope = np.float32(y1 - y0) / (np.float32(x1) - np.float32(x0))
        line = f"{_single(slope)} * ({value} - {_single(x0)}) + {_single(y0)}"
        branches.append(f"when {value} <= {_single(x1)} then {line}")
    branches.append(f"when {value} > {_single(x_last)} then {_single(y_last)}")
    return f"cast(floor(cast(case {' '.join(branches)} end as double) + 0.5D) as int)"


def tenths(value: str) -> str:
    """SQL expression: value truncated to tenths, in single precision."""
    return _single(f"{_single(f'floor({_single(value)} * {_single(10)})')} / {_single(10)}")


def whole(value: str) -> str:
    """SQL expression: value truncated to a whole number, in single precision."""
    return _single(f"floor({_single(value)})")


def aqi_pm25(value: str) -> Column:
    """Index of a PM2.5 mean, truncated to tenths."""
    return piecewise(tenths(value), PM25_BREAKPOINTS)


def aqi_pm10(value: str) -> Column:
    """Index of a PM10 mean, truncated to whole numbers."""
    return piecewise(whole(value), PM10_BREAKPOINTS)


def aqi_combined(pm25: str, pm10: str) -> Column:
    return F.greatest(aqi_pm25(pm25), aqi_pm10(pm10))


def is_good(aqi: Column, good_max: int = DEFAULTS.good_max) -> Column:
    """Good air; the "no data" index -1 is not good."""
    return aqi.between(0, good_max)


def with_index(df: DataFrame) -> DataFrame:
    """Replaces the SUMS of P1 (PM10) and P2 (PM2.5) by ``aqi``, ``aqi_p1``, ``aqi_p2``.

    The truncated means become columns first: the branches of the index then refer
    to a column instead of repeating the division. An infinite mean has the last index, or the first.
    """
    return (
        df.withColumns({
            "_v10": F.expr(whole(sums.mean(sums.nearest(1), "i1", "n"))),
            "_v25": F.expr(tenths(sums.mean(sums.nearest(2), "i2", "n"))),
        })
        .withColumns({
            "aqi_p1": piecewise("_v10", PM10_BREAKPOINTS),
            "aqi_p2": piecewise("_v25", PM25_BREAKPOINTS),
        })
        .withColumn("aqi", F.greatest("aqi_p1", "aqi_p2"))
        .drop(*sums.SUMS, "_v10", "_v25")
    )


def agg_aqi(p1: str, p2: str) -> Column:
    """Aggregate: combined index of the group's mean P1 (PM10) and mean P2 (PM2.5)."""
    coarse, fine = (sums.mean(sums.total(p), sums.beyond(p), "count(1)") for p in (p1, p2))
    means = f"named_struct('coarse', {whole(coarse)}, 'fine', {tenths(fine)})"
    # The means are bound to a name, for every branch of an index needs them.
    index = f"greatest({_piecewise('m.fine', PM25_BREAKPOINTS)}, {_piecewise('m.coarse', PM10_BREAKPOINTS)})"
    return F.expr(f"transform(array({means}), m -> {index})[0]")

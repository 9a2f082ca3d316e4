"""The two standing questions as batch jobs over located readings."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hazemeter.operators.batches import (
    flat_headers, flatten_batches, ingest, nested_headers, valid_readings, watermark_guard,
)
from hazemeter.operators.geo import point_in_polygon, with_city
from hazemeter.operators.improve import aqi_improvement, for_every_batch, top_improvements
from hazemeter.operators.probes import active_probes, arrivals_of_cells, drop_late, late_bounds
from hazemeter.operators.slices import slice_cells, slices_of_cells
from hazemeter.operators.streaks import streak_at_watermark, streak_histogram
from hazemeter.operators.windows import aqi5d, aqi24_all, aqi24_at_watermark, aqi24_snapshots
from hazemeter.params import DEFAULTS, Params
from hazemeter.schema import CURRENT
from hazemeter.session import counted, together, written


@dataclass(frozen=True)
class Timely:
    """What both questions start from: readings without the late ones, and the probes.

    ``batches`` has every batch, ``headers`` those that ask questions.
    """

    batches: DataFrame
    headers: DataFrame
    readings: DataFrame
    probes: DataFrame
    slices: DataFrame
    params: Params

    def at_watermark(self) -> DataFrame:
        return aqi24_at_watermark(
            self.readings, self.slices, self.probes, self.params, unseen=False
        )


def timely(
    readings: DataFrame, headers: DataFrame | None = None, params: Params = DEFAULTS
) -> Timely:
    """Derives probes, drops late readings and sums the slices.

    The readings are scanned once for the cells; everything else here works on
    tables with a row per batch, per city and batch, or per city and slice. Without
    ``headers`` the batch watermarks are those of the readings given.
    """
    readings = valid_readings(readings)
    given = [] if headers is None else [lambda: written(headers, "headers")]
    cells, *given = together(lambda: written(slice_cells(readings, params), "cells"), *given)
    arrived = written(arrivals_of_cells(cells), "arrivals")
    every = given[0] if given else flat_headers(arrived, "last_ts", "last_pos")
    headers = watermark_guard(every, params)
    probes = written(active_probes(arrived, headers, params), "probes")
    late, n_late = counted(late_bounds(arrived, probes, params), "late")
    kept = drop_late(readings, late) if n_late else readings
    slices = slices_of_cells(cells, readings, late if n_late else None, params)
    return Timely(every, headers, kept, probes, written(slices, "slices"), params)


def timely_batches(
    batches: DataFrame, locations: DataFrame, params: Params = DEFAULTS, start: int = 0, n: int | None = None
) -> Timely:
    """``timely`` for nested batches, with cities from geometry.

    The city of each distinct coordinate is found once and written, and so are the located readings: all later passes
    read that table, narrow and without the raw arrays.
    """
    taken = ingest(batches, start, n)
    readings = flatten_batches(taken, params)
    lookup = written(point_in_polygon(readings, locations), "lookup")
    located = written(with_city(readings, lookup).drop("lat", "lon"), "located")
    return timely(located, nested_headers(taken, params), params)


def improvements(base: Timely, values: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """Improvement per batch and city; ``values`` are the tables of snapshots and watermark values if they exist already."""
    snapshots, at_watermark = values or (
        aqi24_snapshots(base.slices, base.params), written(base.at_watermark(), "at-watermark")
    )
    return aqi_improvement(aqi5d(snapshots, at_watermark, base.params))


def q1(base: Timely, values: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """Most improved cities after each batch."""
    return top_improvements(improvements(base, values), base.params.k)


def q1_results(base: Timely, values: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """``q1`` with a row of nulls for every batch without any improved city."""
    return for_every_batch(base.batches, q1(base, values))


def current_streaks(base: Timely, values: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """Streaks of this year's values; last year's readings are not touched."""
    now = F.col("period") == CURRENT
    if values:
        snapshots, at_watermark = (v.where(now) for v in values)
    else:
        slices = base.slices.where(now)
        only_now = replace(
            base, readings=base.readings.where(now), probes=base.probes.where(now), slices=slices
        )
        snapshots, at_watermark = aqi24_snapshots(slices, base.params), only_now.at_watermark()
    return streak_at_watermark(aqi24_all(snapshots, at_watermark), base.params)


def q2(base: Timely, values: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """Histogram of good-air streaks after each batch."""
    return streak_histogram(base.headers, current_streaks(base, values), base.params)


def q2_results(base: Timely, values: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """``q2`` with a row of nulls for every batch that asks nothing."""
    return for_every_batch(base.batches, q2(base, values))


def both(base: Timely) -> tuple[DataFrame, DataFrame]:
    """Both questions, a result for every batch, from one table of snapshots and one of watermark values."""
    values = tuple(together(
        lambda: written(aqi24_snapshots(base.slices, base.params), "snapshots"),
        lambda: written(base.at_watermark(), "at-watermark"),
    ))
    return q1_results(base, values), q2_results(base, values)

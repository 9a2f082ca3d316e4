"""Tunable constants of the two standing questions, all in milliseconds."""

from __future__ import annotations

from dataclasses import dataclass

SECOND = 1_000
MINUTE = 60 * SECOND
HOUR = 60 * MINUTE
DAY = 24 * HOUR


@dataclass(frozen=True)
class Params:
    step_ms: int = 5 * MINUTE  # slice width and slide of both windows
    window_ms: int = DAY  # averaging window of the AQI
    mean_ms: int = 5 * DAY  # window of the mean over AQI snapshots
    active_ms: int = 10 * MINUTE  # a city is active this long after a reading
    origin_ms: int = 0  # grid origin of the slices
    shift_ms: int = 365 * DAY  # last year is moved forward by this much
    nanos_divisor: int = 1_000_000  # 1_000 keeps the original time conversion
    k: int = 50  # size of the improvement ranking
    good_max: int = 50  # highest AQI that counts as good air
    buckets: int = 14  # bars of the streak histogram
    streak_cap_ms: int = 7 * DAY  # longest streak the histogram tells apart
    histogram_origin_ms: int = 1_585_699_200_000  # 2020-04-01: width grows from here
    legacy_overflow: bool = False  # count capped streaks outside the last bar
    max_watermark_ms: int = 1_898_553_600_000  # larger watermarks mean end of data

    def __post_init__(self) -> None:
        for name in ("window_ms", "mean_ms"):
            if getattr(self, name) % self.step_ms:
                raise ValueError(f"{name} must be a multiple of step_ms")


DEFAULTS = Params()

"""Error rates of services on a stream: spikes against a baseline, shifts against the window before.

Windows are Spark's event-time windows, closed by the watermark and summed within tasks before they are shuffled. A
closed window comes once, after all earlier ones of its service, so per service a ring of the last rates is all the
state there is. Windows without events have no row, as in batch. Events later than ``delay`` are dropped.
A window closes when an event of a later batch, of any service, is past its end by ``delay``.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from faultline.operators import anomalies

_SCORED = ("service string, window_start timestamp, total bigint, errors bigint, critical bigint, rate double, previous double, "
           "baseline_windows bigint, baseline double, spread double")


def _mean_and_spread(rates: Sequence[float]) -> tuple[float | None, float | None]:
    """Mean and sample deviation, added up in the order and form of Spark's own aggregates."""
    mean = squares = 0.0
    for n, rate in enumerate(rates, 1):
        delta = rate - mean
        mean += delta / n
        squares += delta * (delta - delta / n)
    n = len(rates)
    return sum(rates) / n if n else None, math.sqrt(squares / (n - 1)) if n > 1 else None


class _Ring(StatefulProcessor):
    """The last rates of a service; each closed window is scored against them."""

    def __init__(self, length: int) -> None:
        self._length = length

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._rates = handle.getListState("rates", T.StructType([T.StructField("rate", T.DoubleType())]))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        past = [r[0] for r in self._rates.get()] if self._rates.exists() else []
        out = []
        for w in pd.concat(list(rows)).sort_values("window_start").itertuples():
            rate = w.errors / w.total
            mean, spread = _mean_and_spread(past)
            out.append((key[0], w.window_start, w.total, w.errors, w.critical, rate, past[-1] if past else None, len(past), mean, spread))
            past = [*past, rate][-self._length:]
        self._rates.put([(rate,) for rate in past])
        names = [column.split()[0] for column in _SCORED.split(", ")]
        yield pd.DataFrame(out, columns=names).astype({"previous": "float64", "baseline": "float64", "spread": "float64"})

    def close(self) -> None:
        pass


def scored_windows(events: DataFrame, width: str = "1 hour", delay: str = "10 minutes", baseline_windows: int = 24) -> DataFrame:
    """Every closed window of a service with its rate, the rate before, and its baseline."""
    closed = anomalies.hourly_rates(events.withWatermark("ts", delay), width)
    return closed.groupBy("service").transformWithStateInPandas(
        statefulProcessor=_Ring(baseline_windows), outputStructType=_SCORED, outputMode="Append", timeMode="None")


def error_rate_spikes(events: DataFrame, width: str = "1 hour", delay: str = "10 minutes", baseline_windows: int = 24,
                      min_baseline: int = 3, deviations: float = 3.0, min_errors: int = 2) -> DataFrame:
    """What the batch operator of this name gives, window by window as they close."""
    return anomalies.judged_rates(scored_windows(events, width, delay, baseline_windows), min_baseline, deviations, min_errors)


def severity_shift(events: DataFrame, width: str = "1 hour", delay: str = "10 minutes", min_rise: float = 0.25, min_errors: int = 3) -> DataFrame:
    """What the batch operator of this name gives, window by window as they close."""
    rated = scored_windows(events, width, delay, 1)
    shares = rated.withColumns({"share": F.round("rate", 6), "previous_share": F.round("previous", 6)})
    return anomalies.judged_shares(shares, min_rise, min_errors)

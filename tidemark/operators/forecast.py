"""A dense daily series: calendar, lags, rolling statistics, holdouts, metrics, recursion."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def daily_series(rows: DataFrame, day: str, value: str) -> DataFrame:
    """One row per calendar day from first to last; days without rows are 0."""
    summed = rows.filter(F.col(day).isNotNull()).groupBy(F.to_date(day).alias("d")).agg(F.sum(value).cast("double").alias("y"))
    span = summed.agg(F.min("d").alias("a"), F.max("d").alias("b")).filter("a is not null").select(F.explode(F.sequence("a", "b")).alias("d"))
    return span.join(summed, "d", "left").select("d", F.coalesce("y", F.lit(0.0)).alias("y"))


def series_features(series: DataFrame, lags: Sequence[int] = (1, 2, 3, 7), windows: Sequence[int] = (3, 7)) -> DataFrame:
    """Calendar, lag and rolling features of a dense series; rows that lack a lag are dropped.

    Rolling statistics see the days before only: the mean needs one of them, the sample
    deviation two, else 0.  The window is over one row per day.
    """
    w = Window.partitionBy(F.lit(0)).orderBy("d")
    angle = F.weekday("d") * (2 * math.pi / 7)
    out = series.withColumns({"day_of_week": F.weekday("d"), "is_weekend": (F.weekday("d") >= 5).cast("int"), "dow_sin": F.sin(angle), "dow_cos": F.cos(angle), "day_of_month": F.dayofmonth("d")})
    out = out.withColumns({f"lag_{k}": F.lag("y", k).over(w) for k in lags})
    before = {n: w.rowsBetween(-n, -1) for n in windows}
    out = out.withColumns({**{f"rolling_mean_{n}": F.avg("y").over(f) for n, f in before.items()}, **{f"rolling_std_{n}": F.coalesce(F.stddev_samp("y").over(f), F.lit(0.0)) for n, f in before.items()}})
    return out.dropna(subset=[f"lag_{k}" for k in lags])


def horizons(n: int, asked: int) -> int:
    """Days of each holdout; both must leave a week to learn from."""
    h = min(asked, max(3, n // 5))
    if n - 2 * h < 7:
        raise ValueError(f"{n} days are too few for two holdouts of {h}")
    return h


def holdouts(series: DataFrame, asked: int) -> DataFrame:
    """``split``: the last h days test, the h before validation, the rest train."""
    n = series.count()
    h = horizons(n, asked)
    i = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("d"))
    return series.withColumn("__i", i).withColumn("split", F.when(F.col("__i") > n - h, "test").when(F.col("__i") > n - 2 * h, "validation").otherwise("train")).drop("__i")


def seasonal_naive(series: DataFrame, period: int = 7) -> DataFrame:
    """The value of the same day one period before."""
    past = series.select(F.date_add("d", period).alias("d"), F.col("y").alias("forecast"))
    return series.join(past, "d").select("d", "y", "forecast")


def errors(rows: DataFrame, actual: str = "y", guess: str = "forecast", by: Sequence[str] = ()) -> DataFrame:
    """MAE, RMSE, WAPE, SMAPE (0 where both are 0) and bias."""
    e = F.col(guess) - F.col(actual)
    both = F.abs(actual) + F.abs(guess)
    return rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("days"), F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"), (F.sum(F.abs(e)) / F.nullif(F.sum(F.abs(actual)), F.lit(0.0))).alias("wape"),
        F.avg(F.when(both > 0, 2 * F.abs(e) / both).otherwise(F.lit(0.0))).alias("smape"), F.avg(e).alias("bias"),
    )


def recursive(history: Sequence[float], days: int, step: Callable[[list[float]], float]) -> list[float]:
    """Each forecast becomes history of the next; never below 0.  The horizon is a few days, on the driver."""
    held, out = list(history), []
    for _ in range(days):
        out.append(max(0.0, float(step(held))))
        held.append(out[-1])
    return out


def choose(candidates: dict[str, tuple[float, float]]) -> str:
    """The method with the least (MAE, RMSE); the baseline may win."""
    return min(candidates, key=lambda k: (*candidates[k], k))


LAGS, LONG_LAG, LONG_FROM, LEAST = (1, 2, 3, 7), 14, 35, 21


def _row(values: Sequence[float], weekday: int, lags: Sequence[int]) -> list[float]:
    """Features of the day that follows ``values``, of which it sees nothing later."""
    angle = weekday * 2 * math.pi / 7
    week = list(values[-7:])
    return [1.0, math.sin(angle), math.cos(angle), float(weekday >= 5), *[values[-k] for k in lags], sum(week) / len(week), sum(values[-3:]) / 3]


def fit_line(values: Sequence[float], weekdays: Sequence[int], ridge: float = 1e-3) -> Callable[[list[float], int], float]:
    """A ridge regression over lags, rolling means and the weekday; a lag of two weeks where there are LONG_FROM days."""
    if len(values) < LEAST:
        raise ValueError(f"{len(values)} days are too few: {LEAST} are needed")
    lags = (*LAGS, LONG_LAG) if len(values) >= LONG_FROM else LAGS
    first = max(lags)
    x = np.array([_row(values[:i], weekdays[i], lags) for i in range(first, len(values))])
    y = np.array(values[first:])
    size = np.abs(x).max(axis=0)
    size[size == 0] = 1.0
    scaled = x / size
    weights = np.linalg.solve(scaled.T @ scaled + ridge * np.diag([0.0] + [1.0] * (x.shape[1] - 1)), scaled.T @ y) / size
    return lambda held, weekday: float(np.dot(weights, _row(held, weekday, lags)))


def selection(series: Sequence[tuple], asked: int) -> list[tuple]:
    """``(day, actual, forecast, method, validation MAE)`` of the last days, by the method that did better on those before.

    The candidates are the fitted line, forecast recursively, and the value a week ago, which
    may win.  The winner is fitted again on all days before the last ones.
    """
    days, values = [d for d, _ in series], [float(y) for _, y in series]
    weekdays = [d.weekday() for d in days]
    h = horizons(len(values), asked)

    def ahead(method: str, upto: int) -> list[float]:
        if method == "seasonal_naive":
            return recursive(values[:upto], h, lambda held: held[-7])
        line = fit_line(values[:upto], weekdays)
        return recursive(values[:upto], h, lambda held: line(held, weekdays[len(held)]))

    start = len(values) - 2 * h
    methods = ["seasonal_naive"] + (["line"] if start >= LEAST else [])
    scores = {}
    for m in methods:
        off = [abs(a - b) for a, b in zip(ahead(m, start), values[start : start + h], strict=True)]
        scores[m] = (sum(off) / h, math.sqrt(sum(e * e for e in off) / h))
    best = choose(scores)
    last = len(values) - h
    return [(d, y, f, best, scores[best][0]) for d, y, f in zip(days[last:], values[last:], ahead(best, last), strict=True)]

"""Daily sales history, trend and forecast, per product or over all products.

A series has at most one row per calendar day, however large the sales table is: lines are summed by day
before anything is grouped by product, so a group handed to Python is bounded by the calendar.  Python fits many series
in one call of numpy, as most products have few days of sales and there are very many of them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from starcellar.functions.money import as_double, rounded
from starcellar.plans.warehouse import Warehouse

# Fewest points for a forecast (products with fewer days of sales have none), average days of a month, and the normal quantile of an 80 % band.
MIN_POINTS = 10
DAYS_PER_MONTH = 30.44
BAND = 1.2816
# Orders of the yearly and weekly Fourier terms, and the weight that holds their coefficients near 0.
YEARLY_ORDER = 10
WEEKLY_ORDER = 3
RIDGE = 1.0
# The trend may change its slope at this many even places of the first part of a history; the smaller the last
# number, the dearer a change.
CHANGES = 25
CHANGING_PART = 0.8
CHANGE_SCALE = 0.05
# Days, filled up to the longest series beside them, that are fitted in one call.
FIT_DAYS = 16_384

FORECAST_SCHEMA = "ProductKey BIGINT, ds DATE, yhat DOUBLE, yhat_lower DOUBLE, yhat_upper DOUBLE, is_future BOOLEAN"


def horizon_days(months: int) -> int:
    return int(months * DAYS_PER_MONTH)


def daily_history(w: Warehouse, product: int | None = None) -> DataFrame:
    """Sales by day over all products or of one; empty with fewer than ten days."""
    if product is None:
        daily = w.totals("sales", ["FullDate"], {"amount": "revenue"})
    else:
        chosen = F.col("ProductKey") == product
        daily = w.totals("sales", ["FullDate"], {"amount": "revenue"}, where=chosen, where_needs=("ProductKey",))
    # One row per day of the calendar, so these rows may meet in one place; nothing is read a second time.
    points = F.count(F.lit(1)).over(Window.partitionBy(F.lit(0)))
    return daily.withColumn("points", points).filter(F.col("points") >= MIN_POINTS).select(F.col("FullDate").alias("ds"), as_double(_no_null("amount")).alias("y"))


def _no_null(column: str) -> Column:
    return F.coalesce(F.col(column), F.lit(0))


def _exact_histories(w: Warehouse) -> DataFrame:
    daily = w.totals("sales", ["ProductKey", "FullDate"], {"amount": "revenue"})
    points = F.count(F.lit(1)).over(Window.partitionBy("ProductKey"))
    return daily.withColumn("points", points).filter(F.col("points") >= MIN_POINTS).select(
        "ProductKey", F.col("FullDate").alias("ds"), _no_null("amount").cast("decimal(18,4)").alias("amount")
    )


def daily_histories(w: Warehouse) -> DataFrame:
    """Sales by product and day, of products with at least ten days of sales."""
    return _exact_histories(w).select("ProductKey", "ds", as_double(F.col("amount")).alias("y"))


def _total_history(w: Warehouse) -> DataFrame:
    return daily_history(w).select(F.lit(None).cast("bigint").alias("ProductKey"), "ds", "y")


# Straight line ---------------------------------------------------------------------------------------


def _line_fits(w: Warehouse) -> DataFrame:
    """Least-squares line and residual deviation of each product's daily sales.

    Fitted from exact decimal sums, so the result does not depend on the order in which partial sums meet.
    ``x`` counts days from the calendar's first day; daily amounts are taken in whole cents.
    """
    first = w.calendar_bounds().select("first_day").scalar()
    amount = F.col("amount").cast("decimal(18,2)")
    points = _exact_histories(w).withColumn("x", F.date_diff("ds", first)).withColumn("amount", amount)
    sums = points.groupBy("ProductKey").agg(
        F.count(F.lit(1)).cast("decimal(8,0)").alias("n"),
        F.sum("x").cast("decimal(12,0)").alias("sx"),
        F.sum(F.col("x").cast("bigint") * F.col("x")).cast("decimal(16,0)").alias("sxx"),
        F.sum("amount").cast("decimal(22,2)").alias("sy"),
        F.sum(F.col("x").cast("decimal(8,0)") * F.col("amount")).cast("decimal(28,2)").alias("sxy"),
        F.sum(F.col("amount") * F.col("amount")).cast("decimal(38,4)").alias("syy"),
        F.max("ds").alias("last_day"),
    )
    n, sx, sy = F.col("n"), F.col("sx"), F.col("sy")
    fits = sums.select(
        "ProductKey", "n", "sx", "sy", "last_day",
        as_double(n * F.col("sxx") - sx * sx).alias("vxx"),
        as_double(n * F.col("sxy") - sx * sy).alias("vxy"),
        as_double((n * F.col("syy")).cast("decimal(38,4)") - (sy * sy).cast("decimal(38,4)")).alias("vyy"),
    )
    slope = F.try_divide("vxy", "vxx")
    count = as_double(n)
    # Left over variance; rounding can take it a hair below zero for points on a line.
    left_over = F.greatest(F.col("vyy") - F.col("vxy") * slope, F.lit(0.0)) / (count * (count - 2))
    return fits.withColumn("slope", slope).select(
        "ProductKey", "last_day", "slope",
        ((as_double(sy) - F.col("slope") * as_double(sx)) / count).alias("intercept"),
        F.sqrt(left_over).alias("deviation"),
        n.cast("bigint").alias("points"),
    ).filter(F.col("slope").isNotNull())


def linear_trend(w: Warehouse) -> DataFrame:
    """Slope per day and intercept at the calendar's first day, by product."""
    return _line_fits(w).select(
        "ProductKey", "points", F.round("slope", 6).alias("slope"), F.round("intercept", 6).alias("intercept")
    )


def linear_forecast(w: Warehouse, months: int = 3) -> DataFrame:
    """The fitted line continued for the horizon, with an 80 % band, by product and day."""
    first = w.calendar_bounds().select("first_day").scalar()
    steps = F.sequence(F.date_add("last_day", 1), F.date_add("last_day", horizon_days(months)))
    days = _line_fits(w).withColumn("ds", F.explode(steps))
    value = F.col("intercept") + F.col("slope") * F.date_diff("ds", first)
    return days.withColumn("yhat", value).select(
        "ProductKey", "ds", "yhat",
        (F.col("yhat") - BAND * F.col("deviation")).alias("yhat_lower"),
        (F.col("yhat") + BAND * F.col("deviation")).alias("yhat_upper"),
    )


# Trend with seasons ----------------------------------------------------------------------------------


def _waves(days: np.ndarray) -> np.ndarray:
    """All yearly and weekly waves for day numbers."""
    columns = []
    for period, order in ((365.25, YEARLY_ORDER), (7.0, WEEKLY_ORDER)):
        for k in range(1, order + 1):
            angle = 2.0 * np.pi * k * days / period
            columns += [np.sin(angle), np.cos(angle)]
    return np.stack(columns, axis=-1)


def _terms(days: np.ndarray, origin: np.ndarray, span: np.ndarray) -> np.ndarray:
    """Intercept, line over the history, and all waves, for the days of each series; waves are computed once a day."""
    line = (days - origin[:, None]) / np.maximum(span, 1)[:, None]
    each, place = np.unique(days, return_inverse=True)
    waves = _waves(each)[place.reshape(days.shape)]
    return np.concatenate([np.ones((*days.shape, 1)), line[:, :, None], waves], axis=2)


def _bends(days: np.ndarray, origin: np.ndarray, span: np.ndarray) -> np.ndarray:
    """For each place where the slope may change, how far a day of a series lies beyond it, in histories."""
    places = CHANGING_PART * np.arange(1, CHANGES + 1) / (CHANGES + 1)
    line = (days - origin[:, None]) / np.maximum(span, 1)[:, None]
    return np.maximum(line[:, :, None] - places, 0.0)


def change_price(values: np.ndarray) -> float:
    """What a unit of slope change costs: the noise between neighbouring points over their scale and CHANGE_SCALE.

    Neighbours differ by noise even where the slope breaks, so a break does not make changes dearer.
    """
    noise = float(np.mean(np.diff(values) ** 2)) / 2.0
    return noise / (max(float(np.abs(values).max()), 1e-9) * CHANGE_SCALE)


def few_changes(gram: np.ndarray, pull: np.ndarray, price: float) -> np.ndarray:
    """The exact minimum of ``d'Gd/2 - pull'd + price * sum|d|``; see ``fewest_changes``."""
    return fewest_changes(gram[None], pull[None], np.array([price]))[0]


def fewest_changes(grams: np.ndarray, pulls: np.ndarray, prices: np.ndarray) -> np.ndarray:
    """The minimum of each series, by following it from the price at which d is 0.

    Between two events the active changes move on a line; an event is one that becomes active or returns to 0.  All
    series that have not reached their price take one such step together.
    """
    count = pulls.shape[1]
    result = np.zeros(pulls.shape)
    at = np.abs(pulls).max(axis=1, initial=0.0)
    going = np.flatnonzero(~(at <= prices))
    found, left, at = np.zeros((len(going), count)), pulls[going].astype(float), at[going]
    active, returned = np.zeros((len(going), count), bool), np.zeros((len(going), count), bool)
    diagonal = np.eye(count, dtype=bool)
    for _ in range(20 * count):
        if not len(going):
            break
        gram, price, top = grams[going], prices[going], at[:, None]
        active |= ~returned & (np.abs(left) >= top * (1 - 1e-9))
        signs = np.where(active, np.where(np.abs(found) > 0, np.sign(found), np.sign(left)), 0.0)
        inner = np.where(active[:, :, None] & active[:, None, :], gram, 0.0)
        hold = 1e-12 * np.trace(inner, axis1=1, axis2=2)[:, None] + 1e-300
        inner += np.where(diagonal, np.where(active, hold, 1.0)[:, :, None], 0.0)
        move = np.linalg.solve(inner, signs[:, :, None])[:, :, 0]
        slide = (gram @ move[:, :, None])[:, :, 0]
        with np.errstate(divide="ignore", invalid="ignore"):
            reach = np.where(active & (move * found < 0), -found / move, np.inf)
            for side in (1, -1):
                enters = (top - side * left) / (1.0 - side * slide)
                enters = np.where((1.0 - side * slide > 1e-12) & (enters > 1e-9 * top) & ~active, enters, np.inf)
                reach = np.minimum(reach, enters)
        event = reach.argmin(axis=1)
        nearest = np.take_along_axis(reach, event[:, None], axis=1)[:, 0]
        met = nearest < at - price
        step = np.where(met, nearest, at - price)
        found += step[:, None] * move
        left -= step[:, None] * slide
        at = at - step
        returned = active & met[:, None] & (np.arange(count) == event[:, None])
        found[returned] = 0.0
        active &= ~returned
        result[going] = found
        more = ~(at <= price)
        going, found, left, at, active, returned = (x[more] for x in (going, found, left, at, active, returned))
    return result


Fit = tuple[np.ndarray, np.ndarray, np.ndarray]


def fit_series(days: np.ndarray, values: np.ndarray, periods: int) -> Fit:
    """``fit_many`` for one series."""
    return fit_many([days], [values], periods)[0]


def fit_many(days: Sequence[np.ndarray], values: Sequence[np.ndarray], periods: int) -> list[Fit]:
    """For each series the days of its history and of the following ``periods``, their fitted values, and the band's
    half-width by day.

    Every series has the same model, however many points it has: a trend of straight pieces and both seasons in full.
    A fixed ridge on the waves keeps the solution stable where days are sparse.  Slope changes pay a price by their
    size, so most are exactly 0 and a noisy series keeps a straight line; level and slope are not held back, so
    residuals sum to 0 and are uncorrelated with time.  The band is as wide as the residuals ask for, freedom counted
    by the ridge's effective number of terms and the changes; ahead of the history it widens with the variance of
    slope changes that come as often, and are as large on average, as those of the history.

    Series of about the same length are fitted together, so that little is spent on filling them up.
    """
    fits: list[Fit] = [None] * len(days)
    order = sorted(range(len(days)), key=lambda i: len(days[i]))
    while order:
        width = len(days[order[-1]])
        some = order[-max(FIT_DAYS // (width + periods), 1):]
        del order[-len(some):]
        for i, fit in zip(some, _fit_together([days[i] for i in some], [values[i] for i in some], periods), strict=True):
            fits[i] = fit
    return fits


def _fit_together(days: list[np.ndarray], values: list[np.ndarray], periods: int) -> Iterator[Fit]:
    """Fits of series that are filled up with their last day, which then counts for nothing."""
    sizes = np.array([len(d) for d in days])
    width = int(sizes.max())
    held = np.arange(width) < sizes[:, None]
    first, last = np.array([d[0] for d in days]), np.array([d[-1] for d in days])
    span = last - first
    day, value = np.repeat(last[:, None], width, axis=1), np.zeros((len(days), width))
    day[held], value[held] = np.concatenate(days), np.concatenate(values)
    every = np.concatenate([day, last[:, None] + 1 + np.arange(periods)], axis=1)
    all_terms, all_bends = _terms(every, first, span), _bends(every, first, span)
    known, bends = all_terms[:, :width] * held[:, :, None], all_bends[:, :width] * held[:, :, None]
    scale = np.maximum(np.abs(value).max(axis=1), 1e-9)
    ridge = np.full((len(days), known.shape[2]), RIDGE)
    ridge[:, :2] = np.where(span > 0, 0.0, 1e-9)[:, None]
    turned = known.transpose(0, 2, 1)
    square = turned @ known
    system = square + ridge[:, :, None] * np.eye(known.shape[2])
    target = (value / scale[:, None])[:, :, None]
    # The best weights for given changes are linear in them, which leaves a problem in the changes alone.
    solved = np.linalg.solve(system, np.concatenate([turned @ target, turned @ bends, square], axis=2))
    plain, follow, kept = solved[:, :, :1], solved[:, :, 1:1 + CHANGES], solved[:, :, 1 + CHANGES:]
    free = bends - known @ follow
    prices = np.array([change_price(v) for v in values]) / scale
    changes = fewest_changes(bends.transpose(0, 2, 1) @ free, (free.transpose(0, 2, 1) @ target)[:, :, 0], prices)
    weights = plain - follow @ changes[:, :, None]
    used = np.trace(kept, axis1=1, axis2=2) + np.count_nonzero(changes, axis=1)
    left = (target - known @ weights - bends @ changes[:, :, None])[:, :, 0]
    variance = np.sum(left**2, axis=1) / np.maximum(sizes - used, 1.0)
    fitted = (all_terms @ weights + all_bends @ changes[:, :, None])[:, :, 0] * scale[:, None]
    ahead = np.maximum(every - last[:, None], 0) / np.maximum(span, 1)[:, None]
    rate, size = CHANGES / CHANGING_PART, np.abs(changes).mean(axis=1)
    band = BAND * np.sqrt(variance[:, None] + rate * 2.0 * size[:, None]**2 * ahead**3 / 3.0) * scale[:, None]
    own = np.concatenate([held, np.ones((len(days), periods), bool)], axis=1)
    for i, mine in enumerate(own):
        yield every[i, mine], fitted[i, mine], band[i, mine]


def _forecast_rows(series: pa.Table, periods: int) -> pa.Table:
    """Forecasts of whole series, whose rows come by product and day."""
    keys = series["ProductKey"].combine_chunks().cast(pa.int64())
    days = series["ds"].cast(pa.int32()).to_numpy().astype("int64")
    starts = np.concatenate([[0], _key_changes(keys)])
    fits = fit_many(np.split(days, starts[1:]), np.split(series["y"].to_numpy(), starts[1:]), periods)
    every, fitted, width = (np.concatenate(x) for x in zip(*fits, strict=True))
    lengths = np.array([len(days) for days, _, _ in fits])
    ends = np.repeat(days[np.append(starts[1:], len(days)) - 1], lengths)
    return pa.table({
        "ProductKey": keys.take(pa.array(np.repeat(starts, lengths))),
        "ds": pa.array(every.astype("int32")).cast(pa.date32()),
        "yhat": fitted, "yhat_lower": fitted - width, "yhat_upper": fitted + width, "is_future": every > ends,
    })


def _key_changes(keys: pa.Array) -> np.ndarray:
    """Rows at which another key begins; NULL is a key too."""
    number, missing = keys.fill_null(0).to_numpy(), keys.is_null().to_numpy(zero_copy_only=False)
    return np.flatnonzero((number[1:] != number[:-1]) | (missing[1:] != missing[:-1])) + 1


def _forecast_sorted(periods: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Forecasts of the series of a partition; the last series of a batch may go on in the next, so it waits for it."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: pa.Table | None = None
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            rows = rows if waiting is None else pa.concat_tables([waiting, rows])
            changes = _key_changes(rows["ProductKey"].combine_chunks())
            whole = int(changes[-1]) if len(changes) else 0
            if whole:
                yield from _forecast_rows(rows.slice(0, whole), periods).to_batches()
            waiting = rows.slice(whole)
        if waiting is not None and waiting.num_rows:
            yield from _forecast_rows(waiting, periods).to_batches()

    return run


def seasonal_forecast(history: DataFrame, months: int = 3) -> DataFrame:
    """Trend of straight pieces, weekly and yearly seasons with an 80 % band, for the history and the horizon.

    ``history`` has ``ProductKey, ds, y`` and one row per product and day; all products are fitted in one job.
    """
    spark = history.sparkSession
    # The fits are heavy and their input is small, so the number of tasks is set rather than left to AQE,
    # which would merge them by bytes.
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 3 * spark.sparkContext.defaultParallelism)
    spread = history.select("ProductKey", "ds", "y").repartition(tasks, "ProductKey")
    spread = spread.sortWithinPartitions("ProductKey", F.asc_nulls_last("ds"))
    return spread.mapInArrow(_forecast_sorted(horizon_days(months)), FORECAST_SCHEMA)


def forecast(w: Warehouse, months: int = 3) -> DataFrame:
    return seasonal_forecast(daily_histories(w), months)


def _optimality(history: DataFrame, predicted: DataFrame) -> DataFrame:
    """What holds for the best fit of each series and for no other one.

    Days covered; residuals without level or trend, relative to the sales; and no slope change left that would pay: the
    residuals' sum weighted by the distance beyond any place of change is at most the price of a change.
    """
    key, ahead = "ProductKey", F.col("is_future")
    # The days ahead are one row of their product without day, so the forecast is made once and shuffled without them.
    known = predicted.groupBy(key, F.when(~ahead, F.col("ds")).alias("ds")).agg(
        F.max(F.when(~ahead, F.col("yhat"))).alias("yhat"), F.sum(F.when(ahead, 1)).alias("days_ahead"),
        F.max(F.when(ahead, F.col("ds"))).alias("last_ahead"),
        F.bool_and(F.when(ahead, (F.col("yhat_lower") <= F.col("yhat")) & (F.col("yhat") <= F.col("yhat_upper")))).alias("in_band"))
    rows = history.join(known, [key, "ds"], "full_outer")
    series = Window.partitionBy(key)
    day = F.date_diff("ds", F.lit("1995-01-01").cast("date"))
    step = F.col("y") - F.lag("y").over(series.orderBy("ds", F.desc_nulls_last("days_ahead")))
    first, last = F.min("ds").over(series), F.max("ds").over(series)
    rows = rows.select("*", (F.col("y") - F.col("yhat")).alias("left"), day.alias("day"), step.alias("step"),
                       (F.date_diff("ds", first) / F.date_diff(last, first)).alias("t"))
    beyond = [F.greatest(F.col("t") - CHANGING_PART * j / (CHANGES + 1), F.lit(0.0)) for j in range(1, CHANGES + 1)]
    gains = [F.abs(F.sum(F.col("left") * b)) for b in beyond]
    price = F.avg(F.col("step") * F.col("step")) / 2 / (F.max(F.abs("y")) * CHANGE_SCALE)
    return rows.groupBy(key).agg(
        F.count("y").alias("points"), F.count("yhat").alias("fitted"), F.min("ds").alias("first_day"),
        F.max("ds").alias("last_day"),
        (F.abs(F.sum("left")) < 1e-6 * F.sum(F.abs("y"))).alias("no_level_left"),
        (F.abs(F.sum(F.col("left") * F.col("day"))) < 1e-6 * F.sum(F.abs("y") * F.col("day"))).alias("no_trend_left"),
        (F.greatest(*gains) <= price + 1e-6 * F.sum(F.abs("y"))).alias("no_change_left"),
        F.max("days_ahead").alias("days_ahead"), F.max("last_ahead").alias("last_ahead"),
        F.bool_and("in_band").alias("in_band"),
    )


def forecast_fit(w: Warehouse) -> DataFrame:
    """The conditions of the best fit, for the forecast of each product."""
    history = daily_histories(w)
    return _optimality(history, seasonal_forecast(history))


def forecast_all(w: Warehouse, months: int = 3) -> DataFrame:
    """The forecast over all products together."""
    return seasonal_forecast(_total_history(w), months).drop("ProductKey")


def forecast_all_fit(w: Warehouse) -> DataFrame:
    """The conditions of the best fit, for the forecast over all products together."""
    every = _total_history(w).withColumn("ProductKey", F.lit(0).cast("bigint"))
    return _optimality(every, seasonal_forecast(every)).drop("ProductKey")


# Reading a forecast ----------------------------------------------------------------------------------


def summarize(history: DataFrame, predicted: DataFrame, months: int) -> DataFrame:
    """Recent sales against the forecast by product: totals, change, trend, and a flag for implausible growth.

    ``predicted`` holds the days after the history.  Forecast values below 0 count as 0.
    """
    days = horizon_days(months)
    last = Window.partitionBy("ProductKey")
    recent = history.withColumn("last_day", F.max("ds").over(last)).filter(
        F.col("ds") > F.date_sub("last_day", days)
    ).groupBy("ProductKey").agg(F.sum("y").alias("recent"))
    clipped = {
        alias: F.sum(F.greatest(F.col(column), F.lit(0.0))).alias(alias)
        for alias, column in (("forecast_total", "yhat"), ("low_total", "yhat_lower"), ("high_total", "yhat_upper"))
    }
    ahead = predicted.groupBy("ProductKey").agg(*clipped.values())
    totals = recent.join(ahead, recent.ProductKey.eqNullSafe(ahead.ProductKey)).drop(ahead.ProductKey)
    # Everything is rounded once, at the end: the change is that of the unrounded totals.
    recent_total = as_double(F.col("recent"))
    totals = totals.withColumn(
        "pct_change",
        F.when(recent_total > 0, rounded((F.col("forecast_total") - recent_total) / recent_total * 100, 1)),
    )
    change = F.coalesce(F.col("pct_change"), F.lit(0.0))
    return totals.select(
        "ProductKey", rounded(recent_total, 2).alias("recent_actual"),
        *(rounded(F.col(c), 2).alias(c) for c in ("forecast_total", "low_total", "high_total")), "pct_change",
        # A change of more than 5 % is a trend, one of more than 100 % is implausible.
        F.when(change > 5, "up").when(change < -5, "down").otherwise("flat").alias("trend"),
        F.coalesce(F.abs("pct_change") > 100, F.lit(False)).alias("implausible_growth"),
    )


def forecast_summary(w: Warehouse, months: int = 3) -> DataFrame:
    """Summary of the straight-line forecast of every product."""
    history = _exact_histories(w).withColumnRenamed("amount", "y")
    return summarize(history, linear_forecast(w, months), months)


def seasonal_summary(w: Warehouse, months: int = 3) -> DataFrame:
    """Summary of the seasonal forecast of every product."""
    future = forecast(w, months).filter("is_future")
    return summarize(daily_histories(w), future, months)


def join_actuals(history: DataFrame, predicted: DataFrame) -> DataFrame:
    """Actual and forecast values by product and day; either may be missing."""
    same = history.ProductKey.eqNullSafe(predicted.ProductKey) & (history.ds == predicted.ds)
    return history.join(predicted, same, "full_outer").select(
        F.coalesce(history.ProductKey, predicted.ProductKey).alias("ProductKey"),
        F.coalesce(history.ds, predicted.ds).alias("ds"),
        F.col("y").alias("actual"), "yhat", "yhat_lower", "yhat_upper",
    )


def actual_vs_forecast(w: Warehouse, months: int = 3) -> DataFrame:
    """History and straight-line forecast of every product by day."""
    return join_actuals(daily_histories(w), linear_forecast(w, months))


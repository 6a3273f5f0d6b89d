"""Monthly forecasts as array expressions: a series is one short array (one value a month), each model a fold over it.

No UDF: the exponential models explode their parameter grids inside ``transform`` and fold the array with ``aggregate``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HORIZON, MIN_MONTHS, FOLDS, BEAT = 3, 8, 3, 0.95


def _repeat(x: Column, h: int) -> Column:
    return F.array(*[x] * h)


def _last(y: Column, k: int = 1) -> Column:
    return F.get(y, F.size(y) - k)


def naive(y: Column, h: int) -> Column:
    return _repeat(_last(y), h)


def seasonal(y: Column, h: int) -> Column:
    return F.when(F.size(y) >= 12, F.array(*[F.get(y, F.size(y) - 12 + i % 12) for i in range(h)])).otherwise(naive(y, h))


def moving_average(y: Column, h: int, k: int = 3) -> Column:
    tail = F.slice(y, F.greatest(F.size(y) - k + 1, F.lit(1)), F.lit(k))
    return _repeat(F.aggregate(tail, F.lit(0.0), lambda a, v: a + v) / F.size(tail), h)


def linear(y: Column, h: int) -> Column:
    """Least squares on 0, 1, 2 ...; not under 0."""
    n = F.size(y).cast("double")
    sy = F.aggregate(y, F.lit(0.0), lambda a, v: a + v)
    sxy = F.aggregate(F.transform(y, lambda v, i: v * i), F.lit(0.0), lambda a, v: a + v)
    mx = (n - 1) / 2
    slope = (sxy - mx * sy) / (n * (n * n - 1) / 12)
    return F.array(*[F.greatest(F.lit(0.0), sy / n + slope * (n + i - mx)) for i in range(h)])


def ses(y: Column, h: int) -> Column:
    """Simple exponential smoothing; the level of the smoothing factor, of 19, with the least squared error."""
    start = F.struct(F.lit(0.0).alias("sse"), F.get(y, F.lit(0)).alias("level"))

    def fit(a: Column) -> Column:
        step = lambda s, v: F.struct((s["sse"] + (v - s["level"]) * (v - s["level"])).alias("sse"), (a * v + (1 - a) * s["level"]).alias("level"))
        return F.aggregate(F.slice(y, F.lit(2), F.size(y)), start, step)

    grid = F.array(*[F.lit(round(0.05 * (i + 1), 2)) for i in range(19)])
    best = F.array_min(F.transform(grid, lambda a, i: F.struct(fit(a)["sse"].alias("sse"), i.alias("i"), fit(a)["level"].alias("level"))))
    return _repeat(best["level"], h)


def holt(y: Column, h: int) -> Column:
    """Level and trend, a grid of 9 by 10; not under 0; naive under three months."""
    start = F.struct(F.lit(0.0).alias("sse"), F.get(y, F.lit(0)).alias("level"), (F.get(y, F.lit(1)) - F.get(y, F.lit(0))).alias("trend"))

    def fit(p: Column) -> Column:
        def step(s: Column, v: Column) -> Column:
            guess = s["level"] + s["trend"]
            level = p["a"] * v + (1 - p["a"]) * guess
            return F.struct((s["sse"] + (v - guess) * (v - guess)).alias("sse"), level.alias("level"), (p["b"] * (level - s["level"]) + (1 - p["b"]) * s["trend"]).alias("trend"))

        return F.aggregate(F.slice(y, F.lit(2), F.size(y)), start, step)

    grid = F.array(*[F.struct(F.lit(round(0.1 * i, 1)).alias("a"), F.lit(round(0.05 * j, 2)).alias("b")) for i in range(1, 10) for j in range(1, 11)])
    fits = F.transform(grid, lambda p, i: F.struct(F.struct(fit(p)["sse"].alias("sse"), i.alias("i")).alias("k"), fit(p).alias("f")))
    best = F.array_min(F.transform(fits, lambda x: F.struct(x["k"]["sse"].alias("sse"), x["k"]["i"].alias("i"), x["f"]["level"].alias("level"), x["f"]["trend"].alias("trend"))))
    return F.when(F.size(y) < 3, naive(y, h)).otherwise(F.array(*[F.greatest(F.lit(0.0), best["level"] + best["trend"] * (i + 1)) for i in range(h)]))


MODELS = {"naive": naive, "seasonal": seasonal, "moving_average": moving_average, "ses": ses, "holt": holt, "linear": linear}


def series(rows: DataFrame, key: str, month: str, value: str) -> DataFrame:
    """(key, months, y): a dense array of months per key, gaps 0.  A series is as long as the calendar, whatever the rows."""
    sums = rows.groupBy(key, F.trunc(month, "month").alias("m")).agg(F.sum(value).cast("double").alias("v"))
    got = sums.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("m", "v"))).alias("at"), F.min("m").alias("lo"), F.max("m").alias("hi"))
    got = got.withColumn("months", F.expr("sequence(lo, hi, interval 1 month)"))
    return got.select(key, "months", F.transform("months", lambda m: F.coalesce(F.element_at("at", m), F.lit(0.0))).alias("y"))


def mean_error(actual: Column, guess: Column) -> Column:
    return F.aggregate(F.zip_with(actual, guess, lambda a, b: F.abs(a - b)), F.lit(0.0), lambda s, v: s + v) / F.size(actual)


def metrics(data: DataFrame, key: str) -> DataFrame:
    """(key, model, mae, rmse, mase): each model on the last window, of a quarter of the months, 2 or 3; MASE by the training months' mean step, null without one."""
    cut = data.where(F.size("y") >= MIN_MONTHS).withColumn("h", F.greatest(F.lit(2), F.least(F.lit(3), F.floor(F.size("y") / 4).cast("int"))))
    cut = cut.select(key, "h", F.expr("slice(y, 1, size(y) - h)").alias("train"), F.expr("slice(y, size(y) - h + 1, h)").alias("test"))
    tried = [F.struct(F.lit(name).alias("model"), F.slice(f(F.col("train"), HORIZON), F.lit(1), F.col("h")).alias("guess")) for name, f in MODELS.items()]
    out = cut.withColumn("t", F.explode(F.array(*tried))).select(key, "train", "test", "t.*")
    square = F.aggregate(F.zip_with("test", "guess", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, v: s + v) / F.size("test")
    step = mean_error(F.expr("slice(train, 2, size(train))"), F.expr("slice(train, 1, size(train) - 1)"))
    mae = mean_error(F.col("test"), F.col("guess"))
    return out.select(key, "model", F.round(mae, 2).alias("mae"), F.round(F.sqrt(square), 2).alias("rmse"), F.round(mae / F.nullif(step, F.lit(0.0)), 3).alias("mase"))


def backtest(data: DataFrame, key: str) -> DataFrame:
    """(key, model, fold, mae): each model on up to three rolling windows; the horizon is a quarter of the months, 2 or 3."""
    n = F.size("y")
    cut = data.where(n >= MIN_MONTHS).withColumn("h", F.greatest(F.lit(2), F.least(F.lit(3), F.floor(n / 4).cast("int"))))
    cut = cut.withColumn("fold", F.explode(F.array(*map(F.lit, range(FOLDS))))).withColumn("at", F.size("y") - F.col("h") * (F.col("fold") + 1))
    cut = cut.where(F.col("at") >= F.greatest(F.lit(5), MIN_MONTHS - F.col("h")))
    cut = cut.select(key, "fold", "h", "at", F.expr("slice(y, 1, at)").alias("train"), F.expr("slice(y, at + 1, h)").alias("test"))
    tried = [F.struct(F.lit(name).alias("model"), F.slice(f(F.col("train"), HORIZON), F.lit(1), F.col("h")).alias("guess")) for name, f in MODELS.items()]
    out = cut.withColumn("t", F.explode(F.array(*tried))).select(key, "fold", "at", "train", "test", "t.model", "t.guess")
    return out.select(key, "model", "fold", "at", mean_error(F.col("test"), F.col("guess")).alias("mae"))


def select_model(data: DataFrame, key: str) -> DataFrame:
    """(key, model, mae, naive_mae, forecast): the model with the least mean error, if it beats naive by 5%; naive otherwise."""
    errors = backtest(data, key)
    means = errors.groupBy(key, "model").agg(F.round(F.avg("mae"), 2).alias("mae"), F.min("at").alias("at")).where((F.col("model") != "seasonal") | (F.col("at") >= 12))
    rank = reduce(lambda c, m: c.when(F.col("model") == m[1], m[0]), enumerate(MODELS), F.when(F.lit(False), -1))
    best = means.groupBy(key).agg(F.min_by(F.struct("model", "mae"), F.struct("mae", rank)).alias("b"), F.min(F.when(F.col("model") == "naive", F.col("mae"))).alias("naive_mae"))
    chosen = F.when(F.col("b.mae") < BEAT * F.col("naive_mae"), F.col("b.model")).otherwise(F.lit("naive"))
    rows = data.join(best, key).select(key, "y", chosen.alias("model"), F.col("b.mae").alias("mae"), "naive_mae")
    forecast = F.coalesce(*[F.when(F.col("model") == name, f(F.col("y"), HORIZON)) for name, f in MODELS.items()])
    return rows.select(key, "model", "mae", "naive_mae", F.transform(forecast, lambda v: F.round(v, 2)).alias("forecast"))

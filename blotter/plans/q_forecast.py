"""Registered queries: additive forecasts, seasonal-naive baseline, errors."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from blotter.operators import forecast as FC
from blotter.operators import gaps as G
from blotter.operators import trends as TR
from blotter.plans.registry import register
from blotter.plans.sql import finish, with_views
from blotter.sources import tables as S

# Fourier orders of the reference's models.
DAILY_ORDERS = {"yearly": 5, "weekly": 45}
HOURLY_ORDERS = {"yearly": 4, "weekly": 15, "daily": 60}
# library defaults for models without explicit orders
MINUTE_ORDERS = {"weekly": 3, "daily": 4}
READING_ORDERS = {"yearly": 10, "weekly": 3}
HOLDOUT_DAYS = 60


def _daily_dense(spark, sf):
    counts = TR.daily_counts(S.incidents_from_orders(spark, sf), ["district"])
    return G.gap_fill(counts, ["district"], "day", "1 DAY")


def _naive(spark, sf):
    sn = FC.seasonal_naive(_daily_dense(spark, sf), "district", "day", "n", "7 DAYS")
    sn = FC._mark_holdout(sn, "district", "day", HOLDOUT_DAYS, "1 DAY")
    return sn.where(~F.col("is_train")).select("district", "day", F.col("n").alias("y"), "yhat")


_NAIVE_SQL = """
c AS (SELECT district, CAST(ts AS DATE) AS day, count(*) AS n FROM incidents_o GROUP BY ALL),
s AS (SELECT district, min(day) AS lo, max(day) AS hi FROM c GROUP BY district),
g AS (SELECT district, CAST(unnest(generate_series(lo, hi, INTERVAL 1 DAY)) AS DATE) AS day, hi FROM s),
d AS (SELECT g.district, g.day, g.hi, coalesce(c.n, 0) AS y FROM g LEFT JOIN c USING (district, day)),
h AS (SELECT a.district, a.day, a.y, b.y AS yhat FROM d a
      LEFT JOIN d b ON a.district = b.district AND b.day = a.day - 7
      WHERE a.day > a.hi - """ + str(HOLDOUT_DAYS) + ")"


@register("forecast_errors", sql=finish(with_views("""
SELECT district, count(*) AS n, avg(e) AS bias, avg(abs(e)) AS mae, avg(e * e) AS mse, sqrt(avg(e * e)) AS rmse
FROM (SELECT district, CAST(CAST(trunc(yhat) AS BIGINT) - y AS DOUBLE) AS e FROM h WHERE yhat IS NOT NULL) x
GROUP BY district""", "incidents_o", ctes=_NAIVE_SQL), doubles=("bias", "mae", "mse", "rmse")))
def forecast_errors(spark, sf):
    """Bias / MAE / MSE / RMSE of the weekly seasonal-naive forecast on the 60-day holdout."""
    return FC.forecast_errors(_naive(spark, sf), ["district"])


@register("forecast_vs_actual", sql=finish(with_views(
    "SELECT district, day, y, yhat FROM h", "incidents_o", ctes=_NAIVE_SQL), dates=("day",)))
def forecast_vs_actual(spark, sf):
    """C6 + J7: actual and forecast value per district and holdout day."""
    return _naive(spark, sf)


_DENSE_SQL = """
c AS (SELECT district, CAST(ts AS DATE) AS day, count(*) AS n FROM incidents_o GROUP BY ALL),
s AS (SELECT district, min(day) AS lo, max(day) AS hi FROM c GROUP BY district),
g AS (SELECT district, CAST(unnest(generate_series(lo, hi, INTERVAL 1 DAY)) AS DATE) AS ts FROM s),
d AS (SELECT g.district, g.ts, coalesce(c.n, 0) AS n FROM g LEFT JOIN c ON g.district = c.district AND g.ts = c.day)"""
_HOURS_SQL = """
c AS (SELECT district, date_trunc('hour', ts) AS hour, count(*) AS n FROM incidents_e GROUP BY ALL),
s AS (SELECT district, min(hour) AS lo, max(hour) AS hi FROM c GROUP BY district),
g AS (SELECT district, unnest(generate_series(lo, hi, INTERVAL 1 HOUR)) AS ts FROM s),
d AS (SELECT g.district, g.ts, coalesce(c.n, 0) AS n FROM g LEFT JOIN c ON g.district = c.district AND g.ts = c.hour)"""


def ridge_sql(orders, holdout: int, horizon: int = 0, unit: str = "DAY", n_changepoints: int = 25) -> str:
    """CTEs ``x`` and ``fit`` over ``d(district, ts, n)`` and ``s``: the design by its
    formulas, X'X + ridge by joins, and its solution by Gauss-Jordan steps - nothing of
    the operator's code. ``fc`` has ``yhat`` of all rows and ``horizon`` steps more."""
    feats = ["1.0", "tt", *(f"greatest(tt - {c!r}, 0.0)" for c in FC.grid_of_changes(n_changepoints))]
    for name, order in orders.items():
        for k in range(1, order + 1):
            feats += [f"sin(t * {2.0 * math.pi * k / FC.PERIODS[name]!r})", f"cos(t * {2.0 * math.pi * k / FC.PERIODS[name]!r})"]
    p = len(feats)
    day = lambda c: f"epoch_us(CAST({c} AS TIMESTAMP)) / 86400e6"
    return f"""
a AS (SELECT district, ts, n FROM d UNION ALL
      SELECT district, unnest(generate_series(hi + INTERVAL 1 {unit}, hi + INTERVAL {horizon} {unit}, INTERVAL 1 {unit})), NULL FROM s),
x AS (SELECT district, ts, n, is_train, [{', '.join(feats)}] AS x FROM (
      SELECT a.district, ts, n, ts <= hi - INTERVAL {holdout} {unit} AS is_train, {day('ts')} AS t,
             ({day('ts')} - {day('lo')}) / greatest({day(f'hi - INTERVAL {holdout} {unit}')} - {day('lo')}, 1e-9) AS tt
      FROM a JOIN s ON a.district = s.district) q),
gram AS (SELECT district, i, j, sum(x[i] * CASE WHEN j > {p} THEN n ELSE x[j] END) AS v
         FROM x, range(1, {p + 1}) r(i), range(1, {p + 2}) q(j) WHERE is_train GROUP BY district, i, j),
eqs AS (SELECT district, i, list(v + CASE WHEN i = j AND i > 1 THEN 1.0 ELSE 0.0 END ORDER BY j) AS r FROM gram GROUP BY district, i),
fit AS (WITH RECURSIVE e AS (
        SELECT district, 1 AS k, list(r ORDER BY i) AS m FROM eqs GROUP BY district
        UNION ALL
        SELECT district, k + 1, list_transform(range(1, {p + 1}), lambda i: CASE WHEN i = k THEN list_transform(m[k], lambda v: v / m[k][k])
               ELSE list_transform(range(1, {p + 2}), lambda j: m[i][j] - m[i][k] / m[k][k] * m[k][j]) END) FROM e WHERE k <= {p})
        SELECT district, list_transform(m, lambda r: r[{p + 1}]) AS beta FROM e WHERE k = {p + 1}),
fc AS (SELECT x.district, ts, n, is_train, round(list_sum(list_transform(range(1, {p + 1}), lambda i: x[i] * beta[i])), 4) AS yhat
       FROM x JOIN fit ON x.district = fit.district)"""


def _holdout(fc, key, ts):
    return fc.where(~F.col("is_train")).select(*([key] if key else []), ts, "y", F.round("yhat", 4).alias("yhat"))


@register("forecast_daily", sql=finish(with_views(
    "SELECT district, CAST(ts AS DATE) AS day, n AS y, yhat FROM fc WHERE NOT is_train", "incidents_o",
    ctes=_DENSE_SQL + "," + ridge_sql(DAILY_ORDERS, HOLDOUT_DAYS)), dates=("day",), doubles=("y", "yhat")))
def forecast_daily(spark, sf):
    """Additive daily model per district (yearly 5, weekly 45), 60-day holdout."""
    fc = FC.additive_forecast(_daily_dense(spark, sf), "district", "day", "n", DAILY_ORDERS,
                              holdout=HOLDOUT_DAYS, grain="day")
    return _holdout(fc, "district", "day")


@register("forecast_daily_sparse")
def forecast_daily_sparse(spark, sf):
    """C1 with few trend changes (Laplace prior) and intervals that widen, 60-day holdout."""
    fc = FC.additive_forecast(_daily_dense(spark, sf), "district", "day", "n", DAILY_ORDERS, holdout=HOLDOUT_DAYS,
                              trend="sparse", uncertainty="trend")
    return fc.where(~F.col("is_train")).select("district", "day", "y", "yhat", "yhat_lower", "yhat_upper")


@register("sparse_trend_optimality", sql=finish(with_views("""
SELECT district, j, count(*) AS n_rows, sum(n) AS total, 0.0 AS violation FROM d, s, range(127) q(j)
WHERE d.district = s.district AND ts <= hi - INTERVAL 60 DAY GROUP BY ALL""".replace("SELECT district", "SELECT d.district"), "incidents_o", ctes=_DENSE_SQL),
    ints=("j", "n_rows", "total"), doubles=("violation",)))
def sparse_trend_optimality(spark, sf):
    """How far each coefficient of the sparse fit is from its optimality condition,
    relative to lambda, by sums over the training rows (not over the fit's Gram blocks):
    a trend change that isn't 0 has a gradient of lambda in its sign's direction, one that
    is 0 at most lambda, any other coefficient that of its ridge."""
    _, rows = FC._timed(_daily_dense(spark, sf), "district", "day", "n", HOLDOUT_DAYS, None, 0, "day", "1 DAY")
    fits = FC.fit_additive(rows, "district", DAILY_ORDERS, trend="sparse")
    rows = FC._attach(rows.where("is_train"), "district", fits, "fit")
    x = FC.design(F.col("t"), F.col("tt"), DAILY_ORDERS, FC.grid_of_changes(25))
    off = F.col("y") - F.aggregate(F.zip_with(x, "fit.beta", lambda a, b: a * b), F.lit(0.0), lambda a, v: a + v)
    each = rows.select("district", "y", off.alias("off"), x.alias("xs"))  # once per row, below the explode
    each = each.select("district", "y", "off", F.posexplode("xs").alias("j", "x"))
    sums = each.groupBy("district", "j").agg(F.count(F.lit(1)).alias("n_rows"), F.sum("y").cast("long").alias("total"),
                                             F.sum(F.col("x") * F.col("off")).alias("gradient"))
    sums = FC._attach(sums, "district", fits, "fit")
    beta, lam, grad = F.element_at("fit.beta", F.col("j") + 1), F.col("fit.lam"), F.col("gradient")
    change = F.when(beta != 0, F.abs(grad - lam * F.signum(beta))).otherwise(F.greatest(F.abs(grad) - lam, F.lit(0.0)))
    other = F.abs(grad - F.when(F.col("j") > 0, beta).otherwise(F.lit(0.0)))
    return sums.select("district", "j", "n_rows", "total",
                       F.round(F.when(F.col("j").between(2, 26), change).otherwise(other) / lam, 4).alias("violation"))


@register("forecast_hourly")
def forecast_hourly(spark, sf):
    """Additive hourly model per district (yearly 4, weekly 15, daily 60), last 3 days held out."""
    series = G.hourly_gapfill(S.incidents_from_events(spark, sf))
    fc = FC.additive_forecast(series, "district", "hour_ts", "n", HOURLY_ORDERS, holdout=72, grain="hour")
    return _holdout(fc, "district", "hour_ts")


@register("forecast_hourly_small", sql=finish(with_views(
    "SELECT district, ts AS hour_ts, n AS y, yhat FROM fc WHERE NOT is_train", "incidents_e",
    ctes=_HOURS_SQL + "," + ridge_sql(MINUTE_ORDERS, 72, unit="HOUR", n_changepoints=5)), stamps=("hour_ts",), doubles=("y", "yhat")))
def forecast_hourly_small(spark, sf):
    """C2 with the library's default orders and 5 trend changes."""
    series = G.hourly_gapfill(S.incidents_from_events(spark, sf))
    fc = FC.additive_forecast(series, "district", "hour_ts", "n", MINUTE_ORDERS, holdout=72, grain="hour", n_changepoints=5)
    return _holdout(fc, "district", "hour_ts")


def _ten_minutes(spark, sf, **more):
    series = G.minute_gapfill(S.incidents_from_events(spark, sf), 10)
    return FC.additive_forecast(series, None, "bucket", "n", MINUTE_ORDERS, grain="minute", width=0.65, trend="sparse",
                                uncertainty="trend", **more)


@register("forecast_10min")
def forecast_10min(spark, sf):
    """C4: 10-minute series of all incidents, first 70 % train, rest forecast, interval width .65."""
    fc = _ten_minutes(spark, sf, holdout=0.3)
    return fc.where(~F.col("is_train")).select("bucket", "y", "yhat", "yhat_lower", "yhat_upper")


# Fixed value: the reference's horizon in steps of 10 minutes.
MINUTE_HORIZON = 10_000


@register("forecast_10min_horizon", sql=finish(with_views(f"""
SELECT unnest(generate_series(hi + INTERVAL 10 MINUTE, hi + INTERVAL {10 * MINUTE_HORIZON} MINUTE, INTERVAL 10 MINUTE)) AS bucket
FROM (SELECT time_bucket(INTERVAL 10 MINUTE, max(ts) + INTERVAL 5 MINUTE) AS hi FROM incidents_e) s""", "incidents_e"), stamps=("bucket",)))
def forecast_10min_horizon(spark, sf):
    """C4 past the data: the buckets of the 10,000 next steps that have a forecast
    inside its interval."""
    fc = _ten_minutes(spark, sf, horizon=MINUTE_HORIZON)
    return fc.where(F.col("y").isNull() & (F.col("yhat_lower") < F.col("yhat_upper"))).select("bucket")


_PATHS = dict(rate=25.0, width=0.65, samples=100, seed=3)


@register("trend_path_quantiles", sql=finish(with_views("""
SELECT district, CAST(ts AS DATE) AS day, quantile_cont(value, 0.175) AS lower, quantile_cont(value, 0.825) AS upper
FROM v GROUP BY district, ts""", "incidents_o", ctes=_DENSE_SQL + """,
f AS (SELECT district, CAST(hi - lo AS DOUBLE) AS len, hi, unnest(range(1, 61)) AS step FROM s),
u AS (SELECT district, len, step, hi + CAST(step AS INTEGER) AS ts, path,
             md5('3:' || district || ':' || path || ':' || epoch_us(CAST(hi + CAST(step AS INTEGER) AS TIMESTAMP))) AS h FROM f, range(100) r(path)),
w AS (SELECT district, ts, path, step, len, (CAST('0x' || substr(h, 1, 8) AS BIGINT) + 0.5) / 4294967296.0 AS u0,
             (CAST('0x' || substr(h, 9, 8) AS BIGINT) + 0.5) / 4294967296.0 - 0.5 AS u1,
             (CAST('0x' || substr(h, 17, 8) AS BIGINT) + 0.5) / 4294967296.0 AS u2,
             (CAST('0x' || substr(h, 25, 8) AS BIGINT) + 0.5) / 4294967296.0 AS u3 FROM u),
e AS (SELECT district, ts, path, step, len, CASE WHEN u0 < 1 - exp(-25.0 / len) THEN -3.0 * sign(u1) * ln(1 - 2 * abs(u1)) ELSE 0 END AS change,
             0.1 * sqrt(-2 * ln(u2)) * cos(2 * pi() * u3) AS noise FROM w),
v AS (SELECT b.district, b.ts, b.path, any_value(b.noise) + coalesce(sum(a.change * (b.step - a.step) / b.len), 0) AS value
      FROM e b LEFT JOIN e a ON a.district = b.district AND a.path = b.path AND a.step < b.step AND a.change <> 0
      GROUP BY b.district, b.ts, b.path)"""), dates=("day",), doubles=("lower", "upper")))
def trend_path_quantiles(spark, sf):
    """C4: the bands of simulated trend changes and noise over each district's next 60 days."""
    s = _daily_dense(spark, sf).groupBy("district").agg(F.min("day").alias("lo"), F.max("day").alias("hi"))
    future = s.select("district", F.date_diff("hi", "lo").alias("len"), "hi", F.explode(F.sequence(F.lit(1), F.lit(60))).alias("step"))
    future = future.select("district", F.date_add("hi", F.col("step")).alias("day"), (F.lit(1.0) + F.col("step") / F.col("len")).alias("tt"),
                           F.lit(3.0).alias("delta_scale"), F.lit(0.1).alias("sigma"))
    return FC.trend_paths(future, "district", "day", **_PATHS)


def _readings_fc(spark, sf):
    means = TR.daily_mean(S.readings_from_lineitem(spark, sf), keys=())
    return FC.posterior_forecast(means, None, "day", "mean_value", READING_ORDERS, holdout=HOLDOUT_DAYS, grain="day")


@register("forecast_readings")
def forecast_readings(spark, sf):
    """Single-series daily mean reading with posterior intervals of 300 draws,
    60-day holdout (J8: forecast and actual by day)."""
    return _readings_fc(spark, sf).where(~F.col("is_train")).select("day", "y", "yhat", "yhat_lower", "yhat_upper")


@register("forecast_model_errors")
def forecast_model_errors(spark, sf):
    """C5 on the readings series' posterior mean."""
    return FC.forecast_errors(_holdout(_readings_fc(spark, sf), None, "day"))


# Weekly order 3 is the most that daily data can tell apart.
FUTURE_ORDERS = {"yearly": 5, "weekly": 3}


@register("forecast_future", sql=finish(with_views(
    "SELECT district, CAST(ts AS DATE) AS day, yhat, TRUE AS inside FROM fc WHERE n IS NULL", "incidents_o",
    ctes=_DENSE_SQL + "," + ridge_sql(FUTURE_ORDERS, 0, HOLDOUT_DAYS)), dates=("day",), doubles=("yhat",)))
def forecast_future(spark, sf):
    """C1 past the data: every district's next 60 days, and whether the forecast
    lies inside its interval of simulated trend changes."""
    fc = FC.additive_forecast(_daily_dense(spark, sf), "district", "day", "n", FUTURE_ORDERS, horizon=HOLDOUT_DAYS, uncertainty="trend")
    inside = (F.col("yhat_lower") <= F.col("yhat")) & (F.col("yhat") <= F.col("yhat_upper"))
    return fc.where(F.col("y").isNull()).select("district", "day", F.round("yhat", 4).alias("yhat"), F.coalesce(inside, F.lit(False)).alias("inside"))


CUTOFF = "2000-12-31"


@register("forecast_cutoff_rows", sql=finish(with_views(f"""
SELECT district, count(*) AS n_rows, sum(n) AS actual, count(*) AS forecasts
FROM d WHERE ts > DATE '{CUTOFF}' GROUP BY district""", "incidents_o", ctes=_DENSE_SQL), ints=("actual",)))
def forecast_cutoff_rows(spark, sf):
    """C1's cutoff mode + J8: rows after the cutoff day with their actual counts and a forecast each."""
    fc = FC.additive_forecast(_daily_dense(spark, sf), "district", "day", "n", DAILY_ORDERS, cutoff=CUTOFF)
    return fc.where(~F.col("is_train")).groupBy("district").agg(
        F.count(F.lit(1)).alias("n_rows"), F.sum("y").cast("long").alias("actual"), F.count("yhat").alias("forecasts"))


_GRAM_ORDERS = {"yearly": 1, "weekly": 1}


@register("forecast_gram", sql=finish(with_views("""
SELECT district, i, j, sum(x[i + 1] * CASE WHEN j = 6 THEN n ELSE x[j + 1] END) AS value
FROM (SELECT district, n, [1.0, (t - t0) / (t1 - t0), sin(t * 2 * pi() / 365.25), cos(t * 2 * pi() / 365.25),
                           sin(t * 2 * pi() / 7.0), cos(t * 2 * pi() / 7.0)] AS x
      FROM (SELECT district, n, CAST(ts - DATE '1970-01-01' AS DOUBLE) AS t, CAST(lo - DATE '1970-01-01' AS DOUBLE) AS t0,
                   CAST(hi - DATE '1970-01-01' AS DOUBLE) AS t1 FROM d JOIN s USING (district)) a) b,
     range(6) r(i), range(7) q(j) GROUP BY ALL""", "incidents_o", ctes=_DENSE_SQL), ints=("i", "j"), doubles=("value",)))
def forecast_gram(spark, sf):
    """The normal equations the fit solves (X'X, and X'y as column 6) per
    district, for a small design without changepoints."""
    s = _daily_dense(spark, sf).select("district", F.col("day").alias("ts"), F.col("n").cast("double").alias("y"))
    s = FC._attach(s, "district", FC.training_span(s, "district", "ts"), "span")
    t, t0, t1 = (FC._days(F.col(c)) for c in ("ts", "span.lo", "span.hi"))
    rows = s.withColumns({"t": t, "tt": (t - t0) / (t1 - t0), "chunk": F.year("ts")})
    g = FC.gram_blocks(rows, "district", lambda t, tt: FC.design_matrix(t, tt, _GRAM_ORDERS, [])).select("district", F.posexplode(F.slice("g", 1, 42)).alias("k", "v"))
    i = F.when(F.col("k") < 36, F.floor(F.col("k") / 6)).otherwise(F.col("k") - 36).cast("long")
    j = F.when(F.col("k") < 36, F.col("k") % 6).otherwise(F.lit(6)).cast("long")
    return g.groupBy("district", i.alias("i"), j.alias("j")).agg(F.sum("v").alias("value"))

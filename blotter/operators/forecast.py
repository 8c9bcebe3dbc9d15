"""Forecasting many count series in parallel.

Additive model (piecewise-linear trend + Fourier seasonalities, as in the
published Prophet paper) fitted per key from sufficient statistics:

1. the rows ``(key, chunk, t, y)`` are shuffled, a chunk being a calendar month
   (sub-daily grains) or year (daily grain), so each task sees at most one chunk
   of an already aggregated series - bounded by the calendar, not by data volume;
   the design is built behind that shuffle and only ``X'X, X'y`` leave the task;
2. the blocks of a key (one row per chunk) are summed and the small ``p x p``
   system is solved in ``applyInPandas``: ridge, ridge with a lasso on the trend's
   changes (:func:`sparse_trend`), or draws of the posterior (:func:`gibbs`);
3. coefficients are joined back by key (for a single series: a scalar
   subquery) and ``yhat = x . beta`` is a JVM expression.

Intervals come from the training residuals' variance, from simulated future
trend changes (:func:`trend_paths`, in the JVM, random numbers from hashed
counters), or from the posterior draws. Nothing random depends on partitions.

Also the seasonal-naive baseline and the error table (bias, MAE, MSE, RMSE
of the truncated forecast) used to judge forecasts.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Mapping
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from blotter.session import materialize

# Seasonal periods in days.
PERIODS = {"yearly": 365.25, "weekly": 7.0, "daily": 1.0}
# The published model's prior scale of trend changes and number of draws.
CHANGEPOINT_SCALE = 0.05
MCMC_DRAWS = 300


def _days(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp")).cast("double") / F.lit(86400e6)


def design(t_days: Column, tt: Column, orders: Mapping[str, int], changepoints) -> Column:
    """Feature array: 1, trend, hinges at ``changepoints``, Fourier pairs."""
    feats = [F.lit(1.0), tt]
    feats += [F.greatest(tt - F.lit(c), F.lit(0.0)) for c in changepoints]
    for name, order in orders.items():
        period = PERIODS[name]
        for k in range(1, order + 1):
            ang = t_days * F.lit(2.0 * math.pi * k / period)
            feats += [F.sin(ang), F.cos(ang)]
    return F.array(*feats)


def design_matrix(t: np.ndarray, tt: np.ndarray, orders: Mapping[str, int], changepoints) -> np.ndarray:
    """The rows of :func:`design`, for many times at once."""
    cols = [np.ones_like(tt), tt, *(np.maximum(tt - c, 0.0) for c in changepoints)]
    for name, order in orders.items():
        for k in range(1, order + 1):
            ang = t * (2.0 * math.pi * k / PERIODS[name])
            cols += [np.sin(ang), np.cos(ang)]
    return np.stack(cols, axis=1)


def grid_of_changes(n: int) -> list[float]:
    """``n`` equidistant changepoints in the first 80 % of the training time."""
    return [0.8 * (i + 1) / (n + 1) for i in range(n)]


def _chunk(ts: Column, grain: str) -> Column:
    return F.year(ts) if grain == "day" else F.year(ts) * 100 + F.month(ts)


_UNITS = {"DAY": 86400e6, "DAYS": 86400e6, "HOUR": 3600e6, "HOURS": 3600e6,
          "MINUTE": 60e6, "MINUTES": 60e6}


def _step_micros(step: str) -> float:
    num, unit = step.split()
    return float(num) * _UNITS[unit.upper()]


_STEP = {"day": "1 DAY", "hour": "1 HOUR", "minute": "10 MINUTES"}


def _same_key(key: str, other: str) -> Column:
    return F.col(key).eqNullSafe(F.col(other))


def _attach(rows: DataFrame, key: str | None, per_key: DataFrame, name: str) -> DataFrame:
    """``rows`` with the struct ``name`` of their key's row of ``per_key`` (its
    columns beside the key; null where it has none). Without a key the one row
    is a scalar subquery, so no join is needed."""
    struct = F.struct(*(c for c in per_key.columns if c != key)).alias(name)
    if key is None:
        return rows.withColumn(name, per_key.select(struct).scalar())
    side = per_key.select(F.col(key).alias(f"__{key}"), struct)
    return rows.join(side, _same_key(key, f"__{key}"), "left").drop(f"__{key}")


def training_span(series: DataFrame, key: str | None, ts: str, holdout=None, cutoff=None, step: str = "1 DAY") -> DataFrame:
    """``(key, lo, hi, cutoff)``: first and last bucket and the end of training.

    Training ends at ``cutoff`` (C1's mode: predict all later rows), or
    ``holdout`` steps, or that fraction of the steps, before a key's last bucket.
    Time based: on gap-filled series "all but the last ``holdout`` rows".
    """
    span = series.groupBy(*([key] if key else [])).agg(F.min(ts).alias("lo"), F.max(ts).alias("hi"))
    if cutoff is not None:
        return span.withColumn("cutoff", F.least(F.lit(cutoff).cast(series.schema[ts].dataType), F.col("hi")))
    h = F.lit(holdout or 0)
    if isinstance(holdout, float):
        micros = F.unix_micros(F.col("hi").cast("timestamp")) - F.unix_micros(F.col("lo").cast("timestamp"))
        h = F.ceil((micros / F.lit(_step_micros(step)) + F.lit(1)) * F.lit(holdout))
    return span.withColumn("cutoff", (F.col("hi") - F.expr(f"INTERVAL {step}") * h).cast(series.schema[ts].dataType))


def _mark_holdout(series: DataFrame, key: str, ts: str, holdout, step: str) -> DataFrame:
    """``is_train``: all but the last ``holdout`` steps (or fraction) of each key."""
    marked = _attach(series, key, training_span(series, key, ts, holdout, step=step), "__span")
    return marked.withColumn("is_train", F.col(ts) <= F.col("__span.cutoff")).drop("__span")


def gram_blocks(rows: DataFrame, key: str | None, build: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> DataFrame:
    """``(key, chunk, g)``, a row per key and chunk: X'X (by rows), X'y, y'y and n of
    the rows ``(key, chunk, t, tt, y)`` with a value; ``build`` makes X of t and tt
    behind the shuffle."""
    keys = [key] if key else []

    def partial(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["t", "y"])  # sums in one order, whatever the partitions
        X = build(pdf["t"].to_numpy(float), pdf["tt"].to_numpy(float))
        v = pdf["y"].to_numpy(dtype=float)
        g = np.concatenate([(X.T @ X).ravel(), X.T @ v, [v @ v, len(v)]])
        return pd.DataFrame({**{k: [pdf[k].iloc[0]] for k in keys}, "chunk": [pdf["chunk"].iloc[0]], "g": [g]})

    known = rows.where(F.col("y").isNotNull() & ~F.isnan("y")).select(*keys, "chunk", "t", "tt", "y")
    return known.groupBy(*keys, "chunk").applyInPandas(partial, _schema(rows, keys, "chunk int, g array<double>"))


def _summed(pdf: pd.DataFrame, p: int) -> tuple[np.ndarray, np.ndarray, float, float]:
    """X'X, X'y, y'y and n of a key's blocks."""
    g = np.sum(np.stack(pdf.sort_values("chunk")["g"].to_numpy()), axis=0)
    return g[:p * p].reshape(p, p), g[p * p:-2], g[-2], g[-1]


def _solve(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    try:
        return np.linalg.solve(a, b)
    except np.linalg.LinAlgError:
        return np.linalg.lstsq(a, b, rcond=None)[0]


def _penalty(p: int, ridge: float) -> np.ndarray:
    """The ridge of each coefficient: none on the level."""
    pen = np.full(p, ridge)
    pen[0] = 0.0
    return pen


def _sigma(beta: np.ndarray, a: np.ndarray, b: np.ndarray, yy: float, n: float) -> float:
    return math.sqrt(max(yy - 2 * beta @ b + beta @ a @ beta, 0.0) / n)


def sparse_trend(a: np.ndarray, b: np.ndarray, hinges: slice, pen: np.ndarray, lam: float,
                 sweeps: int = 20_000) -> np.ndarray:
    """Coefficients that minimise ``|y - X beta|^2 / 2``, plus ``pen * beta^2 / 2`` on all
    but the hinges, plus ``lam * |beta|`` on the hinges, from X'X and X'y alone.

    The other coefficients are eliminated exactly (Schur complement); coordinate
    descent over the hinges finds which are active and their signs, and the
    equations of these are then solved, so the optimality conditions hold to
    rounding. A hinge without data stays 0.
    """
    p = len(b)
    h = np.arange(p)[hinges]
    o = np.setdiff1d(np.arange(p), h)
    beta = np.zeros(p)
    inv = _solve(a[np.ix_(o, o)] + np.diag(pen[o]), np.column_stack([a[np.ix_(o, h)], b[o]]))
    if len(h):
        s = a[np.ix_(h, h)] - a[np.ix_(h, o)] @ inv[:, :-1]
        r = b[h] - a[np.ix_(h, o)] @ inv[:, -1]
        d, diag = np.zeros(len(h)), np.diag(s)
        live = np.flatnonzero(diag > 1e-12 * max(diag.max(), 1e-300))
        for sweep in range(sweeps):
            most = 0.0
            for j in live:
                rho = r[j] - s[j] @ d + diag[j] * d[j]
                new = math.copysign(max(abs(rho) - lam, 0.0), rho) / diag[j]
                most, d[j] = max(most, abs(new - d[j]) * math.sqrt(diag[j])), new
            if sweep % 50 == 49 or most <= 1e-12 * math.sqrt(max(abs(r).max(), 1.0)):
                act = np.flatnonzero(d)
                exact = np.zeros(len(h))
                if len(act):
                    exact[act] = _solve(s[np.ix_(act, act)], r[act] - lam * np.sign(d[act]))
                grad = r - s @ exact
                if (np.sign(exact) == np.sign(d)).all() and (np.abs(grad) <= lam * (1 + 1e-9) + 1e-12).all():
                    d = exact
                    break
                if most == 0.0:
                    break
        beta[h] = d
    beta[o] = inv[:, -1] - inv[:, :-1] @ beta[h]
    return beta


def _rng(*names) -> np.random.Generator:
    """A counter-based generator that only the names decide."""
    key = hashlib.blake2b(":".join(map(str, names)).encode(), digest_size=16).digest()
    return np.random.Generator(np.random.Philox(key=int.from_bytes(key, "little")))


def gibbs(a: np.ndarray, b: np.ndarray, yy: float, n: float, hinges: slice, pen: np.ndarray, rng: np.random.Generator,
          draws: int = MCMC_DRAWS, warmup: int = 150, lam: float | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Posterior draws of beta and sigma from X'X, X'y, y'y and n.

    Priors: beta ~ N(0, sigma^2 / pen), flat where pen is 0; with ``lam`` the hinges
    have a Laplace prior of that rate over sigma instead, by a scale mixture (one
    inverse-Gaussian draw per hinge); sigma^2 vaguely inverse gamma. Without
    ``lam`` the posterior mean of beta is the ridge solution.
    """
    p, h = len(b), np.arange(len(b))[hinges]
    weak = 1e-3 * max(yy / max(n, 1.0), 1e-12)
    beta, var, d = np.zeros(p), max(yy / max(n, 1.0), 1e-12), pen.copy()
    out, sigmas = np.empty((draws, p)), np.empty(draws)
    for i in range(warmup + draws):
        if lam is not None and len(h) and i:
            d[h] = np.maximum(rng.wald(np.minimum(lam * math.sqrt(var) / np.maximum(np.abs(beta[h]), 1e-12), 1e9), lam * lam), 1e-12)
        m = a + np.diag(d)
        jitter = 0.0
        while True:
            try:
                low = np.linalg.cholesky(m + jitter * np.eye(p))
                break
            except np.linalg.LinAlgError:
                jitter = max(10 * jitter, 1e-10 * np.trace(m) / p, 1e-12)
        mean = np.linalg.solve(low.T, np.linalg.solve(low, b))
        beta = mean + math.sqrt(var) * np.linalg.solve(low.T, rng.standard_normal(p))
        rss = max(yy - 2 * beta @ b + beta @ a @ beta, 0.0) + beta @ (d * beta)
        var = (rss / 2 + weak) / rng.gamma((n + np.count_nonzero(pen)) / 2 + 1e-3)
        if i >= warmup:
            out[i - warmup], sigmas[i - warmup] = beta, math.sqrt(var)
    return out, sigmas


def trend_paths(future: DataFrame, key: str | None, ts: str, rate: float, width: float, samples: int = 300, seed: int = 0) -> DataFrame:
    """``(key, ts, lower, upper)``: quantiles of simulated deviations from the trend, with noise.

    ``future`` has, per key and step after training, ``tt`` (training time = 1),
    ``delta_scale`` and ``sigma``. On each of ``samples`` paths the slope changes at
    ``rate`` per unit of ``tt`` by Laplace steps of mean size ``delta_scale``, so the
    band widens; noise is normal. All random numbers are 32-bit parts of the md5 of
    ``seed:key:path:time``: reruns and other engines draw the same. A window holds a
    path's steps.
    """
    keys = [key] if key else []
    name = F.coalesce(F.col(key).cast("string"), F.lit("")) if key else F.lit("")
    draw = F.md5(F.concat_ws(":", F.lit(str(seed)), name, F.col("path").cast("string"),
                             F.unix_micros(F.col(ts).cast("timestamp")).cast("string")))
    paths = future.select(*keys, ts, "tt", "delta_scale", "sigma", F.explode(F.sequence(F.lit(0), F.lit(samples - 1))).alias("path"))
    paths = paths.withColumn("draw", draw)
    u = [(F.conv(F.substring("draw", 1 + 8 * i, 8), 16, 10).cast("double") + F.lit(0.5)) / F.lit(float(1 << 32)) for i in range(4)]
    step = Window.partitionBy(*keys, "path").orderBy(ts)
    paths = paths.withColumn("dt", F.col("tt") - F.lag("tt", 1, 1.0).over(step))
    v = u[1] - F.lit(0.5)
    size = -F.col("delta_scale") * F.signum(v) * F.log(F.lit(1.0) - F.lit(2.0) * F.abs(v))
    noise = F.col("sigma") * F.sqrt(F.lit(-2.0) * F.log(u[2])) * F.cos(F.lit(2.0 * math.pi) * u[3])
    change = F.when(u[0] < F.lit(1.0) - F.exp(F.lit(-rate) * F.col("dt")), size).otherwise(F.lit(0.0))
    paths = paths.withColumns({"change": change, "noise": noise})
    before = step.rowsBetween(Window.unboundedPreceding, -1)
    paths = paths.withColumn("slope", F.coalesce(F.sum("change").over(before), F.lit(0.0)))
    off = F.sum(F.col("slope") * F.col("dt")).over(step.rowsBetween(Window.unboundedPreceding, 0))
    paths = paths.withColumn("value", off + F.col("noise"))
    ends = F.percentile("value", F.array(F.lit(0.5 - width / 2), F.lit(0.5 + width / 2)))
    return paths.groupBy(*keys, ts).agg(ends.alias("q")).select(*keys, ts, F.col("q")[0].alias("lower"), F.col("q")[1].alias("upper"))


def _schema(df: DataFrame, keys, more: str) -> str:
    return ", ".join([*(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys), more])


def _timed(series: DataFrame, key: str | None, ts: str, value: str, holdout, cutoff, horizon: int, grain: str,
           step: str) -> tuple[DataFrame, DataFrame]:
    """The series as ``(key, ts, y)``, written once, and its rows with ``horizon`` steps
    more, ``t`` (days), ``tt`` (training time from 0 to 1), ``chunk`` and ``is_train``."""
    keys = [key] if key else []
    s = series.where(F.col(ts).isNotNull()).select(*keys, F.col(ts).alias("ts"), F.col(value).cast("double").alias("y"))
    s = materialize(s, "series")
    span, rows = training_span(s, key, "ts", holdout, cutoff, step), s
    if horizon:
        after = F.sequence(F.col("hi") + F.expr(f"INTERVAL {step}"), F.col("hi") + F.expr(f"INTERVAL {step}") * F.lit(horizon),
                           F.expr(f"INTERVAL {step}"))
        future = span.where("hi is not null").select(*keys, F.explode(after.cast(f"array<{s.schema['ts'].dataType.simpleString()}>")).alias("ts"), F.lit(None).cast("double").alias("y"))
        rows = s.unionByName(future)
    rows = _attach(rows, key, span, "span")
    t, t0, t1 = _days(F.col("ts")), _days(F.col("span.lo")), _days(F.col("span.cutoff"))
    length = F.when(t1 > t0, t1 - t0).otherwise(F.lit(1.0))  # of one bucket alone: a day
    return s, rows.withColumns({"t": t, "tt": (t - t0) / length, "chunk": _chunk(F.col("ts"), grain),
                                "is_train": F.col("ts") <= F.col("span.cutoff")}).drop("span")


def fit_additive(rows: DataFrame, key: str | None, orders: Mapping[str, int], n_changepoints: int = 25, ridge: float = 1.0,
                 trend: str = "ridge", changepoint_scale: float = CHANGEPOINT_SCALE) -> DataFrame:
    """A written table ``(key, beta, sigma, lam, delta_scale)`` of the training rows' fits.

    ``trend`` "ridge": one ridge on all coefficients but the level. "sparse": a Laplace
    prior on the trend's changes instead, of ``changepoint_scale`` times the series'
    root mean square, which is a lasso of ``lam = sigma^2 / scale`` with the
    ridge fit's sigma.
    """
    if trend not in ("ridge", "sparse"):
        raise ValueError(trend)
    keys, cps = [key] if key else [], grid_of_changes(n_changepoints)
    p, hinges = 2 + len(cps) + 2 * sum(orders.values()), slice(2, 2 + len(cps))

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        a, b, yy, n = _summed(pdf, p)
        pen, lam = _penalty(p, ridge), 0.0
        beta = _solve(a + np.diag(pen), b)
        if trend == "sparse":
            lam = _lasso_rate(_sigma(beta, a, b, yy, n), yy, n, changepoint_scale)
            beta = sparse_trend(a, b, hinges, pen, lam)
        size = float(np.abs(beta[hinges]).mean()) if cps else 0.0
        return pd.DataFrame({**{k: [pdf[k].iloc[0]] for k in keys}, "beta": [beta], "sigma": [_sigma(beta, a, b, yy, n)],
                             "lam": [lam], "delta_scale": [size]})

    blocks = gram_blocks(rows.where("is_train"), key, lambda t, tt: design_matrix(t, tt, orders, cps))
    fits = blocks.groupBy(*keys).applyInPandas(solve, _schema(rows, keys, "beta array<double>, sigma double, lam double, delta_scale double"))
    return materialize(fits, "coefficients")


def _lasso_rate(sigma: float, yy: float, n: float, scale: float) -> float:
    return sigma ** 2 / max(scale * math.sqrt(yy / n), 1e-12)


def additive_forecast(series: DataFrame, key: str | None, ts: str, value: str, orders: Mapping[str, int],
                      holdout=None, cutoff=None, horizon: int = 0, grain: str = "day", n_changepoints: int = 25,
                      ridge: float = 1.0, step: str | None = None, width: float = 0.8, trend: str = "ridge",
                      changepoint_scale: float = CHANGEPOINT_SCALE, uncertainty: str = "residual", samples: int = 300,
                      seed: int = 0) -> DataFrame:
    """Fit on the training rows of each key, predict all rows and ``horizon`` steps more.

    Training ends ``holdout`` steps (or that fraction) before a key's last
    bucket, or at ``cutoff``; ``step`` defaults to the grain's bucket (1 day, 1
    hour, 10 minutes). ``trend`` as in :func:`fit_additive`. Returns ``(key, ts, y,
    yhat, yhat_lower, yhat_upper, is_train)``. The interval has the given ``width``:
    under normal residuals of the training variance or, with ``uncertainty`` "trend",
    after training also under simulated trend changes (:func:`trend_paths`), so that it
    widens with the horizon. Series should be gap-filled first.

    ``key`` None is one series. A null key is a key like any other. Rows without
    a value are predicted and left out of the fit; a key without training values
    has null forecasts. Rows without a time are in no series.

    The series (aggregated counts) is written once, in the shared folder; span,
    fit and forecast read that table.
    """
    if uncertainty not in ("residual", "trend"):
        raise ValueError(uncertainty)
    keys, cps = [key] if key else [], grid_of_changes(n_changepoints)
    _, rows = _timed(series, key, ts, value, holdout, cutoff, horizon, grain, step or _STEP[grain])
    coef = fit_additive(rows, key, orders, n_changepoints, ridge, trend, changepoint_scale)
    rows = _attach(rows, key, coef, "fit")
    half = F.col("fit.sigma") * F.lit(NormalDist().inv_cdf(0.5 + width / 2))
    lower, upper = -half, half
    if uncertainty == "trend":
        future = rows.where(~F.col("is_train")).select(*keys, "ts", "tt", F.col("fit.delta_scale").alias("delta_scale"), F.col("fit.sigma").alias("sigma"))
        bands = trend_paths(future, key, "ts", float(n_changepoints), width, samples, seed)
        bands = bands.select(*(F.col(k).alias(f"__{k}") for k in keys), F.col("ts").alias("__ts"), "lower", "upper")
        same = F.col("ts") == F.col("__ts")
        for k in keys:
            same = same & _same_key(k, f"__{k}")
        rows = rows.join(bands, same, "left")
        lower, upper = F.coalesce("lower", lower), F.coalesce("upper", upper)
    products = F.zip_with(design(F.col("t"), F.col("tt"), orders, cps), "fit.beta", lambda a, b: a * b)
    yhat = F.aggregate(products, F.lit(0.0), lambda acc, v: acc + v)
    return (rows.withColumn("yhat", yhat)
            .select(*keys, F.col("ts").alias(ts), "y", "yhat", (F.col("yhat") + lower).alias("yhat_lower"),
                    (F.col("yhat") + upper).alias("yhat_upper"), "is_train"))


def posterior_forecast(series: DataFrame, key: str | None, ts: str, value: str, orders: Mapping[str, int],
                       holdout=None, cutoff=None, horizon: int = 0, grain: str = "day", n_changepoints: int = 25,
                       ridge: float = 1.0, step: str | None = None, width: float = 0.8, draws: int = MCMC_DRAWS,
                       warmup: int = 150, changepoint_scale: float | None = CHANGEPOINT_SCALE, seed: int = 0) -> DataFrame:
    """Forecasts with posterior uncertainty, columns and rows as of :func:`additive_forecast`.

    Each key's posterior is drawn from its summed Gram blocks (:func:`gibbs`; a
    Laplace prior on the trend's changes, or with ``changepoint_scale`` None the
    conjugate one). ``yhat`` is the mean over the draws, the interval has the
    quantiles of draws with noise and, after training, with each draw's own future
    trend changes. Random numbers follow the key, the draw and the calendar chunk.
    """
    keys, cps = [key] if key else [], grid_of_changes(n_changepoints)
    p, hinges = 2 + len(cps) + 2 * sum(orders.values()), slice(2, 2 + len(cps))
    _, rows = _timed(series, key, ts, value, holdout, cutoff, horizon, grain, step or _STEP[grain])

    def sample(pdf: pd.DataFrame) -> pd.DataFrame:
        a, b, yy, n = _summed(pdf, p)
        pen, lam = _penalty(p, ridge), None
        if changepoint_scale is not None:
            sigma = max(_sigma(_solve(a + np.diag(pen), b), a, b, yy, n), 1e-9)
            lam = _lasso_rate(sigma, yy, n, changepoint_scale) / sigma
        name = pdf[key].iloc[0] if key else ""
        betas, sigmas = gibbs(a, b, yy, n, hinges, pen, _rng(seed, name, "draws"), draws, warmup, lam)
        return pd.DataFrame({**{k: [pdf[k].iloc[0]] for k in keys}, "betas": [betas.ravel()], "sigmas": [sigmas]})

    blocks = gram_blocks(rows.where("is_train"), key, lambda t, tt: design_matrix(t, tt, orders, cps))
    posterior = materialize(blocks.groupBy(*keys).applyInPandas(sample, _schema(rows, keys, "betas array<double>, sigmas array<double>")), "posterior")
    # a row per key and chunk (bounded by the calendar) meets its key's draws
    chunks = rows.groupBy(*keys, "chunk").agg(F.sort_array(F.collect_set(F.struct("t", "tt"))).alias("times"))
    chunks = _attach(chunks.select(*keys, "chunk", F.col("times.t").alias("t"), F.col("times.tt").alias("tt")), key, posterior, "fit")
    chunks = chunks.select(*keys, "chunk", "t", "tt", "fit.betas", "fit.sigmas").where("betas is not null")

    def changes(name, draw: int, scale: float, last: float) -> tuple[np.ndarray, np.ndarray]:
        """Times after training and sizes of a draw's trend changes up to ``last``: the
        same whichever chunk asks."""
        rng, at, where, sizes = _rng(seed, name, "changes", draw), 1.0, [], []
        while cps:
            at += rng.exponential(1.0 / len(cps))
            size = rng.laplace(0.0, max(scale, 1e-300))
            if at >= last:
                break
            where.append(at)
            sizes.append(size)
        return np.array(where), np.array(sizes)

    def predict(pdfs):
        for pdf in pdfs:
            for _, r in pdf.iterrows():
                t, tt, name = np.array(r["t"], float), np.array(r["tt"], float), r[key] if key else ""
                betas, sigmas = np.array(r["betas"]).reshape(-1, p), np.array(r["sigmas"])
                y = design_matrix(t, tt, orders, cps) @ betas.T
                mean = y.mean(axis=1)
                if tt.max() > 1.0:
                    for d in range(len(betas)):
                        at, size = changes(name, d, float(np.abs(betas[d, hinges]).mean()) if cps else 0.0, tt.max())
                        y[:, d] += np.maximum(tt[:, None] - at, 0.0) @ size
                y += sigmas * _rng(seed, name, "noise", r["chunk"]).standard_normal(y.shape)
                low, high = np.quantile(y, [0.5 - width / 2, 0.5 + width / 2], axis=1)
                yield pd.DataFrame({**{k: [r[k]] * len(t) for k in keys}, "t": t, "yhat": mean, "yhat_lower": low, "yhat_upper": high})

    bands = chunks.mapInPandas(predict, _schema(rows, keys, "t double, yhat double, yhat_lower double, yhat_upper double"))
    bands = bands.withColumnsRenamed({**{k: f"__{k}" for k in keys}, "t": "__t"})
    same = F.col("t") == F.col("__t")
    for k in keys:
        same = same & _same_key(k, f"__{k}")
    return rows.join(bands, same, "left").select(*keys, F.col("ts").alias(ts), "y", "yhat", "yhat_lower", "yhat_upper", "is_train")


def seasonal_naive(series: DataFrame, key: str, ts: str, value: str, lag: str = "7 DAYS") -> DataFrame:
    """Baseline: ``yhat`` = the value one season earlier (equi-join on the shifted
    time; a null key is a key like any other)."""
    past = series.select(F.col(key).alias(f"__{key}"), (F.col(ts) + F.expr(f"INTERVAL {lag}")).alias(f"__{ts}"),
                         F.col(value).alias("yhat"))
    same = _same_key(key, f"__{key}") & (F.col(ts) == F.col(f"__{ts}"))
    return series.join(past, same, "left").drop(f"__{key}", f"__{ts}")


def forecast_errors(fc: DataFrame, keys=(), y: str = "y", yhat: str = "yhat") -> DataFrame:
    """Bias, MAE, MSE, RMSE of ``int(yhat) - y`` (forecast truncated to int)."""
    e = F.col(yhat).cast("long") - F.col(y)
    rows = fc.where(F.col(yhat).isNotNull()).withColumn("__e", e.cast("double"))
    return rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.avg("__e").alias("bias"), F.avg(F.abs("__e")).alias("mae"),
        F.avg(F.col("__e") * F.col("__e")).alias("mse")).withColumn("rmse", F.sqrt("mse"))


def forecast_vs_actual(actual: DataFrame, forecast: DataFrame, keys) -> DataFrame:
    """C6 + J7: actual values left-joined with the forecast on (time, key)."""
    return actual.join(forecast, list(keys), "left")

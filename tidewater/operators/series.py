"""Ordered series: differences, lags, stationarity, lag order and Granger tests.

A series has a row a period, some hundred at most, so each is tested as one group; different series
run in parallel. Everything that SQL windows can say stays in the JVM.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

PAIRS = {
    "sentiment_all": "all news",
    "sentiment_typeA": "forward-looking shocks",
    "sentiment_typeB": "backward-looking shocks",
    "sentiment_supply": "supply shocks",
    "sentiment_demand": "demand shocks",
}


class NotEnoughData(ValueError):
    """Fewer periods than a test needs."""


def differenced(series: DataFrame, value: str, order: str, times: int = 1, by: list[str] | None = None) -> DataFrame:
    """series with `value` differenced; the rows that have no predecessor go."""
    window = Window.partitionBy(*(by or [])).orderBy(order)
    for _ in range(times):
        series = series.withColumn(value, F.col(value) - F.lag(value).over(window)).where(F.col(value).isNotNull())
    return series


def lag_matrix(series: DataFrame, columns: list[str], order: str, lags: int) -> DataFrame:
    """series with c_lag1, c_lag2, .. for each column."""
    window = Window.orderBy(order)
    return series.withColumns({f"{c}_lag{k}": F.lag(c, k).over(window) for c in columns for k in range(1, lags + 1)})


def running_sum(series: DataFrame, value: str, order: str) -> DataFrame:
    return series.withColumn(value, F.sum(value).over(Window.orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)))


def cross_correlation(series: DataFrame, y: str, x: str, order: str, max_lag: int = 6) -> DataFrame:
    """(lag, n, correlation, band): corr(y_t, x_{t-lag}), so that a positive lag means x leads.

    0 where two pairs or fewer, or no variance; the band is 1.96 over the root of the series' length.
    """
    window = Window.orderBy(order)
    shifted = {k: (F.lag(x, k) if k >= 0 else F.lead(x, -k)).over(window) for k in range(-max_lag, max_lag + 1)}
    wide = series.select(F.col(y).alias("y"), F.count("*").over(Window.partitionBy()).alias("size"), *[c.alias(f"x{k + max_lag}") for k, c in shifted.items()])
    long = wide.select("y", "size", F.posexplode(F.array(*[f"x{i}" for i in range(2 * max_lag + 1)])).alias("at", "x")).where("y is not null")
    n, paired = F.count("x"), F.when(F.col("x").isNotNull(), F.col("y"))
    spread = F.nullif(F.stddev_pop(paired) * F.stddev_pop("x"), F.lit(0.0))
    corr = F.when(n > 2, F.coalesce(F.covar_pop(paired, "x") / spread, F.lit(0.0))).otherwise(0.0)
    return long.groupBy((F.col("at") - max_lag).cast("int").alias("lag")).agg(n.alias("n"), F.round(corr, 6).alias("correlation"), F.round(1.96 / F.sqrt(F.max("size")), 6).alias("band"))


def _fit(y: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, float, np.ndarray]:
    beta = np.linalg.lstsq(x, y, rcond=None)[0]
    rest = y - x @ beta
    return beta, float(rest @ rest), rest


def _aic(ssr: float, n: int, k: int) -> float:
    return n * (math.log(2 * math.pi) + math.log(max(ssr, 1e-300) / n) + 1) + 2 * k


def _normal_cdf(x: float) -> float:
    return 0.5 * math.erfc(-x / math.sqrt(2))


def _adf_design(y: np.ndarray, lags: int, skip: int) -> tuple[np.ndarray, np.ndarray]:
    step = np.diff(y)
    t = np.arange(skip, len(step))
    return step[t], np.column_stack([y[t], *[step[t - k] for k in range(1, lags + 1)], np.ones(len(t))])


def adf(y: np.ndarray) -> tuple[float, float, int]:
    """(statistic, p-value, lags) of the augmented Dickey-Fuller test with a constant, lags by AIC."""
    n = len(y)
    most = min(math.ceil(12 * (n / 100) ** 0.25), n // 2 - 2)
    if most < 0:
        raise NotEnoughData("too few observations")
    best = min(range(most + 1), key=lambda k: _aic(_fit(*_adf_design(y, k, most))[1], n - 1 - most, k + 2))
    target, x = _adf_design(y, best, best)
    beta, ssr, _ = _fit(target, x)
    error = math.sqrt(ssr / (len(target) - x.shape[1]) * np.linalg.inv(x.T @ x)[0, 0])
    tau = float(beta[0] / error)
    return tau, adf_pvalue(tau), best


def adf_pvalue(tau: float) -> float:
    """Response surface of MacKinnon (1994), constant, one series."""
    if tau > 2.74:
        return 1.0
    if tau < -18.83:
        return 0.0
    coefficients = (2.1659, 1.4412, 0.038269) if tau <= -1.61 else (1.7339, 0.93202, -0.12745, -0.010368)
    return _normal_cdf(sum(c * tau**i for i, c in enumerate(coefficients)))


def kpss(y: np.ndarray) -> tuple[float, float, int]:
    """(statistic, p-value between 0.01 and 0.10, lags) of the KPSS test of level stationarity, automatic lags."""
    n = len(y)
    rest = y - y.mean()
    auto = lambda i: float(rest[i:] @ rest[: n - i])
    span = int(n ** (2 / 9))
    products = [auto(i) / (n / 2) for i in range(1, span + 1)]
    s0 = auto(0) / n + sum(products)
    s1 = sum(i * v for i, v in enumerate(products, 1))
    lags = min(int(1.1447 * ((s1 / s0) ** 2) ** (1 / 3) * n ** (1 / 3)), n - 1)
    variance = (auto(0) + 2 * sum(auto(i) * (1 - i / (lags + 1)) for i in range(1, lags + 1))) / n
    value = float((np.cumsum(rest) ** 2).sum() / n**2 / variance)
    return value, float(np.interp(value, [0.347, 0.463, 0.574, 0.739], [0.10, 0.05, 0.025, 0.01])), lags


def stationarity(y: np.ndarray) -> dict:
    y = y[~np.isnan(y)]
    out = {"adf_statistic": None, "adf_pvalue": None, "kpss_statistic": None, "kpss_pvalue": None, "is_stationary": None, "action_needed": "insufficient_data"}
    if len(y) < 10:
        return out
    for name, test in (("adf", adf), ("kpss", kpss)):
        try:
            value, p, _ = test(y)
            if math.isfinite(value):
                out |= {f"{name}_statistic": round(value, 4), f"{name}_pvalue": round(p, 4)}
        except (ValueError, ZeroDivisionError, np.linalg.LinAlgError):
            pass
    if out["adf_pvalue"] is not None and out["kpss_pvalue"] is not None:
        out["is_stationary"] = out["adf_pvalue"] < 0.05 and out["kpss_pvalue"] > 0.05
    return out | {"action_needed": "none" if out["is_stationary"] else "first_difference"}


def made_stationary(y: np.ndarray) -> tuple[np.ndarray, str]:
    """y differenced once, or twice if once isn't enough."""
    once = np.diff(y)
    if stationarity(once)["is_stationary"] is False:
        return np.diff(once), "second_difference"
    return once, "first_difference"


def var_order(y: np.ndarray, x: np.ndarray, max_lag: int, fallback: int = 2) -> int:
    """Order of the vector autoregression with the least AIC, between 1 and max_lag."""
    n = min(len(y), len(x))
    data = np.column_stack([y[-n:], x[-n:]])
    t = np.arange(max_lag, n)
    if len(t) < 2 * max_lag + 3 or np.isnan(data).any():
        return fallback
    scores = []
    for p in range(max_lag + 1):
        design = np.column_stack([np.ones(len(t)), *[data[t - k] for k in range(1, p + 1)]])
        rest = data[t] - design @ np.linalg.lstsq(design, data[t], rcond=None)[0]
        scores.append(np.linalg.slogdet(rest.T @ rest / len(t))[1] + 2 / len(t) * (4 * p + 2))
    return max(1, min(int(np.argmin(scores)), max_lag)) if np.isfinite(scores).all() else fallback


def _beta_fraction(a: float, b: float, x: float) -> float:
    tiny = 1e-300
    c, d = 1.0, 1 / max(abs(1 - (a + b) * x / (a + 1)), tiny) * (1 if 1 - (a + b) * x / (a + 1) >= 0 else -1)
    value = d
    for m in range(1, 500):
        for up in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + up * d
            d = 1 / (d if abs(d) > tiny else tiny)
            c = 1 + up / (c if abs(c) > tiny else tiny)
            value *= c * d
        if abs(c * d - 1) < 1e-14:
            break
    return value


def f_tail(value: float, d1: float, d2: float) -> float:
    """P(F > value), by the regularised incomplete beta function."""
    if not value > 0:
        return 1.0
    x, a, b = d2 / (d2 + d1 * value), d2 / 2, d1 / 2
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) if 0 < x < 1 else 0.0
    if x < (a + 1) / (a + b + 2):
        return front * _beta_fraction(a, b, x) / a
    return 1 - front * _beta_fraction(b, a, 1 - x) / b


def granger(y: np.ndarray, x: np.ndarray, max_lag: int, alpha: float) -> list[dict]:
    """F-test of each lag order that x helps to predict y; [] with fewer than max_lag + 5 observations."""
    both = np.column_stack([y, x])
    both = both[~np.isnan(both).any(axis=1)]
    if len(both) < max_lag + 5:
        return []
    y, x, out = both[:, 0], both[:, 1], []
    for k in range(1, max_lag + 1):
        t = np.arange(k, len(y))
        df = len(t) - 2 * k - 1
        if df < 1:
            break
        own = [np.ones(len(t)), *[y[t - i] for i in range(1, k + 1)]]
        alone = _fit(y[t], np.column_stack(own))[1]
        full = _fit(y[t], np.column_stack([*own, *[x[t - i] for i in range(1, k + 1)]]))[1]
        value = (alone - full) / k / (full / df) if full > 0 else math.inf
        p = f_tail(value, k, df)
        out.append({"lag": k, "f_statistic": round(value, 4), "p_value": round(p, 4), "significant": bool(p < alpha)})
    return out


def long_form(merged: DataFrame, order: str, target: str, predictors: list[str]) -> DataFrame:
    """(variable, at, y, x), a row for each predictor and period."""
    pairs = ", ".join(f"'{p}', `{p}`" for p in predictors)
    return merged.selectExpr(f"`{order}` as at", f"cast(`{target}` as double) as y", f"stack({len(predictors)}, {pairs}) as (variable, x)")


def stationarity_report(merged: DataFrame, order: str, columns: list[str]) -> DataFrame:
    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("at")
        return pd.DataFrame([{"variable": part["variable"].iloc[0], **stationarity(part["x"].to_numpy(dtype=float))}])

    schema = "variable string, adf_statistic double, adf_pvalue double, kpss_statistic double, kpss_pvalue double, is_stationary boolean, action_needed string"
    return long_form(merged, order, columns[0], columns).groupBy("variable").applyInPandas(run, schema)


def granger_report(merged: DataFrame, order: str, target: str, predictors: list[str], max_lag: int = 4, alpha: float = 0.05, least: int = 20, legacy_np_bool: bool = False) -> DataFrame:
    """(variable, transformation, target_transformation, optimal_lag, lag, f_statistic, p_value, significant).

    Target and predictors are differenced until stationary and aligned by their ends, which is by
    period. With `legacy_np_bool` predictors stay as they are. Fewer than `least` periods raise.
    """
    if (n := merged.count()) < least:
        raise NotEnoughData(f"{n} periods, {least} needed")

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("at")
        y, x, how_y, how_x = part["y"].to_numpy(dtype=float), part["x"].to_numpy(dtype=float), "none", "none"
        if stationarity(y)["is_stationary"] is False:
            y, how_y = made_stationary(y)
        order_ = var_order(y, x, max_lag)
        if stationarity(x)["is_stationary"] is False and not legacy_np_bool:
            x, how_x = made_stationary(x)
        m = min(len(x), len(y))
        rows = granger(y[-m:], x[-m:], max_lag, alpha)
        return pd.DataFrame([{"variable": part["variable"].iloc[0], "transformation": how_x, "target_transformation": how_y, "optimal_lag": order_, **r} for r in rows], columns=[c.split()[0] for c in schema.split(", ")])

    schema = "variable string, transformation string, target_transformation string, optimal_lag int, lag int, f_statistic double, p_value double, significant boolean"
    return long_form(merged, order, target, predictors).groupBy("variable").applyInPandas(run, schema)


def interpretation(report: DataFrame) -> DataFrame:
    """One row: which of A and B predict the target; NULL if either could not be tested."""
    any_of = lambda v: F.max(F.when(F.col("variable") == v, F.col("significant")))
    both = report.agg(any_of("sentiment_typeA").alias("a"), any_of("sentiment_typeB").alias("b"))
    a, b = F.col("a"), F.col("b")
    return both.withColumn(
        "interpretation", F.when(a.isNull() | b.isNull(), None).when(a & ~b, "only forward-looking news predicts").when(a & b, "both kinds predict").when(~a & b, "only backward-looking news predicts").otherwise("neither kind predicts")
    )


def synthetic_target(spark, n: int, seed: int = 42) -> DataFrame:
    """(period_num, vf_inflation): a random walk with drift, for trials only."""
    base = spark.range(1, n + 1).select(F.col("id").cast("int").alias("period_num"), (F.randn(seed) * 0.02 + 0.05).alias("vf_inflation"))
    return running_sum(base, "vf_inflation", "period_num")

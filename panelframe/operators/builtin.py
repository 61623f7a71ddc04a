"""The built-in transformers and composers, as Column expressions where Catalyst can say it."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce
from numbers import Real

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import kernels
from ..functions.expressions import (
    asset_order, average_rank, by, clip, dense_percent, gated, ieee_div, nearest_quantiles, nn, number, percent_rank, present, trailing, with_ddof, with_var_samp,
)
from .registry import TRANSFORMERS, composer, transformer


def _real(x, what: str) -> float:
    if isinstance(x, bool) or not isinstance(x, Real):
        raise TypeError(f"{what} must be a number")
    return float(x)


def _count(x, what: str, least: int = 1) -> int:
    if isinstance(x, bool) or not isinstance(x, int) or x < least:
        raise ValueError(f"{what} must be an integer of at least {least}")
    return x


# Element-wise --------------------------------------------------------------------------------

for _name, _f in {
    "identity": lambda v: v,
    "abs": F.abs,
    "abs_value": F.abs,
    "negate": lambda v: -v,
    "sign": lambda v: F.when(present(v), F.signum(v)),
    "sin": F.sin,
    "cos": F.cos,
    "arcsin": F.asin,
    "arccos": F.acos,
    "arctan": F.atan,
    "arctanh": lambda v: F.when(F.abs(v) < 1, 0.5 * F.ln((1 + v) / F.when(F.abs(v) < 1, 1 - v))),
    "fisher": lambda v: F.when(F.abs(v) < 1, 0.5 * F.ln((1 + v) / F.when(F.abs(v) < 1, 1 - v))),
    "trig": lambda v: F.when(F.abs(v) <= 1, F.acos(v) * F.asin(v)),
    "log": lambda v: F.when(v > 0, F.ln(v)),
    "log1p": lambda v: F.when(v > -1, F.ln(1 + v)),
    "signed_log1p": lambda v: F.signum(v) * F.ln(1 + F.abs(v)),
    "sqrt": F.sqrt,
    "freeman": lambda v: F.sqrt(v) + F.sqrt(v + 1),
    "posonly": lambda v: F.when(v >= 0, v),
    "negonly": lambda v: F.when(v <= 0, v),
    "replace_inf": lambda v: F.when(F.abs(v) != float("inf"), v),
    "non_nan_to_one": lambda v: F.when(present(v), number(1)).otherwise(v),
    "non_nan_to_zero": lambda v: F.when(present(v), number(0)).otherwise(v),
    "nonnans": lambda v: F.coalesce(nn(v), number(0)),
    "notnan": lambda v: present(v).cast("double"),
    "not_": lambda v: (~v.cast("boolean")).cast("double"),
}.items():
    transformer(_name)(_f)
transformer("power")(lambda v, exponent: F.pow(v, number(_real(exponent, "exponent"))))
transformer("signed_power")(lambda v, exponent: F.signum(v) * F.pow(F.abs(v), number(_real(exponent, "exponent"))))
transformer("boxcox")(lambda v, lambda_=0: F.when(v > 0, F.ln(v) if lambda_ == 0 else (F.pow(v, number(lambda_)) - 1) / number(lambda_)))
transformer("truncate")(lambda v, lower, upper: clip(v, number(_real(lower, "lower")), number(_real(upper, "upper"))))
transformer("trim")(lambda v, lower, upper: F.when(v.between(number(_real(lower, "lower")), number(_real(upper, "upper"))), v))
transformer("denoise")(lambda v, threshold=1e-12: F.when(F.abs(v) < number(threshold), number(0)).otherwise(v))
transformer("replace_non_nan")(lambda v, value: F.when(present(v), number(_real(value, "value"))).otherwise(v))
transformer("constant", dense=True)(lambda v, value=1: number(_real(value, "value")))

# Missing data, offsets -----------------------------------------------------------------------

transformer("fillna", dense=True)(lambda v, value=0: F.coalesce(nn(v), number(_real(value, "value"))))
transformer("fillna_zero", dense=True)(lambda v: F.coalesce(nn(v), number(0)))


@transformer("ffill", dense=True, trace="ffill")
def _ffill(v: Column, limit: int | None = None) -> Column:
    return F.last(nn(v), True).over(asset_order().rowsBetween(W.unboundedPreceding if limit is None else -_count(limit, "limit", 0), 0))


@transformer("bfill", dense=True, trace="bfill")
def _bfill(v: Column, limit: int | None = None) -> Column:
    return F.first(nn(v), True).over(asset_order().rowsBetween(0, W.unboundedFollowing if limit is None else _count(limit, "limit", 0)))


def _before(v: Column, n: int) -> Column:
    return F.lag(v, _count(n, "periods", 0)).over(asset_order())


transformer("lag", dense=True, trace="shift")(lambda v, periods=1: _before(v, periods))
transformer("diff", dense=True, trace="current_and_shift_max")(lambda v, periods=1: v - _before(v, periods))
transformer("delta", dense=True, trace="current_and_shift_max")(lambda v, interval=1: v - _before(v, interval))
transformer("rate_of_change", dense=True, trace="current_and_shift_max")(lambda v, interval=1: (v - _before(v, _count(interval, "interval"))) / number(interval))
transformer("pct_change", dense=True, trace="current_and_shift_max")(lambda v, periods=1: ieee_div(v, _before(v, periods)) - 1)
transformer("remove_repeated", dense=True)(lambda v: F.when(~F.coalesce(v == F.lag(v).over(asset_order()), F.lit(False)), v))


@transformer("date_age_constraint", dense=True)
def _age(v: Column, window: int, min_valid: int | None = None) -> Column:
    least = _count(window, "window") if min_valid is None else _count(min_valid, "min_valid")
    return F.when(F.count(nn(v)).over(trailing(window)) >= least, v)


# Rolling -------------------------------------------------------------------------------------


def _rolling(name: str, f, least_rows: int = 1):
    @transformer(name, dense=True, trace="rolling_max")
    def run(v: Column, window: int, min_periods: int | None = None, **more) -> Column:
        least = _count(window, "window") if min_periods is None else _count(min_periods, "min_periods", 0)
        if least > window:
            raise ValueError("min_periods exceeds window")
        return gated(f(v, trailing(window), **more), v, trailing(window), max(least, least_rows))

    return run


_rolling("rolling_mean", lambda v, w: F.avg(v).over(w))
_rolling("rolling_sum", lambda v, w: F.sum(v).over(w))
_rolling("rolling_min", lambda v, w: F.min(v).over(w))
_rolling("rolling_max", lambda v, w: F.max(v).over(w))
_rolling("rolling_var", lambda v, w, ddof=1: with_ddof(v, w, ddof))
_rolling("rolling_std", lambda v, w, ddof=1: F.sqrt(with_ddof(v, w, ddof)))
_rolling("rolling_median", lambda v, w: F.percentile(v, F.lit(0.5)).over(w))


def _skew(v: Column, w) -> Column:
    n = F.count(v).over(w)
    return F.when(n > 2, F.skewness(v).over(w) * F.sqrt(n * (n - 1)) / F.when(n > 2, n - 2))


def _kurt(v: Column, w) -> Column:
    n = F.count(v).over(w)
    return F.when(n > 3, ((n + 1) * F.kurtosis(v).over(w) + 6) * (n - 1) / F.when(n > 3, (n - 2) * (n - 3)))


_rolling("rolling_skew", _skew, 3)
_rolling("rolling_kurt", _kurt, 4)


def _rolling_zscore(v: Column, w, ddof: int = 1) -> Column:
    std = F.sqrt(with_ddof(nn(v), w, ddof))
    return F.when(std > 0, (F.last(nn(v), True).over(w) - F.avg(nn(v)).over(w)) / F.when(std > 0, std))


_rolling("rolling_zscore", _rolling_zscore)


#: Groups of assets for each shuffle partition: enough to even them out, few enough that a group is worth its overhead.
GROUPS_EACH = 4


def _by_asset(df: DataFrame, f) -> DataFrame:
    """f(arrays of an asset's columns by time; missing is nan) gives the new values; other columns stay. A group holds many assets."""
    names = ["value", *_factors(df)]
    groups = GROUPS_EACH * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("asset_id", "ascending"), ("time", "ascending")])
        asset = table.column("asset_id").combine_chunks().dictionary_encode().indices.to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(asset)) + 1).tolist(), len(asset)]
        arrays = {c: table.column(c).to_numpy().astype(float) for c in names}
        values = np.concatenate([f({c: x[a:b] for c, x in arrays.items()}) for a, b in zip(cuts[:-1], cuts[1:], strict=True)])
        out = table.drop_columns("_group")
        return out.set_column(out.schema.get_field_index("value"), "value", pa.array(values, pa.float64(), mask=np.isnan(values)))

    return df.withColumn("_group", F.pmod(F.xxhash64("asset_id"), F.lit(groups))).groupBy("_group").applyInArrow(run, df.schema)


def _factors(df: DataFrame) -> list[str]:
    return sorted((c for c in df.columns if c[0] == "v" and c[1:].isdigit()), key=lambda c: int(c[1:]))


def _ranked(name: str, share: bool):
    @transformer(name, dense=True, trace="rolling_max", frame=True)
    def run(df: DataFrame, window: int, min_periods: int | None = None) -> DataFrame:
        least = _count(window, "window") if min_periods is None else _count(min_periods, "min_periods", 0)
        if least > window:
            raise ValueError("min_periods exceeds window")
        return _by_asset(df, lambda x: kernels.rolling_rank(x["value"], window, max(least, 1), share))


_ranked("rolling_rank", False)
_ranked("rolling_percentile", True)


def _ewm(name: str, bias_of, last=lambda x: x):
    @transformer(name, dense=True, trace="rolling_max", frame=True)
    def run(df: DataFrame, com=None, span=None, halflife=None, alpha=None, min_periods: int = 0, adjust: bool = True, ignore_na: bool = False, **more) -> DataFrame:
        a, bias = kernels.decay(com, span, halflife, alpha), bias_of(**more)
        return _by_asset(df, lambda x: last(kernels.ewm(x["value"], a, adjust, ignore_na, min_periods, bias)))

    return run


_ewm_mean = _ewm("ewm_mean", lambda: None)
_ewm("ewm_var", lambda bias=False: bias)
_ewm("ewm_std", lambda bias=False: bias, np.sqrt)
transformer("rolling_ewm_fw", dense=True, trace="rolling_max", frame=True)(lambda df, halflife, min_periods=0: _ewm_mean.frame(df, halflife=halflife, min_periods=min_periods))


def _kelly(v: Column, window: int, last=lambda x: x) -> Column:
    w = trailing(_count(window, "window", 2))
    return gated(with_var_samp(v, w, lambda var: last(ieee_div(F.avg(v).over(w), var))), v, w, window)


def _steps(df: DataFrame, *steps) -> DataFrame:
    """Window expressions cannot be nested, so each step is a projection of its own."""
    return reduce(lambda d, f: d.withColumn("value", f(F.col("value"))), steps, df)


def _zscore(v: Column, *keys: str | Column) -> Column:
    return ieee_div(v - F.avg(v).over(by(*keys)), F.stddev_samp(v).over(by(*keys)))


transformer("kelly")(_kelly)
transformer("kelly_nonan_standardize", frame=True)(lambda df, window: _steps(df, lambda v: F.coalesce(nn(v), number(0)), lambda v: _zscore(v, "time"), lambda v: _kelly(v, window)))
transformer("kelly_rank_boxcox", frame=True)(lambda df, window, lambda_=0: _steps(df, lambda v: percent_rank(v, "time"), lambda v: F.ln(v) if lambda_ == 0 else (F.pow(v, number(lambda_)) - 1) / number(lambda_), lambda v: _kelly(v, window)))
transformer("kelly_rescaling_weight")(lambda v, window: _kelly(v, window, lambda x: clip(x, number(0), number(1))))

# Cross-section -------------------------------------------------------------------------------


def _min_max(v: Column) -> Column:
    low, high = F.min(v).over(by("time")), F.max(v).over(by("time"))
    return ieee_div(v - low, high - low)


def _net(v: Column) -> Column:
    plus, minus = F.sum(F.when(v > 0, v)).over(by("time")), F.sum(F.when(v < 0, -v)).over(by("time"))
    return F.when(v > 0, v / F.when(v > 0, plus)).when(v < 0, v / F.when(v < 0, minus)).otherwise(v)


def _quantiles(lower: float, upper: float) -> tuple[float, float]:
    if not 0 <= lower <= upper <= 1:
        raise ValueError("0 <= lower <= upper <= 1 must hold")
    return lower, upper


for _name, _f in {
    "rank": lambda v: percent_rank(v, "time"),
    "nrank": lambda v: 2 * percent_rank(v, "time") - 1,
    "logrank": lambda v: F.ln(percent_rank(v, "time")),
    "log_rank": lambda v: F.ln(percent_rank(v, "time")),
    "inv_log_sqrt_rank": lambda v: -F.ln(percent_rank(v, "time")) / F.sqrt(percent_rank(v, "time")),
    "demean": lambda v: v - F.avg(v).over(by("time")),
    "translate_to_pos": lambda v: v - F.min(v).over(by("time")),
    "anscombe": lambda v: 2 * F.sqrt(v - F.min(v).over(by("time")) + 0.375),
    "zscore": lambda v: _zscore(v, "time"),
    "min_max_scale": _min_max,
    "normalize": lambda v: 2 * _min_max(v) - 1,
    "net_scale": _net,
}.items():
    transformer(_name)(_f)


transformer("rankpct", frame=True)(lambda df: dense_percent(df, "time"))


def _between_quantiles(df: DataFrame, lower: float, upper: float, f) -> DataFrame:
    lower, upper = _quantiles(lower, upper)
    return nearest_quantiles(df, {"_low": lower, "_high": upper}, "time").withColumn("value", f(F.col("value"), F.col("_low"), F.col("_high"))).drop("_low", "_high")


@transformer("winsorize", frame=True)
def _winsorize(df: DataFrame, lower: float = 0.01, upper: float = 0.99) -> DataFrame:
    return _between_quantiles(df, lower, upper, clip)


@transformer("trim_quantile", frame=True)
def _trim_quantile(df: DataFrame, lower: float = 0.01, upper: float = 0.99) -> DataFrame:
    return _between_quantiles(df, lower, upper, lambda v, low, high: F.when(v.between(low, high), v))


# Groups and auxiliary panels -----------------------------------------------------------------

for _name, _f in {
    "group_rank": lambda v, g: average_rank(v, "time", g),
    "group_percentile": lambda v, g: percent_rank(v, "time", g),
    "group_mean": lambda v, g: F.avg(v).over(by("time", g)),
    "group_max": lambda v, g: F.max(v).over(by("time", g)),
    "group_min": lambda v, g: F.min(v).over(by("time", g)),
    "group_median": lambda v, g: F.median(v).over(by("time", g)),
    "group_std": lambda v, g: F.stddev_samp(v).over(by("time", g)),
    "group_demean": lambda v, g: v - F.avg(v).over(by("time", g)),
    "group_zscore": lambda v, g: _zscore(v, "time", g),
}.items():
    transformer(_name, trace="parent_max", panels=("group",))(_f)

transformer("group_rankpct", trace="parent_max", panels=("group",), frame=True)(lambda df: dense_percent(df, "time", "v1").drop("v1"))
transformer("project", trace="parent_max", panels=("binary",))(lambda v, b: F.when(b == 1.0, v))
transformer("mask", trace="parent_max", panels=("mask_frame",))(lambda v, m, replace_value=math.nan: F.when(F.coalesce(nn(m), number(0)).cast("boolean"), v).otherwise(number(replace_value)))
transformer("vol_scale", trace="parent_max", panels=("volatility",))(lambda v, s: ieee_div(v, s))


@transformer("orthogonalize", trace="parent_max", many="factors", frame=True)
def _orthogonalize(df: DataFrame, fit_intercept: bool = False) -> DataFrame:
    names = _factors(df)
    if len(names) == 1 and not fit_intercept:  # one factor is two sums over the date
        v, x = F.col("value"), F.col(names[0])
        ok = present(v) & present(x) & (F.abs(v) != float("inf")) & (F.abs(x) != float("inf"))
        top, bottom = F.sum(F.when(ok, x * v)).over(by("time")), F.sum(F.when(ok, x * x)).over(by("time"))
        return df.withColumn("value", F.when(ok, v - x * F.when(bottom != 0, top / F.when(bottom != 0, bottom)).otherwise(0.0)))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        r = kernels.residuals(pdf["value"].to_numpy(float), pdf[names].to_numpy(float), fit_intercept)
        return pdf.assign(value=pd.Series(r, index=pdf.index).astype(object).where(~np.isnan(r), None))

    return df.groupBy("time").applyInPandas(run, df.schema)


def _regression(name: str, method: str, settings):
    @transformer(name, dense=True, trace="parent_max", many="factors", frame=True)
    def run(df: DataFrame, window: int, **more) -> DataFrame:
        _count(window, "window")
        names, fit = _factors(df), kernels.FITS[method](*settings(**more))
        return _by_asset(df, lambda x: kernels.rolling_fit(x["value"], np.column_stack([x[c] for c in names]), window, fit))

    return run


_regression("rolling_ols", "ols", lambda: ())
_regression("rolling_ridge", "ridge", lambda alpha=1.0: (alpha,))
_regression("rolling_lasso", "elastic_net", lambda alpha=1.0, max_iter=1000, tolerance=1e-8: (alpha, 1.0, max_iter, tolerance))
_regression("rolling_elastic_net", "elastic_net", lambda alpha=1.0, l1_ratio=0.5, max_iter=1000, tolerance=1e-8: (alpha, l1_ratio, max_iter, tolerance))

# Composers -----------------------------------------------------------------------------------


def _bool(c: Column) -> Column:
    return c.cast("boolean")


for _name, _f in {
    "and_": lambda a, b: (_bool(a) & _bool(b)).cast("double"),
    "or_": lambda a, b: (_bool(a) | _bool(b)).cast("double"),
    "xor": lambda a, b: (_bool(a) != _bool(b)).cast("double"),
    "xand": lambda a, b: (_bool(a) == _bool(b)).cast("double"),
    "greater": lambda a, b: (a > b).cast("double"),
    "greater_equal": lambda a, b: (a >= b).cast("double"),
    "less": lambda a, b: (a < b).cast("double"),
    "less_equal": lambda a, b: (a <= b).cast("double"),
    "equal": lambda a, b: (a == b).cast("double"),
    "add": lambda a, b: a + b,
    "sub": lambda a, b: a - b,
    "mul": lambda a, b: a * b,
    "div": lambda a, b: F.try_divide(a, b),
    "power_df": lambda a, b: F.pow(a, b),
}.items():
    composer(_name)(_f)

composer("sum_frames", arity=None)(lambda *c: reduce(lambda a, b: a + b, c))
composer("mean", arity=None)(lambda *c: reduce(lambda a, b: a + b, c) / number(len(c)))
composer("product", arity=None)(lambda *c: reduce(lambda a, b: a * b, c))
composer("minimum", arity=None)(lambda *c: F.least(*c))
composer("maximum", arity=None)(lambda *c: F.greatest(*c))
composer("coalesce", arity=None)(lambda *c: F.coalesce(*c))


def _weights(weights: Sequence[float], n: int) -> list[float]:
    if len(weights) != n:
        raise ValueError(f"{n} panels need as many weights, not {len(weights)}")
    return [_real(w, "weight") for w in weights]


@composer("weighted_sum", arity=None)
def _weighted_sum(*c: Column, weights: Sequence[float]) -> Column:
    return reduce(lambda a, b: a + b, [x * number(w) for x, w in zip(c, _weights(weights, len(c)), strict=True)])


@composer("weighted_mean", arity=None)
def _weighted_mean(*c: Column, weights: Sequence[float]) -> Column:
    total = sum(_weights(weights, len(c)))
    if total == 0:
        raise ValueError("the weights add up to zero")
    return _weighted_sum.column(*c, weights=weights) / number(total)


def _pair(a: Column, b: Column) -> tuple[Column, Column]:
    both = present(a) & present(b)
    return F.when(both, a), F.when(both, b)


@composer("rolling_corr", dense=True)
def _rolling_corr(a: Column, b: Column, window: int, min_periods: int | None = None) -> Column:
    least = _count(window, "window") if min_periods is None else _count(min_periods, "min_periods", 0)
    w, (a, b) = trailing(window), _pair(a, b)
    scale = F.sqrt(F.var_pop(a).over(w) * F.var_pop(b).over(w))  # zero if a side is flat
    return gated(clip(F.covar_pop(a, b).over(w) / F.when(scale > 0, scale), number(-1), number(1)), a, w, max(least, 2))


@composer("rolling_cov", dense=True)
def _rolling_cov(a: Column, b: Column, window: int, min_periods: int | None = None, ddof: int = 1) -> Column:
    least = _count(window, "window") if min_periods is None else _count(min_periods, "min_periods", 0)
    w, (a, b) = trailing(window), _pair(a, b)
    n = F.count(a).over(w)
    return gated(F.when(n > ddof, F.covar_pop(a, b).over(w) * n / F.when(n > ddof, n - ddof)), a, w, max(least, 1))


def pct_change_frame(frame: DataFrame, *, periods: int = 1) -> DataFrame:
    """pct_change of a bare frame (time, asset_id, value), without a graph."""
    if isinstance(periods, bool) or not isinstance(periods, int):
        raise TypeError("periods must be an integer")
    if periods < 1:
        raise ValueError("periods must be positive")
    return TRANSFORMERS.get("pct_change").operation(frame, periods=periods)

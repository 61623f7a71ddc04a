"""Column building blocks: missing values, IEEE division, ranks, quantiles, frames."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def nn(v: Column) -> Column:
    """NaN as null."""
    return F.when(~F.isnan(v), v)


def present(v: Column) -> Column:
    return v.isNotNull() & ~F.isnan(v)


def number(x: float) -> Column:
    return F.lit(float(x))


def ieee_div(a: Column, b: Column) -> Column:
    """Division as IEEE has it: x/0 is an infinity, 0/0 is NaN; null stays null."""
    by_zero = F.when(a > 0, number("inf")).when(a < 0, number("-inf")).when(a.isNotNull(), number("nan"))
    return F.when(b == 0, F.when(F.isnan(a), number("nan")).otherwise(by_zero)).otherwise(a / F.when(b != 0, b))


def rounded(v: Column, digits: int) -> Column:
    """round() as the catalog's SQL has it: the double times 10**digits, to a whole number, half away from zero. F.round() takes the double's shortest decimal
    text instead, and ties such as -10731/640 then go the other way. Infinities, NaN and what overflows stay."""
    scaled = v * number(10**digits)
    return F.when(F.abs(scaled) < number("inf"), F.round(scaled) / number(10**digits)).otherwise(v)


def clip(v: Column, low: Column, high: Column) -> Column:
    """Null bounds or values give the value: greatest() would skip nulls."""
    return F.when(v < low, low).when(v > high, high).otherwise(v)


def by(*keys: str | Column) -> WindowSpec:
    return W.partitionBy(*keys)


def asset_order() -> WindowSpec:
    return W.partitionBy("asset_id").orderBy("time")


def trailing(window: int) -> WindowSpec:
    return asset_order().rowsBetween(-(window - 1), 0)


def average_rank(v: Column, *keys: str | Column) -> Column:
    """1-based rank with ties averaged, among non-null values of the keys' group."""
    return F.when(v.isNotNull(), F.rank().over(W.partitionBy(*keys).orderBy(v.asc_nulls_last())) + (F.count(v).over(W.partitionBy(*keys, v)) - 1) / 2.0)


def percent_rank(v: Column, *keys: str | Column) -> Column:
    return average_rank(v, *keys) / F.count(v).over(by(*keys))


def dense_percent(df: DataFrame, *keys: str) -> DataFrame:
    """value becomes its dense rank over the number of distinct values, where a null counts as one: nulls come last, so that is the largest rank."""
    rank = F.dense_rank().over(W.partitionBy(*keys).orderBy(F.col("value").asc_nulls_last()))
    ranked = df.withColumn("_rank", rank).withColumn("_ranks", F.max("_rank").over(by(*keys)))
    return ranked.withColumn("value", F.when(F.col("value").isNotNull(), F.col("_rank") / F.col("_ranks"))).drop("_rank", "_ranks")


def nearest_quantiles(df: DataFrame, quantiles: dict[str, float], key: str) -> DataFrame:
    """Adds a column for each quantile: the key's value at the nearest rank to q * (n - 1), half away from zero. One sort for all."""
    v = nn(F.col("value"))
    ranked = df.withColumn("_at", F.row_number().over(W.partitionBy(key).orderBy(v.asc_nulls_last()))).withColumn("_n", F.count(v).over(by(key)))
    at = {c: F.floor(F.lit(q) * (F.col("_n") - 1) + 0.5) + 1 for c, q in quantiles.items()}
    return ranked.withColumns({c: F.max(F.when(F.col("_at") == i, v)).over(by(key)) for c, i in at.items()}).drop("_at", "_n")


def gated(x: Column, v: Column, frame: WindowSpec, least: int) -> Column:
    return F.when(F.count(v).over(frame) >= least, x)


def with_ddof(v: Column, frame: WindowSpec, ddof: int) -> Column:
    n = F.count(v).over(frame)
    return F.when(n > ddof, F.var_pop(v).over(frame) * n / F.when(n > ddof, n - ddof))


def with_var_samp(v: Column, frame: WindowSpec, f: Callable[[Column], Column]) -> Column:
    """f(var_samp over a frame), in the order of operations of the catalog's SQL: squares grow by (v - new mean) * (v - old mean). F.var_samp() takes
    (v - mean) * ((v - mean) - (v - mean) / n), whose last bits differ; a quotient at a rounding tie shows them. A row's list is folded once, f is applied in the fold."""
    start = F.struct(number(0).alias("n"), number(0).alias("mean"), number(0).alias("squares"))

    def grow(s: Column, x: Column) -> Column:
        n = s["n"] + 1
        mean = s["mean"] + (x - s["mean"]) / n
        return F.struct(n.alias("n"), mean.alias("mean"), (s["squares"] + (x - mean) * (x - s["mean"])).alias("squares"))

    return F.aggregate(F.collect_list(v).over(frame), start, grow, lambda s: f(s["squares"] / F.when(s["n"] > 1, s["n"] - 1)))

"""One query for each built-in operator over panels made of the driver tables, with its SQL.

Panels: month x supplier of lineitem. x has nulls put in, y and g (the nation) do not; keys are unique.
Values are whole numbers, so sums do not depend on the order of rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.expressions import rounded
from ..operators import builtin  # noqa: F401  registers the operators
from ..operators.registry import COMPOSERS, TRANSFORMERS
from ..sources.panel import CategoryPanel, Domain, Panel
from .graph import Graph

BASE_SQL = """
p AS (
  SELECT CAST(date_trunc('month', l_shipdate) AS DATE) AS time, CAST(l_suppkey AS VARCHAR) AS asset_id,
    CAST(CASE WHEN (month(min(l_shipdate)) * 7 + l_suppkey * 3) % 29 = 0 THEN NULL ELSE sum(CAST(l_quantity AS BIGINT)) - 150 END AS DOUBLE) AS x,
    CAST(sum(CAST(round(l_discount * 100) AS BIGINT)) - 20 AS DOUBLE) AS y,
    CAST(l_suppkey % 5 AS VARCHAR) AS g
  FROM lineitem GROUP BY date_trunc('month', l_shipdate), l_suppkey
),
grid AS (SELECT t.time, a.asset_id FROM (SELECT DISTINCT time FROM p) t, (SELECT DISTINCT asset_id FROM p) a),
d AS (SELECT grid.time, grid.asset_id, x, y, g, p.time IS NOT NULL AS here FROM grid LEFT JOIN p USING (time, asset_id))"""


def base(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_shipdate", "l_suppkey", "l_quantity", "l_discount")  # noqa: E741
    month = F.to_date(F.date_trunc("month", "l_shipdate"))
    q = F.sum(F.col("l_quantity").cast("long")) - 150
    out = l.groupBy(month.alias("time"), "l_suppkey").agg(q.alias("q"), (F.sum(F.round(F.col("l_discount") * 100).cast("long")) - 20).cast("double").alias("y"))
    hole = (F.month("time") * 7 + F.col("l_suppkey") * 3) % 29 == 0
    return out.select("time", F.col("l_suppkey").cast("string").alias("asset_id"), F.when(~hole, F.col("q")).cast("double").alias("x"), "y", (F.col("l_suppkey") % 5).cast("string").alias("g"))


_kept: dict[tuple[str, str], DataFrame] = {}


def kept_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """base(), kept in the executors' memory and disk: all panels, the calendar and the universe of a session read lineitem once.
    A lost executor's part is made again."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _kept:
        _kept[key] = base(spark, sf_dir).persist()
    return _kept[key]


def panels(spark: SparkSession, sf_dir: str) -> dict[str, Panel]:
    frame = kept_base(spark, sf_dir)
    domain = Domain.of(frame, identity=f"months-suppliers {sf_dir}")
    return Panel.columns_of(frame, domain, {"x": Panel, "y": Panel, "g": CategoryPanel}, identity=f"lineitem {sf_dir}")


def result(graph: Graph) -> DataFrame:
    panel = graph.compute()
    return panel.lazy(dense=True).withColumn("value", rounded(F.col("value"), 6) + F.lit(0.0))


def _sql(value: str, source: str = "d", ctes: str = "") -> str:
    if source == "d" and not ctes:
        return f"WITH {BASE_SQL}, r AS (SELECT time, asset_id, CAST({value} AS DOUBLE) AS v FROM d) SELECT time, asset_id, CASE WHEN isnan(v) THEN NULL ELSE round(v, 6) + 0.0 END AS value FROM r"
    return f"WITH {BASE_SQL}, {ctes} r AS (SELECT time, asset_id, CAST({value} AS DOUBLE) AS v FROM {source}) SELECT grid.time, grid.asset_id, CASE WHEN isnan(v) THEN NULL ELSE round(v, 6) + 0.0 END AS value FROM grid LEFT JOIN r USING (time, asset_id)"


WA = "PARTITION BY asset_id ORDER BY time"
WR = f"({WA} ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)"
WT = "(PARTITION BY time)"
WG = "(PARTITION BY time, g)"


def _avg_rank(v: str, keys: str) -> str:
    return f"(CASE WHEN {v} IS NOT NULL THEN rank() OVER (PARTITION BY {keys} ORDER BY {v} ASC NULLS LAST) + (count({v}) OVER (PARTITION BY {keys}, {v}) - 1) / 2.0 END)"


def _pct(v: str, keys: str) -> str:
    return f"({_avg_rank(v, keys)} / count({v}) OVER (PARTITION BY {keys}))"


def _dense(v: str, keys: str) -> str:
    return f"(CASE WHEN {v} IS NOT NULL THEN dense_rank() OVER (PARTITION BY {keys} ORDER BY {v} ASC NULLS LAST) / (count(DISTINCT {v}) OVER (PARTITION BY {keys}) + max(CAST({v} IS NULL AS INT)) OVER (PARTITION BY {keys})) END)"


def _gate(e: str, n: int = 3) -> str:
    return f"CASE WHEN count(x) OVER {WR} >= {n} THEN {e} END"


def _ieee(a: str, b: str) -> str:
    return f"(CASE WHEN ({b}) = 0 THEN CASE WHEN ({a}) > 0 THEN CAST('inf' AS DOUBLE) WHEN ({a}) < 0 THEN CAST('-inf' AS DOUBLE) WHEN ({a}) IS NOT NULL THEN CAST('nan' AS DOUBLE) END ELSE ({a}) / nullif(({b}), 0) END)"


def _nearest(q: float) -> str:
    return f"list_extract(list_sort(list(x) FILTER (WHERE x IS NOT NULL) OVER {WT}), CAST(floor({q} * (count(x) OVER {WT} - 1) + 0.5) AS BIGINT) + 1)"


_N = f"(count(x) OVER {WR})"
_VAR = f"(var_pop(x) OVER {WR} * {_N} / nullif({_N} - 1, 0))"
_XY = "CASE WHEN y IS NOT NULL THEN x END"
_YX = "CASE WHEN x IS NOT NULL THEN y END"
_Z = _ieee(f"x - avg(x) OVER {WT}", f"stddev_samp(x) OVER {WT}")
_MM = _ieee(f"x - min(x) OVER {WT}", f"max(x) OVER {WT} - min(x) OVER {WT}")
_K3 = f"({WA} ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)"


def _kelly(v: str) -> str:
    return f"(CASE WHEN count({v}) OVER {_K3} >= 3 THEN {_ieee(f'avg({v}) OVER {_K3}', f'var_samp({v}) OVER {_K3}')} END)"


_WINDOW = {"window": 5, "min_periods": 3}
#: name -> parameters and the SQL value over d (grid rows with x, y, g; `here` tells present keys).
TRANSFORMER_CASES: dict[str, tuple[dict, str | None]] = {
    "identity": ({}, "x"),
    "abs": ({}, "abs(x)"),
    "abs_value": ({}, "abs(x)"),
    "negate": ({}, "-x"),
    "sign": ({}, "CAST(sign(x) AS DOUBLE)"),
    "sin": ({}, "sin(x)"),
    "cos": ({}, "cos(x)"),
    "arcsin": ({}, "CASE WHEN abs(x) <= 1 THEN asin(CASE WHEN abs(x) <= 1 THEN x END) END"),
    "arccos": ({}, "CASE WHEN abs(x) <= 1 THEN acos(CASE WHEN abs(x) <= 1 THEN x END) END"),
    "arctan": ({}, "atan(x)"),
    "arctanh": ({}, "CASE WHEN abs(x) < 1 THEN 0.5 * ln((1 + CASE WHEN abs(x) < 1 THEN x END) / (1 - CASE WHEN abs(x) < 1 THEN x END)) END"),
    "fisher": ({}, "CASE WHEN abs(x) < 1 THEN 0.5 * ln((1 + CASE WHEN abs(x) < 1 THEN x END) / (1 - CASE WHEN abs(x) < 1 THEN x END)) END"),
    "trig": ({}, "CASE WHEN abs(x) <= 1 THEN acos(CASE WHEN abs(x) <= 1 THEN x END) * asin(CASE WHEN abs(x) <= 1 THEN x END) END"),
    "log": ({}, "CASE WHEN x > 0 THEN ln(CASE WHEN x > 0 THEN x END) END"),
    "log1p": ({}, "CASE WHEN x > -1 THEN ln(1 + CASE WHEN x > -1 THEN x END) END"),
    "signed_log1p": ({}, "sign(x) * ln(1 + abs(x))"),
    "power": ({"exponent": 2}, "pow(x, 2.0)"),
    "signed_power": ({"exponent": 0.5}, "sign(x) * pow(abs(x), 0.5)"),
    "sqrt": ({}, "CASE WHEN x >= 0 THEN sqrt(CASE WHEN x >= 0 THEN x END) END"),
    "boxcox": ({"lambda_": 0.5}, "CASE WHEN x > 0 THEN (pow(CASE WHEN x > 0 THEN x END, 0.5) - 1) / 0.5 END"),
    "freeman": ({}, "CASE WHEN x >= 0 THEN sqrt(CASE WHEN x >= 0 THEN x END) + sqrt(CASE WHEN x >= 0 THEN x + 1 END) END"),
    "truncate": ({"lower": -50, "upper": 80}, "CASE WHEN x < -50 THEN -50.0 WHEN x > 80 THEN 80.0 ELSE x END"),
    "trim": ({"lower": -50, "upper": 80}, "CASE WHEN x BETWEEN -50 AND 80 THEN x END"),
    "denoise": ({"threshold": 20}, "CASE WHEN abs(x) < 20 THEN 0.0 ELSE x END"),
    "posonly": ({}, "CASE WHEN x >= 0 THEN x END"),
    "negonly": ({}, "CASE WHEN x <= 0 THEN x END"),
    "replace_inf": ({}, "x"),
    "replace_non_nan": ({"value": 7}, "CASE WHEN x IS NOT NULL THEN 7.0 END"),
    "non_nan_to_one": ({}, "CASE WHEN x IS NOT NULL THEN 1.0 END"),
    "non_nan_to_zero": ({}, "CASE WHEN x IS NOT NULL THEN 0.0 END"),
    "constant": ({"value": 3}, "CAST(3 AS DOUBLE)"),
    "nonnans": ({}, "CASE WHEN here THEN coalesce(x, 0.0) END"),
    "notnan": ({}, "CASE WHEN here THEN CAST(x IS NOT NULL AS DOUBLE) END"),
    "fillna": ({"value": 2}, "coalesce(x, 2.0)"),
    "fillna_zero": ({}, "coalesce(x, 0.0)"),
    "ffill": ({"limit": 2}, f"last_value(x IGNORE NULLS) OVER ({WA} ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)"),
    "bfill": ({}, f"first_value(x IGNORE NULLS) OVER ({WA} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)"),
    "lag": ({"periods": 2}, f"lag(x, 2) OVER ({WA})"),
    "diff": ({"periods": 2}, f"x - lag(x, 2) OVER ({WA})"),
    "delta": ({"interval": 1}, f"x - lag(x, 1) OVER ({WA})"),
    "rate_of_change": ({"interval": 3}, f"(x - lag(x, 3) OVER ({WA})) / 3.0"),
    "pct_change": ({"periods": 1}, _ieee("x", f"lag(x, 1) OVER ({WA})") + " - 1"),
    "remove_repeated": ({}, f"CASE WHEN x = lag(x) OVER ({WA}) THEN NULL ELSE x END"),
    "date_age_constraint": ({"window": 4, "min_valid": 4}, f"CASE WHEN count(x) OVER ({WA} ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) >= 4 THEN x END"),
    "rolling_mean": (_WINDOW, _gate(f"avg(x) OVER {WR}")),
    "rolling_sum": (_WINDOW, _gate(f"sum(x) OVER {WR}")),
    "rolling_min": (_WINDOW, _gate(f"min(x) OVER {WR}")),
    "rolling_max": (_WINDOW, _gate(f"max(x) OVER {WR}")),
    "rolling_var": (_WINDOW, _gate(_VAR)),
    "rolling_std": (_WINDOW, _gate(f"sqrt({_VAR})")),
    "rolling_median": (_WINDOW, _gate(f"median(x) OVER {WR}")),
    "rolling_skew": (_WINDOW, _gate(f"skewness(x) OVER {WR}")),
    "rolling_kurt": (_WINDOW, _gate(f"kurtosis(x) OVER {WR}", 4)),
    "rolling_zscore": (_WINDOW, _gate(f"(last_value(x IGNORE NULLS) OVER {WR} - avg(x) OVER {WR}) / nullif(sqrt({_VAR}), 0)")),
    "rolling_rank": (_WINDOW, None),
    "rolling_percentile": (_WINDOW, None),
    "ewm_mean": ({"span": 4}, None),
    "ewm_var": ({"span": 4}, None),
    "ewm_std": ({"span": 4}, None),
    "rolling_ewm_fw": ({"halflife": 2.0}, None),
    "kelly": ({"window": 3}, None),
    "kelly_nonan_standardize": ({"window": 3}, None),
    "kelly_rank_boxcox": ({"window": 3}, None),
    "kelly_rescaling_weight": ({"window": 3}, None),
    "rank": ({}, _pct("x", "time")),
    "rankpct": ({}, None),
    "nrank": ({}, f"2 * {_pct('x', 'time')} - 1"),
    "logrank": ({}, f"ln({_pct('x', 'time')})"),
    "log_rank": ({}, f"ln({_pct('x', 'time')})"),
    "inv_log_sqrt_rank": ({}, f"-ln({_pct('x', 'time')}) / sqrt({_pct('x', 'time')})"),
    "demean": ({}, f"x - avg(x) OVER {WT}"),
    "translate_to_pos": ({}, f"x - min(x) OVER {WT}"),
    "anscombe": ({}, f"2 * sqrt(x - min(x) OVER {WT} + 0.375)"),
    "zscore": ({}, _Z),
    "min_max_scale": ({}, _MM),
    "normalize": ({}, f"2 * {_MM} - 1"),
    "net_scale": ({}, f"CASE WHEN x > 0 THEN x / sum(CASE WHEN x > 0 THEN x END) OVER {WT} WHEN x < 0 THEN x / sum(CASE WHEN x < 0 THEN -x END) OVER {WT} ELSE x END"),
    "winsorize": ({"lower": 0.05, "upper": 0.9}, f"CASE WHEN x < {_nearest(0.05)} THEN {_nearest(0.05)} WHEN x > {_nearest(0.9)} THEN {_nearest(0.9)} ELSE x END"),
    "trim_quantile": ({"lower": 0.05, "upper": 0.9}, f"CASE WHEN x BETWEEN {_nearest(0.05)} AND {_nearest(0.9)} THEN x END"),
    "group_rank": ({"group": "g"}, _avg_rank("x", "time, g")),
    "group_percentile": ({"group": "g"}, _pct("x", "time, g")),
    "group_rankpct": ({"group": "g"}, None),
    "group_mean": ({"group": "g"}, f"CASE WHEN here THEN avg(x) OVER {WG} END"),
    "group_max": ({"group": "g"}, f"CASE WHEN here THEN max(x) OVER {WG} END"),
    "group_min": ({"group": "g"}, f"CASE WHEN here THEN min(x) OVER {WG} END"),
    "group_median": ({"group": "g"}, f"CASE WHEN here THEN median(x) OVER {WG} END"),
    "group_std": ({"group": "g"}, f"CASE WHEN here THEN stddev_samp(x) OVER {WG} END"),
    "group_demean": ({"group": "g"}, f"x - avg(x) OVER {WG}"),
    "group_zscore": ({"group": "g"}, _ieee(f"x - avg(x) OVER {WG}", f"stddev_samp(x) OVER {WG}")),
    "orthogonalize": ({"factors": ["y"]}, f"x - y * coalesce(sum(x * y) OVER {WT} / nullif(sum(CASE WHEN x IS NOT NULL THEN y * y END) OVER {WT}, 0), 0)"),
    "project": ({"binary": "y"}, "CASE WHEN y = 1 THEN x END"),
    "mask": ({"mask_frame": "y"}, "CASE WHEN y <> 0 THEN x END"),
    "vol_scale": ({"volatility": "y"}, _ieee("x", "y")),
    "rolling_ols": ({"factors": ["y"], "window": 12}, None),
    "rolling_ridge": ({"factors": ["y"], "window": 12, "alpha": 2.0}, None),
    "rolling_lasso": ({"factors": ["y"], "window": 12, "alpha": 1.0, "max_iter": 100}, None),
    "rolling_elastic_net": ({"factors": ["y"], "window": 12, "alpha": 1.0, "max_iter": 100}, None),
    "not_": ({}, "CAST(x = 0 AS DOUBLE)"),
}
_B = {"and_": "AND", "or_": "OR"}
COMPOSER_CASES: dict[str, tuple[list[str], dict, str]] = {
    **{n: (["x", "y"], {}, f"CASE WHEN here THEN CAST((x <> 0) {o} (y <> 0) AS DOUBLE) END") for n, o in _B.items()},
    "xor": (["x", "y"], {}, "CAST((x <> 0) <> (y <> 0) AS DOUBLE)"),
    "xand": (["x", "y"], {}, "CAST((x <> 0) = (y <> 0) AS DOUBLE)"),
    **{n: (["x", "y"], {}, f"CAST(x {o} y AS DOUBLE)") for n, o in {"greater": ">", "greater_equal": ">=", "less": "<", "less_equal": "<=", "equal": "="}.items()},
    **{n: (["x", "y"], {}, f"x {o} y") for n, o in {"add": "+", "sub": "-", "mul": "*"}.items()},
    "div": (["x", "y"], {}, "x / nullif(y, 0)"),
    "power_df": (["x", "x"], {}, "CASE WHEN abs(x) <= 1000 THEN pow(x, x) END"),
    "sum_frames": (["x", "y", "x"], {}, "x + y + x"),
    "mean": (["x", "y", "x"], {}, "(x + y + x) / 3.0"),
    "product": (["x", "y"], {}, "x * y"),
    "minimum": (["x", "y"], {}, "least(x, y)"),
    "maximum": (["x", "y"], {}, "greatest(x, y)"),
    "weighted_sum": (["x", "y"], {"weights": [0.5, 2.0]}, "x * 0.5 + y * 2.0"),
    "weighted_mean": (["x", "y"], {"weights": [0.5, 2.0]}, "(x * 0.5 + y * 2.0) / 2.5"),
    "coalesce": (["x", "y"], {}, "coalesce(x, y)"),
    "rolling_corr": (["x", "y"], _WINDOW, f"CASE WHEN count({_XY}) OVER {WR} >= 3 AND var_pop({_XY}) OVER {WR} > 0 AND var_pop({_YX}) OVER {WR} > 0 THEN corr(x, y) OVER {WR} END"),
    "rolling_cov": (["x", "y"], _WINDOW, f"CASE WHEN count({_XY}) OVER {WR} >= 3 THEN covar_samp(x, y) OVER {WR} END"),
}
#: Sparse-row windows and lists need more than an expression over d.
SPECIAL_SQL = {
    "kelly": _sql(_kelly("x"), "p", " "),
    "kelly_rescaling_weight": _sql(f"CASE WHEN {_kelly('x')} < 0 THEN 0.0 WHEN {_kelly('x')} > 1 THEN 1.0 ELSE {_kelly('x')} END", "p", " "),
    "kelly_nonan_standardize": _sql(_kelly("z"), "s", f"n AS (SELECT time, asset_id, coalesce(x, 0.0) AS x FROM p), s AS (SELECT time, asset_id, {_Z} AS z FROM n),"),
    "kelly_rank_boxcox": _sql(_kelly("z"), "s", f"s AS (SELECT time, asset_id, ln({_pct('x', 'time')}) AS z FROM p),"),
    "rankpct": _sql("CASE WHEN x IS NOT NULL THEN dense_rank() OVER (PARTITION BY time ORDER BY x NULLS LAST) / u END", "(SELECT p.*, u FROM p JOIN (SELECT time, count(DISTINCT x) + max(CAST(x IS NULL AS INT)) AS u FROM p GROUP BY time) USING (time))", " "),
    "group_rankpct": _sql("CASE WHEN x IS NOT NULL THEN dense_rank() OVER (PARTITION BY time, g ORDER BY x NULLS LAST) / u END", "(SELECT p.*, u FROM p JOIN (SELECT time, g, count(DISTINCT x) + max(CAST(x IS NULL AS INT)) AS u FROM p GROUP BY time, g) USING (time, g))", " "),
    **{
        n: _sql(f"CASE WHEN len(a) >= 3 THEN (len(list_filter(a, lambda e: e < l)) + (len(list_filter(a, lambda e: e = l)) + 1) / 2.0){o} END", f"(SELECT time, asset_id, list(x) FILTER (WHERE x IS NOT NULL) OVER {WR} AS a, last_value(x IGNORE NULLS) OVER {WR} AS l FROM d)", " ")
        for n, o in {"rolling_rank": "", "rolling_percentile": " / len(a)"}.items()
    },
}


def _run(name: str, inputs: list[str], params: dict, registry) -> Callable[[SparkSession, str], DataFrame]:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        own = panels(spark, sf_dir)
        op = registry.get(name)
        aux = {k: own[params[k]] for k in op.panels} | ({op.many: [own[v] for v in params[op.many]]} if op.many else {})
        return result(op(*[own[i] for i in inputs], **{**params, **aux}))

    return query


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """rank(zscore(winsorize(x / y)))."""
    own, t = panels(spark, sf_dir), TRANSFORMERS.get
    return result(t("rank")(t("zscore")(t("winsorize")(COMPOSERS.get("div")(own["x"], own["y"]), lower=0.05, upper=0.95))))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from . import more

    out: dict[str, Callable] = {"flagship": flagship}
    out |= {f"t_{n}": _run(n, ["x"], p, TRANSFORMERS) for n, (p, _) in TRANSFORMER_CASES.items()}
    out |= {f"c_{n}": _run(n, i, p, COMPOSERS) for n, (i, p, _) in COMPOSER_CASES.items()}
    return out | more.queries()


def oracles() -> dict[str, str]:
    from . import more

    out = {f"t_{n}": SPECIAL_SQL[n] if n in SPECIAL_SQL else _sql(s) for n, (_, s) in TRANSFORMER_CASES.items() if s or n in SPECIAL_SQL}
    out |= {f"c_{n}": _sql(s) for n, (_, _, s) in COMPOSER_CASES.items() if n != "power_df"}
    ratio = "s0 AS (SELECT time, asset_id, x / nullif(y, 0) AS x FROM p), s1 AS (SELECT time, asset_id, CASE WHEN x < {a} THEN {a} WHEN x > {b} THEN {b} ELSE x END AS x FROM s0), s2 AS (SELECT time, asset_id, CASE WHEN isnan({z}) THEN NULL ELSE {z} END AS x FROM s1),".format(a=_nearest(0.05), b=_nearest(0.95), z=_Z)
    out["flagship"] = _sql(_pct("x", "time"), "s2", ratio)
    return out | more.oracles()


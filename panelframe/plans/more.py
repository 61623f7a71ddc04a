"""Further queries: domains, predictions, learning tools."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import learning
from ..operators import prediction as P
from ..operators.registry import TRANSFORMERS
from ..sources.panel import Panel


def _predicted(make: Callable[[], P.PredictionComposer], n: int = 2) -> Callable[[SparkSession, str], DataFrame]:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        from .catalog import panels

        own = panels(spark, sf_dir)
        training = None
        if make().supervised:
            target = TRANSFORMERS.get("lag")(own["x"], periods=-1)
            known = own["x"].domain.grid().withColumn("value", (F.datediff("time", F.lit("1970-01-01").cast("date")) + 719163 + 31).cast("double"))
            training = (target, Panel.from_domain(known, own["x"].domain, identity="available"))
        found = make().compose(*[own["x"], own["y"]][:n], training=training).compute()
        return found.lazy().withColumn("value", F.round("value", 6) + F.lit(0.0))

    return query


def _fama_macbeth(part: str) -> Callable[[SparkSession, str], DataFrame]:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        from .catalog import panels

        own = panels(spark, sf_dir)
        target = TRANSFORMERS.get("lag")(own["x"], periods=-1).compute().lazy()
        known = own["x"].domain.grid().withColumn("value", (F.datediff("time", F.lit("1970-01-01").cast("date")) + 719163 + 31).cast("double"))
        found = P.fama_macbeth_ols({"x": own["x"].lazy(), "y": own["y"].lazy()}, target, known, 3)[part]
        return found.select(*[(F.round(c, 4) + F.lit(0.0)).alias(c) if kind == "double" else F.col(c) for c, kind in found.dtypes])

    return query


def _domain_membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .catalog import panels

    return panels(spark, sf_dir)["x"].domain.grid()


def _elastic_net(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .catalog import base

    df = base(spark, sf_dir).where("x is not null").withColumn("y2", F.col("y") * F.col("y"))
    scaler = learning.RmsScaler.fit(df, ["y", "y2"])
    gram = learning.Gram.of(scaler.transform(df), ["y", "y2"], "x")
    model = learning.ElasticNet.fit(gram, 0.1 * learning.alpha_max(gram, 0.5), 0.5)
    return model.predict(scaler.transform(df)).select("time", "asset_id", F.round("prediction", 4).alias("value"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "p_identity": _predicted(P.Identity, 1),
        "p_equal_weight": _predicted(P.EqualWeight),
        "p_ic_weighted": _predicted(lambda: P.ICWeighted(window=3)),
        "p_ic_weighted_decay": _predicted(lambda: P.ICWeightedDecay(window=3, half_life=2.0)),
        "p_quantile_ic_weighted": _predicted(lambda: P.QuantileICWeighted(window=3, quantiles=3)),
        "p_ols": _predicted(lambda: P.OLS(window=3)),
        "p_gls": _predicted(lambda: P.GLS(window=3)),
        "fm_factor_returns": _fama_macbeth("factor_returns"),
        "fm_rolling_premia": _fama_macbeth("rolling_premia"),
        "fm_period_diagnostics": _fama_macbeth("period_diagnostics"),
        "domain_grid": _domain_membership,
        "ml_elastic_net": _elastic_net,
    }


#: The target of a month is the next month's x, known 31 days after it; e has what each month says, pos its place in the calendar.
_TRAINING = """cal AS (SELECT time, row_number() OVER (ORDER BY time) AS pos FROM (SELECT DISTINCT time FROM p)),
moved AS (SELECT c0.time, p.asset_id, p.x AS target FROM p JOIN cal c1 ON c1.time = p.time JOIN cal c0 ON c0.pos = c1.pos - 1 WHERE p.x IS NOT NULL),
j AS (SELECT p.time, p.asset_id, x, y, target FROM p JOIN moved USING (time, asset_id))"""

#: Least squares on two regressors, by centred sums.
_FITS = f"""{_TRAINING},
s AS (SELECT time, count(*) AS n, avg(x) AS mx, avg(y) AS my, avg(target) AS mt, count(*) * var_pop(x) AS sxx, count(*) * var_pop(y) AS syy, count(*) * var_pop(target) AS stt,
  count(*) * covar_pop(x, y) AS sxy, count(*) * covar_pop(x, target) AS sxt, count(*) * covar_pop(y, target) AS syt FROM j WHERE x IS NOT NULL GROUP BY time),
det AS (SELECT *, CASE WHEN n > 3 AND sxx * syy - sxy * sxy > 1e-9 THEN sxx * syy - sxy * sxy END AS det FROM s),
slopes AS (SELECT *, (sxt * syy - syt * sxy) / det AS bx, (syt * sxx - sxt * sxy) / det AS b_y FROM det),
e AS (SELECT *, mt - bx * mx - b_y * my AS b0, (stt - bx * sxt - b_y * syt) / nullif(n - 3, 0) AS sigma2 FROM slopes)"""


def _history(sums: str, having: str = "") -> str:
    """w: the last three months of e that are known at a time, if there is no gap between them."""
    return f"""known AS (SELECT t.time, e.time AS q, c.pos AS qpos, e.* EXCLUDE (time), row_number() OVER (PARTITION BY t.time ORDER BY c.pos DESC) AS k
  FROM cal t JOIN e ON e.time < t.time AND e.time + INTERVAL 31 DAY <= t.time JOIN cal c ON c.time = e.time),
w AS (SELECT time, min(q) AS window_start, max(q) AS window_end, {sums} FROM known WHERE k <= 3 GROUP BY time HAVING count(*) = 3 AND max(qpos) - min(qpos) = 2 {having})"""


_PREMIA = f"{_FITS}, " + _history("avg(b0) AS b0, avg(bx) AS bx, avg(b_y) AS b_y", "AND count(b0) = 3")


def _rank_weighted(age: str) -> str:
    from .catalog import BASE_SQL, _avg_rank

    def ic(name: str, alpha: str) -> str:
        ranks = f"SELECT time, {_avg_rank(alpha, 'time')} AS r, {_avg_rank('target', 'time')} AS rt FROM j WHERE {alpha} IS NOT NULL"
        return f"{name} AS (SELECT time, CASE WHEN var_pop(r) > 0 AND var_pop(rt) > 0 THEN corr(r, rt) END AS m FROM ({ranks}) GROUP BY time)"

    e = "e AS (SELECT time, icx.m AS mx, icy.m AS my FROM (SELECT DISTINCT time FROM j) LEFT JOIN icx USING (time) LEFT JOIN icy USING (time))"
    mean = ", ".join(f"CASE WHEN count({m}) = 3 THEN greatest(sum({m} * {age}) / sum({age}), 0) ELSE 0 END AS w{m[1]}" for m in ("mx", "my"))
    total = "(CASE WHEN x IS NOT NULL THEN wx ELSE 0 END + wy)"
    return f"""WITH {BASE_SQL}, {_TRAINING}, {ic('icx', 'x')}, {ic('icy', 'y')}, {e}, {_history(mean)}
SELECT time, asset_id, round((coalesce(x, 0) * wx + y * wy) / {total}, 6) + 0.0 AS value FROM p JOIN w USING (time) WHERE {total} > 0"""


def _terms(source: str, columns: str, of: dict[str, str]) -> str:
    return " UNION ALL ".join(f"SELECT time, {columns}, '{factor}' AS factor, {value} FROM {source}" for factor, value in of.items())


def oracles() -> dict[str, str]:
    from .catalog import BASE_SQL

    return {
        "p_identity": f"WITH {BASE_SQL} SELECT time, asset_id, round(x, 6) + 0.0 AS value FROM p WHERE x IS NOT NULL",
        "p_equal_weight": f"WITH {BASE_SQL} SELECT time, asset_id, round((coalesce(x, 0) + y) / (1.0 + CAST(x IS NOT NULL AS INT)), 6) + 0.0 AS value FROM p",
        "p_ols": f"WITH {BASE_SQL}, {_PREMIA} SELECT time, asset_id, round(b0 + bx * x + b_y * y, 6) + 0.0 AS value FROM p JOIN w USING (time) WHERE x IS NOT NULL",
        "p_ic_weighted": _rank_weighted("1.0"),
        "p_ic_weighted_decay": _rank_weighted("pow(2.0, (1 - k) / 2.0)"),
        "fm_factor_returns": f"WITH {BASE_SQL}, {_FITS}, fit AS (SELECT * FROM e WHERE b0 IS NOT NULL) "
        + _terms("fit", "CAST(time + INTERVAL 31 DAY AS DATE) AS available_at", {
            factor: f"round({b}, 4) + 0.0 AS coefficient, round(sqrt(greatest(sigma2 * ({v}), 0)), 4) + 0.0 AS cross_sectional_standard_error"
            for factor, b, v in (("intercept", "b0", "1.0 / n + (mx * mx * syy - 2 * mx * my * sxy + my * my * sxx) / det"), ("x", "bx", "syy / det"), ("y", "b_y", "sxx / det"))
        }),
        "fm_rolling_premia": f"WITH {BASE_SQL}, {_PREMIA} "
        + _terms("w", "window_start, window_end", {f: f"round({b}, 4) + 0.0 AS mean_coefficient" for f, b in (("intercept", "b0"), ("x", "bx"), ("y", "b_y"))}),
        "domain_grid": f"WITH {BASE_SQL} SELECT time, asset_id FROM grid",
    }

"""Supervised prediction composers: alphas, targets and availability dates to causal predictions.

Per-date statistics are computed in Spark, one small row for each period; what a period may learn from
is decided in one task over these rows (as many as the calendar has dates), and weights go back by a broadcast join.
No job runs while a graph is lowered.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.graph import Graph, GraphValidationError, Node, as_node
from ..sources.panel import KEYS
from .registry import PREDICTIONS


def finite(c: str):
    return F.when(~F.isnan(c) & (F.abs(F.col(c)) != float("inf")), F.col(c))


def wide(alphas: list[DataFrame]) -> DataFrame:
    """Union of keys with a column a0, a1, ... for each alpha; non-finite is null."""
    frames = [f.select(*KEYS, F.col("value").alias(f"a{i}")) for i, f in enumerate(alphas)]
    out = reduce(lambda x, y: x.join(y, list(KEYS), "full"), frames)
    return out.withColumns({f"a{i}": finite(f"a{i}") for i in range(len(alphas))})


def spearman(x: np.ndarray, y: np.ndarray) -> float:
    """Pearson correlation of average ranks; nan for fewer than two pairs or a flat side."""
    ok = np.isfinite(x) & np.isfinite(y)
    x, y = x[ok], y[ok]
    if len(x) < 2 or len(np.unique(x)) < 2 or len(np.unique(y)) < 2:
        return math.nan
    return float(np.corrcoef(pd.Series(x).rank().to_numpy(), pd.Series(y).rank().to_numpy())[0, 1])


def quantile_rank_information_coefficient(values, targets, quantiles: int) -> float | None:
    """Rank correlation of the quantile order (best first) with the quantiles' mean targets."""
    values, targets = np.asarray(values, float), np.asarray(targets, float)
    keep = np.isfinite(values)
    values, targets = values[keep], targets[keep]
    order = np.argsort(-values, kind="stable")
    bucket = np.arange(len(order)) * quantiles // max(len(order), 1)
    means = []
    for q in range(quantiles):
        own = targets[order[bucket == q]]
        own = own[np.isfinite(own)]
        if not len(own):
            return None
        means.append(own.mean())
    if len(set(means)) == 1:
        return None
    out = spearman(np.arange(quantiles, 0, -1.0), np.array(means))
    return None if math.isnan(out) else out


def period_records(joined: DataFrame, measure: Callable[[pd.DataFrame], dict], fields: str) -> DataFrame:
    """A row for each date: what measure says of its rows, whether it may be learned from (it has a target with a date from which it is known), and that date,
    which must be one for all of its rows."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("asset_id")
        trained = bool((pdf["target"].notna() & pdf["available"].notna()).any())
        known = pdf["available"].dropna().unique()
        if trained and (len(known) != 1 or not math.isfinite(known[0])):
            raise ValueError(f"{pdf['time'].iloc[0]}: a training period must have one finite availability date")
        said = {k: [v] for k, v in measure(pdf).items()}
        return pd.DataFrame({"time": [pdf["time"].iloc[0]], "trained": [trained], "available": [math.floor(known[0]) if trained else None], **said})

    return joined.groupBy("time").applyInPandas(one, f"time date, trained boolean, available double, {fields}")


def over_history(records: DataFrame, window: int, combine: Callable[[list[dict]], list[float] | None]) -> DataFrame:
    """w: what combine makes of the last `window` periods known at a date; dates without them, or with a gap between them, have no row.

    One task gets a row for each date of the calendar; no job runs before the result is asked for."""

    def every(pdf: pd.DataFrame) -> pd.DataFrame:
        rows, out = pdf.sort_values("time").to_dict("records"), []
        for at, r in enumerate(rows):
            today = r["time"].toordinal()
            known = (i for i in range(at - 1, -1, -1) if rows[i]["trained"] and rows[i]["available"] <= today)
            last = sorted(itertools.islice(known, window))
            if len(last) == window and last[-1] - last[0] == window - 1:
                w = combine([rows[i] for i in last])
                if w is not None:
                    out.append((r["time"], rows[last[0]]["time"], rows[last[-1]]["time"], [float(x) for x in w]))
        return pd.DataFrame(out, columns=["time", "window_start", "window_end", "w"])

    return records.groupBy().applyInPandas(every, "time date, window_start date, window_end date, w array<double>")


class PredictionComposer:
    kind = ""
    supervised = True

    def __init__(self, **parameters):
        self._parameters = parameters
        self.n_alphas = 0
        for k in ("window", "quantiles"):
            if k in parameters and (not isinstance(parameters[k], int) or parameters[k] < (2 if k == "quantiles" else 1)):
                raise ValueError(f"{k} is too small")
        if parameters.get("half_life", 1) <= 0:
            raise ValueError("half_life must be positive")

    def __init_subclass__(cls) -> None:
        if cls.kind:
            PREDICTIONS[cls.kind] = cls

    def parameters(self) -> dict:
        return dict(self._parameters)

    def compose(self, *alphas, training=None, name: str | None = None, metadata: dict | None = None) -> Graph:
        self._check(len(alphas))
        if self.supervised != (training is not None):
            raise GraphValidationError(f"{self.kind} {'needs' if self.supervised else 'takes no'} training panels")
        made = type(self)(**self._parameters)
        made.n_alphas = len(alphas)
        return Graph(Node("prediction_composer", tuple(as_node(x) for x in (*alphas, *(training or ()))), made, {}, name, metadata))

    def _check(self, n: int) -> None:
        if n < 2:
            raise GraphValidationError(f"{self.kind} needs two alphas or more")

    def predict(self, frames: list[DataFrame]) -> DataFrame:
        alphas = wide(frames[: self.n_alphas])
        out = self._predict(alphas, *[f.select(*KEYS, F.col("value").alias(n)) for f, n in zip(frames[self.n_alphas :], ("target", "available"), strict=False)])
        return out.where("value is not null and not isnan(value)").select(*KEYS, "value")

    def _joined(self, alphas: DataFrame, targets: DataFrame, available: DataFrame) -> DataFrame:
        return alphas.join(targets.withColumn("target", finite("target")), list(KEYS), "left").join(available, list(KEYS), "left")


class Identity(PredictionComposer):
    kind, supervised = "identity", False

    def _check(self, n: int) -> None:
        if n != 1:
            raise GraphValidationError("identity takes one alpha")

    def _predict(self, alphas: DataFrame) -> DataFrame:
        return alphas.withColumnRenamed("a0", "value")


def _weighted(alphas: DataFrame, weights: list) -> DataFrame:
    """Mean of the present alphas by weights, renormalized for each asset."""
    names = [f"a{i}" for i in range(len(weights))]
    total = sum((F.when(F.col(a).isNotNull(), w).otherwise(0.0) for a, w in zip(names, weights, strict=True)), F.lit(0.0))
    top = sum((F.coalesce(F.col(a) * w, F.lit(0.0)) for a, w in zip(names, weights, strict=True)), F.lit(0.0))
    return alphas.withColumn("value", F.when(total > 0, top / F.when(total > 0, total)))


class EqualWeight(PredictionComposer):
    kind, supervised = "equal_weight", False

    def _predict(self, alphas: DataFrame) -> DataFrame:
        return _weighted(alphas, [F.lit(1.0)] * self.n_alphas)


class ICWeighted(PredictionComposer):
    kind = "ic_weighted"

    def _metric(self):
        return spearman

    def _age_weight(self, age: int) -> float:
        return 1.0

    def _predict(self, alphas, targets, available) -> DataFrame:
        n, metric, age_weight = self.n_alphas, self._metric(), self._age_weight

        def measure(pdf: pd.DataFrame) -> dict:
            found = [metric(pdf[f"a{i}"].to_numpy(float), pdf["target"].to_numpy(float)) for i in range(n)]
            return {"m": [math.nan if v is None else v for v in found]}

        def combine(history: list[dict]) -> list[float] | None:
            age = np.array([age_weight(len(history) - 1 - i) for i in range(len(history))])
            m = np.array([np.asarray(h["m"], float) for h in history])
            w = [max(float(age @ m[:, i] / age.sum()), 0.0) if np.isfinite(m[:, i]).all() else 0.0 for i in range(n)]
            return w if sum(w) > 0 else None

        records = period_records(self._joined(alphas, targets, available), measure, "m array<double>")
        table = over_history(records, self._parameters["window"], combine)
        return _weighted(alphas.join(F.broadcast(table), "time"), [F.col("w")[i] for i in range(n)])


class ICWeightedDecay(ICWeighted):
    kind = "ic_weighted_decay"

    def _age_weight(self, age: int) -> float:
        return 2.0 ** (-age / self._parameters["half_life"])


class QuantileICWeighted(ICWeighted):
    kind = "quantile_ic_weighted"

    def _metric(self):
        q = self._parameters["quantiles"]
        return lambda x, y: quantile_rank_information_coefficient(x, y, q)


#: Columns of a period's regression on n alphas; beta has the intercept first, cov its covariance by rows.
REGRESSION = "status string, n long, rank long, condition_number double, r_squared double, residual_standard_error double, beta array<double>, cov array<double>"


def regression_records(joined: DataFrame, n: int) -> DataFrame:
    """The least squares of each date over its assets with finite alphas and target."""

    def measure(pdf: pd.DataFrame) -> dict:
        both = pdf[[*(f"a{i}" for i in range(n)), "target"]].to_numpy(float)
        both = both[np.isfinite(both).all(axis=1)]
        rows, y = len(both), both[:, -1]
        a = np.hstack((np.ones((rows, 1)), both[:, :-1]))
        out = dict.fromkeys(("rank", "condition_number", "r_squared", "residual_standard_error", "beta", "cov")) | {"n": rows, "status": "insufficient_observations"}
        if rows:
            spread = float(np.linalg.cond(a))
            out |= {"rank": int(np.linalg.matrix_rank(a)), "condition_number": spread if math.isfinite(spread) else None}
        if rows <= n + 1:
            return out
        if out["rank"] <= n:
            return out | {"status": "rank_deficient"}
        try:
            inverse = np.linalg.inv(a.T @ a)
        except np.linalg.LinAlgError:
            return out | {"status": "singular"}
        b = inverse @ (a.T @ y)
        left, whole = float(((y - a @ b) ** 2).sum()), float(((y - y.mean()) ** 2).sum())
        cov = inverse * (left / (rows - n - 1))
        out |= {"r_squared": 1.0 - left / whole if whole > 0 else None, "residual_standard_error": math.sqrt(left / (rows - n - 1))}
        fine = np.isfinite(b).all() and np.isfinite(cov).all()
        return out | ({"status": "complete", "beta": b.tolist(), "cov": cov.ravel().tolist()} if fine else {"status": "non_finite"})

    return period_records(joined, measure, REGRESSION)


def _mean_beta(history: list[dict], k: int) -> np.ndarray:
    return np.mean([h["beta"] for h in history], axis=0)


def _precision_beta(history: list[dict], k: int) -> np.ndarray | None:
    try:
        inverses = [np.linalg.inv(np.asarray(h["cov"], float).reshape(k, k)) for h in history]
        out = np.linalg.solve(sum(inverses), sum(i @ np.asarray(h["beta"], float) for i, h in zip(inverses, history, strict=True)))
    except np.linalg.LinAlgError:
        return None
    return out if np.isfinite(out).all() else None


def rolling_premia(records: DataFrame, window: int, combine, k: int) -> DataFrame:
    """w: the coefficients that combine makes of a window of periods; none if one of these has no complete regression."""
    return over_history(records, window, lambda history: combine(history, k) if all(h["status"] == "complete" for h in history) else None)


class OLS(PredictionComposer):
    """Fama-MacBeth: the mean of the periods' coefficients over the window."""

    kind = "ols"
    _combine = staticmethod(_mean_beta)

    def _predict(self, alphas, targets, available) -> DataFrame:
        n = self.n_alphas
        premia = rolling_premia(regression_records(self._joined(alphas, targets, available), n), self._parameters["window"], self._combine, n + 1)
        return alphas.join(F.broadcast(premia), "time").withColumn("value", sum((F.col(f"a{i}") * F.col("w")[i + 1] for i in range(n)), F.col("w")[0]))


class GLS(OLS):
    """Coefficients weighed by the inverse of their covariance."""

    kind = "gls"
    _combine = staticmethod(_precision_beta)


def fama_macbeth_ols(alphas: dict[str, DataFrame], targets: DataFrame, available: DataFrame, window: int) -> dict[str, DataFrame]:
    """prediction, factor_returns, rolling_premia and period_diagnostics as lazy DataFrames; available holds day numbers (1 is 0001-01-01)."""
    made, names = OLS(window=window), ["intercept", *alphas]
    made._check(len(alphas))
    if any(not isinstance(a, str) or not a.strip() or a == "intercept" for a in alphas):
        raise ValueError("alphas need names, and `intercept` is taken")
    made.n_alphas, k = len(alphas), len(names)
    frames = [*alphas.values(), targets, available]
    joined = made._joined(wide(frames[:-2]), targets.select(*KEYS, F.col("value").alias("target")), available.select(*KEYS, F.col("value").alias("available")))
    since = F.date_add(F.lit("0001-01-01").cast("date"), F.col("available").cast("int") - 1).alias("available_at")
    records = regression_records(joined, len(alphas)).where("trained")
    factor = F.array(*[F.lit(x) for x in names])[F.col("i")].alias("factor")
    error = F.sqrt(F.greatest(F.col("cov")[F.col("i") * (k + 1)], F.lit(0.0))).alias("cross_sectional_standard_error")
    returns = records.where("beta is not null").select("time", since, "cov", F.posexplode("beta").alias("i", "coefficient"))
    premia = rolling_premia(regression_records(joined, len(alphas)), window, _mean_beta, k).select("time", "window_start", "window_end", F.posexplode("w").alias("i", "mean_coefficient"))
    measured = ["rank", "condition_number", "r_squared", "residual_standard_error"]
    return {
        "prediction": made.predict(frames),
        "factor_returns": returns.select("time", "available_at", factor, "coefficient", error),
        "rolling_premia": premia.select("time", "window_start", "window_end", factor, "mean_coefficient"),
        "period_diagnostics": records.select("time", since, "status", F.col("n").alias("observation_count"), F.lit(len(alphas)).cast("long").alias("feature_count"), *measured),
    }

import datetime as dt
import json
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.errors import PythonException

import panelframe as pf
from panelframe.operators.prediction import spearman

T = pf.TRANSFORMERS.get


def months(n):
    return [dt.date(2000 + i // 12, i % 12 + 1, 1) for i in range(n)]


@pytest.fixture(scope="module")
def market(spark):
    """Two alphas, a target and its date for 9 assets on 8 months; the fourth month's alphas are alike, so its regression fails."""
    rng, rows = np.random.default_rng(3), []
    for i, t in enumerate(months(8)):
        for a in range(9):
            x, y = rng.normal(size=2)
            target = 0.5 * x - 0.2 * i * y + 0.1 * rng.normal()
            rows.append((t, f"s{a}", float(x), float(x if i == 3 else y), float(target) if i < 7 else None, float(t.toordinal() + 31)))
    pdf = pd.DataFrame(rows, columns=["time", "asset_id", "x", "y", "target", "available"])
    df = spark.createDataFrame(pdf, "time date, asset_id string, x double, y double, target double, available double")
    df = df.replace(float("nan"), None, subset=["target"])
    domain = pf.Domain(spark, df.select("time"), df.select("asset_id"), identity="market")
    return pdf, {c: pf.Panel.from_domain(df.select("time", "asset_id", df[c].alias("value")), domain, identity=c) for c in ("x", "y", "target", "available")}


def fits(pdf):
    out = {}
    for t, g in pdf.groupby("time"):
        a = np.column_stack((np.ones(len(g)), g.x, g.y))
        if g.target.notna().all() and np.linalg.matrix_rank(a) == 3:
            beta, left, *_ = np.linalg.lstsq(a, g.target.to_numpy(), rcond=None)
            out[t] = beta, np.linalg.inv(a.T @ a) * left[0] / (len(g) - 3)
    return out


def expected(pdf, window, weigh):
    """weigh: the periods of a window to a function of a row, or None."""
    times, out = sorted(pdf.time.unique()), {}
    for i, t in enumerate(times):
        known = [p for p in times[:i] if p.toordinal() + 31 <= t.toordinal() and pdf[pdf.time == p].target.notna().any()][-window:]
        if len(known) == window and times.index(known[-1]) - times.index(known[0]) == window - 1 and (f := weigh(known)):
            out |= {(t, r.asset_id): f(r) for r in pdf[pdf.time == t].itertuples()}
    return out


def predicted(made, panels):
    found = made.compose(panels["x"], panels["y"], training=(panels["target"], panels["available"])).compute().lazy().collect()
    return {(r["time"], r["asset_id"]): r["value"] for r in found}


@pytest.mark.parametrize("kind", ["ols", "gls"])
def test_regressions_over_periods_equal_plain_ones(market, kind):
    pdf, panels = market
    own = fits(pdf)

    def weigh(known):
        if any(p not in own for p in known):
            return None
        if kind == "ols":
            b = np.mean([own[p][0] for p in known], axis=0)
        else:
            inverse = [np.linalg.inv(own[p][1]) for p in known]
            b = np.linalg.inv(sum(inverse)) @ sum(i @ own[p][0] for i, p in zip(inverse, known))
        return lambda r: b @ (1.0, r.x, r.y)

    want = expected(pdf, 2, weigh)
    assert want and predicted({"ols": pf.OLS, "gls": pf.GLS}[kind](window=2), panels) == pytest.approx(want)


@pytest.mark.parametrize("made, age", [(pf.ICWeighted(window=2), 1.0), (pf.ICWeightedDecay(window=2, half_life=1), 0.5)])
def test_rank_weights_equal_plain_ones(market, made, age):
    pdf, panels = market

    def weigh(known):
        m = np.array([[spearman(g[c].to_numpy(), g.target.to_numpy()) for c in "xy"] for g in (pdf[pdf.time == p] for p in known)])
        w = np.maximum(np.average(m, axis=0, weights=[age, 1.0]), 0)
        return (lambda r: w @ (r.x, r.y) / w.sum()) if w.sum() > 0 else None

    want = expected(pdf, 2, weigh)
    assert want and predicted(made, panels) == pytest.approx(want)


def test_fama_macbeth_tells_each_period(market):
    pdf, panels = market
    found = pf.fama_macbeth_ols({"x": panels["x"].lazy(), "y": panels["y"].lazy()}, panels["target"].lazy(), panels["available"].lazy(), 2)
    own = fits(pdf)
    periods = {r["time"]: r for r in found["period_diagnostics"].collect()}
    assert {t: r["status"] for t, r in periods.items()} == {t: "complete" if t in own else "rank_deficient" for t in months(7)}
    assert periods[months(4)[3]]["rank"] == 2 and all(r["observation_count"] == 9 and r["feature_count"] == 2 for r in periods.values())
    assert all(r["available_at"] == t + dt.timedelta(31) for t, r in periods.items())
    for r in found["factor_returns"].collect():
        i = ["intercept", "x", "y"].index(r["factor"])
        beta, cov = own[r["time"]]
        assert (r["coefficient"], r["cross_sectional_standard_error"]) == pytest.approx((beta[i], math.sqrt(cov[i, i])))
    premia = found["rolling_premia"].collect()
    assert premia and all(r["mean_coefficient"] == pytest.approx(np.mean([own[p][0][["intercept", "x", "y"].index(r["factor"])] for p in (r["window_start"], r["window_end"])])) for r in premia)
    with pytest.raises(ValueError):
        pf.fama_macbeth_ols({"intercept": panels["x"].lazy(), "y": panels["y"].lazy()}, panels["target"].lazy(), panels["available"].lazy(), 2)


def test_a_period_with_two_dates_is_rejected(market):
    _, panels = market
    frame = panels["available"].lazy().selectExpr("time", "asset_id", "value + if(asset_id = 's1', 1, 0) AS value")
    two = pf.Panel.from_domain(frame, panels["x"].domain, identity="two")
    with pytest.raises(PythonException, match="one finite availability date"):
        predicted(pf.OLS(window=2), panels | {"available": two})


def test_folds():
    config = pf.WalkForwardConfig(6, 4, 3, embargo_months=2)
    folds = pf.expanding_walk_forward(reversed(months(17)), config)
    assert [(f.index, len(f.sample_periods), len(f.training_periods), len(f.oos_periods)) for f in folds] == [(0, 6, 4, 3), (1, 9, 7, 3)]
    assert folds[1].validation_periods == tuple(months(13)[9:]) and folds[1].embargoed_periods == tuple(months(9)[7:])
    more = pf.expanding_walk_forward(months(17), config, include_incomplete_oos=True)
    assert more[:2] == folds and [len(f.oos_periods) for f in more] == [3, 3, 1]
    assert config.effective_minimum_valid_validation_months == 3 and config.enough(3) and not config.enough(2)
    assert pf.WalkForwardConfig.from_dict(config.to_dict()).to_dict() == config.to_dict()
    for wrong in ({"embargo_months": 72}, {"oos_months": 0}, {"validation_months": 8, "minimum_valid_validation_months": 5}, {"oos_months": True}):
        with pytest.raises(ValueError):
            pf.WalkForwardConfig(**wrong)


def test_scaler_and_elastic_net(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(60, 3)) * (3.0, 0.2, 1.0)
    y = 1.5 + x @ (0.4, -3.0, 0.0) + 0.05 * rng.normal(size=60)
    df = spark.createDataFrame([(*map(float, r), 0.0, float(t)) for r, t in zip(x, y)], "a double, b double, c double, zero double, y double")
    scaler = pf.RmsScaler.fit(df, ["a", "zero", "b", "c"])
    assert scaler.dropped_columns == {"zero": "zero_rms"} and scaler.active_feature_names == ("a", "b", "c")
    assert scaler.scales["b"] == pytest.approx(math.sqrt((x[:, 1] ** 2).mean()))
    assert pf.RmsScaler.from_dict(json.loads(json.dumps(scaler.to_dict()))) == scaler
    assert scaler.transform(df).columns == ["a", "b", "c", "y"] and scaler.restore({"a": 1.0, "b": 1.0, "c": 0.0})["zero"] == 0.0
    gram = pf.Gram.of(scaler.transform(df), scaler.active_feature_names, "y")
    z = x / list(scaler.scales.values())
    most = pf.alpha_max(gram, 0.5)
    assert most == pytest.approx(np.abs(z.T @ (y - y.mean())).max() / 60 / 0.5)
    assert not any(pf.ElasticNet.fit(gram, most * 1.0001, 0.5, tolerance=1e-12).coefficients)
    model = pf.ElasticNet.fit(gram, 0.1 * most, 0.5, tolerance=1e-12)
    b, left = np.array(model.coefficients), y - model.intercept - z @ model.coefficients
    slope = z.T @ left / 60 - 0.1 * most * 0.5 * b  # conditions of the optimum
    assert model.converged and left.mean() == pytest.approx(0, abs=1e-9)
    assert all(abs(s - math.copysign(0.05 * most, c)) < 1e-8 if c else abs(s) <= 0.05 * most for s, c in zip(slope, b))
    assert gram.error(model) == pytest.approx((left**2).mean())
    assert pf.ElasticNet.from_dict(json.loads(json.dumps(model.to_dict()))) == model
    with pytest.raises(ValueError):
        pf.ElasticNet.from_dict(model.to_dict() | {"iterations": 0})


def test_search_settings(spark):
    target = {"uuid": "u", "revision": 1, "revision_hash": "h", "definition": {}}
    coverage = {"minimum_all_market_observations": 1, "minimum_applicable_coverage": 0.5, "required_marker_unknown_policy": "drop"}
    config = pf.ElasticNetConfig(alpha_ratios=(1.0, 0.01), l1_ratio_values=(0.5,))
    made = pf.ElasticNetPredictionComposer(pf.WalkForwardConfig(), coverage, target, config, {"objective": "mse"})
    assert pf.ElasticNetPredictionComposer.from_dict(json.loads(json.dumps(made.to_dict()))).to_dict() == made.to_dict()
    df = spark.createDataFrame([(float(i), 2.0 * i + 1) for i in range(10)], "a double, y double")
    gram = pf.Gram.of(df, ["a"], "y")
    first, second = made.candidates(gram)
    assert first.alpha == pytest.approx(100 * second.alpha) and first.selection_key < second.selection_key
    assert made.best(gram, gram)[0] == second
    assert pf.candidates(pf.ElasticNetConfig("absolute_alpha_values", alpha_values=(0.1,), l1_ratio_values=(0.2, 1.0)), gram) == (pf.ElasticNetCandidate(0.1, 0.2), pf.ElasticNetCandidate(0.1, 1.0))
    for wrong in ({"alpha_values": (1.0,)}, {"l1_ratio_values": (1.5,)}, {"search_mode": "absolute_alpha_values"}, {"max_iter": 0}):
        with pytest.raises(ValueError):
            pf.ElasticNetConfig(**wrong)
    with pytest.raises(ValueError):
        pf.ElasticNetPredictionComposer(pf.WalkForwardConfig(), {}, target, config, {"objective": "mse"})


def test_aligned_frames_and_changes(spark):
    a = spark.createDataFrame([("2024-01-01", "p", 2.0), ("2024-01-02", "p", 3.0)], "time string, asset_id string, value double")
    b = spark.createDataFrame([("2024-01-02", "p", 7.0), ("2024-01-03", "q", 8.0)], "time string, asset_id string, value double")
    rows = lambda frames: [sorted((r["time"][-1], r["asset_id"], r["value"]) for r in f.collect()) for f in frames]
    assert rows(pf.align_frames(a, b)) == [[("2", "p", 3.0)], [("2", "p", 7.0)]]
    outer = [sorted((r["time"][-1], r["asset_id"], r["value"]) for r in f.fillna(-1.0).collect()) for f in pf.align_frames(a, b, join="outer")]
    assert outer == [[("1", "p", 2.0), ("2", "p", 3.0), ("3", "q", -1.0)], [("1", "p", -1.0), ("2", "p", 7.0), ("3", "q", 8.0)]]
    assert [r["value"] for r in pf.pct_change_frame(a).orderBy("time").collect()] == [None, 0.5]
    with pytest.raises(ValueError):
        pf.pct_change_frame(a, periods=0)
    with pytest.raises(ValueError):
        pf.align_frames(a, b, join="left")


def test_custom_transformer_with_further_panels(spark, market):
    _, panels = market

    @pf.custom_transformer("plus_all_of_them", panels=("base",), many="others")
    def plus(df, *, base, others, scale=1.0):
        for i, o in enumerate([base, *others]):
            df = df.join(o.withColumnRenamed("value", f"o{i}"), ["time", "asset_id"])
        return df.selectExpr("time", "asset_id", f"(value + {' + '.join(f'o{i}' for i in range(1 + len(others)))}) * {scale} AS value")

    x, y = panels["x"], panels["y"]
    graph = T("plus_all_of_them")(x, base=y, others=[x, y], scale=2.0)
    want = {(r["time"], r["asset_id"]): r["value"] for r in x.lazy().collect()}
    got = {(r["time"], r["asset_id"]): r["value"] for r in graph.compute().lazy().collect()}
    other = {(r["time"], r["asset_id"]): r["value"] for r in y.lazy().collect()}
    assert got == pytest.approx({k: 4 * (v + other[k]) for k, v in want.items()})
    spec = pf.GraphSpec.from_dict(graph.spec().to_dict())
    again = pf.Graph.compile(spec).compute({n.name: n.payload for n in graph.nodes if n.kind == "panel"})
    assert {(r["time"], r["asset_id"]): r["value"] for r in again.lazy().collect()} == pytest.approx(got)
    with pytest.raises(pf.GraphValidationError):
        T("plus_all_of_them")(x, base=y)
    for wrong in ({"outputs": [], "nodes": []}, {"outputs": ["a"], "nodes": [{"name": "a", "node_type": "panel", "inputs": "b"}]}):
        with pytest.raises(pf.GraphValidationError):
            pf.GraphSpec.from_dict(wrong)

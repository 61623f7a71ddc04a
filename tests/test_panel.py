import datetime as dt
import math
import random

import numpy as np
import pytest

from panelframe.functions import kernels
from panelframe.operators import builtin  # noqa: F401
from panelframe.operators.prediction import quantile_rank_information_coefficient
from panelframe.operators.registry import COMPOSERS, TRANSFORMERS
from panelframe.plans.graph import Graph, GraphSpec, GraphValidationError
from panelframe.sources.panel import CategoryPanel, Domain, Panel, PanelError, PredictionPanel

T, C = TRANSFORMERS.get, COMPOSERS.get


def frame(spark, values):
    """values: asset -> values by day."""
    rows = [(f"2024-01-{i + 1:02d}", a, v) for a, vs in values.items() for i, v in enumerate(vs)]
    return spark.createDataFrame(rows, "time string, asset_id string, value double")


def panel(spark, values, domain=None, kind=Panel):
    f = frame(spark, values)
    return kind.from_domain(f, domain or Domain(spark, f.select("time"), f.select("asset_id"), identity="test"))


def values(graph):
    out = {}
    for r in graph.compute().collect().collect():
        out.setdefault(r["asset_id"], []).append(r["value"])
    return out


def table(rng, n_assets, n_days, choices):
    return {f"s{i}": [rng.choice(choices) for _ in range(n_days)] for i in range(n_assets)}


def test_division_by_zero_is_missing(spark):
    tops, bottoms = table(random.Random(1), 6, 5, [-7.5, 0.0, 4.0, None]), table(random.Random(2), 6, 5, [0.0, -0.0, 0.5, -2.0])
    want = {k: [None if x is None or y == 0 else x / y for x, y in zip(tops[k], bottoms[k])] for k in tops}
    assert values(C("div")(panel(spark, tops), panel(spark, bottoms))) == want


def test_ranks_equal_counting(spark):
    """Average and dense ranks against their definitions; a null counts as one more distinct value of the dense rank."""
    given = table(random.Random(3), 9, 7, [5.0, 5.5, 6.0, 9.0, None])
    days = [[vs[i] for vs in given.values()] for i in range(7)]

    def average(v, day):
        own = [x for x in day if x is not None]
        return None if v is None else (sum(x < v for x in own) + (sum(x == v for x in own) + 1) / 2) / len(own)

    def dense(v, day):
        return None if v is None else (len({x for x in day if x is not None and x < v}) + 1) / len(set(day))

    for name, f in (("rank", average), ("rankpct", dense)):
        got = values(T(name)(panel(spark, given)))
        for k, vs in given.items():
            assert got[k] == [x if x is None else pytest.approx(x) for x in (f(v, day) for v, day in zip(vs, days))]


def test_quantile_clipping_equals_sorting(spark):
    given = table(random.Random(4), 11, 6, [-3.0, 1.0, 2.0, 8.0, 13.0, None])
    for low, high in ((0.1, 0.8), (0.0, 1.0), (0.5, 0.5)):
        got = values(T("winsorize")(panel(spark, given), lower=low, upper=high))
        for i in range(6):
            own = sorted(v[i] for v in given.values() if v[i] is not None)
            a, b = (own[math.floor(q * (len(own) - 1) + 0.5)] for q in (low, high))
            assert [got[k][i] for k in given] == [None if v[i] is None else min(max(v[i], a), b) for v in given.values()]


def test_filling_and_age_equal_loops(spark):
    given = table(random.Random(5), 5, 12, [2.5, 6.0, None, None, math.nan])
    missing = lambda x: x is None or math.isnan(x)
    filled, young = values(T("ffill")(panel(spark, given), limit=2)), values(T("date_age_constraint")(panel(spark, given), window=4, min_valid=2))
    for k, vs in given.items():
        for i, v in enumerate(vs):
            near = [x for x in reversed(vs[max(0, i - 2) : i + 1]) if not missing(x)]
            assert filled[k][i] == (near[0] if near else None)
            old = sum(not missing(x) for x in vs[max(0, i - 3) : i + 1]) < 2
            assert young[k][i] == (None if old or missing(v) else v)


def test_siblings_keep_their_own_auxiliary_panels(spark):
    x, y = panel(spark, {"a": [-4.0, 6.0], "b": [9.0, -1.0]}), panel(spark, {"a": [2.0, 3.0], "b": [0.5, 4.0]})
    size = T("abs")(x)
    first, second = T("vol_scale")(size, volatility=size), T("vol_scale")(size, volatility=x)
    assert values(C("sub")(first, second)) == {"a": [2.0, 0.0], "b": [0.0, 2.0]}
    assert values(C("add")(T("vol_scale")(x, volatility=size), T("vol_scale")(x, volatility=T("negate")(x)))) == {"a": [-2.0, 0.0], "b": [0.0, -2.0]}
    masked = C("add")(T("fillna")(T("mask")(x, mask_frame=C("greater")(x, y))), T("fillna")(T("mask")(y, mask_frame=C("less")(x, y))))
    assert values(masked) == {"a": [2.0, 6.0], "b": [9.0, 4.0]}


def test_siblings_keep_their_own_groups(spark):
    x = panel(spark, {"a": [1.0], "b": [5.0], "c": [6.0], "d": [8.0]})
    labels = lambda of: CategoryPanel.from_domain(spark.createDataFrame([("2024-01-01", k, v) for k, v in zip("abcd", of)], "time string, asset_id string, value string"), x.domain)
    g, h = labels("uuvv"), labels("uvuv")
    got = values(C("sub")(T("group_mean")(x, group=g), T("group_mean")(x, group=h)))
    assert got == {"a": [3.0 - 3.5], "b": [3.0 - 6.5], "c": [7.0 - 3.5], "d": [7.0 - 6.5]}


def test_columns_of_one_frame_need_no_join(spark):
    data = spark.createDataFrame([("2024-01-01", "a", 1.0, 2.0), ("2024-01-02", "a", None, 5.0), ("2024-01-01", "b", 3.0, None)], "time string, asset_id string, p double, q double")
    own = Panel.columns_of(data, Domain.of(data), {"p": Panel, "q": Panel})
    total = C("add")(own["p"], T("negate")(own["q"]))
    assert "Join" not in total.compute().frame._jdf.queryExecution().optimizedPlan().toString()
    assert values(total) == {"a": [-1.0, None], "b": [None, None]}


def test_correlation_of_flat_and_exact_windows(spark):
    p = panel(spark, {"a": [1.0, 1.0, 1.0, 2.0, 3.0, None, 5.0]})
    q = panel(spark, {"a": [4.0, 7.0, 4.0, 2.0, 0.0, 1.0, -4.0]})
    got = values(C("rolling_corr")(p, q, window=3, min_periods=2))["a"]
    assert got[:3] == [None, None, None] and got[4:] == pytest.approx([np.corrcoef([1, 2, 3], [4, 2, 0])[0, 1], -1, -1])


def test_lag_follows_the_calendar(spark):
    domain = Domain(spark, ["2024-01-01", "2024-01-02", "2024-01-03", "2024-01-04"], ["a"], identity="four")
    p = panel(spark, {"a": [5.0]}, domain)
    assert values(T("lag")(p, periods=1)) == {"a": [None, 5.0, None, None]}


def test_ewm_mean(spark):
    p = panel(spark, {"a": [1.0, 2.0, 3.0]})
    assert values(T("ewm_mean")(p, alpha=0.5))["a"] == pytest.approx([1, 5 / 3, 17 / 7])
    assert values(T("ewm_mean")(p, alpha=0.5, adjust=False))["a"] == pytest.approx([1, 1.5, 2.25])
    assert values(T("ewm_var")(p, alpha=0.5))["a"][0] == 0.0


def test_rolling_ols_predicts_a_line(spark):
    y, x = panel(spark, {"a": [3.0, 5.0, 7.0, 9.0]}), panel(spark, {"a": [1.0, 2.0, 3.0, 4.0]})
    assert values(T("rolling_ols")(y, factors=[x], window=3))["a"] == [None, None, None, pytest.approx(9.0)]


def test_rolling_rank_equals_counting():
    rng = np.random.default_rng(4)
    v = rng.integers(0, 6, 60).astype(float)
    v[rng.random(60) < 0.3] = np.nan
    for share in (False, True):
        got = kernels.rolling_rank(v, 7, 3, share)
        for t in range(60):
            own = v[max(0, t - 6) : t + 1]
            own = own[~np.isnan(own)]
            want = np.nan if len(own) < 3 else (own < own[-1]).sum() + ((own == own[-1]).sum() + 1) / 2
            assert got[t] == pytest.approx(want / len(own) if share and len(own) else want, nan_ok=True)


def test_ewm_equals_weights():
    rng = np.random.default_rng(6)
    v = rng.normal(size=30)
    v[[0, 5, 6, 17]] = np.nan
    for bias in (None, True, False):
        got = kernels.ewm(v, 0.3, True, False, 0, bias)
        for t in range(30):
            w = np.where(np.isnan(v[: t + 1]), 0, 0.7 ** np.arange(t, -1, -1.0))
            x = np.nan_to_num(v[: t + 1])
            mean = (w * x).sum() / w.sum() if w.any() else np.nan
            want = mean if bias is None else (w * (x - mean) ** 2).sum() / w.sum() if w.any() else np.nan
            if bias is False and (w > 0).sum() > 1:
                want *= w.sum() ** 2 / (w.sum() ** 2 - (w**2).sum())
            assert got[t] == pytest.approx(np.nan if np.isnan(v[t]) else want, nan_ok=True, abs=1e-12)


def test_rolling_fits_equal_single_fits():
    """Windows with holes, a flat and a repeated factor against one plain solution each."""
    rng = np.random.default_rng(8)
    x = rng.normal(size=(50, 2))
    x[20:35, 1] = x[20:35, 0]
    x[36:48, 0] = 3.0
    y = x @ [0.5, 2.0] + rng.normal(size=50)
    y[[3, 4, 25]], x[10, 1] = np.nan, np.nan
    ridge = lambda a, b: np.linalg.solve(a.T @ a + np.diag([0, 2.0, 2.0]), a.T @ b)
    for got, plain in ((kernels.FITS["ols"](), lambda a, b: np.linalg.lstsq(a, b, rcond=None)[0]), (kernels.FITS["ridge"](2.0), ridge), (kernels.FITS["elastic_net"](2.0, 0.0, 20000, 1e-13), ridge)):
        out = kernels.rolling_fit(y, x, 9, got)
        for t in range(50):
            ok = [i for i in range(max(0, t - 9), t) if np.isfinite(y[i]) and np.isfinite(x[i]).all()]
            a = np.column_stack((np.ones(len(ok)), x[ok]))
            want = np.nan if t < 9 or not np.isfinite(x[t]).all() else np.append(1, x[t]) @ plain(a, y[ok])
            assert out[t] == pytest.approx(want, nan_ok=True, abs=1e-6)


def test_regressions_equal_plain_solutions():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(40, 2))
    y = x @ [1.0, -2.0] + 0.5
    assert kernels.rolling_fit(y, x, 10, kernels.FITS["ols"]())[10:] == pytest.approx(y[10:])
    assert kernels.rolling_fit(y, x, 10, kernels.FITS["elastic_net"](0.0, 0.5, 5000, 1e-12))[10:] == pytest.approx(y[10:], abs=1e-6)


def test_no_join_for_values_of_one_source(spark):
    p = panel(spark, {"a": [1.0, 2.0], "b": [3.0, 5.0]})
    plan = C("add")(T("abs")(p), T("rank")(p)).compute().frame._jdf.queryExecution().optimizedPlan().toString()
    own = p.frame._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == own.count("Join")


def test_constant_needs_no_join(spark):
    p = panel(spark, {"a": [1.0, 2.0]})
    assert values(C("mul")(p, T("constant")(p, value=3))) == {"a": [3.0, 6.0]}


def test_spec_round_trip(spark):
    p = panel(spark, {"a": [1.0, 2.0], "b": [3.0, 5.0]})
    g = T("zscore")(C("sub")(p, T("lag")(p, name="lagged"), name="change"), name="z")
    spec = GraphSpec.from_dict(g.spec().to_dict())
    again = Graph.compile(spec).compute({g.nodes[0].name: p})
    assert [r.asDict() for r in again.collect().collect()] == [r.asDict() for r in g.compute().collect().collect()]


def test_rejections(spark):
    p = panel(spark, {"a": [1.0]})
    with pytest.raises(GraphValidationError):
        C("add")(p)
    with pytest.raises(GraphValidationError):
        T("rolling_mean")(p, width=3)
    with pytest.raises(GraphValidationError):
        C("add")(panel(spark, {"a": [1.0]}, kind=PredictionPanel), p)
    twice = spark.createDataFrame([("2024-01-01", "a", 1.0)] * 2, "time string, asset_id string, value double")
    with pytest.raises(PanelError):
        Panel.from_domain(twice, Domain.of(twice), validate=True)


def test_dynamic_domain(spark):
    m = spark.createDataFrame([("2024-01-01", "a", True), ("2024-01-02", "a", False), ("2024-01-02", "b", True)], "time string, asset_id string, active boolean")
    domain = Domain(spark, m.select("time"), membership=m)
    p = panel(spark, {"a": [1.0, 2.0], "b": [3.0, 4.0]}, domain)
    assert [(r["time"], r["asset_id"], r["value"]) for r in p.collect().collect()] == [(dt.date(2024, 1, 1), "a", 1.0), (dt.date(2024, 1, 2), "b", 4.0)]


def test_quantile_information_coefficient():
    assert quantile_rank_information_coefficient([1, 2, 3, 4], [1, 2, 3, 4], 2) == pytest.approx(1)
    assert quantile_rank_information_coefficient([1, 2, 3, 4], [4, 3, 2, 1], 2) == pytest.approx(-1)
    assert quantile_rank_information_coefficient([1, 2], [1, 1], 2) is None


def test_entry_works():
    import __spark_entry__

    assert len(__spark_entry__.queries()) >= 130
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_power_query_returns_all_values(spark):
    from panelframe.plans import catalog

    sf_dir = "/root/testdata/sf0.001"
    x = {(r["time"], r["asset_id"]): r["x"] for r in catalog.base(spark, sf_dir).collect()}
    got = {(r["time"], r["asset_id"]): r["value"] for r in catalog.queries()["c_power_df"](spark, sf_dir).collect()}

    def power(v):
        try:
            return v**v if v else 1.0
        except OverflowError:
            return math.inf if v > 0 or v % 2 == 0 else -math.inf

    assert set(x) <= set(got) and any(v is not None and v >= 1e6 for v in got.values())
    for key, value in got.items():
        v = x.get(key)
        assert value is None if v is None else value == pytest.approx(power(v), rel=1e-9, abs=1e-6)


def sql_values(name, x, y):
    """The SQL of a query over a panel p(time, asset_id, x, y) with these values instead of lineitem's."""
    import duckdb

    from panelframe.plans import catalog

    rows = [(f"2024-01-{i + 1:02d}", a, x[a][i], y[a][i]) for a in x for i in range(len(x[a]))]
    con = duckdb.connect()
    con.execute("CREATE TABLE given (time VARCHAR, asset_id VARCHAR, x DOUBLE, y DOUBLE)")
    con.executemany("INSERT INTO given VALUES (?, ?, ?, ?)", rows)
    sql = catalog.oracles()[name]
    start, end = sql.index("p AS ("), sql.index("grid AS (")
    out = {}
    for _, a, v in con.execute(f"SELECT * FROM ({sql[:start]}p AS (SELECT *, '0' AS g FROM given), {sql[end:]}) ORDER BY time").fetchall():
        out.setdefault(a, []).append(v)
    return out


def rounded_values(graph):
    from panelframe.plans import catalog

    out = {}
    for r in catalog.result(graph).orderBy("time").collect():
        out.setdefault(r["asset_id"], []).append(r["value"])
    return out


def test_pct_change_rounds_ties_as_its_sql(spark):
    """Quotients that end in a five at the seventh digit, and infinities."""
    x = {f"s{q}_{k}": [float(q), float(k)] for q in (640, 1280, 3200, 16000) for k in range(-20000, 20000, 97)} | {"up": [0.0, 3.0], "down": [0.0, -3.0], "none": [0.0, 0.0]}
    x |= {f"t{k}": [16000.0, float(k)] for k in range(-19779, -18000, 250)}
    got, want = rounded_values(T("pct_change")(panel(spark, x))), sql_values("t_pct_change", x, x)
    assert got == want and got["up"][1] == math.inf and got["down"][1] == -math.inf and got["none"][1] is None


def test_kelly_takes_the_variance_in_its_sqls_order(spark):
    """Windows whose quotient ends in a five at the seventh digit, windows without variance, and holes."""
    windows = [(14, 30, 14), (66, 82, 66), (-14, -30, -14), (30, 14, 14), (72, 40, 40), (34, 18, 18), (40, 72, 40), (38, 22, 22), (74, 58, 106), (98, 82, 82), (-34, -18, -18), (162, 178, 162), (142, 126, 126), (94, 14, 94), (98, 18, 98)]
    windows += [(a, b, b) for a in range(-200, 200, 2) for b in (a + 16, a - 16, a + 32, a - 80)] + [(5, 5, 5), (-5, -5, -5), (0, 0, 0), (None, 4, 8)]
    x = {f"s{i}": [None if v is None else float(v) for v in w] for i, w in enumerate(windows)}
    got, want = rounded_values(T("kelly")(panel(spark, x), window=3)), sql_values("t_kelly", x, x)
    assert got == want and [got[f"s{len(windows) - i}"][2] for i in (4, 3, 2, 1)] == [math.inf, -math.inf, None, None]


def test_vol_scale_rounds_ties_as_its_sql(spark):
    """Quotients that end in a five at the seventh digit, zero volatilities and holes."""
    tops = [float(k) for k in range(-20000, 20000, 97)]
    x = {f"s{q}": tops for q in (640, 1280, 3200, 16000)} | {"zero": [3.0, -3.0, 0.0, None], "hole": [3.0, None]}
    y = {k: [float(k[1:])] * len(v) for k, v in x.items() if k[1:].isdigit()} | {"zero": [0.0] * 4, "hole": [None, 5.0]}
    # one asset for each value
    x, y = ({f"{k}_{i}": [v] for k, vs in of.items() for i, v in enumerate(vs)} for of in (x, y))
    domain = panel(spark, x).domain
    got = rounded_values(T("vol_scale")(panel(spark, x, domain), volatility=panel(spark, y, domain)))
    assert got == sql_values("t_vol_scale", x, y)
    assert [got[f"zero_{i}"][0] for i in range(4)] == [math.inf, -math.inf, None, None] and got["hole_0"] == got["hole_1"] == [None]

import datetime as dt
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from basketlab.operators import covariance, forward, portfolio, prices, risk
from basketlab.params import Params
from basketlab.sources import rates

P = Params()
DAY0 = dt.date(2024, 1, 1)


def frame(spark, n, seed=5, portfolios=("a",)):
    rng = np.random.default_rng(seed)
    rows = []
    for name in portfolios:
        for i in range(n):
            b = rng.normal(0.0004, 0.01)
            rows.append((name, DAY0 + dt.timedelta(days=i), float(0.8 * b + rng.normal(0, 0.006)), float(b), 0.03 + 0.00001 * i))
    cols = "portfolio STRING, date DATE, ret DOUBLE, bench DOUBLE, rf_annual DOUBLE"
    return spark.createDataFrame(rows, cols), pd.DataFrame(rows, columns=["portfolio", "date", "ret", "bench", "rf"])


def hac_t(y, x):
    n = len(y)
    X = np.column_stack([np.ones(n), x])
    coef = np.linalg.lstsq(X, y, rcond=None)[0]
    u = X * (y - X @ coef)[:, None]
    lags = int(math.floor(4 * (n / 100) ** (2 / 9)))
    s = u.T @ u
    for k in range(1, lags + 1):
        g = u[k:].T @ u[:-k]
        s += (1 - k / (lags + 1)) * (g + g.T)
    inv = np.linalg.inv(X.T @ X)
    return coef[0] * 252, coef[0] / math.sqrt((inv @ s @ inv)[0, 0])


def test_alpha_and_gate(spark):
    df, pdf = frame(spark, 200)
    r = risk.alpha_newey_west(df, ["portfolio"], P).first()
    rf = pdf.rf / 252
    alpha, t = hac_t((pdf.ret - rf).to_numpy(), (pdf.bench - rf).to_numpy())
    assert r.alphaAnnual == pytest.approx(alpha, rel=1e-9) and r.alphaTStat == pytest.approx(t, rel=1e-9)
    short, _ = frame(spark, 59)
    r = risk.alpha_newey_west(short, ["portfolio"], P).first()
    assert r.alphaAnnual is None and r.alphaTStat is None


def test_summary_against_pandas(spark):
    df, pdf = frame(spark, 300)
    r = risk.metrics_summary(df, ["portfolio"], P).first()
    curve = (1 + pdf.ret).cumprod()
    dd = curve / curve.cummax() - 1
    assert r.annualReturn == pytest.approx(curve.iloc[-1] ** (252 / 300) - 1)
    assert r.maximumDrawdown == pytest.approx(dd.min())
    run = best = 0
    for u in dd < 0:
        run = run + 1 if u else 0
        best = max(best, run)
    assert r.maxDrawdownDuration == best
    var = np.percentile(pdf.ret, 5)
    assert r.valueAtRisk95 == pytest.approx(-var)
    assert r.conditionalVar95 == pytest.approx(-pdf.ret[pdf.ret <= var].mean())
    assert r.beta == pytest.approx(np.cov(pdf.ret, pdf.bench)[0, 1] / pdf.bench.var())


def test_no_drawdown_and_flat_series(spark):
    rows = [("a", DAY0 + dt.timedelta(days=i), 0.01, 0.01, 0.0) for i in range(5)]
    df = spark.createDataFrame(rows, "portfolio STRING, date DATE, ret DOUBLE, bench DOUBLE, rf_annual DOUBLE")
    r = risk.metrics_summary(df, ["portfolio"], P).first()
    assert r.maxDrawdownDuration is None and r.calmarRatio == 0.0 and r.sortinoRatio == 0.0
    assert r.informationRatio is None


def test_rates_asof_and_left_edge(spark):
    rf = spark.createDataFrame(
        [(dt.date(2024, 1, 3), 0.02), (dt.date(2024, 1, 8), 0.03)], "date DATE, rf_annual DOUBLE"
    )
    dates = spark.createDataFrame([(dt.date(2024, 1, i),) for i in (2, 3, 5, 8, 20)], "date DATE")
    got = {r.date.day: r.rf_annual for r in rates.asof(dates, rf, 0.04).collect()}
    assert got == {2: 0.04, 3: 0.02, 5: 0.02, 8: 0.03, 20: 0.03}


def test_constant_rate_equals_flat_series_and_leaves_active_measures(spark):
    df, _ = frame(spark, 260)
    rf = spark.createDataFrame([(dt.date(1990, 1, 1), 0.04)], "date DATE, rf_annual DOUBLE")
    flat = rates.attach(df.drop("rf_annual"), rf, 0.01)
    const = df.withColumn("rf_annual", F.lit(0.04))
    a = risk.metrics_summary(flat, ["portfolio"], P).first().asDict()
    b = risk.metrics_summary(const, ["portfolio"], P).first().asDict()
    c = risk.metrics_summary(df, ["portfolio"], P).first().asDict()
    assert a == pytest.approx(b)
    for k in ("trackingError", "informationRatio", "maximumDrawdown", "annualReturn", "beta"):
        assert a[k] == pytest.approx(c[k])
    assert a["sharpeRatio"] != pytest.approx(c["sharpeRatio"])


def test_windows_need_ninety_percent(spark):
    p = Params(trading_days=20)
    for n, want in ((53, []), (54, [3]), (89, [3]), (90, [3, 5])):
        df, _ = frame(spark, n)
        assert sorted(r.years for r in risk.window_metrics(df, p).collect()) == want


def marks(spark, n, arms=("greedy", "qubo_classical"), late=0):
    rng = np.random.default_rng(2)
    rows = []
    for k, arm in enumerate(arms):
        for i in range(n):
            if k and i < late:
                continue
            rows.append((DAY0 + dt.timedelta(days=i), arm, float(rng.normal(0.0005, 0.01))))
    return spark.createDataFrame(rows, "date DATE, arm STRING, ret DOUBLE")


@pytest.mark.parametrize("n", [9, 10, 19, 20, 59, 60])
def test_gates(spark, n):
    m = marks(spark, n)
    rf = m.select("date").distinct().withColumn("rf", F.lit(0.0001))
    r = forward.forward_stats(forward.compared(m, rf, P), Params(n_boot=50)).first()
    assert r.nDays == n and r.activeReturnCumulative is not None and r.maxDrawdown_arm is not None
    assert (r.trackingError is None) == (n < 20) and (r.probSharpe_arm is None) == (n < 20)
    assert (r.calmar_arm is None) == (n < 60)
    assert (r.ci_low is None) == (n < 10)


def test_late_arm_cuts_alignment_but_not_nav(spark):
    m = marks(spark, 30, ("greedy", "qubo_classical", "qubo_quantum"), late=6)
    aligned = forward.aligned_marks(m)
    assert aligned.select("date").distinct().count() == 24
    nav = forward.forward_nav(m)
    assert nav.where("arm = 'greedy'").count() == 30
    assert nav.where("arm = 'qubo_quantum'").count() == 24


def test_prob_sharpe_formula(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(0.001, 0.01, 80)
    df = spark.createDataFrame([(float(v),) for v in x], "x DOUBLE")
    got = df.agg(*forward.moments("x", "m")).select(forward.prob_sharpe("m").alias("p")).first().p
    sr = x.mean() / x.std(ddof=1)
    z = (x - x.mean()) / x.std()
    g3, g4 = (z**3).mean(), (z**4).mean()
    arg = sr * math.sqrt(79) / math.sqrt(1 - g3 * sr + (g4 - 1) / 4 * sr * sr)
    assert got == pytest.approx(0.5 * (1 + math.erf(arg / math.sqrt(2))), abs=2e-7)


def panel(spark, t=130, n=7):
    rng = np.random.default_rng(7)
    m = rng.normal(0, 0.01, t)
    x = m[:, None] + rng.normal(0, 0.01, (t, n))
    rows = [(f"s{j}", DAY0 + dt.timedelta(days=i), float(x[i, j])) for i in range(t) for j in range(n)]
    df = spark.createDataFrame(rows, "security STRING, date DATE, ret DOUBLE")
    pool = spark.createDataFrame([(j + 1, f"s{j}") for j in range(n)], "pos INT, security STRING")
    return x, df, pool


def matrix(rows, n):
    c = np.zeros((n, n))
    for r in rows:
        c[r.i - 1, r.j - 1] = c[r.j - 1, r.i - 1] = r.c
    return c


def test_covariances_against_numpy(spark):
    x, df, pool = panel(spark)
    t, n = x.shape
    got = {m: matrix(covariance.covariance(df, pool, P, m).collect(), n) for m in ("sample", "ewma", "ledoit")}
    assert np.allclose(got["sample"], np.cov(x, rowvar=False))
    w = 0.5 ** (np.arange(t - 1, -1, -1) / 63.0)
    w /= w.sum()
    xc = x - w @ x
    assert np.allclose(got["ewma"], (xc * w[:, None]).T @ xc)
    xc = x - x.mean(axis=0)
    s = xc.T @ xc / t
    mu = np.trace(s) / n
    d2 = ((s - mu * np.eye(n)) ** 2).sum() / n
    b2 = min(d2, sum(((np.outer(r, r) - s) ** 2).sum() for r in xc) / n / t**2)
    assert np.allclose(got["ledoit"], (1 - b2 / d2) * s + b2 / d2 * mu * np.eye(n))
    assert np.linalg.eigvalsh(got["ledoit"]).min() > 0


@pytest.mark.parametrize("method", ["ewma", "ledoit"])
def test_quadratic_form_needs_no_pairs(spark, method):
    x, df, pool = panel(spark)
    p = Params(cov_method=method)
    c = matrix(covariance.covariance(df, pool, p).collect(), x.shape[1])
    w = np.arange(1, x.shape[1] + 1) / 28.0
    weights = spark.createDataFrame([("k", f"s{j}", float(v)) for j, v in enumerate(w)], "key STRING, security STRING, weight DOUBLE")
    got = covariance.quadratic_form(weights, covariance.risk_factors(df, pool, p), "key").first().wCw
    assert got == pytest.approx(w @ c @ w, rel=1e-9)


def test_too_few_rows_give_no_covariance(spark):
    _, df, pool = panel(spark, t=59)
    assert covariance.covariance(df, pool, P).count() == 0


def test_returns_and_grid_around_gaps(spark):
    rows = [("a", 1, 10.0), ("a", 2, 11.0), ("a", 4, 12.0), ("b", 2, 5.0), ("b", 3, 0.0), ("b", 4, 6.0)]
    bars = spark.createDataFrame(
        [(s, dt.date(2024, 1, d), c, 1.0) for s, d, c in rows], "security STRING, date DATE, close DOUBLE, volume DOUBLE"
    )
    got = {(r.security, r.date.day): round(r.ret, 6) for r in prices.daily_returns(bars).collect()}
    assert got == {("a", 2): 0.1, ("b", 3): -1.0}
    clipped = {(r.security, r.date.day): r.ret for r in prices.clean_returns(bars).collect()}
    assert clipped[("b", 3)] == -0.5
    grid = {(r.security, r.date.day): r.close for r in prices.calendar_grid(bars).collect()}
    assert len(grid) == 8 and grid[("b", 1)] is None and grid[("a", 3)] is None
    filled = {(r.security, r.date.day): r.filled for r in prices.forward_fill(prices.calendar_grid(bars)).collect()}
    assert filled[("a", 3)] == 11.0 and filled[("b", 1)] is None
    p = Params(return_windows=(("r1", 1), ("r3", 3), ("r9", 9)))
    t = {r.security: r for r in prices.trailing_returns(bars, p).collect()}
    assert t["a"].r1 == pytest.approx(12 / 11 - 1) and t["a"].r3 == pytest.approx(0.2) and t["a"].r9 is None
    assert t["b"].r1 is None and t["b"].r3 is None


def test_nav_starts_at_one_and_downsamples(spark):
    df, _ = frame(spark, 101)
    nav = portfolio.nav_series(df)
    first = nav.orderBy("date").first()
    assert first.fund == 1.0 and first.benchmark == 1.0
    thin = portfolio.downsample(nav, 10).orderBy("date").collect()
    assert len(thin) == 11 and thin[-1].date == DAY0 + dt.timedelta(days=100)

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from basketlab.functions.ranking import FULL, SHIFTS, average_rank_pct, exact_median, order_bits, value_ranks
from basketlab.operators import portfolio, scoring
from basketlab.params import Params


def values(seed=7, n=600):
    rng = np.random.default_rng(seed)
    v = np.where(rng.random(n) < 0.35, 1.5, rng.normal(0, 10, n) * 10.0 ** rng.integers(-6, 6, n))
    v[:5] = [0.0, -0.0, 1e300, -1e300, 5e-324]
    return pd.DataFrame({"g": rng.choice(list("abc"), n, p=[0.8, 0.15, 0.05]), "v": v})


def test_ranks_match_pandas_with_a_hot_value(spark):
    pdf = values()
    pdf["want"] = pdf.groupby("g").v.rank(pct=True) * 100
    df = spark.createDataFrame(pdf)
    got = df.join(value_ranks(df, ["g"], "v"), ["g", "v"]).withColumn("p", average_rank_pct()).toPandas()
    assert len(got) == len(pdf)
    assert np.allclose(got.p, got.want)


def test_order_bits_are_the_bits_of_the_double(spark):
    rng = np.random.default_rng(1)
    edges = 2.0 ** np.arange(-1074, 1024)
    v = np.concatenate([edges, np.nextafter(edges, 0), np.nextafter(edges, np.inf), rng.normal(0, 9, 500), [0.0, 5e-324, 1.7976931348623157e308, np.inf]])
    v = np.concatenate([v, -v])
    bits = np.abs(v).view(np.int64) * np.where(v < 0, -1, 1)
    rows = spark.createDataFrame([(float(x),) for x in v], "v DOUBLE").select("v", order_bits("v").alias("b")).collect()
    assert [r.b for r in rows] == bits.tolist()


def narrow(n=100_000):
    """Many values inside 1/256 of an octave, half of them in a far narrower range."""
    steps = np.arange(n, dtype=np.int64)
    bits = np.float64(1.5).view(np.int64) + np.where(steps % 2, steps, steps << 24)
    return pd.DataFrame({"g": "a", "v": np.concatenate([bits.view(np.float64), np.repeat(bits[:50].view(np.float64), 40)])})


def test_a_narrow_factor_is_split_until_no_bucket_is_too_full(spark):
    pdf = narrow()
    assert np.ptp(np.log2(pdf.v)) < 1 / 256
    df = spark.createDataFrame(pdf)
    want = pdf.v.rank(method="min") - 1
    got = df.distinct().join(value_ranks(df, ["g"], "v"), ["g", "v"]).toPandas().set_index("v").sort_index()
    assert (got.n == len(pdf)).all()
    assert got.below.tolist() == sorted(set(want.astype(int)))
    assert len(df.select(F.shiftright(order_bits("v"), SHIFTS[0])).distinct().collect()) <= 2
    sizes = df.distinct().groupBy(F.shiftright(order_bits("v"), SHIFTS[2])).count().agg(F.max("count")).first()[0]
    assert sizes <= FULL


@pytest.mark.parametrize("full", [0, 3])
def test_ranks_are_the_same_however_deep_the_split(spark, full):
    pdf = values(n=900)
    df = spark.createDataFrame(pdf)
    rows = lambda f: sorted(tuple(r) for r in value_ranks(df, ["g"], "v", f).collect())
    assert rows(full) == rows(FULL)


def test_median_matches_pandas(spark):
    pdf = values(n=601)
    got = exact_median(spark.createDataFrame(pdf), ["g"], "v", "m").toPandas().set_index("g").m
    want = pdf.groupby("g").v.median()
    assert np.allclose(got.sort_index(), want.sort_index())


def universe(n=120, seed=3):
    rng = np.random.default_rng(seed)
    factors = [f for m in scoring.FACTORS.values() for f in m]
    pdf = pd.DataFrame({f: rng.normal(0.1, 1, n).round(2) for f in factors})
    for f in factors:
        pdf.loc[rng.random(n) < 0.15, f] = np.nan
    pdf.loc[0, factors] = np.nan
    pdf["security"] = [f"s{i:03d}" for i in range(n)]
    pdf["sector"] = rng.choice(["A", "B", "Unknown", "thin"], n, p=[0.45, 0.35, 0.14, 0.06])
    return pdf, factors


def expected_scores(pdf, p):
    df = pdf.set_index("security").copy()
    df["peRatio"] = df.peRatio.where(df.peRatio > 0)
    out = {}
    for pillar, members in scoring.FACTORS.items():
        cols = {}
        for f, direction in members.items():
            flip = (lambda s: 100 - s) if direction == "lower" else (lambda s: s)
            uni = flip(df[f].rank(pct=True) * 100)
            if pillar in scoring.SECTOR_NEUTRAL:
                within = flip(df[f].groupby(df.sector).rank(pct=True) * 100)
                n = df[f].notna().groupby(df.sector).transform("sum")
                uni = within.where((n >= p.sector_min_count) & (df.sector != "Unknown"), uni)
            cols[f] = uni
        pct = pd.DataFrame(cols)
        out[pillar] = 50 + (pct.mean(axis=1).fillna(50) - 50) * pct.notna().sum(axis=1) / len(members)
    return pd.DataFrame(out)


def test_scores_match_pandas_with_fallbacks(spark):
    pdf, factors = universe()
    p = Params()
    df = spark.createDataFrame(pdf.where(pdf.notna(), None), "".join(f"{f} DOUBLE, " for f in factors) + "security STRING, sector STRING")
    got = scoring.score_universe(df, p).toPandas().set_index("security").sort_index()
    want = expected_scores(pdf, p).sort_index()
    assert len(got) == len(pdf)
    for pillar in scoring.FACTORS:
        assert np.allclose(got[f"{pillar}Score"].astype(float), want[pillar], atol=0.00501)
    assert (got.loc["s000", ["healthScore", "valuationScore", "momentumScore", "score"]] == 50).all()
    assert got.score.between(0, 100).all()
    thin = pdf.set_index("security").sector.isin(["thin", "Unknown"])
    assert not got[[c for c in got if c.endswith("_sectorRanked")]][thin.sort_index()].any().any()


def loop_weights(scores, cap):
    """The defining procedure: cap, hand the excess to the rest, repeat."""
    raw = np.maximum(scores, 0)
    w = raw / (raw.sum() or 1.0)
    for _ in range(200):
        over = w > cap + 1e-12
        if not over.any():
            break
        extra = (w[over] - cap).sum()
        w[over] = cap
        under = w < cap - 1e-12
        if not under.any() or w[under].sum() == 0:
            break
        w[under] += extra * w[under] / w[under].sum()
    return w / (w.sum() or 1.0)


@pytest.mark.parametrize("cap", [0.04, 0.2, 1.0])
def test_capped_weights_match_the_loop(spark, cap):
    rng = np.random.default_rng(11)
    rows, want = [], {}
    for k, n in enumerate((1, 4, 10, 26, 40, 200)):
        s = rng.lognormal(0, 1.5, n) - 0.2
        if k == 2:
            s[:] = -1.0
        for i, (x, w) in enumerate(zip(s, loop_weights(s, cap))):
            rows.append((f"p{k}", f"s{i:03d}", float(x)))
            want[(f"p{k}", f"s{i:03d}")] = w
    df = spark.createDataFrame(rows, "portfolio STRING, security STRING, score DOUBLE")
    got = portfolio.capped_weights(df, cap).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.weight == pytest.approx(want[(r.portfolio, r.security)], abs=1e-7)


def test_group_limit_comes_before_the_shuffle(spark):
    df = spark.range(1000).select(
        (F.col("id") % 3).alias("portfolio"), F.col("id").cast("string").alias("security"),
        F.abs(F.hash("id").cast("double")).alias("_s"),
    )
    plan = portfolio.cap_levels(df, 0.04)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


@pytest.mark.parametrize("weigh", [
    lambda df: portfolio.capped_weights(df.withColumnRenamed("x", "score"), 0.04),
    lambda df: portfolio.held_weights(df.withColumnRenamed("x", "weight"), df.select("security")),
])
@pytest.mark.parametrize("broadcast,node", [("10MB", "BroadcastHashJoin"), ("-1", "SortMergeJoin(skew=true)")])
def test_a_hot_portfolio_is_no_single_task(spark, weigh, broadcast, node):
    """Totals of few portfolios are broadcast by their measured size; beyond that the
    join splits the hot one."""
    rows = spark.range(0, 120_000, numPartitions=12).select(
        F.when(F.col("id") % 3 > 0, F.lit(0)).otherwise(F.col("id") % 40).alias("portfolio"),
        F.col("id").cast("string").alias("security"),
        F.pmod(F.hash("id"), F.lit(1000)).cast("double").alias("x"),
    )
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": broadcast,
        "spark.sql.adaptive.autoBroadcastJoinThreshold": broadcast,
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "64k",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "64k",
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
    }
    before = {k: spark.conf.get(k, None) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        df = weigh(rows)
        df.collect()
        plan = df._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    final = plan.split("== Initial Plan ==")[0]
    assert node in final, final[:3000]

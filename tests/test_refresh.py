"""Arms from the objective, published versions, and the daily refresh."""

import pytest
from conftest import SF
from pyspark.sql import functions as F

from basketlab.operators import baskets
from basketlab.params import WEEKLY_BARS as P
from basketlab.plans import catalog, daily
from basketlab.plans.documents import SNAPSHOT
from basketlab.plans.screen import Screen
from basketlab.sources import snapshot


def test_each_arm_takes_the_least_energy_of_its_own_candidates(spark):
    rows = [(b, 3, q, 0.0, -9.0, 0.0) for b, q in [("top", 1.0), ("sector", 4.0), ("mix1", 2.0), ("mix10", 4.0), ("mix11", 1.0), ("mix20", 3.0)]]
    parts = spark.createDataFrame(rows, "basket string, size int, quality double, risk double, size_term double, same_sector double")
    found = {r.arm: r for r in baskets.arm_winners(parts, P).collect()}
    # equal energies go to the smaller name
    assert found["qubo_classical"].basket == "mix10" and found["qubo_classical"].numReads == 4
    assert found["qubo_quantum"].basket == "mix20" and found["qubo_quantum"].numReads == 2
    assert found["qubo_quantum"].bestEnergy == pytest.approx(-P.l1 * 3.0 - P.l3 * 9.0)


def test_choice_and_its_fallbacks(spark):
    schema = "scheme string, names long, covered long, maxWeight double, namesAtCap long, effectiveN double, wCw double, objective double, feasible boolean"
    rows = []
    for arm, covered, names, ok in [("a", 30, 30, True), ("b", 29, 30, False), ("c", 5, 5, False), ("d", 30, 30, False)]:
        for scheme, objective in [("score_capped", 1.0), ("equal", 0.5), ("inverse_vol", 0.7)]:
            rows.append((f"{arm}|{scheme}", names, covered, 0.04, 2, 25.0, objective / 10, objective, ok and scheme != "equal"))
    found = {r.arm: r for r in baskets.choose_by_arm(spark.createDataFrame(rows, schema), P).collect()}
    assert (found["a"].scheme, found["a"].weighting, found["a"].weightingNote) == ("inverse_vol", "objective", None)
    assert found["a"].wSigmaW == pytest.approx(0.07) and found["a"].wSigmaWScore == pytest.approx(0.1)
    notes = {"b": baskets.NOT_COVERED, "c": baskets.CAP_INFEASIBLE, "d": baskets.NONE_FEASIBLE}
    for arm, note in notes.items():
        assert (found[arm].scheme, found[arm].weighting, found[arm].weightingNote, found[arm].wSigmaW) == ("score_capped", "score_fallback", note, None)


def test_readers_get_the_newest_version_that_succeeded(spark, tmp_path):
    root = str(tmp_path / "published")
    schema = "success boolean, date string, portfolio struct<asOf:string>"

    def document(success, date, portfolio=("x",)):
        return spark.createDataFrame([(success, date, portfolio)], schema)

    def current():
        return [r.date for r in snapshot.read_current(spark, root, schema).collect()]

    snapshot.publish(document(False, "0"), root, 0)
    assert current() == []
    snapshot.publish(document(True, "1"), root, 1)
    snapshot.publish(document(True, "2"), root, 2)
    snapshot.publish(document(False, "3"), root, 3)
    snapshot.publish(document(True, "4", None), root, 4)
    assert current() == ["2"]
    snapshot.publish(document(True, "2 again"), root, 2)
    assert current() == ["2 again"]
    # a version that is being written has no committed file yet
    half = tmp_path / "published" / "version=5" / "_temporary" / "0"
    half.mkdir(parents=True)
    (half / "part-0.json").write_text('{"success": true, "date": "5", "portfolio"')
    assert current() == ["2 again"]


@pytest.fixture(scope="module")
def versions(spark, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("versions") / "published")
    s = Screen(spark, SF)
    old = Screen(spark, SF, behind=catalog.STALE_DAYS)
    snapshot.publish(catalog._document(old, old.stocks), root, 1)
    before = snapshot.read_current(spark, root, SNAPSHOT)
    log = catalog.forward_log.record(s.marks, "weekly", 1)
    after, new_log = daily.refresh(before, log, s, 2)
    return s, before.first().asDict(True), after.first().asDict(True), log, new_log


def test_refresh_freezes_ranks_selections_and_weights(versions):
    s, before, after, _, _ = versions
    frozen = ("rank", "ticker", "name", "sector", "score", "healthScore", "peRatio", "fundWeight", "reasons", "flags")
    pick = lambda d: [[x[f] for f in frozen] for x in d["portfolio"]["stocks"]]
    assert pick(before) == pick(after) and pick(after)
    for a, b in zip(before["portfolio"]["research"]["arms"], after["portfolio"]["research"]["arms"]):
        assert a == b
    assert after["run_type"] == "daily" and before["run_type"] == "weekly"
    assert after["portfolio"]["asOf"] == before["portfolio"]["asOf"]
    fund = after["portfolio"]["fund"]
    assert fund["benchmark"] == before["portfolio"]["fund"]["benchmark"]
    assert fund["navSeries"][-1]["date"] == str(s.bars.agg(F.max("date")).first()[0]) > before["portfolio"]["fund"]["navSeries"][-1]["date"]


def test_refresh_takes_new_prices(versions):
    s, before, after, _, _ = versions
    last = {r.security: r.close for r in s.bars.groupBy("security").agg(F.max_by("close", "date").alias("close")).collect()}
    for x in after["portfolio"]["stocks"]:
        assert x["price"] == pytest.approx(last[x["ticker"]])
    assert [x["price"] for x in after["portfolio"]["stocks"]] != [x["price"] for x in before["portfolio"]["stocks"]]


def test_refresh_logs_one_record_of_the_last_price_date(versions):
    s, before, after, log, new_log = versions
    day = str(s.bars.agg(F.max("date")).first()[0])
    added = new_log.join(log.select("date"), "date", "left_anti").collect()
    assert [(r.date, r.runType, r.rebalance) for r in added] == [(day, "daily", None)]
    returns = {r.security: r.ret for r in catalog.prices.daily_returns(s.bars).where(F.col("date") == day).collect()}
    for arm in after["portfolio"]["research"]["arms"]:
        w = arm["weights"]
        expected = sum(v * (returns.get(k) or 0.0) for k, v in w.items()) / sum(w.values())
        assert added[0].armReturns[arm["key"]] == pytest.approx(expected, abs=1e-6)
    assert len(after["portfolio"]["research"]["forwardNav"]) == len(before["portfolio"]["research"]["forwardNav"]) + 1

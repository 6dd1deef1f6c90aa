"""Backtests over spans and strategy tables against a plain loop."""

import random
from datetime import date
from datetime import date as D

import pandas as pd
import pytest
from pyspark.sql import functions as F

from equiscope.operators import calendar
from equiscope.plans import backtest, screen
from equiscope.plans.screen import Spec
from tests.plain_backtest import fold

DATES = calendar.rebalance_dates(D(2023, 1, 1), D(2024, 7, 1))
SPANS = [("all", DATES[0], DATES[-1]), ("first", DATES[2], DATES[8]), ("second", DATES[5], DATES[11]), ("last", DATES[12], DATES[-1])]
FRAME = "as_of date, ticker string, sector string, market_cap double, avg_volume_20d double, realized_vol_20d double, momentum_12m_return double, revenue_growth double, roe double, roic double, roa double, net_debt_to_ebitda double, debt_to_equity double, rd_to_revenue double, earnings_stability double, close double"
NO_FILTER = (("volume", {"min_avg_volume": 1.0}),)


def panel(spark, names=30, seed=4):
    """(frame, returns): scores that wander, names without vol, price or sector, a date without names."""
    rng = random.Random(seed)
    level = {i: rng.gauss(0, 1) for i in range(names)}
    f, r = [], []
    for k, d in enumerate(DATES[:-1]):
        for i in range(names):
            level[i] = 0.8 * level[i] + rng.gauss(0, 0.5)
            if k == 7:
                continue
            f.append((d, f"t{i:02d}", rng.choice(["x", "y", "z", None]), 1e9, 0.5 if i == 3 else 9.0, rng.choice([0.1, 0.2, 0.35, None]), round(level[i], 3), 0.1, round(rng.random(), 3), 0.1, 0.1, 1.0, 1.0, 0.1, 0.5, 10.0))
            if rng.random() < 0.9 and k != 9:
                start = 100.0
                r.append((d, f"t{i:02d}", rng.gauss(0.005, 0.06), start * (1 - abs(rng.gauss(0, 0.06))), start))
    frame = spark.createDataFrame(f, FRAME)
    return frame, spark.createDataFrame(r, "as_of date, ticker string, ret double, min_low double, start_price double")


SPECS = [
    Spec("plain", top_n=4), Spec("vol", top_n=5, weighting="inverse_vol"), Spec("capped", top_n=5, max_per_sector=1),
    Spec("bonus", top_n=4, hold_bonus=0.8), Spec("both", top_n=5, max_per_sector=2, hold_bonus=0.4, weighting="inverse_vol", position_stop_loss=0.05, portfolio_stop_loss=0.01),
    Spec("stop", top_n=3, position_stop_loss=0.08), Spec("cash", top_n=6, portfolio_stop_loss=0.005, cost_bps=25.0), Spec("wide", top_n=40, hold_bonus=9.0, weighting="inverse_vol"),
]
SPECS = [screen.replace(s, signals={"momentum_12m": 0.7, "quality_score": 0.3}, filters=NO_FILTER) for s in SPECS]


def expected(frame, returns, spec, spans):
    rows = screen.scored(frame, spec).join(returns, ["as_of", "ticker"], "left").toPandas()
    out = []
    for name, a, b in spans:
        own = DATES[DATES.index(a) : DATES.index(b) + 1]
        out.append(fold(rows, spec, own).assign(run=name))
    return pd.concat(out)


def compared(got, want, columns):
    order = ["strategy_id", "run", "t"]
    got, want = (x.sort_values(order).reset_index(drop=True)[columns] for x in (got, want))
    pd.testing.assert_frame_equal(got, want, check_dtype=False, atol=1e-12)


def test_every_run_equals_a_plain_loop(spark):
    frame, returns = panel(spark)
    got = backtest.backtest(frame, returns, DATES, SPECS, SPANS).toPandas()
    want = pd.concat([expected(frame, returns, s, SPANS) for s in SPECS])
    compared(got, want, ["strategy_id", "run", "t", "as_of", "ret", "n", "swaps", "cost"])
    folded = backtest.with_feedback(frame, returns, DATES, SPECS, SPANS).toPandas()
    compared(folded, want, ["strategy_id", "run", "t", "as_of", "ret", "n", "swaps", "cost", "stopped"])
    assert want["stopped"].sum() > 0 and (want["n"] == 0).any() and want["swaps"].sum() > 0
    first = want[(want["t"] == 0) & (want["n"] > 0)]
    assert (first["cost"] >= 0.001 - 1e-12).all(), "every run pays its first purchase"
    inside = want[(want["run"] == "all") & want["as_of"].isin(DATES[5:11])]["ret"].to_numpy()
    assert not pd.Series(inside).equals(pd.Series(want[want["run"] == "second"]["ret"].to_numpy()))


def test_feedback_stays_in_the_jvm(spark):
    frame, returns = panel(spark)
    plan = backtest.with_feedback(frame, returns, DATES, SPECS)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "aggregate(" in plan.lower()


def test_a_plan_does_not_grow_with_its_strategies(spark):
    frame, returns = panel(spark)
    some = [screen.replace(SPECS[k % 3], name=f"s{k}", top_n=2 + k % 7, max_per_sector=k % 3, signals={"momentum_12m": 1.0 + k, "quality_score": 1.0}) for k in range(1200)]
    size = {n: len(screen.picks_by_strategy(frame, screen.strategy_table(spark, some[:n]))._jdf.queryExecution().analyzed().toString()) for n in (3, 1200)}
    assert size[1200] < size[3] * 1.2
    picks = screen.picks_by_strategy(frame, screen.strategy_table(spark, some))
    counts = {r["strategy_id"]: r["n"] for r in picks.groupBy("strategy_id").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert len(counts) == 1200
    for k in (0, 7, 601, 1199):
        own = screen.screen(frame, some[k]).select("as_of", "ticker", F.round("target_weight", 12).alias("w"))
        got = picks.filter(F.col("strategy_id") == f"s{k}").select("as_of", "ticker", F.round("target_weight", 12).alias("w"))
        assert sorted(own.collect()) == sorted(got.collect())


def test_spans_must_lie_on_the_calendar(spark):
    with pytest.raises(ValueError, match="not on the calendar"):
        backtest.run_calendar(spark.range(1), DATES, [("odd", D(2023, 1, 2), DATES[-1])])
    with pytest.raises(screen.SpecError):
        screen.strategy_table(spark, [Spec("x", filters=(("no_such", {}),))])
    with pytest.raises(screen.SpecError):
        screen.strategy_table(spark, [Spec("x", signals={"no_such": 1.0})])


def test_dates_are_found_without_trying_all(spark):
    rng = random.Random(7)
    day = lambda n: date.fromordinal(D(2000, 1, 1).toordinal() + n)
    lists = [calendar.rebalance_dates(D(2000, 1, 1), D(2009, 6, 1)), calendar.rebalance_dates(D(2000, 1, 1), D(2003, 6, 1), "weekly"), calendar.rebalance_dates(D(2000, 2, 1), D(2008, 1, 1), "quarterly"), sorted({day(rng.randrange(900)) for _ in range(40)} | {day(3000)}), [day(5), day(9)]]
    rows = [(day(a), None if rng.random() < 0.1 else day(a + rng.choice([0, 1, 20, 31, 400, -3]))) for a in (rng.randrange(-60, 3600) for _ in range(400))] + [(d, d) for own in lists for d in own[:5] + own[-3:]]
    df = spark.createDataFrame(rows, "a date, b date")
    for dates in lists:
        for low_in in (False, True):
            for high_in in (False, True):
                at = calendar.dates_between(dates, F.col("a"), F.col("b"), low_in, high_in)
                for r in df.select("a", "b", at.alias("at"), F.size(calendar.period_of(dates, F.col("a"))).alias("n"), F.get(calendar.period_of(dates, F.col("a")), F.lit(0)).alias("p")).collect():
                    assert r["at"] == [d for d in dates if (d >= r["a"] if low_in else d > r["a"]) and (r["b"] is None or (d <= r["b"] if high_in else d < r["b"]))]
                    own = [(x, y) for x, y in zip(dates, dates[1:]) if x <= r["a"] < y]
                    assert r["n"] == len(own) and (not own or tuple(r["p"]) == own[0])

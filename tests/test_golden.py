"""Hand-computed frames: temporal rules, returns, ratios, accounts."""

from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from equiscope.functions import scalar
from equiscope.operators import asof, calendar, facts, metrics, portfolio, rolling, signals, tracking
from equiscope.plans import evaluate
from equiscope.plans.screen import Spec
from equiscope.sources import tables

D = date


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


@pytest.fixture(scope="module")
def fact_log(spark):
    at = lambda m, d, h=0: datetime(2023, m, d, h)
    return spark.createDataFrame(
        [("T", "roe", 0.10, D(2023, 3, 31), at(5, 1), "x"), ("T", "roe", 0.20, D(2023, 6, 30), at(8, 1), "x"), ("T", "roe", 0.11, D(2023, 3, 31), at(9, 15), "x"), ("U", "roe", 0.5, D(2023, 3, 31), at(6, 1, 9), "x")],
        "ticker string, field string, value double, report_date date, observed_at timestamp, source string",
    )


def test_late_restatement_never_shadows_a_newer_period(fact_log):
    days = [D(2023, 5, 15), D(2023, 8, 15), D(2023, 10, 1)]
    got = rows(asof.facts_as_of(fact_log, days).filter("ticker = 'T'"), "as_of", "value")
    assert got == [(days[0], 0.10), (days[1], 0.20), (days[2], 0.20)]


def test_midnight_is_visible_and_intraday_is_not(fact_log):
    got = rows(asof.facts_as_of(fact_log, [D(2023, 5, 1), D(2023, 6, 1), D(2023, 6, 2)]).filter("field = 'roe'"), "as_of", "ticker")
    assert got == [(D(2023, 5, 1), "T"), (D(2023, 6, 1), "T"), (D(2023, 6, 2), "T"), (D(2023, 6, 2), "U")]


def test_one_date_agrees_with_intervals_and_keeps_all_tickers(spark, fact_log):
    who = spark.createDataFrame([("T",), ("Z",)], "ticker string")
    assert rows(asof.facts_as_of_one(fact_log, who, ["roe"], D(2023, 8, 15)), "ticker", "roe") == [("T", 0.20), ("Z", None)]


def test_nothing_after_the_date_matters(fact_log):
    d = D(2023, 8, 15)
    past = fact_log.filter(F.col("observed_at") <= F.lit(d))
    assert rows(asof.facts_as_of(fact_log, [d]), "ticker", "value") == rows(asof.facts_as_of(past, [d]), "ticker", "value")


def bars(spark, closes):
    return spark.createDataFrame([(t, d, c, c, c, 1.0) for t, d, c in closes], "ticker string, date date, close double, low double, high double, volume double")


def test_periods_chain_at_boundaries(spark):
    b = bars(spark, [("A", D(2024, 1, 2), 100.0), ("A", D(2024, 1, 31), 110.0), ("A", D(2024, 2, 3), 121.0), ("A", D(2024, 2, 28), 130.0), ("A", D(2024, 3, 2), 132.0)])
    got = rows(rolling.period_returns(b, [D(2024, 1, 1), D(2024, 2, 1), D(2024, 3, 1)]), "as_of", "ret")
    assert got == [(D(2024, 1, 1), pytest.approx(0.21)), (D(2024, 2, 1), pytest.approx(132 / 121 - 1))]


def test_delisted_name_ends_at_its_last_close(spark):
    b = bars(spark, [("A", D(2024, 2, 3), 121.0), ("A", D(2024, 2, 20), 130.0)])
    assert rows(rolling.period_returns(b, [D(2024, 2, 1), D(2024, 3, 1)]), "ret") == [(pytest.approx(130 / 121 - 1),)]


def test_row_count_guards_of_features(spark):
    from datetime import timedelta

    for n, vol in ((300, True), (30, True), (5, False)):
        b = bars(spark, [("A", D(2023, 1, 1) + timedelta(days=i), 100.0 * (1 + 0.01 * (i % 5 - 2))) for i in range(n)])
        r = rolling.features_as_of(b, [D(2024, 6, 1)]).first()
        assert (r["sma_200"] is not None, r["momentum_12m_return"] is not None, r["realized_vol_20d"] is not None) == (n >= 150, n >= 252, vol)


def test_strict_cut_before_the_date(spark):
    b = bars(spark, [("A", D(2024, 1, 1), 1.0), ("A", D(2024, 1, 2), 2.0)])
    assert rolling.features_as_of(b, [D(2024, 1, 2)]).first()["close"] == 1.0


def test_drawdowns(spark):
    for rets, worst in (((-0.3, 0.1, 0.05), -0.30), ((-0.1, -0.15, 0.2), -0.235)):
        s = spark.createDataFrame([("s", i, r) for i, r in enumerate(rets)], "strategy_id string, t int, ret double")
        assert metrics.bundle(s).first()["max_drawdown"] == pytest.approx(worst)


def test_constant_series_is_neutral(spark):
    s = spark.createDataFrame([("s", i, 0.01) for i in range(3)], "strategy_id string, t int, ret double")
    r = metrics.bundle(s).first()
    assert (r["sharpe"], r["skew"], r["kurt"]) == (pytest.approx(0, abs=1e12), 0.0, 3.0)


def test_capm_recovers_and_guards(spark):
    mkt = [(i, 0.01 * ((i * 7) % 5 - 2)) for i in range(24)]
    m = spark.createDataFrame(mkt, "t int, mkt double")
    s = spark.createDataFrame([("s", i, 0.008 + 1.3 * x) for i, x in mkt] + [("few", 0, 0.1), ("few", 1, 0.2)], "strategy_id string, t int, ret double")
    got = {r["strategy_id"]: r for r in metrics.capm(s, m).collect()}
    assert got["s"]["beta"] == pytest.approx(1.3) and got["s"]["alpha"] == pytest.approx(0.008) and got["few"]["beta"] is None
    flat = metrics.capm(s, m.withColumn("mkt", F.lit(0.01))).collect()
    assert all(r["beta"] is None for r in flat)


def test_ols_matches_a_direct_fit(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    x = rng.normal(size=(40, 2))
    y = 0.3 + x @ [1.5, -0.7] + rng.normal(size=40) * 0.1
    df = spark.createDataFrame([("s", float(b), *map(float, a)) for a, b in zip(x, y, strict=True)] + [("few", 1.0, 2.0, 3.0)], "strategy_id string, y double, a double, b double")
    got = {(r["strategy_id"], r["term"]): r["coef"] for r in metrics.ols(df, "y", ["a", "b"]).collect()}
    want = np.linalg.lstsq(np.c_[np.ones(40), x], y, rcond=None)[0]
    assert [got["s", t] for t in ("const", "a", "b")] == pytest.approx(list(want)) and got["few", "a"] == 0


def test_folds_and_calendars(spark):
    f = calendar.folds(D(2016, 1, 1), D(2026, 1, 1), 36, 12, 12)
    assert len(f) == 7 and f[0][2] == D(2020, 1, 1)
    assert calendar.rebalance_dates(D(2024, 1, 3), D(2024, 1, 20), "weekly") == [D(2024, 1, 8), D(2024, 1, 15)]
    for freq in ("weekly", "monthly", "quarterly"):
        assert [r[0] for r in rows(calendar.calendar(spark, D(2024, 1, 15), D(2025, 1, 1), freq), "as_of")] == calendar.rebalance_dates(D(2024, 1, 15), D(2025, 1, 1), freq)


def test_statement_ratios_and_null_guards(spark):
    cols = "ticker string, calendardate date, datekey date, revenue double, cor double, sgna double, rnd double, netinc double, ebt double, taxexp double, ebit double, ebitda double, equity double, assets double, invcap double, marketcap double, debtusd double, cashnequsd double, fcf double, capex double, ncfo double, sbcomp double, intangibles double, receivables double, inventory double, payables double, ev double, eps double, currentratio double"
    base = ["T", D(2023, 6, 30), D(2023, 8, 1), 200.0, 120.0, 20.0, 10.0, 30.0, 50.0, 10.0, 45.0, 60.0, 300.0, 600.0, 400.0, 1000.0, 100.0, 40.0, 25.0, -8.0, 33.0, 2.0, 60.0, 50.0, 40.0, 30.0, 1060.0, 1.0, 1.5]
    none = ["N", D(2023, 6, 30), D(2023, 8, 1), *[0.0] * 25, None]
    df = spark.createDataFrame([tuple(base), tuple(none)], cols)
    got = {(r["ticker"], r["field"]): r["value"] for r in facts.quarterly_facts(df).collect()}
    assert got["T", "roe"] == pytest.approx(0.1) and got["T", "roic"] == pytest.approx(45 * 0.8 / 400)
    assert got["T", "cash_conversion_cycle"] == pytest.approx((50 / 200 + 40 / 120 - 30 / 120) * 91.25, abs=1e-8) and got["T", "ev_to_sales"] == pytest.approx(1060 / 800)
    assert {f for t, f in got if t == "N"} == {"market_cap"}


def _filing(t, period, key, revenue):
    return (t, period, key, revenue, 1.0, 1.0)


def test_growth_uses_the_filing_public_then_and_skips_missing_quarters(spark):
    s = spark.createDataFrame([_filing("A", D(2022, 6, 30), D(2022, 8, 1), 200.0), _filing("A", D(2022, 6, 30), D(2023, 1, 1), 180.0), _filing("A", D(2023, 6, 30), D(2023, 8, 1), 240.0), _filing("B", D(2022, 3, 31), D(2022, 5, 1), 100.0), _filing("B", D(2023, 6, 30), D(2023, 8, 1), 150.0)], "ticker string, calendardate date, datekey date, revenue double, eps double, sgna double")
    y = s.withColumn("py", F.last_day(F.add_months("calendardate", -12)))
    got = {(r["ticker"], r["calendardate"]): r["_revenue"] for r in asof.filing_as_of(y, "py", ["revenue"], s).collect()}
    assert got["A", D(2023, 6, 30)] == 180.0 and got["B", D(2023, 6, 30)] is None


def test_stints(spark):
    e = spark.createDataFrame([(D(2010, 1, 4), "added", "ACME"), (D(2015, 6, 1), "removed", "ACME"), (D(2012, 1, 1), "added", "BETA"), (D(2011, 1, 1), "removed", "OLD")], "date date, action string, ticker string")
    cur = spark.createDataFrame([("BETA",), ("NEW",)], "ticker string")
    got = rows(facts.stints(e, cur), "ticker", "added_date", "removed_date")
    old = D(1957, 3, 4)
    assert got == [("ACME", D(2010, 1, 4), D(2015, 6, 1)), ("BETA", D(2012, 1, 1), None), ("NEW", old, None), ("OLD", old, D(2011, 1, 1))]


def test_staleness_boundary(spark):
    r = spark.createDataFrame([("A", D(2023, 3, 31)), ("A", D(2023, 6, 30)), ("A", D(2023, 9, 30))], "ticker string, report_date date")
    from datetime import timedelta

    due = D(2023, 9, 30) + timedelta(days=92 + 55)
    got = [facts.staleness(r, due + timedelta(days=k)).collect() for k in (0, 1, 100)]
    assert not got[0] and got[1][0]["quarters_behind"] == 1 and got[1][0]["days_overdue"] == 1 and got[2][0]["quarters_behind"] == 2


def test_corrupt_membership_counts_as_open(spark):
    m = spark.createDataFrame([("A", D(2020, 1, 1), D(2019, 1, 1)), ("B", D(2020, 1, 1), D(2021, 1, 1)), ("C", D(2022, 1, 1), None)], "ticker string, added_date date, removed_date date")
    assert rows(asof.members_as_of(m, [D(2020, 6, 1), D(2021, 1, 1)]), "as_of", "ticker") == [(D(2020, 6, 1), "A"), (D(2020, 6, 1), "B"), (D(2021, 1, 1), "A")]


def test_inverse_vol_weights(spark):
    p = spark.createDataFrame([("a", 0.1), ("b", 0.4), ("c", None)], "ticker string, realized_vol_20d double").withColumn("as_of", F.lit(1))
    w = dict(rows(p.withColumn("w", portfolio.inverse_vol_weight()), "ticker", "w"))
    assert w == {"a": pytest.approx(10 / 18.75), "b": pytest.approx(2.5 / 18.75), "c": pytest.approx(6.25 / 18.75)}
    none = p.withColumn("realized_vol_20d", F.lit(None).cast("double"))
    assert [r[1] for r in rows(none.withColumn("w", portfolio.inverse_vol_weight()), "ticker", "w")] == [pytest.approx(1 / 3)] * 3


def test_live_period_with_deposit(spark):
    e = spark.createDataFrame([("b", datetime(2024, 1, 1, 10), 1, True, 1000.0, ["A"]), ("b", datetime(2024, 2, 1, 10), 2, True, 2100.0, ["A"])], "broker string, ts timestamp_ntz, event_id long, executed boolean, equity double, holdings array<string>")
    f = spark.createDataFrame([("b", D(2024, 1, 15), None, 1000.0)], "broker string, date date, ts timestamp_ntz, amount double")
    fw = tracking.daily_forward(bars(spark, [("A", D(2024, 1, 1), 100.0), ("A", D(2024, 2, 1), 110.0)]), D(2023, 1, 1))
    r = tracking.live_periods(tracking.periods(tracking.last_of_day(e)), fw, fw.select("day", "close"), f).first()
    assert r["realized_ret"] == pytest.approx(0.05) and r["model_ret"] == pytest.approx(0.10)


def test_execution_split(spark):
    fw = tracking.daily_forward(bars(spark, [("A", D(2024, 1, 2), 100.0)]), D(2024, 1, 1))
    o = spark.createDataFrame([("b", D(2024, 1, 2), "A", "buy", 1000.0, 100.5, 101.0)], "broker string, date date, ticker string, side string, notional double, arrival_price double, fill_price double")
    eq = spark.createDataFrame([("b", D(2024, 1, 2), 10000.0)], "broker string, date date, equity double")
    r = tracking.execution_costs(o, fw, eq).first()
    assert (r["total_bps"], r["timing_bps"], r["slippage_bps"], r["book_bps"]) == (pytest.approx(100), pytest.approx(50), pytest.approx(49.751, abs=1e-3), pytest.approx(10))


def test_drifting_logs(spark):
    docs = [("20240102_101500_a.json", '{"date":"2024-01-02","mode":"paper","account":{"equity":1000.5,"broker":"alpaca"},"picks":["A","B"],"orders":[{"ticker":"A","side":"buy","notional":5.0}]}'),
            ("x.json", '{"date":"2024-01-03","account":"robin","account_after":{"total_value":7},"holdings":{"Z":1,"Y":2},"dry_run":true}'), ("bad.json", "{oops")]
    got = {r["broker"]: r for r in tracking.read_logs(spark.createDataFrame(docs, "name string, text string")).collect()}
    assert set(got) == {"alpaca-paper", "robin"}
    a, b = got["alpaca-paper"], got["robin"]
    assert a["ts"] == datetime(2024, 1, 2, 10, 15) and a["equity"] == 1000.5 and a["orders"][0]["notional"] == 5.0 and a["executed"]
    assert b["ts"] == datetime(2024, 1, 3, 12) and b["holdings"] == ["Y", "Z"] and not b["executed"] and b["equity"] == 7


def test_normal_functions(spark):
    import math

    xs = [-8.0, -3.0, -0.5, 0.0, 1.0, 2.5, 6.0]
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    for r in df.select("x", scalar.normal_cdf(F.col("x")).alias("c")).collect():
        assert r["c"] == pytest.approx(0.5 * math.erfc(-r["x"] / math.sqrt(2)), rel=1e-6, abs=1e-15)
    p = spark.createDataFrame([(x,) for x in (0.0, 0.001, 0.3, 0.5, 0.975, 1.0)], "p double").select(scalar.normal_ppf(F.col("p")).alias("q")).collect()
    assert [r["q"] for r in p] == [-math.inf, pytest.approx(-3.0902323, abs=1e-6), pytest.approx(-0.5244005, abs=1e-6), pytest.approx(0, abs=1e-9), pytest.approx(1.9599640, abs=1e-6), math.inf]


def test_specs_fail_fast():
    for bad in ({"signals": {"nope": 1.0}}, {"unknown": 1}, {"signals": {"momentum_12m": 0.0}}, {"weighting": "odd"}):
        with pytest.raises(signals.SpecError):
            Spec.of(bad)
    with pytest.raises(signals.SpecError):
        signals.FILTERS.bind("volume", {"min_cap": 1})
    with pytest.raises(signals.SpecError):
        signals.FILTERS.add("volume")(lambda: None)


def test_experiment_budget(spark):
    r = spark.createDataFrame([(f"s{i}", 0, D(2024, 1, 1), 0.1) for i in range(3)], "strategy_id string, t int, as_of date, ret double")
    with pytest.raises(ValueError):
        evaluate.experiment(r, D(2024, 6, 1), budget=2)


def test_sinks_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("A", 1.5)], "ticker string, composite_score double")
    df.write.json(str(tmp_path / "j"))
    df.write.csv(str(tmp_path / "c"), header=True)
    assert spark.read.schema(df.schema).json(str(tmp_path / "j")).collect() == spark.read.schema(df.schema).csv(str(tmp_path / "c"), header=True).collect() == df.collect()


def test_replace_index_is_per_index(spark, tmp_path):
    at = str(tmp_path / "m")
    make = lambda r: spark.createDataFrame(r, "ticker string, index_name string, added_date string, removed_date string")
    tables.replace_index(spark, at, make([("A", "I", "2020-01-01", None), ("B", "J", "2020-01-01", None)]))
    tables.replace_index(spark, at, make([("C", "I", "soon", "2021-01-01")]))
    assert rows(spark.read.parquet(at), "ticker", "index_name") == [("B", "J"), ("C", "I")]


def test_fold_pruning_changes_nothing(spark):
    import random

    import pandas as pd

    from equiscope.plans.backtest import pruned
    from tests.plain_backtest import fold

    rng = random.Random(3)
    dates = calendar.rebalance_dates(D(2024, 1, 1), D(2024, 9, 1))
    r = [(d, f"t{i:02d}", round(rng.gauss(0, 1), 3), rng.choice(["x", "y", None]), rng.choice([0.1, 0.2, None]), rng.gauss(0, 0.1), 90.0 + rng.random() * 10, 100.0) for d in dates for i in range(30)]
    df = spark.createDataFrame(r, "as_of date, ticker string, composite_score double, sector string, realized_vol_20d double, ret double, min_low double, start_price double")
    for spec in (Spec("a", top_n=4, hold_bonus=0.8), Spec("b", top_n=5, max_per_sector=2, hold_bonus=0.4, weighting="inverse_vol", position_stop_loss=0.05, portfolio_stop_loss=0.01)):
        whole, part = df.toPandas(), pruned(df, spec).toPandas()
        assert len(part) < len(whole)
        pd.testing.assert_frame_equal(fold(whole, spec, dates), fold(part, spec, dates))


def test_flows_fall_into_the_period_that_holds_their_time(spark):
    at = lambda d, h: datetime(2024, 1, d, h)
    p = spark.createDataFrame([("b", at(1, 10), at(10, 10)), ("b", at(10, 10), at(20, 10)), ("c", at(1, 10), at(5, 10))], "broker string, start_ts timestamp_ntz, end_ts timestamp_ntz")
    f = spark.createDataFrame([("b", D(2024, 1, 1), at(1, 10), 1.0), ("b", D(2024, 1, 10), at(10, 10), 2.0), ("b", D(2024, 1, 10), None, 4.0), ("b", D(2024, 1, 20), at(20, 10), 8.0), ("b", D(2024, 1, 21), None, 16.0), ("c", D(2024, 1, 6), None, 32.0)], "broker string, date date, ts timestamp_ntz, amount double")
    assert rows(tracking.flows_inside(p, f), "broker", "start_ts", "flows") == [("b", at(1, 10), 2.0), ("b", at(10, 10), 12.0), ("c", at(1, 10), 0.0)]


def test_unresolvable_account_fails(spark):
    p = spark.createDataFrame([(1, "A", 0.5), (1, "B", 0.5), (2, "B", 1.0)], "account int, ticker string, weight double")
    known = lambda *t: spark.createDataFrame([(x,) for x in t], "ticker string")
    assert rows(tracking.resolvable_picks(p, known("B")), "account", "weight") == [(1, 1.0), (2, 1.0)]
    with pytest.raises(Exception, match="no tradeable pick"):
        tracking.resolvable_picks(p, known("A")).collect()


def test_log_files_and_their_times(spark, tmp_path):
    (tmp_path / "logs").mkdir()
    (tmp_path / "logs" / "20240102_101500_a.json").write_text('{\n "date":"2024-01-02","mode":"live","account":{"equity":5},"picks":["A"],"weights":{"A":1.0}\n}')
    (tmp_path / "logs" / "other.json").write_text('{"date":"2024-01-03","account":"robin","holdings":["Z"]}')
    got = {r["broker"]: r for r in tracking.read_log_files(spark, str(tmp_path / "logs")).collect()}
    assert got["alpaca-live"]["ts"] == datetime(2024, 1, 2, 10, 15) and got["alpaca-live"]["weights"] == {"A": 1.0}
    assert got["robin"]["ts"] == datetime(2024, 1, 3, 12) and got["robin"]["holdings"] == ["Z"]


def test_ledger_is_seeded_once(spark, tmp_path):
    flow = lambda x: spark.createDataFrame([("b", D(2024, 1, 2), datetime(2024, 1, 2, 9), x)], "broker string, date date, ts timestamp_ntz, amount double")
    at = str(tmp_path / "ledger")
    assert [tracking.ledger(spark, at, flow(x), again).first()["amount"] for x, again in ((1.0, False), (2.0, False), (3.0, True))] == [1.0, 1.0, 3.0]
    assert tracking.ledger(spark, at, flow(0.0)).first()["ts"] == datetime(2024, 1, 2, 9)


def test_history_load_twice_adds_nothing(spark, tmp_path):
    from equiscope.plans import load

    m = spark.createDataFrame([("A", "I", D(2020, 1, 1), None), ("B", "I", D(2000, 1, 1), D(2001, 1, 1))], "ticker string, index_name string, added_date date, removed_date date")
    b = bars(spark, [("A", D(2021, 1, 4), 1.0), ("A", D(2021, 1, 5), 2.0), ("B", D(2021, 1, 4), 1.0)])
    f = spark.createDataFrame([("A", "roe", 0.1, D(2021, q * 3, 28), datetime(2021, 12, 1)) for q in (1, 2, 3)], "ticker string, field string, value double, report_date date, observed_at timestamp")
    s = spark.createDataFrame([("A", "x"), ("B", "y")], "ticker string, sector string")
    bench = b.groupBy("date").agg(F.avg("close").alias("close"))
    for again in range(2):
        load.history(spark, str(tmp_path), m, f, b.withColumn("close", F.col("close") + again), bench, s, D(2021, 1, 1))
    got = {r["part"]: (r["n"], r["tickers"]) for r in load.report(spark, str(tmp_path), D(2023, 1, 1)).collect()}
    assert got == {"members": (2, 2), "facts": (3, 1), "prices": (2, 1), "benchmark": (2, 1), "sectors": (1, 1), "overdue": (4, 1)}
    assert rows(spark.read.parquet(f"{tmp_path}/prices"), "close") == [(1.0,), (2.0,)]


def test_research_log_replaces_runs_and_counts_budgets(spark):
    make = lambda *r: spark.createDataFrame([(i, "e", "{}", datetime(2024, 1, 1), datetime(2024, 1, d), h, m, "completed") for i, d, h, m in r], "experiment_id string, experiment_name string, config_json string, started_at timestamp, completed_at timestamp, holdout_used boolean, metrics_json string, status string")
    log = evaluate.append_runs(make(("1", 2, False, "a"), ("2", 2, False, "b")), make(("2", 3, True, "c"), ("3", 3, False, "d")))
    assert rows(log, "experiment_id", "metrics_json") == [("1", "a"), ("2", "c"), ("3", "d")]
    assert rows(evaluate.budgets(log, 5), "n", "holdout_used", "left", "may_use_holdout") == [(3, 1, 2, False)]


def test_streamed_facts_compact(spark, tmp_path):
    from equiscope.streaming import ingest

    make = lambda *r: spark.createDataFrame(r, "k string, v int, o int")
    put = ingest.upsert_facts(str(tmp_path / "t"), ["k"], ["o"])
    put(make(("a", 1, 1), ("a", 2, 2), ("b", 1, 1)), 0)
    for _ in range(2):  # a batch that is run again
        put(make(("a", 9, 9), ("b", 0, 0)), 1)
    now = lambda at: rows(ingest.current_facts(spark.read.parquet(str(tmp_path / at)), ["k"], ["o"]), "k", "v")
    assert now("t") == [("a", 9), ("b", 1)]
    ingest.compacted(spark, str(tmp_path / "t"), str(tmp_path / "u"), ["k"], ["o"])
    assert now("u") == [("a", 9), ("b", 1)] and spark.read.parquet(str(tmp_path / "u")).count() == 2


def test_scratch_needs_a_shared_folder_on_a_cluster(spark):
    from types import SimpleNamespace

    from equiscope.sources import stage

    conf = SimpleNamespace(get=lambda k, d: None)
    with pytest.raises(RuntimeError):
        stage.shared_dir(SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master="spark://host:7077")))


def test_growth_falls_back_to_years_below_five_quarters(spark):
    q = spark.createDataFrame([("A", D(2024, m, 28), 10.0 + m, 1.0) for m in (3, 6, 9)] + [("B", D(2023 + i // 4, 3 * (i % 4) + 3, 28), 10.0 + i, 1.0) for i in range(6)], "ticker string, date date, revenue double, eps double").withColumn("roe", F.lit(0.5))
    y = spark.createDataFrame([("A", D(2023, 12, 31), 0.3, 0.4), ("A", D(2022, 12, 31), 0.1, None), ("B", D(2023, 12, 31), 9.0, 9.0)], "ticker string, date date, rev_growth double, eps_growth double")
    got = {r["ticker"]: r for r in facts.merged_live(q.select("ticker", "date", "roe"), q, ["roe"], y).collect()}
    assert (got["A"]["rev_growth_current"], got["A"]["rev_growth_prior"], got["A"]["eps_growth_prior"]) == (0.3, 0.1, None)
    assert got["B"]["rev_growth_current"] == pytest.approx(15 / 11 - 1) and got["B"]["rev_growth_prior"] == pytest.approx(14 / 10 - 1)

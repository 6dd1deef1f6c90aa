"""Versioned tables, gated experiments, random portfolios, wide filings, sinks and views against plain versions."""

import hashlib
import random
from datetime import date as D
from datetime import datetime
from statistics import mean, stdev

import duckdb
import pytest
from pyspark.sql import functions as F

from equiscope.operators import asof, calendar, facts, resample
from equiscope.plans import backtest, catalog, evaluate, load, research, screen, views
from equiscope.plans.screen import Spec
from equiscope.sources import domain, sinks
from equiscope.sources.schemas import FIELDS, RESEARCH_LOG
from equiscope.sources.versioned import Versioned
from equiscope.streaming import ingest
from tests.plain_backtest import fold
from tests.test_backtests import DATES, NO_FILTER, SPECS, panel
from tests.test_queries import TABLES, cells

catalog.load()


# versions


def test_versions_are_whole_and_ordered(spark, tmp_path):
    make = lambda *r: spark.createDataFrame([(x,) for x in r], "x int")
    t = Versioned(spark, str(tmp_path / "t"), "x int")
    got = lambda v=None: sorted(r["x"] for r in t.read(v).collect())
    assert t.version() == -1 and got() == []
    a = t.write(make(1, 2))
    assert got() == [], "a folder counts once a version names it"
    assert t.commit(-1, [a]) and t.version() == 0
    b = t.write(make(3))
    assert not t.commit(-1, [b]) and got() == [1, 2], "the version is taken"
    assert t.change(lambda now: [*now, b]) == 1 and got() == [1, 2, 3] and got(0) == [1, 2]
    c = t.write(make(9))
    t.change(lambda now: [c])
    t.write(make(7))  # never committed
    assert got() == [9] and len(t.clean(keep=1)) == 3 and got() == [9]


def test_batches_and_compactions_in_any_order(spark, tmp_path):
    make = lambda *r: spark.createDataFrame(r, "k string, v int, o int")
    t = Versioned(spark, str(tmp_path / "t"), "k string, v int, o int")
    put = ingest.upsert_versioned(t, ["k"], ["o"])
    now = lambda: {r["k"]: r["v"] for r in ingest.current_facts(t.read(), ["k"], ["o"]).collect()}
    put(make(("a", 1, 1), ("b", 1, 1), ("a", 2, 2)), 0)
    put(make(("a", 3, 3)), 1)
    put(make(("a", 99, 99)), 1)  # a batch that is run again changes nothing
    before = t.read()
    ingest.compact(t, ["k"], ["o"])
    assert now() == {"a": 3, "b": 1} and len(t.folders(t.version())) == 1
    assert before.count() == 3, "readers of the old version read on"
    put(make(("a", 99, 99)), 1)  # also after it was compacted
    put(make(("c", 5, 5), ("b", 6, 6)), 2)
    assert now() == {"a": 3, "b": 6, "c": 5} and len(t.folders(t.version())) == 2
    late = ingest.upsert_versioned(t, ["k"], ["o"], compact_after=1)
    late(make(("d", 1, 1)), 3)
    assert now() == {"a": 3, "b": 6, "c": 5, "d": 1} and len(t.folders(t.version())) == 1


def history_inputs(spark, days, price=1.0, index="I"):
    m = spark.createDataFrame([("A", index, D(2020, 1, 1), None)], "ticker string, index_name string, added_date date, removed_date date")
    b = spark.createDataFrame([("A", D(2021, 1, d), price, 1.0) for d in days], "ticker string, date date, close double, volume double")
    f = spark.createDataFrame([("A", "roe", 0.1, D(2021, 3, d), datetime(2021, 12, 1)) for d in days], "ticker string, field string, value double, report_date date, observed_at timestamp")
    return m, f, b, b.select("date", "close"), spark.createDataFrame([("A", "x")], "ticker string, sector string"), D(2021, 1, 1)


def test_a_load_that_is_cut_off_leaves_the_last_one(spark, tmp_path, monkeypatch):
    at = str(tmp_path / "h")
    counts = lambda v=None: {r["part"]: r["n"] for r in load.report(spark, at, D(2021, 6, 1), v).collect()}
    with pytest.raises(ValueError):
        load.report(spark, at, D(2021, 6, 1))
    assert load.history(spark, at, *history_inputs(spark, [4, 5])) == 0
    first = counts()

    def broken(*a):
        raise OSError("lost")

    with monkeypatch.context() as m:
        m.setattr(Versioned, "commit", broken)
        with pytest.raises(OSError):
            load.history(spark, at, *history_inputs(spark, [4, 5, 6]))
    assert counts() == first and first["prices"] == 2
    assert len(load.swept(spark, at)) == 5 and counts() == first, "all that it wrote"
    assert load.history(spark, at, *history_inputs(spark, [4, 5, 6], index="J")) == 1
    assert (counts()["prices"], counts()["facts"], counts()["members"], counts(0)) == (3, 3, 2, first)


def test_of_two_loads_at_once_none_stores_a_key_twice(spark, tmp_path, monkeypatch):
    at, commit, raced = str(tmp_path / "h"), Versioned.commit, []

    def late(self, after, folders):
        if not raced:  # another load comes first
            raced.append(True)
            load.history(spark, at, *history_inputs(spark, [5, 6], price=7.0))
        return commit(self, after, folders)

    monkeypatch.setattr(Versioned, "commit", late)
    assert load.history(spark, at, *history_inputs(spark, [4, 5])) == 1
    log = Versioned(spark, at, "ticker string")
    got = sorted((r["date"].day, r["close"]) for r in load.stored(log, 1, "prices").collect())
    assert got == [(4, 1.0), (5, 7.0), (6, 7.0)] and load.stored(log, 1, "membership").count() == 1


# experiments


def experiment(most=20, **limits):
    base = Spec("base", signals={"momentum_12m": 1.0}, filters=NO_FILTER, top_n=4, weighting="inverse_vol", hold_bonus=0.5, position_stop_loss=0.08, max_per_sector=2)
    return research.Experiment("exp", "?", base, ({"name": "trend"}, {"name": "mixed", "signals": {"momentum_12m": 0.5, "quality_score": 0.5}}, {"name": "quality", "signals": {"quality_score": 1.0}}), DATES[0], DATES[11], DATES[-1], most, {"least_periods": 5, "least_sharpe": -99.0, "worst_drawdown": -0.99, **limits})


def sharpe(xs):
    return mean(xs) / stdev(xs) * 12**0.5 if len(xs) > 1 and stdev(xs) > 0 else 0.0


def test_holdout_is_shown_once_and_budgets_end(spark, tmp_path):
    frame, returns = panel(spark)
    log, e = Versioned(spark, str(tmp_path / "log"), RESEARCH_LOG), experiment(most=6)
    specs = e.specs()
    assert all((s.weighting, s.hold_bonus, s.position_stop_loss, s.max_per_sector, s.top_n) == ("inverse_vol", 0.5, 0.08, 2, 4) for s in specs)
    rows = lambda s: screen.scored(frame, s).join(returns, ["as_of", "ticker"], "left").toPandas()
    own = lambda s, a, b: sharpe(list(fold(rows(s), s, DATES[a : b + 1])["ret"]))
    first = {r["strategy_id"]: r for r in research.run(log, e, frame, returns, DATES).collect()}
    want = {s.name: own(s, 0, 11) for s in specs}
    assert {k: r["train_sharpe"] for k, r in first.items()} == pytest.approx(want)
    best = max(want, key=want.get)
    assert [k for k, r in first.items() if r["best"]] == [best]
    assert first[best]["holdout_sharpe"] == pytest.approx(own(next(s for s in specs if s.name == best), 11, len(DATES) - 1))
    assert [r["holdout_sharpe"] for k, r in first.items() if k != best] == [None, None]
    assert research.left(log.read(), "exp", 6) == (2, False)
    second = {r["strategy_id"]: r for r in research.run(log, e, frame, returns, DATES).collect()}
    assert set(second) == {"trend", "mixed"} and all(r["holdout_sharpe"] is None for r in second.values())
    with pytest.raises(research.BudgetExhausted):
        research.run(log, e, frame, returns, DATES)
    assert log.read().count() == 6 and log.read().filter("holdout_used").count() == 1
    assert research.left(log.read(), "other", 6) == (6, True)


def test_two_calls_at_once_share_one_holdout(spark, tmp_path):
    frame, returns = panel(spark)
    log, e = Versioned(spark, str(tmp_path / "log"), RESEARCH_LOG), experiment()
    inner = []

    def other() -> None:
        if not inner:
            inner.append(None)
            inner[0] = research.run(log, e, frame, returns, DATES).collect()

    outer = research.run(log, e, frame, returns, DATES, between=other).collect()
    shown = [[r for r in rows if r["holdout_sharpe"] is not None] for rows in (inner[0], outer)]
    assert len(shown[0]) == 1 and shown[1] == [], "the call that committed first has seen the holdout"
    assert log.read().count() == 7 and log.read().filter("holdout_used").count() == 1


def test_a_failed_call_leaves_the_log(spark, tmp_path):
    frame, returns = panel(spark)
    log, e = Versioned(spark, str(tmp_path / "log"), RESEARCH_LOG), experiment()

    def fails() -> None:
        raise RuntimeError("lost")

    with pytest.raises(RuntimeError, match="lost"):
        research.run(log, e, frame, returns, DATES, between=fails)
    assert log.version() == -1 and research.left(log.read(), "exp", 20) == (20, True)
    none = experiment(least_sharpe=99.0)
    assert all(r["holdout_sharpe"] is None and not r["best"] for r in research.run(log, none, frame, returns, DATES).collect())
    assert research.left(log.read(), "exp", 20) == (17, True), "without a clean variation the holdout stays unused"


def test_walk_forward_counts_all_folds(spark):
    frame, returns = panel(spark)
    spans = [(f"f{i}", DATES[a], DATES[a + 5]) for i, a in enumerate((0, 5, 10))]
    runs = backtest.backtest(frame, returns, DATES, SPECS[:4], spans)
    got = {(r["strategy_id"], r["run"]): r for r in evaluate.walk_forward_runs(runs, 3).collect()}
    for s in SPECS[:4]:
        rows = screen.scored(frame, s).join(returns, ["as_of", "ticker"], "left").toPandas()
        own = [sharpe(list(fold(rows, s, DATES[a : a + 6])["ret"])) for a in (0, 5, 10)]
        assert [got[s.name, f"f{i}"]["sharpe"] for i in range(3)] == pytest.approx(own)
        assert got[s.name, "f0"]["consistency"] == pytest.approx(sum(x > 0 for x in own) / 3)


# random portfolios


def draw(*key):
    return int(hashlib.md5(":".join(map(str, key)).encode()).hexdigest()[:13], 16) / 16**13


def test_random_portfolios_equal_a_plain_loop(spark):
    rng = random.Random(5)
    sizes = [0, 3, 7, 18, 25, 60, 90]
    dates = calendar.rebalance_dates(D(2024, 1, 1), D(2024, 8, 1))
    universe = {d: sorted(f"t{k:03d}" for k in range(n)) for d, n in zip(dates, sizes)}
    rets = {(d, t): (rng.gauss(0, 0.05), 100 * (1 - abs(rng.gauss(0, 0.05)))) for d, ts in universe.items() for t in ts if rng.random() < 0.8 and d != dates[3]}
    u = spark.createDataFrame([(d, t) for d, ts in universe.items() for t in ts], "as_of date, ticker string")
    r = spark.createDataFrame([(d, t, x, low, 100.0) for (d, t), (x, low) in rets.items()], "as_of date, ticker string, within_ret double, min_low double, start_price double")
    legs = [(2, 0.0), (5, 0.0), (5, 0.03)]
    got = {(x["n"], x["stop"], x["iteration"]): x["sharpe"] for x in resample.random_portfolios(u, r, dates, legs, iterations=8).collect()}
    assert len(got) == 24

    def places(i, d, size, most=5):
        if size > 4 * most:
            out = list(dict.fromkeys(int(draw(42, i, d, j) * size) for j in range(3 * most + 40)))[:most]
            if len(out) == most:
                return out
        return [p for _, p in sorted((draw(42, i, d, "p", p), p) for p in range(size))][:most]

    for (n, stop, i), s in got.items():
        series = []
        for d in dates[:-1]:
            ts = universe[d]
            own = [rets.get((d, ts[p])) for p in places(i, d, len(ts))[:n]]
            own = [(-stop if stop and low < 100 * (1 - stop) else x) for x, low in filter(None, own)]
            series.append(mean(own) - 0.002 if own and len(ts) >= n else 0.0)
        assert s == pytest.approx(sharpe(series)), (n, stop, i)


def test_draws_that_repeat_too_often_are_made_up_for(spark, monkeypatch):
    monkeypatch.setattr(resample, "draw", lambda *k: F.lit(0.5))  # every draw is the same place
    p = spark.createDataFrame([(D(2024, 1, 1), 50)], "as_of date, size int")
    got = resample.drawn_places(p, 2, 4).groupBy("iteration").agg(F.countDistinct("place").alias("n"), F.count("k").alias("k")).collect()
    assert [(r["n"], r["k"]) for r in got] == [(4, 4)] * 2


def test_monte_carlo_legs():
    specs = [Spec("a", top_n=5), Spec("b", top_n=7, hold_bonus=1.0, position_stop_loss=0.1)]
    assert backtest.monte_carlo_leg(specs)[1] == [(5, 0.0), (7, 0.0)] and backtest.monte_carlo_leg(specs)[0][1].hold_bonus == 0.0
    assert backtest.monte_carlo_leg(specs, True) == (specs, [(5, 0.0), (7, 0.1)])


# filings


def test_wide_filings_equal_the_fact_log(spark, sf):
    made = domain.statements(spark, sf)
    late = made.filter("crc32(concat(ticker, calendardate)) % 7 = 0").withColumns({"datekey": F.date_add("datekey", 200), "equity": F.lit(None).cast("double"), "revenue": F.col("revenue") * 2})
    both = made.filter("crc32(concat(ticker, datekey)) % 5 > 0").unionByName(late)
    for dates in (calendar.rebalance_dates(D(1997, 1, 1), D(2000, 1, 1), "quarterly"), [D(1998, 6, 1)]):
        want = asof.pivoted(asof.facts_as_of(facts.filing_facts(both), dates), ["as_of", "ticker"], FIELDS).select("as_of", "ticker", *FIELDS).toPandas()
        got = facts.filings_known(both, dates, FIELDS).select("as_of", "ticker", *FIELDS).toPandas()
        order = ["as_of", "ticker"]
        a, b = (x.sort_values(order).reset_index(drop=True) for x in (got, want))
        assert len(a) > 5 and a.equals(b)


def test_one_date_reads_up_to_that_date(spark, sf):
    from equiscope.plans.queries_panel import ONE, frame

    plan = frame(spark, sf, [ONE])._jdf.queryExecution().executedPlan().toString()
    scans = [x for x in plan.split("\n") if "FileScan" in x and "lineitem" in x or ("FileScan" in x and "l_shipdate" in x)]
    assert scans and all("LessThanOrEqual(l_shipdate" in x for x in scans)


# sinks and views


def test_sinks_are_whole_and_have_one_header(spark, tmp_path):
    df = spark.createDataFrame([(k, f"a,{k}", None if k % 3 else k / 2) for k in range(50)], "rank int, ticker string, composite_score double")
    for kind in ("json", "csv"):
        at = str(tmp_path / kind)
        assert sinks.put(df.limit(3), at, kind, ["rank"]) == 1 and sinks.put(df, at, kind, ["rank"]) == 1
        files = list((tmp_path / kind).glob("part-*"))
        assert len(files) == 1 and sinks.get(df, at, kind).collect() == df.collect()
        assert kind == "json" or files[0].read_text().count("rank,ticker") == 1
        assert [p.name for p in tmp_path.iterdir()].count(kind) == 1 and not list(tmp_path.glob(f"{kind}.*"))
        assert sinks.put(df, at, kind, ["rank"], rows_per_file=20) == 3 and sorted(sinks.get(df, at, kind).collect(), key=lambda r: r["rank"]) == df.collect()
    with pytest.raises(ValueError):
        sinks.put(df, str(tmp_path / "x"), "xml", ["rank"])


def test_sql_over_stages(spark, sf):
    v = views.Views(spark, sf, D(1998, 1, 1), D(1998, 6, 1), prefix="s_")
    n = v.sql("SELECT count(*) AS n, count(DISTINCT as_of) AS d FROM s_universe").first()
    assert set(v._made) == {"universe", "membership", "bars"} and n["d"] == 6 and n["n"] == v["universe"].count()
    both = v.sql("SELECT p.as_of, p.ticker FROM s_picks p JOIN s_panel USING (as_of, ticker) JOIN s_scores USING (as_of, ticker) LEFT JOIN s_returns USING (as_of, ticker)")
    assert both.count() == v["picks"].count() > 0 and {"known", "filings", "features", "panel", "picks"} - set(v._made) == {"features"}
    with pytest.raises(KeyError):
        v["nothing"]


# figures that vary: at the smallest scale they do not


BIG = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def big():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{BIG}/{t}.parquet')")
    return con


@pytest.mark.parametrize(("name", "column", "least"), [("a23_factor_attribution", "coef", 20), ("a24_factor_returns", "value", 50), ("a25_signal_correlations", "corr", 6), ("a32_a33_walk_forward", "sharpe", 20), ("b12_backtest_with_feedback", "swaps", 6), ("a27_monte_carlo_percentile", "mean_trial", 3)])
def test_varying_figures_equal_their_sql(spark, big, name, column, least):
    got = catalog.QUERIES[name](spark, BIG).toPandas()
    assert got[column].nunique() >= least and got[column].abs().max() > 0
    assert cells(got) == cells(big.execute(catalog.ORACLES[name]).df())

"""Queries of calendars, point-in-time panels, signals, ranking and portfolios."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from equiscope.functions.normalize import zscores
from equiscope.functions.scalar import periods_per_year
from equiscope.operators import asof, calendar, facts, portfolio, rolling, signals
from equiscope.plans import screen, views
from equiscope.plans.catalog import query
from equiscope.plans.queries_tables import FACTS, all_facts
from equiscope.plans.screen import Spec
from equiscope.sources import domain, sinks
from equiscope.sources.domain_sql import BARS, MEMBERSHIP, SECTORS, using
from equiscope.sources.schemas import FIELDS
from equiscope.sources.stage import compiled, scratch

START, END = date(1997, 1, 1), date(2001, 11, 1)
DATES = calendar.rebalance_dates(START, END)
QUARTERS = calendar.rebalance_dates(START, END, "quarterly")
ONE = date(2000, 6, 1)
BASE = Spec()
ALL_SIGNALS = ["piotroski_f", "momentum_12m", "low_leverage_growth", "quality_score", "margin_expansion", "quality_midcap", "quality_at_discount_midcap"]

CAL = "cal AS (SELECT CAST(d AS DATE) AS as_of, lead(CAST(d AS DATE)) OVER (ORDER BY d) AS next_as_of, CAST(row_number() OVER (ORDER BY d)-1 AS INTEGER) AS t FROM generate_series(DATE '1997-01-01', DATE '2001-11-01', INTERVAL 1 MONTH) g(d))"
ONE_CAL = "cal AS (SELECT DATE '2000-06-01' AS as_of)"
LONG = """known AS (SELECT as_of, ticker, field, value, report_date FROM (SELECT c.as_of, f.*, row_number() OVER (PARTITION BY c.as_of, ticker, field ORDER BY report_date DESC, observed_at DESC) AS rn
 FROM cal c JOIN facts f ON CAST(f.observed_at AS DATE) <= c.as_of) WHERE rn=1)"""
WIDE = "pit AS (SELECT as_of, ticker, " + ", ".join(f"max(value) FILTER (field='{f}') AS {f}" for f in FIELDS) + " FROM known GROUP BY as_of, ticker)"
ROLLED = """r0 AS (SELECT *, close/nullif(lag(close) OVER w,0)-1 AS ret, row_number() OVER w AS n_days, lead(date) OVER w AS next_date FROM bars WINDOW w AS (PARTITION BY ticker ORDER BY date)),
 rolled AS (SELECT ticker, date, next_date, close, n_days, CASE WHEN n_days>=150 THEN avg(close) OVER (PARTITION BY ticker ORDER BY date ROWS 199 PRECEDING) END AS sma_200,
  CASE WHEN n_days>=252 THEN lag(close,21) OVER w/nullif(lag(close,251) OVER w,0)-1 END AS momentum_12m_return,
  CASE WHEN n_days>=16 THEN stddev_samp(ret) OVER (PARTITION BY ticker ORDER BY date ROWS 19 PRECEDING)*sqrt(252.0::DOUBLE) END AS realized_vol_20d,
  avg(volume) OVER (PARTITION BY ticker ORDER BY date ROWS 19 PRECEDING) AS avg_volume_20d,
  close/nullif(first_value(close) OVER (PARTITION BY ticker ORDER BY date ROWS 251 PRECEDING),0)-1 AS trailing_return FROM r0 WINDOW w AS (PARTITION BY ticker ORDER BY date)),
 feat AS (SELECT c.as_of, r.* FROM rolled r JOIN cal c ON r.date < c.as_of AND (r.next_date IS NULL OR c.as_of <= r.next_date))"""
UNIVERSE = "mem AS (SELECT DISTINCT c.as_of, m.ticker FROM cal c JOIN membership m ON m.added_date<=c.as_of AND (m.removed_date IS NULL OR m.removed_date<=m.added_date OR m.removed_date>c.as_of)), uni AS (SELECT m.* FROM mem m JOIN (SELECT DISTINCT c.as_of, b.ticker FROM cal c JOIN bars b ON b.date BETWEEN c.as_of-30 AND c.as_of) USING (as_of, ticker))"
TRADEABLE = "trd AS (SELECT DISTINCT c.as_of, b.ticker FROM cal c JOIN bars b ON b.date BETWEEN c.as_of-30 AND c.as_of)"
#: the screening frame under a name, of the names in a table of (as_of, ticker)
FRAMED = "{} AS (SELECT p.*, f.close, f.avg_volume_20d, f.sma_200, f.momentum_12m_return, f.realized_vol_20d, f.n_days, s.sector FROM pit p SEMI JOIN {} USING (as_of, ticker) LEFT JOIN feat f USING (as_of, ticker) LEFT JOIN sectors s USING (ticker))"
FRAME = ",\n".join([MEMBERSHIP, UNIVERSE, FRAMED.format("frame", "uni")])
FILTERED = "kept AS (SELECT * FROM frame WHERE market_cap>=1e6 AND avg_volume_20d>=10 AND coalesce(realized_vol_20d,1.0::DOUBLE)>=0.01)"


def _mm(x: str) -> str:
    return f"(CASE WHEN min({x}) OVER d IS NULL OR min({x}) OVER d = max({x}) OVER d THEN 0.5::DOUBLE ELSE ({x}-min({x}) OVER d)/(max({x}) OVER d-min({x}) OVER d) END)"


def _comp(c: str, invert: bool = False, clip: tuple[float, float] | None = None, fill: float = 0.0) -> tuple[str, str]:
    x = f"coalesce({c},{fill}::DOUBLE)"
    x = f"least(greatest({x},{clip[0]}::DOUBLE),{clip[1]}::DOUBLE)" if clip else x
    return f"count({c}) OVER d > 0", f"(1-{_mm(x)})" if invert else _mm(x)


def _change(a: str, b: str, m: float) -> tuple[str, str]:
    return f"count({a}) OVER d > 0 AND count({b}) OVER d > 0", _mm(f"least(greatest(coalesce({a},0.0::DOUBLE)-coalesce({b},0.0::DOUBLE),{-m}::DOUBLE),{m}::DOUBLE)")


def _mean(parts: list[tuple[str, str]]) -> str:
    total = "+".join(f"(CASE WHEN {t} THEN {c} ELSE 0 END)" for t, c in parts)
    n = "+".join(f"(CASE WHEN {t} THEN 1 ELSE 0 END)" for t, _ in parts)
    return f"coalesce(({total})/nullif({n},0),0.5::DOUBLE)"


_Q = [_comp("roe"), _comp("roic"), _comp("roa"), ("count(net_debt_to_ebitda) OVER d > 0 OR count(debt_to_equity) OVER d > 0", f"(CASE WHEN count(net_debt_to_ebitda) OVER d > 0 THEN {_comp('net_debt_to_ebitda', True)[1]} ELSE {_comp('debt_to_equity', True)[1]} END)"), _comp("rd_to_revenue", clip=(0.0, 0.4))]
_has = lambda c: f"count({c}) OVER d > 0"
SIGNAL_SQL = {
    "piotroski_f": "(" + "+".join(f"(CASE WHEN {t} AND {c} THEN 1.0::DOUBLE ELSE 0 END)" for t, c in [
        (_has("roa"), "coalesce(roa,0)>0"), (f"{_has('roic')} AND {_has('roa')}", "coalesce(roic,0)>coalesce(roa,0)"), (_has("fcf_yield"), "coalesce(fcf_yield,0)>0"), (_has("earnings_yield"), "coalesce(earnings_yield,0)>0"),
        (_has("current_ratio"), "coalesce(current_ratio,0)>1"), (_has("net_debt_to_ebitda"), "coalesce(net_debt_to_ebitda,5)<2"), (_has("roe"), "coalesce(roe,0)>median(coalesce(roe,0)) OVER d"),
        (f"{_has('gross_margin_current')} AND {_has('gross_margin_prior')}", "coalesce(gross_margin_current,0)>coalesce(gross_margin_prior,0)")]) + ")/8",
    "momentum_12m": "CASE WHEN count(momentum_12m_return) OVER d>0 THEN coalesce(momentum_12m_return,0) WHEN count(revenue_growth) OVER d>0 THEN revenue_growth WHEN stddev_samp(close) OVER d=0 OR stddev_samp(close) OVER d IS NULL THEN 0 ELSE (close-avg(close) OVER d)/stddev_samp(close) OVER d END",
    "low_leverage_growth": _mean([_comp("momentum_12m_return"), _comp("net_debt_to_ebitda", True), _comp("fcf_yield"), _comp("capex_to_revenue", True, (0.0, 0.5))]),
    "quality_score": _mean([*_Q, _comp("earnings_stability", fill=0.5)]),
    "margin_expansion": _mean([_change("gross_margin_current", "gross_margin_prior", 0.2), _change("op_margin_current", "op_margin_prior", 0.2), _change("sga_to_revenue_prior", "sga_to_revenue", 0.15)]),
    "quality_midcap": _mean([*_Q, _comp("earnings_yield"), _comp("earnings_stability", fill=0.5)]),
    "quality_at_discount_midcap": _mean([_comp("gross_margin_current"), _comp("momentum_12m_return", True), _comp("fcf_yield"), _comp("net_debt_to_ebitda", True)]),
}


def scores_sql(weights: dict[str, float], source: str = "kept", name: str = "scored") -> str:
    total = sum(weights.values())
    raw = f"sig_{name} AS (SELECT *, " + ", ".join(f"{SIGNAL_SQL[s]} AS s_{s}" for s in weights) + f" FROM {source} WINDOW d AS (PARTITION BY as_of))"
    win = f"win_{name} AS (SELECT *, " + ", ".join(f"CASE WHEN s_{s} IS NULL THEN NULL WHEN stddev_samp(s_{s}) OVER d IS NULL OR stddev_samp(s_{s}) OVER d=0 THEN s_{s} ELSE least(greatest(s_{s}, avg(s_{s}) OVER d-3*stddev_samp(s_{s}) OVER d), avg(s_{s}) OVER d+3*stddev_samp(s_{s}) OVER d) END AS w_{s}" for s in weights) + f" FROM sig_{name} WINDOW d AS (PARTITION BY as_of))"
    z = f"z0_{name} AS (SELECT *, " + ", ".join(f"coalesce(CASE WHEN stddev_samp(w_{s}) OVER d IS NULL OR stddev_samp(w_{s}) OVER d=0 THEN 0.0::DOUBLE ELSE (w_{s}-avg(w_{s}) OVER d)/stddev_samp(w_{s}) OVER d END,0) AS z_{s}" for s in weights) + f" FROM win_{name} WINDOW d AS (PARTITION BY as_of))"
    comp = f"{name} AS (SELECT *, round(" + "+".join(f"z_{s}*{v / total!r}::DOUBLE" for s, v in weights.items()) + f",9) AS composite_score FROM z0_{name})"
    return ",\n".join([raw, win, z, comp])


SCORED = scores_sql(BASE.signals)
TOP = "top AS (SELECT *, row_number() OVER (PARTITION BY as_of ORDER BY composite_score DESC, ticker) AS rank FROM scored QUALIFY rank<=10)"
INVERSE = """wts AS (SELECT *, coalesce(f/nullif(sum(f) OVER d,0), 1.0::DOUBLE/count(*) OVER d) AS target_weight FROM
 (SELECT *, coalesce(inv, median(inv) OVER (PARTITION BY as_of)) AS f FROM (SELECT *, CASE WHEN realized_vol_20d>0 THEN 1/realized_vol_20d END AS inv FROM top)) WINDOW d AS (PARTITION BY as_of))"""
EQUAL = "wts AS (SELECT *, 1.0::DOUBLE/count(*) OVER (PARTITION BY as_of) AS target_weight FROM top)"
PANEL = (BARS, SECTORS, FACTS, CAL, LONG, WIDE, ROLLED, FRAME, FILTERED, SCORED, TOP)
RETS = """inside AS (SELECT c.as_of, c.next_as_of, b.ticker, arg_min(close,date) AS start_price, arg_max(close,date) AS last_within, min(low) AS min_low FROM bars b JOIN cal c ON b.date>=c.as_of AND b.date<c.next_as_of GROUP BY ALL),
 ends AS (SELECT c.next_as_of, b.ticker, arg_min(close,date) AS boundary FROM bars b JOIN cal c ON b.date>=c.next_as_of GROUP BY ALL),
 rets AS (SELECT i.*, coalesce(boundary,last_within) AS end_price, coalesce(boundary,last_within)/nullif(start_price,0)-1 AS ret, last_within/nullif(start_price,0)-1 AS within_ret FROM inside i LEFT JOIN ends e USING (next_as_of, ticker))"""


def rounded(df, *cols, digits: int = 6):
    return df.withColumns({c: F.round(c, digits) for c in cols})


def frame(spark, sf_dir, dates=DATES):
    """What a screen sees at every date: the members that trade then, and nothing of names that left or came later."""
    return frame_of(spark, sf_dir, market(spark, sf_dir, dates, periods=False), dates)


def market(spark, sf_dir, dates=DATES, periods=True):
    """The market at every date, written once: bars are made and sorted once for the frame, the universe and the returns."""
    return compiled(rolling.market(domain.bars(spark, sf_dir, None if periods else max(dates)), dates, periods=periods), "market")


def frame_of(spark, sf_dir, m, dates=DATES, facts=None):
    """frame where the market, and perhaps what is known, is made already."""
    members = asof.universe_of(domain.membership(spark, sf_dir), rolling.of_market(m)[1], dates)
    return framed_by(spark, sf_dir, facts or known(spark, sf_dir, dates), m, members)


def framed_by(spark, sf_dir, facts, m, names):
    """What is known of the names (as_of, ticker), with their features and sectors."""
    return screen.with_market(facts.join(names, ["as_of", "ticker"], "left_semi"), rolling.of_market(m)[0], domain.sectors(spark, sf_dir))


def known(spark, sf_dir, dates=DATES, fields=FIELDS):
    """(as_of, ticker, fields) of the filings that were public at every date; what came later is not read."""
    return facts.filings_known(domain.statements(spark, sf_dir, max(dates)), dates, fields, domain.parts(spark, sf_dir))


def returns(spark, sf_dir, dates=DATES):
    return rolling.period_returns(domain.bars(spark, sf_dir), dates)


@query("b01_rebalance_calendars", using(CAL, BARS, query="""SELECT *, CASE frequency WHEN 'weekly' THEN 52 WHEN 'quarterly' THEN 4 ELSE 12 END AS ppy FROM (SELECT 'monthly' AS frequency, c.as_of, c.next_as_of, count(b.date) AS bars FROM cal c LEFT JOIN bars b ON b.date=c.as_of GROUP BY ALL
 UNION ALL SELECT 'weekly', w.as_of, w.next_as_of, count(b.date) FROM (SELECT CAST(d AS DATE) AS as_of, lead(CAST(d AS DATE)) OVER (ORDER BY d) AS next_as_of FROM generate_series(DATE '1997-01-06', DATE '2001-11-01', INTERVAL 7 DAY) g(d)) w LEFT JOIN bars b ON b.date=w.as_of GROUP BY ALL
 UNION ALL SELECT 'quarterly', w.as_of, w.next_as_of, count(b.date) FROM (SELECT CAST(d AS DATE) AS as_of, lead(CAST(d AS DATE)) OVER (ORDER BY d) AS next_as_of FROM generate_series(DATE '1997-01-01', DATE '2001-11-01', INTERVAL 3 MONTH) g(d)) w LEFT JOIN bars b ON b.date=w.as_of GROUP BY ALL)"""))
def calendars(spark, sf_dir):
    """Rebalance dates of each frequency with the number of bars on the day and the periods of a year."""
    n = domain.bars(spark, sf_dir).groupBy(F.col("date").alias("as_of")).agg(F.count(F.lit(1)).alias("bars"))
    out = None
    for f in ("monthly", "weekly", "quarterly"):
        c = calendar.calendar(spark, START, END, f).select(F.lit(f).alias("frequency"), "as_of", "next_as_of")
        out = c if out is None else out.unionByName(c)
    return out.join(n, "as_of", "left").withColumns({"bars": F.coalesce("bars", F.lit(0)), "ppy": periods_per_year(F.col("frequency"))})


@query("j01_facts_as_of", using(FACTS, CAL, LONG, query="SELECT as_of, ticker, field, round(value,6) AS value, report_date FROM known"))
def facts_as_of(spark, sf_dir):
    return rounded(asof.facts_as_of(all_facts(spark, sf_dir), DATES), "value")


@query("j01_facts_as_of_one_date", using(FACTS, ONE_CAL, LONG, MEMBERSHIP, query="SELECT m.ticker, max(round(value,6)) FILTER (field='roe') AS roe, max(round(value,6)) FILTER (field='market_cap') AS market_cap FROM (SELECT DISTINCT ticker FROM membership) m LEFT JOIN known k ON k.ticker=m.ticker GROUP BY m.ticker"))
def facts_as_of_one(spark, sf_dir):
    who = domain.membership(spark, sf_dir).select("ticker").distinct()
    return rounded(asof.facts_as_of_one(all_facts(spark, sf_dir), who, ["roe", "market_cap"], ONE), "roe", "market_cap")


_MEMBERS = "mem AS (SELECT DISTINCT c.as_of, m.ticker FROM cal c JOIN membership m ON m.added_date<=c.as_of AND (m.removed_date IS NULL OR m.removed_date<=m.added_date OR m.removed_date>c.as_of) {})"


@query("j02_members_as_of", using(MEMBERSHIP, CAL, _MEMBERS.format(""), query="SELECT * FROM mem"))
def members_as_of(spark, sf_dir):
    return asof.members_as_of(domain.membership(spark, sf_dir), DATES)


@query("a07_tradeable_as_of", using(BARS, CAL, TRADEABLE, query="SELECT * FROM trd"))
def tradeable_as_of(spark, sf_dir):
    return asof.tradeable_as_of(domain.bars(spark, sf_dir), DATES)


@query("j03_universe_as_of", using(BARS, MEMBERSHIP, CAL, _MEMBERS.format("WHERE index_name='ASIA'"), TRADEABLE, query="""SELECT as_of, ticker FROM (SELECT as_of, ticker, m.ticker IS NOT NULL AS im, t.ticker IS NOT NULL AS it, count(m.ticker) OVER d>0 AS am, count(t.ticker) OVER d>0 AS atr
 FROM mem m FULL JOIN trd t USING (as_of, ticker) WINDOW d AS (PARTITION BY as_of)) WHERE (im OR NOT am) AND (it OR NOT atr)"""))
def universe_as_of(spark, sf_dir):
    return screen.index_universe(domain.membership(spark, sf_dir), "ASIA", domain.bars(spark, sf_dir), DATES)


@query("a01_a05_features_as_of", using(BARS, CAL, ROLLED, query="SELECT as_of, ticker, close, n_days, round(avg_volume_20d,6) AS avg_volume_20d, round(sma_200,9) AS sma_200, round(momentum_12m_return,6) AS momentum_12m_return, round(realized_vol_20d,6) AS realized_vol_20d, round(trailing_return,6) AS trailing_return FROM feat"))
def features_as_of(spark, sf_dir):
    return rounded(rounded(rolling.features_as_of(domain.bars(spark, sf_dir), DATES), "sma_200", digits=9), "avg_volume_20d", "momentum_12m_return", "realized_vol_20d", "trailing_return")


@query("b15_features_in_loaded_window", using(BARS.replace("bars AS", "bars0 AS"), "bars AS (SELECT * FROM bars0 WHERE date>=DATE '1999-04-28')", ONE_CAL, ROLLED, query="SELECT as_of, ticker, close, n_days, round(sma_200,9) AS sma_200, round(momentum_12m_return,6) AS momentum_12m_return FROM feat"))
def features_in_loaded_window(spark, sf_dir):
    f = rolling.features_as_of(domain.bars(spark, sf_dir), [ONE], load_from=date(1999, 4, 28))
    return rounded(rounded(f, "sma_200", digits=9), "momentum_12m_return").select("as_of", "ticker", "close", "n_days", "sma_200", "momentum_12m_return")


@query("b02_screening_frame", using(*PANEL[:8], query="SELECT as_of, ticker, sector, close, n_days, round(roe,6) AS roe, round(market_cap,6) AS market_cap, round(fcf_yield,6) AS fcf_yield, round(gross_margin_prior,6) AS gross_margin_prior, round(rev_growth_current,6) AS rev_growth_current, round(realized_vol_20d,6) AS realized_vol_20d FROM frame"))
def screening_frame(spark, sf_dir):
    """The frame from a long table of facts, as a fact log gives it; the other queries keep filings wide."""
    nums = ["roe", "market_cap", "fcf_yield", "gross_margin_prior", "rev_growth_current", "realized_vol_20d"]
    bars = domain.bars(spark, sf_dir)
    members = asof.universe_as_of(domain.membership(spark, sf_dir), bars, DATES)
    f = screen.screening_frame(all_facts(spark, sf_dir), bars, domain.sectors(spark, sf_dir), DATES, members, parts=domain.parts(spark, sf_dir))
    return rounded(f, *nums).select("as_of", "ticker", "sector", "close", "n_days", *nums)


@query("f01_f05_filter_chain", using(*PANEL[:8], query="""SELECT as_of, step, filter, before, after, before-after AS removed FROM (SELECT as_of, unnest([1,2,3,4]) AS step, unnest(['momentum_cap','market_cap','volume','low_volatility']) AS filter, unnest([n0,n1,n2,n3]) AS before, unnest([n1,n2,n3,n4]) AS after FROM
 (SELECT as_of, count(*) AS n0, count(*) FILTER (a) AS n1, count(*) FILTER (a AND b) AS n2, count(*) FILTER (a AND b AND c) AS n3, count(*) FILTER (a AND b AND c AND d) AS n4 FROM
 (SELECT as_of, momentum_12m_return IS NULL OR momentum_12m_return<=0.02 AS a, market_cap>=4e6 AS b, avg_volume_20d>=25 AS c, coalesce(realized_vol_20d,1.0::DOUBLE)>=2.0 AS d FROM frame) GROUP BY as_of))"""))
def filter_chain(spark, sf_dir):
    chain = [("momentum_cap", {"cap": 0.02}), ("market_cap", {"min_cap": 4e6}), ("volume", {"min_avg_volume": 25.0}), ("low_volatility", {"min_vol": 2.0})]
    return signals.filter_counts(frame(spark, sf_dir), chain)


@query("g01_g07_signals", using(*PANEL[:9], "sig AS (SELECT as_of, ticker, " + ", ".join(f"round({SIGNAL_SQL[s]},6) AS {s}" for s in ALL_SIGNALS) + " FROM kept WINDOW d AS (PARTITION BY as_of))", query="SELECT * FROM sig"))
def all_signals(spark, sf_dir):
    kept = signals.apply_filters(frame(spark, sf_dir), BASE.chain())
    return rounded(signals.with_signals(kept, ALL_SIGNALS), *ALL_SIGNALS).select("as_of", "ticker", *ALL_SIGNALS)


@query("h05_h07_scores", using(*PANEL[:10], query="SELECT as_of, ticker, z_momentum_12m, z_quality_score, composite_score FROM scored"))
def composite_scores(spark, sf_dir):
    s = screen.scored(frame(spark, sf_dir), BASE)
    return s.select("as_of", "ticker", "z_momentum_12m", "z_quality_score", "composite_score")


@query("h05_winsorized_volumes", using(BARS, query="""SELECT as_of, ticker, round(coalesce(CASE WHEN stddev_samp(w) OVER d IS NULL OR stddev_samp(w) OVER d=0 THEN 0 ELSE -(w-avg(w) OVER d)/stddev_samp(w) OVER d END,0),6) AS z_volume FROM
 (SELECT *, CASE WHEN volume IS NULL THEN NULL WHEN stddev_samp(volume) OVER d IS NULL OR stddev_samp(volume) OVER d=0 THEN volume ELSE least(greatest(volume,avg(volume) OVER d-3*stddev_samp(volume) OVER d),avg(volume) OVER d+3*stddev_samp(volume) OVER d) END AS w FROM (SELECT date AS as_of, ticker, CASE WHEN CAST(ticker AS BIGINT)%17<>0 THEN volume END AS volume FROM bars) WINDOW d AS (PARTITION BY as_of)) WINDOW d AS (PARTITION BY as_of)"""))
def winsorized_volumes(spark, sf_dir):
    """Lower-is-better z-scores of every trading day's volumes, with nulls among them."""
    b = domain.bars(spark, sf_dir).select(F.col("date").alias("as_of"), "ticker", F.when(F.col("ticker").cast("long") % 17 != 0, F.col("volume")).alias("volume"))
    return rounded(zscores(b, {"volume": False}), "z_volume").select("as_of", "ticker", "z_volume")


@query("b03_screen_all_dates", using(*PANEL, EQUAL, query="SELECT as_of, ticker, rank, composite_score, round(target_weight,6) AS target_weight FROM wts"))
def screen_all_dates(spark, sf_dir):
    return rounded(screen.screen(frame(spark, sf_dir), BASE), "target_weight").select("as_of", "ticker", "rank", "composite_score", "target_weight")


def _through(spark, sf_dir, kind):
    """The picks of all dates, through files of a kind and back."""
    rows = screen_all_dates(spark, sf_dir)
    at = scratch(spark, f"ranked-{kind}")
    sinks.put(rows, at, kind, ["as_of", "rank"])
    return sinks.get(rows, at, kind)


_RANKED = using(*PANEL, EQUAL, query="SELECT as_of, ticker, rank, composite_score, round(target_weight,6) AS target_weight FROM wts")


@query("s15_json_sink", _RANKED)
def json_sink(spark, sf_dir):
    return _through(spark, sf_dir, "json")


@query("s16_csv_sink", _RANKED)
def csv_sink(spark, sf_dir):
    return _through(spark, sf_dir, "csv")


@query("v01_sql_over_stages", using(*PANEL, RETS, query="""SELECT p.sector, count(*) AS n, round(avg(t.composite_score),6) AS mean_score, round(avg(r.ret),6) AS mean_ret, round(max(p.roe),6) AS best_roe
 FROM top t JOIN frame p ON p.as_of=t.as_of AND p.ticker=t.ticker LEFT JOIN rets r ON r.as_of=t.as_of AND r.ticker=t.ticker GROUP BY p.sector"""))
def sql_over_stages(spark, sf_dir):
    """A user's statement over the stages of a screen, which are views by their names."""
    v = views.Views(spark, sf_dir, START, END, BASE)
    return v.sql("""SELECT p.sector, count(*) AS n, round(avg(t.composite_score), 6) AS mean_score, round(avg(r.ret), 6) AS mean_ret, round(max(p.roe), 6) AS best_roe
        FROM picks t JOIN panel p ON p.as_of = t.as_of AND p.ticker = t.ticker LEFT JOIN returns r ON r.as_of = t.as_of AND r.ticker = t.ticker GROUP BY p.sector""")


@query("b06_screen_inverse_vol", using(BARS, SECTORS, FACTS, ONE_CAL, LONG, WIDE, ROLLED, FRAME, FILTERED, SCORED, TOP, INVERSE, query="SELECT as_of, ticker, rank, composite_score, round(target_weight,6) AS target_weight FROM wts"))
def screen_inverse_vol(spark, sf_dir):
    """The flagship: one cross-section, ranked and weighted by inverse volatility."""
    s = screen.screen(frame(spark, sf_dir, [ONE]), Spec(weighting="inverse_vol"))
    return rounded(s, "target_weight").select("as_of", "ticker", "rank", "composite_score", "target_weight")


@query("k02_sector_capped_top_n", using(*PANEL[:10], query="""SELECT as_of, ticker, sector, rank FROM (SELECT *, row_number() OVER (PARTITION BY as_of ORDER BY composite_score DESC, ticker) AS rank FROM
 (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY as_of, coalesce(sector,'__unknown__') ORDER BY composite_score DESC, ticker)<=1)) WHERE rank<=8"""))
def sector_capped(spark, sf_dir):
    return portfolio.top_n(screen.scored(frame(spark, sf_dir), BASE), 8, 1).select("as_of", "ticker", "sector", "rank")


@query("s17_result_view", using(BARS, SECTORS, FACTS, ONE_CAL, LONG, WIDE, ROLLED, FRAME, FILTERED, SCORED, TOP, EQUAL, query="SELECT as_of, ticker, composite_score, round(target_weight,6) AS target_weight, z_momentum_12m, z_quality_score FROM wts ORDER BY wts.composite_score DESC, ticker LIMIT 5"))
def result_view(spark, sf_dir):
    v = screen.view(screen.screen(frame(spark, sf_dir, [ONE]), BASE), 5)
    return rounded(v, "target_weight")


@query("k07_candidates", using(*PANEL[:10], "many AS (SELECT *, row_number() OVER (PARTITION BY as_of ORDER BY composite_score DESC, ticker) AS rank FROM scored QUALIFY rank<=50)", query="SELECT as_of, ticker, rank, composite_score, round(1.0::DOUBLE/count(*) OVER (PARTITION BY as_of),6) AS target_weight FROM many"))
def candidates(spark, sf_dir):
    """The wider screen of a live account that wants ten names."""
    c = screen.candidates(frame(spark, sf_dir), BASE)
    return rounded(c, "target_weight").select("as_of", "ticker", "rank", "composite_score", "target_weight")


@query("p02_python_signal", using(*PANEL[:9], query="SELECT as_of, ticker, round(percent_rank() OVER (PARTITION BY as_of ORDER BY coalesce(roe,0)),6) AS roe_rank FROM kept"))
def python_signal(spark, sf_dir):
    """A signal in Python over one date's frame: the share of the other names with a lower return on equity."""
    kept = signals.apply_filters(frame(spark, sf_dir), BASE.chain()).select("as_of", "ticker", "roe")
    share = lambda p: (p["roe"].fillna(0.0).rank(method="min") - 1) / max(1, len(p) - 1)
    return rounded(signals.python_signal(kept, "roe_rank", share), "roe_rank").drop("roe")


@query("j07_first_on_or_after", using(BARS, CAL, query="SELECT b.ticker, c.as_of, min(b.date) AS date, arg_min(close,date) AS close FROM bars b JOIN cal c ON b.date>=c.as_of GROUP BY ALL"))
def first_on_or_after(spark, sf_dir):
    return asof.first_on_or_after(domain.bars(spark, sf_dir).select("ticker", "date", "close"), DATES, ["ticker"])


@query("a08_period_returns", using(BARS, CAL, RETS, query="SELECT as_of, next_as_of, ticker, start_price, min_low, end_price, round(ret,6) AS ret, round(within_ret,6) AS within_ret FROM rets"))
def period_returns(spark, sf_dir):
    return rounded(returns(spark, sf_dir), "ret", "within_ret").drop("last_within")


_TURN = """pw AS (SELECT w.as_of, w.ticker, w.target_weight AS w, c.next_as_of FROM wts w JOIN cal c USING (as_of)),
 ch AS (SELECT coalesce(n.as_of,p.next_as_of) AS as_of, n.w, p.w AS pw FROM pw n FULL JOIN (SELECT * FROM pw WHERE next_as_of IS NOT NULL) p ON p.next_as_of=n.as_of AND p.ticker=n.ticker),
 tv AS (SELECT as_of, count(w) AS n, count(*) FILTER (w IS NULL OR pw IS NULL) AS symdiff, CASE WHEN count(pw)=0 THEN 1.0::DOUBLE ELSE (count(*) FILTER (w IS NULL OR pw IS NULL))::DOUBLE/count(w) END AS traded,
  CASE WHEN count(pw)=0 THEN 0 ELSE count(*) FILTER (w IS NULL OR pw IS NULL)//2 END AS swaps, coalesce(sum(CASE WHEN abs(w-pw)>0.05*w THEN abs(w-pw) END),0) AS drift FROM ch GROUP BY 1 HAVING count(w)>0)"""


@query("b07_b08_turnover_and_drift", using(*PANEL, INVERSE, _TURN, query="SELECT as_of, n, symdiff, round(traded,6) AS traded, swaps, round(drift,6) AS drift, round((traded+drift)*10/10000,8) AS cost FROM tv"))
def turnover(spark, sf_dir):
    t = portfolio.turnover(screen.screen(frame(spark, sf_dir), Spec(weighting="inverse_vol")), calendar.calendar(spark, START, END), 10.0)
    return rounded(rounded(t, "traded", "drift"), "cost", digits=8).drop("n_before")


@query("a10_a11_portfolio_returns", using(*PANEL, INVERSE, RETS, query="""SELECT as_of, count(*) AS n, count(ret) AS priced, count(*) FILTER (coalesce(min_low<start_price*0.85,false)) AS stopped, round(sum(target_weight*CASE WHEN coalesce(min_low<start_price*0.85,false) THEN -0.15 ELSE coalesce(ret,0) END),6) AS gross FROM wts LEFT JOIN rets USING (as_of, ticker) GROUP BY as_of"""))
def portfolio_returns(spark, sf_dir):
    """Weighted period returns with a position stop of 15 %."""
    m = market(spark, sf_dir)
    p = portfolio.portfolio_returns(screen.screen(frame_of(spark, sf_dir, m), Spec(weighting="inverse_vol")), rolling.market_periods(m), stop=0.15)
    return rounded(p, "gross")


@query("a12_market_returns", using(BARS, CAL, RETS, query="SELECT as_of, round(avg(within_ret),6) AS mkt, count(*) AS n FROM rets GROUP BY as_of"))
def market_returns(spark, sf_dir):
    return rounded(returns(spark, sf_dir).groupBy("as_of").agg(F.avg("within_ret").alias("mkt"), F.count(F.lit(1)).alias("n")), "mkt")


@query("a35_monthly_returns", using(BARS, query="SELECT ticker, CAST(date_trunc('month',date) AS DATE) AS month, round(arg_max(close,date)/arg_min(close,date)-1,6) AS ret, count(*) AS n FROM bars GROUP BY ALL"))
def monthly_returns(spark, sf_dir):
    g = domain.bars(spark, sf_dir).groupBy("ticker", F.trunc("date", "month").alias("month"))
    return rounded(g.agg((F.try_divide(F.max_by("close", "date"), F.min_by("close", "date")) - 1).alias("ret"), F.count(F.lit(1)).alias("n")), "ret")


@query("a37_year_month_matrix", using(BARS, query="SELECT ticker, year(date) AS year, " + ", ".join(f"round(arg_max(close,date) FILTER (month(date)={m})/arg_min(close,date) FILTER (month(date)={m})-1,6) AS m{m}" for m in range(1, 13)) + " FROM bars GROUP BY ALL"))
def year_month_matrix(spark, sf_dir):
    r = monthly_returns(spark, sf_dir).withColumn("k", F.month("month"))
    return r.groupBy("ticker", F.year("month").alias("year")).agg(*(F.max(F.when(F.col("k") == k, F.col("ret"))).alias(f"m{k}") for k in range(1, 13)))


@query("a38_holdings_timeline", using(*PANEL, """most AS (SELECT ticker, count(*) AS k FROM top GROUP BY ticker ORDER BY k DESC, ticker LIMIT 20)""", query="SELECT m.ticker, c.as_of, CASE WHEN t.ticker IS NULL THEN 0 ELSE 1 END AS held FROM most m CROSS JOIN (SELECT DISTINCT as_of FROM cal) c LEFT JOIN top t ON t.ticker=m.ticker AND t.as_of=c.as_of"))
def holdings_timeline(spark, sf_dir):
    """The twenty names held most often against every date."""
    p = screen.screen(frame(spark, sf_dir), BASE).select("as_of", "ticker")
    most = p.groupBy("ticker").count().orderBy(F.desc("count"), "ticker").limit(20).select("ticker")
    grid = most.withColumn("as_of", F.explode(calendar.literal(DATES)))
    return grid.join(p.withColumn("held", F.lit(1)), ["as_of", "ticker"], "left").withColumn("held", F.coalesce("held", F.lit(0)))

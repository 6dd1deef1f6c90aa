"""Queries of backtests, risk statistics, attribution and resampling."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from equiscope.functions import scalar
from equiscope.operators import asof, calendar, metrics, portfolio, resample, rolling
from equiscope.plans import backtest, evaluate, research, screen
from equiscope.plans.catalog import query
from equiscope.plans.queries_panel import CAL, DATES, END, EQUAL, FRAMED, INVERSE, PANEL, RETS, START, TRADEABLE, UNIVERSE, frame, frame_of, framed_by, known, market, returns, rounded, scores_sql
from equiscope.plans.screen import Spec
from equiscope.sources import domain
from equiscope.sources.domain_sql import BARS, BENCHMARK, MEMBERSHIP, using
from equiscope.sources.schemas import RESEARCH_LOG
from equiscope.sources.stage import compiled, scratch
from equiscope.sources.versioned import Versioned

VARIANTS = [
    Spec("equal"), Spec("inverse_vol", weighting="inverse_vol"), Spec("value", signals={"low_leverage_growth": 0.5, "quality_midcap": 0.5}, top_n=5),
    Spec("capped", max_per_sector=1, top_n=6), Spec("margins", signals={"margin_expansion": 1.0}, top_n=5, momentum_cap=0.05),
]
FEEDBACK = [Spec("bonus", hold_bonus=0.5), Spec("bonus_inverse", hold_bonus=0.3, weighting="inverse_vol", max_per_sector=2), Spec("stops", position_stop_loss=0.1, portfolio_stop_loss=0.02), Spec("all", hold_bonus=0.5, position_stop_loss=0.12, portfolio_stop_loss=0.03)]


def _picks_sql(v: Spec) -> str:
    """(strategy_id, as_of, ticker, target_weight) of one variant, as CTEs named after it."""
    n = v.name
    kept = f"kept_{n} AS (SELECT * FROM kept{f' WHERE momentum_12m_return IS NULL OR momentum_12m_return<={v.momentum_cap}' if v.momentum_cap else ''})"
    sc = scores_sql(v.signals, f"kept_{n}", f"sc_{n}")
    src = f"(SELECT * FROM sc_{n} QUALIFY row_number() OVER (PARTITION BY as_of, coalesce(sector,'__unknown__') ORDER BY composite_score DESC, ticker)<={v.max_per_sector})" if v.max_per_sector else f"sc_{n}"
    top = f"top_{n} AS (SELECT * FROM {src} QUALIFY row_number() OVER (PARTITION BY as_of ORDER BY composite_score DESC, ticker)<={v.top_n})"
    w = (EQUAL if v.weighting == "equal" else INVERSE).replace("wts AS", f"wts_{n} AS").replace("FROM top", f"FROM top_{n}")
    return ",\n".join([kept, sc, top, w])


_BT = (
    *PANEL[:9], *(_picks_sql(v) for v in VARIANTS),
    "pk AS (" + " UNION ALL ".join(f"SELECT '{v.name}' AS strategy_id, {str(v.weighting != 'equal').lower()} AS drifts, as_of, ticker, target_weight AS w FROM wts_{v.name} WHERE as_of < DATE '2001-11-01'" for v in VARIANTS) + ")",
    RETS,
    "gr AS (SELECT strategy_id, as_of, count(*) AS n, sum(w*coalesce(ret,0)) AS gross FROM pk LEFT JOIN rets USING (as_of, ticker) GROUP BY ALL)",
    "prv AS (SELECT strategy_id, next_as_of AS as_of, ticker, w AS pw FROM pk JOIN cal USING (as_of))",
    "mv AS (SELECT strategy_id, as_of, count(w) AS n, count(pw) AS np, count(*) FILTER (w IS NULL OR pw IS NULL) AS sd, coalesce(sum(CASE WHEN drifts AND abs(w-pw)>0.05*w THEN abs(w-pw) END),0) AS drift FROM pk FULL JOIN prv USING (strategy_id, as_of, ticker) GROUP BY ALL HAVING count(w)>0)",
    "strat AS (" + " UNION ALL ".join(f"SELECT '{v.name}' AS strategy_id" for v in VARIANTS) + ")",
    """bt AS (SELECT s.strategy_id, c.t, c.as_of, coalesce(gross-((CASE WHEN np=0 THEN 1.0::DOUBLE ELSE sd::DOUBLE/m.n END)+drift)*10.0::DOUBLE/10000,0) AS ret, coalesce(g.n,0) AS n, coalesce(CASE WHEN np=0 THEN 0 ELSE sd//2 END,0) AS swaps,
  coalesce(((CASE WHEN np=0 THEN 1.0::DOUBLE ELSE sd::DOUBLE/m.n END)+drift)*10.0::DOUBLE/10000,0) AS cost
  FROM strat s CROSS JOIN (SELECT * FROM cal WHERE next_as_of IS NOT NULL) c LEFT JOIN gr g ON g.strategy_id=s.strategy_id AND g.as_of=c.as_of LEFT JOIN mv m ON m.strategy_id=s.strategy_id AND m.as_of=c.as_of)""",
)


YEARS = backtest.years_between(START, END)


def panel_and_periods(spark, sf_dir, m=None, facts=None):
    """(the frame, the period returns) of one market. The frame is written once, as each filter chain reads it."""
    m = m or market(spark, sf_dir)
    return compiled(frame_of(spark, sf_dir, m, facts=facts), "frame"), rolling.market_periods(m)


def all_returns(spark, sf_dir, m=None, facts=None):
    """Period returns of the variants, written once, as statistics read them."""
    panel, rets = panel_and_periods(spark, sf_dir, m, facts)
    return compiled(backtest.without_feedback(panel, rets, DATES, VARIANTS), "returns")


@query("b12_backtest_without_feedback", using(*_BT, query="SELECT strategy_id, t, as_of, round(ret,6) AS ret, n, swaps, round(cost,8) AS cost FROM bt"))
def backtest_without_feedback(spark, sf_dir):
    return rounded(rounded(all_returns(spark, sf_dir), "ret"), "cost", digits=8)


def _span_sql(spans: list[backtest.Span]) -> str:
    """win: the first and the last-but-one period of each run, by the number of its first date."""
    rows = " UNION ALL ".join(f"SELECT '{name}' AS run, DATE '{a}' AS a, DATE '{b}' AS b" for name, a, b in spans)
    return f"win AS (SELECT run, x.t AS t0, y.t AS t1 FROM ({rows}) s JOIN cal x ON x.as_of=s.a JOIN cal y ON y.as_of=s.b)"


def _fold_sql(v: Spec) -> str:
    """The runs of one strategy as a recursive query: a row per run and period carries what is held, its weights and the last return."""
    n, cap = v.name, v.max_per_sector
    near = f"""SELECT s.run, p.t, p.as_of, p.ticker, p.realized_vol_20d AS vol, p.ret, p.min_low, p.start_price, p.sector, s.held, s.weights,
    p.composite_score+CASE WHEN list_contains(s.held, p.ticker) THEN {v.hold_bonus!r}::DOUBLE ELSE 0 END AS s
   FROM st_{n} s JOIN win w ON w.run=s.run JOIN cand_{n} p ON p.t=s.t+1 AND p.t<w.t1
   WHERE NOT ({v.portfolio_stop_loss!r}>0 AND s.t>=w.t0 AND s.ret < -{v.portfolio_stop_loss!r}::DOUBLE)"""
    capped = f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY run, coalesce(sector,'__unknown__') ORDER BY s DESC, ticker) AS ks FROM ({near})) WHERE {cap}=0 OR ks<={cap}"
    top = f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY run ORDER BY s DESC, ticker) AS k FROM ({capped})) WHERE k<={v.top_n}"
    each = "OVER (PARTITION BY run)"
    weight = f"1.0::DOUBLE/count(*) {each}" if v.weighting == "equal" else f"coalesce(f/nullif(sum(f) {each},0), 1.0::DOUBLE/count(*) {each})"
    inverse = "CASE WHEN vol>0 THEN 1/vol END"
    now = f"""SELECT *, {weight} AS w FROM (SELECT *, coalesce({inverse}, median({inverse}) {each}) AS f,
    coalesce({v.position_stop_loss!r}>0 AND min_low<start_price*(1-{v.position_stop_loss!r}::DOUBLE),false) AS hit FROM ({top}))"""
    moved = "abs(w-coalesce(weights[ticker],0))"
    drift = "0" if v.weighting == "equal" else f"coalesce(sum(CASE WHEN list_contains(held,ticker) AND len(map_keys(weights))>0 AND {moved}>0.05::DOUBLE*w THEN {moved} END),0)"
    rate = f"({v.cost_bps!r}::DOUBLE/10000)"
    one = f"""SELECT run, t, as_of, count(*) AS n, count(ret) AS priced, sum(w*CASE WHEN hit THEN -{v.position_stop_loss!r}::DOUBLE ELSE coalesce(ret,0) END) AS gross,
    count(*) FILTER (hit) AS stopped, list(ticker) FILTER (NOT hit) AS left_, list(ticker) AS all_, map_from_entries(list((ticker,w))) AS ws, {drift} AS drift,
    any_value(len(held)) AS nh, any_value(len(held))+count(*)-2*count(*) FILTER (list_contains(held,ticker)) AS sd FROM ({now}) GROUP BY run, t, as_of"""
    priced = f"SELECT *, priced>0 AS ok, ((CASE WHEN nh=0 THEN 1.0::DOUBLE ELSE sd::DOUBLE/n END)+drift)*{rate} AS c0, CASE WHEN nh=0 THEN 0 ELSE sd//2 END AS sw FROM ({one})"
    weights = "MAP {}::MAP(VARCHAR,DOUBLE)" if v.weighting == "equal" else "ws"
    return f"""cand_{n} AS (SELECT c.t, k.as_of, k.ticker, k.composite_score, k.sector, k.realized_vol_20d, r.ret, r.min_low, r.start_price
  FROM sc_{n} k JOIN cal c ON c.as_of=k.as_of AND c.next_as_of IS NOT NULL LEFT JOIN rets r ON r.as_of=k.as_of AND r.ticker=k.ticker),
 st_{n} AS (SELECT run, CAST(t0-1 AS INTEGER) AS t, CAST(NULL AS DATE) AS as_of, 0.0::DOUBLE AS ret, 0::BIGINT AS n, 0::BIGINT AS swaps, 0.0::DOUBLE AS cost, 0::BIGINT AS stopped, []::VARCHAR[] AS held, MAP {{}}::MAP(VARCHAR,DOUBLE) AS weights FROM win
  UNION ALL SELECT s.run, c.t, c.as_of, coalesce(CASE WHEN ok THEN gross-c0-x.stopped::DOUBLE/x.n*{rate} ELSE -c0 END,0.0::DOUBLE), coalesce(x.n,0)::BIGINT,
   coalesce(sw+CASE WHEN ok THEN x.stopped ELSE 0 END,0)::BIGINT, coalesce(c0+CASE WHEN ok THEN x.stopped::DOUBLE/x.n*{rate} ELSE 0 END,0.0::DOUBLE), coalesce(CASE WHEN ok THEN x.stopped END,0)::BIGINT,
   CASE WHEN x.t IS NULL THEN []::VARCHAR[] WHEN ok THEN coalesce(left_,[]::VARCHAR[]) ELSE all_ END, CASE WHEN x.t IS NULL THEN s.weights ELSE {weights} END
  FROM st_{n} s JOIN win w ON w.run=s.run JOIN cal c ON c.t=s.t+1 AND c.t<w.t1 LEFT JOIN ({priced}) x ON x.t=c.t AND x.run=s.run)"""


def _runs_sql(specs: list[Spec], spans: list[backtest.Span]) -> tuple[str, ...]:
    """runs (strategy_id, run, t, as_of, ret, n, swaps, cost, stopped): every strategy over every span, t from 0."""
    own = []
    for v in specs:
        cap = f" WHERE momentum_12m_return IS NULL OR momentum_12m_return<={v.momentum_cap}" if v.momentum_cap else ""
        own += [f"kept_{v.name} AS (SELECT * FROM kept{cap})", scores_sql(v.signals, f"kept_{v.name}", f"sc_{v.name}"), _fold_sql(v)]
    rows = " UNION ALL ".join(f"SELECT '{v.name}' AS strategy_id, run, (s.t-t0)::INTEGER AS t, as_of, ret, n, swaps, cost, stopped FROM st_{v.name} s JOIN win USING (run) WHERE s.t>=t0" for v in specs)
    return *PANEL[:9], RETS, _span_sql(spans), *own, f"runs AS ({rows})"


def recursive(sql: str) -> str:
    return sql.replace("WITH ", "WITH RECURSIVE ", 1)


_FOLD = _runs_sql(FEEDBACK, [("", START, DATES[-1])])


@query("b12_backtest_with_feedback", recursive(using(*_FOLD, query="SELECT strategy_id, t, as_of, round(ret,6) AS ret, n, swaps, round(cost,6) AS cost, stopped FROM runs")))
def backtest_with_feedback(spark, sf_dir):
    """Hold bonus, position and portfolio stops: a fold over the dates."""
    return rounded(backtest.with_feedback(*panel_and_periods(spark, sf_dir), DATES, FEEDBACK), "ret", "cost")


@query("b12_backtest_summary", recursive(using(*_FOLD,
 "ga AS (SELECT strategy_id, count(*) AS n, sum(swaps)::BIGINT AS swaps, avg(cost) AS mean_cost, CASE WHEN stddev_samp(ret)=0 THEN 0 ELSE avg(ret)/stddev_samp(ret)*sqrt(12.0::DOUBLE) END AS sharpe, exp(sum(ln(1+ret)))-1 AS total FROM runs GROUP BY strategy_id)",
 query=f"SELECT strategy_id, n, swaps, round(mean_cost,6) AS mean_cost, round(sharpe,6) AS sharpe, round(total,6) AS total_return, round(pow(1+total,1/{YEARS!r}::DOUBLE)-1,6) AS cagr FROM ga")))
def backtest_summary(spark, sf_dir):
    """The metric rows of one backtest call with strategies of both kinds."""
    r = compiled(backtest.backtest(*panel_and_periods(spark, sf_dir), DATES, [*FEEDBACK, VARIANTS[0]]), "returns")
    m = backtest.summary(r, START, END).filter(F.col("strategy_id") != VARIANTS[0].name)
    return rounded(m.select("strategy_id", "n", "swaps", "mean_cost", "sharpe", "total_return", "cagr"), "mean_cost", "sharpe", "total_return", "cagr")


def _poly(cs: tuple[float, ...], x: str) -> str:
    out = f"{cs[0]!r}::DOUBLE"
    for c in cs[1:]:
        out = f"({out}*{x}+({c!r}::DOUBLE))"
    return out


def cdf_sql(x: str) -> str:
    a = f"abs({x})"
    low = f"exp(-{a}*{a}/2)*{_poly(scalar.CDF_N, a)}/{_poly(scalar.CDF_D, a)}"
    return f"(CASE WHEN {x}>0 THEN 1-(CASE WHEN {a}>7 THEN 0 ELSE {low} END) ELSE (CASE WHEN {a}>7 THEN 0 ELSE {low} END) END)"


def ppf_sql(p: str) -> str:
    q, lo, hi = f"({p}-0.5::DOUBLE)", f"sqrt(-2*ln({p}))", f"sqrt(-2*ln(1-{p}))"
    return (f"(CASE WHEN {p}<={0} THEN -'inf'::DOUBLE WHEN {p}>=1 THEN 'inf'::DOUBLE WHEN {p}<{scalar.PPF_EDGE}::DOUBLE THEN {_poly(scalar.PPF_C, lo)}/{_poly(scalar.PPF_D, lo)} "
            f"WHEN {p}>1-{scalar.PPF_EDGE}::DOUBLE THEN -{_poly(scalar.PPF_C, hi)}/{_poly(scalar.PPF_D, hi)} ELSE {_poly(scalar.PPF_A, f'({q}*{q})')}*{q}/{_poly(scalar.PPF_B, f'({q}*{q})')} END)")  # fmt: skip


_EQ = "eq AS (SELECT *, greatest(1.0::DOUBLE, max(e) OVER (PARTITION BY strategy_id ORDER BY t)) AS pk FROM (SELECT *, exp(sum(ln(1+ret)) OVER (PARTITION BY strategy_id ORDER BY t)) AS e FROM bt))"
_MET = f"""m0 AS (SELECT strategy_id, count(*) AS n, avg(ret) AS mu, stddev_samp(ret) AS sd, arg_max(e,t)-1 AS total, min(e/pk-1) AS maxdd, avg(ret) AS mm, stddev_pop(ret) AS sp FROM eq GROUP BY strategy_id),
 m1 AS (SELECT m0.*, CASE WHEN sd IS NULL OR sd=0 THEN 0 ELSE mu/sd*sqrt(12.0::DOUBLE) END AS sharpe, CASE WHEN total<=-1 THEN 0 ELSE pow(1+total,1/{YEARS!r}::DOUBLE)-1 END AS cagr,
  (SELECT avg(pow((ret-m0.mm)/nullif(m0.sp,0),3)) FROM bt WHERE bt.strategy_id=m0.strategy_id) AS sk, (SELECT avg(pow((ret-m0.mm)/nullif(m0.sp,0),4)) FROM bt WHERE bt.strategy_id=m0.strategy_id) AS ku FROM m0),
 m2 AS (SELECT *, sharpe/sqrt(12.0::DOUBLE) AS sr, coalesce(sk,0) AS skew, coalesce(ku,3) AS kurt FROM m1),
 m3 AS (SELECT *, sqrt(greatest(1-skew*sr+(kurt-1)/4*sr*sr,0)/greatest(n-1,1)) AS se FROM m2)"""


@query("a13_a20_metric_bundle", using(*_BT, _EQ, _MET, query=f"SELECT strategy_id, n, round(total,6) AS total_return, round(sharpe,6) AS sharpe, round(cagr,6) AS cagr, round(maxdd,6) AS max_drawdown, round(coalesce(cagr/nullif(abs(maxdd),0),0),5) AS calmar, round(skew,6) AS skew, round(kurt,6) AS kurt, round(CASE WHEN n<2 THEN 0 WHEN se=0 THEN 0.5 ELSE {cdf_sql('(sr/se)')} END,6) AS psr, n>=30 AS significant FROM m3"))
def metric_bundle(spark, sf_dir):
    m = metrics.bundle(all_returns(spark, sf_dir).select("strategy_id", "t", "ret"), years=YEARS)
    return rounded(rounded(m, "total_return", "sharpe", "cagr", "max_drawdown", "skew", "kurt", "psr"), "calmar", digits=5)


@query("a36_equity_curves", using(*_BT, _EQ, query="SELECT strategy_id, t, round(e,6) AS equity, round(pk,6) AS peak, round(e/pk-1,6) AS drawdown FROM eq"))
def equity_curves(spark, sf_dir):
    e = metrics.equity(all_returns(spark, sf_dir).select("strategy_id", "t", "ret"))
    return rounded(e, "equity", "peak", "drawdown").drop("ret")


def benchmark_returns(spark, sf_dir):
    b = domain.benchmark(domain.bars(spark, sf_dir))
    at = asof.first_on_or_after(b, DATES, [])
    cal = calendar.calendar(spark, START, END)
    here = cal.join(at.select("as_of", F.col("close").alias("c0")), "as_of", "left").join(at.select(F.col("as_of").alias("next_as_of"), F.col("close").alias("c1")), "next_as_of", "left")
    return here.filter("next_as_of is not null").select(F.col("period").alias("t"), F.coalesce(F.try_divide(F.col("c1"), F.col("c0")) - 1, F.lit(0.0)).alias("mkt"))


_BM = "bat AS (SELECT c.as_of, arg_min(close,b.date) AS c FROM cal c JOIN bench b ON b.date>=c.as_of GROUP BY c.as_of), bm AS (SELECT t, coalesce(y.c/nullif(x.c,0)-1,0) AS mkt FROM cal LEFT JOIN bat x ON x.as_of=cal.as_of LEFT JOIN bat y ON y.as_of=cal.next_as_of WHERE next_as_of IS NOT NULL)"


@query("a22_benchmark_returns", using(BARS, BENCHMARK, CAL, _BM, query="SELECT t, round(mkt,6) AS mkt FROM bm"))
def benchmark_period_returns(spark, sf_dir):
    return rounded(benchmark_returns(spark, sf_dir), "mkt")


@query("a21_capm", using(*_BT, BENCHMARK, _BM, query="""SELECT strategy_id, k, round(b,6) AS beta, round(my-b*mx,6) AS alpha, round((my-b*mx)*12,6) AS alpha_annual, round((my-b*mx)/nullif(sqrt(greatest(syy-b*sxy,0)/(k-2)*(1.0::DOUBLE/k+mx*mx/sxx)),0),5) AS t_alpha, round(greatest(1-greatest(syy-b*sxy,0)/nullif(syy,0),0),6) AS r2 FROM
 (SELECT *, sxy/sxx AS b FROM (SELECT strategy_id, count(*) AS k, regr_sxx(ret,mkt) AS sxx, regr_sxy(ret,mkt) AS sxy, regr_syy(ret,mkt) AS syy, avg(ret) AS my, avg(mkt) AS mx FROM bt JOIN bm USING (t) GROUP BY strategy_id))"""))
def capm(spark, sf_dir):
    c = metrics.capm(all_returns(spark, sf_dir).select("strategy_id", "t", "ret"), benchmark_returns(spark, sf_dir))
    return rounded(rounded(c, "beta", "alpha", "alpha_annual", "r2"), "t_alpha", digits=5)


@query("a26_regimes", using(*_BT, "mk AS (SELECT c.t, avg(within_ret) AS mkt FROM rets r JOIN cal c ON c.as_of=r.as_of GROUP BY c.t)", query="""SELECT strategy_id, CASE WHEN mkt>0.02 THEN 'Bull' WHEN mkt<-0.02 THEN 'Bear' ELSE 'Flat' END AS regime, count(*) AS n, round(avg(ret),6) AS avg_ret, round(CASE WHEN stddev_samp(ret) IS NULL OR stddev_samp(ret)=0 THEN 0 ELSE avg(ret)/stddev_samp(ret)*sqrt(12.0::DOUBLE) END,5) AS sharpe FROM bt JOIN mk USING (t) GROUP BY ALL"""))
def regimes(spark, sf_dir):
    m = market(spark, sf_dir)
    r = metrics.regimes(all_returns(spark, sf_dir, m), backtest.equal_weight_market(rolling.market_periods(m), DATES))
    return rounded(rounded(r, "avg_ret"), "sharpe", digits=5)


_FACTOR = f"""{TRADEABLE},
 fr AS (SELECT r.as_of, r.ticker, r.within_ret AS r, trailing_return AS mom, earnings_yield, roe, p.ticker IS NOT NULL AS has FROM rets r JOIN trd u USING (as_of, ticker) LEFT JOIN feat f USING (as_of, ticker) LEFT JOIN pit p USING (as_of, ticker)),
 mo AS (SELECT f.as_of, f.ticker, f.trailing_return AS mom FROM feat f JOIN trd USING (as_of, ticker)),
 mp AS (SELECT as_of, ticker FROM (SELECT *, row_number() OVER (PARTITION BY as_of ORDER BY mom DESC NULLS LAST, ticker) AS k, count(*) OVER (PARTITION BY as_of) AS n FROM mo) WHERE k<=greatest(n//10,1)),
 dec AS (SELECT *, row_number() OVER (PARTITION BY as_of ORDER BY has DESC, earnings_yield DESC NULLS LAST, ticker) AS kv, row_number() OVER (PARTITION BY as_of ORDER BY has DESC, roe DESC NULLS LAST, ticker) AS kq, count(*) FILTER (has) OVER (PARTITION BY as_of) AS n FROM fr),
 fac0 AS (SELECT as_of, avg(r) AS market, coalesce(avg(r) FILTER ((as_of,ticker) IN (SELECT (as_of,ticker) FROM mp)),0) AS momentum, avg(r) FILTER (kv<=greatest(n//10,1) AND has) AS value, avg(r) FILTER (kq<=greatest(n//10,1) AND has) AS quality FROM dec GROUP BY as_of),
 fac AS (SELECT as_of, CASE WHEN k>=20 THEN market ELSE 0 END AS market, CASE WHEN k>=20 THEN momentum ELSE 0 END AS momentum, CASE WHEN k>=20 THEN coalesce(value,market) ELSE 0 END AS value, CASE WHEN k>=20 THEN coalesce(quality,market) ELSE 0 END AS quality FROM fac0 JOIN (SELECT as_of, count(*) AS k FROM trd GROUP BY as_of) USING (as_of))"""


def factor_returns(spark, sf_dir, m=None, facts=None):
    m = m or market(spark, sf_dir)
    fields = ["earnings_yield", "roe"]
    facts = facts.filter(F.coalesce(*fields).isNotNull()).select("as_of", "ticker", *fields) if facts else known(spark, sf_dir, DATES, fields)
    features, tradeable = rolling.of_market(m)
    return evaluate.factor_returns(facts, features, rolling.market_periods(m), tradeable)


@query("a24_factor_returns", using(*PANEL[:7], RETS, _FACTOR, query="SELECT as_of, round(market,6) AS market, round(momentum,6) AS momentum, round(value,6) AS value, round(quality,6) AS quality FROM fac"))
def factor_portfolios(spark, sf_dir):
    return rounded(factor_returns(spark, sf_dir), "market", "momentum", "value", "quality")


# least squares by taking each factor's part that the ones before it do not explain
_D = lambda x, y: f"sum({x}*{y}) OVER p"
_OLS = f"""o0 AS (SELECT strategy_id, ret, market, momentum, value, quality, ret-avg(ret) OVER p AS y, market-avg(market) OVER p AS e1, momentum-avg(momentum) OVER p AS m2, value-avg(value) OVER p AS m3, quality-avg(quality) OVER p AS m4 FROM bt JOIN fac USING (as_of) WINDOW p AS (PARTITION BY strategy_id)),
 o1 AS (SELECT *, {_D('m2', 'e1')}/nullif({_D('e1', 'e1')},0) AS r21, {_D('m3', 'e1')}/nullif({_D('e1', 'e1')},0) AS r31, {_D('m4', 'e1')}/nullif({_D('e1', 'e1')},0) AS r41 FROM o0 WINDOW p AS (PARTITION BY strategy_id)),
 o2 AS (SELECT *, m2-r21*e1 AS e2 FROM o1),
 o3 AS (SELECT *, {_D('m3', 'e2')}/nullif({_D('e2', 'e2')},0) AS r32, {_D('m4', 'e2')}/nullif({_D('e2', 'e2')},0) AS r42 FROM o2 WINDOW p AS (PARTITION BY strategy_id)),
 o4 AS (SELECT *, m3-r31*e1-r32*e2 AS e3 FROM o3),
 o5 AS (SELECT *, {_D('m4', 'e3')}/nullif({_D('e3', 'e3')},0) AS r43 FROM o4 WINDOW p AS (PARTITION BY strategy_id)),
 o6 AS (SELECT *, m4-r41*e1-r42*e2-r43*e3 AS e4 FROM o5),
 o7 AS (SELECT strategy_id, count(*) AS n, avg(ret) AS my, avg(market) AS x1, avg(momentum) AS x2, avg(value) AS x3, avg(quality) AS x4, any_value(r21) AS r21, any_value(r31) AS r31, any_value(r41) AS r41, any_value(r32) AS r32, any_value(r42) AS r42, any_value(r43) AS r43,
  sum(y*e1)/nullif(sum(e1*e1),0) AS g1, sum(y*e2)/nullif(sum(e2*e2),0) AS g2, sum(y*e3)/nullif(sum(e3*e3),0) AS g3, sum(y*e4)/nullif(sum(e4*e4),0) AS g4, sum(y*y) AS syy, least(sum(e1*e1),sum(e2*e2),sum(e3*e3),sum(e4*e4)) AS small FROM o6 GROUP BY strategy_id),
 o8 AS (SELECT *, g4 AS b4, g3-r43*g4 AS b3 FROM o7), o9 AS (SELECT *, g2-r32*b3-r42*b4 AS b2 FROM o8), o10 AS (SELECT *, g1-r21*b2-r31*b3-r41*b4 AS b1 FROM o9),
 fit AS (SELECT *, n>=6 AND coalesce(small,0)>1e-11 AS ok FROM o10),
 res AS (SELECT f.strategy_id, sum(pow(o.ret-f.my-f.b1*(o.market-f.x1)-f.b2*(o.momentum-f.x2)-f.b3*(o.value-f.x3)-f.b4*(o.quality-f.x4),2)) AS sse FROM o0 o JOIN fit f ON f.strategy_id=o.strategy_id GROUP BY f.strategy_id),
 load AS (SELECT strategy_id, unnest(['const','market','momentum','value','quality']) AS term, unnest([CASE WHEN ok THEN my-b1*x1-b2*x2-b3*x3-b4*x4 ELSE 0 END, CASE WHEN ok THEN b1 ELSE 0 END, CASE WHEN ok THEN b2 ELSE 0 END, CASE WHEN ok THEN b3 ELSE 0 END, CASE WHEN ok THEN b4 ELSE 0 END]) AS coef, CASE WHEN ok AND syy>0 THEN greatest(0,1-sse/syy) ELSE 0 END AS r2 FROM fit JOIN res USING (strategy_id))"""


@query("a23_factor_attribution", using(*_BT, _FACTOR, _OLS, query="SELECT strategy_id, term, round(coef,6) AS coef, round(r2,6) AS r2 FROM load"))
def factor_attribution(spark, sf_dir):
    """Loadings on four factors from one pass of cross moments."""
    m, facts = market(spark, sf_dir), compiled(known(spark, sf_dir), "known")
    r = all_returns(spark, sf_dir, m, facts).join(factor_returns(spark, sf_dir, m, facts), "as_of")
    return rounded(metrics.ols(r, "ret", ["market", "momentum", "value", "quality"]), "coef", "r2")


_CORR = ["momentum_12m", "quality_score", "margin_expansion", "low_leverage_growth"]


_RANKS = (scores_sql(dict.fromkeys(_CORR, 1.0), "allt", "c4"), "lng AS (" + " UNION ALL ".join(f"SELECT as_of, ticker, '{s}' AS sg, round(s_{s},9) AS v FROM c4" for s in _CORR) + ")",
 "rk AS (SELECT as_of, ticker, sg, rank() OVER (PARTITION BY as_of, sg ORDER BY v)+(count(*) OVER (PARTITION BY as_of, sg, v)-1)/2.0::DOUBLE AS r FROM lng)",
 "cr AS (SELECT x.as_of, x.sg AS a, y.sg AS b, covar_samp(x.r,y.r)/nullif(stddev_samp(x.r)*stddev_samp(y.r),0) AS c, count(*) AS n FROM rk x JOIN rk y ON x.as_of=y.as_of AND x.ticker=y.ticker AND x.sg<y.sg GROUP BY ALL)")
_ALL_TRADED = FRAMED.format("allt", "trd")


@query("a25_signal_correlations", using(*PANEL[:7], TRADEABLE, _ALL_TRADED, *_RANKS, query="SELECT a, b, count(c) AS n_dates, round(avg(c),6) AS corr, abs(avg(c))>0.7 AS high FROM cr WHERE n>=20 AND c IS NOT NULL GROUP BY a, b"))
def signal_correlations(spark, sf_dir):
    return rounded(correlations(traded_frame(spark, sf_dir)), "corr")


def traded_frame(spark, sf_dir, dates=DATES):
    """The screening frame of everything that trades, whether in an index or not."""
    m = market(spark, sf_dir, dates, periods=False)
    return framed_by(spark, sf_dir, known(spark, sf_dir, dates), m, rolling.of_market(m)[1])


def correlations(panel):
    """Mean rank correlations of four signals over the dates of a screening frame, none of whose rows are filtered."""
    s = screen.with_signals(panel, _CORR)
    long = s.select("as_of", "ticker", *(F.round(c, 9).alias(c) for c in _CORR)).unpivot(["as_of", "ticker"], _CORR, "signal", "value")
    return metrics.rank_correlations(long)


def _draw(*key: str) -> str:
    return f"(CAST(('0x'||substr(md5(concat_ws(':',{','.join(key)})),1,13)) AS BIGINT)/pow(16.0::DOUBLE,13))"


_ITER = 500


def _trials_sql(legs: list[tuple[int, float]]) -> str:
    """tr (n, stop, i, sharpe): the trials of each leg; large cross-sections by draws without repeats, small ones by a hash of every place."""
    most = max(n for n, _ in legs)
    ret = lambda stop: f"CASE WHEN min_low<start_price*(1-{stop!r}::DOUBLE) THEN -{stop!r}::DOUBLE ELSE within_ret END" if stop else "within_ret"
    rows = " UNION ALL ".join(f"SELECT {n} AS n, {stop!r}::DOUBLE AS stop, i, as_of, coalesce(CASE WHEN any_value(size)>={n} THEN avg({ret(stop)}) FILTER (k<={n})-0.002::DOUBLE END,0) AS ret FROM dm GROUP BY i, as_of" for n, stop in legs)
    return f"""per AS (SELECT c.as_of, coalesce(u.size,0) AS size FROM cal c LEFT JOIN (SELECT as_of, count(*) AS size FROM uni GROUP BY as_of) u USING (as_of) WHERE c.next_as_of IS NOT NULL),
 dj AS (SELECT i, as_of, j, CAST(floor({_draw("'42'", "i::VARCHAR", "as_of::VARCHAR", "j::VARCHAR")}*size) AS BIGINT) AS place FROM per, range({_ITER}) q(i), range({3 * most + 40}) r(j) WHERE size>{4 * most}),
 dk AS (SELECT i, as_of, place, row_number() OVER (PARTITION BY i, as_of ORDER BY j) AS k FROM (SELECT i, as_of, place, min(j) AS j FROM dj GROUP BY ALL)),
 ok AS (SELECT i, as_of FROM dk GROUP BY ALL HAVING count(*)>={most}),
 al AS (SELECT i, as_of, unnest(range(size)) AS place FROM per, range({_ITER}) q(i) WHERE (i, as_of) NOT IN (SELECT (i, as_of) FROM ok)),
 pl AS (SELECT as_of, ticker, row_number() OVER (PARTITION BY as_of ORDER BY ticker)-1 AS place FROM uni),
 dd AS (SELECT i, as_of, place, k FROM dk JOIN ok USING (i, as_of) WHERE k<={most} UNION ALL SELECT * FROM (SELECT i, as_of, place, row_number() OVER (PARTITION BY i, as_of ORDER BY {_draw("'42'", "i::VARCHAR", "as_of::VARCHAR", "'p'", "place::VARCHAR")}, place) AS k FROM al) WHERE k<={most}),
 dm AS (SELECT q.i, per.as_of, per.size, k, within_ret, min_low, start_price FROM per CROSS JOIN range({_ITER}) q(i) LEFT JOIN dd ON dd.i=q.i AND dd.as_of=per.as_of LEFT JOIN pl ON pl.as_of=dd.as_of AND pl.place=dd.place LEFT JOIN rets r ON r.as_of=pl.as_of AND r.ticker=pl.ticker),
 tr AS (SELECT n, stop, i, CASE WHEN stddev_samp(ret) IS NULL OR stddev_samp(ret)=0 THEN 0 ELSE avg(ret)/stddev_samp(ret)*sqrt(12.0::DOUBLE) END AS sharpe FROM ({rows}) GROUP BY n, stop, i)"""


def _sizes_sql(specs: list[Spec], stops: bool = False) -> str:
    return "sz(strategy_id, n, stop) AS (VALUES " + ", ".join(f"('{s.name}', {s.top_n}, {(s.position_stop_loss if stops else 0.0)!r}::DOUBLE)" for s in specs) + ")"


_PLACED = """SELECT strategy_id, z.n, round(s,6) AS sharpe, count(*) AS n_trials, round(avg(sharpe),6) AS mean_trial, round(avg(CASE WHEN sharpe<s THEN 1.0::DOUBLE ELSE 0 END)*100,6) AS percentile
 FROM own JOIN sz z USING (strategy_id) JOIN tr ON tr.n=z.n AND tr.stop=z.stop GROUP BY strategy_id, z.n, s"""
_OWN = "own AS (SELECT strategy_id, CASE WHEN stddev_samp(ret)=0 OR stddev_samp(ret) IS NULL THEN 0 ELSE avg(ret)/stddev_samp(ret)*sqrt(12.0::DOUBLE) END AS s FROM {} GROUP BY strategy_id)"


def members(spark, sf_dir, m=None):
    tradeable = rolling.of_market(m)[1] if m else asof.tradeable_as_of(domain.bars(spark, sf_dir), DATES)
    return asof.universe_of(domain.membership(spark, sf_dir), tradeable, DATES)


def own_sharpe(returns, specs, stops=False):
    """(strategy_id, n, stop, sharpe) of each strategy, with the leg of random portfolios that it is compared with."""
    legs = returns.sparkSession.createDataFrame([(s.name, s.top_n, float(s.position_stop_loss if stops else 0.0)) for s in specs], "strategy_id string, n int, stop double")
    return metrics.bundle(returns.select("strategy_id", "t", "ret")).select("strategy_id", "sharpe").join(F.broadcast(legs), "strategy_id")  # a row for each strategy of the list


_LEGS = backtest.monte_carlo_leg(VARIANTS)[1]


@query("a27_random_portfolios", using(BARS, MEMBERSHIP, CAL, UNIVERSE, RETS, _trials_sql(_LEGS), query="SELECT n, i AS iteration, round(sharpe,6) AS sharpe FROM tr"))
def random_portfolios(spark, sf_dir):
    """The ratios of 500 random portfolios for each number of names that a strategy holds."""
    m = market(spark, sf_dir)
    t = resample.random_portfolios(members(spark, sf_dir, m), rolling.market_periods(m), DATES, _LEGS, _ITER)
    return rounded(t, "sharpe").drop("stop")


@query("a27_monte_carlo_percentile", using(*_BT, _trials_sql(_LEGS), _sizes_sql(VARIANTS), _OWN.format("bt"), query=_PLACED))
def monte_carlo_percentile(spark, sf_dir):
    m = market(spark, sf_dir)
    own = all_returns(spark, sf_dir, m)
    trials = resample.random_portfolios(members(spark, sf_dir, m), rolling.market_periods(m), DATES, _LEGS, _ITER)
    return rounded(resample.percentile_of(trials, own_sharpe(own, VARIANTS)), "sharpe", "mean_trial", "percentile")


_MATCHED = [FEEDBACK[0], FEEDBACK[3]]
_MATCHED_LEGS = backtest.monte_carlo_leg(_MATCHED, match_strategy=True)[1]


@query("a27_matched_percentile", recursive(using(*_runs_sql(_MATCHED, [("", START, DATES[-1])]), _trials_sql(_MATCHED_LEGS), _sizes_sql(_MATCHED, stops=True), _OWN.format("runs"), query=_PLACED)))
def matched_percentile(spark, sf_dir):
    """Strategies with their hold bonus and stops among random portfolios of their size with their position stop."""
    m = market(spark, sf_dir)
    panel, rets = panel_and_periods(spark, sf_dir, m)
    specs, legs = backtest.monte_carlo_leg(_MATCHED, match_strategy=True)
    own = compiled(backtest.backtest(panel, rets, DATES, specs), "returns")
    trials = resample.random_portfolios(members(spark, sf_dir, m), rets, DATES, legs, _ITER)
    return rounded(resample.percentile_of(trials, own_sharpe(own, specs, stops=True)), "sharpe", "mean_trial", "percentile")


_REPS = 5000
_BOOT = f"""n AS (SELECT count(*) AS n FROM bm), grid AS (SELECT r.rep, bm.t, n.n, (bm.t=0 OR {_draw("'42'", "rep::VARCHAR", "bm.t::VARCHAR", "'go'")}>=1-1/3.0::DOUBLE) AS go, CAST(floor({_draw("'42'", "rep::VARCHAR", "bm.t::VARCHAR", "'at'")}*n.n) AS BIGINT) AS st FROM bm, n, range({_REPS}) r(rep)),
 blk AS (SELECT rep, t, n, last_value(CASE WHEN go THEN st END IGNORE NULLS) OVER w AS s, last_value(CASE WHEN go THEN t END IGNORE NULLS) OVER w AS t0 FROM grid WINDOW w AS (PARTITION BY rep ORDER BY t ROWS UNBOUNDED PRECEDING)),
 smp AS (SELECT rep, blk.t, mkt AS ret FROM blk JOIN bm ON bm.t=(s+blk.t-t0)%n),
 se AS (SELECT *, greatest(1.0::DOUBLE,max(e) OVER (PARTITION BY rep ORDER BY t)) AS pk FROM (SELECT *, exp(sum(ln(1+ret)) OVER (PARTITION BY rep ORDER BY t)) AS e FROM smp)),
 st AS (SELECT rep, CASE WHEN stddev_pop(ret)=0 THEN 0 ELSE avg(ret)/stddev_pop(ret)*sqrt(12.0::DOUBLE) END AS sharpe, pow(arg_max(e,t),12.0::DOUBLE/count(*))-1 AS cagr, min(e/pk-1) AS maxdd FROM se GROUP BY rep)"""


@query("a28_block_bootstrap", using(BARS, BENCHMARK, CAL, _BM, _BOOT, query="SELECT metric, round(quantile_cont(v,0.05),6) AS p5, round(quantile_cont(v,0.5),6) AS p50, round(quantile_cont(v,0.95),6) AS p95 FROM (UNPIVOT st ON sharpe, cagr, maxdd INTO NAME metric VALUE v) GROUP BY metric"))
def block_bootstrap(spark, sf_dir):
    return rounded(resample.bootstrap_interval(benchmark_returns(spark, sf_dir).withColumnRenamed("mkt", "ret"), _REPS), "p5", "p50", "p95")


@query("a29_a30_deflated_sharpe", using(*_BT, _EQ, _MET, f"""d AS (SELECT m3.*, count(*) OVER () AS nt, coalesce(stddev_samp(sr) OVER (),0) AS sg FROM m3),
 h AS (SELECT *, CASE WHEN nt<2 OR sg<=0 THEN 0 ELSE sg*((1-{scalar.EULER_GAMMA!r}::DOUBLE)*{ppf_sql('(1-1.0::DOUBLE/nt)')}+{scalar.EULER_GAMMA!r}::DOUBLE*{ppf_sql('(1-1.0::DOUBLE/(nt*2.718281828459045::DOUBLE))')}) END AS hurdle FROM d)""",
 query=f"SELECT strategy_id, nt AS n_trials, round(sg,6) AS sigma, round(hurdle,6) AS hurdle, round(CASE WHEN n<2 THEN 0 WHEN se=0 THEN 0.5 ELSE {cdf_sql('((sr-hurdle)/se)')} END,6) AS dsr FROM h"))
def deflated_sharpe(spark, sf_dir):
    d = resample.deflated(metrics.bundle(all_returns(spark, sf_dir).select("strategy_id", "t", "ret")))
    return rounded(d.select("strategy_id", "n_trials", "sigma", "hurdle", "dsr"), "sigma", "hurdle", "dsr")


_FOLDS = calendar.folds(START, END, 24, 6, 6)


SPANS = [(f"fold {i}", b, c) for i, (_, b, c) in enumerate(_FOLDS)]
WALKED = [VARIANTS[0], VARIANTS[1], VARIANTS[3], FEEDBACK[1], FEEDBACK[3]]
_WALK = """wf AS (SELECT strategy_id, run, min(as_of) AS test_start, count(*) AS n, sum(swaps)::BIGINT AS swaps, CASE WHEN stddev_samp(ret) IS NULL OR stddev_samp(ret)=0 THEN 0 ELSE avg(ret)/stddev_samp(ret)*sqrt(12.0::DOUBLE) END AS sharpe,
  exp(sum(ln(1+ret)))-1 AS total FROM runs GROUP BY strategy_id, run)"""


def walked(spark, sf_dir, panel=None, rets=None, specs=WALKED):
    """The returns of every strategy's own backtest of each fold."""
    if panel is None or rets is None:
        m = market(spark, sf_dir)
        panel, rets = panel or compiled(frame_of(spark, sf_dir, m), "frame"), rets or rolling.market_periods(m)
    return compiled(backtest.backtest(panel, rets, DATES, specs, SPANS), "folds")


@query("a32_a33_walk_forward", recursive(using(*_runs_sql(WALKED, SPANS), _WALK, query="""SELECT strategy_id, run, test_start, n, swaps, round(sharpe,5) AS sharpe, round(total,6) AS total_return,
 round(avg(CASE WHEN sharpe>0 THEN 1.0::DOUBLE ELSE 0 END) OVER (PARTITION BY strategy_id),6) AS consistency FROM wf""")))
def walk_forward(spark, sf_dir):
    """A backtest of its own for each fold: it opens empty, pays its first purchase and forgets what was held before."""
    w = evaluate.walk_forward_runs(walked(spark, sf_dir), len(SPANS))
    return rounded(rounded(w, "sharpe", digits=5), "total_return", "consistency").select("strategy_id", "run", "test_start", "n", "swaps", "sharpe", "total_return", "consistency")


_MONTHLY = "mc AS (SELECT CAST(date_trunc('month',date) AS DATE) AS m, arg_max(close,date) AS c FROM bench GROUP BY 1), mr AS (SELECT m, c, c/nullif(lag(c) OVER (ORDER BY m),0)-1 AS r FROM mc)"


@query("a34_benchmark_summary", using(BARS, BENCHMARK, _MONTHLY, "me AS (SELECT *, max(c) OVER (ORDER BY m) AS pk FROM mr)", query="SELECT 'benchmark' AS name, count(r) AS n, round(CASE WHEN stddev_pop(r)=0 THEN 0 ELSE avg(r)/stddev_pop(r)*sqrt(12.0::DOUBLE) END,6) AS sharpe, round(pow(arg_max(c,m)/arg_min(c,m),12.0::DOUBLE/count(r))-1,6) AS cagr, round(min(CASE WHEN r IS NOT NULL THEN c/pk2-1 END),6) AS max_drawdown, round(arg_max(c,m)/arg_min(c,m)-1,6) AS total_return FROM (SELECT *, max(CASE WHEN r IS NOT NULL THEN c END) OVER (ORDER BY m) AS pk2 FROM me)"))
def benchmark_summary(spark, sf_dir):
    s = evaluate.benchmark_summary(domain.benchmark(domain.bars(spark, sf_dir)))
    return rounded(s, "sharpe", "cagr", "max_drawdown", "total_return")


@query("a39_a40_turnover", using(*_BT, query="SELECT strategy_id, count(*) AS n, round(avg(CASE WHEN np=0 THEN 1.0::DOUBLE ELSE sd::DOUBLE/((n+np+sd)/2.0::DOUBLE) END),6) AS avg_turnover, round(sum(CASE WHEN np=0 THEN 0 ELSE sd//2 END)::DOUBLE/count(*),6) AS swaps_per_period FROM mv GROUP BY strategy_id"))
def turnover_series(spark, sf_dir):
    """Symmetric difference over union of consecutive pick sets, the first 1, averaged per strategy."""
    panel = compiled(frame(spark, sf_dir).filter(F.col("as_of") < F.lit(END)), "frame")
    picks = compiled(screen.picks_by_strategy(panel, VARIANTS), "picks")
    t = portfolio.turnover(picks, calendar.calendar(spark, START, END), 10.0, ("strategy_id",))
    union = (F.col("n") + F.col("n_before") + F.col("symdiff")) / 2
    one = F.when(F.col("n_before") == 0, F.lit(1.0)).otherwise(F.col("symdiff") / union)
    g = t.groupBy("strategy_id").agg(F.count(F.lit(1)).alias("n"), F.avg(one).alias("avg_turnover"), F.try_divide(F.sum("swaps"), F.count(F.lit(1))).alias("swaps_per_period"))
    return rounded(g, "avg_turnover", "swaps_per_period")


@query("q12_guardrails", using(*_BT, _EQ, _MET, query="SELECT strategy_id, concat_ws(',', CASE WHEN n<60 THEN 'sample_size' END, CASE WHEN sharpe<0.3 THEN 'low_sharpe' END, CASE WHEN maxdd<-0.02 THEN 'deep_drawdown' END) AS warnings FROM m3"))
def guardrails(spark, sf_dir):
    m = metrics.bundle(all_returns(spark, sf_dir).select("strategy_id", "t", "ret"))
    return evaluate.guardrails(m, least_periods=60, least_sharpe=0.3, worst_drawdown=-0.02).select("strategy_id", F.concat_ws(",", "warnings").alias("warnings"))


EXPERIMENT = research.Experiment(
    "momentum against value", "Mixed signals hold up better out of sample", Spec("base", weighting="inverse_vol", hold_bonus=0.3, max_per_sector=2),
    ({"name": "mixed"}, {"name": "value", "signals": {"low_leverage_growth": 0.5, "quality_midcap": 0.5}}, {"name": "margins", "signals": {"margin_expansion": 1.0}, "momentum_cap": 0.05}, {"name": "trend", "signals": {"momentum_12m": 1.0}}),
    START, DATES[40], DATES[-1], most_runs=7, limits={"least_sharpe": 0.1},
)


def _judged_sql(e: research.Experiment) -> str:
    """met (strategy_id, run, n, sharpe, maxdd), ex (the variations in their order, judged on their training) and ho (the best's holdout)."""
    order = ", ".join(f"('{s.name}', {i})" for i, s in enumerate(e.specs()))
    return f"""re AS (SELECT *, greatest(1.0::DOUBLE, max(e) OVER (PARTITION BY strategy_id, run ORDER BY t)) AS pk FROM (SELECT strategy_id, run, t, ret, exp(sum(ln(1+ret)) OVER (PARTITION BY strategy_id, run ORDER BY t)) AS e FROM runs)),
 met AS (SELECT strategy_id, run, count(*) AS n, CASE WHEN stddev_samp(ret) IS NULL OR stddev_samp(ret)=0 THEN 0 ELSE avg(ret)/stddev_samp(ret)*sqrt(12.0::DOUBLE) END AS sharpe, arg_max(e,t)-1 AS total, min(e/pk-1) AS maxdd FROM re GROUP BY strategy_id, run),
 ex AS (SELECT strategy_id, k, n, sharpe AS train_sharpe, total, maxdd, concat_ws(',', CASE WHEN n<30 THEN 'sample_size' END, CASE WHEN sharpe<{e.limits['least_sharpe']} THEN 'low_sharpe' END, CASE WHEN maxdd<-0.3 THEN 'deep_drawdown' END) AS w FROM met JOIN (VALUES {order}) o(strategy_id, k) USING (strategy_id) WHERE run='train'),
 ho AS (SELECT strategy_id, sharpe AS holdout_sharpe FROM met WHERE run='holdout')"""


_EXPERIMENT = (*_runs_sql(EXPERIMENT.specs(), [("train", START, DATES[40]), ("holdout", DATES[40], DATES[-1])]), _judged_sql(EXPERIMENT))
#: what is logged before each call: the first one logs its four runs and the use of the holdout
_CALLS = "calls AS (SELECT 1 AS call, 4 AS runs, true AS open UNION ALL SELECT 2, 2, false), jd AS (SELECT call, open, ex.*, w='' AND row_number() OVER (PARTITION BY call ORDER BY w='' DESC, train_sharpe DESC, strategy_id)=1 AS best FROM ex JOIN calls ON k<runs)"


def _experiment_log(spark):
    return Versioned(spark, scratch(spark, "research-log"), RESEARCH_LOG)


@query("q14_experiment", recursive(using(*_EXPERIMENT, _CALLS, query="SELECT call, strategy_id, round(train_sharpe,6) AS train_sharpe, w AS warnings, best, CASE WHEN best AND open THEN round(holdout_sharpe,6) END AS holdout_sharpe FROM jd LEFT JOIN ho USING (strategy_id)")))
def experiment(spark, sf_dir):
    """An experiment that is run until its log lets it run no more: the second call has two runs left and no holdout, the third none."""
    (panel, rets), log = panel_and_periods(spark, sf_dir), _experiment_log(spark)
    out, call = None, 0
    while True:
        call += 1
        try:
            e = research.run(log, EXPERIMENT, panel, rets, DATES).withColumn("call", F.lit(call))
        except research.BudgetExhausted:
            break
        out = e if out is None else out.unionByName(e)
    return rounded(out, "train_sharpe", "holdout_sharpe").select("call", "strategy_id", "train_sharpe", "warnings", "best", "holdout_sharpe")


@query("s25_experiment_report", recursive(using(*_EXPERIMENT, _CALLS, query="""SELECT 'momentum against value' AS experiment_name, (SELECT max(strategy_id) FILTER (best) FROM jd WHERE call=1) AS best_variation, strategy_id AS name, round(train_sharpe,6) AS sharpe, round(maxdd,6) AS max_drawdown, n AS sample_size, w AS warnings,
 (SELECT round(holdout_sharpe,6) FROM jd JOIN ho USING (strategy_id) WHERE best AND call=1) AS holdout_sharpe FROM jd WHERE call=1""")))
def experiment_report(spark, sf_dir):
    """The experiment's report document, read back: a row for each of its variations."""
    e = research.run(_experiment_log(spark), EXPERIMENT, *panel_and_periods(spark, sf_dir), DATES)
    doc = evaluate.experiment_report(e, EXPERIMENT.name, EXPERIMENT.hypothesis)
    d = doc.select(F.from_json("document", evaluate.EXPERIMENT_REPORT).alias("d")).select("d.experiment_name", "d.best_variation", F.col("d.holdout.sharpe").alias("holdout_sharpe"), F.explode("d.results").alias("r"))
    return d.select("experiment_name", "best_variation", "r.name", "r.sharpe", "r.max_drawdown", "r.sample_size", F.array_join("r.warnings", ",").alias("warnings"), "holdout_sharpe")


_MARKET = "mk AS (SELECT c.t, avg(within_ret) AS mkt FROM rets r JOIN cal c ON c.as_of=r.as_of GROUP BY c.t)"
_ALL = ("all", START, DATES[-1])
_REPORT = (*_runs_sql(VARIANTS, [_ALL, *SPANS]), "bt AS (SELECT strategy_id, t, as_of, ret, n, swaps, cost FROM runs WHERE run='all')", BENCHMARK, _BM, _MARKET, _EQ, _MET, _trials_sql(_LEGS), _sizes_sql(VARIANTS), _FACTOR, _OLS, _ALL_TRADED, *_RANKS,
 f"""rp AS (SELECT strategy_id, sxy/sxx AS beta, (my-sxy/sxx*mx)/nullif(sqrt(greatest(syy-sxy/sxx*sxy,0)/(k-2)*(1.0::DOUBLE/k+mx*mx/sxx)),0) AS t_alpha FROM (SELECT strategy_id, count(*) AS k, regr_sxx(ret,mkt) AS sxx, regr_sxy(ret,mkt) AS sxy, regr_syy(ret,mkt) AS syy, avg(ret) AS my, avg(mkt) AS mx FROM bt JOIN bm USING (t) GROUP BY strategy_id)),
 rg AS (SELECT strategy_id, count(*) AS bull_n, avg(ret) AS bull_ret FROM bt JOIN mk USING (t) WHERE mkt>0.02 GROUP BY strategy_id),
 wf AS (SELECT strategy_id, count(*) AS folds, sum(CASE WHEN s>0 THEN 1.0::DOUBLE ELSE 0 END)/{len(SPANS)} AS consistency FROM (SELECT strategy_id, run, CASE WHEN stddev_samp(ret) IS NULL OR stddev_samp(ret)=0 THEN 0 ELSE avg(ret)/stddev_samp(ret) END AS s FROM runs WHERE run<>'all' GROUP BY strategy_id, run) GROUP BY strategy_id),
 pc AS (SELECT strategy_id, avg(CASE WHEN t.sharpe<m.sharpe THEN 1.0::DOUBLE ELSE 0 END)*100 AS percentile FROM m3 m JOIN sz USING (strategy_id) JOIN tr t ON t.n=sz.n GROUP BY strategy_id),
 hc AS (SELECT count(*) AS n_pairs, coalesce(max(abs(corr)),0) AS strongest FROM (SELECT a, b, avg(c) AS corr FROM cr WHERE n>=20 AND c IS NOT NULL AND as_of>=DATE '2000-01-01' AND as_of<DATE '2001-01-01' GROUP BY a, b))""")  # fmt: skip


@query("b14_s24_evaluation_report", recursive(using(*_REPORT, query=f"""SELECT strategy_id, m3.n, round(sharpe,6) AS sharpe, round(cagr,6) AS cagr, round(maxdd,6) AS max_drawdown, round(CASE WHEN m3.n<2 THEN 0 WHEN se=0 THEN 0.5 ELSE {cdf_sql('(sr/se)')} END,6) AS psr, round(beta,6) AS beta, coalesce(bull_n,0) AS bull_periods, round(bull_ret,6) AS bull_ret, folds, round(consistency,6) AS consistency, round(percentile,6) AS percentile, round(coef,6) AS market_loading, round(r2,6) AS factor_r2, n_pairs, round(strongest,6) AS strongest_pair,
 (m3.n>=30)::INT+(sharpe>0.5)::INT+coalesce((t_alpha>2)::INT,0)+(consistency>=0.6)::INT+(percentile>=95)::INT AS passed FROM m3 JOIN rp USING (strategy_id) LEFT JOIN rg USING (strategy_id) LEFT JOIN wf USING (strategy_id) JOIN pc USING (strategy_id) JOIN (SELECT * FROM load WHERE term='market') USING (strategy_id), hc""")))
def evaluation_report(spark, sf_dir):
    """One JSON document per strategy with all of the evaluation's parts, read back for its main figures."""
    m, facts = market(spark, sf_dir), compiled(known(spark, sf_dir), "known")
    panel, rets = panel_and_periods(spark, sf_dir, m, facts)
    runs = compiled(backtest.without_feedback(panel, rets, DATES, VARIANTS, [_ALL, *SPANS]), "runs")
    r = runs.filter("run = 'all'").drop("run")
    trials = resample.random_portfolios(compiled(members(spark, sf_dir, m), "universe"), rets, DATES, _LEGS, _ITER)
    factors = metrics.ols(r.join(factor_returns(spark, sf_dir, m, facts), "as_of"), "ret", ["market", "momentum", "value", "quality"])
    year = (F.col("as_of") >= F.lit(date(2000, 1, 1))) & (F.col("as_of") < F.lit(date(2001, 1, 1)))
    middle = framed_by(spark, sf_dir, facts.filter(year), m, rolling.of_market(m)[1])
    folds = evaluate.walk_forward_runs(runs.filter("run <> 'all'"), len(SPANS))
    placed = resample.percentile_of(trials, own_sharpe(r, VARIANTS))
    doc = evaluate.report(r, benchmark_returns(spark, sf_dir), backtest.equal_weight_market(rets, DATES), folds, placed, factors, correlations(middle), years=YEARS)
    d = doc.select("strategy_id", "passed", F.from_json("document", evaluate.REPORT).alias("d"))
    bull = F.get(F.filter("d.regimes", lambda g: g.regime == "Bull"), F.lit(0))
    loading = F.get(F.filter("d.factors.loadings", lambda g: g.term == "market"), F.lit(0))
    m = "d.metrics"
    return d.select(
        "strategy_id", f"{m}.n", f"{m}.sharpe", f"{m}.cagr", f"{m}.max_drawdown", f"{m}.psr", "d.regression.beta", F.coalesce(bull.n, F.lit(0)).alias("bull_periods"), bull.avg_ret.alias("bull_ret"), "d.walk_forward.folds", "d.walk_forward.consistency",
        F.col("d.monte_carlo.percentile").alias("percentile"), loading.coef.alias("market_loading"), F.col("d.factors.r2").alias("factor_r2"), F.size("d.correlations").cast("long").alias("n_pairs"), F.coalesce(F.array_max(F.transform("d.correlations", lambda c: F.abs(c.corr))), F.lit(0.0)).alias("strongest_pair"), "passed",
    )


@query("h09_h10_normal_functions", f"""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, round({cdf_sql('((l_quantity-25)/10)')},9) AS cdf, round({ppf_sql('(l_quantity/51)')},7) AS ppf FROM lineitem""")
def normal_functions(spark, sf_dir):
    q = F.col("l_quantity")
    return domain.read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", F.round(scalar.normal_cdf((q - 25) / 10), 9).alias("cdf"), F.round(scalar.normal_ppf(q / 51), 7).alias("ppf"))


@query("h12_hash_draws", f"SELECT o_orderkey, round({_draw(chr(39) + '7' + chr(39), 'o_orderkey::VARCHAR')},12) AS u FROM orders")
def hash_draws(spark, sf_dir):
    return domain.read(spark, sf_dir, "orders").select("o_orderkey", F.round(scalar.draw(7, F.col("o_orderkey")), 12).alias("u"))


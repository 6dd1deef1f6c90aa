"""Queries of live accounts, orders and streams over the order and event tables."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from equiscope.functions.scalar import date_prefix, file_time
from equiscope.operators import tracking
from equiscope.plans import evaluate
from equiscope.plans.catalog import query
from equiscope.plans.queries_panel import rounded
from equiscope.sources import domain
from equiscope.sources.domain_sql import ACCOUNT_OBS, BARS, BENCHMARK, using
from equiscope.sources.stage import scratch
from equiscope.sources.versioned import Versioned
from equiscope.streaming import ingest

SINCE = date(1994, 1, 1)

# rebalance events: an order is one, its lines are the trades
EVENTS = """ln AS (SELECT o_custkey, o_orderkey, o_orderdate, o_orderstatus, o_totalprice, CAST(l_suppkey AS VARCHAR) AS ticker, CASE WHEN l_returnflag='N' THEN 'buy' ELSE 'sell' END AS side, l_extendedprice AS notional, l_discount, l_tax, l_linenumber FROM orders JOIN lineitem ON l_orderkey=o_orderkey),
 ev AS (SELECT CAST(o_custkey AS VARCHAR) AS broker, CAST(o_orderdate AS TIMESTAMP) AS ts, o_orderkey AS event_id, o_orderstatus<>'P' AS executed, o_totalprice AS equity, list_sort(list_distinct(list(ticker))) AS holdings FROM ln GROUP BY ALL),
 last AS (SELECT * FROM ev WHERE executed QUALIFY row_number() OVER (PARTITION BY broker, CAST(ts AS DATE) ORDER BY ts DESC, event_id DESC)=1),
 pr AS (SELECT * FROM (SELECT broker, CAST(ts AS DATE) AS start, CAST(lead(ts) OVER w AS DATE) AS "end", ts AS start_ts, lead(ts) OVER w AS end_ts, holdings, equity AS start_equity, lead(equity) OVER w AS end_equity FROM last WINDOW w AS (PARTITION BY broker ORDER BY ts)) WHERE start<"end")"""
FORWARD = """fwd AS (SELECT ticker, CAST(unnest(generate_series(CASE WHEN p IS NULL THEN least(DATE '1994-01-01',date) ELSE p+1 END, date, INTERVAL 1 DAY)) AS DATE) AS day, date AS bar_date, close FROM (SELECT *, lag(date) OVER (PARTITION BY ticker ORDER BY date) AS p FROM bars))"""
MODEL = """mdl AS (SELECT broker, start, "end", avg(b.close/nullif(a.close,0)-1) AS model_ret, count(*) AS n_held, count(b.close/nullif(a.close,0)) AS n_priced FROM (SELECT broker, start, "end", unnest(holdings) AS ticker FROM pr) h LEFT JOIN fwd a ON a.ticker=h.ticker AND a.day=h.start LEFT JOIN fwd b ON b.ticker=h.ticker AND b.day=h."end" GROUP BY ALL)"""
MARKET = """mk AS (SELECT CAST(unnest(generate_series(CASE WHEN p IS NULL THEN least(DATE '1994-01-01',date) ELSE p+1 END, date, INTERVAL 1 DAY)) AS DATE) AS day, close FROM (SELECT *, lag(date) OVER (ORDER BY date) AS p FROM bench))"""
FLOWS = """fl AS (SELECT CAST(o_custkey AS VARCHAR) AS broker, CAST(o_orderdate AS DATE) AS date, CASE WHEN o_orderkey%2=0 THEN CAST(o_orderdate AS TIMESTAMP)+INTERVAL 1 HOUR END AS ts, floor(o_totalprice/50) AS amount FROM orders WHERE o_orderstatus='P')"""


def lines(spark, sf_dir):
    o = domain.read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_orderstatus", "o_totalprice")
    l = domain.read(spark, sf_dir, "lineitem")
    side = F.when(F.col("l_returnflag") == "N", "buy").otherwise("sell")
    return o.join(l, F.col("l_orderkey") == F.col("o_orderkey")).select(*o.columns, F.col("l_suppkey").cast("string").alias("ticker"), side.alias("side"), F.col("l_extendedprice").alias("notional"), "l_discount", "l_tax", "l_linenumber", "l_quantity", "l_partkey")


def events(spark, sf_dir):
    g = lines(spark, sf_dir).groupBy(F.col("o_custkey").cast("string").alias("broker"), F.col("o_orderdate").alias("ts"), F.col("o_orderkey").alias("event_id"), (F.col("o_orderstatus") != "P").alias("executed"), F.col("o_totalprice").alias("equity"))
    return g.agg(F.array_sort(F.collect_set("ticker")).alias("holdings"))


def forward(spark, sf_dir):
    return tracking.daily_forward(domain.bars(spark, sf_dir), SINCE)


def market(spark, sf_dir):
    b = domain.benchmark(domain.bars(spark, sf_dir)).withColumn("ticker", F.lit("bench"))
    return tracking.daily_forward(b, SINCE).select("day", "close")


def flows(spark, sf_dir):
    o = domain.read(spark, sf_dir, "orders").filter("o_orderstatus = 'P'")
    ts = F.when(F.col("o_orderkey") % 2 == 0, F.expr("timestampadd(HOUR, 1, o_orderdate)"))
    return o.select(F.col("o_custkey").cast("string").alias("broker"), F.to_date("o_orderdate").alias("date"), ts.alias("ts"), F.floor(F.col("o_totalprice") / 50).cast("double").alias("amount"))


@query("t04_detected_flows", using(ACCOUNT_OBS, query="SELECT broker, CAST(ts AS DATE) AS date, event_id, round(equity-pe,2) AS amount FROM (SELECT *, lag(equity) OVER w AS pe, lag(ts) OVER w AS pt FROM account_obs WINDOW w AS (PARTITION BY broker ORDER BY ts, event_id)) WHERE CAST(pt AS DATE)=CAST(ts AS DATE) AND abs(equity-pe)>=500 AND abs(equity-pe)>=0.02*pe"))
def detected_flows(spark, sf_dir):
    obs = domain.account_obs(spark, sf_dir)
    found = tracking.detected_flows(obs)
    return found.join(obs.select("broker", "ts", "event_id"), ["broker", "ts"]).select("broker", "date", "event_id", "amount")


@query("t16_rebalance_events", using(EVENTS, query="SELECT broker, CAST(ts AS DATE) AS date, event_id, equity, array_to_string(holdings, ',') AS holdings FROM last"))
def rebalance_events(spark, sf_dir):
    e = tracking.last_of_day(events(spark, sf_dir))
    return e.select("broker", F.to_date("ts").alias("date"), "event_id", "equity", F.array_join("holdings", ",").alias("holdings"))


@query("t05_model_returns", using(BARS, EVENTS, FORWARD, MODEL, query='SELECT broker, start, "end", round(model_ret,6) AS model_ret, n_held, n_priced FROM mdl'))
def model_returns(spark, sf_dir):
    p = tracking.periods(tracking.last_of_day(events(spark, sf_dir)))
    return rounded(tracking.model_returns(p, forward(spark, sf_dir)), "model_ret").select("broker", "start", "end", "model_ret", "n_held", "n_priced")


LIVE = (BARS, BENCHMARK, EVENTS, FORWARD, MODEL, MARKET, FLOWS, """sm AS (SELECT p.broker, p.start_ts, sum(amount) AS flows FROM pr p JOIN fl f ON f.broker=p.broker AND coalesce(f.ts, CAST(f.date AS TIMESTAMP)+INTERVAL 12 HOUR)>p.start_ts AND coalesce(f.ts, CAST(f.date AS TIMESTAMP)+INTERVAL 12 HOUR)<=p.end_ts GROUP BY ALL),
 lv AS (SELECT p.broker, p.start, p."end", model_ret, end_equity/nullif(start_equity+coalesce(flows,0),0)-1 AS realized_ret, b1.close/nullif(b0.close,0)-1 AS bench_ret, coalesce(flows,0) AS flows, n_held, n_priced FROM pr p LEFT JOIN mdl m ON m.broker=p.broker AND m.start=p.start AND m."end"=p."end" LEFT JOIN sm s ON s.broker=p.broker AND s.start_ts=p.start_ts LEFT JOIN mk b0 ON b0.day=p.start LEFT JOIN mk b1 ON b1.day=p."end")""")


@query("t06_live_periods", using(*LIVE, query="""SELECT broker, start, "end", round(model_ret,6) AS model_ret, round(realized_ret,6) AS realized_ret, round(bench_ret,6) AS bench_ret, round(flows,2) AS flows, concat_ws(',', CASE WHEN model_ret IS NULL THEN 'no_price' END, CASE WHEN n_priced<n_held THEN 'partial' END, CASE WHEN abs(realized_ret-model_ret)>0.05 THEN 'gap' END) AS flags FROM lv"""))
def live_periods(spark, sf_dir):
    p = tracking.periods(tracking.last_of_day(events(spark, sf_dir)))
    v = tracking.live_periods(p, forward(spark, sf_dir), market(spark, sf_dir), flows(spark, sf_dir))
    return rounded(rounded(v, "model_ret", "realized_ret", "bench_ret"), "flows", digits=2).select("broker", "start", "end", "model_ret", "realized_ret", "bench_ret", "flows", F.concat_ws(",", "flags").alias("flags"))


@query("t08_cumulative_live", using(*LIVE, query="SELECT broker, count(*) AS n, product(1+model_ret)-1 AS cum_model, product(1+realized_ret)-1 AS cum_realized, product(1+bench_ret)-1 AS cum_bench FROM lv WHERE model_ret IS NOT NULL AND realized_ret IS NOT NULL AND bench_ret IS NOT NULL GROUP BY broker"))
def cumulative_live(spark, sf_dir):
    p = tracking.periods(tracking.last_of_day(events(spark, sf_dir)))
    v = tracking.live_periods(p, forward(spark, sf_dir), market(spark, sf_dir), flows(spark, sf_dir))
    return tracking.cumulative(v)


_ORD = """ot AS (SELECT CAST(o_custkey AS VARCHAR) AS broker, CAST(o_orderdate AS DATE) AS date, ticker, side, notional, CASE WHEN l_linenumber%3<>0 THEN f.close*(1+l_tax*0.01) END AS ap, f.close*(1+l_discount*0.1) AS fp, f.close AS c FROM ln JOIN fwd f USING (ticker) WHERE f.day=CAST(o_orderdate AS DATE))"""


@query("t07_execution_costs", using(BARS, EVENTS, FORWARD, _ORD, query="""SELECT broker, date, count(*) AS n, round(sum(notional),4) AS notional, round(sum(sg*(fp/c-1)*notional)/sum(notional)*10000,4) AS total_bps, round(sum(CASE WHEN ap IS NOT NULL THEN sg*(ap/c-1)*notional END)/sum(CASE WHEN ap IS NOT NULL THEN notional END)*10000,4) AS timing_bps, round(sum(CASE WHEN ap IS NOT NULL THEN sg*(fp/ap-1)*notional END)/sum(CASE WHEN ap IS NOT NULL THEN notional END)*10000,4) AS slippage_bps FROM (SELECT *, CASE WHEN side='buy' THEN 1 ELSE -1 END AS sg FROM ot) GROUP BY ALL"""))
def execution_costs(spark, sf_dir):
    f = forward(spark, sf_dir)
    o = lines(spark, sf_dir).select(F.col("o_custkey").cast("string").alias("broker"), F.to_date("o_orderdate").alias("date"), "ticker", "side", "notional", "l_discount", "l_tax", "l_linenumber")
    o = o.join(f.select("ticker", F.col("day").alias("date"), "close"), ["ticker", "date"])
    o = o.withColumns({"arrival_price": F.when(F.col("l_linenumber") % 3 != 0, F.col("close") * (1 + F.col("l_tax") * 0.01)), "fill_price": F.col("close") * (1 + F.col("l_discount") * 0.1)}).drop("close")
    return rounded(tracking.execution_costs(o, f), "notional", "total_bps", "timing_bps", "slippage_bps", digits=4)


_ACC = """cur AS (SELECT o_custkey AS account, ticker, sum(notional) AS value FROM ln WHERE o_orderdate<TIMESTAMP '1998-01-01' GROUP BY ALL), siz AS (SELECT account, sum(value) AS equity FROM cur GROUP BY account),
 tgt AS (SELECT account, ticker, CASE WHEN account%2=0 THEN w/sum(w) OVER (PARTITION BY account) END AS weight FROM (SELECT *, row_number() OVER (PARTITION BY account ORDER BY round(w,2) DESC, ticker) AS r FROM (SELECT o_custkey AS account, ticker, sum(notional) AS w FROM ln WHERE o_orderdate<TIMESTAMP '2000-01-01' GROUP BY ALL)) WHERE r<=4)"""


def _accounts(spark, sf_dir):
    from pyspark.sql import Window

    ln = lines(spark, sf_dir).withColumnRenamed("o_custkey", "account")
    before = lambda d: ln.filter(F.col("o_orderdate") < F.lit(d).cast("timestamp_ntz"))
    cur = before("1998-01-01").groupBy("account", "ticker").agg(F.sum("notional").alias("value"))
    w = Window.partitionBy("account")
    t = before("2000-01-01").groupBy("account", "ticker").agg(F.sum("notional").alias("w"))
    t = t.withColumn("r", F.row_number().over(w.orderBy(F.round("w", 2).desc(), "ticker"))).filter("r <= 4")
    return cur, t.select("account", "ticker", F.when(F.col("account") % 2 == 0, F.col("w") / F.sum("w").over(w)).alias("weight"))


@query("t01_t02_rebalance_orders", using(EVENTS, _ACC, query="""SELECT account, ticker, CASE WHEN kind IN ('exit','trim') THEN 'sell' ELSE 'buy' END AS side, round(abs(gap),4) AS notional, kind FROM (SELECT *, CASE WHEN tv IS NULL THEN 'exit' WHEN gap < -0.05*want THEN 'trim' WHEN gap > 0.05*want THEN CASE WHEN now=0 THEN 'entry' ELSE 'buy' END ELSE 'hold' END AS kind FROM
 (SELECT account, ticker, t.tv, coalesce(c.value,0) AS now, coalesce(t.tv,0) AS want, coalesce(t.tv,0)-coalesce(c.value,0) AS gap FROM cur c FULL JOIN (SELECT t.account, t.ticker, coalesce(weight,1.0::DOUBLE/n)*equity AS tv FROM (SELECT *, count(*) OVER (PARTITION BY account) AS n FROM tgt) t JOIN siz USING (account)) t USING (account, ticker))) WHERE kind<>'hold'"""))
def rebalance_orders(spark, sf_dir):
    cur, tgt = _accounts(spark, sf_dir)
    return rounded(tracking.rebalance_orders(cur, tgt, cur.groupBy("account").agg(F.sum("value").alias("equity"))), "notional", digits=4)


@query("t03_sizing_base", "SELECT c_custkey AS account, round(greatest(20000+c_acctbal-greatest(c_acctbal-3000,0)-500,0),6) AS base FROM customer")
def sizing_base(spark, sf_dir):
    c = domain.read(spark, sf_dir, "customer")
    cash = F.col("c_acctbal")
    return c.select(F.col("c_custkey").alias("account"), F.round(tracking.sizing_base(20000 + cash, cash, F.lit(3000.0), F.lit(500.0)), 6).alias("base"))


@query("h21_sizing_label", using(EVENTS, _ACC, query="SELECT account, CASE WHEN bool_and(abs(coalesce(weight,1.0::DOUBLE/n)-1.0::DOUBLE/n)<1e-9) THEN 'equal' ELSE 'weighted' END AS label FROM (SELECT *, count(*) OVER (PARTITION BY account) AS n FROM tgt) GROUP BY account"))
def sizing_labels(spark, sf_dir):
    from pyspark.sql import Window

    n = F.count(F.lit(1)).over(Window.partitionBy("account"))
    return tracking.sizing_label(_accounts(spark, sf_dir)[1].withColumn("weight", F.coalesce("weight", 1 / n)))


_LOT = "lt AS (SELECT l_suppkey AS account, CAST(l_partkey AS VARCHAR) AS ticker, o_orderkey*10+l_linenumber AS k, sum(l_quantity) AS units, round(sum(l_extendedprice)/sum(l_quantity),6) AS open_rate FROM orders JOIN lineitem ON l_orderkey=o_orderkey GROUP BY ALL)"


def _lots(spark, sf_dir):
    l = domain.read(spark, sf_dir, "lineitem")
    g = l.groupBy(F.col("l_suppkey").alias("account"), F.col("l_partkey").cast("string").alias("ticker"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("lot_id"))
    return g.agg(F.sum("l_quantity").alias("units"), F.round(F.sum("l_extendedprice") / F.sum("l_quantity"), 6).alias("open_rate"))


@query("t09_lot_trims", using(_LOT.replace("orders JOIN lineitem ON l_orderkey=o_orderkey", "lineitem").replace("o_orderkey", "l_orderkey"), query="""SELECT account, ticker, k AS lot_id, round(least(cap,greatest(want-before,0)),6) AS sold FROM (SELECT *, coalesce(sum(cap) OVER (PARTITION BY account, ticker ORDER BY open_rate DESC, units DESC, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),0) AS before FROM (SELECT lt.*, CASE WHEN units*0.999>=0.001 THEN units*0.999 ELSE 0 END AS cap, w.want FROM lt JOIN (SELECT account, ticker, 0.6*sum(units) AS want FROM lt GROUP BY ALL) w USING (account, ticker))) WHERE round(least(cap,greatest(want-before,0)),6)>=0.001"""))
def lot_trims(spark, sf_dir):
    lots = _lots(spark, sf_dir)
    return tracking.lot_trims(lots, lots.groupBy("account", "ticker").agg((0.6 * F.sum("units")).alias("want")))


@query("t10_clamped_buys", using("w AS (SELECT l_suppkey AS account, l_orderkey*10+l_linenumber AS k, sum(l_extendedprice) AS want FROM lineitem GROUP BY ALL)", query="""SELECT account, k, round(want,4) AS want, round(least(want,cash-before),4) AS bought FROM (SELECT w.*, c.cash, coalesce(sum(want) OVER (PARTITION BY account ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),0) AS before FROM w JOIN (SELECT s_suppkey AS account, 500000.0::DOUBLE+s_acctbal AS cash FROM supplier) c USING (account) WHERE want>=1) WHERE least(want,cash-before)>=1"""))
def clamped_buys(spark, sf_dir):
    l = domain.read(spark, sf_dir, "lineitem")
    wants = l.groupBy(F.col("l_suppkey").alias("account"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("k")).agg(F.sum("l_extendedprice").alias("want"))
    cash = domain.read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("account"), (500000.0 + F.col("s_acctbal")).alias("cash"))
    return rounded(tracking.clamped_buys(wants, cash, ["k"]), "want", "bought", digits=4)


@query("t11_account_rollup", """SELECT account, round(credit-pend,4) AS cash, round(held+mir+pend,4) AS invested, round(pnl,4) AS pnl, round(credit+held+mir+pnl,4) AS equity FROM (SELECT l_suppkey AS account, 1000.0::DOUBLE AS credit, sum(CASE WHEN l_returnflag='N' THEN l_extendedprice ELSE 0 END) AS held, sum(CASE WHEN l_returnflag='A' THEN l_extendedprice+l_quantity-l_tax ELSE 0 END) AS mir,
 coalesce(sum(CASE WHEN l_linenumber<>1 THEN l_quantity+l_tax END) FILTER (l_returnflag='R'),0) AS pend, sum(CASE WHEN l_returnflag='N' THEN l_discount WHEN l_returnflag='A' THEN l_discount+l_tax ELSE 0 END) AS pnl FROM lineitem GROUP BY l_suppkey)""")
def account_rollup(spark, sf_dir):
    """Nested account documents made of an account's lines, rolled up inside their arrays."""
    l = domain.read(spark, sf_dir, "lineitem")
    flag = F.col("l_returnflag")
    profit = F.struct(F.col("l_discount").alias("pnL"))
    odd = F.col("l_linenumber") % 2 == 1
    position = F.struct(F.col("l_extendedprice").alias("amount"), F.when(odd, F.col("l_discount")).alias("pnL"), F.when(~odd, profit).alias("unrealizedPnL"))
    mirror = F.struct(F.array(position).alias("positions"), F.col("l_quantity").alias("availableAmount"), F.col("l_tax").alias("closedPositionsNetProfit"))
    order = F.struct(F.col("l_quantity").alias("amount"), (F.col("l_linenumber") == 1).cast("int").alias("mirrorID"), F.col("l_tax").alias("totalExternalCosts"))
    docs = l.groupBy(F.col("l_suppkey").alias("account")).agg(
        F.collect_list(F.when(flag == "N", position)).alias("positions"), F.collect_list(F.when(flag == "A", mirror)).alias("mirrors"), F.collect_list(F.when(flag == "R", order)).alias("ordersForOpen")
    )
    docs = docs.withColumns({"credit": F.lit(1000.0), "orders": F.array().cast("array<struct<amount:double>>")})
    return rounded(tracking.account_rollup(docs), "cash", "invested", "pnl", "equity", digits=4)


@query("t12_position_values", "SELECT l_suppkey AS account, CAST(l_partkey AS VARCHAR) AS ticker, round(sum(l_extendedprice),4) AS value, count(*) AS n_lots FROM lineitem GROUP BY ALL")
def position_values(spark, sf_dir):
    l = domain.read(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("account"), F.col("l_partkey").cast("string").alias("ticker"), F.col("l_extendedprice").alias("amount"))
    return rounded(tracking.position_values(l), "value", digits=4)


_VAL = "vp AS (SELECT l_suppkey AS account, CAST(l_partkey AS VARCHAR) AS ticker, q AS quantity, CASE WHEN l_partkey%3<>0 AND p_retailprice>0 THEN p_retailprice WHEN l_partkey%5<>0 THEN p_retailprice+1 ELSE c END AS price FROM (SELECT l_suppkey, l_partkey, sum(l_quantity) AS q, round(avg(l_discount),4)+1 AS c FROM lineitem GROUP BY ALL) JOIN part ON p_partkey=l_partkey WHERE l_partkey%7<>0)"


def _valued(spark, sf_dir):
    l, p = domain.read(spark, sf_dir, "lineitem"), domain.read(spark, sf_dir, "part")
    g = l.groupBy(F.col("l_suppkey").alias("account"), "l_partkey").agg(F.sum("l_quantity").alias("q"), (F.round(F.avg("l_discount"), 4) + 1).alias("c"))
    pos = g.select("account", F.col("l_partkey").cast("string").alias("ticker"), F.when(F.col("l_partkey") % 7 != 0, F.col("q")).otherwise(0.0).cast("string").alias("quantity"), F.col("c").cast("string").alias("average_buy_price"))
    k = F.col("p_partkey")
    q = p.select(k.cast("string").alias("ticker"), F.when(k % 3 != 0, F.col("p_retailprice").cast("string")).otherwise("0.0000").alias("last_trade_price"), F.when(k % 5 != 0, (F.col("p_retailprice") + 1).cast("string")).otherwise("").alias("last_extended_hours_trade_price"))
    return tracking.valued_positions(pos, q)


@query("t13_valued_positions", using(_VAL, query="SELECT account, ticker, quantity, round(price,6) AS price, round(quantity*price,4) AS value FROM vp"))
def valued_positions(spark, sf_dir):
    return rounded(rounded(_valued(spark, sf_dir), "price"), "value", digits=4)


@query("t14_stop_levels", using(_VAL, query="SELECT account, ticker, CAST(floor(quantity) AS BIGINT) AS shares, floor(round(price*0.92*100,6)+0.5)/100 AS stop_price FROM vp WHERE floor(quantity)>0"))
def stop_levels(spark, sf_dir):
    return tracking.stop_levels(_valued(spark, sf_dir), 0.08)


@query("t15_resolvable_picks", using(EVENTS, _ACC, query="SELECT account, ticker, round(weight/sum(weight) OVER (PARTITION BY account),6) AS weight FROM (SELECT account, ticker, 0.25::DOUBLE AS weight FROM tgt WHERE CAST(ticker AS BIGINT)%10<>9)"))
def resolvable_picks(spark, sf_dir):
    picks = _accounts(spark, sf_dir)[1].withColumn("weight", F.lit(0.25))
    known = domain.sectors(spark, sf_dir).filter(F.col("ticker").cast("long") % 10 != 9).select("ticker")
    some = picks.join(known, "ticker", "left_semi").select("account").distinct()
    return rounded(tracking.resolvable_picks(picks.join(some, "account", "left_semi"), known), "weight")


@query("s18_s19_rebalance_logs", using(EVENTS, """tr AS (SELECT o_orderkey AS event_id, o_orderstatus<>'P' AS executed, count(*) AS n_orders, round(sum(notional),4) AS notional, count(*) FILTER (side='buy') AS buys FROM ln GROUP BY ALL)""", query="SELECT broker, strftime(ts,'%Y-%m-%d') AS date, executed, round(equity,4) AS equity, array_to_string(holdings, ',') AS holdings, n_orders, notional, buys, len(holdings)::BIGINT AS n_weights FROM ev JOIN tr USING (event_id, executed)"))
def rebalance_logs(spark, sf_dir):
    """Events written as one JSON document each, with orders and weights, and read back from it as drifting documents are."""
    ln = lines(spark, sf_dir)
    traded = ln.groupBy(F.col("o_orderkey").alias("event_id")).agg(F.array_sort(F.collect_list(F.struct("ticker", "side", "notional"))).alias("orders"))
    weights = F.map_from_arrays("holdings", F.transform("holdings", lambda h: 1 / F.size("holdings")))
    r = tracking.read_logs(tracking.log_documents(events(spark, sf_dir).join(traded, "event_id").withColumn("weights", weights)))
    total = F.aggregate("orders", F.lit(0.0), lambda a, o: a + o.notional)
    return r.select(
        "broker", F.col("date").cast("string").alias("date"), "executed", F.round("equity", 4).alias("equity"), F.array_join("holdings", ",").alias("holdings"), F.size("orders").cast("long").alias("n_orders"),
        F.round(total, 4).alias("notional"), F.size(F.filter("orders", lambda o: o.side == "buy")).cast("long").alias("buys"), F.size(F.map_keys("weights")).cast("long").alias("n_weights"),
    )


@query("s20_ledger", using(ACCOUNT_OBS, query="SELECT broker, CAST(ts AS DATE) AS date, round(equity-pe,2) AS amount, CASE WHEN CAST(broker AS BIGINT)%2=0 THEN 'seen' ELSE '' END AS note, true AS inferred, ts FROM (SELECT *, lag(equity) OVER w AS pe, lag(ts) OVER w AS pt FROM account_obs WINDOW w AS (PARTITION BY broker ORDER BY ts, event_id)) WHERE CAST(pt AS DATE)=CAST(ts AS DATE) AND abs(equity-pe)>=500 AND abs(equity-pe)>=0.02*pe"))
def ledger(spark, sf_dir):
    """A ledger seeded from detected flows; asked again with others, it keeps what is stored."""
    found = tracking.detected_flows(domain.account_obs(spark, sf_dir)).withColumn("note", F.when(F.col("broker").cast("long") % 2 == 0, "seen").otherwise(""))
    at = scratch(spark, "ledger")
    tracking.ledger(spark, at, found)
    return tracking.ledger(spark, at, found.withColumn("amount", F.lit(0.0)))


_RUNS = "lg AS (SELECT o_orderpriority AS experiment_name, o_orderstatus='F' AS used, o_totalprice+CASE WHEN o_orderkey%2=0 THEN 1 ELSE 0 END AS sharpe FROM orders WHERE o_orderkey%3<>0 OR o_orderkey%2=0)"


def _log(spark, sf_dir):
    """A research log of one row per order, to which every second order is logged again with a better result."""
    o, k = domain.read(spark, sf_dir, "orders"), F.col("o_orderkey")
    at = F.col("o_orderdate").cast("timestamp")
    runs = lambda d, more: d.select(
        k.cast("string").alias("experiment_id"), F.col("o_orderpriority").alias("experiment_name"), F.lit("{}").alias("config_json"), at.alias("started_at"), (at + F.expr("interval 1 hour")).alias("completed_at"),
        (F.col("o_orderstatus") == "F").alias("holdout_used"), F.to_json(F.struct((F.col("o_totalprice") + more).alias("sharpe"))).alias("metrics_json"), F.lit("completed").alias("status"),
    )
    return evaluate.append_runs(runs(o.filter(k % 3 != 0), 0), runs(o.filter(k % 2 == 0), 1))


@query("s14_research_log", using(_RUNS, query="SELECT experiment_name, count(*) AS n, round(max(sharpe),2) AS best FROM lg GROUP BY 1"))
def research_log(spark, sf_dir):
    """Runs per experiment and the best of them, from metrics kept as JSON."""
    best = F.try_variant_get(F.try_parse_json("metrics_json"), "$.sharpe", "double")
    return _log(spark, sf_dir).groupBy("experiment_name").agg(F.count(F.lit(1)).alias("n"), F.round(F.max(best), 2).alias("best"))


@query("q13_experiment_budget", using(_RUNS, query="SELECT experiment_name, count(*) AS n, count(*) FILTER (used) AS holdout_used, greatest(2000-count(*),0) AS \"left\", count(*) FILTER (used)=0 AS may_use_holdout FROM lg GROUP BY 1"))
def experiment_budget(spark, sf_dir):
    return evaluate.budgets(_log(spark, sf_dir), 2000)


@query("h15_h16_lenient_times", """SELECT o_orderkey, CASE WHEN o_orderkey%4=0 THEN NULL ELSE CAST(o_orderdate AS DATE) END AS day, CASE WHEN o_orderkey%3=0 THEN CAST(CAST(o_orderdate AS DATE) AS TIMESTAMP)+INTERVAL 12 HOUR ELSE date_trunc('second', o_orderdate) END AS at FROM orders""")
def lenient_times(spark, sf_dir):
    o, k = domain.read(spark, sf_dir, "orders"), F.col("o_orderkey")
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    text = F.when(k % 4 == 0, F.lit("not a date")).otherwise(F.concat(day, F.lit("T00:00:00")))
    name = F.when(k % 3 == 0, F.lit("log.json")).otherwise(F.concat(F.date_format("o_orderdate", "yyyyMMdd_HHmmss"), F.lit("_x.json")))
    return o.select("o_orderkey", date_prefix(text).alias("day"), file_time(name, day).cast("timestamp_ntz").alias("at"))


def _ticks(spark, sf_dir):
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    s = spark.readStream.schema(schema).parquet(f"{sf_dir}/events*.parquet")
    return s.select(F.col("user_id").cast("string").alias("ticker"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("seq"), F.col("value").alias("price"), F.lit(1.0).alias("size"))


@query("x03_streamed_daily_bars", """SELECT ticker, date, round(arg_min(value,(ts,event_id)),6) AS open, max(value) AS high, min(value) AS low, round(arg_max(value,(ts,event_id)),6) AS close, CAST(count(*) AS DOUBLE) AS volume
 FROM (SELECT *, CAST(user_id AS VARCHAR) AS ticker, CAST(ts AS DATE) AS date FROM events) WHERE date+1 <= (SELECT max(ts)-INTERVAL 2 HOUR FROM events) GROUP BY ticker, date""")
def streamed_daily_bars(spark, sf_dir):
    """Daily bars of the event stream, run over what is there; a day counts once the watermark has passed it."""
    at = scratch(spark, "stream")
    return rounded(ingest.drained(ingest.daily_bars(_ticks(spark, sf_dir)), f"{at}/out", f"{at}/state"), "open", "close")


@query("x01_streamed_first_of_day", "SELECT CAST(user_id AS VARCHAR) AS ticker, CAST(ts AS DATE) AS date, count(*)>0 AS seen FROM events GROUP BY ALL")
def streamed_first_of_day(spark, sf_dir):
    """One bar per ticker and day of the stream, whatever the duplicates."""
    at = scratch(spark, "stream")
    s = ingest.bar_stream(_ticks(spark, sf_dir).withColumn("date", F.to_date("ts")).select("ticker", "date", "ts"))
    return ingest.drained(s, f"{at}/out", f"{at}/state").select("ticker", "date", F.lit(True).alias("seen"))


@query("x02_streamed_fact_upsert", "SELECT CAST(user_id AS VARCHAR) AS ticker, event_type AS field, arg_max(value,(ts,event_id)) AS value FROM events GROUP BY ALL")
def streamed_fact_upsert(spark, sf_dir):
    """The last value of each (ticker, field), upserted batch by batch."""
    at = scratch(spark, "stream")
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    s = spark.readStream.schema(schema).parquet(f"{sf_dir}/events*.parquet").select(F.col("user_id").cast("string").alias("ticker"), F.col("event_type").alias("field"), "value", "ts", "event_id")
    q = s.writeStream.foreachBatch(ingest.upsert_facts(f"{at}/table", ["ticker", "field"], ["ts", "event_id"])).option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    return ingest.current_facts(spark.read.parquet(f"{at}/table"), ["ticker", "field"], ["ts", "event_id"]).select("ticker", "field", "value")


_FACT_LOG = "ticker string, field string, value double, ts timestamp_ntz, event_id bigint"


@query("x02_compacted_while_streaming", "SELECT CAST(user_id AS VARCHAR) AS ticker, event_type AS field, arg_max(value,(ts,event_id)) AS value FROM events GROUP BY ALL")
def compacted_while_streaming(spark, sf_dir):
    """The same table under versions, compacted while batches come: every second batch, and once more at the end."""
    at = scratch(spark, "stream")
    e = domain.read(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("ticker"), F.col("event_type").alias("field"), "value", F.col("ts").cast("timestamp_ntz").alias("ts"), "event_id")
    e.repartitionByRange(6, "ts", "event_id").write.parquet(f"{at}/in")
    table, keys, order = Versioned(spark, f"{at}/table", _FACT_LOG), ["ticker", "field"], ["ts", "event_id"]
    s = spark.readStream.schema(e.schema).option("maxFilesPerTrigger", 1).parquet(f"{at}/in")
    s.writeStream.foreachBatch(ingest.upsert_versioned(table, keys, order, compact_after=2)).option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start().awaitTermination()
    ingest.compact(table, keys, order)
    table.clean(keep=1)
    return table.read().select("ticker", "field", "value")

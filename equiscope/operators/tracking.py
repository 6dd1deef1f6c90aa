"""Live accounts against the model: logs, cash flows, periods, execution costs, orders and lots."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from equiscope.functions.scalar import bps, file_time, first_positive, signed


def variant_chain(doc: Column, kind: str, *paths: str) -> Column:
    """The first path of a document that holds a value of the kind."""
    return F.coalesce(*(F.try_variant_get(doc, p, kind) for p in paths))


def read_logs(texts: DataFrame) -> DataFrame:
    """(broker, ts, date, executed, equity, holdings, orders, weights) from (name, text) of log documents whose schema drifts.

    account may be an object or a string, equity may stand in three places, holdings may be a list of names or the keys of an
    object; a document that is no JSON is dropped.
    """
    d = texts.withColumn("doc", F.try_parse_json("text")).filter("doc is not null")
    g = lambda kind, *paths: variant_chain(F.col("doc"), kind, *paths)
    is_object = F.try_variant_get(F.col("doc"), "$.account", "map<string,variant>").isNotNull()
    label = F.coalesce(g("string", "$.broker", "$.account.broker"), F.when(~is_object, g("string", "$.account")))
    mode = g("string", "$.mode")
    broker = F.when(label.isNull() | (label == "alpaca"), F.when(mode == "live", "alpaca-live").otherwise("alpaca-paper")).otherwise(label)
    day = g("string", "$.date")
    names = F.coalesce(g("array<string>", "$.picks", "$.holdings"), F.array_sort(F.map_keys(F.try_variant_get(F.col("doc"), "$.holdings", "map<string,variant>"))))
    orders = g("array<struct<ticker:string,side:string,notional:double,status:string,arrival_price:double,fill_price:double>>", "$.orders")
    weights = F.try_variant_get(F.col("doc"), "$.weights", "map<string,double>")
    return d.select(
        broker.alias("broker"), file_time(F.col("name"), day).alias("ts"), F.try_to_timestamp(day).cast("date").alias("date"),
        (~F.coalesce(g("boolean", "$.dry_run"), F.lit(False))).alias("executed"), g("double", "$.account.equity", "$.account_after.total_value", "$.account.portfolio_value").alias("equity"),
        F.coalesce(names, F.array().cast("array<string>")).alias("holdings"), orders.alias("orders"), weights.alias("weights"),
    )


def read_log_files(spark: SparkSession, path: str) -> DataFrame:
    """read_logs of the JSON files under a folder, one document a file; its name gives the time."""
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("name"), F.col("value").alias("text"))
    return read_logs(files)


def log_documents(events: DataFrame) -> DataFrame:
    """(name, text): one JSON document per event (broker, ts, equity, holdings, orders array; weights and screen_results where there are)."""
    extra = [F.col(c) for c in ("weights", "screen_results") if c in events.columns]
    doc = F.struct(
        F.date_format("ts", "yyyy-MM-dd").alias("date"), F.lit("paper").alias("mode"), (~F.col("executed")).alias("dry_run"),
        F.struct(F.col("broker").alias("broker"), F.col("equity").alias("equity")).alias("account"), F.col("holdings").alias("picks"), F.col("orders").alias("orders"), *extra,
    )
    return events.select(F.concat(F.date_format("ts", "yyyyMMdd_HHmmss"), F.lit("_"), F.col("broker"), F.lit(".json")).alias("name"), F.to_json(doc).alias("text"))


def last_of_day(events: DataFrame) -> DataFrame:
    """Executed events with holdings; of one broker and day only the last."""
    w = Window.partitionBy("broker", F.to_date("ts")).orderBy(F.desc("ts"), F.desc("event_id"))
    return events.filter(F.col("executed") & (F.size("holdings") > 0)).withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")


def detected_flows(obs: DataFrame, least: float = 500.0, share: float = 0.02) -> DataFrame:
    """(broker, date, ts, amount): same-day equity jumps of at least `least` and `share` of the equity before."""
    w = Window.partitionBy("broker").orderBy("ts", "event_id")
    o = obs.withColumns({"pe": F.lag("equity").over(w), "pt": F.lag("ts").over(w)}).withColumn("amount", F.col("equity") - F.col("pe"))
    hit = (F.to_date("pt") == F.to_date("ts")) & (F.abs("amount") >= least) & (F.abs("amount") >= share * F.col("pe"))
    return o.filter(hit).select("broker", F.to_date("ts").alias("date"), "ts", F.round("amount", 2).alias("amount"))


def ledger(spark: SparkSession, path: str, detected: DataFrame, again: bool = False) -> DataFrame:
    """The stored cash flows (broker, date, amount, note, inferred, ts), which people edit; where there are none yet, or `again`, seeded.

    detected is (broker, date, ts, amount) and a note where there is one; what it seeds is marked as inferred. Stored as JSON lines.
    """
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if again or not at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
        note = F.col("note") if "note" in detected.columns else F.lit("")
        rows = detected.select("broker", F.col("date").cast("string").alias("date"), "amount", note.alias("note"), F.lit(True).alias("inferred"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("ts"))
        rows.write.mode("overwrite").json(path)
    raw = spark.read.schema("broker string, date string, amount double, note string, inferred boolean, ts string").json(path)
    return raw.select("broker", F.try_to_timestamp("date").cast("date").alias("date"), "amount", F.coalesce("note", F.lit("")).alias("note"), F.coalesce("inferred", F.lit(False)).alias("inferred"), F.try_to_timestamp("ts").cast("timestamp_ntz").alias("ts"))


def periods(events: DataFrame) -> DataFrame:
    """(broker, start, end, start_ts, end_ts, holdings, start_equity, end_equity) between consecutive events of a broker."""
    w = Window.partitionBy("broker").orderBy("ts")
    p = events.withColumns({"end_ts": F.lead("ts").over(w), "end_equity": F.lead("equity").over(w)})
    p = p.select("broker", F.to_date("ts").alias("start"), F.to_date("end_ts").alias("end"), F.col("ts").alias("start_ts"), "end_ts", "holdings", F.col("equity").alias("start_equity"), "end_equity")
    return p.filter(F.col("start") < F.col("end"))


def daily_forward(bars: DataFrame, since: date) -> DataFrame:
    """(ticker, day, bar_date, close): for every day the first bar on or after it, so that a forward as-of join is an equi join."""
    prev = F.lag("date").over(Window.partitionBy("ticker").orderBy("date"))
    first = F.coalesce(F.date_add(F.col("prev"), 1), F.least(F.lit(since), F.col("date")))
    return bars.withColumn("prev", prev).select("ticker", F.explode(F.sequence(first, F.col("date"))).alias("day"), F.col("date").alias("bar_date"), "close")


def model_returns(p: DataFrame, forward: DataFrame) -> DataFrame:
    """p with model_ret, n_held, n_priced and flags: the mean return of the available names from start to end."""
    names = p.select("broker", "start", "end", F.explode("holdings").alias("ticker"))
    at = lambda day, name: forward.select("ticker", F.col("day").alias(day), F.col("close").alias(name))
    met = names.join(at("start", "c0"), ["ticker", "start"], "left").join(at("end", "c1"), ["ticker", "end"], "left")
    r = F.try_divide(F.col("c1"), F.col("c0")) - 1
    m = met.groupBy("broker", "start", "end").agg(F.avg(r).alias("model_ret"), F.count(F.lit(1)).alias("n_held"), F.count(r).alias("n_priced"))
    return p.join(m, ["broker", "start", "end"], "left")


def flows_inside(p: DataFrame, flows: DataFrame) -> DataFrame:
    """p with `flows`: what went in after start_ts and by end_ts; a flow without time counts at noon of its day.

    Periods of one broker don't overlap, so a flow belongs to the last period that starts before it, if that has not ended: one
    sorted pass over both, one shuffle on broker, and no pairs of periods and flows.
    """
    none = F.lit(None)
    at = F.coalesce(F.col("ts"), F.expr("timestampadd(HOUR, 12, cast(date as timestamp_ntz))"))
    own = F.struct(*(F.col(c) for c in p.columns if c != "broker"))
    starts = p.select("broker", F.col("start_ts").alias("at"), F.lit(1).alias("kind"), own.alias("own"), none.cast("double").alias("amount"))
    given = flows.select("broker", at.alias("at"), F.lit(0).alias("kind"), none.cast(starts.schema["own"].dataType).alias("own"), "amount")
    # at one time a flow comes before the start, as it is not inside what starts then
    w = Window.partitionBy("broker").orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, 0)
    both = starts.unionByName(given).withColumn("last", F.last(F.when(F.col("kind") == 1, F.struct(F.col("own.start_ts").alias("s"), F.col("own.end_ts").alias("e"))), ignorenulls=True).over(w))
    counted = F.when((F.col("kind") == 0) & (F.col("at") <= F.col("last.e")), F.col("amount"))
    both = both.withColumn("flows", F.coalesce(F.sum(counted).over(Window.partitionBy("broker", F.col("last.s"))), F.lit(0.0)))
    return both.filter("kind = 1").select("broker", "own.*", "flows")


def live_periods(p: DataFrame, forward: DataFrame, market: DataFrame, flows: DataFrame) -> DataFrame:
    """Periods with model, benchmark and realized returns: (end equity) / (start equity + flows inside) - 1, and flags."""
    m = model_returns(flows_inside(p, flows), forward)
    b = lambda day, name: market.select(F.col("day").alias(day), F.col("close").alias(name))
    m = m.join(b("start", "b0"), "start", "left").join(b("end", "b1"), "end", "left")
    m = m.withColumns({"realized_ret": F.try_divide(F.col("end_equity"), F.col("start_equity") + F.col("flows")) - 1, "bench_ret": F.try_divide(F.col("b1"), F.col("b0")) - 1})
    flag = lambda c, name: F.when(F.coalesce(c, F.lit(False)), F.lit(name))
    flags = F.array(flag(F.col("model_ret").isNull(), "no_price"), flag(F.col("n_priced") < F.col("n_held"), "partial"), flag(F.abs(F.col("realized_ret") - F.col("model_ret")) > 0.05, "gap"))
    return m.select("broker", "start", "end", "model_ret", "realized_ret", "bench_ret", "flows", "start_equity", "end_equity", F.filter(flags, lambda x: x.isNotNull()).alias("flags"))


def cumulative(live: DataFrame) -> DataFrame:
    """Per broker the compounded model, realized and benchmark returns over periods that have all three."""
    ok = live.filter("model_ret is not null and realized_ret is not null and bench_ret is not null")
    return ok.groupBy("broker").agg(F.count(F.lit(1)).alias("n"), *((F.product(1 + F.col(f"{c}_ret")) - 1).alias(f"cum_{c}") for c in ("model", "realized", "bench")))


def execution_costs(orders: DataFrame, forward: DataFrame, equity: DataFrame | None = None) -> DataFrame:
    """(broker, date, n, notional, total_bps, timing_bps, slippage_bps, book_bps): fills against the model's close.

    total: fill against close; timing: arrival against close; slippage: fill against arrival. Costs are positive for buys above
    and sells below, weighted by notional; timing and slippage over the notional that has an arrival price.
    """
    o = orders.join(forward.select("ticker", F.col("day").alias("date"), "close"), ["ticker", "date"]).filter("fill_price is not null and close > 0")
    n, side = F.col("notional"), F.col("side")
    has = F.col("arrival_price").isNotNull()
    cost = lambda a, b: signed(side, F.try_divide(F.col(a), F.col(b)) - 1) * n
    g = o.groupBy("broker", "date").agg(
        F.count(F.lit(1)).alias("n"), F.sum(n).alias("notional"), F.sum(cost("fill_price", "close")).alias("total"), F.sum(F.when(has, n)).alias("seen"),
        F.sum(F.when(has, cost("arrival_price", "close"))).alias("timing"), F.sum(F.when(has, cost("fill_price", "arrival_price"))).alias("slip"),
    )
    per = lambda x, y: bps(F.try_divide(F.col(x), F.col(y)))
    out = g.withColumns({"total_bps": per("total", "notional"), "timing_bps": per("timing", "seen"), "slippage_bps": per("slip", "seen")})
    if equity is not None:
        out = out.join(equity.select("broker", "date", "equity"), ["broker", "date"], "left").withColumn("book_bps", per("total", "equity"))
    return out.drop("total", "timing", "slip", "seen", "equity")


def rebalance_orders(current: DataFrame, target: DataFrame, sizing: DataFrame, band: float = 0.05) -> DataFrame:
    """(account, ticker, side, notional, kind, current_value, target_value): exits in full, trims and buys beyond band x target.

    current is (account, ticker, value), target (account, ticker, weight), sizing (account, equity); a null weight shares equally.
    """
    n = F.count(F.lit(1)).over(Window.partitionBy("account"))
    t = target.withColumn("n", n).join(sizing, "account").select("account", "ticker", (F.coalesce(F.col("weight"), 1 / F.col("n")) * F.col("equity")).alias("target_value"))
    both = current.select("account", "ticker", F.col("value").alias("current_value")).join(t, ["account", "ticker"], "full")
    now, want = F.coalesce("current_value", F.lit(0.0)), F.coalesce("target_value", F.lit(0.0))
    gap, edge = want - now, band * want
    kind = F.when(F.col("target_value").isNull(), "exit").when(gap < -edge, "trim").when(gap > edge, F.when(now == 0, "entry").otherwise("buy")).otherwise("hold")
    out = both.withColumns({"kind": kind, "notional": F.round(F.abs(gap), 6)}).filter("kind <> 'hold' and notional > 0")
    return out.select("account", "ticker", F.when(F.col("kind").isin("exit", "trim"), "sell").otherwise("buy").alias("side"), "notional", "kind")


def sizing_base(total: Column, cash: Column, buying_power: Column, reserve: Column) -> Column:
    """What may be invested: the total less cash that can't be used and less the reserve, at least 0."""
    return F.greatest(total - F.greatest(cash - buying_power, F.lit(0.0)) - reserve, F.lit(0.0))


def sizing_label(weights: DataFrame) -> DataFrame:
    """(account, label): equal where every weight is within 1e-9 of 1 / n."""
    n = F.count(F.lit(1)).over(Window.partitionBy("account"))
    same = weights.withColumn("even", F.abs(F.col("weight") - 1 / n) < 1e-9)
    return same.groupBy("account").agg(F.when(F.every("even"), "equal").otherwise("weighted").alias("label"))


def lot_trims(lots: DataFrame, sells: DataFrame) -> DataFrame:
    """(account, ticker, lot_id, units): units to sell of each lot, dearest first, larger first among equals.

    sells is (account, ticker, want) in units; a lot gives at most 99.9 % of itself, and lots that would give under 0.001 none.
    A running sum of what the lots before can give replaces the walk through them.
    """
    w = Window.partitionBy("account", "ticker").orderBy(F.desc("open_rate"), F.desc("units"), "lot_id").rowsBetween(Window.unboundedPreceding, -1)
    cap = F.col("units") * 0.999
    cap = F.when(cap >= 0.001, cap).otherwise(0.0)
    l = lots.join(sells, ["account", "ticker"]).withColumn("cap", cap)
    l = l.withColumn("before", F.coalesce(F.sum("cap").over(w), F.lit(0.0)))
    sold = F.least(F.col("cap"), F.greatest(F.col("want") - F.col("before"), F.lit(0.0)))
    return l.withColumn("sold", F.round(sold, 6)).filter("sold >= 0.001").select("account", "ticker", "lot_id", "sold")


def clamped_buys(wants: DataFrame, cash: DataFrame, order: list[str]) -> DataFrame:
    """Each want of at least 1, in order, cut to the cash that is left; below 1 nothing is bought."""
    w = Window.partitionBy("account").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    x = wants.filter("want >= 1").join(cash, "account").withColumn("before", F.coalesce(F.sum("want").over(w), F.lit(0.0)))
    return x.withColumn("bought", F.round(F.least(F.col("want"), F.col("cash") - F.col("before")), 6)).filter("bought >= 1").drop("before", "cash")


def account_rollup(docs: DataFrame) -> DataFrame:
    """(account, cash, invested, pnl, equity) of nested documents (account, credit, positions, mirrors, ordersForOpen, orders).

    Sums run inside the arrays; a position's profit stands either in pnL or in unrealizedPnL.pnL; copied portfolios add their own
    positions, free amount and closed profit; open orders of the account itself take from its cash.
    """
    total = lambda arr, f: F.aggregate(F.coalesce(arr, F.array().cast("array<double>")) if f is None else F.transform(arr, f), F.lit(0.0), lambda a, x: a + F.coalesce(x, F.lit(0.0)))
    own = lambda p: F.coalesce(p["pnL"], p["unrealizedPnL"]["pnL"], F.lit(0.0))
    n = lambda c: F.coalesce(c, F.lit(0.0))
    held = n(total(F.col("positions"), lambda p: p["amount"]))
    mirrored = n(total(F.col("mirrors"), lambda m: n(total(m["positions"], lambda p: p["amount"])) + n(m["availableAmount"]) - n(m["closedPositionsNetProfit"])))
    pending = n(total(F.filter("ordersForOpen", lambda o: o["mirrorID"] == 0), lambda o: n(o["amount"]) + n(o["totalExternalCosts"]))) + n(total(F.col("orders"), lambda o: o["amount"]))
    pnl = n(total(F.col("positions"), own)) + n(total(F.col("mirrors"), lambda m: n(total(m["positions"], own)) + n(m["closedPositionsNetProfit"])))
    d = docs.select("account", (F.col("credit") - pending).alias("cash"), (held + mirrored + pending).alias("invested"), pnl.alias("pnl"))
    return d.withColumn("equity", F.col("cash") + F.col("invested") + F.col("pnl"))


def position_values(lots: DataFrame) -> DataFrame:
    """(account, ticker, value, n_lots): a name's lots summed."""
    return lots.groupBy("account", "ticker").agg(F.sum("amount").alias("value"), F.count(F.lit(1)).alias("n_lots"))


def valued_positions(positions: DataFrame, quotes: DataFrame) -> DataFrame:
    """(account, ticker, quantity, price, value) from text columns: last trade, else extended hours, else average cost; none at quantity 0."""
    m = positions.join(quotes, "ticker", "left").withColumns({"quantity": F.col("quantity").try_cast("double"), "price": first_positive(F.col("last_trade_price"), F.col("last_extended_hours_trade_price"), F.col("average_buy_price"))})
    return m.filter("quantity > 0").select("account", "ticker", "quantity", "price", (F.col("quantity") * F.col("price")).alias("value"))


def stop_levels(positions: DataFrame, stop: float) -> DataFrame:
    """(account, ticker, shares, stop_price): whole shares, and the price less the stop to the cent, half a cent up.

    A price within a millionth of half a cent counts as half a cent, so that the last digits of a product don't decide.
    """
    cents = F.floor(F.round(F.col("price") * (1 - stop) * 100, 6) + 0.5)
    return positions.select("account", "ticker", F.floor("quantity").cast("long").alias("shares"), (cents / 100).alias("stop_price")).filter("shares > 0")


def resolvable_picks(picks: DataFrame, known: DataFrame) -> DataFrame:
    """Picks that can be traded, weights over what is left; an account left with nothing fails instead of liquidating."""
    left = picks.join(known, "ticker", "left_semi")
    w = Window.partitionBy("account")
    out = left.withColumn("weight", F.col("weight") / F.sum("weight").over(w))
    lost = picks.select("account").distinct().join(left.select("account").distinct(), "account", "left_anti").agg(F.count(F.lit(1)).alias("n"))
    checked = lost.select(F.when(F.col("n") > 0, F.raise_error(F.lit("an account has no tradeable pick"))).otherwise(F.lit(True)).alias("ok"))
    return out.join(F.broadcast(checked), F.col("ok").isNotNull()).drop("ok")

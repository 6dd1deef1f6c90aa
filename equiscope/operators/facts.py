"""Facts from raw filings, membership from events, staleness, seams and gaps."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from equiscope.functions.scalar import clip, growth, ratio
from equiscope.operators import asof
from equiscope.operators.asof import latest_filing
from equiscope.operators.calendar import dates_between


def statement_fields() -> dict[str, Column]:
    """Screening fields of one quarterly filing."""
    c = F.col
    tax = F.coalesce(clip(ratio(c("taxexp"), c("ebt")), 0.0, 0.5), F.lit(0.25))
    cycle = ratio(c("receivables"), c("revenue")) + ratio(c("inventory"), c("cor")) - ratio(c("payables"), c("cor"))
    return {
        "roe": ratio(c("netinc"), c("equity")), "roa": ratio(c("netinc"), c("assets")), "roic": ratio(c("ebit") * (1 - tax), c("invcap")),
        "current_ratio": c("currentratio"), "net_debt_to_ebitda": ratio(c("debtusd") - c("cashnequsd"), c("ebitda")),
        "earnings_yield": ratio(c("netinc"), c("marketcap")), "fcf_yield": ratio(c("fcf"), c("marketcap")),
        "capex_to_revenue": ratio(F.abs(c("capex")), c("revenue")), "rd_to_revenue": ratio(c("rnd"), c("revenue")), "market_cap": c("marketcap"),
        "sga_to_revenue": ratio(c("sgna"), c("revenue")), "sbc_to_revenue": ratio(c("sbcomp"), c("revenue")), "income_quality": ratio(c("ncfo"), c("netinc")),
        "intangibles_to_assets": ratio(c("intangibles"), c("assets")), "cash_conversion_cycle": cycle * 91.25, "ev_to_sales": ratio(c("ev"), 4 * c("revenue")),
    }


def quarterly_facts(filings: DataFrame) -> DataFrame:
    """(ticker, field, value, report_date, observed_at, source) of quarterly filings and their comparisons, dated by the filing.

    Comparisons are with the latest filing of the compared period that was public by then: the period before among those the ticker
    has, the same quarter a year before, and that of the period before. A period that is missing gives no comparison.
    """
    rows = asof.with_compared(filings, compared_periods(), ["revenue", "eps", "sgna"])
    return to_facts(rows, statement_fields() | comparisons(), "calendardate", F.col("datekey").cast("timestamp"), "arq")


def compared_periods() -> dict[str, Column]:
    """What a filing is compared with: the period before (a), the same quarter a year before (b) and that of the period before (c)."""
    year_ago = lambda p: F.when(F.date_format(p, "MM-dd") != "02-29", F.last_day(F.add_months(p, -12)))
    before = F.col("prev_period")
    return {"a": before, "b": year_ago(F.col("calendardate")), "c": year_ago(before)}


def comparisons() -> dict[str, Column]:
    """Fields that compare a filing with those of compared_periods."""
    c = F.col
    return {
        "sga_to_revenue_prior": ratio(c("sgna_a"), c("revenue_a")), "rev_growth_current": growth(c("revenue"), c("revenue_b")), "eps_growth_current": growth(c("eps"), c("eps_b")),
        "rev_growth_prior": growth(c("revenue_a"), c("revenue_c")), "eps_growth_prior": growth(c("eps_a"), c("eps_c")),
    }


def margins() -> dict[str, Column]:
    c = F.col
    return {"gross_margin_current": c("grossmargin"), "op_margin_current": ratio(c("opinc"), c("revenue")), "gross_margin_prior": c("grossmargin_a"), "op_margin_prior": ratio(c("opinc_a"), c("revenue_a"))}


def _compared(filings: DataFrame, parts: int | None = None) -> DataFrame:
    return asof.with_compared(filings, compared_periods(), ["revenue", "eps", "sgna", "grossmargin", "opinc"], parts)


def filing_fields() -> dict[str, Column]:
    return statement_fields() | comparisons() | margins()


def filings_known(filings: DataFrame, dates: list[date], fields: list[str] | None = None, parts: int | None = None) -> DataFrame:
    """(as_of, ticker, a column per field): what filing_facts, facts_as_of and a pivot give, without taking the rows apart.

    A filing stays one row. Per field a running maximum by (report date, observation) over the ticker's filings is what is known from
    it on, until the next one; the dates between are read off. One shuffle on ticker after the comparisons, of rows that are
    as many as filings, and none for the pivot. What is observed after the last date is left out before the windows.
    A row is a ticker with any field at the date; a field that filings don't have is null.
    """
    made = filing_fields()
    names = [f for f in fields or list(made) if f in made]
    seen = _compared(filings.filter(F.col("calendardate") <= F.lit(max(dates))), parts).filter(F.col("datekey") <= F.lit(max(dates)))
    rows = seen.select("ticker", F.col("calendardate").alias("r"), F.col("datekey").alias("o"), *(F.round(made[f].cast("double"), 9).alias(f) for f in names))
    empty = [F.lit(None).cast("double").alias(f) for f in fields or [] if f not in made]
    newest = lambda f: F.max(F.when(F.col(f).isNotNull(), F.struct("r", "o", F.col(f).alias("v"))))
    if len(dates) == 1:  # one date needs no windows: the newest of each field, combined before the shuffle
        one = rows.groupBy("ticker").agg(*(newest(f).alias(f"_{f}") for f in names)).filter(F.coalesce(*(F.col(f"_{f}.r") for f in names)).isNotNull())
        return one.select(F.lit(dates[0]).alias("as_of"), "ticker", *(F.col(f"_{f}.v").alias(f) for f in names), *empty)
    order = Window.partitionBy("ticker").orderBy("o")
    known = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # numbers in place of a struct for each field, which would be several times the row
    rows = rows.withColumn("_key", F.shiftleft(F.unix_date("r").cast("long"), 32) + F.unix_date("o"))
    best = {f"_{f}": F.max_by(f, F.when(F.col(f).isNotNull(), F.col("_key"))).over(known) for f in names}
    until = F.lead("o").over(order)  # of several filings on a day all but the last serve no date
    some = F.max(F.coalesce(*names).isNotNull()).over(known)  # one column: a filter over all of them costs the optimizer a constraint for each mix with their aliases
    rows = rows.withColumns({**best, "_until": until, "_some": some}).filter("_some")
    at = dates_between(dates, F.col("o"), F.col("_until"), low_in=True, high_in=False)
    return rows.select(F.explode(at).alias("as_of"), "ticker", *(F.col(f"_{f}").alias(f) for f in names), *empty)


def filing_facts(filings: DataFrame, parts: int | None = None) -> DataFrame:
    """quarterly_facts, and the margins of a filing and of the period before it, in one pass over the filings."""
    out = to_facts(_compared(filings, parts), filing_fields(), "calendardate", F.col("datekey").cast("timestamp"), "arq")
    return out.withColumn("source", F.when(F.col("field").isin(list(margins())), "ary").otherwise("arq"))


def to_facts(rows: DataFrame, fields: dict[str, Column], report: str, observed: Column, source: str) -> DataFrame:
    wide = rows.select("ticker", F.col(report).alias("report_date"), observed.alias("observed_at"), *(F.round(v.cast("double"), 9).alias(k) for k, v in fields.items()))
    # taken apart by an array, rows stay in the parts they are in; after an unpivot they would be shuffled again
    long = wide.select("ticker", "report_date", "observed_at", F.inline(F.array(*(F.struct(F.lit(k).alias("field"), F.col(k).alias("value")) for k in fields)))).filter("value is not null")
    return long.select("ticker", "field", "value", "report_date", "observed_at", F.lit(source).alias("source"))


def latest_screen(filings: DataFrame, bars: DataFrame, removed: DataFrame | None = None) -> DataFrame:
    """One row per ticker: fields of its newest period's latest filing, revenue growth on the year before, close and volume tail."""
    best = latest_filing(filings)
    w = Window.partitionBy("ticker").orderBy(F.desc("calendardate"))
    top = best.withColumn("_r", F.row_number().over(w)).filter("_r = 1")
    year = best.select("ticker", F.add_months("calendardate", 12).alias("y"), F.col("revenue").alias("rev_y"))
    met = top.join(year, (top["ticker"] == year["ticker"]) & (F.last_day(year["y"]) == top["calendardate"]), "left").drop(year["ticker"])
    out = met.select("ticker", "calendardate", *(F.round(v, 9).alias(k) for k, v in statement_fields().items()), F.round(growth(F.col("revenue"), F.col("rev_y")), 9).alias("revenue_growth"))
    b = bars.withColumn("_r", F.row_number().over(Window.partitionBy("ticker").orderBy(F.desc("date")))).filter("_r <= 20")
    tail = b.groupBy("ticker").agg(F.max_by("close", "date").alias("close"), F.avg("volume").alias("avg_volume_20d"))
    out = out.join(tail, "ticker", "left")
    return out if removed is None else out.join(removed, "ticker", "left_anti")


def stints(events: DataFrame, current: DataFrame, unknown_start: date = date(1957, 3, 4)) -> DataFrame:
    """(ticker, added_date, removed_date) from (date, action, ticker) events and the current list.

    Events go by date, additions before removals. The running number of removals names a stint: its first addition opens it, its
    removal closes it. A stint without addition, or a current name without events, starts at unknown_start.
    """
    w = Window.partitionBy("ticker").orderBy("date", F.when(F.col("action") == "added", 0).otherwise(1)).rowsBetween(Window.unboundedPreceding, -1)
    e = events.filter(F.col("action").isin("added", "removed")).withColumn("stint", F.coalesce(F.count_if(F.col("action") == "removed").over(w), F.lit(0)))
    made = e.groupBy("ticker", "stint").agg(F.min(F.when(F.col("action") == "added", F.col("date"))).alias("a"), F.max(F.when(F.col("action") == "removed", F.col("date"))).alias("removed_date"))
    made = made.select("ticker", F.coalesce("a", F.lit(unknown_start)).alias("added_date"), "removed_date")
    open_ = made.filter("removed_date is null").select("ticker")
    extra = current.select("ticker").distinct().join(open_, "ticker", "left_anti").select("ticker", F.lit(unknown_start).alias("added_date"), F.lit(None).cast("date").alias("removed_date"))
    return made.unionByName(extra)


def staleness(reports: DataFrame, as_of: date, grace: int = 55, active: DataFrame | None = None) -> DataFrame:
    """(ticker, latest, cadence, expected, days_overdue, quarters_behind), worst first, of tickers whose next report is late.

    Cadence is the median gap of distinct report dates, half to even, and must be 45 to 150 days; two dates at least.
    """
    r = reports.select("ticker", "report_date").distinct()
    r = r if active is None else r.join(active, "ticker", "left_semi")
    gap = F.datediff("report_date", F.lag("report_date").over(Window.partitionBy("ticker").orderBy("report_date")))
    s = r.withColumn("gap", gap).groupBy("ticker").agg(F.max("report_date").alias("latest"), F.bround(F.median("gap"), 0).cast("int").alias("cadence"), F.count(F.lit(1)).alias("n"))
    s = s.filter((F.col("n") >= 2) & F.col("cadence").between(45, 150)).withColumn("expected", F.date_add("latest", F.col("cadence") + grace))
    late = s.withColumn("days_overdue", F.datediff(F.lit(as_of), "expected")).filter("days_overdue > 0")
    return late.select("ticker", "latest", "cadence", "expected", "days_overdue", F.floor(F.col("days_overdue") / F.col("cadence") + 1).cast("int").alias("quarters_behind")).orderBy(F.desc("quarters_behind"), F.desc("days_overdue"), "ticker")


def recently_active(bars: DataFrame, days: int) -> DataFrame:
    """(ticker) whose last bar is within days of the newest bar of all."""
    last = bars.groupBy("ticker").agg(F.max("date").alias("last"))
    return last.join(F.broadcast(bars.agg(F.max("date").alias("newest"))), F.datediff("newest", "last") <= days).select("ticker")


def seams(bars: DataFrame, low: float = 0.6, high: float = 1.67) -> DataFrame:
    """(ticker, date, ratio) where a close jumps as at an unadjusted split."""
    r = F.try_divide(F.col("close"), F.lag("close").over(Window.partitionBy("ticker").orderBy("date")))
    return bars.withColumn("ratio", r).filter((F.col("ratio") < low) | (F.col("ratio") > high)).select("ticker", "date", "ratio")


def healed(bars: DataFrame, fresh: DataFrame) -> DataFrame:
    """All bars of tickers with a seam replaced by fresh ones, where there are any."""
    flagged = seams(bars).select("ticker").distinct().join(fresh.select("ticker").distinct(), "ticker")
    return bars.join(flagged, "ticker", "left_anti").unionByName(fresh.join(flagged, "ticker", "left_semi").select(*bars.columns))


def gap_windows(bars: DataFrame, wanted: DataFrame, start: date, end: date) -> DataFrame:
    """(gap_start, gap_end, n, tickers): missing ranges before the first and after the last stored bar, grouped by equal range."""
    have = bars.groupBy("ticker").agg(F.min("date").alias("a"), F.max("date").alias("b"))
    w = wanted.join(have, "ticker", "left")
    none = F.col("a").isNull()
    piece = lambda s, e: F.struct(s.alias("gap_start"), e.alias("gap_end"))
    lo, hi = F.lit(start), F.lit(end)
    ranges = F.array(F.when(none, piece(lo, hi)), F.when(F.col("a") > lo, piece(lo, F.date_sub("a", 1))), F.when(F.col("b") < hi, piece(F.date_add("b", 1), hi)))
    rows = w.select("ticker", F.explode(F.filter(ranges, lambda x: x.isNotNull())).alias("g")).select("ticker", "g.*")
    return rows.groupBy("gap_start", "gap_end").agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list("ticker")).alias("tickers"))


def vendor_facts(records: DataFrame, fields: list[str], lag_days: int, priors: dict[str, str] | None = None, source: str = "vendor") -> DataFrame:
    """Facts from vendor records (ticker, date, fields) known lag_days after their date; priors come from the next older record."""
    w = Window.partitionBy("ticker").orderBy(F.desc("date"))
    rows = records.withColumns({prior: F.lead(now).over(w) for prior, now in (priors or {}).items()}) if priors else records
    names = [*fields, *(priors or {})]
    return to_facts(rows, {n: F.col(n) for n in names}, "date", F.date_add("date", lag_days).cast("timestamp"), source)


def merged_live(annual: DataFrame, quarterly: DataFrame, fields: list[str], yearly: DataFrame | None = None) -> DataFrame:
    """One row per ticker: the newest quarterly values where there are any, else the annual ones; revenue and EPS growth on
    quarters 0/4 and 1/5, EPS only from a positive base. With fewer than five quarters the growth is that of the two newest
    records of yearly (ticker, date, rev_growth, eps_growth)."""
    newest = annual.groupBy("ticker").agg(*(F.max_by(f, "date").alias(f"{f}_y") for f in fields))
    w = Window.partitionBy("ticker").orderBy(F.desc("date"))
    at = lambda c, k: F.max(F.when(F.col("r") == k + 1, F.col(c)))
    q = quarterly.withColumn("r", F.row_number().over(w)).filter("r <= 6").groupBy("ticker").agg(
        F.count(F.lit(1)).alias("n_q"), *(at(f, 0).alias(f"{f}_q") for f in fields), *(at(c, k).alias(f"{c}_{k}") for c in ("revenue", "eps") for k in (0, 1, 4, 5))
    )
    m = newest.join(q, "ticker", "full")
    g = {f"{n}_{tag}": growth(F.col(f"{c}_{a}"), F.col(f"{c}_{b}")) for n, c in (("rev_growth", "revenue"), ("eps_growth", "eps")) for tag, a, b in (("current", 0, 4), ("prior", 1, 5))}
    if yearly is not None:
        y = yearly.withColumn("r", F.row_number().over(w)).filter("r <= 2").groupBy("ticker").agg(*(at(n, k).alias(f"{n}_{tag}_y") for n in ("rev_growth", "eps_growth") for k, tag in enumerate(("current", "prior"))))
        m = m.join(y, "ticker", "left")
        g = {k: F.when(F.coalesce("n_q", F.lit(0)) < 5, F.col(f"{k}_y")).otherwise(v) for k, v in g.items()}
    return m.select("ticker", *(F.coalesce(f"{f}_q", f"{f}_y").alias(f) for f in fields), *(v.alias(k) for k, v in g.items()))

"""Queries of stored tables, fact derivation and data quality."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from equiscope.functions.scalar import date_prefix
from equiscope.operators import asof, facts
from equiscope.plans import load
from equiscope.plans.catalog import query
from equiscope.sources import domain, tables
from equiscope.sources.domain_sql import BARS, MEMBERSHIP, RAW_BARS, SECTORS, STATEMENTS, using
from equiscope.sources.stage import scratch

PRICE_COLS = "ticker, date, open, high, low, close, volume"


def in_region(spark: SparkSession, sf_dir: str, index: str) -> DataFrame:
    return domain.membership(spark, sf_dir).filter(F.col("index_name") == index).select("ticker").distinct()


@query("s01_price_scan", using(BARS, MEMBERSHIP, query=f"SELECT {PRICE_COLS} FROM bars WHERE date BETWEEN DATE '1998-01-01' AND DATE '1998-12-31' AND ticker IN (SELECT ticker FROM membership WHERE index_name='ASIA')"))
def price_scan(spark, sf_dir):
    return tables.prices(domain.bars(spark, sf_dir), in_region(spark, sf_dir, "ASIA"), date(1998, 1, 1), date(1998, 12, 31))


_FACT = """facts AS (SELECT ticker, 'roe' AS field, round(netinc/nullif(equity,0),9) AS value, calendardate AS report_date, CAST(datekey AS TIMESTAMP) AS observed_at FROM statements
 UNION ALL SELECT ticker, 'roa', round(netinc/nullif(assets,0),9), calendardate, CAST(datekey AS TIMESTAMP) FROM statements)"""


@query("s02_fact_scan", using(STATEMENTS, MEMBERSHIP, _FACT, query="SELECT ticker, field, value, report_date, CAST(observed_at AS DATE) AS observed FROM facts WHERE observed_at <= TIMESTAMP '1999-06-30' AND ticker IN (SELECT ticker FROM membership WHERE index_name='EUROPE')"))
def fact_scan(spark, sf_dir):
    f = facts.quarterly_facts(domain.statements(spark, sf_dir)).filter(F.col("field").isin("roe", "roa") & (F.col("observed_at") <= F.lit("1999-06-30").cast("timestamp")))
    return f.join(in_region(spark, sf_dir, "EUROPE"), "ticker", "left_semi").select("ticker", "field", "value", "report_date", F.to_date("observed_at").alias("observed"))


@query("s03_membership_scan", using(MEMBERSHIP, query="SELECT ticker, added_date, removed_date, is_delisted FROM membership WHERE index_name='AMERICA'"))
def membership_scan(spark, sf_dir):
    return domain.membership(spark, sf_dir).filter("index_name = 'AMERICA'").drop("index_name")


@query("s04_historic_members", using(MEMBERSHIP, query="SELECT DISTINCT ticker FROM membership WHERE NOT contains(ticker,'/')"))
def historic_members(spark, sf_dir):
    return tables.historic_members(domain.membership(spark, sf_dir), domain.sectors(spark, sf_dir))


@query("s05_members_overlapping", using(MEMBERSHIP, query="SELECT DISTINCT ticker FROM membership WHERE removed_date IS NULL OR removed_date >= DATE '1999-01-01'"))
def members_overlapping(spark, sf_dir):
    return tables.members_overlapping(domain.membership(spark, sf_dir), date(1999, 1, 1))


@query("s06_sector_lookup", using(SECTORS, MEMBERSHIP, query="SELECT ticker, sector FROM sectors WHERE ticker IN (SELECT ticker FROM membership WHERE is_delisted)"))
def sector_lookup(spark, sf_dir):
    gone = domain.membership(spark, sf_dir).filter("is_delisted").select("ticker")
    return domain.sectors(spark, sf_dir).join(gone, "ticker", "left_semi")


def _batches(spark, sf_dir):
    """Bars of two loads that overlap: all to the end of 1998, and fresher prices from mid-1998 on."""
    b = domain.bars(spark, sf_dir)
    return b.filter(F.col("date") <= F.lit(date(1998, 12, 31))), b.filter(F.col("date") >= F.lit(date(1998, 7, 1))).withColumn("close", F.round(F.col("close") * 1.01, 6))


_TWO = "a AS (SELECT * FROM bars WHERE date <= DATE '1998-12-31'), b AS (SELECT * REPLACE (round(close*1.01,6) AS close) FROM bars WHERE date >= DATE '1998-07-01')"


@query("s07_append_absent_bars", using(BARS, _TWO, query=f"SELECT {PRICE_COLS} FROM a UNION ALL SELECT {PRICE_COLS} FROM b WHERE NOT EXISTS (SELECT 1 FROM a WHERE a.ticker=b.ticker AND a.date=b.date)"))
def append_absent_bars(spark, sf_dir):
    old, new = _batches(spark, sf_dir)
    return old.unionByName(tables.append_absent(old, new, ["ticker", "date"], ["close"]))


@query("s08_upsert_facts", using(STATEMENTS, query="""SELECT ticker, calendardate AS report_date, CAST(strptime(substr(txt,1,10),'%Y-%m-%d') AS DATE) AS observed_at, revenue AS value FROM
 (SELECT ticker, calendardate, CAST(datekey AS VARCHAR) || 'T09:30:00Z' AS txt, revenue, row_number() OVER (PARTITION BY ticker, calendardate ORDER BY datekey DESC) AS rn FROM statements) WHERE rn=1"""))
def upsert_facts(spark, sf_dir):
    s = domain.statements(spark, sf_dir).select("ticker", F.col("calendardate").alias("report_date"), F.concat(F.col("datekey").cast("string"), F.lit("T09:30:00Z")).alias("txt"), F.col("revenue").alias("value"), "datekey")
    s = tables.parsed_observations(s.withColumnRenamed("txt", "observed_at")).withColumn("observed_at", F.to_date("observed_at"))
    first = s.filter(F.datediff("datekey", "report_date") < 100)
    return tables.upsert(first, s, ["ticker", "report_date"], ["datekey"]).drop("datekey")


@query("s09_record_if_changed", using(STATEMENTS, query="""SELECT ticker, report_date, CAST(observed_at AS DATE) AS observed, value FROM (
 SELECT *, row_number() OVER w AS n, lag(value) OVER w AS p FROM (SELECT ticker, calendardate AS report_date, datekey AS observed_at, CASE WHEN revenue > 1e6 THEN NULL ELSE round(revenue/1e5) END AS value FROM statements) WINDOW w AS (PARTITION BY ticker, report_date ORDER BY observed_at)) WHERE n=1 OR value IS DISTINCT FROM p"""))
def record_if_changed(spark, sf_dir):
    v = F.when(~(F.col("revenue") > 1e6), F.round(F.col("revenue") / 1e5))
    obs = domain.statements(spark, sf_dir).select("ticker", F.lit("revenue").alias("field"), F.col("calendardate").alias("report_date"), F.col("datekey").alias("observed_at"), v.alias("value"))
    return tables.changed(obs).select("ticker", "report_date", F.col("observed_at").alias("observed"), "value")


@query("s10_cached_span", using(BARS, query="SELECT ticker, min(date) AS first_date, max(date) AS last_date, count(*) AS n FROM bars GROUP BY ticker"))
def cached_span(spark, sf_dir):
    return tables.cached_span(domain.bars(spark, sf_dir))


@query("s11_invalidate_bars", using(BARS, MEMBERSHIP, query="SELECT ticker, count(*) AS n FROM bars WHERE ticker NOT IN (SELECT ticker FROM membership WHERE is_delisted) GROUP BY ticker"))
def invalidate_bars(spark, sf_dir):
    gone = domain.membership(spark, sf_dir).filter("is_delisted").select("ticker")
    return tables.without(domain.bars(spark, sf_dir), gone).groupBy("ticker").agg(F.count(F.lit(1)).alias("n"))


@query("s12_sector_upsert", using(SECTORS, query="SELECT ticker, coalesce(CASE WHEN CAST(ticker AS BIGINT) % 5 = 0 THEN 'RECLASSIFIED' END, sector) AS sector FROM sectors"))
def sector_upsert(spark, sf_dir):
    s = domain.sectors(spark, sf_dir)
    new = s.filter(F.col("ticker").cast("long") % 5 == 0).select("ticker", F.lit("RECLASSIFIED").alias("sector"))
    return tables.upsert(s, new, ["ticker"], ["sector"])


@query("s13_replace_index", using(MEMBERSHIP, query="""SELECT ticker, index_name, CASE WHEN index_name='ASIA' THEN try_cast(CASE WHEN CAST(ticker AS BIGINT)%4=0 THEN 'soon' ELSE CAST(added_date AS VARCHAR) END AS DATE) ELSE added_date END AS added_date, removed_date FROM membership"""))
def replace_index(spark, sf_dir):
    m = domain.membership(spark, sf_dir).select("ticker", "index_name", "added_date", "removed_date")
    text = F.when(F.col("ticker").cast("long") % 4 == 0, F.lit("soon")).otherwise(F.col("added_date").cast("string"))
    new = m.filter("index_name = 'ASIA'").withColumn("added_date", text)
    at = scratch(spark, "membership")
    tables.replace_index(spark, at, m)
    tables.replace_index(spark, at, new)
    return spark.read.schema(m.schema).parquet(at)


@query("s22_routed_sources", using(BARS, RAW_BARS, query="SELECT ticker, date, close FROM bars WHERE CAST(ticker AS BIGINT)%10<>0 UNION ALL SELECT ticker, date, close FROM raw_bars WHERE CAST(ticker AS BIGINT)%10=0"))
def routed_sources(spark, sf_dir):
    stocks, funds = (f(spark, sf_dir).select("ticker", "date", "close") for f in (domain.bars, domain.raw_bars))
    symbols = domain.sectors(spark, sf_dir).filter(F.col("ticker").cast("long") % 10 == 0).select("ticker")
    return tables.routed(stocks, funds, symbols)


@query("s21_vendor_bars", using(BARS, query="SELECT ticker, date, open, close, volume FROM bars"))
def vendor_bars(spark, sf_dir):
    b = domain.bars(spark, sf_dir)
    at = scratch(spark, "vendor")
    b.select(F.col("ticker").alias("symbol"), F.col("date").cast("string").alias("date"), "open", "close", "volume").write.json(at)
    return tables.vendor_bars(spark, at).select("ticker", "date", "open", "close", "volume")


@query("s23_vendor_fields", """SELECT CAST(s_suppkey AS VARCHAR) AS ticker, s_acctbal AS market_cap, CASE WHEN s_suppkey%3=0 THEN NULL ELSE s_acctbal/100 END AS roe, CAST(NULL AS DOUBLE) AS roa, CAST(s_nationkey AS DOUBLE) AS beta FROM supplier""")
def vendor_fields(spark, sf_dir):
    k = F.col("s_suppkey")
    raw = domain.read(spark, sf_dir, "supplier").select(k.cast("string").alias("ticker"), F.col("s_acctbal").cast("string").alias("marketCap"), F.when(k % 3 == 0, F.lit("n/a")).otherwise((F.col("s_acctbal") / 100).cast("string")).alias("returnOnEquityTTM"), F.col("s_nationkey").alias("beta"))
    return tables.vendor_fields(raw, ["beta"]).select("ticker", "market_cap", "roe", "roa", "beta")


@query("f07_share_classes", using(BARS, query="SELECT ticker, count(*) AS n FROM bars WHERE CAST(ticker AS BIGINT)%9<>4 GROUP BY ticker"))
def share_classes(spark, sf_dir):
    second = domain.sectors(spark, sf_dir).filter(F.col("ticker").cast("long") % 9 == 4).select("ticker")
    return tables.without(domain.bars(spark, sf_dir), second).groupBy("ticker").agg(F.count(F.lit(1)).alias("n"))


@query("f09_recently_active", using(BARS, query="SELECT ticker FROM bars GROUP BY ticker HAVING (SELECT max(date) FROM bars) - max(date) <= 5"))
def recently_active(spark, sf_dir):
    return facts.recently_active(domain.bars(spark, sf_dir), 5)


# quarterly facts in SQL: comparisons by the latest filing public on the row's own date
_PUBLIC = lambda tag, period: f"""{tag} AS (SELECT r.ticker, r.calendardate, r.datekey, arg_max(f.revenue,f.datekey) AS rev_{tag}, arg_max(f.eps,f.datekey) AS eps_{tag}, arg_max(f.sgna,f.datekey) AS sgna_{tag},
  arg_max(f.grossmargin,f.datekey) AS gm_{tag}, arg_max(f.opinc,f.datekey) AS opinc_{tag}
 FROM rws r JOIN statements f ON f.ticker=r.ticker AND f.calendardate={period} AND f.datekey<=r.datekey GROUP BY ALL)"""  # noqa: E731
FACTS = ",\n".join(
    [
        STATEMENTS,
        "prd AS (SELECT ticker, calendardate, lag(calendardate) OVER (PARTITION BY ticker ORDER BY calendardate) AS pp FROM (SELECT DISTINCT ticker, calendardate FROM statements))",
        "rws AS (SELECT s.*, pp, last_day(CAST(s.calendardate - INTERVAL 12 MONTH AS DATE)) AS py, last_day(CAST(pp - INTERVAL 12 MONTH AS DATE)) AS ppy FROM statements s LEFT JOIN prd USING (ticker, calendardate))",
        _PUBLIC("a", "r.pp"), _PUBLIC("b", "r.py"), _PUBLIC("c", "r.ppy"),
        """wide AS (SELECT ticker, calendardate AS report_date, datekey AS observed_at,
 round(netinc/nullif(equity,0),9) AS roe, round(netinc/nullif(assets,0),9) AS roa,
 round(ebit*(1-coalesce(least(greatest(taxexp/nullif(ebt,0),0.0::DOUBLE),0.5::DOUBLE),0.25::DOUBLE))/nullif(invcap,0),9) AS roic, round(currentratio,9) AS current_ratio,
 round((debtusd-cashnequsd)/nullif(ebitda,0),9) AS net_debt_to_ebitda, round(netinc/nullif(marketcap,0),9) AS earnings_yield, round(fcf/nullif(marketcap,0),9) AS fcf_yield,
 round(abs(capex)/nullif(revenue,0),9) AS capex_to_revenue, round(rnd/nullif(revenue,0),9) AS rd_to_revenue, round(marketcap,9) AS market_cap, round(sgna/nullif(revenue,0),9) AS sga_to_revenue,
 round(sbcomp/nullif(revenue,0),9) AS sbc_to_revenue, round(ncfo/nullif(netinc,0),9) AS income_quality, round(intangibles/nullif(assets,0),9) AS intangibles_to_assets,
 round((receivables/nullif(revenue,0)+inventory/nullif(cor,0)-payables/nullif(cor,0))*91.25::DOUBLE,9) AS cash_conversion_cycle, round(ev/nullif(4*revenue,0),9) AS ev_to_sales,
 round(sgna_a/nullif(rev_a,0),9) AS sga_to_revenue_prior, round(CASE WHEN rev_b>0 THEN revenue/rev_b-1 END,9) AS rev_growth_current, round(CASE WHEN eps_b>0 THEN eps/eps_b-1 END,9) AS eps_growth_current,
 round(CASE WHEN rev_c>0 THEN rev_a/rev_c-1 END,9) AS rev_growth_prior, round(CASE WHEN eps_c>0 THEN eps_a/eps_c-1 END,9) AS eps_growth_prior
 FROM rws LEFT JOIN a USING (ticker,calendardate,datekey) LEFT JOIN b USING (ticker,calendardate,datekey) LEFT JOIN c USING (ticker,calendardate,datekey))""",
        """yearly AS (SELECT ticker, calendardate AS report_date, datekey AS observed_at, round(grossmargin,9) AS gross_margin_current, round(opinc/nullif(revenue,0),9) AS op_margin_current,
 round(gm_a,9) AS gross_margin_prior, round(opinc_a/nullif(rev_a,0),9) AS op_margin_prior FROM rws LEFT JOIN a USING (ticker,calendardate,datekey))""",
        """facts AS (SELECT * FROM (UNPIVOT wide ON COLUMNS(* EXCLUDE (ticker, report_date, observed_at)) INTO NAME field VALUE value)
 UNION ALL SELECT * FROM (UNPIVOT yearly ON COLUMNS(* EXCLUDE (ticker, report_date, observed_at)) INTO NAME field VALUE value))""",
    ]
)


def all_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facts.filing_facts(domain.statements(spark, sf_dir), domain.parts(spark, sf_dir))


@query("q01_statement_facts", using(FACTS, query="SELECT ticker, field, report_date, observed_at AS observed, value FROM facts"))
def statement_facts(spark, sf_dir):
    return all_facts(spark, sf_dir).select("ticker", "field", "report_date", F.to_date("observed_at").alias("observed"), "value")


@query("q02_latest_screen", using(STATEMENTS, BARS, query="""SELECT t.ticker, t.calendardate, round(netinc/nullif(equity,0),9) AS roe, round(marketcap,9) AS market_cap, round(CASE WHEN y.rev>0 THEN revenue/y.rev-1 END,9) AS revenue_growth, v.close, round(v.avol,6) AS avg_volume_20d
 FROM (SELECT * FROM statements QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY calendardate DESC, datekey DESC)=1) t
 LEFT JOIN (SELECT ticker, calendardate, arg_max(revenue,datekey) AS rev FROM statements GROUP BY ALL) y ON y.ticker=t.ticker AND last_day(CAST(y.calendardate + INTERVAL 12 MONTH AS DATE))=t.calendardate
 LEFT JOIN (SELECT ticker, arg_max(close,date) AS close, avg(volume) AS avol FROM (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY date DESC) AS r FROM bars) WHERE r<=20 GROUP BY ticker) v ON v.ticker=t.ticker"""))
def latest_screen(spark, sf_dir):
    out = facts.latest_screen(domain.statements(spark, sf_dir), domain.bars(spark, sf_dir))
    return out.select("ticker", "calendardate", "roe", "market_cap", "revenue_growth", "close", F.round("avg_volume_20d", 6).alias("avg_volume_20d"))


_STALE = """SELECT ticker, latest, cadence, expected, days_overdue, CAST(floor(days_overdue/cadence)+1 AS INTEGER) AS quarters_behind FROM (
 SELECT *, latest+cadence+55 AS expected, DATE '2002-06-30'-(latest+cadence+55) AS days_overdue FROM (
  SELECT ticker, max(d) AS latest, CAST(round_even(median(gap),0) AS INTEGER) AS cadence, count(*) AS n FROM (SELECT ticker, d, d-lag(d) OVER (PARTITION BY ticker ORDER BY d) AS gap FROM rep) GROUP BY ticker)
 WHERE n>=2 AND cadence BETWEEN 45 AND 150) WHERE days_overdue>0"""
_REP = "rep AS (SELECT DISTINCT ticker, calendardate AS d FROM statements WHERE NOT (CAST(ticker AS BIGINT)%3=0 AND calendardate>DATE '2001-03-31'))"


def _reports(spark, sf_dir):
    s = domain.statements(spark, sf_dir).select("ticker", F.col("calendardate").alias("report_date"))
    return s.filter(~((F.col("ticker").cast("long") % 3 == 0) & (F.col("report_date") > F.lit(date(2001, 3, 31)))))


@query("q03_staleness", using(STATEMENTS, _REP, query=_STALE))
def staleness(spark, sf_dir):
    return facts.staleness(_reports(spark, sf_dir), date(2002, 6, 30))


@query("q04_staleness_of_active", using(STATEMENTS, BARS, "rep AS (SELECT DISTINCT ticker, calendardate AS d FROM statements WHERE NOT (CAST(ticker AS BIGINT)%3=0 AND calendardate>DATE '2001-03-31') AND ticker IN (SELECT ticker FROM bars GROUP BY ticker HAVING (SELECT max(date) FROM bars)-max(date)<=4))", query=_STALE))
def staleness_of_active(spark, sf_dir):
    return facts.staleness(_reports(spark, sf_dir), date(2002, 6, 30), active=facts.recently_active(domain.bars(spark, sf_dir), 4))


_SEAM = "seams AS (SELECT * FROM (SELECT ticker, date, close/nullif(lag(close) OVER (PARTITION BY ticker ORDER BY date),0) AS ratio FROM raw_bars) WHERE ratio<0.6 OR ratio>1.67)"


@query("q05_split_seams", using(RAW_BARS, _SEAM, query="SELECT ticker, date, round(ratio,6) AS ratio FROM seams"))
def split_seams(spark, sf_dir):
    return facts.seams(domain.raw_bars(spark, sf_dir)).withColumn("ratio", F.round("ratio", 6))


@query("q06_healed_seams", using(BARS, RAW_BARS, _SEAM, "fresh AS (SELECT ticker, date, low, close, volume FROM bars WHERE CAST(ticker AS BIGINT)%2=0), flagged AS (SELECT DISTINCT ticker FROM seams WHERE ticker IN (SELECT ticker FROM fresh))",
 query="SELECT ticker, date, low, close, volume FROM raw_bars WHERE ticker NOT IN (SELECT ticker FROM flagged) UNION ALL SELECT ticker, date, low, close, volume FROM fresh WHERE ticker IN (SELECT ticker FROM flagged)"))
def healed_seams(spark, sf_dir):
    cols = ["ticker", "date", "low", "close", "volume"]
    fresh = domain.bars(spark, sf_dir).filter(F.col("ticker").cast("long") % 2 == 0).select(cols)
    return facts.healed(domain.raw_bars(spark, sf_dir).select(cols), fresh)


@query("q07_gap_windows", using(BARS, MEMBERSHIP, """have AS (SELECT ticker, min(date) AS a, max(date) AS b FROM bars WHERE CAST(ticker AS BIGINT)%5<>0 GROUP BY ticker),
 w AS (SELECT m.ticker, a, b FROM (SELECT DISTINCT ticker FROM membership) m LEFT JOIN have USING (ticker)),
 g AS (SELECT ticker, DATE '1995-01-10' AS gap_start, DATE '2001-12-31' AS gap_end FROM w WHERE a IS NULL UNION ALL SELECT ticker, DATE '1995-01-10', a-1 FROM w WHERE a>DATE '1995-01-10' UNION ALL SELECT ticker, b+1, DATE '2001-12-31' FROM w WHERE b<DATE '2001-12-31')""",
 query="SELECT gap_start, gap_end, count(*) AS n, string_agg(ticker, ',' ORDER BY ticker) AS tickers FROM g GROUP BY ALL"))
def gap_windows(spark, sf_dir):
    have = domain.bars(spark, sf_dir).filter(F.col("ticker").cast("long") % 5 != 0)
    out = facts.gap_windows(have, domain.membership(spark, sf_dir).select("ticker").distinct(), date(1995, 1, 10), date(2001, 12, 31))
    return out.withColumn("tickers", F.array_join("tickers", ","))


_YEARLY = "ann AS (SELECT ticker, last_day(CAST(date_trunc('year',calendardate)+INTERVAL 11 MONTH AS DATE)) AS date, round(avg(grossmargin),9) AS gm, round(sum(opinc)/sum(revenue),9) AS om FROM statements WHERE datekey-calendardate<100 GROUP BY ALL)"


@query("q08_vendor_facts", using(STATEMENTS, _YEARLY, query="""SELECT ticker, field, report_date, observed, round(value,6) AS value FROM (UNPIVOT (SELECT ticker, date AS report_date, date+90 AS observed, gm AS gross_margin_current, om AS op_margin_current, lag(gm) OVER (PARTITION BY ticker ORDER BY date) AS gross_margin_prior, lag(om) OVER (PARTITION BY ticker ORDER BY date) AS op_margin_prior FROM ann) ON gross_margin_current, op_margin_current, gross_margin_prior, op_margin_prior INTO NAME field VALUE value)
 UNION ALL SELECT ticker, 'roe', calendardate, calendardate+45, round(round(netinc/nullif(equity,0),9),6) FROM statements WHERE datekey-calendardate<100"""))
def vendor_facts(spark, sf_dir):
    s = domain.statements(spark, sf_dir).filter(F.datediff("datekey", "calendardate") < 100)
    year_end = F.last_day(F.add_months(F.trunc("calendardate", "year"), 11))
    annual = s.groupBy("ticker", year_end.alias("date")).agg(F.round(F.avg("grossmargin"), 9).alias("gross_margin_current"), F.round(F.sum("opinc") / F.sum("revenue"), 9).alias("op_margin_current"))
    a = facts.vendor_facts(annual, ["gross_margin_current", "op_margin_current"], 90, {"gross_margin_prior": "gross_margin_current", "op_margin_prior": "op_margin_current"})
    q = facts.vendor_facts(s.select("ticker", F.col("calendardate").alias("date"), F.try_divide("netinc", "equity").alias("roe")), ["roe"], 45)
    return a.unionByName(q).select("ticker", "field", "report_date", F.to_date("observed_at").alias("observed"), F.round("value", 6).alias("value"))


@query("q09_merged_live", using(STATEMENTS, """o AS (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY calendardate DESC) AS r FROM statements WHERE datekey-calendardate<100 AND NOT (CAST(ticker AS BIGINT)%6=0 AND calendardate<DATE '2001-01-01')),
 yr AS (SELECT ticker, rev/nullif(lag(rev) OVER w,0)-1 AS rg, CASE WHEN lag(eps) OVER w>0 THEN eps/lag(eps) OVER w-1 END AS eg, row_number() OVER (PARTITION BY ticker ORDER BY y DESC) AS r FROM (SELECT ticker, year(calendardate) AS y, sum(revenue) AS rev, sum(eps) AS eps FROM statements WHERE datekey-calendardate<100 GROUP BY ALL) WINDOW w AS (PARTITION BY ticker ORDER BY y)),
 yg AS (SELECT ticker, max(rg) FILTER (r=1) AS rg0, max(rg) FILTER (r=2) AS rg1, max(eg) FILTER (r=1) AS eg0, max(eg) FILTER (r=2) AS eg1 FROM yr GROUP BY ticker),
 q AS (SELECT ticker, count(*) AS nq, max(CASE WHEN r=1 AND CAST(ticker AS BIGINT)%4<>0 THEN grossmargin END) AS gm, max(CASE WHEN r=1 THEN revenue END) AS r0, max(CASE WHEN r=2 THEN revenue END) AS r1, max(CASE WHEN r=5 THEN revenue END) AS r4, max(CASE WHEN r=6 THEN revenue END) AS r5,
  max(CASE WHEN r=1 THEN eps END) AS e0, max(CASE WHEN r=2 THEN eps END) AS e1, max(CASE WHEN r=5 THEN eps END) AS e4, max(CASE WHEN r=6 THEN eps END) AS e5 FROM o GROUP BY ticker),
 y AS (SELECT ticker, arg_max(grossmargin,calendardate) AS gm FROM o WHERE month(calendardate)=12 GROUP BY ticker)""",
 query="""SELECT ticker, round(coalesce(q.gm,y.gm),6) AS grossmargin, CASE WHEN coalesce(nq,0)<5 THEN rg0 WHEN r4>0 THEN r0/r4-1 END AS rev_growth_current, CASE WHEN coalesce(nq,0)<5 THEN rg1 WHEN r5>0 THEN r1/r5-1 END AS rev_growth_prior, CASE WHEN coalesce(nq,0)<5 THEN eg0 WHEN e4>0 THEN e0/e4-1 END AS eps_growth_current, CASE WHEN coalesce(nq,0)<5 THEN eg1 WHEN e5>0 THEN e1/e5-1 END AS eps_growth_prior FROM q FULL JOIN y USING (ticker) LEFT JOIN yg USING (ticker)"""))
def merged_live(spark, sf_dir):
    first = domain.statements(spark, sf_dir).filter(F.datediff("datekey", "calendardate") < 100).withColumn("date", F.col("calendardate"))
    year = first.groupBy("ticker", F.trunc("date", "year").alias("date")).agg(F.sum("revenue").alias("revenue"), F.sum("eps").alias("eps"))
    before = lambda c: F.lag(c).over(Window.partitionBy("ticker").orderBy("date"))
    yearly = year.select("ticker", "date", (F.try_divide(F.col("revenue"), before("revenue")) - 1).alias("rev_growth"), F.when(before("eps") > 0, F.col("eps") / before("eps") - 1).alias("eps_growth"))
    s = first.filter(~((F.col("ticker").cast("long") % 6 == 0) & (F.col("date") < F.lit(date(2001, 1, 1)))))
    quarterly = s.withColumn("grossmargin", F.when(F.col("ticker").cast("long") % 4 != 0, F.col("grossmargin")))
    out = facts.merged_live(s.filter(F.month("date") == 12), quarterly, ["grossmargin"], yearly)
    return out.withColumn("grossmargin", F.round("grossmargin", 6))


_EVENTS = """ev AS (SELECT ticker, added_date AS date, 'added' AS action FROM membership WHERE CAST(ticker AS BIGINT)%6<>1
 UNION ALL SELECT ticker, removed_date, 'removed' FROM membership WHERE removed_date IS NOT NULL
 UNION ALL SELECT ticker, CAST(added_date+INTERVAL 60 MONTH AS DATE), 'added' FROM membership WHERE CAST(ticker AS BIGINT)%14=0),
 cur AS (SELECT ticker FROM membership WHERE CAST(ticker AS BIGINT)%7<>0)"""


def _events(spark, sf_dir):
    m = domain.membership(spark, sf_dir)
    k = F.col("ticker").cast("long")
    ev = m.filter(k % 6 != 1).select("ticker", F.col("added_date").alias("date"), F.lit("added").alias("action"))
    ev = ev.unionByName(m.filter("removed_date is not null").select("ticker", F.col("removed_date").alias("date"), F.lit("removed").alias("action")))
    ev = ev.unionByName(m.filter(k % 14 == 0).select("ticker", F.add_months("added_date", 60).alias("date"), F.lit("added").alias("action")))
    return ev, m.filter(k % 7 != 0).select("ticker")


@query("q10_membership_stints", using(MEMBERSHIP, _EVENTS, """st AS (SELECT ticker, k, coalesce(min(date) FILTER (action='added'), DATE '1957-03-04') AS added_date, max(date) FILTER (action='removed') AS removed_date FROM
  (SELECT *, coalesce(sum(CASE WHEN action='removed' THEN 1 ELSE 0 END) OVER (PARTITION BY ticker ORDER BY date, CASE WHEN action='added' THEN 0 ELSE 1 END ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),0) AS k FROM ev) GROUP BY ticker, k)""",
 query="SELECT ticker, added_date, removed_date FROM st UNION ALL SELECT DISTINCT ticker, DATE '1957-03-04', NULL FROM cur WHERE ticker NOT IN (SELECT ticker FROM st WHERE removed_date IS NULL)"))
def membership_stints(spark, sf_dir):
    return facts.stints(*_events(spark, sf_dir))


@query("q11_membership_sync", using(MEMBERSHIP, query="""SELECT ticker, index_name, added_date, CASE WHEN removed_date IS NULL AND CAST(ticker AS BIGINT)%8=3 THEN DATE '2001-06-30' ELSE removed_date END AS removed_date FROM membership WHERE CAST(ticker AS BIGINT)%10<>9
 UNION ALL SELECT ticker, index_name, DATE '2001-06-30', NULL FROM membership m WHERE CAST(ticker AS BIGINT)%8<>3 AND NOT (CAST(ticker AS BIGINT)%10<>9 AND removed_date IS NULL)"""))
def membership_sync(spark, sf_dir):
    m = domain.membership(spark, sf_dir)
    k = F.col("ticker").cast("long")
    return tables.sync_members(m.filter(k % 10 != 9), m.filter(k % 8 != 3).select("ticker", "index_name"), date(2001, 6, 30)).drop("is_delisted")


_LOADED = "wanted AS (SELECT DISTINCT ticker FROM membership WHERE index_name IN ('ASIA','EUROPE') AND (removed_date IS NULL OR removed_date>=DATE '1996-01-01'))"


@query("q15_history_load", using(FACTS, BARS, MEMBERSHIP, SECTORS, _LOADED, f"rep AS (SELECT DISTINCT ticker, report_date AS d FROM facts WHERE ticker IN (SELECT ticker FROM wanted)), late AS ({_STALE})", query="""SELECT 'members' AS part, count(*) AS n, count(DISTINCT ticker) AS tickers FROM membership WHERE index_name IN ('ASIA','EUROPE')
 UNION ALL SELECT 'facts', count(*), count(DISTINCT ticker) FROM facts WHERE ticker IN (SELECT ticker FROM wanted)
 UNION ALL SELECT 'prices', count(*), count(DISTINCT ticker) FROM bars WHERE ticker IN (SELECT ticker FROM wanted) AND date>=DATE '1996-01-01'
 UNION ALL SELECT 'benchmark', count(DISTINCT date), 1 FROM bars WHERE date>=DATE '1996-01-01' UNION ALL SELECT 'sectors', count(*), count(DISTINCT ticker) FROM sectors WHERE ticker IN (SELECT ticker FROM wanted) UNION ALL SELECT 'overdue', coalesce(sum(quarters_behind),0)::BIGINT, count(*) FROM late"""))
def history_load(spark, sf_dir):
    """Membership, facts, prices, benchmark and sectors of one load, read back from its tables as the counts of its report."""
    m = domain.membership(spark, sf_dir).filter(F.col("index_name").isin("ASIA", "EUROPE"))
    b = domain.bars(spark, sf_dir)
    at = scratch(spark, "history")
    load.history(spark, at, m, all_facts(spark, sf_dir), b, domain.benchmark(b), domain.sectors(spark, sf_dir), date(1996, 1, 1))
    return load.report(spark, at, date(2002, 6, 30))


@query("j09_filing_as_of", using(STATEMENTS, query="""SELECT r.ticker, r.calendardate, r.datekey, arg_max(f.revenue, f.datekey) AS revenue_then, max(f.datekey) AS filed FROM statements r JOIN statements f ON f.ticker=r.ticker AND f.calendardate=r.calendardate AND f.datekey<=r.datekey GROUP BY ALL"""))
def filing_as_of(spark, sf_dir):
    s = domain.statements(spark, sf_dir).select("ticker", "calendardate", "datekey", "revenue").withColumns({"same": F.col("calendardate"), "filed": F.col("datekey")})
    return asof.filing_as_of(s, "same", ["revenue", "filed"]).select("ticker", "calendardate", "datekey", F.col("_revenue").alias("revenue_then"), F.col("_filed").alias("filed"))


@query("j11_preceding_period", using(STATEMENTS, query="SELECT ticker, calendardate, lag(calendardate) OVER (PARTITION BY ticker ORDER BY calendardate) AS prev_period FROM (SELECT DISTINCT ticker, calendardate FROM statements WHERE NOT (CAST(ticker AS BIGINT)%3=0 AND month(calendardate)=6))"))
def preceding_period(spark, sf_dir):
    s = domain.statements(spark, sf_dir)
    return asof.preceding_period(s.filter(~((F.col("ticker").cast("long") % 3 == 0) & (F.month("calendardate") == 6))))


@query("w11_latest_filing", using(STATEMENTS, query="SELECT ticker, calendardate, datekey, revenue FROM statements QUALIFY row_number() OVER (PARTITION BY ticker, calendardate ORDER BY datekey DESC)=1"))
def latest_filing(spark, sf_dir):
    return asof.latest_filing(domain.statements(spark, sf_dir)).select("ticker", "calendardate", "datekey", "revenue")


"""The same panel inputs as DuckDB common table expressions, for the oracles."""

from __future__ import annotations

from equiscope.sources.domain import STATEMENT

_COLS = ("rev", "disc", "tax", "qty")
_MADE = ",\n".join("round(" + " + ".join(f"{w}::DOUBLE*{c}" for w, c in zip(ws, _COLS, strict=True)) + f", 4) AS {n}" for n, ws in STATEMENT.items())

BARS = """bars AS (
 SELECT CAST(l_suppkey AS VARCHAR) AS ticker, CAST(l_shipdate AS DATE) AS date, round(avg(p_retailprice*(1-l_discount)),6) AS open,
  round(max(p_retailprice*(1-l_discount)),6) AS high, round(min(p_retailprice*(1-l_discount)),6) AS low,
  round(avg(p_retailprice*(1-l_discount)),6) AS close, sum(l_quantity) AS volume
 FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL)"""
RAW_BARS = """raw_bars AS (
 SELECT CAST(l_suppkey AS VARCHAR) AS ticker, CAST(l_shipdate AS DATE) AS date, round(min(l_extendedprice/l_quantity),6) AS low,
  round(sum(l_extendedprice)/sum(l_quantity),6) AS close, sum(l_quantity) AS volume
 FROM lineitem GROUP BY ALL)"""
MEMBERSHIP = """membership AS (
 SELECT CAST(s_suppkey AS VARCHAR) AS ticker, r_name AS index_name, a AS added_date,
  CASE WHEN s_suppkey % 11 = 0 THEN a - 30 WHEN s_suppkey % 7 = 0 THEN CAST(a + INTERVAL 48 MONTH AS DATE) END AS removed_date, s_suppkey % 7 = 0 AS is_delisted
 FROM (SELECT *, CAST(DATE '1995-01-01' + to_months(CAST(s_suppkey % 24 AS INTEGER)) AS DATE) AS a FROM supplier)
 JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""
SECTORS = """sectors AS (
 SELECT CAST(s_suppkey AS VARCHAR) AS ticker, CASE WHEN s_suppkey % 13 <> 0 THEN n_name END AS sector FROM supplier JOIN nation ON s_nationkey = n_nationkey)"""
STATEMENTS = f"""sums AS (
 SELECT CAST(l_suppkey AS VARCHAR) AS ticker, last_day(CAST(date_trunc('quarter', l_shipdate) + INTERVAL 2 MONTH AS DATE)) AS calendardate,
  round(sum(l_extendedprice),4) AS rev, round(sum(l_extendedprice*l_discount),4) AS disc, round(sum(l_extendedprice*l_tax),4) AS tax, round(sum(l_quantity),4) AS qty,
  round(sum(l_extendedprice) FILTER (l_returnflag<>'R'),4) AS rev_a, round(sum(l_extendedprice*l_discount) FILTER (l_returnflag<>'R'),4) AS disc_a,
  round(sum(l_extendedprice*l_tax) FILTER (l_returnflag<>'R'),4) AS tax_a, round(sum(l_quantity) FILTER (l_returnflag<>'R'),4) AS qty_a,
  count(*) FILTER (l_returnflag<>'R') AS n_a
 FROM lineitem GROUP BY ALL),
filings AS (
 SELECT ticker, calendardate, calendardate + 45 AS datekey, rev, disc, tax, qty FROM sums
 UNION ALL SELECT ticker, calendardate, calendardate + 120, rev_a, disc_a, tax_a, qty_a FROM sums WHERE n_a > 0),
made AS (SELECT ticker, calendardate, datekey,
{_MADE}
 FROM filings),
statements AS (SELECT *, (cashnequsd+receivables)/nullif(payables+0.1::DOUBLE*revenue,0) AS currentratio, (revenue-cor)/nullif(revenue,0) AS grossmargin FROM made)"""
BENCHMARK = "bench AS (SELECT date, round(avg(close),6) AS close FROM bars GROUP BY date)"
ACCOUNT_OBS = """account_obs AS (
 SELECT CAST(user_id AS VARCHAR) AS broker, ts, event_id, round(10000+sum(round(value*20,4)) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING),2) AS equity FROM events)"""


def using(*ctes: str, query: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n" + query

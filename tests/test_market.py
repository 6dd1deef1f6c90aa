"""The market in one pass against the operators that it stands for, and what keeps screens from growing faster than their input."""

from datetime import date

import pytest
from pyspark.sql import functions as F

from equiscope.operators import asof, calendar, rolling
from equiscope.plans import queries_panel, queries_stats, queries_tables, screen
from equiscope.plans.queries_panel import DATES
from equiscope.sources import domain, stage
from equiscope.sources.schemas import FIELDS


def rows(df):
    return sorted((tuple(None if v is None else v if not isinstance(v, float) else round(v, 9) for v in r) for r in df.collect()), key=str)


@pytest.mark.parametrize("dates", [DATES, calendar.rebalance_dates(date(1997, 1, 1), date(1999, 1, 1), "weekly"), [date(1999, 3, 1), date(1999, 9, 2), date(2000, 1, 1)]])
def test_market_is_features_tradeable_and_periods(spark, sf, dates):
    bars = domain.bars(spark, sf).filter("ticker % 3 != 0 or month(date) != 5").localCheckpoint()
    m = rolling.market(bars, dates).localCheckpoint()
    features, tradeable = rolling.of_market(m)
    want = rolling.features_as_of(bars, dates)
    assert rows(features.select(want.columns)) == rows(want)
    assert rows(tradeable) == rows(asof.tradeable_as_of(bars, dates).select("as_of", "ticker"))
    want = rolling.period_returns(bars, dates)
    assert rows(rolling.market_periods(m).select(want.columns)) == rows(want)


def test_no_frame_slides_over_more_than_twenty_rows(spark):
    days = spark.range(400).select(F.lit("A").alias("ticker"), F.date_add(F.lit(date(1999, 1, 1)), F.col("id").cast("int")).alias("date"), (F.col("id") % 7 + 1.0).alias("close"), F.lit(1.0).alias("volume"))
    out = rolling.rolled(days)
    plan = out._jdf.queryExecution().analyzed().toString()
    assert "RowFrame, -19, currentrow" in plan and not any(f"RowFrame, -{n}, currentrow" in plan for n in range(20, 400))
    closes = [i % 7 + 1.0 for i in range(400)]
    for i, r in enumerate(out.orderBy("date").collect()):
        assert r["sma_200"] == (None if i < 149 else pytest.approx(sum(closes[max(0, i - 199) : i + 1]) / min(200, i + 1)))
        assert r["trailing_return"] == pytest.approx(closes[i] / closes[max(0, i - 251)] - 1)


def test_bars_are_made_once(spark, sf, monkeypatch):
    made = []
    bars = domain.bars
    monkeypatch.setattr(domain, "bars", lambda *a: made.append(1) or bars(*a))
    queries_stats.regimes(spark, sf)
    assert len(made) == 1


def test_parts_of_filings_are_not_made_fewer(spark):
    assert "REPARTITION_BY_NUM" in asof.by_ticker(spark.range(5).withColumnRenamed("id", "ticker"))._jdf.queryExecution().executedPlan().toString()


def test_a_row_for_each_ticker_and_date_goes_on_and_not_one_for_each_bar(spark, sf):
    plan = rolling.market(domain.bars(spark, sf), DATES)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Generate explode") == 1
    assert plan.index("Generate explode") < plan.index("Aggregate [ticker")  # what is taken apart stands above the aggregate of the bars


def test_parts_of_line_items_grow_with_them(spark, sf, monkeypatch):
    assert domain.parts(spark, sf) == 4
    monkeypatch.setattr(domain, "LINES_OF_PART", 1000)
    n = -(-domain.read(spark, sf, "lineitem").count() // 1000)
    assert domain.parts(spark, sf) == n > 4
    plan = rolling.market(domain.bars(spark, sf), DATES)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(") == 1 and f", {n}), REPARTITION_BY_NUM" in plan  # nothing is aggregated ahead of the one shuffle
    assert plan.index("HashAggregate(keys=[ticker") < plan.index("Exchange hashpartitioning(")


def test_a_fact_log_is_dealt_once_and_in_parts_that_grow(spark, sf, monkeypatch):
    monkeypatch.setattr(domain, "LINES_OF_PART", 1000)
    n = domain.parts(spark, sf)
    long = asof.facts_as_of(queries_tables.all_facts(spark, sf), DATES, n)
    plan = asof.pivoted(long, ["as_of", "ticker"], FIELDS)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(") == 2 and plan.count("REPARTITION_BY_NUM") == 1  # by quarter, then by ticker for all that follows


def test_dates_of_members_are_made_in_many_parts(spark, sf):
    plan = asof.members_as_of(domain.membership(spark, sf), DATES)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(") == 1 and plan.index("Generate explode") < plan.index("REPARTITION_BY_NUM")


def test_equal_window_aggregates_are_worked_out_once(spark, sf):
    frame = queries_panel.known(spark, sf).withColumns({c: F.rand() for c in ("close", "avg_volume_20d", "sma_200", "momentum_12m_return", "realized_vol_20d")}).withColumn("sector", F.lit("a"))
    plan = screen.scored_by_strategy(frame, queries_stats.VARIANTS)._jdf.queryExecution().analyzed().toString()
    # each of five signals has a mean and a deviation as it is and once it is cut; the close has its own for momentum
    assert plan.count("stddev_samp(") == 11


def test_filings_are_not_repeated_for_what_they_are_compared_with(spark, sf):
    rows = domain.statements(spark, sf)
    plan = asof.with_compared(rows, {"a": F.col("prev_period")}, ["revenue"])._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate explode(array(struct(tag" not in plan and plan.count("Generate ") == 2  # amendments, and the filings of a period
    assert asof.with_compared(rows, {"a": F.col("prev_period")}, ["revenue"]).count() == rows.count()


def test_long_methods_are_not_interpreted_while_a_table_is_staged(spark, monkeypatch):
    df, seen, before = spark.range(3), [], spark.conf.get("spark.sql.codegen.hugeMethodLimit")
    made = type(df.write).parquet
    monkeypatch.setattr(type(df.write), "parquet", lambda w, at: (seen.append(spark.conf.get("spark.sql.codegen.hugeMethodLimit")), made(w, at))[1])
    assert stage.compiled(df, "limit").count() == 3
    assert seen == ["8000"] and spark.conf.get("spark.sql.codegen.hugeMethodLimit") == before

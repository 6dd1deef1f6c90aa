"""Fixed schemas of the stored tables, and the canonical screening fields."""

from __future__ import annotations

PRICES = "ticker string, date date, open double, high double, low double, close double, volume double, source string"
FACTS = "ticker string, field string, value double, report_date date, observed_at timestamp, source string"
MEMBERS = "ticker string, index_name string, added_date date, removed_date date, is_delisted boolean"
SECTORS = "ticker string, sector string"
RESEARCH_LOG = "experiment_id string, experiment_name string, config_json string, started_at timestamp, completed_at timestamp, holdout_used boolean, metrics_json string, status string"
LEDGER = "broker string, date date, amount double, note string, inferred boolean, ts timestamp"

# The canonical field names, and the vendor names of the eleven that are renamed.
RENAMED = {
    "marketCap": "market_cap", "returnOnEquityTTM": "roe", "returnOnAssetsTTM": "roa", "returnOnInvestedCapitalTTM": "roic",
    "currentRatioTTM": "current_ratio", "netDebtToEBITDATTM": "net_debt_to_ebitda", "earningsYieldTTM": "earnings_yield",
    "freeCashFlowYieldTTM": "fcf_yield", "capexToRevenueTTM": "capex_to_revenue", "researchAndDevelopementToRevenueTTM": "rd_to_revenue",
    "evToSalesTTM": "ev_to_sales",
}
PASSED = [
    "rev_growth_current", "rev_growth_prior", "eps_growth_current", "eps_growth_prior", "gross_margin_current", "gross_margin_prior",
    "op_margin_current", "op_margin_prior", "sga_to_revenue", "sga_to_revenue_prior", "sbc_to_revenue", "income_quality",
    "intangibles_to_assets", "cash_conversion_cycle", "revenue_growth", "earnings_stability", "debt_to_equity", "beta", "dividend_yield",
]
FIELDS = [*RENAMED.values(), *PASSED]

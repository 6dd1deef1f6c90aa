"""A backtest with feedback as a plain loop, to hold the plans against."""

from datetime import date

import pandas as pd

from equiscope.plans.screen import Spec

COLUMNS = ["strategy_id", "t", "as_of", "ret", "n", "swaps", "cost", "stopped"]


def _weights(vols: pd.Series, how: str) -> pd.Series:
    if how == "equal" or not len(vols):
        return pd.Series(1.0 / max(1, len(vols)), index=vols.index)
    inverse = (1 / vols.where(vols > 0)).astype(float)
    filled = inverse.fillna(inverse.median())
    return filled / filled.sum() if filled.notna().all() else pd.Series(1.0 / len(vols), index=vols.index)


def fold(rows: pd.DataFrame, spec: Spec, dates: list[date]) -> pd.DataFrame:
    """One strategy through its dates in order, with what it holds, its last weights and whether it sits in cash."""
    by_date = dict(tuple(rows.groupby("as_of")))
    held: set[str] = set()
    weights = pd.Series(dtype=float)
    cash, out = False, []
    for t, d in enumerate(dates[:-1]):
        if spec.portfolio_stop_loss > 0 and out:
            cash = out[-1][3] < -spec.portfolio_stop_loss
        if cash or d not in by_date:
            out.append((spec.name, t, d, 0.0, 0, 0, 0.0, 0))
            held = set()
            continue
        p = by_date[d]
        p = p.assign(s=p["composite_score"] + p["ticker"].isin(held) * (spec.hold_bonus if spec.hold_bonus > 0 else 0.0)).sort_values(["s", "ticker"], ascending=[False, True])
        if spec.max_per_sector:
            p = p[p.groupby(p["sector"].fillna("__unknown__")).cumcount() < spec.max_per_sector]
        p = p.head(spec.top_n).set_index("ticker")
        picks = set(p.index)
        now = _weights(p["realized_vol_20d"], spec.weighting)
        rate = spec.cost_bps / 10000
        change = len(held ^ picks)
        traded, swaps = (change / len(picks), change // 2) if held else (1.0, 0)
        cost = traded * rate
        if spec.weighting != "equal" and len(weights):
            both = sorted(held & picks)
            delta = (now[both] - weights.reindex(both).fillna(0.0)).abs()
            cost += float(delta[delta > 0.05 * now[both]].sum()) * rate
        if p["ret"].isna().all():
            out.append((spec.name, t, d, -cost, len(picks), swaps, cost, 0))
            held, weights = picks, now if spec.weighting != "equal" else pd.Series(dtype=float)
            continue
        ret, stopped = p["ret"].fillna(0.0), set()
        if spec.position_stop_loss > 0:
            hit = p["min_low"] < p["start_price"] * (1 - spec.position_stop_loss)
            ret = ret.mask(hit, -spec.position_stop_loss)
            stopped = set(p.index[hit])
            cost += len(stopped) / len(picks) * rate
        out.append((spec.name, t, d, float((now * ret).sum()) - cost, len(picks), swaps + len(stopped), cost, len(stopped)))
        held, weights = picks - stopped, now if spec.weighting != "equal" else pd.Series(dtype=float)
    return pd.DataFrame(out, columns=COLUMNS)

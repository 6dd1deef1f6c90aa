"""Experiments: variations judged on their training window, one use of the holdout, and the log that gates both."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field, fields
from datetime import UTC, date, datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from equiscope.operators.metrics import bundle
from equiscope.plans.backtest import backtest, years_between
from equiscope.plans.evaluate import budgets, guardrails
from equiscope.plans.screen import Spec
from equiscope.sources.schemas import RESEARCH_LOG
from equiscope.sources.stage import compiled
from equiscope.sources.versioned import Versioned

RESULT = "strategy_id string, train_sharpe double, cagr double, max_drawdown double, psr double, n bigint, warnings string, best boolean, holdout_sharpe double, holdout_cagr double, holdout_max_drawdown double"


class BudgetExhausted(RuntimeError):
    """The log holds as many runs of an experiment as it may have."""


@dataclass(frozen=True)
class Experiment:
    """Variations of a base strategy; the holdout is from holdout_from to end, training is what lies before it."""

    name: str
    hypothesis: str
    base: Spec
    variations: tuple[dict, ...]
    start: date
    holdout_from: date
    end: date
    most_runs: int = 20
    limits: dict = field(default_factory=dict)

    def specs(self) -> list[Spec]:
        """Each variation over the base: what it does not name, such as weighting, hold bonus, stops and caps, is the base's."""
        made = [Spec.of({**{f.name: getattr(self.base, f.name) for f in fields(Spec)}, **v}) for v in self.variations]
        if len({s.name for s in made}) < len(made):
            raise ValueError("two variations of one name")
        return made


def left(log: DataFrame, name: str, most: int) -> tuple[int, bool]:
    """(runs that an experiment may still log, whether it may use its holdout)."""
    found = budgets(log.filter(F.col("experiment_name") == name), most).first()
    return (found["left"], found["may_use_holdout"]) if found else (most, True)


def _log_rows(e: Experiment, version: int, began: datetime, rows: list[dict], holdout: dict | None) -> list[tuple]:
    now = datetime.now(UTC).replace(tzinfo=None)
    keys = ("train_sharpe", "cagr", "max_drawdown", "psr", "n")
    out = [(f"{e.name}/{version}/{r['strategy_id']}", e.name, json.dumps({"variation": r["strategy_id"]}), began, now, False, json.dumps({k: r[k] for k in keys}), "completed") for r in rows]
    if holdout:
        out.append((f"{e.name}/{version}/holdout", e.name, json.dumps({"variation": holdout["strategy_id"], "holdout": True}), began, now, True, json.dumps({k: v for k, v in holdout.items() if k != "strategy_id"}), "completed"))
    return out


def run(log: Versioned, e: Experiment, frame: DataFrame, returns: DataFrame, dates: list[date], between: Callable[[], None] = lambda: None) -> DataFrame:
    """Rows of RESULT, one a variation that the budget lets run; the holdout's figures only with the best clean one, and only once ever.

    The log is read before anything is planned, and an exhausted budget raises. All variations are one backtest over the training
    window. The best clean one (by its ratio to nine digits, so that the order of a sum decides no tie, then by name) is run on the holdout, from nothing held, if the log has no use of
    it. The runs and that use are one commit: if another call has logged in between, the log is judged again, and what the budget no longer covers or
    the holdout that was used meanwhile is not shown. A call that fails before its commit leaves the log as it was. `between` runs before the commit.
    """
    began = datetime.now(UTC).replace(tzinfo=None)
    version = log.version()
    room, open_ = left(log.read(version), e.name, e.most_runs)
    if not room:
        raise BudgetExhausted(f"{e.name} has had its {e.most_runs} runs")
    specs = e.specs()[:room]
    keys = ("strategy_id", "run")
    train = backtest(frame, returns, dates, specs, [("train", e.start, e.holdout_from)])
    judged = guardrails(bundle(train.select(*keys, "t", "ret"), keys=keys, years=years_between(e.start, e.holdout_from)), **e.limits)
    judged = judged.select("strategy_id", F.col("sharpe").alias("train_sharpe"), "cagr", "max_drawdown", "psr", "n", F.concat_ws(",", "warnings").alias("warnings"))
    rows = {r["strategy_id"]: r.asDict() for r in compiled(judged, "train").collect()}  # a budgeted handful
    ordered = [rows[s.name] for s in specs if s.name in rows]
    shown: dict[str, dict] = {}

    def holdout(best: str) -> dict:
        if best not in shown:
            spec = next(s for s in specs if s.name == best)
            held = backtest(frame, returns, dates, [spec], [("holdout", e.holdout_from, e.end)])
            m = bundle(held.select(*keys, "t", "ret"), keys=keys, years=years_between(e.holdout_from, e.end)).first()
            shown[best] = {"strategy_id": best, **({k: m[k] for k in ("sharpe", "cagr", "max_drawdown")} if m else dict.fromkeys(("sharpe", "cagr", "max_drawdown")))}
        return shown[best]

    while True:
        mine = ordered[:room]
        clean = sorted((r for r in mine if not r["warnings"]), key=lambda r: (-round(r["train_sharpe"], 9), r["strategy_id"]))
        best = clean[0]["strategy_id"] if clean else None
        held = holdout(best) if best and open_ else None
        between()
        folder = log.write(log.spark.createDataFrame(_log_rows(e, version + 1, began, mine, held), RESEARCH_LOG))
        if log.commit(version, [*log.folders(version), folder]):
            break
        version = log.version()
        room, open_ = left(log.read(version), e.name, e.most_runs)
        if not room:
            raise BudgetExhausted(f"{e.name} has had its {e.most_runs} runs")
    held = held or {}
    result = [(*(r[c] for c in ("strategy_id", "train_sharpe", "cagr", "max_drawdown", "psr", "n", "warnings")), r["strategy_id"] == best, *((held.get(c) if r["strategy_id"] == best else None) for c in ("sharpe", "cagr", "max_drawdown"))) for r in mine]
    return log.spark.createDataFrame(result, RESULT)


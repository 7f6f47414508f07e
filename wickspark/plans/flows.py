"""The three whole flows as lazy plans: backtest, market update, daily tracking."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wickspark.model import DAILY_PATTERNS, HOLD_DAYS, START_CASH
from wickspark.operators import combined as C
from wickspark.operators import daily as D
from wickspark.operators import metrics as M
from wickspark.operators import selection as S
from wickspark.operators import trades as T
from wickspark.sources import bars as B


def backtest(bars: DataFrame, buy: Iterable[str], sell: Iterable[str], hold: int = HOLD_DAYS,
             cash: float = START_CASH, cautious: bool = False) -> DataFrame:
    """Several patterns of every code: totals over the single accounts, risk of the one shared account."""
    buy, sell = tuple(buy), tuple(sell)
    names = tuple(dict.fromkeys(buy + sell))
    cells = [(n, "buy") for n in buy] + [(n, "sell") for n in sell]
    found = T.folded(T.code_candidates(T.code_rows(bars, names, cells, cautious), cells, (hold,)), cash, traded=True)
    single = M.account_figures(found, cash).groupBy("code").agg(
        F.round(F.sum("return_pct"), 2).alias("total_return"), F.sum("trades").alias("total_trades"),
        F.bround(F.sum("won") / F.sum("trades") * 100, 0).alias("win_rate"), F.sum("hold_days").alias("hold_days"))
    joint = M.account_figures(C.combined_accounts(bars, buy, sell, hold, cash, cautious), cash, ("code",), combined=True).filter("trades > 0")
    risk = joint.select("code", "sharpe", "max_drawdown", F.round((F.col("final_value") / F.lit(cash) - 1) * 100, 2).alias("real_return"))
    held = M.buy_hold_adjusted(bars, single.select("code", F.col("total_return").alias("return_pct"), "hold_days"))
    return single.drop("hold_days").join(risk, "code").join(held, "code")


def market_update(bars: DataFrame, universe: DataFrame, focus: DataFrame, hold: int = HOLD_DAYS, cash: float = START_CASH,
                  cautious: bool = False, completed: DataFrame | None = None, patterns: Iterable[str] = DAILY_PATTERNS) -> DataFrame:
    """Performance rows of every task still to do: all patterns bought for all codes, sold for focus codes.

    completed: (code, pattern, side, params_hash) of an interrupted run; its tasks are left out when
    their parameters are the same.  Sells of other codes are dropped before any account is formed."""
    patterns = tuple(patterns)
    tasks = S.backtest_tasks(universe, focus, True, patterns)
    if completed is not None:
        tasks = S.pending_tasks(tasks, completed, S.params_key(hold=hold, cash=cash, cautious=cautious))
    held = focus.select("code").distinct().withColumn("_f", F.lit(True))
    served = bars.join(universe.select("code").distinct(), "code", "left_semi")
    cells = [(n, side) for n in patterns for side in ("buy", "sell")]
    codes = T.code_rows(served, patterns, cells, cautious).join(held, "code", "left")
    cands = T.code_candidates(codes, cells, (hold,), ("_f",), "side = 'buy' OR _f")
    found = M.account_figures(T.folded(cands, cash, traded=True), cash)
    covered = tasks.join(served.select("code").distinct(), "code", "left_semi")
    out = covered.join(found, ["code", "pattern", "side"], "left")
    return M.performance_table(out.select("code", "pattern", "side", *[
        F.coalesce(c, F.lit(0).cast(t)).alias(c) for c, t in (("trades", "long"), ("win_rate", "double"), ("return_pct", "double"),
                                                            ("sharpe", "double"), ("max_drawdown", "double"))]))


def daily_tracking(bars: DataFrame, day, performance: DataFrame, market: DataFrame, held: DataFrame, config: DataFrame,
                   mode: str = "full", cautious: bool = False, patterns: Iterable[str] = DAILY_PATTERNS, since=None) -> DataFrame:
    """The ranked signal list of a day: signals -> mode -> sell gate -> figures -> market -> tier -> follow-up."""
    later = bars if since is None else bars.filter(F.col("trade_date") >= F.lit(since).cast("date"))
    return _tracked(D.daily_signals(bars, day, patterns, cautious, since), later, performance, market, held, config, mode)


def daily_tracking_of(spark: SparkSession, store: str, day, performance: DataFrame, market: DataFrame, held: DataFrame, config: DataFrame,
                      mode: str = "full", cautious: bool = False, patterns: Iterable[str] = DAILY_PATTERNS) -> DataFrame:
    """The same over a store of bars: signals read the months that `recent_bars` finds, the follow-up those from the first day on."""
    first = min(str(d) for d in (day if isinstance(day, (list, tuple)) else [day]))
    found = D.daily_signals(B.recent_bars(spark, store, day), day, patterns, cautious)
    return _tracked(found, B.read_bars(spark, store, first), performance, market, held, config, mode)


def _tracked(found: DataFrame, later: DataFrame, performance: DataFrame, market: DataFrame, held: DataFrame, config: DataFrame, mode: str) -> DataFrame:
    judged = D.attach_performance(D.sell_gate(D.track_mode(found, config, mode), held), performance)
    return D.follow_up(D.tier(D.attach_market(judged, market)), later)

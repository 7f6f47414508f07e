"""Rule-based strategy signals (G1-G13) and the full-position accounts that trade them.

A rule returns `bars` columns it needs plus boolean `buy` and `sell`.  RULES is the registry users
extend: name -> function(bars, **parameters) -> DataFrame with `buy` and `sell`.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass, field
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wickspark.functions.pick import computed_once
from wickspark.model import COMMISSION, DAILY_BUY_ORDER, DAILY_SELL_ORDER, LOT, START_CASH
from wickspark.operators import candles, refine
from wickspark.operators import indicators as I
from wickspark.operators.candles import W

_BAR = ("code", "trade_date", "bar_idx", "open", "close")


@dataclass(frozen=True)
class Flags:
    """How a rule's flags are made: rolling columns, columns of the bar before, crossings, and the two conditions on them.

    A column's name tells its parameters, so rules that need the same column share it."""

    buy: str
    sell: str
    lines: dict[str, str] = field(default_factory=dict)
    lags: dict[str, str] = field(default_factory=dict)
    crosses: dict[str, tuple[str, str]] = field(default_factory=dict)


def with_columns_of(bars: DataFrame, rules: Iterable[Flags]) -> DataFrame:
    """bars with the columns that the rules need, each once, on one shared window."""
    rules = tuple(rules)
    every = lambda part: {k: v for r in rules for k, v in getattr(r, part).items()}
    df = I.lines(bars, **every("lines"))
    df = I.lagged(df, **every("lags")) if every("lags") else df
    return I.cross(df, **every("crosses")) if every("crosses") else df


def _flagged(bars: DataFrame, rule: Flags) -> DataFrame:
    return with_columns_of(bars, [rule]).selectExpr(*_BAR, f"{rule.buy} AS buy", f"{rule.sell} AS sell")


def breakout_flags(n: int = 20) -> Flags:
    return Flags(f"_up{n} = 1", f"_dn{n} = -1", {f"_hi{n}": I.highest("high", n), f"_lo{n}": I.lowest("low", n)},
                 {f"_hip{n}": f"_hi{n}", f"_lop{n}": f"_lo{n}"}, {f"_up{n}": ("close", f"_hip{n}"), f"_dn{n}": ("close", f"_lop{n}")})


def single_ma_flags(n: int = 20) -> Flags:
    return Flags(f"_c{n} = 1", f"_c{n} = -1", {f"_ma{n}": I.sma("close", n)}, {f"_map{n}": f"_ma{n}"}, {f"_c{n}": ("close", f"_map{n}")})


def double_ma_flags(short: int = 10, long: int = 60) -> Flags:
    name = f"_m{short}_{long}"
    return Flags(f"{name} = 1", f"{name} = -1", {f"_ma{n}": I.sma("close", n) for n in (short, long)}, {}, {name: (f"_ma{short}", f"_ma{long}")})


def combo_flags(n: int = 20, short: int = 10, long: int = 60) -> Flags:
    a, b = breakout_flags(n), double_ma_flags(short, long)
    return Flags(f"({a.buy} OR {b.buy})", f"({a.sell} OR {b.sell})", a.lines | b.lines, a.lags, a.crosses | b.crosses)


def near_ma_flags(periods: Iterable[int] = (10, 60, 90, 60, 90), diff: float = 0.01) -> Flags:
    periods = tuple(dict.fromkeys(periods))
    near = " OR ".join(f"coalesce(close - _ma{p} > 0 AND close - _ma{p} < close * {diff}D, false)" for p in periods)
    return Flags(f"({near})", f"({' OR '.join(f'_x{p} = -1' for p in periods)})", {f"_ma{p}": I.sma("close", p) for p in periods}, {}, {f"_x{p}": ("close", f"_ma{p}") for p in periods})


def near_window_flags(n: int = 30, diff: float = 0.01) -> Flags:
    return Flags(f"coalesce(abs(close - _lo{n}) < close * {diff}D, false)", f"coalesce(abs(close - _hi{n}) < close * {diff}D, false)",
                 {f"_hi{n}": I.highest("high", n), f"_lo{n}": I.lowest("low", n)})


#: Rules whose flags are columns of the bar, so that many parameter sets fit in one row.
SWEPT: dict[str, Callable[..., Flags]] = {
    "breakout": breakout_flags, "single_ma": single_ma_flags, "double_ma": double_ma_flags, "combo": combo_flags, "near_ma": near_ma_flags, "near_window": near_window_flags,
}


def breakout(bars: DataFrame, n: int = 20) -> DataFrame:
    """G1: close crosses the previous bar's n-high upwards, or its n-low downwards."""
    return _flagged(bars, breakout_flags(n))


def single_ma(bars: DataFrame, n: int = 20) -> DataFrame:
    """Close against the previous bar's mean."""
    return _flagged(bars, single_ma_flags(n))


def double_ma(bars: DataFrame, short: int = 10, long: int = 60) -> DataFrame:
    """Short mean against long mean."""
    return _flagged(bars, double_ma_flags(short, long))


def _indicator_flags(bars: DataFrame, n: int, short: int, long: int, turtle_long: int, turtle_short: int,
                     near: tuple[int, ...] = (), diff: float = 0.01, atr_n: int = 14) -> DataFrame:
    """All flags of the indicator rules side by side, on one window."""
    df = I.atr(bars, atr_n)
    df = I.lines(df, _h=I.highest("high", n), _l=I.lowest("low", n), _s=I.sma("close", short),
                 _m=I.sma("close", long), _th=I.highest("high", turtle_long), _tl=I.lowest("low", turtle_short),
                 **{f"_n{p}": I.sma("close", p) for p in near})
    df = I.lagged(df, _hp="_h", _lp="_l", _thp="_th", _tlp="_tl")
    df = I.cross(df, _up=("close", "_hp"), _dn=("close", "_lp"), _ma=("_s", "_m"), _tu=("close", "_thp"),
                 _td=("close", "_tlp"), **{f"_x{p}": ("close", f"_n{p}") for p in near})
    close_to = " OR ".join(f"(close - _n{p} > 0 AND close - _n{p} < close * {diff}D)" for p in near) or "false"
    left = " OR ".join(f"_x{p} = -1" for p in near) or "false"
    return df.selectExpr(*_BAR, "atr", "_up = 1 AS buy_breakout", "_dn = -1 AS sell_breakout",
                         "_ma = 1 AS buy_ma", "_ma = -1 AS sell_ma", "_tu <> 0 AS buy_turtle",
                         "_td < 0 AS sell_turtle", f"coalesce({close_to}, false) AS buy_near", f"{left} AS sell_near")


def combo(bars: DataFrame, n: int = 20, short: int = 10, long: int = 60) -> DataFrame:
    """Breakout or double mean, on each side."""
    return _flagged(bars, combo_flags(n, short, long))


def turtle(bars: DataFrame, long: int = 20, short: int = 10) -> DataFrame:
    """Any crossing of the n-high enters (a downward one too), a break of the n-low leaves;
    the volatility stop depends on the entry price and belongs to `turtle_trades`."""
    df = _indicator_flags(bars, long, short, long, long, short)
    return df.selectExpr(*_BAR, "atr", "buy_turtle AS buy", "sell_turtle AS sell")


def near_ma(bars: DataFrame, periods: Iterable[int] = (10, 60, 90, 60, 90), diff: float = 0.01) -> DataFrame:
    """Buy just above any of the means, sell when close falls through any of them."""
    return _flagged(bars, near_ma_flags(periods, diff))


def near_window(bars: DataFrame, n: int = 30, diff: float = 0.01) -> DataFrame:
    """Buy near the n-low, sell near the n-high."""
    return _flagged(bars, near_window_flags(n, diff))


def indicator_union(bars: DataFrame, n: int = 20, short: int = 10, long: int = 60, turtle_long: int = 20,
                    turtle_short: int = 10, near: tuple[int, ...] = ()) -> DataFrame:
    """G8 (near=() ) and G9 (near means given): the last matching rule names the signal; buy_other and sell_other leave the turtle out."""
    df = _indicator_flags(bars, n, short, long, turtle_long, turtle_short, near)
    buy = ("CASE WHEN buy_turtle THEN 'turtle' WHEN buy_near THEN 'near_ma' WHEN buy_ma THEN 'double_ma' "
           "WHEN buy_breakout THEN 'breakout' END")
    plain = lambda side: f"CASE WHEN {side}_near THEN 'near_ma' WHEN {side}_ma THEN 'double_ma' WHEN {side}_breakout THEN 'breakout' END"
    sell = ("CASE WHEN sell_turtle THEN 'turtle' WHEN sell_near THEN 'near_ma' WHEN sell_ma THEN 'double_ma' "
            "WHEN sell_breakout THEN 'breakout' END")
    return df.selectExpr(*_BAR, "atr", f"{buy} AS buy_signal", f"{sell} AS sell_signal",
                         f"({buy}) IS NOT NULL AS buy", f"({sell}) IS NOT NULL AS sell",
                         f"{plain('buy')} AS buy_other", f"{plain('sell')} AS sell_other")


def indicator_union_v2(bars: DataFrame, near: tuple[int, ...] = (10, 20, 60, 90), **kw) -> DataFrame:
    """G9"""
    return indicator_union(bars, near=near, **kw)


# The patterns of the combined strategy, in the order they are tested (last wins).
COMBO_BUYS = (("CDLSEPARATINGLINES", "CDLSEPARATINGLINES"), ("CDLTASUKIGAP", "CDLTASUKIGAP"),
              ("CDLINVERTEDHAMMER", "CDLINVERTEDHAMMER"), ("CDLDRAGONFLYDOJI", "CDLDRAGONFLYDOJI"),
              ("CDLTAKURI", "CDLTAKURI"), ("CDLMARUBOZU", "CDLTAKURI"))
COMBO_SELLS = ("CDLADVANCEBLOCK", "CDLDARKCLOUDCOVER", "CDLEVENINGDOJISTAR", "CDLEVENINGSTAR", "CDLINNECK",
               "CDLONNECK", "CDLEVENINGDOJISTAR", "CDLDARKCLOUDCOVER", "CDLSTALLEDPATTERN")


def pattern_combo(bars: DataFrame) -> DataFrame:
    """Six cautious buy patterns and seven sell patterns; the last match names the signal."""
    rules = refine.signal_rules()
    names = tuple(dict.fromkeys([p for p, _ in COMBO_BUYS] + list(COMBO_SELLS)))
    df = candles.frame(bars).select(*_BAR, *[candles.pattern_value(n) for n in names],
                                    *[F.expr(str(rules[p])).alias(f"_ok_{p}") for p, _ in COMBO_BUYS])
    buy = " ".join(f"WHEN {p} > 0 AND _ok_{p} THEN '{shown}'" for p, shown in reversed(COMBO_BUYS))
    sell = " ".join(f"WHEN {p} < 0 THEN '{p}'" for p in reversed(COMBO_SELLS))
    out = df.selectExpr(*_BAR, f"CASE {buy} END AS buy_signal", f"CASE {sell} END AS sell_signal")
    return out.selectExpr("*", "buy_signal IS NOT NULL AS buy", "sell_signal IS NOT NULL AS sell")


def cautious_pattern(bars: DataFrame, pattern: str) -> DataFrame:
    """One pattern with its rule at the signal bar; value < 0 sells."""
    rule = refine.signal_rules()[pattern]
    df = candles.frame(bars).select(*_BAR, candles.pattern_value(pattern).alias("_v"), F.expr(str(rule)).alias("_ok"))
    return df.selectExpr(*_BAR, "_v > 0 AND coalesce(_ok, false) AS buy", "_v < 0 AS sell")


def last_match_signal(bars: DataFrame, side: str, cautious: bool = False) -> DataFrame:
    """Of the 59 daily patterns the last one in list order that fires on a bar: the last of the row's values, without a grouping."""
    order = DAILY_BUY_ORDER if side == "buy" else DAILY_SELL_ORDER
    rules = refine.signal_rules() if cautious and side == "buy" else {}  # a rule judges buys only
    value = lambda n: F.when(F.expr(str(rules[n])), candles.pattern_value(n)).otherwise(F.lit(0)) if n in rules else candles.pattern_value(n)
    fired = lambda v, i: F.when(v > 0 if side == "buy" else v < 0, i + 1).otherwise(F.lit(0))
    rows = candles.frame(bars).select("code", "trade_date", F.array(*[value(n) for n in order]).alias("_v"))
    rows = computed_once(rows, _last=F.array_max(F.transform("_v", fired))).filter("_last > 0")
    found = computed_once(rows.select("code", "trade_date", "_last"), pattern=F.element_at(F.array(*map(F.lit, order)), F.col("_last")))
    return found.select("code", "trade_date", refine.alias_pattern().alias("pattern"), F.lit(side).alias("side"))


def pattern_side_signal(bars: DataFrame, pattern: str, side: str) -> DataFrame:
    """The bars on which a pattern speaks for one side."""
    found = candles.signals(bars, [pattern])
    return found.filter("value > 0" if side == "buy" else "value < 0").select("code", "trade_date", "pattern", "value")


RULES: dict[str, Callable[..., DataFrame]] = {
    "breakout": breakout, "single_ma": single_ma, "double_ma": double_ma, "combo": combo, "turtle": turtle,
    "near_ma": near_ma, "near_window": near_window, "indicator_union": indicator_union,
    "indicator_union_v2": indicator_union_v2, "pattern_combo": pattern_combo,
}


def register(name: str, rule: Callable[..., DataFrame]) -> None:
    """Add a rule of your own; it must return the `_BAR` columns plus `buy` and `sell`."""
    RULES[name] = rule


def rule_of_code(decide: Callable[..., pd.DataFrame], needs: Iterable[str] = ("open", "high", "low", "close", "vol")) -> Callable[..., DataFrame]:
    """A rule written as plain Python, for what columns can't say: state that each bar takes on from the one before.

    decide(bars, **parameters) gets the bars of one code by date, as a pandas frame with trade_date, bar_idx and the columns it needs, and
    returns one with boolean `buy` and `sell` for the same bars; anything else ends the query with the code's name. A null flag is no flag.
    Codes are dealt by hash and handed over as Arrow batches; a code is bounded by the calendar (one row a day). The result can be registered,
    traded and swept like any rule."""
    needs = tuple(dict.fromkeys(("open", "close", *needs)))
    shown = _BAR

    def checked(flags, own: pd.DataFrame) -> dict:
        code = own["code"].iloc[0]
        if not isinstance(flags, pd.DataFrame) or len(flags) != len(own) or not {"buy", "sell"} <= set(flags.columns):
            raise ValueError(f"{code}: a rule returns a frame with buy and sell for each of the {len(own)} bars")
        out = {}
        for side in ("buy", "sell"):
            values = flags[side].astype(object).where(flags[side].notna(), False)
            if not values.map(lambda v: v is True or v is False or type(v).__name__ in ("bool", "bool_")).all():
                raise ValueError(f"{code}: {side} is not boolean")
            out[side] = values.astype(bool).to_numpy()
        return out

    def rule(bars: DataFrame, **parameters) -> DataFrame:
        rows = candles.bar_index(bars).select("code", "trade_date", "bar_idx", *needs)
        kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}

        def run(own: pd.DataFrame) -> pd.DataFrame:
            own = own.sort_values("trade_date", ignore_index=True)
            return own[list(shown)].assign(**checked(decide(own.copy(), **parameters), own))

        return rows.groupBy("code").applyInPandas(run, ", ".join(f"{c} {kinds[c]}" for c in shown) + ", buy boolean, sell boolean")

    return rule


# --- T10 ----------------------------------------------------------------------------------------

_TRADE = "struct<entry_date:date,entry_price:double,exit_date:date,exit_price:double,size:double,cash_out:double,is_open:boolean>"


def flag_trades(flags: DataFrame, cash: float = START_CASH, margin: float = 1.001,
                keys: Iterable[str] = ("code",)) -> DataFrame:
    """Flat and buy -> whole lots at the next open; held and sell -> out at the next open.

    Only flagged bars enter the fold.  An order the next open makes too dear leaves the account flat;
    a position still open at the end is valued at the last close.
    """
    keys = tuple(keys)
    return _folded(flags.selectExpr(*keys, "trade_date", "close", "buy", "sell", *_what_follows(keys)), cash, margin, keys)


def _what_follows(keys: tuple[str, ...]) -> list[str]:
    """The next bar's open and date, and the last bar's close and date."""
    by = f"OVER (PARTITION BY {', '.join(keys)} ORDER BY trade_date)"
    ends = (f"OVER (PARTITION BY {', '.join(keys)} ORDER BY trade_date "
            "ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)")
    return [f"lead(open) {by} AS next_open", f"lead(trade_date) {by} AS next_date", f"last(close) {ends} AS last_close", f"last(trade_date) {ends} AS last_date"]


def _folded(seen: DataFrame, cash: float, margin: float, keys: tuple[str, ...]) -> DataFrame:
    """The accounts of flagged bars that carry what follows them."""
    ordered = (seen.filter("(buy OR sell) AND next_date IS NOT NULL").groupBy(*keys).agg(
        F.sort_array(F.collect_list(F.struct("trade_date", "buy", "sell", "close", "next_open", "next_date"))).alias("_e"),
        F.first("last_close").alias("last_close"), F.first("last_date").alias("last_date")))
    shares = f"(acc.cash / nullif(x.close * {margin}D, 0))"
    lots = f"(({shares} - {shares} % 1) / {LOT})"
    size = f"(({lots} - {lots} % 1) * {LOT})"
    cost = f"{size} * x.next_open * {1 + COMMISSION}D"
    gain = f"(acc.cash + acc.size * x.next_open * {1 - COMMISSION}D)"
    fold = f"""aggregate(_e, named_struct('cash', {cash}D, 'size', 0D, 'price', 0D, 'since', CAST(NULL AS DATE),
                 'trades', CAST(array() AS array<{_TRADE}>)),
        (acc, x) -> CASE
            WHEN acc.size = 0 AND x.buy AND {size} > 0 AND {cost} <= acc.cash THEN
                named_struct('cash', acc.cash - {cost}, 'size', {size}, 'price', x.next_open, 'since', x.next_date,
                             'trades', acc.trades)
            WHEN acc.size > 0 AND x.sell THEN
                named_struct('cash', {gain}, 'size', 0D, 'price', 0D, 'since', CAST(NULL AS DATE), 'trades',
                    concat(acc.trades, array(named_struct('entry_date', acc.since, 'entry_price', acc.price,
                        'exit_date', x.next_date, 'exit_price', x.next_open, 'size', acc.size, 'cash_out', {gain},
                        'is_open', false))))
            ELSE acc END,
        acc -> IF(acc.size > 0, concat(acc.trades, array(named_struct('entry_date', acc.since, 'entry_price', acc.price,
            'exit_date', last_date, 'exit_price', last_close, 'size', acc.size,
            'cash_out', acc.cash + acc.size * last_close, 'is_open', true))), acc.trades))"""
    rows = ordered.selectExpr(*keys, "last_date", "last_close", f"{fold} AS _t").selectExpr(*keys, "posexplode(_t) AS (_no, t)")
    return rows.selectExpr(*keys, "CAST(_no + 1 AS INT) AS trade_no", "t.*",
                           "(t.exit_price / nullif(t.entry_price, 0) - 1) * 100 AS pnl_pct")


def turtle_trades(signals: DataFrame, cash: float = START_CASH, margin: float = 1.001, cash_share: float | None = None) -> DataFrame:
    """T10 for G5 and G8: accounts with the volatility stop and the turtle's own lot size.

    signals: `turtle()` or `indicator_union()` output.  A turtle entry buys 1 % of cash per ATR
    (cash_share=None) or a share of cash; any other entry buys full.  Its stop is two ATR under the
    entry; a further turtle entry after a non-turtle exit needs half an ATR above the last price,
    at most five in a row.  The stop can fire on any bar, so the fold runs over all bars of a code.
    """
    if "buy_signal" not in signals.columns:
        signals = signals.selectExpr("*", "IF(buy, 'turtle', NULL) AS buy_signal", "IF(sell, 'turtle', NULL) AS sell_signal")
    seen = signals.selectExpr("code", "trade_date", "close", "atr", "buy_signal", "sell_signal",
                              f"lead(open) {W} AS next_open", f"lead(trade_date) {W} AS next_date")
    ordered = seen.groupBy("code").agg(
        F.sort_array(F.collect_list(F.struct("trade_date", "close", "atr", "buy_signal", "sell_signal",
                                             "next_open", "next_date"))).alias("_e"))
    full = f"(floor(acc.cash / nullif(x.close * {margin}D, 0) / {LOT}) * {LOT})"
    share = (f"(floor(acc.cash * {cash_share}D / nullif(x.close * {margin}D, 0) / {LOT}) * {LOT})" if cash_share
             else f"(floor(acc.cash * 0.01D / nullif(x.atr, 0) / {LOT}) * {LOT})")
    size = f"CAST(coalesce(IF(x.buy_signal = 'turtle', {share}, {full}), 0) AS DOUBLE)"
    again = "(x.buy_signal <> 'turtle' OR acc.n = 0 OR (x.close > acc.price + 0.5D * x.atr AND acc.n <= 4))"
    cost = f"{size} * x.next_open * {1 + COMMISSION}D"
    gain = f"(acc.cash + acc.size * x.next_open * {1 - COMMISSION}D)"
    out = ("(x.sell_signal = 'turtle' OR x.close < acc.price - 2 * x.atr) AND acc.n > 0")
    other = "(x.sell_signal IS NOT NULL AND x.sell_signal <> 'turtle')"
    done = "struct<entry_date:date,entry_price:double,exit_date:date,exit_price:double,size:double,signal:string,exit_signal:string,cash_out:double>"
    fold = f"""aggregate(_e, named_struct('cash', {cash}D, 'size', 0D, 'price', 0D, 'n', 0, 'since', CAST(NULL AS DATE),
                 'signal', CAST(NULL AS STRING), 'trades', CAST(array() AS array<{done}>)),
        (acc, x) -> CASE
            WHEN x.next_date IS NULL THEN acc
            WHEN acc.size = 0 AND x.buy_signal IS NOT NULL AND {again} AND {size} > 0 AND {cost} <= acc.cash THEN
                named_struct('cash', acc.cash - {cost}, 'size', {size}, 'price', x.next_open,
                    'n', acc.n + IF(x.buy_signal = 'turtle', 1, 0), 'since', x.next_date, 'signal', x.buy_signal,
                    'trades', acc.trades)
            WHEN acc.size > 0 AND (coalesce({out}, false) OR coalesce({other}, false)) THEN
                named_struct('cash', {gain}, 'size', 0D, 'price', acc.price, 'n', IF(coalesce({out}, false), 0, acc.n),
                    'since', CAST(NULL AS DATE), 'signal', CAST(NULL AS STRING), 'trades',
                    concat(acc.trades, array(named_struct('entry_date', acc.since, 'entry_price', acc.price,
                        'exit_date', x.next_date, 'exit_price', x.next_open, 'size', acc.size, 'signal', acc.signal,
                        'exit_signal', IF(coalesce({out}, false), 'turtle', x.sell_signal), 'cash_out', {gain}))))
            ELSE acc END, acc -> acc.trades)"""
    rows = ordered.selectExpr("code", f"{fold} AS _t").selectExpr("code", "posexplode(_t) AS (_no, t)")
    return rows.selectExpr("code", "CAST(_no + 1 AS INT) AS trade_no", "t.*", "(t.exit_price / nullif(t.entry_price, 0) - 1) * 100 AS pnl_pct")


def stacked_trades(signals: DataFrame, cash: float = START_CASH, margin: float = 1.001, parts: float = 3) -> DataFrame:
    """T10 for G9: an account that adds to its position as long as a lot can be paid.

    signals: `indicator_union_v2()` output.  While the cash pays a lot at the close, a buy signal orders at the next
    open, whether or not a position is held: the turtle a part of the cash (its first entry at once, up to four more
    half an ATR above the last price; past five its signal gives way to the other rules), any other rule all of it.
    An order the next open makes too dear is not filled, but a turtle entry counts.  Only on bars whose close leaves no lot
    affordable a sell signal, or for turtle entries a close two ATR under the last price, ends the whole position.
    One row for each closed position; entry_price is the mean of its entries.
    """
    seen = signals.selectExpr("code", "trade_date", "close", "atr", "buy_signal", "buy_other", "sell_signal", "sell_other",
                              f"lead(open) {W} AS next_open", f"lead(trade_date) {W} AS next_date")
    ordered = seen.filter("next_date IS NOT NULL").groupBy("code").agg(
        F.sort_array(F.collect_list(F.struct(*seen.columns[1:]))).alias("_e"))
    done = ("struct<entry_date:date,entry_price:double,exit_date:date,exit_price:double,size:double,entries:int,signal:string,"
            "exit_signal:string,cash_out:double>")
    lot = lambda money: f"CAST(coalesce(floor({money} / nullif(x.close * {margin}D, 0) / {LOT}) * {LOT}, 0) AS DOUBLE)"
    let = lambda name, value, then: f"element_at(transform(array({value}), {name} -> {then}), 1)"
    size = f"""CASE WHEN b IS NULL THEN 0D WHEN b <> 'turtle' THEN full
        WHEN acc.n = 0 OR x.close > acc.price + 0.5D * x.atr THEN {lot(f"acc.cash / {parts}D")} ELSE 0D END"""
    filled = f"coalesce(lot > 0 AND lot * x.next_open * {1 + COMMISSION}D <= acc.cash, false)"
    counted = "acc.n + IF(b <=> 'turtle' AND (acc.n = 0 OR lot > 0), 1, 0)"
    bought = f"""IF({filled}, named_struct('cash', acc.cash - lot * x.next_open * {1 + COMMISSION}D, 'size', acc.size + lot,
            'spent', acc.spent + lot * x.next_open, 'price', x.next_open, 'n', {counted}, 'entries', acc.entries + 1,
            'since', coalesce(acc.since, x.next_date), 'signal', coalesce(acc.signal, b), 'trades', acc.trades),
        named_struct('cash', acc.cash, 'size', acc.size, 'spent', acc.spent, 'price', acc.price, 'n', {counted}, 'entries', acc.entries,
            'since', acc.since, 'signal', acc.signal, 'trades', acc.trades))"""
    out = "coalesce((x.sell_signal <=> 'turtle' OR x.close < acc.price - 2 * x.atr) AND acc.n > 0, false)"
    gain = f"(acc.cash + acc.size * x.next_open * {1 - COMMISSION}D)"
    sold = f"""named_struct('cash', {gain}, 'size', 0D, 'spent', 0D, 'price', acc.price, 'n', IF({out}, 0, acc.n), 'entries', 0,
            'since', CAST(NULL AS DATE), 'signal', CAST(NULL AS STRING), 'trades', concat(acc.trades, array(named_struct(
                'entry_date', acc.since, 'entry_price', acc.spent / acc.size, 'exit_date', x.next_date, 'exit_price', x.next_open,
                'size', acc.size, 'entries', acc.entries, 'signal', acc.signal,
                'exit_signal', IF({out}, 'turtle', x.sell_other), 'cash_out', {gain}))))"""
    name = "IF(x.buy_signal <=> 'turtle' AND acc.n > 4, x.buy_other, x.buy_signal)"
    buying = let("b", name, let("lot", size, bought))
    step = f"CASE WHEN full > 0 THEN {buying} WHEN acc.size > 0 AND ({out} OR x.sell_other IS NOT NULL) THEN {sold} ELSE acc END"
    fold = f"""aggregate(_e, named_struct('cash', {cash}D, 'size', 0D, 'spent', 0D, 'price', 0D, 'n', 0, 'entries', 0, 'since', CAST(NULL AS DATE),
            'signal', CAST(NULL AS STRING), 'trades', CAST(array() AS array<{done}>)),
        (acc, x) -> {let("full", lot("acc.cash"), step)}, acc -> acc.trades)"""
    rows = ordered.selectExpr("code", f"{fold} AS _t").selectExpr("code", "posexplode(_t) AS (_no, t)")
    return rows.selectExpr("code", "CAST(_no + 1 AS INT) AS trade_no", "t.*", "(t.exit_price / nullif(t.entry_price, 0) - 1) * 100 AS pnl_pct")


# --- M21 ----------------------------------------------------------------------------------------

def param_sweep(bars: DataFrame, rule: str, grid: Iterable[dict], cash: float = START_CASH,
                margin: float = 1.001) -> DataFrame:
    """Account return of every parameter set for every code.

    For the rules of SWEPT all sets are one plan: each rolling column that any set needs is made once, on one scan, exchange and sort
    of the bars, and a bar becomes a row for each set that flags it; accounts are folded by (code, set_no) within the code's
    partition. Other rules, and rules of your own, are one branch over the bars for each set."""
    grid = list(grid)
    labels = [",".join(f"{k}={v}" for k, v in params.items()) for params in grid]
    keys = ("code", "set_no")
    if not grid:
        raise ValueError("an empty grid")
    if rule in SWEPT:
        sets = [SWEPT[rule](**params) for params in grid]
        made = ", ".join(f"named_struct('set_no', {i}, 'buy', {r.buy}, 'sell', {r.sell})" for i, r in enumerate(sets))
        seen = with_columns_of(bars, sets).selectExpr("code", "trade_date", "close", *_what_follows(("code",)), f"filter(array({made}), s -> s.buy OR s.sell) AS _sets")
        rows = seen.filter("next_date IS NOT NULL").select("*", F.explode("_sets").alias("_set")).select("code", "_set.*", "trade_date", "close", "next_open", "next_date", "last_close", "last_date")
        traded = _folded(rows, cash, margin, keys)
    else:
        parts = [flag_trades(RULES[rule](bars, **params), cash, margin).withColumn("set_no", F.lit(i)) for i, params in enumerate(grid)]
        traded = reduce(DataFrame.unionByName, parts)
    final = traded.groupBy(*keys).agg(F.max_by("cash_out", "trade_no").alias("final_value"), F.count("*").alias("trades"))
    label = F.element_at(F.array(*map(F.lit, labels)), F.col("set_no") + 1)
    return final.select("code", "set_no", label.alias("params"), "trades", F.round(F.log(F.col("final_value") / cash) * 100, 4).alias("log_return"))


def best_params(sweep: DataFrame) -> DataFrame:
    """The parameter set with the highest return per code, the first one on a tie."""
    place = F.row_number().over(Window.partitionBy("code").orderBy(F.col("log_return").desc(), "set_no"))
    return sweep.withColumn("_place", place).filter("_place = 1").select("code", "set_no", "params", "trades", "log_return")

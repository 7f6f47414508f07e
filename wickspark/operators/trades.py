"""Trades from signals (T1-T8, T12-T14): declarative restatement of a bar-by-bar account.

A position opened at bar e has an exit that depends on prices only, so every signal is first given
its outcome by look-ahead columns on the shared window.  Choosing non-overlapping trades and sizing
them is a fold over the sparse, date-sorted candidates of one (code, pattern, side); the group is
bounded by the calendar because bars are unique per code and day.

All steps stay on the hash partitioning by code that the windows asked for: a grouping by
(code, pattern, side) needs no second exchange.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wickspark.model import (ALL_PATTERNS, COMMISSION, HOLD_DAYS, INVEST_FRACTION, LOT,
                             START_CASH, STOP_LABEL, STOP_LOSS)
from wickspark.operators import candles
from wickspark.operators.candles import W, bar_index
from wickspark.operators.refine import entry_rules
from wickspark.operators.selection import fill_forward_zero

KEYS = ("code", "pattern", "side")
NEVER = 2147483647
SPAN = 64  # bars of one run, by which bars meet stretches of an account
PAGE = 64  # trades are appended page by page: appending to one long array would copy it every time
WHOLE = ("OVER (PARTITION BY code ORDER BY trade_date "
         "ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)")


# --- T1, T3, T4, T8: the outcome of entering on the bar after this one --------------------------

def ahead_of(holds: Iterable[int]) -> list[str]:
    """Window expressions: the next bars up to the longest holding period, and the last bar's index."""
    return [f"lead(struct(open AS o, close AS c, trade_date AS d), {k}) {W} AS _x{k}" for k in range(1, max(holds) + 3)
            ] + [f"CAST(count(*) {WHOLE} - 1 AS INT) AS last_idx"]


def with_outcomes(rows: DataFrame, keep: Iterable[str], holds: Iterable[int], combined: bool = False) -> DataFrame:
    """Outcome of a position opened at the next bar's open, per side and holding period.

    rows carry `bar_idx` and the `ahead_of` columns.  Returns `keep`, `last_idx` and, per period n,
    `_buy{n}` and `_sell{n}` (null where nothing can be opened).  The stop bar and the kind of exit
    are columns of their own, so that the outcome structs stay small expressions.
    """
    holds = tuple(holds)
    ahead = range(1, max(holds) + 3)
    keep = tuple(dict.fromkeys((*keep, "bar_idx", "last_idx")))
    look = rows.selectExpr(*keep, *[f"_x{k}" for k in ahead], f"array({', '.join(f'_x{k}' for k in ahead)}) AS _path",
                           f"array({', '.join(f'_x{k}.c' for k in ahead)}) AS _closes", "last_idx - bar_idx AS _n")
    # offsets count from the entry bar, which is one after the signal bar; short positions have no stop
    stops, kinds, ends, out = [], [], [], []
    for n in holds:
        breach = " ".join(f"WHEN _x{k + 1}.c / nullif(_x1.o, 0) - 1 <= {STOP_LOSS}D THEN {k}"
                          for k in range(1, n if combined else n + 1))
        stops.append(f"CASE {breach} END AS _stop{n}" if breach else f"CAST(NULL AS INT) AS _stop{n}")
        kinds += [f"CASE WHEN _stop{n} IS NULL AND _n >= {n + 1} THEN 'hold' WHEN _n >= _stop{n} + 2 THEN 'stop' "
                  f"ELSE 'end' END AS _kbuy{n}", f"CASE WHEN _n >= {n + 1} THEN 'hold' ELSE 'end' END AS _ksell{n}"]
        for side in ("buy", "sell"):
            kind = f"_k{side}{n}"
            stay = n if combined else n + 1
            ends += [f"CASE {kind} WHEN 'stop' THEN _stop{n} + 1 WHEN 'hold' THEN {n} ELSE greatest(_n - 1, 0) END AS _off{side}{n}",
                     f"CASE {kind} WHEN 'stop' THEN _stop{n} + 1 WHEN 'hold' THEN {stay} ELSE greatest(_n, 0) END AS _held{side}{n}"]
            at = f"element_at(_path, _off{side}{n} + 1)"
            out.append(
                f"CASE WHEN _n >= 1 AND _x1.o > 0 THEN named_struct("
                f"'entry_idx', bar_idx + 1, 'entry_date', _x1.d, 'entry_price', _x1.o, "
                f"'exit_idx', bar_idx + 1 + _off{side}{n}, 'exit_date', {at}.d, "
                f"'exit_price', IF({kind} = 'end', {at}.c, {at}.o), 'exit_reason', {kind}, 'held_bars', _held{side}{n}, "
                f"'next_free', IF({kind} = 'end', {NEVER}, bar_idx + 1 + _held{side}{n}), 'last_idx', last_idx, "
                f"'closes', slice(_closes, 1, _held{side}{n})) END AS _{side}{n}")
    staged = look.selectExpr("*", *stops).selectExpr("*", *kinds).selectExpr("*", *ends)
    return staged.selectExpr(*keep, *out)


def outcomes_by_period(signals: DataFrame, holds: Iterable[int], keep: Iterable[str]) -> DataFrame:
    """Signals (value, bar_idx, last_idx, _path) -> a candidate for each holding period that a position can be opened for: `keep`, `hold`, `side` and CANDIDATE.

    `_path` is what lies ahead (o, c, d), up to the longest period. Where the stop is hit first doesn't depend on the period: it is found once, and a
    period has it if it isn't shorter. All else follows from the period as a column."""
    holds, keep = tuple(holds), tuple(keep)
    breach = " ".join(f"WHEN _path[{k}].c / nullif(_path[0].o, 0) - 1 <= {STOP_LOSS}D THEN {k}" for k in range(1, max(holds) + 1))
    at = "element_at(_path, _off + 1)"
    rows = (
        signals.selectExpr(*keep, "bar_idx", "last_idx", "_path", "last_idx - bar_idx AS _n", "IF(value > 0, 'buy', 'sell') AS side", f"IF(value > 0, CASE {breach} END, NULL) AS _first")
        .filter("_n >= 1 AND _path[0].o > 0").select("*", F.explode(F.array(*map(F.lit, holds))).alias("hold"))
        .selectExpr("*", "IF(_first <= hold, _first, NULL) AS _stop")
        .selectExpr("*", "CASE WHEN _stop IS NULL AND _n >= hold + 1 THEN 'hold' WHEN _n >= _stop + 2 THEN 'stop' ELSE 'end' END AS exit_reason")
        .selectExpr("*", "CASE exit_reason WHEN 'stop' THEN _stop + 1 WHEN 'hold' THEN hold ELSE greatest(_n - 1, 0) END AS _off",
                    "CASE exit_reason WHEN 'stop' THEN _stop + 1 WHEN 'hold' THEN hold + 1 ELSE greatest(_n, 0) END AS held_bars")
    )
    return rows.selectExpr(
        *keep, "hold", "side", "bar_idx + 1 AS entry_idx", "_path[0].d AS entry_date", "_path[0].o AS entry_price", "bar_idx + 1 + _off AS exit_idx", f"{at}.d AS exit_date",
        f"IF(exit_reason = 'end', {at}.c, {at}.o) AS exit_price", "exit_reason", "held_bars", f"IF(exit_reason = 'end', {NEVER}, bar_idx + 1 + held_bars) AS next_free", "last_idx",
        "slice(_path.c, 1, held_bars) AS closes")


def outcomes(bars: DataFrame, hold: int = HOLD_DAYS, combined: bool = False) -> DataFrame:
    """Bars + `_buy` and `_sell` for one holding period.

    combined=True is the one-account variant (T9): the hold exit of bar e+hold comes before the
    stop test of that bar, and a new entry may share the exit bar.
    """
    bars = fill_forward_zero(bars)
    rows = bars.selectExpr("*", *([] if "bar_idx" in bars.columns else [candles.BAR_INDEX]), *ahead_of([hold]))
    df = with_outcomes(rows, bars.columns, [hold], combined)
    return df.withColumnsRenamed({f"_buy{hold}": "_buy", f"_sell{hold}": "_sell"})


def pattern_rows(bars: DataFrame, names: Iterable[str], holds: Iterable[int], guarded: dict | None = None) -> DataFrame:
    """`_values` of the patterns and the outcomes of entering after each bar, from one window pass."""
    holds = tuple(holds)
    rows = candles.frame(bars, ahead_of(holds)).select(
        "code", "trade_date", "bar_idx", "last_idx", *[f"_x{k}" for k in range(1, max(holds) + 3)],
        candles.values(names).alias("_values"), *[F.expr(str(r)).alias(f"_ok_{n}") for n, r in (guarded or {}).items()])
    return with_outcomes(rows, ("code", "trade_date", "_values", *[f"_ok_{n}" for n in (guarded or {})]), holds)


CANDIDATE = ("entry_idx", "entry_date", "entry_price", "exit_idx", "exit_date", "exit_price", "exit_reason",
             "held_bars", "next_free", "last_idx", "closes")


def candidate_trades(bars: DataFrame, names: Iterable[str] | None = None, hold: int = HOLD_DAYS,
                     cautious: bool = False, sides: Iterable[str] = ("buy", "sell")) -> DataFrame:
    """One row per signal that can open a position, with its outcome. Missing prices are filled forward first."""
    bars = fill_forward_zero(bars)
    names = tuple(names or ALL_PATTERNS)
    sides = tuple(sides)
    rules = entry_rules(ahead=1) if cautious else {}
    guarded = {n: rules[n] for n in names if n in rules}
    rows = pattern_rows(bars, names, [hold], guarded).withColumnsRenamed({f"_buy{hold}": "_buy", f"_sell{hold}": "_sell"})
    long = candles.unpivot(rows, names, "code", "trade_date", "bar_idx", "_buy", "_sell",
                           *[f"_ok_{n}" for n in guarded])
    if guarded:
        arms = " ".join(f"WHEN '{n}' THEN _ok_{n}" for n in guarded)
        long = long.filter(f"coalesce(CASE pattern {arms} ELSE true END, false)")
    return pick_side(long, sides)


def pick_side(long: DataFrame, sides: Iterable[str] = ("buy", "sell")) -> DataFrame:
    """Signal rows with `_buy`/`_sell` -> candidate rows: value > 0 buys, value < 0 sells short."""
    wanted = ", ".join(f"'{s}'" for s in sides)
    return (long.selectExpr("code", "pattern", "IF(value > 0, 'buy', 'sell') AS side",
                            "trade_date AS signal_date", "IF(value > 0, _buy, _sell) AS _t")
            .filter(f"_t IS NOT NULL AND side IN ({wanted})")
            .selectExpr("code", "pattern", "side", "signal_date", *[f"_t.{c}" for c in CANDIDATE]))


def candidates_of(bars: DataFrame, signals: DataFrame, hold: int = HOLD_DAYS) -> DataFrame:
    """T1 for signals that come as a table (code, trade_date, pattern, value)."""
    look = outcomes(bars, hold).select("code", "trade_date", "_buy", "_sell")
    return pick_side(signals.join(look, ["code", "trade_date"]))


# --- T2, T5: the account ------------------------------------------------------------------------

def select_trades(candidates: DataFrame, cash: float = START_CASH, keys: Iterable[str] = KEYS,
                  extra: Iterable[str] = (), combined: bool = False) -> DataFrame:
    """T2 + T5: greedy non-overlapping trades with lot size, fees and cash after each of them."""
    return explode_trades(accounts(candidates, cash, keys, extra), keys, extra, combined)


def accounts(candidates: DataFrame, cash: float = START_CASH, keys: Iterable[str] = KEYS,
             extra: Iterable[str] = ()) -> DataFrame:
    """One row per account (keys) with its `trades` array."""
    keys, extra = tuple(keys), tuple(extra)
    fields = CANDIDATE + extra + (("side",) if "side" not in keys else ())
    grouped = candidates.groupBy(*keys).agg(
        F.sort_array(F.collect_list(F.struct(*fields))).alias("_c"))
    return folded(grouped, cash, keys)


def folded(grouped: DataFrame, cash: float = START_CASH, keys: Iterable[str] = KEYS, also: Iterable[str] = (), traded: bool = False) -> DataFrame:
    """Accounts (keys, `also`) with their candidates in order as `_c` -> the same with `trades`; traded: only those that have any.

    Trades come by exploding an array of one: a filter on what is made of them would be pushed below the fold and run it again for every mention."""
    keys = tuple(keys)
    side = "side" if "side" in keys else "x.side"
    shares = f"(acc.cash * {INVEST_FRACTION}D / x.entry_price)"
    lots = f"(({shares} - {shares} % 1) / {LOT})"
    whole = f"(({lots} - {lots} % 1) * {LOT})"  # whole lots; a double, as compounding may pass a long
    size = "z"  # bound once for each step
    into = (f"IF({side} = 'buy', acc.cash - {size} * x.entry_price * {1 + COMMISSION}D, "
            f"acc.cash + {size} * x.entry_price * {1 - COMMISSION}D)")
    out = (f"IF({side} = 'buy', {into} + {size} * x.exit_price * {1 - COMMISSION}D, "
           f"{into} - {size} * x.exit_price * {1 + COMMISSION}D)")
    schema = grouped.schema["_c"].dataType.elementType.simpleString()
    done = f"struct<c:{schema},size:double,cash_before:double,cash_in:double,cash_out:double>"
    trade = f"array(named_struct('c', x, 'size', {size}, 'cash_before', acc.cash, 'cash_in', {into}, 'cash_out', {out}))"
    full = f"size(acc.page) >= {PAGE}"
    fold = f"""aggregate(_c,
        named_struct('free', -1, 'cash', {cash}D, 'pages', CAST(array() AS array<array<{done}>>), 'page', CAST(array() AS array<{done}>)),
        (acc, x) -> IF(x.entry_idx >= acc.free, transform(array({whole}), z -> IF({size} > 0,
            named_struct('free', x.next_free, 'cash', {out},
                         'pages', IF({full}, concat(acc.pages, array(acc.page)), acc.pages),
                         'page', IF({full}, {trade}, concat(acc.page, {trade}))),
            acc))[0], acc),
        acc -> flatten(concat(acc.pages, array(acc.page))))"""
    one = f"array({fold})"
    return grouped.selectExpr(*keys, *also, f"explode({f'filter({one}, t -> size(t) > 0)' if traded else one}) AS trades")


# --- accounts from one row per code -------------------------------------------------------------


def gathered_rows(bars: DataFrame, names: Iterable[str], cells: Iterable[tuple[str, str]], cautious: bool = False) -> DataFrame:
    """One row per code: `_dates`, `_opens` and `_closes` of its bars in order, and `_fired`, of each bar the cells (places in `cells`) with a signal."""
    names, place = tuple(names), places(cells)
    rules = entry_rules(ahead=1) if cautious else {}
    rows = candles.frame(fill_forward_zero(bars))
    guarded = {n: rules[n] for n in names if n in rules}
    if guarded:
        rows = rows.select("*", *[F.expr(str(r)).alias(f"_ok_{n}") for n, r in guarded.items()])
    fired = []  # of each pattern the cell that its value names, -1 for none
    for n in names:
        named = F.array(F.lit(place.get((n, "sell"), -1)), F.lit(-1), F.lit(place.get((n, "buy"), -1)))
        cell = F.coalesce(F.get(named, F.signum(candles.pattern_value(n)).cast("int") + 1), F.lit(-1))
        fired.append(F.when(F.col(f"_ok_{n}"), cell).otherwise(F.lit(-1)) if n in guarded else cell)
    rows = rows.select("code", "trade_date", "open", "close", F.array_remove(F.array(*fired), -1).alias("fired"))
    gathered = rows.groupBy("code").agg(F.sort_array(F.collect_list(F.struct("trade_date", "open", "close", "fired"))).alias("_g"))
    return gathered.selectExpr("code", "_g.trade_date AS _dates", "_g.open AS _opens", "_g.close AS _closes", "_g.fired AS _fired")


def places(cells: Iterable[tuple[str, str]]) -> dict[tuple[str, str], int]:
    """The place of each cell (pattern, side), the first one where it is named twice."""
    return {cell: k for k, cell in reversed(tuple(enumerate(cells)))}


def code_rows(bars: DataFrame, names: Iterable[str], cells: Iterable[tuple[str, str]], cautious: bool = False) -> DataFrame:
    """One row per code: `_dates`, `_opens` and `_closes` of its bars in order, and `_at`, for each cell (pattern, side) the bars with its signal.

    What is gathered is a narrow row per bar, bounded by the calendar, and not one per signal with its outcome: the
    accounts of all patterns are formed from this row in place, and nothing is sorted or gathered again."""
    cells = tuple(cells)
    place = places(cells)
    gathered = gathered_rows(bars, names, cells, cautious)
    # signals as cell * 2^32 + bar, sorted among marks that stand before the first signal of each cell
    marks_ = f"transform(sequence(0, {len(cells)}), c -> shiftleft(CAST(c AS BIGINT), 32) - 1)"
    listed = gathered.selectExpr(
        "code", "_dates", "_opens", "_closes",
        f"sort_array(concat({marks_}, flatten(transform(_fired, (f, i) -> transform(f, c -> shiftleft(CAST(c AS BIGINT), 32) + i))))) AS _s")
    listed = listed.selectExpr("*", "array_compact(transform(_s, (z, i) -> IF(z & 4294967295L = 4294967295L, i, NULL))) AS _p")
    wanted = f"array({', '.join(str(place[cell]) for cell in cells)})"
    lists = f"transform({wanted}, c -> transform(slice(_s, get(_p, c) + 2, get(_p, c + 1) - get(_p, c) - 1), z -> CAST(z & 4294967295L AS INT)))"
    return listed.selectExpr("code", "_dates", "_opens", "_closes", f"{lists} AS _at")


def code_candidates(codes: DataFrame, cells: Iterable[tuple[str, str]], holds: Iterable[int] = (HOLD_DAYS,), also: Iterable[str] = (),
                    where: str = "true", beside: int | None = None) -> DataFrame:
    """`code_rows` of these cells -> a row (code, pattern, side, hold, `also`) for each of them and each holding period, its candidates as `_c`.

    where: a condition on code, pattern, side and `also`, judged before any candidate is formed. beside: a further holding period, its candidates as `_d`."""
    cells, holds, also = tuple(cells), tuple(holds), tuple(also)
    labels = F.array(*[F.struct(F.lit(n).alias("pattern"), F.lit(side).alias("side")) for n, side in cells])
    breach = " ".join(f"WHEN get(_closes, i + {k + 1}) / get(_opens, i + 1) - 1 <= {STOP_LOSS}D THEN {k}" for k in range(1, max((*holds, beside or 0)) + 1))
    price = ("_dates", "_opens", "_closes")
    rows = codes.select("code", *also, *price, F.explode(F.arrays_zip(labels.alias("label"), F.col("_at").alias("at"))).alias("_cell")).selectExpr(
        "code", "_cell.label.pattern", "_cell.label.side", *also, *price, "_cell.at AS _at").filter(where)
    rows = rows.selectExpr(
        "code", "pattern", "side", *also, *price,
        f"""transform(filter(_at, i -> get(_opens, i + 1) > 0),
            i -> named_struct('i', i, 'n', size(_opens) - 1 - i, 'first', IF(side = 'buy', CASE {breach} END, NULL))) AS _s""")
    rows = rows.select("*", F.explode(F.array(*map(F.lit, holds))).alias("hold")) if len(holds) > 1 else rows.withColumn("hold", F.lit(holds[0]))
    made = {"_c": "hold"} | ({"_d": str(beside)} if beside else {})
    return rows.selectExpr("code", "pattern", "side", "hold", *also, *price, *[f"{_candidates('_s', h)} AS {name}" for name, h in made.items()])


def _candidates(starts: str, hold: str) -> str:
    """SQL of the candidates of one holding period, from bars with a signal (i, n bars after it, first bar below the stop)."""
    kind = f"CASE WHEN (x.first IS NULL OR x.first > {hold}) AND x.n >= {hold} + 1 THEN 'hold' WHEN x.first <= {hold} AND x.n >= x.first + 2 THEN 'stop' ELSE 'end' END"
    off = f"CASE x.kind WHEN 'stop' THEN x.first + 1 WHEN 'hold' THEN {hold} ELSE greatest(x.n - 1, 0) END"
    held = f"CASE x.kind WHEN 'stop' THEN x.first + 1 WHEN 'hold' THEN {hold} + 1 ELSE greatest(x.n, 0) END"
    return f"""transform(transform(transform({starts},
        x -> named_struct('i', x.i, 'n', x.n, 'first', x.first, 'kind', {kind})),
        x -> named_struct('i', x.i, 'kind', x.kind, 'out', x.i + 1 + {off}, 'held', {held})),
        x -> named_struct('entry_idx', x.i + 1, 'entry_date', get(_dates, x.i + 1), 'entry_price', get(_opens, x.i + 1), 'exit_idx', x.out, 'exit_date', get(_dates, x.out),
            'exit_price', IF(x.kind = 'end', get(_closes, x.out), get(_opens, x.out)), 'exit_reason', x.kind, 'held_bars', x.held,
            'next_free', IF(x.kind = 'end', {NEVER}, x.i + 1 + x.held), 'last_idx', size(_opens) - 1, 'closes', slice(_closes, x.i + 2, x.held)))"""


def pattern_accounts(bars: DataFrame, names: Iterable[str] | None = None, hold: int = HOLD_DAYS, cautious: bool = False,
                     cash: float = START_CASH, sides: Iterable[str] = ("buy", "sell"), also: Iterable[str] = ()) -> DataFrame:
    """The accounts of every code, pattern and side that trades, as `accounts(candidate_trades(...))` gives them. also: of `_dates`, `_opens`, `_closes` those to keep."""
    names = tuple(names or ALL_PATTERNS)
    cells = [(n, side) for n in names for side in sides]
    return folded(code_candidates(code_rows(bars, names, cells, cautious), cells, (hold,)), cash, KEYS, also, traded=True)


def pattern_trades(bars: DataFrame, names: Iterable[str] | None = None, hold: int = HOLD_DAYS, cautious: bool = False,
                   cash: float = START_CASH, sides: Iterable[str] = ("buy", "sell")) -> DataFrame:
    """Their trades, as `select_trades(candidate_trades(...))` gives them."""
    return explode_trades(pattern_accounts(bars, names, hold, cautious, cash, sides))


def account_equity(trades: str = "trades", side: str = "side") -> str:
    """The equity of an account's marks (see `marks`) in order, as an array."""
    return f"flatten(transform({trades}, (t, j) -> {_trade_equity(trades, side)}))"


def _trade_equity(trades: str, side: str) -> str:
    """The equity of the marks of trade t, the j-th of its account."""
    sign = f"IF({side} = 'buy', 1, -1)"
    held = f"transform(t.c.closes, (p, i) -> IF(t.c.exit_reason = 'end' AND i = size(t.c.closes) - 1, t.cash_out, t.cash_in + {sign} * t.size * p))"
    settles = ("t.c.exit_reason <> 'end' AND t.c.entry_idx + t.c.held_bars <= t.c.last_idx "
               f"AND coalesce(get({trades}, j + 1).c.entry_idx <> t.c.entry_idx + t.c.held_bars, true)")
    return f"IF({settles}, concat({held}, array(t.cash_out)), {held})"


def _marked(accounts_: DataFrame, keys: Iterable[str], also: Iterable[str] = ()) -> DataFrame:
    """Accounts with their marks in order as `_m`, an array of bar_idx and equity."""
    return accounts_.selectExpr(
        *keys, *also, f"flatten(transform(trades, (t, j) -> transform({_trade_equity('trades', 'side')}, "
        "(x, k) -> named_struct('bar_idx', t.c.entry_idx + k, 'equity', x)))) AS _m")


def account_marks(accounts_: DataFrame, cash: float = START_CASH, keys: Iterable[str] = KEYS) -> DataFrame:
    """`marked_returns(marks(...))` of accounts that still have their `trades` as an array: bar_idx, equity, daily_return, peak and drawdown. Nothing is sorted."""
    full = f"size(a.page) >= {PAGE}"
    peaks = f"""aggregate(_m, named_struct('peak', {cash}D, 'pages', CAST(array() AS array<array<double>>), 'page', CAST(array() AS array<double>)),
        (a, x) -> named_struct('peak', greatest(a.peak, x.equity), 'pages', IF({full}, concat(a.pages, array(a.page)), a.pages),
            'page', IF({full}, array(greatest(a.peak, x.equity)), concat(a.page, array(greatest(a.peak, x.equity))))),
        a -> flatten(concat(a.pages, array(a.page))))"""
    return _marked(accounts_, keys).selectExpr("*", f"{peaks} AS _k").selectExpr(*keys, f"""inline(transform(_m, (x, i) -> named_struct(
        'bar_idx', x.bar_idx, 'equity', x.equity, 'daily_return', x.equity / nullif(IF(i = 0, {cash}D, get(_m, i - 1).equity), 0) - 1,
        'peak', get(_k, i), 'drawdown', (get(_k, i) - x.equity) / nullif(get(_k, i), 0) * 100)))""")


def account_curve(accounts_: DataFrame, cash: float = START_CASH) -> DataFrame:
    """`equity_curve` of accounts that still have their `trades`, and the `_dates` of their code, as arrays. Nothing is joined or sorted."""
    return _marked(accounts_.filter("code IS NOT NULL"), KEYS, ("_dates",)).selectExpr(*KEYS, f"""inline(concat(
        transform(slice(_dates, 1, _m[0].bar_idx), (d, k) -> named_struct('trade_date', d, 'bar_idx', k, 'equity', {cash}D)),
        flatten(transform(_m, (x, i) -> transform(slice(_dates, x.bar_idx + 1, coalesce(get(_m, i + 1).bar_idx, size(_dates)) - x.bar_idx),
            (d, k) -> named_struct('trade_date', d, 'bar_idx', x.bar_idx + k, 'equity', x.equity))))))""")


def nested_details(trades: str = "trades") -> str:
    """`trade_details` of an account as an array of structs, its side in the column `side`."""
    made = _trade_figures("t.", "t.c.", "side", False)
    return f"""transform({trades}, (t, j) -> named_struct('trade_no', j + 1, 'entry_date', t.c.entry_date, 'entry_price', round(t.c.entry_price, 3), 'exit_date', t.c.exit_date,
        'exit_price', round(t.c.exit_price, 3), 'size', t.size, 'pnl', round({made['pnl']}, 2), 'pnl_pct', round({made['pnl_pct']}, 2), 'hold_days', {made['hold_days']},
        'hold_max_drawdown', round({made['hold_max_drawdown']}, 2), 'exit_reason', IF(t.c.exit_reason = 'stop', '{STOP_LABEL}', NULL)))"""


def _trade_figures(t: str, c: str, side: str, combined: bool) -> dict[str, str]:
    """SQL of a trade's figures; t, c: prefixes of its account columns and of its candidate's."""
    sign = f"IF({side} = 'buy', 1, -1)"
    start = f"{t}cash_before" if combined else f"{t}cash_in + {sign} * {t}size * {c}entry_price"
    value = f"{t}cash_in + {sign} * {t}size * p"
    fall = (f"aggregate({c}closes, named_struct('peak', {start}, 'dd', 0D), "
            f"(a, p) -> named_struct('peak', greatest(a.peak, {value}), "
            f"'dd', IF(greatest(a.peak, {value}) > 0, greatest(a.dd, "
            f"(greatest(a.peak, {value}) - ({value})) "
            f"/ greatest(a.peak, {value}) * 100), a.dd)), a -> a.dd)")
    return {"pnl": f"{sign} * ({c}exit_price - {c}entry_price) * {t}size",
            "pnl_pct": f"CASE WHEN {side} = 'buy' THEN {c}exit_price / {c}entry_price - 1 WHEN {c}exit_price <> 0 THEN {c}entry_price / {c}exit_price - 1 END * 100",
            "hold_days": f"{c}exit_idx - {c}entry_idx" + (f" + IF({c}exit_reason = 'end', 1, 0)" if combined else ""),
            "hold_max_drawdown": fall}


def explode_trades(accounts_: DataFrame, keys: Iterable[str] = KEYS, extra: Iterable[str] = (), combined: bool = False) -> DataFrame:
    """Trades of the accounts. combined: as the one-account form counts, the entry bar of a position that is open at the end
    is a held day, and the fall is measured from the account's value before the entry fee."""
    keys, extra = tuple(keys), tuple(extra)
    side = () if "side" in keys else ("t.c.side AS side",)
    rows = accounts_.selectExpr(*keys, "posexplode(trades) AS (_no, t)").selectExpr(
        *keys, *side, "CAST(_no + 1 AS INT) AS trade_no", *[f"t.c.{c}" for c in CANDIDATE + extra],
        "t.size", "t.cash_before", "t.cash_in", "t.cash_out")
    return rows.selectExpr("*", *[f"{made} AS {name}" for name, made in _trade_figures("", "", "side", combined).items()])


def trade_details(trades: DataFrame) -> DataFrame:
    """Presentation rounding of a trade list: prices 3 digits, money and percent 2."""
    return trades.select(
        *[c for c in ("code", "pattern", "side", "trade_no") if c in trades.columns],
        "entry_date", F.round("entry_price", 3).alias("entry_price"), "exit_date",
        F.round("exit_price", 3).alias("exit_price"), "size", F.round("pnl", 2).alias("pnl"),
        F.round("pnl_pct", 2).alias("pnl_pct"), "hold_days",
        F.round("hold_max_drawdown", 2).alias("hold_max_drawdown"),
        F.when(F.col("exit_reason") == "stop", STOP_LABEL).alias("exit_reason"))


# --- T6: equity ---------------------------------------------------------------------------------

def marks(trades: DataFrame, keys: Iterable[str] = KEYS) -> DataFrame:
    """Equity at every bar where it can move: the held bars, and the bar on which it is cash again.

    Between marks equity is constant, so returns, peaks and drawdowns need nothing else.  The row
    of a trade's first mark also carries the trade's own figures, so that one grouping of the marks
    yields all metrics of an account.
    """
    keys = tuple(keys)
    part = f"OVER (PARTITION BY {', '.join(keys)} ORDER BY trade_no)"
    sign = "IF(side = 'buy', 1, -1)"
    held = trades.selectExpr(
        "*", f"lead(entry_idx) {part} AS _next",
        f"transform(closes, (p, i) -> IF(exit_reason = 'end' AND i = size(closes) - 1, cash_out, "
        f"cash_in + {sign} * size * p)) AS _held")
    settles = ("exit_reason <> 'end' AND entry_idx + held_bars <= last_idx "
               "AND (_next IS NULL OR _next <> entry_idx + held_bars)")
    rows = held.selectExpr(
        *dict.fromkeys((*keys, "side")), "trade_no", "entry_idx", "last_idx", "pnl_pct AS _pnl_pct", "held_bars AS _held_bars",
        "hold_days AS _hold_days",
        f"posexplode(IF({settles}, concat(_held, array(cash_out)), _held)) AS (_at, equity)")
    return rows.selectExpr(
        *dict.fromkeys((*keys, "side")), "trade_no", "entry_idx + _at AS bar_idx", "last_idx", "equity",
        "IF(_at = 0, round(_pnl_pct, 2), NULL) AS pnl_pct", "IF(_at = 0, _held_bars, NULL) AS held_bars",
        "IF(_at = 0, _hold_days, NULL) AS hold_days")


def marked_returns(marks_: DataFrame, cash: float = START_CASH, keys: Iterable[str] = KEYS) -> DataFrame:
    """W8 + W9 on the marks: return against the previous equity, running peak, drawdown."""
    part = f"OVER (PARTITION BY {', '.join(keys)} ORDER BY bar_idx"
    return marks_.selectExpr(
        "*", f"equity / nullif(lag(equity, 1, {cash}D) {part}), 0) - 1 AS daily_return",
        f"greatest(max(equity) {part} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), {cash}D) AS peak",
    ).selectExpr("*", "(peak - equity) / nullif(peak, 0) * 100 AS drawdown")


def equity_curve(bars: DataFrame, trades: DataFrame, cash: float = START_CASH) -> DataFrame:
    """T6 per bar: every bar of every account that traded.

    An account is first cut into stretches of equal equity: from each mark to the bar before the next one, and from the first bar to
    the first mark.  Only marks are sorted.  A stretch meets its bars by (code, run of SPAN bars), so no account is ever held or sorted
    bar by bar, however long it lies flat, and a code with many accounts is spread over its runs."""
    own = f"OVER (PARTITION BY {', '.join(KEYS)} ORDER BY bar_idx)"
    cut = marks(trades).selectExpr(
        *KEYS, "equity", "bar_idx AS lo", f"coalesce(lead(bar_idx) {own} - 1, last_idx) AS hi", f"lag(bar_idx) {own} IS NULL AND bar_idx > 0 AS _first")
    this = "named_struct('lo', lo, 'hi', hi, 'equity', equity)"
    before = f"named_struct('lo', 0, 'hi', lo - 1, 'equity', {cash}D)"
    stretches = cut.selectExpr(*KEYS, f"explode(IF(_first, array({before}, {this}), array({this}))) AS _s").selectExpr(*KEYS, "_s.*")
    runs = stretches.selectExpr("*", f"explode(sequence(lo div {SPAN}, hi div {SPAN})) AS _run")
    index = bar_index(bars).selectExpr("code", "trade_date", "bar_idx", f"bar_idx div {SPAN} AS _run")
    return index.join(runs, ["code", "_run"]).filter("bar_idx BETWEEN lo AND hi").select(*KEYS, "trade_date", "bar_idx", "equity")


# --- T13, T14 -----------------------------------------------------------------------------------

def cut_segments(bars: DataFrame, segments: DataFrame) -> DataFrame:
    """Bars of each date segment (code, segment_id, start, end) as a series of its own.

    The pairs are found by month, so a long history never meets all segments of its code.  The
    segment travels inside `code` ("code#segment") and every bar operator runs unchanged on it.
    """
    months = segments.select("code", "segment_id", "start", "end", F.explode(F.expr(
        "sequence(trunc(start, 'MM'), trunc(end, 'MM'), interval 1 month)")).alias("_month"))
    cut = (bars.withColumn("_month", F.trunc("trade_date", "MM")).join(months, ["code", "_month"])
           .filter("trade_date BETWEEN start AND end"))
    value = [c for c in bars.columns if c not in ("code", "bar_idx")]
    return cut.select(F.concat_ws("#", "code", "segment_id").alias("code"), *value)


def split_segment(df: DataFrame) -> DataFrame:
    """Undo the "code#segment" key of `cut_segments`."""
    rest = [c for c in df.columns if c != "code"]
    return df.select(F.substring_index("code", "#", 1).alias("code"),
                     F.substring_index("code", "#", -1).alias("segment_id"), *rest)


def multi_trades(trades: DataFrame) -> DataFrame:
    """The trades of all accounts of a code as one list by entry date, with their source."""
    order = "OVER (PARTITION BY code ORDER BY entry_date, pattern, side, trade_no)"
    return trades.selectExpr("*", f"CAST(row_number() {order} AS INT) AS merged_no")


COMPARED = (("entry_date", "exit_date", "size", "hold_days", "exit_reason"), ("entry_price", "exit_price", "pnl", "pnl_pct", "hold_max_drawdown"))  # exact, with a tolerance


def compare_trades(a: DataFrame, b: DataFrame, tol: float = 1e-6) -> DataFrame:
    """Full outer comparison of two trade lists; one row per differing field."""
    keys = ["code", "pattern", "side", "trade_no"]

    def side(df: DataFrame, tag: str) -> DataFrame:
        cols = [F.col(k) for k in keys] + [F.col(c).alias(f"{tag}_{c}") for c in sum(COMPARED, ())]
        return df.select(*cols, F.lit(True).alias(f"in_{tag}"))

    return _differences(side(a, "a").join(side(b, "b"), keys, "full"), tol)


def compare_holds(bars: DataFrame, names: Iterable[str], hold: int, other: int, cash: float = START_CASH, sides: Iterable[str] = ("buy", "sell"),
                  tol: float = 1e-6) -> DataFrame:
    """`compare_trades` of the `pattern_trades` of two holding periods. Both accounts stand in one row, so no trade is joined or shuffled."""
    names = tuple(names)
    cells = [(n, side) for n in names for side in sides]
    rows = code_candidates(code_rows(bars, names, cells).filter("code IS NOT NULL"), cells, (hold,), beside=other)
    one = folded(rows, cash, KEYS, ("_d",)).withColumnsRenamed({"trades": "_a", "_d": "_c"})
    both = folded(one, cash, KEYS, ("_a",)).withColumnRenamed("trades", "_b")
    figures = _trade_figures("t.", "t.c.", "side", False) | {"size": "t.size"}
    shown = ", ".join(f"'{c}', {figures.get(c, f't.c.{c}')}" for c in sum(COMPARED, ()))
    made = both.selectExpr(*KEYS, *[f"transform(_{tag}, t -> named_struct({shown})) AS {tag}" for tag in "ab"])
    pairs = made.selectExpr(*KEYS, "posexplode(arrays_zip(a, b)) AS (_no, z)")
    return _differences(pairs.selectExpr(
        *KEYS, "CAST(_no + 1 AS INT) AS trade_no", *[f"z.{tag}.{c} AS {tag}_{c}" for tag in "ab" for c in sum(COMPARED, ())],
        *[f"IF(z.{tag} IS NULL, NULL, true) AS in_{tag}" for tag in "ab"]), tol)


def _differences(both: DataFrame, tol: float) -> DataFrame:
    """Pairs of trades (a_, b_ and in_a, in_b) -> a row per differing field."""
    exact, loose = COMPARED
    checks = [f"IF(in_a IS NULL, 'only_b', IF(in_b IS NULL, 'only_a', NULL))"]
    checks += [f"IF(in_a AND in_b AND NOT (a_{c} <=> b_{c}), '{c}', NULL)" for c in exact]
    checks += [f"IF(in_a AND in_b AND (abs(a_{c} - b_{c}) > {tol}D OR (a_{c} IS NULL) <> (b_{c} IS NULL)), '{c}', NULL)"
               for c in loose]
    return both.selectExpr(*KEYS, "trade_no", f"explode(array_compact(array({', '.join(checks)}))) AS difference")

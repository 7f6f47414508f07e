"""One account over several patterns (T9) and one account over many securities."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wickspark.functions.pick import computed_once
from wickspark.model import (CAUTIOUS, COMMISSION, DAILY_BUY_ORDER, DAILY_SELL_ORDER, HOLD_DAYS, LOT,
                             PATTERN_ALIAS, START_CASH)
from wickspark.operators import candles, refine
from wickspark.operators import trades as T
from wickspark.operators.candles import W
from wickspark.operators.selection import fill_forward_zero


def combined_trades(bars: DataFrame, buy: Iterable[str], sell: Iterable[str], hold: int = HOLD_DAYS,
                    cash: float = START_CASH, cautious: bool = False) -> DataFrame:
    """Any buy pattern beats any sell pattern of the same bar; signals while held are ignored."""
    return T.explode_trades(combined_accounts(bars, buy, sell, hold, cash, cautious), ("code",), ("trigger_patterns",), True)


def combined_accounts(bars: DataFrame, buy: Iterable[str], sell: Iterable[str], hold: int = HOLD_DAYS,
                      cash: float = START_CASH, cautious: bool = False) -> DataFrame:
    """The account of each code with its `trades` array."""
    bars = fill_forward_zero(bars)
    buy, sell = tuple(buy), tuple(sell)
    names = tuple(dict.fromkeys(buy + sell))
    guarded = [n for n in names if n in CAUTIOUS] if cautious else []
    rules = refine.entry_rules(1) if guarded else {}

    def triggered(side_names: tuple[str, ...], op: str) -> str:
        cells = []
        for n in side_names:
            hit = f"{n} {op} 0" + (f" AND coalesce({rules[n]}, false)" if n in rules else "")
            cells.append(f"CASE WHEN {hit} THEN '{n}' END")
        return f"array_compact(array({', '.join(cells)}))" if cells else "CAST(array() AS array<string>)"

    rows = candles.frame(bars, T.ahead_of([hold]))
    rows = rows.select("*", *[candles.pattern_value(n) for n in names])
    ahead = [f"_x{k}" for k in range(1, hold + 3)]
    rows = rows.selectExpr("code", "bar_idx", "last_idx", *ahead, f"{triggered(buy, '>')} AS _bs", f"{triggered(sell, '<')} AS _ss")
    rows = T.with_outcomes(rows, ("code", "_bs", "_ss"), [hold], combined=True).withColumnsRenamed({f"_buy{hold}": "_buy", f"_sell{hold}": "_sell"})
    picked = rows.selectExpr("code", "IF(size(_bs) > 0, 'buy', 'sell') AS side",
                             "IF(size(_bs) > 0, _buy, _sell) AS _t",
                             "IF(size(_bs) > 0, _bs, _ss) AS trigger_patterns",
                             "size(_bs) + size(_ss) AS _k").filter("_k > 0 AND _t IS NOT NULL")
    cands = picked.select("code", "side", "trigger_patterns", *[f"_t.{c}" for c in T.CANDIDATE])
    return T.accounts(cands, cash, ("code",), ("trigger_patterns",))


def pool_candidates(bars: DataFrame, performance: DataFrame, hold: int = HOLD_DAYS) -> DataFrame:
    """Entries a pool may take: the last-match buy pattern of a bar whose stored performance is good.

    The exit is the earlier of `hold` bars and the first sell pattern after the entry, so each
    candidate carries it; the bars in between are a bounded look-ahead."""
    names = tuple(DAILY_BUY_ORDER)
    rules = refine.signal_rules()
    sells = set(DAILY_SELL_ORDER)
    rows = candles.frame(bars).select("code", "trade_date", "bar_idx", "open", "close",
                                      *[candles.pattern_value(n) for n in names],
                                      *[F.expr(str(rules[n])).alias(f"_ok_{n}") for n in CAUTIOUS])
    buy = " ".join(f"WHEN {n} > 0{f' AND coalesce(_ok_{n}, false)' if n in CAUTIOUS else ''} THEN '{PATTERN_ALIAS.get(n, n)}'"
                   for n in reversed(names))
    sell = " OR ".join(f"{n} < 0" for n in names if n in sells)
    rows = rows.selectExpr("code", "trade_date", "bar_idx", "open", "close", f"CASE {buy} END AS pattern",
                           f"({sell}) AS _sells")
    ahead = range(1, hold + 2)
    look = rows.selectExpr("*", *[f"lead(struct(open AS o, close AS c, trade_date AS d, pattern AS p, _sells AS s), {k}) {W} AS _x{k}" for k in ahead])
    # held bar k (entry = 1): out at the next open when k = hold, or on a sell pattern with no buy pattern beside it
    out = " ".join(f"WHEN _x{k}.s AND _x{k}.p IS NULL THEN {k}" for k in range(1, hold))
    look = look.selectExpr("code", "trade_date", "close", "pattern", "_x1", f"array({', '.join(f'_x{k}' for k in ahead)}) AS _path",
                           f"CASE {out} ELSE {hold} END AS _k" if hold > 1 else "1 AS _k")
    # figures that still are the formula of an account: a filter on them would be pushed below it and form the account again for every mention
    figures = {c: F.col(c) for c in ("trades", "win_rate", "return_pct", "sharpe")}
    good = computed_once(performance.filter("side = 'buy'").select("code", "pattern", *figures), **figures).filter(
        "trades > 10 AND win_rate > 50 AND return_pct > 0 AND sharpe > 0.1")
    cands = look.filter("pattern IS NOT NULL AND _x1 IS NOT NULL AND _x1.o > 0").join(
        good.select("code", "pattern"), ["code", "pattern"], "left_semi")
    last = "try_element_at(filter(_path, z -> z IS NOT NULL), -1)"
    nxt = "element_at(_path, _k + 1)"
    decided = "element_at(_path, _k)"
    return cands.selectExpr(
        "code", "pattern", "trade_date AS signal_date", "close AS signal_close", "_x1.d AS entry_date",
        "_x1.o AS entry_price", f"coalesce({decided}.d, {last}.d) AS decision_date", f"coalesce({nxt}.d, {last}.d) AS exit_date",
        f"coalesce({nxt}.o, {last}.c) AS exit_price", f"{nxt} IS NULL AS is_open",
        "transform(filter(_path, z -> z IS NOT NULL), z -> named_struct('d', z.d, 'c', z.c)) AS path")


def pool_trades(candidates: DataFrame, max_stock: int, pool: DataFrame | None = None,
                cash: float = START_CASH) -> DataFrame:
    """Up to max_stock positions at a time; a day's candidates are taken in code order.

    A slot is worth 99 % of the account's value over max_stock and is free again on the day after
    the exit was decided.  Fewer than one lot still takes its slot, with size 0.
    pool: (code, pool) assignment; by default one pool.

    The account is one sequence by nature, so it is made short exactly: at most max_stock slots can
    open on a day and at most max_stock candidates can be held codes, hence the first 2 * max_stock
    candidates of a pool and day decide the same trades as all of them.  What remains is bounded by
    days x slots, whatever the number of securities; the cut itself is a per-day rank, spread over
    all days.
    """
    c = candidates.withColumn("pool", F.lit(0)) if pool is None else candidates.join(pool, "code")
    day = F.row_number().over(Window.partitionBy("pool", "signal_date").orderBy("code"))
    short = c.withColumn("_r", day).filter(F.col("_r") <= 2 * max_stock)
    fields = ("signal_date", "code", "pattern", "signal_close", "entry_date", "entry_price", "decision_date",
              "exit_date", "exit_price", "is_open", "path")
    lists = short.groupBy("pool").agg(F.sort_array(F.collect_list(F.struct(*fields))).alias("_c"))
    item = lists.schema["_c"].dataType.elementType.simpleString()
    held = f"struct<x:{item},size:double>"
    live = "filter(acc.held, z -> z.x.exit_date > x.signal_date)"
    settled = ("(acc.cash + aggregate(filter(acc.held, z -> z.x.exit_date <= x.signal_date), 0D, "
               f"(s, z) -> s + z.size * z.x.exit_price * {1 - COMMISSION}D))")
    seen = "try_element_at(filter(z.x.path, p -> p.d <= x.signal_date), -1).c"
    value = (f"({settled} + aggregate({live}, 0D, (s, z) -> s + z.size * IF(z.x.entry_date > x.signal_date, "
             f"z.x.entry_price * {1 + COMMISSION}D, coalesce({seen}, z.x.entry_price))))")
    lots = f"({value} * 0.99D / {max_stock} / {LOT} / nullif(x.signal_close, 0))"
    size = f"greatest(coalesce(({lots} - {lots} % 1) * {LOT}, 0D), 0D)"
    free = (f"size(filter({live}, z -> z.x.decision_date >= x.signal_date)) < {max_stock} "
            f"AND NOT exists({live}, z -> z.x.code = x.code)")
    fold = f"""aggregate(_c, named_struct('cash', {cash}D, 'held', CAST(array() AS array<{held}>),
                                          'taken', CAST(array() AS array<{held}>)),
        (acc, x) -> IF({free},
            named_struct('cash', {settled} - {size} * x.entry_price * {1 + COMMISSION}D,
                         'held', concat({live}, array(named_struct('x', x, 'size', {size}))),
                         'taken', concat(acc.taken, array(named_struct('x', x, 'size', {size})))), acc),
        acc -> acc.taken)"""
    shown = [f for f in fields if f not in ("path", "signal_close", "decision_date")]
    return lists.selectExpr("pool", f"explode({fold}) AS t").selectExpr(
        "pool", *[f"t.x.{f}" for f in shown], "t.size",
        "(t.x.exit_price / nullif(t.x.entry_price, 0) - 1) * 100 AS pnl_pct")

"""Trades, metrics and market statistics."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from checks import sql as S
from checks.registry import add
from checks.signal_queries import (_TR, RULE_SQL, UNION_BUY, UNION_BUY_OTHER, UNION_BUY_V2, UNION_SELL, UNION_SELL_OTHER, UNION_SELL_V2, UNION_SQL, _lined,
                                   _roll)
from wickspark import adapters as A
from wickspark.model import ALL_PATTERNS, BUY_CLASS, DAILY_PATTERNS, SELL_CLASS
from wickspark.operators import candles, combined as C, cycles as Z, metrics as M, rules as R, trades as T

FEW = DAILY_PATTERNS  # all patterns that the market update and the daily list work on
_BASE = (S.BARS, S.sig(FEW), S.outcomes(), S.CAND)
ACCOUNTS = (*_BASE, S.walk(), S.equity())


def few_trades(s, d):
    return T.pattern_trades(A.bars(s, d), FEW)


# --- T1-T8 --------------------------------------------------------------------------------------

_CCOLS = ("code", "pattern", "side", "signal_date", "entry_idx", "entry_date", "entry_price", "exit_idx", "exit_date",
          "exit_price", "exit_reason", "held_bars")
_CSQL = ("SELECT code, pattern, side, signal_date, CAST(e AS INTEGER) AS entry_idx, entry_date, entry_price, CAST(exit_i AS INTEGER) AS exit_idx, "
         "exit_date, exit_price, kind AS exit_reason, CAST(held AS INTEGER) AS held_bars FROM cand")
add("trade_candidates", lambda s, d: T.candidate_trades(A.bars(s, d), FEW).select(*_CCOLS), S.with_(*_BASE) + _CSQL)
add("trade_candidates_all_patterns",
    lambda s, d: T.candidate_trades(A.bars(s, d)).groupBy("pattern", "side", "exit_reason").agg(
        F.count("*").alias("n"), F.sum("held_bars").alias("held_bars"), F.max("entry_date").alias("last_entry")),
    S.with_(S.BARS, S.sig(), S.outcomes(), S.CAND) + "SELECT pattern, side, kind AS exit_reason, count(*) AS n, CAST(sum(held) AS BIGINT) AS held_bars, "
    "max(entry_date) AS last_entry FROM cand GROUP BY ALL")
add("trade_candidates_hold5", lambda s, d: T.candidate_trades(A.bars(s, d), FEW, hold=5).select(*_CCOLS),
    S.with_(S.BARS, S.sig(FEW), S.outcomes(5), S.CAND) + _CSQL)
_TCOLS = ("code", "pattern", "side", "trade_no", "entry_date", "entry_price", "exit_date", "exit_price", "hold_days", "held_bars")


def _short(df):
    return df.select(*_TCOLS, F.round("size", 0).alias("size"), F.round("pnl_pct", 4).alias("pnl_pct"))


_TSQL = """SELECT code, pattern, side, CAST(trade_no AS INTEGER) AS trade_no, entry_date, entry_price, exit_date, exit_price,
  CAST(exit_i - e AS INTEGER) AS hold_days, CAST(held AS INTEGER) AS held_bars, round(size, 0) AS size,
  round(CASE WHEN side = 'buy' THEN exit_price / entry_price - 1 ELSE entry_price / exit_price - 1 END * 100, 4) AS pnl_pct FROM trades"""
add("trade_select", lambda s, d: _short(few_trades(s, d)), S.with_(*_BASE, S.walk(), recursive=True) + _TSQL)
add("trade_short_side", lambda s, d: _short(T.select_trades(T.candidate_trades(A.bars(s, d), ["CDLHARAMI", "CDLENGULFING"], sides=("sell",)))),
    S.with_(S.BARS, S.sig(["CDLHARAMI", "CDLENGULFING"]), S.outcomes(), S.CAND, S.walk(), recursive=True) + _TSQL + " WHERE side = 'sell'")
add("trade_open_at_end", lambda s, d: few_trades(s, d).filter("exit_reason = 'end'").select(*_TCOLS),
    S.with_(*_BASE, S.walk(), recursive=True) + "SELECT code, pattern, side, CAST(trade_no AS INTEGER) AS trade_no, entry_date, entry_price, exit_date, exit_price, "
    "CAST(exit_i - e AS INTEGER) AS hold_days, CAST(held AS INTEGER) AS held_bars FROM trades WHERE kind = 'end'")
add("trade_size_and_cash",
    lambda s, d: few_trades(s, d).select("code", "pattern", "side", "trade_no", F.round("size", 0).alias("size"), F.round("pnl", 4).alias("pnl"),
                                         F.round("cash_out", 2).alias("cash_out")),
    S.with_(*_BASE, S.walk(), recursive=True) + "SELECT code, pattern, side, CAST(trade_no AS INTEGER) AS trade_no, round(size, 0) AS size, "
    "round(CASE WHEN side = 'buy' THEN 1 ELSE -1 END * (exit_price - entry_price) * size, 4) AS pnl, round(cash_out, 2) AS cash_out FROM trades")
_CAUT = ("CDLMARUBOZU", "CDLINVERTEDHAMMER", "CDLSEPARATINGLINES", "CDLTASUKIGAP")
_LAGS_OF = "lags AS (SELECT code, i, {c} FROM num)".format(c=", ".join(
    f"lag({f}, {k}) OVER ({S.W}) AS {f[0]}{k}" if k else f"{f} AS {f[0]}0" for k in range(4) for f in ("open", "high", "low", "close")))
add("trade_cautious", lambda s, d: _short(T.select_trades(T.candidate_trades(A.bars(s, d), _CAUT, cautious=True))),
    S.with_(S.BARS, S.sig(_CAUT), S.outcomes(), _LAGS_OF,
            """cand AS (SELECT g.code, g.pattern, CASE WHEN g.value > 0 THEN 'buy' ELSE 'sell' END AS side, g.trade_date AS signal_date, r.* EXCLUDE (code, side)
            FROM sig g JOIN res r ON r.code = g.code AND r.e = g.i + 1 AND r.side = CASE WHEN g.value > 0 THEN 'buy' ELSE 'sell' END
            JOIN lags b ON b.code = g.code AND b.i = g.i + 1 WHERE b.i >= 3 AND CASE g.pattern WHEN 'CDLMARUBOZU' THEN c1 / o1 < 1.015 AND c2 / o2 < 1.015
            WHEN 'CDLINVERTEDHAMMER' THEN CASE WHEN c0 > o0 THEN o0 ELSE c0 END / l0 < 1.003 WHEN 'CDLSEPARATINGLINES' THEN c2 > c3 AND c0 > o0
            ELSE o1 > h2 AND l1 > h2 END)""", S.walk(), recursive=True) + _TSQL)
add("trade_from_signal_table",
    lambda s, d: _short(T.select_trades(T.candidates_of(A.bars(s, d), candles.signals(A.bars(s, d), ["CDLDOJI"])))),
    S.with_(S.BARS, S.sig(["CDLDOJI"]), S.outcomes(), S.CAND, S.walk(), recursive=True) + _TSQL)
add("trade_equity_marks",
    lambda s, d: T.account_marks(T.pattern_accounts(A.bars(s, d), FEW)).select("code", "pattern", "side", "bar_idx", F.round("equity", 4).alias("equity"),
                                                                    F.round("daily_return", 8).alias("daily_return"), F.round("drawdown", 6).alias("drawdown")),
    S.with_(*ACCOUNTS, recursive=True) + "SELECT code, pattern, side, CAST(i AS INTEGER) AS bar_idx, round(equity, 4) AS equity, round(ret, 8) AS daily_return, "
    "round((peak - equity) / peak * 100, 6) AS drawdown FROM moves")
add("trade_equity_curve",
    lambda s, d: T.account_curve(T.pattern_accounts(A.bars(s, d), ["CDLENGULFING"], also=["_dates"])).select(
        "code", "pattern", "side", "trade_date", F.round("equity", 2).alias("equity")),
    S.with_(S.BARS, S.sig(["CDLENGULFING"]), S.outcomes(), S.CAND, S.walk(), S.equity(),
            "g AS (SELECT DISTINCT code, pattern, side FROM trades)", recursive=True)
    + "SELECT code, pattern, side, n.trade_date, round(coalesce(last_value(m.equity IGNORE NULLS) OVER (PARTITION BY code, pattern, side ORDER BY n.i), 1e8::DOUBLE), 2) AS equity "
      "FROM g JOIN num n USING (code) LEFT JOIN marks m USING (code, pattern, side, i)")
add("trade_equity_market",
    lambda s, d: T.account_curve(T.pattern_accounts(A.bars(s, d), FEW, also=["_dates"])).groupBy("pattern", "side", "trade_date").agg(
        F.count("*").alias("accounts"), F.sum(F.round("equity", 0).cast("decimal(20,0)")).cast("double").alias("equity")),
    S.with_(*ACCOUNTS, "g AS (SELECT DISTINCT code, pattern, side FROM trades)", """per AS (SELECT pattern, side, n.trade_date,
      CAST(round(coalesce(last_value(m.equity IGNORE NULLS) OVER (PARTITION BY code, pattern, side ORDER BY n.i), 1e8::DOUBLE), 0) AS DECIMAL(20, 0)) AS equity
      FROM g JOIN num n USING (code) LEFT JOIN marks m USING (code, pattern, side, i))""", recursive=True)
    + "SELECT pattern, side, trade_date, count(*) AS accounts, CAST(sum(equity) AS DOUBLE) AS equity FROM per GROUP BY ALL")
add("trade_drawdown", lambda s, d: few_trades(s, d).select("code", "pattern", "side", "trade_no", F.round("hold_max_drawdown", 4).alias("hold_max_drawdown")),
    S.with_(*ACCOUNTS, """run AS (SELECT code, pattern, side, trade_no, at_close, greatest(CASE WHEN side = 'buy' THEN cash_in + size * entry_price ELSE cash_in - size * entry_price END,
        max(at_close) OVER (PARTITION BY code, pattern, side, trade_no ORDER BY i)) AS peak FROM held_bars)""", recursive=True)
    + "SELECT code, pattern, side, CAST(trade_no AS INTEGER) AS trade_no, round(greatest(0, max(CASE WHEN peak > 0 THEN (peak - at_close) / peak * 100 ELSE 0 END)), 4) AS hold_max_drawdown FROM run GROUP BY ALL")
add("trade_held_bars", lambda s, d: few_trades(s, d).groupBy("code", "pattern", "side").agg(F.sum("held_bars").alias("held_bars")),
    S.with_(*_BASE, S.walk(), recursive=True) + "SELECT code, pattern, side, CAST(sum(held) AS BIGINT) AS held_bars FROM trades GROUP BY ALL")

# --- T9-T14 -------------------------------------------------------------------------------------

_BUYS, _SELLS = ("CDLENGULFING", "CDLHARAMI", "CDLDOJI"), ("CDLENGULFING", "CDLDARKCLOUDCOVER", "CDLHANGINGMAN")
_COMB = (S.BARS, S.sig(tuple(dict.fromkeys(_BUYS + _SELLS))), S.outcomes(2, combined=True),
         f"""trig AS (SELECT code, i, string_agg(pattern, ',' ORDER BY list_position({list(_BUYS)}, pattern)) FILTER (value > 0 AND pattern IN {_BUYS}) AS b,
         string_agg(pattern, ',' ORDER BY list_position({list(_SELLS)}, pattern)) FILTER (value < 0 AND pattern IN {_SELLS}) AS s FROM sig GROUP BY code, i)""",
         """cand AS (SELECT t.code, coalesce(t.b, t.s) AS trig, r.* EXCLUDE (code) FROM trig t JOIN res r ON r.code = t.code AND r.e = t.i + 1
         AND r.side = CASE WHEN t.b IS NOT NULL THEN 'buy' ELSE 'sell' END WHERE coalesce(t.b, t.s) IS NOT NULL)""",
         S.walk(("code",), extra=", trig"))
add("trade_combined",
    lambda s, d: C.combined_trades(A.bars(s, d), _BUYS, _SELLS).select(
        "code", "trade_no", "side", "entry_date", "entry_price", "exit_date", "exit_price", F.concat_ws(",", "trigger_patterns").alias("trigger_patterns"),
        F.round("cash_out", 2).alias("cash_out"), "hold_days", F.round("hold_max_drawdown", 4).alias("hold_max_drawdown")),
    S.with_(*_COMB, """paid AS (SELECT *, lag(cash_out, 1, 1e8::DOUBLE) OVER (PARTITION BY code ORDER BY trade_no) AS cash_before FROM trades)""",
            """held AS (SELECT t.code, t.trade_no, t.cash_before, n.i, t.cash_in + CASE WHEN t.side = 'buy' THEN 1 ELSE -1 END * t.size * n.close AS v
              FROM paid t JOIN num n ON n.code = t.code AND n.i BETWEEN t.e AND t.e + t.held - 1)""",
            "tops AS (SELECT *, greatest(cash_before, max(v) OVER (PARTITION BY code, trade_no ORDER BY i)) AS pk FROM held)",
            "falls AS (SELECT code, trade_no, round(greatest(0, max((pk - v) / pk * 100)), 4) AS dd FROM tops GROUP BY ALL)", recursive=True) + "SELECT code, CAST(trade_no AS INTEGER) AS trade_no, side, entry_date, entry_price, exit_date, exit_price, trig AS trigger_patterns, round(cash_out, 2) AS cash_out, "
    "CAST(exit_i - e + CASE WHEN kind = 'end' THEN 1 ELSE 0 END AS INTEGER) AS hold_days, dd AS hold_max_drawdown FROM trades JOIN falls USING (code, trade_no)")
add("trade_combined_account",
    lambda s, d: M.account_metrics(C.combined_trades(A.bars(s, d), _BUYS, _SELLS), keys=("code",)).select(
        "code", "trades", "win_rate", "return_pct", "sharpe", "max_drawdown"),
    S.with_(*_COMB, S.equity(("code",)), recursive=True) + "SELECT code, trades, win_rate, return_pct, sharpe, max_drawdown FROM acct")
add("trade_multi", lambda s, d: T.multi_trades(few_trades(s, d)).select("code", "merged_no", "pattern", "side", "entry_date", F.round("pnl_pct", 2).alias("pnl_pct")),
    S.with_(*_BASE, S.walk(), recursive=True) + "SELECT code, CAST(row_number() OVER (PARTITION BY code ORDER BY entry_date, pattern, side, trade_no) AS INTEGER) AS merged_no, pattern, side, entry_date, "
    "round(CASE WHEN side = 'buy' THEN exit_price / entry_price - 1 ELSE entry_price / exit_price - 1 END * 100, 2) AS pnl_pct FROM trades")


def year_segments(s, d):
    """Two-year segments of every code, the fourth overlapping the third."""
    starts = F.array(*[F.struct(F.lit(f"{y}-01-01").cast("date").alias("start"), F.lit(f"{y + 1}-12-31").cast("date").alias("end"),
                                F.lit(str(y)).alias("segment_id"), F.lit(t).alias("type"))
                       for y, t in ((1995, "up"), (1997, "down"), (1999, "flat"), (2000, "up"))])
    return A.universe(s, d).select("code", F.explode(starts).alias("g")).select("code", "g.*")


_SEG = """segs(segment_id, a, z, type) AS (VALUES ('1995', DATE '1995-01-01', DATE '1996-12-31', 'up'), ('1997', DATE '1997-01-01', DATE '1998-12-31', 'down'),
  ('1999', DATE '1999-01-01', DATE '2000-12-31', 'flat'), ('2000', DATE '2000-01-01', DATE '2001-12-31', 'up')),
cut AS (SELECT b.code || '#' || segment_id AS code, b.trade_date, b.open, b.high, b.low, b.close, b.vol FROM bars b JOIN segs ON b.trade_date BETWEEN a AND z)"""
_SEGT = (S.BARS, _SEG, S.sig(["CDLENGULFING", "CDLHARAMI"], src="cut"), S.outcomes(2, src="cut"), S.CAND, S.walk())


def segment_trades(s, d):
    cut = T.cut_segments(A.bars(s, d), year_segments(s, d))
    return T.select_trades(T.candidate_trades(cut, ["CDLENGULFING", "CDLHARAMI"]))


add("trade_segments", lambda s, d: T.split_segment(_short(segment_trades(s, d))),
    S.with_(*_SEGT, recursive=True) + _TSQL.replace("SELECT code,", "SELECT split_part(code, '#', 1) AS code, split_part(code, '#', 2) AS segment_id,"))


def _segment_results(s, d):
    res = M.account_metrics(segment_trades(s, d)).groupBy("code").agg(
        F.round(F.sum("return_pct"), 2).alias("return_pct"), F.sum("trades").alias("trades"), F.sum("won").alias("won"))
    return T.split_segment(res).join(year_segments(s, d).select("code", "segment_id", "type"), ["code", "segment_id"])


_SRES = """per AS (SELECT code, round(sum(return_pct), 2) AS return_pct, sum(trades) AS trades, sum(won) AS won FROM acct GROUP BY code),
sr AS (SELECT split_part(p.code, '#', 1) AS code, split_part(p.code, '#', 2) AS segment_id, p.return_pct, p.trades, p.won, g.type FROM per p JOIN segs g ON g.segment_id = split_part(p.code, '#', 2))"""
add("metric_segment_summary", lambda s, d: M.segment_summary(_segment_results(s, d)),
    S.with_(*_SEGT, S.equity(), _SRES, recursive=True) + """SELECT code, coalesce(type, 'all') AS type, count(*) AS segments, count(*) FILTER (return_pct > 0) AS positive,
    round(sum(return_pct), 2) AS total_return, CAST(round(CAST(round(sum(return_pct), 2) / count(*) AS DECIMAL(18, 6)), 2) AS DOUBLE) AS avg_return, CAST(sum(trades) AS BIGINT) AS trades,
    coalesce(round_even(sum(won) / nullif(sum(trades), 0) * 100, 0), 0) AS win_rate, first(segment_id ORDER BY return_pct DESC, segment_id DESC) AS best_segment,
    first(segment_id ORDER BY return_pct, segment_id) AS worst_segment FROM sr GROUP BY GROUPING SETS ((code, type), (code))""")


def _renamed(text: str, tag: str) -> str:
    """The same CTEs under other names."""
    for c in ("num", "stops", "both_sides", "kinds", "res", "cand", "nexts", "firsts", "trades"):
        text = re.sub(rf"\b{c}\b", f"{c}{tag}", text)
    return text


def _full(tag: str) -> str:
    """Trades of one list with all compared fields, the fall from the peak included."""
    return f"""hb{tag} AS (SELECT t.code, t.pattern, t.side, t.trade_no, n.i, CASE WHEN t.side = 'buy' THEN 1 ELSE -1 END AS sg, t.cash_in, t.size, t.entry_price, n.close
      FROM trades{tag} t JOIN num{tag} n ON n.code = t.code AND n.i BETWEEN t.e AND t.e + t.held - 1),
    eq{tag} AS (SELECT *, cash_in + sg * size * close AS v, greatest(cash_in + sg * size * entry_price, max(cash_in + sg * size * close) OVER (PARTITION BY code, pattern, side, trade_no ORDER BY i)) AS pk FROM hb{tag}),
    dd{tag} AS (SELECT code, pattern, side, trade_no, greatest(0, max((pk - v) / pk * 100)) AS dd FROM eq{tag} GROUP BY ALL),
    f{tag} AS (SELECT code, pattern, side, trade_no, entry_date, exit_date, size, exit_i - e AS hold_days, kind, entry_price, exit_price, dd,
      CASE WHEN side = 'buy' THEN 1 ELSE -1 END * (exit_price - entry_price) * size AS pnl,
      CASE WHEN side = 'buy' THEN exit_price / entry_price - 1 ELSE entry_price / exit_price - 1 END * 100 AS pct
      FROM trades{tag} JOIN dd{tag} USING (code, pattern, side, trade_no))"""


add("trade_compare",
    lambda s, d: T.compare_holds(A.bars(s, d), FEW, 2, 3)
    .groupBy("pattern", "side", "difference").agg(F.count("*").alias("n")),
    S.with_(S.BARS, S.sig(FEW), _renamed(",\n".join([S.outcomes(2), S.CAND, S.walk()]), "_a"), _renamed(",\n".join([S.outcomes(3), S.CAND, S.walk()]), "_b"),
            _full("_a"), _full("_b"), """j AS (SELECT coalesce(a.pattern, b.pattern) AS pattern, coalesce(a.side, b.side) AS side, unnest([
      CASE WHEN a.code IS NULL THEN 'only_b' WHEN b.code IS NULL THEN 'only_a' END,
      CASE WHEN a.entry_date <> b.entry_date THEN 'entry_date' END, CASE WHEN a.exit_date <> b.exit_date THEN 'exit_date' END,
      CASE WHEN a.size <> b.size THEN 'size' END, CASE WHEN a.hold_days <> b.hold_days THEN 'hold_days' END, CASE WHEN a.kind <> b.kind THEN 'exit_reason' END,
      CASE WHEN abs(a.entry_price - b.entry_price) > 1e-6 THEN 'entry_price' END, CASE WHEN abs(a.exit_price - b.exit_price) > 1e-6 THEN 'exit_price' END,
      CASE WHEN abs(a.pnl - b.pnl) > 1e-6 THEN 'pnl' END, CASE WHEN abs(a.pct - b.pct) > 1e-6 THEN 'pnl_pct' END,
      CASE WHEN abs(a.dd - b.dd) > 1e-6 THEN 'hold_max_drawdown' END]) AS difference
      FROM f_a a FULL JOIN f_b b ON a.code = b.code AND a.pattern = b.pattern AND a.side = b.side AND a.trade_no = b.trade_no)""", recursive=True)
    + "SELECT pattern, side, difference, count(*) AS n FROM j WHERE difference IS NOT NULL GROUP BY ALL")

# --- T10: full-position accounts ------------------------------------------------------------------


def _flag_sql(flag_ctes, margin="1.001"):
    """Walk an account through its flagged bars one by one."""
    return S.with_(S.BARS, *flag_ctes,
                   f"seen AS (SELECT code, trade_date, close, buy, sell, lead(open) OVER ({S.W}) AS no, lead(trade_date) OVER ({S.W}) AS nd FROM flags)",
                   "ev AS (SELECT *, row_number() OVER (PARTITION BY code ORDER BY trade_date) AS n FROM seen WHERE (buy OR sell) AND nd IS NOT NULL)",
                   f"st AS (SELECT code, 0::BIGINT AS n, 1e8::DOUBLE AS cash, 0::DOUBLE AS size, 0::DOUBLE AS price, NULL::DATE AS since, NULL::DATE AS out_date, NULL::DOUBLE AS out_price, "
                   "NULL::DATE AS in_date, NULL::DOUBLE AS in_price, NULL::DOUBLE AS sold FROM ev WHERE n = 1 UNION ALL "
                   f"SELECT s.code, e.n, CASE WHEN s.size = 0 AND e.buy AND q.lot > 0 AND q.lot * e.no * (1 + 0.0001::DOUBLE) <= s.cash THEN s.cash - q.lot * e.no * (1 + 0.0001::DOUBLE) "
                   "WHEN s.size > 0 AND e.sell THEN s.cash + s.size * e.no * (1 - 0.0001::DOUBLE) ELSE s.cash END, "
                   "CASE WHEN s.size = 0 AND e.buy AND q.lot > 0 AND q.lot * e.no * (1 + 0.0001::DOUBLE) <= s.cash THEN q.lot WHEN s.size > 0 AND e.sell THEN 0 ELSE s.size END, "
                   "CASE WHEN s.size = 0 THEN e.no ELSE s.price END, CASE WHEN s.size = 0 THEN e.nd ELSE s.since END, "
                   "CASE WHEN s.size > 0 AND e.sell THEN e.nd END, CASE WHEN s.size > 0 AND e.sell THEN e.no END, s.since, s.price, s.size "
                   "FROM st s JOIN ev e ON e.code = s.code AND e.n = s.n + 1, "
                   f"LATERAL (SELECT floor(floor(s.cash / (e.close * {margin})) / 100) * 100 AS lot) q)", recursive=True)


_FT = ("code", "entry_date", "entry_price", "exit_date", "exit_price", "size")
_FSQL = "SELECT code, in_date AS entry_date, in_price AS entry_price, out_date AS exit_date, out_price AS exit_price, sold AS size FROM st WHERE out_date IS NOT NULL"
for _rule, _m in (("breakout", 1.001), ("single_ma", 1.001), ("double_ma", 1.005), ("near_window", 1.001)):
    add(f"trade_flags_{_rule}",
        lambda s, d, r=_rule, m=_m: R.flag_trades(R.RULES[r](A.bars(s, d)), margin=m).filter("NOT is_open").select(*_FT),
        _flag_sql(RULE_SQL[_rule], str(_m)) + _FSQL)


def _turtle_sql(signal_ctes, lot: str) -> str:
    """Walk every bar of a code with the account's state; one row per bar."""
    buy = ("s.size = 0 AND e.b IS NOT NULL AND (e.b <> 'turtle' OR s.n = 0 OR coalesce(e.close > s.price + 0.5 * e.atr AND s.n <= 4, false)) "
           "AND q.lot > 0 AND q.lot * e.no * (1 + 0.0001::DOUBLE) <= s.cash")
    stop = "(coalesce(e.s = 'turtle', false) OR coalesce(e.close < s.price - 2 * e.atr, false)) AND s.n > 0"
    sell = f"s.size > 0 AND (({stop}) OR coalesce(e.s <> 'turtle', false))"
    return S.with_(
        S.BARS, _TR, *signal_ctes,
        f"""ev AS (SELECT g.code, g.trade_date, g.close, a.atr, g.b, g.s, lead(g.open) OVER w AS no, lead(g.trade_date) OVER w AS nd, row_number() OVER w AS k
          FROM sgn g JOIN atr a USING (code, trade_date) WINDOW w AS (PARTITION BY g.code ORDER BY g.trade_date)),
        st AS (SELECT DISTINCT code, 0::BIGINT AS k, 1e8::DOUBLE AS cash, 0::DOUBLE AS size, 0::DOUBLE AS price, 0 AS n, NULL::DATE AS since, NULL::VARCHAR AS sig,
            NULL::DATE AS in_date, NULL::DOUBLE AS in_price, NULL::DATE AS out_date, NULL::DOUBLE AS out_price, NULL::DOUBLE AS sold, NULL::VARCHAR AS bought_by, NULL::VARCHAR AS sold_by FROM ev
          UNION ALL SELECT s.code, e.k,
            CASE WHEN {buy} THEN s.cash - q.lot * e.no * (1 + 0.0001::DOUBLE) WHEN {sell} THEN s.cash + s.size * e.no * (1 - 0.0001::DOUBLE) ELSE s.cash END,
            CASE WHEN {buy} THEN q.lot WHEN {sell} THEN 0 ELSE s.size END, CASE WHEN {buy} THEN e.no ELSE s.price END,
            CASE WHEN {buy} THEN s.n + CASE WHEN e.b = 'turtle' THEN 1 ELSE 0 END WHEN s.size > 0 AND ({stop}) THEN 0 ELSE s.n END,
            CASE WHEN {buy} THEN e.nd ELSE s.since END, CASE WHEN {buy} THEN e.b ELSE s.sig END,
            s.since, s.price, CASE WHEN {sell} THEN e.nd END, CASE WHEN {sell} THEN e.no END, s.size, s.sig, CASE WHEN {stop} THEN 'turtle' ELSE e.s END
          FROM st s JOIN ev e ON e.code = s.code AND e.k = s.k + 1 AND e.nd IS NOT NULL,
          LATERAL (SELECT coalesce(CASE WHEN e.b = 'turtle' THEN {lot} ELSE floor(s.cash / (e.close * 1.001) / 100) * 100 END, 0) AS lot) q)""", recursive=True) \
        + "SELECT code, in_date AS entry_date, in_price AS entry_price, out_date AS exit_date, out_price AS exit_price, sold AS size, bought_by AS signal, sold_by AS exit_signal FROM st WHERE out_date IS NOT NULL"


_PER_ATR = "floor(s.cash * 0.01 / e.atr / 100) * 100"
_AT = ("code", "entry_date", "entry_price", "exit_date", "exit_price", "size", "signal", "exit_signal")
add("trade_turtle_account", lambda s, d: R.turtle_trades(R.turtle(A.bars(s, d))).select(*_AT),
    _turtle_sql([*RULE_SQL["turtle"], "sgn AS (SELECT code, trade_date, open, close, CASE WHEN buy THEN 'turtle' END AS b, CASE WHEN sell THEN 'turtle' END AS s FROM flags)"], _PER_ATR))
add("trade_indicator_union_account", lambda s, d: R.turtle_trades(R.indicator_union(A.bars(s, d))).select(*_AT),
    _turtle_sql([*UNION_SQL, f"sgn AS (SELECT code, trade_date, open, close, {UNION_BUY} AS b, {UNION_SELL} AS s FROM q)"], _PER_ATR))
def _stacked_sql(signal_ctes) -> str:
    """Walk every bar of a code: buys stack while a lot can be paid, sales only where none can."""
    fill = "q.lot > 0 AND coalesce(r.lot > 0 AND r.lot * e.no * (1 + 0.0001::DOUBLE) <= s.cash, false)"
    stop = "coalesce((coalesce(e.s = 'turtle', false) OR e.close < s.price - 2 * e.atr) AND s.n > 0, false)"
    sell = f"q.lot = 0 AND s.size > 0 AND ({stop} OR e.so IS NOT NULL)"
    return S.with_(
        S.BARS, _TR, *signal_ctes,
        f"""ev AS (SELECT g.code, g.close, a.atr, g.b, g.bo, g.s, g.so, lead(g.open) OVER w AS no, lead(g.trade_date) OVER w AS nd, row_number() OVER w AS k
          FROM sgn g JOIN atr a USING (code, trade_date) WINDOW w AS (PARTITION BY g.code ORDER BY g.trade_date)),
        st AS (SELECT DISTINCT code, 0::BIGINT AS k, 1e8::DOUBLE AS cash, 0::DOUBLE AS size, 0::DOUBLE AS spent, 0::DOUBLE AS price, 0 AS n, 0 AS m, NULL::DATE AS since, NULL::VARCHAR AS sig,
            NULL::DATE AS in_date, NULL::DOUBLE AS in_price, NULL::DATE AS out_date, NULL::DOUBLE AS out_price, NULL::DOUBLE AS sold, NULL::INT AS entries, NULL::VARCHAR AS bought_by, NULL::VARCHAR AS sold_by FROM ev
          UNION ALL SELECT s.code, e.k,
            CASE WHEN {fill} THEN s.cash - r.lot * e.no * (1 + 0.0001::DOUBLE) WHEN {sell} THEN s.cash + s.size * e.no * (1 - 0.0001::DOUBLE) ELSE s.cash END,
            CASE WHEN {fill} THEN s.size + r.lot WHEN {sell} THEN 0 ELSE s.size END, CASE WHEN {fill} THEN s.spent + r.lot * e.no WHEN {sell} THEN 0 ELSE s.spent END,
            CASE WHEN {fill} THEN e.no ELSE s.price END,
            CASE WHEN q.lot > 0 THEN s.n + CASE WHEN coalesce(q.b = 'turtle', false) AND (s.n = 0 OR r.lot > 0) THEN 1 ELSE 0 END WHEN {sell} AND {stop} THEN 0 ELSE s.n END,
            CASE WHEN {fill} THEN s.m + 1 WHEN {sell} THEN 0 ELSE s.m END,
            CASE WHEN {fill} THEN coalesce(s.since, e.nd) WHEN {sell} THEN NULL ELSE s.since END, CASE WHEN {fill} THEN coalesce(s.sig, q.b) WHEN {sell} THEN NULL ELSE s.sig END,
            s.since, s.spent / nullif(s.size, 0), CASE WHEN {sell} THEN e.nd END, CASE WHEN {sell} THEN e.no END, s.size, s.m, s.sig, CASE WHEN {stop} THEN 'turtle' ELSE e.so END
          FROM st s JOIN ev e ON e.code = s.code AND e.k = s.k + 1 AND e.nd IS NOT NULL,
          LATERAL (SELECT coalesce(floor(s.cash / (e.close * 1.001) / 100) * 100, 0) AS lot, CASE WHEN e.b = 'turtle' AND s.n > 4 THEN e.bo ELSE e.b END AS b) q,
          LATERAL (SELECT CASE WHEN q.b IS NULL THEN 0 WHEN q.b <> 'turtle' THEN q.lot WHEN s.n = 0 OR e.close > s.price + 0.5 * e.atr
            THEN coalesce(floor(s.cash / 3 / (e.close * 1.001) / 100) * 100, 0) ELSE 0 END AS lot) r)""", recursive=True) \
        + ("SELECT code, in_date AS entry_date, in_price AS entry_price, out_date AS exit_date, out_price AS exit_price, sold AS size, entries, bought_by AS signal, sold_by AS exit_signal "
           "FROM st WHERE out_date IS NOT NULL")


add("trade_indicator_union_v2_account", lambda s, d: R.stacked_trades(R.indicator_union_v2(A.bars(s, d))).select(*_AT, "entries"),
    _stacked_sql([*UNION_SQL, f"sgn AS (SELECT code, trade_date, open, close, {UNION_BUY_V2} AS b, {UNION_SELL_V2} AS s, {UNION_BUY_OTHER} AS bo, {UNION_SELL_OTHER} AS so FROM q)"]))


def pool_performance(s, d):
    """Stored figures for the pool: short-line and doji accounts judged mildly enough to pass some."""
    return M.scan_patterns(A.bars(s, d), buy=FEW, sell=())


add("trade_pool", lambda s, d: C.pool_trades(C.pool_candidates(A.bars(s, d), pool_performance(s, d)), max_stock=5))

# --- M1-M23 -------------------------------------------------------------------------------------

_ACOLS = ("code", "pattern", "side", "trades", "won", "win_rate", "return_pct", "sharpe", "max_drawdown")
add("metric_account", lambda s, d: M.account_figures(T.pattern_accounts(A.bars(s, d), FEW)).select(*_ACOLS),
    S.with_(*ACCOUNTS, recursive=True) + "SELECT code, pattern, side, trades, won, win_rate, return_pct, sharpe, max_drawdown FROM acct")


def _grid(buy, sell):
    rows = [f"('{n}', 'buy')" for n in buy] + [f"('{n}', 'sell')" for n in sell]
    return f"tasks(pattern, side) AS (VALUES {', '.join(rows)}), span AS (SELECT code, count(*) AS bars, min(trade_date) AS a, max(trade_date) AS z FROM bars GROUP BY code)"


_YEARS = "greatest((z - a) / 365.0::DOUBLE, 0.01)"


def scan_sql(buy, sell, names, pre=(), src="bars"):
    cand = S.CAND[:-1] + " WHERE r.entry_price > 0)"
    return S.with_(S.BARS, *pre, S.sig(names, src=src), S.outcomes(src=src), cand, S.walk(), S.equity(), _grid(buy, sell),
                   f"""scan AS (SELECT p.code, t.pattern, t.side, coalesce(trades, 0) AS trades, coalesce(win_rate, 0) AS win_rate, coalesce(return_pct, 0) AS return_pct,
    {S.annual('coalesce(return_pct, 0)', _YEARS)} AS annualized, round(coalesce(held_bars, 0) / bars * 100, 2) AS capital_occupation,
    coalesce(sharpe, 0) AS sharpe, coalesce(max_drawdown, 0) AS max_drawdown
    FROM span p CROSS JOIN tasks t LEFT JOIN acct c ON c.code = p.code AND c.pattern = t.pattern AND c.side = t.side)""", recursive=True)


_SCAN_FEW = scan_sql(FEW, FEW, FEW)


def few_scan(s, d):
    return M.scan_patterns(A.bars(s, d), buy=FEW, sell=FEW)


add("metric_scan_patterns", lambda s, d: M.scan_patterns(A.bars(s, d)), scan_sql(BUY_CLASS, SELL_CLASS, ALL_PATTERNS) + "SELECT * FROM scan")


def holes(s, d):
    """Bars with missing prices: no price in weeks of little volume."""
    return A.bars(s, d).select("code", "trade_date", *[F.when(F.col("vol") >= lim, F.col(c)).alias(c) for c, lim in (("open", 10), ("high", 20), ("low", 30), ("close", 40))], "vol")


HOLES = "holes AS (SELECT code, trade_date, CASE WHEN vol >= 10 THEN open END AS open, CASE WHEN vol >= 20 THEN high END AS high, CASE WHEN vol >= 30 THEN low END AS low, CASE WHEN vol >= 40 THEN close END AS close, vol FROM bars)"
_FILLED = "filled AS (SELECT code, trade_date, " + ", ".join(f"coalesce(last_value({c} IGNORE NULLS) OVER ({S.W} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0) AS {c}" for c in ("open", "high", "low", "close", "vol")) + " FROM holes)"
add("metric_scan_patterns_gaps", lambda s, d: M.scan_patterns(holes(s, d)), scan_sql(BUY_CLASS, SELL_CLASS, ALL_PATTERNS, (HOLES, _FILLED), "filled") + "SELECT * FROM scan")


def _zeros(s, d):
    """Bars whose prices are 0 in weeks of little volume."""
    return A.bars(s, d).select("code", "trade_date", *[F.when(F.col("vol") >= 30, F.col(c)).otherwise(0.0).alias(c) for c in ("open", "high", "low", "close")], "vol")


_ZEROS = "zeros AS (SELECT code, trade_date, " + ", ".join(f"CASE WHEN vol >= 30 THEN {c} ELSE 0 END AS {c}" for c in ("open", "high", "low", "close")) + ", vol FROM bars)"
add("trade_zero_exit",
    lambda s, d: T.select_trades(T.candidate_trades(_zeros(s, d))).filter("trade_no = 1").select("code", "pattern", "side", "entry_date", "exit_date", "exit_price", F.round("pnl_pct", 4).alias("pnl_pct")),
    S.with_(S.BARS, _ZEROS, S.sig(src="zeros"), S.outcomes(src="zeros"), S.CAND[:-1] + " WHERE r.entry_price > 0)")
    + "SELECT code, pattern, side, entry_date, exit_date, exit_price, round(CASE WHEN side = 'buy' THEN exit_price / entry_price - 1 WHEN exit_price <> 0 THEN entry_price / exit_price - 1 END * 100, 4) AS pnl_pct "
      "FROM cand QUALIFY row_number() OVER (PARTITION BY code, pattern, side ORDER BY e) = 1")
add("metric_pattern_result",
    lambda s, d: M.pattern_result(M.scan_patterns(A.bars(s, d), buy=FEW, sell=FEW, details=True)).select(
        "code", "pattern", "side", "pattern_cn", "trades", F.coalesce(F.size("trade_details"), F.lit(0)).alias("details"),
        F.round(F.aggregate("trade_details", F.lit(0.0), lambda a, t: a + t["pnl_pct"]), 2).alias("detail_return")).withColumn(
        "details", F.greatest("details", F.lit(0))),
    _SCAN_FEW + f"SELECT code, pattern, side, {S.cn()} AS pattern_cn, trades, CAST(trades AS INTEGER) AS details, CASE WHEN trades > 0 THEN return_pct END AS detail_return FROM scan")
add("metric_performance_table", lambda s, d: M.performance_table(few_scan(s, d)),
    _SCAN_FEW + "SELECT code, side || '_' || pattern AS strategy, side, pattern, trades, win_rate, return_pct, sharpe, max_drawdown FROM scan")
add("metric_candidate_cases", lambda s, d: M.candidate_cases(few_scan(s, d), 5), _SCAN_FEW + "SELECT code, pattern, side, trades FROM scan WHERE trades >= 5")
_ENDS = "ends AS (SELECT code, first(open ORDER BY trade_date) AS o, first(close ORDER BY trade_date) AS c0, last(close ORDER BY trade_date) AS c, min(trade_date) AS a, max(trade_date) AS z, count(*) AS n FROM bars GROUP BY code)"
add("metric_buy_hold", lambda s, d: M.buy_hold(A.bars(s, d)),
    S.with_(S.BARS, _ENDS) + f"SELECT code, round((c / o - 1) * 100, 2) AS return_pct, {S.annual('((c / o - 1) * 100)', _YEARS)} AS annualized, a AS start_date, z AS end_date, "
    "o AS buy_price, c AS sell_price FROM ends WHERE floor(floor(1e8 * 0.995 / o) / 100) * 100 > 0")


def _held(s, d):
    return M.account_figures(T.pattern_accounts(A.bars(s, d), FEW)).groupBy("code").agg(F.round(F.sum("return_pct"), 2).alias("return_pct"), F.sum("hold_days").alias("hold_days"))


add("metric_buy_hold_adjusted", lambda s, d: M.buy_hold_adjusted(A.bars(s, d), _held(s, d)),
    S.with_(*ACCOUNTS, _ENDS, "held AS (SELECT code, round(sum(return_pct), 2) AS r, sum(hold_days) AS h FROM acct GROUP BY code)",
            f"""x AS (SELECT code, n, coalesce(h, 0) AS h, coalesce(r, 0) AS r, round((c / c0 - 1) * 100, 2) AS bh, {_YEARS} AS y FROM ends LEFT JOIN held USING (code)),
            y AS (SELECT *, round(h / n, 4) AS ratio FROM x), q AS (SELECT *, round(bh * ratio, 2) AS adj FROM y)""", recursive=True)
    + f"SELECT code, n AS total_trading_days, CAST(h AS BIGINT) AS total_hold_days, ratio AS hold_ratio, bh AS buy_hold_return, {S.annual('bh', 'y')} AS buy_hold_annualized, adj AS adj_buy_hold_return, "
      f"{S.annual('adj', 'y')} AS adj_buy_hold_annualized, {S.annual('r', 'y')} AS strategy_annualized, round(y, 2) AS years FROM q")


def two_loads(s, d):
    """Stored performance: an older load with worse figures under the newest one."""
    new = few_scan(s, d)
    return new.withColumn("return_pct", F.col("return_pct") - 1).withColumn("load", F.lit(1)).unionByName(new.withColumn("load", F.lit(2)))


add("metric_market_wide_stats",
    lambda s, d: M.market_wide_stats(M.keep_last(two_loads(s, d), ("code", "side", "pattern"), "load")).select(
        "pattern", "pattern_cn", "side", "trades", *[F.round(c, 6).alias(c) for c in ("win_rate", "return_pct", "sharpe", "max_drawdown")]),
    _SCAN_FEW + f"""SELECT pattern, {S.cn()} AS pattern_cn, side, CAST(sum(trades) AS BIGINT) AS trades, """
    + ", ".join(f"round(coalesce(sum({c} * trades) FILTER (trades > 0) / sum(trades) FILTER (trades > 0), 0), 6) AS {c}" for c in ("win_rate", "return_pct", "sharpe", "max_drawdown"))
    + f" FROM scan WHERE {S.group_of()} <> 'etf' GROUP BY pattern, side")
add("metric_performance_stats", lambda s, d: M.performance_stats(few_scan(s, d)),
    _SCAN_FEW + "SELECT code, side, CAST(sum(trades) AS BIGINT) AS total_trades, round(avg(win_rate), 2) AS avg_win_rate, round(avg(return_pct), 2) AS avg_return FROM scan GROUP BY code, side")
add("metric_quality_report", lambda s, d: M.quality_report(few_scan(s, d), A.universe(s, d).filter("board = 'excluded'")).select(
        "market", *[F.col(c).cast("long").alias(c) for c in ("rows", "files", "idle", "issues")], "status"),
    _SCAN_FEW[:-1] + f""", {S.UNIVERSE}, per AS (SELECT code, side, count(*) AS rows, sum(trades) AS t FROM scan GROUP BY code, side),
    lines AS (SELECT {S.group_of()} AS market, rows, 1 AS files, CASE WHEN t = 0 THEN 1 ELSE 0 END AS idle, 0 AS issues FROM per
    UNION ALL SELECT {S.group_of()}, 0, 0, 0, 1 FROM universe WHERE board = 'excluded'),
    sums AS (SELECT coalesce(market, 'total') AS market, CAST(sum(rows) AS BIGINT) AS rows, CAST(sum(files) AS BIGINT) AS files, CAST(sum(idle) AS BIGINT) AS idle, CAST(sum(issues) AS BIGINT) AS issues FROM lines GROUP BY ROLLUP (market))
    SELECT *, CASE WHEN issues = 0 THEN 'good' WHEN issues < 10 THEN 'warning' ELSE 'error' END AS status FROM sums""".replace("sums AS (SELECT coalesce", "qsums AS (SELECT coalesce").replace("FROM sums", "FROM qsums"))


def _timed_scan(s, d):
    """Performance rows with the time of their load: a day for each code, the doji a day later."""
    days = A.universe(s, d).select("code", F.date_add(F.lit("2024-01-01").cast("date"), (F.col("key") % 7).cast("int")).alias("day"))
    return few_scan(s, d).join(days, "code").withColumn("loaded_at", F.date_add("day", F.when(F.col("pattern") == "CDLDOJI", 1).otherwise(0)).cast("timestamp"))


def _timed_issues(s, d):
    return A.universe(s, d).filter("board = 'excluded'").select("code", F.date_add(F.lit("2024-01-01").cast("date"), (F.col("key") % 5).cast("int")).cast("timestamp").alias("loaded_at"))


add("metric_quality_report_since", lambda s, d: M.quality_report(_timed_scan(s, d), _timed_issues(s, d), "2024-01-04").select(
        "market", *[F.col(c).cast("long").alias(c) for c in ("rows", "files", "idle", "issues")], "status"),
    _SCAN_FEW[:-1] + f""", {S.UNIVERSE}, per AS (SELECT code, side, count(*) AS rows, sum(trades) AS t FROM scan JOIN universe USING (code) GROUP BY code, side
      HAVING max(DATE '2024-01-01' + (key % 7)::INTEGER + CASE WHEN pattern = 'CDLDOJI' THEN 1 ELSE 0 END) >= DATE '2024-01-04'),
    lines AS (SELECT {S.group_of()} AS market, rows, 1 AS files, CASE WHEN t = 0 THEN 1 ELSE 0 END AS idle, 0 AS issues FROM per
    UNION ALL SELECT {S.group_of()}, 0, 0, 0, 1 FROM universe WHERE board = 'excluded' AND DATE '2024-01-01' + (key % 5)::INTEGER >= DATE '2024-01-04'),
    qsums AS (SELECT coalesce(market, 'total') AS market, CAST(sum(rows) AS BIGINT) AS rows, CAST(sum(files) AS BIGINT) AS files, CAST(sum(idle) AS BIGINT) AS idle, CAST(sum(issues) AS BIGINT) AS issues FROM lines GROUP BY ROLLUP (market))
    SELECT *, CASE WHEN issues = 0 THEN 'good' WHEN issues < 10 THEN 'warning' ELSE 'error' END AS status FROM qsums""")
add("metric_db_stats", lambda s, d: M.db_stats(A.universe(s, d), A.bars(s, d)),
    S.with_(S.BARS, S.UNIVERSE, "cov AS (SELECT code, count(*) AS n, min(trade_date) AS a, max(trade_date) AS z FROM bars GROUP BY code)")
    + "SELECT coalesce(board, 'total') AS board, count(*) AS securities, count(a) AS covered, CAST(coalesce(sum(n), 0) AS BIGINT) AS bars, min(a) AS min_date, max(z) AS max_date "
      "FROM universe LEFT JOIN cov USING (code) GROUP BY ROLLUP (board)")
add("metric_account_return", lambda s, d: M.account_return(few_trades(s, d)).select("code", "pattern", "side", F.round("final_value", 2).alias("final_value"), "account_return"),
    S.with_(*_BASE, S.walk(), recursive=True) + "SELECT code, pattern, side, round(cash_out, 2) AS final_value, trunc((cash_out / 1e8::DOUBLE - 1) * 100 * 100) / 100.0 AS account_return FROM trades "
    "QUALIFY row_number() OVER (PARTITION BY code, pattern, side ORDER BY trade_no DESC) = 1")
add("metric_log_return", lambda s, d: M.log_return(A.bars(s, d)),
    S.with_(S.BARS, _ENDS) + "SELECT code, round(ln(c / c0) * 100, 4) AS log_return, round((exp(ln(c / c0) / n * 252) - 1) * 100, 4) AS annual_return, round((exp(ln(c / c0)) - 1) * 100, 4) AS simple_return FROM ends")


def _variant(s, d, cautious):
    return M.scan_patterns(A.bars(s, d), buy=["CDLMARUBOZU"], sell=(), cautious=cautious)


_VAR = S.with_(S.BARS, S.sig(["CDLMARUBOZU"]), S.outcomes(), _LAGS_OF, S.CAND,
               "cand_a AS (SELECT code, pattern || '/a' AS pattern, * EXCLUDE (code, pattern) FROM cand WHERE side = 'buy')",
               "cand_b AS (SELECT k.code, k.pattern || '/b' AS pattern, k.* EXCLUDE (code, pattern) FROM cand k JOIN lags b ON b.code = k.code AND b.i = k.e "
               "WHERE k.side = 'buy' AND b.i >= 3 AND c1 / o1 < 1.015 AND c2 / o2 < 1.015)",
               "cand2 AS (SELECT * FROM cand_a UNION ALL SELECT * FROM cand_b)", S.walk().replace("FROM cand a", "FROM cand2 a").replace("JOIN cand b", "JOIN cand2 b"), S.equity(),
               """cmp AS (SELECT a.code, a.trades AS trades_a, coalesce(b.trades, 0) AS trades_b, """
               + ", ".join(f"a.{c} AS {c}_a, coalesce(b.{c}, 0) AS {c}_b, round(coalesce(b.{c}, 0) - a.{c}, 2) AS {c}_diff" for c in ("win_rate", "return_pct", "sharpe", "max_drawdown"))
               + " FROM acct a LEFT JOIN acct b ON b.code = a.code AND b.pattern LIKE '%/b' WHERE a.pattern LIKE '%/a' AND a.trades >= 10)", recursive=True)
add("metric_compare_variants", lambda s, d: M.compare_variants(_variant(s, d, False), _variant(s, d, True)), _VAR + "SELECT * FROM cmp")
add("metric_variant_means", lambda s, d: M.variant_means(M.compare_variants(_variant(s, d, False), _variant(s, d, True))),
    _VAR + "SELECT count(*) AS codes, count(*) FILTER (trades_b = 0) AS idle, round(sum(win_rate_b) / count(*) FILTER (trades_b > 0), 2) AS win_rate_b, round(avg(win_rate_a), 2) AS win_rate_a, "
    "round(sum(return_pct_b) / count(*) FILTER (trades_b > 0), 2) AS return_pct_b, round(avg(return_pct_a), 2) AS return_pct_a, round(avg(sharpe_diff), 2) AS sharpe_diff, "
    "round(avg(max_drawdown_diff), 2) AS max_drawdown_diff FROM cmp")


def _sweep_sql(days):
    parts, names = [], []
    for n in days:
        t = ",\n".join([S.outcomes(n), S.CAND])
        for c in ("num", "stops", "both_sides", "kinds", "res", "cand"):
            t = re.sub(rf"\b{c}\b", f"{c}_{n}", t)
        parts.append(t)
        names.append(f"SELECT {n} AS observe_day, * FROM cand_{n}")
    return S.with_(S.BARS, S.sig(DAILY_PATTERNS), *parts, f"cand AS ({' UNION ALL '.join(names)})",
                   S.walk(("code", "observe_day", "pattern", "side")),
                   f"num AS (SELECT * FROM num_{days[0]})", S.equity(("code", "observe_day", "pattern", "side")), recursive=True)


add("metric_observe_day_sweep",
    lambda s, d: M.observe_day_sweep(A.bars(s, d), DAILY_PATTERNS, range(1, 10)).select("code", "observe_day", "pattern", "side", "trades", "win_rate", "return_pct", "sharpe", "max_drawdown"),
    _sweep_sql(list(range(1, 10))) + "SELECT code, observe_day, pattern, side, trades, win_rate, return_pct, sharpe, max_drawdown FROM acct")
_GRID = [{"n": 10, "diff": 0.005}, {"n": 10, "diff": 0.01}, {"n": 30, "diff": 0.005}, {"n": 30, "diff": 0.01}]


def _param_sql() -> str:
    """One account walk per parameter set."""
    ctes, rows = [S.BARS, "lastc AS (SELECT code, last(close ORDER BY trade_date) AS lc FROM bars GROUP BY code)"], []
    for i, g in enumerate(_GRID):
        n, diff = g["n"], g["diff"]
        flags = [_lined(h=_roll("max", "high", n), l=_roll("min", "low", n)),
                 f"flags AS (SELECT *, coalesce(abs(close - l) < close * {diff}, false) AS buy, coalesce(abs(close - h) < close * {diff}, false) AS sell FROM lined)"]
        text = _flag_sql(flags).split(S.BARS + ",\n", 1)[1].rstrip()
        for c in ("lined", "flags", "seen", "ev", "st"):
            text = re.sub(rf"\b{c}\b", f"{c}_{i}", text)
        ctes.append(text)
        rows.append(f"""SELECT s.code, {i} AS set_no, 'n={n},diff={diff}' AS params, count(*) FILTER (s.out_date IS NOT NULL) + max(CASE WHEN z.size > 0 THEN 1 ELSE 0 END) AS trades,
          round(ln(max(z.cash + z.size * lc) / 1e8::DOUBLE) * 100, 4) AS log_return FROM st_{i} s JOIN (SELECT * FROM st_{i} QUALIFY row_number() OVER (PARTITION BY code ORDER BY n DESC) = 1) z ON z.code = s.code
          JOIN lastc c ON c.code = s.code GROUP BY s.code HAVING trades > 0""")
    return S.with_(*ctes, "sweep AS (" + " UNION ALL ".join(rows) + ")", recursive=True)


add("metric_param_sweep", lambda s, d: R.param_sweep(A.bars(s, d), "near_window", _GRID), _param_sql() + "SELECT code, set_no, params, trades, log_return FROM sweep")
add("metric_best_params", lambda s, d: R.best_params(R.param_sweep(A.bars(s, d), "near_window", _GRID)),
    _param_sql() + "SELECT code, set_no, params, trades, log_return FROM sweep QUALIFY row_number() OVER (PARTITION BY code ORDER BY log_return DESC, set_no) = 1")

# --- Z1-Z4 --------------------------------------------------------------------------------------

_ZIG = f"""num AS (SELECT code, trade_date, close, row_number() OVER ({S.W}) - 1 AS i, count(*) OVER (PARTITION BY code) AS n FROM bars),
zz AS (SELECT code, i, close AS ext, i AS ext_i, 0 AS dir, NULL::BIGINT AS p_i, NULL::DOUBLE AS p_price, NULL::VARCHAR AS p_kind FROM num WHERE i = 0 AND n >= 5
  UNION ALL SELECT z.code, x.i,
    CASE WHEN (z.dir >= 0 AND (x.close > z.ext OR x.close < z.ext * (1 - 0.08::DOUBLE))) OR (z.dir = -1 AND (x.close < z.ext OR x.close > z.ext * (1 + 0.08::DOUBLE))) THEN x.close ELSE z.ext END,
    CASE WHEN (z.dir >= 0 AND (x.close > z.ext OR x.close < z.ext * (1 - 0.08::DOUBLE))) OR (z.dir = -1 AND (x.close < z.ext OR x.close > z.ext * (1 + 0.08::DOUBLE))) THEN x.i ELSE z.ext_i END,
    CASE WHEN z.dir >= 0 AND x.close > z.ext THEN 1 WHEN z.dir >= 0 AND x.close < z.ext * (1 - 0.08::DOUBLE) THEN -1 WHEN z.dir = -1 AND x.close > z.ext * (1 + 0.08::DOUBLE) THEN 1 ELSE z.dir END,
    CASE WHEN (z.dir >= 0 AND x.close < z.ext * (1 - 0.08::DOUBLE)) OR (z.dir = -1 AND x.close > z.ext * (1 + 0.08::DOUBLE)) THEN z.ext_i END,
    CASE WHEN (z.dir >= 0 AND x.close < z.ext * (1 - 0.08::DOUBLE)) OR (z.dir = -1 AND x.close > z.ext * (1 + 0.08::DOUBLE)) THEN z.ext END,
    CASE WHEN z.dir >= 0 AND x.close < z.ext * (1 - 0.08::DOUBLE) THEN 'H' WHEN z.dir = -1 AND x.close > z.ext * (1 + 0.08::DOUBLE) THEN 'L' END
  FROM zz z JOIN num x ON x.code = z.code AND x.i = z.i + 1),
turns AS (SELECT code, p_i AS i, p_price AS price, p_kind AS kind FROM zz WHERE p_i IS NOT NULL),
ends0 AS (SELECT z.code, z.ext_i AS i, z.ext AS price, CASE WHEN z.dir = -1 THEN 'L' ELSE 'H' END AS kind FROM zz z JOIN num x ON x.code = z.code AND x.i = z.i AND x.i = x.n - 1
  WHERE z.ext_i <> 0 AND NOT EXISTS (SELECT 1 FROM turns t WHERE t.code = z.code AND t.i = z.ext_i)),
mid AS (SELECT * FROM turns UNION ALL SELECT * FROM ends0),
f0 AS (SELECT x.code, 0::BIGINT AS i, x.close AS price, CASE WHEN (SELECT first(m.kind ORDER BY m.i) FROM mid m WHERE m.code = x.code) = 'H' THEN 'L' ELSE 'H' END AS kind
  FROM num x WHERE x.i = 0 AND x.n >= 5 AND NOT EXISTS (SELECT 1 FROM mid m WHERE m.code = x.code AND m.i = 0)),
piv AS (SELECT p.code, CAST(row_number() OVER (PARTITION BY p.code ORDER BY p.i) - 1 AS INTEGER) AS pivot_no, p.i, x.trade_date, p.price, p.kind
  FROM (SELECT * FROM mid UNION ALL SELECT * FROM f0) p JOIN num x ON x.code = p.code AND x.i = p.i)"""
_SEGS = """seg AS (SELECT code, pivot_no AS segment_no, trade_date AS start, lead(trade_date) OVER w AS "end", i AS a, lead(i) OVER w AS b, price AS start_price, lead(price) OVER w AS end_price,
  kind || '->' || lead(kind) OVER w AS pivot_type FROM piv WINDOW w AS (PARTITION BY code ORDER BY pivot_no)),
segm AS (SELECT *, b - a AS days, round((end_price / start_price - 1) * 100, 2) AS change_pct FROM seg WHERE b IS NOT NULL)"""
add("cycle_zigzag_pivots", lambda s, d: Z.zigzag_pivots(A.bars(s, d)).select("code", "pivot_no", "bar_idx", "trade_date", "price", "kind"),
    S.with_(S.BARS, _ZIG, recursive=True) + "SELECT code, pivot_no, CAST(i AS INTEGER) AS bar_idx, trade_date, price, kind FROM piv")
_SEG_COLS = "code, start, \"end\", CAST(days AS INTEGER) AS days, change_pct, start_price, end_price, pivot_type"
add("cycle_segments", lambda s, d: Z.segments(Z.zigzag_pivots(A.bars(s, d))).select("code", "start", "end", "days", "change_pct", "start_price", "end_price", "pivot_type"),
    S.with_(S.BARS, _ZIG, _SEGS, recursive=True) + f"SELECT {_SEG_COLS} FROM segm")
_T = "0.03::DOUBLE"
_SUB = f"""big AS (SELECT * FROM segm WHERE abs(change_pct) >= 6 AND days >= {{d2}}),
sb AS (SELECT g.code, g.segment_no, g.pivot_type, x.trade_date, x.close, x.i - g.a AS i, g.b - g.a AS n FROM big g JOIN num x ON x.code = g.code AND x.i BETWEEN g.a AND g.b),
sz AS (SELECT code, segment_no, i, close AS ext, i AS ext_i, 0 AS dir, NULL::BIGINT AS p_i, NULL::DOUBLE AS p_price FROM sb WHERE i = 0
  UNION ALL SELECT z.code, z.segment_no, x.i,
    CASE WHEN (z.dir >= 0 AND (x.close > z.ext OR x.close < z.ext * (1 - {_T}))) OR (z.dir = -1 AND (x.close < z.ext OR x.close > z.ext * (1 + {_T}))) THEN x.close ELSE z.ext END,
    CASE WHEN (z.dir >= 0 AND (x.close > z.ext OR x.close < z.ext * (1 - {_T}))) OR (z.dir = -1 AND (x.close < z.ext OR x.close > z.ext * (1 + {_T}))) THEN x.i ELSE z.ext_i END,
    CASE WHEN z.dir >= 0 AND x.close > z.ext THEN 1 WHEN z.dir >= 0 AND x.close < z.ext * (1 - {_T}) THEN -1 WHEN z.dir = -1 AND x.close > z.ext * (1 + {_T}) THEN 1 ELSE z.dir END,
    CASE WHEN (z.dir >= 0 AND x.close < z.ext * (1 - {_T})) OR (z.dir = -1 AND x.close > z.ext * (1 + {_T})) THEN z.ext_i END,
    CASE WHEN (z.dir >= 0 AND x.close < z.ext * (1 - {_T})) OR (z.dir = -1 AND x.close > z.ext * (1 + {_T})) THEN z.ext END
  FROM sz z JOIN sb x ON x.code = z.code AND x.segment_no = z.segment_no AND x.i = z.i + 1),
sp AS (SELECT code, segment_no, 0 AS ord, 0::BIGINT AS i FROM sb WHERE i = 0 UNION ALL SELECT code, segment_no, 1, p_i FROM sz WHERE p_i IS NOT NULL
  UNION ALL SELECT b.code, b.segment_no, 2, b.n FROM sb b WHERE b.i = 0 AND b.n <> coalesce((SELECT max(p_i) FROM sz z WHERE z.code = b.code AND z.segment_no = b.segment_no), 0)),
pairs AS (SELECT code, segment_no, i AS i1, lead(i) OVER (PARTITION BY code, segment_no ORDER BY i, ord) AS i2 FROM sp),
subs AS (SELECT p.code, x.trade_date AS start, y.trade_date AS "end", x.close AS start_price, y.close AS end_price, x.pivot_type, p.i2 - p.i1 AS days,
  round((y.close / x.close - 1) * 100, 2) AS change_pct FROM pairs p JOIN sb x ON x.code = p.code AND x.segment_no = p.segment_no AND x.i = p.i1
  JOIN sb y ON y.code = p.code AND y.segment_no = p.segment_no AND y.i = p.i2 WHERE p.i2 IS NOT NULL),
parts AS (SELECT code, start, "end", start_price, end_price, pivot_type, days, change_pct FROM segm WHERE NOT (abs(change_pct) >= 6 AND days >= {{d2}}) UNION ALL SELECT * FROM subs)"""
add("cycle_sub_segments",
    lambda s, d: Z.sub_segments(A.bars(s, d), Z.segments(Z.zigzag_pivots(A.bars(s, d))), min_days=2).select("code", "start", "end", "days", "change_pct", "start_price", "end_price", "pivot_type"),
    S.with_(S.BARS, _ZIG, _SEGS, _SUB.format(d2=4), recursive=True) + f"SELECT {_SEG_COLS} FROM parts")
add("cycle_market_cycles",
    lambda s, d: Z.market_cycles(A.bars(s, d)).select("code", "start", "end", "days", "change_pct", "start_price", "end_price", "pivot_type", "type"),
    S.with_(S.BARS, _ZIG, _SEGS, _SUB.format(d2=44), recursive=True)
    + f"SELECT {_SEG_COLS}, CASE WHEN change_pct >= 5 THEN 'up' WHEN change_pct <= -5 THEN 'down' ELSE 'flat' END AS type FROM parts WHERE days >= 22")
add("cycle_market_cycles_short",
    lambda s, d: Z.market_cycles(A.bars(s, d), min_days=5).select("code", "start", "end", "days", "change_pct", "start_price", "end_price", "pivot_type", "type"),
    S.with_(S.BARS, _ZIG, _SEGS, _SUB.format(d2=10), recursive=True)
    + f"SELECT {_SEG_COLS}, CASE WHEN change_pct >= 5 THEN 'up' WHEN change_pct <= -5 THEN 'down' ELSE 'flat' END AS type FROM parts WHERE days >= 5")


# --- rules given as code --------------------------------------------------------------------------


def _turns(least: int = 3):
    """A rule as Python: the first rise after a run of falls buys, the first fall after a run of rises sells."""

    def decide(bars, least=least):
        run, buy, sell, last = 0, [], [], None
        for close in bars["close"]:
            move = 0 if last is None else (close > last) - (close < last)
            buy.append(move > 0 and run <= -least)
            sell.append(move < 0 and run >= least)
            run = run + move if move * run > 0 else move
            last = close
        return bars.assign(buy=buy, sell=sell)

    return R.rule_of_code(decide, ("close",))


_TURNS = ("mv AS (SELECT *, sign(close - lag(close) OVER (PARTITION BY code ORDER BY trade_date))::INT AS m FROM bars)",
          "ml AS (SELECT *, " + ", ".join(f"lag(m, {k}) OVER (PARTITION BY code ORDER BY trade_date) AS m{k}" for k in (1, 2, 3)) + " FROM mv)",
          "flags AS (SELECT code, trade_date, open, close, coalesce(m = 1 AND m1 = -1 AND m2 = -1 AND m3 = -1, false) AS buy, coalesce(m = -1 AND m1 = 1 AND m2 = 1 AND m3 = 1, false) AS sell FROM ml)")
add("rule_of_code", lambda s, d: _turns()(A.bars(s, d)).select("code", "trade_date", "buy", "sell"),
    S.with_(S.BARS, *_TURNS) + "SELECT code, trade_date, buy, sell FROM flags")
add("trade_rule_of_code", lambda s, d: R.flag_trades(_turns()(A.bars(s, d))).filter("NOT is_open").select(*_FT), _flag_sql(_TURNS) + _FSQL)

"""Patterns, refinements, indicators and rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import sql as S
from checks.registry import add
from wickspark import adapters as A
from wickspark.model import ALL_PATTERNS, CAUTIOUS, DAILY_BUY_ORDER, DAILY_SELL_ORDER
from wickspark.operators import candles, indicators as I, refine, rules as R

# --- P1-P61 -------------------------------------------------------------------------------------

for _n in ALL_PATTERNS:
    add(f"pattern_{_n.lower()}",
        lambda s, d, n=_n: candles.signals(A.bars(s, d), [n]).select("code", "trade_date", "pattern", "value"),
        S.with_(S.BARS, S.sig([_n])) + "SELECT code, trade_date, pattern, value FROM sig")

add("patterns_all",
    lambda s, d: candles.signals(A.bars(s, d)).groupBy("pattern", "value").agg(
        F.count("*").alias("n"), F.countDistinct("code").alias("codes")),
    S.with_(S.BARS, S.sig()) + "SELECT pattern, value, count(*) AS n, count(DISTINCT code) AS codes FROM sig GROUP BY ALL")

# --- C1-C6 --------------------------------------------------------------------------------------

_NUM = f"num AS (SELECT *, row_number() OVER ({S.W}) - 1 AS i FROM bars)"
_LAGS = "lags AS (SELECT code, i, {cols} FROM num)".format(cols=", ".join(
    f"lag({f}, {k}) OVER ({S.W}) AS {f[0]}{k}" if k else f"{f} AS {f[0]}0" for k in range(5) for f in ("open", "high", "low", "close")))
_RULE = {
    "CDLSEPARATINGLINES": "c2 > c3 AND c0 > o0",
    "CDLTASUKIGAP": "o1 > h2 AND l1 > h2",
    "CDLDRAGONFLYDOJI": "c1 < o1 AND c1 < c2 AND c2 < c3 AND c0 < c1",
    "CDLTAKURI": "c1 < o1 AND c1 < c2 AND c2 < c3 AND c0 < c1",
    "CDLMARUBOZU": "c1 / o1 < 1.015 AND c2 / o2 < 1.015",
    "CDLINVERTEDHAMMER": "CASE WHEN c0 > o0 THEN o0 ELSE c0 END / l0 < 1.003",
}
_BODY = "(c0 > o0 AND o0 / l0 < 1.003) OR (c0 < o0 AND c0 / l0 < 1.003)"
_RULE2 = {**_RULE, "CDLINVERTEDHAMMER": _BODY}
_LONG = "c1 < c2 AND c2 < c3 AND c3 < c4 AND c0 < c1"
_RULE3 = {**_RULE2, "CDLDRAGONFLYDOJI": _LONG, "CDLTAKURI": _LONG}


def _case(rule: dict[str, str]) -> str:
    return "CASE g.pattern " + " ".join(f"WHEN '{k}' THEN ({v})" for k, v in rule.items()) + " ELSE true END"


_COLS = "SELECT g.code, g.trade_date, g.pattern, g.value FROM sig g JOIN lags b ON b.code = g.code AND b.i = g.i"
add("refine_cautious_at_entry",
    lambda s, d: refine.cautious_at_entry(A.bars(s, d)).select("code", "trade_date", "pattern", "value"),
    S.with_(S.BARS, _NUM, _LAGS, S.sig(CAUTIOUS)) + _COLS + f" + 1 WHERE b.i >= 3 AND {_case(_RULE)}")
add("refine_cautious_at_signal",
    lambda s, d: refine.cautious_at_signal(A.bars(s, d), CAUTIOUS).select("code", "trade_date", "pattern", "value"),
    S.with_(S.BARS, _NUM, _LAGS, S.sig(CAUTIOUS)) + _COLS + f" WHERE g.value < 0 OR (b.i >= 3 AND {_case(_RULE2)})")
add("refine_extra_check",
    lambda s, d: refine.extra_check(A.bars(s, d), CAUTIOUS).select("code", "trade_date", "pattern", "value"),
    S.with_(S.BARS, _NUM, _LAGS, S.sig(CAUTIOUS)) + _COLS + f" WHERE g.value < 0 OR {_case(_RULE3)}")
for _side, _op in (("buy", ">"), ("sell", "<")):
    add(f"refine_any_triggered_{_side}",
        lambda s, d, side=_side: refine.any_triggered(A.bars(s, d), side).select(
            "code", "trade_date", F.concat_ws(",", "patterns").alias("patterns"), F.size("patterns").alias("n")),
        S.with_(S.BARS, _NUM, _LAGS, S.sig()) + f"SELECT g.code, g.trade_date, string_agg(g.pattern, ',' ORDER BY g.pattern) AS patterns, "
        f"CAST(count(*) AS INTEGER) AS n FROM sig g JOIN lags b ON b.code = g.code AND b.i = g.i WHERE g.value {_op} 0 "
        f"AND {_case(_RULE3) if _side == 'buy' else 'true'} GROUP BY g.code, g.trade_date")
add("refine_up_hammer",
    lambda s, d: refine.up_hammer(A.bars(s, d)).filter("hammer > 0"),
    S.with_(S.BARS, S.sig(["CDLHAMMER"])) + "SELECT b.code, b.trade_date, b.open AS hammer FROM bars b JOIN sig g USING (code, trade_date) "
    "WHERE g.value = 100 AND (abs(1 - close / high) < 0.001 OR abs(1 - open / high) < 0.001)")
_TWO = ["CDL2CROWS", "CDLADVANCEBLOCK", "CDLDOJI"]
add("refine_alias_pattern",
    lambda s, d: candles.signals(A.bars(s, d), _TWO).select(refine.alias_pattern().alias("shown"), "pattern").groupBy("shown", "pattern").agg(F.count("*").alias("n")),
    S.with_(S.BARS, S.sig(_TWO)) + "SELECT CASE pattern WHEN 'CDL2CROWS' THEN 'CDLADVANCEBLOCK' ELSE pattern END AS shown, pattern, count(*) AS n FROM sig GROUP BY ALL")

# --- W1-W11 -------------------------------------------------------------------------------------

def _roll(fn, col, n):
    return f"CASE WHEN row_number() OVER ({S.W}) >= {n} THEN {fn}({col}) OVER ({S.W} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW) END"


add("indicator_sma", lambda s, d: I.lines(A.bars(s, d), ma=I.sma("close", 20)).select("code", "trade_date", F.round("ma", 6).alias("ma")),
    S.with_(S.BARS) + f"SELECT code, trade_date, round({_roll('avg', 'close', 20)}, 6) AS ma FROM bars")
add("indicator_highest_lowest",
    lambda s, d: I.lagged(I.lines(A.bars(s, d), hi=I.highest("high", 20), lo=I.lowest("low", 10)), hi_prev="hi").select("code", "trade_date", "hi", "lo", "hi_prev"),
    S.with_(S.BARS, f"r AS (SELECT code, trade_date, {_roll('max', 'high', 20)} AS hi, {_roll('min', 'low', 10)} AS lo FROM bars)")
    + f"SELECT code, trade_date, hi, lo, lag(hi) OVER ({S.W}) AS hi_prev FROM r")


def _cross(src: str, out: str, pairs: dict[str, tuple[str, str]]) -> str:
    """Crossings by joining the last differing bar before each bar."""
    was = ", ".join(f"last_value(nullif(sign({a} - {b}), 0) IGNORE NULLS) OVER ({S.W} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS was_{n}"
                    for n, (a, b) in pairs.items())
    got = ", ".join(f"CAST(CASE WHEN was_{n} = -1 AND {a} > {b} THEN 1 WHEN was_{n} = 1 AND {a} < {b} THEN -1 ELSE 0 END AS INTEGER) AS {n}"
                    for n, (a, b) in pairs.items())
    return f"{out}_w AS (SELECT *, {was} FROM {src}), {out} AS (SELECT *, {got} FROM {out}_w)"


def _lined(**cols: str) -> str:
    return "lined AS (SELECT *, " + ", ".join(f"{e} AS {n}" for n, e in cols.items()) + " FROM bars)"


def _prev(src: str, out: str, **cols: str) -> str:
    return f"{out} AS (SELECT *, " + ", ".join(f"lag({c}) OVER ({S.W}) AS {n}" for n, c in cols.items()) + f" FROM {src})"


add("indicator_cross", lambda s, d: I.cross(I.lines(A.bars(s, d), fast=I.sma("close", 5), slow=I.sma("close", 20)), x=("fast", "slow"))
    .filter("x <> 0").select("code", "trade_date", "x"),
    S.with_(S.BARS, _lined(fast=_roll("avg", "close", 5), slow=_roll("avg", "close", 20)), _cross("lined", "xx", {"x": ("fast", "slow")}))
    + "SELECT code, trade_date, x FROM xx WHERE x <> 0")
_TR = (f"tr0 AS (SELECT *, lag(close) OVER ({S.W}) AS pc, row_number() OVER ({S.W}) - 1 AS i FROM bars), "
       "tr AS (SELECT * EXCLUDE (pc), CASE WHEN pc IS NOT NULL THEN greatest(high - low, abs(pc - high), abs(pc - low)) END AS tr FROM tr0), "
       f"atr AS (SELECT *, CASE WHEN i >= 14 THEN avg(tr) OVER ({S.W} ROWS BETWEEN 13 PRECEDING AND CURRENT ROW) END AS atr FROM tr)")
add("indicator_atr", lambda s, d: I.atr(A.bars(s, d)).select("code", "trade_date", F.round("tr", 6).alias("tr"), F.round("atr", 6).alias("atr")),
    S.with_(S.BARS, _TR) + "SELECT code, trade_date, round(tr, 6) AS tr, round(atr, 6) AS atr FROM atr")
add("indicator_support_resistance", lambda s, d: I.support_resistance(A.bars(s, d)),
    S.with_(S.BARS, _lined(support=_roll("min", "low", 20), resistance=_roll("max", "high", 20)),
            "banded AS (SELECT *, support * (1 + 0.005::DOUBLE) AS support_band, resistance * (1 - 0.005::DOUBLE) AS resistance_band FROM lined)",
            _prev("banded", "p", sp="support_band", rp="resistance_band"))
    + "SELECT code, trade_date, support, support_band, resistance, resistance_band, coalesce(close > rp, false) AS bullish_break, "
      "coalesce(close < sp, false) AS bearish_break, CASE WHEN close > rp THEN close END AS bullish_point, CASE WHEN close < sp THEN close END AS bearish_point FROM p")
add("indicator_ma_distance", lambda s, d: I.ma_distance(A.bars(s, d), 10, 0.01).select("code", "trade_date", F.round("distance", 6).alias("distance"), "near"),
    S.with_(S.BARS, _lined(ma=_roll("avg", "close", 10)))
    + "SELECT code, trade_date, round(close - ma, 6) AS distance, coalesce(close - ma > 0 AND close - ma < close * 0.01, false) AS near FROM lined")
add("indicator_pct_chg", lambda s, d: I.pct_chg(A.bars(s, d), 4).select("code", "trade_date", "pct_chg"),
    S.with_(S.BARS, _prev("bars", "p", pc="close")) + "SELECT code, trade_date, CASE WHEN pc > 0 THEN round((close - pc) / pc * 100, 4) END AS pct_chg FROM p")
add("indicator_daily_return", lambda s, d: I.daily_return(A.bars(s, d)).select("code", "trade_date", F.round("daily_return", 8).alias("daily_return")),
    S.with_(S.BARS, _prev("bars", "p", pc="close")) + "SELECT code, trade_date, round(close / pc - 1, 8) AS daily_return FROM p")
add("indicator_drawdown", lambda s, d: I.drawdown(A.bars(s, d)).select("code", "trade_date", "peak", F.round("drawdown", 6).alias("drawdown")),
    S.with_(S.BARS) + f"SELECT code, trade_date, max(close) OVER ({S.W}) AS peak, round((max(close) OVER ({S.W}) - close) / max(close) OVER ({S.W}) * 100, 6) AS drawdown FROM bars")
add("indicator_max_drawdown", lambda s, d: I.max_drawdown(A.bars(s, d)).select("code", F.round("max_drawdown", 6).alias("max_drawdown")),
    S.with_(S.BARS, f"p AS (SELECT code, close, max(close) OVER ({S.W}) AS peak FROM bars)") + "SELECT code, round(max((peak - close) / peak * 100), 6) AS max_drawdown FROM p GROUP BY code")
add("indicator_latest_row", lambda s, d: I.latest_row(A.bars(s, d)),
    S.with_(S.BARS) + "SELECT code, trade_date, open, high, low, close, vol FROM bars QUALIFY row_number() OVER (PARTITION BY code ORDER BY trade_date DESC) = 1")
add("indicator_bar_index", lambda s, d: candles.bar_index(A.bars(s, d)).select("code", "trade_date", "bar_idx"),
    S.with_(S.BARS) + f"SELECT code, trade_date, CAST(row_number() OVER ({S.W}) - 1 AS INTEGER) AS bar_idx FROM bars")

# --- G1-G13 -------------------------------------------------------------------------------------

_FLAGS = ("code", "trade_date", "buy", "sell")


def _flagged(fn, **kw):
    return lambda s, d: fn(A.bars(s, d), **kw).filter("buy OR sell").select(*_FLAGS)


RULE_SQL = {}
RULE_SQL["breakout"] = [_lined(h=_roll("max", "high", 20), l=_roll("min", "low", 20)), _prev("lined", "p", hp="h", lp="l"),
                        _cross("p", "q", {"up": ("close", "hp"), "dn": ("close", "lp")}), "flags AS (SELECT *, up = 1 AS buy, dn = -1 AS sell FROM q)"]
RULE_SQL["single_ma"] = [_lined(m=_roll("avg", "close", 20)), _prev("lined", "p", mp="m"), _cross("p", "q", {"x": ("close", "mp")}),
                         "flags AS (SELECT *, x = 1 AS buy, x = -1 AS sell FROM q)"]
RULE_SQL["double_ma"] = [_lined(f=_roll("avg", "close", 10), m=_roll("avg", "close", 60)), _cross("lined", "q", {"x": ("f", "m")}),
                         "flags AS (SELECT *, x = 1 AS buy, x = -1 AS sell FROM q)"]
RULE_SQL["combo"] = [_lined(h=_roll("max", "high", 20), l=_roll("min", "low", 20), f=_roll("avg", "close", 10), m=_roll("avg", "close", 60)),
                     _prev("lined", "p", hp="h", lp="l"),
                     _cross("p", "q", {"up": ("close", "hp"), "dn": ("close", "lp"), "x": ("f", "m")}),
                     "flags AS (SELECT *, up = 1 OR x = 1 AS buy, dn = -1 OR x = -1 AS sell FROM q)"]
_LINES = dict(h=_roll("max", "high", 20), l=_roll("min", "low", 20), l10=_roll("min", "low", 10), f=_roll("avg", "close", 10), m=_roll("avg", "close", 60))
RULE_SQL["turtle"] = [_lined(**_LINES), _prev("lined", "p", hp="h", lp="l10"),
                      _cross("p", "q", {"up": ("close", "hp"), "dn": ("close", "lp")}), "flags AS (SELECT *, up <> 0 AS buy, dn = -1 AS sell FROM q)"]
_NEAR3 = {f"n{p}": _roll("avg", "close", p) for p in (10, 60, 90)}
RULE_SQL["near_ma"] = [_lined(**_NEAR3), _cross("lined", "q", {f"x{p}": ("close", f"n{p}") for p in (10, 60, 90)}),
                       "flags AS (SELECT *, " + " OR ".join(f"coalesce(close > n{p} AND close - n{p} < close * 0.01, false)" for p in (10, 60, 90))
                       + " AS buy, x10 = -1 OR x60 = -1 OR x90 = -1 AS sell FROM q)"]
RULE_SQL["near_window"] = [_lined(h=_roll("max", "high", 30), l=_roll("min", "low", 30)),
                           "flags AS (SELECT *, coalesce(abs(close - l) < close * 0.01, false) AS buy, coalesce(abs(close - h) < close * 0.01, false) AS sell FROM lined)"]
for _name, _ctes in RULE_SQL.items():
    add(f"rule_{_name}", _flagged(R.RULES[_name]),
        S.with_(S.BARS, *_ctes) + "SELECT code, trade_date, buy, sell FROM flags WHERE buy OR sell")

UNION_SQL = [_lined(**_LINES, **{f"n{p}": _roll("avg", "close", p) for p in (10, 20, 60, 90)}), _prev("lined", "p", hp="h", lp="l", tlp="l10"),
             _cross("p", "q", {"up": ("close", "hp"), "dn": ("close", "lp"), "x": ("f", "m"), "td": ("close", "tlp"),
                               **{f"x{p}": ("close", f"n{p}") for p in (10, 20, 60, 90)}})]
_NEAR_BUY = " OR ".join(f"coalesce(close > n{p} AND close - n{p} < close * 0.01, false)" for p in (10, 20, 60, 90))
UNION_BUY = "CASE WHEN up <> 0 THEN 'turtle' WHEN x = 1 THEN 'double_ma' END"
UNION_SELL = "CASE WHEN td = -1 THEN 'turtle' WHEN x = -1 THEN 'double_ma' WHEN dn = -1 THEN 'breakout' END"
UNION_BUY_V2 = f"CASE WHEN up <> 0 THEN 'turtle' WHEN {_NEAR_BUY} THEN 'near_ma' WHEN x = 1 THEN 'double_ma' END"
UNION_SELL_V2 = ("CASE WHEN td = -1 THEN 'turtle' WHEN x10 = -1 OR x20 = -1 OR x60 = -1 OR x90 = -1 THEN 'near_ma' WHEN x = -1 THEN 'double_ma' "
                 "WHEN dn = -1 THEN 'breakout' END")
UNION_BUY_OTHER = f"CASE WHEN {_NEAR_BUY} THEN 'near_ma' WHEN x = 1 THEN 'double_ma' WHEN up = 1 THEN 'breakout' END"
UNION_SELL_OTHER = "CASE WHEN x10 = -1 OR x20 = -1 OR x60 = -1 OR x90 = -1 THEN 'near_ma' WHEN x = -1 THEN 'double_ma' WHEN dn = -1 THEN 'breakout' END"
for _name, _fn, _b, _s in (("indicator_union", R.indicator_union, UNION_BUY, UNION_SELL), ("indicator_union_v2", R.indicator_union_v2, UNION_BUY_V2, UNION_SELL_V2)):
    add(f"rule_{_name}", lambda s, d, fn=_fn: fn(A.bars(s, d)).filter("buy OR sell").select("code", "trade_date", "buy_signal", "sell_signal"),
        S.with_(S.BARS, *UNION_SQL) + f"SELECT * FROM (SELECT code, trade_date, {_b} AS buy_signal, {_s} AS sell_signal FROM q) WHERE buy_signal IS NOT NULL OR sell_signal IS NOT NULL")
_CB = [p for p, _ in R.COMBO_BUYS]
_RANK_B = "CASE g.pattern " + " ".join(f"WHEN '{p}' THEN {i}" for i, p in enumerate(_CB)) + " END"
_RANK_S = "CASE g.pattern " + " ".join(f"WHEN '{p}' THEN {i}" for p, i in {p: i for i, p in enumerate(R.COMBO_SELLS)}.items()) + " END"
_ALLC = tuple(dict.fromkeys(_CB + list(R.COMBO_SELLS)))
add("rule_pattern_combo", lambda s, d: R.pattern_combo(A.bars(s, d)).filter("buy OR sell").select("code", "trade_date", "buy_signal", "sell_signal"),
    S.with_(S.BARS, _NUM, _LAGS, S.sig(_ALLC),
            f"bb AS (SELECT g.code, g.trade_date, arg_max(CASE g.pattern WHEN 'CDLMARUBOZU' THEN 'CDLTAKURI' ELSE g.pattern END, {_RANK_B}) AS buy_signal "
            f"FROM sig g JOIN lags b ON b.code = g.code AND b.i = g.i WHERE g.value > 0 AND g.pattern IN {tuple(_CB)} AND b.i >= 3 AND {_case(_RULE2)} GROUP BY ALL)",
            f"ss AS (SELECT g.code, g.trade_date, arg_max(g.pattern, {_RANK_S}) AS sell_signal FROM sig g WHERE g.value < 0 AND g.pattern IN {tuple(dict.fromkeys(R.COMBO_SELLS))} GROUP BY ALL)")
    + "SELECT code, trade_date, buy_signal, sell_signal FROM bb FULL JOIN ss USING (code, trade_date)")
for _n in CAUTIOUS:
    add(f"rule_{_n[3:].lower()}", lambda s, d, n=_n: R.cautious_pattern(A.bars(s, d), n).filter("buy OR sell").select(*_FLAGS),
        S.with_(S.BARS, _NUM, _LAGS, S.sig([_n])) + "SELECT g.code, g.trade_date, g.value > 0 AS buy, g.value < 0 AS sell FROM sig g JOIN lags b ON b.code = g.code AND b.i = g.i "
        f"WHERE g.value < 0 OR (b.i >= 3 AND {_case(_RULE2)})")
for _side, _op, _order in (("buy", ">", DAILY_BUY_ORDER), ("sell", "<", DAILY_SELL_ORDER)):
    _rank = "CASE pattern " + " ".join(f"WHEN '{p}' THEN {i}" for i, p in enumerate(_order)) + " END"
    add(f"rule_last_match_{_side}", lambda s, d, side=_side: R.last_match_signal(A.bars(s, d), side),
        S.with_(S.BARS, S.sig(_order), f"m AS (SELECT code, trade_date, arg_max(pattern, {_rank}) AS pattern FROM sig WHERE value {_op} 0 GROUP BY ALL)")
        + f"SELECT code, trade_date, CASE pattern WHEN 'CDL2CROWS' THEN 'CDLADVANCEBLOCK' ELSE pattern END AS pattern, '{_side}' AS side FROM m")
    add(f"rule_pattern_side_{_side}", lambda s, d, side=_side: R.pattern_side_signal(A.bars(s, d), "CDLENGULFING", side),
        S.with_(S.BARS, S.sig(["CDLENGULFING"])) + f"SELECT code, trade_date, pattern, value FROM sig WHERE value {_op} 0")

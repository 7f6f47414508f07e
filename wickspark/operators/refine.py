"""Extra conditions on pattern signals (C1-C6), as text over `candles.frame()` columns.

The three cautious forms differ on purpose: by the bar they look at and by the length of the trend.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wickspark.functions.text import Sql
from wickspark.model import ALL_PATTERNS, CAUTIOUS, PATTERN_ALIAS
from wickspark.operators import candles
from wickspark.operators.candles import W

SMALL_BODY = "1.003D"   # body end over low
CALM = "1.015D"         # close over open


def _price(name: str, back: int, ahead: int) -> Sql:
    """Price `back` bars before the bar looked at, which itself is `ahead` bars after this row."""
    k = back - ahead
    if k >= 0:
        return Sql(f"_{name}{k}")
    column = {"o": "open", "h": "high", "l": "low", "c": "close"}[name]
    return Sql(f"lead({column}, {-k}) {W}")


def entry_rules(ahead: int = 0) -> dict[str, Sql]:
    """The rules at the entry bar (ahead=1 from a signal row); false within the first three bars."""
    def p(name: str, back: int) -> Sql:
        return _price(name, back, ahead)

    o, h, l, c = (lambda k, n=n: p(n, k) for n in "ohlc")
    ready = Sql(f"bar_idx + {ahead}") >= 3
    if ahead:
        ready = ready & Sql(f"lead(bar_idx, {ahead}) {W} IS NOT NULL")
    falling = (c(1) < o(1)) & (c(1) < c(2)) & (c(2) < c(3)) & (c(0) < c(1))
    rules = {
        "CDLSEPARATINGLINES": (c(2) > c(3)) & (c(0) > o(0)),
        "CDLTASUKIGAP": (o(1) > h(2)) & (l(1) > h(2)),
        "CDLINVERTEDHAMMER": Sql(f"IF({c(0) > o(0)}, {o(0)}, {c(0)})") / l(0) < Sql(SMALL_BODY),
        "CDLDRAGONFLYDOJI": falling,
        "CDLTAKURI": falling,
        "CDLMARUBOZU": (c(1) / o(1) < Sql(CALM)) & (c(2) / o(2) < Sql(CALM)),
    }
    return {name: ready & rule for name, rule in rules.items()}


def _hammer_low() -> Sql:
    c, o, l = Sql("_c0"), Sql("_o0"), Sql("_l0")
    return ((c > o) & (o / l < Sql(SMALL_BODY))) | ((c < o) & (c / l < Sql(SMALL_BODY)))


def signal_rules() -> dict[str, Sql]:
    """The rules at the signal bar; the inverted hammer needs a body."""
    rules = {n: Sql(str(r)) for n, r in entry_rules(0).items()}
    return {**rules, "CDLINVERTEDHAMMER": (Sql("bar_idx") >= 3) & _hammer_low()}


def extra_rules() -> dict[str, Sql]:
    """As C2, but four falling closes in a row for the two long-shadow dojis."""
    c = [Sql(f"_c{k}") for k in range(5)]
    falling = (c[1] < c[2]) & (c[2] < c[3]) & (c[3] < c[4]) & (c[0] < c[1])
    o, h, l = ({k: Sql(f"_{n}{k}") for k in range(4)} for n in "ohl")
    return {
        "CDLDRAGONFLYDOJI": falling,
        "CDLTAKURI": falling,
        "CDLSEPARATINGLINES": (c[2] > c[3]) & (c[0] > o[0]),
        "CDLTASUKIGAP": (o[1] > h[2]) & (l[1] > h[2]),
        "CDLINVERTEDHAMMER": _hammer_low(),
        "CDLMARUBOZU": (c[1] / o[1] < Sql(CALM)) & (c[2] / o[2] < Sql(CALM)),
    }


def _ruled(bars: DataFrame, names: Iterable[str], rules: dict[str, Sql], buy_only: bool = True) -> DataFrame:
    """Long signals that pass the rules; the sell side has none."""
    names = tuple(names)
    guarded = [n for n in names if n in rules]
    rows = candles.frame(bars).select(
        "code", "trade_date", "bar_idx", candles.values(names).alias("_values"),
        *[F.expr(str(rules[n])).alias(f"_ok_{n}") for n in guarded])
    long = candles.unpivot(rows, names, "code", "trade_date", "bar_idx", *[f"_ok_{n}" for n in guarded])
    if guarded:
        arms = " ".join(f"WHEN '{n}' THEN _ok_{n}" for n in guarded)
        free = "value < 0 OR " if buy_only else ""
        long = long.filter(f"{free}coalesce(CASE pattern {arms} ELSE true END, false)")
    return long.select("code", "trade_date", "bar_idx", "pattern", "value")


def cautious_at_entry(bars: DataFrame, names: Iterable[str] = CAUTIOUS) -> DataFrame:
    """Signals whose next bar passes the entry rule (both sides)."""
    return _ruled(bars, names, entry_rules(1), buy_only=False)


def cautious_at_signal(bars: DataFrame, names: Iterable[str] = ALL_PATTERNS) -> DataFrame:
    """Signals that pass at their own bar; sells are not tested."""
    return _ruled(bars, names, signal_rules())


def extra_check(bars: DataFrame, names: Iterable[str] = ALL_PATTERNS) -> DataFrame:
    """Signals that pass the longer-trend form; sells are not tested."""
    return _ruled(bars, names, extra_rules())


def any_triggered(bars: DataFrame, side: str, names: Iterable[str] = ALL_PATTERNS) -> DataFrame:
    """C4: the patterns of one side that fire on a bar after the extra check, by name."""
    names = tuple(sorted(names))
    rules = extra_rules() if side == "buy" else {}
    sign = ">" if side == "buy" else "<"
    cells = []
    for n in names:
        hit = f"CAST({candles.case((Sql('bar_idx') >= candles.PATTERNS[n][0], candles.PATTERNS[n][1]()))} AS INT) {sign} 0"
        if n in rules:
            hit = f"({hit}) AND {rules[n]}"
        cells.append(f"CASE WHEN {hit} THEN '{n}' END")
    rows = candles.frame(bars).selectExpr("code", "trade_date", f"array({', '.join(cells)}) AS _hit")
    return (rows.select("code", "trade_date", F.array_compact("_hit").alias("patterns"))
            .filter(F.size("patterns") > 0))


def up_hammer(bars: DataFrame) -> DataFrame:
    """Open of a hammer that closes or opens at its high, else 0."""
    rows = candles.frame(bars).select("code", "trade_date", "open", "high", "close",
                                      candles.pattern_value("CDLHAMMER").alias("_v"))
    at_top = "abs(1 - close / nullif(high, 0)) < 0.001D OR abs(1 - open / nullif(high, 0)) < 0.001D"
    return rows.selectExpr("code", "trade_date", f"IF(_v = 100 AND ({at_top}), open, 0D) AS hammer")


def alias_pattern(col: str = "pattern"):
    """The name a pattern is reported under."""
    out = F.col(col)
    for name, shown in PATTERN_ALIAS.items():
        out = F.when(F.col(col) == name, shown).otherwise(out)
    return out

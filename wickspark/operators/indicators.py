"""Indicators and window functions.

Window functions cannot be nested, so an indicator is a named column: `lines` adds plain rolling
columns, `lagged` shifts them, `cross` compares two of them.  All use the shared code window.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wickspark.functions.pick import pick_row
from wickspark.operators.candles import W, bar_index

OVER = "OVER (PARTITION BY code ORDER BY trade_date ROWS BETWEEN {a} AND {b})"


def _rolling(fn: str, col: str, n: int) -> str:
    """Rolling aggregate over n bars, null until there are n."""
    frame = OVER.format(a=f"{n - 1} PRECEDING", b="CURRENT ROW")
    return f"CASE WHEN bar_idx >= {n - 1} THEN {fn}({col}) {frame} END"


def sma(col: str, n: int) -> str:
    """W1"""
    return _rolling("avg", col, n)


def highest(col: str, n: int) -> str:
    """W2"""
    return _rolling("max", col, n)


def lowest(col: str, n: int) -> str:
    """W2"""
    return _rolling("min", col, n)


def true_range() -> str:
    """Null on the first bar, which has no previous close."""
    prev = f"lag(close, 1) {W}"
    return f"CASE WHEN bar_idx >= 1 THEN greatest(high - low, abs({prev} - high), abs({prev} - low)) END"


def lines(bars: DataFrame, **exprs: str) -> DataFrame:
    """Add rolling columns by name."""
    return bar_index(bars).selectExpr("*", *[f"{e} AS {name}" for name, e in exprs.items()])


def lagged(df: DataFrame, **cols: str) -> DataFrame:
    """Add columns shifted by one bar."""
    return df.selectExpr("*", *[f"lag({src}, 1) {W} AS {name}" for name, src in cols.items()])


def cross(df: DataFrame, **pairs: tuple[str, str]) -> DataFrame:
    """+1 where a rises above b, -1 where it falls below, else 0.

    The side it came from is the sign of the last non-zero difference before this bar, so touching
    without passing is no crossing."""
    back = OVER.format(a="UNBOUNDED PRECEDING", b="1 PRECEDING")
    was = df.selectExpr("*", *[f"last(nullif({a} - {b}, 0), true) {back} AS _was_{name}"
                               for name, (a, b) in pairs.items()])
    out = was.selectExpr("*", *[
        f"CASE WHEN _was_{name} < 0 AND {a} > {b} THEN 1 WHEN _was_{name} > 0 AND {a} < {b} THEN -1 ELSE 0 END AS {name}"
        for name, (a, b) in pairs.items()])
    return out.drop(*[f"_was_{name}" for name in pairs])


def atr(bars: DataFrame, n: int = 14) -> DataFrame:
    """True range and its simple mean over n bars."""
    tr = lines(bars, tr=true_range())
    frame = OVER.format(a=f"{n - 1} PRECEDING", b="CURRENT ROW")
    return tr.selectExpr("*", f"CASE WHEN bar_idx >= {n} THEN avg(tr) {frame} END AS atr")


def support_resistance(bars: DataFrame, n: int = 20, ratio: float = 0.005) -> DataFrame:
    """Rolling low and high, bands drawn inside them, breaks of the previous bar's band."""
    base = lines(bars, support=lowest("low", n), resistance=highest("high", n)).selectExpr(
        "*", f"support * (1 + {ratio}D) AS support_band", f"resistance * (1 - {ratio}D) AS resistance_band")
    base = lagged(base, _sup="support_band", _res="resistance_band")
    return base.selectExpr("code", "trade_date", "support", "support_band", "resistance", "resistance_band",
                           "coalesce(close > _res, false) AS bullish_break",
                           "coalesce(close < _sup, false) AS bearish_break",
                           "IF(close > _res, close, NULL) AS bullish_point",
                           "IF(close < _sup, close, NULL) AS bearish_point")


def ma_distance(bars: DataFrame, n: int, diff: float) -> DataFrame:
    """Close minus its mean, and whether it is just above it."""
    return lines(bars, ma=sma("close", n)).selectExpr(
        "code", "trade_date", "ma", "close - ma AS distance",
        f"coalesce(close - ma > 0 AND close - ma < close * {diff}D, false) AS near")


def pct_chg(bars: DataFrame, digits: int = 2, only_missing: bool = False) -> DataFrame:
    """Percent against the previous close; only_missing keeps a given `pct_chg` (4 digits for quotes)."""
    prev = bars.selectExpr("*", f"lag(close, 1) {W} AS _p")
    made = F.when(F.col("_p") > 0, F.round((F.col("close") - F.col("_p")) / F.col("_p") * 100, digits))
    if only_missing and "pct_chg" in bars.columns:
        made = F.coalesce(F.col("pct_chg"), made)
    return prev.withColumn("pct_chg", made).drop("_p")


def daily_return(values: DataFrame, col: str = "close") -> DataFrame:
    """W8"""
    return values.selectExpr("*", f"{col} / nullif(lag({col}, 1) {W}, 0) - 1 AS daily_return")


def drawdown(values: DataFrame, col: str = "close") -> DataFrame:
    """Running peak and percent below it; `max_drawdown` is the max per code."""
    run = OVER.format(a="UNBOUNDED PRECEDING", b="CURRENT ROW")
    peak = values.selectExpr("*", f"max({col}) {run} AS peak")
    return peak.selectExpr("*", f"(peak - {col}) / nullif(peak, 0) * 100 AS drawdown")


def max_drawdown(values: DataFrame, col: str = "close") -> DataFrame:
    """W9"""
    return drawdown(values, col).groupBy("code").agg(F.max("drawdown").alias("max_drawdown"))


def latest_row(bars: DataFrame) -> DataFrame:
    """The newest bar of each code, as an aggregate."""
    return pick_row(bars, ["code"], F.unix_date("trade_date"), F.max_by, unique=True)

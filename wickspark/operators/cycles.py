"""Rising, falling and flat market cycles from close prices."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wickspark.model import CYCLE_CLASSIFY, CYCLE_MIN_DAYS, CYCLE_REVERSAL, CYCLE_SUB_FACTOR
from wickspark.operators.candles import bar_index

_PIVOT = "struct<idx:int,d:date,price:double,kind:string>"


def _turns(thr: float) -> str:
    """Fold over date-sorted (idx, d, price) in `_s`: running extreme, direction, confirmed turns.

    direction 0 = not known yet; a bar may confirm a high and then, as the new low's own bar, never a
    low as well, because it is the extreme it would be measured against."""
    high = "named_struct('idx', acc.at.idx, 'd', acc.at.d, 'price', acc.at.price, 'kind', 'H')"
    low = "named_struct('idx', acc.at.idx, 'd', acc.at.d, 'price', acc.at.price, 'kind', 'L')"
    return f"""aggregate(slice(_s, 2, greatest(size(_s) - 1, 0)),
        named_struct('at', _s[0], 'dir', 0, 'turns', CAST(array() AS array<{_PIVOT}>)),
        (acc, x) -> CASE
            WHEN acc.dir >= 0 AND x.price > acc.at.price THEN named_struct('at', x, 'dir', 1, 'turns', acc.turns)
            WHEN acc.dir >= 0 AND x.price < acc.at.price * (1 - {thr}D) THEN
                named_struct('at', x, 'dir', -1, 'turns', concat(acc.turns, array({high})))
            WHEN acc.dir = -1 AND x.price < acc.at.price THEN named_struct('at', x, 'dir', -1, 'turns', acc.turns)
            WHEN acc.dir = -1 AND x.price > acc.at.price * (1 + {thr}D) THEN
                named_struct('at', x, 'dir', 1, 'turns', concat(acc.turns, array({low})))
            ELSE acc END)"""


def _series(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(
        F.col("bar_idx").alias("idx"), F.col("trade_date").alias("d"), F.col("close").alias("price")))).alias("_s"))


def zigzag_pivots(bars: DataFrame, thr: float = CYCLE_REVERSAL) -> DataFrame:
    """Confirmed turns, plus the running last extreme and the first bar; none under five bars."""
    runs = _series(bar_index(bars).select("code", "trade_date", "bar_idx", "close"), "code").filter("size(_s) >= 5")
    t = runs.selectExpr("code", "_s", f"{_turns(thr)} AS f")
    last = ("named_struct('idx', f.at.idx, 'd', f.at.d, 'price', f.at.price, 'kind', IF(f.dir = -1, 'L', 'H'))")
    t = t.selectExpr("code", "_s", f"IF(f.at.idx <> 0 AND (size(f.turns) = 0 OR try_element_at(f.turns, -1).idx <> f.at.idx), "
                             f"concat(f.turns, array({last})), f.turns) AS p")
    first = ("named_struct('idx', _s[0].idx, 'd', _s[0].d, 'price', _s[0].price, 'kind', "
             "IF(size(p) > 0 AND try_element_at(p, 1).kind = 'H', 'L', 'H'))")
    t = t.selectExpr("code", f"IF(size(p) = 0 OR try_element_at(p, 1).idx <> 0, concat(array({first}), p), p) AS p")
    return t.selectExpr("code", "posexplode(p) AS (pivot_no, v)").selectExpr(
        "code", "CAST(pivot_no AS INT) AS pivot_no", "v.idx AS bar_idx", "v.d AS trade_date", "v.price", "v.kind")


_NEXT = "OVER (PARTITION BY code ORDER BY pivot_no)"
_CHANGE = "IF(start_price > 0, round((end_price / start_price - 1) * 100, 2), 0D) AS change_pct"


def segments(pivots: DataFrame) -> DataFrame:
    """One row between neighbouring pivots."""
    df = pivots.selectExpr(
        "code", "pivot_no AS segment_no", "trade_date AS start", f"lead(trade_date) {_NEXT} AS end",
        "bar_idx AS start_idx", f"lead(bar_idx) {_NEXT} AS end_idx", "price AS start_price",
        f"lead(price) {_NEXT} AS end_price", f"concat(kind, '->', lead(kind) {_NEXT}) AS pivot_type")
    return df.filter("end_idx IS NOT NULL").selectExpr("*", "end_idx - start_idx AS days", _CHANGE)


def sub_segments(bars: DataFrame, segs: DataFrame, sub: float = CYCLE_CLASSIFY * CYCLE_SUB_FACTOR,
                 min_days: int = CYCLE_MIN_DAYS) -> DataFrame:
    """Z3: long, large segments cut again at smaller turns; the others pass unchanged.

    Neighbouring segments share their boundary bar.  A bar finds its segment by the last start at or
    before it, and a boundary bar is copied to the segment that ends on it; no range join."""
    large = f"abs(change_pct) >= {2 * sub * 100}D AND days >= {2 * min_days}"
    index = bar_index(bars).select("code", "trade_date", "bar_idx", "close")
    starts = segs.select("code", F.col("start_idx").alias("bar_idx"), F.struct(
        "segment_no", "start_idx", "end_idx", "pivot_type", F.expr(large).alias("large")).alias("_g"))
    here = "OVER (PARTITION BY code ORDER BY bar_idx ROWS BETWEEN UNBOUNDED PRECEDING AND {b})"
    tagged = index.join(starts, ["code", "bar_idx"], "left").selectExpr(
        "code", "trade_date", "bar_idx", "close", "_g AS _own",
        f"last(_g, true) {here.format(b='CURRENT ROW')} AS _in", f"last(_g, true) {here.format(b='1 PRECEDING')} AS _before")
    homes = "array(_in, IF(_before.end_idx = bar_idx, _before, NULL))"
    placed = (tagged.selectExpr("code", "trade_date", "bar_idx", "close", f"explode({homes}) AS g")
              .filter("g.large AND bar_idx BETWEEN g.start_idx AND g.end_idx"))
    runs = _series(placed.selectExpr("code", "g.segment_no", "g.pivot_type", "trade_date", "bar_idx", "close"),
                   "code", "segment_no", "pivot_type")
    ends = "named_struct('idx', {e}.idx, 'd', {e}.d, 'price', {e}.price, 'kind', '')"
    cut = runs.selectExpr("code", "segment_no", "pivot_type", "_s", f"{_turns(sub)}.turns AS t")
    cut = cut.selectExpr("code", "segment_no", "pivot_type", f"concat(array({ends.format(e='_s[0]')}), t) AS p",
                         f"{ends.format(e='element_at(_s, -1)')} AS z")
    cut = cut.selectExpr("code", "segment_no", "pivot_type", "IF(element_at(p, -1).idx <> z.idx, concat(p, array(z)), p) AS p")
    parts = (cut.selectExpr("code", "segment_no", "pivot_type", "p", "posexplode(p) AS (_k, a)")
             .selectExpr("code", "pivot_type", "a", "try_element_at(p, _k + 2) AS b").filter("b IS NOT NULL"))
    small = parts.selectExpr("code", "a.d AS start", "b.d AS end", "a.price AS start_price", "b.price AS end_price",
                             "pivot_type", "b.idx - a.idx AS days").selectExpr("*", _CHANGE)
    whole = segs.filter(f"NOT ({large})").select(small.columns)
    return whole.unionByName(small)


def classify_cycles(parts: DataFrame, min_days: int = CYCLE_MIN_DAYS, classify: float = CYCLE_CLASSIFY) -> DataFrame:
    """Parts that last long enough, as up / down / flat."""
    kind = f"CASE WHEN change_pct >= {classify * 100}D THEN 'up' WHEN change_pct <= {-classify * 100}D THEN 'down' ELSE 'flat' END"
    return parts.filter(F.col("days") >= min_days).selectExpr("*", f"{kind} AS type")


def market_cycles(bars: DataFrame, thr: float = CYCLE_REVERSAL, min_days: int = CYCLE_MIN_DAYS,
                  classify: float = CYCLE_CLASSIFY) -> DataFrame:
    """Z1-Z4 in one plan."""
    segs = segments(zigzag_pivots(bars, thr))
    return classify_cycles(sub_segments(bars, segs, classify * CYCLE_SUB_FACTOR, min_days), min_days, classify)

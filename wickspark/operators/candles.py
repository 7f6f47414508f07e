"""The 61 candlestick patterns as row expressions over one shared window.

`frame(bars)` adds the bars of the last six days and four rolling means as columns; everything
below it is plain arithmetic on one row.  Column names: `_o1` is the open one bar ago, `_c0` the
close of this bar.  Rolling means are over the bars *before* the bar they belong to.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wickspark.functions.text import Sql, call, case
from wickspark.model import ALL_PATTERNS

DEPTH = 4  # bars looked back by the longest pattern
_PRICES = {"_o": "open", "_h": "high", "_l": "low", "_c": "close"}
_SHAPE = ("_bd", "_tp", "_bt", "_up", "_lo", "_wh")
_MEANS = ("_ab", "_ar", "_as", "_a5")


# --- shared frame -----------------------------------------------------------------------------

OVER = "OVER (PARTITION BY code ORDER BY trade_date{rows})"
W = OVER.format(rows="")
TEN = OVER.format(rows=" ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING")
FIVE = OVER.format(rows=" ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING")
ALL = range(DEPTH + 1)
BAR_INDEX = f"CAST(row_number() {W} - 1 AS INT) AS bar_idx"


def bar_index(bars: DataFrame) -> DataFrame:
    """Position of the bar in its code's range, from 0; every look-back counts from it."""
    if "bar_idx" in bars.columns:
        return bars
    return bars.selectExpr("*", BAR_INDEX)


def frame(bars: DataFrame, extra: Iterable[str] = ()) -> DataFrame:
    """Bars + shapes, rolling means and facts of the last five bars, on one shared window.

    Everything that reads bars directly sits in the first window node, caller's `extra` window
    expressions included; only what reads another window's result needs a second and third one.

    The facts are stored as columns below the last window on purpose.  With all patterns asked for,
    the frame has more than 100 columns, and Spark then compiles the pattern projection as many
    small methods; as one fused loop it passes the 64 KB limit of a method and is interpreted.
    Columns no asked-for pattern uses are pruned, window expressions included.
    """
    shape = bars.selectExpr(
        "*", *[f"{src} AS {name}0" for name, src in _PRICES.items()],
        "abs(close - open) AS _bd0", "greatest(close, open) AS _tp0", "least(close, open) AS _bt0",
        "high - greatest(close, open) AS _up0", "least(close, open) - low AS _lo0",
        "close >= open AS _wh0", "high - low AS _sp0", "(high - low) - abs(close - open) AS _sh0")
    index = [] if "bar_idx" in bars.columns else [BAR_INDEX]
    first = shape.selectExpr(
        "*", *index, f"avg(_bd0) {TEN} AS _ab0", f"avg(_sp0) {TEN} AS _ar0", f"avg(_sh0) {TEN} AS _as0",
        f"avg(_sp0) {FIVE} AS _a50", *[f"lag({m}0, {k}) {W} AS {m}{k}" for m in (*_PRICES, *_SHAPE) for k in ALL[1:]], *extra)
    lagged = first.selectExpr("*", *[f"lag({m}0, {k}) {W} AS {m}{k}" for m in _MEANS for k in ALL[1:]])
    facts = lagged.selectExpr(
        "*",
        *[f"_bd{k} > _ab{k} AS _long{k}" for k in ALL],
        *[f"_bd{k} < _ab{k} AS _short{k}" for k in ALL[:-1]],
        *[f"_up{k} < {tiny(k)} AS _shaved_top{k}" for k in ALL[:-1]],
        *[f"_lo{k} < {tiny(k)} AS _shaved_low{k}" for k in ALL[:-1]],
        *[f"_bd{k} <= {tiny(k)} AS _doji{k}" for k in ALL[:3]],
        *[f"_bt{a} > _tp{b} AS _gap_up{a}{b}" for a, b in _GAPS],
        *[f"_tp{a} < _bt{b} AS _gap_dn{a}{b}" for a, b in _GAPS],
        *[f"_l{a} > _h{b} AS _clear_up{a}{b}" for a, b in _GAPS[:2]],
        *[f"_h{a} < _l{b} AS _clear_dn{a}{b}" for a, b in _GAPS[:2]],
        *[f"CASE WHEN _wh{k} THEN 1 ELSE -1 END AS _sg{k}" for k in ALL],
        *[f"_a5{k} * 0.2D AS _near{k}" for k in ALL[:-1]],
        *[f"_a5{k} * 0.6D AS _far{k}" for k in (1, 2)],
        *[f"_a5{k} * 0.05D AS _equal{k}" for k in (1, 2)],
        *[f"_as{k} / 2 AS _half{k}" for k in ALL[:3]],
        "_up0 > _bd0 AS _tall_top0", "_lo0 > _bd0 AS _tall_low0",
        f"{_hikkake_start()} AS _hk0", f"{_hikkake_mod_start()} AS _hm0")
    # Hikkake keeps a memory of up to three bars: the start flag of each of them.
    return facts.selectExpr("*", *[f"lag({m}0, {k}) {W} AS {m}{k}" for m in ("_hk", "_hm") for k in (1, 2, 3)])


_GAPS = ((0, 1), (1, 2), (0, 2), (3, 4))


# --- vocabulary -------------------------------------------------------------------------------

def o(k: int) -> Sql: return Sql(f"_o{k}")
def h(k: int) -> Sql: return Sql(f"_h{k}")
def l(k: int) -> Sql: return Sql(f"_l{k}")  # noqa: E743
def c(k: int) -> Sql: return Sql(f"_c{k}")


def body(k: int) -> Sql: return Sql(f"_bd{k}")
def top(k: int) -> Sql: return Sql(f"_tp{k}")
def bottom(k: int) -> Sql: return Sql(f"_bt{k}")
def upper(k: int) -> Sql: return Sql(f"_up{k}")
def lower(k: int) -> Sql: return Sql(f"_lo{k}")


def white(k: int) -> Sql: return Sql(f"_wh{k}")
def black(k: int) -> Sql: return ~Sql(f"_wh{k}")
def sign(k: int) -> Sql: return Sql(f"_sg{k}")


# Limits of bar k, each against the mean of the bars before it.
def long_body(k: int) -> Sql: return Sql(f"_long{k}")
def not_long(k: int) -> Sql: return ~Sql(f"_long{k}")
def short_body(k: int) -> Sql: return Sql(f"_short{k}")
def doji(k: int) -> Sql: return Sql(f"_doji{k}")
def no_upper(k: int) -> Sql: return Sql(f"_shaved_top{k}")
def no_lower(k: int) -> Sql: return Sql(f"_shaved_low{k}")
def tall_upper(k: int) -> Sql: return Sql(f"_tall_top{k}")
def tall_lower(k: int) -> Sql: return Sql(f"_tall_low{k}")
def tiny(k: int) -> Sql: return Sql(f"_ar{k}") * "0.1D"
def near(k: int) -> Sql: return Sql(f"_near{k}")
def far(k: int) -> Sql: return Sql(f"_far{k}")
def equal(k: int) -> Sql: return Sql(f"_equal{k}")
def short_shadow(k: int) -> Sql: return Sql(f"_half{k}")


def within(x: Sql, mid: Sql, tol: Sql) -> Sql:
    return (x >= mid - tol) & (x <= mid + tol)


def gap_up(a: int, b: int) -> Sql: return Sql(f"_gap_up{a}{b}")
def gap_down(a: int, b: int) -> Sql: return Sql(f"_gap_dn{a}{b}")
def clear_up(a: int, b: int) -> Sql: return Sql(f"_clear_up{a}{b}")
def clear_down(a: int, b: int) -> Sql: return Sql(f"_clear_dn{a}{b}")


def every(*conds: Sql) -> Sql: return reduce(lambda a, b: a & b, conds)
def either(*conds: Sql) -> Sql: return reduce(lambda a, b: a | b, conds)


# --- patterns ---------------------------------------------------------------------------------
# name -> (first bar index that may be non-zero, condition, value)

def _plain(cond: Sql, value: int) -> Sql:
    return case((cond, value))


def _signed(cond: Sql, direction: Sql, size: int = 100) -> Sql:
    return case((cond, direction * size))


def two_crows():
    return _plain(every(white(2), long_body(2), black(1), gap_up(1, 2), black(0),
                        o(0) < o(1), o(0) > c(1), c(0) > o(2), c(0) < c(2)), -100)


def three_black_crows():
    return _plain(every(white(3), black(2), black(1), black(0),
                        *[no_lower(k) for k in (2, 1, 0)],
                        o(1) < o(2), o(1) > c(2), o(0) < o(1), o(0) > c(1),
                        h(3) > c(2), c(2) > c(1), c(1) > c(0)), -100)


def three_inside():
    turn = either(every(white(2), black(0), c(0) < o(2)), every(black(2), white(0), c(0) > o(2)))
    return _signed(every(long_body(2), not_long(1), top(1) < top(2), bottom(1) > bottom(2), turn),
                   -sign(2))


def three_line_strike():
    same = (sign(3) == sign(2)) & (sign(2) == sign(1)) & (sign(0) == -sign(1))
    inside = every(o(2) >= bottom(3) - near(3), o(2) <= top(3) + near(3),
                   o(1) >= bottom(2) - near(2), o(1) <= top(2) + near(2))
    run = either(every(white(1), c(1) > c(2), c(2) > c(3), o(0) > c(1), c(0) < o(3)),
                 every(black(1), c(1) < c(2), c(2) < c(3), o(0) < c(1), c(0) > o(3)))
    return _signed(every(same, inside, run), sign(1))


def three_outside():
    return _signed(either(every(white(1), black(2), c(1) > o(2), o(1) < c(2), c(0) > c(1)),
                          every(black(1), white(2), o(1) > c(2), c(1) < o(2), c(0) < c(1))), sign(1))


def three_stars_in_south():
    return _plain(every(black(2), black(1), black(0), long_body(2), lower(2) > body(2),
                        body(1) < body(2), o(1) > c(2), o(1) <= h(2), l(1) < c(2), l(1) >= l(2),
                        lower(1) > tiny(1), short_body(0), no_lower(0), no_upper(0),
                        l(0) > l(1), h(0) < h(1)), 100)


def three_white_soldiers():
    return _plain(every(white(2), white(1), white(0), *[no_upper(k) for k in (2, 1, 0)],
                        c(0) > c(1), c(1) > c(2), o(1) > o(2), o(1) <= c(2) + near(2),
                        o(0) > o(1), o(0) <= c(1) + near(1), body(1) > body(2) - far(2),
                        body(0) > body(1) - far(1), long_body(0)), 100)


def abandoned_baby():
    fall = every(white(2), black(0), c(0) < c(2) - body(2) * "0.3D", clear_up(1, 2), clear_down(0, 1))
    rise = every(black(2), white(0), c(0) > c(2) + body(2) * "0.3D", clear_down(1, 2), clear_up(0, 1))
    return _signed(every(long_body(2), doji(1), long_body(0), either(fall, rise)), sign(0))


def advance_block():
    weaker = either(every(body(1) < body(2) - far(2), body(0) < body(1) + near(1)),
                    body(0) < body(1) - far(1),
                    every(body(0) < body(1), body(1) < body(2),
                          either(upper(0) > short_shadow(0), upper(1) > short_shadow(1))),
                    every(body(0) < body(1), tall_upper(0)))
    return _plain(every(white(2), white(1), white(0), c(0) > c(1), c(1) > c(2),
                        o(1) > o(2), o(1) <= c(2) + near(2), o(0) > o(1), o(0) <= c(1) + near(1),
                        long_body(2), upper(2) < short_shadow(2), weaker), -100)


def belt_hold():
    return _signed(every(long_body(0), either(every(white(0), no_lower(0)),
                                              every(black(0), no_upper(0)))), sign(0))


def breakaway():
    same = (sign(4) == sign(3)) & (sign(3) == sign(1)) & (sign(1) == -sign(0))
    fall = every(black(4), gap_down(3, 4), h(2) < h(3), l(2) < l(3), h(1) < h(2), l(1) < l(2),
                 c(0) > o(3), c(0) < c(4))
    rise = every(white(4), gap_up(3, 4), h(2) > h(3), l(2) > l(3), h(1) > h(2), l(1) > l(2),
                 c(0) < o(3), c(0) > c(4))
    return _signed(every(long_body(4), same, either(fall, rise)), sign(0))


def closing_marubozu():
    return _signed(every(long_body(0), either(every(white(0), no_upper(0)),
                                              every(black(0), no_lower(0)))), sign(0))


def concealing_baby_swallow():
    return _plain(every(*[black(k) for k in (3, 2, 1, 0)],
                        *[no_upper(k) for k in (3, 2)], *[no_lower(k) for k in (3, 2)],
                        gap_down(1, 2), upper(1) > tiny(1), h(1) > c(2), h(0) > h(1), l(0) < l(1)), 100)


def counterattack():
    return _signed(every(sign(1) == -sign(0), long_body(1), long_body(0),
                         within(c(0), c(1), equal(1))), sign(0))


def dark_cloud_cover():
    return _plain(every(white(1), long_body(1), black(0), o(0) > h(1), c(0) > o(1),
                        c(0) < c(1) - body(1) * "0.5D"), -100)


def doji_bar():
    return _plain(doji(0), 100)


def doji_star():
    return _signed(every(long_body(1), doji(0), either(every(white(1), gap_up(0, 1)),
                                                       every(black(1), gap_down(0, 1)))), -sign(1))


def dragonfly_doji():
    return _plain(every(doji(0), no_upper(0), lower(0) > tiny(0)), 100)


def engulfing():
    rise = every(white(0), black(1), either(every(c(0) >= o(1), o(0) < c(1)),
                                            every(c(0) > o(1), o(0) <= c(1))))
    fall = every(black(0), white(1), either(every(o(0) >= c(1), c(0) < o(1)),
                                            every(o(0) > c(1), c(0) <= o(1))))
    touch = either(o(0) == c(1), c(0) == o(1))
    return case((either(rise, fall), sign(0) * case((touch, 80), other=100)))


def _evening(middle: Sql):
    return _plain(every(long_body(2), white(2), middle, gap_up(1, 2), long_body(0), black(0),
                        c(0) < c(2) - body(2) * "0.3D"), -100)


def gap_side_by_side_white():
    up = every(gap_up(1, 2), gap_up(0, 2))
    down = every(gap_down(1, 2), gap_down(0, 2))
    return _signed(every(either(up, down), white(1), white(0), within(body(0), body(1), near(1)),
                         within(o(0), o(1), equal(1))), case((gap_up(1, 2), 1), other=-1))


def gravestone_doji():
    return _plain(every(doji(0), no_lower(0), upper(0) > tiny(0)), 100)


def _hammer_shape():
    return every(short_body(0), tall_lower(0), no_upper(0))


def _harami(small: Sql):
    held = every(long_body(1), small, top(0) <= top(1), bottom(0) >= bottom(1))
    strict = every(top(0) < top(1), bottom(0) > bottom(1))
    return case((held, -sign(1) * case((strict, 100), other=80)))


def high_wave():
    return _signed(every(short_body(0), upper(0) > body(0) * 2, lower(0) > body(0) * 2), sign(0))


def _hikkake_start():
    inside = every(h(1) < h(2), l(1) > l(2))
    out = case((every(inside, h(0) < h(1), l(0) < l(1)), 1),
               (every(inside, h(0) > h(1), l(0) > l(1)), -1))
    return case((Sql("bar_idx") >= 2, out))


def _hikkake_mod_start():
    limit = Sql("_a52") * "0.2D"
    nested = every(h(2) < h(3), l(2) > l(3), h(1) < h(2), l(1) > l(2))
    out = case((every(nested, h(0) < h(1), l(0) < l(1), c(2) <= l(2) + limit), 1),
               (every(nested, h(0) > h(1), l(0) > l(1), c(2) >= h(2) - limit), -1))
    return case((Sql("bar_idx") >= 7, out))


def _hikkake_value(memory: str):
    """Start now, else the first confirmation within three bars of the last start."""
    now = Sql(f"{memory}0")
    start = [Sql(f"{memory}{k}") for k in (1, 2, 3)]

    def passes(direction: Sql, close_k: int, start_k: int) -> Sql:
        return (((direction == 1) & (c(close_k) > h(start_k + 1)))
                | ((direction == -1) & (c(close_k) < l(start_k + 1))))

    def confirmed(k: int) -> Sql:
        d = start[k - 1]
        earlier = [~call("coalesce", passes(d, j, k), "false") for j in range(1, k)]
        return every(passes(d, 0, k), *earlier)

    follow = [(start[k - 1] != 0, case((confirmed(k), start[k - 1] * 200))) for k in (1, 2, 3)]
    return case((now != 0, now * 100), *follow)


def homing_pigeon():
    return _plain(every(black(1), black(0), long_body(1), not_long(0), o(0) < o(1), c(0) > c(1)), 100)


def identical_three_crows():
    return _plain(every(*[black(k) for k in (2, 1, 0)], *[no_lower(k) for k in (2, 1, 0)],
                        c(2) > c(1), c(1) > c(0), within(o(1), c(2), equal(2)),
                        within(o(0), c(1), equal(1))), -100)


def in_neck():
    return _plain(every(black(1), long_body(1), white(0), o(0) < l(1), c(0) >= c(1),
                        c(0) <= c(1) + equal(1)), -100)


def inverted_hammer():
    return _plain(every(short_body(0), tall_upper(0), no_lower(0), gap_down(0, 1)), 100)


def _kick():
    shaved = [cond for k in (1, 0) for cond in (long_body(k), no_upper(k), no_lower(k))]
    return every(sign(1) == -sign(0), *shaved, either(every(black(1), clear_up(0, 1)),
                                                      every(white(1), clear_down(0, 1))))


def ladder_bottom():
    return _plain(every(*[black(k) for k in (4, 3, 2, 1)], o(4) > o(3), o(3) > o(2), c(4) > c(3),
                        c(3) > c(2), upper(1) > tiny(1), white(0), o(0) > o(1), c(0) > h(1)), 100)


def long_legged_doji():
    return _plain(every(doji(0), either(tall_lower(0), tall_upper(0))), 100)


def long_line():
    return _signed(every(long_body(0), upper(0) < short_shadow(0), lower(0) < short_shadow(0)), sign(0))


def marubozu():
    return _signed(every(long_body(0), no_upper(0), no_lower(0)), sign(0))


def matching_low():
    return _plain(every(black(1), black(0), within(c(0), c(1), equal(1))), 100)


def mat_hold():
    floor = c(4) - body(4) * "0.5D"
    return _plain(every(long_body(4), *[short_body(k) for k in (3, 2, 1)], white(4), black(3), white(0),
                        gap_up(3, 4), bottom(2) < c(4), bottom(1) < c(4), bottom(2) > floor,
                        bottom(1) > floor, top(2) < o(3), top(1) < top(2), o(0) > c(1),
                        c(0) > call("greatest", h(3), h(2), h(1))), 100)


def _morning(middle: Sql):
    return _plain(every(long_body(2), black(2), middle, gap_down(1, 2), long_body(0), white(0),
                        c(0) > c(2) + body(2) * "0.3D"), 100)


def on_neck():
    return _plain(every(black(1), long_body(1), white(0), o(0) < l(1), within(c(0), l(1), equal(1))), -100)


def piercing():
    return _plain(every(black(1), long_body(1), white(0), long_body(0), o(0) < l(1), c(0) < o(1),
                        c(0) > c(1) + body(1) * "0.5D"), 100)


def rickshaw_man():
    middle = l(0) + (h(0) - l(0)) / 2
    return _plain(every(doji(0), tall_lower(0), tall_upper(0), bottom(0) <= middle + near(0),
                        top(0) >= middle - near(0)), 100)


def rise_fall_three_methods():
    s = sign(4)
    return _signed(every(long_body(4), *[short_body(k) for k in (3, 2, 1)], long_body(0),
                         sign(4) == -sign(3), sign(3) == sign(2), sign(2) == sign(1), sign(1) == -sign(0),
                         *[cond for k in (3, 2, 1) for cond in (bottom(k) < h(4), top(k) > l(4))],
                         c(2) * s < c(3) * s, c(1) * s < c(2) * s, o(0) * s > c(1) * s,
                         c(0) * s > c(4) * s), s)


def separating_lines():
    return _signed(every(sign(1) == -sign(0), within(o(0), o(1), equal(1)), long_body(0),
                         either(every(white(0), no_lower(0)),
                                every(black(0), no_upper(0)))), sign(0))


def shooting_star():
    return _plain(every(short_body(0), tall_upper(0), no_lower(0), gap_up(0, 1)), -100)


def short_line():
    return _signed(every(short_body(0), upper(0) < short_shadow(0), lower(0) < short_shadow(0)), sign(0))


def spinning_top():
    return _signed(every(short_body(0), tall_upper(0), tall_lower(0)), sign(0))


def stalled():
    return _plain(every(white(2), white(1), white(0), c(0) > c(1), c(1) > c(2), long_body(2), long_body(1),
                        no_upper(1), o(1) > o(2), o(1) <= c(2) + near(2), short_body(0),
                        o(0) >= c(1) - body(0) - near(1)), -100)


def stick_sandwich():
    return _plain(every(black(2), white(1), black(0), l(1) > c(2), within(c(0), c(2), equal(2))), 100)


def takuri():
    return _plain(every(doji(0), no_upper(0), lower(0) > body(0) * 2), 100)


def tasuki_gap():
    alike = call("abs", body(1) - body(0)) < near(1)
    up = every(gap_up(1, 2), white(1), black(0), o(0) < c(1), o(0) > o(1), c(0) < o(1), c(0) > top(2))
    down = every(gap_down(1, 2), black(1), white(0), o(0) < o(1), o(0) > c(1), c(0) > o(1), c(0) < bottom(2))
    return _signed(every(either(up, down), alike), sign(1))


def thrusting():
    return _plain(every(black(1), long_body(1), white(0), o(0) < l(1), c(0) > c(1) + equal(1),
                        c(0) <= c(1) + body(1) * "0.5D"), -100)


def tristar():
    small = every(*[body(k) <= tiny(2) for k in (2, 1, 0)])
    out = case((every(gap_up(1, 2), top(0) < top(1)), -100), (every(gap_down(1, 2), bottom(0) > bottom(1)), 100))
    return case((small, out))


def unique_three_river():
    return _plain(every(long_body(2), black(2), black(1), c(1) > c(2), o(1) <= o(2), l(1) < l(2),
                        short_body(0), o(0) > l(1), white(0)), 100)


def upside_gap_two_crows():
    return _plain(every(white(2), long_body(2), black(1), not_long(1), gap_up(1, 2), black(0),
                        o(0) > o(1), c(0) < c(1), c(0) > c(2)), -100)


def side_gap_three_methods():
    fill = every(sign(2) == sign(1), sign(1) == -sign(0), o(0) < top(1), o(0) > bottom(1),
                 c(0) < top(2), c(0) > bottom(2))
    return _signed(every(fill, either(every(white(2), gap_up(1, 2)),
                                      every(black(2), gap_down(1, 2)))), sign(2))


PATTERNS: dict[str, tuple[int, Callable[[], Sql]]] = {
    "CDL2CROWS": (12, two_crows),
    "CDL3BLACKCROWS": (13, three_black_crows),
    "CDL3INSIDE": (12, three_inside),
    "CDL3LINESTRIKE": (8, three_line_strike),
    "CDL3OUTSIDE": (3, three_outside),
    "CDL3STARSINSOUTH": (12, three_stars_in_south),
    "CDL3WHITESOLDIERS": (12, three_white_soldiers),
    "CDLABANDONEDBABY": (12, abandoned_baby),
    "CDLADVANCEBLOCK": (12, advance_block),
    "CDLBELTHOLD": (10, belt_hold),
    "CDLBREAKAWAY": (14, breakaway),
    "CDLCLOSINGMARUBOZU": (10, closing_marubozu),
    "CDLCONCEALBABYSWALL": (13, concealing_baby_swallow),
    "CDLCOUNTERATTACK": (11, counterattack),
    "CDLDARKCLOUDCOVER": (11, dark_cloud_cover),
    "CDLDOJI": (10, doji_bar),
    "CDLDOJISTAR": (11, doji_star),
    "CDLDRAGONFLYDOJI": (10, dragonfly_doji),
    "CDLENGULFING": (2, engulfing),
    "CDLEVENINGDOJISTAR": (12, lambda: _evening(doji(1))),
    "CDLEVENINGSTAR": (12, lambda: _evening(not_long(1))),
    "CDLGAPSIDESIDEWHITE": (7, gap_side_by_side_white),
    "CDLGRAVESTONEDOJI": (10, gravestone_doji),
    "CDLHAMMER": (11, lambda: _plain(every(_hammer_shape(), bottom(0) <= l(1) + near(1)), 100)),
    "CDLHANGINGMAN": (11, lambda: _plain(every(_hammer_shape(), bottom(0) >= h(1) - near(1)), -100)),
    "CDLHARAMI": (11, lambda: _harami(not_long(0))),
    "CDLHARAMICROSS": (11, lambda: _harami(doji(0))),
    "CDLHIGHWAVE": (10, high_wave),
    "CDLHIKKAKE": (5, lambda: _hikkake_value("_hk")),
    "CDLHIKKAKEMOD": (10, lambda: _hikkake_value("_hm")),
    "CDLHOMINGPIGEON": (11, homing_pigeon),
    "CDLIDENTICAL3CROWS": (12, identical_three_crows),
    "CDLINNECK": (11, in_neck),
    "CDLINVERTEDHAMMER": (11, inverted_hammer),
    "CDLKICKING": (11, lambda: _signed(_kick(), sign(0))),
    "CDLKICKINGBYLENGTH": (11, lambda: _signed(
        _kick(), case((body(0) > body(1), sign(0)), other=sign(1)))),
    "CDLLADDERBOTTOM": (14, ladder_bottom),
    "CDLLONGLEGGEDDOJI": (10, long_legged_doji),
    "CDLLONGLINE": (10, long_line),
    "CDLMARUBOZU": (10, marubozu),
    "CDLMATCHINGLOW": (6, matching_low),
    "CDLMATHOLD": (14, mat_hold),
    "CDLMORNINGDOJISTAR": (12, lambda: _morning(doji(1))),
    "CDLMORNINGSTAR": (12, lambda: _morning(not_long(1))),
    "CDLONNECK": (11, on_neck),
    "CDLPIERCING": (11, piercing),
    "CDLRICKSHAWMAN": (10, rickshaw_man),
    "CDLRISEFALL3METHODS": (14, rise_fall_three_methods),
    "CDLSEPARATINGLINES": (11, separating_lines),
    "CDLSHOOTINGSTAR": (11, shooting_star),
    "CDLSHORTLINE": (10, short_line),
    "CDLSPINNINGTOP": (10, spinning_top),
    "CDLSTALLEDPATTERN": (12, stalled),
    "CDLSTICKSANDWICH": (7, stick_sandwich),
    "CDLTAKURI": (10, takuri),
    "CDLTASUKIGAP": (7, tasuki_gap),
    "CDLTHRUSTING": (11, thrusting),
    "CDLTRISTAR": (12, tristar),
    "CDLUNIQUE3RIVER": (12, unique_three_river),
    "CDLUPSIDEGAP2CROWS": (12, upside_gap_two_crows),
    "CDLXSIDEGAP3METHODS": (2, side_gap_three_methods),
}


def pattern_value(name: str) -> Column:
    """Value of one pattern on a `frame()` row: 0, +-80, +-100 or +-200."""
    first, build = PATTERNS[name]
    gated = case((Sql("bar_idx") >= first, build()))
    return F.expr(f"CAST({gated} AS INT)").alias(name)


# --- operators --------------------------------------------------------------------------------

def patterns(bars: DataFrame, names: Iterable[str] | None = None) -> DataFrame:
    """Bars + bar_idx + one int column per pattern."""
    names = tuple(names or ALL_PATTERNS)
    keep = bars.columns + (["bar_idx"] if "bar_idx" not in bars.columns else [])
    return frame(bars).select(*keep, *[pattern_value(n) for n in names])


def values(names: Iterable[str]) -> Column:
    """Array of the pattern values of a `frame()` row, in list order."""
    return F.array(*[pattern_value(n) for n in names])


def signals(bars: DataFrame, names: Iterable[str] | None = None) -> DataFrame:
    """Long form (code, trade_date, bar_idx, pattern, value), non-zero values only."""
    names = tuple(names or ALL_PATTERNS)
    rows = frame(bars).select("code", "trade_date", "bar_idx", values(names).alias("_values"))
    return unpivot(rows, names, "code", "trade_date", "bar_idx")


def unpivot(rows: DataFrame, names: Iterable[str], *keep: str) -> DataFrame:
    """`_values` array -> one row per pattern that fired."""
    names = tuple(names)
    long = rows.select(*keep, F.posexplode_outer("_values").alias("_at", "value")).filter("value != 0")
    label = F.element_at(F.array(*map(F.lit, names)), F.col("_at") + 1)
    return long.select(*keep, label.alias("pattern"), "value")

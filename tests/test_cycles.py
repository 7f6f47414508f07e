"""Market cycles against a plain loop."""

from tests.series import random_bars
from wickspark.operators import cycles as Z


def turns(closes, thr):
    """Positions and kinds of confirmed turns, with the last running extreme."""
    at, way, out = 0, 0, []
    for i in range(1, len(closes)):
        x = closes[i]
        if way >= 0:
            if x > closes[at]:
                at, way = i, 1
            elif x < closes[at] * (1 - thr):
                out.append((at, "H"))
                at, way = i, -1
        elif x < closes[at]:
            at = i
        elif x > closes[at] * (1 + thr):
            out.append((at, "L"))
            at, way = i, 1
    return out, at, way


def pivots(closes, thr):
    if len(closes) < 5:
        return []
    out, at, way = turns(closes, thr)
    if at != 0 and (not out or out[-1][0] != at):
        out = out + [(at, "L" if way == -1 else "H")]
    if not out or out[0][0] != 0:
        out = [(0, "L" if out and out[0][1] == "H" else "H")] + out
    return out


def parts(closes, min_days):
    out = []
    p = pivots(closes, 0.08)
    for (a, _), (b, _) in zip(p, p[1:]):
        chg = round((closes[b] / closes[a] - 1) * 100, 2)
        if abs(chg) < 6 or b - a < 2 * min_days:
            out.append((a, b, chg))
            continue
        inner = [0] + [i for i, _ in turns(closes[a:b + 1], 0.03)[0]]
        if inner[-1] != b - a:
            inner.append(b - a)
        out += [(a + i, a + j, round((closes[a + j] / closes[a + i] - 1) * 100, 2)) for i, j in zip(inner, inner[1:])]
    return sorted(out)


def test_pivots_and_cycles(spark):
    data = random_bars(40, 200, 5, step=0.25)
    bars = spark.createDataFrame(data)
    got = Z.zigzag_pivots(bars).orderBy("code", "pivot_no").toPandas()
    sub = Z.sub_segments(bars, Z.segments(Z.zigzag_pivots(bars)), min_days=4).toPandas()
    kinds = Z.market_cycles(bars, min_days=4).toPandas()
    for code, g in data.groupby("code"):
        closes = g.close.tolist()
        mine = got[got.code == code]
        assert list(zip(mine.bar_idx, mine.kind)) == pivots(closes, 0.08)
        day = {d: i for i, d in enumerate(g.trade_date)}
        s = sub[sub.code == code]
        assert sorted((day[a], day[b]) for a, b in zip(s.start, s.end)) == [(a, b) for a, b, _ in parts(closes, 4)]
        want = sorted((a, "up" if c >= 5 else "down" if c <= -5 else "flat") for a, b, c in parts(closes, 4) if b - a >= 4)
        k = kinds[kinds.code == code]
        assert sorted((day[a], t) for a, t in zip(k.start, k.type)) == want


def test_short_series_has_no_pivots(spark):
    data = random_bars(1, 200, 5).head(4)
    assert Z.zigzag_pivots(spark.createDataFrame(data)).count() == 0

"""Building blocks of the DuckDB statements the Spark results are compared with.

Written from the rules, not from the library: patterns are spelled on numbered columns, trades are
picked by a recursive walk, equity is rebuilt bar by bar.
"""

from __future__ import annotations

from wickspark.adapters import PREFIXES, SUFFIXES
from wickspark.model import ALL_PATTERNS, OVERSEAS_INDEXES, PATTERN_NAMES


def _list(xs) -> str:
    return "[" + ", ".join(f"'{x}'" for x in xs) + "]"


def code_of(k: str) -> str:
    n = len(PREFIXES)
    digits = f"CASE WHEN length({k}::VARCHAR) < 3 THEN lpad({k}::VARCHAR, 3, '0') ELSE {k}::VARCHAR END"
    return (f"CASE WHEN {k} < 5 THEN list_extract({_list(OVERSEAS_INDEXES)}, ({k} + 1)::BIGINT) ELSE "
            f"list_extract({_list(PREFIXES)}, ({k} % {n} + 1)::BIGINT) || {digits} || "
            f"list_extract({_list(SUFFIXES)}, ({k} % {n} + 1)::BIGINT) END")


_TICKS = """ticks AS (
  SELECT l_suppkey AS k, l_returnflag AS source, CAST(date_trunc('week', l_shipdate) AS DATE) AS trade_date,
         100::DOUBLE + (l_extendedprice / l_quantity) % 10 AS price, l_quantity AS qty,
         l_shipdate, l_orderkey, l_linenumber, l_partkey FROM lineitem)"""
_AGG = """first(price ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey) AS open, max(price) AS high,
         min(price) AS low, last(price ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey) AS close, sum(qty) AS vol"""
BARS = f"""{_TICKS},
rolled AS (SELECT k, trade_date, {_AGG} FROM ticks GROUP BY k, trade_date),
bars AS (SELECT {code_of('k')} AS code, trade_date, open, high, low, close, vol FROM rolled)"""
SOURCES = f"""{_TICKS},
rolled AS (SELECT k, trade_date, source, {_AGG} FROM ticks GROUP BY k, trade_date, source),
srcs AS (SELECT {code_of('k')} AS code, trade_date, open, high, low, close, vol, source,
         CASE source WHEN 'A' THEN 1 WHEN 'N' THEN 2 ELSE 3 END AS priority FROM rolled)"""


def board_of(c: str = "code") -> str:
    return (f"CASE WHEN {c} IN ('DJI','FCHI','SPX','N225','GDAXI') THEN 'index' WHEN {c} LIKE '%.BJ' THEN 'excluded' "
            f"WHEN {c} LIKE '%.SH' AND ({c} LIKE '000%' OR {c} LIKE '880%') THEN 'index' "
            f"WHEN {c} LIKE '%.SZ' AND {c} LIKE '399%' THEN 'index' "
            f"WHEN {c} LIKE '%.SZ' AND ({c} LIKE '300%' OR {c} LIKE '301%') THEN 'cy' "
            f"WHEN {c} LIKE '%.SH' AND {c} LIKE '688%' THEN 'kc' "
            f"WHEN (({c} LIKE '5%' AND {c} LIKE '%.SH') OR ({c} LIKE '15%' AND {c} LIKE '%.SZ')) AND left({c}, 3) IN "
            f"('510','511','512','513','515','516','518','520','561','562','563','588','159') THEN 'etf' "
            f"WHEN {c} LIKE '%.SH' OR {c} LIKE '%.SZ' THEN 'hs' ELSE 'index' END")


UNIVERSE = f"""u0 AS (SELECT {code_of('s_suppkey')} AS code, s_name AS name, n_name AS area, r_name AS region,
         s_acctbal AS total_mv, s_suppkey AS key FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey
         LEFT JOIN region ON n_regionkey = r_regionkey),
universe AS (SELECT *, {board_of()} AS board FROM u0)"""


def short_index(c: str = "code") -> str:
    return f"(length({c}) < 9 OR {c} IN ('000300.SH','399006.SZ'))"


def group_of(c: str = "code") -> str:
    return f"CASE WHEN {short_index(c)} THEN 'index' WHEN left({c}, 2) IN ('15','16','51') THEN 'etf' ELSE 'stock' END"


def cn(p: str = "pattern") -> str:
    return f"CASE {p} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in PATTERN_NAMES.items()) + f" ELSE {p} END"


# --- patterns -----------------------------------------------------------------------------------

W = "PARTITION BY code ORDER BY trade_date"


def px(src: str = "bars") -> str:
    lag = ", ".join(f"lag({f}, {k}) OVER ({W}) AS {f[0]}{k}" for k in range(1, 6) for f in ("open", "high", "low", "close"))
    lag += ", lag(high, 6) OVER ({w}) AS h6, lag(low, 6) OVER ({w}) AS l6".format(w=W)
    now = "open AS o0, high AS h0, low AS l0, close AS c0"
    avg = []
    for k in range(5):
        ten = f"OVER ({W} ROWS BETWEEN {10 + k} PRECEDING AND {1 + k} PRECEDING)"
        five = f"OVER ({W} ROWS BETWEEN {5 + k} PRECEDING AND {1 + k} PRECEDING)"
        avg += [f"avg(abs(close - open)) {ten} AS ab{k}", f"avg(high - low) {ten} AS ar{k}",
                f"avg((high - low) - abs(close - open)) {ten} AS as{k}", f"avg(high - low) {five} AS a5{k}"]
    shape = []
    for k in range(5):
        shape += [f"abs(c{k} - o{k}) AS b{k}", f"greatest(c{k}, o{k}) AS x{k}", f"least(c{k}, o{k}) AS n{k}",
                  f"h{k} - greatest(c{k}, o{k}) AS u{k}", f"least(c{k}, o{k}) - l{k} AS d{k}",
                  f"CASE WHEN c{k} >= o{k} THEN 1 WHEN c{k} < o{k} THEN -1 END AS s{k}"]
    return (f"px0 AS (SELECT code, trade_date, vol, row_number() OVER ({W}) - 1 AS i, {now}, {lag}, {', '.join(avg)} FROM {src}),\n"
            f"px AS (SELECT *, {', '.join(shape)} FROM px0)")


def _gu(a, b): return f"n{a} > x{b}"
def _gd(a, b): return f"x{a} < n{b}"
def _Gu(a, b): return f"l{a} > h{b}"
def _Gd(a, b): return f"h{a} < l{b}"


P: dict[str, tuple[int, str, str]] = {
    "CDL2CROWS": (12, f"s2=1 AND b2>ab2 AND s1=-1 AND {_gu(1,2)} AND s0=-1 AND o0<o1 AND o0>c1 AND c0>o2 AND c0<c2", "-100"),
    "CDL3BLACKCROWS": (13, "s3=1 AND s2=-1 AND s1=-1 AND s0=-1 AND d2<0.1*ar2 AND d1<0.1*ar1 AND d0<0.1*ar0 AND o1>c2 AND o1<o2 AND o0>c1 AND o0<o1 AND h3>c2 AND c2>c1 AND c1>c0", "-100"),
    "CDL3INSIDE": (12, "b2>ab2 AND b1<=ab1 AND x1<x2 AND n1>n2 AND ((s2=1 AND s0=-1 AND c0<o2) OR (s2=-1 AND s0=1 AND c0>o2))", "-100*s2"),
    "CDL3LINESTRIKE": (8, "s3=s2 AND s2=s1 AND s0=-s1 AND o2>=n3-0.2*a53 AND o2<=x3+0.2*a53 AND o1>=n2-0.2*a52 AND o1<=x2+0.2*a52 AND ((s1=1 AND c1>c2 AND c2>c3 AND o0>c1 AND c0<o3) OR (s1=-1 AND c1<c2 AND c2<c3 AND o0<c1 AND c0>o3))", "100*s1"),
    "CDL3OUTSIDE": (3, "(s1=1 AND s2=-1 AND c1>o2 AND o1<c2 AND c0>c1) OR (s1=-1 AND s2=1 AND o1>c2 AND c1<o2 AND c0<c1)", "100*s1"),
    "CDL3STARSINSOUTH": (12, "s2=-1 AND s1=-1 AND s0=-1 AND b2>ab2 AND d2>b2 AND b1<b2 AND o1>c2 AND o1<=h2 AND l1<c2 AND l1>=l2 AND d1>0.1*ar1 AND b0<ab0 AND d0<0.1*ar0 AND u0<0.1*ar0 AND l0>l1 AND h0<h1", "100"),
    "CDL3WHITESOLDIERS": (12, "s2=1 AND s1=1 AND s0=1 AND u2<0.1*ar2 AND u1<0.1*ar1 AND u0<0.1*ar0 AND c0>c1 AND c1>c2 AND o1>o2 AND o1<=c2+0.2*a52 AND o0>o1 AND o0<=c1+0.2*a51 AND b1>b2-0.6*a52 AND b0>b1-0.6*a51 AND b0>ab0", "100"),
    "CDLABANDONEDBABY": (12, f"b2>ab2 AND b1<=0.1*ar1 AND b0>ab0 AND ((s2=1 AND s0=-1 AND c0<c2-b2*0.3 AND {_Gu(1,2)} AND {_Gd(0,1)}) OR (s2=-1 AND s0=1 AND c0>c2+b2*0.3 AND {_Gd(1,2)} AND {_Gu(0,1)}))", "100*s0"),
    "CDLADVANCEBLOCK": (12, "s2=1 AND s1=1 AND s0=1 AND c0>c1 AND c1>c2 AND o1>o2 AND o1<=c2+0.2*a52 AND o0>o1 AND o0<=c1+0.2*a51 AND b2>ab2 AND u2<as2/2 AND ((b1<b2-0.6*a52 AND b0<b1+0.2*a51) OR (b0<b1-0.6*a51) OR (b0<b1 AND b1<b2 AND (u0>as0/2 OR u1>as1/2)) OR (b0<b1 AND u0>b0))", "-100"),
    "CDLBELTHOLD": (10, "b0>ab0 AND ((s0=1 AND d0<0.1*ar0) OR (s0=-1 AND u0<0.1*ar0))", "100*s0"),
    "CDLBREAKAWAY": (14, f"b4>ab4 AND s4=s3 AND s3=s1 AND s1=-s0 AND ((s4=-1 AND {_gd(3,4)} AND h2<h3 AND l2<l3 AND h1<h2 AND l1<l2 AND c0>o3 AND c0<c4) OR (s4=1 AND {_gu(3,4)} AND h2>h3 AND l2>l3 AND h1>h2 AND l1>l2 AND c0<o3 AND c0>c4))", "100*s0"),
    "CDLCLOSINGMARUBOZU": (10, "b0>ab0 AND ((s0=1 AND u0<0.1*ar0) OR (s0=-1 AND d0<0.1*ar0))", "100*s0"),
    "CDLCONCEALBABYSWALL": (13, f"s3=-1 AND s2=-1 AND s1=-1 AND s0=-1 AND u3<0.1*ar3 AND d3<0.1*ar3 AND u2<0.1*ar2 AND d2<0.1*ar2 AND {_gd(1,2)} AND u1>0.1*ar1 AND h1>c2 AND h0>h1 AND l0<l1", "100"),
    "CDLCOUNTERATTACK": (11, "s1=-s0 AND b1>ab1 AND b0>ab0 AND c0 BETWEEN c1-0.05*a51 AND c1+0.05*a51", "100*s0"),
    "CDLDARKCLOUDCOVER": (11, "s1=1 AND b1>ab1 AND s0=-1 AND o0>h1 AND c0>o1 AND c0<c1-b1*0.5", "-100"),
    "CDLDOJI": (10, "b0<=0.1*ar0", "100"),
    "CDLDOJISTAR": (11, f"b1>ab1 AND b0<=0.1*ar0 AND ((s1=1 AND {_gu(0,1)}) OR (s1=-1 AND {_gd(0,1)}))", "-100*s1"),
    "CDLDRAGONFLYDOJI": (10, "b0<=0.1*ar0 AND u0<0.1*ar0 AND d0>0.1*ar0", "100"),
    "CDLENGULFING": (2, "(s0=1 AND s1=-1 AND ((c0>=o1 AND o0<c1) OR (c0>o1 AND o0<=c1))) OR (s0=-1 AND s1=1 AND ((o0>=c1 AND c0<o1) OR (o0>c1 AND c0<=o1)))", "s0*CASE WHEN o0=c1 OR c0=o1 THEN 80 ELSE 100 END"),
    "CDLEVENINGDOJISTAR": (12, f"b2>ab2 AND s2=1 AND b1<=0.1*ar1 AND {_gu(1,2)} AND b0>ab0 AND s0=-1 AND c0<c2-b2*0.3", "-100"),
    "CDLEVENINGSTAR": (12, f"b2>ab2 AND s2=1 AND b1<=ab1 AND {_gu(1,2)} AND b0>ab0 AND s0=-1 AND c0<c2-b2*0.3", "-100"),
    "CDLGAPSIDESIDEWHITE": (7, f"(({_gu(1,2)} AND {_gu(0,2)}) OR ({_gd(1,2)} AND {_gd(0,2)})) AND s1=1 AND s0=1 AND b0 BETWEEN b1-0.2*a51 AND b1+0.2*a51 AND o0 BETWEEN o1-0.05*a51 AND o1+0.05*a51", f"CASE WHEN {_gu(1,2)} THEN 100 ELSE -100 END"),
    "CDLGRAVESTONEDOJI": (10, "b0<=0.1*ar0 AND d0<0.1*ar0 AND u0>0.1*ar0", "100"),
    "CDLHAMMER": (11, "b0<ab0 AND d0>b0 AND u0<0.1*ar0 AND n0<=l1+0.2*a51", "100"),
    "CDLHANGINGMAN": (11, "b0<ab0 AND d0>b0 AND u0<0.1*ar0 AND n0>=h1-0.2*a51", "-100"),
    "CDLHARAMI": (11, "b1>ab1 AND b0<=ab0 AND x0<=x1 AND n0>=n1", "-s1*CASE WHEN x0<x1 AND n0>n1 THEN 100 ELSE 80 END"),
    "CDLHARAMICROSS": (11, "b1>ab1 AND b0<=0.1*ar0 AND x0<=x1 AND n0>=n1", "-s1*CASE WHEN x0<x1 AND n0>n1 THEN 100 ELSE 80 END"),
    "CDLHIGHWAVE": (10, "b0<ab0 AND u0>2*b0 AND d0>2*b0", "100*s0"),
    "CDLHOMINGPIGEON": (11, "s1=-1 AND s0=-1 AND b1>ab1 AND b0<=ab0 AND o0<o1 AND c0>c1", "100"),
    "CDLIDENTICAL3CROWS": (12, "s2=-1 AND s1=-1 AND s0=-1 AND d2<0.1*ar2 AND d1<0.1*ar1 AND d0<0.1*ar0 AND c2>c1 AND c1>c0 AND o1 BETWEEN c2-0.05*a52 AND c2+0.05*a52 AND o0 BETWEEN c1-0.05*a51 AND c1+0.05*a51", "-100"),
    "CDLINNECK": (11, "s1=-1 AND b1>ab1 AND s0=1 AND o0<l1 AND c0>=c1 AND c0<=c1+0.05*a51", "-100"),
    "CDLINVERTEDHAMMER": (11, f"b0<ab0 AND u0>b0 AND d0<0.1*ar0 AND {_gd(0,1)}", "100"),
    "CDLKICKING": (11, f"s1=-s0 AND b1>ab1 AND u1<0.1*ar1 AND d1<0.1*ar1 AND b0>ab0 AND u0<0.1*ar0 AND d0<0.1*ar0 AND ((s1=-1 AND {_Gu(0,1)}) OR (s1=1 AND {_Gd(0,1)}))", "100*s0"),
    "CDLKICKINGBYLENGTH": (11, f"s1=-s0 AND b1>ab1 AND u1<0.1*ar1 AND d1<0.1*ar1 AND b0>ab0 AND u0<0.1*ar0 AND d0<0.1*ar0 AND ((s1=-1 AND {_Gu(0,1)}) OR (s1=1 AND {_Gd(0,1)}))", "100*CASE WHEN b0>b1 THEN s0 ELSE s1 END"),
    "CDLLADDERBOTTOM": (14, "s4=-1 AND s3=-1 AND s2=-1 AND s1=-1 AND o4>o3 AND o3>o2 AND c4>c3 AND c3>c2 AND u1>0.1*ar1 AND s0=1 AND o0>o1 AND c0>h1", "100"),
    "CDLLONGLEGGEDDOJI": (10, "b0<=0.1*ar0 AND (d0>b0 OR u0>b0)", "100"),
    "CDLLONGLINE": (10, "b0>ab0 AND u0<as0/2 AND d0<as0/2", "100*s0"),
    "CDLMARUBOZU": (10, "b0>ab0 AND u0<0.1*ar0 AND d0<0.1*ar0", "100*s0"),
    "CDLMATCHINGLOW": (6, "s1=-1 AND s0=-1 AND c0 BETWEEN c1-0.05*a51 AND c1+0.05*a51", "100"),
    "CDLMATHOLD": (14, f"b4>ab4 AND b3<ab3 AND b2<ab2 AND b1<ab1 AND s4=1 AND s3=-1 AND s0=1 AND {_gu(3,4)} AND n2<c4 AND n1<c4 AND n2>c4-b4*0.5 AND n1>c4-b4*0.5 AND x2<o3 AND x1<x2 AND o0>c1 AND c0>greatest(h3,h2,h1)", "100"),
    "CDLMORNINGDOJISTAR": (12, f"b2>ab2 AND s2=-1 AND b1<=0.1*ar1 AND {_gd(1,2)} AND b0>ab0 AND s0=1 AND c0>c2+b2*0.3", "100"),
    "CDLMORNINGSTAR": (12, f"b2>ab2 AND s2=-1 AND b1<=ab1 AND {_gd(1,2)} AND b0>ab0 AND s0=1 AND c0>c2+b2*0.3", "100"),
    "CDLONNECK": (11, "s1=-1 AND b1>ab1 AND s0=1 AND o0<l1 AND c0 BETWEEN l1-0.05*a51 AND l1+0.05*a51", "-100"),
    "CDLPIERCING": (11, "s1=-1 AND b1>ab1 AND s0=1 AND b0>ab0 AND o0<l1 AND c0<o1 AND c0>c1+b1*0.5", "100"),
    "CDLRICKSHAWMAN": (10, "b0<=0.1*ar0 AND d0>b0 AND u0>b0 AND n0<=l0+(h0-l0)/2+0.2*a50 AND x0>=l0+(h0-l0)/2-0.2*a50", "100"),
    "CDLRISEFALL3METHODS": (14, "b4>ab4 AND b3<ab3 AND b2<ab2 AND b1<ab1 AND b0>ab0 AND s4=-s3 AND s3=s2 AND s2=s1 AND s1=-s0 AND n3<h4 AND x3>l4 AND n2<h4 AND x2>l4 AND n1<h4 AND x1>l4 AND c2*s4<c3*s4 AND c1*s4<c2*s4 AND o0*s4>c1*s4 AND c0*s4>c4*s4", "100*s4"),
    "CDLSEPARATINGLINES": (11, "s1=-s0 AND o0 BETWEEN o1-0.05*a51 AND o1+0.05*a51 AND b0>ab0 AND ((s0=1 AND d0<0.1*ar0) OR (s0=-1 AND u0<0.1*ar0))", "100*s0"),
    "CDLSHOOTINGSTAR": (11, f"b0<ab0 AND u0>b0 AND d0<0.1*ar0 AND {_gu(0,1)}", "-100"),
    "CDLSHORTLINE": (10, "b0<ab0 AND u0<as0/2 AND d0<as0/2", "100*s0"),
    "CDLSPINNINGTOP": (10, "b0<ab0 AND u0>b0 AND d0>b0", "100*s0"),
    "CDLSTALLEDPATTERN": (12, "s2=1 AND s1=1 AND s0=1 AND c0>c1 AND c1>c2 AND b2>ab2 AND b1>ab1 AND u1<0.1*ar1 AND o1>o2 AND o1<=c2+0.2*a52 AND b0<ab0 AND o0>=c1-b0-0.2*a51", "-100"),
    "CDLSTICKSANDWICH": (7, "s2=-1 AND s1=1 AND s0=-1 AND l1>c2 AND c0 BETWEEN c2-0.05*a52 AND c2+0.05*a52", "100"),
    "CDLTAKURI": (10, "b0<=0.1*ar0 AND u0<0.1*ar0 AND d0>2*b0", "100"),
    "CDLTASUKIGAP": (7, f"abs(b1-b0)<0.2*a51 AND (({_gu(1,2)} AND s1=1 AND s0=-1 AND o0>o1 AND o0<c1 AND c0<o1 AND c0>x2) OR ({_gd(1,2)} AND s1=-1 AND s0=1 AND o0<o1 AND o0>c1 AND c0>o1 AND c0<n2))", "100*s1"),
    "CDLTHRUSTING": (11, "s1=-1 AND b1>ab1 AND s0=1 AND o0<l1 AND c0>c1+0.05*a51 AND c0<=c1+b1*0.5", "-100"),
    "CDLTRISTAR": (12, f"b2<=0.1*ar2 AND b1<=0.1*ar2 AND b0<=0.1*ar2 AND (({_gu(1,2)} AND x0<x1) OR ({_gd(1,2)} AND n0>n1))", f"CASE WHEN {_gu(1,2)} AND x0<x1 THEN -100 ELSE 100 END"),
    "CDLUNIQUE3RIVER": (12, "b2>ab2 AND s2=-1 AND s1=-1 AND c1>c2 AND o1<=o2 AND l1<l2 AND b0<ab0 AND o0>l1 AND s0=1", "100"),
    "CDLUPSIDEGAP2CROWS": (12, f"s2=1 AND b2>ab2 AND s1=-1 AND b1<=ab1 AND {_gu(1,2)} AND s0=-1 AND o0>o1 AND c0<c1 AND c0>c2", "-100"),
    "CDLXSIDEGAP3METHODS": (2, f"s2=s1 AND s1=-s0 AND o0<x1 AND o0>n1 AND c0<x2 AND c0>n2 AND ((s2=1 AND {_gu(1,2)}) OR (s2=-1 AND {_gd(1,2)}))", "100*s2"),
}
_HK = {
    "CDLHIKKAKE": (2, 5, "h1<h2 AND l1>l2 AND h0<h1 AND l0<l1", "h1<h2 AND l1>l2 AND h0>h1 AND l0>l1"),
    "CDLHIKKAKEMOD": (7, 10, "h2<h3 AND l2>l3 AND h1<h2 AND l1>l2 AND h0<h1 AND l0<l1 AND c2<=l2+0.2*a52",
                      "h2<h3 AND l2>l3 AND h1<h2 AND l1>l2 AND h0>h1 AND l0>l1 AND c2>=h2-0.2*a52"),
}


def _hikkake(name: str) -> str:
    """Start rows; later rows look for the last start of the three bars before; the first pass confirms."""
    first, lb, up, down = _HK[name]
    t = name.lower()
    return f"""{t}_s AS (SELECT code, trade_date, i, c0, h1, l1,
    CASE WHEN i < {first} THEN 0 WHEN {up} THEN 1 WHEN {down} THEN -1 ELSE 0 END AS st FROM px),
{t}_m AS (SELECT *, max(CASE WHEN st <> 0 THEN i END) OVER ({W} ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS si FROM {t}_s),
{t}_c AS (SELECT a.code, a.trade_date, a.i, a.si, b.st AS dir FROM {t}_m a JOIN {t}_s b ON a.code = b.code AND a.si = b.i
    WHERE a.st = 0 AND ((b.st = 1 AND a.c0 > b.h1) OR (b.st = -1 AND a.c0 < b.l1))),
{t}_f AS (SELECT *, row_number() OVER (PARTITION BY code, si ORDER BY i) AS rn FROM {t}_c),
{t} AS (SELECT code, trade_date, i, '{name}' AS pattern, 100 * st AS value FROM {t}_s WHERE st <> 0 AND i >= {lb}
    UNION ALL SELECT code, trade_date, i, '{name}', 200 * dir FROM {t}_f WHERE rn = 1 AND i >= {lb})"""


def sig(names=ALL_PATTERNS, name: str = "sig", src: str = "bars") -> str:
    """CTEs up to `sig(code, trade_date, i, pattern, value)`, non-zero values only."""
    names = list(names)
    plain = [n for n in names if n in P]
    ctes, parts = [px(src)], []
    if plain:
        cells = ", ".join(f"CASE WHEN i >= {P[n][0]} AND ({P[n][1]}) THEN {P[n][2]} ELSE 0 END AS \"{n}\"" for n in plain)
        ctes.append(f"wide AS (SELECT code, trade_date, i, {cells} FROM px)")
        ctes.append(f"plain AS (UNPIVOT wide ON {', '.join(plain)} INTO NAME pattern VALUE value)")
        parts.append("SELECT code, trade_date, i, pattern, value FROM plain WHERE value <> 0")
    for n in names:
        if n in _HK:
            ctes.append(_hikkake(n))
            parts.append(f"SELECT code, trade_date, i, pattern, value FROM {n.lower()}")
    ctes.append(f"{name} AS (SELECT code, trade_date, CAST(i AS INT) AS i, pattern, CAST(value AS INT) AS value FROM ({' UNION ALL '.join(parts)}))")
    return ",\n".join(ctes)


# --- trades -------------------------------------------------------------------------------------

def outcomes(hold: int = 2, src: str = "bars", combined: bool = False) -> str:
    """`num` (bars with index) and `res(code, e, ...)`: the end of a position entered at bar e, by side."""
    w_stop = hold - 1 if combined else hold
    nf_hold = hold if combined else hold + 1
    held_hold = hold if combined else hold + 1
    return f"""num AS (SELECT *, row_number() OVER ({W}) - 1 AS i, count(*) OVER (PARTITION BY code) - 1 AS last_i FROM {src}),
stops AS (SELECT a.code, a.i AS e, min(b.i) AS s FROM num a LEFT JOIN num b ON a.code = b.code
    AND b.i BETWEEN a.i + 1 AND a.i + {w_stop} AND b.close / a.open - 1 <= -0.03 GROUP BY a.code, a.i),
both_sides AS (SELECT code, e, s, 'buy' AS side FROM stops UNION ALL SELECT code, e, NULL, 'sell' FROM stops),
kinds AS (SELECT t.code, t.e, t.side, t.s, n.last_i,
    CASE WHEN t.s IS NOT NULL AND t.s + 1 <= n.last_i THEN 'stop' WHEN t.s IS NULL AND t.e + {hold} <= n.last_i THEN 'hold' ELSE 'end' END AS kind
    FROM both_sides t JOIN num n ON n.code = t.code AND n.i = t.e),
res AS (SELECT k.code, k.e, k.side, k.kind, k.last_i, x.trade_date AS exit_date, x.i AS exit_i,
    CASE WHEN k.kind = 'end' THEN x.close ELSE x.open END AS exit_price, a.trade_date AS entry_date, a.open AS entry_price,
    CASE k.kind WHEN 'stop' THEN k.s + 1 - k.e WHEN 'hold' THEN {held_hold} ELSE k.last_i - k.e + 1 END AS held,
    CASE k.kind WHEN 'stop' THEN k.s + 1 WHEN 'hold' THEN k.e + {nf_hold} ELSE 2147483647 END AS nf
    FROM kinds k JOIN num a ON a.code = k.code AND a.i = k.e
    JOIN num x ON x.code = k.code AND x.i = CASE k.kind WHEN 'stop' THEN k.s + 1 WHEN 'hold' THEN k.e + {hold} ELSE k.last_i END)"""


CAND = """cand AS (SELECT g.code, g.pattern, CASE WHEN g.value > 0 THEN 'buy' ELSE 'sell' END AS side, g.trade_date AS signal_date, r.* EXCLUDE (code, side)
    FROM sig g JOIN res r ON r.code = g.code AND r.e = g.i + 1 AND r.side = CASE WHEN g.value > 0 THEN 'buy' ELSE 'sell' END)"""


def walk(keys=("code", "pattern", "side"), cash: str = "1e8", extra: str = "") -> str:
    """`trades`: start at an account's first candidate, follow the next one that may open; cash goes along."""
    on = " AND ".join(f"a.{k} = b.{k}" for k in keys)
    onr = " AND ".join(f"c.{k} = r.{k}" for k in keys)
    ks = ", ".join(keys)
    step = """floor(floor({cash} * 0.995 / c.entry_price) / 100) * 100"""
    def cols(cashx):
        size = step.format(cash=cashx)
        cin = (f"CASE WHEN c.side = 'buy' THEN {cashx} - ({size}) * c.entry_price * (1 + 0.0001::DOUBLE) "
               f"ELSE {cashx} + ({size}) * c.entry_price * (1 - 0.0001::DOUBLE) END")
        cout = (f"CASE WHEN c.side = 'buy' THEN ({cin}) + ({size}) * c.exit_price * (1 - 0.0001::DOUBLE) "
                f"ELSE ({cin}) - ({size}) * c.exit_price * (1 + 0.0001::DOUBLE) END")
        return f"{size} AS size, {cin} AS cash_in, {cout} AS cash_out"
    side = "" if "side" in keys else "side, "
    base = f"{ks}, {side}e, entry_date, entry_price, exit_i, exit_date, exit_price, kind, held, nf, last_i{extra}"
    c = ", ".join("c." + x.strip() for x in base.split(","))
    return f"""nexts AS (SELECT a.*, b.e AS nxt FROM cand a ASOF LEFT JOIN cand b ON {on} AND a.nf <= b.e),
firsts AS (SELECT *, row_number() OVER (PARTITION BY {ks} ORDER BY e) AS rn FROM nexts),
trades AS (SELECT {c}, c.nxt, 1 AS trade_no, {cols(cash + '::DOUBLE')} FROM firsts c WHERE rn = 1
    UNION ALL SELECT {c}, c.nxt, r.trade_no + 1, {cols('r.cash_out')} FROM trades r JOIN nexts c ON {onr} AND c.e = r.nxt)"""


def with_(*ctes: str, recursive: bool = False) -> str:
    return ("WITH RECURSIVE " if recursive else "WITH ") + ",\n".join(ctes) + "\n"


def equity(keys=("code", "pattern", "side"), src_num: str = "num") -> str:
    """`marks`: equity of every held bar and of the bar on which the account is cash again; `tm` per trade."""
    ks = ", ".join(keys)
    kt = ", ".join(f"t.{k}" for k in keys)
    side = "" if "side" in keys else "t.side, "
    return f"""nx AS (SELECT *, lead(e) OVER (PARTITION BY {ks} ORDER BY trade_no) AS next_e FROM trades),
held_bars AS (SELECT {kt}, {side}t.trade_no, n.i, t.e, t.kind, t.last_i, t.size, t.entry_price, t.cash_in, t.cash_out,
    CASE WHEN t.side = 'buy' THEN t.cash_in + t.size * n.close ELSE t.cash_in - t.size * n.close END AS at_close
    FROM nx t JOIN {src_num} n ON n.code = t.code AND n.i BETWEEN t.e AND t.e + t.held - 1),
marks AS (SELECT {ks}, trade_no, i, CASE WHEN kind = 'end' AND i = last_i THEN cash_out ELSE at_close END AS equity FROM held_bars
    UNION ALL SELECT {ks}, trade_no, e + held, cash_out FROM nx
    WHERE kind <> 'end' AND e + held <= last_i AND (next_e IS NULL OR next_e <> e + held)),
moves AS (SELECT *, equity / lag(equity, 1, 1e8::DOUBLE) OVER (PARTITION BY {ks} ORDER BY i) - 1 AS ret,
    greatest(1e8::DOUBLE, max(equity) OVER (PARTITION BY {ks} ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS peak FROM marks),
risk AS (SELECT {ks}, count(*) FILTER (ret <> 0) AS n, avg(ret) FILTER (ret <> 0) AS mu, stddev_samp(ret) FILTER (ret <> 0) AS sd,
    max((peak - equity) / peak * 100) AS mdd FROM moves GROUP BY {ks}),
pnl AS (SELECT *, round(CASE WHEN side = 'buy' THEN (exit_price / entry_price - 1) * 100 ELSE (entry_price / exit_price - 1) * 100 END, 2) AS pct FROM trades),
sums AS (SELECT {ks}, count(*) AS trades, count(*) FILTER (pct > 0) AS won, round(sum(pct), 2) AS return_pct, sum(held) AS held_bars,
    sum(exit_i - e) AS hold_days FROM pnl GROUP BY {ks}),
acct AS (SELECT s.*, round_even(won / trades * 100, 0) AS win_rate, round(mdd, 2) AS max_drawdown,
    CASE WHEN n > 1 AND sd > 1e-12 THEN round(mu / sd * sqrt(252), 2) ELSE 0 END AS sharpe FROM sums s JOIN risk USING ({ks}))"""


def annual(pct: str, years: str) -> str:
    return f"CASE WHEN {pct} > -100 THEN round((pow(1 + {pct} / 100, 1 / ({years})) - 1) * 100, 2) ELSE -100 END"

"""Sources, filters, task lists and the daily cross-section."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F
from pyspark.sql import types as T

from checks import sql as S
from checks.registry import add
from checks.trade_queries import _BUYS, _COMB, _SCAN_FEW, _SELLS, FEW, HOLES, _renamed, few_scan, holes
from wickspark import adapters as A
from wickspark.functions import codes as K
from wickspark.model import DAILY_PATTERNS, DAILY_BUY_ORDER, TRACKED_INDEXES
from wickspark.operators import candles, daily as D, metrics as M, selection as F_
from wickspark.operators.indicators import latest_row
from wickspark.plans import flows as P
from wickspark.session import shared_folder
from wickspark.sources import bars as B, files as X, text as Q
from wickspark.streaming import ingest as N

_BAR = ("code", "trade_date", "open", "high", "low", "close", "vol")
_COLS = "code, trade_date, open, high, low, close, vol"
NAMES = ("A", "N", "R")  # the sources there are

# --- S1-S16 -------------------------------------------------------------------------------------

add("source_merge", lambda s, d: B.merge_bar_sources(A.sources(s, d), NAMES).drop("priority"),
    S.with_(S.SOURCES) + f"SELECT {_COLS}, source FROM srcs QUALIFY row_number() OVER (PARTITION BY code, trade_date ORDER BY priority) = 1")
add("source_read_bars", lambda s, d: F_.date_range(B.with_partitions(A.bars(s, d)), "1997-03-15", "1998-02-10").filter("ym BETWEEN '199703' AND '199802'"),
    S.with_(S.BARS) + f"SELECT {_COLS}, {S.board_of()} AS board, strftime(trade_date, '%Y%m') AS ym FROM bars WHERE trade_date BETWEEN DATE '1997-03-15' AND DATE '1998-02-10'")


def _bar_loads(s, d):
    """Two loads that overlap, the later one of source R."""
    return A.sources(s, d).filter("source <> 'A'").select(*_BAR, F.col("source").alias("load"), F.when(F.col("source") == "N", 1).otherwise(2).cast("long").alias("seq"))


add("source_upsert_bars", lambda s, d: B.upserted(A.sources(s, d).filter("source = 'A'").select(*_BAR), _bar_loads(s, d), "seq", "load"),
    S.with_(S.SOURCES, "old AS (SELECT * FROM srcs WHERE source = 'A')",
            "new AS (SELECT * FROM srcs WHERE source <> 'A' AND code NOT LIKE '%.BJ' QUALIFY row_number() OVER (PARTITION BY code, trade_date ORDER BY source DESC) = 1)")
    + f"SELECT {_COLS} FROM new UNION ALL SELECT {_COLS} FROM old o WHERE NOT EXISTS (SELECT 1 FROM new n WHERE n.code = o.code AND n.trade_date = o.trade_date)")
add("source_rejected", lambda s, d: B.rejected(_bar_loads(s, d), "load"),
    S.with_(S.SOURCES) + "SELECT source AS load, code, 'excluded board' AS reason, count(*) AS rows FROM srcs WHERE source <> 'A' AND code LIKE '%.BJ' GROUP BY ALL")


def _vendor(s, d):
    """The sources as the vendors would send them."""
    src = A.sources(s, d)
    a = src.filter("source = 'A'").select(
        F.col("trade_date").cast("string").alias("日期"), "code", F.col("open").alias("开盘"), F.col("close").alias("收盘"), F.col("high").alias("最高"),
        F.col("low").alias("最低"), F.col("vol").alias("成交量"), (F.col("vol") * F.col("close")).alias("成交额"))
    n = src.filter("source = 'N'").select(
        F.date_format("trade_date", "yyyyMMdd").alias("trade_date"), F.col("code").alias("ts_code"), "open", "high", "low", "close", "vol")
    r = src.filter("source = 'R'").select(
        F.col("trade_date").alias("date"), "code", "open", "high", "low", "close", F.col("vol").alias("volume"), (F.col("vol") / 1000).alias("turnover"))
    return (B.normalize_vendor(a, "stock_cn").unionByName(B.normalize_vendor(n, "stock_lots"))
            .unionByName(B.normalize_vendor(r, "stock_fraction")))


add("source_normalize_vendor", _vendor,
    S.with_(S.SOURCES) + "SELECT code, trade_date, open, high, low, close, CASE source WHEN 'N' THEN vol * 100 ELSE vol END AS vol, CASE source WHEN 'A' THEN vol * close END AS amount, "
    "NULL::DOUBLE AS pct_chg, CASE source WHEN 'R' THEN (vol / 1000) * 100 END AS turnover_rate FROM srcs")


def _vendor_indexes(s, d):
    """Bars as the other vendors would send them: indexes by the number of letters in their code, the rest by board."""
    b = A.bars(s, d).withColumn("board", K.classify_board(F.col("code")))
    home, day = F.col("code").rlike(r"\.(SH|SZ|BJ)$"), F.col("trade_date")
    frame = lambda cond, date, *more: b.filter(cond).select(date.alias("date"), "code", "open", "high", "low", "close", F.col("vol").alias("volume"), *more)
    sent = {
        "index_cn": frame(home & (F.col("board") == "index") & F.col("code").endswith(".SH"), day.cast("string")),
        "index_us": frame(~home & (F.length("code") == 3), F.date_format(day, "yyyy-MM-dd HH:mm:ss"), (F.col("vol") * F.col("close")).alias("amount")),
        "index_global": frame(~home & (F.length("code") > 3), day),
        "stock_plain": frame(home & (F.col("board") != "index"), day.cast("string")),
        "index_lots": b.filter(home & (F.col("board") == "index") & ~F.col("code").endswith(".SH")).select(
            F.date_format(day, "yyyyMMdd").alias("trade_date"), F.col("code").alias("ts_code"), "open", "high", "low", "close", "vol",
            (F.col("vol") * 2).alias("amount"), F.when(F.col("vol") > 50, F.col("open")).otherwise(F.lit(float("nan"))).alias("pct_chg")),
    }
    out = None
    for layout, raw in sent.items():
        part = B.normalize_vendor(raw, layout).withColumn("layout", F.lit(layout))
        out = part if out is None else out.unionByName(part)
    return out


add("source_vendor_indexes", _vendor_indexes,
    S.with_(S.BARS, f"""b AS (SELECT *, CASE WHEN NOT regexp_matches(code, '\\.(SH|SZ|BJ)$') THEN CASE WHEN length(code) = 3 THEN 'index_us' ELSE 'index_global' END
      WHEN {S.board_of()} <> 'index' THEN 'stock_plain' WHEN code LIKE '%.SH' THEN 'index_cn' ELSE 'index_lots' END AS layout FROM bars)""")
    + "SELECT code, trade_date, open, high, low, close, vol, CASE layout WHEN 'index_lots' THEN vol * 2 END AS amount, "
    "CASE WHEN layout = 'index_lots' AND vol > 50 THEN open END AS pct_chg, NULL::DOUBLE AS turnover_rate, layout FROM b")
add("source_merged_performance",
    lambda s, d: X.merged_performance(few_scan(s, d).withColumn("trades", F.lit(-1).cast("long")).filter("side = 'buy'"), few_scan(s, d).filter("pattern <> 'CDLDOJI'"))
    .select("code", "pattern", "side", "trades", "return_pct"),
    _SCAN_FEW + "SELECT code, pattern, side, CASE WHEN pattern = 'CDLDOJI' THEN -1 ELSE trades END AS trades, return_pct FROM scan WHERE pattern <> 'CDLDOJI' OR side = 'buy'")

END = "2001-10-29"


def _asked(s, d):
    """Sources in the order they are asked; the third is the local one."""
    return A.sources(s, d).withColumn("is_local", F.col("priority") == 3)


add("source_choose", lambda s, d: B.choose_source(_asked(s, d), END, NAMES).select(*_BAR, "source"),
    S.with_(S.SOURCES, f"""reach AS (SELECT code, priority, max(trade_date) AS m FROM srcs GROUP BY code, priority),
    best AS (SELECT code, priority AS bp, m AS bm FROM reach QUALIFY row_number() OVER (PARTITION BY code ORDER BY CASE WHEN m >= DATE '{END}' THEN 0 ELSE 1 END, CASE WHEN m >= DATE '{END}' THEN priority ELSE -priority END) = 1),
    main AS (SELECT s.*, bm, (SELECT m FROM reach r WHERE r.code = s.code AND r.priority = 3) AS lm, bp FROM srcs s JOIN best b ON s.code = b.code),
    kept AS (SELECT *, CASE WHEN priority = bp THEN 0 ELSE 1 END AS tail FROM main WHERE priority = bp OR (priority = 3 AND bm < DATE '{END}' AND lm > bm))""")
    + f"SELECT {_COLS}, source FROM kept QUALIFY row_number() OVER (PARTITION BY code, trade_date ORDER BY tail DESC) = 1")


def _quotes(s, d):
    """The last bar of each code one week later."""
    return latest_row(A.bars(s, d)).select("code", F.date_add("trade_date", 7).alias("trade_date"), "open", "high", "low", "close", "vol")


add("source_top_up_latest", lambda s, d: B.top_up_latest(A.bars(s, d), _quotes(s, d), END),
    S.with_(S.BARS, "last AS (SELECT * FROM bars QUALIFY row_number() OVER (PARTITION BY code ORDER BY trade_date DESC) = 1)")
    + f"SELECT {_COLS} FROM bars UNION ALL SELECT code, trade_date + 7, open, high, low, close, vol FROM last WHERE trade_date + 7 = DATE '{END}'")


def _quote_lines(s, d):
    """Each code's last bar as a quote text line; overseas codes in the other layout, part of them at night."""
    last = latest_row(A.bars(s, d))
    sym = K.quote_symbol(F.col("code"))
    num = lambda c: F.col(c).cast("string")
    share = F.concat_ws(",", F.lit("name"), num("open"), F.lit("0"), num("close"), num("high"), num("low"), F.lit("0"), F.lit("0"), num("vol"),
                        *[F.lit("0")] * 21, num("trade_date"), F.lit("15:00:00"), F.lit("00"))
    us = F.concat_ws(",", F.lit("name"), num("close"), F.lit("0"), F.concat(num("trade_date"), F.when(F.col("code") == "SPX", F.lit(" 03:30:00")).otherwise(F.lit(" 09:30:00"))),
                     F.lit("0"), num("open"), num("high"), num("low"), F.lit("0"), F.lit("0"), num("vol"))
    text = F.when(sym.startswith("gb_"), us).otherwise(share)
    return last.filter(sym.isNotNull()).select(F.concat(F.lit("var hq_str_"), sym, F.lit('="'), text, F.lit('";')).alias("value"))


add("source_parse_quotes", lambda s, d: Q.parse_quote_lines(_quote_lines(s, d)),
    S.with_(S.BARS, "last AS (SELECT * FROM bars QUALIFY row_number() OVER (PARTITION BY code ORDER BY trade_date DESC) = 1)")
    + """SELECT CASE WHEN code = 'DJI' THEN 'gb_dji' WHEN code = 'SPX' THEN 'gb_inx' ELSE lower(right(code, 2)) || left(code, 6) END AS symbol,
    CASE WHEN code = 'SPX' THEN trade_date - 1 ELSE trade_date END AS trade_date, open, high, low, close, vol FROM last
    WHERE code IN ('DJI', 'SPX') OR (length(code) = 9 AND (code LIKE '%.SH' OR code LIKE '%.SZ'))""")


def _log_lines(s, d):
    """Every order as a line of a tracking log: a start line, its details, or another message.

    All lines belong to one file: the case the two-level scan is for."""
    li = A.table(s, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderpriority", "o_orderstatus")
    kind = F.col("o_orderkey") % 5
    code = F.concat(F.lpad((F.floor(F.col("o_orderkey") / 5) % 900 + 600000).cast("string"), 6, "0"), F.lit(".SH"))
    msg = (F.when(kind == 0, F.concat(F.lit("买入原因：x(buy_signal_CDLDOJI)")))
           .when(kind == 1, F.lit("触发形态：y(buy_signal_CDLDOJI)"))
           .when((kind == 2) & (F.col("o_orderstatus") != "P"), F.concat(F.lit("策略在该股的交易次数：9, 胜率(%)："), (F.col("o_custkey") % 100).cast("string"),
                                                                     F.lit(", 简易收益率(%)：-1.5, 夏普比率：0.1")))
           .when(kind == 3, F.lit("卖出提示：sell_signal_CDLHARAMI")).otherwise(F.lit("其他")))
    line = F.concat(F.lit("2024-01-05 10:30:00 跟踪日：2024-01-05 - "), code, F.lit(" - 名称: "), msg)
    return li.select(F.lit("day.log").alias("file"), F.col("o_orderkey").alias("line_no"), line.alias("value"))


add("source_tracking_blocks",
    lambda s, d: Q.tracking_blocks(_log_lines(s, d)).select("code", "side", "pattern", "win_rate", "return_pct", "lines", "line_no"),
    """WITH l AS (SELECT o_orderkey AS n, o_orderkey % 5 AS k, o_orderstatus AS st, o_custkey % 100 AS w, (600000 + floor(o_orderkey / 5) % 900)::BIGINT::VARCHAR || '.SH' AS code FROM orders),
    t AS (SELECT *, lead(k) OVER (ORDER BY n) AS k1, lead(k, 2) OVER (ORDER BY n) AS k2, lead(st, 2) OVER (ORDER BY n) AS st2, lead(w, 2) OVER (ORDER BY n) AS w2 FROM l),
    b AS (SELECT code, 'buy' AS side, 'CDLDOJI' AS pattern, CASE WHEN k1 = 1 AND k2 = 2 AND st2 <> 'P' THEN w2::DOUBLE END AS win_rate,
      CASE WHEN k1 = 1 AND k2 = 2 AND st2 <> 'P' THEN -1.5::DOUBLE END AS return_pct, CASE WHEN k1 = 1 AND k2 = 2 AND st2 <> 'P' THEN 3 WHEN k1 = 1 THEN 2 ELSE 1 END AS lines, n FROM t WHERE k = 0
      UNION ALL SELECT code, 'sell', 'CDLHARAMI', NULL, NULL, 1, n FROM t WHERE k = 3)
    SELECT code, side, pattern, win_rate, return_pct, CAST(lines AS BIGINT) AS lines, min(n) AS line_no FROM b GROUP BY ALL""")
add("source_coverage", lambda s, d: B.coverage(A.bars(s, d), B.coverage(A.sources(s, d).filter("source = 'R'").withColumn("trade_date", F.date_sub("trade_date", 70)))),
    S.with_(S.SOURCES, f"bars AS (SELECT {S.code_of('k')} AS code, trade_date, count(*) AS n FROM rolled GROUP BY k, trade_date)",
            "a AS (SELECT code, min(trade_date) AS lo, max(trade_date) AS hi, count(*) AS n FROM bars GROUP BY code)",
            "b AS (SELECT code, min(trade_date) - 70 AS lo, max(trade_date) - 70 AS hi, count(*) AS n FROM srcs WHERE source = 'R' GROUP BY code)")
    + "SELECT code, least(a.lo, b.lo) AS min_date, greatest(a.hi, b.hi) AS max_date, coalesce(a.n, b.n) AS row_count FROM a FULL JOIN b USING (code)")


def _requests(s, d):
    base = A.universe(s, d)
    return base.select("code", F.date_add(F.lit("1995-01-02").cast("date"), (F.col("key") % 30).cast("int")).alias("start"),
                       F.date_sub(F.lit("2001-11-04").cast("date"), (F.col("key") % 17).cast("int")).alias("end")).union(
        base.select("code", F.lit("1994-06-25").cast("date"), F.lit("2001-06-01").cast("date")))


_REQ = """req AS (SELECT code, DATE '1995-01-02' + (key % 30)::INTEGER AS start, DATE '2001-11-04' - (key % 17)::INTEGER AS "end" FROM universe
    UNION ALL SELECT code, DATE '1994-06-25', DATE '2001-06-01' FROM universe), cov AS (SELECT code, min(trade_date) AS lo, max(trade_date) AS hi FROM bars GROUP BY code)"""
_COVERED = "coalesce(lo <= start + 10 AND hi >= \"end\" - 5 AND code NOT LIKE '%.BJ', false)"
add("source_check_coverage", lambda s, d: B.check_coverage(B.coverage(A.bars(s, d)), _requests(s, d)),
    S.with_(S.BARS, S.UNIVERSE, _REQ) + f"SELECT code, start, \"end\", {_COVERED} AS covered FROM req LEFT JOIN cov USING (code)")
add("source_missing_codes", lambda s, d: B.missing_codes(_requests(s, d), B.coverage(A.bars(s, d))),
    S.with_(S.BARS, S.UNIVERSE, _REQ) + f"SELECT code, start, \"end\" FROM req LEFT JOIN cov USING (code) WHERE NOT {_COVERED}")


def _securities(s, d):
    u = A.universe(s, d)
    stored = u.filter("key % 3 <> 0").select("code", "name", "board", F.lit("2000-01-01").alias("list_date"))
    rows = u.filter("key % 2 = 0").select("code", F.concat(F.lit("new "), "name").alias("name"))
    return B.upsert_securities(stored, rows)


add("source_upsert_securities", _securities,
    S.with_(S.UNIVERSE) + "SELECT code, CASE WHEN key % 2 = 0 THEN 'new ' || name ELSE name END AS name, board, CASE WHEN key % 3 <> 0 THEN '2000-01-01' END AS list_date FROM universe WHERE key % 3 <> 0 OR key % 2 = 0")
add("source_daily_summary",
    lambda s, d: X.daily_summary(D.daily_signals(A.bars(s, d), DAYS)).select("trade_date", "code", "buy_count", "sell_count", F.size("signals").cast("long").alias("n")),
    S.with_(S.BARS, S.sig(DAILY_PATTERNS)) + f"SELECT trade_date, code, count(*) FILTER (value > 0) AS buy_count, count(*) FILTER (value < 0) AS sell_count, count(*) AS n FROM sig "
    "WHERE trade_date IN (DATE '2001-10-15', DATE '2001-10-22', DATE '2001-10-29') AND i >= 3 GROUP BY ALL")
DAYS = ["2001-10-15", "2001-10-22", "2001-10-29"]



def _csv_report(s, d):
    """The orders as CSV files of four parts: in one line of ten the price is no number, in one of ten a field is missing."""
    path = f"{shared_folder(s)}/csv-{uuid.uuid4().hex}"
    o, kind = A.table(s, d, "orders"), F.col("o_orderkey") % 10
    price = F.when(kind == 3, F.lit("n/a")).otherwise(F.col("o_totalprice").cast("string"))
    line = F.concat_ws(",", F.col("o_orderkey").cast("string"), price, F.when(kind != 7, F.to_date("o_orderdate").cast("string")))
    parts = o.select(line.alias("value"), (F.floor(F.col("o_orderkey") / 10) % 4).alias("part")).repartition("part")
    parts.write.partitionBy("part").text(f"{path}/csv")
    schema = T.StructType.fromDDL("order_key bigint, price double, day date")
    report = X.csv_to_parquet(s, f"{path}/csv", f"{path}/out", schema, header=False)
    part = F.regexp_extract("source_file", "part=([0-9]+)", 1).cast("long")
    good = X.converted(s, f"{path}/out").groupBy(part.alias("part")).agg(F.sum(F.col("price").cast("decimal(20,2)")).cast("double").alias("price"), F.max("day").alias("last_day"))
    lines = X.refused_lines(s, f"{path}/out").groupBy(part.alias("part")).agg(F.sum(F.length(X.BAD_LINE)).alias("bad_chars"))
    sums = report.groupBy(part.alias("part")).agg(*[F.sum(c).alias(c) for c in ("csv_rows", "parquet_rows", "bad_lines")], F.bool_and("verified").alias("verified"))
    return sums.join(good, "part").join(lines, "part")


add("source_csv_report", _csv_report,
    """WITH l AS (SELECT (o_orderkey // 10) % 4 AS part, o_orderkey % 10 IN (3, 7) AS bad, o_totalprice AS price, CAST(o_orderdate AS DATE) AS day,
      length(o_orderkey::VARCHAR) + CASE WHEN o_orderkey % 10 = 3 THEN 15 ELSE 1 END AS n, o_orderkey % 10 = 7 AS short FROM orders)
    SELECT CAST(part AS BIGINT) AS part, count(*) AS csv_rows, count(*) FILTER (NOT bad) AS parquet_rows, count(*) FILTER (bad) AS bad_lines, true AS verified,
    CAST(sum(CAST(price AS DECIMAL(20, 2))) FILTER (NOT bad) AS DOUBLE) AS price, max(day) FILTER (NOT bad) AS last_day,
    CAST(sum(n + CASE WHEN short THEN length(price::VARCHAR) ELSE 0 END) FILTER (bad) AS BIGINT) AS bad_chars FROM l GROUP BY part""")

# --- F1-F24 -------------------------------------------------------------------------------------

add("code_rules",
    lambda s, d: A.universe(s, d).select(
        "code", K.classify_board(F.col("code")).alias("board"), K.is_index(F.col("code")).alias("is_index"), K.is_index_short(F.col("code")).alias("short_index"),
        K.perf_group(F.col("code")).alias("perf_group"), K.listed_in_beijing(F.col("code")).alias("bj")),
    S.with_(S.UNIVERSE) + f"""SELECT code, {S.board_of()} AS board, code IN ('DJI','FCHI','SPX','GDAXI','N225') OR (code LIKE '%.SH' AND left(code, 3) IN ('000', '880')) OR (code LIKE '%.SZ' AND left(code, 3) = '399') AS is_index,
    {S.short_index()} AS short_index, {S.group_of()} AS perf_group, code LIKE '%.BJ' AS bj FROM universe""")
add("code_normalize",
    lambda s, d: A.universe(s, d).select("code", K.normalize_code(F.concat(F.when(F.col("key") % 3 == 0, "sh").when(F.col("key") % 3 == 1, "").otherwise(" "), F.split("code", "\\.")[0]),
                                                                  F.when(F.col("key") % 4 == 0, "bj")).alias("normal")),
    S.with_(S.UNIVERSE, """p AS (SELECT code, split_part(code, '.', 1) AS six, CASE WHEN key % 3 = 0 THEN 'sh' WHEN key % 4 = 0 THEN 'bj' ELSE '' END AS m FROM universe)""")
    + """SELECT code, six || '.' || CASE WHEN regexp_full_match(six, '[0-9]{6}') THEN CASE WHEN m = 'sh' OR left(six, 1) IN ('5', '6', '9') OR left(six, 2) = '11' THEN 'SH'
    WHEN m = 'bj' OR left(six, 1) IN ('8', '4') THEN 'BJ' ELSE 'SZ' END ELSE CASE WHEN m IN ('sh', 'bj') THEN upper(m) ELSE 'SZ' END END AS normal FROM p""")
add("code_vendor_symbols",
    lambda s, d: A.universe(s, d).select("code", K.history_symbol(F.col("code")).alias("history"), K.quote_symbol(F.col("code")).alias("quote")),
    S.with_(S.UNIVERSE) + """SELECT code, CASE code WHEN '000300.SH' THEN 'sh000300' WHEN '399006.SZ' THEN 'sz399006' WHEN 'DJI' THEN '.DJI' WHEN 'SPX' THEN '.INX' WHEN 'IXIC' THEN '.IXIC' ELSE
    CASE WHEN length(code) = 9 AND right(code, 3) IN ('.SH', '.SZ') THEN left(code, 6) END END AS history,
    CASE WHEN length(code) = 9 AND right(code, 3) = '.SH' THEN 'sh' || left(code, 6) WHEN length(code) = 9 AND right(code, 3) = '.SZ' THEN 'sz' || left(code, 6)
    WHEN code = 'DJI' THEN 'gb_dji' WHEN code = 'SPX' THEN 'gb_inx' WHEN code = 'IXIC' THEN 'gb_ixic' END AS quote FROM universe""")
add("code_from_digits",
    lambda s, d: A.universe(s, d).select("code", K.stock_code(F.substring("code", 1, 6)).alias("stock"), K.etf_code(F.substring("code", 1, 6)).alias("etf")),
    S.with_(S.UNIVERSE) + """SELECT code, left(code, 6) || CASE WHEN code LIKE '6%' THEN '.SH' ELSE '.SZ' END AS stock,
    CASE WHEN code LIKE '5%' THEN left(code, 6) || '.SH' WHEN code LIKE '1%' THEN left(code, 6) || '.SZ' END AS etf FROM universe""")
add("filter_date_range", lambda s, d: F_.date_range(A.bars(s, d), "1998-01-05", "1998-06-29"),
    S.with_(S.BARS) + f"SELECT {_COLS} FROM bars WHERE trade_date BETWEEN DATE '1998-01-05' AND DATE '1998-06-29'")
add("filter_codes_without_rows", lambda s, d: F_.codes_without_rows(A.universe(s, d).select("code"), A.bars(s, d), "2001-10-29", "2001-10-29"),
    S.with_(S.BARS, S.UNIVERSE) + "SELECT code FROM universe WHERE code NOT IN (SELECT code FROM bars WHERE trade_date = DATE '2001-10-29')")


add("filter_fill_forward_zero", lambda s, d: F_.fill_forward_zero(holes(s, d)),
    S.with_(S.BARS, HOLES) + "SELECT code, trade_date, " + ", ".join(f"coalesce(last_value({c} IGNORE NULLS) OVER ({S.W} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0) AS {c}" for c in ("open", "high", "low", "close", "vol")) + " FROM holes")


def _raw(s, d):
    """Raw rows with every kind of fault: all sources at once, some prices bent by volume."""
    src = A.sources(s, d)
    one = B.merge_bar_sources(src)
    lead = F.substring("code", 1, 3)
    bent = one.select("code", "trade_date", F.when((lead == "600") & (F.col("vol") > 120), None).otherwise(F.col("open")).alias("open"),
                      F.when((lead == "601") & (F.col("vol") > 120), F.col("low") - 1).otherwise(F.col("high")).alias("high"),
                      F.when((lead == "603") & (F.col("vol") > 120), F.lit(0.0)).otherwise(F.col("low")).alias("low"), "close", "vol")
    twice = src.filter(lead == "605").select(*_BAR)
    return bent.filter(lead != "605").unionByName(twice)


_RAW = """one AS (SELECT * FROM srcs QUALIFY row_number() OVER (PARTITION BY code, trade_date ORDER BY priority) = 1),
raw AS (SELECT code, trade_date, CASE WHEN left(code, 3) = '600' AND vol > 120 THEN NULL ELSE open END AS open, CASE WHEN left(code, 3) = '601' AND vol > 120 THEN low - 1 ELSE high END AS high,
  CASE WHEN left(code, 3) = '603' AND vol > 120 THEN 0 ELSE low END AS low, close, vol FROM one WHERE left(code, 3) <> '605'
  UNION ALL SELECT code, trade_date, open, high, low, close, vol FROM srcs WHERE left(code, 3) = '605'),
chk AS (SELECT code, count(*) AS rows, count(*) FILTER (open IS NULL) AS no, count(*) FILTER (high < greatest(open, close) OR low > least(open, close) OR high < low) AS odd,
  count(*) FILTER (open <= 0 OR high <= 0 OR low <= 0 OR close <= 0) AS low, count(*) - count(DISTINCT trade_date) AS dup FROM raw GROUP BY code)"""
add("filter_quality_check", lambda s, d: F_.quality_check(_raw(s, d)),
    S.with_(S.SOURCES, _RAW) + """SELECT code, rows, no + odd + low + dup = 0 AS passed, CASE WHEN no > 0 THEN 'null open' WHEN odd > 0 THEN 'price out of range' WHEN low > 0 THEN 'price not positive' WHEN dup > 0 THEN 'duplicate date' END AS reason,
    CASE WHEN no > 0 THEN no WHEN odd > 0 THEN odd WHEN low > 0 THEN low ELSE dup END AS bad_rows FROM chk""")
add("filter_good_rows", lambda s, d: F_.good_rows(_raw(s, d)).groupBy("code").agg(F.count("*").alias("n"), F.sum("vol").alias("vol")),
    S.with_(S.SOURCES, _RAW) + "SELECT code, count(*) AS n, sum(vol) AS vol FROM raw WHERE code IN (SELECT code FROM chk WHERE no + odd + low + dup = 0) GROUP BY code")
add("filter_market_cap", lambda s, d: F_.market_cap_filter(A.universe(s, d), 1000, 8000).select("code", "name", "total_mv"),
    S.with_(S.UNIVERSE) + "SELECT code, name, total_mv FROM universe WHERE total_mv BETWEEN 1000 AND 8000")
_IDX = ", ".join(f"('{c}', '{n}', 'index')" for c, n in TRACKED_INDEXES.items())


def _etfs(s, d):
    u = A.universe(s, d).filter("board = 'etf'")
    return u.select(F.substring_index("code", ".", 1).alias("code"), "name", F.when(F.col("key") % 2 == 0, "sz").alias("market"))


add("filter_select_universe", lambda s, d: F_.select_universe(A.universe(s, d), ["index", "hs", "cy", "etf"], 0, 9000, _etfs(s, d)),
    S.with_(S.UNIVERSE) + f"""SELECT * FROM (VALUES {_IDX}) t(code, name, type) UNION ALL
    SELECT code, name, CASE WHEN left(code, 3) IN ('300', '301') THEN 'cy' ELSE 'hs' END FROM universe WHERE total_mv BETWEEN 0 AND 9000 AND left(code, 3) <> '688' AND (left(code, 3) IN ('300', '301') OR right(code, 3) IN ('.SH', '.SZ'))
    UNION ALL SELECT split_part(code, '.', 1) || CASE WHEN key % 2 = 0 THEN '.SZ' ELSE '.SH' END, name, 'etf' FROM universe WHERE board = 'etf' AND length(split_part(code, '.', 1)) >= 6""")
add("filter_exclude_bj", lambda s, d: F_.exclude_bj(A.universe(s, d).select("code", F.col("key").alias("seq")).union(A.universe(s, d).select("code", F.col("key") + 7))),
    S.with_(S.UNIVERSE) + "SELECT code, min(key) AS seq FROM universe WHERE code NOT LIKE '%.BJ' GROUP BY code")
add("filter_list_securities", lambda s, d: F_.list_securities(A.universe(s, d).withColumn("is_st", F.col("total_mv") < 0), "hs").select("code", "name"),
    S.with_(S.UNIVERSE) + "SELECT code, name FROM universe WHERE board = 'hs' AND NOT total_mv < 0")
add("filter_search_securities", lambda s, d: F_.search_securities(A.universe(s, d), " 00001 ", 30, A.bars(s, d)).select("code", "name"),
    S.with_(S.BARS, S.UNIVERSE) + "SELECT code, name FROM universe WHERE (code LIKE '%00001%' OR upper(name) LIKE '%00001%') AND code IN (SELECT code FROM bars) ORDER BY code LIMIT 30")


def _watchlist(s, d):
    u = A.universe(s, d).filter("key % 11 = 0")
    pat = F.element_at(F.array(*map(F.lit, DAILY_BUY_ORDER)), (F.col("key") % 59).cast("int") + 1)
    return u.select("code", "name", pat.alias("pattern"), M.pattern_cn(pat).alias("pattern_cn"), F.when(F.col("key") % 2 == 0, "buy").otherwise("sell").alias("signal_type"),
                    F.when(F.col("key") % 3 == 0, "keep").otherwise(" ").alias("note"), F.date_add(F.lit("2001-01-01").cast("date"), (F.col("key") % 97).cast("int")).alias("created_at"))


_WL = f"""wl0 AS (SELECT code, name, list_extract({S._list(DAILY_BUY_ORDER)}, (key % 59 + 1)::BIGINT) AS pattern, CASE WHEN key % 2 = 0 THEN 'buy' ELSE 'sell' END AS signal_type,
  CASE WHEN key % 3 = 0 THEN 'keep' ELSE ' ' END AS note, DATE '2001-01-01' + (key % 97)::INTEGER AS created_at FROM universe WHERE key % 11 = 0), wl AS (SELECT *, {S.cn()} AS pattern_cn FROM wl0)"""
add("filter_watchlist", lambda s, d: F_.watchlist_filter(_watchlist(s, d), "buy", "CDL", True).select("code", "pattern", "signal_type", "note", "created_at"),
    S.with_(S.UNIVERSE, _WL) + "SELECT code, pattern, signal_type, note, created_at FROM wl WHERE signal_type = 'buy' AND lower(name || code || pattern_cn || pattern) LIKE '%cdl%' AND trim(note) <> ''")


_ALIAS = "CASE pattern WHEN 'CDL2CROWS' THEN 'CDLADVANCEBLOCK' ELSE pattern END"


def _few_signals(s, d):
    return D.daily_signals(A.bars(s, d), DAYS, FEW).withColumn("track_date", F.col("trade_date"))


_FEWSIG = f"ds AS (SELECT g.code, g.trade_date, CASE WHEN value > 0 THEN 'buy' ELSE 'sell' END AS side, {_ALIAS} AS pattern, value FROM sig g WHERE i >= 3 AND trade_date IN (DATE '2001-10-15', DATE '2001-10-22', DATE '2001-10-29'))"


def _known(s, d):
    return _few_signals(s, d).filter("pattern <> 'CDLDOJI' AND trade_date > DATE '2001-10-15'")


add("filter_watched", lambda s, d: F_.mark_watched(_few_signals(s, d), _known(s, d)).select("code", "trade_date", "pattern", "side", "watched"),
    S.with_(S.BARS, S.sig(FEW), _FEWSIG) + "SELECT code, trade_date, pattern, side, pattern <> 'CDLDOJI' AND trade_date > DATE '2001-10-15' AS watched FROM ds")
add("filter_not_watched", lambda s, d: F_.not_watched(_few_signals(s, d), _known(s, d)).select("code", "trade_date", "pattern", "side"),
    S.with_(S.BARS, S.sig(FEW), _FEWSIG) + "SELECT code, trade_date, pattern, side FROM ds WHERE NOT (pattern <> 'CDLDOJI' AND trade_date > DATE '2001-10-15')")


def _zero(s, d):
    return holes(s, d).select("code", "trade_date", *[F.when(F.col("vol") >= 60, F.col(c)).alias(c) for c in ("open", "high", "low", "close")], "vol")


add("filter_chart_bars", lambda s, d: F_.chart_bars(_zero(s, d), 100),
    S.with_(S.BARS, HOLES, "last AS (SELECT * FROM holes QUALIFY row_number() OVER (PARTITION BY code ORDER BY trade_date DESC) <= 100)")
    + "SELECT * FROM (SELECT code, trade_date, " + ", ".join(f"coalesce(CASE WHEN vol >= 60 THEN {c} END, 0) AS {c}" for c in ("open", "high", "low", "close")) + ", vol FROM last) WHERE NOT (open = 0 AND high = 0 AND low = 0 AND close = 0)")
_TEXTNUM = "CASE o_orderkey % 5 WHEN 0 THEN NULL WHEN 1 THEN 'NaN' WHEN 2 THEN 'x' || o_orderkey ELSE o_totalprice::VARCHAR END"
add("filter_clean_numeric",
    lambda s, d: A.table(s, d, "orders").select("o_orderkey", F_.clean_numeric(
        F.when(F.col("o_orderkey") % 5 == 1, "NaN").when(F.col("o_orderkey") % 5 == 2, F.concat(F.lit("x"), "o_orderkey")).when(F.col("o_orderkey") % 5 > 2, F.col("o_totalprice").cast("string")), -1.0).alias("v")),
    "SELECT o_orderkey, CASE WHEN o_orderkey % 5 > 2 THEN o_totalprice ELSE -1 END AS v FROM orders")


def _config(s, d):
    u = A.universe(s, d).filter("key % 5 = 0")
    few = F.explode(F.array(*[F.struct(F.lit(p).alias("p"), F.lit(i).alias("i")) for i, p in enumerate(FEW)]))
    c = u.select("code", "name", "key", few.alias("x"))
    return c.select("code", "name", F.col("x.p").alias("pattern"), F.when((F.col("key") + F.col("x.i")) % 2 == 0, "buy").otherwise("sell").alias("pattern_type"),
                    (F.col("x.i") + 1).alias("observe_day"), ((F.col("key") + F.col("x.i")) % 3 != 0).alias("enabled"))


_CFG = f"""cfg AS (SELECT code, name, f.p AS pattern, CASE WHEN (key + f.i) % 2 = 0 THEN 'buy' ELSE 'sell' END AS pattern_type, f.i + 1 AS observe_day, (key + f.i) % 3 <> 0 AS enabled
  FROM universe, (VALUES {', '.join(f"('{p}', {i})" for i, p in enumerate(FEW))}) f(p, i) WHERE key % 5 = 0)"""


def _positions(s, d):
    return A.universe(s, d).filter("key % 7 = 0").select("code", "name", F.lit(101.5).alias("cost_price"), F.lit(100).alias("shares"))


add("filter_focus_codes", lambda s, d: F_.focus_codes(_positions(s, d), _watchlist(s, d), _config(s, d)),
    S.with_(S.UNIVERSE) + "SELECT code FROM universe WHERE key % 7 = 0 OR key % 11 = 0 OR key % 5 = 0")
_PATS = ", ".join(f"('{p}')" for p in DAILY_PATTERNS)
add("filter_backtest_tasks", lambda s, d: F_.backtest_tasks(A.universe(s, d), _positions(s, d)),
    S.with_(S.UNIVERSE) + f"SELECT code, p AS pattern, side FROM universe, (VALUES {_PATS}) t(p), (VALUES ('buy'), ('sell')) q(side) WHERE side = 'buy' OR key % 7 = 0")


def _done(s, d):
    tasks = F_.backtest_tasks(A.universe(s, d).filter("key % 4 = 0"), _positions(s, d))
    other = F_.backtest_tasks(A.universe(s, d).filter("key % 4 = 1"), _positions(s, d))
    return tasks.withColumn("params_hash", F.sha1(F.lit(F_.params_key(hold=2)))).unionByName(other.withColumn("params_hash", F.sha1(F.lit(F_.params_key(hold=3)))))


add("filter_pending_tasks", lambda s, d: F_.pending_tasks(F_.backtest_tasks(A.universe(s, d), _positions(s, d)), _done(s, d), F_.params_key(hold=2)),
    S.with_(S.UNIVERSE) + f"SELECT code, p AS pattern, side FROM universe, (VALUES {_PATS}) t(p), (VALUES ('buy'), ('sell')) q(side) WHERE (side = 'buy' OR key % 7 = 0) AND key % 4 <> 0")
add("filter_configured_patterns",
    lambda s, d: F_.configured_patterns(_config(s, d)).select("code", F.concat_ws(",", F.transform("patterns", lambda x: x["pattern"])).alias("patterns"), "n", "n_buy", "n_sell"),
    S.with_(S.UNIVERSE, _CFG) + "SELECT code, string_agg(pattern, ',' ORDER BY pattern) AS patterns, count(*) AS n, count(*) FILTER (pattern_type = 'buy') AS n_buy, count(*) FILTER (pattern_type = 'sell') AS n_sell FROM cfg WHERE enabled GROUP BY code")
add("filter_replace_configs",
    lambda s, d: F_.replace_configs(_config(s, d), _config(s, d).filter("observe_day = 2").withColumn("observe_day", F.lit(9)).join(_positions(s, d).select("code"), "code", "left_semi")).select("code", "pattern", "pattern_type", "observe_day"),
    S.with_(S.UNIVERSE, _CFG) + "SELECT code, pattern, pattern_type, observe_day FROM cfg WHERE code NOT IN (SELECT code FROM universe WHERE key % 7 = 0) UNION ALL SELECT code, pattern, pattern_type, 9 FROM cfg WHERE observe_day = 2 AND code IN (SELECT code FROM universe WHERE key % 7 = 0)")

# --- D1-D15 -------------------------------------------------------------------------------------

_DAYSIG = f"""prev AS (SELECT code, trade_date, close, lag(close) OVER ({S.W}) AS pc FROM bars),
day AS (SELECT g.code, g.trade_date, CASE WHEN value > 0 THEN 'buy' ELSE 'sell' END AS side, g.pattern AS fired, {_ALIAS} AS pattern, value, close, CASE WHEN pc > 0 THEN round((close - pc) / pc * 100, 2) END AS pct_chg
  FROM sig g JOIN prev USING (code, trade_date) WHERE g.i >= 3 AND g.trade_date IN (DATE '2001-10-15', DATE '2001-10-22', DATE '2001-10-29'))"""
add("daily_signals", lambda s, d: D.daily_signals(A.bars(s, d), DAYS),
    S.with_(S.BARS, S.sig(DAILY_PATTERNS), _DAYSIG) + "SELECT code, trade_date, side, fired, pattern, value, close, pct_chg FROM day")
add("daily_errors", lambda s, d: D.day_errors(A.universe(s, d).select("code").union(s.range(1).select(F.lit("NONE.SH"))), A.bars(s, d), "2001-10-29"),
    S.with_(S.BARS, S.UNIVERSE, "req AS (SELECT code FROM universe UNION ALL SELECT 'NONE.SH')", "h AS (SELECT code, count(*) FILTER (trade_date <= DATE '2001-10-29') AS n, bool_or(trade_date = DATE '2001-10-29') AS has FROM bars GROUP BY code)")
    + "SELECT code, CASE WHEN n IS NULL THEN 'no data' WHEN NOT has THEN 'day not in data' ELSE 'fewer than 4 bars' END AS error FROM req LEFT JOIN h USING (code) WHERE n IS NULL OR NOT has OR n < 4")
_FEWDAY = (S.BARS, S.UNIVERSE, S.sig(FEW), _DAYSIG)
add("daily_sell_gate", lambda s, d: D.sell_gate(_few_signals(s, d), _positions(s, d)).select("code", "trade_date", "side", "pattern"),
    S.with_(*_FEWDAY) + "SELECT code, trade_date, side, pattern FROM day WHERE side = 'buy' OR code IN (SELECT code FROM universe WHERE key % 7 = 0)")
add("daily_sell_gate_empty", lambda s, d: D.sell_gate(_few_signals(s, d), _positions(s, d).filter("shares < 0")).select("code", "trade_date", "side", "pattern"),
    S.with_(*_FEWDAY) + "SELECT code, trade_date, side, pattern FROM day")
_PERFJ = _SCAN_FEW[:-1] + ",\n" + ",\n".join([S.UNIVERSE, _DAYSIG]) + "\n"


def _judged(s, d):
    return D.attach_performance(_few_signals(s, d), few_scan(s, d).filter("pattern <> 'CDLSHORTLINE'"))


add("daily_attach_performance", lambda s, d: _judged(s, d).select("code", "trade_date", "side", "pattern", "win_rate", "return_pct", "sharpe", "max_drawdown", "trades", "no_perf_data"),
    _PERFJ + "SELECT g.code, g.trade_date, g.side, g.pattern, win_rate, return_pct, sharpe, max_drawdown, trades, p.code IS NULL AS no_perf_data FROM day g LEFT JOIN scan p ON p.code = g.code AND p.side = g.side AND p.pattern = g.pattern AND p.pattern <> 'CDLSHORTLINE'")
_MKT = f"mkt AS (SELECT pattern, side, sum(win_rate * trades) / sum(trades) AS w, sum(return_pct * trades) / sum(trades) AS r, CAST(sum(trades) AS BIGINT) AS t FROM scan WHERE {S.group_of()} <> 'etf' GROUP BY pattern, side)"
add("daily_attach_market",
    lambda s, d: D.attach_market(_few_signals(s, d), M.market_wide_stats(few_scan(s, d))).select("code", "trade_date", "side", "pattern", "pattern_cn", F.round("market_win_rate", 4).alias("market_win_rate"), F.round("market_return", 4).alias("market_return"), "market_trade_count"),
    _PERFJ[:-1] + ", " + _MKT + f" SELECT g.code, g.trade_date, g.side, g.pattern, {S.cn('g.pattern')} AS pattern_cn, round(coalesce(w, CASE WHEN t IS NOT NULL THEN 0 END), 4) AS market_win_rate, round(coalesce(r, CASE WHEN t IS NOT NULL THEN 0 END), 4) AS market_return, t AS market_trade_count FROM day g LEFT JOIN mkt m USING (pattern, side)")
_TIER = "CASE WHEN g.side = 'sell' THEN NULL WHEN p.trades >= 10 AND p.return_pct > 0 AND p.win_rate >= 70 THEN 'strong' WHEN p.trades >= 10 AND p.return_pct > 0 AND p.win_rate >= 60 THEN 'recommend' ELSE 'other' END"
_GJ = "day g LEFT JOIN scan p ON p.code = g.code AND p.side = g.side AND p.pattern = g.pattern AND p.pattern <> 'CDLSHORTLINE'"
add("daily_tier", lambda s, d: D.tier(_judged(s, d)).select("code", "trade_date", "side", "pattern", "tier"), _PERFJ + f"SELECT g.code, g.trade_date, g.side, g.pattern, {_TIER} AS tier FROM {_GJ}")
for _mode in ("full", "directional", "configured_only"):
    _keep = {"full": "true", "directional": f"({S.short_index('g.code')} OR NOT EXISTS (SELECT 1 FROM on_ c WHERE c.code = g.code) OR EXISTS (SELECT 1 FROM on_ c WHERE c.code = g.code AND c.pattern = g.fired AND c.pattern_type = g.side))",
             "configured_only": f"({S.short_index('g.code')} OR EXISTS (SELECT 1 FROM on_ c WHERE c.code = g.code AND c.pattern = g.fired AND c.pattern_type = g.side))"}[_mode]
    add(f"daily_track_{_mode}", lambda s, d, m=_mode: D.track_mode(_few_signals(s, d), _config(s, d), m).select("code", "trade_date", "side", "fired"),
        S.with_(*_FEWDAY, _CFG, "on_ AS (SELECT * FROM cfg WHERE enabled)") + f"SELECT code, trade_date, side, fired FROM day g WHERE {_keep}")
add("daily_track_groups",
    lambda s, d: D.track_groups("all", A.universe(s, d).filter(K.is_index_short(F.col("code"))), A.universe(s, d).filter("board = 'hs'"), _positions(s, d), _watchlist(s, d)),
    S.with_(S.UNIVERSE, f"""g AS (SELECT code, 'index' AS grp, 1 AS r FROM universe WHERE {S.short_index()} UNION ALL SELECT code, 'stock', 2 FROM universe WHERE board = 'hs'
    UNION ALL SELECT code, CASE WHEN {S.short_index()} THEN 'target index' ELSE 'target stock' END, CASE WHEN {S.short_index()} THEN 3 ELSE 4 END FROM universe WHERE key % 11 = 0)""")
    + f"SELECT code, arg_min(grp, r) AS grp, {S.short_index()} AS is_index FROM g WHERE code NOT LIKE '%.BJ' GROUP BY code")
add("daily_recent_signals", lambda s, d: D.recent_signals(_few_signals(s, d), "2001-10-27", 7).groupBy("trade_date", "side").agg(F.count("*").alias("n")),
    S.with_(*_FEWDAY, "cal AS (SELECT CAST(unnest(generate_series(DATE '2001-10-01', DATE '2001-10-27', INTERVAL 1 DAY)) AS DATE) AS c), wk AS (SELECT c FROM cal WHERE isodow(c) < 6 ORDER BY c DESC LIMIT 7)")
    + "SELECT trade_date, side, count(*) AS n FROM day WHERE trade_date IN (SELECT c FROM wk) GROUP BY ALL")
add("daily_consecutive", lambda s, d: D.consecutive(_few_signals(s, d)).select("code", "trade_date", "side", "pattern", "is_consecutive"),
    S.with_(*_FEWDAY) + "SELECT code, trade_date, side, pattern, count(*) OVER (PARTITION BY code, side) >= 2 AS is_consecutive FROM day")


def _year_signals(s, d):
    b = A.bars(s, d)
    return candles.signals(b, FEW).select("code", "trade_date", "pattern", "value").join(b.select("code", "trade_date", "close"), ["code", "trade_date"])


add("daily_follow_up", lambda s, d: D.follow_up(_year_signals(s, d), A.bars(s, d)),
    S.with_(S.BARS, S.sig(FEW), f"f AS (SELECT code, trade_date, close, last_value(close) OVER aft AS l, max(close) OVER aft AS hi, min(close) OVER aft AS lo, count(*) OVER aft AS n FROM bars WINDOW aft AS ({S.W} ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING))")
    + "SELECT g.code, g.trade_date, g.pattern, g.value, f.close, CASE WHEN n > 0 THEN round((l - close) / close * 100, 2) END AS followup_return, CASE WHEN n > 0 THEN round((hi - close) / close * 100, 2) END AS followup_max, "
      "CASE WHEN n > 0 THEN round((lo - close) / close * 100, 2) END AS followup_min, n AS followup_days FROM sig g JOIN f USING (code, trade_date)")
add("daily_legacy_filter", lambda s, d: D.legacy_filter(_judged(s, d)).select("code", "trade_date", "side", "pattern", "win_rate", "return_pct"),
    _PERFJ + f"SELECT g.code, g.trade_date, g.side, g.pattern, win_rate, return_pct FROM {_GJ} WHERE win_rate > 50 AND return_pct > 0")
add("daily_position_quotes", lambda s, d: D.position_quotes(_positions(s, d), A.bars(s, d)).select("code", "current", "pct_chg", "quote_date"),
    S.with_(S.BARS, S.UNIVERSE, f"p AS (SELECT code, trade_date, close, lag(close) OVER ({S.W}) AS pc FROM bars QUALIFY row_number() OVER (PARTITION BY code ORDER BY trade_date DESC) = 1)")
    + "SELECT u.code, close AS current, round((close - pc) / pc * 100, 4) AS pct_chg, trade_date AS quote_date FROM universe u LEFT JOIN p USING (code) WHERE key % 7 = 0")
add("daily_last_weekday", lambda s, d: A.table(s, d, "orders").select("o_orderkey", D.last_weekday(F.to_date("o_orderdate")).alias("day")),
    "SELECT o_orderkey, CAST(o_orderdate AS DATE) - CASE WHEN isodow(o_orderdate) > 5 THEN isodow(o_orderdate) - 5 ELSE 0 END::INTEGER AS day FROM orders")


def _loads(s, d):
    new = few_scan(s, d)
    return new.withColumn("return_pct", F.lit(-99.0)).withColumn("load", F.lit(1)).unionByName(new.withColumn("load", F.lit(2)))


add("daily_security_performance", lambda s, d: D.security_performance(_loads(s, d), A.universe(s, d), "load"),
    _SCAN_FEW[:-1] + f", {S.UNIVERSE} SELECT code, coalesce(name, '') AS name, {S.group_of()} AS type, side, side || '_' || pattern AS strategy, {S.cn()} AS pattern_cn, win_rate, return_pct, sharpe, max_drawdown, trades FROM scan LEFT JOIN universe USING (code)")
add("daily_retry_set", lambda s, d: D.retry_set(A.universe(s, d).select("code"), _few_signals(s, d)),
    S.with_(*_FEWDAY) + "SELECT code FROM universe WHERE code NOT IN (SELECT code FROM day)")
add("daily_retry_set_of_day", lambda s, d: D.retry_set(A.universe(s, d).select("code"), A.bars(s, d).filter(F.col("trade_date") == END)),
    S.with_(S.BARS, S.UNIVERSE) + f"SELECT code FROM universe WHERE code NOT IN (SELECT code FROM bars WHERE trade_date = DATE '{END}')")
add("metric_tracking_summary",
    lambda s, d: M.tracking_summary(D.tier(_judged(s, d)), A.universe(s, d).select("code", K.is_index_short(F.col("code")).alias("is_index"), (F.col("board") == "excluded").alias("failed"))),
    _PERFJ[:-1] + f""", t AS (SELECT g.code, g.side, p.win_rate, {_TIER} AS tier FROM {_GJ})
    SELECT (SELECT count(*) FROM universe) AS total, (SELECT count(*) FROM universe WHERE board <> 'excluded') AS success, (SELECT count(*) FROM universe WHERE board = 'excluded') AS failed,
    (SELECT count(*) FROM universe WHERE {S.short_index()}) AS index_count, (SELECT count(*) FROM universe WHERE NOT {S.short_index()}) AS stock_count, count(DISTINCT code) AS codes_with_signals,
    count(*) FILTER (side = 'buy') AS buy_count, count(*) FILTER (tier = 'strong') AS strong_buy_count, count(*) FILTER (tier = 'recommend') AS recommend_buy_count, count(*) FILTER (tier = 'other') AS other_buy_count,
    count(*) FILTER (side = 'sell') AS sell_count, round(avg(win_rate) FILTER (side = 'buy'), 2) AS avg_win_rate FROM t""")

# --- whole flows ----------------------------------------------------------------------------------

add("flow_market_update", lambda s, d: P.market_update(A.bars(s, d), A.universe(s, d), _positions(s, d), patterns=FEW),
    _SCAN_FEW[:-1] + f", {S.UNIVERSE} SELECT code, side || '_' || pattern AS strategy, side, pattern, trades, win_rate, return_pct, sharpe, max_drawdown FROM scan JOIN universe USING (code) WHERE side = 'buy' OR key % 7 = 0")
add("flow_daily_tracking",
    lambda s, d: P.daily_tracking(A.bars(s, d), DAYS, few_scan(s, d).filter("pattern <> 'CDLSHORTLINE'"), M.market_wide_stats(few_scan(s, d)), _positions(s, d), _config(s, d), "directional", patterns=FEW)
    .select("code", "trade_date", "side", "pattern", "pct_chg", "win_rate", "no_perf_data", "market_trade_count", "tier", "followup_return", "followup_days"),
    _PERFJ[:-1] + f""", {_CFG}, on_ AS (SELECT * FROM cfg WHERE enabled), {_MKT},
    f AS (SELECT code, trade_date, close, last_value(close) OVER aft AS l, count(*) OVER aft AS n FROM bars WINDOW aft AS ({S.W} ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING))
    SELECT g.code, g.trade_date, g.side, g.pattern, g.pct_chg, p.win_rate, p.code IS NULL AS no_perf_data, m.t AS market_trade_count, {_TIER} AS tier,
    CASE WHEN f.n > 0 THEN round((f.l - f.close) / f.close * 100, 2) END AS followup_return, f.n AS followup_days
    FROM {_GJ} LEFT JOIN mkt m ON m.pattern = g.pattern AND m.side = g.side JOIN f ON f.code = g.code AND f.trade_date = g.trade_date
    WHERE (g.side = 'buy' OR g.code IN (SELECT code FROM universe WHERE key % 7 = 0)) AND ({S.short_index('g.code')} OR NOT EXISTS (SELECT 1 FROM on_ c WHERE c.code = g.code)
      OR EXISTS (SELECT 1 FROM on_ c WHERE c.code = g.code AND c.pattern = g.fired AND c.pattern_type = g.side))""")
_BT = (S.BARS, S.sig(tuple(dict.fromkeys(_BUYS + _SELLS))))
add("flow_backtest", lambda s, d: P.backtest(A.bars(s, d), _BUYS, _SELLS).select("code", "total_return", "total_trades", "win_rate", "sharpe", "max_drawdown", "real_return", "buy_hold_return", "hold_ratio"),
    S.with_(*_BT, _renamed(S.outcomes(), "_1"), _renamed(S.CAND, "_1").replace("FROM sig", "FROM sig"),
            f"cand1f AS (SELECT * FROM cand_1 WHERE (side = 'buy' AND pattern IN {_BUYS}) OR (side = 'sell' AND pattern IN {_SELLS}))",
            _renamed(S.walk(), "_1").replace("FROM cand_1 a", "FROM cand1f a").replace("JOIN cand_1 b", "JOIN cand1f b"),
            *[c for c in _COMB[2:]], S.equity(("code",)),
            """pct1 AS (SELECT code, exit_i - e AS hd, round(CASE WHEN side = 'buy' THEN exit_price / entry_price - 1 ELSE entry_price / exit_price - 1 END * 100, 2) AS p FROM trades_1),
            one AS (SELECT code, round(sum(p), 2) AS total_return, count(*) AS total_trades, round_even(count(*) FILTER (p > 0) / count(*) * 100, 0) AS win_rate, sum(hd) AS hd FROM pct1 GROUP BY code),
            fin AS (SELECT code, round((cash_out / 1e8::DOUBLE - 1) * 100, 2) AS real_return FROM trades QUALIFY row_number() OVER (PARTITION BY code ORDER BY trade_no DESC) = 1),
            bh AS (SELECT code, round((last(close ORDER BY trade_date) / first(close ORDER BY trade_date) - 1) * 100, 2) AS buy_hold_return, count(*) AS n FROM bars GROUP BY code)""", recursive=True)
    + "SELECT code, total_return, total_trades, win_rate, sharpe, max_drawdown, real_return, buy_hold_return, round(hd / n, 4) AS hold_ratio FROM one JOIN acct USING (code) JOIN fin USING (code) JOIN bh USING (code)".replace("win_rate, sharpe", "one.win_rate, sharpe"))

# --- a store on files -----------------------------------------------------------------------------

_STORES: dict = {}


def _store(s, d):
    """A store of two loads that overlap; codes of one board section are suspended for two years, so they lack recent bars. Returns its
    path and what the first load refused."""
    key = (s.sparkContext.applicationId, d)
    if key not in _STORES:
        path = f"{shared_folder(s)}/bars-{uuid.uuid4().hex}"
        bars = A.bars(s, d).filter("NOT (code LIKE '600%' AND trade_date BETWEEN DATE '1999-06-01' AND DATE '2001-10-08')")
        B.upsert_bars(s, path, bars.filter("trade_date < DATE '2001-09-20'").withColumn("close", F.when(F.col("trade_date") < "2001-09-01", F.col("close")).otherwise(F.col("low"))))
        B.upsert_bars(s, path, bars.filter("trade_date >= DATE '2001-09-01'"))
        _STORES[key] = path
    return _STORES[key]


_HELD = S.BARS.replace("bars AS (", "bars0 AS (") + ", bars AS (SELECT * FROM bars0 WHERE code NOT LIKE '%.BJ' AND NOT (code LIKE '600%' AND trade_date BETWEEN DATE '1999-06-01' AND DATE '2001-10-08'))"
add("store_read_bars", lambda s, d: B.read_bars(s, _store(s, d), "1997-03-15", "2001-10-10").select(*_BAR, "board"),
    S.with_(_HELD) + f"SELECT {_COLS}, {S.board_of()} AS board FROM bars WHERE trade_date BETWEEN DATE '1997-03-15' AND DATE '2001-10-10'")
add("store_zones", lambda s, d: B.zones(s, _store(s, d)).select("code", F.col("ym").cast("int").alias("ym"), "bars", "first_date", "last_date"),
    S.with_(_HELD) + "SELECT code, strftime(trade_date, '%Y%m')::INT AS ym, count(*) AS bars, min(trade_date) AS first_date, max(trade_date) AS last_date FROM bars GROUP BY ALL")
add("store_coverage", lambda s, d: B.read_coverage(s, _store(s, d)),
    S.with_(_HELD) + """SELECT code, min(trade_date) AS min_date, max(trade_date) AS max_date, CASE WHEN max(trade_date) >= DATE '2001-09-01' THEN count(*) FILTER (trade_date >= DATE '2001-09-01')
    ELSE count(*) FILTER (trade_date < DATE '2001-09-20') END AS row_count FROM bars GROUP BY code""")
add("store_daily_signals", lambda s, d: D.daily_signals(B.recent_bars(s, _store(s, d), DAYS), DAYS),
    S.with_(_HELD, S.sig(DAILY_PATTERNS), _DAYSIG) + "SELECT code, trade_date, side, fired, pattern, value, close, pct_chg FROM day")
add("store_daily_tracking",
    lambda s, d: P.daily_tracking_of(s, _store(s, d), DAYS, few_scan(s, d).filter("pattern <> 'CDLSHORTLINE'"), M.market_wide_stats(few_scan(s, d)), _positions(s, d), _config(s, d), "full", patterns=FEW)
    .select("code", "trade_date", "side", "pattern", "pct_chg", "followup_return", "followup_days"),
    S.with_(_HELD, S.UNIVERSE, S.sig(FEW), _DAYSIG, f"f AS (SELECT code, trade_date, close, last_value(close) OVER aft AS l, count(*) OVER aft AS n FROM bars WINDOW aft AS ({S.W} ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING))")
    + """SELECT g.code, g.trade_date, g.side, g.pattern, g.pct_chg, CASE WHEN f.n > 0 THEN round((f.l - f.close) / f.close * 100, 2) END AS followup_return, f.n AS followup_days
    FROM day g JOIN f ON f.code = g.code AND f.trade_date = g.trade_date WHERE g.side = 'buy' OR g.code IN (SELECT code FROM universe WHERE key % 7 = 0)""")

# --- ST1, ST2 on tables ---------------------------------------------------------------------------


def _ticks(s, d):
    return A.table(s, d, "events").select(F.col("event_type").alias("code"), "ts", F.col("value").alias("price"), F.col("event_id").alias("seq"))


add("stream_latest_quotes", lambda s, d: N.latest_quotes(_ticks(s, d)).select("code", F.to_date("window_start").alias("day"), "price", "seq"),
    "SELECT event_type AS code, CAST(ts AS DATE) AS day, arg_max(value, ts) AS price, arg_max(event_id, ts) AS seq FROM events GROUP BY 1, 2")
add("stream_ticks_to_bars", lambda s, d: N.ticks_to_bars(_ticks(s, d)),
    "SELECT event_type AS code, CAST(ts AS DATE) AS trade_date, arg_min(value, event_id) AS open, max(value) AS high, min(value) AS low, arg_max(value, event_id) AS close, count(*) AS ticks FROM events GROUP BY 1, 2")


def _latest_table(s, d):
    """The events as a stream of ticks, kept as a table of the newest one of each kind."""
    path, events = f"{shared_folder(s)}/latest-{uuid.uuid4().hex}", A.table(s, d, "events")
    stream = s.readStream.schema(events.schema).parquet(f"{d}/events.parquet*")  # a file or a folder; a stream takes a pattern for either
    ticks = stream.select(F.col("event_type").alias("code"), "ts", F.col("value").alias("price"), F.col("event_id").alias("seq"))
    N.latest_table_stream(ticks, f"{path}/table", f"{path}/checkpoint").awaitTermination()
    return N.read_latest(s, f"{path}/table").select("code", "ts", "price", "seq")


add("stream_latest_table", _latest_table, "SELECT event_type AS code, max(ts) AS ts, arg_max(value, ts) AS price, arg_max(event_id, ts) AS seq FROM events GROUP BY 1")

"""Store, files, text parsing, coverage and streams on small hand-made inputs."""

import datetime as dt
import json
import os

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from wickspark import adapters as A
from wickspark.functions.pick import pick_row
from wickspark.model import BAR_SCHEMA
from wickspark.operators import daily as D_, metrics as M_, ordered, selection as F_
from wickspark.sources import bars as B, files as X, text as Q
from wickspark.streaming import ingest as N

D = dt.date


def bar(code, day, close, **kw):
    row = {f.name: None for f in BAR_SCHEMA.fields}
    row.update(code=code, trade_date=day, open=close, high=close + 1, low=close - 1, close=close, vol=10.0)
    row.update(kw)
    return tuple(row[f.name] for f in BAR_SCHEMA.fields)


def frame(spark, rows):
    return spark.createDataFrame(rows, BAR_SCHEMA)


def test_upsert_rewrites_only_touched_months(spark, folder):
    path = f"{folder}/store"
    B.upsert_bars(spark, path, frame(spark, [bar("600000.SH", D(2024, 1, 5), 10.0), bar("600000.SH", D(2024, 2, 5), 11.0), bar("830001.BJ", D(2024, 2, 5), 11.0)]))
    january = f"{path}/board=hs/ym=202401"
    before = sorted(os.listdir(january))
    B.upsert_bars(spark, path, frame(spark, [bar("600000.SH", D(2024, 2, 5), 12.0), bar("600001.SH", D(2024, 2, 6), 7.0)]))
    assert sorted(os.listdir(january)) == before
    rows = {(r.code, r.trade_date): r.close for r in B.read_bars(spark, path).collect()}
    assert rows == {("600000.SH", D(2024, 1, 5)): 10.0, ("600000.SH", D(2024, 2, 5)): 12.0, ("600001.SH", D(2024, 2, 6)): 7.0}
    covered = {(r.code, r.min_date, r.max_date, r.row_count) for r in B.read_coverage(spark, path + "/").collect()}
    assert covered == {("600000.SH", D(2024, 1, 5), D(2024, 2, 5), 1), ("600001.SH", D(2024, 2, 6), D(2024, 2, 6), 1)}
    part = B.read_bars(spark, path, "2024-02-01", "2024-02-05")
    assert part.count() == 1
    plan = part._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(ym" in plan and "GreaterThanOrEqual(trade_date" in plan


def test_upsert_keeps_last_load_and_refuses_bad_codes(spark, folder):
    new = frame(spark, [bar("600000.SH", D(2024, 1, 5), 10.0), bar("600002.SH", D(2024, 1, 5), 5.0, high=1.0)])
    out = B.upserted(None, new)
    assert [r.code for r in out.collect()] == ["600000.SH"]
    seq = frame(spark, [bar("600000.SH", D(2024, 1, 5), 10.0)]).selectExpr("*", "2 AS load")
    assert [r.close for r in B.upserted(frame(spark, [bar("600000.SH", D(2024, 1, 5), 9.0)]), seq, "load").collect()] == [10.0]
    unknown = frame(spark, [bar("600000.SH", D(2024, 1, 5), 10.0)]).selectExpr("*", "CAST(NULL AS INT) AS load")
    assert [r.close for r in B.upserted(None, unknown, "load").collect()] == [10.0]


def test_a_source_that_reaches_the_end_beats_partial_ones(spark):
    rows = [(bar("600000.SH", D(2024, 1, 5), 1.0), 900), (bar("600000.SH", D(2024, 2, 5), 2.0), 950)]
    asked = frame(spark, [r for r, _ in rows]).selectExpr("*", "IF(close = 1, 900, 950) AS priority", "false AS is_local")
    assert [r.close for r in B.choose_source(asked, "2024-02-01").collect()] == [2.0]


@pytest.mark.parametrize("fault,reason", [
    ({"open": None}, "null open"), ({"high": 3.0}, "price out of range"), ({"low": -1.0, "open": 0.0}, "price not positive")])
def test_quality_reasons(spark, fault, reason):
    rows = [bar("600000.SH", D(2024, 1, 5), 10.0), bar("600000.SH", D(2024, 1, 8), 10.0, **fault)]
    r = F_.quality_check(frame(spark, rows)).first()
    assert (r.passed, r.reason, r.bad_rows) == (False, reason, 1)


def test_quality_duplicate(spark):
    rows = [bar("600000.SH", D(2024, 1, 5), 10.0)] * 3
    r = F_.quality_check(frame(spark, rows)).first()
    assert (r.reason, r.bad_rows) == ("duplicate date", 2)


def test_month_edge_coverage(spark):
    cov = B.coverage(frame(spark, [bar("600000.SH", D(2024, 3, 4), 10.0), bar("600000.SH", D(2024, 5, 31), 10.0)]))
    req = spark.createDataFrame([("600000.SH", D(2024, 2, 25), D(2024, 6, 3)), ("600000.SH", D(2024, 2, 20), D(2024, 6, 3)), ("000001.SZ", D(2024, 3, 1), D(2024, 3, 2))],
                                "code string, start date, end date")
    got = {(r.code, r.start): r.covered for r in B.check_coverage(cov, req).collect()}
    assert got == {("600000.SH", D(2024, 2, 25)): True, ("600000.SH", D(2024, 2, 20)): False, ("000001.SZ", D(2024, 3, 1)): False}
    assert B.missing_codes(req, cov).count() == 2


def test_sources_priority_and_choice(spark):
    a = frame(spark, [bar("600000.SH", D(2024, 1, 5), 1.0)])
    b = frame(spark, [bar("600000.SH", D(2024, 1, 5), 2.0), bar("600000.SH", D(2024, 1, 8), 3.0)])
    merged = B.merge_bar_sources(B.union_sources(a, b))
    assert sorted(r.close for r in merged.collect()) == [1.0, 3.0]
    asked = B.union_sources(a, b).selectExpr("*", "priority = 1 AS is_local")
    assert sorted(r.close for r in B.choose_source(asked, "2024-01-08").collect()) == [2.0, 3.0]
    # nobody reaches the end: the last one asked is the base, a newer local one adds its tail and wins its dates
    local_first = B.union_sources(b, a).selectExpr("*", "priority = 0 AS is_local")
    assert sorted(r.close for r in B.choose_source(local_first, "2024-02-01").collect()) == [2.0, 3.0]


def test_top_up(spark):
    bars = frame(spark, [bar("600000.SH", D(2024, 1, 5), 1.0), bar("600001.SH", D(2024, 1, 8), 2.0)])
    quotes = frame(spark, [bar("600000.SH", D(2024, 1, 8), 9.0), bar("600001.SH", D(2024, 1, 8), 9.0)])
    assert sorted((r.code, r.close) for r in B.top_up_latest(bars, quotes, "2024-01-08").collect()) == [
        ("600000.SH", 1.0), ("600000.SH", 9.0), ("600001.SH", 2.0)]


def test_csv_to_parquet(spark, folder):
    os.makedirs(f"{folder}/csv")
    for i in (1, 2):
        with open(f"{folder}/csv/c{i}_daily.csv", "w") as f:
            f.write("code,close\n" + "".join(f"60000{i}.SH,{k}.5\n" for k in range(i * 3)))
    rep = X.csv_to_parquet(spark, f"{folder}/csv", f"{folder}/pq", StructType.fromDDL("code string, close double"))
    rows = rep.collect()
    assert sorted((r.csv_rows, r.parquet_rows, r.verified) for r in rows) == [(3, 3, True), (6, 6, True)]


def test_performance_and_summary_files(spark, folder):
    perf = spark.createDataFrame([("a", "buy", "P", 1), ("a", "sell", "P", 2)], "code string, side string, pattern string, trades int")
    X.write_performance(X.merged_performance(None, perf), f"{folder}/perf")
    again = X.merged_performance(spark.read.parquet(f"{folder}/perf"), perf.selectExpr("code", "side", "pattern", "trades + 10 AS trades").filter("side = 'buy'"))
    assert sorted((r.side, r.trades) for r in again.collect()) == [("buy", 11), ("sell", 2)]
    sig = spark.createDataFrame([("a", D(2024, 1, 5), "buy", "P", 1.0), ("a", D(2024, 1, 5), "sell", "Q", 1.0)],
                                "code string, trade_date date, side string, pattern string, close double")
    for _ in range(2):
        X.write_summary(X.daily_summary(sig), f"{folder}/sum")
    (day,) = [p for p in os.listdir(f"{folder}/sum") if p.startswith("trade_date=")]
    lines = [json.loads(x) for p in os.listdir(f"{folder}/sum/{day}") if p.endswith(".json") for x in open(f"{folder}/sum/{day}/{p}")]
    assert len(lines) == 1 and lines[0]["buy_count"] == 1 and len(lines[0]["signals"]) == 2


def test_quote_lines(spark):
    share = ["n", "10.1", "0", "10.3", "10.9", "10.0", "0", "0", "12345"] + ["0"] * 21 + ["2024-01-05", "15:00:00", "00"]
    us = ["n", "37000", "0", "2024-01-06 03:10:00", "0", "36900", "37100", "36800", "0", "0", "777"]
    rows = [f'var hq_str_sh600000="{",".join(share)}";', f'var hq_str_gb_dji="{",".join(us)}";', 'var hq_str_sh600001="";', "noise",
            f'var hq_str_sz000001="{",".join(share[:20])}";']
    got = {r.symbol: (r.trade_date, r.open, r.high, r.low, r.close, r.vol) for r in Q.parse_quote_lines(spark.createDataFrame([(x,) for x in rows], "value string")).collect()}
    assert got == {"sh600000": (D(2024, 1, 5), 10.1, 10.9, 10.0, 10.3, 12345.0), "gb_dji": (D(2024, 1, 5), 36900.0, 37100.0, 36800.0, 37000.0, 777.0)}


def log(code, msg):
    return f"2024-01-05 10:30:00 跟踪日：2024-01-05 - {code} - 名称: {msg}"


def test_tracking_blocks(spark):
    perf = "策略在该股的交易次数：9, 胜率(%)：71.0, 简易收益率(%)：-1.5"
    lines = [log("a", "买入原因：x(buy_signal_CDLDOJI)"), log("a", "触发形态：x"), log("a", perf),   # whole block
             log("a", "其他"), log("a", perf),                                                # detail after a break: no block
             log("a", "卖出提示：次日达到买入天数_2天"), log("b", perf),                             # detail of another code
             log("b", "卖出提示：sell_signal_CDLHARAMI"), "noise", log("b", perf),
             log("a", "买入原因：x(buy_signal_CDLDOJI)"), log("a", "触发形态：x"), log("a", perf)]   # the first block again
    df = spark.createDataFrame([("f", i, x) for i, x in enumerate(lines)], "file string, line_no long, value string")
    got = sorted((r.line_no, r.code, r.side, r.pattern, r.win_rate, r.return_pct, r.lines) for r in Q.tracking_blocks(df).collect())
    assert got == [(0, "a", "buy", "CDLDOJI", 71.0, -1.5, 3), (5, "a", "sell", None, None, None, 1), (7, "b", "sell", "CDLHARAMI", None, None, 1)]


def test_two_level_scan(spark):
    df = spark.range(0, 1000).selectExpr("'g' AS g", "id AS pos", "IF(id % 97 = 5, id, NULL) AS v")
    rows = ordered.running_max(ordered.with_previous(df, "g", "pos", {"p": "v"}, 64), "g", "pos", {"m": "v"}, 64).orderBy("pos").collect()
    top = None
    for i, r in enumerate(rows):
        v = i if i % 97 == 5 else None
        top = v if v is not None else top
        assert (r.pos, r.m, r.p) == (i, top, i - 1 if i and (i - 1) % 97 == 5 else None)


def test_ingest_stream_resumes(spark, folder):
    land, store, cp = f"{folder}/land", f"{folder}/store", f"{folder}/cp"
    frame(spark, [bar("600000.SH", D(2024, 1, 5), 10.0)]).write.mode("append").parquet(land)
    N.ingest_bars_stream(spark, land, store, cp).awaitTermination()
    frame(spark, [bar("600000.SH", D(2024, 1, 5), 11.0), bar("600000.SH", D(2023, 12, 5), 9.0)]).write.mode("append").parquet(land)
    N.ingest_bars_stream(spark, land, store, cp).awaitTermination()
    assert sorted((r.trade_date, r.close) for r in spark.read.parquet(store).collect()) == [(D(2023, 12, 5), 9.0), (D(2024, 1, 5), 11.0)]


def test_ingest_does_not_depend_on_batches(spark, folder):
    """Files that overlap, one with a repeated day (refused as a whole code), read one, two or all at a time."""
    land = f"{folder}/land"
    loads = [[bar("600000.SH", D(2024, 1, 5), 10.0), bar("600001.SH", D(2024, 1, 5), 5.0)], [bar("600000.SH", D(2024, 1, 5), 11.0), bar("600000.SH", D(2024, 1, 8), 12.0)],
             [bar("600001.SH", D(2024, 1, 5), 6.0)] * 2 + [bar("600000.SH", D(2024, 1, 8), 13.0)], [bar("600001.SH", D(2024, 2, 5), 7.0)]]
    for rows in loads:
        frame(spark, rows).coalesce(1).write.mode("append").parquet(land)
    stores, refused, covered = [], [], []
    for n in (1, 2, 1000):
        N.ingest_bars_stream(spark, land, f"{folder}/store{n}", f"{folder}/cp{n}", max_files=n).awaitTermination()
        stores.append(sorted((r.code, r.trade_date, r.close) for r in B.read_bars(spark, f"{folder}/store{n}").collect()))
        covered.append(sorted((r.code, r.min_date, r.max_date, r.row_count) for r in B.read_coverage(spark, f"{folder}/store{n}").collect()))
        refused.append(sorted((r.load, r.code, r.reason, r.rows) for r in spark.read.parquet(f"{folder}/store{n}_rejected").collect()))
    assert stores[0] == [("600000.SH", D(2024, 1, 5), 11.0), ("600000.SH", D(2024, 1, 8), 13.0), ("600001.SH", D(2024, 1, 5), 5.0), ("600001.SH", D(2024, 2, 5), 7.0)]
    assert stores[1] == stores[0] == stores[2]
    assert covered[0] == [("600000.SH", D(2024, 1, 5), D(2024, 1, 8), 1), ("600001.SH", D(2024, 1, 5), D(2024, 2, 5), 1)]
    assert covered[1] == covered[0] == covered[2]
    assert [r[1:] for r in refused[0]] == [("600001.SH", "duplicate date", 2)] and refused[0] == [(r[0], *r[1:]) for r in refused[1]] == refused[2]


def test_latest_quote_stream(spark, folder):
    ticks = spark.sql("SELECT 'a' AS code, timestamp'2024-01-05 10:00:00' AS ts, 1D AS price, 1L AS seq UNION ALL "
                      "SELECT 'a', timestamp'2024-01-05 11:00:00', 2D, 2L UNION ALL SELECT 'b', timestamp'2024-01-06 09:00:00', 3D, 3L")
    ticks.write.parquet(f"{folder}/t")
    live = spark.readStream.schema(ticks.schema).parquet(f"{folder}/t")
    q = N.latest_quotes(live).writeStream.outputMode("update").format("memory").queryName("quotes").start()
    q.processAllAvailable()
    q.stop()
    assert sorted((r.code, r.price) for r in spark.table("quotes").collect()) == [("a", 2.0), ("b", 3.0)]
    assert sorted((r.code, r.price) for r in N.latest_quotes(ticks).collect()) == [("a", 2.0), ("b", 3.0)]


def test_vendor_layouts(spark):
    lots = spark.createDataFrame([("600000.SH", "20240105", 1.0, 2.0, 0.5, 1.5, 3.0, 4.0, 5.0)], "ts_code string, trade_date string, open double, high double, low double, close double, vol double, amount double, pct_chg double")
    r = B.normalize_vendor(lots, "stock_lots").first()
    assert (r.trade_date, r.vol, r.turnover_rate) == (D(2024, 1, 5), 300.0, None)
    assert B.normalize_vendor(lots, "index_lots").first().vol == 3.0  # an index comes in shares
    frac = spark.createDataFrame([("600000.SH", "2024-01-05", 1.0, 2.0, 0.5, 1.5, 3.0, 0.25)], "code string, date string, open double, high double, low double, close double, volume double, turnover double")
    assert B.normalize_vendor(frac, "stock_fraction").first().turnover_rate == 25.0


def test_update_log_appends(spark, folder):
    row = spark.createDataFrame([("t1", "600000.SH", "ok", 3)], "task_id string, code string, status string, rows_added int")
    for _ in range(2):
        B.append_update_log(row, f"{folder}/log")
    assert spark.read.parquet(f"{folder}/log").count() == 2


# --- the store: zones, pruning, recovery -----------------------------------------------------------

def weeks(code, first, n, close=10.0):
    return [bar(code, first + dt.timedelta(days=7 * k), close + k % 3) for k in range(n)]


def plan_of(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def test_recent_bars_read_what_is_needed(spark, folder):
    """Most codes trade weekly; one was suspended for a year, one is new, one stopped trading."""
    path, day = f"{folder}/store", D(2024, 6, 3)
    rows = [r for k in range(30) for r in weeks(f"60{k:04d}.SH", D(2021, 1, 4), 179)]
    rows += weeks("000001.SZ", D(2021, 1, 4), 100) + weeks("000001.SZ", D(2024, 5, 6), 5) + weeks("000002.SZ", D(2024, 4, 1), 10) + weeks("000003.SZ", D(2021, 1, 4), 90)
    B.upsert_bars(spark, path, frame(spark, rows))
    whole, got = B.read_bars(spark, path), B.recent_bars(spark, path, str(day))
    for code in ("600000.SH", "000001.SZ", "000002.SZ"):
        have = sorted(r.trade_date for r in got.filter(f"code = '{code}'").collect())
        every = sorted(r.trade_date for r in whole.filter(f"code = '{code}'").collect())
        assert have == every[-len(have):] and len([d for d in have if d < day]) >= min(25, len(every) - 1)
    assert got.filter("code = '600000.SH'").count() < 40
    for cautious in (False, True):
        key = lambda df: sorted(tuple(r) for r in df.collect())
        assert key(D_.daily_signals(got, str(day), cautious=cautious)) == key(D_.daily_signals(whole, str(day), cautious=cautious))
    assert plan_of(got).count("Subquery") >= 2 and "PartitionFilters: [" in plan_of(got)
    months = {r.ym for r in got.select("ym").distinct().collect()}
    assert min(months) > 202200 and got.filter("ym < 202310 AND code <> '000001.SZ'").count() == 0


def test_zones_follow_the_store(spark, folder):
    path = f"{folder}/store"
    B.upsert_bars(spark, path, frame(spark, weeks("600000.SH", D(2024, 1, 1), 10) + weeks("600001.SH", D(2024, 2, 5), 2)))
    B.upsert_bars(spark, path, frame(spark, [bar("600000.SH", D(2024, 2, 6), 9.0), bar("600002.SH", D(2024, 2, 6), 9.0)]))
    want = {(r.code, r.ym): r.n for r in B.read_bars(spark, path).groupBy("code", "ym").agg(F.count("*").alias("n")).collect()}
    assert {(r.code, r.ym): r.bars for r in B.zones(spark, path).collect()} == want and len(want) == 5


def test_cut_off_save_is_finished_by_the_next(spark, folder, monkeypatch):
    path = f"{folder}/store"
    B.upsert_bars(spark, path, frame(spark, weeks("600000.SH", D(2024, 1, 1), 20)))
    put, moved = B._Files.put, []

    def fails(self, source, target):
        moved.append(target)
        if len(moved) == 3:
            self.remove(target)  # lost between removal and renaming
            raise OSError("gone")
        put(self, source, target)

    monkeypatch.setattr(B._Files, "put", fails)
    with pytest.raises(OSError):
        B.upsert_bars(spark, path, frame(spark, weeks("600000.SH", D(2024, 1, 1), 20, 50.0) + weeks("600001.SH", D(2024, 1, 1), 20)))
    monkeypatch.setattr(B._Files, "put", put)
    B.upsert_bars(spark, path, frame(spark, [bar("600002.SH", D(2025, 1, 6), 5.0)]))
    rows = B.read_bars(spark, path).collect()
    assert len(rows) == 41 and all(r.close >= 50 for r in rows if r.code == "600000.SH") and not os.path.exists(f"{path}_staged/months")


def test_save_reads_its_input_once(spark, folder):
    reads = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            reads.add(b.num_rows)
            yield b

    new = frame(spark, weeks("600000.SH", D(2024, 1, 1), 30) + [bar("600001.SH", D(2024, 1, 1), 5.0, high=1.0)])
    refused = B.upsert_bars(spark, f"{folder}/store", new.mapInArrow(counted, new.schema))
    assert reads.value == 31 and [tuple(r) for r in refused.collect()] == [("600001.SH", "price out of range", 1)]


# --- picking a row ---------------------------------------------------------------------------------

def test_pick_row_nulls_ties_and_texts(spark):
    rows = [("a", None, 1.0, "x"), ("b", None, 2.0, "y"), ("b", 1, 3.0, None), ("c", 5, 4.0, "p"), ("c", 5, 6.0, "q"), ("c", 4, 9.0, "r"), ("d", 2, None, "")]
    df = spark.createDataFrame(rows, "code string, seq int, v double, s string")
    for fn in (F.max_by, F.min_by):
        for values in (None, {"s": ["", "x", "y", "p", "q", "r"]}):
            got = {r.code: tuple(r) for r in pick_row(df, ["code"], F.col("seq"), fn, values).collect()}
            assert got["a"] == rows[0] and got["b"] == rows[2] and got["d"] == rows[6]
            assert got["c"] in (rows[3], rows[4]) if fn is F.max_by else got["c"] == rows[5]
    ties = {pick_row(spark.createDataFrame(order, df.schema).repartition(n), ["code"], F.col("seq"), F.max_by).filter("code = 'c'").first().v for order in (rows, rows[::-1]) for n in (1, 3, 7)}
    assert len(ties) == 1
    assert "SortAggregate" not in pick_row(df, ["code"], F.col("seq"), F.max_by)._jdf.queryExecution().executedPlan().toString()


def test_good_rows_keep_texts_and_read_once(spark):
    raw = frame(spark, weeks("600000.SH", D(2024, 1, 1), 5) + [bar("600001.SH", D(2024, 1, 1), 5.0), bar("600001.SH", D(2024, 1, 1), 5.0), bar("600002.SH", None, 5.0)])
    named = raw.withColumn("note", F.concat(F.lit("n"), "trade_date"))
    got = F_.good_rows(named).collect()
    assert sorted((r.code, r.note) for r in got) == [("600000.SH", f"n{D(2024, 1, 1) + dt.timedelta(days=7 * k)}") for k in range(5)]
    assert F_.good_rows(raw).columns == raw.columns
    assert {r.code: r.reason for r in F_.quality_check(raw).collect()} == {"600000.SH": None, "600001.SH": "duplicate date", "600002.SH": "null trade_date"}


# --- files with faults, load times, the latest table --------------------------------------------------

def test_csv_with_broken_lines(spark, folder):
    os.makedirs(f"{folder}/csv/below")
    texts = {"a.csv": "code,close\n600000.SH,1.5\n600001.SH,x\n\n600002.SH\n  \n600003.SH,2.5,9\n600004.SH,\n", "below/b.csv": "code,close\n", "c.csv": "code,close\nz,1"}
    for name, text in texts.items():
        with open(f"{folder}/csv/{name}", "w") as f:
            f.write(text)
    schema = StructType.fromDDL("code string, close double")
    rep = {r.source_file.rsplit("/", 1)[1]: tuple(r)[1:] for r in X.csv_to_parquet(spark, f"{folder}/csv", f"{folder}/pq", schema).collect()}
    assert rep == {"a.csv": (5, 2, 3, True), "b.csv": (0, 0, 0, True), "c.csv": (1, 1, 0, True)}
    assert sorted((r.code, r.close) for r in X.converted(spark, f"{folder}/pq").collect()) == [("600000.SH", 1.5), ("600004.SH", None), ("z", 1.0)]
    assert sorted(r.bad_line for r in X.refused_lines(spark, f"{folder}/pq").collect()) == ["600001.SH,x", "600002.SH", "600003.SH,2.5,9"]
    with pytest.raises(ValueError):
        X.csv_to_parquet(spark, f"{folder}/csv", f"{folder}/no", StructType.fromDDL("bad_line string"))


def test_quality_report_since(spark, folder):
    rows = [("600000.SH", "buy", "P", 3), ("600000.SH", "sell", "P", 0), ("DJI", "buy", "P", 0)]
    for k, row in enumerate(rows):
        spark.createDataFrame([row], "code string, side string, pattern string, trades int").coalesce(1).write.parquet(f"{folder}/perf/load={k}")
        for name in os.listdir(f"{folder}/perf/load={k}"):
            os.utime(f"{folder}/perf/load={k}/{name}", (1_700_000_000 + 100 * k,) * 2)
    perf = X.read_performance(spark, f"{folder}/perf")
    issues = spark.sql("SELECT '600009.SH' AS code, timestamp_seconds(1700000050) AS loaded_at UNION ALL SELECT 'SPX', timestamp_seconds(1700000150) UNION ALL SELECT 'N225', NULL")
    since = dt.datetime.fromtimestamp(1_700_000_100, dt.timezone.utc)
    report = lambda at: {r.market: (r.rows, r.files, r.idle, r.issues, r.status) for r in M_.quality_report(perf, issues, at).collect()}
    assert report(since) == {"stock": (1, 1, 1, 0, "good"), "index": (1, 1, 1, 1, "warning"), "total": (2, 2, 2, 1, "warning")}
    assert report(None) == {"stock": (2, 2, 1, 1, "warning"), "index": (1, 1, 1, 2, "warning"), "total": (3, 3, 2, 3, "warning")}


def test_latest_table_resumes_and_repeats(spark, folder):
    """Ticks in several files, late and equal ones among them: one, two or all files a batch give the table of all ticks; a batch may be repeated."""
    at = lambda h: dt.datetime(2024, 1, 5, h)
    files = [[("a", at(10), 1.0, "x"), ("b", at(9), 2.0, None)], [("a", at(12), 3.0, "y"), ("a", at(12), 4.0, "z")], [("a", at(11), 5.0, "late"), ("c", dt.datetime(2020, 1, 1), 6.0, "old")], [("d", None, 7.0, "q")]]
    schema = StructType.fromDDL("code string, ts timestamp, price double, note string")
    want = sorted(map(tuple, N.newest_of(spark.createDataFrame([r for f in files for r in f], schema)).collect()))
    assert [w[0] for w in want] == ["a", "b", "c", "d"] and want[0][1] == at(12)
    for n in (1, 2, 10):
        land, path = f"{folder}/land{n}", f"{folder}/latest{n}"
        for k, rows in enumerate(files):
            spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(land)
            if k % 2:
                N.latest_table_stream(spark.readStream.schema(schema).option("maxFilesPerTrigger", n).parquet(land), path, f"{path}_cp").awaitTermination()
        assert sorted(map(tuple, N.read_latest(spark, path).collect())) == want
        last = max(int(f) for f in os.listdir(f"{path}_cp/commits") if f.isdigit())
        for name in (f"{last}", f".{last}.crc"):
            os.remove(f"{path}_cp/commits/{name}")  # as if the driver was lost before it could note the last batch
        N.latest_table_stream(spark.readStream.schema(schema).option("maxFilesPerTrigger", n).parquet(land), path, f"{path}_cp").awaitTermination()
        assert sorted(map(tuple, N.read_latest(spark, path).collect())) == want
    with pytest.raises(ValueError):
        N.read_latest(spark, f"{folder}/none")


def test_ticks_are_dealt_before_they_are_combined(spark):
    """A combine in the tasks that read the file would hold a group per tick of its part; a key of its own lets a key with most ticks be split."""
    raw = spark.range(4000).selectExpr(
        "IF(id % 4 < 3, 1, id % 50) AS l_suppkey", "DATE '2001-10-01' AS trade_date", "CAST(id AS DOUBLE) AS price", "1D AS qty", "CAST(id AS DECIMAL(38,0)) AS seq")
    rolled = A._ohlc(raw)
    plan = rolled._jdf.queryExecution().executedPlan().toString().split("Exchange ")
    assert len(plan) == 3 and "REBALANCE_PARTITIONS_BY_COL" in plan[2] and "HashAggregate" not in plan[2]
    assert "HashAggregate" in plan[1] and "HashAggregate" in plan[0]
    one = rolled.filter("l_suppkey = 1").collect()
    assert [(r["open"], r["high"], r["low"], r["close"]) for r in one] == [(0.0, 3998.0, 0.0, 3998.0)] and one[0]["vol"] >= 3000

"""Registered queries against their SQL on the smallest tables, and promises about their plans."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from checks import registry
from checks.compare import TABLES, canonical

SF = os.environ.get("QUERY_SF_DIR", "/root/testdata/sf0.001")
SOME = ("patterns_all", "refine_any_triggered_buy", "indicator_cross", "rule_indicator_union_v2", "trade_select", "trade_combined_account",
        "trade_segments", "trade_flags_breakout", "trade_turtle_account", "metric_scan_patterns", "metric_market_wide_stats", "metric_best_params",
        "cycle_market_cycles_short", "source_choose", "source_upsert_bars", "source_tracking_blocks", "source_missing_codes", "filter_quality_check",
        "filter_pending_tasks", "daily_track_directional", "daily_follow_up", "flow_daily_tracking", "stream_ticks_to_bars")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", SOME)
def test_query_matches_sql(spark, con, name):
    got, want = entry.queries()[name](spark, SF).toPandas(), con.sql(entry.oracle_sql()[name]).df()
    a, b = canonical(got), canonical(want)
    assert list(a.columns) == list(b.columns) and a.equals(b)


def test_every_query_but_the_pool_has_sql():
    assert set(registry.QUERIES) - set(registry.SQL) == {"trade_pool"}


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_scan_has_one_exchange_of_bars(spark, tmp_path):
    from wickspark import adapters as A
    from wickspark.operators import metrics as M, trades as T
    path = str(tmp_path / "bars")
    A.bars(spark, SF).write.parquet(path)
    bars = spark.read.parquet(path)
    text = plan(M.account_metrics(T.select_trades(T.candidate_trades(bars))))
    assert text.count("Exchange hashpartitioning(code") == 1 and text.count("Exchange") == 1


def test_no_cross_or_nested_loop_joins(spark):
    for name in SOME:
        text = plan(entry.queries()[name](spark, SF))
        assert "CartesianProduct" not in text and "NestedLoop" not in text and "PythonUDF" not in text, name


def test_upsert_is_hash_aggregated(spark):
    text = plan(entry.queries()["source_upsert_bars"](spark, SF))
    assert "SortAggregate" not in text and "Window" not in text


def test_since_reads_less_and_gives_the_same(spark):
    from wickspark import adapters as A
    from wickspark.operators import daily as D
    bars = A.bars(spark, "/root/testdata/sf0.01").cache()
    full = D.daily_signals(bars, "2001-10-15").toPandas()
    part = D.daily_signals(bars, "2001-10-15", since="2000-06-01").toPandas()
    bars.unpersist()
    key = ["code", "pattern", "side", "fired"]
    # rolling means may differ in the last bit, never in the signals
    assert sorted(map(tuple, full[key].values)) == sorted(map(tuple, part[key].values))


def test_suspended_codes_keep_their_signals(spark):
    from pyspark.sql import functions as F
    from wickspark import adapters as A
    from wickspark.operators import daily as D
    bars = A.bars(spark, SF)
    quiet = (F.crc32("code") % 2 == 0) & F.col("trade_date").between("2000-06-01", "2001-10-10")
    bars = bars.filter(~quiet).cache()
    key = ["code", "pattern", "side", "fired"]
    full, part = (D.daily_signals(bars, "2001-10-15", since=x).select(key).toPandas() for x in (None, "2000-06-01"))
    bars.unpersist()
    assert len(full) and sorted(map(tuple, full.values)) == sorted(map(tuple, part.values))

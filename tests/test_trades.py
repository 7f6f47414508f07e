"""Trades, equity and metrics against a bar-by-bar account on random series."""

import math

import numpy as np
import pandas as pd
import pytest

from tests.series import random_bars, run_account
from wickspark.operators import candles, combined as C, metrics as M, trades as T

NAMES = ["CDLDOJI", "CDLENGULFING", "CDLSHORTLINE"]


@pytest.fixture(scope="module")
def data():
    return random_bars(30, 160, 3)


@pytest.fixture(scope="module")
def wide(spark, data):
    return candles.patterns(spark.createDataFrame(data), NAMES).orderBy("code", "trade_date").toPandas()


def oracle(wide, hold, cash):
    out, acct = [], {}
    for code, g in wide.groupby("code"):
        for name in NAMES:
            for side in ("buy", "sell"):
                mask = (g[name] > 0) if side == "buy" else (g[name] < 0)
                trades, equity, held, end = run_account(g.open.values, g.close.values, mask.values, side, hold, cash)
                for no, t in enumerate(trades, 1):
                    out.append({"code": code, "pattern": name, "side": side, "trade_no": no, **t})
                if trades:
                    acct[code, name, side] = (trades, np.array(equity), held, end)
    return pd.DataFrame(out), acct


@pytest.mark.parametrize("hold,cash", [(1, 1e8), (2, 1e8), (3, 1e8), (5, 1e8), (2, 12_000.0)])
def test_trades_match_walk(spark, data, wide, hold, cash):
    want, _ = oracle(wide, hold, cash)
    got = T.select_trades(T.candidate_trades(spark.createDataFrame(data), NAMES, hold), cash).toPandas()
    keys = ["code", "pattern", "side", "trade_no"]
    m = got.merge(want, on=keys, how="outer", suffixes=("", "_w"), indicator=True)
    assert (m["_merge"] == "both").all(), m[m["_merge"] != "both"].head()
    assert (m.entry_idx == m.entry_idx_w).all() and (m.exit_idx == m.exit_idx_w).all()
    assert (m.exit_reason == m.exit_reason_w).all() and (m["size"] == m.size_w).all()
    assert (m.held_bars == m.held).all()
    assert np.allclose(m.pnl_pct, m.pnl_pct_w) and np.allclose(m.hold_max_drawdown, m.dd)


def test_intervals_and_lots(spark, data):
    got = T.select_trades(T.candidate_trades(spark.createDataFrame(data), NAMES)).toPandas()
    assert (got["size"] % 100 == 0).all() and (got["size"] > 0).all()
    for _, g in got.sort_values("trade_no").groupby(["code", "pattern", "side"]):
        assert (g.entry_idx.values[1:] >= g.exit_idx.values[:-1]).all()


def test_metrics_match_walk(spark, data, wide):
    _, acct = oracle(wide, 2, 1e8)
    trades = T.select_trades(T.candidate_trades(spark.createDataFrame(data), NAMES))
    got = M.account_metrics(trades).toPandas().set_index(["code", "pattern", "side"])
    assert set(got.index) == set(acct)
    for key, (tr, eq, held, _) in acct.items():
        row = got.loc[key]
        ret = np.diff(eq) / eq[:-1]
        ret = ret[ret != 0]
        sharpe = round(ret.mean() / ret.std(ddof=1) * math.sqrt(252), 2) if len(ret) > 1 and ret.std(ddof=1) > 1e-12 else 0.0
        peak = np.maximum.accumulate(eq)
        pcts = [round(t["pnl_pct"], 2) for t in tr]
        assert row.trades == len(tr) and row.held_bars == held
        assert abs(row.return_pct - round(sum(pcts), 2)) <= 0.011
        assert row.win_rate == round(sum(p > 0 for p in pcts) / len(pcts) * 100)
        assert abs(row.sharpe - sharpe) <= 0.011, key
        assert abs(row.max_drawdown - round(((peak - eq) / peak * 100).max(), 2)) <= 0.011, key


def test_equity_curve_matches_walk(spark, data, wide):
    _, acct = oracle(wide, 2, 1e8)
    bars = spark.createDataFrame(data)
    trades = T.select_trades(T.candidate_trades(bars, NAMES))
    got = T.equity_curve(bars, trades).orderBy("code", "pattern", "side", "bar_idx").toPandas()
    for key, g in got.groupby(["code", "pattern", "side"]):
        assert np.allclose(g.equity.values, acct[key][1], rtol=1e-12), key


def test_combined_account(spark, data, wide):
    buy, sell = ["CDLDOJI", "CDLENGULFING"], ["CDLENGULFING", "CDLSHORTLINE"]
    got = C.combined_trades(spark.createDataFrame(data), buy, sell).toPandas()
    for code, g in wide.groupby("code"):
        b = (g[buy] > 0).any(axis=1).values
        s = (g[sell] < 0).any(axis=1).values & ~b
        want = walk_combined(g.open.values, g.close.values, b, s, 2)
        mine = got[got.code == code].sort_values("trade_no")
        assert list(zip(mine.entry_idx, mine.exit_idx, mine.side)) == want


def walk_combined(opens, closes, buys, sells, hold):
    out, e, side, pending, days = [], None, None, False, 0
    for i in range(len(opens)):
        if e is not None and pending:
            out.append((e, i, side))
            e, pending = None, False
        if e is not None and days == hold:
            out.append((e, i, side))
            e = None
        if e is None and i and (buys[i - 1] or sells[i - 1]):
            e, side, days = i, "buy" if buys[i - 1] else "sell", 0
        if e is not None and days > 0 and side == "buy" and closes[i] / opens[e] - 1 <= -0.03:
            pending = True
        if e is not None:
            days += 1
    if e is not None:
        out.append((e, len(opens) - 1, side))
    return out


def test_trade_details_rounding_and_label(spark, data):
    trades = T.select_trades(T.candidate_trades(spark.createDataFrame(data), NAMES))
    d = T.trade_details(trades).toPandas()
    assert set(d.exit_reason.dropna()) == {"3%止损"}
    assert (d.pnl_pct * 100 - (d.pnl_pct * 100).round()).abs().max() < 1e-6


def test_same_trades_compare_empty(spark, data):
    bars = spark.createDataFrame(data)
    t = T.select_trades(T.candidate_trades(bars, NAMES))
    assert T.compare_trades(t, t).count() == 0


def test_sweep_equals_single_runs(spark, data):
    bars = spark.createDataFrame(data)
    sweep = M.observe_day_sweep(bars, NAMES, (1, 4)).toPandas()
    for n in (1, 4):
        one = M.account_metrics(T.select_trades(T.candidate_trades(bars, NAMES, n))).toPandas()
        part = sweep[sweep.observe_day == n].drop(columns="observe_day")
        keys = ["code", "pattern", "side"]
        pd.testing.assert_frame_equal(part.sort_values(keys)[one.columns].reset_index(drop=True), one.sort_values(keys).reset_index(drop=True))


def test_market_totals(spark, data):
    bars = spark.createDataFrame(data)
    scan = M.scan_patterns(bars, buy=NAMES, sell=NAMES)
    total = scan.groupBy().sum("trades").first()[0]
    assert M.market_wide_stats(scan).groupBy().sum("trades").first()[0] == total
    assert scan.count() == 30 * 6


def test_equity_curve_by_loop(spark):
    """Every bar of every account against its trades one by one; long flat stretches and one bar accounts among them."""
    data = random_bars(6, 300, 5, step=0.25)
    bars = spark.createDataFrame(data)
    trades = T.select_trades(T.candidate_trades(bars, ["CDLENGULFING", "CDLDOJI", "CDLDARKCLOUDCOVER"]))
    curve, done = T.equity_curve(bars, trades).toPandas(), trades.toPandas()
    accounts, bars_seen = 0, 0
    for key, own in done.groupby(["code", "pattern", "side"]):
        g = data[data.code == key[0]].sort_values("trade_date")
        closes, want = list(g.close), [1e8] * len(g)
        for t in own.sort_values("trade_no").to_dict("records"):
            sign = 1 if t["side"] == "buy" else -1
            for i in range(t["entry_idx"], len(closes)):
                held = i < t["entry_idx"] + t["held_bars"]
                want[i] = t["cash_in"] + sign * t["size"] * closes[i] if held and not (t["exit_reason"] == "end" and i == len(closes) - 1) else t["cash_out"]
        mine = curve[(curve.code == key[0]) & (curve.pattern == key[1]) & (curve.side == key[2])].sort_values("trade_date")
        assert list(mine.trade_date) == list(g.trade_date) and all(abs(a - b) < 1e-3 for a, b in zip(mine.equity, want))
        accounts, bars_seen = accounts + 1, bars_seen + len(g)
    assert accounts > 5 and len(curve) == bars_seen


@pytest.mark.parametrize("hold,cautious", [(2, False), (3, True)])
def test_accounts_in_place_match_windows(spark, data, hold, cautious):
    """Accounts formed from one row per code against candidates gathered per account and marks in windows."""
    bars, keys = spark.createDataFrame(data), ["code", "pattern", "side"]
    old = T.select_trades(T.candidate_trades(bars, NAMES, hold, cautious))
    new = T.pattern_trades(bars, NAMES, hold, cautious)
    assert old.exceptAll(new).count() == 0 and new.exceptAll(old).count() == 0 and old.count() > 0
    want = M.account_metrics(old).toPandas().sort_values(keys).reset_index(drop=True)
    got = M.account_figures(T.pattern_accounts(bars, NAMES, hold, cautious)).toPandas()
    pd.testing.assert_frame_equal(got[want.columns].sort_values(keys).reset_index(drop=True), want, check_exact=True)
    results = M.scan_patterns(bars, hold=hold, cautious=cautious, buy=NAMES, sell=NAMES)
    nested = M.pattern_result(results, old)
    in_place = M.pattern_result(M.scan_patterns(bars, hold=hold, cautious=cautious, buy=NAMES, sell=NAMES, details=True))
    assert nested.select(sorted(nested.columns)).exceptAll(in_place.select(sorted(nested.columns))).count() == 0 and nested.count() == in_place.count()


def test_scan_and_sweep_neither_join_nor_sort_accounts(spark, data, tmp_path):
    path = str(tmp_path / "bars")
    spark.createDataFrame(data).write.parquet(path)
    bars = spark.read.parquet(path)
    for df in (M.scan_patterns(bars, buy=NAMES, sell=NAMES), M.observe_day_sweep(bars, NAMES, (1, 4))):
        text = df._jdf.queryExecution().executedPlan().toString()
        windows = [line for line in text.splitlines() if "windowspecdefinition" in line]
        assert text.count("Exchange") == 1 and "Join" not in text and windows and not any("windowspecdefinition(code" in w and "pattern" in w for w in windows)


def test_equity_in_place_matches_windows(spark, data):
    """Marks and curves of accounts in place against those of windows and joins; the plan neither joins nor sorts accounts."""
    bars = spark.createDataFrame(data)
    trades = T.pattern_trades(bars, NAMES)
    marks, curve = T.account_marks(T.pattern_accounts(bars, NAMES)), T.account_curve(T.pattern_accounts(bars, NAMES, also=["_dates"]))
    old = T.marked_returns(T.marks(trades)).select(marks.columns)
    for new, want, keys in ((marks, old, [*T.KEYS, "bar_idx"]), (curve, T.equity_curve(bars, trades).select(curve.columns), [*T.KEYS, "bar_idx"])):
        a, b = (x.toPandas().sort_values(keys).reset_index(drop=True) for x in (new, want))
        assert len(a) > 500
        pd.testing.assert_frame_equal(a, b, check_exact=True)
        plan = new._jdf.queryExecution().optimizedPlan().toString()
        assert "Join" not in plan and "pattern" not in "".join(line for line in plan.splitlines() if "Window [" in line)


def test_compare_holds_in_place(spark, data):
    """The differences between two holding periods, as the join of their trades gives them; the plan has no join."""
    bars = spark.createDataFrame(data)
    new = T.compare_holds(bars, NAMES, 2, 3)
    old = T.compare_trades(T.pattern_trades(bars, NAMES), T.pattern_trades(bars, NAMES, hold=3))
    a, b = (sorted(map(tuple, x.select(*T.KEYS, "trade_no", "difference").collect())) for x in (new, old))
    assert a == b and {"only_a", "exit_date", "size", "hold_max_drawdown"} <= {x[-1] for x in a}
    assert "Join" not in new._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("cash,part", [(1e8, 1 << 20), (12_000.0, 40)])
def test_sweep_in_numpy_matches_sql(spark, data, monkeypatch, cash, part):
    """Accounts of several periods against those folded in SQL, digit by digit: gaps, prices of 0, below it and infinite, a code without a name, cash for few lots, codes one by one."""
    from wickspark.operators import ledgers
    monkeypatch.setattr(ledgers, "PART", part)
    rng = np.random.default_rng(4)
    rows = data[data.code < "600012.SH"].astype({"code": object})
    rows.loc[rows.code == "600003.SH", "code"] = None
    for c in ("open", "high", "low", "close"):
        rows[c] = rows[c].where(rng.random(len(rows)) > 0.05, rng.choice([0.0, np.nan, np.nan, np.inf, -3.0], len(rows), p=[0.45, 0.25, 0.25, 0.025, 0.025]))
    rows = rows.astype(object).where(rows.notna(), None)
    bars = spark.createDataFrame(rows, "code string, trade_date date, open double, high double, low double, close double, vol double")
    names, days = [*NAMES, "CDLMARUBOZU"], (1, 2, 3, 9)
    cells = [(n, side) for n in names for side in ("buy", "sell")]
    keys = ["code", "observe_day", "pattern", "side"]
    folded = T.folded(T.code_candidates(T.code_rows(bars, names, cells), cells, days).withColumnRenamed("hold", "observe_day"), cash, keys, traded=True)
    want = M.account_figures(folded, cash, keys).drop("final_value").toPandas()
    got = M.observe_day_sweep(bars, names, days, cash)
    assert "aggregate(" not in got._jdf.queryExecution().optimizedPlan().toString()  # a lambda for each candidate and mark
    a, b = (x[want.columns].sort_values(keys).reset_index(drop=True) for x in (got.toPandas(), want))
    assert len(b) > 150 and b.code.isna().any() and (b.won < b.trades).any() and got.filter("sharpe IS NULL").count() == 0
    pd.testing.assert_frame_equal(a, b, check_exact=True)


def test_round_two_as_spark(spark):
    from wickspark.operators.ledgers import round_two
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(0, 30, 2000), np.arange(-400, 400) / 200 + 1, [1.005, -2.675, 1e-9, 8.5e9 + 0.005, 1e17, -1e17, 0.0, np.inf, -np.inf, np.nan]])
    want = spark.createDataFrame(pd.DataFrame({"i": range(len(x)), "x": x})).selectExpr("i", "round(x, 2) AS r").toPandas().sort_values("i").r.to_numpy()
    assert np.array_equal(round_two(x), want, equal_nan=True)


def test_figures_are_judged_once_they_are_formed(spark, data):
    """A filter on a scan's figures is no part of the formulas that form the account: no fold of trades stands in it, and it gives the rows of the whole scan."""
    from wickspark.operators import daily as D
    bars = spark.createDataFrame(data)
    scan = M.scan_patterns(bars, buy=NAMES, sell=NAMES)
    folds = [df._jdf.queryExecution().optimizedPlan().toString().count("cash_before, ") for df in (
        D.legacy_filter(scan), D.legacy_filter(M.scan_patterns(bars, buy=NAMES, sell=NAMES, details=True)), M.scan_patterns(bars, buy=NAMES, sell=NAMES, details=True),
        D.legacy_filter(M.account_figures(T.pattern_accounts(bars, NAMES))), M.account_figures(T.pattern_accounts(bars, NAMES)))]
    assert folds[0] == 0 and folds[1] == folds[2] and folds[3] == folds[4]
    want = scan.toPandas()
    want = want[(want.win_rate > 50) & (want.return_pct > 0)]
    assert 0 < len(want) < scan.count() and sorted(map(tuple, D.legacy_filter(scan).toPandas().values)) == sorted(map(tuple, want.values))


def test_scan_in_numpy_matches_sql(spark, data):
    """The scan's figures against those of its detailed form, which folds accounts in SQL; accounts without a trade, a code with one bar and years given among them."""
    bars = spark.createDataFrame(pd.concat([data, data[data.code == "600001.SH"].head(1).assign(code="one")]))
    names = [*NAMES, "CDLBREAKAWAY"]
    for asked in ({}, {"hold": 4, "cash": 15_000.0, "cautious": True, "start": "2020-01-01", "end": "2020-12-31"}):
        got, want = (M.scan_patterns(bars, buy=names, sell=["CDLDOJI", "CDLDOJI"], details=d, **asked).drop("trade_details").toPandas() for d in (False, True))
        a, b = (x.sort_values(list(T.KEYS)).reset_index(drop=True) for x in (got, want))
        assert len(b) == 31 * 6 and (b.trades == 0).any() and (b.trades > 0).any()
        pd.testing.assert_frame_equal(a, b, check_exact=True)


def test_signals_of_days_pass_few_bars_to_wide_windows(spark, data):
    """Signals of far and near days as the whole history gives them; what is far from any asked day is left out before the wide windows."""
    from wickspark.operators import daily as D
    bars = spark.createDataFrame(pd.concat([data, data[data.code == "600002.SH"].head(5).assign(code="few")]))
    for days in (["2020-01-07", "2020-05-04"], "2020-04-15", ["2030-01-01"]):
        asked = [days] if isinstance(days, str) else days
        whole = candles.signals(bars, NAMES).filter("bar_idx >= 3")
        want = whole.filter(whole.trade_date.cast("string").isin(asked)).selectExpr("code", "trade_date", "pattern AS fired", "value")
        got = D.daily_signals(bars, days, NAMES)
        key = ["code", "trade_date", "fired", "value"]
        assert sorted(map(tuple, got.select(key).toPandas().values)) == sorted(map(tuple, want.select(key).toPandas().values))
        assert (got.count() > 0) == (days != ["2030-01-01"])
    text = got._jdf.queryExecution().optimizedPlan().toString()
    assert text.index("isnotnull(_hi") > text.index("avg(")  # below, and so before, the rolling means

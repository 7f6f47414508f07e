"""Full-position accounts, turtle accounts, the pool and sweeps against plain loops."""

import math

import pandas as pd
import pytest

from tests.series import random_bars
from wickspark.operators import combined as C, metrics as M, rules as R

FEE = 0.0001


@pytest.fixture(scope="module")
def data():
    return random_bars(25, 220, 11, step=0.25)


def lots(x):
    return math.floor(math.floor(x) / 100) * 100


def walk_flags(g, margin, cash=1e8):
    out, size, price, since = [], 0, 0.0, None
    rows = g.sort_values("trade_date").to_dict("records")
    for i, r in enumerate(rows[:-1]):
        nxt = rows[i + 1]
        if size == 0 and r["buy"]:
            n = lots(cash / (r["close"] * margin))
            if n > 0 and n * nxt["open"] * (1 + FEE) <= cash:
                cash -= n * nxt["open"] * (1 + FEE)
                size, price, since = n, nxt["open"], nxt["trade_date"]
        elif size and r["sell"]:
            cash += size * nxt["open"] * (1 - FEE)
            out.append((since, nxt["trade_date"], size, round(cash, 4)))
            size = 0
    return out, cash + size * rows[-1]["close"]


@pytest.mark.parametrize("rule,margin,cash", [("breakout", 1.001, 1e8), ("near_ma", 1.001, 1e8), ("double_ma", 1.005, 1e8),
                                              ("near_window", 1.001, 9_000.0), ("pattern_combo", 1.001, 1e8)])
def test_flag_trades(spark, data, rule, margin, cash):
    kw = {"double_ma": {"short": 5, "long": 20}, "near_ma": {"periods": (5, 20)}, "breakout": {"n": 10}}.get(rule, {})
    flags = R.RULES[rule](spark.createDataFrame(data), **kw)
    pdf = flags.toPandas()
    got = R.flag_trades(flags, cash, margin).toPandas()
    seen = 0
    for code, g in pdf.groupby("code"):
        want, value = walk_flags(g, margin, cash)
        mine = got[(got.code == code) & ~got.is_open].sort_values("trade_no")
        assert [(a, b, s, round(c, 4)) for a, b, s, c in zip(mine.entry_date, mine.exit_date, mine["size"], mine.cash_out)] == want
        last = got[got.code == code].sort_values("trade_no")
        if len(last):
            assert abs(last.cash_out.iloc[-1] - value) < 1e-3
        seen += len(want)
    assert seen > 0


def walk_turtle(g, share, cash=1e8):
    out, size, price, n, since, sig = [], 0, 0.0, 0, None, None
    rows = g.sort_values("trade_date").to_dict("records")
    for i, r in enumerate(rows[:-1]):
        nxt = rows[i + 1]
        atr, b, s = r["atr"], r["buy_signal"], r["sell_signal"]
        has_atr = not pd.isna(atr)
        if size == 0 and b:
            turtle = b == "turtle"
            may = not turtle or n == 0 or (has_atr and r["close"] > price + 0.5 * atr and n <= 4)
            if turtle:
                want = (math.floor(cash * share / (r["close"] * 1.001) / 100) * 100 if share
                        else (math.floor(cash * 0.01 / atr / 100) * 100 if has_atr and atr else 0))
            else:
                want = math.floor(cash / (r["close"] * 1.001) / 100) * 100
            if may and want > 0 and want * nxt["open"] * (1 + FEE) <= cash:
                cash -= want * nxt["open"] * (1 + FEE)
                size, price, since, sig = want, nxt["open"], nxt["trade_date"], b
                n += turtle
        elif size:
            out_t = (s == "turtle" or (has_atr and r["close"] < price - 2 * atr)) and n > 0
            if out_t or (s and s != "turtle"):
                cash += size * nxt["open"] * (1 - FEE)
                out.append((since, nxt["trade_date"], size, sig, "turtle" if out_t else s, round(cash, 2)))
                size = 0
                if out_t:
                    n = 0
    return out


@pytest.mark.parametrize("rule,share", [("turtle", None), ("indicator_union", None), ("indicator_union", 1 / 3)])
def test_turtle_trades(spark, data, rule, share):
    kw = {} if rule == "turtle" else {"n": 15, "short": 5, "long": 20}
    sig = R.RULES[rule](spark.createDataFrame(data), **kw)
    pdf = sig.toPandas()
    if "buy_signal" not in pdf:
        pdf["buy_signal"] = pdf.buy.map(lambda x: "turtle" if x else None)
        pdf["sell_signal"] = pdf.sell.map(lambda x: "turtle" if x else None)
    pdf = pdf.astype(object).where(pdf.notna(), None)
    pdf["atr"] = pdf.atr.astype(float)
    got = R.turtle_trades(sig, cash_share=share).toPandas()
    seen = 0
    for code, g in pdf.groupby("code"):
        mine = got[got.code == code].sort_values("trade_no")
        want = walk_turtle(g, share)
        assert list(zip(mine.entry_date, mine.exit_date, mine["size"], mine.signal, mine.exit_signal)) == [w[:5] for w in want]
        assert all(abs(a - w[5]) < 0.02 for a, w in zip(mine.cash_out, want))
        seen += len(want)
    assert seen > 0


def walk_stacked(g, cash):
    """One bar after the other, as an account that orders at the close and is filled at the next open."""
    out, held, spent, last, count, first, names, fills = [], 0, 0.0, 0.0, 0, None, [], 0
    rows = g.sort_values("trade_date").to_dict("records")
    for r, nxt in zip(rows, rows[1:]):
        atr = r["atr"] if not pd.isna(r["atr"]) else math.nan
        price = r["close"] * 1.001
        if full := math.floor(cash / price / 100) * 100:
            rule, order = r["buy_signal"], 0
            if rule == "turtle" and count > 4:
                rule = r["buy_other"]
            if rule == "turtle":
                third = math.floor(cash / 3 / price / 100) * 100
                if count == 0:
                    count, order = 1, third
                elif r["close"] > last + 0.5 * atr and third:
                    count, order = count + 1, third
            elif rule:
                order = full
            if order and order * nxt["open"] * (1 + FEE) <= cash:
                cash -= order * nxt["open"] * (1 + FEE)
                held, spent, last, fills = held + order, spent + order * nxt["open"], nxt["open"], fills + 1
                first = first or nxt["trade_date"]
                names.append(rule)
        elif held:
            why = r["sell_other"]
            if count and (r["sell_signal"] == "turtle" or r["close"] < last - 2 * atr):
                why, count = "turtle", 0
            if why:
                cash += held * nxt["open"] * (1 - FEE)
                out.append((first, nxt["trade_date"], held, fills, names[0], why, round(cash, 2), round(spent / held, 6)))
                held, spent, first, names, fills = 0, 0.0, None, [], 0
    return out


@pytest.mark.parametrize("cash", [1e8, 30_000.0])
def test_stacked_trades(spark, data, cash):
    signals = R.indicator_union_v2(spark.createDataFrame(data), near=(10,), n=15, short=5, long=20, turtle_long=15)
    pdf = signals.toPandas()
    atr = pdf.atr.astype(float)
    pdf = pdf.astype(object).where(pdf.notna(), None)
    pdf["atr"] = atr
    got = R.stacked_trades(signals, cash).toPandas()
    several = 0
    for code, g in pdf.groupby("code"):
        mine, want = got[got.code == code].sort_values("trade_no"), walk_stacked(g, cash)
        assert list(zip(mine.entry_date, mine.exit_date, mine["size"], mine.entries, mine.signal, mine.exit_signal)) == [w[:6] for w in want]
        assert all(abs(a - w[6]) < 0.02 and abs(b - w[7]) < 1e-5 for a, b, w in zip(mine.cash_out, mine.entry_price, want))
        several += sum(w[3] > 1 for w in want)
    assert several > 0


def walk_pool(c, slots, cash=1e8):
    """Every candidate of every day, without any shortening."""
    held, taken = [], []
    for r in c.sort_values(["signal_date", "code"]).to_dict("records"):
        d = r["signal_date"]
        for z in [z for z in held if z["exit_date"] <= d]:
            cash += z["size"] * z["exit_price"] * (1 - FEE)
        held = [z for z in held if z["exit_date"] > d]
        value = cash
        for z in held:
            seen = [p["c"] for p in z["path"] if p["d"] <= d]
            value += z["size"] * (z["entry_price"] * (1 + FEE) if z["entry_date"] > d else (seen[-1] if seen else z["entry_price"]))
        busy = sum(z["decision_date"] >= d for z in held)
        if busy < slots and all(z["code"] != r["code"] for z in held):
            size = max(math.floor(value * 0.99 / slots / 100 / r["signal_close"]) * 100, 0)
            cash -= size * r["entry_price"] * (1 + FEE)
            held.append({**r, "size": size})
            taken.append((d, r["code"], float(size)))
    return taken


@pytest.mark.parametrize("slots", [1, 3, 8])
def test_pool_shortening_is_exact(spark, data, slots):
    bars = spark.createDataFrame(data)
    perf = spark.createDataFrame(data[["code"]].drop_duplicates()).selectExpr(
        "code", "explode(array('CDLDOJI','CDLSHORTLINE','CDLENGULFING','CDLHARAMI','CDLBELTHOLD')) AS pattern", "'buy' AS side", "20L AS trades", "60D AS win_rate",
        "5D AS return_pct", "1D AS sharpe")
    cands = C.pool_candidates(bars, perf)
    got = C.pool_trades(cands, slots).orderBy("signal_date", "code").toPandas()
    want = walk_pool(cands.toPandas(), slots)
    assert list(zip(got.signal_date, got.code, got["size"])) == want and len(want) > slots


def test_pool_judges_figures_once_they_are_formed(spark, data):
    """A filter on the figures of a scan pushed below them forms the account again for every mention; the scan's result as a table decides the same."""
    bars = spark.createDataFrame(data)
    scan = M.scan_patterns(bars, buy=["CDLSHORTLINE", "CDLDOJI"], sell=())
    lazy = C.pool_candidates(bars, scan)
    plan = lazy._jdf.queryExecution().optimizedPlan().toString()
    assert not [line for line in plan.splitlines() if "Filter" in line and "aggregate(" in line]
    table = spark.createDataFrame(scan.toPandas(), scan.schema)
    want = C.pool_candidates(bars, table).orderBy("code", "signal_date").collect()
    assert lazy.orderBy("code", "signal_date").collect() == want


def test_sweep_and_best(spark, data):
    bars = spark.createDataFrame(data)
    grid = [{"n": 10, "diff": 0.01}, {"n": 20, "diff": 0.02}, {"n": 20, "diff": 0.02}]
    sweep = R.param_sweep(bars, "near_window", grid)
    rows = sweep.toPandas()
    best = R.best_params(sweep).toPandas().set_index("code")
    for code, g in rows.groupby("code"):
        top = g.sort_values(["log_return", "set_no"], ascending=[False, True]).iloc[0]
        assert best.loc[code].set_no == top.set_no
    one = R.flag_trades(R.near_window(bars, n=10, diff=0.01)).toPandas()
    assert set(rows[rows.set_no == 0].code) == set(one.code)


def test_registry_takes_own_rule(spark, data):
    R.register("monday", lambda bars: bars.selectExpr("*", "dayofweek(trade_date) = 2 AS buy", "dayofweek(trade_date) = 5 AS sell"))
    assert R.flag_trades(R.RULES["monday"](spark.createDataFrame(data))).count() > 0
    del R.RULES["monday"]


def test_rule_of_code(spark, data):
    """A stop that trails the highest close since the rule last spoke: state that columns can't carry."""
    def decide(bars, fall=0.01):
        top, buy, sell = None, [], []
        for close in bars["close"]:
            top = close if top is None else max(top, close)
            hit = close < top * (1 - fall)
            sell.append(hit)
            buy.append(not hit and close == top)
            top = close if hit else top
        return bars.assign(buy=pd.array(buy, "boolean"), sell=sell)

    bars = spark.createDataFrame(data)
    rule = R.rule_of_code(decide)
    got = rule(bars, fall=0.02).toPandas()
    assert list(got.columns) == ["code", "trade_date", "bar_idx", "open", "close", "buy", "sell"] and len(got) == len(data)
    for code, g in data.sort_values("trade_date").groupby("code"):
        want, mine = decide(g, 0.02), got[got.code == code].sort_values("trade_date")
        assert list(mine.buy) == list(want.buy) and list(mine.sell) == list(want.sell) and list(mine.bar_idx) == list(range(len(g)))
    R.register("trailing", rule)
    sweep = R.param_sweep(bars, "trailing", [{"fall": 0.01}, {"fall": 0.05}]).toPandas()
    del R.RULES["trailing"]
    assert set(sweep.set_no) == {0, 1} and rule(bars.filter("code = 'none'")).count() == 0


@pytest.mark.parametrize("wrong", [lambda b: b, lambda b: b.assign(buy=1.5, sell=False), lambda b: b.iloc[:1].assign(buy=True, sell=False), lambda b: None])
def test_rule_of_code_checks_what_it_gets(spark, data, wrong):
    with pytest.raises(Exception, match="returns a frame with buy and sell|is not boolean"):
        R.rule_of_code(wrong)(spark.createDataFrame(data)).count()

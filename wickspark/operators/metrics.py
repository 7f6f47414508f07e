"""Performance metrics of accounts and markets."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wickspark.functions.codes import perf_group
from wickspark.functions.pick import pick_row
from wickspark.model import (BUY_CLASS, HOLD_DAYS, INVEST_FRACTION, LOT, MIN_YEARS, PATTERN_NAMES,
                             SELL_CLASS, START_CASH, YEAR_BARS)
from wickspark.operators import candles
from wickspark.operators import trades as T
from wickspark.operators.ledgers import ledgers
from wickspark.operators.selection import fill_forward_zero
from wickspark.operators.trades import KEYS


def years_between(start, end):
    return F.greatest(F.datediff(end, start) / F.lit(365.0), F.lit(MIN_YEARS))


def annualized(pct, years):
    """M3: compounded yearly percent; -100 when everything is lost."""
    grown = (F.pow(1 + pct / 100, 1 / years) - 1) * 100
    return F.when(pct > -100, F.round(grown, 2)).otherwise(F.lit(-100.0))


def account_metrics(trades: DataFrame, cash: float = START_CASH, keys: Iterable[str] = KEYS) -> DataFrame:
    """M1, M2, M5, M6 and held bars of every account in one grouping of its marks."""
    keys = tuple(keys)
    live = T.marked_returns(T.marks(trades, keys), cash, keys)
    moved = F.when(F.col("daily_return") != 0, F.col("daily_return"))
    out = live.groupBy(*keys).agg(
        F.count("held_bars").alias("trades"),
        F.count_if(F.col("pnl_pct") > 0).alias("won"),
        F.round(F.sum("pnl_pct"), 2).alias("return_pct"),
        F.sum("held_bars").alias("held_bars"),
        F.sum("hold_days").alias("hold_days"),
        F.count(moved).alias("_n"), F.avg(moved).alias("_mean"), F.stddev_samp(moved).alias("_std"),
        F.round(F.max("drawdown"), 2).alias("max_drawdown"))
    sharpe = F.when((F.col("_n") > 1) & (F.col("_std") > 1e-12),
                    F.round(F.col("_mean") / F.col("_std") * F.sqrt(F.lit(float(YEAR_BARS))), 2)).otherwise(0.0)
    return out.select(*keys, "trades", "won", F.bround(F.col("won") / F.col("trades") * 100, 0).alias("win_rate"),
                      "return_pct", sharpe.alias("sharpe"), "max_drawdown", "held_bars", "hold_days")


def account_figures(accounts: DataFrame, cash: float = START_CASH, keys: Iterable[str] = KEYS, combined: bool = False,
                    also: Iterable[str] = ()) -> DataFrame:
    """`account_metrics` of accounts that still have their `trades` as an array: each row by itself, without a sort or a grouping.

    An account without a trade has 0 trades and null figures. Return, peak and deviation are taken mark by mark in the order of the windows."""
    keys, also = tuple(keys), tuple(also)
    side = "side" if "side" in keys else "t.c.side"
    made = T._trade_figures("t.", "t.c.", side, combined)
    one = accounts.selectExpr(
        *keys, *also, "CAST(size(trades) AS BIGINT) AS trades", f"{T.account_equity(side=side)} AS _m",
        f"filter(transform(trades, t -> round({made['pnl_pct']}, 2)), x -> x IS NOT NULL) AS _p", "aggregate(trades, 0L, (a, t) -> a + t.c.held_bars) AS held_bars",
        f"aggregate(trades, 0L, (a, t) -> a + ({made['hold_days']})) AS hold_days", "try_element_at(trades, -1).cash_out AS final_value")
    two = one.selectExpr(
        *keys, *also, "trades", "held_bars", "hold_days", "final_value", "CAST(size(filter(_p, x -> x > 0)) AS BIGINT) AS won",
        "IF(size(_p) > 0, round(aggregate(_p, 0D, (a, x) -> a + x), 2), NULL) AS return_pct",
        f"filter(transform(_m, (x, i) -> x / nullif(IF(i = 0, {cash}D, get(_m, i - 1)), 0) - 1), r -> r <> 0) AS _r",
        f"""round(aggregate(_m, named_struct('peak', {cash}D, 'dd', CAST(NULL AS DOUBLE)), (a, x) -> IF(x > a.peak, named_struct('peak', x, 'dd', greatest(a.dd, (x - x) / x * 100)),
            named_struct('peak', a.peak, 'dd', greatest(a.dd, (a.peak - x) / nullif(a.peak, 0) * 100))), a -> a.dd), 2) AS max_drawdown""")
    three = two.selectExpr(
        "*", "aggregate(_r, 0D, (a, x) -> a + x) / nullif(size(_r), 0) AS _mean",
        """aggregate(_r, named_struct('n', 0D, 'mean', 0D, 'm2', 0D), (a, x) -> named_struct('n', a.n + 1D, 'mean', a.mean + (x - a.mean) / (a.n + 1D),
            'm2', a.m2 + (x - a.mean) * ((x - a.mean) - (x - a.mean) / (a.n + 1D))), a -> IF(a.n > 1, sqrt(a.m2 / (a.n - 1D)), NULL)) AS _std""")
    return _rated(three, (*keys, *also))


def _rounded(accounts: DataFrame) -> DataFrame:
    return accounts.withColumns({"return_pct": F.round("_sum", 2), "max_drawdown": F.round("_fall", 2)})


def _rated(accounts: DataFrame, keys: Iterable[str]) -> DataFrame:
    sharpe = F.when(F.col("_std") > 1e-12, F.round(F.col("_mean") / F.col("_std") * F.sqrt(F.lit(float(YEAR_BARS))), 2)).otherwise(0.0)
    return accounts.select(*keys, "trades", "won", F.bround(F.col("won") / F.nullif("trades", F.lit(0)) * 100, 0).alias("win_rate"),
                           "return_pct", sharpe.alias("sharpe"), "max_drawdown", "held_bars", "hold_days", "final_value")


def task_grid(codes: DataFrame, buy: Iterable[str] = BUY_CLASS, sell: Iterable[str] = SELL_CLASS) -> DataFrame:
    """Every (code, pattern, side) to be reported, by exploding the fixed pattern lists."""
    cells = [F.struct(F.lit(n).alias("pattern"), F.lit("buy").alias("side")) for n in buy]
    cells += [F.struct(F.lit(n).alias("pattern"), F.lit("sell").alias("side")) for n in sell]
    return codes.select("code", F.explode(F.array(*cells)).alias("_t")).select("code", "_t.pattern", "_t.side")


def scan_patterns(bars: DataFrame, start=None, end=None, hold: int = HOLD_DAYS, cash: float = START_CASH,
                  cautious: bool = False, buy: Iterable[str] = BUY_CLASS,
                  sell: Iterable[str] = SELL_CLASS, details: bool = False) -> DataFrame:
    """M7/M8: the result row of every code x pattern x side, accounts without a trade included.

    start/end bound the report's years (default: first and last bar of the code).  details: its trades too, as `pattern_result` nests them."""
    buy, sell = tuple(buy), tuple(sell)
    names = tuple(dict.fromkeys(buy + sell))
    cells = [(n, "buy") for n in buy] + [(n, "sell") for n in sell]
    spans = ("bars", "_first", "_last")
    known = ("*", "CAST(size(_dates) AS BIGINT) AS bars", "array_min(_dates) AS _first", "array_max(_dates) AS _last")
    if details:
        codes = T.code_rows(bars, names, cells, cautious).filter("code IS NOT NULL").selectExpr(*known)
        found = T.folded(T.code_candidates(codes, cells, (hold,), spans), cash, KEYS, spans)
        found = found.selectExpr("*", f"IF(size(trades) > 0, {T.nested_details()}, NULL) AS trade_details")
        out = account_figures(found, cash, KEYS, also=(*spans, "trade_details"))
    else:
        place = T.places(cells)
        codes = T.gathered_rows(bars, names, cells, cautious).filter("code IS NOT NULL").selectExpr(*known)
        out = _rated(_rounded(ledgers(codes, [(place[cell], *cell) for cell in cells], (hold,), cash, spans)), (*KEYS, *spans))
    first = F.lit(start).cast("date") if start is not None else F.col("_first")
    last = F.lit(end).cast("date") if end is not None else F.col("_last")
    ret = F.coalesce("return_pct", F.lit(0.0))
    return out.select(
        *KEYS, F.coalesce("trades", F.lit(0)).alias("trades"),
        F.coalesce("win_rate", F.lit(0.0)).alias("win_rate"), ret.alias("return_pct"),
        annualized(ret, years_between(first, last)).alias("annualized"),
        F.round(F.coalesce("held_bars", F.lit(0)) / F.col("bars") * 100, 2).alias("capital_occupation"),
        F.coalesce("sharpe", F.lit(0.0)).alias("sharpe"),
        F.coalesce("max_drawdown", F.lit(0.0)).alias("max_drawdown"), *(["trade_details"] if details else []))


def pattern_result(results: DataFrame, trades: DataFrame | None = None) -> DataFrame:
    """M7 nested: result row + names + its trades as an array of structs; without trades, results have them (`scan_patterns(details=True)`)."""
    if trades is None:
        return results.withColumn("pattern_cn", pattern_cn(F.col("pattern")))
    detail = T.trade_details(trades)
    nested = detail.groupBy(*KEYS).agg(F.sort_array(F.collect_list(F.struct(
        "trade_no", "entry_date", "entry_price", "exit_date", "exit_price", "size", "pnl", "pnl_pct",
        "hold_days", "hold_max_drawdown", "exit_reason"))).alias("trade_details"))
    return (results.join(nested, list(KEYS), "left")
            .withColumn("pattern_cn", pattern_cn(F.col("pattern"))))


def pattern_cn(pattern):
    names = F.create_map(*[F.lit(x) for pair in PATTERN_NAMES.items() for x in pair])
    return F.coalesce(F.element_at(names, pattern), pattern)


def performance_table(results: DataFrame) -> DataFrame:
    """M9: the stored projection, strategy name included."""
    return results.select("code", F.concat_ws("_", "side", "pattern").alias("strategy"), "side", "pattern",
                          "trades", "win_rate", "return_pct", "sharpe", "max_drawdown")


def buy_hold(bars: DataFrame, start=None, end=None, cash: float = START_CASH) -> DataFrame:
    """Full lot at the first open, sold at the last close; codes too dear for a lot drop out."""
    ends = bars.groupBy("code").agg(
        F.min_by("open", "trade_date").alias("buy_price"), F.max_by("close", "trade_date").alias("sell_price"),
        F.min("trade_date").alias("start_date"), F.max("trade_date").alias("end_date"))
    size = F.floor(F.floor(F.lit(cash * INVEST_FRACTION) / F.col("buy_price")) / LOT) * LOT
    pct = (F.col("sell_price") / F.col("buy_price") - 1) * 100
    first = F.lit(start).cast("date") if start is not None else F.col("start_date")
    last = F.lit(end).cast("date") if end is not None else F.col("end_date")
    return ends.withColumn("_size", size).filter("_size > 0").select(
        "code", F.round(pct, 2).alias("return_pct"),
        annualized(pct, years_between(first, last)).alias("annualized"),
        "start_date", "end_date", "buy_price", "sell_price")


def buy_hold_adjusted(bars: DataFrame, held: DataFrame) -> DataFrame:
    """Close-to-close holding scaled by the strategy's share of held days.

    held: (code, return_pct, hold_days), one row per code."""
    ends = bars.groupBy("code").agg(
        F.min_by("close", "trade_date").alias("start_close"), F.max_by("close", "trade_date").alias("end_close"),
        F.min("trade_date").alias("_first"), F.max("trade_date").alias("_last"),
        F.count("*").alias("total_trading_days"))
    years = years_between(F.col("_first"), F.col("_last"))
    hold_pct = F.when(F.col("start_close") > 0,
                      F.round((F.col("end_close") / F.col("start_close") - 1) * 100, 2)).otherwise(0.0)
    j = ends.join(held.select("code", "return_pct", "hold_days"), "code", "left").select(
        "code", "start_close", "end_close", "total_trading_days",
        F.coalesce("hold_days", F.lit(0)).alias("total_hold_days"), years.alias("_years"),
        hold_pct.alias("buy_hold_return"), F.coalesce("return_pct", F.lit(0.0)).alias("_ret"))
    j = j.withColumn("hold_ratio", F.round(F.col("total_hold_days") / F.col("total_trading_days"), 4))
    j = j.withColumn("adj_buy_hold_return", F.round(F.col("buy_hold_return") * F.col("hold_ratio"), 2))
    return j.select("code", "total_trading_days", "total_hold_days", "hold_ratio", "buy_hold_return",
                    annualized(F.col("buy_hold_return"), F.col("_years")).alias("buy_hold_annualized"),
                    "adj_buy_hold_return",
                    annualized(F.col("adj_buy_hold_return"), F.col("_years")).alias("adj_buy_hold_annualized"),
                    annualized(F.col("_ret"), F.col("_years")).alias("strategy_annualized"),
                    F.round("_years", 2).alias("years"))


def keep_last(df: DataFrame, keys: Iterable[str], seq: str) -> DataFrame:
    """Last row per key by the load sequence, as an aggregate: no key is gathered or sorted."""
    return pick_row(df, keys, F.col(seq), F.max_by)


def market_wide_stats(performance: DataFrame) -> DataFrame:
    """Per pattern and side over all stocks and indexes, weighted by trades.

    One pass: the weighted sums and the trade sum come from the same grouping, because an account
    without trades adds nothing to either of the weighted sums."""
    kept = performance.filter(perf_group(F.col("code")) != "etf")
    figures = ("win_rate", "return_pct", "sharpe", "max_drawdown")
    grouped = kept.groupBy("pattern", "side").agg(
        F.sum("trades").alias("trades"), *[F.sum(F.col(c) * F.col("trades")).alias(c) for c in figures])
    return grouped.select("pattern", pattern_cn(F.col("pattern")).alias("pattern_cn"), "side", "trades",
                          *[F.coalesce(F.col(c) / F.nullif("trades", F.lit(0)), F.lit(0.0)).alias(c) for c in figures])


def performance_stats(performance: DataFrame) -> DataFrame:
    """Per code and side."""
    return performance.groupBy("code", "side").agg(
        F.sum("trades").alias("total_trades"), F.round(F.avg("win_rate"), 2).alias("avg_win_rate"),
        F.round(F.avg("return_pct"), 2).alias("avg_return"))


def quality_report(performance: DataFrame, issues: DataFrame | None = None, since=None) -> DataFrame:
    """Rows, tables (code, side) and traded-less tables per market, with a grand total and a status.

    issues: (code, ...) rows that failed to load.  since: only tables of which a row was loaded then or later, and issues of that
    time, count; both frames need `loaded_at` then (`files.read_performance` gives it). A row or issue without a time is older than any."""
    per_file = performance.groupBy("code", "side").agg(
        F.count("*").alias("rows"), F.sum("trades").alias("t"), *([F.max("loaded_at").alias("newest")] if since is not None else []))
    if since is not None:
        first = F.lit(since).cast("timestamp")
        per_file = per_file.filter(F.col("newest") >= first)
        issues = issues.filter(F.col("loaded_at") >= first) if issues is not None else None
    perf = per_file.select(perf_group(F.col("code")).alias("market"), "rows",
                           F.lit(1).alias("files"), (F.col("t") == 0).cast("int").alias("idle"),
                           F.lit(0).alias("issues"))
    if issues is not None:
        perf = perf.unionByName(issues.select(
            perf_group(F.col("code")).alias("market"), F.lit(0).cast("long").alias("rows"), F.lit(0).alias("files"),
            F.lit(0).alias("idle"), F.lit(1).alias("issues")))
    out = perf.rollup("market").agg(*[F.sum(c).alias(c) for c in ("rows", "files", "idle", "issues")])
    status = F.when(F.col("issues") == 0, "good").when(F.col("issues") < 10, "warning").otherwise("error")
    return out.select(F.coalesce("market", F.lit("total")).alias("market"), "rows", "files", "idle", "issues",
                      status.alias("status"))


def db_stats(universe: DataFrame, bars: DataFrame) -> DataFrame:
    """Securities, bars and date range per board, with the total."""
    cov = bars.groupBy("code").agg(F.count("*").alias("bars"), F.min("trade_date").alias("lo"),
                                   F.max("trade_date").alias("hi"))
    return (universe.select("code", "board").join(cov, "code", "left").rollup("board")
            .agg(F.count("*").alias("securities"), F.count("lo").alias("covered"),
                 F.coalesce(F.sum("bars"), F.lit(0)).alias("bars"), F.min("lo").alias("min_date"),
                 F.max("hi").alias("max_date"))
            .withColumn("board", F.coalesce("board", F.lit("total"))))


def account_return(trades: DataFrame, cash: float = START_CASH, keys: Iterable[str] = KEYS, rounded: bool = False) -> DataFrame:
    """Final value of the account over its start, percent, cut to two digits or, as for the one-account form, rounded."""
    final = trades.groupBy(*keys).agg(F.max_by("cash_out", "trade_no").alias("final_value"))
    pct = (F.col("final_value") / F.lit(cash) - 1) * 100
    two = F.round(pct, 2) if rounded else (pct * 100).cast("long") / 100.0
    return final.select(*keys, "final_value", two.alias("account_return"))


def log_return(values: DataFrame, value: str = "close") -> DataFrame:
    """Total and yearly log return per code, and the simple return they stand for."""
    ends = values.groupBy("code").agg(F.min_by(value, "trade_date").alias("_a"), F.max_by(value, "trade_date").alias("_b"),
                                      F.count("*").alias("_n"))
    total = F.log(F.col("_b") / F.col("_a"))
    return ends.filter("_a > 0 AND _b > 0").select(
        "code", F.round(total * 100, 4).alias("log_return"),
        F.round((F.exp(total / F.col("_n") * YEAR_BARS) - 1) * 100, 4).alias("annual_return"),
        F.round((F.exp(total) - 1) * 100, 4).alias("simple_return"))


def segment_summary(results: DataFrame) -> DataFrame:
    """Per code over its segments (code, segment_id, type, return_pct, trades, won), by type and in total."""
    best = F.max_by("segment_id", F.struct("return_pct", "segment_id"))
    worst = F.min_by("segment_id", F.struct("return_pct", "segment_id"))
    return (results.rollup("code", "type").agg(
        F.count("*").alias("segments"), F.count_if(F.col("return_pct") > 0).alias("positive"),
        F.round(F.sum("return_pct"), 2).alias("total_return"),
        F.round(F.round(F.sum("return_pct"), 2) / F.count("return_pct"), 2).alias("avg_return"),
        F.sum("trades").alias("trades"),
        F.coalesce(F.bround(F.sum("won") / F.nullif(F.sum("trades"), F.lit(0)) * 100, 0), F.lit(0.0)).alias("win_rate"),
        best.alias("best_segment"), worst.alias("worst_segment"))
        .filter("code IS NOT NULL").withColumn("type", F.coalesce("type", F.lit("all"))))


def compare_variants(a: DataFrame, b: DataFrame, min_trades: int = 10) -> DataFrame:
    """Per code, variant b against variant a where a traded often enough.

    a, b: (code, trades, win_rate, return_pct, sharpe, max_drawdown)."""
    figures = ("win_rate", "return_pct", "sharpe", "max_drawdown")
    j = (a.filter(F.col("trades") >= min_trades).alias("a").join(b.alias("b"), "code", "left"))
    return j.select("code", F.col("a.trades").alias("trades_a"), F.coalesce("b.trades", F.lit(0)).alias("trades_b"),
                    *[F.round(F.col(f"a.{c}"), 2).alias(f"{c}_a") for c in figures],
                    *[F.round(F.coalesce(F.col(f"b.{c}"), F.lit(0.0)), 2).alias(f"{c}_b") for c in figures],
                    *[F.round(F.round(F.coalesce(F.col(f"b.{c}"), F.lit(0.0)), 2) - F.round(F.col(f"a.{c}"), 2), 2)
                      .alias(f"{c}_diff") for c in figures])


def variant_means(compared: DataFrame) -> DataFrame:
    """Means of both variants; accounts of b without a trade are left out of b's win and return means."""
    active = F.col("trades_b") > 0
    def mean_b(c):
        return F.round(F.sum(f"{c}_b") / F.nullif(F.count_if(active), F.lit(0)), 2).alias(f"{c}_b")
    return compared.agg(
        F.count("*").alias("codes"), F.count_if(~active).alias("idle"),
        mean_b("win_rate"), F.round(F.avg("win_rate_a"), 2).alias("win_rate_a"),
        mean_b("return_pct"), F.round(F.avg("return_pct_a"), 2).alias("return_pct_a"),
        F.round(F.avg("sharpe_diff"), 2).alias("sharpe_diff"),
        F.round(F.avg("max_drawdown_diff"), 2).alias("max_drawdown_diff"))


def observe_day_sweep(bars: DataFrame, names: Iterable[str], days: Iterable[int] = range(1, 10),
                      cash: float = START_CASH) -> DataFrame:
    """Account metrics for every holding period, as one job.

    Patterns are found once; each code's bars are one row, from which the accounts of every pattern and period are formed together (see
    `ledgers`). Missing prices are filled forward first."""
    names, days = tuple(names), tuple(days)
    cells = [(n, side) for n in names for side in ("buy", "sell")]
    place = T.places(cells)
    found = ledgers(T.gathered_rows(bars, names, cells), [(place[cell], *cell) for cell in cells], days, cash, traded=True).withColumnRenamed("hold", "observe_day")
    return _rated(_rounded(found), ("code", "observe_day", "pattern", "side")).drop("final_value")


def candidate_cases(results: DataFrame, min_trades: int = 1) -> DataFrame:
    """Which code x pattern x side trades at all."""
    return results.filter(F.col("trades") >= min_trades).select(*KEYS, "trades")


def tracking_summary(signals: DataFrame, targets: DataFrame) -> DataFrame:
    """One row of totals for a tracking day.

    signals: (code, side, win_rate, tier); targets: (code, is_index, failed)."""
    s = signals.select("code", "side", "win_rate", "tier", F.lit(None).cast("boolean").alias("is_index"),
                       F.lit(None).cast("boolean").alias("failed"))
    t = targets.select("code", F.lit(None).cast("string").alias("side"), F.lit(None).cast("double").alias("win_rate"),
                       F.lit(None).cast("string").alias("tier"), "is_index", "failed")
    buy = F.col("side") == "buy"
    return s.unionByName(t).agg(
        F.count("failed").alias("total"), F.count_if(~F.col("failed")).alias("success"),
        F.count_if(F.col("failed")).alias("failed"), F.count_if(F.col("is_index")).alias("index_count"),
        F.count_if(~F.col("is_index")).alias("stock_count"),
        F.countDistinct(F.when(F.col("side").isNotNull(), F.col("code"))).alias("codes_with_signals"),
        F.count_if(buy).alias("buy_count"), F.count_if(buy & (F.col("tier") == "strong")).alias("strong_buy_count"),
        F.count_if(buy & (F.col("tier") == "recommend")).alias("recommend_buy_count"),
        F.count_if(buy & (F.col("tier") == "other")).alias("other_buy_count"),
        F.count_if(F.col("side") == "sell").alias("sell_count"),
        F.round(F.avg(F.when(buy, F.col("win_rate"))), 2).alias("avg_win_rate"))

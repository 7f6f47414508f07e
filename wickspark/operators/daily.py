"""The daily cross-section: signals of a day, ranked and followed up."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wickspark.functions.codes import is_index_short, listed_in_beijing, perf_group
from wickspark.model import DAILY_PATTERNS, LOOK_BACK
from wickspark.operators import candles, refine
from wickspark.operators.candles import W
from wickspark.operators.metrics import keep_last, pattern_cn
from wickspark.operators.trades import WHOLE

PERF = ("win_rate", "return_pct", "sharpe", "max_drawdown", "trades")


def daily_signals(bars: DataFrame, days, names: Iterable[str] = DAILY_PATTERNS, cautious: bool = False,
                  since=None) -> DataFrame:
    """Every pattern that speaks on the tracking day(s), with the day's close and change.

    days: one date or a list.  The whole history is the look-back, so no pattern is silenced by a
    short window; only the rows of the asked days leave the window stage.  Bars are counted over all of it; of each code those
    from LOOK_BACK before its first asked day to its last one then go through the wide windows of the patterns.  `since` reads less with the same
    result: codes with LOOK_BACK bars from `since` to the first day are judged on these (the longest pattern looks back 14
    bars); only for codes with a bar on the days that have fewer, as after a suspension, is the rest read too. Bars from a store come
    from `recent_bars`, which knows beforehand what is needed."""
    names = tuple(names)
    asked = list(days) if isinstance(days, (list, tuple)) else [days]
    wanted = [F.lit(d).cast("date") for d in asked]
    if since is not None:
        recent = bars.filter(F.col("trade_date") >= F.lit(since).cast("date"))
        seen = recent.groupBy("code").agg(F.count_if(F.col("trade_date") <= F.least(*wanted, F.lit("9999-12-31").cast("date"))).alias("_n"),
                                          F.max(F.col("trade_date").isin(wanted)).alias("_on"))
        lacking = seen.filter(F.col("_on") & (F.col("_n") < LOOK_BACK)).select("code")
        older = bars.filter(F.col("trade_date") < F.lit(since).cast("date")).join(lacking, "code", "left_semi")
        bars = recent.unionByName(older)
    rules = refine.signal_rules() if cautious else {}
    guarded = [n for n in names if n in rules]
    placed = candles.bar_index(bars).withColumns({"_row": F.expr(f"row_number() {W}"), "_asked": F.col("trade_date").isin(wanted)})
    spans = placed.selectExpr("*", f"min(IF(_asked, _row, NULL)) {WHOLE} AS _lo", f"max(IF(_asked, _row, NULL)) {WHOLE} AS _hi")
    near = spans.filter(f"_row BETWEEN _lo - {LOOK_BACK} AND _hi").drop("_row", "_asked", "_lo", "_hi")
    base = candles.frame(near).withColumn("_prev", F.expr(f"lag(close, 1) {W}"))
    on_day = base.filter(F.col("trade_date").isin(wanted) & (F.col("bar_idx") >= 3))
    rows = on_day.select(
        "code", "trade_date", "close",
        F.when(F.col("_prev") > 0, F.round((F.col("close") - F.col("_prev")) / F.col("_prev") * 100, 2)).alias("pct_chg"),
        candles.values(names).alias("_values"), *[F.expr(str(rules[n])).alias(f"_ok_{n}") for n in guarded])
    long = candles.unpivot(rows, names, "code", "trade_date", "close", "pct_chg", *[f"_ok_{n}" for n in guarded])
    if guarded:
        arms = " ".join(f"WHEN '{n}' THEN _ok_{n}" for n in guarded)
        long = long.filter(f"value < 0 OR coalesce(CASE pattern {arms} ELSE true END, false)")
    return long.select("code", "trade_date", F.when(F.col("value") > 0, "buy").otherwise("sell").alias("side"),
                       F.col("pattern").alias("fired"), refine.alias_pattern().alias("pattern"), "value", "close", "pct_chg")


def day_errors(requested: DataFrame, bars: DataFrame, day) -> DataFrame:
    """Requested codes that cannot be judged on the day, with the reason."""
    d = F.lit(day).cast("date")
    have = bars.groupBy("code").agg(F.count_if(F.col("trade_date") <= d).alias("n"),
                                    F.max(F.when(F.col("trade_date") == d, 1)).alias("on_day"))
    j = requested.join(have, "code", "left")
    reason = (F.when(F.col("n").isNull(), "no data").when(F.col("on_day").isNull(), "day not in data")
              .when(F.col("n") < 4, "fewer than 4 bars"))
    return j.select("code", reason.alias("error")).filter("error IS NOT NULL")


def sell_gate(signals: DataFrame, held: DataFrame, keep_when_empty: bool = True) -> DataFrame:
    """Sells only for held codes; an empty held list keeps all sells (or none, by the flag).

    The emptiness test is a scalar subquery of the plan, so nothing runs on the driver."""
    known = held.select("code").distinct().withColumn("_h", F.lit(True))
    empty = (held.agg(F.count("*")).scalar() == 0) & F.lit(keep_when_empty)
    return signals.join(known, "code", "left").filter((F.col("side") == "buy") | F.col("_h") | empty).drop("_h")


def attach_performance(signals: DataFrame, performance: DataFrame) -> DataFrame:
    """D3: stored account figures of (code, side, reported pattern); no_perf_data where missing."""
    perf = performance.select("code", "side", "pattern", *[F.col(c) for c in PERF], F.lit(False).alias("_known"))
    j = signals.join(perf, ["code", "side", "pattern"], "left")
    return j.withColumn("no_perf_data", F.coalesce("_known", F.lit(True))).drop("_known")


def attach_market(signals: DataFrame, market: DataFrame, texts: DataFrame | None = None) -> DataFrame:
    """Market-wide figures, display name and, from texts (pattern, pattern_desc), the description.

    market has one row per pattern and side, texts one per pattern; how they are joined is left to Spark, which sees their size."""
    m = market.select("pattern", "side", F.col("win_rate").alias("market_win_rate"),
                      F.col("return_pct").alias("market_return"), F.col("trades").alias("market_trade_count"))
    out = signals.join(m, ["pattern", "side"], "left").withColumn("pattern_cn", pattern_cn(F.col("pattern")))
    return out if texts is None else out.join(texts.select("pattern", "pattern_desc"), "pattern", "left")


def tier(signals: DataFrame) -> DataFrame:
    """Strong / recommend / other for buys, null for sells."""
    base = (F.col("trades") >= 10) & (F.col("return_pct") > 0)
    level = (F.when(base & (F.col("win_rate") >= 70), "strong").when(base & (F.col("win_rate") >= 60), "recommend")
             .otherwise("other"))
    return signals.withColumn("tier", F.when(F.col("side") == "buy", level))


def track_mode(signals: DataFrame, config: DataFrame, mode: str = "full") -> DataFrame:
    """Full / directional / configured_only.  Indexes are always tracked in full."""
    if mode == "full":
        return signals
    on = config.filter("enabled")
    pairs = on.select("code", F.col("pattern").alias("fired"), F.col("pattern_type").alias("side"), F.lit(True).alias("_pair")).distinct()
    codes = on.select("code", F.lit(True).alias("_conf")).distinct()
    j = signals.join(codes, "code", "left").join(pairs, ["code", "fired", "side"], "left")
    free = is_index_short(F.col("code"))
    keep = free | F.coalesce("_pair", F.lit(False))
    if mode == "directional":
        keep = keep | F.col("_conf").isNull()
    return j.filter(keep).drop("_pair", "_conf")


def track_groups(mode: str, indexes: DataFrame, stocks: DataFrame, held: DataFrame, targets: DataFrame | None = None) -> DataFrame:
    """The codes of a tracking run with the group they come from, each code once."""
    def group(df: DataFrame, label: str, rank: int) -> DataFrame:
        return df.select("code", F.lit(label).alias("grp"), F.lit(rank).alias("_r"))

    index_of, stock_of = is_index_short(F.col("code")), ~is_index_short(F.col("code"))
    parts = []
    if mode in ("all", "index"):
        parts.append(group(indexes, "index", 1))
    if mode in ("all", "stock"):
        parts.append(group(stocks, "stock", 2))
    if mode == "position":
        parts += [group(held.filter(index_of), "held index", 1), group(held.filter(stock_of), "held stock", 2)]
    if targets is not None:
        parts += [group(targets.filter(index_of), "target index", 3), group(targets.filter(stock_of), "target stock", 4)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return (out.filter(~listed_in_beijing(F.col("code"))).groupBy("code")
            .agg(F.min_by("grp", "_r").alias("grp")).withColumn("is_index", index_of))


def recent_weekdays(spark, today, days: int = 7) -> DataFrame:
    """The last `days` Mondays to Fridays up to `today`."""
    end = F.lit(today).cast("date")
    span = F.explode(F.sequence(F.date_sub(end, days * 2 + 7), end)).alias("trade_date")
    return (spark.range(1).select(span).filter(F.dayofweek("trade_date").between(2, 6))
            .orderBy(F.desc("trade_date")).limit(days))


def recent_signals(signals: DataFrame, today, days: int = 7) -> DataFrame:
    """The signals of those days; the list of days is fixed-size, so it is broadcast."""
    return signals.join(F.broadcast(recent_weekdays(signals.sparkSession, today, days)), "trade_date", "left_semi")


def consecutive(signals: DataFrame) -> DataFrame:
    """Same code and side at least twice in the period."""
    n = signals.groupBy("code", "side").agg(F.count("*").alias("_n"))
    return signals.join(n, ["code", "side"]).withColumn("is_consecutive", F.col("_n") >= 2).drop("_n")


def follow_up(signals: DataFrame, bars: DataFrame) -> DataFrame:
    """Last, best and worst close after the signal day against the signal's close.

    What follows a bar is a window over the bars, computed once per bar; the join is on equality,
    so no signal is paired with all later bars."""
    after = "OVER (PARTITION BY code ORDER BY trade_date ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)"
    rest = bars.selectExpr("code", "trade_date", f"last(close) {after} AS _last", f"max(close) {after} AS _max",
                           f"min(close) {after} AS _min", f"count(close) {after} AS followup_days")
    j = signals.join(rest, ["code", "trade_date"], "left")
    def pct(c: str, name: str):
        return F.when((F.col("close") > 0) & (F.col("followup_days") > 0),
                      F.round((F.col(c) - F.col("close")) / F.col("close") * 100, 2)).alias(name)
    return j.select(*signals.columns, pct("_last", "followup_return"), pct("_max", "followup_max"),
                    pct("_min", "followup_min"), "followup_days")


def legacy_filter(signals: DataFrame) -> DataFrame:
    """D11"""
    return signals.filter("win_rate > 50 AND return_pct > 0")


def position_quotes(positions: DataFrame, bars: DataFrame) -> DataFrame:
    """Newest close of each held code and its change, derived where not given."""
    given = F.col("pct_chg") if "pct_chg" in bars.columns else F.lit(None).cast("double")
    last = (bars.select("code", "trade_date", "close", given.alias("pct_chg"))
            .selectExpr("*", f"lag(close, 1) {W} AS _prev"))
    last = last.groupBy("code").agg(F.max_by(F.struct("trade_date", "close", "pct_chg", "_prev"), "trade_date").alias("q"))
    made = F.when(F.col("q._prev") > 0, F.round((F.col("q.close") - F.col("q._prev")) / F.col("q._prev") * 100, 4))
    return positions.join(last, "code", "left").select(
        *positions.columns, F.col("q.close").alias("current"), F.coalesce("q.pct_chg", made).alias("pct_chg"),
        F.col("q.trade_date").alias("quote_date"))


def last_weekday(day):
    """Saturday and Sunday fall back to Friday."""
    return F.when(F.dayofweek(day) == 7, F.date_sub(day, 1)).when(F.dayofweek(day) == 1, F.date_sub(day, 2)).otherwise(day)


def security_performance(performance: DataFrame, universe: DataFrame, seq: str) -> DataFrame:
    """Stored rows per code and strategy, newest load only, with names."""
    kept = keep_last(performance, ["code", "side", "pattern"], seq)
    return (kept.join(universe.select("code", "name"), "code", "left")
            .select("code", F.coalesce("name", F.lit("")).alias("name"), perf_group(F.col("code")).alias("type"), "side",
                    F.concat_ws("_", "side", "pattern").alias("strategy"), pattern_cn(F.col("pattern")).alias("pattern_cn"), *PERF))


def retry_set(requested: DataFrame, done: DataFrame) -> DataFrame:
    """Requested codes without a result."""
    return requested.join(done.select("code").distinct(), "code", "left_anti")

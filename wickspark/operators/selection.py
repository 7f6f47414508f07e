"""Filters, universes and task lists."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wickspark.functions.codes import classify_board, is_index_short, listed_in_beijing
from wickspark.functions.pick import coded
from wickspark.model import DAILY_PATTERNS, TRACKED_INDEXES

OHLC = ("open", "high", "low", "close")


def date_range(df: DataFrame, start, end) -> DataFrame:
    """F8: inclusive; pushed down to the scan."""
    return df.filter(F.col("trade_date").between(F.lit(start).cast("date"), F.lit(end).cast("date")))


def codes_without_rows(requested: DataFrame, df: DataFrame, start, end) -> DataFrame:
    """F8: requested codes that have nothing in the range."""
    return requested.join(date_range(df, start, end).select("code").distinct(), "code", "left_anti")


def fill_forward_zero(df: DataFrame, cols: Iterable[str] = (*OHLC, "vol")) -> DataFrame:
    """last known value per code, 0 before the first."""
    run = "OVER (PARTITION BY code ORDER BY trade_date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    cols = set(cols)
    return df.selectExpr(*[f"coalesce(last({c}, true) {run}, 0D) AS {c}" if c in cols else c for c in df.columns])


_RULES = [*((f"_null_{x}", f"null {x}") for x in (*OHLC, "trade_date")), ("_odd", "price out of range"), ("_low", "price not positive"), ("_dup", "duplicate date")]


def _day_counts() -> list:
    """Per key and date: the rows, and how many of them break each rule."""
    o, h, l, c = (F.col(x) for x in OHLC)
    odd = (h < F.greatest(o, c)) | (l > F.least(o, c)) | (h < l)
    low = (o <= 0) | (h <= 0) | (l <= 0) | (c <= 0)
    return [F.count("*").alias("_rows"), *[F.count_if(F.col(x).isNull()).alias(f"_null_{x}") for x in OHLC], F.count_if(odd).alias("_odd"), F.count_if(low).alias("_low")]


def _totals(total) -> dict:
    """The same per key; total: how a column of day counts is summed up."""
    out = {c: total(F.col(c)) for c in (*(f"_null_{x}" for x in OHLC), "_odd", "_low")}
    out["_null_trade_date"] = F.coalesce(total(F.when(F.col("trade_date").isNull(), F.col("_rows"))), F.lit(0))
    return out | {"_dup": total(F.col("_rows") - 1), "_all": total(F.col("_rows"))}


def _verdict() -> tuple:
    """The first rule that is broken, and the rows that break it."""
    reason, bad = F.lit(None).cast("string"), F.lit(0).cast("long")
    for col, text in reversed(_RULES):
        reason = F.when(F.col(col) > 0, text).otherwise(reason)
        bad = F.when(F.col(col) > 0, F.col(col)).otherwise(bad)
    return reason, bad


def quality_check(raw: DataFrame, keys: Iterable[str] = ("code",)) -> DataFrame:
    """one row per code (or load and code): passed, reason (the first failing rule) and the rows it counts.

    Counting duplicates by (code, date) first makes both steps aggregates with map-side combine, so a
    code with a third of all raw rows is no hot spot."""
    keys = list(keys)
    per = raw.groupBy(*keys, "trade_date").agg(*_day_counts()).groupBy(*keys).agg(*[c.alias(n) for n, c in _totals(F.sum).items()])
    reason, bad = _verdict()
    return per.select(*keys, F.col("_all").alias("rows"), reason.isNull().alias("passed"), reason.alias("reason"), bad.alias("bad_rows"))


def judged(raw: DataFrame, keys: Iterable[str] = ("code",)) -> DataFrame:
    """F10 in one pass over raw: a row per key and date with the columns of raw, and of its key all_rows, reason and bad_rows (null and 0 where it passes).

    One aggregate counts what the rules ask for and carries the values; the verdict is then a window over the days of a key. A
    key that passes has one row a day, so its values are those rows; what stands in a day of a key that fails is not said."""
    keys = list(keys)
    narrow, back = coded(raw, (*keys, "trade_date"))
    rest = [c for c in raw.columns if c not in keys and c != "trade_date"]
    day = narrow.groupBy(*keys, "trade_date").agg(*_day_counts(), *[F.max(c).alias(c) for c in rest])
    whole = Window.partitionBy(*keys)
    told = day.withColumns(_totals(lambda c: F.sum(c).over(whole)))
    reason, bad = _verdict()
    return back(told.select(*raw.columns, F.col("_all").alias("all_rows"), reason.alias("reason"), bad.alias("bad_rows")))


def good_rows(raw: DataFrame, keys: Iterable[str] = ("code",)) -> DataFrame:
    """the rows of the codes (or loads and codes) that pass; raw is read once, but for texts that aren't keys, see `coded`."""
    return judged(raw, keys).filter("reason IS NULL").select(*raw.columns)


def market_cap_filter(universe: DataFrame, min_mv: float | None = None, max_mv: float | None = None) -> DataFrame:
    """total_mv in units of 10,000."""
    out = universe
    if min_mv is not None:
        out = out.filter(F.col("total_mv") >= float(min_mv))
    if max_mv is not None:
        out = out.filter(F.col("total_mv") <= float(max_mv))
    return out


def select_universe(universe: DataFrame, types: Iterable[str], min_mv: float | None = None,
                    max_mv: float | None = None, etfs: DataFrame | None = None) -> DataFrame:
    """fixed indexes + stocks of the asked boards within the size limits + listed funds."""
    types = tuple(types)
    code = F.col("code")
    head = F.substring(code, 1, 3)
    board = (F.when(head.isin("300", "301"), "cy").when(head == "688", "kc")
             .when(code.endswith(".SH") | code.endswith(".SZ"), "hs"))
    stock_types = [t for t in types if t in ("hs", "cy", "kc")]
    out = market_cap_filter(universe, min_mv, max_mv).filter(board.isin(*stock_types)).select("code", "name", board.alias("type"))
    if "index" in types:
        fixed = F.explode(F.array(*[F.struct(F.lit(c).alias("code"), F.lit(n).alias("name"))
                                    for c, n in TRACKED_INDEXES.items()]))
        one = universe.sparkSession.range(1).select(fixed.alias("_i"))
        out = one.select("_i.code", "_i.name", F.lit("index").alias("type")).unionByName(out)
    if "etf" in types and etfs is not None:
        with_market = F.when(code.contains("."), code).otherwise(
            F.concat(code, F.lit("."), F.upper(F.coalesce(F.col("market"), F.lit("SH")))))
        out = out.unionByName(etfs.filter(F.length("code") >= 6).select(with_market.alias("code"), "name", F.lit("etf").alias("type")))
    return out


def exclude_bj(codes: DataFrame) -> DataFrame:
    """served codes, each once (the first by `seq` where given)."""
    kept = codes.filter(~listed_in_beijing(F.col("code")))
    if "seq" not in codes.columns:
        return kept.select("code").distinct()
    return kept.groupBy("code").agg(F.min("seq").alias("seq"))


def list_securities(securities: DataFrame, board: str | None = None, include_st: bool = False) -> DataFrame:
    """F14"""
    out = securities if board is None else securities.filter(F.col("board") == board)
    if not include_st:
        out = out.filter("NOT coalesce(is_st, false)")
    return out.orderBy("code")


def search_securities(securities: DataFrame, q: str, limit: int = 30, performance: DataFrame | None = None) -> DataFrame:
    """case-insensitive part of code or name, at most `limit` hits by code; with `performance`
    only codes that have a row there."""
    text = q.strip().upper()
    hit = securities.filter((F.upper("code").contains(text)) | (F.upper("name").contains(text)))
    if performance is not None:
        hit = hit.join(performance.select("code").distinct(), "code", "left_semi")
    return hit.orderBy("code").limit(limit)


def watchlist_filter(watchlist: DataFrame, side: str | None = None, q: str | None = None, has_note: bool = False) -> DataFrame:
    """F16: newest first."""
    out = watchlist if side is None else watchlist.filter(F.col("signal_type") == side)
    if q:
        text = F.lower(F.concat_ws("", *[F.coalesce(F.col(c), F.lit("")) for c in ("name", "code", "pattern_cn", "pattern")]))
        out = out.filter(text.contains(q.strip().lower()))
    if has_note:
        out = out.filter("trim(coalesce(note, '')) <> ''")
    return out.orderBy(F.desc("created_at"), "code", "pattern")


WATCH_KEYS = ["code", "pattern", "side", "track_date"]


def mark_watched(signals: DataFrame, watchlist: DataFrame) -> DataFrame:
    """is the signal on the watchlist?"""
    known = watchlist.select(*WATCH_KEYS).distinct().withColumn("_w", F.lit(True))
    return signals.join(known, WATCH_KEYS, "left").withColumn("watched", F.coalesce("_w", F.lit(False))).drop("_w")


def not_watched(signals: DataFrame, watchlist: DataFrame) -> DataFrame:
    """signals that would be new on the watchlist."""
    return signals.join(watchlist.select(*WATCH_KEYS), WATCH_KEYS, "left_anti")


def chart_bars(bars: DataFrame, n: int = 500) -> DataFrame:
    """the last n bars per code, then nulls as 0, then bars without any price dropped."""
    newest = F.row_number().over(Window.partitionBy("code").orderBy(F.desc("trade_date")))
    last = bars.withColumn("_r", newest).filter(F.col("_r") <= n)
    cols = [F.coalesce(F.nanvl(c, F.lit(None).cast("double")), F.lit(0.0)).alias(c) for c in (*OHLC, "vol")]
    return last.select("code", "trade_date", *cols).filter("NOT (open = 0 AND high = 0 AND low = 0 AND close = 0)")


def clean_numeric(col, default: float = 0.0):
    """number, or the default for null, NaN and text that is no number."""
    value = F.try_cast(col, "double") if hasattr(F, "try_cast") else col.try_cast("double")
    return F.coalesce(F.nanvl(value, F.lit(None).cast("double")), F.lit(default))


def focus_codes(positions: DataFrame, watchlist: DataFrame, config: DataFrame) -> DataFrame:
    """codes held, watched or configured."""
    parts = [d.select(F.trim("code").alias("code")) for d in (positions, watchlist, config)]
    return parts[0].union(parts[1]).union(parts[2]).filter("code <> ''").distinct()


def backtest_tasks(universe: DataFrame, focus: DataFrame, buy_only: bool = True,
                   patterns: Iterable[str] = DAILY_PATTERNS) -> DataFrame:
    """every pattern's buy side for every code, its sell side for focus codes (or for all)."""
    names = F.array(*map(F.lit, patterns))
    if buy_only:
        marked = universe.select("code").join(focus.select("code").distinct().withColumn("_f", F.lit(True)), "code", "left")
        sides = F.when(F.col("_f"), F.array(F.lit("buy"), F.lit("sell"))).otherwise(F.array(F.lit("buy")))
    else:
        marked, sides = universe.select("code"), F.array(F.lit("buy"), F.lit("sell"))
    return (marked.select("code", F.explode(names).alias("pattern"), sides.alias("_s"))
            .select("code", "pattern", F.explode("_s").alias("side")))


def params_key(**params) -> str:
    """text under which a run's parameters are hashed."""
    return "|".join(f"{k}={params[k]}" for k in sorted(params))


def pending_tasks(tasks: DataFrame, completed: DataFrame, params: str) -> DataFrame:
    """tasks not yet done under the same parameters (completed carries params_hash)."""
    done = completed.filter(F.col("params_hash") == F.sha1(F.lit(params)))
    return tasks.join(done.select("code", "pattern", "side"), ["code", "pattern", "side"], "left_anti")


def configured_patterns(config: DataFrame) -> DataFrame:
    """enabled configurations per code as a list, with counts by side."""
    item = F.struct("pattern", "pattern_type", "observe_day")
    return config.filter("enabled").groupBy("code").agg(
        F.sort_array(F.collect_list(item)).alias("patterns"), F.count("*").alias("n"),
        F.count_if(F.col("pattern_type") == "buy").alias("n_buy"), F.count_if(F.col("pattern_type") == "sell").alias("n_sell"))


def replace_configs(config: DataFrame, new: DataFrame) -> DataFrame:
    """all rows of the codes in `new` give way to the new ones."""
    return config.join(new.select("code").distinct(), "code", "left_anti").unionByName(new, allowMissingColumns=True)

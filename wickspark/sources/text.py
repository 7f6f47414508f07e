"""Quote lines and tracking logs as text tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wickspark.functions.pick import computed_once
from wickspark.operators.ordered import running_max, with_previous

# The shape of a quote variable and of a tracking line, and the words that open a block.
QUOTE = r"var hq_str_(\w+)=[\"']([^\"']*)[\"']"
LINE = r"^\S+\s+\S+\s+跟踪日：(\S+)\s+-\s+(\S+)\s+-\s+(.+?):\s+(.+)$"
BUY_START, SELL_START = "买入原因：", "卖出提示："
DETAIL_STARTS = ("触发形态：", "策略在该股的")
HELD_OUT = "达到买入天数"
# positions (from 0) of date, open, high, low, close, volume in the two quote layouts
SHARE_FIELDS, SHARE_MIN = (30, 1, 4, 5, 3, 8), 33
US_FIELDS, US_MIN = (3, 5, 6, 7, 1, 10), 11
NIGHT_HOURS = 4  # a US quote stamped before this hour belongs to the day before


def parse_quote_lines(lines: DataFrame, text: str = "value") -> DataFrame:
    """Text lines -> symbol, trade_date, open, high, low, close, vol; lines that do not parse drop out."""
    raw = computed_once(lines.select(text), symbol=F.regexp_extract(text, QUOTE, 1),
                        _p=F.split(F.regexp_extract(text, QUOTE, 2), ",")).filter("symbol <> ''")
    n = F.size("_p")
    share = F.col("symbol").rlike("^(sh|sz)") & (n >= SHARE_MIN)
    us = F.col("symbol").startswith("gb_") & (n >= US_MIN)

    def number(i: int):
        part = lambda k: F.try_element_at("_p", F.lit(k + 1))
        return F.when(share, part(SHARE_FIELDS[i]).try_cast("double")).when(us, part(US_FIELDS[i]).try_cast("double"))

    stamp = F.try_to_timestamp(F.try_element_at("_p", F.lit(US_FIELDS[0] + 1)))
    us_day = F.when(F.hour(stamp) < NIGHT_HOURS, F.date_sub(stamp.cast("date"), 1)).otherwise(stamp.cast("date"))
    share_day = F.try_to_timestamp(F.try_element_at("_p", F.lit(SHARE_FIELDS[0] + 1))).cast("date")
    out = raw.select("symbol", F.when(share, share_day).when(us, us_day).alias("trade_date"),
                     *[number(i).alias(c) for i, c in enumerate(("open", "high", "low", "close", "vol"), start=1)])
    return out.dropna()


def parse_tracking_lines(lines: DataFrame) -> DataFrame:
    """(file, line_no, value) -> tracking fields, null where the line is none."""
    def part(i):
        return F.nullif(F.regexp_extract("value", LINE, i), F.lit(""))
    return lines.select("file", "line_no", part(1).alias("track_date"), part(2).alias("code"),
                        part(3).alias("name"), part(4).alias("msg"))


def tracking_blocks(lines: DataFrame) -> DataFrame:
    """One row per signal block: its start line and the detail lines that follow it directly.

    A detail line belongs to the block when nothing else came in between: the last start is later
    than the last break.  Both are running maxima of the line number, taken in two levels, because one
    log file may hold any number of lines.  Equal blocks are reported once.
    """
    p = with_previous(parse_tracking_lines(lines), "file", "line_no", {"_pcode": "code"})
    start = F.coalesce(F.col("msg").startswith(BUY_START) | F.col("msg").startswith(SELL_START), F.lit(False))
    detail = F.coalesce(F.col("msg").startswith(DETAIL_STARTS[0]) | F.col("msg").startswith(DETAIL_STARTS[1]), F.lit(False))
    p = p.withColumn("_start", start).withColumn("_part", ~start & detail & F.col("code").eqNullSafe(F.col("_pcode")))
    p = p.withColumn("_s", F.when(F.col("_start"), F.col("line_no"))).withColumn(
        "_b", F.when(~F.col("_start") & ~F.col("_part"), F.col("line_no")))
    p = running_max(p, "file", "line_no", {"_last_start": "_s", "_last_break": "_b"})
    inside = p.filter("_start OR (_last_start IS NOT NULL AND _last_start > coalesce(_last_break, -1L))")
    perf = F.when(F.col("msg").startswith(DETAIL_STARTS[1]), F.col("msg"))
    figure = lambda label: F.regexp_extract(perf, label + r"：([\d.-]+)", 1).try_cast("double")
    head = F.when(F.col("_start"), F.col("msg"))
    blocks = inside.groupBy("file", "_last_start").agg(
        F.max("track_date").alias("track_date"), F.max("code").alias("code"), F.max("name").alias("name"),
        F.max(head).alias("head"), F.max(figure(r"胜率\(%\)")).alias("win_rate"),
        F.max(figure(r"简易收益率\(%\)")).alias("return_pct"), F.count("*").alias("lines"))
    side = F.when(F.col("head").startswith(BUY_START), "buy").otherwise("sell")
    pattern = F.nullif(F.regexp_extract("head", r"(?:buy|sell)_signal_(\w+)", 1), F.lit(""))
    pattern = F.when(F.col("head").contains(HELD_OUT), F.lit(None).cast("string")).otherwise(F.coalesce(pattern, F.lit("unknown")))
    out = blocks.select("file", F.col("_last_start").alias("line_no"), "track_date", "code", "name", side.alias("side"),
                        pattern.alias("pattern"), "win_rate", "return_pct", "lines", "head")
    same = ["file", "track_date", "code", "name", "side", "pattern", "win_rate", "return_pct", "lines", "head"]
    return out.groupBy(*same).agg(F.min("line_no").alias("line_no"))

"""Bar sources: merge, store, read, top up, coverage.

Several raw rows of one (code, date) are resolved by aggregates, never by a per-code window, so raw
skew does not reach a single task.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wickspark.functions.codes import classify_board
from wickspark.functions.pick import pick_row
from wickspark.model import BAR_SCHEMA, COVER_END_SLACK, COVER_START_SLACK, LOOK_BACK
from wickspark.operators.selection import judged, quality_check

KEY = ("code", "trade_date")
BEFORE_ALL = -(2 ** 63)  # load sequence of what is already stored

# Column names of the vendor layouts -> column names of a bar.
LAYOUTS = {
    "stock_cn": {"日期": "trade_date", "开盘": "open", "最高": "high", "最低": "low", "收盘": "close",
                 "成交量": "vol", "成交额": "amount", "涨跌幅": "pct_chg", "换手率": "turnover_rate"},
    "index_cn": {"date": "trade_date", "open": "open", "high": "high", "low": "low", "close": "close", "volume": "vol"},
    "index_us": {"date": "trade_date", "open": "open", "high": "high", "low": "low", "close": "close", "volume": "vol"},
    "index_global": {"date": "trade_date", "open": "open", "high": "high", "low": "low", "close": "close", "volume": "vol"},
    "stock_fraction": {"date": "trade_date", "open": "open", "high": "high", "low": "low", "close": "close",
                       "volume": "vol", "amount": "amount", "turnover": "turnover_rate"},
    "stock_lots": {"trade_date": "trade_date", "open": "open", "high": "high", "low": "low", "close": "close",
                   "vol": "vol", "amount": "amount", "pct_chg": "pct_chg"},
    "index_lots": {"trade_date": "trade_date", "open": "open", "high": "high", "low": "low", "close": "close",
                   "vol": "vol", "amount": "amount", "pct_chg": "pct_chg"},
    "stock_plain": {"date": "trade_date", "open": "open", "high": "high", "low": "low", "close": "close", "volume": "vol"},
}
SCALES = {("stock_fraction", "turnover_rate"): 100.0, ("stock_lots", "vol"): 100.0}


def as_date(col):
    """Dates come as DATE, `YYYYMMDD` or `YYYY-MM-DD`."""
    text = F.regexp_replace(F.substring(col.cast("string"), 1, 10), "-", "")
    return F.to_date(F.substring(text, 1, 8), "yyyyMMdd")


def normalize_vendor(df: DataFrame, layout: str) -> DataFrame:
    """Vendor columns -> bar schema; optional columns that are absent become null."""
    names = LAYOUTS[layout]
    code = "code" if "code" in df.columns else "ts_code"
    cols = {"code": F.col(code).cast("string")}
    for src, dst in names.items():
        if src in df.columns:
            value = as_date(F.col(src)) if dst == "trade_date" else F.nanvl(F.col(src).cast("double"), F.lit(None).cast("double"))
            scale = SCALES.get((layout, dst))
            cols[dst] = value * scale if scale else value
    return df.select(*[cols.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in BAR_SCHEMA.fields])


def merge_bar_sources(union: DataFrame, names: Sequence[str] | None = None) -> DataFrame:
    """Of rows with the same code and date keep the one with the lowest `priority`. names: all that occur in `source`, where known."""
    return pick_row(union, KEY, F.col("priority"), F.min_by, {"source": names} if names else None)


def union_sources(*sources: DataFrame) -> DataFrame:
    """Sources in order of preference -> one frame with `priority`."""
    out = None
    for i, s in enumerate(sources):
        s = s.withColumn("priority", F.lit(i))
        out = s if out is None else out.unionByName(s, allowMissingColumns=True)
    return out


def choose_source(union: DataFrame, end, names: Sequence[str] | None = None) -> DataFrame:
    """Per code the best source that reaches `end`, else the last partial one plus a newer local tail.

    union: bars with `priority` (1 = first asked) and `is_local`.  The per-source maximum is an
    aggregate; the chosen source is joined back on (code, priority). names: all that occur in `source`, where known."""
    end = F.lit(end).cast("date")
    reach = union.groupBy("code", "priority").agg(F.max("trade_date").alias("_max"), F.max("is_local").alias("_local"))
    # sources that reach the end: the first asked wins; otherwise the last one asked. Priorities are 32-bit integers, those that reach are below all others
    whole = F.col("_max") >= end
    rank = F.when(whole, F.col("priority").cast("long") - F.lit(1 << 33)).otherwise(-F.col("priority").cast("long"))
    best = reach.groupBy("code").agg(
        F.min_by("priority", rank).alias("_bp"), F.min_by("_max", rank).alias("_bmax"),
        F.max(F.when(F.col("_local"), F.col("_max"))).alias("_local_max"))
    j = union.join(best, "code")
    main = F.col("priority") == F.col("_bp")
    tail = F.col("is_local") & ~main & (F.col("_bmax") < end) & (F.col("_local_max") > F.col("_bmax"))
    kept = j.filter(main | tail).withColumn("_tail", tail.cast("int")).drop("_bp", "_bmax", "_local_max")
    # a tail row replaces its date; priorities are 32-bit integers
    return pick_row(kept, KEY, F.col("_tail") * F.lit(1 << 32) + F.col("priority"), F.max_by, {"source": names} if names else None).drop("_tail")


def top_up_latest(bars: DataFrame, quotes: DataFrame, end) -> DataFrame:
    """Codes that stop before `end` get their quote of that day; it wins over a stored row."""
    end = F.lit(end).cast("date")
    behind = bars.groupBy("code").agg(F.max("trade_date").alias("_m")).filter(F.col("_m") < end).select("code")
    fresh = quotes.filter(F.col("trade_date") == end).join(behind, "code", "left_semi").withColumn("_s", F.lit(1))
    both = bars.withColumn("_s", F.lit(0)).unionByName(fresh, allowMissingColumns=True)
    return pick_row(both, KEY, F.col("_s"), F.max_by).drop("_s")


# --- store --------------------------------------------------------------------------------------

def with_partitions(df: DataFrame) -> DataFrame:
    return df.withColumn("board", classify_board(F.col("code"))).withColumn("ym", F.date_format("trade_date", "yyyyMM"))


def read_bars(spark: SparkSession, path: str, start=None, end=None, codes: list[str] | None = None) -> DataFrame:
    """Only the months, row groups and columns asked for are read."""
    df = spark.read.parquet(path)
    df = df.drop("load_seq") if "load_seq" in df.columns else df
    if start is not None:
        df = df.filter(F.col("ym") >= F.date_format(F.lit(start).cast("date"), "yyyyMM")).filter(F.col("trade_date") >= F.lit(start).cast("date"))
    if end is not None:
        df = df.filter(F.col("ym") <= F.date_format(F.lit(end).cast("date"), "yyyyMM")).filter(F.col("trade_date") <= F.lit(end).cast("date"))
    if codes is not None:
        df = df.filter(F.col("code").isin(codes))
    return df


def load_rank(time, name):
    """Order of loads as one number: the time of the load (timestamp), then its name. It doesn't depend on what is loaded together."""
    digest = F.conv(F.substring(F.md5(name.cast("binary")), 1, 15), 16, 10).cast("decimal(20,0)")
    return (F.unix_micros(time).cast("decimal(18,0)") * F.lit(str(10 ** 19)).cast("decimal(20,0)") + digest).cast("decimal(38,0)")


def _board_verdict(rows: DataFrame) -> DataFrame:
    """judged() rows, where codes outside the boards are refused as such."""
    outside = classify_board(F.col("code")) == "excluded"
    return rows.withColumn("reason", F.when(outside, "excluded board").otherwise(F.col("reason")))


def rejected(new: DataFrame, load: str | None = None) -> DataFrame:
    """S3: what a save refuses: (load,) code, reason, rows. Codes outside the boards, and codes of a load that fail a rule of F10."""
    keys = ([load] if load else []) + ["code"]
    checked = quality_check(new, keys).withColumn("reason", F.when(classify_board(F.col("code")) == "excluded", "excluded board").otherwise(F.col("reason")))
    return checked.filter("reason IS NOT NULL").select(*keys, "reason", "rows")


def accepted(new: DataFrame, load: str | None = None) -> DataFrame:
    """S3: the rows that a save takes: codes within the boards that pass the quality gate of their load."""
    keys = [load, "code"] if load else ["code"]
    inside = new.filter(classify_board(F.col("code")) != "excluded")
    return inside.join(quality_check(inside, keys).filter("passed").select(*keys), keys, "left_semi")


def _newest(stored: DataFrame | None, taken: DataFrame, seq: str | None, keep_seq: bool) -> DataFrame:
    """New over stored, of several loads the last by `seq`."""
    wide = "decimal(38,0)"
    order = F.coalesce(F.col(seq).cast(wide), F.lit(BEFORE_ALL + 1).cast(wide)) if seq else F.lit(0).cast(wide)
    both = taken.withColumn("_s", order)
    if stored is not None:
        held = F.coalesce(F.col(seq), F.lit(BEFORE_ALL).cast(wide)) if keep_seq else F.lit(BEFORE_ALL).cast(wide)
        both = stored.withColumn("_s", held).unionByName(both, allowMissingColumns=True)
    out = pick_row(both, KEY, F.col("_s"), F.max_by).drop("_s")
    return out.drop(seq) if seq and not keep_seq and seq in out.columns else out


def upserted(stored: DataFrame | None, new: DataFrame, seq: str | None = None, load: str | None = None, keep_seq: bool = False) -> DataFrame:
    """S3 as a table function: quality gate per load and code, keep-last per date by `seq`, new over stored.

    load: column that names the load of a row; without it all rows are one load. seq: number that orders loads; a null is before all others. Where
    the stored rows carry `seq` themselves (keep_seq), the order is by it alone, whatever was stored first."""
    taken = accepted(new, load)
    return _newest(stored, taken.drop(load) if load else taken, seq, keep_seq)


class _Files:
    """Folders of the store's file system, whatever that is."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def exists(self, path: str) -> bool:
        return self._fs.exists(self._path(path))

    def folders(self, path: str) -> list[str]:
        return sorted(f.getPath().toString() for f in self._fs.listStatus(self._path(path)) if f.isDirectory()) if self.exists(path) else []

    def mark(self, path: str) -> None:
        self._fs.create(self._path(path), True).close()

    def remove(self, path: str) -> None:
        self._fs.delete(self._path(path), True)

    def put(self, source: str, target: str) -> None:
        """source in the place of target. A second call after a failure between the two steps finishes the work."""
        where = self._path(target)
        self._fs.delete(where, True)
        self._fs.mkdirs(where.getParent())
        if not self._fs.rename(self._path(source), where):
            raise OSError(f"{source} could not be moved to {target}")


def _beside(path: str, what: str) -> str:
    return f"{path.rstrip('/')}_{what}"


def _put_in_place(files: _Files, path: str, folder: str) -> None:
    """The finished months of a save, moved into the store. Months that were moved before are not there any more."""
    for board in files.folders(f"{folder}/months"):
        for month in files.folders(board):
            files.put(month, f"{path.rstrip('/')}/{month.split('/months/', 1)[1]}")
    files.remove(f"{folder}/_READY")


def recover(spark: SparkSession, path: str) -> None:
    """Finish a save that was cut off after its months were written; drop what one before that has left."""
    files = _Files(spark, path)
    for folder in files.folders(_beside(path, "staged")):
        if files.exists(f"{folder}/_READY"):
            _put_in_place(files, path, folder)
        files.remove(folder)


def upsert_bars(spark: SparkSession, path: str, new: DataFrame, seq: str | None = None, load: str | None = None) -> DataFrame:
    """S3: merge new bars into the store, rewriting only the months they touch. Returns what was refused, to be read before the next save.

    new is read once: one pass judges and gathers it per load, code and day, and is staged beside the store; accepted rows, what is refused, the touched
    months and the coverage of each load come from there. The merged months are written beside the store too, marked as ready and
    then moved in, once their zones (bars of each code and month, see `recent_bars`) are noted; a save that is cut off is
    finished by the next one (`recover`). A month is swapped by removing one folder and renaming another.

    Every stored row keeps the rank of its load, `load_seq`: the order of loads decides, not the order or number of saves. Without
    seq the rows are one load, of now. Rows are brought together by board and month with a rebalance hint: AQE joins small months into
    one task and splits a large one (a board may hold most of the market) by size; files are sorted by code. The list of touched
    months is bounded by the calendar and is the only thing the driver sees."""
    recover(spark, path)
    files, folder = _Files(spark, path), f"{_beside(path, 'staged')}/{uuid.uuid4().hex}"
    rank = F.col(seq).cast("decimal(38,0)") if seq else load_rank(F.current_timestamp(), F.lit(""))
    new = new.withColumn("trade_date", as_date(F.col("trade_date"))).withColumn("load_seq", rank)
    new = new.drop(seq) if seq and seq != "load_seq" else new
    keys = [load, "code"] if load else ["code"]
    verdicts = _board_verdict(judged(new, keys))
    verdicts.write.parquet(f"{folder}/load")
    staged = spark.read.schema(verdicts.schema).parquet(f"{folder}/load")
    refused = staged.filter("reason IS NOT NULL").groupBy(*keys, "reason").agg(F.max("all_rows").alias("rows"))
    good = staged.filter("reason IS NULL").select(*new.columns)
    months = [r[0] for r in good.select(F.date_format("trade_date", "yyyyMM").cast("int")).distinct().collect()]
    if not months:
        return refused
    stored = spark.read.parquet(path).filter(F.col("ym").isin(months)).drop("board", "ym") if files.exists(path) else None
    taken = good.drop(load) if load else good
    merged = with_partitions(_newest(stored, taken, "load_seq", True) if stored is not None or load else taken)
    (merged.hint("rebalance", "board", "ym").sortWithinPartitions("board", "ym", "code", "trade_date")
     .write.partitionBy("board", "ym").parquet(f"{folder}/months"))
    counted = merged.groupBy("code", F.col("ym").cast("int").alias("ym")).agg(F.count("*").alias("bars"), F.min("trade_date").alias("first_date"), F.max("trade_date").alias("last_date"))
    counted.withColumn("saved", F.lit(time.time_ns())).write.mode("append").parquet(_beside(path, "zones"))
    ranges = good.groupBy("code", "load_seq").agg(F.min("trade_date").alias("min_date"), F.max("trade_date").alias("max_date"), F.count("*").alias("row_count"))
    ranges.write.mode("append").parquet(_beside(path, "coverage"))
    files.mark(f"{folder}/_READY")
    _put_in_place(files, path, folder)
    return refused


def zones(spark: SparkSession, path: str) -> DataFrame:
    """Bars of each code and month of the store: code, ym, bars, first_date, last_date. Each save notes all codes of the months it
    rewrites; of a month the newest save counts."""
    noted = spark.read.parquet(_beside(path, "zones"))
    newest = noted.groupBy("ym").agg(F.max("saved").alias("saved"))
    return noted.join(newest, ["ym", "saved"], "left_semi").select("code", "ym", "bars", "first_date", "last_date")


def recent_bars(spark: SparkSession, path: str, days, look_back: int = LOOK_BACK, share: float = 0.95) -> DataFrame:
    """The bars that the signals of some days need, from a store: those of the days' months, and of each code that trades there as
    many months before as hold look_back bars, or all it has.

    The zones say how far back that is for each code. Most codes (share of them) need the same few months; these are read for all codes.
    What is older is read only for codes that lack bars since then, as after a suspension, and only as far back as they need. Both limits are
    scalar subqueries in the partition filters: no job runs while the plan is made, and months beyond them are never listed for reading."""
    asked = [F.lit(d).cast("date") for d in (days if isinstance(days, (list, tuple)) else [days])]
    number = lambda d: F.date_format(d, "yyyyMM").cast("int")
    low, high = (number(f(*asked) if len(asked) > 1 else asked[0]) for f in (F.least, F.greatest))
    seen = zones(spark, path).filter(F.col("ym") <= high)
    later = Window.partitionBy("code").orderBy(F.col("ym").desc())
    before = seen.filter(F.col("ym") < low).withColumn("_n", F.sum("bars").over(later))
    back = before.groupBy("code").agg(F.coalesce(F.max(F.when(F.col("_n") >= look_back, F.col("ym"))), F.min("ym")).alias("start"))
    active = seen.filter(F.col("ym") >= low).select("code").distinct()
    starts = active.join(back, "code", "left").select("code", F.coalesce("start", low).alias("start"))
    common = F.coalesce(F.percentile_approx("start", 1 - share), low)
    limits = starts.agg(common.alias("common"), F.coalesce(F.min("start"), low).alias("oldest"))
    bars = spark.read.parquet(path)
    bars = (bars.drop("load_seq") if "load_seq" in bars.columns else bars).withColumn("ym", F.col("ym").cast("int"))
    since = lambda: limits.select("common").scalar()
    late = bars.filter((F.col("ym") >= since()) & (F.col("ym") <= high))
    lacking = starts.filter(F.col("start") < since())
    early = bars.filter((F.col("ym") >= limits.select("oldest").scalar()) & (F.col("ym") < since()))
    early = early.join(lacking, "code").filter(F.col("ym") >= F.col("start")).select(*bars.columns)
    return late.unionByName(early)


# --- coverage and master ------------------------------------------------------------------------

def coverage(bars: DataFrame, stored: DataFrame | None = None) -> DataFrame:
    """Range and rows per code; with a stored table the range widens and the row count is replaced."""
    now = bars.groupBy("code").agg(F.min("trade_date").alias("min_date"), F.max("trade_date").alias("max_date"),
                                   F.count("*").alias("row_count"))
    if stored is None:
        return now
    old = stored.select("code", F.col("min_date").alias("_lo"), F.col("max_date").alias("_hi"), F.col("row_count").alias("_n"))
    return now.join(old, "code", "full").select(
        "code", F.least("min_date", "_lo").alias("min_date"), F.greatest("max_date", "_hi").alias("max_date"),
        F.coalesce("row_count", "_n").alias("row_count"))


def read_coverage(spark: SparkSession, path: str) -> DataFrame:
    """S12 of a store, as its saves kept it: the range of all loads and the rows of the newest load per code.

    Saves append a row per code and load; one saved twice, after a failure, changes nothing here."""
    kept = spark.read.parquet(_beside(path, "coverage"))
    return kept.groupBy("code").agg(F.min("min_date").alias("min_date"), F.max("max_date").alias("max_date"), F.max_by("row_count", "load_seq").alias("row_count"))


def check_coverage(cov: DataFrame, requests: DataFrame) -> DataFrame:
    """Is [start, end] covered, with ten days of slack at the start and five at the end?"""
    inside = ((F.col("min_date") <= F.date_add("start", COVER_START_SLACK))
              & (F.col("max_date") >= F.date_sub("end", COVER_END_SLACK))
              & (classify_board(F.col("code")) != "excluded"))
    return requests.join(cov, "code", "left").select("code", "start", "end", F.coalesce(inside, F.lit(False)).alias("covered"))


def missing_codes(requests: DataFrame, cov: DataFrame) -> DataFrame:
    """Requests to be refreshed."""
    ok = check_coverage(cov, requests).filter("covered").select("code", "start", "end")
    return requests.join(ok, ["code", "start", "end"], "left_anti")


def upsert_securities(stored: DataFrame, rows: DataFrame) -> DataFrame:
    """New values win where given; the board is inferred where absent."""
    cols = [c for c in stored.columns if c != "code"]
    old = stored.select("code", *[F.col(c).alias(f"_old_{c}") for c in cols])
    new = rows.select("code", *[F.col(c) if c in rows.columns else F.lit(None).cast(stored.schema[c].dataType).alias(c) for c in cols])
    j = new.join(old, "code", "full")
    out = [F.coalesce(F.col(c), F.col(f"_old_{c}"), classify_board(F.col("code"))).alias(c) if c == "board"
           else F.coalesce(F.col(c), F.col(f"_old_{c}")).alias(c) for c in cols]
    return j.select("code", *out)


def append_update_log(rows: DataFrame, path: str) -> None:
    """S16"""
    rows.write.mode("append").parquet(path)

"""Picking one row per key, and keeping an expensive column computed once."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_WHOLE = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
_TEXT = (T.StringType, T.BinaryType)
_WIDE = "decimal(38,0)"


def coded(df: DataFrame, keep: Iterable[str] = (), values: Mapping[str, Sequence[str]] | None = None) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """df with its texts as fixed-width codes, but for the columns to keep, and what turns the codes back.

    Aggregates hold fixed-width buffers in place; with a text among them Spark sorts all rows before it combines any. A column whose
    values are known (all of them, null aside) is coded by its place in the list. Others are coded by a 64-bit hash and turned back
    by a join with their distinct values, for which that column of df is read once more."""
    keep, values = set(keep), values or {}
    texts = [f.name for f in df.schema.fields if isinstance(f.dataType, _TEXT) and f.name not in keep]
    made = {c: F.when(F.col(c).isNotNull(), F.array_position(F.array(*map(F.lit, values[c])), F.col(c)).cast("int") if c in values else F.xxhash64(c)) for c in texts}

    def back(out: DataFrame) -> DataFrame:
        columns = out.columns
        for c in texts:
            if c in values:
                out = out.withColumn(c, F.when(F.col(c) > 0, F.element_at(F.array(*map(F.lit, values[c])), F.greatest(F.col(c), F.lit(1)))))
            else:
                known = df.select(F.xxhash64(c).alias("_code"), F.col(c).alias("_text")).filter(F.col("_text").isNotNull()).distinct()
                out = out.join(known, F.col(c) == F.col("_code"), "left").withColumn(c, F.col("_text")).drop("_code", "_text")
        return out.select(*columns)

    return (df.withColumns(made) if made else df), back


def pick_row(df: DataFrame, keys: Iterable[str], rank: Column, fn: Callable[[Column, Column], Column], values: Mapping[str, Sequence[str]] | None = None,
             unique: bool = False) -> DataFrame:
    """Keep the row with the highest (fn=F.max_by) or lowest (fn=F.min_by) rank of each key. A null rank comes last.

    Rows are combined before the shuffle, so a key with a third of all rows sends one row per map
    task.  Each column is picked by itself into a fixed-width buffer (texts are coded, see `coded`), so the
    aggregate is a hash aggregate.  Of several rows of equal whole-numbered rank a hash of the row decides, so the same
    rows give the same result however they are dealt; unique says that there are none.  All columns see the same comparisons."""
    keys = tuple(keys)
    rest = [c for c in df.columns if c not in keys]
    narrow, back = coded(df.withColumn("_rank", rank), (*keys, "_rank"), values)
    kind = narrow.schema["_rank"].dataType
    sign = -1 if fn is F.max_by else 1
    by = F.col("_rank")
    if isinstance(kind, T.DateType):
        by, kind = F.unix_date("_rank"), T.IntegerType()
    if isinstance(kind, _WHOLE) and not unique:
        tie = F.pmod(F.xxhash64(*rest), F.lit(10 ** 18)) if rest else F.lit(0)
        by = F.coalesce(by.cast("decimal(20,0)") * F.lit(10 ** 18).cast("decimal(19,0)") + tie.cast("decimal(18,0)"), F.lit(str(sign * 9 * 10 ** 37)).cast(_WIDE)).cast(_WIDE)
    elif isinstance(kind, _WHOLE):
        by = F.coalesce(by.cast("long"), F.lit(-(2 ** 63) if sign < 0 else 2 ** 63 - 1))
    elif isinstance(kind, T.DecimalType):
        by = F.coalesce(by, F.lit(str(sign * (10 ** (kind.precision - kind.scale) - 1))).cast(kind))
    elif isinstance(kind, (T.DoubleType, T.FloatType)):
        by = F.coalesce(by, F.lit(float("-inf") if sign < 0 else float("nan")))
    ranked = narrow.withColumn("_rank", by)
    return back(ranked.groupBy(*keys).agg(*[fn(F.col(c), F.col("_rank")).alias(c) for c in rest]))


def computed_once(df: DataFrame, **cols: Column) -> DataFrame:
    """Add columns whose expression is not repeated in later filters and joins.

    Catalyst pushes a filter on a computed column below it and writes the whole expression into
    every mention.  That is free for cheap expressions and ruinous for long ones mentioned often.
    Exploding a one-element array leaves the value a plain column.
    """
    made = F.explode_outer(F.array(F.struct(*[c.alias(n) for n, c in cols.items()]))).alias("_once")
    keep = [c for c in df.columns if c not in cols]
    return df.select("*", made).select(*keep, *[F.col(f"_once.{n}").alias(n) for n in cols])

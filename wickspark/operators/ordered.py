"""Running values over long ordered groups, in two levels.

A group without a natural bound (the lines of one log file) is cut into fixed ranges of its position.
Each range is scanned by itself, the totals of the ranges (one row per range) are scanned per group,
and the total of what came before is joined back.  No task ever holds a whole group.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RANGE = 65_536


def with_previous(df: DataFrame, group: str, pos: str, cols: dict[str, str], size: int = RANGE) -> DataFrame:
    """Add columns of the previous position (gap-free positions); the last row of a range is copied
    into the next range, so that ranges stay independent."""
    last = F.col(pos) % size == size - 1
    home = F.floor(F.col(pos) / size)
    spread = df.withColumn("_range", F.explode(F.when(last, F.array(home, home + 1)).otherwise(F.array(home))))
    over = f"OVER (PARTITION BY {group}, _range ORDER BY {pos})"
    out = spread.selectExpr("*", *[f"lag({src}) {over} AS {name}" for name, src in cols.items()])
    return out.filter(F.col("_range") == home).drop("_range")


def running_max(df: DataFrame, group: str, pos: str, cols: dict[str, str], size: int = RANGE) -> DataFrame:
    """Add the running maximum of each column up to and including the row."""
    ranged = df.withColumn("_range", F.floor(F.col(pos) / size))
    over = f"OVER (PARTITION BY {group}, _range ORDER BY {pos} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    local = ranged.selectExpr("*", *[f"max({src}) {over} AS _l_{name}" for name, src in cols.items()])
    totals = ranged.groupBy(group, "_range").agg(*[F.max(src).alias(f"_t_{name}") for name, src in cols.items()])
    before = f"OVER (PARTITION BY {group} ORDER BY _range ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    carry = totals.selectExpr(group, "_range", *[f"max(_t_{name}) {before} AS _b_{name}" for name in cols])
    out = local.join(carry, [group, "_range"])
    return out.select(*df.columns, *[F.greatest(f"_l_{name}", f"_b_{name}").alias(name) for name in cols])

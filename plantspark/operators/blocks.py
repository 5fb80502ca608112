"""Joins by nearness in time, without theta joins and without whole units in one task.

Both sides are cut into time blocks of fixed width. Only the looked-up side is repeated
into the blocks whose readings can see it, so one shuffle on (unit, block) is enough and
the rows that ask are never copied.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plantspark.schema import UNIT

BLOCK = "_block"


def _blocks(first: Column, last: Column, width: int) -> Column:
    return F.explode(F.sequence(F.floor(first / width).cast("long"), F.floor(last / width).cast("long")))


def _tagged(asking: DataFrame, seen: DataFrame, keys: Sequence[str], value: str, reach_back: int, reach_on: int, sparse: bool) -> DataFrame:
    """One frame of askers (payload kept) and copies of the seen rows, with block ids.

    ``reach_back`` / ``reach_on``: how far before / after an asker a seen row may lie.
    ``sparse``: few rows ask, so seen rows of blocks nobody asks from are left out first.
    """
    width = 4 * max(reach_back, reach_on, 1)
    ask = asking.select(
        *keys,
        F.unix_micros("time").alias("_us"),
        F.struct(*[F.col(c) for c in asking.columns]).alias("_row"),
        F.lit(None).cast("double").alias("_seen"),
        F.lit(None).cast("long").alias("_seen_us"),
    ).withColumn(BLOCK, F.floor(F.col("_us") / width))
    see = seen.where(F.col(value).isNotNull()).select(
        *keys,
        F.unix_micros("time").alias("_us"),
        F.lit(None).cast(ask.schema["_row"].dataType).alias("_row"),
        F.col(value).alias("_seen"),
        F.unix_micros("time").alias("_seen_us"),
    )
    see = see.select("*", _blocks(F.col("_us") - reach_on, F.col("_us") + reach_back, width).alias(BLOCK))
    if sparse:
        see = see.join(ask.select(*keys, BLOCK).distinct(), [*keys, BLOCK], "left_semi")
    return ask.unionByName(see)


def nearest_in_time(
    asking: DataFrame,
    seen: DataFrame,
    output: str,
    *,
    tolerance_micros: int,
    keys: Sequence[str] = UNIT,
    value: str = "value",
) -> DataFrame:
    """As-of join: value of the nearest ``seen`` row within the tolerance, else null.

    On equal distance the earlier row wins. Several seen rows at one time count as
    one with the smallest value (first) so that the answer is defined.
    """
    seen = seen.groupBy(*keys, "time").agg(F.min(value).alias(value))
    both = _tagged(asking, seen, keys, value, tolerance_micros, tolerance_micros, sparse=False)
    forward = Window.partitionBy(*keys, BLOCK).orderBy("_us").rangeBetween(Window.unboundedPreceding, 0)
    backward = Window.partitionBy(*keys, BLOCK).orderBy(F.col("_us").desc()).rangeBetween(Window.unboundedPreceding, 0)
    pair = F.when(F.col("_seen_us").isNotNull(), F.struct("_seen_us", "_seen"))
    found = (
        both.withColumn("_prev", F.last(pair, ignorenulls=True).over(forward))
        .withColumn("_next", F.last(pair, ignorenulls=True).over(backward))
        .where(F.col("_row").isNotNull())
    )
    back, ahead = F.col("_us") - F.col("_prev._seen_us"), F.col("_next._seen_us") - F.col("_us")
    use_prev = F.col("_next").isNull() | (back <= ahead)
    best = F.when(use_prev, F.col("_prev")).otherwise(F.col("_next"))
    gap = F.when(use_prev, back).otherwise(ahead)
    return found.select("_row.*", F.when(gap <= tolerance_micros, best["_seen"]).alias(output))


def around(
    asking: DataFrame,
    seen: DataFrame,
    prefix: str,
    *,
    reach_micros: int,
    keys: Sequence[str] = UNIT,
    value: str = "value",
) -> DataFrame:
    """Count, mean and sample std of the ``seen`` rows within ± reach of each asking row.

    Sums over the frame are differences of running sums inside the block: linear in
    the rows, whatever the reach.
    """
    both = _tagged(asking, seen, keys, value, reach_micros, reach_micros, sparse=True)
    part = Window.partitionBy(*keys, BLOCK)
    up_to_right = part.orderBy("_us").rangeBetween(Window.unboundedPreceding, reach_micros)
    up_to_left = part.orderBy("_us").rangeBetween(Window.unboundedPreceding, -reach_micros - 1)
    centred = both.withColumn("_centre", F.avg("_seen").over(part)).withColumn("_d", F.col("_seen") - F.col("_centre"))

    def span(c: Column) -> Column:
        return F.coalesce(F.sum(c).over(up_to_right), F.lit(0)) - F.coalesce(F.sum(c).over(up_to_left), F.lit(0))

    summed = centred.withColumns(
        {
            "_n": span(F.when(F.col("_d").isNotNull(), F.lit(1)).otherwise(0)),
            "_s": span(F.coalesce("_d", F.lit(0.0))),
            "_q": span(F.coalesce(F.col("_d") * F.col("_d"), F.lit(0.0))),
        }
    ).where(F.col("_row").isNotNull())
    n, s, q = F.col("_n"), F.col("_s"), F.col("_q")
    return summed.select(
        "_row.*",
        n.alias(f"{prefix}_n"),
        F.when(n > 0, F.col("_centre") + s / n).alias(f"{prefix}_mean"),
        F.when(n > 1, F.sqrt(F.greatest(F.lit(0.0), (q - s * s / n) / (n - 1)))).alias(f"{prefix}_std"),
    )

"""Rolling, offset and run operators over one series."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plantspark.operators import sequence
from plantspark.operators.dedup import latest_rows
from plantspark.schema import MICROS_PER_DAY, SERIES, UNIT, hours_between, ratio


def rolling_mean(df: DataFrame, rows: int = 5, min_rows: int = 2) -> DataFrame:
    """Mean of the last ``rows`` values, null below ``min_rows``."""

    def outputs(w):
        frame = w.rowsBetween(-(rows - 1), 0)
        return {"roll_mean": F.when(F.count("value").over(frame) >= min_rows, F.avg("value").over(frame))}

    return sequence.row_frame(df, outputs, before=rows - 1)


def rolling_days(df: DataFrame, width_days: float = 90, min_points: int = 20) -> DataFrame:
    """Mean and sample std over (t - width, t], null below ``min_points``."""
    rolled = sequence.trailing(df, int(width_days * MICROS_PER_DAY))
    enough = F.col("roll_n") >= min_points
    return rolled.withColumn("roll_mean", F.when(enough, F.col("roll_mean"))).withColumn("roll_std", F.when(enough, F.col("roll_std")))


def quantile_bands(df: DataFrame, low: float = 0.1, high: float = 0.9, rows: int = 20) -> DataFrame:
    """Rolling quantiles of the last ``rows`` values, null below max(3, rows / 2)."""
    enough = max(3, rows // 2)

    def outputs(w):
        frame = w.rowsBetween(-(rows - 1), 0)
        ok = F.count("value").over(frame) >= enough
        return {
            "band_low": F.when(ok, F.percentile("value", F.lit(low)).over(frame)),
            "band_high": F.when(ok, F.percentile("value", F.lit(high)).over(frame)),
        }

    return sequence.row_frame(df, outputs, before=rows - 1)


def rolling_hits(df: DataFrame, hit: Column, rows: int = 3, output: str = "hits") -> DataFrame:
    """How many of the last ``rows`` rows are hits."""
    marked = sequence.lay_out(df).withColumn("_hit", F.coalesce(hit, F.lit(False)).cast("int"))
    out = sequence.row_frame(marked, lambda w: {output: F.sum("_hit").over(w.rowsBetween(-(rows - 1), 0))}, before=rows - 1)
    return out.drop("_hit")


def lags(df: DataFrame, count: int = 3) -> DataFrame:
    """The previous ``count`` values and the first difference."""

    def outputs(w):
        out = {f"lag{i}": F.lag("value", i).over(w) for i in range(1, count + 1)}
        return out | {"diff": F.col("value") - F.lag("value", 1).over(w)}

    return sequence.row_frame(df, outputs, before=count)


def rolling_stats(df: DataFrame, rows: int = 5, min_rows: int = 1) -> DataFrame:
    """Rolling mean and std of the last ``rows`` values (``min_rows`` = rows: full frames)."""

    def outputs(w):
        frame = w.rowsBetween(-(rows - 1), 0)
        ok = F.count("value").over(frame) >= min_rows
        return {
            f"mean{rows}": F.when(ok, F.avg("value").over(frame)),
            f"std{rows}": F.when(ok, F.stddev_samp("value").over(frame)),
        }

    return sequence.row_frame(df, outputs, before=rows - 1)


def last_values(df: DataFrame, n: int = 5, distinct_of: int = 50, by: Sequence[str] = SERIES, tie: Sequence[str] = ("seq",)) -> DataFrame:
    """Mean of the last n values and distinct values among the last 50."""
    last = latest_rows(df.where(F.col("value").isNotNull()), max(n, distinct_of), by, tie)
    return last.groupBy(*by).agg(
        F.avg(F.when(F.col("_rn") <= n, F.col("value"))).alias("last_mean"),
        F.count_distinct(F.when(F.col("_rn") <= distinct_of, F.col("value"))).alias("last_distinct"),
    )


def longest_run(df: DataFrame, flag: Column, output: str = "longest_run") -> DataFrame:
    """Longest run of a true flag per series (0 when it never holds)."""
    runs = sequence.run_lengths(df, flag).groupBy(*SERIES).agg(F.max("run_length").alias("_m"))
    return df.select(*SERIES).distinct().join(runs, list(SERIES), "left").select(*SERIES, F.coalesce("_m", F.lit(0)).alias(output))


def same_value_runs(df: DataFrame, tolerance: float = 0.001) -> DataFrame:
    """Length of the longest stretch of nearly equal neighbours per series."""
    previous = sequence.row_frame(df.where(F.col("value").isNotNull()), lambda w: {"_prev": F.lag("value").over(w)}, before=1)
    breaks = F.col("_prev").isNull() | (F.abs(F.col("value") - F.col("_prev")) >= tolerance)
    runs = sequence.run_ids(previous, breaks).groupBy(*SERIES, "run_id").agg(F.count("*").alias("_n"))
    return runs.groupBy(*SERIES).agg(F.max("_n").alias("longest_same"))


def minimal_change_runs(df: DataFrame, threshold_percent: float = 0.5, min_steps: int = 5) -> DataFrame:
    """Stretches where every step changes the value by less than the threshold.

    A stretch of k quiet steps is kept when k - 1 >= ``min_steps``; its change is the
    mean of its own steps (aligned by row).
    """
    moved = with_change(df)
    quiet = F.coalesce(F.col("change_percent") < threshold_percent, F.lit(False))
    numbered = sequence.run_ids(moved, ~quiet)
    runs = numbered.where(quiet).groupBy(*SERIES, "run_id").agg(
        F.min("time").alias("period_start"), F.max("time").alias("period_end"), F.count("*").alias("steps"),
        F.avg("change_percent").alias("mean_change"),
    )
    kept = runs.where(F.col("steps") - 1 >= min_steps)
    return kept.withColumn("period_hours", hours_between(F.col("period_end"), F.col("period_start"))).drop("run_id")


def with_change(df: DataFrame) -> DataFrame:
    """Absolute change to the previous value in percent; null when that was zero."""
    previous = sequence.row_frame(df, lambda w: {"_prev": F.lag("value").over(w)}, before=1)
    change = F.abs(ratio(F.col("value") - F.col("_prev"), F.col("_prev"))) * 100
    return previous.withColumn("change_percent", change).drop("_prev")


def clustered_run(df: DataFrame, flag: Column) -> DataFrame:
    """Longest chain of neighbouring flagged rows, counted in adjacencies (rows - 1)."""
    runs = sequence.run_lengths(df, flag).groupBy(*SERIES).agg(F.max("run_length").alias("_m"), F.sum("run_length").alias("flagged"))
    return runs.select(*SERIES, "flagged", (F.col("_m") - 1).alias("adjacent"))


def cooldown_counts(df: DataFrame, hit: Column, cooldown: int = 5, keys: Sequence[str] = SERIES) -> DataFrame:
    """Events per series: a hit counts, then the next cooldown - 1 rows are skipped.

    The only state between two rows is the number of rows still blocked, so every time
    piece is folded once for each possible entry state, and the pieces are chained
    afterwards. A piece's hits are bounded by the piece, the chain by the piece count.
    """
    step = max(1, cooldown)
    placed = sequence.running(df, {"_pos": F.lit(1)}, keys=keys)
    spans = placed.groupBy(*keys, sequence.PIECE).agg(
        F.min("_pos").alias("_first"), F.max("_pos").alias("_last"),
        F.array_sort(F.collect_list(F.when(F.coalesce(hit, F.lit(False)), F.col("_pos")))).alias("_hits"),
    )

    def fold(blocked: Column) -> Column:
        start = F.struct((F.col("_first") + blocked).alias("free"), F.lit(0).cast("long").alias("count"))

        def advance(state: Column, position: Column) -> Column:
            counts = position >= state["free"]
            return F.struct(
                F.when(counts, position + F.lit(step).cast("long")).otherwise(state["free"]).alias("free"),
                F.when(counts, state["count"] + 1).otherwise(state["count"]).alias("count"),
            )

        return F.aggregate("_hits", start, advance)

    by_entry = F.transform(F.sequence(F.lit(0), F.lit(step)), lambda b: fold(b.cast("long")))
    tables = spans.select(
        *keys, sequence.PIECE,
        F.transform(by_entry, lambda s: F.struct(F.greatest(F.lit(0), s["free"] - F.col("_last") - 1).cast("int").alias("exit"), s["count"].alias("count"))).alias("_table"),
    )
    chain = tables.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(sequence.PIECE, "_table"))).alias("_pieces_"))
    begin = F.struct(F.lit(0).alias("blocked"), F.lit(0).cast("long").alias("count"))

    def link(state: Column, piece: Column) -> Column:
        row = F.element_at(piece["_table"], state["blocked"] + 1)
        return F.struct(row["exit"].alias("blocked"), (state["count"] + row["count"]).alias("count"))

    return chain.select(*keys, F.aggregate("_pieces_", begin, link)["count"].alias("events"))


def fill(df: DataFrame, column: str = "value", default: float | None = None) -> DataFrame:
    """Forward fill, backward fill, then a default."""
    both = sequence.carry(sequence.carry(df, column, "_f"), column, "_b", backward=True)
    return both.withColumn(column, F.coalesce("_f", "_b", *([F.lit(default)] if default is not None else []))).drop("_f", "_b")


def interpolate(df: DataFrame, column: str = "value", output: str = "interpolated") -> DataFrame:
    """Linear in time between known values; before the first and after the last, the nearest."""
    point = F.when(F.col(column).isNotNull(), F.struct(F.unix_micros("time").alias("t"), F.col(column).alias("v")))
    pointed = sequence.lay_out(df).withColumn("_point", point)
    sides = sequence.carry(sequence.carry(pointed, "_point", "_a"), "_point", "_b", backward=True)
    a, b, now = F.col("_a"), F.col("_b"), F.unix_micros("time")
    between = a["v"] + (b["v"] - a["v"]) * ratio(now - a["t"], b["t"] - a["t"])
    filled = F.coalesce(F.col(column), between, a["v"], b["v"])
    return sides.withColumn(output, filled).drop("_point", "_a", "_b")


def most_variable(df: DataFrame, top: int = 8, min_points: int = 100) -> DataFrame:
    """Per unit the tags with the largest coefficient of variation (a top-k report)."""
    stats = df.groupBy(*SERIES).agg(F.count("value").alias("n"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"))
    cv = stats.where(F.col("n") > min_points).withColumn("cv", F.coalesce(ratio(F.col("std"), F.col("mean")), F.lit(0.0)))
    rank = F.row_number().over(Window.partitionBy(*UNIT).orderBy(F.col("cv").desc(), "tag"))
    return cv.withColumn("rank", rank).where(F.col("rank") <= top)


def top_per_unit(table: DataFrame, column: str, k: int | None, by: Sequence[str] = UNIT, tie: Sequence[str] = ("tag",)) -> DataFrame:
    """O2 / O3: the k rows per unit with the largest ``column`` (a top-k report; None ranks all)."""
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(F.col(column).desc(), *tie))
    ranked = table.withColumn("rank", rank)
    return ranked if k is None else ranked.where(F.col("rank") <= k)


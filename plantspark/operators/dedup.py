"""Set operations (U1 to U9) and incremental merges.

Keep-first and keep-last are grouped aggregates (min_by / max_by over the load order):
copies of one key collapse in the map tasks before the shuffle, however many there are.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plantspark.schema import NATURAL_KEY

KEY = NATURAL_KEY


def _keep(df: DataFrame, keys: Sequence[str], order: Sequence[str], pick) -> DataFrame:
    rest = [c for c in df.columns if c not in keys]
    if len(order) == 1:
        # One aggregate per column keeps the buffers primitive, so Spark can hash.
        return df.groupBy(*keys).agg(*[pick(c, order[0]).alias(c) for c in rest])
    kept = df.groupBy(*keys).agg(pick(F.struct(*rest), F.struct(*[F.col(c) for c in order])).alias("_kept"))
    return kept.select(*keys, "_kept.*")


def any_copy(df: DataFrame, keys: Sequence[str] = KEY, seq: str = "seq") -> DataFrame:
    """One row per key; the smallest load number decides, so the result is defined."""
    return _keep(df, keys, (seq,), F.min_by)


def keep_first(df: DataFrame, keys: Sequence[str] = KEY, order: Sequence[str] = ("seq",)) -> DataFrame:
    """The first loaded row of every key."""
    return _keep(df, keys, order, F.min_by)


def keep_last(df: DataFrame, keys: Sequence[str] = KEY, order: Sequence[str] = ("seq",)) -> DataFrame:
    """The last loaded row of every key."""
    return _keep(df, keys, order, F.max_by)


def merge_new_wins(existing: DataFrame, new: DataFrame, keys: Sequence[str] = KEY, seq: str = "seq") -> DataFrame:
    """U4: existing and new rows; new ones replace existing ones, later ones earlier ones."""
    both = existing.withColumn("_new", F.lit(False)).unionByName(new.withColumn("_new", F.lit(True)))
    rest = [c for c in existing.columns if c not in keys]
    new_seq, old_seq = F.when(F.col("_new"), F.col(seq)), F.when(~F.col("_new"), F.col(seq))
    picks = [p for c in rest for p in (F.max_by(c, new_seq).alias(f"_n_{c}"), F.max_by(c, old_seq).alias(f"_o_{c}"))]
    merged = both.groupBy(*keys).agg(F.max("_new").alias("_replaced"), *picks)
    return merged.select(*keys, *[F.when(F.col("_replaced"), F.col(f"_n_{c}")).otherwise(F.col(f"_o_{c}")).alias(c) for c in rest])


def insert_or_ignore(existing: DataFrame, new: DataFrame, keys: Sequence[str] = KEY, seq: str = "seq") -> DataFrame:
    """Only new keys are added; the first new copy of a key wins."""
    fresh = new.join(existing.select(*keys).distinct(), list(keys), "left_anti")
    return existing.unionByName(keep_first(fresh, keys, (seq,)).select(*existing.columns))


def duplicate_count(df: DataFrame, keys: Sequence[str] = ("time", "tag"), by: Sequence[str] = ()) -> DataFrame:
    """Rows beyond the first of every key."""
    per_key = df.groupBy(*dict.fromkeys([*by, *keys])).agg(F.count("*").alias("_n"))
    return per_key.groupBy(*by).agg(F.sum("_n").alias("records"), F.sum(F.col("_n") - 1).alias("duplicates"))


def union_labelled(frames: dict[str, DataFrame], keys: Sequence[str]) -> DataFrame:
    """U8: union of detections, one row per key; the first listed detector names it."""
    parts = [
        frame.withColumn("anomaly_method", F.lit(name)).withColumn("_rank", F.lit(i)) for i, (name, frame) in enumerate(frames.items())
    ]
    both = parts[0]
    for part in parts[1:]:
        both = both.unionByName(part, allowMissingColumns=True)
    return _keep(both, keys, ("_rank",), F.min_by).drop("_rank")


def one_per_minute(incidents: DataFrame, method_order: Sequence[str], by: Sequence[str] = ("plant", "unit", "tag")) -> DataFrame:
    """One incident per series and minute: first method, then earliest time, wins."""
    rank = F.lit(len(method_order))
    for i, name in enumerate(method_order):
        rank = F.when(F.col("method") == name, i).otherwise(rank)
    minutes = incidents.withColumn("minute", F.date_trunc("minute", "time")).withColumn("_rank", rank)
    return _keep(minutes, (*by, "minute"), ("_rank", "time"), F.min_by).drop("_rank")


def new_rows(existing: DataFrame, incoming: DataFrame, by: Sequence[str] = ("plant", "unit", "tag")) -> DataFrame:
    """Incoming rows after their tag's latest stored time; unknown tags use the oldest latest."""
    latest = existing.groupBy(*by).agg(F.max("time").alias("_latest"))
    oldest = latest.select(F.min("_latest")).scalar()
    joined = incoming.join(latest, list(by), "left")
    floor = F.coalesce(F.col("_latest"), oldest)
    return joined.where(floor.isNull() | (F.col("time") > floor)).drop("_latest")


def merge_incremental(existing: DataFrame, incoming: DataFrame, keys: Sequence[str] = KEY, seq: str = "seq") -> DataFrame:
    """Only rows newer than each tag's end are merged, new wins."""
    return merge_new_wins(existing, new_rows(existing, incoming), keys, seq)


def latest_rows(df: DataFrame, n: int, by: Sequence[str], tie: Sequence[str] = ()) -> DataFrame:
    """The last n readings per key (Spark prunes to n per task before the shuffle)."""
    newest = Window.partitionBy(*by).orderBy(F.col("time").desc(), *[F.col(c).desc() for c in tie])
    return df.withColumn("_rn", F.row_number().over(newest)).where(F.col("_rn") <= n)

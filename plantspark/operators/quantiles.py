"""The distribution of each group from counts of its values, in few passes.

``percentile`` keeps every distinct value of a group in the memory of one task. Here

1. one pass takes the plain sums a caller wants and a sketch of the values;
2. one pass counts the values between the sketch's edges and keeps single values only in
   the narrow brackets around the wanted ranks. Counting is a grouped aggregate with
   partial sums, so one hot group spreads over all tasks. The counts are exact, so they
   tell whether a rank lies in its bracket; for hot groups, where a sketch is merged from
   many parts, an interval that holds a missed rank is opened and counted again;
3. ``deviations`` bounds the median absolute deviation from those same counts (each
   interval has a least and a greatest distance from the median) and finds it, together
   with any counts that depend on the statistics, in one more pass.

What is left of a group after a pass is small. For hot groups and for deviations it is written
to the checkpoint folder, so nothing that uses it reads the readings again.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plantspark.operators.sequence import has_hot_series
from plantspark.session import cut_lineage

# Rank error of the sketch is at most 1 / ACCURACY; the bracket leaves four times that.
ACCURACY = 10_000
MARGIN = 4.0 / ACCURACY
# Parts into which a round divides a bracket of a hot group.
GRID = 1_000
# Intervals whose counts bound the deviations from the median.
CELLS = 100
_INTERVALS = "array<struct<lo:double,hi:double>>"


def _numbers(values: Sequence[float]) -> Column:
    """A literal array; one text keeps the plan small."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<double>")


def _with_marks(data: DataFrame, marks: DataFrame, keys: Sequence[str]) -> DataFrame:
    # No hint: Spark broadcasts the marks when they are small and splits a skewed
    # group of the sort-merge join (AQE) when they are not.
    return data.join(marks, list(keys)) if keys else data.crossJoin(F.broadcast(marks))


# Edges in one block; more are searched in two steps, so a row meets about two blocks of them.
BLOCK = 10


def _below() -> tuple[Column, Column]:
    """The first edge of each block, to be named ``_heads``; and how many of the sorted ``_edges`` are below ``_v``: first among every BLOCK-th, then within a block."""
    last = F.floor((F.size("_edges") - 1) / BLOCK).cast("int")
    heads = F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda i: F.try_element_at("_edges", i * BLOCK + 1))
    inside = lambda b: F.size(F.filter(F.slice("_edges", (b - 1) * BLOCK + 1, F.lit(BLOCK)), lambda e: e < F.col("_v")))
    # An array of one names the block, so that it is searched for once.
    block = F.array(F.size(F.filter("_heads", lambda e: e < F.col("_v"))))
    return heads, F.transform(block, lambda b: F.when(b == 0, F.lit(0)).otherwise((b - 1) * BLOCK + inside(b)))[0]


def _slots(data: DataFrame, marks: DataFrame, keys: Sequence[str], sums: Mapping[str, Column] | None = None) -> DataFrame:
    """Counts of ``_v`` by interval between ``_edges``, and by value inside the ``_open`` intervals."""
    inside = F.exists("_open", lambda b: (F.col("_v") >= b["lo"]) & (F.col("_v") <= b["hi"]))
    heads, below = _below()
    marks = marks.withColumn("_edges", F.array_sort("_edges")).withColumn("_heads", heads)
    return (
        _with_marks(data, marks, keys)
        .groupBy(*keys, below.alias("_slot"), F.when(inside, F.col("_v")).alias("_single"))
        .agg(F.sum("_w").alias("_count"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"), *[c.alias(n) for n, c in (sums or {}).items()])
    )


def _ranked(slots: DataFrame, keys: Sequence[str], ranks: Mapping[str, Column]) -> DataFrame:
    """Per group one struct (value, lo, hi) per rank, counted from 0; value is null where only an interval is known."""
    order = Window.partitionBy(*keys).orderBy("_slot", F.col("_single").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    counted = slots.withColumn("_upto", F.sum("_count").over(order)).withColumn("_from", F.col("_upto") - F.col("_count"))
    n = Window.partitionBy(*keys)
    counted = counted.withColumn("n", F.sum("_count").over(n))

    def pick(rank: Column) -> Column:
        known = F.when((F.col("_lo") == F.col("_hi")) | (rank == F.col("_from")), F.col("_lo")).when(rank == F.col("_upto") - 1, F.col("_hi"))
        found = F.struct(known.alias("value"), F.col("_lo").alias("lo"), F.col("_hi").alias("hi"))
        return F.max(F.when((rank >= F.col("_from")) & (rank < F.col("_upto")), found))

    return counted.groupBy(*keys, "n").agg(*[pick(r).alias(name) for name, r in ranks.items()])


def _rank(p: float, side: int) -> Column:
    low = F.floor((F.col("n") - 1) * F.lit(p))
    return F.least(low + side, F.col("n") - 1)


def distribution(
    df: DataFrame, keys: Sequence[str], value: str | Column, quantiles: Mapping[str, float], sums: Mapping[str, Column] | None = None, *,
    cells: int = 0, hot: bool | None = None, weight: str | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(stats, slots). Stats: keys, ``n``, the sums and one exact quantile column per entry (linear interpolation).

    Groups without a value are left out. ``cells``: how many intervals the slots divide
    each group into beside the brackets. ``hot``: does a group exceed what one task should
    rank? None asks the data; callers that derived ``df`` from laid-out readings know it.
    ``weight``: a column of whole numbers, how often a row counts. A sketch cannot know it,
    so the first count is by interval only and a second one opens those that hold a rank.
    """
    keys, sums = list(keys), dict(sums or {})
    cells = max(cells, CELLS) if weight else cells
    probs = sorted(set(quantiles.values()))
    v = (F.col(value) if isinstance(value, str) else value).cast("double")
    times = F.col(weight).cast("long") if weight else F.lit(1).cast("long")
    data = df.select(*[F.col(k) for k in keys], v.alias("_v"), times.alias("_w")).where(F.col("_v").isNotNull() & (F.col("_w") > 0))
    edges = sorted({min(1.0, max(0.0, p + side * MARGIN)) for p in probs for side in (-1, 1)})
    # The counts between the cells are exact, so a coarse sketch may place them.
    parts = F.percentile_approx(v, _numbers([i / cells for i in range(1, cells)]), 10 * cells) if cells else F.array().cast("array<double>")
    marks = df.groupBy(*keys).agg(F.coalesce(F.sum(F.when(v.isNotNull(), times)), F.lit(0)).alias("n"), F.percentile_approx(v, _numbers(edges), ACCURACY).alias("_near"), *[c.alias(s) for s, c in sums.items()], *([parts.alias("_edges")] if cells else []))
    if not cells:
        marks = marks.withColumn("_edges", parts)

    def edge(p: float, side: int) -> Column:
        return F.element_at("_near", edges.index(min(1.0, max(0.0, p + side * MARGIN))) + 1)

    brackets = F.array(*[F.struct(edge(p, -1).alias("lo"), edge(p, 1).alias("hi")) for p in probs])
    marks = marks.where(F.col("n") > 0).withColumn("_open", (F.array() if weight else brackets).cast(_INTERVALS))
    sides = {f"_{i}{side}": _rank(p, side) for i, p in enumerate(probs) for side in (0, 1)}
    if weight or (has_hot_series(data, keys) if hot is None else hot):
        marks = cut_lineage(marks)
        found, slots = _searched(data, marks.select(*keys, "n", "_edges", "_open"), keys, probs, sides, narrow=not weight)
    else:
        # Small groups: one lazy plan. The bracket holds four times the sketch's error, so a miss means a broken sketch.
        marks = cut_lineage(marks) if cells else marks
        slots = _slots(data, _ended(marks.select(*keys, "_edges", "_open"), keys), keys)
        slots = cut_lineage(slots) if cells else slots
        found = _ranked(slots, keys, sides)
        exact = lambda name: F.coalesce(F.col(f"{name}.value"), F.raise_error(F.lit("quantile rank outside its bracket")).cast("double"))
        found = found.select(*keys, "n", *[F.struct(exact(name).alias("value")).alias(name) for name in sides])
    columns = []
    for name, p in quantiles.items():
        i = probs.index(p)
        fraction = (F.col("n") - 1) * F.lit(p) - F.floor((F.col("n") - 1) * F.lit(p))
        low, high = F.col(f"_{i}0.value"), F.col(f"_{i}1.value")
        columns.append((low + (high - low) * fraction).alias(name))
    exact = found.select(*keys, *columns)
    stats = marks.select(*keys, "n", *sums)
    return _with_marks(stats, exact, keys), slots


def _ended(around: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Marks whose edges include the ends of the open intervals."""
    ends = F.flatten(F.transform("_open", lambda b: F.array(b["lo"], b["hi"])))
    return around.select(*keys, F.array_distinct(F.concat("_edges", ends)).alias("_edges"), "_open")


def _searched(data: DataFrame, around: DataFrame, keys: list[str], probs: list[float], sides: Mapping[str, Column], narrow: bool) -> tuple[DataFrame, DataFrame]:
    """(ranks, slots) of large or weighted groups: narrowed first, and counted again wherever a rank is not in an open interval."""
    if narrow:
        around = cut_lineage(_narrowed(data, around, keys, probs))
    missed = F.lit(False)
    for name in sides:
        missed = missed | F.col(f"{name}.value").isNull()
    again = F.array_compact(F.array(*[F.when(F.col(f"{name}.value").isNull(), F.struct(F.col(f"{name}.lo").alias("lo"), F.col(f"{name}.hi").alias("hi"))) for name in sides]))
    found = slots = None
    while True:
        part = cut_lineage(_slots(data, _ended(around, keys), keys))
        placed = cut_lineage(_ranked(part, keys, sides))
        good = placed.where(~missed)
        found = good if found is None else found.unionByName(good)
        kept = part if not keys else part.join(good.select(*keys), keys, "left_semi")
        slots = kept if slots is None else slots.unionByName(kept)
        late = placed.where(missed).withColumn("_more", again).select(*keys, "_more")
        if late.isEmpty():
            return found, slots
        # The interval that holds the rank is known exactly: open it.
        around = cut_lineage(_with_marks(around, late, keys).withColumn("_open", F.concat("_open", F.col("_more").cast(_INTERVALS))).drop("_more"))


def deviations(df: DataFrame, keys: Sequence[str], value: str, stats: DataFrame, slots: DataFrame, *, centre: str = "median", far: float = 3.5, scale: float = 0.6745, counts: Mapping[str, Column] | None = None) -> DataFrame:
    """``stats`` with ``mad``, ``mad_outliers`` (scaled deviation above ``far``) and conditional counts over values and stats.

    ``slots`` bound the deviation at its rank: every value of an interval is at least as
    far from the centre as its nearer end, and at most as its farther one.
    """
    keys, counts = list(keys), dict(counts or {})
    middle = F.col(centre)
    near, away = F.abs(F.col("_lo") - middle), F.abs(F.col("_hi") - middle)
    covers = (F.col("_lo") <= middle) & (middle <= F.col("_hi"))
    spread = _with_marks(slots, stats.select(*keys, "n", centre), keys)
    # Counted by the nearer ends for the lower bound, by the farther ones for the upper.
    ends = spread.withColumns({"_near": F.when(covers, F.lit(0.0)).otherwise(F.least(near, away)), "_away": F.greatest(near, away)})
    upto = lambda end: F.sum("_count").over(Window.partitionBy(*keys).orderBy(end))
    ends = ends.withColumn("_by_near", upto("_near")).withColumn("_by_away", upto("_away"))
    low, high = F.min(F.when(F.col("_by_near") > _rank(0.5, 0), F.col("_near"))), F.min(F.when(F.col("_by_away") > _rank(0.5, 1), F.col("_away")))
    bounds = ends.groupBy(*keys).agg(low.alias("r_lo"), high.alias("r_hi"))
    factor = far / scale
    wide = 1e-9  # rounding of the factor
    intervals = F.array(
        F.struct(F.col("r_lo").alias("lo"), F.col("r_hi").alias("hi")),
        F.struct((F.col("r_lo") * (factor * (1 - wide))).alias("lo"), (F.col("r_hi") * (factor * (1 + wide))).alias("hi")),
    ).cast(_INTERVALS)
    marks = _with_marks(stats, bounds, keys).withColumn("_open", intervals).drop("r_lo", "r_hi")
    marks = marks.withColumn("_edges", F.flatten(F.transform("_open", lambda b: F.array(b["lo"], b["hi"]))))
    data = df.select(*[F.col(k) for k in keys], F.col(value).cast("double").alias("_x")).where(F.col("_x").isNotNull())
    joined = _with_marks(data, marks, keys).withColumn("_v", F.abs(F.col("_x") - F.col(centre))).withColumnRenamed("_x", value)
    inside = F.exists("_open", lambda b: (F.col("_v") >= b["lo"]) & (F.col("_v") <= b["hi"]))
    below = F.size(F.filter("_edges", lambda e: e < F.col("_v")))
    part = joined.groupBy(*keys, below.alias("_slot"), F.when(inside, F.col("_v")).alias("_single")).agg(
        F.count("*").alias("_count"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"), *[F.count_if(c).alias(n) for n, c in counts.items()]
    )
    part = cut_lineage(part)
    placed = _ranked(part, keys, {"_a": _rank(0.5, 0), "_b": _rank(0.5, 1)})
    fraction = (F.col("n") - 1) * 0.5 - F.floor((F.col("n") - 1) * 0.5)
    mad = placed.select(*keys, (F.col("_a.value") + (F.col("_b.value") - F.col("_a.value")) * fraction).alias("mad"))
    hit = (F.col("mad") > 0) & (scale * F.try_divide(F.col("_lo"), F.col("mad")) > far)
    totals = _with_marks(part, mad, keys).groupBy(*keys).agg(
        F.first("mad").alias("mad"), F.coalesce(F.sum(F.when(hit, F.col("_count"))), F.lit(0)).alias("mad_outliers"), *[F.sum(n).alias(n) for n in counts]
    )
    return _with_marks(stats, totals, keys)


def _narrowed(data: DataFrame, marks: DataFrame, keys: list[str], probs: list[float]) -> DataFrame:
    """For hot groups: a sketch of the rows inside each bracket narrows it.

    The rows below a bracket are counted exactly, so the wanted rank is known inside it.
    What is left to rank one by one is about 3e-6 of a group.
    """
    grid = _numbers([i / GRID for i in range(1, GRID)])
    aggregates = []
    for i in range(len(probs)):
        b = F.col("_open")[i]
        inside = (F.col("_v") >= b["lo"]) & (F.col("_v") <= b["hi"])
        aggregates += [
            F.count_if(F.col("_v") < b["lo"]).alias(f"_below{i}"), F.count_if(inside).alias(f"_in{i}"),
            F.percentile_approx(F.when(inside, F.col("_v")), grid, ACCURACY).alias(f"_q{i}"),
        ]
    counted = _with_marks(data, marks, keys).groupBy(*keys).agg(F.first("n").alias("n"), F.first("_edges").alias("_edges"), F.first("_open").alias("_open"), *aggregates)
    narrow = []
    for i, p in enumerate(probs):
        b, inside = F.col("_open")[i], F.col(f"_in{i}")
        rank = F.floor((F.col("n") - 1) * F.lit(p)) - F.col(f"_below{i}")
        first = F.floor(rank / F.greatest(inside, F.lit(1)) * GRID).cast("int") - 2
        last = F.ceil((rank + 2) / F.greatest(inside, F.lit(1)) * GRID).cast("int") + 2
        narrow.append(
            F.struct(
                F.when(first < 1, b["lo"]).otherwise(F.try_element_at(f"_q{i}", F.greatest(F.lit(1), F.least(first, F.lit(GRID - 1))))).alias("lo"),
                F.when(last > GRID - 1, b["hi"]).otherwise(F.try_element_at(f"_q{i}", F.greatest(F.lit(1), last))).alias("hi"),
            )
        )
    return counted.select(*keys, "n", "_edges", F.array(*narrow).cast(_INTERVALS).alias("_open"))


def grouped_quantiles(df: DataFrame, keys: Sequence[str], value: str, quantiles: Mapping[str, float], hot: bool | None = None, weight: str | None = None) -> DataFrame:
    """One row per group: keys, ``n`` and one exact quantile column per entry."""
    return distribution(df, keys, value, quantiles, hot=hot, weight=weight)[0]

"""Ordered work over one series without ever handing a whole series to one task.

A window over (plant, unit, tag) puts a tag in one task, and one tag may hold a third
of all readings. The helpers here cut such a hot series into time pieces of bounded
size and make the ordered operators exact across the cuts:

* ``lay_out``      adds the piece number; series below ``target_rows`` stay whole, and
                   when all do (one small counting job tells) the plan is plain windows;
* ``row_frame``    lag and rows-between frames, with the few edge rows of the
                   neighbouring pieces repeated at the cut;
* ``running``      running sums, with the totals of earlier pieces added;
* ``carry``        forward / backward fill, with the last known value carried over;
* ``trailing``     count / mean / std over (t - width, t] from running sums, so the cost
                   does not depend on the width of the frame;
* ``run_lengths``  runs of a flag (gaps and islands).

All of them partition by (series, piece), so a chain of them shares one exchange.
The table of cuts has at most N / target_rows entries: that is its size bound, and the
reason it is broadcast.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from plantspark.schema import SERIES

TARGET_ROWS = 4_000_000
# Cuts are searched in two steps, block heads first, so a row meets about 2 * 64 of them.
BLOCK_CUTS = 64
PIECE, PIECES, CUTS, MICROS = "_piece", "_pieces", "_cuts", "_us"
LAYOUT_COLUMNS = (PIECE, PIECES, CUTS, MICROS)


def cut_table(df: DataFrame, keys: Sequence[str] = SERIES, target_rows: int | None = None) -> DataFrame:
    """Cut times (microseconds) of every series with more than ``target_rows`` rows."""
    target_rows = target_rows or TARGET_ROWS
    stamped = df.select(*keys, F.unix_micros("time").alias(MICROS))
    hot = stamped.groupBy(*keys).agg(F.count("*").alias("_n")).where(F.col("_n") > target_rows)
    # As many marks as the largest series needs pieces, so every piece keeps its size.
    most = hot.agg(F.max("_n")).first()[0] or 0
    marks = max(64, -(-most // target_rows))
    # One text literal instead of a thousand number literals keeps the plan small.
    grid = F.split(F.lit(",".join(str(i / marks) for i in range(1, marks))), ",").cast("array<double>")
    pieces = F.ceil(F.col("_n") / target_rows).cast("int")
    cuts = (
        stamped.join(F.broadcast(hot), list(keys))
        .groupBy(*keys, "_n")
        .agg(F.percentile_approx(MICROS, grid, 20 * marks).alias("_q"))
        .select(
            *keys,
            F.array_distinct(
                F.transform(
                    F.sequence(F.lit(1), pieces - 1),
                    lambda i: F.element_at("_q", F.greatest(F.lit(1), F.floor(i * marks / pieces).cast("int"))),
                )
            ).alias("_c"),
        )
    )
    last = F.floor((F.size("_c") - 1) / BLOCK_CUTS).cast("int")
    blocks = F.transform(F.sequence(F.lit(0), last), lambda i: F.slice("_c", i * BLOCK_CUTS + 1, BLOCK_CUTS))
    heads = F.transform(blocks, lambda b: F.element_at(b, 1))
    return cuts.select(*keys, F.struct(F.size("_c").alias("size"), heads.alias("heads"), blocks.alias("blocks")).alias(CUTS))


CUTS_TYPE = "struct<size: int, heads: array<bigint>, blocks: array<array<bigint>>>"


def piece_of(at: Column) -> Column:
    """Number of cuts at or before ``at``; 0 for a series without cuts."""
    block = F.size(F.filter(F.col(f"{CUTS}.heads"), lambda c: c <= at))
    inside = F.size(F.filter(F.try_element_at(f"{CUTS}.blocks", block), lambda c: c <= at))
    return F.when(F.col(CUTS).isNull() | (block == 0), F.lit(0)).otherwise((block - 1) * BLOCK_CUTS + inside)


def has_hot_series(df: DataFrame, keys: Sequence[str] = SERIES, target_rows: int | None = None) -> bool:
    """Does any series exceed the rows one task should order? A small job, run while planning.

    Like the sampling job of a range partitioning it decides the shape of the plan: the
    row count comes first (no shuffle), counts per series only when that is not enough.
    """
    target_rows = target_rows or TARGET_ROWS
    if df.count() <= target_rows:
        return False
    return not df.groupBy(*keys).agg(F.count("*").alias("_n")).where(F.col("_n") > target_rows).isEmpty()


def lay_out(df: DataFrame, keys: Sequence[str] = SERIES, target_rows: int | None = None, hot: bool | None = None) -> DataFrame:
    """Add piece number, number of pieces, cuts and microseconds to every reading.

    ``hot``: what the caller already knows about hot series; None asks the data. Lay out
    the readings before joining to them, so that nothing derived is counted.
    """
    if PIECE in df.columns:
        return df
    stamped = df.withColumn(MICROS, F.unix_micros("time"))
    if not (has_hot_series(df, keys, target_rows) if hot is None else hot):
        whole = {"whole": True}
        return stamped.select(
            "*", F.lit(0).alias(PIECE), F.lit(1).alias(PIECES, metadata=whole), F.lit(None).cast(CUTS_TYPE).alias(CUTS)
        )
    cuts = cut_table(df, keys, target_rows)
    return (
        stamped.join(F.broadcast(cuts), list(keys), "left")
        .withColumn(PIECE, piece_of(F.col(MICROS)))
        .withColumn(PIECES, F.coalesce(F.col(f"{CUTS}.size"), F.lit(0)) + 1)
    )


def is_whole(laid: DataFrame) -> bool:
    """True when no series of the frame is cut, so no edge has to be looked after."""
    return bool(laid.schema[PIECES].metadata.get("whole"))


def strip(df: DataFrame) -> DataFrame:
    return df.drop(*LAYOUT_COLUMNS)


def piece_window(keys: Sequence[str] = SERIES, order: Sequence[str] = ("time",), reverse: bool = False) -> WindowSpec:
    cols = [F.col(c).desc() if reverse else F.col(c) for c in order]
    return Window.partitionBy(*keys, PIECE).orderBy(*cols)


def _edge_rows(laid: DataFrame, keys: Sequence[str], order: Sequence[str], count: int, following: bool) -> DataFrame:
    """The ``count`` rows next to each cut, labelled with the piece on its other side."""
    payload = F.struct(*[F.col(c) for c in laid.columns if c not in LAYOUT_COLUMNS], F.col(MICROS).alias(MICROS))
    nearest = Window.partitionBy(*keys, PIECE).orderBy(*[F.col(c) if following else F.col(c).desc() for c in order])
    key = F.struct(*[F.col(c) for c in order])
    kept = (
        laid.where(F.col(PIECES) > 1)
        .withColumn("_rank", F.row_number().over(nearest))
        .where(F.col("_rank") <= count)
        .groupBy(*keys, PIECE, PIECES)
        .agg(F.array_sort(F.collect_list(F.struct(key.alias("k"), payload.alias("row")))).alias("_rows"))
    )
    by_piece = Window.partitionBy(*keys).orderBy(PIECE)
    # Each piece has at least one row, so `count` neighbours always hold enough rows.
    if following:
        gathered = F.flatten(F.collect_list("_rows").over(by_piece.rowsBetween(1, count)))
        wanted = F.slice(gathered, F.lit(1), F.lit(count))
    else:
        gathered = F.flatten(F.collect_list("_rows").over(by_piece.rowsBetween(-count, -1)))
        wanted = F.slice(gathered, F.greatest(F.lit(1), F.size(gathered) - count + 1), F.lit(count))
    gathered_rows = kept.select(PIECE, PIECES, wanted.alias("_edges"))
    return gathered_rows.select(PIECE, PIECES, F.explode("_edges").alias("_edge")).select("_edge.row.*", PIECE, PIECES)


def row_frame(
    df: DataFrame,
    outputs: Callable[[WindowSpec], dict[str, Column]],
    *,
    before: int = 0,
    after: int = 0,
    keys: Sequence[str] = SERIES,
    order: Sequence[str] = ("time",),
    target_rows: int | None = None,
) -> DataFrame:
    """Evaluate window expressions that look at most ``before`` / ``after`` rows away."""
    laid = lay_out(df, keys, target_rows)
    if is_whole(laid):
        return laid.withColumns(outputs(piece_window(keys, order)))
    rows = laid.withColumn("_edge_row", F.lit(False))
    for count, following in ((before, False), (after, True)):
        if count:
            edge = _edge_rows(laid, keys, order, count, following)
            rows = rows.unionByName(edge.withColumn("_edge_row", F.lit(True)), allowMissingColumns=True)
    window = piece_window(keys, order)
    return rows.withColumns(outputs(window)).where(~F.col("_edge_row")).drop("_edge_row")


def _earlier_totals(laid: DataFrame, sums: dict[str, Column], keys: Sequence[str]) -> DataFrame:
    per_piece = laid.where(F.col(PIECES) > 1).groupBy(*keys, PIECE).agg(*[F.sum(c).alias(n) for n, c in sums.items()])
    before = Window.partitionBy(*keys).orderBy(PIECE).rowsBetween(Window.unboundedPreceding, -1)
    return per_piece.select(*keys, PIECE, *[F.coalesce(F.sum(n).over(before), F.lit(0)).alias(f"_before_{n}") for n in sums])


def running(
    df: DataFrame,
    sums: dict[str, Column],
    *,
    keys: Sequence[str] = SERIES,
    order: Sequence[str] = ("time",),
    target_rows: int | None = None,
) -> DataFrame:
    """Running sums in series order (``F.lit(1)`` gives the row position)."""
    laid = lay_out(df, keys, target_rows)
    window = piece_window(keys, order).rowsBetween(Window.unboundedPreceding, 0)
    local = laid.withColumns({n: F.sum(c).over(window) for n, c in sums.items()})
    if is_whole(laid):
        return local
    offsets = F.broadcast(_earlier_totals(laid, sums, keys))
    joined = local.join(offsets, [*keys, PIECE], "left")
    return joined.withColumns(
        {n: F.col(n) + F.coalesce(F.col(f"_before_{n}"), F.lit(0)) for n in sums}
    ).drop(*[f"_before_{n}" for n in sums])


def carry(
    df: DataFrame,
    column: str,
    output: str,
    *,
    backward: bool = False,
    include_current: bool = True,
    keys: Sequence[str] = SERIES,
    order: Sequence[str] = ("time",),
    target_rows: int | None = None,
) -> DataFrame:
    """Last known (``backward``: next known) non-null value of ``column`` in series order."""
    laid = lay_out(df, keys, target_rows)
    # A reversed order turns "next known" into "last known": frames that run to the
    # end of the partition are quadratic in Spark, frames from its start are linear.
    window = piece_window(keys, order, reverse=backward).rowsBetween(Window.unboundedPreceding, 0 if include_current else -1)
    local = laid.withColumn(output, F.last(column, ignorenulls=True).over(window))
    if is_whole(laid):
        return local
    pick = F.min_by if backward else F.max_by
    known = (
        laid.where((F.col(PIECES) > 1) & F.col(column).isNotNull())
        .groupBy(*keys, PIECE)
        .agg(pick(column, F.struct(*[F.col(c) for c in order])).alias("_known"))
    )
    pieces = laid.where(F.col(PIECES) > 1).select(*keys, PIECE).distinct()
    side = Window.partitionBy(*keys).orderBy(F.col(PIECE).desc() if backward else F.col(PIECE))
    earlier = (
        pieces.join(known, [*keys, PIECE], "left")
        .withColumn("_carried", F.last("_known", ignorenulls=True).over(side.rowsBetween(Window.unboundedPreceding, -1)))
        .drop("_known")
    )
    joined = local.join(F.broadcast(earlier), [*keys, PIECE], "left")
    return joined.withColumn(output, F.coalesce(output, "_carried")).drop("_carried")


def trailing(
    df: DataFrame,
    width_micros: int,
    *,
    value: str = "value",
    prefix: str = "roll",
    keys: Sequence[str] = SERIES,
    target_rows: int | None = None,
) -> DataFrame:
    """Count, mean and sample std over (t - width, t] as ``{prefix}_n/_mean/_std``.

    Both ends are running sums: sum up to t minus sum up to t - width. Values are
    centred first so that the difference keeps its precision.
    """
    laid = lay_out(df, keys, target_rows)
    if is_whole(laid):
        sums = _trailing_whole(laid, width_micros, value, keys)
    else:
        whole = _trailing_whole(laid.where(F.col(PIECES) == 1), width_micros, value, keys)
        sums = whole.unionByName(_trailing_cut(laid.where(F.col(PIECES) > 1), width_micros, value, keys))
    n, s, q = F.col("_n"), F.col("_s"), F.col("_q")
    variance = F.when(n > 1, F.greatest(F.lit(0.0), (q - s * s / n) / (n - 1)))
    return sums.withColumns(
        {
            f"{prefix}_n": n,
            f"{prefix}_mean": F.when(n > 0, F.col("_centre") + s / n),
            f"{prefix}_std": F.sqrt(variance),
        }
    ).drop("_n", "_s", "_q", "_centre")


def _powers(value: str) -> dict[str, Column]:
    d = F.col(value) - F.col("_centre")
    return {"_n": F.when(d.isNotNull(), F.lit(1)).otherwise(0), "_s": F.coalesce(d, F.lit(0.0)), "_q": F.coalesce(d * d, F.lit(0.0))}


def _trailing_whole(laid: DataFrame, width: int, value: str, keys: Sequence[str]) -> DataFrame:
    part = Window.partitionBy(*keys, PIECE)
    up_to_now = part.orderBy(MICROS).rangeBetween(Window.unboundedPreceding, 0)
    up_to_left = part.orderBy(MICROS).rangeBetween(Window.unboundedPreceding, -width)
    centred = laid.withColumn("_centre", F.avg(value).over(part))
    return centred.withColumns(
        {n: F.sum(c).over(up_to_now) - F.coalesce(F.sum(c).over(up_to_left), F.lit(0)) for n, c in _powers(value).items()}
    )


def _trailing_cut(laid: DataFrame, width: int, value: str, keys: Sequence[str]) -> DataFrame:
    """The same sums when (t - width) falls into another piece than t.

    The sum up to t is read at the reading itself. The sum up to t - width is looked up
    in the piece that holds this time: look-ups and readings are ordered together there
    and a look-up reads the running sum. Times before the first reading need no look-up.
    """
    ends = laid.groupBy(*keys).agg(F.avg(value).alias("_centre"), F.min(MICROS).alias("_start"))
    rows = laid.join(F.broadcast(ends), list(keys))
    sums = _powers(value)
    names = list(sums)
    offsets = F.broadcast(_earlier_totals(rows, sums, keys))

    def up_to(at: str) -> WindowSpec:
        return Window.partitionBy(*keys, PIECE).orderBy(at).rangeBetween(Window.unboundedPreceding, 0)

    def with_offsets(df: DataFrame) -> DataFrame:
        joined = df.join(offsets, [*keys, PIECE], "left")
        total = {n: F.col(n) + F.coalesce(F.col(f"_before_{n}"), F.lit(0)) for n in names}
        return joined.withColumns(total).drop(*[f"_before_{n}" for n in names])

    now = with_offsets(rows.withColumns({n: F.sum(c).over(up_to(MICROS)) for n, c in sums.items()}))
    left = F.col(MICROS) - width
    nothing = [F.lit(0).cast("int" if n == "_n" else "double").alias(n) for n in names]
    look_ups = rows.where(left >= F.col("_start")).select(*keys, piece_of(left).alias(PIECE), left.alias("_at"), *nothing, F.col(MICROS).alias("_for"))
    readings = rows.select(*keys, PIECE, F.col(MICROS).alias("_at"), *[c.alias(n) for n, c in sums.items()], F.lit(None).cast("long").alias("_for"))
    ordered = readings.unionByName(look_ups).withColumns({n: F.sum(n).over(up_to("_at")) for n in names})
    found = with_offsets(ordered.where(F.col("_for").isNotNull())).groupBy(*keys, F.col("_for").alias(MICROS)).agg(
        *[F.first(n).alias(f"_left{n}") for n in names]
    )
    joined = now.join(found, [*keys, MICROS], "left")
    gone = {n: F.col(n) - F.coalesce(F.col(f"_left{n}"), F.lit(0)) for n in names}
    return joined.withColumns(gone).drop("_start", *[f"_left{n}" for n in names])


def run_ids(df: DataFrame, breaks: Column, output: str = "run_id", *, keys: Sequence[str] = SERIES, order: Sequence[str] = ("time",)) -> DataFrame:
    """Number the runs: a row where ``breaks`` holds starts the next run."""
    return running(df, {output: F.when(breaks, F.lit(1)).otherwise(0)}, keys=keys, order=order)


def run_lengths(df: DataFrame, flag: Column, *, keys: Sequence[str] = SERIES, order: Sequence[str] = ("time",)) -> DataFrame:
    """One row per run of consecutive true flags: series, run id, start, end, length.

    A run is counted by a grouped aggregate (partial sums per task), so one endless run
    is no hot spot.
    """
    numbered = run_ids(df, ~F.coalesce(flag, F.lit(False)), keys=keys, order=order)
    return (
        numbered.where(F.coalesce(flag, F.lit(False)))
        .groupBy(*keys, "run_id")
        .agg(F.min("time").alias("run_start"), F.max("time").alias("run_end"), F.count("*").alias("run_length"))
    )


def run_summary(
    df: DataFrame,
    flag: Column,
    *,
    sums: dict[str, Column] | None = None,
    latest: dict[str, Column] | None = None,
    keys: Sequence[str] = SERIES,
) -> DataFrame:
    """One row per series: ``rows``, ``longest_run`` of the flag, sums, newest values.

    Runs are counted inside each piece (no running total over the series is needed) and
    chained over the pieces: a piece is summed up by its rows, its longest run and the
    runs touching its two ends.
    """
    sums, latest = sums or {}, latest or {}
    on = F.coalesce(flag, F.lit(False))
    window = Window.partitionBy(*keys, PIECE).orderBy(MICROS).rowsBetween(Window.unboundedPreceding, 0)
    marked = lay_out(df, keys).withColumns({"_on": on, "_off": F.sum(F.when(on, 0).otherwise(1)).over(window)})
    runs = marked.groupBy(*keys, PIECE, F.when(F.col("_on"), F.col("_off")).alias("_run")).agg(
        F.count("*").alias("_c"), F.max("_off").alias("_offs"),
        *[F.sum(c).alias(n) for n, c in sums.items()],
        F.max(MICROS).alias("_at"), *[F.max_by(c, F.col(MICROS)).alias(n) for n, c in latest.items()],
    )
    pieces = runs.groupBy(*keys, PIECE).agg(
        F.sum("_c").alias("_rows"), F.max("_offs").alias("_offs"),
        F.max(F.when(F.col("_run").isNotNull(), F.col("_c"))).alias("_best"),
        F.max(F.when(F.col("_run") == 0, F.col("_c"))).alias("_head"),
        F.max(F.when(F.col("_run").isNotNull(), F.struct("_run", "_c"))).alias("_last"),
        *[F.sum(n).alias(n) for n in sums],
        F.max("_at").alias("_at"), *[F.max_by(n, "_at").alias(n) for n in latest],
    )
    tail = F.when(F.col("_last._run") == F.col("_offs"), F.col("_last._c"))
    zero = F.lit(0).cast("long")
    link = F.struct(
        PIECE, F.col("_rows").alias("rows"), F.coalesce("_best", zero).alias("best"), F.coalesce("_head", zero).alias("head"), F.coalesce(tail, zero).alias("tail")
    )
    chained = pieces.groupBy(*keys).agg(
        F.array_sort(F.collect_list(link)).alias("_links"), F.sum("_rows").alias("rows"),
        *[F.sum(n).alias(n) for n in sums], *[F.max_by(n, "_at").alias(n) for n in latest],
    )

    def join(state: Column, piece: Column) -> Column:
        whole = piece["head"] == piece["rows"]
        open_run = state["open"] + piece["head"]
        return F.struct(
            F.when(whole, open_run).otherwise(piece["tail"]).alias("open"),
            F.greatest(state["best"], piece["best"], open_run).alias("best"),
        )

    start = F.struct(zero.alias("open"), zero.alias("best"))
    return chained.select(
        *keys, "rows", F.aggregate("_links", start, join)["best"].alias("longest_run"), *sums, *latest
    )

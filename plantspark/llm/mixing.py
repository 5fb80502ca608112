"""Mixing sources to target weights by Pareto order sampling; DataFrame functions only.

``targets`` shares a number of words among the sources by weight. No target exceeds ``most``
times the size of its source: what is over is shared again by weight until none is above
(a level is raised over a table with one row per source, a few sums a round).

``mix`` then gives every document the same expected number of copies as its source's target
has words for each of its words, or one in proportion to ``weight_col`` within the source.
The whole part of that number is certain. The rest is an inclusion probability p, and the
documents of a source are ranked by Pareto order sampling (Rosen, 1997): random odds
u / (1 - u) divided by inclusion odds p / (1 - p), the smallest first. The sample has a fixed
size, counted in words: documents are taken in this order until the target is reached.

Documents with more than a thousandth of their source's words, fewer than a thousand, come
first: in Pareto order each is taken if it still fits. The others fill what is left exactly
in Pareto order, so a large source ends within a thousandth of its size. In a source of
large documents only, the shortfall is less than the shortest document left out, or that one
is taken where this comes nearer.

Skew: no task ranks a source. Words are counted by source and interval of the rank (256 a
source), the interval where the target falls is found in the running sums, cut into 256 once
more, and only the documents of the small interval found there are ordered. Reruns agree: u is a hash of the id, the source and the text.

Edge cases: a null text has size 0 and takes nothing; a null source is a source of its own
and the last; a null id is an id like any other; rows equal in id, source and text are
interchangeable, so any of them may be the ones taken; an empty table gives no rows; columns
of the input named like an output are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, text_or_empty, written

WEIGHTS = (1, 2, 3)
#: Copies of one document at most.
MOST = 3
#: Intervals of the rank that are counted per source, twice.
INTERVALS = 256
#: A document with more than this part of its source's words is fitted in one by one.
LARGE = 1000


def words(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def ranked(sizes: DataFrame, key: str) -> DataFrame:
    """Add ``rank`` from 0 by ``key``, null last: ranges of keys are numbered apart, then shifted."""
    parts = int(sizes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = F.col(key).asc_nulls_last()
    dealt = cut(sizes.repartitionByRange(parts, order).withColumn("__llm_part", F.spark_partition_id()))
    # One row per partition, so this window is small whatever the number of keys.
    before = Window.orderBy("__llm_part").rowsBetween(Window.unboundedPreceding, -1)
    counts = dealt.groupBy("__llm_part").agg(F.count(F.lit(1)).alias("n"))
    shift = counts.select("__llm_part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("shift"))
    own = F.row_number().over(Window.partitionBy("__llm_part").orderBy(order)) - 1
    return dealt.withColumn("own", own).join(shift, "__llm_part").withColumn("rank", F.col("own") + F.col("shift")).drop("__llm_part", "own", "shift")


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: float = MOST, share: float = 1.0) -> DataFrame:
    """Add ``target`` to one row per ``source`` with its ``source_size``: ``share`` of all sizes by the repeating weights."""
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.col("rank") % len(weights) + 1).cast("int"))
    table = written(ranked(sizes, "source").withColumn("weight", weight).withColumn("most", most * F.col("source_size").cast("double")))
    total = share * float(table.agg(F.sum("source_size")).first()[0] or 0)
    level, full = 0.0, -1
    while True:
        over = F.col("most") <= level * F.col("weight")
        taken, left, n = table.agg(F.sum(F.when(over, F.col("most"))), F.sum(F.when(~over, F.col("weight"))), F.count(F.when(over, 1))).first()
        if not left or n == full:  # every source is at its most, or no further one is
            break
        level, full = (total - (taken or 0.0)) / left, n
    return table.select("source", "source_size", F.least(F.col("most"), level * F.col("weight")).alias("target"))


def _uniform(h: Column) -> Column:
    """Strictly between 0 and 1, from the upper 53 bits of a hash."""
    return (F.shiftrightunsigned(h, 11).cast("double") + 0.5) * 2.0**-53


def _copies(rows: DataFrame, of: DataFrame, most: float) -> DataFrame:
    """Add the expected number of copies, at most ``most``, in proportion to ``weight``; Newton steps on one level per source."""
    state = of.withColumn("level", F.lit(0.0)).withColumn("open", F.lit(True))
    while True:
        state = written(state)
        if state.where("open").isEmpty():
            break
        over = F.col("level") * F.col("weight") >= most
        joined = rows.join(state.where("open"), rows["source"].eqNullSafe(state["source"])).select(rows["source"], "size", "weight", "level", "target", over.alias("over"))
        sums = joined.groupBy("source").agg(
            F.coalesce(F.sum(F.when(F.col("over"), F.col("size"))), F.lit(0)).alias("full"),
            F.sum(F.when(~F.col("over"), F.col("size") * F.col("weight"))).alias("rest"),
        )
        new = F.when(F.coalesce("rest", F.lit(0.0)) > 0, F.greatest("level", (F.col("target") - most * F.col("full")) / F.col("rest"))).otherwise(F.col("level"))
        sums = sums.withColumnRenamed("source", "of")
        state = state.join(sums, F.col("source").eqNullSafe(F.col("of")), "left").withColumn("new", F.when(F.col("full").isNotNull(), new).otherwise(F.col("level")))
        state = state.select("source", "source_size", "target", F.col("new").alias("level"), (F.col("open") & (F.col("new") > F.col("level") * (1 + 1e-12))).alias("open"))
    return rows.join(state.withColumnRenamed("source", "of").drop("open"), rows["source"].eqNullSafe(F.col("of"))).withColumn("expected", F.least(F.lit(float(most)), F.col("level") * F.col("weight")))


def _fitted(large: DataFrame) -> DataFrame:
    """Walk the large documents of each source, fewer than LARGE: take each that still fits."""
    one = F.struct("place", "hash", "doc_id", "size", "whole")
    lists = large.groupBy("source").agg(F.array_sort(F.collect_list(one)).alias("docs"), F.first("large_quota").alias("quota"), F.first("small_words").alias("small_words"))
    start = F.struct(F.col("quota").alias("room"), F.expr("cast(array() as array<boolean>)").alias("flags"))

    def step(at: Column, doc: Column) -> Column:
        fits = doc["size"] <= at["room"]
        return F.struct((at["room"] - F.when(fits, doc["size"]).otherwise(F.lit(0))).alias("room"), F.concat(at["flags"], F.array(fits)).alias("flags"))

    walked = lists.withColumn("walked", F.aggregate("docs", start, step))
    pairs = walked.select("source", "small_words", "walked.room", F.arrays_zip(F.col("docs"), F.col("walked.flags").alias("flag")).alias("docs"))
    # With no small documents to fill the room: the shortest one left out, if it comes nearer.
    out = F.array_sort(F.transform(F.filter("docs", lambda d: ~d["flag"]), lambda d: F.struct(d["docs"]["size"].alias("size"), d["docs"]["place"].alias("place"), d["docs"]["hash"].alias("hash"), d["docs"]["doc_id"].alias("doc_id"))))
    nearest = F.when((F.col("small_words") == 0) & (F.size(out) > 0) & (2 * F.col("room") > F.get(out, F.lit(0))["size"]), F.get(out, F.lit(0)))
    rows = pairs.withColumn("extra", nearest).select("source", "extra", F.posexplode("docs").alias("at", "d"))
    doc = F.col("d.docs")
    last = F.struct(doc["size"].alias("size"), doc["place"].alias("place"), doc["hash"].alias("hash"), doc["doc_id"].alias("doc_id")).eqNullSafe(F.col("extra")) & ~F.col("d.flag")
    # Equal rows may meet the extra one together: the first of them only.
    first = F.min(F.when(last, F.col("at"))).over(Window.partitionBy("source"))
    taken = F.col("d.flag") | F.coalesce(F.col("at") == first, F.lit(False))
    return rows.select("source", doc["doc_id"].alias("doc_id"), doc["hash"].alias("hash"), doc["size"].alias("size"), doc["whole"].alias("whole"), taken.cast("long").alias("more"))


def _edge(rows: DataFrame, interval: str, start: DataFrame) -> DataFrame:
    """Per source the interval in which ``quota`` is passed: of, edge, before (words ahead of it), quota. ``start``: of, before, quota."""
    counted = rows.groupBy("source", interval).agg(F.sum("size").alias("n"))
    running = counted.withColumn("through", F.sum("n").over(Window.partitionBy("source").orderBy(interval)))
    passed = running.join(start, F.col("source").eqNullSafe(F.col("of"))).where(F.col("before") + F.col("through") > F.col("quota"))
    first = passed.groupBy("of").agg(F.min(F.struct(F.col(interval).alias("edge"), (F.col("before") + F.col("through") - F.col("n")).alias("before"), "quota")).alias("at"))
    return first.select("of", "at.edge", "at.before", "at.quota")


def mix(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weight_col: str | None = None,
    weights: tuple[float, ...] = WEIGHTS, most: int = MOST, share: float = 1.0, seed: int = 13,
) -> DataFrame:
    """One row per row of ``docs``: doc_id, source, hash, size, source_size, target, copies, taken (words).

    ``weight_col`` (null or negative: 0) prefers documents of a source over others.
    """
    text = text_or_empty(text_col)
    source, key = F.col(f"`{source_col}`").cast("string"), F.col(f"`{id_col}`")
    weight = F.greatest(F.coalesce(F.col(f"`{weight_col}`").cast("double"), F.lit(0.0)), F.lit(0.0)) if weight_col else F.lit(1.0)
    rows = written(docs.select(key.alias("doc_id"), source.alias("source"), words(text).alias("size"), F.xxhash64(F.lit(seed), key, source, text).alias("hash"), weight.alias("weight")))
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    of = written(targets(sizes, weights, most, share))
    if weight_col:
        drawn = _copies(rows, of, most)
    else:
        # One level for the whole source, known from its two numbers.
        ratio = F.when(F.col("source_size") > 0, F.least(F.lit(float(most)), F.col("target") / F.col("source_size"))).otherwise(F.lit(0.0))
        drawn = rows.join(of.withColumnRenamed("source", "of"), F.col("source").eqNullSafe(F.col("of"))).withColumn("expected", ratio)
    whole = F.floor(F.col("expected") + 1e-9)
    p = F.greatest(F.col("expected") - F.col("whole"), F.lit(0.0))
    odds = _uniform(F.col("hash")) / (1 - _uniform(F.col("hash"))) * (1 - F.col("p")) / F.col("p")
    drawn = drawn.withColumn("whole", whole).withColumn("p", F.when(F.col("size") > 0, p).otherwise(F.lit(0.0))).withColumn("place", F.when(F.col("p") > 0, odds / (1 + odds)))
    drawn = drawn.withColumn("large", F.col("size") * LARGE > F.col("source_size")).select("doc_id", "source", "hash", "size", "whole", "p", "place", "large")
    open_, big = F.col("place").isNotNull(), F.col("large")
    plan = drawn.groupBy("source").agg(
        F.sum(F.col("size") * F.col("whole")).alias("certain"),
        F.coalesce(F.sum(F.when(open_ & ~big, F.col("size"))), F.lit(0)).alias("small_words"),
        F.coalesce(F.sum(F.when(open_ & ~big, F.col("size") * F.col("p"))), F.lit(0.0)).alias("small_expected"),
    )
    plan = plan.withColumnRenamed("source", "of").join(of, F.col("of").eqNullSafe(F.col("source")))
    room = F.greatest(F.round("target").cast("long") - F.col("certain"), F.lit(0))
    large_quota = F.greatest(F.col("room") - F.round("small_expected").cast("long"), F.lit(0))
    plan = written(plan.withColumn("room", room).select("of", "room", "small_words", large_quota.alias("large_quota")))

    # Large documents first, one by one; what they leave is the quota of the others.
    same = F.col("source").eqNullSafe(F.col("of"))
    large = written(_fitted(drawn.where(open_ & big).join(plan.drop("room"), same).drop("of")))
    used = large.groupBy("source").agg(F.sum(F.col("size") * F.col("more")).alias("used")).withColumnRenamed("source", "by")
    quota = plan.join(used, F.col("of").eqNullSafe(F.col("by")), "left").select("of", (F.col("room") - F.coalesce("used", F.lit(0))).alias("quota"))

    # The interval of the rank where the quota is used up, and the one within it; all before are in.
    scaled = F.col("place") * INTERVALS
    fine = F.least(F.floor((scaled - F.floor(scaled)) * INTERVALS), F.lit(INTERVALS - 1))
    small = drawn.where(open_ & ~big).withColumn("coarse", F.least(F.floor(scaled), F.lit(INTERVALS - 1))).withColumn("fine", fine)
    coarse = _edge(small, "coarse", quota.withColumn("before", F.lit(0).cast("long")))
    within = small.join(coarse, same).where("coarse = edge").select("source", "fine", "size")
    exact = _edge(within, "fine", coarse.drop("edge")).withColumnsRenamed({"edge": "fine_edge"})
    edge = written(exact.join(coarse.select(F.col("of").alias("by"), F.col("edge").alias("coarse_edge")), F.col("of").eqNullSafe(F.col("by"))).drop("by"))
    placed = small.join(edge, same, "left").drop("of").withColumn("at", F.struct("coarse", "fine")).withColumn("edge", F.struct(F.col("coarse_edge").alias("coarse"), F.col("fine_edge").alias("fine")))
    inner = F.coalesce(F.col("at") == F.col("edge"), F.lit(False))
    beside = placed.where(~inner).select("source", "doc_id", "hash", "size", "whole", (F.col("quota").isNull() | (F.col("at") < F.col("edge"))).cast("long").alias("more"))
    ordered = Window.partitionBy("source").orderBy("place", "hash", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    inside = placed.where(inner).withColumn("through", F.sum("size").over(ordered))
    inside = inside.select("source", "doc_id", "hash", "size", "whole", (F.col("before") + F.col("through") <= F.col("quota")).cast("long").alias("more"))
    rest = drawn.where(~open_).select("source", "doc_id", "hash", "size", "whole", F.lit(0).cast("long").alias("more"))

    copies = F.col("whole") + F.col("more")
    chosen = large.unionByName(beside).unionByName(inside).unionByName(rest).withColumn("copies", copies)
    out = chosen.join(of.withColumnRenamed("source", "of"), same)
    return out.select("doc_id", "source", "hash", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 13, **how) -> DataFrame:
    """The mix itself: every row of ``docs`` as often as it is taken, with its own columns."""
    text, source, key = text_or_empty(text_col), F.col(f"`{source_col}`").cast("string"), F.col(f"`{id_col}`")
    plan = mix(docs, id_col, text_col, source_col, seed=seed, **how).groupBy("hash", "doc_id").agg(F.sum("copies").alias("all"), F.count(F.lit(1)).alias("rows"))
    plan = plan.where("all > 0").select(*(F.col(c).alias(f"__llm_{c}") for c in ("hash", "doc_id", "all", "rows")))
    hashed = docs.withColumn("__llm_own", F.xxhash64(F.lit(seed), key, source, text))
    joined = hashed.join(plan, (F.col("__llm_own") == F.col("__llm_hash")) & key.eqNullSafe(F.col("__llm_doc_id")))
    alone = joined.where("__llm_rows = 1").withColumn("__llm_n", F.col("__llm_all"))
    # Equal rows share their copies: the first ones get one more.
    nth = F.row_number().over(Window.partitionBy("__llm_hash", "__llm_doc_id").orderBy("__llm_own"))
    equal = joined.where("__llm_rows > 1").withColumn("__llm_n", F.floor(F.col("__llm_all") / F.col("__llm_rows")) + (nth <= F.col("__llm_all") % F.col("__llm_rows")).cast("long"))
    many = alone.unionByName(equal).where("__llm_n > 0").withColumn("__llm_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("__llm_n"))))
    return many.select(*(F.col(f"`{c}`") for c in docs.columns))

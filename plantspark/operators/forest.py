"""Isolation forest per group as a Spark job.

* every tree draws its rows from the whole group: a hash of row and tree decides, about
  ``max_samples`` rows a tree, so a group sends at most trees x max_samples rows to its
  one small fitting task (numpy), whatever its size;
* splits come from a hash too: of tree and node for the threshold, and of the feature for
  the choice among features. So draws, trees and scores are the same in any run, and SQL
  can repeat them (see the oracle queries);
* with one feature a forest is a step function of the value: the model is its steps, and
  rows find theirs when both are put in order, in the JVM. With more features rows are
  scored by numpy. Either way a group is dealt out in salted shares, so a hot group spreads
  over many tasks;
* scores are rounded to four digits and ties broken by a hash of the row, so the cut by
  contamination is exact and made of counts: per score value, then per hash bucket.

Splits are uniform inside a feature's range, so scaling features changes nothing and is
left out. Scores follow the published method; labels of another library's random trees
are not reproduced.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plantspark.functions.hashing import fractions, hash_fraction, hash_number
from plantspark.schema import SERIES
from plantspark.session import cut_lineage

ROWS_PER_SHARE = 250_000
SCORE_DIGITS = 4
TIE_BUCKETS = 4_096
EULER = 0.5772156649


def _expected_path(n: np.ndarray | float) -> np.ndarray:
    """Mean path length of an unsuccessful search among n points."""
    n = np.asarray(n, dtype=float)
    out = np.where(n == 2, 1.0, 0.0)
    big = n > 2
    m = np.where(big, n, 3.0)
    return np.where(big, 2.0 * (np.log(m - 1.0) + EULER) - 2.0 * (m - 1.0) / m, out)


def _grow(rows: np.ndarray, tree: np.ndarray, names: np.ndarray, limit: int, seed: int) -> dict[str, np.ndarray]:
    """All trees at once, level by level. ``rows``: one line per draw, ``tree``: 0, 1, ... for each, ``names``: what the hashes call them.

    Nodes are numbered over all trees, roots first; feature -1 marks a leaf, whose
    ``depth`` is the path length it stands for. In its tree a node is called 1, 2, 3 ... as
    in a heap. ``low``: the least value of the first feature that can come here.
    """
    trees = len(names)
    node = tree
    parts: list[dict[str, np.ndarray]] = []
    level, ids, following = 0, np.arange(trees), trees
    owner, heap, low_end = np.arange(trees), np.ones(trees, np.int64), np.full(trees, -np.inf)
    while len(ids):
        order = np.argsort(node, kind="stable")
        rows, node = rows[order], node[order]
        starts = np.searchsorted(node, ids)
        counts = np.diff(np.append(starts, len(node)))
        low, high = np.minimum.reduceat(rows, starts), np.maximum.reduceat(rows, starts)
        usable = high > low
        splits = (counts > 1) & usable.any(axis=1) & (level < limit)
        feature, share = np.zeros(len(ids), np.int64), np.zeros(len(ids))
        at = np.flatnonzero(splits)
        called = [f"{seed}|{t}|{n}" for t, n in zip(names[owner[at]].tolist(), heap[at].tolist(), strict=True)]
        share[at] = fractions(f"{c}|t" for c in called)
        if rows.shape[1] > 1:
            choice = np.array(fractions(f"{c}|{f}" for c in called for f in range(rows.shape[1]))).reshape(len(at), rows.shape[1])
            feature[at] = np.where(usable[at], choice, -1.0).argmax(axis=1)
        line = np.arange(len(ids))
        # Above the lowest and up to the highest value, so neither side is empty.
        threshold = high[line, feature] - share * (high[line, feature] - low[line, feature])
        left = np.where(splits, following + 2 * (np.cumsum(splits) - 1), 0)
        parts.append(
            {
                "feature": np.where(splits, feature, -1), "threshold": np.where(splits, threshold, 0.0), "left": left, "right": np.where(splits, left + 1, 0),
                "depth": np.where(splits, 0.0, level + _expected_path(counts)), "tree": owner, "low": low_end,
            }
        )
        place = np.searchsorted(ids, node)
        kept = splits[place]
        rows, place = rows[kept], place[kept]
        goes_right = rows[np.arange(len(rows)), feature[place]] >= threshold[place]
        node = left[place] + goes_right
        ids = np.arange(following, following + 2 * len(at))
        owner, heap = np.repeat(owner[at], 2), np.repeat(2 * heap[at], 2) + np.tile([0, 1], len(at))
        low_end = np.column_stack([low_end[at], threshold[at]]).ravel()
        following += len(ids)
        level += 1
    return {name: np.concatenate([p[name] for p in parts]) for name in parts[0]}


def _score_of(total: np.ndarray, trees: int, n_fit: float) -> np.ndarray:
    norm = max(float(_expected_path(n_fit)), 1e-12)
    return np.round(np.power(2.0, -(total / trees) / norm), SCORE_DIGITS)


def _steps(nodes: dict[str, np.ndarray], trees: int, n_fit: float) -> tuple[np.ndarray, np.ndarray]:
    """With one feature: values where the score changes, and the score before the first and from each on.

    The leaves of a tree in order of their lower ends are the steps of its path length; the
    forest's are all of them together.
    """
    leaf = nodes["feature"] < 0
    tree, low, depth = nodes["tree"][leaf], nodes["low"][leaf], nodes["depth"][leaf]
    order = np.lexsort((low, tree))
    tree, low, depth = tree[order], low[order], depth[order]
    first = np.r_[True, tree[1:] != tree[:-1]]
    change = np.where(first, 0.0, depth - np.r_[0.0, depth[:-1]])[~first]
    starts, where = np.unique(low[~first], return_inverse=True)
    total = depth[first].sum() + np.r_[0.0, np.cumsum(np.bincount(where, change, minlength=len(starts)))]
    scores = _score_of(total, trees, n_fit)
    new = scores[1:] != scores[:-1]
    return starts[new], np.r_[scores[0], scores[1:][new]]


MODEL = "n_fit double, trees int, feature array<int>, threshold array<double>, left array<int>, right array<int>, depth array<double>"
STEPS = "_starts array<double>, _levels array<double>"


def draws(identity: Sequence[Column | str], fits: Column, trees: int, max_samples: int, seed: int) -> Column:
    """The trees that draw a row, each with probability max_samples / ``fits`` (1 at most).

    One hash decides over as many trees as one draw in all of them is expected from, so a
    row of a large group costs one hash, not one per tree.
    """
    text = [(F.col(c) if isinstance(c, str) else c).cast("string") for c in identity]
    share = F.least(F.lit(1.0), F.lit(float(max_samples)) / fits)
    at_once = F.greatest(F.lit(1), F.least(F.lit(trees), F.floor(1.0 / share))).cast("int")
    rounds = F.sequence(F.lit(0), F.ceil(F.lit(trees) / at_once).cast("int") - 1)

    def drawn(r: Column) -> Column:
        return F.struct((r * at_once).alias("first"), F.floor(hash_fraction(seed, r.cast("string"), *text) / share).alias("step"))

    hits = F.filter(F.transform(rounds, drawn), lambda d: (d["step"] < at_once) & (d["first"] + d["step"] < trees))
    return F.transform(hits, lambda d: (d["first"] + d["step"]).cast("int"))


def _builder(keys: list[str], features: list[str], max_samples: int, seed: int):
    def build(pool: pd.DataFrame) -> pd.DataFrame:
        names, tree, sizes = np.unique(pool["_tree"], return_inverse=True, return_counts=True)
        limit = int(np.ceil(np.log2(max(2, min(max_samples, sizes.max())))))
        nodes = _grow(pool[features].to_numpy(dtype=float), tree, names, limit, seed)
        n_fit, row = float(sizes.mean()), {k: [pool[k].iloc[0]] for k in keys}
        if len(features) == 1:
            starts, levels = _steps(nodes, len(names), n_fit)
            return pd.DataFrame(row | {"_starts": [np.r_[-np.inf, starts]], "_levels": [levels]})
        return pd.DataFrame(row | {"n_fit": [n_fit], "trees": [len(names)]} | {name: [nodes[name]] for name in ("feature", "threshold", "left", "right", "depth")})

    return build


def _step_scores(rows: DataFrame, models: DataFrame, sizes: DataFrame, keys: list[str], feature: str, spread: Column) -> DataFrame:
    """Rows with the level of the last step at or below their value: rows and steps of a share in one order."""
    shares = F.greatest(F.lit(1), F.ceil(F.col("_rows") / ROWS_PER_SHARE)).cast("int")
    value, none = F.col(feature).cast("double"), F.lit(None)
    dealt = rows.join(sizes, keys).select(*rows.columns, value.alias("_at"), F.pmod(spread, shares).cast("int").alias("_share"), none.cast("double").alias("_level"))
    steps = models.join(sizes, keys).select(*keys, F.explode(F.arrays_zip("_starts", "_levels")).alias("_s"), F.sequence(F.lit(0), shares - 1).alias("_in"))
    steps = steps.select(*keys, F.col("_s._starts").alias("_at"), F.explode("_in").alias("_share"), F.col("_s._levels").alias("_level"))
    # At equal values the step comes first.
    order = Window.partitionBy(*keys, "_share").orderBy("_at", F.col("_level").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, 0)
    both = dealt.unionByName(steps.withColumn("_step", F.lit(True)), allowMissingColumns=True)
    found = both.withColumn("score", F.when(F.col("_at").isNotNull(), F.last("_level", ignorenulls=True).over(order))).where(F.col("_step").isNull())
    return found.select(*rows.columns, "score")


def _scores(data: np.ndarray, model: pd.Series) -> np.ndarray:
    feature, threshold = np.asarray(model.feature), np.asarray(model.threshold)
    left, right, depth = np.asarray(model.left), np.asarray(model.right), np.asarray(model.depth)
    total = np.zeros(len(data))
    lines = np.arange(len(data))
    for root in range(model.trees):
        at = np.full(len(data), root)
        while True:
            f = feature[at]
            inner = f >= 0
            if not inner.any():
                break
            goes_left = data[lines, np.where(inner, f, 0)] < threshold[at]
            at = np.where(inner, np.where(goes_left, left[at], right[at]), at)
        total += depth[at]
    return _score_of(total, model.trees, model.n_fit)


def forest_scores(
    df: DataFrame,
    features: Sequence[str],
    *,
    keys: Sequence[str] = SERIES,
    identity: Sequence[str] = ("time",),
    trees: int = 100,
    max_samples: int = 256,
    seed: int = 42,
    min_rows: int = 10,
    fit: Column | None = None,
) -> DataFrame:
    """Rows of groups with at least ``min_rows`` fitting rows, with ``score`` in (0, 1).

    ``identity``: columns that tell the rows of a group apart (they decide the draws).
    ``max_samples``: rows a tree is expected to draw, the method's own subsample.
    ``fit``: rows the forest learns from (default all); every row is scored.
    """
    keys, features = list(keys), list(features)
    ready = df.withColumn("_fit", F.coalesce(fit, F.lit(False)) if fit is not None else F.lit(True))
    sizes = ready.groupBy(*keys).agg(F.count("*").alias("_rows"), F.count_if("_fit").alias("_fits")).where(F.col("_fits") >= min_rows)
    sized = ready.join(sizes, keys)
    text = _text(df, [*keys, *identity])
    tree = F.explode(draws(text, F.col("_fits"), trees, max_samples, seed)).alias("_tree")
    pool = sized.where("_fit").select(*keys, *[F.col(f).cast("double").alias(f) for f in features], tree)
    key_ddl = ", ".join(f"{k} {df.schema[k].dataType.simpleString()}" for k in keys)
    models = pool.groupBy(*keys).applyInPandas(_builder(keys, features, max_samples, seed), f"{key_ddl}, {STEPS if len(features) == 1 else MODEL}")
    if len(features) == 1:
        return _step_scores(df, models, sizes.select(*keys, "_rows"), keys, features[0], F.xxhash64(F.lit(seed), *keys, *identity))
    schema = T.StructType([*df.schema.fields, T.StructField("score", T.DoubleType())])
    return apply_model(
        df, models, sizes.select(*keys, "_rows"), keys, F.xxhash64(F.lit(seed), *keys, *identity), lambda rows, model: rows.assign(score=_scores(rows[features].to_numpy(dtype=float), model)), schema
    )


def _text(df: DataFrame, names: Sequence[str]) -> list[Column]:
    """Columns as hashes see them: times as microseconds."""
    return [(F.unix_micros(c) if isinstance(df.schema[c].dataType, T.TimestampType) else F.col(c)).cast("string") for c in names]


def apply_model(
    rows: DataFrame, models: DataFrame, sizes: DataFrame, keys: Sequence[str], spread: Column, fn: Callable[[pd.DataFrame, pd.Series], pd.DataFrame], schema: T.StructType
) -> DataFrame:
    """Run ``fn(rows, model)`` with each group's small model beside its rows.

    ``sizes`` holds each group's row count as ``_rows``: a group is dealt out by the hash
    ``spread`` into shares of bounded size and only the model is repeated per share.
    """
    shares = F.greatest(F.lit(1), F.ceil(F.col("_rows") / ROWS_PER_SHARE)).cast("int")
    dealt = rows.join(sizes, list(keys)).withColumn("_share", F.pmod(spread, shares).cast("int"))
    copies = models.join(sizes, list(keys)).withColumn("_share", F.explode(F.sequence(F.lit(0), shares - 1))).drop("_rows")
    names = [f.name for f in schema.fields]

    def run(part: pd.DataFrame, model: pd.DataFrame) -> pd.DataFrame:
        if model.empty or part.empty:
            return pd.DataFrame(columns=names)
        return fn(part.drop(columns=["_share", "_rows"]), model.iloc[0])[names]

    grouping = [*keys, "_share"]
    return dealt.groupBy(*grouping).cogroup(copies.groupBy(*grouping)).applyInPandas(run, schema)


def cut_by_share(scored: DataFrame, share: Column | float, *, keys: Sequence[str] = SERIES, identity: Sequence[str] = ("time",), among: Column | None = None) -> DataFrame:
    """Add ``is_outlier``: the ceil(share * n) rows of a group with the highest scores.

    Equal scores are ranked by a hash of ``identity``. ``among``: rows that set the cut
    (default all). ``share`` may differ per group.
    """
    keys = list(keys)
    tie = hash_number(*_text(scored, [*keys, *identity]))
    rows = scored.withColumns({"_tie": tie, "_bucket": F.pmod(tie, F.lit(TIE_BUCKETS)).cast("int")})
    base = rows.where(among) if among is not None else rows
    wish = share if isinstance(share, Column) else F.lit(float(share))
    side = Window.partitionBy(*keys)
    before = Window.unboundedPreceding, -1

    # Counts per score, from the top: the score at which the wanted number is reached.
    slots = base.withColumn("_wish", wish).groupBy(*keys, "score").agg(F.count("*").alias("_c"), F.max("_wish").alias("_wish"))
    above = F.coalesce(F.sum("_c").over(side.orderBy(F.col("score").desc()).rowsBetween(*before)), F.lit(0))
    wanted = F.ceil(F.max("_wish").over(side) * F.sum("_c").over(side) - 1e-9)
    at = slots.select(*keys, F.col("score").alias("_cut"), "_c", above.alias("_above"), wanted.alias("_wanted"))
    at = at.where((F.col("_above") < F.col("_wanted")) & (F.col("_wanted") <= F.col("_above") + F.col("_c"))).select(*keys, "_cut", (F.col("_wanted") - F.col("_above")).alias("_left"))

    # Among the rows of that score: counts per hash bucket, then the rows of one bucket.
    level = base.join(at, keys).where(F.col("score") == F.col("_cut")).select(*keys, "_tie", "_bucket", "_left")
    filled = level.groupBy(*keys, "_bucket").agg(F.count("*").alias("_c"), F.max("_left").alias("_left"))
    under = F.coalesce(F.sum("_c").over(side.orderBy("_bucket").rowsBetween(*before)), F.lit(0))
    last = filled.select(*keys, F.col("_bucket").alias("_last"), "_c", under.alias("_under"), "_left")
    last = last.where((F.col("_under") < F.col("_left")) & (F.col("_left") <= F.col("_under") + F.col("_c")))
    some = level.drop("_left").join(last.select(*keys, "_last", (F.col("_left") - F.col("_under")).alias("_rest")), keys).where(F.col("_bucket") == F.col("_last"))
    numbered = some.withColumn("_n", F.row_number().over(side.orderBy("_tie"))).where(F.col("_n") <= F.col("_rest"))
    edge = numbered.groupBy(*keys).agg(F.max("_last").alias("_last"), F.max("_tie").alias("_edge"))

    tied = (F.col("_bucket") < F.col("_last")) | ((F.col("_bucket") == F.col("_last")) & (F.col("_tie") <= F.col("_edge")))
    is_outlier = (F.col("score") > F.col("_cut")) | ((F.col("score") == F.col("_cut")) & tied)
    judged = rows.join(at.drop("_left").join(edge, keys), keys, "left").withColumn("is_outlier", F.coalesce(is_outlier, F.lit(False)))
    return judged.drop("_tie", "_bucket", "_cut", "_last", "_edge")


def outliers(df: DataFrame, features: Sequence[str] = ("value",), contamination: float = 0.1, *, keys: Sequence[str] = SERIES, identity: Sequence[str] = ("time",), **options) -> DataFrame:
    """Fit, score and flag in one go; the scores are written once and read twice."""
    scored = cut_lineage(forest_scores(df, features, keys=keys, identity=identity, **options))
    return cut_by_share(scored, contamination, keys=keys, identity=identity)

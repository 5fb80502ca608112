"""Hard negatives by exact inner-product search with lists shared by clusters of anchors.

As in MAXIMUS (Abuzaid et al., 2019): the anchors are clustered, and for every cluster the
candidates are sorted once by an upper bound of their inner product with any member, namely
|x| cos(max(0, angle to the centre - widest angle of the cluster)) for a member of length
one. Every member walks this list until the bound proves that nothing further can enter its
results. So the result is exact and equals brute force, ties included.

Anchors are worked on in chunks of bounded size (``CHUNK_BYTES``): one chunk is broadcast,
with its centres, while Spark scans all candidates, block by block; each task keeps the best
of its rows so far, so that later blocks stop sooner, and hands out at most ``first`` rows a
search. Two passes: the first finds the nearest rows of the same label (positives), the
second for each positive the first rows of other labels with a score in the asked range.
The results of a chunk are written before the next one starts. Centres are fitted on at most
``FIT`` anchors of the chunk; they decide the order of the walk, never the result.

Edge cases: rows with a null label, a null vector or any null or non-finite component take no
part; vectors of unequal lengths count as filled up with zeros; equal scores go by the
smaller id, null ids last (a null id is never an anchor); a row that repeats an anchor in
full is another row, so it may be its positive, and its own results are repeated; scores
beyond 64 bits are not defined; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

#: Bytes of anchor vectors that are broadcast at once.
CHUNK_BYTES = 8 << 20
#: Anchors on which the centres of a chunk are fitted, and members per centre.
FIT, PER_CENTRE = 4096, 64
#: Candidates of one list, and those that a walk scores at a time.
BLOCK, STRIDE = 8192, 512
#: Above this a product of doubles may be off by more than rounding to a whole number mends.
EXACT = 2.0**52
_LAST = np.iinfo(np.int64).max


def prepared(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", scale: float = 256.0, relabel: Column | None = None) -> DataFrame:
    """id, label and vector (array<long>, floor(scale * x)) of the rows that take part."""
    vector = F.col(f"`{vector_col}`")
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    label = F.col(f"`{label_col}`").cast("long")
    kept = rows.where(F.col(f"`{label_col}`").isNotNull() & vector.isNotNull() & finite)
    whole = F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("long"))
    return kept.select(F.col(f"`{id_col}`").cast("long").alias("id"), (relabel if relabel is not None else label).cast("long").alias("label"), whole.alias("vector"))


def _matrix(vectors: list) -> np.ndarray:
    """Rows of whole numbers, filled up with zeros."""
    width = max((len(v) for v in vectors), default=0)
    out = np.zeros((len(vectors), width), np.int64)
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    return out


def _unit(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Directions and lengths; a null vector has the direction of the first axis."""
    x = x.astype(np.float64)
    length = np.sqrt(np.einsum("ij,ij->i", x, x))
    out = x / np.where(length > 0, length, 1)[:, None]
    out[length == 0] = 0
    if out.shape[1]:
        out[length == 0, 0] = 1
    return out, length


def _angle(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(a @ b.T, -1, 1))


def centres(x: np.ndarray, per: int = PER_CENTRE, rounds: int = 8) -> np.ndarray:
    """Spherical k-means from evenly spaced rows; fitted on at most FIT of them."""
    fit = x[:: max(1, -(-len(x) // FIT))]
    k = max(1, len(x) // per)
    at = fit[np.linspace(0, len(fit) - 1, min(k, len(fit))).astype(int)]
    for _ in range(rounds):
        own = (fit @ at.T).argmax(1)
        sums = np.zeros_like(at)
        np.add.at(sums, own, fit)
        moved, length = _unit(sums)
        at = np.where((length > 0)[:, None], moved, at)
    return at


class Anchors:
    """One chunk: vectors, clusters, and the searches that its members run."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray):
        self.ids, self.labels, self.vectors = ids, labels, vectors
        direction, self.length = _unit(vectors)
        self.centres = centres(direction)
        own = (direction @ self.centres.T).argmax(1)
        away = np.array([_angle(direction[i : i + 1], self.centres[c : c + 1])[0, 0] for i, c in enumerate(own)])
        self.members = [np.flatnonzero(own == c) for c in range(len(self.centres))]
        self.widest = np.array([away[m].max() if len(m) else 0.0 for m in self.members])


class Searches:
    """Top lists of many searches: (anchor, least score, greatest score), by score, then id, null ids last."""

    def __init__(self, anchor: np.ndarray, least: np.ndarray, greatest: np.ndarray, first: int, same: bool):
        self.anchor, self.least, self.greatest, self.first, self.same = anchor, least, greatest, first, same
        shape = (len(anchor), first)
        self.score, self.id = np.zeros(shape, np.int64), np.zeros(shape, np.int64)
        self.none, self.filled = np.zeros(shape, bool), np.zeros(len(anchor), np.int64)
        self.bar = least.copy()  # no score below it can still enter

    def add(self, search: np.ndarray, score: np.ndarray, ids: np.ndarray, none: np.ndarray) -> None:
        """Merge rows into the lists of their searches; the other lists are not touched."""
        if not len(search):
            return
        touched = np.unique(search)
        row, place = np.nonzero(np.arange(self.first) < self.filled[touched, None])
        held = touched[row]
        search, score = np.r_[held, search], np.r_[self.score[held, place], score]
        ids, none = np.r_[self.id[held, place], ids], np.r_[self.none[held, place], none]
        order = np.lexsort((ids, none, -score, search))
        search, score, ids, none = search[order], score[order], ids[order], none[order]
        start = np.flatnonzero(np.r_[True, search[1:] != search[:-1]])
        place = np.arange(len(search)) - np.repeat(start, np.diff(np.r_[start, len(search)]))
        keep = place < self.first
        search, place = search[keep], place[keep]
        self.score[search, place], self.id[search, place], self.none[search, place] = score[keep], ids[keep], none[keep]
        self.filled[touched] = np.bincount(np.searchsorted(touched, search), minlength=len(touched))
        full = touched[self.filled[touched] == self.first]
        self.bar[full] = np.maximum(self.bar[full], self.score[full, -1])

    def rows(self) -> pd.DataFrame:
        search, place = np.nonzero(np.arange(self.first) < self.filled[:, None])
        ids = pd.array(self.id[search, place], "Int64")
        ids[self.none[search, place]] = pd.NA
        return pd.DataFrame({"search": search, "score": self.score[search, place], "id": ids})


def _scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products: doubles where no sum can pass 2^52, else 64-bit integers."""
    top = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * max(1, a.shape[1])
    if top < EXACT:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a @ b.T


def walk(anchors: Anchors, searches: Searches, ids: np.ndarray, none: np.ndarray, labels: np.ndarray, vectors: np.ndarray) -> int:
    """Offer one block of candidates to all searches; the number of scores computed."""
    width = max(vectors.shape[1], anchors.vectors.shape[1])
    pad = lambda x: np.pad(x, ((0, 0), (0, width - x.shape[1]))) if x.shape[1] < width else x
    mine, vectors = pad(anchors.vectors), pad(vectors)
    direction, length = _unit(vectors)
    angles = _angle(direction, pad(anchors.centres))
    by_anchor = np.argsort(searches.anchor, kind="stable")
    starts = np.searchsorted(searches.anchor[by_anchor], np.arange(len(anchors.ids) + 1))
    made = 0
    for c, members in enumerate(anchors.members):
        members = members[starts[members + 1] > starts[members]]
        if not len(members):
            continue
        count = starts[members + 1] - starts[members]
        own_first = np.cumsum(count) - count
        own = by_anchor[np.repeat(starts[members] - own_first, count) + np.arange(count.sum())]
        # Rounding of angles and lengths is far below this margin.
        bound = length * np.cos(np.maximum(0.0, angles[:, c] - anchors.widest[c] - 1e-6))
        order = np.argsort(-bound, kind="stable")
        for at in range(0, len(order), STRIDE):
            # A member goes on while the best of what is left may reach one of its bars.
            reach = bound[order[at]] * anchors.length[members]
            reach += np.abs(reach) * 1e-9 + 1e-3
            live = np.flatnonzero(reach >= np.minimum.reduceat(searches.bar[own], own_first))
            if not len(live):
                break
            part, who = order[at : at + STRIDE], members[live]
            scores = _scores(mine[who], vectors[part])
            made += scores.size
            kind = labels[part][None, :] == anchors.labels[who][:, None]
            fitting = kind if searches.same else ~kind
            if searches.same:  # not the anchor itself; rows that repeat it in full are added by their number
                for i, j in np.argwhere((ids[part][None, :] == anchors.ids[who][:, None]) & kind & ~none[part][None, :]):
                    fitting[i, j] = (vectors[part[j]] != mine[who[i]]).any()
            for turn in range(int(count[live].max())):
                having = np.flatnonzero(count[live] > turn)
                s = own[own_first[live[having]] + turn]
                good = fitting[having] & (scores[having] >= searches.bar[s][:, None]) & (scores[having] <= searches.greatest[s][:, None])
                i, j = np.nonzero(good)
                searches.add(s[i], scores[having[i], j], ids[part[j]], none[part[j]])
    return made


def _blocks(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += len(batch)
        if n >= BLOCK:
            yield _arrays(pd.concat(held))
            held, n = [], 0
    if n:
        yield _arrays(pd.concat(held))


def _arrays(rows: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    none = rows["id"].isna().to_numpy()
    return rows["id"].fillna(_LAST).astype("int64").to_numpy() if none.any() else rows["id"].to_numpy().astype(np.int64), none, rows["label"].to_numpy().astype(np.int64), _matrix(list(rows["vector"]))


_FOUND = "search long, score long, id long"


def _run(candidates: DataFrame, shared, least: np.ndarray, greatest: np.ndarray, anchor: np.ndarray, first: int, same: bool) -> DataFrame:
    """(search, score, id, rank): the first rows of every search, from all candidates."""
    asked = candidates.sparkSession.sparkContext.broadcast((anchor, least, greatest))

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        searches = Searches(*(x.copy() for x in asked.value), first, same)
        for block in _blocks(batches):
            walk(shared.value, searches, *block)
        yield searches.rows()

    rows = candidates.select(F.col("id"), "label", "vector").mapInPandas(search, _FOUND)
    ranked = F.row_number().over(Window.partitionBy("search").orderBy(F.col("score").desc(), F.col("id").asc_nulls_last()))
    return rows.withColumn("rank", ranked).where(F.col("rank") <= first)


def _chunks(anchors: DataFrame) -> tuple[DataFrame, int]:
    """Deal distinct anchors to chunks of at most CHUNK_BYTES; checked by counting."""
    key = F.xxhash64("id", "label", "vector")
    n = 1
    while True:
        dealt = anchors.withColumn("chunk", F.pmod(key, F.lit(n)).cast("int"))
        top = dealt.groupBy("chunk").agg(F.sum(F.size("vector") * 8 + 64).alias("bytes")).agg(F.max("bytes")).first()[0] or 0
        if top <= CHUNK_BYTES:
            return dealt, n
        n = max(2 * n, int(n * top / CHUNK_BYTES) + 1)


def mine(candidates: DataFrame, anchors: DataFrame, positives: int = 5, negatives: int = 10, least: int = 30, greatest: int = 90) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    ``candidates`` and ``anchors`` are like the result of ``prepared``; the anchors are rows
    of the candidates. A negative n of a positive p has
    ``least * p <= 100 * n <= greatest * p``.
    """
    spark = candidates.sparkSession
    rows = written(candidates.select("id", "label", "vector"))
    distinct = written(anchors.groupBy("id", "label", "vector").agg(F.count(F.lit(1)).alias("copies")))
    dealt, n = _chunks(distinct)
    parts = []
    for chunk in range(n):
        own = dealt.where(F.col("chunk") == chunk).toPandas()  # at most CHUNK_BYTES
        if not len(own):
            continue
        vectors = _matrix(list(own["vector"]))
        held = Anchors(own["id"].to_numpy().astype(np.int64), own["label"].to_numpy().astype(np.int64), vectors)
        shared = spark.sparkContext.broadcast(held)
        lowest, highest = np.iinfo(np.int64).min, np.iinfo(np.int64).max
        every = np.arange(len(own))
        near = _run(rows, shared, np.full(len(own), lowest), np.full(len(own), highest), every, positives, True)
        found = near.select("search", "score", "id").toPandas()  # at most ``positives`` rows an anchor
        # Rows that repeat an anchor in full score as itself.
        again = own["copies"].to_numpy().astype(np.int64) - 1
        if again.any():
            self_score = np.array([int(_scores(v[None], v[None])[0, 0]) for v in vectors])
            times = np.minimum(again, positives)
            more = pd.DataFrame({"search": np.repeat(every, times), "score": np.repeat(self_score, times), "id": np.repeat(held.ids, times)})
            found = pd.concat([found, more])
        found["none"] = found["id"].isna()
        found = found.sort_values(["search", "score", "none", "id"], ascending=[True, False, True, True]).groupby("search").head(positives).reset_index(drop=True)
        if not len(found):
            continue
        p = found["score"].to_numpy().astype(np.int64)
        # Whole bounds of the range; Python's floor division is exact for either sign.
        low = np.array([-(-least * int(x) // 100) for x in p], np.int64)
        high = np.array([greatest * int(x) // 100 for x in p], np.int64)
        asked = found["search"].to_numpy().astype(np.int64)
        hits = _run(rows, shared, low, high, asked, negatives, False)
        told = [(i, int(held.ids[a]), None if none else int(x), int(s), int(own["copies"].iloc[a])) for i, (a, x, none, s) in enumerate(zip(asked, found["id"], found["none"], p, strict=True))]
        names = spark.createDataFrame(told, "search long, anchor_id long, positive_id long, positive_score long, copies long")
        joined = hits.withColumnRenamed("id", "negative_id").withColumnRenamed("score", "negative_score").join(names, "search")
        repeated = joined.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
        parts.append(written(repeated.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")))
    if not parts:
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    return reduce(DataFrame.unionByName, parts)

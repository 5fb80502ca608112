"""SimHash near-duplicates: pigeonhole blocks propose pairs, the Hamming distance decides.

Distinct fingerprints (copies collapse first) are split into six blocks of bits. Two that
differ in at most three bits agree in at least three blocks, so they share one of the 20
keys made of three blocks (31 to 33 bits each). Inside a shared key all pairs are compared
with numpy, but only links of a spanning forest leave the task, at most one per row and
group, never all pairs. A key held by more than ``TILE`` fingerprints is cut into tiles, and
each pair of tiles is a group of its own: memory stays bounded and no pair is lost.

Components of the remaining links come from alternating large-star and small-star joins
(Kiveris et al., 2014), with a checkpoint per round.

Edge cases: a null text is an empty one; texts without words share fingerprint zero and are
linked like any other; with fewer than three words the whole sequence is one shingle;
repeated rows link to each other; a null id is never the smallest one; an empty table gives
no rows; input columns named like an output are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, islice

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, text_or_empty

SHINGLE = 3
DISTANCE = 3
BLOCKS = 6
SEED = 42
#: Fingerprints compared against each other in one group, twice this at most.
TILE = 1000
#: Shingles whose bits are summed at a time.
PART = 1 << 16


def fingerprint(text: str) -> int:
    """A bit is 1 if more than half of the shingles' hashes have it."""
    words = text.encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z only
    if not words:
        return 0
    if len(words) < SHINGLE:
        shingles = iter([b" ".join(words)])
    else:
        shingles = map(b" ".join, zip(*(words[i:] for i in range(SHINGLE)), strict=False))
    ones, n = np.zeros(64, np.int64), 0
    while part := list(islice(shingles, PART)):
        hashes = np.fromiter((xxhash.xxh64_intdigest(s, SEED) for s in part), np.uint64, len(part))
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
        n += len(part)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, text_col: str = "text", out: str = "fingerprint") -> DataFrame:
    """Add the signed 64-bit fingerprint."""
    made = F.pandas_udf(lambda texts: pd.Series([fingerprint(t) for t in texts], dtype="int64"), "long")
    return docs.withColumn(out, made(text_or_empty(text_col)))


def as_hex(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def block_keys(fp: Column, distance: int = DISTANCE, blocks: int = BLOCKS) -> Column:
    """One key per choice of ``blocks - distance`` blocks, tagged with the choice."""
    edges = [64 * i // blocks for i in range(blocks + 1)]
    keys = []
    for tag, chosen in enumerate(combinations(range(blocks), blocks - distance)):
        key = F.lit(tag).cast("long")
        for b in chosen:
            width = edges[b + 1] - edges[b]
            key = F.shiftleft(key, width).bitwiseOR(F.shiftrightunsigned(fp, edges[b]).bitwiseAND(F.lit((1 << width) - 1)))
        keys.append(key)
    return F.array(*keys)


def _forest(fps: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """(fingerprint, smallest of its component) for the rows of one group that have a smaller one."""
    bits = fps.view(np.uint64)
    label = np.arange(len(fps))
    links = []
    for at in range(0, len(fps), 256):
        near = np.bitwise_count(bits[at : at + 256, None] ^ bits[None, :]) <= distance
        left, right = np.nonzero(near)
        keep = left + at < right
        links.append(np.stack([left[keep] + at, right[keep]]))
    left, right = np.concatenate(links, axis=1)
    while True:
        before = label.copy()
        low = np.minimum(label[left], label[right])
        np.minimum.at(label, left, low)
        np.minimum.at(label, right, low)
        label = label[label]
        if (before == label).all():
            break
    child = np.flatnonzero(label != np.arange(len(fps)))
    return fps[child], fps[label[child]]


def _grouped_links(batches: Iterator[pd.DataFrame], distance: int) -> Iterator[pd.DataFrame]:
    """Rows arrive sorted by (key, i, j); a group may go on in the next batch."""
    held: pd.DataFrame | None = None
    for batch in batches:
        if held is not None:
            batch = pd.concat([held, batch], ignore_index=True)
        group = batch[["key", "i", "j"]].to_numpy()
        starts = np.flatnonzero(np.r_[True, (group[1:] != group[:-1]).any(1)]) if len(batch) else np.array([0])
        held = batch.iloc[starts[-1] :]
        yield _links(batch["fp"].to_numpy()[: starts[-1]], starts, distance)
    if held is not None and len(held):
        yield _links(held["fp"].to_numpy(), np.array([0, len(held)]), distance)


def _links(fps: np.ndarray, starts: np.ndarray, distance: int) -> pd.DataFrame:
    sizes = np.diff(starts)
    out: list[tuple[np.ndarray, np.ndarray]] = []
    two = starts[:-1][sizes == 2]  # by far the most common size
    a, b = fps[two], fps[two + 1]
    near = np.bitwise_count(a.view(np.uint64) ^ b.view(np.uint64)) <= distance
    out.append((np.maximum(a, b)[near], np.minimum(a, b)[near]))
    for start, size in zip(starts[:-1][sizes > 2], sizes[sizes > 2], strict=True):
        out.append(_forest(np.sort(fps[start : start + size]), distance))
    return pd.DataFrame({"a": np.concatenate([x for x, _ in out]), "b": np.concatenate([x for _, x in out])})


def links(distinct: DataFrame, distance: int = DISTANCE, blocks: int = BLOCKS, tile: int = TILE) -> DataFrame:
    """Links (a, b), a > b, whose components are those of all pairs within ``distance`` bits.

    ``distinct`` has one column ``fp`` of distinct fingerprints.
    """
    keyed = distinct.select("fp", F.explode(block_keys(F.col("fp"), distance, blocks)).alias("key"))
    shared = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    parts = F.ceil(F.col("n") / tile)
    own = F.pmod(F.xxhash64("fp"), parts)
    others = F.when(parts == 1, F.array(F.lit(0).cast("long"))).otherwise(F.sequence(F.lit(0).cast("long"), parts - 1))
    tiled = keyed.join(shared, "key").select("key", "fp", own.alias("own"), F.explode(others).alias("other"))
    grouped = tiled.select("key", "fp", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))
    sorted_rows = grouped.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    return sorted_rows.mapInPandas(lambda rows: _grouped_links(rows, distance), "a long, b long").distinct()


def _spread(df: DataFrame) -> DataFrame:
    """Deal rows out evenly, so that a join above can split its hot keys."""
    return df.repartition(max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))))


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b), the root being the smallest node of its component; roots included."""
    edges = cut(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())
    seen = None
    while True:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = _spread(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m")))
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        low = _spread(large.groupBy("a").agg(F.min("b").alias("m")))
        small = large.join(low, "a").select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b"))
        edges = cut(small.where("a <> b").distinct())
        state = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == seen:
            break
        seen = state
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def roots(prints: DataFrame, id_col: str = "doc_id", fp_col: str = "fingerprint", distance: int = DISTANCE, blocks: int = BLOCKS) -> DataFrame:
    """(fp, least, root) per distinct fingerprint: the smallest id that has it, the smallest fingerprint of its component."""
    classes = cut(prints.groupBy(F.col(f"`{fp_col}`").alias("fp")).agg(F.min(id_col).alias("least")))
    found = components(links(classes.select("fp"), distance, blocks)).withColumnRenamed("node", "fp")
    return classes.join(found, "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))


def clustered(prints: DataFrame, id_col: str = "doc_id", fp_col: str = "fingerprint", distance: int = DISTANCE, blocks: int = BLOCKS) -> DataFrame:
    """Add ``component_id``, the smallest id in the component of each row's fingerprint.

    ``prints`` is read several times: pass a written or checkpointed table of narrow rows.
    """
    labelled = roots(prints, id_col, fp_col, distance, blocks)
    least = _spread(labelled.groupBy("root").agg(F.min("least").alias("component_id")))
    members = labelled.select("fp", "root").join(least, "root").select(F.col("fp").alias("__llm_fp"), "component_id")
    rest = [F.col(f"`{c}`") for c in prints.columns if c != "component_id"]
    return prints.select(*rest).join(_spread(members), F.col(f"`{fp_col}`") == F.col("__llm_fp"), "left").drop("__llm_fp")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", distance: int = DISTANCE, blocks: int = BLOCKS) -> DataFrame:
    """One row of each component: that with the smallest id, the smallest hash of all columns where ids are equal or null."""
    columns = [F.col(f"`{c}`") for c in docs.columns]
    own = F.xxhash64(*columns)
    keyed = docs.select(F.col(f"`{id_col}`").alias("id"), own.alias("own"), text_or_empty(text_col).alias("text"))
    prints = cut(fingerprints(keyed).drop("text"))
    # A component's first row by (id is null, id, own); copies collapse before the shuffles.
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "own"))
    firsts = prints.groupBy(F.col("fingerprint").alias("fp")).agg(first.alias("first"))
    kept = roots(prints, "id", "fingerprint", distance, blocks).join(firsts, "fp").groupBy("root").agg(F.min("first").alias("first"))
    keep = _spread(kept.select(F.col("first.id").alias("__llm_id"), F.col("first.own").alias("__llm_own")))
    chosen = docs.withColumn("__llm_row", own)
    out = chosen.join(keep, (F.col("__llm_row") == F.col("__llm_own")) & F.col(f"`{id_col}`").eqNullSafe(F.col("__llm_id")), "left_semi")
    if prints.groupBy("id", "own").count().where("count > 1").isEmpty():
        return out.drop("__llm_row")
    return out.dropDuplicates(["__llm_row", id_col]).drop("__llm_row")

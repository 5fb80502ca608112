"""Repeated passages by compaction of a De Bruijn graph of words.

With windows of 35 words, a node is a sequence of 34 words and an edge a piece of text that
leads from one node to another: all windows in a row that share their smallest 16-word
k-mer, one word or more further on. So an edge is found within the scan of its text, and two
edges that follow each other in a text meet at the node of 34 words that both hold.

1. ``k-mers``: Spark counts the smallest k-mers of all texts and joins those seen twice back
   to their texts. Windows of a unique k-mer are unique and leave the search.
2. ``graph``: edges seen twice are its edges. In- and out-degrees of the nodes are counted; a
   node with one edge in and one out does not branch, and joins the two. Such paths are
   compacted: first along the text that an edge was first seen in, whose coordinates put its
   edges in order, then by pointer doubling over the pieces left, in joins.
3. ``spans``: every occurrence is known by its source coordinates (text, window, length).
   Occurrences that follow each other in a text and on a path form one long repeated span.
4. ``windows``: beside a branch a window may repeat although its edge does not. There the
   35-word windows themselves are compared: those of edges seen once, and of one source of a
   repeated edge whose k-mer also occurs in such edges.

The words of repeated windows are removed, all copies included, judged on the input.
Texts with the same words are worked on once, with the weight two. What decides is never a
rolling hash (these only choose k-mers and name nodes, where a clash costs work, not
results): texts are equal by SHA-256, edges and windows by BLAKE2b over their words, 128 bits each.

Edge cases: a null text has no words; texts shorter than a window keep all; repeated rows
and equal texts of a window or more lose all words; a null id is an id like any other; an
empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import text_or_empty, written

WINDOW = 35
EDGE = 16

_U = np.uint64
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
_SEEDS = (0x9E3779B97F4A7C15,)
_BYTES = [np.random.default_rng(11).integers(1, 1 << 63, 256, dtype=np.uint64) * _U(2) + _U(1)]
_POWERS: dict[tuple[int, bool], np.ndarray] = {}


def _powers(seed: int, inverse: bool, n: int) -> np.ndarray:
    """1, b, b^2, ... modulo 2^64, of an odd b or its inverse."""
    have = _POWERS.get((seed, inverse))
    if have is None or len(have) < n:
        base = pow(_SEEDS[seed], -1, 1 << 64) if inverse else _SEEDS[seed]
        have = np.full(max(n, 1 << 16) * 5 // 4, base, np.uint64)
        have[0] = 1
        _POWERS[seed, inverse] = have = np.multiply.accumulate(have)
    return have


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(33))) * _U(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> _U(29))) * _U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> _U(32))


def _sums(values: np.ndarray, seed: int) -> np.ndarray:
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * _powers(seed, True, len(values))[: len(values)], out=out[1:])
    return out


def _ranges(sums: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int) -> np.ndarray:
    """Hashes of the values between start and end, equal for equal values wherever they stand."""
    return _mix((sums[end] - sums[start]) * _powers(seed, False, len(sums))[start])


class Words:
    """The words of a text as running sums, from which the hash of any range follows at once."""

    def __init__(self, data: bytes, seeds: tuple[int, ...] = (0,)):
        self.data = data
        raw = np.frombuffer(data, np.uint8)
        word = ~_BLANK[raw]
        start = np.flatnonzero(word & np.r_[True, ~word[:-1]]) if len(raw) else np.zeros(0, int)
        end = np.flatnonzero(word & np.r_[~word[1:], True]) + 1 if len(raw) else np.zeros(0, int)
        self.n, self.start, self.end = len(start), start, end
        self.sums = {s: _sums(_ranges(_sums(_BYTES[s][raw], s), start, end, s), s) for s in seeds}

    def hashes(self, start: np.ndarray, end: np.ndarray, seed: int = 0) -> np.ndarray:
        return _ranges(self.sums[seed], start, end, seed)

    def digests(self, first: np.ndarray, end: np.ndarray) -> list[bytes]:
        """128 bits of the words between first and end; the data must have single blanks."""
        data, digest = self.data, hashlib.blake2b
        return [digest(data[a:b], digest_size=16).digest() for a, b in zip(self.start[first].tolist(), self.end[end - 1].tolist(), strict=True)]

    def edges(self, window: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(first window, number of windows, hash) of the kept k-mers: each is the smallest of a run of windows."""
        if self.n < window:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
        at = np.arange(self.n - k + 1)
        grams = self.hashes(at, at + k)
        low = np.lib.stride_tricks.sliding_window_view(grams, window - k + 1).argmin(1)
        low += np.arange(len(low))
        first = np.flatnonzero(np.r_[True, low[1:] != low[:-1]])
        return first, np.diff(np.r_[first, len(low)]), grams[low[first]]


def _pack(low: np.ndarray, size: np.ndarray) -> np.ndarray:
    return low.astype(np.int64) << 8 | size << 1


def _unpack(packed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return packed >> 8, packed >> 1 & 127


def plain(text: str) -> bytes:
    """The words, joined by one space."""
    return b" ".join(text.encode("utf-8", "surrogatepass").split())


def _packed(texts: pd.Series) -> pd.DataFrame:
    """Texts travel compressed, beside the SHA-256 of their words."""
    pack = zstandard.ZstdCompressor(level=3).compress
    words = [plain(t) for t in texts]
    return pd.DataFrame({"of": [hashlib.sha256(w).digest()[:16] for w in words], "words": [pack(w) for w in words]})


def _scan(rows: Iterator[pd.DataFrame], window: int, k: int) -> Iterator[pd.DataFrame]:
    for batch in rows:
        out = []
        for text in batch["text"]:
            words = Words(data := plain(text))
            digest = hashlib.sha256(data)
            out.append((digest.digest()[:16], words.n, digest.hexdigest(), words.edges(window, k)[2].view(np.int64)))
        made = pd.DataFrame(out, columns=["of", "n_words", "kept_sha256", "grams"])
        yield pd.concat([batch[["row", "doc_id"]].reset_index(drop=True), made], axis=1)


def _edge_rows(rows: Iterator[pd.DataFrame], window: int, k: int) -> Iterator[pd.DataFrame]:
    """The edges of each text that have a repeated k-mer."""
    unpack = zstandard.ZstdDecompressor().decompress
    for batch in rows:
        out = []
        for text, data, repeated, weight in zip(batch["text"], batch["words"], batch["places"], batch["weight"], strict=True):
            words = Words(unpack(data))
            first, size, grams = (x[np.sort(repeated)] for x in words.edges(window, k))
            end = first + size - 1 + window
            left, right = (words.hashes(x, x + window - 1).view(np.int64) for x in (first, end - window + 1))
            kind = {"digest": words.digests(first, end), "gram": grams.view(np.int64), "left": left, "right": right}
            out.append(pd.DataFrame(kind | {"text": text, "at": _pack(first, size), "weight": weight}))
        if out:
            yield pd.concat(out, ignore_index=True)


def _window_rows(rows: Iterator[pd.DataFrame], window: int, k: int) -> Iterator[pd.DataFrame]:
    """Windows of the edges that are not settled, and of those that speak for a settled one."""
    unpack = zstandard.ZstdDecompressor().decompress
    for batch in rows:
        out = []
        for text, data, repeated, weight, settled in zip(*(batch[c] for c in ("text", "words", "places", "weight", "settled")), strict=True):
            words = Words(unpack(data))
            first, size = (x[repeated] for x in words.edges(window, k)[:2])
            open_ = np.zeros(words.n + 1, np.int64)
            np.add.at(open_, first, 1)
            np.add.at(open_, first + size, -1)
            if settled is not None:
                packed = np.array([x["at"] for x in settled], np.int64)
                low, size = _unpack(packed[packed & 1 == 0])  # settled, and another source speaks for it or none has to
                np.add.at(open_, low, -1)
                np.add.at(open_, low + size, 1)
            starts = np.flatnonzero(np.cumsum(open_))
            if len(starts):
                out.append(pd.DataFrame({"digest": words.digests(starts, starts + window), "text": text, "start": starts, "weight": weight}))
        if out:
            yield pd.concat(out, ignore_index=True)


def _spans(settled, window: int) -> list[tuple[int, int, int]]:
    """(path, first word, words): occurrences that follow each other in the text and on a path are one span."""
    out: list[list[int]] = []
    last = None
    for x in sorted(settled, key=lambda x: x["at"]):
        low, size = _unpack(x["at"])
        if last == (x["path"], x["place"] - 1, low):
            out[-1][2] = low + size - 1 + window - out[-1][1]
        else:
            out.append([x["path"], low, size - 1 + window])
        last = (x["path"], x["place"], low + size)
    return [tuple(x) for x in out]


def _remove(rows: Iterator[pd.DataFrame], window: int, whole: bool) -> Iterator[pd.DataFrame]:
    unpack = zstandard.ZstdDecompressor().decompress
    for batch in rows:
        out = []
        for of, data, settled, starts in zip(*(batch[c] for c in ("of", "words", "settled", "starts")), strict=True):
            words = unpack(data).split()
            edge = np.zeros(len(words) + 1, np.int64)
            spans = _spans(settled, window) if settled is not None else []
            for _, first, n in spans:
                edge[first] += 1
                edge[first + n] -= 1
            if starts is not None:
                np.add.at(edge, np.asarray(starts, np.int64), 1)
                np.add.at(edge, np.asarray(starts, np.int64) + window, -1)
            kept = np.cumsum(edge[:-1]) == 0
            text = b" ".join(compress(words, kept.tolist()))
            shown = text.decode("utf-8", "surrogatepass") if whole else None
            told = [{"path": p, "first": a, "words": n} for p, a, n in spans] if whole else None
            out.append((of, int((~kept).sum()), shown, hashlib.sha256(text).hexdigest(), told))
        yield pd.DataFrame(out, columns=["of", "n_removed", "kept", "kept_sha256", "spans"])


def _spread(df: DataFrame) -> DataFrame:
    """Deal rows out evenly, so that a join above can split its hot keys."""
    return df.repartition(max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))))


def compacted(edges: DataFrame) -> DataFrame:
    """(edge, path, place) for the edges of a graph: edge, left and right (its nodes), text and at (where it was first seen).

    Edges joined by nodes that do not branch are one path; ``place`` counts up to -1 at its
    end. Closed rings without a branch stay in the pieces that the texts gave.
    """
    none = F.lit(None).cast("long")
    sides = edges.select(F.col("right").alias("node"), F.col("edge").alias("into"), none.alias("out")).union(edges.select("left", none, "edge"))
    degrees = sides.groupBy("node").agg(F.count("into").alias("n_in"), F.count("out").alias("n_out"), F.max("into").alias("edge"), F.max("out").alias("next"))
    joints = degrees.where("n_in = 1 AND n_out = 1 AND edge <> next").select("edge", "next")

    # Edges that follow each other where they were first seen need no join.
    order = Window.partitionBy("text").orderBy("at")
    low, size = F.shiftright("at", 8), F.shiftright("at", 1).bitwiseAND(F.lit(127))
    placed = edges.select("edge", "text", "at", (low + size).alias("through")).join(joints, "edge", "left")
    goes_on = F.lag("next").over(order).eqNullSafe(F.col("edge")) & (F.lag("through").over(order) == low)
    heads = placed.withColumn("head", F.when(F.coalesce(goes_on, F.lit(False)), none).otherwise(F.col("edge")))
    pieces = written(heads.withColumn("head", F.last("head", ignorenulls=True).over(order)).select("edge", "text", "at", "next", "head"))

    # The pieces of a path point to the next one; jumps double until all have reached the last.
    chain = pieces.groupBy("head").agg(F.count(F.lit(1)).alias("n"), F.max_by("next", "at").alias("to"))
    state = written(chain.select("head", "to", F.col("n").alias("rest"), F.col("head").alias("path")))
    still = -1
    while (left := state.where("to IS NOT NULL").count()) not in (0, still):
        still = left
        further = state.select(F.col("head").alias("to"), F.col("to").alias("to2"), F.col("rest").alias("rest2"), F.col("path").alias("path2"))
        jumped = state.join(further, "to", "left")
        state = written(jumped.select("head", F.col("to2").alias("to"), (F.col("rest") + F.coalesce("rest2", F.lit(0))).alias("rest"), F.coalesce("path2", "path").alias("path")))
    ring = F.col("to").isNotNull()
    ends = state.join(chain.select("head", "n"), "head").select("head", F.when(ring, F.col("head")).otherwise(F.col("path")).alias("path"), F.when(ring, F.col("n")).otherwise(F.col("rest")).alias("rest"))
    nth = F.row_number().over(Window.partitionBy("text", "head").orderBy("at")) - 1
    return pieces.withColumn("nth", nth).join(ends, "head").select("edge", "path", (F.col("nth") - F.col("rest")).alias("place"))


def shared_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, k: int = EDGE, with_text: bool = True) -> tuple[DataFrame, DataFrame]:
    """(sources, changed): one row per row of ``docs``, and one per distinct sequence of words with removed words.

    sources: row, doc_id, of, n_words, kept_sha256 of all words, grams. changed: of, n_removed,
    kept (the words left, joined by one space), its sha256, and spans (path, first word,
    words) of the repeated edges; kept and spans are null unless ``with_text``. ``of`` names
    the words: 128 bits of their SHA-256.
    """
    if not k < window <= k + 120:
        raise ValueError("an edge must have fewer than 128 windows")
    source = docs.select(F.col(f"`{id_col}`").alias("doc_id"), text_or_empty(text_col).alias("text"))
    id_type = source.schema["doc_id"].dataType.simpleString()
    numbered = source.withColumn("row", F.monotonically_increasing_id())
    sources = written(numbered.mapInPandas(lambda rows: _scan(rows, window, k), f"row long, doc_id {id_type}, of binary, n_words long, kept_sha256 string, grams array<long>"))

    # 1. k-mers seen twice, as places in the list of each distinct text.
    grams = sources.select("row", F.posexplode("grams").alias("place", "gram"))
    twice = _spread(grams.groupBy("gram").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("gram"))
    flagged = grams.join(twice, "gram").groupBy("row").agg(F.collect_set("place").alias("places"))
    classes = sources.groupBy("of").agg(F.min("row").alias("row"), F.min_by("doc_id", "row").alias("rep"), F.least(F.count(F.lit(1)), F.lit(2)).alias("weight"))
    wanted = flagged.join(classes, "row").withColumnsRenamed({"row": "text", "of": "wanted"})
    # One row of each text goes on; equal ids with equal texts are the same row twice.
    same = (F.col("made.of") == F.col("wanted")) & F.col("doc_id").eqNullSafe(F.col("rep"))
    packed = source.select("doc_id", F.pandas_udf(_packed, "of binary, words binary")("text").alias("made"))
    texts = written(packed.join(wanted, same).select("text", F.col("made.of").alias("of"), F.col("made.words").alias("words"), "places", "weight"))

    # 2. Edges seen twice, and the paths they make.
    edge_kind = "digest binary, gram long, left long, right long, text long, at long, weight long"
    runs = written(texts.mapInPandas(lambda rows: _edge_rows(rows, window, k), edge_kind))
    seen = runs.groupBy("digest").agg(
        F.sum("weight").alias("n"), F.count(F.lit(1)).alias("sources"), F.min(F.struct("text", "at")).alias("lead"),
        *(F.first(c).alias(c) for c in ("gram", "left", "right")),
    )
    edges = written(seen.where("n > 1").select(F.monotonically_increasing_id().alias("edge"), "digest", "sources", "lead.text", "lead.at", "gram", "left", "right"))
    paths = compacted(edges.select("edge", "left", "right", "text", "at"))

    # 3. All their occurrences are settled. Where a k-mer also occurs in an edge seen once, the first source speaks.
    all_of = runs.groupBy("gram").agg(F.count(F.lit(1)).alias("all"))
    mixed = edges.groupBy("gram").agg(F.sum("sources").alias("settled")).join(all_of, "gram").where("settled < all").select("gram", F.lit(1).cast("long").alias("speaks"))
    known = edges.join(paths, "edge").join(mixed, "gram", "left").select("digest", F.col("text").alias("lead"), F.col("at").alias("lead_at"), "path", "place", "speaks")
    found = runs.select("digest", "text", "at").join(_spread(known), "digest")
    speaks = F.when((F.col("text") == F.col("lead")) & (F.col("at") == F.col("lead_at")), F.coalesce("speaks", F.lit(0))).otherwise(F.lit(0)).cast("long")
    span = F.struct(F.col("at").bitwiseOR(speaks).alias("at"), "path", "place")
    settled = written(found.groupBy("text").agg(F.collect_set(span).alias("settled")))

    # 4. The windows beside branches are compared one by one.
    open_texts = texts.join(settled, "text", "left").select("text", "words", "places", "weight", "settled")
    windows = written(open_texts.mapInPandas(lambda rows: _window_rows(rows, window, k), "digest binary, text long, start long, weight long"))
    again = _spread(windows.groupBy("digest").agg(F.sum("weight").alias("n")).where("n > 1").select("digest"))
    starts = windows.join(again, "digest").groupBy("text").agg(F.collect_set("start").alias("starts"))

    touched = texts.select("text", "of", "words").join(settled.join(starts, "text", "full"), "text").select("of", "words", "settled", "starts")
    changed = touched.mapInPandas(lambda rows: _remove(rows, window, with_text), "of binary, n_removed long, kept string, kept_sha256 string, spans array<struct<path:long,first:long,words:long>>")
    return sources, changed


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, k: int = EDGE) -> DataFrame:
    """doc_id, n_words, n_removed and the sha256 of the words left, one row per row of ``docs``."""
    sources, changed = shared_passages(docs, id_col, text_col, window, k, with_text=False)
    less = changed.dropDuplicates(["of"]).select("of", "n_removed", F.col("kept_sha256").alias("less"))
    out = sources.drop("grams").join(_spread(less), "of", "left")
    return out.select("doc_id", "n_words", F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"), F.coalesce("less", "kept_sha256").alias("kept_sha256"))

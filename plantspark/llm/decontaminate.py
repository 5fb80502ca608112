"""Benchmark decontamination by Wu-Manber search over words.

A pattern is a window of 13 consecutive words of a benchmark item, or the whole of a shorter
item. Patterns of similar length form one machine: ``m`` is its shortest length, a block is
two neighbouring words (one where m is 1). The shift table says how far the search may jump
when it reads a block at the end of the current m words: m - 1 for a block that no pattern
has there. Where the shift is zero, the bucket of that suffix block, narrowed by the first
word, gives the patterns that are then compared word by word.

The benchmark without its repeated rows is cut into blocks of bounded size. Each block is
one broadcast. A benchmark of one block is searched in the plan that reads the documents; of
several, one pass after the other adds its hits to a written table of the documents, and only
one block lives on the driver at a time. No pair of document and item is made.

Edge cases: a null text has no words; items without words are ignored; repeated items and
windows count once per item id (a null id counts as the text ``null``); empty tables give
no hits; input columns named like an output are replaced.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache
from math import ceil

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, text_or_empty, with_fields

WINDOW = 13
#: Benchmark bytes per broadcast; a larger benchmark is searched in several blocks.
BLOCK_BYTES = 8 << 20
#: Patterns of one machine: a short pattern must not spoil the jumps of the long ones.
LENGTHS = ((13, 1 << 30), (7, 12), (4, 6), (2, 3), (1, 1))
_WORDS = re.compile(rb"[0-9a-z\x80-\xff]+").findall


def words_of(text: str) -> list[bytes]:
    """A-Z in lower case, then runs of 0-9, a-z and characters beyond ASCII."""
    return _WORDS(text.encode("utf-8", "surrogatepass").lower())


class Machine:
    """Shift and bucket tables of patterns whose shortest has ``m`` words."""

    def __init__(self, patterns: dict[tuple[bytes, ...], set[str]]):
        self.m = m = min(map(len, patterns))
        self.items = patterns
        self.width = width = min(2, m)
        self.shift: dict = {}
        self.buckets: dict = defaultdict(lambda: defaultdict(list))
        for p in patterns:
            for end in range(width, m + 1):
                block = p[end - width : end] if width == 2 else p[0]
                self.shift[block] = min(self.shift.get(block, m), m - end)
            self.buckets[p[m - width : m] if width == 2 else p[0]][p[0]].append(p)
        self.buckets = {block: dict(firsts) for block, firsts in self.buckets.items()}

    def search(self, words: list[bytes], found: dict[int, int], items: set[str]) -> None:
        """Put {start: longest length} of the occurrences into ``found``, their items into ``items``."""
        m, shift, buckets, n = self.m, self.shift.get, self.buckets, len(words)
        if self.width == 1:
            ends = [i for i, w in enumerate(words) if w in buckets]
        else:
            ends, i, far = [], m - 1, m - 1
            while i < n:
                jump = shift((words[i - 1], words[i]), far)
                if not jump:
                    ends.append(i)
                    jump = 1
                i += jump
        for end in ends:
            start = end - m + 1
            block = (words[end - 1], words[end]) if self.width == 2 else words[end]
            for p in buckets[block].get(words[start], ()):
                if tuple(words[start : start + len(p)]) == p:
                    found[start] = max(found.get(start, 0), len(p))
                    items |= self.items[p]


def machines(items: list[tuple[str, str]], window: int = WINDOW) -> list[Machine]:
    patterns: dict[tuple[bytes, ...], set[str]] = defaultdict(set)
    for item, text in items:
        words = words_of(text)
        for start in range(max(1, len(words) - window + 1) if words else 0):
            patterns[tuple(words[start : start + window])].add(item)
    groups = [{p: ids for p, ids in patterns.items() if low <= len(p) <= high} for low, high in LENGTHS]
    return [Machine(g) for g in groups if g]


def spans_of(found: dict[int, int]) -> list[int]:
    """Disjoint hit spans as start, end, start, end, ..."""
    out: list[int] = []
    for start in sorted(found):
        end = start + found[start]
        if out and start <= out[-1]:
            out[-1] = max(out[-1], end)
        else:
            out += [start, end]
    return out


@lru_cache(maxsize=1)
def _built(key: tuple, window: int) -> list[Machine]:
    return machines(list(key), window)


def blocks_of(benchmark: DataFrame, id_col: str, text_col: str, block_bytes: int) -> Iterator[list[tuple[str, str]]]:
    """The distinct rows of the benchmark in parts of about ``block_bytes``, which bound what the driver and a task hold at a time."""
    items = benchmark.select(F.coalesce(F.col(id_col).cast("string"), F.lit("null")).alias("item"), text_or_empty(text_col).alias("text")).distinct()
    size = items.agg(F.sum(F.octet_length("item") + F.octet_length("text"))).first()[0] or 0
    parts = max(1, ceil(size / block_bytes))
    part = F.pmod(F.xxhash64("item", "text"), F.lit(parts))
    for k in range(parts):
        yield sorted((r.item, r.text) for r in (items.where(part == k) if parts > 1 else items).collect())


def contamination(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Add ``n_words``, ``n_hit``, ``hit_spans`` (word positions), ``items`` (sorted as strings), ``contaminated``."""
    sc = docs.sparkSession.sparkContext
    text = text_or_empty(text_col)
    kind = "n_words long, hit_spans array<int>, items array<string>"
    made: Column = F.struct(F.lit(0).cast("long").alias("n_words"), F.array().cast("array<int>").alias("hit_spans"), F.array().cast("array<string>").alias("items"))
    held, broadcast = "__llm_hits", None
    for block in blocks_of(benchmark, item_id, item_text, block_bytes):
        if broadcast is not None:  # another block follows: write what the last one found
            docs = cut(docs.withColumn(held, made))
            made = F.col(held)
            broadcast.destroy()
        broadcast = sc.broadcast(tuple(block))
        made = _searched(broadcast, window, kind)(text, made["hit_spans"], made["items"])
    docs = docs.withColumn(held, made)
    made = F.col(held)
    out = with_fields(docs, made, ["n_words", "hit_spans", "items"], drop=("n_hit", "contaminated", held))
    hit = F.aggregate(F.sequence(F.lit(0), F.size("hit_spans") - 1), F.lit(0).cast("long"), lambda s, i: s + F.get("hit_spans", i) * F.when(i % 2 == 0, -1).otherwise(1))
    out = out.withColumn("n_hit", F.when(F.size("hit_spans") > 0, hit).otherwise(F.lit(0)).cast("long"))
    return out.withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))


def _searched(block, window: int, kind: str):
    def run(texts: pd.Series, spans: pd.Series, items: pd.Series) -> pd.DataFrame:
        tables = _built(block.value, window)
        rows = []
        for text, before, ids in zip(texts, spans, items, strict=True):
            words = words_of(text)
            found: dict[int, int] = {}
            hits = set(ids)
            for start, end in np.reshape(before, (-1, 2)).tolist():
                found[start] = end - start
            for machine in tables:
                machine.search(words, found, hits)
            rows.append((len(words), spans_of(found), sorted(hits)))
        return pd.DataFrame(rows, columns=["n_words", "hit_spans", "items"])

    return F.pandas_udf(run, kind)

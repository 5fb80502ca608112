"""Prefix trie of conversations by vertical bitmaps.

A shard holds ``width`` neighbouring conversation ids. Its index maps (position, turn) to
the bitset of the ids that have this turn there, and (position, end) to those that end
there. A node is the bitset of its members: intersecting it with the postings of the next
position gives its children, counting bits its size, and intersecting it with the ends the
ids that stop at it. The walk is depth-first within a block of positions; the open bitsets
go on into the next block, so neither long conversations nor many fill a task.

Nodes of different shards are the same when their paths are: a path is named by the SHA-256
of its parent's name and its turn's SHA-256, so the texts never leave the first scan. Sizes,
children and least ids are summed by path. Sums over subtrees come from doubling jumps over
the shared nodes alone (a node with one member has one leaf and saves nothing): after k
rounds a node has what lies less than 2^k below it. The list of the ids that end at a node is
hashed in the order of the shards, a piece at a time.

Edge cases: turns are ordered by ``turn``, null first, equal ones by their digest; a null
role or text is empty; rows without a conversation id take no part; a conversation without
turns ends at the root; an empty table gives no rows; columns besides the four are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, written

#: Ids of one shard, the bits of a bitset.
WIDTH = 256
#: Postings read before a walk goes on, plus those of one position.
BLOCK = 50_000

ROOT = hashlib.sha256(b"").digest()
_NODES = "path binary, parent binary, depth int, tokens long, conv_id long, n long, shard long, ends array<long>"


def turns(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv_id, position from 0, digest of (role, text), tokens of the text."""
    role, text = (F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in (role_col, text_col))
    # The length keeps (role, text) apart from any other split of the same characters.
    digest = F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256))
    tokens = F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long")
    rows = conversations.select(F.col(f"`{conv_col}`").cast("long").alias("conv_id"), F.col(f"`{turn_col}`").alias("turn"), digest.alias("digest"), tokens.alias("tokens"))
    place = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "digest")) - 1
    return rows.where("conv_id IS NOT NULL").select("conv_id", place.alias("position"), "digest", "tokens")


def branched(rows: DataFrame, every: int = 20, most: int = 4) -> DataFrame:
    """Rebuild every conversation c on the first h turns of c - c % every; h = crc32(c) % most.

    The result has one more row per conversation, with a null digest, at the position after its last turn.
    """
    of = (F.col("conv_id") - F.col("conv_id") % every).alias("base")
    lengths = rows.groupBy("conv_id").agg((F.max("position") + 1).alias("length"))
    lengths = lengths.withColumn("h", (F.crc32(F.col("conv_id").cast("string").cast("binary")) % most).cast("int")).withColumn("base", of)
    head = rows.where(F.col("conv_id") % every == 0).where(F.col("position") < most - 1)
    first = head.groupBy(F.col("conv_id").alias("base")).agg(F.array_sort(F.collect_list(F.struct("position", "digest", "tokens"))).alias("first"))
    # At most most - 1 turns of a base go to at most every conversations.
    based = lengths.join(first, "base", "left")
    based = based.select("conv_id", "length", "h", F.coalesce(F.slice("first", F.lit(1), F.col("h")), F.expr("cast(array() as array<struct<position:int,digest:binary,tokens:bigint>>)")).alias("first"))
    n_first = F.size("first")
    own_end = F.greatest(F.col("length") - F.col("h"), F.lit(0)) + n_first
    end = F.array(F.struct(own_end.alias("position"), F.lit(None).cast("binary").alias("digest"), F.lit(0).cast("long").alias("tokens")))
    given = based.select("conv_id", F.explode(F.concat("first", end)).alias("t")).select("conv_id", "t.*")
    own = rows.join(based.select("conv_id", "h", n_first.alias("n_first")), "conv_id").where("position >= h")
    own = own.select("conv_id", (F.col("position") - F.col("h") + F.col("n_first")).alias("position"), "digest", "tokens")
    return given.unionByName(own)


class _Walk:
    """The walk over one shard: ``read`` takes postings in order of position."""

    def __init__(self, shard: int, width: int):
        self.shard, self.low = shard, shard * width
        self.rows: list[tuple] = []
        self.block: dict[int, tuple[dict[int, int], list, int]] = {}
        self.n, self.open, self.started = 0, [], False

    def read(self, position: int, digest: bytes | None, tokens: int, ids: list[int]) -> None:
        if position not in self.block:
            if self.n >= BLOCK:
                self.go()
            self.block[position] = ({}, [], 0)
        at, postings, ends = self.block[position]
        bits = 0
        for i in ids:
            bits |= 1 << (i - self.low)
        self.n += 1
        if digest is None:
            self.block[position] = (at, postings, bits)
            return
        for i in ids:
            at[i - self.low] = len(postings)
        postings.append((bits, bytes(digest), tokens))

    def go(self) -> None:
        """Depth-first through the block; what is open at its end waits for the next one."""
        if not self.started:
            # Every id of the shard has a turn or its end at position 0.
            _, postings, members = self.block[0]
            for bits, _, _ in postings:
                members |= bits
            self.open, self.started = [(ROOT, None, 0, 0, members)], True
        last = max(self.block, default=-1)
        waiting = []
        stack = self.open[::-1]
        while stack:
            path, parent, depth, tokens, members = stack.pop()
            if depth > last:
                waiting.append((path, parent, depth, tokens, members))
                continue
            at, postings, ends = self.block.get(depth, ({}, [], 0))
            self.emit(path, parent, depth, tokens, members, members & ends)
            rest = members & ~ends
            children = []
            while rest:
                bits, digest, tokens_of = postings[at[(rest & -rest).bit_length() - 1]]
                child = members & bits
                rest &= ~child
                children.append((hashlib.sha256(path + digest).digest(), path, depth + 1, tokens_of, child))
            stack.extend(reversed(children))
        self.open, self.block, self.n = waiting, {}, 0

    def emit(self, path: bytes, parent: bytes | None, depth: int, tokens: int, members: int, ends: int) -> None:
        ids = []
        while ends:
            low = ends & -ends
            ids.append(self.low + low.bit_length() - 1)
            ends ^= low
        self.rows.append((path, parent, depth, tokens, self.low + (members & -members).bit_length() - 1, members.bit_count(), self.shard, ids or None))


def _walked(batches: Iterator[pd.DataFrame], width: int) -> Iterator[pd.DataFrame]:
    """Postings arrive sorted by (shard, position); a shard may go on in the next batch."""
    names = [c.split()[0] for c in _NODES.split(", ")]
    walk: _Walk | None = None
    for batch in batches:
        done: list[tuple] = []
        columns = (batch[c].tolist() for c in ("shard", "position", "digest", "tokens"))
        for shard, position, digest, tokens, ids in zip(*columns, (x.tolist() for x in batch["ids"]), strict=True):
            if walk is None or walk.shard != shard:
                if walk is not None:
                    walk.go()
                    done += walk.rows
                walk = _Walk(shard, width)
            walk.read(position, digest, tokens, ids)
        if walk is not None:
            done += walk.rows
            walk.rows = []
        yield pd.DataFrame(done, columns=names)
    if walk is not None:
        walk.go()
        yield pd.DataFrame(walk.rows, columns=names)


def postings(rows: DataFrame, width: int = WIDTH) -> DataFrame:
    """(shard, position, digest) to the ids, at most ``width`` of a shard; a null digest marks the ends."""
    shard = F.expr(f"(conv_id - pmod(conv_id, {width})) div {width}")
    indexed = rows.groupBy(shard.alias("shard"), "position", "digest").agg(F.max("tokens").alias("tokens"), F.collect_list("conv_id").alias("ids"))
    return indexed.repartition("shard").sortWithinPartitions("shard", "position")


def shard_nodes(rows: DataFrame, width: int = WIDTH) -> DataFrame:
    """The nodes of each shard's own trie, with its members counted and the ids that end there."""
    return postings(rows, width).mapInPandas(lambda b: _walked(b, width), _NODES)


def _hashed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Pieces arrive sorted by (path, shard); only the running digest of one list is held."""
    path, running = None, None
    for batch in batches:
        out = []
        for p, ids in zip(batch["path"], batch["ends"], strict=True):
            piece = ",".join(map(str, ids.tolist())).encode()
            if p != path:
                if running is not None:
                    out.append((path, running.hexdigest()))
                path, running = p, hashlib.sha256(piece)
            else:
                running.update(b"," + piece)
        yield pd.DataFrame(out, columns=["path", "ends_sha256"])
    if running is not None:
        yield pd.DataFrame([(path, running.hexdigest())], columns=["path", "ends_sha256"])


def ends(nodes: DataFrame) -> DataFrame:
    """(path, ends_sha256) for the nodes where conversations end; few pieces of at most one shard's ids each."""
    pieces = nodes.where("ends IS NOT NULL").select("path", "shard", "ends")
    ordered = pieces.repartition("path").sortWithinPartitions("path", "shard")
    return ordered.mapInPandas(_hashed, "path binary, ends_sha256 string")


def _null_or(column: str, value: Column) -> Column:
    return F.coalesce(F.col(column), value)


def _subtrees(shared: DataFrame) -> DataFrame:
    """Sum ``leaves`` and ``saved`` over the subtree of each shared node by doubling jumps (path, parent)."""
    state = written(shared.select("path", F.col("parent").alias("jump"), "leaves", "saved"))
    while not state.where("jump IS NOT NULL").isEmpty():
        gains = state.where("jump IS NOT NULL").groupBy(F.col("jump").alias("path")).agg(F.sum("leaves").alias("more_leaves"), F.sum("saved").alias("more_saved"))
        summed = state.join(gains, "path", "left").select("path", "jump", (F.col("leaves") + _null_or("more_leaves", F.lit(0))).alias("leaves"), (F.col("saved") + _null_or("more_saved", F.lit(0))).alias("saved"))
        further = state.select(F.col("path").alias("jump"), F.col("jump").alias("next"))
        state = written(summed.join(further, "jump", "left").select("path", F.col("next").alias("jump"), "leaves", "saved"))
    return state.select("path", F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"))


def trie(rows: DataFrame, width: int = WIDTH) -> DataFrame:
    """One row per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256, path, parent.

    ``rows`` is like the result of ``branched``: conv_id, position, digest, tokens, and an end row per conversation.
    """
    found = cut(shard_nodes(rows, width))
    nodes = found.groupBy("path").agg(
        F.first("parent").alias("parent"), F.first("depth").alias("depth"), F.max("tokens").alias("tokens"),
        F.min("conv_id").alias("conv_id"), F.sum("n").alias("n_convs"),
    )
    nodes = written(nodes)
    single = F.col("n_convs") == 1
    below = nodes.where("parent IS NOT NULL").groupBy(F.col("parent").alias("path")).agg(F.count(F.lit(1)).alias("n_children"), F.count(F.when(single, 1)).alias("lone"))
    listed = nodes.join(below, "path", "left").join(ends(found), "path", "left")
    listed = written(listed.withColumns({"n_children": _null_or("n_children", F.lit(0)), "lone": _null_or("lone", F.lit(0)), "ends_sha256": _null_or("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest()))}))
    # A lone child has one leaf below it and saves nothing: it counts at its parent.
    own = F.col("lone") + F.when(F.col("n_children") == 0, 1).otherwise(0)
    shared = listed.where(~single).select("path", "parent", own.alias("leaves"), ((F.col("n_convs") - 1) * F.col("tokens")).alias("saved"))
    sums = _subtrees(shared)
    parents = nodes.where(F.col("n_convs") >= 1).select(F.col("path").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    out = listed.join(sums, "path", "left").join(parents, "parent", "left")
    return out.select(
        "conv_id", F.col("depth").cast("long").alias("depth"), "parent_conv_id", "n_convs", "n_children",
        _null_or("n_leaves", F.lit(1)).cast("long").alias("n_leaves"), _null_or("saved_tokens", F.lit(0)).cast("long").alias("saved_tokens"), "ends_sha256", "path", "parent",
    )

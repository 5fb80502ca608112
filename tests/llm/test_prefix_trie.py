"""The prefix trie against a dictionary of rebuilt conversations."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from plantspark.llm import prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def brute_force(rows):
    said = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            said.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    digest = lambda t: hashlib.sha256(f"{len(t[2].encode())}:{t[2]}{t[3]}".encode()).digest()
    said = {c: [t[2:] for t in sorted(ts, key=lambda t: (t[:2], digest(t)))] for c, ts in said.items()}
    built = {}
    for c, own in said.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = c - (c % 20 if c >= 0 else -(-c % 20))
        built[c] = tuple(said.get(base, [])[:h] + own[h:])
    members = {}
    for c, ts in built.items():
        for d in range(len(ts) + 1):
            members.setdefault(ts[:d], []).append(c)
    children = {}
    for node in members:
        if node:
            children.setdefault(node[:-1], []).append(node)
    sums = {}
    for node in sorted(members, key=len, reverse=True):
        below = [sums[x] for x in children.get(node, [])]
        own = (len(members[node]) - 1) * len(node[-1][1].encode().split()) if node else 0
        sums[node] = (sum(x for x, _ in below) or 1, sum(x for _, x in below) + own)
    out = []
    for node, who in members.items():
        stop = ",".join(str(c) for c in sorted(who) if built[c] == node)
        parent = min(members[node[:-1]]) if node else None
        out.append((min(who), len(node), parent, len(who), len(children.get(node, [])), *sums[node], hashlib.sha256(stop.encode()).hexdigest()))
    return sorted(out, key=repr)


def result(spark, rows, width=prefix_trie.WIDTH):
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    df = df.withColumns({c: F.lit(-1) for c in ("position", "digest", "tokens", "path", "parent", "base", "h", "first", "n")})
    out = prefix_trie.trie(prefix_trie.branched(prefix_trie.turns(df)), width)
    return sorted(map(tuple, out.select(*COLUMNS).collect()), key=repr)


def conversations(seed=3):
    rng = random.Random(seed)
    rows = []
    for c in [*range(90), 1000, 1007, -3, -20, -21]:
        for turn in range(rng.randint(1, 6)):
            rows.append((c, turn, rng.choice(["user", "assistant"]), rng.choice(["a b", "c", "d e f"]) if turn < 3 else f"t{rng.randint(0, 3)} x"))
    rows += [(200 + i, t, "user", f"same {t}") for i in range(30) for t in range(40)]  # a long group of copies
    rows += [(300, None, None, None), (300, 1, "user", ""), (300, 1, "", "user"), (300, 1, "user", ""), (301, None, "a", "b"), (301, None, "a", "b")]
    rows += [(None, 0, "user", "lost"), (320, 0, "user", "Ünï 🎉 " * 3), (321, 0, "us", "er x")]
    return rows


@pytest.mark.parametrize(("width", "block"), [(256, 50_000), (8, 5), (1, 1)])
def test_trie_equals_brute_force(spark, monkeypatch, width, block):
    monkeypatch.setattr(prefix_trie, "BLOCK", block)
    rows = conversations()
    assert result(spark, rows, width) == brute_force(rows)


def test_block_walk_is_the_same_in_one_process():
    """The walk of one shard with blocks of one position, where workers cannot see a changed constant."""
    def run(block):
        prefix_trie.BLOCK, before = block, prefix_trie.BLOCK
        try:
            walk = prefix_trie._Walk(0, 8)
            for position in range(5):
                for k in range(3):
                    walk.read(position, hashlib.sha256(b"%d" % (k if position < 2 else 0)).digest(), 2, [k, k + 3])
            walk.read(5, None, 0, list(range(6)))
            walk.go()
        finally:
            prefix_trie.BLOCK = before
        return sorted(walk.rows, key=repr)

    assert run(1) == run(50_000)


def test_turnless_conversations_end_at_the_root(spark):
    """No base and one turn inside the first h: nothing is left of it."""
    lone = next(c for c in range(21, 40) if zlib.crc32(str(c).encode()) % 4 > 0)
    rows = [(lone, 0, "user", "x")]
    assert result(spark, rows) == brute_force(rows) == [(lone, 0, None, 1, 0, 1, 0, hashlib.sha256(str(lone).encode()).hexdigest())]


def test_no_conversations(spark):
    assert result(spark, []) == []

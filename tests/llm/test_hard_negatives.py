"""Hard negatives against all inner products."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from plantspark.llm import hard_negatives as hn

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute_force(rows, every=100, positives=5, negatives=10):
    kept = []
    for i, v, label in rows:
        if label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        label = (label + 1) % 10 if i is not None and i % 7 == 0 else label
        kept.append((i, [math.floor(256 * float(np.float32(x))) for x in v], label))
    score = lambda a, b: sum(x * y for x, y in zip(a, b, strict=False))
    out = []
    for at, (a, v, label) in enumerate(kept):
        if a is None or a % every:
            continue
        rest = [(score(v, w), i, m) for k, (i, w, m) in enumerate(kept) if k != at]
        rest.sort(key=lambda r: (-r[0], r[1] is None, r[1] or 0))
        for p, i, _ in [r for r in rest if r[2] == label][:positives]:
            fit = [r for r in rest if r[2] != label and 30 * p <= 100 * r[0] <= 90 * p]
            out += [(a, i, k + 1, j, p, n) for k, (n, j, _) in enumerate(fit[:negatives])]
    return sorted(out, key=repr)


def result(spark, rows, every=100):
    df = spark.createDataFrame(rows, SCHEMA).repartition(3).withColumns({c: F.lit(-1) for c in ("id", "vector", "score", "search", "rank", "copies")})
    label = F.col("label").cast("long")
    own = hn.prepared(df, relabel=F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label))
    out = hn.mine(own, own.where(f"id % {every} = 0")).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
    return sorted(map(tuple, out.collect()), key=repr)


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(5)
    middle = rng.normal(size=(6, 12))
    made = middle[rng.integers(0, 6, 600)] + rng.normal(size=(600, 12)) * 0.7
    out = [(i, [float(x) for x in v / np.linalg.norm(v)], int(rng.integers(0, 4))) for i, v in enumerate(made)]
    out += [(1000 + i, out[100][1], i % 3) for i in range(40)]  # many copies of an anchor: ties
    out += [out[200], out[200], out[300]]  # repeated rows
    out += [(200, out[5][1], out[200][2]), (None, out[9][1], 2), (None, out[9][1], 1)]
    out += [(2100, [0.0] * 12, 1), (2200, [-x for x in out[0][1]], 3), (2300, None, 1), (2400, out[1][1], None), (2500, [1.0, None], 1), (2600, [float("nan")] * 12, 1), (2700, [float("inf")] * 12, 1)]
    return out + [(2800, [0.5, 0.5], 2), (2900, [], 2), (3000, [300.0, -200.0] + [1e3] * 12, 2)]


def test_search_equals_brute_force(spark, rows):
    assert result(spark, rows) == brute_force(rows)


def test_many_chunks_give_the_same(spark, rows, monkeypatch):
    monkeypatch.setattr(hn, "CHUNK_BYTES", 2000)
    monkeypatch.setattr(hn, "PER_CENTRE", 2)
    assert result(spark, rows) == brute_force(rows)


def test_walk_stops_early_and_stays_exact(monkeypatch):
    """Tight groups: most of each list is never scored."""
    monkeypatch.setattr(hn, "STRIDE", 32)
    rng = np.random.default_rng(1)
    middle = np.eye(24)[:12]
    x = np.floor(256 * (np.repeat(middle, 300, 0) + rng.normal(size=(3600, 24)) * 0.02)).astype(np.int64)
    ids, labels, none = np.arange(3600), np.zeros(3600, np.int64), np.zeros(3600, bool)
    at = np.arange(0, 3600, 30)
    anchors = hn.Anchors(ids[at], labels[at], x[at])
    low, high = np.iinfo(np.int64).min, np.iinfo(np.int64).max
    searches = hn.Searches(np.arange(len(at)), np.full(len(at), low), np.full(len(at), high), 5, True)
    made = hn.walk(anchors, searches, ids, none, labels, x)
    assert made < 0.4 * len(at) * len(x)
    scores = x[at] @ x.T
    for k, a in enumerate(at):
        order = [i for i in np.lexsort((ids, -scores[k])) if i != a][:5]
        got = searches.rows().query("search == @k")
        assert list(got["id"]) == order and list(got["score"]) == [scores[k, i] for i in order]


def test_nothing_to_search(spark):
    assert result(spark, []) == []
    assert result(spark, [(1, [1.0], 1)]) == []
    assert result(spark, [(100, [1.0], 1)]) == []

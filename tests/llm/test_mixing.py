"""Mixing: targets against a plain water level, choices against the method written out."""

import math

import pytest
from pyspark.sql import functions as F

from plantspark.llm import mixing

from .samples import frame, rows


def level(sizes, weights=(1, 2, 3), most=3):
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total, full = sum(sizes.values()), set()
    while True:
        left = sum(w for s, w in weight.items() if s not in full)
        share = (total - sum(most * sizes[s] for s in full)) / left if left else 0
        new = {s for s in sizes if s in full or most * sizes[s] <= share * weight[s]}
        if new == full:
            return {s: most * sizes[s] if s in full else share * weight[s] for s in sizes}
        full = new


def brute_force(table, large=mixing.LARGE):
    """(source, hash) to copies, for documents (source, hash, id, size) without repeated rows."""
    by = {}
    for row in table:
        by.setdefault(row[0], []).append(row)
    goal = level({s: sum(r[3] for r in rs) for s, rs in by.items()})
    out = {}
    for s, rs in by.items():
        size = sum(r[3] for r in rs)
        expected = min(3.0, goal[s] / size) if size else 0.0
        whole = math.floor(expected + 1e-9)
        p = max(expected - whole, 0.0)
        out |= {(s, r[1]): whole for r in rs}
        if not p:
            continue
        uniform = lambda h: (((h & (1 << 64) - 1) >> 11) + 0.5) * 2.0**-53
        place = {r[1]: (q := uniform(r[1]) / (1 - uniform(r[1])) * (1 - p) / p) / (1 + q) for r in rs}
        ranked = sorted((r for r in rs if r[3]), key=lambda r: (place[r[1]], r[1]))
        big, small = ([r for r in ranked if (r[3] * large > size) is x] for x in (True, False))
        room = max(round(goal[s]) - whole * size, 0)
        quota = max(room - round(sum(r[3] * p for r in small)), 0)
        for r in big:
            if r[3] <= quota:
                quota -= r[3]
                room -= r[3]
                out[s, r[1]] += 1
        left = [r for r in big if out[s, r[1]] == whole]
        if not small and left and 2 * quota > min(r[3] for r in left):
            out[s, min(left, key=lambda r: (r[3], place[r[1]], r[1]))[1]] += 1
        for r in small:
            if r[3] > room:
                break
            room -= r[3]
            out[s, r[1]] += 1
    return goal, out


def documents(spark, clash=True):
    pairs = [(i, t) for i, t in dict(rows(n=200)).items()]
    df = frame(spark, pairs, clash)
    of = F.when(F.col("doc_id") % 11 == 0, None).when(F.col("doc_id") % 3 == 0, "b").when(F.col("doc_id") % 50 == 1, "tiny").when(F.col("doc_id") == 7, "ünï").otherwise("a")
    return df.withColumn("source", of)


@pytest.mark.parametrize("large", [1000, 5, 1])
def test_mix_equals_brute_force(spark, monkeypatch, large):
    monkeypatch.setattr(mixing, "LARGE", large)
    got = mixing.mix(documents(spark)).collect()
    goal, copies = brute_force([(r.source, r.hash, r.doc_id, r["size"]) for r in got], large)
    assert {(r.source, r.hash): r.copies for r in got} == copies
    assert all(r.target == pytest.approx(goal[r.source]) and r.taken == r.copies * r["size"] <= 3 * r["size"] for r in got)
    assert len(got) == documents(spark).count()


def test_targets_are_reached_and_reruns_agree(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    first = sorted(map(tuple, mixing.mix(docs).collect()), key=repr)
    again = sorted(map(tuple, mixing.mix(docs.repartition(7)).collect()), key=repr)
    assert first == again
    by = {}
    for _, source, _, _, size, target, _, taken in first:
        by.setdefault(source, [size, target, 0])[2] += taken
    assert all(abs(taken - target) <= 0.01 * target for _, target, taken in by.values())


def test_preferred_documents_are_taken_more_often(spark):
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("w " * 10).alias("text"), F.when(F.col("id") < 1000, "a").when(F.col("id") < 3000, "b").otherwise("c").alias("source"), (F.col("id") % 4).alias("liked"))
    got = mixing.mix(docs, weight_col="liked")
    sums = {(r.source, r.liked): r.n for r in got.groupBy("source", (F.col("doc_id") % 4).alias("liked")).agg(F.avg("copies").alias("n")).collect()}
    assert all(sums[s, 0] == 0 for s in "abc") and sums["b", 1] < sums["b", 2] < sums["b", 3]
    whole = {r.source: (r.taken, r.target) for r in got.groupBy("source").agg(F.sum("taken").alias("taken"), F.first("target").alias("target")).collect()}
    assert all(abs(taken - target) <= 10 or taken == pytest.approx(3 * 10 * 0.75 * n) for (taken, target), n in ((whole[s], n) for s, n in (("a", 1000), ("b", 2000), ("c", 1000))))


def test_mixed_repeats_rows(spark):
    base = frame(spark, [(i, f"w{i % 5} " * (1 + i % 4)) for i in range(60)] + [(3, "w3 " * 4)] * 5 + [(None, "x y")] * 3)
    docs = base.withColumn("source", F.when(F.col("doc_id") < 30, "a").otherwise("b"))
    plan = {(r.doc_id, r.hash): r.n for r in mixing.mix(docs).groupBy("doc_id", "hash").agg(F.sum("copies").alias("n")).collect()}
    out = mixing.mixed(docs)
    assert out.columns == docs.columns
    assert out.count() == sum(plan.values())


def test_empty_and_wordless(spark):
    assert mixing.mix(frame(spark, [])).count() == 0
    got = mixing.mix(frame(spark, [(1, None), (2, " "), (None, None)])).collect()
    assert len(got) == 3 and all((r["size"], r.target, r.taken) == (0, 0.0, 0) for r in got)

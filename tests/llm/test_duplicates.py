"""SimHash, repeated passages, the pipeline."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from plantspark.llm import simhash, substring_dedup
from plantspark.llm.common import cut

from .samples import answer, frame, rows


@pytest.fixture(scope="module", autouse=True)
def shipped(spark):
    from plantspark.session import ship

    ship(spark)


def fingerprint(text):
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if x]
    if not w:
        return 0
    grams = [" ".join(w)] if len(w) < 3 else [" ".join(w[i : i + 3]) for i in range(len(w) - 2)]
    hashes = [xxhash.xxh64(g.encode(), seed=42).intdigest() for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups(prints, distance=3):
    """Representative index per row, by brute force."""
    parent = list(range(len(prints)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(prints)):
        for b in range(a):
            if (prints[a] ^ prints[b]).bit_count() <= distance:
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return [find(i) for i in range(len(prints))]


def test_fingerprints_and_components(spark):
    pairs = rows()
    prints = cut(simhash.fingerprints(frame(spark, pairs, clash=True)).select("doc_id", "fingerprint", "fp", "root"))
    expected = [fingerprint(t) for _, t in pairs]
    root = groups(expected)
    least = {}
    for (i, _), r in zip(pairs, root, strict=True):
        least[r] = min((x for x in (least.get(r), i) if x is not None), default=None)
    found = simhash.clustered(prints).select("doc_id", simhash.as_hex(F.col("fingerprint")), "component_id")
    assert answer(found) == sorted(((i, f"{f:016x}", least[r]) for (i, _), f, r in zip(pairs, expected, root, strict=True)), key=repr)


@pytest.mark.parametrize("tile", [1000, 3])
def test_links_find_every_close_pair(spark, tile):
    rng = random.Random(2)
    centres = [rng.getrandbits(64) for _ in range(8)]
    prints = list({c ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 5))) for c in centres for _ in range(40)})
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    df = spark.createDataFrame([(p,) for p in signed], "fp long").repartition(3)
    roots = dict(simhash.components(simhash.links(df, tile=tile)).collect())
    expected = groups(prints)
    mine = [roots.get(p, p) for p in signed]
    for a in range(len(prints)):
        for b in range(a):
            assert (mine[a] == mine[b]) == (expected[a] == expected[b])


def test_components_of_a_chain(spark):
    n = 40
    edges = spark.range(n).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    assert {r.root for r in simhash.components(edges).collect()} == {0}


def test_one_of_each(spark):
    pairs = rows()
    kept = simhash.one_of_each(frame(spark, pairs)).collect()
    root = groups([fingerprint(t) for _, t in pairs])
    assert len(kept) == len(set(root))
    least = {}
    for (i, _), r in zip(pairs, root, strict=True):
        least.setdefault(r, []).append(i)
    expected = sorted((min((i for i in ids if i is not None), default=None) for ids in least.values()), key=repr)
    assert sorted((r.doc_id for r in kept), key=repr) == expected
    assert simhash.one_of_each(frame(spark, [])).count() == 0


def deduplicated(pairs, window):
    split = [(t or "").encode().split() for _, t in pairs]
    seen = Counter(tuple(w[i : i + window]) for w in split for i in range(len(w) - window + 1))
    out = []
    for (doc, _), w in zip(pairs, split, strict=True):
        gone = set()
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i : i + window])] > 1:
                gone |= set(range(i, i + window))
        kept = b" ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((doc, len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize(("window", "k", "seed"), [(35, 16, 7), (35, 8, 8), (12, 5, 9)])
def test_repeated_passages_equal_brute_force(spark, window, k, seed):
    pairs = rows(seed, 200)
    assert answer(substring_dedup.deduplicated(frame(spark, pairs, clash=True), window=window, k=k)) == deduplicated(pairs, window)


def test_words_decide_not_rolling_hashes(spark):
    """Two words in Thue-Morse order: equal sums for any base modulo a power of two, yet different words."""
    word = "a"
    while len(word) < 2048:
        word += word.translate(str.maketrans("ab", "ba"))
    other = word.translate(str.maketrans("ab", "ba"))
    rest = [f"w{i}" for i in range(34)]
    pairs = [(1, " ".join([word, *rest])), (2, " ".join([other, *rest])), (3, " ".join([*rest[:17], word, *rest[17:]])), (4, " ".join([*rest[:17], other, *rest[17:]]))]
    assert answer(substring_dedup.deduplicated(frame(spark, pairs))) == deduplicated(pairs, 35)
    assert all(r.n_removed == 0 for r in substring_dedup.deduplicated(frame(spark, pairs)).collect())


def test_paths_of_a_graph(spark):
    """A chain over several texts, a branch, and a ring, against a walk."""
    pack = lambda low: int(substring_dedup._pack(np.int64(low), np.int64(1)))
    chain = [(i, 100 + i, 101 + i, i // 3 if i % 2 else 7, pack(i)) for i in range(23)]  # edge, left, right, text, at
    branch = [(40, 123, 200, 9, pack(0)), (41, 123, 201, 9, pack(5)), (42, 201, 202, 9, pack(6))]
    ring = [(50 + i, 300 + i, 300 + (i + 1) % 4, 11, pack(2 * i)) for i in range(4)]
    loop = [(60, 400, 400, 12, pack(0))]
    df = spark.createDataFrame(chain + branch + ring + loop, "edge long, left long, right long, text long, at long").repartition(3)
    found = {r.edge: (r.path, r.place) for r in substring_dedup.compacted(df).collect()}
    assert len({found[i][0] for i in range(23)}) == 1 and [found[i][1] for i in range(23)] == list(range(-23, 0))
    assert found[41][0] == found[42][0] != found[40][0] and (found[41][1], found[42][1]) == (-2, -1)
    assert len({found[50 + i][0] for i in range(4)}) == 4 and found[60] == (60, -1)


def test_spans_of_long_passages(spark):
    """A passage shared by texts is one span of its whole length, at its own place in each."""
    rng = random.Random(4)
    fresh = lambda n: [f"{rng.getrandbits(40):x}" for _ in range(n)]
    passage = fresh(400)
    texts = [fresh(50) + passage + fresh(60), passage + fresh(20), fresh(7) + passage]
    _, changed = substring_dedup.shared_passages(frame(spark, [(i, " ".join(t)) for i, t in enumerate(texts)]))
    found = {r.n_removed: r for r in changed.collect()}
    assert set(found) == {400} and changed.count() == 3
    for r in changed.collect():
        longest = max(r.spans, key=lambda x: x["words"])
        assert longest["words"] > 340
        own = next(t for t in texts if " ".join(x for x in t if x not in passage) == r.kept)
        assert own[longest["first"] : longest["first"] + longest["words"]] == passage[passage.index(own[longest["first"]]) :][: longest["words"]]


def test_no_passages(spark):
    assert substring_dedup.deduplicated(frame(spark, [])).count() == 0


def test_pipeline_stages_equal_brute_force(spark, tmp_path):
    import corpus_pipeline

    from .test_filters import base_spans, contaminated

    rng = random.Random(6)
    sentence = lambda: f"The {rng.getrandbits(24):x} of {rng.getrandbits(20):x} is in {rng.getrandbits(24):x} and to a {rng.getrandbits(28):x}."
    good = ["\n".join(sentence() for _ in range(25)) for _ in range(20)]
    texts = good + [good[0], good[0] + " end", "too short", None, "", "Of " * 200, "\n".join(sentence() for _ in range(25)) + " mail a@b.cc or +1 555 123 4567"]
    pairs = list(enumerate(texts))
    clashing = frame(spark, pairs, clash=True).withColumns({"doc": F.lit("x"), "a.b": F.lit("y"), "clean": F.lit(0), "__extra": F.lit(None).cast("string")})
    clashing.write.parquet(f"{tmp_path}/documents.parquet")
    items = [(1, " ".join(good[5].split()[:100]))]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        before = [(r.doc_id, r.text) for r in docs.collect()]
        out = cut(stage(spark, docs, str(tmp_path)))
        after = {r.doc_id: r for r in out.collect()}
        if name == "quality rules":
            assert set(after) == {i for i, t in pairs if t and len(t.split()) >= 50 and not t.startswith("Of")}
        elif name == "SimHash near-dedup":
            root = groups([fingerprint(t) for _, t in before])
            assert set(after) == {min(i for (i, _), r in zip(before, root, strict=True) if r == g) for g in set(root)}
        elif name == "benchmark decontamination":
            assert set(after) == {x[0] for x in contaminated(before, items) if not x[4]}
        elif name == "personal data":
            assert set(after) == {i for i, _ in before}
            assert all(not base_spans(r.text) and r.n_chars == len(r.text) for r in after.values())
        else:
            digest = {i: hashlib.sha256(t.encode()).hexdigest() for i, t in before}
            assert {i: r.decoded_sha256 for i, r in after.items()} == digest
        if name != "byte-level BPE":
            assert out.columns == docs.columns
        docs = out
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == docs.count()

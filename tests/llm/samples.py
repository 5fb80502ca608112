"""Small inputs with the hard cases: nulls, empty and long texts, copies, ties, clashing columns."""

import random

from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
# Columns that operators make themselves, or use inside: they must not get in the way.
CLASHING = (
    "n_words", "n_tokens", "shard", "slot", "fingerprint", "component_id", "pii", "kept", "quality", "items", "contaminated",
    "key", "path", "edges", "fp", "root", "ids", "decoded", "own", "spans", "base", "n_hit", "size", "parts", "steps",
)


def texts(seed=7, n=120):
    rng = random.Random(seed)
    vocabulary = [f"word{i}" for i in range(300)] + "the of and to a in is that it for".split() * 20
    base = [" ".join(rng.choice(vocabulary) for _ in range(rng.randint(1, 160))) for _ in range(30)]
    out = [None, "", " ", "\n\n", "x", "Ends here.", "Ünïcode 🎉 wörds " * 30, "Of " * 90, "a b " * 60, "z" * 30_000, "1 " * 5_000]
    while len(out) < n:
        words = rng.choice(base).split(" ")
        for _ in range(rng.choice([0, 0, 1, 3])):
            words[rng.randrange(len(words))] = rng.choice(vocabulary)
        cut = rng.randrange(len(words)) if rng.random() < 0.2 else 0
        out.append(rng.choice([" ", "\n", "  \t"]).join(words[cut:] + (rng.choice(base).split(" ") if rng.random() < 0.3 else [])))
    return out


def rows(seed=7, n=120):
    made = [(i, t) for i, t in enumerate(texts(seed, n))]
    made += [(3, made[40][1]), (40, made[40][1]), (40, made[40][1]), (None, made[41][1]), (None, made[41][1]), (None, None)]
    return made


def frame(spark, pairs, clash=False):
    df = spark.createDataFrame([(i, t, "en", "src0", len(t or "")) for i, t in pairs], SCHEMA).repartition(3)
    return df.withColumns({c: F.lit(-1) for c in CLASHING}) if clash else df


def answer(df):
    return sorted(map(tuple, df.collect()), key=repr)

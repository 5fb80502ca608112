"""Quality by weak supervision: rules vote or abstain, EM weighs them, a posterior decides.

``measure`` counts what the rules need in one pass over each whole text. ``RULES`` turn the
counts into votes (1 good, -1 bad, 0 abstains). ``fit`` groups the corpus by vote pattern
(at most 3^9 patterns, whatever the corpus size) and estimates by expectation-maximisation
how accurate each rule is on good and on bad texts; no labels are used. Texts that fail the
two base rules are certain and would make up the whole bad class, so they are left out of
the estimate. ``judge`` adds the posterior probability of good quality, a sum of one fitted
weight per vote, in plain columns.

Edge cases: a null text is an empty one, has no words and fails; repeated rows get equal
verdicts; an empty table fits to the prior alone; input columns named like an output are
replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BLANKS, text_or_empty, with_fields

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_distinct", "n_stop", "n_upper", "n_lines", "n_ended")
SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50

# Frequent function words of English, German, French and Spanish.
STOP_WORDS = frozenset(
    "the of and to in a is that it for on with as was be by this are or from at an not which "
    "der die das und in zu den ist von mit sich des auf für nicht ein eine im dem als auch es an werden "
    "de la le les et des en un une du dans est que pour qui sur pas au avec ce il par "
    "el los las y del se por con para su al lo como más o no".split()
)
_EDGES = ".,;:!?\"'()[]«»¿¡#*$%&|<>-"


def _repeats(ids: np.ndarray, distinct: int) -> int:
    """Words inside three-word windows that occur at least twice."""
    if len(ids) < 4:
        return 0
    if distinct < 2_000_000:
        codes = (ids[:-2] * distinct + ids[1:-1]) * distinct + ids[2:]
    else:
        _, pairs = np.unique(ids[:-1] * distinct + ids[1:], return_inverse=True)
        codes = pairs[:-1] * distinct + ids[2:]
    order = np.argsort(codes, kind="stable")
    same = codes[order][1:] == codes[order][:-1]
    if not same.any():
        return 0
    twice = np.zeros(len(codes), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    covered = np.zeros(len(ids), bool)
    for shift in range(3):
        covered[shift : shift + len(twice)] |= twice
    return int(covered.sum())


def counts_of(text: str) -> tuple[int, ...]:
    words = text.encode("utf-8", "surrogatepass").split()
    lines = [x for x in text.split("\n") if x.strip(BLANKS)]
    distinct = {w: i for i, w in enumerate(set(words))}
    ids = np.fromiter(map(distinct.__getitem__, words), np.int64, len(words))
    known, upper = np.zeros(len(distinct) + 1, np.int64), np.zeros(len(distinct) + 1, np.int64)
    for w, i in distinct.items():
        plain = w.decode("utf-8", "replace")
        known[i] = plain.strip(_EDGES).lower() in STOP_WORDS
        upper[i] = len(plain) > 1 and plain.isupper()
    return (
        len(words),
        len(text) - sum(map(text.count, BLANKS)),
        sum(map(text.count, SYMBOLS)),
        len(lines) - len(set(lines)),
        _repeats(ids, len(distinct)),
        len(distinct),
        int(known[ids].sum()),
        int(upper[ids].sum()),
        len(lines),
        sum(x.rstrip(BLANKS).endswith((".", "!", "?", ":", '"', "»")) for x in lines),
    )


def _counted(texts: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([counts_of(t) for t in texts], columns=list(COUNTS), dtype="int64")


def measure(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """All rows and columns plus the counts of ``COUNTS`` over the whole text."""
    counted = F.pandas_udf(_counted, ", ".join(f"{c} long" for c in COUNTS))
    return with_fields(docs, counted(text_or_empty(text_col)), list(COUNTS))


def _per_word(name: str) -> Column:
    return F.col(name) / F.greatest(F.col("n_words"), F.lit(1))


def _per_line(name: str) -> Column:
    return F.col(name) / F.greatest(F.col("n_lines"), F.lit(1))


def _vote(bad: Column, good: Column) -> Column:
    return F.when(bad, -1).when(good, 1).otherwise(0)


def rules() -> list[tuple[str, Column]]:
    """(name, vote): 1 speaks for quality, -1 against it, 0 abstains."""
    length = F.col("word_chars") / F.greatest(F.col("n_words"), F.lit(1))
    variety = _per_word("n_distinct")
    return [
        ("enough words", _vote(F.col("n_words") < MIN_WORDS, F.col("n_words") >= 2 * MIN_WORDS)),
        ("word length", _vote((length < 3) | (length > 9), length.between(3.8, 6.2))),
        ("few symbols", _vote(_per_word("n_symbols") > 0.2, _per_word("n_symbols") < 0.05)),
        ("own lines", _vote(_per_line("n_dup_lines") > 0.3, F.col("n_dup_lines") == 0)),
        ("few repeats", _vote(_per_word("n_repeat_words") > 0.5, _per_word("n_repeat_words") < 0.15)),
        ("varied words", _vote((variety < 0.15) & (F.col("n_words") < 2_000), variety > 0.3)),
        ("function words", _vote(_per_word("n_stop") < 0.04, _per_word("n_stop") > 0.12)),
        ("mixed case", _vote(_per_word("n_upper") > 0.4, _per_word("n_upper") < 0.05)),
        ("ended lines", _vote(_per_line("n_ended") < 0.2, _per_line("n_ended") > 0.6)),
    ]


@dataclass(frozen=True)
class LabelModel:
    """prior: share of good texts; on_good, on_bad: each rule's accuracy on good and on bad texts when it votes."""

    prior: float
    on_good: tuple[float, ...]
    on_bad: tuple[float, ...]

    def odds(self, rule: int) -> tuple[float, float]:
        """What a vote against and a vote for quality add to the log odds."""
        g, b = self.on_good[rule], self.on_bad[rule]
        return float(np.log((1 - g) / b)), float(np.log(g / (1 - b)))


#: Where the estimation starts and what its pseudo-votes say: votes for bad quality are rare on good texts.
START = {"prior": 0.85, "on_good": 0.98, "on_bad": 0.4, "pseudo_votes": 1.0}


def expectation_maximisation(votes: np.ndarray, weights: np.ndarray, rounds: int = 1000) -> LabelModel:
    """Two classes and two accuracies per rule; an abstaining rule says nothing about a text."""
    n, p, pseudo = votes.shape[1], START["prior"], START["pseudo_votes"]
    g, b = np.full(n, START["on_good"]), np.full(n, START["on_bad"])
    up, down = (votes == 1).astype(float), (votes == -1).astype(float)
    for _ in range(rounds if len(votes) else 0):
        z = np.log(p / (1 - p)) + up @ np.log(g / (1 - b)) + down @ np.log((1 - g) / b)
        good = weights / (1 + np.exp(-z))
        bad = weights - good
        p = (good.sum() + 1) / (weights.sum() + 2)
        new = (good @ up + pseudo * START["on_good"]) / (good @ (up + down) + pseudo)
        # A vote never counts for the class that it speaks against.
        b = np.maximum((bad @ down + pseudo * START["on_bad"]) / (bad @ (up + down) + pseudo), 1 - new)
        moved, g = float(np.abs(new - g).max()), new
        if moved < 1e-12:
            break
    return LabelModel(float(p), tuple(g.tolist()), tuple(b.tolist()))


def _failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def fit(measured: DataFrame) -> LabelModel:
    """Estimate the accuracies from the vote patterns of all rows that the base rules leave to the verdict."""
    names = [f"__llm_v{i}" for i in range(len(rules()))]
    voted = measured.where(~_failed()).select(*(v.alias(n) for n, (_, v) in zip(names, rules(), strict=True)))
    rows = sorted(voted.groupBy(*names).agg(F.count(F.lit(1)).alias("n")).collect())
    votes = np.array([[r[n] for n in names] for r in rows], float).reshape(-1, len(names))
    return expectation_maximisation(votes, np.array([r["n"] for r in rows], float))


def judge(measured: DataFrame, model: LabelModel, threshold: float = 0.5) -> DataFrame:
    """Add ``quality`` (posterior), ``base_failed`` and ``kept``."""
    z = F.lit(float(np.log(model.prior / (1 - model.prior))))
    for i, (_, vote) in enumerate(rules()):
        against, favour = model.odds(i)
        z = z + F.when(vote == -1, against).when(vote == 1, favour).otherwise(0.0)
    out = measured.withColumn("quality", 1 / (1 + F.exp(-z))).withColumn("base_failed", _failed())
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("quality") >= threshold))

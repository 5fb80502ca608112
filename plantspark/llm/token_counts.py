"""Token counts of a sentencepiece BPE model by a whole-token shortcut.

No piece of the model has a blank after another character, so no merge crosses the start of
a run of blanks: a text falls into pre-tokens (blanks, then other characters) that encode
independently. ``prove`` encodes every vocabulary string once, alone, and keeps those that
come back as exactly one token. A pre-token among them counts one; only the rest is merged,
each distinct one once per worker.

Edge cases: a null or empty text has no tokens; special strings are ordinary text, as the
library has it by default; characters outside the vocabulary count their bytes.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_or_empty, with_fields

BLANK = "▁"
#: Merged pre-tokens kept per Python worker; beyond it the cache starts anew.
CACHE = 100_000


def prove(model) -> frozenset[str]:
    """Vocabulary strings, blanks as spaces and without the one the library puts in front, that are one token alone."""
    size = model.get_piece_size()
    pieces = [model.id_to_piece(i) for i in range(size) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]
    if any(BLANK in p.lstrip(BLANK) for p in pieces):
        raise ValueError("a piece has a blank inside: pre-tokens would not be independent")
    if model.encode(" a  b", out_type=str)[:2] != [BLANK, f"{BLANK}a"]:
        raise ValueError("the model must prefix one blank and keep all others")
    # A pre-token starts with a blank; the library adds that first one itself.
    ours = [p[1:].replace(BLANK, " ") for p in pieces if len(p) > 1 and p.startswith(BLANK)]
    return frozenset(p for p, ids in zip(ours, model.encode(ours, num_threads=1), strict=True) if len(ids) == 1)


class Counter:
    def __init__(self, data: bytes):
        import regex
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_proto=data)
        self.whole = prove(self.model)
        self.known = dict.fromkeys(self.whole, 1)
        self.opens = np.array([self.model.id_to_piece(i).startswith(BLANK) for i in range(self.model.get_piece_size())])
        # A pre-token without its first blank: further blanks, then other characters; the end of the text may be blanks alone.
        self.split = regex.compile(r" ( *+[^ ]++| *+$)").findall

    def _learn(self, tokens: list[str]) -> None:
        new = [t for t in dict.fromkeys(tokens) if t not in self.known]
        if len(self.known) + len(new) > CACHE + len(self.whole):
            self.known = dict.fromkeys(self.whole, 1)
            new = [t for t in dict.fromkeys(tokens) if t not in self.known]
        # One call for all that start without a blank: each begins where a piece with a blank stands.
        plain = [t for t in new if t and t[0] != " "]
        ids = np.asarray(self.model.encode(" ".join(plain), num_threads=1), np.int64)
        starts = np.flatnonzero(self.opens[ids])
        self.known.update(zip(plain, np.diff(starts, append=len(ids)).tolist(), strict=True))
        # An empty rest is a lone blank, which the library never sees alone: one piece.
        other = [t for t in new if not t or t[0] == " "]
        self.known.update((t, len(ids) if t else 1) for t, ids in zip(other, self.model.encode(other, num_threads=1), strict=True))

    def count(self, text: str) -> int:
        if not text:
            return 0
        text = text.replace(BLANK, " ")
        tokens = text.split(" ") if "  " not in text and text[0] != " " and text[-1] != " " else self.split(" " + text)
        try:
            return sum(map(self.known.__getitem__, tokens))
        except KeyError:
            self._learn(tokens)
            return sum(map(self.known.__getitem__, tokens))


@lru_cache(maxsize=2)
def counter(data: bytes) -> Counter:
    return Counter(data)


def counted(docs: DataFrame, model_path: str, limit: int = 4096, text_col: str = "text") -> DataFrame:
    """Add ``n_bytes``, ``n_tokens`` and ``over_limit`` (more than ``limit`` tokens). The model file (0.5 MB, fixed) is broadcast."""
    with open(model_path, "rb") as file:
        data = docs.sparkSession.sparkContext.broadcast(file.read())

    def run(texts: pd.Series) -> pd.Series:
        count = counter(data.value).count
        return pd.Series([count(t) for t in texts], dtype="int64")

    text = text_or_empty(text_col)
    n_tokens: Column = F.pandas_udf(run, "long")(text)
    made = F.struct(F.octet_length(text).cast("long").alias("n_bytes"), n_tokens.alias("n_tokens"))
    out = with_fields(docs, made, ["n_bytes", "n_tokens"], drop=("over_limit",))
    return out.withColumn("over_limit", F.col("n_tokens") > limit)

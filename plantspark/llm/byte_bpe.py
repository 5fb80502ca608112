"""Byte-level BPE through a sentencepiece model written straight from a rank file.

Each of the 256 bytes is mapped to one printable character. A vocabulary entry becomes a
piece of such characters with the negative rank as its score, so the merge with the best
score is the merge with the lowest rank. The model file is written field by field; its
normaliser is the identity. Texts are split into pre-tokens by the public pattern, each
pre-token is mapped and encoded alone, and decoding maps the pieces back to bytes.

Edge cases: a null text is an empty one, has no ids and decodes to no bytes; special
strings are ordinary text; long pre-tokens are merged whole.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from functools import lru_cache
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_or_empty, with_fields

#: Pre-tokens kept with their ids per Python worker; beyond it the cache starts anew.
CACHE = 100_000


def byte_letters() -> list[str]:
    """Printable Latin-1 characters stand for themselves, the other bytes for U+0100 onwards in order."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    shifted = iter(range(256, 512))
    return [chr(b if b in own else next(shifted)) for b in range(256)]


def read_ranks(path: str) -> list[bytes]:
    """Tokens of a rank file ("base64 rank" per line), in the order of their ranks."""
    with open(path, "rb") as lines:
        pairs = [line.split() for line in lines if line.strip()]
    tokens = [base64.b64decode(token) for token, _ in sorted(pairs, key=lambda p: int(p[1]))]
    if sorted(int(rank) for _, rank in pairs) != list(range(len(pairs))):
        raise ValueError("ranks must run from 0 without gaps")
    return tokens


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes(out + bytes([n]))


def _number(field: int, n: int) -> bytes:
    return _varint(field << 3) + _varint(n & (1 << 64) - 1)


def _block(field: int, data: bytes) -> bytes:
    return _varint(field << 3 | 2) + _varint(len(data)) + data


def serialise(tokens: list[bytes]) -> bytes:
    """The model: piece i is token i, the unknown piece comes last and cannot occur.

    Fields of the public format. Piece: 1 text, 2 score, 3 kind (1 normal, 2 unknown).
    Trainer: 3 kind of model (2 is BPE), 4 size, 24 splitting by white space, 40 to 43 ids
    of unknown, begin, end and padding (-1: none). Normaliser: 1 name, 3 to 5 dummy
    prefix, removal of blanks, escaping of blanks.
    """
    letters = byte_letters()
    pieces = [_block(1, _block(1, "".join(letters[b] for b in t).encode()) + b"\x15" + struct.pack("<f", -i) + _number(3, 1)) for i, t in enumerate(tokens)]
    pieces.append(_block(1, _block(1, b"<unk>") + b"\x15" + struct.pack("<f", 0) + _number(3, 2)))
    trainer = _number(3, 2) + _number(4, len(pieces)) + _number(24, 0) + _number(40, len(tokens)) + b"".join(_number(f, -1) for f in (41, 42, 43))
    normaliser = _block(1, b"identity") + _number(3, 0) + _number(4, 0) + _number(5, 0)
    return b"".join(pieces) + _block(2, trainer) + _block(3, normaliser)


class Codec:
    """Encodes and decodes with one serialised model; lives in a Python worker."""

    def __init__(self, model: bytes, pattern: str):
        import regex
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_proto=model)
        letters = byte_letters()
        # One decoded byte is one Latin-1 character: a translation turns it into its letter.
        self.to_letters = {b: letter for b, letter in enumerate(letters)}
        back = {letter: b for b, letter in enumerate(letters)}
        size = self.model.get_piece_size() - 1
        self.pieces = [bytes(map(back.__getitem__, self.model.id_to_piece(i))) for i in range(size)]
        self.unknown = size
        self.names = [str(i) for i in range(size)]
        self.split = regex.compile(pattern).findall
        self.seen: dict[str, list[int]] = {}

    def _learn(self, tokens: list[str]) -> None:
        """Encode new pre-tokens in one call. The line feed between them is no letter of the
        vocabulary: it comes back as the unknown piece, and no merge crosses it."""
        new = [t for t in dict.fromkeys(tokens) if t not in self.seen]
        if len(self.seen) + len(new) > CACHE:
            self.seen, new = {}, list(dict.fromkeys(tokens))
        mapped = "\n".join(t.encode().decode("latin-1").translate(self.to_letters) for t in new)
        ids = self.model.encode(mapped, num_threads=1)
        at, stop = 0, self.unknown
        for token in new:
            try:
                end = ids.index(stop, at)
            except ValueError:
                end = len(ids)
            self.seen[token] = ids[at:end]
            at = end + 1

    def encode(self, text: str) -> list[int]:
        tokens = self.split(text)
        try:
            return list(chain.from_iterable(map(self.seen.__getitem__, tokens)))
        except KeyError:
            self._learn(tokens)
            return list(chain.from_iterable(map(self.seen.__getitem__, tokens)))

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.pieces.__getitem__, ids))


@lru_cache(maxsize=2)
def codec(model: bytes, pattern: str) -> Codec:
    return Codec(model, pattern)


def _digest(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def encoded(docs: DataFrame, ranks: str, pattern: str, text_col: str = "text", outputs: tuple[str, ...] = ("ids", "decoded")) -> DataFrame:
    """Add any of ``ids``, ``decoded`` (bytes), ``n_tokens``, ``ids_sha256``, ``decoded_sha256``.

    The rank file has a fixed size (about 1 MB); its model is broadcast.
    """
    model = docs.sparkSession.sparkContext.broadcast(serialise(read_ranks(ranks)))
    kinds = {"ids": "array<int>", "decoded": "binary", "n_tokens": "long", "ids_sha256": "string", "decoded_sha256": "string"}
    names: list[str] = []
    make = {
        "ids": lambda ids, raw: np.asarray(ids, np.int32),  # a list of integers takes nine times the memory
        "decoded": lambda ids, raw: raw,
        "n_tokens": lambda ids, raw: len(ids),
        "ids_sha256": lambda ids, raw: _digest(" ".join(map(names.__getitem__, ids)).encode()),
        "decoded_sha256": lambda ids, raw: _digest(raw),
    }

    def run(texts: pd.Series) -> pd.DataFrame:
        c = codec(model.value, pattern)
        names[:] = c.names
        rows: dict[str, list] = {name: [] for name in outputs}
        for text in texts:
            ids = c.encode(text)
            raw = c.decode(ids)
            for name in outputs:
                rows[name].append(make[name](ids, raw))
        return pd.DataFrame(rows, columns=list(outputs))

    made: Column = F.pandas_udf(run, ", ".join(f"{name} {kinds[name]}" for name in outputs))(text_or_empty(text_col))
    return with_fields(docs, made, list(outputs))

"""Reproducible numbers from md5, the same in Spark, in SQL and in Python."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

DIGITS = 13
SPACE = float(16**DIGITS)


def hash_number(*columns: Column) -> Column:
    """52 bits of the md5 over the text of the columns, joined by a bar."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *columns)), 1, DIGITS), 16, 10).cast("long")


def hash_fraction(seed: int, *columns: Column) -> Column:
    """Uniform number in [0, 1)."""
    return hash_number(F.lit(str(seed)), *columns).cast("double") / SPACE


def fractions(texts: Iterable[str]) -> list[float]:
    """``hash_fraction`` in Python, for texts that are already joined."""
    return [int(hashlib.md5(t.encode()).hexdigest()[:DIGITS], 16) / SPACE for t in texts]

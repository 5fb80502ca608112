"""Registered queries: one Spark plan, one output contract, one oracle query each.

The contract names every output column with a one-letter type. It is applied to the
Spark result (casts, doubles rounded) and wrapped around the oracle SQL the same way, so
both sides agree on types and on the last digits of a floating sum. Before rounding, both
scale a double by 1 + 1e-12: a mean of cents over 2^k rows lies exactly between two
rounded values, and the last bit of the sum must not decide which one is taken.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plantspark.session import ship

DIGITS = 6
NUDGE = 1.000000000001
_SPARK = {"s": "string", "l": "bigint", "d": "double", "b": "boolean", "t": "timestamp_ntz", "D": "date"}
_DUCK = {"s": "VARCHAR", "l": "BIGINT", "d": "DOUBLE", "b": "BOOLEAN", "t": "TIMESTAMP", "D": "DATE"}

# Times are UTC; a hot key of a sort-merge join is split even where the next step would
# otherwise reuse the join's partitioning.
SESSION = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
}

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _columns(contract: str) -> list[tuple[str, str]]:
    pairs = (item.partition(":") for item in contract.split())
    return [(name, kind or "s") for name, _, kind in pairs]


def shaped(df: DataFrame, contract: str) -> DataFrame:
    out = []
    for name, kind in _columns(contract):
        col = F.col(name).cast(_SPARK[kind])
        # + 0.0 turns a rounded -0.0 into 0.0.
        out.append((F.round(col * NUDGE, DIGITS) + F.lit(0.0) if kind == "d" else col).alias(name))
    return df.select(*out)


def oracle(contract: str, ctes: str, body: str) -> str:
    out = []
    for name, kind in _columns(contract):
        cast = f'CAST("{name}" AS {_DUCK[kind]})'
        out.append(f'round({cast} * CAST({NUDGE} AS DOUBLE), {DIGITS}) + CAST(0 AS DOUBLE) AS "{name}"' if kind == "d" else f'{cast} AS "{name}"')
    prefix = f"WITH {ctes}, " if ctes else "WITH "
    return f"{prefix}answer AS ({body.strip()}) SELECT {', '.join(out)} FROM answer"


def query(name: str, contract: str, sql: str | None = None, ctes: str = ""):
    """Register ``plan(spark, sf_dir)`` under ``name``; without ``sql`` only rows are checked."""

    def register(plan: Callable[[SparkSession, str], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship(spark)
            for setting, value in SESSION.items():
                spark.conf.set(setting, value)
            return shaped(plan(spark, sf_dir), contract)

        run.__name__, run.__doc__ = plan.__name__, plan.__doc__
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = oracle(contract, ctes, sql)
        return plan

    return register

"""What the text operators share: reading, null rules, lineage cuts."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plantspark.session import checkpoint_root, cut_lineage, ship

#: Characters that separate words wherever a contract says ``[^\x20\x09-\x0D]+``; bytes.split() uses the same six.
BLANKS = " \t\n\v\f\r"


#: Rows in one Arrow batch: whole texts go to Python, and one may be very long.
BATCH_ROWS = 500


def prepare(spark: SparkSession) -> None:
    """Send the package to the executors and keep the batches of texts small."""
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(column: str) -> Column:
    """A null text counts as an empty one in every operator of this subpackage."""
    return F.coalesce(F.col(f"`{column}`").cast("string"), F.lit(""))


def with_fields(df: DataFrame, made: Column, names: list[str], drop: tuple[str, ...] = ()) -> DataFrame:
    """Add the fields of one struct as columns; a column of the input with such a name is replaced."""
    held = "__llm_made"
    rest = [F.col(f"`{c}`") for c in df.columns if c not in names and c not in drop]
    return df.withColumn(held, made).select(*rest, *(F.col(held)[n].alias(n) for n in names))


def cut(df: DataFrame) -> DataFrame:
    """Write the rows to the shared checkpoint folder and go on from there."""
    return cut_lineage(df)


def written(df: DataFrame) -> DataFrame:
    """The rows as Parquet in the shared folder, whose size the planner knows; lineage goes on from there."""
    path = f"{checkpoint_root(df.sparkSession).rstrip('/')}/llm-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)

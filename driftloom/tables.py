"""Reading the given tables, and the rule by which one of several rows with a key stands."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def standing(rows: DataFrame, keys: Sequence[str], values: Sequence[str], order: str = "recorded_at") -> DataFrame:
    """One row per key: the values of the row with the latest ``order``.

    Every value is picked on its own by a hash aggregate of fixed-width buffers, which combines before the shuffle; a window over
    the key would send and sort every row. Null keys form a key of their own; rows whose ``order`` is null lose against any other
    (if all are null, any value that is not null stands).
    """
    at = F.coalesce(F.col(order).cast("timestamp"), F.lit("0001-01-01").cast("timestamp")) if order in rows.columns else F.lit(0)
    return rows.groupBy(*keys).agg(*(F.max_by(F.col(v), at).alias(v) for v in values))


def no_parent(parent: Column, own: Column) -> Column:
    """The parent, or null where null, a negative number or the row's own id say that there is none."""
    return F.when((parent >= 0) & (parent != own), parent)

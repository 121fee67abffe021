"""Per-key results where a few keys hold most rows.

Rows are range partitioned by the key and a secondary order, at quantiles that Spark samples. A heavy key thereby spans as many partitions
as its rows fill, and every task gets about as many rows. Each partition folds its rows into one partial state per key; only a key
that crosses a boundary has several, and a last small aggregate stitches them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..store import Workspace

FOLDS = {"sum": F.sum, "count": F.count, "min": F.min, "max": F.max}
STITCHES = FOLDS | {"count": F.sum}


def split_ranges(rows: DataFrame, keys: Sequence[str], order: Sequence[str], partitions: int | None = None) -> DataFrame:
    """The rows range partitioned by keys and order, with heavy keys over several partitions."""
    n = partitions or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartitionByRange(n, *keys, *order)


def boundary_states(ranges: DataFrame, keys: Sequence[str], folds: dict[str, tuple[str, Column]]) -> DataFrame:
    """The partial states: one row per key and partition, with ``partition``; for a key that crosses no boundary, its result."""
    return ranges.withColumn("partition", F.spark_partition_id()).groupBy("partition", *keys).agg(*(FOLDS[op](v).alias(k) for k, (op, v) in folds.items()))


def stitched(states: DataFrame, keys: Sequence[str], folds: dict[str, tuple[str, Column]]) -> DataFrame:
    """One row per key, and how many partitions it spanned."""
    return states.groupBy(*keys).agg(*(STITCHES[op](F.col(k)).alias(k) for k, (op, _) in folds.items()), F.count(F.lit(1)).alias("spans"))


def skewed_totals(rows: DataFrame, keys: Sequence[str], order: Sequence[str], folds: dict[str, tuple[str, Column]], partitions: int | None = None, unique: bool = False) -> DataFrame:
    """One result per key, without a task that gets more than its share.

    :param order: secondary order within a key; with ``keys`` it should tell rows apart, or equal rows stay together in one task
    :param folds: by name, ``sum``, ``count``, ``min`` or ``max`` and what it is of (``max`` of a struct finds the row that leads)
    :param unique: ``keys`` and ``order`` identify a row, and repeated rows count once; they share a partition, so this needs no shuffle
    :return: keys, the folds, ``spans`` (number of partitions that the key's rows lay in)

    Null keys are a key of their own; null values add nothing, and a key with no other has null (count: 0). An empty table gives an empty result.
    Columns other than those named are left out of the shuffle.
    """
    ranges = split_ranges(rows, keys, order, partitions)
    if unique:
        ranges = ranges.dropDuplicates([*keys, *order])
    return stitched(boundary_states(ranges, keys, folds), keys, folds)


def running(rows: DataFrame, keys: Sequence[str], order: Sequence[str], sums: dict[str, Column] | None = None, lasts: dict[str, Column] | None = None) -> DataFrame:
    """``rows`` with running values within ``keys`` in ``order``, up to and with each row, though a key's rows may be more than one task should hold.

    :param sums: by name, what is summed (nulls add nothing)
    :param lasts: by name, of what the last value that is not null is taken

    Rows are range partitioned by keys and order, each partition runs through its own stretch, and what the stretches before it come to is joined on. Equal keys and order are in any order
    among each other. Null keys are a key; an empty table gives an empty result.
    """
    sums, lasts = sums or {}, lasts or {}
    ws = Workspace(rows.sparkSession, "running")
    laid = rows.withColumns({**{f"__s_{k}": c for k, c in sums.items()}, **{f"__l_{k}": c for k, c in lasts.items()}}).repartitionByRange(*keys, *order)
    laid = ws.keep(laid.withColumn("__part", F.spark_partition_id()))  # written, so that a row keeps its partition whoever reads it
    local = Window.partitionBy("__part", *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    at = F.struct(*order)
    states = laid.groupBy("__part", *keys).agg(F.count(F.lit(1)).alias("__n"), *(F.sum(f"__s_{k}").alias(f"__s_{k}") for k in sums), *(F.max_by(f"__l_{k}", F.when(F.col(f"__l_{k}").isNotNull(), at)).alias(f"__l_{k}") for k in lasts))
    before = Window.partitionBy(*keys).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    prior = states.select(F.col("__part").alias("__p"), *(F.col(k).alias(f"__p_{i}") for i, k in enumerate(keys)), *(F.sum(f"__s_{k}").over(before).alias(f"__b_{k}") for k in sums), *(F.last(f"__l_{k}", True).over(before).alias(f"__e_{k}") for k in lasts))
    ran = laid.select(*rows.columns, "__part", *(F.sum(f"__s_{k}").over(local).alias(f"__s_{k}") for k in sums), *(F.last(f"__l_{k}", True).over(local).alias(f"__l_{k}") for k in lasts))
    met = ran.join(prior, [F.col("__part") == F.col("__p"), *(F.col(k).eqNullSafe(F.col(f"__p_{i}")) for i, k in enumerate(keys))])
    zero = F.lit(0)
    return met.select(*(c for c in rows.columns if c not in {*sums, *lasts}), *((F.coalesce(f"__b_{k}", zero) + F.coalesce(f"__s_{k}", zero)).alias(k) for k in sums), *(F.coalesce(f"__l_{k}", f"__e_{k}").alias(k) for k in lasts))


def as_of(left: DataFrame, right: DataFrame, keys: Sequence[str], left_at: str, right_at: str, value: str, strict: bool = False) -> DataFrame:
    """``left`` with the ``value`` of the latest row of ``right`` of its keys that is not later (``strict``: that is earlier), null if none, as ``value``; and when that was, as ``since``. No range join: one run over both in order.

    Of right rows with equal keys and time the one with the greatest value counts. Null keys match each other.
    """
    kept = [c for c in left.columns if c not in keys and c != left_at]
    r = right.groupBy(*keys, F.col(right_at).alias("__at")).agg(F.max(value).alias("__v"))
    a = left.select(*keys, F.col(left_at).alias("__at"), F.lit(0 if strict else 1).alias("__kind"), F.struct(*(kept or [left_at])).alias("__kept"), F.lit(None).cast(r.schema["__v"].dataType).alias("__v"))
    b = r.select(*keys, F.col("__at").cast(a.schema["__at"].dataType), F.lit(1 if strict else 0).alias("__kind"), F.lit(None).cast(a.schema["__kept"].dataType).alias("__kept"), "__v")
    right_kind = 1 if strict else 0
    ran = running(a.unionByName(b), keys, ["__at", "__kind"], lasts={"__last": F.when(F.col("__kind") == right_kind, F.struct("__v", "__at"))})
    return ran.where(F.col("__kind") != right_kind).select(*keys, F.col("__at").alias(left_at), *(F.col(f"__kept.{c}").alias(c) for c in kept), F.col("__last.__v").alias(value), F.col("__last.__at").alias("since"))

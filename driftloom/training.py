"""Events for training: voxels with labels, sharded, and read in Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .operators.points import contested_voxels


def training_voxels(points: DataFrame, membership: DataFrame, include_le: bool = True) -> DataFrame:
    """One row per voxel of an event (event_id, x, y, z): energy, ``inst_id``, ``interaction_id`` and ``sem_type`` of the instance that wins it. Points of no instance have -1 and the last rank.

    :param membership: event_id, id, inst_id, sem_type, interaction_id, is_le
    """
    m = membership.select(F.col("event_id").alias("m_e"), F.col("id").alias("m_id"), "inst_id", "sem_type", "interaction_id", "is_le")
    rows = points.join(m, (F.col("event_id") == F.col("m_e")) & (F.col("particle_id") == F.col("m_id")), "left").withColumns({"inst_id": F.coalesce("inst_id", F.lit(-1)), "interaction_id": F.coalesce("interaction_id", F.lit(-1))})
    return contested_voxels(rows, ["inst_id", "interaction_id"], include_le=include_le)


def shards(events: DataFrame, world: int, rank: int, epoch: int = 0) -> DataFrame:
    """The events of one of ``world`` workers, another split in each epoch; together the workers see every event once."""
    return events.where(F.pmod(F.xxhash64("event_id", F.lit(epoch)), F.lit(world)) == rank)


def write_shards(voxels: DataFrame, columns: list[str], path: str, shards: int) -> None:
    """Voxels of whole events in ``shards`` parts, each sorted by event, for ``batches``: one shuffle by shard, nothing through the driver."""
    part = F.pmod(F.xxhash64("event_id"), F.lit(shards)).cast("int")
    laid = voxels.select("event_id", *columns, part.alias("shard")).repartition(shards, "shard").sortWithinPartitions("shard", "event_id")
    laid.write.mode("errorifexists").partitionBy("shard").parquet(path)


def batches(path: str, columns: list[str], shard: int | None = None, rows: int = 65_536) -> Iterator[tuple[int, pa.Table]]:
    """Events of written shards (one, or all in turn) one by one as Arrow tables, without padding. Record batches are streamed from the files, so memory holds one event and one batch."""
    import pyarrow.dataset as ds

    root = path.removeprefix("file://")
    held: list[pa.RecordBatch] = []
    now = None
    files = sorted(ds.dataset(root, partitioning="hive").files)
    for name in files:
        if shard is not None and f"/shard={shard}/" not in name:
            continue
        for b in ds.dataset(name).to_batches(columns=["event_id", *columns], batch_size=rows, use_threads=False):
            ids = b.column(0).to_numpy(zero_copy_only=False)
            edges = [0, *(np.flatnonzero(ids[1:] != ids[:-1]) + 1).tolist(), len(ids)]
            for a, e in zip(edges, edges[1:]):
                if e == a:
                    continue
                if now is not None and ids[a] != now:
                    yield now, pa.Table.from_batches(held)
                    held = []
                now = int(ids[a])
                held.append(b.slice(a, e - a))
    if now is not None:
        yield now, pa.Table.from_batches(held)

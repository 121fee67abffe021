"""Point clouds as long tables: duplicates, voxels, extents, contested voxels. All are hash aggregates on composite keys that combine before the shuffle; no event or particle is ever collected."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import cell, centre, semantic_rank

CLOUD = ("event_id", "particle_id")


def merge_duplicates(points: DataFrame, owner: Sequence[str] = CLOUD) -> DataFrame:
    """Points of one owner at exactly one position become one: t least, de and dx summed, ``n`` how many there were. NaN positions are equal to each other, and null ones."""
    return points.groupBy(*owner, "x", "y", "z").agg(F.min("t").alias("t"), F.sum(F.col("de").cast("double")).alias("de"), F.sum(F.col("dx").cast("double")).alias("dx"), F.count(F.lit(1)).alias("n"))


def cells(points: DataFrame, size: Sequence[float], origin: Sequence[float] | None, owner: Sequence[str] = CLOUD) -> DataFrame:
    """Points with their cell (vx, vy, vz) and its origin (ox, oy, oz). Without an origin each owner's least coordinates are it. Points with a null or NaN coordinate have no cell and are left out."""
    if min(size) <= 0:
        raise ValueError("voxel sizes must be positive")
    good = points.where(" and ".join(f"{a} is not null and not isnan({a})" for a in "xyz"))
    if origin is None:
        low = good.groupBy(*(F.col(k).alias(f"__{k}") for k in owner)).agg(*(F.min(a).cast("double").alias(f"o{a}") for a in "xyz"))
        good = good.join(low, [F.col(k) == F.col(f"__{k}") for k in owner]).drop(*(f"__{k}" for k in owner))
    else:
        good = good.withColumns({f"o{a}": F.lit(float(o)) for a, o in zip("xyz", origin)})
    return good.withColumns({f"v{a}": cell(F.col(a), s, F.col(f"o{a}")) for a, s in zip("xyz", size)})


def voxelize(points: DataFrame, size: Sequence[float], origin: Sequence[float] | None, owner: Sequence[str] = CLOUD, point: str | None = None) -> DataFrame:
    """One point per owner and occupied cell, at its centre: t least, de and dx summed, ``n`` points; with ``point`` also the least of that column, an id for the voxel. Every point snaps, also of clouds in which no two share a cell."""
    c = cells(points, size, origin, owner)
    least = [F.min(point).alias(point)] if point else []
    v = c.groupBy(*owner, "vx", "vy", "vz", "ox", "oy", "oz").agg(F.min("t").alias("t"), F.sum(F.col("de").cast("double")).alias("de"), F.sum(F.col("dx").cast("double")).alias("dx"), F.count(F.lit(1)).alias("n"), *least)
    return v.select(*owner, "vx", "vy", "vz", *(centre(F.col(f"v{a}"), s, F.col(f"o{a}")).alias(a) for a, s in zip("xyz", size)), "t", "de", "dx", "n", *([point] if point else []))


def voxmap(points: DataFrame, size: Sequence[float], origin: Sequence[float] | None, point: str = "point_id", owner: Sequence[str] = CLOUD) -> DataFrame:
    """The bridge from voxels to the points that fell into them."""
    return cells(points, size, origin, owner).select(*owner, "vx", "vy", "vz", point)


def extent(points: DataFrame, size: float | None, owner: Sequence[str] = CLOUD) -> DataFrame:
    """How large each cloud is: occupied cells of a cube grid at 0, or rows where ``size`` is None."""
    if size is None:
        return points.groupBy(*owner).agg(F.count(F.lit(1)).alias("extent"))
    # first the cells, which combine in the tasks, then their number
    c = cells(points, (size,) * 3, (0.0,) * 3, owner).select(*owner, "vx", "vy", "vz").distinct()
    return c.groupBy(*owner).agg(F.count(F.lit(1)).alias("extent"))


def truth_voxels(steps: DataFrame, size: Sequence[float], origin: Sequence[float], earliest: Sequence[str], position: str, owner: Sequence[str] = CLOUD) -> DataFrame:
    """Voxels of truth steps: as ``voxelize``, and the ``earliest`` columns from the step of least (t, position)."""
    c = cells(steps, size, origin, owner)
    v = c.groupBy(*owner, "vx", "vy", "vz").agg(F.min("t").alias("t"), F.sum(F.col("de").cast("double")).alias("de"), F.sum(F.col("dx").cast("double")).alias("dx"), F.min(F.struct("t", position, *earliest)).alias("first"))
    return v.select(*owner, "vx", "vy", "vz", *(centre(F.col(f"v{a}"), s, F.lit(float(o))).alias(a) for a, s, o in zip("xyz", size, origin)), F.col("first.t").alias("t"), "de", "dx", *(f"first.{k}" for k in earliest))


def contested_voxels(points: DataFrame, labels: Sequence[str], by: Sequence[str] = ("event_id", "x", "y", "z"), include_le: bool = True, energy: str = "de", time: str = "t", tie: str = "point_id") -> DataFrame:
    """One row per voxel of an event over all instances: energy of all its points, labels of the one that wins it.

    The winner has the lowest rank of ``sem_type``, then the least time, then the least ``tie``. With ``include_le`` false, low-energy points are left out
    before, energy included. Labels are columns of ``points`` besides ``sem_type``. Points of no instance take part with the last rank.
    """
    rows = points if include_le else points.where(~F.coalesce(F.col("is_le"), F.lit(False)))
    win = F.struct(semantic_rank(F.col("sem_type")).alias("rank"), F.col(time), F.col(tie), F.col("sem_type"), *labels)
    v = rows.groupBy(*by).agg(F.sum(F.col(energy).cast("double")).alias("energy"), F.min(win).alias("win"), F.count(F.lit(1)).alias("points"))
    return v.select(*by, "energy", "points", F.col("win.sem_type").alias("sem_type"), *(F.col(f"win.{k}").alias(k) for k in labels))


def group_reductions(deposits: DataFrame, group: Sequence[str]) -> DataFrame:
    """Mean t0 and summed de of each readout group; a group of only nulls has 0 energy."""
    return deposits.groupBy(*group).agg(F.avg(F.col("t").cast("double")).alias("t0"), F.coalesce(F.sum(F.col("de").cast("double")), F.lit(0.0)).alias("de"))


def shared_energy(hits: DataFrame, groups: DataFrame, group: Sequence[str], charge: str = "charge") -> DataFrame:
    """``true_de`` of each hit: its group's energy in proportion to the size of its charge; 0 where the hit or the group has no charge. Sums are joined back, so a group of any size stays spread."""
    total = hits.groupBy(*(F.col(k).alias(f"__{k}") for k in group)).agg(F.sum(F.abs(charge)).alias("__q"))
    of = groups.select(*(F.col(k).alias(f"_g_{k}") for k in group), F.col("de").alias("__de"))
    both = total.join(of, [F.col(f"__{k}") == F.col(f"_g_{k}") for k in group], "left")
    out = hits.join(both, [F.col(k) == F.col(f"__{k}") for k in group], "left")
    return out.select(*hits.columns, F.when((F.col("__q") > 0) & F.col(charge).isNotNull(), F.col("__de") * F.abs(charge) / F.col("__q")).otherwise(0.0).alias("true_de"))


def bounding_boxes(points: DataFrame, owner: Sequence[str] = CLOUD) -> DataFrame:
    """Least and greatest coordinates of each cloud; NaN and null ones do not count."""
    clean = points.select(*owner, *(F.when(~F.isnan(a), F.col(a).cast("double")).alias(a) for a in "xyz"))
    return clean.groupBy(*owner).agg(*(f(a).alias(f"{a}_{n}") for a in "xyz" for f, n in ((F.min, "min"), (F.max, "max"))), F.count("x").alias("points"))


def union_clouds(points: DataFrame, size: Sequence[float], origin: Sequence[float], event: str = "event_id") -> DataFrame:
    """One cloud per event: voxels over all particles, with the particle that has most energy in each (ties: the lower id)."""
    per = voxelize(points, size, origin, (event, "particle_id"))
    return per.groupBy(event, "vx", "vy", "vz").agg(F.min("t").alias("t"), F.sum("de").alias("de"), F.sum("dx").alias("dx"), F.min(F.struct((-F.col("de")).alias("m"), F.col("particle_id"))).alias("top")).select(event, "vx", "vy", "vz", "t", "de", "dx", F.col("top.particle_id").alias("particle_id"))

"""Readout: groups, hits and pixels. Array-coded inputs are decoded by explode, everything else is equi-joins and aggregates on (event, group)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import entry_charge
from .skew import running


def association_owner(slices: DataFrame, event: str = "event_id") -> DataFrame:
    """event, ``step``, ``owner``: the row whose [start, end) slice holds the step; the later row where slices overlap. Empty slices own nothing."""
    steps = slices.where(F.col("end") > F.col("start")).select(event, "row", F.explode(F.sequence(F.col("start"), F.col("end") - 1)).alias("step"))
    return steps.groupBy(event, "step").agg(F.max("row").alias("owner"))


def decode_hits(groups: DataFrame, entries: DataFrame, keys: Sequence[str], order: str = "position", bits: int = 16, signed: bool = True, absolute: bool = False) -> DataFrame:
    """Hits of run-length coded groups: centre plus delta, charge = peak * fraction.

    :param groups: keys, ``group_no`` (order of the groups), ``group_id``, ``group_size``, ``center_py``, ``center_pz``, ``center_times``, ``peak_charges``
    :param entries: keys, ``position`` (0, 1, ...), ``delta_py``, ``delta_pz``, ``delta_times``, ``fraction``

    Each group owns as many entries as its size, in order. Where sizes and entries do not add up, or positions do not count from 0, the query fails; a surplus of whole 256s is named, for sizes
    that were stored in one byte.
    """
    started = running(groups, keys, ["group_no"], {"first": F.col("group_size")}).withColumn("first", F.col("first") - F.coalesce("group_size", F.lit(0)))
    n = entries.groupBy(*(F.col(k).alias(f"n_{k}") for k in keys)).agg(F.count(F.lit(1)).alias("entries"), F.sum(order).alias("sum"))
    told = groups.groupBy(*keys).agg(F.sum("group_size").alias("told"))
    both = told.join(n, [F.col(k) == F.col(f"n_{k}") for k in keys], "left").withColumn("lost", F.coalesce("entries", F.lit(0)) - F.coalesce("told", F.lit(0)))
    message = F.concat(F.lit("group sizes and entries differ: "), F.when((F.col("lost") > 0) & (F.col("lost") % 256 == 0), F.concat((F.col("lost") / 256).cast("int").cast("string"), F.lit(" x 256 lost"))).otherwise(F.col("lost").cast("string")))
    checked = both.select(*(F.col(k).alias(f"c_{k}") for k in keys), F.when((F.col("lost") != 0) | (F.col("sum") * 2 != F.col("entries") * (F.col("entries") - 1)), F.raise_error(message).cast("boolean")).otherwise(True).alias("fits")).where("fits")
    spread = started.where("group_size > 0").select(*keys, "group_id", "center_py", "center_pz", "center_times", "peak_charges", F.explode(F.sequence(F.col("first"), F.col("first") + F.col("group_size") - 1)).alias("at"))
    e = entries.select(*(F.col(k).alias(f"e_{k}") for k in keys), F.col(order).cast("bigint").alias("e_at"), "delta_py", "delta_pz", "delta_times", "fraction")
    met = spread.join(e, [*(F.col(k) == F.col(f"e_{k}") for k in keys), F.col("at") == F.col("e_at")]).join(checked, [F.col(k) == F.col(f"c_{k}") for k in keys])
    return met.select(*keys, F.col("at").alias("csr_pos"), "group_id", *((F.col(f"center_{c}").cast("int") + F.col(f"delta_{c}")).alias(n) for c, n in (("py", "py"), ("pz", "pz"), ("times", "tick"))), entry_charge(F.col("peak_charges"), F.col("fraction"), bits, signed, absolute).alias("charge"))


def decode_deltas(rows: DataFrame, keys: Sequence[str], order: str, values: dict[str, str], starts: dict[str, Column | int]) -> DataFrame:
    """Running sums of deltas: keys, ``order`` and for each output name start + the sum of its delta column up to the row, in 64 bits."""
    ran = running(rows.select(*keys, order, *(F.col(c).cast("bigint").alias(f"d_{n}") for n, c in values.items())), keys, [order], {n: F.col(f"d_{n}") for n in values})
    return ran.select(*keys, order, *((F.col(n) + starts[n]).alias(n) for n in values))


def on_sensor(hits: DataFrame, pixels: DataFrame, keys: Sequence[str], pixel: Sequence[str] = ("py", "pz", "tick"), threshold: float | None = None, keep_off: bool = False) -> DataFrame:
    """Hits on pixels that the sensor kept (``keep_off``: all, with the flag ``on_sensor``), then those of at least the threshold in size of charge."""
    on = [*keys, *pixel]
    p = pixels.select(*(F.col(k).alias(f"p_{k}") for k in on)).distinct()
    same = [F.col(k) == F.col(f"p_{k}") for k in on]
    if keep_off:
        out = hits.join(p, same, "left").select(*hits.columns, F.col(f"p_{on[0]}").isNotNull().alias("on_sensor"))
    else:
        out = hits.join(p, same, "left_semi")
    return out if threshold is None else out.where(F.abs("charge") >= threshold)


def visible(deposits: DataFrame, hit_groups: DataFrame, keys: Sequence[str] = ("event_id", "volume", "group_id")) -> DataFrame:
    """Deposits whose group fired on any plane."""
    return deposits.join(hit_groups.select(*(F.col(k).alias(f"v_{k}") for k in keys)).distinct(), [F.col(k) == F.col(f"v_{k}") for k in keys], "left_semi")


def attach_tracks(groups: DataFrame, tracks: DataFrame, group_track: str = "group_to_track", track: str = "track_id", event: str = "event_id") -> tuple[DataFrame, DataFrame]:
    """Groups whose track exists, with the track's columns prefixed with track_, and per event how many have none (``unmatched``)."""
    t = tracks.select(*(F.col(c).alias(f"track_{c}") for c in tracks.columns))
    on = [F.col(event) == F.col(f"track_{event}"), F.col(group_track) == F.col(f"track_{track}")]
    none = groups.join(t, on, "left_anti").groupBy(event).agg(F.count(F.lit(1)).alias("unmatched"))
    return groups.join(t, on), none


def owners(rows: DataFrame, mode: str = "majority", event: str = "event_id", group: str = "group_id", particle: str = "particle_id", position: str | None = None) -> DataFrame:
    """event, ``group``, ``owner``, ``straddled``: the particle a readout group belongs to.

    :param mode: ``first``: the particle that comes first in the list (``position``, by default the id); ``majority``: for groups over several particles, the one with most rows, then the first; ``check``: fail where a group is over several
    """
    n = rows.where(F.col(group) >= 0).groupBy(event, group, particle).agg(F.count(F.lit(1)).alias("n"), F.min(position or particle).alias("pos"))
    first = F.min(F.struct("pos", particle))[particle]
    most = F.min(F.struct((-F.col("n")).alias("m"), F.col("pos"), F.col(particle)))[particle]
    out = n.groupBy(event, group).agg(F.when(F.count(F.lit(1)) > 1, most if mode == "majority" else first).otherwise(first).alias("owner"), (F.count(F.lit(1)) > 1).alias("straddled"))
    if mode == "check":
        bad = F.raise_error(F.concat(F.lit("group over several particles: "), F.col(group).cast("string"))).cast("boolean")
        out = out.where(F.when(F.col("straddled"), bad).otherwise(True))
    return out


def hit_labels(hits: DataFrame, owners_: DataFrame, membership: DataFrame, event: str = "event_id", group: str = "group_id") -> DataFrame:
    """Hits with ``fragment_id``, ``instance_id`` (-1: none, or off the sensor where there is a flag for it) and ``is_le``."""
    o = owners_.select(F.col(event).alias("o_e"), F.col(group).alias("o_g"), "owner")
    m = membership.select(F.col(event).alias("m_e"), "particle_id", "frag_id", "inst_id", F.col("is_le").alias("m_le"))
    lab = o.join(m, (F.col("o_e") == F.col("m_e")) & (F.col("owner") == F.col("particle_id"))).select("o_e", "o_g", "frag_id", "inst_id", "m_le")
    on = F.col("on_sensor") if "on_sensor" in hits.columns else F.lit(True)
    met = hits.join(lab, (F.col(event) == F.col("o_e")) & (F.col(group) == F.col("o_g")), "left")
    return met.select(*hits.columns, F.when(on, F.coalesce("frag_id", F.lit(-1))).otherwise(-1).alias("fragment_id"), F.when(on, F.coalesce("inst_id", F.lit(-1))).otherwise(-1).alias("instance_id"), F.coalesce(on & F.col("m_le"), F.lit(False)).alias("is_le"))


def contained(positions: DataFrame, ranges: DataFrame, keys: Sequence[str], at: str, label: str) -> DataFrame:
    """positions with the ``label`` of the range [start, end) that holds them, null if none: an as-of walk over both in order, without a range join. Ranges of one key do not overlap."""
    p = positions.select(*keys, F.col(at).cast("bigint").alias("at"), F.lit(1).alias("kind"), F.lit(None).cast("bigint").alias("stop"), F.lit(None).cast(ranges.schema[label].dataType).alias("lab"))
    r = ranges.where("end > start").select(*keys, F.col("start").cast("bigint").alias("at"), F.lit(0).alias("kind"), F.col("end").cast("bigint").alias("stop"), F.col(label).alias("lab"))
    last = running(p.unionByName(r), keys, ["at", "kind"], lasts={"last": F.when(F.col("kind") == 0, F.struct("stop", "lab"))})
    return last.where("kind = 1").select(*keys, F.col("at").alias(at), F.when(F.col("at") < F.col("last.stop"), F.col("last.lab")).alias(label))


def paired_entries(events: DataFrame, entries: DataFrame) -> DataFrame:
    """Events with their readout entry: by (job_id, job_event) where both have them, else by (source name, index in it). An entry found twice, or none, is an error.

    :param events: event_id, job_id, job_event, source, source_event; :param entries: entry, job_id, job_event, source, source_event
    """
    key = lambda p: F.when(F.col(f"{p}job_id").isNotNull() & F.col(f"{p}job_event").isNotNull(), F.concat_ws("/", F.lit("job"), f"{p}job_id", f"{p}job_event")).otherwise(F.concat_ws("/", F.lit("file"), F.element_at(F.split(f"{p}source", "/"), -1), f"{p}source_event"))
    e = entries.select(*(F.col(c).alias(f"e_{c}") for c in entries.columns)).withColumn("e_key", key("e_"))
    n = events.withColumn("key", key("")).join(e, F.col("key") == F.col("e_key"), "left").groupBy("event_id").agg(F.count("e_entry").alias("n"), F.min("e_entry").alias("entry"))
    wrong = F.raise_error(F.concat(F.lit("entries of event "), F.col("event_id").cast("string"), F.lit(": "), F.col("n").cast("string"))).cast("int")
    return n.select("event_id", F.when(F.col("n") == 1, F.col("entry")).otherwise(wrong).alias("entry"))


def zipped(left: DataFrame, right: DataFrame, keys: Sequence[str], left_order: str, right_order: str) -> DataFrame:
    """The k-th row of each key with the k-th of the other side: full outer, so that surplus rows show as nulls. Right columns come prefixed with z_."""
    number = lambda df, o: running(df, keys, [o], {"__k": F.lit(1)})
    r = number(right, right_order)
    r = r.select(*(F.col(c).alias(f"z_{c}") for c in r.columns))
    return number(left, left_order).join(r, [*(F.col(k) == F.col(f"z_{k}") for k in keys), F.col("__k") == F.col("z___k")], "full").drop("__k", "z___k")

"""What links readout to truth: decoded positions, steps behind segments, deposits behind groups, planes, and pixel hits as points. Equi-joins on keys and running numbers; no event is handled in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import drift_position
from .readout import decode_hits, on_sensor, zipped
from .skew import running
from .spatial import box_outlines, points_in_regions

#: Numbers of the readout planes by name. Fixed values; others are numbered after the known ones that a volume has, by name.
PLANES = {"U": 0, "V": 1, "Y": 2, "Pixel": 0}


def decoded_positions(segments: DataFrame, step: Column | float, origin: Sequence[Column | float], raw: Sequence[str] = ("ix", "iy", "iz"), names: Sequence[str] = ("x", "y", "z")) -> DataFrame:
    """Segments with positions in mm: whole steps times the step's size, from the origin, as floats. Null counts stay null."""
    return segments.withColumns({n: (F.col(r) * step + o).cast("float") for n, r, o in zip(names, raw, origin)})


def deposit_tracks(deposits: DataFrame, lookup: DataFrame, keys: Sequence[str] = ("event_id", "volume")) -> DataFrame:
    """Deposits (keys, ``group_id``) with the ``track_id`` of their group by ``lookup`` (keys, ``group_id``, ``track_id``); -1 where the group is none of the lookup's, or has no track."""
    on = [*keys, "group_id"]
    right = lookup.select(*(F.col(k).alias(f"l_{k}") for k in on), F.col("track_id").alias("l_track"))
    return deposits.join(right, [F.col(k) == F.col(f"l_{k}") for k in on], "left").select(*deposits.columns, F.coalesce("l_track", F.lit(-1)).alias("track_id"))


def group_offsets(lookup: DataFrame, event: str = "event_id", volume: str = "volume") -> DataFrame:
    """event, volume, ``offset``: how many groups the event's volumes before this one have, which makes group numbers unique in the event. A window over one row per volume."""
    n = lookup.groupBy(event, volume).agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(event).orderBy(volume).rowsBetween(Window.unboundedPreceding, -1)
    return n.select(event, volume, F.coalesce(F.sum("n").over(w), F.lit(0)).alias("offset"))


def matched_steps(steps: DataFrame, segments: DataFrame, boxes: DataFrame, tolerance: float = 1.0) -> DataFrame:
    """The step that each segment was made from: event_id, volume, ``step_no``, ``segment_no``, ``off`` (greatest difference of a coordinate, mm).

    :param steps: event_id, ``step_no`` (position in the event), x, y, z in mm
    :param segments: event_id, volume, ``segment_no`` (position in the volume), x, y, z in mm
    :param boxes: volume, x_min .. z_max in mm; lower faces belong to a box, upper ones do not

    Steps are put into volumes as the readout simulation does, in cm and single precision; the k-th step of a volume is then its k-th segment. Where their numbers differ, or a pair lies farther apart than the
    tolerance, the plan fails and says so. Volumes without segments are passed over. Steps with a null or NaN coordinate are in no volume.
    """
    cm = steps.select("event_id", "step_no", *(F.col(a).cast("float").alias(a) for a in "xyz"), *((F.col(a).cast("float") / F.lit(10.0).cast("float")).cast("float").alias(f"c{a}") for a in "xyz"))
    scaled = boxes.select("volume", *((F.col(f"{a}_{m}") / 10.0).alias(f"{a}_{m}") for a in "xyz" for m in ("min", "max")))
    held = points_in_regions(cm, box_outlines(scaled, "volume", ("x_min", "x_max"), ("y_min", "y_max"), ("z_min", "z_max")), "cx", "cy", "cz", region="volume", key=["event_id", "step_no"])
    told = segments.groupBy(F.col("event_id").alias("t_e"), F.col("volume").alias("t_v")).agg(F.count(F.lit(1)).alias("told"))
    inside = held.join(told.select("t_e", "t_v"), (F.col("event_id") == F.col("t_e")) & (F.col("volume") == F.col("t_v")), "left_semi").select("event_id", "volume", "step_no", "x", "y", "z")
    pairs = zipped(inside, segments.select("event_id", "volume", "segment_no", "x", "y", "z"), ["event_id", "volume"], "step_no", "segment_no")
    off = F.greatest(*(F.abs(F.col(a).cast("double") - F.col(f"z_{a}").cast("double")) for a in "xyz"))
    where = F.concat(F.lit("event "), F.coalesce("event_id", "z_event_id").cast("string"), F.lit(", volume "), F.coalesce("volume", "z_volume").cast("string"))
    lone = F.raise_error(F.concat(where, F.lit(": steps and segments differ in number"))).cast("double")
    far = F.raise_error(F.concat(where, F.lit(": a segment is off its step by mm "), off.cast("string"))).cast("double")
    checked = F.when(F.col("event_id").isNull() | F.col("z_event_id").isNull(), lone).when(off > tolerance, far).otherwise(off)
    return pairs.select(F.coalesce("event_id", "z_event_id").alias("event_id"), F.coalesce("volume", "z_volume").alias("volume"), "step_no", F.col("z_segment_no").alias("segment_no"), checked.alias("off"))


def truth_segments(pairs: DataFrame, steps: DataFrame, groups: DataFrame, offsets: DataFrame) -> DataFrame:
    """Segments with the values of their step at full precision: event_id, volume, segment_no, ``group`` (unique in the event), x, y, z in mm, ``t`` in us (from ns), ``de``, ``dx`` in cm (from mm), theta, phi, p.

    :param pairs: as ``matched_steps`` gives them; :param steps: event_id, step_no and the values; :param groups: event_id, volume, segment_no, group_id; :param offsets: as ``group_offsets`` gives them
    """
    s = steps.select(F.col("event_id").alias("s_e"), F.col("step_no").alias("s_no"), "x", "y", "z", (F.col("t") / 1000.0).cast("float").alias("t"), "de", (F.col("dx") / 10.0).cast("float").alias("dx"), "theta", "phi", "p")
    g = groups.select(F.col("event_id").alias("g_e"), F.col("volume").alias("g_v"), F.col("segment_no").alias("g_no"), "group_id")
    o = offsets.select(F.col("event_id").alias("o_e"), F.col("volume").alias("o_v"), "offset")
    met = pairs.join(s, (F.col("event_id") == F.col("s_e")) & (F.col("step_no") == F.col("s_no"))).join(g, (F.col("event_id") == F.col("g_e")) & (F.col("volume") == F.col("g_v")) & (F.col("segment_no") == F.col("g_no")), "left").join(o, (F.col("event_id") == F.col("o_e")) & (F.col("volume") == F.col("o_v")), "left")
    return met.select("event_id", "volume", "segment_no", (F.col("group_id") + F.coalesce("offset", F.lit(0))).alias("group"), "x", "y", "z", "t", "de", "dx", "theta", "phi", "p")


def step_groups(steps: DataFrame, pairs: DataFrame, groups: DataFrame, fired: DataFrame) -> DataFrame:
    """Every step (event_id, step_no) with the ``volume`` and ``group_id`` of its segment (-1: in no volume) and whether the readout saw it: ``seen``, its group is among the fired ones (event_id, volume, group_id)."""
    g = groups.select(F.col("event_id").alias("g_e"), F.col("volume").alias("g_v"), F.col("segment_no").alias("g_no"), "group_id")
    f = fired.select(F.col("event_id").alias("f_e"), F.col("volume").alias("f_v"), F.col("group_id").alias("f_g")).distinct()
    held = pairs.join(g, (F.col("event_id") == F.col("g_e")) & (F.col("volume") == F.col("g_v")) & (F.col("segment_no") == F.col("g_no"))).join(f, (F.col("event_id") == F.col("f_e")) & (F.col("volume") == F.col("f_v")) & (F.col("group_id") == F.col("f_g")), "left")
    h = held.select(F.col("event_id").alias("h_e"), F.col("step_no").alias("h_s"), F.col("volume").alias("h_v"), F.col("group_id").alias("h_g"), F.col("f_g").isNotNull().alias("h_seen"))
    met = steps.select("event_id", "step_no").join(h, (F.col("event_id") == F.col("h_e")) & (F.col("step_no") == F.col("h_s")), "left")
    return met.select("event_id", "step_no", F.coalesce("h_v", F.lit(-1)).alias("volume"), F.coalesce("h_g", F.lit(-1)).alias("group_id"), F.coalesce("h_seen", F.lit(False)).alias("seen"))


def step_owners(steps: DataFrame, tracks: DataFrame) -> DataFrame:
    """event_id, step_no, ``owner``: the row (``row_idx``) of the track that made the step, the first of several; -1 for none."""
    t = tracks.groupBy(F.col("event_id").alias("t_e"), F.col("track_id").alias("t_t")).agg(F.min("row_idx").alias("row"))
    return steps.join(t, (F.col("event_id") == F.col("t_e")) & (F.col("track_id") == F.col("t_t")), "left").select("event_id", "step_no", F.coalesce("row", F.lit(-1)).alias("owner"))


def plane_numbers(planes: DataFrame, keys: Sequence[str] = ("event_id", "volume"), name: str = "plane") -> DataFrame:
    """keys, ``name``, ``number`` of the planes that each volume has. The window is over the planes of one volume."""
    known = F.create_map(*(F.lit(x) for kv in PLANES.items() for x in kv))[F.col(name)]
    p = planes.select(*keys, name).distinct().withColumn("known", known)
    w = Window.partitionBy(*keys)
    return p.select(*keys, name, F.coalesce("known", F.count("known").over(w) + F.sum(F.col("known").isNull().cast("int")).over(w.orderBy(F.col("known").isNotNull(), name).rowsBetween(Window.unboundedPreceding, 0)) - 1).cast("int").alias("number"))


def plane_entries(groups: DataFrame, offsets: DataFrame) -> DataFrame:
    """Every entry of every plane, in the order of the file: event_id, volume, ``plane`` (its number), ``source`` (its name), ``entry_no``, ``group`` (unique in the event).

    :param groups: event_id, volume, ``plane`` (name), ``group_no`` (order in the plane), ``group_id``, ``group_size``
    """
    keys = ["event_id", "volume", "plane"]
    n = plane_numbers(groups).select(F.col("event_id").alias("n_e"), F.col("volume").alias("n_v"), F.col("plane").alias("n_p"), "number")
    o = offsets.select(F.col("event_id").alias("o_e"), F.col("volume").alias("o_v"), "offset")
    placed = running(groups.select(*keys, "group_no", "group_id", "group_size"), keys, ["group_no"], {"end": F.col("group_size")}).where("group_size > 0")
    each = placed.select(*keys, "group_id", F.explode(F.sequence(F.col("end") - F.col("group_size"), F.col("end") - 1)).alias("entry_no"))
    met = each.join(n, (F.col("event_id") == F.col("n_e")) & (F.col("volume") == F.col("n_v")) & (F.col("plane") == F.col("n_p"))).join(o, (F.col("event_id") == F.col("o_e")) & (F.col("volume") == F.col("o_v")), "left")
    return met.select("event_id", "volume", F.col("number").alias("plane"), F.col("plane").alias("source"), "entry_no", (F.col("group_id") + F.coalesce("offset", F.lit(0))).alias("group"))


def pixel_hits(groups: DataFrame, entries: DataFrame, sensor: DataFrame | None, tracks: DataFrame, geometry: dict[str, Column], volumes: DataFrame, threshold: float | None = None, bits: int = 16, signed: bool = True) -> DataFrame:
    """Detected hits as points: event_id, volume, ``csr_pos``, ``group_id``, ``track_id`` (of the group, -1: none), ``x``, ``y``, ``z``, ``t`` (tick times time step), ``de`` (charge), ``outside``.

    :param groups: as ``decode_hits`` takes them, keyed by event_id and volume, with ``group_to_track``
    :param sensor: event_id, volume, py, pz, tick that the sensor kept; hits off it, and then those of less than the threshold in size, are dropped; None: no mask
    :param volumes: ``volume`` and the columns that ``geometry`` is made of, with x_min and x_max
    """
    keys = ("event_id", "volume")
    hits = decode_hits(groups, entries, keys, bits=bits, signed=signed)
    if sensor is not None:
        hits = on_sensor(hits, sensor, keys, threshold=threshold)
    elif threshold is not None:
        hits = hits.where(F.abs("charge") >= threshold)
    lookup = groups.select(*keys, "group_id", F.col("group_to_track").alias("track_id")).join(tracks.select(F.col("event_id").alias("t_e"), F.col("track_id").alias("t_t")).distinct(), (F.col("event_id") == F.col("t_e")) & (F.col("track_id") == F.col("t_t")), "left_semi")
    v = volumes.withColumnRenamed("volume", "v_volume")
    placed = deposit_tracks(hits, lookup, keys).join(v, F.col("volume") == F.col("v_volume"))
    x, y, z = drift_position(F.col("py"), F.col("pz"), F.col("tick"), geometry)
    return placed.select(*keys, "csr_pos", "group_id", "track_id", x.alias("x"), y.alias("y"), z.alias("z"), (F.col("tick") * geometry["time_step"]).alias("t"), F.col("charge").alias("de"), ((x < F.col("x_min")) | (x > F.col("x_max"))).alias("outside"))

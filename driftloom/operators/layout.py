"""Storage order, rows and ranges of an event's output, and the checks on them. Running sums over an event are range partitioned (``running``), so an event may hold any share of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..store import Workspace
from .genealogy import nearest_marked, true_ancestors, with_ancestors
from .skew import running

ORDER = ("interaction_id", "inst_id", "is_le", "frag_id", "particle_id")


def fenceposts(counts: DataFrame, keys: Sequence[str], order: Sequence[str], n: str = "n") -> DataFrame:
    """``start`` and ``end`` of each row's slice when slices of ``n`` follow each other within ``keys`` in ``order``."""
    return running(counts, keys, order, {"end": F.col(n)}).withColumn("start", F.col("end") - F.col(n))


def storage_ranges(particles: DataFrame, event: str = "event_id") -> DataFrame:
    """``particles`` (with the columns of ORDER and ``n`` points) and where its points lie in the event: ``pc_start``, ``pc_end``."""
    return fenceposts(particles, (event,), ORDER).withColumnsRenamed({"start": "pc_start", "end": "pc_end"})


def group_spans(ranges: DataFrame, group: Sequence[str], check: bool = True) -> DataFrame:
    """Span of each group over its members with points: ``start``, ``end``, ``le_start`` (where its low-energy members begin, ``end`` if none), (-1, -1) for one without points. A group that is not contiguous is an error."""
    full = F.col("n") > 0
    out = ranges.groupBy(*group).agg(
        F.min(F.when(full, F.col("pc_start"))).alias("start"), F.max(F.when(full, F.col("pc_end"))).alias("end"), F.min(F.when(full & F.col("is_le"), F.col("pc_start"))).alias("le_start"), F.sum("n").alias("n")
    )
    if check:
        bad = F.raise_error(F.concat(F.lit("a group is not contiguous: "), F.to_json(F.struct(*group)))).cast("boolean")
        out = out.where(F.when(F.col("end") - F.col("start") != F.col("n"), bad).otherwise(True))
    return out.select(*group, F.coalesce("start", F.lit(-1)).alias("start"), F.coalesce("end", F.lit(-1)).alias("end"), F.coalesce("le_start", "end", F.lit(-1)).alias("le_start"))


def running_base(sizes: DataFrame, event: str = "event_id", n: str = "n", width: int = 4096) -> DataFrame:
    """``b_e``, ``base``: how many rows the events before each one have. In two levels: sums over ranges of ``width`` events first, so that no window sees more than ``width`` rows, or a row per range."""
    s = sizes.select(F.col(event).alias("b_e"), F.col(n).alias("b_n"), F.floor(F.col(event) / width).alias("block"))
    before = lambda *by: Window.partitionBy(*by).rowsBetween(Window.unboundedPreceding, -1)
    blocks = s.groupBy("block").agg(F.sum("b_n").alias("all")).select(F.col("block").alias("of"), F.coalesce(F.sum("all").over(before().orderBy("block")), F.lit(0)).alias("ahead"))
    inside = s.withColumn("base", F.coalesce(F.sum("b_n").over(before("block").orderBy("b_e")), F.lit(0)))
    return inside.join(blocks, F.col("block") == F.col("of")).select("b_e", (F.col("base") + F.col("ahead")).alias("base"))


def absolute(ranges: DataFrame, sizes: DataFrame, columns: Sequence[str], event: str = "event_id") -> DataFrame:
    """Ranges within an event as ranges in the file, events in order of id; -1 stays. ``sizes``: event, ``n``, one row per event."""
    met = ranges.join(running_base(sizes, event), F.col(event) == F.col("b_e"))
    return met.select(*(F.when(F.col(c) >= 0, F.col(c) + F.col("base")).otherwise(F.col(c)).alias(c) if c in columns else F.col(c) for c in ranges.columns))


def relative(ranges: DataFrame, sizes: DataFrame, columns: Sequence[str], event: str = "event_id") -> DataFrame:
    """What ``absolute`` does, undone: ranges in the file as ranges within their event."""
    met = ranges.join(running_base(sizes, event), F.col(event) == F.col("b_e"))
    return met.select(*(F.when(F.col(c) >= 0, F.col(c) - F.col("base")).otherwise(F.col(c)).alias(c) if c in columns else F.col(c) for c in ranges.columns))


def overlaps(ranges: DataFrame, keys: Sequence[str], label: str) -> DataFrame:
    """Neighbouring ranges that overlap: keys, ``label``, ``next_label``, ``start``, ``end``, ``next_start``. Empty and absent ones do not count."""
    full = ranges.where("start >= 0 and end > start").select(*keys, F.col(label).alias("lab"), "start", "end").withColumns({f"m_{c}": -F.col(c) for c in ("start", "end", "lab")})
    # backwards, so that the last range seen before is the next one
    n = running(full, keys, ["m_start", "m_end", "m_lab"], {"no": F.lit(1)})
    nxt = n.select(*(F.col(k).alias(f"x_{k}") for k in keys), (F.col("no") + 1).alias("x_no"), F.col("lab").alias("next_label"), F.col("start").alias("next_start"))
    met = n.join(nxt, [*(F.col(k).eqNullSafe(F.col(f"x_{k}")) for k in keys), F.col("no") == F.col("x_no")])
    return met.where("next_start < end").select(*keys, F.col("lab").alias(label), "next_label", "start", "end", "next_start")


def stored_rows(particles: DataFrame, keep: DataFrame | None = None, event: str = "event_id") -> DataFrame:
    """Which particles get a row: those with points, heads of fragments and instances, all ancestors of those, and kept ids (event, id).

    :param particles: event, id, parent_id, n (points), frag_id, inst_id (of the particle's groups)
    """
    from .hierarchy import resolve_hierarchy

    own = particles.where((F.col("n") > 0) | (F.col("frag_id") == F.col("id")) | (F.col("inst_id") == F.col("id"))).select(event, "id")
    ids = own if keep is None else own.unionByName(keep.select(event, "id"))
    r = Workspace(particles.sparkSession, "rows").keep(resolve_hierarchy(particles, "id", "parent_id", (event,), path=True))
    return with_ancestors(r, ids.select(event, "id"), "id", "parent_id", (event,)).join(
        particles.select(F.col(event).alias("k_e"), F.col("id").alias("k_id")), (F.col(event) == F.col("k_e")) & (F.col("id") == F.col("k_id")), "left_semi"
    )


def redirected(particles: DataFrame, event: str = "event_id") -> DataFrame:
    """event, id, ``parent_id`` (the nearest ancestor with a row, itself if none) and ``ancestor_id`` (the root of that chain) of the particles with ``stored``."""
    near = nearest_marked(particles, "id", "parent_id", "stored", (event,)).select(F.col(event).alias("n_e"), F.col("id").alias("n_id"), "nearest")
    rows = particles.where("stored").join(near, (F.col(event) == F.col("n_e")) & (F.col("id") == F.col("n_id"))).select(event, "id", F.coalesce("nearest", "id").alias("parent_id"))
    root = true_ancestors(rows, "id", "parent_id", (event,)).select(F.col(event).alias("r_e"), F.col("id").alias("r_id"), "root_id")
    return rows.join(root, (F.col(event) == F.col("r_e")) & (F.col("id") == F.col("r_id"))).select(event, "id", "parent_id", F.col("root_id").alias("ancestor_id"))


def group_parents(particles: DataFrame, head: str, event: str = "event_id") -> DataFrame:
    """event, id, ``group_parent`` for heads of groups at a level (boolean ``head``): the nearest ancestor that heads one, itself if none."""
    near = nearest_marked(particles, "id", "parent_id", head, (event,)).select(F.col(event).alias("n_e"), F.col("id").alias("n_id"), "nearest")
    return particles.where(head).join(near, (F.col(event) == F.col("n_e")) & (F.col("id") == F.col("n_id"))).select(event, "id", F.coalesce("nearest", "id").alias("group_parent"))


def self_markers(membership: DataFrame) -> DataFrame:
    """``frag_id``/``inst_id`` as files hold them: the own id on the head's row, else -1; and how many members each head has (-1 on others). Members are counted by a hash aggregate that combines first."""
    out = membership
    for k in ("frag", "inst"):
        n = membership.groupBy(F.col("event_id").alias("n_e"), F.col(f"{k}_id").alias("n_g")).agg(F.count(F.lit(1)).alias("n"))
        out = out.join(n, (F.col("event_id") == F.col("n_e")) & (F.col("id") == F.col("n_g")) & (F.col(f"{k}_id") == F.col("id")), "left").withColumn(f"{k}_merge_count", F.coalesce("n", F.lit(-1))).drop("n_e", "n_g", "n")
    return out.withColumns({f"{k}_id": F.when(F.col(f"{k}_id") == F.col("id"), F.col("id")).otherwise(-1) for k in ("frag", "inst")})


def dense_ids(particles: DataFrame, order: Sequence[str], event: str = "event_id") -> DataFrame:
    """Ids from 0 in list order per event, with parents and ancestors mapped along; those that are absent become the particle itself."""
    n = running(particles, (event,), order, {"new_id": F.lit(1)}).withColumn("new_id", (F.col("new_id") - 1).cast("int"))
    ref = lambda p: n.select(F.col(event).alias(f"{p}_e"), F.col("id").alias(f"{p}_i"), F.col("new_id").alias(f"{p}_n"))
    met = n.join(ref("p"), (F.col(event) == F.col("p_e")) & (F.col("parent_id") == F.col("p_i")), "left").join(ref("a"), (F.col(event) == F.col("a_e")) & (F.col("ancestor_id") == F.col("a_i")), "left")
    return met.select(event, F.col("id").alias("old_id"), F.col("new_id").alias("id"), F.coalesce("p_n", "new_id").alias("parent_id"), F.coalesce("a_n", "new_id").alias("ancestor_id"))


def interaction_table(rows: DataFrame, spans: DataFrame, vertices: DataFrame | None = None, event: str = "event_id") -> DataFrame:
    """The interactions that a stored row belongs to, numbered from 0 in each event: event, ``interaction_id``, ``vertex_id`` (the number before), ``part_start``, ``part_end`` (its rows), ``pc_start``, ``pc_end`` (its points; -1 where all
    of them went to another interaction's groups), and the columns of ``vertices`` (event, ``vertex_row``, ...).

    :param rows: event, ``interaction_id``, ``row_no`` of the stored rows; :param spans: event, ``interaction_id`` (of the points' group), ``start``, ``end``
    """
    live = rows.where("interaction_id >= 0").groupBy(event, F.col("interaction_id").alias("vertex_id")).agg(F.min("row_no").alias("part_start"), (F.max("row_no") + 1).alias("part_end"))
    numbered = running(live, (event,), ["vertex_id"], {"no": F.lit(1)}).withColumn("interaction_id", (F.col("no") - 1).cast("int")).drop("no")
    s = spans.select(F.col(event).alias("s_e"), F.col("interaction_id").alias("s_i"), "start", "end")
    out = numbered.join(s, (F.col(event) == F.col("s_e")) & (F.col("vertex_id") == F.col("s_i")), "left").select(event, "interaction_id", "vertex_id", "part_start", "part_end", F.coalesce("start", F.lit(-1)).alias("pc_start"), F.coalesce("end", F.lit(-1)).alias("pc_end"))
    return with_vertices(out, vertices, event)


def with_vertices(interactions: DataFrame, vertices: DataFrame | None, event: str = "event_id") -> DataFrame:
    """The interactions with the further columns of the ``vertices`` (event, ``vertex_row``, ...) that they were numbered after; without any, as they are."""
    if vertices is None:
        return interactions
    v = vertices.select(F.col(event).alias("v_e"), F.col("vertex_row").alias("v_r"), *(c for c in vertices.columns if c not in (event, "vertex_row", *interactions.columns)))
    return interactions.join(v, (F.col(event) == F.col("v_e")) & (F.col("vertex_id") == F.col("v_r")), "left").drop("v_e", "v_r")


def first_last_steps(steps: DataFrame, instance: Sequence[str] = ("event_id", "inst_id"), time: str = "t", tie: str = "step_id", keep: Sequence[str] = ("x", "y", "z")) -> DataFrame:
    """First and last step of each instance by time, then by ``tie`` (``keep``: further columns of them): of its allowed steps (``allowed``), of all its steps if it has none of those. Showers (``is_shower``) have no last."""
    at = F.struct(F.col(time), F.col(tie), *keep)
    last = F.struct(F.col(time), (-F.col(tie)).alias("m"), F.col(tie), *keep)
    ok = F.coalesce(F.col("allowed"), F.lit(False))
    g = steps.groupBy(*instance).agg(F.coalesce(F.min(F.when(ok, at)), F.min(at)).alias("f"), F.coalesce(F.max(F.when(ok, last)), F.max(last)).alias("l"), F.max("is_shower").alias("s"))
    return g.select(*instance, *(F.col(f"f.{c}").alias(f"first_{c}") for c in (time, tie, *keep)), *(F.when(~F.col("s"), F.col(f"l.{c}")).alias(f"last_{c}") for c in (time, tie, *keep)))


def converted_end_momenta(tracks: DataFrame, event: str = "event_id") -> DataFrame:
    """event, track_id, end_px, end_py, end_pz, end_e: as recorded; for a photon that converts, its start less what its Compton electrons carried off."""
    from ..enums import PROCESS, SUBPROCESS

    em = PROCESS["electromagnetic"]
    d = lambda c: F.col(c).cast("double")
    lost = tracks.where((F.col("proc_start") == em) & (F.col("subproc_start") == SUBPROCESS["compton"])).groupBy(F.col(event).alias("l_e"), F.col("parent_track_id").alias("l_t")).agg(*(F.sum(d(c)).alias(f"l_{c}") for c in ("px", "py", "pz", "ke")))
    conv = (F.col("pdg") == 22) & (F.col("proc_end") == em) & (F.col("subproc_end") == SUBPROCESS["conversion"])
    met = tracks.join(lost, (F.col(event) == F.col("l_e")) & (F.col("track_id") == F.col("l_t")), "left")
    less = lambda c: F.coalesce(F.col(f"l_{c}"), F.lit(0.0))
    return met.select(event, "track_id", *(F.when(conv, d(c) - less(c)).otherwise(d(f"end_{c}")).alias(f"end_{c}") for c in ("px", "py", "pz")), F.when(conv, d("ke") + d("mass") - less("ke")).otherwise(d("end_ke") + d("mass")).alias("end_e"))

"""The whole run: from particles and their deposits to ordered, range-addressable tables.

Stages: voxelize; semantic types; split off small pieces; repair the genealogy; merge to fragments; give pieces back to their tracks and bury deltas;
merge to instances; keep what is traceable; order points and rows. Each stage is a library operator on DataFrames over all events at once.
"""

from __future__ import annotations

from dataclasses import asdict
from functools import reduce
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .enums import SEMANTIC
from .functions.columns import semantic_type
from .operators import bundles, clustering, genealogy, layout, points as P
from .operators.readout import owners
from .operators.skew import running
from .params import Params
from .sources import store as S
from .store import Workspace

LE = SEMANTIC["le_scatter"]


class Run(NamedTuple):
    """The tables of a run. ``converged``: whether merging came to an end by itself."""

    particles: DataFrame
    points: DataFrame
    interactions: DataFrame
    membership: DataFrame
    decisions: DataFrame
    voxmap: DataFrame
    pieces: DataFrame
    issues: DataFrame
    converged: bool


def _to(df: DataFrame, right: DataFrame, key: str, how: str = "left") -> DataFrame:
    """``df`` joined by (event_id, ``key``) with the first two columns of ``right``, which are dropped."""
    e, i = right.columns[:2]
    r = right.withColumnsRenamed({e: "__e", i: "__i"})
    return df.join(r, (F.col("event_id") == F.col("__e")) & (F.col(key) == F.col("__i")), how).drop("__e", "__i")


def run_events(particles: DataFrame, points: DataFrame, params: Params | None = None, vertices: DataFrame | None = None, keep: DataFrame | None = None, event_rows: int = bundles.EVENT_ROWS) -> Run:
    """Fragments, instances and their layout, of all events.

    :param particles: event_id, id, parent_id (null or itself: none), ancestor_id, pdg, parent_pdg, geant4_trackid, interaction_id, interaction_type; a row each
    :param points: event_id, particle_id, point_id (unique), x, y, z, t, de, dx
    :param vertices: event_id, vertex_row and what interactions are to carry of them
    :param keep: event_id, id of particles that get a row in any case
    :param event_rows: events of at most so many particles and voxels are run within a task (``operators.bundles``), larger ones by operators on tables; both give the same rows

    Points of unknown particles, and points with a null or NaN coordinate, are left out. Null pdg and kinds count as 0 and invalid. An event without points still has its primaries' rows where something of it is kept.
    """
    params = params or Params()
    spark = particles.sparkSession
    ws = Workspace(spark, "run")
    base = ws.keep(particles.select("event_id", "id", "parent_id", "ancestor_id", F.coalesce("pdg", F.lit(0)).alias("pdg"), F.coalesce("parent_pdg", F.lit(0)).alias("parent_pdg"), "geant4_trackid", F.coalesce("interaction_id", F.lit(-1)).alias("interaction_id"), F.coalesce(F.col("interaction_type").cast("int"), F.lit(13)).alias("interaction_type")))
    own = points.join(base.select(F.col("event_id").alias("o_e"), F.col("id").alias("o_i")), (F.col("event_id") == F.col("o_e")) & (F.col("particle_id") == F.col("o_i")), "left_semi")
    voxels = ws.keep(P.voxelize(own, params.voxel_size, params.voxel_origin, point="point_id"))

    extent = P.extent(voxels, params.extent_voxel()).select("event_id", "particle_id", "extent")
    kind = semantic_type(F.col("interaction_type"), F.col("pdg"), F.col("parent_pdg"), F.coalesce("extent", F.lit(0)), params.min_pc_size, strict=False)
    typed = ws.keep(_to(base, extent, "id").withColumn("sem_type", kind).drop("extent"))
    if not _can_bundle(typed, voxels, params):
        return _spread(typed, voxels, own, params, vertices, keep)[0]

    # events that a task may hold: small ones without crowds, whose rows have names of their own
    rows = typed.groupBy("event_id", "id").agg(F.count(F.lit(1)).alias("k")).groupBy("event_id").agg(F.sum("k").alias("rows"), (F.max("k") > 1).alias("repeated"), F.bool_or(F.col("id").isNull()).alias("unnamed"))
    clouds = voxels.groupBy(F.col("event_id").alias("v_e")).agg(F.count(F.lit(1)).alias("v"), F.bool_or(F.col("point_id").isNull()).alias("v_unnamed"))
    odd = F.col("repeated") | F.col("unnamed") | F.coalesce("v_unnamed", F.lit(False)) | F.col("event_id").isNull()
    sizes = ws.keep(rows.join(clouds, F.col("event_id") == F.col("v_e"), "left").select("event_id", (F.col("rows") + F.coalesce("v", F.lit(0))).alias("rows"), odd.alias("odd")), sized=True)
    large = (F.col("rows") > event_rows) | F.col("odd")
    doubtful = sizes.where(~large & (F.col("rows") * F.col("rows") > bundles.EVENT_PAIRS)).select(F.col("event_id").alias("d_e"))  # smaller events cannot have as many pairs
    crowds = voxels.join(doubtful, F.col("event_id") == F.col("d_e"), "left_semi").groupBy(F.col("event_id").alias("c_e"), *(F.floor(F.col(a).cast("double") / params.distance_threshold) for a in "xyz")).agg(F.count(F.lit(1)).alias("v"))
    crowds = crowds.groupBy("c_e").agg(F.sum(F.col("v") * F.col("v")).alias("pairs")).where(F.col("pairs") > bundles.EVENT_PAIRS)
    sizes = ws.keep(sizes.join(crowds, F.col("event_id") == F.col("c_e"), "left").select("event_id", "rows", (large | F.col("c_e").isNotNull()).alias("large")), sized=True)
    n = sizes.agg(F.count_if("large").alias("large"), F.coalesce(F.sum(F.when(~F.col("large"), F.col("rows"))), F.lit(0)).alias("small")).first()
    if not n["large"]:
        run = _at_once([_bundled(typed, voxels, points, params, vertices, keep, n["small"])])
        for done in (base, voxels, typed):  # the tables of the run hold all of them
            ws.forget(done)
        return run
    which = sizes.where("large").select(F.col("event_id").alias("w_e"))
    of = lambda how: (df.join(which, F.col("event_id").eqNullSafe(F.col("w_e")), how) for df in (typed, voxels, own))
    parts = [_spread(*of("left_semi"), params, vertices, keep)]
    if n["small"]:
        parts.append(_bundled(*of("left_anti"), params, vertices, keep, n["small"]))
    return _at_once(parts)


def _can_bundle(typed: DataFrame, voxels: DataFrame, params: Params) -> bool:
    """Whether ids are whole numbers and the rules those that bundles know, in an order in which an event that merges nothing in a pass is done."""
    whole = all(typed.schema[c].dataType.simpleString() in ("int", "bigint", "smallint", "tinyint") for c in typed.columns) and voxels.schema["point_id"].dataType.simpleString() in ("int", "bigint")
    return whole and set(params.rules) <= set(clustering.RULES) and "photon_decay" not in params.rules[1:]


def _at_once(parts: list[tuple[Run, int]]) -> Run:
    """The runs of several sets of events as one. Passes are those of all events: pairs that an event tries again in passes that only others need are told again."""
    most = max(passes for _, passes in parts)
    told = []
    for run, passes in parts:
        d = run.decisions
        if "last" not in d.columns:
            d = d.withColumn("last", F.lit(run.converged) & (F.col("pass_no") == passes))
        again = F.when(F.col("last"), F.sequence(F.col("pass_no"), F.lit(most))).otherwise(F.array("pass_no"))
        told.append(run._replace(decisions=d.select("event_id", "child", "parent", "rule", F.explode(again).alias("pass_no"), "outcome")))
    both = {k: reduce(DataFrame.unionByName, (getattr(r, k) for r in told)) for k in Run._fields if k != "converged"}
    return Run(**both, converged=all(r.converged for r in told))


def _bundled(typed: DataFrame, voxels: DataFrame, points: DataFrame, params: Params, vertices: DataFrame | None, keep: DataFrame | None, rows: int) -> tuple[Run, int]:
    """The run of small events, each within a task, and the passes that they took; decisions have ``last``, true for those of an event's last pass."""
    ws = Workspace(typed.sparkSession, "bundles")
    many = max(1, rows // bundles.BUNDLE_ROWS)
    bundle = F.pmod(F.xxhash64("event_id"), F.lit(many)).alias("bundle")
    people = typed.withColumn("asked", F.lit(False))
    if keep is not None:
        people = people.unionByName(keep.select("event_id", "id", F.lit(True).alias("asked")), allowMissingColumns=True)
    clouds = voxels.select(bundle, "event_id", "particle_id", "point_id", "x", "y", "z")

    def run(a: pa.Table, b: pa.Table) -> pa.Table:
        return bundles.run_bundle(a, b, params)

    all_ = ws.keep(people.select(bundle, "*").groupBy("bundle").cogroup(clouds.groupBy("bundle")).applyInArrow(run, bundles.SCHEMA))
    kind = lambda k: all_.where(F.col("kind") == k)
    end = kind("end").agg(F.max("n").alias("passes"), F.bool_and("last").alias("converged")).first()
    passes = end["passes"] if end["passes"] is not None else min(1, params.max_passes)
    converged = end["converged"] if end["converged"] is not None else params.max_passes > 0

    of = {c: typed.schema[c].dataType for c in typed.columns} | {"point_id": voxels.schema["point_id"].dataType}
    as_ = lambda c, like, name=None: F.col(c).cast(of.get(like, like)).alias(name or c)
    event, id_ = as_("event_id", "event_id"), lambda c, name=None: as_(c, "id", name)
    p = kind("particle")
    out = p.where("stored").select(
        event, as_("row_no", "int"), id_("id"), as_("geant4_trackid", "geant4_trackid"), id_("parent_id"), id_("ancestor_id"), as_("pdg", "pdg"), as_("parent_pdg", "pdg"), as_("interaction_id", "int"), as_("interaction_type", "interaction_type"), as_("sem_type", "sem_type"), "pc_start", "pc_end",
        id_("frag_id"), as_("frag_sem", "sem_type"), "frag_pc_start", "frag_pc_end", "frag_merge_count", id_("frag_parent_id"), id_("frag_inst_id"), id_("inst_id"), as_("inst_sem", "sem_type"), "inst_pc_start", "inst_pc_le_start", "inst_pc_end", "inst_merge_count", id_("inst_parent_id"),
    )
    membership = p.select(event, id_("id"), id_("in_frag", "frag_id"), id_("in_inst", "inst_id"), "is_le", as_("of_frag_sem", "sem_type", "frag_sem"), as_("of_inst_sem", "sem_type", "inst_sem"), "n")
    interactions = layout.with_vertices(kind("interaction").select(event, as_("interaction_id", "int"), as_("id", "interaction_id", "vertex_id"), as_("row_no", "int", "part_start"), as_("n", "int", "part_end"), "pc_start", "pc_end"), vertices)
    decisions = kind("decision").select(event, id_("id", "child"), id_("parent_id", "parent"), F.col("code").alias("rule"), as_("n", "int", "pass_no"), "outcome", "last")
    pieces = kind("piece").select(event, as_("id", "int", "new_id"), id_("parent_id", "particle_id"), F.col("n").alias("points"))
    issues = kind("issue").select(event, id_("id"), "code")

    moved = ws.keep(kind("moved").select(F.col("event_id").alias("m_e"), F.col("point_id").alias("m_p"), id_("id", "new_id")), sized=True)
    cloud = voxels.join(moved, (F.col("event_id") == F.col("m_e")) & (F.col("point_id") == F.col("m_p")), "left")
    cloud = ws.keep(cloud.withColumns({"made_by": F.col("particle_id"), "particle_id": F.coalesce("new_id", "particle_id")}).drop("m_e", "m_p", "new_id"))
    ws.forget(moved)
    start = p.where("n > 0").select(F.col("event_id").alias("s_e"), id_("id", "s_i"), "pc_start")
    no = F.row_number().over(Window.partitionBy("event_id", "particle_id").orderBy("point_id"))  # of a small event
    placed = cloud.join(start, (F.col("event_id") == F.col("s_e")) & (F.col("particle_id") == F.col("s_i")))
    stored_points = placed.select("event_id", (F.col("pc_start") + no - 1).alias("point_row"), "particle_id", "point_id", "x", "y", "z", "t", "de", "dx", F.col("n"))
    return Run(out, stored_points, interactions, membership, decisions, _bridge(cloud, points, params), pieces, issues, converged), passes


def _bridge(cloud: DataFrame, points: DataFrame, params: Params) -> DataFrame:
    """Which input points fell into each voxel, by the particle that has it now: event_id, particle_id, ``voxel_id``, point_id. Points of particles that the cloud has not are left out."""
    bridge = cloud.select("event_id", "made_by", "vx", "vy", "vz", F.col("point_id").alias("voxel_id"), "particle_id")
    inputs = P.voxmap(points, params.voxel_size, params.voxel_origin).withColumnsRenamed({"event_id": "i_e", "particle_id": "i_p", "vx": "i_x", "vy": "i_y", "vz": "i_z"})
    return bridge.join(inputs, (F.col("event_id") == F.col("i_e")) & (F.col("made_by") == F.col("i_p")) & (F.col("vx") == F.col("i_x")) & (F.col("vy") == F.col("i_y")) & (F.col("vz") == F.col("i_z"))).select("event_id", "particle_id", "voxel_id", "point_id")


def _spread(typed: DataFrame, voxels: DataFrame, own: DataFrame, params: Params, vertices: DataFrame | None, keep: DataFrame | None) -> tuple[Run, int]:
    """The run of events of any size by operators on tables, and the passes that it took."""
    ws = Workspace(typed.sparkSession, "run")
    moved, pieces = clustering.defragment(voxels.select("event_id", "particle_id", "point_id", "x", "y", "z"), typed, params)
    pieces = ws.keep(pieces)
    to = moved.select(F.col("event_id").alias("m_e"), F.col("point_id").alias("m_p"), "new_id")
    cloud = voxels.join(to, (F.col("event_id") == F.col("m_e")) & (F.col("point_id") == F.col("m_p")))
    cloud = ws.keep(cloud.select("event_id", F.col("new_id").alias("particle_id"), F.col("particle_id").alias("made_by"), "point_id", "vx", "vy", "vz", "x", "y", "z", "t", "de", "dx", "n"))
    made = _to(pieces.select("event_id", F.col("new_id").alias("id"), "particle_id"), typed.select("event_id", F.col("id").alias("of"), "ancestor_id", "pdg", "geant4_trackid", "interaction_id", "interaction_type"), "particle_id", "inner")
    spawned = made.select("event_id", "id", F.col("particle_id").alias("parent_id"), "ancestor_id", "pdg", F.col("pdg").alias("parent_pdg"), "geant4_trackid", "interaction_id", "interaction_type", F.lit(LE).alias("sem_type"))
    everyone = ws.keep(typed.unionByName(spawned))

    fixed = genealogy.resolve_orphans(everyone).select("event_id", "id", F.col("parent_id").alias("p"), F.col("ancestor_id").alias("a"))
    every = ws.keep(_to(everyone, fixed, "id").drop("parent_id", "ancestor_id").withColumnsRenamed({"p": "parent_id", "a": "ancestor_id"}))
    issues = ws.keep(genealogy.genealogy_issues(typed))

    f = clustering.merge_fixpoint(every, cloud.select("event_id", "particle_id", "point_id", "x", "y", "z"), params)
    state = ws.keep(f.state)
    reps = ws.keep(_to(every, state.where("particle_id = rep_id").select("event_id", "particle_id", F.col("sem_type").alias("s")), "id", "inner").drop("sem_type").withColumnRenamed("s", "sem_type"))

    cut = ws.keep(clustering.split_pieces(reps, state, every))
    reps = ws.keep(_to(reps, cut.select("event_id", "frag_id", F.col("sem_type").alias("s")), "id").withColumn("sem_type", F.coalesce("s", "sem_type")).drop("s"))
    members = state.select("event_id", "particle_id", "rep_id")
    buried = ws.keep(clustering.buried_deltas(reps, members, every, cloud.select("event_id", "particle_id", "x", "y", "z"), params.voxel_size[0], params.delta_min_standoff)) if params.delta_min_standoff > 0 else None
    if buried is not None:
        members = ws.keep(_to(members, buried.select("event_id", "frag_id", "home"), "rep_id").select("event_id", "particle_id", F.coalesce("home", "rep_id").alias("rep_id")))
        reps = ws.keep(reps.join(buried.select(F.col("event_id").alias("b_e"), F.col("frag_id").alias("b_f")), (F.col("event_id") == F.col("b_e")) & (F.col("id") == F.col("b_f")), "left_anti"))
    absorbed = ws.keep(clustering.absorbed_deltas(members, every))

    merged = clustering.merge_showers(reps, members)
    heads = ws.keep(merged)
    joined = _to(heads, cut.select("event_id", "frag_id", "home"), "frag_id")
    home = heads.select("event_id", F.col("frag_id").alias("of"), F.col("inst_id").alias("its"))
    heads = ws.keep(_to(joined, home, "home").select("event_id", "frag_id", F.coalesce("its", "inst_id").alias("inst_id")))

    frag_sem = reps.select("event_id", F.col("id").alias("f"), F.col("sem_type").alias("frag_sem"))
    within = _to(members.withColumnRenamed("rep_id", "frag_id"), heads, "frag_id")
    within = _to(_to(within, frag_sem, "frag_id"), reps.select("event_id", F.col("id").alias("i"), F.col("sem_type").alias("inst_sem"), F.col("interaction_id").alias("inst_interaction")), "inst_id")
    sizes = cloud.groupBy("event_id", "particle_id").agg(F.count(F.lit(1)).alias("n"))
    membership = ws.keep(_to(within, sizes, "particle_id").withColumns({"n": F.coalesce("n", F.lit(0)), "is_le": F.coalesce(F.col("frag_sem") == LE, F.lit(False))}).withColumnRenamed("particle_id", "id"))

    # which instances are written
    level = membership.select("event_id", F.col("id").alias("particle_id"), F.col("inst_id").alias("rep_id"))
    inst = membership.groupBy("event_id", "inst_id").agg((F.sum("n") > 0).alias("visible"), F.first("inst_interaction").alias("interaction_id"), F.first("inst_sem").alias("inst_sem"))
    up = clustering.homes(level, every, inst.select("event_id", F.col("inst_id").alias("child"))).select("event_id", "child", F.col("home").alias("parent_inst"))
    inst = ws.keep(_to(inst, up, "inst_id"))
    if params.drop_le:
        inst = inst.where(F.coalesce(F.col("inst_sem") != LE, F.lit(True)))
    kept = ws.keep(genealogy.traceable_instances(inst)) if params.traceable else inst.select("event_id", "inst_id")
    told = kept.select("event_id", F.col("inst_id").alias("k"), F.lit(True).alias("written"))
    membership = ws.keep(_to(membership, told, "inst_id").withColumn("written", F.coalesce("written", F.lit(False))))

    # order of points: interaction of the group, instance, low-energy last, fragment, particle
    grouped = F.when(F.col("written"), F.col("inst_id")).otherwise(F.col("frag_id"))
    owner = every.select("event_id", F.col("id").alias("g"), F.col("interaction_id").alias("interaction_id"))
    ordered = _to(membership.withColumn("group", grouped), owner, "group").select("event_id", F.col("id").alias("particle_id"), "interaction_id", F.when(F.col("written"), F.col("inst_id")).otherwise(F.col("id")).alias("inst_id"), "is_le", "frag_id", "n", "written")
    laid = ws.keep(layout.storage_ranges(ordered))
    frag_span = layout.group_spans(laid, ["event_id", "frag_id"], check=False).select("event_id", "frag_id", F.col("start").alias("frag_pc_start"), F.col("end").alias("frag_pc_end"))
    inst_span = layout.group_spans(laid.where("written"), ["event_id", "inst_id"], check=False).select("event_id", "inst_id", F.col("start").alias("inst_pc_start"), F.col("le_start").alias("inst_pc_le_start"), F.col("end").alias("inst_pc_end"))
    counts = lambda by, rows: rows.groupBy("event_id", by).agg(F.count(F.lit(1)).alias(f"{by[:4]}_merge_count"))

    forced = absorbed.select("event_id", "id")
    if buried is not None:
        forced = forced.unionByName(buried.select("event_id", F.col("frag_id").alias("id")))
    if keep is not None:
        forced = forced.unionByName(keep.select("event_id", "id"))
    heads_with_points = laid.where("n > 0").select("event_id", F.col("frag_id").alias("id")).distinct()
    seeds = ws.keep(heads_with_points.unionByName(kept.select("event_id", F.col("inst_id").alias("id"))).unionByName(forced).distinct())
    walked = ws.keep(genealogy.resolve_hierarchy(every, "id", "parent_id", ("event_id",), path=True))
    chains = genealogy.with_ancestors(walked, kept.select("event_id", F.col("inst_id").alias("id")), "id", "parent_id")
    stored = ws.keep(seeds.unionByName(chains).distinct())

    flagged = ws.keep(_to(every, stored.select("event_id", "id", F.lit(True).alias("stored")), "id").withColumn("stored", F.coalesce("stored", F.lit(False))))
    redirected = layout.redirected(flagged).select("event_id", "id", F.col("parent_id").alias("to_parent"), F.col("ancestor_id").alias("to_ancestor"))
    marked = membership.select("event_id", F.col("id").alias("mi"), (F.col("frag_id") == F.col("id")).alias("heads_frag"), ((F.col("inst_id") == F.col("id")) & F.col("written")).alias("heads_inst"), "frag_id", "inst_id", "frag_sem", "inst_sem", "written", "is_le")
    rows = _to(_to(flagged.where("stored"), redirected, "id").drop("parent_id", "ancestor_id").withColumnsRenamed({"to_parent": "parent_id", "to_ancestor": "ancestor_id"}), marked, "id")
    delta = absorbed.select("event_id", "id", F.lit(SEMANTIC["delta"]).alias("as_delta"))
    rows = ws.keep(_to(rows, delta, "id").withColumn("sem_type", F.coalesce("as_delta", "sem_type")).drop("as_delta"))
    parents = {}
    for k in ("frag", "inst"):
        parents[k] = layout.group_parents(rows, f"heads_{k}").select("event_id", "id", F.col("group_parent").alias(f"{k}_parent_id"))
    ranges = laid.select("event_id", "particle_id", "pc_start", "pc_end", F.col("interaction_id").alias("point_interaction"), F.col("inst_id").alias("o_inst"), F.col("is_le").alias("o_le"), F.col("frag_id").alias("o_frag"))
    rows = _to(rows, ranges, "id")
    for k, span, n in (("frag", frag_span, counts("frag_id", laid)), ("inst", inst_span, counts("inst_id", laid.where("written")))):
        rows = _to(_to(_to(rows, span, "id"), n, "id"), parents[k], "id")
    up_pdg = every.select("event_id", F.col("id").alias("u"), F.col("pdg").alias("up_pdg"))
    rows = _to(rows, up_pdg, "parent_id")
    order = ["interaction_id", "point_interaction", "o_inst", "o_le", "o_frag", "id"]
    rows = ws.keep(running(rows, ("event_id",), order, {"row_no": F.lit(1)}).withColumn("row_no", (F.col("row_no") - 1).cast("int")))
    spans = layout.group_spans(laid, ["event_id", "interaction_id"], check=False)
    interactions = ws.keep(layout.interaction_table(rows.select("event_id", "interaction_id", "row_no"), spans, vertices))
    dense = interactions.select("event_id", F.col("vertex_id").alias("v"), F.col("interaction_id").alias("dense"))
    none = F.lit(-1)
    at = lambda flag, value: F.when(F.coalesce(F.col(flag), F.lit(False)), F.col(value)).otherwise(none).alias(value)
    out = _to(rows, dense, "interaction_id").select(
        "event_id", "row_no", "id", "geant4_trackid", "parent_id", "ancestor_id", "pdg", F.col("up_pdg").alias("parent_pdg"), F.coalesce("dense", none).alias("interaction_id"), "interaction_type", "sem_type", "pc_start", "pc_end",
        F.when(F.col("heads_frag"), F.col("id")).otherwise(none).alias("frag_id"), at("heads_frag", "frag_sem"), at("heads_frag", "frag_pc_start"), at("heads_frag", "frag_pc_end"), at("heads_frag", "frag_merge_count"), at("heads_frag", "frag_parent_id"),
        F.when(F.col("heads_frag") & F.col("written"), F.col("inst_id")).otherwise(none).alias("frag_inst_id"),
        F.when(F.col("heads_inst"), F.col("id")).otherwise(none).alias("inst_id"), at("heads_inst", "inst_sem"), at("heads_inst", "inst_pc_start"), at("heads_inst", "inst_pc_le_start"), at("heads_inst", "inst_pc_end"), at("heads_inst", "inst_merge_count"), at("heads_inst", "inst_parent_id"),
    )
    start = laid.select("event_id", "particle_id", "pc_start")
    placed = running(cloud, ("event_id", "particle_id"), ["point_id"], {"no": F.lit(1)})
    stored_points = _to(placed, start, "particle_id", "inner").select("event_id", (F.col("pc_start") + F.col("no") - 1).alias("point_row"), "particle_id", "point_id", "x", "y", "z", "t", "de", "dx", "n")
    voxmap = _bridge(_to(cloud, laid.select("event_id", "particle_id"), "particle_id", "left_semi"), own, params)
    told = membership.select("event_id", "id", "frag_id", F.when(F.col("written"), F.col("inst_id")).otherwise(none).alias("inst_id"), "is_le", "frag_sem", "inst_sem", "n")
    return Run(out, stored_points, interactions, told, f.decisions, voxmap, pieces, issues, f.converged), f.passes


def group_owners(run: Run, deposits: DataFrame, mode: str = "majority") -> DataFrame:
    """event_id, group_id, ``fragment_id``, ``is_le``: which fragment each readout group belongs to. ``deposits``: event_id, point_id, group_id of the input points."""
    d = deposits.select(F.col("event_id").alias("d_e"), F.col("point_id").alias("d_p"), "group_id")
    held = run.voxmap.join(d, (F.col("event_id") == F.col("d_e")) & (F.col("point_id") == F.col("d_p"))).select("event_id", "group_id", "particle_id")
    own = owners(held, mode)
    m = run.membership.select(F.col("event_id").alias("m_e"), F.col("id").alias("m_i"), F.col("frag_id").alias("fragment_id"), "is_le")
    return own.join(m, (F.col("event_id") == F.col("m_e")) & (F.col("owner") == F.col("m_i"))).select("event_id", "group_id", "fragment_id", "is_le", "straddled")


def write_run(run: Run, root: str, params: Params, sources: DataFrame | None = None, codec: str = "lz4", buckets: int = S.BUCKETS) -> None:
    """The run as an event store: particles, points, interactions, membership, decisions, voxmap, issues, events (``sources``) and the parameters."""
    orders = {"particles": ["row_no"], "points": ["point_row"], "interactions": ["interaction_id"], "membership": ["id"], "decisions": ["pass_no", "rule", "child"], "voxmap": ["voxel_id", "point_id"], "issues": ["id", "code"]}
    for name, order in orders.items():
        S.write_table(getattr(run, name), root, name, order, codec, buckets, parts=None)
    if sources is not None:
        S.write_table(sources, root, "events", (), codec, buckets)
    S.write_meta(run.particles.sparkSession, root, asdict(params) | {"converged": run.converged})

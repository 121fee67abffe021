"""Queries of the engine's own operators over the given tables, and the SQL that gives the same rows.

Each query drives a library operator through a mapping of the tables onto its input; the mappings are the helpers at the top.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..enums import INTERACTION, SEMANTIC
from ..functions import columns as C
from ..operators import clustering, genealogy, geometry, layout, points as P, readout, reports
from ..operators.components import connected_components
from ..operators.spatial import box_outlines, matched, points_in_regions, standoff, touching
from ..params import Params
from ..sources import store as S
from ..tables import no_parent, standing, table
from ..training import training_voxels
from .oracle import SQL as SQL

SIZE, ORIGIN = (3.0, 3.0, 3.0), (-2160.0, -2160.0, -2160.0)
DISTANCE = 5.2


# ---- the tables in their roles


def _points(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    """Points, each once (repeated rows are equal)."""
    return table(spark, d, "points").select("event_id", "particle_id", "point_id", *(columns or ("x", "y", "z", "t", "de", "dx"))).dropDuplicates(["point_id"])


def _tracks(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    s = standing(table(spark, d, "geant4"), ["event_id", "track_id"], ["parent_track_id", *columns, "dropped"])
    return s.where(~F.coalesce("dropped", F.lit(False))).drop("dropped").withColumn("parent_track_id", no_parent(F.col("parent_track_id"), F.col("track_id")))


def _particles(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    s = standing(table(spark, d, "particles"), ["event_id", "id"], ["parent_id", *columns])
    return s.withColumn("parent_id", no_parent(F.col("parent_id"), F.col("id")))


def _groups(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    return standing(table(spark, d, "inst_groups"), ["event_id", "group_id"], ["volume", "group_to_track", *columns])


def _merged(spark: SparkSession, d: str) -> DataFrame:
    """Fragments by the stored decisions: event_id, id, frag_id."""
    pairs = table(spark, d, "merge_decisions").where(reports.outcome(F.col("reason")) == "MERGED")
    g = connected_components(pairs, "id1", "id2", ("event_id",), "g_id", "frag").select(F.col("event_id").alias("g_e"), "g_id", "frag")
    p = _particles(spark, d, "sem_type", "interaction_id", "interaction_type", "pdg", "parent_pdg", "geant4_trackid", "ancestor_id")
    return p.join(g, (F.col("event_id") == F.col("g_e")) & (F.col("id") == F.col("g_id")), "left").drop("g_e", "g_id").withColumn("frag_id", F.coalesce("frag", "id")).drop("frag")


def _membership(spark: SparkSession, d: str) -> DataFrame:
    """event_id, id, parent_id, frag_id, inst_id, sem_type, interaction_id, is_le: a low-energy particle is in the fragment of its parent where that is not low-energy itself, others head one of their own;
    instances are the fragments of one stored ancestor. All but the ids are those of the fragment's head."""
    p = _particles(spark, d, "sem_type", "interaction_id", "ancestor_id")
    le = lambda c: F.coalesce(F.col(c) == SEMANTIC["le_scatter"], F.lit(False))
    up = p.select(F.col("event_id").alias("u_e"), F.col("id").alias("u_id"), F.col("sem_type").alias("u_sem"), F.col("interaction_id").alias("u_inter"), F.col("ancestor_id").alias("u_anc")).where(~le("u_sem"))
    m = p.join(up, (F.col("event_id") == F.col("u_e")) & (F.col("parent_id") == F.col("u_id")) & le("sem_type"), "left")
    held = F.col("u_id").isNotNull()
    of = lambda own, its: F.when(held, F.col(its)).otherwise(F.col(own))
    return m.select("event_id", "id", "parent_id", of("id", "u_id").alias("frag_id"), F.coalesce(of("ancestor_id", "u_anc"), of("id", "u_id")).alias("inst_id"), of("sem_type", "u_sem").alias("sem_type"), of("interaction_id", "u_inter").alias("interaction_id"), (~held & le("sem_type")).alias("is_le"))


# ---- points


def voxel_label_events(spark: SparkSession, d: str) -> DataFrame:
    """Flagship: voxelize every cloud, then one row per voxel of an event with the label of the instance that wins it."""
    v = P.voxelize(_points(spark, d), SIZE, ORIGIN).select("event_id", "particle_id", "x", "y", "z", "t", "de", F.col("particle_id").alias("point_id"))
    out = training_voxels(v, _membership(spark, d).drop("parent_id", "frag_id"))
    return out.select("event_id", "x", "y", "z", F.round("energy", 3).alias("energy"), "points", F.col("sem_type").cast("int").alias("sem_type"), "inst_id", "interaction_id")


def training_without_le(spark: SparkSession, d: str) -> DataFrame:
    v = P.voxelize(_points(spark, d), SIZE, ORIGIN).select("event_id", "particle_id", "x", "y", "z", "t", "de", F.col("particle_id").alias("point_id"))
    out = training_voxels(v, _membership(spark, d).drop("parent_id", "frag_id"), include_le=False)
    return out.groupBy("event_id", F.col("sem_type").cast("int").alias("sem_type")).agg(F.count(F.lit(1)).alias("voxels"), F.round(F.sum("energy"), 2).alias("energy"))


def merge_duplicates(spark: SparkSession, d: str) -> DataFrame:
    m = P.merge_duplicates(_points(spark, d))
    return m.groupBy("event_id", "particle_id").agg(F.count(F.lit(1)).alias("points"), F.count_if(F.col("n") > 1).alias("merged"), F.round(F.sum("de"), 3).alias("energy"))


def voxelize_points(spark: SparkSession, d: str) -> DataFrame:
    v = P.voxelize(_points(spark, d), SIZE, ORIGIN)
    return v.select("event_id", "particle_id", "x", "y", "z", F.round(F.col("t").cast("double"), 4).alias("t"), F.round("de", 3).alias("de"), F.round("dx", 3).alias("dx"), "n")


def voxelize_own_origin(spark: SparkSession, d: str) -> DataFrame:
    v = P.voxelize(_points(spark, d), SIZE, None)
    return v.groupBy("event_id", "particle_id").agg(F.count(F.lit(1)).alias("voxels"), F.sum("n").alias("points"))


def voxmap_bridge(spark: SparkSession, d: str) -> DataFrame:
    return P.voxmap(_points(spark, d), SIZE, ORIGIN).select("event_id", "particle_id", "vx", "vy", "vz", "point_id")


def extent_by_particle(spark: SparkSession, d: str) -> DataFrame:
    return P.extent(_points(spark, d, "x", "y", "z"), 3.0)


def truth_voxel_earliest(spark: SparkSession, d: str) -> DataFrame:
    v = P.truth_voxels(_points(spark, d), SIZE, ORIGIN, ["dx"], "point_id")
    return v.select("event_id", "particle_id", "vx", "vy", "vz", F.round("de", 3).alias("de"), F.round(F.col("t").cast("double"), 4).alias("t"))


def union_clouds(spark: SparkSession, d: str) -> DataFrame:
    return P.union_clouds(_points(spark, d), SIZE, ORIGIN).select("event_id", "vx", "vy", "vz", F.round("de", 3).alias("de"), "particle_id")


def particle_boxes(spark: SparkSession, d: str) -> DataFrame:
    return P.bounding_boxes(_points(spark, d, "x", "y", "z"))


# ---- derivations


def _classified(spark: SparkSession, d: str) -> DataFrame:
    t = _tracks(spark, d, "pdg", "x", "y", "z", "ke", "proc_start", "subproc_start")
    up = genealogy.parent_values(t, "track_id", "parent_track_id", ["pdg", "x", "y", "z"])
    dr = F.when(F.col("parent_x").isNull(), -1.0).otherwise(F.sqrt(sum(((F.col(f"parent_{a}").cast("double") - F.col(a).cast("double")) * (F.col(f"parent_{a}").cast("double") - F.col(a).cast("double")) for a in "xyz"), F.lit(0.0))))
    return up.withColumns({"parent_pdg": F.coalesce("parent_pdg", F.lit(0)), "kind": C.interaction_type(F.col("parent_track_id").isNull(), F.coalesce("pdg", F.lit(0)), F.coalesce("parent_pdg", F.lit(0)), F.col("proc_start"), F.col("subproc_start"), dr, F.col("ke"))})


def interaction_types(spark: SparkSession, d: str) -> DataFrame:
    return _classified(spark, d).select("event_id", "track_id", "parent_pdg", F.col("kind").alias("interaction_type"))


def semantic_types(spark: SparkSession, d: str) -> DataFrame:
    ext = P.extent(_points(spark, d, "x", "y", "z"), 3.0).select(F.col("event_id").alias("x_e"), F.col("particle_id").alias("x_p"), "extent")
    p = _particles(spark, d, "pdg", "parent_pdg", "interaction_type").where("interaction_type not in (4, 6, 8, 12) or abs(pdg) in (11, 22)")
    m = p.join(ext, (F.col("event_id") == F.col("x_e")) & (F.col("id") == F.col("x_p")), "left").withColumn("extent", F.coalesce("extent", F.lit(0)))
    return m.select("event_id", "id", "extent", C.semantic_type(F.col("interaction_type"), F.col("pdg"), F.col("parent_pdg"), F.col("extent"), 5).alias("sem_type"))




def _geometry() -> dict:
    half = F.when(F.col("drift_dir") > 0, F.col("x_max")).otherwise(F.col("x_min"))
    return {"anode_x": half, "drift_dir": F.col("drift_dir"), "velocity": F.lit(1.6), "time_step": F.lit(0.5), "reference_tick": F.lit(100), "y_min": F.col("y_min"), "z_min": F.col("z_min"), "pitch_y": F.lit(4.0), "pitch_z": F.lit(4.0)}


def _placed(spark: SparkSession, d: str) -> DataFrame:
    g = _groups(spark, d, "center_py", "center_pz", "center_times", "peak_charges")
    return g.join(table(spark, d, "volumes"), F.col("volume") == F.col("volume_id"))


def _held(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    """Points with the volume that holds them, and its columns."""
    boxes = box_outlines(table(spark, d, "volumes"), "volume_id", ("x_min", "x_max"), ("y_min", "y_max"), ("z_min", "z_max"))
    held = points_in_regions(table(spark, d, "points").select("event_id", "particle_id", "point_id", *columns), boxes, region="v", key=["point_id"])
    return held.join(table(spark, d, "volumes"), F.col("v") == F.col("volume_id")).drop("v")


def drift_to_xyz(spark: SparkSession, d: str) -> DataFrame:
    g = _placed(spark, d)
    x, y, z = C.drift_position(F.col("center_py"), F.col("center_pz"), F.col("center_times"), _geometry())
    return g.select("event_id", "group_id", F.round(x, 4).alias("x"), F.round(y, 4).alias("y"), F.round(z, 4).alias("z"), C.outside(x, F.col("x_min"), F.col("x_max")).alias("outside"))


def window_truncation(spark: SparkSession, d: str) -> DataFrame:
    """Per volume: points that would be read out before the window, and after it."""
    held = _held(spark, d, "x", "y", "z", "t")
    tick = C.wanted_tick(F.col("x").cast("double"), F.col("t").cast("double"), _geometry())
    return held.groupBy("volume_id").agg(F.count(F.lit(1)).alias("points"), F.count_if(tick < 0).alias("before"), F.count_if(tick > 2000).alias("after"))


def converted_momenta(spark: SparkSession, d: str) -> DataFrame:
    t = standing(table(spark, d, "geant4"), ["event_id", "track_id"], ["parent_track_id", "pdg", "px", "py", "pz", "ke", "mass", "end_px", "end_py", "end_pz", "end_ke", "proc_start", "subproc_start", "proc_end", "subproc_end", "dropped"]).where("not dropped")
    m = layout.converted_end_momenta(t)
    return m.select("event_id", "track_id", *(F.round(c, 3).alias(c) for c in ("end_px", "end_py", "end_pz", "end_e")))


def step_ends(spark: SparkSession, d: str) -> DataFrame:
    """Ends of each track taken as one step, along its momentum."""
    t = _tracks(spark, d, "x", "y", "z", "t", "px", "py", "pz", "mass")
    p = F.sqrt(sum((F.col(c).cast("double") * F.col(c).cast("double") for c in ("px", "py", "pz")), F.lit(0.0)))
    theta = F.when(p > 0, F.acos(F.col("pz").cast("double") / p)).otherwise(0.0)
    phi = F.atan2(F.col("py").cast("double"), F.col("px").cast("double"))
    e = C.step_end(1, F.col("x"), F.col("y"), F.col("z"), F.col("t"), theta, phi, p, F.lit(10.0), F.col("mass"))
    return t.select("event_id", "track_id", e.alias("e")).select("event_id", "track_id", *(F.round(f"e.{c}", 2).alias(c) for c in ("x", "y", "z", "t", "e")))


def rounded_energy(spark: SparkSession, d: str) -> DataFrame:
    return _points(spark, d, "de").select("point_id", C.rounded_mantissa(F.col("de"), 10).alias("de"))


# ---- genealogy


def ancestor_root(spark: SparkSession, d: str) -> DataFrame:
    """The root of every track; of tracks that run in a circle or into one, the least id on the circle, without depth."""
    t = _tracks(spark, d)
    return genealogy.true_ancestors(t, "track_id", "parent_track_id").select("event_id", "track_id", "root_id", "depth")


def resolve_orphans(spark: SparkSession, d: str) -> DataFrame:
    p = _particles(spark, d, "ancestor_id")
    return genealogy.resolve_orphans(p)


def group_parents(spark: SparkSession, d: str) -> DataFrame:
    """Parents of instance heads, where every shower, track and Michel heads one."""
    p = _particles(spark, d, "sem_type").withColumn("head", F.coalesce(F.col("sem_type").isin(1, 2, 4), F.lit(False)))
    return layout.group_parents(p, "head")


def redirected_parents(spark: SparkSession, d: str) -> DataFrame:
    p = _particles(spark, d, "sem_type").withColumn("stored", ~F.coalesce(F.col("sem_type") == SEMANTIC["le_scatter"], F.lit(False)))
    return layout.redirected(p).select("event_id", "id", "parent_id")


def vertex_match(spark: SparkSession, d: str) -> DataFrame:
    """Tracks at the start of a top-level track of their event, the first such."""
    t = _tracks(spark, d, "x", "y", "z", "t")
    v = t.where("parent_track_id is null").select("event_id", F.col("track_id").alias("vertex_row"), "x", "y", "z", "t")
    m = matched(t.where("parent_track_id is null"), v, ["event_id"], [(c, c) for c in "xyzt"], "vertex_row")
    return m.select("event_id", "track_id", F.col("r_vertex_row").alias("vertex_row"))


def interaction_ids(spark: SparkSession, d: str) -> DataFrame:
    t = _tracks(spark, d, "x", "y", "z", "t")
    v = t.where("parent_track_id is null").select("event_id", F.col("track_id").alias("vertex_row"), F.col("track_id").alias("interaction_id"), "x", "y", "z", "t")
    return genealogy.interactions(t, v, "track_id", "parent_track_id").select("event_id", "track_id", "interaction_id")


def genealogy_issues(spark: SparkSession, d: str) -> DataFrame:
    i = genealogy.genealogy_issues(_particles(spark, d, "ancestor_id", "interaction_id"))
    return reports.issue_counts(i)


def traceable_instances(spark: SparkSession, d: str) -> DataFrame:
    """Particles as instances of their own, visible where their track has a readout group."""
    g = _groups(spark, d).where("group_to_track >= 0").select(F.col("event_id").alias("g_e"), F.col("group_to_track").alias("g_t")).distinct()
    p = _particles(spark, d, "geant4_trackid", "interaction_id").join(g, (F.col("event_id") == F.col("g_e")) & (F.col("geant4_trackid") == F.col("g_t")), "left").withColumn("visible", F.col("g_t").isNotNull())
    return genealogy.traceable_instances(p, "id", "parent_id").select("event_id", "id")


# ---- readout


def visible_groups(spark: SparkSession, d: str) -> DataFrame:
    """Groups of charge that some track of the event left."""
    g = _groups(spark, d, "peak_charges")
    fired = g.where("abs(peak_charges) >= 100").select("event_id", "volume", "group_id")
    return readout.visible(g, fired).select("event_id", "group_id", "group_to_track")


def attached_groups(spark: SparkSession, d: str) -> DataFrame:
    both, none = readout.attach_tracks(_groups(spark, d), _tracks(spark, d, "pdg").select("event_id", "track_id", "pdg"))
    n = both.groupBy("event_id").agg(F.count(F.lit(1)).alias("matched"))
    return n.join(none.withColumnRenamed("event_id", "n_e"), F.col("event_id") == F.col("n_e"), "full").select(F.coalesce("event_id", "n_e").alias("event_id"), F.coalesce("matched", F.lit(0)).alias("matched"), F.coalesce("unmatched", F.lit(0)).alias("unmatched"))


def sensor_mask(spark: SparkSession, d: str) -> DataFrame:
    g = _groups(spark, d, "center_py", "center_pz", "center_times", "peak_charges").select("event_id", "volume", "group_id", F.col("center_py").alias("py"), F.col("center_pz").alias("pz"), F.col("center_times").alias("tick"), F.col("peak_charges").alias("charge"))
    kept = g.where("volume % 2 = 0").select("event_id", "volume", "py", "pz", "tick")
    return readout.on_sensor(g, kept, ("event_id", "volume"), threshold=50.0, keep_off=True).select("event_id", "group_id", "on_sensor")


def csr_decode(spark: SparkSession, d: str) -> DataFrame:
    """Groups of one to four entries, coded as deltas from the group's centre; sizes, deltas and fractions follow from the centres."""
    g = _groups(spark, d, "center_py", "center_pz", "center_times", "peak_charges").withColumn("group_no", F.col("group_id")).withColumn("group_size", F.pmod(F.col("center_pz").cast("bigint"), F.lit(4)) + 1)
    first = F.coalesce(F.sum("group_size").over(Window.partitionBy("event_id").orderBy("group_id").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    e = g.withColumn("k", first).select("event_id", "k", "center_py", "center_times", F.explode(F.sequence(F.lit(0), (F.col("group_size") - 1).cast("int"))).alias("i"))
    mixed = lambda c, by, of: F.pmod(F.col(c).cast("int") + F.col("i") * by, F.lit(of)) - of // 2
    e = e.select("event_id", (F.col("k") + F.col("i")).alias("position"), mixed("center_py", 7, 23).alias("delta_py"), mixed("center_times", 5, 31).alias("delta_pz"), mixed("center_py", 11, 61).alias("delta_times"), (mixed("center_times", 4099, 65535)).alias("fraction"))
    h = readout.decode_hits(g, e, ("event_id",))
    return h.select("event_id", "group_id", "csr_pos", "py", "pz", "tick", F.round("charge", 4).alias("charge"))


def sensor_delta_decode(spark: SparkSession, d: str) -> DataFrame:
    g = _groups(spark, d, "center_py", "center_times")
    return readout.decode_deltas(g, ("event_id", "volume"), "group_id", {"py": "center_py", "tick": "center_times"}, {"py": 7, "tick": F.lit(-3)})


def group_owners(spark: SparkSession, d: str) -> DataFrame:
    """The particle of most points of each (volume, 100 mm slab of z): a group over many particles."""
    p = _held(spark, d, "x", "y", "z")
    rows = p.select("event_id", (F.col("volume_id") * 100 + F.floor((F.col("z") + 2200) / 100)).alias("group_id"), "particle_id")
    return readout.owners(rows, "majority").select("event_id", "group_id", "owner", "straddled")


def group_reductions(spark: SparkSession, d: str) -> DataFrame:
    r = P.group_reductions(_points(spark, d, "t", "de").where("not isnan(de)"), ["event_id", "particle_id"])
    return r.select("event_id", "particle_id", "t0", "de")


def shared_energy(spark: SparkSession, d: str) -> DataFrame:
    """The energy of all of each particle's points, shared over them by dx: a point without dx gets 0, its energy goes to the others."""
    number = lambda c: F.when(~F.isnan(c), F.col(c).cast("double"))
    p = _points(spark, d, "de", "dx").select("event_id", "particle_id", "point_id", number("de").alias("de"), number("dx").alias("charge"))
    g = p.groupBy("event_id", "particle_id").agg(F.coalesce(F.sum("de"), F.lit(0.0)).alias("de"))
    return P.shared_energy(p.drop("de"), g, ["event_id", "particle_id"]).select("point_id", "true_de")


def hit_labels(spark: SparkSession, d: str) -> DataFrame:
    g = _groups(spark, d)
    p = _particles(spark, d, "geant4_trackid")
    own = g.join(p.select(F.col("event_id").alias("p_e"), "geant4_trackid", F.col("id").alias("owner")), (F.col("event_id") == F.col("p_e")) & (F.col("group_to_track") == F.col("geant4_trackid"))).groupBy("event_id", "group_id").agg(F.min("owner").alias("owner"))
    return readout.hit_labels(g.select("event_id", "group_id"), own, _membership(spark, d).withColumnRenamed("id", "particle_id"))


# ---- proximity and clustering


def _clean(spark: SparkSession, d: str) -> DataFrame:
    return _points(spark, d, "x", "y", "z").where("x is not null and not isnan(z)")


def touching_particles(spark: SparkSession, d: str) -> DataFrame:
    t = touching(_clean(spark, d), DISTANCE, "point_id", "particle_id", ("event_id",))
    return t.select("event_id", "owner_a", "owner_b", F.round("distance", 5).alias("distance"))


def cloud_components(spark: SparkSession, d: str) -> DataFrame:
    c = clustering.cloud_components(_clean(spark, d), DISTANCE)
    return c.select("event_id", "particle_id", "point_id", "component")


def defragmented(spark: SparkSession, d: str) -> DataFrame:
    moved, _ = clustering.defragment(_clean(spark, d), _particles(spark, d, "sem_type"), Params())
    return moved.groupBy("event_id", "particle_id", "new_id").agg(F.count(F.lit(1)).alias("points"))


def combine_le(spark: SparkSession, d: str) -> DataFrame:
    """Low-energy particles in touch, as groups: what the rule merges in one pass."""
    p = _particles(spark, d, "sem_type").select("event_id", "id", "parent_id", F.coalesce("sem_type", F.lit(6)).alias("sem_type"))
    state = p.select("event_id", F.col("id").alias("particle_id"), F.col("id").alias("rep_id"))
    pairs = clustering.combine_le(state, p, _clean(spark, d), Params())
    return connected_components(pairs, "child", "parent", ("event_id",), "id", "group_id")


def absorb_le(spark: SparkSession, d: str) -> DataFrame:
    p = _particles(spark, d, "sem_type").select("event_id", "id", "parent_id", F.coalesce("sem_type", F.lit(6)).alias("sem_type"))
    state = p.select("event_id", F.col("id").alias("particle_id"), F.col("id").alias("rep_id"))
    return clustering.absorb_le(state, p, _clean(spark, d), Params())


def photon_decay(spark: SparkSession, d: str) -> DataFrame:
    p = _particles(spark, d, "pdg", "parent_pdg", "interaction_type", "geant4_trackid")
    state = p.select("event_id", F.col("id").alias("particle_id"), F.col("id").alias("rep_id"))
    return clustering.photon_decay(state, p, p, Params())


def merge_fixpoint(spark: SparkSession, d: str) -> DataFrame:
    """Fragments by all rules, to the fixpoint."""
    p = _particles(spark, d, "ancestor_id", "pdg", "parent_pdg", "geant4_trackid", "interaction_type", "sem_type").withColumn("sem_type", F.coalesce("sem_type", F.lit(6)))
    return clustering.merge_fixpoint(p, _clean(spark, d), Params()).state


def shower_instances(spark: SparkSession, d: str) -> DataFrame:
    f = _particles(spark, d, "pdg", "parent_pdg", "sem_type", "interaction_type").withColumn("sem_type", F.coalesce("sem_type", F.lit(6)))
    return clustering.merge_showers(f, f.select("event_id", F.col("id").alias("particle_id"), F.col("id").alias("rep_id")))


def absorbed_deltas(spark: SparkSession, d: str) -> DataFrame:
    """Low-energy particles in the fragment of their parent, taken as deltas by origin where their id is even."""
    p = _particles(spark, d, "sem_type").withColumns({"sem_type": F.coalesce("sem_type", F.lit(6)), "interaction_type": F.when(F.col("id") % 2 == 0, INTERACTION["delta"]).otherwise(INTERACTION["compton"])})
    return clustering.absorbed_deltas(_membership(spark, d).select("event_id", F.col("id").alias("particle_id"), F.col("frag_id").alias("rep_id")), p)


def nearest_standoff(spark: SparkSession, d: str) -> DataFrame:
    """How far each delta sticks out of its parent's cloud, within 30 mm."""
    delta = _particles(spark, d, "sem_type").where("sem_type = 3 and parent_id is not null").select(F.col("event_id").alias("d_e"), F.col("id").alias("child"), "parent_id")
    pts = _clean(spark, d)
    side = lambda by, n: pts.join(delta, (F.col("event_id") == F.col("d_e")) & (F.col("particle_id") == F.col(by))).select("event_id", "child", F.lit(n).alias("side"), "point_id", "x", "y", "z")
    s = standoff(side("child", 1).unionByName(side("parent_id", 2)), 30.0, ("event_id", "child"), "side", "point_id")
    return s.select("event_id", "child", "cells", F.round("standoff", 4).alias("standoff"))


def partition_stats(spark: SparkSession, d: str) -> DataFrame:
    return clustering.partition_stats(_merged(spark, d), "frag_id")


# ---- layout


def _laid(spark: SparkSession, d: str) -> DataFrame:
    m = _membership(spark, d)
    n = table(spark, d, "points").select("event_id", "particle_id", "point_id").distinct().groupBy(F.col("event_id").alias("n_e"), F.col("particle_id").alias("n_p")).agg(F.count(F.lit(1)).alias("n"))
    rows = m.join(n, (F.col("event_id") == F.col("n_e")) & (F.col("id") == F.col("n_p")), "left").select("event_id", F.col("id").alias("particle_id"), "interaction_id", "inst_id", "is_le", "frag_id", F.coalesce("n", F.lit(0)).alias("n"))
    return layout.storage_ranges(rows)


def storage_ranges(spark: SparkSession, d: str) -> DataFrame:
    return _laid(spark, d).select("event_id", "particle_id", "pc_start", "pc_end")


def instance_spans(spark: SparkSession, d: str) -> DataFrame:
    return layout.group_spans(_laid(spark, d), ["event_id", "interaction_id", "inst_id"])


def absolute_ranges(spark: SparkSession, d: str) -> DataFrame:
    laid = _laid(spark, d).select("event_id", "particle_id", "n", F.when(F.col("n") > 0, F.col("pc_start")).otherwise(-1).alias("pc_start"))
    return layout.absolute(laid.drop("n"), laid.groupBy("event_id").agg(F.sum("n").alias("n")), ["pc_start"])


def range_overlaps(spark: SparkSession, d: str) -> DataFrame:
    """Stored point ranges of an event that overlap."""
    p = table(spark, d, "particles").select("event_id", "id", "pc_offsets").dropDuplicates(["event_id", "id"]).where("size(pc_offsets) = 2").select("event_id", "id", F.col("pc_offsets")[0].alias("start"), (F.col("pc_offsets")[1] + 1).alias("end"))
    return layout.overlaps(p, ["event_id"], "id")


def contained_points(spark: SparkSession, d: str) -> DataFrame:
    """The particle whose stored range holds each point's row."""
    p = table(spark, d, "particles").select("event_id", "id", "pc_offsets").dropDuplicates(["event_id", "id"]).where("size(pc_offsets) = 2").select("event_id", "id", F.col("pc_offsets")[0].alias("start"), F.col("pc_offsets")[1].alias("end"))
    rows = table(spark, d, "points").select("event_id", "point_row").distinct()
    return readout.contained(rows, p, ["event_id"], "point_row", "id")


def first_last_points(spark: SparkSession, d: str) -> DataFrame:
    m = _membership(spark, d).select(F.col("event_id").alias("m_e"), "id", "inst_id", "is_le")
    s = _points(spark, d, "x", "t").join(m, (F.col("event_id") == F.col("m_e")) & (F.col("particle_id") == F.col("id"))).select("event_id", "inst_id", "t", "x", F.col("point_id").alias("step_id"), (~F.col("is_le")).alias("allowed"), F.lit(False).alias("is_shower"))
    return layout.first_last_steps(s, keep=("x",)).select("event_id", "inst_id", F.col("first_step_id").alias("first_point"), F.col("last_step_id").alias("last_point"))


def dense_ids(spark: SparkSession, d: str) -> DataFrame:
    return layout.dense_ids(_particles(spark, d, "ancestor_id"), ["id"])


def self_markers(spark: SparkSession, d: str) -> DataFrame:
    return layout.self_markers(_membership(spark, d).select("event_id", "id", "frag_id", "inst_id"))


def points_of_instances(spark: SparkSession, d: str) -> DataFrame:
    g = S.points_with_groups(_points(spark, d, "de"), _membership(spark, d), "inst").where(~F.col("is_le"))
    return g.groupBy("event_id", "group_id").agg(F.count(F.lit(1)).alias("points"))


# ---- reports, geometry, sources


def decision_summary(spark: SparkSession, d: str) -> DataFrame:
    return reports.decision_summary(table(spark, d, "merge_decisions"))


def not_merged(spark: SparkSession, d: str) -> DataFrame:
    """Decisions of pairs that no decision merged: why they were not."""
    return reports.never_merged(table(spark, d, "merge_decisions")).groupBy("outcome").agg(F.count_distinct("event_id", "lo", "hi").alias("pairs"))


def run_report(spark: SparkSession, d: str) -> DataFrame:
    m = _points(spark, d, "de").groupBy("event_id").agg(F.count(F.lit(1)).alias("points"), F.count_distinct("particle_id").alias("particles"))
    r = reports.run_report(m, ["points", "particles"])
    return r.select("metric", "least", F.round("mean", 6).alias("mean"), "most", "events")


def _with_track(spark: SparkSession, d: str) -> DataFrame:
    """Readout groups with the start of their track: pixel, tick, and where the charge came from."""
    both, _ = readout.attach_tracks(_groups(spark, d, "center_py", "center_times"), _tracks(spark, d, "x", "y", "t").select("event_id", "track_id", "x", "y", "t"))
    return both


def pitch_fit(spark: SparkSession, d: str) -> DataFrame:
    """Line through pixel number and position of the track, per volume."""
    f = geometry.line_fit(_with_track(spark, d), ["volume"], "center_py", "track_y")
    return f.select("volume", F.round("slope", 6).alias("slope"), F.round("intercept", 4).alias("intercept"), "n")


def plane_fit(spark: SparkSession, d: str) -> DataFrame:
    """Position of the track by tick and start time, per volume."""
    f = geometry.plane_fit(_with_track(spark, d), ["volume"], "center_times", "track_t", "track_x")
    return f.select("volume", F.round("b1", 6).alias("b1"), F.round("b2", 6).alias("b2"), F.round("b0", 4).alias("b0"), "n")


def residual_medians(spark: SparkSession, d: str) -> DataFrame:
    g = _groups(spark, d, "center_times", "peak_charges")
    r = geometry.residual_check(g, ["volume"], F.col("peak_charges").cast("double") - 100, 60.0)
    return r.select("volume", "n", F.round("median", 4).alias("median"), "ok")


def chained_inputs(spark: SparkSession, d: str) -> DataFrame:
    """Run events of two inputs, one after the other, with their events counted in each."""
    e = table(spark, d, "run_events").dropDuplicates(["event_id"])
    both = S.chained([e.where("input_no % 2 = 0").select("event_id", "job_id"), e.where("input_no % 2 = 1").select("event_id", "format_version")])
    return both.groupBy("input").agg(F.count(F.lit(1)).alias("events"), F.count("job_id").alias("with_job"), F.count("format_version").alias("with_version"))


def paired_entries(spark: SparkSession, d: str) -> DataFrame:
    """Every standing event that has an entry, with it: by job where given, else by a file of its own."""
    e = standing(table(spark, d, "run_events"), ["event_id"], ["input_no", "input_event", "jaxtpc_entry", "job_id", "job_event"]).where("jaxtpc_entry >= 0")
    rows = e.select("event_id", "job_id", "job_event", F.concat_ws("-", F.lit("/in/f"), "input_no", "event_id").alias("source"), F.col("input_event").alias("source_event"))
    return readout.paired_entries(rows, rows.select(F.col("event_id").alias("entry"), "job_id", "job_event", F.regexp_replace("source", "/in/", "/out/").alias("source"), "source_event"))


def store_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """Groups written to an event store, repacked with another codec, and compared: rows on either side, and rows that differ."""
    from ..store import Workspace

    ws = Workspace(spark, "roundtrip")
    g = _groups(spark, d, "peak_charges")
    S.write_table(g, ws.root, "groups", ["group_id"], buckets=4)
    S.repack(spark, f"{ws.root}/groups", f"{ws.root}/packed", "gzip")
    back = spark.read.parquet(f"{ws.root}/packed").select(*g.columns)
    one = lambda df, name: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("what"), "n")
    return one(g, "given").unionByName(one(back, "read")).unionByName(one(S.differences(back, g), "different"))


QUERIES = {
    f.__name__: f
    for f in (
        voxel_label_events, training_without_le, merge_duplicates, voxelize_points, voxelize_own_origin, voxmap_bridge, extent_by_particle, truth_voxel_earliest, union_clouds, particle_boxes,
        interaction_types, semantic_types, drift_to_xyz, window_truncation, converted_momenta, step_ends, rounded_energy, ancestor_root, resolve_orphans, group_parents, redirected_parents,
        vertex_match, interaction_ids, genealogy_issues, traceable_instances, visible_groups, attached_groups, sensor_mask, csr_decode, sensor_delta_decode, group_owners, group_reductions,
        shared_energy, hit_labels, touching_particles, cloud_components, defragmented, combine_le, absorb_le, photon_decay, merge_fixpoint, shower_instances, absorbed_deltas, nearest_standoff,
        partition_stats, storage_ranges, instance_spans, absolute_ranges, range_overlaps, contained_points, first_last_points, dense_ids, self_markers, points_of_instances, decision_summary,
        not_merged, run_report, pitch_fit, plane_fit, residual_medians, chained_inputs, paired_entries, store_roundtrip,
    )
}

"""More queries of the engine's operators over the given tables: readout against truth, genealogy tools, single rules, the store and the whole run. SQL beside each where SQL can state it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..enums import INTERACTION, SEMANTIC
from ..functions import columns as C
from ..operators import clustering, genealogy, geometry, kinematics, layout, points as P, readout, reports, truth
from ..operators.hierarchy import resolve_hierarchy
from ..params import Params
from ..run import Run, group_owners as owners_of_run, run_events
from ..sources import store as S
from ..sources.inputs import step_columns
from ..store import Workspace
from ..tables import no_parent, standing, table
from .oracle import CENTRES, GOOD, GRP, MEM, NEAR, PAR, PTS, TRK, VOLUME, VOXELS, _roots
from .queries import DISTANCE, ORIGIN, SIZE, _clean, _geometry, _groups, _held, _membership, _particles, _points, _tracks

# ---- steps, segments, planes


def step_projection(spark: SparkSession, d: str) -> DataFrame:
    """Points as steps whose columns go by other names, projected to the engine's."""
    named = _points(spark, d, "x", "y", "z", "t", "de").withColumnsRenamed({"t": "time", "de": "energy"})
    columns, missing = step_columns(named)
    return named.select("point_id", *columns, F.lit(",".join(missing)).alias("missing"))


def slice_owners(spark: SparkSession, d: str) -> DataFrame:
    """The particle whose stored slice holds each position; of several the last."""
    p = standing(table(spark, d, "particles"), ["event_id", "id"], ["pc_offsets"]).where("size(pc_offsets) = 2")
    return readout.association_owner(p.select("event_id", F.col("id").alias("row"), F.col("pc_offsets")[0].alias("start"), F.col("pc_offsets")[1].alias("end")))


def pixel_keys(spark: SparkSession, d: str) -> DataFrame:
    g = _groups(spark, d, "center_py", "center_pz", "center_times")
    return g.select("event_id", "group_id", C.pixel_key(F.col("center_py"), F.col("center_pz"), F.col("center_times")).alias("key"))


def nominal_positions(spark: SparkSession, d: str) -> DataFrame:
    """Where points appear to be, whose time is taken for drift time."""
    g = _geometry()
    return _held(spark, d, "x", "y", "z", "t").select("point_id", F.round(F.col("x").cast("double") + C.time_shift(F.col("t").cast("double"), g), 4).alias("x"), F.round(C.time_shift(F.col("t").cast("double"), g) * 10000).cast("bigint").alias("shift"))  # in 0.1 um


def _segments(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Points as steps, the segments made from those in a volume (positions in whole 0.5 mm steps), and the volumes."""
    v = table(spark, d, "volumes")
    steps = _points(spark, d, "x", "y", "z", "t", "de", "dx").select("event_id", F.col("point_id").alias("step_no"), "particle_id", "x", "y", "z", "t", "de", "dx")
    cm = v.select("volume_id", *((F.col(f"{a}_{m}") / 10.0).alias(f"{a}_{m}") for a in "xyz" for m in ("min", "max")))
    held = steps.where("x is not null and not isnan(x) and not isnan(y) and not isnan(z)").select("*", *((F.col(a) / F.lit(10.0).cast("float")).cast("float").alias(f"c{a}") for a in "xyz"))
    inside = held.join(cm, [(F.col(f"c{a}").cast("double") >= F.col(f"{a}_min")) & (F.col(f"c{a}").cast("double") < F.col(f"{a}_max")) for a in "xyz"])
    raw = inside.select("event_id", F.col("volume_id").alias("volume"), F.col("step_no").alias("segment_no"), *(F.rint((F.col(a).cast("double") + 2200) / 0.5).cast("int").alias(f"i{a}") for a in "xyz"), F.pmod("step_no", F.lit(7)).alias("group_id"))
    return steps, truth.decoded_positions(raw, 0.5, (-2200.0,) * 3), v.withColumnRenamed("volume_id", "volume")


def decoded_segments(spark: SparkSession, d: str) -> DataFrame:
    _, s, _ = _segments(spark, d)
    return s.select("event_id", "volume", "segment_no", "x", "y", "z")


def matched_steps(spark: SparkSession, d: str) -> DataFrame:
    """The step behind each segment."""
    steps, s, v = _segments(spark, d)
    m = truth.matched_steps(steps, s, v)
    return m.select("event_id", "volume", "step_no", "segment_no", (F.col("off") <= 0.26).alias("near"))


def truth_segments(spark: SparkSession, d: str) -> DataFrame:
    """Segments with the full-precision values of their step, and groups that are unique in the event."""
    steps, s, v = _segments(spark, d)
    s = Workspace(spark, "segments").keep(s)
    offsets = truth.group_offsets(s.select("event_id", "volume", "group_id").distinct())
    angles = steps.withColumns({"theta": F.lit(0.0), "phi": F.lit(0.0), "p": F.lit(1.0)})
    out = truth.truth_segments(truth.matched_steps(steps, s, v), angles, s, offsets)
    return out.select("event_id", "volume", "segment_no", "group", F.round(F.col("t").cast("double"), 6).alias("t"), "de", F.round(F.col("dx").cast("double"), 5).alias("dx"))


def visible_steps(spark: SparkSession, d: str) -> DataFrame:
    """Steps whose group fired, where groups 0 to 4 of even volumes did."""
    steps, s, v = _segments(spark, d)
    s = Workspace(spark, "segments").keep(s)
    fired = s.where("group_id < 5 and volume % 2 = 0").select("event_id", "volume", "group_id").distinct()
    return truth.step_groups(steps, truth.matched_steps(steps, s, v), s, fired)


def step_owners(spark: SparkSession, d: str) -> DataFrame:
    """The row of the track that made each step, by the particle's track."""
    p = _particles(spark, d, "geant4_trackid").select(F.col("event_id").alias("p_e"), "id", F.col("geant4_trackid").alias("track_id"))
    steps = _points(spark, d, "t").join(p, (F.col("event_id") == F.col("p_e")) & (F.col("particle_id") == F.col("id")), "left").select("event_id", F.col("point_id").alias("step_no"), "track_id")
    return truth.step_owners(steps, _tracks(spark, d, "row_idx"))


def deposit_tracks(spark: SparkSession, d: str) -> DataFrame:
    """The track of every group's deposits, one deposit per group and one whose group is unknown."""
    g = _groups(spark, d)
    deposits = g.select("event_id", "volume", "group_id").unionByName(g.select("event_id", "volume", (-F.col("group_id") - 1).alias("group_id")))
    return truth.deposit_tracks(deposits, g.select("event_id", "volume", "group_id", F.col("group_to_track").alias("track_id")))


def plane_entries(spark: SparkSession, d: str) -> DataFrame:
    """Entries of groups on planes that are named by the group's pixel: known planes, and two others."""
    g = _groups(spark, d, "center_py", "center_pz")
    name = F.element_at(F.array(*(F.lit(x) for x in ("Y", "A", "U", "B", "V"))), (F.pmod(F.col("center_py").cast("int"), F.lit(5)) + 1))
    rows = g.select("event_id", "volume", name.alias("plane"), F.col("group_id").alias("group_no"), "group_id", (F.pmod(F.col("center_pz").cast("int"), F.lit(3))).cast("bigint").alias("group_size"))
    return truth.plane_entries(rows, truth.group_offsets(g))


def pixel_hits(spark: SparkSession, d: str) -> DataFrame:
    """Groups of one entry each as detected hits: on the sensor where the volume is even, of at least 50 in size, with their track."""
    g = _groups(spark, d, "center_py", "center_pz", "center_times", "peak_charges").where("peak_charges is not null")
    g = readout.running(g, ("event_id", "volume"), ["group_id"], {"k": F.lit(1)}).select("*", F.col("group_id").alias("group_no"), F.lit(1).cast("bigint").alias("group_size"))
    g = Workspace(spark, "pixels").keep(g)
    e = g.select("event_id", "volume", (F.col("k") - 1).alias("position"), F.lit(1).alias("delta_py"), F.lit(-1).alias("delta_pz"), F.lit(2).alias("delta_times"), F.lit(32767).alias("fraction"))
    sensor = g.where("volume % 2 = 0").select("event_id", "volume", (F.col("center_py") + 1).alias("py"), (F.col("center_pz") - 1).alias("pz"), (F.col("center_times") + 2).alias("tick"))
    hits = truth.pixel_hits(g, e, sensor, _tracks(spark, d).select("event_id", "track_id"), _geometry(), table(spark, d, "volumes").withColumnRenamed("volume_id", "volume"), threshold=50.0)
    return hits.select("event_id", "volume", "csr_pos", "group_id", "track_id", *(F.round(a, 4).alias(a) for a in ("x", "y", "z", "t", "de")), "outside")


def hits_subset(spark: SparkSession, d: str) -> DataFrame:
    """The readout of the first 50 events, decoded with charges by size: the extract for short runs."""
    g = S.first_events(_groups(spark, d, "center_py", "center_pz", "center_times", "peak_charges").where("peak_charges is not null"), 50)
    g = readout.running(g, ("event_id",), ["group_id"], {"k": F.lit(1)}).select("*", F.col("group_id").alias("group_no"), F.lit(1).cast("bigint").alias("group_size"))
    g = Workspace(spark, "subset").keep(g)
    e = g.select("event_id", (F.col("k") - 1).alias("position"), F.lit(0).alias("delta_py"), F.lit(0).alias("delta_pz"), F.lit(0).alias("delta_times"), F.lit(-16000).alias("fraction"))
    h = readout.decode_hits(g, e, ("event_id",), absolute=True)
    return h.select("event_id", "csr_pos", "group_id", F.round("charge", 4).alias("charge"))


# ---- genealogy tools


def primary_mismatches(spark: SparkSession, d: str) -> DataFrame:
    """Where the tracks stored as their own root and the parentless ones disagree."""
    t = _tracks(spark, d, "root_track_id")
    listed = t.where("root_track_id = track_id").select("event_id", "track_id").unionByName(t.groupBy("event_id").agg((F.max("track_id") + 1).alias("track_id")))
    _, wrong = genealogy.primaries(t.select("event_id", "track_id", F.coalesce("parent_track_id", F.lit(-1)).alias("parent_track_id")), listed)
    return wrong


def issue_chains(spark: SparkSession, d: str) -> DataFrame:
    """Absent parents and loops with the chain of ids above them."""
    p = Workspace(spark, "chains").keep(_particles(spark, d, "ancestor_id", "interaction_id"))
    i = genealogy.genealogy_issues(p).where("code in ('absent_parent', 'loop')")
    return genealogy.issue_chains(i, p).select("event_id", "id", "code", "chain")


def michel_ancestry(spark: SparkSession, d: str) -> DataFrame:
    """The chains above all Michel electrons, root first."""
    r = resolve_hierarchy(_particles(spark, d, "sem_type"), "id", "parent_id", ("event_id",), carry=["sem_type"], unique=True)
    return genealogy.trace(r, F.col("sem_type") == SEMANTIC["michel"]).select("event_id", "id", "step", "step_id")


def direct_children(spark: SparkSession, d: str) -> DataFrame:
    p = Workspace(spark, "children").keep(_particles(spark, d, "sem_type"))
    return genealogy.children(p, p.where("sem_type = 2"), "id", "parent_id")


def stored_rows(spark: SparkSession, d: str) -> DataFrame:
    """Particles that get a row: heads and all above them, where every shower heads a fragment and nothing has points."""
    p = _particles(spark, d, "sem_type").select("event_id", "id", "parent_id", F.lit(0).alias("n"), F.when(F.col("sem_type") == 1, F.col("id")).otherwise(-1).alias("frag_id"), F.lit(-1).alias("inst_id"))
    return layout.stored_rows(p)


# ---- single rules


def partition_sem_types(spark: SparkSession, d: str) -> DataFrame:
    m = _membership(spark, d).select("event_id", F.col("id").alias("particle_id"), F.col("frag_id").alias("rep_id"), F.col("sem_type").cast("int").alias("sem_type"))
    return clustering.partitions_by_sem_type(m)


def partition_once(spark: SparkSession, d: str) -> DataFrame:
    """Particles and their parents, tried once by contact."""
    p = _particles(spark, d)
    ids = p.select(F.col("event_id").alias("i_e"), F.col("id").alias("i_i"))
    pairs = p.join(ids, (F.col("event_id") == F.col("i_e")) & (F.col("parent_id") == F.col("i_i"))).select("event_id", F.col("id").alias("child"), F.col("parent_id").alias("parent"))
    _, tried = clustering.partition_once(pairs, _clean(spark, d), DISTANCE)
    return tried


def sibling_groups(spark: SparkSession, d: str) -> DataFrame:
    """Siblings of one pdg as groups: any predicate on two rows, within the children of one parent."""
    p = _particles(spark, d, "pdg").where("parent_id is not null")
    return clustering.partition_custom(p, lambda a, b: a["pdg"] == b["pdg"], ("event_id", "parent_id"))


def shower_contacts(spark: SparkSession, d: str) -> DataFrame:
    """Electron and photon particles beside their parent's, tried by the shower rule."""
    p = _particles(spark, d, "sem_type", "pdg", "ancestor_id").withColumns({"sem_type": F.coalesce("sem_type", F.lit(6))})
    state = p.select("event_id", F.col("id").alias("particle_id"), F.col("id").alias("rep_id"))
    return clustering.touching_em(state, p, _clean(spark, d), Params())


def split_pieces(spark: SparkSession, d: str) -> DataFrame:
    """Low-energy particles as pieces of their parent's track."""
    p = _particles(spark, d, "sem_type", "pdg", "geant4_trackid")
    up = p.select(F.col("event_id").alias("u_e"), F.col("id").alias("u_i"), F.col("geant4_trackid").alias("u_t"))
    p = p.join(up, (F.col("event_id") == F.col("u_e")) & (F.col("parent_id") == F.col("u_i")), "left").withColumn("geant4_trackid", F.when(F.col("sem_type") == 5, F.coalesce("u_t", "geant4_trackid")).otherwise(F.col("geant4_trackid"))).drop("u_e", "u_i", "u_t")
    p = Workspace(spark, "pieces").keep(p)
    return clustering.split_pieces(p, p.select("event_id", F.col("id").alias("particle_id"), F.col("id").alias("rep_id")), p)


def buried_deltas(spark: SparkSession, d: str) -> DataFrame:
    """Deltas no cell of which is 8 mm or farther from the cloud of their parent."""
    p = _particles(spark, d, "sem_type", "interaction_type")
    p = Workspace(spark, "buried").keep(p)
    b = clustering.buried_deltas(p, p.select("event_id", F.col("id").alias("particle_id"), F.col("id").alias("rep_id")), p, _clean(spark, d), 3.0, 8.0)
    return b.select("event_id", "frag_id", "home", F.round("standoff", 4).alias("standoff"))


# ---- kinematics, geometry


def row_kinematics(spark: SparkSession, d: str) -> DataFrame:
    t = _tracks(spark, d, "px", "py", "pz", "mass")
    k = kinematics.row_kinematics(_particles(spark, d, "geant4_trackid").select("event_id", "id", "geant4_trackid"), t, ["px", "py", "pz", "mass"])
    return k.select("event_id", "id", *(F.when(F.isnan(c), None).otherwise(F.round(c, 4)).alias(c) for c in ("px", "py", "pz", "mass")))


def instance_kinematics(spark: SparkSession, d: str) -> DataFrame:
    """First and last point of the instances, and the momentum of the track that the first belongs to or of the pair it converted into."""
    ws = Workspace(spark, "kinematics")
    p = ws.keep(_particles(spark, d, "pdg", "interaction_type", "geant4_trackid", "sem_type"))
    m = ws.keep(_membership(spark, d).select("event_id", "id", "inst_id", F.col("sem_type").alias("inst_sem")))
    own = p.select(F.col("event_id").alias("o_e"), F.col("id").alias("o_i"), F.col("geant4_trackid").alias("track_id"))
    steps = _points(spark, d, "x", "t").join(own, (F.col("event_id") == F.col("o_e")) & (F.col("particle_id") == F.col("o_i"))).select("event_id", "particle_id", "track_id", F.col("point_id").alias("step_id"), "t", "x")
    k = kinematics.instance_kinematics(steps, p, m, _tracks(spark, d, "px"), ("x",), ("px",))
    return k.select("event_id", "inst_id", F.col("first_step_id").alias("first_point"), F.col("last_step_id").alias("last_point"), F.round("first_px", 3).alias("first_px"))


def stated_geometry(spark: SparkSession, d: str) -> DataFrame:
    """What is wrong with the volumes, where pitches are the volume's number less one and the fourth volume is turned inside out."""
    v = table(spark, d, "volumes").withColumns({"velocity": F.lit(1.6), "time_step": F.lit(0.5), "pitch_y": F.col("volume_id") - 1, "pitch_z": F.lit(4), "x_max": F.when(F.col("volume_id") == 3, F.col("x_min")).otherwise(F.col("x_max"))})
    return geometry.stated_problems(v)


def calibrated_pitch(spark: SparkSession, d: str) -> DataFrame:
    """The pitch of each volume, fitted to pixel centres, in place of a stated 4.1 mm."""
    g = _groups(spark, d, "center_py").select("volume", "center_py", ((F.col("center_py") + 0.5) * 4.0).alias("y"))
    c = geometry.calibrated(geometry.line_fit(g, ["volume"], "center_py", "y"), 4.1)
    return c.select("volume", F.round("pitch", 6).alias("pitch"))


# ---- selections, store, streaming


def groups_of_showers(spark: SparkSession, d: str) -> DataFrame:
    """Readout groups that showers own, and of those the hits of at least 50."""
    g = _groups(spark, d, "peak_charges")
    p = _particles(spark, d, "geant4_trackid", "sem_type")
    own = g.join(p.select(F.col("event_id").alias("p_e"), "geant4_trackid", F.col("id").alias("owner")), (F.col("event_id") == F.col("p_e")) & (F.col("group_to_track") == F.col("geant4_trackid"))).groupBy("event_id", "group_id").agg(F.min("owner").alias("owner"))
    chosen = S.groups_of_particles(own, p.where("sem_type = 1").select("event_id", F.col("id").alias("particle_id")))
    return S.hits_of_groups(g.where("peak_charges >= 50").select("event_id", "group_id"), chosen)


def interaction_rows(spark: SparkSession, d: str) -> DataFrame:
    """Interactions of the particles, numbered from 0 per event, and the particles with theirs."""
    ws = Workspace(spark, "interactions")
    rows = readout.running(_particles(spark, d, "interaction_id"), ("event_id",), ["interaction_id", "id"], {"row_no": F.lit(1)}).withColumn("row_no", F.col("row_no") - 1)
    rows = ws.keep(rows)
    i = ws.keep(layout.interaction_table(rows, rows.limit(0).select("event_id", "interaction_id", F.lit(0).alias("start"), F.lit(0).alias("end"))))
    own = i.select("event_id", F.col("vertex_id").alias("interaction_id"), F.col("interaction_id").alias("no"), "part_start", "part_end")
    return S.interaction_of(rows.select("event_id", "id", "interaction_id"), own).select("event_id", "id", F.col("i_no").alias("interaction_no"), F.col("i_part_start").alias("part_start"), F.col("i_part_end").alias("part_end"))


def _stored(spark: SparkSession, d: str) -> S.EventStore:
    ws = Workspace(spark, "store")
    S.write_table(_points(spark, d, "de"), ws.root, "points", ["particle_id", "point_id"], "zstd", 8)
    S.write_table(_membership(spark, d), ws.root, "membership", ["id"], "gzip", 8)
    S.write_table(_particles(spark, d), ws.root, "particles", ["id"], "gzip", 8)
    S.write_meta(spark, ws.root, {"made": "for a query"})
    return S.EventStore(spark, ws.root, 8)


def store_points(spark: SparkSession, d: str) -> DataFrame:
    """Points per event and fragment, read from a written store of this layout's version; low-energy ones apart."""
    s = _stored(spark, d)
    s.version()
    return s.points_of("frag", F.col("group_id") >= 0).groupBy("event_id", F.col("group_id").alias("frag_id")).agg(F.count(F.lit(1)).alias("points"), F.count_if("is_le").alias("le_points"))


def store_codecs(spark: SparkSession, d: str) -> DataFrame:
    """Codec and values of the column ``de`` of a store's points before and after repacking, which flips the codec; repacking compares the rows itself."""
    s = _stored(spark, d)
    to = f"{s.root}-packed"
    S.repack_store(spark, s.root, to, tables=["points"])
    one = lambda root: S.inspect_compression(spark, spark.read.parquet(f"{root}/points").inputFiles()).where("name = 'de'").groupBy("codec").agg(F.sum("n").alias("values"))
    return one(s.root).unionByName(one(to))


def stored_voxmap(spark: SparkSession, d: str) -> DataFrame:
    """The bridge from voxels to points, written and read again: points per voxel."""
    ws = Workspace(spark, "voxmap")
    S.write_table(P.voxmap(_points(spark, d), SIZE, ORIGIN), ws.root, "voxmap", ["particle_id", "vx", "vy", "vz"], "lz4", 8)
    return S.EventStore(spark, ws.root, 8).table("voxmap").groupBy("event_id", "particle_id", "vx", "vy", "vz").agg(F.count(F.lit(1)).alias("points"), F.min("point_id").alias("first"))


def streamed_totals(spark: SparkSession, d: str) -> DataFrame:
    """Points as a stream of files, each batch folded to totals per event and appended; repeated deliveries of a point pass once."""
    from ..streaming.events import event_stream, once_per_key, run_per_batch

    ws = Workspace(spark, "stream")
    src = f"{ws.root}/in"
    table(spark, d, "points").select("event_id", "point_id", "recorded_at").write.parquet(src)
    stream = once_per_key(event_stream(spark, src, "event_id bigint, point_id bigint, recorded_at timestamp"), ["point_id"], "recorded_at", "3650 days")
    run_per_batch(stream, lambda b: b.groupBy("event_id").agg(F.count(F.lit(1)).alias("points")), ws.root, "totals", f"{ws.root}/progress").awaitTermination()
    return spark.read.parquet(f"{ws.root}/totals").groupBy("event_id").agg(F.sum("points").alias("points"))


def loader_events(spark: SparkSession, d: str) -> DataFrame:
    """Voxels written in four shards for a loader, and what the shards hold."""
    from ..training import write_shards

    ws = Workspace(spark, "shards")
    v = P.voxelize(_points(spark, d), SIZE, ORIGIN)
    write_shards(v, ["particle_id", "x", "y", "z", "de"], f"{ws.root}/shards", 4)
    return spark.read.parquet(f"{ws.root}/shards").groupBy("event_id").agg(F.count_distinct("shard").alias("shards"), F.count(F.lit(1)).alias("voxels"))


# ---- the whole run


_runs: dict[tuple[str, str], Run] = {}


def _run(spark: SparkSession, d: str) -> Run:
    """One run per session and folder, whose tables the queries share: they are written once."""
    at = (spark.sparkContext.applicationId, d)
    if at not in _runs:
        _runs[at] = _run_of(spark, d)
    return _runs[at]


def _run_of(spark: SparkSession, d: str) -> Run:
    p = _particles(spark, d, "ancestor_id", "pdg", "parent_pdg", "geant4_trackid", "interaction_id", "interaction_type")
    return run_events(p, _points(spark, d), Params(delta_min_standoff=8.0))


def run_particles(spark: SparkSession, d: str) -> DataFrame:
    return _run(spark, d).particles


def run_interactions(spark: SparkSession, d: str) -> DataFrame:
    return _run(spark, d).interactions


def run_decisions(spark: SparkSession, d: str) -> DataFrame:
    """How many pairs each rule tried in each pass, by outcome."""
    return _run(spark, d).decisions.groupBy("rule", "pass_no", "outcome").agg(F.count(F.lit(1)).alias("pairs"))


def run_why_not(spark: SparkSession, d: str) -> DataFrame:
    """Why pairs that no rule merged were not: pairs by the outcomes that they had."""
    x = reports.as_decisions(_run(spark, d).decisions)
    return reports.never_merged(x).groupBy("outcome").agg(F.count_distinct("event_id", "lo", "hi").alias("pairs"))


def run_checks(spark: SparkSession, d: str) -> DataFrame:
    """What must hold of a run's tables: voxels that come in and go out, energy, input points bridged, positions that do not follow on each other, particles without a fragment, and whether merging converged."""
    r = _run(spark, d)
    ws = Workspace(spark, "checks")
    points, members = ws.keep(r.points), ws.keep(r.membership)
    rows = points.groupBy("event_id").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("point_row").alias("d"), F.max("point_row").alias("top"), F.sum("de").alias("de"))
    total = rows.agg(F.sum("n").alias("voxels"), F.round(F.sum("de"), 1).alias("energy"), F.count_if((F.col("n") != F.col("d")) | (F.col("top") != F.col("n") - 1)).alias("gaps"))
    total = ws.keep(total)
    one = lambda df, name, c: df.select(F.lit(name).alias("what"), F.col(c).cast("double").alias("value"))
    bridged = r.voxmap.agg(F.count_distinct("point_id").alias("n"))
    heads = members.where("frag_id = id").select(F.col("event_id").alias("h_e"), F.col("frag_id").alias("h_f"))
    lost = members.join(heads, (F.col("event_id") == F.col("h_e")) & (F.col("frag_id") == F.col("h_f")), "left_anti").agg(F.count(F.lit(1)).alias("n"))
    converged = spark.createDataFrame([("converged", float(r.converged))], "what string, value double")
    return one(total, "voxels", "voxels").unionByName(one(total, "energy", "energy")).unionByName(one(total, "gaps", "gaps")).unionByName(one(bridged, "bridged", "n")).unionByName(one(lost, "lost", "n")).unionByName(converged)


def run_group_owners(spark: SparkSession, d: str) -> DataFrame:
    """The fragment of each readout group, where input points are dealt to groups by their number."""
    deposits = _points(spark, d, "t").select("event_id", "point_id", F.floor(F.col("point_id") / 16).alias("group_id"))
    return owners_of_run(_run(spark, d), deposits)


QUERIES = {
    f.__name__: f
    for f in (
        step_projection, slice_owners, pixel_keys, nominal_positions, decoded_segments, matched_steps, truth_segments, visible_steps, step_owners, deposit_tracks, plane_entries, pixel_hits, hits_subset,
        primary_mismatches, issue_chains, michel_ancestry, direct_children, stored_rows, partition_sem_types, partition_once, sibling_groups, shower_contacts, split_pieces, buried_deltas,
        row_kinematics, instance_kinematics, stated_geometry, calibrated_pitch, groups_of_showers, interaction_rows, store_points, store_codecs, stored_voxmap, streamed_totals, loader_events,
        run_particles, run_interactions, run_decisions, run_why_not, run_checks, run_group_owners,
    )
}

_CM = "CAST(CAST(x AS FLOAT) / CAST(10 AS FLOAT) AS FLOAT)"
_IN_CM = " AND ".join(f"CAST({_CM.replace('x AS', f'{a} AS')} AS DOUBLE) >= v.{a}_min / 10 AND CAST({_CM.replace('x AS', f'{a} AS')} AS DOUBLE) < v.{a}_max / 10" for a in "xyz")
_SEG = f"{PTS}, {GOOD}, seg AS (SELECT event_id, volume_id AS volume, point_id, t, de, dx, x, y, z, point_id % 7 AS group_id FROM good JOIN volumes v ON {_IN_CM})"
_ANODE = "CASE WHEN drift_dir > 0 THEN x_max ELSE x_min END"
_LINKS = "lk AS (SELECT c.event_id, c.id, q.id AS up FROM par c LEFT JOIN par q ON q.event_id = c.event_id AND q.id = c.parent_id)"

SQL = {
    "step_projection": f"WITH {PTS} SELECT point_id, x, y, z, t, de, CAST(0 AS FLOAT) AS dx, 'dx' AS missing FROM pts",
    "slice_owners": "WITH p AS (SELECT event_id, id, arg_max(pc_offsets, recorded_at) AS o FROM particles GROUP BY ALL), s AS (SELECT event_id, id, unnest(range(o[1], o[2])) AS step FROM p WHERE len(o) = 2 AND o[2] > o[1]) SELECT event_id, step, max(id) AS owner FROM s GROUP BY event_id, step",
    "pixel_keys": f"WITH {GRP} SELECT event_id, group_id, (CAST(center_py AS BIGINT) + 1048576) * 4398046511104 + (CAST(center_pz AS BIGINT) + 1048576) * 2097152 + CAST(center_times AS BIGINT) + 1048576 AS key FROM grp",
    "nominal_positions": f"WITH {PTS}, q AS (SELECT point_id, CAST(x AS DOUBLE) AS x, drift_dir * CAST(t AS DOUBLE) * CAST(1.6 AS DOUBLE) AS s FROM pts JOIN volumes ON {VOLUME}) SELECT point_id, round(x + s, 4) AS x, CAST(round(s * 10000) AS BIGINT) AS shift FROM q",
    "decoded_segments": f"WITH {_SEG} SELECT event_id, volume, point_id AS segment_no, {', '.join(f'CAST(round_even((CAST({a} AS DOUBLE) + 2200) / 0.5, 0) * 0.5 - 2200 AS FLOAT) AS {a}' for a in 'xyz')} FROM seg",
    "matched_steps": f"WITH {_SEG} SELECT event_id, volume, point_id AS step_no, point_id AS segment_no, true AS near FROM seg",
    "truth_segments": f"""WITH {_SEG}, n AS (SELECT event_id, volume, count(DISTINCT group_id) AS n FROM seg GROUP BY ALL), o AS (SELECT event_id, volume, coalesce(sum(n) OVER (PARTITION BY event_id ORDER BY volume ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off FROM n)
 SELECT event_id, volume, point_id AS segment_no, CAST(group_id + off AS BIGINT) AS "group", round(CAST(CAST(CAST(t AS DOUBLE) / 1000 AS FLOAT) AS DOUBLE), 6) AS t, de, round(CAST(CAST(CAST(dx AS DOUBLE) / 10 AS FLOAT) AS DOUBLE), 5) AS dx FROM seg JOIN o USING (event_id, volume)""",
    "visible_steps": f"WITH {_SEG} SELECT p.event_id, p.point_id AS step_no, coalesce(s.volume, -1) AS volume, coalesce(s.group_id, -1) AS group_id, coalesce(s.group_id < 5 AND s.volume % 2 = 0, false) AS seen FROM pts p LEFT JOIN seg s ON s.point_id = p.point_id",
    "step_owners": f"WITH {PTS}, {PAR}, t AS (SELECT event_id, track_id, arg_max(row_idx, recorded_at) AS r, arg_max(dropped, recorded_at) AS gone FROM geant4 GROUP BY ALL) SELECT p.event_id, p.point_id AS step_no, coalesce(t.r, -1) AS owner FROM pts p LEFT JOIN par q ON q.event_id = p.event_id AND q.id = p.particle_id LEFT JOIN t ON t.event_id = p.event_id AND t.track_id = q.geant4_trackid AND NOT t.gone",
    "deposit_tracks": f"WITH {GRP} SELECT event_id, volume, group_id, coalesce(group_to_track, -1) AS track_id FROM grp UNION ALL SELECT event_id, volume, -group_id - 1, -1 FROM grp",
    "plane_entries": f"""WITH {GRP}, g AS (SELECT event_id, volume, group_id, ['Y', 'A', 'U', 'B', 'V'][((center_py % 5) + 5) % 5 + 1] AS plane, ((center_pz % 3) + 3) % 3 AS size FROM grp), n AS (SELECT event_id, volume, count(*) AS n FROM g GROUP BY ALL), o AS (SELECT event_id, volume, coalesce(sum(n) OVER (PARTITION BY event_id ORDER BY volume ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off FROM n),
 k AS (SELECT DISTINCT event_id, volume, plane FROM g), c AS (SELECT event_id, volume, count(*) FILTER (plane IN ('U', 'V', 'Y')) AS known FROM k GROUP BY ALL), pn AS (SELECT k.*, CASE plane WHEN 'U' THEN 0 WHEN 'V' THEN 1 WHEN 'Y' THEN 2 ELSE known + row_number() OVER (PARTITION BY k.event_id, k.volume, plane IN ('U', 'V', 'Y') ORDER BY plane) - 1 END AS number FROM k JOIN c USING (event_id, volume)),
 e AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY event_id, volume, plane ORDER BY group_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS first FROM g), x AS (SELECT event_id, volume, plane, group_id, first, unnest(range(CAST(size AS BIGINT))) AS i FROM e WHERE size > 0)
 SELECT event_id, volume, CAST(number AS INT) AS plane, plane AS source, CAST(first + i AS BIGINT) AS entry_no, CAST(group_id + off AS BIGINT) AS "group" FROM x JOIN o USING (event_id, volume) JOIN pn USING (event_id, volume, plane)""",
    "pixel_hits": f"""WITH {GRP}, {TRK}, n AS (SELECT *, row_number() OVER (PARTITION BY event_id, volume ORDER BY group_id) - 1 AS k FROM grp WHERE peak_charges IS NOT NULL)
 SELECT n.event_id, volume, k AS csr_pos, group_id, coalesce(trk.track_id, -1) AS track_id, round(CAST(({_ANODE}) - drift_dir * (center_times + 2 - 100) * 1.6 * 0.5 AS DOUBLE), 4) AS x, round(CAST(y_min + (center_py + 1 + 0.5) * 4.0 AS DOUBLE), 4) AS y, round(CAST(z_min + (center_pz - 1 + 0.5) * 4.0 AS DOUBLE), 4) AS z, CAST((center_times + 2) * 0.5 AS DOUBLE) AS t, round(CAST(peak_charges AS DOUBLE), 4) AS de,
 ({_ANODE}) - drift_dir * (center_times + 2 - 100) * 1.6 * 0.5 < x_min OR ({_ANODE}) - drift_dir * (center_times + 2 - 100) * 1.6 * 0.5 > x_max AS outside FROM n JOIN volumes ON volume_id = volume LEFT JOIN trk ON trk.event_id = n.event_id AND trk.track_id = n.group_to_track WHERE volume % 2 = 0 AND abs(peak_charges) >= 50""".replace("n.event_id, volume, k", "n.event_id, n.volume, n.k"),
    "hits_subset": f"WITH {GRP}, n AS (SELECT * FROM grp WHERE peak_charges IS NOT NULL AND event_id IN (SELECT event_id FROM (SELECT DISTINCT event_id FROM grp WHERE peak_charges IS NOT NULL) ORDER BY event_id LIMIT 50)) SELECT event_id, row_number() OVER (PARTITION BY event_id ORDER BY group_id) - 1 AS csr_pos, group_id, round(abs(CAST(peak_charges AS DOUBLE)) * -16000 / CAST(32767 AS DOUBLE), 4) AS charge FROM n",
    "primary_mismatches": f"""WITH {TRK.replace('parent_track_id, pdg', 'parent_track_id, root_track_id, pdg') if 'root_track_id' in TRK else TRK}, r AS (SELECT event_id, track_id, arg_max(root_track_id, recorded_at) AS root FROM geant4 GROUP BY ALL), t AS (SELECT trk.event_id, trk.track_id, parent_track_id, root FROM trk JOIN r ON r.event_id = trk.event_id AND r.track_id = trk.track_id)
 SELECT event_id, track_id, CASE WHEN parent_track_id IS NULL THEN 'parentless_not_primary' ELSE 'primary_with_parent' END AS code FROM t WHERE (parent_track_id IS NULL) <> coalesce(root = track_id, false) UNION ALL SELECT event_id, max(track_id) + 1, 'primary_not_in_particles' FROM t GROUP BY event_id""",
    "issue_chains": f"""WITH RECURSIVE {PAR}, {_LINKS}, {_roots('lk')}, ch AS (SELECT event_id, id AS s, id AS at, 1 AS n, CAST(id AS VARCHAR) AS chain FROM w UNION ALL SELECT ch.event_id, ch.s, lk.up, n + 1, CASE WHEN n < 12 THEN chain || ' <- ' || lk.up ELSE chain END FROM ch JOIN lk ON lk.event_id = ch.event_id AND lk.id = ch.at WHERE lk.up IS NOT NULL AND n < 13),
 full_ AS (SELECT event_id, s, arg_max(chain, n) || CASE WHEN max(n) > 12 THEN ' <- ...' ELSE '' END AS chain FROM ch GROUP BY ALL)
 SELECT p.event_id, p.id, 'absent_parent' AS code, f.chain FROM par p JOIN lk ON lk.event_id = p.event_id AND lk.id = p.id JOIN full_ f ON f.event_id = p.event_id AND f.s = p.id WHERE p.parent_id IS NOT NULL AND lk.up IS NULL
 UNION ALL SELECT p.event_id, p.id, 'loop', p.id || ' <- ' || p.parent_id || ' <- ...' FROM par p JOIN lo ON lo.event_id = p.event_id AND lo.id = p.id""",
    "michel_ancestry": f"""WITH RECURSIVE {PAR}, {_LINKS}, {_roots('lk')}, c AS (SELECT w.event_id, w.id, w.id AS step_id, w.depth AS step FROM w JOIN par ON par.event_id = w.event_id AND par.id = w.id WHERE sem_type = 4 UNION ALL SELECT c.event_id, c.id, lk.up, c.step - 1 FROM c JOIN lk ON lk.event_id = c.event_id AND lk.id = c.step_id WHERE lk.up IS NOT NULL) SELECT event_id, id, CAST(step AS INT) AS step, step_id FROM c""",
    "direct_children": f"WITH {PAR} SELECT c.event_id, p.id, c.id AS child FROM par c JOIN par p ON p.event_id = c.event_id AND p.id = c.parent_id WHERE p.sem_type = 2",
    "stored_rows": f"WITH RECURSIVE {PAR}, u AS (SELECT event_id, id FROM par WHERE sem_type = 1 UNION SELECT u.event_id, q.id FROM u JOIN par c ON c.event_id = u.event_id AND c.id = u.id JOIN par q ON q.event_id = c.event_id AND q.id = c.parent_id) SELECT event_id, id FROM u",
    "partition_sem_types": f"WITH {PAR}, {MEM} SELECT event_id, CAST(sem_type AS INT) AS sem_type, count(*) FILTER (id = frag_id) AS partitions, count(*) AS particles FROM mem GROUP BY ALL",
    "partition_once": f"WITH {NEAR}, {PAR} SELECT c.event_id, c.id AS child, c.parent_id AS parent, CASE WHEN t.owner_a IS NULL THEN 'NOT_TOUCHING' ELSE 'MERGED' END AS outcome FROM par c JOIN par q ON q.event_id = c.event_id AND q.id = c.parent_id LEFT JOIN tch t ON t.event_id = c.event_id AND t.owner_a = least(c.id, c.parent_id) AND t.owner_b = greatest(c.id, c.parent_id)",
    "sibling_groups": f"WITH {PAR} SELECT event_id, parent_id, id AS particle_id, CASE WHEN pdg IS NULL THEN id ELSE min(id) OVER (PARTITION BY event_id, parent_id, pdg) END AS group_id FROM par WHERE parent_id IS NOT NULL",
    "shower_contacts": f"""WITH {NEAR}, {PAR}, e AS (SELECT * FROM par WHERE pdg IN (11, 22) AND coalesce(sem_type, 6) <> 5) SELECT c.event_id, c.id AS child, c.parent_id AS parent, CASE WHEN t.owner_a IS NULL THEN 'NOT_TOUCHING' ELSE 'MERGED' END AS outcome FROM e c JOIN e q ON q.event_id = c.event_id AND q.id = c.parent_id AND q.ancestor_id = c.ancestor_id
 LEFT JOIN tch t ON t.event_id = c.event_id AND t.owner_a = least(c.id, c.parent_id) AND t.owner_b = greatest(c.id, c.parent_id)""",
    "split_pieces": f"""WITH {PAR}, p AS (SELECT c.event_id, c.id, c.sem_type, c.pdg, CASE WHEN c.sem_type = 5 THEN coalesce(u.geant4_trackid, c.geant4_trackid) ELSE c.geant4_trackid END AS g FROM par c LEFT JOIN par u ON u.event_id = c.event_id AND u.id = c.parent_id),
 h AS (SELECT event_id, g, min(id) AS home, arg_min(sem_type, id) AS sem_type FROM p WHERE sem_type IN (2, 3, 4) AND pdg <> 2112 GROUP BY ALL) SELECT p.event_id, p.id AS frag_id, h.home, h.sem_type FROM p JOIN h ON h.event_id = p.event_id AND h.g = p.g WHERE p.sem_type = 5""",
    "buried_deltas": f"""WITH RECURSIVE {PTS}, {GOOD}, {PAR}, cel AS (SELECT DISTINCT event_id, particle_id, {', '.join(f'floor(CAST({a} AS DOUBLE) / 3) * 3 AS {a}' for a in 'xyz')} FROM good), d AS (SELECT c.event_id, c.id, c.parent_id FROM par c JOIN par q ON q.event_id = c.event_id AND q.id = c.parent_id WHERE c.sem_type = 3 AND c.interaction_type <> {INTERACTION['primary']}),
 n AS (SELECT d.event_id, d.id, d.parent_id, a.x, a.y, a.z, min(sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2 + (a.z - b.z) ** 2)) AS near FROM d JOIN cel a ON a.event_id = d.event_id AND a.particle_id = d.id LEFT JOIN cel b ON b.event_id = d.event_id AND b.particle_id = d.parent_id GROUP BY ALL),
 s AS (SELECT event_id, id, parent_id AS home, max(near) AS standoff FROM n GROUP BY ALL HAVING count(near) = count(*) AND max(near) < 8), r AS (SELECT event_id, id, home, standoff FROM s UNION ALL SELECT r.event_id, r.id, s.home, r.standoff FROM r JOIN s ON s.event_id = r.event_id AND s.id = r.home)
 SELECT r.event_id, r.id AS frag_id, r.home, round(r.standoff, 4) AS standoff FROM r WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.event_id = r.event_id AND s.id = r.home)""",
    "row_kinematics": f"WITH {PAR}, {TRK} SELECT p.event_id, p.id, {', '.join(f'CASE WHEN NOT isnan(t.{c}) THEN round(CAST(t.{c} AS DOUBLE), 4) END AS {c}' for c in ('px', 'py', 'pz', 'mass'))} FROM par p LEFT JOIN trk t ON t.event_id = p.event_id AND t.track_id = p.geant4_trackid",
    "instance_kinematics": f"""WITH {PTS}, {PAR}, {MEM}, {TRK}, i AS (SELECT m.event_id, m.id, m.inst_id, m.sem_type AS inst_sem, p.geant4_trackid AS g, p.sem_type AS s, p.pdg, p.parent_id, p.interaction_type AS k FROM mem m JOIN par p ON p.event_id = m.event_id AND p.id = m.id),
 pr AS (SELECT DISTINCT i.event_id, i.inst_id, i.g FROM i JOIN par h ON h.event_id = i.event_id AND h.id = i.inst_id AND h.pdg = 22 WHERE abs(i.pdg) = 11 AND i.k = 8 AND i.parent_id = i.inst_id), fo AS (SELECT event_id, inst_id, g FROM i WHERE coalesce(s, 0) <> 5 UNION SELECT * FROM pr),
 st AS (SELECT q.event_id, i.inst_id, i.g, q.t, q.point_id, fo.g IS NOT NULL AS ok, max(fo.g IS NOT NULL) OVER (PARTITION BY q.event_id, i.inst_id) AS any_ok, max(coalesce(i.inst_sem = 1, false)) OVER (PARTITION BY q.event_id, i.inst_id) AS shower FROM pts q JOIN i ON i.event_id = q.event_id AND i.id = q.particle_id LEFT JOIN fo ON fo.event_id = q.event_id AND fo.inst_id = i.inst_id AND fo.g = i.g),
 sh AS (SELECT event_id, inst_id, max(coalesce(inst_sem = 1, false)) AS shower FROM i GROUP BY ALL), e AS (SELECT event_id, inst_id, arg_min(point_id, (t, point_id)) AS f, arg_max(point_id, (t, -point_id)) AS l, arg_min(g, (t, point_id)) AS fg, max(shower) AS held FROM st WHERE ok OR NOT any_ok GROUP BY ALL),
 tot AS (SELECT pr.event_id, pr.inst_id, sum(CAST(px AS DOUBLE)) AS px FROM pr JOIN trk ON trk.event_id = pr.event_id AND trk.track_id = pr.g GROUP BY ALL)
 SELECT e.event_id, e.inst_id, e.f AS first_point, CASE WHEN NOT held THEN e.l END AS last_point, round(CASE WHEN sh.shower AND pr.g IS NOT NULL THEN tot.px ELSE CAST(trk.px AS DOUBLE) END, 3) AS first_px FROM e JOIN sh USING (event_id, inst_id) LEFT JOIN pr ON pr.event_id = e.event_id AND pr.inst_id = e.inst_id AND pr.g = e.fg
 LEFT JOIN tot ON tot.event_id = e.event_id AND tot.inst_id = e.inst_id LEFT JOIN trk ON trk.event_id = e.event_id AND trk.track_id = e.fg""",
    "stated_geometry": "SELECT volume_id, 'pitch is not positive' AS problem FROM volumes WHERE volume_id <= 1 UNION ALL SELECT volume_id, 'empty box' FROM volumes WHERE volume_id = 3",
    "calibrated_pitch": f"WITH {GRP} SELECT DISTINCT volume, CAST(4 AS DOUBLE) AS pitch FROM grp",
    "groups_of_showers": f"WITH {GRP}, {PAR}, o AS (SELECT g.event_id, g.group_id, min(p.id) AS owner FROM grp g JOIN par p ON p.event_id = g.event_id AND p.geant4_trackid = g.group_to_track GROUP BY ALL) SELECT g.event_id, g.group_id FROM grp g JOIN o USING (event_id, group_id) JOIN par p ON p.event_id = o.event_id AND p.id = o.owner WHERE p.sem_type = 1 AND g.peak_charges >= 50",
    "interaction_rows": f"""WITH {PAR}, r AS (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY interaction_id NULLS FIRST, id) - 1 AS no FROM par), i AS (SELECT event_id, interaction_id, min(no) AS a, max(no) + 1 AS b, row_number() OVER (PARTITION BY event_id ORDER BY interaction_id) - 1 AS k FROM r WHERE interaction_id >= 0 GROUP BY event_id, interaction_id)
 SELECT r.event_id, r.id, CAST(i.k AS INT) AS interaction_no, i.a AS part_start, i.b AS part_end FROM r LEFT JOIN i ON i.event_id = r.event_id AND i.interaction_id = r.interaction_id""",
    "store_points": f"WITH {PTS}, {PAR}, {MEM} SELECT p.event_id, m.frag_id, count(*) AS points, count(*) FILTER (m.is_le) AS le_points FROM pts p JOIN mem m ON m.event_id = p.event_id AND m.id = p.particle_id GROUP BY ALL",
    "store_codecs": f"WITH {PTS} SELECT 'ZSTD' AS codec, count(*) AS \"values\" FROM pts UNION ALL SELECT 'GZIP', count(*) FROM pts",
    "stored_voxmap": f"WITH {VOXELS} SELECT event_id, particle_id, vx, vy, vz, count(*) AS points, min(point_id) AS first FROM cel GROUP BY ALL",
    "streamed_totals": "SELECT event_id, count(DISTINCT point_id) AS points FROM points GROUP BY event_id",
    "loader_events": f"WITH {VOXELS} SELECT event_id, CAST(1 AS BIGINT) AS shards, count(*) AS voxels FROM vxl GROUP BY event_id",
    "run_checks": f"""WITH {PTS}, {PAR}, own AS (SELECT p.* FROM pts p JOIN par q ON q.event_id = p.event_id AND q.id = p.particle_id WHERE x IS NOT NULL AND NOT isnan(x) AND NOT isnan(y) AND NOT isnan(z)), c AS (SELECT event_id, particle_id, {', '.join(f'floor((CAST({a} AS DOUBLE) + 2160) / 3) AS v{a}' for a in 'xyz')}, sum(CAST(de AS DOUBLE)) AS de FROM own GROUP BY ALL)
 SELECT 'voxels' AS what, CAST(count(*) AS DOUBLE) AS value FROM c UNION ALL SELECT 'energy', round(sum(de), 1) FROM c UNION ALL SELECT 'gaps', 0 UNION ALL SELECT 'bridged', count(*) FROM own UNION ALL SELECT 'lost', 0 UNION ALL SELECT 'converged', 1""",
}

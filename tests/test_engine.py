"""The engine's operators on small hand-checkable cases."""

import math

import pytest
from pyspark.sql import functions as F

from driftloom.enums import INTERACTION as I
from driftloom.enums import SEMANTIC as S
from driftloom.functions import columns as C
from driftloom.operators import clustering, geometry, layout, points as P, readout, reports
from driftloom.operators.genealogy import interactions, primaries, traceable_instances
from driftloom.params import Params
from driftloom.plans import queries
from driftloom.sources import inputs, store as St
from driftloom.training import batches, shards, training_voxels, write_shards

POINT = "event_id int, particle_id int, point_id int, x float, y float, z float, t float, de float, dx float"


def pts(spark, rows):
    return spark.createDataFrame([(1, p, i, float(x), float(y), float(z), float(t), float(e), float(d)) for p, i, x, y, z, t, e, d in rows], POINT)


def test_voxels_and_map(spark):
    df = pts(spark, [(1, i, x, 0.5, 0.5, 5 - i, i + 1, 1) for i, x in enumerate((0.2, 0.7, 1.2, 1.8))] + [(2, 10 + i, x, 0.5, 0.5, 1, 5 + i, 1) for i, x in enumerate((0.5, 1.5, 2.5))])
    v = {(r.particle_id, r.x): (r.de, r.n, r.t) for r in P.voxelize(df, (1.0,) * 3, (0.0,) * 3).collect()}
    assert v == {(1, 0.5): (3.0, 2, 4.0), (1, 1.5): (7.0, 2, 2.0), (2, 0.5): (5.0, 1, 1.0), (2, 1.5): (6.0, 1, 1.0), (2, 2.5): (7.0, 1, 1.0)}
    m = {(r.particle_id, r.vx, r.point_id) for r in P.voxmap(df, (1.0,) * 3, (0.0,) * 3).collect()}
    assert m == {(1, 0, 0), (1, 0, 1), (1, 1, 2), (1, 1, 3), (2, 0, 10), (2, 1, 11), (2, 2, 12)}
    with pytest.raises(ValueError):
        P.voxelize(df, (0.0, 1.0, 1.0), None)
    assert P.voxelize(df.limit(0), (1.0,) * 3, None).count() == 0


def test_voxels_below_zero_nan_and_null(spark):
    df = pts(spark, [(1, 0, -0.5, 0, 0, 1, 1, 1), (1, 1, float("nan"), 0, 0, 1, 1, 1)]).unionByName(pts(spark, [(1, 2, 0, 0, 0, 1, 1, 1)]).withColumn("x", F.lit(None).cast("float")))
    assert [r.x for r in P.voxelize(df, (1.0,) * 3, (0.0,) * 3).collect()] == [-0.5]


def test_truth_voxel_takes_the_earliest_step(spark):
    df = pts(spark, [(1, 0, 1, 1, 1, 5, 1, 0.03), (1, 1, 2, 2, 2, 3, 2, 0.03)]).withColumn("p", F.when(F.col("point_id") == 0, 50).otherwise(80))
    r = P.truth_voxels(df, (3.0,) * 3, (0.0,) * 3, ["p"], "point_id").collect()[0]
    assert (r.x, r.y, r.z, r.t, r.de, r.p) == (1.5, 1.5, 1.5, 3.0, 3.0, 80) and abs(r.dx - 0.06) < 1e-6


def test_contested_voxel(spark, tmp_path):
    df = pts(spark, [(1, 0, 1, 1, 1, 1, 3, 1), (2, 1, 1, 1, 1, 2, 4, 1), (3, 2, 1, 1, 1, 0, 8, 1)])
    m = spark.createDataFrame([(1, 1, 10, S["shower"], 0, False), (1, 2, 20, S["shower"], 0, False), (1, 3, 30, S["le_scatter"], 0, True)], "event_id int, id int, inst_id int, sem_type int, interaction_id int, is_le boolean")
    r = training_voxels(df, m).collect()
    assert len(r) == 1 and (r[0].energy, r[0].inst_id, r[0].sem_type) == (15.0, 10, S["shower"])
    r = training_voxels(df, m, include_le=False).collect()
    assert r[0].energy == 7.0
    assert training_voxels(df, m.limit(0)).collect()[0].inst_id == -1
    out = str(tmp_path / "shards")
    write_shards(training_voxels(df, m), ["x", "energy"], out, 2)
    got = dict(batches(out, ["x", "energy"]))
    assert got[1].num_rows == 1
    e = spark.range(100).select(F.col("id").alias("event_id"))
    assert sorted(x.event_id for k in range(3) for x in shards(e, 3, k, epoch=2).collect()) == list(range(100))


def kind(spark, **v):
    v = dict(primary=False, pdg=11, parent_pdg=0, process=2, sub=0, dr=-1.0, ke=1.0) | v
    row = spark.range(1).select(C.interaction_type(F.lit(v["primary"]), F.lit(v["pdg"]), F.lit(v["parent_pdg"]), F.lit(v["process"]), F.lit(v["sub"]), F.lit(v["dr"]), F.lit(v["ke"])).alias("k")).first()
    return next(n for n, c in I.items() if c == row.k)


def test_interaction_types(spark):
    assert kind(spark, primary=True, pdg=2112) == "primary"
    assert kind(spark, pdg=2112) == "neutron" and kind(spark, pdg=1000180400) == "nucleus" and kind(spark, pdg=22) == "photon" and kind(spark, pdg=13) == "track"
    assert kind(spark, sub=12) == "photoelectron" and kind(spark, sub=13) == "compton" and kind(spark, sub=14) == "conversion" and kind(spark, sub=4) == "conversion"
    assert kind(spark, sub=2, parent_pdg=22) == "ionization" and kind(spark, sub=2, parent_pdg=-13) == "delta" and kind(spark, sub=2, parent_pdg=11) == "ionization" and kind(spark, sub=3) == "invalid"
    assert kind(spark, process=6) == "decay" and kind(spark, process=4, sub=151, ke=0.01) == "ionization" and kind(spark, process=4, sub=151) == "decay" and kind(spark, process=4, sub=151, dr=1.0, ke=0.01) == "compton" and kind(spark, process=0) == "other_shower"


def sem(spark, k, pdg=11, parent=0, extent=5):
    return spark.range(1).select(C.semantic_type(F.lit(I[k]), F.lit(pdg), F.lit(parent), F.lit(extent), 5).alias("s")).first().s


def test_semantic_types_at_the_limit(spark):
    assert sem(spark, "track", 13) == S["track"] and sem(spark, "track", 13, extent=4) == S["le_scatter"] and sem(spark, "delta") == S["delta"]
    assert sem(spark, "compton") == S["le_scatter"] and sem(spark, "compton", extent=6) == S["shower"] and sem(spark, "nucleus", 1000180400) == S["le_scatter"]
    assert sem(spark, "decay", 11, 13) == S["michel"] and sem(spark, "decay", 22) == S["shower"] and sem(spark, "decay", 211) == S["track"] and sem(spark, "primary", 22, extent=0) == S["shower"] and sem(spark, "invalid") == S["unknown"]
    with pytest.raises(Exception, match="no semantic type"):
        sem(spark, "photon", 13)


def test_scalar_functions(spark):
    r = spark.range(1).select(C.rounded_mantissa(F.lit(1.0009765625 + 2**-13), 10).alias("a"), C.rounded_mantissa(F.lit(float("nan")), 10).alias("b"), C.rounded_mantissa(F.lit(-3.3), 4).alias("c"), C.pixel_key(F.lit(-1), F.lit(0), F.lit(0)).alias("lo"), C.pixel_key(F.lit(0), F.lit(0), F.lit(0)).alias("hi")).first()
    assert r.a == 1.0009765625 and math.isnan(r.b) and r.c == -3.25 and r.lo < r.hi
    e = spark.range(1).select(C.step_end(1, F.lit(0.0), F.lit(0.0), F.lit(3.0), F.lit(1.0), F.lit(0.0), F.lit(0.0), F.lit(280.0), F.lit(1.0), F.lit(0.0)).alias("e")).first().e
    assert abs(e.z - 3.5) < 1e-12 and abs(e.pz - 280) < 1e-9 and abs(e.t - 1 - 0.5 / 299.792458) < 1e-12


def test_decode_hits(spark, rows):
    g = spark.createDataFrame([(1, 0, 7, 2, 10, 20, 30, 100.0), (1, 1, 9, 1, 40, 50, 60, 50.0)], "e int, group_no int, group_id int, group_size int, center_py int, center_pz int, center_times int, peak_charges double")
    e = [(1, 0, 0, 0, 0, 32767), (1, 1, 1, -2, 3, 16383), (1, 2, -1, 1, 0, -32767)]
    schema = "e int, position int, delta_py int, delta_pz int, delta_times int, fraction int"
    h = readout.decode_hits(g, spark.createDataFrame(e, schema), ("e",)).collect()
    assert [(r.py, r.pz, r.tick, round(r.charge)) for r in sorted(h, key=lambda r: r.csr_pos)] == [(10, 20, 30, 100), (11, 18, 33, 50), (39, 51, 60, -50)]
    more = e + [(1, k, 0, 0, 0, 1) for k in range(3, 259)]
    with pytest.raises(Exception, match="1 x 256 lost"):
        readout.decode_hits(g, spark.createDataFrame(more, schema), ("e",)).collect()
    with pytest.raises(Exception, match="differ"):
        readout.decode_hits(g, spark.createDataFrame(e[:2], schema), ("e",)).collect()


def test_owners_and_labels(spark, rows):
    d = spark.createDataFrame([(1, 0, 7), (1, 0, 7), (1, 0, 9), (1, 0, 9), (1, 1, 9), (1, 1, 9), (1, 1, 7), (1, -1, 9)], "event_id int, group_id int, particle_id int")
    assert rows(readout.owners(d, "majority")) == [(1, 0, 7, True), (1, 1, 9, True)]
    assert rows(readout.owners(d, "first")) == [(1, 0, 7, True), (1, 1, 7, True)]
    with pytest.raises(Exception, match="several particles"):
        readout.owners(d, "check").collect()
    hits = spark.createDataFrame([(1, 0, True), (1, 1, False), (1, 5, True)], "event_id int, group_id int, on_sensor boolean")
    m = spark.createDataFrame([(1, 7, 70, 700, True), (1, 9, 90, 900, False)], "event_id int, particle_id int, frag_id int, inst_id int, is_le boolean")
    assert rows(readout.hit_labels(hits, readout.owners(d), m)) == [(1, 0, True, 70, 700, True), (1, 1, False, -1, -1, False), (1, 5, True, -1, -1, False)]


def test_slices_ranges_and_containment(spark, rows):
    s = spark.createDataFrame([(1, 0, 0, 2), (1, 1, 1, 3), (1, 2, 5, 5)], "event_id int, row int, start int, end int")
    assert rows(readout.association_owner(s)) == [(1, 0, 0), (1, 1, 1), (1, 2, 1)]
    r = spark.createDataFrame([(1, 0, 3, "a"), (1, 5, 8, "b"), (1, 9, 9, "c")], "e int, start int, end int, name string")
    p = spark.createDataFrame([(1, 0), (1, 2), (1, 3), (1, 7), (1, 9), (2, 1)], "e int, at int")
    assert rows(readout.contained(p, r, ["e"], "at", "name")) == [(1, 0, "a"), (1, 2, "a"), (1, 3, None), (1, 7, "b"), (1, 9, None), (2, 1, None)]
    o = spark.createDataFrame([(1, 0, 5, 1), (1, 4, 6, 2), (1, 6, 7, 3), (1, -1, -1, 4)], "e int, start int, end int, g int")
    assert rows(layout.overlaps(o, ["e"], "g")) == [(1, 1, 2, 0, 5, 4)]


def test_layout(spark, rows):
    p = spark.createDataFrame([(1, 9, 0, 5, False, 9, 2), (1, 5, 0, 5, False, 5, 0), (1, 7, 0, 5, True, 7, 2), (2, 1, 0, 1, False, 1, 4)], "event_id int, particle_id int, interaction_id int, inst_id int, is_le boolean, frag_id int, n int")
    laid = layout.storage_ranges(p)
    assert rows(laid.select("particle_id", "pc_start", "pc_end")) == [(1, 0, 4), (5, 0, 0), (7, 2, 4), (9, 0, 2)]
    assert rows(layout.group_spans(laid, ["event_id", "inst_id"])) == [(1, 5, 0, 4, 2), (2, 1, 0, 4, 4)]
    assert rows(layout.group_spans(laid.where("n = 0"), ["event_id", "inst_id"])) == [(1, 5, -1, -1, -1)]
    sizes = laid.groupBy("event_id").agg(F.sum("n").alias("n"))
    assert rows(layout.absolute(laid.select("event_id", "particle_id", "pc_start"), sizes, ["pc_start"])) == [(1, 5, 0), (1, 7, 2), (1, 9, 0), (2, 1, 4)]
    bad = spark.createDataFrame([(1, 0, 2, 2, False), (1, 4, 6, 2, False)], "g int, pc_start int, pc_end int, n int, is_le boolean")
    with pytest.raises(Exception, match="not contiguous"):
        layout.group_spans(bad, ["g"]).collect()


def test_stored_rows_and_redirection(spark, rows):
    p = spark.createDataFrame([(1, 0, None, 0, -1, -1), (1, 1, 0, 0, -1, -1), (1, 2, 1, 5, 2, 2), (1, 3, 2, 0, -1, -1), (1, 4, None, 0, -1, -1)], "event_id int, id int, parent_id int, n int, frag_id int, inst_id int")
    assert rows(layout.stored_rows(p).select("id")) == [(0,), (1,), (2,)]
    assert rows(layout.stored_rows(p, spark.createDataFrame([(1, 4)], "event_id int, id int")).select("id")) == [(0,), (1,), (2,), (4,)]
    q = p.withColumn("stored", F.col("id").isin(0, 2, 3))
    assert rows(layout.redirected(q).select("id", "parent_id", "ancestor_id")) == [(0, 0, 0), (2, 0, 0), (3, 2, 0)]


PART = "event_id int, id int, parent_id int, ancestor_id int, pdg int, parent_pdg int, geant4_trackid int, interaction_type int, sem_type int"


def cloud(spark, **at):
    return spark.createDataFrame([(1, int(p[1:]), 1000 * int(p[1:]) + i, *map(float, xyz)) for p, c in at.items() for i, xyz in enumerate(c)], "event_id int, particle_id int, point_id int, x double, y double, z double")


def test_le_chain_merges_and_largest_wins(spark):
    p = spark.createDataFrame([(1, i, None, i, 11, 0, i, I["compton"], S["le_scatter"]) for i in (1, 2, 3)], PART)
    c = cloud(spark, p1=[(0, 0, 0)], p2=[(0.05, 0, 0)] * 3, p3=[(0.1, 0, 0)] * 2)
    state, decisions, _, done = clustering.merge_fixpoint(p, c, Params(distance_threshold=0.06))
    assert {r.particle_id: r.rep_id for r in state.collect()} == {1: 2, 2: 2, 3: 2}
    assert {r.rule for r in decisions.collect()} == {"combine_le"}


def test_le_between_two_showers_joins_its_home(spark):
    p = spark.createDataFrame([(1, 1, None, 1, 13, 0, 1, I["primary"], S["track"]), (1, 2, None, 2, 11, 0, 2, I["primary"], S["shower"]), (1, 3, 2, 2, 11, 11, 3, I["ionization"], S["le_scatter"])], PART)
    c = cloud(spark, p1=[(0, 0, 0)], p2=[(2.0, 0, 0)], p3=[(0.9, 0, 0)])
    state, *_ = clustering.merge_fixpoint(p, c, Params(distance_threshold=1.5))
    assert {r.particle_id: r.rep_id for r in state.collect()} == {1: 1, 2: 2, 3: 2}


def test_photon_with_conversion_becomes_a_shower(spark):
    le = S["le_scatter"]
    rows_ = [
        (1, 1, None, 1, 22, 0, 1, I["primary"], le), (1, 2, 1, 1, 11, 22, 2, I["conversion"], le), (1, 3, None, 3, 11, 0, 3, I["compton"], le), (1, 4, None, 4, 13, 0, 4, I["primary"], S["track"]),
        (2, 1, None, 1, 22, 0, 1, I["primary"], le), (2, 2, 1, 1, 11, 22, 2, I["compton"], le), (2, 4, None, 4, 13, 0, 4, I["primary"], S["track"]),
        (3, 1, None, 1, 22, 0, 1, I["primary"], S["shower"]), (3, 2, 1, 1, 22, 22, 2, I["photon"], le), (3, 3, 2, 1, 11, 22, 3, I["conversion"], S["shower"]),
        (4, 1, None, 1, 22, 0, 1, I["primary"], le), (4, 2, 1, 1, 22, 22, 1, I["photon"], le), (4, 4, None, 4, 13, 0, 4, I["primary"], S["track"]),
    ]
    at = {(1, 1): 0, (1, 2): 10, (1, 3): 0.5, (1, 4): -0.5, (2, 1): 0, (2, 2): 0.5, (2, 4): -0.5, (3, 1): 0, (3, 2): 0.5, (3, 3): 10, (4, 1): 0, (4, 2): 10, (4, 4): -0.5}
    p = spark.createDataFrame(rows_, PART)
    c = spark.createDataFrame([(e, i, 1000 * e + 10 * i + k, float(x), 0.1 * k, 0.0) for (e, i), x in at.items() for k in range(9 if (e, i) == (1, 3) else 1)], "event_id int, particle_id int, point_id int, x double, y double, z double")
    state, *_ = clustering.merge_fixpoint(p, c, Params(distance_threshold=0.6))
    got = {(r.event_id, r.particle_id): (r.rep_id, r.sem_type) for r in state.collect()}
    # converted: neither combined with the larger low-energy cloud nor absorbed by the track, but takes in what is low-energy
    assert {k[1]: v for k, v in got.items() if k[0] == 1 and k[1] != 3} == {1: (1, S["shower"]), 2: (1, S["shower"]), 4: (4, S["track"])} and got[1, 3][0] in (1, 4)
    # a Compton electron promotes nothing; a piece of the photon itself neither
    assert {v for k, v in got.items() if k[0] in (2, 4)} == {(4, S["track"])}
    # a promoted photon joins the shower it touches
    assert {v for k, v in got.items() if k[0] == 3} == {(1, S["shower"])}


def test_shower_instances(spark):
    rows_ = [(1, 1, None, 1, 22, 0, 1, I["photon"], S["shower"]), (1, 4, 1, 1, 11, 22, 4, I["compton"], S["shower"]), (1, 5, 1, 1, 22, 11, 5, I["photon"], S["shower"]), (1, 6, 5, 1, 11, 22, 6, I["compton"], S["le_scatter"]), (1, 7, None, 7, 11, 0, 7, I["primary"], S["le_scatter"]), (1, 8, 7, 7, 11, 11, 8, I["ionization"], S["shower"]), (1, 9, 10, 9, 11, 11, 9, I["other_shower"], S["shower"]), (1, 10, 9, 9, 11, 11, 10, I["other_shower"], S["le_scatter"])]
    f = spark.createDataFrame(rows_, PART)
    m = spark.createDataFrame([(1, r[1], r[1]) for r in rows_], "event_id int, particle_id int, rep_id int")
    got = {r.frag_id: r.inst_id for r in clustering.merge_showers(f, m).collect()}
    assert got == {1: 1, 4: 4, 5: 1, 6: 1, 7: 7, 8: 8, 9: 9, 10: 9}


def test_pieces_buried_and_absorbed(spark, rows):
    p = spark.createDataFrame([(1, 1, None, 1, 13, 0, 1, I["primary"], S["track"]), (1, 2, 1, 1, 13, 13, 1, I["track"], S["le_scatter"]), (1, 3, 1, 1, 11, 13, 3, I["delta"], S["delta"]), (1, 4, 1, 1, 11, 13, 4, I["delta"], S["le_scatter"])], PART)
    m = spark.createDataFrame([(1, 1, 1), (1, 2, 2), (1, 3, 3), (1, 4, 1)], "event_id int, particle_id int, rep_id int")
    f = p.where("id <> 4")
    assert rows(clustering.split_pieces(f, m, p)) == [(1, 2, 1, S["track"])]
    assert rows(clustering.absorbed_deltas(m, p)) == [(1, 4)]
    c = cloud(spark, p1=[(3 * i + 1, 1, 1) for i in range(40)], p3=[(3 * i + 1, 1, 1) for i in range(8)] + [(1, 4, 1), (4, 4, 1)])
    assert rows(clustering.buried_deltas(f, m, p, c, 3.0, 8.0)) == [(1, 3, 1, 3.0)]
    assert clustering.buried_deltas(f, m, p, c, 3.0, 3.0).count() == 0


def test_defragment(spark, rows):
    p = spark.createDataFrame([(1, 1, None, 1, 11, 0, 1, 5, S["shower"]), (1, 2, None, 2, 13, 0, 2, 5, S["track"])], PART)
    c = cloud(spark, p1=[(i, 0, 0) for i in range(8)] + [(50, 0, 0), (51, 0, 0), (80, 0, 0)], p2=[(0, 9, 0), (50, 9, 0)])
    moved, pieces = clustering.defragment(c, p, Params(distance_threshold=1.5, min_pc_size=2))
    assert rows(pieces) == [(1, 3, 1, 2), (1, 4, 1, 1)]
    n = {(r.particle_id, r.new_id): r.n for r in moved.groupBy("particle_id", "new_id").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert n == {(1, 1): 8, (1, 3): 2, (1, 4): 1, (2, 2): 2}


def test_custom_partition(spark):
    p = spark.createDataFrame([(1, 1, 5), (1, 2, 6), (1, 3, 9), (2, 1, 5)], "event_id int, id int, v int")
    got = clustering.partition_custom(p, lambda a, b: F.abs(a["v"] - b["v"]) <= 1)
    assert {(r.event_id, r.particle_id): r.group_id for r in got.collect()} == {(1, 1): 1, (1, 2): 1, (1, 3): 3, (2, 1): 1}


def test_genealogy(spark, rows):
    t = spark.createDataFrame([(1, 1, -1), (1, 2, -1), (1, 3, 1), (1, 4, 2)], "event_id int, track_id int, parent_track_id int")
    out, wrong = primaries(t)
    assert rows(out.where("is_primary").select("track_id")) == [(1,), (2,)] and wrong.count() == 0
    out, wrong = primaries(t, spark.createDataFrame([(1, 1), (1, 3), (1, 9)], "event_id int, track_id int"))
    assert rows(wrong.select("track_id", "code")) == [(2, "parentless_not_primary"), (3, "primary_with_parent"), (9, "primary_not_in_particles")]
    n = spark.createDataFrame([(1, 1, None, 0.0), (1, 2, 1, 5.0), (1, 3, None, 9.0), (1, 4, 3, 2.0), (1, 5, 4, 7.0)], "event_id int, id int, parent int, x double").selectExpr("*", "0d as y", "0d as z", "0d as t")
    v = spark.createDataFrame([(1, 0, 77, 0.0), (1, 1, 88, 2.0)], "event_id int, vertex_row int, interaction_id int, x double").selectExpr("*", "0d as y", "0d as z", "0d as t")
    # 4 starts at a vertex but is no root: only roots are matched
    assert rows(interactions(n, v, "id", "parent").select("id", "interaction_id")) == [(1, 77), (2, 77), (3, None), (4, None), (5, None)]
    i = spark.createDataFrame([(1, 1, None, False, 0), (1, 2, 1, False, 0), (1, 3, 2, True, 0), (1, 4, None, False, 0), (1, 5, None, False, 1), (1, 6, 4, False, 0)], "event_id int, inst_id int, parent_inst int, visible boolean, interaction_id int")
    assert rows(traceable_instances(i).select("inst_id")) == [(1,), (2,), (3,), (4,)]


def test_first_last(spark):
    s = spark.createDataFrame([(1, 1, 1.0, 0, 1.0, True, False), (1, 1, 3.0, 1, 3.0, True, False), (1, 1, 50.0, 2, 2.5, False, False), (1, 2, 1.0, 3, 8.0, False, True)], "event_id int, inst_id int, t double, step_id int, z double, allowed boolean, is_shower boolean")
    got = {r.inst_id: (r.first_z, r.last_z) for r in layout.first_last_steps(s, keep=("z",)).collect()}
    assert got == {1: (1.0, 3.0), 2: (8.0, None)}


def test_geometry(spark):
    rows_ = [(1, float(a), float(b), 2.0 * a - 3.0 * b + 1) for a in range(5) for b in range(5)] + [(2, 1.0, 1.0, 1.0)]
    df = spark.createDataFrame(rows_, "v int, a double, b double, y double")
    f = {r.v: r for r in geometry.plane_fit(df, ["v"], "a", "b", "y").collect()}
    assert abs(f[1].b1 - 2) < 1e-9 and abs(f[1].b2 + 3) < 1e-9 and abs(f[1].b0 - 1) < 1e-9 and f[1].sure1 and f[2].b1 is None
    assert {r.v: r.ok for r in geometry.residual_check(df, ["v"], F.col("y") - F.col("y") + 1, 2.0).collect()} == {1: True, 2: None}
    with pytest.raises(Exception, match="differs too much"):
        geometry.calibrated(geometry.line_fit(df.where("v = 1"), ["v"], "a", "y"), 4.0).collect()


def test_inputs(spark, rows):
    assert inputs.resolved(["a", "b"], {"hits": "h", "seg": None}) == [{"events": "a", "hits": "h", "seg": None}, {"events": "b", "hits": "h", "seg": None}]
    with pytest.raises(ValueError):
        inputs.resolved(["a", "b", "c"], {"hits": ["h", "i"]})
    assert inputs.readout_type({}) == "wire"
    with pytest.raises(ValueError):
        inputs.readout_type({"readout_type": "film"})
    cols, missing = inputs.step_columns(spark.createDataFrame([(1.0, 2.0, 3.0, 4.0)], "x double, y double, z double, time double"))
    assert missing == ["de", "dx"] and len(cols) == 6
    with pytest.raises(ValueError):
        inputs.step_columns(spark.createDataFrame([(1.0,)], "x double"))
    e = spark.createDataFrame([(1, 5, 0, "/a/f", 0), (2, None, None, "/a/f", 1)], "event_id int, job_id int, job_event int, source string, source_event int")
    r = spark.createDataFrame([(10, 5, 0, "x", 9), (11, None, None, "/b/f", 1)], "entry int, job_id int, job_event int, source string, source_event int")
    assert rows(readout.paired_entries(e, r)) == [(1, 10), (2, 11)]
    with pytest.raises(Exception, match="entries of event"):
        readout.paired_entries(e, r.limit(1)).collect()


def test_store(spark, rows, tmp_path):
    p = spark.createDataFrame([(e, i, float(i)) for e in range(5) for i in range(4)], "event_id int, particle_id int, x double")
    m = spark.createDataFrame([(e, i, i // 2, 0, i == 3) for e in range(5) for i in range(3)], "event_id int, id int, frag_id int, inst_id int, is_le boolean")
    root = str(tmp_path / "s")
    St.write_table(p, root, "points", ["particle_id"], buckets=2)
    St.write_table(m, root, "membership", ["id"], "lz4", buckets=2, parts=2)
    s = St.EventStore(spark, root, 2)
    assert rows(s.table("points", [3])) == [(3, i, float(i)) for i in range(4)]
    assert rows(s.points_of("frag", F.col("group_id") == 0, events=[1]).select("particle_id")) == [(0,), (1,)]
    assert s.points_of("inst", F.col("group_id") == -1).count() == 5
    St.repack(spark, f"{root}/points", f"{root}/p2", "gzip")
    assert St.differences(spark.read.parquet(f"{root}/p2"), spark.read.parquet(f"{root}/points")).count() == 0
    import glob

    codecs = {r.codec for r in St.inspect_compression(spark, glob.glob(f"{root}/p2/*/*.parquet")).collect()}
    assert codecs == {"GZIP"}
    assert St.first_events(p, 2).count() == 8


def test_streaming(spark, rows, tmp_path):
    from driftloom.streaming.events import event_stream, once_per_key, run_per_batch

    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    df = spark.createDataFrame([(1, 1, 1.0), (1, 1, 2.0), (2, 1, 5.0)], "event_id int, particle_id int, de double").withColumn("at", F.lit("2024-01-01 00:00:00").cast("timestamp"))
    df.write.parquet(src)
    stream = event_stream(spark, src, "event_id int, particle_id int, de double, at timestamp")
    q = run_per_batch(stream, lambda b: b.groupBy("event_id").agg(F.sum("de").alias("de")), out, "totals", str(tmp_path / "c1"))
    q.awaitTermination()
    assert rows(spark.read.parquet(f"{out}/totals").select("event_id", "de")) == [(1, 3.0), (2, 5.0)]
    q = run_per_batch(once_per_key(stream, ["event_id"], "at", "1 hour"), lambda b: b.select("event_id"), out, "once", str(tmp_path / "c2"))
    q.awaitTermination()
    assert rows(spark.read.parquet(f"{out}/once").select("event_id")) == [(1,), (2,)]


def test_reports(spark, rows):
    d = spark.createDataFrame([(1, 1, 2, "MERGED", "a", 1), (1, 2, 1, " MergeOutcome.merged ", "a", 1), (1, 3, 4, "NOT_TOUCHING", "a", 1), (1, 3, 4, None, "b", 2)], "event_id int, id1 int, id2 int, reason string, stage string, pass_no int")
    assert rows(reports.decision_summary(d)) == sorted([("a", 1, "MERGED", 2), ("a", 1, "NOT_TOUCHING", 1), ("b", 2, None, 1)], key=str) or len(rows(reports.decision_summary(d))) == 3
    assert reports.why_not_merged(d, F.lit(4), F.lit(3)).count() == 2 and reports.why_not_merged(d, F.lit(2), F.lit(1)).count() == 0
    s = reports.loader_stalls(spark.createDataFrame([(0, 1.0, 3.0), (0, 1.0, 1.0)], "epoch int, wait_s double, step_s double")).collect()[0]
    assert s.batches == 2 and abs(s.stalled - 2 / 6) < 1e-12


def test_every_event_with_an_entry_is_paired(spark, rows, tmp_path):
    r = [(1, 0, 0, 5, 7, 0, "2024-01-01"), (2, 0, 0, 6, 7, 1, "2024-01-01"), (3, 0, 0, 0, None, None, "2024-01-01"), (4, 0, 0, 1, None, 3, "2024-01-01"), (5, 0, 1, -1, 7, 2, "2024-01-01"), (6, 0, 1, 2, 7, 4, "2024-01-01"), (6, 0, 1, -1, 7, 4, "2024-01-02")]
    spark.createDataFrame(r, "event_id bigint, input_no int, input_event bigint, jaxtpc_entry bigint, job_id bigint, job_event bigint, recorded_at string").withColumn("recorded_at", F.col("recorded_at").cast("timestamp")).write.parquet(str(tmp_path / "run_events.parquet"))
    assert rows(queries.paired_entries(spark, str(tmp_path))) == [(1, 1), (2, 2), (3, 3), (4, 4)]


def test_tracks_on_circles_have_a_root(spark, rows, tmp_path):
    # event 1: a tree, a circle 5-7-6 with 8 and 9 running into it, a parent that is absent; event 2: a circle of two
    up = {(1, 1): None, (1, 2): 1, (1, 3): 2, (1, 5): 7, (1, 6): 5, (1, 7): 6, (1, 8): 6, (1, 9): 8, (1, 10): 99, (1, 11): 11, (2, 1): 2, (2, 2): 1}
    spark.createDataFrame([(e, n, u, False, 1) for (e, n), u in up.items()], "event_id bigint, track_id int, parent_track_id int, dropped boolean, recorded_at int").withColumn("recorded_at", F.timestamp_seconds("recorded_at")).write.parquet(str(tmp_path / "geant4.parquet"))

    def root(e, n):
        seen = [n]
        while (u := up[e, seen[-1]]) is not None and u != seen[-1] and (e, u) in up and u not in seen:
            seen.append(u)
        return (min(seen[seen.index(u):]), None) if u in seen and u != seen[-1] else (seen[-1], len(seen) - 1)

    assert rows(queries.ancestor_root(spark, str(tmp_path))) == sorted((e, n, *root(e, n)) for e, n in up)


def test_points_without_dx_share_their_energy(spark, tmp_path):
    df = pts(spark, [(1, 0, 0, 0, 0, 0, 6, 1), (1, 1, 0, 0, 0, 0, 1, 3), (1, 2, 0, 0, 0, 0, 5, 9), (2, 3, 0, 0, 0, 0, 4, 9), (3, 4, 0, 0, 0, 0, float("nan"), 1), (3, 5, 0, 0, 0, 0, 2, float("nan")), (3, 6, 0, 0, 0, 0, 2, 3)])
    df.withColumn("dx", F.when(F.col("dx") != 9, F.col("dx"))).write.parquet(str(tmp_path / "points.parquet"))
    got = {r.point_id: r.true_de for r in queries.shared_energy(spark, str(tmp_path)).collect()}
    assert got == {0: 3.0, 1: 9.0, 2: 0.0, 3: 0.0, 4: 1.0, 5: 0.0, 6: 3.0}

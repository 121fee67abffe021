"""The merge fixpoint against a plain sequential version, and the whole run on a small event."""

import random

import pytest
from pyspark.sql import functions as F

from driftloom.enums import INTERACTION as I
from driftloom.enums import SEMANTIC as S
from driftloom.operators import clustering, geometry, layout
from driftloom.operators.reports import write_decisions
from driftloom.params import Params
from driftloom.run import group_owners, run_events, write_run
from driftloom.sources import store as St

LE = S["le_scatter"]
PART = "event_id int, id int, parent_id int, ancestor_id int, pdg int, parent_pdg int, geant4_trackid int, interaction_type int, sem_type int"


class Plain:
    """One event, merged pair by pair in Python."""

    def __init__(self, particles, points, distance):
        self.p = {r[1]: dict(zip(("parent", "ancestor", "pdg", "ppdg", "g4", "kind", "sem"), r[2:])) for r in particles}
        self.xyz = {i: [q[3:] for q in points if q[1] == i] for i in self.p}
        self.rep = {i: i for i in self.p}
        self.d = distance

    def cloud(self, rep):
        return [x for i, r in self.rep.items() if r == rep for x in self.xyz[i]]

    def near(self, a, b):
        ds = [sum((u - v) ** 2 for u, v in zip(x, y)) ** 0.5 for x in self.cloud(a) for y in self.cloud(b)]
        return min(ds) if ds and min(ds) <= self.d else None

    def reps(self):
        return sorted(set(self.rep.values()))

    def kids(self):
        for i, c in self.p.items():
            g = self.p.get(c["parent"])
            if g and c["parent"] != i and g["pdg"] == 22:
                pair = abs(c["pdg"]) == 11 and c["kind"] == I["conversion"] and c["ppdg"] == 22
                if pair or (c["pdg"] == 22 and c["g4"] == g["g4"]):
                    yield i, c["parent"], pair

    def photon_decay(self):
        for _, g, pair in self.kids():
            if pair and self.p[self.rep[g]]["sem"] == LE:
                self.p[self.rep[g]]["sem"] = S["shower"]
        return {(self.rep[a], self.rep[b]) for a, b, _ in self.kids() if self.rep[a] != self.rep[b]}

    def combine_le(self):
        le = [r for r in self.reps() if self.p[r]["sem"] == LE]
        return {(b, a) if len(self.cloud(a)) >= len(self.cloud(b)) else (a, b) for a in le for b in le if a < b and self.near(a, b) is not None}

    def home(self, r):
        at, seen = r, set()
        while at in self.p and at not in seen:
            seen.add(at)
            up = self.p[at]["parent"]
            if up in self.p and self.rep[up] != r:
                return self.rep[up]
            at = up if up != at else None
        return None

    def absorb_le(self):
        out = set()
        for r in self.reps():
            if self.p[r]["sem"] == LE:
                touch = [(q != self.home(r), self.near(r, q), q) for q in self.reps() if self.p[q]["sem"] != LE and self.near(r, q) is not None]
                if touch:
                    out.add((r, min(touch)[2]))
        return out

    def touching_em(self):
        out = set()
        for r in self.reps():
            c = self.p[r]
            if c["pdg"] in (11, 22) and c["sem"] != LE and c["parent"] in self.p and c["parent"] != r:
                q = self.rep[c["parent"]]
                if q != r and self.p[q]["pdg"] in (11, 22) and self.p[q]["sem"] != LE and self.p[q]["ancestor"] == c["ancestor"] and self.near(r, q) is not None:
                    out.add((r, q))
        return out

    def merge(self, pairs):
        group = {}
        for a, b in pairs:
            group.setdefault(a, {a})
            group.setdefault(b, {b})
            both = group[a] | group[b]
            for x in both:
                group[x] = both
        kids = {a for a, _ in pairs}
        for i, r in self.rep.items():
            if r in group:
                self.rep[i] = min((x in kids, x) for x in group[r])[1]

    def run(self):
        while True:
            n = 0
            for rule in (self.photon_decay, self.combine_le, self.absorb_le, self.touching_em):
                pairs = rule()
                self.merge(pairs)
                n += len(pairs)
            if not n:
                return self.rep


def test_fixpoint_is_that_of_a_plain_version(spark):
    rng = random.Random(7)
    particles, points = [], []
    for e in range(12):
        n = rng.randint(4, 16)
        for i in range(n):
            parent = rng.choice([None, i, rng.randint(0, n + 1), max(0, i - 1)])
            pdg = rng.choice([11, -11, 22, 22, 13])
            particles.append((e, i, parent, rng.choice([0, 0, 1]), pdg, rng.choice([22, 22, 11, 0]), rng.choice([i, i, rng.randint(0, n)]), rng.choice([I["conversion"], I["compton"], I["photon"]]), rng.choice([LE, LE, S["shower"], S["track"]])))
            points += [(e, i, 10_000 * e + 100 * i + k, *(rng.uniform(0, 9) for _ in range(3))) for k in range(rng.randint(0, 4))]
    want = {}
    for e in range(12):
        want |= {(e, i): r for i, r in Plain([p for p in particles if p[0] == e], [q for q in points if q[0] == e], 1.6).run().items()}
    p = spark.createDataFrame(particles, PART)
    c = spark.createDataFrame(points, "event_id int, particle_id int, point_id int, x double, y double, z double")
    f = clustering.merge_fixpoint(p, c, Params(distance_threshold=1.6))
    assert {(r.event_id, r.particle_id): r.rep_id for r in f.state.collect()} == want
    assert f.converged and f.passes > 1
    tried = {(r.rule, r.outcome) for r in f.decisions.select("rule", "outcome").distinct().collect()}
    assert {o for _, o in tried} <= {"MERGED", "NOT_TOUCHING", "ALREADY_MERGED_WITH_OTHER"} and ("touching_em", "NOT_TOUCHING") in tried and ("absorb_le", "MERGED") in tried
    assert not clustering.merge_fixpoint(p, c, Params(distance_threshold=1.6, max_passes=1)).converged


def event():
    """A muon along x with a delta on it and one apart; a photon that converts into a pair, whose electron radiates; a neutron that leaves nothing; a loose low-energy blob."""
    particles = [
        (1, 0, None, 0, 13, 0, 1, 0, I["primary"]), (1, 1, 0, 0, 11, 13, 2, 0, I["delta"]), (1, 2, 0, 0, 11, 13, 3, 0, I["delta"]), (1, 3, None, 3, 22, 0, 4, 1, I["primary"]),
        (1, 4, 3, 3, 11, 22, 5, 1, I["conversion"]), (1, 5, 3, 3, -11, 22, 6, 1, I["conversion"]), (1, 6, 4, 3, 22, 11, 7, 1, I["photon"]), (1, 7, 6, 3, 11, 22, 8, 1, I["compton"]), (1, 8, None, 8, 2112, 0, 9, 2, I["primary"]), (1, 9, 8, 8, 11, 2112, 10, 2, I["compton"]),
    ]
    line = lambda y, n, x0=0.0: [(x0 + 3.0 * k, y, 0.0) for k in range(n)]
    clouds = {0: line(0.0, 40), 1: line(1.0, 6, 30.0), 2: [(60.0 + 3.0 * k, 3.0 * k + 3.0, 0.0) for k in range(12)], 4: line(300.0, 10), 5: line(306.0, 8), 7: [(200.0, 300.0 + 3.0 * k, 0.0) for k in range(9)], 9: [(500.0, 500.0, 3.0)]}
    points = [(1, i, 1000 * i + k, float(x), float(y), float(z), float(10 * i + k), 1.0, 0.5) for i, c in clouds.items() for k, (x, y, z) in enumerate(c)]
    return particles, points


@pytest.fixture(scope="module")
def ran(spark):
    particles, points = event()
    p = spark.createDataFrame(particles, "event_id int, id int, parent_id int, ancestor_id int, pdg int, parent_pdg int, geant4_trackid int, interaction_id int, interaction_type int")
    q = spark.createDataFrame(points, "event_id int, particle_id int, point_id int, x float, y float, z float, t float, de float, dx float")
    params = Params(delta_min_standoff=8.0)
    return run_events(p, q, params), q, params


def test_run(ran):
    run, q, _ = ran
    m = {r.id: r for r in run.membership.collect()}
    # the pair joins its photon, the electron's photon and its Compton the same shower; the delta on the muon is buried, the other stays
    assert {i: r.frag_id for i, r in m.items()} | {9: 9} == {0: 0, 1: 0, 2: 2, 3: 3, 4: 3, 5: 3, 6: 6, 7: 7, 8: 8, 9: 9}
    assert m[7].inst_id == 3 and m[0].inst_id == 0 and m[2].inst_id == 2 and m[9].is_le
    rows = {r.id: r for r in run.particles.orderBy("row_no").collect()}
    assert [r.row_no for r in rows.values()] == list(range(len(rows)))
    assert rows[1].sem_type == S["delta"] and rows[1].frag_id == -1 and rows[0].frag_merge_count == 2
    assert (rows[3].inst_pc_start, rows[3].inst_pc_end) != (-1, -1) and rows[3].inst_merge_count == 5
    # ranges: fragments lie within their instances, and instances do not overlap
    spans = sorted((r.inst_pc_start, r.inst_pc_end) for r in rows.values() if r.inst_id >= 0 and r.inst_pc_start >= 0)
    assert all(a[1] <= b[0] for a, b in zip(spans, spans[1:]))
    assert {(i, rows[i].parent_id) for i in (0, 2, 3)} == {(0, 0), (2, 0), (3, 3)}
    n = run.points.count()
    assert sorted(r.point_row for r in run.points.collect()) == list(range(n))
    assert run.voxmap.select("point_id").distinct().count() == q.count()
    i = {r.vertex_id: r for r in run.interactions.collect()}
    assert [i[v].interaction_id for v in sorted(i)] == list(range(len(i))) and i[0].part_start == 0
    own = {r.group_id: (r.fragment_id, r.straddled) for r in group_owners(run, q.select("event_id", "point_id", F.floor(F.col("point_id") / 1000).alias("group_id"))).collect()}
    assert own[1] == (0, False) and own[5] == (3, False)


def test_run_is_stored_and_read(spark, ran, tmp_path):
    run, _, params = ran
    root = str(tmp_path / "out")
    write_run(run, root, params, spark.createDataFrame([(1, 0, 0)], "event_id int, input int, input_event int"), buckets=2)
    s = St.EventStore(spark, root, 2)
    assert s.version() == St.VERSION and len(s) == 1
    with s as held:
        one = held[-1]
        assert {"particles", "points", "interactions", "membership", "decisions", "voxmap", "issues", "events"} == set(one)
        assert one["points"].count() == run.points.count() and len(list(held)) == 1
        with pytest.raises(IndexError):
            held[1]
    assert s.interaction_of().where("i_vertex_id is not null").count() == run.particles.where("interaction_id >= 0").count()
    assert s.points_of("inst", F.col("group_id") == 3).count() == s.points_of("inst", F.col("group_id") == 3, le=False).count() + s.points_of("inst", F.col("group_id") == 3, le=True).count() > 0
    assert St.repack_store(spark, root, str(tmp_path / "packed"), tables=["points", "particles"]) == {"points": "gzip", "particles": "gzip"}
    write_decisions(run.decisions, str(tmp_path / "why"))
    assert spark.read.json(str(tmp_path / "why/decisions")).count() == run.decisions.count()
    old = str(tmp_path / "old")
    spark.createDataFrame([("version", "2.0")], "name string, value string").write.json(f"{old}/meta")
    with pytest.raises(ValueError, match="2.0"):
        St.EventStore(spark, old).version()


def test_run_of_nothing(spark):
    p = spark.createDataFrame([], "event_id int, id int, parent_id int, ancestor_id int, pdg int, parent_pdg int, geant4_trackid int, interaction_id int, interaction_type int")
    q = spark.createDataFrame([], "event_id int, particle_id int, point_id int, x float, y float, z float, t float, de float, dx float")
    run = run_events(p, q)
    assert run.particles.count() == 0 and run.points.count() == 0 and run.converged


def test_medians_and_positions_in_the_file(spark):
    rng = random.Random(5)
    rows = [(k, rng.choice([rng.gauss(0, 1e6), 0.0, 1.5, -2.0])) for k in (1, 2, None) for _ in range(101 if k == 1 else 50)] + [(3, 4.0), (4, None), (5, float("nan")), (5, 7.0)]
    got = {r.k: (r.n, r.median) for r in geometry.medians(spark.createDataFrame(rows, "k int, v double"), ["k"], "v", parts=4).collect()}
    want = {}
    for k in (1, 2, None, 3, 5):
        v = sorted(x for j, x in rows if j == k and x is not None and x == x)
        want[k] = (len(v), (v[(len(v) - 1) // 2] + v[len(v) // 2]) / 2)
    assert got == want
    sizes = spark.createDataFrame([(e, e % 7) for e in range(300) if e % 11], "event_id int, n int")
    base, at = {}, 0
    for e in range(300):
        if e % 11:
            base[e] = at
            at += e % 7
    assert {r.b_e: r.base for r in layout.running_base(sizes, width=16).collect()} == base
    ranges = sizes.select("event_id", F.lit(3).cast("bigint").alias("start"), F.lit(-1).cast("bigint").alias("end"))
    there = layout.absolute(ranges, sizes, ["start", "end"])
    assert sorted(tuple(r) for r in layout.relative(there, sizes, ["start", "end"]).collect()) == sorted(tuple(r) for r in ranges.collect())


def random_events(spark, events=40):
    """Events of any genealogy: circles, absent parents, self-parents, nulls, pieces, deltas, photons, and clouds that touch or repeat."""
    rng = random.Random(11)
    particles, points = [], []
    for e in range(events):
        n = rng.randint(1, 24)
        for i in range(n):
            parent = rng.choice([None, i, rng.randint(0, n + 2), rng.randint(0, n - 1), max(0, i - 1)])
            kind = rng.choice([I["primary"], I["delta"], I["delta"], I["conversion"], I["compton"], I["photoelectron"], I["photon"], I["decay"], I["track"], I["ionization"], None])
            particles.append((e, i * 3, None if parent is None else parent * 3, rng.choice([None, 0, i * 3, 999]), rng.choice([11, -11, 22, 22, 13, 2112, None]), rng.choice([22, 22, 11, 13, None]), rng.choice([i, i, 1, None]), rng.choice([0, 0, 1, 2, -1, None]), kind))
            at, k = [rng.uniform(0, 40) for _ in range(3)], rng.choice([0, 0, 1, 3, 12, 30])
            step = [rng.uniform(-2, 2) for _ in range(3)]
            points += [(e, i * 3, 100_000 * e + 1000 * i + j, *(a + b * j + rng.choice([0.0, 0.0, 12.0]) for a, b in zip(at, step)), float(j), 0.5, 0.25) for j in range(k)]
            points += [(e, 5000, 100_000 * e + 1000 * i + 900, 0.0, 0.0, 0.0, 0.0, 1.0, 1.0), (e, i * 3, 100_000 * e + 1000 * i + 901, float("nan"), 0.0, 0.0, 0.0, 1.0, 1.0)]
    p = spark.createDataFrame(particles, "event_id int, id int, parent_id int, ancestor_id int, pdg int, parent_pdg int, geant4_trackid int, interaction_id int, interaction_type int")
    return p, spark.createDataFrame(points, "event_id int, particle_id int, point_id int, x float, y float, z float, t float, de float, dx float")


TABLES = ("particles", "points", "interactions", "decisions", "membership", "voxmap", "pieces", "issues")


@pytest.fixture(scope="module")
def both_ways(spark):
    """A run of events within tasks, one by operators on tables, and one of which some events go either way: each table's columns and sorted rows, and whether merging converged."""
    p, q = random_events(spark)
    params = Params(delta_min_standoff=8.0)
    keep, vertices = spark.createDataFrame([(e, 3) for e in range(0, 40, 2)] + [(77, 1)], "event_id int, id int"), spark.createDataFrame([(e, v, f"v{v}") for e in range(40) for v in (0, 1)], "event_id int, vertex_row int, name string")
    out = []
    for rows in (10**6, 0, 120):
        r = run_events(p, q, params, vertices, keep, event_rows=rows)
        out.append(({k: (sorted(getattr(r, k).dtypes), sorted(map(repr, getattr(r, k).select(sorted(getattr(r, k).columns)).collect()))) for k in TABLES}, r.converged))
    return out


@pytest.mark.parametrize("table", TABLES)
def test_events_within_tasks_give_the_rows_of_operators_on_tables(both_ways, table):
    (within, a), (spread, b), (mixed, c) = both_ways
    assert a == b == c and within[table][1]
    assert within[table] == spread[table] and mixed[table] == spread[table]


def test_run_takes_few_jobs(spark):
    """However often its rules go round: over operators on tables these events take hundreds of jobs, which is what a run of small events used to cost."""
    p, q = random_events(spark)
    spark.sparkContext.setJobGroup("few-jobs", "a run")
    try:
        run_events(p, q, Params(delta_min_standoff=8.0))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert 0 < len(spark.sparkContext.statusTracker().getJobIdsForGroup("few-jobs")) < 100


def test_group_owners_are_the_same_either_way(spark):
    p, q = random_events(spark, 5)
    groups = q.select("event_id", "point_id", F.floor(F.col("point_id") / 16).alias("group_id"))
    within, spread = (sorted(map(tuple, group_owners(run_events(p, q, Params(delta_min_standoff=8.0), event_rows=n), groups).collect())) for n in (10**6, 0))
    assert within == spread and within

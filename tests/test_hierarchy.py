"""Pointer doubling, references and components against brute force."""

import random

from driftloom.operators.components import connected_components
from driftloom.operators.genealogy import nearest_marked, resolve_orphans, true_ancestors
from driftloom.operators.hierarchy import descendants, resolve_hierarchy
from driftloom.operators.references import orphan_references

NODES = "event_id bigint, id int, parent int"


def walk(nodes):
    """Root, depth and path of each node, by walking; None in or below a circle."""
    up = {(e, i): p for e, i, p in nodes if i is not None}
    out = {}
    for e, i, p in nodes:
        path, at = [i], p if p != i else None
        while at is not None and (e, at) in up and len(path) <= len(up) + 1:
            path.append(at)
            q = up[e, at]
            at = q if q != at else None
        out[e, i] = None if len(path) > len(up) else (path[-1], len(path) - 1, path[::-1])
    return out


def test_random_forests_with_circles(spark):
    rng = random.Random(5)
    nodes = []
    for e in range(6):
        n = rng.randint(1, 60)
        for i in range(n):
            kind = rng.random()
            nodes.append((e, i, None if kind < 0.1 else i if kind < 0.15 else rng.randint(0, n + 3) if kind < 0.5 else max(0, i - 1)))
    got = {(r.event_id, r.id): (r.root_id, r.depth, r.path) if not r.in_loop else None for r in resolve_hierarchy(spark.createDataFrame(nodes, NODES), "id", "parent", ("event_id",)).collect()}
    assert got == walk(nodes)


def test_long_chain_takes_logarithmic_rounds(spark):
    nodes = [(1, i, i - 1 if i else None) for i in range(300)]
    r = resolve_hierarchy(spark.createDataFrame(nodes, NODES), "id", "parent", ("event_id",), path=False)
    assert {(x.id, x.root_id, x.depth) for x in r.collect()} == {(i, 0, i) for i in range(300)}


def test_nulls_repeats_and_clashing_names(spark):
    nodes = [(1, None, 5, "a"), (1, 5, None, "b"), (1, 5, None, "b"), (None, 7, 5, "c"), (1, 6, 5, "d"), (1, 8, 99, "e"), (1, None, None, "f")]
    df = spark.createDataFrame(nodes, "event_id bigint, n int, p int, depth string")
    got = sorted((str(r.event_id), str(r.n), str(r.root_id), str(r.depth)) for r in resolve_hierarchy(df, "n", "p", ("event_id",)).collect())
    assert got == sorted([("1", "None", "5", "1"), ("1", "5", "5", "0"), ("None", "7", "7", "0"), ("1", "6", "5", "1"), ("1", "8", "8", "0"), ("1", "None", "None", "0")])


def test_empty(spark):
    e = spark.createDataFrame([], NODES)
    assert resolve_hierarchy(e, "id", "parent", ("event_id",)).count() == 0
    assert descendants(resolve_hierarchy(e, "id", "parent", ("event_id",)), ("event_id",)).count() == 0
    assert connected_components(e, "id", "parent", ("event_id",)).count() == 0


def test_descendants(spark, rows):
    d = descendants(resolve_hierarchy(spark.createDataFrame([(1, 1, None), (1, 2, 1), (1, 3, 2), (2, 2, 1)], NODES), "id", "parent", ("event_id",)), ("event_id",))
    assert rows(d) == [(1, 1, 2, 1), (1, 1, 3, 2), (1, 2, 3, 1)]


def test_circle_heads_and_marks(spark, rows):
    nodes = spark.createDataFrame([(1, 1, 2), (1, 2, 3), (1, 3, 2), (1, 0, 1), (1, 9, None), (1, 10, 9)], NODES)
    got = {r.id: (r.root_id, r.depth) for r in true_ancestors(nodes, "id", "parent").collect()}
    assert got == {1: (2, None), 2: (2, None), 3: (2, None), 0: (2, None), 9: (9, 0), 10: (9, 1)}
    m = spark.createDataFrame([(1, 1, None, True), (1, 2, 1, False), (1, 3, 2, True), (1, 4, 3, False), (1, 5, 8, False)], NODES + ", m boolean")
    assert {r.id: r.nearest for r in nearest_marked(m, "id", "parent", "m").collect()} == {1: None, 2: 1, 3: 1, 4: 3, 5: None}
    assert {r.id: r.nearest for r in nearest_marked(m, "id", "parent", "m", own=True).collect()} == {1: 1, 2: 1, 3: 3, 4: 3, 5: None}


def test_resolve_orphans(spark):
    p = spark.createDataFrame([(1, 1, 7, 7), (1, 2, 1, 7), (1, 3, 2, 1)], "event_id bigint, id int, parent_id int, ancestor_id int")
    assert {tuple(r)[1:] for r in resolve_orphans(p).collect()} == {(1, 1, 1), (2, 1, 1), (3, 2, 1)}


RECS = "target_table string, event_id bigint, target_id int, present boolean"
REFS = "ref_table string, event_id bigint, child_id int, target_table string, target_id int, month string, level int"


def test_orphans_direct_and_inherited(spark):
    refs = [("t", 1, 2, "t", 9, "m", 1), ("t", 1, 3, "t", 2, "m", 1), ("t", 1, 4, "t", 3, "m", 1), ("t", 1, 5, "t", None, "m", 1), ("t", 1, 6, "t", 8, "m", 1), ("g", 1, 1, "t", 4, "m", 1), ("t", None, 7, "t", 5, "m", 1)]
    refs += [("t", 2, i, "t", i - 1, "m", 1) for i in range(1, 15)]
    recs = [("t", 1, i, True) for i in (2, 3, 4, 5, 6)] + [("t", 1, 8, False)] + [("t", 2, i, True) for i in range(1, 15)]
    out = orphan_references(spark.createDataFrame(refs, REFS), spark.createDataFrame(recs, "target_table string, event_id bigint, target_id int, present boolean"), ("event_id",), ["month"])
    got = {(r.ref_table, r.event_id, r.child_id): (r.missing_id, r.level, r.withdrawn) for r in out.collect()}
    want = {("t", 1, 2): (9, 0, False), ("t", 1, 3): (9, 1, None), ("t", 1, 4): (9, 2, None), ("g", 1, 1): (9, 3, None), ("t", 1, 6): (8, 0, True), ("t", None, 7): (5, 0, False)}
    want |= {("t", 2, i): (0, i - 1, False if i == 1 else None) for i in range(1, 15)}
    assert got == want


def brute_orphans(refs, recs):
    """(reference, missing, level) of every orphaned reference, by walking level by level."""
    there = {r[:3] for r in recs if r[3]}
    refs = {r for r in refs if r[4] is not None}
    out, level_of, n = {}, {}, 0
    for r in refs:
        if r[1] is None or (r[3], r[1], r[4]) not in there:
            out[r] = (r[4], 0)
            if r[1] is not None:
                k = (r[0], r[1], r[2])
                level_of[k] = (0, min(level_of.get(k, (0, r[4]))[1], r[4]))
    while True:
        new = {}
        for r in refs - set(out):
            above = level_of.get((r[3], r[1], r[4]))
            if above and above[0] == n:
                out[r] = (above[1], n + 1)
                k = (r[0], r[1], r[2])
                if k not in level_of:
                    new[k] = min(new.get(k, (n + 1, above[1])), (n + 1, above[1]))
        if not new:
            return out
        level_of |= new
        n += 1


def test_records_with_several_references(spark):
    few = [("t", 1, 11, "t", 90, "m", 1), ("t", 1, 12, "t", 11, "m", 1), ("t", 1, 13, "t", 11, "m", 1), ("t", 1, 13, "t", 12, "m", 1), ("t", 1, 14, "t", 13, "m", 1), ("t", 1, 12, "t", 11, "m", 1)]
    recs = [("t", 1, i, True) for i in (11, 12, 13, 14)]
    for others in (0, 40):
        more = [("t", 2, i, "t", 1000 + i, "m", 1) for i in range(others)]
        out = orphan_references(spark.createDataFrame(few + more, REFS), spark.createDataFrame(recs, RECS), carry=["month"]).where("event_id = 1").collect()
        assert sorted((r.child_id, r.target_id, r.missing_id, r.level) for r in out) == [(11, 90, 90, 0), (12, 11, 90, 1), (13, 11, 90, 1), (13, 12, 90, 2), (14, 13, 90, 2)]


def test_random_references(spark):
    rng = random.Random(11)
    recs = [("t", e, i, rng.random() < 0.95) for e in range(4) for i in range(60) if rng.random() < 0.95] + [("u", e, i, True) for e in range(4) for i in range(20)]
    refs = [("t", e, i, "t", rng.randint(0, 65) if rng.random() < 0.2 else i - 1 if rng.random() < 0.9 else None, "m", 1) for e in range(4) for i in range(60) for _ in range(rng.choice([1, 1, 1, 2]))]
    refs += [("u", e, rng.randint(0, 19), rng.choice(["t", "u"]), rng.randint(0, 25), "m", 1) for e in range(4) for _ in range(30)] + [("g", e, i, "u", rng.randint(0, 25), "m", 1) for e in range(4) for i in range(30)] + [("t", None, 3, "t", 4, "m", 1)]
    out = orphan_references(spark.createDataFrame(refs, REFS), spark.createDataFrame(recs, RECS), carry=["month"]).collect()
    got = {(r.ref_table, r.event_id, r.child_id, r.target_table, r.target_id, r.month): (r.missing_id, r.level) for r in out}
    want = {r[:6]: v for r, v in brute_orphans(set(refs), recs).items()}
    assert len(out) == len(got) and got == want


def test_orphans_empty(spark):
    out = orphan_references(spark.createDataFrame([], REFS), spark.createDataFrame([], "target_table string, event_id bigint, target_id int, present boolean"))
    assert out.count() == 0


def test_components_random(spark):
    rng = random.Random(3)
    pairs = [(e, rng.randint(0, 80), rng.randint(0, 80)) for e in range(3) for _ in range(60)] + [(7, i, i + 1) for i in range(100)] + [(8, 0, i) for i in range(100)] + [(1, None, 3), (None, 1, 2)]
    pairs += pairs[:40]
    find = {}

    def root(x):
        while find.setdefault(x, x) != x:
            x = find[x]
        return x

    for e, a, b in pairs:
        if None not in (e, a, b) and a != b:
            x, y = sorted((root((e, a)), root((e, b))))
            find[y] = x
    want = {(e, n): root((e, n))[1] for e, n in find}
    got = connected_components(spark.createDataFrame(pairs, "event_id bigint, node int, component int"), "node", "component", ("event_id",))
    assert {(r.event_id, r.node): r.component for r in got.collect()} == want

"""Regions and neighbours against brute force."""

import math
import random

import pytest

from driftloom.operators.spatial import box_outlines, matched, near_pairs, points_in_regions, standoff, touching

NAN = float("nan")


def inside(x, y, ring):
    odd = False
    for i, (x1, y1) in enumerate(ring):
        x2, y2 = ring[(i + 1) % len(ring)]
        if (y1 <= y) != (y2 <= y) and (x1 if x1 == x2 else x1 + (y - y1) * (x2 - x1) / (y2 - y1)) > x:
            odd = not odd
    return odd


def test_polygons_with_many_edges(spark):
    rng = random.Random(2)
    rings = {1: [(0.0, 0.0), (10.0, 0.0), (10.0, 10.0), (5.0, 3.0), (0.0, 10.0)], 2: [(12 + 5 * math.cos(k / 3.5), 5 + 5 * math.sin(k / 3.5)) for k in range(22)], 3: [(0.0, 0.0), (1.0, 1.0)]}
    outlines = spark.createDataFrame([(i, [{"x": x, "y": y} for x, y in r], -1.0 if i == 1 else None, 1.0 if i == 1 else None) for i, r in rings.items()], "region_id int, ring array<struct<x:double,y:double>>, z_low double, z_high double")
    pts = [(i, rng.uniform(-1, 18), rng.uniform(-1, 11), rng.choice([-1.0, 0.0, 1.0])) for i in range(400)] + [(1000, None, 1.0, 0.0), (1001, 1.0, NAN, 0.0), (1002, 5.0, 3.0, 0.0), (1003, float("inf"), 3.0, 0.0)]
    want = {(i, r) for i, x, y, z in pts for r, ring in rings.items() if len(ring) > 2 and x is not None and not math.isnan(y) and math.isfinite(x) and (r != 1 or -1 <= z < 1) and inside(x, y, ring)}
    df = spark.createDataFrame(pts, "point_id int, x double, y double, z double")
    for strip in (None, 0.7, 50.0):
        for key in (("point_id",), ()):
            got = [(r.point_id, r.region_id) for r in points_in_regions(df.unionByName(df), outlines, key=key, strip=strip).collect()]
            assert set(got) == want and len(got) == len(want)


def test_repeated_points_count_once(spark):
    ring = [{"x": 10 * math.cos(2 * math.pi * k / 64), "y": 10 * math.sin(2 * math.pi * k / 64)} for k in range(64)]
    disc = spark.createDataFrame([(1, ring, None, None), (2, [{"x": float("nan"), "y": 0.0}] * 4, None, None), (3, None, None, None), (4, ring, None, None), (4, [{"x": c["x"] / 2, "y": c["y"] / 2} for c in ring], None, None)], "region_id int, ring array<struct<x:double,y:double>>, z_low double, z_high double")
    pts = spark.createDataFrame([(1, 0.3, 0.2, "a"), (1, 0.3, 0.2, "b"), (2, 9.9, 9.9, "a"), (3, 7.0, 0.0, "a"), (None, 1.0, 1.0, "a"), (None, 2.0, 7.0, "a")], "id int, x double, y double, region_id string")
    for strip in (0.2, 5.0, 20.0):
        got = sorted((str(r.id), r.region_id) for r in points_in_regions(pts, disc, z=None, key=("id",), strip=strip).collect())
        assert got == [("1", 1), ("3", 1), ("3", 4), ("None", 1), ("None", 1), ("None", 4)]


def test_shared_faces_belong_to_one_box(spark):
    boxes = spark.createDataFrame([(0, 0.0, 1.0, 0.0, 1.0, 0.0, 1.0), (1, 1.0, 2.0, 0.0, 1.0, 0.0, 1.0), (2, 0.0, 1.0, 1.0, 2.0, 0.0, 1.0), (3, 0.0, 1.0, 0.0, 1.0, 1.0, 2.0)], "v int, a double, b double, c double, d double, e double, f double")
    o = box_outlines(boxes, "v", ("a", "b"), ("c", "d"), ("e", "f"))
    pts = spark.createDataFrame([(1, 1.0, 0.5, 0.5, "k"), (2, 0.5, 1.0, 0.5, "k"), (3, 0.5, 0.5, 1.0, "k"), (4, 0.0, 0.0, 0.0, "k"), (5, 2.0, 0.5, 0.5, "k"), (6, -0.1, 0.5, 0.5, "k")], "id int, x float, y float, z float, strip string")
    got = points_in_regions(pts, o)
    assert {(r.id, r.region_id) for r in got.collect()} == {(1, 1), (2, 2), (3, 3), (4, 0)}
    assert points_in_regions(pts.limit(0), o).count() == 0
    assert points_in_regions(pts, o.limit(0)).count() == 0


def cloud(seed=0, n=300):
    rng = random.Random(seed)
    pts = [(rng.randint(0, 2), rng.randint(0, 6), i, rng.uniform(-20, 20), rng.uniform(-20, 20), rng.uniform(-20, 20)) for i in range(n)]
    return pts + [(0, 1, 9001, 0.0, 0.0, 0.0), (0, 2, 9002, 0.0, 0.0, 0.0), (0, 3, 9003, 5.0, 0.0, 0.0), (0, 1, 9004, None, 0.0, 0.0), (0, 2, 9005, NAN, 0.0, 0.0), (0, None, 9006, 0.0, 0.0, 0.0), (None, 1, 9007, 0.0, 0.0, 0.0), (0, 5, 9008, float("inf"), 0.0, 0.0)]


def brute(pts, d):
    ok = [p for p in pts if None not in p and all(math.isfinite(v) for v in p[3:])]
    return {(min(a[2], b[2]), max(a[2], b[2])) for a in ok for b in ok if a[2] < b[2] and a[0] == b[0] and a[1] != b[1] and sum((p - q) ** 2 for p, q in zip(a[3:], b[3:])) <= d * d}


def test_near_pairs(spark):
    pts = cloud()
    df = spark.createDataFrame(pts + pts[:50], "event_id int, cell int, point_id int, x double, y double, z double").withColumnRenamed("cell", "o")
    for cell, split in ((None, 512), (5.0, 512), (100.0, 3), (None, 1), (5.0, 0)):
        got = near_pairs(df, 5.0, "point_id", "o", ("event_id",), cell=cell, split=split)
        assert {(r.point_a, r.point_b) for r in got.collect()} == brute(pts, 5.0)
    assert got.count() == len(brute(pts, 5.0))
    assert near_pairs(df.limit(0), 5.0, "point_id", "o", ("event_id",)).count() == 0
    flat = near_pairs(spark.createDataFrame([(1, 0.0), (2, 3.0), (3, 7.0)], "i int, x double"), 3.0, "i", xyz=("x",))
    assert [(r.point_a, r.point_b) for r in flat.collect()] == [(1, 2)]
    with pytest.raises(ValueError):
        near_pairs(df, 5.0, "point_id", cell=1.0)


def test_touching_and_standoff(spark, rows):
    df = spark.createDataFrame([(1, 10, 1, 0.0, 0.0, 0.0), (1, 20, 2, 3.0, 0.0, 0.0), (1, 30, 3, 9.0, 0.0, 0.0), (1, 20, 4, 4.0, 0.0, 0.0)], "event_id int, o int, p int, x double, y double, z double")
    assert rows(touching(df, 5.0, "p", "o", ("event_id",))) == [(1, 10, 20, 3.0), (1, 20, 30, 5.0)]
    c = spark.createDataFrame([(7, 1, 1, 0.0, 0.0, 0.0), (7, 1, 2, 4.0, 0.0, 0.0), (7, 2, 3, 0.0, 3.0, 0.0), (8, 1, 4, 0.0, 0.0, 0.0), (8, 2, 5, 50.0, 0.0, 0.0)], "k int, side int, p int, x double, y double, z double")
    assert rows(standoff(c, 8.0, ("k",), "side", "p")) == [(7, 2, 5.0), (8, 1, None)]


def test_first_match_within_tolerance(spark, rows):
    left = spark.createDataFrame([(1, 5, 100.0), (1, 6, 7.0)], "e int, id int, x double")
    right = spark.createDataFrame([(1, 1, 100.001), (1, 0, 100.0005), (1, 2, 3.0)], "e int, row int, x double")
    got = matched(left, right, ["e"], [("x", "x")], "row")
    assert {(r.id, r.r_row) for r in got.collect()} == {(5, 0), (6, None)}
    rng = random.Random(4)
    a = [(rng.randint(0, 1), i, rng.choice([0.0, 5e-5, -1e-4, rng.uniform(-3000, 3000), rng.uniform(-1, 1), None, NAN])) for i in range(200)]
    b = [(rng.randint(0, 1), j, v + rng.choice([0.0, 1e-4, -9e-5, 2e-4, 1e-5 * v, -1.1e-5 * v])) for j, v in enumerate(x[2] for x in a if x[2] is not None and x[2] == x[2])]
    want = {(e, i): min([j for f, j, w in b if f == e and v is not None and abs(v - w) <= 1e-4 + 1e-5 * abs(w)], default=None) for e, i, v in a}
    got = matched(spark.createDataFrame(a, "e int, id int, x double"), spark.createDataFrame(b, "e int, row int, x double"), ["e"], [("x", "x")], "row")
    assert {(r.e, r.id): r.r_row for r in got.collect()} == want

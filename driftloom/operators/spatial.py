"""Points in regions and points near points.

Regions: crossing parity in SQL. The edges of the regions' outlines are binned into strips of latitude (y); a point joins the edges
of its strip only, and a ray from it towards greater x crosses an odd number of the edges of a region that holds it. Crossings are grouped by point and
region. An edge is crossed if it starts at or below the point and ends above it (or the reverse) and lies strictly beyond it, which decides
boundaries: lower and left ones belong to a region, upper and right ones do not, and a point on a border that two regions share
belongs to exactly one of them.

Neighbours: a cell hash. Points shuffle by cell, and each is also sent to those cells before its own that reach within the
distance, so every near pair meets in exactly one cell. Cells are several distances wide, so few points are sent twice; a cell with many points is
split into cells of about one distance, so that the comparisons stay near the pairs that are found. Nothing is keyed by
event alone: one event may hold any share of the points.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import add, and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..store import Workspace

#: Points of one cell above which it is split.
SPLIT = 64


def box_outlines(boxes: DataFrame, region: str, x: tuple[str, str], y: tuple[str, str], z: tuple[str, str] | None = None) -> DataFrame:
    """Outlines, as ``points_in_regions`` takes them, of boxes that include their lower and exclude their upper faces."""
    c = [F.col(n).cast("double") for n in (*x, *y)]
    corner = lambda i, j: F.struct(c[i].alias("x"), c[2 + j].alias("y"))
    ring = F.array(corner(0, 0), corner(1, 0), corner(1, 1), corner(0, 1))
    zs = [F.col(n).cast("double") if z else F.lit(None).cast("double") for n in (z or (None, None))]
    return boxes.select(F.col(region).alias("region_id"), ring.alias("ring"), zs[0].alias("z_low"), zs[1].alias("z_high"))


def edge_strips(outlines: DataFrame, strip: float) -> DataFrame:
    """The edges of the outlines, each once for every strip that it reaches: ``strip``, ``region_id``, ``z_low``, ``z_high``, ``x1``, ``y1``, ``x2``, ``y2``. Level edges are never crossed and left out."""
    n = F.size("ring")
    edges = outlines.where(n >= 3).select(
        "region_id", "z_low", "z_high",
        F.explode(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct(F.col("ring")[i].alias("a"), F.col("ring")[(i + 1) % n].alias("b")))).alias("e"),
    ).select("region_id", "z_low", "z_high", F.col("e.a.x").alias("x1"), F.col("e.a.y").alias("y1"), F.col("e.b.x").alias("x2"), F.col("e.b.y").alias("y2")).where("y1 <> y2")
    return edges.select(F.explode(F.sequence(F.floor(F.least("y1", "y2") / strip), F.floor(F.greatest("y1", "y2") / strip))).alias("strip"), *edges.columns)


def _finite(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))


def points_in_regions(points: DataFrame, outlines: DataFrame, x: str = "x", y: str = "y", z: str | None = "z", strip: float | None = None, region: str = "region_id", key: Sequence[str] = ()) -> DataFrame:
    """Every point with every region that holds it, once; points in no region are left out.

    :param outlines: ``region_id``, ``ring`` (array of struct x, y: a simple polygon, closed by itself), ``z_low``, ``z_high`` (half open, null: no bound)
    :param strip: height of the strips of latitude; by default an eighth of the mean height of the regions
    :param key: columns that tell one point from another; by default all columns
    :return: the columns of ``points`` and ``region`` (which takes the place of a column of that name)

    Rows equal in key and coordinates are one point, whatever their other columns hold (any row's values stand); null keys are a key like others. Several rings
    of one region count together: a ring within another is a hole. Points with a null, NaN or infinite coordinate are in no region; rings of under three
    corners, or with a corner that is null or not finite, hold nothing. Column names of the points may be those
    used here: the regions' side is prefixed. The points are made distinct by one shuffle, which also serves the grouping of their crossings where the edges
    are under Spark's threshold for a broadcast; else points and edges are joined by strip, where AQE splits hot strips.
    """
    whole = outlines.where(F.forall("ring", lambda c: _finite(c["x"]) & _finite(c["y"])))
    if strip is None:
        tall = whole.select(F.avg(F.array_max(F.col("ring.y")) - F.array_min(F.col("ring.y"))).alias("h")).first()["h"]
        strip = (tall or 8.0) / 8
    edges = edge_strips(whole, strip)
    own = [c for c in points.columns if c != region]
    at = [x, y, *([z] if z else [])]
    same = list(dict.fromkeys([*(key or own), *at]))
    right = edges.select(*(F.col(c).alias(f"__{c}") for c in edges.columns))
    px, py = F.col("__px"), F.col("__py")
    one = points.select(*own).where(reduce(and_, [_finite(F.col(c).cast("double")) for c in at])).dropDuplicates(same)
    left = one.withColumns({"__px": F.col(x).cast("double"), "__py": F.col(y).cast("double"), **({"__pz": F.col(z).cast("double")} if z else {})}).withColumn("__at", F.floor(py / strip))
    x1, y1, x2, y2 = (F.col(f"__{k}") for k in ("x1", "y1", "x2", "y2"))
    # where the edge meets the point's latitude; an upright edge's x is not recomputed, so that a point on it is decided exactly
    meets = F.when(x1 == x2, x1).otherwise(x1 + (py - y1) * (x2 - x1) / (y2 - y1))
    on = [F.col("__at") == F.col("__strip"), (y1 <= py) != (y2 <= py), meets > px]
    if z:
        on += [(F.col("__z_low").isNull() | (F.col("__pz") >= F.col("__z_low"))), (F.col("__z_high").isNull() | (F.col("__pz") < F.col("__z_high")))]
    crossed = left.join(right, on, "inner").groupBy(*same, F.col("__region_id").alias(region)).agg(F.count(F.lit(1)).alias("__crossings"), *(F.first(c).alias(c) for c in own if c not in same))
    return crossed.where("__crossings % 2 = 1").select(*own, region)


def _near(points: DataFrame, distance: float, point: str, owner: str | None, scope: Sequence[str], xyz: Sequence[str], cell: float | None, split: int = SPLIT) -> DataFrame:
    """The pairs of ``near_pairs`` as s0.., id_a, o_a, id_b, o_b, d2; in either order, and repeated where rows repeat."""
    width = cell or 6 * distance
    if width < distance:
        raise ValueError("cells must be at least as wide as the distance")
    parts = max(1, int(width / distance + 1e-9))  # of a split cell, along each axis
    fine, reach, n = width / parts, distance * (1 + 1e-9), len(xyz)
    sk, axes, kept = [f"s{i}" for i in range(len(scope))], [f"q{i}" for i in range(n)], ["o"] if owner else []
    flat = points.select(*(F.col(k).alias(x) for k, x in zip(scope, sk)), F.col(point).alias("id"), *([F.col(owner).alias("o")] if owner else []), *(F.col(k).cast("float" if points.schema[k].dataType.simpleString() == "float" else "double").alias(a) for k, a in zip(xyz, axes)))
    flat = flat.where(" and ".join([*(f"{k} is not null" for k in flat.columns), *(f"abs({a}) < double('infinity')" for a in axes)]))
    ws = Workspace(points.sparkSession, "near")
    q = {a: F.col(a).cast("double") for a in axes}
    own = [F.floor(q[a] / fine) for a in axes]
    over = lambda c: F.floor(c / parts)
    # written, as it is read for the counts and for the join; near rows side by side make the shuffle small
    flat = ws.keep(flat.sortWithinPartitions(*sk, *(over(k) for k in own)))
    crowd, crowded = ws.count(flat.groupBy(*sk, *(over(k).alias(f"h{i}") for i, k in enumerate(own))).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > split).select(F.xxhash64(*sk, *(f"h{i}" for i in range(n))).alias("crowd")), sized=True)
    rows = flat
    for i, a in enumerate(axes):
        rows = rows.withColumns({f"f{i}": own[i], f"l{i}": F.floor((q[a] - reach) / fine), f"u{i}": F.floor((q[a] + reach) / fine)})
        rows = rows.withColumn(f"k{i}", F.explode(F.sequence(over(F.col(f"l{i}")), over(F.col(f"u{i}")))))
    # of the neighbouring cells only those before the own one, in the order of the axes
    code = reduce(add, [(F.col(f"k{i}") - over(F.col(f"f{i}"))) * 3 ** (n - 1 - i) for i in range(n)])
    rows = rows.where(code <= 0).withColumns({"cell": F.xxhash64(*sk, *(f"k{i}" for i in range(n))), "away": (code < 0)})
    if crowded["rows"]:
        hot = ws.spark.read.schema("crowd bigint").parquet(crowd)
        rows = rows.join(hot, F.col("cell") == F.col("crowd"), "left")
        split_ = F.col("crowd").isNotNull()
        for i in range(n):
            first = F.col(f"k{i}") * parts
            rows = rows.withColumn(f"g{i}", F.explode(F.when(split_, F.sequence(F.greatest(f"l{i}", first), F.least(F.col(f"u{i}"), first + parts - 1))).otherwise(F.array(F.col(f"f{i}")))))
        within = reduce(add, [(F.col(f"g{i}") - F.col(f"f{i}")) * 3 ** (n - 1 - i) for i in range(n)])
        rows = rows.where(F.col("away") | (within <= 0)).withColumns({"away": F.col("away") | (within < 0), "cell": F.when(split_, F.xxhash64("cell", *(f"g{i}" for i in range(n)))).otherwise(F.col("cell"))})
    rows = rows.select("cell", *sk, "id", *kept, *axes, F.col("away").cast("tinyint").alias("away"))
    a, b = rows.alias("a"), rows.alias("b")
    # both sides read the same shuffle; no condition is on one side only, lest it be pushed below it
    d2 = reduce(add, [(F.col(f"a.{k}").cast("double") - F.col(f"b.{k}").cast("double")) * (F.col(f"a.{k}").cast("double") - F.col(f"b.{k}").cast("double")) for k in axes])
    rank = lambda t: F.col(f"{t}.away").cast("int") * 2
    meets = [F.col("a.cell") == F.col("b.cell"), rank("a") - rank("b") < 1, rank("a") + rank("b") < 4, (rank("a") < rank("b")) | (F.col("a.id") < F.col("b.id"))]
    meets += [F.col(f"a.{x}") == F.col(f"b.{x}") for x in sk]
    found = a.join(b, reduce(and_, meets), "inner")
    if owner:
        found = found.where(F.col("a.o") != F.col("b.o"))
    found = found.where(F.col("a.id") != F.col("b.id")).where(d2 <= distance * distance)
    return found.select(*(F.col(f"a.{x}").alias(x) for x in sk), *(F.col(f"{t}.{k}").alias(f"{k}_{t}") for t in "ab" for k in ("id", *kept)), d2.alias("d2"))


def near_pairs(points: DataFrame, distance: float, point: str, owner: str | None = None, scope: Sequence[str] = (), xyz: Sequence[str] = ("x", "y", "z"), cell: float | None = None, split: int = SPLIT) -> DataFrame:
    """All pairs of points of one scope, of different owners, at most ``distance`` apart (inclusive, in double precision).

    :param owner: points of one owner are no pair; None: any two points are
    :param cell: width of the cells; by default six distances
    :param split: cells with more points than that are split
    :return: distinct (``point_a``, ``point_b``, ``d2``), point_a < point_b, ``d2`` the squared distance

    Points with a null or NaN coordinate, point id, scope or (if used) owner are near nothing; infinite ones neither. Repeated rows of a point
    count once. Equal positions are at distance 0. Works in one to three dimensions, by the names in ``xyz``. The columns of the points
    may have any names. One shuffle of the points by cell, joined with itself; then one of the pairs found, to make them distinct.
    The points are written once before, as they are read for the counts of cells as well.
    """
    found = _near(points, distance, point, owner, scope, xyz, cell, split)
    return found.select(F.least("id_a", "id_b").alias("point_a"), F.greatest("id_a", "id_b").alias("point_b"), "d2").distinct()


def touching(points: DataFrame, distance: float, point: str, owner: str, scope: Sequence[str] = (), xyz: Sequence[str] = ("x", "y", "z"), cell: float | None = None) -> DataFrame:
    """Which owners of one scope have points at most ``distance`` apart: scope, ``owner_a`` < ``owner_b``, ``distance`` of their nearest points.

    Rows are treated as by ``near_pairs``. Owners without points touch nothing. Pairs of points are folded to pairs of owners before the shuffle.
    """
    found = _near(points, distance, point, owner, scope, xyz, cell)
    return found.groupBy(*(F.col(f"s{i}").alias(k) for i, k in enumerate(scope)), F.least("o_a", "o_b").alias("owner_a"), F.greatest("o_a", "o_b").alias("owner_b")).agg(F.sqrt(F.min("d2")).alias("distance"))


def standoff(cells: DataFrame, radius: float, pair: Sequence[str], side: str, point: str, xyz: Sequence[str] = ("x", "y", "z")) -> DataFrame:
    """How far the cloud of side 1 of each pair sticks out of that of side 2: the greatest distance of a cell of side 1 from its nearest of side 2.

    Searched within ``radius``: ``standoff`` is null where some cell of side 1 has no neighbour that near. The ``point`` ids are unique within the pair, over both sides.
    """
    found = _near(cells, radius, point, side, pair, xyz, None)
    keys = [F.col(f"s{i}").alias(k) for i, k in enumerate(pair)]
    near = found.groupBy(*keys, F.when(F.col("o_a") == 1, F.col("id_a")).otherwise(F.col("id_b")).alias("__id")).agg(F.min("d2").alias("d2"))
    reach = near.groupBy(*pair).agg(F.max("d2").alias("d2"), F.count(F.lit(1)).alias("near"))
    all_ = cells.where(F.col(side) == 1).groupBy(*(F.col(k).alias(f"__{k}") for k in pair)).agg(F.count_distinct(point).alias("cells"))
    met = all_.join(reach, [F.col(f"__{k}") == F.col(k) for k in pair], "left")
    return met.select(*(F.col(f"__{k}").alias(k) for k in pair), "cells", F.when(F.col("near") == F.col("cells"), F.sqrt("d2")).alias("standoff"))


def matched(left: DataFrame, right: DataFrame, on: Sequence[str], close: Sequence[tuple[str, str]], first: str, absolute: float = 1e-4, relative: float = 1e-5) -> DataFrame:
    """``left`` with the first row of ``right`` (least ``first``) whose values all lie within absolute + relative * |its value|, in the same ``on``; nulls where none does.

    The right side's columns come prefixed with r_. Rows of ``left`` that repeat become one. Null and NaN values match nothing. The values are binned on a scale on which the
    tolerance is about as wide everywhere, so rows meet by hash and only those near each other are compared.
    """
    r = right.select(*(F.col(c).alias(f"r_{c}") for c in right.columns))
    scale = lambda v: F.signum(v) * F.log1p(F.abs(v) * relative / absolute) / relative if relative else v / absolute
    bin_ = lambda v: F.floor(scale(v) / 64)
    l = left
    for i, (a, b) in enumerate(close):
        value = F.col(f"r_{b}").cast("double")
        wide = (absolute + relative * F.abs(value)) * (1 + 1e-9)
        r = r.where(_finite(value)).withColumn(f"__b{i}", F.explode(F.sequence(bin_(value - wide), bin_(value + wide))))
        l = l.withColumn(f"__a{i}", F.when(_finite(F.col(a).cast("double")), bin_(F.col(a).cast("double"))))
    near = [F.abs(F.col(a).cast("double") - F.col(f"r_{b}").cast("double")) <= absolute + relative * F.abs(F.col(f"r_{b}").cast("double")) for a, b in close]
    met = l.join(r, [*(F.col(k) == F.col(f"r_{k}") for k in on), *(F.col(f"__a{i}") == F.col(f"__b{i}") for i in range(len(close))), *near], "left")
    of = [f"r_{c}" for c in right.columns]
    least = F.min(F.when(F.col(f"r_{first}").isNotNull(), F.struct(f"r_{first}", *(c for c in of if c != f"r_{first}"))))
    return met.groupBy(*left.columns).agg(least.alias("m")).select(*left.columns, *(F.col(f"m.{c}").alias(c) for c in of))

"""Queries of the general data problems p1 to p6 over the given tables. SQL for DuckDB beside each where SQL is quick enough."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.components import connected_components
from ..operators.drift import consistent_table, consistent_values, file_fields, lasting_names, schema_changes, with_versions
from ..operators.hierarchy import descendants, resolve_hierarchy
from ..operators.references import orphan_references
from ..operators.skew import skewed_totals
from ..operators.spatial import box_outlines, near_pairs, points_in_regions
from ..store import Workspace
from ..tables import no_parent, standing, table

DISTANCE = 5.2


# ---- p1: points near points, points in volumes


def _in_volumes(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    volumes = box_outlines(table(spark, d, "volumes"), "volume_id", ("x_min", "x_max"), ("y_min", "y_max"), ("z_min", "z_max"))
    points = table(spark, d, "points").select(*columns, "x", "y", "z")
    return points_in_regions(points, volumes, region="volume_id", key=["point_id"])


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    held = _in_volumes(spark, d, "event_id", "particle_id", "point_id")
    pairs = near_pairs(held, DISTANCE, "point_id", owner="particle_id", scope=("event_id", "volume_id"))
    return pairs.select("point_a", "point_b")


def p1_volumes(spark: SparkSession, d: str) -> DataFrame:
    """Which volume holds each point; one row per point in a volume."""
    return _in_volumes(spark, d, "point_id").select("point_id", "volume_id")


#: An arrow head, as shares of a volume's width and height.
ARROW = ((0.0, 0.125), (0.5, 0.375), (1.0, 0.0), (0.875, 0.5), (1.0, 1.0), (0.5, 0.75), (0.125, 0.875), (0.25, 0.5))


def p1_polygons(spark: SparkSession, d: str) -> DataFrame:
    """Which volume's arrow head, a polygon of eight slanted edges, holds each point in x and y; z is that of the volume."""
    corner = lambda u, v: F.struct((F.col("x_min") + (F.col("x_max") - F.col("x_min")) * u).alias("x"), (F.col("y_min") + (F.col("y_max") - F.col("y_min")) * v).alias("y"))
    arrows = table(spark, d, "volumes").select(F.col("volume_id").alias("region_id"), F.array(*(corner(u, v) for u, v in ARROW)).alias("ring"), F.col("z_min").alias("z_low"), F.col("z_max").alias("z_high"))
    points = table(spark, d, "points").select("point_id", "x", "y", "z")
    return points_in_regions(points, arrows, region="volume_id", key=["point_id"]).select("point_id", "volume_id")


# ---- p2: schemas that drift


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return schema_changes(file_fields(table(spark, d, "file_records"))).select("file_id", "field_name", "change_kind")


def p2_table(spark: SparkSession, d: str) -> DataFrame:
    """One table of all records, standing rows only, of consistent columns."""
    return consistent_table(_records(spark, d), ["record_id", "file_id"])


def _records(spark: SparkSession, d: str) -> DataFrame:
    return standing(table(spark, d, "file_records"), ["record_id"], ["file_id", "producer", "written_at", "payload"], "received_at")


def p2_cells(spark: SparkSession, d: str) -> DataFrame:
    """Every record of the consistent table: whether it could be read, and how many of its cells are filled; as many as its payload has values, if none was lost on the way."""
    t = p2_table(spark, d)
    names = [c for c in t.columns if c not in ("record_id", "file_id", "readable")]
    filled = F.aggregate(F.array(*(F.col(f"`{c}`").isNotNull().cast("int") for c in names)), F.lit(0), lambda a, b: a + b) if names else F.lit(0)
    return t.select("record_id", "readable", filled.alias("cells"))


def p2_values(spark: SparkSession, d: str) -> DataFrame:
    """Every value of every standing record, with the name it had in its file and its lasting one."""
    records = Workspace(spark, "records").keep(_records(spark, d))
    fields = Workspace(spark, "records").keep(file_fields(records))
    return consistent_values(records, ["record_id"], lasting_names(fields, schema_changes(fields))).select("record_id", "field_name", "name", "value")


def p2_versions(spark: SparkSession, d: str) -> DataFrame:
    """The versions of each producer's schema, and the files that have them."""
    files = with_versions(file_fields(table(spark, d, "file_records")))
    return files.groupBy("producer", "version").agg(F.count_distinct("file_id").alias("files"), F.count_distinct("field_name").alias("fields"), F.min("file_no").alias("first_file"))


# ---- p3: hierarchies


def _tracks(spark: SparkSession, d: str) -> DataFrame:
    s = standing(table(spark, d, "geant4"), ["event_id", "track_id"], ["parent_track_id", "root_track_id", "dropped"])
    return s.where(~F.coalesce("dropped", F.lit(False))).select(F.lit("geant4").alias("hierarchy"), "event_id", F.col("track_id").alias("node_id"), no_parent(F.col("parent_track_id"), F.col("track_id")).alias("parent_id"), F.col("root_track_id").alias("stored"))


def _particles(spark: SparkSession, d: str) -> DataFrame:
    s = standing(table(spark, d, "particles"), ["event_id", "id"], ["parent_id", "ancestor_id"])
    return s.select(F.lit("particles").alias("hierarchy"), "event_id", F.col("id").alias("node_id"), no_parent(F.col("parent_id"), F.col("id")).alias("parent_id"), F.col("ancestor_id").alias("stored"))


def _resolved(spark: SparkSession, d: str, path: bool) -> DataFrame:
    return resolve_hierarchy(_tracks(spark, d).unionByName(_particles(spark, d)), "node_id", "parent_id", ("hierarchy", "event_id"), path=path, carry=["stored"], unique=True)


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    true = F.when(F.col("in_loop"), -1).otherwise(F.col("root_id")).cast("bigint")
    cases = _resolved(spark, d, path=False).withColumn("true_root_id", true).where("stored is null or stored <> true_root_id")
    return cases.select("hierarchy", "event_id", F.col("node_id").cast("bigint").alias("node_id"), "true_root_id")


def p3_paths(spark: SparkSession, d: str) -> DataFrame:
    r = _resolved(spark, d, path=True)
    return r.select("hierarchy", "event_id", F.col("node_id").cast("bigint").alias("node_id"), F.col("root_id").cast("bigint").alias("root_id"), "depth", F.array_join(F.col("path").cast("array<string>"), "/").alias("path"), "in_loop")


def p3_descendants(spark: SparkSession, d: str) -> DataFrame:
    pairs = descendants(_resolved(spark, d, path=True), ("hierarchy", "event_id"))
    return pairs.groupBy("hierarchy", "event_id", F.col("ancestor_id").cast("bigint").alias("ancestor_id")).agg(F.count(F.lit(1)).alias("descendants"), F.max("steps").alias("height"))


def p3_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Every node with every descendant of it, and the steps between them."""
    pairs = descendants(_resolved(spark, d, path=True), ("hierarchy", "event_id"))
    return pairs.select("hierarchy", "event_id", F.col("ancestor_id").cast("bigint").alias("ancestor_id"), F.col("descendant_id").cast("bigint").alias("descendant_id"), "steps")


# ---- p4: references to records that do not exist


def _orphans(spark: SparkSession, d: str) -> DataFrame:
    ws = Workspace(spark, "standing")  # each is both a side that refers and one that is referred to
    g = ws.keep(standing(table(spark, d, "geant4"), ["event_id", "track_id"], ["parent_track_id", "dropped", "recorded_at"]))
    p = ws.keep(standing(table(spark, d, "particles"), ["event_id", "id"], ["parent_id", "recorded_at"]))
    i = standing(table(spark, d, "inst_groups"), ["event_id", "group_id"], ["group_to_track", "recorded_at"])
    gone = F.coalesce("dropped", F.lit(False))
    month = F.trunc("recorded_at", "month").alias("month")
    ref = lambda name, target, child, to: [F.lit(name).alias("ref_table"), "event_id", F.col(child).cast("int").alias("child_id"), F.lit(target).alias("target_table"), to.cast("int").alias("target_id"), month]
    refs = (
        g.where(~gone).select(*ref("geant4", "geant4", "track_id", no_parent(F.col("parent_track_id"), F.col("track_id"))))
        .unionByName(p.select(*ref("particles", "particles", "id", no_parent(F.col("parent_id"), F.col("id")))))
        .unionByName(i.select(*ref("inst_groups", "geant4", "group_id", F.when(F.col("group_to_track") >= 0, F.col("group_to_track")))))
    )
    records = g.select(F.lit("geant4").alias("target_table"), "event_id", F.col("track_id").alias("target_id"), (~gone).alias("present")).unionByName(p.select(F.lit("particles").alias("target_table"), "event_id", F.col("id").alias("target_id"), F.lit(True).alias("present")))
    return orphan_references(refs, records, ("event_id",), carry=["month"], unique=True)


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    direct = _orphans(spark, d).where("level = 0")
    return direct.select("ref_table", "event_id", F.col("child_id").cast("bigint").alias("child_id"), F.col("missing_id").cast("bigint").alias("missing_id"))


def p4_orphans(spark: SparkSession, d: str) -> DataFrame:
    """Every orphaned reference with its level: 0 where its own target is missing, above where that of a record on the way up is."""
    return _orphans(spark, d).select("ref_table", "event_id", "child_id", "target_id", "missing_id", "level", "withdrawn")


def p4_periods(spark: SparkSession, d: str) -> DataFrame:
    """Orphans per table and month of recorded_at: direct ones, of them with a withdrawn target, and inherited ones."""
    o = _orphans(spark, d)
    return o.groupBy("ref_table", F.date_format("month", "yyyy-MM").alias("month")).agg(F.count_if(F.col("level") == 0).alias("direct"), F.count_if("withdrawn").alias("withdrawn"), F.count_if(F.col("level") > 0).alias("inherited"))


# ---- p5: a few keys hold most rows


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    width = F.when(F.size("pc_offsets") == 2, F.greatest(F.element_at("pc_offsets", 2) - F.element_at("pc_offsets", 1), F.lit(0)))
    rows = table(spark, d, "particles").select("event_id", "id", "sem_type", F.coalesce(width, F.lit(0)).alias("n"))
    # a particle with most of its event's points leads the state of its sem_type
    kinds = skewed_totals(rows, ["event_id", "sem_type"], ["id"], {"n": ("sum", F.col("n")), "top": ("max", F.struct("n", "id"))}, unique=True)
    events = kinds.groupBy("event_id").agg(F.sum("n").alias("all"), F.max("top").alias("top"), F.max(F.when(F.col("sem_type").isNotNull(), F.struct("n", "sem_type"))).alias("kind"))
    cases = F.filter(
        F.array(
            F.struct(F.lit("particle").alias("key_kind"), F.col("top.id").cast("bigint").alias("key_id"), (F.col("top.n") * 100 > F.col("all") * 70).alias("most")),
            F.struct(F.lit("sem_type").alias("key_kind"), F.col("kind.sem_type").cast("bigint").alias("key_id"), (F.col("kind.n") * 100 > F.col("all") * 90).alias("most")),
        ),
        lambda c: c["most"],
    )
    return events.select("event_id", F.explode(cases).alias("c")).select("event_id", "c.key_kind", "c.key_id")


def _particle_totals(spark: SparkSession, d: str) -> DataFrame:
    points = table(spark, d, "points").select("event_id", "particle_id", "point_id", "de")
    return skewed_totals(points, ["event_id", "particle_id"], ["point_id"], {"points": ("count", F.lit(1)), "energy": ("sum", F.when(~F.isnan("de"), F.col("de").cast("double")))}, unique=True)


def p5_particles(spark: SparkSession, d: str) -> DataFrame:
    """Points and energy of every particle."""
    return _particle_totals(spark, d).select("event_id", F.col("particle_id").cast("bigint").alias("particle_id"), "points", F.round("energy", 3).alias("energy"))


def p5_sem_types(spark: SparkSession, d: str) -> DataFrame:
    """Points and energy of every event and sem_type; points are folded by particle before they meet the particles."""
    kind = standing(table(spark, d, "particles"), ["event_id", "id"], ["sem_type"]).select(F.col("event_id").alias("e"), "id", "sem_type")
    t = _particle_totals(spark, d)
    return t.join(kind, (F.col("event_id") == F.col("e")) & (F.col("particle_id") == F.col("id")), "left").groupBy("event_id", F.col("sem_type").cast("int").alias("sem_type")).agg(F.sum("points").alias("points"), F.round(F.sum("energy"), 3).alias("energy"))


# ---- p6: groups from pairwise matches


def _merged_pairs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "merge_decisions").where(F.col("reason").rlike(r"(?i)^\s*(mergeoutcome\.)?\s*merged\s*$")).select("event_id", "id1", "id2")


def _groups(spark: SparkSession, d: str) -> DataFrame:
    return connected_components(_merged_pairs(spark, d), "id1", "id2", ("event_id",), node="particle_id", component="group_id")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return _groups(spark, d).select("event_id", F.col("particle_id").cast("bigint").alias("particle_id"), F.col("group_id").cast("bigint").alias("group_id"))


def p6_markers(spark: SparkSession, d: str) -> DataFrame:
    """Groups against the stored self-markers: members, and how many of them are marked heads of a fragment or an instance."""
    heads = standing(table(spark, d, "particles"), ["event_id", "id"], ["frag_id", "inst_id"]).select(F.col("event_id").alias("e"), "id", (F.col("frag_id") == F.col("id")).alias("frag"), (F.col("inst_id") == F.col("id")).alias("inst"))
    g = _groups(spark, d)
    return g.join(heads, (F.col("event_id") == F.col("e")) & (F.col("particle_id") == F.col("id")), "left").groupBy("event_id", F.col("group_id").cast("bigint").alias("group_id")).agg(F.count(F.lit(1)).alias("members"), F.count_if("frag").alias("fragment_heads"), F.count_if("inst").alias("instance_heads"), F.count_if(F.col("id").isNull()).alias("without_row"))


QUERIES = {f.__name__: f for f in (p1_found, p1_volumes, p1_polygons, p2_found, p2_table, p2_cells, p2_values, p2_versions, p3_found, p3_paths, p3_descendants, p3_pairs, p4_found, p4_orphans, p4_periods, p5_found, p5_particles, p5_sem_types, p6_found, p6_markers)}

_TRACKS = """g AS (SELECT 'geant4' AS hierarchy, event_id, track_id AS node_id, CASE WHEN parent_track_id >= 0 AND parent_track_id <> track_id THEN parent_track_id END AS parent_id, root_track_id AS stored, gone, seen_at
 FROM (SELECT event_id, track_id, arg_max(parent_track_id, recorded_at) AS parent_track_id, arg_max(root_track_id, recorded_at) AS root_track_id, arg_max(dropped, recorded_at) AS gone, max(recorded_at) AS seen_at FROM geant4 GROUP BY event_id, track_id)),
p AS (SELECT 'particles' AS hierarchy, event_id, id AS node_id, CASE WHEN parent_id >= 0 AND parent_id <> id THEN parent_id END AS parent_id, ancestor_id AS stored, false AS gone, seen_at
 FROM (SELECT event_id, id, arg_max(parent_id, recorded_at) AS parent_id, arg_max(ancestor_id, recorded_at) AS ancestor_id, max(recorded_at) AS seen_at FROM particles GROUP BY event_id, id))"""

_WALK = f"""WITH RECURSIVE {_TRACKS}, n AS (SELECT hierarchy, event_id, node_id, parent_id, stored FROM g WHERE NOT gone UNION ALL SELECT hierarchy, event_id, node_id, parent_id, stored FROM p),
l AS (SELECT n.*, q.node_id AS up FROM n LEFT JOIN n q ON q.hierarchy = n.hierarchy AND q.event_id = n.event_id AND q.node_id = n.parent_id),
w AS (SELECT hierarchy, event_id, node_id, node_id AS root_id, 0 AS depth, CAST(node_id AS VARCHAR) AS path FROM l WHERE up IS NULL
 UNION ALL SELECT l.hierarchy, l.event_id, l.node_id, w.root_id, w.depth + 1, w.path || '/' || l.node_id FROM l JOIN w ON w.hierarchy = l.hierarchy AND w.event_id = l.event_id AND w.node_id = l.up)"""

_POINTS = "pts AS (SELECT DISTINCT event_id, particle_id, point_id, CAST(x AS DOUBLE) AS x, CAST(y AS DOUBLE) AS y, CAST(z AS DOUBLE) AS z, volume_id FROM points JOIN volumes ON x >= x_min AND x < x_max AND y >= y_min AND y < y_max AND z >= z_min AND z < z_max WHERE NOT isnan(x) AND NOT isnan(y) AND NOT isnan(z))"

_FIELDS = r"""ok AS (SELECT file_id, producer, written_at, payload FROM file_records WHERE json_valid(payload) AND json_type(payload) = 'OBJECT'),
t AS (SELECT DISTINCT file_id, j.key, j.type, j.id, j.parent, j.path, j.fullkey, payload FROM ok, json_tree(payload) j),
leaf AS (SELECT DISTINCT file_id, substr(fullkey, 3) AS f, CASE WHEN type = 'BOOLEAN' THEN 'boolean' WHEN type IN ('BIGINT', 'UBIGINT') THEN 'long' WHEN type = 'DOUBLE' THEN 'double' ELSE 'string' END AS k, fullkey LIKE '%[%' AS arr FROM t WHERE type NOT IN ('OBJECT', 'ARRAY', 'NULL')),
one AS (SELECT file_id, regexp_replace(f, '\[.*$', '') AS field_name, arr, list_sort(list_distinct(list(k))) AS ks FROM leaf GROUP BY ALL),
kind AS (SELECT file_id, field_name, arr, CASE WHEN len(ks) = 1 THEN ks[1] WHEN ks = ['double', 'long'] THEN 'double' ELSE 'string' END AS k FROM one),
fields AS (SELECT file_id, field_name, CASE WHEN count(*) > 1 THEN 'string' ELSE any_value(CASE WHEN arr THEN 'array<' || k || '>' ELSE k END) END AS field_type FROM kind GROUP BY ALL),
files AS (SELECT file_id, producer, lead(file_id) OVER w AS next_id, row_number() OVER w AS no FROM (SELECT DISTINCT file_id, producer, written_at FROM ok WHERE file_id IN (SELECT file_id FROM fields)) WINDOW w AS (PARTITION BY producer ORDER BY written_at, file_id))"""

_REFERENCES = f"""{_TRACKS}, i AS (SELECT event_id, group_id, arg_max(group_to_track, recorded_at) AS t, max(recorded_at) AS seen_at FROM inst_groups GROUP BY event_id, group_id),
 refs AS (SELECT hierarchy AS ref_table, hierarchy AS target, event_id, node_id AS child, parent_id AS par, seen_at FROM g WHERE NOT gone AND parent_id IS NOT NULL UNION ALL SELECT hierarchy, hierarchy, event_id, node_id, parent_id, seen_at FROM p WHERE parent_id IS NOT NULL UNION ALL SELECT 'inst_groups', 'geant4', event_id, group_id, t, seen_at FROM i WHERE t >= 0),
 recs AS (SELECT hierarchy AS target, event_id, node_id, gone FROM g UNION ALL SELECT hierarchy, event_id, node_id, gone FROM p),
 d AS (SELECT refs.*, recs.gone IS NOT NULL AS withdrawn FROM refs LEFT JOIN recs ON recs.target = refs.target AND recs.event_id = refs.event_id AND recs.node_id = refs.par WHERE recs.gone IS NULL OR recs.gone)"""

SQL = {
    "p1_found": f"""WITH {_POINTS}, c AS (SELECT *, CAST(floor(x / 5.2) AS BIGINT) AS i, CAST(floor(y / 5.2) AS BIGINT) AS j, CAST(floor(z / 5.2) AS BIGINT) AS k FROM pts),
 o AS (SELECT a.range - 1 AS di, b.range - 1 AS dj, d.range - 1 AS dk FROM range(3) a, range(3) b, range(3) d), f AS (SELECT event_id, particle_id, point_id, x, y, z, volume_id, i + di AS i, j + dj AS j, k + dk AS k FROM c, o)
 SELECT f.point_id AS point_a, c.point_id AS point_b FROM f JOIN c USING (event_id, volume_id, i, j, k) WHERE f.point_id < c.point_id AND f.particle_id <> c.particle_id AND (f.x - c.x) ** 2 + (f.y - c.y) ** 2 + (f.z - c.z) ** 2 <= 5.2 * 5.2""",
    "p1_volumes": f"WITH {_POINTS} SELECT point_id, volume_id FROM pts",
    "p1_polygons": f"""WITH pts AS (SELECT DISTINCT point_id, CAST(x AS DOUBLE) AS x, CAST(y AS DOUBLE) AS y, CAST(z AS DOUBLE) AS z FROM points WHERE NOT isnan(x) AND NOT isnan(y) AND NOT isnan(z)), c(i, u, v) AS (VALUES {', '.join(f'({i}, CAST({u} AS DOUBLE), CAST({v} AS DOUBLE))' for i, (u, v) in enumerate(ARROW))}),
 k AS (SELECT volume_id, i, x_min + (x_max - x_min) * u AS x, y_min + (y_max - y_min) * v AS y, z_min, z_max FROM volumes, c), e AS (SELECT a.volume_id, a.z_min, a.z_max, a.x AS x1, a.y AS y1, b.x AS x2, b.y AS y2 FROM k a JOIN k b ON b.volume_id = a.volume_id AND b.i = (a.i + 1) % {len(ARROW)})
 SELECT point_id, volume_id FROM pts JOIN e ON z >= z_min AND z < z_max AND (y1 <= y) <> (y2 <= y) AND CASE WHEN x1 = x2 THEN x1 ELSE x1 + (y - y1) * (x2 - x1) / (y2 - y1) END > x GROUP BY point_id, volume_id HAVING count(*) % 2 = 1""",
    "p2_found": f"""WITH {_FIELDS},
new AS (SELECT file_id, field_name, field_type FROM fields JOIN files USING (file_id) WHERE no > 1), old AS (SELECT next_id AS file_id, field_name, field_type FROM fields JOIN files USING (file_id) WHERE next_id IS NOT NULL),
d AS (SELECT coalesce(new.file_id, old.file_id) AS file_id, coalesce(new.field_name, old.field_name) AS field_name, old.field_type AS o, new.field_type AS n FROM new FULL JOIN old ON old.file_id = new.file_id AND old.field_name = new.field_name WHERE old.field_type IS DISTINCT FROM new.field_type),
m AS (SELECT *, CASE WHEN o IS NULL OR n IS NULL THEN coalesce(o, n) END AS mt FROM d), c AS (SELECT *, count(*) FILTER (n IS NULL) OVER w AS g, count(*) FILTER (o IS NULL) OVER w AS a FROM m WINDOW w AS (PARTITION BY file_id, mt))
SELECT file_id, field_name, CASE WHEN mt IS NULL THEN 'retyped' WHEN g = 1 AND a = 1 THEN 'renamed' WHEN n IS NULL THEN 'removed' ELSE 'added' END AS change_kind FROM c WHERE NOT (mt IS NOT NULL AND g = 1 AND a = 1 AND n IS NULL)""",
    "p2_cells": """WITH st AS (SELECT record_id, arg_max(payload, received_at) AS payload FROM file_records GROUP BY record_id), ok AS (SELECT record_id, CASE WHEN json_valid(payload) AND payload LIKE '{%' THEN payload END AS payload FROM (SELECT record_id, trim(payload, E' \\t\\n\\r') AS payload FROM st)),
 leaf AS (SELECT record_id, count(*) AS n FROM (SELECT record_id, coalesce(payload, '{}') AS payload FROM ok) o, json_tree(o.payload) j WHERE j.type NOT IN ('OBJECT', 'NULL') AND j.fullkey NOT LIKE '%[%' AND NOT (j.type = 'ARRAY' AND json_array_length(j.value) = 0) GROUP BY record_id) SELECT ok.record_id, payload IS NOT NULL AS readable, CAST(coalesce(n, 0) AS INT) AS cells FROM ok LEFT JOIN leaf ON leaf.record_id = ok.record_id""",
    "p2_versions": f"""WITH {_FIELDS}, every AS (SELECT DISTINCT file_id, producer, written_at FROM file_records), pr AS (SELECT e.file_id, producer, written_at, coalesce(string_agg(field_name || ':' || field_type, chr(10) ORDER BY field_name || ':' || field_type), '') AS print, count(field_name) AS n FROM every e LEFT JOIN fields f ON f.file_id = e.file_id GROUP BY ALL),
 nr AS (SELECT *, row_number() OVER (PARTITION BY producer ORDER BY written_at, file_id) AS no FROM pr), v AS (SELECT producer, print, any_value(n) AS n, min(no) AS first_no, count(*) AS files FROM nr GROUP BY producer, print)
 SELECT producer, CAST(row_number() OVER (PARTITION BY producer ORDER BY first_no) AS INT) AS version, files, n AS fields, CAST(first_no AS INT) AS first_file FROM v""",
    "p3_pairs": f"""{_WALK}, e AS (SELECT hierarchy, event_id, node_id, depth, unnest(string_split(path, '/')) AS a, unnest(range(depth + 1)) AS step FROM w)
 SELECT hierarchy, event_id, CAST(a AS BIGINT) AS ancestor_id, CAST(node_id AS BIGINT) AS descendant_id, CAST(depth - step AS INT) AS steps FROM e WHERE depth > step""",
    "p3_found": f"""{_WALK} SELECT l.hierarchy, l.event_id, CAST(l.node_id AS BIGINT) AS node_id, CAST(coalesce(w.root_id, -1) AS BIGINT) AS true_root_id FROM l LEFT JOIN w USING (hierarchy, event_id, node_id) WHERE l.stored IS NULL OR l.stored <> coalesce(w.root_id, -1)""",
    "p3_paths": f"""{_WALK} SELECT l.hierarchy, l.event_id, CAST(l.node_id AS BIGINT) AS node_id, CAST(w.root_id AS BIGINT) AS root_id, w.depth, w.path, w.root_id IS NULL AS in_loop FROM l LEFT JOIN w USING (hierarchy, event_id, node_id)""",
    "p3_descendants": f"""{_WALK}, e AS (SELECT hierarchy, event_id, node_id, depth, unnest(string_split(path, '/')) AS a, unnest(range(depth + 1)) AS step FROM w)
 SELECT hierarchy, event_id, CAST(a AS BIGINT) AS ancestor_id, count(*) AS descendants, CAST(max(depth - step) AS INT) AS height FROM e WHERE CAST(a AS BIGINT) <> node_id GROUP BY ALL""",
    "p4_found": f"""WITH {_TRACKS}, i AS (SELECT event_id, group_id, arg_max(group_to_track, recorded_at) AS t FROM inst_groups GROUP BY event_id, group_id)
 SELECT hierarchy AS ref_table, event_id, CAST(node_id AS BIGINT) AS child_id, CAST(parent_id AS BIGINT) AS missing_id FROM g WHERE NOT gone AND parent_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM g q WHERE NOT q.gone AND q.event_id = g.event_id AND q.node_id = g.parent_id)
 UNION ALL SELECT hierarchy, event_id, CAST(node_id AS BIGINT), CAST(parent_id AS BIGINT) FROM p WHERE parent_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM p q WHERE q.event_id = p.event_id AND q.node_id = p.parent_id)
 UNION ALL SELECT 'inst_groups', event_id, CAST(group_id AS BIGINT), CAST(t AS BIGINT) FROM i WHERE t >= 0 AND NOT EXISTS (SELECT 1 FROM g q WHERE NOT q.gone AND q.event_id = i.event_id AND q.node_id = i.t)""",
    "p4_orphans": f"""WITH RECURSIVE {_REFERENCES}, w AS (SELECT ref_table, event_id, child, par, par AS missing, 0 AS lev, withdrawn FROM d UNION ALL SELECT r.ref_table, r.event_id, r.child, r.par, w.missing, w.lev + 1, NULL FROM refs r JOIN w ON w.ref_table = r.target AND w.event_id = r.event_id AND w.child = r.par)
 SELECT ref_table, event_id, child AS child_id, par AS target_id, missing AS missing_id, lev AS level, withdrawn FROM w""",
    "p4_periods": f"""WITH RECURSIVE {_REFERENCES},
 w AS (SELECT ref_table, event_id, child, seen_at, 0 AS lev, withdrawn FROM d UNION SELECT r.ref_table, r.event_id, r.child, r.seen_at, 1, false FROM refs r JOIN w ON w.ref_table = r.target AND w.event_id = r.event_id AND w.child = r.par)
 SELECT ref_table, strftime(seen_at, '%Y-%m') AS month, count(*) FILTER (lev = 0) AS direct, count(*) FILTER (withdrawn) AS withdrawn, count(*) FILTER (lev > 0) AS inherited FROM w GROUP BY ALL""",
    "p5_found": """WITH s AS (SELECT event_id, id, any_value(sem_type) AS sem_type, coalesce(any_value(CASE WHEN len(pc_offsets) = 2 THEN pc_offsets[2] - pc_offsets[1] END), 0) AS n FROM particles GROUP BY event_id, id), t AS (SELECT event_id, sum(n) AS a FROM s GROUP BY event_id)
 SELECT event_id, 'particle' AS key_kind, CAST(id AS BIGINT) AS key_id FROM s JOIN t USING (event_id) WHERE n * 100 > a * 70
 UNION ALL SELECT event_id, 'sem_type', CAST(sem_type AS BIGINT) FROM (SELECT event_id, sem_type, sum(n) AS n FROM s WHERE sem_type IS NOT NULL GROUP BY ALL) JOIN t USING (event_id) WHERE n * 100 > a * 90""",
    "p5_particles": "SELECT event_id, CAST(particle_id AS BIGINT) AS particle_id, count(*) AS points, round(sum(CASE WHEN NOT isnan(de) THEN CAST(de AS DOUBLE) END), 3) AS energy FROM (SELECT DISTINCT event_id, particle_id, point_id, de FROM points) GROUP BY ALL",
    "p5_sem_types": """WITH k AS (SELECT event_id, id, any_value(sem_type) AS sem_type FROM particles GROUP BY ALL) SELECT q.event_id, CAST(sem_type AS INT) AS sem_type, count(*) AS points, round(sum(CASE WHEN NOT isnan(de) THEN CAST(de AS DOUBLE) END), 3) AS energy
 FROM (SELECT DISTINCT event_id, particle_id, point_id, de FROM points) q LEFT JOIN k ON k.event_id = q.event_id AND k.id = q.particle_id GROUP BY ALL""",
    "p6_found": r"""WITH RECURSIVE m AS (SELECT event_id, id1, id2 FROM merge_decisions WHERE regexp_matches(reason, '^\s*(mergeoutcome\.)?\s*merged\s*$', 'i') AND id1 <> id2), e AS (SELECT event_id, id1 AS u, id2 AS v FROM m UNION SELECT event_id, id2, id1 FROM m),
 r AS (SELECT DISTINCT event_id, u AS n, u AS c FROM e UNION SELECT r.event_id, e.v, r.c FROM r JOIN e ON e.event_id = r.event_id AND e.u = r.n) SELECT event_id, CAST(n AS BIGINT) AS particle_id, CAST(min(c) AS BIGINT) AS group_id FROM r GROUP BY event_id, n""",
    "p6_markers": r"""WITH RECURSIVE m AS (SELECT event_id, id1, id2 FROM merge_decisions WHERE regexp_matches(reason, '^\s*(mergeoutcome\.)?\s*merged\s*$', 'i') AND id1 <> id2), e AS (SELECT event_id, id1 AS u, id2 AS v FROM m UNION SELECT event_id, id2, id1 FROM m),
 r AS (SELECT DISTINCT event_id, u AS n, u AS c FROM e UNION SELECT r.event_id, e.v, r.c FROM r JOIN e ON e.event_id = r.event_id AND e.u = r.n), g AS (SELECT event_id, n, min(c) AS grp FROM r GROUP BY event_id, n), h AS (SELECT event_id, id, arg_max(frag_id, recorded_at) AS f, arg_max(inst_id, recorded_at) AS i FROM particles GROUP BY event_id, id)
 SELECT g.event_id, CAST(g.grp AS BIGINT) AS group_id, count(*) AS members, count(*) FILTER (h.f = h.id) AS fragment_heads, count(*) FILTER (h.i = h.id) AS instance_heads, count(*) FILTER (h.id IS NULL) AS without_row FROM g LEFT JOIN h ON h.event_id = g.event_id AND h.id = g.n GROUP BY g.event_id, g.grp""",
}

"""SQL for DuckDB that gives the rows of ``queries``. Queries without an entry are tested against brute force on fixtures."""

from __future__ import annotations


def _one(table: str, keys: str, columns: str) -> str:
    """The standing row of each key."""
    return f"SELECT {keys}, {', '.join(f'arg_max({c}, recorded_at) AS {c}' for c in columns.split(', '))} FROM {table} GROUP BY {keys}"


PTS = "pts AS (SELECT event_id, particle_id, point_id, any_value(x) AS x, any_value(y) AS y, any_value(z) AS z, any_value(t) AS t, any_value(de) AS de, any_value(dx) AS dx FROM points GROUP BY event_id, particle_id, point_id)"
GOOD = "good AS (SELECT * FROM pts WHERE x IS NOT NULL AND NOT isnan(x) AND NOT isnan(y) AND NOT isnan(z))"
VOX = f"{PTS}, {GOOD}, cel AS (SELECT *, CAST(floor((CAST(x AS DOUBLE) + 2160) / 3) AS BIGINT) AS vx, CAST(floor((CAST(y AS DOUBLE) + 2160) / 3) AS BIGINT) AS vy, CAST(floor((CAST(z AS DOUBLE) + 2160) / 3) AS BIGINT) AS vz FROM good)"
VOXELS = f"{VOX}, vxl AS (SELECT event_id, particle_id, vx, vy, vz, min(t) AS t, sum(CAST(de AS DOUBLE)) AS de, sum(CAST(dx AS DOUBLE)) AS dx, count(*) AS n FROM cel GROUP BY event_id, particle_id, vx, vy, vz)"
_TRACK_COLUMNS = "parent_track_id, pdg, x, y, z, t, px, py, pz, ke, mass, end_px, end_py, end_pz, end_ke, proc_start, subproc_start, proc_end, subproc_end, dropped"
TRK = f"trk AS (SELECT * REPLACE (CASE WHEN parent_track_id >= 0 AND parent_track_id <> track_id THEN parent_track_id END AS parent_track_id) FROM ({_one('geant4', 'event_id, track_id', _TRACK_COLUMNS)}) WHERE NOT dropped)"
PAR = f"par AS (SELECT * REPLACE (CASE WHEN parent_id >= 0 AND parent_id <> id THEN parent_id END AS parent_id) FROM ({_one('particles', 'event_id, id', 'parent_id, geant4_trackid, ancestor_id, pdg, parent_pdg, interaction_id, interaction_type, sem_type, pc_offsets')}))"
GRP = f"grp AS ({_one('inst_groups', 'event_id, group_id', 'volume, group_to_track, center_py, center_pz, center_times, peak_charges')})"
MEM = """mem AS (SELECT c.event_id, c.id, c.parent_id, coalesce(u.id, c.id) AS frag_id, coalesce(CASE WHEN u.id IS NULL THEN c.ancestor_id ELSE u.ancestor_id END, u.id, c.id) AS inst_id, CASE WHEN u.id IS NULL THEN c.sem_type ELSE u.sem_type END AS sem_type,
 CASE WHEN u.id IS NULL THEN c.interaction_id ELSE u.interaction_id END AS interaction_id, u.id IS NULL AND coalesce(c.sem_type = 5, false) AS is_le FROM par c LEFT JOIN par u ON u.event_id = c.event_id AND u.id = c.parent_id AND c.sem_type = 5 AND coalesce(u.sem_type, 0) <> 5)"""
RANK = "CASE sem_type WHEN 2 THEN 0 WHEN 1 THEN 1 WHEN 3 THEN 2 WHEN 4 THEN 3 WHEN 5 THEN 4 WHEN 6 THEN 5 ELSE 6 END"
LAB = f"{VOXELS}, {PAR}, {MEM}, lab AS (SELECT v.*, coalesce(m.inst_id, -1) AS inst_id, m.sem_type, coalesce(m.interaction_id, -1) AS interaction_id, coalesce(m.is_le, false) AS is_le, {RANK} AS rk FROM vxl v LEFT JOIN mem m ON m.event_id = v.event_id AND m.id = v.particle_id)"
CENTRE = "CAST((v{a} + 0.5) * 3 - 2160 AS FLOAT) AS {a}"
CENTRES = ", ".join(CENTRE.format(a=a) for a in "xyz")
GROUPS = r"""m AS (SELECT event_id, id1, id2 FROM merge_decisions WHERE regexp_matches(reason, '^\s*(mergeoutcome\.)?\s*merged\s*$', 'i') AND id1 <> id2), e AS (SELECT event_id, id1 AS u, id2 AS v FROM m UNION SELECT event_id, id2, id1 FROM m),
 r AS (SELECT DISTINCT event_id, u AS n, u AS c FROM e UNION SELECT r.event_id, e.v, r.c FROM r JOIN e ON e.event_id = r.event_id AND e.u = r.n), g AS (SELECT event_id, n AS id, min(c) AS frag FROM r GROUP BY event_id, n)"""
NEAR = f"""{PTS}, {GOOD}, cc AS (SELECT event_id, particle_id, point_id, CAST(x AS DOUBLE) AS x, CAST(y AS DOUBLE) AS y, CAST(z AS DOUBLE) AS z, CAST(floor(CAST(x AS DOUBLE) / 5.2) AS BIGINT) AS i, CAST(floor(CAST(y AS DOUBLE) / 5.2) AS BIGINT) AS j, CAST(floor(CAST(z AS DOUBLE) / 5.2) AS BIGINT) AS k FROM good),
 off AS (SELECT a.range - 1 AS di, b.range - 1 AS dj, d.range - 1 AS dk FROM range(3) a, range(3) b, range(3) d), ff AS (SELECT event_id, particle_id, point_id, x, y, z, i + di AS i, j + dj AS j, k + dk AS k FROM cc, off),
 tch AS (SELECT ff.event_id, ff.particle_id AS owner_a, cc.particle_id AS owner_b, min(sqrt((ff.x - cc.x) ** 2 + (ff.y - cc.y) ** 2 + (ff.z - cc.z) ** 2)) AS distance FROM ff JOIN cc USING (event_id, i, j, k) WHERE ff.particle_id < cc.particle_id AND (ff.x - cc.x) ** 2 + (ff.y - cc.y) ** 2 + (ff.z - cc.z) ** 2 <= 5.2 * 5.2 GROUP BY ALL)"""
LAID = f"""{PAR}, {MEM}, cnt AS (SELECT event_id, particle_id, count(DISTINCT point_id) AS n FROM points GROUP BY ALL), rws AS (SELECT m.event_id, m.id AS particle_id, interaction_id, inst_id, is_le, frag_id, CAST(coalesce(n, 0) AS BIGINT) AS n FROM mem m LEFT JOIN cnt c ON c.event_id = m.event_id AND c.particle_id = m.id),
 laid AS (SELECT *, CAST(sum(n) OVER w AS BIGINT) - n AS pc_start, CAST(sum(n) OVER w AS BIGINT) AS pc_end FROM rws WINDOW w AS (PARTITION BY event_id ORDER BY interaction_id NULLS FIRST, inst_id NULLS FIRST, is_le, frag_id, particle_id ROWS UNBOUNDED PRECEDING))"""
VOLUME = "x >= x_min AND x < x_max AND y >= y_min AND y < y_max AND z >= z_min AND z < z_max AND NOT isnan(x) AND NOT isnan(y) AND NOT isnan(z)"
_KIND = """CASE WHEN parent_track_id IS NULL THEN 5 WHEN pdg = 2112 THEN 2 WHEN pdg > 1000000000 THEN 3 WHEN pdg = 22 THEN 4
 WHEN abs(pdg) = 11 AND proc_start = 2 AND subproc_start = 12 THEN 10 WHEN abs(pdg) = 11 AND proc_start = 2 AND subproc_start = 13 THEN 6 WHEN abs(pdg) = 11 AND proc_start = 2 AND subproc_start IN (14, 4) THEN 8
 WHEN abs(pdg) = 11 AND proc_start = 2 AND subproc_start = 2 AND abs(ppdg) = 22 THEN 9 WHEN abs(pdg) = 11 AND proc_start = 2 AND subproc_start = 2 AND abs(ppdg) IN (211, 13, 2212, 321) THEN 7 WHEN abs(pdg) = 11 AND proc_start = 2 AND subproc_start = 2 THEN 9
 WHEN abs(pdg) = 11 AND proc_start = 2 THEN 13 WHEN abs(pdg) = 11 AND proc_start = 6 THEN 11 WHEN abs(pdg) = 11 AND proc_start = 4 AND subproc_start = 151 AND dr < 1e-4 AND ke < 0.05 THEN 9
 WHEN abs(pdg) = 11 AND proc_start = 4 AND subproc_start = 151 AND dr < 1e-4 THEN 11 WHEN abs(pdg) = 11 AND ke < 0.05 THEN 6 WHEN abs(pdg) = 11 THEN 12 ELSE 1 END"""
_SEM = """CASE WHEN k = 13 THEN 6 WHEN k = 1 THEN CASE WHEN extent < 5 THEN 5 ELSE 2 END WHEN k = 5 THEN CASE WHEN abs(pdg) IN (11, 22) THEN 1 ELSE 2 END WHEN k = 7 THEN CASE WHEN extent < 5 THEN 5 ELSE 3 END
 WHEN k = 11 THEN CASE WHEN abs(pdg) = 11 AND abs(parent_pdg) = 13 THEN 4 WHEN abs(pdg) IN (11, 22) THEN 1 ELSE 2 END WHEN k IN (2, 9, 10) THEN 5 WHEN k IN (4, 6, 8, 12) THEN CASE WHEN extent > 5 THEN 1 ELSE 5 END WHEN k = 3 THEN CASE WHEN extent > 5 THEN 2 ELSE 5 END END"""
_ANODE = "CASE WHEN drift_dir > 0 THEN x_max ELSE x_min END"


def _roots(lk: str) -> str:
    """rt (event_id, id, root_id, depth) of the links in ``lk`` (event_id, id, up; up null at roots); of a circle the least id on it is the root of all that run into it, without depth."""
    return f"""w AS (SELECT event_id, id, id AS root_id, 0 AS depth FROM {lk} WHERE up IS NULL UNION ALL SELECT l.event_id, l.id, w.root_id, w.depth + 1 FROM {lk} l JOIN w ON w.event_id = l.event_id AND w.id = l.up),
 lo AS (SELECT l.event_id, l.id, l.up FROM {lk} l WHERE NOT EXISTS (SELECT 1 FROM w WHERE w.event_id = l.event_id AND w.id = l.id)), cl AS (SELECT event_id, id AS s, up AS n FROM lo UNION SELECT cl.event_id, cl.s, lo.up FROM cl JOIN lo ON lo.event_id = cl.event_id AND lo.id = cl.n),
 hd AS (SELECT cl.event_id, cl.s AS id, min(cl.n) AS root_id FROM cl JOIN cl o ON o.event_id = cl.event_id AND o.s = cl.n AND o.n = cl.n GROUP BY ALL), rt AS (SELECT event_id, id, root_id, depth FROM w UNION ALL SELECT event_id, id, root_id, NULL FROM hd)"""


_CLOSE = " AND ".join(f"abs(CAST(a.{c} AS DOUBLE) - b.{c}) <= 1e-4 + 1e-5 * abs(CAST(b.{c} AS DOUBLE))" for c in "xyzt")
#: Components of each particle's cloud: the labels of a round are the least of the neighbours'.
_CLOUDS = """cc AS (SELECT event_id, particle_id, point_id, CAST(x AS DOUBLE) AS x, CAST(y AS DOUBLE) AS y, CAST(z AS DOUBLE) AS z, CAST(floor(CAST(x AS DOUBLE) / 5.2) AS BIGINT) AS i, CAST(floor(CAST(y AS DOUBLE) / 5.2) AS BIGINT) AS j, CAST(floor(CAST(z AS DOUBLE) / 5.2) AS BIGINT) AS k FROM {of}),
 off AS (SELECT a.range - 1 AS di, b.range - 1 AS dj, d.range - 1 AS dk FROM range(3) a, range(3) b, range(3) d), ff AS (SELECT event_id, particle_id, point_id, x, y, z, i + di AS i, j + dj AS j, k + dk AS k FROM cc, off),
 eg AS (SELECT ff.point_id AS u, cc.point_id AS v FROM ff JOIN cc USING (event_id, particle_id, i, j, k) WHERE ff.point_id <> cc.point_id AND (ff.x - cc.x) ** 2 + (ff.y - cc.y) ** 2 + (ff.z - cc.z) ** 2 <= 5.2 * 5.2),
 lab(id, comp) USING KEY (id) AS (SELECT point_id, point_id FROM cc UNION SELECT u.id, min(v.comp) FROM recurring.lab u JOIN eg ON eg.u = u.id JOIN lab v ON v.id = eg.v WHERE v.comp < u.comp GROUP BY u.id)"""


SQL = {
    "voxel_label_events": f"""WITH {LAB} SELECT event_id, {CENTRES}, round(sum(de), 3) AS energy, count(*) AS points, CAST(arg_min(sem_type, (rk, t, particle_id)) AS INT) AS sem_type, arg_min(inst_id, (rk, t, particle_id)) AS inst_id, arg_min(interaction_id, (rk, t, particle_id)) AS interaction_id FROM lab GROUP BY event_id, vx, vy, vz""",
    "training_without_le": f"""WITH {LAB}, u AS (SELECT event_id, vx, vy, vz, sum(de) AS energy, CAST(arg_min(sem_type, (rk, t, particle_id)) AS INT) AS sem_type FROM lab WHERE NOT is_le GROUP BY event_id, vx, vy, vz) SELECT event_id, sem_type, count(*) AS voxels, round(sum(energy), 2) AS energy FROM u GROUP BY ALL""",
    "merge_duplicates": f"WITH {PTS}, d AS (SELECT event_id, particle_id, x, y, z, sum(CAST(de AS DOUBLE)) AS de, count(*) AS n FROM pts GROUP BY ALL) SELECT event_id, particle_id, count(*) AS points, count(*) FILTER (n > 1) AS merged, round(sum(de), 3) AS energy FROM d GROUP BY ALL",
    "voxelize_points": f"WITH {VOXELS} SELECT event_id, particle_id, {CENTRES}, round(CAST(t AS DOUBLE), 4) AS t, round(de, 3) AS de, round(dx, 3) AS dx, n FROM vxl",
    "voxelize_own_origin": f"""WITH {PTS}, {GOOD}, o AS (SELECT event_id, particle_id, min(CAST(x AS DOUBLE)) AS ox, min(CAST(y AS DOUBLE)) AS oy, min(CAST(z AS DOUBLE)) AS oz FROM good GROUP BY ALL),
 v AS (SELECT event_id, particle_id, floor((x - ox) / 3) AS a, floor((y - oy) / 3) AS b, floor((z - oz) / 3) AS c, count(*) AS n FROM good JOIN o USING (event_id, particle_id) GROUP BY ALL) SELECT event_id, particle_id, count(*) AS voxels, CAST(sum(n) AS BIGINT) AS points FROM v GROUP BY ALL""",
    "voxmap_bridge": f"WITH {VOX} SELECT event_id, particle_id, vx, vy, vz, point_id FROM cel",
    "extent_by_particle": f"WITH {PTS}, {GOOD} SELECT event_id, particle_id, count(DISTINCT (floor(CAST(x AS DOUBLE) / 3), floor(CAST(y AS DOUBLE) / 3), floor(CAST(z AS DOUBLE) / 3))) AS extent FROM good GROUP BY ALL",
    "truth_voxel_earliest": f"WITH {VOXELS} SELECT event_id, particle_id, vx, vy, vz, round(de, 3) AS de, round(CAST(t AS DOUBLE), 4) AS t FROM vxl",
    "union_clouds": f"WITH {VOXELS} SELECT event_id, vx, vy, vz, round(sum(de), 3) AS de, arg_min(particle_id, (-de, particle_id)) AS particle_id FROM vxl GROUP BY event_id, vx, vy, vz",
    "particle_boxes": f"WITH {PTS} SELECT event_id, particle_id, {', '.join(f'{m}(CASE WHEN NOT isnan({a}) THEN CAST({a} AS DOUBLE) END) AS {a}_{m}' for a in 'xyz' for m in ('min', 'max'))}, count(CASE WHEN NOT isnan(x) THEN x END) AS points FROM pts GROUP BY ALL",
    "interaction_types": f"""WITH {TRK}, u AS (SELECT c.event_id, c.track_id, c.parent_track_id, coalesce(c.pdg, 0) AS pdg, c.proc_start, c.subproc_start, CASE WHEN isnan(c.ke) THEN 1e9 ELSE c.ke END AS ke, coalesce(p.pdg, 0) AS ppdg,
 CASE WHEN p.x IS NULL THEN -1 ELSE sqrt((CAST(p.x AS DOUBLE) - c.x) ** 2 + (CAST(p.y AS DOUBLE) - c.y) ** 2 + (CAST(p.z AS DOUBLE) - c.z) ** 2) END AS dr FROM trk c LEFT JOIN trk p ON p.event_id = c.event_id AND p.track_id = c.parent_track_id) SELECT event_id, track_id, ppdg AS parent_pdg, {_KIND} AS interaction_type FROM u""",
    "semantic_types": f"""WITH {PTS}, {GOOD}, {PAR}, x AS (SELECT event_id, particle_id, count(DISTINCT (floor(CAST(x AS DOUBLE) / 3), floor(CAST(y AS DOUBLE) / 3), floor(CAST(z AS DOUBLE) / 3))) AS extent FROM good GROUP BY ALL),
 k AS (SELECT par.event_id, id, pdg, parent_pdg, interaction_type AS k, coalesce(extent, 0) AS extent FROM par LEFT JOIN x ON x.event_id = par.event_id AND x.particle_id = par.id WHERE interaction_type NOT IN (4, 6, 8, 12) OR abs(pdg) IN (11, 22)) SELECT event_id, id, extent, {_SEM} AS sem_type FROM k""",
    "drift_to_xyz": f"""WITH {GRP}, q AS (SELECT event_id, group_id, ({_ANODE}) - drift_dir * (center_times - 100) * 1.6 * 0.5 AS x, y_min + (center_py + 0.5) * 4.0 AS y, z_min + (center_pz + 0.5) * 4.0 AS z, x_min, x_max FROM grp JOIN volumes ON volume = volume_id)
 SELECT event_id, group_id, round(CAST(x AS DOUBLE), 4) AS x, round(CAST(y AS DOUBLE), 4) AS y, round(CAST(z AS DOUBLE), 4) AS z, x < x_min OR x > x_max AS outside FROM q""",
    "window_truncation": f"""WITH {PTS}, q AS (SELECT volume_id, 100 + (abs(CAST(x AS DOUBLE) - ({_ANODE})) / CAST(1.6 AS DOUBLE) + CAST(t AS DOUBLE)) / 0.5 AS tick FROM pts JOIN volumes ON {VOLUME}) SELECT volume_id, count(*) AS points, count(*) FILTER (tick < 0) AS before, count(*) FILTER (tick > 2000) AS after FROM q GROUP BY ALL""",
    "converted_momenta": f"""WITH t AS ({_one('geant4', 'event_id, track_id', _TRACK_COLUMNS)}), l AS (SELECT event_id, parent_track_id, {', '.join(f'sum(CAST({c} AS DOUBLE)) AS {c}' for c in ('px', 'py', 'pz', 'ke'))} FROM t WHERE NOT dropped AND proc_start = 2 AND subproc_start = 13 GROUP BY ALL)
 SELECT t.event_id, t.track_id, {', '.join(f'round(CASE WHEN t.pdg = 22 AND t.proc_end = 2 AND t.subproc_end = 14 THEN CAST(t.{c} AS DOUBLE) - coalesce(l.{c}, 0) ELSE CAST(t.end_{c} AS DOUBLE) END, 3) AS end_{c}' for c in ('px', 'py', 'pz'))},
 round(CASE WHEN t.pdg = 22 AND t.proc_end = 2 AND t.subproc_end = 14 THEN CAST(t.ke AS DOUBLE) + t.mass - coalesce(l.ke, 0) ELSE CAST(t.end_ke AS DOUBLE) + t.mass END, 3) AS end_e FROM t LEFT JOIN l ON l.event_id = t.event_id AND l.parent_track_id = t.track_id WHERE NOT dropped""",
    "step_ends": f"""WITH {TRK}, q AS (SELECT event_id, track_id, CAST(x AS DOUBLE) AS x, CAST(y AS DOUBLE) AS y, CAST(z AS DOUBLE) AS z, CAST(t AS DOUBLE) AS t, CAST(px AS DOUBLE) AS px, CAST(py AS DOUBLE) AS py, CAST(pz AS DOUBLE) AS pz, CAST(mass AS DOUBLE) AS m FROM trk), p AS (SELECT *, sqrt(px * px + py * py + pz * pz) AS p FROM q),
 a AS (SELECT *, CASE WHEN p > 0 THEN acos(pz / p) ELSE 0 END AS th, atan2(py, px) AS ph, sqrt(p * p + m * m) AS e FROM p) SELECT event_id, track_id, round(x + 5 * sin(th) * cos(ph), 2) AS x, round(y + 5 * sin(th) * sin(ph), 2) AS y, round(z + 5 * cos(th), 2) AS z, round(t + CASE WHEN p > 0 THEN 5 / (p / e * 299.792458) ELSE 0 END, 2) AS t, round(e, 2) AS e FROM a""",
    "rounded_energy": f"WITH {PTS}, q AS (SELECT point_id, CAST(de AS DOUBLE) AS d, pow(2.0, floor(log2(abs(CASE WHEN de = 0 THEN 1 ELSE CAST(de AS DOUBLE) END))) - 10) AS u FROM pts) SELECT point_id, CASE WHEN d IS NULL OR isnan(d) OR d = 0 THEN d ELSE round_even(d / u, 0) * u END AS de FROM q",
    "ancestor_root": f"WITH RECURSIVE {TRK}, lk AS (SELECT c.event_id, c.track_id AS id, p.track_id AS up FROM trk c LEFT JOIN trk p ON p.event_id = c.event_id AND p.track_id = c.parent_track_id), {_roots('lk')} SELECT event_id, id AS track_id, root_id, depth FROM rt",
    "visible_groups": f"WITH {GRP} SELECT event_id, group_id, group_to_track FROM grp WHERE abs(peak_charges) >= 100",
    "attached_groups": f"WITH {GRP}, {TRK}, j AS (SELECT grp.event_id, trk.track_id FROM grp LEFT JOIN trk ON trk.event_id = grp.event_id AND trk.track_id = grp.group_to_track) SELECT event_id, count(track_id) AS matched, count(*) - count(track_id) AS unmatched FROM j GROUP BY ALL",
    "sensor_mask": f"WITH {GRP}, k AS (SELECT DISTINCT event_id, volume, center_py, center_pz, center_times FROM grp WHERE volume % 2 = 0) SELECT g.event_id, g.group_id, k.event_id IS NOT NULL AS on_sensor FROM grp g LEFT JOIN k USING (event_id, volume, center_py, center_pz, center_times) WHERE abs(peak_charges) >= 50",
    "csr_decode": f"""WITH {GRP}, n AS (SELECT *, ((center_pz % 4) + 4) % 4 + 1 AS size FROM grp), o AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY event_id ORDER BY group_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS k FROM n), e AS (SELECT *, unnest(range(CAST(size AS BIGINT))) AS i FROM o),
 m AS (SELECT *, {', '.join(f'(({c} + i * {by}) % {of} + {of}) % {of} - {of // 2} AS {n}' for c, by, of, n in (('center_py', 7, 23, 'dy'), ('center_times', 5, 31, 'dz'), ('center_py', 11, 61, 'dt'), ('center_times', 4099, 65535, 'fr')))} FROM e)
 SELECT event_id, group_id, CAST(k + i AS BIGINT) AS csr_pos, CAST(center_py + dy AS INT) AS py, CAST(center_pz + dz AS INT) AS pz, CAST(center_times + dt AS INT) AS tick, round(CAST(peak_charges AS DOUBLE) * fr / CAST(32767 AS DOUBLE), 4) AS charge FROM m""",
    "sensor_delta_decode": f"WITH {GRP} SELECT event_id, volume, group_id, CAST(7 + sum(center_py) OVER w AS BIGINT) AS py, CAST(-3 + sum(center_times) OVER w AS BIGINT) AS tick FROM grp WINDOW w AS (PARTITION BY event_id, volume ORDER BY group_id ROWS UNBOUNDED PRECEDING)",
    "group_owners": f"""WITH {PTS}, r AS (SELECT event_id, volume_id * 100 + CAST(floor((z + 2200) / 100) AS BIGINT) AS group_id, particle_id FROM pts JOIN volumes ON {VOLUME}), n AS (SELECT event_id, group_id, particle_id, count(*) AS n FROM r GROUP BY ALL) SELECT event_id, group_id, arg_min(particle_id, (-n, particle_id)) AS owner, count(*) > 1 AS straddled FROM n GROUP BY ALL""",
    "group_reductions": f"WITH {PTS} SELECT event_id, particle_id, avg(CAST(t AS DOUBLE)) AS t0, coalesce(sum(CAST(de AS DOUBLE)), 0) AS de FROM pts WHERE NOT isnan(de) GROUP BY ALL",
    "shared_energy": f"""WITH {PTS}, q AS (SELECT event_id, particle_id, point_id, CASE WHEN NOT isnan(de) THEN CAST(de AS DOUBLE) END AS e, abs(CASE WHEN NOT isnan(dx) THEN CAST(dx AS DOUBLE) END) AS c FROM pts), s AS (SELECT event_id, particle_id, coalesce(sum(e), 0) AS e, sum(c) AS c FROM q GROUP BY ALL)
 SELECT point_id, CASE WHEN s.c > 0 AND q.c IS NOT NULL THEN s.e * q.c / s.c ELSE 0 END AS true_de FROM q JOIN s USING (event_id, particle_id)""",
    "hit_labels": f"""WITH {GRP}, {PAR}, {MEM}, o AS (SELECT g.event_id, g.group_id, min(p.id) AS owner FROM grp g JOIN par p ON p.event_id = g.event_id AND p.geant4_trackid = g.group_to_track GROUP BY ALL)
 SELECT g.event_id, g.group_id, coalesce(m.frag_id, -1) AS fragment_id, coalesce(m.inst_id, -1) AS instance_id, coalesce(m.is_le, false) AS is_le FROM grp g LEFT JOIN o USING (event_id, group_id) LEFT JOIN mem m ON m.event_id = o.event_id AND m.id = o.owner""",
    "touching_particles": f"WITH {NEAR} SELECT event_id, owner_a, owner_b, round(distance, 5) AS distance FROM tch",
    "combine_le": f"""WITH RECURSIVE {NEAR}, {PAR}, l AS (SELECT event_id, id FROM par WHERE sem_type = 5), e AS (SELECT t.event_id, owner_a AS u, owner_b AS v FROM tch t WHERE (t.event_id, owner_a) IN (SELECT (event_id, id) FROM l) AND (t.event_id, owner_b) IN (SELECT (event_id, id) FROM l)), s AS (SELECT event_id, u, v FROM e UNION ALL SELECT event_id, v, u FROM e),
 r AS (SELECT DISTINCT event_id, u AS n, u AS c FROM s UNION SELECT r.event_id, s.v, r.c FROM r JOIN s ON s.event_id = r.event_id AND s.u = r.n) SELECT event_id, n AS id, min(c) AS group_id FROM r GROUP BY event_id, n""",
    "photon_decay": f"""WITH {PAR} SELECT DISTINCT c.event_id, c.id AS child, g.id AS parent FROM par c JOIN par g ON g.event_id = c.event_id AND g.id = c.parent_id AND g.pdg = 22 WHERE (abs(c.pdg) = 11 AND c.interaction_type = 8 AND c.parent_pdg = 22) OR (c.pdg = 22 AND c.geant4_trackid = g.geant4_trackid)""",
    "nearest_standoff": f"""WITH {PTS}, {GOOD}, {PAR}, d AS (SELECT event_id, id, parent_id FROM par WHERE sem_type = 3 AND parent_id IS NOT NULL), n AS (SELECT d.event_id, d.id AS child, a.point_id, min(sqrt((CAST(a.x AS DOUBLE) - b.x) ** 2 + (CAST(a.y AS DOUBLE) - b.y) ** 2 + (CAST(a.z AS DOUBLE) - b.z) ** 2)) AS near
 FROM d JOIN good a ON a.event_id = d.event_id AND a.particle_id = d.id LEFT JOIN good b ON b.event_id = d.event_id AND b.particle_id = d.parent_id GROUP BY ALL) SELECT event_id, child, count(*) AS cells, CASE WHEN count(near) = count(*) AND max(near) <= 30 THEN round(max(near), 4) END AS standoff FROM n GROUP BY ALL""",
    "partition_stats": f"""WITH RECURSIVE {PAR}, {GROUPS}, f AS (SELECT par.event_id, coalesce(g.frag, par.id) AS frag_id, count(*) AS n FROM par LEFT JOIN g ON g.event_id = par.event_id AND g.id = par.id GROUP BY ALL)
 SELECT event_id, count(*) AS partitions, avg(n) AS mean_size, CAST(quantile_cont(n, 0.5) AS DOUBLE) AS median_size, max(n) AS most, count(*) FILTER (n = 1) AS of_1, count(*) FILTER (n BETWEEN 2 AND 5) AS of_2_5, count(*) FILTER (n BETWEEN 6 AND 10) AS of_6_10, count(*) FILTER (n BETWEEN 11 AND 20) AS of_11_20, count(*) FILTER (n > 20) AS of_more FROM f GROUP BY event_id""",
    "absorbed_deltas": f"""WITH {PAR}, {MEM} SELECT d.event_id, d.id FROM mem d JOIN par p ON p.event_id = d.event_id AND p.id = d.id AND p.sem_type = 5 JOIN mem u ON u.event_id = d.event_id AND u.id = d.parent_id AND u.frag_id = d.frag_id JOIN par h ON h.event_id = d.event_id AND h.id = d.frag_id AND h.sem_type IN (2, 3, 4) WHERE d.id % 2 = 0""",
    "storage_ranges": f"WITH {LAID} SELECT event_id, particle_id, pc_start, pc_end FROM laid",
    "instance_spans": f"""WITH {LAID} SELECT event_id, interaction_id, inst_id, coalesce(min(pc_start) FILTER (n > 0), -1) AS start, coalesce(max(pc_end) FILTER (n > 0), -1) AS "end", coalesce(min(pc_start) FILTER (n > 0 AND is_le), max(pc_end) FILTER (n > 0), -1) AS le_start FROM laid GROUP BY event_id, interaction_id, inst_id""",
    "absolute_ranges": f"WITH {LAID}, b AS (SELECT event_id, CAST(sum(s) OVER (ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) - s AS base FROM (SELECT event_id, CAST(sum(n) AS BIGINT) AS s FROM laid GROUP BY event_id)) SELECT event_id, particle_id, CASE WHEN n > 0 THEN pc_start + base ELSE -1 END AS pc_start FROM laid JOIN b USING (event_id)",
    "range_overlaps": """WITH p AS (SELECT event_id, id, pc_offsets[1] AS start, pc_offsets[2] + 1 AS stop FROM (SELECT event_id, id, any_value(pc_offsets) AS pc_offsets FROM particles GROUP BY ALL) WHERE len(pc_offsets) = 2), n AS (SELECT *, lead(start) OVER w AS next_start, lead(id) OVER w AS next_label FROM p WHERE start >= 0 AND stop > start WINDOW w AS (PARTITION BY event_id ORDER BY start, stop, id))
 SELECT event_id, id, next_label, start, stop AS "end", next_start FROM n WHERE next_start < stop""",
    "contained_points": """WITH p AS (SELECT event_id, id, pc_offsets[1] AS s, pc_offsets[2] AS e FROM (SELECT event_id, id, any_value(pc_offsets) AS pc_offsets FROM particles GROUP BY ALL) WHERE len(pc_offsets) = 2 AND pc_offsets[2] > pc_offsets[1]), r AS (SELECT DISTINCT event_id, point_row FROM points) SELECT r.event_id, r.point_row, CASE WHEN r.point_row < p.e THEN p.id END AS id FROM r ASOF LEFT JOIN p ON p.event_id = r.event_id AND r.point_row >= p.s""",
    "first_last_points": f"""WITH {PTS}, {PAR}, {MEM}, s AS (SELECT m.event_id, m.inst_id, p.t, p.point_id, NOT m.is_le AS ok, max(NOT m.is_le) OVER (PARTITION BY m.event_id, m.inst_id) AS has_ok FROM pts p JOIN mem m ON m.event_id = p.event_id AND m.id = p.particle_id)
 SELECT event_id, inst_id, arg_min(point_id, (t, point_id)) AS first_point, arg_max(point_id, (t, -point_id)) AS last_point FROM s WHERE ok OR NOT has_ok GROUP BY ALL""",
    "dense_ids": f"WITH {PAR}, n AS (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY id) - 1 AS nid FROM par) SELECT n.event_id, n.id AS old_id, CAST(n.nid AS INT) AS id, CAST(coalesce(p.nid, n.nid) AS INT) AS parent_id, CAST(coalesce(a.nid, n.nid) AS INT) AS ancestor_id FROM n LEFT JOIN n p ON p.event_id = n.event_id AND p.id = n.parent_id LEFT JOIN n a ON a.event_id = n.event_id AND a.id = n.ancestor_id",
    "self_markers": f"""WITH {PAR}, {MEM} SELECT event_id, id, {', '.join(f'CASE WHEN {k}_id = id THEN id ELSE -1 END AS {k}_id, CASE WHEN {k}_id = id THEN count(*) OVER (PARTITION BY event_id, {k}_id) ELSE -1 END AS {k}_merge_count' for k in ('frag', 'inst'))} FROM mem""",
    "points_of_instances": f"WITH {PTS}, {PAR}, {MEM} SELECT p.event_id, coalesce(m.inst_id, -1) AS group_id, count(*) AS points FROM pts p LEFT JOIN mem m ON m.event_id = p.event_id AND m.id = p.particle_id WHERE NOT coalesce(m.is_le, false) GROUP BY ALL",
    "decision_summary": r"SELECT stage, pass_no, upper(regexp_replace(trim(reason), '^MergeOutcome\.', '', 'i')) AS outcome, count(*) AS decisions FROM merge_decisions GROUP BY ALL",
    "not_merged": r"""WITH x AS (SELECT *, upper(regexp_replace(trim(reason), '^MergeOutcome\.', '', 'i')) AS outcome, least(id1, id2) AS lo, greatest(id1, id2) AS hi FROM merge_decisions), m AS (SELECT DISTINCT event_id, lo, hi FROM x WHERE outcome = 'MERGED') SELECT outcome, count(DISTINCT (event_id, lo, hi)) AS pairs FROM x WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.event_id = x.event_id AND m.lo = x.lo AND m.hi = x.hi) GROUP BY ALL""",
    "run_report": f"""WITH {PTS}, e AS (SELECT event_id, CAST(count(*) AS DOUBLE) AS points, CAST(count(DISTINCT particle_id) AS DOUBLE) AS particles FROM pts GROUP BY ALL) SELECT 'points' AS metric, min(points) AS least, round(avg(points), 6) AS mean, max(points) AS most, count(*) AS events FROM e UNION ALL SELECT 'particles', min(particles), round(avg(particles), 6), max(particles), count(*) FROM e""",
    "pitch_fit": f"WITH {GRP}, {TRK}, q AS (SELECT volume, CAST(center_py AS DOUBLE) AS a, CAST(y AS DOUBLE) AS y FROM grp JOIN trk ON trk.event_id = grp.event_id AND trk.track_id = grp.group_to_track WHERE NOT isnan(y)) SELECT volume, round(regr_slope(y, a), 6) AS slope, round(regr_intercept(y, a), 4) AS intercept, CAST(regr_count(y, a) AS BIGINT) AS n FROM q GROUP BY ALL",
    "residual_medians": f"WITH {GRP} SELECT volume, count(*) AS n, round(quantile_cont(abs(CAST(peak_charges AS DOUBLE) - 100), 0.5), 4) AS median, CASE WHEN count(*) >= 8 THEN quantile_cont(abs(CAST(peak_charges AS DOUBLE) - 100), 0.5) <= 60 END AS ok FROM grp WHERE peak_charges IS NOT NULL GROUP BY ALL",
    "chained_inputs": "WITH e AS (SELECT event_id, any_value(input_no) AS i, any_value(job_id) AS j, any_value(format_version) AS f FROM run_events GROUP BY event_id) SELECT CAST(i % 2 AS INT) AS input, count(*) AS events, CASE WHEN i % 2 = 0 THEN count(j) ELSE 0 END AS with_job, CASE WHEN i % 2 = 1 THEN count(f) ELSE 0 END AS with_version FROM e GROUP BY i % 2",
    "paired_entries": "SELECT event_id, event_id AS entry FROM (SELECT event_id, arg_max(jaxtpc_entry, recorded_at) AS j FROM run_events GROUP BY event_id) WHERE j >= 0",
    "store_roundtrip": f"WITH {GRP}, c AS (SELECT count(*) AS n FROM grp) SELECT 'given' AS what, n FROM c UNION ALL SELECT 'read', n FROM c UNION ALL SELECT 'different', 0",
    "vertex_match": f"WITH {TRK}, v AS (SELECT * FROM trk WHERE parent_track_id IS NULL) SELECT a.event_id, a.track_id, min(b.track_id) AS vertex_row FROM v a LEFT JOIN v b ON b.event_id = a.event_id AND {_CLOSE} GROUP BY ALL",
    "group_parents": f"WITH RECURSIVE {PAR}, h AS (SELECT *, coalesce(sem_type IN (1, 2, 4), false) AS head FROM par), w AS (SELECT event_id, id AS s, parent_id AS n, 1 AS d FROM h WHERE head UNION ALL SELECT w.event_id, w.s, h.parent_id, w.d + 1 FROM w JOIN h ON h.event_id = w.event_id AND h.id = w.n WHERE NOT h.head AND w.d < 500), f AS (SELECT w.event_id, w.s, min(CASE WHEN h.head THEN h.id END) AS top FROM w LEFT JOIN h ON h.event_id = w.event_id AND h.id = w.n GROUP BY ALL) SELECT event_id, s AS id, coalesce(top, s) AS group_parent FROM f",
    "redirected_parents": f"WITH RECURSIVE {PAR}, h AS (SELECT *, NOT coalesce(sem_type = 5, false) AS head FROM par), w AS (SELECT event_id, id AS s, parent_id AS n, 1 AS d FROM h WHERE head UNION ALL SELECT w.event_id, w.s, h.parent_id, w.d + 1 FROM w JOIN h ON h.event_id = w.event_id AND h.id = w.n WHERE NOT h.head AND w.d < 500), f AS (SELECT w.event_id, w.s, min(CASE WHEN h.head THEN h.id END) AS top FROM w LEFT JOIN h ON h.event_id = w.event_id AND h.id = w.n GROUP BY ALL) SELECT event_id, s AS id, coalesce(top, s) AS parent_id FROM f",
    "traceable_instances": f"""WITH RECURSIVE {PAR}, {GRP}, vis AS (SELECT DISTINCT p.event_id, p.id, p.interaction_id FROM par p JOIN grp ON grp.event_id = p.event_id AND grp.group_to_track = p.geant4_trackid WHERE group_to_track >= 0),
 u AS (SELECT event_id, id FROM vis UNION SELECT u.event_id, q.id FROM u JOIN par c ON c.event_id = u.event_id AND c.id = u.id JOIN par q ON q.event_id = c.event_id AND q.id = c.parent_id)
 SELECT event_id, id FROM u UNION SELECT p.event_id, p.id FROM par p LEFT JOIN par q ON q.event_id = p.event_id AND q.id = p.parent_id WHERE q.id IS NULL AND EXISTS (SELECT 1 FROM vis WHERE vis.event_id = p.event_id AND vis.interaction_id = p.interaction_id)""",
    "plane_fit": f"""WITH {GRP}, {TRK}, q AS (SELECT volume, CAST(center_times AS DOUBLE) AS a, CAST(t AS DOUBLE) AS b, CAST(x AS DOUBLE) AS y FROM grp JOIN trk ON trk.event_id = grp.event_id AND trk.track_id = grp.group_to_track WHERE NOT isnan(x) AND NOT isnan(t)), s AS (SELECT volume, count(*) AS n, avg(a) AS ma, avg(b) AS mb, avg(y) AS my, covar_pop(a, a) AS saa, covar_pop(a, b) AS sab, covar_pop(b, b) AS sbb, covar_pop(a, y) AS say, covar_pop(b, y) AS sby FROM q GROUP BY volume),
 f AS (SELECT *, (say * sbb - sby * sab) / (saa * sbb - sab * sab) AS b1, (sby * saa - say * sab) / (saa * sbb - sab * sab) AS b2 FROM s) SELECT volume, round(b1, 6) AS b1, round(b2, 6) AS b2, round(my - b1 * ma - b2 * mb, 4) AS b0, n FROM f""",
    "resolve_orphans": f"""WITH RECURSIVE {PAR}, fx AS (SELECT c.event_id, c.id, coalesce(q.id, c.id) AS p, a.id AS a FROM par c LEFT JOIN par q ON q.event_id = c.event_id AND q.id = c.parent_id LEFT JOIN par a ON a.event_id = c.event_id AND a.id = c.ancestor_id),
 lk AS (SELECT event_id, id, CASE WHEN p <> id THEN p END AS up FROM fx), {_roots('lk')} SELECT fx.event_id, fx.id, fx.p AS parent_id, coalesce(fx.a, rt.root_id) AS ancestor_id FROM fx JOIN rt ON rt.event_id = fx.event_id AND rt.id = fx.id""",
    "interaction_ids": f"""WITH RECURSIVE {TRK}, lk AS (SELECT c.event_id, c.track_id AS id, p.track_id AS up FROM trk c LEFT JOIN trk p ON p.event_id = c.event_id AND p.track_id = c.parent_track_id), {_roots('lk')}, v AS (SELECT * FROM trk WHERE parent_track_id IS NULL),
 m AS (SELECT a.event_id, a.track_id, min(b.track_id) AS i FROM trk a JOIN v b ON b.event_id = a.event_id AND {_CLOSE} GROUP BY ALL) SELECT rt.event_id, rt.id AS track_id, m.i AS interaction_id FROM rt LEFT JOIN m ON m.event_id = rt.event_id AND m.track_id = rt.root_id""",
    "genealogy_issues": f"""WITH RECURSIVE {PAR}, lk AS (SELECT c.event_id, c.id, q.id AS up FROM par c LEFT JOIN par q ON q.event_id = c.event_id AND q.id = c.parent_id), {_roots('lk')}, j AS (SELECT c.event_id, c.parent_id, c.ancestor_id, c.interaction_id, q.id AS q, q.interaction_id AS qi, rt.depth, rt.root_id FROM par c JOIN rt ON rt.event_id = c.event_id AND rt.id = c.id LEFT JOIN par q ON q.event_id = c.event_id AND q.id = c.parent_id),
 e AS (SELECT event_id, 'absent_parent' AS code FROM j WHERE parent_id IS NOT NULL AND q IS NULL UNION ALL SELECT event_id, 'wrong_ancestor' FROM j WHERE depth IS NOT NULL AND ancestor_id IS DISTINCT FROM root_id UNION ALL SELECT event_id, 'loop' FROM j WHERE depth IS NULL UNION ALL SELECT event_id, 'mixed_interaction' FROM j WHERE q IS NOT NULL AND interaction_id IS DISTINCT FROM qi)
 SELECT code, count(*) AS issues, count(DISTINCT event_id) AS events FROM e GROUP BY code""",
    "cloud_components": f"WITH RECURSIVE {PTS}, {GOOD}, {_CLOUDS.format(of='good')} SELECT event_id, particle_id, point_id, comp AS component FROM cc JOIN lab ON lab.id = cc.point_id",
    "defragmented": f"""WITH RECURSIVE {PTS}, {GOOD}, {PAR}, seen AS (SELECT g.* FROM good g JOIN par p ON p.event_id = g.event_id AND p.id = g.particle_id AND p.sem_type IN (1, 3, 4, 5)), {_CLOUDS.format(of='seen')}, sz AS (SELECT event_id, particle_id, comp, count(*) AS n, count(*) OVER (PARTITION BY event_id, particle_id) AS parts FROM cc JOIN lab ON lab.id = cc.point_id GROUP BY event_id, particle_id, comp),
 nw AS (SELECT event_id, particle_id, comp, row_number() OVER (PARTITION BY event_id ORDER BY particle_id, comp) AS no FROM sz WHERE parts > 1 AND n <= 5), tp AS (SELECT event_id, max(id) AS top FROM par GROUP BY event_id)
 SELECT g.event_id, g.particle_id, CAST(coalesce(tp.top + nw.no, g.particle_id) AS INT) AS new_id, count(*) AS points FROM good g LEFT JOIN lab ON lab.id = g.point_id LEFT JOIN nw ON nw.event_id = g.event_id AND nw.particle_id = g.particle_id AND nw.comp = lab.comp LEFT JOIN tp ON tp.event_id = g.event_id GROUP BY ALL""",
    "absorb_le": f"""WITH {NEAR}, {PAR}, c AS (SELECT t.event_id, CASE WHEN a.sem_type = 5 THEN a.id ELSE b.id END AS child, CASE WHEN a.sem_type = 5 THEN b.id ELSE a.id END AS parent, distance FROM tch t JOIN par a ON a.event_id = t.event_id AND a.id = owner_a JOIN par b ON b.event_id = t.event_id AND b.id = owner_b WHERE (coalesce(a.sem_type, 6) = 5) <> (coalesce(b.sem_type, 6) = 5)),
 k AS (SELECT c.event_id, child, arg_min(parent, (coalesce(parent <> p.parent_id, true), distance, parent)) AS took FROM c JOIN par p ON p.event_id = c.event_id AND p.id = c.child GROUP BY c.event_id, child) SELECT c.event_id, c.child, parent, CASE WHEN parent = took THEN 'MERGED' ELSE 'ALREADY_MERGED_WITH_OTHER' END AS outcome FROM c JOIN k ON k.event_id = c.event_id AND k.child = c.child""",
    "shower_instances": f"""WITH RECURSIVE {PAR}, f AS (SELECT *, coalesce(abs(pdg) IN (11, 22), false) OR coalesce(sem_type, 6) = 1 AS em, coalesce(sem_type, 6) <> 5 AS big, interaction_type IN (6, 10) AND parent_pdg = 22 AS second FROM par),
 u0 AS (SELECT c.event_id, c.id, c.em AND c.big AS able, c.second, q.pdg AS q_pdg, CASE WHEN c.em AND q.em THEN q.id END AS up FROM f c LEFT JOIN f q ON q.event_id = c.event_id AND q.id = c.parent_id), lk AS (SELECT c.event_id, c.id, c.able, CASE WHEN coalesce(c.second AND abs(c.q_pdg) = 22 AND q.up IS NULL, false) THEN NULL ELSE c.up END AS up FROM u0 c LEFT JOIN u0 q ON q.event_id = c.event_id AND q.id = c.up),
 {_roots('lk')}, t AS (SELECT event_id, id, CASE WHEN able THEN id END AS top FROM lk WHERE up IS NULL UNION ALL SELECT l.event_id, l.id, coalesce(t.top, CASE WHEN l.able THEN l.id END) FROM lk l JOIN t ON t.event_id = l.event_id AND t.id = l.up),
 rh AS (SELECT hd.event_id, root_id, arg_min(hd.id, (NOT able, hd.id)) AS head FROM hd JOIN lk ON lk.event_id = hd.event_id AND lk.id = hd.id GROUP BY ALL)
 SELECT event_id, id AS frag_id, coalesce(top, id) AS inst_id FROM t UNION ALL SELECT hd.event_id, hd.id, head FROM hd JOIN rh ON rh.event_id = hd.event_id AND rh.root_id = hd.root_id""",
}

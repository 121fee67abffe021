"""Genealogies of particles: roots, nearest marked ancestors, interactions, traces. Every walk is pointer doubling (``resolve_hierarchy``)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..store import Workspace
from .hierarchy import resolve_hierarchy
from .spatial import matched

EVENT = ("event_id",)


def loop_heads(nodes: DataFrame, node: str, parent: str, scope: Sequence[str] = EVENT) -> DataFrame:
    """For nodes that run in circles or into one: scope, ``node``, ``head``, the least id on the circle. Rounds of doubling as many as the logarithm of the most such nodes that a scope has."""
    ws = Workspace(nodes.sparkSession, "loops")
    state = ws.keep(nodes.select(*scope, F.col(node).alias("n"), F.col(parent).alias("a"), F.col(parent).alias("low")), sized=True)
    most = state.groupBy(*scope).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    if not most:
        return state.select(*scope, F.col("n").alias(node), F.col("low").alias("head"))
    for _ in range(int(most).bit_length()):
        up = state.select(*(F.col(k).alias(f"t_{k}") for k in scope), F.col("n").alias("t_n"), F.col("a").alias("t_a"), F.col("low").alias("t_low"))
        before, state = state, ws.keep(state.join(up, [*(F.col(k) == F.col(f"t_{k}") for k in scope), F.col("a") == F.col("t_n")]).select(*scope, "n", F.col("t_a").alias("a"), F.least("low", "t_low").alias("low")), sized=True)
        ws.forget(before)
    # every pointer is on its circle now, and what follows it is the whole circle
    up = state.select(*(F.col(k).alias(f"t_{k}") for k in scope), F.col("n").alias("t_n"), F.col("low").alias("head"))
    return state.join(up, [*(F.col(k) == F.col(f"t_{k}") for k in scope), F.col("a") == F.col("t_n")]).select(*scope, F.col("n").alias(node), "head")


def true_ancestors(nodes: DataFrame, node: str, parent: str, scope: Sequence[str] = EVENT, carry: Sequence[str] = ()) -> DataFrame:
    """scope, ``node``, ``parent``, carry, ``root_id``, ``depth``: the last node on the way up. Of a circle, the least id on it (depth null)."""
    ws = Workspace(nodes.sparkSession, "ancestors")
    r = ws.keep(resolve_hierarchy(nodes, node, parent, scope, path=False, carry=carry))
    heads = loop_heads(r.where("in_loop"), node, parent, scope).select(*(F.col(k).alias(f"h_{k}") for k in scope), F.col(node).alias("h_n"), "head")
    met = r.join(heads, [*(F.col(k) == F.col(f"h_{k}") for k in scope), F.col(node) == F.col("h_n")], "left")
    return met.select(*scope, node, parent, *carry, F.coalesce("root_id", "head").alias("root_id"), "depth")


def nearest_marked(nodes: DataFrame, node: str, parent: str, marked: str, scope: Sequence[str] = EVENT, own: bool = False) -> DataFrame:
    """scope, ``node``, ``nearest``: the first marked node on the way up, from the parent on (``own``: from the node itself on); null where there is none.

    A marked node ends the walk, so it is a root of the forest cut at the marks: one resolution serves any stop predicate.
    """
    ws = Workspace(nodes.sparkSession, "marked")
    base = ws.keep(nodes.select(*scope, F.col(node).alias("n"), F.when(F.col(parent) != F.col(node), F.col(parent)).alias("p"), F.coalesce(F.col(marked), F.lit(False)).alias("m")))
    cut = resolve_hierarchy(base.select(*scope, "n", F.when(~F.col("m"), F.col("p")).alias("q")), "n", "q", scope, path=False).select(*(F.col(k).alias(f"c_{k}") for k in scope), F.col("n").alias("c_n"), "root_id")
    marks = base.where("m").select(*(F.col(k).alias(f"m_{k}") for k in scope), F.col("n").alias("m_n"))
    stop = cut.join(marks, [*(F.col(f"c_{k}") == F.col(f"m_{k}") for k in scope), F.col("root_id") == F.col("m_n")]).select(*(F.col(f"c_{k}") for k in scope), "c_n", F.col("root_id").alias("nearest"))
    return base.join(stop, [*(F.col(k) == F.col(f"c_{k}") for k in scope), F.col("n" if own else "p") == F.col("c_n")], "left").select(*scope, F.col("n").alias(node), "nearest")


def resolve_orphans(particles: DataFrame, node: str = "id", parent: str = "parent_id", ancestor: str = "ancestor_id", scope: Sequence[str] = EVENT) -> DataFrame:
    """scope, ``node``, ``parent``, ``ancestor``: an absent parent becomes the particle itself, then an absent ancestor the root of the repaired chain."""
    ws = Workspace(particles.sparkSession, "orphans")
    base = ws.keep(particles.select(*scope, F.col(node).alias("n"), F.col(parent).alias("p"), F.col(ancestor).alias("a")))
    ids = base.select(*(F.col(k).alias(f"i_{k}") for k in scope), F.col("n").alias("i_n"))
    known = lambda df, c: df.join(ids.select(*(F.col(f"i_{k}").alias(f"{c}_{k}") for k in scope), F.col("i_n").alias(f"has_{c}")), [*(F.col(k) == F.col(f"{c}_{k}") for k in scope), F.col(c) == F.col(f"has_{c}")], "left").drop(*(f"{c}_{k}" for k in scope))
    fixed = ws.keep(known(known(base, "p"), "a").select(*scope, "n", F.coalesce("has_p", "n").alias("p"), F.col("has_a").alias("a")))
    root = true_ancestors(fixed, "n", "p", scope).select(*(F.col(k).alias(f"r_{k}") for k in scope), F.col("n").alias("r_n"), "root_id")
    out = fixed.join(root, [*(F.col(k) == F.col(f"r_{k}") for k in scope), F.col("n") == F.col("r_n")])
    return out.select(*scope, F.col("n").alias(node), F.col("p").alias(parent), F.coalesce("a", "root_id").alias(ancestor))


def parent_values(nodes: DataFrame, node: str, parent: str, values: Sequence[str], scope: Sequence[str] = EVENT) -> DataFrame:
    """``nodes`` with the parent's ``values`` as parent_<name>, null where the parent is absent."""
    up = nodes.select(*(F.col(k).alias(f"u_{k}") for k in scope), F.col(node).alias("u_n"), *(F.col(v).alias(f"u_v_{v}") for v in values))
    met = nodes.join(up, [*(F.col(k) == F.col(f"u_{k}") for k in scope), F.col(parent) == F.col("u_n")], "left")
    return met.select(*nodes.columns, *(F.col(f"u_v_{v}").alias(f"parent_{v}") for v in values))


def interactions(nodes: DataFrame, vertices: DataFrame, node: str, parent: str, scope: Sequence[str] = EVENT) -> DataFrame:
    """scope, ``node``, ``interaction_id``: that of the first vertex at the start (x, y, z, t) of the node's root, for the whole tree; null where the root starts at none.

    Only roots are matched: a node further down that happens to start at a vertex changes nothing, as the walked root, and not a stored one, is what counts. Of a circle the least id is the root.
    """
    ws = Workspace(nodes.sparkSession, "interactions")
    base = nodes.select(*scope, F.col(node).alias("n"), F.col(parent).alias("p"), "x", "y", "z", "t")
    root = ws.keep(true_ancestors(base, "n", "p", scope, carry=["x", "y", "z", "t"]))
    tops = root.where("n = root_id").select(*(F.col(k).alias(f"o_{k}") for k in scope), F.col("n").alias("o_n"), "x", "y", "z", "t")
    at = matched(tops, vertices.select(*(F.col(k).alias(f"o_{k}") for k in scope), "vertex_row", "interaction_id", "x", "y", "z", "t"), [f"o_{k}" for k in scope], [(c, c) for c in "xyzt"], "vertex_row")
    own = at.select(*(f"o_{k}" for k in scope), "o_n", F.col("r_interaction_id").alias("interaction_id"))
    return root.join(own, [*(F.col(k) == F.col(f"o_{k}") for k in scope), F.col("root_id") == F.col("o_n")], "left").select(*scope, F.col("n").alias(node), "interaction_id")


def children(nodes: DataFrame, chosen: DataFrame, node: str, parent: str, scope: Sequence[str] = EVENT) -> DataFrame:
    """scope, ``node``, ``child``: the direct children of the chosen (scope, ``node``)."""
    c = chosen.select(*(F.col(k).alias(f"c_{k}") for k in scope), F.col(node).alias("c_n")).distinct()
    kids = nodes.where(F.col(parent) != F.col(node)).join(c, [*(F.col(k) == F.col(f"c_{k}") for k in scope), F.col(parent) == F.col("c_n")], "left_semi")
    return kids.select(*scope, F.col(parent).alias(node), F.col(node).alias("child"))


def trace(resolved: DataFrame, which: Column) -> DataFrame:
    """The chains, root first, of the chosen nodes of a resolved hierarchy: one row per step, with ``step`` from 0."""
    return resolved.where(which).select("*", F.posexplode("path").alias("step", "step_id"))


def traceable_instances(instances: DataFrame, instance: str = "inst_id", parent: str = "parent_inst", visible: str = "visible", interaction: str = "interaction_id", scope: Sequence[str] = EVENT) -> DataFrame:
    """scope, ``instance``: visible ones, all ancestors of visible ones, and parentless ones of interactions with a visible one."""
    ws = Workspace(instances.sparkSession, "traceable")
    r = ws.keep(resolve_hierarchy(instances, instance, parent, scope, path=True, carry=[visible, interaction]))
    seen = r.where(visible)
    lit = seen.select(*(F.col(k).alias(f"l_{k}") for k in scope), F.col(interaction).alias("l_i")).distinct()
    tops = r.where("depth = 0").join(lit, [*(F.col(k) == F.col(f"l_{k}") for k in scope), F.col(interaction) == F.col("l_i")], "left_semi").select(*scope, instance)
    return with_ancestors(r, seen.select(*scope, instance), instance, parent, scope).unionByName(tops).distinct()


def with_ancestors(resolved: DataFrame, seeds: DataFrame, node: str, parent: str, scope: Sequence[str] = EVENT) -> DataFrame:
    """scope, ``node``, distinct: the seeds and all their ancestors. In and below circles, which have no path, the links are followed one by one until nothing is new.

    :param resolved: as ``resolve_hierarchy`` gives it, with paths
    """
    ws = Workspace(resolved.sparkSession, "ancestors")
    chosen = seeds.select(*(F.col(k).alias(f"s_{k}") for k in scope), F.col(node).alias("s_n")).distinct()
    at = ws.keep(resolved.join(chosen, [*(F.col(k) == F.col(f"s_{k}") for k in scope), F.col(node) == F.col("s_n")], "left_semi").select(*scope, node, "path", "in_loop"))
    up = at.where("path is not null").select(*scope, F.explode("path").alias(node))
    rings = ws.keep(resolved.where("in_loop").select(*(F.col(k).alias(f"c_{k}") for k in scope), F.col(node).alias("c_n"), F.col(parent).alias("c_p")))
    path, n = ws.count(at.where("in_loop").select(*scope, node))
    schema = at.select(*scope, node).schema
    found = [path]
    while n["rows"]:
        last = resolved.sparkSession.read.schema(schema).parquet(found[-1])
        had = resolved.sparkSession.read.schema(schema).parquet(*found).select(*(F.col(k).alias(f"h_{k}") for k in scope), F.col(node).alias("h_n"))
        named = last.join(rings, [*(F.col(k) == F.col(f"c_{k}") for k in scope), F.col(node) == F.col("c_n")]).select(*scope, F.col("c_p").alias(node)).distinct()
        path, n = ws.count(named.join(had, [*(F.col(k) == F.col(f"h_{k}") for k in scope), F.col(node) == F.col("h_n")], "left_anti"))
        found.append(path)
    return up.unionByName(resolved.sparkSession.read.schema(schema).parquet(*found)).distinct()


def genealogy_issues(particles: DataFrame, node: str = "id", parent: str = "parent_id", ancestor: str = "ancestor_id", interaction: str = "interaction_id", scope: Sequence[str] = EVENT) -> DataFrame:
    """Findings as rows: scope, ``node``, ``code``: absent_parent, wrong_ancestor, loop, mixed_interaction (the parent has another interaction)."""
    ws = Workspace(particles.sparkSession, "issues")
    base = ws.keep(particles.select(*scope, F.col(node).alias("n"), F.col(parent).alias("p"), F.col(ancestor).alias("a"), F.col(interaction).alias("i")))
    r = ws.keep(resolve_hierarchy(base, "n", "p", scope, path=False, carry=["a", "i"]))
    up = r.select(*(F.col(k).alias(f"u_{k}") for k in scope), F.col("n").alias("u_n"), F.col("i").alias("u_i"))
    met = r.join(up, [*(F.col(k) == F.col(f"u_{k}") for k in scope), F.col("p") == F.col("u_n")], "left")
    codes = F.array_compact(F.array(
        F.when(F.col("p").isNotNull() & F.col("u_n").isNull(), F.lit("absent_parent")), F.when(~F.col("in_loop") & ~F.col("a").eqNullSafe(F.col("root_id")), F.lit("wrong_ancestor")),
        F.when(F.col("in_loop"), F.lit("loop")), F.when(F.col("u_n").isNotNull() & ~F.col("i").eqNullSafe(F.col("u_i")), F.lit("mixed_interaction")),
    ))
    return met.select(*scope, F.col("n").alias(node), F.explode(codes).alias("code"))


def issue_chains(issues: DataFrame, particles: DataFrame, node: str = "id", parent: str = "parent_id", scope: Sequence[str] = EVENT, most: int = 12) -> DataFrame:
    """The issues with ``chain``: the ids from the node up to its root, joined by arrows, at most ``most`` of them (then an ellipsis); of a circle the node's own id and its parent's."""
    r = resolve_hierarchy(particles, node, parent, scope, path=True).select(*(F.col(k).alias(f"r_{k}") for k in scope), F.col(node).alias("r_n"), F.col(parent).alias("r_p"), "path")
    met = issues.join(r, [*(F.col(k) == F.col(f"r_{k}") for k in scope), F.col(node) == F.col("r_n")], "left")
    up = F.coalesce(F.reverse("path"), F.array_compact(F.array("r_n", "r_p")))
    more = (F.size("path") > most) | F.col("path").isNull()
    return met.select(*issues.columns, F.concat(F.array_join(F.slice(up, 1, most).cast("array<string>"), " <- "), F.when(more, " <- ...").otherwise("")).alias("chain"))


def refused(issues: DataFrame, code: str = "code") -> DataFrame:
    """The issues, as an error: a plan that reads this fails where there is any, with its code and row."""
    bad = F.raise_error(F.concat(F.lit("genealogy is broken: "), F.to_json(F.struct(*issues.columns)))).cast("boolean")
    return issues.where(F.coalesce(bad, F.lit(True)))


def primaries(tracks: DataFrame, table: DataFrame | None = None, scope: Sequence[str] = EVENT) -> tuple[DataFrame, DataFrame]:
    """Tracks with ``is_primary`` (listed in the table, or without one: parent -1), and the mismatches as rows: scope, ``track_id``, ``code``."""
    alone = F.coalesce(F.col("parent_track_id"), F.lit(-1)) == -1
    if table is None:
        return tracks.withColumn("is_primary", alone), tracks.limit(0).select(*scope, "track_id", F.lit("").alias("code"))
    listed = table.select(*(F.col(k).alias(f"l_{k}") for k in scope), F.col("track_id").alias("l_id")).distinct()
    on = [*(F.col(k) == F.col(f"l_{k}") for k in scope), F.col("track_id") == F.col("l_id")]
    out = tracks.join(listed, on, "left").withColumn("is_primary", F.col("l_id").isNotNull()).drop("l_id", *(f"l_{k}" for k in scope))
    wrong = out.where(alone & ~F.col("is_primary")).select(*scope, "track_id", F.lit("parentless_not_primary").alias("code")).unionByName(out.where(~alone & F.col("is_primary")).select(*scope, "track_id", F.lit("primary_with_parent").alias("code")))
    missing = listed.join(tracks.select(*scope, "track_id"), on, "left_anti").select(*(F.col(f"l_{k}").alias(k) for k in scope), F.col("l_id").alias("track_id"), F.lit("primary_not_in_particles").alias("code"))
    return out, wrong.unionByName(missing)

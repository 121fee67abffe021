"""Particles into fragments and fragments into instances.

Fragments: a fixpoint of merge rules. The state is one table (event, particle, rep): the surviving representative of each particle's partition. A rule proposes pairs
(child rep, parent rep) from metadata, those that must touch are tested on the points of whole partitions by the cell-hash join, a rule may choose among
a child's parents, and the accepted pairs collapse to components with the top of each chain as representative. Points never move; membership is
a join. Passes repeat until no rule merges anything.

A rule is a function (state, particles, points, params) -> pairs, so users can add their own; a column ``outcome`` tells which pairs were merged and why others
that it tried were not (without it all are merged).
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..enums import INTERACTION, SEMANTIC
from ..params import Params
from ..store import Workspace
from .components import connected_components
from .genealogy import nearest_marked
from .hierarchy import resolve_hierarchy
from .points import cells
from .skew import running
from .spatial import standoff, touching

LE = SEMANTIC["le_scatter"]
#: Outcomes of a pair that a rule tried, by the names that decisions go by. Fixed values.
MERGED, APART, TAKEN = "MERGED", "NOT_TOUCHING", "ALREADY_MERGED_WITH_OTHER"
Rule = Callable[[DataFrame, DataFrame, DataFrame, Params], DataFrame]


# ---- splitting clouds


def cloud_components(points: DataFrame, eps: float, point: str = "point_id", owner: Sequence[str] = ("event_id", "particle_id")) -> DataFrame:
    """owner, ``point``, ``component`` (its least point id): points within ``eps`` of each other, directly or in chains; a lone point is its own component.

    Points of one small cell, of which no two are more than ``eps`` apart, are one node, named by its least point; near points of different cells are folded to links of cells in the task that finds them, so a dense cloud
    has no more links than pairs of neighbouring cells. Points with a null or NaN coordinate are lone.
    """
    ws = Workspace(points.sparkSession, "clouds")
    own = [f"o{i}" for i in range(len(owner))]
    side = eps / 3**0.5 * (1 - 1e-9)
    p = points.select(*(F.col(k).alias(x) for k, x in zip(owner, own)), F.col(point).alias("id"), "x", "y", "z", *(F.floor(F.col(a).cast("double") / side).alias(f"g{a}") for a in "xyz"))
    good = p.where(" and ".join(f"abs({a}) < double('infinity')" for a in "xyz"))
    held = good.groupBy(*(F.col(k).alias(f"h{k}") for k in (*own, "gx", "gy", "gz"))).agg(F.min("id").alias("node"))
    named = ws.keep(good.join(held, [F.col(k) == F.col(f"h{k}") for k in (*own, "gx", "gy", "gz")]).select(*own, "id", "node", "x", "y", "z"))
    links = touching(named, eps, "id", "node", own)
    linked = connected_components(links, "owner_a", "owner_b", (), "n", "component")
    cells_ = named.select("id", "node").distinct().join(linked, F.col("node") == F.col("n"), "left").select(F.col("id").alias("c_id"), F.coalesce("component", "node").alias("component"))
    return points.select(*owner, point).distinct().join(cells_, F.col(point) == F.col("c_id"), "left").select(*owner, point, F.coalesce("component", point).alias("component"))


def defragment(points: DataFrame, particles: DataFrame, params: Params, point: str = "point_id", event: str = "event_id") -> tuple[DataFrame, DataFrame]:
    """Small pieces of a cloud become low-energy particles of their own.

    Of particles of the examined sem_types whose cloud falls into several components, each of at most ``min_pc_size`` points is split off. New ids continue after the event's greatest, in
    the order of (particle, component). Returns (event, particle_id, ``point``, ``new_id``) of all points, and the pieces: event, ``new_id``, ``particle_id`` (their parent), ``points``.
    An emptied original keeps its row, as particles are not touched here.
    """
    ws = Workspace(points.sparkSession, "defragment")
    which = particles.where(F.col("sem_type").isin(*params.defragment_sem_types)).select(F.col(event).alias("w_e"), F.col("id").alias("w_id"))
    seen = points.join(which, (F.col(event) == F.col("w_e")) & (F.col("particle_id") == F.col("w_id")), "left_semi")
    parts = ws.keep(cloud_components(seen, params.distance_threshold, point, (event, "particle_id")))
    sizes = parts.groupBy(event, "particle_id", "component").agg(F.count(F.lit(1)).alias("n"))
    split = sizes.groupBy(event, "particle_id").agg(F.count(F.lit(1)).alias("parts")).where("parts > 1").select(F.col(event).alias("s_e"), F.col("particle_id").alias("s_p"))
    small = sizes.where(F.col("n") <= params.min_pc_size).join(split, (F.col(event) == F.col("s_e")) & (F.col("particle_id") == F.col("s_p")), "left_semi")
    top = particles.groupBy(F.col(event).alias("t_e")).agg(F.max("id").alias("top"))
    numbered = running(small, (event,), ["particle_id", "component"], {"no": F.lit(1)}).join(top, F.col(event) == F.col("t_e"))
    pieces = ws.keep(numbered.select(event, (F.col("top") + F.col("no")).cast("int").alias("new_id"), "particle_id", "component", F.col("n").alias("points")))
    to = pieces.select(F.col(event).alias("n_e"), F.col("particle_id").alias("n_p"), F.col("component").alias("n_c"), "new_id")
    all_ = points.select(event, "particle_id", point).join(parts.select(F.col(point).alias("c_p"), "component"), F.col(point) == F.col("c_p"), "left")
    moved = all_.join(to, (F.col(event) == F.col("n_e")) & (F.col("particle_id") == F.col("n_p")) & (F.col("component") == F.col("n_c")), "left")
    return moved.select(event, "particle_id", point, F.coalesce("new_id", "particle_id").alias("new_id")), pieces.select(event, "new_id", "particle_id", "points")


# ---- the merge fixpoint


def _reps(state: DataFrame, particles: DataFrame) -> DataFrame:
    """Representatives with their scalars."""
    return particles.join(state.where("particle_id = rep_id").select(F.col("event_id").alias("p_e"), F.col("rep_id").alias("p_id")), (F.col("event_id") == F.col("p_e")) & (F.col("id") == F.col("p_id")), "left_semi")


def _with_rep(rows: DataFrame, by: str, state: DataFrame, name: str) -> DataFrame:
    s = state.select(F.col("event_id").alias(f"{name}_e"), F.col("particle_id").alias(f"{name}_p"), F.col("rep_id").alias(name))
    return rows.join(s, (F.col("event_id") == F.col(f"{name}_e")) & (F.col(by) == F.col(f"{name}_p"))).drop(f"{name}_e", f"{name}_p")


def _sem(rows: DataFrame, by: str, particles: DataFrame, name: str, columns: Sequence[str] = ("sem_type",)) -> DataFrame:
    s = particles.select(F.col("event_id").alias(f"{name}_e"), F.col("id").alias(f"{name}_i"), *(F.col(c).alias(f"{name}_{c}") for c in columns))
    return rows.join(s, (F.col("event_id") == F.col(f"{name}_e")) & (F.col(by) == F.col(f"{name}_i"))).drop(f"{name}_e", f"{name}_i")


def touching_pairs(pairs: DataFrame, state: DataFrame, points: DataFrame, distance: float) -> DataFrame:
    """Those of the pairs (event, child, parent) whose partitions' points come within the distance, with it. Only points of named partitions whose boxes overlap after widening take part."""
    ends = pairs.select("event_id", F.explode(F.array("child", "parent")).alias("n_r")).distinct().select(F.col("event_id").alias("n_e"), "n_r")
    owned = _with_rep(points.select("event_id", "particle_id", "point_id", "x", "y", "z"), "particle_id", state, "rep_id").join(ends, (F.col("event_id") == F.col("n_e")) & (F.col("rep_id") == F.col("n_r")), "left_semi")
    near = touching(owned, distance, "point_id", "rep_id", ("event_id",)).select(F.col("event_id").alias("t_e"), "owner_a", "owner_b", "distance")
    return pairs.join(near, (F.col("event_id") == F.col("t_e")) & (F.least("child", "parent") == F.col("owner_a")) & (F.greatest("child", "parent") == F.col("owner_b"))).select("event_id", "child", "parent", "distance")


def _photon_kids(particles: DataFrame) -> DataFrame:
    """event_id, ``a``, ``b``, ``pair``: children a of photons b that are converting electrons (``pair``), or photons with b's own track id."""
    photons = particles.where("pdg = 22").select(F.col("event_id").alias("g_e"), F.col("id").alias("g_id"), F.col("geant4_trackid").alias("g_t"))
    kids = particles.join(photons, (F.col("event_id") == F.col("g_e")) & (F.col("parent_id") == F.col("g_id")) & (F.col("id") != F.col("g_id")))
    pair = (F.abs("pdg") == 11) & (F.col("interaction_type") == INTERACTION["conversion"]) & (F.col("parent_pdg") == 22)
    same = (F.col("pdg") == 22) & (F.col("geant4_trackid") == F.col("g_t"))
    return kids.where(pair | same).select("event_id", F.col("id").alias("a"), F.col("g_id").alias("b"), pair.alias("pair"))


def photon_decay(state: DataFrame, particles: DataFrame, points: DataFrame, params: Params) -> DataFrame:
    """A photon's converting electrons, and photons with its own track id, join it. No contact is asked for."""
    c = _photon_kids(particles)
    return _with_rep(_with_rep(c, "a", state, "child"), "b", state, "parent").where("child <> parent").select("event_id", "child", "parent").distinct()


def converted(state: DataFrame, particles: DataFrame) -> DataFrame:
    """event_id, ``id``, ``sem_type``: low-energy representatives that hold a photon with a converting electron become showers. Pieces of a photon alone promote nothing."""
    held = _with_rep(_photon_kids(particles).where("pair"), "b", state, "held").select(F.col("event_id").alias("c_e"), "held")
    shower = F.lit(SEMANTIC["shower"]).cast(particles.schema["sem_type"].dataType)
    return particles.where(F.col("sem_type") == LE).join(held, (F.col("event_id") == F.col("c_e")) & (F.col("id") == F.col("held")), "left_semi").select("event_id", "id", shower.alias("sem_type"))


def touching_em(state: DataFrame, particles: DataFrame, points: DataFrame, params: Params) -> DataFrame:
    """A representative with pdg 11 or 22 joins the touching partition of its parent, likewise 11 or 22, of the same ancestor; neither low-energy."""
    r = _reps(state, particles).where(F.col("pdg").isin(11, 22) & (F.col("sem_type") != LE) & (F.col("parent_id") != F.col("id"))).select("event_id", F.col("id").alias("child"), "parent_id", "ancestor_id")
    c = _sem(_with_rep(r, "parent_id", state, "parent"), "parent", particles, "q", ("pdg", "sem_type", "ancestor_id")).where(F.col("q_pdg").isin(11, 22) & (F.col("q_sem_type") != LE) & (F.col("q_ancestor_id") == F.col("ancestor_id")) & (F.col("child") != F.col("parent")))
    tried = Workspace(points.sparkSession, "showers").keep(c.select("event_id", "child", "parent").distinct())
    met = touching_pairs(tried, state, points, params.distance_threshold).select(F.col("event_id").alias("m_e"), F.col("child").alias("m_c"), F.col("parent").alias("m_p"))
    return tried.join(met, (F.col("event_id") == F.col("m_e")) & (F.col("child") == F.col("m_c")) & (F.col("parent") == F.col("m_p")), "left").select("event_id", "child", "parent", F.when(F.col("m_c").isNotNull(), MERGED).otherwise(APART).alias("outcome"))


def _le_contacts(state: DataFrame, particles: DataFrame, points: DataFrame, distance: float, both: bool) -> DataFrame:
    """Touching partitions (a < b) of which at least one (``both``: each) is low-energy, with their sem_types. Only low-energy points, and others in cells that those reach, are compared."""
    ws = Workspace(points.sparkSession, "contacts")
    owned = _sem(_with_rep(points.select("event_id", "particle_id", "point_id", "x", "y", "z"), "particle_id", state, "rep_id"), "rep_id", particles, "r").select("event_id", "rep_id", "point_id", "x", "y", "z", (F.col("r_sem_type") == LE).alias("le"))
    if both:
        rows = owned.where("le")
    else:
        owned = ws.keep(owned)
        wide = 4 * distance
        reached = owned.where("le").where(" and ".join(f"abs({a}) < double('infinity')" for a in "xyz")).select(F.col("event_id").alias("c_e"), "x", "y", "z")
        for a in "xyz":
            v = F.col(a).cast("double")
            reached = reached.withColumn(f"c_{a}", F.explode(F.sequence(F.floor((v - distance * (1 + 1e-9)) / wide), F.floor((v + distance * (1 + 1e-9)) / wide))))
        reached = reached.select("c_e", "c_x", "c_y", "c_z").distinct()
        rows = owned.where("le").unionByName(owned.where("not le").join(reached, [F.col("event_id") == F.col("c_e"), *(F.floor(F.col(a).cast("double") / wide) == F.col(f"c_{a}") for a in "xyz")], "left_semi"))
    near = touching(rows, distance, "point_id", "rep_id", ("event_id",))
    return _sem(_sem(near, "owner_a", particles, "a"), "owner_b", particles, "b").where((F.col("a_sem_type") == LE) | (F.col("b_sem_type") == LE))


def combine_le(state: DataFrame, particles: DataFrame, points: DataFrame, params: Params) -> DataFrame:
    """Touching low-energy partitions merge; the one with more points, then of lower id, survives."""
    both = _le_contacts(state, particles, points, params.distance_threshold, True)
    n = _with_rep(points.select("event_id", "particle_id"), "particle_id", state, "r").groupBy("event_id", "r").agg(F.count(F.lit(1)).alias("n"))
    size = lambda by, name: n.select(F.col("event_id").alias(f"{name}_e"), F.col("r").alias(f"{name}_r"), F.col("n").alias(name))
    c = both.join(size("owner_a", "na"), (F.col("event_id") == F.col("na_e")) & (F.col("owner_a") == F.col("na_r"))).join(size("owner_b", "nb"), (F.col("event_id") == F.col("nb_e")) & (F.col("owner_b") == F.col("nb_r")))
    a_lives = F.col("na") >= F.col("nb")
    return c.select("event_id", F.when(a_lives, F.col("owner_b")).otherwise(F.col("owner_a")).alias("child"), F.when(a_lives, F.col("owner_a")).otherwise(F.col("owner_b")).alias("parent"))


def absorb_le(state: DataFrame, particles: DataFrame, points: DataFrame, params: Params) -> DataFrame:
    """Each low-energy partition joins one touching other partition: that of its nearest ancestor outside itself if among them, else the nearest (then of lower id)."""
    ws = Workspace(points.sparkSession, "absorb")
    le_a = F.col("a_sem_type") == LE
    c = ws.keep(_le_contacts(state, particles, points, params.distance_threshold, False).where(F.col("a_sem_type") != F.col("b_sem_type")).select("event_id", F.when(le_a, F.col("owner_a")).otherwise(F.col("owner_b")).alias("child"), F.when(le_a, F.col("owner_b")).otherwise(F.col("owner_a")).alias("parent"), "distance"))
    home = homes(state, particles, c.select("event_id", "child").distinct()).select(F.col("event_id").alias("h_e"), F.col("child").alias("h_c"), "home")
    met = c.join(home, (F.col("event_id") == F.col("h_e")) & (F.col("child") == F.col("h_c")), "left")
    took = met.groupBy(F.col("event_id").alias("k_e"), F.col("child").alias("k_c")).agg(F.min(F.struct((~F.coalesce(F.col("parent") == F.col("home"), F.lit(False))).alias("other"), "distance", "parent"))["parent"].alias("took"))
    return c.join(took, (F.col("event_id") == F.col("k_e")) & (F.col("child") == F.col("k_c"))).select("event_id", "child", "parent", F.when(F.col("parent") == F.col("took"), MERGED).otherwise(TAKEN).alias("outcome"))


def homes(state: DataFrame, particles: DataFrame, reps: DataFrame) -> DataFrame:
    """event, ``child``, ``home``: the partition of the nearest ancestor of a representative that lies outside the representative's own partition."""
    mine = _with_rep(particles.select("event_id", "id", "parent_id"), "id", state, "own")
    up = mine.select(F.col("event_id").alias("u_e"), F.col("id").alias("u_id"), F.col("own").alias("u_own"))
    linked = mine.join(up, (F.col("event_id") == F.col("u_e")) & (F.col("parent_id") == F.col("u_id")), "left")
    # the last member of the own partition on the way up is marked where its parent lies outside
    leaves = linked.select("event_id", "id", "parent_id", "own", F.col("u_own"), (F.col("u_own") != F.col("own")).alias("leaves"))
    stop = nearest_marked(leaves, "id", "parent_id", "leaves", own=True).select(F.col("event_id").alias("s_e"), F.col("id").alias("s_id"), "nearest")
    at = leaves.select(F.col("event_id").alias("l_e"), F.col("id").alias("l_id"), F.col("u_own").alias("home"))
    met = reps.join(stop, (F.col("event_id") == F.col("s_e")) & (F.col("child") == F.col("s_id"))).join(at, (F.col("event_id") == F.col("l_e")) & (F.col("nearest") == F.col("l_id")))
    return met.select("event_id", "child", "home")


RULES: dict[str, Rule] = {"photon_decay": photon_decay, "combine_le": combine_le, "absorb_le": absorb_le, "touching_em": touching_em}
#: Rules that change the sem_type of representatives as well: what they change, before any of the rule's pairs is merged.
PROMOTIONS: dict[Rule, Callable[[DataFrame, DataFrame], DataFrame]] = {photon_decay: converted}


def collapse(state: DataFrame, pairs: DataFrame) -> DataFrame:
    """The state after merging pairs (event, child, parent): each component keeps one representative, a member that is nobody's child; of several, or on a circle, the one of lowest id."""
    parts = connected_components(pairs, "child", "parent", ("event_id",), "rep", "part")
    kids = pairs.select(F.col("event_id").alias("k_e"), F.col("child").alias("k_c")).distinct()
    tops = parts.join(kids, (F.col("event_id") == F.col("k_e")) & (F.col("rep") == F.col("k_c")), "left").groupBy("event_id", "part").agg(F.min(F.struct(F.col("k_c").isNotNull().alias("below"), "rep")).alias("t"))
    new = parts.join(tops.select(F.col("event_id").alias("t_e"), F.col("part").alias("t_p"), F.col("t.rep").alias("top")), (F.col("event_id") == F.col("t_e")) & (F.col("part") == F.col("t_p"))).select(F.col("event_id").alias("n_e"), F.col("rep").alias("n_r"), "top")
    return state.join(new, (F.col("event_id") == F.col("n_e")) & (F.col("rep_id") == F.col("n_r")), "left").select("event_id", "particle_id", F.coalesce("top", "rep_id").alias("rep_id"))


class Fragments(NamedTuple):
    """What ``merge_fixpoint`` gives."""

    state: DataFrame
    decisions: DataFrame
    passes: int
    converged: bool


def merge_fixpoint(particles: DataFrame, points: DataFrame, params: Params, rules: dict[str, Rule] | None = None) -> Fragments:
    """Fragments. ``state``: (event_id, particle_id, rep_id, sem_type) of every particle; ``decisions``: event_id, child, parent, rule, pass_no, ``outcome`` of every pair of partitions that a rule tried;
    ``converged``: the last pass merged nothing (false: ``max_passes`` ended it while pairs were still merging).

    :param particles: event_id, id, parent_id, ancestor_id, pdg, parent_pdg, geant4_trackid, interaction_type, sem_type; one row each
    :param points: event_id, particle_id, point_id, x, y, z

    Each rule sees what earlier rules of the pass merged; the size of a partition counts all its points. Particles without points take part in rules that need no contact.
    sem_type is that of the representative, which photon_decay may make a shower (``converted``); later rules see it in ``particles``.
    """
    spark = particles.sparkSession
    ws = Workspace(spark, "merge")
    particles, points = ws.keep(particles), ws.keep(points)
    state = ws.keep(particles.select("event_id", F.col("id").alias("particle_id"), F.col("id").alias("rep_id")))
    known = RULES | (rules or {})
    tried: list[DataFrame] = []
    n, merged = 0, 1
    while n < params.max_passes and merged:
        n, merged = n + 1, 0
        for name in params.rules:
            if known[name] in PROMOTIONS:
                raised = PROMOTIONS[known[name]](state, particles)
                at, some = ws.count(raised, sized=True)
                if some["rows"]:
                    r = spark.read.schema(raised.schema).parquet(at).select(F.col("event_id").alias("r_e"), F.col("id").alias("r_i"), F.col("sem_type").alias("r_sem"))
                    before, particles = particles, ws.keep(particles.join(r, (F.col("event_id") == F.col("r_e")) & (F.col("id") == F.col("r_i")), "left").withColumn("sem_type", F.coalesce("r_sem", "sem_type")).drop("r_e", "r_i", "r_sem"))
                    ws.forget(before)
            proposed = known[name](state, particles, points, params)
            if "outcome" not in proposed.columns:
                proposed = proposed.withColumn("outcome", F.lit(MERGED))
            proposed = proposed.select("event_id", "child", "parent", "outcome").distinct()
            at, some = ws.count(proposed, merged=F.col("outcome") == MERGED)
            pairs = spark.read.schema(proposed.schema).parquet(at)
            if some["rows"]:
                tried.append(pairs.select("event_id", "child", "parent", F.lit(name).alias("rule"), F.lit(n).alias("pass_no"), "outcome"))
            if some["merged"]:
                before, state = state, ws.keep(collapse(state, pairs.where(F.col("outcome") == MERGED)))
                ws.forget(before)
                merged += some["merged"]
    decisions = reduce(DataFrame.unionByName, tried) if tried else state.limit(0).select("event_id", F.col("particle_id").alias("child"), F.col("rep_id").alias("parent"), F.lit("").alias("rule"), F.lit(0).alias("pass_no"), F.lit("").alias("outcome"))
    return Fragments(_sem(state, "rep_id", particles, "rep").withColumnRenamed("rep_sem_type", "sem_type"), decisions, n, not merged)


def partition_once(candidates: DataFrame, points: DataFrame, distance: float) -> tuple[DataFrame, DataFrame]:
    """One pass over particles, without representatives: groups of candidate pairs (event_id, child, parent) whose own clouds touch (event_id, ``particle_id``, ``group_id``), and the pairs with their ``outcome``."""
    ws = Workspace(points.sparkSession, "once")
    tried = ws.keep(candidates.where("child <> parent").select("event_id", "child", "parent").distinct())
    alone = tried.select("event_id", F.explode(F.array("child", "parent")).alias("particle_id")).distinct().withColumn("rep_id", F.col("particle_id"))
    met = ws.keep(touching_pairs(tried, alone, points, distance).select("event_id", "child", "parent"))
    had = met.select(F.col("event_id").alias("m_e"), F.col("child").alias("m_c"), F.col("parent").alias("m_p"))
    told = tried.join(had, (F.col("event_id") == F.col("m_e")) & (F.col("child") == F.col("m_c")) & (F.col("parent") == F.col("m_p")), "left").select("event_id", "child", "parent", F.when(F.col("m_c").isNotNull(), MERGED).otherwise(APART).alias("outcome"))
    return connected_components(met, "child", "parent", ("event_id",), "particle_id", "group_id"), told


def partition_custom(particles: DataFrame, predicate: Callable[[Column, Column], Column], scope: Sequence[str] = ("event_id",), columns: Sequence[str] = ()) -> DataFrame:
    """Groups of particles of one scope linked by any predicate on two rows: scope, ``particle_id``, ``group_id``. As many comparisons as there are pairs in a scope: for small scopes only."""
    a = particles.select(*scope, F.col("id").alias("a_id"), F.struct(*particles.columns).alias("a"))
    b = particles.select(*(F.col(k).alias(f"b_{k}") for k in scope), F.col("id").alias("b_id"), F.struct(*particles.columns).alias("b"))
    pairs = a.join(b, [*(F.col(k) == F.col(f"b_{k}") for k in scope), F.col("a_id") < F.col("b_id"), predicate(F.col("a"), F.col("b"))])
    groups = connected_components(pairs, "a_id", "b_id", scope, "g_id", "group_id")
    return particles.select(*scope, "id").join(groups.select(*(F.col(k).alias(f"g_{k}") for k in scope), F.col("g_id"), "group_id"), [*(F.col(k) == F.col(f"g_{k}") for k in scope), F.col("id") == F.col("g_id")], "left").select(*scope, F.col("id").alias("particle_id"), F.coalesce("group_id", "id").alias("group_id"))


# ---- instances


def merge_showers(fragments: DataFrame, members: DataFrame) -> DataFrame:
    """Instances: event_id, ``frag_id``, ``inst_id``, by genealogy alone.

    :param fragments: event_id, id, parent_id, pdg, parent_pdg, sem_type, interaction_type of each fragment's representative
    :param members: event_id, particle_id, rep_id

    An electron, photon or shower fragment climbs to the fragment that holds its parent while that is one too; a Compton or photoelectron of a photon that does not climb itself stays. The
    highest fragment on the way that is not low-energy heads the instance; without one the fragment stays alone. Of circles the lowest id that may head does.
    """
    ws = Workspace(fragments.sparkSession, "showers")
    em = F.abs("pdg").isin(11, 22) | (F.col("sem_type") == SEMANTIC["shower"])
    base = fragments.select("event_id", "id", "parent_id", "pdg", em.alias("em"), (em & (F.col("sem_type") != LE)).alias("able"), (F.col("interaction_type").isin(INTERACTION["compton"], INTERACTION["photoelectron"]) & (F.col("parent_pdg") == 22)).alias("second"))
    held = _with_rep(base, "parent_id", members, "up").select(F.col("event_id").alias("h_e"), F.col("id").alias("h_id"), "up")
    b = base.join(held, (F.col("event_id") == F.col("h_e")) & (F.col("id") == F.col("h_id")), "left").drop("h_e", "h_id")
    q = base.select(F.col("event_id").alias("q_e"), F.col("id").alias("q_id"), F.col("em").alias("q_em"), F.col("pdg").alias("q_pdg"))
    b = ws.keep(b.join(q, (F.col("event_id") == F.col("q_e")) & (F.col("up") == F.col("q_id")), "left").select("event_id", "id", "able", "second", "q_pdg", F.when(F.col("em") & F.col("q_em") & (F.col("up") != F.col("id")), F.col("up")).alias("up")))
    climbs = b.where("up is not null").select(F.col("event_id").alias("c_e"), F.col("id").alias("c_id"))
    b = b.join(climbs, (F.col("event_id") == F.col("c_e")) & (F.col("up") == F.col("c_id")), "left").withColumn("up", F.when(F.col("second") & (F.abs("q_pdg") == 22) & F.col("c_id").isNull(), None).otherwise(F.col("up"))).select("event_id", "id", "able", "up")
    b = ws.keep(b)
    r = ws.keep(resolve_hierarchy(b, "id", "up", ("event_id",), path=False, carry=["able"], unique=True, mark="able"))
    heads = r.where("topmost is not null").select("event_id", "id", F.col("topmost").alias("head"))
    loops = r.where("in_loop").select("event_id", "id", "up", "able")
    rings = connected_components(loops.where("up is not null"), "id", "up", ("event_id",), "id", "ring")
    ring_able = rings.join(loops.select(F.col("event_id").alias("l_e"), F.col("id").alias("l_id"), "able"), (F.col("event_id") == F.col("l_e")) & (F.col("id") == F.col("l_id")))
    ring_head = ring_able.groupBy("event_id", "ring").agg(F.min(F.struct((~F.col("able")).alias("no"), "id")).alias("h")).select(F.col("event_id").alias("r_e"), F.col("ring").alias("r_r"), F.col("h.id").alias("head"))
    heads = heads.unionByName(rings.join(ring_head, (F.col("event_id") == F.col("r_e")) & (F.col("ring") == F.col("r_r"))).select("event_id", "id", "head"))
    h = heads.select(F.col("event_id").alias("h_e"), F.col("id").alias("h_id"), "head")
    return b.join(h, (F.col("event_id") == F.col("h_e")) & (F.col("id") == F.col("h_id")), "left").select("event_id", F.col("id").alias("frag_id"), F.coalesce("head", "id").alias("inst_id"))


def split_pieces(fragments: DataFrame, members: DataFrame, particles: DataFrame) -> DataFrame:
    """Low-energy fragments that are pieces of one track: event_id, ``frag_id``, ``home``, ``sem_type``.

    Stand-alone low-energy fragments whose members all have one track id, that of a track, Michel or delta fragment headed by that very track and no neutron: they join it and take its sem_type.
    """
    ws = Workspace(particles.sparkSession, "pieces")
    m = ws.keep(_sem(members.select("event_id", "particle_id", "rep_id"), "particle_id", particles, "m", ("geant4_trackid",)))
    le = fragments.where(F.col("sem_type") == LE).select(F.col("event_id").alias("f_e"), F.col("id").alias("f_id"))
    one = m.join(le, (F.col("event_id") == F.col("f_e")) & (F.col("rep_id") == F.col("f_id")), "left_semi").groupBy("event_id", "rep_id").agg(F.min("m_geant4_trackid").alias("g"), F.max("m_geant4_trackid").alias("g2")).where("g = g2")
    to = fragments.where(F.col("sem_type").isin(SEMANTIC["track"], SEMANTIC["michel"], SEMANTIC["delta"]) & (F.col("pdg") != 2112)).groupBy(F.col("event_id").alias("t_e"), F.col("geant4_trackid").alias("t_g")).agg(F.min(F.struct("id", "sem_type")).alias("t"))
    return one.join(to, (F.col("event_id") == F.col("t_e")) & (F.col("g") == F.col("t_g"))).select("event_id", F.col("rep_id").alias("frag_id"), F.col("t.id").alias("home"), F.col("t.sem_type").alias("sem_type"))


def buried_deltas(fragments: DataFrame, members: DataFrame, particles: DataFrame, points: DataFrame, voxel: float, min_standoff: float) -> DataFrame:
    """Delta fragments all of whose cells lie closer than ``min_standoff`` to the track they sit on: event_id, ``frag_id``, ``home``, ``standoff``. Chains end at the last home."""
    ws = Workspace(particles.sparkSession, "buried")
    d = fragments.where((F.col("sem_type") == SEMANTIC["delta"]) & (F.col("interaction_type") != INTERACTION["primary"])).select("event_id", F.col("id").alias("child"))
    home = ws.keep(homes(members, particles, d))
    grid = cells(_with_rep(points, "particle_id", members, "rep_id"), (voxel,) * 3, (0.0,) * 3, ("event_id", "rep_id")).select("event_id", "rep_id", *((F.col(f"v{a}") * voxel).alias(a) for a in "xyz")).distinct()
    grid = ws.keep(grid.withColumn("cell_id", F.xxhash64("rep_id", "x", "y", "z")))
    side = lambda by, n: home.join(grid.withColumnRenamed("event_id", "g_e"), (F.col("event_id") == F.col("g_e")) & (F.col(by) == F.col("rep_id"))).select("event_id", "child", F.lit(n).alias("side"), "cell_id", "x", "y", "z")
    far = standoff(side("child", 1).unionByName(side("home", 2)), max(min_standoff, voxel), ("event_id", "child"), "side", "cell_id").where(F.col("standoff") < min_standoff)
    near = home.join(far.select(F.col("event_id").alias("f_e"), F.col("child").alias("f_c"), "standoff"), (F.col("event_id") == F.col("f_e")) & (F.col("child") == F.col("f_c"))).select("event_id", "child", "home", "standoff")
    chain = resolve_hierarchy(near, "child", "home", ("event_id",), path=False, carry=["standoff"])
    up = near.select(F.col("event_id").alias("u_e"), F.col("child").alias("u_c"), F.col("home").alias("u_home"))
    return chain.join(up, (F.col("event_id") == F.col("u_e")) & (F.col("root_id") == F.col("u_c"))).select("event_id", F.col("child").alias("frag_id"), F.col("u_home").alias("home"), "standoff")


def absorbed_deltas(members: DataFrame, particles: DataFrame) -> DataFrame:
    """event_id, ``id``: low-energy deltas by origin that lie in the track-like fragment of their own parent; they are written as deltas."""
    d = particles.where((F.col("sem_type") == LE) & (F.col("interaction_type") == INTERACTION["delta"])).select("event_id", "id", "parent_id")
    both = _with_rep(_with_rep(d, "id", members, "own"), "parent_id", members, "up").where("own = up")
    return _sem(both, "own", particles, "o").where(F.col("o_sem_type").isin(SEMANTIC["track"], SEMANTIC["michel"], SEMANTIC["delta"])).select("event_id", "id")


def partitions_by_sem_type(state: DataFrame) -> DataFrame:
    """event_id, ``sem_type`` of the representative, ``partitions``, ``particles``: the partitions of a state (event_id, particle_id, rep_id, sem_type) by what their representative is; null is a type."""
    return state.groupBy("event_id", "sem_type").agg(F.count_if(F.col("particle_id") == F.col("rep_id")).alias("partitions"), F.count(F.lit(1)).alias("particles"))


def partition_stats(members: DataFrame, group: str = "rep_id", event: str = "event_id") -> DataFrame:
    """Per event: partitions, mean, median and greatest size, and how many have 1, 2-5, 6-10, 11-20 and more members."""
    n = members.groupBy(event, group).agg(F.count(F.lit(1)).alias("n"))
    between = lambda a, b: F.count_if((F.col("n") >= a) & (F.col("n") <= b))
    return n.groupBy(event).agg(F.count(F.lit(1)).alias("partitions"), F.avg("n").alias("mean_size"), F.percentile("n", 0.5).alias("median_size"), F.max("n").alias("most"), between(1, 1).alias("of_1"), between(2, 5).alias("of_2_5"), between(6, 10).alias("of_6_10"), between(11, 20).alias("of_11_20"), F.count_if(F.col("n") > 20).alias("of_more"))

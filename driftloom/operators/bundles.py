"""The run of whole events within a task, for events that are small enough.

Most events have some hundreds of rows, and every round of a loop over tables is a job; so events of at most ``EVENT_ROWS`` rows, in which
not too many points lie together (``EVENT_PAIRS``), are dealt to bundles of about ``BUNDLE_ROWS``, and a task takes a bundle at a time through all stages in vectors over all its events. Both limits bound the memory of a task.
Larger events go through the operators on tables, which state the same rules.

Particles lie in order of (event, id), so of one event's rows the lower index is the lower id. Links are indices, -1 for none.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from ..enums import INTERACTION, SEMANTIC

#: Rows (particles and voxels), and pairs of voxels in cells of one distance, up to which an event is run within a task; rows of a bundle on average.
EVENT_ROWS, EVENT_PAIRS, BUNDLE_ROWS = 1_000_000, 3_000_000, 20_000
#: Pairs of points compared at once.
AT_ONCE = 1 << 20
NULL = np.iinfo(np.int64).min
LE = SEMANTIC["le_scatter"]

INTS = (
    "id", "parent_id", "ancestor_id", "pdg", "parent_pdg", "geant4_trackid", "interaction_id", "interaction_type", "sem_type", "row_no", "pc_start", "pc_end", "frag_id", "frag_sem", "frag_pc_start", "frag_pc_end", "frag_merge_count", "frag_parent_id",
    "frag_inst_id", "inst_id", "inst_sem", "inst_pc_start", "inst_pc_le_start", "inst_pc_end", "inst_merge_count", "inst_parent_id", "in_frag", "in_inst", "of_frag_sem", "of_inst_sem", "n", "point_id",
)
FLAGS = ("is_le", "stored", "last")
TEXTS = ("kind", "code", "outcome")
SCHEMA = ", ".join(["event_id bigint", *(f"{c} bigint" for c in INTS), *(f"{c} boolean" for c in FLAGS), *(f"{c} string" for c in TEXTS)])


# ---- vectors


class Places:
    """Where the row of (event, id) is."""

    def __init__(self, event: np.ndarray, ids: np.ndarray):
        self.ids = np.unique(ids)
        code = event * len(self.ids) + np.searchsorted(self.ids, ids)
        self.rows = np.argsort(code, kind="stable")
        self.code = code[self.rows]

    def find(self, event: np.ndarray, ids: np.ndarray) -> np.ndarray:
        if not len(self.ids):
            return np.full(len(ids), -1)
        at = np.minimum(np.searchsorted(self.ids, ids), len(self.ids) - 1)
        code = event * len(self.ids) + at
        to = np.minimum(np.searchsorted(self.code, code), len(self.code) - 1)
        return np.where((self.ids[at] == ids) & (self.code[to] == code), self.rows[to], -1)


def roots(up: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The last row on the way up, and whether the way runs in circles (then it is any row on the circle)."""
    at = np.where(up < 0, np.arange(len(up)), up)
    for _ in range(len(up).bit_length()):
        before, at = at, at[at]
        if (at == before).all():
            break
    return at, up[at] >= 0


def circle_heads(up: np.ndarray) -> np.ndarray:
    """The root of every row; of a circle the lowest row on it."""
    at, loop = roots(up)
    if not loop.any():
        return at
    low = to = np.where(loop, up, np.arange(len(up)))
    for _ in range(len(up).bit_length()):
        low, to = np.minimum(low, low[to]), to[to]
    return np.where(loop, low[to], at)


def nearest(up: np.ndarray, marked: np.ndarray, own: bool = False) -> np.ndarray:
    """The first marked row on the way up, from the row above on (``own``: from the row itself on)."""
    at, loop = roots(np.where(marked, -1, up))
    hit = np.where(~loop & marked[at], at, -1)
    return hit if own else np.where(up >= 0, hit[up], -1)


def topmost(up: np.ndarray, marked: np.ndarray) -> np.ndarray:
    """The marked row nearest to the root among the row and those above it, -1 for none; of rows in or below circles anything."""
    at = np.where(up < 0, np.arange(len(up)), up)
    best = np.where(marked, np.arange(len(up)), -1)
    for _ in range(len(up).bit_length()):
        best = np.where(best[at] >= 0, best[at], best)
        at = at[at]
    return best


def ancestors(up: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    """Flags of the seeds and of all rows above them."""
    seen = np.zeros(len(up), bool)
    new = np.unique(seeds)
    while len(new):
        seen[new] = True
        above = up[new]
        new = np.unique(above[above >= 0])
        new = new[~seen[new]]
    return seen


def components(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``label`` (the lowest row of each row's component so far) after linking the rows of a with those of b."""
    while True:
        a, b = label[a], label[b]
        a, b = np.minimum(a, b)[a != b], np.maximum(a, b)[a != b]
        if not len(a):
            return label
        label = label.copy()
        np.minimum.at(label, b, a)
        while (label[label] != label).any():
            label = label[label]


def near(scope: np.ndarray, xyz: np.ndarray, distance: float, from_scope: np.ndarray | None = None, from_xyz: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Rows i and j of one scope at most ``distance`` apart, with the squared distance, ``AT_ONCE`` candidates at a time; each pair of rows once. With ``from_*``, i are rows of those."""
    rows = np.nonzero(np.isfinite(xyz).all(1))[0]
    k = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], np.uint64)

    def hashed(s: np.ndarray, p: np.ndarray) -> np.ndarray:
        c = np.clip(np.floor(p / (distance * (1 + 1e-9))), -(2.0**40), 2.0**40).astype(np.int64).view(np.uint64)
        return s.astype(np.int64).view(np.uint64) * k[0] + c[:, 0] * k[1] + c[:, 1] * k[2] + c[:, 2] * k[3]

    h = hashed(scope[rows], xyz[rows])
    order = np.argsort(h, kind="stable")
    rows, h = rows[order], h[order]
    cells, first = np.unique(h, return_index=True)
    first = np.append(first, len(h))
    same = from_scope is None
    fs, fx = (scope, xyz) if same else (from_scope, from_xyz)
    froms = rows if same else np.nonzero(np.isfinite(fx).all(1))[0]
    fh = h if same else hashed(fs[froms], fx[froms])
    if not len(cells) or not len(froms):
        return
    for o in range(13 if same else 0, 27):
        step = np.array([[o // 9 - 1, o // 3 % 3 - 1, o % 3 - 1]], np.int64).view(np.uint64)
        to = fh + (step * k[1:]).sum(1, dtype=np.uint64)
        at = np.minimum(np.searchsorted(cells, to), len(cells) - 1)
        hit = np.nonzero(cells[at] == to)[0]
        lo, hi = first[at[hit]], first[at[hit] + 1]
        if same and o == 13:
            lo = hit + 1
        n = hi - lo
        ends = np.cumsum(n)
        done = 0
        while done < len(n):
            base = ends[done - 1] if done else 0
            upto = max(done + 1, int(np.searchsorted(ends, base + AT_ONCE, "right")))
            m = n[done:upto]
            i = np.repeat(hit[done:upto], m)
            j = np.arange(len(i)) - np.repeat(ends[done:upto] - m - base, m) + np.repeat(lo[done:upto], m)
            i, j = froms[i], rows[j]
            d = fx[i] - xyz[j]
            d2 = d[:, 0] * d[:, 0] + d[:, 1] * d[:, 1] + d[:, 2] * d[:, 2]
            ok = (fs[i] == scope[j]) & (d2 <= distance * distance)
            yield i[ok], j[ok], d2[ok]
            done = upto


def folded(a: np.ndarray, b: np.ndarray, v: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct pairs of rows under ``n``, each with its least value."""
    code = a * n + b
    order = np.lexsort((v, code))
    code = code[order]
    first = np.append(True, code[1:] != code[:-1])[: len(code)]
    return code[first] // n, code[first] % n, v[order][first]


def isin(v: np.ndarray, *values: int) -> np.ndarray:
    return np.isin(v, values)


# ---- the run of a bundle


@dataclass
class Rows:
    """Output rows of several kinds, with the columns of SCHEMA."""

    events: np.ndarray
    parts: list[pa.Table]

    def add(self, kind: str, event: np.ndarray, **columns) -> None:
        n = len(event)
        if n:
            of = {"event_id": pa.array(self.events[event], pa.int64()), "kind": pa.array(np.full(n, kind, object), pa.string())}
            for c in INTS:
                v = columns.get(c)
                of[c] = pa.nulls(n, pa.int64()) if v is None else pa.array(np.asarray(v, np.int64), mask=np.asarray(v) == NULL)
            for c in FLAGS:
                of[c] = pa.nulls(n, pa.bool_()) if c not in columns else pa.array(np.asarray(columns[c], bool))
            for c in ("code", "outcome"):
                of[c] = pa.nulls(n, pa.string()) if c not in columns else pa.array(np.asarray(columns[c], object), pa.string())
            self.parts.append(pa.table({c: of[c] for c in ("event_id", *INTS, *FLAGS, *TEXTS)}))


def _ints(t: pa.Table, c: str) -> np.ndarray:
    return t[c].cast(pa.int64()).fill_null(NULL).to_numpy()


def run_bundle(people: pa.Table, voxels: pa.Table, params) -> pa.Table:
    """All stages of ``run_events`` for the events of ``people`` (typed particles; ``asked``: a row that only asks for its id to be kept) and their voxels."""
    asked = people.filter(people["asked"])
    people = people.filter(pc.invert(people["asked"]))
    events, ev = np.unique(_ints(people, "event_id"), return_inverse=True)
    out = Rows(events, [])
    if not len(ev):
        return pa.schema([("event_id", pa.int64()), *((c, pa.int64()) for c in INTS), *((c, pa.bool_()) for c in FLAGS), *((c, pa.string()) for c in TEXTS)]).empty_table()
    c = {k: _ints(people, k) for k in ("id", "parent_id", "ancestor_id", "pdg", "parent_pdg", "geant4_trackid", "interaction_id", "interaction_type", "sem_type")}
    order = np.lexsort((c["id"], ev))
    ev, c = ev[order], {k: v[order] for k, v in c.items()}

    # issues of the genealogy as given
    n = len(ev)
    place = Places(ev, c["id"])
    up = place.find(ev, c["parent_id"])
    parted = (c["parent_id"] != NULL) & (c["parent_id"] != c["id"])
    linked = np.where(parted, up, -1)
    at, loop = roots(linked)
    for code, bad in (("absent_parent", parted & (up < 0)), ("wrong_ancestor", ~loop & (c["ancestor_id"] != c["id"][at])), ("loop", loop), ("mixed_interaction", (linked >= 0) & (c["interaction_id"] != c["interaction_id"][linked]))):
        out.add("issue", ev[bad], id=c["id"][bad], code=np.full(bad.sum(), code, object))

    # small pieces of clouds become particles
    v_ev = np.searchsorted(events, _ints(voxels, "event_id"))
    v_point, v_xyz = _ints(voxels, "point_id"), np.stack([voxels[a].cast(pa.float64()).to_numpy() for a in "xyz"], 1).reshape(-1, 3)
    v_of = place.find(v_ev, _ints(voxels, "particle_id"))
    order = np.argsort(v_point, kind="stable")
    v_ev, v_point, v_xyz, v_of = v_ev[order], v_point[order], v_xyz[order], v_of[order]
    seen = np.nonzero(np.isin(c["sem_type"][v_of], params.defragment_sem_types))[0]
    label = np.arange(len(seen))
    for i, j, _ in near(v_of[seen], v_xyz[seen], params.distance_threshold):
        label = components(label, i, j)
    part, size = np.unique(label, return_counts=True)
    of = v_of[seen[part]]
    small = (size <= params.min_pc_size) & (np.bincount(of, minlength=n)[of] > 1)
    part, size, of = part[small], size[small], of[small]
    order = np.lexsort((v_point[seen[part]], of))
    part, size, of = part[order], size[order], of[order]
    last = np.append(ev[1:] != ev[:-1], True)
    top = c["id"][last][ev[of]]
    no = np.arange(len(of)) - np.searchsorted(ev[of], ev[of]) + 1
    new_id = (top + no).astype(np.int32).astype(np.int64)
    out.add("piece", ev[of], id=new_id, parent_id=c["id"][of], n=size)
    spawned = {k: v[of] for k, v in c.items()} | {"id": new_id, "parent_id": c["id"][of], "parent_pdg": c["pdg"][of], "sem_type": np.full(len(of), LE)}
    ev, c = np.append(ev, ev[of]), {k: np.append(v, spawned[k]) for k, v in c.items()}
    piece = np.full(len(seen), -1)
    piece[part] = np.arange(len(part))
    piece = piece[label]
    moved = seen[piece >= 0]
    out.add("moved", v_ev[moved], point_id=v_point[moved], id=new_id[piece[piece >= 0]])
    v_of[moved] = n + piece[piece >= 0]
    order = np.lexsort((c["id"], ev))
    back = np.empty(len(order), np.int64)
    back[order] = np.arange(len(order))
    ev, c, v_of = ev[order], {k: v[order] for k, v in c.items()}, back[v_of]
    n = len(ev)
    ids, pdg, kind, sem0 = c["id"], c["pdg"], c["interaction_type"], c["sem_type"]
    place = Places(ev, ids)
    points = np.bincount(v_of, minlength=n)

    # orphans
    up = place.find(ev, c["parent_id"])
    parent = np.where(up >= 0, up, np.arange(n))
    up = np.where(up == np.arange(n), -1, up)
    ancestor = place.find(ev, c["ancestor_id"])
    ancestor = np.where(ancestor >= 0, ancestor, circle_heads(up))

    # the merge fixpoint; which particles' points touch is found once, as points never move
    ea, eb, ed = (np.zeros(0, t) for t in (np.int64, np.int64, float))
    for i, j, d2 in near(v_ev, v_xyz, params.distance_threshold):
        a, b = v_of[i], v_of[j]
        apart = a != b
        a, b, d2 = a[apart], b[apart], d2[apart]
        ea, eb, ed = folded(np.append(ea, np.minimum(a, b)), np.append(eb, np.maximum(a, b)), np.append(ed, d2), n)
    rep, sem = np.arange(n), sem0.copy()
    kid = np.nonzero((up >= 0) & (pdg[up] == 22))[0]
    pair = (np.abs(pdg[kid]) == 11) & (kind[kid] == INTERACTION["conversion"]) & (c["parent_pdg"][kid] == 22)
    same = (pdg[kid] == 22) & (c["geant4_trackid"][kid] == c["geant4_trackid"][up[kid]]) & (c["geant4_trackid"][kid] != NULL)
    kid, pair = kid[pair | same], pair[pair | same]

    def homes(of: np.ndarray) -> np.ndarray:
        """The group of the nearest row above that lies outside the group of the row, -1 for none."""
        leaves = (up >= 0) & (of[up] != of)
        at = nearest(up, leaves, own=True)
        return np.where(at >= 0, of[up[at]], -1)

    def contacts() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        a, b = rep[ea], rep[eb]
        on = active[ev[ea]] & (a != b)
        return folded(np.minimum(a, b)[on], np.maximum(a, b)[on], ed[on], n)

    def photon_decay():
        k = kid[active[ev[kid]]]
        raised = rep[up[kid[pair & active[ev[kid]]]]]
        sem[raised[sem[raised] == LE]] = SEMANTIC["shower"]
        a, b = rep[k], rep[up[k]]
        a, b, _ = folded(a[a != b], b[a != b], np.zeros((a != b).sum()), n)
        return a, b, np.full(len(a), "MERGED", object)

    def combine_le():
        a, b, _ = contacts()
        both = (sem[a] == LE) & (sem[b] == LE)
        a, b = a[both], b[both]
        size = np.bincount(rep, points, n)
        lives = size[a] >= size[b]
        return np.where(lives, b, a), np.where(lives, a, b), np.full(len(a), "MERGED", object)

    def absorb_le():
        a, b, d2 = contacts()
        one = (sem[a] == LE) != (sem[b] == LE)
        a, b, d = a[one], b[one], np.sqrt(d2[one])
        child, into = np.where(sem[a] == LE, a, b), np.where(sem[a] == LE, b, a)
        order = np.lexsort((into, d, into != homes(rep)[child], child))
        child, into = child[order], into[order]
        first = np.append(True, child[1:] != child[:-1])[: len(child)]
        return child, into, np.where(first, "MERGED", "ALREADY_MERGED_WITH_OTHER").astype(object)

    def touching_em():
        r = np.nonzero((rep == np.arange(n)) & isin(pdg, 11, 22) & (sem != LE) & (up >= 0) & active[ev])[0]
        q = rep[up[r]]
        ok = isin(pdg[q], 11, 22) & (sem[q] != LE) & (ancestor[q] == ancestor[r]) & (q != r)
        r, q = r[ok], q[ok]
        a, b, _ = contacts()
        met = np.isin(np.minimum(r, q) * n + np.maximum(r, q), a * n + b)
        return r, q, np.where(met, "MERGED", "NOT_TOUCHING").astype(object)

    rules = {"photon_decay": photon_decay, "combine_le": combine_le, "absorb_le": absorb_le, "touching_em": touching_em}
    active, passes, tried = np.ones(len(events), bool), 0, []
    while passes < params.max_passes and active.any():
        passes += 1
        merging = np.zeros(len(events), bool)
        told = []
        for name in params.rules:
            child, into, outcome = rules[name]()
            told.append((name, child, into, outcome))
            on = outcome == "MERGED"
            if on.any():
                a, b = child[on], into[on]
                merging[ev[a]] = True
                group = components(np.arange(n), a, b)
                below = np.zeros(n, bool)
                below[a] = True
                ends = np.unique(np.append(a, b))
                order = np.lexsort((ends, below[ends], group[ends]))
                ends = ends[order]
                first = np.append(True, group[ends[1:]] != group[ends[:-1]])
                head = np.arange(n)
                head[group[ends[first]]] = ends[first]
                hooked = np.zeros(n, bool)
                hooked[ends] = True
                rep = np.where(hooked[rep], head[group[rep]], rep)
        for name, child, into, outcome in told:
            tried.append((name, passes, child, into, outcome, ~merging[ev[child]]))
        active &= merging
    for name, no, child, into, outcome, ended in tried:
        out.add("decision", ev[child], id=ids[child], parent_id=ids[into], n=np.full(len(child), no), code=np.full(len(child), name, object), outcome=outcome, last=ended)
    out.add("end", np.zeros(1, np.int64), n=[passes], last=[not active.any()])

    # fragments: pieces of tracks, buried and absorbed deltas
    head = rep == np.arange(n)
    track = (SEMANTIC["track"], SEMANTIC["michel"], SEMANTIC["delta"])
    known = c["geant4_trackid"] != NULL
    low, high = np.full(n, np.iinfo(np.int64).max), np.full(n, NULL)
    np.minimum.at(low, rep[known], c["geant4_trackid"][known])
    np.maximum.at(high, rep[known], c["geant4_trackid"][known])
    alone = np.nonzero(head & (sem == LE) & (low == high))[0]
    tops = np.nonzero(head & isin(sem, *track) & (pdg != 2112) & known)[0]
    home_of = np.full(n, -1)
    to = Places(ev[tops], c["geant4_trackid"][tops]).find(ev[alone], low[alone])  # the lowest id of those with a track id
    home_of[alone[to >= 0]] = tops[to[to >= 0]]
    frag_sem = np.where(home_of >= 0, sem[home_of], sem)
    members, buried = rep, np.zeros(n, bool)
    if params.delta_min_standoff > 0:
        child = np.nonzero(head & (frag_sem == SEMANTIC["delta"]) & (kind != INTERACTION["primary"]))[0]
        at = homes(members)[child]
        child, at = child[at >= 0], at[at >= 0]
        side = params.voxel_size[0]
        of_pair = np.isin(members[v_of], np.append(child, at))
        g_rep, cell = members[v_of[of_pair]], np.floor(v_xyz[of_pair] / side)
        _, first = np.unique(np.column_stack([g_rep.astype(float), cell]), axis=0, return_index=True)
        g_rep, g_xyz = g_rep[first], cell[first] * side
        asks = np.full(n, -1)
        asks[child] = at
        mine = np.nonzero(asks[g_rep] >= 0)[0]
        radius = max(params.delta_min_standoff, side)
        least = np.full(len(mine), np.inf)
        useful = np.isin(g_rep, at)
        for i, _, d2 in near(g_rep[useful], g_xyz[useful], radius, asks[g_rep[mine]], g_xyz[mine]):
            np.minimum.at(least, i, d2)
        worst = np.full(n, -1.0)
        np.maximum.at(worst, g_rep[mine], np.sqrt(least))
        sunk = (asks >= 0) & (worst >= 0) & (worst < params.delta_min_standoff)
        chain = np.where(sunk, asks, -1)
        at, loop = roots(chain)
        buried = sunk & ~loop
        members = np.where(buried[members], at[members], members)
    absorbed = (sem0 == LE) & (kind == INTERACTION["delta"]) & (members[parent] == members) & isin(sem0[members], *track)
    frag = head & ~buried

    # instances
    em = isin(np.abs(pdg), 11, 22) | (frag_sem == SEMANTIC["shower"])
    able = em & (frag_sem != LE) & frag
    second = isin(kind, INTERACTION["compton"], INTERACTION["photoelectron"]) & (c["parent_pdg"] == 22)
    to = members[parent]
    climb = np.where(frag & em & frag[to] & em[to] & (to != np.arange(n)), to, -1)
    stays = second & (climb >= 0) & (np.abs(pdg[climb]) == 22) & (climb[climb] < 0)
    climb = np.where(stays, -1, climb)
    at, loop = roots(climb)
    highest = topmost(climb, able)
    inst_of = np.where(~loop & (highest >= 0), highest, np.arange(n))
    if loop.any():
        rows = np.nonzero(loop)[0]
        ring = components(np.arange(n), rows, climb[rows])
        order = np.lexsort((rows, ~able[rows], ring[rows]))
        rows = rows[order]
        first = np.append(True, ring[rows[1:]] != ring[rows[:-1]])
        heads = np.arange(n)
        heads[ring[rows[first]]] = rows[first]
        inst_of[rows] = heads[ring[rows]]
    joins = (home_of >= 0) & frag & frag[home_of]
    inst_of = np.where(joins, inst_of[home_of], inst_of)
    f = members
    inst = inst_of[f]
    is_le = frag[f] & (frag_sem[f] == LE)
    f_sem = np.where(frag[f], frag_sem[f], NULL)
    own_sem, own_inter = np.where(frag, frag_sem, NULL), np.where(frag, c["interaction_id"], NULL)
    i_sem = own_sem[inst]

    # which instances are written
    is_inst = np.zeros(n, bool)
    is_inst[inst] = True
    visible = np.zeros(n, bool)
    visible[inst[points > 0]] = True
    above = homes(inst)
    if params.drop_le:
        is_inst &= own_sem != LE
        visible &= is_inst
    inst_up = np.where(is_inst & (above >= 0) & (above != np.arange(n)) & is_inst[above], above, -1)
    kept = is_inst
    if params.traceable:
        lit = Places(ev[visible], own_inter[visible]).find(ev, own_inter) >= 0
        kept = ancestors(inst_up, np.nonzero(visible)[0]) | (is_inst & (inst_up < 0) & lit & (own_inter != NULL))
    written = kept[inst]

    # points: interaction of the group, instance, low-energy last, fragment, particle
    inter = c["interaction_id"]
    o_inter, o_inst = inter[np.where(written, inst, f)], np.where(written, inst, np.arange(n))
    order = np.lexsort((np.arange(n), f, is_le, o_inst, o_inter, ev))
    first_of = np.searchsorted(ev, np.arange(len(events)))
    ends = np.cumsum(points[order])
    starts = ends - points[order]
    base = starts[first_of][ev[order]]
    pc_start, pc_end = np.empty(n, np.int64), np.empty(n, np.int64)
    pc_start[order], pc_end[order] = starts - base, ends - base

    def spans(group: np.ndarray, rows: np.ndarray, m: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        far = np.iinfo(np.int64).max
        start, end, le = np.full(m, far), np.full(m, -1), np.full(m, far)
        r = np.nonzero(rows & (points > 0))[0]
        np.minimum.at(start, group[r], pc_start[r])
        np.maximum.at(end, group[r], pc_end[r])
        np.minimum.at(le, group[r[is_le[r]]], pc_start[r[is_le[r]]])
        return np.where(start == far, -1, start), end, np.where(le == far, end, le)

    f_start, f_end, _ = spans(f, np.ones(n, bool), n)
    i_start, i_end, i_le = spans(inst, written, n)
    f_count, i_count = np.bincount(f, minlength=n), np.bincount(inst[written], minlength=n)

    # rows
    stored = ancestors(up, np.nonzero(kept)[0]) | absorbed | buried
    stored[f[points > 0]] = True
    more = np.isin(_ints(asked, "event_id"), events)
    at = place.find(np.searchsorted(events, _ints(asked, "event_id")[more]), _ints(asked, "id")[more])
    stored[at[at >= 0]] = True
    at = nearest(up, stored)
    new_parent = np.where(at >= 0, at, np.arange(n))
    row_up = np.where(stored & (new_parent != np.arange(n)), new_parent, -1)
    new_root = circle_heads(row_up)
    heads_frag, heads_inst = f == np.arange(n), (inst == np.arange(n)) & written
    s = np.nonzero(stored)[0]
    group_parent = {}
    for k, heads in (("frag", heads_frag), ("inst", heads_inst)):
        at = nearest(row_up, heads & stored)
        group_parent[k] = np.where(at >= 0, at, np.arange(n))
    order = s[np.lexsort((s, f[s], is_le[s], o_inst[s], o_inter[s], inter[s], ev[s]))]
    row_no = np.full(n, NULL)
    row_no[order] = np.arange(len(order)) - np.searchsorted(ev[order], ev[order])

    # interactions: of the stored rows, numbered in each event
    live = s[inter[s] >= 0]
    vertices = Places(ev[live], inter[live])
    v_code, first = np.unique(vertices.code, return_index=True)
    v_row = live[vertices.rows[first]]
    v_no = np.arange(len(v_row)) - np.searchsorted(ev[v_row], ev[v_row])
    slot = np.full(n, -1)
    at = vertices.find(ev, inter)
    at_code = np.where(at >= 0, ev * max(1, len(vertices.ids)) + np.searchsorted(vertices.ids, inter), -1)
    slot = np.where(at >= 0, np.searchsorted(v_code, at_code), -1)
    p_start, p_end = np.full(len(v_row), np.iinfo(np.int64).max), np.full(len(v_row), -1)
    np.minimum.at(p_start, slot[live], row_no[live])
    np.maximum.at(p_end, slot[live], row_no[live] + 1)
    at = vertices.find(ev, o_inter)
    o_slot = np.where(at >= 0, slot[live[np.maximum(at, 0)]] if len(live) else -1, -1)
    x_start, x_end, _ = spans(np.maximum(o_slot, 0), o_slot >= 0, max(1, len(v_row)))
    m = len(v_row)
    out.add("interaction", ev[v_row], interaction_id=v_no, id=inter[v_row], row_no=p_start, n=p_end, pc_start=x_start[:m], pc_end=x_end[:m])
    dense = np.where(slot >= 0, np.append(v_no, -1)[slot], -1)

    at_head = lambda flag, v: np.where(flag, v, -1)
    out.add(
        "particle", ev, id=ids, row_no=row_no, geant4_trackid=c["geant4_trackid"], parent_id=ids[new_parent], ancestor_id=ids[new_root], pdg=pdg, parent_pdg=pdg[new_parent], interaction_id=dense, interaction_type=kind,
        sem_type=np.where(absorbed, SEMANTIC["delta"], sem0), pc_start=pc_start, pc_end=pc_end, frag_id=at_head(heads_frag, ids), frag_sem=at_head(heads_frag, f_sem), frag_pc_start=at_head(heads_frag, f_start), frag_pc_end=at_head(heads_frag, f_end),
        frag_merge_count=at_head(heads_frag, f_count), frag_parent_id=at_head(heads_frag, ids[group_parent["frag"]]), frag_inst_id=at_head(heads_frag & written, ids[inst]), inst_id=at_head(heads_inst, ids), inst_sem=at_head(heads_inst, i_sem),
        inst_pc_start=at_head(heads_inst, i_start), inst_pc_le_start=at_head(heads_inst, i_le), inst_pc_end=at_head(heads_inst, i_end), inst_merge_count=at_head(heads_inst, i_count), inst_parent_id=at_head(heads_inst, ids[group_parent["inst"]]),
        in_frag=ids[f], in_inst=at_head(written, ids[inst]), of_frag_sem=f_sem, of_inst_sem=i_sem, n=points, is_le=is_le, stored=stored,
    )
    return pa.concat_tables(out.parts)

"""Parent-child links of unknown depth, resolved by pointer doubling.

Every node starts with a pointer to its parent. A round joins the pointers with themselves, so that each jumps twice as far; path
segments are concatenated on the way. After round k all nodes of depth up to 2**k know their root. While some link leads to a root,
a round always finishes the nodes just beyond the last reach; a round that finishes none proves that what is left runs in circles.
The number of rounds is the logarithm of the deepest tree, not of the table.

Only nodes that have children take part in the rounds; all nodes take their parent's answer in one join at the end. Finished nodes
are never rewritten: a round writes only the nodes still open and joins them with all pointers, where Spark broadcasts the open
ones once their written table is small.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..store import Workspace


def resolve_hierarchy(nodes: DataFrame, node: str, parent: str, scope: Sequence[str] = (), path: bool = True, carry: Sequence[str] = (), unique: bool = False, mark: str | None = None) -> DataFrame:
    """Root, depth and path of every node.

    :param nodes: one row per node; ``parent`` null or the node itself means that the node is a root
    :param scope: columns within which ids are unique and links hold (an event, say)
    :param path: whether to build ``path``, an array from the root down to the node
    :param carry: further columns to keep
    :param unique: the caller knows that there is one row per scope and id, which saves a shuffle
    :param mark: a boolean column; adds ``topmost``, the marked node nearest to the root among the node and those above it (null: none, or circles)
    :return: scope, ``node``, ``parent``, carry, ``root_id``, ``depth``, ``in_loop`` and, if asked for, ``path`` and ``topmost``

    A parent that is not a node of the scope ends the walk: the node is a root. A node whose links run in circles, or lead into a
    circle, has ``in_loop`` true and null root, depth and path. A row whose node id or scope is null is kept: it is nobody's parent
    and, with a null scope, nobody's child. Of several rows with one id one stands, the one with the least parent, then carried values
    (null is least). An empty table gives an empty result. Other columns of the input are left out, so their names cannot clash.
    """
    ws = Workspace(nodes.sparkSession, "hierarchy")
    sk = [f"s{i}" for i in range(len(scope))]
    ck = [f"c{i}" for i in range(len(carry))]
    base = nodes.select(
        *(F.col(k).alias(x) for k, x in zip(scope, sk)), F.col(node).alias("n"), F.when(F.col(parent).eqNullSafe(F.col(node)), None).otherwise(F.col(parent)).alias("p"), *(F.col(k).alias(x) for k, x in zip(carry, ck)), *([F.coalesce(F.col(mark), F.lit(False)).alias("mk")] if mark else [])
    )
    mk = ["mk"] if mark else []
    if not unique:
        one = base.where("n is not null").groupBy(*sk, "n").agg(F.min(F.struct("p", *ck, *mk)).alias("v")).select(*sk, "n", "v.*")
        base = one.unionByName(base.where("n is null"))
    base = ws.keep(base)

    def met(left: DataFrame, by: str, right: DataFrame, how: str) -> DataFrame:
        """``left`` with the row of ``right`` for its node ``by``, prefixed with t_."""
        right = right.select(*(F.col(c).alias(f"t_{c}") for c in right.columns))
        return left.join(right, [F.col(x) == F.col(f"t_{x}") for x in sk] + [F.col(by) == F.col("t_n")], how)

    parents = base.where("p is not null").select(*sk, F.col("p").alias("n")).distinct()
    # the base is packed, so its size says nothing about a broadcast
    inner = ws.keep(met(parents.hint("merge"), "n", base.select(*sk, "n", "p", *mk), "inner").select(*sk, "n", F.col("t_p").alias("p"), *(F.col(f"t_{c}").alias(c) for c in mk)), sized=True)
    top = F.col("t_n").isNull()
    begun = met(inner, "p", inner.select(*sk, "n", *mk), "left").select(
        *sk, "n", F.coalesce("t_n", "n").alias("a"), F.when(top, 0).otherwise(1).alias("d"), top.alias("done"),
        *([F.when(top, F.slice(F.array("n"), 1, 0)).otherwise(F.array("t_n")).alias("seg")] if path else []),
        *(["mk", F.when(F.col("t_mk"), F.col("t_n")).alias("up")] if mark else []),
    )
    state = begun.schema
    read = lambda *paths: nodes.sparkSession.read.schema(state).parquet(*paths)
    first, count = ws.count(begun, sized=True, done=F.col("done"))
    written = [first]
    while 0 < count["done"] < count["rows"]:
        mine = read(written[-1]).where("not done")
        every = read(*written).where("done").unionByName(mine)
        step = met(mine, "a", every, "inner").select(*sk, "n", F.col("t_a").alias("a"), (F.col("d") + F.col("t_d")).alias("d"), F.col("t_done").alias("done"), *([F.concat("seg", "t_seg").alias("seg")] if path else []), *(["mk", F.coalesce("t_up", "up").alias("up")] if mark else []))
        at, count = ws.count(step, sized=True, done=F.col("done"))
        written.append(at)
    answers = read(*written).where("done")
    if count["rows"] and not count["done"]:  # the last round finished none: circles
        answers = answers.unionByName(read(written[-1]).where("not done"))
    has, loop = F.col("t_n").isNotNull(), ~F.col("t_done")
    return met(base, "p", answers, "left").select(
        *(F.col(x).alias(k) for x, k in zip(sk, scope)), F.col("n").alias(node), F.col("p").alias(parent), *(F.col(x).alias(k) for x, k in zip(ck, carry)),
        F.when(has & loop, None).when(has, F.col("t_a")).otherwise(F.col("n")).alias("root_id"),
        F.when(has & loop, None).when(has, F.col("t_d") + 1).otherwise(0).alias("depth"),
        (has & loop).alias("in_loop"),
        *([F.when(has & loop, None).when(has, F.concat(F.reverse("t_seg"), F.array("p", "n"))).otherwise(F.array("n")).alias("path")] if path else []),
        *([F.when(has & loop, None).otherwise(F.coalesce(F.when(has, F.coalesce("t_up", F.when(F.col("t_mk"), F.col("p")))), F.when(F.col("mk"), F.col("n")))).alias("topmost")] if mark else []),
    )


def descendants(resolved: DataFrame, scope: Sequence[str] = ()) -> DataFrame:
    """All (ancestor_id, descendant_id) pairs with the number of steps between them, from the paths of ``resolve_hierarchy``.

    Rows without a path (circles) have no pairs. As many rows come out as the depths add up to.
    """
    up = resolved.where("depth > 0").select(*scope, "path", "depth", F.posexplode(F.slice("path", F.lit(1), F.size("path") - 1)).alias("at", "ancestor_id"))
    return up.select(*scope, "ancestor_id", F.element_at("path", -1).alias("descendant_id"), (F.col("depth") - F.col("at")).alias("steps"))

"""Connected components by deterministic Boruvka hooking.

A round lets every component pick its smallest outgoing edge, hooks it onto the other end, collapses the trees by pointer doubling, and
relabels and deduplicates the edges, until none is left. Edges are compared as (lower label, higher label), a total order, so picks
form trees with one circle of two at their top: the tree's smallest edge, whose lower end is its smallest label and becomes the root. A component is
hence always named by its smallest member, and every round at least halves the components that still have edges.

Picks are minima, combined before the shuffle: a label with a third of all edges sends one row per task. Joins put the edges on the
streamed side, so that AQE may split a hot label.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..store import Workspace


def connected_components(pairs: DataFrame, a: str, b: str, scope: Sequence[str] = (), node: str = "node", component: str = "component") -> DataFrame:
    """The component of every node that is linked to another one.

    :param pairs: links between ``a`` and ``b`` within ``scope``, in either order, repeated or not
    :return: scope, ``node``, ``component`` (the smallest node id of the group)

    Links with a null end or scope, and links of a node with itself, link nothing; a node that has no others is not in the result.
    An empty table gives an empty result. Other columns of the input are left out.
    """
    spark = pairs.sparkSession
    ws = Workspace(spark, "components")
    sk = [f"s{i}" for i in range(len(scope))]
    first = F.col(a).isNotNull() & F.col(b).isNotNull()
    edges = pairs.where(first).select(*(F.col(k).alias(x) for k, x in zip(scope, sk)), F.least(a, b).alias("u"), F.greatest(a, b).alias("v")).where(" and ".join([*(f"{x} is not null" for x in sk), "u < v"])).distinct()
    path, n = ws.count(edges, sized=True)
    labels: str | None = None  # n -> label, for every node hooked so far
    link_schema = edges.select(*sk, F.col("u").alias("n"), F.col("v").alias("r")).schema
    read_links = lambda p: spark.read.schema(link_schema).parquet(p)

    def met(left: DataFrame, by: str, links: DataFrame, how: str, as_: str) -> DataFrame:
        right = links.select(*(F.col(x).alias(f"t_{x}") for x in sk), F.col("n").alias(f"n_{as_}"), F.col("r").alias(as_))
        return left.join(right, [*(F.col(x) == F.col(f"t_{x}") for x in sk), F.col(by) == F.col(f"n_{as_}")], how).drop(*(f"t_{x}" for x in sk), f"n_{as_}")

    while n["rows"]:
        left = spark.read.schema(edges.schema).parquet(path)
        # the smallest edge of a label: below it if it has a smaller neighbour, else to its smallest greater one
        ends = left.select(*sk, F.explode(F.array(F.struct(F.col("u").alias("n"), F.lit(None).cast(edges.schema["u"].dataType).alias("lo"), F.col("v").alias("hi")), F.struct(F.col("v").alias("n"), F.col("u").alias("lo"), F.lit(None).cast(edges.schema["v"].dataType).alias("hi")))).alias("e"))
        picks = ends.select(*sk, "e.*").groupBy(*sk, "n").agg(F.coalesce(F.min("lo"), F.min("hi")).alias("r"), F.min("lo").isNull().alias("least"))
        # a label without a smaller neighbour whose pick picks it back is a root
        picks_at = ws.write(picks, sized=True)
        picks = spark.read.schema(picks.schema).parquet(picks_at)
        back = met(picks, "r", picks.select(*sk, "n", "r"), "inner", "rr")
        hook = ws.write(back.select(*sk, "n", F.when(F.col("least") & (F.col("rr") == F.col("n")), F.col("n")).otherwise(F.col("r")).alias("r")), sized=True)
        while True:  # pointer doubling until every label points at its root
            at = read_links(hook)
            step = met(at, "r", at, "inner", "rr").select(*sk, "n", F.col("rr").alias("r"), (F.col("rr") != F.col("r")).alias("moved"))
            to, turned = ws.count(step, sized=True, moved=F.col("moved"))
            ws.drop(hook)
            hook = to
            if not turned["moved"]:
                break
        roots = read_links(hook)
        # relabel and deduplicate the edges
        again = met(met(left, "u", roots, "inner", "ru"), "v", roots, "inner", "rv").where("ru <> rv")
        again_at, n = ws.count(again.select(*sk, F.least("ru", "rv").alias("u"), F.greatest("ru", "rv").alias("v")).distinct(), sized=True)
        if labels is None:
            labels = hook
        else:
            old = read_links(labels)
            new = ws.write(met(old, "r", roots, "left", "rr").select(*sk, "n", F.coalesce("rr", "r").alias("r")), sized=True)
            ws.drop(labels)
            ws.drop(hook)
            labels = new
        ws.drop(path)
        ws.drop(picks_at)
        path = again_at
    ends = read_links(labels) if labels else spark.createDataFrame([], link_schema)
    return ends.select(*(F.col(x).alias(k) for x, k in zip(sk, scope)), F.col("n").alias(node), F.col("r").alias(component))

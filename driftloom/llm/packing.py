"""Filling containers of fixed capacity with items: best-fit decreasing over a segment tree.

Items are dealt by hash to shards of bounded size, equal items over all shards alike, and every shard fills its own containers: largest item first, each into the open container
with the least room that still holds it, which a segment tree over the remaining capacities finds in logarithmic time. A shard wastes
what one packing wastes anyway plus its last few open containers; shards make the work
parallel and no task ever sees more than a shard. An item above the capacity, and no other, is divided: whole containers of it, and
a rest that is packed like any item.
"""

from __future__ import annotations

from collections import defaultdict
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Items of one shard, on average.
SHARD_ITEMS = 50_000
#: Kinds of container in one plan; more are packed by further plans.
KINDS_AT_ONCE = 500
#: Up to this capacity the tree is an array; above it only nodes that some container is below are held.
DENSE = 1 << 20


class Rooms:
    """Open containers by remaining capacity: a segment tree of counts over 0..capacity."""

    def __init__(self, capacity: int):
        self.leaves = 1 << max(1, int(capacity).bit_length())
        self.count = [0] * (2 * self.leaves) if capacity <= DENSE else defaultdict(int)
        self.open: dict[int, list[int]] = {}

    def add(self, room: int, container: int) -> None:
        self.open.setdefault(room, []).append(container)
        i = self.leaves + room
        count = self.count
        while i and not (count[i] and i >= self.leaves):
            count[i] += 1
            i >>= 1
        if i:  # the leaf was open before: only counts change, and only zero matters
            count[i] += 1

    def tightest(self, size: int) -> int:
        """The least remaining capacity of at least ``size`` that a container has; -1: none."""
        count, leaves = self.count, self.leaves
        i = leaves + size
        if count[i]:
            return size
        while i > 1:  # up until there is an open right neighbour, then down its left side
            if not i & 1 and count[i + 1]:
                i += 1
                while i < leaves:
                    i <<= 1
                    if not count[i]:
                        i += 1
                return i - leaves
            i >>= 1
        return -1

    def take(self, room: int) -> int:
        container = self.open[room].pop()
        i = self.leaves + room
        self.count[i] -= 1
        if not self.count[i]:
            i >>= 1
            while i:
                self.count[i] -= 1
                i >>= 1
        return container


def pack(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """The container of each item, by best-fit decreasing; sizes are from 0 to ``capacity``."""
    rooms, out, n = Rooms(capacity), np.empty(len(sizes), dtype=np.int64), 0
    for i in np.argsort(-sizes, kind="stable"):
        size = int(sizes[i])
        room = rooms.tightest(size)
        if room < 0:
            at, room = n, capacity
            n += 1
        else:
            at = rooms.take(room)
        out[i] = at
        rooms.add(room - size, at)
    return out


def fill_containers(items: DataFrame, containers: DataFrame, item: str = "doc_id", size: str = "tokens", kind: str = "container_kind", capacity: str = "capacity_tokens", shard_items: int = SHARD_ITEMS) -> DataFrame:
    """For every kind of container, the container of every item.

    :param containers: a row per kind; their number is that of the results per item
    :return: ``kind``, ``item``, ``part_no`` (0, or counting the parts of a divided item), ``part_size``, ``container_id`` (unique within the kind)

    Items of size 0 or null need no room and get a container like others (null counts as 0); a negative size counts as 0. Null item ids are items. Repeated rows
    are items of their own. Kinds without a positive capacity hold nothing and are left out. Empty tables give an empty result. Ties are
    broken by the order of item ids, so the result does not depend on how the rows lie.
    """
    of, n = items.schema[item].dataType.simpleString(), items.count()
    shards = max(1, -(-n // shard_items))
    slim = items.select(F.col(item).alias("item"), F.greatest(F.coalesce(F.col(size), F.lit(0)), F.lit(0)).cast("bigint").alias("size"))
    # equal items are folded, then spread over all shards in even shares, beginning at the shard of their hash
    folded = slim.groupBy("item", "size").agg(F.count(F.lit(1)).alias("copies")).withColumn("first", F.pmod(F.xxhash64("item", "size"), F.lit(shards)))
    spread = folded.select("item", "size", "copies", "first", F.explode(F.sequence(F.lit(0), F.least("copies", F.lit(shards)) - 1)).alias("i"))
    dealt = spread.select("item", "size", F.pmod(F.col("first") + F.col("i"), F.lit(shards)).alias("shard"), (F.floor(F.col("copies") / shards) + F.when(F.col("i") < F.col("copies") % shards, 1).otherwise(0)).cast("bigint").alias("copies"))
    given = containers.where(F.col(capacity) > 0).select(F.col(kind).alias("kind"), F.col(capacity).cast("bigint").alias("capacity")).collect()

    def one(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        cap = int(rows["capacity"].iloc[0])
        rows = rows.sort_values(["item", "size"], kind="stable", na_position="first")
        rows = rows.loc[rows.index.repeat(rows["copies"])]
        sizes = rows["size"].to_numpy(dtype=np.int64)
        whole = np.where(sizes > cap, sizes // cap, 0)  # containers that parts of a divided item fill alone
        rest = sizes - whole * cap
        packed = (rest > 0) | (whole == 0)
        at = np.full(len(rows), -1, dtype=np.int64)
        at[packed] = pack(rest[packed], cap)
        used = int(at.max()) + 1 if packed.any() else 0
        base = (int(key[1]) << 36)
        ids = rows["item"].to_numpy()
        out = pd.DataFrame({"item": ids[packed], "part_no": whole[packed], "part_size": rest[packed], "container_id": base + at[packed]})
        if whole.any():
            i = np.repeat(np.arange(len(rows)), whole)
            first = np.repeat(np.cumsum(whole) - whole, whole)
            k = np.arange(len(i)) - first
            out = pd.concat([out, pd.DataFrame({"item": ids[i], "part_no": k, "part_size": cap, "container_id": base + used + np.arange(len(i))})])
        out.insert(0, "kind", key[0])
        return out

    kind_type = containers.schema[kind].dataType.simpleString()
    schema = f"kind {kind_type}, item {of}, part_no bigint, part_size bigint, container_id bigint"
    done = []
    for k in range(0, max(len(given), 1), KINDS_AT_ONCE):
        each = [F.struct(F.lit(r["kind"]).cast(kind_type).alias("kind"), F.lit(r["capacity"]).cast("bigint").alias("capacity")) for r in given[k : k + KINDS_AT_ONCE]]
        to = dealt.select("*", F.explode(F.array(*each) if each else F.array().cast(f"array<struct<kind:{kind_type},capacity:bigint>>")).alias("k")).select("item", "size", "copies", "shard", "k.kind", "k.capacity")
        done.append(to.groupBy("kind", "shard").applyInPandas(one, schema))
    return reduce(DataFrame.unionByName, done).select(F.col("kind").alias(kind), F.col("item").alias(item), "part_no", "part_size", "container_id")


def packing_report(packed: DataFrame, items: DataFrame, containers: DataFrame, item: str = "doc_id", size: str = "tokens", kind: str = "container_kind", capacity: str = "capacity_tokens") -> DataFrame:
    """Per kind: ``containers`` used, ``at_least`` (how many the sizes alone would fill to the brim: no packing can have fewer), ``tokens``, ``filled``; and what must not be: ``over`` (containers above their
    capacity), ``missing`` (items whose parts do not add up to their size), ``divided`` (items of several parts that would fit into one container)."""
    caps = containers.select(F.col(kind).alias("c_kind"), F.col(capacity).cast("bigint").alias("capacity")).where("capacity > 0")
    bins = packed.groupBy(kind, "container_id").agg(F.sum("part_size").alias("used")).join(caps, F.col(kind).eqNullSafe(F.col("c_kind")))
    filled = bins.groupBy(kind, "capacity").agg(F.count(F.lit(1)).alias("containers"), F.sum("used").alias("tokens"), F.count_if(F.col("used") > F.col("capacity")).alias("over"))
    want = items.groupBy(F.col(item).alias("w_item")).agg(F.sum(F.greatest(F.coalesce(F.col(size), F.lit(0)), F.lit(0))).alias("want"), F.count(F.lit(1)).alias("copies"))
    parts = packed.groupBy(F.col(kind).alias("p_kind"), F.col(item).alias("p_item")).agg(F.sum("part_size").alias("got"), F.count(F.lit(1)).alias("parts"))
    both = parts.join(want, F.col("p_item").eqNullSafe(F.col("w_item"))).join(caps, F.col("p_kind").eqNullSafe(F.col("c_kind")))
    seen = both.groupBy("p_kind").agg(F.count(F.lit(1)).alias("seen"), F.count_if(F.col("got") != F.col("want")).alias("unequal"), F.count_if((F.col("parts") > F.col("copies")) & (F.col("want") <= F.col("capacity"))).alias("divided"))
    met = filled.join(seen, F.col(kind).eqNullSafe(F.col("p_kind"))).withColumn("all", F.lit(want.count()))
    return met.select(kind, "capacity", "all", "containers", F.ceil(F.col("tokens") / F.col("capacity")).alias("at_least"), "tokens", (F.col("tokens") / (F.col("containers") * F.col("capacity"))).alias("filled"), "over", (F.col("all") - F.col("seen") + F.col("unequal")).alias("missing"), "divided")

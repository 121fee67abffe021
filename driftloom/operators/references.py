"""References to records that do not exist, and what hangs below them.

One join of all references with all keys tells which targets are missing: those references are orphaned directly. References to orphaned records are
orphaned indirectly: a fixpoint of semi joins walks down the foreign-key graph from the records found so far. The links that it walks double their
reach from round to round (they are joined with themselves), so that a chain of any length below an orphan takes as many rounds as the logarithm of
its length. Only records that are referred to themselves take part; the others take their level from their target at the end, in one join.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..store import Workspace


def orphan_references(references: DataFrame, records: DataFrame, scope: Sequence[str] = ("event_id",), carry: Sequence[str] = (), holds: Mapping[str, str] | None = None, unique: bool = False) -> DataFrame:
    """Every orphaned reference, direct or inherited, once.

    :param references: columns ``ref_table``, scope, ``child_id``, ``target_table``, ``target_id`` and carry: which record of which table names which key
    :param records: columns ``target_table``, scope, ``target_id`` and boolean ``present``; a key that is missing here, or only has rows that are not present, does not exist
    :param holds: the target table that a child table's own records are, where it is not its own name
    :param unique: the caller knows that no reference row repeats and that records have one row per key, which saves two shuffles
    :return: the columns of ``references`` and ``missing_id`` (the key that does not exist, at the top of the chain), ``level`` (0: direct), ``withdrawn`` (the key has a row that is not present; null if inherited)

    A reference whose target is missing has level 0, one whose target is an orphaned record the record's level plus 1; the level of a record is the lowest of its
    references, its ``missing_id`` the least among those of that level. So a record with several references may have several rows, whatever else the
    tables hold. Equal reference rows are one. References with a null target refer to nothing and are no orphans. A null scope matches nothing, so
    such references are orphans. Circles end, as a record takes its lowest level only. Empty tables give an empty result.
    """
    spark, scope, carry = references.sparkSession, list(scope), list(carry)
    ws = Workspace(spark, "references")
    refs = references.where("target_id is not null").select("ref_table", *scope, "child_id", "target_table", "target_id", *carry)
    keys = ["target_table", *scope, "target_id"]
    known = records.select(*keys, F.coalesce("present", F.lit(False)).alias("present"))
    if not unique:
        refs, known = refs.distinct(), known.groupBy(*keys).agg(F.max("present").alias("present"))
    known = known.select(*(F.col(k).alias(f"k_{k}") for k in keys), "present")
    judged = ws.keep(refs.hint("merge").join(known, [F.col(k) == F.col(f"k_{k}") for k in keys], "left").select(*refs.columns, "present"))
    direct = judged.where("not coalesce(present, false)").select(*refs.columns, F.col("target_id").alias("missing_id"), F.lit(0).alias("level"), F.col("present").isNotNull().alias("withdrawn"))
    own = F.coalesce(F.create_map(*(F.lit(x) for kv in holds.items() for x in kv))[F.col("ref_table")], F.col("ref_table")) if holds else F.col("ref_table")
    sk = [f"s{i}" for i in range(len(scope))]

    def key(table: Column, node: str, name: str) -> list[Column]:
        return [table.alias(f"{name}_t"), F.col(node).alias(f"{name}_n")]

    def same(a: str, b: str, of: str = "") -> list[Column]:
        return [*(F.col(x) == F.col(f"{of}{x}") for x in sk), F.col(f"{a}_t") == F.col(f"{b}_t"), F.col(f"{a}_n") == F.col(f"{b}_n")]

    named = [F.col(k).alias(x) for k, x in zip(scope, sk)]
    links = judged.where("present").select(*named, *key(own, "child_id", "c"), *key(F.col("target_table"), "target_id", "a"))
    top = judged.where("not coalesce(present, false)").select(*named, *key(own, "child_id", "f"), F.col("target_id").alias("top")).groupBy(*sk, "f_t", "f_n").agg(F.min("top").alias("top")).withColumn("level", F.lit(0))
    # records that something refers to; and of the scopes only those in which one of them is orphaned
    held = links.select(*(F.col(x).alias(f"h_{x}") for x in sk), "a_t", "a_n").distinct()
    begun = top.join(held, same("f", "a", "h_"), "left_semi")
    read, paths = lambda *p: spark.read.schema(begun.schema).parquet(*p), [ws.write(begun, sized=True)]
    found = read(*paths)
    if scope:
        with_orphans = found.select(*(F.col(x).alias(f"l_{x}") for x in sk)).distinct()
        links = links.join(with_orphans, [F.col(x) == F.col(f"l_{x}") for x in sk], "left_semi")
    inner = links.select(*(F.col(x).alias(f"i_{x}") for x in sk), F.col("a_t").alias("i_t"), F.col("a_n").alias("i_n")).distinct()
    reach, jumps = 1, ws.keep(links.join(inner, same("c", "i", "i_"), "left_semi").distinct(), sized=True)
    while True:  # found: every record up to level reach - 1; jumps: the links over exactly reach steps
        new = jumps.join(found.select(*(F.col(x).alias(f"f_{x}") for x in sk), "f_t", "f_n", "top", "level"), same("a", "f", "f_")).groupBy(*sk, "c_t", "c_n").agg(F.min(F.struct((F.col("level") + reach).alias("level"), "top")).alias("m"))
        had = found.select(*(F.col(x).alias(f"d_{x}") for x in sk), F.col("f_t").alias("d_t"), F.col("f_n").alias("d_n"))
        new = new.join(had, same("c", "d", "d_"), "left_anti").select(*sk, F.col("c_t").alias("f_t"), F.col("c_n").alias("f_n"), "m.top", "m.level")
        at, n = ws.count(new, sized=True)
        if not n["rows"]:
            break
        paths.append(at)
        found = read(*paths)
        had = found.select(*(F.col(x).alias(f"d_{x}") for x in sk), F.col("f_t").alias("d_t"), F.col("f_n").alias("d_n"))
        far = jumps.select(*(F.col(x).alias(f"j_{x}") for x in sk), F.col("c_t").alias("j_t"), F.col("c_n").alias("j_n"), F.col("a_t").alias("b_t"), F.col("a_n").alias("b_n"))
        before, jumps = jumps, ws.keep(jumps.join(had, same("c", "d", "d_"), "left_anti").join(far, same("a", "j", "j_")).select(*sk, "c_t", "c_n", F.col("b_t").alias("a_t"), F.col("b_n").alias("a_n")).distinct(), sized=True)
        ws.forget(before)
        reach *= 2
    above = found.select(*(F.col(x).alias(f"f_{x}") for x in sk), "f_t", "f_n", "top", F.col("level").alias("above"))
    met = judged.where("present").join(above, [*(F.col(k) == F.col(f"f_{x}") for k, x in zip(scope, sk)), F.col("target_table") == F.col("f_t"), F.col("target_id") == F.col("f_n")])
    inherited = met.select(*refs.columns, F.col("top").cast(direct.schema["missing_id"].dataType).alias("missing_id"), (F.col("above") + 1).alias("level"), F.lit(None).cast("boolean").alias("withdrawn"))
    return direct.unionByName(inherited)

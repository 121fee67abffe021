"""Geometry audit and calibration from matched groups: least squares as sums, so one pass over any number of rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..store import Workspace


def line_fit(rows: DataFrame, keys: Sequence[str], x: str, y: str) -> DataFrame:
    """keys, ``slope``, ``intercept``, ``n`` of y ~ x. NaN and null rows do not count."""
    good = rows.where(~F.isnan(F.col(x).cast("double")) & ~F.isnan(F.col(y).cast("double")))
    a, b = F.col(x).cast("double"), F.col(y).cast("double")
    return good.groupBy(*keys).agg(F.regr_slope(b, a).alias("slope"), F.regr_intercept(b, a).alias("intercept"), F.regr_count(b, a).alias("n"))


def plane_fit(rows: DataFrame, keys: Sequence[str], x1: str, x2: str, y: str) -> DataFrame:
    """keys, ``b1``, ``b2``, ``b0``, ``n``, ``sure1``, ``sure2`` of y ~ b0 + b1 x1 + b2 x2, by the normal equations. A slope is sure where its standard error is under 5 % of it. Degenerate keys have nulls."""
    c = {n: F.col(v).cast("double") for n, v in (("a", x1), ("b", x2), ("y", y))}
    good = rows.where(" and ".join(f"not isnan(cast({v} as double)) and {v} is not null" for v in (x1, x2, y)))
    s = good.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), *(F.avg(v).alias(f"m{k}") for k, v in c.items()), *(F.covar_pop(c[p], c[q]).alias(f"s{p}{q}") for p, q in ("aa", "ab", "bb", "ay", "by", "yy"))
    )
    det = F.col("saa") * F.col("sbb") - F.col("sab") * F.col("sab")
    f = s.withColumn("det", F.when(F.abs(det) > 1e-12 * F.col("saa") * F.col("sbb"), det))
    f = f.withColumns({"b1": (F.col("say") * F.col("sbb") - F.col("sby") * F.col("sab")) / F.col("det"), "b2": (F.col("sby") * F.col("saa") - F.col("say") * F.col("sab")) / F.col("det")})
    rest = F.greatest(F.col("syy") - F.col("b1") * F.col("say") - F.col("b2") * F.col("sby"), F.lit(0.0)) / F.greatest(F.col("n") - 3, F.lit(1))
    sure = lambda b, other: F.sqrt(rest * F.col(other) / F.col("det")) < 0.05 * F.abs(F.col(b))
    return f.select(*keys, "b1", "b2", (F.col("my") - F.col("b1") * F.col("ma") - F.col("b2") * F.col("mb")).alias("b0"), "n", sure("b1", "sbb").alias("sure1"), sure("b2", "saa").alias("sure2"))


def medians(rows: DataFrame, keys: Sequence[str], value: str, parts: int = 1024) -> DataFrame:
    """keys, ``n``, ``median``: exact medians of a double column, without any group in one task.

    Each pass cuts the interval that holds a key's middle value into ``parts`` equal ones, counts the values in each (combined in the tasks first), and goes on with the one in which the middle falls, narrowed to its
    least and greatest value; it ends where those are equal. Null, NaN and infinite values do not count; the median of an even number is the mean of the middle two.
    """
    ws = Workspace(rows.sparkSession, "medians")
    v = F.col("v")
    good = ws.keep(rows.select(*(F.col(k).alias(f"k{i}") for i, k in enumerate(keys)), F.col(value).cast("double").alias("v")).where("v is not null and abs(v) < double('infinity')"))
    kk = [f"k{i}" for i in range(len(keys))]
    n = good.groupBy(*kk).agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("low"), F.max("v").alias("high"))
    sides = n.select(*kk, "n", F.explode(F.array(F.floor((F.col("n") + 1) / 2), F.floor(F.col("n") / 2) + 1)).alias("rank"), "low", "high").distinct()
    open_ = ws.keep(sides.withColumn("left", F.col("rank")), sized=True)
    done: list[DataFrame] = []
    while True:
        finished = open_.where("low = high").select(*kk, "n", "rank", F.col("low").alias("v"))
        done.append(finished)
        live = open_.where("low < high")
        at = live.select(*(F.col(c).alias(f"o_{c}") for c in kk), "n", "rank", "left", "low", "high")
        step = (F.col("high") - F.col("low")) / parts
        bin_ = F.least(F.floor((v - F.col("low")) / step), F.lit(parts - 1))
        met = good.join(at, [F.col(c).eqNullSafe(F.col(f"o_{c}")) for c in kk]).where((v >= F.col("low")) & (v <= F.col("high")))
        counts = met.groupBy(*kk, "n", "rank", "left", bin_.alias("bin")).agg(F.count(F.lit(1)).alias("m"), F.min("v").alias("low"), F.max("v").alias("high"))
        w = Window.partitionBy(*kk, "rank").orderBy("bin")
        hit = counts.withColumn("upto", F.sum("m").over(w)).where("upto >= left and upto - m < left").select(*kk, "n", "rank", "low", "high", (F.col("left") - (F.col("upto") - F.col("m"))).alias("left"))
        path, left = ws.count(hit, sized=True)
        if not left["rows"]:
            break
        open_ = rows.sparkSession.read.schema(hit.schema).parquet(path)
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out.groupBy(*kk, "n").agg(F.avg("v").alias("median")).select(*(F.col(c).alias(k) for c, k in zip(kk, keys)), "n", "median")


def residual_check(rows: DataFrame, keys: Sequence[str], residual: Column, tolerance: float, least: int = 8) -> DataFrame:
    """keys, ``n``, ``median`` (exact, of the residuals' sizes) and ``ok``; null with fewer than ``least`` rows. All events count, not only the first ones."""
    out = medians(rows.select(*keys, F.abs(residual).alias("r")), keys, "r")
    return out.select(*keys, "n", "median", F.when(F.col("n") >= least, F.col("median") <= tolerance).alias("ok"))


def stated_problems(geometry: DataFrame) -> DataFrame:
    """What is wrong with stated volumes: volume_id, ``problem``. Needs volume_id, drift_dir, velocity, time_step, pitch_y, pitch_z, and the box."""
    checks = {
        "drift direction is not 1 or -1": ~F.col("drift_dir").isin(1, -1), "empty box": (F.col("x_max") <= F.col("x_min")) | (F.col("y_max") <= F.col("y_min")) | (F.col("z_max") <= F.col("z_min")),
        "velocity is not positive": F.col("velocity") <= 0, "time step is not positive": F.col("time_step") <= 0, "pitch is not positive": (F.col("pitch_y") <= 0) | (F.col("pitch_z") <= 0),
    }
    found = F.array_compact(F.array(*(F.when(F.coalesce(c, F.lit(True)), F.lit(n)) for n, c in checks.items())))
    return geometry.select("volume_id", F.explode(found).alias("problem"))


def calibrated(fits: DataFrame, stated: float, most: float = 0.05) -> DataFrame:
    """Fitted slopes in place of a stated pitch; one that differs by more than ``most`` of it is refused."""
    bad = F.raise_error(F.concat(F.lit("fitted pitch differs too much: "), F.col("slope").cast("string"))).cast("double")
    return fits.withColumn("pitch", F.when(F.abs(F.col("slope") - stated) <= most * abs(stated), F.col("slope")).otherwise(bad))

"""Issues, decisions and run reports as tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def issue_counts(issues: DataFrame, code: str = "code") -> DataFrame:
    """``code``, ``issues``, ``events`` with it."""
    return issues.groupBy(code).agg(F.count(F.lit(1)).alias("issues"), F.count_distinct("event_id").alias("events"))


def run_report(metrics: DataFrame, values: Sequence[str]) -> DataFrame:
    """Least, mean and greatest over all events of each metric: ``metric``, ``least``, ``mean``, ``most``, ``events``."""
    s = metrics.select(F.explode(F.array(*(F.struct(F.lit(v).alias("metric"), F.col(v).cast("double").alias("value")) for v in values))).alias("m")).select("m.*")
    return s.groupBy("metric").agg(F.min("value").alias("least"), F.avg("value").alias("mean"), F.max("value").alias("most"), F.count("value").alias("events"))


def outcome(reason: Column) -> Column:
    """The outcome of a merge decision in one spelling."""
    return F.upper(F.regexp_replace(F.trim(reason), r"(?i)^MergeOutcome\.", ""))


def why_not_merged(decisions: DataFrame, a: Column, b: Column) -> DataFrame:
    """The decisions on a pair, in either order, that did not merge it; none if any merged it."""
    own = decisions.where(((F.col("id1") == a) & (F.col("id2") == b)) | ((F.col("id1") == b) & (F.col("id2") == a))).withColumn("outcome", outcome(F.col("reason")))
    merged = own.where("outcome = 'MERGED'").select(F.col("event_id").alias("m_e"))
    return own.join(merged, F.col("event_id") == F.col("m_e"), "left_anti")


def as_decisions(tried: DataFrame) -> DataFrame:
    """The pairs that a run tried (event_id, child, parent, rule, pass_no, outcome) in the columns that decisions are stored in: event_id, id1, id2, reason, stage, pass_no."""
    return tried.select("event_id", F.col("child").alias("id1"), F.col("parent").alias("id2"), F.col("outcome").alias("reason"), F.col("rule").alias("stage"), "pass_no")


def never_merged(decisions: DataFrame) -> DataFrame:
    """The decisions on pairs, in either order, that no decision merged, with ``outcome`` in one spelling and the pair as ``lo``, ``hi``."""
    x = decisions.withColumns({"outcome": outcome(F.col("reason")), "lo": F.least("id1", "id2"), "hi": F.greatest("id1", "id2")})
    m = x.where("outcome = 'MERGED'").select(F.col("event_id").alias("m_e"), F.col("lo").alias("m_lo"), F.col("hi").alias("m_hi")).distinct()
    return x.join(m, (F.col("event_id") == F.col("m_e")) & (F.col("lo") == F.col("m_lo")) & (F.col("hi") == F.col("m_hi")), "left_anti")


def decision_summary(decisions: DataFrame, by: Sequence[str] = ("stage", "pass_no")) -> DataFrame:
    """How often each outcome came, per stage and pass; null reasons are an outcome."""
    return decisions.groupBy(*by, outcome(F.col("reason")).alias("outcome")).agg(F.count(F.lit(1)).alias("decisions"))


def loader_stalls(batches: DataFrame) -> DataFrame:
    """Per epoch of a loader's log (epoch, wait_s, step_s): batches, seconds waited, and the share of time that the consumer waited."""
    return batches.groupBy("epoch").agg(F.count(F.lit(1)).alias("batches"), F.sum("wait_s").alias("wait_s"), (F.sum("wait_s") / (F.sum("wait_s") + F.sum("step_s"))).alias("stalled"))


def write_decisions(decisions: DataFrame, path: str) -> None:
    """Every decision as a line of JSON, and their summary per rule, pass and outcome beside them: ``path``/decisions and ``path``/summary."""
    decisions.write.mode("errorifexists").json(f"{path}/decisions")
    decisions.groupBy("rule", "pass_no", "outcome").agg(F.count(F.lit(1)).alias("pairs")).write.mode("errorifexists").json(f"{path}/summary")

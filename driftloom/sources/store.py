"""The event store: one Parquet directory per table, bucketed by event and sorted in storage order.

Readers filter on ``event_bucket`` and ``event_id``; the first prunes directories, the second row groups. Nothing is collected to plan a read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKETS = 256
#: What a codec is called in Parquet; names that only other formats have stand for the nearest fast one.
CODECS = {"none": "uncompressed", "gzip": "gzip", "lz4": "lz4", "zstd": "zstd", "snappy": "snappy", "lzf": "snappy", "blosc_lz4": "lz4"}
#: The version of the layout that this engine writes, and those that it reads.
VERSION, READABLE = "4.1", ("4.0", "4.1")


def bucket(event: Column | str = "event_id", buckets: int = BUCKETS) -> Column:
    return F.pmod(F.col(event) if isinstance(event, str) else event, F.lit(buckets)).cast("int")


def write_table(df: DataFrame, root: str, name: str, order: Sequence[str] = (), codec: str = "zstd", buckets: int = BUCKETS, mode: str = "append", parts: int | None = None) -> None:
    """Rows of one table of the store. One shuffle by bucket and part of it, a sort within; a bucket's rows go to ``parts`` files, so that a large event does not wait for one task."""
    b = df.withColumn("event_bucket", bucket(buckets=buckets))
    salt = F.pmod(F.xxhash64(*(order or df.columns[:1])), F.lit(parts)) if parts and parts > 1 else F.lit(0)
    laid = b.repartition("event_bucket", salt).sortWithinPartitions("event_bucket", "event_id", *order)
    laid.write.mode(mode).option("compression", CODECS[codec]).partitionBy("event_bucket").parquet(f"{root}/{name}")
    _write_schema(df, f"{root}/{name}")


def _write_schema(df: DataFrame, path: str) -> None:
    """A file without rows, so that a table without any can be read."""
    df.limit(0).coalesce(1).write.mode("overwrite").parquet(f"{path}/event_bucket=-1")


class EventStore:
    """Reads a store; ``buckets`` as it was written with."""

    def __init__(self, spark: SparkSession, root: str, buckets: int = BUCKETS):
        self.spark, self.root, self.buckets = spark, root, buckets

    def version(self) -> str:
        """The layout's version; a store of another version, or without one, is refused."""
        row = self.spark.read.json(f"{self.root}/meta").where("name = 'version'").select("value").first()
        if row is None or row["value"] not in READABLE:
            raise ValueError(f"layout {row['value'] if row else 'unknown'}: this engine reads {', '.join(READABLE)}")
        return row["value"]

    def table(self, name: str, events: Sequence[int] | None = None) -> DataFrame:
        df = self.spark.read.parquet(f"{self.root}/{name}")
        if events is not None:
            df = df.where(F.col("event_bucket").isin(sorted({e % self.buckets for e in events})) & F.col("event_id").isin(list(events)))
        return df.drop("event_bucket")

    def event_ids(self) -> DataFrame:
        return self.table("particles").select("event_id").distinct()

    def points_of(self, level: str, group: Column, le: bool | None = None, events: Sequence[int] | None = None) -> DataFrame:
        """Points of particles, fragments or instances (``particle``, ``frag``, ``inst``) that satisfy ``group`` (a condition on ``group_id``); ``le``: only low-energy ones, or only others."""
        g = points_with_groups(self.table("points", events), self.table("membership", events), level)
        g = g.where(group)
        return g if le is None else g.where(F.col("is_le") == le)


    def hit_labels(self, events: Sequence[int] | None = None) -> DataFrame:
        return self.table("hit_labels", events)

    def group_owners(self, events: Sequence[int] | None = None) -> DataFrame:
        return self.table("groups", events)

    def issues(self, events: Sequence[int] | None = None) -> DataFrame:
        return self.table("issues", events)

    def sources(self, events: Sequence[int] | None = None) -> DataFrame:
        return self.table("events", events)

    def interaction_of(self, events: Sequence[int] | None = None) -> DataFrame:
        """The particles with the columns of their interaction, null where they have none."""
        return interaction_of(self.table("particles", events), self.table("interactions", events))

    def __len__(self) -> int:
        """The number of events."""
        return self.event_ids().count()

    def __getitem__(self, i: int) -> dict[str, DataFrame]:
        """The tables of the i-th event by id; negative numbers count from the end."""
        n = len(self)
        if not -n <= i < n:
            raise IndexError(i)
        ids = self.event_ids().orderBy("event_id")
        event = ids.offset(i % n).limit(1).first()["event_id"]
        return {t: self.table(t, [event]) for t in self.tables()}

    def __iter__(self):
        """The events' tables one by one, in the order of their ids."""
        for r in self.event_ids().orderBy("event_id").toLocalIterator():
            yield {t: self.table(t, [r["event_id"]]) for t in self.tables()}

    def __enter__(self) -> EventStore:
        return self

    def __exit__(self, *_) -> None:
        pass

    def tables(self) -> list[str]:
        """The names of the tables by event that the store has."""
        jvm = self.spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(self.root)
        found = at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).listStatus(at)
        return sorted(f.getPath().getName() for f in found if f.isDirectory() and f.getPath().getName() != "meta")


def write_meta(spark: SparkSession, root: str, parameters: dict[str, object]) -> None:
    """The layout's version and the run's parameters, as JSON lines of ``name`` and ``value``."""
    rows = [("version", VERSION), *((k, str(v)) for k, v in sorted(parameters.items()))]
    spark.createDataFrame(rows, "name string, value string").coalesce(1).write.mode("errorifexists").json(f"{root}/meta")


def interaction_of(particles: DataFrame, interactions: DataFrame) -> DataFrame:
    """Particles with the columns of their interaction (event_id, interaction_id), prefixed with i_; null where they have none."""
    i = interactions.select(*(F.col(c).alias(f"i_{c}") for c in interactions.columns))
    return particles.join(i, (F.col("event_id") == F.col("i_event_id")) & (F.col("interaction_id") == F.col("i_interaction_id")), "left").drop("i_event_id", "i_interaction_id")


def points_with_groups(points: DataFrame, membership: DataFrame, level: str) -> DataFrame:
    """Points with ``group_id`` at a level (-1 where the particle has no membership) and ``is_le``."""
    col = {"particle": "id", "frag": "frag_id", "inst": "inst_id"}[level]
    m = membership.select(F.col("event_id").alias("m_e"), F.col("id").alias("m_id"), F.col(col).alias("group_id"), F.col("is_le"))
    return points.join(m, (F.col("event_id") == F.col("m_e")) & (F.col("particle_id") == F.col("m_id")), "left").select(*points.columns, F.coalesce("group_id", F.lit(-1)).alias("group_id"), F.coalesce("is_le", F.lit(False)).alias("is_le"))


def hits_of_groups(hits: DataFrame, chosen: DataFrame, group: str = "group_id") -> DataFrame:
    """Hits of the chosen (event_id, group); -1 is never chosen."""
    c = chosen.where(F.col(group) >= 0).select(F.col("event_id").alias("c_e"), F.col(group).alias("c_g"))
    return hits.join(c, (F.col("event_id") == F.col("c_e")) & (F.col(group) == F.col("c_g")), "left_semi")


def groups_of_particles(owners: DataFrame, chosen: DataFrame) -> DataFrame:
    """Groups owned by the chosen (event_id, particle_id)."""
    c = chosen.where(F.col("particle_id") >= 0).select(F.col("event_id").alias("c_e"), F.col("particle_id").alias("c_p"))
    return owners.join(c, (F.col("event_id") == F.col("c_e")) & (F.col("owner") == F.col("c_p")), "left_semi")


def chained(frames: Sequence[DataFrame], event: str = "event_id") -> DataFrame:
    """Inputs one after the other: all rows, with ``input`` (0, 1, ...); ids stay, so (input, event) is the key. Columns that only some have are null elsewhere."""
    if not frames:
        raise ValueError("no inputs")
    out = frames[0].withColumn("input", F.lit(0))
    for i, f in enumerate(frames[1:], 1):
        out = out.unionByName(f.withColumn("input", F.lit(i)), allowMissingColumns=True)
    return out


def first_events(df: DataFrame, n: int, event: str = "event_id") -> DataFrame:
    """All rows of the n events of lowest id; a feature (short runs), pushed down as a filter once the bound is known."""
    bound = df.select(event).distinct().orderBy(event).limit(n).agg(F.max(event)).first()[0]
    return df.where(F.col(event) <= bound) if bound is not None else df.limit(0)


def repack_store(spark: SparkSession, source: str, target: str, codec: str | None = None, tables: Sequence[str] | None = None) -> dict[str, str]:
    """A store's tables (by default all) rewritten, and the codec of each: the one named, or, without one, gzip for what is packed otherwise now and lz4 for what is gzip. The rows are compared afterwards; any difference is an error."""
    done = {}
    for t in tables or EventStore(spark, source).tables():
        to = codec
        if to is None:
            files = spark.read.parquet(f"{source}/{t}").inputFiles()
            held = inspect_compression(spark, files).groupBy("codec").agg(F.sum("packed").alias("n")).orderBy(F.desc("n")).first()
            to = "lz4" if held is not None and held["codec"] == "GZIP" else "gzip"
        repack(spark, f"{source}/{t}", f"{target}/{t}", to)
        if not differences(spark.read.parquet(f"{source}/{t}"), spark.read.parquet(f"{target}/{t}")).isEmpty():
            raise ValueError(f"{t}: rows differ after repacking")
        done[t] = to
    return done


def repack(spark: SparkSession, source: str, target: str, codec: str) -> None:
    """A Parquet directory rewritten with another codec; buckets and order within files stay."""
    df = spark.read.parquet(source)
    w = df.write.option("compression", CODECS[codec])
    (w.partitionBy("event_bucket") if "event_bucket" in df.columns else w).parquet(target)
    if "event_bucket" in df.columns:
        _write_schema(df.drop("event_bucket"), target)


def differences(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows that only one side has, with multiplicity, and ``side``; empty where both hold the same rows."""
    return a.exceptAll(b).withColumn("side", F.lit("a")).unionByName(b.exceptAll(a).withColumn("side", F.lit("b")))


def inspect_compression(spark: SparkSession, files: Sequence[str]) -> DataFrame:
    """Per file and column: codec, compressed and raw bytes, rows, from the footers, read on the executors (local or mounted paths)."""
    import pandas as pd

    def read(batches):
        import pyarrow.parquet as pq

        for b in batches:
            rows = []
            for path in b["path"]:
                m = pq.ParquetFile(path.removeprefix("file://")).metadata
                for g in range(m.num_row_groups):
                    for c in range(m.num_columns):
                        x = m.row_group(g).column(c)
                        rows.append((path, x.path_in_schema, x.compression, x.total_compressed_size, x.total_uncompressed_size, x.num_values))
            yield pd.DataFrame(rows, columns=["path", "name", "codec", "packed", "raw", "n"])

    per = spark.createDataFrame([(f,) for f in files], "path string").repartition(max(1, min(len(files), 200))).mapInPandas(read, "path string, name string, codec string, packed bigint, raw bigint, n bigint")
    return per.groupBy("path", "name", "codec").agg(F.sum("packed").alias("packed"), F.sum("raw").alias("raw"), F.sum("n").alias("n"))

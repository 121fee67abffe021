"""HDF5 event files as a Spark data source, where h5py is installed: one input partition per file and range of events.

    spark.dataSource.register(EventFiles)
    spark.read.format("event_hdf5").option("table", "particle/geant4").schema(...).load("/data/*.h5")
"""

from __future__ import annotations

import glob
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

try:
    import h5py
except ImportError:
    h5py = None

EVENTS_AT_ONCE = 100


class _Range(InputPartition):
    def __init__(self, path: str, start: int, end: int):
        super().__init__((path, start, end))


class EventFiles(DataSource):
    """Datasets of variable length, one entry per event; options ``table`` and ``events`` (per partition). Columns of the schema besides ``event_id``, ``row`` and ``source`` are fields of the records."""

    @classmethod
    def name(cls) -> str:
        return "event_hdf5"

    def schema(self) -> str:
        raise ValueError("event_hdf5 needs a schema: event_id BIGINT, row INT and the fields wanted")

    def reader(self, schema: StructType) -> DataSourceReader:
        if h5py is None:
            raise ImportError("event_hdf5 needs h5py")
        return _Reader(schema, self.options)


class _Reader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict):
        self.fields, self.table, self.step = schema.fieldNames(), options["table"], int(options.get("events", EVENTS_AT_ONCE))
        self.paths = sorted(glob.glob(options["path"]))
        if not self.paths:
            raise FileNotFoundError(options["path"])

    def partitions(self) -> list[InputPartition]:
        out = []
        for p in self.paths:
            with h5py.File(p, "r") as f:
                n = len(f[self.table])
            out += [_Range(p, a, min(a + self.step, n)) for a in range(0, n, self.step)]
        return out

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        path, start, end = partition.value
        with h5py.File(path, "r") as f:
            data = f[self.table]
            for e in range(start, end):
                rows = data[e]
                given = {"event_id": [e] * len(rows), "row": range(len(rows)), "source": [path] * len(rows)}
                yield from zip(*(given[n] if n in given else [x.decode() if isinstance(x, bytes) else x.item() for x in rows[n]] for n in self.fields))

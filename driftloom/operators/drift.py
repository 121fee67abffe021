"""Schemas that drift between files.

Each file has a versioned fingerprint: the dotted paths of its fields and their types. Files with the fingerprint of the file before change nothing and are passed over. Where it differs, the step from
one fingerprint to the other (added, removed, retyped, renamed) is worked out once, however many files take it, and every file that does gets its changes. Chained back through the renames every field
has one lasting name; a file's records are routed through those steps: renamed, cast to the field's type, and filled where absent.

Payloads of any nesting are flattened in Arrow batches, once for the fingerprints and once for the table; everything else is relational.
Fingerprints are per file and field, and the fields of a file are few, so nothing grows with the records after the first aggregate.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..store import Workspace
from .skew import as_of, running

#: Bits of the kinds of value that a field holds somewhere in a file.
BOOLEAN, LONG, DOUBLE, STRING, ARRAY, LIST_BOOLEAN, LIST_LONG, LIST_DOUBLE, LIST_STRING = (1 << i for i in range(9))


class _Written(float):
    """A number that was written with a decimal point or an exponent; ``text`` as it stood there."""

    def __new__(cls, text: str):
        self = super().__new__(cls, text)
        self.text = text
        return self


_decoder = json.JSONDecoder(parse_float=_Written)


def _load(payload: str | None) -> dict | None:
    try:
        value = _decoder.decode(payload.strip()) if payload else None
    except (ValueError, RecursionError):
        return None
    return value if isinstance(value, dict) else None


def _kind(v) -> int:
    if isinstance(v, bool):
        return BOOLEAN
    if isinstance(v, int):
        return LONG
    if isinstance(v, float):
        return DOUBLE
    if isinstance(v, list):
        bits = 0
        for x in v:
            if x is not None:
                bits |= (LIST_BOOLEAN if isinstance(x, bool) else LIST_LONG if isinstance(x, int) else LIST_DOUBLE if isinstance(x, float) else LIST_STRING)
        return bits
    return STRING


def _leaves(value: dict) -> Iterator[tuple[str, object]]:
    stack = [("", value)]
    while stack:
        at, d = stack.pop()
        for k, v in d.items():
            path = f"{at}.{k}" if at else k
            if isinstance(v, dict):
                stack.append((path, v))
            else:
                yield path, v


def file_fields(records: DataFrame, file: str = "file_id", producer: str = "producer", written: str = "written_at", payload: str = "payload") -> DataFrame:
    """The fields of every file: ``producer``, ``file_id``, ``written_at``, ``field_name``, ``field_type``, ``fingerprint``.

    A field is the dotted path of a leaf that holds a value other than null, the empty array or an array of nulls in at least one record. Its type is boolean, long,
    double (written with a decimal point) or string, or array<one of these>; with several in one file string wins over double
    over long, and any other mixture is string (of arrays: array<string>; of an array and a plain value: string). Payloads that are null,
    empty, no JSON or no object are ignored, and so are files of only such; they get one row with a null field, so that they still count as files.
    ``fingerprint`` is a hash of the file's fields and types. A file whose producer or time is null belongs to a producer of its own named null.
    """
    src = records.select(F.col(file).alias("file_id"), F.col(producer).alias("producer"), F.col(written).alias("written_at"), F.col(payload).alias("payload"))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            bits: dict[tuple, int] = {}
            files, payloads = b.column(0).to_pylist(), b.column(1).to_pylist()
            for f, p in zip(files, payloads):
                d = _load(p)
                if d is not None:
                    for path, v in _leaves(d):
                        if v is not None and (k := _kind(v)):
                            bits[f, path] = bits.get((f, path), 0) | k
            keys = list(bits)
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], b.schema.field(0).type), pa.array([k[1] for k in keys], pa.string()), pa.array(list(bits.values()), pa.int32())], names=["file_id", "field_name", "bits"])

    seen = src.select("file_id", "payload").mapInArrow(scan, f"file_id {src.schema['file_id'].dataType.simpleString()}, field_name string, bits int").groupBy("file_id", "field_name").agg(F.bit_or("bits").alias("bits"))
    plain = F.col("bits").bitwiseAND(BOOLEAN | LONG | DOUBLE | STRING)
    lists = F.col("bits").bitwiseAND(LIST_BOOLEAN | LIST_LONG | LIST_DOUBLE | LIST_STRING)

    def name(bits: Column, boolean: int, long: int, double: int) -> Column:
        return F.when(bits == boolean, "boolean").when(bits == long, "long").when((bits == double) | (bits == double + long), "double").otherwise("string")

    kind = F.when((plain > 0) & (lists > 0), "string").when(plain > 0, name(plain, BOOLEAN, LONG, DOUBLE)).otherwise(F.concat(F.lit("array<"), name(lists, LIST_BOOLEAN, LIST_LONG, LIST_DOUBLE), F.lit(">")))
    files = src.groupBy("file_id").agg(F.min("producer").alias("producer"), F.min("written_at").alias("written_at"))
    fields = files.join(seen.select(F.col("file_id").alias("f"), "field_name", kind.alias("field_type")), F.col("file_id") == F.col("f"), "left").drop("f")
    # a file has few fields: they are what is gathered, never its records
    prints = fields.groupBy("producer", "file_id", "written_at").agg(F.md5(F.array_join(F.sort_array(F.collect_list(F.concat_ws(":", "field_name", "field_type"))), "\n")).alias("fingerprint"), F.collect_list(F.when(F.col("field_name").isNotNull(), F.struct("field_name", "field_type"))).alias("fields"))
    prints = Workspace(records.sparkSession, "drift").keep(prints)
    return prints.select("producer", "file_id", "written_at", "fingerprint", F.explode_outer("fields").alias("f")).select("producer", "file_id", "written_at", "fingerprint", "f.field_name", "f.field_type")


def with_versions(fields: DataFrame) -> DataFrame:
    """``fields`` (as ``file_fields`` gives them) with ``file_no`` (the file's place among its producer's files, in the order of time and id) and ``version`` (the producer's fingerprints numbered in the order in which they first came up)."""
    ws = Workspace(fields.sparkSession, "drift")
    files = fields.groupBy("producer", "file_id", "written_at").agg(F.first("fingerprint").alias("fingerprint"))
    ordered = ws.keep(running(files, ["producer"], ["written_at", "file_id"], {"file_no": F.lit(1)}).withColumn("file_no", F.col("file_no").cast("int")))
    firsts = ordered.groupBy("producer", "fingerprint").agg(F.min("file_no").alias("first_no"))
    v = running(firsts, ["producer"], ["first_no"], {"version": F.lit(1)}).select(F.col("producer").alias("v_p"), F.col("fingerprint").alias("v_f"), F.col("version").cast("int").alias("version"))
    told = ordered.join(v, F.col("producer").eqNullSafe(F.col("v_p")) & (F.col("fingerprint") == F.col("v_f"))).select(F.col("file_id").alias("t_id"), "file_no", "version")
    return fields.join(told, F.col("file_id").eqNullSafe(F.col("t_id"))).select("producer", "file_id", "written_at", "file_no", "fingerprint", "version", "field_name", "field_type")


def schema_changes(fields: DataFrame) -> DataFrame:
    """The migration steps: every change of a file against the producer's file before it.

    :param fields: as ``file_fields`` gives them
    :return: ``producer``, ``file_id``, ``file_no``, ``field_name``, ``change_kind``, ``old_name``, ``old_type``, ``new_type``

    ``renamed``: exactly one name of a type is gone and exactly one name of that type appears; one row with the new name. Else ``added``, ``removed``
    or ``retyped``. First files have no changes. Files without any readable record are passed over: the next is compared with the one before.
    """
    ws = Workspace(fields.sparkSession, "drift")
    have = fields.where("field_name is not null").select("producer", "file_id", "written_at", "fingerprint", "field_name", "field_type")
    files = have.groupBy("producer", "file_id", "written_at").agg(F.first("fingerprint").alias("fingerprint"))
    files = ws.keep(running(files, ["producer"], ["written_at", "file_id"], {"no": F.lit(1)}))
    before = files.select(F.col("producer").alias("b_p"), (F.col("no") + 1).alias("b_no"), F.col("fingerprint").alias("from_print"))
    # files whose fingerprint is that of the file before have no changes
    moves = files.join(before, F.col("producer").eqNullSafe(F.col("b_p")) & (F.col("no") == F.col("b_no")) & (F.col("fingerprint") != F.col("from_print"))).select("producer", "file_id", F.col("no").cast("int").alias("file_no"), "from_print", F.col("fingerprint").alias("to_print"))
    moves = ws.keep(moves)
    steps = migration_steps(moves.select("from_print", "to_print").distinct(), have.select("fingerprint", "field_name", "field_type").distinct())
    steps = steps.withColumnsRenamed({"from_print": "s_from", "to_print": "s_to"})
    return moves.join(steps, (F.col("from_print") == F.col("s_from")) & (F.col("to_print") == F.col("s_to"))).select("producer", "file_id", "file_no", "field_name", "change_kind", "old_name", "old_type", "new_type")


def migration_steps(pairs: DataFrame, prints: DataFrame) -> DataFrame:
    """What changes between two fingerprints: ``from_print``, ``to_print``, ``field_name``, ``change_kind``, ``old_name``, ``old_type``, ``new_type``.

    :param pairs: distinct ``from_print``, ``to_print``; :param prints: distinct ``fingerprint``, ``field_name``, ``field_type``
    """
    p = prints.select(F.col("fingerprint").alias("p"), "field_name", "field_type")
    none = F.lit(None).cast("string")
    new = pairs.join(p, F.col("to_print") == F.col("p")).select("from_print", "to_print", "field_name", none.alias("old_type"), F.col("field_type").alias("new_type"))
    old = pairs.join(p, F.col("from_print") == F.col("p")).select("from_print", "to_print", "field_name", F.col("field_type").alias("old_type"), none.alias("new_type"))
    both = new.unionByName(old).groupBy("from_print", "to_print", "field_name").agg(F.max("old_type").alias("old_type"), F.max("new_type").alias("new_type")).where("not (old_type <=> new_type)")
    gone, came = F.col("new_type").isNull(), F.col("old_type").isNull()
    of = Window.partitionBy("from_print", "to_print", "moved")  # the fields of two schemas
    tagged = both.withColumn("moved", F.when(gone | came, F.coalesce("old_type", "new_type")))
    counted = tagged.withColumns({"gone": F.sum(gone.cast("int")).over(of), "came": F.sum(came.cast("int")).over(of), "old_name": F.max(F.when(gone, F.col("field_name"))).over(of)})
    renamed = F.col("moved").isNotNull() & (F.col("gone") == 1) & (F.col("came") == 1)
    return counted.where(~(renamed & gone)).select(
        "from_print", "to_print", "field_name", F.when(renamed, "renamed").when(gone, "removed").when(came, "added").otherwise("retyped").alias("change_kind"),
        F.when(renamed, F.col("old_name")).alias("old_name"), F.when(renamed, F.col("moved")).otherwise(F.col("old_type")).alias("old_type"), "new_type",
    )


def lasting_names(fields: DataFrame, changes: DataFrame) -> DataFrame:
    """``file_id``, ``field_name`` and ``name``: what the field was called before all renames of its producer's earlier files.

    Each producer's changes are chained from file to file. Renames are the links of parent-child trees (a rename's parent is the rename that gave
    the old name), which pointer doubling resolves; a field's rename is the last one up to its file. A name that comes back after it was renamed away is a field of its own: its lasting name
    ends in ``__again``, so that no two fields of a file share one.
    """
    from .hierarchy import resolve_hierarchy

    ws = Workspace(fields.sparkSession, "drift")
    moves = ws.keep(changes.where("change_kind = 'renamed'").select("producer", F.col("file_no").cast("bigint").alias("file_no"), F.col("field_name").alias("to"), F.col("old_name").alias("frm"), F.xxhash64("producer", "file_id", "field_name").alias("id")))
    earlier = moves.select("producer", F.col("to").alias("frm"), F.col("file_no").alias("at"), F.col("id").alias("before"))
    links = ws.keep(as_of(moves.select("producer", "frm", "file_no", "to", "id"), earlier, ["producer", "frm"], "file_no", "at", "before", strict=True).drop("since"))
    roots = resolve_hierarchy(links, "id", "before", path=False).select(F.col("id").alias("i"), "root_id")
    origin = links.select(F.col("id").alias("r"), F.col("frm").alias("origin"))
    given = ws.keep(moves.join(roots, F.col("id") == F.col("i")).join(origin, F.col("root_id") == F.col("r")).select("producer", F.col("to").alias("field_name"), "file_no", "origin"))
    have = fields.where("field_name is not null").select("producer", "file_id", "written_at", "field_name")
    numbered = running(have.select("producer", "written_at", "file_id").distinct(), ["producer"], ["written_at", "file_id"], {"no": F.lit(1)}).select(F.col("file_id").alias("n_id"), "no")
    at = have.join(numbered, F.col("file_id").eqNullSafe(F.col("n_id"))).select("producer", "field_name", "no", "file_id")
    to = as_of(at, given, ["producer", "field_name"], "no", "file_no", "origin").withColumnRenamed("since", "came")
    away = as_of(to, moves.select("producer", F.col("frm").alias("field_name"), "file_no", F.lit(True).alias("left")), ["producer", "field_name"], "no", "file_no", "left")
    back = F.col("left").isNotNull() & (F.col("came").isNull() | (F.col("came") < F.col("since")))
    return away.select("file_id", "field_name", F.when(back, F.concat("field_name", F.lit("__again"))).otherwise(F.coalesce("origin", "field_name")).alias("name"))


def consistent_values(records: DataFrame, key: Sequence[str], names: DataFrame, file: str = "file_id", payload: str = "payload") -> DataFrame:
    """Every value of every record under its lasting name: key, ``field_name``, ``name``, ``value`` (text; arrays as JSON). The long form of ``consistent_table``, for any number of names."""
    given = [records.schema[k] for k in key]
    n = len(key)

    def flat(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, paths, values = [], [], []
            for i, p in enumerate(b.column(n + 1).to_pylist()):
                for k, v in _leaves(_load(p) or {}):
                    if v is not None and v != []:
                        at.append(i)
                        paths.append(k)
                        values.append(_text(v))
            take = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([*(b.column(i).take(take) for i in range(n + 1)), pa.array(paths, pa.string()), pa.array(values, pa.string())], names=[*(f.name for f in given), "__file", "field_name", "value"])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in given), f"`__file` {records.schema[file].dataType.simpleString()}, field_name string, value string"])
    rows = records.select(*key, F.col(file).alias("__file"), F.col(payload).alias("__payload")).mapInArrow(flat, schema)
    to = names.select(F.col("file_id").alias("__n_file"), F.col("field_name").alias("__n_field"), "name")
    return rows.join(to, (F.col("__file") == F.col("__n_file")) & (F.col("field_name") == F.col("__n_field")), "left").select(*key, "field_name", F.coalesce("name", "field_name").alias("name"), "value")


def consistent_table(records: DataFrame, key: Sequence[str], file: str = "file_id", producer: str = "producer", written: str = "written_at", payload: str = "payload", most_columns: int = 2000) -> DataFrame:
    """All records under one schema: the key columns, ``readable``, and a column per lasting field name, of the widest type it had anywhere.

    Records pass the chained steps of their file: rename to the lasting name, cast to the column's type, null (the default) where the file has no such
    field. Arrays and mixtures come as JSON text, dots in names become ``__``. Records that are no JSON object keep their row, with ``readable`` false. More than
    ``most_columns`` names is an error, not a cut: ``consistent_values`` has the same values in long form.
    """
    fields = Workspace(records.sparkSession, "drift").keep(file_fields(records, file, producer, written, payload))
    names = Workspace(records.sparkSession, "drift").keep(lasting_names(fields, schema_changes(fields)))
    typed = fields.where("field_name is not null").select(F.col("file_id").alias("f"), F.col("field_name").alias("n"), "field_type").join(names, (F.col("f") == F.col("file_id")) & (F.col("n") == F.col("field_name")))
    kinds = typed.groupBy("name").agg(F.collect_set("field_type").alias("types")).orderBy("name").limit(most_columns + 1).collect()
    if len(kinds) > most_columns:
        raise ValueError(f"over {most_columns} field names")
    wide = {}
    for r in kinds:
        t = set(r["types"])
        wide[r["name"]] = "boolean" if t == {"boolean"} else "bigint" if t == {"long"} else "double" if t <= {"long", "double"} else "string"
    per_file = names.groupBy(F.col("file_id").alias("__f")).agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("field_name", "name")))).alias("__names"))
    rows = records.join(per_file, F.col(file) == F.col("__f"), "left").select(*key, F.col(payload).alias("__payload"), "__names")
    n = len(key)
    given = [records.schema[k] for k in key]

    def flat(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        maps: dict[str, dict] = {}
        for b in batches:
            names_, out, ok = b.column(n + 1).to_pylist(), [], []
            for p, m in zip(b.column(n).to_pylist(), names_):
                d = _load(p)
                ok.append(d is not None)
                if m is not None and m not in maps:
                    if len(maps) > 1000:
                        maps.clear()
                    maps[m] = json.loads(m)
                to = maps[m] if m is not None else {}
                out.append([(to.get(k, k), _text(v)) for k, v in sorted(_leaves(d)) if v is not None and v != []] if d is not None else [])
            out = [list(dict(x).items()) for x in out]
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(n)), pa.array(ok, pa.bool_()), pa.array(out, pa.map_(pa.string(), pa.string()))], names=[*(f.name for f in given), "readable", "__values"])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in given), "readable boolean", "__values map<string,string>"])
    values = rows.mapInArrow(flat, schema)
    taken = {k.lower() for k in key} | {"readable"}
    column = lambda c: (x if (x := c.replace(".", "__")).lower() not in taken else f"field_{x}")
    return values.select(*key, "readable", *(F.element_at("__values", F.lit(c)).try_cast(t).alias(column(c)) for c, t in wide.items()))


def _text(v) -> str:
    if isinstance(v, _Written):
        return v.text
    if isinstance(v, str):
        return v
    if isinstance(v, bool):
        return "true" if v else "false"
    if isinstance(v, list):
        return "[" + ",".join(json.dumps(x) if isinstance(x, (str, dict, list)) else "null" if x is None else _text(x) for x in v) + "]"
    return str(v)

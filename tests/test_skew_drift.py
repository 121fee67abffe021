"""Skewed keys and drifting schemas."""

import json
import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from driftloom.operators.drift import consistent_table, consistent_values, file_fields, lasting_names, schema_changes, with_versions
from driftloom.operators.skew import as_of, running, skewed_totals


def test_heavy_key_spans_partitions(spark):
    rows = [(1, i, 1.0) for i in range(3000)] + [(k, 0, 2.0) for k in range(2, 40)] + [(None, 1, None), (None, 2, 5.0)]
    df = spark.createDataFrame(rows + rows[:100], "k int, i int, v double")
    got = {r.k: (r.s, r.n, r.spans) for r in skewed_totals(df, ["k"], ["i"], {"s": ("sum", F.col("v")), "n": ("count", F.lit(1))}, partitions=8, unique=True).collect()}
    assert got[1][:2] == (3000.0, 3000) and got[1][2] > 2
    assert got[None][:2] == (5.0, 2) and all(got[k][:2] == (2.0, 1) for k in range(2, 40))
    assert skewed_totals(df.limit(0), ["k"], ["i"], {"s": ("sum", F.col("v"))}).count() == 0


REC = "record_id long, file_id long, producer string, written_at timestamp, payload string, fields string"


def records(spark, files, producer="p"):
    day = datetime(2024, 1, 1)
    out = []
    for i, payloads in enumerate(files):
        for p in payloads:
            out.append((len(out), i + 1, producer, day + timedelta(days=i), p if isinstance(p, str) or p is None else json.dumps(p), "clash"))
    return spark.createDataFrame(out, REC)


FILES = [
    [{"a": 1, "b": "x", "n": {"c": [1]}}, {"a": 2.5, "b": None, "n": {"c": []}}],
    [{"a2": 1.0, "b": "y", "n": {"c": [2]}}],
    [None, "", "no json", "[1]", "3"],
    [{"a2": 2, "b": True, "n": {"c": [2.0, None]}, "new": 1}],
    [{"a3": 7, "b": True, "n": {"c": [1, "s"]}, "new": None, "empty": [], "nulls": [None]}],
]


def test_types_and_changes(spark, rows):
    r = records(spark, FILES)
    fields = file_fields(r)
    types = {(x.file_id, x.field_name): x.field_type for x in fields.collect()}
    assert types[1, "a"] == "double" and types[1, "n.c"] == "array<long>" and types[4, "n.c"] == "array<double>" and types[5, "n.c"] == "array<string>" and types[3, None] is None and (5, "empty") not in types and (5, "nulls") not in types
    got = rows(schema_changes(fields).select("file_id", "field_name", "change_kind"))
    want = [(2, "a2", "renamed"), (4, "a2", "retyped"), (4, "b", "retyped"), (4, "n.c", "retyped"), (4, "new", "added"), (5, "a2", "removed"), (5, "a3", "added"), (5, "n.c", "retyped"), (5, "new", "removed")]
    assert sorted(got) == sorted(want)


def test_consistent_table_follows_renames(spark):
    r = records(spark, [[{"a": 1}], [{"b": 2.5}], [{"c": 3.5}], ["torn"]])
    t = {x.record_id: x.asDict() for x in consistent_table(r, ["record_id", "file_id"]).collect()}
    # a (long) and b (double) are two fields; b was renamed to c
    assert set(t[0]) == {"record_id", "file_id", "readable", "a", "b"}
    assert t[0]["a"] == 1 and t[1]["b"] == 2.5 and t[2]["b"] == 3.5 and t[3]["readable"] is False and t[3]["a"] is None


def test_empty_records(spark):
    r = records(spark, FILES).limit(0)
    assert schema_changes(file_fields(r)).count() == 0
    assert consistent_table(r, ["record_id"]).count() == 0


def test_versions(spark):
    f = with_versions(file_fields(records(spark, [[{"a": 1}], [{"a": 1.5}], [{"a": 2}], [{"z": 2}]])))
    assert {(x.file_id, x.version) for x in f.collect()} == {(1, 1), (2, 2), (3, 1), (4, 3)}


def test_a_name_that_comes_back_is_a_field_of_its_own(spark):
    r = records(spark, [[{"a": 1}], [{"b": 2}], [{"b": 3, "a": 4}], [{"b": 5, "a": 6}], [{"a": 7, "x": "s"}]])
    fields = file_fields(r)
    changes = schema_changes(fields)
    assert {(x.file_id, x.field_name, x.change_kind) for x in changes.collect()} == {(2, "b", "renamed"), (3, "a", "added"), (5, "b", "removed"), (5, "x", "added")}
    names = {(x.file_id, x.field_name): x.name for x in lasting_names(fields, changes).collect()}
    assert names == {(1, "a"): "a", (2, "b"): "a", (3, "b"): "a", (3, "a"): "a__again", (4, "b"): "a", (4, "a"): "a__again", (5, "a"): "a__again", (5, "x"): "x"}
    t = {x.record_id: x.asDict() for x in consistent_table(r, ["record_id"]).collect()}
    assert (t[2]["a"], t[2]["a__again"], t[4]["a"], t[4]["a__again"]) == (3, 4, None, 7)
    values = {(x.record_id, x.name): x.value for x in consistent_values(r, ["record_id"], lasting_names(fields, changes)).collect()}
    assert values == {(0, "a"): "1", (1, "a"): "2", (2, "a"): "3", (2, "a__again"): "4", (3, "a"): "5", (3, "a__again"): "6", (4, "a__again"): "7", (4, "x"): "s"}


def test_renamed_there_and_back(spark):
    fields = file_fields(records(spark, [[{"a": 1}], [{"b": 2}], [{"a": 3}]]))
    assert {x.name for x in lasting_names(fields, schema_changes(fields)).collect()} == {"a"}


def test_equal_fingerprints_change_nothing_and_steps_are_shared(spark):
    files = [[{"a": 1}], [{"a": 2}], [{"a": 1.5, "b": "x"}], [{"a": 1}], [{"a": 2.5, "b": "y"}]]
    got = sorted((x.file_id, x.field_name, x.change_kind) for x in schema_changes(file_fields(records(spark, files))).collect())
    assert got == [(3, "a", "retyped"), (3, "b", "added"), (4, "a", "retyped"), (4, "b", "removed"), (5, "a", "retyped"), (5, "b", "added")]


def test_running_values_over_ranges(spark):
    rng = random.Random(2)
    rows_ = [(rng.choice(["a", "b", None]), i, rng.choice([None, 1, 2, 3])) for i in range(500)] + [("hot", i, 1) for i in range(3000)]
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    got = running(spark.createDataFrame(rows_, "k string, i int, v int"), ["k"], ["i"], {"sum": F.col("v")}, {"last": F.col("v")}).collect()
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    want, at = {}, {}
    for k, i, v in sorted(rows_, key=lambda r: (str(r[0]), r[1])):
        s, last = at.get(k, (0, None))
        at[k] = want[k, i] = (s + (v or 0), v if v is not None else last)
    assert {(r.k, r.i): (r.sum, r.last) for r in got} == want and len(got) == len(rows_)
    assert running(spark.createDataFrame([], "k string, i int"), ["k"], ["i"], {"n": F.lit(1)}).count() == 0


def test_as_of(spark):
    left = spark.createDataFrame([("a", 1, "p"), ("a", 5, "q"), ("b", 5, "r"), (None, 9, "s")], "k string, at int, what string")
    right = spark.createDataFrame([("a", 1, 10), ("a", 5, 20), ("a", 5, 30), (None, 2, 40)], "k string, at int, v int")
    got = lambda strict: {r.what: (r.v, r.since) for r in as_of(left, right, ["k"], "at", "at", "v", strict).collect()}
    assert got(False) == {"p": (10, 1), "q": (30, 5), "r": (None, None), "s": (40, 2)}
    assert got(True) == {"p": (None, None), "q": (10, 1), "r": (None, None), "s": (40, 2)}

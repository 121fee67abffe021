"""Truncated texts on made-up files with known cuts: held-out accuracy by source, and odd inputs."""

import random

import numpy as np
from pyspark.sql import functions as F

from driftloom.llm import truncation
from driftloom.llm.truncation import fit_limits, learned_notes, lengths_of, suspicious_lengths, truncated_texts

SCHEMA = "doc_id long, text string, lang string, source string"
WORDS = [a + b + c for a in ("ba", "ke", "lo", "mi", "su") for b in ("ra", "to", "ne", "") for c in ("x", "l", "n", "")]


def python(rng):
    out = []
    for _ in range(rng.randint(2, 60)):
        f, v = rng.choice(WORDS), rng.choice(WORDS)
        out.append(f"def {f}({v}, limit={rng.randint(1, 99)}):\n    # {' '.join(rng.choice(WORDS) for _ in range(6))}\n    for item in {v}:\n        if item > limit:\n            break\n    return {v}\n")
    return "\n\n".join(out)


def script(rng):
    return "".join(f"const {rng.choice(WORDS)} = ({rng.choice(WORDS)}) => {{\n  return {rng.choice(WORDS)}.map((x) => {rng.choice(WORDS)}(x, {rng.randint(1, 999)}));\n}};\n" for _ in range(rng.randint(2, 60)))


def corpus(n=900):
    rng = random.Random(8)
    docs, cut = [], set()
    for i in range(n):
        lang, source = rng.choice([("py", python), ("js", script)]), rng.choice(["clean", "limited", "noted", "torn"])
        text = lang[1](rng)
        if rng.random() < 0.2:
            text = text.rstrip("\n")
        if source == "limited" and len(text) > 1500:
            text = text[:1500]
            cut.add(i)
        elif source == "noted" and len(text) > 1200:
            text = text[:1200] + " [cut]"
            cut.add(i)
        elif source == "torn" and rng.random() < 0.3:
            k = rng.randint(50, max(51, len(text) - 5))
            if k < len(text):
                text = text[:k]
                cut.add(i)
        docs.append((i, text, lang[0] if rng.random() > 0.05 else None, source))
    return docs, cut


def test_finds_cuts(spark):
    docs, cut = corpus()
    df = spark.createDataFrame(docs, SCHEMA)
    ends = lengths_of(df)
    spikes = suspicious_lengths(ends)
    assert {(r.source, r.at) for r in spikes.where("kind = 'chars'").collect()} == {("limited", 1500), ("noted", 1206)}
    assert {(r.source, r.note) for r in learned_notes(ends, spikes).collect()} == {("noted", " [cut]")}
    rows = truncated_texts(df).collect()
    assert len(rows) == len(docs)
    found = {r.doc_id for r in rows if r.truncated}
    assert len(found & cut) / len(cut) > 0.9
    assert len(found & cut) / len(found) > 0.9
    assert not {i for i in found if docs[i][3] == "clean"} or len({i for i in found if docs[i][3] == "clean"}) <= 3


def test_long_notes_and_cuts_by_bytes(spark):
    rng = random.Random(3)
    note = "\n/* " + "the rest of this file was left out " * 6 + "*/"
    assert len(note) > 200
    docs, cut = [], set()
    for i in range(500):
        text = python(rng) + "# größe ü\n" * rng.randint(0, 9) + python(rng)
        if i % 2 and len(text.encode()) > 1500:
            text = text.encode()[:1500].decode(errors="ignore")
            text += "x" * (1500 - len(text.encode())) + note
            cut.add(i)
        docs.append((i, text, "py", "noted" if i % 2 else "clean"))
    rows = truncated_texts(spark.createDataFrame(docs, SCHEMA)).collect()
    found = {r.doc_id for r in rows if r.truncated}
    assert {r.length_class.split()[0] for r in rows if r.doc_id in cut} == {"note"}
    assert len(found & cut) / len(cut) > 0.9 and len(found & cut) / len(found) > 0.9


def test_long_suffixes_read_the_table_once(spark, monkeypatch):
    """Altered copies of one text share more than any tail; only such texts are looked at again. What other lengths end with too is no note."""
    rng = random.Random(5)
    body, foot = "".join(chr(rng.choice([97, 98, 10, 228, 0x1F600])) for _ in range(1500)), "\n// " + "this file is part of a collection " * 4
    docs = [(i, f"# {i:06d}" + body, "py", "copies") for i in range(12)] + [(20 + i, python(rng), "py", "copies") for i in range(60)]
    docs += [(100 + i, (python(rng) + "x" * 900)[:900] + foot, "py", "footed") for i in range(12)] + [(120 + i, python(rng) + foot, "py", "footed") for i in range(60)]
    df = spark.createDataFrame(docs, SCHEMA)
    ends = lengths_of(df, tail=4096)
    in_tails = {(r.source, r.kind, r.at, r.note) for r in learned_notes(ends, suspicious_lengths(ends)).collect()}
    note = next(docs[0][1][-k:] for k in range(len(docs[0][1]), 0, -1) if sum(d[1].endswith(docs[0][1][-k:]) for d in docs[:12]) >= 0.8 * 12)
    assert len(note) >= 1500 and in_tails == {("copies", "chars", 1508, note), ("copies", "bytes", len(docs[0][1].encode()), note)}

    calls = []
    monkeypatch.setattr(truncation, "lengths_of", lambda *a, **k: calls.append(a) or lengths_of(*a, **k))
    rows = {r.doc_id: r.length_class for r in truncated_texts(df).collect()}
    assert len(calls) == 1 and len(rows) == len(docs)
    assert {rows[i] for i in range(12)} == {"note 1508"} and not any(c.startswith("note") for i, c in rows.items() if i > 11)


def test_limits_are_per_language():
    rng = np.random.default_rng(0)
    lang = np.repeat([0, 1], 2000)
    cut = rng.random(4000) < np.where(lang == 0, 0.6, 0.05)
    odds = np.where(cut, rng.normal(1.5, 1.5, 4000), rng.normal(-1.5, 1.5, 4000))
    limit = fit_limits(lang, np.zeros(4000, dtype=int), odds, np.ones(4000))
    assert limit.shape == (2, 1) and abs(limit[0, 0] + np.log(0.6 / 0.4)) < 0.4 and abs(limit[1, 0] + np.log(0.05 / 0.95)) < 0.6


def test_odd_texts(spark):
    docs = [(1, None, None, None), (2, "", "py", "a"), (3, "x", "py", "a"), (4, "\0\0", "py", None), (5, "a\n" * 60_000, None, "b"), (None, "text", "py", "a"), (6, "größe…", "md", "a")]
    rows = truncated_texts(spark.createDataFrame(docs, SCHEMA).withColumn("tail", F.lit("clash"))).collect()
    assert len(rows) == len(docs)
    assert not any(r.truncated for r in rows if r.doc_id in (1, 2, None))


def test_empty(spark):
    assert truncated_texts(spark.createDataFrame([], SCHEMA)).count() == 0

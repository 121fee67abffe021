"""Token counts, packing and mixing."""

import random

import numpy as np
import pytest

from driftloom.llm.mixing import fit_rates, mix_sources
from driftloom.llm.packing import fill_containers, pack, packing_report
from driftloom.llm.tokens import VOCABULARY, encoding, with_token_counts


def best_fit(sizes, capacity):
    room, out = [], [0] * len(sizes)
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        fits = [(r, b) for b, r in enumerate(room) if r >= sizes[i]]
        if fits:
            b = min(fits)[1]
        else:
            room.append(capacity)
            b = len(room) - 1
        room[b] -= sizes[i]
        out[i] = b
    return out, room


@pytest.mark.parametrize("capacity", [1, 2, 7, 64, 100, 1000])
def test_pack_is_best_fit_decreasing(capacity):
    rng = np.random.default_rng(capacity)
    for n in (0, 1, 2, 50, 400):
        sizes = rng.integers(0, capacity + 1, n)
        at = pack(sizes, capacity)
        _, room = best_fit(sizes.tolist(), capacity)
        assert sorted(np.bincount(at, weights=sizes, minlength=len(room)).tolist()) == sorted(capacity - r for r in room)


def test_token_counts(spark):
    texts = [(1, "hello world"), (2, ""), (3, None), (4, "größe <|endoftext|> \U0001f600"), (5, "x" * 100_000 + " y\n" * 1000)]
    got = {r.doc_id: r.tokens for r in with_token_counts(spark.createDataFrame(texts, "doc_id long, text string"), ["doc_id"]).collect()}
    e = encoding(VOCABULARY)
    assert got == {i: len(e.encode_ordinary(t)) if t else 0 for i, t in texts}
    for _, t in texts:
        if t:
            assert e.decode(e.encode_ordinary(t)) == t


def test_fill_containers(spark):
    rng = random.Random(4)
    items = [(i, rng.randint(0, 120)) for i in range(2000)] + [(5000, 260), (5001, 200), (5002, None), (None, 7), (None, 7), (5003, -3)]
    kinds = spark.createDataFrame([("s", 100), ("l", 1000), ("none", 0), ("null", None)], "container_kind string, capacity_tokens int")
    df = spark.createDataFrame(items, "doc_id long, tokens int").withColumnRenamed("doc_id", "kind")
    got = fill_containers(df, kinds, item="kind", shard_items=500).collect()
    size = {i: max(0, n or 0) for i, n in items if i is not None}
    for k, cap in (("s", 100), ("l", 1000)):
        rows = [r for r in got if r.container_kind == k]
        used: dict = {}
        parts: dict = {}
        for r in rows:
            used[r.container_id] = used.get(r.container_id, 0) + r.part_size
            if r.kind is not None:
                parts.setdefault(r.kind, []).append(r.part_size)
        assert max(used.values()) <= cap
        assert {i: sum(p) for i, p in parts.items()} == size
        assert all(len(p) == 1 for i, p in parts.items() if size[i] <= cap)
        assert sum(r.kind is None for r in rows) == 2
        whole = sum(size.values()) + 14
        assert len([u for u in used.values() if u]) <= whole / cap * 1.05 + 5
    assert {r.container_kind for r in got} == {"s", "l"}
    assert fill_containers(df.limit(0), kinds, item="kind").count() == 0
    assert fill_containers(df, kinds.limit(0), item="kind").count() == 0


def test_equal_items_over_all_shards_and_many_kinds(spark):
    items = spark.range(6000).selectExpr("7L as doc_id", "30 as tokens").unionByName(spark.range(5).selectExpr("id as doc_id", "cast(null as int) as tokens"))
    got = fill_containers(items, spark.createDataFrame([("s", 100)], "container_kind string, capacity_tokens int"), shard_items=500)
    shards = got.selectExpr("container_id >> 36 as shard").groupBy("shard").count().collect()
    assert len(shards) == 13 and max(r["count"] for r in shards) <= 600 and got.count() == 6005
    kinds = spark.createDataFrame([(f"k{i}", 1 << 40 if i % 2 else 64) for i in range(501)], "container_kind string, capacity_tokens long")
    few = spark.createDataFrame([(1, 50), (2, 200)], "doc_id long, tokens int")
    out = fill_containers(few, kinds).collect()
    assert len({r.container_kind for r in out}) == 501
    assert {(r.doc_id, r.part_no, r.part_size) for r in out if r.container_kind == "k1"} == {(1, 0, 50), (2, 0, 200)} and len({r.container_id for r in out if r.container_kind == "k1"}) == 1
    assert sorted(r.part_size for r in out if r.container_kind == "k0" and r.doc_id == 2) == [8, 64, 64, 64]
    report = packing_report(got, items, spark.createDataFrame([("s", 100)], "container_kind string, capacity_tokens int")).first()
    assert (report["over"], report["missing"], report["divided"], report["at_least"]) == (0, 0, 0, 1800)


@pytest.mark.parametrize("capacity", [1 << 21])
def test_sparse_tree(capacity):
    sizes = np.random.default_rng(3).integers(0, capacity // 3, 500)
    _, room = best_fit(sizes.tolist(), capacity)
    assert sorted(np.bincount(pack(sizes, capacity), weights=sizes).tolist()) == sorted(capacity - r for r in room)


def test_rates_meet_targets():
    source, tokens = np.array([0, 0, 1]), np.array([10.0, 20.0, 40.0])
    hard = np.array([[10.0, 20.0, 0.0], [0.0, 0.0, 40.0]])
    soft = np.array([[9.0, 5.0, 4.0], [1.0, 15.0, 36.0]])
    r = fit_rates(source, tokens, soft, np.array([2.0, 2.0, 2.0]), np.array([30.0, 20.0]), soft_weight=1e-6)
    assert np.allclose(hard @ r, [30, 20], atol=0.05) and (r >= 0).all() and (r <= 2).all()
    # against a fine grid, where the soft totals weigh as much as the others
    want, caps = np.array([30.0, 20.0]), np.array([1.0, 2.0, 1.0])
    r = fit_rates(source, tokens, soft, caps, want, soft_weight=1.0)
    cost = lambda x: ((hard @ x - want) ** 2).sum() + ((soft @ x - want) ** 2).sum()
    best = min(cost(np.array([a, b, c])) for a in np.linspace(0, 1, 41) for b in np.linspace(0, 2, 81) for c in np.linspace(0, 1, 41))
    assert cost(r) <= best + 1e-6


def test_thousand_sources_need_no_matrix_of_their_square():
    d, cells = 1000, 5000
    rng = np.random.default_rng(1)
    source, tokens = np.repeat(np.arange(d), 5), rng.uniform(1, 50, cells)
    soft = np.zeros((d, cells), dtype=float)
    soft[source, np.arange(cells)] = tokens
    want = np.bincount(source, tokens, d) * 0.5
    r = fit_rates(source, tokens, soft, np.ones(cells), want, steps=200)
    assert np.abs(np.bincount(source, tokens * r, d) - want).max() < 0.5


DOCS = "doc_id long, text string, source string"
TARGETS = "source string, target_share double, max_repeats int"


def test_mixture(spark):
    rng = random.Random(1)
    words = {"a": "alpha beta gamma", "b": "def return class", "c": "1 2 3 4 5"}
    docs = [(i, " ".join(rng.choice(words[s].split()) for _ in range(rng.randint(5, 60))), s) for i, s in enumerate("a" * 600 + "b" * 300 + "c" * 40)]
    docs += [(2000, None, "a"), (2001, "", "b"), (2002, "text of none", None), (2003, "text", "other")]
    targets = spark.createDataFrame([("a", 0.5, 1), ("b", 0.3, 2), ("c", 0.1, 3), ("ghost", 0.1, 5), ("null", None, None)], TARGETS)
    m = mix_sources(spark.createDataFrame(docs, DOCS), targets)
    shares = {r.source: r for r in m.shares.collect()}
    reach = sum(shares[s].target_share for s in "abc")
    for s in "abc":
        assert abs(shares[s].actual_share - shares[s].target_share / reach) < 0.01
        assert shares[s].most_repeats <= shares[s].max_repeats
    assert shares["ghost"].tokens == 0 and shares["null"].actual_share == 0
    chosen = m.chosen.collect()
    assert {r.source for r in chosen} == {"a", "b", "c"} and min(r.repeats for r in chosen) >= 1
    assert sum(r.repeats * r.tokens for r in chosen) == sum(shares[s].tokens for s in "abc")
    small = mix_sources(spark.createDataFrame(docs, DOCS), targets, total=3000)
    assert abs(small.chosen.selectExpr("sum(tokens * repeats)").first()[0] - 3000 * reach) < 200


def test_mixture_of_nothing(spark):
    docs, targets = spark.createDataFrame([], DOCS), spark.createDataFrame([("a", 1.0, 1)], TARGETS)
    m = mix_sources(docs, targets)
    assert m.chosen.count() == 0 and m.shares.collect()[0].tokens == 0
    none = mix_sources(spark.createDataFrame([(1, "t", "a")], DOCS), targets.limit(0))
    assert none.chosen.count() == 0 and none.shares.count() == 0

"""Texts that stop before their end: a backward character n-gram model of ends against continuations.

Two distributions of the characters before a position are compared, read backwards: before the end of a text, and before any other position (where a text
goes on). Both are tries of contexts of up to ``ORDER`` characters, per language and pooled over all (a language may be labelled wrongly), with counts over every
position of every text. A context is kept where at least ``LEAST`` ends, and one in 1 / ``LEAST_SHARE`` of all ends, have it; beyond it an end is as likely as its parent allows. The
log odds of a text are those of its final context, continuation against end, by the model that explains its end best.

Ends that were cut are among the counted ends, so texts under suspicion do not train: those whose length is one that its source has far more
often than its neighbours (a field limit, in characters or bytes, a block size, or the top of a source that nothing exceeds), and a second round
leaves out the ends that the first one held for cut. Notes
that a feed appends after such a cut are learned: a suffix that nearly all texts of one such length share and others lack; it is taken off first.

The threshold is per language and column (the text of one source): the share of cut texts in each is fitted by expectation maximization on the histogram of log odds. How
a suspicious length shifts the odds is fitted with it, per source: how common that length is among cut texts against whole ones. A text is reported where being cut is likelier than not.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..store import Workspace

ORDER, LEAST, SMOOTH = 16, 2, 1.0
#: A context is kept with at least this share of all ends: at most ORDER * 2 / LEAST_SHARE contexts (3.2 million) are ever kept, however many texts there are.
LEAST_SHARE = 1e-5
#: Characters of a text's end that are looked at for a note at first; more of the texts whose note may be longer.
TAIL = 64
#: A length is suspicious with RATIO times as many texts as lengths around it on average, and SURE nats of evidence (Poisson) that this is no chance.
RATIO, SURE = 8, 12.0
#: A length is also suspicious as a multiple of a BLOCK, or within the last part (above TOP) of a source's lengths.
BLOCK, TOP = 1024, 0.96
#: A note is shared by SHARED of the texts of its length, at least NOTED of them, and ends at most RARE of the source's other texts.
SHARED, NOTED, RARE = 0.8, 8, 0.1
#: What names a suspicious length.
GROUP = ["source", "kind", "at"]
#: Rounds of training; an end with log odds of CLEAN or more trains no further round.
ROUNDS, CLEAN = 2, 2.5
#: Bounds of the fitted share of cut texts: few texts prove neither none nor all. A language is worth PRIOR texts of its source's share.
LOW, HIGH, PRIOR = 1e-3, 0.99, 20.0
_MUL, _ADD = np.uint64(0x9E3779B97F4A7C15), np.uint64(0x632BE59BD9B4E019)


def _mix(h: np.ndarray, char: np.ndarray) -> np.ndarray:
    h = (h ^ (char.astype(np.uint64) + _ADD)) * _MUL
    return h ^ (h >> np.uint64(29))


def _lang_key(lang: str | None) -> np.uint64:
    h = 14695981039346656037
    for b in (lang or "").encode():
        h = (h ^ b) * 1099511628211 % (1 << 64)
    return np.uint64(h | 1)


def _keyed(h: np.ndarray, lang: np.ndarray) -> np.ndarray:
    k = (h ^ lang) * _MUL
    return k ^ (k >> np.uint64(31))


def _characters(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def lengths_of(docs: DataFrame, doc: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source", tail: int = TAIL) -> DataFrame:
    """``doc_id``, ``lang``, ``source``, ``chars``, ``bytes``, ``tail`` (the last characters) and a hash of the text."""
    t = F.coalesce(F.col(text), F.lit(""))
    return docs.select(F.col(doc).alias("doc_id"), F.coalesce(F.col(lang), F.lit("")).alias("lang"), F.coalesce(F.col(source), F.lit("")).alias("source"), F.length(t).alias("chars"), F.octet_length(t).alias("bytes"), F.right(t, F.lit(tail)).alias("tail"), F.xxhash64(t).alias("same"))


def _whole(docs: DataFrame, text: str, source: str) -> DataFrame:
    """``source``, ``chars``, ``bytes``, a hash of the text and the text."""
    t = F.coalesce(F.col(text), F.lit(""))
    return docs.select(F.coalesce(F.col(source), F.lit("")).alias("source"), F.length(t).alias("chars"), F.octet_length(t).alias("bytes"), F.xxhash64(t).alias("same"), t.alias("text"))


def _unlikely(n: Column, expected: Column) -> Column:
    """``n`` texts where about ``expected`` should be: RATIO times as many, and by more than chance."""
    m = expected + 0.05
    return (n >= RATIO * expected) & (n > m) & (n * F.log(n / m) - (n - m) >= SURE)


def suspicious_lengths(ends: DataFrame) -> DataFrame:
    """``source``, ``kind`` (chars, bytes, block, top), ``at``, ``texts``: lengths that a source has far too often. Copies of one text count once. All is derived from the number of texts by length."""
    one = ends.where("chars > 0").groupBy("source", "same").agg(F.first("chars").cast("bigint").alias("chars"), F.first("bytes").cast("bigint").alias("bytes"))
    ws = Workspace(ends.sparkSession, "lengths")
    n = ws.keep(one.groupBy("source", "chars", "bytes").agg(F.count(F.lit(1)).alias("texts")))
    found = []
    for kind in ("chars", "bytes"):
        by = n.groupBy("source", F.col(kind).alias("at")).agg(F.sum("texts").alias("texts"))
        # the average count per length, of the lengths within a bin of about 20 %
        binned = by.withColumn("bin", F.floor(F.log("at") / 0.2))
        near = binned.groupBy(F.col("source").alias("b_s"), F.col("bin").alias("b_b")).agg(F.sum("texts").alias("in_bin"))
        met = binned.join(near, (F.col("source") == F.col("b_s")) & (F.col("bin") == F.col("b_b"))).withColumn("around", (F.col("in_bin") - F.col("texts")) / (F.exp(F.col("bin") * 0.2) * 0.22 + 1))
        found.append(met.where(_unlikely(F.col("texts"), F.col("around"))).select("source", F.lit(kind).alias("kind"), "at", "texts"))
    block = n.groupBy("source").agg(F.coalesce(F.sum(F.when((F.col("bytes") % BLOCK == 0) | (F.col("chars") % BLOCK == 0), F.col("texts"))), F.lit(0)).alias("texts"), F.sum("texts").alias("all"), F.max("chars").alias("top"))
    block = ws.keep(block)
    found.append(block.where(_unlikely(F.col("texts"), F.col("all") / BLOCK)).select("source", F.lit("block").alias("kind"), F.lit(BLOCK).cast("bigint").alias("at"), "texts"))
    top = n.join(block.select(F.col("source").alias("s"), "top"), F.col("source") == F.col("s"))
    within = lambda low, high: F.coalesce(F.sum(F.when((F.col("chars") >= low * F.col("top")) & (F.col("chars") < high), F.col("texts"))), F.lit(0))
    share = top.groupBy("source", "top").agg(within(TOP, F.lit(1 << 62)).alias("texts"), within(TOP**4, TOP * F.col("top")).alias("below"))
    found.append(share.where(_unlikely(F.col("texts"), F.col("below") / 3)).select("source", F.lit("top").alias("kind"), F.ceil(F.col("top") * TOP).alias("at"), "texts"))
    return found[0].unionByName(found[1]).unionByName(found[2]).unionByName(found[3])


def _at(group: Sequence[str]) -> Column:
    """Whether a text is of a suspicious length, given as columns for its source, kind and number."""
    source, kind, at = (F.col(c) for c in group)
    return (F.col("source") == source) & (at == F.when(kind == "chars", F.col("chars")).otherwise(F.col("bytes")))


def _shared_suffixes(texts: DataFrame, of: DataFrame) -> DataFrame:
    """``source``, ``kind``, ``at``, ``note``, ``k`` (its length): the longest suffix that SHARED of a length's texts have. Rows and time grow with the characters of the tails.

    :param texts: ``source``, ``kind``, ``at``, ``tail``
    :param of: ``a_source``, ``a_kind``, ``a_at``, ``all``: how many texts a length has
    """
    same = [F.col(k) == F.col(f"a_{k}") for k in GROUP]
    chars = F.split(F.reverse("tail"), "")
    # where SHARED have a suffix, SHARED have its character at each place: this path of characters, from the end, starts with it
    most = texts.select(*GROUP, F.posexplode(chars).alias("place", "char")).groupBy(*GROUP, "place", "char").agg(F.count(F.lit(1)).alias("n")).join(of, same).where(F.col("n") >= SHARED * F.col("all"))
    path = most.groupBy(*(F.col(k).alias(f"a_{k}") for k in GROUP), "all").agg(F.array_sort(F.collect_list(F.struct("place", "char"))).alias("path"))
    path = path.withColumn("path", F.array_join(F.transform(F.filter("path", lambda x, i: x["place"] == i), lambda x: x["char"]), "")).where("path <> ''")
    leaves = F.array_position(F.zip_with(chars, F.split("path", ""), lambda x, y: x.eqNullSafe(y)), False)
    met = texts.join(path, same).groupBy(*GROUP, "all", "path", F.when(leaves == 0, F.length("path")).otherwise(leaves - 1).cast("int").alias("k")).agg(F.count(F.lit(1)).alias("n"))
    # how many follow the path at least so far
    far = met.withColumn("n", F.sum("n").over(Window.partitionBy(*GROUP).orderBy(F.desc("k")))).where((F.col("k") > 0) & (F.col("n") >= SHARED * F.col("all")))
    return far.groupBy(*GROUP).agg(F.max_by("path", "k").alias("path"), F.max("k").alias("k")).select(*GROUP, F.reverse(F.left("path", F.col("k"))).alias("note"), "k")


def learned_notes(ends: DataFrame, spikes: DataFrame) -> DataFrame:
    """``source``, ``kind`` (chars, bytes), ``at``, ``note``, ``k`` (its length): what nearly all texts of a suspicious length end with, and hardly any other of the source. The longest such suffix of the ``tail``."""
    return _notes(ends, spikes, None)[0]


def _notes(ends: DataFrame, spikes: DataFrame, whole: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """The notes, and ``ends`` with tails that reach ORDER characters beyond them.

    :param whole: ``source``, ``chars``, ``bytes``, ``same``, ``text`` of every row of ``ends``, for notes that may be longer than TAIL. Only texts that end as such a note does are looked at again.
    """
    spark = ends.sparkSession
    ws = Workspace(spark, "notes")
    at = spikes.where(F.col("kind").isin("chars", "bytes")).select(F.col("source").alias("s"), "kind", "at")
    texts = ws.keep(ends.join(at, _at(["s", "kind", "at"])).groupBy("source", "kind", "at", "same").agg(F.first("tail").alias("tail")), sized=True)
    of = ws.keep(texts.groupBy(*(F.col(k).alias(f"a_{k}") for k in GROUP)).agg(F.count(F.lit(1)).alias("all")).where(F.col("all") >= NOTED), sized=True)

    def shared_suffixes(texts: DataFrame, most: int) -> tuple[DataFrame, bool]:
        """The shared suffixes, and whether any is longer than ``most``."""
        path, n = ws.count(_shared_suffixes(texts, of), sized=True, long=F.col("k") > most)
        return spark.read.schema("source string, kind string, at bigint, note string, k int").parquet(path), n["long"] > 0

    short, more = shared_suffixes(texts, TAIL - ORDER)
    own = short.select(*(F.col(k).alias(f"w_{k}") for k in GROUP))

    def others(of: DataFrame) -> DataFrame:
        return of.where("chars > 0").join(own, _at(["w_source", "w_kind", "w_at"]), "left_anti")

    def rare(shared: DataFrame, often: DataFrame) -> DataFrame:
        """Those that are no natural end of file, which is common at other lengths too."""
        return shared.join(often, (F.col("source") == F.col("o_source")) & (F.col("note") == F.col("o_note")), "left").where(F.col("often").isNull() | (F.col("often") < RARE)).select(*GROUP, "note", "k")

    def named(shared: DataFrame) -> DataFrame:
        return shared.select(F.col("source").alias("o_source"), F.col("note").alias("o_note")).distinct()

    def by_tail(shared: DataFrame) -> DataFrame:
        return rare(shared, others(ends).join(named(shared), F.col("source") == F.col("o_source")).groupBy("o_source", "o_note").agg(F.avg(F.endswith(F.col("tail"), F.col("o_note")).cast("int")).alias("often")))

    if whole is None or not more:
        return by_tail(short), ends
    long = short.where(F.col("k") > TAIL - ORDER)
    last = lambda c: F.right(c, F.lit(TAIL - ORDER + 1))
    first = ws.keep(long.select(F.col("source").alias("l_source"), last(F.col("note")).alias("l_last")).distinct(), sized=True)
    deep = ws.keep(whole.join(first, (F.col("source") == F.col("l_source")) & (last(F.col("text")) == F.col("l_last")), "left_semi"), sized=True)  # copies pack to next to nothing
    found, tail = [], TAIL
    while more:
        tail *= 4
        now = long.select(*(F.col(k).alias(f"l_{k}") for k in GROUP))
        texts = deep.join(now, _at(["l_source", "l_kind", "l_at"])).groupBy("source", F.col("l_kind").alias("kind"), F.col("l_at").alias("at"), "same").agg(F.first(F.right("text", F.lit(tail))).alias("tail"))
        shared, more = shared_suffixes(ws.keep(texts, sized=True), tail - ORDER)
        found.append(shared.where(F.col("k") <= tail - ORDER))
        long = shared.where(F.col("k") > tail - ORDER)
    long = ws.keep(reduce(DataFrame.unionByName, found), sized=True)
    ending = others(deep).join(named(long), (F.col("source") == F.col("o_source")) & (last(F.col("text")) == last(F.col("o_note"))) & F.endswith(F.col("text"), F.col("o_note"))).groupBy("o_source", "o_note").agg(F.count(F.lit(1)).alias("n"))
    total = others(ends).join(first.select("l_source").distinct(), F.col("source") == F.col("l_source"), "left_semi").groupBy(F.col("source").alias("t_source")).agg(F.count(F.lit(1)).alias("of"))
    long = ws.keep(rare(long, ending.join(total, F.col("o_source") == F.col("t_source")).select("o_source", "o_note", (F.col("n") / F.col("of")).alias("often"))), sized=True)
    held = long.select(*(F.col(k).alias(f"h_{k}") for k in GROUP), "note", "k")
    longer = deep.join(held, _at(["h_source", "h_kind", "h_at"]) & F.endswith(F.col("text"), F.col("note"))).groupBy(F.col("source").alias("b_source"), F.col("same").alias("b_same")).agg(F.max_by(F.right("text", F.col("k") + ORDER), "k").alias("b_tail"))
    longer = ws.keep(longer, sized=True)
    ends_ = ends.join(longer, (F.col("source") == F.col("b_source")) & (F.col("same") == F.col("b_same")), "left").select(*(F.coalesce("b_tail", "tail").alias("tail") if c == "tail" else F.col(c) for c in ends.columns))
    return by_tail(short.where(F.col("k") <= TAIL - ORDER)).unionByName(long), ends_


def _contexts(ends: DataFrame) -> DataFrame:
    """Keys of the final contexts: ``doc_id``, ``trains``, ``model`` (0 pooled, 1 language), ``k``, ``key``, ``parent``."""
    kind = ends.schema["id"].dataType.simpleString()

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = b.num_rows
            tails = np.zeros((n, ORDER), dtype=np.uint32)
            size = np.zeros(n, dtype=np.int64)
            for i, t in enumerate(b.column(3).to_pylist()):
                e = _characters(t[-ORDER:])
                size[i] = len(e)
                tails[i, : len(e)] = e[::-1]
            lang = np.array([_lang_key(x) for x in b.column(2).to_pylist()], dtype=np.uint64)
            h = np.zeros(n, dtype=np.uint64)
            last = [np.zeros(n, dtype=np.uint64), _keyed(h, lang)]
            for k in range(1, ORDER + 1):
                h = _mix(h, tails[:, k - 1])
                at = np.flatnonzero(size >= k)
                if not len(at):
                    break
                take = pa.array(at)
                for model, now in enumerate((h.copy(), _keyed(h, lang))):
                    yield pa.RecordBatch.from_arrays([b.column(0).take(take), b.column(1).take(take), pa.array(np.full(len(at), model), pa.int32()), pa.array(np.full(len(at), k), pa.int32()), pa.array(now[at].view(np.int64)), pa.array(last[model][at].view(np.int64))], names=["id", "trains", "model", "k", "key", "parent"])
                    last[model] = now

    return ends.select("id", "trains", "lang", "tail").mapInArrow(keys, f"id {kind}, trains boolean, model int, k int, key bigint, parent bigint")


def _slots(kept: DataFrame, contexts: int) -> np.ndarray:
    """A table of bits, packed, with one set for each kept key: what the executors need to know of the contexts, to pass over the others. Sixteen bits a context, gathered in pieces of 4 KB, so at most 8 MB, as their number is bounded."""
    bits = max(16, int(16 * contexts).bit_length())
    v = F.col("key").bitwiseAND((1 << bits) - 1) + 1
    pieces = kept.groupBy(F.bitmap_bucket_number(v).alias("piece")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(v)).alias("bits")).toArrow()
    packed = np.zeros((1 << bits) // 8, dtype=np.uint8)
    for at, b in zip(pieces.column(0).to_pylist(), pieces.column(1).to_pylist()):
        packed[(at - 1) * 4096 : (at - 1) * 4096 + len(b)] = np.frombuffer(b, dtype=np.uint8)
    return packed


def _continuations(docs: DataFrame, text: str, lang: str, packed: np.ndarray) -> DataFrame:
    """``key``, ``n``: how often each kept context stands before a position where a text goes on, over all positions of all texts; and the roots."""
    mask = np.uint64(len(packed) * 8 - 1)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = np.unpackbits(packed, bitorder="little").view(bool)
        sums: dict[int, int] = {}

        def add(found: np.ndarray) -> None:
            if len(found):
                for k, n in zip(*(x.tolist() for x in np.unique(found.view(np.int64), return_counts=True))):
                    sums[k] = sums.get(k, 0) + n

        for b in batches:
            by: dict[str, list[str]] = {}
            for t, lg in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if t:
                    by.setdefault(lg or "", []).append(t)
            for lg, texts in by.items():
                key, group, size = _lang_key(lg), [], 0
                for j, t in enumerate(texts):
                    group.append(t)
                    size += len(t)
                    if size < 1 << 20 and j < len(texts) - 1:
                        continue
                    gap = "\0" * ORDER
                    flat = _characters(gap + gap.join(group) + gap)
                    goes_on = flat != 0
                    goes_on[:-1] &= flat[1:] != 0  # not before an end
                    at = np.flatnonzero(goes_on)
                    group, size = [], 0
                    sums[0] = sums.get(0, 0) + len(at)
                    root = int(_keyed(np.zeros(1, dtype=np.uint64), np.array([key]))[0].astype(np.int64))
                    sums[root] = sums.get(root, 0) + len(at)
                    h = np.zeros(len(at), dtype=np.uint64)
                    for k in range(ORDER):
                        char = flat[at - k]
                        h = _mix(h, char)
                        hit = kept[(h & mask).astype(np.int64)] & (char != 0)
                        at, h = at[hit], h[hit]
                        if not len(at):
                            break
                        add(h)
                        own = _keyed(h, key)
                        add(own[kept[(own & mask).astype(np.int64)]])
            if len(sums) > 1 << 20:
                yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int64()), pa.array(list(sums.values()), pa.int64())], names=["key", "n"])
                sums = {}
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int64()), pa.array(list(sums.values()), pa.int64())], names=["key", "n"])

    return docs.select(text, lang).mapInArrow(count, "key bigint, n bigint").groupBy("key").agg(F.sum("n").alias("n"))


def end_log_odds(docs: DataFrame, ends: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """``id``, ``log_odds`` of the final context: continuation against end.

    :param ends: ``id`` (unique), ``lang``, ``tail``, ``trains``
    """
    spark = docs.sparkSession
    ws = Workspace(spark, "truncation")
    contexts = ws.keep(_contexts(ends))
    whole = contexts.where("trains and model = 0 and k = 1").count()
    least = max(LEAST, int(np.ceil(whole * LEAST_SHARE)))
    ended = contexts.where("trains").groupBy("model", "k", "key", "parent").agg(F.count(F.lit(1)).alias("ends")).where(F.col("ends") >= least)
    at, n = ws.count(ended)
    ended = spark.read.schema(ended.schema).parquet(at)
    on = ws.keep(_continuations(docs, text, lang, _slots(ended, n["rows"])), sized=True)
    on_ = on.select(F.col("key").alias("o_key"), F.col("n").alias("on"))
    out = None
    for _ in range(ROUNDS):
        # ends that the last round held for cut train no longer; contexts only become fewer, so the continuations stay as counted
        now = contexts.where("trains") if out is None else contexts.where("trains").join(out.where(F.col("log_odds") < CLEAN).select(F.col("id").alias("c_id")), F.col("id") == F.col("c_id"), "left_semi")
        if out is not None:
            ended = ws.keep(now.groupBy("model", "k", "key", "parent").agg(F.count(F.lit(1)).alias("ends")).where(F.col("ends") >= least))
        roots = now.where("k = 1").groupBy(F.col("parent").alias("r_key")).agg(F.count(F.lit(1)).alias("r_ends"))
        nodes = ws.keep(ended.join(on_, F.col("key") == F.col("o_key"), "left").select("model", "k", "key", "parent", "ends", F.coalesce("on", F.lit(0)).alias("on")), sized=True)
        above = nodes.select(F.col("key").alias("p_key"), F.col("ends").alias("p_ends"), F.col("on").alias("p_on")).unionByName(
            roots.join(on_, F.col("r_key") == F.col("o_key"), "left").select(F.col("r_key").alias("p_key"), F.col("r_ends").alias("p_ends"), F.coalesce("on", F.lit(0)).alias("p_on"))
        )
        goes = (F.col("on") + 0.05) / (F.col("p_on") + 0.05 * 64)
        stops = (F.col("ends") + SMOOTH * goes) / (F.col("p_ends") + SMOOTH)
        steps = nodes.join(above, F.col("parent") == F.col("p_key")).select(F.col("key").alias("s_key"), F.log(goes / stops).alias("step"), F.log((F.col("ends") + SMOOTH) / SMOOTH).alias("leaves"))
        met = contexts.select("id", "model", "k", "key").join(ws.keep(steps, sized=True), F.col("key") == F.col("s_key"), "left")
        per = met.groupBy("id", "model").agg(F.sum("step").alias("sum"), F.max(F.when(F.col("step").isNotNull(), F.col("k"))).alias("deep"), F.max_by("leaves", F.when(F.col("step").isNotNull(), F.col("k"))).alias("leaves"))
        # a text leaves the trie below its last context; one whose very last byte no end has leaves it at the root
        odds = F.when(F.col("deep").isNull(), F.lit(float(np.log(1000.0)))).otherwise(F.col("sum") + F.when(F.col("deep") < ORDER, F.col("leaves")).otherwise(0))
        out = ws.keep(per.groupBy("id").agg(F.min(odds).alias("log_odds")), sized=True)
    return out


def fit_limits(lang: np.ndarray, kind: np.ndarray, odds: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Per (lang, kind), lang by kind: the log odds above which a text is likelier cut than not, by expectation maximization on one source's histogram.

    lang, kind: codes from 0; odds: log likelihood ratios of the final context, cut against whole; weight: texts. Fitted are the share of cut texts per language (drawn to the source's), and
    how the kinds of length are distributed among cut texts and among whole ones.
    """
    langs, kinds = int(lang.max()) + 1, int(kind.max()) + 1
    edge = np.log(HIGH / (1 - HIGH))
    share, shift = np.full(langs, 0.2), np.zeros(kinds)
    total, of_lang = weight.sum(), np.bincount(lang, weight, langs)
    of_kind = np.bincount(kind, weight, kinds)
    known = np.full((langs, kinds), 0.0)
    for _ in range(300):
        prior = np.clip(np.log(share / (1 - share))[:, None] + shift[None, :], np.log(LOW / (1 - LOW)), edge)
        p = 1 / (1 + np.exp(-np.clip(odds + prior[lang, kind], -60, 60)))
        cut = p * weight
        all_ = cut.sum() / max(total, 1)
        new = np.clip((np.bincount(lang, cut, langs) + PRIOR * all_) / (of_lang + PRIOR), LOW, HIGH)
        in_cut, in_whole = np.bincount(kind, cut, kinds), of_kind - np.bincount(kind, cut, kinds)
        shift = np.log((in_cut + 0.5) / (in_cut.sum() + 0.5 * kinds)) - np.log((np.maximum(in_whole, 0) + 0.5) / (max(in_whole.sum(), 0) + 0.5 * kinds))
        moved = np.abs(new - share).max()
        share, known = new, prior
        if moved < 1e-6:
            break
    return -known


def truncated_texts(docs: DataFrame, doc: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """Every document with its verdict.

    :return: ``doc_id``, ``source``, ``lang``, ``length_class`` (how its length is suspicious, or ``other``), ``log_odds``, ``limit`` (the threshold of its language and source, for its length class), ``truncated``

    Null or empty texts are not truncated. A null language or source is one of its own. Texts are read whole; nothing depends on their
    length but the classes. Document ids are unique; rows that repeat one give repeated rows (ids may be null, such rows do not get odds and are
    not truncated). An empty table gives an empty result.
    """
    spark = docs.sparkSession
    ws = Workspace(spark, "truncation")
    ends = ws.keep(lengths_of(docs, doc, text, lang, source))
    spikes = ws.keep(suspicious_lengths(ends))
    notes, ends = _notes(ends, spikes, _whole(docs, text, source))
    notes = ws.keep(notes, sized=True)

    def spike(kind: str) -> DataFrame:
        return spikes.where(F.col("kind") == kind).select(F.col("source").alias(f"{kind}_s"), F.col("at").alias(f"{kind}_at"))

    def note(kind: str) -> DataFrame:
        return notes.where(F.col("kind") == kind).select(F.col("source").alias(f"n_{kind}_s"), F.col("at").alias(f"n_{kind}"), F.col("note").alias(f"note_{kind}"))

    e = ends
    for k in ("chars", "bytes"):
        e = e.join(note(k), (F.col("source") == F.col(f"n_{k}_s")) & (F.col(k) == F.col(f"n_{k}")) & F.endswith(F.col("tail"), F.col(f"note_{k}")), "left")
        e = e.join(spike(k), (F.col("source") == F.col(f"{k}_s")) & (F.col(k) == F.col(f"{k}_at")), "left")
    e = e.join(spike("block"), (F.col("source") == F.col("block_s")) & ((F.col("bytes") % F.col("block_at") == 0) | (F.col("chars") % F.col("block_at") == 0)), "left")
    e = e.join(spike("top"), (F.col("source") == F.col("top_s")) & (F.col("chars") >= F.col("top_at")), "left")
    e = e.withColumn("note", F.coalesce("note_chars", "note_bytes"))
    named = lambda kind, at: F.concat_ws(" ", F.lit(kind), at.cast("string"))
    kind: Column = (
        F.when(F.col("note_chars").isNotNull(), named("note", F.col("chars"))).when(F.col("note_bytes").isNotNull(), named("note bytes", F.col("bytes")))
        .when(F.col("bytes_at").isNotNull(), named("bytes", F.col("bytes"))).when(F.col("chars_at").isNotNull(), named("chars", F.col("chars")))
        .when(F.col("block_at").isNotNull(), named("block", F.col("block_at"))).when(F.col("top_at").isNotNull(), named("top", F.col("top_at"))).otherwise("other")
    )
    body = F.when(F.col("note").isNotNull(), F.expr("left(tail, length(tail) - length(note))")).otherwise(F.col("tail"))
    e = ws.keep(e.select(F.col("doc_id").alias("id"), "lang", "source", F.right(body, F.lit(ORDER)).alias("tail"), kind.alias("length_class"), (F.col("chars") > 0).alias("has")).withColumn("trains", (F.col("length_class") == "other") & F.col("has")))
    odds = end_log_odds(docs, e.where("has and id is not null").dropDuplicates(["id"]), text, lang)
    all_ = ws.keep(e.join(odds.withColumnRenamed("id", "o_id"), F.col("id") == F.col("o_id"), "left").select("id", "source", "lang", "length_class", "log_odds"))
    # a row per source, language, class and tenth of log odds: its size does not grow with the texts
    bins = all_.where("log_odds is not null").groupBy("source", "lang", "length_class", F.round("log_odds", 1).alias("odds")).agg(F.count(F.lit(1)).alias("n"))

    def limits(rows: pd.DataFrame) -> pd.DataFrame:
        l, langs = pd.factorize(rows["lang"], sort=True)
        c, classes = pd.factorize(rows["length_class"], sort=True)
        fitted = fit_limits(l, c, rows["odds"].to_numpy(float), rows["n"].to_numpy(float))
        i, j = np.divmod(np.arange(fitted.size), len(classes))
        return pd.DataFrame({"l_source": rows["source"].iloc[0], "l_lang": langs[i], "l_class": classes[j], "limit": fitted.ravel()})

    limit = ws.keep(bins.groupBy("source").applyInPandas(limits, "l_source string, l_lang string, l_class string, limit double"), sized=True)
    met = all_.join(limit, (F.col("source") == F.col("l_source")) & (F.col("lang") == F.col("l_lang")) & (F.col("length_class") == F.col("l_class")), "left")
    return met.select(F.col("id").alias("doc_id"), "source", "lang", "length_class", "log_odds", "limit", F.coalesce(F.col("log_odds") > F.col("limit"), F.lit(False)).alias("truncated"))

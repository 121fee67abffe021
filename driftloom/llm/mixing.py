"""Mixing sources to target weights: soft membership, document rates by projected gradient, and exact rounding.

1. A classifier learns from the labelled rows: multinomial naive Bayes on hashed tokens, fit on a sample of about ``FIT_ROWS`` rows, as many of each source (all of a source with fewer). One pass over all whole texts then gives each
   document its tokens and its posterior over the domains.
2. Documents with one source and one cell (how sure the classifier is of their own source) share a rate. The token totals of the cells, summed over all documents by the tasks that score them, hold
   everything that the least squares need: every source's own tokens and every domain's expected tokens are linear in the rates, and so is the gradient. Projected
   gradient descent keeps rates between 0 and the source's cap. The totals by the stored label are what is asked for, so they weigh most;
   the expected totals decide between documents of one source. There are ``SURE_CELLS`` cells per source, whatever the corpus.
3. Rates become whole repeats. The whole part is given to every document of a cell, the rest in the order of a hash divided by the
   rest, up to the source's token budget; the place where a source's budget ends is found by a radix histogram, digit by digit, with sums that every task
   combines first. A source's total then misses its target by less than one document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..store import Workspace
from .tokens import VOCABULARY, encoding

#: Rows that the classifier is fit on, about, at most; the same number of each source.
FIT_ROWS = 4000
#: Hashed token features, and how strongly the mean log likelihood of a text decides.
BUCKETS, SHARPNESS = 4096, 20.0
#: Weight of the soft totals against the totals by label; cells by how sure the classifier is of a document's own source.
SOFT, SURE_CELLS = 0.05, 20
#: Digits of the radix selection: LEVELS digits of DIGIT bits.
DIGIT, LEVELS = 12, 4


def fit_domains(docs: DataFrame, domains: list[str], source: str = "source", text: str = "text", vocabulary: str = VOCABULARY, fit_rows: int = FIT_ROWS) -> np.ndarray:
    """Log weights (domains x buckets) of a naive Bayes classifier, from about ``fit_rows`` labelled rows chosen by hash, spread evenly over the domains; the counts are summed on the executors."""
    labelled = docs.where(F.col(source).isin(domains))
    of = labelled.groupBy(F.col(source).alias("f_s")).agg(F.count(F.lit(1)).alias("n")).select("f_s", F.greatest(F.lit(1), F.ceil(F.col("n") * len(domains) / fit_rows)).cast("bigint").alias("every"))
    of = Workspace(docs.sparkSession, "mixing").keep(of, sized=True)  # known to be small, lest the texts be shuffled to meet it
    some = labelled.join(of, F.col(source) == F.col("f_s")).where(F.pmod(F.xxhash64(text), F.col("every")) == 0).select(F.col(source).alias("source"), F.col(text).alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, sums = encoding(vocabulary).encode_ordinary, {}
        for b in batches:
            for s, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if t:
                    c = np.bincount(np.asarray(encode(t), dtype=np.int64) % BUCKETS, minlength=BUCKETS)
                    sums[s] = sums[s] + c if s in sums else c
        for s, c in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([s] * BUCKETS), pa.array(range(BUCKETS), pa.int32()), pa.array(c, pa.int64())], names=["source", "bucket", "n"])

    rows = some.mapInArrow(count, "source string, bucket int, n bigint").groupBy("source", "bucket").agg(F.sum("n").alias("n")).collect()  # domains x BUCKETS at most
    counts = np.full((len(domains), BUCKETS), 0.5)
    at = {d: i for i, d in enumerate(domains)}
    for r in rows:
        counts[at[r["source"]], r["bucket"]] += r["n"]
    return np.log(counts / counts.sum(axis=1, keepdims=True))


def scored(docs: DataFrame, weights: np.ndarray, domains: list[str], doc: str = "doc_id", source: str = "source", text: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """One pass over the whole texts: a row per document (``doc_id``, ``source``, ``tokens``, ``cell``), and rows without a document that hold what a task's documents add up to (``source``, ``cell``, ``domain``, ``soft``: expected tokens).

    ``cell`` is how sure the classifier is that a document is of its own source, from 0 to SURE_CELLS - 1; null for sources that are no domain. An empty or null text has no tokens and an even posterior.
    """
    d, at = weights.shape[0], {n: i for i, n in enumerate(domains)}

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, w = encoding(vocabulary).encode_ordinary, np.ascontiguousarray(weights.T.astype(np.float32))
        sums: dict[tuple[int, int], np.ndarray] = {}
        for b in batches:
            n, cells = [], []
            for s, t in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                ids = np.asarray(encode(t), dtype=np.int64) if t else np.empty(0, dtype=np.int64)
                n.append(len(ids))
                if s not in at:
                    cells.append(None)
                    continue
                mean = w[ids % BUCKETS].mean(axis=0) * SHARPNESS if len(ids) else np.zeros(d)
                e = np.exp(mean - mean.max())
                post = e / e.sum()
                c = min(int(post[at[s]] * SURE_CELLS), SURE_CELLS - 1)
                cells.append(c)
                if len(ids):
                    sums[at[s], c] = sums.get((at[s], c), 0.0) + post * len(ids)
            k = b.num_rows
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n, pa.int64()), pa.array(cells, pa.int32()), pa.nulls(k, pa.int32()), pa.nulls(k, pa.float64())], names=["doc_id", "source", "tokens", "cell", "domain", "soft"])
        for (s, c), v in sums.items():
            yield pa.RecordBatch.from_arrays([pa.nulls(d, kind_), pa.array([domains[s]] * d, pa.string()), pa.nulls(d, pa.int64()), pa.array([c] * d, pa.int32()), pa.array(range(d), pa.int32()), pa.array(v, pa.float64())], names=["doc_id", "source", "tokens", "cell", "domain", "soft"])

    kind = docs.schema[doc].dataType.simpleString()
    kind_ = to_arrow_type(docs.schema[doc].dataType)
    return docs.select(F.col(doc).alias("doc_id"), F.col(source).cast("string").alias("source"), F.col(text)).mapInArrow(score, f"doc_id {kind}, source string, tokens bigint, cell int, domain int, soft double")


def fit_rates(source: np.ndarray, tokens: np.ndarray, soft: np.ndarray, caps: np.ndarray, target: np.ndarray, soft_weight: float = SOFT, steps: int = 5000) -> np.ndarray:
    """Rates r of the cells, 0 <= r <= caps, by projected gradient on |own totals - target|^2 + soft_weight |soft r - target|^2.

    source, tokens: each cell's source and tokens (a source's own total is the sum of tokens times rates of its cells: never a matrix); soft: domains x cells, expected tokens. Columns are
    scaled to even steps; Nesterov momentum; ends where no rate moves any more.
    """
    d = len(target)
    root = np.sqrt(soft_weight)
    scale = np.maximum(np.sqrt(tokens**2 + soft_weight * (soft**2).sum(axis=0)), 1e-12)
    own, exp_, top = tokens / scale, root * soft / scale, caps * scale
    forward = lambda x: (np.bincount(source, own * x, d), exp_ @ x)
    back = lambda h, s: own * h[source] + exp_.T @ s
    v = np.ones(len(tokens))
    for _ in range(50):  # the largest eigenvalue, for the step
        v = back(*forward(v))
        size = np.linalg.norm(v)
        v = v / max(size, 1e-300)
    step = 1 / max(size * 1.05, 1e-12)
    x = z = np.zeros(len(tokens))
    t = 1.0
    for _ in range(steps):
        h, s = forward(z)
        new = np.clip(z - step * back(h - target, s - root * target), 0, top)
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        z = new + (t - 1) / t2 * (new - x)
        still = np.abs(new - x).max() <= 1e-12 * max(np.abs(new).max(), 1e-300)
        x, t = new, t2
        if still:
            break
    return x / scale


class Mixture:
    """The chosen documents and the shares reached; see ``mix_sources``."""

    def __init__(self, chosen: DataFrame, shares: DataFrame):
        self.chosen, self.shares = chosen, shares


def mix_sources(docs: DataFrame, targets: DataFrame, doc: str = "doc_id", source: str = "source", text: str = "text", total: int | None = None, vocabulary: str = VOCABULARY) -> Mixture:
    """Documents with repeats, so that each source's tokens come to its target share.

    :param targets: ``source``, ``target_share`` (of all tokens), ``max_repeats``
    :param total: tokens wanted; by default as many as the caps allow all sources at their shares
    :return: ``chosen``: ``doc_id``, ``source``, ``repeats`` (1 up to max_repeats), ``tokens``; ``shares``: per target source ``target_share``, ``actual_share``, ``expected_share`` (by the posteriors of the chosen documents rather than by their label), ``tokens``, ``target_tokens``, ``documents``, ``most_repeats``, ``max_repeats``

    A source without documents or tokens cannot reach its share; it is reported with 0, the others keep their proportions. Documents of sources that are no
    target, or with a null source, get no repeats. Null or negative shares and caps count as 0; of repeated target rows the largest counts.
    Documents without tokens are not chosen. Rows with one doc_id are documents of their own. Empty tables give empty results, or shares of 0.
    """
    spark = docs.sparkSession
    ws = Workspace(spark, "mixing")
    want = targets.where(F.col("source").isNotNull()).groupBy("source").agg(F.greatest(F.coalesce(F.max("target_share"), F.lit(0.0)), F.lit(0.0)).alias("share"), F.greatest(F.coalesce(F.max("max_repeats"), F.lit(0)), F.lit(0)).alias("cap")).orderBy("source").collect()
    if not want:
        kind = docs.schema[doc].dataType.simpleString()
        return Mixture(spark.createDataFrame([], f"doc_id {kind}, source string, repeats int, tokens bigint"), spark.createDataFrame([], "source string, target_share double, actual_share double, expected_share double, tokens bigint, target_tokens double, documents bigint, most_repeats int, max_repeats int"))
    names = [r["source"] for r in want]
    share, cap = np.array([r["share"] for r in want]), np.array([r["cap"] for r in want], dtype=float)
    weights = fit_domains(docs, names, source, text, vocabulary)
    rows = ws.keep(scored(docs, weights, names, doc, source, text, vocabulary))
    usable = rows.where("domain is null and cell is not null and tokens > 0").withColumn("u", F.pmod(F.xxhash64("doc_id", "tokens"), F.lit(1 << 32)))
    at = {s: i for i, s in enumerate(names)}
    cells = usable.groupBy("source", "cell").agg(F.sum("tokens").alias("tokens")).orderBy("source", "cell").collect()  # SURE_CELLS per source at most
    expected = rows.where("domain is not null").groupBy("source", "cell", "domain").agg(F.sum("soft").alias("soft")).collect()  # and those by domain
    col = {(r["source"], r["cell"]): j for j, r in enumerate(cells)}
    of = np.array([at[r["source"]] for r in cells], dtype=np.int64)
    tokens, soft = np.array([r["tokens"] for r in cells], dtype=float), np.zeros((len(names), len(cells)))
    for r in expected:
        soft[r["domain"], col[r["source"], r["cell"]]] = r["soft"]
    have = np.bincount(of, tokens, len(names))
    can = (have > 0) & (share > 0) & (cap > 0)
    most = float((cap[can] * have[can] / share[can]).min()) if can.any() else 0.0
    goal = np.where(can, share, 0) * (min(most, total) if total is not None else most)
    rates = fit_rates(of, tokens / 1e6, soft / 1e6, cap[of], goal / 1e6) if cells else np.zeros(0)
    # the label's totals are met in full: what the soft totals cost is given back, in proportion to the room that rates have
    for s in np.flatnonzero(can):
        own = np.flatnonzero(of == s)
        for _ in range(50):
            miss = goal[s] - tokens[own] @ rates[own]
            room = (cap[s] - rates[own]) if miss > 0 else rates[own]
            if abs(miss) < 1e-9 * max(goal[s], 1) or not (tokens[own] @ room) > 0:
                break
            rates[own] = np.clip(rates[own] + miss * room / (tokens[own] @ room), 0, cap[s])
    whole, rest = np.floor(rates + 1e-9), np.maximum(rates - np.floor(rates + 1e-9), 0)
    plan = spark.createDataFrame([(r["source"], r["cell"], int(w), float(f)) for r, w, f in zip(cells, whole, rest)], "p_source string, p_cell int, base int, rest double")
    limit = (1 << DIGIT * LEVELS) - 1
    ranked = usable.join(plan, (F.col("source") == F.col("p_source")) & (F.col("cell") == F.col("p_cell"))).select("doc_id", "source", "tokens", "base", F.when(F.col("rest") > 0, F.least(F.floor(F.col("u") / F.col("rest")), F.lit(limit))).alias("v"))
    ranked = ws.keep(ranked)  # as wide as five columns
    budget = {names[s]: float(goal[s] - np.bincount(of, tokens * whole, len(names))[s]) for s in np.flatnonzero(can)}
    cut = _radix_cut(ranked.where("v is not null").select("source", "tokens", "v"), budget)
    cuts = F.create_map(*(F.lit(x) for s, c in cut.items() for x in (s, c))) if cut else F.lit(None).cast("map<string,bigint>")
    chosen = ranked.select("doc_id", "source", (F.col("base") + F.when(F.col("v") < F.coalesce(cuts[F.col("source")], F.lit(0)), 1).otherwise(0)).alias("repeats"), "tokens").where("repeats > 0")
    got = chosen.groupBy("source").agg(F.sum(F.col("tokens") * F.col("repeats")).alias("tokens"), F.count(F.lit(1)).alias("documents"), F.max("repeats").alias("most_repeats"))
    softly = soft @ rates if len(cells) else np.zeros(len(names))
    softly = softly / max(softly.sum(), 1e-300)
    wanted = spark.createDataFrame([(n, float(x), int(c), float(e), float(g)) for n, x, c, e, g in zip(names, share, cap, softly, goal)], "t_source string, target_share double, cap int, expected_share double, target_tokens double")
    shares = wanted.join(got, F.col("t_source") == F.col("source"), "left").select(F.col("t_source").alias("source"), "target_share", "expected_share", "target_tokens", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("tokens", "documents", "most_repeats")), F.col("cap").alias("max_repeats"))
    all_ = F.sum("tokens").over(Window.partitionBy())  # a row per target
    shares = shares.select("source", "target_share", F.coalesce(F.col("tokens") / F.nullif(all_, F.lit(0)), F.lit(0.0)).alias("actual_share"), "expected_share", "tokens", "target_tokens", "documents", "most_repeats", "max_repeats")
    return Mixture(chosen, shares)


def _radix_cut(rows: DataFrame, budget: dict[str, float]) -> dict[str, int]:
    """Per source the value of ``v`` below which the tokens come nearest to the budget; one pass of sums per digit."""
    cut = {s: 0 for s, b in budget.items() if b <= 0}
    prefix, left = {s: 0 for s in budget if s not in cut}, dict(budget)
    for level in range(LEVELS):
        if not prefix:
            break
        shift = DIGIT * (LEVELS - 1 - level)
        known = F.create_map(*(F.lit(x) for sp in prefix.items() for x in sp))
        here = rows.where(F.shiftright("v", shift + DIGIT) == known[F.col("source")])
        sums = here.groupBy("source", F.shiftright("v", shift).bitwiseAND((1 << DIGIT) - 1).alias("digit")).agg(F.sum("tokens").alias("n")).collect()  # sources x 4096 at most
        by: dict[str, dict[int, int]] = {}
        for r in sums:
            by.setdefault(r["source"], {})[r["digit"]] = r["n"]
        for s in list(prefix):
            for digit, n in sorted(by.get(s, {}).items()):
                if left[s] < n:
                    prefix[s] = (prefix[s] << DIGIT) | digit
                    if level == LEVELS - 1:  # the documents at the cut itself are taken where that comes nearer
                        cut[s] = prefix.pop(s) + (n - left[s] < left[s])
                    break
                left[s] -= n
            else:  # everything fits
                cut[s] = 1 << DIGIT * LEVELS
                del prefix[s]
    return cut

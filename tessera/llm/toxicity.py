"""Toxic passages by maximum-scoring segments.

Fit: documents labelled toxic or not give, for every word and word beginning, a log-odds ratio with a Dirichlet prior
(of mass `prior` on each feature); features whose ratio is large and significant become the lexicon. A word scores
the largest ratio listed for it or one of its beginnings, else a small negative drift. Scan: a linear-time pass finds all
maximal scoring segments of a text (every one is a passage more toxic than its surroundings). Calibrate: with Karlin and
Altschul's statistics, lambda solves sum p(s) exp(lambda s) = 1 over the scores of clean text and K is fitted to clean
texts' best segments, so that lambda S - ln(K n) is comparable across lengths; a logistic curve fitted to the labels
turns the document's extreme value and the sum statistic over its segments into a score between 0 and 1. Calibration is cross-fitted:
each part of the labelled rows is scored by a lexicon that it didn't help to choose.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import bounded, delete, map_arrow, materialise

letters = re.compile(r"[^\W\d_]+").findall
#: Lengths of word beginnings that are features.
BEGINNINGS = (3, 4, 5, 6, 7)


@dataclass(frozen=True)
class Model:
    words: dict[str, float]
    beginnings: dict[str, float]
    drift: float
    lam: float
    log_k: float
    weights: tuple[float, float, float, float]


class Scores(dict):
    """Word -> score; emptied when full."""

    def __init__(self, model: Model, most: int = 150_000):
        super().__init__()
        self.model, self.most = model, most

    def __missing__(self, word: str) -> float:
        if len(self) >= self.most:
            self.clear()
        found = [s for k in BEGINNINGS if len(word) >= k and (s := self.model.beginnings.get(word[:k])) is not None]
        if (own := self.model.words.get(word)) is not None:
            found.append(own)
        score = self[word] = max(found, default=self.model.drift)
        return score


def maximal_segments(scores: list[float] | np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments as (start, end, score), in linear time.

    Candidates stand on a stack with the sums left (before them) and right (to their end). A new positive score looks for
    the latest candidate whose left sum is below its own; unless that one's right sum is at least its own too, the two
    and all between become one candidate, and the search goes on.
    """
    at = np.flatnonzero(np.asarray(scores) > 0)
    if not len(at):
        return []
    total = np.concatenate([[0.0], np.cumsum(scores, dtype=float)])
    stack: list[list] = []  # start, end, left, right, index of the latest candidate with a smaller left sum
    for i in at.tolist():
        start, end, left, right = i, i + 1, float(total[i]), float(total[i + 1])
        j = len(stack) - 1
        while True:
            while j >= 0 and stack[j][2] >= left:
                j = stack[j][4]
            if j < 0 or stack[j][3] >= right:
                break
            start, left = stack[j][0], stack[j][2]
            del stack[j:]
            j = j - 1
        stack.append([start, end, left, right, j])
    return [(s, e, r - left) for s, e, left, r, _ in stack]


def evidence(text: str | None, scores: Scores) -> tuple[float, float, int, list[tuple[int, int, float]]]:
    """(extreme value, sum statistic over segments, words, segments) of a whole text."""
    found = letters((text or "").lower())
    n = len(found)
    if not n:
        return 0.0, 0.0, 0, []
    values = np.fromiter(map(scores.__getitem__, found), np.float64, n)
    if values.max() <= 0:
        return 0.0, 0.0, n, []
    m = scores.model
    segments = maximal_segments(values)
    z = sorted((m.lam * s - m.log_k - math.log(n) for _, _, s in segments), reverse=True)
    return max(0.0, z[0]), sum_statistic(z), n, segments


def sum_statistic(z: list[float]) -> float:
    """-ln of the chance of the best r segments' normalised scores, e^-T T^(r-1) / (r! (r-1)!), at the r that makes it largest; 0 if none is positive."""
    best = total = 0.0
    for r, x in enumerate(z, 1):
        total += x
        if total > 0:
            best = max(best, total - (r - 1) * math.log(max(total, 1.0)) + math.lgamma(r + 1) + math.lgamma(r))
        elif x < 0:
            break
    return best


def features(extreme: float, total: float, found: bool) -> tuple[float, float, float]:
    """What the logistic curve takes: the extreme value, the sum statistic, and whether there is any segment."""
    return math.log1p(extreme), math.log1p(total), float(found)


def probability(model: Model, text: str | None, scores: Scores) -> tuple[float, float, list]:
    """(probability, extreme value, segments) of a text."""
    extreme, total, _, segments = evidence(text, scores)
    x = model.weights[0] + sum(w * f for w, f in zip(model.weights[1:], features(extreme, total, bool(segments)), strict=True))
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, x)))), extreme, segments


#: Parts of the labelled rows, each of which is scored by what the others taught while the calibration is fitted.
FOLDS = 4


def count_features(labelled: DataFrame) -> DataFrame:
    """(feature, c): labelled documents (text, toxic, fold) that hold each word (kind w) and word beginning (kind p), counted as c[2 * fold + toxic]; summed a partition before the shuffle."""

    def run(batches):
        counts: dict[str, list[int]] = {}

        def flush():
            out = pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), *(pa.array([c[k] for c in counts.values()], pa.int64()) for k in range(2 * FOLDS))], ["feature", *(f"c{k}" for k in range(2 * FOLDS))])
            counts.clear()
            return out

        for batch in batches:
            for text, toxic, fold in zip(batch.column(0), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                found = set(letters((text.as_py() or "").lower()))
                for feature in {"w" + w for w in found} | {"p" + w[:k] for w in found for k in BEGINNINGS if len(w) >= k}:
                    counts.setdefault(feature, [0] * (2 * FOLDS))[2 * fold + toxic] += 1
                if len(counts) > 60_000:
                    yield flush()
        yield flush()

    columns = [f"c{k}" for k in range(2 * FOLDS)]
    sums = bounded(labelled).mapInArrow(run, ", ".join(["feature string", *(f"{c} long" for c in columns)])).groupBy("feature").agg(*(F.sum(c).alias(c) for c in columns))
    return sums.select("feature", F.array(*columns).alias("c"))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.3, rounds: int = 30) -> np.ndarray:
    """Weights of [1, x] by Newton's method with a ridge on the slopes."""
    x = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(x.shape[1])
    penalty = np.diag([1e-6, *([ridge] * (x.shape[1] - 1))])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        w -= np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + penalty, x.T @ (p - y) + penalty @ w)
    return w


def fit(labelled: DataFrame, prior: float = 0.5, least_z: float = 2.6, least_ratio: float = 3.0, drift: float = -0.7, max_lexicon: int = 50_000, max_rows: int = 20_000) -> Model:
    """Fit to labelled (text, toxic) rows: of more than max_rows, those whose texts' hashes come first, which bounds all that reaches the driver.

    The lexicon is that of all these rows; the calibration (lambda, K and the logistic curve) is fitted to each part of them as the other
    parts' lexicon scores it, so that it sees what the lexicon does to texts that didn't choose it. Parts go by the hash of the text.
    Without rows of both classes the model knows no toxic word and every text scores the share of toxic rows (0 without any).
    """
    labelled = labelled.where("toxic is not null").select(F.col("text").cast("string"), F.when(F.col("toxic") != 0, 1).otherwise(0).alias("toxic"), F.pmod(F.xxhash64("text"), F.lit(FOLDS)).cast("int").alias("fold"))
    labelled = materialise(labelled, "labelled")
    if labelled.count() > max_rows:
        every, labelled = labelled, materialise(labelled.orderBy(F.xxhash64("text", "toxic"), "text", "toxic").limit(max_rows), "labelled")
        delete(every)
    n = [0] * (2 * FOLDS)
    for r in labelled.groupBy("fold", "toxic").count().collect():
        n[2 * r["fold"] + r["toxic"]] = r["count"]
    n0, n1 = sum(n[::2]), sum(n[1::2])
    if not n0 or not n1:
        share = n1 / (n0 + n1) if n1 else 1e-9
        return Model({}, {}, drift, 1.0, 0.0, (math.log(max(share, 1e-9) / max(1 - share, 1e-9)), 0.0, 0.0, 0.0))
    counted = count_features(labelled)
    variants = [*range(FOLDS), FOLDS]  # without one fold each, and of all
    for v in variants:
        used = [f for f in range(FOLDS) if f != v]
        a, b = (sum((F.col("c")[2 * f + toxic] for f in used), F.lit(0)) for toxic in (0, 1))
        all_a, all_b = (sum(n[2 * f + toxic] for f in used) for toxic in (0, 1))
        # prior mass `prior` for a feature in either class, as for a Dirichlet over (holds it, doesn't)
        ratio = F.log((b + prior) / (F.lit(all_b) - b + prior)) - F.log((a + prior) / (F.lit(all_a) - a + prior))
        z = ratio / F.sqrt(1 / (b + prior) + 1 / (a + prior))
        counted = counted.withColumn(f"r{v}", ratio).withColumn(f"z{v}", F.when((z >= least_z) & (ratio >= least_ratio), z))
    scores = [f"z{v}" for v in variants]
    rows = counted.drop("c").where(F.coalesce(*scores).isNotNull()).orderBy(F.desc(F.greatest(*scores)), "feature").limit(len(variants) * max_lexicon).collect()
    drafts = []
    for v in variants:
        best = sorted((r for r in rows if r[f"z{v}"] is not None), key=lambda r: (-r[f"z{v}"], r["feature"]))[:max_lexicon]
        words, beginnings = ({r["feature"][1:]: r[f"r{v}"] for r in best if r["feature"][0] == kind} for kind in "wp")
        drafts.append(Model(words, beginnings, drift, 1.0, 0.0, (0.0, 0.0, 0.0, 0.0)))

    def scan(batch: pa.RecordBatch, scores: list[Scores]) -> pa.RecordBatch:
        best, lengths, positive, weight = [], [], [], []
        for text, fold in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
            values = [scores[fold][w] for w in letters((text or "").lower())]
            above = [v for v in values if v > 0]
            best.append(max((s for _, _, s in maximal_segments(values)), default=0.0))
            lengths.append(len(values))
            positive.append(len(above))
            weight.append(sum(above))
        return pa.RecordBatch.from_arrays([pa.array(best, pa.float64()), pa.array(lengths, pa.int64()), pa.array(positive, pa.int64()), pa.array(weight, pa.float64()), batch.column(1)], ["best", "n", "positive", "weight", "toxic"])

    seen = map_arrow(labelled, scan, "best double, n long, positive long, weight double, toxic int", lambda: [Scores(m, 40_000) for m in drafts]).where("toxic = 0").toPandas()
    total, positive, weight = float(seen["n"].sum()) + 1, float(seen["positive"].sum()) + 0.5, float(seen["weight"].sum()) + 1.0
    lam = solve_lambda(positive / total, max(weight / positive, 0.5), drift)
    hits = seen[seen["n"] > 0]
    log_k = math.log(max(len(hits), 1)) - math.log(float((hits["n"] * np.exp(-lam * hits["best"])).sum()) + 1e-9)
    models = [replace(m, lam=lam, log_k=log_k) for m in drafts]

    def gather(batch: pa.RecordBatch, scores: list[Scores]) -> pa.RecordBatch:
        x = []
        for text, fold in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
            extreme, total, _, segments = evidence(text, scores[fold])
            x.append(features(extreme, total, bool(segments)))
        return pa.RecordBatch.from_arrays([*(pa.array(c, pa.float64()) for c in zip(*x, strict=True)), batch.column(1)], ["a", "b", "found", "toxic"])

    table = map_arrow(labelled, gather, "a double, b double, found double, toxic int", lambda: [Scores(m, 40_000) for m in models]).toPandas()
    delete(labelled)
    w = logistic(table[["a", "b", "found"]].to_numpy(), table["toxic"].to_numpy(dtype=float))
    return replace(models[FOLDS], weights=tuple(map(float, w)))


def solve_lambda(share: float, height: float, drift: float) -> float:
    """The positive root of share exp(lambda height) + (1 - share) exp(lambda drift) = 1, by bisection."""
    def f(x: float) -> float:
        return share * math.exp(min(50.0, x * height)) + (1 - share) * math.exp(x * drift) - 1
    low, high = 1e-6, 20.0
    if f(low) >= 0:
        return 0.05
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if f(mid) < 0 else (low, mid)
    return low


def labelled_sample(docs: DataFrame, labels: DataFrame, usable, max_rows: int = 20_000) -> DataFrame:
    """(text, toxic) of at most max_rows labelled documents for which usable holds: those whose hashed id comes first; a bounded set of ids, so it is broadcast.

    An id whose labels differ is toxic; of texts that share an id the smallest is taken.
    """
    chosen = labels.where("doc_id is not null and toxic is not null").where(usable).groupBy("doc_id").agg(F.max((F.col("toxic") != 0).cast("int")).alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    return docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text")).select("text", "toxic")


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.7) -> DataFrame:
    """A row a document: id, score (0 to 1), predicted (score >= threshold), n_segments, top_start, top_end (words of the best segment; null without one), extreme.

    Whole texts; a null text is scored as an empty one, by the base rate. Null and repeated ids pass through, a row
    each; an empty table gives none; other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = [id_col, "score", "predicted", "n_segments", "top_start", "top_end", "extreme"]

    def per_slice(batch: pa.RecordBatch, scores: Scores) -> pa.RecordBatch:
        rows = []
        for text in batch.column(1).to_pylist():
            p, extreme, segments = probability(scores.model, text, scores)
            top = max(segments, key=lambda s: s[2], default=(None, None, 0.0))
            rows.append((p, int(p >= threshold), len(segments), top[0], top[1], extreme))
        kinds = (pa.float64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.float64())
        return pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True))], names)

    chosen = docs.select(F.col(id_col), F.col(text_col).cast("string"))
    return map_arrow(chosen, per_slice, f"{id_col} {docs.schema[id_col].dataType.simpleString()}, score double, predicted int, n_segments long, top_start long, top_end long, extreme double", lambda: Scores(shared.value))


def without_toxic(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = 0.7) -> DataFrame:
    """docs without the rows whose text scores threshold or more; each row by its own text, so nothing is joined. All columns pass through."""
    shared, at, names = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index(text_col), docs.columns

    def per_slice(batch: pa.RecordBatch, scores: Scores) -> pa.RecordBatch:
        keep = [probability(scores.model, t, scores)[0] < threshold for t in batch.column(at).to_pylist()]
        return pa.RecordBatch.from_arrays(batch.columns, names).filter(pa.array(keep, pa.bool_()))

    return map_arrow(docs, per_slice, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema), lambda: Scores(shared.value))

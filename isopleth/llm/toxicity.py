"""Toxic passages by maximum-scoring segments of token log-odds.

A token's score is its log-odds between the two labels, in documents, under Dirichlet
priors proportional to how many of all documents have it, drawn towards nothing by what is
uncertain about it. It has either sign. Rare words fall back to their first letters, and a
drift is taken from every token. A linear-time scan finds all maximal-scoring segments of a
text. Segments are judged by the extreme-value law of such scores (scale from the
distribution of scores in clean rows, location from their best segments), several
together by the law of their sum, and the resulting evidence is mapped to a probability
on the labelled sample, each row of which is scored by weights learnt from the others.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from .base import dropped, held, own, sliced

#: At most so many labelled rows, by order of a hash of their id, are learnt from.
SAMPLE_ROWS = 20_000
#: At most so many features, by significance in the sample, get a score.
FEATURES = 20_000
#: Sampled rows that agree on so many smallest hashes are taken for copies of each other.
KIN = 4
#: Letters of the beginnings that rare words fall back to, longest first.
STEMS = (6, 4)
#: Documents that the prior of either class stands for.
PRIOR = 100.0
#: Standard errors by which log-odds are drawn towards 0: a language or topic with more
#: toxic rows than others must not speak for itself.
SHRINK = 1.0
#: Taken from every token, so that segments end where nothing speaks for them. These three were
#: chosen by five-fold cross-validation inside the rows one may learn from.
DRIFT = 1.0
#: Parts of the sample; a row's evidence, to calibrate on, comes from weights of the others.
PARTS = 3
#: A passage is reported if its expected number in clean text of this length is below.
SIGNIFICANT = 0.05
THRESHOLD = 0.7

WORD = re.compile(r"\w+")
_CACHE = 200_000
# Odd factors, as multiplying by one orders 64-bit hashes anew.
_ORDERS = np.array([xxh3_64_intdigest(bytes([k])) | 1 for k in range(KIN)], dtype=np.uint64)
#: Scores are counted in steps of _STEP from _LOW on; those outside fall into the end bins.
_STEP, _LOW, _BINS = 0.05, -8.0, 480


def features(word: str) -> list[str]:
    """The word and its beginnings, from the most particular on."""
    return [word, *(f"{word[:k]}*" for k in STEMS if len(word) > k)]


def found_in(text: str | None) -> set[str]:
    """All features of a text, each once."""
    return {f for w in set(WORD.findall((text or "").lower())) for f in features(w)}


class Scores(dict):
    """Word to score, by its most particular feature that has one; bounded."""

    def __init__(self, weights: dict[str, float]):
        super().__init__()
        self.weights = weights

    def __missing__(self, word: str) -> float:
        if len(self) >= _CACHE:
            self.clear()
        known = (self.weights[f] for f in features(word) if f in self.weights)
        score = self[word] = next(known, 0.0) - DRIFT
        return score

    def of(self, text: str | None) -> np.ndarray:
        words = WORD.findall((text or "").lower())
        return np.fromiter(map(self.__getitem__, words), dtype=np.float64, count=len(words))


@dataclass
class Model:
    weights: dict[str, float]
    scale: float
    location: float
    #: Log evidence and the chance of label 1 there.
    at: list[float]
    chance: list[float]


def segments(values: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal-scoring segments (first, last, score), in order, in linear time."""
    first, last, left, right, before = [], [], [], [], []
    sums = np.concatenate(([0.0], np.cumsum(values))).tolist()
    for p in np.flatnonzero(values > 0).tolist():
        lo, lo_at, total = sums[p], p, sums[p + 1]
        while True:
            j = len(left) - 1
            while j >= 0 and left[j] >= lo:
                j = before[j]
            if j < 0 or right[j] >= total:
                first.append(lo_at), last.append(p), left.append(lo), right.append(total), before.append(j)
                break
            lo, lo_at = left[j], first[j]
            del first[j:], last[j:], left[j:], right[j:], before[j:]
    return [(a, b, r - x) for a, b, x, r in zip(first, last, left, right)]


def _log_tail(r: int, x: float) -> float:
    """Log chance that the ``r`` best segments together exceed normalised score ``x``."""
    if x <= r:
        return 0.0
    return min(0.0, -x + (r - 1) * math.log(x) - math.lgamma(r + 1) - math.lgamma(r))


def evidence(found: list[tuple[int, int, float]], n_tokens: int, scale: float, location: float) -> float:
    """Minus the log chance of the best sum of top segments in clean text of this length."""
    best, total = 0.0, 0.0
    space = location + math.log(max(n_tokens, 1))
    for r, s in enumerate(sorted((s for _, _, s in found), reverse=True), 1):
        total += scale * s - space
        best = max(best, -_log_tail(r, total))
    return best


def _read(text: str | None, scores: Scores, model: Model):
    values = scores.of(text)
    found = segments(values)
    return values, found, evidence(found, len(values), model.scale, model.location)


def sampled(labels: DataFrame, doc_id: str, label: str, rows: int) -> DataFrame:
    """At most ``rows`` labelled ids with their label; an id with both labels counts as 1."""
    one = labels.filter(F.col(doc_id).isNotNull() & F.col(label).isin(0, 1)).groupBy(F.col(doc_id).cast("long").alias("id"))
    return one.agg(F.max(F.col(label).cast("int")).alias("y")).orderBy(F.xxhash64("id"), "id").limit(rows)


def _log_odds(n: np.ndarray, pos: np.ndarray, neg: np.ndarray, rows: tuple[int, int, int]) -> np.ndarray:
    """Of documents with a feature; ``rows`` are all, positive and negative documents."""
    prior = PRIOR * (n + 0.5) / (rows[0] + 1)
    p, q = (pos + prior) / (rows[1] + PRIOR), (neg + prior) / (rows[2] + PRIOR)
    odds = np.log(p / np.maximum(1 - p, 1e-6)) - np.log(q / np.maximum(1 - q, 1e-6))
    doubt = SHRINK * np.sqrt(1 / (pos + prior) + 1 / (neg + prior))
    return np.sign(odds) * np.maximum(np.abs(odds) - doubt, 0.0)


def _binned(values: np.ndarray) -> np.ndarray:
    return np.bincount(np.clip(np.round((values - _LOW) / _STEP), 0, _BINS - 1).astype(int), minlength=_BINS)


def _scale(counts: np.ndarray) -> float:
    """The positive root of sum(share * exp(root * score)) = 1 over binned scores."""
    scores, share = _LOW + np.arange(_BINS) * _STEP, counts / max(1.0, counts.sum())
    total = lambda x: float((share * np.exp(x * scores)).sum())
    low, high = 1e-6, 1.0
    while total(high) < 1 and high < 16:
        high *= 2
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if total(mid) < 1 else (low, mid)
    return high


def _calibrated(x: np.ndarray, y: np.ndarray) -> tuple[list[float], list[float]]:
    """The rising step curve closest to the labels, as points to interpolate between."""
    blocks: list[list[float]] = []  # sum of evidence, sum of labels, rows
    values, inverse = np.unique(x, return_inverse=True)
    ones, rows = np.bincount(inverse, weights=y), np.bincount(inverse)
    for v, one, n in zip(values, ones, rows):
        blocks.append([v * n, one, n])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][2] >= blocks[-1][1] * blocks[-2][2]:
            last = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], last)]
    chances = np.maximum.accumulate([(one + 0.5) / (n + 1) for _, one, n in blocks])
    return [v / n for v, _, n in blocks], chances.tolist()


def probability(weight: float, model: Model) -> float:
    """The calibrated chance of label 1; more evidence always scores a little higher."""
    x = math.log1p(weight)
    return float(0.998 * np.interp(x, model.at, model.chance) + 0.002 * x / (1 + x))


def kinship(text: str | None) -> bytes:
    """The smallest of the hashes of three words in a row under each of ``KIN`` orders. Two
    texts have one of them in common with a chance of their similarity, all of them
    only if they are copies or nearly so."""
    words = WORD.findall((text or "").lower())
    runs = set(zip(words, words[1:], words[2:])) if len(words) > 2 else [words]
    hashes = np.array([xxh3_64_intdigest(" ".join(r).encode()) for r in runs], dtype=np.uint64)
    return b"".join((hashes * factor).min().tobytes() for factor in _ORDERS)


def _kinship(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        kin = pa.array([kinship(body) for part in sliced(batch) for body in part["text"].to_pylist()], pa.binary())
        yield pa.RecordBatch.from_arrays([batch["id"], batch["y"], batch["same"], kin], ["id", "y", "same", "kin"])


def fit(docs: DataFrame, doc_id: str, text: str, labels: DataFrame, label_id: str, label: str, sample_rows: int = SAMPLE_ROWS) -> Model:
    """Learn from a bounded sample of ``labels``; corpus counts cover all ``docs``.

    Labels other than 0 and 1, and labels without a document, are left out. Of sampled rows
    that are copies of each other, or nearly so, one counts, with its own label: the smallest id
    of those with label 1, else the smallest. A row repeated whole counts once. Without rows of both labels nothing can be learnt: every
    score is then the share of label 1 among the sampled rows, 0 without any.
    """
    # Bounded by sample_rows, so it goes to every executor and no text is shuffled.
    sample = F.broadcast(sampled(labels, label_id, label, sample_rows))
    rows = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).cast("string").alias("text"))
    kin = rows.join(sample, "id").select("id", "y", F.xxhash64("text").alias("same"), "text").mapInArrow(_kinship, "id long, y int, same long, kin binary")
    first = F.min(F.struct((-F.col("y")).alias("not_y"), "id", "same")).alias("r")
    # Rows repeating an id could be many; as many as were sampled are enough.
    chosen = kin.groupBy("kin").agg(first).select("r.id", "r.same", (-F.col("r.not_y")).alias("y"))
    chosen = chosen.orderBy(F.xxhash64("id", "same"), "id", "same").limit(sample_rows)
    told = {(r["id"], r["same"]): r["y"] for r in chosen.collect()}
    n_rows = (sum(told.values()), len(told) - sum(told.values()))
    if 0 in n_rows:
        return Model({}, 1.0, 0.0, [0.0], [n_rows[0] / max(1, len(told))])
    spark = docs.sparkSession
    ids, same = zip(*told)
    # From Arrow, as rows of a list would go through an RDD with Python workers of its own.
    picked = spark.createDataFrame(pa.table({"id": pa.array(ids, pa.int64()), "same": pa.array(same, pa.int64()), "y": pa.array([*told.values()], pa.int32())}))
    learnt = rows.withColumn("same", F.xxhash64("text")).join(F.broadcast(picked), ["id", "same"])
    part = F.pmod(F.hash("id", "same"), F.lit(PARTS)).cast("int").alias("part")
    # Only the sample's texts are dealt out by key, and a row repeated whole goes once.
    learnt, learnt_path = held(learnt.dropDuplicates(["id", "same"]).select("text", "y", part), "learnt")
    sizes = {(r["part"], r["y"]): r["count"] for r in learnt.groupBy("part", "y").count().collect()}

    def tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = [Counter() for _ in range(2 * PARTS)]
            for some in sliced(batch):
                for body, y, at in zip(*(c.to_pylist() for c in some.columns)):
                    counts[2 * at + y].update(found_in(body))
            names = list(set().union(*counts))
            numbers = [pa.array([c[f] for f in names], pa.int64()) for c in counts]
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), *numbers], ["feature", *classes])

    # How many rows of each part have a feature, with label 0 and with label 1.
    classes = [f"{y}{at}" for at in range(PARTS) for y in ("neg", "pos")]
    sums = learnt.mapInArrow(tell, ", ".join(["feature string", *[f"{c} long" for c in classes]])).groupBy("feature").agg(*[F.sum(c).alias(c) for c in classes])
    pos, neg = (sum(F.col(f"{y}{at}") for at in range(PARTS)) for y in ("pos", "neg"))
    both = (pos + neg) / sum(n_rows)
    z = (pos / n_rows[0] - neg / n_rows[1]) / F.sqrt(both * (1 - both + 1e-9) * (1 / n_rows[0] + 1 / n_rows[1]))
    some = sums.orderBy(F.abs(z).desc(), "feature").limit(FEATURES).toArrow().to_pylist()
    names = spark.sparkContext.broadcast([r["feature"] for r in some])

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = {f: k for k, f in enumerate(names.value)}
        lists: dict[str, list[int]] = {}
        n, total = np.zeros(len(place), dtype=np.int64), 0
        for batch in batches:
            for body in (b for part in sliced(batch) for b in part.column(0).to_pylist()):
                total += 1
                seen = set()
                for w in set(WORD.findall((body or "").lower())):
                    if (at := lists.get(w)) is None:
                        if len(lists) >= _CACHE:
                            lists.clear()
                        at = lists[w] = [place[f] for f in features(w) if f in place]
                    if at:
                        seen.update(at)
                n[list(seen)] += 1
        at = np.flatnonzero(n)
        places, numbers = np.append(at, -1).astype(np.int32), np.append(n[at], total)
        yield pa.RecordBatch.from_arrays([pa.array(places), pa.array(numbers)], ["place", "n"])

    counted = rows.select("text").mapInArrow(spread, "place int, n long").groupBy("place").agg(F.sum("n").alias("n")).toArrow()
    everywhere = dict(zip(counted["place"].to_pylist(), counted["n"].to_pylist()))
    n = np.array([everywhere.get(k, 0) for k in range(len(some))], dtype=np.float64)
    counts = np.array([[r[c] for c in classes] for r in some], dtype=np.float64).reshape(-1, PARTS, 2)
    groups = np.array([[sizes.get((at, y), 0) for y in (0, 1)] for at in range(PARTS)])

    def learnt_from(without: int | None) -> dict[str, float]:
        """Weights by all parts of the sample but one. Features that don't say anything
        stay: a common word needn't fall back to its beginning."""
        here = [at for at in range(PARTS) if at != without]
        (neg, pos), (n_neg, n_pos) = counts[:, here].sum(axis=1).T, groups[here].sum(axis=0)
        odds = _log_odds(n, pos, neg, (everywhere.get(-1, 0), n_pos, n_neg))
        return {r["feature"]: float(o) for r, o in zip(some, odds)}

    model = Model(learnt_from(None), 1.0, 0.0, [0.0], [0.0])
    apart = spark.sparkContext.broadcast([learnt_from(at) for at in range(PARTS)])

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of clean rows: tokens, best segment, and all scores in bins."""
        scores = [Scores(w) for w in apart.value]
        bins, sizes, tops = np.zeros(_BINS, np.int64), [], []
        for batch in batches:
            for body, at in ((b, k) for part in sliced(batch) for b, k in zip(part["text"].to_pylist(), part["part"].to_pylist())):
                values = scores[at].of(body)
                if len(values):
                    bins += _binned(values)
                    sizes.append(len(values))
                    tops.append(max((s for *_, s in segments(values)), default=0.0))
        yield pa.RecordBatch.from_arrays(
            [pa.array([bins.tobytes()], pa.binary()), pa.array([sizes], pa.list_(pa.int64())), pa.array([tops], pa.list_(pa.float64()))], ["bins", "n", "top"]
        )

    clean = learnt.filter("y = 0").mapInArrow(measure, "bins binary, n array<long>, top array<double>").toArrow().to_pylist()
    model.scale = _scale(sum((np.frombuffer(r["bins"], np.int64) for r in clean), np.zeros(_BINS, np.int64)).astype(np.float64))
    normal = [model.scale * top - math.log(size) for r in clean for top, size in zip(r["top"], r["n"])]
    # The mean of the extreme-value law lies Euler's constant above its location.
    model.location = (float(np.mean(normal)) if normal else 0.0) - 0.5772
    law = (model.scale, model.location)

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scores = [Scores(w) for w in apart.value]
        for batch in batches:
            for part in sliced(batch):
                values = [scores[at].of(body) for body, at in zip(part["text"].to_pylist(), part["part"].to_pylist())]
                weights = [evidence(segments(v), len(v), *law) for v in values]
                yield pa.RecordBatch.from_arrays([part["y"], pa.array(weights, pa.float64())], ["y", "weight"])

    # At most as many rows as were sampled, in any order: equal evidence is put together below.
    seen = learnt.mapInArrow(weigh, "y int, weight double").toArrow()
    dropped(learnt, learnt_path)
    model.at, model.chance = _calibrated(np.log1p(seen["weight"].to_numpy()), seen["y"].to_numpy().astype(float))
    return model


def score(docs: DataFrame, text: str, model: Model, name: str = "toxicity") -> DataFrame:
    """Add ``name`` (0 to 1) and ``<name>_passages``: start, end (code points) and score.

    The whole text is read. Missing and empty texts have no passages and the lowest
    score. Scores depend on nothing but the text, so repeated rows score alike. Columns of
    the two names are replaced, also when ``text`` is one of them; others pass through.
    """
    shared = docs.sparkSession.sparkContext.broadcast(vars(model))
    kind = pa.struct([("score", pa.float64()), ("passages", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())])))])

    @F.arrow_udf("struct<score: double, passages: array<struct<start: bigint, end: bigint, score: double>>>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        m = Model(**shared.value)
        scores = Scores(m.weights)
        for batch in batches:
            made = [pa.array([], kind)]
            for part in sliced(batch):
                rows = []
                for body in part.to_pylist():
                    values, found, weight = _read(body, scores, m)
                    space = m.location + math.log(max(len(values), 1))
                    strong = [f for f in found if m.scale * f[2] - space > -math.log(SIGNIFICANT)]
                    rows.append({"score": probability(weight, m), "passages": _spans(body, strong)})
                made.append(pa.array(rows, kind))
            yield pa.concat_arrays(made)

    made = own(docs, "made")
    rest = [c for c in docs.columns if c.lower() not in (name.lower(), f"{name}_passages".lower())]
    out = docs.withColumn(made, run(F.col(text).cast("string")))
    return out.select(*rest, F.col(f"{made}.score").alias(name), F.col(f"{made}.passages").alias(f"{name}_passages"))


def _spans(body: str | None, found: list[tuple[int, int, float]]) -> list[dict]:
    """Token ranges as ranges of code points in the lower-cased text."""
    if not found:
        return []
    words = [m.span() for m in WORD.finditer(body.lower())]
    return [{"start": words[a][0], "end": words[b][1], "score": s} for a, b, s in found]

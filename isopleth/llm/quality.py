"""Quality classification by co-training on two views of a document.

One classifier sees the text's content (hashed words and shares of kinds of characters), the
other what is known about the page (source, language, size, layout). Both are fitted on a
bounded sample of labelled rows. Then, over some rounds, each scores all rows without
labels and marks those that it is surest of, and the other learns from them. Held-back
labelled rows calibrate both views; a document's score is the mean of its calibrated
log-odds, weighted by how well each view does on those rows.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from .base import dropped, held

#: Bound on the labelled rows the classifiers are fitted on, by order of a hash of the id.
SAMPLE_ROWS = 6_000
ROUNDS = 5
#: Unlabelled rows, of all there are, that each view marks for the other in a round, by label.
MARKED = 200
#: A view marks nothing that it is less sure of.
SURE = 0.9
WORD_BUCKETS = 1024
META_BUCKETS = 256
_CACHE = 200_000
_WORD = re.compile(r"\w+")


class Buckets(dict):
    """Word to bucket; bounded, starts anew when full."""

    def __missing__(self, word: str) -> int:
        if len(self) >= _CACHE:
            self.clear()
        bucket = self[word] = xxh3_64_intdigest(word.encode()) % WORD_BUCKETS
        return bucket


_KINDS = ("alnum", "upper", "digit", "blank", "line", "other")


def content(text: str | None, buckets: Buckets) -> np.ndarray:
    """Content view: normalised hashed words, shares of kinds of characters, word lengths."""
    text = text or ""
    words = _WORD.findall(text.lower())
    bag = np.bincount(np.fromiter(map(buckets.__getitem__, words), np.int64, len(words)), minlength=WORD_BUCKETS).astype(np.float32)
    bag = np.log1p(bag)
    bag /= max(float(np.linalg.norm(bag)), 1e-9)
    codes = np.frombuffer(text.encode(), dtype=np.uint8)
    counts = np.bincount(codes, minlength=256) if len(codes) else np.zeros(256, np.int64)
    total = max(1, len(codes))
    letters = counts[65:91].sum() + counts[97:123].sum() + counts[128:].sum()
    shares = [
        letters / total, counts[65:91].sum() / total, counts[48:58].sum() / total, counts[32] / total, counts[10] / total,
        1 - (letters + counts[48:58].sum() + counts[[9, 10, 13, 32, 44, 46]].sum()) / total,
    ]
    lengths = [sum(map(len, words)) / max(1, len(words)) / 10, len(set(words)) / max(1, len(words))]
    return np.concatenate([bag, np.array(shares + lengths, dtype=np.float32) * 3])


CONTENT = WORD_BUCKETS + len(_KINDS) + 2


def page(source: str | None, lang: str | None, text: str | None) -> np.ndarray:
    """Page view: hashed source and language, size and layout."""
    out = np.zeros(META_BUCKETS + 6, dtype=np.float32)
    for kind, value in (("source", source), ("lang", lang)):
        out[xxh3_64_intdigest(f"{kind}={value}".encode()) % META_BUCKETS] = 1
    text = text or ""
    lines = text.split("\n")
    size = [len(line) for line in lines]
    longest = max(size)
    ends = sum(line.rstrip().endswith((".", "!", "?", ":")) for line in lines)
    out[META_BUCKETS:] = [
        np.log1p(len(text)) / 5, np.log1p(len(lines)) / 3, np.log1p(longest) / 5, np.log1p(len(text) / len(lines)) / 5,
        ends / len(lines), len(set(lines)) / len(lines),
    ]
    return out


PAGE = META_BUCKETS + 6


@dataclass
class Model:
    content: np.ndarray
    page: np.ndarray
    #: Slope, offset and weight of each view's log-odds.
    content_curve: tuple[float, float, float]
    page_curve: tuple[float, float, float]
    prior: float


def _logistic(x: np.ndarray, y: np.ndarray, steps: int = 300, penalty: float = 1e-4) -> np.ndarray:
    """Weights and, last, the offset; classes count alike. Full-batch Adam."""
    w = np.zeros(x.shape[1] + 1, dtype=np.float32)
    share = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum())).astype(np.float32)
    m, v = np.zeros_like(w), np.zeros_like(w)
    for step in range(1, steps + 1):
        p = 1 / (1 + np.exp(-np.clip(x @ w[:-1] + w[-1], -30, 30)))
        d = (p - y) * share
        g = np.concatenate([x.T @ d + penalty * w[:-1], [d.sum()]]).astype(np.float32)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return w


def _odds(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    return x @ w[:-1] + w[-1]


def _curve(z: np.ndarray, y: np.ndarray) -> tuple[float, float, float]:
    """Calibration of log-odds, and the view's weight: how far it beats chance."""
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * z + b, -30, 30)))
        s = np.maximum(p * (1 - p), 1e-6)
        g = np.array([((p - y) * z).sum() + 0.1 * (a - 1), (p - y).sum()])
        h = np.array([[(s * z * z).sum() + 0.1, (s * z).sum()], [(s * z).sum(), s.sum() + 1e-3]])
        step = np.clip(np.linalg.solve(h, g), -2, 2)
        a, b = a - step[0], b - step[1]
    order = np.argsort(z, kind="stable")
    ranks = np.empty(len(z))
    ranks[order] = np.arange(len(z))
    ones = max(1, int((y == 1).sum()))
    zeros = max(1, int((y == 0).sum()))
    area = (ranks[y == 1].sum() - ones * (ones - 1) / 2) / (ones * zeros)
    return float(max(a, 0.0)), float(b), float(max(0.0, area - 0.5)) ** 2


def co_train(labelled: tuple, y: np.ndarray, mark: Callable | None, rounds: int = ROUNDS) -> Model:
    """The two views' matrices of labelled rows to a calibrated model.

    ``mark`` takes both views' weights and returns what each view marks: both matrices of
    these rows, and their labels.
    """
    fit_rows = np.arange(len(y)) % 4 != 3
    if len(np.unique(y[fit_rows])) < 2 or len(np.unique(y[~fit_rows])) < 2:
        fit_rows = np.ones(len(y), bool)
    told = [([v[fit_rows]], [y[fit_rows]]) for v in labelled]
    weights = [None, None]
    for at in range(rounds + 1):
        for view in (0, 1):
            weights[view] = _logistic(np.concatenate(told[view][0]), np.concatenate(told[view][1]).astype(np.float32))
        if at == rounds or mark is None:
            break
        marks = mark(weights)
        if not any(len(labels) for _, labels in marks):
            break
        for view, (rows, labels) in enumerate(marks):
            told[1 - view][0].append(rows[1 - view])
            told[1 - view][1].append(labels)
    test = ~fit_rows if (~fit_rows).any() else fit_rows
    curves = [_curve(_odds(labelled[v][test], weights[v]), y[test]) for v in (0, 1)]
    return Model(weights[0], weights[1], *curves, prior=float(y.mean()))


def probability(content_rows: np.ndarray, page_rows: np.ndarray, model: Model) -> np.ndarray:
    (a, b, u), (c, d, v) = model.content_curve, model.page_curve
    if u + v == 0:
        return np.full(len(content_rows), model.prior)
    z = (u * (a * _odds(content_rows, model.content) + b) + v * (c * _odds(page_rows, model.page) + d)) / (u + v)
    return 1 / (1 + np.exp(-np.clip(z.astype(np.float64), -30, 30)))


def _rows(columns: list, buckets: Buckets) -> tuple[np.ndarray, np.ndarray]:
    n = len(columns[0])
    first, second = np.empty((n, CONTENT), np.float32), np.empty((n, PAGE), np.float32)
    for i, (source, lang, text) in enumerate(zip(*columns)):
        first[i], second[i] = content(text, buckets), page(source, lang, text)
    return first, second


def _view(df: DataFrame, text: str, source: str, lang: str) -> list[Column]:
    return [F.col(c).cast("string").alias(a) for c, a in ((source, "source"), (lang, "lang"), (text, "text"))]


def _sparse(columns: list, buckets: Buckets) -> tuple[list[bytes], list[bytes]]:
    """Places and values of each row's features that aren't 0, the page's behind the content's."""
    places, values = [], []
    for at in range(0, len(columns[0]), 256):
        for row in np.hstack(_rows([c[at : at + 256] for c in columns], buckets)).astype(np.float16):
            place = np.flatnonzero(row)
            places.append(place.astype(np.uint16).tobytes())
            values.append(row[place].tobytes())
    return places, values


def _dense(places: list[bytes], values: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    out = np.zeros((len(places), CONTENT + PAGE), np.float32)
    for row, place, value in zip(out, places, values):
        row[np.frombuffer(place, np.uint16)] = np.frombuffer(value, np.float16)
    return out[:, :CONTENT], out[:, CONTENT:]


_PLACED = "id long, mark long, places binary, data binary"


def _marker(rows: DataFrame, marked: int) -> Callable:
    """For ``co_train``: per view and label the ``marked`` surest of all ``rows``, each marked
    once by a view. Equal ones go by id; a row repeated whole counts once."""
    taken: tuple[set, set] = (set(), set())

    def mark(weights: list[np.ndarray]) -> list:
        shared = rows.sparkSession.sparkContext.broadcast((weights, taken))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            (first, second), gone = shared.value
            factors = (np.append(first[:-1], np.zeros(PAGE)), np.append(np.zeros(CONTENT), second[:-1]))
            best: dict[tuple[int, int], dict] = {(view, label): {} for view in (0, 1) for label in (0, 1)}
            for batch in batches:
                ids, marks, places, data = (batch[c].to_pylist() for c in ("id", "mark", "places", "data"))
                row = np.repeat(np.arange(len(ids)), [len(p) // 2 for p in places])
                at, value = np.frombuffer(b"".join(places), np.uint16), np.frombuffer(b"".join(data), np.float16).astype(np.float64)
                for (view, label), kept in best.items():
                    z = np.bincount(row, value * factors[view][at], minlength=len(ids)) + (first, second)[view][-1]
                    sure = z if label else -z
                    least = kept[next(reversed(kept))][0] if len(kept) == marked else np.log(SURE / (1 - SURE))
                    some = np.flatnonzero(sure >= least)
                    new = {(ids[k], marks[k]): (float(sure[k]), places[k], data[k]) for k in some.tolist() if (ids[k], marks[k]) not in gone[view]}
                    if new:
                        order = sorted((kept | new).items(), key=lambda r: (-r[1][0], r[0]))[:marked]
                        kept.clear()
                        kept.update(order)
            out = [(*key, sure, *row, place, value) for key, kept in best.items() for row, (sure, place, value) in kept.items()]
            if out:
                kinds = (pa.int32(), pa.int32(), pa.float64(), pa.int64(), pa.int64(), pa.binary(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], ["view", "label", "sure", "id", "mark", "places", "data"])

        found = rows.mapInArrow(run, f"view int, label int, sure double, {_PLACED}").dropDuplicates(["view", "label", "id", "mark"])
        found, path = held(found, "surest")
        out = []
        for view in (0, 1):
            got = []
            for label in (1, 0):
                some = found.filter((F.col("view") == view) & (F.col("label") == label))
                got += some.orderBy(F.col("sure").desc(), "id", "mark").limit(marked).collect()
            taken[view].update((r.id, r.mark) for r in got)
            out.append((_dense([r.places for r in got], [r.data for r in got]), np.array([r.label for r in got], int)))
        dropped(found, path)
        shared.unpersist()
        return out

    return mark


def fit(
    docs: DataFrame, doc_id: str, text: str, source: str, lang: str, labels: DataFrame, label_id: str, label: str,
    learn: Column | None = None, sample_rows: int = SAMPLE_ROWS, marked: int = MARKED, rounds: int = ROUNDS,
) -> Model | float:
    """Learn from a bounded sample of labelled rows, and of all other rows from the surest.

    ``learn`` (over ``docs``) says which rows may be learnt from. Labels other than 0 and
    1 and labels without a document are left out; an id with both counts as 1. With
    fewer than both labels there is no model but the share of label 1, 0 without any.
    """
    may = F.col(doc_id).isNotNull() & (F.lit(True) if learn is None else learn)
    ids = docs.filter(may).select(F.col(doc_id).cast("long").alias("id"))
    known = labels.filter(F.col(label).isin(0, 1)).groupBy(F.col(label_id).cast("long").alias("id")).agg(F.max(F.col(label).cast("int")).alias("y"))
    known, known_path = held(known, "quality-labels")
    order = [F.xxhash64("id"), F.col("id")]
    # Bounded, so it goes to every executor and no text is shuffled.
    picked = F.broadcast(ids.distinct().join(known, "id").orderBy(*order).limit(sample_rows))
    seen = docs.select(F.col(doc_id).cast("long").alias("id"), *_view(docs, text, source, lang), may.alias("may"))
    seen = seen.withColumn("mark", F.xxhash64("source", "lang", "text"))

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        buckets = Buckets()
        for batch in batches:
            if batch.num_rows:
                both = _sparse([batch[c].to_pylist() for c in ("source", "lang", "text")], buckets)
                kept = [batch["id"], batch["mark"], *(pa.array(c, pa.binary()) for c in both)]
                yield pa.RecordBatch.from_arrays(kept, ["id", "mark", "places", "data"])

    # Rows repeating an id don't widen the sample.
    got = seen.join(picked.select("id"), "id").mapInArrow(features, _PLACED).limit(sample_rows).join(picked, "id").toArrow()
    got = got.sort_by([("id", "ascending"), ("mark", "ascending")])
    y = np.array(got["y"].to_pylist())
    if len(np.unique(y)) < 2:
        return float(y.mean()) if len(y) else 0.0
    # Features, not texts, are what may be shuffled here if there are very many labels.
    others, path = held(seen.filter("may").mapInArrow(features, _PLACED).join(known.select("id"), "id", "left_anti"), "unlabelled")
    model = co_train(_dense(got["places"].to_pylist(), got["data"].to_pylist()), y, _marker(others, marked), rounds)
    dropped(others, path)
    dropped(known, known_path)
    return model


def score(docs: DataFrame, text: str, source: str, lang: str, model: Model | float, name: str = "quality") -> DataFrame:
    """Add ``name``: the probability of label 1, from the whole text and the page's fields.

    Missing texts count as empty and missing fields as a value of their own. Repeated rows
    score alike. With a share instead of a model every row gets the share. A column named
    ``name`` is replaced, others pass through.
    """
    if isinstance(model, float):
        return docs.withColumn(name, F.lit(model))
    shared = docs.sparkSession.sparkContext.broadcast(vars(model))

    @F.arrow_udf("double")
    def run(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        buckets, held_model = Buckets(), Model(**shared.value)
        for columns in batches:
            parts, n = [], len(columns[0])
            for at in range(0, n, 256):
                rows = _rows([c.slice(at, 256).to_pylist() for c in columns], buckets)
                parts.append(probability(*rows, held_model))
            yield pa.array(np.concatenate(parts) if parts else np.empty(0), pa.float64())

    return docs.withColumn(name, run(*(F.col(c).cast("string") for c in (source, lang, text))))

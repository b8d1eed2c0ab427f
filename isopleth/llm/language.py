"""Language identification by a convolutional network over bytes.

A text is cut into windows of fixed length that overlap by the widest filter less one,
so every byte position of the whole text is convolved once. Filters of several widths
slide over byte embeddings, the maximum of each over a window feeds a softmax layer,
and a text's prediction is the mean of its windows' logits. The network is trained here,
in numpy, on windows from a bounded sample of labelled rows. For prediction, embedding
and filters are folded into lookup tables of byte pairs, which is the same sum.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .base import own

WINDOW = 256
WIDTHS = (2, 3, 4)
CHANNELS = 12
EMBEDDING = 8
#: At most so many labelled rows, evenly over the languages, with so many windows each.
SAMPLE_ROWS = 1_600
SAMPLE_WINDOWS = 4
EPOCHS = 8
UNKNOWN = "und"
_BLOCK = 64
_HOP = WINDOW - max(WIDTHS) + 1


@dataclass
class Model:
    names: list[str]
    front: np.ndarray
    back: np.ndarray
    bias: np.ndarray
    dense: np.ndarray
    dense_bias: np.ndarray


def windows(body: bytes) -> np.ndarray:
    """The whole text as rows of ``WINDOW`` bytes, the last filled up with zeros."""
    n = max(1, -(-(len(body) - WINDOW + _HOP) // _HOP))
    padded = np.zeros((n - 1) * _HOP + WINDOW, dtype=np.uint8)
    padded[: len(body)] = np.frombuffer(body, dtype=np.uint8)
    return np.lib.stride_tricks.sliding_window_view(padded, WINDOW)[::_HOP]


def _shape(filters: np.ndarray) -> np.ndarray:
    """Zero the taps past each filter's width."""
    for k, width in enumerate(WIDTHS):
        filters[width:, :, k * CHANNELS : (k + 1) * CHANNELS] = 0
    return filters


def train(rows: np.ndarray, labels: np.ndarray, n_labels: int, epochs: int = EPOCHS, seed: int = 7):
    """Adam over minibatches; gradients pass through the maxima only."""
    rng = np.random.default_rng(seed)
    taps, wide = max(WIDTHS), len(WIDTHS) * CHANNELS
    p = {
        "e": rng.normal(0, 0.5, (256, EMBEDDING)),
        "f": _shape(rng.normal(0, 0.3, (taps, EMBEDDING, wide))),
        "b": np.zeros(wide),
        "d": rng.normal(0, 0.2, (wide, n_labels)),
        "c": np.zeros(n_labels),
    }
    p = {k: v.astype(np.float32) for k, v in p.items()}
    moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in p.items()}
    step, length = 0, WINDOW - taps + 1
    weight = len(labels) / (n_labels * np.maximum(1, np.bincount(labels, minlength=n_labels)))
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for at in range(0, len(order), _BLOCK):
            pick = order[at : at + _BLOCK]
            x, y = rows[pick], labels[pick]
            embedded = p["e"][x]
            conv = sum(embedded[:, j : j + length] @ p["f"][j] for j in range(taps))
            best = conv.argmax(axis=1)
            top = np.take_along_axis(conv, best[:, None], axis=1)[:, 0] + p["b"]
            hidden = np.maximum(top, 0)
            logits = hidden @ p["d"] + p["c"]
            prob = np.exp(logits - logits.max(axis=1, keepdims=True))
            prob /= prob.sum(axis=1, keepdims=True)
            prob[np.arange(len(y)), y] -= 1
            back = (prob * weight[y][:, None] / len(y)).astype(np.float32)
            g = {"d": hidden.T @ back, "c": back.sum(axis=0)}
            into = (back @ p["d"].T) * (top > 0)
            g["b"], g["f"], g["e"] = into.sum(axis=0), np.zeros_like(p["f"]), np.zeros_like(p["e"])
            batch = np.arange(len(y))[:, None]
            for j in range(taps):
                seen = x[batch, best + j]
                g["f"][j] = np.einsum("nce,nc->ec", p["e"][seen], into)
                np.add.at(g["e"], seen, into[:, :, None] * p["f"][j].T[None])
            _shape(g["f"])
            step += 1
            for k in p:
                m, v = moments[k]
                m += 0.1 * (g[k] - m)
                v += 0.001 * (g[k] ** 2 - v)
                p[k] -= 0.01 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return p


def folded(p: dict, names: list[str]) -> Model:
    """Embedding and filters as sums over byte pairs: taps 0 and 1, taps 2 and 3."""
    tap = [p["e"] @ f for f in p["f"]]
    pair = lambda a, b: (a[:, None] + b[None]).reshape(65536, -1)
    return Model(names, pair(tap[0], tap[1]), pair(tap[2], tap[3]), p["b"], p["d"], p["c"])


def logits(rows: np.ndarray, model: Model) -> np.ndarray:
    """One row of logits per window, a block of windows at a time."""
    out = np.empty((len(rows), len(model.names)), dtype=np.float32)
    for at in range(0, len(rows), _BLOCK):
        x = rows[at : at + _BLOCK].astype(np.int32)
        pairs = x[:, :-1] * 256 + x[:, 1:]
        conv = model.front[pairs[:, :_HOP]]
        conv += model.back[pairs[:, 2 : 2 + _HOP]]
        hidden = np.maximum(conv.max(axis=1) + model.bias, 0)
        out[at : at + _BLOCK] = hidden @ model.dense + model.dense_bias
    return out


def fit(docs: DataFrame, doc_id: str, text: str, lang: str, sample_rows: int = SAMPLE_ROWS, epochs: int = EPOCHS) -> Model | None:
    """Learn from rows with text and language; None without any.

    The sample takes rows by the order of a hash of their id, evenly over the languages.
    Rows without id, text or language, and empty texts, are left out.
    """
    rows = docs.select(F.col(doc_id).alias("id"), F.col(text).cast("string").alias("text"), F.col(lang).cast("string").alias("lang"))
    rows = rows.filter("id IS NOT NULL AND lang IS NOT NULL AND length(text) > 0")
    turn = F.row_number().over(Window.partitionBy("lang").orderBy(F.pmod(F.xxhash64("id"), F.lit(1 << 31)), "id"))
    # Ids below a hash that leaves about four times the sample of each language are ranked:
    # as many however large the input is. Small languages are ranked whole.
    ids = rows.select("id", "lang")
    sizes = ids.groupBy("lang").agg(F.count(F.lit(1)).alias("size"))
    low = F.pmod(F.xxhash64("id"), F.lit(1 << 31)) / (1 << 31) * F.col("size") <= 4 * sample_rows
    # No more languages than rows can be in the sample: the largest ones, by a bounded broadcast.
    most = F.broadcast(sizes.orderBy(F.desc("size"), "lang").limit(sample_rows))
    picked = ids.join(most, "lang").filter(low).withColumn("turn", turn).filter(F.col("turn") <= sample_rows)
    picked = picked.orderBy("turn", "lang").limit(sample_rows).select("id", "lang")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for body, name in zip(*(c.to_pylist() for c in batch.select(["text", "lang"]).columns)):
                all_of = windows(body.encode())
                some = np.unique(np.linspace(0, len(all_of) - 1, SAMPLE_WINDOWS).astype(int))
                out += [(name, all_of[i].tobytes()) for i in some]
            if out:
                names, cuts = zip(*out)
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(cuts, pa.binary())], ["lang", "bytes"])

    # Bounded by sample_rows; rows repeating an id don't widen it.
    sample = rows.join(F.broadcast(picked), ["id", "lang"]).mapInArrow(cut, "lang string, bytes binary").limit(sample_rows * SAMPLE_WINDOWS)
    got = sorted((r["lang"], r["bytes"]) for r in sample.toArrow().to_pylist())
    if not got:
        return None
    names = sorted({name for name, _ in got})
    labels = np.array([names.index(name) for name, _ in got])
    return folded(train(np.stack([np.frombuffer(b, np.uint8) for _, b in got]), labels, len(names), epochs), names)


def predict(docs: DataFrame, text: str, model: Model | None, name: str = "lang_pred", score: str = "score") -> DataFrame:
    """Add the predicted language and its probability, from the whole text alone.

    A missing text, a text without any letter, and every text when there is no model get
    ``und`` with score 0. Repeated rows are predicted alike. Columns named ``name`` or
    ``score`` are replaced, also when ``text`` is one of them; all others pass through.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model and vars(model))
    kind = pa.struct([("name", pa.string()), ("score", pa.float64())])

    @F.arrow_udf("struct<name: string, score: double>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        m = shared.value and Model(**shared.value)
        for batch in batches:
            out = []
            for body in batch:
                body = body.as_py()
                if m is None or body is None:
                    out.append({"name": UNKNOWN, "score": 0.0})
                    continue
                mean = logits(windows(body.encode()), m).mean(axis=0, dtype=np.float64)
                odds = np.exp(mean - mean.max())
                k = int(odds.argmax())
                out.append({"name": m.names[k], "score": float(odds[k] / odds.sum())})
            yield pa.array(out, kind)

    made = own(docs, "made")
    # Texts without a letter are not sent to the network.
    body = F.when(F.col(text).cast("string").rlike(r"\p{L}"), F.col(text).cast("string"))
    rest = [c for c in docs.columns if c.lower() not in (name.lower(), score.lower())]
    return docs.withColumn(made, run(body)).select(*rest, F.col(f"{made}.name").alias(name), F.col(f"{made}.score").alias(score))

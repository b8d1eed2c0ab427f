"""Order min-hash fingerprints of documents: alike where their edit distance is small.

Every run of ``K`` code points of a text, told apart from equal ones before it by its
number, is an element. Under each of ``SIZE`` hash orders the ``TUPLE`` smallest elements
are selected; put back into the order they have in the text, their runs are hashed as one
tuple. Two texts agree in an entry when they share the selected runs *and* their order, so
moving passages about counts as an edit, which a plain min-hash doesn't see.

Consecutive documents are compared without a window over the table: rows are ranged by
descending id, a task walks its own chunk, and only the last text of each chunk meets the
first one of the next by a join of one row per chunk.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .base import held

K, TUPLE, SIZE = 5, 2, 64
#: Elements hashed at a time: SIZE / 4 orders of them fit a core's cache.
SLICE = 1 << 14
#: A name has 40 bits; places of up to 24 bits are sorted together with it in one number.
_PLACE_BITS = 24
_JOINT = 1 << _PLACE_BITS

_ODD = np.uint64(0x9E3779B97F4A7C15)


def _mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers after which every input bit shows in every output bit."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


#: One odd factor per order: multiplying by it permutes the 32-bit numbers.
_FACTORS = ((_mixed(np.arange(1, SIZE + 1, dtype=np.uint64) * _ODD) >> np.uint64(32)).astype(np.uint32) | np.uint32(1))[:, None]


def _names(points: np.ndarray) -> np.ndarray:
    """40-bit names of the runs of K code points; a shorter text is one run."""
    width = min(K, len(points))
    out = points[: len(points) - width + 1].astype(np.uint64) + np.uint64(width)
    for shift in range(1, width):
        out *= _ODD
        out += points[shift : len(points) - width + 1 + shift]
    return _mixed(out) >> np.uint64(_PLACE_BITS)


def _elements(points: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Name, place and 32-bit hash of every numbered run, by name and place."""
    names = _names(points)
    n = len(names)
    if n <= _JOINT:
        both = np.sort((names << np.uint64(_PLACE_BITS)) | np.arange(n, dtype=np.uint64))
        names, places = both >> np.uint64(_PLACE_BITS), (both & np.uint64((1 << _PLACE_BITS) - 1)).astype(np.int64)
    else:
        places = np.argsort(names, kind="stable")
        names = names[places]
    at = np.arange(n)
    fresh = np.empty(n, bool)
    fresh[0] = True
    np.not_equal(names[1:], names[:-1], out=fresh[1:])
    number = (at - np.maximum.accumulate(np.where(fresh, at, 0))).astype(np.uint64)
    hashes = _mixed((names << np.uint64(_PLACE_BITS)) + number)
    return names, places, (hashes >> np.uint64(32)).astype(np.uint32)


def _smallest(hashes: np.ndarray, take: int) -> np.ndarray:
    """Under each order, which ``take`` elements come first; of equal ones the first listed."""
    values, found = [], []
    for start in range(0, len(hashes), SLICE):
        part = hashes[start : start + SLICE]
        for lines in range(0, SIZE, SIZE // 4):
            ranked = part * _FACTORS[lines : lines + SIZE // 4]
            rows = np.arange(len(ranked))
            for _ in range(min(take, len(part))):
                best = ranked.argmin(axis=1)
                values.append((lines, ranked[rows, best]))
                found.append(best + start)
                ranked[rows, best] = 0xFFFFFFFF
    if len(hashes) <= SLICE:
        return np.concatenate([np.stack(found[i : i + take], 1) for i in range(0, len(found), take)])
    out = []
    for lines in range(0, SIZE, SIZE // 4):
        mine = [i for i, (start, _) in enumerate(values) if start == lines]
        order = np.argsort(np.stack([values[i][1] for i in mine], 1), axis=1, kind="stable")[:, :take]
        out.append(np.take_along_axis(np.stack([found[i] for i in mine], 1), order, 1))
    return np.concatenate(out)


def fingerprint(text: str) -> bytes:
    """SIZE entries of 16 bits, none of them 0; all are 0 for the empty text."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    if not len(points):
        return bytes(2 * SIZE)
    names, places, hashes = _elements(points)
    chosen = _smallest(hashes, min(TUPLE, len(hashes)))
    chosen = np.take_along_axis(chosen, np.argsort(places[chosen], axis=1), 1)
    entry = np.zeros(SIZE, np.uint64)
    for column in names[chosen].T:
        entry = _mixed(entry * _ODD + column + np.uint64(1))
    return ((entry >> np.uint64(32)) % np.uint64(65535) + np.uint64(1)).astype(">u2").tobytes()


def likeness(a: bytes, b: bytes) -> float:
    """The share of entries in which two fingerprints agree."""
    return float(np.mean(np.frombuffer(a, np.uint16) == np.frombuffer(b, np.uint16)))


def fingerprints(df: DataFrame, text: str, name: str = "fingerprint") -> DataFrame:
    """Add the fingerprint of ``text`` as a binary column, in place of one of that name.

    Missing text counts as empty; equal texts have equal fingerprints. Any other column
    stays as it is.
    """

    @F.arrow_udf("binary")
    def prints(texts):
        return pa.array([fingerprint(t.as_py()) for t in texts], pa.binary())

    return df.withColumn(name, prints(F.coalesce(F.col(text).cast("string"), F.lit(""))))


def edited(text: str, following: str) -> str:
    """``text`` with its last third replaced by as much of the start of ``following``."""
    third = len(text) // 3
    return text[: len(text) - third] + following[:third]


def _compared(text: str, mine: bytes, following: str, theirs: bytes) -> tuple:
    """n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next."""
    changed = edited(text, following)
    other = fingerprint(changed)
    digest = hashlib.sha256(changed.encode("utf-8", "surrogatepass")).hexdigest()
    return len(text), digest, mine, other, likeness(mine, other), likeness(mine, theirs)


_RESULT = "n_chars long, edited_sha256 string, fingerprint binary, edited_fingerprint binary, near_edited double, near_next double"
#: What a row of the walk is: compared with its successor, the last of its chunk, or the first.
_DONE, _TAIL, _HEAD = 0, 1, 2
#: Rows of a batch whose texts are Python strings at the same time.
_ROWS = 256


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


def edited_chain(df: DataFrame, doc_id: str, text: str) -> DataFrame:
    """Compare every document with its edited text and with the next document.

    The next document is that of the next smaller id, rows without id come last, and the
    first follows the last; a lone document follows itself. Rows of one id go by a hash of
    their text, so repeated rows are neighbours, and every row is compared once. Returns
    ``id``, ``n_chars``, ``edited_sha256``, the binary ``fingerprint`` and
    ``edited_fingerprint``, ``near_edited`` and ``near_next``; missing text counts as empty.
    No other column of ``df`` is carried along, so their names don't matter.
    """
    kind = df.schema[doc_id].dataType
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    rows = df.select(F.col(doc_id).alias("id"), body.alias("body")).withColumn("hash", F.xxhash64("body"))
    # The hash splits a repeated id: ranging by the texts themselves would sample them to the driver.
    order = [F.col("id").desc_nulls_last(), F.col("hash")]
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order, F.col("body"))

    walked = T.StructType([T.StructField("id", kind)])
    for field in T.StructType.fromDDL(f"{_RESULT}, chunk int, kind int, body string"):
        walked.add(field)
    compared = T.StructType([f for f in walked if f.name not in ("chunk", "kind", "body")])
    inner, border = to_arrow_schema(walked), to_arrow_schema(compared)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = None
        for batch in batches:
            for start in range(0, batch.num_rows, _ROWS):
                part, out = batch.slice(start, _ROWS), []
                for ident, body, chunk in zip(*(part.column(c).to_pylist() for c in ("id", "body", "chunk"))):
                    mine = fingerprint(body)
                    if before is None:
                        out.append((ident, None, None, mine, None, None, None, chunk, _HEAD, body))
                    else:
                        out.append((before[0], *_compared(*before[1:], body, mine), chunk, _DONE, None))
                    before = ident, body, mine
                yield _batch(out, inner)
        if before is not None:
            yield _batch([(before[0], None, None, before[2], None, None, None, chunk, _TAIL, before[1])], inner)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(batch.num_rows):
                row = batch.slice(start, 1).to_pylist()[0]
                yield _batch([(row["id"], *_compared(row["body"], row["fingerprint"], row["next_body"], row["next_fingerprint"]))], border)

    done, _ = held(ranged.withColumn("chunk", F.spark_partition_id()).select("id", "body", "chunk").mapInArrow(walk, walked), "fingerprints")
    heads = done.filter(F.col("kind") == _HEAD)
    # One row per chunk and no text: as many rows as tasks.
    chunks = heads.select("chunk")
    following = F.coalesce(F.lead("chunk").over(Window.orderBy("chunk")), F.first("chunk").over(Window.orderBy("chunk")))
    pairs = chunks.select("chunk", following.alias("following"))
    first = heads.select(F.col("chunk").alias("following"), F.col("body").alias("next_body"), F.col("fingerprint").alias("next_fingerprint"))
    tails = done.filter(F.col("kind") == _TAIL).select("id", "body", "fingerprint", "chunk")
    met = tails.join(pairs, "chunk").join(first, "following").select("id", "body", "fingerprint", "next_body", "next_fingerprint")
    return done.filter(F.col("kind") == _DONE).select(*compared.fieldNames()).unionByName(met.mapInArrow(meet, compared))

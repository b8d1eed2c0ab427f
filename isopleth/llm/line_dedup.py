"""Lines that several documents share, found with two Bloom filters.

One filter has the hashes of lines seen once, the other those seen twice. Tasks send the
bit positions of their distinct lines, sorted by segment of the filter; whoever builds a
segment reads positions in a stream and marks "once" or, if already marked, "twice". A
line whose bits are all in "twice" is suspected. Only suspected lines are shuffled, with
their whole keys: the smallest and largest document of each key say whether it repeats
and who keeps it. Wrong suspicions cost a little shuffling, never a wrong result.

The filter has bits in proportion to the lines, up to a fixed bound; it alone goes to
every executor. Past the bound more lines are suspected and the result is the same.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from .base import BLANKS, held, own, sliced

MIN_POINTS = 10
BITS_PER_LINE = 16
MIN_BITS, MAX_BITS = 1 << 20, 1 << 28
SEGMENT_BITS = 1 << 16
PROBES = 2
#: A missing id is one document, after every other.
_LAST = 2**63 - 1

_STRIP = BLANKS.encode()


def line_keys(text: str | None) -> list[bytes]:
    """The key of each line: ASCII blanks stripped at both ends, A-Z lower-cased."""
    return [line.strip(_STRIP) for line in (text or "").encode().lower().split(b"\n")]


def long_enough(key: bytes, points: int) -> bool:
    """Whether the key has at least so many code points."""
    return len(key) >= points and (len(key) >= 4 * points or len(key.decode()) >= points)


def distinct_keys(text: str | None, points: int) -> list[bytes]:
    return [k for k in dict.fromkeys(line_keys(text)) if long_enough(k, points)]


def probes(keys: list[bytes], bits: int) -> np.ndarray:
    """Bit positions of each key, one row of ``PROBES`` per key."""
    hashes = np.fromiter(map(xxh3_64_intdigest, keys), dtype=np.uint64, count=len(keys))
    step = (hashes >> np.uint64(32)) | np.uint64(1)
    with np.errstate(over="ignore"):
        return np.stack([(hashes + np.uint64(i) * step) & np.uint64(bits - 1) for i in range(PROBES)], axis=1)


def filter_bits(n_lines: int) -> int:
    bits = MIN_BITS
    while bits < min(MAX_BITS, BITS_PER_LINE * n_lines):
        bits *= 2
    return bits


def twice_filter(lines: DataFrame, bits: int, points: int) -> np.ndarray:
    """The twice-seen filter, as bytes, over (id, text) rows."""

    def positions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # A row's own repeats count once.
            rows = [probes(distinct_keys(t, points), bits) for part in sliced(batch) for t in part.column(0).to_pylist()]
            # Several keys of a row may share a bit; they are marked as often as they occur.
            flat = np.sort(np.concatenate([r.ravel() for r in rows])) if rows else np.empty(0, np.uint64)
            if not len(flat):
                continue
            segment = (flat // SEGMENT_BITS).astype(np.int32)
            starts = np.flatnonzero(np.r_[True, segment[1:] != segment[:-1]])
            marks = (flat % SEGMENT_BITS).astype(np.uint16)
            # Three marks say no more than two.
            parts = [_at_most_two(m).tobytes() for m in np.split(marks, starts[1:])]
            yield pa.RecordBatch.from_arrays([pa.array(segment[starts], pa.int32()), pa.array(parts, pa.binary())], ["segment", "marks"])

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, once, twice = -1, None, None
        for batch in batches:
            for segment, marks in zip(*(c.to_pylist() for c in batch.columns)):
                if segment != at:
                    if at >= 0:
                        yield _segment(at, twice)
                    at, once, twice = segment, np.zeros(SEGMENT_BITS, bool), np.zeros(SEGMENT_BITS, bool)
                m = np.frombuffer(marks, dtype=np.uint16)
                twice[m[once[m]]] = True
                twice[m[1:][m[1:] == m[:-1]]] = True
                once[m] = True
        if at >= 0:
            yield _segment(at, twice)

    sent = lines.select("text").mapInArrow(positions, "segment int, marks binary")
    parts = sent.repartition("segment").sortWithinPartitions("segment").mapInArrow(build, "segment int, bits binary")
    out = np.zeros(bits // 8, dtype=np.uint8)
    step = SEGMENT_BITS // 8
    # At most MAX_BITS / 8 bytes in all, whatever the input.
    for row in parts.toLocalIterator():
        out[row["segment"] * step : (row["segment"] + 1) * step] = np.frombuffer(row["bits"], dtype=np.uint8)
    return out


def _at_most_two(marks: np.ndarray) -> np.ndarray:
    keep = np.ones(len(marks), bool)
    keep[2:] = marks[2:] != marks[:-2]
    return marks[keep]


def _segment(number: int, bits: np.ndarray) -> pa.RecordBatch:
    packed = np.packbits(bits, bitorder="little").tobytes()
    return pa.RecordBatch.from_arrays([pa.array([number], pa.int32()), pa.array([packed], pa.binary())], ["segment", "bits"])


def _suspected(keys: list[bytes], bits: np.ndarray) -> np.ndarray:
    at = probes(keys, len(bits) * 8)
    return ((bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1).all(axis=1)


def drop_repeated_lines(
    df: DataFrame, doc_id: str, text: str, kept: str = "kept", min_points: int = MIN_POINTS
) -> DataFrame:
    """Add ``kept`` (the text without repeated lines), ``n_lines`` and ``n_dropped``.

    A line goes if its key has at least ``min_points`` code points, at least two
    documents have it, and this document's id isn't the smallest of them. Missing and
    empty texts are one empty line and stay empty. Rows of one id are one document;
    rows with a missing id are together one document, the last. Within a document
    repeats stay. Columns of the three new names are replaced; others pass through.
    """
    spark = df.sparkSession
    out = df.drop(*(c for c in (kept, "n_lines", "n_dropped") if c != text))
    lines = df.select(F.coalesce(F.col(doc_id), F.lit(_LAST)).alias("id"), F.col(text).cast("string").alias("text"))
    lines = lines.select("id", F.xxhash64("text").alias("row"), "text")
    n_lines = lines.select(F.sum(F.coalesce(F.length("text") - F.length(F.translate("text", "\n", "")) + 1, F.lit(1)))).first()[0]
    shared = spark.sparkContext.broadcast(twice_filter(lines, filter_bits(n_lines or 0), min_points))

    def suspects(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in sliced(whole)):
            ids, marks, keys = [], [], []
            for ident, mark, body in zip(*(c.to_pylist() for c in batch.columns)):
                mine = distinct_keys(body, min_points)
                if mine:
                    some = [k for k, s in zip(mine, _suspected(mine, shared.value)) if s]
                    ids.extend([ident] * len(some))
                    marks.extend([mark] * len(some))
                    keys.extend(some)
            if ids:
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(marks, pa.int64()), pa.array(keys, pa.binary())], ["id", "row", "key"])

    found = lines.mapInArrow(suspects, "id long, row long, key binary")
    # Written, so that the join below shuffles both sides and can split a hot line's rows.
    ends = found.groupBy("key").agg(F.min("id").alias("first"), F.max("id").alias("last"))
    first, _ = held(ends.filter("first < last").select("key", "first"), "repeated-lines")
    lost = found.join(first, "key").filter("id > first")
    # By id and text: however many rows share an id, a list has one text's lines at most.
    by_row = lost.groupBy("id", "row").agg(F.collect_set("key").alias("lost"))
    ident, mark, gone, made = own(out, "id"), own(out, "row"), own(out, "lost"), own(out, "made")
    joined = out.withColumns({ident: F.coalesce(F.col(doc_id), F.lit(_LAST)), mark: F.xxhash64(F.col(text).cast("string"))}).join(
        by_row.select(F.col("id").alias(ident), F.col("row").alias(mark), F.col("lost").alias(gone)), [ident, mark], "left"
    )

    @F.arrow_udf("struct<kept: string, n_lines: long, n_dropped: long>")
    def without(texts: pa.Array, losts: pa.Array) -> pa.Array:
        kind = pa.struct([("kept", pa.string()), ("n_lines", pa.int64()), ("n_dropped", pa.int64())])
        made = []
        for some, gone in zip(sliced(texts), sliced(losts)):
            rows = []
            for body, lose in zip(some.to_pylist(), gone.to_pylist()):
                parts, lose = (body or "").split("\n"), set(lose or ())
                stay = [p for p, k in zip(parts, line_keys(body)) if k not in lose] if lose else parts
                rows.append({"kept": "\n".join(stay), "n_lines": len(parts), "n_dropped": len(parts) - len(stay)})
            made.append(pa.array(rows, kind))
        return pa.concat_arrays(made) if made else pa.array([], kind)

    # Else a filter on what is made here is put below it: lines are then cut twice, by two workers of one task.
    once = without.asNondeterministic()
    joined = joined.withColumn(made, once(F.col(text).cast("string"), F.col(gone)))
    return joined.select(
        *(c for c in out.columns if c != kept),
        *(F.col(f"{made}.{a}").alias(b) for a, b in (("kept", kept), ("n_lines", "n_lines"), ("n_dropped", "n_dropped"))),
    )

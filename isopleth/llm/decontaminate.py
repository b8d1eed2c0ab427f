"""Benchmark passages in documents, found by spaced seeds and verified with substitutions.

A mask names some of a run of tokens and ignores the others; its hash over a run is
equal wherever the named tokens are, whatever stands between them. All runs of the test
items are hashed under the masks for their length, and all runs of the documents likewise. Documents
drop runs that a Bloom filter of fixed size over the test hashes rules out, the rest is joined by
hash. Around each hit the two texts are laid over each other and the best stretch of
matching tokens is scored, substitutions counting against it.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from .base import hash_filter, held, may_hold, sliced

#: The token positions each mask looks at, by the fewest matches that they are for: every
#: best stretch with so many matches, of any length, holds at least one of the masks.
MASKS = {
    12: ("10100100111", "100100010111", "1100011101", "1110111"),
    8: ("10010111", "1010111"),
    5: ("10111",),
    4: ("10111", "1111"),
    3: ("111",),
    2: ("11",),
    1: ("1",),
}
#: Tokens that must match, fewer for short items.
MIN_MATCHED = 13
MIN_SHARE = 0.8
#: Items with fewer tokens are left out where the caller names no other bound.
MIN_TOKENS = 4
#: A substitution costs as much as so many matches gain.
PENALTY = 2.0
BITMAP_BITS = 1 << 24
_CACHE = 200_000
_WORD = re.compile(r"\w+")
# An odd factor for each position under a mask.
_FACTORS = np.array([xxh3_64_intdigest(bytes([j])) | 1 for j in range(64)], dtype=np.uint64)


class Tokens(dict):
    """Word to 64-bit hash; bounded, starts anew when full."""

    def __missing__(self, word: str) -> int:
        if len(self) >= _CACHE:
            self.clear()
        value = self[word] = xxh3_64_intdigest(word.encode())
        return value

    def of(self, text: str | None) -> np.ndarray:
        words = _WORD.findall((text or "").lower())
        return np.fromiter(map(self.__getitem__, words), dtype=np.uint64, count=len(words))


def seeds(tokens: np.ndarray, masks: Iterable[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hash and start of every run of ``tokens`` under every mask: the sum over the named
    positions of token times the position's factor, modulo 2^64."""
    hashes, starts, scaled = [], [], {}
    for mask in masks:
        n = len(tokens) - len(mask) + 1
        if n <= 0:
            continue
        h = np.zeros(n, dtype=np.uint64)
        for j, used in enumerate(mask):
            if used == "1":
                if j not in scaled:
                    scaled[j] = tokens * _FACTORS[j]
                h += scaled[j][j : j + n]
        hashes.append(h)
        starts.append(np.arange(n, dtype=np.int32))
    if not hashes:
        return np.empty(0, np.uint64), np.empty(0, np.int32)
    return np.concatenate(hashes), np.concatenate(starts)


def stretch(same: np.ndarray, penalty: float = PENALTY) -> tuple[int, int, int]:
    """Start, end and matches of the stretch with the highest score; first of equal ones."""
    total = np.concatenate([[0.0], np.cumsum(np.where(same, 1.0, -penalty))])
    gain = total - np.minimum.accumulate(total)
    end = int(gain.argmax())
    start = int(total[: end + 1].argmin())
    return start, end, int(same[start:end].sum())


def overlap(doc: np.ndarray, item: np.ndarray, shift: int) -> tuple[int, int, int, int]:
    """Best stretch with ``doc[i]`` over ``item[i - shift]``: doc start, item start, length, matches."""
    low, high = max(0, shift), min(len(doc), len(item) + shift)
    start, end, n = stretch(doc[low:high] == item[low - shift : high - shift])
    return low + start, low + start - shift, end - start, n


def needed(n_tokens: int, matched: int = MIN_MATCHED, share: float = MIN_SHARE) -> int:
    return min(matched, int(np.ceil(share * n_tokens)))


def tier(n_tokens: int, matched: int = MIN_MATCHED, share: float = MIN_SHARE) -> int:
    """The key in ``MASKS`` for an item: the highest that its needed matches reach."""
    return max(k for k in MASKS if k <= max(1, needed(n_tokens, matched, share)))


def _seeded(df: DataFrame, ident: str, text: str, matched: int, share: float, least: int):
    """(id, text) rows of ``least`` tokens or more with tokens, hash and start of each seed, and tier."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Tokens()
        for batch in batches:
            rows = []
            for i, body in zip(*(c.to_pylist() for c in batch.columns)):
                tokens = words.of(body)
                if len(tokens) >= max(1, least):
                    level = tier(len(tokens), matched, share)
                    h, s = seeds(tokens, MASKS[level])
                    rows.append((i, tokens.view(np.int64), h.view(np.int64), s, level))
            if rows:
                *columns, levels = zip(*rows)
                yield _table(zip(*columns)).append_column("tier", pa.array(levels, pa.int32()))

    return df.select(F.col(ident).cast("long").alias("id"), F.col(text).cast("string").alias("text")).mapInArrow(
        run, "id long, tokens array<long>, hashes array<long>, starts array<int>, tier int"
    )


def _table(rows) -> pa.RecordBatch:
    ids, tokens, hashes, starts = zip(*rows)
    longs = pa.list_(pa.int64())
    return pa.RecordBatch.from_arrays(
        [pa.array(ids, pa.int64()), pa.array(tokens, longs), pa.array(hashes, longs), pa.array(starts, pa.list_(pa.int32()))],
        ["id", "tokens", "hashes", "starts"],
    )


def contaminated(
    docs: DataFrame, doc_id: str, text: str, benchmark: DataFrame, item_id: str, item_text: str,
    min_matched: int = MIN_MATCHED, min_share: float = MIN_SHARE, bits: int = BITMAP_BITS, min_tokens: int = MIN_TOKENS,
) -> DataFrame:
    """Pairs of document and test item that share a passage.

    Returns doc_id, item_id, doc_start, item_start (tokens), n_aligned and n_matched of
    the pair's best stretch: most matches, then fewest aligned tokens, then first. A pair
    counts from ``min_matched`` matching tokens, or ``min_share`` of a shorter item; every
    such pair is found, as any stretch that counts holds a seed of its item's masks.
    Tokens are lower-cased runs of letters, digits and underscores. Missing and empty
    texts, and items with fewer than ``min_tokens`` tokens, match nothing. Rows without
    id are left out; rows repeating an id are that document's or item's texts, each is laid
    over each, and the best counts.
    """
    spark = docs.sparkSession
    items = benchmark.filter(F.col(item_id).isNotNull())
    # A number for each text, as an id may have several; the same text twice is one.
    test = _seeded(items, item_id, item_text, min_matched, min_share, min_tokens).withColumn("text", F.xxhash64("id", "tokens"))
    test, _ = held(test.dropDuplicates(["id", "text"]), "test-seeds")
    # Documents are looked at under the masks that some item has, each once.
    masks = sorted({m for r in test.select("tier").distinct().collect() for m in MASKS[r.tier]})
    shared = spark.sparkContext.broadcast(hash_filter(test.select(F.explode("hashes").alias("h")), bits))

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, seen = Tokens(), shared.value
        for batch in (part for whole in batches for part in sliced(whole)):
            rows = []
            for i, body in zip(*(c.to_pylist() for c in batch.columns)):
                tokens = words.of(body)
                h, s = seeds(tokens, masks)
                hit = may_hold(seen, h)
                if hit.any():
                    rows.append((i, tokens.view(np.int64), h[hit].view(np.int64), s[hit]))
            if rows:
                yield _table(rows)

    rows = docs.filter(F.col(doc_id).isNotNull()).select(F.col(doc_id).cast("long").alias("id"), F.col(text).cast("string").alias("text"))
    suspects = rows.mapInArrow(probe, "id long, tokens array<long>, hashes array<long>, starts array<int>")
    # Only documents with hits, one row each, with a number of their own for repeated ids.
    suspects, path = held(suspects.withColumn("row", F.xxhash64("id", "tokens")), "suspects")
    pairs = F.explode(F.arrays_zip("hashes", "starts")).alias("s")
    ours = suspects.select("id", "row", pairs).select("id", "row", F.col("s.hashes").alias("h"), F.col("s.starts").alias("at"))
    theirs = test.select(F.col("id").alias("item"), "text", pairs).select("item", "text", F.col("s.hashes").alias("h"), F.col("s.starts").alias("item_at"))
    hits = ours.join(theirs, "h").groupBy("id", "row", "item", "text").agg(F.collect_set(F.col("at") - F.col("item_at")).alias("shifts"))
    laid = hits.join(suspects.select("id", "row", "tokens").dropDuplicates(["id", "row"]), ["id", "row"]).join(
        test.select(F.col("id").alias("item"), "text", F.col("tokens").alias("item_tokens")), ["item", "text"]
    )

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in sliced(whole, 64)):
            out = []
            for r in batch.to_pylist():
                doc, item = np.array(r["tokens"], np.int64), np.array(r["item_tokens"], np.int64)
                best = min((overlap(doc, item, s) for s in r["shifts"]), key=lambda o: (-o[3], o[2], o[0], o[1]))
                if best[3] >= needed(len(item), min_matched, min_share):
                    out.append((r["id"], r["item"], *best))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], names)

    names = ["doc_id", "item_id", "doc_start", "item_start", "n_aligned", "n_matched"]
    found = laid.select("id", "item", "tokens", "item_tokens", "shifts").mapInArrow(verify, ", ".join(f"{n} long" for n in names))
    order = F.struct(-F.col("n_matched"), "n_aligned", "doc_start", "item_start")
    best = F.min_by(F.struct(*names[2:]), order).alias("best")
    return found.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", *(F.col(f"best.{n}") for n in names[2:]))



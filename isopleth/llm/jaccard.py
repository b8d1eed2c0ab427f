"""Exact Jaccard join of documents on word shingles by T-occurrence search.

Two sets with Jaccard similarity of at least ``t`` share ``T = ceil(t * n)`` elements of
each, so at least ``l`` of the ``n - T + l`` smallest elements, in any common order, are
the same in both. The join narrows down in three exact steps:

1. From every set, only those smallest hashes are shuffled. A set goes on if enough of
   them are found in some other set.
2. For the sets left, all hashes are counted. A set goes on if ``T`` of them occur in
   another; its ``n - T + 1`` rarest ones are its short lists. Sets meet in blocks: one
   block per smallest id of a short list, so two similar sets share a block.
3. In a block, T-occurrence search with DivideSkip: the short inverted lists are merged
   with a heap and counted, and the candidates that can still reach the overlap are
   looked up in the long lists by bisection.

Equal sets are one class from the start. Blocks are cut into parts of bounded size; parts
of one block meet only for sets that are not connected yet. A task gives back the edges of
a spanning forest, never all pairs, and components are found from those.
"""

from __future__ import annotations

import heapq
import math
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest, xxh3_128_digest

from .base import dropped, hash_filter, held, may_hold, own

#: Sets of one part of a block.
PART_ROWS = 256
#: Rows whose sets a task makes before it passes them on.
SLICE_ROWS = 512
#: The filter of the sets that go on has bits in proportion to them, up to a fixed bound.
BITS_PER_ROW = 16
MIN_BITS, MAX_BITS = 1 << 20, 1 << 28
#: How much a bisection weighs against a merged entry when lists are divided.
MU = 0.0085
_EDGE = "a long, b long"


@dataclass(frozen=True)
class Rule:
    """Shingles of ``words`` words; a link from ``percent`` hundredths of the union."""

    words: int = 5
    percent: int = 80

    def least(self, n: int) -> int:
        """The overlap that a set of ``n`` needs with any other."""
        return -(-self.percent * n // 100)

    def needed(self, n: int, m: int) -> int:
        """The overlap that sets of ``n`` and ``m`` need."""
        return -(-self.percent * (n + m) // (100 + self.percent))

    def margin(self, n: int) -> int:
        """Elements that two prefixes must share; grows with ``n``."""
        return n // 10 + 1

    def prefix(self, n: int) -> int:
        return min(n, n - self.least(n) + self.margin(n))

    def shared(self, n: int) -> int:
        """Shared elements a prefix needs, whichever size the other set has."""
        return self.margin(self.least(n))


def shingles(text: str | None, words: int) -> np.ndarray:
    """Sorted distinct hashes of the text's shingles.

    Words are runs without ASCII blanks, A-Z lower-cased. A text with fewer words is one
    shingle of all its words; one without words has none.
    """
    tokens = (text or "").encode().lower().split()
    if not tokens:
        return np.empty(0, np.int64)
    h = np.fromiter(map(xxh3_64_intdigest, tokens), dtype=np.uint64, count=len(tokens))
    width = min(words, len(h))
    out = np.full(len(h) - width + 1, width, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for j in range(width):
            out = (out ^ h[j : len(h) - width + 1 + j]) * np.uint64(0x9E3779B97F4A7C15)
            out ^= out >> np.uint64(32)
    return np.unique(out.view(np.int64))


def divide_skip(query: list[int], index: dict[int, list[int]], least: int, mu: float = MU) -> Iterator[tuple[int, int, list[list[int]]]]:
    """Entries that may occur in ``least`` of the query's lists.

    Yields (entry, count in the short lists, long lists); the caller bisects the long lists.
    """
    # The query's own entry alone in a list says nothing.
    lists = sorted((one for q in query if len(one := index.get(q, ())) > 1), key=len)
    if len(lists) < least or not least:
        return
    long_lists = min(least - 1, int(least / (mu * math.log2(len(lists[-1]) + 1) + 1)))
    cut = len(lists) - long_lists
    for entry, same in groupby(heapq.merge(*lists[:cut])):
        count = sum(1 for _ in same)
        if count >= least - long_lists:
            yield entry, count, lists[cut:]


def reaches(entry: int, count: int, lists: list[list[int]], needed: int) -> bool:
    """Whether the entry is in ``needed`` lists, ``count`` of them seen; gives up early."""
    rest = len(lists)
    for one in lists:
        if count >= needed:
            return True
        if count + rest < needed:
            return False
        at = bisect_left(one, entry)
        count += at < len(one) and one[at] == entry
        rest -= 1
    return count >= needed


class Forest:
    """Union-find that keeps the smallest member on top."""

    def __init__(self, tops: list[int]):
        self.up = list(tops)

    def top(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, i: int, j: int) -> None:
        i, j = self.top(i), self.top(j)
        self.up[max(i, j)] = min(i, j)


def block_edges(ids: list[int], sizes: list[int], sets: list[list[int]], asks: list[bool], groups: list[int], rule: Rule) -> list[tuple[int, int]]:
    """Edges of a spanning forest of the links in a part.

    ``sets`` hold the hashes that occur in more than one set, ``sizes`` count all. Only sets that
    ask are searched with; sets of one group are connected already.
    """
    order = sorted(range(len(ids)), key=lambda i: (not asks[i], ids[i]))
    place = {g: k for k, g in reversed([(k, groups[i]) for k, i in enumerate(order)])}
    forest = Forest([place[groups[i]] for i in order])
    index: dict[int, list[int]] = {}
    for k, i in enumerate(order):
        for h in sets[i]:
            index.setdefault(h, []).append(k)
    edges = []
    for k, i in enumerate(order):
        if not asks[i]:
            break
        n = sizes[i]
        for other, count, lists in divide_skip(sets[i], index, rule.least(n)):
            # Pairs of two asking sets are looked at once.
            if other == k or (other < k and asks[order[other]]) or forest.top(other) == forest.top(k):
                continue
            m = sizes[order[other]]
            if rule.percent * max(n, m) <= 100 * min(n, m) and reaches(other, count, lists, rule.needed(n, m)):
                forest.join(k, other)
                edges.append((ids[i], ids[order[other]]))
    return edges


def components(edges: DataFrame) -> DataFrame:
    """(id, component) of every end of (a, b) edges, by alternating large and small stars.

    Each round is written to the shared folder; nodes far from their component's smallest
    id move closer at every round, so rounds grow with the logarithm of its size.
    """
    smaller = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a != b").distinct()
    now, path = held(smaller, "edges")
    mark = None
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("low"))
        large = both.join(low, "a").filter("b > a").select(F.col("b").alias("a"), F.col("low").alias("b")).filter("a != b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("low"))
        moved = large.join(low, "a").select(F.col("b").alias("a"), F.col("low").alias("b")).filter("a != b")
        new, new_path = held(moved.unionByName(low.select("a", F.col("low").alias("b"))).distinct(), "edges")
        seen = new.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.crc32(F.concat_ws(",", "a", "b")))).first()
        dropped(now, path)
        now, path = new, new_path
        if seen == mark:
            break
        mark = seen
    ends = now.select(F.col("a").alias("id"), F.col("b").alias("component"))
    return ends.unionByName(now.select(F.col("b").alias("id"), F.col("b").alias("component"))).groupBy("id").agg(F.min("component").alias("component"))


def _signed(batches: Iterator[pa.RecordBatch], rule: Rule, whole: bool) -> Iterator[pa.RecordBatch]:
    # Sets are about as large as their texts: a whole batch of them is never held at once.
    for batch in (b.slice(k, SLICE_ROWS) for b in batches for k in range(0, b.num_rows, SLICE_ROWS)):
        rows = []
        for i, text_hash, body in zip(*(c.to_pylist() for c in batch.columns)):
            s = shingles(body, rule.words)
            key = xxh3_128_digest(s.tobytes()) if len(s) else None
            rows.append((i, text_hash, len(s), key, s if whole else s[: rule.prefix(len(s))]))
        if rows:
            ids, marks, n, keys, hashes = zip(*rows)
            numbers = [pa.array(c, pa.int64()) for c in (ids, marks, n)]
            yield pa.RecordBatch.from_arrays(
                [*numbers, pa.array(keys, pa.binary()), pa.array(hashes, pa.list_(pa.int64()))], ["id", "text_hash", "n", "key", "hashes"]
            )


_SIGNED = "id long, text_hash long, n long, key binary, hashes array<long>"


def _survivors(signed: DataFrame, rule: Rule) -> DataFrame:
    """Step 1: (key, id, node) of the classes that may have a link: a row that has the text, and a number."""
    known = signed.filter("key IS NOT NULL AND id IS NOT NULL")
    node = F.xxhash64("key").alias("node")
    # Hashes that two classes have at least.
    ends = known.select(node, F.explode("hashes").alias("h")).groupBy("h").agg(F.min("node").alias("low"), F.max("node").alias("high"))
    shared, path = held(ends.filter("low != high").select("h"), "shared")
    found, found_path = held(known.select("id", F.explode("hashes").alias("h")).join(shared, "h").groupBy("id").agg(F.count(F.lit(1)).alias("seen")), "seen")
    least = -F.floor(-F.lit(rule.percent) * F.col("n") / 100)
    left = known.select("id", "n", "key").join(found, "id").filter(F.col("seen") >= F.floor(least / 10) + 1)
    # Numbered, as hashes of very many classes would meet somewhere.
    chosen, _ = held(left.groupBy("key").agg(F.min("id").alias("id")).withColumn("node", F.monotonically_increasing_id()), "survivors")
    dropped(shared, path)
    dropped(found, found_path)
    return chosen


def _sets_of(rows: DataFrame, chosen: DataFrame, rule: Rule) -> DataFrame:
    """Whole sets of the chosen classes, one row each, without shuffling any text."""
    bits = MIN_BITS
    while bits < min(MAX_BITS, BITS_PER_ROW * chosen.count()):
        bits *= 2
    shared = rows.sparkSession.sparkContext.broadcast(hash_filter(chosen.select(F.xxhash64("id").alias("h")), bits))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hit = may_hold(shared.value, batch["mark"].to_numpy().view(np.uint64))
            yield from _signed(iter([batch.select(["id", "text_hash", "text"]).filter(pa.array(hit))]), rule, True)

    marked = rows.filter("id IS NOT NULL").select("id", "text_hash", "text", F.xxhash64("id").alias("mark"))
    # The filter lets a few others through; the join is exact.
    whole = marked.mapInArrow(run, _SIGNED).join(chosen, ["id", "key"]).dropDuplicates(["key"])
    return whole.select(F.col("node").alias("id"), "n", "hashes")


def _search(rule: Rule):
    kind = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(part: pa.Table) -> pa.Table:
        c = {name: part[name].to_pylist() for name in ("id", "n", "hashes", "asks", "group")}
        edges = block_edges(c["id"], c["n"], c["hashes"], c["asks"], c["group"], rule)
        a, b = zip(*edges) if edges else ((), ())
        return pa.table([pa.array(a, pa.int64()), pa.array(b, pa.int64())], schema=kind)

    return run


def _links(sets: DataFrame, rule: Rule, part_rows: int) -> DataFrame:
    """Steps 2 and 3: edges that connect all linked sets of (id, n, hashes)."""
    posted = sets.select("id", "n", F.explode("hashes").alias("h"))
    often = posted.groupBy("h").agg(F.count(F.lit(1)).alias("f")).filter("f > 1")
    lists = F.array_sort(F.collect_list(F.struct("f", "h"))).alias("lists")
    found = posted.join(held(often, "often")[0], "h").groupBy("id", "n").agg(lists)
    least = -F.floor(-F.lit(rule.percent) * F.col("n") / 100)
    left = found.filter(F.size("lists") >= least).select("id", "n", "lists", least.alias("least"))
    left, left_path = held(left, "left")
    # Rarest first; the hashes of no other set are the very rarest and are gone already.
    short = F.slice("lists", F.lit(1), (F.size("lists") - F.col("least") + 1).cast("int"))
    posted = left.select("id", F.explode(short.getField("h")).alias("h"))
    heads = posted.groupBy("h").agg(F.min("id").alias("block"), F.max("id").alias("last")).filter("block < last").select("h", "block")
    members = posted.join(held(heads, "heads")[0], "h").select("block", "id").distinct()
    members, _ = held(members, "members")
    blocks = members.groupBy("block").agg(F.count(F.lit(1)).alias("rows")).filter("rows > 1")
    parts = F.ceil(F.col("rows") / part_rows).cast("int")
    placed, _ = held(members.join(blocks.select("block", parts.alias("parts")), "block"), "placed")
    place = lambda seed: F.pmod(F.xxhash64("id", F.lit(seed)), F.col("parts")).cast("int")
    bodies = left.select("id", "n", F.col("lists.h").alias("hashes"))

    # First the parts by themselves. The block's head is in all of them and ties them together.
    heads_too = F.when(F.col("id") == F.col("block"), F.sequence(F.lit(0), F.col("parts") - 1)).otherwise(F.array(place(1)))
    one = placed.select("block", "id", F.explode(heads_too).alias("part"), F.lit(True).alias("asks"), F.col("id").alias("group"))
    edges, _ = held(one.join(bodies, "id").groupBy("block", "part").applyInArrow(_search(rule), _EDGE), "links")

    # Then, of blocks with several parts, sets outside the block's largest component against all.
    joined, _ = held(components(edges), "joined")
    wide = placed.filter("parts > 1").join(joined, "id", "left").select("block", "id", "parts", F.coalesce("component", "id").alias("group"))
    wide, _ = held(wide, "wide")
    largest = wide.groupBy("block", "group").agg(F.count(F.lit(1)).alias("rows")).groupBy("block").agg(F.max_by("group", F.struct("rows", "group")).alias("largest"))
    wide = wide.join(largest, "block").withColumn("asks", F.col("group") != F.col("largest"))
    asking = wide.filter("asks").groupBy("block").agg(F.ceil(F.count(F.lit(1)) / part_rows).cast("int").alias("turns"))
    wide, _ = held(wide.join(asking, "block"), "asking")
    ask = wide.filter("asks").select(
        "block", "id", "group", F.pmod(F.xxhash64("id", F.lit(2)), F.col("turns")).cast("int").alias("turn"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "asks"
    )
    told = wide.select("block", "id", "group", F.explode(F.sequence(F.lit(0), F.col("turns") - 1)).alias("turn"), place(1).alias("part"), F.lit(False).alias("asks"))
    # A set that asks and is asked in the same part is there once, asking.
    two = ask.unionByName(told).groupBy("block", "turn", "part", "id", "group").agg(F.bool_or("asks").alias("asks"))
    more = two.join(bodies, "id").groupBy("block", "turn", "part").applyInArrow(_search(rule), _EDGE)
    all_edges, _ = held(edges.unionByName(more), "links")
    dropped(left, left_path)
    return all_edges


def link_components(df: DataFrame, doc_id: str, text: str, rule: Rule = Rule(), part_rows: int = PART_ROWS) -> DataFrame:  # noqa: B008
    """One row per row of ``df``: doc_id, n_shingles, component_id and text_hash.

    ``n_shingles`` is the size of the set and ``component_id`` the smallest id reachable by
    links, the row's own included. Texts without words have an empty set and link with nothing;
    equal sets link. A row without id links with nothing and has a null component. Rows
    repeating an id are linked each by its own text; ``text_hash`` (xxhash64) tells them
    apart. Hashes of 64 bits stand for shingles and one of 128 bits for a whole set.
    """
    rows = df.select(F.col(doc_id).cast("long").alias("id"), F.col(text).cast("string").alias("text"))
    rows = rows.select("id", F.xxhash64("text").alias("text_hash"), "text")
    signed, signed_path = held(rows.mapInArrow(lambda b: _signed(b, rule, False), _SIGNED), "signed")
    chosen = _survivors(signed, rule)
    plain, _ = held(signed.drop("hashes"), "classes")
    dropped(signed, signed_path)
    sets, sets_path = held(_sets_of(rows, chosen, rule), "sets")
    found, _ = held(components(_links(sets, rule, part_rows)), "components")
    dropped(sets, sets_path)
    classes = plain.filter("key IS NOT NULL AND id IS NOT NULL").groupBy("key").agg(F.min("id").alias("low"))
    # Classes without a link keep the smallest id of their own.
    grouped = chosen.select("key", F.col("node").alias("id")).join(found, "id").select("key", F.col("component").alias("label"))
    named, _ = held(classes.join(grouped, "key", "left"), "named")
    lowest, _ = held(named.filter("label IS NOT NULL").groupBy("label").agg(F.min("low").alias("lowest")), "lowest")
    named, _ = held(named.join(lowest, "label", "left").select("key", F.coalesce("lowest", "low").alias("lowest")), "named")
    return plain.join(named, "key", "left").select(
        F.col("id").alias("doc_id"),
        F.col("n").alias("n_shingles"),
        F.when(F.col("id").isNotNull(), F.coalesce("lowest", "id")).alias("component_id"),
        "text_hash",
    )


def keep_one(
    df: DataFrame, doc_id: str, text: str, rule: Rule = Rule(), part_rows: int = PART_ROWS, nameless: bool = False,  # noqa: B008
) -> DataFrame:
    """``df`` with one row of each group of linked documents: the smallest id's.

    Every row gets a number, so that each links by its own text. Of rows repeating both id and
    text one stays. Rows without id all stay, or with ``nameless`` link like others, and one
    stays only where no linked row has an id. Columns are those of ``df``.
    """
    number, ident, group, size = (own(df, c) for c in ("number", "id", "group", "size"))
    # Written, so that reruns see the same numbers; hashes of very many rows would meet somewhere.
    every, _ = held(df.withColumn(number, F.monotonically_increasing_id()), "numbered")
    marked = every if nameless else every.filter(F.col(doc_id).isNotNull())
    linked = link_components(marked, number, text, rule, part_rows).select(
        F.col("doc_id").alias(number), F.col("component_id").alias(group), F.col("n_shingles").alias(size)
    )
    named, _ = held(linked.join(marked.select(number, F.col(doc_id).cast("long").alias(ident)), number), "grouped")
    first = F.min(F.struct(F.col(ident).isNull().alias("none"), ident, number)).alias("first")
    stay = named.groupBy(group).agg(first, F.max(size).alias(size)).select(f"first.{number}", size)
    # Texts without words link with nothing: of those, repeats of id and text go here.
    blank = F.col(size) == 0
    once = {number: F.when(~blank, F.col(number)), ident: F.when(blank, F.col(doc_id)), group: F.when(blank, F.col(text))}
    kept = marked.join(stay, number).withColumns(once).dropDuplicates(list(once)).select(*df.columns)
    return kept if nameless else kept.unionByName(every.filter(F.col(doc_id).isNull()).select(*df.columns))

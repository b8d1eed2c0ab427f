"""Ranked lexical search by pipelined term partitioning.

A first scan counts documents, terms and the frequencies of the items' terms. The terms are
dealt to ``OWNERS`` owners, the rarest to the first and the most frequent to the last, and a
second scan gives each owner its postings, packed by blocks of documents and already worth
their integer contributions. Bundles of items then visit one owner after the other: a bundle
carries, per block of documents, its sparse accumulators, a cogroup brings them together with
the owner's postings of that block, and the contributions are added.

After every stage each item knows a score that its last hit must reach, and what the
owners still ahead can add at most. An accumulator that can't reach it any more is left
out, and once no new document could, frequent terms only add to accumulators that are
already there. Both rules are exact: they drop no hit and no tie.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.ordered import ordered, running_sum
from .base import dropped, held

#: A block is closed at so many documents or postings, so rows and arrays stay small.
BLOCK_DOCS, BLOCK_POSTINGS = 1024, 1 << 17
#: Weight of the items of a bundle, and of those searched for in one round; an item weighs
#: as much as it has distinct terms, ``ITEM_WEIGHT`` at least. A round's terms are shipped
#: to the tasks, its bound keeps them small; more items take more rounds.
ITEM_WEIGHT, BUNDLE_WEIGHT, ROUND_WEIGHT = 64, 1 << 15, 1 << 20
#: Shares of all postings up to which the terms, rarest first, belong to each owner.
OWNERS = (1 / 64, 1 / 16, 1 / 4, 1.0)

_LAST = 2**63 - 1
#: What parts terms: ASCII that is neither digit nor letter. A-Z is lowered, other letters aren't.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if chr(c).isalnum() or c > 127 else 32 for c in range(256))


def terms(text: bytes | None) -> list[bytes]:
    """The terms of a UTF-8 text in order; a missing text has none."""
    return text.translate(_FOLD).split() if text else []


def _binary(column: pa.Array) -> list:
    return column.cast(pa.binary()).to_pylist()


_SLICE = 512


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        for start in range(0, batch.num_rows, _SLICE):
            part = batch.slice(start, _SLICE)
            yield from zip(part.column(0).to_pylist(), _binary(part.column(1)))


def item_terms(items: DataFrame, item_id: str, text: str) -> DataFrame:
    """no, term, times of every row of ``items``; rows without a term have none. ``no``
    numbers the rows, as ids may repeat or be missing."""

    def count(batches):
        for batch in batches:
            rows = [(no, t, n) for no, body in _texts([batch]) for t, n in Counter(terms(body)).items()]
            if rows:
                no, term, times = zip(*rows)
                yield pa.RecordBatch.from_arrays([pa.array(no, pa.int64()), pa.array(term, pa.binary()), pa.array(times, pa.int64())], ["no", "term", "times"])

    return items.select("no", F.col(text).cast("string").alias("text")).mapInArrow(count, "no long, term binary, times long")


def _scan(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    return docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).cast("string").alias("text"), F.spark_partition_id().alias("part"))


#: The number under which the counts of all documents and terms come.
_ALL = -1


def counted(docs: DataFrame, doc_id: str, text: str, wanted: dict[bytes, int]) -> DataFrame:
    """df and the largest tf of the wanted terms; under ``_ALL`` the documents with a term,
    and in ``terms`` all terms of those, wanted or not. Each task adds up its own rows first."""

    def count(batches):
        df, most, n_docs, n_terms = Counter(), {}, 0, 0
        for _, body in _texts(batches):
            if not (words := terms(body)):
                continue
            n_docs += 1
            n_terms += len(words)
            for word, n in Counter(words).items():
                if (at := wanted.get(word)) is not None:
                    df[at] += 1
                    if n > most.get(at, 0):
                        most[at] = n
        rows = [(t, n, most[t], 0) for t, n in df.items()] + [(_ALL, n_docs, 0, n_terms)]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), (pa.int32(), *[pa.int64()] * 3))], ["term", "df", "most", "terms"])

    local = _scan(docs, doc_id, text).mapInArrow(count, "term int, df long, most long, terms long")
    return local.groupBy("term").agg(F.sum("df").alias("df"), F.max("most").alias("most"), F.sum("terms").alias("terms"))


@dataclass(frozen=True)
class Round:
    """What the tasks of one round know: its items' terms and the weights of those."""

    pairs: dict[int, list[tuple[int, int, int]]]  # bundle -> (item, term, times)
    weight: np.ndarray
    owner: np.ndarray
    best: np.ndarray  # the largest contribution of a term
    n_docs: int
    n_terms: int

    def ahead(self, stage: int) -> dict[int, int]:
        """Per item, the most that the owners after ``stage`` can add."""
        out: dict[int, int] = {}
        for rows in self.pairs.values():
            for item, term, times in rows:
                out[item] = out.get(item, 0) + (times * int(self.best[term]) if self.owner[term] > stage else 0)
        return out


def contribution(weight: int, tf: int, m: int) -> int:
    return weight * ((1_000_000_000 * tf) // (1000 * tf + 12 * m))


def planned(pairs: dict, counts: pa.Table, n_wanted: int) -> Round:
    """Weights and owners of the terms from ``counted``."""
    df, most, n_docs, n_terms = np.zeros(n_wanted, np.int64), np.ones(n_wanted, np.int64), 0, 0
    for term, n, largest, total in zip(*(counts[c].to_pylist() for c in ("term", "df", "most", "terms"))):
        if term == _ALL:
            n_docs, n_terms = n, total
        else:
            df[term], most[term] = n, largest
    weight = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * d + 1))) for d in df.tolist()], np.int64)
    order = np.argsort(df, kind="stable")
    share = np.cumsum(df[order]) / max(1, df.sum())
    owner = np.empty(n_wanted, np.int64)
    owner[order] = np.searchsorted(OWNERS[:-1], share, side="left")
    best = np.array([contribution(w, t, 75) for w, t in zip(weight.tolist(), most.tolist())], np.int64)
    return Round(pairs, weight, owner, best, n_docs, n_terms)


_OWNED = "owner int, bundle long, block long, docs array<long>, term binary, slot binary, gain binary"
_KINDS = [pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.binary(), pa.binary(), pa.binary()]
#: The owner whose rows list the documents of the blocks.
_NOBODY = -1


def postings(docs: DataFrame, doc_id: str, text: str, wanted: dict[bytes, int], plan: Round) -> DataFrame:
    """Per owner, bundle and block the contributions of every posting, sorted by term; and per
    bundle and block its documents, by id and missing ones last. Documents without a wanted
    term are in no block."""
    bundles = {b: np.unique([t for _, t, _ in rows]) for b, rows in plan.pairs.items()}

    def block(number, found):
        found.sort(key=lambda f: _LAST if f[0] is None else f[0])
        sizes = [len(hits) for *_, hits in found]
        term = np.concatenate([np.fromiter(hits, np.int32, len(hits)) for *_, hits in found])
        tf = np.concatenate([np.fromiter(hits.values(), np.int64, len(hits)) for *_, hits in found])
        slot = np.repeat(np.arange(len(found), dtype=np.int32), sizes)
        order = np.argsort(term, kind="stable")
        term, slot, tf = term[order], slot[order], tf[order]
        m = np.array([75 + 25 * n * plan.n_docs // plan.n_terms for _, n, _ in found], np.int64)
        gain = plan.weight[term] * ((1_000_000_000 * tf) // (1000 * tf + 12 * m[slot]))
        for bundle, mine in bundles.items():
            here = np.isin(term, mine)
            rows = [(_NOBODY, bundle, number, [f[0] for f in found], None, None, None)] if here.any() else []
            for stage in range(len(OWNERS)):
                kept = here & (plan.owner[term] == stage)
                if kept.any():
                    rows.append((stage, bundle, number, None, term[kept].tobytes(), slot[kept].tobytes(), gain[kept].tobytes()))
            if rows:
                columns = [pa.array(c, k) for c, k in zip(zip(*rows), _KINDS)]
                yield pa.RecordBatch.from_arrays(columns, ["owner", "bundle", "block", "docs", "term", "slot", "gain"])

    def build(batches):
        found, held_now, made, part = [], 0, 0, 0
        for batch in batches:
            part = batch.column(2)[0].as_py() if batch.num_rows else part
            for ident, body in _texts([batch]):
                words = terms(body)
                hits = {at: n for word, n in Counter(words).items() if (at := wanted.get(word)) is not None}
                if hits:
                    found.append((ident, len(words), hits))
                    held_now += len(hits)
                if len(found) == BLOCK_DOCS or held_now >= BLOCK_POSTINGS:
                    yield from block((part << 33) + made, found)
                    found, held_now, made = [], 0, made + 1
        if found:
            yield from block((part << 33) + made, found)

    return _scan(docs, doc_id, text).mapInArrow(build, _OWNED)


_CARRIED = "bundle long, block long, docs array<long>, item binary, slot binary, score binary, tops array<struct<item: long, doc_id: long, score: long>>"
_ARROW = pa.schema([
    ("bundle", pa.int64()), ("block", pa.int64()), ("docs", pa.list_(pa.int64())), ("item", pa.binary()), ("slot", pa.binary()), ("score", pa.binary()),
    ("tops", pa.list_(pa.struct([("item", pa.int64()), ("doc_id", pa.int64()), ("score", pa.int64())]))),
])


def _visit(carried: DataFrame, owned: DataFrame, plan: Round, stage: int, floor: dict[int, int], hits: int) -> DataFrame:
    """The bundles after this owner has added its contributions.

    ``floor`` is the score of each item's last hit so far; accumulators that can't reach
    it with what this and the later owners can add are left out.
    """
    ahead = plan.ahead(stage - 1)
    known = {}
    for bundle, rows in plan.pairs.items():
        items = np.unique([item for item, _, _ in rows])
        mine = np.array([(item, term, times) for item, term, times in rows if plan.owner[term] == stage], np.int64).reshape(-1, 3)
        rest = np.array([ahead[item] for item in items.tolist()], np.int64)[:, None]
        least = np.array([floor.get(item, 0) for item in items.tolist()], np.int64)[:, None]
        known[bundle] = items, np.searchsorted(items, mine[:, 0]), mine[:, 1], mine[:, 2], rest, least

    def add(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return _ARROW.empty_table()
        # One row at most on either side: the accumulators and the postings of this bundle and block.
        items, of, wanted, times, rest, least = known[left["bundle"][0].as_py()]
        docs = left["docs"].combine_chunks().flatten()
        item, slot, score = (np.frombuffer(left[c][0].as_py(), k) for c, k in (("item", np.int64), ("slot", np.int32), ("score", np.int64)))
        scores = np.zeros((len(items), len(docs)), np.int64)
        scores[np.searchsorted(items, item), slot] = score
        scores[scores + rest < least] = 0
        if right.num_rows:
            term, slot, gain = (np.frombuffer(right[c][0].as_py(), k) for c, k in (("term", np.int32), ("slot", np.int32), ("gain", np.int64)))
            first, last = np.searchsorted(term, wanted, side="left"), np.searchsorted(term, wanted, side="right")
            n = last - first
            at = np.repeat(first - (np.cumsum(n) - n), n) + np.arange(n.sum())
            cell = np.repeat(of, n) * len(docs) + slot[at]
            alive = ((scores > 0) | (rest >= least)).ravel()[cell]
            np.add.at(scores.reshape(-1), cell[alive], (gain[at] * np.repeat(times, n))[alive])
        line, slot = np.nonzero(scores)
        score = scores[line, slot]
        # The floor is reached by as many documents as there are hits, so the best are among these.
        near = score >= least[line, 0]
        # Slots are in order of ids and settle ties.
        order = np.lexsort((slot[near], -score[near], line[near]))
        top_line, top_slot, top_score = line[near][order], slot[near][order], score[near][order]
        rank = np.arange(len(order)) - np.searchsorted(top_line, top_line)
        top = rank < hits
        tops = pa.StructArray.from_arrays(
            [pa.array(items[top_line[top]]), docs.take(pa.array(top_slot[top])), pa.array(top_score[top])], ["item", "doc_id", "score"]
        )
        columns = {
            "bundle": left["bundle"], "block": left["block"], "docs": left["docs"], "item": [items[line].tobytes()],
            "slot": [slot.astype(np.int32).tobytes()], "score": [score.tobytes()], "tops": pa.ListArray.from_arrays(pa.array([0, len(tops)], pa.int32()), tops),
        }
        return pa.table([pa.array(c, f.type) if isinstance(c, list) else c for c, f in zip(columns.values(), _ARROW)], schema=_ARROW)

    keys = ("bundle", "block")
    return carried.groupBy(*keys).cogroup(owned.groupBy(*keys)).applyInArrow(add, _CARRIED)


def _best(carried: DataFrame, hits: int) -> DataFrame:
    """item, doc_id, score, rank: the first hits of every item over all blocks. Spark keeps
    that many rows per item and task before its shuffle."""
    rows = carried.select(F.explode("tops").alias("t")).select("t.*")
    order = Window.partitionBy("item").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    return rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= hits)


def _search(spark: SparkSession, docs: DataFrame, doc_id: str, text: str, pairs: pa.Table, hits: int) -> DataFrame:
    """One round: its items against all documents."""
    wanted: dict[bytes, int] = {}
    by_bundle: dict[int, list] = {}
    for bundle, no, term, times in zip(*(pairs[c].to_pylist() for c in ("bundle", "no", "term", "times"))):
        by_bundle.setdefault(bundle, []).append((no, wanted.setdefault(term, len(wanted)), times))
    counts = counted(docs, doc_id, text, wanted).toArrow()
    plan = planned(by_bundle, counts, len(wanted))
    owned, owned_path = held(postings(docs, doc_id, text, wanted, plan), "postings", by="owner")
    none, paths, floor = F.lit(b""), [], {}
    blocks = owned.filter(F.col("owner") == _NOBODY)
    carried = blocks.select("bundle", "block", "docs", none.alias("item"), none.alias("slot"), none.alias("score"))
    for stage in range(len(OWNERS)):
        carried, path = held(_visit(carried, owned.filter(F.col("owner") == stage).drop("docs"), plan, stage, floor, hits), "accumulators")
        if stage + 1 < len(OWNERS):
            last = _best(carried, hits).filter(F.col("rank") == hits).select("item", "score").toArrow()
            floor = dict(zip(last["item"].to_pylist(), last["score"].to_pylist()))
            carried = carried.drop("tops")
        paths.append(path)
    for path in (owned_path, *paths[:-1]):
        dropped(docs, path)
    return _best(carried, hits)


def search(docs: DataFrame, doc_id: str, text: str, items: DataFrame, item_id: str, item_text: str, hits: int = 20) -> DataFrame:
    """item_id, rank, doc_id, score of the ``hits`` best documents of every item.

    Scores are sums of integers over the item's terms, repeats included; documents without
    a term in common aren't hits. Equal scores go by ascending id, a missing id last. Every
    row is a document and an item of its own, so repeated rows rank one after the other and
    a repeated item id has several rankings. Missing texts have no terms. Only the named
    columns are read; the result's names are fixed.
    """
    spark, kind = docs.sparkSession, items.schema[item_id].dataType
    numbered, _ = held(items.select(F.monotonically_increasing_id().alias("no"), F.col(item_id).alias("item_id"), F.col(item_text).alias("text")), "items")
    found, _ = held(item_terms(numbered, "item_id", "text"), "item-terms")
    sizes = found.groupBy("no").agg(F.greatest(F.count(F.lit(1)), F.lit(ITEM_WEIGHT)).alias("weight"))
    dealt, _ = held(running_sum(ordered(sizes, [], ["no"]), F.col("weight"), "sum").select(
        "no", F.expr(f"(sum - weight) div {BUNDLE_WEIGHT}").alias("bundle"), F.expr(f"(sum - weight) div {ROUND_WEIGHT}").alias("round"),
    ), "dealt")
    rounds = dealt.agg(F.max("round")).first()[0]
    schema = T.StructType([T.StructField("item", T.LongType()), T.StructField("doc_id", T.LongType()), T.StructField("score", T.LongType()), T.StructField("rank", T.IntegerType())])
    out = spark.createDataFrame([], schema)
    for number in range(0 if rounds is None else rounds + 1):
        mine = dealt.filter(F.col("round") == number)
        pairs = found.join(mine, "no").select("bundle", "no", "term", "times").orderBy("no", "term").toArrow()
        if pairs.num_rows:
            out = out.unionByName(_search(spark, docs, doc_id, text, pairs, hits))
    named = out.join(numbered.select(F.col("no").alias("item"), "item_id"), "item")
    return named.select(F.col("item_id").cast(kind), F.col("rank").cast("int"), "doc_id", "score")

"""Exact duplicates by owners that hold full texts in compressed radix (Patricia) tries.

Every text goes by length and content hash to one owner partition, which inserts the
whole byte string into a trie. A terminal node keeps how many rows ended there and the
best of them, so equality is that of bytes, not of hashes. Each scan task first inserts
its own rows, batch by batch, and passes on one entry per distinct text: a text that a
third of all rows repeat reaches its owner once per batch, not once per row.

The digest only chooses the owner: tries branch inside the texts, so texts that begin alike
share that beginning. A trie that outgrows its bound gives up subtrees, heavy ones first:
their entries go to a file of the task, later ones of the same subtree follow, and each
file is read back into a trie of its own at the end. The files are the running task's
own spill, in the folder Spark spills to itself; another attempt of a lost task makes its own.
"""

from __future__ import annotations

import hashlib
import os
import pickle
import tempfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .base import BLANKS, own, sliced

SPILL_BYTES = 96 << 20
#: A missing id comes after every other.
_LAST = 2**63 - 1


def _common(a: bytes, b: bytes) -> int:
    """Length of the common prefix: doubling steps, then halving."""
    end = min(len(a), len(b))
    if a[:end] == b[:end]:
        return end
    low, step = 0, 16
    while a[low : low + step] == b[low : low + step]:
        low += step
        step *= 2
    high = min(end, low + step)
    while low < high:
        mid = (low + high) // 2 + 1
        if a[low:mid] == b[low:mid]:
            low = mid
        else:
            high = mid - 1
    return low


class Node:
    __slots__ = ("label", "kids", "value", "weight", "file")

    def __init__(self, label: bytes, value=None, weight: int = 0):
        self.label, self.kids, self.value, self.weight, self.file = label, None, value, weight, None


def _merged(a, b):
    """Of two terminals: rows in all, and the longer original, then the smaller id."""
    return (a[0] + b[0], *min((a[1], a[2]), (b[1], b[2])))


#: Bytes a node takes besides its label, about.
_NODE_BYTES = 250


def _spill_folder() -> str | None:
    """Where the executor keeps its own spill; Spark names it to every Python worker."""
    return os.environ.get("SPARK_LOCAL_DIRS", "").split(",")[0] or None


class Trie:
    """Compressed radix trie from byte strings to (rows, -code points, id).

    Beyond ``limit`` bytes subtrees move to files: their node stays and says which. All its
    keys begin with ``prefix``, which is left out of them.
    """

    def __init__(self, limit: int | None = None, prefix: bytes = b""):
        self.root, self.limit, self.prefix, self.files = Node(b""), limit, prefix, 0

    def insert(self, key: bytes, value) -> None:
        node, path, added = self.root, [self.root], 0
        while True:
            if node.file is not None:
                pickle.dump((key, value), node.file)
                break
            if not key:
                node.value = value if node.value is None else _merged(node.value, value)
                break
            kid = node.kids.get(key[0]) if node.kids else None
            if kid is None:
                if node.kids is None:
                    node.kids = {}
                added += len(key) + _NODE_BYTES
                node.kids[key[0]] = Node(key, value, len(key) + _NODE_BYTES)
                break
            same = _common(kid.label, key)
            if same < len(kid.label):
                upper = Node(kid.label[:same], None, kid.weight + _NODE_BYTES)
                upper.kids = {kid.label[same]: kid}
                kid.label = kid.label[same:]
                kid.weight -= same
                node.kids[key[0]] = kid = upper
                # The new node counts itself already; those above it don't.
                for above in path:
                    above.weight += _NODE_BYTES
            path.append(kid)
            node, key = kid, key[same:]
        for above in path:
            above.weight += added
        while self.limit is not None and self.root.weight > self.limit and self._spill():
            pass

    def _spill(self) -> bool:
        """Move the subtree where the heaviest path begins to spread; False if that frees nothing."""
        heaviest = lambda node: max((k for k in (node.kids or {}).values() if k.file is None), key=lambda k: k.weight, default=None)
        path = [self.root]
        # What all keys begin with leads to no smaller part.
        while path[-1].kids and len(path[-1].kids) == 1 and (only := heaviest(path[-1])) is not None:
            path.append(only)
        kid = heaviest(path[-1])
        # Not so far that little is moved: then there would be many files.
        while kid is not None and (below := heaviest(kid)) is not None and 4 * below.weight > kid.weight and 8 * below.weight > self.limit:
            path.append(kid)
            kid = below
        freed = kid.weight - 1 - _NODE_BYTES if kid is not None else 0
        if freed <= 0:
            return False
        # The node stays with the first byte of its label, which tells it from the others.
        first, rest_of_label, file = kid.label[:1], kid.label[1:], tempfile.TemporaryFile(dir=_spill_folder())
        for rest, value in self._walk(kid):
            if value is not None:
                pickle.dump((rest_of_label + rest, value), file)
            else:
                self._copy(rest_of_label + rest[0], rest[1], file)
        kid.label, kid.kids, kid.value, kid.file, self.files = first, None, None, file, self.files + 1
        for node in (*path, kid):
            node.weight -= freed
        return True

    def _copy(self, path: bytes, node: Node, out) -> None:
        """What a subtree inside the one that moves has in its file already."""
        for rest, value in _stored(node.file):
            pickle.dump((path + rest, value), out)
        self.files -= 1

    def _walk(self, top: Node) -> Iterator:
        """(path below ``top``, value) of every terminal, and ((path, node), None) of every
        subtree in a file; a stack, as paths may be deep."""
        todo = [(top, b"")]
        while todo:
            node, path = todo.pop()
            if node.file is not None:
                yield (path, node), None
            if node.value is not None:
                yield path, node.value
            todo.extend((kid, path + kid.label) for kid in (node.kids or {}).values())

    def items(self) -> Iterator:
        """Every byte string with its terminal. Subtrees in files come last, one at a time."""
        spilt: list[tuple[bytes, Node]] = []
        yield from self._held(spilt)
        while spilt:
            prefix, node = spilt.pop()
            part = Trie(self.limit, prefix)
            for rest, value in _stored(node.file):
                part.insert(rest, value)
            yield from part._held(spilt)

    def _held(self, spilt: list[tuple[bytes, Node]]) -> Iterator:
        """What is in memory; ``spilt`` gets the subtrees that aren't. The trie is empty then."""
        for path, value in self._walk(self.root):
            if value is None:
                spilt.append((self.prefix + path[0], path[1]))
            else:
                yield self.prefix + path, value
        self.root = Node(b"")


def _stored(file) -> Iterator:
    """The entries of a file, which is closed at the end."""
    file.seek(0)
    while True:
        try:
            yield pickle.load(file)
        except EOFError:
            file.close()
            return


def without_blanks(text: Column) -> Column:
    """The text with every ASCII white-space character deleted; missing counts as empty."""
    return F.translate(F.coalesce(text.cast("string"), F.lit("")), BLANKS, "")


_ENTRY = "body binary, n long, points long, id long"


def owners(entries: DataFrame, spill_bytes: int = SPILL_BYTES) -> DataFrame:
    """One row per distinct text of ``entries`` (body, n, points, id).

    Returns digest, n_bytes, n (rows), points and id of the row that stays. Texts are told
    apart by their bytes; the digest is the key by which rows find their group again.
    """

    def columns(batch: pa.RecordBatch):
        for part in sliced(batch):
            yield from zip(*(part.column(c).to_pylist() for c in ("body", "n", "points", "id")))

    def combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            trie = Trie()
            for body, n, points, ident in columns(batch):
                trie.insert(body, (n, -points, ident))
            rows = [(body, n, -points, ident) for body, (n, points, ident) in trie.items()]
            if rows:
                kinds = (pa.binary(), pa.int64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], ["body", "n", "points", "id"])

    def own_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, out = Trie(spill_bytes), []
        for batch in batches:
            for body, n, points, ident in columns(batch):
                trie.insert(body, (n, -points, ident))
        for body, (n, points, ident) in trie.items():
            out.append((hashlib.sha256(body).digest(), len(body), n, -points, ident))
            if len(out) == 10_000:
                yield result(out)
                out = []
        if out:
            yield result(out)

    def result(rows) -> pa.RecordBatch:
        digest, *numbers = map(list, zip(*rows))
        return pa.RecordBatch.from_arrays(
            [pa.array(digest, pa.binary()), *(pa.array(x, pa.int64()) for x in numbers)], ["digest", "n_bytes", "n", "points", "id"]
        )

    local = entries.select("body", "n", "points", "id").mapInArrow(combine, _ENTRY)
    dealt = local.repartition(F.octet_length("body"), F.sha2("body", 256))
    return dealt.mapInArrow(own_texts, "digest binary, n_bytes long, n long, points long, id long")


def exact_groups(df: DataFrame, doc_id: str, text: str, spill_bytes: int = SPILL_BYTES) -> DataFrame:
    """Add ``keep_id``, ``group_size``, ``kept`` and ``text_sha256`` to every row.

    Texts are equal when identical without ASCII white space; missing counts as empty.
    Of equal texts the one with the most code points stays, then the smallest id; a
    missing id comes last and its group's ``keep_id`` is null only if all are missing.
    Rows repeating both id and text can't be told apart: all of them count in
    ``group_size`` and are marked alike. Columns of these names are replaced.
    """
    digest, size, points, length, ident = (own(df, x) for x in ("digest", "bytes", "points", "length", "id"))
    df = df.drop("keep_id", "group_size", "kept", "text_sha256")
    body = without_blanks(F.col(text))
    number = F.coalesce(F.col(doc_id), F.lit(_LAST))
    points_of = F.length(F.coalesce(F.col(text).cast("string"), F.lit("")))
    entries = df.select(
        body.cast("binary").alias("body"),
        F.lit(1).cast("long").alias("n"),
        points_of.cast("long").alias("points"),
        number.alias("id"),
    )
    best = owners(entries, spill_bytes).select(
        F.col("digest").alias(digest), F.col("n_bytes").alias(size), F.col("n").alias("group_size"),
        F.col("points").alias(points), F.col("id").alias(ident),
    )
    keyed = (
        df.withColumn(digest, F.unhex(F.sha2(body.cast("binary"), 256)))
        .withColumn(size, F.octet_length(body).cast("long"))
        .withColumn(length, points_of.cast("long"))
    )
    joined = keyed.join(best, [digest, size])
    kept = (F.coalesce(F.col(doc_id), F.lit(_LAST)) == F.col(ident)) & (F.col(length) == F.col(points))
    return joined.select(
        *df.columns,
        F.when(F.col(ident) != _LAST, F.col(ident)).alias("keep_id"),
        "group_size",
        kept.alias("kept"),
        F.lower(F.hex(digest)).alias("text_sha256"),
    )

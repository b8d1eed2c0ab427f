"""SentencePiece encoding by a table of distinct chunks, and decoding.

SentencePiece writes each space as a marker and one more in front of the text. Where no
piece of the vocabulary holds a marker after another character, no merge crosses from
one marked word to the next, so a text's pieces are those of its marked words in order.
Each task keeps a table from distinct marked word to ids. Arrow cuts the texts of a slice
into words and numbers the distinct ones; those the table lacks go to the library, many
joined to one text, whose ids are cut again where a marker begins a word. The ids are then
taken by position. The words of a text stay together in its row: nothing is shuffled,
however long the text or however common the word.

A vocabulary that can cross markers, or whose model rewrites characters, is encoded text
by text by the library instead.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import filterfalse

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import own, sliced

MARK = "▁"
TABLE_WORDS = 200_000
#: Bytes of text whose words are looked up together, besides a longer text's.
SLICE_BYTES = 1 << 21
#: New words in one text for the library; its time per word grows with much longer ones.
JOINED_WORDS = 256

_CROSSING = re.compile(f"[^{MARK}]{MARK}")
_PROBES = ("a", " a", "a ", "  a  b ", "\ta\nb", "ﬁ é ½ Å é 　x", "<s> a", "中\x00b", f"a{MARK}b")


def _processor(model_path: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=model_path)


class ChunkTable(dict):
    """Distinct marked word (its first marker left out, others as spaces) to ids, as 32-bit integers in bytes.

    Starts anew rather than exceed ``limit`` words, unless one slice has more of its own, so
    memory is bounded.
    """

    def __init__(self, model_path: str, limit: int = TABLE_WORDS):
        super().__init__()
        self.processor, self.limit = _processor(model_path), limit
        self.mark = np.array([self.processor.piece_to_id(MARK)], dtype=np.int32).tobytes()
        pieces = [self.processor.id_to_piece(i) for i in range(self.processor.vocab_size())]
        self.marked = np.array([p.startswith(MARK) for p in pieces])
        self.only_marks = np.array([not p.strip(MARK) for p in pieces])
        self.exact = not any(map(_CROSSING.search, pieces)) and all(self.encode(p) == self.whole(p) for p in _PROBES)

    def whole(self, text: str) -> bytes:
        return np.array(self.processor.encode(text), dtype=np.int32).tobytes()

    def learn(self, words: list[str]) -> None:
        """Add the ids of ``words``."""
        # Markers at a word's end would run into the next word's.
        joined = [w for w in words if w and w[-1] != " "]
        for at in range(0, len(joined), JOINED_WORDS):
            group = joined[at : at + JOINED_WORDS]
            ids = np.array(self.processor.encode(" ".join(group)), dtype=np.int32)
            first = self.marked[ids]
            first[1:] &= ~self.only_marks[ids[:-1]]
            raw, starts = ids.tobytes(), (4 * np.flatnonzero(first)).tolist()
            if len(starts) == len(group):
                self.update((w, raw[i:j]) for w, i, j in zip(group, starts, [*starts[1:], len(raw)]))
        for word in filterfalse(self.__contains__, words):
            # The library puts the left-out marker in front again, but not before nothing.
            self[word] = self.whole(word) if word else self.mark

    def words(self, words: list[str]) -> list[bytes]:
        new = list(filterfalse(self.__contains__, words))
        if len(self) + len(new) > self.limit:
            self.clear()
            new = words
        self.learn(new)
        return list(map(self.__getitem__, words))

    def arrays(self, texts: pa.Array) -> pa.ListArray:
        """The ids of each text, by the words' ids."""
        filled = pc.fill_null(pc.greater(pc.binary_length(texts), 0), False)
        spaced = pc.replace_substring(texts.filter(filled), MARK, " ")
        # A marked word begins at a space behind another character; further spaces belong to it.
        lists = pc.split_pattern(pc.replace_substring_regex(spaced, "([^ ]) ", rf"\1{MARK}"), MARK)
        coded = pc.list_flatten(lists).dictionary_encode()
        distinct = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(coded.dictionary)], pa.int32()), coded.dictionary), MARK)
        found = self.words(distinct[0].as_py().split(MARK)) if len(coded) else []
        taken = _lists(np.frombuffer(b"".join(found), dtype=np.int32), [len(f) // 4 for f in found]).take(coded.indices)
        counts = np.zeros(len(texts) + 1, dtype=np.int64)
        counts[1:][filled.to_numpy(zero_copy_only=False)] = pc.list_value_length(lists).to_numpy()
        ends = taken.offsets.to_numpy()[np.cumsum(counts)]
        return pa.ListArray.from_arrays(pa.array(ends), taken.values)

    def encode(self, text: str | None) -> bytes:
        return self.arrays(pa.array([text], pa.string())).values.to_numpy().tobytes()

    def ids(self, text: str | None) -> bytes:
        return self.encode(text) if self.exact else self.whole(text or "")

    def lists(self, texts: pa.Array) -> pa.ListArray:
        if self.exact:
            return self.arrays(texts)
        rows = [self.whole(t.as_py() or "") for t in texts]
        return _lists(np.frombuffer(b"".join(rows), dtype=np.int32), [len(r) // 4 for r in rows])


def _lists(flat: np.ndarray, lengths: list[int]) -> pa.ListArray:
    ends = np.cumsum([0, *lengths], dtype=np.int64).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))


def _slices(texts: pa.Array) -> Iterator[pa.Array]:
    """The texts in parts of some ``SLICE_BYTES``."""
    at = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(), dtype=np.int64) // SLICE_BYTES
    cuts = [0, *(np.flatnonzero(np.diff(at)) + 1).tolist(), len(texts)]
    return (texts.slice(i, j - i) for i, j in zip(cuts, cuts[1:]))


def _decoded(processor, ids: pa.ListArray) -> pa.Array:
    # Through numpy: Arrow makes a scalar of each id first, which takes longer than decoding.
    rows = (row.values.to_numpy().tolist() if row.is_valid else [] for row in ids)
    return pa.array([processor.decode(row) for row in rows], pa.string())


def encode(df: DataFrame, text: str, ids: str, model_path: str, table_words: int = TABLE_WORDS) -> DataFrame:
    """Add ``ids`` (array of int): the whole text as the library encodes it.

    No begin or end ids, no sampling. Missing and empty texts have no ids. Rows are
    independent, so repeated rows get equal ids; a column named ``ids`` is replaced, others
    pass through unread.
    """

    @F.arrow_udf("array<int>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        table = ChunkTable(model_path, table_words)
        for batch in batches:
            yield from map(table.lists, _slices(batch))

    return df.withColumn(ids, run(F.col(text).cast("string")))


def decode(df: DataFrame, ids: str, text: str, model_path: str) -> DataFrame:
    """Add ``text``: what the library decodes the whole array of ids to.

    A missing array decodes to the empty text. An id outside the vocabulary is an error. A
    column named ``text`` is replaced, others pass through unread.
    """

    @F.arrow_udf("string")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        processor = _processor(model_path)
        for batch in batches:
            yield from (_decoded(processor, part) for part in sliced(batch))

    return df.withColumn(text, run(F.col(ids)))


def round_trip(df: DataFrame, text: str, ids: str, back: str, model_path: str, table_words: int = TABLE_WORDS) -> DataFrame:
    """Add what ``encode`` and then ``decode`` add: ``ids``, and as ``back`` what they decode to.

    A task needs one Python worker for it instead of one for each of the two, and ids aren't
    sent to Python again. Columns of the two names are replaced, others pass through unread.
    """

    @F.arrow_udf("struct<ids: array<int>, back: string>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        table = ChunkTable(model_path, table_words)
        for batch in batches:
            for found in map(table.lists, _slices(batch)):
                yield pa.StructArray.from_arrays([found, _decoded(table.processor, found)], ["ids", "back"])

    made = own(df, "made")
    rest = [c for c in df.columns if c.lower() not in (ids.lower(), back.lower())]
    return df.withColumn(made, run(F.col(text).cast("string"))).select(*rest, F.col(f"{made}.ids").alias(ids), F.col(f"{made}.back").alias(back))

"""Fill-in-middle: documents cut at two token borders and laid out with markers.

The borders of a text's tokens are a set of code point offsets, kept as a Roaring bitmap
is: one container per 65,536 offsets, an array of the low halves, a bitmap or a list of
runs, whichever is smallest. Cumulative cardinalities in front of the containers turn
"the border after the i-th token" into a search over containers and a select in one.
"""

from __future__ import annotations

from bisect import bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .base import own

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
PLAIN, PSM, SPM = "plain", "psm", "spm"
#: Of a hundred documents so many stay as they are, and so many of the others start with the suffix.
PLAIN_PERCENT, SPM_PERCENT = 10, 20

_SPAN = 1 << 16


class ArrayContainer:
    """The low halves themselves."""

    def __init__(self, low: np.ndarray):
        self.low = low.astype(np.uint16)

    def select(self, i: int) -> int:
        return int(self.low[i])


class BitmapContainer:
    """One bit per offset; counts before each 64-bit word lead to the word that holds the i-th."""

    def __init__(self, low: np.ndarray):
        bits = np.zeros(_SPAN, np.uint8)
        bits[low] = 1
        self.words = np.packbits(bits, bitorder="little").view(np.uint64)
        self.before = np.concatenate(([0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)))

    def select(self, i: int) -> int:
        word = int(np.searchsorted(self.before, i, side="right")) - 1
        rest, left = int(self.words[word]), i - int(self.before[word])
        for _ in range(left):
            rest &= rest - 1
        return word * 64 + (rest & -rest).bit_length() - 1


class RunContainer:
    """Starts of the runs of consecutive offsets, and how many offsets lie before each."""

    def __init__(self, starts: np.ndarray, lengths: np.ndarray):
        self.starts = starts.astype(np.uint16)
        self.before = np.concatenate(([0], np.cumsum(lengths, dtype=np.int64)))

    def select(self, i: int) -> int:
        run = int(np.searchsorted(self.before, i, side="right")) - 1
        return int(self.starts[run]) + i - int(self.before[run])


def container(low: np.ndarray):
    """The smallest container of sorted low halves: 2 bytes an entry, 4 a run, or 8,192."""
    heads = np.flatnonzero(np.diff(low, prepend=low[0] - 2) != 1)
    if 4 * len(heads) < min(2 * len(low), _SPAN // 8):
        return RunContainer(low[heads], np.diff(np.append(heads, len(low))))
    return ArrayContainer(low) if 2 * len(low) <= _SPAN // 8 else BitmapContainer(low)


class OffsetSet:
    """A sorted set of offsets in containers, with ``select``."""

    def __init__(self, offsets: np.ndarray):
        high = offsets >> 16
        heads = np.flatnonzero(np.diff(high, prepend=-1))
        ends = np.append(heads[1:], len(offsets))
        self.keys = high[heads].tolist()
        self.before = [0, *ends.tolist()]
        self.containers = [container(offsets[a:b] & (_SPAN - 1)) for a, b in zip(heads, ends)]

    def __len__(self) -> int:
        return self.before[-1]

    def select(self, i: int) -> int:
        """The i-th smallest offset, from 0."""
        at = bisect_right(self.before, i) - 1
        return (self.keys[at] << 16) + self.containers[at].select(i - self.before[at])


def borders(text: str) -> OffsetSet:
    """Where tokens end, and 0. A token is a longest run of A-Z and a-z, or any other code point."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = ((points | 32) - np.uint32(97)) < 26
    ends = np.ones(len(points) + 1, bool)
    ends[1:-1] = ~(letter[1:] & letter[:-1])
    return OffsetSet(np.flatnonzero(ends))


def cuts(text: str, first: int, second: int) -> tuple[int, int, int]:
    """The number of tokens n and two cut offsets, at tokens ``first`` and ``second`` modulo n + 1."""
    at = borders(text)
    units = sorted((first % len(at), second % len(at)))
    return len(at) - 1, *(at.select(u) for u in units)


def arrange(text: str, form: str, start: int, end: int) -> str:
    prefix, middle, suffix = text[:start], text[start:end], text[end:]
    if form == PSM:
        return f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}"
    if form == SPM:
        return f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}"
    return text


def rebuild(output: str, form: str) -> str:
    """The text an output was made from. A marker is none of its own borders, so the first
    one found is the one that was put there."""
    if form == PLAIN:
        return output
    first, second = (PREFIX, SUFFIX) if form == PSM else (SUFFIX, PREFIX)
    if not output.startswith(first):
        raise ValueError("the output doesn't begin with its marker")
    one, rest = output[len(first) :].split(second, 1)
    two, middle = rest.split(MIDDLE, 1)
    prefix, suffix = (one, two) if form == PSM else (two, one)
    return prefix + middle + suffix


def _draws(doc_id: Column, seed: int) -> list[Column]:
    """Four numbers of 32 bits from a row's id; rows without one share theirs."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("long") for i in range(4)]


def fill_in_middle(df: DataFrame, doc_id: str, text: str, seed: int = 1) -> DataFrame:
    """Add ``n`` (tokens), ``form``, ``prefix_chars``, ``middle_chars`` and ``output``.

    The draws depend on ``seed`` and the id alone, so a rerun and a repeated row give the
    same output. Missing text counts as empty. A text that is empty or holds a marker stays
    plain, and its cut columns are null. Columns of these names are replaced, also when
    ``doc_id`` or ``text`` is one of them.
    """
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    h1, h2, h3, h4 = _draws(F.col(doc_id), seed)
    marked = F.contains(body, F.lit(PREFIX)) | F.contains(body, F.lit(SUFFIX)) | F.contains(body, F.lit(MIDDLE))
    plain = (body == "") | marked | (h3 % 100 >= 100 - PLAIN_PERCENT)
    form = F.when(plain, PLAIN).when(h4 % 100 < SPM_PERCENT, SPM).otherwise(PSM)

    @F.arrow_udf("struct<n: bigint, prefix_chars: bigint, middle_chars: bigint, output: string>")
    def cut(texts, firsts, seconds, forms):
        n, prefix, middle, output = [], [], [], []
        for body, a, b, shape in zip(texts, firsts, seconds, forms):
            body, shape = body.as_py(), shape.as_py()
            tokens, start, end = cuts(body, a.as_py(), b.as_py())
            n.append(tokens)
            prefix.append(None if shape == PLAIN else start)
            middle.append(None if shape == PLAIN else end - start)
            output.append(arrange(body, shape, start, end))
        return pa.StructArray.from_arrays(
            [*(pa.array(x, pa.int64()) for x in (n, prefix, middle)), pa.array(output, pa.string())],
            ["n", "prefix_chars", "middle_chars", "output"],
        )

    shape, done = own(df, "form"), own(df, "cut")
    added = ("n", "form", "prefix_chars", "middle_chars", "output")
    kept = [c for c in df.columns if c.lower() not in added]
    out = df.withColumn(shape, form).withColumn(done, cut(body, h1, h2, F.col(shape)))
    return out.select(*kept, F.col(done)["n"].alias("n"), F.col(shape).alias("form"), *[F.col(done)[c].alias(c) for c in added[2:]])


def rebuilt(output: str, form: str) -> Column:
    """The text behind an output, read back from the output and its form alone."""

    @F.arrow_udf("string")
    def back(outputs, forms):
        return pa.array([rebuild(o.as_py(), f.as_py()) for o, f in zip(outputs, forms)], pa.string())

    return back(output, form)

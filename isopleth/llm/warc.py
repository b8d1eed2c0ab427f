"""Fixity audit of archives by Merkle trees.

Records of an archive file lie one after the other at ordered offsets. Each record is
hashed, and ranges of records under a tree node are hashed from their children in
order, up to one root per file. Two replicas are compared root by root; only under
nodes that differ are the next nodes joined, down to the records. Positions are absolute
(number ``n`` lies under node ``n div fan_out`` one level up), so a damaged record
changes its own path to the root and no other. Everything is DataFrame operations.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .base import held, hex_digest

FAN_OUT = 16
_CRLF = "\r\n"


def warc_record(url: Column, ident: Column, payload: Column) -> Column:
    """A response record as bytes: header, payload and the two line ends after it.

    Missing fields count as empty; line ends in the url are blanks.
    """
    body = F.coalesce(payload.cast("string"), F.lit("")).cast("binary")
    uri = F.translate(F.coalesce(url.cast("string"), F.lit("")), "\r\n", "  ")
    head = F.concat_ws(
        _CRLF,
        F.lit("WARC/1.1"),
        F.lit("WARC-Type: response"),
        F.concat(F.lit("WARC-Record-ID: <urn:page:"), F.coalesce(ident.cast("string"), F.lit("")), F.lit(">")),
        F.concat(F.lit("WARC-Target-URI: "), uri),
        F.concat(F.lit("WARC-Payload-Digest: sha256:"), F.sha2(body, 256)),
        F.concat(F.lit("Content-Length: "), F.octet_length(body).cast("string")),
        F.lit(_CRLF),
    )
    return F.concat(head.cast("binary"), body, F.lit(_CRLF * 2).cast("binary"))


@dataclass
class Tree:
    """The levels of the trees of many files, records first, roots last."""

    levels: list[DataFrame]


def leaves(records: DataFrame, file: str, number: str, record: str) -> DataFrame:
    """(file, number, offset, length, hash) of each record of (file, number, bytes) rows.

    ``number`` is the record's place in its file, from 0; gaps are records that are not
    there. Where a place is taken more than once, its one leaf covers all records there: the
    lengths are summed and the hash is that of the sorted hex hashes, one after the other.
    Rows without file or number are left out, a missing record is an empty one. ``offset``
    sums the lengths before the place.
    """
    size = F.octet_length(F.coalesce(F.col(record), F.lit(b""))).cast("long")
    digest = hex_digest(F.coalesce(F.col(record), F.lit(b"")))
    rows = records.filter(F.col(file).isNotNull() & F.col(number).isNotNull()).select(
        F.col(file).alias("file"), F.col(number).cast("long").alias("number"), digest.alias("hash"), size.alias("length")
    )
    one = rows.groupBy("file", "number").agg(F.sort_array(F.collect_list("hash")).alias("all"), F.sum("length").alias("length"))
    one = one.withColumn("hash", F.when(F.size("all") == 1, F.col("all")[0]).otherwise(hex_digest(F.concat_ws("", "all"))))
    before = Window.partitionBy("file").orderBy("number").rowsBetween(Window.unboundedPreceding, -1)
    return one.select("file", "number", F.coalesce(F.sum("length").over(before), F.lit(0)).alias("offset"), "length", "hash")


def tree(records: DataFrame, depth: int, fan_out: int = FAN_OUT) -> Tree:
    """All levels over ``leaves``: ``depth`` levels above the records, the last with the root."""
    levels = [held(records, "merkle")[0]]
    for level in range(1, depth + 1):
        node = F.lit(0).cast("long") if level == depth else F.floor(F.col("number") / fan_out).cast("long")
        # At most fan_out children, in order; each line has the child's range from the node's start.
        nodes = levels[-1].groupBy("file", node.alias("node")).agg(
            F.array_sort(F.collect_list(F.struct("number", "offset", "length", "hash"))).alias("kids"),
            F.min("offset").alias("offset"),
            F.sum("length").alias("length"),
        )
        line = lambda k: F.concat_ws(":", k["number"], k["offset"] - F.col("offset"), k["length"], k["hash"])
        lines = F.concat_ws("\n", F.transform("kids", line))
        nodes = nodes.select("file", F.col("node").alias("number"), "offset", "length", hex_digest(lines).alias("hash"))
        levels.append(held(nodes, "merkle")[0])
    return Tree(levels)


def depth_for(records: int, fan_out: int = FAN_OUT) -> int:
    """Levels above the records so that no node has more than ``fan_out`` children."""
    depth = 1
    while fan_out**depth < records:
        depth += 1
    return depth


def audit(first: Tree, second: Tree, fan_out: int = FAN_OUT) -> DataFrame:
    """Records that differ between two replicas, found from the roots down.

    Returns file, number, offset and length (in the first replica, else in the second),
    hash_first, hash_second and kind: ``changed``, ``missing`` (not in the second) or
    ``extra`` (not in the first). Files in one replica only have all their records
    reported. A record is told apart by its hash. Nodes hold their children's offsets
    counted from the node's own start, so a change of length shows in the nodes above it
    and not in those of the sound records behind it.
    """
    under = None
    for level in range(len(first.levels) - 1, -1, -1):
        sides = []
        for side in (first, second):
            rows = side.levels[level]
            if under is not None:
                parent = F.lit(0).cast("long") if level == len(first.levels) - 2 else F.floor(F.col("number") / fan_out).cast("long")
                rows = rows.withColumn("parent", parent).join(under, ["file", "parent"], "left_semi").drop("parent")
            sides.append(rows)
        a, b = (s.select("file", "number", *(F.col(c).alias(f"{c}_{n}") for c in ("offset", "length", "hash"))) for s, n in zip(sides, ("first", "second")))
        both = a.join(b, ["file", "number"], "full_outer")
        same = F.col("hash_first").eqNullSafe(F.col("hash_second"))
        if level:
            under, _ = held(both.filter(~same).select("file", F.col("number").alias("parent")), "merkle-differs")
    kind = F.when(F.col("hash_second").isNull(), "missing").when(F.col("hash_first").isNull(), "extra").otherwise("changed")
    return both.filter(~same).select(
        "file", "number", F.coalesce("offset_first", "offset_second").alias("offset"),
        F.coalesce("length_first", "length_second").alias("length"), "hash_first", "hash_second", kind.alias("kind"),
    )

"""What the text operators share: safe column names, written intermediates, digests."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import scratch_path

# ASCII white space of the contracts: space, tab, line feed, vertical tab, form feed, return.
BLANKS = " \t\n\x0b\x0c\r"


def own(df: DataFrame, label: str) -> str:
    """A column name that ``df`` doesn't have yet, in any case spelling."""
    name, taken = f"llm_{label}", {c.lower() for c in df.columns}
    while name in taken:
        name += "_"
    return name


def held(df: DataFrame, label: str, by: str | None = None) -> tuple[DataFrame, str]:
    """``df`` written to the shared scratch folder and read again, and its path. ``by``
    names a column with few values, one folder for each.

    This cuts the lineage: whatever reads the result survives the loss of any executor
    without computing ``df`` again.
    """
    path = scratch_path(df.sparkSession, label)
    df.write.partitionBy(*([by] if by else [])).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


#: Rows of an Arrow batch whose texts are Python objects at the same time.
SLICE = 512


def sliced(batch, rows: int = SLICE):
    """An Arrow batch or array cut into parts, so a task holds few texts twice."""
    return (batch.slice(start, rows) for start in range(0, len(batch) if isinstance(batch, pa.Array) else batch.num_rows, rows))


def dropped(df: DataFrame, path: str) -> None:
    """Delete an intermediate once nothing reads it any more."""
    spark = df.sparkSession
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)


def learnable(doc_id: str) -> Column:
    """Rows a model may learn from; the others are held out."""
    return F.crc32(F.col(doc_id).cast("string")) % 3 != 1


def held_out(doc_id: str) -> Column:
    """Whether no model may have learnt from the row. A missing id is held out."""
    return F.coalesce(~learnable(doc_id), F.lit(True))


def hex_digest(column: Column) -> Column:
    return F.sha2(column.cast("binary"), 256)


def hash_filter(hashes: DataFrame, bits: int) -> np.ndarray:
    """A Bloom filter of the 64-bit hashes ``h`` with two probes each: the low and the high
    half, modulo ``bits``, a power of two. It has ``bits`` / 8 bytes, however many there are."""
    high = F.call_function("shiftrightunsigned", F.col("h"), F.lit(32))
    words = (
        hashes.select(F.explode(F.array(F.pmod("h", F.lit(bits)), F.pmod(high, F.lit(bits)))).alias("at"))
        .groupBy(F.shiftright("at", 6).alias("word"))
        .agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("at") % 64).cast("int"))).alias("bits"))
    )
    out = np.zeros(bits // 64, dtype=np.int64)
    got = words.toArrow()
    out[got["word"].to_numpy()] = got["bits"].to_numpy()
    return out.view(np.uint8)


def may_hold(bitmap: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Which unsigned hashes the filter doesn't rule out."""
    hit = np.ones(len(hashes), bool)
    for probe in (hashes, hashes >> np.uint64(32)):
        at = probe & np.uint64(len(bitmap) * 8 - 1)
        hit &= (bitmap[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1
    return hit

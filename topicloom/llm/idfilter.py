"""A filter of integer ids of fixed size, which spares most rows an exchange before an exact join.

The filter has eight bits an id or more, 2 ** LEAST at least and 2 ** MOST (4 MB) at most, so it may go to every
task. It lets through each id it was made of, and others by chance; beyond some 30 million ids it fills up and lets
more and more through, and the exact join that follows does all the work.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bytes as B

LEAST, MOST = 22, 25


def bits_of(ids: DataFrame, id_col: str = "doc_id") -> bytes:
    """The filter of the ids, a written table; what comes to the driver is bounded by its size. A null counts as 0."""
    size = min(MOST, max(LEAST, (8 * ids.count()).bit_length()))
    place = F.coalesce(F.pmod(id_col, F.lit(1 << size)), F.lit(0)).cast("int")
    rows = ids.select(place.alias("p")).groupBy(F.shiftright("p", 5).alias("w")).agg(F.expr("bit_or(shiftleft(1L, p & 31))").alias("m")).collect()
    bits = np.zeros(1 << size, np.uint8)
    for w, m in rows:
        bits[w * 32 : w * 32 + 32] = [m >> i & 1 for i in range(32)]
    return np.packbits(bits).tobytes()


def mask_of(bits: bytes) -> np.ndarray:
    return np.unpackbits(np.frombuffer(bits, np.uint8)).astype(bool)


def passes(column: pa.Array, mask: np.ndarray) -> pa.Array:
    """Which ids of a column of 64-bit integers the filter lets through."""
    ids = column.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    return pa.array(mask[ids & (len(mask) - 1)])


def where_passes(docs: DataFrame, bits: bytes, id_col: str = "doc_id", let: bool = True) -> DataFrame:
    """Rows of ``docs`` whose id the filter lets through, or with ``let`` false the others."""
    at = docs.columns.index(id_col)

    def rows(batches):
        mask = mask_of(bits)
        mask = mask if let else ~mask
        for batch in B.slices(batches):
            yield batch.filter(passes(batch.column(at), mask))

    return docs.mapInArrow(B.released(rows), docs.schema)

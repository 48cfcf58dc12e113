"""A fixed-size Bloom filter of ids, to keep texts out of shuffles that need few of them.

Its size does not depend on the data.  It only ever says "maybe" or "surely
not", so what it lets through is still joined exactly; with far more ids than
bits it lets everything through and only the saving is lost.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import seeded

BITS = 24  # two megabytes
HASHES = 2


def _places(ids: np.ndarray, bits: int) -> list[np.ndarray]:
    x = ids.astype(np.int64).view(np.uint64)
    return [(seeded(x, 900 + k) >> np.uint64(64 - bits)).astype(np.int64) for k in range(HASHES)]


def in_filter(words: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Which ids may be in the filter of these words."""
    out = np.ones(len(ids), bool)
    for place in _places(ids, len(words).bit_length() + 5):
        out &= (words[place >> 6] >> (place & 63).astype(np.uint64)) & np.uint64(1) == 1
    return out


class IdFilter:
    def __init__(self, ids: DataFrame, column: str, bits: int = BITS):
        """ids: a table of long ids; at most 2**bits / 64 rows come to the driver."""

        def run(batches):
            for batch in batches:
                place = np.concatenate(_places(batch.column(0).to_numpy(zero_copy_only=False), bits))
                yield pa.RecordBatch.from_arrays([pa.array(place >> 6), pa.array((np.uint64(1) << (place & 63).astype(np.uint64)).view(np.int64))], names=["word", "bits"])

        found = ids.where(F.col(column).isNotNull()).select(F.col(column).cast("long")).mapInArrow(run, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
        words = np.zeros(1 << (bits - 6), np.uint64)
        words[found["word"].to_numpy()] = found["bits"].to_numpy().view(np.uint64)
        self.shared = ids.sparkSession.sparkContext.broadcast(words)

    def destroy(self) -> None:
        """Frees the filter once what reads it has been written."""
        self.shared.destroy()

    def maybe(self, id_column: Column) -> Column:
        """False for ids that are surely not in the table; null ids are not."""
        shared = self.shared

        @F.arrow_udf("boolean")
        def test(ids: pa.Array) -> pa.Array:
            valid = ids.is_valid().to_numpy(zero_copy_only=False)
            return pa.array(valid & in_filter(shared.value, ids.fill_null(0).to_numpy(zero_copy_only=False)))

        return test(id_column.cast("long"))

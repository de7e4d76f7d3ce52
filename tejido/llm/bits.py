"""A set of 64-bit hashes as a bit filter of a fixed size, put together range by range: what may go to every task.

A hash that is in the set is always found; others are found by chance, the oftener the fuller the filter is. Its size does not
depend on the set, so it stays a bounded broadcast; where it is full it lets everything through.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: 2^27 bits are 16 MB.
BITS = 27
_RANGES = 7


def part(number: int, hit: np.ndarray) -> tuple[int, bytes]:
    """A range of the filter, as a row: which of its bits are set."""
    return number, zstandard.compress(np.packbits(hit).tobytes())


def joined(parts: Iterable[tuple[int, bytes]]) -> bytes:
    """The filter from the rows of its ranges, all of one width; ranges without a row are empty."""
    out = np.zeros(1 << (BITS - 3), np.uint8)
    for number, data in parts:
        own = np.frombuffer(zstandard.decompress(data), np.uint8)
        out[number * len(own) : (number + 1) * len(own)] = own
    return out.tobytes()


def found(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Which of the hashes (uint64; their upper bits count) may be in the set."""
    at = hashes >> np.uint64(64 - BITS)
    return bits[at >> np.uint64(3)] >> (np.uint64(7) - (at & np.uint64(7))).astype(np.uint8) & 1 == 1


def filter_of(hashes: DataFrame, column: str) -> bytes:
    """The filter of a column of longs."""
    width = BITS - _RANGES

    def run(rows: pa.Table) -> pa.Table:
        at = rows.column("bit").to_numpy()
        hit = np.zeros(1 << width, bool)
        hit[at & ((1 << width) - 1)] = True
        number, data = part(int(at[0] >> width), hit)
        return pa.table({"number": pa.array([number], pa.int32()), "data": [data]})

    bit: Column = F.shiftrightunsigned(F.col(column), 64 - BITS).cast("int").alias("bit")
    rows = hashes.select(bit).distinct().groupBy(F.shiftright("bit", width).alias("range")).applyInArrow(run, "number int, data binary")
    return joined((r["number"], r["data"]) for r in rows.collect())

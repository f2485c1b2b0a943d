"""Count-min sketch of 64-bit keys, built in partitions and merged cell by cell.

Up to BITS for the places of a row it may be broadcast (64 MB at most, with ROWS rows); a larger one stays a table of blocks. What it
keeps of a cell is whether its merged count reaches `least`; a key's count is at most that of each of its cells, so no
key with that count is ever missed, and a fuller sketch only lets more keys pass.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from doseframe.llm.base import mix, tidy

ROWS, BITS = 2, 28
BLOCK = 19  # bits of a cell's place in its block
CELLS = "sketch_row int, block int, once binary, more binary"


def cells(keys: np.ndarray, row: int, bits: int) -> np.ndarray:
    return (mix(keys + np.uint64(0x632BE59BD9B4E019 * (row + 1) & 0xFFFFFFFFFFFFFFFF)) >> np.uint64(64 - bits)).astype(np.int64)


def partial(keys: np.ndarray, rows: int = ROWS, bits: int = BITS) -> Iterator[pa.RecordBatch]:
    """The sketch of some keys: per row and block, its cells seen once and those seen more often."""
    block = min(BLOCK, bits)
    for row in range(rows):
        at, n = np.unique(cells(keys, row, bits), return_counts=True)
        starts = np.flatnonzero(np.diff(at >> block, prepend=-1))
        ends = np.append(starts[1:], len(at))
        inner = (at & ((1 << block) - 1)).astype(np.uint32)
        out = [(int(at[i] >> block), inner[i:j][n[i:j] == 1].tobytes(), inner[i:j][n[i:j] > 1].tobytes()) for i, j in zip(starts, ends, strict=True)]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array([row] * len(out), pa.int32()), pa.array([x[0] for x in out], pa.int32()), pa.array([x[1] for x in out], pa.binary()), pa.array([x[2] for x in out], pa.binary())], names=["sketch_row", "block", "once", "more"])


def merged(parts: DataFrame, least: int, bits: int = BITS) -> DataFrame:
    """(sketch_row, block, bits): packed bits of the cells whose count over all partitions is at least `least` (1 or 2).

    A task holds one block's counts at a time, however many partitions sent a part of it."""
    block = min(BLOCK, bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, counts = None, np.zeros(1 << block, np.uint8)

        def done() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([now[0]], pa.int32()), pa.array([now[1]], pa.int32()), pa.array([np.packbits(counts >= least).tobytes()], pa.binary())], names=["sketch_row", "block", "bits"])

        for batch in batches:
            for row, at, once, more in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if now != (row, at):
                    if now:
                        yield done()
                    now, counts[:] = (row, at), 0
                once, more = np.frombuffer(once, np.uint32), np.frombuffer(more, np.uint32)
                counts[once] = np.minimum(counts[once] + 1, 2)
                counts[more] = 2
        if now:
            yield done()

    return parts.repartition("sketch_row", "block").sortWithinPartitions("sketch_row", "block").mapInArrow(tidy(run), "sketch_row int, block int, bits binary")


class Sketch:
    """The merged sketch on the driver, and broadcast, in the tasks."""

    def __init__(self, blocks: DataFrame, rows: int = ROWS, bits: int = BITS):
        block = min(BLOCK, bits)
        self.bits = bits
        self.planes = [np.zeros(1 << max(bits - 3, 0), np.uint8) for _ in range(rows)]
        size = (1 << block) // 8
        for row, at, packed in blocks.toLocalIterator():
            self.planes[row][at * size : (at + 1) * size] = np.frombuffer(packed, np.uint8)

    def reached(self, keys: np.ndarray) -> np.ndarray:
        out = np.ones(len(keys), bool)
        for row, plane in enumerate(self.planes):
            at = cells(keys, row, self.bits)
            out &= (plane[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1).astype(bool)
        return out

"""From one array a frame to one array a cell."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes that a task may hold of the traces it puts together, and as much again of the rows they come from.
TASK_BYTES = 32 << 20


def frames_to_cells(frames: DataFrame, row: str = "row", values: str = "values", cell: str = "cell", trace: str = "trace", task_bytes: int = TASK_BYTES) -> DataFrame:
    """(cell, trace) of a movie of (frame number from 0, array of all cells' values); cells are numbered from 0.

    Every frame's array is cut into blocks of cells, which are shuffled by block and put together frame by frame: the movie
    moves once, and a task holds one block of cells over all frames (``task_bytes``, or one cell where its trace is longer).
    ``frames`` is read twice, the first time for its number of frames and cells. Frames that are missing, null or too
    short, and null values, become NaN; rows without a number are left out; a number that comes twice is an error.
    """
    kept = frames.filter(F.col(row).isNotNull()).select(F.col(row).cast("long").alias("__row"), F.col(values).alias("__v"))
    n, most = kept.agg(F.max("__row") + 1, F.max(F.size("__v"))).first()
    if not n or not most or most < 1:
        return kept.select(F.col("__row").alias(cell), F.array().cast("array<double>").alias(trace)).limit(0)
    width = int(min(most, max(1, task_bytes // (8 * n))))
    cut = F.transform(F.sequence(F.lit(0), F.lit((most - 1) // width)), lambda b: F.slice("__v", b * width + 1, width))
    tiles = kept.select("__row", F.posexplode(cut).alias("__block", "__part"))

    def assemble(table: pa.Table) -> pa.Table:
        first = table.column("__block")[0].as_py() * width
        rows, parts = table.column("__row").to_numpy(), table.column("__part").combine_chunks()
        if len(np.unique(rows)) < len(rows):
            raise ValueError("frames_to_cells: a frame's number comes twice")
        sizes = np.nan_to_num(parts.value_lengths().to_numpy(zero_copy_only=False).astype(float)).astype(int)
        ends = np.cumsum(sizes)
        out = np.full((min(width, most - first), n), np.nan)
        out[np.arange(ends[-1]) - np.repeat(ends - sizes, sizes), np.repeat(rows, sizes)] = parts.flatten().to_numpy(zero_copy_only=False)
        offsets = pa.array(np.arange(len(out) + 1, dtype=np.int64) * n)
        return pa.table({cell: pa.array(np.arange(first, first + len(out))), trace: pa.LargeListArray.from_arrays(offsets, pa.array(out.ravel())).cast(pa.list_(pa.float64()))})

    return tiles.groupBy("__block").applyInArrow(assemble, f"`{cell}` long, `{trace}` array<double>")

"""Set overlaps between two bounded blocks of sets inside one task."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Most cells of a matrix that is held at once (4 bytes each).
CELLS = 1 << 22


def block_count(items: Column, block_items: int, block_rows: int) -> Column:
    """Blocks of a cluster (an aggregate) so that one has about ``block_items`` items and ``block_rows`` rows at most."""
    return F.greatest(F.ceil(F.sum(F.size(items)) / block_items), F.ceil(F.count("*") / block_rows)).cast("int")


def overlaps(items: pa.ListArray, first: np.ndarray, cells: int = CELLS) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(part of ``first``, intersections, unions) of the sets ``first`` with all sets, for some rows of ``first`` at a time.

    No matrix that is held has more than about ``cells`` cells, whatever the number of sets and items."""
    length = items.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    words, column, seen = np.unique(items.flatten().to_numpy(), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(length)), length)
    shared = seen > 1  # an item of one set only is in no intersection but with itself
    alone = np.bincount(row[~shared[column]], minlength=len(length))
    row, column = row[shared[column]], (np.cumsum(shared) - 1)[column[shared[column]]]
    size = max(1, len(length))
    tile, width = max(1, cells // size), max(64, cells // size)
    for start in range(0, len(first), tile):
        part = first[start : start + tile]
        place = np.full(len(length), -1)
        place[part] = np.arange(len(part))
        mine = place[row] >= 0
        used = np.zeros(int(shared.sum()), bool)
        used[column[mine]] = True
        number = np.cumsum(used) - 1  # only items of these rows have columns
        of_use = used[column]
        rows, columns = row[of_use], number[column[of_use]]
        both = np.zeros((len(part), len(length)), np.float32)
        for low in range(0, int(used.sum()), width):
            here = (columns >= low) & (columns < low + width)
            dense = np.zeros((len(length), min(width, int(used.sum()) - low)), np.float32)
            dense[rows[here], columns[here] - low] = 1
            both += dense[part] @ dense.T
        both[np.arange(len(part)), part] += alone[part]
        yield part, both, length[part][:, None] + length[None, :] - both

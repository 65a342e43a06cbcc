"""Groups of rows that lie next to each other in a partition, as Arrow tables; rows with an id of a list."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BROADCAST_IDS = 2 << 20  # an estimated 130 MB as a hash relation


def contiguous(batches: Iterable[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """One table for each run of rows with equal (integer) keys, across batch borders."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(batch.schema.names.index(k)).to_numpy(zero_copy_only=False) for k in keys]
        new = np.zeros(batch.num_rows, bool)
        new[0] = True
        for c in columns:
            new[1:] |= c[1:] != c[:-1]
        starts = np.flatnonzero(new)
        for a, b in zip(starts, np.append(starts[1:], batch.num_rows)):
            key = tuple(c[a] for c in columns)
            if key != last and held:
                yield pa.Table.from_batches(held)
                held = []
            last = key
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)


def matching(rows: DataFrame, ids: DataFrame, name: str, how: str = "left_semi") -> DataFrame:
    """The rows whose id in the column `name` is among ids (left_semi) or not (left_anti). Wide rows stay where they
    are as long as the ids, which are counted first, fit into a broadcast; beyond that both sides are shuffled."""
    small = ids.count() <= BROADCAST_IDS
    return rows.join(F.broadcast(ids) if small else ids.hint("merge"), name, how)

"""Which physical form answers a search."""

from __future__ import annotations

import math
from dataclasses import dataclass

#: Query matrices up to this size are broadcast; above it queries meet the corpus in blocks.
BROADCAST_BYTES = 32 << 20
#: From so many distance computations on, matrix products beat expressions.
KERNEL_PAIRS = 20_000
IVF_LEAST_ROWS = 256


@dataclass(frozen=True)
class Plan:
    tier: str  # expression, kernel, blocks or ivf
    reason: str


def choose(mode: str, rows: int, queries: int, dims: int, metric: str, has_filter: bool, nprobe: int = 4, lists: int = 256) -> Plan:
    """Exact unless the fast mode is asked for and can serve: enough rows, no filter, no
    hamming, and fewer lists to read than there are."""
    if mode == "fast" and rows >= IVF_LEAST_ROWS and metric != "hamming" and not has_filter and nprobe < lists:
        return Plan("ivf", "fast mode over inverted lists")
    if rows * queries < KERNEL_PAIRS:
        return Plan("expression", "few distances")
    if queries * dims * 8 <= BROADCAST_BYTES:
        return Plan("kernel", "the queries fit into a broadcast")
    return Plan("blocks", "queries and corpus meet block by block")


def list_count(requested: int, rows: int) -> int:
    """The number of inverted lists: 256 stands for rows / 64, at least 16, and from 16,384 rows on for twice their
    square root, so that lists and their number grow alike; others are clamped."""
    if requested == 256:
        requested = max(16, rows // 64 if rows <= 16_384 else 2 * math.isqrt(rows))
    return max(1, min(requested, rows))

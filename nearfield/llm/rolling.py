"""Rolling hashes of bytes, shared by the operators: a span's hash is the difference of two sums, shifted by a power."""

from __future__ import annotations

import numpy as np

BASE = 0xD1342543DE82EF95
INVERSE = pow(BASE, -1, 1 << 64)
BYTE_HASH = np.random.Generator(np.random.PCG64(20240613)).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0 to base ** (n - 1), modulo 2 ** 64."""
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)

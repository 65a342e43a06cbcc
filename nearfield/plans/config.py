"""Configurations as frozen dataclasses that read and write JSON, and the errors of the library."""

from __future__ import annotations

import dataclasses
import json
from dataclasses import dataclass

METRICS = ("cosine", "l2", "inner_product", "hamming")


class VectorError(Exception):
    """Base of all errors raised on purpose."""


class ConstructionFailed(VectorError):
    """Input from which no index can be built."""


class DimensionMismatch(VectorError):
    def __init__(self, expected: int | None, got: int | None):
        super().__init__(f"expected {expected} dimensions, got {got}")


class IdAlreadyExists(VectorError):
    """An id is there already, or twice in one batch."""


class IdNotFound(VectorError):
    """No live row has the id."""


class IndexEmpty(VectorError):
    """Nothing has been built yet."""


class IndexCapacityExceeded(VectorError):
    """More rows than max_rows allows."""


class SearchFailed(VectorError):
    """A search that the index cannot answer."""


class StreamFailed(VectorError):
    """A merge of a stream failed, and nobody has cleared the error since."""


class CorruptFile(VectorError):
    """Stored data that does not fit its manifest or header."""


class _Json:
    def to_json(self) -> str:
        return json.dumps(dataclasses.asdict(self), sort_keys=True)

    @classmethod
    def from_json(cls, text: str):
        """Missing keys take their defaults, unknown ones are passed over."""
        names = {f.name for f in dataclasses.fields(cls)}
        return cls(**{k: v for k, v in json.loads(text).items() if k in names})


@dataclass(frozen=True)
class IndexConfig(_Json):
    metric: str = "cosine"
    degree: int = 32
    ef_search: int = 64
    ef_construction: int = 100  # accepted; no algorithm needs it
    max_iterations: int = 20
    convergence: float = 0.001
    codec: str = "float32"  # float32, float16 or binary
    search_mode: str = "exact"  # exact or fast
    ivf_lists: int = 256  # 256 stands for automatic
    ivf_nprobe: int = 4
    hnsw_levels: int = 6
    repair_interval: int = 100
    repair_depth: int = 2
    repair_iterations: int = 5
    max_rows: int | None = None

    def __post_init__(self):
        if self.metric not in METRICS:
            raise ConstructionFailed(f"unknown metric {self.metric}")
        if (self.metric == "hamming") != (self.codec == "binary"):
            raise ConstructionFailed("hamming goes with the binary codec, and only with it")


@dataclass(frozen=True)
class IVFPQConfig(_Json):
    subspaces: int = 8
    codes: int = 256
    lists: int = 256
    nprobe: int = 8
    metric: str = "l2"
    iterations: int = 20

    def __post_init__(self):
        if self.codes != 256:
            raise ConstructionFailed("a code is one byte: codes must be 256")


@dataclass(frozen=True)
class ShardConfig(_Json):
    shards: int = 16
    nprobe: int = 4


@dataclass(frozen=True)
class StreamConfig(_Json):
    delta_capacity: int = 10_000
    strict: bool = True  # raise on ids seen before; else pass them over

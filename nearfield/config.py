"""Index configuration and argument checks; all run before any plan is built."""

from __future__ import annotations

import warnings
from dataclasses import dataclass, replace

METRICS = ("l2", "mips", "cosine", "fast_l2")
#: Element types and the Spark type that holds them; bytes from 0 to 255 have none of their own.
DTYPES = {"float": "float", "int8": "tinyint", "uint8": "smallint"}
#: Which element types each metric takes, in memory and on disk.
SUPPORTED = {
    "memory": {"l2": {"float", "int8", "uint8"}, "cosine": {"float", "int8", "uint8"}, "mips": {"float"}, "fast_l2": {"float"}},
    "disk": {"l2": {"float", "int8", "uint8"}, "mips": {"float"}},
}


def check_metric(metric: str, dtype: str = "float", storage: str = "memory") -> str:
    """The metric's canonical name; an unknown one or one that the element type lacks raises."""
    name = {"inner_product": "mips", "ip": "mips", "fastl2": "fast_l2"}.get(str(metric).lower(), str(metric).lower())
    if name not in METRICS:
        raise ValueError(f"metric must be one of {', '.join(METRICS)}, not {metric!r}")
    if dtype not in DTYPES:
        raise TypeError(f"vectors must be one of {', '.join(DTYPES)}, not {dtype!r}")
    if dtype not in SUPPORTED[storage].get(name, ()):
        raise ValueError(f"{storage} indexes don't take metric {name} over {dtype} vectors")
    return name


def check_positive(**values: float) -> None:
    for name, value in values.items():
        if isinstance(value, bool) or not isinstance(value, (int, float)) or value <= 0:
            raise ValueError(f"{name} must be above 0, not {value!r}")


def check_nonnegative(**values: int) -> None:
    for name, value in values.items():
        if isinstance(value, bool) or not isinstance(value, int) or not 0 <= value < 1 << 32:
            raise ValueError(f"{name} must be an integer from 0 on that 32 bits hold, not {value!r}")


def search_width(k: int, width: int, strict: bool = False) -> int:
    """The candidate list must hold k results: raise if strict, else widen with a warning."""
    check_positive(k=k, width=width)
    if k <= width:
        return width
    if strict:
        raise ValueError(f"a candidate list of {width} can't hold {k} results")
    warnings.warn(f"candidate list of {width} widened to hold {k} results", stacklevel=2)
    return k


@dataclass(frozen=True)
class IndexConfig:
    """What an index is built with.

    degree is the most out-edges of a node, build_width the candidate list while building, pool the most candidates that pruning
    looks at, alpha its slack, filter_width the candidate list among points of one label (0: build_width), slack how far reverse edges may
    overfill a node before it is pruned again. A shard is the part of an index that one task builds.
    """

    dim: int
    metric: str = "l2"
    dtype: str = "float"
    degree: int = 64
    build_width: int = 100
    pool: int = 750
    alpha: float = 1.2
    filter_width: int = 0
    slack: float = 1.3
    saturate: bool = False
    universal_label: str | None = None
    max_vectors: int | None = None
    shard_rows: int = 5_000
    replicas: int = 2
    seed: int = 1

    def __post_init__(self):
        object.__setattr__(self, "metric", check_metric(self.metric, self.dtype))
        check_positive(dim=self.dim, degree=self.degree, build_width=self.build_width, pool=self.pool, alpha=self.alpha, slack=self.slack, shard_rows=self.shard_rows, replicas=self.replicas)
        check_nonnegative(filter_width=self.filter_width, seed=self.seed)
        if self.alpha < 1:
            raise ValueError(f"alpha must be 1 or more, not {self.alpha}")
        if self.max_vectors is not None:
            check_positive(max_vectors=self.max_vectors)

    def with_options(self, **changes) -> IndexConfig:
        return replace(self, **changes)

    @property
    def label_width(self) -> int:
        return self.filter_width or self.build_width

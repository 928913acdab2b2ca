"""Embedders by name. Vectors usually come as a column; others may be registered."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditlake.functions import columns as C


@dataclass(frozen=True)
class Embedder:
    name: str
    dimension: int
    embed: Callable[[DataFrame], DataFrame]  # (idx, ...) -> (idx, v)
    available: bool = True


def precomputed(column: str = "embedding", dimension: int = 64) -> Embedder:
    """Vectors that the table has, made of unit length."""
    return Embedder("precomputed", dimension, lambda d: d.select("idx", C.unit(column).alias("v")))


class Registry:
    def __init__(self, default: Embedder | None = None):
        self.default = default or precomputed()
        self._by_name = {self.default.name: self.default}

    def register(self, e: Embedder) -> None:
        self._by_name[e.name] = e

    def get(self, name: str, fall_back: bool = True) -> Embedder:
        e = self._by_name.get(name)
        if e and e.available:
            return e
        if fall_back:
            return self.default
        raise KeyError(name)

    def all(self) -> list[dict]:
        return [{"name": e.name, "dimension": e.dimension, "available": e.available} for e in self._by_name.values()]


def ensemble(parts: list[Embedder], name: str = "ensemble") -> Embedder:
    """The available parts' vectors end to end, made of unit length."""
    used = [p for p in parts if p.available]

    def embed(d: DataFrame) -> DataFrame:
        out = None
        for k, p in enumerate(used):
            v = p.embed(d).withColumnRenamed("v", f"v{k}")
            out = v if out is None else out.join(v, "idx")
        return out.select("idx", C.unit(F.concat(*[f"v{k}" for k in range(len(used))])).alias("v"))

    return Embedder(name, sum(p.dimension for p in used), embed, bool(used))


def once_each(d: DataFrame, digest: str, e: Embedder) -> DataFrame:
    """Embeds each content once: rows of equal digest share the vector of the first."""
    first = d.groupBy(digest).agg(F.min("idx").alias("idx"))
    made = e.embed(d.join(first.select("idx"), "idx", "left_semi")).join(first, "idx").select(digest, "v")
    return d.select("idx", digest).join(made, digest).select("idx", "v")

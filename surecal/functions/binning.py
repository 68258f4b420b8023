"""Bin edges: validation, labels, geometry and right-closed assignment."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce
from operator import add

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

_COMPARED_EDGES = 64


def equal_width_edges(n_bins: int = 10) -> list[float]:
    """``n_bins`` equal bins of [0, 1], with the doubles numpy gives."""
    return np.linspace(0.0, 1.0, n_bins + 1).tolist()


@dataclass(frozen=True)
class Bins:
    """A checked, strictly increasing list of edges and what follows from it."""

    edges: tuple[float, ...]

    @classmethod
    def of(cls, edges: Sequence[float] | None = None) -> Bins:
        values = np.asarray(equal_width_edges() if edges is None else edges, dtype=float)
        if values.ndim != 1 or values.size < 2:
            raise ValueError("bins must be one-dimensional with at least two edges")
        if not (np.diff(values) > 0).all():
            raise ValueError("bin edges must increase strictly")
        bins = cls(tuple(values.tolist()))
        if len(set(bins.labels)) != len(bins.labels):
            raise ValueError("bin edges closer than 0.001 give the same label twice")
        return bins

    @property
    def labels(self) -> list[str]:
        return [f"{a:.3f}-{b:.3f}" for a, b in zip(self.edges, self.edges[1:])]

    def __len__(self) -> int:
        return len(self.edges) - 1

    def index_of(self, p: Column) -> Column:
        """0-based bin of ``p``: ``(a, b]``, the first bin also holds its left edge.

        NULL outside the edges and for a missing ``p``. The comparisons use the
        edges themselves, so a value on an inexact edge falls where it should.
        """
        if len(self) <= _COMPARED_EDGES:
            # Plain comparisons stay inside generated code.
            below = reduce(add, [(p > F.lit(e)).cast("int") for e in self.edges])
        else:
            below = F.size(F.filter(F.array(*[F.lit(e) for e in self.edges]), lambda e: e < p))
        return (
            F.when(p.isNull(), F.lit(None))
            .when(p == F.lit(self.edges[0]), F.lit(0))
            .when((below == 0) | (below > len(self)), F.lit(None))
            .otherwise(below - 1)
            .cast("int")
        )

    def geometry(self) -> Column:
        """Literal array with one struct per bin, in order."""
        return F.array(*[
            F.struct(
                F.lit(i).alias("bin_idx"),
                F.lit(label).alias("bin"),
                F.lit((a + b) / 2.0).alias("mid"),
                F.lit(a).alias("start"),
                F.lit(b).alias("end"),
                F.lit(b - a).alias("width"),
            )
            for i, (label, a, b) in enumerate(zip(self.labels, self.edges, self.edges[1:]))
        ])

    def midpoints(self) -> list[float]:
        return [(a + b) / 2.0 for a, b in zip(self.edges, self.edges[1:])]


"""Column functions: averages, orders that two engines agree on, and scalars of the coarsening."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def average(kind: str, a: Column, b: Column) -> Column:
    """MIN, GEOM, HARM, ALG or MAX of two non-negative columns; HHARM is the half-harmonic a*b/(a+b)."""
    kind = kind.lower()
    if kind == "min":
        return F.least(a, b)
    if kind == "max":
        return F.greatest(a, b)
    if kind == "geom":
        return F.sqrt(a * b)
    if kind == "alg":
        return (a + b) / 2
    half = F.when(a + b > 0, a * b / (a + b)).otherwise(F.lit(0.0))
    if kind == "hharm":
        return half
    if kind == "harm":
        return 2 * half
    raise ValueError(f"unknown average {kind!r}")


def tie_hash(a: Column, b: Column) -> Column:
    """An integer for an unordered pair that orders ties without following the ids; SQL computes the same."""
    lo, hi = F.least(a, b) % 1000003, F.greatest(a, b) % 1000003
    return (lo * F.lit(7919).cast("long") + hi * F.lit(104729).cast("long") + (lo * hi % 1000003) * F.lit(31).cast("long")) % 1000003


def vertex_hash(v: Column) -> Column:
    """The same for one id."""
    return ((v % 1000003) * F.lit(7919).cast("long") + (v % 1000003) * (v % 1000003) % 1000003 * F.lit(31).cast("long")) % 1000003


def coarsening_goal(level: int, current: int, first_aaf: float, aaf: float, aaf_scale: float, max_meas: int) -> int:
    """Vertices that a coarsening step should stop at."""
    factor = first_aaf if level == 0 else aaf * aaf_scale ** max(level - 1, 0)
    return int(max(math.ceil(min(factor, 0.9) * current), max_meas, 1))


def level_partitions(vertices: int, per_task: int, most: int) -> int:
    """Partitions that a level of so many vertices is dealt over; the counterpart of moving coarse levels to fewer processes."""
    return max(1, min(most, -(-vertices // per_task)))

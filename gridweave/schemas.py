"""Schemas of the tables: graphs, matrices, vectors and maps."""

from __future__ import annotations

from pyspark.sql import DataFrame

VERTICES = "vid long, w double, cnt double, free boolean"
EDGES = "src long, dst long, w double"
MATRIX = "i long, j long, v double"
BLOCK_MATRIX = "i long, j long, v array<double>"
VECTOR = "i long, x double"
VMAP = "f long, c long"
BLOCKS = "block_id long, i long"
LOOPS = "loop_id long, pos int, eid long, sign int"
RESIDUALS = "iter int, err double"


def expect(df: DataFrame, schema: str) -> DataFrame:
    """``df`` with the columns of a schema first and cast to its types; columns that are missing raise ValueError."""
    names = [f.split()[0] for f in schema.split(", ")]
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"columns {missing} are missing from {df.columns}")
    return df.select(*[df[f.split()[0]].cast(f.split()[1]).alias(f.split()[0]) for f in schema.split(", ")], *[df[c] for c in df.columns if c not in names])

"""Operators made of matrices: sums, products, multiples, transposes, projections and embeddings; applied, or made one matrix."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridweave.operators import linalg


class Operator:
    """Maps vectors (i, x)."""

    def apply(self, x: DataFrame) -> DataFrame:
        raise NotImplementedError

    def to_matrix(self) -> DataFrame:
        """(i, j, v) that does the same."""
        raise NotImplementedError

    def __add__(self, other: Operator) -> Operator:
        return Sum(self, other)

    def __matmul__(self, other: Operator) -> Operator:
        return Product(self, other)

    def __rmul__(self, factor: float) -> Operator:
        return Multiple(factor, self)

    @property
    def T(self) -> Operator:  # noqa: N802
        return Transposed(self)


@dataclass(frozen=True)
class Matrix(Operator):
    a: DataFrame

    def apply(self, x: DataFrame) -> DataFrame:
        return linalg.spmv(self.a, x)

    def to_matrix(self) -> DataFrame:
        return self.a.select("i", "j", "v")


@dataclass(frozen=True)
class Projection(Operator):
    """Keeps the unknowns in ``keep`` (i), the others become zero. With all unknowns the identity."""

    keep: DataFrame

    def apply(self, x: DataFrame) -> DataFrame:
        return x.join(self.keep.select("i").distinct(), "i", "left_semi")

    def to_matrix(self) -> DataFrame:
        return self.keep.select("i").distinct().select("i", F.col("i").alias("j"), F.lit(1.0).alias("v"))


@dataclass(frozen=True)
class Embedding(Operator):
    """Unknowns of a space of their own as a range of a larger one, from ``first`` on; ``ids`` (i) are its unknowns."""

    ids: DataFrame
    first: int

    def apply(self, x: DataFrame) -> DataFrame:
        return x.select((F.col("i") + self.first).alias("i"), "x")

    def to_matrix(self) -> DataFrame:
        return self.ids.select((F.col("i") + self.first).alias("i"), F.col("i").alias("j"), F.lit(1.0).alias("v"))


@dataclass(frozen=True)
class Sum(Operator):
    left: Operator
    right: Operator

    def apply(self, x: DataFrame) -> DataFrame:
        return linalg.axpy(1.0, self.left.apply(x), self.right.apply(x))

    def to_matrix(self) -> DataFrame:
        return self.left.to_matrix().unionByName(self.right.to_matrix()).groupBy("i", "j").agg(F.sum("v").alias("v"))


@dataclass(frozen=True)
class Product(Operator):
    left: Operator
    right: Operator

    def apply(self, x: DataFrame) -> DataFrame:
        return self.left.apply(self.right.apply(x))

    def to_matrix(self) -> DataFrame:
        return linalg.spgemm(self.left.to_matrix(), self.right.to_matrix())


@dataclass(frozen=True)
class Multiple(Operator):
    factor: float
    inner: Operator

    def apply(self, x: DataFrame) -> DataFrame:
        return self.inner.apply(x).select("i", (F.col("x") * self.factor).alias("x"))

    def to_matrix(self) -> DataFrame:
        return self.inner.to_matrix().select("i", "j", (F.col("v") * self.factor).alias("v"))


@dataclass(frozen=True)
class Transposed(Operator):
    """The transpose; it is applied through the matrix."""

    inner: Operator

    def apply(self, x: DataFrame) -> DataFrame:
        return linalg.spmv_t(self.inner.to_matrix(), x)

    def to_matrix(self) -> DataFrame:
        return linalg.transpose(self.inner.to_matrix())

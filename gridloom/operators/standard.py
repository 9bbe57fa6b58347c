"""The operations under their standard names and argument order.

``GrB_mxv(w, mask, accum, semiring, A, u, desc)`` and so on. Objects are
immutable here, so each call returns what the standard would write to its
first argument; ``w`` is the old output, or None.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import SparkSession

from gridloom.functions.algebra import BinaryOp, Monoid
from gridloom.operators import ops
from gridloom.operators.descriptor import DEFAULT, Descriptor
from gridloom.operators.matrix import Matrix
from gridloom.operators.vector import Vector


def _desc(desc: Descriptor | None) -> Descriptor:
    return DEFAULT if desc is None else desc


def GrB_Matrix_new(spark: SparkSession, nrows: int, ncols: int, kind: str = "double") -> Matrix:
    return Matrix(spark.createDataFrame([], f"row long, col long, val {kind}"), nrows, ncols)


def GrB_Vector_new(spark: SparkSession, size: int, kind: str = "double") -> Vector:
    return Vector(spark.createDataFrame([], f"idx long, val {kind}"), size)


def GrB_Matrix_nrows(a: Matrix) -> int:
    return a.nrows


def GrB_Matrix_ncols(a: Matrix) -> int:
    return a.ncols


def GrB_Matrix_nvals(a: Matrix) -> int:
    return a.nvals()


def GrB_Vector_size(v: Vector) -> int:
    return v.size


def GrB_Vector_nvals(v: Vector) -> int:
    return v.nvals()


def GrB_Vector_setElement(v: Vector, value, idx: int) -> Vector:
    return v.set_element(value, idx)


def GrB_Vector_dup(v: Vector) -> Vector:
    return v.dup()


def GrB_clear(v: Vector) -> Vector:
    return v.clear()


def GrB_mxv(w, mask, accum, semiring, a: Matrix, u: Vector, desc=None) -> Vector:
    return ops.mxv(a, u, semiring, mask, accum, w, _desc(desc))


def GrB_vxm(w, mask, accum, semiring, u: Vector, a: Matrix, desc=None) -> Vector:
    return ops.vxm(u, a, semiring, mask, accum, w, _desc(desc))


def GrB_mxm(c, mask, accum, semiring, a: Matrix, b: Matrix, desc=None) -> Matrix:
    return ops.mxm(a, b, semiring, mask, accum, c, _desc(desc))


def GrB_eWiseAdd(w, mask, accum, op, u: Vector, v: Vector, desc=None) -> Vector:
    return ops.ewise_add(u, v, op, mask, accum, w, _desc(desc))


def GrB_eWiseMult(w, mask, accum, op, u: Vector, v: Vector, desc=None) -> Vector:
    return ops.ewise_mult(u, v, op, mask, accum, w, _desc(desc))


def GrB_apply(w, mask, accum, op, u: Vector, desc=None) -> Vector:
    return ops.apply(op, u, mask, accum, w, _desc(desc))


def GrB_apply_BinaryOp1st(w, mask, accum, op, value, u: Vector, desc=None) -> Vector:
    return ops.apply_first(op, value, u, mask, accum, w, _desc(desc))


def GrB_apply_BinaryOp2nd(w, mask, accum, op, u: Vector, value, desc=None) -> Vector:
    return ops.apply_second(op, u, value, mask, accum, w, _desc(desc))


def GrB_apply_IndexOp(w, mask, accum, op, u: Vector, thunk, desc=None) -> Vector:
    return ops.apply_index(op, u, thunk, mask, accum, w, _desc(desc))


def GrB_select(out, mask, accum, op, x: Vector | Matrix, thunk, desc=None) -> Vector | Matrix:
    chosen = ops.select if isinstance(x, Vector) else ops.select_matrix
    return chosen(op, x, thunk, mask, accum, out, _desc(desc))


def GrB_assign(w: Vector, mask, accum: BinaryOp | None, value, indices: Sequence[int] | None = None, desc=None) -> Vector:
    """``value``: a scalar for all listed positions, or a vector of their values."""
    desc = Descriptor(replace=False) if desc is None else desc
    written = ops.assign_vector if isinstance(value, Vector) else ops.assign_scalar
    return written(w, value, indices, mask, accum, desc)


def GrB_scatter(w: Vector, mask, accum, u: Vector, targets: Vector, dup: Monoid | None = None, desc=None) -> Vector:
    return ops.scatter(w, u, targets, mask, accum, dup, Descriptor(replace=False) if desc is None else desc)


def GrB_extract(w, mask, accum, u: Vector, indices: Vector | Sequence[int], desc=None) -> Vector:
    return ops.extract(u, indices, mask, accum, w, _desc(desc))


def GrB_reduce(start, accum, monoid: Monoid, x: Vector | Matrix):
    return ops.reduce(x, monoid, accum, start)


def GrB_transpose(a: Matrix) -> Matrix:
    return a.T

"""Unary and binary operators, monoids and semirings.

Each is a small value that builds Spark columns, so a product over a semiring
is one join and one aggregate inside generated code.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

Binary = Callable[[Column, Column], Column]


@dataclass(frozen=True)
class UnaryOp:
    name: str
    of: Callable[[Column], Column]

    def __call__(self, x: Column) -> Column:
        return self.of(x)


@dataclass(frozen=True)
class BinaryOp:
    """``uses`` tells which arguments the result depends on, so unread values are pruned from scans."""

    name: str
    of: Binary
    uses: str = "ab"

    def __call__(self, a: Column, b: Column) -> Column:
        return self.of(a, b)


@dataclass(frozen=True)
class Monoid:
    """``aggregate(value, order)``: order is what "first" and "last" go by.

    ``op`` folds two values; ``identity`` is the result over nothing.
    ``presence``: the result is 1 wherever there is anything at all.
    """

    name: str
    op: BinaryOp
    identity: object
    aggregate: Callable[[Column, Column], Column]
    presence: bool = False


@dataclass(frozen=True)
class Semiring:
    name: str
    add: Monoid
    mul: BinaryOp


def _flag(condition: Column) -> Column:
    """Truth as 1 or 0, which all stored types can hold."""
    return condition.cast("long")


def _truth(x: Column) -> Column:
    return x.cast("boolean")


PLUS = BinaryOp("plus", lambda a, b: a + b)
MINUS = BinaryOp("minus", lambda a, b: a - b)
TIMES = BinaryOp("multiplies", lambda a, b: a * b)
DIV = BinaryOp("div", lambda a, b: F.try_divide(a, b))
FIRST = BinaryOp("first", lambda a, b: a, "a")
SECOND = BinaryOp("second", lambda a, b: b, "b")
MIN = BinaryOp("minimum", lambda a, b: F.least(a, b))
MAX = BinaryOp("maximum", lambda a, b: F.greatest(a, b))
NE = BinaryOp("not_equal_to", lambda a, b: _flag(a != b))
LESS = BinaryOp("less", lambda a, b: _flag(a < b))
LAND = BinaryOp("logical_and", lambda a, b: _flag(_truth(a) & _truth(b)))
LOR = BinaryOp("logical_or", lambda a, b: _flag(_truth(a) | _truth(b)))
PAIR = BinaryOp("pair", lambda a, b: F.lit(1).cast("long"), "")

IDENTITY = UnaryOp("identity", lambda x: x)
ABS = UnaryOp("abs", F.abs)


def integer_div() -> BinaryOp:
    """Division of integers that drops the remainder; null where the divisor is 0."""
    return BinaryOp("integer_div", lambda a, b: F.when(b != 0, F.call_function("div", a, b)))


def set_random(seed: int) -> UnaryOp:
    """Replaces values by uniform random numbers."""
    return UnaryOp("set_random", lambda x: F.rand(seed))


def cast(kind: str) -> UnaryOp:
    """Converts values to a Spark type."""
    return UnaryOp(f"cast_{kind}", lambda x: x.cast(kind))


PLUS_MONOID = Monoid("plus", PLUS, 0, lambda x, order: F.sum(x))
LOR_MONOID = Monoid("logical_or", LOR, 0, lambda x, order: F.max(_flag(_truth(x))))
MIN_MONOID = Monoid("minimum", MIN, None, lambda x, order: F.min(x))
MAX_MONOID = Monoid("maximum", MAX, None, lambda x, order: F.max(x))
FIRST_MONOID = Monoid("first", FIRST, 0, lambda x, order: F.min_by(x, order))
SECOND_MONOID = Monoid("second", SECOND, 0, lambda x, order: F.max_by(x, order))
FIRST_MIN_MONOID = Monoid("first_min", MIN, 0, lambda x, order: F.least(F.min(x), F.lit(0)))
PRESENCE_MONOID = Monoid("presence", LOR, 0, lambda x, order: F.lit(1).cast("long"), presence=True)



def fold_monoid(op: BinaryOp, identity: object, kind: str = "double") -> Monoid:
    """A monoid that folds values in order with any operator.

    The values of a group meet in one row: for groups that are known to be
    small. Where an aggregate function says the same, use that.
    """

    def aggregate(x: Column, order: Column) -> Column:
        ordered = F.array_sort(F.collect_list(F.struct(order.alias("order"), x.alias("x"))))
        return F.aggregate(ordered, F.lit(identity).cast(kind), lambda total, e: op(total, e["x"]).cast(kind))

    return Monoid(op.name, op, identity, aggregate)


PLUS_TIMES = Semiring("plus_multiplies", PLUS_MONOID, TIMES)
LOR_LAND = Semiring("logical_or_and", LOR_MONOID, LAND)
FIRST_WINS = Semiring("first_wins", FIRST_MONOID, TIMES)
SECOND_WINS = Semiring("second_wins", SECOND_MONOID, TIMES)
FIRST_MIN = Semiring("first_min", FIRST_MIN_MONOID, TIMES)
PLUS_SECOND = Semiring("plus_second", PLUS_MONOID, SECOND)
STRUCTURAL = Semiring("structural_bool", PRESENCE_MONOID, PAIR)
MIN_PLUS = Semiring("minimum_plus", MIN_MONOID, PLUS)
LESS_PLUS = Semiring("less_plus", Monoid("less", LESS, None, lambda x, order: F.min(x)), PLUS)
MIN_SECOND = Semiring("minimum_select_second", MIN_MONOID, SECOND)
MIN_NE = Semiring("minimum_not_equal_to", MIN_MONOID, NE)
PLUS_PAIR = Semiring("plus_pair", Monoid("count", PLUS, 0, lambda x, order: F.count(F.lit(1))), PAIR)

#: Operators under their usual names.
BINARY_OPS = {op.name: op for op in (PLUS, MINUS, TIMES, DIV, FIRST, SECOND, MIN, MAX, NE, LESS, LAND, LOR, PAIR)}
UNARY_OPS = {op.name: op for op in (IDENTITY, ABS)}
MONOIDS = {m.name: m for m in (PLUS_MONOID, LOR_MONOID, MIN_MONOID, MAX_MONOID, FIRST_MONOID, SECOND_MONOID, FIRST_MIN_MONOID, PRESENCE_MONOID)}
SEMIRINGS = {
    s.name: s for s in (PLUS_TIMES, LOR_LAND, FIRST_WINS, SECOND_WINS, FIRST_MIN, PLUS_SECOND, STRUCTURAL, MIN_PLUS, LESS_PLUS, MIN_SECOND, MIN_NE, PLUS_PAIR)
}

#: Names by value type, as C programs call the same operators.
TYPED_NAMES = {
    "GrB_DIV_FP32": DIV,
    "GrB_MAX_FP32": MAX,
    "GrB_PLUS_FP32": PLUS,
    "GrB_MINUS_FP32": MINUS,
    "GrB_ABS_FP32": ABS,
    "GrB_SECOND_INT64": SECOND,
    "GrB_SECOND_INT32": SECOND,
    "GrB_SECOND_FLT32": SECOND,
    "GrB_ONEB_T": PAIR,
    "GrB_PLUS_MONOID_FP32": PLUS_MONOID,
    "GrB_PLUS_MONOID_INT32": PLUS_MONOID,
    "GrB_PLUS_MONOID_INT64": PLUS_MONOID,
    "LAGraph_plus_second_fp32": PLUS_SECOND,
    "LAGraph_structural_bool": STRUCTURAL,
    "LAGraph_plus_one_int64": PLUS_PAIR,
}


def binary(op: BinaryOp | Semiring | Monoid | Binary, part: str = "mul") -> BinaryOp:
    """The binary operator of what an element-wise operation was given: a semiring gives its ``part``."""
    if isinstance(op, Semiring):
        return op.mul if part == "mul" else op.add.op
    if isinstance(op, Monoid):
        return op.op
    return op if isinstance(op, BinaryOp) else BinaryOp(getattr(op, "__name__", "custom"), op)


def unary(op: UnaryOp | Callable[[Column], Column]) -> UnaryOp:
    return op if isinstance(op, UnaryOp) else UnaryOp(getattr(op, "__name__", "custom"), op)

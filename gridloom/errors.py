"""Errors of the graph operators."""


class GraphError(Exception):
    """Any misuse of a matrix, a vector or an operator."""


class UninitializedObject(GraphError):
    """An object that was never given contents."""


class NullPointer(GraphError):
    """An argument that must be given is None."""


class InvalidValue(GraphError):
    """An argument has a value that is not allowed."""


class DimensionMismatch(GraphError):
    """The sizes of two objects do not fit."""


class IndexOutOfBounds(GraphError):
    """An index is outside its object."""


class NoValue(GraphError):
    """There is no entry at a position."""

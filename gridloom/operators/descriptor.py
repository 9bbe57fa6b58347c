"""How an operation reads its mask and inputs and what it does with its output."""

from __future__ import annotations

import dataclasses
from dataclasses import dataclass

from gridloom.errors import InvalidValue

MASKS = ("value", "structure", "complement", "structural_complement")


@dataclass(frozen=True)
class Descriptor:
    """``mask``: entries count by value or by presence, as they are or complemented.

    ``replace``: positions outside the mask become absent; otherwise the old
    output keeps them. ``transpose_a``, ``transpose_b``: transpose a matrix
    input first. ``strategy``: ``"broadcast"`` sends the vector or second
    matrix to all executors (the caller has checked its size); names of
    multiplication loops and of directions are accepted and leave the choice to Spark.
    """

    mask: str = "value"
    replace: bool = True
    transpose_a: bool = False
    transpose_b: bool = False
    strategy: str = "auto"

    def __post_init__(self):
        if self.mask not in MASKS:
            raise InvalidValue(f"mask must be one of {MASKS}")
        if self.strategy not in ("auto", "broadcast", "ijk", "ijk_double_sort", "ikj", "ikj_masked", "push", "pull", "push_pull"):
            raise InvalidValue(f"unknown strategy {self.strategy!r}")

    @property
    def complemented(self) -> bool:
        return self.mask.endswith("complement")

    @property
    def structural(self) -> bool:
        return self.mask.startswith("structur")

    def set(self, **fields) -> Descriptor:
        return dataclasses.replace(self, **fields)

    def get(self, field: str):
        return getattr(self, field)

    def toggle(self, field: str) -> Descriptor:
        """The opposite of a flag; for ``mask`` its complement."""
        if field == "mask":
            turned = {"value": "complement", "complement": "value", "structure": "structural_complement", "structural_complement": "structure"}
            return self.set(mask=turned[self.mask])
        return self.set(**{field: not getattr(self, field)})


DEFAULT = Descriptor()
KEEP = Descriptor(replace=False)
C = Descriptor(mask="complement")
S = Descriptor(mask="structure")
SC = Descriptor(mask="structural_complement")
RSC = Descriptor(mask="structural_complement", replace=True)
PUSH = Descriptor(strategy="push")
PULL = Descriptor(strategy="pull")
PUSH_PULL = Descriptor(strategy="push_pull")
IKJ = Descriptor(strategy="ikj")
IKJ_MASKED = Descriptor(strategy="ikj_masked")
IJK = Descriptor(strategy="ijk")
IJK_DOUBLE_SORT = Descriptor(strategy="ijk_double_sort")

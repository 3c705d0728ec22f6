"""Join types, comparison operators and one join clause."""

from __future__ import annotations

from dataclasses import dataclass
from enum import Enum

from pyspark.sql import Column


class JoinType(Enum):
    """The four types of the join language, and three that it is extended by."""

    INNER = "inner"
    LEFT = "left"
    RIGHT = "right"
    FULL = "full"
    SEMI = "left_semi"
    ANTI = "left_anti"
    ASOF = "asof"

    @classmethod
    def parse(cls, word: str) -> JoinType:
        try:
            return cls[word.upper()]
        except KeyError:
            raise ValueError(f"unknown join type {word}") from None

    @property
    def mirrored(self) -> JoinType | None:
        """The type that gives the same rows with the inputs swapped."""
        return {"INNER": JoinType.INNER, "LEFT": JoinType.RIGHT, "RIGHT": JoinType.LEFT, "FULL": JoinType.FULL}.get(self.name)


class Op(Enum):
    EQ = "="
    NE = "<>"
    LT = "<"
    LE = "<="
    GT = ">"
    GE = ">="

    @classmethod
    def parse(cls, sign: str) -> Op:
        try:
            return cls(sign)
        except ValueError:
            raise ValueError(f"unknown operator {sign}") from None

    @property
    def flipped(self) -> Op:
        """The operator with its sides swapped."""
        return {Op.LT: Op.GT, Op.GT: Op.LT, Op.LE: Op.GE, Op.GE: Op.LE}.get(self, self)

    @property
    def ordered(self) -> bool:
        return self not in (Op.EQ, Op.NE)

    def supports(self, family: str) -> bool:
        """Text has no order in the join language."""
        return not (self.ordered and family == "text")

    def apply(self, a: Column, b: Column) -> Column:
        return {Op.EQ: a == b, Op.NE: a != b, Op.LT: a < b, Op.LE: a <= b, Op.GT: a > b, Op.GE: a >= b}[self]


@dataclass(frozen=True)
class JoinSpec:
    """``left`` is the table that owns ``left_col``: the table before, unless the clause or the catalog says otherwise."""

    left: str
    right: str
    how: JoinType
    left_col: str
    op: Op
    right_col: str

"""``T1 INNER T2 ON a = b LEFT T3 ON c < d ...`` to join clauses."""

from __future__ import annotations

import re
import warnings

from plait.spec import JoinSpec, JoinType, Op

_NAME = r"[^\W\d]\w*"
_TABLE = re.compile(rf"\s*({_NAME})(?![\w.])")
_HEAD = re.compile(rf"\s*({_NAME})\s+({_NAME})\s+ON\b", re.IGNORECASE)
_TEST = re.compile(rf"\s*((?:{_NAME}\.)?{_NAME})\s*([<>=!]+)\s*((?:{_NAME}\.)?{_NAME})")


def _operand(text: str) -> tuple[str | None, str]:
    table, _, column = text.rpartition(".")
    return table or None, column


def parse(text: str, strict: bool = False) -> list[JoinSpec]:
    """Clauses of a query; none for the empty text or a single table.

    A column may be qualified by any earlier table; a bare one belongs to the table before (the planner looks
    further back if that table lacks it).  Sides given the other way round are swapped.  What follows the last
    clause draws a warning, or an error if ``strict``.
    """
    first = _TABLE.match(text)
    if not first:
        if text.strip():
            raise ValueError(f"a table's name is expected at {text.strip()[:40]!r}")
        return []
    at, seen, out = first.end(), [first[1]], []
    while head := _HEAD.match(text, at):
        how, right = JoinType.parse(head[1]), head[2]
        test = _TEST.match(text, head.end())
        if not test:
            raise ValueError(f"a condition is expected at {text[head.end() :].strip()[:40]!r}")
        (lt, lc), op, (rt, rc) = _operand(test[1]), Op.parse(test[2]), _operand(test[3])
        if lt == right and rt != right:
            (lt, lc), op, (rt, rc) = (rt, rc), op.flipped, (lt, lc)
        if rt not in (None, right):
            raise ValueError(f"{rt}.{rc} is not a column of {right}")
        if lt is not None and lt not in seen:
            raise ValueError(f"{lt} is not among the tables before {right}")
        out.append(JoinSpec(lt or seen[-1], right, how, lc, op, rc))
        seen.append(right)
        at = test.end()
    if rest := text[at:].strip():
        if strict:
            raise ValueError(f"not understood: {rest[:60]!r}")
        warnings.warn(f"ignored: {rest[:60]!r}", stacklevel=2)
    return out

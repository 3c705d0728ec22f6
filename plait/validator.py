"""Checks of join clauses against a catalog."""

from __future__ import annotations

from dataclasses import replace

from plait.catalog import FAMILIES, Catalog
from plait.spec import JoinSpec


def resolve(specs: list[JoinSpec], catalog: Catalog) -> list[JoinSpec]:
    """Give a bare left column to the nearest earlier table that has it."""
    out, seen = [], [specs[0].left] if specs else []
    for s in specs:
        known = catalog.defs.get(s.left)
        if known is not None and known.type_of(s.left_col) is None:
            owner = next((t for t in reversed(seen) if t in catalog.defs and catalog.defs[t].type_of(s.left_col)), s.left)
            s = replace(s, left=owner)
        out.append(s)
        seen.append(s.right)
    return out


def validate(specs: list[JoinSpec], catalog: Catalog, identical_types: bool = False) -> list[str]:
    """Every reason why the clauses cannot run; none if they can.

    Columns compare within a family of types; ``identical_types`` asks for the same declared type.
    """
    wrong: list[str] = []
    seen = [specs[0].left] if specs else []
    for s in specs:
        if s.right.lower() == seen[-1].lower():
            wrong.append(f"{s.right} is joined with itself")
        elif s.right.lower() in (t.lower() for t in seen):
            wrong.append(f"{s.right} occurs more than once")
        seen.append(s.right)
        unknown = [t for t in (s.left, s.right) if t not in catalog.defs]
        wrong += [f"table {t} is unknown" for t in unknown]
        if unknown:
            continue
        kinds = {}
        for t, c in ((s.left, s.left_col), (s.right, s.right_col)):
            kinds[t] = catalog.defs[t].type_of(c)
            if kinds[t] is None:
                wrong.append(f"table {t} has no column {c}")
        if None in kinds.values():
            continue
        a, b = kinds[s.left], kinds[s.right]
        fa, fb = FAMILIES[a], FAMILIES[b]
        if identical_types and a != b or fa != fb and {fa, fb} != {"integer", "number"}:
            wrong.append(f"{s.left}.{s.left_col} is {a} and {s.right}.{s.right_col} is {b}")
        elif not s.op.supports(fa):
            wrong.append(f"{s.op.value} doesn't apply to {a}")
    return wrong

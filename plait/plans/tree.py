"""Join trees: from clauses, to DataFrames, and the rewrites that keep their result."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plait.catalog import Catalog
from plait.operators.joins import join_tables
from plait.operators.strategies import Strategy
from plait.spec import JoinSpec, JoinType, Op
from plait.validator import resolve, validate


@dataclass(frozen=True)
class Scan:
    table: str

    @property
    def tables(self) -> tuple[str, ...]:
        return (self.table,)


@dataclass(frozen=True)
class Join:
    """``left_of`` and ``right_of`` are the tables that own the compared columns."""

    left: Scan | Join
    right: Scan | Join
    how: JoinType
    left_of: str
    left_col: str
    op: Op
    right_of: str
    right_col: str
    strategy: Strategy = Strategy.AUTO

    @property
    def tables(self) -> tuple[str, ...]:
        return self.left.tables + self.right.tables


Node = Scan | Join


def left_deep(specs: list[JoinSpec]) -> Node:
    node: Node = Scan(specs[0].left)
    for s in specs:
        node = Join(node, Scan(s.right), s.how, s.left, s.left_col, s.op, s.right, s.right_col)
    return node


def output_names(tables: list[str], catalog: Catalog) -> dict[tuple[str, str], str]:
    """Result column of each table's column, in the order of the tables; a taken name gets the table's in front."""
    out: dict[tuple[str, str], str] = {}
    taken: set[str] = set()
    for t in tables:
        for c in catalog.frames[t].columns:
            new = c
            while new in taken:
                new = f"{t}_{new}"
            taken.add(new)
            out[t, c] = new
    return out


def compile_tree(node: Node, catalog: Catalog, order: list[str] | None = None) -> DataFrame:
    """The tree as a DataFrame whose columns follow ``order`` (the FROM order) whatever the tree's shape."""
    order = order or list(node.tables)
    names = output_names(order, catalog)

    def build(n: Node) -> DataFrame:
        if isinstance(n, Scan):
            df = catalog.frames[n.table]
            return df.select(*(F.col(c).alias(names[n.table, c]) for c in df.columns))
        left, right = build(n.left), build(n.right)
        return join_tables(left, right, n.how, names[n.left_of, n.left_col], n.op, names[n.right_of, n.right_col], n.strategy)

    out = build(node)
    return out.select(*(c for c in names.values() if c in out.columns))


def plan(specs: list[JoinSpec], catalog: Catalog, strategies: list[Strategy | str] | None = None) -> DataFrame:
    """Check the clauses and join them in order; ``strategies`` has one a clause."""
    specs = resolve(specs, catalog)
    if wrong := validate(specs, catalog):
        raise ValueError("; ".join(wrong))
    node = left_deep(specs)
    for k, s in enumerate(strategies or []):
        node = _with_strategy(node, len(specs) - 1 - k, Strategy(s))
    return compile_tree(node, catalog, [specs[0].left, *(s.right for s in specs)])


def _with_strategy(node: Node, depth: int, strategy: Strategy) -> Node:
    """Set the strategy of the join ``depth`` levels down the left side."""
    if depth == 0:
        return replace(node, strategy=strategy)
    return replace(node, left=_with_strategy(node.left, depth - 1, strategy))


# -- rewrites; each gives None where it doesn't apply ------------------------------------
def commute(node: Node) -> Node | None:
    """INNER and FULL with the inputs swapped."""
    if not isinstance(node, Join) or node.how not in (JoinType.INNER, JoinType.FULL):
        return None
    return _swapped(node)


def left_to_right(node: Node) -> Node | None:
    return _swapped(node) if isinstance(node, Join) and node.how is JoinType.LEFT else None


def right_to_left(node: Node) -> Node | None:
    return _swapped(node) if isinstance(node, Join) and node.how is JoinType.RIGHT else None


def _swapped(n: Join) -> Join:
    return Join(n.right, n.left, n.how.mirrored, n.right_of, n.right_col, n.op.flipped, n.left_of, n.left_col, n.strategy)


def associate(node: Node) -> Node | None:
    """(A join B) join C as A join (B join C): inner joins only, and only if the upper condition's left column is B's."""
    if not isinstance(node, Join) or not isinstance(node.left, Join) or JoinType.INNER is not node.how or node.left.how is not JoinType.INNER:
        return None
    low = node.left
    if node.left_of not in low.right.tables:
        return None
    upper = Join(low.right, node.right, JoinType.INNER, node.left_of, node.left_col, node.op, node.right_of, node.right_col, node.strategy)
    return Join(low.left, upper, JoinType.INNER, low.left_of, low.left_col, low.op, low.right_of, low.right_col, low.strategy)


REWRITES = (commute, associate, left_to_right, right_to_left)


def alternatives(node: Node) -> Iterator[Node]:
    """All trees with the same result, by applying the rewrites anywhere until nothing new comes up."""
    found, todo = {node}, deque([node])
    while todo:
        tree = todo.popleft()
        yield tree
        for new in _rewritten(tree):
            if new not in found:
                found.add(new)
                todo.append(new)


def joins_of(node: Node) -> list[Join]:
    """Joins of a tree, the left side's before the right side's before its own."""
    return [] if isinstance(node, Scan) else [*joins_of(node.left), *joins_of(node.right), node]


def conditions(node: Node) -> frozenset:
    """The conditions of a tree's joins, whichever way round they are written, with their types."""
    if isinstance(node, Scan):
        return frozenset()
    sides = ((node.how, node.left_of, node.left_col, node.op, node.right_of, node.right_col), (node.how.mirrored, node.right_of, node.right_col, node.op.flipped, node.left_of, node.left_col))
    own = min(sides, key=str)
    return conditions(node.left) | conditions(node.right) | {own}


def _rewritten(node: Node):
    if isinstance(node, Scan):
        return
    for rule in REWRITES:
        if (new := rule(node)) is not None:
            yield new
    for side in ("left", "right"):
        for new in _rewritten(getattr(node, side)):
            yield replace(node, **{side: new})


def pretty(node: Node, indent: int = 0) -> str:
    """The tree as indented lines."""
    pad = "  " * indent
    if isinstance(node, Scan):
        return f"{pad}{node.table}"
    head = f"{pad}{node.how.name} {node.strategy.value} ON {node.left_of}.{node.left_col} {node.op.value} {node.right_of}.{node.right_col}"
    return "\n".join([head, pretty(node.left, indent + 1), pretty(node.right, indent + 1)])


__all__ = ["REWRITES", "Join", "Node", "Scan", "alternatives", "associate", "commute", "compile_tree", "conditions", "joins_of", "left_deep", "left_to_right", "output_names", "plan", "pretty", "right_to_left"]

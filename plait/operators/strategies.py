"""Physical strategies as Spark's join hints, and what each can do."""

from __future__ import annotations

import re
from enum import Enum

from pyspark.sql import DataFrame

from plait.spec import JoinType, Op


class Strategy(Enum):
    AUTO = "auto"
    #: one side built in memory: broadcast, for sides of a checked size
    HASH = "hash"
    #: both sides partitioned by the key, then hashed
    GRACE = "grace"
    BLOCK_NL = "block_nl"
    MERGE = "merge"
    #: the right side read within the left side's range of keys only, then hashed
    INDEX_NL = "index_nl"


HINTS = {Strategy.HASH: "broadcast", Strategy.GRACE: "shuffle_hash", Strategy.MERGE: "merge", Strategy.INDEX_NL: "broadcast", Strategy.BLOCK_NL: "broadcast"}
_EQUAL_ONLY = (Strategy.HASH, Strategy.GRACE)
#: Largest estimated side that a hint may broadcast.
BROADCAST_BYTES = 256 << 20


def check(strategy: Strategy, how: JoinType, op: Op) -> None:
    """Raise for a combination that the strategy cannot run."""
    if strategy in _EQUAL_ONLY and op is not Op.EQ:
        raise ValueError(f"{strategy.value} joins are for = only")
    if strategy is Strategy.MERGE and op is Op.NE:
        raise ValueError("merge joins are not for <>")


def applicable(how: JoinType, op: Op) -> list[Strategy]:
    out = []
    for s in Strategy:
        try:
            check(s, how, op)
        except ValueError:
            continue
        out.append(s)
    return out


def apply_hint(strategy: Strategy, left: DataFrame, right: DataFrame, how: JoinType = JoinType.INNER, op: Op = Op.EQ) -> tuple[DataFrame, DataFrame]:
    """The right side hinted.  Where it is too large to broadcast, or kept whole, an equal join is partitioned instead."""
    if strategy not in HINTS:
        return left, right
    from plait.operators.joins import size_in_bytes

    hint = HINTS[strategy]
    if strategy is Strategy.BLOCK_NL:
        # every block of the left side with every block of the right one; what isn't inner needs one of them whole
        return left, right.hint("shuffle_replicate_nl" if how is JoinType.INNER and op is Op.EQ else "broadcast")
    if hint == "broadcast" and (how in (JoinType.RIGHT, JoinType.FULL) or size_in_bytes(right) > BROADCAST_BYTES):
        hint = "shuffle_hash"
    return left, right.hint(hint)


def physical_join(df: DataFrame) -> list[str]:
    """Names of the join nodes that Spark chose, outermost first."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return re.findall(r"(BroadcastHashJoin|ShuffledHashJoin|SortMergeJoin|BroadcastNestedLoopJoin|CartesianProduct)", plan)

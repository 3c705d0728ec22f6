"""Joins of two DataFrames: all types by all operators, with a choice of strategy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plait.operators.strategies import BROADCAST_BYTES, Strategy, apply_hint, check
from plait.spec import JoinType, Op

_LEFT, _RIGHT = "_plait_l", "_plait_r"
#: Product of the bytes that both sides scan from which on a join that tests pairs is dealt over tasks of about TASK_WORK.
LARGE_WORK = 1 << 32
TASK_WORK = 1 << 30
MOST_TASKS = 1000
#: Quantiles of each side at which a large block join cuts the keys into ranges.
BLOCKS = 150
#: Estimated bytes of a side that a large inner join on an inequality sends to all tasks whatever the broadcast limit.
SENT_BYTES = 4 << 20
#: Rows of the sent side that a large join on an order holds as one block.
BLOCK_ROWS = 256


def size_in_bytes(df: DataFrame) -> int:
    """Catalyst's estimate; for a scan the compressed files, which may be several times as much when built in memory."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def scanned_bytes(df: DataFrame) -> int:
    """Bytes of the tables that ``df`` reads, which doesn't multiply over joins as the estimate does; 0 if Catalyst doesn't know."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(str(leaves.apply(k).stats().sizeInBytes())) for k in range(leaves.size())]
    return sum(sizes) if all(x < 1 << 62 for x in sizes) else 0


def broadcast_limit(df: DataFrame) -> int:
    text = df.sparkSession.conf.get("spark.sql.autoBroadcastJoinThreshold")
    return int(df.sparkSession._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(text)) if not text.startswith("-") else -1


def right_names(left: DataFrame, right: DataFrame, right_name: str) -> dict[str, str]:
    """Names of the right columns beside the left ones: a name that is taken gets the table's in front."""
    taken, out = set(left.columns), {}
    for c in right.columns:
        new = c
        while new in taken:
            new = f"{right_name}_{new}"
        taken.add(new)
        out[c] = new
    return out


def join_tables(
    left: DataFrame, right: DataFrame, how: JoinType | str, left_col: str, op: Op | str, right_col: str, strategy: Strategy | str | None = None, right_name: str = "right"
) -> DataFrame:
    """All columns of both sides, left ones first, with SQL's bag semantics; a null key matches nothing.

    SEMI and ANTI give the left columns only.  ASOF needs an order (``>=``, ``>``, ``<=``, ``<``) and gives each
    left row its nearest right row.
    """
    how = JoinType.parse(how) if isinstance(how, str) else how
    op = Op.parse(op) if isinstance(op, str) else op
    strategy = Strategy(strategy or "auto")
    names = right_names(left, right, right_name)
    right = right.select(*(F.col(c).alias(n) for c, n in names.items()))
    left = left.select(*(F.col(c).alias(c) for c in left.columns))
    right_col = names[right_col]
    if how is JoinType.ASOF:
        return asof_join(left, right, left_col, right_col, op)
    check(strategy, how, op)
    if op is not Op.EQ and (strategy is Strategy.AUTO or how in (JoinType.RIGHT, JoinType.FULL) or size_in_bytes(right) > BROADCAST_BYTES):
        return _theta(left, right, how, left_col, op, right_col)
    if strategy is Strategy.INDEX_NL:
        right = _sought(left, left_col, op, right, right_col, how)
    if strategy is Strategy.BLOCK_NL and op is Op.EQ and pair_tasks(left, right) > 1:
        return _block_join(left, right, how, left_col, right_col)
    left, right = apply_hint(strategy, left, right, how, op)
    condition = op.apply(left[left_col], right[right_col])
    if strategy is Strategy.BLOCK_NL and op is Op.EQ and how is not JoinType.INNER:
        # an equality would be hashed; as two inequalities it is tested block by block
        condition = (left[left_col] <= right[right_col]) & (left[left_col] >= right[right_col])
    return left.join(right, condition, how.value)


def _sought(left: DataFrame, a: str, op: Op, right: DataFrame, b: str, how: JoinType) -> DataFrame:
    """The right rows within the range of keys that the left side seeks; on a sorted layout the scan skips the other files and row groups."""
    if how in (JoinType.RIGHT, JoinType.FULL) or op is Op.NE:
        return right
    ends = left.agg(F.min(a).alias("low"), F.max(a).alias("high")).first()
    if ends["low"] is None:
        return right
    out = right
    if op in (Op.EQ, Op.LE, Op.LT):
        out = out.filter(F.col(b) >= F.lit(ends["low"]))
    if op in (Op.EQ, Op.GE, Op.GT):
        out = out.filter(F.col(b) <= F.lit(ends["high"]))
    return out


def _theta(left: DataFrame, right: DataFrame, how: JoinType, a: str, op: Op, b: str) -> DataFrame:
    """A join on an inequality.

    Spark runs an outer one by broadcasting the side that isn't kept.  Where that side is over the broadcast
    limit, the outer rows are found without it: whether a value has a partner follows from the other side's
    smallest and largest value alone, so the result is the inner join and the rows those two numbers leave over.
    """
    limit = broadcast_limit(left)
    if (tasks := pair_tasks(left, right)) > 1:
        return _dealt_theta(left, right, how, a, op, b, limit, tasks)
    sent = {JoinType.LEFT: [right], JoinType.RIGHT: [left], JoinType.FULL: [left, right], JoinType.SEMI: [right], JoinType.ANTI: [right]}.get(how, [])
    if all(size_in_bytes(x) <= limit for x in sent):
        return left.join(right, op.apply(left[a], right[b]), how.value)
    if how is JoinType.SEMI:
        return _partnered(left, a, op, right, b, True)
    if how is JoinType.ANTI:
        return _partnered(left, a, op, right, b, False)
    return _with_lone(left.join(right, op.apply(left[a], right[b]), "inner"), left, right, how, a, op, b)


def _with_lone(out: DataFrame, left: DataFrame, right: DataFrame, how: JoinType, a: str, op: Op, b: str) -> DataFrame:
    """The inner join ``out`` and the rows without a partner of the sides that ``how`` keeps."""
    if how in (JoinType.LEFT, JoinType.FULL):
        alone = _partnered(left, a, op, right, b, False)
        out = out.unionByName(alone.select("*", *(F.lit(None).cast(t).alias(c) for c, t in right.dtypes)))
    if how in (JoinType.RIGHT, JoinType.FULL):
        alone = _partnered(right, b, op.flipped, left, a, False)
        out = out.unionByName(alone.select(*(F.lit(None).cast(t).alias(c) for c, t in left.dtypes), "*"))
    return out


def _block_join(left: DataFrame, right: DataFrame, how: JoinType, a: str, b: str) -> DataFrame:
    """Block nested loops of a large join on ``=``: both sides are dealt over blocks by ranges of the key, and each row is tested with all rows of the other side's block; blocks of different ranges hold no equal keys and do not meet.

    The ranges are cut at quantiles of each side, so a side whose keys go beyond the other's is not one block there.
    """
    block, other = "_plait_block", "_plait_block_right"
    numbers = [_number(df.schema[c].dataType.simpleString())(F.col(c)) for df, c in ((left, a), (right, b))]
    sides = [left.withColumn(block, numbers[0]), right.withColumn(other, numbers[1])]
    cuts, ends = block_cuts([sides[0].select(block), sides[1].select(other)])
    for k, (name, kept) in enumerate(((block, (JoinType.LEFT, JoinType.FULL, JoinType.ANTI)), (other, (JoinType.RIGHT, JoinType.FULL)))):
        if how not in kept:
            sides[k] = _between(sides[k], name, *ends[1 - k])
        # as one text: a Column object for each of the cuts takes seconds
        sides[k] = sides[k].withColumn(name, F.expr(f"CASE WHEN {name} IS NOT NULL THEN {_range_text(name, cuts, 0)} END"))
    # as two inequalities the keys themselves are neither hashed nor sorted
    tested = (F.col(block) == F.col(other)) & (F.col(a) <= F.col(b)) & (F.col(a) >= F.col(b))
    return sides[0].join(sides[1].hint("merge"), tested, how.value).drop(block, other)


def block_cuts(sides: list[DataFrame]) -> tuple[list[float], list[tuple[float | None, float | None]]]:
    """BLOCKS quantiles of each of these columns, in order, and each one's smallest and largest value; read as one job."""
    shares = f"array({', '.join(f'{k / BLOCKS!r}D' for k in range(1, BLOCKS))})"
    names = [f"x{k}" for k in range(len(sides))]
    both = None
    for k, df in enumerate(sides):
        one = df.select(*((F.col(df.columns[0]) if k == i else F.lit(None).cast("double")).alias(x) for i, x in enumerate(names)))
        both = one if both is None else both.union(one)
    found = both.agg(*(F.struct(F.expr(f"percentile_approx({x}, {shares}, {10 * BLOCKS})").alias("cuts"), F.min(x).alias("low"), F.max(x).alias("high")).alias(x) for x in names)).first()
    return sorted({cut for f in found for cut in f["cuts"] or []}), [(f["low"], f["high"]) for f in found]


def _between(df: DataFrame, name: str, low: float | None, high: float | None) -> DataFrame:
    """The rows that can have a partner among numbers from ``low`` to ``high``; none where these are unknown."""
    if low is None:
        return df.filter(F.lit(False))
    # a sum isn't pushed to the files, whose statistics may leave NaN out
    number = F.col(name) + 0.0
    return df.filter((number >= low) & (number <= high))


def _number(kind: str):
    """A key of this type as a number that never goes down where the key goes up (for text by its first bytes); equal keys have equal numbers."""
    if kind in ("date", "timestamp", "timestamp_ntz"):
        return lambda c: F.unix_micros(c.cast("timestamp")).cast("double")
    if kind == "string":
        return lambda c: F.conv(F.rpad(F.hex(F.substring(c.cast("binary"), 1, 7)), 14, "0"), 16, 10).cast("double")
    return lambda c: c.cast("double")


def pair_tasks(left: DataFrame, right: DataFrame) -> int:
    """Tasks over which a join that tests pairs of rows is dealt; 1 if it is small.  A table may be one file, which is one task by itself."""
    work = scanned_bytes(left) * scanned_bytes(right)
    return max(2 * left.sparkSession.sparkContext.defaultParallelism, min(MOST_TASKS, work // TASK_WORK)) if work > LARGE_WORK else 1


def _dealt_theta(left: DataFrame, right: DataFrame, how: JoinType, a: str, op: Op, b: str, limit: int, tasks: int) -> DataFrame:
    """A large join on an inequality: the larger side's rows are dealt evenly over ``tasks``, the other one is sent to each if it is small, for an order in blocks (then outer rows come beside the inner join)."""
    if how in (JoinType.SEMI, JoinType.ANTI):
        return _partnered(left, a, op, right, b, how is JoinType.SEMI)
    sizes = [size_in_bytes(left), size_in_bytes(right)]
    sides = [left, right]
    small = sizes.index(min(sizes))
    sides[1 - small] = sides[1 - small].repartition(tasks)
    sent = 0 <= limit and sizes[small] <= max(limit, SENT_BYTES)
    kinds = [left.schema[a].dataType, right.schema[b].dataType]
    alike = kinds[0] == kinds[1] or not any(k.simpleString().startswith("string") for k in kinds)
    if op.ordered and alike and sent:
        inner = _ordered_pairs(sides[1], left, b, op.flipped, a) if small == 0 else _ordered_pairs(sides[0], right, a, op, b)
        return _with_lone(inner.select(*left.columns, *right.columns), left, right, how, a, op, b)
    if sent:
        sides[small] = F.broadcast(sides[small])
    pairs = op.apply(sides[0][a], sides[1][b])
    # an outer join keeps the side that is dealt in the same pass
    if sent and how is (JoinType.RIGHT if small == 0 else JoinType.LEFT):
        return sides[0].join(sides[1], pairs, how.value)
    inner = sides[0].join(sides[1], pairs, "inner")
    return _with_lone(inner, left, right, how, a, op, b)


def _ordered_pairs(dealt: DataFrame, sent: DataFrame, a: str, op: Op, b: str) -> DataFrame:
    """The inner join on an order, ``sent`` in blocks by the order of its key: a dealt row is tested with the rows of those blocks only that hold a partner, as their largest key (for > and >= the smallest) tells."""
    block, other, edge, rows = "_plait_block", "_plait_block_right", "_plait_edge", "_plait_rows"
    number = F.floor((F.row_number().over(Window.orderBy(b)) - 1) / BLOCK_ROWS)
    blocks = sent.filter(F.col(b).isNotNull()).withColumn(block, number).groupBy(block)
    # both read the sent side; rows of an equal key may change places between the two, which changes no edge
    edges = blocks.agg((F.max if op in (Op.LT, Op.LE) else F.min)(b).alias(edge))
    held = blocks.agg(F.collect_list(F.struct(*sent.columns)).alias(rows)).withColumnRenamed(block, other)
    met = dealt.join(F.broadcast(edges), op.apply(F.col(a), F.col(edge)))
    # sorted by block, all rows of a task that meet a block follow each other, so a file of the result repeats the same few sent
    # rows, which its encodings hold in little space; the sort also ends the compiled loop over the blocks, which would keep
    # copies of all partners of a row before the first is returned
    # a sort below a join is dropped unless a column between them isn't known before it runs
    met = met.select(*dealt.columns, block).sortWithinPartitions(block).withColumn(block, F.when(F.spark_partition_id() >= 0, F.col(block)))
    pairs = met.join(F.broadcast(held), F.col(block) == F.col(other)).select(*dealt.columns, F.inline(rows))
    return pairs.filter(op.apply(F.col(a), F.col(b)))


def unequal_counts(left: DataFrame, right: DataFrame, how: JoinType | str, a: str, b: str, counted: str) -> DataFrame:
    """One row for the join on ``a <> b``: n_rows, and n_counted, its rows whose left column ``counted`` isn't null.

    No pair is made: the pairs of unequal keys are all pairs of known keys less those of equal ones, which the numbers of rows
    of each key tell.
    """
    how = JoinType.parse(how) if isinstance(how, str) else how
    if how in (JoinType.SEMI, JoinType.ANTI, JoinType.ASOF):
        raise ValueError("pairs are counted for inner and outer joins")
    one = F.count(F.lit(1))
    lefts = left.filter(F.col(a).isNotNull()).groupBy(F.col(a).alias("k")).agg(one.alias("n"), F.count(counted).alias("c"))
    rights = right.filter(F.col(b).isNotNull()).groupBy(F.col(b).alias("k2")).agg(one.alias("m"))

    def total(*parts: Column) -> list[Column]:
        return [F.coalesce(F.sum(p), F.lit(0)).alias(f"t{i}") for i, p in enumerate(parts)]

    equal = lefts.join(rights, F.col("k") == F.col("k2")).agg(*total(F.col("n") * F.col("m"), F.col("c") * F.col("m"))).toDF("en", "ec")
    out = lefts.agg(*total(F.col("n"), F.col("c"))).toDF("n", "c").crossJoin(rights.agg(*total(F.col("m"))).toDF("m")).crossJoin(equal)
    n_rows, n_counted = F.col("n") * F.col("m") - F.col("en"), F.col("c") * F.col("m") - F.col("ec")
    if how in (JoinType.LEFT, JoinType.FULL):
        out = out.crossJoin(_partnered(left, a, Op.NE, right, b, False).agg(one.alias("l"), F.count(counted).alias("lc")))
        n_rows, n_counted = n_rows + F.col("l"), n_counted + F.col("lc")
    if how in (JoinType.RIGHT, JoinType.FULL):
        out = out.crossJoin(_partnered(right, b, Op.NE, left, a, False).agg(one.alias("r")))
        n_rows = n_rows + F.col("r")
    return out.select(n_rows.alias("n_rows"), n_counted.alias("n_counted"))


def _partnered(df: DataFrame, a: str, op: Op, other: DataFrame, b: str, has: bool) -> DataFrame:
    """Rows of ``df`` that have (or lack) a row of ``other`` with ``a op b``, by the extremes of ``b``."""
    low, high = other.select(F.min(b)).scalar(), other.select(F.max(b)).scalar()
    one: Column
    if op is Op.NE:
        one = (F.col(a) != low) | (F.col(a) != high)
    else:
        one = op.apply(F.col(a), high if op in (Op.LT, Op.LE) else low)
    known = F.coalesce(one, F.lit(False))
    return df.filter(known if has else ~known)


def asof_join(left: DataFrame, right: DataFrame, left_on: str, right_on: str, op: Op | str = Op.GE, by: list[tuple[str, str]] | None = None, buckets: int = 128) -> DataFrame:
    """Each left row with the nearest right row such that ``left_on op right_on``; unmatched rows get nulls.

    Of right rows with an equal key any one is taken, the largest by its columns' order.  Keys are cut into ``buckets`` ranges
    at approximate quantiles of the right side: within one, rows of both sides are put in order of the typed key and the last
    right row is carried on; what reaches into later ranges is one row a range (and ``by`` group), so neither a hot group
    nor its absence makes a single task.
    """
    op = Op.parse(op) if isinstance(op, str) else op
    if not op.ordered:
        raise ValueError("an as-of join needs an order")
    by = by or []
    down = op in (Op.GE, Op.GT)  # the nearest one below
    kind = left.schema[left_on].dataType.simpleString()
    number = _number(kind)  # it chooses the range only
    keys = [f"_by{i}" for i in range(len(by))]
    packed = F.struct(*right.columns)
    rights = right.filter(F.col(right_on).isNotNull()).select(*(F.col(b).alias(k) for k, (_, b) in zip(keys, by, strict=True)), F.col(right_on).alias("_k"), packed.alias("_r"))
    rights = rights.groupBy(*keys, "_k").agg(F.max("_r").alias("_r"))
    lefts = left.select(*(F.col(a).alias(k) for k, (a, _) in zip(keys, by, strict=True)), F.col(left_on).alias("_k"), F.struct(*left.columns).alias("_l"))
    shares = [k / buckets for k in range(1, buckets)]
    cuts = sorted(set(right.agg(F.percentile_approx(number(F.col(right_on)), shares, 10 * buckets)).first()[0] or [])) if shares else []
    bucket = (_range_of(number(F.col("_k")), cuts, 0) * (1 if down else -1)).cast("int").alias("_b")
    # an equal key is before the left row for >= and <=, after it for > and <
    first = 0 if op in (Op.GE, Op.LE) else 2
    none_l, none_r = F.lit(None).cast(lefts.schema["_l"].dataType), F.lit(None).cast(rights.schema["_r"].dataType)
    both = rights.select(*keys, "_k", bucket, F.lit(first).alias("_o"), none_l.alias("_l"), "_r").unionByName(lefts.select(*keys, "_k", bucket, F.lit(1).alias("_o"), "_l", none_r.alias("_r")))
    onwards = F.col("_k").asc() if down else F.col("_k").desc()
    inside = Window.partitionBy(*keys, "_b").orderBy(onwards, "_o").rowsBetween(Window.unboundedPreceding, 0)
    carried = both.withColumn("_r", F.when(F.col("_k").isNotNull(), F.last("_r", True).over(inside))).filter("_o = 1")
    # the last right row of the latest range before
    lasts = rights.withColumn("_b", bucket).groupBy(*keys, "_b").agg((F.max_by if down else F.min_by)("_r", "_k").alias("_last"))
    known = lasts.select(*keys, "_b", "_last").unionByName(lefts.select(*keys, bucket).distinct().select(*keys, "_b", none_r.alias("_last")))
    known = known.groupBy(*keys, "_b").agg(F.first("_last", True).alias("_last"))
    across = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    reach = known.select(*(F.col(k).alias(f"{k}_") for k in keys), F.col("_b").alias("_b_"), F.last("_last", True).over(across).alias("_before"))
    match = F.expr("_b <=> _b_")
    for k in keys:
        match = match & F.col(k).eqNullSafe(F.col(f"{k}_"))
    joined = carried.join(reach, match, "left")
    nearest = F.coalesce("_r", F.when(F.col("_k").isNotNull(), F.col("_before")))
    if keys:  # a null group matches nothing
        nearest = F.when(~F.greatest(*(F.col(k).isNull() for k in keys)) if len(keys) > 1 else F.col(keys[0]).isNotNull(), nearest)
    out = joined.select("_l", nearest.alias("_r"))
    return out.select("_l.*", *(F.col("_r")[c].alias(c) for c in right.columns))


def _range_of(value: Column, cuts: list[float], base: int) -> Column:
    """The number of ``cuts`` at most ``value``, plus ``base``, by halving."""
    if not cuts:
        return F.lit(base)
    mid = len(cuts) // 2
    return F.when(value < cuts[mid], _range_of(value, cuts[:mid], base)).otherwise(_range_of(value, cuts[mid + 1 :], base + mid + 1))


def _range_text(name: str, cuts: list[float], base: int) -> str:
    """The same of a column as SQL text; a list that is halved in a loop, as nested cases grow too long to be compiled."""
    if not cuts:
        return str(base)
    steps = [1 << k for k in reversed(range(len(cuts).bit_length()))]
    # filled up to 2^n - 1, with what is at most NaN only
    filled = [*cuts, *[float("nan")] * (2 * steps[0] - 1 - len(cuts))]
    listed = f"array({', '.join(f'double({str(x)!r})' for x in filled)})"
    found = f"aggregate(array({', '.join(map(str, steps))}), 0, (n, step) -> IF({name} >= {listed}[n + step - 1], n + step, n))"
    return f"({base} + {found})"

"""Fixtures with their SQL answers, and the whole matrix against DuckDB."""

import random

import duckdb
import pytest
from pyspark.sql import functions as F

from plait.operators.joins import asof_join, join_tables
from plait.operators.strategies import Strategy, applicable, check, physical_join
from plait.spec import JoinType, Op


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def bag(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


CASES = [
    ("INNER", "=", [(1, "L1"), (2, "L2"), (3, "L3")], [(2, "R2"), (3, "R3"), (4, "R4")], [(2, "L2", 2, "R2"), (3, "L3", 3, "R3")]),
    ("INNER", "<", [(1, "A1"), (2, "A2")], [(2, "B2"), (3, "B3")], [(1, "A1", 2, "B2"), (1, "A1", 3, "B3"), (2, "A2", 3, "B3")]),
    ("INNER", ">=", [(1, "X1"), (2, "X2")], [(1, "Y1"), (2, "Y2"), (3, "Y3")], [(1, "X1", 1, "Y1"), (2, "X2", 1, "Y1"), (2, "X2", 2, "Y2")]),
    ("LEFT", "=", [(1, "L1"), (2, "L2"), (3, "L3")], [(2, "R2")], [(1, "L1", None, None), (2, "L2", 2, "R2"), (3, "L3", None, None)]),
    ("LEFT", "<", [(1, "A1"), (3, "A3")], [(2, "B2")], [(1, "A1", 2, "B2"), (3, "A3", None, None)]),
    ("RIGHT", "=", [(1, "L1")], [(1, "R1"), (2, "R2")], [(1, "L1", 1, "R1"), (None, None, 2, "R2")]),
    ("RIGHT", ">", [(2, "L2")], [(1, "R1"), (3, "R3")], [(2, "L2", 1, "R1"), (None, None, 3, "R3")]),
    ("FULL", "=", [(1, "L1"), (2, "L2")], [(2, "R2"), (3, "R3")], [(1, "L1", None, None), (2, "L2", 2, "R2"), (None, None, 3, "R3")]),
    ("FULL", "<>", [(1, "X1"), (2, "X2")], [(1, "Y1"), (3, "Y3")], [(1, "X1", 3, "Y3"), (2, "X2", 1, "Y1"), (2, "X2", 3, "Y3")]),
    ("INNER", "=", [(2, "a"), (2, "b")], [(2, "x"), (2, "y")], [(2, a, 2, b) for a in "ab" for b in "xy"]),
    ("INNER", "=", [], [(2, "x")], []),
    ("LEFT", "=", [(1, "a"), (2, "b")], [], [(1, "a", None, None), (2, "b", None, None)]),
    ("RIGHT", "=", [(5, "Z")], [(5, "A"), (5, "B"), (25, "C")], [(5, "Z", 5, "A"), (5, "Z", 5, "B"), (None, None, 25, "C")]),
]


@pytest.mark.parametrize(("how", "op", "left", "right", "want"), CASES)
def test_fixture(spark, how, op, left, right, want):
    df = join_tables(frame(spark, left, "id int, l_val string"), frame(spark, right, "id int, r_val string"), how, "id", op, "id")
    assert df.columns == ["id", "l_val", "right_id", "r_val"]
    assert bag(df) == sorted(want, key=repr)


def _rows(seed, n):
    rng = random.Random(seed)
    return [(rng.choice([None, *range(6)]), k) for k in range(n)]


@pytest.fixture(scope="module")
def oracle():
    con = duckdb.connect()
    for name, seed, n in (("l", 1, 14), ("r", 2, 11), ("one", 3, 1), ("none", 4, 0)):
        con.execute(f"CREATE TABLE {name} (k INTEGER, v INTEGER)")
        con.executemany(f"INSERT INTO {name} VALUES (?, ?)", _rows(seed, n)) if n else None
    con.execute("INSERT INTO one SELECT 3, 7")
    return con


@pytest.mark.parametrize("limit", ["10m", "-1"])
@pytest.mark.parametrize("how", ["INNER", "LEFT", "RIGHT", "FULL", "SEMI", "ANTI"])
def test_matrix(spark, oracle, how, limit):
    """All operators, with null and repeated keys, with broadcasts and without any."""
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    try:
        for a, b, ops in (("l", "r", Op), ("l", "one", [Op.NE]), ("r", "none", [Op.LE])):
            left, right = (frame(spark, oracle.execute(f"SELECT * FROM {t}").fetchall(), "k int, v int") for t in (a, b))
            for op in ops:
                want = oracle.execute(f"SELECT * FROM {a} x {how} JOIN {b} y ON x.k {op.value} y.k").fetchall()
                assert bag(join_tables(left, right, how, "k", op, "k")) == sorted(want, key=repr), (a, b, op)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


@pytest.mark.parametrize("how", [JoinType.INNER, JoinType.LEFT, JoinType.RIGHT, JoinType.FULL])
def test_strategies_agree(spark, how):
    left, right = frame(spark, _rows(5, 30), "k int, v int"), frame(spark, _rows(6, 25), "k int, w int")
    for op in (Op.EQ, Op.NE, Op.LE):
        want = bag(join_tables(left, right, how, "k", op, "k"))
        for s in applicable(how, op):
            assert bag(join_tables(left, right, how, "k", op, "k", s)) == want, (op, s)


@pytest.mark.parametrize(("strategy", "node"), [("hash", "BroadcastHashJoin"), ("grace", "ShuffledHashJoin"), ("merge", "SortMergeJoin")])
def test_hints_are_followed(spark, strategy, node):
    left, right = spark.range(30).withColumnRenamed("id", "k"), spark.range(20).withColumnRenamed("id", "k")
    assert physical_join(join_tables(left, right, "INNER", "k", "=", "k", strategy)) == [node]


@pytest.mark.parametrize(
    ("strategy", "nodes"),
    [
        ("hash", {"LEFT": "BroadcastHashJoin", "RIGHT": "ShuffledHashJoin", "FULL": "ShuffledHashJoin"}),
        ("grace", dict.fromkeys(("LEFT", "RIGHT", "FULL"), "ShuffledHashJoin")),
        ("merge", dict.fromkeys(("LEFT", "RIGHT", "FULL"), "SortMergeJoin")),
        ("index_nl", {"LEFT": "BroadcastHashJoin", "RIGHT": "ShuffledHashJoin", "FULL": "ShuffledHashJoin"}),
        ("block_nl", dict.fromkeys(("LEFT", "RIGHT", "FULL"), "BroadcastNestedLoopJoin")),
    ],
)
def test_outer_joins_run_as_asked(spark, strategy, nodes):
    left = spark.sql("SELECT * FROM VALUES (1, 'a'), (1, 'b'), (2, 'c'), (NULL, 'd'), (9, 'e') AS t(k, l)")
    right = spark.sql("SELECT * FROM VALUES (1, 'x'), (1, 'y'), (NULL, 'z'), (5, 'w') AS t(k, r)")
    for how, node in nodes.items():
        joined = join_tables(left, right, how, "k", "=", "k", strategy)
        assert physical_join(joined) == [node]
        want = left.join(right.withColumnRenamed("k", "right_k"), left["k"] == F.col("right_k"), how.lower())
        assert sorted(map(str, joined.collect())) == sorted(map(str, want.collect()))


def test_index_join_reads_a_range(spark, tmp_path):
    spark.range(10_000).withColumnRenamed("id", "r").write.parquet(str(tmp_path / "r"))
    joined = join_tables(spark.range(40, 50), spark.read.parquet(str(tmp_path / "r")), "INNER", "id", "=", "r", "index_nl")
    assert "GreaterThanOrEqual(r,40), LessThanOrEqual(r,49)" in joined._jdf.queryExecution().executedPlan().toString()
    assert joined.count() == 10


def test_asof_tells_large_keys_apart(spark):
    left = spark.createDataFrame([((1 << 60) + 5,), (None,)], "k long")
    right = spark.createDataFrame([((1 << 60) + 3,), ((1 << 60) + 9,), (-(1 << 62),)], "r long")
    for op, r in ((">=", (1 << 60) + 3), ("<=", (1 << 60) + 9)):
        assert {(x.k, x.r) for x in asof_join(left, right, "k", "r", op).collect()} == {((1 << 60) + 5, r), (None, None)}


def test_strategies_that_do_not_apply():
    with pytest.raises(ValueError):
        check(Strategy.HASH, JoinType.INNER, Op.LT)
    with pytest.raises(ValueError):
        check(Strategy.MERGE, JoinType.INNER, Op.NE)


@pytest.mark.parametrize("op", [">=", ">", "<=", "<"])
def test_asof(spark, op):
    rng = random.Random(9)
    left = [(rng.choice([None, 1, 2]), rng.choice([None, *range(40)]), k) for k in range(40)]
    right = [(g, t, 100 * g + t) for g in (1, 2) for t in range(3, 40, 5)]
    con = duckdb.connect()
    con.execute("CREATE TABLE l (g INTEGER, t INTEGER, k INTEGER)")
    con.execute("CREATE TABLE r (g INTEGER, t INTEGER, w INTEGER)")
    con.executemany("INSERT INTO l VALUES (?, ?, ?)", left)
    con.executemany("INSERT INTO r VALUES (?, ?, ?)", right)
    want = con.execute(f"SELECT l.*, r.t, r.w FROM l ASOF LEFT JOIN r ON l.g = r.g AND l.t {op} r.t").fetchall()
    lf, rf = frame(spark, left, "g int, t int, k int"), frame(spark, right, "h int, u int, w int")
    for buckets in (1, 7):
        got = asof_join(lf, rf, "t", "u", op, by=[("g", "h")], buckets=buckets).select("g", "t", "k", "u", "w")
        assert bag(got) == sorted(want, key=repr)
    alone = [r for r in right if r[0] == 1]
    con.execute("DELETE FROM r WHERE g = 2")
    want = con.execute(f"SELECT l.*, r.t, r.w FROM l ASOF LEFT JOIN r ON l.t {op} r.t").fetchall()
    got = join_tables(lf, frame(spark, alone, "h int, u int, w int"), "ASOF", "t", op, "u").select("g", "t", "k", "u", "w")
    assert bag(got) == sorted(want, key=repr)

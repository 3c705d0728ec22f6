"""Joins that test many pairs: dealt over tasks, counted without pairs, or held in blocks."""

import random

import duckdb
import pytest

from plait.operators import joins
from plait.operators.joins import join_tables, unequal_counts
from plait.operators.strategies import physical_join
from plait.queries import QUERIES

@pytest.fixture
def tables(spark, tmp_path, monkeypatch):
    """Two tables of one file each, which count as large: unknown, repeated and odd keys."""
    monkeypatch.setattr(joins, "LARGE_WORK", 0)
    rng = random.Random(3)
    con = duckdb.connect()
    for name, n in (("l", 60), ("r", 40)):
        con.execute(f"CREATE TABLE {name} (d DOUBLE, k BIGINT, t VARCHAR, v INTEGER)")
        odd = [None, float("nan"), float("inf"), -0.0, 0.0]
        con.executemany(f"INSERT INTO {name} VALUES (?, ?, ?, ?)", [(rng.choice([*odd, *range(9)]), rng.choice([None, *range(12)]), rng.choice([None, "", "a", "prefixes-1", "prefixes-2"]), i if i % 7 else None) for i in range(n)])
        con.execute(f"COPY {name} TO '{tmp_path}/{name}.parquet'")
    return con, *(spark.read.parquet(f"{tmp_path}/{t}.parquet") for t in "lr")


def same(con, joined, how, key, op):
    want = con.execute(f"SELECT * FROM l {how} JOIN r ON l.{key} {op} r.{key}").fetchall()
    # NaN differs from itself as a Python value
    return sorted(map(repr, map(tuple, joined.collect()))) == sorted(map(repr, want))


def dealt(spark, tables, how, limit):
    con, left, right = tables
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    try:
        for a, op in (("d", "<"), ("d", ">"), ("k", "<>"), ("k", ">=")):
            joined = join_tables(left, right, how, a, op, a)
            assert joined.rdd.getNumPartitions() >= 8
            assert same(con, joined, how, a, op), (a, op)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


@pytest.mark.parametrize("limit", ["10m", "-1"])
@pytest.mark.parametrize("how", ["LEFT", "RIGHT", "FULL"])
def test_large_outer_inequality_is_dealt(spark, tables, how, limit):
    dealt(spark, tables, how, limit)


@pytest.mark.parametrize("limit", ["10m", "-1"])
def test_large_inner_inequality_is_dealt(spark, tables, limit):
    dealt(spark, tables, "INNER", limit)


@pytest.mark.parametrize("how", ["INNER", "LEFT", "RIGHT", "FULL"])
def test_unequal_pairs_are_counted_without_making_them(spark, tables, how):
    con, left, right = tables
    for table, other in (("r", right), ("(SELECT * FROM r WHERE k = 3)", right.filter("k = 3")), ("(SELECT * FROM r WHERE k < 0)", right.filter("k < 0"))):
        want = con.execute(f"SELECT count(*), count(l.v) FROM l {how} JOIN {table} r ON l.k <> r.k").fetchone()
        assert tuple(unequal_counts(left, other, how, "k", "k", "v").first()) == want
    plan = QUERIES["ne_right_big"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "NOT (l_suppkey" not in plan  # no join tests each pair


def block_join(tables, how):
    con, left, right = tables
    for key in ("k", "d", "t"):
        joined = join_tables(left, right, how, key, "=", key, "block_nl")
        assert physical_join(joined) == ["SortMergeJoin"]  # on the numbers of the blocks, not pairs of all rows
        assert same(con, joined, how, key, "=")


def test_large_block_join_inner(spark, tables):
    block_join(tables, "INNER")


def test_large_block_join_full(spark, tables):
    block_join(tables, "FULL")


def test_large_block_join_right(spark, tables):
    block_join(tables, "RIGHT")


@pytest.fixture
def apart(spark, tmp_path, monkeypatch):
    """Many left keys beyond those of the right side."""
    monkeypatch.setattr(joins, "LARGE_WORK", 0)
    con = duckdb.connect()
    con.execute("CREATE TABLE l AS SELECT range AS k, range % 7 AS v FROM range(6000) UNION ALL SELECT NULL, 1")
    con.execute("CREATE TABLE r AS SELECT range - 5 AS k, range % 5 AS w FROM range(300) UNION ALL SELECT NULL, 2")
    for t in "lr":
        con.execute(f"COPY {t} TO '{tmp_path}/{t}.parquet'")
    return con, *(spark.read.parquet(f"{tmp_path}/{t}.parquet") for t in "lr")


def blocks_are_even(apart, monkeypatch, how):
    con, left, right = apart
    made = []
    text = joins._range_text
    monkeypatch.setattr(joins, "_range_text", lambda name, cuts, base: made.append(cuts) or text(name, cuts, base))
    joined = join_tables(left, right, how, "k", "=", "k", "block_nl")
    assert same(con, joined, how, "k", "=")
    edges = [float("-inf"), *max(made, key=len), float("inf")]
    for table, n in (("l", 6000), ("r", 300)):
        most = max(con.execute(f"SELECT count(*) FROM {table} WHERE k >= ? AND k < ?", list(e)).fetchone()[0] for e in zip(edges, edges[1:]))
        assert most <= n / 50  # of about 150 blocks; no block holds all left rows beyond the right side


def test_large_block_join_full_of_keys_beyond_the_other_side(apart, monkeypatch):
    blocks_are_even(apart, monkeypatch, "FULL")


def test_large_block_join_right_of_keys_beyond_the_other_side(apart, monkeypatch):
    blocks_are_even(apart, monkeypatch, "RIGHT")


def joined_rows(spark, joined):
    """Numbers of rows that the two sides bring to the join."""
    node = joined._jdf.queryExecution().optimizedPlan()
    while node.nodeName() != "Join":
        node = node.children().apply(0)
    sides = (node.children().apply(k) for k in range(2))
    return tuple(spark._jvm.org.apache.spark.sql.classic.Dataset.ofRows(spark._jsparkSession, side).count() for side in sides)


def test_large_block_join_right_leaves_out_left_keys_beyond_the_right_side(spark, apart):
    con, left, right = apart
    joined = join_tables(left, right, "RIGHT", "k", "=", "k", "block_nl")
    assert joined_rows(spark, joined) == (295, 301)  # of 6001 left rows; every right row is kept
    assert same(con, joined, "RIGHT", "k", "=")
    for cond in ("k IS NULL", "k > 7000"):  # no partner at all
        want = con.execute(f"SELECT * FROM l RIGHT JOIN (SELECT * FROM r WHERE {cond}) r ON l.k = r.k").fetchall()
        joined = join_tables(left, right.filter(cond), "RIGHT", "k", "=", "k", "block_nl")
        assert sorted(map(repr, map(tuple, joined.collect()))) == sorted(map(repr, want))


@pytest.mark.parametrize("how", ["INNER", "LEFT", "FULL"])
def test_large_block_joins_leave_out_no_kept_row(spark, apart, how):
    con, left, right = apart
    assert same(con, join_tables(left, right, how, "k", "=", "k", "block_nl"), how, "k", "=")


@pytest.mark.parametrize("dealt", ["l", "r"])
@pytest.mark.parametrize("op", ["<", "<=", ">", ">="])
def test_large_inner_order_is_tested_within_blocks(spark, tables, monkeypatch, dealt, op):
    con, left, right = tables
    monkeypatch.setattr(joins, "BLOCK_ROWS", 4)
    monkeypatch.setattr(joins, "size_in_bytes", lambda df: 2 if dealt in df.columns[-1] else 1)
    left, right = left.withColumnRenamed("v", "v_l"), right.withColumnRenamed("v", "v_r")
    for key in ("d", "k", "t"):
        joined = join_tables(left, right, "INNER", key, op, key)
        sent = "r" if dealt == "l" else "l"
        met, blocks = joined_rows(spark, joined)
        known = con.execute(f"SELECT count({key}) FROM {sent}").fetchone()[0]
        assert blocks == -(-known // 4)
        pairs = con.execute(f"SELECT count(*) FROM l JOIN r ON l.{key} {op} r.{key}").fetchone()[0]
        rows = con.execute(f"SELECT count({key}) FROM {dealt}").fetchone()[0]
        assert met <= pairs / 4 + 2 * rows  # of each row, full blocks of partners, one that holds some, and the last, which isn't full
        assert joined.columns == ["d", "k", "t", "v_l", "right_d", "right_k", "right_t", "v_r"]
        assert same(con, joined, "", key, op)


def test_large_inner_order_of_empty_or_unknown_keys(spark, tables):
    con, left, right = tables
    for cond in ("k IS NULL", "k > 100"):
        assert join_tables(left, right.filter(cond), "INNER", "k", "<", "k").count() == 0
        assert join_tables(left.filter(cond), right, "INNER", "k", "<", "k").count() == 0


def test_range_text_counts_cuts(spark):
    values = [float("-inf"), -1.5, -0.0, 0.0, 1.0, 2.0, 1e300, float("inf")]
    df = spark.createDataFrame([(x,) for x in values], "x double")
    for cuts in ([], [0.0], [-1.5, 0.0], [0.0, 1.0, 2.0], [-1.5, 0.0, 1.0, 2.0, 1e300], [1.0, float("inf")]):
        found = [r[0] for r in df.selectExpr(joins._range_text("x", cuts, 0)).collect()]
        assert found == [sum(c <= x for c in cuts) for x in values], cuts


def blocks_follow_each_other(spark, tmp_path, monkeypatch, how, op):
    """In each task's part of the result the pairs of one block of sent rows stand together, so the files repeat few sent rows at a time."""
    monkeypatch.setattr(joins, "LARGE_WORK", 0)
    monkeypatch.setattr(joins, "BLOCK_ROWS", 64)
    con = duckdb.connect()
    con.execute("CREATE TABLE l AS SELECT range AS i, hash(range) % 5000 AS a FROM range(3000)")
    con.execute("CREATE TABLE r AS SELECT hash(range + 7) AS j, range * 5 AS b, 'name-' || hash(range) AS n FROM range(1, 1000)")
    for t in "lr":
        con.execute(f"COPY {t} TO '{tmp_path}/{t}.parquet'")
    left, right = (spark.read.parquet(f"{tmp_path}/{t}.parquet") for t in "lr")
    monkeypatch.setattr(joins, "size_in_bytes", lambda df: 2 if "i" in df.columns else 1)
    out = f"{tmp_path}/out"
    join_tables(left, right, how, "a", op, "b").write.parquet(out)
    want = con.execute(f"SELECT count(*), sum(hash(i, a, j, b, n)) FROM l {how} JOIN r ON a {op} b").fetchone()
    assert con.execute(f"SELECT count(*), sum(hash(i, a, j, b, n)) FROM '{out}/*.parquet'").fetchone() == want
    parts = con.execute(f"SELECT list((b // 5 - 1) // 64 ORDER BY file_row_number) FROM read_parquet('{out}/*.parquet', file_row_number = true, filename = true) WHERE b IS NOT NULL GROUP BY filename").fetchall()
    assert len(parts) >= 8
    for (blocks,) in parts:
        assert sum(x != y for x, y in zip(blocks, blocks[1:])) == len(set(blocks)) - 1
    (size,) = con.execute(f"SELECT sum(total_compressed_size) FROM parquet_metadata('{out}/*.parquet')").fetchone()
    return size / want[0]


def test_large_inner_order_writes_blocks_together(spark, tmp_path, monkeypatch):
    assert blocks_follow_each_other(spark, tmp_path, monkeypatch, "INNER", "<") < 2  # bytes a row


def test_large_left_order_writes_blocks_together(spark, tmp_path, monkeypatch):
    assert blocks_follow_each_other(spark, tmp_path, monkeypatch, "LEFT", ">") < 2

"""Registered queries of the join engine and the same queries in DuckDB's SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plait.catalog import Catalog, ColumnDef, TableDef
from plait.functions import stats
from plait.operators import access
from plait.operators.joins import asof_join, join_tables, unequal_counts
from plait.operators.strategies import Strategy
from plait.parser import parse
from plait.plans.tree import Join, Scan, associate, commute, compile_tree, left_deep, left_to_right, plan, right_to_left
from plait.sources.pipe import pipe_lines, read_pipe, write_pipe
from plait.sources.scratch import scratch_path
from plait.spec import JoinType, Op

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events"]

Query = Callable[[SparkSession, str], DataFrame]


def catalog(spark: SparkSession, sf_dir: str, names: list[str] | None = None) -> Catalog:
    return Catalog(spark).register_parquet(sf_dir, names or TABLES)


def _chain(text: str, strategies: list[str] | None = None) -> Query:
    specs = parse(text, strict=True)
    names = [specs[0].left, *(s.right for s in specs)]
    return lambda spark, d: plan(specs, catalog(spark, d, names), strategies)


def _table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def _add(name: str, query: Query, sql: str | None = None) -> None:
    QUERIES[name] = query
    if sql is not None:
        SQL[name] = sql


_WORDS = {"INNER": "JOIN", "LEFT": "LEFT JOIN", "RIGHT": "RIGHT JOIN", "FULL": "FULL JOIN", "SEMI": "SEMI JOIN", "ANTI": "ANTI JOIN"}


def _sql(text: str, select: str = "*") -> str:
    """A query of the join language in SQL."""
    specs = parse(text, strict=True)
    joins = " ".join(f"{_WORDS[s.how.name]} {s.right} ON {s.left_col} {s.op.value} {s.right_col}" for s in specs)
    return f"SELECT {select} FROM {specs[0].left} {joins}"


_CHAIN5 = "customer INNER orders ON c_custkey = o_custkey INNER supplier ON o_custkey = s_suppkey INNER nation ON s_nationkey < n_nationkey INNER region ON n_regionkey >= r_regionkey"
_CHAIN3 = "customer INNER orders ON c_custkey = o_custkey INNER supplier ON o_custkey = s_suppkey"

_LANGUAGE = {
    "inner_eq": "customer INNER orders ON c_custkey = o_custkey",
    "left_eq": "customer LEFT supplier ON c_custkey = s_suppkey",
    "full_eq": "customer FULL supplier ON c_custkey = s_suppkey",
    "right_eq": "orders RIGHT customer ON o_custkey = c_custkey",
    "left_eq_fact": "orders LEFT lineitem ON o_orderkey = l_orderkey",
    "chain3": _CHAIN3,
    "chain4": "customer INNER orders ON c_custkey = o_custkey INNER lineitem ON o_orderkey = l_orderkey INNER part ON l_partkey = p_partkey",
    "chain5": _CHAIN5,
    "chain_star": "orders INNER customer ON o_custkey = c_custkey LEFT supplier ON orders.o_custkey = s_suppkey RIGHT nation ON c_nationkey = n_nationkey",
    "text_ne": "nation INNER region ON n_name <> r_name",
    "text_eq": "customer LEFT supplier ON c_name = s_name",
    "dec_lt": "customer INNER supplier ON c_acctbal < s_acctbal",
    "dec_gt_left": "customer LEFT supplier ON c_acctbal > s_acctbal",
    "ge_inner_region": "nation INNER region ON n_regionkey >= r_regionkey",
    "semi_eq": "orders SEMI lineitem ON o_orderkey = l_orderkey",
    "anti_eq": "orders ANTI lineitem ON o_orderkey = l_orderkey",
}
for _name, _text in _LANGUAGE.items():
    _add(_name, _chain(_text), _sql(_text))

# the whole matrix of types by operators on small keys
for _how in ("INNER", "LEFT", "RIGHT", "FULL"):
    for _op in Op:
        _text = f"supplier {_how} nation ON s_suppkey {_op.value} n_nationkey"
        _add(f"matrix_{_how.lower()}_{_op.name.lower()}", _chain(_text), _sql(_text))
for _how in ("SEMI", "ANTI"):  # each keeps some rows and drops some
    for _op, _pair in ((Op.LT, "nation {} region ON n_nationkey {} r_regionkey"), (Op.LE, "nation {} region ON n_nationkey {} r_regionkey"), (Op.GT, "region {} supplier ON r_regionkey {} s_suppkey")):
        _text = _pair.format(_how, _op.value)
        _add(f"matrix_{_how.lower()}_{_op.name.lower()}", _chain(_text), _sql(_text))

# every strategy gives the same rows
for _s in ("hash", "grace", "merge", "index_nl", "block_nl"):
    for _how in ("INNER", "LEFT", "RIGHT", "FULL"):
        _text = f"customer {_how} supplier ON c_custkey = s_suppkey"
        _add(f"strategy_{_s}_{_how.lower()}", _chain(_text, [_s]), _sql(_text))
    for _how in ("INNER", "LEFT", "RIGHT", "FULL"):  # repeated keys on both sides
        _text = f"supplier {_how} nation ON s_nationkey = n_regionkey"
        _add(f"strategy_{_s}_{_how.lower()}_repeated", _chain(_text, [_s]), _sql(_text))
for _s in ("merge", "index_nl", "block_nl"):
    _text = "supplier INNER nation ON s_suppkey <= n_nationkey"
    _add(f"strategy_{_s}_le", _chain(_text, [_s]), _sql(_text))


# theta joins whose results are too large to return row by row
def _ne_right_big(spark: SparkSession, d: str) -> DataFrame:
    return unequal_counts(_table(spark, d, "lineitem"), _table(spark, d, "supplier"), JoinType.RIGHT, "l_suppkey", "s_suppkey", "l_orderkey").withColumnRenamed("n_counted", "n_matched")


_add("ne_right_big", _ne_right_big, _sql("lineitem RIGHT supplier ON l_suppkey <> s_suppkey", "count(*) AS n_rows, count(l_orderkey) AS n_matched"))


def _date_full(spark: SparkSession, d: str) -> DataFrame:
    joined = _chain("orders FULL lineitem ON o_orderdate = l_shipdate")(spark, d)
    return joined.agg(F.count(F.lit(1)).alias("n_rows"), F.count("o_orderkey").alias("n_orders"), F.count("l_orderkey").alias("n_lines"), F.max("o_orderdate").alias("last_order"))


_add("date_full", _date_full, _sql("orders FULL lineitem ON o_orderdate = l_shipdate", "count(*) AS n_rows, count(o_orderkey) AS n_orders, count(l_orderkey) AS n_lines, max(o_orderdate) AS last_order"))


def _asof(spark: SparkSession, d: str) -> DataFrame:
    """Each order with the line shipped last before or on its date, by key of the order."""
    orders = _table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    days = _table(spark, d, "lineitem").groupBy("l_shipdate").agg(F.count(F.lit(1)).alias("n_lines"))
    return join_tables(orders, days, "ASOF", "o_orderdate", ">=", "l_shipdate")


_add(
    "asof_ge",
    _asof,
    "SELECT o_orderkey, o_custkey, o_orderdate, l_shipdate, n_lines FROM orders ASOF LEFT JOIN (SELECT l_shipdate, count(*) AS n_lines FROM lineitem GROUP BY l_shipdate) ON o_orderdate >= l_shipdate",
)


def _asof_by(spark: SparkSession, d: str) -> DataFrame:
    """Each order with the total of the same customer's next later order date."""
    orders = _table(spark, d, "orders")
    left = orders.select("o_orderkey", "o_custkey", "o_orderdate")
    right = orders.groupBy(F.col("o_custkey").alias("c"), F.col("o_orderdate").alias("next_date")).agg(F.count(F.lit(1)).alias("n_next"))
    return asof_join(left, right, "o_orderdate", "next_date", Op.LT, by=[("o_custkey", "c")]).drop("c")


_add(
    "asof_by_lt",
    _asof_by,
    """SELECT o_orderkey, o_custkey, o_orderdate, next_date, n_next FROM orders
ASOF LEFT JOIN (SELECT o_custkey AS c, o_orderdate AS next_date, count(*) AS n_next FROM orders GROUP BY ALL) r ON o_custkey = c AND o_orderdate < next_date""",
)


def _asof_large(spark: SparkSession, d: str) -> DataFrame:
    """Keys beyond the integers that a double tells apart, and one far outlier."""
    keys = _table(spark, d, "orders").select("o_orderkey", (F.lit(1 << 60) + F.col("o_orderkey")).alias("k"))
    right = _table(spark, d, "orders").filter("o_orderkey % 3 = 0").select((F.lit(1 << 60) + F.col("o_orderkey")).alias("r"))
    return asof_join(keys, right.unionByName(spark.createDataFrame([(1,)], "r long")), "k", "r", Op.GE)


_add(
    "asof_large_keys",
    _asof_large,
    """SELECT o_orderkey, k, r FROM (SELECT o_orderkey, 1152921504606846976 + o_orderkey AS k FROM orders)
ASOF LEFT JOIN (SELECT 1152921504606846976 + o_orderkey AS r FROM orders WHERE o_orderkey % 3 = 0 UNION ALL SELECT 1) ON k >= r""",
)

# rewrites keep the result and the order of the columns
def _rewritten(text: str, rule) -> Query:
    specs = parse(text, strict=True)
    names = [specs[0].left, *(s.right for s in specs)]

    def run(spark: SparkSession, d: str) -> DataFrame:
        return compile_tree(rule(left_deep(specs)), catalog(spark, d, names), names)

    return run


for _name, _text, _rule in (
    ("rewrite_commute_inner", "supplier INNER nation ON s_nationkey < n_nationkey", commute),
    ("rewrite_commute_full", "supplier FULL nation ON s_nationkey < n_nationkey", commute),
    ("rewrite_left_to_right", "customer LEFT supplier ON c_custkey = s_suppkey", left_to_right),
    ("rewrite_right_to_left", "orders RIGHT customer ON o_custkey = c_custkey", right_to_left),
    ("rewrite_associate", _CHAIN3, associate),
):
    _add(_name, _rewritten(_text, _rule), _sql(_text))


def _bushy(spark: SparkSession, d: str) -> DataFrame:
    """(customer, nation) joined with (orders, supplier)."""
    names = ["customer", "nation", "orders", "supplier"]
    left = Join(Scan("customer"), Scan("nation"), JoinType.INNER, "customer", "c_nationkey", Op.EQ, "nation", "n_nationkey")
    right = Join(Scan("orders"), Scan("supplier"), JoinType.LEFT, "orders", "o_custkey", Op.EQ, "supplier", "s_suppkey")
    return compile_tree(Join(left, right, JoinType.INNER, "customer", "c_custkey", Op.EQ, "orders", "o_custkey"), catalog(spark, d, names), names)


_add(
    "bushy",
    _bushy,
    "SELECT c.*, n.*, o.* FROM customer c JOIN nation n ON c_nationkey = n_nationkey JOIN (SELECT * FROM orders LEFT JOIN supplier ON o_custkey = s_suppkey) o ON c_custkey = o_custkey",
)

# scans, lookups, sorts
for _name in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem"):
    _add(f"scan_{_name}", lambda s, d, t=_name: _table(s, d, t), f"SELECT * FROM {_name}")
_add("point_lookup", lambda s, d: access.seek_equal(_table(s, d, "orders"), "o_orderkey", 1234), "SELECT * FROM orders WHERE o_orderkey = 1234")
_add("point_lookup_text", lambda s, d: access.seek_equal(_table(s, d, "customer"), "c_mktsegment", "AUTOMOBILE"), "SELECT * FROM customer WHERE c_mktsegment = 'AUTOMOBILE'")
_add("range_lookup", lambda s, d: access.seek_range(_table(s, d, "orders"), "o_orderkey", access.KeyRange(100, 200, True, False)), "SELECT * FROM orders WHERE o_orderkey >= 100 AND o_orderkey < 200 ORDER BY o_orderkey")
_add("range_lookup_open", lambda s, d: access.seek_range(_table(s, d, "customer"), "c_name", access.KeyRange(low="Customer#000001000")), "SELECT * FROM customer WHERE c_name >= 'Customer#000001000' ORDER BY c_name")
_add("sorted_table", lambda s, d: access.sort_by(_table(s, d, "supplier"), "s_acctbal"), "SELECT * FROM supplier ORDER BY s_acctbal")
_add(
    "pipe_lines",
    lambda s, d: pipe_lines(_chain("nation FULL region ON n_nationkey = r_regionkey")(s, d)),
    "SELECT concat_ws('|', coalesce(CAST(n_nationkey AS VARCHAR), ''), coalesce(n_name, ''), coalesce(CAST(n_regionkey AS VARCHAR), ''), coalesce(CAST(r_regionkey AS VARCHAR), ''), coalesce(r_name, '')) AS value FROM nation FULL JOIN region ON n_nationkey = r_regionkey",
)


def _pipe_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Supplier written as pipe text and read back with a declared schema."""
    df = _table(spark, d, "supplier").withColumn("s_acctbal", F.col("s_acctbal").cast("decimal(15,2)"))
    path = scratch_path(spark, "pipe")
    write_pipe(df, path)
    return read_pipe(spark, path, TableDef("supplier", (ColumnDef("s_suppkey", "BIGINT"), ColumnDef("s_name", "CHAR", length=25), ColumnDef("s_nationkey", "INT"), ColumnDef("s_acctbal", "DECIMAL", precision=15, scale=2))))


_add("pipe_round_trip", _pipe_round_trip, "SELECT s_suppkey, s_name, s_nationkey, CAST(s_acctbal AS DECIMAL(15,2)) AS s_acctbal FROM supplier")


def _index_lookup(spark: SparkSession, d: str) -> DataFrame:
    """Orders laid out by customer, then a range of customers."""
    index = access.build_index(_table(spark, d, "orders"), scratch_path(spark, "index"), "o_custkey")
    return access.seek_range(index, "o_custkey", access.KeyRange(10, 20, False, True))


_add("index_lookup", _index_lookup, "SELECT * FROM orders WHERE o_custkey > 10 AND o_custkey <= 20 ORDER BY o_custkey")
_add("located_row", lambda s, d: access.with_locator(_table(s, d, "nation")).filter("locator.row = 5").drop("locator"), "SELECT * FROM nation LIMIT 1 OFFSET 5")


# statistics
def _exact_stats(table: str, columns: list[str]) -> tuple[Query, str]:
    def run(spark: SparkSession, d: str) -> DataFrame:
        return stats.stats_frame(_table(spark, d, table).select(*columns), ("n_nulls", "low", "high"))

    one = "SELECT '{c}' AS column_name, count(*) AS n_rows, count(*) - count({c}) AS n_nulls, CAST(min({c}) AS VARCHAR) AS low, CAST(max({c}) AS VARCHAR) AS high FROM " + table
    return run, " UNION ALL ".join(one.format(c=c) for c in columns)


_add("stats_orders", *_exact_stats("orders", ["o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority"]))
_add("stats_customer", *_exact_stats("customer", ["c_custkey", "c_name", "c_nationkey", "c_mktsegment"]))
_add("stats_ndv", lambda s, d: stats.stats_frame(_table(s, d, "lineitem"), ("ndv",)).select("column_name", "ndv"))
_add("stats_quantiles", lambda s, d: stats.quantile_frame(_table(s, d, "orders"), "o_totalprice"))


def _ndv_close(spark: SparkSession, d: str) -> DataFrame:
    """Whether the sketched counts of distinct values are within 3 % of the exact ones."""
    orders = _table(spark, d, "orders")
    exact = orders.agg(*(F.count_distinct(c).alias(c) for c in orders.columns))
    exact = exact.select(F.explode(F.array(*(F.struct(F.lit(c).alias("column_name"), F.col(c).alias("n")) for c in orders.columns))).alias("s")).select("s.*")
    return stats.stats_frame(orders, ("ndv",)).join(exact, "column_name").select("column_name", "n", (F.abs(F.col("ndv") - F.col("n")) <= 0.03 * F.col("n")).alias("close"))


_ORDERS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"]
_add("stats_ndv_close", _ndv_close, " UNION ALL ".join(f"SELECT '{c}' AS column_name, count(DISTINCT {c}) AS n, true AS close FROM orders" for c in _ORDERS))


def _quantiles_close(spark: SparkSession, d: str) -> DataFrame:
    """Whether the rank of each estimated quantile is within 1 % of its share."""
    orders = _table(spark, d, "orders")
    found = stats.quantile_frame(orders, "o_totalprice")
    ranked = orders.select("o_totalprice").join(F.broadcast(found), F.col("o_totalprice") <= F.col("value"))  # three rows
    rank = ranked.groupBy("quantile").agg(F.count(F.lit(1)).alias("below"))
    return rank.crossJoin(orders.agg(F.count("o_totalprice").alias("n_rows"))).select("quantile", "n_rows", (F.abs(F.col("below") / F.col("n_rows") - F.col("quantile")) <= 0.01).alias("close"))


_add("stats_quantiles_close", _quantiles_close, "SELECT CAST(q AS DOUBLE) AS quantile, count(o_totalprice) AS n_rows, true AS close FROM orders, (VALUES (0.25), (0.5), (0.75)) t(q) GROUP BY q")


def _sorted_files(spark: SparkSession, d: str) -> DataFrame:
    """Sortedness of orders laid out by key in several files of unequal size."""
    path = scratch_path(spark, "files")
    orders = _table(spark, d, "orders").withColumn("band", F.when(F.col("o_orderkey") < 40, 0).when(F.col("o_orderkey") < 4000, 1).otherwise(2))
    orders.repartitionByRange(3, "band").sortWithinPartitions("o_orderkey").drop("band").write.parquet(path)
    laid = spark.read.parquet(path)
    return spark.createDataFrame([(c, access.is_sorted(laid, c)) for c in ("o_orderkey", "o_custkey")], "column_name string, was_sorted boolean")


_add("stats_was_sorted_files", _sorted_files, "SELECT 'o_orderkey' AS column_name, true AS was_sorted UNION ALL SELECT 'o_custkey', false")
_add("stats_prefixes", lambda s, d: stats.prefix_histogram(_table(s, d, "part"), "p_name"), "SELECT substr(p_name, 1, 3) AS prefix, count(*) AS n FROM part WHERE p_name IS NOT NULL GROUP BY 1")
_add(
    "stats_was_sorted",
    lambda s, d: s.createDataFrame([(c, access.is_sorted(_table(s, d, "orders"), c)) for c in ("o_orderkey", "o_custkey")], "column_name string, was_sorted boolean"),
    """SELECT 'o_orderkey' AS column_name, bool_and(coalesce(p <= o_orderkey, true)) AS was_sorted FROM (SELECT o_orderkey, lag(o_orderkey) OVER (ORDER BY r) AS p FROM (SELECT *, row_number() OVER () AS r FROM orders))
UNION ALL SELECT 'o_custkey', bool_and(coalesce(p <= o_custkey, true)) FROM (SELECT o_custkey, lag(o_custkey) OVER (ORDER BY r) AS p FROM (SELECT *, row_number() OVER () AS r FROM orders))""",
)

STRATEGIES = [s.value for s in Strategy]

"""Declarations of the eight TPC-H tables."""

from __future__ import annotations

from plait.catalog import ColumnDef, TableDef

# fixed values: names and types of the public TPC-H specification
_TABLES = {
    "region": "r_regionkey INT, r_name CHAR(25), r_comment CHAR(152)",
    "nation": "n_nationkey INT, n_name CHAR(25), n_regionkey INT, n_comment CHAR(152)",
    "customer": "c_custkey INT, c_name CHAR(25), c_address CHAR(40), c_nationkey INT, c_phone CHAR(15), c_acctbal DECIMAL(15,2), c_mktsegment CHAR(10), c_comment CHAR(117)",
    "supplier": "s_suppkey INT, s_name CHAR(25), s_address CHAR(40), s_nationkey INT, s_phone CHAR(15), s_acctbal DECIMAL(15,2), s_comment CHAR(101)",
    "part": "p_partkey INT, p_name CHAR(55), p_mfgr CHAR(25), p_brand CHAR(10), p_type CHAR(25), p_size INT, p_container CHAR(10), p_retailprice DECIMAL(15,2), p_comment CHAR(23)",
    "partsupp": "ps_partkey INT, ps_suppkey INT, ps_availqty INT, ps_supplycost DECIMAL(15,2), ps_comment CHAR(199)",
    "orders": "o_orderkey INT, o_custkey INT, o_orderstatus CHAR(1), o_totalprice DECIMAL(15,2), o_orderdate DATE, o_orderpriority CHAR(15), o_clerk CHAR(15), o_shippriority INT, o_comment STRING(79)",
    "lineitem": "l_orderkey INT, l_partkey INT, l_suppkey INT, l_linenumber INT, l_quantity DECIMAL(15,2), l_extendedprice DECIMAL(15,2), l_discount DECIMAL(15,2), l_tax DECIMAL(15,2), l_returnflag CHAR(1), l_linestatus CHAR(1), l_shipdate DATE, l_commitdate DATE, l_receiptdate DATE, l_shipinstruct CHAR(25), l_shipmode CHAR(10), l_comment CHAR(44)",
}


def _column(text: str, indexed: tuple[str, ...]) -> ColumnDef:
    name, kind = text.split(" ")
    kind, _, sizes = kind.rstrip(")").partition("(")
    numbers = [int(n) for n in sizes.split(",") if n]
    named = dict(zip(("precision", "scale") if kind == "DECIMAL" else ("length",), numbers, strict=False))
    return ColumnDef(name, kind, index=name in indexed, **named)


def tpch_schema(table: str, indexed: tuple[str, ...] = ()) -> TableDef:
    """One table's declaration; ``indexed`` names the columns that are laid out for lookups."""
    return TableDef(table, tuple(_column(c, indexed) for c in _TABLES[table].split(", ")))


def tpch_schemas() -> dict[str, TableDef]:
    return {t: tpch_schema(t) for t in _TABLES}

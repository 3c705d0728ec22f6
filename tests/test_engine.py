import json

import duckdb
import pandas as pd
import pytest
import yaml

from plait.catalog import Catalog, ColumnDef, TableDef
from plait.cli import answer
from plait.functions import stats
from plait.operators import access
from plait.operators.strategies import Strategy
from plait.parser import parse
from plait.plans import lab
from plait.plans.cost import estimate
from plait.plans.tree import alternatives, associate, commute, compile_tree, left_deep, left_to_right, plan, pretty, right_to_left
from plait.queries import QUERIES, SQL
from plait.sources.pipe import list_tables, read_pipe, write_pipe
from plait.spec import Op
from plait.tpch import tpch_schemas

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables(spark):
    c = Catalog(spark)
    c.register("a", spark.createDataFrame([(1, "X"), (2, "Y")], "ida int, va string"))
    c.register("b", spark.createDataFrame([(1, "U"), (2, "V"), (3, "W")], "idb int, vb string"))
    c.register("c", spark.createDataFrame([(2, "Z"), (3, "W")], "idc int, vc string"))
    return c


def bag(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_three_way(tables):
    df = plan(parse("a INNER b ON ida = idb INNER c ON a.ida = idc"), tables)
    assert df.columns == ["ida", "va", "idb", "vb", "idc", "vc"]
    assert bag(df) == [(2, "Y", 2, "V", 2, "Z")]


def test_colliding_columns(spark, tables):
    tables.register("d", spark.createDataFrame([(2, "D")], "ida int, va string"))
    assert plan(parse("a LEFT d ON a.ida = d.ida"), tables).columns == ["ida", "va", "d_ida", "d_va"]


def test_planning_reports_all_errors(tables):
    with pytest.raises(ValueError, match="no column x.*no column y"):
        plan(parse("a INNER b ON x = idb INNER c ON b.idb = c.y"), tables)


@pytest.mark.parametrize(
    ("rule", "text"),
    [(commute, "a INNER b ON ida < idb"), (commute, "a FULL b ON ida >= idb"), (left_to_right, "a LEFT b ON ida <> idb"), (right_to_left, "b RIGHT c ON idb = idc"), (associate, "a INNER b ON ida = idb INNER c ON idb <= idc")],
)
def test_rewrites_keep_rows_and_columns(tables, rule, text):
    node = left_deep(parse(text))
    new = rule(node)
    order = list(node.tables)
    assert new != node
    assert bag(compile_tree(new, tables, order)) == bag(compile_tree(node, tables, order))


def test_rewrites_that_do_not_apply():
    assert associate(left_deep(parse("a INNER b ON ida = idb INNER c ON a.ida = idc"))) is None
    assert associate(left_deep(parse("a LEFT b ON ida = idb INNER c ON idb = idc"))) is None
    assert commute(left_deep(parse("a LEFT b ON ida = idb"))) is None


def test_alternatives_agree(tables):
    node = left_deep(parse("a INNER b ON ida = idb INNER c ON idb = idc"))
    found = list(alternatives(node))
    assert len(found) >= 6
    assert len({str(bag(compile_tree(n, tables, list(node.tables)))) for n in found}) == 1


def test_plan_lab(tables, tmp_path):
    specs = parse("a INNER b ON ida = idb INNER c ON idb = idc")
    found = lab.ranked(specs, tables)
    assert [c for c, _ in found] == sorted(c for c, _ in found)
    results = lab.run_top(specs, tables, n=3, out=str(tmp_path))
    assert len(results) == 3
    assert len({r.plan for r in results}) == 3
    assert "fastest" in lab.report(results)
    assert lab.dump_plans(specs, tables, tmp_path / "plans.txt") == len(found)


def test_the_cheapest_plans_are_of_all_plans(tables):
    specs = parse("a INNER b ON ida = idb INNER c ON idb = idc")
    sizes = {"a": stats.TableStats(10, 20.0), "b": stats.TableStats(3000, 9.0), "c": stats.TableStats(70, 50.0)}
    every = lab.ranked(specs, tables, sizes)
    trees = list(alternatives(left_deep(specs)))
    assert len(every) == len({lab.pretty(t) for _, t in every}) == len(trees) * len([s for s in Strategy if s is not Strategy.AUTO]) ** 2
    assert [c for c, _ in every] == pytest.approx([estimate(t, sizes).cost for _, t in every])
    for n in (1, 6, 50):
        assert [c for c, _ in lab.ranked(specs, tables, sizes, n=n)] == pytest.approx([c for c, _ in every[:n]])


def test_measured_joins_replace_estimates(tables):
    specs = parse("a INNER b ON ida = idb")
    timings = lab.Timings()
    tables.stats.clear()
    lab.run_top(specs, tables, n=1, timings=timings)
    assert list(timings.seconds) == ["rank", "plan 1: compile", "plan 1: run"]
    rows = plan(specs, tables).count()
    for tree in alternatives(left_deep(specs)):
        assert estimate(tree, tables.statistics(["a", "b"])).rows == rows
    tables.register("a", tables.frames["a"])
    assert set(tables.stats) == {"b"}


def test_cost_grows_with_rows():
    node = left_deep(parse("a INNER b ON ida = idb"))
    small = {t: stats.TableStats(10, 20.0) for t in "ab"}
    large = {t: stats.TableStats(10_000, 20.0) for t in "ab"}
    assert estimate(node, small).cost < estimate(node, large).cost


def test_declared_pipe_files(spark, tmp_path):
    schema = TableDef("t", (ColumnDef("i", "INT"), ColumnDef("d", "DECIMAL", precision=15, scale=2), ColumnDef("t", "DATE"), ColumnDef("s", "STRING", length=9)))
    (tmp_path / "t.tbl").write_text('1|2.50|2020-01-02|a "b" |\n\n2||| |\n3|-1.00|1999-12-31||\n')
    (tmp_path / "t_clean.tbl").write_text("1|2.50|2020-01-02|x\n")
    (tmp_path / "other.tbl").write_text("1\n")
    assert list_tables(tmp_path) == ["other", "t", "t_clean"]
    assert list_tables(tmp_path / "missing") == []
    rows = [tuple(r) for r in read_pipe(spark, str(tmp_path / "t.tbl"), schema).collect()]
    assert [(r[0], None if r[1] is None else str(r[1]), None if r[2] is None else str(r[2]), r[3]) for r in rows] == [(1, "2.50", "2020-01-02", 'a "b" '), (2, None, None, " "), (3, "-1.00", "1999-12-31", None)]
    assert read_pipe(spark, str(tmp_path / "t_clean.tbl"), schema).count() == 1
    (tmp_path / "bad.tbl").write_text("x|1|2020-01-01|s|\n")
    with pytest.raises(Exception, match="(?i)malformed|parse|FAILFAST"):
        read_pipe(spark, str(tmp_path / "bad.tbl"), schema).collect()
    catalog = Catalog(spark).register_pipe(tmp_path, {"t": schema})
    assert catalog.tables() == ["t"]


def test_pipe_round_trip(spark, tmp_path):
    schemas = tpch_schemas()
    df = spark.createDataFrame([(1, "A|B", 0, None), (2, None, 1, "x")], schemas["nation"].struct())
    write_pipe(df, str(tmp_path / "n"), single_file=True)
    lines = sorted(r[0] for r in spark.read.text(str(tmp_path / "n")).collect())
    assert lines == ["1|A|B|0|", "2||1|x"]


def test_lookups(spark, tmp_path):
    df = spark.createDataFrame([(k % 50, f"v{k:03d}") for k in range(200)], "k int, v string")
    index = access.build_index(df, str(tmp_path / "i"), "k", files=4)
    assert access.seek_equal(index, "k", 7).count() == 4
    assert [r.k for r in access.seek_range(index, "k", access.KeyRange(10, 12, False, True)).collect()] == [11] * 4 + [12] * 4
    assert access.seek_range(index, "k", access.KeyRange(high=1)).count() == 8
    meta = access.index_meta(spark, str(tmp_path / "i"), "k").orderBy("low").collect()
    assert sum(r.n_rows for r in meta) == 200
    assert all(a.high < b.low for a, b in zip(meta, meta[1:], strict=False))
    located = access.with_locator(index).first()
    assert access.read_located(index, located.locator.file, located.locator.row).first().v == located.v
    plan_text = access.seek_equal(index, "k", 7)._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(k,7)" in plan_text


def test_sortedness(spark):
    df = spark.createDataFrame([(None, 3), (1, 2), (1, None), (4, 9), (7, 1)], "a int, b int").coalesce(1)
    assert access.is_sorted(df, "a")
    assert not access.is_sorted(df, "b")
    path = f"{spark.sparkContext.getConf().get('spark.checkpoint.dir')}/unequal"
    spark.range(10).coalesce(1).write.mode("overwrite").parquet(path)
    spark.range(10, 200_000).coalesce(1).write.mode("append").parquet(path)
    names = sorted((r.file, r.low) for r in access.index_meta(spark, path, "id").collect())
    assert access.is_sorted(spark.read.parquet(path), "id") == ([low for _, low in names] == [0, 10])
    spark.range(5, 3, -1).coalesce(1).write.mode("append").parquet(path)
    assert not access.is_sorted(spark.read.parquet(path), "id")
    many = spark.range(1000).repartitionByRange(5, "id").sortWithinPartitions("id")
    assert access.is_sorted(many, "id")
    assert access.is_sorted(df.filter("a > 100"), "a")
    assert [r.a for r in access.sort_by(df, "a").collect()] == [None, 1, 1, 4, 7]


def test_statistics(spark, tmp_path):
    df = spark.createDataFrame([(k, None if k % 10 == 0 else k * 1.5, f"n{k % 7}") for k in range(2000)], "i int, d double, s string")
    s = stats.gather(df)
    assert (s.rows, s.columns["d"].nulls, s.columns["i"].low, s.columns["i"].high) == (2000, 200, 0, 1999)
    assert abs(s.columns["i"].ndv - 2000) <= 60
    assert s.columns["s"].ndv == 7
    assert abs(stats.cdf(s.columns["i"], 500) - 0.25) < 0.02
    assert stats.selectivity(Op.EQ, s.columns["i"], s.columns["i"]) == pytest.approx(1 / 2000, rel=0.05)
    assert stats.selectivity(Op.LT, s.columns["i"], s.columns["i"]) == pytest.approx(0.5, abs=0.05)
    assert stats.selectivity(Op.LT, None, s.columns["i"]) == stats.UNKNOWN
    stats.dump(s, tmp_path / "s.yml")
    stats.dump(s, tmp_path / "s.json")
    assert yaml.safe_load((tmp_path / "s.yml").read_text())["rows"] == json.loads((tmp_path / "s.json").read_text())["rows"] == 2000
    with pytest.raises(ValueError):
        stats.dump(s, tmp_path / "s.csv")
    assert {tuple(r) for r in stats.prefix_histogram(df, "s", 1).collect()} == {("n", 2000)}
    text = stats.gather(df, ("s",)).columns["s"]
    assert sum(text.prefixes.values()) == 2000
    assert stats.selectivity(Op.EQ, text, text, 2000, 2000) == pytest.approx(1 / 7, rel=0.05)


def test_prompt(tables):
    assert "INNER" in answer("help", tables)
    assert answer("a", tables) == "no joins"
    assert "no column" in answer("a INNER b ON zz = idb", tables)
    assert "V" in answer("a INNER b ON ida = idb", tables)
    assert "Physical Plan" in answer("explain a INNER b ON ida = idb", tables)


def test_flagship(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", ["inner_eq", "left_eq_fact", "chain3", "matrix_full_lt", "date_full", "asof_ge", "stats_orders", "pipe_lines"])
def test_queries_against_duckdb(spark, name):
    con = duckdb.connect()
    for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got = QUERIES[name](spark, SF).toPandas()
    want = con.execute(SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    cols = sorted(got.columns)
    rows = lambda d: sorted(tuple("" if pd.isna(v) else str(v).removesuffix(".0") for v in r) for r in d[cols].itertuples(index=False))
    assert rows(got) == rows(want)

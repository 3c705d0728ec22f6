import pytest

from plait.catalog import Catalog, ColumnDef, TableDef, load_schemas
from plait.parser import parse
from plait.spec import JoinSpec, JoinType, Op
from plait.tpch import tpch_schema, tpch_schemas
from plait.validator import resolve, validate


def test_single_join():
    assert parse("table1 INNER table2 ON table1.id = table2.id") == [JoinSpec("table1", "table2", JoinType.INNER, "id", Op.EQ, "id")]


def test_chain_over_lines():
    text = """a inner b ON a.x = b.x
      LEFT c ON b.y = c.y
      RIGHT d ON c.z <> d.z"""
    found = parse(text)
    assert [(s.left, s.right, s.how.name, s.op.value) for s in found] == [("a", "b", "INNER", "="), ("b", "c", "LEFT", "="), ("c", "d", "RIGHT", "<>")]


@pytest.mark.parametrize("text", ["", "   ", "table1"])
def test_no_joins(text):
    assert parse(text) == []


@pytest.mark.parametrize("op", ["=", "<>", "<", "<=", ">", ">="])
@pytest.mark.parametrize("space", ["", " "])
def test_operators_with_and_without_spaces(op, space):
    assert parse(f"a FULL b ON x{space}{op}{space}y")[0].op.value == op


@pytest.mark.parametrize("text", ["t1 UNKNOWN t2 ON t1.a = t2.a", "t1 INNER t2 ON a == b", "t1 INNER t2 ON a != b", "t1 INNER t2 ON", "t1 INNER t2 ON z.a = t2.a"])
def test_wrong_queries_raise(text):
    with pytest.raises(ValueError):
        parse(text)


def test_rest_is_reported():
    with pytest.warns(UserWarning, match="AND more"):
        assert len(parse("t1 INNER t2 ON t1.id = t2.id AND more text")) == 1
    with pytest.raises(ValueError):
        parse("t1 INNER t2 ON t1.id = t2.id AND more text", strict=True)


def test_swapped_sides_and_earlier_tables():
    a, b = parse("t1 INNER t2 ON t2.b < t1.a LEFT t3 ON t1.c = t3.d")
    assert (a.left_col, a.op, a.right_col) == ("a", Op.GT, "b")
    assert b.left == "t1"


def test_flipping():
    assert [o.flipped.value for o in Op] == ["=", "<>", ">", ">=", "<", "<="]


def _table(name, **columns):
    extra = {"CHAR": {"length": 5}, "STRING": {"length": 5}, "DECIMAL": {"precision": 9, "scale": 2}}
    return TableDef(name, tuple(ColumnDef(c, t, **extra.get(t, {})) for c, t in columns.items()))


@pytest.fixture
def catalog():
    c = Catalog(None)
    c.defs = {"a": _table("a", i="INT", s="STRING", d="DECIMAL", t="DATE"), "b": _table("b", j="BIGINT", k="INT", r="CHAR", e="DECIMAL"), "c": _table("c", u="INT")}
    return c


@pytest.mark.parametrize("text", ["a INNER b ON i = k", "a INNER b ON d < e", "a INNER b ON s <> r", "a INNER b ON i >= j", "a INNER b ON i = k INNER c ON k = u", "a INNER b ON i = k INNER c ON i = u"])
def test_valid(catalog, text):
    assert validate(resolve(parse(text), catalog), catalog) == []


@pytest.mark.parametrize("text", ["a INNER b ON s < r", "x INNER b ON i = k", "a INNER x ON i = k", "a INNER b ON i = r", "a INNER b ON zz = k", "a INNER b ON i = zz", "a INNER a ON i = i", "a INNER A ON i = i", "a INNER b ON i = k INNER a ON k = i", "a INNER b ON i = k INNER c ON t = u"])
def test_invalid(catalog, text):
    assert validate(resolve(parse(text), catalog), catalog)


def test_identical_types(catalog):
    specs = parse("a INNER b ON i = j")
    assert validate(specs, catalog) == []
    assert validate(specs, catalog, identical_types=True)


def test_declared_schemas(tmp_path):
    found = tpch_schemas()
    assert sorted(found) == ["customer", "lineitem", "nation", "orders", "part", "partsupp", "region", "supplier"]
    assert found["orders"].type_of("o_comment") == "STRING"
    assert not [p for t in found.values() for c in t.columns for p in c.problems()]
    assert [c.name for c in tpch_schema("customer", ("c_name",)).columns if c.index] == ["c_name"]
    assert found["part"].columns[7] == ColumnDef("p_retailprice", "DECIMAL", precision=15, scale=2)
    (tmp_path / "towns.yml").write_text("table: towns\ncolumns:\n- {name: t_id, type: INT, index: true}\n- {name: t_name, type: STRING}\n")
    assert [c.name for c in load_schemas(tmp_path)["towns"].columns if c.index] == ["t_id"]


@pytest.mark.parametrize("column", [{"type": "DECIMAL", "precision": 5}, {"type": "INT", "length": 4}, {"type": "CHAR"}, {"type": "BOOL"}, {"type": "STRING", "scale": 2}])
def test_wrong_declarations(column):
    with pytest.raises(ValueError):
        TableDef.from_dict({"table": "t", "columns": [{"name": "c", **column}]})


def test_string_length_has_a_default():
    assert TableDef.from_dict({"table": "t", "columns": [{"name": "c", "type": "STRING"}]}).columns[0].length == 256

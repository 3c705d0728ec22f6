"""Tables and their declared schemas."""

from __future__ import annotations

import logging
from dataclasses import dataclass, field, replace
from pathlib import Path
from typing import Any

import yaml
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from plait.functions.stats import TableStats, gather

log = logging.getLogger(__name__)

#: Family of each declared type; columns compare within a family.
FAMILIES = {"INT": "integer", "BIGINT": "integer", "DECIMAL": "number", "DATE": "time", "CHAR": "text", "STRING": "text"}
DEFAULT_STRING_LENGTH = 256


@dataclass(frozen=True)
class ColumnDef:
    name: str
    type: str
    length: int | None = None
    precision: int | None = None
    scale: int | None = None
    index: bool = False

    def problems(self) -> list[str]:
        """What the declaration lacks or has too much of."""
        if self.type not in FAMILIES:
            return [f"{self.name}: unknown type {self.type}"]
        needs = {"DECIMAL": ("precision", "scale"), "CHAR": ("length",), "STRING": ("length",)}.get(self.type, ())
        given = [a for a in ("length", "precision", "scale") if getattr(self, a) is not None]
        return [f"{self.name}: {self.type} needs {a}" for a in needs if a not in given] + [f"{self.name}: {self.type} takes no {a}" for a in given if a not in needs]

    def spark_type(self) -> T.DataType:
        """Text is never padded or cut, so CHAR is a string."""
        if self.type == "DECIMAL":
            return T.DecimalType(self.precision, self.scale)
        return {"INT": T.IntegerType(), "BIGINT": T.LongType(), "DATE": T.DateType()}.get(self.type, T.StringType())


@dataclass(frozen=True)
class TableDef:
    table: str
    columns: tuple[ColumnDef, ...]

    def struct(self) -> T.StructType:
        return T.StructType([T.StructField(c.name, c.spark_type(), True, {"index": c.index, "length": c.length}) for c in self.columns])

    def type_of(self, column: str) -> str | None:
        return next((c.type for c in self.columns if c.name == column), None)

    @classmethod
    def from_dict(cls, found: dict) -> TableDef:
        columns = []
        for c in found["columns"]:
            one = ColumnDef(**c)
            if one.type == "STRING" and one.length is None:
                one = replace(one, length=DEFAULT_STRING_LENGTH)
            columns.append(one)
        if wrong := [p for c in columns for p in c.problems()]:
            raise ValueError(f"{found['table']}: " + "; ".join(wrong))
        return cls(found["table"], tuple(columns))


def load_schema(path: str | Path) -> TableDef:
    """One table's YAML declaration."""
    with open(path, encoding="utf-8") as f:
        return TableDef.from_dict(yaml.safe_load(f))


def load_schemas(folder: str | Path) -> dict[str, TableDef]:
    """All declarations in a folder by file name, so a table may be declared under another file's name too."""
    return {p.stem: load_schema(p) for p in sorted(Path(folder).glob("*.yml"))}


def declared(df: DataFrame, table: str) -> TableDef:
    """A declaration for a DataFrame that has none."""
    kinds = {T.IntegerType: "INT", T.ShortType: "INT", T.ByteType: "INT", T.LongType: "BIGINT", T.DateType: "DATE", T.TimestampType: "DATE", T.TimestampNTZType: "DATE"}
    columns = []
    for f in df.schema:
        if isinstance(f.dataType, T.DecimalType):
            columns.append(ColumnDef(f.name, "DECIMAL", precision=f.dataType.precision, scale=f.dataType.scale))
        elif isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            columns.append(ColumnDef(f.name, "DECIMAL", precision=38, scale=18))
        elif type(f.dataType) in kinds:
            columns.append(ColumnDef(f.name, kinds[type(f.dataType)]))
        else:
            columns.append(ColumnDef(f.name, "STRING", length=DEFAULT_STRING_LENGTH))
    return TableDef(table, tuple(columns))


@dataclass
class Catalog:
    """Names of tables to DataFrames and declarations.  Names are case-sensitive, as declared."""

    spark: SparkSession
    frames: dict[str, DataFrame] = field(default_factory=dict)
    defs: dict[str, TableDef] = field(default_factory=dict)
    stats: dict[Any, TableStats] = field(default_factory=dict)

    def statistics(self, tables: list[str]) -> dict[Any, TableStats]:
        """Statistics of the tables, gathered once each, and of the joins that were measured."""
        for t in tables:
            if t not in self.stats:
                text = tuple(c.name for c in self.defs[t].columns if FAMILIES[c.type] == "text")
                self.stats[t] = gather(self.frames[t], text)
        return self.stats

    def keep_statistics(self, tables: list[str], conditions: frozenset, stats: TableStats) -> None:
        """Rows and size of a join of ``tables``, in whatever order they were joined."""
        self.stats[frozenset(tables), conditions] = stats

    def register(self, name: str, df: DataFrame, schema: TableDef | None = None) -> None:
        if name in self.frames:
            log.warning("table %s is registered again", name)
            self.stats = {k: s for k, s in self.stats.items() if k != name and (isinstance(k, str) or name not in k[0])}
        self.frames[name] = df
        self.defs[name] = schema or declared(df, name)
        df.createOrReplaceTempView(name)

    def register_parquet(self, folder: str, names: list[str]) -> Catalog:
        for n in names:
            self.register(n, self.spark.read.parquet(f"{folder}/{n}.parquet"))
        return self

    def register_pipe(self, folder: str | Path, schemas: dict[str, TableDef]) -> Catalog:
        """Every ``*.tbl`` file of a folder that has a declaration; others are reported and left out."""
        from plait.sources.pipe import list_tables, read_pipe

        for n in list_tables(folder):
            if n in schemas:
                self.register(n, read_pipe(self.spark, f"{folder}/{n}.tbl", schemas[n]), schemas[n])
            else:
                log.warning("table %s has no schema and is left out", n)
        return self

    def tables(self) -> list[str]:
        return sorted(self.frames)

    def indexed_columns(self, table: str) -> list[str]:
        return [c.name for c in self.defs[table].columns if c.index]

"""Pipe-delimited text: reading with a declared schema, writing, and dumps of small tables."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plait.catalog import TableDef


def list_tables(folder: str | Path) -> list[str]:
    """Names of the ``*.tbl`` files; none if the folder is missing."""
    return sorted(p.stem for p in Path(folder).glob("*.tbl")) if Path(folder).is_dir() else []


def read_pipe(spark: SparkSession, path: str, schema: TableDef) -> DataFrame:
    """Rows of a file or folder.  An empty token is null, blank lines are skipped and a token that doesn't parse fails the query.

    Whether lines end with a separator, as the TPC-H generator's do, is seen from the first line.
    """
    struct = schema.struct()
    first = spark.read.text(path).filter("value <> ''").head(1)
    trailing = bool(first) and first[0][0].rstrip("\r").endswith("|") and first[0][0].count("|") >= len(struct)
    full = T.StructType([*struct.fields, T.StructField("_end", T.StringType())]) if trailing else struct
    rows = spark.read.schema(full).options(sep="|", quote="", mode="FAILFAST", dateFormat="yyyy-MM-dd", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(path)
    return rows.select(*struct.names)


def pipe_lines(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """One text column: values joined by the separator, null as nothing, nothing escaped."""
    return df.select(F.concat_ws("|", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns or df.columns)).alias("value"))


def write_pipe(df: DataFrame, path: str, columns: list[str] | None = None, single_file: bool = False) -> None:
    """Write a folder of text files; ``single_file`` is for results known to be small."""
    lines = pipe_lines(df, columns)
    (lines.coalesce(1) if single_file else lines).write.mode("overwrite").text(path)

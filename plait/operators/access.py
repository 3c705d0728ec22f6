"""Point and range lookups, sorted layouts in the place of indexes, row locators and sorts."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class KeyRange:
    """Bounds of a lookup; None is open."""

    low: Any = None
    high: Any = None
    low_inclusive: bool = True
    high_inclusive: bool = True

    def condition(self, key: str) -> Column:
        out = F.col(key).isNotNull()
        if self.low is not None:
            out = out & (F.col(key) >= self.low if self.low_inclusive else F.col(key) > self.low)
        if self.high is not None:
            out = out & (F.col(key) <= self.high if self.high_inclusive else F.col(key) < self.high)
        return out


def seek_equal(df: DataFrame, key: str, value: Any) -> DataFrame:
    """Rows with that key; the filter reaches the Parquet scan."""
    return df.filter(F.col(key) == value)


def seek_range(df: DataFrame, key: str, bounds: KeyRange) -> DataFrame:
    """Rows within the bounds, ascending."""
    return df.filter(bounds.condition(key)).orderBy(key)


def build_index(df: DataFrame, path: str, key: str, files: int | None = None) -> DataFrame:
    """Write ``df`` range-partitioned and sorted by ``key``, so that lookups skip files and row groups by their minimum and maximum."""
    dealt = df.repartitionByRange(files, key) if files else df.repartitionByRange(key)
    dealt.sortWithinPartitions(key).write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)


def index_meta(spark: SparkSession, path: str, key: str) -> DataFrame:
    """What a lookup prunes by: rows and key bounds of each file."""
    df = spark.read.parquet(path)
    return df.groupBy(F.col("_metadata.file_name").alias("file")).agg(F.count(F.lit(1)).alias("n_rows"), F.min(key).alias("low"), F.max(key).alias("high"))


def with_locator(df: DataFrame) -> DataFrame:
    """Add ``locator`` (file, row number in the file) to a DataFrame read from Parquet."""
    return df.select("*", F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row")).alias("locator"))


def read_located(df: DataFrame, file: str, row: int) -> DataFrame:
    """The row at a locator."""
    return df.filter((F.col("_metadata.file_path") == file) & (F.col("_metadata.row_index") == row))


def sort_by(df: DataFrame, key: str) -> DataFrame:
    """Total order by the typed value, nulls first."""
    return df.orderBy(F.col(key).asc_nulls_first())


def is_sorted(df: DataFrame, key: str) -> bool:
    """Whether the column never decreases; nulls are skipped.

    Rows of files are in the order of the file names and of the rows in them, others in that of the partitions.
    Each stretch of a file that a task reads gives one row, and these are compared in order; one row comes to the driver.
    """
    kind = df.schema[key].dataType.simpleString()
    try:
        placed = df.select(key, F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))
    except AnalysisException:  # not read from files
        placed = df.select(key, F.format_string("%010d", F.spark_partition_id()).alias("file"), F.monotonically_increasing_id().alias("row"))

    def ends(it):
        held: dict[str, list] = {}  # first row, first, last, fine of each file of the task
        for b in it:
            file, row = b.column(1), b.column(2)
            for name in pc.unique(file).to_pylist():
                here = pc.and_(pc.equal(file, name), pc.is_valid(b.column(0)))
                v = b.column(0).filter(here)
                if not len(v):
                    continue
                fine = len(v) < 2 or pc.all(pc.less_equal(v[:-1], v[1:])).as_py()
                if name in held:
                    last = held[name]
                    last[3] = last[3] and fine and not pc.less(v[0], last[2]).as_py()
                    last[2] = v[len(v) - 1]
                else:
                    held[name] = [row.filter(here)[0].as_py(), v[0], v[len(v) - 1], fine]
        for name, (start, first, last, fine) in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([start], pa.int64()), pa.array([first.as_py()], first.type), pa.array([last.as_py()], last.type), pa.array([fine])], names=["file", "start", "first", "last", "fine"])

    parts = placed.mapInArrow(ends, f"file string, start long, first {kind}, last {kind}, fine boolean")
    before = F.lag("last").over(Window.orderBy("file", "start"))
    found = parts.select("fine", (before > F.col("first")).alias("back")).agg(F.min("fine").alias("fine"), F.max(F.coalesce("back", F.lit(False))).alias("back")).first()
    return found["fine"] is not False and not found["back"]

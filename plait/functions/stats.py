"""Table and column statistics in one pass, and the estimates that follow from them."""

from __future__ import annotations

import json
import math
from dataclasses import asdict, dataclass, field
from pathlib import Path
from typing import Any

import yaml
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plait.spec import Op

# fixed values: bytes of a page and the share where nothing is known
PAGE_BYTES = 8192
#: Distinct counts come from HyperLogLog sketches of 2^14 registers (about 0.9 % off).
NDV_BITS = 14
QUANTILES = (0.25, 0.5, 0.75)
#: Shares whose quantiles are kept for planning.
SHARES = tuple(k / 100 for k in range(1, 100))
UNKNOWN = 1 / 3
PREFIX = 3
#: Prefixes kept of a text column.  The others share what rows are left.
PREFIXES = 1000


@dataclass
class ColumnStats:
    nulls: int
    ndv: int
    low: Any
    high: Any
    quantiles: list[float] = field(default_factory=list)  # one for each of SHARES
    prefixes: dict[str, int] = field(default_factory=dict)  # rows by first characters, of text


@dataclass
class TableStats:
    rows: int
    row_bytes: float
    columns: dict[str, ColumnStats] = field(default_factory=dict)

    @property
    def pages(self) -> int:
        return math.ceil(self.rows * self.row_bytes / PAGE_BYTES)


def _ndv(column: str) -> Column:
    """Sketched count of distinct values of any type, nulls left out."""
    return F.hll_sketch_estimate(F.hll_sketch_agg(F.when(F.col(column).isNotNull(), F.xxhash64(column)), F.lit(NDV_BITS)))


_MADE = {
    "n_nulls": lambda c: F.count_if(F.col(c).isNull()),
    "ndv": lambda c: _ndv(c),
    "low": lambda c: F.min(c).cast("string"),
    "high": lambda c: F.max(c).cast("string"),
}


def stats_frame(df: DataFrame, wanted: tuple[str, ...] = ("n_nulls", "ndv", "low", "high")) -> DataFrame:
    """A row for each column: n_rows and of n_nulls, ndv (sketched), low and high (as text) those ``wanted``.  One pass, partial aggregates."""
    wide = df.agg(F.count(F.lit(1)).alias("n_rows"), *(_MADE[w](c).alias(f"{c}__{w}") for c in df.columns for w in wanted))
    rows = [F.struct(F.lit(c).alias("column_name"), F.col("n_rows"), *(F.col(f"{c}__{w}").alias(w) for w in wanted)) for c in df.columns]
    return wide.select(F.explode(F.array(*rows)).alias("s")).select("s.*")


def row_bytes(df: DataFrame) -> Column:
    """Average size of a row as text."""
    return F.avg(F.octet_length(F.concat_ws("|", *(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in df.columns))))


def gather(df: DataFrame, prefixes: tuple[str, ...] = ()) -> TableStats:
    """Statistics for planning; one aggregate row comes to the driver, and the most frequent prefixes of the text columns in ``prefixes``."""
    numeric = [f.name for f in df.schema if isinstance(f.dataType, T.NumericType)]
    aggs = [F.count(F.lit(1)).alias("rows"), row_bytes(df).alias("row_bytes")]
    for c in df.columns:
        aggs += [F.count_if(F.col(c).isNull()).alias(f"{c}__nulls"), _ndv(c).alias(f"{c}__ndv"), F.min(c).alias(f"{c}__low"), F.max(c).alias(f"{c}__high")]
    aggs += [F.percentile_approx(F.col(c).cast("double"), list(SHARES), 10000).alias(f"{c}__q") for c in numeric]
    r = df.agg(*aggs).first()
    columns = {c: ColumnStats(r[f"{c}__nulls"], r[f"{c}__ndv"], r[f"{c}__low"], r[f"{c}__high"], list(r[f"{c}__q"] or []) if c in numeric else []) for c in df.columns}
    for c in prefixes:
        heads = prefix_histogram(df, c).orderBy(F.desc("n"), "prefix").limit(PREFIXES).collect()
        columns[c].prefixes = {h["prefix"]: h["n"] for h in heads}
    return TableStats(r["rows"], r["row_bytes"] or 0.0, columns)


def quantile_frame(df: DataFrame, column: str, accuracy: int = 10000) -> DataFrame:
    """Approximate quantiles of a column, a row each."""
    found = df.agg(F.percentile_approx(F.col(column).cast("double"), list(QUANTILES), accuracy).alias("q"))
    return found.select(F.posexplode("q").alias("k", "value")).select(F.element_at(F.array(*map(F.lit, QUANTILES)), F.col("k") + 1).alias("quantile"), "value")


def prefix_histogram(df: DataFrame, column: str, length: int = PREFIX) -> DataFrame:
    """Counts of the first characters of a text column."""
    return df.filter(F.col(column).isNotNull()).groupBy(F.substring(column, 1, length).alias("prefix")).agg(F.count(F.lit(1)).alias("n"))


def cdf(stats: ColumnStats, value: float) -> float:
    """Share of values at most ``value``, linear between the known quantiles."""
    if stats.low is None or not stats.quantiles:
        return 0.5
    points = [(float(stats.low), 0.0), *zip(map(float, stats.quantiles), SHARES, strict=True), (float(stats.high), 1.0)]
    if value < points[0][0]:
        return 0.0
    for (x0, y0), (x1, y1) in zip(points, points[1:], strict=False):
        if value <= x1:
            return y1 if x1 == x0 else y0 + (y1 - y0) * (value - x0) / (x1 - x0)
    return 1.0


def _same_prefix(a: ColumnStats, b: ColumnStats, rows_a: int, rows_b: int) -> float:
    """Share of the pairs of known values that begin alike, of the prefixes that were kept."""
    known = max(1, rows_a - a.nulls) * max(1, rows_b - b.nulls)
    return sum(n * b.prefixes.get(p, 0) for p, n in a.prefixes.items()) / known


def selectivity(op: Op, a: ColumnStats | None, b: ColumnStats | None, rows_a: int = 0, rows_b: int = 0) -> float:
    """Share of the pairs of rows that satisfy ``a op b``."""
    if a is None or b is None or not a.ndv or not b.ndv:
        return UNKNOWN if a is None or b is None else 0.0
    known = (1 - a.nulls / rows_a if rows_a else 1.0) * (1 - b.nulls / rows_b if rows_b else 1.0)
    equal = _same_prefix(a, b, rows_a, rows_b) / max(1.0, max(a.ndv, b.ndv) / max(len(a.prefixes), len(b.prefixes))) if a.prefixes and b.prefixes and rows_a and rows_b else 1 / max(a.ndv, b.ndv)
    if op is Op.EQ:
        return known * equal
    if op is Op.NE:
        return known * (1 - equal)
    if not a.quantiles or not b.quantiles:
        return known * UNKNOWN
    # a's share below b, averaged over b's quantiles
    below = sum(cdf(a, q) for q in b.quantiles) / len(b.quantiles)
    share = {Op.LT: below - equal, Op.LE: below, Op.GT: 1 - below, Op.GE: 1 - below + equal}[op]
    return known * min(1.0, max(0.0, share))




def dump(stats: TableStats, path: str | Path) -> None:
    """Write as YAML or JSON by the file's ending."""
    kind = Path(path).suffix.lstrip(".").lower()
    plain = json.loads(json.dumps(asdict(stats), default=str))
    if kind in ("yml", "yaml"):
        text = yaml.safe_dump(plain, sort_keys=False)
    elif kind == "json":
        text = json.dumps(plain, indent=1)
    else:
        raise ValueError(f"unknown format {kind}")
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    Path(path).write_text(text)

"""Small helpers that the operators share."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Copies of the small side of a join whose big side may hold one hot key.
SALTS = 16


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once an application, so that they needn't have it installed."""
    app = spark.sparkContext.applicationId
    if app not in _shipped:
        root = Path(__file__).resolve().parent.parent
        path = Path(tempfile.mkdtemp(prefix="plait-")) / "plait_package.zip"
        with zipfile.ZipFile(path, "w") as z:
            for f in sorted(root.rglob("*.py")):
                z.write(f, f.relative_to(root.parent))
        spark.sparkContext.addPyFile(str(path))
        _shipped.add(app)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Read ``name`` with Spark's own reader, so any store that Spark can open will do."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``; only a local session may do without and gets a temporary one."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = tempfile.mkdtemp(prefix="plait-")
        spark.sparkContext._conf.set("spark.checkpoint.dir", found)
        spark.sparkContext.setCheckpointDir(found)
    return found


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back; lineage is cut and survives lost executors."""
    spark = df.sparkSession
    path = new_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_path(spark: SparkSession, path: str) -> None:
    """Remove a table written by ``materialize`` that no later plan reads."""
    jpath = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(jpath, True)


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores before it until no column has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def salt_of(*cols: str) -> Column:
    return F.pmod(F.xxhash64(*cols), F.lit(SALTS)).cast("int")


def salted_left_join(big: DataFrame, small: DataFrame, key: str, spread: str) -> DataFrame:
    """``big`` left join ``small`` on ``key``, where ``small`` has one row a key and ``big`` may have one hot key.

    The rows of ``big`` of one key are dealt over SALTS tasks by a hash of ``spread``;
    ``small`` is repeated once for each.  Null keys of ``big`` match nothing.
    """
    left = big.withColumn("_salt", salt_of(spread))
    right = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return left.join(right, [key, "_salt"], "left").drop("_salt")


def held_out(doc_id: str = "doc_id") -> Column:
    """True for the rows that training never sees: crc32 of the id as text, modulo 4, is 2.  Null ids count as the empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 4 == 2


def runs(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[list[pa.Array]]:
    """Columns of each run of rows with equal first ``keys`` columns (integers without nulls), of batches sorted by them; one run is in memory at a time beside its batch."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        change = np.zeros(b.num_rows, bool)
        for k in range(keys):
            v = b.column(k).to_numpy(zero_copy_only=False)
            change[1:] |= v[1:] != v[:-1]
        cuts = [*np.flatnonzero(change).tolist(), b.num_rows]
        if held and any(held[-1].column(k)[-1].as_py() != b.column(k)[0].as_py() for k in range(keys)):
            yield _columns(held)
            held = []
        at = 0
        for cut in cuts:
            held.append(b.slice(at, cut - at))
            if cut < b.num_rows:
                yield _columns(held)
                held = []
            at = cut
    if held:
        yield _columns(held)


def _columns(held: list[pa.RecordBatch]) -> list[pa.Array]:
    if len(held) == 1:
        return held[0].columns
    return [pa.concat_arrays([h.column(k) for h in held]) for k in range(held[0].num_columns)]

"""Helpers that the operators share: tables in the shared folder, runs of equal keys, components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes up to which a side may be broadcast after it was counted, and of a row without longer columns.
BROADCAST_BYTES, ROW_BYTES = 24_000_000, 24
#: Rows and bytes of an Arrow batch between the JVM and Python, where the session allows more.
BATCH_ROWS, BATCH_BYTES = 2_000, 8 << 20


def shared_folder(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names; where it is unset and Spark runs on this machine alone, one of our own."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.conf.get("spark.master", "").startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="quire-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def bound_batches(spark: SparkSession) -> None:
    """Lowers the session's Arrow batches to BATCH_ROWS and BATCH_BYTES, so whole texts don't pile up in a task."""
    for name, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        now = spark.conf.get(name, str(most + 1)).lower().removesuffix("b")
        if not (now.isdigit() and 0 < int(now) <= most):
            spark.conf.set(name, str(most))


class Tables:
    """Intermediate tables of one operator call, written below the shared folder.

    Writing and rereading cuts the lineage, so a lost executor costs a reread only.
    """

    def __init__(self, spark: SparkSession):
        bound_batches(spark)
        self.spark, self.root, self.paths = spark, f"{shared_folder(spark)}/quire-{uuid.uuid4().hex}", []

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{len(self.paths)}-{name}"
        df.write.option("compression", "zstd").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.spark._jvm.System.gc()  # lets Spark's cleaner drop the shuffle files of what is now written
        self.paths.append((out, path))
        return out

    def drop(self, *tables: DataFrame) -> None:
        for name in (path for t, path in self.paths if any(t is x for x in tables)):
            path = self.spark._jvm.org.apache.hadoop.fs.Path(name)
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def broadcast_if_small(df: DataFrame, row_bytes: int = ROW_BYTES) -> DataFrame:
    """``df`` with a broadcast hint when its rows, of ``row_bytes`` at most, fit in BROADCAST_BYTES; else as it is, for a shuffled join."""
    limit = BROADCAST_BYTES // row_bytes
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Runs of rows with equal (non-null, integer or string) keys, from batches sorted by the keys."""
    rest: pa.Table | None = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        table = table if rest is None else pa.concat_tables([rest, table]).combine_chunks()
        if not table.num_rows:
            continue
        new = np.zeros(table.num_rows, bool)
        for k in keys:
            v = table[k].to_numpy(zero_copy_only=False)
            new[1:] |= v[1:] != v[:-1]
        cuts = [0, *np.flatnonzero(new).tolist()]
        for a, b in zip(cuts, cuts[1:]):
            yield table.slice(a, b - a)
        rest = table.slice(cuts[-1])
    if rest is not None and rest.num_rows:
        yield rest


def components(edges: DataFrame, tables: Tables, a: str = "a", b: str = "b") -> DataFrame:
    """(id, component) of every node of undirected ``edges``: the smallest id it reaches.

    Alternating large-star and small-star rounds until the edges are stars around their
    smallest nodes.  Minima are aggregated before the shuffle, and the joins back on a hot
    hub are ones that adaptive execution splits.  Null ends are ignored.
    """
    e = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u is not null and v is not null and u <> v").distinct()
    now, state = tables.keep(e, "edges"), None
    while True:
        both = now.union(now.select("v", "u"))
        least = both.groupBy("u").agg(F.min(F.least("u", "v")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = tables.keep(large, "edges")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = tables.keep(small.union(least.select("u", "m")).distinct(), "edges")
        tables.drop(now, large)
        now = small
        then, state = state, now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == then:
            return now.select(F.col("u").alias("id"), F.col("v").alias("component")).union(now.select("v", "v").distinct())

"""Helpers shared by the training-data operators: settled tables, Arrow batches and components of link graphs."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

U64 = np.uint64
MASK = (1 << 64) - 1


_own_dirs: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, spark.checkpoint.dir. In local mode one is made where it is unset; on a cluster that is an error."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        app = spark.sparkContext.applicationId
        where = _own_dirs.get(app) or tempfile.mkdtemp(prefix="spark-settled-")
        _own_dirs[app] = where
    return where.rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; what is written there goes when the application ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = at.getFileSystem(spark._jsc.hadoopConfiguration())
    files.mkdirs(at.getParent())
    files.deleteOnExit(at)
    return path


def settle(df: DataFrame) -> DataFrame:
    """Write a table to the shared folder and read it back, so that later failures don't recompute what led to it.

    Shuffle files of what led to it are of no more use; Spark deletes those of plans that its driver's collector has
    found unused, so the collector is asked to run.
    """
    spark = df.sparkSession
    path = shared_path(spark, "settled")
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.settled_at = path
    del df
    gc.collect()
    spark._jvm.System.gc()
    return out


def forget(*tables: DataFrame) -> None:
    """Delete settled tables that nothing reads any more."""
    for t in tables:
        spark, path = t.sparkSession, t.settled_at
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def drawn(rows: DataFrame, most: int, *key: Column, n: int | None = None) -> DataFrame:
    """A sample of the rows, those whose key hash h lies below a threshold set from their number; rows of equal key count once.

    No row is ranked against others, so a task passes on only its own share of the sample, whatever the size of the
    table. `most` is the expected size if all keys differ; the real one is binomial about it, and less if keys repeat.
    """
    n = rows.count() if n is None else n
    hashed = rows.withColumn("h", F.xxhash64(*key))
    return hashed.filter(hash_share("h") < most / max(n, 1)).dropDuplicates(["h"])


def hash_share(h: str) -> Column:
    """A signed 64-bit hash as a number from 0 to 1."""
    return F.shiftrightunsigned(h, 12).cast("double") / F.lit(float(1 << 52))


def fresh(name: str, *tables: DataFrame) -> str:
    """The name, or the name with underscores after it, that is no column of the tables in any case of letters."""
    taken = {c.lower() for t in tables for c in t.columns}
    while name.lower() in taken:
        name += "_"
    return name


def shuffle_count(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def map_rows(df: DataFrame, fn: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]], schema: str | T.StructType) -> DataFrame:
    """mapInArrow for a function of one batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield from fn(batch)

    return df.mapInArrow(run, schema)


def pieces(batch: pa.RecordBatch, column: str, most: int) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about `most` bytes in `column`, one row at least; no row is cut."""
    size = np.cumsum(byte_lengths(batch.column(column)))
    at = 0
    while at < batch.num_rows:
        base = size[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(size, base + most, side="right")))
        yield batch.slice(at, to - at)
        at = to


def byte_lengths(column: pa.Array) -> np.ndarray:
    import pyarrow.compute as pc

    return pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def texts(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of each row; null counts as empty."""
    return [b"" if x is None else x for x in column.cast(pa.binary()).to_pylist()]


def record(schema: list[tuple[str, pa.DataType]], *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, type=t) if not isinstance(c, pa.Array) else c for (_, t), c in zip(schema, columns, strict=True)], names=[n for n, _ in schema])


# --- hashes -------------------------------------------------------------------------------------------------------

#: The primes of XXH64.
XP1, XP2, XP3, XP4, XP5 = 0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5


def mix(x: np.ndarray) -> np.ndarray:
    """XXH64 of 64-bit values with seed 42: what Spark's xxhash64() gives for a bigint."""
    with np.errstate(over="ignore"):
        k = x.astype(U64) * U64(XP2)
        k = ((k << U64(31)) | (k >> U64(33))) * U64(XP1)
        h = U64((42 + XP5 + 8) & MASK) ^ k
        h = ((h << U64(27)) | (h >> U64(37))) * U64(XP1) + U64(XP4)
        h = (h ^ (h >> U64(33))) * U64(XP2)
        h = (h ^ (h >> U64(29))) * U64(XP3)
        return h ^ (h >> U64(32))


# --- connected components -----------------------------------------------------------------------------------------


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Star edges (node, root) with the same components as the edges (a, b); the root has the least signed hash."""
    if not len(a):
        return a, b
    nodes, inverse = np.unique(np.concatenate([a, b]), return_inverse=True)
    order = np.argsort(mix(nodes.astype(np.int64).view(U64)).view(np.int64), kind="stable")
    rank = np.empty(len(nodes), np.int64)
    rank[order] = np.arange(len(nodes))
    u, v = rank[inverse[: len(a)]], rank[inverse[len(a) :]]
    label = np.arange(len(nodes))
    while True:
        lu, lv = label[u], label[v]
        open_ = lu != lv
        if not open_.any():
            break
        u, v, lu, lv = u[open_], v[open_], lu[open_], lv[open_]
        np.minimum.at(label, np.maximum(lu, lv), np.minimum(lu, lv))
        while not np.array_equal(label, up := label[label]):
            label = up
    moved = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[order[moved]], nodes[order[label[moved]]]


EDGE = [("a", pa.int64()), ("b", pa.int64())]


def _local_forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    a, b, held = [], [], 0
    for batch in batches:
        a.append(batch.column(0).to_numpy())
        b.append(batch.column(1).to_numpy())
        held += batch.num_rows
        if held > 2_000_000:  # keeps memory bounded: what is left open meets again in the next round
            x, y = forest(np.concatenate(a), np.concatenate(b))
            a, b, held = [x], [y], len(x)
            if held > 1_000_000:
                yield record(EDGE, x, y)
                a, b, held = [], [], 0
    if held:
        yield record(EDGE, *forest(np.concatenate(a), np.concatenate(b)))


def components(edges: DataFrame) -> DataFrame:
    """Connected components by rounds of contraction.

    edges: long columns a, b; loops, repeats and either direction are fine, rows with a null are left out. Returns (node, root) for every node that has
    an edge to another node; root is some node of the component, the same for all of it. In each round every node
    joins the neighbour of least hash, and edges between the joined groups go on; the expected number of rounds is
    logarithmic. Nothing is collected: the driver only learns whether edges are left.
    """
    rank = lambda c: F.xxhash64(c)
    left = settle(edges.filter("a <> b").select("a", "b").mapInArrow(_local_forest, "a long, b long"))
    rounds: list[DataFrame] = []
    while not left.isEmpty():
        both = left.select("a", "b").union(left.select("b", "a"))
        best = both.groupBy("a").agg(F.min(F.struct(rank(F.col("b")).alias("h"), F.col("b").alias("b"))).alias("m"))
        up = settle(best.select(F.col("a").alias("node"), F.when(F.col("m.h") < rank(F.col("a")), F.col("m.b")).otherwise(F.col("a")).alias("up")))
        rounds.append(up)
        pa_, pb_ = up.select(F.col("node").alias("a"), F.col("up").alias("x")), up.select(F.col("node").alias("b"), F.col("up").alias("y"))
        on = left.join(pa_, "a").join(pb_, "b").filter("x <> y")
        on = on.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
        before, left = left, settle(on.mapInArrow(_local_forest, "a long, b long"))
        forget(before)
    forget(left)
    if not rounds:
        return edges.sparkSession.createDataFrame([], "node long, root long")
    found = rounds[-1].select("node", F.col("up").alias("root"))
    last = rounds[-1]
    for up in reversed(rounds[:-1]):
        later = found.select(F.col("node").alias("up"), "root")
        found = settle(up.join(later, "up", "left").select("node", F.coalesce("root", "up").alias("root")))
        forget(up, last)
        last = found
    return found

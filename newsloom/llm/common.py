"""What the operators of this subpackage share: the shared folder, batches, connected components."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Characters of text that a Python task works on at once; a longer single text makes a batch of its own.
BATCH_CHARS = 4 << 20


def work_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a folder of its own where that is unset."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if spark.sparkContext.master.startswith("local["):
        found = "file://" + tempfile.mkdtemp(prefix="newsloom-")
    else:
        found = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/newsloom-work"
    spark.conf.set("spark.checkpoint.dir", found)
    return found


def cut(df: DataFrame, tag: str) -> DataFrame:
    """Write a result to the shared folder and read it again, so that lost executors never recompute what lies before."""
    spark = df.sparkSession
    path = f"{work_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._newsloom_path = path
    if _OPEN:
        _OPEN[-1].append(out)
    return out


#: Tables that cut() wrote within each scratch() that is open.
_OPEN: list[list[DataFrame]] = []


@contextmanager
def scratch() -> Iterator[list[DataFrame]]:
    """Tables that cut() writes within are deleted at the end, but for those added to the list given, which what encloses it then owns."""
    kept: list[DataFrame] = []
    _OPEN.append([])
    try:
        yield kept
    finally:
        made = _OPEN.pop()
        names = {getattr(k, "_newsloom_path", None) for k in kept}
        release(*[t for t in made if t._newsloom_path not in names])
        if _OPEN:
            _OPEN[-1].extend(t for t in made if t._newsloom_path in names)


def release(*frames: DataFrame) -> None:
    """Delete tables that cut() wrote and nobody reads any more."""
    for df in frames:
        if path := getattr(df, "_newsloom_path", None):
            jvm = df.sparkSession.sparkContext._jvm
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def free_name(wanted: str, taken: list[str]) -> str:
    """A column name that differs, in any case, from those taken."""
    low = {x.lower() for x in taken}
    while wanted.lower() in low:
        wanted = "_" + wanted
    return wanted


def as_bytes(column: pa.Array) -> list[bytes | None]:
    return column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()


def slices(batch: pa.RecordBatch, name: str, most: int = BATCH_CHARS) -> Iterator[pa.RecordBatch]:
    """The rows of a batch in order, cut where the texts of a part pass the limit; no row is split."""
    n = batch.num_rows
    if not n:
        return
    size = pc.binary_length(batch.column(name)).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.cumsum(size)
    start, base = 0, 0
    while start < n:
        stop = max(start + 1, int(np.searchsorted(ends, base + most, side="right")))
        yield batch.slice(start, stop - start)
        base, start = int(ends[stop - 1]), stop


def over_texts(df: DataFrame, text: str, fn: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: T.StructType | str) -> DataFrame:
    """mapInArrow with batches cut by text size; fn may give None for no rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text):
                if (out := fn(part)) is not None and out.num_rows:
                    yield out

    return df.mapInArrow(run, schema)


def append(df: DataFrame, text: str, fn: Callable[[list[bytes | None]], list[pa.Array]], fields: list[T.StructField]) -> DataFrame:
    """All columns of df and those that fn makes from the texts. Names of fields must be free."""
    names = df.columns + [f.name for f in fields]
    at = df.columns.index(text)

    def work(part: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([*part.columns, *fn(as_bytes(part.column(at)))], names)

    return over_texts(df, text, work, T.StructType([*df.schema.fields, *fields]))


class Words(dict):
    """word -> number, from a function that is called for words not seen yet; it stops keeping them at a size."""

    def __init__(self, fn, most: int):
        super().__init__()
        self.fn, self.most = fn, most

    def __missing__(self, key):
        value = self.fn(key)
        if len(self) < self.most:
            self[key] = value
        return value


_KEPT: dict = {}


def per_worker(key, make):
    """A value that a Python worker builds once and uses in all its tasks; only the newest few of one kind are kept.

    A worker that goes over to another kind of work (the first part of the key) first gives up what it kept for the one before, as
    workers outlive stages and their memory adds up.
    """
    if key not in _KEPT:
        kind = lambda k: k if isinstance(k, str) else k[0]
        if any(kind(k) != kind(key) for k in _KEPT):
            _KEPT.clear()
            gc.collect()
            pa.default_memory_pool().release_unused()
        elif len(_KEPT) >= 4:
            _KEPT.pop(next(iter(_KEPT)))
        _KEPT[key] = make()
    return _KEPT[key]


def components(edges: DataFrame) -> DataFrame:
    """Connected components. edges: a, b. Gives node, component (the smallest node reachable) for each node that has an edge.

    Labels are pointers to smaller nodes; in each round a node and its parent take the smallest
    grandparent of the node's neighbours, then pointers are halved, so chains take logarithmically
    many rounds. Each round is written to the shared folder. No rows: no rows. Nulls and loops are ignored.
    """
    both = edges.where("a is not null and b is not null and a <> b")
    link = cut(both.select("a", "b").union(both.select(F.col("b"), F.col("a"))).distinct(), "links")
    now = cut(link.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("near")).select("node", F.least("node", "near").alias("up")), "labels")
    while True:
        up = now.select(F.col("node").alias("parent"), F.col("up").alias("top"))
        full = now.join(up, now["up"] == up["parent"]).select("node", "up", "top")
        near = link.join(full.select(F.col("node").alias("b"), "top"), "b").groupBy(F.col("a").alias("node")).agg(F.min("top").alias("best"))
        seen = full.join(near, "node")
        told = seen.select(
            F.explode(
                F.array(
                    F.struct("node", F.least("up", "top", "best").alias("up"), F.col("up").alias("old")),
                    F.struct(F.col("up").alias("node"), F.col("best").alias("up"), F.lit(None).cast("bigint").alias("old")),
                )
            ).alias("x")
        )
        after = cut(told.select("x.*").groupBy("node").agg(F.min("up").alias("up"), F.max("old").alias("old")), "labels")
        changed = after.where("up <> old").limit(1).count()
        release(now)
        now = after
        if not changed:
            release(link)
            out = now.select("node", F.col("up").alias("component"))
            out._newsloom_path = now._newsloom_path
            return out

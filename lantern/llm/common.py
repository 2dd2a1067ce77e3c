"""Plumbing that the corpus operators share: tables, the shared folder, files and links."""

from __future__ import annotations

import gc
import os
import tempfile
import uuid
import weakref
from collections.abc import Callable, Iterator
from pathlib import PurePosixPath
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows handed to Python at once; texts can be long, so far fewer than Spark's 10,000.
ARROW_ROWS = 512


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str) -> str:
    """A vocabulary file: in the folder that LANTERN_TOKENIZERS names, or else where public_tokenizers has it."""
    if folder := os.environ.get("LANTERN_TOKENIZERS"):
        return os.path.join(folder, name)
    import public_tokenizers

    return str(public_tokenizers.path(name))


def free_names(df: DataFrame, *names: str) -> list[str]:
    """The names, each with underscores before it until no column of df has it, in any case."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        out.append(name)
        taken.add(name.lower())
    return out


def small_batches(spark: SparkSession) -> None:
    """Bound what one Arrow batch holds: rows here, and bytes where Spark knows the setting."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > ARROW_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir; where that is unset, one of this machine if Spark runs on it alone."""
    set_to = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not set_to:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        set_to = f"file://{tempfile.mkdtemp(prefix='lantern-')}"
        spark.conf.set("spark.checkpoint.dir", set_to)
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(set_to)
    return set_to


def fresh_dir(spark: SparkSession, what: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{what}-{uuid.uuid4().hex}"


def checkpoint(df: DataFrame) -> DataFrame:
    """A reliable checkpoint: its files outlive executors, and lineage ends here."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def release(spark: SparkSession) -> None:
    """Lets Spark's cleaner remove shuffle files of finished jobs now: executors keep them until the driver's JVM
    collects the plans that made them, which a driver with little to do may not do for half an hour."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def written(df: DataFrame, what: str) -> DataFrame:
    """The rows written as Parquet to the shared folder and read again: cuts lineage, keeps sizes and column pruning.

    Nothing read from the result needs the shuffles behind df again, so they are released."""
    spark = df.sparkSession
    path = fresh_dir(spark, what)
    df.write.parquet(path)
    release(spark)
    out = spark.read.schema(df.schema).parquet(path)
    _folders[id(out)] = (weakref.ref(out), path)
    return out


_folders: dict[int, tuple] = {}


def discard(df: DataFrame) -> None:
    """Removes the folder of a result of written() that nothing will read again; other tables are left alone."""
    seen, path = _folders.pop(id(df), (lambda: None, None))
    if seen() is df:
        at = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(at, True)


_remembered: dict[str, Callable[[], object]] = {}


def caches_of(operator: str, clear: Callable[[], object] | None = None) -> None:
    """Empties what other operators' tasks have left in the caches of this worker process; clear empties the caller's own.

    Workers live on from task to task, so a pipeline would else hold the caches of all its stages at once.
    """
    others = [k for k in _remembered if k != operator]
    for k in others:
        _remembered.pop(k)()
    if clear:
        if _remembered.get(operator, clear) != clear:
            _remembered[operator]()
        _remembered[operator] = clear
    if others:
        gc.collect()
        pa.default_memory_pool().release_unused()


class Files:
    """Reads and writes whole files below a URI: file: by the operating system, any other scheme by pyarrow.fs."""

    def __init__(self, root: str):
        self.root = root
        parsed = urlparse(root)
        if parsed.scheme in ("", "file"):
            self.fs, self.base = None, parsed.path if parsed.scheme else root
        else:
            from pyarrow import fs

            self.fs, self.base = fs.FileSystem.from_uri(root)

    def path(self, name: str) -> str:
        return str(PurePosixPath(self.base) / name)

    def create(self, name: str):
        """An output stream; what it writes shows under the name only once it is published."""
        if self.fs is None:
            os.makedirs(self.base, exist_ok=True)
            return open(self.path(f".{name}.part"), "wb")
        self.fs.create_dir(self.base, recursive=True)
        return self.fs.open_output_stream(self.path(f".{name}.part"))

    def publish(self, name: str) -> None:
        if self.fs is None:
            os.replace(self.path(f".{name}.part"), self.path(name))
        else:
            self.fs.move(self.path(f".{name}.part"), self.path(name))

    def open(self, name: str):
        return open(self.path(name), "rb") if self.fs is None else self.fs.open_input_file(self.path(name))

    def delete(self, name: str) -> None:
        os.remove(self.path(name)) if self.fs is None else self.fs.delete_file(self.path(name))

    def list(self) -> list[tuple[str, int]]:
        """Names and sizes of the published files."""
        if self.fs is None:
            found = [(x.name, x.stat().st_size) for x in os.scandir(self.base)] if os.path.isdir(self.base) else []
        else:
            from pyarrow import fs

            found = [(x.base_name, x.size) for x in self.fs.get_file_info(fs.FileSelector(self.base, allow_not_found=True)) if x.is_file]
        return sorted(x for x in found if not x[0].startswith("."))


def running_totals(df: DataFrame, keys: list[str], bucket: str, order: list[Column], weight: Column, out: str, total_out: str | None = None) -> DataFrame:
    """Adds the running sum of weight before each row, within keys, ordered by bucket and then by order.

    No task holds a whole key: buckets are summed first, their offsets come from a window over bucket
    sums, and rows are only ordered inside one bucket. bucket must be a column that spreads a key evenly.
    """
    from pyspark.sql import Window as W

    w = df.withColumn("_w", weight.cast("long"))
    sums = w.groupBy(*keys, bucket).agg(F.sum("_w").alias("_bucket_sum"))
    over = W.partitionBy(*keys).orderBy(bucket)
    sums = sums.withColumn("_offset", F.sum("_bucket_sum").over(over) - F.col("_bucket_sum"))
    if total_out:
        sums = sums.withColumn(total_out, F.sum("_bucket_sum").over(W.partitionBy(*keys)))
    on = [w[k].eqNullSafe(sums[k]) for k in [*keys, bucket]]
    inside = W.partitionBy(*[w[k] for k in [*keys, bucket]]).orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
    joined = w.withColumn("_before", F.sum("_w").over(inside) - F.col("_w")).alias("w").join(sums, on, "left")
    kept = [F.col(f"w.{c}") for c in df.columns]
    return joined.select(*kept, (F.col("_before") + F.col("_offset")).alias(out), *([F.col(total_out)] if total_out else []))


#: Edges of a graph that one task takes (16 bytes each).
TASK_EDGES = 1 << 20


def _in_one_task(edges: DataFrame) -> DataFrame:
    """id, component_id of a graph of TASK_EDGES edges (a, b) at most: roots by pointer jumping, the smallest id a root."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [[c.to_numpy() for c in b.columns] for b in batches]
        if not held:
            return
        ids, place = np.unique(np.concatenate([x[k] for k in (0, 1) for x in held]), return_inverse=True)
        u, v = np.split(place, 2)
        root = np.arange(len(ids))
        while True:
            x, y = root[u], root[v]
            open_ = x != y
            if not open_.any():
                break
            u, v, x, y = u[open_], v[open_], x[open_], y[open_]
            np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
            while (root != root[root]).any():
                root = root[root]
        for i in range(0, len(ids), 65_536):
            yield pa.RecordBatch.from_arrays([pa.array(ids[i : i + 65_536]), pa.array(ids[root[i : i + 65_536]])], names=["id", "component_id"])

    return edges.coalesce(1).mapInArrow(run, "id long, component_id long")


def components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 64, task_edges: int = TASK_EDGES) -> DataFrame:
    """Connected components of a graph: (id, component_id) for each id in an edge; component_id is the smallest id.

    While there are more than task_edges edges, random-mate contraction: in every round each node joins the neighbour with
    the least salted hash, edges are renamed to the chosen nodes and loops dropped, so that the edges left shrink by a
    constant factor. What is left, as counted, is settled in one task. Only mappings are joined back, and nothing
    goes to the driver. Null ends are ignored; an empty table of edges gives an empty result.
    """
    e = written(edges.select(F.col(a).cast("long").alias("a"), F.col(b).cast("long").alias("b")).filter("a <> b").distinct(), "edges")
    label = None
    for k in range(max_rounds):
        if e.count() <= task_edges:
            break
        both = e.select("a", "b").union(e.select(F.col("b"), F.col("a")))
        salted = lambda c: F.struct(F.xxhash64(F.lit(k), c).alias("h"), c.alias("v"))  # noqa: E731, B023
        step = both.groupBy("a").agg(F.min(salted(F.col("b"))).alias("m")).select("a", F.least(F.col("m"), salted(F.col("a")))["v"].alias("to"))
        step = written(step, "mates")
        to_a, to_b = step.select("a", F.col("to").alias("na")), step.select(F.col("a").alias("b"), F.col("to").alias("nb"))
        old, e = e, e.join(to_a, "a").join(to_b, "b").select(F.col("na").alias("a"), F.col("nb").alias("b")).filter("a <> b")
        e = written(e.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
        if label is None:
            label = written(step.select(F.col("a").alias("id"), F.col("to").alias("label")), "labels")
        else:
            was, label = label, written(label.join(step.select(F.col("a").alias("label"), "to"), "label", "left").select("id", F.coalesce("to", "label").alias("label")), "labels")
            discard(was)
        discard(old)
        discard(step)
    else:
        raise RuntimeError("the components did not settle")
    part = _in_one_task(e)
    if label is None:
        return part
    label = label.join(part.withColumnRenamed("id", "label"), "label", "left").select("id", F.coalesce("component_id", "label").alias("label"))
    least = label.groupBy("label").agg(F.min("id").alias("component_id"))
    return label.join(least, "label").select("id", "component_id")

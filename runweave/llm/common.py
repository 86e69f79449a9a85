"""Shared folder, table access and connected components for the llm operators."""

from __future__ import annotations

import atexit
import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

_LOCAL_DIR: list[str] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """Folder that every executor sees: spark.checkpoint.dir of the session.

    Only a session on a local master may go without the setting (tests); it then
    gets one temporary folder of its own.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
    if not _LOCAL_DIR:
        tmp = tempfile.TemporaryDirectory(prefix="runweave-")
        atexit.register(tmp.cleanup)
        _LOCAL_DIR.append(tmp.name)
    return _LOCAL_DIR[0]


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: cuts lineage, survives lost executors.

    Each call writes a folder of its own; the folder of a finished application
    can be deleted as a whole.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete the files of a materialised table that nothing reads any more."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def release() -> None:
    """Give unused memory of this worker back: workers are kept between tasks, and what they hold adds up."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def tidy(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """A mapInArrow function that releases its memory when the task's rows are through."""

    def wrapped(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            release()

    return wrapped


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, each lengthened until no column of df has it."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


HOT_KEYS, HOT_ROWS = 65_536, 1024


def join_spread(rows: DataFrame, one: DataFrame, on: str, count: str, total: int, by: str) -> DataFrame:
    """rows joined with one, which has a row a key and in `count` how many of rows have it; no task gets a hot key whole.

    Keys of more than max(HOT_ROWS, total / HOT_KEYS) rows are salted by the hash of `by`, total
    being the sum of the counts. There are at most HOT_KEYS of them, so their list can be
    broadcast whatever the size of the tables.
    """
    share = max(HOT_ROWS, -(-total // HOT_KEYS))
    hot = one.where(F.col(count) > share).select(F.col(on).alias("__k"), F.ceil(F.col(count) / share).cast("int").alias("__m"))
    salted = rows.join(F.broadcast(hot), F.col(on) == F.col("__k"), "left")
    salted = salted.withColumn("__salt", F.pmod(F.xxhash64(by), F.coalesce("__m", F.lit(1))).cast("int")).drop("__k", "__m")
    parts = F.when(F.col(count) > share, F.ceil(F.col(count) / share).cast("int")).otherwise(1)
    return salted.join(one.withColumn("__salt", F.explode(F.sequence(F.lit(0), parts - 1))), [on, "__salt"]).drop("__salt")


def sweep(df: DataFrame, order: list[str], last: dict[str, Column] | None = None, total: dict[str, Column] | None = None) -> DataFrame:
    """df swept in the given order (nulls first): for each name of `last` the expression's latest value that is not null, for each of `total` its sum, over all rows up to this one.

    Rows are dealt over ranges of the order and the ranges written; each range is swept by
    itself and what the ranges before hand on, one row a range, is added. So neither a hot
    key nor the whole table comes to one task, if `order` tells rows well enough apart.
    """
    last, total = last or {}, total or {}
    reads = df.withColumns({f"__in_{k}": c for k, c in {**last, **total}.items()})
    ranged = materialize(reads.repartitionByRange(*order).withColumn("__range", F.spark_partition_id()), "ranges")
    inside = W.partitionBy("__range").orderBy(*[F.col(c).asc_nulls_first() for c in order]).rowsBetween(W.unboundedPreceding, W.currentRow)
    place = F.struct(*[F.struct(F.col(c).isNotNull(), F.col(c)) for c in order])
    ends = ranged.groupBy("__range").agg(*[F.max_by(f"__in_{k}", F.when(F.col(f"__in_{k}").isNotNull(), place)).alias(f"__to_{k}") for k in last], *[F.sum(f"__in_{k}").alias(f"__to_{k}") for k in total])
    before = W.orderBy("__range").rowsBetween(W.unboundedPreceding, -1)
    carried = ends.select("__range", *[F.last(f"__to_{k}", True).over(before).alias(f"__to_{k}") for k in last], *[F.sum(f"__to_{k}").over(before).alias(f"__to_{k}") for k in total])
    out = ranged.withColumns({**{k: F.last(f"__in_{k}", True).over(inside) for k in last}, **{k: F.sum(f"__in_{k}").over(inside) for k in total}})
    out = out.join(F.broadcast(carried), "__range")  # a row a shuffle partition
    added = {**{k: F.coalesce(F.col(k), F.col(f"__to_{k}")) for k in last}, **{k: F.coalesce(F.col(k), F.lit(0)) + F.coalesce(F.col(f"__to_{k}"), F.lit(0)) for k in total}}
    return out.withColumns(added).select(*df.columns, *last, *total)


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, component_id): the smallest id reachable over undirected edges.

    Alternating large-star and small-star rounds (Kiveris et al. 2014): only minima
    per node are aggregated and joined, so a hub's neighbours are never gathered, and
    each round's edge list, no longer than the first, goes to the shared folder.
    """
    e = edges.select(F.col(a).cast("long").alias("u"), F.col(b).cast("long").alias("v")).where("u <> v")
    e = materialize(e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    seen, rows = None, e.count()
    while True:
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("c")).select("u", F.least("u", "m").alias("m"), "c")
        large = join_spread(both.where("v > u"), low, "u", "c", 2 * rows, "v").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("c"))
        small = (
            join_spread(large, least, "u", "c", rows, "v").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .union(least.select("u", F.col("m").alias("v")))
            .where("u <> v")
            .distinct()
        )
        nxt = materialize(small, "edges")
        state = nxt.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        discard(e)
        e = nxt
        if tuple(state) == seen:
            break
        seen, rows = tuple(state), state[0]
    roots = e.select(F.col("v").alias("u"), "v").distinct()
    return e.union(roots).groupBy(F.col("u").alias("id")).agg(F.min("v").alias("component_id"))

"""Helpers that the operators of this subpackage share: table access, shared storage, gapless ranks, connected components."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
import weakref
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or a folder of our own where it is unset, which only local mode allows."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("Set spark.checkpoint.dir to a folder that the driver and all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="vellum-checkpoint-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where


#: Where materialized tables lie, so that one which a later table replaces can be deleted.
PLACES: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


def materialize(df: DataFrame, replaces: tuple[DataFrame, ...] = ()) -> DataFrame:
    """Cuts lineage: writes df as Parquet in the shared folder and reads it again, so a lost executor costs no recomputation.

    `replaces`: materialized tables that nothing but df is made from any more; they are deleted once df is written.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/vellum-{uuid.uuid4().hex}"
    df.write.parquet(path)
    for old in filter(None, (PLACES.pop(t, None) for t in replaces)):
        place = spark._jvm.org.apache.hadoop.fs.Path(old)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
    made = spark.read.schema(df.schema).parquet(path)
    PLACES[made] = path
    return made


#: Rows of a batch that goes to a Python worker: texts are long, and a batch lies in the executor and in the worker at once.
ARROW_ROWS = 2048


def small_batches(spark: SparkSession) -> None:
    """Bounds the rows of Arrow batches in this session, unless it has a lower bound already."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name, "10000")) <= ARROW_ROWS:
        spark.conf.set(name, str(ARROW_ROWS))


def give_back() -> None:
    """Returns to the system what this process's allocators hold and don't use."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def in_slices(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """Batches cut to few rows, so that a worker holds few texts as Python objects at a time; what a batch took is given back after it, as
    workers are kept between tasks."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
        del batch
        give_back()


#: Rows of a table of few narrow columns that may be broadcast, some 30 MB in memory.
BROADCAST_ROWS = 200_000


def sized(df: DataFrame) -> DataFrame:
    """A materialized table of narrow rows, marked for broadcast if its counted rows are few enough; else joins shuffle it."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


#: A key with more rows than this, or than the HOT_KEYS-th part of all, is dealt to several tasks.
HOT_ROWS, HOT_KEYS = 1024, 100_000


def hot_join(left: DataFrame, right: DataFrame, key: str, count: str, total: int) -> DataFrame:
    """The inner join on `key`, right having one row a key and in `count` the number of left's rows with it; total: left's rows.

    Keys with many rows are salted: their rows are dealt by a hash of all columns, and right's row is repeated for each salt. At most
    HOT_KEYS keys can be so hot, so the list of them is broadcast.
    """
    limit = max(HOT_ROWS, total // HOT_KEYS)
    parts = F.ceil(F.col(count) / limit).cast("int")
    hot = right.where(F.col(count) > limit).select(F.col(key).alias("__hot"), parts.alias("__parts"))
    dealt = left.join(F.broadcast(hot), F.col(key) == F.col("__hot"), "left")
    dealt = dealt.withColumn("__salt", F.when(F.col("__parts").isNull(), 0).otherwise(F.pmod(F.xxhash64(*left.columns), F.col("__parts"))).cast("int"))
    again = right.withColumn("__salt", F.explode(F.when(F.col(count) > limit, F.sequence(F.lit(0), parts - 1)).otherwise(F.array(F.lit(0)))))
    return dealt.drop("__hot", "__parts").join(again, [key, "__salt"]).drop("__salt")


def gapless_rank(df: DataFrame, keys: list[str], spread: Column, order: list[Column], name: str, spreads: int = 64, bounded: bool = False) -> DataFrame:
    """Adds `name`, numbers from 0 without gaps inside each combination of keys.

    A key's rows are dealt to `spreads` groups by `spread` (an expression that tells rows apart, such as a hash of the id) and numbered
    in each, so a key with a third of all rows isn't sorted by one task; each group's start is the sum of the counts before it, over a
    table of at most keys x spreads rows (bounded: the number of keys has a proven bound, so that table is broadcast). df is read twice: pass
    a materialized one. `order` must be a total order for stable numbers.
    """
    bucket, start, own = "__bucket", "__start", "__own"
    dealt = df.withColumn(bucket, F.pmod(F.xxhash64(spread, F.lit(name)), F.lit(spreads)).cast("int"))
    counts = dealt.groupBy(*keys, bucket).agg(F.count(F.lit(1)).alias("__n"))
    starts = counts.select(*keys, bucket, (F.sum("__n").over(Window.partitionBy(*keys).orderBy(bucket)) - F.col("__n")).alias(start))
    starts = F.broadcast(starts) if bounded else starts
    numbered = dealt.withColumn(own, F.row_number().over(Window.partitionBy(*keys, bucket).orderBy(*order)) - 1)
    on = reduce(lambda a, b: a & b, [F.col(f"n.{k}").eqNullSafe(F.col(f"s.{k}")) for k in [*keys, bucket]])
    return (
        numbered.alias("n").join(starts.alias("s"), on)
        .select(*[F.col(f"n.{c}") for c in df.columns], (F.col(f"n.{own}") + F.col(f"s.{start}")).cast("long").alias(name))
    )


def components(edges: DataFrame) -> DataFrame:
    """Connected components of edges(a long, b long): (node, root), root being the smallest node reachable. Nodes without an edge are absent.

    Loops and repeated edges change nothing; an edge with a null end is left out; an empty table gives none. Alternates the large-star and
    small-star steps. Each step is a map-side combined minimum and a join that deals a hub's edges to many tasks; nothing reaches the
    driver but counts and one checksum a round. Rounds are about the logarithm of the longest path, and each replaces the one before.
    """
    e = edges.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    e, before = materialize(e), None
    while True:
        now = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(now) == before:
            return e.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("root"))
        before = tuple(now)
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count(F.lit(1)).alias("n"))
        large = hot_join(both, least, "u", "n", 2 * now[0]).where(F.col("v") > F.col("u")).where(F.col("v") != F.col("m"))
        large = materialize(large.select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), replaces=(e,))
        low = large.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n"))
        small = hot_join(large, low, "u", "n", large.count()).where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = materialize(small.union(low.select("u", F.col("m").alias("v"))).distinct(), replaces=(large,))

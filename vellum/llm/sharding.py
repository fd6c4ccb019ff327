"""Sharding by vector bin packing: bytes, tokens and rows are balanced jointly.

Rows of equal text form a group and stay together. Groups that weigh much are packed one by one; the others are gathered in cells by a hash
of their text, so the driver plans over a number of vectors that depends on the number of shards alone. From the heaviest down, each vector
goes to the shard where its dot product with what is left of the shard's capacity is highest. A group of more bytes, tokens or rows than a
shard can hold is the one kind that is split, into parts by a hash of the id.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.llm.common import gapless_rank, materialize, table

SHARDS = 24
#: Cells a shard; a group with more than a CELLS-th of a shard's capacity in any dimension is a vector of its own.
CELLS = 512
#: Parts of a group too large for a shard hold about so much of a shard's capacity in the dimension the group takes most of.
PART = 1 / 16
#: Bytes that a row takes besides its text.
OVERHEAD = 8


def pack_vectors(weights: np.ndarray, shards: int) -> np.ndarray:
    """The shard of each row of weights (items x dimensions): heaviest first, to the highest dot product with residual capacity."""
    total = weights.sum(axis=0)
    share = weights / np.where(total > 0, total, 1) * shards
    left = np.ones((shards, weights.shape[1]))
    place = np.zeros(len(weights), dtype=np.int32)
    for i in np.argsort(-share.max(axis=1, initial=0), kind="stable"):
        place[i] = s = int(np.argmax(left @ share[i]))
        left[s] -= share[i]
    return place


def measured(docs: DataFrame) -> DataFrame:
    """(doc_id, size, tokens, text_crc32, grp): a row for each row of docs(doc_id, text), repeated ones and null ids too; tokens are runs of
    anything but white space. A null text counts like an empty one: no token. Other columns aren't read."""
    text = F.coalesce("text", F.lit(""))
    bare = F.trim(F.translate(text, "\t\n\r\x0b\x0c", "     "))
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(text) + OVERHEAD).cast("long").alias("size"),
        F.when(bare == "", 0).otherwise(F.size(F.split(bare, " +"))).cast("long").alias("tokens"),
        F.crc32(text).alias("text_crc32"),
        F.xxhash64(text).alias("grp"),
    )


def shard(rows: DataFrame, shards: int = SHARDS) -> DataFrame:
    """rows(doc_id, size, tokens, grp, …) with shard int and slot long (gapless from 0 in its shard) added. Pass a materialized table.

    Rows with equal grp go to one shard, unless their bytes, tokens or number exceed a shard's share. Null ids and repeated rows are rows like any other.
    An empty table gives none.
    """
    spark = rows.sparkSession
    measures = [F.sum("size").alias("size"), F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("rows")]
    names = ["size", "tokens", "rows"]
    groups = materialize(rows.groupBy("grp").agg(*measures))
    total = groups.agg(*[F.sum(n).alias(n) for n in names]).first()
    capacity = {n: (total[n] or 0) / shards for n in names}
    heavy_if = F.lit(False)
    for n in names:
        heavy_if = heavy_if | (F.col(n) > capacity[n] / CELLS)
    # a sum of shares is at most 1, so at most 3 x shards x CELLS groups are heavy
    heavy = groups.where(heavy_if).collect()
    cells = shards * CELLS
    light = groups.where(~heavy_if).groupBy(F.pmod("grp", F.lit(cells)).alias("cell")).agg(*[F.sum(n).alias(n) for n in names]).collect()
    # shards that a group would fill; parts of those that no shard can hold: fewer than 3 x shards x (1 + 1 / PART)
    fills = {r["grp"]: max(r[n] / capacity[n] for n in names if capacity[n]) for r in heavy}
    split = spark.createDataFrame([(g, int(np.ceil(f / PART))) for g, f in fills.items() if f > 1], "grp long, parts int")
    dealt = rows.join(F.broadcast(split), "grp", "left").withColumn("part", F.when(F.col("parts").isNotNull(), F.pmod(F.xxhash64("doc_id", F.lit("part")), F.col("parts"))).otherwise(0).cast("int"))
    parts = dealt.where(F.col("parts").isNotNull()).groupBy("grp", "part").agg(*measures).collect()
    whole = [r for r in heavy if fills[r["grp"]] <= 1]
    own = sorted([(r["grp"], 0, r) for r in whole] + [(r["grp"], r["part"], r) for r in parts], key=lambda x: x[:2])
    cells_of = sorted([(r["cell"], r) for r in light], key=lambda x: x[0])
    weights = [[r[n] for n in names] for *_, r in [*own, *cells_of]]
    place = pack_vectors(np.array(weights, dtype=float).reshape(-1, len(names)), shards)
    by_group = spark.createDataFrame([(g, part, int(s)) for (g, part, _), s in zip(own, place, strict=False)], "grp long, part int, shard int")
    by_cell = spark.createDataFrame([(c, int(s)) for (c, _), s in zip(cells_of, place[len(own) :], strict=True)], "cell long, cell_shard int")
    # both tables are bounded by the number of shards (see above)
    placed = dealt.withColumn("cell", F.pmod("grp", F.lit(cells))).join(F.broadcast(by_group), ["grp", "part"], "left").join(F.broadcast(by_cell), "cell", "left")
    placed = placed.select(*rows.columns, F.coalesce("shard", "cell_shard").alias("shard"))
    return gapless_rank(placed, ["shard"], F.col("doc_id"), order(rows), "slot", spreads=256, bounded=True)


def order(rows: DataFrame) -> list[Column]:
    return [F.col(c) for c in ("doc_id", "text_crc32", "size", "grp") if c in rows.columns]


def write_shards(docs: DataFrame, path: str, salts: int = 16) -> None:
    """Writes docs with a column shard as one folder a shard; a shard is dealt to `salts` files so that none is written by one task.

    All rows and other columns are written, null ids (all to one of a shard's files) and repeated rows too. An empty table writes no shard.
    """
    docs.repartition(F.col("shard"), F.pmod(F.xxhash64("doc_id"), F.lit(salts))).write.partitionBy("shard").parquet(path)


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shard and slot of every document under the law `bytes`; see shard."""
    rows = materialize(measured(table(spark, sf_dir, "documents")))
    return shard(rows).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))

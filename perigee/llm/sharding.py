"""Sharding: a uniform shuffle with exact shard sizes, by a hypergeometric communication matrix.

Rows lie in logical partitions. How many rows each partition sends to each shard is drawn exactly, as a uniform shuffle
would have it. Each partition permutes its rows and cuts them by those numbers; each shard then permutes what it got.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import free_names, materialize

SHARDS, SEED, LAW = 24, 20240117, "rows"
#: Rows of a logical partition, and the fewest and most partitions: the matrix has at most MOST x shards numbers.
PARTITION_ROWS, FEWEST, MOST = 1_000_000, 64, 4096


def hypergeometric(rng: np.random.Generator, good: int, bad: int, draws: int) -> int:
    """How many of `draws` balls are good, drawn without replacement; by inversion from the mode, at any size.

    Weights are summed outwards from the mode over 40 standard deviations, beyond which they are below rounding.
    """
    total = good + bad
    low, high = max(0, draws - bad), min(good, draws)
    if low == high:
        return low
    mode = min(high, max(low, (draws + 1) * (good + 1) // (total + 2)))
    spread = math.sqrt(draws * (good / total) * (bad / total) * max(total - draws, 1) / max(total - 1, 1))
    reach = int(40 * spread) + 40
    low, high = max(low, mode - reach), min(high, mode + reach)
    up = np.arange(mode, high, dtype=float)
    down = np.arange(mode, low, -1, dtype=float)
    ups = np.cumsum(np.log((good - up) * (draws - up) / ((up + 1) * (bad - draws + up + 1))))
    downs = np.cumsum(np.log(down * (bad - draws + down) / ((good - down + 1) * (draws - down + 1))))
    weights = np.exp(np.concatenate([downs[::-1], [0.0], ups]))
    return low + int(np.searchsorted(np.cumsum(weights), rng.random() * weights.sum(), side="right").clip(0, len(weights) - 1))


def communication_matrix(sizes: list[int], shards: int, seed: int) -> list[list[int]]:
    """Row i: how many rows of partition i go to each shard. Rows sum to sizes, columns to counts at most one apart."""
    rng, total = np.random.default_rng(seed), sum(sizes)
    left = [total // shards + (s < total % shards) for s in range(shards)]
    out = []
    for size in sizes:
        row, need, rest = [], size, sum(left)
        for s in range(shards):
            got = hypergeometric(rng, left[s], rest - left[s], need)
            rest -= left[s]
            need -= got
            left[s] -= got
            row.append(got)
        out.append(row)
    return out


def _measures(text: str) -> tuple[Column, Column]:
    """The size and the crc32 of a text."""
    known = F.coalesce(text, F.lit(""))
    return (F.octet_length(known) + 8).cast("bigint"), F.crc32(known.cast("binary"))


def shard(docs: DataFrame, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """Every row of docs, all columns as they are, with size, text_crc32, law, shard, slot, grown_shard, by the law `rows`.

    The rows themselves are shuffled, texts included: once to their partition, once to their shard and block; they come
    block by block, in the order of their slots. size and text_crc32 are those of the text that arrives. A null text has
    size 8 and the crc32 of no bytes. Documents of equal text are rows like any other and are spread independently;
    repeated rows are interchangeable, and each gets a slot of its own (rows that are equal in id
    and text lie in one partition). Columns may be of any type. Where docs has a column of the name of a new one, the
    new one gets an underscore. An empty table gives no rows. The driver sees one
    count a partition and one count a block.
    """
    spark = docs.sparkSession
    size, crc = _measures("text")
    parts = min(MOST, max(FEWEST, -(-docs.count() // PARTITION_ROWS)))
    # the caller's columns travel as one, so that no name can clash; rows that share id, size and crc are in any order
    rows = docs.select(F.struct(*docs.columns).alias("doc"), F.col("doc_id").alias("id"), size.alias("_size"), crc.alias("_crc"), F.monotonically_increasing_id().alias("_row"))
    rows = rows.withColumns({"_key1": F.xxhash64("id", "_size", "_crc", F.lit(seed)), "_key2": F.xxhash64(F.lit(seed + 1), "_crc", "_size", "id"), "_part": F.pmod(F.xxhash64("id", "_size", "_crc", F.lit(seed + 2)), F.lit(parts)).cast("int")})
    within = Window.partitionBy("_part").orderBy("_key1", "id", "_size", "_crc", "_row")
    rows = materialize(rows.withColumn("_place", F.row_number().over(within)), "zstd")
    sizes = dict(rows.groupBy("_part").count().collect())
    n = sum(sizes.values())
    matrix = communication_matrix([sizes.get(p, 0) for p in range(parts)], shards, seed)
    ends = spark.createDataFrame([(p, [int(x) for x in np.cumsum(row)]) for p, row in enumerate(matrix)], "_part int, _ends array<bigint>")
    dealt = rows.join(F.broadcast(ends), "_part")  # at most MOST rows
    dealt = dealt.withColumn("_shard", F.size(F.filter("_ends", lambda e: e < F.col("_place"))).cast("int")).drop("_ends", "_place", "_part", "_key1")
    placed = _slots(dealt, shards, max(1, -(-n // (shards * PARTITION_ROWS))), max(8, FEWEST // shards))
    size, crc = _measures("doc.text")
    new = [size, crc, F.lit(LAW), F.col("_shard"), F.col("_slot"), F.lit(None).cast("int")]
    names = free_names(docs, "size", "text_crc32", "law", "shard", "slot", "grown_shard")
    return placed.select("doc.*", *[c.alias(n) for c, n in zip(new, names, strict=True)])


def _slots(dealt: DataFrame, shards: int, blocks: int, least: int) -> DataFrame:
    """Orders each shard by its random key, block of keys by block, so that no shard lies in one task."""
    blocks = max(blocks, least)
    order: Column = F.pmod(F.shiftrightunsigned("_key2", 1), F.lit(1 << 40))
    dealt = dealt.withColumn("_block", F.floor(order / (2.0**40) * blocks).cast("int")).withColumn("_order", order)
    counts = {(r["_shard"], r["_block"]): r["count"] for r in dealt.groupBy("_shard", "_block").count().collect()}
    starts = []
    for s in range(shards):
        at = 0
        for b in range(blocks):
            starts.append((s, b, at))
            at += counts.get((s, b), 0)
    starts = dealt.sparkSession.createDataFrame(starts, "_shard int, _block int, _start bigint")
    place = F.row_number().over(Window.partitionBy("_shard", "_block").orderBy("_order", "_key2", "id", "_size", "_crc", "_row")) - 1
    out = dealt.withColumn("_at", place).join(F.broadcast(starts) if shards * blocks <= 1_000_000 else starts, ["_shard", "_block"])
    return out.withColumn("_slot", (F.col("_start") + F.col("_at")).cast("bigint"))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The places of all documents, with the measures of the texts that shard() moved."""
    return shard(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")

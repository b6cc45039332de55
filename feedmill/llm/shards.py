"""Proportional stratified interleaving of rows into shards [op4].

Rows are shuffled within each source by a seeded hash and ranked; a row's fractional rank is
(rank + offset) / rows of its source, with a seeded offset per source in [0, 1).  Sorted by it, all sources
advance at the same pace, and sources of few rows are spread evenly instead of meeting at 1/2, so any stretch
of the order holds the mixture of the whole.  The order is cut into shards whose row counts differ by
at most one (the law ``rows``).

DataFrame functions only.  No source and no order is ever sorted in one task: ranks come from counts
per (source, hash stretch) plus a row number inside the stretch, and global positions from counts per
stretch of the fractional rank plus a row number inside it.  The number of stretches follows the number
of rows up to ``MOST_STRETCHES``, which bounds the table of stretch sizes.

* A null source is a source of its own; null or empty texts and null keys are rows like any other.
* Rows with equal hash are ordered by key, checksum and size; rows equal in all of these are
  interchangeable, so the result is the same whichever comes first.
* Equal rows are numbered as one row with a count and dealt out again in blocks of ``COPIES_PER_BLOCK``, so a row that holds
  a third of the table gathers in no task.  Carried columns must be of types that Spark can group by.
* An empty table gives an empty result; with fewer rows than shards some shards stay empty.
* Columns of the input other than those asked for in ``carry`` are not moved.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

MOST_STRETCHES = 1 << 16
ROWS_PER_STRETCH = 50_000
COPIES_PER_BLOCK = 10_000


def stretch_bits(rows: int) -> int:
    """Bits of the hash that choose a stretch: about ``ROWS_PER_STRETCH`` rows each, 64 stretches at least."""
    return min(MOST_STRETCHES.bit_length() - 1, max(6, (rows // ROWS_PER_STRETCH).bit_length()))


def byte_size(text: Column) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long")


def checksum(text: Column) -> Column:
    return F.crc32(F.coalesce(text.cast("binary"), F.lit(b"")))


def interleave(
    df: DataFrame,
    shards: int,
    carry: list[str],
    source: str = "source",
    key: str = "doc_id",
    text: str = "text",
    seed: int = 42,
    overhead: int = 16,
) -> DataFrame:
    """``carry`` columns with size, text_crc32, shard and slot of every row.

    A carried column that is named like an added one is replaced by it.
    """
    count = df.count()
    bits = stretch_bits(count)
    added = ["size", "text_crc32", "shard", "slot"]
    kept = [c for c in dict.fromkeys(carry) if c not in added]
    rows = df.select(
        F.struct(*[F.col(c) for c in kept]).alias("_carried"),
        F.col(key).alias("_key"),
        F.when(F.col(source).isNull(), "n").otherwise(F.concat(F.lit("s"), F.col(source).cast("string"))).alias("_source"),
        (byte_size(F.col(text)) + overhead).alias("_size"),
        checksum(F.col(text)).alias("_crc"),
    ).withColumn("_hash", F.xxhash64(F.lit(seed), "_key", "_crc", "_size"))
    ties = ["_hash", "_key", "_crc", "_size"]

    rows = rows.groupBy("_source", *ties, "_carried").agg(F.count("*").alias("_copies"))
    rows = rows.withColumn("_stretch", F.shiftrightunsigned("_hash", 64 - bits))
    sizes = rows.groupBy("_source", "_stretch").agg(F.sum("_copies").alias("_n"))
    of_source = W.partitionBy("_source")
    earlier = of_source.orderBy("_stretch").rowsBetween(W.unboundedPreceding, -1)
    offsets = sizes.select(
        "_source", "_stretch",
        F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"),
        F.sum("_n").over(of_source).alias("_all"),
    )
    ahead = W.partitionBy("_source", "_stretch").orderBy(*ties).rowsBetween(W.unboundedPreceding, -1)
    numbered = rows.join(offsets, ["_source", "_stretch"]).withColumn(
        "_rank", F.col("_before") + F.coalesce(F.sum("_copies").over(ahead), F.lit(0))
    )
    block = F.lit(COPIES_PER_BLOCK).cast("long")
    blocks = numbered.withColumn("_from", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_copies") - 1, block)))
    blocks = blocks.repartition("_hash", "_from")
    each = blocks.withColumn("_copy", F.explode(F.sequence(F.col("_from"), F.least(F.col("_from") + block, F.col("_copies")) - 1)))
    offset = F.shiftrightunsigned(F.xxhash64(F.lit(seed), "_source"), 11) / F.lit(float(1 << 53))
    ranked = each.withColumn(
        "_share", F.least((F.col("_rank") + F.col("_copy") + offset) / F.col("_all"), F.lit(1 - 2.0**-53))  # rounding may reach 1
    )

    ranked = ranked.withColumn("_cut", F.floor(F.col("_share") * (1 << bits)))
    cuts = ranked.groupBy("_cut").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(W.orderBy("_cut").rowsBetween(W.unboundedPreceding, -1))  # at most MOST_STRETCHES rows
    cuts = cuts.select("_cut", F.coalesce(before, F.lit(0)).alias("_ahead"))
    place = F.row_number().over(W.partitionBy("_cut").orderBy("_share", *ties))
    placed = ranked.join(cuts, "_cut").withColumn("_place", F.col("_ahead") + place - 1)

    total = max(count, 1)
    shard = F.expr(f"(_place * {shards}L) div {total}L")
    return placed.withColumn("_shard", shard).select(
        "_carried.*",
        F.col("_size").alias("size"),
        F.col("_crc").alias("text_crc32"),
        F.col("_shard").cast("int").alias("shard"),
        (F.col("_place") - F.expr(f"(_shard * {total}L + {shards - 1}L) div {shards}L")).alias("slot"),
    )

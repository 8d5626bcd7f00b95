"""Sharding by rendezvous hashing of stable record keys over weighted shards."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from lumensift.llm.common import shuffle_partitions, utf8_bytes


def _head(hexed: Column) -> Column:
    """The first 52 bits of a hex digest as a number."""
    return F.conv(F.substring(hexed, 1, 13), 16, 10).cast("bigint")


def race(key: Column, shard: int, weight: float) -> Column:
    """The arrival time of ``shard`` for a key: exponential with rate ``weight``; the earliest shard gets the record."""
    u = (_head(F.md5(F.concat_ws(":", F.coalesce(key.cast("string"), F.lit("")), F.lit(str(shard))))) + F.lit(0.5)) / F.lit(float(1 << 52))
    return -F.ln(u) / F.lit(float(weight))


def shard_of(key: Column, weights: Sequence[float]) -> Column:
    """Index of the winning shard. A shard added at the end takes records only into itself; a heavier one wins in proportion."""
    if not weights or min(weights) <= 0:
        raise ValueError("shards need positive weights")
    runs = [F.struct(race(key, s, w).alias("t"), F.lit(s).alias("s")) for s, w in enumerate(weights)]
    return (F.least(*runs) if len(runs) > 1 else runs[0])["s"].cast("int")


def assign_shards(df: DataFrame, key: str, weights: Sequence[float], grown: Sequence[float] | None = None, out: str = "shard") -> DataFrame:
    """Add ``out`` and, if ``grown`` gives more weights, ``grown_<out>``. A map without a shuffle; existing columns of these names are replaced."""
    every = list(grown or weights)
    if list(weights) != every[: len(weights)]:
        raise ValueError("grown must start with weights")
    c = F.col(key)
    runs = df.withColumn("_races", F.array(*[F.struct(race(c, s, w).alias("t"), F.lit(s).alias("s")) for s, w in enumerate(every)]))
    runs = runs.withColumn(out, F.array_min(F.slice("_races", 1, len(weights)))["s"].cast("int"))
    if grown:
        runs = runs.withColumn(f"grown_{out}", F.array_min("_races")["s"].cast("int"))
    return runs.drop("_races")


def with_slots(df: DataFrame, key: str, tie: Sequence[str] = (), shard: str = "shard", out: str = "slot") -> DataFrame:
    """Number the rows of every shard from 0 without gaps, in the order of the key's digest.

    A shard is cut into ranges of digests (as many as shuffle partitions), each range is numbered on its own and starts where the
    earlier ones end; the numbers do not depend on how many ranges there are. Only key, ``tie`` and ``shard`` should be carried here.
    """
    n = max(1, shuffle_partitions(df.sparkSession) // 4)
    h = _head(F.md5(F.coalesce(F.col(key).cast("string"), F.lit(""))))
    d = df.withColumn("_h", h).withColumn("_cell", F.floor(F.col("_h") / F.lit((1 << 52) / n)).cast("int"))
    sizes = d.groupBy(F.col(shard).alias("_s"), F.col("_cell").alias("_c")).agg(F.count(F.lit(1)).alias("_n"))
    # at most shards x ranges rows
    starts = sizes.withColumn("_start", F.coalesce(F.sum("_n").over(W.partitionBy("_s").orderBy("_c").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    d = d.join(F.broadcast(starts), (F.col(shard) == F.col("_s")) & (F.col("_cell") == F.col("_c")))
    order = W.partitionBy(shard, "_cell").orderBy("_h", key, *tie)
    return d.withColumn(out, F.col("_start") + F.row_number().over(order) - 1).drop("_h", "_cell", "_s", "_c", "_n", "_start")


def shard_documents(docs: DataFrame, n_shards: int = 16, weights: Sequence[float] | None = None) -> DataFrame:
    """Each document's shard by its ``doc_id``, with its size, checksum and slot.

    Null texts have size 1 and the checksum of no bytes (0). Null ids share one key. Rows that repeat an id share its shard and get
    slots of their own. Only ids, sizes and checksums are shuffled, never texts. An empty table gives an empty one.
    """
    weights = list(weights or [1.0] * n_shards)
    d = docs.select("doc_id", (utf8_bytes(F.col("text")) + 1).alias("size"), F.crc32(F.encode(F.coalesce(F.col("text"), F.lit("")), "UTF-8")).cast("bigint").alias("text_crc32"))
    d = assign_shards(d, "doc_id", weights, [*weights, 1.0]).withColumn("law", F.lit("key"))
    d = with_slots(d, "doc_id", ("text_crc32", "size"))
    return d.select("doc_id", "size", "text_crc32", "law", "shard", F.col("slot").cast("bigint").alias("slot"), "grown_shard")

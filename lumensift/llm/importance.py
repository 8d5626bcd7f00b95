"""Importance resampling towards a target distribution: hashed word n-grams from overlapped regex scans, log-ratio gains, Gumbel top-k draws."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from lumensift.llm.common import chunks, cut

N_LOW, N_HIGH, BUCKETS, SEED, MIN_WORDS, PERCENT = 1, 1, 10_000, 2024, 20, 10
#: Separators become spaces, A-Z become a-z; digits, letters and all bytes of non-ASCII characters stay.
_FLAT = bytes(b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))


def gram_pattern(n: int) -> regex.Pattern:
    """A run of ``n`` words between single spaces; the lookarounds hold it to whole words wherever an overlapped scan goes on."""
    return regex.compile(rb"(?<= )[^ ]+(?: [^ ]+){%d}(?= )" % (n - 1))


def gram_buckets(text: bytes | None, patterns: list[regex.Pattern], buckets: int) -> tuple[int, np.ndarray]:
    """Number of words, and the bucket of every n-gram: a match starts at each word, since the next search starts one byte after the last start."""
    flat = b" ".join((text or b"").translate(_FLAT).split())
    if not flat:
        return 0, np.zeros(0, np.uint32)
    words, flat = flat.count(b" ") + 1, b" " + flat + b" "
    spans = [np.fromiter((crc32(m[0]) for m in p.finditer(flat, overlapped=True)), np.uint32) for p in patterns]
    return words, np.concatenate(spans) % np.uint32(buckets)


def _scan(lo: int, hi: int, buckets: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        patterns = [gram_pattern(n) for n in range(lo, hi + 1)]
        for part, texts in chunks(batches, "text"):
            found = [gram_buckets(t, patterns, buckets) for t in texts]
            yield pa.RecordBatch.from_arrays([
                part.column(part.schema.get_field_index("doc_id")), pa.array([w for w, _ in found], pa.int64()),
                pa.array([f.astype("<u4").tobytes() for _, f in found], pa.binary()),
            ], names=["doc_id", "n_words", "features"])
    return run


def hashed_features(docs: DataFrame, lo: int = N_LOW, hi: int = N_HIGH, buckets: int = BUCKETS) -> DataFrame:
    """doc_id, n_words, features (little-endian 32-bit bucket numbers, one for every n-gram of ``lo`` to ``hi`` words, repeats included)."""
    base = docs.select("doc_id", "text")
    return base.mapInArrow(_scan(lo, hi, buckets), f"doc_id {base.schema['doc_id'].dataType.simpleString()}, n_words bigint, features binary")


def _tally(buckets: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for f in batch.column("features").to_pylist():
                total += np.bincount(np.frombuffer(f, "<u4"), minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(total[some], pa.int64())], names=["bucket", "n"])
    return run


def bucket_counts(features: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """bucket, n over all documents; each task sends at most one row a bucket."""
    return features.select("features").mapInArrow(_tally(buckets), "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n"))


def bucket_gains(raw: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """bucket, gain for each of the ``buckets`` buckets: 1000 times the log of the smoothed share in ``target`` over that in ``raw``, floored."""
    spark = raw.sparkSession
    every = spark.range(buckets).withColumnRenamed("id", "bucket")
    s, t = (bucket_counts(f, buckets).select("bucket", F.col("n").alias(k)) for f, k in ((raw, "s"), (target, "t")))
    both = every.join(s, "bucket", "left").join(t, "bucket", "left").fillna(0, ["s", "t"])
    whole = W.partitionBy()  # ``buckets`` rows, whatever the input
    d = lambda c: c.cast("double")
    ratio = (d(F.col("t") + 1) * d(F.sum("s").over(whole) + buckets)) / (d(F.col("s") + 1) * d(F.sum("t").over(whole) + buckets))
    return both.select("bucket", F.floor(1000.0 * F.log(ratio)).cast("bigint").alias("gain"))


def _weigh(gains: np.ndarray) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [np.frombuffer(f, "<u4") for f in batch.column("features").to_pylist()]
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id"), batch.column("n_words"), pa.array([f.size for f in found], pa.int64()),
                pa.array([int(gains[f].sum()) // f.size if f.size else 0 for f in found], pa.int64()),
            ], names=["doc_id", "n_words", "n_features", "weight"])
    return run


def gumbel(doc_id: Column, seed: int = SEED) -> Column:
    """1000 times a standard Gumbel draw, floored: a hash of seed and id stands for the uniform number, so that reruns draw alike."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000.0 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("bigint")


def importance_scores(docs: DataFrame, target: DataFrame, lo: int = N_LOW, hi: int = N_HIGH, buckets: int = BUCKETS, seed: int = SEED) -> DataFrame:
    """doc_id, n_words, n_features, weight (floored mean gain), score (weight plus Gumbel draw) of every row of ``docs``.

    ``target`` has a text column, too. The scan's features are written once to the checkpoint folder (4 bytes each) and read for counts and
    for weights. ``buckets`` gains, a number fixed by parameter, go through the driver to the tasks.
    """
    raw = cut(hashed_features(docs, lo, hi, buckets))
    aim = hashed_features(target.select(F.lit(0).cast("bigint").alias("doc_id"), "text"), lo, hi, buckets)
    gains = np.zeros(buckets, np.int64)
    for r in bucket_gains(raw, aim, buckets).collect():
        gains[r.bucket] = r.gain
    kind = raw.schema["doc_id"].dataType.simpleString()
    weighed = raw.mapInArrow(_weigh(gains), f"doc_id {kind}, n_words bigint, n_features bigint, weight bigint")
    return weighed.withColumn("score", F.col("weight") + gumbel(F.col("doc_id"), seed))


def with_draws(scored: DataFrame, percent: int = PERCENT, min_words: int = MIN_WORDS) -> DataFrame:
    """``rank`` from 1 for the drawn rows, else null: floor(percent * N / 100) highest scores of the N rows of ``min_words`` words or more.

    Scores are integers in a range bounded by the gains (1000 times a log of counts) and the draw (-3,200 to 22,200), so their histogram is
    small whatever the input: it gives the number of rows above each score, and positions are counted only among rows of the same score,
    which the draw keeps few. No step orders all rows in one task.
    """
    able = F.col("n_words") >= min_words
    hist = scored.where(able).groupBy("score").agg(F.count(F.lit(1)).alias("_n"))
    above = W.orderBy(F.desc("score")).rowsBetween(W.unboundedPreceding, -1)
    hist = hist.select("score", F.coalesce(F.sum("_n").over(above), F.lit(0)).alias("_above"), F.sum("_n").over(W.partitionBy()).alias("_all"))
    hist = hist.select("score", "_above", F.floor(F.lit(percent) * F.col("_all") / 100).cast("bigint").alias("_take")).where("_above < _take")
    d = scored.withColumn("_able", able).join(F.broadcast(hist), "score", "left")  # at most one row for each possible score
    near = F.col("_able") & F.col("_above").isNotNull()
    place = F.row_number().over(W.partitionBy("score", "_near").orderBy(F.col("doc_id").asc_nulls_first(), "n_features", "weight"))
    drawn = d.withColumn("_near", near).where("_near").withColumn("rank", F.col("_above") + place).withColumn("rank", F.when(F.col("rank") <= F.col("_take"), F.col("rank")))
    rest = d.where(~near).withColumn("rank", F.lit(None).cast("bigint"))
    cols = [*scored.columns, "rank"]
    return drawn.select(cols).unionByName(rest.select(cols))


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, min_words: int = MIN_WORDS, lo: int = N_LOW, hi: int = N_HIGH, buckets: int = BUCKETS, seed: int = SEED) -> DataFrame:
    """doc_id, n_words, n_features, weight, score, rank for every row of ``docs``; rank is null for rows that aren't drawn.

    Words are runs of digits, letters (A-Z lower-cased) and non-ASCII characters of the whole text. A null or empty text has no words: weight 0,
    never drawn unless ``min_words`` is 0. A null doc_id hashes as an empty one and comes first among equal scores. Rows that repeat a doc_id
    are documents of their own; of equal score, fewer features come first. Empty tables give no rows; an empty target gives all buckets the
    smoothed share 1 / buckets. Further columns of either table play no part.
    """
    return with_draws(cut(importance_scores(docs, target, lo, hi, buckets, seed)), percent, min_words)


def drawn_documents(docs: DataFrame, target: DataFrame, **settings) -> DataFrame:
    """The drawn rows of ``docs`` with all their columns (a doc_id that repeats is drawn with all its rows)."""
    ids = resample(docs, target, **settings).where(F.col("rank").isNotNull()).select(F.col("doc_id").alias("_drawn")).distinct()
    return docs.join(ids, F.col("doc_id").eqNullSafe(F.col("_drawn")), "left_semi")

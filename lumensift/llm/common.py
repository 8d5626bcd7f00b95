"""Small helpers shared by the corpus operators."""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: Text bytes that one numpy pass inside a task handles at a time (a single longer text is its own pass).
CHUNK_BYTES = 1 << 20


def tables(spark: SparkSession, sf_dir: str, *names: str) -> list[DataFrame]:
    """The named Parquet tables of a data folder."""
    return [spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in names]


def cut(df: DataFrame, eager: bool = True) -> DataFrame:
    """Write to the shared checkpoint folder, so that later steps neither recompute nor depend on executors' disks."""
    spark = df.sparkSession
    sc = spark.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        where = spark.conf.get("spark.checkpoint.dir", None)
        if not where and not sc.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(where or tempfile.mkdtemp(prefix="spark-"))
    return df.checkpoint(eager)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def utf8_bytes(c: Column) -> Column:
    """UTF-8 length; null has none."""
    return F.coalesce(F.octet_length(c), F.lit(0)).cast("bigint")


def chunks(batches: Iterator[pa.RecordBatch], text: str, limit: int = CHUNK_BYTES) -> Iterator[tuple[pa.RecordBatch, list[bytes | None]]]:
    """Slices of the batches whose texts add up to about ``limit`` bytes, with the texts as UTF-8."""
    for batch in batches:
        col = batch.column(batch.schema.get_field_index(text))
        sizes = np.cumsum(pc.fill_null(pc.binary_length(col), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 16)
        start = 0
        while start < batch.num_rows:
            base = sizes[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(sizes, base + limit, side="right")))
            part = batch.slice(start, stop - start)
            yield part, part.column(part.schema.get_field_index(text)).cast(pa.binary()).to_pylist()
            start = stop


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on unsigned 64-bit integers (Steele, Lea and Flood's SplitMix64)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class Powers:
    """Powers of an odd base modulo 2**64 and of its inverse, grown on demand: window hashes are differences of prefix sums."""

    def __init__(self, base: int):
        self.base, self.inv = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > self.up.size:
            size = max(n, 2 * self.up.size)
            both = []
            for b in (self.base, self.inv):
                a = np.full(size, b, np.uint64)
                a[0] = 1
                both.append(np.multiply.accumulate(a))
            self.up, self.down = both
        return self.up[:n], self.down[:n]


WORD_POWERS = Powers(0x9E3779B97F4A7C15)
GRAM_POWERS = Powers(0xD1342543DE82EF95)
_BYTES = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def split_words(texts: list[bytes | None], keep: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words of all texts at once: the joined bytes, each word's start and end there, and the number of words of each text.

    ``keep`` maps each byte to itself (or another letter) or to zero where it separates words; it maps the space to zero.
    """
    joined = b" ".join([t or b"" for t in texts] + [b""])
    table = np.frombuffer(keep, np.uint8)
    data = table[np.frombuffer(joined, np.uint8)]
    inside = np.zeros(data.size + 2, np.int8)
    inside[1:-1] = data != 0
    edge = np.diff(inside)
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    text_ends = np.cumsum([len(t or b"") + 1 for t in texts]) if texts else np.zeros(0, np.int64)
    upto = np.searchsorted(starts, text_ends)
    return data, starts, ends, np.diff(upto, prepend=0)


def hash_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word."""
    up, down = WORD_POWERS.get(data.size + 1)
    sums = np.zeros(data.size + 1, np.uint64)
    np.cumsum(_BYTES[data] * up[:-1], out=sums[1:])
    return mix64((sums[ends] - sums[starts]) * down[starts])


def hash_grams(words: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit hash of every run of ``k`` words (empty if there are fewer)."""
    if words.size < k:
        return np.zeros(0, np.uint64)
    up, down = GRAM_POWERS.get(words.size + 1)
    sums = np.zeros(words.size + 1, np.uint64)
    np.cumsum(words * up[:-1], out=sums[1:])
    return mix64((sums[k:] - sums[:-k]) * down[: words.size - k + 1])


def sliding(a: np.ndarray, w: int, op) -> np.ndarray:
    """``op`` (np.minimum or np.maximum) over every window of ``w`` neighbours, by doubling."""
    out, span = a, 1
    while span * 2 <= w:
        out = op(out[:-span], out[span:])
        span *= 2
    return op(out[: a.size - w + 1], out[w - span: w - span + a.size - w + 1]) if span < w else out


def bytes_table(word: str) -> bytes:
    """Byte map for ``split_words``: ``alnum`` keeps digits, letters (lower-cased) and all non-ASCII; ``solid`` keeps all but white space."""
    if word == "alnum":
        return bytes(b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else b + 32 if 0x41 <= b <= 0x5A else 0 for b in range(256))
    return bytes(0 if b == 0x20 or 0x09 <= b <= 0x0D else b or 0xFF for b in range(256))  # a zero byte is part of a word; 0xFF isn't in UTF-8

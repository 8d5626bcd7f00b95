"""Stable hashes, folds, shards and splits; never ``rand()``."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def digest(value: Column, seed: int) -> Column:
    """Hex sha-256 of ``seed|value``; the order used for every pseudo-random pick."""
    return F.sha2(F.concat_ws("|", F.lit(str(seed)), value.cast("string")), 256)


def _mod_first8(hexed: Column, n: int) -> Column:
    hi = F.conv(F.substring(hexed, 1, 8), 16, 10).cast("bigint")
    lo = F.conv(F.substring(hexed, 9, 8), 16, 10).cast("bigint")
    return (((hi % n) * F.lit((1 << 32) % n) + lo) % n).cast("bigint")


def stable_fold(value: Column, seed: int, n_folds: int = 5) -> Column:
    """First eight digest bytes, big-endian, modulo ``n_folds``; exact in 64-bit arithmetic."""
    return _mod_first8(digest(value, seed), n_folds)


def stable_shard(value: Column, n_shards: int) -> Column:
    """First eight sha-1 bytes of the id modulo ``n_shards``."""
    return _mod_first8(F.sha1(value.cast("string")), n_shards)


def split_of(tic: Column) -> Column:
    """70/15/15 train, validation and test by the target's sha-1."""
    bucket = F.conv(F.substring(F.sha1(tic.cast("string")), 1, 8), 16, 10).cast("bigint") % 100
    return F.when(bucket < 70, "train").when(bucket < 85, "validation").otherwise("test")


def uniform(value: Column, seed: int) -> Column:
    """A reproducible uniform in [0, 1) from the first 8 hex digits of the digest."""
    return F.conv(F.substring(digest(value, seed), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)

"""Exact top-k search: term-at-a-time accumulation over blocks, partition selection, merge."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

#: Rows of a block of candidates and of queries; one cell (a block against a block) is in memory at a time.
CANDIDATE_ROWS, QUERY_ROWS, STRIP = 2048, 4096, 64


def usable(vec: Column) -> Column:
    """Not null and without null or non-finite components."""
    x = F.coalesce(F.forall(vec, lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < float("inf"))), F.lit(False))
    return vec.isNotNull() & x


def quantised(vectors: list[np.ndarray], scale: float) -> np.ndarray:
    """floor(scale * x) as whole numbers in rows; shorter vectors are filled with zeros. Integers beyond 2**62 become Python's."""
    width = max((v.size for v in vectors), default=0)
    out = np.zeros((len(vectors), width))
    for i, v in enumerate(vectors):
        out[i, : v.size] = v
    with np.errstate(over="ignore"):
        big = np.floor(out * scale)
    if np.abs(big).max(initial=0.0) < 2.0**62:
        return big.astype(np.int64)
    from fractions import Fraction
    return np.array([[int(Fraction(float(x)) * Fraction(scale) // 1) for x in row] for row in out], object).reshape(out.shape)


def accumulate(queries: np.ndarray, postings: list[tuple[np.ndarray, np.ndarray]], n: int, kind) -> np.ndarray:
    """Scores of some query rows against ``n`` candidates: each term's weighted postings are added into dense score rows.

    A list of ``n`` postings has no positions (the term is in most candidates; the others have weight 0) and is added as it stands.
    """
    scores = np.zeros((len(queries), n), kind)
    part = np.empty_like(scores)
    queries = queries.astype(kind)
    for t in range(min(queries.shape[1], len(postings))):
        at, weights = postings[t]
        if at is None:
            np.multiply.outer(queries[:, t], weights, out=part)
            np.add(scores, part, out=scores)
        elif at.size:
            for row in np.flatnonzero(queries[:, t]):
                scores[row, at] += queries[row, t] * weights
    return scores


def cell_top(q_ids: np.ndarray, q: np.ndarray, c_ids: np.ndarray, c: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, list[int]]]:
    """Each query's best ``k`` of one block of candidates (not those with its own id): (query id, candidate ids, scores)."""
    order = np.argsort(c_ids, kind="stable")
    c_ids, c = c_ids[order], c[order]
    n = c_ids.size
    top = lambda a: float(np.abs(a.astype(float)).max(initial=0.0))
    bound = top(q) * top(c) * max(1, min(q.shape[1], c.shape[1]))
    kind = np.int32 if bound < 2**31 - 1 else np.int64 if bound * n < 2**62 else object
    c = c.astype(kind)
    postings = [(None, c[:, t].copy()) if at.size * 2 > n else (at, c[at, t]) for t in range(c.shape[1]) for at in [np.flatnonzero(c[:, t])]]
    back = np.arange(n - 1, -1, -1, dtype=np.int64)
    for s in range(0, q_ids.size, STRIP):
        scores = accumulate(q[s:s + STRIP], postings, n, kind)
        # one number orders by score and then by smaller id; the partition needs no second key
        keys = scores.astype(object) * n + back.astype(object) if kind is object else scores.astype(np.int64) * n + back
        lo, hi = np.searchsorted(c_ids, q_ids[s:s + STRIP], "left"), np.searchsorted(c_ids, q_ids[s:s + STRIP], "right")
        most = min(n, k + int((hi - lo).max(initial=0)))
        if kind is object:
            picked = np.argsort(-keys, axis=1)[:, :most]
        else:
            picked = np.argpartition(keys, n - most, axis=1)[:, n - most:] if most < n else np.tile(np.arange(n), (len(keys), 1))
        for i, own in enumerate(picked):
            own = own[(own < lo[i]) | (own >= hi[i])]
            own = own[np.argsort(-keys[i, own])][:k]
            yield int(q_ids[s + i]), c_ids[own], [int(x) for x in scores[i, own]]


def _cells(k: int, scale: float):
    def block(part, name: str) -> tuple[np.ndarray, np.ndarray]:
        rows = part.column(part.schema.get_field_index(name))[0].values
        vecs = rows.field("v")
        return rows.field("id").to_numpy(zero_copy_only=False), quantised([np.asarray(x.values, float) for x in vecs], scale)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                part = batch.slice(i, 1)
                out = list(cell_top(*block(part, "q"), *block(part, "c"), k))
                if out:
                    clip = lambda x: max(-(1 << 63), min((1 << 63) - 1, x))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([o[0] for o in out], pa.int64()), pa.array([o[1].tolist() for o in out], pa.list_(pa.int64())), pa.array([[clip(x) for x in o[2]] for o in out], pa.list_(pa.int64()))],
                        names=["query_id", "ids", "scores"])
    return run


def top_k(vectors: DataFrame, is_query: Column, k: int = 20, vec_id: str = "vec_id", vec: str = "embedding", scale: float = 64.0) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` highest integer inner products of every query row with all other rows, ties to smaller ids.

    Rows without an id and vectors that are null or hold null or non-finite components take no part. Missing trailing components count as
    zero. A repeated candidate row is a candidate each time; a repeated query id is asked once, with its smallest vector, and no row of its
    id is its own candidate. Scores beyond 64 bits are clipped after ranking inside a block. Fewer rows than ``k`` give fewer results, an
    empty table none.

    Blocks of candidates meet blocks of queries in an equi join on the grid of blocks, so a task holds one block of each, whatever the size
    of the table; a cell passes on ``k`` rows per query, and the merge is a top-k per query that Spark cuts before its shuffle.
    """
    v = vectors.select(F.col(vec_id).cast("bigint").alias("id"), F.col(vec).cast("array<double>").alias("v"), is_query.alias("_q")).where(F.col("id").isNotNull() & usable(F.col("v")))
    sizes = v.agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("_q"), 1)).alias("q")).head()
    n_c, n_q = max(1, -(-sizes.n // CANDIDATE_ROWS)), max(1, -(-sizes.q // QUERY_ROWS))
    pack = F.collect_list(F.struct("id", "v"))
    # the row's place in its block comes from its whole content, so that repeated ids spread as well
    c = v.withColumn("_c", F.pmod(F.xxhash64("id", "v"), F.lit(n_c))).groupBy("_c").agg(pack.alias("c"))
    asked = v.where("_q").groupBy("id").agg(F.min("v").alias("v"))
    q = asked.withColumn("_r", F.pmod(F.xxhash64("id"), F.lit(n_q))).groupBy("_r").agg(pack.alias("q"))
    c = c.withColumn("_r", F.explode(F.sequence(F.lit(0), F.lit(n_q - 1)))).withColumn("_r", F.col("_r").cast("bigint"))
    q = q.withColumn("_c", F.explode(F.sequence(F.lit(0), F.lit(n_c - 1)))).withColumn("_c", F.col("_c").cast("bigint"))
    cells = c.join(q.hint("shuffle_hash"), ["_r", "_c"]).select("q", "c")
    found = cells.mapInArrow(_cells(k, scale), "query_id bigint, ids array<bigint>, scores array<bigint>")
    flat = found.select("query_id", F.explode(F.arrays_zip("ids", "scores")).alias("x")).select("query_id", F.col("x.ids").alias("vec_id"), F.col("x.scores").alias("score"))
    best = W.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("vec_id"))
    return flat.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

"""Benchmark decontamination: a broadcast set of normalised test n-grams against the word windows of every document."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from lumensift.llm.common import bytes_table, chunks, cut, hash_grams, mix64, split_words

_ALNUM = bytes_table("alnum")
#: Words of benchmark items that one broadcast set may hold; larger benchmarks are scanned in several sets of items.
SET_WORDS = 2_000_000


@dataclass
class WindowSet:
    """Windows of some benchmark items: word ids, the sorted window hashes of each length, and what verifies a hit."""

    vocab: dict[bytes, int]
    sorted_hashes: dict[int, np.ndarray]  # by window length
    windows: dict[int, np.ndarray]  # word ids, a row for each hash
    owners: dict[int, list[list[str]]]  # the items of each window


def build_windows(items: list[tuple[str, bytes | None]], n: int) -> WindowSet:
    """All windows of ``n`` words of (id, text); an item of fewer words, but not none, is one window."""
    _, _, _, words = _words([t for _, t in items])
    vocab: dict[bytes, int] = {}
    found: dict[tuple[int, ...], set[str]] = {}
    for (item, _), own in zip(items, words):
        ids = [vocab.setdefault(w, len(vocab) + 1) for w in own]
        k = min(n, len(ids))
        for i in range(len(ids) - k + 1 if k else 0):
            found.setdefault(tuple(ids[i:i + k]), set()).add(item)
    out = WindowSet(vocab, {}, {}, {})
    for k in sorted({len(w) for w in found}):
        rows = [w for w in found if len(w) == k]
        a = np.array(rows, np.uint64).reshape(-1, k)
        h = np.array([hash_grams(mix64(r), k)[0] for r in a], np.uint64)
        order = np.argsort(h, kind="stable")
        out.sorted_hashes[k], out.windows[k], out.owners[k] = h[order], a[order], [sorted(found[rows[i]]) for i in order]
    return out


def _words(texts: list[bytes | None]) -> tuple[None, None, np.ndarray, list[list[bytes]]]:
    each = [t.translate(_MAP).split() if t else [] for t in texts]
    return None, None, np.array([len(w) for w in each], np.int64), each


_MAP = bytes(b if b else 0x20 for b in _ALNUM)


def hits(texts: list[bytes | None], known: WindowSet) -> tuple[np.ndarray, np.ndarray, list[set[str]]]:
    """For each text its number of words and, over all texts' words, which are hit; and the items that occur in each text."""
    each = [t.translate(_MAP).split() if t else [] for t in texts]
    counts = np.array([len(w) for w in each], np.int64)
    get = known.vocab.get
    total = int(counts.sum())
    ids = np.fromiter((get(w, 0) for own in each for w in own), np.uint64, total)
    hit, items = np.zeros(total, bool), [set() for _ in texts]
    ends = np.cumsum(counts)
    unknown = np.zeros(total + 1, np.int64)
    np.cumsum(ids == 0, out=unknown[1:])
    mixed = mix64(ids)
    for k, hashes in known.sorted_hashes.items():
        if total < k:
            continue
        inner = unknown[k:] == unknown[:-k]  # no unknown word
        at = np.flatnonzero(inner)
        if not at.size:
            continue
        doc = np.searchsorted(ends, at, side="right")
        at, doc = at[at + k <= ends[doc]], doc[at + k <= ends[doc]]
        h = hash_grams(mixed, k)[at] if at.size * 20 > total else np.array([hash_grams(mixed[i:i + k], k)[0] for i in at], np.uint64)
        lo, hi = np.searchsorted(hashes, h, side="left"), np.searchsorted(hashes, h, side="right")
        for j in np.flatnonzero(hi > lo):
            i = at[j]
            for w in range(lo[j], hi[j]):  # equal hashes: the words decide
                if np.array_equal(known.windows[k][w], ids[i:i + k]):
                    hit[i:i + k] = True
                    items[doc[j]].update(known.owners[k][w])
    return counts, hit, items


def _scan(known_by, carried: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = known_by.value
        for part, texts in chunks(batches, "_text"):
            counts, hit, items = hits(texts, known)
            ends = np.cumsum(counts)
            spans = []
            for i, e in enumerate(ends):
                own = np.flatnonzero(np.diff(hit[e - counts[i]:e].astype(np.int8), prepend=0, append=0))
                spans.append(own.astype(np.int64).tolist())
            if carried:
                spans = [_union(a, b) for a, b in zip(part.column("_spans").to_pylist(), spans)]
                items = [set(a) | b for a, b in zip(part.column("_items").to_pylist(), items)]
            keep = [c for c in part.schema.names if c not in ("_n_words", "_spans", "_items")]
            yield pa.RecordBatch.from_arrays(
                [*(part.column(c) for c in keep), pa.array(counts), pa.array(spans, pa.list_(pa.int64())), pa.array([sorted(x) for x in items], pa.list_(pa.string()))],
                names=[*keep, "_n_words", "_spans", "_items"])
    return run


def _union(a: list[int], b: list[int]) -> list[int]:
    """Union of two lists of alternating starts and ends."""
    out: list[int] = []
    for s, e in sorted([*zip(a[::2], a[1::2]), *zip(b[::2], b[1::2])]):
        if out and s <= out[-1]:
            out[-1] = max(out[-1], e)
        else:
            out += [s, e]
    return out


def mark_hits(docs: DataFrame, benchmark: DataFrame, n: int = 13, text: str = "text", item: str = "item_id", item_text: str = "text", keep: Sequence[str] | None = None, set_words: int = SET_WORDS) -> DataFrame:
    """doc (a struct of ``docs``' columns, or those in ``keep``), _n_words, _spans (hit word ranges as alternating starts and ends) and _items
    (ids of occurring items, sorted).

    Words are maximal runs of digits, ASCII letters (lower-cased) and non-ASCII characters. The set is broadcast; its size is checked: items
    are dealt by id into sets of about ``set_words`` words, one set is in memory at a time, and each set is one narrow pass over the
    documents that adds to the earlier passes' spans; between two passes the documents are written. Nothing is shuffled. A single item is never split over sets.
    Null and empty texts and items have no words. Repeated items count once per id; a null item id is written as an empty string.
    """
    sc = docs.sparkSession.sparkContext
    b = benchmark.select(F.coalesce(F.col(item).cast("string"), F.lit("")).alias("item"), F.col(item_text).alias("text")).where(F.col("text").isNotNull())
    size = b.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).head()[0] // 2  # a word has a byte and a separator at least
    n_sets = max(1, -(-size // set_words))
    d = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep or docs.columns]).alias("doc"), F.col(text).alias("_text"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in d.schema)
    for k in range(n_sets):
        d = cut(d) if k else d  # maps in one stage would hold their sets at once
        own = b if n_sets == 1 else b.where(F.pmod(F.xxhash64("item"), F.lit(n_sets)) == k)
        known = build_windows([(r.item, r.text.encode()) for r in own.toLocalIterator()], n)
        d = d.mapInArrow(_scan(sc.broadcast(known), k > 0), f"{fields}, _n_words bigint, _spans array<bigint>, _items array<string>")
    return d.drop("_text")


def n_hit(spans: Column) -> Column:
    """Words inside the alternating starts and ends."""
    signed = F.transform(spans, lambda x, i: F.when(i % 2 == 0, -x).otherwise(x))
    return F.aggregate(signed, F.lit(0).cast("bigint"), lambda a, x: a + x)


def contamination(docs: DataFrame, benchmark: DataFrame, n: int = 13, one_in: int = 20) -> DataFrame:
    """One row for each document: doc_id, n_words, n_hit, n_items, items_sha256 and contaminated (one word of ``one_in`` or more is hit).

    Only id and text are read. Ties and repeated rows are judged each on its own; an empty table gives an empty one; without any benchmark
    words nothing is hit.
    """
    d = mark_hits(docs, benchmark, n, keep=["doc_id"]).withColumn("n_hit", n_hit(F.col("_spans")))
    return d.select(
        "doc.doc_id", F.col("_n_words").alias("n_words"), "n_hit", F.size("_items").cast("bigint").alias("n_items"), F.sha2(F.array_join("_items", ","), 256).alias("items_sha256"),
        ((F.col("n_hit") > 0) & (F.lit(one_in) * F.col("n_hit") >= F.col("_n_words"))).alias("contaminated"))


@F.pandas_udf(T.StringType())
def without_spans(text: pd.Series, spans: pd.Series) -> pd.Series:
    """The text without the bytes from each span's first word to its last."""
    out = []
    for t, s in zip(text, spans):
        if t is None or not len(s):
            out.append(t)
            continue
        raw = t.encode()
        _, starts, ends, _ = split_words([raw], _ALNUM)
        kept, at = [], 0
        for a, e in zip(s[::2], s[1::2]):
            kept.append(raw[at:starts[a]])
            at = ends[e - 1]
        out.append(b"".join([*kept, raw[at:]]).decode())
    return pd.Series(out)


def decontaminate(docs: DataFrame, benchmark: DataFrame, n: int = 13, one_in: int = 20, remove: str = "documents") -> DataFrame:
    """``docs`` without contaminated documents, or (``remove="spans"``) with the hit spans cut from their texts. Columns stay as they are."""
    d = mark_hits(docs, benchmark, n)
    hit = n_hit(F.col("_spans"))
    if remove == "documents":
        d = d.where(~((hit > 0) & (F.lit(one_in) * hit >= F.col("_n_words"))))
    elif remove == "spans":
        d = d.withColumn("doc", F.struct(*[(without_spans("doc.text", "_spans") if c == "text" else F.col(f"doc.`{c}`")).alias(c) for c in docs.columns]))
    else:
        raise ValueError("remove is 'documents' or 'spans'")
    return d.select("doc.*")

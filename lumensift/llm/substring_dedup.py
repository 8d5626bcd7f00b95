"""Exact substring dedup: windows of words that an earlier document has, found with an FM-index per shard of suspicious passages."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from lumensift.llm.common import Powers, bytes_table, chunks, cut, hash_grams, hash_words, mix64, shuffle_partitions, split_words
from lumensift.llm.fm_index import FMIndex

_SOLID = bytes_table("solid")
#: Words of a window; of an anchor within it. Every window has WINDOW - ANCHOR + 1 anchors and is filed under the one of least hash.
WINDOW, ANCHOR = 50, 26
#: Words of an index (more only where one anchor needs them); windows of one anchor beyond which they are compared by digest instead.
#: A window under its anchor is about five words of passages, so one anchor adds 300,000 words at most: an index of some 100 MB.
SHARD_WORDS, HOT_WINDOWS = 200_000, 60_000
#: Windows of one frequent anchor that a task compares by digest; more are dealt by their digests.
HOT_PART = 500_000
#: Bits for each text that is looked at in the filter before their shuffle, and at most (32 MB).
FILTER_BITS, MOST_BITS = 16, 1 << 28
_SECOND = Powers(0xA0761D6478BD642F)


def least_anchor(grams: np.ndarray, w: int) -> np.ndarray:
    """The position of the least hash among every ``w`` neighbours, the leftmost of equals."""
    idx, span = np.arange(grams.size), 1
    pick = lambda l, r: np.where(grams[l] <= grams[r], l, r)
    base = idx
    while span * 2 <= w:
        base = pick(base[:-span], base[span:])
        span *= 2
    return pick(base[: grams.size - w + 1], base[w - span: grams.size + 1 - span]) if span < w else base


def _filed(texts: list[bytes | None], window: int, anchor: int):
    """All words of the texts and, for every window that lies in one text: its start, its text and its anchor's position; and the anchor hashes."""
    data, starts, ends, counts = split_words(texts, _SOLID)
    words = hash_words(data, starts, ends)
    owner = np.repeat(np.arange(len(texts)), counts)
    if words.size < window:
        none = np.zeros(0, np.int64)
        return data, starts, ends, counts, words, none, none, none, np.zeros(0, np.uint64)
    grams = hash_grams(words, anchor)
    at = np.arange(words.size - window + 1)
    ok = owner[at] == owner[at + window - 1]
    pos = least_anchor(grams, window - anchor + 1)
    at, pos = at[ok], pos[ok]
    return data, starts, ends, counts, words, at, owner[at], pos, grams


def _survey(window: int, anchor: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in chunks(batches, "text"):
            _, _, _, counts, _, _, owner, pos, grams = _filed(texts, window, anchor)
            hashes, cuts = grams[pos].view(np.int64), np.searchsorted(owner, np.arange(len(texts) + 1))
            anchors, windows = zip(*[np.unique(hashes[cuts[i]:cuts[i + 1]], return_counts=True) for i in range(len(texts))])
            yield pa.RecordBatch.from_arrays([
                part.column(part.schema.get_field_index("doc_id")), pa.array(counts.astype(np.int64)),
                pa.array([hashlib.sha256(t or b"").digest()[:16] for t in texts], pa.binary()),
                pa.array([hashlib.sha256(b" ".join((t or b"").split())).hexdigest() for t in texts], pa.string()),
                pa.array(anchors, pa.list_(pa.int64())), pa.array([w.astype(np.int32) for w in windows], pa.list_(pa.int32())),
            ], names=["doc_id", "n_words", "digest", "whole_sha256", "anchors", "windows"])
    return run


def _segments(window: int, anchor: int):
    """The passages of each text around its repeated anchors, a row each: words for an index, or where the anchor is very frequent the digests of
    the passage's windows, by the part that each belongs to."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in chunks(batches, "text"):
            data, starts, ends, counts, words, at, owner, pos, grams = _filed(texts, window, anchor)
            if not at.size:
                continue
            repeated = part.column(part.schema.get_field_index("anchors"))
            hot = part.column(part.schema.get_field_index("parts"))
            first = np.cumsum(counts) - counts
            keys = grams[pos].view(np.int64)
            new = np.flatnonzero(np.append(True, (keys[1:] != keys[:-1]) | (owner[1:] != owner[:-1]) | (at[1:] != at[:-1] + 1)))
            stop = np.append(new[1:], at.size) - 1
            digest = None
            rows: list[tuple] = []
            known = [dict(zip(a.as_py(), h.as_py())) for a, h in zip(repeated, hot)]
            for key, a, b, o in zip(keys[new].tolist(), at[new].tolist(), at[stop].tolist(), owner[new].tolist()):
                parts = known[o].get(key)
                if parts is None:
                    continue
                if not parts:
                    rows.append((key, 0, o, a - int(first[o]), data[starts[a]:ends[b + window - 1]].tobytes(), None, None, None))
                    continue
                if digest is None:
                    digest = hash_grams(words, window), _second(words, window)
                x, y = digest[0][a:b + 1], digest[1][a:b + 1]
                which = (y % np.uint64(parts)).astype(np.int64)
                for k in np.unique(which).tolist():
                    own = np.flatnonzero(which == k)
                    rows.append((key, k, o, a - int(first[o]), None, own.astype(np.int32), x[own].view(np.int64), y[own].view(np.int64)))
            if rows:
                c = list(zip(*rows))
                at_row, col = pa.array(c[2], pa.int64()), lambda n: part.column(part.schema.get_field_index(n))  # noqa: B023
                yield pa.RecordBatch.from_arrays([
                    pa.array(c[0], pa.int64()), pa.array(c[1], pa.int64()), col("doc_id").take(at_row), col("digest").take(at_row), pa.array(c[3], pa.int64()), pa.array(c[4], pa.binary()),
                    pa.array(c[5], pa.list_(pa.int32())), pa.array(c[6], pa.list_(pa.int64())), pa.array(c[7], pa.list_(pa.int64())),
                ], names=["anchor", "part", "doc_id", "digest", "start", "words", "offsets", "first", "second"])
    return run


def _known(table: dict, x: np.ndarray, y: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> None:
    for k, a, b in zip(zip(x, y), lo, hi):
        old = table.get(k)
        table[k] = (a, b) if old is None else (min(a, old[0]), max(b, old[1]))


def _window_rows(tables: dict) -> pa.RecordBatch:
    out = []
    for (anchor, part), t in tables.items():
        x, y = zip(*t)
        lo, hi = zip(*t.values())
        out.append((anchor, part, x, y, lo, hi))
    long = pa.list_(pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), [pa.int64(), pa.int64(), long, long, long, long])], names=["anchor", "part", "first", "second", "lo", "hi"])


def _first_seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Within a task, the least and greatest document of each window digest, before the shuffle."""
    tables: dict = {}
    size = 0
    for b in batches:
        for anchor, part, doc, x, y in zip(*(b.column(c).to_pylist() for c in ("anchor", "part", "doc_id", "first", "second"))):
            t = tables.setdefault((anchor, part), {})
            size -= len(t)
            _known(t, x, y, [doc] * len(x), [doc] * len(x))
            size += len(t)
        if size > 400_000:
            yield _window_rows(tables)
            tables, size = {}, 0
    if tables:
        yield _window_rows(tables)


def _repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come ordered by anchor and part: the windows that several documents have, with the least of these."""
    at, table = None, {}

    def flush() -> Iterator[pa.RecordBatch]:
        twice = {k: v for k, v in table.items() if v[0] < v[1]}
        if twice:
            yield _window_rows({at: twice}).select(["anchor", "part", "first", "second", "lo"])

    for b in batches:
        for anchor, part, *window in zip(*(b.column(c).to_pylist() for c in ("anchor", "part", "first", "second", "lo", "hi"))):
            if (anchor, part) != at:
                yield from flush()
                at, table = (anchor, part), {}
            _known(table, *window)
    yield from flush()


def _marked(window: int):
    """Rows come ordered by anchor, part and salt, the part's repeated windows before its passages: the words that windows of a smaller document
    cover."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, least = None, {}
        for b in batches:
            out = []
            for *key, lo, doc, text, start, offs, x, y in zip(*(b.column(c).to_pylist() for c in ("anchor", "part", "salt", "lo", "doc_id", "digest", "start", "offsets", "first", "second"))):
                if lo is not None:
                    at, least = key, dict(zip(zip(x, y), lo))
                elif key == at:
                    found = np.array([o for o, k in zip(offs, zip(x, y)) if least.get(k, doc) < doc], np.int64)
                    if found.size:
                        cuts = np.flatnonzero(np.diff(found) > 1)
                        out += [(doc, text, start + int(found[i]), start + int(found[j]) + window) for i, j in zip(np.append(0, cuts + 1), np.append(cuts, found.size - 1))]
            if out:
                c = list(zip(*out))
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.binary() if k == 1 else pa.int64()) for k, x in enumerate(c)], names=["doc_id", "digest", "start", "stop"])
    return run


def _second(words: np.ndarray, k: int) -> np.ndarray:
    """Another 64-bit hash of every window, independent of the first."""
    up, down = _SECOND.get(words.size + 1)
    sums = np.zeros(words.size + 1, np.uint64)
    np.cumsum(mix64(words ^ np.uint64(0x5851F42D4C957F2D)) * up[:-1], out=sums[1:])
    return mix64((sums[k:] - sums[:-k]) * down[: words.size - k + 1])


def shard_matches(rows: list[tuple[int, bytes, int, bytes]], window: int) -> list[tuple[int, bytes, int, int]]:
    """Index the passages (doc_id, text's digest, start, words) of one shard and stream each through it: (doc_id, digest, start, end) of words
    covered by windows that occur in a passage of a smaller doc_id."""
    ids: dict[bytes, int] = {}
    seqs = [np.array([ids.setdefault(w, len(ids)) for w in r[3].replace(b"\0", b" ").split()], np.int64) for r in rows]
    index = FMIndex(seqs, window)
    docs = np.array([r[0] for r in rows], np.int64)
    least = np.minimum.reduceat(docs[index.owner], index.full)  # the smallest document of each run of equal windows
    out = []
    for (doc, text, start, _), ranks in zip(rows, index.window_matches(seqs)):
        found = np.flatnonzero((ranks >= 0) & (least[np.searchsorted(index.full, ranks, side="right") - 1] < doc))
        if found.size:
            breaks = np.flatnonzero(np.diff(found) > 1)
            for a, b in zip(np.append(0, breaks + 1), np.append(breaks, found.size - 1)):
                out.append((doc, text, start + int(found[a]), start + int(found[b]) + window))
    return out


def _shards(window: int, shard_words: int):
    """Rows come ordered by anchor; a shard takes whole anchors until it has enough words."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, bytes, int, bytes]] = []
        size, last = 0, None

        def flush() -> Iterator[pa.RecordBatch]:
            found = shard_matches(held, window) if len(held) > 1 else []
            if found:
                c = list(zip(*found))
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.binary() if k == 1 else pa.int64()) for k, x in enumerate(c)], names=["doc_id", "digest", "start", "stop"])

        for batch in batches:
            for key, doc, text, start, words in zip(*(batch.column(n).to_pylist() for n in ("anchor", "doc_id", "digest", "start", "words"))):
                if size >= shard_words and key != last:
                    yield from flush()
                    held, size = [], 0
                held.append((doc, text, start, words))
                size, last = size + len(words) // 7 + 1, key
        yield from flush()
    return run


def _with_digest(docs: DataFrame) -> DataFrame:
    """doc_id, digest, text: the digest that the survey gives the text."""
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.substring(F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256)), 1, 16).alias("digest"), "text")


@F.pandas_udf(T.ArrayType(T.LongType()))
def merged_spans(starts: pd.Series, stops: pd.Series) -> pd.Series:
    """Overlapping and touching ranges become one; alternating starts and ends."""
    out = []
    for a, b in zip(starts, stops):
        a, b = np.asarray(a, np.int64), np.asarray(b, np.int64)
        order = np.argsort(a, kind="stable")
        a, b = a[order], np.maximum.accumulate(b[order])
        first = np.append(True, a[1:] > b[:-1])
        out.append(np.stack([a[first], b[np.append(first[1:], True)]], 1).ravel())
    return pd.Series(out)


def key_bits(keys: DataFrame, size: int) -> np.ndarray:
    """A bitmap of ``size`` bits (a multiple of 32,768), one set at the hash of each (doc_id, digest); tasks combine theirs before the shuffle."""
    place = keys.select(_place(size).alias("p"))
    parts = place.groupBy(F.shiftright("p", 15).alias("at")).agg(F.bitmap_construct_agg(F.col("p").bitwiseAND(F.lit(32767))).alias("bits"))
    bits = np.zeros(size // 8, np.uint8)
    for r in parts.collect():
        bits[r["at"] * 4096:(r["at"] + 1) * 4096] = np.frombuffer(bytes(r["bits"]), np.uint8)
    return bits


def _place(size: int) -> Column:
    return F.pmod(F.xxhash64("doc_id", "digest"), F.lit(size).cast("bigint"))


def may_be_among(keys: DataFrame) -> Column:
    """Whether a row may have one of ``keys``; rows that can't need no shuffle. True for about 6 % of those that haven't (more beyond
    MOST_BITS), so a join has to decide."""
    size = min(MOST_BITS, -(-max(1, FILTER_BITS * keys.count()) // 32768) * 32768)
    bits = keys.sparkSession.sparkContext.broadcast(key_bits(keys, size))

    @F.pandas_udf(T.BooleanType())
    def may(place: pd.Series) -> pd.Series:
        p = place.to_numpy(np.int64)
        return pd.Series((bits.value[p >> 3] >> (p & 7).astype(np.uint8) & 1).astype(bool))

    return may(_place(size))


def _likely(base: DataFrame, keys: DataFrame) -> DataFrame:
    """``base`` without most of the rows that have none of ``keys``, so their texts aren't shuffled."""
    return base.where(may_be_among(keys))


def originals(seen: DataFrame, gone: DataFrame) -> DataFrame:
    """The rows of ``seen`` that have windows and aren't ``gone`` (keys of whole copies). Only rows that may be copies are shuffled, not the
    anchors of all texts; rows that repeat an id and its text all stay."""
    d = seen.where(F.col("doc_id").isNotNull() & (F.size("anchors") > 0))
    may = may_be_among(gone)
    return d.where(~may).unionByName(d.where(may).join(gone, ["doc_id", "digest"], "left_anti").select(*d.columns))


def survey(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """doc_id, n_words, digest, whole_sha256, anchors and the number of windows filed under each, of every document."""
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(_survey(window, anchor), "doc_id bigint, n_words bigint, digest binary, whole_sha256 string, anchors array<bigint>, windows array<int>")


def repeated_spans(docs: DataFrame, seen: DataFrame, gone: DataFrame, window: int = WINDOW, anchor: int = ANCHOR, hot_windows: int = HOT_WINDOWS) -> tuple[DataFrame, DataFrame]:
    """(spans, texts): doc_id, digest, spans (removed words as alternating starts and ends) and the texts that were looked at.

    Only the first document of equal texts is looked at; the others, ``gone``, are removed whole. A document is an id with one text: an id
    with several texts is that many documents.
    """
    spark = docs.sparkSession
    own = originals(seen, gone).select("doc_id", "digest", F.explode(F.arrays_zip("anchors", "windows")).alias("x")).select("doc_id", "digest", F.col("x.anchors").alias("anchor"), F.col("x.windows").alias("windows"))
    often = own.groupBy("anchor").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"), F.sum("windows").alias("n")).where("lo <> hi")
    dealt = F.when(F.col("n") > hot_windows, F.ceil(F.col("n") / HOT_PART)).otherwise(F.lit(0)).cast("bigint")
    often = cut(often.select("anchor", dealt.alias("parts")))  # read for the marks and the salts
    # dealt by both, kept apart from `own`, whose hot anchors may be split
    marks = own.join(often.repartition("parts", "anchor"), "anchor").groupBy("doc_id", "digest").agg(F.collect_set(F.struct("anchor", "parts")).alias("x"))
    marks = marks.select("doc_id", "digest", F.col("x.anchor").alias("anchors"), F.col("x.parts").alias("parts"))
    base = _with_digest(docs.where(F.col("text").isNotNull()))
    marks = cut(marks)  # read for the filter and the join
    texts = cut(_likely(base, marks).join(marks, ["doc_id", "digest"]).dropDuplicates(["doc_id", "digest"]))
    parts = cut(texts.mapInArrow(_segments(window, anchor), "anchor bigint, part bigint, doc_id bigint, digest binary, start bigint, words binary, offsets array<int>, first array<bigint>, second array<bigint>"))

    cold = parts.where(F.col("words").isNotNull()).repartition(shuffle_partitions(spark), "anchor").sortWithinPartitions("anchor", "doc_id", "start")
    found = cold.select("anchor", "doc_id", "digest", "start", "words").mapInArrow(_shards(window, SHARD_WORDS), "doc_id bigint, digest binary, start bigint, stop bigint")
    hot = parts.where(F.col("words").isNull()).drop("words")
    windows = "anchor bigint, part bigint, first array<bigint>, second array<bigint>, lo array<bigint>"
    seen_first = hot.select("anchor", "part", "doc_id", "first", "second").mapInArrow(_first_seen, windows + ", hi array<bigint>")
    twice = seen_first.repartition("anchor", "part").sortWithinPartitions("anchor", "part").mapInArrow(_repeated, windows)
    # a frequent anchor's passages are dealt to as many salts as it has parts, and so is what they look up
    salts = often.where("parts > 0")
    held = twice.join(salts, "anchor").withColumn("salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1))).drop("parts")
    seeking = hot.join(salts, "anchor").withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.col("parts"))).drop("parts")
    both = held.unionByName(seeking, allowMissingColumns=True).repartition("anchor", "part", "salt").sortWithinPartitions("anchor", "part", "salt", F.col("lo").isNull())
    again = both.mapInArrow(_marked(window), "doc_id bigint, digest binary, start bigint, stop bigint")
    spans = found.unionByName(again).groupBy("doc_id", "digest").agg(F.collect_list(F.struct("start", "stop")).alias("s"))
    return cut(spans.select("doc_id", "digest", merged_spans("s.start", "s.stop").alias("spans"))), texts


@F.pandas_udf(T.StringType())
def kept_sha256(text: pd.Series, spans: pd.Series) -> pd.Series:
    out = []
    for t, s in zip(text, spans):
        words, kept, at = t.encode().split(), [], 0
        for a, b in zip(s[::2], s[1::2]):
            kept += words[at:a]
            at = b
        out.append(hashlib.sha256(b" ".join(kept + words[at:])).hexdigest())
    return pd.Series(out)


def _copies(seen: DataFrame, window: int) -> DataFrame:
    """doc_id, digest of documents of at least a window whose whole text a smaller doc_id has."""
    known = seen.where(F.col("doc_id").isNotNull() & (F.col("n_words") >= window)).select("doc_id", "digest")
    first = known.groupBy("digest").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo <> hi").select("digest", "lo").repartition("lo")
    return known.join(first, "digest").where("lo < doc_id").select("doc_id", "digest").distinct()


def dedup_report(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 for every document.

    Words are maximal runs of anything but space and U+0009 to U+000D. A word is removed if it lies in a window of ``window`` words whose
    words, in order, also start in a document with a smaller doc_id. Null texts have no words. A row without doc_id loses nothing and takes
    nothing from others. Rows that repeat a doc_id with differing texts are judged each, and take from documents of larger ids each. Windows inside one document do not count against each other.

    1. Each text is read once for its anchors: of the hashes of its 26-word runs, the least in each window, about one in 13 words.
    2. Anchors that lie in different texts are kept (hash collisions only add work); only the passages around those go on.
    3. Passages are filed under their anchor. Shards of whole anchors build an FM-index of words over their passages and stream each passage
       through it. The windows of an anchor with more than HOT_WINDOWS are compared by 128-bit digests instead, a row for each passage and part:
       tasks combine them before the shuffle, and the windows that several documents have go back to the passages.
    """
    seen = cut(survey(docs, window))
    copies = cut(_copies(seen, window))
    spans, texts = repeated_spans(docs, seen, copies, window)
    done = spans.join(texts.select("doc_id", "digest", "text"), ["doc_id", "digest"]).select("doc_id", "digest", "spans", kept_sha256("text", "spans").alias("cut_sha256"))
    n = F.aggregate(F.transform("spans", lambda x, i: F.when(i % 2 == 0, -x).otherwise(x)), F.lit(0).cast("bigint"), lambda a, x: a + x)
    gone = copies.withColumn("copy", F.lit(True))
    out = seen.select("doc_id", "digest", "n_words", "whole_sha256").join(gone, ["doc_id", "digest"], "left").join(done.select("doc_id", "digest", n.alias("n"), "cut_sha256"), ["doc_id", "digest"], "left")
    none = hashlib.sha256(b"").hexdigest()
    return out.select(
        "doc_id", "n_words", F.when(F.col("copy"), F.col("n_words")).otherwise(F.coalesce("n", F.lit(0))).cast("bigint").alias("n_removed"),
        F.when(F.col("copy"), F.lit(none)).otherwise(F.coalesce("cut_sha256", "whole_sha256")).alias("kept_sha256"))


@F.pandas_udf(T.StringType())
def without_words(text: pd.Series, spans: pd.Series) -> pd.Series:
    """The text without each span, from its first word's first byte to its last word's last."""
    out = []
    for t, s in zip(text, spans):
        if t is None or s is None or not len(s):
            out.append(t)
            continue
        raw = t.encode()
        _, starts, ends, _ = split_words([raw], _SOLID)
        kept, at = [], 0
        for a, b in zip(s[::2], s[1::2]):
            kept.append(raw[at:starts[a]])
            at = ends[b - 1]
        out.append(b"".join([*kept, raw[at:]]).decode().strip())
    return pd.Series(out)


def remove_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """``docs`` with the repeated words cut from ``text`` (and ``n_chars``, if there, counted anew). A whole copy keeps its row with an
    empty text; untouched documents keep their text as it is."""
    seen = cut(survey(docs, window))
    copies = cut(_copies(seen, window))
    spans, _ = repeated_spans(docs, seen, copies, window)
    todo = spans.withColumn("copy", F.lit(False)).unionByName(copies.select("doc_id", "digest", F.lit(None).cast("array<bigint>").alias("spans"), F.lit(True).alias("copy")))
    todo = todo.groupBy(F.col("doc_id").alias("_id"), F.col("digest").alias("_digest")).agg(F.max("copy").alias("_copy"), F.first("spans", ignorenulls=True).alias("_spans"))
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc")
    d = docs.select(whole, F.col("doc_id").cast("bigint").alias("_id"), F.substring(F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256)), 1, 16).alias("_digest")).join(todo, ["_id", "_digest"], "left")
    old = F.col("doc.text")
    touched = F.col("_copy").isNotNull() & old.isNotNull()
    text = F.when(~touched, old).when(F.col("_copy"), F.lit("")).otherwise(without_words("doc.text", "_spans"))
    d = d.select("doc", touched.alias("touched"), text.alias("text"))
    new = {"text": F.col("text"), "n_chars": F.when(F.col("touched"), F.char_length("text")).otherwise(F.col("doc.n_chars")) if "n_chars" in docs.columns else None}
    return d.select(*[(new[c].cast(docs.schema[c].dataType) if c in new else F.col(f"doc.`{c}`")).alias(c) for c in docs.columns])

"""Near duplicates by ProbMinHash: signatures of weighted word shingles, banding, exact verification, components."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from lumensift.llm.common import bytes_table, chunks, cut, hash_grams, hash_words, mix64, split_words
from lumensift.llm.components import components

_ALNUM = bytes_table("alnum")
SHINGLE, THRESHOLD = 5, 0.8
#: Bands and components of a band: two documents of similarity s meet with probability 1 - (1 - s**ROWS)**BANDS, over 1 - 3e-6 at 0.8. That
#: holds for each part of the similarity, since texts have bands of both kinds of signature (``search_keys``).
BANDS, ROWS = 32, 5
#: Members of a cell, and bytes of their shingles: what one task compares at a time. A larger group is cut into blocks, of which two meet in a cell.
CELL, CELL_BYTES = 4096, 128 << 20


def shingles(texts: list[bytes | None], k: int = SHINGLE) -> list[tuple[np.ndarray, np.ndarray]]:
    """Hashes of each text's distinct word shingles, in order, and how often each occurs; a text of fewer words is one shingle."""
    data, starts, ends, counts = split_words(texts, _ALNUM)
    words, out, at = hash_words(data, starts, ends), [], 0
    for n in counts:
        own, at = words[at:at + n], at + n
        out.append(np.unique(hash_grams(own, min(k, n)), return_counts=True) if n else (np.zeros(0, np.uint64), np.zeros(0, np.int64)))
    return out


def signatures(sets: list[tuple[np.ndarray, np.ndarray]], m: int = BANDS * ROWS) -> np.ndarray:
    """ProbMinHash signatures, a row of ``m`` shingle hashes for each weighted set (Ertl 2020; an empty set's row is meaningless).

    Every shingle's arrivals are a Poisson process whose rate is its share of the weight; each arrival goes to a component at random, and
    a component keeps the shingle that arrives first. Two sets agree in a component with the probability Jaccard similarity. A shingle's
    process ends early, once it is later than the latest first arrival of its set. Arrivals are drawn in growing blocks for all sets at once.
    """
    d = len(sets)
    sizes = np.array([s[0].size for s in sets], np.int64)
    owner = np.repeat(np.arange(d), sizes)
    x = np.concatenate([s[0] for s in sets]) if d else np.zeros(0, np.uint64)
    w = np.concatenate([s[1] for s in sets]).astype(float) if d else np.zeros(0)
    rate = w / np.maximum(1.0, np.bincount(owner, w, minlength=d))[owner]
    first, sig = np.full(d * m, np.inf), np.zeros(d * m, np.uint64)
    clock, drawn, block = np.zeros(x.size), 0, 1
    while x.size:
        j = np.arange(drawn, drawn + block, dtype=np.uint64)
        u = mix64(x[:, None] + (j + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))
        step = -np.log(((u >> np.uint64(12)).astype(float) + 0.5) * 2.0**-52) / rate[:, None]
        t = clock[:, None] + np.cumsum(step, 1)
        at = owner[:, None] * m + (mix64(u) % np.uint64(m)).astype(np.int64)
        late = first.reshape(d, m).max(1)[owner]
        use = t <= late[:, None]
        ti, ai = t[use], at[use]
        np.minimum.at(first, ai, ti)
        won = first[ai] == ti
        sig[ai[won]] = np.broadcast_to(x[:, None], t.shape)[use][won]
        clock = t[:, -1]
        live = clock <= first.reshape(d, m).max(1)[owner]
        x, owner, rate, clock = x[live], owner[live], rate[live], clock[live]
        drawn, block = drawn + block, min(64, block * 2)
    return sig.reshape(d, m)


def band_keys(sig: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """One 64-bit key for each band of each signature."""
    h = np.tile(np.arange(bands, dtype=np.uint64), (len(sig), 1))
    parts = sig.reshape(len(sig), bands, rows)
    for r in range(rows):
        h = mix64(h * np.uint64(0x9E3779B97F4A7C15) + parts[:, :, r])
    return h.view(np.int64)


def search_keys(sets: list[tuple[np.ndarray, np.ndarray]]) -> list[np.ndarray]:
    """The sorted band keys of each (not empty) weighted set: of its signature by counts and of that with all weights 1.

    The first find pairs of a high probability Jaccard similarity, the second those of a high Jaccard similarity of the sets. Where all
    shingles occur equally often, the two signatures are the same and the set has BANDS keys, otherwise up to twice as many.
    """
    keys = list(band_keys(signatures(sets)))
    uneven = [i for i, s in enumerate(sets) if s[1].min() < s[1].max()]
    for i, plain in zip(uneven, band_keys(signatures([(sets[i][0], np.ones_like(sets[i][1])) for i in uneven]))):
        keys[i] = np.concatenate([keys[i], plain])
    return [np.unique(k) for k in keys]


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """The larger of the exact probability Jaccard similarity of the weighted shingles and the Jaccard similarity of their sets."""
    (x, v), (y, w) = a, b
    both, i, j = np.intersect1d(x, y, assume_unique=True, return_indices=True)
    if not both.size:
        return 0.0
    plain = both.size / (x.size + y.size - both.size)
    p, q = v / v.sum(), w / w.sum()
    # sum over common shingles of 1 / sum_y max(p_y / p_x, q_y / q_x): the inner sums follow from the order of the ratios p/q
    pi, qi = p[i], q[j]
    ratio = pi / qi
    order = np.argsort(ratio, kind="stable")
    r, ps, qs = ratio[order], pi[order], qi[order]
    # a common y counts p_y / p_x where its ratio exceeds that of x, else q_y / q_x; what only one side has counts on its own side
    above_p = np.append(np.cumsum(ps[::-1])[::-1], 0.0)
    upto_q = np.append(0.0, np.cumsum(qs))
    k = np.searchsorted(r, r, side="right")
    only_p, only_q = 1.0 - ps.sum(), 1.0 - qs.sum()
    prob = float(np.sum(1.0 / ((above_p[k] + only_p) / ps + (upto_q[k] + only_q) / qs)))
    return max(plain, prob)


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part, texts in chunks(batches, "text", 1 << 19):
        sets = shingles(texts)
        some = [i for i, s in enumerate(sets) if s[0].size]
        keys = search_keys([sets[i] for i in some])
        row = dict(zip(some, range(len(some))))
        yield pa.RecordBatch.from_arrays([
            part.column(part.schema.get_field_index("doc_id")),
            pa.array([None if t is None else hashlib.blake2b(t, digest_size=16).digest() for t in texts], pa.binary()),
            pa.array([keys[row[i]] if i in row else [] for i in range(len(texts))], pa.list_(pa.int64())),
        ], names=["doc_id", "digest", "keys"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Shingles of the rows whose text has the digest that is sought (an id may have several texts)."""
    for part, texts in chunks(batches, "text"):
        sought = part.column(part.schema.get_field_index("node")).to_pylist()
        mine = [i for i, t in enumerate(texts) if hashlib.blake2b(t, digest_size=16).digest() == sought[i]]
        sets = shingles([texts[i] for i in mine])
        yield pa.RecordBatch.from_arrays([
            pa.array([sought[i] for i in mine], pa.binary()), pa.array([s[0].tobytes() for s in sets], pa.binary()), pa.array([s[1].astype("<u4").tobytes() for s in sets], pa.binary()),
        ], names=["node", "shingles", "counts"])


def _similar(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        col = {n: batch.column(n) for n in batch.schema.names}
        sims = []
        for i in range(batch.num_rows):
            get = lambda s, c: np.frombuffer(col[f"shingles_{s}"][i].as_py(), np.uint64) if c == "x" else np.frombuffer(col[f"counts_{s}"][i].as_py(), "<u4").astype(float)  # noqa: B023, E731
            sims.append(similarity((get("a", "x"), get("a", "w")), (get("b", "x"), get("b", "w"))))
        yield pa.RecordBatch.from_arrays([col["a"], col["b"], pa.array(sims, pa.float64())], names=["a", "b", "similarity"])


def _verified(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) whose exact similarity reaches ``threshold``."""
    side = lambda s: sets.select(F.col("node").alias(s), F.col("shingles").alias(f"shingles_{s}"), F.col("counts").alias(f"counts_{s}"))
    full = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "shingles_a", "counts_a", "shingles_b", "counts_b")
    return full.mapInArrow(_similar, "a binary, b binary, similarity double").where(F.col("similarity") >= threshold)


def cell_links(members: list[tuple], threshold: float, one_block: bool = True) -> list[tuple[int, int]]:
    """Links between the members (component, block, shingles, counts) of one cell, at most one less than there are components: pairs of
    positions whose exact similarity reaches ``threshold`` and that connect what wasn't connected.

    Each member meets all later ones of other components at once: their rows lie one after the other in one sparse matrix, whose entries are
    looked up in the member's. The Jaccard similarity of the sets follows for all of them. Where counts differ, the sums of min and max of both
    distributions over common shingles bound the probability Jaccard similarity: a common shingle adds at most max(p, q) / sum of max, as
    max(p_y / p_x, q_y / q_x) >= max(p_y, q_y) / max(p_x, q_x). Only pairs that pass it are computed one by one.
    """
    comps, blocks, sets, counts = zip(*members)
    n, sizes = len(members), np.array([x.size for x in sets], np.int64)
    _, col = np.unique(np.concatenate(sets), return_inverse=True)
    start = np.cumsum(sizes) - sizes
    weight = np.concatenate([c / c.sum() for c in counts])
    uneven = np.array([c.min() < c.max() for c in counts])
    block = np.array(blocks)
    ids: dict = {}
    root = np.array([ids.setdefault(c, len(ids)) for c in comps])
    have, p = np.zeros(int(col.max()) + 1, np.int32), np.zeros(int(col.max()) + 1)
    links = []
    for i in range(n - 1):
        other = root[i + 1:] != root[i]
        if not one_block:
            other &= block[i + 1:] != block[i]
        if not other.any():
            continue
        a = start[i + 1]
        own = slice(start[i], start[i] + sizes[i])
        have[col[own]] = 1
        both = np.add.reduceat(have[col[a:]], start[i + 1:] - a)
        union = sizes[i] + sizes[i + 1:] - both
        linked = other & (both / union >= threshold)
        maybe = other & ~linked & (both > 0) & (uneven[i + 1:] | uneven[i])
        if maybe.any():
            p[col[own]] = weight[own]
            mine, theirs, cuts = p[col[a:]], weight[a:], start[i + 1:] - a
            least = np.add.reduceat(np.minimum(mine, theirs), cuts)
            common = np.add.reduceat(mine, cuts) + np.add.reduceat(np.where(mine > 0, theirs, 0.0), cuts)
            maybe &= (common - least) / (2.0 - least) >= threshold - 1e-9
            p[col[own]] = 0.0
        have[col[own]] = 0
        for j in np.flatnonzero(linked) + i + 1:
            if root[j] != root[i]:
                links.append((i, int(j)))
                root[root == root[j]] = root[i]
        for j in np.flatnonzero(maybe) + i + 1:
            if root[j] != root[i] and similarity((sets[i], counts[i]), (sets[j], counts[j])) >= threshold:
                links.append((i, int(j)))
                root[root == root[j]] = root[i]
    return links


def _compare(threshold: float):
    """Rows come ordered by cell; links are between components."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, held = None, []

        def flush() -> Iterator[pa.RecordBatch]:
            found = cell_links(held, threshold, cell[1] == cell[2]) if len({h[0] for h in held}) > 1 else []
            if found:
                yield pa.RecordBatch.from_arrays([pa.array([held[x[k]][0] for x in found], pa.binary()) for k in (0, 1)], names=["a", "b"])

        for batch in batches:
            for *key, comp, own, x, w in zip(*(batch.column(c).to_pylist() for c in ("cell", "i", "j", "comp", "own", "shingles", "counts"))):
                if key != cell:
                    if held:
                        yield from flush()
                    cell, held = key, []
                held.append((comp, own, np.frombuffer(x, np.uint64), np.frombuffer(w, "<u4").astype(float)))
        if held:
            yield from flush()
    return run


def _cells(open_: DataFrame, rounds: int = 2) -> DataFrame:
    """cell, node: what to compare so that all members of each open bucket (key, node) meet.

    The bands of one set of near copies give many large buckets of nearly the same members; one cell of them all replaces these. So nodes take
    the least label of their buckets' members a few times, and a bucket whose members end with one label belongs to that group; the others,
    which merely touch, are cells of their own. A group stays in one cell where that makes fewer pairs than its buckets, by the squares of
    the sizes. Any labels give the same links.
    """
    label = open_.select("node", F.col("node").alias("label")).distinct()
    for k in range(rounds):
        here = open_.join(label.hint("merge"), "node") if k else open_.withColumn("label", F.col("node"))
        least = here.groupBy("key").agg(F.min("label").alias("label"))
        label = open_.join(least.hint("merge"), "key").groupBy("node").agg(F.min("label").alias("label"))
    label = cut(label)
    bucket = open_.join(label.hint("merge"), "node").groupBy("key").agg(F.min("label").alias("label"), F.max("label").alias("_hi"), F.count(F.lit(1)).alias("n"))
    bucket = bucket.withColumn("one", F.col("label") == F.col("_hi")).withColumn("square", F.col("n").cast("double") * F.col("n"))
    cost = bucket.where("one").groupBy("label").agg(F.sum("square").alias("apart"))
    size = label.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    whole = cut(size.join(cost.hint("merge"), "label").where(F.col("n").cast("double") * F.col("n") <= F.col("apart")).select("label"))
    apart = bucket.join(whole.withColumn("_w", F.lit(True)).hint("merge"), "label", "left").where(~F.col("one") | F.col("_w").isNull()).select("key")
    grouped = label.join(whole.hint("merge"), "label").select(F.col("label").alias("cell"), "node")
    return grouped.unionByName(open_.join(apart.hint("merge"), "key").select(F.col("key").cast("string").cast("binary").alias("cell"), "node"))


def classes(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, class_id for every row: the smallest doc_id among all documents connected by links of similarity ``threshold`` or more.

    Words are lower-cased runs of digits, letters and non-ASCII characters; shingles are five words, weighted by count. Equal texts are one
    class whatever their length (no text or letters included); a null text stands alone; a row without doc_id has class null. Rows that
    repeat a doc_id are one document if their texts are equal; differing texts of one id join their classes.

    1. Each text is signed in its task; equal texts (by 128-bit digest) are one node from then on, whatever ids they have.
    2. Each node is verified against one leader: of the most central members of its buckets (those with the fullest buckets), the one
       it shares most buckets with.
    3. Buckets whose members are connected are done. The members of others meet in cells (``_cells``), where a task verifies members of different
       components exactly and keeps track of what it connects; a cell gives fewer links than it has members. Nothing is capped.
    """
    base = docs.select("doc_id", "text")
    kind = base.schema["doc_id"].dataType.simpleString()
    signed = cut(base.mapInArrow(_sign, f"doc_id {kind}, digest binary, keys array<bigint>"))
    named = signed.where(F.col("digest").isNotNull() & F.col("doc_id").isNotNull())
    reps = named.groupBy("digest").agg(F.min("doc_id").alias("rep"))
    own = cut(named.where(F.size("keys") > 0).join(reps, (named["digest"] == reps["digest"]) & (F.col("doc_id") == F.col("rep")), "left_semi").dropDuplicates(["digest"]).select(F.col("digest").alias("node"), "doc_id", "keys"))
    bands = own.select("node", F.explode("keys").alias("key"))
    shared = bands.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    shared = shared.repartition("n", "key")  # few rows; kept apart from the bands' partitioning, so that a large bucket can be split below
    met = cut(bands.join(shared, "key").select("key", "node", "n"))
    # whole shingle sets only for texts that share a bucket
    central = cut(met.groupBy("node").agg(F.sum("n").alias("reach")))
    some = own.join(central.select("node"), "node").select("node", "doc_id")
    sets = cut(base.where(F.col("text").isNotNull()).join(some, "doc_id").select("node", "text").mapInArrow(_sets, "node binary, shingles binary, counts binary").dropDuplicates(["node"]))

    leaders = met.join(central, "node").groupBy("key").agg(F.min_by("node", F.struct(-F.col("reach"), F.col("node"))).alias("leader")).repartition("leader", "key")
    count = met.join(leaders, "key").where("node <> leader").groupBy("node", "leader").agg(F.count(F.lit(1)).alias("n"))
    best = count.groupBy(F.col("node").alias("a")).agg(F.min_by("leader", F.struct(-F.col("n"), F.col("leader"))).alias("b"))
    links = cut(_verified(best, sets, threshold).select("a", "b"))
    comp = components(links)

    placed = met.join(comp.hint("merge"), "node", "left").select("key", "node", F.coalesce("comp", "node").alias("comp"))
    mixed = placed.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count(F.lit(1)).alias("n")).where("lo <> hi").select("key", "n").repartition("n", "key")
    open_ = cut(placed.join(mixed, "key").select("key", "node", "comp"))
    cells = cut(_cells(open_.select("key", "node")))
    weight = cells.join(sets.select("node", F.octet_length("shingles").alias("bytes")), "node").groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.sum("bytes").alias("bytes"))
    by_count = F.when(F.col("n") > CELL, F.ceil(2 * F.col("n") / CELL)).otherwise(F.lit(1))
    blocks = weight.select("cell", F.greatest(by_count, F.when(F.col("bytes") > CELL_BYTES, F.ceil(2 * F.col("bytes") / CELL_BYTES)).otherwise(F.lit(1))).cast("int").alias("blocks")).repartition("blocks", "cell")
    rows = cells.join(blocks.hint("merge"), "cell").join(open_.select("node", "comp").distinct().hint("merge"), "node").withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select("cell", "node", "comp", "own", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j")).join(sets, "node")
    ordered = rows.repartition("cell", "i", "j").sortWithinPartitions("cell", "i", "j")
    more = ordered.select("cell", "i", "j", "comp", "own", "shingles", "counts").mapInArrow(_compare(threshold), "a binary, b binary")
    one_id = _one_id(named)
    for side in "ab":
        one_id = one_id.join(comp.select(F.col("node").alias(side), F.col("comp").alias("_c")).hint("merge"), side, "left").withColumn(side, F.coalesce("_c", side)).drop("_c")
    wider = components(cut(more).unionByName(one_id))
    root = wider.select(F.col("node").alias("comp"), F.col("comp").alias("root"))
    comp = comp.join(root.hint("merge"), "comp", "left").select("node", F.coalesce("root", "comp").alias("comp")).unionByName(wider.join(comp.select("node").hint("merge"), "node", "left_anti"))

    # the class is named after the smallest id of its texts
    comp = comp.join(reps.withColumnRenamed("digest", "node").hint("merge"), "node")
    least = comp.groupBy("comp").agg(F.min("rep").alias("class_id"))
    of_text = comp.join(least.hint("merge"), "comp").select(F.col("node").alias("digest"), "class_id")
    of_text = reps.join(of_text.hint("merge"), "digest", "left").select("digest", F.coalesce("class_id", "rep").alias("class_id"))
    out = signed.select("doc_id", "digest").join(of_text.hint("merge"), "digest", "left")
    return out.select("doc_id", F.when(F.col("doc_id").isNotNull(), F.coalesce("class_id", "doc_id")).alias("class_id"))


def _one_id(named: DataFrame) -> DataFrame:
    """(a, b): the texts of an id that has several, each linked to the first."""
    several = named.groupBy("doc_id").agg(F.min("digest").alias("a"), F.max("digest").alias("_hi")).where("a <> _hi").select("doc_id", "a")
    return named.select("doc_id", F.col("digest").alias("b")).join(several, "doc_id").select("a", "b").where("a <> b").distinct()


def keep_one(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The document of every class that has its smallest id; documents without an id and null texts stay. Columns stay as they are."""
    gone = classes(docs, threshold).where(F.col("doc_id") != F.col("class_id")).select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])

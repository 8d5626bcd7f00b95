"""Quality rules whose thresholds adapt: mergeable quantile sketches per language and source give fences, documents are joined with theirs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from lumensift.llm.common import bytes_table, chunks, cut, hash_grams, hash_words, split_words

MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
#: A group (language and source) with fewer documents than this takes the sketch of its language, then that of all documents.
MIN_GROUP = 200
#: Leading bits that a sketch keeps of a value: a quantile is right to 1 part in 2**(SKETCH_BITS - 1).
SKETCH_BITS = 7
#: The rules: name, numerator, denominator, sides judged, room; a document's value is floor(1000 * numerator / denominator). A value within
#: ``room`` of its group's median passes, so that a group whose values are all alike has no fence at their very edge.
RULES = (
    ("word_length", "word_chars", "n_words", ("low", "high"), 2000),
    ("symbols", "n_symbols", "n_words", ("high",), 100),
    ("dup_lines", "n_dup_lines", "n_lines", ("high",), 400),
    ("repeats", "n_repeat_words", "n_words", ("high",), 300),
)
#: A fence is also this many quartile ranges beyond the quartile at least. Junk moves no fence while it is less than a quarter of the group.
FENCE = 3

_SOLID = bytes_table("solid")
_SYMBOL = np.isin(np.arange(256), np.frombuffer(b"#*$%&|<>", np.uint8))
_BLANK = b" \t\n\x0b\x0c\r"


def repeated_words(words: np.ndarray, k: int = 3) -> int:
    """How many of the (hashed) words lie in a window of ``k`` that occurs twice or more."""
    grams = hash_grams(words, k)
    if grams.size < 2:
        return 0
    _, where, often = np.unique(grams, return_inverse=True, return_counts=True)
    edge = np.zeros(words.size + 1, np.int64)
    starts = np.flatnonzero(often[where] > 1)
    edge[starts] += 1
    edge[starts + k] -= 1
    return int((np.cumsum(edge) > 0).sum())


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part, texts in chunks(batches, "text"):
        data, starts, ends, counts = split_words(texts, _SOLID)
        hashes = hash_words(data, starts, ends)
        heads = np.append(0, np.cumsum(((data & 0xC0) != 0x80) & (data != 0)))  # bytes that begin a code point, inside words
        symbols = np.append(0, np.cumsum(_SYMBOL[data]))
        rows, at = [], 0
        for t, n in zip(texts, counts):
            lines = [x for x in (t or b"").split(b"\n") if x.strip(_BLANK)]
            s, e = starts[at:at + n], ends[at:at + n]
            chars, signs = (int(v[e[-1]] - v[s[0]]) if n else 0 for v in (heads, symbols))
            rows.append((int(n), chars, signs, len(lines) - len(set(lines)), repeated_words(hashes[at:at + n]), len(lines)))
            at += n
        yield pa.RecordBatch.from_arrays(
            [part.column(part.schema.get_field_index(c)) for c in ("doc_id", "lang", "source")] + [pa.array(c, pa.int64()) for c in (zip(*rows) if rows else [[]] * 6)],
            names=["doc_id", "lang", "source", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines"])


def measures(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source and the counts of each text: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines (lines with a word)."""
    base = docs.select("doc_id", "text", "lang", "source")
    kinds = ", ".join(f"{c} {base.schema[c].dataType.simpleString()}" for c in ("doc_id", "lang", "source"))
    return base.mapInArrow(_measure, kinds + ", n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, n_lines bigint")


def rule_values() -> Column:
    """An array of (rule, value); a rule without denominator has no value."""
    one = [F.struct(F.lit(r).alias("rule"), F.when(F.col(d) > 0, F.expr(f"(1000 * {n}) div {d}")).alias("value")) for r, n, d, *_ in RULES]
    return F.filter(F.array(*one), lambda x: x["value"].isNotNull())


def sketch_bucket(value: Column, bits: int = SKETCH_BITS) -> Column:
    """The smallest number whose leading ``bits`` bits and length are those of ``value``: all numbers of a bucket share it."""
    extra = F.greatest(F.lit(0), F.length(F.bin(value)) - bits)
    return (F.floor(value / F.pow(F.lit(2.0), extra)) * F.pow(F.lit(2.0), extra)).cast("bigint")


def sketches(measured: DataFrame) -> DataFrame:
    """lang, source, rule, bucket, n: a sketch is the count of each bucket. Sketches of disjoint rows merge by adding counts, in any order, to
    just the sketch of all the rows; so tasks combine before the shuffle and a group of any size is a few hundred rows."""
    rows = measured.select("lang", "source", F.explode(rule_values()).alias("x"))
    return rows.groupBy("lang", "source", F.col("x.rule").alias("rule"), sketch_bucket(F.col("x.value")).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def merged(sketch: DataFrame, *keys: str) -> DataFrame:
    """The sketches of coarser groups (some of ``lang``, ``source``)."""
    return sketch.groupBy(*keys, "rule", "bucket").agg(F.sum("n").alias("n"))


def fences(sketch: DataFrame, *keys: str) -> DataFrame:
    """Per group and rule: size, low and high fence. Quantiles are bucket values at ranks ceil(q * n); a high fence is the larger of
    Q3 + FENCE * (Q3 - Q1) and the median plus the rule's room, up to the end of a bucket; a low one mirrors it."""
    group = [*keys, "rule"]
    upto = W.partitionBy(*group).orderBy("bucket")
    ranked = sketch.withColumn("upto", F.sum("n").over(upto)).withColumn("size", F.sum("n").over(W.partitionBy(*group)))
    at = lambda p: F.min(F.when(F.col("upto") * 1000 >= p * F.col("size"), F.col("bucket")))
    q = ranked.groupBy(*group).agg(F.max("size").alias("size"), at(250).alias("q1"), at(500).alias("q2"), at(750).alias("q3"))
    width = F.expr(f"q3 div {1 << (SKETCH_BITS - 1)} + 1")  # a bucket's width at most
    spread = FENCE * (F.col("q3") - F.col("q1"))
    room = F.create_map(*[F.lit(x) for r in RULES for x in (r[0], r[4])])[F.col("rule")]
    high = F.greatest(F.col("q3") + spread, F.col("q2") + room) + width
    return q.select(*group, "size", F.least(F.col("q1") - spread, F.col("q2") - room).alias("low"), high.alias("high"))


def thresholds(measured: DataFrame) -> DataFrame:
    """lang, source and for every rule <rule>_low and <rule>_high: of the group itself if it has MIN_GROUP documents, else of its language, else of
    all. One row for each language and source that occurs."""
    base = cut(sketches(measured))
    levels = [fences(base, "lang", "source"), fences(merged(base, "lang"), "lang"), fences(merged(base))]
    t = base.select("lang", "source").distinct().withColumn("rule", F.explode(F.array(*[F.lit(r[0]) for r in RULES])))
    for k, (level, keys) in enumerate(zip(levels, (("lang", "source"), ("lang",), ()))):
        other = level.select(*[F.col(c).alias(f"_{c}") for c in keys], F.col("rule").alias("_rule"), F.struct("size", "low", "high").alias(f"f{k}"))
        on = F.col("rule") == F.col("_rule")
        for c in keys:
            on &= F.col(c).eqNullSafe(F.col(f"_{c}"))
        t = t.join(other, on, "left").drop("_rule", *[f"_{c}" for c in keys])
    enough = lambda k: F.when(F.col(f"f{k}.size") >= MIN_GROUP, F.col(f"f{k}"))
    t = t.select("lang", "source", "rule", F.coalesce(enough(0), enough(1), F.col("f2")).alias("f"))
    one = lambda rule, side: F.max(F.when(F.col("rule") == rule, F.col(f"f.{side}"))).alias(f"{rule}_{side}")
    return t.groupBy("lang", "source").agg(*[one(r[0], side) for r in RULES for side in ("low", "high")])


def judge(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source, the measures, base_failed, failed_rules (array of names), kept for every row of ``docs``.

    base_failed: fewer than MIN_WORDS words, or over MAX_REPEAT_PERCENT percent of them in repeated 3-word windows. Others fail a rule if their
    value lies beyond the fence of their language and source. Sketches cover all rows that pass the base, so junk doesn't move the fences.
    Words are runs of characters that aren't white space, of whole texts. A null or empty text has no words and fails the base. Null languages
    and sources are groups of their own; rows that repeat are judged each. Empty tables give no rows. Further columns play no part.
    """
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    m = cut(measures(docs)).withColumn("base_failed", failed)
    t = thresholds(m.where(~F.col("base_failed"))).withColumnRenamed("lang", "_lang").withColumnRenamed("source", "_source")
    d = m.join(t, F.col("lang").eqNullSafe(F.col("_lang")) & F.col("source").eqNullSafe(F.col("_source")) & ~F.col("base_failed"), "left")
    checks = []
    for rule, n, den, sides, _ in RULES:
        value = F.when(F.col(den) > 0, F.expr(f"(1000 * {n}) div {den}"))
        out = F.lit(False)
        for side in sides:
            out = out | (value < F.col(f"{rule}_low") if side == "low" else value > F.col(f"{rule}_high"))
        checks.append(F.when(F.coalesce(out, F.lit(False)), F.lit(rule)))
    d = d.withColumn("failed_rules", F.array_compact(F.array(*checks)))
    return d.select("doc_id", "lang", "source", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "base_failed", "failed_rules",
                    (~F.col("base_failed") & (F.size("failed_rules") == 0)).alias("kept"))


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose texts are kept, with all their columns; an id with several texts stays if one of them is kept."""
    good = judge(docs).where("kept").select(F.col("doc_id").alias("_good")).distinct()
    return docs.join(good, F.col("doc_id").eqNullSafe(F.col("_good")), "left_semi")

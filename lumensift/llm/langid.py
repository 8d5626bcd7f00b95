"""Language identification: each document as a mixture of languages, fitted by expectation-maximisation over letter trigrams."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from lumensift.llm.common import chunks

#: Trigrams are hashed into so many features; a model is one row of probabilities for each language, so its size is languages x features.
FEATURE_BITS = 16
#: Added to every count; likelihood that a further language must gain, in units of the log of the number of trigrams.
SMOOTHING, PENALTY = 0.3, 4.0
UNKNOWN = "und"

_letters: np.ndarray | None = None


def letters() -> np.ndarray:
    """Which code points are letters."""
    global _letters
    if _letters is None:
        _letters = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)
    return _letters


def trigrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Features of all texts (one for each letter: it and its neighbours, lower-cased, other characters as a space) and how many each text has."""
    low = [t.lower() for t in texts]
    cp = np.frombuffer(("\0" + "\0".join(low) + "\0").encode("utf-32-le", "surrogatepass"), np.uint32)
    is_letter = letters()[cp]
    c = np.where(is_letter, cp, 32).astype(np.uint64)
    at = np.flatnonzero(is_letter)
    h = c[at - 1] * np.uint64(0x9E3779B97F4A7C15) + c[at] * np.uint64(0xC2B2AE3D27D4EB4F) + c[at + 1] * np.uint64(0x165667B19E3779F9)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    ends = np.cumsum([len(t) + 1 for t in low])
    upto = np.searchsorted(at, ends, side="right")
    return (h >> np.uint64(64 - FEATURE_BITS)).astype(np.int64), np.diff(upto, prepend=0)


@dataclass
class Model:
    """Languages in order and P(trigram | language), a column for each."""

    langs: list[str]
    probs: np.ndarray


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[str, np.ndarray] = {}
    for part, texts in chunks(batches, "text"):
        feats, sizes = trigrams([(t or b"").decode() for t in texts])
        names = np.array(part.column(part.schema.get_field_index("lang")).to_pylist(), object)
        owner = np.repeat(names, sizes)
        for lang in set(names):
            total[lang] = total.get(lang, 0) + np.bincount(feats[owner == lang], minlength=1 << FEATURE_BITS)
    for lang, counts in total.items():
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * at.size, pa.string()), pa.array(at, pa.int64()), pa.array(counts[at], pa.int64())], names=["lang", "feature", "n"])


def held_out(doc_id: Column) -> Column:
    """Documents never learned from: CRC-32 of the id's text modulo 4 is 2 (a null id counts as an empty text)."""
    return F.pmod(F.crc32(F.encode(F.coalesce(doc_id.cast("string"), F.lit("")), "UTF-8")), F.lit(4)) == 2


def train(labelled: DataFrame) -> Model:
    """Fit on all rows of (text, lang): counts are summed in the tasks and by Spark; the driver gets languages x features numbers at most."""
    rows = labelled.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("text", "lang")
    sums = rows.mapInArrow(_count, "lang string, feature bigint, n bigint").groupBy("lang", "feature").agg(F.sum("n").alias("n")).toPandas()
    langs = sorted(sums["lang"].unique())
    counts = np.zeros((1 << FEATURE_BITS, len(langs)))
    counts[sums["feature"].to_numpy(np.int64), [langs.index(x) for x in sums["lang"]]] = sums["n"]
    counts += SMOOTHING
    return Model(langs, counts / counts.sum(0))


def mixture(m: np.ndarray, c: np.ndarray, iterations: int = 25, tol: float = 1e-3) -> tuple[np.ndarray, float]:
    """Expectation-maximisation for the shares of the languages: (shares, log-likelihood). ``m``: trigrams x languages, ``c``: counts."""
    shares = np.full(m.shape[1], 1 / m.shape[1])
    n = c.sum()
    for _ in range(iterations):
        new = shares * (m.T @ (c / (m @ shares))) / n
        done = np.abs(new - shares).max() < tol
        shares = new
        if done:
            break
    return shares, float(c @ np.log(m @ shares))


def choose(m: np.ndarray, c: np.ndarray, penalty: float = PENALTY) -> tuple[list[int], np.ndarray]:
    """The set of languages with the best penalised likelihood, largest share first, and their shares."""
    each = c @ np.log(m)
    top = int(each.argmax())
    cost = penalty * np.log(c.sum() + 1)
    if m.shape[1] == 1:
        return [0], np.ones(1)
    shares, full = mixture(m, c)
    best, best_score = ([top], np.ones(1)), each[top]
    if full - cost <= best_score:  # no set can gain more than all languages together
        return best
    order = np.argsort(-shares, kind="stable")
    for size in range(2, m.shape[1] + 1):
        own = order[:size]
        if full - cost * (size - 1) <= best_score:
            break
        s, value = mixture(m[:, own], c)
        if value - cost * (size - 1) > best_score:
            rank = np.argsort(-s, kind="stable")
            best, best_score = ([int(own[i]) for i in rank], s[rank]), value - cost * (size - 1)
    return best


def _identify(model_by, penalty: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Model = model_by.value
        for part, texts in chunks(batches, "_text"):
            feats, sizes = trigrams([(t or b"").decode() for t in texts])
            pred, score, found = [], [], []
            at = 0
            for n in sizes:
                own, at = feats[at:at + n], at + n
                if not n or not model.langs:
                    pred.append(UNKNOWN), score.append(0.0), found.append([])
                    continue
                ids, c = np.unique(own, return_counts=True)
                langs, shares = choose(model.probs[ids], c.astype(float), penalty)
                pred.append(model.langs[langs[0]]), score.append(float(min(1.0, shares[0]))), found.append([model.langs[i] for i in langs])
            names = [n for n in part.schema.names if n != "_text"]
            yield pa.RecordBatch.from_arrays([*(part.column(n) for n in names), pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(found, pa.list_(pa.string()))], names=[*names, "lang_pred", "score", "langs"])
    return run


def identify(docs: DataFrame, model: Model, text: str = "text", penalty: float = PENALTY) -> DataFrame:
    """``docs`` with lang_pred, score (its share of the chosen set) and langs (the set); columns of these names are replaced.

    A text that is null or has no letter is ``und`` with score 0, and so is every text if nothing was learned. Repeated rows are judged
    each; an empty table gives an empty one. A map over whole texts without a shuffle; the model is broadcast, languages x features numbers.
    """
    d = docs.drop("lang_pred", "score", "langs").withColumn("_text", F.col(text))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in d.schema if f.name != "_text")
    return d.mapInArrow(_identify(docs.sparkSession.sparkContext.broadcast(model), penalty), f"{fields}, lang_pred string, score double, langs array<string>")


def learn_from(docs: DataFrame) -> Model:
    """The model of all documents that have a language and aren't held out."""
    return train(docs.where(~held_out(F.col("doc_id"))))


def keep_identified(docs: DataFrame, model: Model) -> DataFrame:
    """The documents whose language can be told, with their own columns only; those without a letter go."""
    d = identify(docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), F.col("text").alias("text")), model)
    return d.where(F.col("lang_pred") != UNKNOWN).select("doc.*")

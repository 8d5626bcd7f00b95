"""Best-fit packing of token pieces into sequences by a grouping genetic algorithm on islands."""

from __future__ import annotations

from array import array
from bisect import bisect_left, insort
from collections.abc import Iterator
import random
import re
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from lumensift.llm.common import chunks, cut

CAPACITY, END_ID = 4096, 1
#: Pieces an island packs, generations, individuals of each of its two colonies, and how often elites change colonies.
ISLAND_PIECES, GENERATIONS, COLONY, MIGRATE_EVERY = 2000, 6, 3, 2
#: Rounds in which the documents of poorly filled sequences move on to other islands; sequences filled at least so far stay.
EPOCHS, SETTLED = 3, 0.998
#: Distinct words whose ids a task remembers.
WORD_CACHE = 600_000

_LETTER = "a-zªµºß-öø-ÿ"
_DIGIT = "0-9²³¹¼-¾"
_SPACE = r"\s"
#: The letters that byte-level BPE writes for bytes: printable Latin-1 for itself, the others in order from U+0100.
_BYTE_LETTERS = {b: 0x100 + i for i, b in enumerate(b for b in range(256) if not (0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b))}
#: The tokenizer's own split, spelled out for Latin-1 text; other texts go to the tokenizer whole.
_WORDS = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTER}]+|[{_DIGIT}]|[^{_SPACE}{_LETTER}{_DIGIT}]+")
_LATIN = re.compile("[\t\n\r -~¡-¬®-ÿ]*")


class WordTokenizer(dict):
    """Token ids of texts by a public tokenizer file. The tokenizer encodes one word after the other, so the ids of what stands between white
    space are remembered, as little-endian 32-bit numbers."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        self.whole = Tokenizer.from_file(path)
        self.model = self.whole.model

    def __missing__(self, word: str) -> bytes:
        parts = _WORDS.findall(word)
        if len(parts) > 1:  # words with their punctuation are too many to remember
            return b"".join([self[p] for p in parts])
        ids = self[word] = array("I", [t.id for t in self.model.tokenize(word.encode().decode("latin-1").translate(_BYTE_LETTERS))]).tobytes()
        return ids

    def encode(self, text: str) -> bytes:
        """Ids of one text, without special tokens added."""
        if "<|" in text or not _LATIN.fullmatch(text):
            return array("I", self.whole.encode(text, add_special_tokens=False).ids).tobytes()
        if len(self) > WORD_CACHE:
            self.clear()
        return b"".join(map(self.__getitem__, text.lower().split()))


_TOKENIZERS: dict[str, WordTokenizer] = {}


def _pieces(tokenizer: str, capacity: int, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if tokenizer not in _TOKENIZERS:
            _TOKENIZERS[tokenizer] = WordTokenizer(tokenizer)
        tok, end = _TOKENIZERS[tokenizer], np.array([end_id], "<u4").tobytes()
        for part, texts in chunks(batches, "text"):
            row, piece, start, length, crc = [], [], [], [], []
            for i, t in enumerate(texts):
                ids = tok.encode((t or b"").decode()) + end
                for p, at in enumerate(range(0, len(ids), 4 * capacity)):
                    own = ids[at:at + 4 * capacity]
                    row.append(i), piece.append(p), start.append(at // 4), length.append(len(own) // 4), crc.append(zlib.crc32(own))
            yield pa.RecordBatch.from_arrays(
                [part.column(part.schema.get_field_index("doc_id")).take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())],
                names=["doc_id", "piece", "start", "length", "ids_crc32"])
        tok.clear()  # a worker outlives its tasks; later jobs need the memory
    return run


def pieces_of(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 for every piece of at most ``capacity`` tokens; a null text is empty (its end id only)."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(_pieces(tokenizer, capacity, end_id), f"doc_id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint")


# --- one island -------------------------------------------------------------------------------------------------------------------

Bins = list[list[int]]  # indices of pieces


def best_fit(sizes: list[int], items: list[int], bins: Bins, capacity: int) -> Bins:
    """Put ``items``, largest first, each into the fullest of ``bins`` that still takes it, or into a new one."""
    room = sorted((capacity - sum(sizes[i] for i in own), b) for b, own in enumerate(bins))
    for i in sorted(items, key=lambda i: (-sizes[i], i)):
        at = bisect_left(room, (sizes[i], -1))
        if at < len(room):
            free, b = room.pop(at)
        else:
            free, b = capacity, len(bins)
            bins.append([])
        bins[b].append(i)
        if free > sizes[i]:
            insort(room, (free - sizes[i], b))
    return bins


def fitness(sizes: list[int], bins: Bins, capacity: int) -> tuple[int, float]:
    """Fewer bins first; then fills as unequal as can be, for what is left over to be emptied later (Falkenauer)."""
    return -len(bins), sum((sum(sizes[i] for i in own) / capacity) ** 2 for own in bins) / max(1, len(bins))


def crossover(sizes: list[int], giver: Bins, taker: Bins, capacity: int, rng: random.Random) -> Bins:
    """Inject whole well-filled bins of ``giver``, drop the bins of ``taker`` that hold any of their pieces, best-fit what is displaced."""
    fill = sorted(giver, key=lambda own: (-sum(sizes[i] for i in own), own))
    injected = [own for own in fill[: max(1, len(fill) // 2)] if rng.random() < 0.7] or fill[:1]
    taken = {i for own in injected for i in own}
    kept, displaced = [], []
    for own in taker:
        if taken.isdisjoint(own):
            kept.append(list(own))
        else:
            displaced += [i for i in own if i not in taken]
    return best_fit(sizes, displaced, [list(own) for own in injected] + kept, capacity)


def mutate(sizes: list[int], bins: Bins, capacity: int, rng: random.Random) -> Bins:
    """Empty the least-filled bins and a few others, and best-fit their pieces again."""
    order = sorted(range(len(bins)), key=lambda b: (sum(sizes[i] for i in bins[b]), b))
    gone = set(order[:2]) | {rng.randrange(len(bins)) for _ in range(max(1, len(bins) // 20))}
    return best_fit(sizes, [i for b in gone for i in bins[b]], [list(own) for b, own in enumerate(bins) if b not in gone], capacity)


def shuffled_fit(sizes: list[int], capacity: int, rng: random.Random) -> Bins:
    """Best fit in slightly disturbed order of size."""
    bins: Bins = []
    noisy = sorted(range(len(sizes)), key=lambda i: -sizes[i] * rng.uniform(0.9, 1.1))
    step = max(1, len(noisy) // 8)
    for s in range(0, len(noisy), step):
        best_fit(sizes, noisy[s:s + step], bins, capacity)
    return bins


def evolve(sizes: list[int], capacity: int, seed: int, generations: int = GENERATIONS, colony: int = COLONY) -> Bins:
    """The best packing found by two colonies that exchange their elites; ends early at the least number of bins that the sum allows."""
    if not sizes:
        return []
    rng, least = random.Random(seed), -(-sum(sizes) // capacity)
    best = best_fit(sizes, list(range(len(sizes))), [], capacity)
    if len(best) == least:
        return best
    score = lambda bins: fitness(sizes, bins, capacity)
    colonies = [[best] + [shuffled_fit(sizes, capacity, rng) for _ in range(colony - 1)] for _ in range(2)]
    for g in range(generations):
        for pop in colonies:
            pop.sort(key=score, reverse=True)
            children = [mutate(sizes, crossover(sizes, pop[rng.randrange(len(pop))], pop[rng.randrange(len(pop))], capacity, rng), capacity, rng) for _ in range(2)]
            pop[:] = sorted(pop + children, key=score, reverse=True)[:colony]
        best = max((pop[0] for pop in colonies), key=score)
        if len(best) == least:
            break
        if g % MIGRATE_EVERY == MIGRATE_EVERY - 1:
            colonies[0][-1], colonies[1][-1] = colonies[1][0], colonies[0][0]
    return best


def _island(capacity: int, settled: float, epoch: int, last: bool):
    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", "doc_id", "piece", "ids_crc32"], ascending=[False, True, True, True], kind="stable").reset_index(drop=True)
        sizes = pdf["length"].tolist()
        bins = evolve(sizes, capacity, seed=(epoch << 32) + int(key[0]))
        bins.sort(key=lambda own: (-sum(sizes[i] for i in own), own))
        number, offset, done = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64), np.zeros(len(sizes), bool)
        for b, own in enumerate(bins):
            at = 0
            for i in own:
                number[i], offset[i] = b, at
                at += sizes[i]
            done[own] = last or at >= settled * capacity
        pdf["sequence_id"], pdf["offset"], pdf["settled"] = (np.int64(epoch) << 56) + (np.int64(key[0]) << 24) + number, offset, done
        return pdf
    return run


def pack(pieces: DataFrame, capacity: int = CAPACITY, island_pieces: int = ISLAND_PIECES, epochs: int = EPOCHS, settled: float = SETTLED) -> DataFrame:
    """``pieces`` with sequence_id and offset: every piece in one sequence of at most ``capacity`` tokens, without gaps.

    Pieces are dealt to islands of about ``island_pieces`` by a hash of their row; an island is one task's group, however large the table.
    Sequences of an island's elite that are filled to ``settled`` stay; the documents of the others migrate to new islands in the next
    epoch, and what is left at last is packed by the last epoch's islands. Full pieces are sequences by themselves. The result depends on
    the rows alone. Repeated rows are packed each. Every epoch is written to the checkpoint folder.
    """
    cols = ["doc_id", "piece", "start", "length", "ids_crc32"]
    rest = cut(pieces.select(*cols))
    out = [rest.where(F.col("length") >= capacity).select(*cols, F.xxhash64("doc_id", "piece", "start", "ids_crc32").alias("_h"))]
    whole = out[0].withColumn("sequence_id", -(F.lit(1) + F.pmod(F.col("_h"), F.lit(1 << 62)))).withColumn("offset", F.lit(0).cast("bigint")).drop("_h")
    # copies of one row (and the odd collision) would share a number: they are told apart by their rank among equals, and packed by the islands
    rank = W.partitionBy("sequence_id").orderBy("doc_id", "piece")
    whole = whole.withColumn("_r", F.row_number().over(rank))
    out = [whole.where("_r = 1").drop("_r")]
    rest = rest.where(F.col("length") < capacity).unionByName(whole.where("_r > 1").select(*cols))
    kind = pieces.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint, island bigint, sequence_id bigint, offset bigint, settled boolean"
    for epoch in range(epochs):
        n = rest.count()
        if not n:
            break
        islands = max(1, -(-n // island_pieces))
        last = epoch == epochs - 1 or islands == 1
        dealt = rest.withColumn("island", F.pmod(F.xxhash64(F.lit(epoch), *cols), F.lit(islands)))
        got = cut(dealt.groupBy("island").applyInPandas(_island(capacity, settled, epoch, last), schema))
        out.append(got.where("settled").select(*cols, "sequence_id", "offset"))
        if last:
            break
        rest = got.where("NOT settled").select(*cols)
    result = out[0]
    for o in out[1:]:
        result = result.unionByName(o)
    return result


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """Tokenise, cut and pack whole documents: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Only ids, lengths and checksums of pieces are shuffled, never texts or tokens. Only documents of more than ``capacity`` tokens are cut.
    """
    d = pack(pieces_of(docs, tokenizer, capacity, end_id), capacity)
    return d.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")

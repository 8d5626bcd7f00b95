"""Importance resampling, quality rules and conversation repair against plain versions of their rules."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter
from functools import lru_cache

import pytest
from pyspark.sql import functions as F, types as T

from lumensift.llm import conversation, importance, quality
from tests.llm.conftest import AWKWARD

TURNS = T.StructType([T.StructField("conv_id", T.LongType()), T.StructField("turn", T.LongType()), T.StructField("role", T.StringType()), T.StructField("text", T.StringType()), T.StructField("digest", T.StringType()),
                      T.StructField("part", T.StringType())])


@pytest.fixture(scope="module")
def make_turns(spark, make_docs):
    return lambda rows: spark.createDataFrame([(*r, "x", "y") for r in rows], TURNS)


# ---- conversation repair

def plain_repair(codes):
    """(cost, audit) by trying every target length, each by plain recursion."""
    n = len(codes)

    def target(length):
        return ("s" if length % 2 else "") + "ua" * (length // 2)

    best = None
    for length in [k for k in range(2 * n + 4) if k != 1]:
        goal = target(length)

        @lru_cache(None)
        def go(i, j):
            if i == n and j == length:
                return 0, ""
            ways = []
            if i < n:
                role, fault = "uasx"[codes[i] & 3], codes[i] >> 2
                c, a = go(i + 1, j)
                ways.append((c + 4, "D" + a))
                if j < length and fault < 2:
                    c, a = go(i + 1, j + 1)
                    late = 3 if fault == 1 else 0
                    if role == goal[j]:
                        ways.append((c + late, "K" + a))
                    if goal[j] != "s":
                        ways.append((c + 3 + late, "R" + a))
            if j < length and goal[j] != "s":
                c, a = go(i, j + 1)
                ways.append((c + 3, "I" + a))
            return min(ways) if ways else (10**6, "~")
        got = go(0, 0)
        best = got if best is None else min(best, got)
    return best


def block_repair(codes, size):
    """The blocks' way, without Spark."""
    blocks = [codes[i:i + size] for i in range(0, len(codes), size)]
    rows = [(0, 0, k, sum(conversation.Alignment(b).costs(), [])) for k, b in enumerate(blocks)]
    after = {r[2]: r[3] for r in conversation._backward(rows)}
    ways = []
    for k, b in enumerate(blocks):
        got = [conversation.Alignment(b).repair(e, tuple(after[k])) for e in range(4)]
        ways.append((0, 0, k, [g[0] for g in got], [g[1].decode() for g in got], [g[2] for g in got]))
    out = list(conversation._forward(ways))
    return sum(o[3] for o in out), "".join(o[4] for o in out)


@pytest.mark.parametrize("seed", range(6))
def test_alignment_is_the_cheapest_and_least(seed):
    rng = random.Random(seed)
    for _ in range(250):
        weights = rng.choice([[5, 5, 1, 1], [1, 1, 4, 1], [9, 1, 0, 0], [1, 1, 1, 1]])
        codes = bytes(rng.choices(range(4), weights)[0] + 4 * rng.choices(range(4), rng.choice([[8, 2, 1, 1], [1, 1, 1, 1], [1, 0, 9, 9], [0, 1, 0, 0]]))[0] for _ in range(rng.randint(1, 9)))
        cost, audit, last = conversation.Alignment(codes).repair(conversation.O)
        audit = audit.decode() + "I" * (conversation.END[last] // conversation.INSERT)
        assert (cost, audit) == plain_repair(codes), codes
        for size in (1, 2, 4):
            assert block_repair(codes, size) == (cost, audit), (codes, size)


def test_long_alignment_equals_its_blocks():
    rng = random.Random(5)
    codes = bytes(rng.choices(range(16), [9, 9, 1, 1, 3, 3, 1, 1, 1, 1, 0, 0, 1, 1, 0, 0])[0] for _ in range(400))
    cost, audit, last = conversation.Alignment(codes).repair(conversation.O)
    assert block_repair(codes, 64) == (cost, audit.decode() + "I" * (conversation.END[last] // conversation.INSERT))


def plain_report(rows, every):
    out = {}
    for conv in every:
        mine = sorted(((t is not None, t or 0, r if r is not None else " ", x if x is not None else " ") for c, t, r, x in rows if c == conv),
                      key=lambda v: (v[0], v[1], v[2], hashlib.sha256(v[3].encode()).digest()))
        seen, codes, faults = set(), [], Counter()
        for _, _, role, text in mine:
            solid = text.strip(" \t\n\x0b\x0c\r")
            fault = 2 if not solid else 3 if (role, text) in seen else 1 if solid[-1] not in ".!?" else 0
            seen.add((role, text))
            faults[fault] += 1
            codes.append({"u": 0, "a": 1, "s": 2}.get(role[:1], 3) + 4 * fault)
        turns = {t for known, t, *_ in mine if known}
        cost, audit = plain_repair(bytes(codes)) if codes else (0, "")
        size, i, turned = len(audit) - audit.count("D"), 0, []
        for a in audit:
            due = "user" if (len(turned) + size) % 2 == 0 else "assistant"
            if a == "I":
                turned.append(f"{due}:")
                continue
            if a != "D":
                turned.append(f"{mine[i][2] if a == 'K' else due}:{mine[i][3]}")
            i += 1
        initials = [m[2][:1] for m in mine]
        out[conv] = (max(turns) - min(turns) + 1 - len(turns) if turns else 0, faults[2], faults[3], faults[1], sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])),
                     cost, audit, hashlib.sha256("\n".join(turned).encode()).hexdigest())
    return out


RNG = random.Random(11)
SAID = ["Well.", "What now?", "No end", "", " \n ", "Go!", "the end \n", "x."]
MESSY = [(c, RNG.choice([None, *range(7)]), RNG.choice(["user", "assistant", "user", "assistant", "system", None, "", "User", "tool"]), RNG.choice([*SAID, None]))
         for c in [None, *range(12)] for _ in range(RNG.randint(1, 9))] + [(50, t, ("user", "assistant")[t % 2], f"Turn {t}.") for t in range(9)] + [(51, 3, "user", "Same.")] * 7


@pytest.mark.parametrize("block", [2, 512])
def test_reports_of_messy_conversations(make_turns, block):
    every = make_turns(MESSY + [(99, 0, "user", "gone")])
    got = {r.conv_id: tuple(r)[1:] for r in conversation.report(make_turns(MESSY), every, block).collect()}
    want = plain_report(MESSY, [None, *range(12), 50, 51, 99])
    assert got == want
    assert got[99] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert got[51][2] == 6 and got[51][6] == "KDDDDDDI"


def test_repaired_turns_are_legal(make_turns):
    found = conversation.repaired(make_turns(MESSY)).collect()
    for conv in {r.conv_id for r in found}:
        mine = sorted((r for r in found if r.conv_id == conv), key=lambda r: r.place)
        assert [r.place for r in mine] == list(range(len(mine)))
        assert re.fullmatch("(s?(ua)+)?", "".join(r.role[:1] for r in mine))
        assert all((r.edit == "I") == (r.text == "") for r in mine)


def test_damage_by_checksum(make_turns):
    rows = [(c, t, "assistant", "A. B! C?") for c in range(8) for t in [None, *range(12)]] + [(None, 1, None, None)]
    got = sorted(((r.conv_id, r.turn, r.role, r.text) for r in conversation.damage(make_turns(rows)).collect()), key=str)
    want = []
    for c, t, role, text in rows:
        kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        if kind:
            row = (c, t, "user" if kind == 4 else role or " ", "" if kind == 1 else (text or " ").translate({46: None, 33: None, 63: None}) if kind == 2 else text or " ")
            want += [row] * (2 if kind == 3 else 1)
    assert got == sorted(want, key=str)


def test_empty_conversations(make_turns):
    assert conversation.audits(make_turns([])).count() == 0
    assert conversation.report(make_turns([]), make_turns([])).count() == 0
    assert conversation.repaired(make_turns([])).count() == 0


# ---- importance resampling

def plain_words(t):
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))


def plain_scores(docs, target, lo=1, hi=1, buckets=importance.BUCKETS):
    def features(t):
        w = plain_words(t)
        return [zlib.crc32(" ".join(w[i:i + n]).encode()) % buckets for n in range(lo, hi + 1) for i in range(len(w) - n + 1)]
    s, t = Counter(x for _, d in docs for x in features(d)), Counter(x for d in target for x in features(d))
    S, Z = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (S + buckets) / ((s[b] + 1) * (Z + buckets))))
    out = []
    for i, d in docs:
        f = features(d)
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(map(gain, f)) // len(f) if f else 0
        out.append((i, len(plain_words(d)), len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    return out


PROSE = [(100 + i, " ".join(random.Random(i).choices(["Sun", "moon", "étoile", "Stars,", "x1", "2", "of-the", "sky\tblue"], k=5 + 7 * (i % 9)))) for i in range(60)]


@pytest.mark.parametrize("grams", [(1, 1), (1, 2), (3, 3)])
def test_importance_equals_the_plain_rule(make_docs, spark, grams):
    docs = PROSE + AWKWARD
    target = ["The stars, the MOON and the sky", None, "étoile étoile", ""]
    lo, hi = grams
    aim = spark.createDataFrame([(t, "z") for t in target], "text string, lang string")
    got = importance.resample(make_docs(docs), aim, percent=30, lo=lo, hi=hi).collect()
    want = plain_scores(docs, target, lo, hi)
    key = lambda r: (r[0] is None, r[0] or 0, r[1:])
    assert sorted((tuple(r)[:5] for r in got), key=key) == sorted(want, key=key)
    able = sorted((-w[4], w[0] is not None, w[0] or 0) for w in want if w[1] >= 20)
    drawn = sorted((r.rank, r.score, r.doc_id) for r in got if r["rank"] is not None)
    assert [d[0] for d in drawn] == list(range(1, 30 * len(able) // 100 + 1)) and [(-d[1], True, d[2]) for d in drawn] == able[:len(drawn)]


def test_importance_edges(make_docs, spark):
    none = spark.createDataFrame([], "text string")
    assert importance.resample(make_docs([]), none).count() == 0
    got = importance.resample(make_docs(PROSE), none).collect()
    assert len(got) == len(PROSE) and sum(r["rank"] is not None for r in got) == 10 * sum(len(plain_words(t)) >= 20 for _, t in PROSE) // 100
    kept = importance.drawn_documents(make_docs(PROSE), none)
    assert kept.columns == make_docs([]).columns and {r.doc_id for r in kept.collect()} == {r.doc_id for r in got if r["rank"] is not None}


# ---- quality rules

QUALITY = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_words", T.StringType()),
                        T.StructField("kept", T.StringType())])


def plain_measures(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
    lines = [x for x in (t or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    grams = Counter(zip(w, w[1:], w[2:]))
    hit = {i + k for i, g in enumerate(zip(w, w[1:], w[2:])) if grams[g] > 1 for k in range(3)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t or ""), len(lines) - len(set(lines)), len(hit), len(lines)


def test_quality_measures(make_docs, spark):
    texts = [t for _, t in AWKWARD + PROSE] + ["a b c a b c d", "x\nx \nx\n\n \nx", "# * $% é& |<>", "a b c\na b", "中 文 é"]
    docs = spark.createDataFrame([(i, t, None, "s", "q", "q") for i, t in enumerate(texts)], QUALITY)
    got = {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.n_lines) for r in quality.measures(docs).collect()}
    assert got == {i: plain_measures(t) for i, t in enumerate(texts)}


def _prose(seed, symbols=0):
    rng = random.Random(seed)
    words = ["".join(rng.choices("abcdefghij", k=rng.randint(2, 8))) for _ in range(80)]
    return " ".join(words[:40]) + "\n" + " ".join(words[40:] + [f"${k}#" for k in range(symbols)])


def test_fences_follow_language_and_source(spark):
    rows = [(i, _prose(i), "en", "web", "q", "q") for i in range(300)] + [(1000 + i, _prose(i, 12 + i % 3), "en", "code", "q", "q") for i in range(300)]
    odd = [(5000, _prose(7, 12), "en", "web"), (5001, " ".join(f"{i:040d}" for i in range(80)), "en", "web"), (5002, _prose(7, 60), "en", "code"), (5003, _prose(8), "en", None), (5004, None, None, None),
           (5005, "one two three " * 40, "en", "web"), (5006, "\n".join([_prose(9).split("\n")[0]] * 2), "en", "web")]
    docs = spark.createDataFrame(rows + [(*o, "q", "q") for o in odd], QUALITY)
    got = {r.doc_id: r for r in quality.judge(docs).collect()}
    assert sum(not got[r[0]].kept for r in rows) <= 3
    assert got[5000].failed_rules == ["symbols"] and got[1000].kept  # what is usual in code is not in web
    assert "word_length" in got[5001].failed_rules and got[5002].failed_rules == ["symbols"]
    assert got[5003].kept  # a small group is judged by its language
    assert got[5004].base_failed and got[5005].base_failed and not got[5004].kept
    assert {r.doc_id for r in quality.keep_good(docs).collect()} == {i for i, r in got.items() if r.kept}
    assert quality.judge(docs.limit(0)).count() == 0


def test_sketches_merge(spark):
    docs = spark.createDataFrame([(i, _prose(i, i % 4), ("en", "de", None)[i % 3], ("a", "b")[i % 2], "q", "q") for i in range(120)], QUALITY)
    m = quality.measures(docs).cache()
    rows = lambda d: sorted(map(str, d.collect()))
    halves = quality.sketches(m.where("doc_id < 50")).unionByName(quality.sketches(m.where("doc_id >= 50")))
    assert rows(quality.merged(halves, "lang", "source")) == rows(quality.merged(quality.sketches(m), "lang", "source"))
    # quantiles of a sketch are right to a bucket
    values = sorted(r.v for r in m.select(F.expr("1000 * word_chars div n_words").alias("v")).collect())
    sk = quality.merged(quality.sketches(m)).where("rule = 'word_length'")
    upto, median = 0, None
    for r in sorted(sk.collect(), key=lambda r: r.bucket):
        upto += r.n
        if median is None and 2 * upto >= len(values):
            median = r.bucket
    exact = values[(len(values) - 1) // 2]
    assert median <= exact < median * (1 + 2.0 ** -(quality.SKETCH_BITS - 1)) + 1

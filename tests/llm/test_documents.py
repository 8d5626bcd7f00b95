import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumensift.llm import decontaminate as D, langid as L, near_dup as N, pack as P, shards as S, substring_dedup as B
from lumensift.llm.fm_index import FMIndex
from lumensift.llm.licenses import RULES, SENTENCES, scan
from lumensift.llm.queries import tokenizer_path

from .conftest import AWKWARD

DATA = "/root/testdata/sf0.001"


def rows_of(df):
    return [tuple(r) for r in df.collect()]


# --- sharding --------------------------------------------------------------------------------------------------------------------

def test_shards_follow_the_law(make_docs):
    got = S.shard_documents(make_docs([(i + 100, f"text {i}") for i in range(3000)] + AWKWARD), 16).collect()
    assert len(got) == 3000 + len(AWKWARD)
    by = defaultdict(list)
    for r in got:
        by[r.shard].append(r.slot)
        assert r.grown_shard in (r.shard, 16) and r.law == "key"
    assert set(by) == set(range(16)) and all(sorted(v) == list(range(len(v))) for v in by.values())
    moved = sum(r.grown_shard == 16 for r in got) / len(got)
    assert 0.03 < moved < 0.09
    for r in got:
        if r.doc_id == 6:
            raw = dict(AWKWARD)[6].encode()
            assert r.size == len(raw) + 1 and r.text_crc32 == zlib.crc32(raw)
        if r.doc_id == 1:
            assert r.size == 1 and r.text_crc32 == 0
    assert len({r.shard for r in got if r.doc_id == 4}) == 1


def test_shards_match_brute_force_and_weights(make_docs, spark):
    docs = make_docs([(i, "x") for i in range(2000)])
    weights = [1.0, 3.0, 2.0]
    got = {r.doc_id: r.shard for r in S.assign_shards(docs, "doc_id", weights).collect()}
    for i in range(2000):
        t = [-math.log((int(hashlib.md5(f"{i}:{s}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52) / w for s, w in enumerate(weights)]
        assert got[i] == t.index(min(t))
    share = Counter(got.values())
    assert abs(share[1] / 2000 - 0.5) < 0.05
    assert S.shard_documents(make_docs([]), 4).count() == 0


# --- near duplicates -------------------------------------------------------------------------------------------------------------

def brute_classes(rows, threshold=0.8):
    words = {i: re.findall(rb"[0-9a-z\x80-\xff]+", t.lower().encode()) for i, t in rows if t is not None}
    sets = {i: {tuple(w[j:j + 5]) for j in range(max(1, len(w) - 4))} if w else set() for i, w in words.items()}
    up = {i: i for i, _ in rows}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    texts = dict(rows)
    for a, b in combinations(sorted(sets), 2):
        same = texts[a] == texts[b]
        if same or sets[a] and len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b]):
            x, y = root(a), root(b)
            up[max(x, y)] = min(x, y)
    return {i: root(i) for i in up}


def test_near_duplicates_match_brute_force(make_docs):
    rng = random.Random(5)
    vocab = [f"w{i}" for i in range(400)]
    rows, n = [], 0
    for _ in range(12):
        base = [rng.choice(vocab) for _ in range(rng.randrange(60, 200))]
        for k in range(6):  # a chain of edits: the ends are linked through the middle only
            rows.append((n, " ".join(base)))
            n += 1
            base = list(base)
            base[rng.randrange(len(base))] = rng.choice(vocab)
    rows += [(n + i, t) for i, t in enumerate(["", "", None, None, "one two", "one two", "one two three", "!!!"])]
    got = dict(rows_of(N.classes(make_docs(rows))))
    assert got == brute_classes(rows)


def test_near_duplicate_cells_and_blocks(make_docs, monkeypatch):
    """A star whose members are no copies of one another: later rounds and cells of several blocks find every link."""
    monkeypatch.setattr(N, "CELL", 4)
    rng = random.Random(8)
    base = [f"a{i}" for i in range(100)]
    rows = []
    for i in range(60):
        w = list(base)
        for _ in range(rng.randrange(1, 5)):
            w[rng.randrange(100)] = f"e{rng.randrange(10**6)}"
        rows.append((i, " ".join(w)))
    assert dict(rows_of(N.classes(make_docs(rows)))) == brute_classes(rows)


def test_near_duplicates_with_a_repeated_line(make_docs):
    """Copies whose sets are alike but whose counts are not: probability Jaccard about 0.35, Jaccard of the sets over 0.9."""
    rows = []
    for i in range(8):
        base, line = [f"t{i}x{j}" for j in range(200)], [f"t{i}x{j}" for j in range(10)]
        rows += [(2 * i, " ".join(base)), (2 * i + 1, " ".join(base + line * 40))]
    want = brute_classes(rows)
    assert set(want.values()) == set(range(0, 16, 2))
    assert dict(rows_of(N.classes(make_docs(rows)))) == want


def random_sets(rng, n, uneven):
    """Near copies of one set, alike by 0.6 to 0.95, some with counts above one."""
    base = np.arange(1, 140, dtype=np.uint64) << np.uint64(40)
    out = []
    for k in range(n):
        own = base.copy()
        own[rng.choice(139, rng.integers(2, 40), replace=False)] = rng.integers(1 << 20, 1 << 60, 1).astype(np.uint64) + np.uint64(1)
        own = np.unique(np.append(own[: rng.integers(90, 139)], rng.integers(1 << 60, 1 << 61, rng.integers(0, 12)).astype(np.uint64)))
        counts = rng.integers(1, 4, own.size).astype(float) if uneven and k % 3 == 0 else np.where(np.arange(own.size) < 20, 1.0 + 3 * (uneven and k % 3 == 1), 1.0)
        out.append((own, counts))
    return out


@pytest.mark.parametrize("uneven", [False, True])
def test_cells_connect_exactly_what_is_similar(uneven):
    for seed in range(12):
        rng = np.random.default_rng(seed)
        sets = random_sets(rng, 30, uneven)
        comps = [b"%d" % (k if k % 4 else 0) for k in range(30)]
        blocks = [k % 2 for k in range(30)]
        for one_block in (True, False):
            up = {c: c for c in comps}

            def root(x):
                while up[x] != x:
                    x = up[x]
                return x
            for i, j in combinations(range(30), 2):
                if (one_block or blocks[i] != blocks[j]) and N.similarity(sets[i], sets[j]) >= 0.8:
                    up[root(comps[i])] = root(comps[j])
            want = {frozenset(c for c in comps if root(c) == root(d)) for d in comps}
            links = N.cell_links([(c, b, *s) for c, b, s in zip(comps, blocks, sets)], 0.8, one_block)
            assert all(N.similarity(sets[i], sets[j]) >= 0.8 for i, j in links) and len(links) < len(set(comps))
            up = {c: c for c in comps}
            for i, j in links:
                assert root(comps[i]) != root(comps[j])
                up[root(comps[i])] = root(comps[j])
            assert {frozenset(c for c in comps if root(c) == root(d)) for d in comps} == want


def test_buckets_that_merely_touch_stay_cells(spark):
    """A chain of buckets that share one member each is compared bucket by bucket, many buckets of the same members as one group."""
    node = lambda i: b"%08d" % i
    chain = [(k, node(10 * k + i)) for k in range(8) for i in range(11)]
    same = [(100 + k, node(1000 + i)) for k in range(20) for i in range(12) if (i + k) % 5]
    cells = N._cells(spark.createDataFrame(chain + same, "key bigint, node binary")).collect()
    groups = {}
    for r in cells:
        groups.setdefault(bytes(r.cell), set()).add(bytes(r.node))
    assert sorted(map(len, groups.values()))[-1] == 12 and len(groups) <= 9
    for rows in (chain, same):
        for key in {k for k, _ in rows}:
            assert any({n for k, n in rows if k == key} <= g for g in groups.values())


def test_near_copies_below_the_threshold_with_repeated_lines(make_docs):
    """Hundreds of near copies, mostly less alike than the threshold, each with a line many times: classes are still exact."""
    rng = random.Random(4)
    base, rows = [f"b{i}" for i in range(120)], []
    for i in range(300):
        w = list(base)
        for _ in range(rng.randrange(2, 7)):
            w[rng.randrange(120)] = f"e{rng.randrange(10**6)}"
        rows.append((i, " ".join(w) + (" " + " ".join(w[:12])) * (3 if i % 2 else 0)))
    sets = N.shingles([t.encode() for _, t in rows])
    up = list(range(300))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x
    for i, j in combinations(range(300), 2):
        if root(i) != root(j) and N.similarity(sets[i], sets[j]) >= 0.8:
            up[max(root(i), root(j))] = min(root(i), root(j))
    assert dict(rows_of(N.classes(make_docs(rows)))) == {i: root(i) for i in range(300)}


def test_texts_of_one_id_are_judged_each(make_docs):
    a, b = (" ".join(f"{c}{i}" for i in range(80)) for c in "ab")
    got = rows_of(N.classes(make_docs([(1, a), (1, b), (2, a + " x y"), (3, b + " x y"), (4, "c " * 40), (4, "c " * 40)])))
    assert sorted(got) == [(1, 1), (1, 1), (2, 1), (3, 1), (4, 4), (4, 4)]


def test_near_duplicates_of_awkward_rows(make_docs):
    got = rows_of(N.classes(make_docs(AWKWARD)))
    assert len(got) == len(AWKWARD)
    assert (1, 1) in got and (9, 2) in got and (8, 4) in got and (None, None) in got and got.count((4, 4)) == 2
    kept = N.keep_one(make_docs(AWKWARD))
    assert kept.columns == make_docs([]).columns
    assert sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 2, 3, 4, 4, 5, 6, 7]
    assert N.classes(make_docs([])).count() == 0


def test_one_id_with_two_texts_joins_their_classes(make_docs):
    a, b = " ".join(f"a{i}" for i in range(50)), " ".join(f"b{i}" for i in range(50))
    assert set(rows_of(N.classes(make_docs([(1, a), (2, b), (3, a), (3, b)])))) == {(1, 1), (2, 1), (3, 1)}


def test_signatures_estimate_probability_jaccard():
    rng = np.random.default_rng(0)
    for _ in range(5):
        x = np.unique(rng.integers(0, 2**63, 300).astype(np.uint64))
        a, b = (x[:250], rng.integers(1, 4, 250)), (x[40:], rng.integers(1, 4, x.size - 40))
        pa_, pb = dict(zip(a[0].tolist(), a[1] / a[1].sum())), dict(zip(b[0].tolist(), b[1] / b[1].sum()))
        exact = sum(1 / sum(max(pa_.get(y, 0) / pa_[s], pb.get(y, 0) / pb[s]) for y in {*pa_, *pb}) for s in pa_ if s in pb)
        plain = len(pa_.keys() & pb.keys()) / len(pa_.keys() | pb.keys())
        assert N.similarity(a, b) == pytest.approx(max(exact, plain))
        sig = N.signatures([a, b], 4096)
        assert abs((sig[0] == sig[1]).mean() - exact) < 0.04


# --- substring dedup -------------------------------------------------------------------------------------------------------------

def brute_substrings(rows, n):
    words = [(i, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in rows]
    first = {}
    for i, w in words:
        for j in range(len(w) - n + 1):
            first[tuple(w[j:j + n])] = min(first.get(tuple(w[j:j + n]), i), i)
    out = []
    for i, w in words:
        gone = set()
        for j in range(len(w) - n + 1):
            if first[tuple(w[j:j + n])] < i:
                gone.update(range(j, j + n))
        out.append((i, len(w), len(gone), hashlib.sha256(" ".join(x for k, x in enumerate(w) if k not in gone).encode()).hexdigest()))
    return sorted(out)


def repeats(seed, n):
    rng = random.Random(seed)
    word = lambda: rng.choice("abcdefghij") + rng.choice("abcdefghij")
    shared = [[word() for _ in range(rng.randrange(40, 90))] for _ in range(4)]
    rows = []
    for i in range(n):
        w = []
        for _ in range(rng.randrange(1, 4)):
            w += [word() for _ in range(rng.randrange(0, 40))]
            s = rng.choice(shared)
            a = rng.randrange(0, 10)
            w += s[a:]
        rows.append((i, rng.choice([" ", "\n", "  \t"]).join(w)))
    rows += [(n, rows[0][1]), (n + 1, "same word " * 200), (n + 2, "same word " * 180), (n + 3, None), (n + 4, ""), (n + 5, "\x00 " * 60), (n + 6, "\x00 " * 60 + "x")]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("hot", [B.HOT_WINDOWS, 2])
def test_substring_dedup_matches_brute_force(make_docs, monkeypatch, hot):
    monkeypatch.setattr(B, "SHARD_WORDS", 500)
    monkeypatch.setattr(B.repeated_spans, "__defaults__", (B.WINDOW, B.ANCHOR, hot))
    monkeypatch.setattr(B, "HOT_PART", 20)
    rows = repeats(3, 40)
    assert sorted(rows_of(B.dedup_report(make_docs(rows)))) == brute_substrings(rows, 50)


def test_substring_dedup_of_awkward_rows(make_docs):
    rows = [r for r in AWKWARD if r[0] is not None]
    got = rows_of(B.dedup_report(make_docs([*rows, (None, "long " * 30_000)])))
    assert sorted(x for x in got if x[0] is not None) == sorted(brute_substrings(rows, 50))
    assert [x[2] for x in got if x[0] is None] == [0]
    assert B.dedup_report(make_docs([])).count() == 0


def test_substring_dedup_of_ids_with_several_texts(make_docs):
    a, b = (" ".join(f"{c}{i}" for i in range(120)) for c in "ab")
    rows = [(1, a), (1, b), (2, "x " + a), (3, "y " + b), (3, a + " z"), (1, a)]
    for _ in range(2):
        got = sorted((r.doc_id, r.n_words, r.n_removed) for r in B.dedup_report(make_docs(rows)).collect())
        assert got == [(1, 120, 0), (1, 120, 0), (1, 120, 0), (2, 121, 120), (3, 121, 120), (3, 121, 120)]
        rows = rows[::-1]
    left = sorted((r.doc_id, r.text) for r in B.remove_repeats(make_docs(rows)).collect())
    assert left == sorted([(1, a), (1, b), (1, a), (2, "x"), (3, "y"), (3, "z")])


def test_repeats_are_cut_from_the_text(make_docs):
    passage = " ".join(f"p{i}" for i in range(60))
    docs = make_docs([(1, f"one {passage} two"), (2, f"three\n{passage}\nfour five"), (3, passage), (4, passage)])
    got = {r.doc_id: r.text for r in B.remove_repeats(docs).collect()}
    assert got == {1: f"one {passage} two", 2: "three\n\nfour five", 3: "", 4: ""}


def test_fm_index_finds_exactly_the_windows_that_occur():
    rng = np.random.default_rng(2)
    seqs = [rng.integers(0, 6, rng.integers(5, 40)) for _ in range(30)]
    index = FMIndex(seqs, 4)
    have = {tuple(s[i:i + 4]) for s in seqs for i in range(s.size - 3)}
    asked = [rng.integers(0, 7, 50) for _ in range(20)]
    for s, ranks in zip(asked, index.window_matches(asked)):
        for i, r in enumerate(ranks):
            assert (r >= 0) == (tuple(s[i:i + 4]) in have)


# --- decontamination -------------------------------------------------------------------------------------------------------------

def brute_hits(text, items, n=13):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))
    w, hit, found = words(text), set(), set()
    for item, t in items:
        own = words(t)
        k = min(n, len(own))
        for a in range(len(own) - k + 1 if k else 0):
            for j in range(len(w) - k + 1):
                if w[j:j + k] == own[a:a + k]:
                    hit.update(range(j, j + k))
                    found.add(str(item))
    return len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)


@pytest.mark.parametrize("set_words", [D.SET_WORDS, 20])
def test_decontamination_matches_brute_force(make_docs, spark, monkeypatch, set_words):
    rng = random.Random(1)
    vocab = ["Alpha", "beta", "GAMMA", "dé", "x1", "9"]
    items = [(i, " ".join(rng.choice(vocab) for _ in range(rng.choice([0, 1, 5, 13, 30])))) for i in range(10)] + [(10, None), (11, "--- !"), (3, "zeta eta theta")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    rows = []
    for i in range(40):
        w = [rng.choice(vocab + ["other"]) for _ in range(rng.randrange(0, 120))]
        if i % 3 == 0 and (t := items[i % 10][1]):
            w[5:5] = t.split()
        rows.append((i, ", ".join(w)))
    rows += [r for r in AWKWARD if r[0] is not None]
    monkeypatch.setattr(D.mark_hits, "__defaults__", (*D.mark_hits.__defaults__[:-1], set_words))
    got = sorted(rows_of(D.contamination(make_docs(rows), bench)))
    assert got == sorted((i, *brute_hits(t, [x for x in items if x[1] is not None])) for i, t in rows)


def test_decontamination_removes_documents_or_spans(make_docs, spark):
    item = " ".join(f"q{i}" for i in range(15))
    bench = spark.createDataFrame([("a", item)], "item_id string, text string")
    docs = make_docs([(1, f"Before, {item}. after"), (2, "clean text"), (3, None), (4, "w " * 400 + item)])
    assert sorted(r.doc_id for r in D.decontaminate(docs, bench).collect()) == [2, 3, 4]
    cut = {r.doc_id: r.text for r in D.decontaminate(docs, bench, remove="spans").collect()}
    assert cut[1] == "Before, . after" and cut[2] == "clean text" and cut[3] is None and cut[4] == "w " * 400
    assert D.contamination(docs, bench.limit(0)).where("n_hit > 0").count() == 0


# --- licences --------------------------------------------------------------------------------------------------------------------

def test_licences(make_docs):
    mit = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal\nin the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions.\n\nThe above copyright notice and this permission notice shall be included in all\ncopies or substantial portions of the Software.\n\nTHE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT."
    rows = [(1, "Words. Licensed under CC BY-NC 4.0.\nMore"), (2, mit), (3, "Copyright X. All rights reserved"), (4, "no licence here"), (5, "released under the MIT LICENSE!\nAll rights reserved."), (6, "All rights\nreserved.")]
    got = {r.doc_id: (r.sentence_ids, r.licenses, r.n_known) for r in scan(make_docs(rows)).collect()}
    assert got == {1: ("cc_by_nc_4", "CC-BY-NC-4.0", 1), 2: ("mit_grant,mit_notice,as_is_software", "MIT", 3), 3: ("all_rights", "Proprietary", 1), 4: ("", "", 0),
                   5: ("mit_released,all_rights", "MIT-reference,Proprietary", 2), 6: ("all_rights", "Proprietary", 1)}
    assert scan(make_docs(AWKWARD)).where("n_known > 0").count() == 0 and scan(make_docs([])).count() == 0
    assert all(n in SENTENCES for _, names, _ in RULES for n in names)


def test_licences_in_a_text_of_very_many_known_sentences(make_docs):
    mit = [SENTENCES[k] + ". " for k in ("mit_grant", "mit_notice", "as_is_software")]
    many = "All rights reserved.\n" * 20_000
    texts = [mit[0] + "\n" + many, mit[0] + "\n" + many + mit[1] + "\n" + many + mit[2], mit[2] + "\n" + many + mit[1] + mit[0]]
    got = {r.doc_id: r for r in scan(make_docs(list(enumerate(texts)))).collect()}
    assert [got[i].licenses for i in range(3)] == ["Proprietary", "MIT", "Proprietary"] and got[1].n_known == 40_003


def test_wrapped_licences(make_docs):
    """The standard texts as they are published, wrapped under a title, a copyright line or a colon."""
    grant = """Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:
{}The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.
{}THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS BE LIABLE."""
    bsd = """Copyright (c) 2020, Some One

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:
{0}1{1} Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.
{0}2{1} Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.
{0}3{1} Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.
"""
    gpl = """/*  prog - does things
 *  Copyright (C) 2020  Some One
 *  This program is free software: you can redistribute it and/or modify
 *  it under the terms of the GNU General Public License as published by
 *  the Free Software Foundation, either version 3 of the License, or
 *  (at your option) any later version.
 *
 *  This program is distributed in the hope that it will be useful,
 *  but WITHOUT ANY WARRANTY; without even the implied warranty of
 *  MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
 *  GNU General Public License for more details.
 */"""
    mpl = "This Source Code Form is subject to the terms of the Mozilla Public\n * License, v. 2.0. If a copy"
    rows = [(1, "MIT License\n\nCopyright (c) 2020 Some One\n\n" + grant.format("\n", "\n")), (2, ("MIT License\nCopyright (c) 2020 Some One\n" + grant.format("", "")).replace("\n", "\r\n")),
            (3, bsd.format("\n", ".")), (4, bsd.format("", ")")), (5, gpl), (6, mpl), (7, "Words. This text is not\nreleased under the MIT license\nof old"), (8, "\"Released under\nthe MIT license\"\nof 2020")]
    got = {r.doc_id: (r.sentence_ids, r.licenses) for r in scan(make_docs(rows)).collect()}
    mit, three = ("mit_grant,mit_notice,as_is_software", "MIT"), ("bsd_redistribution,bsd_source,bsd_binary,bsd_endorse", "BSD-3-Clause")
    assert got == {1: mit, 2: mit, 3: three, 4: three, 5: ("gpl_redistribute,gpl_no_warranty,gpl_see", "GPL-3.0-or-later"), 6: ("mpl_2", "MPL-2.0"), 7: ("mit_released", "MIT-reference"), 8: ("mit_released", "MIT-reference")}


# --- packing ---------------------------------------------------------------------------------------------------------------------

def check_packing(got, capacity):
    by = defaultdict(list)
    for r in got:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for own in by.values():
        at = 0
        for o, n in sorted(own):
            assert o == at
            at += n
        assert at <= capacity
    return len(by)


def test_packing_whole_documents(make_docs):
    from tokenizers import Tokenizer
    rows = [(i, t) for i, t in AWKWARD if i is not None] + [(100 + i, " ".join(["it's", "Élan", "x²", "½", "naïve", "a b", "中文", "<|endoftext|>", "don't", "I'LL", "ﬁne", "İ", "123"][i % 13:] * (1 + i))) for i in range(60)]
    got = [r.asDict() for r in P.pack_documents(make_docs(rows), tokenizer_path()).collect()]
    tok, want = Tokenizer.from_file(tokenizer_path()), Counter()
    for i, t in rows:
        ids = np.array([*tok.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        for p, s in enumerate(range(0, ids.size, 4096)):
            want[i, p, s, len(ids[s:s + 4096]), zlib.crc32(ids[s:s + 4096].tobytes())] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want
    assert check_packing(got, 4096) <= -(-sum(r["length"] for r in got) // 4096) + 1
    assert P.pack_documents(make_docs([]), tokenizer_path()).count() == 0


def test_packing_migrates_between_islands(spark):
    rng = random.Random(4)
    rows = [(i, 0, 0, rng.choice([rng.randrange(1, 101), 100]), i) for i in range(3000)] + [(7, 0, 0, 100, 7)] * 3
    pieces = spark.createDataFrame(rows, "doc_id long, piece int, start long, length long, ids_crc32 long")
    got = [r.asDict() for r in P.pack(pieces, capacity=100, island_pieces=150).collect()]
    assert len(got) == len(rows)
    n, least = check_packing(got, 100), -(-sum(r[3] for r in rows) // 100)
    assert n <= 1.01 * least


def test_genetic_packing_is_no_worse_than_best_fit():
    rng = random.Random(9)
    for _ in range(5):
        sizes = [rng.randrange(20, 60) for _ in range(200)]
        plain = P.best_fit(sizes, list(range(200)), [], 100)
        best = P.evolve(sizes, 100, 1)
        assert sorted(i for own in best for i in own) == list(range(200)) and all(sum(sizes[i] for i in own) <= 100 for own in best)
        assert len(best) <= len(plain)


# --- languages -------------------------------------------------------------------------------------------------------------------

def test_language_on_held_out_documents(spark, make_docs):
    make_docs([])
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = L.identify(docs, L.learn_from(docs)).where(L.held_out(F.col("doc_id")))
    right, n = got.agg(F.sum((F.col("lang") == F.col("lang_pred")).cast("int")), F.count("*")).head()
    assert right / n > 0.97


def test_language_of_mixtures_and_awkward_rows(make_docs):
    en, fr = "the quick brown fox jumps over the lazy dog while we watch them all ", "le renard brun saute par dessus le chien paresseux et nous regardons tous "
    model = L.train(make_docs([(1, en * 3, "en"), (2, fr * 3, "fr"), (3, None, "fr"), (4, "text of no language", None)]))
    assert model.langs == ["en", "fr"]
    got = {r.doc_id: r for r in L.identify(make_docs([(10, en), (11, fr), (12, (en + fr) * 20), *AWKWARD]), model).collect()}
    assert got[10].lang_pred == "en" and got[11].lang_pred == "fr" and sorted(got[12].langs) == ["en", "fr"] and 0.4 < got[12].score < 0.7
    assert got[1].lang_pred == got[2].lang_pred == got[5].lang_pred == "und" and got[1].score == 0.0
    assert got[6].lang_pred in ("en", "fr")
    assert sorted(r.doc_id or 0 for r in L.keep_identified(make_docs(AWKWARD), model).collect()) == [0, 4, 4, 6, 7, 8]
    none = L.train(make_docs([]))
    assert {r.lang_pred for r in L.identify(make_docs(AWKWARD), none).collect()} == {"und"}


def test_texts_without_repeated_anchors_stay_out_of_the_shuffle(spark, make_docs):
    """The filter loses no text that is looked at, and lets few others pass."""
    docs = B._with_digest(make_docs([(i, f"text number {i}") for i in range(3000)]))
    some = docs.where("doc_id % 3 = 0").select("doc_id", "digest")
    passed = {r.doc_id for r in B._likely(docs, some).select("doc_id").collect()}
    assert passed >= set(range(0, 3000, 3)) and len(passed) < 1250
    assert B._likely(docs, some.limit(0)).count() == 0
    size = 65536
    places = {r.p for r in some.select(B._place(size).alias("p")).collect()}
    assert set(np.flatnonzero(np.unpackbits(B.key_bits(some, size), bitorder="little")).tolist()) == places


def test_copies_leave_without_a_shuffle_of_all_anchors(make_docs):
    a, b = (" ".join(f"{c}{i}" for i in range(120)) for c in "ab")
    seen = B.cut(B.survey(make_docs([(1, a), (1, a), (2, a), (3, b), (4, "short"), (2, b), (None, a)]), B.WINDOW))
    left = B.originals(seen, B.cut(B._copies(seen, B.WINDOW)))
    digest = {r.doc_id: bytes(r.digest) for r in seen.where("doc_id in (1, 3)").collect()}
    assert sorted((r.doc_id, bytes(r.digest)) for r in left.collect()) == [(1, digest[1]), (1, digest[1]), (2, digest[3])]
    rest = [(i, " ".join(f"{i}w{j}" for j in range(60))) for i in range(10, 210)]
    seen = B.cut(B.survey(make_docs([*rest, (1, a), (2, a)]), B.WINDOW))
    gone = B.cut(B._copies(seen, B.WINDOW))
    assert [r.doc_id for r in gone.collect()] == [2]
    assert seen.where(B.may_be_among(gone)).count() < 40  # what the join with the copies shuffles

"""Substring dedup against a plain version: all earlier documents, all places."""

import random

import numpy as np
import pytest

from lorewell.llm import passages
from lorewell.llm.common import folded, word_hashes


def words(seed, n):
    r = random.Random(seed)
    return ["".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6)) for _ in range(n)]


def dedup(spark, docs):
    rows = passages.dedup_passages(spark.createDataFrame([(i, " ".join(w)) for i, w in docs.items()], "doc_id long, text string")).collect()
    return {r["doc_id"]: r["text"].split() for r in rows}


def left(docs, least=50):
    """The words of each document that are in no run of ``least`` words that an earlier one has."""
    out, seen = {}, set()
    for i in sorted(docs):
        w = docs[i]
        runs = [tuple(w[j : j + least]) for j in range(len(w) - least + 1)]
        held = {k for j, run in enumerate(runs) if run in seen for k in range(j, j + least)}
        out[i] = [x for k, x in enumerate(w) if k not in held]
        seen.update(runs)
    return out


def brute(docs, percent=80):
    """The words that stay when each document is aligned as a whole with every earlier one."""
    out, hashes = {}, {i: word_hashes(folded(" ".join(w))) for i, w in docs.items()}
    for i in docs:
        cut = set()
        for j in docs:
            if j < i:
                for shift in range(-len(docs[i]), len(docs[j]), 25):
                    cut |= {k for a, b in passages.aligned(hashes[i], hashes[j], shift, 50, percent) for k in range(a, b)}
        out[i] = [w for k, w in enumerate(docs[i]) if k not in cut]
    return out


def test_a_passage_twice_in_a_later_document(spark):
    p = words(1, 60)
    docs = {1: p, 2: p + words(2, 200) + p, 3: words(3, 30) + p + p + words(4, 30) + p}
    assert dedup(spark, docs) == left(docs) == {1: p, 2: words(2, 200), 3: words(3, 30) + words(4, 30)}


def test_pieces_in_earlier_documents_hide_no_passage(spark):
    p, q = words(1, 60), words(2, 50)
    docs = {1: p[:30] + words(3, 40), 2: words(4, 40) + p[30:], 3: words(5, 20) + p + words(6, 20), 4: words(7, 20) + p + words(8, 20)}
    docs |= {11: q[:20] + words(9, 40) + q[15:35] + words(10, 40), 12: q[30:] + words(11, 40), 13: words(12, 20) + q, 14: q + words(13, 20)}
    # the first document holds the pieces apart and then the whole
    docs |= {21: (s := words(14, 60))[20:40] + words(15, 30) + s, 22: s + words(16, 30)}
    assert dedup(spark, docs) == left(docs)
    assert dedup(spark, docs)[4] == words(7, 20) + words(8, 20)


def test_runs_that_stay_are_none_in_pieced_texts(spark):
    r, pool = random.Random(3), [words(100 + i, 70) for i in range(8)]
    docs = {}
    for i in range(60):
        docs[i] = []
        for _ in range(r.randint(1, 5)):
            p = r.choice(pool)
            a = r.randrange(0, 40)
            docs[i] += p[a : a + r.randint(10, 70)] + words(r.random(), r.choice([0, 3, 40]))
        docs[i] += ["spam"] * r.choice([0, 0, 45, 80]) + ["ham", "eggs"] * r.choice([0, 0, 40])
    got, exact = dedup(spark, docs), left(docs)
    # fuzzy stretches may go as well, but nothing stays that a run of 50 words would take
    for i in docs:
        rest = iter(exact[i])
        assert all(w in rest for w in got[i])


@pytest.mark.parametrize("every", [6, 7, 8, 10])
def test_edited_passages_are_found(spark, every):
    docs, r = {}, random.Random(every)
    for n in range(40):
        p = words(n, 66)
        edited = [f"new{n}x{k}" if k % every == every - 1 else w for k, w in enumerate(p)] if n % 2 else list(p)
        for k in r.sample(range(66), 66 // every) if not n % 2 else ():
            edited[k] = f"new{n}x{k}"
        docs[n], docs[100 + n] = words(1000 + n, 30) + p, words(2000 + n, 30) + edited + words(3000 + n, 30)
    assert dedup(spark, docs) == brute(docs)


def test_a_long_insertion_splits_no_passage(spark):
    p = words(1, 90)
    docs = {1: words(2, 30) + p + words(3, 30), 2: words(4, 30) + p[:45] + words(5, 12) + p[45:] + words(6, 30), 3: words(7, 30) + p[:45] + words(8, 30) + p[45:]}
    got = dedup(spark, docs)
    assert got[2] == words(4, 30) + words(6, 30)
    assert got[3] == docs[3]  # 90 of 120 words are less than 80 %
    assert got == brute(docs)


def test_repeated_edited_and_pieced_passages_against_brute_force(spark):
    r, docs = random.Random(8), {}
    pool = [words(50 + i, 120) for i in range(10)]
    for i in range(30):
        docs[i] = words(500 + i, 30)
        for _ in range(r.randint(0, 3)):
            p = list(r.choice(pool)[r.choice([0, 30]) : r.choice([90, 120])])
            for _ in range(r.randint(0, 6)):
                k = r.randrange(len(p))
                p[k : k + 1] = words(r.random(), r.choice([0, 1, 2, 12]))
            docs[i] += p + words(r.random(), 40)
    got, plain, exact = dedup(spark, docs), brute(docs), left(docs)
    cut = [(i, w) for i in docs for w in set(docs[i]) - set(plain[i])]
    # alignment ends a little earlier where a passage's k-mers lead to other documents
    assert sum(w in got[i] for i, w in cut) <= 0.01 * len(cut)
    assert not any(set(got[i]) - set(exact[i]) for i in docs)


def test_runs_of_a_phrase_meet_a_run_as_long(spark):
    docs = {1: words(1, 40) + ["spam"] * 30 + words(2, 40), 2: words(3, 60) + ["spam"] * 60 + words(4, 60), 3: words(5, 60) + ["spam"] * 190 + words(6, 60), 4: ["spam"] * 49 + words(7, 60)}
    docs |= {5: words(8, 60) + ["ham", "eggs", "and"] * 30, 6: words(9, 60) + ["ham", "eggs", "and"] * 80 + words(10, 60)}
    assert dedup(spark, docs) == docs | {3: words(5, 60) + words(6, 60), 6: words(9, 60) + words(10, 60)}


@pytest.mark.parametrize("bytes_of_a_part", [1, 1 << 12])
def test_any_number_of_parts_gives_the_same(spark, tmp_path, monkeypatch, bytes_of_a_part):
    p, q = words(1, 70), words(2, 55)
    docs = {i: words(10 + i, 40) + (p if i % 2 else q) + words(40 + i, 30) for i in range(12)}
    spark.createDataFrame([(i, " ".join(w)) for i, w in docs.items()], "doc_id long, text string").write.parquet(f"{tmp_path}/docs")
    monkeypatch.setattr(passages, "PART_BYTES", bytes_of_a_part)
    rows = spark.read.parquet(f"{tmp_path}/docs")
    assert (passages.parts_for(rows) > passages.PARTS) == (bytes_of_a_part == 1)
    assert {r["doc_id"]: r["text"].split() for r in passages.dedup_passages(rows).collect()} == left(docs)


def hashes(w):
    return word_hashes(folded(" ".join(w)))


@pytest.mark.parametrize("repeated, made", [(30, 0), (70, 1)])
def test_windows_are_made_only_where_another_text_has_all_their_words(monkeypatch, repeated, made):
    """A phrase over and over needs whole windows where the other text has 50 words in a row, and only there."""
    calls, real = [], passages.windows
    monkeypatch.setattr(passages, "windows", lambda *a: calls.append(1) or real(*a))
    phrase = words(1, repeated)
    one, two = phrase * 3 if made else words(2, 60) * 2 + phrase, words(3, 40) + phrase + words(4, 40)
    spans = passages.aligned(hashes(one), hashes(two), 0, 50, 80)
    assert bool(calls) == bool(made)
    assert {k for a, b in spans for k in range(a, b)} == (set(range(3 * repeated)) if made else set())


def test_packed_blocks_come_back_as_they_were():
    r = np.random.default_rng(5)
    for sizes in (passages.KMERS, passages.WINDOWS, passages.MATCHES):
        columns = [r.integers(0, 1 << (8 * k - 1 - (k == 8)), 1000) for k in sizes]
        cuts = [0, 1, 300, 301, 1000]
        whole = [passages.zstandard.decompress(b) for b in passages.packed(columns, sizes, cuts)]
        for a, b, data in zip(cuts, cuts[1:], whole):
            alone = passages.packed([c[a:b] for c in columns], sizes)
            assert data == passages.zstandard.decompress(alone[0])
            assert all((x == c[a:b]).all() for x, c in zip(passages.unpacked(data, sizes), columns))

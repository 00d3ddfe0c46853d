"""Each corpus operator against a plain version, and over nulls, empty texts, ties, repeats and clashing columns."""

import base64
import hashlib
import random
import zlib

import numpy as np
import public_tokenizers as P
import pytest

from lorewell.llm import byte_bpe, chat, jaccard, line_dedup, packing, passages, quality, queries, token_counts, topk_search, vector_dedup
from lorewell.llm.common import connected_components, counted, folded, rolled, word_hashes
from lorewell.operators.graph import trimmed

ODD = [None, "", " ", "a", "  two  words ", "été ﬁ 日本語 😀", "a\x00b\tc\n\n", "<s> <|endoftext|> <0x0A>", "x" * 5000, "ab" * 3000, "日本" * 2000, " ".join(["It"] * 400), "thing " * 3000]
SCHEMA = "doc_id long, text string, n_tokens string, ids int, score string, removed int, n_lines_removed int"


def prose(seed, n):
    r = random.Random(seed)
    return " ".join("".join(r.choice(["th", "en", "or", "a", "is", "der", "é"]) for _ in range(r.randint(1, 4))) for _ in range(n))


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i if i != 3 else None, t, "x", 1, "y", 2, 3) for i, t in enumerate(ODD + [ODD[4]])] + [(5, ODD[5], "x", 1, "y", 2, 3)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_token_counts_equal_the_library(spark, odd, empty):
    import sentencepiece

    path = P.path("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    got = token_counts.count_tokens(odd, path, limit=100)
    assert "ids" in got.columns and got.columns.count("n_tokens") == 1
    for r in got.collect():
        assert r["n_tokens"] == len(sp.encode(r["text"] or "")) and r["n_bytes"] == len((r["text"] or "").encode()) and r["over_limit"] == (r["n_tokens"] > 100)
    assert got.count() == len(ODD) + 2 and token_counts.count_tokens(empty, path).count() == 0


def test_block_maps_compose_from_any_entry():
    t = token_counts.Transducer(P.path("piece_bpe_32k.model"))
    text = token_counts.SPACE + prose(1, 300).replace(" ", "")
    whole = t.run(0, text)
    for size in (7, 64, 500):
        state, n = 0, 0
        for i in range(0, len(text), size):
            state, more = t.block_map(text[i : i + size])(state)
            n += more
        assert (state, n) == whole


def test_byte_bpe_round_trip_and_library(spark, odd, empty):
    import tiktoken

    path = P.path("byte_bpe_multi_50k.tiktoken")
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    e = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for r in byte_bpe.round_trip(odd, path, P.PATTERN).collect():
        assert np.frombuffer(r["ids"], "<u4").tolist() == e.encode_ordinary(r["text"] or "") and bytes(r["decoded"]) == (r["text"] or "").encode()
    two = byte_bpe.decode_ids(byte_bpe.encode_texts(odd, path, P.PATTERN), path, P.PATTERN)
    assert all(bytes(r["decoded"]) == (r["text"] or "").encode() for r in two.collect())
    assert byte_bpe.round_trip(empty, path, P.PATTERN).count() == 0


def test_chats_keep_maximal_conversations(spark):
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", "yo"), (2, 0, "user", "hi"), (3, 0, "user", "hi"), (3, 1, "assistant", "yo"), (3, 2, None, None), (4, 0, "user", "other"), (5, 0, "user", "other"), (None, 0, "user", "x"), (4, 0, "user", "other")]
    got = {r["conv_id"]: r for r in chat.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert set(got) == {3, 4} and got[3]["n_turns"] == 3
    assert got[3]["rendered"] == "<|user|>\nhi\n<|end|>\n<|assistant|>\nyo\n<|end|>\n<|user|>\n\n<|end|>\n"
    assert chat.format_chats(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def test_passages_are_cut_from_later_documents(spark, odd, empty):
    shared, fuzzy = prose(7, 60), prose(8, 100).split()
    altered = fuzzy[:30] + ["CHANGED"] + fuzzy[31:70] + ["ADDED", *fuzzy[70:]]
    docs = {1: prose(1, 80) + " " + shared + " " + prose(2, 50), 2: prose(3, 40) + "\n" + shared + " " + prose(4, 70), 3: prose(5, 90) + " " + " ".join(fuzzy), 4: " ".join(altered) + " " + prose(6, 30), 5: prose(9, 200), 6: shared, 7: " ".join(shared.split()[:40]) + " " + prose(10, 100)}
    got = {r["doc_id"]: r for r in passages.dedup_passages(spark.createDataFrame(list(docs.items()), "doc_id long, text string")).collect()}
    assert [got[i]["n_words_removed"] for i in (1, 3, 5, 7)] == [0, 0, 0, 0] and all(got[i]["text"] == docs[i] for i in (1, 3, 5, 7))
    assert got[2]["text"] == prose(3, 40) + "\n" + prose(4, 70) and got[6]["text"] == ""
    assert got[4]["text"].strip() == prose(6, 30) and {x["other"] for x in got[4]["removed"]} == {3}
    same = {(r["doc_id"], r["text"], r["n_words_removed"]) for r in passages.dedup_passages(odd).collect()}
    assert (0, None, 0) in same and (None, "a", 0) in same and passages.dedup_passages(empty).count() == 0


def test_runs_of_one_word_meet_runs_as_long(spark):
    # the first document has the word often, but no run of 50; the third has a run three times as long as the second's
    docs = {1: prose(1, 40) + " spam" * 30 + " " + prose(2, 40), 2: prose(3, 60) + " spam" * 60 + " " + prose(4, 60), 3: prose(5, 60) + " spam" * 190 + " " + prose(6, 60), 4: prose(7, 60) + " ham eggs and" * 30, 5: prose(8, 60) + " ham eggs and" * 80 + " " + prose(9, 60), 6: "spam " * 49 + "then " + prose(10, 60)}
    # 6 has a run of 49; the word after it must not be the one that follows the run in 3, or 50 words agree
    assert prose(6, 1) != "then"
    got = {r["doc_id"]: r["text"] for r in passages.dedup_passages(spark.createDataFrame(list(docs.items()), "doc_id long, text string")).collect()}
    assert all(got[i] == docs[i] for i in (1, 2, 4, 6))
    assert got[3].split() == (prose(5, 60) + " " + prose(6, 60)).split()
    assert got[5].split() == (prose(8, 60) + " " + prose(9, 60)).split()


def test_chains_are_best_by_brute_force():
    r = random.Random(3)
    for _ in range(30):
        n = r.randint(1, 12)
        y, x = (np.array([r.randint(0, 40) for _ in range(n)]) for _ in range(2))
        size = np.full(n, 5)
        best = 0
        for mask in range(1, 1 << n):
            own = sorted((i for i in range(n) if mask >> i & 1), key=lambda i: (y[i], x[i]))
            if all(y[a] < y[b] and x[a] < x[b] for a, b in zip(own, own[1:])):
                best = max(best, 5 * len(own) - passages.GAP_COST * sum(y[b] - y[a] - 5 + x[b] - x[a] - 5 for a, b in zip(own, own[1:])))
        chain = passages.chains(y, x, size)[0]
        got = 5 * len(chain) - passages.GAP_COST * sum(y[b] - y[a] - 5 + x[b] - x[a] - 5 for a, b in zip(chain, chain[1:]))
        assert got == pytest.approx(best)


def test_packing_holds_every_token_once(spark, odd, empty):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    pieces = packing.pack_documents(odd, queries.packing_tokenizer()).toPandas()
    by = {}
    for r in pieces.sort_values("start").itertuples():
        by.setdefault((None if np.isnan(r.doc_id) else int(r.doc_id)), []).append(r)
    for i, text in enumerate(ODD):
        if i in (3, 5):
            continue
        ids = np.array(t.encode(text or "", add_special_tokens=False).ids + [0], dtype="<u4")
        assert b"".join(r.ids for r in by[i]) == ids.tobytes() and all(r.doc_tokens == len(ids) for r in by[i])
    for _, g in pieces.sort_values("offset").groupby("sequence_id"):
        total = int(g["length"].sum())
        assert total <= 1024 and (total & (total - 1)) == 0 and g["offset"].tolist() == (g["length"].cumsum() - g["length"]).tolist()
    assert packing.pack_documents(empty, queries.packing_tokenizer()).count() == 0


def test_hilbert_neighbours_are_one_step_apart():
    points = np.array([(a, b, c) for a in range(8) for b in range(8) for c in range(8)])
    order = np.argsort(packing.hilbert(points, 3))
    assert sorted(packing.hilbert(points, 3)) == list(range(512))
    assert (np.abs(np.diff(points[order], axis=0)).sum(axis=1) == 1).all()


def test_long_texts_are_cut_where_tokens_end():
    text = prose(4, 120_000)
    parts = packing.segments(text)
    assert len(parts) > 1 and "".join(parts) == text


def plain_chunks(text):
    lines = text.split("\n")
    h = [int(hashlib.md5(x.encode()).hexdigest()[:8], 16) for x in lines]
    hit = [sum(h[i - j] * 31**j for j in range(line_dedup.WINDOW) if i >= j) % line_dedup.DIVISOR == 0 for i in range(len(h))]
    out, own = [], []
    for i, x in enumerate(lines):
        own.append(x)
        if i == len(lines) - 1 or (i and hit[i] and not hit[i - 1]):
            out.append(own)
            own = []
    return out


def test_line_dedup_equals_a_plain_version(spark):
    r = random.Random(9)
    pool = [[prose(r.random(), 4) for _ in range(r.randint(2, 25))] for _ in range(12)]
    docs = {i: "\n".join(x for _ in range(r.randint(1, 4)) for x in r.choice(pool) + [prose(r.random(), 3)]) for i in range(60)}
    seen, want = set(), {}
    for i, text in docs.items():
        left = []
        for chunk in plain_chunks(text):
            key = "\n".join(chunk)
            if len(chunk) > 1 and key in seen:
                continue
            seen.add(key)
            left += chunk
        want[i] = "\n".join(left)
    got = {x["doc_id"]: x["text"] for x in line_dedup.dedup_lines(spark.createDataFrame(list(docs.items()), "doc_id long, text string")).collect()}
    assert got == want and sum(map(len, want.values())) < 0.8 * sum(map(len, docs.values()))


def test_line_dedup(spark, odd, empty):
    block = "\n".join(f"line {i} of the block" for i in range(30))
    rows = [(1, "start\n" + block + "\nend one"), (2, "other\nthings\n" + block + "\nend two"), (3, None), (4, ""), (5, "single"), (6, "single"), (2, "other\nthings\n" + block + "\nend two")]
    got = line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == 7
    by = {r["doc_id"]: r for r in got}
    assert by[1]["text"] == rows[0][1] and by[1]["n_lines_removed"] == 0 and by[3]["text"] is None and by[4]["text"] == "" and by[6]["text"] == "single"
    assert by[2]["n_lines_removed"] > 0 and by[2]["text"].startswith("other\nthings\n") and by[2]["text"].endswith("end two")
    assert len(by[2]["text"].split("\n")) + by[2]["n_lines_removed"] == 33  # 30 lines of the block and 3 others
    assert line_dedup.dedup_lines(odd).count() == len(ODD) + 2 and line_dedup.dedup_lines(empty).count() == 0


def brute_groups(docs):
    sets = {}
    for i, text in docs.items():
        w = (text or "").encode().lower().split()
        sets[i] = {tuple(w[j : j + 5]) for j in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    root = {i: i for i in docs}
    for a in docs:
        for b in docs:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = (next(iter(_roots(root, k))) for k in (a, b))
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), next(iter(_roots(root, i)))) for i in docs}


def _roots(root, i):
    while root[i] != i:
        i = root[i]
    return [i]


def test_jaccard_groups_equal_brute_force(spark, odd, empty):
    r = random.Random(5)
    docs = {}
    for g in range(12):
        base = prose(100 + g, r.choice([3, 12, 40, 120])).split()
        for _ in range(r.randint(1, 7)):
            w = list(base)
            for _ in range(r.randint(0, 3)):
                w[r.randrange(len(w))] = prose(r.random(), 1)
            docs[len(docs)] = " ".join(w).upper() if r.random() < 0.3 else " ".join(w)
    docs |= {900: None, 901: "", 902: " \t", 903: "one two", 904: "ONE  two", 905: "one two three four five"}
    got = {x["doc_id"]: (x["n_shingles"], x["component_id"]) for x in jaccard.jaccard_groups(spark.createDataFrame(list(docs.items()), "doc_id long, text string")).collect()}
    assert got == brute_groups(docs)
    assert jaccard.jaccard_groups(odd).count() == len(ODD) + 2 and jaccard.jaccard_groups(empty).count() == 0


def test_long_lists_equal_brute_force(spark, monkeypatch):
    """Near copies of which no document is the centre, and passages in documents of all sizes, with passes and small blocks."""
    r = random.Random(11)
    docs, shared = {}, prose(500, 30)
    for g in range(3):
        base = prose(200 + g, 60).split()
        for _ in range(25):
            gone = r.randrange(50)
            docs[len(docs)] = " ".join(base[:gone] + base[gone + r.randint(0, 12) :])
    for _ in range(40):
        docs[len(docs)] = shared + " " + prose(r.random(), r.choice([2, 6, 8, 30, 100]))
    for name, value in (("LONG", 4), ("BLOCKS_FROM", 10), ("BLOCK_DOCS", 8), ("BLOCK_SHINGLES", 600), ("SPARSE", 30), ("COLUMNS", 7), ("CELLS_AT_ONCE", 64)):
        monkeypatch.setattr(jaccard, name, value)
    rows = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    assert {x["doc_id"]: (x["n_shingles"], x["component_id"]) for x in jaccard.jaccard_groups(rows).collect()} == brute_groups(docs)


@pytest.mark.parametrize("n", [100, 300])
def test_pairs_of_near_copies_without_a_centre_are_in_proportion(spark, monkeypatch, n):
    """Each of n texts lacks 19 words at another place; only like places link. A few pairs for each text lead to the one component."""
    r, base, looked = random.Random(n), prose(700, 160).split(), []
    docs = {i: " ".join(base[:at] + base[at + 19 :]) for i, at in enumerate(r.randrange(141) for _ in range(n))}
    verified = jaccard._verified
    monkeypatch.setattr(jaccard, "_verified", lambda pairs, *rest: (looked.append(pairs.count()), verified(pairs, *rest))[1])
    rows = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    got = {x["doc_id"]: (x["n_shingles"], x["component_id"]) for x in jaccard.jaccard_groups(rows).collect()}
    assert got == brute_groups(docs)
    assert sum(looked) < 10 * n, looked


@pytest.mark.parametrize("sparse", [0, 30, 10**9])
def test_products_count_overlaps(monkeypatch, sparse):
    r = np.random.default_rng(3)
    sides = [[np.unique(r.integers(0, 90, r.integers(0, 60))).astype(np.uint64) for _ in range(m)] for m in (23, 17)]
    for name, value in (("SPARSE", sparse), ("COLUMNS", 11), ("CELLS_AT_ONCE", 50)):
        monkeypatch.setattr(jaccard, name, value)
    assert (jaccard.overlaps_of(*sides) == [[len(np.intersect1d(x, y)) for y in sides[1]] for x in sides[0]]).all()


def test_rows_that_repeat_an_id_link_by_each_text(spark):
    """Two texts of like size under one id, one in the other, and a document that only the shorter one is near enough to."""
    rows = []
    for g in range(40):
        words = prose(3000 + g, 100).split()
        near = [f"{w}x" if i in (30, 60) else w for i, w in enumerate(words)]
        rows += [(10 * g + 1, " ".join(words)), (10 * g + 1, prose(4000 + g, 20) + " " + " ".join(words)), (10 * g, " ".join(near)), (10 * g + 2, prose(5000 + g, 100))]
    got = {}
    for x in jaccard.jaccard_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        got.setdefault(x["doc_id"], set()).add(x["component_id"])
    assert got == {10 * g + i: {10 * g + (2 if i == 2 else 0)} for g in range(40) for i in range(3)}


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, 101), (101, 100), (102, 102), (None, 5), (200, 100)]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(61)} | {100: 100, 101: 100, 200: 100}


def test_components_of_few_edges_take_few_tasks(spark):
    """With 50 shuffle partitions that Spark doesn't coalesce, rounds over 60 edges don't cost a task for each."""
    names = {"spark.sql.shuffle.partitions": "50", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in names}
    sc = spark.sparkContext
    try:
        for k, v in names.items():
            spark.conf.set(k, v)
        sc.setJobGroup("few-edges", "components")
        labels = connected_components(spark.createDataFrame([(i, i + 1) for i in range(60)], "a long, b long"))
        tracker = sc.statusTracker()
        stages = {s for j in tracker.getJobIdsForGroup("few-edges") for s in tracker.getJobInfo(j).stageIds}
        tasks = sum(info.numCompletedTasks for info in map(tracker.getStageInfo, stages) if info)
        assert {r["component"] for r in labels.collect()} == {0}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
        sc.setLocalProperty("spark.jobGroup.id", None)
    assert tasks < 2000, tasks  # 4914 when every step had a task for each partition


def test_compact_counts_rows_while_it_writes_them(spark):
    """It has the tasks of its rows' partitions alone; counting was a second job over all of them."""
    sc = spark.sparkContext
    sc.setJobGroup("compact", "rows")
    try:
        kept, rows = counted(spark.range(0, 100_000, 1, 50).where("id % 2 = 0"))
        tracker = sc.statusTracker()
        stages = {s for j in tracker.getJobIdsForGroup("compact") for s in tracker.getJobInfo(j).stageIds}
        tasks = sum(info.numCompletedTasks for info in map(tracker.getStageInfo, stages) if info)
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
    assert (rows, tasks, kept.rdd.getNumPartitions(), kept.count()) == (50_000, 50, 1, 50_000)
    assert counted(spark.range(0))[1] == 0


def test_native_memory_of_the_driver_is_given_back(spark):
    said = trimmed(spark)
    if not said:
        pytest.skip("this Java has no System.trim_native_heap")
    assert "Trim native heap" in said


def _vectors(spark):
    r = np.random.default_rng(2)
    v = r.normal(size=(400, 16))
    near = v[:60] + r.normal(size=(60, 16)) * 0.12
    rows = [[float(np.float32(x)) for x in row] for row in np.concatenate([v, near, np.repeat(v[:1], 30, axis=0)])]
    odd = [None, [], [None] * 16, [float("nan")] * 16, [0.0] * 16, [1.0, 2.0], [float("inf")] * 16]
    return spark.createDataFrame([(i, x, 1) for i, x in enumerate(rows + odd)], "vec_id long, embedding array<float>, score int"), np.array(rows)


def brute_vectors(rows, cosine=0.9):
    """(id, n_links, component_id, kept) of rows (id, vector) of one length, by all pairs."""
    fine = [k for k, (i, v) in enumerate(rows) if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    m = np.array([rows[k][1] for k in fine], dtype=np.float64)
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    near = m @ m.T >= cosine
    label = np.array([rows[k][0] for k in fine])
    while True:
        new = np.array([label[x].min() for x in near])
        if (new == label).all():
            break
        label = new
    found = dict(zip(fine, zip((near.sum(axis=1) - 1).tolist(), label.tolist())))
    out = [(i, *found.get(k, (0, i))) for k, (i, _) in enumerate(rows)]
    return sorted([(i, n, c, None if i is None else i == c) for i, n, c in out], key=repr)


def test_near_vectors_with_repeated_and_null_ids(spark):
    """Ids repeat with equal and with other vectors; all rows are compared with brute force."""
    r = np.random.default_rng(8)
    base = r.normal(size=(60, 16))
    every = [(i, b) for i, b in enumerate(base)] + [(200 + i, b + r.normal(size=16) * 0.08) for i, b in enumerate(base[:30])]
    # 7 has two vectors, each with a near one; 8 is there twice with one vector; a null id has no part in links
    every += [(7, base[40]), (8, base[8]), (8, base[8]), (None, base[3]), (300, base[40] + 0.01)]
    rows = [(i, [float(np.float32(x)) for x in v]) for i, v in every] + [(400, None), (401, [None] * 16), (402, [0.0] * 16)]
    got = vector_dedup.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>"))
    assert sorted(map(tuple, got.select("vec_id", "n_links", "component_id", "kept").collect()), key=repr) == brute_vectors(rows)


def test_topk_is_exact(spark):
    df, v = _vectors(spark)
    got = {}
    for r in topk_search.search(df, "vec_id % 100 = 0 OR vec_id >= 490", 10).collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = (r["vec_id"], r["score"])
    w = np.floor(1024 * v).astype(np.int64)
    zero = np.concatenate([w, np.zeros((4, 16), dtype=np.int64)])  # the zero vector (id 494) takes part
    for q in (0, 100, 200, 300, 400):
        s = w @ w[q]
        s = np.append(s, 0)
        ids = np.append(np.arange(len(w)), len(w) + 4)
        keep = ids != q
        order = np.lexsort((ids[keep], -s[keep]))[:10]
        assert [got[q][k] for k in range(1, 11)] == [(ids[keep][o], s[keep][o]) for o in order]
    assert zero.shape[1] == 16 and 495 not in got and topk_search.search(df.limit(0), "true").count() == 0


def test_vector_links_and_recall(spark):
    df, v = _vectors(spark)
    got = {r["vec_id"]: r for r in vector_dedup.near_vectors(df).collect()}
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    want = (u @ u.T >= 0.9) & ~np.eye(len(u), dtype=bool)
    found = np.array([got[i]["n_links"] for i in range(len(u))])
    assert (found <= want.sum(axis=1)).all() and found.sum() >= 0.9 * want.sum()
    assert all(got[i]["n_links"] == 0 and got[i]["component_id"] == i and got[i]["kept"] for i in range(len(u), len(u) + 7))
    assert got[470]["component_id"] == 0 and not got[470]["kept"] and vector_dedup.near_vectors(df.limit(0)).count() == 0


def test_quality_learns_and_takes_odd_texts(spark, odd, empty):
    docs = [(i, prose(i, 150) if i % 3 else prose(i, 100).upper().replace(" ", "!! ")) for i in range(240)]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(240)] + [(500, None, 0), (1, 0, 0)], "doc_id long, quality int, toxic int")
    model = quality.fit(d, labels)
    held = [r for r in quality.score(d, model).collect() if zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1]
    assert np.mean([r["predicted"] == int(r["doc_id"] % 3 > 0) for r in held]) > 0.95
    scores = quality.score(odd, model).collect()
    assert len(scores) == len(ODD) + 2 and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in scores)
    assert quality.fit(d, labels.limit(0)) is None and {r["score"] for r in quality.score(odd, None).collect()} == {0.5} and quality.score(empty, model).count() == 0


def test_gradients_are_those_of_the_loss():
    r = np.random.default_rng(1)
    bags = [quality.encode_passages(prose(i, 200)) for i in range(3)]
    p = quality.train(bags, [1, 0, 1], epochs=1)
    x, starts, y = np.concatenate(bags).astype(float), np.cumsum([0] + [len(b) for b in bags[:-1]]), np.array([1.0, 0, 1])
    weight = np.ones(3)
    loss = lambda q: -np.sum(y * np.log(quality.forward(q, x, starts)[0]) + (1 - y) * np.log(1 - quality.forward(q, x, starts)[0]))
    s, kept = quality.forward(p, x, starts)
    grad = quality.gradients(p, y, starts, s, kept, weight)
    for k in ("b", "w", "c"):
        i = r.integers(len(p[k]))
        up, down = ({**p, k: p[k].copy()} for _ in range(2))
        up[k][i] += 1e-5
        down[k][i] -= 1e-5
        assert (loss(up) - loss(down)) / 2e-5 == pytest.approx(grad[k][i], rel=1e-3, abs=1e-6)


def test_sha_of_ids_as_the_query_gives_it(spark):
    got = queries.op3_byte_bpe(spark, "/root/testdata/sf0.001").first()
    assert len(got["ids_sha256"]) == 64 and hashlib.sha256(b"").hexdigest() != got["decoded_sha256"]

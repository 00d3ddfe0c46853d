"""Very long rows, repeated ids and texts that no boundary cuts, operator by operator."""

import random

import numpy as np
import public_tokenizers
import sentencepiece

from lorewell.llm import chat, line_dedup, topk_search, token_counts


def test_a_very_long_conversation_and_its_beginnings(spark):
    turns = [(t, "user" if t % 2 == 0 else "assistant", f"turn {t % 11}") for t in range(6000)]
    rows = [(5, *t) for t in turns] + [(2, *t) for t in turns[:3000]] + [(1, *t) for t in turns[:1]] + [(9, *t) for t in turns] + [(7, 0, "user", "turn 0"), (7, 1, "user", "own")]
    got = {r["conv_id"]: r for r in chat.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert set(got) == {5, 7} and got[5]["n_turns"] == 6000
    assert got[5]["rendered"] == "".join(f"<|{role}|>\n{text}\n<|end|>\n" for _, role, text in turns)


def test_a_very_long_text_loses_its_repeated_lines(spark):
    r = random.Random(1)
    line = lambda: "".join(r.choice("abcdefgh ") for _ in range(20))
    block = [line() for _ in range(40)]
    long = [line() for _ in range(30_000)]
    for at in range(0, 30_000, 3000):
        long[at:at] = block
    docs = spark.createDataFrame([(1, "\n".join(long)), (2, "\n".join(block)), (3, "x" * 3_000_000)], "doc_id long, text string")
    got = {x["doc_id"]: x for x in line_dedup.dedup_lines(docs).collect()}
    left = got[1]["text"].split("\n")
    # the block stays once; of the others only lines next to their edges may
    assert got[1]["n_lines_removed"] == len(long) - len(left) and 300 < got[1]["n_lines_removed"] <= 360
    assert left.count(block[20]) == 1 and got[2]["n_lines_removed"] > 30 and len(got[3]["text"]) == 3_000_000


def test_rows_that_repeat_an_id_are_candidates_of_their_own(spark):
    r = np.random.default_rng(5)
    rows = [(int(i), [float(np.float32(x)) for x in r.normal(size=8)]) for i in [*range(60), 3, 3, 7]]
    got = topk_search.search(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), "vec_id = 50", 10)
    w = np.floor(1024 * np.array([v for _, v in rows])).astype(np.int64)
    ids = np.array([i for i, _ in rows])
    s, keep = w @ w[50], ids != 50
    order = np.lexsort((ids[keep], -s[keep]))[:10]
    assert [(x["vec_id"], x["score"]) for x in got.orderBy("rank").collect()] == [(int(ids[keep][o]), int(s[keep][o])) for o in order]


def test_a_long_text_without_any_boundary(spark):
    path = public_tokenizers.path("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    r = random.Random(2)
    texts = ["a" * 70_001, "".join(r.choice("etaoin") for _ in range(90_000)), "".join(r.choice("ab \n") for _ in range(70_000)), "é" * 66_000, " " * 70_000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {x["doc_id"]: x["n_tokens"] for x in token_counts.count_tokens(docs, path).collect()}
    assert got == {i: len(sp.encode(t)) for i, t in enumerate(texts)}

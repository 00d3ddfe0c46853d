"""Personal data: base spans against Python's own matching, and contextual extraction against the SQL and by hand."""

import hashlib
import random
import re

import duckdb
import pytest

from lorewell.llm import personal_data as P

SCHEMA = "doc_id long, text string"
PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    return sum(sum(divmod(2 * int(c), 10)) if i % 2 else int(c) for i, c in enumerate(reversed(d))) % 10 == 0


def base(text):
    out = []
    for kind, pattern in PLAIN.items():
        # Python takes quadratic time over long runs that no match ends
        for m in re.finditer(pattern, text or "") if P.RULES[kind][0] in (text or "") else ():
            d = re.sub("[^0-9]", "", m[0])
            fine = {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")), "card": 13 <= len(d) <= 19 and luhn(d), "phone": 9 <= len(d) <= 15}
            if fine[kind]:
                out.append((kind, *m.span()))
    return out


def told(spans):
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def texts():
    r = random.Random(4)
    out = [None, "", " ", "a@b.c_d@e.f x@y z@q.", "1.2.3.4.5.6.7.8.9 256.1.1.1 001.02.3.255 1.1.1", "4111 1111 1111 1111 4111-1111-1111-1112", "+1 (437) 555-0689, +12 +123456789", "ñé 𝄞 me@x.org\n\t4111111111111111 0000000000000"]
    out += ["".join(r.choice("ab1 2.@+-() 9é") for _ in range(r.randrange(120))) for _ in range(400)]
    out += ["".join(r.choice("0123456789 -.+") for _ in range(200)) for _ in range(100)]
    return out


def test_base_spans_are_those_of_plain_matching(spark):
    docs = list(enumerate(texts()))
    got = {r["doc_id"]: r for r in P.find_personal_data(spark.createDataFrame(docs, SCHEMA)).collect()}
    for i, text in docs:
        want = base(text)
        assert got[i]["base_sha256"] == hashlib.sha256(told(want).encode()).hexdigest(), text
        assert [got[i][f"n_{k}"] for k in P.KINDS] == [sum(x[0] == k for x in want) for k in P.KINDS]
        # what the method adds comes beside the base spans
        assert set(told(want).split(",")) - {""} <= set(got[i]["spans"].split(","))


def test_very_long_texts(spark):
    long = ["7" * 300_000, "1 " * 200_000, "1.2." * 100_000, "a" * 400_000 + "@b.c", "a@b." * 50_000, "#" * 300_000 + "1", "me@x.org " * 20_000]
    got = {r["doc_id"]: r for r in P.find_personal_data(spark.createDataFrame(list(enumerate(long)), SCHEMA)).collect()}
    for i, text in enumerate(long):
        assert got[i]["base_sha256"] == hashlib.sha256(told(base(text)).encode()).hexdigest(), i


def contextual():
    """E-mail addresses and cards in contexts of their own; values that the rules don't know in the same contexts."""
    docs = [f"Hello there, write to user{i}x@mail{i}.org today." for i in range(9)]
    docs += [f"The bill was paid, card no: {n} thanks." for n in ("4111111111111111", "5500000000000004", "340000000000009", "30000000000004", "6011000000000004", "3530111333300000")]
    docs += ["Please write to anna@localhost today.", "He paid with card no: 4111111111111112 thanks.", "Again anna@localhost was here.", "Nothing of note in 2024, said 30 people.", "token is ab12cd34ef and mail was user1x@mail1.org twice"]
    # a context that all kinds share says nothing
    docs += [f"see the {v} there" for v in ("q@w.ee", "a@s.dd", "z@x.cc", "r@t.yy", "f@g.hh", "10.1.1.1", "10.1.1.2", "10.1.1.3", "abc1234567")]
    return list(enumerate(docs))


def test_contexts_lead_to_unknown_values(spark):
    docs = contextual()
    got = {r["doc_id"]: r for r in P.find_personal_data(spark.createDataFrame(docs, SCHEMA)).collect()}
    at = {i: t for i, t in docs}
    added = {i: set(r["spans"].split(",")) - set(told(base(at[i])).split(",")) for i, r in got.items() if r["n_found"]}
    words = {i: {(s.split(":")[0], at[i][int(s.split(":")[1]) : int(s.split(":")[2])]) for s in x} for i, x in added.items()}
    assert words == {15: {("email", "anna@localhost")}, 16: {("card", "4111111111111112")}, 17: {("email", "anna@localhost")}}


@pytest.mark.parametrize("docs", [contextual(), [(i, t) for i, t in enumerate(texts()) if t is None or "\0" not in t]], ids=["contextual", "random"])
def test_equals_the_sql(spark, docs):
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", docs)
    found = con.execute(P.PERSONAL_DATA_SQL)
    names = [d[0] for d in found.description]
    got = P.find_personal_data(spark.createDataFrame(docs, SCHEMA))
    assert sorted(map(tuple, got.select(*names).collect())) == sorted(found.fetchall())


def test_nulls_repeats_and_clashing_names(spark):
    rows = [(1, "me@x.org", 5, "k", 1, 2), (1, "me@x.org", 6, "k", 1, 2), (None, "me@x.org", 7, "k", 1, 2), (None, None, 8, "k", 1, 2)]
    docs = spark.createDataFrame(rows, SCHEMA + ", spans long, _key string, start long, value long")
    got = P.find_personal_data(docs)
    assert {"_key", "start", "value"} <= set(got.columns) and got.columns.count("spans") == 1
    assert sorted(r["spans"] for r in got.collect()) == ["", "email:0:8", "email:0:8", "email:0:8"]


def test_empty_table(spark):
    assert P.find_personal_data(spark.createDataFrame([], SCHEMA)).count() == 0

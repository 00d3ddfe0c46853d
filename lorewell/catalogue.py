"""The registered queries of the engine and, beside each, the same in DuckDB's SQL."""

from __future__ import annotations

import json
import re
import uuid

from pyspark.sql import functions as F

from .functions import security, vectors, vocab
from .functions import text as T
from .operators import ingest as I
from .operators import knowledge as K
from .operators import resolution as V
from .operators import retrieval as R
from .operators import extraction as X
from .operators import governed as G
from .operators.graph import checkpoint, merge_components, shared_folder
from .sources import bindings as B
from .sources import objects
from .sources.store import Store, open_store, write_store
from .sources.vector_index import open_vectors, search_vectors, write_vectors
from .streaming import ingest as S
from .streaming import status

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def quoted(words) -> str:
    return ", ".join("'" + w + "'" for w in words)


# --- shared parts of the SQL ------------------------------------------------------------------

DOCS = """docs AS (
  SELECT d.doc_id::VARCHAR AS id, d.source || '_' || d.lang || '_' || d.doc_id || '.txt' AS name, d.text,
         (['official', 'analyst', 'rumor'])[substr(d.source, 4)::INT % 3 + 1] AS source_tier,
         coalesce(t.toxic, 0) = 1 AS controlled, d.source AS department, d.doc_id AS seq
  FROM documents d LEFT JOIN (SELECT doc_id, max(toxic) AS toxic FROM labels GROUP BY doc_id) t USING (doc_id))"""
FIRST = "firsts AS (SELECT * FROM docs QUALIFY row_number() OVER (PARTITION BY sha256(text) ORDER BY seq) = 1)"
BODY = "regexp_replace(text, '^\\s+|\\s+$', '', 'g')"
CHUNKS = f"""bodies AS (SELECT *, {BODY} AS body FROM docs),
spots AS (SELECT *, unnest(generate_series(0, (greatest(0, ceil((length(body) - 500) / 420.0)) * 420)::BIGINT, 420)) AS pos FROM bodies WHERE length(body) > 0),
chunks AS (SELECT substr(md5(id || '||' || pos), 1, 12) AS chunk_id, id AS doc_id, substr(md5(id || '|'), 1, 12) AS parent_id, pos,
                  substr(body, pos + 1, 500) AS text, controlled, name, department FROM spots)"""
TOKENS = "regexp_extract_all(lower(%s), '[A-Za-z0-9]+|[\\x{4e00}-\\x{9fff}]')"
POSTS = f"""toks AS (SELECT chunk_id, {TOKENS % 'text'} AS t FROM chunks),
post AS (SELECT chunk_id, len, term, count(*) AS tf FROM (SELECT chunk_id, len(t) AS len, unnest(t) AS term FROM toks) GROUP BY ALL),
stat AS (SELECT count(*) AS n, sum(len(t)) / greatest(count(*), 1) AS avg_len FROM toks),
dfs AS (SELECT term, count(*) AS df FROM post GROUP BY term)"""
ASKED = [(1, "what is the tion of the er", "analyst"), (2, "overall trend across der und die", "viewer"), (3, "status of la ment and of que", "strategy"), (4, "main themes in general", "compliance")]
QUESTIONS = "questions(query_id, query, role) AS (VALUES " + ", ".join(f"({i}, '{q}', '{r}')" for i, q, r in ASKED) + ")"
TERMS = f"terms AS (SELECT DISTINCT query_id, unnest({TOKENS % 'query'}) AS term FROM questions)"
BM25 = """hits AS (
  SELECT t.query_id, p.chunk_id, round(sum(ln(1 + (s.n - d.df + 0.5) / (d.df + 0.5)) * p.tf * 2.5 / (p.tf + 1.5 * (0.25 + 0.75 * p.len / s.avg_len))) + 1e-9, 6) AS score
  FROM post p JOIN terms t USING (term) JOIN dfs d USING (term) CROSS JOIN stat s GROUP BY ALL)"""
SEEN = "seen AS (SELECT h.* FROM hits h JOIN chunks c USING (chunk_id) JOIN questions q USING (query_id) WHERE score > 0 AND (NOT c.controlled OR q.role != 'viewer'))"
FEATURES = """f_tok AS (SELECT id, md5(f) AS h, count(*)::DOUBLE AS n FROM (SELECT id, unnest(%s) AS f FROM src) GROUP BY ALL),
f_tri AS (SELECT id, md5(f) AS h, count(*)::DOUBLE AS n FROM (SELECT id, substr(text, i, 3) AS f FROM (SELECT id, text, unnest(generate_series(1, length(text) - 2)) AS i FROM src WHERE length(text) >= 3)) GROUP BY ALL),
f_all AS (SELECT id, ('0x' || right(h, 2))::INT AS bucket, n * CASE WHEN ('0x' || substr(h, 30, 1))::INT %% 2 = 1 THEN 1 ELSE -1 END AS v FROM f_tok
          UNION ALL SELECT id, ('0x' || right(h, 2))::INT, n * 0.5 FROM f_tri),
feats AS (SELECT id, bucket, sum(v) AS value FROM f_all GROUP BY ALL HAVING sum(v) != 0),
norms AS (SELECT id, sqrt(sum(value * value)) AS norm FROM feats GROUP BY id)""" % (TOKENS % "text")


def questions(spark):
    return spark.createDataFrame(ASKED, "query_id int, query string, role string")


def docs_and_chunks(spark, sf_dir):
    d = B.documents(spark, sf_dir)
    return d, I.chunks(d)


_stores: dict[tuple[str, str], str] = {}


def store(spark, sf_dir) -> Store:
    """The stored index of the documents, written when a session first asks for it and again when their files change."""
    files = [B.table(spark, sf_dir, t).select(*[f"_metadata.file_{c}" for c in ("path", "size", "modification_time")]).distinct() for t in ("documents", "labels")]
    state = files[0].union(files[1]).agg(F.sha2(F.array_join(F.array_sort(F.collect_list(F.concat_ws(" ", *files[0].columns))), ","), 256)).first()[0]
    key = spark.sparkContext.applicationId, state
    if key not in _stores:
        write_store(B.documents(spark, sf_dir, sent=True), path := f"{shared_folder(spark)}/store-{uuid.uuid4().hex}")
        _stores[key] = path
    return open_store(spark, _stores[key])


# --- ingest -----------------------------------------------------------------------------------


@query(f"WITH {DOCS}, {FIRST} SELECT seq, sha256(text) AS sha256 FROM firsts")
def doc_dedup_fingerprint(spark, sf_dir):
    return I.dedup(B.documents(spark, sf_dir)).select("seq", "sha256")


def _any(words, at="t"):
    return "(" + " OR ".join(f"contains({at}, '{w}')" for w in words) + ")"


TIERED = f"""tiered AS (SELECT *, CASE WHEN source_tier = 'official' AND {_any(vocab.HIGH_VALUE)} THEN 'A' WHEN {_any(vocab.LOW_VALUE)} THEN 'C'
  WHEN source_tier = 'rumor' AND NOT {_any(vocab.HIGH_VALUE)} THEN 'C' WHEN source_tier = 'official' OR {_any(vocab.HIGH_VALUE)} THEN 'A'
  WHEN length(text) < 200 AND NOT {_any(vocab.ENTITY_HINTS)} THEN 'C' ELSE 'B' END AS tier
  FROM (SELECT *, lower(name || ' ' || substr(text, 1, 2000)) AS t FROM %s))"""


@query(f"WITH {DOCS}, {TIERED % 'docs'} SELECT id, tier FROM tiered")
def doc_tier_classify(spark, sf_dir):
    return I.classify(B.documents(spark, sf_dir)).select("id", "tier")


@query(f"WITH {DOCS}, {FIRST}, {TIERED % 'firsts'} SELECT tier, count(*) AS n FROM tiered GROUP BY tier UNION ALL SELECT 'deduped', (SELECT count(*) FROM docs) - (SELECT count(*) FROM firsts)")
def doc_tier_counts(spark, sf_dir):
    docs = B.documents(spark, sf_dir)
    return I.stats(docs, I.classify(I.dedup(docs)))


@query(f"WITH {DOCS}, {CHUNKS} SELECT chunk_id, doc_id, parent_id, pos, length(text) AS n FROM chunks")
def chunk_windows(spark, sf_dir):
    return docs_and_chunks(spark, sf_dir)[1].select("chunk_id", "doc_id", "parent_id", "pos", F.length("text").cast("long").alias("n"))


HTML = r"""web AS (SELECT page_id::VARCHAR AS id, url AS name, regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?i)<h[1-3][^>]*>', chr(10) || '# ', 'g'), '<[^>]*>', chr(10), 'g'), '^\s+|\s+$', '', 'g'), '\n(#{1,3}\s)', chr(1) || '\1', 'g') AS text FROM pages),
parts AS (SELECT id, name, unnest(string_split(text, chr(1))) AS p, generate_subscripts(string_split(text, chr(1)), 1) - 1 AS ord FROM web),
split AS (SELECT id, name, ord, CASE WHEN regexp_matches(p, '^#{1,3}\s*.') THEN regexp_replace(regexp_extract(p, '^#{1,3}\s*(.+)', 1), '^\s+|\s+$', '', 'g') ELSE '' END AS section,
  regexp_replace(CASE WHEN regexp_matches(p, '^#{1,3}\s*.') THEN regexp_replace(p, '^#{1,3}\s*.+', '') ELSE p END, '^\s+|\s+$', '', 'g') AS body FROM parts),
kept AS (SELECT * FROM split WHERE body != '' QUALIFY row_number() OVER (PARTITION BY id, section ORDER BY ord DESC) = 1)"""


@query(f"WITH {HTML} SELECT substr(md5(id || '|' || section), 1, 12) AS page_id, id AS doc_id, section, length(body) AS n FROM kept")
def page_sections(spark, sf_dir):
    rows = I.sectioned(B.web_pages(spark, sf_dir)).where("body != ''")
    return I.latest(rows, ["id", "section"], "ord").select(
        T.stable_id(F.col("id"), F.col("section")).alias("page_id"), F.col("id").alias("doc_id"), "section", F.length("body").cast("long").alias("n")
    )


@query(f"WITH {HTML} SELECT substr(md5(id || '|' || section), 1, 12) AS page_id, CASE WHEN section = '' THEN name ELSE section END AS title, substr(body, 1, 160) AS summary FROM kept")
def page_summary(spark, sf_dir):
    return I.pages(B.web_pages(spark, sf_dir).withColumn("tier", F.lit("B"))).where("body != ''").select("page_id", "title", "summary")


@query("SELECT page_id, regexp_extract(url, '^https?://([^/:]+)', 1) AS host, length(html) AS n FROM pages")
def page_sources(spark, sf_dir):
    return B.table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("url", "^https?://([^/:]+)", 1).alias("host"), F.length("html").cast("long").alias("n"))


TERM = (("[A-Z][a-z]{7,}", "Term"),)
MENTIONS = f"""found AS (SELECT id AS doc_id, unnest(m) AS name, generate_subscripts(m, 1) AS rank FROM (SELECT id, regexp_extract_all({BODY}, '[A-Z][a-z]{{7,}}') AS m FROM docs)),
ments AS (SELECT doc_id, name, min(rank) AS rank FROM found GROUP BY ALL)"""


def _entities(spark, sf_dir):
    return I.entities(B.documents(spark, sf_dir).withColumn("tier", F.lit("A")), patterns=TERM, names=())


@query(f"WITH {DOCS}, {MENTIONS} SELECT doc_id, substr(md5('ent|' || name), 1, 12) AS entity_id, name, 'Term' AS type FROM ments")
def entity_extract(spark, sf_dir):
    return _entities(spark, sf_dir)


@query(f"WITH {DOCS}, {MENTIONS} SELECT name, count(*) AS docs FROM ments GROUP BY name")
def entity_dedup(spark, sf_dir):
    return _entities(spark, sf_dir).groupBy("name").agg(F.count(F.lit(1)).alias("docs"))


@query(f"WITH {DOCS}, {MENTIONS} SELECT a.name AS src, b.name AS dst, count(*) AS n FROM ments a JOIN ments b ON a.doc_id = b.doc_id AND a.rank < b.rank GROUP BY ALL")
def entity_cooccur(spark, sf_dir):
    r = I.relations(B.documents(spark, sf_dir).withColumn("tier", F.lit("A")), patterns=TERM, names=())
    return r.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"))


def _part_sheets(spark, sf_dir):
    """A short text about every part that names nodes, standards, tools and companies."""
    p = B.table(spark, sf_dir, "part")
    tools = F.get(F.array(F.lit("EUV"), F.lit("DUV"), F.lit("no tool")), (F.col("p_partkey") % 3).cast("int"))
    text = F.concat(
        F.lit("N"), "p_size", F.lit(" and N"), F.col("p_size") + 1, F.lit("P of TSMC, HBM"), F.col("p_size") % 4, F.lit(" by "), tools, F.lit("; xN7 JESD"),
        "p_partkey", F.lit(" 代工厂 N"), "p_size"
    )
    return p.select(F.col("p_partkey").cast("string").alias("id"), text.alias("text"), F.lit("A").alias("tier"))


_NAMED = "unnest(['N' || p_size, 'N' || (p_size + 1) || 'P', 'HBM' || p_size % 4, (['EUV', 'DUV', NULL])[p_partkey % 3 + 1], 'JESD' || p_partkey, '代工厂', 'TSMC']) AS name, unnest(['ProcessNode', 'ProcessNode', 'Standard', 'Equipment', 'Standard', 'Company', 'Company']) AS type"


@query(f"SELECT * FROM (SELECT p_partkey::VARCHAR AS doc_id, {_NAMED} FROM part) WHERE name IS NOT NULL")
def entity_patterns(spark, sf_dir):
    """What the engine's own patterns and names find in texts about parts."""
    return I.entities(_part_sheets(spark, sf_dir)).select("doc_id", "name", "type")


@query(
    rf"WITH {HTML}, b AS (SELECT substr(md5(id || '|' || section), 1, 12) AS page_id, id, body FROM kept), e AS (SELECT DISTINCT id, unnest(regexp_extract_all(body, '[A-Z][a-z]{{7,}}')) AS name FROM split WHERE body != '') SELECT page_id, count(*) AS n FROM b JOIN e USING (id) WHERE contains(body, name) GROUP BY page_id"
)
def page_entity_links(spark, sf_dir):
    """How many entities of its document the body of every web page's section names."""
    docs = B.web_pages(spark, sf_dir).withColumn("tier", F.lit("A"))
    links = I.page_entities(I.pages(docs).where("body != ''"), I.entities(docs, patterns=TERM, names=()))
    return links.groupBy("page_id").agg(F.count(F.lit(1)).alias("n"))


class Reader:
    """A model that works by rule, as one on this machine would: long capitalised words are objects, each linked to the next.

    It fails for texts of some lengths, and for some the first time it is asked, so that both are seen."""

    def __call__(self, prompt: str) -> str:
        body, said = re.fullmatch(r"(?s).*?<text>\n(.*)\n</text>(.*)", prompt).groups()
        if len(body) % 11 == 0:
            raise TimeoutError("no answer")
        if len(body) % 7 == 0 and "could not be read" not in said:
            return "Here is what I think."
        names = list(dict.fromkeys(re.findall("[A-Z][a-z]{7,}", body)))
        found = {"objects": [{"id": n, "type": "Term"} for n in names], "links": [{"lt": "next", "from": a, "to": b} for a, b in zip(names, names[1:])]}
        return "```json\n" + json.dumps(found) + "\n```"


@query(f"""WITH {DOCS}, {TIERED % 'docs'}, r AS (SELECT id, tier, controlled, {BODY} AS body FROM tiered WHERE tier != 'C'),
o AS (SELECT *, length(body) % 11 = 0 AS failed, len(list_distinct(regexp_extract_all(body, '[A-Z][a-z]{{7,}}'))) AS n FROM r)
SELECT id AS doc_id, CASE WHEN controlled THEN 'local' WHEN tier = 'A' THEN 'strong' ELSE 'light' END AS endpoint, CASE WHEN failed THEN 3 WHEN length(body) % 7 = 0 THEN 2 ELSE 1 END AS attempts, failed,
  CASE WHEN failed THEN 0 ELSE n END AS n_objects, CASE WHEN failed THEN 0 ELSE greatest(n - 1, 0) END AS n_links FROM o""")
def extract_documents(spark, sf_dir):
    """What models find in every section of documents of tiers A and B: by tier, with retries, controlled ones locally."""
    known = {n: X.Endpoint(n, url, Reader()) for n, url in (("strong", "https://models.example.com/v1"), ("light", "https://small.example.com/v1"), ("local", "http://localhost:8000/v1"))}
    found = X.extract(X.sections_to_ask(I.classify(B.documents(spark, sf_dir)), "strong", "light", "local"), known)
    return found.select("doc_id", "endpoint", "attempts", F.col("error").isNotNull().alias("failed"), F.size("objects").cast("long").alias("n_objects"), F.size("links").cast("long").alias("n_links"))


# --- sparse index -----------------------------------------------------------------------------


@query(f"WITH {DOCS}, {CHUNKS}, {POSTS} SELECT term, sum(tf)::BIGINT AS tf FROM post GROUP BY term")
def token_freq(spark, sf_dir):
    return R.postings(docs_and_chunks(spark, sf_dir)[1]).groupBy("term").agg(F.sum("tf").alias("tf"))


@query(f"WITH {DOCS}, {CHUNKS}, {POSTS} SELECT term, df FROM dfs")
def doc_freq(spark, sf_dir):
    return R.doc_freq(R.postings(docs_and_chunks(spark, sf_dir)[1]))


@query(f"WITH {DOCS}, {CHUNKS}, {POSTS} SELECT n, round(avg_len, 6) AS avg_len FROM stat")
def corpus_stats(spark, sf_dir):
    return R.corpus_stats(docs_and_chunks(spark, sf_dir)[1]).withColumn("avg_len", F.round("avg_len", 6))


@query(
    f"WITH {DOCS}, {CHUNKS}, {POSTS}, {QUESTIONS}, {TERMS}, {BM25} SELECT query_id, chunk_id, score FROM hits WHERE score > 0 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) <= 30"
)
def bm25_topk(spark, sf_dir):
    return R.bm25_stored(store(spark, sf_dir), questions(spark)).select("query_id", "chunk_id", "score")


@query(
    f"WITH {DOCS}, {CHUNKS}, {POSTS}, {QUESTIONS}, {TERMS}, {BM25} SELECT query_id, chunk_id, score FROM hits JOIN chunks c USING (chunk_id) WHERE score > 0 AND NOT c.controlled AND department IN ('src1', 'src3') QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) <= 30"
)
def bm25_filtered_topk(spark, sf_dir):
    where = R.metadata_filter({"controlled": False}) & F.col("department").isin("src1", "src3")
    return R.bm25_stored(store(spark, sf_dir), questions(spark), where=where).select("query_id", "chunk_id", "score")


# --- vectors ----------------------------------------------------------------------------------

UNIT = """unit AS (SELECT vec_id, label, list_transform(e, lambda x: x / CASE WHEN n = 0 THEN 1 ELSE n END) AS v FROM (SELECT *, sqrt(list_sum(list_transform(e, lambda x: x * x))) AS n FROM (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings)))"""
TOPK = "SELECT query_id, id, score FROM (SELECT q.vec_id AS query_id, u.vec_id AS id, round(list_dot_product(u.v, q.v) + 1e-9, 6) AS score FROM unit q JOIN unit u ON %s WHERE q.vec_id %% 50 = 0) QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) <= 10"


def _vectors(spark, sf_dir):
    e = B.table(spark, sf_dir, "embeddings")
    return e, e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"), F.col("label").alias("q_label"))


@query(f"WITH {UNIT} {TOPK % 'true'}")
def vector_topk_exact(spark, sf_dir):
    e, q = _vectors(spark, sf_dir)
    return R.vector_topk(e, q, 10).select("query_id", "id", "score")


@query(f"WITH {UNIT} {TOPK % 'u.label IN (1, 3)'}")
def vector_topk_filtered(spark, sf_dir):
    e, q = _vectors(spark, sf_dir)
    return R.vector_topk(e.where("label IN (1, 3)"), q, 10).select("query_id", "id", "score")


@query(f"WITH {UNIT} {TOPK % 'u.label = q.label'}")
def vector_topk_partition(spark, sf_dir):
    e, q = _vectors(spark, sf_dir)
    v = e.select(F.col("vec_id").alias("id"), F.col("label").alias("q_label"), vectors.normalised(vectors.doubles(F.col("embedding"))).alias("v"))
    scored = v.join(q, "q_label").select("query_id", "id", F.round(vectors.dot(F.col("v"), vectors.normalised(vectors.doubles(F.col("q")))) + 1e-9, 6).alias("score"))
    return R.ranked(scored, ["query_id"], [F.col("score").desc(), "id"], 10).select("query_id", "id", "score")


INT8 = """codes AS (SELECT vec_id, s AS scale, list_transform(e, lambda x: least(greatest(round_even(x / s, 0), -127), 127)::TINYINT) AS c FROM (SELECT vec_id, e, CASE WHEN m = 0 THEN 1e-9 ELSE m END / 127 AS s FROM (SELECT vec_id, e, coalesce(list_max(list_transform(e, lambda x: abs(x))), 0) AS m FROM (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings))))"""


@query(f"WITH {INT8} SELECT vec_id, round(scale, 9) AS scale, array_to_string(c, ',') AS codes FROM codes")
def vector_int8_codes(spark, sf_dir):
    v = vectors.doubles(F.col("embedding"))
    return B.table(spark, sf_dir, "embeddings").select(
        "vec_id", F.round(vectors.int8_scale(v), 9).alias("scale"),
        F.array_join(F.transform(vectors.int8_codes(v), lambda x: x.cast("string")), ",").alias("codes")
    )


@query(
    f"WITH {INT8}, embeddings2 AS (SELECT vec_id, list_transform(c, lambda x: x * scale) AS e FROM codes), unit AS (SELECT vec_id, list_transform(e, lambda x: x / n) AS v FROM (SELECT *, sqrt(list_sum(list_transform(e, lambda x: x * x))) AS n FROM embeddings2)) {TOPK % 'true'}"
)
def vector_int8_topk(spark, sf_dir):
    e, q = _vectors(spark, sf_dir)
    v = vectors.doubles(F.col("embedding"))
    coded = e.select("vec_id", F.size("embedding").alias("dim"), vectors.int8_decoded(vectors.int8_codes(v), vectors.int8_scale(v)).alias("embedding"))
    asked = coded.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "dim", F.col("embedding").alias("q"))
    return R.vector_topk(coded, asked, 10).select("query_id", "id", "score")


@query(
    "SELECT label AS shard, count(*) AS vectors, sum(len(embedding) + 4)::BIGINT AS int8_bytes, sum(4 * len(embedding))::BIGINT AS raw_bytes FROM embeddings WHERE embedding IS NOT NULL GROUP BY label"
)
def vector_store_stats(spark, sf_dir):
    e = B.table(spark, sf_dir, "embeddings").where("embedding IS NOT NULL")
    return e.groupBy(F.col("label").alias("shard")).agg(F.count(F.lit(1)).alias("vectors"), F.sum(F.size("embedding") + 4).alias("int8_bytes"), F.sum(4 * F.size("embedding")).alias("raw_bytes"))


@query(
    "SELECT vec_id, round(list_sum(list_transform(e[1:16], lambda x: x * x)) / 1, 6) AS share, round(e[1] / sqrt(list_sum(list_transform(e[1:16], lambda x: x * x))), 6) AS first FROM (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings)"
)
def vector_truncate_norm(spark, sf_dir):
    v = vectors.doubles(F.col("embedding"))
    t = F.slice(v, 1, 16)
    return B.table(spark, sf_dir, "embeddings").select("vec_id", F.round(vectors.dot(t, t), 6).alias("share"), F.round(F.element_at(vectors.truncated(v, 16), 1), 6).alias("first"))


@query()
def vector_ann_recall(spark, sf_dir):
    """Recall at 10 against exact search, of 8-bit vectors and of the inverted-file index, with the share of vectors that each scores."""
    e, q = _vectors(spark, sf_dir)
    path = f"{shared_folder(spark)}/vectors-{uuid.uuid4().hex}"
    write_vectors(e.select(F.col("vec_id").alias("id"), F.col("label").cast("string").alias("department"), F.col("embedding").alias("v")), path)
    index = open_vectors(spark, path)
    exact = checkpoint(R.vector_topk(e, q, 10).select("query_id", "id"))
    # vectors without any order need many lists; clustered ones few
    found, seen = search_vectors(index, q.select("query_id", "q"), 10, probes=-(-2 * index.centroids.count() // 3))
    coded = vector_int8_topk(spark, sf_dir)
    sizes = exact.agg(F.count(F.lit(1)).alias("wanted"), F.countDistinct("query_id").alias("queries")).crossJoin(index.vectors.agg(F.count(F.lit(1)).alias("n")))
    hits = lambda rows, method: exact.join(rows.select("query_id", "id"), ["query_id", "id"]).agg(F.lit(method).alias("method"), F.count(F.lit(1)).alias("hits"))
    share = seen.agg(F.sum("seen").alias("seen")).crossJoin(sizes).select(F.lit("index").alias("method"), (F.col("seen") / F.col("queries") / F.col("n")).alias("share"))
    both = hits(found, "index").unionByName(hits(coded, "int8")).crossJoin(sizes).join(share, "method", "left")
    return both.select("method", "hits", "wanted", (F.col("hits") / F.col("wanted")).alias("recall"), F.coalesce("share", F.lit(1.0)).alias("share"))


@query(f"WITH src AS (SELECT item_id AS id, text FROM benchmark), {FEATURES} SELECT id, bucket, round(value / norm, 6) AS value FROM feats JOIN norms USING (id)")
def hash_embed_buckets(spark, sf_dir):
    return vectors.hashed_features(B.table(spark, sf_dir, "benchmark"), "item_id", "text").select("id", "bucket", F.round(F.col("value") / F.col("norm"), 6).alias("value"))


#: Cosines of the given vectors seldom reach what the engine takes for likeness.
LIKE = 0.25


@query(
    f"SELECT a.vec_id, count(*) AS near FROM (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings) a JOIN (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings) b ON a.label = b.label AND a.vec_id < b.vec_id AND list_cosine_similarity(a.e, b.e) > {LIKE} GROUP BY a.vec_id"
)
def entity_type_neighbours(spark, sf_dir):
    """How many later vectors of its label each vector is like."""
    e = B.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").alias("type"), F.col("embedding").alias("v"))
    return V.neighbour_counts(e, LIKE).withColumnRenamed("id", "vec_id")


# --- the read path ----------------------------------------------------------------------------

_G = " + ".join(f"contains(lower(query), '{w}')::INT" for w in vocab.GLOBAL_SIGNALS)
_L = " + ".join(f"contains(lower(query), '{w}')::INT" for w in vocab.LOCAL_SIGNALS)
ROUTED = f"routed AS (SELECT *, CASE WHEN ({_G}) > ({_L}) AND NOT regexp_matches(query, '\\bN[0-9]+|\\bHBM|\\bEUV|JESD[0-9]+') THEN 'global' ELSE 'local' END AS mode FROM questions)"


_ASKS = ("what is ", "overall trend of ", "main themes across EUV and ", "how much, in general, was ", "summary and landscape: ", "")
_ASKED_OF = "questions AS (SELECT conv_id, turn, ([" + quoted(_ASKS) + f"])[(conv_id + turn) % {len(_ASKS)} + 1] || text AS query FROM conversations WHERE role = 'user')"


@query(f"WITH {_ASKED_OF}, {ROUTED} SELECT conv_id, turn, mode FROM routed")
def route_queries(spark, sf_dir):
    """The modes of what users say in conversations, each put as one of several kinds of question."""
    said = B.table(spark, sf_dir, "conversations").where("role = 'user'")
    put = F.get(F.array(*map(F.lit, _ASKS)), ((F.col("conv_id") + F.col("turn")) % len(_ASKS)).cast("int"))
    return R.route(said.select("conv_id", "turn", F.concat(put, "text").alias("query"))).select("conv_id", "turn", "mode")


DENSE = """qsrc AS (SELECT query_id, query AS text FROM questions),
qf AS (SELECT query_id, ('0x' || right(h, 2))::INT AS bucket, n * CASE WHEN ('0x' || substr(h, 30, 1))::INT %% 2 = 1 THEN 1 ELSE -1 END AS v FROM (SELECT query_id, md5(f) AS h, count(*)::DOUBLE AS n FROM (SELECT query_id, unnest(%s) AS f FROM qsrc) GROUP BY ALL)
       UNION ALL SELECT query_id, ('0x' || right(h, 2))::INT, n * 0.5 FROM (SELECT query_id, md5(f) AS h, count(*)::DOUBLE AS n FROM (SELECT query_id, substr(text, i, 3) AS f FROM (SELECT query_id, text, unnest(generate_series(1, length(text) - 2)) AS i FROM qsrc)) GROUP BY ALL)),
qv AS (SELECT query_id, bucket, sum(v) AS q FROM qf GROUP BY ALL HAVING sum(v) != 0), qn AS (SELECT query_id, sqrt(sum(q * q)) AS q_norm FROM qv GROUP BY query_id),
dense AS (SELECT query_id, f.id AS chunk_id, round(sum(f.value * q) / max(norm) / max(q_norm) + 1e-9, 6) AS score FROM feats f JOIN norms USING (id) JOIN qv USING (bucket) JOIN qn USING (query_id) GROUP BY ALL)""" % (TOKENS % "text")
FUSED = """dense_seen AS (SELECT d.* FROM dense d JOIN chunks c USING (chunk_id) JOIN questions q USING (query_id) WHERE NOT c.controlled OR q.role != 'viewer'),
lists AS (SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) - 1 AS rank FROM dense_seen
          UNION ALL SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) - 1 FROM seen),
fused AS (SELECT query_id, chunk_id, round(sum(1.0 / (60 + rank)) + 1e-12, 9) AS rrf FROM lists WHERE rank < 30 GROUP BY query_id, chunk_id QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(sum(1.0 / (60 + rank)) + 1e-12, 9) DESC, chunk_id) <= 30)"""
READ = f"{DOCS}, {CHUNKS}, {POSTS}, {QUESTIONS}, {TERMS}, {BM25}, {SEEN}, src AS (SELECT chunk_id AS id, text FROM chunks), {FEATURES}, {DENSE}, {FUSED}"


def _fused(spark, sf_dir):
    held, q = store(spark, sf_dir), questions(spark)
    return R.rrf(R.dense_stored(held, q, secure=True), R.bm25_stored(held, q, secure=True)), held.chunks, q


@query(f"WITH {READ} SELECT query_id, chunk_id, rrf FROM fused")
def rrf_fuse(spark, sf_dir):
    return _fused(spark, sf_dir)[0].select("query_id", "chunk_id", "rrf")


PARTS = f"""cand AS (SELECT f.query_id, q.query, q.role, c.*, {TOKENS % 'q.query'} AS qt, {TOKENS % 'c.text'} AS ct FROM fused f JOIN questions q USING (query_id) JOIN chunks c USING (chunk_id)),
parts AS (SELECT *, len(list_filter(qt, lambda w: list_contains(ct, w))) AS covered, len(qt) AS terms, list_filter(qt, lambda w: regexp_matches(w, '^[a-z]?\\d') OR length(w) <= 2) AS rl,
  list_filter(range(1, len(ct) + 1), lambda i: list_contains(qt, ct[i])) AS hitl FROM cand),
scored AS (SELECT *, len(rl) AS rare, len(list_filter(rl, lambda w: list_contains(ct, w))) AS rare_hits, len(hitl) AS hits, CASE WHEN len(hitl) >= 2 THEN hitl[-1] - hitl[1] + 1 ELSE 0 END AS span FROM parts),
reranked AS (SELECT *, round(CASE WHEN terms = 0 OR len(ct) = 0 THEN 0 ELSE 0.6 * covered / terms + 0.25 * rare_hits / greatest(rare, 1) + 0.15 * CASE WHEN hits >= 2 AND span > 0 THEN hits / span ELSE 0 END END + 1e-9, 6) AS score FROM scored),
top8 AS (SELECT *, 1 / (1 + exp(-6 * (score - 0.4))) AS confidence, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) - 1 AS rank FROM reranked QUALIFY rank < 8)"""


def _reranked(spark, sf_dir):
    fused, c, q = _fused(spark, sf_dir)
    return R.rerank(R.candidates(fused, q, c, R.few(q)))


@query(f"WITH {READ}, {PARTS} SELECT query_id, chunk_id, score, round(confidence, 6) AS confidence, covered, rare_hits, hits, span FROM top8")
def rerank_score(spark, sf_dir):
    r = _reranked(spark, sf_dir)
    return r.select("query_id", "chunk_id", "score", F.round("confidence", 6).alias("confidence"), *[F.col(f"parts.{c}").cast("long").alias(c) for c in ("covered", "rare_hits", "hits", "span")])


@query(f"WITH {READ}, {PARTS} SELECT query_id, count(*) FILTER (confidence >= 0.5) AS kept, count(*) FILTER (confidence < 0.5) AS dropped FROM top8 GROUP BY query_id")
def confidence_gate(spark, sf_dir):
    r = checkpoint(_reranked(spark, sf_dir).select("query_id", "score"))
    kept = R.gate(r).groupBy("query_id").agg(F.count(F.lit(1)).alias("kept"))
    return r.groupBy("query_id").agg(F.count(F.lit(1)).alias("n")).join(kept, "query_id", "left").select(
        "query_id", F.coalesce("kept", F.lit(0)).alias("kept"), (F.col("n") - F.coalesce("kept", F.lit(0))).alias("dropped")
    )


@query(f"WITH {QUESTIONS}, q AS (SELECT query_id, {TOKENS % 'query'} AS qt FROM questions), b AS (SELECT item_id, text FROM benchmark), "
       f"s AS (SELECT query_id, qt, item_id, text, unnest(l) AS raw, generate_subscripts(l, 1) AS i FROM (SELECT *, regexp_extract_all(text, '[^。.!?！？\\n]*[。.!?！？\\n]|[^。.!?！？\\n]+$') AS l FROM q CROSS JOIN b)), "
       f"o AS (SELECT *, regexp_replace(raw, '^\\s+|\\s+$', '', 'g') AS st FROM s WHERE trim(raw, E' \\n\\t\\r') != ''), "
       f"r AS (SELECT *, len(list_intersect(list_distinct(qt), list_distinct({TOKENS % 'st'}))) AS ov FROM o), "
       f"t AS (SELECT *, row_number() OVER (PARTITION BY query_id, item_id ORDER BY ov DESC, i) AS rn FROM r), "
       f"c AS (SELECT query_id, item_id, string_agg(st, ' ' ORDER BY rn) FILTER (ov > 0 AND rn <= 3) AS text FROM t GROUP BY ALL) "
       f"SELECT q.query_id, b.item_id, coalesce(c.text, substr(b.text, 1, 200)) AS text FROM q CROSS JOIN b LEFT JOIN c USING (query_id, item_id)")
def compress_sentences(spark, sf_dir):
    both = B.table(spark, sf_dir, "benchmark").crossJoin(F.broadcast(questions(spark)))
    return both.select("query_id", "item_id", T.compress(F.col("text"), F.col("query")).alias("text"))


PARENTS = """kept8 AS (SELECT *, row_number() OVER (PARTITION BY query_id, parent_id ORDER BY rank) AS turn FROM top8 WHERE confidence >= 0.5),
paged AS (SELECT k.*, b.body, t.tier FROM kept8 k JOIN bodies b ON b.id = k.doc_id JOIN tiered t ON t.id = k.doc_id),
ctx AS (SELECT *, turn = 1 AND tier != 'C' AS page FROM paged)"""


@query(f"WITH {READ}, {PARTS}, {TIERED % 'docs'}, {PARENTS} SELECT query_id, rank::INT AS rank, doc_id, page FROM ctx")
def parent_restore(spark, sf_dir):
    kept = R.gate(_reranked(spark, sf_dir))
    pages = store(spark, sf_dir).pages.select(F.col("page_id").alias("parent_id"), F.lit(True).alias("has"))
    from pyspark.sql import Window

    turn = F.row_number().over(Window.partitionBy("query_id", "parent_id").orderBy("rank"))
    return kept.withColumn("turn", turn).join(pages, "parent_id", "left").select("query_id", "rank", "doc_id", ((F.col("turn") == 1) & F.coalesce("has", F.lit(False))).alias("page"))


ANSWERS = f"""cs AS (SELECT c.query_id, c.rank, c.role, c.controlled, c.qt, CASE WHEN page THEN body ELSE text END AS source FROM ctx c),
sen AS (SELECT *, unnest(l) AS raw, generate_subscripts(l, 1) AS i FROM (SELECT *, regexp_extract_all(source, '[^。.!?！？\\n]*[。.!?！？\\n]|[^。.!?！？\\n]+$') AS l FROM cs)),
ove AS (SELECT *, len(list_intersect(list_distinct(qt), list_distinct({TOKENS % 'st'}))) AS ov FROM (SELECT *, regexp_replace(raw, '^\\s+|\\s+$', '', 'g') AS st FROM sen) WHERE st != ''),
sel AS (SELECT query_id, rank, string_agg(st, ' ' ORDER BY rn) FILTER (ov > 0 AND rn <= 3) AS picked FROM (SELECT *, row_number() OVER (PARTITION BY query_id, rank ORDER BY ov DESC, i) AS rn FROM ove) GROUP BY ALL),
con AS (SELECT c.query_id, c.rank, c.role, c.controlled, coalesce(s.picked, substr(c.source, 1, 200)) AS text FROM cs c LEFT JOIN sel s USING (query_id, rank)),
shown AS (SELECT query_id, rank, CASE WHEN NOT controlled OR role = 'compliance' THEN text WHEN role = 'strategy' THEN '{vocab.SUMMARY_PREFIX}' || substr(text, 1, 8) || '{vocab.ELLIPSIS}' WHEN role = 'analyst' THEN '{vocab.MASKED}' END AS text, controlled AND role != 'compliance' AS masked FROM con),
told AS (SELECT query_id, count(*) AS n, count(*) FILTER (masked) AS m, string_agg(substr(text, 1, 60), '{vocab.ANSWER_JOIN}' ORDER BY rank) FILTER (k <= 3) AS bits FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS k FROM shown WHERE text IS NOT NULL) GROUP BY query_id)"""


@query(
    f"WITH {READ}, {PARTS}, {TIERED % 'docs'}, {PARENTS}, {ANSWERS}, {ROUTED} SELECT r.query_id, r.mode, coalesce(t.n, 0) AS n_contexts, coalesce(t.m, 0) AS n_masked, coalesce(t.n, 0) > 0 AS grounded, CASE WHEN t.n > 0 THEN '{vocab.ANSWER_PREFIX}' || t.bits ELSE '{vocab.NO_CONTENT}' END AS answer FROM routed r LEFT JOIN told t USING (query_id)"
)
def ask_flagship(spark, sf_dir):
    held = store(spark, sf_dir)
    return R.ask(questions(spark), held.chunks, held.pages, store=held)


IN_DEPARTMENT = [ASKED[0] + ("src1",), ASKED[1] + ("src3",), ASKED[2] + (None,), ASKED[3] + ("src99",)]
_VISIBLE = "(NOT c.controlled OR q.role != 'viewer') AND (q.department IS NULL OR c.department = q.department)"
_QUESTIONS_IN = "questions(query_id, query, role, department) AS (VALUES " + ", ".join(f"({i}, '{q}', '{r}', {quoted([d]) if d else 'NULL'})" for i, q, r, d in IN_DEPARTMENT) + ")"


@query(
    ORACLE_SQL["ask_flagship"]
    .replace(QUESTIONS, _QUESTIONS_IN)
    .replace("score > 0 AND (NOT c.controlled OR q.role != 'viewer')", f"score > 0 AND {_VISIBLE}")
    .replace("WHERE NOT c.controlled OR q.role != 'viewer')", f"WHERE {_VISIBLE})")
)
def ask_department(spark, sf_dir):
    """The read path for questions of which each may only look into one department."""
    held = store(spark, sf_dir)
    asked = spark.createDataFrame(IN_DEPARTMENT, "query_id int, query string, role string, department string")
    return R.ask(asked, held.chunks, held.pages, store=held)


# --- graph ------------------------------------------------------------------------------------

LINES = """ln AS (SELECT DISTINCT doc_id, line FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents) WHERE length(line) >= 40),
hub AS (SELECT line, min(doc_id) AS dst, count(*) AS n FROM ln GROUP BY line HAVING count(*) > 1),
edges AS (SELECT DISTINCT ln.doc_id AS src, hub.dst FROM ln JOIN hub USING (line) WHERE ln.doc_id != hub.dst)"""
REACH = f"""{LINES}, pair2 AS (SELECT src, dst FROM edges UNION SELECT dst, src FROM edges),
reach(node, goal) AS (SELECT src, src FROM pair2 UNION SELECT r.node, b.dst FROM reach r JOIN pair2 b ON b.src = r.goal),
comm AS (SELECT node, min(goal) AS community FROM reach GROUP BY node)"""


def _shared_lines(spark, sf_dir):
    """Documents linked to the first document with the same line of 40 or more characters.

    Lines are told apart by the 128 bits of their MD5, so that no text is shuffled; of a document
    each line is taken once within its row."""
    long = F.array_distinct(F.filter(F.split("text", "\n", -1), lambda s: F.length(s) >= 40))
    line = B.table(spark, sf_dir, "documents").select("doc_id", F.explode(long).alias("s")).select("doc_id", F.unhex(F.md5("s")).alias("line"))
    hub = line.groupBy("line").agg(F.min("doc_id").alias("dst"), F.max("doc_id").alias("last")).where("dst != last").drop("last")
    return line.join(hub, "line").where("doc_id != dst").select(F.col("doc_id").alias("src"), "dst").distinct()


def _communities(spark, sf_dir):
    e = _shared_lines(spark, sf_dir)
    return K.communities(e.select(F.col("src").alias("node")), e)


@query(f"WITH RECURSIVE {REACH} SELECT node, community FROM comm")
def graph_components(spark, sf_dir):
    return _communities(spark, sf_dir)


@query(
    f"WITH {LINES}, pair2 AS (SELECT src, dst FROM edges UNION SELECT dst, src FROM edges), s AS (SELECT min(dst) AS node FROM edges), h1 AS (SELECT dst AS node FROM pair2 JOIN s ON src = node), h2 AS (SELECT dst AS node FROM pair2 JOIN h1 ON src = node) SELECT node FROM (SELECT node FROM h1 UNION SELECT node FROM h2) WHERE node NOT IN (SELECT node FROM s)"
)
def graph_khop(spark, sf_dir):
    e = _shared_lines(spark, sf_dir)
    return K.khop(e, e.agg(F.min("dst").alias("node")), 2)


@query(f"WITH RECURSIVE {REACH} SELECT node, community FROM comm")
def communities_incremental(spark, sf_dir):
    """Communities of documents whose links arrive in three batches, each of which relabels only what it touches."""
    edges = _shared_lines(spark, sf_dir).select(F.col("src").alias("a"), F.col("dst").alias("b"))
    labels = spark.createDataFrame([], "node long, component long")
    for part in range(3):
        labels, _ = merge_components(labels, edges.where(f"a % 3 = {part}"))
    return labels.select("node", F.col("component").alias("community"))


SUMMED = f"""{REACH}, summ AS (SELECT community, count(*) AS members, string_agg(DISTINCT lang, ',' ORDER BY lang) AS types, list_sort(list(node))[1:8] AS f FROM comm JOIN documents ON doc_id = node GROUP BY community),
told AS (SELECT community, members, types, '社区' || community || '：' || members || ' 实体，类型 ' || types || '。成员：' || array_to_string(f, ', ') AS summary FROM summ)"""


def _summaries(spark, sf_dir, labels=None):
    return K.community_summaries(_communities(spark, sf_dir) if labels is None else labels, B.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("node"), F.col("lang").alias("type")))


@query(f"WITH RECURSIVE {SUMMED} SELECT * FROM told")
def community_summary(spark, sf_dir):
    return _summaries(spark, sf_dir)


@query(f"""WITH RECURSIVE {SUMMED}, {QUESTIONS}, cand AS (SELECT query_id, query, community, {TOKENS % 'query'} AS qt, {TOKENS % 'summary'} AS ct FROM told CROSS JOIN questions),
pt AS (SELECT *, len(list_filter(qt, lambda w: list_contains(ct, w))) AS covered, list_filter(qt, lambda w: regexp_matches(w, '^[a-z]?\\d') OR length(w) <= 2) AS rl, list_filter(range(1, len(ct) + 1), lambda i: list_contains(qt, ct[i])) AS hl FROM cand),
sc AS (SELECT query_id, community, round(0.6 * covered / len(qt) + 0.25 * len(list_filter(rl, lambda w: list_contains(ct, w))) / greatest(len(rl), 1) + 0.15 * CASE WHEN len(hl) >= 2 THEN len(hl) / (hl[-1] - hl[1] + 1) ELSE 0 END + 1e-9, 6) AS score FROM pt)
SELECT query_id, community, round_even(least(1.0, score), 3) AS confidence FROM sc QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, community) <= 5""")
def global_top_communities(spark, sf_dir):
    return K.top_communities(questions(spark), _summaries(spark, sf_dir)).select("query_id", "community", "confidence")


GLOBAL = f"""gtext AS (SELECT community, summary, summary || ' ' || (SELECT string_agg(node::VARCHAR, ' ' ORDER BY node) FROM comm c WHERE c.community = csum.community) AS text FROM csum),
gcand AS (SELECT query_id, community, summary, {TOKENS % 'query'} AS qt, {TOKENS % 'text'} AS ct FROM gtext CROSS JOIN routed WHERE mode = 'global'),
gpt AS (SELECT *, len(list_filter(qt, lambda w: list_contains(ct, w))) AS covered, list_filter(qt, lambda w: regexp_matches(w, '^[a-z]?\\d') OR length(w) <= 2) AS rl, list_filter(range(1, len(ct) + 1), lambda i: list_contains(qt, ct[i])) AS hl FROM gcand),
gsc AS (SELECT query_id, community, summary, round(0.6 * covered / len(qt) + 0.25 * len(list_filter(rl, lambda w: list_contains(ct, w))) / greatest(len(rl), 1) + 0.15 * CASE WHEN len(hl) >= 2 THEN len(hl) / (hl[-1] - hl[1] + 1) ELSE 0 END + 1e-9, 6) AS score FROM gpt),
gtop AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, community) - 1 AS rank FROM gsc QUALIFY rank < 5)"""
_SUMMED = SUMMED.replace("told AS", "csum AS")


def global_contexts(spark, sf_dir):
    """The communities of documents that share lines, as contexts for global questions."""
    labels = checkpoint(_communities(spark, sf_dir))
    summaries = checkpoint(_summaries(spark, sf_dir, labels))
    postings = checkpoint(K.community_postings(labels, summaries))
    return lambda asked: K.global_communities(asked, postings, summaries)


@query(f"WITH RECURSIVE {_SUMMED}, {QUESTIONS}, {ROUTED}, {GLOBAL} SELECT query_id, community, round_even(least(1.0, score), 3) AS confidence, rank::INT AS rank FROM gtop")
def global_contexts_topk(spark, sf_dir):
    """The communities that answer each global question, by postings of summaries and members."""
    asked = R.route(questions(spark)).where("mode = 'global'")
    return global_contexts(spark, sf_dir)(asked).select("query_id", "community", "confidence", "rank")


@query(
    f"WITH RECURSIVE {_SUMMED}, {READ}, {PARTS}, {TIERED % 'docs'}, {PARENTS}, {ANSWERS}, {ROUTED}, {GLOBAL}, "
    f"gtold AS (SELECT query_id, count(*) AS n, 0 AS m, string_agg(substr(summary, 1, 60), '{vocab.ANSWER_JOIN}' ORDER BY rank) FILTER (rank < 3) AS bits FROM gtop GROUP BY query_id), "
    f"both_told AS (SELECT t.* FROM told t JOIN routed USING (query_id) WHERE mode = 'local' UNION ALL SELECT * FROM gtold) "
    f"SELECT r.query_id, r.mode, coalesce(t.n, 0) AS n_contexts, coalesce(t.m, 0) AS n_masked, coalesce(t.n, 0) > 0 AS grounded, CASE WHEN t.n > 0 THEN '{vocab.ANSWER_PREFIX}' || t.bits ELSE '{vocab.NO_CONTENT}' END AS answer FROM routed r LEFT JOIN both_told t USING (query_id)"
)
def ask_global(spark, sf_dir):
    """The read path with both modes: local questions from the index, global ones from community summaries."""
    held = store(spark, sf_dir)
    asked = questions(spark)
    return R.ask(asked, held.chunks, held.pages, store=held, global_contexts=lambda routed: global_contexts(spark, sf_dir)(routed).select("query_id", "rank", F.col("summary").alias("text")))


# --- resolution -------------------------------------------------------------------------------


@query(
    f"WITH {DOCS}, {MENTIONS}, k AS (SELECT lower(name) AS key, name, doc_id::BIGINT AS seq FROM ments), f AS (SELECT key, arg_min(substr(md5('ent|' || name), 1, 12), {{'s': seq, 'n': name}}) AS canonical_id, count(DISTINCT name) AS names FROM k GROUP BY key) SELECT key, canonical_id, names FROM f"
)
def entity_resolve_alias(spark, sf_dir):
    e = _entities(spark, sf_dir).select("entity_id", "name", F.struct(F.col("doc_id").cast("long"), "name").alias("seq"))
    r = K.resolve_aliases(e).distinct().join(e.select("entity_id", F.lower("name").alias("key"), "name").distinct(), "entity_id")
    return r.groupBy("key", "canonical_id").agg(F.countDistinct("name").alias("names"))


@query(f"""WITH RECURSIVE pairs AS (SELECT a.vec_id AS id, b.vec_id AS other, list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS c FROM embeddings a JOIN embeddings b ON a.label = b.label AND b.vec_id < a.vec_id WHERE c > {LIKE}),
near AS (SELECT row_number() OVER (ORDER BY vec_id) AS k, vec_id, coalesce((SELECT list(other) FROM pairs WHERE id = vec_id), []) AS others FROM embeddings),
walk(k, chosen) AS (SELECT 0::BIGINT, []::BIGINT[] UNION ALL SELECT n.k, CASE WHEN list_has_any(n.others, w.chosen) THEN w.chosen ELSE list_append(w.chosen, n.vec_id) END FROM walk w JOIN near n ON n.k = w.k + 1),
chosen AS (SELECT unnest(chosen) AS id FROM walk WHERE k = (SELECT count(*) FROM near))
SELECT vec_id AS entity_id, CASE WHEN vec_id IN (SELECT id FROM chosen) THEN vec_id ELSE (SELECT arg_max(other, {{'c': c, 'o': -other}}) FROM pairs WHERE pairs.id = vec_id AND other IN (SELECT id FROM chosen)) END AS canonical_id FROM embeddings""")
def entity_resolve_vector(spark, sf_dir):
    """Vectors resolved in order within their label."""
    e = B.table(spark, sf_dir, "embeddings")
    return V.resolve_vectors(e.select(F.col("vec_id").alias("entity_id"), F.col("vec_id").alias("seq"), F.col("label").alias("type"), F.col("embedding").alias("v")), LIKE)


# --- bitemporal -------------------------------------------------------------------------------

OBS = "obs AS (SELECT user_id AS obj_id, strftime(ts, '%Y-%m-%d') AS valid_time, event_id AS seq, value FROM events)"


@query(f"WITH {OBS} SELECT obj_id, valid_time, seq, lead(seq) OVER (PARTITION BY obj_id, valid_time ORDER BY seq) AS superseded_by FROM obs")
def obs_supersede_chain(spark, sf_dir):
    return K.superseded(B.observations(spark, sf_dir)).select("obj_id", "valid_time", "seq", "superseded_by")


@query(f"WITH {OBS} SELECT obj_id, valid_time, seq, value FROM obs WHERE substr(valid_time, 1, 4)::INT <= 2024 QUALIFY row_number() OVER (PARTITION BY obj_id ORDER BY valid_time DESC, seq DESC) = 1")
def obs_asof(spark, sf_dir):
    return K.as_of(B.observations(spark, sf_dir), 2024)


@query(
    "SELECT o_custkey AS obj_id, strftime(o_orderdate, '%Y-%m-%d') AS valid_time, o_orderkey AS seq, o_totalprice AS value FROM orders WHERE year(o_orderdate) <= 1995 QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY strftime(o_orderdate, '%Y-%m-%d') DESC, o_orderkey DESC) = 1"
)
def obs_asof_year(spark, sf_dir):
    """What was known of each customer's orders at the end of a year that most of them are after."""
    o = B.table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("obj_id"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("valid_time"), F.col("o_orderkey").alias("seq"),
        F.col("o_totalprice").alias("value")
    )
    return K.as_of(o, 1995)


@query(
    f"WITH {OBS}, open AS (SELECT *, lead(seq) OVER (PARTITION BY obj_id, valid_time ORDER BY seq) AS nxt FROM obs) SELECT obj_id, valid_time, seq, value FROM open WHERE nxt IS NULL QUALIFY row_number() OVER (PARTITION BY obj_id ORDER BY valid_time DESC, seq DESC) = 1"
)
def obs_truth(spark, sf_dir):
    return K.truth(B.observations(spark, sf_dir))


@query(
    f"WITH {OBS}, moments AS (SELECT DISTINCT obj_id, unnest(['2024-01-10', '2024-01-20']) AS \"at\" FROM obs) SELECT m.obj_id, m.\"at\", max(o.valid_time) AS valid_time, arg_max(o.value, {{'v': o.valid_time, 's': o.seq}}) AS value FROM moments m LEFT JOIN obs o ON o.obj_id = m.obj_id AND o.valid_time <= m.\"at\" GROUP BY ALL"
)
def obs_asof_join(spark, sf_dir):
    o = B.observations(spark, sf_dir)
    times = o.select("obj_id").distinct().withColumn("at", F.explode(F.array(F.lit("2024-01-10"), F.lit("2024-01-20"))))
    return K.as_of_at(o, times)


@query("SELECT o_custkey AS node, o_orderstatus AS status, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1")
def status_latest(spark, sf_dir):
    return K.status_latest(B.status_events(spark, sf_dir)).select("node", "status", F.col("seq.o_orderkey").alias("o_orderkey"))


@query(
    "WITH h AS (SELECT *, lag(o_orderstatus) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS b FROM orders) SELECT o_custkey AS node, o_orderkey, b AS before, o_orderstatus AS status FROM h WHERE b IS NOT NULL AND NOT ((b = 'O' AND o_orderstatus = 'F') OR (b = 'F' AND o_orderstatus = 'P'))"
)
def fsm_violations(spark, sf_dir):
    return K.fsm_violations(B.status_events(spark, sf_dir), {"O": "F", "F": "P"}).select("node", "o_orderkey", "before", "status")


# --- actions and stores -----------------------------------------------------------------------

_ALLOWED = " OR ".join(f"(action = '{a}' AND role IN ({quoted(r)}))" for a, (r, _) in vocab.ACTIONS.items())
_SANDBOX = quoted(a for a, (_, s) in vocab.ACTIONS.items() if s)
ACTS = f"""acts AS (SELECT event_id AS seq, CASE event_type WHEN 'click' THEN 'review' WHEN 'view' THEN 'create_link' WHEN 'purchase' THEN 'revise-capacity' WHEN 'signup' THEN 'mark' ELSE 'drop-all' END AS action,
  (['viewer', 'analyst', 'strategy', 'compliance'])[user_id % 4 + 1] AS role, event_id % 2 = 0 AS confirmed, CASE WHEN event_id % 5 = 0 THEN 'rumor' ELSE 'official' END AS source_tier FROM events),
decided AS (SELECT *, CASE WHEN action NOT IN ({quoted(vocab.ACTIONS)}) THEN 'unknown_action' WHEN NOT ({_ALLOWED}) THEN 'permission_denied' WHEN action = 'revise-capacity' AND source_tier = 'rumor' THEN 'rumor_rejected'
  WHEN action IN ({_SANDBOX}) AND NOT confirmed THEN 'pending_review' ELSE 'executed' END AS decision FROM acts)"""


@query(f"WITH {ACTS} SELECT seq, decision FROM decided")
def action_decisions(spark, sf_dir):
    return K.decide(B.actions(spark, sf_dir)).select("seq", "decision")


@query(f"WITH {ACTS} SELECT action, role, count(*) AS n FROM decided WHERE decision = 'executed' GROUP BY ALL")
def action_audit_counts(spark, sf_dir):
    return K.audit(K.decide(B.actions(spark, sf_dir))).groupBy("action", "role").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {ACTS}, done AS (SELECT d.*, e.user_id::VARCHAR AS id, e.value FROM decided d JOIN events e ON e.event_id = d.seq WHERE decision = 'executed')
SELECT id, bool_or(action = 'mark') AS controlled, round(least(1.0, 0.78 + 0.03 * count(*) FILTER (action = 'review')), 9)::DOUBLE AS confidence,
  arg_max(value, seq) FILTER (action = 'revise-capacity') AS capacity, count(*) FILTER (action = 'create_link') AS links FROM done GROUP BY id""")
def action_apply(spark, sf_dir):
    """What the executed actions of the log make of the objects they name."""
    return K.applied(K.decide(B.actions(spark, sf_dir))).withColumn("confidence", F.round("confidence", 9))


_STATES = "['development', 'risk', 'HVM', 'EOL']"
_NEXT = "CASE cur " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in vocab.NEXT_STATUS.items()) + " END"
ORDERED = f"""oacts AS (SELECT o_orderkey AS seq, (['create_object', 'advance-roadmap', 'correct', 'merge', 'promote'])[o_orderpriority[1]::INT] AS action, (['viewer', 'analyst', 'strategy', 'compliance'])[o_custkey % 4 + 1] AS role,
  o_orderkey % 2 = 0 AS confirmed, ({_STATES})[o_orderkey % 4 + 1] AS cur, ({_STATES})[o_orderkey // 4 % 4 + 1] AS nxt, o_custkey % 7 = 0 AS correction, (o_custkey % 500)::VARCHAR AS id FROM orders),
odone AS (SELECT * FROM oacts WHERE ({_ALLOWED}) AND NOT (action = 'advance-roadmap' AND NOT correction AND {_NEXT} IS DISTINCT FROM nxt) AND NOT (action IN ({_SANDBOX}) AND NOT confirmed)),
oresult AS (SELECT seq, action, CASE action WHEN 'create_object' THEN CASE WHEN row_number() OVER (PARTITION BY action, id ORDER BY seq) = 1 THEN 'created ' ELSE 'merged ' END || id WHEN 'advance-roadmap' THEN 'advanced ' || id || ' to ' || nxt ELSE 'noop ' || action END AS result FROM odone)"""


@query(f"""WITH {ORDERED}, {ACTS}, done AS (SELECT d.*, e.user_id::VARCHAR AS id FROM decided d JOIN events e ON e.event_id = d.seq WHERE decision = 'executed')
SELECT 'orders' AS log, seq, action, result FROM oresult
UNION ALL SELECT 'events', seq, action, CASE action WHEN 'review' THEN 'reviewed ' || id WHEN 'mark' THEN 'marked ' || id WHEN 'revise-capacity' THEN 'revised ' || id WHEN 'create_link' THEN 'linked ' || id || '->' || id END FROM done""")
def action_results(spark, sf_dir):
    """What every executed action of two logs, which name all nine actions, comes to."""
    events = B.actions(spark, sf_dir).withColumn(
        "params",
        F.map_concat("params", F.create_map(F.lit("src"), F.try_element_at("params", F.lit("id")), F.lit("dst"), F.try_element_at("params", F.lit("id"))))
    )
    logs = {"orders": B.order_actions(spark, sf_dir), "events": events}
    one, two = (G.results(K.decide(log)).select(F.lit(name).alias("log"), "seq", "action", "result") for name, log in logs.items())
    return one.unionByName(two)


@query(
    f"""WITH {ORDERED} SELECT seq, action, sha256('{{"aliases":"' || o_orderpriority || '","id":"' || id || '","objectType":"' || o_orderstatus || '","title":"object ' || seq || '"}}') AS params_hash FROM odone JOIN orders ON o_orderkey = seq"""
)
def action_audit_hashes(spark, sf_dir):
    """The audit's hash of the parameters of every executed action, whatever their order."""
    return K.audit(K.decide(B.order_actions(spark, sf_dir))).select("seq", "action", "params_hash")


@query(
    f"WITH {ORDERED} SELECT id AS node, nxt AS status, count(*) OVER (PARTITION BY id) AS n FROM odone WHERE action = 'advance-roadmap' QUALIFY row_number() OVER (PARTITION BY id ORDER BY seq DESC) = 1"
)
def action_statuses(spark, sf_dir):
    """The status that executed actions have advanced each node to, and in how many steps."""
    log = G.appended(K.decide(B.order_actions(spark, sf_dir)))["statuses"]
    return log.groupBy("node").agg(F.max_by("status", "seq").alias("status"), F.count(F.lit(1)).alias("n"))


@query(
    f"WITH {ORDERED}, w AS (SELECT * FROM odone WHERE action = 'create_object') SELECT id, 'object ' || min(seq) AS title, arg_min(o_orderstatus, seq) AS object_type, count(*) AS writes FROM w JOIN orders ON o_orderkey = seq GROUP BY id"
)
def object_snapshots(spark, sf_dir):
    """Objects that executed actions make, appended in three batches, with a snapshot after the second."""
    path = f"{shared_folder(spark)}/objects-{uuid.uuid4().hex}"
    writes = G.appended(K.decide(B.order_actions(spark, sf_dir)))["objects"]
    third = writes.agg(F.floor(F.max("seq") / 3)).first()[0] or 1
    for batch in range(3):
        # the last batch is written twice, as after a failure
        for _ in range(1 + (batch == 2)):
            objects.append(writes.where(F.greatest(F.least(F.floor((F.col("seq") - 1) / third), F.lit(2)), F.lit(0)) == batch), path, batch)
        if batch == 1:
            objects.compact(spark, path)
    return objects.state(spark, path).select("id", "title", "object_type", "writes")


@query(f"""WITH {DOCS}, {MENTIONS}, o AS (SELECT doc_id, name, row_number() OVER (PARTITION BY name ORDER BY doc_id::BIGINT) = 1 AS first FROM ments),
l AS (SELECT doc_id, count(*) * (count(*) - 1) // 2 AS n FROM ments GROUP BY doc_id)
SELECT d.id, count(o.name) FILTER (o.first) AS objects_created, count(o.name) FILTER (NOT o.first) AS objects_merged, coalesce(max(l.n), 0)::BIGINT AS links_committed FROM docs d LEFT JOIN o ON o.doc_id = d.id LEFT JOIN l ON l.doc_id = d.id GROUP BY d.id""")
def ingest_counts(spark, sf_dir):
    """What governed ingest reports for each document: objects it created, objects it merged into, links."""
    docs = B.documents(spark, sf_dir)
    rated = docs.withColumn("tier", F.lit("A"))
    written = _object_writes(_entities(spark, sf_dir), docs)
    return G.ingest_counts(docs, written, I.relations(rated, patterns=TERM, names=()))


def _object_writes(entities, docs):
    return K.governed_writes(entities, None, docs)[0].withColumn("doc_id", F.get("doc_ids", F.lit(0)))


_SEEN = [
    ("compliance", None, None, "clear"), (None, None, False, "clear"), ("strategy", None, True, "summary"), ("analyst", None, True, "masked"),
    ("analyst", "segment", None, "clear"), ("viewer", "balance", None, "hidden")
]
_MAY = "CASE role " + " ".join(f"WHEN '{r}' THEN '{','.join(a for a, (who, _) in vocab.ACTIONS.items() if r in who)}'" for r in G.ROLES) + " ELSE '' END"


@query(f"""WITH roles(role) AS (VALUES ('viewer'), ('analyst'), ('strategy'), ('compliance'), ('stranger')),
f AS (SELECT c_custkey AS id, c_acctbal < 0 AS controlled, unnest(['balance', 'name', 'segment']) AS key, unnest([round(c_acctbal)::BIGINT::VARCHAR, c_name, c_mktsegment]) AS value FROM customer),
s AS (SELECT *, CASE WHEN role = 'viewer' AND key = 'balance' THEN 'hidden' WHEN role = 'analyst' AND controlled THEN CASE WHEN key = 'segment' THEN 'masked' ELSE 'masked' END WHEN role = 'strategy' AND controlled THEN 'summary' WHEN role = 'analyst' AND key = 'segment' THEN 'clear' WHEN NOT controlled OR role = 'compliance' THEN 'clear' ELSE 'hidden' END AS see FROM f CROSS JOIN roles),
t AS (SELECT *, CASE see WHEN 'clear' THEN value WHEN 'summary' THEN '{vocab.SUMMARY_PREFIX}' || substr(value, 1, 8) || '{vocab.ELLIPSIS}' WHEN 'masked' THEN '{vocab.MASKED}' END AS display FROM s)
SELECT id, role, coalesce(string_agg(key || '=' || display, '; ' ORDER BY key) FILTER (see != 'hidden'), '') AS facts, count(*) FILTER (see IN ('masked', 'summary')) AS n_masked, count(*) FILTER (see = 'hidden') AS n_hidden,
  count(*) FILTER (see != 'clear') > 0 AS filtered, {_MAY} AS actions FROM t GROUP BY id, role""")
def object_view(spark, sf_dir):
    """Every customer as every role sees it by a table of rules, with the actions that the role may run."""
    c = B.table(spark, sf_dir, "customer")
    values = {"balance": F.round("c_acctbal").cast("long").cast("string"), "name": F.col("c_name"), "segment": F.col("c_mktsegment")}
    every = F.array(*[F.struct(F.lit(k).alias("key"), v.alias("value")) for k, v in values.items()])
    facts = c.select(F.col("c_custkey").alias("id"), (F.col("c_acctbal") < 0).alias("controlled"), F.explode(every).alias("f")).select("id", "controlled", "f.key", "f.value")
    rules = spark.createDataFrame(_SEEN, "role string, key string, controlled boolean, see string")
    return G.object_view(facts, _roles(spark), G.policy(rules))


@query(
    f"WITH {ORDERED}, {ACTS}, every AS (SELECT action, role FROM oacts UNION ALL SELECT action, role FROM acts) SELECT action, role, coalesce({_ALLOWED}, false) AS permitted, coalesce(action IN ({_SANDBOX}), false) AS sandbox, count(*) AS n FROM every GROUP BY ALL"
)
def action_permission_matrix(spark, sf_dir):
    """Which roles may run which actions, for all that two logs ask for, and how often they do."""
    logs = B.order_actions(spark, sf_dir).select("action", "role").unionByName(B.actions(spark, sf_dir).select("action", "role"))
    spec = spark.createDataFrame([(a, list(r), x) for a, (r, x) in vocab.ACTIONS.items()], "action string, roles array<string>, sandbox boolean")
    asked = logs.groupBy("action", "role").agg(F.count(F.lit(1)).alias("n")).join(F.broadcast(spec), "action", "left")
    return asked.select("action", "role", F.coalesce(F.array_contains("roles", F.col("role")), F.lit(False)).alias("permitted"), F.coalesce("sandbox", F.lit(False)).alias("sandbox"), "n")


@query(f"WITH {ACTS} SELECT seq, action, role FROM decided WHERE decision = 'executed' ORDER BY seq DESC LIMIT 100")
def audit_tail(spark, sf_dir):
    return K.tail(K.audit(K.decide(B.actions(spark, sf_dir))), ["seq"], 100).select("seq", "action", "role")


@query(
    "SELECT conv_id, turn, text, n AS version FROM (SELECT *, count(*) OVER (PARTITION BY conv_id) AS n, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS rn FROM conversations) WHERE rn = 1"
)
def page_latest_version(spark, sf_dir):
    return K.versions(B.table(spark, sf_dir, "conversations"), "conv_id", "turn").select("conv_id", "turn", "text", "version")


@query("SELECT p_brand AS id, arg_min(p_name, p_partkey) AS title, array_to_string(list_sort(list_distinct(list(p_type))), ',') AS aliases, count(*) AS writes FROM part GROUP BY p_brand")
def object_fold(spark, sf_dir):
    p = B.table(spark, sf_dir, "part")
    w = p.select(
        F.col("p_brand").alias("id"), F.col("p_partkey").alias("seq"), F.col("p_name").alias("title"), F.lit("Part").alias("object_type"),
        F.array("p_type").alias("aliases"), F.array(F.col("p_size").cast("string")).alias("doc_ids"), F.lit(False).alias("controlled")
    )
    return K.fold_objects(w).select("id", "title", F.array_join(F.array_sort("aliases"), ",").alias("aliases"), "writes")


@query("SELECT l_suppkey AS src, l_partkey AS dst, 'supplies' AS lt, count(*) AS times FROM lineitem GROUP BY ALL")
def link_dedup(spark, sf_dir):
    li = B.table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("src"), F.col("l_partkey").alias("dst"), F.lit("supplies").alias("lt"))
    return K.link_view(li)


@query(
    "SELECT s_suppkey AS id, s_name AS title, count(DISTINCT l_partkey) AS n_links, coalesce(array_to_string(list_sort(list_distinct(list(l_partkey) FILTER (l_partkey IS NOT NULL)))[1:5], ','), '') AS first FROM supplier LEFT JOIN lineitem ON l_suppkey = s_suppkey GROUP BY ALL"
)
def object_with_links(spark, sf_dir):
    o = B.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("title"))
    li = B.table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("src"), F.col("l_partkey").alias("dst"), F.lit("supplies").alias("lt"))
    out = K.object_with_links(o, li)
    return out.select(
        "id", "title", F.coalesce(F.size("links"), F.lit(0)).cast("long").alias("n_links"),
        F.coalesce(F.array_join(F.slice(F.transform("links", lambda x: x["dst"].cast("string")), 1, 5), ","), F.lit("")).alias("first")
    )


@query("SELECT s_name AS title, count(*) AS n FROM supplier GROUP BY s_name")
def objects_by_title(spark, sf_dir):
    return B.table(spark, sf_dir, "supplier").groupBy(F.col("s_name").alias("title")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT source, md5(text) AS mark, count(*) AS n FROM documents GROUP BY ALL HAVING count(*) > 1")
def unique_check(spark, sf_dir):
    """Texts that a source holds more than once."""
    return K.duplicates(B.table(spark, sf_dir, "documents").select("source", F.md5("text").alias("mark")), ["source", "mark"])


MASKS = f"""CASE WHEN NOT controlled OR role = 'compliance' THEN text WHEN role = 'strategy' THEN '{vocab.SUMMARY_PREFIX}' || substr(text, 1, 8) || '{vocab.ELLIPSIS}' WHEN role = 'analyst' THEN '{vocab.MASKED}' END"""
ROLES = "roles(role) AS (VALUES ('viewer'), ('analyst'), ('strategy'), ('compliance'), ('stranger'))"


def _roles(spark):
    return spark.createDataFrame([(r,) for r in ("viewer", "analyst", "strategy", "compliance", "stranger")], "role string")


@query(f"WITH {DOCS}, {ROLES} SELECT id, role, md5({MASKS}) AS shown, controlled AND role != 'compliance' AS masked FROM docs CROSS JOIN roles")
def field_security_mask(spark, sf_dir):
    facts = B.documents(spark, sf_dir).select("id", F.col("text").alias("value"), "controlled")
    return K.field_security(facts, _roles(spark)).select("id", "role", F.md5("display").alias("shown"), "masked")


@query(f"WITH {DOCS}, {ROLES} SELECT role, count(*) AS visible FROM docs CROSS JOIN roles WHERE NOT controlled OR role != 'viewer' GROUP BY role")
def row_visibility(spark, sf_dir):
    both = B.documents(spark, sf_dir).select("controlled").crossJoin(F.broadcast(_roles(spark)))
    return both.where(security.row_visible(F.col("role"), F.col("controlled"))).groupBy("role").agg(F.count(F.lit(1)).alias("visible"))


@query(
    f"WITH {DOCS}, m AS (SELECT DISTINCT doc_id::VARCHAR AS e FROM labels WHERE quality = 0) SELECT substr(md5(id || '|'), 1, 12) AS page_id, id AS doc_id, controlled OR id IN (SELECT e FROM m) AS controlled FROM docs"
)
def mark_controlled_join(spark, sf_dir):
    d = B.documents(spark, sf_dir)
    pages = d.select(T.stable_id(F.col("id"), F.lit("")).alias("page_id"), F.col("id").alias("doc_id"), "controlled")
    marked = B.table(spark, sf_dir, "labels").where("quality = 0").select(F.col("doc_id").cast("string").alias("entity_id"))
    return K.mark_controlled(d.select("id", "controlled"), pages, marked)[1]


@query(f"WITH {DOCS} SELECT id AS entity_id, name AS doc, 'controlled document ingested' AS reason FROM docs WHERE controlled")
def pending_controls(spark, sf_dir):
    d = B.documents(spark, sf_dir)
    return K.governed_writes(_entities(spark, sf_dir), spark.createDataFrame([], "src string, dst string, lt string, doc_id string"), d)[2]


@query("SELECT p_brand AS id, least(1.0, 0.78 + 0.03 * count(*))::DOUBLE AS confidence FROM part GROUP BY p_brand")
def review_confidence(spark, sf_dir):
    p = B.table(spark, sf_dir, "part")
    facts = p.select(F.col("p_brand").alias("id")).distinct().withColumn("confidence", F.lit(None).cast("double"))
    return K.bumped_confidence(facts, p.select(F.col("p_brand").alias("id"), F.lit(0.03).alias("delta"))).withColumn("confidence", F.round("confidence", 9))


CHECKED = """facts AS (SELECT p_partkey // 4 AS object_id, 'k' || p_partkey % 4 AS key, CASE WHEN p_partkey % 11 > 0 THEN 0.5 + p_size / 128.0 END AS confidence, p_partkey AS k, p_size FROM part),
told AS (SELECT *, k % 97 = 0 AS gone, k % 89 > 0 AS valid, k % 3 > 0 AS supported, (p_size % 7 - 3) / 16.0 AS delta FROM facts WHERE k % 5 > 0),
lost AS (SELECT DISTINCT object_id FROM told WHERE gone OR NOT valid),
moved AS (SELECT f.object_id, f.key, l.object_id IS NOT NULL AS lost, coalesce(f.confidence, 0.78) AS base, t.supported, t.delta FROM facts f LEFT JOIN told t ON t.k = f.k LEFT JOIN lost l ON l.object_id = f.object_id),
judged_facts AS (SELECT object_id, key, lost, CASE WHEN supported IS NULL THEN base WHEN supported THEN least(1.0, greatest(0.0, base + delta)) ELSE least(0.55, greatest(0.0, base + delta)) END::DOUBLE AS c FROM moved),
banded AS (SELECT object_id, key, CASE WHEN lost THEN 'object_dropped' WHEN c < 0.6 THEN 'dropped' WHEN c < 0.85 THEN 'pending' ELSE 'keep' END AS band, round_even(c, 3) AS confidence FROM judged_facts)"""


def _checked(spark, sf_dir):
    p = B.table(spark, sf_dir, "part")
    k, same = F.col("p_partkey"), [F.floor(F.col("p_partkey") / 4).alias("object_id"), F.concat(F.lit("k"), F.col("p_partkey") % 4).alias("key")]
    facts = p.select(*same, F.when(k % 11 > 0, 0.5 + F.col("p_size") / 128).alias("confidence"))
    told = p.where(k % 5 > 0).select(*same, (k % 97 == 0).alias("drop"), (k % 89 > 0).alias("valid_type"), (k % 3 > 0).alias("supported"), ((F.col("p_size") % 7 - 3) / 16).alias("delta"))
    return K.apply_verdicts(facts, told)


@query(f"WITH {CHECKED} SELECT * FROM banded")
def verify_apply(spark, sf_dir):
    """Facts about parts, with a judge's verdicts on four of five of them."""
    return _checked(spark, sf_dir)


JUDGED = """v AS (SELECT user_id AS object_id, event_type AS key, event_id % 3 > 0 AS supported, (event_id % 7 - 3) / 16.0 AS delta FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id DESC) = 1),
judged AS (SELECT object_id, key, CASE WHEN supported THEN least(1.0, greatest(0.0, 0.78 + delta)) ELSE least(0.55, greatest(0.0, 0.78 + delta)) END::DOUBLE AS c FROM v)"""


@query(f"WITH {JUDGED} SELECT object_id, key, CASE WHEN c < 0.6 THEN 'dropped' WHEN c < 0.85 THEN 'pending' ELSE 'keep' END AS band, round_even(c, 3) AS confidence FROM judged")
def verify_duplicates(spark, sf_dir):
    """Facts with many verdicts each, of which the last counts."""
    e = B.table(spark, sf_dir, "events").select(F.col("user_id").alias("object_id"), F.col("event_type").alias("key"), F.col("event_id").alias("seq"))
    verdicts = e.withColumn("drop", F.lit(False)).withColumn("valid_type", F.lit(True)).withColumn("supported", F.col("seq") % 3 > 0).withColumn("delta", (F.col("seq") % 7 - 3) / 16)
    facts = e.select("object_id", "key").distinct().withColumn("confidence", F.lit(None).cast("double"))
    return K.apply_verdicts(facts, verdicts)


@query(
    f"WITH {CHECKED}, o AS (SELECT object_id, bool_or(band IN ('keep', 'pending')) AS kept, count(*) FILTER (band = 'dropped') AS d, count(*) FILTER (band = 'pending') AS p FROM banded GROUP BY object_id) SELECT count(*) AS objects_in, count(*) FILTER (kept) AS objects_kept, count(*) FILTER (NOT kept) AS objects_dropped, sum(d)::BIGINT AS facts_dropped, sum(p)::BIGINT AS facts_pending FROM o"
)
def verify_counts(spark, sf_dir):
    return K.review_counts(_checked(spark, sf_dir))


@query(
    "SELECT p_partkey AS id, CASE p_partkey % 4 WHEN 0 THEN NULL WHEN 1 THEN 2 ELSE 1 END::BIGINT AS objects, CASE p_partkey % 4 WHEN 0 THEN NULL WHEN 3 THEN 'n' || p_size ELSE p_brand END AS first FROM part"
)
def llm_json_parse(spark, sf_dir):
    """Replies about parts as models write them: prose alone, JSON in a fence, JSON in prose, nested JSON."""
    p = B.table(spark, sf_dir, "part")
    one = lambda name: F.concat(F.lit('{"id":"'), name, F.lit('","type":"'), F.col("p_type"), F.lit('"}'))
    kinds = [
        F.lit("sorry, no data"),
        F.concat(F.lit('```json\n{"objects":['), one(F.col("p_brand")), F.lit(","), one(F.col("p_name")), F.lit('],"links":[]}\n```')),
        F.concat(F.lit('here: {"objects":['), one(F.col("p_brand")), F.lit("]} done")),
        F.concat(F.lit('{"objects":['), one(F.concat(F.lit("n"), "p_size")), F.lit('],"links":[{"lt":"x","from":"a","to":"b"}]}')),
    ]
    reply = F.get(F.array(*kinds), (F.col("p_partkey") % 4).cast("int"))
    parsed = K.parse_reply(F.col("reply"))
    rows = p.select(F.col("p_partkey").alias("id"), reply.alias("reply"))
    return rows.select("id", F.when(parsed.isNotNull(), F.size(parsed["objects"])).cast("long").alias("objects"), F.try_element_at(parsed["objects"], F.lit(1))["id"].alias("first"))


@query("SELECT page_id, page_id % 5 > 0 AND (page_id % 5 != 2 OR page_id % 64 BETWEEN 16 AND 31) AS local FROM pages")
def egress_hosts(spark, sf_dir):
    """Whether the hosts of pages, or private addresses in their place, may be sent controlled text."""
    n = F.col("page_id")
    hosts = [
        F.regexp_extract("url", "^https?://([^/]+)", 1), F.lit("localhost:8000"), F.concat(F.lit("172."), n % 64, F.lit(".0.1")),
        F.concat(F.lit("10."), n % 256, F.lit(".2.3")), F.concat(F.lit("192.168.0."), n % 256, F.lit(":443"))
    ]
    url = F.concat(F.lit("https://"), F.get(F.array(*hosts), (n % 5).cast("int")), F.lit("/v1"))
    return B.table(spark, sf_dir, "pages").select("page_id", security.is_local(url).alias("local"))


# --- streams, as batches over the same functions ----------------------------------------------


def _drained(spark, stream, mode="append"):
    """What a stream gives when it has read all that is there, from files in the shared folder."""
    at = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"

    def put(batch, number):
        # a batch that runs again writes over itself; in complete mode each batch replaces the last
        batch.write.mode("overwrite").parquet(f"{at}/rows" if mode == "complete" else f"{at}/rows/batch={number}")

    stream.writeStream.foreachBatch(put).outputMode(mode).option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start().awaitTermination()
    rows = spark.read.schema(stream.schema).parquet(f"{at}/rows")
    return rows.select(*stream.columns)


@query("SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def stream_event_windows(spark, sf_dir):
    schema = B.table(spark, sf_dir, "events").schema
    return _drained(spark, S.windows(S.timed(S.table_source(spark, sf_dir, "events", schema))), "complete")


@query("SELECT DISTINCT sha256(text) AS sha256 FROM documents WHERE text IS NOT NULL")
def stream_dedup(spark, sf_dir):
    schema = B.table(spark, sf_dir, "documents").schema
    return _drained(spark, S.first_of_each(S.table_source(spark, sf_dir, "documents", schema)).select("sha256"))


@query(
    "WITH o AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 1 HOUR THEN 0 ELSE 1 END AS s FROM events), g AS (SELECT *, sum(s) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM o) SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, count(*) AS n FROM g GROUP BY user_id, k"
)
def event_sessions(spark, sf_dir):
    e = B.table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return S.sessions(e).select("user_id", F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "n")


@query(ORACLE_SQL["fsm_violations"])
def stream_status(spark, sf_dir):
    """The statuses of customers' orders that don't follow, told by state of a stream."""
    orders = S.table_source(spark, sf_dir, "orders", B.table(spark, sf_dir, "orders").schema)
    # time, then key, as one number
    seq = F.unix_timestamp(F.col("o_orderdate").cast("timestamp")) * 10**9 + F.col("o_orderkey")
    events = orders.select(F.col("o_custkey").alias("node"), seq.alias("seq"), F.col("o_orderstatus").alias("status"), F.lit(False).alias("correction"))
    with status.keyed_state(spark):
        told = _drained(spark, status.violations(events, {"O": "F", "F": "P"}))
    return told.select("node", (F.col("seq") % 10**9).alias("o_orderkey"), "before", "status")

"""The jobs as registered queries: each runs twice over the whole tables into one new folder, and gives what lies there then."""

from __future__ import annotations

import uuid

from jobs import build_index, ingest_documents
from lorewell.catalogue import CHUNKS, DOCS, FIRST, POSTS, TIERED
from lorewell.operators.graph import shared_folder
from lorewell.streaming.ingest import table_path


def job1_build_index(spark, sf_dir: str):
    output = f"{shared_folder(spark)}/job1-{uuid.uuid4().hex}"
    for _ in range(2):
        build_index.run(spark, f"{sf_dir}/documents.parquet", f"{sf_dir}/labels.parquet", output)
    return build_index.output_of(spark, output)


def job2_ingest_documents(spark, sf_dir: str):
    folder = f"{shared_folder(spark)}/job2-{uuid.uuid4().hex}"
    for _ in range(2):
        # all files in one batch, so that of equal texts the first of the whole table stays
        ingest_documents.run(spark, table_path(sf_dir, "documents"), f"{sf_dir}/labels.parquet", f"{folder}/store", f"{folder}/checkpoint", "*", 1_000_000)
    return ingest_documents.output_of(spark, f"{folder}/store")


QUERIES = {"job1_build_index": job1_build_index, "job2_ingest_documents": job2_ingest_documents}

ORACLE_SQL = {
    "job1_build_index": f"WITH {DOCS}, {CHUNKS}, {POSTS} SELECT term, chunk_id, c.department, c.controlled, len, tf FROM post JOIN chunks c USING (chunk_id)",
    "job2_ingest_documents": f"""WITH {DOCS}, {FIRST}, {TIERED % 'firsts'}, {CHUNKS.replace('FROM docs', 'FROM firsts')}
SELECT t.id, t.department, t.tier, t.controlled, sha256(t.text) AS sha256, (SELECT count(*) FROM chunks c WHERE c.doc_id = t.id) AS n_chunks, (t.tier != 'C')::BIGINT AS n_pages FROM tiered t WHERE t.text IS NOT NULL""",
}

"""Extraction by models: sections go to an endpoint by tier, replies are checked and asked for again, a judge
re-scores what was found. Failures stay in the rows; only controlled text on its way out stops a job."""

from __future__ import annotations

import itertools
import json
import re
from collections import deque
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import security, vocab
from . import ingest, knowledge

HINT = 'Answer with JSON only: {"objects":[{"id","type","facts":[{"key","value","confidence"}]}],"links":[{"lt","from","to"}]}'
JUDGE = 'Which of these facts does the text support? Answer with JSON only: {"objects":[{"object_id","valid_type","drop","facts":[{"key","supported","confidence_delta"}]}]}'
FOUND = "objects array<struct<id:string,type:string,facts:array<struct<key:string,value:string,confidence:double>>>>, links array<struct<lt:string,src:string,dst:string>>, error string, attempts int"
VERDICTS = "verdicts array<struct<object_id:string,key:string,drop:boolean,valid_type:boolean,supported:boolean,delta:double>>, error string"

#: Characters of text whose answers a task holds before it passes them on.
CHARS_AT_ONCE = 1 << 20


@dataclass(frozen=True)
class Endpoint:
    """A model: what it is called, where it is, and a function from a prompt to a reply that tasks can carry."""

    name: str
    url: str
    chat: Callable[[str], str]


def endpoint_of(tier: Column, controlled: Column, strong: str, light: str, local: str) -> Column:
    """The name of the endpoint for a section: the local one for controlled text, else by tier; none for tier C."""
    by_tier = F.lit(None).cast("string")
    for name, (model, *_) in vocab.TIER_BUDGET.items():
        if model is not None:
            by_tier = F.when(tier == name, strong if model == "strong" else light).otherwise(by_tier)
    return F.when(by_tier.isNull(), by_tier).when(controlled, local).otherwise(by_tier)


def outermost(reply: str) -> dict:
    """The JSON object in a reply, whatever stands around it."""
    found = re.search(r"\{.*\}", reply or "", re.DOTALL)
    if not found:
        raise ValueError("no JSON object")
    return json.loads(found[0])


def objects_of(reply: str) -> tuple[list, list]:
    """(objects, links) of a reply that has the wanted shape."""
    data = outermost(reply)
    if not isinstance(data.get("objects"), list) or not all(isinstance(o, dict) and "id" in o and "type" in o for o in data["objects"]):
        raise ValueError("objects need an id and a type")
    text = lambda v: None if v is None else str(v)
    facts = lambda o: [{"key": text(f.get("key")), "value": text(f.get("value")), "confidence": float(f.get("confidence", vocab.FACT_CONFIDENCE))} for f in o.get("facts") or []]
    objects = [{"id": str(o["id"])[:80], "type": str(o["type"]), "facts": facts(o)} for o in data["objects"] if str(o["id"])]
    links = [{"lt": str(x.get("lt", "related")), "src": str(x.get("from", "")), "dst": str(x.get("to", ""))} for x in data.get("links") or []]
    return objects, links


def verdicts_of(reply: str) -> list:
    out = []
    for o in outermost(reply).get("objects", []):
        whole = {"object_id": o.get("object_id"), "drop": bool(o.get("drop", False)), "valid_type": bool(o.get("valid_type", True))}
        for f in [*o.get("facts", []), None]:
            if whole["object_id"] is not None:
                own = {"key": None, "supported": None, "delta": None} if f is None else {
                    "key": f.get("key", ""), "supported": bool(f.get("supported", True)), "delta": float(f.get("confidence_delta", 0.0))
                }
                out.append(whole | own)
    return out


def _asked(rows: DataFrame, endpoints: dict[str, Endpoint], ask: Callable, schema: str, at_once: int) -> DataFrame:
    """``rows`` (..., endpoint, controlled) with what ``ask`` (endpoint, row) gives as struct ``got``; calls of a batch run at_once at a time.

    Controlled rows on their way to an endpoint that isn't local stop the job before any call of
    their batch is made. Answers go on once they belong to CHARS_AT_ONCE characters, so that a task
    doesn't hold those of a whole batch, which may be many times its text; calls go on meanwhile."""
    url = F.lit(None).cast("string")
    for e in endpoints.values():
        url = F.when(F.col("endpoint") == e.name, F.lit(e.url)).otherwise(url)
    checked = rows.withColumn("_safe", security.is_local(url) | ~F.col("controlled"))

    def told(row):
        return None if row.endpoint is None else ask(endpoints[row.endpoint], row)

    def run(batches):
        with ThreadPoolExecutor(at_once) as pool:
            for pdf in batches:
                if not pdf.pop("_safe").fillna(True).all():
                    raise security.EgressViolation("controlled text for an endpoint that isn't local")
                sizes, calls, got, first, held = [len(b or "") for b in pdf["body"]], deque(), [], 0, 0
                waiting = pdf.itertuples()
                for n, size in enumerate(sizes, 1):
                    calls.extend(pool.submit(told, row) for row in itertools.islice(waiting, 2 * at_once - len(calls)))
                    got.append(calls.popleft().result())
                    held += size
                    if held >= CHARS_AT_ONCE or n == len(sizes):
                        yield pdf.iloc[first:n].assign(got=pd.Series(got, index=pdf.index[first:n], dtype=object))
                        got, first, held = [], n, 0

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return checked.mapInPandas(run, f"{kept}, got struct<{schema}>")


def sections_to_ask(classified: DataFrame, strong: str, light: str, local: str) -> DataFrame:
    """(doc_id, ord, section, body, tier, controlled, endpoint) of the sections that a model is asked about."""
    rows = ingest.sectioned(classified.where("tier != 'C'")).withColumnRenamed("id", "doc_id")
    return rows.select("doc_id", "ord", "section", "body", "tier", "controlled", endpoint_of(F.col("tier"), F.col("controlled"), strong, light, local).alias("endpoint"))


def extract(sections: DataFrame, endpoints: dict[str, Endpoint], retries: int = 2, at_once: int = 8) -> DataFrame:
    """``sections`` with objects, links, error and attempts.

    A reply that isn't JSON of the wanted shape, and a call that fails, are tried again with the error
    added to the prompt; after the last try the section has no objects and its error. Calls are made
    once for each section and batch: what follows should read this from where it was written."""

    def ask(endpoint: Endpoint, row) -> dict:
        prompt, error = f"{HINT}\n<text>\n{row.body or ''}\n</text>", None
        for attempt in range(1, retries + 2):
            try:
                objects, links = objects_of(endpoint.chat(prompt))
                return {"objects": objects, "links": links, "error": None, "attempts": attempt}
            except security.EgressViolation:
                raise
            except Exception as e:  # a model may fail in any way; the row then says how
                error = f"{type(e).__name__}: {e}"
                prompt += f"\n\nThe last answer could not be read ({e}). {HINT}"
        return {"objects": [], "links": [], "error": error, "attempts": retries + 1}

    asked = _asked(sections, endpoints, ask, FOUND, at_once)
    return asked.select(*sections.columns, "got.objects", "got.links", "got.error", "got.attempts")


def judged(extracted: DataFrame, endpoints: dict[str, Endpoint], at_once: int = 8) -> tuple[DataFrame, DataFrame]:
    """(facts, judge's errors): facts (doc_id, ord, object_id, key, value, band, confidence) of extract() after a judge's verdicts.

    ``endpoint`` names the judge of each section. Where the judge fails or can't be read, all facts
    of the section are pending. Verdicts count within their section."""
    with_facts = extracted.where("exists(objects, o -> size(o.facts) > 0)")

    def ask(endpoint: Endpoint, row) -> dict:
        told = json.dumps([{"object_id": o["id"], "type": o["type"], "facts": [dict(f) for f in o["facts"]]} for o in row.objects], ensure_ascii=False)
        try:
            return {"verdicts": verdicts_of(endpoint.chat(f"{JUDGE}\n<text>\n{row.body or ''}\n</text>\n{told}")), "error": None}
        except security.EgressViolation:
            raise
        except Exception as e:  # as above
            return {"verdicts": [], "error": f"{type(e).__name__}: {e}"}

    asked = _asked(with_facts.select("doc_id", "ord", "body", "controlled", "endpoint", "objects"), endpoints, ask, VERDICTS, at_once)
    # facts and verdicts of a section stay apart from those of others
    name = F.concat_ws("|", "doc_id", "ord", "o.id")
    facts = asked.select("doc_id", "ord", F.col("got.error").alias("error"), F.explode("objects").alias("o")).select(
        "doc_id", "ord", "error", name.alias("object_id"), F.col("o.id").alias("id"), F.explode("o.facts").alias("f")
    )
    facts = facts.select("doc_id", "ord", "error", "object_id", "id", "f.key", "f.value", "f.confidence")
    told = asked.select("doc_id", "ord", F.explode("got.verdicts").alias("v")).select(
        F.concat_ws("|", "doc_id", "ord", "v.object_id").alias("object_id"), "v.key", "v.drop", "v.valid_type", "v.supported", "v.delta"
    )
    banded = knowledge.apply_verdicts(facts.select("object_id", "key", "confidence").distinct(), told)
    both = facts.drop("confidence").join(banded, ["object_id", "key"])
    band = F.when(F.col("error").isNotNull(), "pending").otherwise(F.col("band"))
    return both.select(
        "doc_id", "ord", F.col("id").alias("object_id"), "key", "value", band.alias("band"), "confidence"
    ), asked.select("doc_id", "ord", F.col("got.error").alias("error")).where("error IS NOT NULL")


def entities_of(extracted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(entities (doc_id, name, type), relations (src, dst, lt, doc_id)) of extract(): each name once for a document."""
    named = extracted.select("doc_id", "ord", F.posexplode("objects").alias("i", "o"))
    first = named.groupBy("doc_id", F.col("o.id").alias("name")).agg(F.min(F.struct("ord", "i", F.col("o.type").alias("type"))).alias("f"))
    links = extracted.select("doc_id", F.explode("links").alias("l"))
    return first.select("doc_id", "name", "f.type"), links.select("l.src", "l.dst", "l.lt", "doc_id")

"""Queries over strict JSON sources, with SQL that reads the same texts."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from marginalia.functions import fixed as X
from marginalia.operators import library
from marginalia.plans.language import quote, values
from marginalia.sources import documents as D
from marginalia.sources import json_source as J
from marginalia.plans.fixtures import told, told_sql

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return add


def _source(*drop: str, more: tuple = (), **root) -> dict:
    blocks = [
        {"kind": "snapshot", "payload": {"heading": "Harbour", "summary": "Gates move to readers."}},
        {"kind": "signals", "title": "Numbers", "payload": {"entries": [{"label": "Queue", "trend": "down", "value": 4}]}},
        {"kind": "decisions", "payload": {"entries": [{"ref": "D-1", "status": "approved", "text": "Keep manual gates \"north\""}]}},
        {"kind": "timeline", "payload": {"entries": [{"date": "2026-05-01", "state": "planned", "title": "Launch"}]}},
        {"kind": "risks", "payload": {"entries": [], "notes": ["none yet"]}},
        {"kind": "actions", "payload": {"entries": [{"status": "pending", "task": "Sign"}]}},
    ]
    return {"blocks": [b for b in blocks if b["kind"] not in drop] + list(more), "title": "Plan", "version": 1} | root


_ACTION = lambda **e: {"kind": "actions", "payload": {"entries": [e]}}
SOURCES = tuple(
    (i, x if isinstance(x, str) else json.dumps(x, indent=1, ensure_ascii=False))
    for i, x in enumerate(
        (
            _source(), _source("actions", more=(_ACTION(status="open", task="Old"), )), _source("risks", "signals"), _source(more=({"kind": "risks", "payload": {"entries": []}},)), _source(version=2), _source(extra=1, title=""),
            _source("actions", more=(_ACTION(status="late", task="x"),)), _source("actions", more=(_ACTION(status="done", task="x", colour="red"),)), _source("actions", more=(_ACTION(status="done"),)), _source(more=({"kind": "mood", "payload": {}},)),
            '{"version": 1, "title": "x", "blocks": [}', "[1, 2]", _source(**{"__proto__": {"a": 1}}), _source(relations=[{"from": "actions:0", "to": "decisions:0", "relation": "implements"}]), '{"title": "x", "blocks": []}', _source("risks", more=({"kind": "risks", "payload": {"entries": [{"risk": "r", "odd key": 1, "constructor": 2}]}},)),
        )
    )
)
_FIELDS = [("snapshot", f, r[0], "") for f, r in J.SNAPSHOT.items()] + [(k, f, r[0], "|".join(r[2]) if isinstance(r[2], tuple) else "") for k, fs in J.ENTRIES.items() for f, r in fs.items()]
_KINDS = ", ".join(map(quote, X.KINDS))
_FROM = rf"""with {told_sql("raw", "doc_id, raw", SOURCES)}, {values("fd", "kind, field, required, allowed", _FIELDS)},
v as (select doc_id, raw, json_valid(raw) as valid from raw), j as (select doc_id, raw, case when valid then cast(raw as json) end as j from v),
tree as (select doc_id, unnest(list_concat([('$', j)], [('$.' || k, j->k) for k in coalesce(case when json_type(j) = 'OBJECT' then json_keys(j) end, [])])) as n from j where j is not null),
bl as (select doc_id, j, unnest(range(0, len(bs))) as i, unnest(bs) as b from (select doc_id, j, from_json(j->'blocks', '["json"]') as bs from j where json_type(j) = 'OBJECT' and json_type(j->'blocks') = 'ARRAY')),
bk as (select *, b->>'kind' as kind from bl), en as (select doc_id, i, kind, unnest(range(0, len(es))) as e, unnest(es) as x from (select *, from_json(b->'payload'->'entries', '["json"]') as es from bk where json_type(b->'payload'->'entries') = 'ARRAY')),
bad as (select doc_id, 'json.syntax' as code, null as path, 1 as stage from v where not valid union all
  select doc_id, 'input.unsafe-key', '$.' || k, 2 from (select doc_id, unnest(json_keys(j)) as k from j where json_type(j) = 'OBJECT') where k in ('__proto__', 'prototype', 'constructor') union all
  select doc_id, 'input.unsafe-key', '$.blocks[' || i || '].payload.entries[' || e || '].' || k, 2 from (select *, unnest(json_keys(x)) as k from en) where k in ('__proto__', 'prototype', 'constructor') union all
  select doc_id, 'json.invalid-field', '$', 3 from j where j is not null and json_type(j) <> 'OBJECT' union all
  select doc_id, 'json.unsupported-version', '$.version', 4 from j where json_type(j) = 'OBJECT' and (j->'version') is not null and j->>'version' <> '1' union all
  select doc_id, 'json.unsupported-version', '$.version', 5 from j where json_type(j) = 'OBJECT' and (j->'version') is null union all
  select doc_id, 'json.invalid-field', '$.title', 5 from j where json_type(j) = 'OBJECT' and coalesce(j->>'title', '') = '' union all
  select doc_id, 'json.invalid-field', '$.blocks', 5 from j where json_type(j) = 'OBJECT' and coalesce(json_array_length(j->'blocks'), 0) = 0 union all
  select doc_id, 'json.unknown-key', '$', 5 from j where json_type(j) = 'OBJECT' and len(list_filter(json_keys(j), lambda k: k not in ('version', 'title', 'blocks', 'relations', 'archetype'))) > 0 union all
  select doc_id, 'json.unknown-kind', '$.blocks[' || i || '].kind', 5 from bk where kind not in ({_KINDS}) union all
  select doc_id, 'json.invalid-field', '$.blocks[' || i || '].payload.entries[' || e || '].' || field, 5 from en join fd using (kind) where (required and (x->field) is null) or (allowed <> '' and (x->field) is not null and not list_contains(string_split(allowed, '|'), case when x->>field = 'open' and field = 'status' then 'pending' else x->>field end)) union all
  select doc_id, 'json.unknown-key', '$.blocks[' || i || '].payload.entries[' || e || ']', 5 from en join (select kind, list(field) as known from fd group by kind) using (kind) where len(list_filter(json_keys(x), lambda k: not list_contains(known, k))) > 0 union all
  select doc_id, 'json.duplicate-kind', '$.blocks[' || i || '].kind', 6 from (select *, row_number() over (partition by doc_id, kind order by i) as n from bk) where n > 1 union all
  select doc_id, 'json.missing-kind', '$.blocks', 6 from (select doc_id, k from (select distinct doc_id from bk), (select unnest([{_KINDS}]) as k)) m where not exists (select 1 from bk where bk.doc_id = m.doc_id and bk.kind = m.k)),
er as (select doc_id, code, path from bad qualify stage = min(stage) over (partition by doc_id)),
good as (select doc_id, raw, j from j where doc_id not in (select doc_id from er))"""


def _rows(spark, sf_dir):
    return told(spark, sf_dir, list(SOURCES), "doc_id int, raw string")


@query(_FROM.replace("x->field", "json_extract(x, '$.\"' || field || '\"')").replace("x->>field", "json_extract_string(x, '$.\"' || field || '\"')") + " select doc_id, code, path, count(*) as n from er group by all")
def json_import_errors(spark, sf_dir):
    """Errors of the strict import, with paths; the first failing stage tells all of its own."""
    rows = J.imported(_rows(spark, sf_dir)).select("doc_id", F.explode("errors").alias("e"))
    return rows.groupBy("doc_id", "e.code", "e.path").agg(F.count("*").alias("n"))


_FROM2 = ORACLES["json_import_errors"].rpartition(" select doc_id, code, path")[0]


@query(_FROM2 + " select doc_id, n as rewritten from (select good.doc_id, (select count(*) from en where en.doc_id = good.doc_id and x->>'status' = 'open') as n from good) where n > 0")
def json_migrated(spark, sf_dir):
    """Entries whose old status was rewritten."""
    return J.imported(_rows(spark, sf_dir)).where("ok").select("doc_id", F.explode("warnings").alias("w")).select("doc_id", F.col("w.count").cast("long").alias("rewritten"))


@query(
    _FROM2
    + r""", cb as (select bk.doc_id, i, kind, coalesce(b->>'title', upper(kind[1]) || kind[2:]) as title, replace(cast(b->'payload' as varchar), '"open"', '"pending"') as payload, 'blocks[' || i || '] · ' || kind as locator, raw from bk join good using (doc_id)),
ix as (select *, string_split(raw, chr(10)) as ls from cb), ex as (select *, coalesce(list_filter(range(1, len(ls) + 1), lambda k: contains(ls[k], '"' || kind || '"'))[1], least(i + 1, len(ls))) as s from ix)
select doc_id, cast(i as int) as source_order, kind, title, 'blk_' || kind || '_' || left(sha256('{"kind":"' || kind || '","locator":"' || locator || '","payload":' || payload || ',"title":"' || title || '"}'), 12) as block_id, left(trim(regexp_replace(array_to_string(ls[s:s + 2], chr(10)), '\s+', ' ', 'g')), 240) as excerpt from ex"""
)
def canonical_blocks(spark, sf_dir):
    """Blocks with their stable ids, locators and excerpts."""
    return J.canonical_blocks(_rows(spark, sf_dir)).select("doc_id", "source_order", "kind", "title", "block_id", "excerpt")


@query(_FROM2 + ", cb as (select bk.doc_id, i, kind from bk join good using (doc_id)), wn as (select cast(s_suppkey * 1000 as int) as doc_id, unnest([1, 2, 3]) as p, unnest(['risks', 'actions', 'mood']) as kind from supplier) select cb.doc_id, kind, cast(row_number() over (partition by cb.doc_id order by coalesce(p, 1000 + i)) as int) as place from cb left join wn using (doc_id, kind)")
def blocks_reordered(spark, sf_dir):
    """Blocks in a wanted order; those it doesn't name follow."""
    blocks = J.canonical_blocks(_rows(spark, sf_dir)).select("doc_id", F.col("kind").alias("id"), "source_order")
    wanted = told(spark, sf_dir, [(0, "risks actions mood")], "doc_id int, ids string").select("doc_id", F.split("ids", " ").alias("ids"))
    return J.reordered(blocks, wanted).select("doc_id", F.col("id").alias("kind"), "place")


@query("select d.doc_id, fingerprint, example_id from (select doc_id, sha256(trim(nfc_normalize(regexp_replace(text, '\\r\\n?', chr(10), 'g')), e' \\t\\n\\r\\x0b\\x0c')) as fingerprint from documents where text is not null) d join (select sha256(trim(nfc_normalize(regexp_replace(text, '\\r\\n?', chr(10), 'g')), e' \\t\\n\\r\\x0b\\x0c')) as fingerprint, min(doc_id) as example_id from documents where lang = 'en' and text is not null group by 1) c using (fingerprint)")
def verified_examples(spark, sf_dir):
    """Documents whose text is one of the verified examples, here the English ones."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").where("text is not null").select("doc_id", "lang", "text")
    catalogue = docs.where("lang = 'en'").groupBy(D.fingerprint(F.col("text")).alias("fingerprint")).agg(F.min("doc_id").alias("example_id"))
    return D.verified_lookup(docs, catalogue).select("doc_id", "fingerprint", "example_id")


FILES = ((1, "plain"), (2, "a\x00b"), (3, "x\x01\x02\x03y"), (4, "ok\x7fok"), (5, "﻿{\"a\": 1}"), (6, "line\r\ntwo\x00"))


@query()
def binary_guards(spark, sf_dir):
    """Texts with control characters; SQL texts can't hold them, so tests hold the expected rows."""
    rows = D.preflight(told(spark, sf_dir, list(FILES), "doc_id int, raw string"))
    d = F.get("diagnostics", F.lit(0))
    return rows.select("doc_id", "format", d["code"].alias("code"), d["line"].alias("line"), d["column"].alias("column"))


@query("with o as (select o_custkey as doc_id, case when o_orderstatus = 'F' then 'timeline' when o_orderstatus = 'O' then 'signals' else 'decisions' end as kind, o_orderkey as idx, o_orderpriority as text from orders) select doc_id, kind, count(*) as n, left(arg_min(text, idx), 80) as sample from o group by doc_id, kind")
def kind_counts(spark, sf_dir):
    """Entries by kind and document (here: orders by status and customer)."""
    kind = F.when(F.col("o_orderstatus") == "F", "timeline").when(F.col("o_orderstatus") == "O", "signals").otherwise("decisions")
    return library.kind_counts(spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_custkey").alias("doc_id"), kind.alias("kind"), F.col("o_orderkey").alias("idx"), F.col("o_orderpriority").alias("text")))


@query("with t as (select user_id, sum(value) filter (event_id % 2 = 0) as before, sum(value) filter (event_id % 2 = 1) as after from events group by user_id) select user_id, case when before > 0 then round((after - before) / before * 100, 1) end as change from t")
def latency_changes(spark, sf_dir):
    """Change in percent between two halves of the events of each user."""
    half = lambda r: F.sum(F.when(F.col("event_id") % 2 == r, F.col("value")))
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").groupBy("user_id").agg(half(0).alias("before"), half(1).alias("after"))
    return rows.select("user_id", library.latency_change(F.col("before"), F.col("after")).alias("change"))

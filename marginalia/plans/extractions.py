"""Queries over model extractions, with SQL that reads the same JSON."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from marginalia.operators import repair as R
from marginalia.plans.fixtures import told, told_sql
from marginalia.runtime import stored

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(oracle: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = oracle
        return f

    return add


EXTRACTIONS = (
    (1, {"document_meta": {"archetype": "PRD", "timeline_mode": "milestone_chain", "anchor_date": "2026-03-02", "anchor_confidence": "high"},
         "snapshot": [{"content": "Harbour gates move to readers."}, {"content": "  The north pier stays manual. "}],
         "signals": [{"content": "Queue time fell by 12%", "source_confidence": "high"}, {"content": "queue time fell by 12 %"}, {"content": "Refund calls rose at the old desk", "signal_type": "tone"}],
         "timeline": [{"id": "T-001", "content": "Gate launch", "resolved_date": {"type": "point", "value": "2026-09-30"}, "timeline_confidence": {"date_resolution": "high"}, "depends_on": ["T-9", "T-003"]},
                      {"content": "Pier survey soon", "raw_temporal_expression": "soon", "resolved_date": {"type": "relative_unresolved", "value": None}, "timeline_confidence": {"date_resolution": "none"}},
                      {"content": "Refund desk", "date_role": "deadline", "resolved_date": {"type": "range", "value": {"start": "2026-05", "end": "2026-06"}}},
                      {"content": "Staff day", "resolved_date": {"type": "recurring", "value": {"start": None, "pattern": ""}}},
                      {"content": "Weekly check", "date_role": "mention_date", "resolved_date": {"type": "recurring", "value": {"pattern": "every Monday"}}, "responsible_party": "Pier team"},
                      {"content": "Open day", "resolved_date": {"type": "point", "value": " "}}, {"content": "No date at all"}],
         "decisions": [{"content": "UPSERT keep manual gates at the north pier", "decided_by": "board"}, {"decision_id": " D-7 ", "content": "Lease spare gate readers for the ferry season"}],
         "risks": [{"content": "Late readers", "why_it_matters": "MERGE  delays the launch", "source_confidence": "high"}],
         "actions": [{"content": "Sign the reader lease", "status": "ready", "carries_out": "D-001"}, {"content": "Train the pier teams", "carries_out": "D-9"}, {"content": "Sign the reader lease today", "owner": "Mara", "due_date": "2026-05-01"}]}),
    (2, {"document_meta": {"archetype": "Menu", "timeline_mode": "none", "anchor_confidence": "none"}, "snapshot": [{"content": "Ferry menu"}], "timeline": [{"content": "Ferry day", "resolved_date": {"type": "point", "value": "2026-01-01"}}], "risks": [{"content": ""}, {"content": "Late readers"}]}),
    (3, {}),
    (4, {"document_meta": {"archetype": "airline ticket", "timeline_mode": "single_leg", "anchor_date": None}, "timeline": [{"content": c, "raw_temporal_expression": "12 May", "resolved_date": {"type": "point", "value": f"2026-05-{12 + i}"}} for i, c in enumerate(("Departure from Aarhus", "Arrival in Oslo", "Hotel in Oslo", "Return to Aarhus"))]}),
    (5, {"document_meta": {"archetype": "Research paper", "timeline_mode": "weekly", "archetype_confidence": 0.9}, "snapshot": [{"content": "DELETE"}, {"content": "EMBEDDING cluster_id of the row"}], "signals": "none", "decisions": [{"decision_id": "D-2", "content": "Sampling stays at forty days of gate logs"}, {"content": "Sampling stays at forty days of logs"}]}),
    (6, {"document_meta": {"archetype": "other"}, "snapshot": [{"content": "Thin."}], "actions": [{"content": "Close the old form", "status": "done"}]}),
)


def _sql(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


_VERB = _sql(R.STORAGE_VERB)
_FROM = rf"""with {told_sql("raw", "doc_id, raw", [(i, json.dumps(x, ensure_ascii=False)) for i, x in EXTRACTIONS])},
x as (select doc_id, cast(raw as json) as j from raw),
meta as (select doc_id, coalesce(j->>'$.document_meta.archetype', 'generic') as archetype, case when j->>'$.document_meta.timeline_mode' in ({", ".join(map(_sql, R.TIMELINE_MODES))}) then j->>'$.document_meta.timeline_mode' else 'none' end as mode,
  j->>'$.document_meta.anchor_date' as anchor, coalesce(j->>'$.document_meta.anchor_confidence', 'none') as sure from x),
l as (select doc_id, b, case when json_type(j, '$.' || b) = 'ARRAY' then from_json(json_extract(j, '$.' || b), '["json"]') else [] end as l from x, (values {", ".join(f"('{b}')" for b in R.BUCKETS)}) v(b)),
i0 as (select doc_id, b, unnest(range(1, len(l) + 1)) as i, unnest(l) as e from l),
i1 as (select doc_id, b, row_number() over (partition by doc_id, b order by i) as i, e, e->>'content' as c, e->>'why_it_matters' as y from i0 where coalesce(e->>'content', '') <> ''),
i2 as (select *, trim(regexp_replace(regexp_replace(c, {_VERB}, '', 'g'), '\s{{2,}}', ' ', 'g'), e' \n\t') as c1, trim(regexp_replace(regexp_replace(y, {_VERB}, '', 'g'), '\s{{2,}}', ' ', 'g'), e' \n\t') as y1 from i1),
it as (select doc_id, b, i, e, c1 <> c as changed, coalesce(y <> '' and y1 <> y, false) as changed_why, case when c1 <> '' then c1 else trim(regexp_replace(c, {_VERB}, '[redacted]', 'g')) end as content,
  case when y1 <> '' then y1 when y <> '' then trim(regexp_replace(y, {_VERB}, '[redacted]', 'g')) else y end as why from i2),
t0 as (select it.*, mode, coalesce(e->>'$.timeline_confidence.date_resolution', 'medium') as sure, e->>'raw_temporal_expression' as said, e->>'$.resolved_date.type' as kind, json_type(e, '$.resolved_date.value') as vt, e->>'$.resolved_date.value' as v,
  coalesce(e->>'$.resolved_date.value.start', '') as v_start, coalesce(e->>'$.resolved_date.value.end', '') as v_end, coalesce(e->>'$.resolved_date.value.pattern', '') as v_pattern from it join meta using (doc_id) where b = 'timeline'),
t1 as (select *, case when sure in ('low', 'none') then 1 when coalesce(kind, '') = 'relative_unresolved' or vt is null or vt = 'NULL' or (vt = 'VARCHAR' and trim(v) = '') or (vt = 'OBJECT' and v_start || v_end || v_pattern = '') then 2 else 0 end as fate from t0),
t2 as (select *, case when fate = 0 and mode = 'none' then 3 when fate = 0 and mode = 'single_leg' and row_number() over (partition by doc_id, fate order by i) > 2 then 3 else fate end as left_at from t1),
tl as (select *, row_number() over (partition by doc_id order by i) as k, coalesce(nullif(trim(e->>'id'), ''), 'T-' || lpad(cast(row_number() over (partition by doc_id order by i) as varchar), 3, '0')) as id from t2 where left_at = 0),
sg as (select doc_id, 0 as step, i, content, coalesce(e->>'signal_type', 'pattern') as signal_type, coalesce(e->>'source_confidence', 'medium') as confidence from it where b = 'signals' union all
  select doc_id, left_at, i, case left_at when 1 then {_sql(R.UNRESOLVED)} || content || case when coalesce(said, '') <> '' then ' (“' || said || '”)' else '' end when 2 then {_sql(R.NO_SAFE_DATE)} || content else content end,
    case when left_at = 3 and mode = 'single_leg' then 'pattern' else 'unresolved_temporal' end, case when left_at = 2 then 'low' else 'medium' end from t2 where left_at > 0),
dc as (select doc_id, i, content, e, coalesce(nullif(trim(e->>'decision_id'), ''), 'D-' || lpad(cast(i as varchar), 3, '0')) as id from it where b = 'decisions'),
ac as (select a.doc_id, a.i, a.content, a.e, e->>'carries_out' as wants, case when coalesce(e->>'carries_out', '') = '' or exists (select 1 from dc where dc.doc_id = a.doc_id and dc.id = a.e->>'carries_out') then e->>'carries_out' end as carries_out from it a where b = 'actions'),
dp as (select doc_id, k, d, unnest(range(1, 100)) as n from (select doc_id, k, case when json_type(e, '$.depends_on') = 'ARRAY' then from_json(e->'depends_on', '["varchar"]') else [] end as d from tl)),
dq as (select doc_id, k, d[n] as d, n, exists (select 1 from tl where tl.doc_id = dp.doc_id and tl.id = dp.d[n]) as known from dp where n <= len(d)),
al as (select doc_id, 'snapshot' as b, i as ord, content, null as extra from it where b = 'snapshot' union all select doc_id, 'signals', row_number() over (partition by doc_id order by step, i), content, null from sg union all
  select doc_id, 'timeline', k, content, null from tl union all select doc_id, 'risks', i, content, null from it where b = 'risks' union all select doc_id, 'decisions', i, content, id from dc union all select doc_id, 'actions', i, content, carries_out from ac),
ky as (select *, trim(regexp_replace(lower(content), '[^a-z0-9]+', ' ', 'g')) as key from al),
kw as (select *, list_distinct(list_filter(string_split(key, ' '), lambda w: length(w) > 2)) as w from ky),
gr as (select doc_id, b, list([{{'ord': ord, 'key': key, 'w': w}}] order by ord) as xs from kw group by doc_id, b),
kp as (select doc_id, b, unnest(list_reduce(xs, lambda a, x: case when len(list_filter(a, lambda k: k.key = x[1].key or (least(len(k.w), len(x[1].w)) > 0 and len(list_intersect(k.w, x[1].w)) >= 0.85 * least(len(k.w), len(x[1].w)) and abs(len(k.w) - len(x[1].w)) <= 3))) > 0 then a else list_concat(a, x) end)) as x from gr),
fin as (select kw.* from kw join kp on kw.doc_id = kp.doc_id and kw.b = kp.b and kw.ord = kp.x.ord)"""
_SCORE = """, n as (select x.doc_id, count(*) filter (b = 'snapshot') as s, count(*) filter (b in ('signals', 'decisions', 'risks', 'actions')) as m, count(*) filter (b = 'timeline') as t, count(*) filter (b = 'decisions') as d, count(*) filter (b = 'actions') as a,
  count(*) filter (b = 'actions' and coalesce(extra, '') <> '' and exists (select 1 from fin f where f.doc_id = x.doc_id and f.b = 'decisions' and f.extra = fin.extra)) as linked from x left join fin using (doc_id) group by x.doc_id),
sc as (select doc_id, least(1.0, s / 3) as identity, least(1.0, (m + case when t > 0 then 1 else 0 end) / 8) as memory_density, cast(case when mode = 'none' then case when t > 0 then 0.25 else 1 end when t > 0 then 0.9 else 0.55 end as double) as timeline_honesty,
  cast(case when a > 0 then linked / a when d > 0 then 0.8 else 0.7 end as double) as decision_action_link from n join meta using (doc_id)),
q as (select *, round(0.28 * identity + 0.27 * memory_density + 0.25 * timeline_honesty + 0.2 * decision_action_link, 6) as overall from sc)"""


def _rows(spark, sf_dir):
    return told(spark, sf_dir, [(i, json.dumps(x, ensure_ascii=False)) for i, x in EXTRACTIONS], "doc_id long, raw string")


def _items(rows, name, *fields):
    """A row for each item of a bucket."""
    return rows.select("doc_id", F.posexplode(name).alias("idx", "e")).select("doc_id", "idx", *[F.col("e")[f].alias(f) for f in fields])


@query(_FROM + " select doc_id, b as bucket, cast(i - 1 as int) as idx, content, why from it")
def v6_scrubbed(spark, sf_dir):
    """Lenient reading, default buckets and verbs of the storage layer removed."""
    rows = R.scrubbed(R.parsed(_rows(spark, sf_dir)))
    parts = [_items(rows, b, "content", *(["why_it_matters"] if b == "risks" else [])).withColumn("bucket", F.lit(b)) for b in R.BUCKETS]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out.select("doc_id", "bucket", "idx", "content", F.col("why_it_matters").alias("why"))


def _until(spark, sf_dir, step):
    rows = R.parsed(_rows(spark, sf_dir))
    for s in R.STEPS[: R.STEPS.index(step) + 1]:
        rows = s(rows)
    return rows


@query(_FROM + " select doc_id, 'signals' as bucket, cast(row_number() over (partition by doc_id order by step, i) - 1 as int) as idx, content, signal_type, confidence from sg union all select doc_id, 'timeline', cast(k - 1 as int), content, null, null from tl")
def v6_gate(spark, sf_dir):
    """Confidence gate, unusable dates and honesty about the timeline's mode."""
    rows = _until(spark, sf_dir, R.with_honest_mode)
    signals = _items(rows, "signals", "content", "signal_type", "source_confidence").withColumnRenamed("source_confidence", "confidence").withColumn("bucket", F.lit("signals"))
    return signals.unionByName(_items(rows, "timeline", "content").withColumn("bucket", F.lit("timeline")), allowMissingColumns=True)


@query(_FROM + " select doc_id, 'decisions' as bucket, cast(i - 1 as int) as idx, id as ref from dc union all select doc_id, 'actions', cast(i - 1 as int), carries_out from ac union all select tl.doc_id, 'timeline', cast(k - 1 as int), id || ' <- ' || coalesce((select string_agg(d, ',' order by n) from dq where dq.doc_id = tl.doc_id and dq.k = tl.k and known), '') from tl")
def v6_orphans(spark, sf_dir):
    """Numbered ids, and links that point to something."""
    rows = _until(spark, sf_dir, R.with_links)
    phases = rows.select("doc_id", F.posexplode("timeline").alias("idx", "e")).select("doc_id", F.lit("timeline").alias("bucket"), "idx", F.concat("e.id", F.lit(" <- "), F.array_join("e.depends_on", ",")).alias("ref"))
    of = lambda b, f: _items(rows, b, f).select("doc_id", F.lit(b).alias("bucket"), "idx", F.col(f).alias("ref"))
    return of("decisions", "decision_id").union(of("actions", "carries_out")).union(phases)


@query(_FROM + " select doc_id, b as bucket, cast(row_number() over (partition by doc_id, b order by ord) - 1 as int) as idx, content from fin")
def v6_repaired(spark, sf_dir):
    """All steps, near repeats compressed."""
    rows = R.repaired(_rows(spark, sf_dir))
    parts = [_items(rows, b, "content").withColumn("bucket", F.lit(b)) for b in R.BUCKETS]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


@query(_FROM + """, rp as (select doc_id, 'backend_verbs_scrubbed' as mode, sum(cast(changed as int) + cast(changed_why as int)) as count from it group by doc_id union all
select doc_id, case left_at when 1 then 'timeline_confidence_gate' when 2 then 'fabricated_date_rejected' else 'timeline_mode_honesty' end, count(*) from t2 where left_at > 0 group by doc_id, left_at union all
select doc_id, 'orphan_link_repair', sum(n) from (select doc_id, count(*) filter (coalesce(wants, '') <> '' and carries_out is null) as n from ac group by doc_id union all select doc_id, count(*) filter (not known) from dq group by doc_id) group by doc_id union all
select doc_id, 'duplicate_compression', (select count(*) from al where al.doc_id = x.doc_id) - (select count(*) from fin where fin.doc_id = x.doc_id) from x) select doc_id, mode, cast(count as int) as count from rp where count > 0""")
def v6_repairs(spark, sf_dir):
    """What each step changed."""
    # Outer: of an inner explode Spark makes a filter, which holds all steps anew, many times over.
    return R.repaired(_rows(spark, sf_dir)).select("doc_id", F.explode_outer("repairs").alias("r")).where("r is not null").select("doc_id", "r.mode", "r.count")


@query(_FROM + _SCORE + " select * from q")
def v6_quality(spark, sf_dir):
    return R.quality(R.repaired(_rows(spark, sf_dir)))


@query(_FROM + _SCORE + " select i.doc_id, i.timeline_honesty < c.timeline_honesty - 0.05 or i.overall + 0.08 < c.overall or (i.memory_density = 0 and c.memory_density > 0) as fallback from q i join q c on c.doc_id = floor(i.doc_id / 1000) * 1000 + 1")
def v6_fallback(spark, sf_dir):
    """Whether each extraction is worse than the scores of its supplier's first one, taken as the local candidate of all that supplier's."""
    scores = stored(R.quality(R.repaired(_rows(spark, sf_dir))), "scores")
    first = F.floor(F.col("doc_id") / 1000) * 1000 + 1
    candidate = scores.select("doc_id", first.alias("_first")).join(scores.withColumnRenamed("doc_id", "_first"), "_first").drop("_first")
    return R.falls_back(candidate, scores)


@query(_FROM + r""", parts as (select doc_id, ord, content from fin where b = 'snapshot' and ord <= (select max(o) from (select f.ord as o, row_number() over (partition by f.doc_id order by f.ord) as r from fin f where f.b = 'snapshot' and f.doc_id = fin.doc_id) where r <= 3)),
s as (select doc_id, string_agg(trim(content), ' ' order by ord) as said from parts group by doc_id), k as (select *, regexp_replace(lower(archetype), '[\s/-]+', '_', 'g') as key from meta),
a as (select *, case when key = 'cv' or contains(key, 'resume') then 'resume' when key = 'receipt' or contains(key, 'invoice') then 'invoice' when contains(key, 'research') or contains(key, 'paper') then 'research' else 'generic' end as id from k)
select doc_id, archetype as heading, coalesce(said, 'A ' || archetype || ' remembered with timeline mode ' || mode || '.') as summary, case when coalesce(anchor, '') <> '' then 'Anchor ' || anchor || ' · ' || sure when sure = 'none' then 'No reliable date anchor' end as byline, id as archetype,
case id when 'resume' then 'Resume' when 'invoice' then 'Invoice' when 'research' then 'Research' else case when lower(trim(archetype)) in ('other', 'generic', 'unknown', '') then 'Generic Knowledge' else left(trim(archetype), 80) end end as archetype_label from a left join s using (doc_id)""")
def v6_snapshots(spark, sf_dir):
    return R.projected_snapshots(R.repaired(_rows(spark, sf_dir)))


@query(_FROM + r""", w as (select fin.*, coalesce(nullif(trim(regexp_extract(content, '^[^.!?]*')), ''), content) as first from fin where b <> 'snapshot'),
o as (select *, cast(row_number() over (partition by doc_id, b order by ord) - 1 as int) as idx from w)
select o.doc_id, o.b as kind, idx, o.content as text, case when o.b = 'signals' then array_to_string(regexp_split_to_array(first, '\s+')[1:8], ' ') end as label,
 case when o.b = 'timeline' then case when tl.vt = 'OBJECT' then coalesce(nullif(tl.v_start, '') || '–' || nullif(tl.v_end, ''), nullif(tl.v_start, ''), nullif(tl.v_pattern, '')) else trim(tl.v) end when o.b = 'actions' then nullif(ac.e->>'due_date', '') end as date,
 case when o.b = 'timeline' then case coalesce(tl.e->>'date_role', 'event_date') when 'authored_date' then 'done' when 'mention_date' then 'done' when 'deadline' then 'planned' else 'on-track' end end as state,
 case o.b when 'decisions' then 'approved' when 'risks' then coalesce(rk.e->>'source_confidence', 'medium') when 'actions' then case when ac.e->>'status' in ('ready', 'done', 'suggested') then ac.e->>'status' else 'pending' end end as status,
 case o.b when 'decisions' then o.extra when 'actions' then nullif(o.extra, '') when 'timeline' then (select string_agg(d, ', ' order by n) from dq where dq.doc_id = o.doc_id and dq.k = o.ord and known) end as ref,
 case o.b when 'timeline' then tl.e->>'responsible_party' when 'actions' then nullif(ac.e->>'owner', '') end as owner,
 case o.b when 'decisions' then 'Decided by ' || nullif(dc.e->>'decided_by', '') when 'risks' then nullif(rk.why, '') end as because
from o left join tl on o.b = 'timeline' and tl.doc_id = o.doc_id and tl.k = o.ord left join ac on o.b = 'actions' and ac.doc_id = o.doc_id and ac.i = o.ord left join dc on o.b = 'decisions' and dc.doc_id = o.doc_id and dc.i = o.ord left join it rk on o.b = 'risks' and rk.b = 'risks' and rk.doc_id = o.doc_id and rk.i = o.ord""")
def v6_projected(spark, sf_dir):
    """The entries that the repaired extractions give."""
    return R.projected(R.repaired(_rows(spark, sf_dir)))

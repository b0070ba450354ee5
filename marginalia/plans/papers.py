"""Queries over research papers: fixture documents of our own, with SQL over the same lines."""

from __future__ import annotations

from pyspark.sql import functions as F

from marginalia.functions import fixed as X
from marginalia.operators import graphs, library
from marginalia.operators import research as R
from marginalia.runtime import stored
from marginalia.plans.fixtures import told, told_sql

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(oracle: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = oracle
        return f

    return add


GATES = """# Adaptive gates under load
Draft of a harbour paper with four authors.

## Abstract
Little is known about adaptive ferry gates under winter load. We study whether adaptive gates keep queues short within 2 points of staffed gates.
Adaptive gates cut waiting time by 18% in our experiments [3]. However, a gap remains between pilot piers and large piers (Silva et al., 2024).

## Method
The dataset holds 40 days of gate logs [1, 2]. We compare fixed gates with adaptive gates on three piers.
| Gate | Rate |
North-pier 12 14 16 18
- Gates were sampled every ten minutes during the day.

## Results
Adaptive gates reach 93.5% accuracy against 88.1% for fixed gates. Gate type classification (80-90% F1) holds on all piers.
Adaptive gates significantly improve boarding on cold mornings. Fixed gates fail when two ferries land at once.
Results demonstrate strong recall on boarding events at 91%.

## Limitations
Dataset Scope: the logs come from one harbour with mild winters. Other harbours may differ in ferry size and staff.
Staffing: we did not evaluate gates without any staff on the pier.
Several limitations should be considered when interpreting results.

## Future work
We plan to test adaptive gates on river piers next year. Future work should explore gates that learn from ticket sales.

## References
[3] Gate studies of the harbour board are listed here.
"""
PUMPS = """# Pump wear in salt water

## Introduction
Pump wear is not well understood in salt water harbours. This work addresses a fundamental question: do coated pumps last longer?

## Results
Coated pumps lose 4% of their flow after one year. Uncoated pumps lose 11-13% accuracy of flow in the same time.

## Discussion
The study was limited to one pump maker and default parameters. rmance on small pumps is not clear to us yet.
Coating pumps early suggests that repairs can wait for the dry season.

## Conclusion
Coated pumps pay for themselves within 3 points of the forecast.
"""
EMPTY = "# A title without sections\n\nOnly a short line."
PAPERS = ((1, GATES), (2, PUMPS), (3, EMPTY))


def _sql(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _docs(spark, sf_dir):
    return told(spark, sf_dir, PAPERS, "doc_id long, text string")


_ROLE = "case " + " ".join(f"when regexp_matches(title, {_sql(p)}) then '{name}'" for name, p in X.RESEARCH_ROLES) + " else 'other' end"
_LINES = rf"""with {told_sql("papers", "doc_id, text", PAPERS)},
ln as (select doc_id, unnest(range(1, len(ls) + 1)) as line_no, unnest(ls) as line from (select doc_id, string_split(text, chr(10)) as ls from papers)),
hd as (select *, case when regexp_matches(line, '^#+ ') then trim(regexp_replace(line, '^#+ ', '')) end as heading from ln),
sx as (select *, cast(sum(case when heading is not null then 1 else 0 end) over (partition by doc_id order by line_no) as int) as section from hd),
ti as (select doc_id, section, max(heading) as title, min(case when heading is null then line_no end) as first_line from sx group by doc_id, section),
bd as (select sx.doc_id, sx.section, title, {_ROLE} as role, first_line, line_no, line from sx join ti on ti.doc_id = sx.doc_id and ti.section = sx.section where heading is null),
it as (select *, trim(regexp_replace(trim(line), '^[-*] ', '')) as body from bd),
pt as (select doc_id, section, line_no, unnest(range(1, len(ps) + 1)) as pn, unnest(ps) as p from (select *, string_split(regexp_replace(regexp_replace(body, '\s+', ' ', 'g'), '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)) as ps from it)),
rn as (select *, lag(regexp_matches(p, {_sql(X.ABBREVIATION)}) or regexp_matches(p, '\d\.$')) over (partition by doc_id, line_no order by pn) as runs from pt),
sn as (select *, sum(case when runs then 0 else 1 end) over (partition by doc_id, line_no order by pn) as spot from rn),
se as (select doc_id, section, line_no, cast(spot - 1 as int) as spot, string_agg(p, ' ' order by pn) as raw from sn group by all),
st as (select it.doc_id, it.section, title, role, first_line, it.line_no, spot, raw, len(string_split(raw, ' ')) as w from se join it on it.doc_id = se.doc_id and it.line_no = se.line_no where raw <> '')"""
_CLAIMS = rf""", c0 as (select *, row_number() over (partition by doc_id, section order by line_no, spot) as n from st where role <> 'references' and w >= 4),
cl as (select doc_id, section, title, role, first_line, line_no, spot, raw as sentence, case when regexp_matches(raw, {_sql(X.CLAIM_METRIC)}) then 'metric' when role = 'limitations' or regexp_matches(raw, {_sql(X.CLAIM_LIMIT)}) then 'limitation' when role = 'future' or regexp_matches(raw, {_sql(X.CLAIM_FUTURE)}) then 'future_work'
  when role in ('abstract', 'introduction', 'hypothesis') and regexp_matches(raw, {_sql(X.CLAIM_GAP)}) then 'research_gap' else 'claim' end as kind,
  list_transform(regexp_extract_all(raw, {_sql(X.CITATION_NUMBERS + "|" + X.CITATION_NAMES)}), lambda m: regexp_replace(m, '^\[|\]$', '', 'g'))[1:3] as cites
  from c0 where n <= {X.CLAIMS_OF_SECTION} and not contains(raw, '|') and not (regexp_matches(raw, {_sql(X.SCOREBOARD)}) and w < 20))"""
_GRAPH = rf""", m0 as (select doc_id, 'paper' as kind, (select arg_min(heading, line_no) from hd where hd.doc_id = papers.doc_id and heading is not null) as label, null as named, -1 as s, 0 as l, 0 as a, 0 as i from papers union all
  select doc_id, 'section', coalesce(title, role), role || ':' || coalesce(title, role), section, 0, 0, 0 from (select distinct doc_id, section, title, role from bd where role <> 'references' and (title is not null or exists (select 1 from bd b where b.doc_id = bd.doc_id and b.section = bd.section and trim(b.line) <> ''))) union all
  select doc_id, kind, left(sentence, 160), null, section, line_no, spot + 1, 0 from cl union all
  select doc_id, 'citation', left('cite:' || m, 120), m, section, line_no, spot + 1, i from (select doc_id, section, line_no, spot, unnest(range(1, len(cites) + 1)) as i, unnest(cites) as m from cl)),
m1 as (select *, kind || '::' || left(trim(regexp_replace(lower(label), '\s+', ' ', 'g')), 120) as key, kind || '_' || left(sha256(kind || ':' || lower(coalesce(named, label))), 12) as own from m0),
m2 as (select *, first_value(own) over (partition by doc_id, key order by s, l, a, i) as id, row_number() over (partition by doc_id, key order by s, l, a, i) as nth from m1),
po as (select m2.*, cl.role, row_number() over (partition by m2.doc_id order by s, l, a) as pos from m2 join cl on cl.doc_id = m2.doc_id and cl.section = s and cl.line_no = l and cl.spot + 1 = a where i = 0 and l > 0),
onm as (select doc_id, count(*) filter (role in ('results', 'conclusion') and kind <> 'metric') = 0 as metrics_only from po group by doc_id),
fi as (select po.doc_id, id, row_number() over (partition by po.doc_id order by pos) as n from po join onm using (doc_id) where role in ('results', 'conclusion') and (metrics_only or kind <> 'metric')),
pk as (select doc_id, id, kind, row_number() over (partition by doc_id, kind order by pos) as n from po),
e0 as (select p.doc_id, p.id as source, q.id as target, 'contains' as relation, 'EXTRACTED' as confidence, 0 as g, q.s as x, 0 as y, 0 as z, 0 as t from m2 p join m2 q on p.doc_id = q.doc_id and p.kind = 'paper' and q.kind = 'section' union all
  select q.doc_id, h.id, q.id, case q.kind when 'metric' then 'reports' when 'limitation' then 'bounds' when 'future_work' then 'proposes' when 'research_gap' then 'motivates' else 'states' end, 'EXTRACTED', 0, q.s, q.l, q.a, 0 from po q join m2 h on h.doc_id = q.doc_id and h.kind = 'section' and h.s = q.s union all
  select q.doc_id, q.id, r.id, 'cites', 'EXTRACTED', 0, r.s, r.l, r.a, r.i from m2 r join po q on r.kind = 'citation' and q.doc_id = r.doc_id and q.s = r.s and q.l = r.l and q.a = r.a union all
  select a.doc_id, a.id, b.id, 'addressed_by', 'INFERRED', 1, a.n, 0, b.n, 0 from pk a join fi b on a.doc_id = b.doc_id and a.kind = 'research_gap' and a.n <= 3 and b.n <= 4 union all
  select a.doc_id, a.id, b.id, 'supports', 'INFERRED', 2, a.n, 0, b.n, 0 from pk a join fi b on a.doc_id = b.doc_id and a.kind = 'metric' and a.n <= 6 and b.n <= 4 and a.id <> b.id union all
  select g.doc_id, g.id, m.id, 'addressed_by', 'INFERRED', 2, m.n, 1, g.n, 0 from pk g join pk m on g.doc_id = m.doc_id and g.kind = 'research_gap' and g.n <= 2 and m.kind = 'metric' and m.n <= 6 join onm on onm.doc_id = g.doc_id where metrics_only or not exists (select 1 from fi where fi.doc_id = m.doc_id and fi.id <> m.id) union all
  select a.doc_id, a.id, b.id, 'qualifies', 'INFERRED', 3, a.n, 0, b.n, 0 from pk a join fi b on a.doc_id = b.doc_id and a.kind = 'limitation' and a.n <= 4 and b.n <= 3),
ed as (select doc_id, source, target, relation, arg_min(confidence, (g, x, y, z, t)) as confidence, min((g, x, y, z, t)) as ord from e0 group by doc_id, source, target, relation)"""


def _graph(spark, sf_dir):
    lines = stored(R.section_lines(_docs(spark, sf_dir)), "paper-lines").where("role <> 'references'")
    whole = lines.groupBy("doc_id", "section").agg(F.first("title").alias("title"), F.first("role").alias("role"), F.first("first_line").alias("first_line"), F.max(F.trim("line") != "").alias("body"))
    titles = lines.where("title is not null").groupBy("doc_id").agg(F.min_by("title", "section").alias("title"))
    return R.graph(R.claims_of(lines), titles, whole.where("title is not null or body").drop("body"))


@query(_LINES + " select distinct doc_id, section, title, role from bd")
def research_roles(spark, sf_dir):
    """Sections of papers with their role."""
    return R.section_lines(_docs(spark, sf_dir)).select("doc_id", "section", "title", "role").distinct()


@query(_LINES + _CLAIMS + " select doc_id, section, role, cast(line_no as int) as line_no, spot, sentence, kind, array_to_string(cites, ' ; ') as cites from cl")
def research_claims(spark, sf_dir):
    """Claims of each section, their kind and citations."""
    return R.claims(_docs(spark, sf_dir)).select("doc_id", "section", "role", "line_no", F.col("at").alias("spot"), "sentence", "kind", F.array_join("cites", " ; ").alias("cites"))


@query(_LINES + _CLAIMS + _GRAPH + " select m2.doc_id, id, m2.kind, label from m2 where nth = 1 and label is not null")
def kg_nodes(spark, sf_dir):
    return _graph(spark, sf_dir)[0].select("doc_id", "id", "kind", "label")


@query(_LINES + _CLAIMS + _GRAPH + " select doc_id, source, target, relation, confidence from ed")
def kg_edges(spark, sf_dir):
    return _graph(spark, sf_dir)[1].drop("ord")


@query(_LINES + _CLAIMS + _GRAPH + ", en as (select doc_id, source as id, ord, 0 as e from ed union all select doc_id, target, ord, 1 from ed), dg as (select doc_id, id, count(*) as degree, min((ord, e)) as f from en group by doc_id, id), rk as (select *, row_number() over (partition by doc_id order by degree desc, f) as rank from dg) select rk.doc_id, cast(rank as int) as rank, rk.id, label, degree from rk join m2 on m2.doc_id = rk.doc_id and m2.id = rk.id and nth = 1 where rank <= 8")
def kg_degree(spark, sf_dir):
    """The eight best connected nodes."""
    return graphs.degrees(*_graph(spark, sf_dir))


@query(_LINES + _CLAIMS + _GRAPH + " select doc_id, source, target, relation, cast(rank as int) as rank from (select *, row_number() over (partition by doc_id order by ord) as rank from ed where confidence = 'INFERRED') where rank <= 12")
def kg_surprising(spark, sf_dir):
    """The first twelve inferred links."""
    return graphs.surprising(_graph(spark, sf_dir)[1]).select("doc_id", "source", "target", "relation", "rank")


_OTHER_NODES = (("metric_other", "Adaptive gates significantly improve  boarding on cold mornings.", "claim"), ("lonely", "A node that nothing names", "claim"), ("gate_paper", "adaptive gates under load", "paper"))
_OTHER_EDGES = (("gate_paper", "metric_other", "states"), ("metric_other", "metric_other", "states"), ("gate_paper", "missing", "states"))
_MERGED = rf""", sn_(id, label, kind, o) as (values {", ".join(f"({_sql(i)}, {_sql(t)}, '{k}', {n})" for n, (i, t, k) in enumerate(_OTHER_NODES))}), se_(source, target, relation, o) as (values {", ".join(f"('{a}', '{b}', '{r}', {n})" for n, (a, b, r) in enumerate(_OTHER_EDGES))}),
an as (select id, label, kind, 0 as late, s, l, a, i from m2 where doc_id = 1 and nth = 1 and label is not null union all select id, label, kind, 1, o, 0, 0, 0 from sn_),
ak as (select *, first_value(id) over (partition by kind, left(trim(regexp_replace(lower(label), '\s+', ' ', 'g')), 120) order by late, s, l, a, i) as keep from an),
ae as (select source, target, relation, confidence from ed where doc_id = 1 union all select source, target, relation, 'EXTRACTED' from se_),
fe as (select distinct p.keep as source, q.keep as target, relation from ae join ak p on p.id = ae.source join ak q on q.id = ae.target where p.keep <> q.keep)"""


#: The same merge for every paper.
_MERGED_ALL = rf""", sn_(id, label, kind, o) as (values {", ".join(f"({_sql(i)}, {_sql(t)}, '{k}', {n})" for n, (i, t, k) in enumerate(_OTHER_NODES))}), se_(source, target, relation, o) as (values {", ".join(f"('{a}', '{b}', '{r}', {n})" for n, (a, b, r) in enumerate(_OTHER_EDGES))}),
an as (select doc_id, id, label, kind, 0 as late, s, l, a, i from m2 where nth = 1 and label is not null union all select doc_id, id, label, kind, 1, o, 0, 0, 0 from papers, sn_),
ak as (select *, first_value(id) over (partition by doc_id, kind, left(trim(regexp_replace(lower(label), '\s+', ' ', 'g')), 120) order by late, s, l, a, i) as keep from an),
ae as (select doc_id, source, target, relation from ed union all select doc_id, source, target, relation from papers, se_),
fe as (select distinct ae.doc_id, p.keep as source, q.keep as target, relation from ae join ak p on p.doc_id = ae.doc_id and p.id = ae.source join ak q on q.doc_id = ae.doc_id and q.id = ae.target where p.keep <> q.keep)"""


def _merged(spark, sf_dir):
    nodes, edges = _graph(spark, sf_dir)
    papers = _docs(spark, sf_dir).select("doc_id")
    of = lambda rows, *names: papers.select("doc_id", F.inline(F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip((*names, "ord"), (*r, f"{k:04d}"), strict=True)]) for k, r in enumerate(rows)])))
    other = of(_OTHER_NODES, "id", "label", "kind")
    links = of([(*e, "EXTRACTED") for e in _OTHER_EDGES], "source", "target", "relation", "confidence")
    nodes = graphs.merged(other, nodes.select(other.columns), ["doc_id", "id"])
    edges = graphs.merged(links, edges.select(links.columns), ["doc_id", "source", "target", "relation"])
    return graphs.without_duplicates(nodes, edges)


@query(_LINES + _CLAIMS + _GRAPH + _MERGED_ALL + " select doc_id, source, target, relation from fe")
def kg_merge(spark, sf_dir):
    """Another graph merged over each paper's own, duplicate entities collapsed."""
    return _merged(spark, sf_dir)[1].select(F.col("doc_id").cast("int").alias("doc_id"), "source", "target", "relation")


@query(_LINES + _CLAIMS + _GRAPH + _MERGED + " select 1 as doc_id, id from ak where id = keep and id not in (select source from fe union all select target from fe)")
def kg_orphans(spark, sf_dir):
    """Nodes of the first paper's merged graph without an edge."""
    nodes, edges = (x.where("doc_id = 1") for x in _merged(spark, sf_dir))
    return graphs.orphans(nodes, edges).select(F.col("doc_id").cast("int").alias("doc_id"), "id")


_STOPS = ", ".join(_sql(w) for w in X.STOP_OPENERS)


def _stump(word: str) -> str:
    bare = f"regexp_replace({word}, '[^A-Za-z]', '', 'g')"
    return f"(length({bare}) between 2 and 8 and lower({bare}) not in ({_STOPS}) and (not regexp_matches({bare}, '(?i)[aeiouy]') or regexp_matches({bare}, {_sql(X.WORD_STUMP)})))"


_CLEAN = rf""", cs as (select *, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(raw, '([A-Za-z])-\s+([a-z])', '\1\2', 'g'), '\s*\((?:[A-Z][A-Za-z-]+(?:\s+et\s+al\.)?,?\s*\d{{4}}(?:[a-z])?(?:\s*;\s*[^)]{{0,80}})?)\)', '', 'g'), '\s*\[\d+(?:\s*[,–-]\s*\d+)*\]', '', 'g'), '\s{{2,}}', ' ', 'g')) as s from st),
gb as (select *, len(string_split(s, ' ')) as n, regexp_replace(string_split(s, ' ')[1], '[^A-Za-z'']', '', 'g') as f, len(list_filter(string_split(s, ' '), lambda w: regexp_matches(w, '^[A-Za-z]{{1,2}}$'))) as tiny from cs),
gg as (select *, s = '' or (regexp_matches(s, '^[a-z]') and length(f) <= 8 and lower(f) not in ({_STOPS})) or {_stump("f")} or regexp_matches(s, '\(\d+$') or regexp_matches(s, '\b\d+\s*[-–—]\s*$') or regexp_matches(s, '[A-Za-z]-\s+[a-z]') or regexp_matches(s, '\[[^\]]{{0,40}}\b(?:The|We|This|Our|In|A)\b')
  or regexp_matches(s, '\b\d{{4}}\]\s*[A-Z][a-z]') or (n < 8 and not regexp_matches(s, '[.!?]$') and regexp_matches(s, '^[a-z]')) or (n >= 8 and tiny / n > 0.35) as garbled,
  len(regexp_extract_all(s, '\d+(?:\.\d+)?%?')) >= 2 or (regexp_matches(s, {_sql(X.RESEARCH_METRIC)}) and n <= 18) as heavy from gb)"""


@query(_LINES + _CLEAN + " select doc_id, cast(line_no as int) as line_no, spot, s as sentence from gg where n >= 6 and not garbled")
def research_sentences(spark, sf_dir):
    """Cleaned sentences without garbled ones."""
    return R.sentences(_docs(spark, sf_dir)).select("doc_id", "line_no", F.col("at").alias("spot"), "sentence")


_POINTS = rf"""case when n between 10 and 45 then 2 when n >= 8 then 1 else 0 end + case when regexp_matches(s, '[.!?]$') then 1 else 0 end + case when regexp_matches(lower(s), {_sql(X.CLAIM_VERBS)}) then 3 else 0 end + case when regexp_matches(lower(s), {_sql(X.CLAIM_TERMS)}) then 3 else 0 end
- case when regexp_matches(lower(s), {_sql(X.RELATED_WORK)}) then 5 else 0 end - case when regexp_matches(lower(s), {_sql(X.OWN_METHOD)}) then 1 else 0 end - case when heavy then 1 else 0 end - case when garbled then 10 else 0 end"""


@query(_LINES + _CLEAN + rf" select doc_id, cast(line_no as int) as line_no, spot, garbled, heavy, s = '' or contains(s, '|') or regexp_matches(s, '^:?-{{3,}}') or (len(regexp_extract_all(s, '\d+(?:\.\d+)?')) >= 4 and n <= len(regexp_extract_all(s, '\d+(?:\.\d+)?')) + 6) as table_dump, cast({_POINTS} as int) as score from gg")
def claim_scores(spark, sf_dir):
    """How much each sentence reads like a finding."""
    rows = R._sentences(R.section_lines(_docs(spark, sf_dir)), R.clean_sentence, 1)
    s = F.col("sentence")
    return rows.select("doc_id", "line_no", F.col("at").alias("spot"), R.garbled(s).alias("garbled"), R.metric_heavy(s).alias("heavy"), R.table_dump(s).alias("table_dump"), R.claim_score(s).cast("int").alias("score"))


@query(
    _LINES
    + _CLEAN
    + rf""", mm as (select doc_id, line_no, spot, s, unnest(regexp_extract_all(s, '(?i)\d+(?:\.\d+)?\s*[-–—]\s*\d+(?:\.\d+)?%\s*(?:F1|accuracy|recall|precision)?|\d+(?:\.\d+)?%')) as m from gg where n >= 6 and not garbled),
mo as (select *, regexp_matches(m, '\d\s*[-–—]\s*\d') as ranged, trim(left(s, strpos(s, m) - 1)) as b from mm),
mw as (select *, list_filter(string_split(regexp_replace(regexp_replace(regexp_replace(regexp_replace(b, '[\s(\[:\-–—,;]+$', ''), '(?i)^(?:results?\s+)?(?:demonstrate|show|shows|showed|achieve|achieves|report|reports)\s+', ''), '(?i)^(?:strong|modest|weak|high|low|extreme)\s+', ''), '(?i)\b(?:particularly|especially|namely)\s+', ''), ' '), lambda w: w <> '') as ws from mo),
ml as (select *, list_filter(range(1, len(ws) + 1), lambda k: not ({_stump("ws[k]")} or (regexp_matches(ws[k], '^[a-z]') and lower(ws[k]) not in ({_STOPS}))))[1] as k from mw),
mn as (select *, regexp_replace(array_to_string(ws[greatest(k, len(ws) - 5):], ' '), '(?i)^(?:on|of|for|in|at|to|with)\s+', '') as l from ml),
mq as (select *, case when k is null or l = '' or length(l) < 3 or regexp_matches(l, '^[A-Za-z]\s+\w+') then 'Measured result' else upper(l[1]) || l[2:] end as label, nullif(regexp_extract(m, '(?i)%\s*(F1|accuracy|recall|precision)$', 1), '') as unit from mn)
select distinct doc_id, cast(line_no as int) as line_no, spot, case when ranged and label = 'Measured result' and unit is not null then unit || ' range' else label end as label, case when ranged then regexp_replace(regexp_extract(m, '(?i)^(.*?%)', 1), '\s*[-–—]\s*', '–') || coalesce(' ' || unit, '') else m end as value from mq"""
)
def metrics_extracted(spark, sf_dir):
    """Percentages and ranges of the cleaned sentences, labelled by the words before them."""
    rows = R.sentences(_docs(spark, sf_dir)).select("doc_id", "line_no", F.col("at").alias("spot"), F.explode(R.metrics(F.col("sentence"))).alias("m"))
    return rows.select("doc_id", "line_no", "spot", "m.label", "m.value").where("value like '%\\%%'")


def limitation_themes(spark, sf_dir):
    """Limits of each paper by theme."""
    return R.limitation_themes(_docs(spark, sf_dir))


QUERIES["limitation_themes"] = limitation_themes


@query(
    _LINES
    + _CLAIMS
    + r""", en as (select doc_id, case kind when 'metric' then 'signals' when 'claim' then 'timeline' else 'decisions' end as kind, sentence as text, nullif(regexp_extract(sentence, '[0-9]+(?:\.[0-9]+)?%'), '') as value from cl),
cp as (select doc_id, count(*) as copied from en d where kind = 'decisions' and lower(trim(text)) in (select lower(trim(f.text)) from en f where f.kind = 'timeline' and f.doc_id = d.doc_id) group by doc_id)
select en.doc_id, count(*) filter (kind = 'timeline') as findings, count(*) filter (kind = 'signals') as evidence, count(*) filter (kind = 'decisions') as insights,
  count(*) filter (kind = 'timeline' and (contains(text, '|') or regexp_matches(text, '^\s*[0-9.]+\s+[0-9.]+\s+[0-9.]+'))) as table_like, count(*) filter (kind = 'signals' and value is not null) as with_values, coalesce(any_value(copied), 0) as copied
from en left join cp using (doc_id) group by en.doc_id"""
)
def research_checks(spark, sf_dir):
    """Checks of what papers were read into: here their claims, measured ones as evidence, limits and gaps as insights."""
    kind = F.when(F.col("kind") == "metric", "signals").when(F.col("kind") == "claim", "timeline").otherwise("decisions")
    value = F.nullif(F.regexp_extract("sentence", r"[0-9]+(?:\.[0-9]+)?%", 0), F.lit(""))
    claims = R.claims(_docs(spark, sf_dir)).select("doc_id", kind.alias("kind"), F.col("sentence").alias("text"), value.alias("value"))
    return library.research_checks(stored(claims, "checked-claims"))

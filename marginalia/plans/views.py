"""Queries over small views, with SQL over the same values."""

from __future__ import annotations

from pyspark.sql import functions as F

from marginalia.operators import views as V
from marginalia.plans.language import quote, values
from marginalia.plans.fixtures import told, told_sql

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(oracle: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = oracle
        return f

    return add


ENTRIES = (
    (1, "signals", 0, None, "Open question", None, "Should the desk keep paper forms for the pier teams in winter?", None, None), (1, "signals", 1, None, "Queue", "4 minutes", None, None, None), (1, "decisions", 0, "Keep manual gates", None, None, None, None, None),
    (1, "risks", 0, "Late readers", None, None, None, None, None), (1, "timeline", 0, None, None, None, None, "2026-05-01", "Launch"), (1, "actions", 0, "Sign the lease", None, None, None, None, None),
)
RELATIONS = ((1, 1, "snapshot", "risks", "frames"), (1, 2, "signals:0", "decisions:0", "blocks"), (1, 3, "actions:0", "decisions:0", "implements"), (1, 4, "actions:0", "decisions:0", "implements"), (1, 5, "risks", "signals:1", "threatens"), (1, 6, "decisions:9", "timeline:0", "depends_on"), (1, 7, "timeline:0", "actions:0", "schedules"))
BLOCKS = ((1, "risks", "Risks — open"), (1, "decisions", "Decisions"), (1, "signals", "Signals"))
_E = told_sql("e", "doc_id, kind, idx, text, label, value, implication, date, title", ENTRIES)
_NAMED = """n0 as (select doc_id, kind || ':' || idx as ref, case kind when 'signals' then case when lower(label) in ('open question', 'open questions') and implication is not null then implication when value is not null and label <> '' then label || ': ' || value else coalesce(implication, nullif(label, '')) end when 'timeline' then concat_ws(' · ', date, title) else text end as t from e),
n as (select doc_id, ref, case when length(t) <= 48 then t else regexp_replace(left(t, 45), '\\s+\\S*$', '') || '…' end as name from n0), w as (select doc_id, kind, trim(regexp_replace(title, '\\s+[—–-].*$', '')) as whole from b)"""
_VERB = "case relation " + " ".join(f"when {quote(k)} then {quote(v)}" for k, v in V.VERBS.items()) + " else replace(relation, '_', ' ') end"


@query(
    f"with {_E}, {told_sql('r', 'doc_id, ord, f, t, relation', RELATIONS)}, {told_sql('b', 'doc_id, kind, title', BLOCKS)}, {_NAMED}, l as (select r.doc_id, ord, coalesce(x.name, u.whole, string_split(f, ':')[1]) || ' ' || {_VERB} || ' ' || coalesce(y.name, v.whole, string_split(t, ':')[1]) as line from r left join n x on x.doc_id = r.doc_id and x.ref = f left join n y on y.doc_id = r.doc_id and y.ref = t left join w u on u.doc_id = r.doc_id and u.kind = string_split(f, ':')[1] left join w v on v.doc_id = r.doc_id and v.kind = string_split(t, ':')[1] where relation <> 'frames'), o as (select doc_id, line, min(ord) as ord from l group by all) select doc_id, cast(rank as int) as rank, line from (select *, row_number() over (partition by doc_id order by ord) as rank from o) where rank <= 4"
)
def conversation_lines(spark, sf_dir):
    """Relations as a conversation inside the document."""
    e = told(spark, sf_dir, list(ENTRIES), "doc_id int, kind string, idx int, text string, label string, value string, implication string, date string, title string")
    r = told(spark, sf_dir, list(RELATIONS), "doc_id int, ord int, from string, to string, relation string")
    return V.conversation(r, e, told(spark, sf_dir, list(BLOCKS), "doc_id int, kind string, title string"))


@query(f"with {told_sql('r', 'doc_id, ord, f, t, relation', RELATIONS)} select ord, string_split(f, ':')[1] as kind, try_cast(string_split(f, ':')[2] as int) as idx, f = 'actions:0' or t = 'actions:0' as touches from r")
def relation_ends(spark, sf_dir):
    """References of relations, and which relations touch one entry."""
    r = told(spark, sf_dir, list(RELATIONS), "doc_id int, ord int, from string, to string, relation string")
    touched = V.touching(r, "actions:0").select("doc_id", "ord", F.lit(True).alias("touches"))
    return r.join(touched, ["doc_id", "ord"], "left").select("ord", V.reference(F.col("from")).alias("x"), F.coalesce("touches", F.lit(False)).alias("touches")).select("ord", "x.kind", "x.idx", "touches")


@query(r"""select page_id, case when n = '' then 'output' else n end as name, case when s >= 1048576 then printf('%.1f MB', floor(s / 1048576 * 10 + 0.5) / 10) when s >= 1024 then printf('%.1f KB', floor(s / 1024 * 10 + 0.5) / 10) else s || ' B' end as size from (select page_id, left(regexp_replace(regexp_replace(regexp_replace(regexp_replace(list_last(string_split(coalesce(url, ''), '/')), '[\x00-\x1f<>:"|?*]', '', 'g'), '\s+', '-', 'g'), '[^A-Za-z0-9._-]', '', 'g'), '^[.]+', ''), 80) as n, octet_length(encode(coalesce(html, ''))) as s from pages)""")
def file_names(spark, sf_dir):
    """File names from the addresses of pages, and their sizes in words."""
    rows = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return rows.select("page_id", V.file_name(F.coalesce("url", F.lit(""))).alias("name"), V.size_words(F.coalesce(F.octet_length("html"), F.lit(0))).alias("size"))


SECTIONS = ((1, 0, None, None), (1, 1, "Open risks", None), (1, 2, "Risk register of the pier", None), (1, 3, "Key metrics", "timeline"), (1, 4, "Prose", None), (2, 1, "Metrics", None))
NODES = ((1, 0, "Prose", "prose"), (1, 1, "risk register", "risk"), (1, 2, "Risks", "decision"), (1, 3, "open risks", "risk"), (2, 0, "Key metrics", "metric"), (2, 1, "", "risk"))
_KIND = "case type " + " ".join(f"when {quote(k)} then {quote(v)}" for k, v in V.NODE_KINDS.items()) + " end"


@query(f"with {told_sql('s', 'doc_id, section, title, kind', SECTIONS)}, {told_sql('n', 'doc_id, ord, title, type', NODES)}, m as (select s.doc_id, section, arg_min(type, ord) as type from s join n on s.doc_id = n.doc_id and n.title <> '' and coalesce(s.title, '') <> '' and (contains(lower(s.title), lower(n.title)) or contains(lower(n.title), lower(s.title))) where kind is null group by all) select s.doc_id, s.section, coalesce(kind, {_KIND}) as kind from s left join m using (doc_id, section)")
def kinds_from_graph(spark, sf_dir):
    """Sections that take their memory from the graph."""
    s = told(spark, sf_dir, list(SECTIONS), "doc_id int, section int, title string, kind string")
    return V.kinds_from_graph(s, told(spark, sf_dir, list(NODES), "doc_id int, ord int, title string, type string"))


LINES = ((1, 0, 1, "short"), (1, 0, 2, ""), (1, 0, 3, "not read since the first run ended"), (1, 1, 4, ""), (1, 1, 5, "- item"), (1, 1, 6, "The pier opens"), (1, 1, 7, "at dawn every day."), (1, 1, 8, "---"), (1, 1, 9, "More."), (2, 0, 1, "→"), (2, 0, 2, "one two"))


@query(f"with {told_sql('l', 'doc_id, section, line_no, line', LINES)}, b as (select *, trim(line) = '' or regexp_matches(line, '^\\s*[-*•]\\s+') or regexp_matches(trim(line), '^[↓↑→←⇒⇓|+/\\\\_.·•\\-–—=]{{1,4}}$') as brk from l), r as (select *, sum(cast(brk as int)) over (partition by doc_id, section order by line_no) as run from b), k as (select *, min(run) over (partition by doc_id, section) as first from r where not brk), t as (select doc_id, section, string_agg(line, ' ' order by line_no) as text from k where run = first group by all) select doc_id, arg_min(text, section) as text from t where len(string_split(text, ' ')) >= 3 group by doc_id")
def first_paragraphs(spark, sf_dir):
    """The first paragraph of plain lines."""
    return V.first_paragraph(told(spark, sf_dir, list(LINES), "doc_id int, section int, line_no int, line string"))


@query("select a.item_id as doc_id, 'kind' || (a.item_id % 5) as kind, coalesce(b.l, 'new ' || a.item_id) as locator, coalesce(b.e, left(a.text, 10)) as excerpt from benchmark a left join (select item_id, 'old ' || item_id as l, case when item_id % 4 = 0 then null else left(text, 20) end as e from benchmark where item_id % 2 = 0) b using (item_id)")
def provenance_carried(spark, sf_dir):
    """Locators and excerpts that an improved document keeps (here: items of the benchmark, every other one known before)."""
    rows = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select(F.col("item_id").alias("doc_id"), "text", F.concat(F.lit("kind"), (F.col("item_id") % 5).cast("string")).alias("kind"))
    name = lambda x: F.concat(F.lit(x), F.col("doc_id").cast("string"))
    new = rows.select("doc_id", "kind", name("new ").alias("locator"), F.substring("text", 1, 10).alias("excerpt"))
    old = rows.where("doc_id % 2 = 0").select("doc_id", "kind", name("old ").alias("locator"), F.when(F.col("doc_id") % 4 != 0, F.substring("text", 1, 20)).alias("excerpt"))
    return V.with_carried_provenance(new, old)


@query("with k as (select distinct sha256(coalesce(text, '')) as key from documents where source = (select min(source) from documents)) select doc_id, key is not null as hit, sha256(coalesce(text, '')) as key from documents left join k on k.key = sha256(coalesce(text, ''))".replace("select doc_id, key is not null as hit", "select doc_id, k.key is not null as hit"))
def parse_cache(spark, sf_dir):
    """Documents that were parsed before: those whose text one of the first source has."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    first = docs.agg(F.min("source").alias("s"))  # one row
    known = docs.join(F.broadcast(first), docs.source == first.s, "left_semi").select(F.sha2(F.coalesce("text", F.lit("")), 256).alias("key"))
    return V.cached(docs.select("doc_id", "text"), known).select("doc_id", "hit", "key")


@query("select user_id, d || case when d = 1 then ' document' else ' documents' end || ' remembered · ' || m || case when m = 1 then ' memory' else ' memories' end || case when p > 0 then ' · ' || p || ' published' else '' end as said, since from (select user_id, count(*) filter (event_type <> 'error') as d, cast(sum(event_id % 3) as bigint) as m, count(*) filter (event_type = 'purchase') as p, cast(min(ts) as date) as since from events group by user_id) where d > 0")
def local_tallies(spark, sf_dir):
    """What each user has done, as a sentence, and since when."""
    kind = F.col("event_type")
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").groupBy("user_id").agg(F.count_if(kind != "error").alias("d"), F.sum(F.col("event_id") % 3).alias("m"), F.count_if(kind == "purchase").alias("p"), F.to_date(F.min("ts")).alias("since"))
    return rows.select("user_id", V.tally(F.col("d"), F.col("m"), F.col("p")).alias("said"), "since").where("said is not null")


PAPERS = (("generic", "a.pdf", "Abstract of the gates", 8), ("resume", "acl.pdf", "Abstract", 30), (None, "Notes.pdf", "Prose", 21), (None, "neurips-2026.pdf", "Prose", 8), ("Research", "a.pdf", "Prose", 6), ("generic", "t.pdf", "| a | b |\n" * 12, 4), ("generic", "t.pdf", "| a | b |\n" * 11, 4))


@query(f"with {told_sql('p', 'n, kind, name, text, pages', [(i, *p) for i, p in enumerate(PAPERS)])} select n, coalesce(lower(kind), '') not in ('resume', 'invoice') and (pages > 20 or ((regexp_matches(text, {quote(V.PAPER_CUES)}) or regexp_matches(lower(name), {quote(V.VENUE_CUES)})) and pages >= 8) or (coalesce(lower(kind), '') = 'research' and pages >= 6) or (len(regexp_extract_all(text, {quote(V.TABLE_LINE)})) >= 12 and pages >= 4)) as refine from p")
def refining_gate(spark, sf_dir):
    """Which documents are worth a second reading."""
    c = F.col
    rows = told(spark, sf_dir, [(i, *p) for i, p in enumerate(PAPERS)], "n int, kind string, name string, text string, pages int")
    return rows.select("n", V.wants_refining(c("kind"), c("name"), c("text"), c("pages")).alias("refine"))


READINGS = (("generic", 3, 1, "# A", "research", 3, 1, "# A\n## B\n## C"), ("resume", 3, 1, "", "research", 9, 9, ""), ("generic", 3, 1, "x", "research", 4, 1, "x"), ("generic", 3, 1, "x", "generic", 4, 5, "x"), (None, 3, 1, "long text here", "research", 3, 1, "#"))


@query(f"with {told_sql('r', 'n, a, b, e, t, a2, b2, e2, t2', [(i, *p) for i, p in enumerate(READINGS)])} select n, coalesce(a, '') not in ('resume', 'invoice') and a2 = 'research' and (b2 > b or e2 > e or (len(regexp_extract_all(t2, {quote(V.HEADING_LINE)})) >= len(regexp_extract_all(t, {quote(V.HEADING_LINE)})) + 2 and length(t2) > length(t) * 0.8)) as better from r")
def refining_result(spark, sf_dir):
    """Whether the second reading replaces the first."""
    rows = told(spark, sf_dir, [(i, *p) for i, p in enumerate(READINGS)], "n int, a1 string, b1 int, e1 int, t1 string, a2 string, b2 int, e2 int, t2 string")
    reading = lambda i: F.struct(*[F.col(f"{c}{i}").alias(n) for c, n in zip("abet", ("archetype", "blocks", "evidence", "text"), strict=True)])
    rows = rows.select("n", reading(1).alias("b"), reading(2).alias("a"))
    return rows.select("n", V.refined_better(F.col("b"), F.col("a")).alias("better"))

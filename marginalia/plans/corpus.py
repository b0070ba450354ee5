"""Queries over whole tables, each with the SQL that DuckDB runs for the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.functions import fixed as X
from marginalia.functions.text import content_tokens, matches, normalize_key, stem, tokenize
from marginalia.operators import library, statements, structure, understanding
from marginalia.plans.language import key as key_sql
from marginalia.plans.language import stem_list as stem_sql
from marginalia.plans.language import tokens as tokens_sql
from marginalia.sources import documents as sources


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return add


def quoted(values) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


STOP = quoted(X.STOPWORDS)
SENTENCES = rf"""
l as (select doc_id, unnest(range(1, len(ls) + 1)) as line_no, unnest(ls) as line from (select doc_id, string_split(coalesce(text, ''), chr(10)) as ls from documents)),
p as (select doc_id, line_no, unnest(range(1, len(ps) + 1)) as pn, unnest(ps) as p from
        (select doc_id, line_no, string_split(regexp_replace(trim(regexp_replace(line, '\s+', ' ', 'g')), '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)) as ps from l)),
q as (select *, lag(regexp_matches(p, '{X.ABBREVIATION}') or regexp_matches(p, '\d\.$')) over (partition by doc_id, line_no order by pn) as runs from p),
r as (select *, sum(case when runs then 0 else 1 end) over (partition by doc_id, line_no order by pn) as sn from q),
s as (select doc_id, line_no, sn, string_agg(p, ' ' order by pn) as s from r group by all),
t as (select doc_id, line_no, sn, s, len(string_split(s, ' ')) as w, trim(regexp_replace(lower(s), '[^a-z0-9]+', ' ', 'g')) as k from s where s <> '')"""
TOKENS = r"""
tok as (select doc_id, line_no, unnest(list_filter(list_transform(regexp_split_to_array(regexp_replace(lower(line), '[''’]s\b', '', 'g'), '[^a-z0-9+#.]+'),
          lambda x: regexp_replace(x, '^\.+|\.+$', '', 'g')), lambda x: x <> '')) as token from
        (select doc_id, unnest(range(1, len(ls) + 1)) as line_no, unnest(ls) as line from (select doc_id, string_split(coalesce(text, ''), chr(10)) as ls from documents)))"""


@query(f"with {SENTENCES} select doc_id, count(*) as n_sentences, count(*) filter (w between 3 and 60) as n_raw, count(distinct k) filter (w between 3 and 60) as n_kept, count(*) filter (w between 3 and 60) - count(distinct k) filter (w between 3 and 60) as n_redundant from t group by doc_id union all select doc_id, 0, 0, 0, 0 from documents where doc_id not in (select doc_id from t)")
def statements_by_doc(spark, sf_dir):
    """Sentences, statements and redundancy of every document: the flagship."""
    return statements.counts(table(spark, sf_dir, "documents"))


@query(f"with {SENTENCES}, o as (select *, row_number() over (partition by doc_id order by line_no, sn) - 1 as ord from t where w between 3 and 60), f as (select *, row_number() over (partition by doc_id, k order by ord) as n from o) select doc_id, cast(ord as int) as ord, s as statement, k as key from f where n = 1")
def statement_exact_dedupe(spark, sf_dir):
    return statements.distilled(table(spark, sf_dir, "documents"))


_CONTENT = rf"list_distinct(list_filter(list_transform(regexp_split_to_array(regexp_replace(lower(s), '[''’]s\b', '', 'g'), '[^a-z0-9+#.]+'), lambda x: regexp_replace(x, '^\.+|\.+$', '', 'g')), lambda x: length(x) >= 3 and x not in ({STOP}) and not regexp_matches(x, '^\d+$')))"


@query(
    f"""with {SENTENCES}, o as (select doc_id, row_number() over (partition by doc_id order by line_no, sn) - 1 as ord, s, k, {_CONTENT} as w from t where w between 3 and 60), g as (select doc_id, list([{{'ord': ord, 's': s, 'k': k, 'w': w}}] order by ord) as xs from o group by doc_id),
f as (select doc_id, unnest(list_reduce(xs, lambda a, x: case when len(list_filter(a, lambda y: y.k = x[1].k or (len(y.w) > 0 and len(x[1].w) > 0 and least(len(y.w), len(x[1].w)) >= 0.72 * greatest(len(y.w), len(x[1].w)) and len(list_intersect(y.w, x[1].w)) / (len(y.w) + len(x[1].w) - len(list_intersect(y.w, x[1].w))) >= 0.72))) > 0 then a else list_concat(a, x) end)) as x from g)
select doc_id, cast(x.ord as int) as ord, x.s as statement from f"""
)
def greedy_dedupe(spark, sf_dir):
    return statements.without_restatements(table(spark, sf_dir, "documents"))


@query(f"with {TOKENS} select token, count(*) as n, count(distinct doc_id) as n_docs from tok group by token")
def token_counts(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", F.explode(tokenize(F.coalesce("text", F.lit("")))).alias("token"))
    per_doc = rows.groupBy("token", "doc_id").agg(F.count("*").alias("n"))
    return per_doc.groupBy("token").agg(F.sum("n").alias("n"), F.count("*").alias("n_docs"))


@query(rf"with {TOKENS} select token, count(*) as n from tok where length(token) >= 3 and token not in ({STOP}) and not regexp_matches(token, '^\d+$') group by token")
def content_token_counts(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(F.explode(content_tokens(F.coalesce("text", F.lit("")))).alias("token")).groupBy("token").agg(F.count("*").alias("n"))


_STEM = "case when length(token) <= 4 then token " + " ".join(f"when token like '%{s}' and length(token) >= {len(s) + 3} then left(token, length(token) - {len(s)})" for s in X.SUFFIXES) + " else token end"


@query(rf"with {TOKENS}, c as (select token, count(*) as n from tok where length(token) >= 3 and token not in ({STOP}) and not regexp_matches(token, '^\d+$') group by token), d as (select n, length(token) as l, {_STEM} as s from c) select case when l > 4 and s like '%e' and length(s) > 4 then left(s, length(s) - 1) else s end as stem, cast(sum(n) as bigint) as n from d group by 1")
def stem_counts(spark, sf_dir):
    tokens = content_token_counts(spark, sf_dir)
    return tokens.groupBy(stem(F.col("token")).alias("stem")).agg(F.sum("n").alias("n"))


def _concept_sql(tail: str) -> str:
    meta, stop = quoted(X.META_TERMS), STOP
    bad = lambda w: f"{w} in ({stop})"
    return rf"""with lines as (select doc_id, unnest(range(0, len(ls))) as section, unnest(ls) as line from (select doc_id, string_split(coalesce(text, ''), chr(10)) as ls from documents)),
w as (select doc_id, section, list_filter(list_transform(regexp_split_to_array(regexp_replace(lower(line), '[''’]s\b', '', 'g'), '[^a-z0-9+#.]+'), lambda x: regexp_replace(x, '^\.+|\.+$', '', 'g')), lambda x: x <> '') as ws from lines),
u as (select doc_id, section, ws, unnest(range(1, len(ws) + 1)) as i from w),
g as (select doc_id, section, i, 1 as size, ws[i] as phrase from u where length(ws[i]) >= 4 and ws[i] not in ({stop}) and ws[i] not in ({meta}) and not regexp_matches(ws[i], '^\d')
      union all select doc_id, section, i, size, array_to_string(ws[i:i + size - 1], ' ') from u, (values (2), (3)) v(size)
      where i + size - 1 <= len(ws) and not {bad('ws[i]')} and not {bad('ws[i + size - 1]')} and length(ws[i]) >= 3 and length(ws[i + size - 1]) >= 3 and not regexp_matches(ws[i + size - 1], '[a-z]{{2}}ed$')
        and len(list_filter(ws[i:i + size - 1], lambda x: regexp_matches(x, '^\d+$'))) = 0 and length(array_to_string(ws[i:i + size - 1], '')) >= 8
        and len(list_filter(ws[i:i + size - 1], lambda x: x not in ({meta}) and x not in ({stop}))) > 0),
k as (select *, trim(regexp_replace(lower(phrase), '[^a-z0-9]+', ' ', 'g')) as key from g),
c as (select doc_id, key, arg_min(phrase, (section, size, i)) as display, count(*) as count, count(distinct section) as spread from k where length(key) >= 3 group by doc_id, key) {tail}"""


@query(_concept_sql("select doc_id, key, count, spread from c"))
def concept_ngrams(spark, sf_dir):
    return understanding.concept_counts(understanding.line_sections(table(spark, sf_dir, "documents"))).select("doc_id", "key", F.col("count").cast("long").alias("count"), "spread")


_HEADS = rf"""h as (select doc_id, ws[i] as word, i < len(ws) and length(ws[i + 1]) >= 3 and ws[i + 1] not in ({STOP}) and not regexp_matches(ws[i + 1], '^\d') as leans, ws[i + 1] as token from u),
hs as (select doc_id, word, leans, length(token) as l, {_STEM} as s, token from h),
hh as (select doc_id, word, count(*) filter (not leans) as free, count(distinct case when leans then case when l > 4 and s like '%e' and length(s) > 4 then left(s, length(s) - 1) else s end end) as followers from hs group by doc_id, word)"""


@query(_concept_sql(", " + _HEADS + " select doc_id, word, free, followers from hh"))
def head_words(spark, sf_dir):
    return understanding.heads(understanding.line_sections(table(spark, sf_dir, "documents")))


@query(_concept_sql(", " + _HEADS + " select c.doc_id, display as phrase, count, spread, round(count * greatest(spread, 1) * (1 + 0.6::double * (len(string_split(display, ' ')) - 1)), 6) as weight from c where (count >= 2 or spread >= 2) and not exists (select 1 from hh where hh.doc_id = c.doc_id and word = list_last(string_split(key, ' ')) and free = 0 and followers = 1)"))
def concept_weights(spark, sf_dir):
    return understanding.weighted_concepts(understanding.line_sections(table(spark, sf_dir, "documents")))


_WEIGHTS = _HEADS + " , wt as (select c.doc_id, display as phrase, count, spread, round(count * greatest(spread, 1) * (1 + 0.6::double * (len(string_split(display, ' ')) - 1)), 6) as weight from c where (count >= 2 or spread >= 2) and not exists (select 1 from hh where hh.doc_id = c.doc_id and word = list_last(string_split(key, ' ')) and free = 0 and followers = 1))"
_BEST = f"""{_WEIGHTS}, ph as (select distinct phrase from wt), pk as (select phrase, ' ' || {key_sql("phrase")} || ' ' as k, {tokens_sql("phrase")} as tk from ph), ps as (select phrase, k, list_distinct({stem_sql("tk")}) as st from pk),
rk as (select wt.doc_id, wt.phrase, weight, k, st, row_number() over (partition by wt.doc_id order by weight desc, spread desc, wt.phrase) as r from wt join ps on ps.phrase = wt.phrase), ls as (select doc_id, list([{{'phrase': phrase, 'weight': weight, 'k': k, 'st': st}}] order by r) as xs from rk group by doc_id),
kp as (select doc_id, list_reduce(xs, lambda a, x: case when len(a) >= {X.CONCEPTS} or len(list_filter(a, lambda y: contains(y.k, x[1].k) or contains(x[1].k, y.k) or len(list_intersect(y.st, x[1].st)) >= 2)) > 0 then a else list_concat(a, x) end) as ks from ls)"""


@query(_concept_sql(", " + _BEST + " select doc_id, cast(n as int) as rank, ks[n].phrase as phrase, ks[n].weight as weight from (select doc_id, ks, unnest(range(1, len(ks) + 1)) as n from kp)"))
def concepts_top12(spark, sf_dir):
    return understanding.top_concepts(understanding.line_sections(table(spark, sf_dir, "documents")))


_CUES = {k: " + ".join(f"case when regexp_matches(b, '{p.replace(chr(39), chr(39) * 2)}') then {w} else 0 end" for kk, _, w, p in X.ARCHETYPE_CUES if kk == k) for k in ("resume", "research", "invoice")}


@query(rf"""with b as (select doc_id, left(array_to_string(list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: trim(x) <> '')[1:80], chr(10)), 4000) as b from documents),
s as (select doc_id, {", ".join(f"cast({v} as int) as {k}" for k, v in _CUES.items())} from b), r as (select *, list_sort([resume, research, invoice], 'DESC') as o from s),
a as (select *, case when o[1] < 10 or o[1] - o[2] < 4 then 'generic' when resume = o[1] then 'resume' when research = o[1] then 'research' else 'invoice' end as archetype from r)
select doc_id, resume, research, invoice, archetype, case archetype when 'generic' then 'Generic Knowledge' when 'resume' then 'Resume' when 'research' then 'Research' else 'Invoice' end as label, case archetype when 'invoice' then 'obligation_deadlines' else 'narrative_sequence' end as timeline_mode from a""")
def archetype_scores(spark, sf_dir):
    return understanding.archetypes(table(spark, sf_dir, "documents"))


@query(rf"""with {SENTENCES}, n as (select doc_id, count(*) as n, count(*) filter (regexp_matches(s, '{X.INTENT_IMPERATIVE.replace(chr(39), chr(39) * 2)}')) as i from t group by doc_id),
m as (select doc_id, count(*) as n, count(*) filter (regexp_matches(line, '{X.INTENT_MEASURED}')) as m, count(*) filter (regexp_matches(line, '{X.INTENT_SEQUENCED}')) as q from l where trim(line) <> '' group by doc_id),
f as (select d.doc_id, coalesce(n.i / greatest(n.n, 1), 0) >= 0.22 as instructional, coalesce(m.m / greatest(m.n, 1), 0) >= 0.18 as measured, coalesce(m.q / greatest(m.n, 1), 0) >= 0.12 as sequenced from documents d left join n using (doc_id) left join m using (doc_id)),
k as (select *, case when instructional and sequenced then 'guide' when instructional then 'spec' when measured then 'review' when sequenced then 'plan' else 'notes' end as intent from f)
select *, case intent when 'guide' then 'walks through' when 'spec' then 'pins down' when 'review' then 'takes stock of' when 'plan' then 'lays out' else 'records' end as verb from k""")
def intent_flags(spark, sf_dir):
    return understanding.intents(table(spark, sf_dir, "documents"))


@query(r"""select doc_id, cast(octet_length(encode(coalesce(text, ''))) as bigint) as byte_length, case when trim(coalesce(text, ''), e' \t\n\r') = '' then 'empty' when regexp_matches(ltrim(text, e' \t\n\r'), '^[\{\[]') then 'json' else 'text' end as format,
case when trim(coalesce(text, ''), e' \t\n\r') = '' then 'input.empty' when octet_length(encode(text)) > 1048576 then 'input.too-large' else 'ok' end as code from documents""")
def preflight_stats(spark, sf_dir):
    out = sources.preflight(table(spark, sf_dir, "documents"), "text")
    return out.select("doc_id", "byte_length", "format", F.coalesce(F.get(F.col("diagnostics")["code"], F.lit(0)), F.lit("ok")).alias("code"))


@query("select format, count(*) as n from (select case when regexp_matches(ltrim(coalesce(html, ''), e' \\t\\n\\r'), '^[\\{\\[]') then 'json' when trim(coalesce(html, ''), e' \\t\\n\\r') = '' then 'empty' else 'text' end as format from pages) group by format")
def route_format(spark, sf_dir):
    return table(spark, sf_dir, "pages").groupBy(sources.detect_format(F.col("html")).alias("format")).agg(F.count("*").alias("n"))


@query(r"select fingerprint, count(*) as n, min(doc_id) as first_doc from (select doc_id, sha256(trim(nfc_normalize(regexp_replace(text, '\r\n?', chr(10), 'g')), e' \t\n\r\x0b\x0c')) as fingerprint from documents where text is not null) group by fingerprint")
def fingerprint_groups(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").where("text is not null").select("doc_id", sources.fingerprint(F.col("text")).alias("fingerprint"))
    return rows.groupBy("fingerprint").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_doc"))


@query(r"select page_id, trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)) as title from pages")
def page_titles(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", library.html_title(F.col("html")).alias("title"))


@query("with t as (select *, row_number() over (partition by user_id, event_type order by ts desc, event_id desc) as n from events where ts > (select max(ts) from events) - interval 7 day), r as (select *, row_number() over (partition by user_id order by ts desc, event_id desc) as rank from t where n = 1) select event_id, user_id, event_type, cast(rank as int) as rank from r where rank <= 24")
def library_recent(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    now = events.agg(F.max("ts").alias("now"))  # one row
    rows = events.withColumn("id", F.col("event_id")).join(F.broadcast(now))
    return library.recent(rows, F.col("now"), key="event_type", at="ts", owner="user_id").select("event_id", "user_id", "event_type", "rank")


@query("select conv_id, role, count(*) as n_lines, cast(sum(len(list_filter(regexp_split_to_array(coalesce(text, ''), '\\s+'), lambda x: x <> ''))) as bigint) as n_words from (select conv_id, role, unnest(string_split(coalesce(text, ''), chr(10))) as text from conversations) group by conv_id, role")
def conversation_sections(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select("conv_id", "role", F.explode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("line"))
    words = F.size(F.array_remove(F.split("line", r"\s+"), ""))
    return rows.groupBy("conv_id", "role").agg(F.count("*").alias("n_lines"), F.sum(words).alias("n_words"))


@query(rf"""with l as (select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as line from documents), k as (select doc_id, trim(line) as line from l where trim(line) <> ''),
s as (select doc_id, count(*) as total, count(*) filter (regexp_matches(line, '{X.RULE_LINE.replace(chr(39), chr(39) * 2)}')) as rules, count(*) filter (regexp_matches(line, '{X.RISK_LINE}')) as risks, count(*) filter (regexp_matches(line, '{X.MEASURED_LINE}')) as measured from k group by doc_id)
select *, case when total < 2 then null when risks / total >= 0.4 then 'risks' when measured / total >= 0.5 then 'signals' when rules / total >= 0.5 then 'decisions' end as shape_kind from s""")
def corpus_shapes(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", F.filter(F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x: F.trim(x)), lambda x: x != "").alias("l")).where("size(l) > 0")
    n = lambda p: F.size(F.filter("l", lambda x: matches(x, p))).cast("long")
    out = rows.select("doc_id", F.size("l").cast("long").alias("total"), n(X.RULE_LINE).alias("rules"), n(X.RISK_LINE).alias("risks"), n(X.MEASURED_LINE).alias("measured"))
    share = lambda c: F.col(c) / F.col("total")
    return out.withColumn("shape_kind", F.when(F.col("total") >= 2, F.when(share("risks") >= 0.4, "risks").when(share("measured") >= 0.5, "signals").when(share("rules") >= 0.5, "decisions")))


@query(r"""with w as (select 'a' as side, item_id as id, list_distinct(list_filter(regexp_split_to_array(regexp_replace(lower(coalesce(text, '')), '[^a-z0-9\s%-]', ' ', 'g'), '\s+'), lambda x: length(x) >= 4)) as ws from benchmark union all
select 'b', doc_id, list_distinct(list_filter(regexp_split_to_array(regexp_replace(lower(coalesce(text, '')), '[^a-z0-9\s%-]', ' ', 'g'), '\s+'), lambda x: length(x) >= 4)) from documents),
x as (select side, id, len(ws) as n, unnest(ws) as w from w), p as (select a.id as item_id, b.id as doc_id, count(*) as shared, any_value(a.n) as na, any_value(b.n) as nb from x a join x b on a.w = b.w and a.side = 'a' and b.side = 'b' group by all),
j as (select *, round(shared / (na + nb - shared), 6) as jaccard from p), t as (select *, row_number() over (partition by item_id order by jaccard desc, doc_id) as r from j) select item_id, doc_id, shared, jaccard from t where r = 1""")
def doc_overlap(spark, sf_dir):
    """For each benchmark item the document whose words are most like it."""
    return library.overlaps(table(spark, sf_dir, "benchmark"), table(spark, sf_dir, "documents"))


@query("select doc_id, " + " + ".join(f"len(regexp_extract_all(t, {quoted([p])}))" for p in library.ARTEFACTS) + f" as artefacts, cast(len(regexp_extract_all(t, {quoted([library.BROKEN_WORDS])})) as bigint) as broken_words, cast(len(regexp_extract_all(t, {quoted([library.HALF_SENTENCES])})) as bigint) as half_sentences, regexp_matches(t, {quoted([library.REFERENCE_HEADING])}) as has_references, length(t) as chars from (select doc_id, coalesce(text, '') as t from documents)")
def markdown_noise(spark, sf_dir):
    """What a converter left behind in every document."""
    return table(spark, sf_dir, "documents").select("doc_id", *[c.alias(k) for k, c in library.noise(F.coalesce("text", F.lit(""))).items()])


@query("with b as (select lang, source, count(*) as n from documents where doc_id % 2 = 0 group by all), a as (select lang, source, count(*) as n from documents where doc_id % 2 = 1 group by all) select lang, source, coalesce(b.n, 0) as before, coalesce(a.n, 0) as after, coalesce(a.n, 0) - coalesce(b.n, 0) as delta, abs(coalesce(a.n, 0) - coalesce(b.n, 0)) >= 3 as flagged from b full join a using (lang, source)")
def compare_counts(spark, sf_dir):
    """Counts by language and source of two halves of the corpus, compared."""
    rows = table(spark, sf_dir, "documents").groupBy("lang", "source", (F.col("doc_id") % 2).alias("half")).agg(F.count("*").alias("n"))
    return library.changes(rows.where("half = 0"), rows.where("half = 1"), ["lang", "source"])


@query(r"select event_id, json_extract_string(props, '$.' || k) as value, k as field from events, (values ('page'), ('ref'), ('k'), ('v')) x(k) where json_extract_string(props, '$.' || k) is not null")
def event_props(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_id", "props", F.explode(F.array(*[F.lit(k) for k in ("page", "ref", "k", "v")])).alias("field"))
    value = F.coalesce(*[F.when(F.col("field") == k, F.get_json_object("props", f"$.{k}")) for k in ("page", "ref", "k", "v")])
    return rows.select("event_id", value.alias("value"), "field").where(F.col("value").isNotNull())


@query("select doc_id, normalized, count(*) as n from (select doc_id, trim(regexp_replace(lower(line), '[^a-z0-9]+', ' ', 'g')) as normalized from (select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as line from documents)) where normalized <> '' group by all having count(*) > 1")
def repeated_lines(spark, sf_dir):
    rows = statements.lines(table(spark, sf_dir, "documents")).select("doc_id", normalize_key(F.col("line")).alias("normalized")).where("normalized <> ''")
    return rows.groupBy("doc_id", "normalized").agg(F.count("*").alias("n")).where("n > 1")


@query()
def corpus_segments(spark, sf_dir):
    """Segments of every document."""
    return structure.segments(table(spark, sf_dir, "documents"))

"""Queries over single statements and small lists of entries, with SQL over the same values."""

from __future__ import annotations

from pyspark.sql import functions as F

from marginalia.functions import fixed as X
from marginalia.functions import text as T
from marginalia.operators import judgement as J
from marginalia.operators import library
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


def quote(value) -> str:
    return "null" if value is None else str(value).lower() if isinstance(value, bool | int) else "'" + value.replace("'", "''") + "'"


def values(name: str, columns: str, rows) -> str:
    return f"{name}({columns}) as (values " + ", ".join("(" + ", ".join(map(quote, r)) + ")" for r in rows) + ")"


# --- SQL of the text functions ------------------------------------------------------------------------------------------
_STOP = ", ".join(map(quote, X.STOPWORDS))


def words(x: str) -> str:
    return rf"len(regexp_split_to_array(trim({x}), '\s+'))"


def bare(x: str) -> str:
    return f"trim(regexp_replace(trim({x}), '[.;,]+$', ''))"


def key(x: str) -> str:
    return f"trim(regexp_replace(lower({x}), '[^a-z0-9]+', ' ', 'g'))"


def fragment(x: str) -> str:
    return rf"({bare(x)} = '' or {words(bare(x))} < 2 or regexp_matches({bare(x)}, {quote(X.DANGLING)}))"


def tokens(x: str) -> str:
    return rf"list_filter(list_transform(regexp_split_to_array(regexp_replace(lower({x}), '[''’]s\b', '', 'g'), '[^a-z0-9+#.]+'), lambda w: regexp_replace(w, '^\.+|\.+$', '', 'g')), lambda w: length(w) >= 3 and w not in ({_STOP}) and not regexp_matches(w, '^\d+$'))"


def clamp(x: str, n: int) -> str:
    return rf"case when {words(x)} <= {n} then trim({x}) else regexp_replace(array_to_string(regexp_split_to_array(trim({x}), '\s+')[1:{n}], ' '), '[,;:]$', '') || '...' end"


def capital(x: str) -> str:
    return f"upper(left(trim({x}), 1)) || substr(trim({x}), 2)"


def stem_list(x: str) -> str:
    cut = "case when length(w) <= 4 then w " + " ".join(f"when w like '%{s}' and length(w) >= {len(s) + 3} then left(w, length(w) - {len(s)})" for s in X.SUFFIXES) + " else w end"
    return f"list_transform({x}, lambda w: case when length(w) > 4 and ({cut}) like '%e' and length({cut}) > 4 then left(({cut}), length({cut}) - 1) else ({cut}) end)"


# --- forms of phrases ---------------------------------------------------------------------------------------------------
PHRASES = (
    "The objective is to", "keep the gates at the north pier open, even when ferries are late and staff is short", "We will retire the old form.", "ETA", "", "  NASA gates  ", "iPhone readers fail at the pier; we might lease spare ones for the season of ferries",
    "McKay runs the pier", "done: refund desk shipped;", "ready to start <now> & \"soon\" isn't it", "Could move refunds to chat - perhaps in spring when the teams at all of the", "Use the", "one", "always check the reader, then the gate, then the pier and the", "Decision: lease gates",
)
_P = "with " + told_sql("p", "n, t", list(enumerate(PHRASES)))
_HEAD = r"array_to_string(ws[1:6], ' ')"
_LAST = "greatest(" + ", ".join(f"case when contains(head, '{m}') then length(head) - strpos(reverse(head), '{m[::-1]}') - {len(m)} + 1 else -1 end" for m in (",", " - ", ";")) + ")"


@query(
    _P
    + rf""", w as (select n, t, {bare("t")} as flat, regexp_split_to_array({bare("t")}, '\s+') as ws from p), h as (select *, {_HEAD} as head from w), k as (select *, case when {_LAST} > length(head) * 0.5 then left(head, cast({_LAST} as int)) else head end as kept from h),
s as (select *, regexp_split_to_array(kept, '\s+') as kw from k), f as (select *, list_filter(list_reverse(range(1, len(kw) + 1)), lambda m: m <= 2 or {fragment("array_to_string(kw[1:m], ' ')")})[1] as dummy, list_filter(list_reverse(range(1, len(kw) + 1)), lambda m: m <= 2 or not {fragment("array_to_string(kw[1:m], ' ')")})[1] as best from s)
select n, {fragment("t")} as fragment, cast(case when trim(t) = '' then 0 else {words("t")} end as int) as words, {clamp("t", 5)} as clamped, case when len(ws) <= 6 then flat else {bare("array_to_string(kw[1:best], ' ')")} end as shortened, {capital("t")} as capital,
  case when (length(regexp_extract(trim(t), '^\S*')) > 1 and regexp_extract(trim(t), '^\S*') = upper(regexp_extract(trim(t), '^\S*'))) or regexp_matches(regexp_extract(trim(t), '^\S*'), '^[A-Z][a-z]+[A-Z]') then trim(t) else lower(left(trim(t), 1)) || substr(trim(t), 2) end as decapital,
  replace(replace(replace(replace(replace(t, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#39;') as escaped,
  case when regexp_matches(t, {quote(X.CONSIDERED)}) then 'considered' when regexp_matches(t, {quote(X.COMMITTED)}) or regexp_matches(trim(t), {quote(X.IMPERATIVE)}) then 'committed' else 'considered' end as commitment,
  case when regexp_matches(t, {quote(X.FINISHED)}) then 'done' when regexp_matches(t, {quote(X.READY)}) then 'ready' when regexp_matches(t, {quote(X.CONSIDERED)}) then 'suggested' else 'pending' end as readiness from f"""
)
def text_forms(spark, sf_dir):
    """Phrases as they are shortened, cased, escaped and judged."""
    t = F.col("t")
    rows = told(spark, sf_dir, list(enumerate(PHRASES)), "n int, t string")
    return rows.select("n", T.reads_as_fragment(t).alias("fragment"), T.word_count(t).alias("words"), T.clamp_words(t, 5).alias("clamped"), T.shorten(t, 6).alias("shortened"), T.sentence_case(t).alias("capital"), T.decapitalize(t).alias("decapital"), library.html_escape(t).alias("escaped"), T.read_commitment(t).alias("commitment"), T.infer_readiness(t).alias("readiness"))


@query("with l as (select r_regionkey as k, list(n_name order by n_name) as ns from region join nation on n_regionkey = r_regionkey group by all) select k, array_to_string(ns[1:len(ns) - 1], ', ') || ' and ' || ns[len(ns)] as names, ['no', 'one', 'two', 'three', 'four', 'five', 'six', 'seven', 'eight', 'nine', 'ten', 'eleven', 'twelve'][len(ns) + 1] as spelled, cast(k * 7 as varchar) as far from l where len(ns) > 1")
def spoken_lists(spark, sf_dir):
    """Lists and counts as a person says them."""
    rows = spark.read.parquet(f"{sf_dir}/nation.parquet").groupBy(F.col("n_regionkey").alias("k")).agg(F.array_sort(F.collect_list("n_name")).alias("ns"))
    return rows.select("k", T.speak_list(F.col("ns")).alias("names"), T.spell_count(F.size("ns")).alias("spelled"), (F.col("k") * 7).cast("string").alias("far"))


# --- decisions ----------------------------------------------------------------------------------------------------------
PAIRS = (
    ("'Opened on' dates visible in gate list views", "Opened on dates visible in gate list view"), ("Auto-increment revision numbers (r1, r2)", "Revision number auto-increments with each edit (r1, r2, r3)"), ("Preserve linked advances during gate edits", "Linked advances remain intact after edits"),
    ("Approval workflow for late changes (configurable)", "Edits trigger configurable approval workflow"), ("Auto-increment revision numbers for each order", "PDF export shows the revision number of each order"), ("Keep manual gates at the north pier", "Lease spare readers for the south pier"),
    ("Business Impact", "Priority"), ("Keep gates open", "Keep gates open during ferry boarding"), ("", "Keep gates"), ("Edit history with editor name for each order", "Complete edit history for the order"),
)
_REWRITTEN = "lower({x})"
for _p, _to in X.DECISION_REWRITES:
    _REWRITTEN = f"regexp_replace({_REWRITTEN}, {quote(_p)}, {quote(_to)}, 'g')"
_REWRITTEN = f"trim({_REWRITTEN})"
_ANCHORS = "list_filter([" + ", ".join(map(quote, X.DECISION_ANCHORS)) + "], lambda a: contains({x}, a))"


@query(
    "with "
    + told_sql("p", "n, a, b", [(i, *x) for i, x in enumerate(PAIRS)])
    + f""", d as (select *, {_REWRITTEN.replace("{x}", "a")} as na, {_REWRITTEN.replace("{x}", "b")} as nb from p), e as (select *, list_distinct({tokens("a")}) as ta, list_distinct({tokens("b")}) as tb, {tokens("na")} as ca, {tokens("nb")} as cb, {_ANCHORS.replace("{x}", "na")} as aa, {_ANCHORS.replace("{x}", "nb")} as ab from d),
f as (select *, list_distinct({stem_list("ca")}) as sa, list_distinct({stem_list("cb")}) as sb from e), g as (select *, len(list_intersect(sa, sb)) as shared, least(len(sa), len(sb)) as small, len(list_intersect(aa, ab)) as joint from f)
select n, na as rewritten, {key("a")} = '' or regexp_matches({key("a")}, {quote(X.DECISION_CHROME)}) as chrome, {key("a")} = {key("b")} or (len(ta) > 0 and len(tb) > 0 and len(list_intersect(ta, tb)) / len(list_distinct(list_concat(ta, tb))) >= 0.72) or (na <> '' and nb <> '' and (na = nb
  or ((contains(na, nb) or contains(nb, na)) and case when length(na) <= length(nb) then len(ca) else len(cb) end >= 3) or (small > 0 and ((shared >= 3 and shared / small >= 0.62) or (joint > 0 and not (len(aa) > joint and len(ab) > joint) and shared >= 2 and shared / small >= 0.45))))) as same from g"""
)
def decision_pairs(spark, sf_dir):
    """Which two decisions say the same."""
    rows = told(spark, sf_dir, [(i, *x) for i, x in enumerate(PAIRS)], "n int, a string, b string")
    same = T.let_all(lambda p: F.struct(p["a"]["text"].alias("rewritten"), J.same_decision(p["a"], p["b"]).alias("same")), a=J.decision_parts(F.col("a")), b=J.decision_parts(F.col("b")))
    return rows.select("n", same.alias("s"), J.is_chrome(F.col("a")).alias("chrome")).select("n", "s.rewritten", "chrome", "s.same")


STATEMENTS = (
    ("Phase 2 ships the readers", None), ("The blocker is a missing lease (high)", None), ("Gates must survive a risk of flooding", None), ("Draft the lease for the readers", None), ("Mara Holt - Aug 15", None), ("Every order must carry an edit history", "Key requirements"),
    ("Gates cannot read old tickets", None), ("We have decided that gates cannot close early", None), ("Refund calls keep growing", "Pain points"), ("We approved the lease", "Problem"), ("", None), ("The pier team likes blue gates", "Notes"),
    ("The key bottleneck is not staff but readers because the old ones fail in the rain", "Why"), ("Email the invoice total to the desk because the tax is due and cannot wait any longer", None), ("Trust in the audit trail means the team can recall every single decision about gates", "Strategy"),
    ("Readers at the pier are cheap, although the workflow around them is the constraint for every gate", "Insight"),
)
_S = "with " + told_sql("s", "n, t, title", [(i, *x) for i, x in enumerate(STATEMENTS)])
_STRONG = f"case when regexp_matches(trim(t), {quote(X.PHASE_SHAPE)}) then 'requirement' when regexp_matches(t, {quote(X.RISK_SHAPE)}) and (regexp_matches(t, {quote(X.GRADED_RISK)}) or not regexp_matches(t, {quote(X.REQUIREMENT_SHAPE)})) then 'risk' when regexp_matches(trim(t), {quote(X.ACTION_SHAPE)}) or regexp_matches(t, {quote(X.ACTION_META)}) then 'action' when regexp_matches(t, {quote(X.REQUIREMENT_SHAPE)}) then 'requirement' end"


def _statements(spark, sf_dir):
    return told(spark, sf_dir, [(i, *x) for i, x in enumerate(STATEMENTS)], "n int, t string, title string")


@query(
    _S
    + f""", c as (select n, {_STRONG} as category, regexp_matches(trim(t), {quote(X.PHASE_SHAPE)}) as phase, regexp_matches(t, {quote(X.EXPLICIT_COMMITMENT)}) as commits, coalesce(regexp_matches(title, {quote(X.PROBLEM_TITLE)}), false) or (regexp_matches(t, {quote(X.CANNOT)}) and not regexp_matches(t, {quote(X.EXPLICIT_COMMITMENT)})) as problem,
regexp_matches(t, {quote(X.REQUIREMENT_RULE)}) as rule, regexp_matches(t, {quote(X.LESSON)}) as lesson, regexp_matches(t, {quote(X.LEVERAGE)}) as leverage from s)
select n, category, phase or coalesce(category in ('risk', 'action'), false) as blocked, commits, problem, not problem and commits as slide_decides, rule, lesson, leverage from c"""
)
def category_precedence(spark, sf_dir):
    """What a statement is before it can be a decision."""
    t, title = F.col("t"), F.col("title")
    return _statements(spark, sf_dir).select("n", J.strongest_category(t).alias("category"), J.blocks_decision(t).alias("blocked"), J.commits(t).alias("commits"), J.is_problem(t, title).alias("problem"), J.slide_decides(t, title).alias("slide_decides"), T.matches(t, X.REQUIREMENT_RULE).alias("rule"), T.matches(t, X.LESSON).alias("lesson"), T.matches(t, X.LEVERAGE).alias("leverage"))


CONCEPTS = ("audit trail", "readers", "gates")
_LIST = "[" + ", ".join(map(quote, CONCEPTS)) + "]"
_SAID = "case " + " ".join(f"when regexp_matches(u, {quote(p)}) then {capital(quote(a) + ' || ' + '(' + clamp(f'regexp_extract(u, {quote(p)}, 1)', n) + ') || ' + quote(b) + ' || (' + clamp(f'regexp_extract(u, {quote(p)}, 2)', m) + ')')}" for p, a, n, b, m in X.IMPLICATIONS) + f" else {capital('(' + clamp('u', 26) + ')')} end"


@query(
    _S
    + f""", u as (select n, title, {bare("t")} as u from s), c as (select *, case when regexp_matches(u, {quote(X.LEVERAGE)}) then 5 else 0 end + case when regexp_matches(u, {quote(X.PHILOSOPHY)}) then 3 else 0 end + case when regexp_matches(u, {quote(X.NEGATED)}) then 2 else 0 end + case when regexp_matches(u, {quote(X.DECISIVE)}) then 2 else 0 end
 + least(4, len(list_filter({_LIST}, lambda c: contains(lower(u), c)))) + case when coalesce(regexp_matches(title, {quote(X.INSIGHT_TITLE)}), false) then 2 else 0 end as points from u where {words("u")} between 8 and 42 and not regexp_matches(u, {quote(X.EXTRACTIVE)}))
select n, cast(points as int) as score, {_SAID} as implication from c where points >= 6"""
)
def insight_scores(spark, sf_dir):
    """Statements that carry an insight, and what they mean."""
    t = F.col("t")
    rows = _statements(spark, sf_dir).withColumn("score", J.insight_score(t, F.col("title"), T.words_in(CONCEPTS))).where("score is not null")
    return rows.select("n", F.col("score").cast("int").alias("score"), J.implication(T.unpunctuated(t)).alias("implication"))


@query(_S + f" select n, coalesce(list_filter({_LIST}, lambda c: contains({key('t')}, c))[1], array_to_string(({tokens('t')})[1:6], ' ')) as label from s")
def concept_labels(spark, sf_dir):
    """The heaviest concept that a statement names, else its first content words."""
    return _statements(spark, sf_dir).select("n", J.concept_of(F.col("t"), T.words_in(CONCEPTS)).alias("label"))


ACTIONS = ((1, 0, "Sign the gate reader lease", None), (1, 1, "Survey the north pier gates", "D-9"), (1, 2, "Keep the manual gates at the north pier", None), (1, 3, "Paint the pier", None), (2, 0, "Sign the gate reader lease", None))
DECISIONS = ((1, 0, "Keep manual gates at the north pier", "D-1"), (1, 1, "sign the gate-reader lease!", None), (1, 2, "Sign the gate reader lease", "D-3"))


@query(
    "with "
    + told_sql("a", "doc_id, idx, task, source", ACTIONS)
    + ", "
    + told_sql("d", "doc_id, idx, text, ref", DECISIONS)
    + f""", p as (select a.doc_id, a.idx, coalesce(d.ref, d.text) as name, d.idx as di, list_distinct({tokens("task")}) as x, list_distinct({tokens("text")}) as y, {key("task")} = {key("text")} as equal from a join d using (doc_id) where source is null),
b as (select doc_id, idx, arg_min(name, di) as name from p where equal or (len(x) > 0 and len(y) > 0 and len(list_intersect(x, y)) / len(list_distinct(list_concat(x, y))) >= 0.72) group by all) select a.doc_id, a.idx, coalesce(source, name) as source from a left join b using (doc_id, idx)"""
)
def actions_linked(spark, sf_dir):
    """The decision that an action carries out."""
    a = told(spark, sf_dir, list(ACTIONS), "doc_id int, idx int, task string, source string")
    return J.linked_actions(a, told(spark, sf_dir, list(DECISIONS), "doc_id int, idx int, text string, ref string"))


# --- dates --------------------------------------------------------------------------------------------------------------
NOTES = ((1, "Plan as of March 3, 2026 for the pier", "plan-2026-04-01.md"), (2, "Notes without a stated day", "notes_20260511.txt"), (3, "We met on 2026-02-03 and on May 5, 2026", "notes.txt"), (4, "Nothing here", None), (5, "Date: 12/03/2026 on the pier", None))


@query(
    "with "
    + told_sql("n", "doc_id, text, label", NOTES)
    + rf""", x as (select doc_id, nullif(regexp_extract(text, {quote(X.EXPLICIT_ANCHOR)}, 1), '') as e, nullif(regexp_extract(coalesce(label, ''), {quote(X.FILE_DATE)}, 1), '') as f, nullif(regexp_extract(text, {quote(X.FULL_DATE)}, 1), '') as b from n)
select doc_id, coalesce(trim(e), case when length(f) = 8 then f[1:4] || '-' || f[5:6] || '-' || f[7:8] else f end, b) as value, case when e is not null then 'high' when coalesce(f, b) is not null then 'medium' else 'none' end as confidence, case when e is not null then 'explicit' when f is not null then 'filename' when b is not null then 'body' else 'none' end as source from x"""
)
def anchor_dates(spark, sf_dir):
    """The date that a document stands on."""
    rows = told(spark, sf_dir, list(NOTES), "doc_id int, text string, label string")
    return rows.select("doc_id", J.anchor(F.col("text"), F.col("label")).alias("a")).select("doc_id", "a.*")


OWED = ("Due date: 2026-08-14", "Due: next month", "Dated May 5, 2026", "Payment due - soon", "Effective date: on signature", "Nothing owed", "Due date", "As of Q3 2026")


@query(
    "with "
    + told_sql("o", "n, t", list(enumerate(OWED)))
    + rf""", r as (select n, trim(regexp_extract(t, {quote(X.OBLIGATION)}, 2)) as r from o), d as (select n, coalesce(trim(regexp_replace(nullif(regexp_extract(r, {quote(X.DATE_ANYWHERE)}, 1), ''), '\.$', '')), case when regexp_matches(r, {quote(X.DATE_AT_START)}) then r end) as d from r)
select n, case when d is null then 'none' when regexp_matches(d, '^\d{{4}}-\d{{2}}-\d{{2}}') then 'high' when regexp_matches(d, {quote(X.DATE_AT_START)}) and regexp_matches(d, {quote(X.DATE_ANYWHERE)}) then 'medium' when lower(d) in ('soon', 'eventually', 'asap', 'tbd', 'tba') then 'none' else 'low' end as confidence from d"""
)
def obligation_confidence(spark, sf_dir):
    """How sure the date of an obligation is."""
    return told(spark, sf_dir, list(enumerate(OWED)), "n int, t string").select("n", J.obligation_confidence(F.col("t")).alias("confidence"))


TIMELINE = (
    *((1, i, d, t, "narrative_sequence", False) for i, (d, t) in enumerate((("2026-05-01", "Launch"), ("next week", "Desk"), ("May", "Survey"), ("GATE-12", "Ticket"), ("Phase 2", "Readers")))),
    *((2, i, d, t, "none", True) for i, (d, t) in enumerate((("2026-05-01", "Open"), ("soon", "Menu"), ("Q3", "Season"), ("Step A", "Order"), ("May", "Spring")))),
    *((3, i, d, t, "single_leg", False) for i, (d, t) in enumerate((("2026-05-01", "Hotel"), ("2026-05-02", "Arrival in Oslo"), ("2026-05-01", "Departure from Aarhus"), ("2026-05-09", "Departure from Oslo")))),
    *((4, i, d, t, "single_leg", False) for i, (d, t) in enumerate((("2026-05-01", "Hotel"), ("2026-05-02", "Departs at nine"), ("2026-05-03", "Departs again")))),
    *((5, i, d, t, "obligation_deadlines", False) for i, (d, t) in enumerate((("2026-05-01", "Pay"), ("INV-7", "Invoice"), ("tomorrow", "Call")))),
)


@query(
    "with "
    + told_sql("t", "doc_id, idx, date, title, mode, suppress", TIMELINE)
    + rf""", m as (select *, regexp_matches(date, {quote(X.RELATIVE_DATE)}) as relative, regexp_matches(date, {quote(X.TICKET_ID)}) or regexp_matches(date, {quote(X.PHASE_ORDINAL)}) as marker, case when regexp_matches(title, '(?i)\bdepart') then 'd' when regexp_matches(title, '(?i)\barriv') then 'a' end as leg from t),
f as (select *, leg is not null and row_number() over (partition by doc_id, leg order by idx) = 1 as first from m), g as (select *, row_number() over (partition by doc_id order by case when first then 0 when leg is not null then 1 else 2 end, idx) as place from f),
k as (select *, case when mode = 'single_leg' then first or (leg is not null and place <= 2) when mode = 'none' and suppress then not marker and not relative and regexp_matches(date, {quote(X.HARD_DATE)}) when marker then mode in ('milestone_chain', 'narrative_sequence') when relative then not suppress and mode <> 'none' when regexp_matches(date, {quote(X.MONTH_ALONE)}) then not suppress else true end as kept from g)
select doc_id, idx, kept, case when not kept then date || ': ' || title end as signal from k"""
)
def timeline_gate(spark, sf_dir):
    """Which timeline entries are honest; the others become signals."""
    rows = told(spark, sf_dir, list(TIMELINE), "doc_id int, idx int, date string, title string, mode string, suppress boolean")
    return J.gated_timeline(rows).select("doc_id", "idx", "kept", "signal")


# --- views --------------------------------------------------------------------------------------------------------------
BLOCKS = tuple((d, a, k, (d + i * 3) % 4 if d != 5 else 0) for d, a in ((1, "generic"), (2, "resume"), (3, "invoice"), (4, "research"), (5, "resume"), (6, "menu")) for i, k in enumerate(X.KINDS))
_TITLES = values("v", "view, kind, ord, title", [(a, k, i, t) for a, kinds in X.MEMORY_TITLES.items() for i, (k, t) in enumerate(kinds.items())])


@query("with " + told_sql("b", "doc_id, archetype, kind, n", BLOCKS) + ", " + _TITLES + ", x as (select *, case when archetype in ('resume', 'invoice', 'research') then archetype else 'generic' end as view from b) select x.doc_id, cast(row_number() over (partition by x.doc_id order by ord) as int) as place, x.kind, title from x join v on v.view = x.view and v.kind = x.kind where x.view = 'generic' or n > 0 or x.kind = 'snapshot'")
def memory_views(spark, sf_dir):
    """The memories that documents of each type show, with their titles."""
    return J.memory_views(told(spark, sf_dir, list(BLOCKS), "doc_id int, archetype string, kind string, n int"))


# --- recall -------------------------------------------------------------------------------------------------------------
_FIELDS = "doc_id, kind, idx, text, label, value, implication, consequence, severity, date, title, status, commitment"


def _entry(doc, kind, idx, text=None, **more):
    names = _FIELDS.split(", ")[4:]
    return (doc, kind, idx, text, *(more.get(n) for n in names))


RECALLED = (
    _entry(1, "decisions", 0, "P1 gates first", commitment="committed"), _entry(1, "decisions", 1, "Keep manual gates at the north pier", commitment="committed", status="approved"), _entry(1, "decisions", 2, "Every order must carry an audit trail", commitment="committed"), _entry(1, "decisions", 3, "Paint it", commitment="considered"),
    _entry(1, "risks", 0, "Readers arrive late", severity="low", consequence="queues at the gates"), _entry(1, "risks", 1, "Staff is short", severity="high"), _entry(1, "signals", 0, label="Queue", value="4 minutes", implication="Target"), _entry(1, "timeline", 0, date="GATE-12", title="x"), _entry(1, "timeline", 1, date="May", title="gate-12 again"), _entry(1, "timeline", 2, date="June", title="PIER-3 opens"),
    _entry(2, "actions", 0, "User story: I want to see every booking on one page", status="pending"), _entry(2, "actions", 1, "Close the old form", status="done"), *(_entry(2, "actions", 2 + i, f"Write the {x} part of the refund guide for the desk team", status="pending") for i, x in enumerate(("first", "second", "third", "fourth", "fifth"))), _entry(2, "signals", 0, label="Calls", value="812", implication="The desk is full on Mondays"),
    _entry(3, "decisions", 0, "Close early", commitment="considered"), _entry(3, "risks", 0, "Old readers fail", severity="high", consequence="long queues"), _entry(4, "timeline", 0, date="May", title="Opening"),
)
OPENINGS = ((1, "The harbour moves its tickets to new gates, and every pier is part of it."), (2, ""), (3, "Notes of the"), (4, "A quiet note about the pier in spring"), (5, None))


def _short(x: str, most: int) -> str:
    """SQL of `shorten` for texts that are cut at a word only."""
    cut = rf"regexp_split_to_array({bare(x)}, '\s+')"
    kept = f"list_filter(list_reverse(range(1, {most} + 1)), lambda m: m <= 2 or not {fragment(f'array_to_string(({cut})[1:m], chr(32))')})[1]"
    return f"case when {words(bare(x))} <= {most} then {bare(x)} else {bare(f'array_to_string(({cut})[1:{kept}], chr(32))')} end"


def _small(x: str) -> str:
    return f"case when (length(regexp_extract(trim({x}), '^\\S*')) > 1 and regexp_extract(trim({x}), '^\\S*') = upper(regexp_extract(trim({x}), '^\\S*'))) then trim({x}) else lower(left(trim({x}), 1)) || substr(trim({x}), 2) end"


_SPEAK = "case when len({0}) = 1 then {0}[1] else array_to_string({0}[1:len({0}) - 1], ', ') || ' and ' || {0}[len({0})] end"
_SPELLED = "(['no', 'one', 'two', 'three', 'four', 'five', 'six', 'seven'])[len({0}) + 1]"


@query(
    "with "
    + told_sql("e", _FIELDS, RECALLED)
    + ", "
    + told_sql("o", "doc_id, opening", OPENINGS)
    + rf""", de as (select doc_id, arg_min(text, (case when regexp_matches(text, {quote(X.GOAL_TERMS)}) then 0 else 1 end, idx)) as d from e where kind = 'decisions' and commitment = 'committed' and coalesce(status, '') <> 'rejected' and not regexp_matches(text, '(?i)^p\d\b') group by doc_id),
sy as (select doc_id, arg_min(text, idx) as st from e where kind = 'actions' and regexp_matches(text, '(?i)^user story:') group by doc_id), ri as (select doc_id, arg_min(text, (case when consequence is null then 1 else 0 end, case severity when 'high' then 1 when 'medium' then 2 when 'low' then 3 else 9 end, idx)) as r, arg_min(coalesce(consequence, ''), (case when consequence is null then 1 else 0 end, case severity when 'high' then 1 when 'medium' then 2 when 'low' then 3 else 9 end, idx)) as q from e where kind = 'risks' group by doc_id),
si as (select doc_id, arg_min(label, idx) as l, arg_min(coalesce(implication, ''), idx) as i from e where kind = 'signals' and value is not null and lower(label) <> 'open question' group by doc_id), re as (select doc_id, arg_min(text, idx) as x from e where kind = 'decisions' and regexp_matches(text, {quote(X.OUTCOME_TERMS)}) group by doc_id),
tk as (select doc_id, list(t order by f) as ts from (select doc_id, t, min(idx) as f from (select doc_id, idx, upper(coalesce(nullif(regexp_extract(date, {quote(X.TICKET)}, 1), ''), nullif(regexp_extract(title, {quote(X.TICKET)}, 1), ''))) as t from e where kind = 'timeline') where t is not null group by doc_id, t) group by doc_id),
ta as (select doc_id, list(text order by idx) as ws from e where kind = 'actions' and coalesce(status, '') <> 'done' and not regexp_matches(text, '(?i)^(persona|user story):') group by doc_id),
hr as (select doc_id, arg_min(text, (case when severity = 'high' then 0 else 1 end, idx)) as h from e where kind = 'risks' and consequence is not null group by doc_id), hd as (select doc_id, arg_min(text, (case when status = 'approved' then 0 else 1 end, idx)) as k from e where kind = 'decisions' and coalesce(commitment, '') <> 'considered' group by doc_id),
n as (select doc_id, sum(case kind when 'decisions' then 18 when 'risks' then 22 else 12 end) + 80 as w from e group by doc_id),
a as (select o.doc_id, trim(coalesce(opening, '')) as opening, d, regexp_replace(regexp_replace(st, '(?i)^user story:\s*', ''), '(?i)^i want (?:to\s+)?', '') as want, r, nullif(q, '') as q, l, nullif(i, '') as i, x, ts, ws, h, k, coalesce(w, 80) as w, list_transform(ws[1:4], lambda y: {_short("y", 8)}) as shown
  from o left join de using (doc_id) left join sy using (doc_id) left join ri using (doc_id) left join si using (doc_id) left join re using (doc_id) left join tk using (doc_id) left join ta using (doc_id) left join hr using (doc_id) left join hd using (doc_id) left join n using (doc_id)),
b as (select *, {_short("d", 18)} as ds, {_short("want", 18)} as wn, {_short("r || ', causing ' || q", 22)} as rq, {_short("r", 20)} as rs, {_short("l || ': ' || i", 18)} as li, {_short("x", 18)} as xs, {_short("h", 14)} as hs, {_short("k", 16)} as ks, {_short("opening", 22)} as op from a),
c as (select doc_id, opening, hs, ks, w, op, coalesce(case when not {fragment("ds")} then case when regexp_matches(ds, {quote(X.GOAL_VERB)}) then {capital("ds")} else 'Enable ' || {_small(capital("ds"))} end end, {capital("wn")}, '') as goal, coalesce({capital("rq")}, {capital("rs")}, '') as problem, coalesce(case when i is not null and i <> 'Target' then {capital("li")} end, {capital("xs")}, '') as outcome,
  case when len(ts) > 0 then 'Outstanding work (' || {_SPELLED.format("ts")} || '): ' || {_SPEAK.format("ts")} || '.' when len(ws) > 0 then 'Outstanding work (' || {_SPELLED.format("ws")} || '): ' || {_SPEAK.format("shown")} || case when len(ws) > 4 then ', +' || (len(ws) - 4) || ' more' else '' end || '.' else '' end as waiting from b),
d2 as (select *, case when opening <> '' then case when not {fragment("op")} then {capital("op")} end when goal <> '' then 'This document remembers ' || {_small("(" + _short("goal", 16) + ")")} || '.' end as start from c)
select doc_id, goal, problem, outcome, waiting, case when goal || problem || outcome <> '' then concat_ws(' ', start, nullif(waiting, '')) else {bare("opening")} end as summary, case when goal <> '' then 'Primary goal: ' || goal || '.' else coalesce('Primary problem: ' || {_small("hs")} || '.', 'Primary goal: ' || {_small("ks")} || '.', '') end as hook, cast(greatest(1, round(w / 230)) as int) as minutes from d2"""
)
def recall_parts(spark, sf_dir):
    """Goal, problem, outcome, outstanding work, summary and hook of each document."""
    from marginalia.operators import recall

    kinds = ", ".join(f"{n} {'int' if n in ('doc_id', 'idx') else 'string'}" for n in _FIELDS.split(", "))
    return recall.recalled(told(spark, sf_dir, list(RECALLED), kinds), told(spark, sf_dir, list(OPENINGS), "doc_id int, opening string"))


# --- relations ----------------------------------------------------------------------------------------------------------
_PARTS = "doc_id, kind, idx, text, label, value, implication, because, consequence, title, produces, requires, ref, source"


def _part(kind, idx, text=None, **more):
    return (1, kind, idx, text, *(more.get(n) for n in _PARTS.split(", ")[4:]))


MEMORIES = (
    _part("snapshot", 0, "Harbour"), _part("signals", 0, label="Open question", implication="Which gate readers should the north pier lease?"), _part("signals", 1, label="Queue time at gates", value="4 minutes", implication="Gate readers cut the queue"), _part("signals", 2, label="Slow readers", implication="Old gate readers delay every ferry launch"),
    _part("decisions", 0, "Lease spare gate readers for the north pier", ref="D-1"), _part("decisions", 1, "Keep manual gates at the pier"), _part("decisions", 2, "Paint the harbour desk"), _part("risks", 0, "Gate readers arrive late", because="The lease is not signed", consequence="The ferry launch slips"), _part("risks", 1, "Desk staff is short"),
    _part("actions", 0, "Sign it", source="d-1"), _part("actions", 1, "Paint the whole harbour desk"), _part("actions", 2, "Survey north pier gates", source="Keep manual gates at the pier"), _part("timeline", 0, title="Survey of north pier gates", produces="Pier gate map"), _part("timeline", 1, title="Install gate readers", requires="the pier gate map", produces="Tested gate readers"), _part("timeline", 2, title="Launch ferry gates", requires="tested gate readers"),
)
_ROLES = """ro as (
 select *, 1 as step, true as lefty, st as t from x where kind = 'signals' and asks union all select *, 1, false, text from x where kind = 'decisions' union all
 select *, 2, true, text from x where kind = 'decisions' union all select *, 2, false, st from x where kind = 'signals' and asks union all
 select *, 3, true, st from x where kind = 'signals' and not asks and value is not null union all select *, 3, false, text from x where kind = 'decisions' union all
 select *, 4, true, st from x where kind = 'signals' and not asks and value is null union all select *, 4, false, text from x where kind = 'decisions' union all
 select *, 5, true, st from x where kind = 'signals' union all select *, 5, false, rt from x where kind = 'risks' union all
 select *, 6, true, rt from x where kind = 'risks' union all select *, 6, false, text from x where kind = 'decisions' union all
 select *, 7, true, text from x where kind = 'decisions' union all select *, 7, false, rt from x where kind = 'risks' union all
 select *, 8, true, text from x where kind = 'actions' union all select *, 8, false, text from x where kind = 'decisions' union all
 select *, 9, true, tt from x where kind = 'timeline' union all select *, 9, false, text from x where kind = 'actions' union all
 select *, 10, true, requires from x where kind = 'timeline' and requires is not null union all select *, 10, false, produces from x where kind = 'timeline' and produces is not null)"""


def _steps(i: int) -> str:
    from marginalia.operators.relations import STEPS

    return "case step " + " ".join(f"when {k} then {quote(v[i])}" for k, v in STEPS.items()) + " end"


_RELATED = rf"""with {told_sql("m", _PARTS, MEMORIES)}, x as (select *, kind || ':' || idx as r, concat_ws(' ', label, value, implication) as st, concat_ws(' ', text, because, consequence) as rt, concat_ws(' ', title, produces) as tt, coalesce(lower(label) in ('open question', 'open questions'), false) as asks from m), {_ROLES},
tk as (select doc_id, step, lefty, r as ref_, idx, {tokens("t")} as w from ro), sm as (select *, list_distinct({stem_list("w")}) as s from tk),
pr as (select a.doc_id, a.step, a.ref_ as l, a.idx as li, b.ref_ as r, b.idx as ri, len(list_intersect(a.s, b.s)) as shared, least(len(a.s), len(b.s)) as small from sm a join sm b on a.doc_id = b.doc_id and a.step = b.step and a.lefty and not b.lefty and a.ref_ <> b.ref_),
rk as (select *, shared / small as score, row_number() over (partition by doc_id, step, l order by shared / small desc, ri) as rank from pr where shared >= 2 and shared / small >= 0.2)"""


@query(_RELATED + " select doc_id, step, l, r, round(score, 6) as score, cast(rank as int) as rank from rk")
def related_entries(spark, sf_dir):
    """Entries that share two stems and a fifth of the smaller set, ranked, for every step."""
    from marginalia.operators import relations as R

    rows = _memories(spark, sf_dir)
    parts = rows.select("doc_id", F.concat_ws(":", "kind", "idx").alias("ref"), "idx", F.explode(R.roles()).alias("x")).select("doc_id", "ref", "idx", "x.*")
    return R.related(parts).select("doc_id", "step", "l", "r", F.round("score", 6).alias("score"), "rank")


def _memories(spark, sf_dir):
    kinds = ", ".join(f"{n} {'int' if n in ('doc_id', 'idx') else 'string'}" for n in _PARTS.split(", "))
    return told(spark, sf_dir, list(MEMORIES), kinds)


@query(
    _RELATED
    + rf""", ky as (select doc_id, r, idx, unnest([{key("coalesce(ref, text)")}, {key("text")}]) as k from x where kind = 'decisions'), ex as (select a.doc_id, a.r as l, a.idx as li, arg_min(ky.r, ky.idx) as r from x a join ky on ky.doc_id = a.doc_id and ky.k = {key("a.source")} where a.kind = 'actions' and a.source is not null group by all),
al as (select doc_id, step, l, li, r, rank from rk where rank <= case when step in (8, 10) then 1 else 2 end and not (step = 8 and exists (select 1 from ex where ex.l = rk.l and ex.doc_id = rk.doc_id)) union all select doc_id, 8, l, li, r, 1 from ex),
ed as (select doc_id, step, li, rank, case when step = 10 then r else l end as f, case when step = 10 then l else r end as t, {_steps(0)} as relation, {_steps(1)} || case when step = 10 then (select title from x where x.r = al.l and x.doc_id = al.doc_id) else '' end as note from al
 union all select doc_id, 0, 0, 1, 'snapshot', k, 'frames', null from (select distinct doc_id, kind as k from x where kind <> 'snapshot')),
de as (select *, row_number() over (partition by doc_id, f, relation, t order by step, li, rank) as n from ed where f <> t) select doc_id, f as "from", t as "to", relation, note from de where n = 1"""
)
def relations_of_entries(spark, sf_dir):
    """Relations between the entries of a document, stated ones first, each once."""
    from marginalia.operators import relations as R
    from marginalia.runtime import stored

    return R.relations(stored(_memories(spark, sf_dir), "memories")).drop("ord")


@query(f"with {told_sql('m', _PARTS, MEMORIES)}, w as (select doc_id, kind, {tokens('text')} as t from m where text is not null) select doc_id, kind, stem, count(*) as n from (select doc_id, kind, unnest({stem_list('t')}) as stem from w) group by all")
def entry_stems(spark, sf_dir):
    """Stems of entries by kind."""
    return _memories(spark, sf_dir).where("text is not null").select("doc_id", "kind", F.explode(T.stem_tokens(F.col("text"))).alias("stem")).groupBy("doc_id", "kind", "stem").agg(F.count("*").alias("n"))


SUMMARIES = ((1, "Gates open at dawn on every pier", "Gates open at dawn on every pier."), (2, "The desk closes", "Gates open at dawn"), (3, "anything", " "))


@query("with " + told_sql("s", "n, a, b", SUMMARIES) + f", w as (select n, b, list_distinct({tokens('a')}) as x, list_distinct({tokens('b')}) as y from s) select n, trim(b) <> '' and len(x) > 0 and len(y) > 0 and len(list_intersect(x, y)) / len(list_distinct(list_concat(x, y))) >= 0.8 as copied from w")
def summary_copies(spark, sf_dir):
    """Summaries that are only the paragraph again."""
    from marginalia.operators import recall

    return told(spark, sf_dir, list(SUMMARIES), "n int, a string, b string").select("n", recall.copies(F.col("a"), F.col("b")).alias("copied"))


# --- forms of lines -----------------------------------------------------------------------------------------------------
FORMS = (
    "**Gate** launch: `north` pier - done", "* *Soft* rule", "Phase 2: Install gate readers - planned", "step b — Survey the pier", "| --- | :---: |", "---", "→", "✓ Passport packed", "- [x] Survey the gates (Jon Reed, Mar 3)", "1) Close the old form", "Refund rate: 3.1% (down 0.4 pts)",
    "The survey produces a map of every gate at the pier; it depends on the lease of the spare readers", "Only after you have the tested readers.", "Output: a list of old readers", "Harbour rollout plan", "Plan", "The desk - A guide: the pier | gates", "The gate desk is a small office built for refunds", "A pier is an", "word", "", "Deliverable — Tested gate readers for each pier of the harbour and of the river by May and June",
)


@query()
def line_forms(spark, sf_dir):
    """Lines as they are classified and cut: marks, steps, separators, suffixes, artefacts, subjects and purposes."""
    from marginalia.functions import lines as L
    from marginalia.operators import understanding as U

    t = F.col("t")
    rows = told(spark, sf_dir, list(enumerate(FORMS)), "n int, t string")
    rows = rows.select("n", "t", L.ordinal(t).alias("o"), L.first_separator(t).alias("p"), L.paren_suffix(t).alias("s"), L.trailing_keyword(t, L.TRAILING_STATE).alias("k"), *[c.alias(a) for c, a in zip(L.artifact(t), ("produces", "requires"), strict=True)])
    return rows.select("n", L.is_structural(t).alias("structural"), L.is_decorative(t).alias("decorative"), L.is_list_like(t).alias("listed"), L.is_table_separator(t).alias("separator"), "o.marker", F.col("o.rest").alias("rest"), L.strip_emphasis(t).alias("plain"), F.col("p.left").alias("left_"), F.col("p.right").alias("right_"), "s.body", "s.suffix", F.col("k.keyword").alias("keyword"), "produces", "requires", U.subject(t).alias("subject"), U.purpose(t).alias("purpose"))


def _line_forms_sql() -> str:
    from marginalia.functions import lines as L
    from marginalia.operators import understanding as U

    pick = lambda p, i=1: f"nullif(trim(regexp_extract(t, {quote(p)}, {i})), '')"
    has = lambda x, p: f"regexp_matches({x}, {quote(p)})"
    sep, paren, tail = r"(?s)^(.+?)(?:\s*[:—–]\s+|\s+-\s+)(.*)$", r"^(.*?)\s*\(([^()]{1,80})\)\s*$", r"^(.*?)\s+[—–-]\s+(\S[\s\S]{0,40}?)\.?\s*$"
    split = f"{has('t', sep)} and not {has('t', r'^(?:\s*[:—–]\s+|\s+-\s+)')}"
    made = lambda p: f"case when {has('t', p)} then {capital('(' + clamp(bare(f'regexp_extract(t, {quote(p)}, 1)'), 10) + ')')} end"
    plain = r"trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(t, '\*\*(.+?)\*\*', '\1', 'g'), '__(.+?)__', '\1', 'g'), '(^|\W)\*(\S(?:.*?\S)?)\*(\W|$)', '\1\2\3', 'g'), '`([^`]+)`', '\1', 'g'))"
    flat = r"regexp_replace(regexp_replace(trim(t), '^\|', ''), '\|$', '')"
    cut = rf"trim({bare(rf'''regexp_replace(regexp_replace(regexp_replace(t, {quote(U.TYPE_NOUN)}, ' ', 'g'), '\s*[:|·]\s*', ' ', 'g'), '\s+', ' ', 'g')''')})"
    goal = r"(?i)\bis\s+(?:a|an)\s+(.{8,90}?)(?:\s+built\b|\s+designed\b|\s+meant\b|\s+intended\b|\s+created\b|[.;]|$)"
    return (
        "with " + told_sql("l", "n, t", list(enumerate(FORMS))) + rf""", c as (select *, {cut} as cut_, {bare(f"regexp_extract(t, {quote(goal)}, 1)")} as goal from l)
select n, {has("trim(t)", r"^(=+|-{3,}|\*{3,}|_{3,})$")} or starts_with(trim(t), '```') or {has("trim(t)", r"(?i)^<!--\s*(page|image):")} as structural, trim(t) = '' or {has("trim(t)", r"^[↓↑→←⇒⇓|+/\\_.·•\-–—=]{1,4}$")} as decorative, {has("t", L.TASK)} or {has("t", L.BULLET)} or {has("t", L.NUMBER)} or {has("t", L.GLYPH)} as listed,
 contains(t, '|') and {has(flat, r"^[\s:|-]+$")} as separator, case when {has("trim(t)", X.ORDINAL)} then upper(left(regexp_extract(trim(t), {quote(X.ORDINAL)}, 1), 1)) || lower(substr(regexp_extract(trim(t), {quote(X.ORDINAL)}, 1), 2)) || ' ' || upper(regexp_extract(trim(t), {quote(X.ORDINAL)}, 2)) end as marker,
 case when {has("trim(t)", X.ORDINAL)} then trim(regexp_replace(substr(trim(t), length(regexp_extract(trim(t), {quote(X.ORDINAL)})) + 1), '^\s*[:—–-]\s*', '')) end as rest, {plain} as plain,
 case when {split} then trim(regexp_extract(t, {quote(sep)}, 1)) end as left_, case when {split} then trim(regexp_extract(t, {quote(sep)}, 2)) end as right_, case when {has("t", paren)} then trim(regexp_extract(t, {quote(paren)}, 1)) else t end as body, {pick(paren, 2)} as suffix,
 nullif(regexp_extract(trim(regexp_extract(t, {quote(tail)}, 2)), {quote(L.TRAILING_STATE)}), '') as keyword, {made(X.PRODUCES)} as produces, {made(X.REQUIRES)} as requires,
 case when len({tokens("cut_")}) = 0 or (len(regexp_split_to_array(cut_, '\s+')) < 2 and len(regexp_split_to_array(t, '\s+')) > 1) then {bare("t")} else cut_ end as subject, case when len({tokens("goal")}) >= 2 then goal end as purpose from c"""
    )


ORACLES["line_forms"] = _line_forms_sql()

"""Queries over the structured fixture documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from marginalia.functions import fixed as X
from marginalia.functions import lines as L
from marginalia.functions.text import matches
from marginalia.operators import inference, statements, structure
from marginalia.plans import language as T
from marginalia.plans.fixtures import DOCUMENTS_SQL, LINES_SQL, documents
from marginalia.sources import documents as sources

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return add


def _lines(spark, sf_dir):
    return statements.lines(documents(spark, sf_dir), text="raw")


def sql(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


@query(rf"with {LINES_SQL}, i as (select doc_id, line_no, line, case when regexp_matches(line, {sql(L.TASK)}) then 'task' when regexp_matches(line, {sql(L.BULLET)}) then 'bullet' when regexp_matches(line, {sql(L.NUMBER)}) then 'number' end as marker from fixture_lines) select doc_id, cast(line_no as int) as line_no, marker, case when marker = 'task' then lower(regexp_extract(line, {sql(L.TASK)}, 1)) = 'x' end as done, trim(case marker when 'task' then regexp_extract(line, {sql(L.TASK)}, 2) when 'bullet' then regexp_extract(line, {sql(L.BULLET)}, 1) else regexp_extract(line, {sql(L.NUMBER)}, 2) end) as text from i where marker is not null")
def list_items(spark, sf_dir):
    return _lines(spark, sf_dir).select("doc_id", "line_no", L.list_item(F.col("line")).alias("i")).where("i is not null").select("doc_id", "line_no", "i.marker", "i.done", "i.text")


@query(rf"with {LINES_SQL}, t as (select doc_id, line_no, regexp_replace(regexp_replace(trim(line), '^\|', ''), '\|$', '') as t from fixture_lines where contains(line, '|')), c as (select doc_id, line_no, list_transform(string_split(t, '|'), lambda x: trim(x)) as cells from t where not regexp_matches(t, '^[\s:|-]+$')) select doc_id, cast(line_no as int) as line_no, cast(len(cells) as int) as n_cells, array_to_string(cells, ' ; ') as cells from c where len(cells) >= 2 and len(list_filter(cells, lambda x: x <> '')) > 0")
def table_rows(spark, sf_dir):
    return _lines(spark, sf_dir).select("doc_id", "line_no", L.table_cells(F.col("line")).alias("c")).where("c is not null").select("doc_id", "line_no", F.size("c").alias("n_cells"), F.array_join("c", " ; ").alias("cells"))


@query(rf"with {LINES_SQL} select doc_id, cast(line_no as int) as line_no, nullif(regexp_extract(trim(line), {sql(X.DATE_AT_START)}, 1), '') as at_start, trim(regexp_replace(regexp_replace(nullif(regexp_extract(line, {sql(X.DATE_ANYWHERE)}, 1), ''), '\.$', ''), '\s+', ' ', 'g')) as anywhere from fixture_lines where regexp_matches(trim(line), {sql(X.DATE_AT_START)}) or regexp_matches(line, {sql(X.DATE_ANYWHERE)})")
def dates_found(spark, sf_dir):
    rows = _lines(spark, sf_dir).select("doc_id", "line_no", L.date_at_start(F.col("line")).alias("at_start"), L.find_date(F.col("line")).alias("anywhere"))
    return rows.where("at_start is not null or anywhere is not null")


@query(rf"with {LINES_SQL} select doc_id, cast(line_no as int) as line_no, case when regexp_matches(lower(line), '(^|\s)(up|grew|growth|increase|increased|▲|\+)') then 'up' when regexp_matches(lower(line), '(^|\s)(down|fell|decline|declined|decrease|decreased|▼|-\d)') then 'down' when regexp_matches(lower(line), '(^|\s)(flat|steady|unchanged|→|holds?)\b') then 'flat' end as trend from fixture_lines")
def trend_of(spark, sf_dir):
    return _lines(spark, sf_dir).select("doc_id", "line_no", L.trend(F.col("line")).alias("trend"))


_KEYWORDS = "kw(ord, word, kind) as (values " + ", ".join(f"({i}, {sql(w)}, '{k}')" for i, (w, k) in enumerate(L.keyword_rows())) + ")"
_HEADED = rf"""{_KEYWORDS}, n as (select doc_id, line_no, line, lead(line) over (partition by doc_id order by line_no) as following from fixture_lines),
hd as (select *, regexp_matches(line, '^\s{{0,3}}(#{{1,6}})\s+(.+?)\s*#*\s*$') as atx, coalesce(regexp_matches(following, '^\s{{0,3}}(=+|-+)\s*$'), false) and trim(line) <> '' as under, trim(regexp_replace(trim(line), ':$', '')) as plain from n),
h as (select doc_id, line_no, line, case when atx then trim(regexp_extract(line, '^\s{{0,3}}(#{{1,6}})\s+(.+?)\s*#*\s*$', 2)) when under then trim(line) when length(plain) <= 40 and not regexp_matches(plain, '[.!?]$') and regexp_replace(lower(plain), '\s+', ' ', 'g') in (select word from kw) then plain end as text,
  case when atx then length(regexp_extract(line, '^\s{{0,3}}(#{{1,6}})\s+', 1)) when under and trim(following)[1] = '=' then 1 else 2 end as level from hd)"""


@query(rf"with {LINES_SQL}, {_HEADED} select doc_id, cast(line_no as int) as line_no, text, cast(level as int) as level from h where text is not null")
def heading_match(spark, sf_dir):
    rows = structure.headed_lines(documents(spark, sf_dir), text="raw").where("heading is not null")
    return rows.select("doc_id", "line_no", "heading.text", "heading.level")


_KIND = r"""k0 as (select *, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(text), '^\d+(\.\d+)*\.?\s*', ''), '^(slide|deck|page|section)\s+\d+\s*[-—–:.]?\s*', ''), '\s*\(.*\)\s*$', ''), ':$', ''), '[—–]', '-', 'g'), '\s*-\s*', ' - ', 'g'), '\s+', ' ', 'g')) as key from h where text is not null),
k1 as (select *, trim(regexp_replace(regexp_replace(key, '\s*-\s*', ' ', 'g'), '\s+', ' ', 'g')) as compact from k0),
k2 as (select k1.*, (select kind from kw where word = key) as direct, (select kind from kw where word = compact) as direct2, (select arg_min(kind, (-length(word), ord)) from kw where contains(' ' || key || ' ', ' ' || word || ' ') or contains(' ' || compact || ' ', ' ' || word || ' ')) as longest from k1)"""


@query(rf"with {LINES_SQL}, {_HEADED}, {_KIND} select doc_id, cast(line_no as int) as line_no, text, coalesce(direct, direct2, longest, case when regexp_matches(key, '^as an?\s+') then 'actions' end) as kind from k2")
def heading_kinds(spark, sf_dir):
    rows = structure.headed_lines(documents(spark, sf_dir), text="raw").where("heading is not null")
    return rows.select("doc_id", "line_no", "heading.text", L.heading_kind(F.col("heading")["text"]).alias("kind"))


@query(rf"with {LINES_SQL}, {_HEADED} select doc_id, cast(line_no as int) as line_no, cast(sum(case when text is not null then 1 else 0 end) over (partition by doc_id order by line_no) as int) as section from h")
def sections_running(spark, sf_dir):
    return structure.headed_lines(documents(spark, sf_dir), text="raw").select("doc_id", "line_no", "section")


_SECTIONED = "sx as (select *, cast(sum(case when text is not null then 1 else 0 end) over (partition by doc_id order by line_no) as int) as section from h)"
_STRUCTURAL = r"(regexp_matches(trim(line), '^(=+|-{3,}|\*{3,}|_{3,})$') or starts_with(trim(line), '```') or regexp_matches(trim(line), '(?i)^<!--\s*(page|image):'))"


@query(rf"""with {LINES_SQL}, {_HEADED}, {_KIND}, {_SECTIONED}, g as (select doc_id, section, max(text) as title, max(case when text is not null then level end) as level, max(case when text is not null then line_no end) as heading_line, min(case when text is null and trim(line) <> '' and not {_STRUCTURAL} then line_no end) as first_line, max(case when text is null and trim(line) <> '' and not {_STRUCTURAL} then line_no end) as last_line, count(*) filter (text is null and trim(line) <> '' and not {_STRUCTURAL}) as n_lines from sx group by doc_id, section)
select g.doc_id, g.section, g.title, cast(g.level as int) as level, cast(heading_line as int) as heading_line, cast(first_line as int) as first_line, cast(last_line as int) as last_line, n_lines, case when section = 0 then 'snapshot' else coalesce(direct, direct2, longest, case when regexp_matches(key, '^as an?\s+') then 'actions' end, case when regexp_matches(trim(title), {sql(X.ORDINAL)}) then 'timeline' end) end as kind from g left join k2 on k2.doc_id = g.doc_id and k2.line_no = g.heading_line""")
def sections(spark, sf_dir):
    return structure.sections(documents(spark, sf_dir), text="raw")


@query(rf"""with {LINES_SQL}, {_HEADED}, {_SECTIONED}, b as (select doc_id, section, regexp_matches(line, {sql(L.NUMBER)}) as numbered, case when regexp_matches(line, {sql(L.TASK)}) then trim(regexp_extract(line, {sql(L.TASK)}, 2)) when regexp_matches(line, {sql(L.BULLET)}) then trim(regexp_extract(line, {sql(L.BULLET)}, 1)) when regexp_matches(line, {sql(L.NUMBER)}) then trim(regexp_extract(line, {sql(L.NUMBER)}, 2)) else trim(line) end as body from sx where text is null and trim(line) <> ''),
shape as (select doc_id, section, count(*) as total, count(*) filter (regexp_matches(body, {sql(X.RULE_LINE)})) as rules, count(*) filter (regexp_matches(body, {sql(X.RISK_LINE)})) as risks, count(*) filter (regexp_matches(body, {sql(X.MEASURED_LINE)})) as measured, count(*) filter (numbered) as numbered from b group by doc_id, section)
select *, case when total >= 2 then case when risks / total >= 0.4 then 'risks' when measured / total >= 0.5 then 'signals' when rules / total >= 0.5 then 'decisions' when numbered / total >= 0.6 then 'actions' end end as shape_kind from shape""")
def section_shapes(spark, sf_dir):
    return structure.shapes(documents(spark, sf_dir), text="raw")


_SEGMENTS = rf"""with recursive {LINES_SQL}, cl as (select doc_id, line_no, line, case when regexp_matches(trim(line), '(?i)^<!--\s*page:\s*\d+\s*-->$') then 'page' when regexp_matches(trim(line), '(?i)^<!--\s*image:.*-->$') then 'image' when regexp_matches(trim(line), '^#{{1,6}}\s+\S') then 'heading' when regexp_matches(trim(line), '^\|.*\|$') then 'table'
  when regexp_matches(line, {sql(L.BULLET)}) or regexp_matches(line, {sql(L.NUMBER)}) then 'list' when trim(line) = '' then 'blank' else 'other' end as seen from fixture_lines),
st(doc_id, line_no, state, segment, page, inherits) as (select doc_id, 0, 'none', 0, null::int, false from fixture union all
  select st.doc_id, cl.line_no, case seen when 'page' then state when 'image' then 'image' when 'heading' then 'section' when 'table' then 'table' when 'list' then case when state = 'none' then 'list' else state end when 'blank' then case when state = 'prose' then 'none' else state end else case when state in ('none', 'table') then 'prose' else state end end,
    segment + case when seen in ('image', 'heading') or (seen = 'table' and state <> 'table') or (seen = 'list' and state = 'none') or (seen = 'other' and state in ('none', 'table')) then 1 else 0 end, case when seen = 'page' then cast(regexp_extract(line, '(?i)page:\s*(\d+)', 1) as int) else page end,
    case when seen in ('image', 'heading') or (seen = 'table' and state <> 'table') or (seen = 'list' and state = 'none') or (seen = 'other' and state in ('none', 'table')) then state <> 'none' and seen <> 'heading' else inherits end from st join cl on cl.doc_id = st.doc_id and cl.line_no = st.line_no + 1),
sl as (select st.*, line, seen from st join cl using (doc_id, line_no) where seen not in ('page', 'blank')),
sg as (select doc_id, segment, arg_min(state, line_no) as kind, arg_min(inherits, line_no) as inherits, max(case when seen = 'heading' then trim(regexp_extract(trim(line), '^(#{{1,6}})\s+(.+?)\s*#*\s*$', 2)) end) as own, arg_min(page, line_no) as page, count(*) filter (seen <> 'heading') as n_lines, coalesce(trim(string_agg(line, chr(10) order by line_no) filter (seen <> 'heading'), e' \n'), '') as body from sl group by all),
sc as (select *, sum(case when inherits then 0 else 1 end) over (partition by doc_id order by segment) as grp from sg),
se as (select *, max(case when own is not null then own when kind = 'image' and not inherits then 'Embedded visual' end) over (partition by doc_id, grp) as title from sc),
sn as (select doc_id, cast(row_number() over (partition by doc_id order by segment) as int) as segment, kind, title, page, n_lines, body, case when kind in ('table', 'image') then kind when kind = 'list' and regexp_matches(coalesce(title, '') || body, {sql(structure.REQUIREMENT_LIST)}) then 'requirement' {" ".join(f"when regexp_matches(coalesce(title, ''), {sql(p)}) then '{n}'" for n, p in structure.NODE_TITLES)} when kind in ('section', 'list') then kind else 'prose' end as node from se where body <> '' or title is not null)"""


@query(_SEGMENTS + " select doc_id, segment, kind, title, page, node, cast(n_lines as int) as n_lines, body from sn")
def segments_fsm(spark, sf_dir):
    """Segments of the fixture documents."""
    return structure.segments(documents(spark, sf_dir), text="raw").select("doc_id", "segment", "kind", "title", "page", "node", "n_lines", "body")


@query(_SEGMENTS + ", e as (select doc_id, segment as t, lag(segment) over w as f, lag(page) over w = page as follows, lag(node) over w = 'section' and node <> 'section' as contains from sn window w as (partition by doc_id order by segment)) select doc_id, f as \"from\", t as \"to\", 'follows' as rel from e where follows union all select doc_id, f, t, 'contains' from e where contains")
def segment_graph(spark, sf_dir):
    """Edges between the segments."""
    return structure.segment_edges(structure.segments(documents(spark, sf_dir), text="raw"))


def _parsed(spark, sf_dir, parse):
    # Out of an array without nulls: a filter of its own would be pushed below and parse every line once more.
    return _lines(spark, sf_dir).select("doc_id", "line_no", F.inline(F.array_compact(F.array(parse(F.col("line"))))))


_ITEM = f"case when regexp_matches(line, {sql(L.TASK)}) then trim(regexp_extract(line, {sql(L.TASK)}, 2)) when regexp_matches(line, {sql(L.BULLET)}) then trim(regexp_extract(line, {sql(L.BULLET)}, 1)) when regexp_matches(line, {sql(L.NUMBER)}) then trim(regexp_extract(line, {sql(L.NUMBER)}, 2)) else trim(line) end"
_BARS = r"regexp_replace(regexp_replace(trim(line), '^\|', ''), '\|$', '')"
_SEP, _PAREN, _MARK = r"(?s)^(.+?)(?:\s*[:—–]\s+|\s+-\s+)(.*)$", r"^(.*?)\s*\(([^()]{1,80})\)\s*$", r"(?i)[\[(](high|medium|med|low)[\])]"
_PLAIN = r"trim(regexp_replace(regexp_replace(regexp_replace(text, '\*\*(.+?)\*\*', '\1', 'g'), '__(.+?)__', '\1', 'g'), '`([^`]+)`', '\1', 'g'))"
_TREND = r"case when regexp_matches(lower({0}), '(^|\s)(up|grew|growth|increase|increased|▲|\+)') then 'up' when regexp_matches(lower({0}), '(^|\s)(down|fell|decline|declined|decrease|decreased|▼|-\d)') then 'down' when regexp_matches(lower({0}), '(^|\s)(flat|steady|unchanged|→|holds?)\b') then 'flat' end"
_TARGET, _BY_DASH = r"(?i)\(target:\s*([^)]+)\)", r"(?i)^(.{4,80}?)\s*[—–:-]\s*(.+?)\s*(?:target|goal)\s*[: ]\s*(.+)$"
_ASKS, _OPEN = r"(?i)^(should|what|who|when|where|why|how)\b", r"(?i)^\s*open questions?\s*[:—–-]\s*"


def _halves(x: str, i: int) -> str:
    return rf"case when regexp_matches({x}, {sql(_SEP)}) and not regexp_matches({x}, '^(?:\s*[:—–]\s+|\s+-\s+)') then trim(regexp_extract({x}, {sql(_SEP)}, {i})) end"


@query(
    rf"""with {LINES_SQL}, t0 as (select doc_id, line_no, line, {_ITEM} as text, case when regexp_matches(line, {sql(L.TASK)}) or regexp_matches(line, {sql(L.BULLET)}) or regexp_matches(line, {sql(L.NUMBER)}) then {_ITEM} else line end as raw_, case when contains(line, '|') and not regexp_matches({_BARS}, '^[\s:|-]+$') then list_transform(string_split({_BARS}, '|'), lambda c: trim(c)) end as cs from fixture_lines),
t1 as (select *, {_PLAIN} as p, case when len(cs) >= 2 and len(list_filter(cs, lambda c: c <> '')) > 0 then cs end as cells, case when regexp_matches(raw_, {sql(_PAREN)}) then trim(regexp_extract(raw_, {sql(_PAREN)}, 1)) else raw_ end as body, nullif(trim(regexp_extract(raw_, {sql(_PAREN)}, 2)), '') as suffix from t0),
t2 as (select *, {_halves("body", 1)} as l, {_halves("body", 2)} as r, trim(regexp_replace(p, '(?i)\s*\(target:\s*[^)]+\)', '')) as mb from t1), t3 as (select *, {_halves("mb", 1)} as ml, {_halves("mb", 2)} as mr from t2),
t4 as (select *, left(trim(regexp_replace(coalesce(ml, mb), ':$', '')), 120) as name, array_to_string(cells[2:], ' ') as rest from t3),
e as (select doc_id, line_no, case when length(p) >= 12 and (contains(p, '?') or regexp_matches(p, '(?i)\bopen question\b') or regexp_matches(p, {sql(_ASKS)})) then {{'label': 'Open question', 'value': null, 'delta': null, 'trend': null, 'implication': left(regexp_replace(p, {sql(_OPEN)}, ''), 400)}}
  when length(p) >= 12 and regexp_matches(p, {sql(_TARGET)}) and length(name) >= 2 then {{'label': name, 'value': left(trim(regexp_extract(p, {sql(_TARGET)}, 1)), 120), 'delta': null, 'trend': null, 'implication': case when coalesce(mr, '') <> '' then left(mr, 240) else 'Target' end}}
  when length(p) >= 12 and not regexp_matches(p, {sql(_TARGET)}) and regexp_matches(p, {sql(_BY_DASH)}) then {{'label': left(trim(regexp_extract(p, {sql(_BY_DASH)}, 1)), 120), 'value': left(trim(regexp_extract(p, {sql(_BY_DASH)}, 3)), 120), 'delta': null, 'trend': null, 'implication': left(trim(regexp_extract(p, {sql(_BY_DASH)}, 2)), 240)}}
  when coalesce(cells[1], '') <> '' and coalesce(cells[2], '') <> '' then {{'label': cells[1], 'value': cells[2], 'delta': nullif(cells[3], ''), 'trend': {_TREND.format("rest")}, 'implication': null}}
  when length(l) between 1 and 60 and regexp_matches(r, '[0-9%$€£#<>]') then {{'label': l, 'value': r, 'delta': case when regexp_matches(suffix, '[0-9%$€£]') or regexp_matches(suffix, '(?i)up|down|flat|pts?|pp\b') then suffix end, 'trend': {_TREND.format("(r || ' ' || coalesce(suffix, ''))")}, 'implication': null}} end as e from t4)
select doc_id, cast(line_no as int) as line_no, e.label, e.value, e.delta, e.trend, e.implication from e where e is not null"""
)
def parse_signals(spark, sf_dir):
    return _parsed(spark, sf_dir, L.parse_signal)


_REF, _TAIL, _HEADS = r"^([A-Z]{1,5}-[0-9]{1,4})\s+", r"^(.*?)\s+[—–-]\s+(\S[\s\S]{0,40}?)\.?\s*$", ("business impact", "priority", "feature", "status", "summary", "overview")
_END = f"trim(regexp_extract(rest, {sql(_TAIL)}, 2))"


_REMARKS, _FLAGS = "trim(array_to_string(cells[5:], ' '))", r"regexp_replace(cells[2] || '/' || cells[3] || '/' || cells[4], '\|', '', 'g')"
_SHEET = f"(coalesce(len(cells) >= 4, false) and cells[1] <> '' and not regexp_matches(cells[1], {sql(X.CASES_HEADER)}) and regexp_matches(cells[2], {sql(X.CASES_FLAGS)}) and regexp_matches(cells[3], {sql(X.CASES_FLAGS)}))"
_OF = lambda i: f"regexp_extract(bare, {sql(X.CASES_PROSE)}, {i})"
_CASES = rf"""t1b as (select *, {_PLAIN} as bare, {_REMARKS} as remarks, {_FLAGS} as flags, {_SHEET} as sheet from t1),
t1c as (select *, case when sheet and remarks <> '' and regexp_matches(remarks, {sql(X.CASES_RULE)}) then cells[1] || ': ' || remarks
    when sheet and not (remarks = '' and regexp_matches(flags, '^[\-–./]+$')) then case when remarks = '' then cells[1] || ': editability ' || flags else cells[1] || ' [' || flags || '] — ' || remarks end
    when coalesce(len(cells), 0) < 4 and regexp_matches(bare, {sql(X.CASES_PROSE)}) and not (regexp_matches(trim({_OF(1)}), {sql(X.CASES_MODULE)}) and length(trim({_OF(5)})) < 8) then
      case when regexp_matches({_OF(5)}, {sql(X.CASES_RULE)}) or length(trim({_OF(5)})) >= 12 then trim({_OF(1)}) || ': ' || trim({_OF(5)}) else trim({_OF(1)}) || ': editability ' || {_OF(2)} || '/' || {_OF(3)} || '/' || {_OF(4)} end end as case_row,
  case when length(bare) >= 20 and regexp_matches(bare, {sql(X.CASES_RULE)}) and not regexp_matches(bare, {sql(X.CASES_BARE)}) then regexp_replace(bare, '(?i)^note:\s*', '') end as case_rule from t1b)"""


@query(
    rf"""with {LINES_SQL}, t0 as (select doc_id, line_no, {_ITEM} as text, regexp_matches(line, {sql(L.TASK)}) or regexp_matches(line, {sql(L.BULLET)}) or regexp_matches(line, {sql(L.NUMBER)}) as listed, case when contains(line, '|') and not regexp_matches({_BARS}, '^[\s:|-]+$') then list_transform(string_split({_BARS}, '|'), lambda c: trim(c)) end as cs from fixture_lines),
t1 as (select *, case when len(cs) >= 2 and len(list_filter(cs, lambda c: c <> '')) > 0 then cs end as cells, nullif(regexp_extract(text, {sql(_REF)}, 1), '') as ref, case when regexp_matches(text, {sql(_REF)}) then trim(regexp_replace(text, {sql(_REF)}, '')) else text end as rest from t0),
{_CASES},
t2 as (select *, case when regexp_matches(rest, {sql(_PAREN)}) then trim(regexp_extract(rest, {sql(_PAREN)}, 1)) else rest end as whole, regexp_extract(rest, {sql(_PAREN)}, 2) as suffix, nullif(regexp_extract({_END}, {sql(X.DECISION_STATUS)}), '') as ts, nullif(regexp_extract({_END}, {sql(X.DECISION_COMMITMENT)}), '') as tc, trim(regexp_extract(rest, {sql(_TAIL)}, 1)) as head from t1c),
t3 as (select *, regexp_matches(suffix, {sql(X.DECISION_STATUS)}) as ps, regexp_matches(suffix, {sql(X.DECISION_COMMITMENT)}) as pc from t2),
t4 as (select *, lower(case when ps then regexp_extract(suffix, {sql(X.DECISION_STATUS)}, 1) when pc then null else ts end) as status, lower(case when ps then null when pc then regexp_extract(suffix, {sql(X.DECISION_COMMITMENT)}, 1) when ts is null then tc end) as commitment, case when ps or pc then whole when ts is not null or tc is not null then head else rest end as said from t3),
e as (select doc_id, line_no, case when (regexp_matches(cells[1], '(?i)^P\d\b') or regexp_matches(cells[1], '(?i)^(critical|high|medium|low)\b')) and length(cells[2]) >= 3 and lower(cells[2]) <> 'feature' then {{'ref': upper(nullif(regexp_extract(cells[1], '(?i)^P\d\b'), '')), 'text': cells[1] || ': ' || cells[2] || case when coalesce(cells[3], '') <> '' then ' (' || cells[3] || ')' else '' end, 'status': case when regexp_matches(cells[1], '(?i)^P0\b') then 'approved' else 'proposed' end, 'commitment': 'committed'}}
  when coalesce(case_row, case_rule) is not null then {{'ref': null, 'text': left(coalesce(case_row, case_rule), 500), 'status': 'approved', 'commitment': 'committed'}}
  when length(text) >= 3 and lower(trim(regexp_replace(text, '[''"`]', '', 'g'))) not in ({", ".join(map(sql, _HEADS))}) and (ref is not null or status is not null or commitment is not null or (listed and (len(regexp_split_to_array(said, '\s+')) >= 3 or regexp_matches(said, '[.!?]$')))) and length(said) >= 2
  then {{'ref': ref, 'text': said, 'status': coalesce(status, 'proposed'), 'commitment': coalesce(commitment, case when status = 'approved' then 'committed' end, case when regexp_matches(said, {sql(X.CONSIDERED)}) then 'considered' when regexp_matches(said, {sql(X.COMMITTED)}) or regexp_matches(trim(said), {sql(X.IMPERATIVE)}) then 'committed' else 'considered' end)}} end as e from t4)
select doc_id, cast(line_no as int) as line_no, e.ref, e.text, e.status, e.commitment, cast(null as varchar) as because from e where e is not null"""
)
def parse_decisions(spark, sf_dir):
    return _parsed(spark, sf_dir, L.parse_decision)


def _state(x: str) -> str:
    return "case " + " ".join(f"when regexp_matches({x}, {sql(p)}) then '{name}'" for name, p in X.TIMELINE_STATES) + " end"


def _match(x: str, p: str, i: int = 1) -> str:
    return f"nullif(regexp_extract({x}, {sql(p)}, {i}), '')"


def _found(x: str) -> str:
    return rf"trim(regexp_replace(regexp_replace({_match(x, X.DATE_ANYWHERE)}, '\.$', ''), '\s+', ' ', 'g'))"


def _looks(x: str) -> str:
    return f"regexp_matches(trim({x}), {sql(X.DATE_AT_START)})"


def _made(x: str, p: str) -> str:
    return T.capital("(" + T.clamp(T.bare(_match(x, p)), 10) + ")")


_LEG, _BY_NUMBER = r"(?i)^(departure|arrival|depart(?:s|ing)?|arriv(?:e|es|al|ing)?)\s*[:—–-]?\s*(.+)$", r"(?i)^(phase|step|stage|milestone|sprint|task|iteration)\s"
_INITIALS = "array_to_string(list_transform(string_split({0}, ' '), lambda w: upper(left(w, 1)) || lower(substr(w, 2))), ' ')"


@query(
    rf"""with {LINES_SQL}, t0 as (select doc_id, line_no, {_ITEM} as text, case when contains(line, '|') and not regexp_matches({_BARS}, '^[\s:|-]+$') then list_transform(string_split({_BARS}, '|'), lambda c: trim(c)) end as cs from fixture_lines),
t1 as (select *, case when len(cs) >= 2 and len(list_filter(cs, lambda c: c <> '')) > 0 then cs end as cells, trim(regexp_extract(text, {sql(X.OBLIGATION)}, 1)) as owed, trim({_match("text", X.OBLIGATION, 2)}) as owed_rest, {_match("text", _LEG)} as leg, trim({_match("text", _LEG, 2)}) as leg_rest,
  {_match("trim(text)", X.ORDINAL, 0)} as head, {_match("text", X.DATE_AT_START, 0)} as leads, regexp_extract(text, {sql(X.DATE_ANYWHERE)}, 0) as spot from t0),
t2 as (select *, coalesce({_found("owed_rest")}, case when {_looks("owed_rest")} then owed_rest end) as owed_on, {_found("leg_rest")} as leg_on, {_match("leg_rest", X.DATE_ANYWHERE + r"\s*[·,]?\s*(\d{1,2}:\d{2})\b", 2)} as clock,
  trim(regexp_replace(substr(trim(text), length(head) + 1), '^\s*[:—–-]\s*', '')) as step_rest, {_INITIALS.format(_match("trim(text)", X.ORDINAL))} || ' ' || upper(regexp_extract(trim(text), {sql(X.ORDINAL)}, 2)) as marker,
  coalesce(trim(regexp_replace(regexp_replace({_match("text", X.DATE_AT_START)}, '\.$', ''), '\s+', ' ', 'g')), {_found("text")}) as day,
  case when leads is not null then trim(regexp_replace(substr(text, length(leads) + 1), '^\s*[:—–-]\s*', '')) else trim(regexp_replace(regexp_replace(left(text, strpos(text, spot) - 1) || ' ' || substr(text, strpos(text, spot) + length(spot)), '\s+', ' ', 'g'), '^\s*[:—–-]\s*|\s*[:—–-]\s*$', '', 'g')) end as rest from t1),
t3 as (select *, {_match(f"trim(regexp_extract(step_rest, {sql(_TAIL)}, 2))", L.TRAILING_STATE, 0)} as step_key, {_match(f"trim(regexp_extract(rest, {sql(_TAIL)}, 2))", L.TRAILING_STATE, 0)} as end_key, {_state(f"nullif(trim(regexp_extract(rest, {sql(_PAREN)}, 2)), '')")} as in_paren from t2),
t4 as (select *, case when step_key is not null then trim(regexp_extract(step_rest, {sql(_TAIL)}, 1)) else step_rest end as step_body, case when in_paren is not null then trim(regexp_extract(rest, {sql(_PAREN)}, 1)) when end_key is not null then trim(regexp_extract(rest, {sql(_TAIL)}, 1)) else rest end as title from t3),
t5 as (select *, case when length(step_body) < 2 then marker else step_body end as step_title from t4),
e as (select doc_id, line_no, case when coalesce(cells[1], '') <> '' and {_looks("cells[1]")} then {{'date': cells[1], 'title': cells[2], 'state': coalesce({_state("coalesce(cells[3], '')")}, 'planned'), 'of': array_to_string(cells[3:], '. ')}}
  when regexp_matches(cells[1], '(?i)^[A-Z]{{2,}}-\d+') then {{'date': cells[1], 'title': cells[2], 'state': case when contains(lower(coalesce(cells[3], '')), 'priorit') then 'planned' else coalesce({_state("coalesce(cells[3], '')")}, 'planned') end, 'of': null}}
  when owed_on is not null then {{'date': owed_on, 'title': left({_INITIALS.format("owed")} || ': ' || owed_rest, 200), 'state': case when regexp_matches(owed, '(?i)due|payment') then 'planned' else 'done' end, 'of': null}}
  when leg_on is not null then {{'date': concat_ws(' ', leg_on, clock), 'title': trim(regexp_replace(case when starts_with(lower(leg), 'arriv') then 'Arrival: ' else 'Departure: ' end || leg_rest, '\s+', ' ', 'g')), 'state': 'planned', 'of': null}}
  when head is not null and regexp_matches(text, {sql(_BY_NUMBER)}) then {{'date': marker, 'title': step_title, 'state': coalesce({_state("step_key")}, {_state("step_rest")}, 'planned'), 'of': step_title}}
  when day is not null and length(rest) >= 2 and length(title) >= 2 then {{'date': day, 'title': title, 'state': coalesce(in_paren, {_state("end_key")}, 'planned'), 'of': title}} end as e from t5)
select doc_id, cast(line_no as int) as line_no, e.date, e.title, e.state, {_made("e.of", X.PRODUCES)} as produces, {_made("e.of", X.REQUIRES)} as requires from e where e is not null"""
)
def parse_timeline(spark, sf_dir):
    return _parsed(spark, sf_dir, L.parse_timeline)


_TELL, _CHANCE = r"(?i)^(.{8,160}?),?\s+(?:but|yet|however|while|with)\s+(.{6,180})$", r"(?i)^(?:there is|there's|we have|we see|this is)\s+(?:a\s+)?(?:risk|danger|chance)\s+(?:that|of)\s+"


def _grade(x: str) -> str:
    return f"case lower(regexp_extract({x}, {sql(X.SEVERITY)}, 1)) when 'med' then 'medium' when '' then 'medium' else lower(regexp_extract({x}, {sql(X.SEVERITY)}, 1)) end"


def _got(x: str, p: str, i: int = 1) -> str:
    return f"nullif(regexp_extract({x}, {sql(p)}, {i}), '')"


def _said(x: str, n: int) -> str:
    return T.capital("(" + T.clamp(T.bare(x), n) + ")")


_READ = rf"""r1 as (select *, {T.bare("risk0")} as flat from r0), r2 as (select *, {_got("flat", X.CONSEQUENCE)} as costs, {_got("flat", X.WHY)} as why, strpos(flat, regexp_extract(flat, {sql(X.CONSEQUENCE)})) as cat, strpos(flat, regexp_extract(flat, {sql(X.WHY)})) as wat from r1),
r3 as (select *, {_said("costs", 18)} as cq, case when why is not null and wat > 1 then {_said("why", 18)} end as rs, why is not null and wat > 1 as inside from r2),
r4 as (select *, case when cq is null or rs <> cq then rs end as reason, case when costs is not null then {T.bare("left(flat, cat - 1)")} when inside then {T.bare("left(flat, wat - 1)")} else flat end as seen0, {_got("flat", _TELL, 2)} as other from r3),
r5 as (select *, reason is null and coalesce(regexp_matches(other, {sql(X.TROUBLE)}), false) as told from r4),
r6 as (select *, regexp_replace(case when told then {_said(_got("flat", _TELL), 14)} else seen0 end, {sql(_CHANCE)}, '') as seen, case when told then {_said("other", 16)} else reason end as reason2 from r5),
r7 as (select *, {T.capital("(" + T.clamp("seen", 26) + ")")} as stated from r6),
rd as (select *, {T.words("flat")} >= 4 and (regexp_matches(flat, {sql(X.TROUBLE)}) or costs is not null) and {T.words("seen")} >= 3 and not {T.fragment("stated")} as usable from r7)"""


@query(
    rf"""with {LINES_SQL}, t0 as (select doc_id, line_no, {_ITEM} as text, case when contains(line, '|') and not regexp_matches({_BARS}, '^[\s:|-]+$') then list_transform(string_split({_BARS}, '|'), lambda c: trim(c)) end as cs from fixture_lines),
t1 as (select *, case when len(cs) >= 2 and len(list_filter(cs, lambda c: c <> '')) > 0 then cs end as cells, coalesce(regexp_matches(regexp_extract(text, {sql(_PAREN)}, 2), {sql(X.SEVERITY)}), false) as inp from t0),
t2 as (select *, case when inp then trim(regexp_extract(text, {sql(_PAREN)}, 1)) else text end as body, list_filter(range(1, len(cells) + 1), lambda i: regexp_matches(cells[i], {sql(X.SEVERITY)}))[1] as g from t1),
t3 as (select *, case when regexp_matches(body, {sql(_SEP)}) and not regexp_matches(body, '^(?:\s*[:—–]\s+|\s+-\s+)') then trim(regexp_extract(body, {sql(_SEP)}, 1)) end as l, case when regexp_matches(body, {sql(_SEP)}) and not regexp_matches(body, '^(?:\s*[:—–]\s+|\s+-\s+)') then trim(regexp_extract(body, {sql(_SEP)}, 2)) end as r from t2),
t4 as (select *, case when inp then {_grade(f"regexp_extract(text, {sql(_PAREN)}, 2)")} when regexp_matches(l, {sql(_MARK)}) then {_grade(f"regexp_extract(l, {sql(_MARK)}, 1)")} end as sev, case when inp then l else trim(regexp_replace(l, {sql(_MARK)}, '')) end as risk_, trim(regexp_replace(r, '(?i)^mitigation\s*[:—–-]\s*', '')) as mit from t3),
r0 as (select doc_id, line_no, cells[1] as risk0, {_grade("cells[g]")} as severity, array_to_string(cells[g + 1:], ' · ') as mitigation from t4 where cells is not null and g > 1 and cells[1] <> '' and trim(array_to_string(cells[g + 1:], ' · ')) <> '' union all
  select doc_id, line_no, risk_, sev, mit from t4 where cells is null and sev is not null and length(risk_) >= 3 and length(mit) >= 2), {_READ}
select doc_id, cast(line_no as int) as line_no, case when usable then stated else risk0 end as risk, severity, mitigation, case when usable and not {T.fragment("coalesce(reason2, '')")} then reason2 end as because, case when usable and not {T.fragment("coalesce(cq, '')")} then cq end as consequence from rd"""
)
def parse_risks(spark, sf_dir):
    return _parsed(spark, sf_dir, L.parse_risk)


_STORY, _PERSONA, _WANT = r"(?i)^(?:user\s*story|story)\s*[:—–-]\s*(.+)$", r"(?i)^(?:persona\s*[:—–-]\s*)?(as an?\s+.+)$", r"(?i)^i want\b"


def _ready(x: str, done: str) -> str:
    return f"case when {done} or regexp_matches({x}, {sql(X.FINISHED)}) then 'done' when regexp_matches({x}, {sql(X.READY)}) then 'ready' when regexp_matches({x}, {sql(X.CONSIDERED)}) then 'suggested' else 'pending' end"


def _dated(x: str) -> str:
    return f"coalesce(regexp_matches(trim({x}), {sql(X.DATE_AT_START)}), false)"


@query(
    rf"""with {LINES_SQL}, t0 as (select doc_id, line_no, {_ITEM} as text, lower(regexp_extract(line, {sql(L.TASK)}, 1)) = 'x' as done, case when contains(line, '|') and not regexp_matches({_BARS}, '^[\s:|-]+$') then list_transform(string_split({_BARS}, '|'), lambda c: trim(c)) end as cs from fixture_lines),
t1 as (select *, {_PLAIN} as bare, case when len(cs) >= 2 and len(list_filter(cs, lambda c: c <> '')) > 0 then cs end as cells, case when regexp_matches(text, {sql(_PAREN)}) then trim(regexp_extract(text, {sql(_PAREN)}, 1)) end as body, list_transform(string_split(regexp_extract(text, {sql(_PAREN)}, 2), ','), lambda c: trim(c)) as names,
  list_filter(list_transform(string_split(regexp_replace(text, '\s+[—–]\s+|\s+-\s+', chr(1), 'g'), chr(1)), lambda c: trim(c)), lambda c: c <> '') as ps from t0),
t2 as (select *, length(bare) >= 12 as long, len(ps) as n, case when length(array_to_string(cells[4:], ' ')) > 0 then array_to_string(cells[4:], ' ') else cells[1] end as told from t1),
e as (select doc_id, line_no, case when long and regexp_matches(bare, {sql(_STORY)}) then {{'task': left('User story: ' || trim(regexp_extract(bare, {sql(_STORY)}, 1)), 500), 'owner': null, 'due': null, 'status': 'pending'}} when long and regexp_matches(bare, {sql(_PERSONA)}) and not regexp_matches(bare, '(?i)\bi want\b') then {{'task': left('Persona: ' || trim(regexp_extract(bare, {sql(_PERSONA)}, 1)), 240), 'owner': null, 'due': null, 'status': 'pending'}}
  when long and regexp_matches(bare, {sql(_WANT)}) and length(bare) >= 20 then {{'task': left('User story: ' || bare, 500), 'owner': null, 'due': null, 'status': 'pending'}} when coalesce(cells[1], '') <> '' and coalesce(cells[2], '') <> '' and coalesce(cells[3], '') <> '' then {{'task': cells[1], 'owner': cells[2], 'due': cells[3], 'status': {_ready("told", "false")}}}
  when length(text) >= 3 and body is not null and names[1] <> '' and {_dated("names[2]")} then {{'task': body, 'owner': names[1], 'due': names[2], 'status': {_ready("text", "done")}}} when length(text) >= 3 and n >= 3 and {_dated("ps[n]")} and length(ps[n - 1]) <= 60 and length(array_to_string(ps[1:n - 2], ', ')) >= 3 then {{'task': array_to_string(ps[1:n - 2], ', '), 'owner': ps[n - 1], 'due': ps[n], 'status': {_ready("text", "done")}}} end as e from t2)
select doc_id, cast(line_no as int) as line_no, e.task, e.owner, e.due, e.status from e where e is not null"""
)
def parse_actions(spark, sf_dir):
    return _parsed(spark, sf_dir, L.parse_action)


@query(rf"""with {DOCUMENTS_SQL}, c as (select doc_id, coalesce(raw, '') as t, regexp_replace(list_last(regexp_split_to_array(coalesce(label, ''), '[\\\\/]')), '[\x00-\x1f<>:"|?*]', '', 'g') as b from fixture)
select doc_id, case when trim(b) = '' then 'Pasted notes' else left(trim(b), 120) end as clean_label, case when trim(t, e' \t\n\r') = '' then 'empty' when regexp_matches(ltrim(t, e' \t\n\r'), '^[\{{\[]') then 'json' else 'text' end as format, cast(octet_length(encode(t)) as bigint) as byte_length, case when trim(t, e' \t\n\r') = '' then 'input.empty' end as code from c""")
def preflight_fixture(spark, sf_dir):
    out = sources.preflight(documents(spark, sf_dir)).withColumn("clean_label", sources.sanitize_label(F.col("label")))
    return out.select("doc_id", "clean_label", "format", "byte_length", F.get(F.col("diagnostics")["code"], F.lit(0)).alias("code"))


@query(rf"with {LINES_SQL} select doc_id, cast(line_no as int) as line_no, regexp_matches(trim(line), {sql(X.IMPERATIVE)}) as imperative, regexp_matches(line, {sql(X.CONSIDERED)}) as hedged, regexp_matches(line, {sql(X.COMMITTED)}) as committed, regexp_matches(line, {sql(X.TROUBLE)}) as trouble from fixture_lines")
def statement_predicates(spark, sf_dir):
    c = F.col("line")
    return _lines(spark, sf_dir).select("doc_id", "line_no", matches(F.trim(c), X.IMPERATIVE).alias("imperative"), matches(c, X.CONSIDERED).alias("hedged"), matches(c, X.COMMITTED).alias("committed"), matches(c, X.TROUBLE).alias("trouble"))


@query(rf"with {LINES_SQL}, {_HEADED}, a as (select doc_id, line_no from fixture_lines), g as (select doc_id, line_no from h where text is not null) select a.doc_id, cast(a.line_no as int) as anchor, cast(coalesce((select max(line_no) from g where g.doc_id = a.doc_id and g.line_no <= a.line_no), (select min(line_no) from g where g.doc_id = a.doc_id and g.line_no >= a.line_no)) as int) as line_no from a")
def highlight_heading(spark, sf_dir):
    rows = structure.headed_lines(documents(spark, sf_dir), text="raw")
    return structure.highlight(rows.select("doc_id", F.col("line_no").alias("anchor")), rows.where("heading is not null").select("doc_id", "line_no"))


_MARKED = r"^(#{1,6})\s+(.+?)\s*$"


@query(rf"""with {LINES_SQL}, mk as (select doc_id, line_no, line, case when regexp_matches(line, {sql(_MARKED)}) then length(regexp_extract(line, {sql(_MARKED)}, 1)) end as level from fixture_lines),
sc as (select *, count(level) over (partition by doc_id order by line_no) as section from mk),
gr as (select doc_id, section, max(case when level is not null then trim(regexp_extract(line, {sql(_MARKED)}, 2)) end) as heading, coalesce(max(level), 0) as level,
  trim(coalesce(string_agg(case when level is null then line end, chr(10) order by line_no), ''), e' \t\n\r') as text, min(line_no) as start_line, max(line_no) as end_line from sc group by all)
select doc_id, cast(section as int) as section, heading, cast(level as int) as level, text, cast(start_line as int) as start_line, cast(end_line as int) as end_line from gr where heading is not null or text <> ''""")
def markdown_sections(spark, sf_dir):
    """Sections between marked headings, with their first and last line."""
    return structure.markdown_sections(documents(spark, sf_dir), text="raw")


@query(rf"""with {DOCUMENTS_SQL}, f1 as (select doc_id, label, list_filter(list_transform(string_split(coalesce(raw, ''), chr(10)), lambda x: trim(x, e' \t\r')), lambda x: x <> '')[1] as s from fixture)
select doc_id, case when s is null then regexp_replace(list_last(string_split(coalesce(label, ''), '/')), '(.)\.[^.]*$', '\1') when length(regexp_extract(s, {sql(_MARKED)}, 1)) = 1 then trim(regexp_extract(s, {sql(_MARKED)}, 2)) else left(s, 160) end as title from f1""")
def guessed_titles(spark, sf_dir):
    """Titles guessed from the first line, else from the file's name."""
    return documents(spark, sf_dir).select("doc_id", structure.guessed_title(F.col("raw"), F.col("label")).alias("title"))


_LISTED = f"(regexp_matches(line, {sql(L.TASK)}) or regexp_matches(line, {sql(L.BULLET)}) or regexp_matches(line, {sql(L.NUMBER)}))"
_STATED = rf"""{_HEADED}, {_KIND}, kinds as (select distinct text, coalesce(direct, direct2, longest, case when regexp_matches(key, '^as an?\s+') then 'actions' end) as kind from k2),
hs as (select *, last_value(text ignore nulls) over (partition by doc_id order by line_no) as section_title from h),
bl as (select doc_id, line_no, section_title, {_LISTED} as listed, case when {_LISTED} then {_ITEM.replace("trim(line)", "line")} else line end as body from hs where text is null),
pt as (select doc_id, line_no, section_title, listed, unnest(range(1, len(ps) + 1)) as pn, unnest(ps) as p from (select *, string_split(regexp_replace(trim(regexp_replace(body, '\s+', ' ', 'g')), '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)) as ps from bl)),
ru as (select *, lag(regexp_matches(p, {sql(X.ABBREVIATION)}) or regexp_matches(p, '\d\.$')) over (partition by doc_id, line_no order by pn) as runs from pt),
rn as (select *, sum(case when runs then 0 else 1 end) over (partition by doc_id, line_no order by pn) as sn from ru),
se as (select doc_id, line_no, any_value(section_title) as section_title, any_value(listed) as listed, sn, string_agg(p, ' ' order by pn) as s from rn group by doc_id, line_no, sn),
ky as (select *, trim(regexp_replace(lower(s), '[^a-z0-9]+', ' ', 'g')) as skey from se where s <> '' and len(string_split(s, ' ')) between 3 and 60),
di as (select * from (select *, row_number() over (partition by doc_id, skey order by line_no, sn) as nth from ky) where nth = 1)"""


@query(rf"with {LINES_SQL}, {_STATED} select doc_id, cast(line_no as int) as line_no, section_title, listed, s as text, skey as key, kind as section_kind from di left join kinds on kinds.text = section_title")
def distilled_statements(spark, sf_dir):
    """The first statement of each key, and what heads it."""
    return inference.statements(documents(spark, sf_dir), text="raw")

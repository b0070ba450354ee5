"""Queries over page items and texts read from images, with SQL over the same items."""

from __future__ import annotations

from pyspark.sql import functions as F

from marginalia.functions import fixed as X
from marginalia.operators import layout as L
from marginalia.plans.language import quote
from marginalia.runtime import stored
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


def _items() -> list[tuple]:
    out = []

    def put(page, text, x, y, width=None, height=10.0):
        out.append((1, page, len(out), text, float(x), float(y), float(width or 5 * len(text)), float(height)))

    put(1, "Harbour plan", 50, 760, 200, 16)
    put(1, "1. Gates", 50, 740, 60, 12)
    for i, line in enumerate(("The gates at the north pier are old and the tic-", "kets of the season do not fit their readers.", "A second para-graph follows here after a stop.")):
        put(1, line, 50, 720 - 12 * i, 260)
    put(1, "Ticket Summary Status", 50, 670, 150)
    put(1, "GATE-12 Replace the reader Open", 50, 655, 200)
    for x, cell in ((50, "Rate"), (200, "12"), (300, "14")):
        put(1, cell, x, 640.2, 30)
    put(1, "1 2", 50, 620)
    put(1, "● first", 50, 600)
    put(1, "of", 92, 600, 8)
    put(1, "Owners:", 50, 580)
    put(1, "the pier team and the desk", 50, 568)
    # Two columns: left edges at 50 and 310.
    put(2, "Adaptive gates under winter load on three piers of the harbour", 60, 780, 420, 15)
    put(2, "Mara Holt", 60, 765, 50)
    put(2, "Pier team", 330, 765, 50)
    for i in range(12):
        put(2, f"left line {i} tells how the gates of the pier work well in {i} cold", 50, 740 - 14 * i, 210)
        put(2, f"right line {i} tells how the desks of the pier work well in {i} wet", 310, 740 - 14 * i, 210)
    for x in (70, 90, 110, 330, 350):
        put(2, "x", x, 500, 6)
    put(2, "Abstract", 50, 560)
    return out


ITEMS = tuple(_items())
COLUMNS = "doc_id int, page int, seq int, str string, x double, y double, width double, height double"
_FROM = rf"""with {told_sql("items", "doc_id, page, seq, str, x, y, width, height", ITEMS)},
b0 as (select doc_id, page, round(x / 10) * 10 as x, sum(length(str)) as mass from items where trim(str) <> '' and width <= 220 group by all),
b1 as (select *, sum(mass) over w as total, count(*) over w as n, max(x) over w - min(x) over w as spread, lag(mass, 1, 0) over o as p, lead(mass, 1, 0) over o as q from b0 window w as (partition by doc_id, page), o as (partition by doc_id, page order by x)),
b2 as (select *, mass >= p and mass >= q and mass >= 80 as peak from b1 where total >= 400 and n >= 6 and spread >= 180), f1 as (select doc_id, page, arg_min(x, (-mass, x)) as a from b2 where peak group by all),
f2 as (select b2.doc_id, b2.page, any_value(a) as a, arg_min(x, (-mass, x)) as b from b2 join f1 using (doc_id, page) where peak and mass >= 150 and abs(x - a) >= 140 group by b2.doc_id, b2.page), f3 as (select doc_id, page, least(a, b) as l, greatest(a, b) as r from f2),
z0 as (select b2.*, l, r, min(mass) over (partition by b2.doc_id, b2.page) as least_mass from b2 join f3 using (doc_id, page) where x > l + 30 and x < r - 30), z1 as (select *, x - lag(x) over (partition by doc_id, page order by x) as step from z0 where mass = least_mass),
z2 as (select *, sum(case when step >= 20 then 1 else 0 end) over (partition by doc_id, page order by x) as run from z1), z3 as (select doc_id, page, max(x) as x from z2 where run = 0 group by all),
g0 as (select doc_id, page, least(coalesce(x, (l + r) / 2) + 30, r - 40) as gutter from f3 left join z3 using (doc_id, page)),
g1 as (select doc_id, page, gutter, sum(mass) filter (b2.x < gutter) as lm, sum(mass) filter (b2.x >= gutter) as rm from b2 join g0 using (doc_id, page) group by all), g as (select doc_id, page, gutter from g1 where lm >= 250 and rm >= 250 and least(lm, rm) / greatest(lm, rm) >= 0.35),
p0 as (select items.*, gutter, case when gutter is null or (x < gutter - 8 and x + width > gutter + 40 and width >= 300) then 'full' when x < gutter then 'left' else 'right' end as side, round(y * 2) / 2 as ry from items left join g using (doc_id, page) where str <> ''),
p1 as (select *, x - lag(x + width) over r as gap, lag(str) over r as before from p0 window r as (partition by doc_id, page, side, ry order by x, seq)),
p2 as (select *, sum(case when gap > 28 then 1 else 0 end) over (partition by doc_id, page, side, ry order by x, seq) as cell from p1),
p3 as (select doc_id, page, side, ry, cell, any_value(gutter) as gutter, max(height) as size, string_agg(case when gap <= 28 and gap > 1.2 and not ends_with(before, ' ') and not starts_with(str, ' ') then ' ' else '' end || str, '' order by x, seq) as t from p2 group by all),
p4 as (select doc_id, page, side, ry as y, any_value(gutter) as gutter, max(size) as size, list(trim(t) order by cell) as cs from p3 where trim(t) <> '' group by all),
p5 as (select *, case when len(cs) >= 2 then array_to_string(cs, ' | ') else cs[1] end as t0 from p4), p6 as (select *, regexp_replace(regexp_replace(t0, '^[●•▪◦]\s*', '• '), '([A-Za-z])-\s+([a-z])', '\1\2', 'g') as text0 from p5),
p7 as (select * exclude (text0), regexp_replace(text0, '\b([A-Za-z]{{2,4}})-([A-Za-z]{{2,5}})\b', '\1\2', 'g') as text from p6)"""


def _rows(spark, sf_dir):
    return told(spark, sf_dir, list(ITEMS), COLUMNS)


@query(_FROM + " select doc_id, page, gutter from g")
def page_gutters(spark, sf_dir):
    """Where pages of two columns part."""
    return L.gutters(_rows(spark, sf_dir))


_LINES = (
    _FROM
    + rf""", ls as (select *, case when len(cs) >= 2 then cs when contains(text, ' | ') then string_split(text, ' | ') when regexp_matches(text, '(?i)^ticket\b') and regexp_matches(text, '(?i)\bstatus\b') then ['Ticket', 'Summary', 'Status']
  when regexp_matches(text, {quote(X.TICKET_CELLS)}) then [regexp_extract(text, {quote(X.TICKET_CELLS)}, 1), regexp_extract(text, {quote(X.TICKET_CELLS)}, 2), regexp_extract(text, {quote(X.TICKET_CELLS)}, 3)] else [text] end as loose from p7 where not regexp_matches(text, {quote(X.MARKER_ROW)})),
tb as (select *, side = 'full' and (len(cs) >= 2 or len(loose) >= 3 or regexp_matches(text, {quote(X.TICKET_ROW)}) or regexp_matches(text, {quote(X.PRIORITY_ROW)})) as is_table from ls),
bt as (select *, least(max(y) filter (side = 'left' and length(text) > 48) over w, max(y) filter (side = 'right' and length(text) > 48) over w) as top from tb window w as (partition by doc_id, page)),
bd as (select *, case when gutter is null then 3 when side = 'full' or (y > top + 4 and length(text) <= case when side = 'left' then 80 else 40 end) then 0 when side = 'left' then 1 else 2 end as band from bt),
sz as (select *, list_sort(list(size) over (partition by doc_id, page)) as sizes from bd), bo as (select *, sizes[cast(floor(len(sizes) * 0.5) as int) + 1] as body from sz)"""
)


@query(_LINES + " select doc_id, page, cast(row_number() over (partition by doc_id, page order by band, -y, text) - 1 as int) as place, text, side, is_table, case when is_table and len(loose) >= 2 then array_to_string(loose, ';') else '' end as cells from bd")
def page_lines(spark, sf_dir):
    """Lines of each page in reading order, with the cells of rows."""
    return L.page_lines(_rows(spark, sf_dir)).select("doc_id", "page", "place", "text", "side", F.col("table").alias("is_table"), F.array_join("cells", ";").alias("cells"))


_TITLE = f"(length(text) <= 72 and not regexp_matches(text, '[.!?,;]$') and not regexp_matches(text, {quote(X.SENTENCE_OPENER)}))"
_NUMBERED, _COLON = f"(regexp_matches(text, {quote(X.NUMBERED_SECTION)}) and length(text) <= 80)", r"(length(text) <= 72 and regexp_matches(text, ':\s*$'))"


@query(
    _LINES
    + rf""", lv as (select doc_id, page, text, body, case when is_table or regexp_matches(text, {quote(X.LISTED)}) or regexp_matches(text, '^[a-z]') then null when regexp_matches(text, {quote(X.SECTION_LABEL)}) then 2
  when (size >= body + 1.2 or {_NUMBERED} or {_COLON}) and length(text) <= 90 and not (length(text) > 60 and regexp_matches(text, '(?i)^(current|we|this|these)\b')) and ({_TITLE} or {_NUMBERED} or {_COLON}) then case when size >= body + 3.5 then 1 when size >= body + 1.2 or {_NUMBERED} then 2 else 3 end end as level from bo) select * from lv"""
)
def page_headings(spark, sf_dir):
    """Lines with the page's body size and their level as headings."""
    return L.annotated(L.page_lines(_rows(spark, sf_dir))).select("doc_id", "page", "text", "body", "level")


@query()
def page_markdown(spark, sf_dir):
    """Documents as Markdown; tests hold the expected text."""
    return L.documents(stored(L.markdown(stored(L.annotated(L.page_lines(_rows(spark, sf_dir))), "page-lines")), "page-blocks"))


WRAPS = (("the zeo-", "lite bed"), ("a domain-", "specific model"), ("state-of-the-", "art gates"), ("model O4-", "mini runs"), ("NASA-", "led work"), ("two words", "go on"), ("", "alone"), ("funda-", "mental domain-specific work"), ("soft­", "hyphen"), ("end ", ""))
_KEEP = rf"(regexp_matches(stem, '-[A-Za-z]+$') or regexp_matches(stem, '\d$') or (tail <> '' and tail = upper(tail) and length(tail) <= 4) or (regexp_matches(tail, {quote(X.COMPOUND_HEAD)}) and not regexp_matches(head, {quote(X.SYLLABLE)})))"


@query(
    "with "
    + told_sql("w", "n, l, r", [(i, *w) for i, w in enumerate(WRAPS)])
    + rf""", s as (select n, rtrim(l) as a, ltrim(r) as b, regexp_replace(rtrim(l), '-$', '') as stem from w), t as (select *, regexp_extract(stem, '[A-Za-z]+$') as tail, regexp_extract(b, '^[a-z]+') as head from s)
select n, case when a = '' then b when b = '' then a when ends_with(a, chr(173)) then left(a, length(a) - 1) || b when regexp_matches(a, '.-$') and regexp_matches(b, '^[a-z]') then case when {_KEEP} then a || b else stem || b end else a || ' ' || b end as joined from t"""
)
def soft_wraps(spark, sf_dir):
    """Two lines of a paragraph as one."""
    rows = told(spark, sf_dir, [(i, *w) for i, w in enumerate(WRAPS)], "n int, l string, r string")
    return rows.select("n", L.soft_wrapped(F.col("l"), F.col("r")).alias("joined"))


OCR = (
    (1, "Status of contracts:\nNote: prices hold until May\nPO: open for edits\n1. The quantity cannot be edited after delivery\nModule x\nY | N | -\nRates cannot be reduced once the advance is paid\n1. The quantity cannot be edited  after delivery"),
    (2, "short\na line of ordinary words here\nanother line of words"),
)
_OCR = (
    "with "
    + told_sql("o", "doc_id, raw", OCR)
    + rf""", l as (select doc_id, unnest(range(1, len(ls) + 1)) as n, unnest(ls) as t from (select doc_id, list_filter(list_transform(string_split(raw, chr(10)), lambda x: trim(regexp_replace(x, '\s+', ' ', 'g'))), lambda x: x <> '') as ls from o)),
c as (select *, case when regexp_matches(t, {quote(X.OCR_STATUS)}) then '**' || regexp_replace(t, ':$', '') || '**' when regexp_matches(t, {quote(X.OCR_NOTE)}) then '- ' || regexp_replace(t, '(?i)^note:\s*', 'Note: ') when regexp_matches(t, {quote(X.OCR_FIELD)}) then '- ' || t end as said from l),
r as (select *, case when said is null then case when length(regexp_extract(t, {quote(X.OCR_ITEM)}, 1)) > 20 then regexp_extract(t, {quote(X.OCR_ITEM)}, 1) when regexp_matches(t, {quote(X.OCR_RULE)}) and length(t) > 24 then t end end as rule from c),
u as (select doc_id, min(n) as n, arg_min(rule, n) as rule from r where rule is not null group by doc_id, left(lower(rule), 120)),
parts as (select doc_id, 0 as s, n, said as t from r where said is not null union all select distinct doc_id, 1, 0, '' from u union all select distinct doc_id, 1, 1, {quote(X.OCR_RULES_TITLE)} from u union all select doc_id, 2, n, '- ' || rule from u),
st as (select doc_id, string_agg(t, chr(10) order by s, n) as text from parts group by doc_id), fb as (select doc_id, string_agg('- ' || t, chr(10) order by n) as text from l where length(t) > 12 group by doc_id),
img as (select o.doc_id, coalesce(st.text, fb.text) as text, case when regexp_matches(raw, '(?i)status of contracts|indent|grn|\bpo\b') then 'Cases – Sheet (embedded spreadsheet)' else 'Embedded visual' end as heading from o left join st using (doc_id) left join fb using (doc_id))"""
)


def _images(spark, sf_dir):
    rows = told(spark, sf_dir, list(OCR), "doc_id int, raw string")
    return rows.select("doc_id", L.structured_ocr(F.col("raw")).alias("text"), L.image_heading(F.col("raw")).alias("heading"))


@query(_OCR + " select doc_id, text, heading from img")
def ocr_structured(spark, sf_dir):
    """Notes, fields and rules of sheets read from images."""
    return _images(spark, sf_dir)


BODIES = ((1, "<!-- page:1 -->\n# Plan\n## Cases and rules\nEnd"), (2, "<!-- page:1 -->\n# Other"), (3, "No image"))
_SECTION = "chr(10) || '## ' || heading || chr(10) || chr(10) || '<!-- image:page=1 confidence=88 -->' || chr(10) || chr(10) || text || chr(10)"


@query(_OCR + ", " + told_sql("b", "doc_id, md", BODIES) + f" select b.doc_id, case when img.doc_id is null then md when b.doc_id % 1000 = 1 then replace(md, '## Cases and rules', '## Cases and rules' || chr(10) || {_SECTION}) else replace(md, '<!-- page:1 -->', '<!-- page:1 -->' || chr(10) || {_SECTION}) end as markdown from b left join img using (doc_id)")
def ocr_merged(spark, sf_dir):
    """Markdown with the texts of its images in place."""
    images = _images(spark, sf_dir).select("doc_id", F.lit(1).alias("page"), F.lit(0).alias("place"), "heading", F.lit(87.6).alias("confidence"), "text")
    return L.with_image_texts(told(spark, sf_dir, list(BODIES), "doc_id int, markdown string"), images)

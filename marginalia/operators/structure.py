"""Document structure: headings, running sections, section shapes, segments and their graph."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from marginalia.functions import fixed as X
from marginalia.functions.lines import heading, heading_kind, is_structural, list_item, ordinal
from marginalia.functions.text import content_tokens, extract, let, matches, overlap, strip, word_count
from marginalia.operators.statements import lines


def headed_lines(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, line_no, line, heading STRUCT(text, level), section): section counts the headings so far, 0 before the first."""
    order = Window.partitionBy(id).orderBy("line_no")
    rows = lines(docs, id, text).withColumn("heading", heading(F.col("line"), F.lead("line").over(order)))
    running = F.sum(F.when(F.col("heading").isNotNull(), 1).otherwise(0)).over(order.rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("section", running.cast("int"))


def sections(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, section, title, level, kind, heading_line, first_line, last_line, n_lines); the preamble is a snapshot."""
    rows = headed_lines(docs, id, text)
    head = F.col("heading").isNotNull()
    body = ~head & (strip(F.col("line")) != "") & ~is_structural(F.col("line"))
    grouped = rows.groupBy(id, "section").agg(
        F.max(F.when(head, F.col("heading")["text"])).alias("title"),
        F.max(F.when(head, F.col("heading")["level"])).alias("level"),
        F.max(F.when(head, F.col("line_no"))).alias("heading_line"),
        F.min(F.when(body, F.col("line_no"))).alias("first_line"),
        F.max(F.when(body, F.col("line_no"))).alias("last_line"),
        F.sum(F.when(body, 1).otherwise(0)).cast("long").alias("n_lines"),
    )
    step = ordinal(F.col("title"))
    kind = F.when(F.col("section") == 0, "snapshot").otherwise(F.coalesce(heading_kind(F.col("title")), F.when(step.isNotNull(), "timeline")))
    return grouped.withColumn("kind", kind)


def shapes(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, section, total, rules, risks, measured, numbered, shape_kind): what a section's lines look like."""
    rows = headed_lines(docs, id, text).where(F.col("heading").isNull() & (strip(F.col("line")) != ""))
    body = F.coalesce(list_item(F.col("line"))["text"], strip(F.col("line")))
    n = lambda c: F.sum(F.when(c, 1).otherwise(0)).cast("long")
    out = rows.groupBy(id, "section").agg(
        F.count("*").alias("total"),
        n(matches(body, X.RULE_LINE)).alias("rules"),
        n(matches(body, X.RISK_LINE)).alias("risks"),
        n(matches(body, X.MEASURED_LINE)).alias("measured"),
        n(F.coalesce(list_item(F.col("line"))["marker"] == "number", F.lit(False))).alias("numbered"),
    )
    share = lambda c: F.col(c) / F.col("total")
    kind = F.when(F.col("total") >= 2, F.when(share("risks") >= 0.4, "risks").when(share("measured") >= 0.5, "signals").when(share("rules") >= 0.5, "decisions").when(share("numbered") >= 0.6, "actions"))
    return out.withColumn("shape_kind", kind)


def shape_kind(line: Column, whole) -> Column:
    """The memory that the lines of a window look like, without a shuffle of its own."""
    body = F.coalesce(list_item(line)["text"], strip(line))
    full = strip(line) != ""
    n = lambda c: F.sum(F.when(full & c, 1).otherwise(0)).over(whole)
    total = n(F.lit(True))
    numbered = F.coalesce(list_item(line)["marker"] == "number", F.lit(False))
    shares = (("risks", matches(body, X.RISK_LINE), 0.4), ("signals", matches(body, X.MEASURED_LINE), 0.5), ("decisions", matches(body, X.RULE_LINE), 0.5), ("actions", numbered, 0.6))
    out = F.lit(None).cast("string")
    for kind, hit, least in reversed(shares):
        out = F.when(n(hit) / total >= least, kind).otherwise(out)
    return F.when(total >= 2, out)


# --- segments: a state machine over the classes of lines ---------------------------------------------------------------


def line_class(line: Column) -> Column:
    flat = strip(line)
    return (
        F.when(matches(flat, r"(?i)^<!--\s*page:\s*\d+\s*-->$"), "page")
        .when(matches(flat, r"(?i)^<!--\s*image:.*-->$"), "image")
        .when(matches(flat, r"^#{1,6}\s+\S"), "heading")
        .when(matches(flat, r"^\|.*\|$"), "table")
        .when(list_item(line).isNotNull(), "list")
        .when(flat == "", "blank")
        .otherwise("other")
    )


def _moves(state: Column, seen: Column) -> tuple[Column, Column]:
    """(next state, whether a segment starts) of the state machine."""
    after = (
        F.when(seen == "page", state)
        .when(seen == "image", "image")
        .when(seen == "heading", "section")
        .when(seen == "table", "table")
        .when(seen == "list", F.when(state == "none", "list").otherwise(state))
        .when(seen == "blank", F.when(state == "prose", "none").otherwise(state))
        .otherwise(F.when(state.isin("none", "table"), "prose").otherwise(state))
    )
    starts = seen.isin("image", "heading") | ((seen == "table") & (state != "table")) | ((seen == "list") & (state == "none")) | ((seen == "other") & state.isin("none", "table"))
    return after, starts


def segment_lines(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, line_no, line, page, segment, kind, inherits): every line that isn't blank or a page mark, with its segment; inherits:
    whether the segment takes over the title of the one before it."""
    ls = F.split(F.coalesce(F.col(text), F.lit("")), "\n")
    read = F.transform(ls, lambda s, i: F.struct((i + 1).alias("line_no"), line_class(s).alias("seen"), extract(s, r"(?i)<!--\s*page:\s*(\d+)").cast("int").alias("page")))
    empty = "array<struct<line_no:int,page:int,segment:int,kind:string,inherits:boolean>>"
    start = F.struct(F.lit("none").alias("state"), F.lit(0).alias("segment"), F.lit(None).cast("int").alias("page"), F.lit(False).alias("inherits"), F.array().cast(empty).alias("out"))

    def step(acc: Column, x: Column) -> Column:
        state, starts = _moves(acc["state"], x["seen"])
        segment = acc["segment"] + starts.cast("int")
        page = F.when(x["seen"] == "page", x["page"]).otherwise(acc["page"])
        inherits = F.when(starts, (acc["state"] != "none") & (x["seen"] != "heading")).otherwise(acc["inherits"])
        row = F.struct(x["line_no"].alias("line_no"), page.alias("page"), segment.alias("segment"), state.alias("kind"), inherits.alias("inherits"))
        return F.struct(state.alias("state"), segment.alias("segment"), page.alias("page"), inherits.alias("inherits"), F.when(x["seen"].isin("blank", "page"), acc["out"]).otherwise(F.array_append(acc["out"], row)).alias("out"))

    rows = docs.select(id, ls.alias("_ls"), F.aggregate(read, start, step, lambda a: a["out"]).alias("_xs")).select(id, "_ls", F.explode("_xs").alias("x"))
    return rows.select(id, "x.line_no", F.col("_ls")[F.col("x.line_no") - 1].alias("line"), "x.page", "x.segment", "x.kind", "x.inherits")


# --- fixed values: what a segment's title says about it, first match wins -----------------------------------------------
NODE_TITLES = (
    ("question", r"(?i)open question|unresolved|tbd"),
    ("risk", r"(?i)risk|problem|pain|limitation|threat"),
    ("metric", r"(?i)metric|kpi|success|signal|measure"),
    ("decision", r"(?i)decision|requirement|priority|policy|rule"),
)
REQUIREMENT_LIST = r"(?i)requirement|criteria|must\b"


def node_type(kind: Column, title: Column, text: Column) -> Column:
    out = F.when(kind == "section", "section").when(kind == "list", "list").otherwise("prose")
    for name, pattern in reversed(NODE_TITLES):
        out = F.when(matches(F.coalesce(title, F.lit("")), pattern), name).otherwise(out)
    asks = (kind == "list") & matches(F.concat(F.coalesce(title, F.lit("")), text), REQUIREMENT_LIST)
    return F.when(kind.isin("table", "image"), kind).when(asks, "requirement").otherwise(out)


def segments(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, segment, kind, title, level, page, node, first_line, n_lines, body), one row each.

    Untitled prose of eight lines or more is split where its topic shifts.
    """
    rows = segment_lines(docs, id, text)
    atx = r"^(#{1,6})\s+(.+?)\s*#*\s*$"
    titled = matches(strip(F.col("line")), atx)
    out = rows.groupBy(id, "segment").agg(
        F.min_by("kind", "line_no").alias("kind"),
        F.min_by("inherits", "line_no").alias("inherits"),
        F.max(F.when(titled, strip(extract(strip(F.col("line")), atx, 2)))).alias("own"),
        F.max(F.when(titled, F.length(extract(strip(F.col("line")), atx)))).alias("level"),
        F.min_by("page", "line_no").alias("page"),
        F.min("line_no").alias("start"),
        F.array_sort(F.collect_list(F.when(~titled, F.struct("line_no", "line")))).alias("ls"),
    )
    order = Window.partitionBy(id).orderBy("segment")
    out = out.withColumn("line_of_titles", F.sum((~F.col("inherits")).cast("int")).over(order))
    own = F.coalesce("own", F.when((F.col("kind") == "image") & ~F.col("inherits"), "Embedded visual"))
    first = Window.partitionBy(id, "line_of_titles").orderBy("segment").rowsBetween(Window.unboundedPreceding, 0)
    title = F.last(own, ignorenulls=True).over(first)
    out = out.withColumn("title", F.coalesce(title, F.when(F.col("kind") == "image", "Embedded visual")))
    shifts = topic_shifts(F.transform("ls", lambda x: x["line"]))
    parts = lambda b: F.transform(F.sequence(F.lit(0), F.element_at(b, -1)), lambda k: F.filter("ls", lambda x, i: F.get(b, i) == k))
    split = (F.col("kind") == "prose") & F.col("title").isNull() & (F.size("ls") >= 8)
    out = out.withColumn("parts", F.when(split, let(shifts, parts)).otherwise(F.array("ls")))
    out = out.select(id, "segment", "kind", "title", F.when(F.col("kind") == "section", F.col("level")).alias("level"), "page", "start", F.posexplode("parts").alias("part", "ls"))
    body = strip(F.array_join(F.transform("ls", lambda x: x["line"]), "\n"))
    out = out.withColumn("body", body).where((F.col("body") != "") | F.col("title").isNotNull())
    number = F.row_number().over(Window.partitionBy(id).orderBy("segment", "part"))
    return out.select(id, number.alias("segment"), "kind", "title", "level", "page", node_type(F.col("kind"), F.col("title"), F.col("body")).alias("node"), F.coalesce(F.get("ls", F.lit(0))["line_no"], "start").alias("first_line"), F.size("ls").alias("n_lines"), "body")


def segment_edges(segmented: DataFrame, id: str = "doc_id") -> DataFrame:
    """(id, from, to, rel): a segment follows the one before it on the same page; a section contains the segment right after it."""
    order = Window.partitionBy(id).orderBy("segment")
    before = lambda name: F.lag(name).over(order)
    rows = segmented.select(id, F.col("segment").alias("to"), before("segment").alias("from"), (before("page") == F.col("page")).alias("follows"), ((before("node") == "section") & (F.col("node") != "section")).alias("contains"))
    rels = F.array_compact(F.array(*[F.when(F.col(r), F.lit(r)) for r in ("follows", "contains")]))
    return rows.select(id, "from", "to", F.explode(rels).alias("rel"))


def topic_shifts(line_array: Column, least_words: int = 80, least_overlap: float = 0.12) -> Column:
    """Bucket numbers of consecutive lines: a new bucket starts once the open one has enough words and the next line shares too little with it."""
    items = F.transform(line_array, lambda s: F.struct(F.array_distinct(content_tokens(s)).alias("tokens"), word_count(s).alias("words")))
    start = F.struct(F.lit(0).alias("bucket"), F.array().cast("array<string>").alias("tokens"), F.lit(0).alias("words"), F.array().cast("array<int>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        shut = (acc["words"] >= least_words) & (overlap(acc["tokens"], x["tokens"]) < least_overlap)
        bucket = acc["bucket"] + shut.cast("int")
        return F.struct(bucket.alias("bucket"), F.when(shut, x["tokens"]).otherwise(F.array_union(acc["tokens"], x["tokens"])).alias("tokens"), F.when(shut, x["words"]).otherwise(acc["words"] + x["words"]).alias("words"), F.array_append(acc["out"], bucket).alias("out"))

    return F.aggregate(items, start, step, lambda a: a["out"])


def highlight(anchors: DataFrame, headings: DataFrame, id: str = "doc_id") -> DataFrame:
    """(id, anchor, line_no): the nearest heading at or above the anchor's line, else the nearest below; an as-of lookup without a range join.

    anchors: (id, anchor); headings: (id, line_no).  Both are sorted together once per document.
    """
    rows = anchors.select(id, F.col("anchor").alias("at"), F.lit(None).cast("int").alias("h"), F.lit(1).alias("o")).union(headings.select(id, F.col("line_no"), F.col("line_no"), F.lit(0)))
    order = Window.partitionBy(id).orderBy("at", "o")
    above = F.last("h", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))
    below = F.first("h", ignorenulls=True).over(order.rowsBetween(0, Window.unboundedFollowing))
    return rows.withColumn("line_no", F.coalesce(above, below)).where("o = 1").select(id, F.col("at").alias("anchor"), "line_no")


# --- Markdown by its marked headings ------------------------------------------------------------------------------------

MARKED = r"^(#{1,6})\s+(.+?)\s*$"


def markdown_sections(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, section, heading, level, text, start_line, end_line): what stands between headings marked by #; sections without both are left out.

    Of rows of one id the lines are read as one document's; a null or empty text has no sections; very long texts are read whole."""
    c = F.col
    plain = F.regexp_replace(F.coalesce(c(text), F.lit("")), r"\r\n?", "\n")
    rows = lines(docs.select(id, plain.alias("_plain")), id, "_plain").withColumn("level", F.length(extract(c("line"), MARKED)))
    order = Window.partitionBy(id).orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("section", F.count("level").over(order))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(c("level").isNull(), F.struct("line_no", "line")))), lambda x: x["line"]), "\n")
    out = rows.groupBy(id, "section").agg(
        strip(F.max(extract(c("line"), MARKED, 2))).alias("heading"), F.coalesce(F.max("level"), F.lit(0)).cast("int").alias("level"), strip(body).alias("text"),
        F.min("line_no").cast("int").alias("start_line"), F.max("line_no").cast("int").alias("end_line"),
    )
    return out.where("heading is not null or text <> ''").select(id, c("section").cast("int").alias("section"), "heading", "level", "text", "start_line", "end_line")


def guessed_title(text: Column, label: Column) -> Column:
    """The first line that isn't blank: the words of a heading of level 1, else its first 160 letters; without one the file's name, its ending gone."""
    flat = F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), r"\r\n?|\n"), strip), lambda s: s != "")
    name = F.regexp_replace(F.element_at(F.split(F.coalesce(label, F.lit("")), r"/"), -1), r"(?<=.)\.[^.]*\z", "")
    first = lambda s: F.when(F.length(extract(s, MARKED)) == 1, strip(extract(s, MARKED, 2))).otherwise(F.substring(s, 1, 160))
    return F.coalesce(let(F.get(flat, F.lit(0)), lambda s: F.when(s.isNotNull(), first(s))), name)

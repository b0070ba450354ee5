"""Page layout: text items with places to ordered lines, headings, tables and Markdown; and text read from images.

Items are rows (doc_id, page, seq, str, x, y, width, height), y upwards.  A page is the unit: histograms and peaks are windows over
its bins, rows are groups of equal baselines, and what runs from line to line is found as islands over a page's order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from marginalia.functions import fixed as X
from marginalia.functions.text import extract, let, let_all, matches, strip

PAGE = ("doc_id", "page")


def gutters(items: DataFrame) -> DataFrame:
    """(doc_id, page, gutter): where two columns part, for pages that have two.

    Letters by left edge, in bins of ten: the strongest peak and the strongest one far from it; the emptiest bin between them.
    """
    w, c = Window.partitionBy(*PAGE), F.col
    order = w.orderBy("x")
    bins = items.where((F.trim("str") != "") & (c("width") <= 220)).groupBy(*PAGE, (F.round(c("x") / 10) * 10).alias("x")).agg(F.sum(F.length("str")).alias("mass"))
    whole = {"total": F.sum("mass").over(w), "n": F.count("*").over(w), "low": F.min("x").over(w), "high": F.max("x").over(w)}
    bins = bins.withColumns(whole | {"before": F.lag("mass", 1, 0).over(order), "after": F.lead("mass", 1, 0).over(order)})
    bins = bins.where("total >= 400 and n >= 6 and high - low >= 180")
    peak = (c("mass") >= c("before")) & (c("mass") >= c("after")) & (c("mass") >= 80)
    strongest = F.min(F.when(peak, F.struct((-c("mass")).alias("m"), c("x").alias("x")))).over(w)
    bins = bins.withColumn("first", strongest["x"])
    far = F.min(F.when(peak & (c("mass") >= 150) & (F.abs(c("x") - c("first")) >= 140), F.struct((-c("mass")).alias("m"), c("x").alias("x")))).over(w)
    bins = bins.withColumn("second", far["x"]).where("second is not null").withColumns({"left": F.least("first", "second"), "right": F.greatest("first", "second")})
    inner = (c("x") > c("left") + 30) & (c("x") < c("right") - 30)
    bins = bins.withColumn("empty", F.min(F.when(inner, c("mass"))).over(w)).withColumn("low_bin", inner & (c("mass") == c("empty")))
    # The end of the first run of such bins that lie side by side.
    spots = F.array_sort(F.collect_list(F.when(c("low_bin"), c("x"))).over(w))
    run = F.aggregate(spots, F.lit(None).cast("double"), lambda at, x: F.when(at.isNull() | (x - at < 20), x).otherwise(at))
    # Once a gap came, later bins are never within 20 of where the run stopped.
    bins = bins.withColumn("gutter", F.least(F.coalesce(run, (c("left") + c("right")) / 2) + 30, c("right") - 40))
    side = bins.groupBy(*PAGE, "gutter").agg(F.sum(F.when(c("x") < c("gutter"), c("mass")).otherwise(0)).alias("l"), F.sum(F.when(c("x") >= c("gutter"), c("mass")).otherwise(0)).alias("r"))
    return side.where((c("l") >= 250) & (c("r") >= 250) & (F.least("l", "r") / F.greatest("l", "r") >= 0.35)).select(*PAGE, "gutter")


def collapsed(text: Column) -> Column:
    return strip(F.regexp_replace(text, r"\s+", " "))


def dehyphenated(text: Column) -> Column:
    """Hyphens that a line break left inside words: at a blank, as a soft hyphen, before a syllable, between short parts."""
    out = F.regexp_replace(F.regexp_replace(text, "([A-Za-z])­([a-z])", "$1$2"), r"([A-Za-z])-\s+([a-z])", "$1$2")
    parts = r"^([^A-Za-z]*)([A-Za-z]{2,6})-([A-Za-z]{2,8})([^A-Za-z0-9_-].*)?$"

    def joined(word: Column) -> Column:
        left, right = extract(word, parts, 2), extract(word, parts, 3)
        keeps = matches(left, X.COMPOUND_LEFT) | matches(right, X.COMPOUND_RIGHT)
        joins = matches(right, X.SYLLABLE_END) | ((F.length(left) <= 4) & (F.length(right) <= 5))
        return F.when(word.contains("-") & F.coalesce(~keeps & joins, F.lit(False)), F.replace(word, F.lit("-"), F.lit(""))).otherwise(word)

    return F.array_join(F.transform(F.split(out, " "), joined), " ")


def soft_wrapped(left: Column, right: Column) -> Column:
    """Two lines of one paragraph as one: a hyphen at the break goes unless it belongs to a compound."""
    a, b = F.regexp_replace(left, r"\s+\z", ""), F.regexp_replace(right, r"^\s+", "")

    def whole(s: Column) -> Column:
        stem = F.regexp_replace(s["a"], r"-\z", "")
        tail, head = F.regexp_extract(stem, r"[A-Za-z]+\z", 0), F.regexp_extract(s["b"], "^[a-z]+", 0)
        keep = stem.rlike(r"-[A-Za-z]+\z") | stem.rlike(r"[0-9]\z") | ((tail != "") & (tail == F.upper(tail)) & (F.length(tail) <= 4)) | (matches(tail, X.COMPOUND_HEAD) & ~matches(head, X.SYLLABLE))
        wrapped = F.when(keep, F.concat(s["a"], s["b"])).otherwise(F.concat(stem, s["b"]))
        soft = s["a"].endswith("­")
        glued = F.when(soft, F.concat(F.regexp_replace(s["a"], "­\\z", ""), s["b"])).when(s["a"].rlike(r".-\z") & s["b"].rlike("^[a-z]"), wrapped).otherwise(F.concat(s["a"], F.lit(" "), s["b"]))
        return F.when(s["a"] == "", s["b"]).when(s["b"] == "", s["a"]).otherwise(collapsed(glued))

    return let_all(whole, a=a, b=b)


def loose_cells(text: Column) -> Column:
    """Cells of a row whose columns aren't marked: by bars, of known headers, of ticket and priority rows; else the text alone."""
    three = lambda *xs: F.array(*[F.lit(x) if isinstance(x, str) else x for x in xs])
    plain = ~matches(text, r"(?i)\bmatrix\b")
    return (
        F.when(text.contains(" | "), F.array_remove(F.transform(F.split(text, r" \| "), lambda x: F.trim(x)), ""))
        .when(matches(text, r"(?i)^ticket\b") & matches(text, r"(?i)\bstatus\b") & plain, three("Ticket", "Summary", "Status"))
        .when(matches(text, r"(?i)^priority\b") & matches(text, r"(?i)\bfeature\b") & plain, three("Priority", "Feature", "Business Impact"))
        .when(matches(text, X.TICKET_CELLS), three(*[extract(text, X.TICKET_CELLS, i) for i in (1, 2, 3)]))
        .when(matches(text, X.PRIORITY_CELLS), three(extract(text, X.PRIORITY_CELLS), extract(text, X.PRIORITY_CELLS, 2), strip(F.concat(extract(text, X.PRIORITY_CELLS, 3), F.coalesce(extract(text, X.PRIORITY_CELLS, 4), F.lit(""))))))
        .otherwise(F.array(text))
    )


def joined_row(parts: Column) -> Column:
    """STRUCT(text, cells, table) of the items of one baseline, in order of x: a gap over 28 opens a cell, one over 1.2 is a blank."""
    state = lambda cells, cell, gaps, end: F.struct(cells.alias("cells"), cell.alias("cell"), gaps.alias("gaps"), end.alias("end"))
    shut = lambda s: F.when(F.trim(s["cell"]) != "", F.array_append(s["cells"], collapsed(s["cell"]))).otherwise(s["cells"])

    def step(s: Column, p: Column) -> Column:
        gap, end = p["x"] - s["end"], p["x"] + p["width"]
        blank = (gap > 1.2) & ~s["cell"].endswith(" ") & ~p["str"].startswith(" ")
        more = F.concat(s["cell"], F.when(blank, " ").otherwise(""), p["str"])
        return F.when(s["end"].isNull(), state(s["cells"], p["str"], s["gaps"], end)).when(gap > 28, state(shut(s), p["str"], s["gaps"] + 1, end)).otherwise(state(s["cells"], more, s["gaps"], end))

    def done(s: Column) -> Column:
        table = lambda cells: (s["gaps"] >= 1) & (F.size(cells) >= 2)
        return let(shut(s), lambda cells: F.struct(collapsed(F.when(table(cells), F.array_join(cells, " | ")).otherwise(F.array_join(cells, " "))).alias("text"), F.when(table(cells), cells).otherwise(F.slice(cells, 1, 0)).alias("cells"), table(cells).alias("table")))

    start = state(F.array().cast("array<string>"), F.lit(""), F.lit(0), F.lit(None).cast("double"))
    return let(F.aggregate(parts, start, step), done)


def _line_text(text: Column) -> Column:
    flat = F.regexp_replace(F.regexp_replace(text, "\\x00", ""), r"[ \t]+", " ")
    return dehyphenated(strip(F.regexp_replace(flat, r"^[●•▪◦]\s*", "• ")))


def page_lines(items: DataFrame) -> DataFrame:
    """(doc_id, page, place, text, y, size, side, table, cells): the lines of each page in reading order.

    With two columns: wide items and short lines above the body first, then the left column, then the right one.
    """
    c = F.col
    parts = items.where("str <> ''").join(gutters(items), list(PAGE), "left").withColumn("height", F.coalesce(F.nullif("height", F.lit(0.0)), F.lit(10.0)))
    wide = (c("x") < c("gutter") - 8) & (c("x") + c("width") > c("gutter") + 40) & (c("width") >= 300)
    parts = parts.withColumn("side", F.when(c("gutter").isNull() | wide, "full").when(c("x") < c("gutter"), "left").otherwise("right"))
    rows = parts.groupBy(*PAGE, "side", (F.round(c("y") * 2) / 2).alias("y")).agg(F.array_sort(F.collect_list(F.struct("x", "seq", "str", "width"))).alias("ps"), F.max("height").alias("size"), F.max(c("gutter").isNotNull()).alias("split"))
    rows = rows.withColumn("j", joined_row(c("ps"))).withColumn("text", _line_text(c("j.text"))).where((c("text") != "") & ~matches(c("text"), X.MARKER_ROW))
    loose = F.when(c("j.table"), c("j.cells")).otherwise(loose_cells(c("text")))
    table = (c("side") == "full") & (c("j.table") | (F.size(loose) >= 3) | matches(c("text"), X.TICKET_ROW) | matches(c("text"), X.PRIORITY_ROW)) & ~matches(c("text"), X.FOOTNOTE_ROW)
    rows = rows.withColumn("table", table).withColumn("cells", F.when(c("table") & (F.size(loose) >= 2), loose).otherwise(c("j.cells")))
    whole = Window.partitionBy(*PAGE)
    top = lambda side: F.max(F.when((c("side") == side) & (F.length("text") > 48), c("y"))).over(whole)
    rows = rows.withColumn("top", F.least(top("left"), top("right")))  # least ignores a column without body
    above = (c("top") > 0) & (c("y") > c("top") + 4)
    head = c("split") & ((c("side") == "full") | (above & (F.length("text") <= F.when(c("side") == "left", 80).otherwise(40))))
    rows = rows.withColumn("band", F.when(head, 0).when(c("side") == "left", 1).when(c("side") == "right", 2).otherwise(3))
    line = F.struct("band", (-c("y")).alias("up"), F.when(c("band") == 0, c("text")).alias("tie"), "text", "y", "size", "side", "table", "cells")
    pages = rows.groupBy(*PAGE).agg(F.array_sort(F.collect_list(line)).alias("ls"))  # the lines of one page
    ordered = F.concat(_merged_head(F.filter("ls", lambda x: x["band"] == 0)), F.filter("ls", lambda x: x["band"] > 0))
    out = pages.select(*PAGE, F.posexplode(ordered).alias("place", "l"))
    return out.select(*PAGE, "place", "l.text", "l.y", "l.size", "l.side", "l.table", "l.cells")


def _merged_head(lines: Column) -> Column:
    """Short fragments on one baseline of a page's head as one line."""

    def step(kept: Column, x: Column) -> Column:
        last = F.element_at(kept, -1)
        close = (F.abs(last["y"] - x["y"]) < 1.2) & ~last["table"] & ~x["table"] & ((last["side"] == x["side"]) | (last["side"] == "full") | (x["side"] == "full"))
        short = (F.length(x["text"]) <= 60) | ((F.length(last["text"]) <= 60) & (F.length(x["text"]) <= 80))
        both = last.withField("text", _line_text(F.concat(last["text"], F.lit(" "), x["text"]))).withField("size", F.greatest(last["size"], x["size"]))
        return F.when((F.size(kept) > 0) & F.coalesce(close & short, F.lit(False)), F.array_append(F.slice(kept, F.lit(1), F.size(kept) - 1), both)).otherwise(F.array_append(kept, x))

    return F.aggregate(lines, F.slice(lines, 1, 0), step)


def heading_level(text: Column, size: Column, body: Column, table: Column) -> Column:
    """1 to 3 by size and shape, null for text: labels of sections, large titles, numbered sections, keywords with a colon."""
    n = F.length(text)
    short = n <= 72
    title = short & ~text.rlike(r"[.!?,;]\z") & ~matches(text, X.SENTENCE_OPENER)
    numbered, keyword = matches(text, X.NUMBERED_SECTION) & (n <= 80), short & text.rlike(r":\s*\z")
    large, display = size >= body + 1.2, size >= body + 3.5
    never = table | matches(text, X.LISTED) | text.rlike("^[a-z]")
    copy = (n > 90) | ((n > 60) & matches(text, r"(?i)^(current|we|this|these)\b"))
    usual = F.when((large | numbered | keyword) & ~copy & (title | numbered | keyword), F.when(display, 1).when(large | numbered, 2).otherwise(3))
    return F.when(~never, F.when(matches(strip(text), X.SECTION_LABEL), 2).otherwise(usual))


def annotated(lines: DataFrame) -> DataFrame:
    """`lines` with body, the upper median of the page's sizes, and level."""
    whole = Window.partitionBy(*PAGE)
    sizes = F.array_sort(F.collect_list("size").over(whole))
    rows = lines.withColumn("body", F.element_at(sizes, (F.floor(F.size(sizes) * 0.5) + 1).cast("int")))
    return rows.withColumn("level", heading_level(F.col("text"), F.col("size"), F.col("body"), F.col("table")).cast("int"))


def markdown(lines: DataFrame) -> DataFrame:
    """(doc_id, page, block, kind, text): each page's blocks as Markdown: headings, lists, tables of 40 rows at most, paragraphs.

    A line goes on with a paragraph unless that ended a sentence, it is an acronym or the column changes; a row goes on with a table if
    it is one or a short rest of a cell.
    """
    c, order = F.col, Window.partitionBy(*PAGE).orderBy("place")
    t = c("text")
    header = ~matches(t, r"(?i)\bmatrix\b") & matches(t, r"(?i)^(ticket|priority)\b") & matches(t, r"(?i)\b(summary|status|feature)\b")
    tabular = c("table") | header
    row = c("table") | matches(t, X.TICKET_ROW) | matches(t, X.PRIORITY_ROW)
    rows = lines.withColumns({"tabular": tabular, "row": row, "listed": matches(t, X.LISTED)})
    before = lambda name: F.lag(name).over(order)
    rest = ~c("listed") & (before("tabular") | before("row")) & (c("size") <= before("size") + 0.2) & (F.length("text") <= 70) & (matches(t, r"(?i)^(record|risk)\b") | (t.rlike("^[a-z(]") & (F.abs(before("y") - c("y")) < 18)))
    kind = F.when(c("level").isNotNull(), "heading").when(c("tabular"), "table").when(c("listed"), "list").otherwise("prose")
    rows = rows.withColumns({"kind": kind, "rest": F.coalesce(rest, F.lit(False))})
    # Rests and rows belong to the table right before them.
    in_table = (c("kind") == "table") | ((c("kind") == "prose") & (c("rest") | c("row")) & F.coalesce(before("kind") == "table", F.lit(False)))
    rows = rows.withColumn("kind", F.when(in_table, "table").otherwise(c("kind")))
    ended = before("text")
    wraps = ended.rlike("[A-Za-z][­-]\\s*\\z") & t.rlike("^[a-z]")
    goes_on = (c("kind") == "prose") & (before("kind") == "prose") & (before("side") == c("side")) & (wraps | (~ended.rlike(r"[.!?:]\z") & ~t.rlike(r"^[A-Z][A-Z0-9_/-]{2,}\z")))
    goes_on = F.coalesce(goes_on | ((c("kind") == "table") & (before("kind") == "table")), F.lit(False))
    rows = rows.withColumn("start", (~goes_on).cast("int")).withColumn("run", F.sum("start").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    nth = F.row_number().over(Window.partitionBy(*PAGE, "run").orderBy("place"))
    rows = rows.withColumn("part", F.when(c("kind") == "table", F.floor((nth - 1) / 40)).otherwise(0))
    item = F.struct("place", "text", "level", F.when(F.size("cells") >= 2, c("cells")).otherwise(loose_cells(t)).alias("cells"))
    blocks = rows.groupBy(*PAGE, "run", "part").agg(F.first("kind").alias("kind"), F.array_sort(F.collect_list(item)).alias("ls"))
    one = F.get("ls", F.lit(0))
    prose = F.aggregate(F.slice("ls", F.lit(2), F.size("ls")), one["text"], lambda s, x: soft_wrapped(s, x["text"]))
    listed = F.when(one["text"].startswith("•"), F.regexp_replace(one["text"], r"^•\s*", "- ")).otherwise(F.regexp_replace(one["text"], r"^([0-9]+)[.)]\s+", "$1. "))
    text = (
        F.when(c("kind") == "heading", F.concat(F.repeat(F.lit("#"), one["level"]), F.lit(" "), F.regexp_replace(one["text"], r":\z", "")))
        .when(c("kind") == "table", table_text(F.transform("ls", lambda x: x["cells"])))
        .when(c("kind") == "list", listed)
        .otherwise(dehyphenated(collapsed(prose)))
    )
    place = F.row_number().over(Window.partitionBy(*PAGE).orderBy("run", "part"))
    return blocks.select(*PAGE, place.alias("block"), "kind", text.alias("text"))


def table_text(rows: Column) -> Column:
    """A Markdown table of at most twelve columns; a row of one cell that isn't a code joins the second cell of the row before."""
    width = F.least(F.lit(12), F.array_max(F.transform(rows, lambda r: F.size(r))))
    even = F.transform(rows, lambda r: F.transform(F.slice(F.concat(r, F.array_repeat(F.lit(""), width)), F.lit(1), width), lambda x: F.replace(x, F.lit("|"), F.lit("/"))))

    def step(kept: Column, r: Column) -> Column:
        filled = F.filter(r, lambda x: F.trim(x) != "")
        orphan = (F.size(kept) > 0) & (F.size(filled) == 1) & (r[0] != "") & ~r[0].rlike("^[A-Z]{2,}")
        last = F.element_at(kept, -1)
        at = F.least(F.lit(1), F.size(last) - 1)
        both = F.transform(last, lambda x, i: F.when(i == at, F.trim(F.concat(x, F.lit(" "), filled[0]))).otherwise(x))
        return F.when(orphan, F.array_append(F.slice(kept, F.lit(1), F.size(kept) - 1), both)).otherwise(F.array_append(kept, r))

    line = lambda r: F.concat(F.lit("| "), F.array_join(r, " | "), F.lit(" |"))
    rule = lambda ms: F.transform(ms[0], lambda x: F.lit("---"))
    merged = lambda es: F.aggregate(es, F.slice(es, 1, 0), step)
    return let(let(even, merged), lambda ms: F.array_join(F.concat(F.array(line(ms[0]), line(rule(ms))), F.transform(F.slice(ms, F.lit(2), F.size(ms)), line)), "\n"))


def documents(blocks: DataFrame) -> DataFrame:
    """(doc_id, markdown): the blocks of all pages, each page after its mark."""
    c = F.col
    space = F.when(c("kind").isin("table", "prose"), "\n").otherwise("")
    line = F.struct("page", "block", F.concat("text", space).alias("t"))
    pages = blocks.groupBy(*PAGE).agg(F.array_join(F.transform(F.array_sort(F.collect_list(line)), lambda x: x["t"]), "\n").alias("t"))
    pages = pages.withColumn("t", F.concat(F.lit("<!-- page:"), c("page").cast("string"), F.lit(" -->\n"), c("t")))
    whole = pages.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page", "t"))), lambda x: x["t"]), "\n").alias("t"))
    return whole.select("doc_id", F.concat(strip(F.regexp_replace("t", r"\n{3,}", "\n\n")), F.lit("\n")).alias("markdown"))


# --- text read from images ----------------------------------------------------------------------------------------------


def image_heading(text: Column) -> Column:
    return F.when(matches(text, r"(?i)status of contracts|indent|grn|\bpo\b"), "Cases – Sheet (embedded spreadsheet)").otherwise("Embedded visual")


def structured_ocr(raw: Column) -> Column:
    """Status notes, fields and rules of a sheet read from an image, as Markdown; else its first forty longer lines."""
    lines = F.array_remove(F.transform(F.split(raw, r"\r?\n"), collapsed), "")
    note = lambda t: matches(t, X.OCR_NOTE)
    said = lambda t: (
        F.when(matches(t, X.OCR_STATUS), F.concat(F.lit("**"), F.regexp_replace(t, r":\z", ""), F.lit("**")))
        .when(note(t), F.concat(F.lit("- "), F.regexp_replace(t, r"(?i)^note:\s*", "Note: ")))
        .when(matches(t, X.OCR_FIELD), F.concat(F.lit("- "), t))
    )
    item = lambda t: extract(t, X.OCR_ITEM)
    rule = lambda t: F.when(said(t).isNull(), F.when(F.length(item(t)) > 20, item(t)).when(matches(t, X.OCR_RULE) & (F.length(t) > 24), t))
    key = lambda t: F.substring(F.lower(t), 1, 120)

    def built(a: Column) -> Column:
        out, rules, ls = a["out"], a["rules"], a["ls"]
        once = F.filter(rules, lambda r, i: F.array_position(F.transform(rules, key), key(r)) == i + 1)
        more = F.when(F.size(rules) > 0, F.concat(F.array(F.lit(""), F.lit(X.OCR_RULES_TITLE)), F.transform(once, lambda r: F.concat(F.lit("- "), r)))).otherwise(F.slice(out, 1, 0))
        rest = F.transform(F.slice(F.filter(ls, lambda t: F.length(t) > 12), 1, 40), lambda t: F.concat(F.lit("- "), t))
        return let(F.concat(out, more), lambda all_: F.array_join(F.when(F.size(all_) > 0, all_).otherwise(rest), "\n"))

    return let(lines, lambda ls: let_all(built, ls=ls, out=F.array_compact(F.transform(ls, said)), rules=F.array_compact(F.transform(ls, rule))))


def with_image_texts(docs: DataFrame, images: DataFrame, id: str = "doc_id") -> DataFrame:
    """`docs` (id, markdown) with the texts of their images (id, page, place, heading, confidence, text) put in order: under a heading
    of cases, else after the page's mark, else at the end."""
    section = F.concat(F.lit("\n## "), F.col("heading"), F.lit("\n\n<!-- image:page="), F.col("page").cast("string"), F.lit(" confidence="), F.round("confidence").cast("int").cast("string"), F.lit(" -->\n\n"), F.col("text"), F.lit("\n"))
    item = F.struct("place", F.concat(F.lit("<!-- page:"), F.col("page").cast("string"), F.lit(" -->")).alias("mark"), section.alias("s"))
    lists = images.groupBy(id).agg(F.array_sort(F.collect_list(item)).alias("xs"))  # the images of one document
    cases = r"(?im)^(#{1,3}\s+Cases\b[^\n]*)"

    def put(md: Column, x: Column) -> Column:
        at = F.regexp_instr(md, F.lit(cases)) - 1 + F.length(F.regexp_extract(md, cases, 1))
        mark = F.instr(md, x["mark"]) if isinstance(x["mark"], str) else F.call_function("instr", md, x["mark"])
        split = lambda n: F.concat(F.substring(md, F.lit(1), n), F.lit("\n"), x["s"], F.substring(md, n + 1, F.length(md)))
        return F.when(md.rlike(cases), split(at)).when(mark > 0, split(mark - 1 + F.length(x["mark"]))).otherwise(F.concat(md, F.lit("\n"), x["s"]))

    out = docs.join(lists, id, "left")
    return out.select(id, F.aggregate(F.coalesce("xs", F.array().cast("array<struct<place:int,mark:string,s:string>>")), F.col("markdown"), put).alias("markdown"))

"""Line classifiers and strict line parsers as Column expressions (cascades of the first that applies)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from marginalia.functions import fixed as X
from marginalia.functions.text import clamp_words, extract, infer_readiness, java, let, let_all, matches, read_commitment, reads_as_fragment, sentence_case, strip, title_words, unpunctuated, word_count

TASK, BULLET, NUMBER = r"^\s*[-*]\s+\[([ xX])\]\s+(.*)$", r"^\s*[-*•]\s+(.*)$", r"^\s*(\d{1,3})[.)]\s+(.*)$"
GLYPH = r"^\s*[✓✔✅×✗✘→⇒▸▪▫◦·+]\s*"


def list_item(line: Column) -> Column:
    """STRUCT(marker, done, text): a task, a bullet or a number, in that order; null for other lines."""
    item = lambda marker, done, text: F.struct(F.lit(marker).alias("marker"), done.alias("done"), strip(text).alias("text"))
    no = F.lit(None).cast("boolean")
    return (
        F.when(matches(line, TASK), item("task", F.lower(extract(line, TASK)) == "x", extract(line, TASK, 2)))
        .when(matches(line, BULLET), item("bullet", no, extract(line, BULLET)))
        .when(matches(line, NUMBER), item("number", no, extract(line, NUMBER, 2)))
    )


def item_text(line: Column) -> Column:
    """The text of a list item, or the trimmed line."""
    return F.coalesce(list_item(line)["text"], strip(line))


def table_cells(line: Column) -> Column:
    """Trimmed cells of a table row; null for separators and lines without two cells."""
    return let(F.regexp_replace(F.regexp_replace(strip(line), r"^\|", ""), r"\|\z", ""), lambda flat: let(F.transform(F.split(flat, r"\|"), strip), lambda cells: _cells(line, flat, cells)))


def _cells(line: Column, flat: Column, cells: Column) -> Column:
    usable = line.contains("|") & ~flat.rlike(r"^[\s:|-]+\z") & (F.size(cells) >= 2) & F.exists(cells, lambda c: c != "")
    return F.when(usable, cells)


def is_table_separator(line: Column) -> Column:
    flat = F.regexp_replace(F.regexp_replace(strip(line), r"^\|", ""), r"\|\z", "")
    return line.contains("|") & flat.rlike(r"^[\s:|-]+\z")


def is_structural(line: Column) -> Column:
    flat = strip(line)
    return flat.rlike(r"^(=+|-{3,}|\*{3,}|_{3,})\z") | flat.startswith("```") | flat.rlike(r"(?i)^<!--\s*(page|image):")


def is_decorative(line: Column) -> Column:
    flat = strip(line)
    return (flat == "") | flat.rlike(r"^[↓↑→←⇒⇓|+/\\_.·•\-–—=]{1,4}\z")


def is_list_like(line: Column) -> Column:
    return list_item(line).isNotNull() | matches(line, GLYPH)


def strip_emphasis(text: Column) -> Column:
    out = F.regexp_replace(F.regexp_replace(text, r"\*\*(.+?)\*\*", "$1"), "__(.+?)__", "$1")
    out = F.regexp_replace(out, r"(^|\W)\*(\S(?:.*?\S)?)\*(?=\W|\z)", "$1$2")
    return strip(F.regexp_replace(out, "`([^`]+)`", "$1"))


def plain_content(line: Column) -> Column:
    return strip_emphasis(strip(F.regexp_replace(item_text(line), java(GLYPH), "")))


def date_at_start(text: Column) -> Column:
    return extract(strip(text), X.DATE_AT_START)


def looks_like_date(text: Column) -> Column:
    return matches(strip(text), X.DATE_AT_START)


def tidy_date(date: Column) -> Column:
    return strip(F.regexp_replace(F.regexp_replace(date, r"\.\z", ""), r"\s+", " "))


def find_date(text: Column) -> Column:
    """The first date phrase of a text; bare month names don't count."""
    return tidy_date(extract(text, X.DATE_ANYWHERE))


def without_date(text: Column) -> Column:
    """A text without its first date phrase, tidied at the seams."""
    at = F.regexp_instr(text, F.lit(java(X.DATE_ANYWHERE)))
    n = F.length(F.regexp_extract(text, java(X.DATE_ANYWHERE), 0))
    rest = F.concat(F.substring(text, F.lit(1), at - 1), F.lit(" "), F.substring(text, at + n, F.length(text)))
    return strip(F.regexp_replace(F.regexp_replace(rest, r"\s+", " "), r"^\s*[:—–-]\s*|\s*[:—–-]\s*\z", ""))


def first_separator(text: Column) -> Column:
    """STRUCT(left, right) around the first colon or dash that isn't at the start."""
    p = r"(?s)^(.+?)(?:\s*[:—–]\s+|\s+-\s+)(.*)$"
    return F.when(matches(text, p) & ~text.rlike(r"^(?:\s*[:—–]\s+|\s+-\s+)"), F.struct(strip(extract(text, p)).alias("left"), strip(extract(text, p, 2)).alias("right")))


def paren_suffix(text: Column) -> Column:
    """STRUCT(body, suffix): a closing remark in parentheses, suffix null without one."""
    p = r"^(.*?)\s*\(([^()]{1,80})\)\s*$"
    return F.struct(F.when(matches(text, p), strip(extract(text, p))).otherwise(text).alias("body"), strip(extract(text, p, 2)).alias("suffix"))


def trailing_keyword(text: Column, pattern: str) -> Column:
    """STRUCT(body, keyword) of "text — approved"; null unless the tail has the keyword."""
    p = r"^(.*?)\s+[—–-]\s+(\S[\s\S]{0,40}?)\.?\s*$"
    keyword = extract(strip(extract(text, p, 2)), pattern, 0)
    return F.when(keyword.isNotNull(), F.struct(strip(extract(text, p)).alias("body"), keyword.alias("keyword")))


def trend(text: Column) -> Column:
    low = F.lower(text)
    return (
        F.when(low.rlike(r"(^|\s)(up|grew|growth|increase|increased|▲|\+)"), "up")
        .when(low.rlike(r"(^|\s)(down|fell|decline|declined|decrease|decreased|▼|-[0-9])"), "down")
        .when(matches(low, r"(^|\s)(flat|steady|unchanged|→|holds?)\b"), "flat")
    )


def timeline_state(text: Column) -> Column:
    out = F.lit(None).cast("string")
    for state, pattern in reversed(X.TIMELINE_STATES):
        out = F.when(matches(text, pattern), state).otherwise(out)
    return out


TRAILING_STATE = r"(?i)\b(shipped|released|launched|live|done|complete|completed|closed|on[\s-]?track|in\s+progress|underway|planned|upcoming|scheduled)\b"


def ordinal(text: Column) -> Column:
    """STRUCT(marker, rest) of "Phase 2: …"; null for other texts."""
    flat = strip(text)
    head = extract(flat, X.ORDINAL, 0)
    rest = F.substring(flat, F.length(head) + 1, F.length(flat))
    marker = F.concat(title_words(extract(flat, X.ORDINAL)), F.lit(" "), F.upper(extract(flat, X.ORDINAL, 2)))
    return F.when(head.isNotNull(), F.struct(marker.alias("marker"), strip(F.regexp_replace(rest, r"^\s*[:—–-]\s*", "")).alias("rest")))


def heading(line: Column, following: Column) -> Column:
    """STRUCT(text, level): ATX, underlined by the next line, or a plain line that is a known keyword."""
    atx = r"^\s{0,3}(#{1,6})\s+(.+?)\s*#*\s*$"
    plain = strip(F.regexp_replace(strip(line), r":\z", ""))
    flat = F.regexp_replace(F.lower(plain), r"\s+", " ")
    known = flat.isin([k for k, _ in keyword_rows()]) & (F.length(plain) <= 40) & ~plain.rlike(r"[.!?]\z") & (F.size(F.split(flat, " ")) <= 8)
    found = lambda text, level: F.struct(text.alias("text"), level.cast("int").alias("level"))
    return (
        F.when(matches(line, atx), found(strip(extract(line, atx, 2)), F.length(extract(line, atx))))
        .when(F.coalesce(following.rlike(r"^\s{0,3}(=+|-+)\s*\z"), F.lit(False)) & (strip(line) != ""), found(strip(line), F.when(strip(following).startswith("="), 1).otherwise(2)))
        .when(known, found(plain, F.lit(2)))
    )


def keyword_rows() -> list[tuple[str, str]]:
    """(keyword, kind) in the table's order."""
    return [(k, kind) for kind, line in X.HEADINGS for k in line.split(";")]


def heading_key(text: Column) -> Column:
    out = F.regexp_replace(F.lower(text), r"^[0-9]+(\.[0-9]+)*\.?\s*", "")
    out = F.regexp_replace(out, r"^(slide|deck|page|section)\s+[0-9]+\s*[-—–:.]?\s*", "")
    out = F.regexp_replace(F.regexp_replace(out, r"\s*\(.*\)\s*\z", ""), r":\z", "")
    out = F.regexp_replace(F.regexp_replace(out, "[—–]", "-"), r"\s*-\s*", " - ")
    return strip(F.regexp_replace(out, r"\s+", " "))


def heading_kind(text: Column) -> Column:
    """The memory that a heading names: the whole key first, then the longest keyword at its start, end or inside."""
    rows = keyword_rows()
    table = F.create_map(*[F.lit(x) for row in rows for x in row])
    longest = sorted(range(len(rows)), key=lambda i: (-len(rows[i][0]), i))
    known = F.array(*[F.struct(F.lit(f" {rows[i][0]} ").alias("word"), F.lit(rows[i][1]).alias("kind")) for i in longest])
    padded = lambda k: F.concat(F.lit(" "), k, F.lit(" "))

    def named(k: Column) -> Column:
        hit = lambda p: F.filter(known, lambda x: p["key"].contains(x["word"]) | p["compact"].contains(x["word"]))
        first = let_all(lambda p: F.get(hit(p), F.lit(0))["kind"], key=padded(k["key"]), compact=padded(k["compact"]))
        return F.coalesce(table[k["key"]], table[k["compact"]], first, F.when(k["key"].rlike(r"^as an?\s+"), "actions"))

    compact = lambda key: strip(F.regexp_replace(F.regexp_replace(key, r"\s*-\s*", " "), r"\s+", " "))
    return let(heading_key(text), lambda key: let_all(named, key=key, compact=compact(key)))


# --- strict parsers ---------------------------------------------------------------------------------------------------


def cut(text: Column, n: int) -> Column:
    return F.substring(text, 1, n)


def artifact(text: Column) -> tuple[Column, Column]:
    read = lambda p: sentence_case(clamp_words(unpunctuated(extract(text, p)), 10))
    return read(X.PRODUCES), read(X.REQUIRES)


def _signal(label, value=None, delta=None, trend_=None, implication=None) -> Column:
    none = F.lit(None).cast("string")
    names = ("label", "value", "delta", "trend", "implication")
    return F.struct(*[(none if c is None else c).alias(n) for n, c in zip(names, (label, value, delta, trend_, implication), strict=True)])


def open_question(line: Column) -> Column:
    return let(strip_emphasis(item_text(line)), _open_question)


def _open_question(text: Column) -> Column:
    asks = text.contains("?") | matches(text, r"(?i)\bopen question\b") | matches(text, r"(?i)^(should|what|who|when|where|why|how)\b")
    said = cut(F.regexp_replace(text, r"(?i)^\s*open questions?\s*[:—–-]\s*", ""), 400)
    return F.when((F.length(text) >= 12) & asks, _signal(F.lit("Open question"), implication=said))


def metric_target(line: Column) -> Column:
    return let(strip_emphasis(item_text(line)), _metric_target)


def _metric_target(text: Column) -> Column:
    in_parens, by_dash = r"(?i)\(target:\s*([^)]+)\)", r"(?i)^(.{4,80}?)\s*[—–:-]\s*(.+?)\s*(?:target|goal)\s*[: ]\s*(.+)$"
    body = strip(F.regexp_replace(text, r"(?i)\s*\(target:\s*[^)]+\)", ""))

    def with_target(parts: Column) -> Column:
        label = cut(strip(F.regexp_replace(F.coalesce(parts["left"], body), r":\z", "")), 120)
        detail = F.when(F.coalesce(parts["right"], F.lit("")) != "", cut(parts["right"], 240)).otherwise("Target")
        return let(label, lambda name: F.when(F.length(name) >= 2, _signal(name, cut(strip(extract(text, in_parens)), 120), implication=detail)))

    return F.when(
        F.length(text) >= 12,
        F.when(matches(text, in_parens), let(first_separator(body), with_target))
        .when(matches(text, by_dash), _signal(cut(strip(extract(text, by_dash)), 120), cut(strip(extract(text, by_dash, 3)), 120), implication=cut(strip(extract(text, by_dash, 2)), 240))),
    )


def parse_signal(line: Column) -> Column:
    """STRUCT(label, value, delta, trend, implication) or null."""
    whole = let(F.coalesce(list_item(line)["text"], line), paren_suffix)
    return let_all(lambda a: let(first_separator(a["whole"]["body"]), lambda parts: _signal_of(line, a["cells"], a["whole"], parts)), cells=table_cells(line), whole=whole)


def _signal_of(line: Column, cells: Column, whole: Column, parts: Column) -> Column:
    rest = F.array_join(F.slice(cells, 2, 1000), " ")
    from_cells = F.when((F.get(cells, F.lit(0)) != "") & (F.get(cells, F.lit(1)) != ""), _signal(cells[0], cells[1], F.nullif(F.get(cells, F.lit(2)), F.lit("")), trend(rest)))
    usable = F.length(parts["left"]).between(1, 60) & parts["right"].rlike("[0-9%$€£#<>]")
    delta = F.when(whole["suffix"].rlike(r"[0-9%$€£]") | matches(whole["suffix"], r"(?i)up|down|flat|pts?|pp\b"), whole["suffix"])
    stated = F.when(usable, _signal(parts["left"], parts["right"], delta, trend(F.concat(parts["right"], F.lit(" "), F.coalesce(whole["suffix"], F.lit(""))))))
    return F.coalesce(open_question(line), metric_target(line), from_cells, stated)


def parse_decision(line: Column) -> Column:
    """STRUCT(ref, text, status, commitment, because): priority rows, rows and rules of cases sheets, then a reference, list marker or stated status."""
    return let_all(
        lambda a: let_all(
            lambda b: let_all(lambda c: _decision(a, b, c), whole=paren_suffix(b["rest"]), tail_status=trailing_keyword(b["rest"], X.DECISION_STATUS), tail_commitment=trailing_keyword(b["rest"], X.DECISION_COMMITMENT)),
            ref=extract(a["text"], REF),
            rest=F.when(matches(a["text"], REF), strip(F.regexp_replace(a["text"], REF, ""))).otherwise(a["text"]),
        ),
        cells=table_cells(line),
        text=item_text(line),
        listed=list_item(line).isNotNull(),
        cases=F.coalesce(cases_row(line), cases_rule(line)),
    )


REF = r"^([A-Z]{1,5}-[0-9]{1,4})\s+"


def _decision(a: Column, b: Column, c: Column) -> Column:
    cells, text, listed, ref, rest, whole, tail_status, tail_commitment = a["cells"], a["text"], a["listed"], b["ref"], b["rest"], c["whole"], c["tail_status"], c["tail_commitment"]
    none = F.lit(None).cast("string")
    out = lambda text, status, commitment, ref=none: F.struct(ref.alias("ref"), text.alias("text"), status.alias("status"), commitment.alias("commitment"), none.alias("because"))
    first, second, third = (F.get(cells, F.lit(i)) for i in range(3))
    ranked = matches(first, r"(?i)^P\d\b") | matches(first, r"(?i)^(critical|high|medium|low)\b")
    said = F.concat(first, F.lit(": "), second, F.when(F.coalesce(third, F.lit("")) != "", F.concat(F.lit(" ("), third, F.lit(")"))).otherwise(""))
    priority = F.when(ranked & (F.length(second) >= 3) & (F.lower(second) != "feature"), out(said, F.when(matches(first, r"(?i)^P0\b"), "approved").otherwise("proposed"), F.lit("committed"), F.upper(extract(first, r"(?i)^P\d\b", 0))))
    by_paren_status, by_paren_commitment = matches(whole["suffix"], X.DECISION_STATUS), matches(whole["suffix"], X.DECISION_COMMITMENT)
    status = F.lower(F.when(by_paren_status, extract(whole["suffix"], X.DECISION_STATUS)).when(F.coalesce(by_paren_commitment, F.lit(False)), none).otherwise(tail_status["keyword"]))
    commitment = F.lower(F.when(by_paren_status, none).when(by_paren_commitment, extract(whole["suffix"], X.DECISION_COMMITMENT)).when(tail_status.isNull(), tail_commitment["keyword"]))
    body = F.when(F.coalesce(by_paren_status | by_paren_commitment, F.lit(False)), whole["body"]).otherwise(F.coalesce(tail_status["body"], tail_commitment["body"], rest))
    header = F.lower(strip(F.regexp_replace(text, "['\"`]", ""))).isin("business impact", "priority", "feature", "status", "summary", "overview")

    def judged(d: Column) -> Column:
        said = d["body"]
        stated = d["status"].isNotNull() | d["commitment"].isNotNull()
        reads = (F.size(F.split(said, r"\s+")) >= 3) | said.rlike(r"[.!?]\z")
        settled = F.coalesce(d["status"], F.lit("proposed"))
        usable = (F.length(text) >= 3) & ~header & (ref.isNotNull() | stated | (listed & reads)) & (F.length(said) >= 2)
        how = F.coalesce(d["commitment"], F.when(settled == "approved", "committed"), read_commitment(said))
        return F.when(usable, out(said, settled, how, ref))

    return F.coalesce(priority, a["cases"], let_all(judged, body=body, status=status, commitment=commitment))


def parse_timeline(line: Column) -> Column:
    """STRUCT(date, title, state, produces, requires): dated row, ticket row, obligation, leg, ordinal, date first, date inside."""
    return let_all(_timeline, cells=table_cells(line), text=item_text(line), step=ordinal(item_text(line)))


def _timeline(a: Column) -> Column:
    cells, text, step = a["cells"], a["text"], a["step"]
    none = F.lit(None).cast("string")

    def out(date, title, state, made_of=None):
        produces, requires = artifact(made_of) if made_of is not None else (none, none)
        return F.struct(date.alias("date"), title.alias("title"), state.alias("state"), produces.alias("produces"), requires.alias("requires"))

    first, second, third = F.get(cells, F.lit(0)), F.get(cells, F.lit(1)), F.coalesce(F.get(cells, F.lit(2)), F.lit(""))
    state_of = lambda c: F.coalesce(timeline_state(c), F.lit("planned"))
    dated = F.when((first != "") & looks_like_date(first), out(first, second, state_of(third), F.array_join(F.slice(cells, 2, 1000), ". ")))
    ticket = F.when(matches(first, r"(?i)^[A-Z]{2,}-\d+"), out(first, second, F.when(F.lower(third).contains("priorit"), "planned").otherwise(state_of(third))))
    owed = r"(?i)^(due(?:\s+date)?|dated|date|effective(?:\s+date)?|invoice\s+date|payment\s+due|as\s+of)\s*[:—–-]?\s*(.+)$"
    remainder = strip(extract(text, owed, 2))
    on = F.coalesce(find_date(remainder), F.when(looks_like_date(remainder), remainder))
    obligation = F.when(on.isNotNull(), out(on, cut(F.concat(F.initcap(strip(extract(text, owed))), F.lit(": "), remainder), 200), F.when(matches(extract(text, owed), "(?i)due|payment"), "planned").otherwise("done")))
    leg_p = r"(?i)^(departure|arrival|depart(?:s|ing)?|arriv(?:e|es|al|ing)?)\s*[:—–-]?\s*(.+)$"
    leg_rest = strip(extract(text, leg_p, 2))
    clock = extract(leg_rest, X.DATE_ANYWHERE + r"\s*[·,]?\s*(\d{1,2}:\d{2})\b", 2)
    leg_title = strip(F.regexp_replace(F.concat(F.when(F.lower(extract(text, leg_p)).startswith("arriv"), "Arrival: ").otherwise("Departure: "), leg_rest), r"\s+", " "))
    leg = F.when(find_date(leg_rest).isNotNull(), out(F.concat_ws(" ", find_date(leg_rest), clock), leg_title, F.lit("planned")))
    numbered_by = matches(text, r"(?i)^(phase|step|stage|milestone|sprint|task|iteration)\s")
    tail = trailing_keyword(step["rest"], TRAILING_STATE)
    step_title = F.coalesce(tail["body"], step["rest"])
    step_title = F.when(F.length(step_title) < 2, step["marker"]).otherwise(step_title)
    numbered = F.when(step.isNotNull() & numbered_by, out(step["marker"], step_title, F.coalesce(timeline_state(tail["keyword"]), timeline_state(step["rest"]), F.lit("planned")), step_title))
    leads = extract(text, X.DATE_AT_START, 0)
    date = F.coalesce(tidy_date(extract(text, X.DATE_AT_START)), find_date(text))
    rest = F.when(leads.isNotNull(), strip(F.regexp_replace(F.substring(text, F.length(leads) + 1, F.length(text)), r"^\s*[:—–-]\s*", ""))).otherwise(without_date(text))

    def titled(d: Column) -> Column:
        whole, end = d["whole"], d["end"]
        in_paren = timeline_state(whole["suffix"])
        title = F.when(in_paren.isNotNull(), whole["body"]).otherwise(F.coalesce(end["body"], d["rest"]))
        return let(title, lambda t: F.when(d["date"].isNotNull() & (F.length(d["rest"]) >= 2) & (F.length(t) >= 2), out(d["date"], t, F.coalesce(in_paren, timeline_state(end["keyword"]), F.lit("planned")), t)))

    plain = let_all(lambda d: let_all(titled, date=d["date"], rest=d["rest"], whole=paren_suffix(d["rest"]), end=trailing_keyword(d["rest"], TRAILING_STATE)), date=date, rest=rest)
    return F.coalesce(dated, ticket, obligation, leg, numbered, plain)


def read_risk(text: Column) -> Column:
    """STRUCT(risk, because, consequence) of a sentence in which something goes wrong; null for others."""
    return let(unpunctuated(text), lambda flat: let_all(lambda a: _risk(flat, a["costs"], a["why"], a["consequence"]), costs=extract(flat, X.CONSEQUENCE), why=extract(flat, X.WHY), consequence=sentence_case(clamp_words(unpunctuated(extract(flat, X.CONSEQUENCE)), 18))))


def _risk(flat: Column, costs: Column, why: Column, consequence: Column) -> Column:
    tell = r"(?i)^(.{8,160}?),?\s+(?:but|yet|however|while|with)\s+(.{6,180})$"
    before = lambda p: unpunctuated(F.substring(flat, F.lit(1), F.regexp_instr(flat, F.lit(java(p))) - 1))
    why_inside = why.isNotNull() & (F.regexp_instr(flat, F.lit(java(X.WHY))) > 1)
    reason = F.when(why_inside, sentence_case(clamp_words(unpunctuated(why), 18)))
    reason = F.when(consequence.isNull() | (reason != consequence), reason)
    seen = F.when(costs.isNotNull(), before(X.CONSEQUENCE)).when(why_inside, before(X.WHY)).otherwise(flat)
    return let_all(lambda a: _risk_parts(flat, tell, costs, consequence, a["reason"], a["seen"], a["other"]), reason=reason, seen=seen, other=extract(flat, tell, 2))


def _risk_parts(flat: Column, tell: str, costs: Column, consequence: Column, reason: Column, seen: Column, other: Column) -> Column:
    by_tell = reason.isNull() & matches(other, X.TROUBLE)
    seen = F.when(by_tell, sentence_case(clamp_words(unpunctuated(extract(flat, tell)), 14))).otherwise(seen)
    reason = F.when(by_tell, sentence_case(clamp_words(unpunctuated(other), 16))).otherwise(reason)
    seen = F.regexp_replace(seen, r"(?i)^(?:there is|there's|we have|we see|this is)\s+(?:a\s+)?(?:risk|danger|chance)\s+(?:that|of)\s+", "")
    whole = lambda c: let(c, lambda x: F.when(~reads_as_fragment(x), x))

    def judged(a: Column) -> Column:
        usable = (word_count(flat) >= 4) & (matches(flat, X.TROUBLE) | costs.isNotNull()) & (word_count(a["seen"]) >= 3) & ~reads_as_fragment(a["stated"])
        return F.when(usable, F.struct(a["stated"].alias("risk"), whole(reason).alias("because"), whole(consequence).alias("consequence")))

    return let(seen, lambda x: let_all(judged, seen=x, stated=sentence_case(clamp_words(x, 26))))


def severity_of(text: Column) -> Column:
    word = F.lower(extract(text, X.SEVERITY))
    return F.when(word == "med", "medium").otherwise(F.coalesce(word, F.lit("medium")))


def parse_risk(line: Column) -> Column:
    """STRUCT(risk, severity, mitigation, because, consequence): both severity and mitigation must be stated."""
    return let_all(_risk_line, cells=table_cells(line), text=item_text(line), whole=paren_suffix(item_text(line)))


def _risk_line(a: Column) -> Column:
    cells, text, whole = a["cells"], a["text"], a["whole"]

    def out(risk, severity, mitigation):
        return let(read_risk(risk), lambda read: _graded(read, risk, severity, mitigation))

    def _graded(read, risk, severity, mitigation):
        return F.struct(F.coalesce(read["risk"], risk).alias("risk"), severity.alias("severity"), mitigation.alias("mitigation"), read["because"].alias("because"), read["consequence"].alias("consequence"))

    graded = F.array_position(F.transform(cells, lambda c: matches(c, X.SEVERITY)), F.lit(True)).cast("int")
    plan = strip(F.array_join(F.slice(cells, graded + 1, F.size(cells)), " · "))
    from_cells = F.when((graded > 1) & (cells[0] != "") & (plan != ""), out(cells[0], severity_of(F.get(cells, graded - 1)), plan))
    in_paren = matches(whole["suffix"], X.SEVERITY)
    stated = let(first_separator(F.when(in_paren, whole["body"]).otherwise(text)), lambda parts: _stated_risk(whole, in_paren, parts, out))
    return F.when(cells.isNotNull(), from_cells).otherwise(stated)


def _stated_risk(whole: Column, in_paren: Column, parts: Column, out) -> Column:
    mark = r"(?i)[\[(](high|medium|med|low)[\])]"
    severity = F.when(in_paren, severity_of(whole["suffix"])).when(matches(parts["left"], mark), severity_of(extract(parts["left"], mark)))
    risk = F.when(F.coalesce(in_paren, F.lit(False)), parts["left"]).otherwise(strip(F.regexp_replace(parts["left"], mark, "")))
    mitigation = strip(F.regexp_replace(parts["right"], r"(?i)^mitigation\s*[:—–-]\s*", ""))
    return F.when(severity.isNotNull() & (F.length(risk) >= 3) & (F.length(mitigation) >= 2), out(risk, severity, mitigation))


def parse_action(line: Column) -> Column:
    """STRUCT(task, owner, due, status): user story, table row, (owner, due), three segments.

    Two segments never give an action: a tail that starts with a date has no owner, and no other tail has a date at its start.
    """
    text = item_text(line)
    segments = F.array_remove(F.transform(F.split(text, r"\s+[—–]\s+|\s+-\s+"), strip), "")
    return let_all(_action, cells=table_cells(line), text=text, item=list_item(line), whole=paren_suffix(text), parts=segments)


def _action(a: Column) -> Column:
    cells, text, item, whole, parts = a["cells"], a["text"], a["item"], a["whole"], a["parts"]
    none = F.lit(None).cast("string")
    out = lambda task, status, owner=none, due=none: F.struct(task.alias("task"), owner.alias("owner"), due.alias("due"), status.alias("status"))
    bare = strip_emphasis(text)
    story, persona = r"(?i)^(?:user\s*story|story)\s*[:—–-]\s*(.+)$", r"(?i)^(?:persona\s*[:—–-]\s*)?(as an?\s+.+)$"
    pending = F.lit("pending")
    told = F.when(
        F.length(bare) >= 12,
        F.when(matches(bare, story), out(cut(F.concat(F.lit("User story: "), strip(extract(bare, story))), 500), pending))
        .when(matches(bare, persona) & ~matches(bare, r"(?i)\bi want\b"), out(cut(F.concat(F.lit("Persona: "), strip(extract(bare, persona))), 240), pending))
        .when(matches(bare, r"(?i)^i want\b") & (F.length(bare) >= 20), out(cut(F.concat(F.lit("User story: "), bare), 500), pending)),
    )
    filled = lambda i: F.coalesce(F.get(cells, F.lit(i)), F.lit("")) != ""
    more = F.array_join(F.slice(cells, 4, 1000), " ")
    row = F.when(filled(0) & filled(1) & filled(2), out(cells[0], infer_readiness(F.when(more != "", more).otherwise(cells[0])), cells[1], cells[2]))
    status = infer_readiness(text, item["done"])
    names = F.transform(F.split(whole["suffix"], ","), strip)
    in_paren = F.when((F.get(names, F.lit(0)) != "") & looks_like_date(F.get(names, F.lit(1))), out(whole["body"], status, names[0], names[1]))
    n = F.size(parts)
    last, owner = F.get(parts, n - 1), F.get(parts, n - 2)
    task = F.array_join(F.slice(parts, F.lit(1), F.greatest(n - 2, F.lit(0))), ", ")
    three = F.when((n >= 3) & looks_like_date(last) & (F.length(owner) <= 60) & (F.length(task) >= 3), out(task, status, owner, last))
    return F.coalesce(told, row, F.when(F.length(text) >= 3, F.coalesce(in_paren, three)))


# --- cases sheets and lenient parsers -----------------------------------------------------------------------------------


def _settled(text: Column) -> Column:
    none = F.lit(None).cast("string")
    return F.struct(none.alias("ref"), cut(text, 500).alias("text"), F.lit("approved").alias("status"), F.lit("committed").alias("commitment"), none.alias("because"))


def cases_row(line: Column) -> Column:
    """A decision from a row of a cases sheet: a field, its Y and N flags, and the rule that the remarks state; null for other lines."""
    return let_all(_cases_row, cells=table_cells(line), text=strip_emphasis(item_text(line)))


def _cases_row(a: Column) -> Column:
    cells, text = a["cells"], a["text"]
    cell = lambda i: F.coalesce(F.get(cells, F.lit(i)), F.lit(""))
    field, remarks = cell(0), strip(F.array_join(F.slice(cells, 5, 1000), " "))
    flags = F.regexp_replace(F.concat_ws("/", cell(1), cell(2), cell(3)), r"\|", "")
    usable = (F.size(cells) >= 4) & (field != "") & ~matches(field, X.CASES_HEADER) & matches(cell(1), X.CASES_FLAGS) & matches(cell(2), X.CASES_FLAGS)
    said = F.when(remarks == "", F.concat(field, F.lit(": editability "), flags)).otherwise(F.concat(field, F.lit(" ["), flags, F.lit("] — "), remarks))
    row = F.when((remarks != "") & matches(remarks, X.CASES_RULE), _settled(F.concat(field, F.lit(": "), remarks))).when(~((remarks == "") & flags.rlike(r"^[\-–./]+\z")), _settled(said))
    part = lambda i: extract(text, X.CASES_PROSE, i)
    name, rest = strip(part(1)), strip(part(5))
    ruled = matches(rest, X.CASES_RULE) | (F.length(rest) >= 12)
    prose = F.when(~(matches(name, X.CASES_MODULE) & (F.length(rest) < 8)), F.when(ruled, _settled(F.concat(name, F.lit(": "), rest))).otherwise(_settled(F.concat(name, F.lit(": editability "), F.concat_ws("/", part(2), part(3), part(4))))))
    return F.when(usable, row).when(~((F.size(cells) >= 4) & cells.isNotNull()) | cells.isNull(), F.when(matches(text, X.CASES_PROSE), prose))


def cases_rule(line: Column) -> Column:
    """A decision from a sentence that says what may not be changed; null for other lines."""
    said = lambda t: F.when((F.length(t) >= 20) & matches(t, X.CASES_RULE) & ~matches(t, X.CASES_BARE), _settled(F.regexp_replace(t, r"(?i)^note:\s*", "")))
    return let(strip_emphasis(item_text(line)), said)


def acceptance_criterion(line: Column) -> Column:
    """A decision from a list item that reads as a check of what a system does; null for questions, metrics and rules of cases sheets."""
    none = F.lit(None).cast("string")

    def judged(t: Column) -> Column:
        asks = t.contains("?") | matches(t, r"(?i)^(should|what|who|when|where|why|how)\b")
        does = matches(t, X.PROCEDURAL) | matches(t, X.PROCEDURAL_START)
        fits = F.length(t).between(12, 320) & ~asks & (does | ((F.size(F.split(t, r"\s+")) >= 5) & t.rlike("^[A-Z]")))
        return F.when(fits, F.struct(none.alias("ref"), cut(t, 500).alias("text"), F.lit("proposed").alias("status"), F.lit("committed").alias("commitment"), F.lit("Acceptance criterion").alias("because")))

    return F.when(list_item(line).isNotNull() & metric_target(line).isNull() & cases_rule(line).isNull(), let(strip_emphasis(item_text(line)), judged))


def _entry_text(line: Column, then) -> Column:
    """`then` of a line's plain content of 3 to 300 letters; null for shorter and longer ones."""
    return let(plain_content(line), lambda t: F.when(F.length(t).between(3, 300), then(t)))


def lenient_signal(line: Column) -> Column:
    def read(t: Column) -> Column:
        pair = lambda p: F.when(F.length(p["left"]).between(1, 120) & (F.length(p["right"]) >= 1), _signal(p["left"], cut(p["right"], 120), trend_=trend(p["right"]))).otherwise(_signal(cut(t, 120)))
        return let(first_separator(t), pair)

    return F.coalesce(open_question(line), metric_target(line), _entry_text(line, read))


def salvaged_signal(line: Column) -> Column:
    return F.coalesce(open_question(line), metric_target(line), parse_signal(line))


def lenient_decision(line: Column) -> Column:
    none = F.lit(None).cast("string")
    header = lambda t: F.lower(t).isin("business impact", "priority", "feature", "status", "summary", "overview")
    bare = lambda t: F.when(~header(t) & list_item(line).isNotNull() & (F.size(F.split(t, r"\s+")) >= 2), F.struct(none.alias("ref"), t.alias("text"), F.lit("proposed").alias("status"), read_commitment(t).alias("commitment"), none.alias("because")))
    return F.coalesce(cases_rule(line), cases_row(line), acceptance_criterion(line), parse_decision(line), _entry_text(line, bare))


def lenient_timeline(line: Column) -> Column:
    def read(t: Column) -> Column:
        produces, requires = artifact(without_date(t))
        found = lambda a: F.when(a["date"].isNotNull() & (F.length(a["title"]) >= 2), F.struct(a["date"].alias("date"), a["title"].alias("title"), F.coalesce(timeline_state(t), F.lit("planned")).alias("state"), produces.alias("produces"), requires.alias("requires")))
        return F.coalesce(parse_timeline(line), let_all(found, date=find_date(t), title=without_date(t)))

    return _entry_text(line, read)


def lenient_risk(line: Column) -> Column:
    none = F.lit(None).cast("string")

    def read(t: Column) -> Column:
        told = lambda r: F.struct(F.coalesce(r["risk"], t).alias("risk"), none.alias("severity"), none.alias("mitigation"), r["because"].alias("because"), r["consequence"].alias("consequence"))
        return F.coalesce(parse_risk(line), let(read_risk(t), told))

    return _entry_text(line, read)


def lenient_action(line: Column) -> Column:
    none = F.lit(None).cast("string")
    due = lambda t: F.regexp_replace(extract(t, X.DATE_AT_START), r"\.\z", "")
    read = lambda t: F.struct(t.alias("task"), none.alias("owner"), due(t).alias("due"), infer_readiness(t, list_item(line)["done"]).alias("status"))
    return F.coalesce(parse_action(line), _entry_text(line, read))


def parse_obligation(text: Column) -> Column:
    """STRUCT(date, title, state) of a line like "Due date: …"; null for others."""
    rest = strip(extract(text, X.OBLIGATION, 2))
    head = strip(extract(text, X.OBLIGATION))
    capitals = F.array_join(F.transform(F.split(head, " "), lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 100))), " ")
    on = F.coalesce(find_date(rest), F.when(looks_like_date(rest), rest))
    return F.when(on.isNotNull(), F.struct(on.alias("date"), cut(F.concat(capitals, F.lit(": "), rest), 200).alias("title"), F.when(matches(head, "(?i)due|payment"), "planned").otherwise("done").alias("state")))

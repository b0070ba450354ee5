"""Judgement of single lines and of entries: categories before decisions, restated decisions, honest timelines, insights, memory views.

Line rules are Column expressions; what compares entries of a document folds over that document's list or joins on shared keys.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from marginalia.functions import fixed as X
from marginalia.functions.lines import find_date, looks_like_date
from marginalia.functions.text import clamp_words, content_tokens, extract, java, let, let_all, matches, normalize_key, overlap, reads_as_fragment, sentence_case, stem_tokens, strip, unpunctuated, word_count

# --- categories ---------------------------------------------------------------------------------------------------------


def strongest_category(text: Column) -> Column:
    """requirement, risk or action where a line is one before it could be a decision; null for others."""
    t = strip(text)
    risk, rule = matches(t, X.RISK_SHAPE), matches(t, X.REQUIREMENT_SHAPE)
    return (
        F.when(matches(t, X.PHASE_SHAPE), "requirement")
        .when(risk & (matches(t, X.GRADED_RISK) | ~rule), "risk")
        .when(matches(t, X.ACTION_SHAPE) | matches(t, X.ACTION_META), "action")
        .when(rule, "requirement")
    )


def blocks_decision(text: Column) -> Column:
    return F.coalesce(matches(strip(text), X.PHASE_SHAPE) | strongest_category(text).isin("risk", "action"), F.lit(False))


def commits(text: Column) -> Column:
    return matches(text, X.EXPLICIT_COMMITMENT)


def is_problem(text: Column, title: Column) -> Column:
    """Under a heading of problems or open questions, or a lack without a settled position."""
    return F.coalesce(matches(title, X.PROBLEM_TITLE), F.lit(False)) | (matches(text, X.CANNOT) & ~commits(text))


def slide_decides(text: Column, title: Column) -> Column:
    return ~is_problem(text, title) & commits(text)


# --- decisions that say the same ----------------------------------------------------------------------------------------


def decision_text(text: Column) -> Column:
    out = F.lower(text)
    for pattern, to in X.DECISION_REWRITES:
        out = F.regexp_replace(out, java(pattern), to)
    return F.trim(out)


def is_chrome(text: Column) -> Column:
    """A heading or column name that was read as a decision."""
    key = normalize_key(text)
    return (key == "") | matches(key, X.DECISION_CHROME)


def decision_parts(text: Column) -> Column:
    """What two decisions are compared by."""
    n = decision_text(text)
    named = lambda t: F.filter(F.array(*[F.lit(a) for a in X.DECISION_ANCHORS]), lambda a: t.contains(a))
    return let(n, lambda t: F.struct(normalize_key(text).alias("key"), F.array_distinct(content_tokens(text)).alias("tokens"), t.alias("text"), F.size(content_tokens(t)).alias("n"), F.array_distinct(stem_tokens(t)).alias("stems"), named(t).alias("anchors")))


def same_decision(a: Column, b: Column) -> Column:
    """Of two `decision_parts`: equal in meaning, one inside the other, or enough shared stems and no anchors of their own."""

    def judged(x: Column) -> Column:
        shared, small = x["shared"], F.least(F.size(a["stems"]), F.size(b["stems"]))
        inside = (a["text"].contains(b["text"]) | b["text"].contains(a["text"])) & (F.when(F.length(a["text"]) <= F.length(b["text"]), a["n"]).otherwise(b["n"]) >= 3)
        both = F.size(F.array_intersect(a["anchors"], b["anchors"]))
        apart = (F.size(a["anchors"]) > both) & (F.size(b["anchors"]) > both)
        near = ((shared >= 3) & (shared / small >= 0.62)) | ((both > 0) & ~apart & (shared >= 2) & (shared / small >= 0.45))
        return (a["key"] == b["key"]) | (overlap(a["tokens"], b["tokens"]) >= X.SAME_MEANING) | ((a["text"] != "") & (b["text"] != "") & ((a["text"] == b["text"]) | inside | F.coalesce((small > 0) & near, F.lit(False))))

    return let_all(judged, shared=F.size(F.array_intersect(a["stems"], b["stems"])))


def merged_decisions(entries: Column, keep: tuple[str, ...] = ()) -> Column:
    """Of an array of STRUCT(text, status, commitment, because, ref) restated ones merged into the first: the higher status and
    commitment, the longer text, the first reason and reference.  keep: more fields, of the first."""
    parts = F.transform(F.filter(entries, lambda e: ~is_chrome(e["text"])), lambda e: F.struct(e.alias("e"), decision_parts(e["text"]).alias("p")))
    rank = F.create_map(*[F.lit(x) for kv in X.STATUS_RANKS.items() for x in kv])
    sure = lambda e: F.coalesce(e["commitment"], F.lit("considered")) == "committed"

    def joined(k: Column, x: Column) -> Column:
        a, b = k["e"], x["e"]
        longer = F.length(a["text"]) >= F.length(b["text"])
        e = F.struct(
            F.when(longer, a["text"]).otherwise(b["text"]).alias("text"),
            F.when(rank[a["status"]] >= rank[b["status"]], a["status"]).otherwise(b["status"]).alias("status"),
            F.when(sure(a) | ~sure(b), F.coalesce(a["commitment"], b["commitment"])).otherwise(b["commitment"]).alias("commitment"),
            F.coalesce(a["because"], b["because"]).alias("because"),
            F.coalesce(a["ref"], b["ref"]).alias("ref"),
            *[a[k].alias(k) for k in keep],
        )
        return F.struct(e.alias("e"), F.when(longer, k["p"]).otherwise(x["p"]).alias("p"))

    def step(kept: Column, x: Column) -> Column:
        at = F.array_position(F.transform(kept, lambda k: same_decision(k["p"], x["p"])), F.lit(True))
        return let(at, lambda n: F.when(n == 0, F.array_append(kept, x)).otherwise(F.transform(kept, lambda k, i: F.when(i == n - 1, joined(k, x)).otherwise(k))))

    return let(parts, lambda ps: F.transform(F.aggregate(ps, F.slice(ps, 1, 0), step), lambda k: k["e"]))


def linked_actions(actions: DataFrame, decisions: DataFrame, id: str = "doc_id") -> DataFrame:
    """(id, idx, source): of each action (id, idx, task, source) what it carries out: its stated source, else the reference or text of
    the first decision (id, idx, text, ref) that says the same.  An equi-join on the document and a shared word or the whole key."""
    tokens = lambda t: F.array_distinct(content_tokens(t))
    key = lambda t: F.array_union(F.array(F.concat(F.lit("="), normalize_key(t))), tokens(t))
    a = actions.where("source is null").select(id, F.col("idx").alias("a"), normalize_key(F.col("task")).alias("ka"), tokens(F.col("task")).alias("ta"), F.explode(key(F.col("task"))).alias("k"))
    d = decisions.select(id, F.col("idx").alias("d"), F.coalesce("ref", "text").alias("name"), normalize_key(F.col("text")).alias("kd"), tokens(F.col("text")).alias("td"), F.explode(key(F.col("text"))).alias("k"))
    pairs = a.join(d, [id, "k"]).drop("k").dropDuplicates([id, "a", "d"])
    same = pairs.where((F.col("ka") == F.col("kd")) | (overlap(F.col("ta"), F.col("td")) >= X.SAME_MEANING))
    best = same.groupBy(id, F.col("a").alias("idx")).agg(F.min_by("name", "d").alias("found"))
    return actions.join(best, [id, "idx"], "left").select(id, "idx", F.coalesce("source", "found").alias("source"))


# --- honest timelines ---------------------------------------------------------------------------------------------------


def obligation_confidence(line: Column) -> Column:
    """How sure the date of a line like "Due date: ..." is: high, medium, low or none."""
    rest = strip(extract(strip(line), X.OBLIGATION, 2))
    date = strip(F.coalesce(find_date(rest), F.when(looks_like_date(rest), rest)))
    return F.when(date.isNull(), "none").when(date.rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}"), "high").when(looks_like_date(date) & find_date(date).isNotNull(), "medium").when(F.lower(date).isin("soon", "eventually", "asap", "tbd", "tba"), "none").otherwise("low")


def anchor(text: Column, filename: Column) -> Column:
    """STRUCT(value, confidence, source): a stated date, one in the file's name, or the first full date of the text."""
    stated, named, body = extract(text, X.EXPLICIT_ANCHOR), extract(filename, X.FILE_DATE), extract(text, X.FULL_DATE)
    out = lambda value, sure, source: F.struct(value.alias("value"), F.lit(sure).alias("confidence"), F.lit(source).alias("source"))
    dashed = F.when(F.length(named) == 8, F.regexp_replace(named, "^(.{4})(.{2})(.{2})$", "$1-$2-$3")).otherwise(named)
    return F.when(stated.isNotNull(), out(strip(stated), "high", "explicit")).when(named.isNotNull(), out(dashed, "medium", "filename")).when(body.isNotNull(), out(strip(body), "medium", "body")).otherwise(out(F.lit(None).cast("string"), "none", "none"))


def keeps_date(date: Column, mode: Column, suppress: Column) -> Column:
    """Whether a timeline entry's date is honest for a document of this timeline mode; `suppress`: types that must not invent schedules."""
    d = strip(date)
    relative, marker = matches(d, X.RELATIVE_DATE), matches(d, X.TICKET_ID) | matches(d, X.PHASE_ORDINAL)
    hard = ~marker & ~relative & matches(d, X.HARD_DATE)
    usual = F.when(marker, mode.isin("milestone_chain", "narrative_sequence")).when(relative, ~suppress & (mode != "none")).when(matches(d, X.MONTH_ALONE), ~suppress).otherwise(True)
    return F.when((mode == "none") & suppress, hard).otherwise(usual)


def gated_timeline(entries: DataFrame, id: str = "doc_id") -> DataFrame:
    """`entries` (id, idx, date, title, mode, suppress) with kept and signal, the words of the signal that a demoted entry becomes.

    Mode single_leg keeps the first departure and the first arrival, and where one is missing the next leg.
    """
    leaves, arrives = matches(F.col("title"), r"(?i)\bdepart"), matches(F.col("title"), r"(?i)\barriv")
    rows = entries.withColumn("leg", F.when(leaves, "d").when(arrives, "a"))
    nth = F.row_number().over(Window.partitionBy(id, "leg").orderBy("idx"))
    rows = rows.withColumn("first_leg", F.col("leg").isNotNull() & (nth == 1))
    order = Window.partitionBy(id).orderBy(F.when(F.col("first_leg"), 0).when(F.col("leg").isNotNull(), 1).otherwise(2), "idx")
    rows = rows.withColumn("place", F.row_number().over(order))
    single = F.col("first_leg") | (F.col("leg").isNotNull() & (F.col("place") <= 2))
    kept = F.when(F.col("mode") == "single_leg", single).otherwise(keeps_date(F.col("date"), F.col("mode"), F.col("suppress")))
    out = rows.withColumn("kept", kept).withColumn("signal", F.when(~F.col("kept"), F.concat("date", F.lit(": "), "title")))
    return out.drop("leg", "first_leg", "place")


# --- insights -----------------------------------------------------------------------------------------------------------


def names_phrase(text: Column, phrase: Column) -> Column:
    return (F.length(phrase) >= 4) & F.lower(text).contains(F.lower(phrase))


def insight_score(text: Column, title: Column, concepts: Column) -> Column:
    """Points of a statement of 8 to 42 words; null below 6."""
    t = unpunctuated(text)
    points = lambda cond, n: F.when(F.coalesce(cond, F.lit(False)), n).otherwise(0)

    def scored(s: Column) -> Column:
        total = points(matches(s, X.LEVERAGE), 5) + points(matches(s, X.PHILOSOPHY), 3) + points(matches(s, X.NEGATED), 2) + points(matches(s, X.DECISIVE), 2)
        total = total + F.least(F.lit(4), F.size(F.filter(concepts, lambda c: names_phrase(s, c)))) + points(matches(title, X.INSIGHT_TITLE), 2)
        return let(total, lambda n: F.when(word_count(s).between(8, 42) & ~matches(s, X.EXTRACTIVE) & (n >= 6), n))

    return let(t, scored)


def implication(text: Column) -> Column:
    """What a statement means, by its reason, its contrast or what it shows; else its first 26 words."""
    cases = [F.when(matches(text, p), sentence_case(F.concat(F.lit(a), clamp_words(extract(text, p), n), F.lit(b), clamp_words(extract(text, p, 2), m)))) for p, a, n, b, m in X.IMPLICATIONS]
    return F.coalesce(*cases, sentence_case(clamp_words(text, 26)))


def _long_words(label: Column, said: Column) -> Column:
    return F.filter(F.split(F.lower(F.concat(label, F.lit(" "), F.coalesce(said, F.lit("")))), r"\W+"), lambda w: F.length(w) > 4)


def insights(statements: DataFrame, concepts: DataFrame, signals: DataFrame, id: str = "doc_id") -> DataFrame:
    """(id, rank, line_no, score, label, implication): the three best statements of each document that no signal or better one overlaps.

    statements: (id, line_no, text, section_title); concepts: (id, concepts array<string>, the heaviest first); signals: (id, said
    array<array<string>>, the long words of each).
    """
    rows = statements.join(concepts, id, "left").withColumn("concepts", F.coalesce("concepts", F.array().cast("array<string>")))
    rows = rows.withColumn("score", insight_score(F.col("text"), F.col("section_title"), F.col("concepts"))).where("score is not null")
    t = unpunctuated(F.col("text"))
    theme = F.get(F.filter("concepts", lambda c: names_phrase(t, c)), F.lit(0))
    label = sentence_case(clamp_words(F.coalesce(theme, "section_title", F.lit("Hero insight")), 8))
    rows = rows.select(id, "line_no", "score", label.alias("label"), implication(t).alias("implication")).where(~reads_as_fragment(F.col("implication")))
    item = F.struct((-F.col("score")).alias("order"), "line_no", "score", "label", "implication", _long_words(F.col("label"), F.col("implication")).alias("w"))
    lists = rows.groupBy(id).agg(F.array_sort(F.collect_list(item)).alias("xs")).join(signals, id, "left")
    alike = lambda l, r: (F.size(l) > 0) & (F.size(r) > 0) & (F.size(F.filter(r, lambda w: F.array_contains(l, w))) / F.least(F.size(F.array_distinct(l)), F.size(r)) >= 0.6)
    fresh = F.filter("xs", lambda x: ~F.exists(F.coalesce("said", F.array().cast("array<array<string>>")), lambda s: alike(s, x["w"])))
    fold = lambda xs: F.aggregate(xs, F.slice(xs, 1, 0), lambda acc, x: F.when((F.size(acc) >= 3) | F.exists(acc, lambda k: alike(k["w"], x["w"])), acc).otherwise(F.array_append(acc, x)))
    best = lists.select(id, F.posexplode(let(fresh, fold)).alias("rank", "x"))
    return best.select(id, (F.col("rank") + 1).alias("rank"), "x.line_no", "x.score", "x.label", "x.implication")


# --- views of the six memories ------------------------------------------------------------------------------------------


def memory_views(blocks: DataFrame, id: str = "doc_id") -> DataFrame:
    """(id, place, kind, title): the blocks (id, archetype, kind, n) that a document shows, in order.

    Resume, invoice and research leave out empty memories but the snapshot; every other type shows all six.
    """
    rows = [(a, k, i, t) for a, kinds in X.MEMORY_TITLES.items() for i, (k, t) in enumerate(kinds.items())]
    known = [a for a in X.MEMORY_TITLES if a != "generic"]
    table = F.create_map(*[x for a, k, i, t in rows for x in (F.lit(f"{a} {k}"), F.struct(F.lit(i).alias("ord"), F.lit(t).alias("title")))])
    view = F.when(F.col("archetype").isin(*known), F.col("archetype")).otherwise("generic")
    out = blocks.select(id, "kind", "n", view.alias("view"), table[F.concat_ws(" ", view, "kind")].alias("v"))
    out = out.where((F.col("view") == "generic") | (F.col("n") > 0) | (F.col("kind") == "snapshot"))
    order = Window.partitionBy(id).orderBy("v.ord")
    return out.select(id, F.row_number().over(order).alias("place"), "kind", F.col("v.title").alias("title"))


# --- labels from concepts -----------------------------------------------------------------------------------------------


def concept_of(sentence: Column, concepts: Column) -> Column:
    """The heaviest concept that a sentence names, else its first six content words."""
    key = normalize_key(sentence)
    named = lambda k: F.get(F.filter(concepts, lambda c: k.contains(normalize_key(c))), F.lit(0))
    return F.coalesce(let(key, named), F.array_join(F.slice(content_tokens(sentence), 1, 6), " "))

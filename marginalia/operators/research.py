"""Research papers: section roles, cleaned sentences, claims, metrics, limitation themes, and the knowledge graph of each paper.

Sentences are rows with their section and place; per-section caps, themes and ranks are windows over one paper, nothing is compared
all with all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from marginalia.functions import fixed as X
from marginalia.functions.lines import list_item, plain_content
from marginalia.functions.text import extract, java, let, let_all, matches, split_sentences, strip, word_count
from marginalia.operators.graphs import node_id
from marginalia.operators.repair import clamped
from marginalia.operators.structure import headed_lines
from marginalia.runtime import stored


def role(title: Column) -> Column:
    """The role of a section by its heading; other without one."""
    out = F.lit("other")
    for name, pattern in reversed(X.RESEARCH_ROLES):
        out = F.when(matches(title, pattern), name).otherwise(out)
    return out


def section_lines(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, section, title, role, first_line, line_no, line): the lines under each heading, without the heading."""
    whole = Window.partitionBy(id, "section")
    rows = headed_lines(docs, id, text).withColumn("title", F.max(F.col("heading")["text"]).over(whole)).where("heading is null").drop("heading")
    return rows.withColumns({"role": role(F.col("title")), "first_line": F.min("line_no").over(whole)})


def _sentences(rows: DataFrame, clean, least: int) -> DataFrame:
    raw = clean(plain_content(F.col("line")))
    body = let(raw, lambda r: F.coalesce(list_item(r)["text"], r))
    parts = F.transform(split_sentences(body), clean)
    rows = rows.select("*", F.posexplode(parts).alias("at", "sentence")).drop("line")
    return rows.where(word_count(F.col("sentence")) >= least)


# --- claims and the graph -----------------------------------------------------------------------------------------------


def citations(text: Column) -> Column:
    """Labels of the citations in a sentence, in order: the numbers between brackets, or names and year with their parentheses."""
    both = f"{X.CITATION_NUMBERS}|{X.CITATION_NAMES}"
    return F.transform(F.regexp_extract_all(text, F.lit(both), F.lit(0)), lambda m: F.regexp_replace(m, r"^\[|\]\z", ""))


def claim_kind(sentence: Column, section_role: Column) -> Column:
    motive = section_role.isin("abstract", "introduction", "hypothesis") & matches(sentence, X.CLAIM_GAP)
    return (
        F.when(matches(sentence, X.CLAIM_METRIC), "metric")
        .when((section_role == "limitations") | matches(sentence, X.CLAIM_LIMIT), "limitation")
        .when((section_role == "future") | matches(sentence, X.CLAIM_FUTURE), "future_work")
        .when(motive, "research_gap")
        .otherwise("claim")
    )


def claims(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, section, title, role, first_line, line_no, at, sentence, kind, cites): the first 24 sentences of each section, without tables."""
    return claims_of(section_lines(docs, id, text), id)


def claims_of(lines: DataFrame, id: str = "doc_id") -> DataFrame:
    """The claims of rows of `section_lines`."""
    rows = _sentences(lines.where("role <> 'references'"), lambda t: strip(F.regexp_replace(t, r"\s+", " ")), 4)
    order = Window.partitionBy(id, "section").orderBy("line_no", "at")
    rows = rows.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= X.CLAIMS_OF_SECTION).drop("_n")
    s = F.col("sentence")
    rows = rows.where(~s.contains("|") & ~(matches(s, X.SCOREBOARD) & (word_count(s) < 20)))
    return rows.withColumns({"kind": claim_kind(s, F.col("role")), "cites": F.slice(citations(s), 1, X.CITES_OF_CLAIM)})


def entity_key(kind: Column, label: Column) -> Column:
    return F.concat(kind, F.lit("::"), F.substring(strip(F.regexp_replace(F.lower(label), r"\s+", " ")), 1, 120))


def graph(claimed: DataFrame, papers: DataFrame, sections: DataFrame, id: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of every paper.

    claimed: rows of `claims`; papers: (id, title); sections: (id, section, title, role, first_line) of the sections that count.
    nodes: (id, id, kind, label, role, location, ord), one for each kind and label; edges: (id, source, target, relation, confidence, ord):
    what the text states, and inferred links from the first gaps, metrics and limits to the first findings.

    All mentions of a paper in order are one stored table: each with the node it stands for and the paper, section or claim it hangs on, so
    nothing is joined.
    """
    c = F.col
    none = F.lit(None).cast("string")
    place = lambda *xs: F.concat_ws(".", *[F.lpad(x.cast("string"), 6, "0") for x in xs])
    zero = F.lit(0)

    def node(kind: Column, label: Column, named: Column, role_: Column, location: Column, ord_: Column) -> Column:
        return F.struct(kind.alias("kind"), label.alias("label"), node_id(kind, named).alias("id"), role_.alias("role"), location.alias("location"), ord_.alias("ord"))

    paper = papers.select(id, F.lit(-1).alias("section"), none.alias("within"), node(F.lit("paper"), c("title"), c("title"), none, F.lit("title"), F.lit("")).alias("n"))
    label = F.coalesce("title", "role")
    location = F.coalesce(F.concat(F.lit("L"), c("first_line").cast("string")), c("role"))
    section = node(F.lit("section"), label, F.concat_ws(":", "role", label), c("role"), location, place(c("section"), zero, zero, zero))
    cut = F.substring("sentence", 1, 160)
    claim = node(c("kind"), cut, cut, none, location, place(c("section"), c("line_no"), c("at") + 1, zero))
    cites = F.transform("cites", lambda m, i: node(F.lit("citation"), F.substring(F.concat(F.lit("cite:"), m), 1, 120), m, none, location, place(c("section"), c("line_no"), c("at") + 1, i + 1)))
    given = sections.select(id, "section", none.alias("within"), section.alias("n"))
    said = claimed.select(id, "section", c("role").alias("within"), F.explode(F.concat(F.array(claim), cites)).alias("n"))
    found = paper.union(given).union(said).select(id, "section", "within", "n.*").withColumn("key", entity_key(c("kind"), c("label")))
    # Each mention stands for the first node of its kind and label.
    first = Window.partitionBy(id, "key").orderBy("ord")
    found = found.repartition(id).withColumns({"node": F.first("id").over(first), "nth": F.row_number().over(first)})
    # In order, a section stands before its claims, a claim before its citations.
    whole = Window.partitionBy(id)
    so_far = whole.orderBy("ord").rowsBetween(Window.unboundedPreceding, 0)
    is_ = lambda *kinds: c("kind").isin(*kinds)
    claims_ = ~is_("paper", "section", "citation")
    shown = claims_ & c("within").isin("results", "conclusion")
    last = lambda where, *xs: F.last(F.when(where, F.struct(*xs)), ignorenulls=True).over(so_far)
    found = found.withColumns({"top": last(is_("paper"), "node"), "under": last(is_("section"), "section", "node"), "of": last(claims_, "node"), "only_metrics": ~F.max(shown & ~is_("metric")).over(whole)})
    found = found.withColumn("finds", shown & (c("only_metrics") | ~is_("metric")))
    nth = lambda where: F.when(where, F.count_if(where).over(so_far)).cast("int")
    found = found.withColumns({"n": F.coalesce(*[nth(is_(k)) for k in ("research_gap", "metric", "limitation")]), "fn": nth(c("finds"))}).drop("key")
    found = stored(found, "mentions")
    nodes = found.where("nth = 1").select(id, "id", "kind", "label", "role", "location", "ord")
    over = F.when(is_("section"), c("top.node")).when(c("under.section") == c("section"), F.when(is_("citation"), c("of.node")).otherwise(c("under.node")))
    relation = F.when(is_("section"), "contains").when(is_("citation"), "cites").otherwise(F.create_map(*[F.lit(x) for kv in X.CLAIM_RELATIONS.items() for x in kv])[c("kind")])
    stated = found.where(~is_("paper")).select(id, over.alias("source"), c("node").alias("target"), relation.alias("relation"), F.lit("EXTRACTED").alias("confidence"), F.concat_ws(".", place(zero), "ord").alias("ord")).where("source is not null")
    # The first few of each part, numbered within the paper; links between these few are made in its row.
    few = lambda where, n: F.array_sort(F.collect_list(F.when(where, F.struct(c(n).alias("n"), c("node").alias("x")))))
    part = lambda kind, most: few(is_(kind) & (c("n") <= most), "n")
    finding = F.when(c("finds"), c("node"))
    parts = found.where(claims_ & c("under.section").eqNullSafe(c("section")) & F.coalesce("n", "fn").isNotNull()).groupBy(id).agg(
        part("research_gap", 3).alias("gaps"), part("metric", 6).alias("metrics"), part("limitation", 4).alias("limits"), few(c("fn") <= 4, "fn").alias("findings"), F.max("only_metrics").alias("only_metrics"), F.min(finding).alias("least"), F.max(finding).alias("most")
    )

    def links(xs, ys, relation_: str, ord_) -> Column:
        link = lambda x, y: F.struct(x["x"].alias("source"), y["x"].alias("target"), F.lit(relation_).alias("relation"), F.lit("INFERRED").alias("confidence"), ord_(x, y).alias("ord"))
        return F.flatten(F.transform(xs, lambda x: F.transform(ys, lambda y: link(x, y))))

    at = lambda step: lambda x, y: place(F.lit(step), x["n"], zero, y["n"], zero)
    # A metric that is the only finding, or stands where no finding is in words, is what the gaps lead to.
    alone = F.filter("metrics", lambda m: c("only_metrics") | c("least").isNull() | ((c("least") == m["x"]) & (c("most") == m["x"])))
    inferred = F.concat(
        links("gaps", c("findings"), "addressed_by", at(1)),
        F.filter(links("metrics", c("findings"), "supports", at(2)), lambda e: e["source"] != e["target"]),
        links(F.slice("gaps", 1, 2), alone, "addressed_by", lambda g, m: place(F.lit(2), m["n"], F.lit(1), g["n"], zero)),
        links("limits", F.slice("findings", 1, 3), "qualifies", at(3)),
    )
    edges = stated.union(parts.select(id, F.inline(inferred))).groupBy(id, "source", "target", "relation").agg(F.min_by("confidence", "ord").alias("confidence"), F.min("ord").alias("ord"))
    return nodes, edges


# --- cleaned sentences, findings, metrics, limits ----------------------------------------------------------------------


def dehyphenated(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, "([A-Za-z])­([a-z])", "$1$2"), r"([A-Za-z])-\s+([a-z])", "$1$2")


def without_citations(text: Column) -> Column:
    """Without author-year and numbered citations."""
    names = r"[A-Z][A-Za-z-]+(?:\s+et\s+al\.)?,?\s*[0-9]{4}(?:[a-z])?"
    out = F.regexp_replace(text, rf"\s*\[(?:{names}(?:\s*;\s*[^\\\]]{{0,80}})?)\]", "")
    out = F.regexp_replace(out, rf"\s*\((?:{names}(?:\s*;\s*[^)]{{0,80}})?)\)", "")
    out = F.regexp_replace(out, r"\s*\[[0-9]+(?:\s*[,–-]\s*[0-9]+)*\]", "")
    return strip(F.regexp_replace(out, r"\s{2,}", " "))


def clean_sentence(text: Column) -> Column:
    return without_citations(dehyphenated(strip(F.regexp_replace(text, r"\s+", " "))))


def letters_of(word: Column, more: str = "") -> Column:
    return F.regexp_replace(word, f"[^A-Za-z{more}]", "")


def is_stump(word: Column) -> Column:
    """A rest of a word that a cut left: no vowel, or a known ending."""
    t = letters_of(word)
    return F.length(t).between(2, 8) & ~F.lower(t).isin(X.STOP_OPENERS) & (~t.rlike("(?i)[aeiouy]") | matches(t, X.WORD_STUMP))


def garbled(text: Column) -> Column:
    """Prose that a page's layout broke: cut words, open hyphens, citations run into the text, mostly tiny words."""

    def judged(a: Column) -> Column:
        s, words, first = a["s"], a["words"], a["first"]
        tiny = F.size(F.filter(words, lambda w: w.rlike(r"^[A-Za-z]{1,2}\z")))
        return (
            (s == "")
            | (s.rlike("^[a-z]") & (F.length(first) <= 8) & ~F.lower(first).isin(X.STOP_OPENERS))
            | is_stump(first)
            | s.rlike(r"\([0-9]+\z")
            | matches(s, r"\b[0-9]+\s*[-–—]\s*$")
            | s.rlike(r"[A-Za-z]-\s+[a-z]")
            | matches(s, r"\[[^\]]{0,40}\b(?:The|We|This|Our|In|A)\b")
            | matches(s, r"\b[0-9]{4}\]\s*[A-Z][a-z]")
            | ((F.size(words) < 8) & ~s.rlike(r"[.!?]\z") & s.rlike("^[a-z]"))
            | ((F.size(words) >= 8) & (tiny / F.size(words) > 0.35))
        )

    split = lambda s: let_all(judged, s=s, words=F.split(s, r"\s+"), first=letters_of(F.get(F.split(s, r"\s+"), F.lit(0)), "'"))
    return let(strip(text), split)


def garbled_label(label: Column) -> Column:
    def judged(a: Column) -> Column:
        s, first = a["s"], a["first"]
        return (F.length(s) < 3) | s.rlike(r"\([0-9]+\z") | matches(s, r"\b[0-9]+\s*[-–—]\s*$") | is_stump(first) | s.rlike(r"^[A-Za-z]\s+\w+") | (s.rlike("^[a-z]") & ~F.lower(first).isin(X.STOP_OPENERS))

    return let(strip(label), lambda s: let_all(judged, s=s, first=letters_of(F.get(F.split(s, r"\s+"), F.lit(0)), "'")))


def table_dump(text: Column) -> Column:
    """Rows of a table: bars, rules of dashes, or hardly more words than numbers."""
    s = strip(text)
    numbers = F.regexp_count(s, F.lit(r"[0-9]+(?:\.[0-9]+)?"))
    return (s == "") | s.contains("|") | s.rlike(r"^:?-{3,}") | ((numbers >= 4) & (word_count(s) <= numbers + 6))


def metric_heavy(text: Column) -> Column:
    return (F.regexp_count(text, F.lit(r"[0-9]+(?:\.[0-9]+)?%?")) >= 2) | (matches(text, X.RESEARCH_METRIC) & (word_count(text) <= 18))


def claim_score(sentence: Column) -> Column:
    """Points for a whole sentence with a claim; fewer for surveys of others' work, own method, numbers; far fewer if garbled."""
    n, low = word_count(sentence), F.lower(sentence)
    if_ = lambda cond, points: F.when(cond, points).otherwise(0)
    length = F.when(n.between(10, 45), 2).when(n >= 8, 1).otherwise(0)
    return (
        length
        + if_(sentence.rlike(r"[.!?]\z"), 1)
        + if_(matches(low, X.CLAIM_VERBS), 3)
        + if_(matches(low, X.CLAIM_TERMS), 3)
        - if_(matches(low, X.RELATED_WORK), 5)
        - if_(matches(low, X.OWN_METHOD), 1)
        - if_(metric_heavy(sentence), 1)
        - if_(garbled(sentence), 10)
    )


def sentences(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, section, title, role, first_line, line_no, at, sentence): cleaned, of six words at least, not garbled."""
    return _sentences(section_lines(docs, id, text), clean_sentence, 6).where(~garbled(F.col("sentence")))


def metric_label(before: Column) -> Column:
    """A label from the words before a number: without clause openers, cut words and lower-case starts; its last six words."""
    s = strip(F.regexp_replace(before, r"\s+", " "))
    s = strip(F.regexp_replace(s, r"[\s(\[:\-–—,;]+\z", ""))
    s = F.regexp_replace(s, r"(?i)^(?:results?\s+)?(?:demonstrate|show|shows|showed|achieve|achieves|report|reports)\s+", "")
    s = F.regexp_replace(s, r"(?i)^(?:strong|modest|weak|high|low|extreme)\s+", "")
    s = F.regexp_replace(s, java(r"(?i)\b(?:particularly|especially|namely)\s+"), "")
    words = F.array_remove(F.split(s, r"\s+"), "")
    good = lambda w: ~(is_stump(w) | (w.rlike("^[a-z]") & ~F.lower(w).isin(X.STOP_OPENERS)))

    def named(ws: Column) -> Column:
        at = F.array_position(F.transform(ws, good), F.lit(True)).cast("int")
        kept = F.when(at > 0, F.slice(ws, at, F.size(ws))).otherwise(F.slice(ws, 1, 0))
        return let(kept, lambda k: F.array_join(F.slice(k, F.greatest(F.size(k) - 5, F.lit(1)), F.lit(6)), " "))

    def finished(label: Column) -> Column:
        bare = strip(F.regexp_replace(strip(F.regexp_replace(label, r"\s*\(\s*\z", "")), r"(?i)^(?:on|of|for|in|at|to|with)\s+", ""))
        return let(F.concat(F.upper(F.substring(bare, 1, 1)), F.substring(bare, F.lit(2), F.length(bare))), lambda x: F.when((x == "") | garbled_label(x), "Measured result").otherwise(clamped(x, 72)))

    return let(let(words, named), finished)


_RANGE, _SINGLE = r"[0-9]+(?:\.[0-9]+)?\s*[-–—]\s*[0-9]+(?:\.[0-9]+)?%\s*(?:F1|accuracy|recall|precision)?", r"[0-9]+(?:\.[0-9]+)?%"


def metrics(sentence: Column) -> Column:
    """array<STRUCT(label, value)>: ranges, then single percentages outside of them, four at most; then points; else the first number."""
    item = lambda label, value: F.struct(label.alias("label"), value.alias("value"))
    found = F.regexp_extract_all(sentence, F.lit(f"(?i){_RANGE}|{_SINGLE}"), F.lit(0))
    start = F.struct(F.array().cast("array<struct<text:string,at:int>>").alias("out"), F.lit(1).alias("from"))

    def placed(acc: Column, m: Column) -> Column:
        at = F.call_function("locate", m, sentence, acc["from"])
        return F.struct(F.array_append(acc["out"], F.struct(m.alias("text"), at.alias("at"))).alias("out"), (at + F.length(m)).alias("from"))

    spots = F.aggregate(found, start, placed, lambda a: a["out"])
    is_range = lambda m: m["text"].rlike(r"[0-9]\s*[-–—]\s*[0-9]")
    parts = r"(?i)^([0-9]+(?:\.[0-9]+)?)\s*[-–—]\s*([0-9]+(?:\.[0-9]+)?)%\s*(F1|accuracy|recall|precision)?$"

    def read(m: Column) -> Column:
        unit = F.nullif(F.regexp_extract(m["text"], java(parts), 3), F.lit(""))
        ranged = F.concat(extract(m["text"], parts), F.lit("–"), extract(m["text"], parts, 2), F.lit("%"), F.coalesce(F.concat(F.lit(" "), unit), F.lit("")))
        label = metric_label(F.substring(sentence, F.lit(1), m["at"] - 1))
        return let(label, lambda lab: F.when(is_range(m), item(F.when((lab == "Measured result") & unit.isNotNull(), F.concat(unit, F.lit(" range"))).otherwise(lab), ranged)).otherwise(item(lab, m["text"])))

    ordered = F.concat(F.filter(spots, is_range), F.filter(spots, lambda m: ~is_range(m)))
    entries = F.filter(F.transform(ordered, read), lambda e: ~garbled_label(e["label"]))
    unique = lambda es: F.filter(es, lambda e, i: ~F.exists(F.slice(es, F.lit(1), i), lambda o: (F.lower(o["label"]) == F.lower(e["label"])) & (o["value"] == e["value"])))

    def ended(es: Column) -> Column:
        points = F.transform(F.slice(F.regexp_extract_all(sentence, F.lit(r"(?i)within\s+([0-9]+(?:\.[0-9]+)?)\s*points?"), F.lit(1)), 1, 2), lambda p: item(F.lit("Gap vs baseline"), F.concat(p, F.lit(" points"))))
        all_ = F.when(F.size(es) >= 4, F.slice(es, 1, 4)).otherwise(F.concat(es, F.array_distinct(points)))
        first = F.coalesce(extract(sentence, r"[0-9]+(?:\.[0-9]+)?%?", 0), F.lit("see source"))
        return let(all_, lambda out: F.when((F.size(out) == 0) & matches(sentence, X.RESEARCH_METRIC), F.array(item(F.lit("Measured result"), first))).otherwise(out))

    return let(let(entries, unique), ended)


def without_opener(sentence: Column) -> Column:
    """A sentence without "we study", "this paper" and the like; garbled rests stay as they are."""
    s = clean_sentence(sentence)
    s = F.regexp_replace(F.regexp_replace(s, java(X.META_OPENER), ""), r"^[,:\s-]+", "")
    s = F.regexp_replace(s, r"(?i)^(?:this\s+work\s+)?addresses\s+a\s+fundamental\s+question:\s*", "")
    s = F.regexp_replace(s, r"(?i)^we\s+(?:study|investigate|examine|ask|test)\s+", "")
    s = F.regexp_replace(s, r"(?i)^whether\s+", "Whether ")
    return let(s, lambda x: F.when(garbled(x) | x.rlike("^[A-Z]"), strip(x)).otherwise(strip(F.concat(F.upper(F.substring(x, 1, 1)), F.substring(x, F.lit(2), F.length(x))))))


def limitation_themes(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, rank, theme, risk): up to six limits of a paper.

    In a section on limits a stated theme ("Dataset scope: ...") takes the sentences after it; elsewhere explicit limits open themes.
    """
    s = F.col("sentence")
    rows = sentences(docs, id, text).where(~matches(s, X.LIMIT_INTRO))
    own = F.col("role") == "limitations"
    rows = rows.where(own | (F.col("role").isin("discussion", "conclusion") & matches(s, X.EXPLICIT_LIMIT))).where(own | ~matches(s, r"(?i)\bhallucin"))
    guess = F.lit("Limitation")
    for name, pattern in reversed(X.LIMIT_THEMES):
        guess = F.when(matches(s, pattern), name).otherwise(guess)
    order = Window.partitionBy(id).orderBy(F.when(own, 0).otherwise(1), "section", "line_no", "at")
    stated = matches(s, X.STATED_THEME)
    first = F.row_number().over(order) == 1
    opens = stated | ~own | first
    rows = rows.withColumns({"theme": F.when(stated, strip(extract(s, X.STATED_THEME))).when(opens, guess), "claim": F.when(stated, strip(extract(s, X.STATED_THEME, 2))).when(opens, without_opener(s)).when(word_count(s) >= 5, s)})
    rows = rows.withColumns({"bucket": F.sum(F.when(F.col("theme").isNotNull(), 1).otherwise(0)).over(order.rowsBetween(Window.unboundedPreceding, 0)), "place": F.row_number().over(order)})
    rows = rows.withColumn("claim", clean_sentence(F.col("claim"))).where("claim is not null")
    kept = F.filter(F.array_sort(F.collect_list(F.when((word_count(F.col("claim")) >= 4) & ~matches(F.col("claim"), X.LIMIT_INTRO), F.struct("place", "claim")))), lambda x: x.isNotNull())
    groups = rows.groupBy(id, "bucket").agg(F.max("theme").alias("theme"), kept.alias("cs")).where("size(cs) > 0")
    lower = lambda c: F.concat(F.lower(F.substring(c, 1, 1)), F.substring(c, F.lit(2), F.length(c)))
    bare = lambda c, most: F.regexp_replace(clamped(c, most), r"\.\z", "")
    core = bare(F.col("cs")[0]["claim"], 130)
    more = bare(F.regexp_replace(F.get("cs", F.lit(1))["claim"], r"(?i)^(while|although|however|though|this)\s+", ""), 90)
    body = F.when(F.coalesce(more, F.lit("")) != "", F.concat(core, F.lit("; "), lower(more))).otherwise(core)
    risk = F.when(F.col("theme") == "Limitation", clamped(F.concat(body, F.lit(".")), 220)).otherwise(clamped(F.concat("theme", F.lit(" — "), lower(body), F.lit(".")), 220))
    groups = groups.select(id, "bucket", "theme", risk.alias("risk")).where(~garbled(F.col("risk")) & (word_count(F.col("risk")) >= 4))
    item = F.struct("bucket", "theme", "risk")
    lists = groups.groupBy(id).agg(F.array_sort(F.collect_list(item)).alias("xs"))  # the themes of one paper
    again = lambda acc, x: F.exists(acc, lambda k: F.lower(k["risk"]).startswith(F.lower(x["theme"])) | (F.lower(k["risk"]) == F.lower(x["risk"])))
    fold = F.aggregate("xs", F.slice("xs", 1, 0), lambda acc, x: F.when((F.size(acc) >= 6) | again(acc, x), acc).otherwise(F.array_append(acc, x)))
    return lists.select(id, F.posexplode(fold).alias("rank", "x")).select(id, (F.col("rank") + 1).alias("rank"), "x.theme", "x.risk")

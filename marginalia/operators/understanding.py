"""Understanding of whole documents: document type, intent, key concepts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from marginalia.functions import fixed as X
from marginalia.functions.text import content_tokens, extract, java, let, let_all, matches, normalize_key, stem, stem_tokens, strip, tokenize, unpunctuated
from marginalia.operators.statements import sentences


def body_sample(text: Column) -> Column:
    """The first 80 lines that aren't blank, at most 4000 letters."""
    kept = F.slice(F.filter(F.split(text, "\n"), lambda line: F.trim(line) != ""), 1, 80)
    return F.substring(F.array_join(kept, "\n"), 1, 4000)


def archetype_scores(haystack: Column) -> dict[str, Column]:
    out = {}
    for kind in ("resume", "research", "invoice"):
        hits = [F.when(matches(haystack, p), w).otherwise(0) for k, _, w, p in X.ARCHETYPE_CUES if k == kind]
        out[kind] = sum(hits[1:], hits[0])
    return out


def archetypes(docs: DataFrame, id: str = "doc_id", text: str = "text", sampled: bool = False) -> DataFrame:
    """(id, resume, research, invoice, archetype, label, timeline_mode): the best score wins if it is high and clear enough.

    sampled: the text is the title, the headings and a `body_sample` already."""
    t = F.coalesce(F.col(text), F.lit(""))
    t = t if sampled else body_sample(t)
    scored = docs.select(id, t.alias("_t")).select(id, *[c.cast("int").alias(k) for k, c in archetype_scores(F.col("_t")).items()])
    ranked = F.sort_array(F.array("resume", "research", "invoice"), asc=False)
    clear = (ranked[0] >= X.ARCHETYPE_LEAST) & (ranked[0] - ranked[1] >= X.ARCHETYPE_MARGIN)
    best = F.when(~clear, "generic").when(F.col("resume") == ranked[0], "resume").when(F.col("research") == ranked[0], "research").otherwise("invoice")
    out = scored.withColumn("archetype", best)
    labels = F.create_map(*[F.lit(x) for kv in X.ARCHETYPE_LABELS.items() for x in kv])
    return out.withColumn("label", labels[F.col("archetype")]).withColumn("timeline_mode", F.when(F.col("archetype") == "invoice", "obligation_deadlines").otherwise("narrative_sequence"))


def intents(docs: DataFrame, id: str = "doc_id", text: str = "text", title: Column | None = None, headings: Column | None = None) -> DataFrame:
    """(id, instructional, measured, sequenced, intent, verb) from title and headings first, then from how lines read."""
    t = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(id, F.filter(F.split(t, "\n"), lambda x: F.trim(x) != "").alias("l"), sentences(t).alias("s"), (F.lit("") if title is None else title).alias("title"), (F.array().cast("array<string>") if headings is None else headings).alias("h"))
    share = lambda hits, of: F.size(hits) / F.greatest(F.size(of), F.lit(1))
    all_lines = F.concat("h", "l")
    flags = rows.select(
        id,
        (share(F.filter("s", lambda s: matches(strip(s), X.INTENT_IMPERATIVE)), F.col("s")) >= 0.22).alias("instructional"),
        (share(F.filter("l", lambda s: matches(s, X.INTENT_MEASURED)), F.col("l")) >= 0.18).alias("measured"),
        (share(F.filter(all_lines, lambda s: matches(s, X.INTENT_SEQUENCED)), all_lines) >= 0.12).alias("sequenced"),
        "title",
        F.array_join("h", " ").alias("h"),
    )
    kind = F.when(F.col("instructional") & F.col("sequenced"), "guide").when(F.col("instructional"), "spec").when(F.col("measured"), "review").when(F.col("sequenced"), "plan").otherwise("notes")
    for column in ("h", "title"):
        for name, pattern in reversed(X.INTENT_MARKERS):
            kind = F.when(matches(F.col(column), pattern), name).otherwise(kind)
    verbs = F.create_map(*[F.lit(x) for kv in X.INTENT_VERBS.items() for x in kv])
    return flags.withColumn("intent", kind).withColumn("verb", verbs[F.col("intent")]).drop("title", "h")


TYPE_NOUN = r"(?i)\b(guide|playbook|handbook|tutorial|walkthrough|spec|specification|rfc|plan|roadmap|review|retro|retrospective|report|recap|analysis|assessment|audit|study|brief|memo|summary|update|overview|notes?|document|doc)\b"


def subject(title: Column) -> Column:
    """A title without the noun that names its type; the title itself if too little is left."""
    bare = F.regexp_replace(F.regexp_replace(F.regexp_replace(title, java(TYPE_NOUN), " "), r"\s*[:|·]\s*", " "), r"\s+", " ")
    bare = strip(unpunctuated(bare))
    short = (F.size(F.split(bare, r"\s+")) < 2) & (F.size(F.split(title, r"\s+")) > 1)
    return F.when((F.size(content_tokens(bare)) == 0) | short, unpunctuated(title)).otherwise(bare)


def purpose(line: Column) -> Column:
    found = unpunctuated(extract(line, r"(?i)\bis\s+(?:a|an)\s+(.{8,90}?)(?:\s+built\b|\s+designed\b|\s+meant\b|\s+intended\b|\s+created\b|[.;]|$)"))
    return F.when(F.size(content_tokens(found)) >= 2, found)


# --- concepts -----------------------------------------------------------------------------------------------------------


def phrases(tokens: Column) -> Column:
    """Candidate phrases of one line's tokens: content words, then runs of two and of three."""
    # Each token is judged once; the runs only read those marks.
    first = lambda w: F.substring(w, 1, 1).between("0", "9")
    marks = F.transform(
        tokens,
        lambda w: F.struct(
            w.alias("w"),
            w.isin(X.STOPWORDS).alias("stop"),
            w.isin(X.META_TERMS).alias("meta"),
            first(w).alias("digit"),
            (F.translate(w, "0123456789", "") == "").alias("number"),
            ((F.length(w) >= 4) & w.endswith("ed") & w.rlike(r"[a-z]{2}ed\z")).alias("past"),
            F.length(w).alias("n"),
        ),
    )
    return let(marks, _phrases)


def _phrases(m: Column) -> Column:
    single = F.transform(F.filter(m, lambda x: (x["n"] >= 4) & ~x["stop"] & ~x["meta"] & ~x["digit"]), lambda x: x["w"])
    ends = lambda x: ~x["stop"] & (x["n"] >= 3) & ~x["number"]
    plain = lambda x: x["meta"] | x["stop"]

    def run(i: Column, size: int) -> Column:
        parts = [F.get(m, i + k) for k in range(size)]
        good = ends(parts[0]) & ends(parts[-1]) & ~parts[-1]["past"]
        if size == 3:
            good &= ~parts[1]["number"]
        length, dull = parts[0]["n"], plain(parts[0])
        for x in parts[1:]:
            length, dull = length + x["n"], dull & plain(x)
        return F.when(good & (length >= 8) & ~dull, F.concat_ws(" ", *[x["w"] for x in parts]))

    def of(size: int) -> Column:
        return F.filter(F.transform(m, lambda x, i: run(i, size)), lambda r: r.isNotNull())

    return F.concat(single, of(2), of(3))


def _lines(sections: DataFrame, id: str) -> DataFrame:
    """(id, ls): a document's lines in one row, so that only its text is shuffled, not the phrases, which are many times as much."""
    return sections.groupBy(id).agg(F.collect_list(F.struct("section", "line", "boost", "ord")).alias("ls"))


def _runs(items: Column, field: str, made) -> Column:
    """`made` of each run of items with the same field, of an array of structs that begin with it."""
    starts = lambda xs: F.filter(F.transform(xs, lambda x, i: F.when((i == 0) | (F.get(xs, i - 1)[field] != x[field]), i)), lambda i: i.isNotNull())
    run = lambda a, s, j: F.slice(a["xs"], s + 1, F.coalesce(F.get(a["starts"], j + 1), F.size(a["xs"])) - s)
    each = lambda a: F.transform(a["starts"], lambda s, j: let(run(a, s, j), made))
    return let(F.array_sort(items), lambda xs: let_all(each, xs=xs, starts=starts(xs)))


def _counted(lines: Column) -> Column:
    """array<STRUCT(key, display, count, spread)>"""
    item = lambda x, p, at: F.struct(normalize_key(p).alias("key"), x["ord"].alias("ord"), at.alias("at"), p.alias("phrase"), x["section"].alias("section"), x["boost"].alias("boost"))
    found = F.flatten(F.transform(lines, lambda x: F.transform(phrases(tokenize(x["line"])), lambda p, at: item(x, p, at))))
    count = lambda xs: F.aggregate(xs, F.lit(0).cast("long"), lambda n, x: n + x["boost"])
    spread = lambda xs: F.size(F.array_distinct(F.transform(xs, lambda x: x["section"]))).cast("long")
    made = lambda xs: F.struct(xs[0]["key"].alias("key"), xs[0]["phrase"].alias("display"), count(xs).alias("count"), spread(xs).alias("spread"))
    return _runs(F.filter(found, lambda x: F.length(x["key"]) >= 3), "key", made)


def _headed(lines: Column) -> Column:
    """array<STRUCT(word, free, followers)>"""

    def follower(w: Column) -> Column:
        leans = w.isNotNull() & (F.length(w) >= 3) & ~w.isin(X.STOPWORDS) & ~w.rlike("^[0-9]")
        return F.when(F.coalesce(leans, F.lit(False)), stem(w))

    pairs = lambda ws: F.transform(ws, lambda w, i: F.struct(w.alias("word"), follower(F.get(ws, i + 1)).alias("next")))
    found = F.flatten(F.transform(lines, lambda x: let(tokenize(x["line"]), pairs)))
    free = lambda xs: F.size(F.filter(xs, lambda x: x["next"].isNull())).cast("long")
    followers = lambda xs: F.size(F.array_distinct(F.filter(F.transform(xs, lambda x: x["next"]), lambda n: n.isNotNull()))).cast("long")
    return _runs(found, "word", lambda xs: F.struct(xs[0]["word"].alias("word"), free(xs).alias("free"), followers(xs).alias("followers")))


def concept_counts(sections: DataFrame, id: str = "doc_id") -> DataFrame:
    """(id, key, display, count, spread) from rows (id, section, line, boost): a heading's phrases count three times."""
    return _lines(sections, id).select(id, F.inline(_counted(F.col("ls"))))


def heads(sections: DataFrame, id: str = "doc_id") -> DataFrame:
    """(id, word, free, followers): how often a word closes a phrase, and how many different words follow it otherwise."""
    return _lines(sections, id).select(id, F.inline(_headed(F.col("ls"))))


def weighted_concepts(sections: DataFrame, id: str = "doc_id") -> DataFrame:
    """(id, phrase, count, spread, weight) of phrases that occur twice or in two sections and don't stop mid-name."""
    often = F.filter(_counted(F.col("ls")), lambda x: (x["count"] >= 2) | (x["spread"] >= 2))
    modifiers = F.transform(F.filter(_headed(F.col("ls")), lambda h: (h["free"] == 0) & (h["followers"] == 1)), lambda h: h["word"])
    whole = lambda a: F.filter(a["often"], lambda x: ~F.array_contains(a["modifiers"], F.element_at(F.split(x["key"], " "), -1)))
    kept = _lines(sections, id).select(id, F.inline(let_all(whole, often=often, modifiers=modifiers)))
    words = F.size(F.split("display", r"\s+"))
    weight = F.col("count") * F.greatest(F.col("spread"), F.lit(1)) * (1 + 0.6 * (words - 1))
    return kept.select(id, F.col("display").alias("phrase"), "count", "spread", F.round(weight, 6).alias("weight"))


def top_concepts(sections: DataFrame, id: str = "doc_id", limit: int = X.CONCEPTS) -> DataFrame:
    """(id, rank, phrase, weight): by weight, without phrases that a better one contains or shares two stems with.

    The greedy pass runs over all phrases of a document and stops accepting at `limit`.
    """
    ranked = weighted_concepts(sections, id)
    order = Window.partitionBy(id).orderBy(F.desc("weight"), F.desc("spread"), F.asc("phrase"))
    best = ranked.withColumn("r", F.row_number().over(order))
    item = F.struct("r", "phrase", "weight", F.concat(F.lit(" "), normalize_key(F.col("phrase")), F.lit(" ")).alias("key"), F.array_distinct(stem_tokens(F.col("phrase"))).alias("stems"))
    lists = best.select(id, item.alias("x")).groupBy(id).agg(F.array_sort(F.collect_list("x")).alias("xs"))
    holds = lambda k, x: k["key"].contains(x["key"]) | x["key"].contains(k["key"]) | (F.size(F.array_intersect(k["stems"], x["stems"])) >= 2)
    kept = F.aggregate("xs", F.slice("xs", 1, 0), lambda acc, x: F.when((F.size(acc) >= limit) | F.exists(acc, lambda k: holds(k, x)), acc).otherwise(F.array_append(acc, x)))
    return lists.select(id, F.posexplode(kept).alias("rank", "x")).select(id, (F.col("rank") + 1).alias("rank"), "x.phrase", "x.weight")


def line_sections(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """Each line of a document as a section of its own: (id, section, line, boost, ord)."""
    rows = docs.select(id, F.posexplode(F.split(F.coalesce(F.col(text), F.lit("")), "\n")).alias("section", "line"))
    return rows.select(id, "section", "line", F.lit(1).alias("boost"), F.col("section").alias("ord"))

"""Small views over documents, entries and relations: conversation lines, file names, section kinds from a graph, caches, tallies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from marginalia.functions.lines import is_decorative, is_table_separator, list_item, plain_content
from marginalia.functions.text import let, matches, strip, word_count

# --- fixed values: how relations read, what a graph's node types are as memories, cues of papers ------------------------
VERBS = {"implements": "carries out", "threatens": "points at", "schedules": "is scheduled by", "depends_on": "depends on"}
NODE_KINDS = {"requirement": "decisions", "decision": "decisions", "risk": "risks", "metric": "signals", "question": "signals"}
PAPER_CUES, VENUE_CUES = r"(?i)\b(abstract|references|bibliography|methodology|experimental\s+setup|related\s+work)\b", r"(?i)\b(arxiv|acl|neurips|icml|cvpr)\b"
TABLE_LINE, HEADING_LINE = r"(?m)^\s*\|.+\|", r"(?m)^#{1,3}\s+"
# ----------------------------------------------------------------------------------------------------------------------


def reference(ref: Column) -> Column:
    """STRUCT(kind, idx) of "actions:2"; idx null for a whole memory."""
    parts = F.split(ref, ":")
    return F.struct(F.get(parts, F.lit(0)).alias("kind"), F.get(parts, F.lit(1)).cast("int").alias("idx"))


def touching(relations: DataFrame, ref: str) -> DataFrame:
    """The relations that start or end at a memory or entry."""
    return relations.where((F.col("from") == ref) | (F.col("to") == ref))


def phrase(kind: Column, e) -> Column:
    """A short phrase that names an entry; e: its fields by name."""

    def cut(text: Column) -> Column:
        flat = strip(F.regexp_replace(text, r"\s+", " "))
        return let(flat, lambda t: F.when(F.length(t) <= 48, t).otherwise(F.concat(F.regexp_replace(F.substring(t, 1, 45), r"\s+\S*\z", ""), F.lit("…"))))

    asks = F.lower(F.coalesce(e("label"), F.lit(""))).isin("open question", "open questions")
    signal = F.when(asks & e("implication").isNotNull(), e("implication")).when(e("value").isNotNull() & (e("label") != ""), F.concat(e("label"), F.lit(": "), e("value"))).otherwise(F.coalesce(e("implication"), F.nullif(e("label"), F.lit(""))))
    dated = F.concat_ws(" · ", e("date"), e("title"))
    return cut(F.when(kind == "signals", signal).when(kind.isin("decisions", "risks", "actions"), e("text")).when((kind == "timeline") & e("title").isNotNull(), dated))


def conversation(relations: DataFrame, entries: DataFrame, blocks: DataFrame, id: str = "doc_id", most: int = 4) -> DataFrame:
    """(id, rank, line): the first distinct lines that relations (id, ord, from, to, relation) read as, frames left out.

    entries: (id, kind, idx, text, label, value, implication, date, title); blocks: (id, kind, title), which name whole memories.
    """
    c = F.col
    names = entries.select(id, F.concat_ws(":", "kind", "idx").alias("ref"), phrase(c("kind"), c).alias("name"))
    wholes = blocks.select(id, c("kind").alias("k"), F.coalesce(F.nullif(strip(F.regexp_replace("title", r"\s+[—–-].*\z", "")), F.lit("")), c("kind")).alias("whole"))
    out = relations.where("relation <> 'frames'")
    for end in ("from", "to"):
        named = names.select(id, c("ref").alias(end), c("name").alias(f"{end}_name"))
        out = out.join(named, [id, end], "left").withColumn("k", F.substring_index(c(end), ":", 1)).join(wholes.withColumnRenamed("whole", f"{end}_whole"), [id, "k"], "left")
        out = out.withColumn(f"{end}_said", F.coalesce(f"{end}_name", f"{end}_whole", c("k"))).drop("k")
    verbs = F.create_map(*[F.lit(x) for kv in VERBS.items() for x in kv])
    out = out.withColumn("line", F.concat_ws(" ", "from_said", F.coalesce(verbs[c("relation")], F.replace("relation", F.lit("_"), F.lit(" "))), "to_said"))
    out = out.groupBy(id, "line").agg(F.min("ord").alias("ord"))
    return out.withColumn("rank", F.row_number().over(Window.partitionBy(id).orderBy("ord"))).where(c("rank") <= most).select(id, "rank", "line")


def file_name(name: Column) -> Column:
    base = F.element_at(F.split(name, r"[\\/]"), -1)
    flat = F.regexp_replace(F.regexp_replace(F.regexp_replace(base, r'[\x00-\x1f<>:"|?*]', ""), r"\s+", "-"), "[^A-Za-z0-9._-]", "")
    short = F.substring(F.regexp_replace(flat, r"^[.]+", ""), 1, 80)
    return F.when(short == "", "output").otherwise(short)


def size_words(n: Column) -> Column:
    """1.5 MB, 2.0 KB, 12 B"""
    return F.when(n >= 1 << 20, F.format_string("%.1f MB", n / (1 << 20))).when(n >= 1024, F.format_string("%.1f KB", n / 1024)).otherwise(F.concat(n.cast("string"), F.lit(" B")))


def kinds_from_graph(sections: DataFrame, nodes: DataFrame, id: str = "doc_id") -> DataFrame:
    """(id, section, kind): sections (id, section, title, kind) without a kind take that of the first node (id, ord, title, type) whose
    title is theirs, holds it or lies in it."""
    s = sections.where("kind is null").select(id, "section", F.lower(F.trim("title")).alias("t")).where("t <> ''")
    n = nodes.select(id, "ord", F.lower(F.trim("title")).alias("nt"), "type").where("nt <> ''")
    table = F.create_map(*[F.lit(x) for kv in NODE_KINDS.items() for x in kv])
    found = s.join(n, id).where(F.col("t").contains(F.col("nt")) | F.col("nt").contains(F.col("t")))  # the headings of one document
    found = found.groupBy(id, "section").agg(F.min_by("type", "ord").alias("type")).select(id, "section", table[F.col("type")].alias("found"))
    return sections.join(found, [id, "section"], "left").select(id, "section", F.coalesce("kind", "found").alias("kind"))


def first_paragraph(sections: DataFrame, id: str = "doc_id") -> DataFrame:
    """(id, text): the first run of plain lines of three words at least; sections: (id, section, line_no, line) without headings.

    Of each section only its first run counts, which blank lines, list items, rules and decorations end.
    """
    line = F.col("line")
    breaks = (strip(line) == "") | list_item(line).isNotNull() | is_table_separator(line) | is_decorative(line)
    order = Window.partitionBy(id, "section").orderBy("line_no")
    rows = sections.withColumn("run", F.sum(breaks.cast("int")).over(order)).where(~breaks)
    rows = rows.withColumn("first", F.min("run").over(Window.partitionBy(id, "section"))).where("run = first")
    item = F.struct("line_no", plain_content(line).alias("t"))
    runs = rows.groupBy(id, "section").agg(F.array_join(F.transform(F.array_sort(F.collect_list(item)), lambda x: x["t"]), " ").alias("text"))
    runs = runs.withColumn("text", strip(F.col("text"))).where(word_count(F.col("text")) >= 3)
    return runs.groupBy(id).agg(F.min_by("text", "section").alias("text"))


def with_carried_provenance(improved: DataFrame, previous: DataFrame, id: str = "doc_id") -> DataFrame:
    """`improved` (id, kind, locator, excerpt) with the locator and excerpt of the same memory before, where there was one."""
    old = previous.select(id, "kind", F.col("locator").alias("l"), F.col("excerpt").alias("e"))
    return improved.join(old, [id, "kind"], "left").select(id, "kind", F.coalesce("l", "locator").alias("locator"), F.coalesce("e", "excerpt").alias("excerpt"))


def cached(docs: DataFrame, cache: DataFrame, text: str = "text") -> DataFrame:
    """`docs` with key, the hash of the text, and hit: whether the cache (key) has it; the others are the work that is left."""
    keys = cache.select("key").distinct().withColumn("_hit", F.lit(True))
    return docs.withColumn("key", F.sha2(F.coalesce(F.col(text), F.lit("")), 256)).join(keys, "key", "left").withColumn("hit", F.coalesce("_hit", F.lit(False))).drop("_hit")


def tally(documents: Column, memories: Column, published: Column) -> Column:
    """2 documents remembered · 7 memories · 1 published; null before the first document."""
    said = F.concat_ws(
        " · ",
        F.concat(documents.cast("string"), F.when(documents == 1, " document").otherwise(" documents"), F.lit(" remembered")),
        F.concat(memories.cast("string"), F.when(memories == 1, " memory").otherwise(" memories")),
        F.when(published > 0, F.concat(published.cast("string"), F.lit(" published"))),
    )
    return F.when(documents > 0, said)


def wants_refining(archetype: Column, name: Column, text: Column, pages: Column) -> Column:
    """Whether a paper, or a long document of many tables, is worth a second, slower reading."""
    kind, sample = F.lower(F.coalesce(archetype, F.lit(""))), F.substring(text, 1, 20_000)
    cues = matches(sample, PAPER_CUES) | matches(F.lower(name), VENUE_CUES)
    tables = F.regexp_count(sample, F.lit(TABLE_LINE))
    return ~kind.isin("resume", "invoice") & ((pages > 20) | (cues & (pages >= 8)) | ((kind == "research") & (pages >= 6)) | ((tables >= 12) & (pages >= 4)))


def refined_better(before: Column, after: Column) -> Column:
    """Whether the second reading replaces the first; both STRUCT(archetype, blocks, evidence, text)."""
    heads = lambda x: F.regexp_count(x["text"], F.lit(HEADING_LINE))
    more = (after["blocks"] > before["blocks"]) | (after["evidence"] > before["evidence"]) | ((heads(after) >= heads(before) + 2) & (F.length(after["text"]) > F.length(before["text"]) * 0.8))
    return ~F.lower(F.coalesce(before["archetype"], F.lit(""))).isin("resume", "invoice") & (F.lower(F.coalesce(after["archetype"], F.lit(""))) == "research") & more

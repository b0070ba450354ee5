"""Library and evaluation: recent documents, search, counters, before/after comparison, noise counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from marginalia.functions.text import java, matches


def recent(saved: DataFrame, now: Column, key: str = "key", at: str = "saved_at", owner: str = "owner", days: int = 7, most: int = 24) -> DataFrame:
    """The newest `most` items of each owner within `days`; an item replaces older ones with its key."""
    fresh = saved.where(F.col(at) > now - F.expr(f"interval {days} days"))
    last = Window.partitionBy(owner, key).orderBy(F.desc(at), F.desc("id"))
    order = Window.partitionBy(owner).orderBy(F.desc(at), F.desc("id"))
    once = fresh.withColumn("_n", F.row_number().over(last)).where("_n = 1").drop("_n")
    return once.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)


def search(saved: DataFrame, needle: str, *columns: str) -> DataFrame:
    """Rows with the needle in one of the columns, whatever its case."""
    hit = F.lit(False)
    for c in columns:
        hit |= F.contains(F.lower(F.coalesce(F.col(c), F.lit(""))), F.lit(needle.lower()))
    return saved.where(hit)


def changes(before: DataFrame, after: DataFrame, keys: list[str], n: str = "n", least: int = 3) -> DataFrame:
    """(keys, before, after, delta, flagged): a full outer join of counts; missing counts are 0."""
    out = before.select(*keys, F.col(n).alias("before")).join(after.select(*keys, F.col(n).alias("after")), keys, "full")
    out = out.withColumns({"before": F.coalesce("before", F.lit(0).cast("long")), "after": F.coalesce("after", F.lit(0).cast("long"))})
    return out.withColumn("delta", F.col("after") - F.col("before")).withColumn("flagged", F.abs("delta") >= least)


# --- fixed values: what a converter leaves behind -----------------------------------------------------------------------
TRIPLED = "(?i)\\b\\w*(?:" + "|".join(f"{c}{{3,}}" for c in "abcdefghijklmnopqrstuvwxyz") + ")\\w*\\b"
ARTEFACTS = (TRIPLED, r"\bWe We\b", r"\bWiWithout\b|\bfaface\b|\bbar+riers\b")
BROKEN_WORDS, HALF_SENTENCES = r"\b[A-Za-z]{1,2}\s+[A-Za-z]{1,2}\s+[A-Za-z]{1,2}\b", r"\b(We|The|This|Our)\s+[a-z]{0,3}\s*[.!?]"
REFERENCE_HEADING = r"(?i)\n#{1,3}\s*(references|bibliography)\b"


def noise(text: Column) -> dict[str, Column]:
    """Artefacts of recognition, words broken into letters, sentences without a middle, whether references follow, and the length."""
    n = lambda p: F.regexp_count(text, F.lit(java(p))).cast("long")
    artefacts = sum((n(p) for p in ARTEFACTS[1:]), n(ARTEFACTS[0]))
    return {"artefacts": artefacts, "broken_words": n(BROKEN_WORDS), "half_sentences": n(HALF_SENTENCES), "has_references": matches(text, REFERENCE_HEADING), "chars": F.length(text).cast("long")}


def html_title(html: Column) -> Column:
    return F.trim(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1))


def html_escape(text: Column) -> Column:
    """The five characters that markup reserves."""
    out = text
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def token_set(text: Column, least: int = 4) -> Column:
    """Distinct lower-case words of `least` letters, digits, percent signs and dashes."""
    flat = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^a-z0-9\s%-]", " ")
    return F.array_distinct(F.filter(F.split(flat, r"\s+"), lambda w: F.length(w) >= least))


def overlaps(left: DataFrame, right: DataFrame, text: str = "text", left_id: str = "item_id", right_id: str = "doc_id", least: int = 4) -> DataFrame:
    """(left_id, right_id, shared, jaccard): the right text whose words are most like each left one's, by Jaccard; ties: the smaller id.

    An inverted index: one row for each word and text, joined on words and counted; both sides are read once.
    """
    side = lambda rows, id, n: rows.select(id, token_set(F.col(text), least).alias("w")).select(id, F.size("w").alias(n), F.explode("w").alias("w"))
    pairs = side(left, left_id, "a").join(side(right, right_id, "b"), "w").groupBy(left_id, right_id, "a", "b").agg(F.count("*").alias("shared"))
    pairs = pairs.withColumn("jaccard", F.round(F.col("shared") / (F.col("a") + F.col("b") - F.col("shared")), 6))
    best = Window.partitionBy(left_id).orderBy(F.desc("jaccard"), right_id)
    return pairs.withColumn("r", F.row_number().over(best)).where("r = 1").select(left_id, right_id, "shared", "jaccard")


def latency_change(before: Column, after: Column) -> Column:
    """Change in percent, rounded to one place; null without a time before."""
    return F.when(before > 0, F.round((after - before) / before * 100, 1))


def research_checks(entries: DataFrame, id: str = "doc_id") -> DataFrame:
    """(id, findings, evidence, insights, table_like, with_values, copied) of a paper's entries (id, kind, text, value)."""
    title = F.lower(F.trim(F.col("text")))
    found = entries.where("kind = 'timeline'").select(id, title.alias("t")).distinct()
    copied = entries.where("kind = 'decisions'").select(id, title.alias("t")).join(found, [id, "t"], "left_semi").groupBy(id).agg(F.count("*").alias("copied"))
    n = lambda cond: F.count_if(cond).cast("long")
    table = F.col("text").contains("|") | F.col("text").rlike(r"^\s*[0-9.]+\s+[0-9.]+\s+[0-9.]+")
    kind = lambda k: F.col("kind") == k
    out = entries.groupBy(id).agg(n(kind("timeline")).alias("findings"), n(kind("signals")).alias("evidence"), n(kind("decisions")).alias("insights"), n(kind("timeline") & table).alias("table_like"), n(kind("signals") & F.col("value").isNotNull()).alias("with_values"))
    return out.join(copied, id, "left").withColumn("copied", F.coalesce("copied", F.lit(0).cast("long")))


def kind_counts(entries: DataFrame, id: str = "doc_id") -> DataFrame:
    """(id, kind, n, sample): how many entries of each kind a document has, and how its first one begins."""
    return entries.groupBy(id, "kind").agg(F.count("*").alias("n"), F.substring(F.min_by("text", "idx"), 1, 80).alias("sample"))

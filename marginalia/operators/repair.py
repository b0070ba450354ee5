"""Repair of model extractions: pure steps over typed arrays, in a fixed order; nothing is shuffled.

An extraction is JSON with `document_meta` and six buckets.  `parsed` reads it leniently; the steps scrub verbs of the storage layer,
gate dates by confidence, reject unusable dates, honour the timeline mode, repair links and compress near repeats.  What leaves
the timeline becomes a signal, so nothing is lost; every step that changed something is noted in `repairs`.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginalia.functions.text import let, let_all, normalize_key, strip

# --- fixed values: the extraction's shape, its words and its defaults -------------------------------------------------
META = "struct<archetype:string,archetype_confidence:double,timeline_mode:string,anchor_date:string,anchor_confidence:string>"
RESOLVED = "struct<type:string,value:string>"
BUCKETS = {
    "snapshot": "struct<content:string>",
    "signals": "struct<content:string,signal_type:string,source_confidence:string>",
    "timeline": f"struct<id:string,content:string,date_role:string,raw_temporal_expression:string,resolved_date:{RESOLVED},timeline_confidence:struct<date_resolution:string>,responsible_party:string,depends_on:array<string>>",
    "risks": "struct<content:string,why_it_matters:string,source_confidence:string>",
    "decisions": "struct<decision_id:string,content:string,decided_by:string>",
    "actions": "struct<content:string,owner:string,due_date:string,status:string,carries_out:string>",
}
DEFAULTS = {"signals": {"signal_type": "pattern", "source_confidence": "medium"}, "timeline": {"date_role": "event_date"}, "risks": {"source_confidence": "medium"}, "actions": {"status": "pending"}}
TIMELINE_MODES = ("single_leg", "milestone_chain", "obligation_deadlines", "narrative_sequence", "none")
STORAGE_VERB = r"(?i)\b(UPSERT|MERGE|DELETE|FLAG_CONFLICT|CLUSTER_ID|EMBEDDING|CACHE_POLICY)\b"
UNRESOLVED, NO_SAFE_DATE = "Unresolved temporal reference: ", "Temporal pattern without a safe date: "
WEIGHTS = {"identity": 0.28, "memory_density": 0.27, "timeline_honesty": 0.25, "decision_action_link": 0.2}
# ----------------------------------------------------------------------------------------------------------------------
EXTRACTION = f"struct<document_meta:{META}," + ",".join(f"{k}:array<{v}>" for k, v in BUCKETS.items()) + ">"
REPAIRS = "array<struct<mode:string,count:int>>"


def _noted(rows: DataFrame, mode: str, count: Column) -> DataFrame:
    note = F.struct(F.lit(mode).alias("mode"), count.cast("int").alias("count"))
    return rows.withColumn("repairs", F.when(count > 0, F.array_append("repairs", note)).otherwise(F.col("repairs")))


def parsed(docs: DataFrame, raw: str = "raw", id: str = "doc_id") -> DataFrame:
    """(id, meta, the six buckets, repairs): what is missing or of another type becomes its default, an unknown mode `none`.

    Null or broken JSON gives empty buckets; items without content are dropped.
    """
    x = docs.select(id, F.from_json(raw, EXTRACTION).alias("x"))
    given = F.col("x.document_meta")
    meta = F.struct(
        F.coalesce(given["archetype"], F.lit("generic")).alias("archetype"),
        given["archetype_confidence"].alias("archetype_confidence"),
        F.when(given["timeline_mode"].isin(*TIMELINE_MODES), given["timeline_mode"]).otherwise("none").alias("timeline_mode"),
        given["anchor_date"].alias("anchor_date"),
        F.coalesce(given["anchor_confidence"], F.lit("none")).alias("anchor_confidence"),
    )
    return x.select(id, meta.alias("meta"), *[_filled(name).alias(name) for name in BUCKETS], F.array().cast(REPAIRS).alias("repairs"))


def _filled(name: str) -> Column:
    items = F.coalesce(F.col("x")[name], F.array().cast(f"array<{BUCKETS[name]}>"))
    items = F.filter(items, lambda e: F.coalesce(e["content"], F.lit("")) != "")
    for field, value in DEFAULTS.get(name, {}).items():
        items = _each(items, field, lambda v, value=value: F.coalesce(v, F.lit(value)))
    if name == "timeline":
        items = _each(items, "depends_on", lambda v: F.coalesce(v, F.array().cast("array<string>")))
    return items


def _each(items: Column, field: str, new: Callable[[Column], Column]) -> Column:
    return F.transform(items, lambda e: e.withField(field, new(e[field])))


def without_verbs(text: Column) -> Column:
    """A text without the verbs; only of verbs: [redacted] for each."""
    bare = strip(F.regexp_replace(F.regexp_replace(text, STORAGE_VERB, ""), r"\s{2,}", " "))
    return let(bare, lambda b: F.when(b != "", b).otherwise(strip(F.regexp_replace(text, STORAGE_VERB, "[redacted]"))))


def scrubbed(rows: DataFrame) -> DataFrame:
    bare = lambda t: strip(F.regexp_replace(F.regexp_replace(t, STORAGE_VERB, ""), r"\s{2,}", " "))
    count, out = F.lit(0), {}
    for name, field in [(name, "content") for name in BUCKETS] + [("risks", "why_it_matters")]:
        texts = F.col(name)[field]
        count = count + F.size(F.filter(texts, lambda t: F.coalesce((t != "") & (bare(t) != t), F.lit(False))))
        out[name] = _each(out.get(name, F.col(name)), field, lambda t: F.when(t != "", without_verbs(t)).otherwise(t))
    return _noted(rows.withColumn("_n", count).withColumns(out), "backend_verbs_scrubbed", F.col("_n")).drop("_n")


def _signal(content: Column, kind: str, confidence: str) -> Column:
    return F.struct(content.alias("content"), F.lit(kind).alias("signal_type"), F.lit(confidence).alias("source_confidence"))


def _moved(rows: DataFrame, mode: str, leaves: Callable[[Column, Column], Column], signal: Callable[[Column], Column]) -> DataFrame:
    """Timeline items that leave become signals."""
    gone = F.filter("timeline", leaves)
    rows = rows.withColumn("_n", F.size(gone)).withColumn("signals", F.concat("signals", F.transform(gone, signal)))
    rows = rows.withColumn("timeline", F.filter("timeline", lambda e, i: ~leaves(e, i)))
    return _noted(rows, mode, F.col("_n")).drop("_n")


def gated(rows: DataFrame) -> DataFrame:
    """Dates resolved with low confidence or none leave the timeline."""
    raw = lambda e: F.when(F.coalesce(e["raw_temporal_expression"], F.lit("")) != "", F.concat(F.lit(" (“"), e["raw_temporal_expression"], F.lit("”)"))).otherwise("")
    unsure = lambda e, i: F.coalesce(e["timeline_confidence"]["date_resolution"], F.lit("medium")).isin("low", "none")
    return _moved(rows, "timeline_confidence_gate", unsure, lambda e: _signal(F.concat(F.lit(UNRESOLVED), e["content"], raw(e)), "unresolved_temporal", "medium"))


def unusable(resolved: Column) -> Column:
    """No value, a blank one, one of type relative_unresolved, or an object without start, end and pattern."""
    value = resolved["value"]
    part = lambda k: F.coalesce(F.get_json_object(value, f"$.{k}"), F.lit(""))
    hollow = value.startswith("{") & (F.concat(part("start"), part("end"), part("pattern")) == "")
    return F.coalesce(resolved["type"] == "relative_unresolved", F.lit(False)) | F.coalesce((strip(value) == "") | hollow, F.lit(True))


def with_usable_dates(rows: DataFrame) -> DataFrame:
    return _moved(rows, "fabricated_date_rejected", lambda e, i: unusable(e["resolved_date"]), lambda e: _signal(F.concat(F.lit(NO_SAFE_DATE), e["content"]), "unresolved_temporal", "low"))


def with_honest_mode(rows: DataFrame) -> DataFrame:
    """Mode none empties the timeline, single_leg keeps its first two items."""
    mode = F.col("meta.timeline_mode")
    over = lambda e, i: (mode == "none") | ((mode == "single_leg") & (i >= 2))
    return _moved(rows, "timeline_mode_honesty", over, lambda e: _signal(e["content"], "unresolved_temporal", "medium").withField("signal_type", F.when(mode == "none", "unresolved_temporal").otherwise("pattern")))


def with_links(rows: DataFrame) -> DataFrame:
    """Blank ids are numbered D-001, T-001, ...; references to ids that don't exist are dropped."""
    named = lambda items, field, letter: F.transform(items, lambda e, i: e.withField(field, F.coalesce(F.nullif(strip(e[field]), F.lit("")), F.concat(F.lit(letter), F.lpad((i + 1).cast("string"), 3, "0")))))
    out = rows.withColumns({"decisions": named("decisions", "decision_id", "D-"), "timeline": named("timeline", "id", "T-")})
    decisions, phases = F.col("decisions")["decision_id"], F.col("timeline")["id"]
    lost = lambda e: F.coalesce((e["carries_out"] != "") & ~F.array_contains(decisions, e["carries_out"]), F.lit(False))
    there = lambda e: F.filter(e["depends_on"], lambda d: F.array_contains(phases, d))
    dangling = F.aggregate("timeline", F.lit(0), lambda n, e: n + F.size(e["depends_on"]) - F.size(there(e)))
    out = out.withColumn("_n", F.size(F.filter("actions", lost)) + dangling)
    out = out.withColumns({"actions": F.transform("actions", lambda e: e.withField("carries_out", F.when(~lost(e), e["carries_out"]))), "timeline": F.transform("timeline", lambda e: e.withField("depends_on", there(e)))})
    return _noted(out, "orphan_link_repair", F.col("_n")).drop("_n")


def near(a: Column, b: Column) -> Column:
    """Equal keys, or 0.85 of the smaller set of words of three letters is shared and the sets differ by three words at most."""
    both, small = F.size(F.array_intersect(a["words"], b["words"])), F.least(F.size(a["words"]), F.size(b["words"]))
    return (a["key"] == b["key"]) | ((small > 0) & (both >= 0.85 * small) & (F.abs(F.size(a["words"]) - F.size(b["words"])) <= 3))


def compressed(items: Column) -> Column:
    """The first of each group of near repeats, by an ordered fold over one bucket of one document."""
    words = lambda key: F.array_distinct(F.filter(F.split(key, " "), lambda w: F.length(w) > 2))
    keyed = F.transform(items, lambda e: let(normalize_key(e["content"]), lambda k: F.struct(e.alias("e"), k.alias("key"), words(k).alias("words"))))
    kept = lambda rows: F.aggregate(rows, F.slice(rows, 1, 0), lambda acc, x: F.when(F.exists(acc, lambda k: near(k, x)), acc).otherwise(F.array_append(acc, x)))
    return let_all(lambda s: F.transform(kept(s["rows"]), lambda x: x["e"]), rows=keyed)


def without_repeats(rows: DataFrame) -> DataFrame:
    before = sum((F.size(n) for n in BUCKETS), F.lit(0))
    out = rows.withColumn("_n", before).withColumns({n: compressed(F.col(n)) for n in BUCKETS})
    return _noted(out, "duplicate_compression", F.col("_n") - before).drop("_n")


STEPS = (scrubbed, gated, with_usable_dates, with_honest_mode, with_links, without_repeats)


def repaired(docs: DataFrame, raw: str = "raw", id: str = "doc_id") -> DataFrame:
    """All steps in their order: (id, meta, the six buckets, repairs)."""
    rows = parsed(docs, raw, id)
    for step in STEPS:
        rows = step(rows)
    return rows


def quality(rows: DataFrame, id: str = "doc_id") -> DataFrame:
    """(id, identity, memory_density, timeline_honesty, decision_action_link, overall), each from 0 to 1."""
    n = lambda name: F.size(name)
    dated, decided, acts = n("timeline") > 0, n("decisions") > 0, n("actions") > 0
    ids = F.col("decisions")["decision_id"]
    linked = F.filter("actions", lambda e: F.coalesce((e["carries_out"] != "") & F.array_contains(ids, e["carries_out"]), F.lit(False)))
    parts = {
        "identity": F.least(F.lit(1.0), n("snapshot") / 3),
        "memory_density": F.least(F.lit(1.0), (n("signals") + n("decisions") + n("risks") + n("actions") + dated.cast("int")) / 8),
        "timeline_honesty": F.when(F.col("meta.timeline_mode") == "none", F.when(dated, 0.25).otherwise(1.0)).otherwise(F.when(dated, 0.9).otherwise(0.55)),
        "decision_action_link": F.when(acts, F.size(linked) / n("actions")).when(decided, 0.8).otherwise(0.7),
    }
    out = rows.select(id, *[c.alias(k) for k, c in parts.items()])
    return out.withColumn("overall", F.round(sum((w * F.col(k) for k, w in WEIGHTS.items()), F.lit(0.0)), 6))


def falls_back(candidate: DataFrame, improved: DataFrame, id: str = "doc_id") -> DataFrame:
    """(id, fallback): whether the local candidate stays, from two tables of scores: less honest by over 0.05, worse by over 0.08, or hollow."""
    both = candidate.alias("c").join(improved.alias("i"), id)
    worse = (F.col("i.timeline_honesty") < F.col("c.timeline_honesty") - 0.05) | (F.col("i.overall") + 0.08 < F.col("c.overall"))
    return both.select(id, (worse | ((F.col("i.memory_density") == 0) & (F.col("c.memory_density") > 0))).alias("fallback"))


def clamped(text: Column, most: int) -> Column:
    """One line of at most `most` characters, the last one an ellipsis if it was longer."""
    flat = strip(F.regexp_replace(text, r"\s+", " "))
    return let(flat, lambda t: F.when(F.length(t) <= most, t).otherwise(F.concat(F.regexp_replace(F.substring(t, 1, most - 1), r"\s+\z", ""), F.lit("…"))))


def archetype_id(name: Column) -> Column:
    key = F.regexp_replace(F.lower(name), r"[\s/-]+", "_")
    return F.when((key == "cv") | key.contains("resume"), "resume").when((key == "receipt") | key.contains("invoice"), "invoice").when(key.contains("research") | key.contains("paper"), "research").otherwise("generic")


def archetype_label(name: Column) -> Column:
    id = archetype_id(name)
    plain = F.lower(strip(name)).isin("other", "generic", "unknown", "")
    return F.when(id != "generic", F.initcap(id)).when(plain, "Generic Knowledge").otherwise(F.substring(strip(name), 1, 80))


def date_words(item: Column) -> Column:
    """How a timeline item's date reads: its value, its range or pattern, else the raw words."""
    resolved, raw = item["resolved_date"], F.nullif(strip(item["raw_temporal_expression"]), F.lit(""))
    part = lambda k: F.nullif(F.get_json_object(resolved["value"], f"$.{k}"), F.lit(""))
    of_object = F.coalesce(F.concat(part("start"), F.lit("–"), part("end")), part("start"), part("pattern"))
    value = F.when(resolved["value"].startswith("{"), of_object).otherwise(F.nullif(strip(resolved["value"]), F.lit("")))
    return F.coalesce(value, raw, resolved["type"], F.lit("unspecified"))


def short_label(content: Column) -> Column:
    """The first eight words of the first sentence."""
    first = F.coalesce(F.nullif(strip(F.get(F.split(content, "[.!?]"), F.lit(0))), F.lit("")), content)
    return F.array_join(F.slice(F.split(first, r"\s+"), 1, 8), " ")


def projected(rows: DataFrame, id: str = "doc_id", most: int = 100) -> DataFrame:
    """(id, kind, idx, text, label, date, state, status, ref, owner, because): the entries that a repaired extraction gives."""
    none = F.lit(None).cast("string")
    names = ("text", "label", "date", "state", "status", "ref", "owner", "because")

    def long(kind: str, fields: Callable[[Column], dict[str, Column]]) -> Column:
        row = lambda e, i, f: F.struct(F.lit(kind).alias("kind"), i.cast("int").alias("idx"), *[f.get(n, none).alias(n) for n in names])
        return F.transform(F.slice(kind, 1, most), lambda e, i: row(e, i, fields(e)))

    text = lambda e: clamped(e["content"], 2000)
    state = lambda e: F.when(e["date_role"].isin("authored_date", "mention_date"), "done").when(e["date_role"] == "deadline", "planned").otherwise("on-track")
    status = lambda e: F.when(e["status"].isin("ready", "done", "suggested"), e["status"]).otherwise("pending")
    parts = F.concat(
        long("signals", lambda e: {"text": text(e), "label": clamped(short_label(e["content"]), 120)}),
        long("decisions", lambda e: {"text": text(e), "ref": clamped(e["decision_id"], 40), "status": F.lit("approved"), "because": F.when(e["decided_by"] != "", F.concat(F.lit("Decided by "), e["decided_by"]))}),
        long("timeline", lambda e: {"text": text(e), "date": clamped(date_words(e), 80), "state": state(e), "ref": F.nullif(F.array_join(e["depends_on"], ", "), F.lit("")), "owner": e["responsible_party"]}),
        long("risks", lambda e: {"text": text(e), "status": e["source_confidence"], "because": F.nullif(e["why_it_matters"], F.lit(""))}),
        long("actions", lambda e: {"text": text(e), "status": status(e), "owner": F.nullif(e["owner"], F.lit("")), "date": F.nullif(e["due_date"], F.lit("")), "ref": F.nullif(e["carries_out"], F.lit(""))}),
    )
    return rows.select(id, F.explode(parts).alias("e")).select(id, "e.*")


def projected_snapshots(rows: DataFrame, title: Column | None = None, id: str = "doc_id") -> DataFrame:
    """(id, heading, summary, byline, archetype, archetype_label) of a repaired extraction."""
    meta = F.col("meta")
    title = clamped(F.coalesce(F.nullif(title, F.lit("")), meta["archetype"]) if title is not None else meta["archetype"], 200)
    parts = F.filter(F.transform(F.slice("snapshot", 1, 3), lambda e: strip(e["content"])), lambda t: t != "")
    said = F.concat(F.lit("A "), meta["archetype"], F.lit(" remembered with timeline mode "), meta["timeline_mode"], F.lit("."))
    byline = F.when(F.coalesce(meta["anchor_date"], F.lit("")) != "", F.concat(F.lit("Anchor "), meta["anchor_date"], F.lit(" · "), meta["anchor_confidence"])).when(meta["anchor_confidence"] == "none", "No reliable date anchor")
    heading = F.when(F.length(title) > 80, meta["archetype"]).otherwise(title)
    return rows.select(id, heading.alias("heading"), clamped(F.coalesce(F.nullif(F.array_join(parts, " "), F.lit("")), said), 2000).alias("summary"), byline.alias("byline"), archetype_id(meta["archetype"]).alias("archetype"), archetype_label(meta["archetype"]).alias("archetype_label"))

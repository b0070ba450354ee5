"""Operators on small documents."""

import json

from pyspark.sql import functions as F

from marginalia.operators import graphs, judgement, library, relations, repair, research, statements, structure, understanding
from marginalia.plans.fixtures import FORMS
from marginalia.plans.extractions import EXTRACTIONS
from marginalia.sources import documents as sources
from marginalia.sources import json_source


def test_statements_first_wins(spark):
    docs = spark.createDataFrame([(1, "The gates open at dawn. The gates open at dawn!\nGates open at dawn for late ferries."), (2, None), (3, "")], "doc_id long, text string")
    assert {r["doc_id"]: (r["n_raw"], r["n_kept"], r["n_redundant"]) for r in statements.counts(docs).collect()} == {1: (3, 2, 1), 2: (0, 0, 0), 3: (0, 0, 0)}
    kept = statements.without_restatements(docs).collect()
    assert [r["statement"] for r in kept] == ["The gates open at dawn.", "Gates open at dawn for late ferries."]


def test_segments_follow_the_state_table(spark):
    docs = spark.createDataFrame([(1, "# T\n- a\n\n| x | y |\nprose\n\nmore\n<!-- page:2 -->\n## U\nend")], "doc_id long, text string")
    rows = structure.segment_lines(docs).orderBy("line_no").collect()
    assert [(r["segment"], r["kind"]) for r in rows] == [(1, "section"), (1, "section"), (2, "table"), (3, "prose"), (4, "prose"), (5, "section"), (5, "section")]
    assert [r["page"] for r in rows][-1] == 2


def test_long_prose_is_split_where_its_topic_shifts(spark):
    """Every line of prose in some segment, split as a plain walk over its lines splits it."""
    import re

    from marginalia.functions import fixed

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").limit(60)
    harbour = "\n".join(" ".join(f"harbour{i}{j} gate{i}" for j in range(10)) for i in range(8)) + "\n" + "\n".join(" ".join(f"orchard{i}{j} apple{i}" for j in range(10)) for i in range(8))
    docs = docs.union(spark.createDataFrame([(-1, harbour), (-2, "# Title\n" + harbour)], "doc_id long, text string"))

    def content(line):
        flat = re.sub(r"['’]s\b", "", line.lower(), flags=re.ASCII)
        return {w for w in (re.sub(r"^\.+|\.+$", "", x) for x in re.split("[^a-z0-9+#.]+", flat)) if len(w) >= 3 and w not in fixed.STOPWORDS and not w.isdigit()}

    def plain(text):
        out, run = [], []
        for line in [*(text or "").split("\n"), ""]:
            if line.strip():
                run.append(line)
            elif run:
                bucket = [run[0]] if len(run) >= 8 else run
                for line in run[1:] if len(run) >= 8 else []:
                    a, b = set().union(*map(content, bucket)), content(line)
                    near = len(a & b) / len(a | b) if a and b else 0
                    if near < 0.12 and sum(len(x.split()) for x in bucket) >= 80:
                        out.append("\n".join(bucket))
                        bucket = []
                    bucket.append(line)
                out.append("\n".join(bucket))
                run = []
        return [x.strip() for x in out]

    got = {}
    for r in structure.segments(docs).orderBy("segment").collect():
        got.setdefault(r["doc_id"], []).append(r["body"])
    prose = {r["doc_id"]: r["text"] for r in docs.collect() if not re.search(r"^\s*([-*•#|]|\d{1,3}[.)]\s|<!--)", r["text"] or "", re.M)}
    assert len(prose) > 30 and all(got.get(i, []) == plain(t) for i, t in prose.items())
    assert len(got[-1]) > 1 and len(got[-2]) == 1


def test_topic_shift(spark):
    long = " ".join(f"harbour{i} gate{i}" for i in range(45))
    got = spark.range(1).select(structure.topic_shifts(F.array(F.lit(long), F.lit("completely different orchard apples"), F.lit("orchard apples"))).alias("b")).first()["b"]
    assert got == [0, 1, 1]


def test_preflight_codes(spark):
    docs = spark.createDataFrame([(1, " "), (2, "a\n\x00b"), (3, "\x01" * 9 + "a"), (4, "﻿ok\r\n"), (5, "x" * (1 << 20) + "y"), (6, None)], "doc_id long, raw string")
    got = {r["doc_id"]: r for r in sources.preflight(docs).collect()}
    assert {k: [d["code"] for d in r["diagnostics"]] for k, r in got.items()} == {1: ["input.empty"], 2: ["input.binary"], 3: ["input.binary"], 4: [], 5: ["input.too-large"], 6: ["input.empty"]}
    assert (got[2]["diagnostics"][0]["line"], got[2]["diagnostics"][0]["column"]) == (2, 1) and got[4]["text"] == "ok\n"


def test_label(spark):
    docs = spark.createDataFrame([("a/b.md",), ("C:\\x\\y<1>.txt",), ("",), (None,)], "l string")
    assert [r[0] for r in docs.select(sources.sanitize_label(F.col("l"))).collect()] == ["b.md", "y1.txt", "Pasted notes", "Pasted notes"]


def test_archetypes(spark):
    got = {r["doc_id"]: r["archetype"] for r in understanding.archetypes(spark.createDataFrame([(i + 1, f[1]) for i, f in enumerate(FORMS)], "doc_id long, raw string"), text="raw").collect()}
    assert got[3] == "invoice" and got[4] == "research" and got[1] == "generic" and got[8] == "generic"


def test_relations(spark):
    fields = "doc_id long, kind string, idx int, text string, label string, value string, implication string, because string, consequence string, title string, produces string, requires string, ref string, source string"
    row = lambda kind, idx, text, **k: (1, kind, idx, text, k.get("label"), k.get("value"), None, None, None, k.get("title"), k.get("produces"), k.get("requires"), k.get("ref"), k.get("source"))
    rows = [
        row("snapshot", 0, "x"), row("decisions", 0, "Lease spare gate readers", ref="D-1"), row("decisions", 1, "Paint the pier"), row("risks", 0, "Gate readers arrive late"),
        row("actions", 0, "Sign it", source="d-1"), row("actions", 1, "Paint the whole pier"), row("timeline", 0, "a", title="Survey piers", produces="Pier map"), row("timeline", 1, "b", title="Install", requires="the pier map"),
    ]
    got = {(r["from"], r["relation"], r["to"]) for r in relations.relations(spark.createDataFrame(rows, fields)).collect()}
    assert {("snapshot", "frames", "risks"), ("decisions:0", "mitigates", "risks:0"), ("risks:0", "motivates", "decisions:0"), ("actions:0", "implements", "decisions:0"), ("actions:1", "implements", "decisions:1"), ("timeline:0", "unblocks", "timeline:1")} <= got
    assert not any(a == b for a, _, b in got)


def test_duplicate_entities(spark):
    nodes = spark.createDataFrame([(1, "a", "claim", "Gates  open", 1), (1, "b", "claim", "gates open", 2), (1, "c", "value", "3%", 3)], "doc_id long, id string, kind string, label string, ord int")
    edges = spark.createDataFrame([(1, "b", "c", "measures", "INFERRED", 2), (1, "a", "c", "measures", "EXTRACTED", 1), (1, "a", "b", "same", "INFERRED", 3), (1, "c", "gone", "same", "INFERRED", 4)], "doc_id long, source string, target string, relation string, confidence string, ord int")
    left, moved = graphs.without_duplicates(nodes, edges)
    assert {r["id"] for r in left.collect()} == {"a", "c"} and [(r["source"], r["target"], r["confidence"]) for r in moved.collect()] == [("a", "c", "EXTRACTED")]
    assert [(r["id"], r["degree"]) for r in sorted(graphs.degrees(nodes, edges, 3).collect(), key=lambda r: r["rank"])] == [("c", 3), ("a", 2), ("b", 2)]


def test_repair_chain(spark):
    docs = spark.createDataFrame([(i, json.dumps(x)) for i, x in EXTRACTIONS] + [(7, "{broken"), (8, None)], "doc_id long, raw string")
    got = {r["doc_id"]: r for r in repair.repaired(docs).collect()}
    first = got[1]
    assert [(t["id"], t["content"], t["depends_on"]) for t in first["timeline"]] == [("T-001", "Gate launch", ["T-003"]), ("T-002", "Refund desk", []), ("T-003", "Weekly check", [])]
    assert [s["content"] for s in first["signals"]][2:4] == ["Unresolved temporal reference: Pier survey soon (“soon”)", "Temporal pattern without a safe date: Staff day"]
    assert [d["decision_id"] for d in first["decisions"]] == ["D-001", "D-7"] and first["decisions"][0]["content"] == "keep manual gates at the north pier"
    assert [a["carries_out"] for a in first["actions"]] == ["D-001", None] and first["risks"][0]["why_it_matters"] == "delays the launch"
    assert got[2]["timeline"] == [] and got[2]["signals"][0]["signal_type"] == "unresolved_temporal" and [s["signal_type"] for s in got[4]["signals"]] == ["pattern", "pattern"]
    assert got[5]["meta"]["timeline_mode"] == "none" and got[5]["snapshot"][0]["content"] == "[redacted]" and got[3]["repairs"] == [] == got[7]["signals"] == got[8]["risks"]


def test_json_errors():
    entries_of = {"snapshot": {"heading": "h", "summary": "s"}} | {k: {"entries": []} for k in ("signals", "decisions", "timeline", "risks", "actions")}
    good = {"version": 1, "title": "t", "blocks": [{"kind": k, "payload": p} for k, p in entries_of.items()]}
    codes = lambda x: [(d["code"], d["path"]) for d in json_source.checked(x if isinstance(x, str) else json.dumps(x))["errors"]]
    assert codes(good) == [] and codes("{") == [("json.syntax", None)] and codes([]) == [("json.invalid-field", "$")] and codes(good | {"version": 2}) == [("json.unsupported-version", "$.version")]
    assert codes(good | {"x": 1}) == [("json.unknown-key", "$")] and codes(good | {"blocks": good["blocks"][1:]}) == [("json.missing-kind", "$.blocks")]
    assert codes(good | {"blocks": [*good["blocks"], good["blocks"][0]]}) == [("json.duplicate-kind", "$.blocks[6].kind")]
    assert codes('{"a b": {"__proto__": 1}}') == [("input.unsafe-key", '$["a b"].__proto__')] and codes("[" * 14 + "]" * 14) == [("input.too-deep", "$" + "[0]" * 13)]
    assert codes({"version": 1, "title": "t", "blocks": list(range(101))})[0] == ("input.too-many-entries", "$.blocks")
    late = json.loads(json.dumps(good))
    late["blocks"][5]["payload"]["entries"] = [{"task": "x", "status": "open"}, {"task": "", "status": "done", "due": 4}]
    assert codes(late) == [("json.invalid-field", "$.blocks[5].payload.entries[1].task"), ("json.invalid-field", "$.blocks[5].payload.entries[1].due")]
    late["blocks"][5]["payload"]["entries"].pop()
    done = json_source.checked("\ufeff" + json.dumps(late))
    assert done["rewritten"] == 1 and json.loads(done["source"])["blocks"][5]["payload"]["entries"][0]["status"] == "pending"
    assert json_source.canonical('{"b": 1.0, "a": "e\\u0301\\r\\n"}') == '{"a":"é\\n","b":1}'


def test_binary_guards(spark):
    from marginalia.plans import sources as plans

    got = {r["doc_id"]: (r["code"], r["line"], r["column"], r["format"]) for r in plans.binary_guards(spark, "/root/testdata/sf0.001").where("doc_id < 1000").collect()}
    assert got == {1: (None, None, None, "text"), 2: ("input.binary", 1, 2, "text"), 3: ("input.binary", None, None, "text"), 4: (None, None, None, "text"), 5: (None, None, None, "json"), 6: ("input.binary", 2, 4, "text")}


def test_files_above_the_limit_are_reported(spark, tmp_path):
    (tmp_path / "a.md").write_text("# Pier")
    (tmp_path / "b.txt").write_bytes(b"x" * ((1 << 20) + 1))
    (tmp_path / "c.png").write_bytes(b"x")
    got = {r["label"]: (r["raw"], r["byte_length"], r["code"]) for r in sources.read_files(spark, str(tmp_path)).collect()}
    assert got == {"a.md": ("# Pier", 6, None), "b.txt": (None, (1 << 20) + 1, "input.too-large")}


def test_limitation_themes(spark):
    from marginalia.plans import papers

    place = spark.read.parquet("/root/testdata/sf0.001/supplier.parquet").where("s_suppkey = 0").join(spark.read.parquet("/root/testdata/sf0.001/nation.parquet"), F.col("s_nationkey") == F.col("n_nationkey")).first()["n_name"].lower()
    got = [(r["doc_id"], r["rank"], r["risk"].replace(place, "pier")) for r in papers.limitation_themes(spark, "/root/testdata/sf0.001").where("doc_id < 1000").collect()]
    assert sorted(got) == [
        (1, 1, "Dataset Scope — the logs come from one harbour with mild winters; other harbours may differ in ferry size and staff."),
        (1, 2, "Staffing — we did not evaluate gates without any staff on the pier."),
        (2, 1, "Model Configuration — the study was limited to one pump maker and default parameters."),
    ]


def _other_suppliers(spark, tmp_path):
    """The given suppliers without number 0."""
    for t in ("supplier", "nation"):
        spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet").where("s_suppkey > 0" if t == "supplier" else "true").write.parquet(str(tmp_path / f"{t}.parquet"))
    return str(tmp_path)


def test_extractions_are_compared_within_their_supplier(spark, tmp_path):
    from marginalia.plans import extractions

    rows = extractions.v6_fallback(spark, _other_suppliers(spark, tmp_path)).collect()
    assert {r["doc_id"] // 1000 for r in rows} == set(range(1, 10))
    assert len(rows) == 9 * len(EXTRACTIONS)
    assert {r["doc_id"] % 1000: r["fallback"] for r in rows if r["doc_id"] // 1000 == 4} == {1: False, 2: True, 3: True, 4: True, 5: True, 6: True}


def test_every_paper_is_merged_with_another_graph(spark, tmp_path):
    from marginalia.plans import papers

    rows = papers.kg_merge(spark, _other_suppliers(spark, tmp_path)).collect()
    assert {r["doc_id"] for r in rows} == {1000 * s + n for s in range(1, 10) for n in (1, 2, 3)}
    assert all((r["source"], r["target"]) != ("gate_paper", "missing") and r["source"] != r["target"] for r in rows)
    assert ("gate_paper", "metric_other", "states") in {tuple(r)[1:] for r in rows if r["doc_id"] == 4003}


def test_restated_decisions_merge(spark):
    rows = [("Business Impact", "approved", None, None, None), ("Preserve linked advances during edits", "proposed", None, None, "D-4"), ("Keep the pier blue", "rejected", "considered", None, None), ("Linked advances remain intact after edits of any order", "approved", "committed", "Auditors ask", None)]
    frame = spark.createDataFrame([(rows,)], "d array<struct<text:string,status:string,commitment:string,because:string,ref:string>>")
    got = [tuple(x) for x in frame.select(judgement.merged_decisions(F.col("d")).alias("d")).first()["d"]]
    assert got == [("Linked advances remain intact after edits of any order", "approved", "committed", "Auditors ask", "D-4"), ("Keep the pier blue", "rejected", "considered", None, None)]


def test_insights(spark):
    said = ["The key bottleneck is not staff but readers because the old ones fail in the rain", "The key bottleneck is not the staff but readers because old ones fail in rain", "Trust in the audit trail means the team can recall every single decision about gates", "Short because small"]
    rows = spark.createDataFrame([(1, i, t, None) for i, t in enumerate(said)], "doc_id int, line_no int, text string, section_title string")
    concepts = spark.createDataFrame([(1, ["audit trail"])], "doc_id int, concepts array<string>")
    none = spark.createDataFrame([], "doc_id int, said array<array<string>>")
    got = [(r["rank"], r["line_no"], r["score"], r["label"]) for r in judgement.insights(rows, concepts, none).collect()]
    assert sorted(got) == [(1, 2, 11, "Audit trail"), (2, 0, 9, "Hero insight")]


def test_checks_of_papers(spark):
    rows = [(1, "timeline", "Gates cut queues", None), (1, "timeline", "12 13 14 rows", None), (1, "decisions", " gates cut QUEUES ", None), (1, "signals", "Rate", "4%"), (2, "signals", "Rate", None)]
    got = {r["doc_id"]: tuple(r)[1:] for r in library.research_checks(spark.createDataFrame(rows, "doc_id int, kind string, text string, value string")).collect()}
    assert got == {1: (2, 1, 1, 1, 1, 1), 2: (0, 1, 0, 0, 0, 0)}


def test_recent_items(spark):
    rows = spark.createDataFrame([(1, "u", "a", "2026-01-09 00:00:00"), (2, "u", "a", "2026-01-10 00:00:00"), (3, "u", "b", "2026-01-01 00:00:00")], "id long, owner string, key string, saved_at string").withColumn("saved_at", F.to_timestamp("saved_at"))
    got = library.recent(rows, F.to_timestamp(F.lit("2026-01-11 00:00:00"))).collect()
    assert [r["id"] for r in got] == [2]


def test_stream_runs_once(spark, tmp_path):
    from marginalia.streaming.incremental import run

    spark.createDataFrame([(1, "The gates open at dawn."), (2, "Ferries leave the pier late.")], "doc_id long, text string").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("doc_id long, text string").parquet(str(tmp_path / "in"))
    run(stream, str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2


def test_overlap_counts_frequent_words(spark):
    left = spark.createDataFrame([(1, "pier gates open"), (2, "pier gates open rare")], "item_id long, text string")
    right = spark.createDataFrame([(1, "pier"), (2, "pier gates open more"), (3, "pier gates rare"), (4, "pier gates open rarely")], "doc_id long, text string")
    got = {r["item_id"]: (r["doc_id"], r["shared"], r["jaccard"]) for r in library.overlaps(left, right).collect()}
    assert got == {1: (2, 3, 0.75), 2: (3, 3, 0.75)}
    assert [r["doc_id"] for r in library.overlaps(left.limit(1), right.where("doc_id = 1")).collect()] == [1]


def test_concepts_beyond_two_hundred_phrases(spark):
    """Seven words in every order of three give over 200 phrases, all of which the seven swallow; five later words make it 12."""
    from itertools import permutations

    often, later = ["quartz", "copper", "velvet", "orchid", "marble", "tundra", "walnut"], ["anchor", "beacon", "cactus", "dagger", "falcon", "garnet"]
    lines = [" ".join(p) for p in permutations(often, 3)] * 2 + later * 2
    rows = understanding.line_sections(spark.createDataFrame([(1, "\n".join(lines))], "doc_id long, text string"))
    got = [r["phrase"] for r in sorted(understanding.top_concepts(rows).collect(), key=lambda r: r["rank"])]
    assert set(got[:7]) == set(often) and got[7:] == later[:5]


def test_claims_of_two_sections_with_one_title(spark):
    some = lambda a: "\n".join(f"The {a} harbour number{i} opens its gates early." for i in range(20))
    text = f"# Results\n{some('north')}\n# Other\nThe pier closes at night time.\n# Results\n" + "\n".join(f"Short line{i} here." for i in range(20)) + f"\n{some('south')}"
    rows = research.claims(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()
    assert len(rows) == 41


def test_pages_as_markdown(spark):
    from marginalia.plans import pages

    rows = {r["doc_id"]: r["markdown"] for r in pages.page_markdown(spark, "/root/testdata/sf0.001").collect()}
    nation = spark.read.parquet("/root/testdata/sf0.001/supplier.parquet").where("s_suppkey = 0").join(spark.read.parquet("/root/testdata/sf0.001/nation.parquet"), F.col("s_nationkey") == F.col("n_nationkey")).first()["n_name"].lower()
    assert len(rows) == 10
    first, second = rows[1].replace(nation, "pier").split("<!-- page:2 -->")
    assert first == (
        "<!-- page:1 -->\n# Harbour plan\n1. Gates\nThe gates at the north pier are old and the tickets of the season do not fit their readers.\n\n"
        "A second paragraph follows here after a stop.\n\n| Ticket | Summary | Status |\n| --- | --- | --- |\n| GATE-12 | Replace the reader | Open |\n"
        "| Rate | 12 | 14 |\n\n- first of\n### Owners\nthe pier team and the desk\n\n"
    )
    assert second.startswith("\n# Adaptive gates under winter load on three piers of the harbour\n") and "\n## Abstract\n" in second
    assert second.index("left line 11") < second.index("right line 0") < second.index("right line 11")


def test_markdown_sections_and_titles(spark):
    docs = spark.createDataFrame([(1, "before\r\n\r\n# A \nx\n\n### B\n## C\n  y\n", "a/b.v2.md"), (2, "# \n\n", "c.md"), (3, None, "notes/d.tar.gz"), (4, "", None), (5, "x" * 200, "e")], "doc_id long, text string, label string")
    got = sorted((r["doc_id"], r["section"], r["heading"], r["level"], r["text"], r["start_line"], r["end_line"]) for r in structure.markdown_sections(docs).collect())
    assert got == [(1, 0, None, 0, "before", 1, 2), (1, 1, "A", 1, "x", 3, 5), (1, 2, "B", 3, "", 6, 6), (1, 3, "C", 2, "y", 7, 9), (2, 0, None, 0, "#", 1, 3), (5, 0, None, 0, "x" * 200, 1, 1)]
    titles = dict(docs.select("doc_id", structure.guessed_title(F.col("text"), F.col("label"))).collect())
    assert titles == {1: "before", 2: "#", 3: "d.tar", 4: "", 5: "x" * 160}

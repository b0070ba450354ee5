"""Text and line functions against values derived by reading."""

from pyspark.sql import functions as F

from marginalia.functions import lines as L
from marginalia.functions import text as T


def values(spark, items, column):
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(items)], "i int, t string").select("i", column(F.col("t")).alias("v"))
    return [r["v"] for r in sorted(rows.collect(), key=lambda r: r["i"])]


def test_tokens_and_stems(spark):
    assert values(spark, ["The pier's C++ gates, v1.2.", "", None], T.tokenize) == [["the", "pier", "c++", "gates", "v1.2"], [], None]
    assert values(spark, ["The gates were opened in 2026 by C"], T.content_tokens) == [["gates", "opened"]]
    assert values(spark, ["sourcing", "gates", "policies", "note", "adoptions", "management"], T.stem) == ["sourc", "gat", "polic", "note", "adoption", "manag"]


def test_sentences_hold_abbreviations_and_numbers(spark):
    got = values(spark, ["We met Dr. Holt at 5. Then we left! Why?", "", "One"], T.split_sentences)
    assert got == [["We met Dr. Holt at 5. Then we left!", "Why?"], [], ["One"]]


def test_shortening_and_case(spark):
    assert values(spark, ["one two, three", "one"], lambda c: T.clamp_words(c, 2)) == ["one two...", "one"]
    assert values(spark, ["the objective is to", "ship it", "word"], T.reads_as_fragment) == [True, True, True]
    assert values(spark, ["PDF export", "McKay left", "Gates open"], T.decapitalize) == ["PDF export", "McKay left", "gates open"]


def test_dates(spark):
    assert values(spark, ["Q3 2026: launch", "May need work", "Ship next  week", "due 2026-08-14.", "none"], L.find_date) == ["Q3 2026", None, "next week", "2026-08-14", None]
    assert values(spark, ["May 3, 2026", "May", "12/08/2026 x", "Sprint 4", "soon"], L.looks_like_date) == [True, True, True, True, False]


def test_headings(spark):
    got = values(spark, ["3.1 Risks", "Workflow (IMPORTANT)", "Slide 1 — Problem", "As a Purchase Manager", "Cases – Sheet", "Colours", "Our key requirements now"], L.heading_kind)
    assert got == ["risks", "actions", "risks", "actions", "decisions", None, "decisions"]


def test_signals(spark):
    got = values(spark, ["- Uptime: 99.95% (up 0.2)", "| Calls | 812 | up 9% |", "- How many gates stay manual?", "- Queue time (target: under 4 min)", "- Colour: blue", None], L.parse_signal)
    assert [g and (g["label"], g["value"], g["delta"], g["trend"]) for g in got] == [("Uptime", "99.95%", "up 0.2", "up"), ("Calls", "812", "up 9%", "up"), ("Open question", None, None, None), ("Queue time", "under 4 min", None, None), None, None]


def test_decisions(spark):
    got = values(spark, ["- D-1 Keep the gates — approved", "- Consider leasing spare readers (requested)", "- Redis", "plain prose here", "- Never run updates at noon", "| P0 | Audit log | High |"], L.parse_decision)
    assert [g and (g["ref"], g["text"], g["status"], g["commitment"]) for g in got] == [
        ("D-1", "Keep the gates", "approved", "committed"), (None, "Consider leasing spare readers", "requested", "considered"), None, None, (None, "Never run updates at noon", "proposed", "committed"), ("P0", "P0: Audit log (High)", "approved", "committed"),
    ]


def test_timeline(spark):
    got = values(spark, ["- Phase 2: Install readers — done", "Due date: 2026-08-14", "Departure: Aarhus · 2026-08-12 09:40", "- Q3 2026: Launch - scheduled", "- Ship the desk next week", "no date"], L.parse_timeline)
    assert [g and (g["date"], g["title"], g["state"]) for g in got] == [
        ("Phase 2", "Install readers", "done"), ("2026-08-14", "Due Date: 2026-08-14", "planned"), ("2026-08-12 09:40", "Departure: Aarhus · 2026-08-12 09:40", "planned"), ("Q3 2026", "Launch", "planned"), ("next week", "Ship the desk", "planned"), None,
    ]


def test_risks_need_severity_and_mitigation(spark):
    got = values(spark, ["- Late readers delay the launch (high) - mitigation: lease spares", "- Staff gaps [low]: Train teams", "| Vendor slips | medium | Second vendor |", "- Late readers: lease spares"], L.parse_risk)
    assert [g and (g["risk"], g["severity"], g["mitigation"]) for g in got] == [("Late readers delay the launch", "high", "lease spares"), ("Staff gaps", "low", "Train teams"), ("Vendor slips", "medium", "Second vendor"), None]


def test_actions(spark):
    got = values(spark, ["- [ ] Sign the lease - Mara Holt - Aug 15", "- [x] Survey (Jon Reed, Mar 3)", "User story: I want changes on my phone", "| Train | Ana | May 1 |", "- Sign it"], L.parse_action)
    assert [g and (g["task"], g["owner"], g["due"], g["status"]) for g in got] == [("Sign the lease", "Mara Holt", "Aug 15", "pending"), ("Survey", "Jon Reed", "Mar 3", "done"), ("User story: I want changes on my phone", None, None, "pending"), ("Train", "Ana", "May 1", "pending"), None]

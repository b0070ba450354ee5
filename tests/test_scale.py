"""Plans that must not grow: what a query may cost whatever the size of its tables."""

import pytest

PAPER = "# Gates\n\n## Abstract\nLittle is known about adaptive ferry gates [1].\n\n## Results\nAdaptive gates cut waiting time by 18% in winter.\nAdaptive gates improve boarding on cold mornings [1].\n\n## Limitations\nThe study was limited to one pier only.\n"


@pytest.fixture(scope="module")
def graph(spark):
    from marginalia.operators import research as R

    def made(*texts):
        lines = R.section_lines(spark.createDataFrame(list(enumerate(texts, 1)), "doc_id long, text string")).where("role <> 'references'")
        titles = lines.where("title is not null").groupBy("doc_id").agg({"title": "min"}).selectExpr("doc_id", "'Gates' as title")
        return R.graph(R.claims_of(lines), titles, lines.select("doc_id", "section", "title", "role", "first_line").distinct().where("title is not null"))

    return made


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_graph_is_made_without_joins(graph):
    nodes, edges = graph(PAPER, PAPER)
    assert "Join" not in plan(nodes) + plan(edges)
    kinds = {(r.doc_id, r.relation, r.confidence): 0 for r in edges.collect()}
    assert {k[1:] for k in kinds if k[0] == 2} == {("contains", "EXTRACTED"), ("cites", "EXTRACTED"), ("reports", "EXTRACTED"), ("states", "EXTRACTED"), ("bounds", "EXTRACTED"), ("motivates", "EXTRACTED"), ("addressed_by", "INFERRED"), ("supports", "INFERRED"), ("qualifies", "INFERRED")}
    assert {(r.source, r.target) for r in edges.collect() if r.doc_id == 1} == {(r.source, r.target) for r in edges.collect() if r.doc_id == 2}


@pytest.mark.parametrize(("name", "most"), [("kg_merge", 5), ("kg_surprising", 0), ("kg_degree", 1)])
def test_graph_queries_join_little(spark, name, most):
    from marginalia.plans import papers

    assert plan(papers.QUERIES[name](spark, "/root/testdata/sf0.001")).count("Join ") <= most


def test_told_rows_are_spread(spark):
    from marginalia.plans.fixtures import told

    spark.conf.set("spark.sql.shuffle.partitions", "7")
    try:
        rows = told(spark, "/root/testdata/sf0.01", [(1, "a pier")], "doc_id int, text string")
        assert rows.rdd.getNumPartitions() == 7
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


@pytest.mark.parametrize(("module", "name", "letters"), [("language", "decision_pairs", 30_000), ("extractions", "v6_repairs", 100_000), ("language", "relations_of_entries", 38_000), ("structured", "parse_decisions", 45_000), ("structured", "parse_timeline", 180_000)])
def test_expressions_stand_once(spark, module, name, letters):
    """An expression that a filter below its projection holds once more is evaluated once more for each row."""
    import importlib

    query = importlib.import_module(f"marginalia.plans.{module}").QUERIES[name]
    assert len(plan(query(spark, "/root/testdata/sf0.001"))) < letters


@pytest.mark.parametrize("name", ["concept_weights", "concepts_top12", "concept_ngrams"])
def test_phrases_are_not_shuffled(spark, name):
    """Only a document's text moves: one aggregate, by the document alone."""
    from marginalia.plans import corpus

    found = plan(corpus.QUERIES[name](spark, "/root/testdata/sf0.001"))
    grouped = [x.split("Aggregate [")[1] for x in found.split("\n") if "Aggregate [" in x]
    assert "Join" not in found and grouped and all(x.startswith("doc_id#") and "]" in x[:14] for x in grouped), grouped


def test_a_headings_key_is_made_once(spark):
    from pyspark.sql import functions as F

    from marginalia.functions.lines import heading_kind

    rows = spark.createDataFrame([("2. Open risks (all):",), ("Slide 3 - Next steps",), ("As a rider, I pay",), ("Ferry",), (None,)], "t string").select("t", heading_kind(F.col("t")).alias("kind"))
    assert plan(rows).count("slide|deck") == 1
    assert {r.t: r.kind for r in rows.collect()} == {"2. Open risks (all):": "risks", "Slide 3 - Next steps": "actions", "As a rider, I pay": "actions", "Ferry": None, None: None}

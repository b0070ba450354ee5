"""Toxicity, quality rules, quality classifier, licences, WARC, pipeline."""

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from marginalia.llm import licenses, quality_classifier, quality_rules, queries, toxicity, warc


def same_rows(frame, sql, **views):
    con = duckdb.connect()
    for name, path in views.items():
        con.sql(f"create view {name} as select * from '{path}'")
    want = con.sql(sql)
    columns = sorted(want.columns)
    return sorted(map(str, frame.select(*columns).collect())) == sorted(f"Row({', '.join(f'{c}={v!r}' for c, v in zip(columns, row, strict=True))})" for row in want.select(*columns).fetchall())


def test_rules_as_sql(spark, docs, tmp_path, none):
    whole = docs.where("doc_id is not null").dropDuplicates(["doc_id"])
    whole.unionByName(spark.createDataFrame([(100 + i, t) for i, t in enumerate(["a b c d e f g h i " * 5, "l\nl\n \nl # $", "the pier opens at dawn " * 3 + "and later ferries come"])], "doc_id long, text string"), allowMissingColumns=True).coalesce(1).write.parquet(str(tmp_path / "d"))
    got = quality_rules.judged(spark.read.parquet(str(tmp_path / "d")))
    assert same_rows(got, quality_rules.ORACLE, documents=f"{tmp_path}/d/*.parquet")
    assert quality_rules.judged(none).count() == 0 and "lang" in got.columns


def test_rules_run_without_python(docs):
    plan = quality_rules.judged(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_toxicity_on_held_out_labels(spark):
    d = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    labelled = docs.join(labels.select("doc_id"), "doc_id", "left_semi")
    got = toxicity.scored(labelled, toxicity.train(docs, labels)).join(labels, "doc_id").where("held_out").toPandas()
    assert ((got.predicted == 1) == (got.score >= 0.5)).all() and got.score.between(0, 1).all()
    assert got[(got.toxic == 1) & (got.quality == 1)].predicted.mean() > 0.95 and got[got.toxic == 0].predicted.mean() < 0.05


def test_corrected_risk_learns_from_positives_and_unlabelled():
    g = np.random.default_rng(0)
    word = lambda bad: np.unique(np.r_[g.integers(0, 300, 20), 999 if bad else 998]).astype(np.int32)
    p, u = [word(True) for _ in range(200)], [word(g.random() < 0.1) for _ in range(1000)]
    count = lambda rows: np.bincount(np.concatenate(rows), minlength=toxicity.DIMS)
    ids = toxicity.marked(count(p), len(p), count(u), len(u))
    model = toxicity.fit(p, u, 0.1, ids)
    assert set(model.weights) == {999} and model.weights[999] + model.bias > 0 > model.bias
    assert toxicity.fit([], [word(False)], 0.1, ids).score("anything") < 1e-9


def test_sums_of_tasks_are_those_of_the_driver(spark):
    g = np.random.default_rng(3)
    rows = [(bool(k % 3 == 0), np.unique(g.integers(0, 9, g.integers(0, 6))).astype(np.int32).tobytes(), int(g.integers(1, 5))) for k in range(200)]
    w = g.normal(size=10)
    table = spark.createDataFrame(rows, "positive boolean, pattern binary, n long").repartition(5)
    for a, b in zip(toxicity.local_sums([(p, bytes(x), n) for p, x, n in rows])(w), toxicity.spread_sums(table)(w), strict=True):
        assert np.allclose(a, b)
    # Against the plain definition of the risk's parts.
    for side, got in zip((True, False), toxicity.local_sums(rows)(w), strict=True):
        margins = [(w[list(np.frombuffer(x, np.int32))].sum() + w[-1], n) for p, x, n in rows if p == side]
        assert np.isclose(got[0], sum(n * np.log1p(np.exp(m)) for m, n in margins))
        assert np.isclose(got[10], sum(n / (1 + np.exp(-m)) for m, n in margins)) and np.isclose(got[20], sum(n / (1 + np.exp(m)) for m, n in margins))


def test_features_as_plain_python(docs):
    import re

    import pyarrow as pa

    texts = [r["text"] for r in docs.collect()] + ["Pier's piers,\nPIER ünter-wasser x1y", "a\tb"]
    row, feature = toxicity.features_of(pa.array(texts, pa.string()))
    for k, t in enumerate(texts):
        words = [w for w in re.split(r"[\W\d_]+", (t or "").lower().replace("i̇", "i")) if w]
        if not {"İ", "\u0308", "Σ"} & set(t or ""):  # whose lower case differs between the two
            assert sorted(feature[row == k].tolist()) == sorted({i for w in words for i in toxicity._of_word(w)}), t


def test_training_both_ways_is_the_same(spark, corpus):
    docs, labels = (spark.read.parquet(f"{corpus}/{t}.parquet") for t in ("documents", "labels"))
    a, b = toxicity.train(docs, labels), toxicity.train(docs, labels, on_driver=0)
    assert a.weights.keys() == b.weights.keys() and np.allclose([a.weights[k] for k in a.weights], [b.weights[k] for k in a.weights], atol=1e-6)


def test_toxicity_edges(spark, docs, none):
    labels = spark.createDataFrame([(4, 1, 1), (6, 1, 0), (9, 0, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    model = toxicity.train(docs, labels)
    assert toxicity.scored(docs, model).count() == docs.count() and toxicity.scored(none, toxicity.train(none, labels)).count() == 0
    assert toxicity.scored(docs, toxicity.train(docs, labels.limit(0))).where("predicted = 1").count() == 0


def test_exact_kth_largest(spark):
    g = np.random.default_rng(1)
    keys = np.r_[g.normal(size=500) * 1000, [5.0] * 10, -3.25]
    frame = spark.createDataFrame([(float(k),) for k in keys], "key double")
    for k in (1, 7, 250, 511):
        assert abs(quality_classifier.kth_largest(frame, "key", k) - np.sort(keys)[-k]) < 2e-6
    assert quality_classifier.kth_largest(frame, "key", 512) is None


def test_exact_kth_of_close_keys(spark):
    keys = [1.0 + k * 2.0**-40 for k in range(50)] + [2.0**-30 * k for k in range(-20, 20)] + [7.5] * 9
    frame = spark.createDataFrame([(k,) for k in keys], "key double")
    for k in (1, 9, 10, 30, 59, 60, 75, 99):
        assert quality_classifier.kth_largest(frame, "key", k) == sorted(keys)[-k]


def test_importance_weights_as_plain_python(spark, corpus):
    """Weights and choice of every row against counts in dictionaries."""
    import math
    import zlib
    from collections import Counter

    docs, labels = (spark.read.parquet(f"{corpus}/{t}.parquet") for t in ("documents", "labels"))
    good = {r["doc_id"] for r in labels.where("quality = 1").collect()}

    def grams(text):
        words = [zlib.crc32(w) for w in (text or "").encode().split()]
        two = [((a * 0x9E3779B1 + b * 0x85EBCA6B + 1) % 2**64) >> 7 for a, b in zip(words, words[1:], strict=False)]
        return [x % quality_classifier.BUCKETS for x in words + two]

    texts = {r["doc_id"]: grams(r["text"]) for r in docs.collect()}
    raw, target = Counter(), Counter()
    for i, g in texts.items():
        raw.update(g)
        if i in good:
            target.update(g)
    n, m = (sum(c.values()) + quality_classifier.BUCKETS for c in (raw, target))
    weight = {i: sum(math.log((target[x] + 1) / m) - math.log((raw[x] + 1) / n) for x in g) for i, g in texts.items()}
    got = queries.op9_quality_classifier(spark, corpus).toPandas()
    assert len(got) == len(texts) and np.allclose(got.log_weight, [weight[i] for i in got.doc_id], atol=1e-6)
    noise = {r["doc_id"]: r["x"] for r in docs.select("doc_id", quality_classifier.gumbel(F.col("doc_id"), 9).alias("x")).collect()}
    assert np.allclose(got.gumbel_key, [weight[i] + noise[i] for i in got.doc_id], atol=1e-6)
    k = math.ceil(quality_classifier.keep_share(labels) * len(got))
    assert (got.kept == (got.gumbel_key >= got.gumbel_key.nlargest(k).min())).all()


def test_names_that_clash(spark, docs, corpus):
    """Extra columns under the names that operators use inside keep their values, or the new column takes their place as stated."""
    extra = ["_words", "_lines", "_hashes", "_row", "_key", "_log_weight", "_text", "_id", "_p", "band", "node", "print", "class", "fp"]
    rows = docs.select("*", *[F.lit(k).alias(n) for k, n in enumerate(extra)])
    judged = quality_rules.judged(rows)
    assert set(extra) <= set(judged.columns) and judged.first()["_words"] == 0
    assert licenses.scans(rows).count() == 0
    labels = spark.createDataFrame([(4, 1, 1), (6, 1, 0), (9, 0, None)], "doc_id long, quality int, toxic int")
    assert toxicity.scored(rows, toxicity.train(rows, labels)).columns == ["doc_id", "held_out", "score", "predicted"]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, rows, corpus)
        assert out.columns == rows.columns and all([r[n] for n in extra] == list(range(len(extra))) for r in out.collect())
    assert corpus_pipeline.pack(spark, rows, corpus).count() >= docs.count()
    pages = spark.createDataFrame([(1, "u", "x" * 200, 5, "q"), (2, "u", "x" * 200, 5, "q"), (None, "u", "x" * 200, 5, "q")], "page_id long, url string, html string, digest int, refers string")
    got = {r["page_id"]: (r["record_type"], r["refers_to"]) for r in warc.round_trip(pages).collect()}
    assert got == {1: ("response", None), 2: ("revisit", 1), None: ("revisit", 1)}


def test_classifier_keeps_clean_texts(spark, corpus):
    got = queries.op9_quality_classifier(spark, corpus).join(spark.read.parquet(f"{corpus}/labels.parquet"), "doc_id").toPandas()
    assert got[got.quality == 1].kept.mean() > 0.97 and got[got.quality == 1].log_weight.median() > got[got.quality == 0].log_weight.median()


def test_classifier_counts_every_gram():
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array(["a b a", None]), pa.array([True, False])], names=["_text", "own"])
    out = list(quality_classifier._count(iter([batch])))
    assert sum(sum(b.column(1).to_pylist()) for b in out) == 5 == sum(sum(b.column(2).to_pylist()) for b in out)


def test_classifier_edges(spark, docs, none):
    labels = spark.createDataFrame([(4, 1), (None, 1), (6, None)], "doc_id long, quality int")
    rows = quality_classifier.keyed(docs, quality_classifier.train(docs, labels))
    assert rows.where("_log_weight is null").count() == 0 and rows.where(quality_classifier.chosen(rows, 1.0)).count() == docs.count()
    empty = quality_classifier.keyed(none, quality_classifier.train(none, labels))
    assert empty.where(quality_classifier.chosen(empty, 0.5)).count() == 0


def test_gumbel_is_fixed_and_spread(spark):
    x = np.array([r[0] for r in spark.range(20_000).select(quality_classifier.gumbel(F.col("id"), 9)).collect()])
    assert abs(x.mean() - 0.5772) < 0.05 and abs(x.std() - 1.2825) < 0.05


MIT = "The MIT License (MIT)\n\nCopyright (c) 2020 Some One\n\n" + licenses.SENTENCES["mit-grant"][0].replace(", to any", ",\nto any") + "\n\n" + licenses.SENTENCES["mit-condition"][0] + "\n\n" + licenses.SENTENCES["as-is"][0]


def test_licence_rules():
    rules = lambda t: [(a, b) for a, b, *_ in licenses.scan(t)]
    assert rules(MIT) == [("MIT", "mit-text")] and rules(None) == rules("") == rules("no licence here") == []
    assert rules("Prose.\nReleased under the MIT License.\nLicensed under CC BY-NC 4.0.") == [("MIT", "mit-notice"), ("CC-BY-NC-4.0", "cc-by-nc-4-notice")]
    header = " ".join(licenses.SENTENCES[k][0] for k in ("apache-header", "apache-copy", "apache-as-is"))
    assert rules("# " + header) == [("Apache-2.0", "apache-2-header")]
    assert rules(licenses.SENTENCES["apache-header"][0]) == [("Apache-2.0", "apache-2-short-header")]
    assert rules("it was not Licensed under the MIT License") == []  # not where a sentence starts
    for hit in licenses.scan("x.\nReleased under\n the MIT License."):
        assert "x.\nReleased under\n the MIT License."[hit[2] : hit[3]] == "Released under\n the MIT License"


def test_licences_of_documents(spark, docs, none, corpus):
    text = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{corpus}/documents.parquet").collect()}
    got = queries.op6_licenses(spark, corpus).collect()
    want = {(i, m[0], m[2], m[3]) for i, t in text.items() for m in licenses.scan(t)}
    assert {(r["doc_id"], r["license"], r["start"], r["end"]) for r in got} == want and len(got) == len(want)
    assert licenses.scans(docs).count() == 0 == licenses.scans(none).count()
    import re

    assert all(re.search(licenses.ANCHORS, form.lower()) for forms in licenses.SENTENCES.values() for form in forms)


def test_licences_of_wrapped_lines(spark):
    """What the matcher takes passes the filter before it, whatever stands between two words."""
    forms = [(form.replace(" ", gap), form) for forms in licenses.SENTENCES.values() for form in forms for gap in ("\n", "  ", "\t# ", "_", "\u00a0", " \u2028 ")]
    forms += [("RELEASED\nUNDER\nCC BY 4.0", ""), ("L\u0130CENSED UNDER CC BY 4.0", "")]
    docs = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(forms)], "doc_id long, text string")
    got = {(r["doc_id"], r["license"], r["start"], r["end"]) for r in licenses.scans(docs).collect()}
    assert got == {(i, m[0], m[2], m[3]) for i, (t, _) in enumerate(forms) for m in licenses.scan(t)}
    assert {m[0] for m in licenses.scan("Released under\nCC BY 4.0")} == {"CC-BY-4.0"} and len(got) > 200


def test_licences_with_many_holders():
    holders = "\n".join(f"Copyright (c) {2000 + i} Some Person Number {i} of a Long List" for i in range(9))
    text = "\n\n".join(["MIT License", holders, *(licenses.SENTENCES[n][0] for n in ("mit-grant", "mit-condition", "as-is"))])
    assert [m[1] for m in licenses.scan(text)] == ["mit-text"]
    assert [m[1] for m in licenses.scan(text.replace("Copyright (c)", "Written in"))] == ["mit-text-untitled"]


def brute_scan(text):
    """Every known sentence at every place where one may start, by words; then the rules from left to right."""
    import re

    low = text.lower()
    spots = [(m.group(), m.start(), m.end()) for m in re.finditer(r"[^\W_]+(?:\.[0-9]+)*", low)]
    words, found, at = [w for w, _, _ in spots], [], 0
    forms = sorted(((licenses.form_of(f), n) for n, fs in licenses.SENTENCES.items() for f in fs), key=lambda x: -len(x[0]))
    forms = [x for x in forms if "*" not in x[0]]
    after_sentence = True
    while at < len(words):
        if after_sentence or re.search(r"[\n.;:!?]", low[spots[at - 1][2] : spots[at][1]]):
            hit = next(((f, n) for f, n in forms if tuple(words[at : at + len(f)]) == f), None)
            if hit:
                found.append((hit[1], spots[at][1], spots[at + len(hit[0]) - 1][2], at, at + len(hit[0])))
                at, after_sentence = at + len(hit[0]), True
                continue
        at, after_sentence = at + 1, False
    out = []
    while found:
        rule = next((r for r in licenses.RULES if tuple(x[0] for x in found[: len(r[2])]) == r[2] and all(b[3] - a[4] <= 12 for a, b in zip(found[: len(r[2])], found[1 : len(r[2])], strict=False))), None)
        n = len(rule[2]) if rule else 1
        if rule:
            out.append((rule[1], rule[0], found[0][1], found[n - 1][2]))
        found = found[n:]
    return out


def test_licences_against_brute_force(spark, corpus):
    import random

    r = random.Random(8)
    forms = [f for fs in licenses.SENTENCES.values() for f in fs if "*" not in f]
    texts = [t["text"] or "" for t in spark.read.parquet(f"{corpus}/documents.parquet").collect()][:60]
    for _ in range(120):
        parts = [r.choice(forms).replace(" ", r.choice([" ", "\n", "  "])) if r.random() < 0.7 else r.choice(["Copyright 2020 A B", "some words, and more words", "x."]) for _ in range(r.randint(1, 6))]
        texts.append(r.choice([" ", "\n", ". "]).join(parts))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = sorted((m["doc_id"], m["license"], m["rule"], m["start"], m["end"]) for m in licenses.scans(docs).collect())
    assert got == sorted((i, *m) for i, t in enumerate(texts) for m in brute_scan(t)) and len(got) > 100


def test_licence_families():
    text = lambda *names: "\n\n".join(licenses.SENTENCES[n][0] for n in names)
    rules = lambda t: [a for a, *_ in licenses.scan(t)]
    bsd = ("bsd-grant", "bsd-source", "bsd-binary")
    assert rules(text(*bsd)) == ["BSD-2-Clause"] and rules(text(*bsd, "bsd-endorsement").replace("*", "its owner")) == ["BSD-3-Clause"]
    numbered = "\n".join(f"{i}. {licenses.SENTENCES[n][0]}" for i, n in enumerate((*bsd[1:], "bsd-endorsement"), 1))
    for holder in ("the copyright holder nor the names of its contributors", "Some University nor the\nnames of its contributors"):
        assert rules(text("bsd-grant") + "\n" + numbered.replace("*", holder)) == ["BSD-3-Clause"]
    assert rules(text("agpl-grant-3", "gpl-warranty")) == ["AGPL-3.0-or-later"] and rules(text("lgpl-grant-21", "lgpl-warranty")) == ["LGPL-2.1-or-later"]
    assert rules(text("mpl-grant")) == ["MPL-2.0"] and rules(text("unlicense-grant")) == ["Unlicense"]


def test_arc_versions_and_lengths():
    records = [("http://a/ b", "text/html", warc.http_response(b"one\n\ntwo", "7")), (None, "text/plain", b"plain"), ("http://c", "text/html", warc.http_response(b"", ""))]
    for version in (1, 2):
        raw = warc.write_arc(records, version)
        back = list(warc.read_arc(raw))
        assert [r.content for r in back] == [r[2] for r in records] and [r.url for r in back] == ["http://a/%20b", "about:blank", "http://c"]
        assert len(raw.split(b"\n")[0].split(b" ")) == (5 if version == 1 else 10)
        with pytest.raises(ValueError, match="beyond the end"):
            list(warc.read_arc(raw[:-20]))
    with pytest.raises(ValueError, match="filedesc"):
        list(warc.read_arc(b"http://x 0 0 0 3\nabc\n"))


def test_arc_dates_and_content_types():
    raw = b"filedesc://x 0.0.0.0 20240101000000 text/plain 2\n1 \n" + b"http://a 1.2.3.4 202401020304 text/html; charset=utf-8 5\nhello\n"
    (r,) = warc.read_arc(raw)
    assert r.content_type == "text/html; charset=utf-8" and r.content == b"hello" and r.ip == "1.2.3.4"
    ((fields, block),) = warc.read_warc(warc.gzipped(warc.to_warc(r, "k")))
    assert fields["WARC-Date"] == "2024-01-02T03:04:00Z" and fields["Content-Type"] == "text/html; charset=utf-8" and block == b"hello"


def test_arc_files_from_storage(spark, tmp_path):
    import gzip

    records = [(f"http://a/{i}", "text/html", warc.http_response(b"x" * i, str(i))) for i in range(300)]
    (tmp_path / "one.arc").write_bytes(warc.write_arc(records, 1))
    (tmp_path / "two.arc.gz").write_bytes(gzip.compress(warc.write_arc(records[:3], 2)) + gzip.compress(b"\n"))
    got = warc.arc_records(spark, str(tmp_path)).collect()
    assert len(got) == 303 and all(next(warc.read_warc(r["warc"]))[0]["WARC-Target-URI"] == r["url"] for r in got)


def test_revisits_of_a_popular_payload(spark):
    rows = [(i, "d", 200) for i in range(500)] + [(None, "d", 200), (7, "e", 99), (8, "e", 99), (9, "f", 100)]
    got = warc.revisits(spark.createDataFrame(rows, "_id long, digest string, n int")).collect()
    assert {(r["_id"], r["refers"]) for r in got} == {(i, 0) for i in range(1, 500)} | {(None, 0)}


def test_warc_records():
    arc = list(warc.read_arc(warc.write_arc([("http://a", "text/html", warc.http_response(b"x" * 200, "7")), ("http://b", "text/plain", b"plain")])))
    raw = warc.gzipped(warc.to_warc(arc[0], "7")) + warc.gzipped(warc.to_warc(arc[0], "8", "7")) + warc.gzipped(warc.to_warc(arc[1], "9"))
    (a, block), (b, head), (c, plain) = warc.read_warc(raw)
    assert a["WARC-Type"] == "response" and block.endswith(b"x" * 200) and a["WARC-Date"] == "2024-01-01T00:00:00Z"
    assert b["WARC-Type"] == "revisit" and b["WARC-Refers-To"] == a["WARC-Record-ID"] != b["WARC-Record-ID"] and head.endswith(b"\r\n\r\n") and b["WARC-Payload-Digest"] == a["WARC-Payload-Digest"]
    assert c["WARC-Type"] == "resource" and plain == b"plain"


def test_round_trip_as_sql(spark, tmp_path):
    same = "<p>" + "é" * 60
    rows = [(1, "u", same), (2, None, same), (3, "u v", None), (4, "u", ""), (5, "u", "short"), (6, "u", "short"), (7, "u", "x" * 300_000), (9, "u", same), (8, "u", "a\r\n\r\nb" * 30)]
    spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1).write.parquet(str(tmp_path / "p"))
    pages = spark.read.parquet(str(tmp_path / "p"))
    assert same_rows(warc.round_trip(pages, batch=2), warc.ORACLE, pages=f"{tmp_path}/p/*.parquet")
    assert warc.round_trip(pages.limit(0)).count() == 0


def test_pipeline(spark, corpus):
    docs = spark.read.parquet(f"{corpus}/documents.parquet")
    left, ids = docs, {r[0] for r in docs.select("doc_id").collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        left = stage(spark, left, corpus)
        kept = {r[0] for r in left.select("doc_id").collect()}
        assert left.columns == docs.columns and kept <= ids, name
        ids = kept
    assert len(ids) < docs.count()
    packed = corpus_pipeline.run(spark, corpus)
    assert {r[0] for r in packed.select("doc_id").distinct().collect()} == ids


def test_pipeline_of_nothing(spark, none, corpus):
    left = none
    for _, stage in corpus_pipeline.STAGES:
        left = stage(spark, left, corpus)
    assert left.count() == 0

"""SimHash, components and embeddings against brute force."""

import math
import random

import corpus_pipeline
import numpy as np
import xxhash

from marginalia.llm import embedding_dedup, near_copies, quality_classifier, simhash
from marginalia.llm.common import Forest, components


def plain_print(text):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprints(docs, none):
    for r in simhash.fingerprints(docs, keep=("doc_id", "text")).collect():
        assert r["fingerprint"] & (1 << 64) - 1 == plain_print(r["text"])
    assert simhash.near_duplicates(none).count() == 0


def test_anchors_cover_every_near_pair():
    r = random.Random(1)
    for _ in range(300):
        x = r.getrandbits(32)
        y = x ^ (1 << r.randrange(32)) if r.random() < 0.8 else x
        row, anchor, home = simhash.anchors_of(np.array([x, y], dtype=np.uint32))
        of = lambda k, only: set(anchor[(row == k) & (home | (not only))].tolist())
        assert of(0, True) <= of(1, False) and of(1, True) <= of(0, False) and len(of(0, True)) == 1
        assert all(bin(a ^ x).count("1") <= 2 for a in of(0, False))


def wanted(prints, most=3):
    forest = Forest()
    ids = list(prints)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            if bin((prints[a] ^ prints[b]) & (1 << 64) - 1).count("1") <= most:
                forest.join(a, b)
    return {i: forest.find(i) for i in ids}


def test_links_reach_the_same_components(spark):
    r = random.Random(2)
    prints = {}
    for _ in range(12):
        x = r.getrandbits(64)
        for _ in range(r.randint(1, 12)):
            prints[len(prints)] = x - (1 << 64) if x >> 63 else x
            for _ in range(r.randint(0, 4)):
                x ^= 1 << r.randrange(64)
    rows = spark.createDataFrame([(x,) for x in set(prints.values())], "fingerprint long")
    by_value = wanted({x: x for x in set(prints.values())})
    for hot in (4096, 0):  # 0: every anchor is split
        got = {e["node"]: e["component"] for e in components(simhash.links(rows, hot=hot)).collect()}
        groups = lambda of: {frozenset(x for x in by_value if of(x) == c) for c in {of(x) for x in by_value}}
        assert groups(lambda x: got.get(x, x)) == groups(lambda x: by_value[x])  # noqa: B023


def test_large_group_of_one_anchor():
    """A hot anchor's forest connects what all its pairs would."""
    r = random.Random(3)
    base = r.getrandbits(64)
    prints = np.unique(np.array([base ^ (1 << r.randrange(64)) ^ (1 << r.randrange(64)) for _ in range(300)], dtype=np.uint64))
    edges = simhash._forest(prints, np.ones(len(prints), bool), 3)
    forest = Forest()
    for a, b in edges:
        forest.join(a, b)
    want = wanted(dict(enumerate(prints.tolist())))
    assert len(edges) < len(prints) and all(forest.find(i) == want[i] for i in want)


def test_near_duplicates(docs):
    rows = simhash.near_duplicates(docs).collect()
    want = wanted({r["doc_id"]: r["fingerprint"] for r in rows if r["doc_id"] is not None})
    assert len(rows) == docs.count() and all(r["component_id"] == want[r["doc_id"]] for r in rows if r["doc_id"] is not None)


def test_components_of_a_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(60)] + [(1000, 1000 + i) for i in range(1, 50)] + [(5, 5), (None, 3), (2000, 2001), (2001, 2000)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "x long, y long").repartition(4)).collect()}
    assert got == {**dict.fromkeys(range(61), 0), **dict.fromkeys(range(1000, 1050), 1000), 2000: 2000, 2001: 2000}
    assert components(spark.createDataFrame([], "x long, y long")).count() == 0


def test_quantisation_bound():
    x = np.random.default_rng(0).normal(size=(200, 40))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    q, s, e = embedding_dedup.quantised(x)
    rough = (q.astype(float) @ q.T.astype(float)) * s[:, None] * s[None]
    assert (np.abs(x @ x.T - rough) <= e[:, None] + (1 + e)[:, None] * e[None] + 1e-12).all()


def test_embeddings(spark):
    g = np.random.default_rng(1)
    base = g.normal(size=(40, 16))
    rows = []
    for b in base:
        for _ in range(g.integers(1, 8)):
            rows.append((b + g.normal(size=16) * g.choice([0, 0.05, 0.2])) * g.choice([1.0, 3.0]))
    data = [(i, x.astype(np.float32).tolist(), 0) for i, x in enumerate(rows)] + [(900, None, 0), (901, [0.0] * 16, 0), (902, [1.0, None], 0), (903, [float("nan")] * 16, 0), (904, [1.0, 0.0], 0), (905, [9.0, 0.0], 0), (905, [9.0, 0.0], 1)]
    frame = spark.createDataFrame(data, "vec_id long, embedding array<float>, label int")
    x = np.array([np.array(d[1], np.float32) for d in data[: len(rows)]], dtype=float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = (x @ x.T >= 0.95) & ~np.eye(len(x), dtype=bool)
    forest = Forest()
    for a, b in np.argwhere(near):
        forest.join(int(a), int(b))
    for tile, band in ((1024, 8), (16, 2)):
        got = [r for r in embedding_dedup.near_duplicates(frame, tile=tile, band=band).collect()]
        assert len(got) == len(data)
        for r in got:
            if r["vec_id"] < 900:
                assert (r["n_links"], r["component_id"]) == (near[r["vec_id"]].sum(), forest.find(r["vec_id"]))
            assert r["kept"] == (r["vec_id"] == r["component_id"])
        odd = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in got if r["vec_id"] >= 900}
        assert odd == {900: (0, 900), 901: (0, 901), 902: (0, 902), 903: (0, 903), 904: (2, 904), 905: (2, 904)}
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert embedding_dedup.near_duplicates(empty).count() == 0


def test_tiles_that_may_meet(spark):
    """Pruned meetings hold every pair of vectors above the threshold."""
    g = np.random.default_rng(5)
    x = np.repeat(g.normal(size=(30, 3)), 40, axis=0) + g.normal(size=(1200, 3)) * 0.1
    data = [(i, v.tolist()) for i, v in enumerate(x)]
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = (unit @ unit.T >= 0.95) & ~np.eye(len(x), dtype=bool)
    got = embedding_dedup.near_duplicates(spark.createDataFrame(data, "vec_id long, embedding array<double>"), tile=32, band=2).collect()
    assert all(r["n_links"] == near[r["vec_id"]].sum() for r in got) and len(got) == 1200
    tiles = spark.createDataFrame([(0, 3, [0.1], [0.2]), (1, 3, [0.3], [0.4]), (2, 3, [2.0], [2.1]), (3, 4, [], [])], "tile int, dim int, low array<double>, high array<double>")
    assert {tuple(r) for r in embedding_dedup.meetings(tiles, 0.95, 1).collect()} == {(0, 0, 0), (1, 1, 1), (0, 1, 0), (0, 1, 1), (2, 2, 2), (3, 3, 3)}


def test_candidates_of_prints(spark):
    rows = [(1, 0), (2, 0), (3, 7), (4, (1 << 40) - 1), (9, 7)]
    got = {tuple(r) for r in near_copies.print_pairs(spark.createDataFrame(rows, "node long, print long")).collect()}
    assert {(2, 1), (9, 3), (3, 1)} == got


def test_pipeline_keeps_one_of_each_near_copies(spark):
    """Rewritten copies around similarity 0.8, against brute force over all pairs."""
    r = random.Random(4)
    texts = []
    for _ in range(40):
        words = [f"w{r.randrange(5000)}" for _ in range(r.choice([4, 40, 200, 600]))]
        for _ in range(r.randint(1, 6)):
            texts.append(" ".join(words))
            words = list(words)
            for _ in range(r.randint(0, len(words) // 40)):
                words[r.randrange(len(words))] = f"v{r.randrange(5000)}"
    texts += [None, "", " ", "one", "ONE"]

    def plain(t):
        words = (t or "").lower().split()
        return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()

    sets, forest = [plain(t) for t in texts], Forest()
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a == b or 10 * len(a & b) >= 8 * len(a | b):
                forest.join(i, j)
    want = {i for i in range(len(texts)) if forest.find(i) == i}
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    got = [x["doc_id"] for x in corpus_pipeline.drop_near_copies(spark, docs, "").collect()]
    assert sorted(got) == sorted(want) and len(want) < len(texts)


def test_pipeline_keeps_rows_not_ids(spark):
    """Null ids, and one id with two texts of which one is a copy of a smaller id's."""
    a, b, c, d = (" ".join(f"{x}{i}" for i in range(30)) for x in "abcd")
    docs = spark.createDataFrame([(1, a), (2, a), (2, b), (None, c), (None, d), (None, a), (3, b), (2, b)], "doc_id long, text string")
    got = [(x["doc_id"], x["text"]) for x in corpus_pipeline.drop_near_copies(spark, docs, "").collect()]
    assert sorted(got, key=lambda x: x[1]) == [(1, a), (2, b), (None, c), (None, d)]


def test_sketches_drop_no_similar_pair(spark):
    """Whatever the sizes, a similar pair passes; pairs that share a part only are dropped before their texts move."""
    r = random.Random(8)
    dropped = 0
    for n in (1, 2, 5, 60, 61, 63, 64, 65, 400, 3000):
        for m in (n, n + n // 9, n + n // 4, 2 * n):
            for shared in {n, n - n // 10, n - n // 9, n // 2, 0}:
                pool = [b"%d" % x for x in r.sample(range(10**9), n + m)]
                a, b = set(pool[:n]), set(pool[n - shared : n - shared + m])
                fits = near_copies.may_be_similar(len(a), near_copies.sketch(near_copies.hashes_of(a)), len(b), near_copies.sketch(near_copies.hashes_of(b)))
                assert fits or not near_copies.similar(a, b)
                dropped += not fits
    assert dropped > 100
    texts = {1: " ".join(f"a{i}" for i in range(300)), 2: " ".join(f"a{i}" for i in range(290)), 3: " ".join(f"a{i}" if i < 150 else f"b{i}" for i in range(300))}
    sets = [(k, near_copies.hashes_of(near_copies.shingles(t))) for k, t in texts.items()]
    signed = spark.createDataFrame([(k, len(h), bytearray(near_copies.sketch(h))) for k, h in sets], "_row long, size long, sketch binary")
    pairs = spark.createDataFrame([(2, 1), (3, 1), (3, 2)], "a long, b long")
    assert {tuple(x) for x in near_copies.possible(pairs, signed).collect()} == {(2, 1)}


def test_texts_are_not_stored_for_their_keys(spark, tmp_path, monkeypatch):
    """The quality stage writes keys only, and keeps what the rows with their keys say."""
    docs = spark.createDataFrame([(i, " ".join(f"w{i * k % 50}" for k in range(30))) for i in range(200)], "doc_id long, text string")
    spark.createDataFrame([(i, i % 2, 0) for i in range(0, 200, 3)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    written = []
    monkeypatch.setattr(corpus_pipeline, "stored", lambda rows, name: written.append(rows.columns) or near_copies.stored(rows, name))
    got = {r["doc_id"] for r in corpus_pipeline.drop_low_quality(spark, docs, str(tmp_path)).collect()}
    labels = spark.read.parquet(str(tmp_path / "labels.parquet"))
    keys = {r["doc_id"]: r["_key"] for r in quality_classifier.keyed(docs, quality_classifier.train(docs, labels)).collect()}
    n = math.ceil(quality_classifier.keep_share(labels) * 200)
    assert got == set(sorted(keys, key=keys.get)[-n:])
    assert written and not any("text" in c for c in written)


def test_texts_stay_where_they_lie(spark, monkeypatch):
    """Neither texts nor bands are shuffled for a few ids, however many rows stay; with many ids they are, and the result is the same."""
    texts = [" ".join(f"w{i % 25}x{k}" for k in range(30)) for i in range(40)] + [None, "", "one", "ONE"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    moves = lambda rows: "Exchange hashpartitioning" in rows._jdf.queryExecution().executedPlan().toString()
    made, nodes_of = [], near_copies.class_nodes
    monkeypatch.setattr(near_copies, "class_nodes", lambda *tables: made.append(nodes_of(*tables)) or made[-1])
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as if all tables were large
    try:
        for few in (near_copies.FEW, 0):
            monkeypatch.setattr(near_copies, "FEW", few)
            got = corpus_pipeline.drop_near_copies(spark, docs, "")
            assert moves(got) == moves(made[-1][1]) == (few == 0)
            assert sorted(r["doc_id"] for r in got.collect()) == [*range(25), 40, 42]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)

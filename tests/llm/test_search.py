"""Exact top-k, tokenizer alignment and collocations against brute force."""

import collections
import hashlib
import itertools
import re

import duckdb
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from marginalia.llm import alignment, collocations, exact_topk
from marginalia.llm.bpe import byte_letters

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
VECTORS = "vec_id long, embedding array<double>, label int, id string, score string"


def best_of(rows, k=5):
    """(query id, rank, id, score) by comparing everything."""
    good = [(i, [int(np.floor(256 * c)) for c in v]) for i, v in rows if i is not None and v is not None and all(c is not None and np.isfinite(c) for c in v)]
    out = []
    for at, (q, x) in enumerate(good):
        if q % 50 == 0:
            score = lambda y, x=x: min(max(sum(a * b for a, b in zip(x, y, strict=True)), -(2**63)), 2**63 - 1)
            found = sorted((-score(y), i) for j, (i, y) in enumerate(good) if j != at and len(x) == len(y))
            out += [(q, r, i, -s) for r, (s, i) in enumerate(found[:k], 1)]
    return sorted(out)


def searched(spark, rows, **options):
    table = spark.createDataFrame([(i, v, 0, "other", None) for i, v in rows], VECTORS)
    out = exact_topk.top_k(table, F.col("vec_id") % 50 == 0, **options)
    assert out.columns == ["query_id", "rank", "vec_id", "score"]
    return sorted(map(tuple, out.collect()))


@pytest.mark.parametrize("options", [{}, {"group": 64, "ask_group": 3, "size": 8 * 6 * 40}, {"k": 1, "group": 100}])
def test_top_k_of_clusters(spark, options):
    r = np.random.default_rng(5)
    centres = r.normal(size=(7, 6))
    rows = [(i, (centres[i % 7] + 0.2 * r.normal(size=6)).tolist()) for i in range(700)]
    assert searched(spark, rows, **options) == best_of(rows, options.get("k", 5))


def test_top_k_of_ties_and_odd_vectors(spark):
    same = [0.5, -0.25, 0.1]
    rows = [(i, same) for i in range(120)] + [(50, same), (50, [0.5, 0.5, 0.5]), (None, same), (100, None), (150, [0.1, None, 0.2]), (200, [float("nan"), 0.0, 0.0])]
    rows += [(250, []), (251, []), (300, [0.0, 0.0, 0.0]), (350, [1.0]), (400, [1e6, -1e6, 3.0]), (401, [1e15, 1.0, 1.0]), (450, [1e200, 1.0, 1.0]), (451, [-1e200, 1.0, 1.0])]
    assert searched(spark, rows, group=40, size=1 << 10) == best_of(rows)
    assert searched(spark, []) == [] and searched(spark, [(50, [1.0])]) == []


def test_lists_stop_early():
    r = np.random.default_rng(1)
    x = np.floor(256 * r.normal(size=(4000, 8)))
    x[7] = 3 * np.abs(x).max(axis=0)
    queries = np.vstack([np.abs(x[3]) + 1, x[7], -x[9]])
    lists = exact_topk.Lists(x)
    limits = np.array([np.sort(x @ q)[-5] for q in queries])
    found = dict(exact_topk.survivors(lists, queries, 5, limits, np.array([3, 7, -1]), lambda q: np.zeros(4000, bool)))
    assert set(found) == {0, 1, 2} and lists.depth < 4000
    for q, own in ((0, 3), (1, 7), (2, None)):
        assert len(found[q]) <= 125 and set(np.flatnonzero(x @ queries[q] > limits[q])) - {own} <= set(found[q])


ODD = ["a▁b", "日本語 テキスト 🙂  x", "<|endoftext|> <s> </s>", "  two  blanks\n\n\n x \t y", "\x00nul \x1c", "ﬁ ligature", " ", "مرحبا ก็", "it's they'll ΣΑΣ 12345", "à̀ ͏", "word " * 9_000, "x" * 5_000]


def plainly(texts):
    """ids, links and groups of each text by two pointers."""
    import sentencepiece
    from tokenizers import Tokenizer

    left, right = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    left.encode_special_tokens = True
    back = {c: b for b, c in enumerate(byte_letters())}
    out = []
    for text in texts:
        a = left.encode(" " + text, add_special_tokens=False).ids if text else []
        b = right.encode(text) if text else []
        x = [bytes(back[c] for c in left.id_to_token(i)) for i in a]
        y = [bytes([int(right.id_to_piece(i)[3:5], 16)]) if right.is_byte(i) else right.id_to_piece(i).replace("▁", " ").encode() for i in b]
        if not text or b"".join(x) != (" " + text).encode() or b"".join(y) != (" " + text).encode():
            out.append(([], [], [], []))
            continue
        x, y = (list(itertools.accumulate(map(len, side))) for side in (x, y))
        i = j = 0
        links, groups, since = [], [], (0, 0)
        while i < len(a):
            links.append((i, j))
            step = (x[i] <= y[j], y[j] <= x[i])
            if all(step):
                groups.append(f"{','.join(map(str, a[since[0] : i + 1]))}|{','.join(map(str, b[since[1] : j + 1]))}")
                since = i + 1, j + 1
            i, j = i + step[0], j + step[1]
        out.append((a, b, links, groups))
    return out


def test_alignment(spark, docs, none, monkeypatch):
    monkeypatch.setattr(alignment, "UNIT", 1 << 16)
    rows = docs.select("doc_id", "text", F.lit("theirs").alias("unit"), F.lit(1).alias("links"))
    rows = rows.union(spark.createDataFrame([(100 + i, t, "u", 2) for i, t in enumerate(ODD)], "doc_id long, text string, unit string, links int"))
    found = rows.collect()
    plain = plainly([r["text"] for r in found])
    got = alignment.aligned(rows, A, B, keep=("doc_id", "text")).collect()
    key = lambda x: (x[0] is None, x[0] or 0, repr(x[1:]))
    mine = [(r["doc_id"], r["text"], r["a_ids"], r["b_ids"], list(zip(r["link_a"], r["link_b"], strict=True)), r["groups"]) for r in got]
    assert sorted(mine, key=key) == sorted([(r["doc_id"], r["text"], a, b, links, ";".join(groups)) for r, (a, b, links, groups) in zip(found, plain, strict=True)], key=key)
    pairs = [[(a[i], b[j]) for i, j in links] for a, b, links, _ in plain]
    counts = collections.Counter(p for x in pairs for p in set(x))
    best = {a: max(n for (x, _), n in counts.items() if x == a) for a, _ in counts}
    want = []
    for r, p, (a, b, links, groups) in zip(found, pairs, plain, strict=True):
        digest = hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else ""
        want.append((r["doc_id"], len(a), len(b), len(groups), len(links), sum(counts[x] == best[x[0]] for x in p), sum(counts[x] for x in p), digest))
    digest = {"groups_sha256": ("string", alignment.groups_sha256)}
    got = alignment.with_counts(rows, A, B, more=digest)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert sorted(map(tuple, got.collect()), key=key) == sorted(want, key=key)
    assert alignment.with_counts(none, A, B).count() == 0


def phrases_of(rows, least, longest=4, first=2000, share=80):
    """(lang, rank, phrase, a, l, r, n, score) by counting everything."""
    f, n = collections.Counter(), collections.Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\n-\r]", lowered):
            words = re.findall("[^ \t]+", piece)
            n[lang] += len(words)
            f.update((lang, *words[i : i + k]) for k in range(1, longest + 1) for i in range(len(words) - k + 1))
    many = {p: c for p, c in f.items() if c >= least and len(p) > 2}
    held = collections.defaultdict(int)
    for (lang, *w), c in many.items():
        for k in range(2, len(w)):
            for i in range(len(w) - k + 1):
                held[(lang, *w[i : i + k])] = max(held[(lang, *w[i : i + k])], c)
    scored = []
    for (lang, *w), a in many.items():
        if 100 * held[(lang, *w)] >= share * a:
            continue
        cuts = [(2_000_000 * a // (f[(lang, *w[:k])] + f[(lang, *w[k:])]), k) for k in range(1, len(w))]
        score, k = min(cuts)
        scored.append((lang, -score, -a, " ".join(w).encode(), f[(lang, *w[:k])], f[(lang, *w[k:])]))
    scored.sort()
    out = []
    for lang, own in itertools.groupby(scored, lambda x: x[0]):
        out += [(lang, i, p.decode(), -a, left, right, n[lang], -s) for i, (_, s, a, p, left, right) in enumerate(itertools.islice(own, first), 1)]
    return out


def collected(spark, rows, **options):
    table = spark.createDataFrame([(t, g, 1, "x", 2) for t, g in rows], "text string, lang string, n int, phrase string, block int")
    return sorted(map(tuple, collocations.collocations(table, **options).collect()))


@pytest.mark.parametrize("options", [{"least": 3}, {"least": 3, "most_bits": 1 << 16, "first": 5}, {"least": 300}, {"least": 2, "longest": 2}])
def test_collocations(spark, options):
    r = np.random.default_rng(3)
    words = ["of", "The", "the", "new", "york", "times", "ÉTÉ", "été", "x y", "<s>", "a", "b"]
    texts = [" ".join(r.choice(words, 30)) for _ in range(60)] + ["new york times\tnew  york, times! New York Times of of of of"] * 40
    rows = [(t, (None, "en", "de")[i % 3]) for i, t in enumerate(texts)] + [("of the " * 4_000, "en"), (None, "en"), ("", None), (" .\n, ", "fr"), ("solo", "fr")]
    plain = {k: v for k, v in options.items() if k != "most_bits"}
    assert collected(spark, rows, **options) == sorted(phrases_of(rows, **plain))


def test_collocations_of_no_rows(spark):
    assert collected(spark, []) == [] and collected(spark, [(None, None)]) == []


@pytest.mark.parametrize("name, oracle, run", [("op11", exact_topk.ORACLE, "op11_exact_topk"), ("op13", collocations.ORACLE, "op13_collocations")])
def test_queries_against_sql(spark, corpus, name, oracle, run):
    from marginalia.llm import queries

    con = duckdb.connect()
    for t in ("embeddings", "documents"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{corpus}/{t}.parquet'")
    got = queries.QUERIES[run](spark, corpus)
    names = ", ".join(got.columns)
    assert sorted(map(tuple, got.collect())) == sorted(con.execute(f"SELECT {names} FROM ({oracle})").fetchall())

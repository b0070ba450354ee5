"""BPE, token counts and packing against the library and brute force."""

import itertools
import random

import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

from marginalia.llm import bpe, packing, token_counts

WORDS, BYTES = P.path("word_bpe_49k.json"), P.path("byte_bpe_50k.json")
LETTERS = "aAbBz019 .,'!<|>éÉß̈ñΣσ漢字😀\n\t\x1c\x85  İsrevlmtd"


def odd_texts(n, seed=0):
    r = random.Random(seed)
    return ["".join(r.choice(LETTERS) for _ in range(r.randint(0, 50))) for _ in range(n)] + ["<|endoftext|>", "a<|endoftext|> b<|startoftext|>c", " " * 50 + "a", "x" * 500]


def test_encode_and_decode_as_the_library():
    lib, own = Tokenizer.from_file(WORDS), bpe.WordBpe(WORDS)
    for t in odd_texts(400):
        ids = lib.encode(t, add_special_tokens=False).ids
        assert own.encode(t) == ids and own.decode(ids) == lib.decode(ids, skip_special_tokens=False), t


def test_merges_skip_stale_entries():
    # ab merges first, so the entry for bc is stale; ties go left.
    assert bpe.merged([1, 2, 3], {1 << 20 | 2: 0 << 32, 2 << 20 | 3: 1 << 32}, [9, 8]) == [9, 3]
    assert bpe.merged([1, 1, 1], {1 << 20 | 1: 0}, [5]) == [5, 1]


def test_memo_of_two_generations():
    made = []
    memo = bpe.Remembered(lambda k: made.append(k) or k * 2, 2)
    assert [memo[k] for k in (1, 2, 3, 1, 1)] == [2, 4, 6, 2, 2] and made == [1, 2, 3] and len(memo) <= 2


def test_encoded_documents(docs, none):
    lib = Tokenizer.from_file(WORDS)
    for r in bpe.encode_decode(docs, WORDS, keep=("doc_id", "text")).collect():
        ids = lib.encode(r["text"] or "", add_special_tokens=False).ids
        assert r["token_ids"] == ids and r["decoded"] == lib.decode(ids, skip_special_tokens=False)
    assert bpe.encode_decode(none, WORDS).count() == 0


def test_counts_as_the_library(docs, none):
    lib, own = Tokenizer.from_file(BYTES), token_counts.PrefixCounter(BYTES)
    for t in odd_texts(400, 1):
        assert own.count(t) == len(lib.encode(t, add_special_tokens=False).ids), t
    rows = token_counts.token_counts(docs, BYTES, keep=("doc_id", "text")).collect()
    assert len(rows) == docs.count() and all(r["n_tokens"] == len(lib.encode(r["text"] or "", add_special_tokens=False).ids) for r in rows)
    assert token_counts.token_counts(none, BYTES).count() == 0


def test_count_of_every_prefix():
    lib, own = Tokenizer.from_file(BYTES), token_counts.PrefixCounter(BYTES)
    for t in odd_texts(60, 2):
        want = [len(lib.encode(t[:i], add_special_tokens=False).ids) for i in range(len(t) + 1)]
        assert own.prefix_counts(t) == want, t
        assert own.longest_prefix(t, 5) == max(i for i, n in enumerate(want) if n <= 5)


def test_counts_and_cuts_of_batches():
    """Texts cut by Arrow and odd ones alike, with cuts read off the prefix counts."""
    import pyarrow as pa

    lib, own = Tokenizer.from_file(BYTES), token_counts.PrefixCounter(BYTES)
    r = random.Random(5)
    words = ["the", "pier's", "don't", "ends.", "Über", "naïve,", "x" * 70, "漢字", "#7", "a.b", "'s", "1999", "(so)"]
    texts = [r.choice(["", "\n", " "]) + "".join(r.choice(words) + r.choice([" ", " ", "\n", "\n\n", "  ", "\n\n\n", " \n"][: r.choice([3, 4, 7])]) for _ in range(r.randint(0, 30))) + r.choice(["", "end"]) for _ in range(300)]
    texts += odd_texts(100, 6) + [None, "hello <|endoftext|> x", "a  <|endoftext|>b"]
    n, cuts = own.count_all(pa.array(texts, pa.string()), (0, 3, 11))
    for i, t in enumerate(texts):
        t = t or ""
        want = [len(lib.encode(t[:k], add_special_tokens=False).ids) for k in range(len(t) + 1)]
        assert n[i] == want[-1], t
        for b, cut in zip((0, 3, 11), cuts, strict=True):
            assert cut[i] == max(k for k, x in enumerate(want) if x <= b), (t, b)


def test_special_strings_cut_short():
    lib, own = Tokenizer.from_file(BYTES), token_counts.PrefixCounter(BYTES)
    for t in ("hello <|endoftext|> x", "a  <|endoftext|>b", "<|endoftext|><|endoftext|> ", "wo\n\n<|endoftext|>", " " * 3000 + "<|endoftext|>"):
        want = [len(lib.encode(t[:i], add_special_tokens=False).ids) for i in range(len(t) + 1)] if len(t) < 100 else None
        got = own.prefix_counts(t)
        assert got == want if want else len(got) == len(t) + 1


def test_stored_prefix_tables(docs, none):
    short = docs.where("length(text) < 500 or text is null")
    tables = token_counts.prefix_tables(short, BYTES, keep=("doc_id", "text"))
    own = token_counts.PrefixCounter(BYTES)
    for r in tables.withColumn("cut", token_counts.longest_within(tables.counts, 3)).collect():
        assert r["counts"] == own.prefix_counts(r["text"]) and r["cut"] == own.longest_prefix(r["text"] or "", 3)
    assert token_counts.prefix_tables(none, BYTES).count() == 0


def test_names_that_clash(spark):
    """Extra columns under the names of new ones don't disturb the maps, whose results hold the asked columns alone."""
    rows = spark.createDataFrame([(1, "two words", 7, "x", -1)], "doc_id long, text string, n_tokens int, token_ids string, _n long")
    assert [tuple(r) for r in token_counts.token_counts(rows, BYTES).collect()] == [(1, 2)]
    assert bpe.encode_decode(rows, WORDS).columns == ["doc_id", "token_ids", "decoded"]
    assert packing.pack_documents(rows, BYTES).first()["n_tokens"] == 2


def brute(histogram, buckets):
    lengths, best = sorted(histogram), None
    for k in range(1, min(buckets, len(lengths)) + 1):
        for c in itertools.combinations(lengths[:-1], k - 1):
            uppers = [*c, lengths[-1]]
            cost = sum(n * (min(u for u in uppers if u >= x) - x) for x, n in histogram.items())
            best = cost if best is None else min(best, cost)
    return best


def test_boundaries_are_optimal():
    r = random.Random(3)
    for _ in range(200):
        h = {r.randint(1, 40): r.randint(1, 9) for _ in range(r.randint(1, 8))}
        b = r.randint(1, 5)
        uppers = packing.boundaries(h, b)
        assert len(uppers) <= b and sum(n * (min(u for u in uppers if u >= x) - x) for x, n in h.items()) == brute(h, b)
    assert packing.boundaries({}, 3) == []


@pytest.mark.parametrize("shard_rows", [3, 1000])
def test_batches_hold_every_token_once(spark, shard_rows):
    r = random.Random(4)
    rows = [(i, r.choice([0, 1, 5, 9, 30, 31, 100, 257])) for i in range(300)] + [(7, 5), (None, 4), (8, None)]
    out = packing.pack(spark.createDataFrame(rows, "doc_id long, n_tokens long"), window=64, buckets=4, budget=128, shard_rows=shard_rows).toPandas()
    assert out.n_tokens.sum() == sum(n or 0 for _, n in rows) and len(out) == sum(max(1, -(-(n or 0) // 64)) for _, n in rows)
    full = out.dropna(subset=["bucket"])
    assert (full.n_tokens <= full.padded).all() and full.bucket.nunique() == 4
    for _, part in full.groupby("bucket"):
        fits = max(1, 128 // part.padded.iloc[0])
        sizes = part.groupby("batch").size().sort_index()
        assert (sizes.iloc[:-1] == fits).all() and sizes.iloc[-1] <= fits and sizes.index.tolist() == list(range(len(sizes)))
        assert not part.duplicated(["batch", "slot"]).any()


def test_packing_documents(docs, none):
    assert packing.pack_documents(docs, BYTES).where("doc_id = 1").first()["bucket"] is None
    assert packing.pack_documents(none, BYTES).count() == 0

"""Lines, sentences and distilled statements of each document; all row-local, so nothing is shuffled."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginalia.functions import fixed as X
from marginalia.functions.text import content_tokens, let, normalize_key, split_sentences, word_count

LEAST, MOST = X.STATEMENT_WORDS


def lines(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, line_no, line), numbered from 1."""
    return docs.select(id, F.posexplode(F.split(F.coalesce(F.col(text), F.lit("")), "\n")).alias("line_no", "line")).withColumn("line_no", F.col("line_no") + 1)


def sentences(text: Column) -> Column:
    """All sentences of a text, line by line, in order."""
    return F.flatten(F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), split_sentences))


def statement(sentence: Column) -> Column:
    return word_count(sentence).between(LEAST, MOST)


def first_of_each(keys: Column) -> Column:
    """Places (from 0) at which an array's value occurs for the first time: pairs of value and place in order, of which the first stay."""
    pairs = F.array_sort(F.transform(keys, lambda k, i: F.struct(k.alias("k"), i.alias("i"))))
    firsts = lambda ps: F.filter(ps, lambda p, j: (j == 0) | (F.get(ps, j - 1)["k"] != p["k"]))
    return F.array_sort(F.transform(let(pairs, firsts), lambda p: p["i"]))


def counts(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, n_sentences, n_raw, n_kept, n_redundant): statements before and after exact dedupe by normalised key."""
    out = docs.select(id, sentences(F.col(text)).alias("s")).withColumn("k", F.filter("s", statement))
    out = out.withColumn("keys", F.transform("k", normalize_key))
    return out.select(id, *[c.cast("long").alias(n) for n, c in (("n_sentences", F.size("s")), ("n_raw", F.size("k")), ("n_kept", F.size(F.array_distinct("keys"))), ("n_redundant", F.size("k") - F.size(F.array_distinct("keys"))))])


def distilled(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, ord, statement, key): the first statement of each key, in order."""
    out = docs.select(id, F.filter(sentences(F.col(text)), statement).alias("s")).withColumn("keys", F.transform("s", normalize_key))
    out = out.select(id, F.explode(F.transform(first_of_each(F.col("keys")), lambda i: F.struct(i.alias("ord"), F.get("s", i).alias("statement"), F.get("keys", i).alias("key")))).alias("x"))
    return out.select(id, "x.*")


def greedy(items: Column, room=None) -> Column:
    """Of an array of STRUCT(key, tokens, …) those that no earlier kept one restates (Jaccard of tokens or equal key): an ordered fold.

    `room(kept, item)`: whether an item that restates nothing may still be kept.  Tokens are distinct.  Two sets of Jaccard t share a
    token among the first n - ceil(t n) + 1 of each in any one order (here: long words first), and differ in size by a factor of t at
    most, so most pairs are told apart by their sizes and these few tokens.
    """
    least = X.SAME_MEANING

    def keyed(x: Column) -> Column:
        n = F.size(x["tokens"])
        ordered = F.transform(F.array_sort(F.transform(x["tokens"], lambda w: F.struct((-F.length(w)).alias("n"), w.alias("w")))), lambda s: s["w"])
        return F.struct(x.alias("x"), n.alias("n"), F.slice(ordered, F.lit(1), n - F.ceil(least * n).cast("int") + 1).alias("first"))

    def same(a: Column, b: Column) -> Column:
        shared = lambda: F.size(F.array_intersect(a["x"]["tokens"], b["x"]["tokens"]))
        near = (a["n"] >= least * b["n"]) & (b["n"] >= least * a["n"]) & F.arrays_overlap(a["first"], b["first"])
        return (a["x"]["key"] == b["x"]["key"]) | (near & let(shared(), lambda both: both / (a["n"] + b["n"] - both) >= least))

    full = (lambda kept, k: ~room(kept, k["x"])) if room else (lambda kept, k: F.lit(False))
    fold = lambda ks: F.aggregate(ks, F.slice(ks, 1, 0), lambda kept, k: F.when(full(kept, k) | F.exists(kept, lambda o: same(o, k)), kept).otherwise(F.array_append(kept, k)))
    return let(F.transform(items, keyed), lambda ks: F.transform(fold(ks), lambda k: k["x"]))


def without_restatements(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, ord, statement): greedy dedupe by meaning, first phrasing wins."""
    out = docs.select(id, F.filter(sentences(F.col(text)), statement).alias("s"))
    items = F.transform("s", lambda s, i: F.struct(i.alias("ord"), s.alias("statement"), normalize_key(s).alias("key"), F.array_distinct(content_tokens(s)).alias("tokens")))
    out = out.withColumn("items", items).select(id, F.explode(greedy(F.col("items"))).alias("x"))
    return out.select(id, "x.ord", "x.statement")

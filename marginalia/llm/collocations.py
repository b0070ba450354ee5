"""Operator 13: collocations by hashed bucket counts (PCY, DHP) and Apriori pruning.

Pass k reads the texts once.  It counts phrases of k words exactly, but only those that may be frequent: both phrases of
k - 1 words inside them are frequent (Apriori), and the bucket that the phrase hashes to was hit often enough in the pass before.  While it
does so it counts into buckets the phrases of k + 1 words whose two parts are such candidates (DHP), for the next pass.

Both prunings are bitmaps of at most `most_bits` bits (2^26: 8 MB) sent to all tasks: one of buckets, one of the hashes of the frequent
phrases of the pass before.  A hash that collides lets a phrase through, which its exact count then drops; nothing frequent is
lost, whatever the size of a bitmap.  Their size grows with the bytes of the texts up to that bound; beyond it they only prune less.
Bucket counts travel as blocks of one byte a bucket, cut off at the threshold (more can't matter), and are merged in two
levels while they stream, so no task holds the blocks of one place together.

Scores come from equi-joins of candidates' parts with the frequent phrases.  A language's first rows are taken in two levels, since one
language may hold nearly all candidates.

Defined cases: a null text is the empty text and has no words; a null language is `und`; repeated rows count once each; phrases of the
same score and count come in byte order; very long texts are read whole, batches of them are cut by bytes; other columns are dropped,
whatever their names; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from marginalia.llm.common import discard, slices, stored

#: Buckets of one block of a bitmap.
BLOCK = 1 << 16
#: Bytes of text that a task works on at a time, and rows of counts that it holds.
SLICE, HELD = 1 << 20, 200_000
#: Bytes of text for each bucket, where the bound allows it.
SHARE = 64
MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93))  # odd multipliers


def _mixed(h: np.ndarray, other: np.ndarray) -> np.ndarray:
    x = (h * MIX[0]) ^ (other + (h >> np.uint64(29)))
    x ^= x >> np.uint64(32)
    x *= MIX[1]
    return x ^ (x >> np.uint64(29))


def phrase_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """The hash of the phrase of k words that starts at each place, from the words' hashes."""
    out = words[: max(0, len(words) - k + 1)]
    for j in range(1, k):
        out = _mixed(out, words[j : j + len(out)])
    return out


def _seeds(langs: pa.Array) -> np.ndarray:
    return np.array([xxhash.xxh64_intdigest(x.encode(), 7) for x in langs.to_pylist()], np.uint64)


def _word_hashes(words: pa.Array) -> np.ndarray:
    return np.array([xxhash.xxh64_intdigest(w.encode()) for w in words.to_pylist()], np.uint64)


def _place(h: np.ndarray, bits: int) -> np.ndarray:
    return ((h >> np.uint64(32)) * np.uint64(bits)) >> np.uint64(32)


def _holds(bitmap: np.ndarray, h: np.ndarray) -> np.ndarray:
    at = _place(h, 8 * len(bitmap))
    return (bitmap[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 != 0


class Words:
    """The words of a batch end to end: `code` (-1 at the end of a piece), the words of the codes, and each place's language."""

    def __init__(self, texts: pa.Array, langs: pa.Array) -> None:
        marked = pc.ascii_lower(pc.fill_null(texts, ""))
        for mark in ".,;:!?\x0b\x0c\r":
            marked = pc.replace_substring(marked, mark, "\n")
        marked = pc.replace_substring(marked, "\t", " ")
        marked = pc.replace_substring(pc.binary_join_element_wise(marked, "", "\n"), "\n", " \n ")
        lists = pc.split_pattern(marked, " ")
        flat = pc.list_flatten(lists).dictionary_encode()
        self.words, code = flat.dictionary, flat.indices.to_numpy().astype(np.int64)
        blank, end = (pc.index(self.words, value=w).as_py() for w in ("", "\n"))
        row = np.repeat(np.arange(len(texts)), pc.list_value_length(lists).to_numpy())
        kept = code != blank
        langs = pc.fill_null(langs, "und").dictionary_encode()
        self.langs, of = langs.dictionary, langs.indices.to_numpy()
        self.code, self.lang = code[kept], of[row[kept]].astype(np.int64)
        self.code[self.code == end] = -1
        hashes = _word_hashes(self.words)
        self.hash = _mixed(hashes[self.code], _seeds(self.langs)[self.lang]) if len(self.code) else np.zeros(0, np.uint64)

    def starts(self, k: int) -> np.ndarray:
        """Whether a phrase of k words within one piece starts at each place that has k places after it."""
        word = self.code >= 0
        n = max(0, len(word) - k + 1)
        return reduce(np.logical_and, (word[j : j + n] for j in range(k)), np.ones(n, bool))

    def counted(self, at: np.ndarray, k: int) -> pa.RecordBatch:
        """The distinct phrases of k words at the places `at`, with their numbers."""
        # Exact keys: pairs of numbers are numbered through again, one word at a time.
        keys = [self.lang[at]]
        for j in range(k):
            pair = keys[-1] * (len(self.words) + 1) + self.code[at + j]
            keys.append(pa.array(pair).dictionary_encode().indices.to_numpy().astype(np.int64))
        number = keys[-1]
        n = np.bincount(number)
        first = np.zeros(len(n), np.int64)
        first[number[::-1]] = at[::-1]
        parts = [self.words.take(pa.array(self.code[first + j])) for j in range(k)]
        phrase = pc.binary_join_element_wise(*parts, " ") if k > 1 else parts[0]
        return pa.RecordBatch.from_arrays([self.langs.take(pa.array(self.lang[first])), phrase, pa.array(n, pa.int64())], names=["lang", "phrase", "n"])


class Sums:
    """Counts of one task, added up while they are few; what grows beyond HELD rows leaves the task."""

    def __init__(self) -> None:
        self.held: list[pa.RecordBatch] = []
        self.rows = 0

    def add(self, rows: pa.RecordBatch) -> list[pa.RecordBatch]:
        self.held.append(rows)
        self.rows += len(rows)
        if self.rows <= HELD:
            return []
        whole = self._one()
        if len(whole) > HELD // 2:
            return self._leave(whole)
        self.held, self.rows = whole.to_batches(), len(whole)
        return []

    def rest(self) -> list[pa.RecordBatch]:
        return self._leave(self._one()) if self.held else []

    def _one(self) -> pa.Table:
        return pa.Table.from_batches(self.held).group_by(["lang", "phrase"], use_threads=False).aggregate([("n", "sum")]).rename_columns({"n_sum": "n"}).select(["lang", "phrase", "n"])

    def _leave(self, whole: pa.Table) -> list[pa.RecordBatch]:
        self.held, self.rows = [], 0
        return whole.to_batches(max_chunksize=50_000)


#: A row of a pass is either a phrase with its number or a block of buckets.
ROWS = "lang string, phrase string, n long, block int, counts binary"


def _blocks(counts: np.ndarray) -> Iterator[tuple[int, bytes]]:
    """The blocks of an array that aren't all zero, compressed."""
    for k in range(0, len(counts), BLOCK):
        if (part := counts[k : k + BLOCK]).any():
            yield k // BLOCK, _closed(part)


def _closed(part: np.ndarray) -> bytes:
    return pa.compress(part.tobytes(), "zstd", asbytes=True)


def _opened(raw: bytes, width: type) -> np.ndarray:
    return np.frombuffer(pa.decompress(raw, BLOCK * np.dtype(width).itemsize, "zstd", asbytes=True), width)


def _added(counts: np.ndarray, at: np.ndarray, most: int) -> None:
    at, n = np.unique(at, return_counts=True)
    counts[at] = np.minimum(counts[at].astype(np.int64) + n, most)


def _pass(k: int, last: int, least: int, bits: int, often: np.ndarray | None, frequent: np.ndarray | None):
    """often: the bitmap of buckets of phrases of k words; frequent: that of frequent phrases of k - 1 words; neither in the first pass."""
    width = np.uint8 if least < 256 else np.uint32

    def may_be(words: Words) -> np.ndarray:
        ok = words.starts(k)
        if k > 1 and len(ok):
            parts = _holds(frequent, phrase_hashes(words.hash, k - 1))
            ok &= parts[: len(ok)] & parts[1 : len(ok) + 1]
            some = np.flatnonzero(ok)
            ok[some] = _holds(often, phrase_hashes(words.hash, k)[some])
        return ok

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, sums = np.zeros(bits if k < last else 0, width), Sums()
        names, none = ["lang", "phrase", "n", "block", "counts"], pa.nulls
        of = lambda rows: [pa.RecordBatch.from_arrays([*b.columns, none(len(b), pa.int32()), none(len(b), pa.binary())], names=names) for b in rows]
        for batch in slices(batches, 1 << 14, 1, SLICE):
            words = Words(batch.column(1), batch.column(0))
            ok = may_be(words)
            if (at := np.flatnonzero(ok)).size:
                yield from of(sums.add(words.counted(at, k)))
            if k < last:
                longer = np.flatnonzero(ok[:-1] & ok[1:] & words.starts(k + 1)) if len(ok) > 1 else at[:0]
                _added(counts, _place(phrase_hashes(words.hash, k + 1)[longer], bits), least)
        yield from of(sums.rest())
        for block, raw in _blocks(counts):
            yield pa.RecordBatch.from_arrays([none(1, pa.string()), none(1, pa.string()), none(1, pa.int64()), pa.array([block], pa.int32()), pa.array([raw], pa.binary())], names=names)

    return work


def _merged(least: int):
    """Blocks of the same place added up, as they stream by."""
    width = np.uint8 if least < 256 else np.uint32

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, raw in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                part = _opened(raw.as_buffer(), width)
                old = sums.get(block)
                sums[block] = part.copy() if old is None else np.minimum(old.astype(np.uint32) + part, least).astype(width)
        for block, part in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([_closed(part)], pa.binary())], names=["block", "counts"])

    return work


def _hit(least: int):
    width = np.uint8 if least < 256 else np.uint32

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bits = [np.packbits(_opened(raw.as_buffer(), width) >= least, bitorder="little").tobytes() for raw in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(bits, pa.binary())], names=["block", "bits"])

    return work


#: Parts that the blocks of one place, and the rows of one language, are first dealt to.
LEVELS = 8
SALTS = 32


def _bitmap(blocks: DataFrame, bits: int, least: int) -> np.ndarray:
    """Which places the blocks (block, counts) count at least `least` times: bits / 8 bytes come to the driver, of a fixed bound."""
    many = max(1, bits // BLOCK)
    rows = blocks.repartition(many, "block", F.pmod(F.xxhash64("counts"), F.lit(LEVELS))).mapInArrow(_merged(least), "block int, counts binary")
    rows = rows.repartition(many, "block").mapInArrow(_merged(least), "block int, counts binary").mapInArrow(_hit(least), "block int, bits binary")
    out = np.zeros(bits // 8, np.uint8)
    for r in rows.collect():
        out[r["block"] * (BLOCK // 8) : (r["block"] + 1) * (BLOCK // 8)] = np.frombuffer(r["bits"], np.uint8)
    return out


def _hashed(k: int, bits: int):
    """Blocks in which the hashes of given phrases of k words are marked."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks = np.zeros(bits, np.uint8)
        for batch in slices(batches, 1 << 16):
            langs = batch.column(0).dictionary_encode()
            words = pc.list_flatten(pc.split_pattern(batch.column(1), " ")).dictionary_encode()
            seed, word = _seeds(langs.dictionary), _word_hashes(words.dictionary)
            of = np.repeat(langs.indices.to_numpy(), k)
            h = _mixed(word[words.indices.to_numpy()], seed[of]).reshape(-1, k)
            marks[_place(reduce(_mixed, h.T), bits)] = 1
        for block, raw in _blocks(marks):
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([raw], pa.binary())], names=["block", "counts"])

    return work


def frequent_phrases(docs: DataFrame, text: str = "text", lang: str = "lang", least: int = 30, longest: int = 4, most_bits: int = 1 << 26) -> tuple[list[DataFrame], DataFrame]:
    """For k = 1 to `longest` a table (lang, phrase, f) of the phrases of k words that occur `least` times or more; and (lang, n), all words."""
    rows = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), F.col(text).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = min(most_bits, BLOCK * (1 + size // (SHARE * BLOCK)))
    found, total, often, frequent = [], None, None, None
    for k in range(1, longest + 1):
        done = stored(rows.mapInArrow(_pass(k, longest, least, bits, often, frequent), ROWS), f"pass-{k}")
        phrases = done.where("phrase is not null")
        found.append(stored(phrases.groupBy("lang", "phrase").agg(F.sum("n").alias("f")).where(F.col("f") >= least), f"frequent-{k}"))
        if k == 1:
            total = stored(phrases.groupBy("lang").agg(F.sum("n").alias("n")), "words")
        if k < longest:
            often = _bitmap(done.where("block is not null").select("block", "counts"), bits, least)
            frequent = _bitmap(found[-1].select("lang", "phrase").mapInArrow(_hashed(k, bits), "block int, counts binary"), bits, 1)
        discard(done)
    return found, total


def collocations(docs: DataFrame, text: str = "text", lang: str = "lang", least: int = 30, longest: int = 4, first: int = 2000, share: int = 80, most_bits: int = 1 << 26) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score) of each language's `first` best phrases of 2 to `longest` words.

    a: occurrences; l, r: those of the two parts at the cut with the lowest score floor(2 000 000 a / (l + r)), of ties the first one.
    Phrases inside a longer frequent one that has `share` hundredths of their occurrences or more are left out."""
    found, total = frequent_phrases(docs, text, lang, least, longest, most_bits)
    every = reduce(DataFrame.union, found)
    many = reduce(DataFrame.union, found[1:])
    words = F.split("phrase", " ")
    joined = lambda start, n: F.array_join(F.slice("words", start, n), " ")
    cuts = many.withColumn("words", words).withColumn("k", F.explode(F.sequence(F.lit(1), F.size("words") - 1)))
    cuts = cuts.select("lang", "phrase", F.col("f").alias("a"), "k", joined(F.lit(1), F.col("k")).alias("head"), joined(F.col("k") + 1, F.size("words") - F.col("k")).alias("rest"))
    part = lambda name, n: every.select("lang", F.col("phrase").alias(name), F.col("f").alias(n))
    cuts = cuts.join(part("head", "l"), ["lang", "head"]).join(part("rest", "r"), ["lang", "rest"])
    score = F.expr("cast(2000000 as decimal(8,0)) * cast(a as decimal(20,0)) div (cast(l as decimal(20,0)) + cast(r as decimal(20,0)))")
    scored = cuts.groupBy("lang", "phrase").agg(F.first("a").alias("a"), F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("low"))
    # What each longer phrase holds: its parts of 2 words or more.
    longer = reduce(DataFrame.union, found[2:]).withColumn("words", words) if longest > 2 else None
    if longer is not None:
        longer = longer.withColumn("size", F.explode(F.sequence(F.lit(2), F.size("words") - 1))).withColumn("at", F.explode(F.sequence(F.lit(1), F.size("words") - F.col("size") + 1)))
        inside = longer.select("lang", joined(F.col("at"), F.col("size")).alias("phrase"), "f").groupBy("lang", "phrase").agg(F.max("f").alias("longer"))
        whole = lambda c, by: F.col(c).cast("decimal(20,0)") * F.lit(by)
        scored = scored.join(inside, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (whole("longer", 100) < whole("a", share)))
    rows = scored.select("lang", "phrase", "a", "low.l", "low.r", "low.score", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)).alias("salt"))
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    best = rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).where(F.col("rank") <= first)
    best = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= first)
    return best.join(total, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


#: The same in SQL, for tables that a single machine holds.
ORACLE = """
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang,
         unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS piece
  FROM documents),
worded AS (SELECT lang, list_filter(string_split_regex(piece, '[ \\t]+'), lambda w: w <> '') AS ws FROM pieces),
grams AS (
  SELECT lang, k, unnest(list_transform(range(1, len(ws) - k + 2), lambda i: array_to_string(ws[i:i + k - 1], ' '))) AS phrase
  FROM worded, (SELECT unnest(range(1, 5)) AS k)),
counts AS (SELECT lang, k, phrase, count(*) AS f FROM grams GROUP BY ALL HAVING count(*) >= 30),
totals AS (SELECT lang, sum(len(ws))::BIGINT AS n FROM worded GROUP BY lang),
cuts AS (SELECT lang, k, phrase, f, string_split(phrase, ' ') AS ws, unnest(range(1, k)) AS cut FROM counts WHERE k > 1),
scored AS (
  SELECT c.lang, c.phrase, c.f AS a, l.f AS l, r.f AS r, (2000000::HUGEINT * c.f // (l.f + r.f))::BIGINT AS score,
         row_number() OVER (PARTITION BY c.lang, c.phrase ORDER BY 2000000::HUGEINT * c.f // (l.f + r.f), cut) AS place
  FROM cuts c JOIN counts l ON l.lang = c.lang AND l.phrase = array_to_string(c.ws[1:cut], ' ')
              JOIN counts r ON r.lang = c.lang AND r.phrase = array_to_string(c.ws[cut + 1:], ' ')),
inside AS (
  SELECT lang, array_to_string(ws[i:i + n - 1], ' ') AS phrase, max(f) AS longer
  FROM (SELECT lang, f, ws, n, unnest(range(1, len(ws) - n + 2)) AS i
        FROM (SELECT lang, f, string_split(phrase, ' ') AS ws, unnest(range(2, k)) AS n FROM counts WHERE k > 2))
  GROUP BY ALL),
ranked AS (
  SELECT s.*, row_number() OVER (PARTITION BY s.lang ORDER BY score DESC, a DESC, s.phrase) AS rank
  FROM scored s LEFT JOIN inside i ON i.lang = s.lang AND i.phrase = s.phrase
  WHERE place = 1 AND (longer IS NULL OR 100::HUGEINT * longer < 80::HUGEINT * a))
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN totals USING (lang) WHERE rank <= 2000
"""

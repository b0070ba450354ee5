"""Operator 4: toxicity by non-negative positive-unlabelled learning.

A linear classifier over the presence of hashed words and beginnings of words is trained with numpy from texts confirmed toxic (P) and unlabelled
texts (U).  With the class prior p, the risk of calling U negative is corrected by p times the risk of calling P negative and
held at or above 0, so the model can't gain by fitting the toxic texts inside U:
    p E_P[l(g)] + max(0, E_U[l(-g)] - p E_P[l(-g)]).

U is every row outside the held-out fifth.  In how many words (distinct in a text) each feature occurs is counted over all of them, features clearly more
frequent in P than in U are marked (the 256 clearest), and rows with the same marked features become one row with a count, so the
sums of the risk are exact over all rows.  Up to `on_driver` such rows are added up in numpy on the driver, more of them by tasks that
return sums for each feature; the sums are the same.

Bound: at most `positives` ids labelled toxic are P, the least by a hash of their ids; p is counted over all training labels.

Defined cases: a null text is the empty text; a text without known words scores the bias; no toxic label: every score is sigmoid(-50),
below 1e-21; repeated rows score alike and count each; very long texts are read whole, batches of them are cut by bytes; labels, lang,
source and id are never inputs of a score; a null id isn't held out and has no label; an empty table gives an empty table; other columns are
dropped, whatever their names.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginalia.llm.common import discard, held, is_training_id, slices, stored

DIMS = 1 << 18
#: Texts and bytes of text that are looked at together.
ROWS, BYTES = 4096, 2 << 20
#: Lengths, in bytes, of the beginnings of words that are features beside the words.
STARTS = (4, 5, 6, 7)


#: Factors of the hash of a word's bytes.
_ROOT, _MIX, _STEP = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F


def _ids(total: np.ndarray, n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return (((total + np.uint64(n * _STEP % 2**64)) * np.uint64(_MIX)) >> np.uint64(64 - 18)).astype(np.int64)


def _of_word(word: str) -> tuple[int, ...]:
    """The features of one word: the word, and its beginnings of 4 to 7 bytes."""
    raw, total, power, out = word.encode(), 0, 1, set()
    for k, b in enumerate(raw, 1):
        total, power = (total + (b + 1) * power) % 2**64, power * _ROOT % 2**64
        if k in STARTS:
            out.add(int(_ids(np.array([total], np.uint64), k)[0]))
    return tuple(out | {int(_ids(np.array([total], np.uint64), 0)[0])})


def _of_words(words: pa.Array, known: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """(word, feature) of distinct words in order; with `known` (a mark for each feature) only of the known ones."""
    offsets, raw = np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + len(words) + 1].astype(np.int64), np.frombuffer(words.buffers()[2] or b"", np.uint8)
    size = np.diff(offsets)
    raw = raw[offsets[0] : offsets[-1]].astype(np.uint64) + np.uint64(1)
    begin = offsets[:-1] - offsets[0]
    place = np.arange(len(raw)) - np.repeat(begin, size)
    with np.errstate(over="ignore"):
        powers = np.multiply.accumulate(np.r_[np.uint64(1), np.full(place.max(initial=0), _ROOT, np.uint64)])
        sums_ = np.r_[np.uint64(0), np.cumsum(raw * powers[place], dtype=np.uint64)]
        word, feature = [], []
        for n in (0, *STARTS):
            at = np.flatnonzero(size >= max(n, 1))
            ids = _ids(sums_[begin[at] + (n or size[at])] - sums_[begin[at]], n)
            if known is not None:
                few = known[ids]
                at, ids = at[few], ids[few]
            word.append(at)
            feature.append(ids)
    word, feature = np.concatenate(word), np.concatenate(feature)
    order = np.argsort(word, kind="stable")
    return word[order], feature[order]


class Stretches:
    """The stretches between white space of at most ROWS texts, each distinct one with the features of the words of letters in it."""

    def __init__(self, texts: pa.Array, known: np.ndarray | None = None) -> None:
        lists = pc.split_pattern(pc.replace_substring(pc.utf8_lower(pc.fill_null(texts, "")), "\n", " "), " ")
        if isinstance(lists, pa.ChunkedArray):
            lists = lists.combine_chunks()
        row = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
        found = pc.list_flatten(lists).dictionary_encode()
        inner = pc.split_pattern_regex(found.dictionary, r"\PL+")
        words = pc.list_flatten(inner).dictionary_encode()
        word, feature = _of_words(words.dictionary, known)
        size = np.bincount(word, minlength=len(words.dictionary))
        of_stretch = np.repeat(np.arange(len(inner)), np.diff(inner.offsets.to_numpy()))
        #: (stretch, feature), in order of the stretches.
        self.stretch, self.feature = _spread(of_stretch, words.indices.to_numpy(), np.cumsum(size) - size, size, feature)
        self.n = len(inner)
        self.size = np.bincount(self.stretch, minlength=self.n)
        at = found.indices.to_numpy()
        some = self.size[at] > 0
        pair = np.unique(row[some] * self.n + at[some])  # a stretch counts once in a text
        #: (row, stretch) of the distinct stretches with features of each text.
        self.row, self.at = pair // max(self.n, 1), pair % max(self.n, 1)

    def counts(self, rows: np.ndarray) -> np.ndarray:
        """For each feature, in how many (text, stretch) of the marked rows it occurs."""
        often = np.bincount(self.at[rows[self.row]], minlength=self.n)
        return np.bincount(self.feature, weights=often[self.stretch], minlength=DIMS).astype(np.int64)


def features_of(texts: pa.Array, known: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(row, feature) of the distinct features of each whole text, in order; at most ROWS texts."""
    s = Stretches(texts, known)
    row, feature = _spread(s.row, s.at, np.cumsum(s.size) - s.size, s.size, s.feature)
    key = np.unique((row * DIMS + feature).astype(np.int32))
    return key // DIMS, key % DIMS


def _spread(owner: np.ndarray, item: np.ndarray, begin: np.ndarray, size: np.ndarray, flat: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each owner with all values of its item: values begin[item] to begin[item] + size[item] of `flat`."""
    n = size[item]
    first = np.cumsum(n) - n
    return np.repeat(owner, n), flat[np.arange(n.sum()) - np.repeat(first - begin[item], n)]


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How often the distinct stretches of one task's rows have each feature: of all rows, and of those of P; last the rows."""
    held("toxicity", dict)  # nothing to remember here: only the objects of earlier operators go
    every, toxic = np.zeros(DIMS + 1, np.int64), np.zeros(DIMS + 1, np.int64)
    for batch in slices(batches, ROWS, 0, BYTES):
        found, positive = Stretches(batch.column(0)), batch.column(1).to_numpy(zero_copy_only=False).astype(bool)
        every += np.append(found.counts(np.ones(batch.num_rows, bool)), batch.num_rows)
        if positive.any():
            toxic += np.append(found.counts(positive), positive.sum())
    at = np.flatnonzero(every)
    for k in range(0, len(at), 10_000):
        part = at[k : k + 10_000]
        yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(every[part]), pa.array(toxic[part])], names=["i", "rows", "toxic"])


def marked(seen: np.ndarray, n: int, rest: np.ndarray, m: int, least: int = 5, lift: float = 3.0, most: int = 256) -> np.ndarray:
    """The features that are clearly more frequent in n positive rows than in m unlabelled ones; the `most` clearest."""
    often, usual = seen / max(n, 1), (rest + 1) / (m + 1)
    clear = (often - usual) / np.sqrt(usual / max(n, 1))
    found = np.flatnonzero((seen >= least) & (often >= lift * usual) & (clear >= 4))
    return np.sort(found[np.argsort(-clear[found], kind="stable")[:most]])


def _patterns(ids: np.ndarray):
    """(positive, pattern, n): the places in `ids` of the marked features of the rows of one task, equal ones counted."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held("toxicity", dict)
        known, column = np.zeros(DIMS, bool), np.zeros(DIMS, np.int32)
        known[ids], column[ids] = True, np.arange(len(ids))
        counts: Counter = Counter()

        def flush() -> Iterator[pa.RecordBatch]:
            rows = list(counts.items())
            for at in range(0, len(rows), 10_000):
                part = rows[at : at + 10_000]
                yield pa.RecordBatch.from_arrays([pa.array([k[0] for k, _ in part], pa.bool_()), pa.array([k[1] for k, _ in part], pa.binary()), pa.array([n for _, n in part], pa.int64())], names=["positive", "pattern", "n"])
            counts.clear()

        for batch in slices(batches, ROWS, 0, BYTES):
            row, feature = features_of(batch.column(0), known)
            ends = np.cumsum(np.bincount(row, minlength=batch.num_rows))
            feature = column[feature]
            for k, positive in enumerate(batch.column(1).to_pylist()):
                pattern = feature[ends[k - 1] if k else 0 : ends[k]].tobytes()
                counts[False, pattern] += 1
                if positive:
                    counts[True, pattern] += 1
            if len(counts) > 100_000:
                yield from flush()
        yield from flush()

    return work


class Model:
    """A weight for each feature; features that aren't in it weigh nothing."""

    def __init__(self, ids: np.ndarray, weights: np.ndarray, bias: float) -> None:
        self.weights, self.bias = dict(zip(ids.tolist(), weights.tolist(), strict=True)), bias

    def tables(self) -> tuple[np.ndarray, np.ndarray]:
        known, weight = np.zeros(DIMS, bool), np.zeros(DIMS)
        at = np.array(list(self.weights), np.int64)
        known[at], weight[at] = True, list(self.weights.values())
        return known, weight

    def scores(self, texts: pa.Array) -> np.ndarray:
        known, weight = self.tables()
        out = []
        for part in slices(iter([pa.RecordBatch.from_arrays([texts], names=["t"])]), ROWS, 0, BYTES):
            row, feature = features_of(part.column(0), known)
            out.append(_sigmoid(self.bias + np.bincount(row, weights=weight[feature], minlength=part.num_rows)))
        return np.concatenate([*out, np.zeros(0)])

    def score(self, text: str | None) -> float:
        return float(self.scores(pa.array([text], pa.string()))[0])


def _sigmoid(g):
    return 1 / (1 + np.exp(-np.clip(g, -50, 50)))


def sums(patterns: list[np.ndarray], n: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Over rows that occur n times: the sum of log(1 + e^g), then by weight the sums of x sigmoid(g) and of x sigmoid(-g); the bias last."""
    row, column = np.repeat(np.arange(len(patterns)), [len(x) for x in patterns]), np.concatenate([*patterns, np.zeros(0, np.int32)]).astype(np.int64)
    g = np.bincount(row, weights=w[column], minlength=len(patterns)) + w[-1]
    back = lambda d: np.append(np.bincount(column, weights=d[row], minlength=len(w) - 1), d.sum())
    return np.concatenate([[(n * np.logaddexp(0, g)).sum()], back(n * _sigmoid(g)), back(n * _sigmoid(-g))])


def local_sums(rows: list[tuple[bool, bytes, int]]) -> Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]]:
    """The sums over P and over U from rows on the driver."""
    sides = []
    for side in (True, False):
        part = [(np.frombuffer(p, np.int32), n) for positive, p, n in rows if positive == side]
        sides.append(([p for p, _ in part], np.array([n for _, n in part], np.float64)))
    return lambda w: tuple(sums(p, n, w) for p, n in sides)


def spread_sums(table: DataFrame) -> Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]]:
    """The same, added up by the tasks that hold the rows of `table`; a row for each feature comes back."""

    def of(w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        shared = table.sparkSession.sparkContext.broadcast(w)  # a weight for each marked feature

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            out = [np.zeros(2 * len(shared.value) + 1), np.zeros(2 * len(shared.value) + 1)]
            for batch in slices(batches, 10_000):
                parts = local_sums(list(zip(*(c.to_pylist() for c in batch.columns), strict=True)))(shared.value)
                out = [a + b for a, b in zip(out, parts, strict=True)]
            for side, x in enumerate(out):
                at = np.flatnonzero(x)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), side)), pa.array(at), pa.array(x[at])], names=["side", "i", "x"])

        found = table.mapInArrow(work, "side long, i long, x double").groupBy("side", "i").agg(F.sum("x").alias("x")).toPandas()
        out = np.zeros((2, 2 * len(w) + 1))
        out[found["side"], found["i"]] = found["x"]
        shared.unpersist()
        return out[0], out[1]

    return of


def minimised(of: Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]], n: int, m: int, prior: float, ids: np.ndarray, steps: int = 200, rate: float = 0.1, decay: float = 5e-4) -> Model:
    """Full-batch Adam on the non-negative risk with the logistic loss, over the features `ids`; n rows of P, m rows of U."""
    if not n or not m:
        return Model(np.zeros(0, int), np.zeros(0), -50.0)
    k = len(ids) + 1
    w, first, second = np.zeros(k), np.zeros(k), np.zeros(k)
    w[-1] = np.log(prior / (1 - prior))
    for t in range(1, steps + 1):
        p, u = of(w)
        p, u = p / n, u / m
        minus = u[0] - prior * p[0]  # the corrected risk of calling U negative
        rest = u[1 : k + 1] - prior * p[1 : k + 1]
        grad = rest - prior * p[k + 1 :] if minus >= 0 else -rest  # it fell below 0: step back from it
        grad[:-1] += decay * w[:-1]
        first, second = 0.9 * first + 0.1 * grad, 0.999 * second + 0.001 * grad**2
        w = w - rate * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.999**t)) + 1e-8)
    return Model(ids, w[:-1], float(w[-1]))


def fit(positive: list[np.ndarray], unlabelled: list[np.ndarray], prior: float, ids: np.ndarray, **options) -> Model:
    """`minimised` for texts at hand, each given as its feature ids."""
    column = np.full(DIMS, -1)
    column[ids] = np.arange(len(ids))
    sides = [([c[c >= 0] for c in (column[np.asarray(x, np.int64)] for x in rows)], np.ones(len(rows))) for rows in (positive, unlabelled)]
    return minimised(lambda w: tuple(sums(p, n, w) for p, n in sides), len(positive), len(unlabelled), prior, ids, **options)


def train(docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", positives: int = 3000, on_driver: int = 100_000) -> Model:
    """From rows whose crc32(id as text) mod 5 is not 0 alone."""
    learn = labels.where(is_training_id(F.col(id)) & F.col("toxic").isNotNull())
    prior = learn.agg(F.avg(F.col("toxic").cast("double"))).first()[0] or 0.0
    ids = learn.where("toxic = 1").select(F.col(id).alias("_id")).distinct().orderBy(F.xxhash64("_id", F.lit(4)), "_id").limit(positives).withColumn("_p", F.lit(True))
    rows = docs.select(F.col(id).alias("_id"), F.col(text).alias("_text")).where(F.coalesce(is_training_id(F.col("_id")), F.lit(True)))
    rows = rows.join(F.broadcast(ids), "_id", "left").select("_text", F.coalesce("_p", F.lit(False)).alias("positive"))  # at most `positives` ids
    counts = rows.mapInArrow(_frequencies, "i long, rows long, toxic long").groupBy("i").agg(F.sum("rows").alias("rows"), F.sum("toxic").alias("toxic")).toPandas()
    every, toxic = np.zeros(DIMS + 1, np.int64), np.zeros(DIMS + 1, np.int64)  # at most DIMS + 1 rows; the last counts the texts
    every[counts["i"]], toxic[counts["i"]] = counts["rows"], counts["toxic"]
    m, n = int(every[-1]), int(toxic[-1])
    if not n:
        return minimised(local_sums([]), 0, m, 0.5, np.zeros(0, int))
    chosen = marked(toxic[:-1], n, every[:-1], m)
    table = rows.mapInArrow(_patterns(chosen), "positive boolean, pattern binary, n long").groupBy("positive", "pattern").agg(F.sum("n").alias("n"))
    table = stored(table, "toxicity-patterns")
    few = table.limit(on_driver + 1).collect()
    of = local_sums(sorted(map(tuple, few))) if len(few) <= on_driver else spread_sums(table)
    model = minimised(of, n, m, min(max(prior, 1e-3), 0.9), chosen)
    discard(table)
    return model


def score_column(spark, model: Model, text: Column) -> Column:
    """The score of a whole text, 0 to 1."""
    shared = spark.sparkContext.broadcast(model)  # at most DIMS weights

    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        held("toxicity", dict)
        return pa.array(shared.value.scores(texts), pa.float64())

    return score(text)


def scored(docs: DataFrame, model: Model, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, held_out, score, predicted) of every row."""
    out = docs.select(F.col(id), F.coalesce(~is_training_id(F.col(id)), F.lit(False)).alias("held_out"), score_column(docs.sparkSession, model, F.col(text)).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))

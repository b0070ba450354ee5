"""Operator 9: quality by importance resampling.

Two generative models of hashed word 1- and 2-grams: one of target texts (labelled quality 1), one of all raw texts.  A text's
log importance weight is the sum over its n-grams of log p_target - log p_raw; rows are sampled without replacement by
Gumbel top-k: the k largest log weights plus Gumbel noise, the noise a fixed hash of the id.

The raw model counts every text.  The target model is fitted on at most `target_rows` labelled rows (least by a hash of their
ids).  The k-th largest key is found exactly by a radix search over histograms of at most 65536 bins; rows that tie with it
all stay.

Defined cases: a null text is the empty text, whose weight is 0; no target: all weights are 0; an empty table gives an empty table;
repeated rows have equal keys, and so stay or go together; very long texts are read whole, batches of them are cut by bytes; extra
columns stay unless they have the names chosen for the new ones.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginalia.llm.common import held, slices

#: Buckets of the hashed n-grams.
BUCKETS = 1 << 16


def grams(text: str | None) -> np.ndarray:
    """Buckets of all 1- and 2-grams of a whole text."""
    words = (text or "").encode().split()
    one = np.fromiter(map(zlib.crc32, words), dtype=np.uint64, count=len(words))
    two = (one[:-1] * np.uint64(0x9E3779B1) + one[1:] * np.uint64(0x85EBCA6B) + np.uint64(1)) >> np.uint64(7)
    return (np.concatenate([one, two]) % np.uint64(BUCKETS)).astype(np.int64)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of one task: a row for each bucket."""
    held("quality", dict)
    raw, target = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
    for batch in slices(batches, 64, 0):
        rows = [grams(text) for text in batch.column(0).to_pylist()]
        raw += np.bincount(np.concatenate(rows), minlength=BUCKETS)
        if good := [n for n, own in zip(rows, batch.column(1).to_pylist(), strict=True) if own]:
            target += np.bincount(np.concatenate(good), minlength=BUCKETS)
    at = np.flatnonzero(raw)
    for k in range(0, len(at), 10_000):
        part = at[k : k + 10_000]
        yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(raw[part]), pa.array(target[part])], names=["bucket", "raw", "target"])


def train(docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", target_rows: int = 20_000, smooth: float = 1.0) -> np.ndarray:
    """log p_target - log p_raw for each bucket."""
    good = labels.where("quality = 1").select(F.col(id).alias("_id")).distinct().orderBy(F.xxhash64("_id", F.lit(9)), "_id").limit(target_rows).withColumn("own", F.lit(True))
    rows = docs.select(F.col(id).alias("_id"), F.col(text).alias("_text")).join(F.broadcast(good), "_id", "left")  # at most target_rows ids
    counts = rows.select("_text", F.coalesce("own", F.lit(False)).alias("own")).mapInArrow(_count, "bucket long, raw long, target long")
    table = counts.groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).toPandas()  # at most BUCKETS rows
    raw, target = np.full(BUCKETS, smooth), np.full(BUCKETS, smooth)
    raw[table["bucket"]] += table["raw"]
    target[table["bucket"]] += table["target"]
    if target.sum() == smooth * BUCKETS:
        return np.zeros(BUCKETS)
    return np.log(target / target.sum()) - np.log(raw / raw.sum())


def weight_column(spark, model: np.ndarray, text: Column) -> Column:
    """The log importance weight of a whole text."""
    shared = spark.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def weight(texts: pa.Array) -> pa.Array:
        held("quality", dict)  # nothing to remember here: only the objects of earlier operators go
        m = shared.value
        return pa.array([float(m[grams(t.as_py())].sum()) for t in texts], pa.float64())

    return weight(text)


def gumbel(id: Column, seed: int) -> Column:
    """Standard Gumbel noise from a hash of the id: the same row always gets the same noise."""
    u = (F.shiftrightunsigned(F.xxhash64(id, F.lit(seed)), 11).cast("double") + 0.5) / F.lit(float(1 << 53))
    return -F.log(-F.log(u))


def kth_largest(keys: DataFrame, column: str, k: int) -> float | None:
    """The exact k-th largest double; null if there are fewer than k rows.

    Histograms of 16 bits each, from the whole multiples of 2^-20 on to the rest (products by powers of 2 and their whole parts are
    exact); once at most `few` rows are left in a bin, or all its rows are equal, they decide.
    """
    few, scale = 4096, float(1 << 20)
    rows = keys.where(F.col(column).isNotNull()).select(F.col(column).cast("double").alias("x"))
    rank = F.floor(F.col("x") * scale).cast("long") + F.lit(1 << 62)
    rest = F.col("x") * scale - F.floor(F.col("x") * scale)
    digits = [F.shiftrightunsigned(rank, s).bitwiseAND(F.lit(0xFFFF)) for s in (48, 32, 16, 0)]
    for _ in range(4):
        rest = rest * 65536.0
        digits.append(F.floor(rest).cast("long"))
        rest = rest - F.floor(rest)
    left = k
    for digit in digits:
        bins = rows.groupBy(digit.alias("b")).agg(F.count("*").alias("n"), F.min("x").alias("low"), F.max("x").alias("high")).collect()  # at most 65536 rows
        for r in sorted(bins, key=lambda r: -r["b"]):
            if left <= r["n"]:
                break
            left -= r["n"]
        else:
            return None
        if r["low"] == r["high"]:
            return r["low"]
        rows = rows.where(digit == r["b"])
        if r["n"] <= few:
            return sorted((x for (x,) in rows.collect()), reverse=True)[left - 1]
    return r["low"]  # closer than 2^-84


def keep_share(labels: DataFrame) -> float:
    """The share of quality 1 among all labels, plus three standard errors: texts go only where the labels say so."""
    n, share = labels.where("quality is not null").agg(F.count("*"), F.avg(F.col("quality").cast("double"))).first()
    return 1.0 if not n else min(1.0, share + 3 * math.sqrt(max(share * (1 - share), 1 / n) / n))


def keyed(docs: DataFrame, model: np.ndarray, id: str = "doc_id", text: str = "text", seed: int = 9, weight: str = "_log_weight", key: str = "_key") -> DataFrame:
    """`docs` with the columns `weight` and `key`, which take the place of columns of their names."""
    noise = gumbel(F.col(id), seed)
    return docs.withColumn(weight, weight_column(docs.sparkSession, model, F.col(text))).withColumn(key, F.col(weight) + noise)


def chosen(rows: DataFrame, share: float, key: str = "_key") -> Column:
    """Whether a row of `rows` (with `key`) is among the ceil(share * rows) largest keys."""
    n = rows.count()
    least = kth_largest(rows, key, math.ceil(share * n)) if n else None
    return F.lit(True) if least is None else F.col(key) >= least

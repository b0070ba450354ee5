"""Operator 1: packing into optimal length buckets.

Texts longer than the window are cut into windows and a rest, so lengths lie in 1..window and the global histogram has
at most `window` rows.  A dynamic programme over that histogram chooses the bucket boundaries with the least padding
(convex hull of lines, exact integers).  Inside each bucket, token-budget batches: a bucket padded to b tokens takes
budget // b sequences a batch, and every batch but the bucket's last is full.

A row's place in its bucket comes from counts of shards (a few hundred rows each, by hash) and its place in the shard, so no
task sees a whole bucket.

Defined cases: empty texts have no sequence, but keep a row with null bucket and batch; null texts are empty texts; repeated
rows are packed each; texts longer than the window become several parts; other columns are dropped, whatever their names; an empty table
gives an empty table.
"""

from __future__ import annotations

from bisect import bisect_left

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from marginalia.llm.common import stored
from marginalia.llm.token_counts import token_counts


def boundaries(histogram: dict[int, int], buckets: int) -> list[int]:
    """The at most `buckets` upper lengths, in order, that minimise the sum of (upper length - length) over the histogram."""
    lengths = sorted(k for k, n in histogram.items() if n > 0)
    if not lengths:
        return []
    count, total = [0], [0]
    for x in lengths:
        count.append(count[-1] + histogram[x])
        total.append(total[-1] + x * histogram[x])
    n = len(lengths)
    # cost of one bucket over (i, j]: b_j (N_j - N_i) - (S_j - S_i), so for each i a line in b_j with slope -N_i.
    best: list[int | None] = [0] + [None] * n
    back: list[list[int]] = []
    for _ in range(min(buckets, n)):
        hull: list[tuple[int, int, int]] = []
        at, now, source = 0, [None] * (n + 1), [0] * (n + 1)
        for j in range(1, n + 1):
            if best[j - 1] is not None:
                line = (-count[j - 1], best[j - 1] + total[j - 1], j - 1)
                while len(hull) > at + 1 and (line[1] - hull[-2][1]) * (hull[-2][0] - hull[-1][0]) <= (hull[-1][1] - hull[-2][1]) * (hull[-2][0] - line[0]):
                    hull.pop()
                hull.append(line)
            if not hull:
                continue
            x = lengths[j - 1]
            while at + 1 < len(hull) and hull[at + 1][0] * x + hull[at + 1][1] <= hull[at][0] * x + hull[at][1]:
                at += 1
            slope, level, i = hull[at]
            now[j], source[j] = slope * x + level + x * count[j] - total[j], i
        back.append(source)
        if best[n] is not None and now[n] is not None and now[n] >= best[n]:
            back.pop()
            break
        best = now
    out, j = [], n
    for source in reversed(back):
        out.append(lengths[j - 1])
        j = source[j]
    return out[::-1]


def pack(lengths: DataFrame, id: str = "doc_id", length: str = "n_tokens", window: int = 2048, buckets: int = 16, budget: int = 65_536, shard_rows: int = 1024) -> DataFrame:
    """(id, part, start, n_tokens, bucket, padded, batch, slot): each part of each row in one batch.

    part: 0, 1, ... of a row's windows; start: its first token; padded: the bucket's length; batch: number of the batch inside its
    bucket; slot: place in the batch.
    """
    rows = lengths.select(F.col(id).alias("_id"), F.coalesce(F.col(length).cast("long"), F.lit(0)).alias("_n"), F.monotonically_increasing_id().alias("_row"))
    rows = stored(rows, "lengths")
    parts = rows.select("_id", "_row", "_n", F.explode_outer(F.when(F.col("_n") > 0, F.sequence(F.lit(0), ((F.col("_n") - 1) / window).cast("int")))).alias("part"))
    parts = parts.withColumn("start", F.col("part") * F.lit(window).cast("long")).withColumn("size", F.when(F.col("part").isNotNull(), F.least(F.lit(window), F.col("_n") - F.col("start"))))
    histogram = {r["size"]: r["n"] for r in parts.where("size is not null").groupBy("size").agg(F.count("*").alias("n")).collect()}  # at most `window` rows
    uppers = boundaries(histogram, buckets)
    counts = [0] * len(uppers)
    for size, n in histogram.items():
        counts[bisect_left(uppers, size)] += n
    bucket = F.lit(None).cast("int")
    shards, padded = F.lit(1), F.lit(None).cast("long")
    for k in reversed(range(len(uppers))):
        inside = F.col("size") <= uppers[k]
        bucket = F.when(inside, k).otherwise(bucket)
        padded = F.when(inside, F.lit(uppers[k]).cast("long")).otherwise(padded)
        shards = F.when(inside, 1 + counts[k] // shard_rows).otherwise(shards)
    parts = parts.withColumns({"bucket": bucket, "padded": padded, "shard": F.pmod(F.xxhash64("_row", "part"), shards)})
    full = parts.where("bucket is not null")
    before = full.groupBy("bucket", "shard").agg(F.count("*").alias("n")).select("bucket", "shard", (F.sum("n").over(Window.partitionBy("bucket").orderBy("shard")) - F.col("n")).alias("before"))
    place = F.row_number().over(Window.partitionBy("bucket", "shard").orderBy("size", "_id", "_row", "part")) - 1
    placed = full.withColumn("place", place).join(before, ["bucket", "shard"]).withColumn("at", F.col("place") + F.col("before"))
    fits = F.greatest(F.lit(1).cast("long"), F.floor(F.lit(budget) / F.col("padded")))
    placed = placed.select("_id", "part", "start", "size", "bucket", "padded", F.floor(F.col("at") / fits).alias("batch"), (F.col("at") % fits).cast("int").alias("slot"))
    none = parts.where("bucket is null").select("_id", "part", "start", "size", "bucket", "padded", F.lit(None).cast("long").alias("batch"), F.lit(None).cast("int").alias("slot"))
    return placed.union(none).select(F.col("_id").alias(id), "part", "start", F.coalesce(F.col("size").cast("long"), F.lit(0).cast("long")).alias("n_tokens"), "bucket", "padded", "batch", "slot")


def pack_documents(docs: DataFrame, path: str, batch: int = 8 << 20, **options) -> DataFrame:
    """Counts the tokens of every whole text with the vocabulary file `path`, then packs; batch: as `token_counts` has it."""
    return pack(token_counts(docs, path, batch=batch), **options)

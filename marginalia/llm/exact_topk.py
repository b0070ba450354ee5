"""Operator 11: exact top-k search by no-random-access aggregation.

Every dimension of a block of candidates gives two lists sorted by component, one from the top and one from the bottom.  A query
reads all lists in step: from the top where its own component is positive, from the bottom where it is negative; where it is
zero the list adds nothing.  With f the value at which a list stands and w its last one, a candidate's score lies between

    lower = sum of what was read of it + q w of the lists it was not met in,
    upper = sum of what was read of it + q f of those lists.

Reading goes on until no candidate that was met nowhere can qualify (the sum of all q f falls below the k-th best score), then level by level
until the upper bounds leave few of the met ones.  Only those are resolved to exact scores.  The k-th best score is the
k-th best lower bound of the block or, if better, the k-th best exact score of the blocks before it in the same task.  The lists are read once for
all queries of a task; what was read is a matrix, so the bounds of many queries are one product.

Queries and candidates lie in blocks of packed integers; each (block of queries, group of candidates) is one task's work and leaves at
most k rows for each query.  Nothing is broadcast or collected; equal vectors are rows as any others, dealt by row number.

Defined cases: rows with a null id, a null vector or null or non-finite components take no part; vectors of different lengths aren't
compared, empty ones score 0; repeated rows and ids are rows of their own and candidates of each other; ties go to the smaller id; fewer
candidates than k: all of them; scores beyond the ends of a long are that end, and tie; very long vectors make blocks of fewer rows; other
columns are dropped, whatever their names; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from marginalia.llm.common import discard, slices, stored

#: Integers whose products and sums are exact below these sizes: in single and double precision, and in longs.
SINGLE, DOUBLE, LONG = 2**24, 2**53, 2**63


def _packed(scale: float):
    """Vectors as bytes: floor(scale * x) as 16-bit numbers where all fit, else as doubles; null if the vector takes no part."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 2048):
            out, wide = [], []
            for v in batch.column(3).to_pylist():
                x = None if v is None else np.array([np.nan if c is None else c for c in v], dtype=np.float64)
                if x is not None:
                    x = np.floor(scale * x)
                big = x is not None and bool((np.abs(x) >= 32767).any())
                wide.append(big)
                out.append(None if x is None or not np.isfinite(x).all() else x.tobytes() if big else x.astype(np.int16).tobytes())
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(out, pa.binary()), pa.array(wide)], names=["row", "id", "asks", "vec", "wide"])

    return work


def _blocks(size: int):
    """The rows of one group as blocks of about `size` bytes: ids, row numbers and components side by side, one block a row."""

    def work(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        vecs, wide = table["vec"].to_pylist(), table["wide"].to_numpy()
        ids, rows = table["id"].to_numpy().astype(np.int64), table["row"].to_numpy().astype(np.int64)
        dims = np.array([len(v) for v in vecs]) // np.where(wide, 8, 2)
        found = []
        for d in np.unique(dims):
            step = max(16, size // max(1, 8 * int(d)))
            for w in (False, True):
                at = np.flatnonzero((dims == d) & (wide == w))
                for some in (at[k : k + step] for k in range(0, len(at), step)):
                    found.append((int(d), w, ids[some].tobytes(), rows[some].tobytes(), b"".join(vecs[i] for i in some)))
        part = pa.array([table["part"][0].as_py()] * len(found), pa.int32())
        columns = list(zip(*found, strict=True))
        return pa.table([part, *(pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.bool_(), *[pa.binary()] * 3), strict=True))], names=["part", "dim", "wide", "ids", "rows", "vecs"])

    return work


def _matrix(r: dict) -> np.ndarray:
    return np.frombuffer(r["vecs"], np.float64 if r["wide"] else np.int16).astype(np.float64).reshape(len(r["ids"]) // 8, r["dim"])


class Lists:
    """The sorted lists of a block: one for each dimension from the top and one from the bottom, read in step, level by level."""

    def __init__(self, x: np.ndarray, kind: type = np.float64, steps: int = 16) -> None:
        n, d = x.shape
        x = x.astype(kind)
        order = np.argsort(x, axis=0, kind="stable")
        #: the lists side by side (rows: depth), those from the top first, and the components in their order
        self.order = np.hstack([order[::-1], order])
        self.values = np.take_along_axis(np.hstack([x, x]), self.order, axis=0)
        self.depths = np.unique(np.linspace(0, n, min(steps, n) + 1).astype(np.int64)[1:])
        self.x, self.n, self.depth = x, n, 0
        #: what was read of each candidate in each list
        self.seen, self.met = np.zeros((n, 2 * d), kind), np.zeros((n, 2 * d), bool)

    def read(self, depth: int) -> None:
        """Reads all lists on to `depth`."""
        if depth > self.depth:
            rows = self.order[self.depth : depth]
            np.put_along_axis(self.seen, rows, self.values[self.depth : depth], axis=0)
            np.put_along_axis(self.met, rows, True, axis=0)
            self.depth = depth

    def bounds(self, signed: np.ndarray, at: int) -> np.ndarray:
        """Candidates by queries: the sum of what was read plus, for what wasn't, the components at depth `at` of the lists."""
        return np.where(self.met, self.seen, self.values[at]) @ signed.T


def split(queries: np.ndarray) -> np.ndarray:
    """Each query against the lists from the top (where it is positive) and from the bottom (where it is negative)."""
    return np.hstack([np.maximum(queries, 0), np.minimum(queries, 0)])


def survivors(lists: Lists, queries: np.ndarray, k: int, best: np.ndarray, own: np.ndarray, beats) -> Iterator[tuple[int, np.ndarray]]:
    """(query, candidates that may be among its k best), each query once.

    best: for each query a k-th best score known before, or -inf; own: its own place in the block, or -1; beats(query): the candidates that
    win a tie with that score.
    """
    signed, n = split(queries).astype(lists.x.dtype), lists.n
    # How far to read at least: where no candidate that was met nowhere can qualify.
    fronts = lists.values[lists.depths - 1] @ signed.T < best
    first = np.where(fronts.any(axis=0), fronts.argmax(axis=0), len(lists.depths) - 1)
    first[~np.isfinite(best)] = 0
    waiting, few = np.ones(len(queries), bool), max(4 * k, n // 32)
    for level, depth in enumerate(lists.depths.tolist()):
        now = np.flatnonzero(waiting & (first <= level))
        if not len(now) or (level % 4 != 3 and depth < n and not np.isfinite(best[now]).any()):
            continue
        lists.read(depth)
        if depth == n:
            for q in now.tolist():
                yield q, np.delete(np.arange(n), own[q]) if own[q] >= 0 else np.arange(n)
            return
        front = signed[now] @ lists.values[depth - 1]
        upper = lists.bounds(signed[now], depth - 1)
        new = ~np.isfinite(best[now])
        least = best[now].astype(np.float64)
        if new.any() and n > k:
            lower = lists.bounds(signed[now[new]], n - 1)
            lower[own[now[new]][own[now[new]] >= 0], np.flatnonzero(own[now[new]] >= 0)] = -np.inf
            least[new] = np.partition(lower, n - k, axis=0)[n - k]
        many = (upper >= least).sum(axis=0)
        for j in np.flatnonzero((front < least) & (many <= 2 * few + 4 * k)).tolist():
            q = int(now[j])
            column = upper[:, j]
            alive = column >= least[j] if new[j] else (column > least[j]) | ((column == least[j]) & beats(q))
            if own[q] >= 0:
                alive[own[q]] = False
            if int(alive.sum()) <= few:
                waiting[q] = False
                yield q, np.flatnonzero(alive)


def _exact(x: np.ndarray, q: np.ndarray, safe: bool) -> list[int]:
    if safe:
        return (x @ q).astype(np.int64).tolist()
    whole = [int(c) for c in q]
    return [min(max(sum(int(c) * y for c, y in zip(r, whole, strict=True)), -LONG), LONG - 1) for r in x.tolist()]


def _search(k: int):
    def work(table: pa.Table) -> pa.Table:
        asked, blocks = [], []
        for r in table.to_pylist():
            (asked if r["asks"] else blocks).append(r)
        asked = [(r["dim"], _matrix(r), np.frombuffer(r["ids"], np.int64), np.frombuffer(r["rows"], np.int64)) for r in asked]
        best: dict[int, list[tuple[int, int, int]]] = {}  # by row of the query: (-score, id, row)
        names: dict[int, int] = {}
        for b in sorted(blocks, key=lambda r: r["rows"]):
            x, ids, rows = _matrix(b), np.frombuffer(b["ids"], np.int64), np.frombuffer(b["rows"], np.int64)
            place = {r: i for i, r in enumerate(rows.tolist())}
            for dim, queries, qids, qrows in asked:
                if dim != b["dim"]:
                    continue
                largest = float(np.abs(x).max(initial=0)) * float(np.abs(queries).max(initial=0)) * max(dim, 1)
                kept_of = [best.setdefault(r, []) for r in qrows.tolist()]
                names.update(zip(qrows.tolist(), qids.tolist(), strict=True))
                own = np.array([place.get(r, -1) for r in qrows.tolist()], np.int64)
                safe = largest < DOUBLE
                if safe and dim:
                    lists = Lists(x, np.float32 if largest < SINGLE else np.float64)
                    limits = np.array([-kept[-1][0] if len(kept) == k else -np.inf for kept in kept_of], np.float64)
                    found = survivors(lists, queries, k, limits, own, lambda q, kept_of=kept_of, ids=ids: ids < kept_of[q][-1][1])
                else:  # bounds can't be had in doubles: the lists are read to their ends
                    found = ((q, np.delete(np.arange(len(x)), own[q]) if own[q] >= 0 else np.arange(len(x))) for q in range(len(queries)))
                for q, at in found:
                    if not len(at):
                        continue
                    scores = _exact(x[at], queries[q], safe)
                    if safe and len(at) > 4 * k:  # only those that may stand among k of the block
                        s = np.array(scores, dtype=np.int64)
                        good = np.flatnonzero(s >= np.partition(s, len(s) - k)[len(s) - k])
                        good = good[np.lexsort((ids[at[good]], -s[good]))[:k]]
                        at, scores = at[good], s[good].tolist()
                    kept = kept_of[q]
                    kept += zip((-s for s in scores), ids[at].tolist(), rows[at].tolist(), strict=True)
                    kept.sort()
                    del kept[k:]
        flat = [(r, names[r], i, -s) for r, kept in best.items() for s, i, _ in kept]
        columns = list(zip(*flat, strict=True)) if flat else [[]] * 4
        return pa.table([pa.array(c, pa.int64()) for c in columns], names=["asker", "query_id", "vec_id", "score"])

    return work


def top_k(vectors: DataFrame, asks: Column, k: int = 5, id: str = "vec_id", vector: str = "embedding", scale: float = 256.0, group: int = 32768, ask_group: int = 1024, size: int = 4 << 20) -> DataFrame:
    """(query_id, rank, vec_id, score) long but for rank: the k best other rows of each row for which `asks` holds, by the inner product of
    floor(scale * x).  group, ask_group: candidates and queries of one task; size: bytes of one block's lists."""
    rows = vectors.select(F.col(id).cast("long").alias("id"), F.coalesce(asks, F.lit(False)).alias("asks"), F.col(vector).cast("array<double>").alias("v"))
    rows = rows.where("id is not null and v is not null").select(F.monotonically_increasing_id().alias("row"), "id", "asks", "v")
    rows = stored(rows.mapInArrow(_packed(scale), "row long, id long, asks boolean, vec binary, wide boolean").where("vec is not null"), "integer-vectors")
    bytes_ = F.sum(F.octet_length("vec"))
    n = rows.agg(F.count("*"), F.count_if("asks"), bytes_, F.sum(F.when(F.col("asks"), F.octet_length("vec")))).first()
    parts = max(1, -(-n[0] // group), (n[2] or 0) >> 24)
    ask_parts = max(1, -(-n[1] // ask_group), (n[3] or 0) >> 22)
    packed = "part int, dim int, wide boolean, ids binary, rows binary, vecs binary"

    def blocks(some: DataFrame, many: int) -> DataFrame:
        part = F.pmod(F.xxhash64("row"), F.lit(many)).cast("int").alias("part")
        return some.select("row", "id", "vec", "wide", part).groupBy("part").applyInArrow(_blocks(size), packed)

    own = stored(blocks(rows, parts), "candidate-blocks")
    asked = stored(blocks(rows.where("asks"), ask_parts), "query-blocks")
    every = lambda many: F.explode(F.sequence(F.lit(0), F.lit(many - 1)))
    grid = own.select("*", F.lit(False).alias("asks"), every(ask_parts).alias("by")).union(asked.withColumnRenamed("part", "by").select(every(parts).alias("part"), "dim", "wide", "ids", "rows", "vecs", F.lit(True).alias("asks"), "by"))
    found = stored(grid.groupBy("part", "by").applyInArrow(_search(k), "asker long, query_id long, vec_id long, score long"), "best-of-groups")
    discard(rows, own, asked)
    order = Window.partitionBy("asker").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


#: The same in SQL, for tables that a single machine holds.
ORACLE = """
WITH whole AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scores AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
  FROM whole q JOIN whole c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 50 = 0),
ranked AS (SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INTEGER AS rank, vec_id, score FROM scores)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""

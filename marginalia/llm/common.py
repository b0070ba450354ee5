"""Shared helpers of the training-data operators: durable intermediates, Arrow batches, connected components."""

from __future__ import annotations

import gc
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from marginalia.runtime import discard, stored  # noqa: F401

#: What the contracts call white space between words: blank and the controls 9 to 13.
SPACES = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free_name(rows: DataFrame, name: str) -> str:
    """`name`, with as many underscores before it as no column of `rows` has."""
    taken = {c.lower() for c in rows.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def slices(batches: Iterator[pa.RecordBatch], rows: int = 512, text: int | None = None, size: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Smaller batches: of at most `rows` rows and, where the number of a text column is given, of about `size` bytes of it."""
    for batch in batches:
        if text is None:
            for at in range(0, batch.num_rows, rows):
                yield batch.slice(at, rows)
            continue
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False))
        at = 0
        while at < batch.num_rows:
            most = (ends[at - 1] if at else 0) + size
            to = min(at + rows, max(at + 1, int(np.searchsorted(ends, most, "right"))))
            yield batch.slice(at, to - at)
            at = to


_held: dict = {}


def held(key, make: Callable):
    """The one large object of a worker process, made on first use.

    Spark reuses its workers, so what operators remember would add up in a session; here each takes the place of the last.
    """
    if key not in _held:
        _held.clear()
        gc.collect()
        pa.default_memory_pool().release_unused()
        _held[key] = make()
    return _held[key]


def is_training_id(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 5, is not 0."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 != 0


class Forest:
    """Union-find over hashable keys; the root of a tree is its least key."""

    def __init__(self) -> None:
        self.up: dict = {}

    def find(self, x):
        up = self.up
        root = x
        while (y := up.get(root, root)) != root:
            root = y
        while x != root:
            nxt = up.get(x, x)
            up[x] = root
            x = nxt
        return root

    def join(self, a, b) -> bool:
        a, b = self.find(a), self.find(b)
        if a == b:
            return False
        if b < a:
            a, b = b, a
        self.up[b] = a
        self.up.setdefault(a, a)
        return True


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The edges of one task as stars: as many rows as the task has nodes, at most."""
    forest, seen = Forest(), 0
    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            forest.join(a, b)
        seen += batch.num_rows
        if len(forest.up) > 500_000:
            yield from _stars(forest)
            forest = Forest()
    yield from _stars(forest)


def _stars(forest: Forest) -> Iterator[pa.RecordBatch]:
    pairs = [(x, r) for x in forest.up if (r := forest.find(x)) != x]
    for at in range(0, len(pairs), 10_000):
        part = np.array(pairs[at : at + 10_000], dtype=np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(part[:, 0]), pa.array(part[:, 1])], names=["a", "b"])


#: Parts that the rows of one key are dealt to.
SALTS = 32


def with_least(rows: DataFrame, key: str, value: str) -> DataFrame:
    """`rows` (key, value) with `m`, the least value of the key.  A key's rows are dealt to SALTS tasks, so no task holds a hot one."""
    rows = rows.withColumn("_s", F.pmod(F.xxhash64(value), F.lit(SALTS)))
    parts = rows.groupBy(key, "_s").agg(F.min(value).alias("_m"))  # at most SALTS rows of a key
    least = parts.select(key, "_s", F.min("_m").over(Window.partitionBy(key)).alias("m"))
    return rows.join(least, [key, "_s"]).drop("_s")


def components(edges: DataFrame, rounds: int = 200) -> DataFrame:
    """(node long, component long) of every node that has an edge; component: the least node that can be reached.

    `edges` has two long columns.  Edges are first contracted to stars inside each task, then large-star and
    small-star steps alternate until nothing changes.  Both steps are partial aggregates and a salted equi-join, so a
    node with very many edges is combined on the map side and its rows lie in several tasks; nothing is collected.
    Null ends and loops are ignored.  No edges: no rows.
    """
    a, b = (edges[c].cast("long") for c in edges.columns[:2])
    edges = edges.select(a.alias("a"), b.alias("b")).where("a is not null and b is not null and a <> b")
    now = stored(edges.mapInArrow(_contract, "a long, b long"), "edges")
    before = None
    for _ in range(rounds):
        # a is the larger end of every edge here
        both = now.select(F.col("a").alias("u"), F.col("b").alias("v")).union(now.select("b", "a"))
        large = with_least(both, "u", "v").where("v > u").select(F.col("v").alias("a"), F.least("m", "u").alias("b")).where("a <> b").distinct()
        large = stored(large, "edges")
        small = with_least(large, "a", "b").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e"))
        small = stored(small.select("e.a", "e.b").where("a <> b").distinct(), "edges")
        n, h = small.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        discard(now, large)
        now = small
        if (n, h) == before:
            break
        before = n, h
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(now.select("b", "b").distinct())

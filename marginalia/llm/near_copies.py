"""Operator 3 with five-word shingles and verification: texts whose sets of shingles have a Jaccard similarity of at least 0.8.

Candidates come from the anchor covering of SimHash prints (`simhash.links`).  At similarity 0.8 those prints differ by about 10 bits
and often by more, which no covering by blocks or anchors can list, so a second signature finds the others: BANDS bands of ROWS minima of
the same hashes; a pair of similarity s shares no band with probability (1 - s^ROWS)^BANDS, at most 1.3e-7 at 0.8.  Each
candidate, from either, is then verified on the shingles themselves.

Before texts move, pairs that can't be similar are dropped on sketches: a set of n shingles is a bitmap of 4 n to 8 n bits, a bit for the low
bits of each hash.  A bit that only one of two sets has stands for at least one shingle that only this set has, so the bitmaps bound the
intersection from above, and no similar pair is dropped.

Texts with equal sets are one class before anything is compared.  Each band's group is compared with one of its members only, the first
in one of ORDERS orders, so a large group costs as many pairs as it has members.  Members of groups that the links found so far don't
connect are then grouped by pairs of bands, where texts that merely share a passage seldom meet, and compared with one member of each such
group.  No group is cut and no group's pairs are listed; a pair is missed only if, in every group that it shares, the member compared
with is like neither of the two.

Defined cases: a null text is the empty text; texts without words are one class; fewer words than the shingle has: the whole
sequence is the only shingle; each component keeps its row of the least id (nulls last), then of the least place.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia.llm import simhash
from marginalia.llm.common import components, discard, held, slices, stored

WIDTH, LEAST = 5, 0.8
BANDS, ROWS = 40, 5
#: Bits of the largest sketch (128 kB).
SKETCH_BITS = 1 << 20
#: Steps from a band to the ones it is paired with, and the orders that choose whom a group is compared with.
STEPS, ORDERS = (1, 3, 7), 4
_RANDOM = np.random.default_rng(42)
_TIMES = _RANDOM.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PLUS = _RANDOM.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64)


def shingles(text: str | None, width: int = WIDTH) -> set[bytes]:
    words = (text or "").encode().lower().split()  # of bytes: only A-Z, and only the ASCII white space
    if not words:
        return set()
    line = b" ".join(words)
    starts, at = [], 0
    for w in words:
        starts.append(at)
        at += len(w) + 1
    stops = [s - 1 for s in starts[width:]] + [len(line)]
    return {line[a:b] for a, b in zip(starts, stops, strict=False)}


def similar(a: set[bytes], b: set[bytes], least: float = LEAST) -> bool:
    both = len(a & b)
    return both >= least * (len(a) + len(b) - both)


def hashes_of(found: set[bytes]) -> np.ndarray:
    """The hashes of the shingles in order, as many as there are shingles."""
    digest = xxhash.xxh64_intdigest
    return np.sort(np.array([digest(s, 42) for s in found], dtype=np.uint64))


def sketch(hashes: np.ndarray) -> bytes:
    """The bitmap of a set: a power of 2 of bits, at most SKETCH_BITS."""
    bits = min(SKETCH_BITS, max(64, 1 << (4 * len(hashes) - 1).bit_length() if len(hashes) else 64))
    out = np.zeros(bits, dtype=bool)
    out[(hashes & np.uint64(bits - 1)).astype(np.int64)] = True
    return np.packbits(out, bitorder="little").tobytes()


def may_be_similar(n: int, a: bytes, m: int, b: bytes, least: float = LEAST) -> bool:
    """Whether sets of n and m shingles with the sketches a and b can be similar."""
    if min(n, m) < least * max(n, m):
        return False
    x, y, bits = int.from_bytes(a, "little"), int.from_bytes(b, "little"), 8 * min(len(a), len(b))
    x, y = _folded(x, 8 * len(a), bits), _folded(y, 8 * len(b), bits)
    both = min(n - (x & ~y).bit_count(), m - (y & ~x).bit_count())
    return both >= least * (n + m - both)


def _folded(x: int, bits: int, to: int) -> int:
    while bits > to:
        bits //= 2
        x = (x & ((1 << bits) - 1)) | (x >> bits)
    return x


def signature(found: set[bytes]) -> tuple[bytes, int, list[int]]:
    """(digest of the set, its SimHash print, key of each band); no bands for an empty set."""
    return _signature(hashes_of(found))


def _signature(hashes: np.ndarray) -> tuple[bytes, int, list[int]]:
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, dtype=np.uint64)
    for at in range(0, len(hashes), 512):
        np.minimum(least, (hashes[at : at + 512, None] * _TIMES + _PLUS).min(axis=0), out=least)
    keys = [xxhash.xxh64_intdigest(part.tobytes(), k) for k, part in enumerate(least.reshape(BANDS, ROWS))] if len(hashes) else []
    return xxhash.xxh128_digest(hashes.tobytes()), simhash.majority(hashes), [k - (1 << 64) if k >> 63 else k for k in keys]


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held("near_copies", dict)
    for batch in slices(batches, 256, 1):
        hashes = [hashes_of(shingles(t.as_py())) for t in batch.column(1)]
        out = [_signature(h) for h in hashes]
        columns = [pa.array([x[0] for x in out], pa.binary()), pa.array([x[1] for x in out], pa.int64()), pa.array([x[2] for x in out], pa.list_(pa.int64())), pa.array([len(h) for h in hashes], pa.int64()), pa.array([sketch(h) for h in hashes], pa.binary())]
        yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["_row", "class", "print", "bands", "size", "sketch"])


def _possible(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, 1024):
        fits = [may_be_similar(n, x, m, y) for n, x, m, y in zip(*(c.to_pylist() for c in batch.columns[2:]), strict=True)]
        yield batch.select(["a", "b"]).filter(pa.array(fits, pa.bool_()))


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    last, other = None, set()
    for batch in slices(batches, 256):
        left, right = [], []
        for a, b, x, y in zip(*batch.columns, strict=True):
            if (b := b.as_py()) != last:
                last, other = b, shingles(y.as_py())
            if similar(shingles(x.as_py()), other):
                left.append(a.as_py())
                right.append(b)
        yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], names=["a", "b"])


#: Ids that may be broadcast: 8 bytes each.
FEW = 500_000


def few(ids: DataFrame) -> DataFrame:
    """Stored ids for a join: broadcast unless they are many, so that the rows they are joined to don't move."""
    return F.broadcast(ids) if ids.count() <= FEW else ids


def _of_pairs(pairs: DataFrame, rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The ids that `pairs` name, stored, and their rows."""
    ids = stored(pairs.select(F.explode(F.array("a", "b")).alias("_row")).distinct(), "ids")
    return ids, rows.join(few(ids), "_row", "left_semi")


def possible(pairs: DataFrame, signed: DataFrame) -> DataFrame:
    """The pairs (a, b) that their sketches allow to be similar; signed: (_row, size, sketch)."""
    ids, own = _of_pairs(pairs, signed.select("_row", "size", "sketch"))
    of = lambda end: own.select(F.col("_row").alias(end), F.col("size").alias(f"size_{end}"), F.col("sketch").alias(f"sketch_{end}"))
    both = pairs.join(of("a"), "a").join(of("b"), "b").select("a", "b", "size_a", "sketch_a", "size_b", "sketch_b")
    out = stored(both.mapInArrow(_possible, "a long, b long"), "possible")
    discard(ids)
    return out


def verified(pairs: DataFrame, rows: DataFrame, text: str = "text") -> DataFrame:
    """The pairs (a, b) of rows whose shingles are similar enough; only texts of candidates move."""
    ids, own = _of_pairs(pairs, rows.select("_row", F.col(text).alias("t")))
    texts = stored(own, "texts")
    of = lambda end: texts.select(F.col("_row").alias(end), F.col("t").alias(f"text_{end}"))
    both = pairs.join(of("a"), "a").join(of("b"), "b").select("a", "b", "text_a", "text_b")
    out = stored(both.mapInArrow(_verify, "a long, b long"), "links")
    discard(ids, texts)
    return out


def print_pairs(nodes: DataFrame) -> DataFrame:
    """Candidates (a > b) of `nodes` (node, print): equal prints with their least node, and least nodes whose prints the covering links."""
    least = stored(nodes.groupBy("print").agg(F.min("node").alias("b")), "prints")
    equal = nodes.join(least, "print").where("node <> b").select(F.col("node").alias("a"), "b")
    edges = simhash.links(least.select("print"))
    of = lambda end: least.select(F.col("print").alias(end), F.col("b").alias(f"node_{end}"))
    near = edges.join(of("a"), "a").join(of("b"), "b").select(F.greatest("node_a", "node_b").alias("a"), F.least("node_a", "node_b").alias("b"))
    return equal.union(near.where("a <> b"))


def stars(homes: DataFrame) -> DataFrame:
    """(band, a, b): every member a of each group of `homes` (node, k, band) with the group's first member b, groups of one left out."""
    order = F.struct(F.xxhash64("node", F.col("k") % ORDERS).alias("o"), "node")
    shared = homes.groupBy("band").agg(F.min(order).alias("first"), F.count("*").alias("n")).where("n > 1").select("band", F.col("first.node").alias("b"))
    return homes.join(shared, "band").select("band", F.col("node").alias("a"), "b")


def ordered(pairs: DataFrame) -> DataFrame:
    """Distinct pairs of two nodes, the larger first."""
    return pairs.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def class_nodes(signed: DataFrame, classes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows of `signed` that stand for no class, stored, and (node, print, bands) of the others, without the class of no words."""
    shared = classes.where("n > 1").select("class", "node")
    copies = stored(signed.select("_row", "class").join(shared, "class").where("_row <> node").select("_row"), "copies")
    nodes = signed.join(few(copies), "_row", "left_anti")
    return copies, nodes.select(F.col("_row").alias("node"), "print", "bands").where("size(bands) > 0")


def dropped_rows(rows: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(_row) of all but the row that stays of each component of near copies, stored; `rows` is stored and has a unique long `_row`."""
    signed = stored(rows.select("_row", text).mapInArrow(_sign, "_row long, class binary, print long, bands array<long>, size long, sketch binary"), "signatures")
    best = F.min(F.struct(F.col(id).isNull().alias("none"), F.col(id).alias("id"), F.col("_row").alias("row")))
    classes = stored(signed.select("_row", "class").join(rows.select("_row", F.col(id).alias(id)), "_row").groupBy("class").agg(F.min("_row").alias("node"), best.alias("best"), F.count("*").alias("n")), "classes")
    copies, nodes = class_nodes(signed, classes)
    groups = stored(stars(nodes.select("node", F.posexplode("bands").alias("k", "band"))), "groups")  # few, most bands are of one node
    first = stored(ordered(groups.select("a", "b").union(print_pairs(nodes.select("node", "print")))), "pairs")
    near = possible(first, signed)
    edges = verified(near, rows, text)
    parts = stored(components(edges), "parts")
    part = lambda end: parts.select(F.col("node").alias(end), F.col("component").alias(f"part_{end}"))
    apart = lambda ps: ps.join(part("a"), "a", "left").join(part("b"), "b", "left").where(F.coalesce("part_a", "a") != F.coalesce("part_b", "b"))
    # Nodes of groups that aren't connected yet meet again in pairs of bands.
    open_ = stored(apart(groups).select(F.explode(F.array("a", "b")).alias("node")).distinct(), "open")
    # A pair of bands can be shared only where both are: other bands are null.
    shared = groups.groupBy(F.col("a").alias("node")).agg(F.collect_set("band").alias("shared"))  # at most BANDS values
    bound = nodes.join(few(open_), "node", "left_semi").join(shared, "node").select("node", F.transform("bands", lambda x: F.when(F.array_contains("shared", x), x)).alias("bands"))
    again = bound.select("node", F.posexplode(F.concat(*[_paired(d) for d in STEPS])).alias("k", "band")).where("band is not null")
    second = stored(ordered(apart(stars(again)).select("a", "b")).join(first, ["a", "b"], "left_anti"), "pairs")
    near_too = possible(second, signed)
    more = verified(near_too, rows, text)
    all_parts = components(edges.union(more))
    named = classes.join(all_parts, "node", "left").select("best", F.coalesce("component", "node").alias("root"))
    kept = stored(named.groupBy("root").agg(F.min("best").alias("best")).select(F.col("best")["row"].alias("_row")), "kept")
    dropped = stored(signed.select("_row").join(kept, "_row", "left_anti"), "dropped")
    discard(signed, classes, copies, groups, first, near, edges, parts, open_, second, near_too, more, kept)
    return dropped


def _paired(step: int):
    """The keys of each band together with the one `step` further on, null where one of them is."""

    def key(x, i):
        other = F.get("bands", (i + step) % BANDS)
        return F.when(x.isNotNull() & other.isNotNull(), F.xxhash64(x, other, F.lit(step)))

    return F.transform("bands", key)

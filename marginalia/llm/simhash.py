"""Operator 3: SimHash near-dedup by anchor-point covering.

A fingerprint has 64 bits.  Two fingerprints that differ in at most 3 bits differ in at most 1 bit in one of their two
halves.  On the 32 bits of a half, the anchors are the words of the perfect Hamming code of length 31 with the 32nd bit
beside it: every half lies within covering radius 1 of its home anchor.  So the other half of a linked pair lies within
1 + 1 bits of that anchor, and every fingerprint is replicated to all anchors within covering radius plus threshold
(2, then 17 of 2^27).  Fingerprints are compared per anchor, homes against replicas, whole 64 bits at a time.

Equal fingerprints are one class before anything is replicated.  An anchor with very many homes is split by bytes of the
other half (at most 3 bits differ there, so one of its 4 bytes is equal).  Inside an anchor a search emits a spanning
forest, never all pairs; the forests meet in `common.components`.

Defined cases: a null text is the empty text; no words: fingerprint 0, linked like any other; fewer words than the shingle
has: the whole sequence is the only shingle; repeated rows stay; a null id takes part, but ids of components ignore it; very long
texts are read whole, batches of them are cut by bytes; other columns are dropped, whatever their names; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia.llm.common import components, discard, held, slices, stored

#: Parity masks of the Hamming code: bit p - 1 belongs to check j if p has bit j.
_CHECKS = [sum(1 << (p - 1) for p in range(1, 32) if p >> j & 1) for j in range(5)]
#: For each syndrome the 15 pairs of bits whose numbers differ by it.
_PAIRS = np.array([[0] * 15] + [[(1 << (p - 1)) | (1 << ((p ^ s) - 1)) for p in range(1, 32) if p < p ^ s] for s in range(1, 32)], dtype=np.uint32)


def fingerprint(text: str | None, width: int = 3, seed: int = 42) -> int:
    """A bit is 1 if it is set in over half the hashes of the shingles, repeats included.  Signed, as a Spark long."""
    words = (text or "").encode().lower().split()  # of bytes: only A-Z, and only the ASCII white space
    if not words:
        return 0
    line = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = [0, *ends[:-1].tolist()]
    stops = (ends - 1).tolist()[width - 1 :] or [len(line)]
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(line[a:b], seed) for a, b in zip(starts, stops, strict=False)], dtype=np.uint64)
    return majority(hashes)


def majority(hashes: np.ndarray) -> int:
    """The 64 bits that are set in over half of the hashes, as a signed long."""
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 4096):
        ones += np.unpackbits(hashes[at : at + 4096].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), width: int = 3) -> DataFrame:
    """`keep` columns and `fingerprint` long of every whole text.  A map without any shuffle."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held("simhash", dict)
        for batch in slices(batches, 512, len(keep)):
            out = [fingerprint(t, width) for t in batch.column(len(keep)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(out, pa.int64())], names=[*keep, "fingerprint"])

    types = dict(docs.dtypes)
    return docs.select(*keep, text).mapInArrow(work, ", ".join([*(f"`{k}` {types[k]}" for k in keep), "fingerprint long"]))


def anchors_of(half: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, anchor, is home) of every anchor within 2 bits of each 32-bit half."""
    low, top = half & np.uint32(0x7FFFFFFF), half & np.uint32(0x80000000)
    syndrome = np.zeros(len(half), dtype=np.uint32)
    for j, mask in enumerate(_CHECKS):
        syndrome |= (np.bitwise_count(low & np.uint32(mask)).astype(np.uint32) & np.uint32(1)) << np.uint32(j)
    flip = np.where(syndrome > 0, np.uint32(1) << (np.maximum(syndrome, 1) - np.uint32(1)), np.uint32(0)).astype(np.uint32)
    near = low ^ flip
    row = np.arange(len(half))
    off = np.flatnonzero(syndrome)
    far = (low[off, None] ^ _PAIRS[syndrome[off]]) | top[off, None]
    rows = np.concatenate([row, row, np.repeat(off, 15)])
    anchors = np.concatenate([near | top, near | (top ^ np.uint32(0x80000000)), far.ravel()])
    return rows, anchors, np.arange(len(rows)) < len(half)


def _replicate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, 4096):
        prints = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
        for half in range(2):
            row, anchor, home = anchors_of((prints >> np.uint64(32 * half)).astype(np.uint32))
            key = anchor.astype(np.int64) | (half << 32)
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(prints[row].view(np.int64)), pa.array(home)], names=["anchor", "fp", "home"])


def _forest(prints: np.ndarray, home: np.ndarray, most: int) -> list[tuple[int, int]]:
    """Edges of a spanning forest of one anchor's links between a home and any row; each pair is looked at once at most."""
    edges, waiting = [], np.arange(len(prints))
    while len(waiting):
        front, waiting = [waiting[0]], waiting[1:]
        while front and len(waiting):
            x = front.pop()
            near = np.bitwise_count(prints[waiting] ^ prints[x]) <= most
            if not home[x]:
                near &= home[waiting]
            if near.any():
                found = waiting[near]
                edges += [(int(x), int(y)) for y in found]
                front += found.tolist()
                waiting = waiting[~near]
    return edges


def _compare(most: int):
    def pairs(key: np.ndarray, prints: np.ndarray, home: np.ndarray) -> Iterator[np.ndarray]:
        """Linked pairs of whole groups of rows with equal keys."""
        starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        sizes = np.diff(np.r_[starts, len(key)])
        homes = np.add.reduceat(home.astype(np.int64), starts)
        use = (sizes > 1) & (homes > 0)
        large = use & (sizes * homes > 256)
        for s, n in zip(starts[large], sizes[large], strict=True):
            rows, first = np.unique(prints[s : s + n], return_index=True)
            at = np.searchsorted(rows, prints[s : s + n])
            is_home = np.zeros(len(rows), dtype=bool)
            is_home[at[home[s : s + n]]] = True
            if e := _forest(rows, is_home, most):
                yield rows[np.array(e)]
        use &= ~large
        size_of = np.repeat(np.where(use, sizes, 0), sizes)
        left = np.flatnonzero(home & (size_of > 0))
        begin = np.repeat(starts, sizes)[left]
        n = size_of[left]
        a = np.repeat(left, n)
        b = np.arange(len(a)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(begin, n)
        ok = (np.bitwise_count(prints[a] ^ prints[b]) <= most) & (prints[a] != prints[b])
        if ok.any():
            yield np.stack([prints[a[ok]], prints[b[ok]]], axis=1)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []

        def flush(whole: bool) -> Iterator[pa.RecordBatch]:
            nonlocal held
            if not held:
                return
            key, prints, home = (np.concatenate(x) for x in zip(*held, strict=True))
            cut = len(key) if whole else int(np.searchsorted(key, key[-1]))  # the last group may go on
            held = [(key[cut:], prints[cut:], home[cut:])] if cut < len(key) else []
            if cut:
                for e in pairs(key[:cut], prints[:cut], home[:cut]):
                    e = e.view(np.int64)
                    for at in range(0, len(e), 50_000):
                        yield pa.RecordBatch.from_arrays([pa.array(e[at : at + 50_000, 0]), pa.array(e[at : at + 50_000, 1])], names=["a", "b"])

        for batch in batches:
            if batch.num_rows:
                held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy().view(np.uint64), batch.column(2).to_numpy(zero_copy_only=False).astype(bool)))
                if held[0][0][0] != held[-1][0][-1]:
                    yield from flush(False)
        yield from flush(True)

    return work


def links(prints: DataFrame, most: int = 3, hot: int = 4096) -> DataFrame:
    """Edges (a long, b long) that connect all distinct fingerprints within `most` (at most 3) bits; prints: one column, distinct."""
    if not 0 <= most <= 3:
        raise ValueError("the two halves cover at most 3 differing bits")
    spread = prints.mapInArrow(_replicate, "anchor long, fp long, home boolean")
    # Anchors with very many homes: rows go to the 4 bytes of the other half instead, one of which is equal.
    home = prints.mapInArrow(_homes, "anchor long").groupBy("anchor").count().where(F.col("count") > hot).select("anchor", F.lit(True).alias("hot"))
    spread = spread.join(home, "anchor", "left")
    other = F.when(F.col("anchor") >= 1 << 32, F.col("fp")).otherwise(F.shiftrightunsigned("fp", 32)).bitwiseAND(F.lit(0xFFFFFFFF))
    bytes_ = [F.shiftrightunsigned(other, 8 * k).bitwiseAND(F.lit(255)).bitwiseOR(F.lit((k + 1) << 8)) for k in range(4)]
    spread = spread.withColumn("sub", F.explode(F.when(F.col("hot"), F.array(*bytes_)).otherwise(F.array(F.lit(0).cast("long")))))
    # One key of 33 bits and 11 bits: rows of a key are dealt to one task and lie together there.
    spread = spread.select(F.shiftleft("sub", 33).bitwiseOR(F.col("anchor")).alias("key"), "fp", "home")
    n = int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return spread.repartition(n, "key").sortWithinPartitions("key").mapInArrow(_compare(most), "a long, b long")


def _homes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, 8192):
        prints = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
        for half in range(2):
            _, anchor, home = anchors_of((prints >> np.uint64(32 * half)).astype(np.uint32))
            yield pa.RecordBatch.from_arrays([pa.array(anchor[home].astype(np.int64) | (half << 32))], names=["anchor"])


def near_duplicates(docs: DataFrame, id: str = "doc_id", text: str = "text", width: int = 3, most: int = 3) -> DataFrame:
    """(id, fingerprint long, component_id) of every row; component_id: the least id that links reach."""
    docs = docs.select(F.col(id).alias("_id"), F.col(text).alias("_text"))
    rows = stored(fingerprints(docs, "_text", ("_id",), width), "fingerprints")
    classes = stored(rows.groupBy("fingerprint").agg(F.min("_id").alias("least")), "classes")
    parts = components(links(classes.select("fingerprint"), most))
    named = classes.join(parts, classes.fingerprint == parts.node, "left").select("fingerprint", "least", F.coalesce("component", "fingerprint").alias("root"))
    named = stored(named, "roots")
    discard(classes)
    roots = named.groupBy("root").agg(F.min("least").alias("component_id"))
    named = named.join(roots, "root").select("fingerprint", "component_id")
    return rows.join(named, "fingerprint").select(F.col("_id").alias(id), "fingerprint", "component_id")

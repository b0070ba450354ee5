"""Operator 8: embedding near-dedup by int8 tile products.

Equal vectors are one class with a count.  Distinct unit vectors lie in tiles; a tile is quantised to int8 with one scale a
vector.  With x = s q + e and the residual norm |e| measured for each vector, |x.y - s_x s_y q_x.q_y| <= |e_x| |y| + |x - e_x| |e_y|,
so only pairs whose tile product plus that bound reaches the threshold are recomputed, in double precision.  Tile products are
exact: products of int8 numbers are summed as floats below 2^24.

Tiles follow pivots, whose number grows with the vectors: rows go to cells by nearest pivot and angle to it, cells of more rows than
a tile are dealt by hash, small cells share a tile.  A tile keeps the range of its angles to every pivot; two tiles whose ranges lie
further apart than the threshold's angle for any pivot hold no link.  Which tiles may meet is found on these ranges alone, a table of one
narrow row for each tile, by an equi-join of angle bins; vectors move only for pairs of tiles that are left.  Tiles are grouped in bands,
and each pair of bands is one task's work: vectors move as tiles, links leave as counts of each class and a spanning forest.
Where vectors of many dimensions lie alike far from every pivot, few pairs fall away and the work stays quadratic.

Defined cases: null, zero and non-finite vectors link with nothing; vectors of different lengths don't link; ties at the
threshold link; repeated rows and ids count as vectors of their own; very long vectors make tiles of fewer rows; other columns are
dropped, whatever their names; an empty table gives an empty table.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia.llm.common import Forest, components, discard, slices, stored

RINGS = 32


def quantised(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """int8 rows, their scales and the norms of what quantising lost (rounded up)."""
    scale = np.abs(unit).max(axis=1) / 127
    q = np.rint(unit / scale[:, None]).astype(np.int8)
    lost = np.linalg.norm(unit - scale[:, None] * q, axis=1) * (1 + 1e-9) + 1e-12
    return q, scale, lost


def candidates(a, b, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of two quantised tiles whose cosine may reach the threshold."""
    (qa, sa, ea), (qb, sb, eb) = a, b
    step = max(1, (1 << 24) // (127 * 127))  # sums of so many products stay exact in single precision
    product = sum((qa[:, k : k + step].astype(np.float32) @ qb[:, k : k + step].astype(np.float32).T).astype(np.float64) for k in range(0, qa.shape[1], step))
    product *= sa[:, None]
    product *= sb[None, :]
    product += ea[:, None]
    product += (1 + ea)[:, None] * eb[None, :]
    return np.nonzero(product >= threshold - 1e-9)


def _valid(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A class's vector as bytes of doubles, null if it can't link."""
    for batch in batches:
        out = []
        for v in batch.column(1).to_pylist():
            x = np.array([np.nan if y is None else y for y in v or []], dtype=np.float64)
            out.append(x.tobytes() if len(x) and np.isfinite(x).all() and x.any() else None)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary()), batch.column(2)], names=["class", "vec", "n"])


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _angles(unit: np.ndarray, pivots: np.ndarray | None) -> np.ndarray:
    return np.zeros((len(unit), 0)) if pivots is None else np.arccos(np.clip(unit @ pivots.T, -1, 1))


def _cells(pivots: dict[int, np.ndarray]):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 2048, 1):
            vecs = batch.column(1).to_pylist()
            dims = np.array([len(v) // 8 for v in vecs])
            cell = dims.astype(np.int64) << 20
            for d in np.unique(dims):
                if (p := pivots.get(int(d))) is not None:
                    at = np.flatnonzero(dims == d)
                    angle = _angles(_unit(np.frombuffer(b"".join(vecs[i] for i in at)).reshape(-1, d)), p)
                    near = angle.argmin(axis=1)
                    ring = np.minimum((angle[np.arange(len(at)), near] / (math.pi / RINGS)).astype(np.int64), RINGS - 1)
                    cell[at] |= (near << 8) | ring
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell)], names=["class", "vec", "n", "cell"])

    return work


def _tile(pivots: dict[int, np.ndarray]):
    def work(table: pa.Table) -> pa.Table:
        table = table.sort_by("class")
        vecs = table["vec"].to_pylist()
        x = np.frombuffer(b"".join(vecs)).reshape(len(vecs), -1)
        angle = _angles(_unit(x), pivots.get(x.shape[1]))
        return pa.table({"tile": table["tile"][:1], "classes": pa.array([table["class"].to_numpy().astype(np.int64).tobytes()], pa.binary()), "vecs": pa.array([x.tobytes()], pa.binary()),
                         "mult": pa.array([table["n"].to_numpy().astype(np.int64).tobytes()], pa.binary()), "dim": pa.array([x.shape[1]], pa.int32()),
                         "low": pa.array([angle.min(axis=0)], pa.list_(pa.float64())), "high": pa.array([angle.max(axis=0)], pa.list_(pa.float64()))})

    return work


def meetings(tiles: DataFrame, threshold: float, band: int) -> DataFrame:
    """(i, j, tile): the tiles that each pair of bands i <= j needs; from (tile, dim, low, high) alone.

    Tiles meet in a bin of their angles to the first two pivots, and then have to lie close for every pivot.
    """
    apart = math.acos(threshold) + 1e-6
    width = max(apart, 0.1)

    def bins(k: int, more: float):
        low, high = F.coalesce(F.get("low", F.lit(k)), F.lit(0.0)), F.coalesce(F.get("high", F.lit(k)), F.lit(0.0))
        return F.sequence(F.floor((low - more) / width), F.floor((high + more) / width))

    def side(name: str, more: float) -> DataFrame:
        rows = tiles.select("dim", F.struct("tile", "low", "high").alias(name), bins(1, more).alias("second"), F.explode(bins(0, more)).alias("x"))
        return rows.select("dim", name, "x", F.explode("second").alias("y"))

    far = lambda p, q: F.exists(F.zip_with(p, q, lambda x, y: x > y + apart), lambda out: out)
    pairs = side("a", 0.0).join(side("b", apart), ["dim", "x", "y"]).where("a.tile <= b.tile")
    pairs = pairs.where(~far(F.col("a.low"), F.col("b.high")) & ~far(F.col("b.low"), F.col("a.high")))
    of = lambda t: (F.col(t) / band).cast("int")
    pairs = pairs.select(of("a.tile").alias("i"), of("b.tile").alias("j"), F.explode(F.array("a.tile", "b.tile")).alias("tile"))
    return pairs.distinct()


def _compare(threshold: float):
    apart = math.acos(threshold) + 1e-6

    def work(table: pa.Table) -> pa.Table:
        tiles = []
        for r in table.to_pylist():
            x = np.frombuffer(r["vecs"]).reshape(-1, r["dim"])
            unit = _unit(x)
            tiles.append((r["band"], r["tile"], unit, quantised(unit), np.frombuffer(r["classes"], np.int64), np.frombuffer(r["mult"], np.int64), np.array(r["low"]), np.array(r["high"])))
        i, j = table["i"][0].as_py(), table["j"][0].as_py()
        left, right = [t for t in tiles if t[0] == i], [t for t in tiles if t[0] == j]
        links: dict[int, int] = {}
        forest = Forest()
        for a in left:
            for b in right:
                if i == j and b[1] < a[1] or a[2].shape[1] != b[2].shape[1] or (a[6] > b[7] + apart).any() or (b[6] > a[7] + apart).any():
                    continue
                p, q = candidates(a[3], b[3], threshold)
                if a[1] == b[1]:
                    p, q = p[p < q], q[p < q]
                for at in range(0, len(p), 200_000):
                    pp, qq = p[at : at + 200_000], q[at : at + 200_000]
                    ok = np.einsum("ij,ij->i", a[2][pp], b[2][qq]) >= threshold
                    pp, qq = pp[ok], qq[ok]
                    for own, mult, classes in ((pp, b[5][qq], a[4]), (qq, a[5][pp], b[4])):
                        total = np.bincount(own, weights=mult, minlength=len(classes))
                        for k in np.flatnonzero(total):
                            links[int(classes[k])] = links.get(int(classes[k]), 0) + int(total[k])
                    for x, y in zip(a[4][pp].tolist(), b[4][qq].tolist(), strict=True):
                        forest.join(x, y)
        root = [(forest.find(x)) for x in links]
        return pa.table({"class": pa.array(list(links), pa.int64()), "links": pa.array(list(links.values()), pa.int64()), "root": pa.array(root, pa.int64())})

    return work


def near_duplicates(vectors: DataFrame, id: str = "vec_id", vector: str = "embedding", threshold: float = 0.95, tile: int = 1024, band: int = 8, pivots: int = 512) -> DataFrame:
    """(id, n_links, component_id, kept) of every row.  tile: vectors of a tile; pivots: at most so many, one for every three tiles."""
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id).alias("_id"), F.col(vector).cast("array<double>").alias("_v"))
    # Classes of equal vectors; a class is named by a number of its own so that repeated ids stay apart.
    classes = rows.groupBy("_v").agg(F.min("_id").alias("least"), F.count("*").alias("n")).withColumn("class", F.monotonically_increasing_id())
    classes = stored(classes, "vector-classes")
    good = classes.select("class", "_v", "n").mapInArrow(_valid, "class long, vec binary, n long").where("vec is not null")
    good = stored(good, "vector-bytes")
    size = (F.length("vec") / 8).cast("int")
    lengths = dict(map(tuple, good.groupBy(size.alias("d")).count().collect()))  # a row for each length of vectors
    rows_of = {d: max(16, min(tile, (8 << 20) // (8 * d))) for d in lengths}
    many = {d: min(pivots, max(4, n // (3 * rows_of[d]))) for d, n in lengths.items() if n > rows_of[d]}  # other lengths are one tile
    at = {}
    if many:
        # One pivot for each part of a length's vectors, by hash: one partial aggregate, and at most `pivots` rows of a length.
        number = F.lit(None).cast("int")
        for d, n in many.items():
            number = F.when(size == d, F.lit(n)).otherwise(number)
        parts = good.select("vec", "class", size.alias("d"), number.alias("of")).where("of is not null")
        firsts = parts.groupBy("d", F.pmod(F.xxhash64("vec"), F.col("of")).alias("part")).agg(F.min_by("vec", F.struct(F.xxhash64("vec", F.lit(1)), F.col("class"))).alias("vec"))
        found: dict[int, list[bytes]] = {}
        for r in sorted(firsts.collect(), key=lambda r: (r["d"], r["part"])):
            found.setdefault(r["d"], []).append(bytes(r["vec"]))
        at = {d: _unit(np.frombuffer(b"".join(v)).reshape(len(v), d)) for d, v in found.items()}
    if lengths:
        cells = stored(good.mapInArrow(_cells(at), "class long, vec binary, n long, cell long"), "vector-cells")
        # At most pivots * RINGS cells for each length.  Large cells are dealt over several tiles, small ones share one.
        places, number, filled, dim = [], 0, 0, None
        for c, n in sorted(map(tuple, cells.groupBy("cell").count().collect())):
            most = rows_of[c >> 20]
            if filled and (filled + n > most or c >> 20 != dim):
                number, filled = number + 1, 0
            parts_of, dim = -(-n // most), c >> 20
            places.append((c, number, parts_of))
            if parts_of > 1:
                number, filled = number + parts_of, 0
            else:
                filled += n
        places = spark.createDataFrame(places, "cell long, first int, parts int")
        tiles = cells.join(F.broadcast(places), "cell").withColumn("tile", (F.col("first") + F.pmod(F.xxhash64("class", F.lit(8)), F.col("parts"))).cast("int"))
        tiles = stored(tiles.select("tile", "class", "vec", "n").groupBy("tile").applyInArrow(_tile(at), "tile int, classes binary, vecs binary, mult binary, dim int, low array<double>, high array<double>"), "tiles")
        need = stored(meetings(tiles.select("tile", "dim", "low", "high"), threshold, band), "meetings")
        meet = tiles.withColumn("band", (F.col("tile") / band).cast("int")).join(need, "tile")
        found = stored(meet.groupBy("i", "j").applyInArrow(_compare(threshold), "class long, links long, root long"), "vector-links")
        links = found.groupBy("class").agg(F.sum("links").alias("links"))
        parts_ = components(found.select("class", "root"))
        named = classes.select("class", "least", "n").join(links, "class", "left").join(parts_, F.col("class") == F.col("node"), "left").join(good.select("class", F.lit(True).alias("good")), "class", "left")
    else:
        named = classes.select("class", "least", "n").withColumns({"links": F.lit(None).cast("long"), "component": F.lit(None).cast("long"), "good": F.lit(None).cast("boolean")})
    named = named.select("class", "least", "good", F.coalesce("component", "class").alias("root"), F.when(F.col("good"), F.coalesce("links", F.lit(0)) + F.col("n") - 1).otherwise(0).cast("long").alias("n_links"))
    named = stored(named, "vector-names")
    if lengths:
        discard(cells, tiles, need, found, good)
    roots = named.groupBy("root").agg(F.min("least").alias("component_id"))
    named = named.join(roots, "root").select("class", "good", "n_links", "component_id")
    lookup_ = classes.select("class", "_v").join(named, "class").drop("class")
    out = rows.join(lookup_, rows["_v"].eqNullSafe(lookup_["_v"]), "left").select("_id", "n_links", F.when(F.col("good"), F.col("component_id")).otherwise(F.col("_id")).alias("component_id"))
    return out.select(F.col("_id").alias(id), "n_links", "component_id", (F.col("_id") == F.col("component_id")).alias("kept"))

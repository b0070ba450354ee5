"""Knowledge graphs: merging, duplicate entities, degree ranking, and links between documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def node_id(kind, label):
    """kind_ and twelve letters of a hash of kind and lower-case label."""
    return F.concat(kind, F.lit("_"), F.left(F.sha2(F.concat(kind, F.lit(":"), F.lower(label)), 256), F.lit(12)))


def merged(primary: DataFrame, fallback: DataFrame, keys: list[str]) -> DataFrame:
    """Union by key; where both have it, the primary's row stays in the fallback's place; `ord` is the place."""
    rest = [c for c in primary.columns if c not in (*keys, "ord")]
    side = lambda rows, p: rows.select(*keys, F.struct(F.lit(p).alias("p"), *rest).alias("row"), F.struct(F.lit(1 - p).alias("late"), "ord").alias("place"))
    both = side(primary, 0).unionByName(side(fallback, 1))
    out = both.groupBy(*keys).agg(F.min_by("row", "row.p").alias("row"), F.min("place").alias("place"))
    return out.select(*keys, *[F.col("row")[c].alias(c) for c in rest], F.concat_ws(":", F.col("place.late").cast("string"), F.col("place.ord")).alias("ord"))


def survivors(nodes: DataFrame, id: str = "doc_id") -> DataFrame:
    """(doc_id, id, keep): of nodes with the same kind and label, whatever its case and blanks, the first one survives."""
    label = F.substring(F.trim(F.regexp_replace(F.lower(F.coalesce("label", F.lit(""))), r"\s+", " ")), 1, 120)
    order = Window.partitionBy(id, F.coalesce("kind", F.lit("node")), label).orderBy("ord")
    return nodes.select(id, "id", F.first("id").over(order).alias("keep"))


def without_duplicates(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes without duplicate entities; edges rewritten to survivors, without loops, dangling ends and repeats."""
    keep = survivors(nodes)
    left = nodes.join(keep.where("id = keep").select("doc_id", "id"), ["doc_id", "id"], "left_semi")
    ends = lambda n: keep.select("doc_id", F.col("id").alias(n), F.col("keep").alias(n + "_keep"))
    moved = edges.join(ends("source"), ["doc_id", "source"]).join(ends("target"), ["doc_id", "target"]).where("source_keep <> target_keep")
    moved = moved.groupBy("doc_id", F.col("source_keep").alias("source"), F.col("target_keep").alias("target"), "relation").agg(F.min_by("confidence", "ord").alias("confidence"), F.min("ord").alias("ord"))
    return left, moved


def degrees(nodes: DataFrame, edges: DataFrame, top: int = 8) -> DataFrame:
    """(doc_id, rank, id, label, degree) of the `top` nodes of each document: by degree, then by the first edge that names them."""
    ends = edges.select("doc_id", F.posexplode(F.array("source", "target")).alias("end", "id"), "ord").groupBy("doc_id", "id").agg(F.count("*").alias("degree"), F.min(F.struct("ord", "end")).alias("first"))
    order = Window.partitionBy("doc_id").orderBy(F.desc("degree"), "first")
    best = ends.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return best.join(nodes.select("doc_id", "id", "label"), ["doc_id", "id"], "left").select("doc_id", "rank", "id", F.coalesce("label", "id").alias("label"), "degree")


def surprising(edges: DataFrame, top: int = 12) -> DataFrame:
    """The first `top` inferred edges of each document."""
    order = Window.partitionBy("doc_id").orderBy("ord")
    return edges.where("confidence = 'INFERRED'").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)


def orphans(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes without any edge."""
    ends = edges.select("doc_id", F.explode(F.array("source", "target")).alias("id")).distinct()
    return nodes.join(ends, ["doc_id", "id"], "left_anti")

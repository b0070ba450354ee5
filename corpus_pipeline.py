"""A corpus pipeline of four operators: toxicity, quality classifier, near-dedup, packing.

Each stage takes (spark, docs, sf_dir) and gives a DataFrame; all but the last give the columns of documents.  The tables
between two stages are written as Parquet and read again, so a lost executor costs one stage at most.

Defined cases, of every stage: a null text is the empty text; empty texts score the models' bias, and those that no stage rejects meet in
one group of copies, of which one stays; null and repeated ids are rows of their own; extra columns go through whatever their names; a
table of no rows gives one.
"""

from __future__ import annotations

import numpy as np
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.llm import near_copies, packing, quality_classifier, toxicity
from marginalia.llm.common import discard, free_name, stored, table
from marginalia.runtime import ship

TOKENIZER = "byte_bpe_50k.json"
#: Weights of the quality model are whole multiples of 1 / WHOLE, so their sums are exact, and a text's key is the same on any machine.
WHOLE = float(1 << 24)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity score below 0.5 stay; the model is learnt from this stage's own documents."""
    model = toxicity.train(docs, table(ship(spark), sf_dir, "labels"))
    return docs.where(toxicity.score_column(spark, model, F.col("text")) < 0.5)


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with the largest Gumbel keys stay, as many as the labels of this stage's documents call good."""
    labels = table(ship(spark), sf_dir, "labels")
    own = labels.join(docs.select("doc_id"), "doc_id", "left_semi")
    weight, key = free_name(docs, "_log_weight"), free_name(docs, "_key")
    model = np.round(quality_classifier.train(docs, labels) * WHOLE) / WHOLE
    rows = quality_classifier.keyed(docs, model, weight=weight, key=key)
    keys = stored(rows.select(key), "keys")  # no texts: the rows that stay get their keys again
    keep = quality_classifier.chosen(keys, quality_classifier.keep_share(own), key)
    discard(keys)
    return rows.where(keep).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near copies (five-word similarity of at least 0.8) the row with the least id stays."""
    ship(spark)
    name = free_name(docs, "_row")
    rows = stored(docs.withColumn(name, F.monotonically_increasing_id()), "rows")
    dropped = near_copies.few(near_copies.dropped_rows(rows.select(F.col(name).alias("_row"), "doc_id", "text")))
    return rows.join(dropped, rows[name] == dropped["_row"], "left_anti").select(*docs.columns)  # texts don't move for few ids


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    # The heap is full by now, so the workers count less text at once than in a run of their own.
    return packing.pack_documents(docs, public_tokenizers.path(TOKENIZER), batch=2 << 20)


STAGES = [("toxicity", drop_toxic), ("quality_classifier", drop_low_quality), ("simhash_dedup", drop_near_copies), ("packing", pack)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stored(docs, name)
    return docs

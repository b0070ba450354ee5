"""Sources: format routing, label cleaning, preflight checks, fingerprints, files and nested JSON columns."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marginalia.functions import fixed as X
from marginalia.functions.text import strip

CONTROL = "[\\x01-\\x08\\x0b\\x0c\\x0e-\\x1f]"


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """(label, raw, byte_length, code) of text, Markdown and JSON files, each whole; a file above the size limit has no text but the
    code input.too-large."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.{txt,md,markdown,json}").option("recursiveFileLookup", "true").load(path)
    fits = F.col("length") <= X.MAX_BYTES
    return files.select(F.element_at(F.split("path", "/"), -1).alias("label"), F.when(fits, F.decode("content", "UTF-8")).alias("raw"), F.col("length").alias("byte_length"), F.when(~fits, "input.too-large").alias("code"))


def detect_format(raw: Column) -> Column:
    """json, text or empty, by the first letter that isn't white space."""
    flat = strip(raw)
    return F.when(F.coalesce(flat, F.lit("")) == "", "empty").when(flat.rlike(r"^[\{\[]"), "json").otherwise("text")


def sanitize_label(label: Column) -> Column:
    base = F.element_at(F.split(F.coalesce(label, F.lit("")), r"[\\/]"), -1)
    flat = F.substring(strip(F.regexp_replace(base, r'[\x00-\x1f<>:"|?*]', "")), 1, 120)
    return F.when(flat == "", "Pasted notes").otherwise(flat)


def clean_text(raw: Column) -> Column:
    """Without byte-order mark, with line feeds only."""
    return F.regexp_replace(F.regexp_replace(raw, "^﻿", ""), r"\r\n?", "\n")


def line_column(text: Column, offset: Column) -> Column:
    """STRUCT(line, column), 1-based, of a 1-based offset."""
    before = F.split(F.substring(text, F.lit(1), offset - 1), "\n")
    return F.struct(F.size(before).alias("line"), (F.length(F.element_at(before, -1)) + 1).cast("int").alias("column"))


def preflight(docs: DataFrame, raw: str = "raw") -> DataFrame:
    """`docs` with text, byte_length, format and diagnostics; the first failing guard wins: empty, too large, binary, controls."""
    t = F.coalesce(F.col(raw), F.lit(""))
    nul = F.instr(t, "\x00")
    sample = F.substring(t, 1, X.CONTROL_SAMPLE)
    share = F.regexp_count(sample, F.lit(CONTROL)) / F.greatest(F.length(sample), F.lit(1))
    none = F.struct(F.lit(None).cast("int").alias("line"), F.lit(None).cast("int").alias("column"))
    flaw = lambda code, at=none: F.array(F.struct(F.lit(code).alias("code"), at["line"].alias("line"), at["column"].alias("column")))
    found = (
        F.when(strip(t) == "", flaw("input.empty"))
        .when(F.octet_length(t) > X.MAX_BYTES, flaw("input.too-large"))
        .when(nul > 0, flaw("input.binary", line_column(t, nul)))
        .when(share > X.MAX_CONTROL_SHARE, flaw("input.binary"))
        .otherwise(F.array().cast("array<struct<code:string,line:int,column:int>>"))
    )
    return docs.withColumns({"text": clean_text(t), "byte_length": F.octet_length(t).cast("long"), "format": detect_format(clean_text(t)), "diagnostics": found})


@F.pandas_udf(T.StringType())
def nfc(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else unicodedata.normalize("NFC", t))


def fingerprint(text: Column) -> Column:
    """SHA-256 of the NFC text with line feeds, trimmed.  Texts of ASCII alone are in NFC and stay out of Python."""
    flat = F.regexp_replace(text, r"\r\n?", "\n")
    other = nfc(F.when(flat.rlike(r"[^\x00-\x7F]"), flat))
    return F.sha2(strip(F.coalesce(other, flat)), 256)


def verified_lookup(docs: DataFrame, catalogue: DataFrame, text: str = "text") -> DataFrame:
    """`docs` whose fingerprint is in the catalogue (fingerprint, example_id); an equi-join, planned by size."""
    return docs.withColumn("fingerprint", fingerprint(F.col(text))).join(catalogue, "fingerprint")

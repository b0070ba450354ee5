"""Operator 12: alignment of two tokenizers over the same texts.

The tokens of A and B tile the bytes of a text.  B's tokens form a static interval index, their sorted starts and ends; for each A
token two bisections give the first and the last B token that overlaps it.  Places that no token of either side spans, where both have an
end, are the boundaries of groups.  The index is built once for a batch of texts laid end to end, since no token crosses a text.

`aligned` gives the tokens, links and groups of each text.  `pair_counts` counts, for each pair of ids, the documents that hold it
linked; `with_counts` brings these counts back to the documents.  For that, documents lie in units of about 8 MB of text: a unit knows its
distinct pairs with their numbers of documents, and its links as places in that list (compressed).  Units send distinct pairs only, once
to be summed and once to ask for the sums; the links themselves move with their unit.  No count is broadcast.

A is a byte-level vocabulary (JSON of the tokenizers library), encoded by rank; texts with characters outside the Latin letters and the usual
marks, whose classes could differ between libraries' Unicode tables, go through the tokenizers library itself.  B is a sentencepiece
model.

Defined cases: a null or empty text, and one whose joined A or B bytes differ from blank + text (B normalises some characters), has no
tokens, so zeros and no groups; strings of special tokens are plain text; repeated rows and ids are documents of their own; very long texts
are encoded whole, batches of them are cut by bytes; columns outside `keep` are dropped, whatever their names; an empty table gives an
empty table.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia.llm.bpe import byte_letters
from marginalia.llm.common import held, slices, stored

#: Characters that every version of the Unicode tables classes alike.
PLAIN = regex.compile("[\n\r\t\x20-\x7e\xa1-\xac\xae-ɏ‐-‧‰-⁞₠-€]*+")
#: How a byte-level vocabulary of this kind cuts texts into pieces (a fixed value of the format).
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
UNIT = 8 << 20


class Sides:
    """The two tokenizers, and the bytes of every token."""

    def __init__(self, byte_path: str, piece_path: str) -> None:
        import sentencepiece
        import tiktoken
        from tokenizers import Tokenizer

        with open(byte_path, encoding="utf-8") as f:
            spec = json.load(f)
        back = {c: b for b, c in enumerate(byte_letters())}
        special = {x["content"] for x in spec.get("added_tokens", [])}
        vocab = spec["model"]["vocab"]
        known = {i: bytes(back[c] for c in token) for token, i in vocab.items() if token not in special}
        self.a_bytes = [known.get(i, b"") for i in range(max(vocab.values()) + 1)]
        # A token's rank is its age: single bytes first, then the merges in order.
        pairs = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        ranks = {b: k for k, b in enumerate(b for b in known.values() if len(b) == 1)}
        for a, b in pairs:
            ranks.setdefault(bytes(back[c] for c in a + b), len(ranks))
        number = {t: i for i, t in known.items()}
        self.ids = np.zeros(len(ranks), np.int64)
        for token, rank in ranks.items():
            self.ids[rank] = number[token]
        self.by_rank = tiktoken.Encoding("ranks", pat_str=PIECES, mergeable_ranks=ranks, special_tokens={})
        self.library = Tokenizer.from_file(byte_path)
        self.library.encode_special_tokens = True
        self.library.no_truncation()
        self.library.no_padding()
        self.pieces = sentencepiece.SentencePieceProcessor(model_file=piece_path)
        n = self.pieces.get_piece_size()
        names = [self.pieces.id_to_piece(i) for i in range(n)]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.pieces.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(names)]
        self.a_length, self.b_length = (np.array([len(b) for b in side], np.int64) for side in (self.a_bytes, self.b_bytes))
        # A group's text: each id with what stands behind it (next of its side, end of the side, end of the group).
        self.shown = [f"{i}{mark}" for i in range(len(self.a_bytes)) for mark in ",|"] + [f"{i}{mark}" for i in range(n) for mark in ",;"]

    def a_ids(self, text: str) -> np.ndarray:
        if PLAIN.fullmatch(text):
            return self.ids[self.by_rank.encode_ordinary(text)]
        return np.array(self.library.encode(text, add_special_tokens=False).ids, np.int64)

    def both(self, texts: list[str | None]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """The ids of each side; none for texts that the sides don't tile alike."""
        none = np.zeros(0, np.int64)
        a, b = [], []
        for text, found in zip(texts, self.pieces.encode([t or "" for t in texts], num_threads=1), strict=True):
            left = self.a_ids(" " + text) if text else none
            whole = b" " + text.encode() if text else b""
            get = self.b_bytes.__getitem__
            if text and b"".join(map(get, found)) == whole and b"".join(map(self.a_bytes.__getitem__, left.tolist())) == whole:
                a.append(left)
                b.append(np.array(found, np.int64))
            else:
                a.append(none)
                b.append(none)
        return a, b


class Aligned(NamedTuple):
    """A batch of texts end to end.  a, b: ids; a_of, b_of: where each text's tokens start (one entry more than texts); left, right: the
    links as places in a and b, by left; group_a, group_b: the group of every token, numbered through; link_of, groups: as a_of, and
    the number of groups of each text."""

    a: np.ndarray
    b: np.ndarray
    a_of: np.ndarray
    b_of: np.ndarray
    left: np.ndarray
    right: np.ndarray
    link_of: np.ndarray
    group_a: np.ndarray
    group_b: np.ndarray
    groups: np.ndarray


def align(a: list[np.ndarray], b: list[np.ndarray], a_length: np.ndarray, b_length: np.ndarray) -> Aligned:
    a_of, b_of = (np.cumsum([0, *map(len, side)]) for side in (a, b))
    a, b = (np.concatenate([np.zeros(0, np.int64), *side]) for side in (a, b))
    a_end, b_end = np.cumsum(a_length[a]), np.cumsum(b_length[b])
    a_start, b_start = a_end - a_length[a], b_end - b_length[b]
    first, last = np.searchsorted(b_end, a_start, "right"), np.searchsorted(b_start, a_end, "left")  # the stabbing queries
    each = last - first
    left = np.repeat(np.arange(len(a)), each)
    right = np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each) + np.repeat(first, each)
    link_of = np.r_[0, np.cumsum(each)][a_of]
    seams = np.intersect1d(a_end, b_end, assume_unique=True)
    group_a, group_b = np.searchsorted(seams, a_end, "left"), np.searchsorted(seams, b_end, "left")
    through = np.r_[0, group_a + 1][a_of]  # groups up to each text's end
    return Aligned(a, b, a_of, b_of, left, right, link_of, group_a, group_b, np.diff(through))


def group_texts(x: Aligned, sides: Sides) -> list[str]:
    """`a1,a2|b1;a3|b2,b3` for each text: its groups, A's ids and B's; empty without tokens."""
    ends = lambda group: np.r_[group[1:] != group[:-1], np.ones(min(1, len(group)), bool)].astype(np.int64)
    codes = np.zeros(len(x.a) + len(x.b), np.int64)
    # In order of groups, A before B; both sides lie by group already.
    codes[np.arange(len(x.a)) + np.searchsorted(x.group_b, x.group_a, "left")] = 2 * x.a + ends(x.group_a)
    codes[np.arange(len(x.b)) + np.searchsorted(x.group_a, x.group_b, "right")] = 2 * (len(sides.a_bytes) + x.b) + ends(x.group_b)
    show, at = sides.shown.__getitem__, x.a_of + x.b_of
    return ["".join(map(show, codes[i:j].tolist()))[:-1] for i, j in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]


def loaded(byte_path: str, piece_path: str) -> Sides:
    return held(("sides", byte_path, piece_path), lambda: Sides(byte_path, piece_path))


def _lists(values: np.ndarray, of: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(of.astype(np.int32)), pa.array(values, kind))


def aligned(docs: DataFrame, byte_path: str, piece_path: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """`keep` columns and of every whole text: `a_ids`, `b_ids` array<int>; `link_a`, `link_b` array<int>, the places (from 0) in them of
    each link's two tokens; `groups` string as `group_texts` writes it.  A map without any shuffle."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sides = loaded(byte_path, piece_path)
        for batch in slices(batches, 1024, len(keep), 1 << 20):
            x = align(*sides.both(batch.column(len(keep)).to_pylist()), sides.a_length, sides.b_length)
            each = np.diff(x.link_of)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[: len(keep)], _lists(x.a, x.a_of, pa.int32()), _lists(x.b, x.b_of, pa.int32()),
                 _lists(x.left - np.repeat(x.a_of[:-1], each), x.link_of, pa.int32()), _lists(x.right - np.repeat(x.b_of[:-1], each), x.link_of, pa.int32()), pa.array(group_texts(x, sides), pa.string())],
                names=[*keep, "a_ids", "b_ids", "link_a", "link_b", "groups"],
            )

    types = dict(docs.dtypes)
    schema = ", ".join([*(f"`{k}` {types[k]}" for k in keep), "a_ids array<int>, b_ids array<int>, link_a array<int>, link_b array<int>, groups string"])
    return docs.select(*keep, text).mapInArrow(work, schema)


#: An id pair as one number.
SHIFT = 20
NUMBERS = ("n_a", "n_b", "n_groups", "n_links")
Extra = dict[str, tuple[str, Callable[[Aligned, Sides], list]]]


def units(docs: DataFrame, byte_path: str, piece_path: str, text: str, keep: tuple[str, ...], more: Extra) -> DataFrame:
    """One row for about UNIT bytes of texts of one task: `pairs` distinct id pairs, `docs` in how many of the unit's texts each is linked,
    `links` the places in `pairs` of all links in order (compressed), and an array of each column of the texts."""
    names = ["unit", "pairs", "docs", "links", "size", *keep, *NUMBERS, *more]

    def pack(number: int, parts: list[tuple[list, Aligned]]) -> pa.RecordBatch:
        import pandas as pd

        codes = np.concatenate([(x.a[x.left] << SHIFT) | x.b[x.right] for _, x in parts])
        each = np.concatenate([np.diff(x.link_of) for _, x in parts])
        place, pairs = pd.factorize(codes)
        del codes
        inside = pd.unique(place.astype(np.int64) * len(each) + np.repeat(np.arange(len(each)), each))
        docs = np.bincount(inside // max(1, len(each)), minlength=len(pairs))
        raw = place.astype(np.uint32).tobytes()
        columns = [pa.concat_arrays(c) for c in zip(*(c for c, _ in parts), strict=True)]
        one = lambda array: pa.ListArray.from_arrays(pa.array([0, len(array)], pa.int32()), array)
        return pa.RecordBatch.from_arrays([pa.array([number]), one(pa.array(pairs, pa.int64())), one(pa.array(docs, pa.int32())), pa.array([pa.compress(raw, "zstd", asbytes=True)], pa.binary()), pa.array([len(raw)], pa.int64()), *map(one, columns)], names=names)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        sides = loaded(byte_path, piece_path)
        number, parts, size = TaskContext.get().partitionId() << 32, [], 0
        for batch in slices(batches, 1024, len(keep), 1 << 20):
            texts = batch.column(len(keep))
            x = align(*sides.both(texts.to_pylist()), sides.a_length, sides.b_length)
            counts = [np.diff(x.a_of), np.diff(x.b_of), x.groups, np.diff(x.link_of)]
            found = [pa.array(f(x, sides)) for _, f in more.values()]
            parts.append(([*batch.columns[: len(keep)], *(pa.array(c, pa.int64()) for c in counts), *found], x))
            size += texts.nbytes
            if size >= UNIT:
                yield pack(number, parts)
                number, parts, size = number + 1, [], 0
        if parts:
            yield pack(number, parts)

    types = dict(docs.dtypes)
    schema = "unit long, pairs array<long>, docs array<int>, links binary, size long, " + ", ".join([*(f"`{k}` array<{types[k]}>" for k in keep), *(f"{n} array<long>" for n in NUMBERS), *(f"`{n}` array<{t}>" for n, (t, _) in more.items())])
    return docs.select(*keep, text).mapInArrow(work, schema)


def pair_counts(units: DataFrame) -> DataFrame:
    """(pair, docs, best): the documents that hold an id pair linked, and whether no pair of the same A id has more."""
    asked = units.select(F.explode(F.arrays_zip("pairs", "docs")).alias("p")).select(F.col("p.pairs").alias("pair"), F.col("p.docs").alias("n"))
    counts = stored(asked.groupBy("pair").agg(F.sum("n").alias("docs")), "pair-counts")
    a = F.shiftright("pair", SHIFT).alias("a")
    most = counts.groupBy(a).agg(F.max("docs").alias("most"))
    return counts.withColumn("a", a).join(most, "a").select("pair", "docs", (F.col("docs") == F.col("most")).alias("best"))


def with_counts(docs: DataFrame, byte_path: str, piece_path: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",), more: Extra | None = None) -> DataFrame:
    """`keep` columns and long n_a, n_b, n_groups, n_links of every whole text; n_best: its links whose pair has the most documents of all
    pairs of that A id; count_sum: the documents of its links' pairs, summed.  more: columns of (type, function of a batch)."""
    more = more or {}
    done = stored(units(docs, byte_path, piece_path, text, keep, more), "alignment-units")
    counts = stored(pair_counts(done), "best-pairs")
    asked = done.select("unit", F.posexplode("pairs").alias("at", "pair"))
    # A count that is its A id's best travels as a negative number.
    answers = asked.join(counts, "pair").select(F.col("unit").alias("of"), "at", F.when(F.col("best"), -F.col("docs")).otherwise(F.col("docs")).alias("n"))
    names = [*keep, *NUMBERS, "n_best", "count_sum", *more]

    def settle(unit: pa.Table, answers: pa.Table) -> pa.Table:
        of = np.zeros(answers.num_rows, np.int64)
        of[answers["at"].to_numpy()] = answers["n"].to_numpy()
        row = unit.combine_chunks()
        values = {n: row[n].chunk(0).values if row.num_rows else None for n in (*keep, *NUMBERS, *more)}
        place = np.frombuffer(pa.decompress(row["links"][0].as_py(), row["size"][0].as_py(), "zstd", asbytes=True), np.uint32)
        ends = np.r_[0, np.cumsum(values["n_links"].to_numpy())]
        at_best, total = (np.r_[0, np.cumsum(x[place])] for x in ((of < 0).astype(np.int64), np.abs(of)))
        between = lambda running: pa.array(running[ends[1:]] - running[ends[:-1]], pa.int64())
        return pa.table([*(values[k] for k in (*keep, *NUMBERS)), between(at_best), between(total), *(values[k] for k in more)], names=names)

    types = dict(docs.dtypes)
    schema = ", ".join([*(f"`{k}` {types[k]}" for k in keep), *(f"{n} long" for n in (*NUMBERS, "n_best", "count_sum")), *(f"`{n}` {t}" for n, (t, _) in more.items())])
    texts = done.select("unit", "links", "size", *keep, *NUMBERS, *more)
    return texts.groupBy("unit").cogroup(answers.groupBy("of")).applyInArrow(settle, schema)


def groups_sha256(x: Aligned, sides: Sides) -> list[str]:
    """The digest of each text's groups; empty without tokens."""
    return [hashlib.sha256(g.encode()).hexdigest() if g else "" for g in group_texts(x, sides)]

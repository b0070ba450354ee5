"""Operator 2: BPE encoding and decoding.

Encoding of one word: the mergeable pairs lie in a priority queue by merge rank (ties: the left one first); symbols form
a doubly linked list; an entry of the queue that no longer matches its pair is stale and is skipped.  Decoding
concatenates vocabulary strings.  The vocabulary file is that of a public tokenizer (a parameter) and is never trained.

Defined cases: a null text is the empty text; the empty text has no tokens and decodes to the empty text; strings of
special tokens inside a text become those tokens, as in the tokenizers library; repeated rows are encoded once each; very long texts
are encoded whole, batches of them are cut by bytes; columns outside `keep` are dropped, whatever their names; an empty table gives an
empty table.
"""

from __future__ import annotations

import heapq
import json
import re
import unicodedata
from array import array
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from marginalia.llm.common import held, slices

#: White space to Python alone.
SEPARATORS = re.compile("[\x1c-\x1f]")
#: Words that one worker remembers: two generations of this many, none of them longer than LONGEST letters.
MEMORY, LONGEST = 350_000, 64


def byte_letters() -> list[str]:
    """The printable letter that byte-level vocabularies use for each byte: itself where printable, else the next letter from 256."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    letters, spare = [], 256
    for b in range(256):
        if b in printable:
            letters.append(chr(b))
        else:
            letters.append(chr(spare))
            spare += 1
    return letters


class Remembered(dict):
    """A memo of bounded size: when it is full it becomes the old generation, whose entries return when they are used."""

    def __init__(self, make, limit: int = MEMORY) -> None:
        super().__init__()
        self.make, self.limit, self.old = make, limit, {}

    def __missing__(self, key):
        value = self.old.get(key)
        return self.keep(key, self.make(key) if value is None else value)

    def seen(self, key):
        """The value, or None if it isn't remembered."""
        value = self.get(key)
        return self.old.get(key) if value is None else value

    def keep(self, key, value):
        if not isinstance(key, str) or len(key) <= LONGEST:
            if len(self) >= self.limit:
                self.old = dict(self)
                self.clear()
            self[key] = value
        return value


#: Linked lists of the first words' lengths, copied instead of built.
_AFTER, _BEFORE = list(range(1, 66)), list(range(-1, 64))


def merged(symbols: list[int], merges: dict[int, int], made: list[int]) -> list[int]:
    """BPE of one word.  merges: packed pair of symbols -> rank << 32; made: the new symbol of each rank."""
    n = len(symbols)
    if n < 2:
        return symbols
    get, push, pop = merges.get, heapq.heappush, heapq.heappop
    queue = []
    left = symbols[0]
    for i in range(n - 1):
        right = symbols[i + 1]
        if (m := get(left << 20 | right)) is not None:
            queue.append(m | i)
        left = right
    if not queue:
        return symbols
    after, before = (_AFTER[:n], _BEFORE[:n]) if n < 65 else (list(range(1, n + 1)), list(range(-1, n - 1)))
    if len(queue) > 1:
        heapq.heapify(queue)
    dead = 0
    while queue:
        entry = pop(queue)
        i = entry & 0xFFFFFFFF
        left, j = symbols[i], after[i]
        if left < 0 or j >= n or get(left << 20 | symbols[j]) != entry - i:
            continue  # stale: one of the two symbols has changed since
        new = symbols[i] = made[entry >> 32]
        symbols[j] = -1
        dead += 1
        k = after[i] = after[j]
        if k < n:
            before[k] = i
            if (m := get(new << 20 | symbols[k])) is not None:
                push(queue, m | i)
        h = before[i]
        if h >= 0 and (m := get(symbols[h] << 20 | new)) is not None:
            push(queue, m | h)
    return [s for s in symbols if s >= 0] if dead else symbols


def _packed(ids: list[int]) -> bytes:
    return array("I", ids).tobytes()


class WordBpe:
    """The vocabulary file `path` (JSON of the tokenizers library; BPE with word ends, lower case, white space dropped)."""

    PIECE = r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+"
    # White space as Unicode has it; Python's own notion adds the separators 28 to 31.
    WHITE = "[\t-\r \x85\xa0  -     　]+"

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.end = model.get("end_of_word_suffix") or ""
        vocab = model["vocab"]
        special = {x["content"]: x["id"] for x in spec.get("added_tokens", [])}
        self.strings = [""] * (1 + max([*vocab.values(), *special.values()]))
        for token, i in chain(vocab.items(), special.items()):
            self.strings[i] = token
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.merges = {vocab[a] << 20 | vocab[b]: rank << 32 for rank, (a, b) in enumerate(pairs)}
        self.made = [vocab[a + b] for a, b in pairs]
        letters = byte_letters()
        self.inner = [vocab[c] for c in letters]
        self.last = [vocab[c + self.end] for c in letters]
        self.special = special
        self.special_re = regex.compile("(" + "|".join(map(regex.escape, sorted(special, key=len, reverse=True))) + ")") if special else None
        self.piece_re = regex.compile(self.PIECE.replace(r"\s", self.WHITE[1:-2]))
        self.white_re = re.compile(self.WHITE)
        self.simple_re = re.compile("([A-Za-z]+)([.,;:!?]*)")
        self.words, self.chunks = Remembered(self._word), Remembered(self._chunk)

    def _word(self, word: str) -> bytes:
        raw, inner = word.encode(), self.inner
        symbols = [inner[b] for b in raw]
        symbols[-1] = self.last[raw[-1]]
        return _packed(merged(symbols, self.merges, self.made))

    def _plain(self, text: str) -> bytes:
        # The library lowers letter by letter, so without the final sigma.
        text = text if text.isascii() else unicodedata.normalize("NFC", text).replace("Σ", "σ")
        words = self.words
        return b"".join([words[w] for w in self.piece_re.findall(text.lower())])

    def _chunk(self, chunk: str) -> bytes:
        if m := self.simple_re.fullmatch(chunk):
            word, end = m.groups()
            return self.words[word.lower()] + self.words[end] if end else self.words[word.lower()]
        if self.special_re is None or "<" not in chunk:
            return self._plain(chunk)
        return b"".join([_packed([self.special[p]]) if k % 2 else self._plain(p) for k, p in enumerate(self.special_re.split(chunk))])

    def packed(self, text: str | None) -> bytes:
        """The ids as unsigned 32-bit numbers, one after the other."""
        if not text:
            return b""
        # No token crosses white space, so each stretch between white space is encoded once.
        parts = self.white_re.split(text) if SEPARATORS.search(text) else text.split()
        chunks = self.chunks
        return b"".join([chunks[c] for c in parts if c])

    def encode(self, text: str | None) -> list[int]:
        return np.frombuffer(self.packed(text), np.uint32).tolist()

    def decode(self, ids) -> str:
        """As the tokenizers library without a decoder in the file: vocabulary strings, one blank between them."""
        strings = self.strings
        return " ".join([strings[i] for i in ids])


def loaded(path: str) -> WordBpe:
    """One tokenizer for each worker process and path."""
    return held(("words", path), lambda: WordBpe(path))


def encode_decode(docs: DataFrame, path: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """`keep` columns, `token_ids` array<int> and `decoded` string of every whole text.  A map without any shuffle."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(path)
        for batch in slices(batches, 1024, len(keep), 4 << 20):
            packed = [bpe.packed(t) for t in batch.column(len(keep)).to_pylist()]
            offsets = np.zeros(len(packed) + 1, dtype=np.int32)
            np.cumsum([len(x) // 4 for x in packed], out=offsets[1:])
            ids = np.frombuffer(b"".join(packed), np.uint32).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[: len(keep)], pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids)), pa.array([bpe.decode(np.frombuffer(x, np.uint32).tolist()) for x in packed], pa.string())],
                names=[*keep, "token_ids", "decoded"],
            )

    types = dict(docs.dtypes)
    schema = ", ".join([*(f"`{k}` {types[k]}" for k in keep), "token_ids array<int>", "decoded string"])
    return docs.select(*keep, text).mapInArrow(work, schema)

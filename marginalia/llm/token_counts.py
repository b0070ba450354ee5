"""Operator 7: token counts by prefix dynamic programming.

For every prefix of a piece of text the programme stores the last token of that prefix's encoding and the number of
tokens: the last token is the one ending there that may follow the last token before it, where two tokens may stand side by
side if no merge across their seam comes before the merges that made them.  So the counts of all prefixes of a text are
known after one pass, and truncation and budget questions need no further encoding: `token_counts` answers budgets from the
running counts, `prefix_tables` stores the count at every character, `longest_within` reads a stored table.

Texts of usual white space are cut into words by Arrow, each distinct word of a batch is looked up once, and the running
sums of the words' counts are the prefix counts at their ends; inside the word that a budget falls into, the counts of its own
prefixes decide.  Other texts go piece by piece.

Defined cases: a null text is the empty text with 0 tokens; strings of special tokens inside texts count as one token, as
in the tokenizers library; repeated rows count once each; very long texts are counted whole, batches of them are cut by bytes;
an empty table gives an empty table; columns outside `keep` are dropped, whatever their names.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginalia.llm.bpe import SEPARATORS, Remembered, byte_letters
from marginalia.llm.common import held, slices

#: Pieces and words that one worker remembers, in two generations of this many small numbers.
MEMORY = 300_000
#: Words of letters after a blank, and the marks at their ends.
PLAIN = r"\A(?P<letters>[A-Za-zÀ-ÖØ-öø-ɏ]{1,64})(?P<marks>[.,;:!?]*)\z"
#: Texts with other white space than single blanks and single or double line breaks between words.
ODD = "[\\x00\\x01\t\x0b-\r\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]|  |\n\n\n| \n|\n |\\A[ \n]|[ \n]\\z"
WHITE = "\t-\r \x85\xa0  -     　"


class PrefixCounter:
    """A byte-level vocabulary file (JSON of the tokenizers library)."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        back = {c: b for b, c in enumerate(byte_letters())}
        as_bytes = lambda token: bytes(back[c] for c in token)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        # A token's number is its age: the 256 bytes first, then the merges in order.
        number = {bytes([b]): b for b in range(256)}
        self.parts: list[tuple[int, int]] = [(b, b) for b in range(256)]
        self.merges: dict[int, int] = {}
        for a, b in pairs:
            a, b = as_bytes(a), as_bytes(b)
            if a + b in number:
                continue
            new = number[a + b] = len(self.parts)
            self.parts.append((number[a], number[b]))
            self.merges[number[a] << 20 | number[b]] = new
        # Tokens whose own encoding is another one never occur.
        self.number = {t: i for t, i in number.items() if i < 256 or self.may_follow(*self.parts[i], i)}
        self.endings: dict = {}  # a trie of the tokens from their last byte on
        for token, i in self.number.items():
            node = self.endings
            for byte in reversed(token):
                node = node.setdefault(byte, {})
            node[-1] = i
        self.special = [x["content"] for x in spec.get("added_tokens", [])]
        self.special_re = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.piece_re = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{WHITE}\p{{L}}\p{{N}}]+|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]+")
        # Pieces never run from a letter into white space, so these chunks can be counted apart.
        self.chunk_re = regex.compile(rf" ?[^{WHITE}]+|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]+")
        self.fast_re = re.compile(r" ?\S+|\s+(?!\S)|\s+")
        self.simple_re = re.compile("( ?[A-Za-z]+)([.,;:!?]*)")
        self.white_re = regex.compile(rf"[{WHITE}]+")
        self.white = {chr(c) for c in (*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)}
        self.seams: dict[int, bool] = {}
        self.pieces, self.chunks = Remembered(lambda p: self.counts(p.encode())[-1], MEMORY), Remembered(self._chunk, MEMORY)
        self.words = Remembered(self._word, MEMORY)
        self.odd = ODD + "".join("|" + re.escape(x) for x in self.special)

    def may_follow(self, left: int, right: int, below: int = 1 << 30) -> bool:
        """No merge across the seam happens, among merges older than `below`."""
        parts, merges = self.parts, self.merges
        while True:
            if merges.get(left << 20 | right, below) < below:
                return False
            # Undo the younger of the two; of two equal ones the right one, since the left one is merged first.
            if left > right:
                if left < 256:
                    return True
                below = min(below, left)
                left = parts[left][1]
            else:
                if right < 256:
                    return True
                below = min(below, right + 1)
                right = parts[right][0]

    def _extend(self, raw: bytes, count: list[int], last: list[int]) -> None:
        """Carries the programme on from the prefix that `count` and `last` end with, to the whole of `raw`.

        The tokens that end at a place are found from their last byte on; one of them may follow the last token before it, and exactly one.
        """
        seams, endings = self.seams, self.endings
        for j in range(len(count) - 1, len(raw)):
            node, i = endings, j
            while True:
                node = node[raw[i]]
                if (token := node.get(-1)) is not None:
                    if not i:
                        break
                    pair = last[i] << 20 | token
                    fits = seams.get(pair)
                    if fits is None:
                        if len(seams) > 1_000_000:
                            seams.clear()
                        fits = seams[pair] = self.may_follow(last[i], token)
                    if fits:
                        break
                i -= 1
            count.append(count[i] + 1)
            last.append(token)

    def counts(self, raw: bytes) -> list[int]:
        """Token counts of the prefixes of one piece: 0 bytes, 1 byte and so on."""
        count, last = [0], [-1]
        self._extend(raw, count, last)
        return count

    def totals(self, pieces: list[bytes]) -> list[int]:
        """Token counts of pieces in order: what two neighbours begin with alike is worked out once."""
        out, count, last, before = [], [0], [-1], b""
        for raw in pieces:
            k, n = 0, min(len(before), len(raw))
            while k < n and before[k] == raw[k]:
                k += 1
            del count[k + 1 :], last[k + 1 :]
            self._extend(raw, count, last)
            out.append(count[-1])
            before = raw
        return out

    def _chunk(self, chunk: str) -> int:
        pieces = self.pieces
        if m := self.simple_re.fullmatch(chunk):
            word, end = m.groups()
            return pieces[word] + pieces[end] if end else pieces[word]
        return sum([pieces[p] for p in self.piece_re.findall(chunk)])

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        if self.special_re is not None and any(s in text for s in self.special):
            parts = self.special_re.split(text)
            return len(parts) // 2 + sum(self._whole(p) for p in parts[::2])
        return self._whole(text)

    def _whole(self, text: str) -> int:
        chunks = self.chunks
        cut = self.chunk_re if SEPARATORS.search(text) else self.fast_re
        return sum([chunks[c] for c in cut.findall(text)])

    def _word(self, word: str) -> int:
        """A word as `_words` marks it: after a blank, after a line break (0) or at the start of the text (1)."""
        if word[:1] == "\x00":
            return self.chunks["\n"] + (self._chunk(word[1:]) if len(word) > 1 else 0)
        return self._chunk(word[1:] if word[:1] == "\x01" else " " + word)

    def _of_distinct(self, words: pa.Array) -> np.ndarray:
        """Tokens of distinct marked words."""
        parts = pc.extract_regex(words, PLAIN)
        plain = pc.is_valid(parts).to_numpy(zero_copy_only=False)
        out = np.zeros(len(words), np.int64)
        rest = np.flatnonzero(~plain)
        memo = self.words
        out[rest] = [memo[w] for w in words.take(pa.array(rest)).to_pylist()]
        at = np.flatnonzero(plain)
        parts = parts.take(pa.array(at))
        letters, marks = pc.struct_field(parts, "letters").dictionary_encode(), pc.struct_field(parts, "marks").dictionary_encode()
        known, pieces = letters.dictionary.to_pylist(), self.pieces
        n = [pieces.seen(" " + w) for w in known]
        new = sorted((" " + known[i]).encode() for i, x in enumerate(n) if x is None)
        if new:
            found = dict(zip(new, self.totals(new), strict=True))
            for i, x in enumerate(n):
                if x is None:
                    piece = " " + known[i]
                    n[i] = pieces.keep(piece, found[piece.encode()])
        ends = [pieces[m] if m else 0 for m in marks.dictionary.to_pylist()]
        out[at] = np.array(n, np.int64)[letters.indices.to_numpy()] + np.array(ends, np.int64)[marks.indices.to_numpy()] if len(at) else 0
        return out

    def _words(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of texts that aren't odd: where each one's words start, the tokens of every word, and its characters in the text."""
        marked = pc.replace_substring(pc.binary_join_element_wise("\x01", texts, ""), "\n", " \x00")
        lists = pc.split_pattern(marked, " ")
        if isinstance(lists, pa.ChunkedArray):
            lists = lists.combine_chunks()
        found = pc.list_flatten(lists).dictionary_encode()
        at = found.indices.to_numpy()
        # In the text a blank or a line break stands before every word but the first.
        first = pc.starts_with(found.dictionary, "\x01").to_numpy(zero_copy_only=False)
        line = pc.starts_with(found.dictionary, "\x00").to_numpy(zero_copy_only=False)
        length = pc.utf8_length(found.dictionary).to_numpy() + (~first & ~line) - first.astype(np.int64)
        return lists.offsets.to_numpy(), self._of_distinct(found.dictionary)[at], length[at]

    def count_all(self, texts: pa.Array, budgets: tuple[int, ...] = ()) -> tuple[np.ndarray, list[np.ndarray]]:
        """Tokens of each text, and for each budget the characters of its longest prefix of at most so many tokens."""
        texts = pc.fill_null(texts, "")
        total = np.zeros(len(texts), np.int64)
        cuts = [pc.utf8_length(texts).to_numpy(zero_copy_only=False).astype(np.int64).copy() for _ in budgets]
        odd = pc.match_substring_regex(texts, self.odd).to_numpy(zero_copy_only=False)
        for i in np.flatnonzero(odd):
            text = texts[i].as_py()
            total[i] = self.count(text)
            for b, cut in zip(budgets, cuts, strict=True):
                if total[i] > b:
                    cut[i] = self.longest_prefix(text, b)
        rows = np.flatnonzero(~odd)
        if not len(rows):
            return total, cuts
        some = texts.take(pa.array(rows)) if len(rows) < len(texts) else texts
        starts, tokens, length = self._words(some)
        running, place = np.cumsum(tokens), np.cumsum(length)
        before = np.r_[0, running][starts]
        total[rows] = np.diff(before)
        for b, cut in zip(budgets, cuts, strict=True):
            for k in np.flatnonzero(total[rows] > b):
                first, last = starts[k], starts[k + 1]
                # The first word with which the budget is exceeded: the answer lies in it or just before it.
                w = int(np.searchsorted(running[first:last], before[k] + b, "right")) + first
                low, high = max(w - 2, first), min(w + 2, last)
                origin = place[first - 1] if first else 0
                begin, end = (place[low - 1] if low else 0) - origin, place[high - 1] - origin
                left = b - ((running[low - 1] if low else 0) - before[k])
                inside = self.prefix_counts(some[k].as_py()[begin:end])
                cut[rows[k]] = begin + max(i for i, n in enumerate(inside) if n <= left)
        return total, cuts

    def prefix_counts(self, text: str | None) -> list[int]:
        """The token count of every prefix of `text` by characters, the empty one first.

        A cut inside a run of white space or a contraction is cut into pieces as the library would cut that prefix.
        """
        out, done, base, tail = [0], 0, 0, ""
        for k, part in enumerate(self.special_re.split(text or "") if self.special_re is not None else [text or ""]):
            if k % 2:  # a prefix of a special string is ordinary text, read together with the end of the text before it
                out += [base + self._whole(tail + part[:i]) for i in range(1, len(part))] + [done + 1]
                done += 1
                continue
            chunks = self.chunk_re.findall(part)
            tail = "".join(chunks[-3:])
            base = done + sum(self.chunks[c] for c in chunks[:-3])
            run = None  # the white space just before this point: the counts of its prefixes, how many letters, the tokens before it
            for m in self.piece_re.finditer(part):
                piece = m.group()
                counts, at = self.counts(piece.encode()), 0
                if piece[0] in self.white and run is None:
                    stretch = self.white_re.match(part, m.start()).group()
                    ends = [0]
                    for c in stretch:
                        ends.append(ends[-1] + len(c.encode()))
                    all_ = self.counts(stretch.encode())
                    run, letters = [all_[e] for e in ends], 0
                    base_run = done
                for i, c in enumerate(piece, 1):
                    at += len(c.encode())
                    if c in self.white:  # a prefix that ends here takes the whole run as one piece
                        letters += 1
                        out.append(base_run + run[letters])
                    elif i == 2 and piece[0] == "'" and c.isalpha() and len(piece) > 2:  # half a contraction is no contraction
                        out.append(done + 1 + self.pieces[c])
                    else:
                        out.append(done + counts[at])
                done += counts[-1]
                if piece[-1] not in self.white:
                    run = None
        return out

    def longest_prefix(self, text: str, budget: int) -> int:
        """Characters of the longest prefix with at most `budget` tokens."""
        return max(i for i, n in enumerate(self.prefix_counts(text)) if n <= budget)


def loaded(path: str) -> PrefixCounter:
    return held(("prefixes", path), lambda: PrefixCounter(path))


def token_counts(docs: DataFrame, path: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",), budgets: tuple[int, ...] = (), batch: int = 8 << 20) -> DataFrame:
    """`keep` columns, `n_tokens` long of every whole text and, for each budget b, `cut_b` long: the characters of its longest
    prefix of at most b tokens.  A map without any shuffle.  batch: bytes of text that a worker counts at once; fewer take less memory."""
    names = [*keep, "n_tokens", *(f"cut_{b}" for b in budgets)]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = loaded(path)
        for rows in slices(batches, 4096, len(keep), batch):
            n, cuts = counter.count_all(rows.column(len(keep)), budgets)
            yield pa.RecordBatch.from_arrays([*rows.columns[: len(keep)], pa.array(n), *map(pa.array, cuts)], names=names)

    types = dict(docs.dtypes)
    schema = ", ".join([*(f"`{k}` {types[k]}" for k in keep), *(f"`{n}` long" for n in names[len(keep) :])])
    return docs.select(*keep, text).mapInArrow(work, schema)


def prefix_tables(docs: DataFrame, path: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """`keep` columns and `counts` array<int>: the tokens of every prefix of the text by characters, the empty prefix first."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = loaded(path)
        for batch in slices(batches, 256, len(keep)):
            out = [counter.prefix_counts(t) for t in batch.column(len(keep)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(out, pa.list_(pa.int32()))], names=[*keep, "counts"])

    types = dict(docs.dtypes)
    return docs.select(*keep, text).mapInArrow(work, ", ".join([*(f"`{k}` {types[k]}" for k in keep), "counts array<int>"]))


def longest_within(counts: Column, budget: int) -> Column:
    """Characters of the longest prefix of at most `budget` tokens, from a stored table of prefix counts; native."""
    fits = F.transform(F.reverse(counts), lambda n: n <= budget)
    return (F.size(counts) - F.array_position(fits, True)).cast("long")

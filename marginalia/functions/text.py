"""Text functions as Column expressions: nothing here runs Python on executors."""

from __future__ import annotations

import re
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from marginalia.functions import fixed as X

_WORD = "[A-Za-z0-9_]"


def _alternatives(pattern: str, start: int, end: int) -> list[tuple[int, int]]:
    """The top-level alternatives of pattern[start:end] as (start, end)."""
    out, depth, begin, i, inside = [], 0, start, start, False
    while i < end:
        c = pattern[i]
        if c == "\\":
            i += 1
        elif inside:
            inside = c != "]"
        elif c == "[":
            inside = True
        elif c in "()":
            depth += 1 if c == "(" else -1
        elif c == "|" and depth == 0:
            out.append((begin, i))
            begin = i + 1
        i += 1
    return [*out, (begin, end)]


def _elements(pattern: str, start: int, end: int) -> list[tuple[int, int, bool]]:
    """The elements of one alternative as (start, end, may be absent); end is before the quantifier."""
    out, i = [], start
    while i < end:
        begin = i
        if pattern[i] == "\\":
            i += 2
        elif pattern[i] == "[":
            i += 2  # a first ] stands for itself
            while pattern[i] != "]":
                i += 2 if pattern[i] == "\\" else 1
            i += 1
        elif pattern[i] == "(":
            depth = 0
            while True:
                c = pattern[i]
                if c == "\\":
                    i += 1
                elif c == "[":
                    while pattern[i] != "]":
                        i += 2 if pattern[i] == "\\" else 1
                elif c in "()":
                    depth += 1 if c == "(" else -1
                i += 1
                if depth == 0:
                    break
        else:
            i += 1
        stop, absent = i, False
        while i < end and pattern[i] in "*+?{":
            absent |= pattern[i] in "*?" and i == stop or pattern[i : i + 2] == "{0"
            i = pattern.index("}", i) + 1 if pattern[i] == "{" else i + 1
        out.append((begin, stop, absent))
    return out


def _is_word(pattern: str, start: int, end: int, last: bool) -> bool:
    """Whether all that an element can match begins (or ends, `last`) with a word character."""
    text = pattern[start:end]
    if text.startswith("("):
        inner = start + (3 if text.startswith("(?:") else 1)
        if text.startswith("(?") and not text.startswith("(?:"):
            return False
        return all(_edge(pattern, a, b, last) for a, b in _alternatives(pattern, inner, end - 1))
    if text.startswith("["):
        return re.fullmatch(r"\[(?:[A-Za-z0-9_]-[A-Za-z0-9_]|[A-Za-z0-9_]|\\d|\\w)+\]", text) is not None
    return text in (r"\d", r"\w") or re.fullmatch("[A-Za-z0-9_]", text) is not None


def _edge(pattern: str, start: int, end: int, last: bool) -> bool:
    found = _elements(pattern, start, end)
    for a, b, absent in reversed(found) if last else found:
        if pattern[a:b] == r"\b" or not _is_word(pattern, a, b, last):
            return False
        if not absent:
            return True
    return False


@cache
def java(pattern: str) -> str:
    r"""A pattern of the shared dialect for Java: \b by ASCII word characters, $ at the very end only.

    Where what stands beside a \b begins or ends with a word character anyway, one lookaround is enough.
    """
    out, i, inside = [], 0, False
    while i < len(pattern):
        c = pattern[i]
        if c == "\\":
            pair = pattern[i : i + 2]
            out.append(_boundary(pattern, i) if pair == r"\b" and not inside else pair)
            i += 2
            continue
        if c == "[":
            inside = True
        elif c == "]":
            inside = False
        out.append(r"\z" if c == "$" and not inside else c)
        i += 1
    return "".join(out)


def _boundary(pattern: str, at: int) -> str:
    """What a \\b at a place of a pattern is in Java."""
    flags = len("(?i)") if pattern.startswith(("(?i)", "(?s)")) else 0
    spans, span = [(flags, len(pattern))], None
    while spans:  # the innermost alternative that holds the place
        a, b = spans.pop()
        for x, y in _alternatives(pattern, a, b):
            if x <= at < y:
                span = x, y
                for p, q, _ in _elements(pattern, x, y):
                    if p < at < q and pattern[p] == "(":
                        spans = [(p + (3 if pattern[p : p + 3] == "(?:" else 1), q - 1)]
    found = _elements(pattern, *span)
    k = next(i for i, e in enumerate(found) if e[0] == at)

    def beside(part: list, last: bool) -> bool:
        for a, b, absent in part:
            if not _is_word(pattern, a, b, last):
                return False
            if not absent:
                return True
        return False

    if beside(found[k + 1 :], False):
        return f"(?<!{_WORD})"
    if beside(found[:k][::-1], True):
        return f"(?!{_WORD})"
    return f"(?:(?<={_WORD})(?!{_WORD})|(?<!{_WORD})(?={_WORD}))"


def matches(text: Column, pattern: str) -> Column:
    return text.rlike(java(pattern))


def extract(text: Column, pattern: str, group: int = 1) -> Column:
    """A group of the first match, null where nothing matches."""
    p = java(pattern)
    return F.when(text.rlike(p), F.regexp_extract(text, p, group))


def words_in(values) -> Column:
    return F.array(*[F.lit(v) for v in values])


def let(value: Column, body) -> Column:
    """`body` of `value`, which is evaluated once however often the body names it."""
    return F.transform(F.array(value), body)[0]


def let_all(then, /, **values: Column) -> Column:
    """`then` of a struct of the values, each evaluated once."""
    return let(F.struct(*[v.alias(k) for k, v in values.items()]), then)


def tokenize(text: Column) -> Column:
    """Lower-case ASCII tokens of letters, digits, + # and inner dots; possessives removed."""
    flat = F.regexp_replace(F.lower(text), java(r"['’]s\b"), "")
    parts = F.transform(F.split(flat, "[^a-z0-9+#.]+"), lambda t: F.regexp_replace(t, r"^\.+|\.+\z", ""))
    return F.array_remove(parts, "")


def is_content(token: Column) -> Column:
    """Three letters at least, no stop word, no bare number."""
    return (F.length(token) >= 3) & ~token.isin(X.STOPWORDS) & ~token.rlike(r"^[0-9]+\z")


def content_tokens(text: Column) -> Column:
    return F.filter(tokenize(text), is_content)


def stem(word: Column) -> Column:
    """The first suffix of the list that leaves three letters goes, then a final e; short words stay."""
    return let(F.lower(word), _stem)


def _stem(low: Column) -> Column:
    cut = F.when(F.length(low) <= 4, low)
    for s in X.SUFFIXES:
        cut = cut.when(low.endswith(s) & (F.length(low) >= len(s) + 3), F.substring(low, F.lit(1), F.length(low) - len(s)))
    cut = cut.otherwise(low)
    return let(cut, lambda c: F.when((F.length(low) > 4) & c.endswith("e") & (F.length(c) > 4), F.substring(c, F.lit(1), F.length(c) - 1)).otherwise(c))


def stem_tokens(text: Column) -> Column:
    return F.transform(content_tokens(text), stem)


def normalize_key(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " "))


def strip(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+\z", "")


def word_count(text: Column) -> Column:
    flat = strip(text)
    return F.when(flat == "", 0).otherwise(F.size(F.split(flat, r"\s+")))


def split_sentences(text: Column) -> Column:
    """Sentences; a part that ends in a known abbreviation or a number and a dot runs on into the next."""
    flat = strip(F.regexp_replace(text, r"\s+", " "))
    return let(F.split(flat, r"(?<=[.!?])\s+"), _joined)


def _joined(parts: Column) -> Column:
    runs_on = lambda s: matches(s, X.ABBREVIATION) | s.rlike(r"[0-9]\.\z")
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open"))

    def step(acc: Column, part: Column) -> Column:
        joined = F.when(acc["open"] == "", part).otherwise(F.concat(acc["open"], F.lit(" "), part))
        more = F.struct(acc["done"].alias("done"), joined.alias("open"))
        shut = F.struct(F.array_append(acc["done"], strip(joined)).alias("done"), F.lit("").alias("open"))
        return F.when(runs_on(joined), more).otherwise(shut)

    folded = F.aggregate(parts, start, step, lambda a: F.when(F.trim(a["open"]) == "", a["done"]).otherwise(F.array_append(a["done"], F.trim(a["open"]))))
    # Texts in which nothing runs on need no fold.
    plain = F.transform(parts, strip)
    return F.array_remove(F.when(F.exists(parts, runs_on), folded).otherwise(plain), "")


def overlap(left: Column, right: Column) -> Column:
    """Jaccard overlap of two arrays of content tokens; 0 if one is empty."""
    shared = F.size(F.array_intersect(left, right))
    both = F.size(F.array_union(left, right))
    return F.coalesce(F.when((F.size(left) > 0) & (F.size(right) > 0), shared / both), F.lit(0.0))


def says_the_same(key_a: Column, tokens_a: Column, key_b: Column, tokens_b: Column) -> Column:
    return (key_a == key_b) | (overlap(tokens_a, tokens_b) >= X.SAME_MEANING)


def unpunctuated(text: Column) -> Column:
    return strip(F.regexp_replace(strip(text), r"[.;,]+\z", ""))


def clamp_words(text: Column, most: int) -> Column:
    return let(strip(text), lambda flat: let(F.split(flat, r"\s+"), lambda words: _clamped(flat, words, most)))


def _clamped(flat: Column, words: Column, most: int) -> Column:
    cut = F.regexp_replace(F.array_join(F.slice(words, 1, most), " "), r"[,;:]\z", "")
    return F.when(F.size(words) <= most, flat).otherwise(F.concat(cut, F.lit("...")))


def shorten(text: Column, most: int) -> Column:
    """At most `most` words without an ellipsis, cut at the last comma or dash of the second half, not ending on a function word."""

    def cut(a: Column) -> Column:
        head = F.array_join(F.slice(a["words"], 1, most), " ")
        last = lambda h, mark: F.length(h) - F.coalesce(F.length(F.substring_index(h, mark, -1)), F.length(h)) - len(mark)
        at = lambda h: F.greatest(*[F.when(h.contains(m), last(h, m)).otherwise(-1) for m in (",", " - ", ";")])
        kept = let(head, lambda h: F.when(at(h) > F.length(h) * 0.5, F.substring(h, F.lit(1), at(h))).otherwise(h))
        whole = lambda ws: F.filter(F.sequence(F.size(ws), F.lit(1), F.lit(-1)), lambda n: (n <= 2) | ~reads_as_fragment(F.array_join(F.slice(ws, F.lit(1), n), " ")))[0]
        fit = let(F.split(kept, r"\s+"), lambda ws: unpunctuated(F.array_join(F.slice(ws, F.lit(1), whole(ws)), " ")))
        return F.when(F.size(a["words"]) <= most, a["flat"]).otherwise(fit)

    return let(unpunctuated(text), lambda flat: let_all(cut, flat=flat, words=F.split(flat, r"\s+")))


def sentence_case(text: Column) -> Column:
    flat = strip(text)
    return F.concat(F.upper(F.substring(flat, 1, 1)), F.substring(flat, F.lit(2), F.length(flat)))


def decapitalize(text: Column) -> Column:
    flat = strip(text)
    first = F.regexp_extract(flat, r"^\S*", 0)
    keeps = ((F.length(first) > 1) & (first == F.upper(first))) | first.rlike("^[A-Z][a-z]+[A-Z]")
    return F.when(keeps, flat).otherwise(F.concat(F.lower(F.substring(flat, 1, 1)), F.substring(flat, F.lit(2), F.length(flat))))


def reads_as_fragment(text: Column) -> Column:
    return let(unpunctuated(text), lambda flat: (flat == "") | (word_count(flat) < 2) | matches(flat, X.DANGLING))


def speak_list(items: Column) -> Column:
    """a, b and c"""
    clean = F.filter(F.transform(items, lambda x: F.trim(x)), lambda x: x != "")
    head = F.array_join(F.slice(clean, F.lit(1), F.greatest(F.size(clean) - 1, F.lit(0))), ", ")
    return F.when(F.size(clean) == 0, "").when(F.size(clean) == 1, clean[0]).otherwise(F.concat(head, F.lit(" and "), F.element_at(clean, -1)))


def spell_count(n: Column) -> Column:
    return F.coalesce(F.get(words_in(X.SPELLED), n), n.cast("string"))


def read_commitment(text: Column) -> Column:
    return F.when(matches(text, X.CONSIDERED), "considered").when(matches(text, X.COMMITTED) | matches(strip(text), X.IMPERATIVE), "committed").otherwise("considered")


def infer_readiness(text: Column, checked: Column | None = None) -> Column:
    done = matches(text, X.FINISHED) if checked is None else F.coalesce(checked, F.lit(False)) | matches(text, X.FINISHED)
    return F.when(done, "done").when(matches(text, X.READY), "ready").when(matches(text, X.CONSIDERED), "suggested").otherwise("pending")


def title_words(column: Column) -> Column:
    return F.concat(F.upper(F.substring(column, 1, 1)), F.lower(F.substring(column, F.lit(2), F.length(column))))

"""Operator 5: quality rules, native.

The threshold table RULES is compiled into one projection of length, symbol, stop-word and line ratios; only built-in SQL
functions run.  Repeated windows: the windows of a text are hashed (XXH64 over their words); texts without an equal pair
are done, the others sort (hash, place) pairs, so a long text costs n log n.

Defined cases: a null text has no words; no words: all counts 0, ratios null, a null ratio passes its rule, and the base
rule fails; repeated rows stay; very long texts are read whole; other columns pass through unless a result column takes their name;
an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginalia.llm.common import SPACES, free_name

SYMBOLS = "#*$%&|<>"
#: Common function words of English, German, French and Spanish.
STOP_WORDS = (
    "the and of to a in is it that for on with as was at by be this from are or an he "
    "der die das und ist nicht mit den von zu ein eine auf für im dem des auch sich "
    "le la les des et un une du en est que qui dans pour pas sur au par il elle "
    "el los las y de que en un una por con para es se no su al del lo como"
).split()
#: rule, ratio, least, most
RULES = (
    ("words", "n_words", 20, None),
    ("word_length", "word_chars / n_words", 1.5, 25.0),
    ("symbols", "n_symbols / n_words", None, 0.35),
    ("stop_words", "n_stop_words / n_words", 0.02, None),
    ("dup_lines", "n_dup_lines / n_lines", None, 0.6),
)
#: Words of a window, and the percentage of repeated words that fails a text.
WINDOW, REPEATED = 8, 30


def counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """`docs` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_stop_words and n_lines (long)."""
    t = F.coalesce(F.col(text), F.lit(""))
    words = F.array_remove(F.split(F.translate(t, SPACES, " " * len(SPACES)), " "), "")
    lines = F.filter(F.split(t, "\n"), lambda x: F.length(F.trim(F.translate(x, SPACES, " " * len(SPACES)))) > 0)
    words_, lines_, hashes_ = (free_name(docs, x) for x in ("_words", "_lines", "_hashes"))
    step = docs.withColumns({words_: words, lines_: lines})
    last = F.size(words_) - (WINDOW - 1)
    hashes = F.when(last > 1, F.transform(F.sequence(F.lit(1), last), lambda i: F.xxhash64(F.slice(words_, i, WINDOW)))).otherwise(F.array().cast("array<bigint>"))
    step = step.withColumn(hashes_, hashes)
    pairs = F.array_sort(F.transform(hashes_, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    # array_sort of structs goes by hash, then place; a place is repeated if a neighbour has its hash.
    twice = lambda p: F.transform(F.filter(p, lambda x, k: (F.get(p, k - 1)["h"] == x["h"]) | F.coalesce(F.get(p, k + 1)["h"] == x["h"], F.lit(False))), lambda x: x["i"])
    covered = lambda at: F.aggregate(at, F.struct(F.lit(0).cast("long").alias("n"), F.lit(-WINDOW).alias("last")), lambda s, x: F.struct((s["n"] + F.least(F.lit(WINDOW), x - s["last"])).alias("n"), x.alias("last")))["n"]
    let = lambda value, body: F.transform(F.array(value), body)[0]  # noqa: E731  evaluates `value` once
    repeated = F.when(F.size(F.array_distinct(hashes_)) == F.size(hashes_), F.lit(0).cast("long")).otherwise(let(let(pairs, lambda p: F.array_sort(twice(p))), covered))
    out = {
        "n_words": F.size(words_),
        "word_chars": F.length(F.translate(t, SPACES, "")),
        "n_symbols": F.length(t) - F.length(F.translate(t, SYMBOLS, "")),
        "n_dup_lines": F.size(lines_) - F.size(F.array_distinct(lines_)),
        "n_repeat_words": repeated,
        "n_stop_words": F.size(F.filter(words_, lambda w: F.lower(w).isin(STOP_WORDS))),
        "n_lines": F.size(lines_),
    }
    return step.withColumns({k: v.cast("long") for k, v in out.items()}).drop(words_, lines_, hashes_)


def verdict(rules=RULES) -> Column:
    """The rules as one boolean; a ratio that is null (no words) passes."""
    keep = F.lit(True)
    for _, ratio, least, most in rules:
        if least is not None:
            keep &= F.coalesce(F.expr(ratio) >= least, F.lit(True))
        if most is not None:
            keep &= F.coalesce(F.expr(ratio) <= most, F.lit(True))
    return keep


def judged(docs: DataFrame, text: str = "text", rules=RULES) -> DataFrame:
    """`counts` with base_failed and kept."""
    failed = F.expr(f"n_words < 20 or 100 * n_repeat_words > {REPEATED} * n_words")
    nonzero = [(name, ratio.replace("/ n_words", "/ nullif(n_words, 0)").replace("/ n_lines", "/ nullif(n_lines, 0)"), a, b) for name, ratio, a, b in rules]
    return counts(docs, text).withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & verdict(nonzero))


#: The same for DuckDB, over the view documents.
ORACLE = rf"""
with d as (select doc_id, coalesce(text, '') as t from documents),
w as (select doc_id, t, list_filter(regexp_split_to_array(t, '[ \t\n\x0b\f\r]+'), lambda x: x <> '') as ws,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^ \t\n\x0b\f\r]')) as ls from d),
g as (select doc_id, i, hash_of from (select doc_id, unnest(range(1, len(ws) - 6)) as i, ws from w where len(ws) >= 8) x,
             lateral (select array_to_string(ws[i:i + 7], ' ') as hash_of)),
r as (select doc_id, i from (select doc_id, i, count(*) over (partition by doc_id, hash_of) as c from g) where c > 1),
p as (select doc_id, count(distinct i + k) as n from r, (select unnest(range(0, 8)) as k) group by doc_id),
c as (select w.doc_id, len(ws) as n_words, length(regexp_replace(t, '[ \t\n\x0b\f\r]+', '', 'g')) as word_chars,
             length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) as n_symbols,
             len(ls) - len(list_distinct(ls)) as n_dup_lines, coalesce(p.n, 0) as n_repeat_words, len(ls) as n_lines,
             len(list_filter(ws, lambda x: lower(x) in ({", ".join(f"'{s}'" for s in dict.fromkeys(STOP_WORDS))}))) as n_stop_words
      from w left join p using (doc_id)),
f as (select *, n_words < 20 or 100 * n_repeat_words > {REPEATED} * n_words as base_failed from c)
select doc_id, cast(n_words as bigint) as n_words, cast(word_chars as bigint) as word_chars, cast(n_symbols as bigint) as n_symbols,
       cast(n_dup_lines as bigint) as n_dup_lines, cast(n_repeat_words as bigint) as n_repeat_words, base_failed,
       not base_failed and {" and ".join(f"coalesce({r.replace('/ n_words', '/ nullif(n_words, 0)').replace('/ n_lines', '/ nullif(n_lines, 0)')} {op} {v}, true)" for _, r, a, b in RULES for op, v in ((">=", a), ("<=", b)) if v is not None)} as kept
from f"""

"""Notes on the customers of the given tables, as the documents with structure that prose without headings never reaches.

One note for each customer, of a form that its key decides: plan, review, invoice, paper, trip, a blank text, JSON, or none.  Names, dates and
amounts are the customer's; every one of its orders adds a line to each list, so the notes grow with the tables.
"""

from __future__ import annotations

import json
import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PLAN = """# {name} rollout plan

The {segment} rollout is a staged programme designed to move ticketing of {nation} to the new gates. As of {day}.

## Key metrics
- Gate throughput: 1,450 per hour (up 12%)
- Account value: {balance} EUR (up 2%)
{worths}
- Refund rate: 3.1% (down 0.4 pts)
- Uptime: 99.95%
- How many gates stay manual after launch?
- Queue time at gates (target: under 4 minutes)

## Decisions
- D-1 Keep manual gates at the north pier - approved
- D-2 Consider leasing spare gate readers (requested)
- Never run gate firmware updates during ferry boarding
- Redis
- Order volume cannot be reduced below the received volume
- Note: only when a lease is open
| Carrier details | Y | N | N | Carrier name cannot be edited |
| Ship date | Y | Y | N | |
| Colour | Y | Y | N | Shown on paper |
Delivery place Y N - agreed with the pier
{choices}

## Timeline
- Phase 1: Survey every gate at the north pier - done
- Phase 2: Install gate readers - planned
- Q3 2026: Public launch of the gate programme - scheduled
- Due date: 2026-09-30
- Ship the refund desk next week
{steps}

## Risks
- Late gate readers delay the ferry launch (high) - mitigation: lease spare gate readers
- Staff gaps at the north pier [low]: Train two more pier teams
{dangers}

## Next steps
- [ ] Sign the gate reader lease - Mara Holt - Aug 15
- [x] Survey the north pier gates (Jon Reed, Mar 3)
- Train pier teams - Ana Silva - 2026-05-01
{tasks}
"""
REVIEW = """Slide 1 — Problem
====

Support queues of {name} grew because the refund form fails on old phones.
If the form is slow, then customers call the support desk.
Mobile forms beat desk forms for refunds.

| Metric | Value | Change |
| --- | --- | --- |
| Refund calls | 812 | up 9% |
| Form errors | 4.2% | down |
| Balance | ${balance} | up |

1. Rebuild the refund form
2. Measure form errors every week
3. Close the old form
{numbered}

Open questions
--------------
- Should the desk keep paper forms?

<!-- page:2 -->
Results
The team will retire the old form so that errors fall.
We could move refunds to chat.
"""
INVOICE = """# Invoice number {key}

Bill to: {name} ({nation})
Dated: 2026-07-15
Due date: {day}
Payment terms: net 30

| Line item | Qty | Unit price |
| --- | --- | --- |
| Gate reader | 4 | $310.00 |
| Fitting | 4 | $75.50 |
{items}

Total amount due: ${balance}
VAT: 20%
"""
PAPER = """# Adaptive gates of {nation} under load

## Abstract
We study adaptive ferry gates. Adaptive gates cut waiting time by 18% in our experiments [3].

## Method
The dataset holds {orders} days of gate logs of {segment} (Silva et al., 2024). We compare fixed and adaptive gates.

## Results
Adaptive gates reach 93.5% accuracy against 88.1% for fixed gates.

## Discussion
However, the results are limited to one pier. Future work should test more piers.

## References
[3] Gate studies.
"""
TRIP = """Itinerary

Departure: {nation} (AAR) · {day} 09:40 · Gate B12
Arrival: Oslo (OSL) · 2026-08-12 11:05
✓ Passport packed
→ Hotel from 12/08/2026

{steps}

***
As a traveller, I want one page with every booking.
User story: I want gate changes on my phone
"""

JSON = '{"version": 1, "title": "{name}", "blocks": []}'
#: By the remainder of the customer's key: label and text.
FORMS = (("plans/{key}.md", PLAN), ("review {key}.txt", REVIEW), ("C:\\files\\invoice<{key}>.md", INVOICE), ("paper.md", PAPER), ("", TRIP), ("empty.txt", " \n "), ("data.json", JSON), (None, None))
#: What one order adds to each list: a line before its values, between and after them; {o}: its key, {d}: its date, {p}: its total, {s}: its state.
LINES = {
    "worths": "- Order {o}: {p} EUR (up 3%)",
    "choices": "- D-{o} Keep the terms of order {o} - {a}",
    "steps": "- {d}: Order {o} of {n} leaves the pier - {s}",
    "dangers": "- Order {o} of {n} slips past its date ({g}) - mitigation: split the delivery",
    "tasks": "- [{x}] Ship order {o} - Desk {n} - {d}",
    "numbered": "{o}. Check the papers of order {o}",
    "items": "| Order {o} | 1 | ${p} |",
}
STATES, GRADES, ANSWERS, MARKS = ({"F": "done", "O": "planned", "P": "in progress"}, {"1-URGENT": "high", "2-HIGH": "medium"}, {"F": "approved", "O": "requested"}, {"F": "x"})
OTHERS = ("planned", "low", "rejected", " ")


def _chosen(value: Column, of: dict[str, str], other: str) -> Column:
    return reduce(lambda out, kv: F.when(value == kv[0], kv[1]).otherwise(out), of.items(), F.lit(other))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, label, raw)"""
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    o, customers, nations = read("orders"), read("customer"), read("nation")
    filled = lambda text, values: reduce(lambda t, kv: F.replace(t, F.lit("{" + kv[0] + "}"), kv[1]), values.items(), text)
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    own = customers.join(nations, customers["c_nationkey"] == nations["n_nationkey"]).select("c_custkey", "c_name", "n_name", "c_mktsegment", "c_acctbal")
    rows = own.join(o, own["c_custkey"] == o["o_custkey"], "left")
    values = {
        "o": F.col("o_orderkey").cast("string"), "d": day, "p": F.format_string("%.2f", "o_totalprice"), "n": F.col("n_name"), "s": _chosen(F.col("o_orderstatus"), STATES, OTHERS[0]),
        "g": _chosen(F.col("o_orderpriority"), GRADES, OTHERS[1]), "a": _chosen(F.col("o_orderstatus"), ANSWERS, OTHERS[2]), "x": _chosen(F.col("o_orderstatus"), MARKS, OTHERS[3]),
    }
    # Only lists that the customer's form shows are made, of their parts; a nation that itself holds a mark takes the long way, which fills marks in turn.
    odd = F.coalesce(F.col("n_name").contains("{"), F.lit(False))
    shown = lambda name: (F.col("c_custkey") % len(FORMS)).isin([k for k, f in enumerate(FORMS) if "{" + name + "}" in (f[0] or "") + (f[1] or "")])
    parts = lambda line: F.concat(*[values[x] if i % 2 else F.lit(x) for i, x in enumerate(re.split(r"\{(\w)\}", line))])
    made = lambda line: F.when(odd, filled(F.lit(line), values)).otherwise(parts(line)).alias("line")
    ordered = lambda name, line: F.array_sort(F.collect_list(F.when(F.col("o_orderkey").isNotNull() & (odd | shown(name)), F.struct("o_orderdate", "o_orderkey", made(line)))))
    joined = {name: F.array_join(F.transform(ordered(name, line), lambda x: x["line"]), "\n").alias(name) for name, line in LINES.items()}
    rows = rows.groupBy("c_custkey", "c_name", "n_name", "c_mktsegment", "c_acctbal").agg(*joined.values(), F.coalesce(F.max(day), F.lit("2026-03-02")).alias("day"), F.count("o_orderkey").cast("string").alias("orders"))
    whole = {"key": F.col("c_custkey").cast("string"), "name": F.col("c_name"), "nation": F.col("n_name"), "segment": F.lower("c_mktsegment"), "balance": F.format_string("%.2f", "c_acctbal"), "day": F.col("day"), "orders": F.col("orders")} | {n: F.col(n) for n in LINES}
    form = lambda i: F.element_at(F.array(*[F.lit(f[i]) for f in FORMS]), (F.col("c_custkey") % len(FORMS) + 1).cast("int"))
    return rows.select(F.col("c_custkey").cast("long").alias("doc_id"), filled(form(0), whole).alias("label"), filled(form(1), whole).alias("raw"))


def _sql(value: str | None) -> str:
    return "null" if value is None else "'" + value.replace("'", "''") + "'"


def _filled(text: str, values: dict[str, str]) -> str:
    return reduce(lambda t, kv: f"replace({t}, '{{{kv[0]}}}', {kv[1]})", values.items(), text)


def _case(value: str, of: dict[str, str], other: str) -> str:
    return f"case {value} " + " ".join(f"when '{k}' then '{v}'" for k, v in of.items()) + f" else '{other}' end"


_VALUES = {"o": "o_orderkey::varchar", "d": "strftime(o_orderdate, '%Y-%m-%d')", "p": "printf('%.2f', o_totalprice)", "n": "n_name", "s": _case("o_orderstatus", STATES, OTHERS[0]), "g": _case("o_orderpriority", GRADES, OTHERS[1]), "a": _case("o_orderstatus", ANSWERS, OTHERS[2]), "x": _case("o_orderstatus", MARKS, OTHERS[3])}
_WHOLE = {"key": "c_custkey::varchar", "name": "c_name", "nation": "n_name", "segment": "lower(c_mktsegment)", "balance": "printf('%.2f', c_acctbal)", "day": "day", "orders": "orders"} | {n: n for n in LINES}
_FORM = lambda i: "case c_custkey % " + str(len(FORMS)) + " " + " ".join(f"when {k} then {_sql(f[i])}" for k, f in enumerate(FORMS)) + " end"
#: The same notes for DuckDB, and their lines.
DOCUMENTS_SQL = (
    "note_rows as (select c_custkey, c_name, n_name, c_mktsegment, c_acctbal, "
    + ", ".join(f"coalesce(string_agg(case when o_orderkey is not null then {_filled(_sql(line), _VALUES)} end, chr(10) order by o_orderdate, o_orderkey), '') as {name}" for name, line in LINES.items())
    + ", coalesce(max(strftime(o_orderdate, '%Y-%m-%d')), '2026-03-02') as day, count(o_orderkey)::varchar as orders from customer join nation on n_nationkey = c_nationkey left join orders on o_custkey = c_custkey group by all), "
    + f"fixture as (select c_custkey as doc_id, {_filled(_FORM(0), _WHOLE)} as label, {_filled(_FORM(1), _WHOLE)} as raw from note_rows)"
)
LINES_SQL = DOCUMENTS_SQL + ", fixture_lines as (select doc_id, unnest(range(1, len(ls) + 1)) as line_no, unnest(ls) as line from (select doc_id, string_split(coalesce(raw, ''), chr(10)) as ls from fixture))"


# --- remarks: what is told of every supplier --------------------------------------------------------------------------------
#: The word of a remark that gives way to the supplier's nation.
PLACE = "pier"


def told(spark: SparkSession, sf_dir: str, rows, schema: str) -> DataFrame:
    """`rows` of every supplier: the first column, a number below 1 000, becomes supplier * 1 000 + number, PLACE in texts becomes its nation."""
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    kinds = dict(c.strip().rsplit(" ", 1) for c in schema.split(", "))
    suppliers = read("supplier").join(read("nation"), F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", F.lower("n_name").alias("_place"))
    each = F.from_json(F.lit(json.dumps([dict(zip(kinds, r, strict=True)) for r in rows], ensure_ascii=False)), f"array<struct<{', '.join(f'`{n}`: {k}' for n, k in kinds.items())}>>")
    # The table is one small file, what is told of it is not: by a stated number, which adaptive execution doesn't coalesce.
    suppliers = suppliers.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "s_suppkey")
    out = suppliers.select("s_suppkey", "_place", F.inline(each))
    first = next(iter(kinds))
    values = {n: F.replace(F.col(f"`{n}`"), F.lit(PLACE), F.col("_place")) if k == "string" else F.col(f"`{n}`") for n, k in kinds.items()}
    values[first] = (F.col("s_suppkey") * 1000 + F.col(first)).cast(kinds[first])
    return out.select(*[v.alias(n) for n, v in values.items()])


def told_sql(name: str, columns: str, rows) -> str:
    """The same remarks for DuckDB."""
    rows, names = list(rows), [c.strip() for c in columns.split(",")]
    quoted = lambda v: "null" if v is None else str(v).lower() if isinstance(v, bool | int) else f"cast({v} as double)" if isinstance(v, float) else _sql(v)
    texts = {n for i, n in enumerate(names) if any(isinstance(r[i], str) for r in rows)}
    shown = [f"cast(s_suppkey * 1000 + {n} as int) as {n}" if not i else f"replace({n}, '{PLACE}', lower(n_name)) as {n}" if n in texts else n for i, n in enumerate(names)]
    return f"{name} as (select {', '.join(shown)} from supplier join nation on s_nationkey = n_nationkey, (values " + ", ".join("(" + ", ".join(map(quoted, r)) + ")" for r in rows) + f") _v({', '.join(names)}))"

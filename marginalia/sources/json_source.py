"""Strict JSON import, canonical JSON and document hashes.

The shape of a source is {version: 1, title, blocks: [{kind, title?, payload}], relations?, archetype?}.  A document is imported
whole or not at all: the first stage with errors returns all of its own.  The recursive walks (safety, canonical form) are the only
parts without built-in functions; they run as Arrow-batched pandas functions over whole texts.
"""

from __future__ import annotations

import json
import math
import re
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from marginalia.functions import fixed as X
from marginalia.functions.text import let, strip

# --- fixed values: limits, unsafe keys, and the fields of the strict source: name, whether required, longest, allowed words --
MAX_DEPTH, MAX_ITEMS, MAX_RELATIONS, MAX_EXCERPT = 12, 100, 400, 240
UNSAFE = ("__proto__", "prototype", "constructor")
RELATIONS = ("informs", "supports", "motivates", "mitigates", "causes", "depends_on", "blocks", "implements", "schedules", "threatens", "frames", "unblocks")
SNAPSHOT = {"heading": (True, 2000, None), "summary": (True, 2000, None), "hook": (False, 300, None), "goal": (False, 2000, None), "problem": (False, 2000, None), "outcome": (False, 2000, None), "byline": (False, 240, None)}
ENTRIES = {
    "signals": {"label": (True, 120, None), "value": (False, 120, "number"), "delta": (False, 120, "number"), "trend": (False, 0, ("up", "flat", "down")), "implication": (False, 2000, None)},
    "decisions": {"ref": (False, 40, None), "text": (True, 2000, None), "status": (True, 0, ("approved", "requested", "proposed", "rejected")), "commitment": (False, 0, ("committed", "considered")), "because": (False, 2000, None)},
    "timeline": {"date": (True, 80, None), "title": (True, 2000, None), "state": (True, 0, ("shipped", "on-track", "planned", "done")), "produces": (False, 240, None), "requires": (False, 240, None)},
    "risks": {"risk": (True, 2000, None), "severity": (False, 0, ("high", "medium", "low")), "mitigation": (False, 2000, None), "because": (False, 2000, None), "consequence": (False, 2000, None)},
    "actions": {"task": (True, 2000, None), "owner": (False, 120, None), "due": (False, 80, None), "status": (True, 0, ("pending", "suggested", "ready", "done")), "from": (False, 2000, None)},
}
REFERENCE = re.compile(r"(?:snapshot|signals|decisions|timeline|risks|actions)(?::\d{1,3})?")
# -----------------------------------------------------------------------------------------------------------------------

DIAGNOSTIC = T.StructType([T.StructField("code", T.StringType()), T.StructField("path", T.StringType()), T.StructField("line", T.IntegerType()), T.StructField("column", T.IntegerType())])
CHECKED = T.StructType([T.StructField("errors", T.ArrayType(DIAGNOSTIC)), T.StructField("rewritten", T.IntegerType()), T.StructField("source", T.StringType())])


def joined(path: str, key: str) -> str:
    return f"{path}.{key}" if re.fullmatch(r"[A-Za-z_$][A-Za-z0-9_$]*", key, re.ASCII) else f"{path}[{json.dumps(key, ensure_ascii=False)}]"


def unsafe(value, path: str = "$", depth: int = 0) -> list[tuple[str, str]]:
    """Too deep, too many entries, unsafe keys: every one with its path."""
    if depth > MAX_DEPTH:
        return [("input.too-deep", path)]
    out = []
    if isinstance(value, list):
        if len(value) > MAX_ITEMS:
            out.append(("input.too-many-entries", path))
        for i, x in enumerate(value):
            out += unsafe(x, f"{path}[{i}]", depth + 1)
    elif isinstance(value, dict):
        for k, x in value.items():
            out += [("input.unsafe-key", joined(path, k))] if k in UNSAFE else unsafe(x, joined(path, k), depth + 1)
    return out


def migrated(root: dict) -> int:
    """Rewrites the old status "open" of entries to "pending" in place; how many there were."""
    n = 0
    blocks = root.get("blocks")
    for block in blocks if isinstance(blocks, list) else []:
        payload = block.get("payload") if isinstance(block, dict) else None
        entries = payload.get("entries") if isinstance(payload, dict) else None
        for entry in entries if isinstance(entries, list) else []:
            if isinstance(entry, dict) and entry.get("status") == "open":
                entry["status"] = "pending"
                n += 1
    return n


def _text(value, path: str, rule: tuple) -> list[tuple[str, str]]:
    required, longest, allowed = rule
    bad = [("json.invalid-field", path)]
    if value is _ABSENT:
        return bad if required else []
    if allowed == "number":
        if isinstance(value, int | float) and not isinstance(value, bool):
            return [] if math.isfinite(value) else bad
    elif allowed:
        return [] if value in allowed else bad
    return [] if isinstance(value, str) and len(value) <= longest and (value or path.endswith(".delta")) else bad


_ABSENT = object()


def _fields(value, path: str, rules: dict, more: tuple[str, ...] = ()) -> list[tuple[str, str]]:
    """A strict object: its fields, and one error for all keys it doesn't know."""
    if not isinstance(value, dict):
        return [("json.invalid-field", path)]
    out = [e for k, rule in rules.items() for e in _text(value.get(k, _ABSENT), f"{path}.{k}", rule)]
    return out + ([("json.unknown-key", path)] if set(value) - set(rules) - set(more) else [])


def _list(value, path: str, most: int, each) -> list[tuple[str, str]]:
    if not isinstance(value, list):
        return [("json.invalid-field", path)]
    return ([("input.too-many-entries", path)] if len(value) > most else []) + [e for i, x in enumerate(value) for e in each(x, f"{path}[{i}]")]


def _block(block, path: str) -> list[tuple[str, str]]:
    if not isinstance(block, dict):
        return [("json.invalid-field", path)]
    kind = block.get("kind")
    if kind not in X.KINDS:
        return [("json.unknown-kind", f"{path}.kind")]
    out = _text(block.get("title", _ABSENT), f"{path}.title", (False, 120, None))
    payload, at = block.get("payload", _ABSENT), f"{path}.payload"
    if kind == "snapshot":
        out += _fields(payload, at, SNAPSHOT, ("notes",))
    elif not isinstance(payload, dict):
        out.append(("json.invalid-field", at))
    else:
        out += _list(payload.get("entries"), f"{at}.entries", MAX_ITEMS, lambda x, p: _fields(x, p, ENTRIES[kind]))
        out += [("json.unknown-key", at)] if set(payload) - {"entries", "notes"} else []
    if isinstance(payload, dict) and "notes" in payload:
        out += _list(payload["notes"], f"{at}.notes", MAX_ITEMS, lambda x, p: [] if isinstance(x, str) and len(x) <= 2000 else [("json.invalid-field", p)])
    return out + ([("json.unknown-key", path)] if set(block) - {"kind", "title", "payload"} else [])


def _relation(value, path: str) -> list[tuple[str, str]]:
    out = _fields(value, path, {"relation": (True, 0, RELATIONS), "note": (False, 200, None)}, ("from", "to"))
    ends = [f"{path}.{k}" for k in ("from", "to") if isinstance(value, dict) and not (isinstance(value.get(k), str) and REFERENCE.fullmatch(value[k]))]
    return out + [("json.invalid-field", p) for p in ends]


def checked(text: str | None) -> dict:
    """Errors of the first failing stage (syntax, safety, root and version, fields, kinds), how many entries were rewritten, and the
    source with them rewritten, if it has no errors."""
    out = lambda errors, n=0, source=None: {"errors": [{"code": e[0], "path": e[1], "line": e[2] if len(e) > 2 else None, "column": e[3] if len(e) > 3 else None} for e in errors], "rewritten": n, "source": source}
    try:
        root = json.loads((text or "").removeprefix("\ufeff"))
    except RecursionError:
        return out([("input.too-deep", "$")])
    except json.JSONDecodeError as e:
        return out([("json.syntax", None, e.lineno, e.colno)])
    if found := unsafe(root):
        return out(found)
    if not isinstance(root, dict):
        return out([("json.invalid-field", "$")])
    if "version" in root and (root["version"] != 1 or isinstance(root["version"], bool)):
        return out([("json.unsupported-version", "$.version")])
    n = migrated(root)
    errors = [] if "version" in root else [("json.unsupported-version", "$.version")]
    errors += _text(root.get("title", _ABSENT), "$.title", (True, 200, None))
    errors += _list(root.get("blocks"), "$.blocks", MAX_ITEMS, _block)
    errors += [("json.invalid-field", "$.blocks")] if root.get("blocks") == [] else []
    if "relations" in root:
        errors += _list(root["relations"], "$.relations", MAX_RELATIONS, _relation)
    errors += [("json.unknown-key", "$")] if set(root) - {"version", "title", "blocks", "relations", "archetype"} else []
    if errors:
        return out(errors)
    kinds = [b["kind"] for b in root["blocks"]]
    errors = [("json.duplicate-kind", f"$.blocks[{i}].kind") for i, k in enumerate(kinds) if k in kinds[:i]]
    errors += [("json.missing-kind", "$.blocks") for k in X.KINDS if k not in kinds]
    return out(errors) if errors else out([], n, json.dumps(root, ensure_ascii=False))


@F.pandas_udf(CHECKED)
def check(texts: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([checked(t) for t in texts], columns=["errors", "rewritten", "source"])


def canonical_value(value):
    """Sorted keys, ordered lists, NFC strings with line feeds, non-finite numbers as null."""
    if isinstance(value, str):
        return unicodedata.normalize("NFC", value.replace("\r\n", "\n").replace("\r", "\n"))
    if isinstance(value, float):
        return None if not math.isfinite(value) else int(value) if value.is_integer() and abs(value) < 1e21 else value
    if isinstance(value, list):
        return [canonical_value(x) for x in value]
    if isinstance(value, dict):
        return {k: canonical_value(value[k]) for k in sorted(value)}
    return value


def canonical(text: str | None) -> str | None:
    try:
        return json.dumps(canonical_value(json.loads(text)), ensure_ascii=False, separators=(",", ":"))
    except (TypeError, ValueError, RecursionError):
        return None


@F.pandas_udf(T.StringType())
def canonical_json(texts: pd.Series) -> pd.Series:
    """The canonical form of JSON texts; null for texts that aren't JSON."""
    return texts.map(canonical)


def _json_text(text: Column) -> Column:
    """A string as JSON."""
    one = F.to_json(F.array(text))
    return F.substring(one, F.lit(2), F.length(one) - 2)


def block_id(kind: Column, title: Column, payload: Column, locator: Column) -> Column:
    """blk_, the kind and twelve letters of the hash of the block's canonical form; the place among the blocks isn't part of it."""
    body = F.concat(F.lit('{"kind":'), _json_text(kind), F.lit(',"locator":'), _json_text(locator), F.lit(',"payload":'), canonical_json(payload), F.lit(',"title":'), _json_text(title), F.lit("}"))
    return F.concat(F.lit("blk_"), kind, F.lit("_"), F.left(F.sha2(body, 256), F.lit(12)))


BLOCKS = "struct<version:int,title:string,archetype:string,blocks:array<struct<kind:string,title:string,payload:string>>>"


def imported(docs: DataFrame, text: str = "raw") -> DataFrame:
    """`docs` with errors, ok, warnings, title and blocks (array of kind, title, payload as JSON text); blocks are null unless ok.

    A warning json.legacy-status tells how many entries had the old status.
    """
    out = docs.withColumn("_c", check(F.col(text)))
    warning = F.struct(F.lit("json.legacy-status").alias("code"), F.col("_c.rewritten").alias("count"))
    parsed = F.from_json(F.col("_c.source"), BLOCKS)
    out = out.withColumns({"errors": F.col("_c.errors"), "ok": F.size("_c.errors") == 0, "warnings": F.filter(F.array(warning), lambda w: w["count"] > 0), "_p": parsed})
    return out.withColumns({"title": F.col("_p.title"), "blocks": F.col("_p.blocks")}).drop("_p", "_c")


def excerpt(text: Column, kind: Column, index: Column) -> Column:
    """Three lines from the first one that names the kind (else from the block's number) on one line, of at most 240 characters."""

    def cut(lines: Column) -> Column:
        at = F.array_position(F.transform(lines, lambda x: x.contains(F.concat(F.lit('"'), kind, F.lit('"')))), F.lit(True)).cast("int")
        start = F.when(at > 0, at).otherwise(F.least(index + 1, F.size(lines)))
        flat = strip(F.regexp_replace(F.array_join(F.slice(lines, start, F.lit(3)), "\n"), r"\s+", " "))
        return let(flat, lambda t: F.when(F.length(t) > MAX_EXCERPT, F.concat(F.substring(t, 1, MAX_EXCERPT - 1), F.lit("…"))).otherwise(t))

    return let(F.split(text, "\n"), cut)


def canonical_blocks(docs: DataFrame, text: str = "raw", id: str = "doc_id") -> DataFrame:
    """(id, id of the block, kind, title, source_order, locator, excerpt, payload) of every block of a document without errors."""
    names = F.create_map(*[F.lit(x) for k in X.KINDS for x in (k, k.capitalize())])
    rows = imported(docs, text).where("ok").select(id, F.regexp_replace(text, "^\ufeff", "").alias("_t"), F.posexplode("blocks").alias("source_order", "b"))
    rows = rows.select(id, "_t", "source_order", "b.kind", F.coalesce("b.title", names[F.col("b.kind")]).alias("title"), "b.payload")
    locator = F.concat(F.lit("blocks["), F.col("source_order").cast("string"), F.lit("] · "), F.col("kind"))
    rows = rows.withColumns({"locator": locator, "excerpt": excerpt(F.col("_t"), F.col("kind"), F.col("source_order"))}).drop("_t")
    return rows.withColumn("block_id", block_id(F.col("kind"), F.col("title"), F.col("payload"), F.col("locator")))


def exported(title: Column, blocks: Column) -> Column:
    """The source format again, two blanks deep."""
    return F.concat(F.to_json(F.struct(F.lit(1).alias("version"), title.alias("title"), blocks.alias("blocks")), {"pretty": "true"}), F.lit("\n"))


def reordered(blocks: DataFrame, wanted: DataFrame) -> DataFrame:
    """Blocks (doc_id, id, source_order) in the order of wanted (doc_id, ids); ids that it doesn't name follow in source order."""
    place = wanted.select("doc_id", F.posexplode(F.array_distinct("ids")).alias("pos", "id"))
    out = blocks.join(place, ["doc_id", "id"], "left")
    order = Window.partitionBy("doc_id").orderBy(F.coalesce("pos", F.lit(1 << 30)), "source_order")
    return out.withColumn("place", F.row_number().over(order)).drop("pos")

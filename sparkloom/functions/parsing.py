"""Formats that need a real parser: byte-bounded chunks, JSON in replies, WASM modules, catalogs, source maps, OpenAPI."""

from __future__ import annotations

import json
import re

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def chunk_text(text: str | None, most: int) -> list[str]:
    """Greedy chunks of at most most UTF-8 bytes (one character at least) that join to the text; cut behind a newline, ; } space or comma in the last 40 %."""
    data, out, at = (text or "").encode(), [], 0
    while at < len(data):
        end = min(at + most, len(data))
        while end < len(data) and end > at and data[end] & 0xC0 == 0x80:
            end -= 1
        if end == at:
            end = at + 1
            while end < len(data) and data[end] & 0xC0 == 0x80:
                end += 1
        piece = data[at:end].decode()
        if end < len(data):
            least = max(1, int(len(piece) * 0.6))
            cut = max(piece.rfind(c) for c in "\n;} ,") + 1
            if cut > least:
                piece = piece[:cut]
        out.append(piece)
        at += len(piece.encode())
    return out


@F.arrow_udf(T.ArrayType(T.StringType()))
def text_chunks(text: pa.Array, most: pa.Array) -> pa.Array:
    return pa.array([chunk_text(t, n) for t, n in zip(text.to_pylist(), most.to_pylist(), strict=True)], pa.list_(pa.string()))


def balanced_json(text: str) -> str | None:
    """The first balanced object or list, honouring strings and escapes."""
    start = next((k for k, c in enumerate(text) if c in "{["), None)
    if start is None:
        return None
    closing, quoted, escaped = [], False, False
    for k in range(start, len(text)):
        c = text[k]
        if quoted:
            quoted, escaped = not (c == '"' and not escaped), c == "\\" and not escaped
        elif c == '"':
            quoted = True
        elif c in "{[":
            closing.append("}" if c == "{" else "]")
        elif c in "}]":
            if not closing or closing.pop() != c:
                return None
            if not closing:
                return text[start : k + 1]
    return None


def repair_json(text: str | None) -> str | None:
    """JSON text of a reply: whole, out of a code fence, or its first balanced part; null if none parses."""
    plain = (text or "").strip()
    fenced = re.fullmatch(r"```(?:json)?\s*(.*?)\s*```", plain, re.S | re.I)
    plain = fenced[1] if fenced else plain
    for candidate in (plain, balanced_json(plain)):
        if candidate:
            try:
                return json.dumps(json.loads(candidate), ensure_ascii=False, separators=(",", ":"))
            except ValueError:
                pass
    return None


@F.arrow_udf(T.StringType())
def extract_json(text: pa.Array) -> pa.Array:
    return pa.array([repair_json(t) for t in text.to_pylist()], pa.string())


def printable_strings(data: bytes, most: int = 20) -> list[str]:
    return list(dict.fromkeys(m[0].decode() for m in re.finditer(rb"[\x20-\x7e]{4,}", data)))[:most]


def _uleb(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = data[at]
        value, shift, at = value | (byte & 127) << shift, shift + 7, at + 1
        if byte < 128:
            return value, at


def _name(data: bytes, at: int) -> tuple[str, int]:
    n, at = _uleb(data, at)
    return data[at : at + n].decode(), at + n


_KINDS = ("function", "table", "memory", "global", "tag")


def wasm_interface(data: bytes) -> tuple[list[str], list[str]]:
    """Imports and exports of a WebAssembly module, from sections 2 and 7."""
    if data[:8] != b"\0asm\1\0\0\0":
        raise ValueError("not a version 1 module")
    imports, exports, at = [], [], 8
    while at < len(data):
        section, at = data[at], at + 1
        size, at = _uleb(data, at)
        end = at + size
        if end > len(data):
            raise ValueError("section exceeds the module")
        if section in (2, 7):
            n, k = _uleb(data, at)
            for _ in range(n):
                first, k = _name(data, k)
                if section == 7:
                    exports.append(f"{first} ({_KINDS[data[k]]})")
                    _, k = _uleb(data, k + 1)
                    continue
                second, k = _name(data, k)
                kind, k = data[k], k + 1
                imports.append(f"{first}.{second} ({_KINDS[kind]})")
                if kind == 0:
                    _, k = _uleb(data, k)
                elif kind in (1, 2):
                    k += kind == 1
                    flags, k = data[k], k + 1
                    for _ in range(1 + (flags & 1)):
                        _, k = _uleb(data, k)
                else:
                    k += 2
        at = end
    return imports, exports


def wasm_text(url: str, data: bytes) -> str:
    head = [f"WASM module: {url}", f"Byte size: {len(data)}"]
    try:
        imports, exports = wasm_interface(data)
    except (ValueError, IndexError, UnicodeDecodeError) as why:
        return "\n".join([*head, f"Binary summary unavailable: {why}"])
    parts = (("Imports", imports), ("Exports", exports), ("Embedded strings", printable_strings(data)))
    return "\n".join([*head, *(f"{name}: {', '.join(x) or 'none'}" for name, x in parts)])


@F.arrow_udf(T.StringType())
def wasm_summary(url: pa.Array, data: pa.Array) -> pa.Array:
    return pa.array([wasm_text(u, d or b"") for u, d in zip(url.to_pylist(), data.to_pylist(), strict=True)], pa.string())


def source_map_text(raw: Column, url: Column) -> Column:
    """A source map as text: its count of sources, then each with its content; raw text that is no source map stays."""
    parsed = F.from_json(raw, "struct<sources:array<string>,sourcesContent:array<string>>")
    sources = F.coalesce(parsed["sources"], F.array().cast("array<string>"))
    contents = F.coalesce(parsed["sourcesContent"], F.array().cast("array<string>"))
    pairs = F.filter(F.zip_with(sources, F.slice(contents, F.lit(1), F.greatest(F.size(sources), F.lit(1))), lambda s, c: F.struct(s.alias("s"), c.alias("c"))), lambda x: F.coalesce(x["s"], F.lit("")) != "")
    lines = F.flatten(F.transform(pairs, lambda x: F.array_compact(F.array(F.concat(F.lit("--- Source: "), x["s"]), F.nullif(x["c"], F.lit(""))))))
    head = F.array(F.concat(F.lit("Source map: "), url), F.concat(F.lit("Mapped sources: "), F.size(sources).cast("string")))
    ok = parsed.isNotNull() & F.trim(raw).startswith("{") & F.get_json_object(raw, "$").isNotNull()
    return F.when(ok, F.array_join(F.concat(head, lines), "\n")).otherwise(raw)


HTTP_METHODS = ("GET", "POST", "PUT", "PATCH", "DELETE")


def openapi_document(body: Column) -> Column:
    """title, version, path_summaries (of the first 20 paths), schema_names (first 24) of a JSON document."""
    doc = F.from_json(body, "struct<openapi:string,swagger:string,info:struct<title:string,version:string>,paths:map<string,map<string,string>>,components:struct<schemas:map<string,string>>>")
    detail = lambda x: F.coalesce(F.nullif(F.get_json_object(x, "$.summary"), F.lit("")), F.nullif(F.get_json_object(x, "$.operationId"), F.lit("")), F.lit("No summary"))
    of_path = lambda p: F.transform(F.filter(F.map_entries(p["value"]), lambda m: F.upper(m["key"]).isin(*HTTP_METHODS)), lambda m: F.concat(F.upper(m["key"]), F.lit(" "), p["key"], F.lit(" - "), detail(m["value"])))
    none = F.array().cast("array<string>")
    return F.when(doc.isNotNull(), F.struct(
        doc["info"]["title"].alias("title"), F.coalesce(doc["info"]["version"], doc["openapi"], doc["swagger"]).alias("version"),
        F.coalesce(F.flatten(F.transform(F.slice(F.map_entries(doc["paths"]), 1, 20), of_path)), none).alias("path_summaries"), F.coalesce(F.slice(F.map_keys(doc["components"]["schemas"]), 1, 24), none).alias("schema_names"),
    ))


def introspection(status: Column, body: Column) -> Column:
    """introspection_status, operation_types and sample_fields of a recorded introspection reply."""
    schema = F.from_json(body, "struct<data:struct<__schema:struct<queryType:struct<name:string>,mutationType:struct<name:string>,subscriptionType:struct<name:string>,types:array<struct<kind:string,name:string>>>>>")["data"]["__schema"]
    state = F.when(status.isin(400, 401, 403), "blocked").when(~status.between(200, 299) | status.isNull() | schema.isNull(), "failed").otherwise("supported")
    names = F.filter(F.array(*(schema[f"{k}Type"]["name"] for k in ("query", "mutation", "subscription"))), lambda x: F.coalesce(x, F.lit("")) != "")
    fields = F.slice(F.transform(F.filter(F.coalesce(schema["types"], F.expr("array()").cast("array<struct<kind:string,name:string>>")), lambda t: F.coalesce(t["name"], F.lit("")) != ""), lambda t: F.concat_ws(":", t["kind"], t["name"])), 1, 12)
    none = F.array().cast("array<string>")
    ok = state == "supported"
    return F.struct(state.alias("introspection_status"), F.when(ok, names).otherwise(none).alias("operation_types"), F.when(ok, fields).otherwise(none).alias("sample_fields"))


def _token_count(value) -> int | None:
    if isinstance(value, bool):
        return None
    if isinstance(value, int | float):
        n = int(value)
    elif isinstance(value, str):
        m = re.fullmatch(r"\s*(\d+(?:\.\d+)?)\s*([km])?\s*(?:tokens?)?\s*", value.replace(",", "").replace("_", ""), re.I)
        if not m:
            return None
        n = round(float(m[1]) * {"k": 1000, "m": 1_000_000}.get((m[2] or "").lower(), 1))
    else:
        return None
    return n if 1024 <= n <= 10_000_000 else None


def _key_score(key: str) -> int:
    flat = re.sub(r"[^a-z0-9]", "", key.lower())
    if flat in ("contextwindow", "contextlength", "contextsize", "maxcontext", "maxcontextlength", "maxcontexttokens", "maxcontextwindow"):
        return 6
    if "context" in flat or "window" in flat:
        return 5
    if "input" in flat and "token" in flat:
        return 4
    return 3 if "token" in flat or "ctx" in flat else 0


def context_window(metadata: str | None) -> int | None:
    """The most likely context size in a model's metadata: best key first, then the largest value."""
    try:
        root = json.loads(metadata or "")
    except ValueError:
        return None
    best: tuple[int, int] | None = None
    stack: list[tuple[str, object]] = [("", root)]
    while stack:
        key, value = stack.pop()
        if isinstance(value, dict):
            stack += value.items()
        elif isinstance(value, list):
            stack += [(key, x) for x in value]
        else:
            found = []
            if (score := _key_score(key)) and (n := _token_count(value)):
                found.append((score, n))
            if isinstance(value, str) and (m := re.search(r"(?:context|ctx|window)\D{0,12}(\d+(?:\.\d+)?\s*[km]?)", value, re.I)) and (n := _token_count(m[1])):
                found.append((2, n))
            best = max([*found, *([best] if best else [])], default=None)
    return best[1] if best else None


@F.arrow_udf(T.LongType())
def model_context(metadata: pa.Array) -> pa.Array:
    return pa.array([context_window(m) for m in metadata.to_pylist()], pa.int64())


# Where a catalog's entries, and an entry's id and label, are looked for.
ENTRY_LISTS, ID_KEYS, LABEL_KEYS = ("data", "models", "items", "results"), ("id", "model", "name", "slug"), ("display_name", "label", "name")


def model_entries(payload: str | None) -> list[dict]:
    """id, label and context of a catalog's entries that have an id; of a repeated id the last."""
    try:
        root = json.loads(payload or "")
    except ValueError:
        return []
    if isinstance(root, dict):
        root = next((root[k] for k in ENTRY_LISTS if isinstance(root.get(k), list)), [])
    text = lambda entry, keys: next((v.strip() for k in keys if isinstance(v := entry.get(k), str) and v.strip()), None)
    found = {}
    for entry in root if isinstance(root, list) else []:
        if isinstance(entry, dict) and (name := text(entry, ID_KEYS)):
            found[name] = {"id": name, "label": text(entry, LABEL_KEYS), "context": context_window(json.dumps(entry))}
    return list(found.values())


@F.arrow_udf(T.ArrayType(T.StructType([T.StructField("id", T.StringType()), T.StructField("label", T.StringType()), T.StructField("context", T.LongType())])))
def catalog_entries(payload: pa.Array) -> pa.Array:
    return pa.array([model_entries(p) for p in payload.to_pylist()], pa.list_(pa.struct([("id", pa.string()), ("label", pa.string()), ("context", pa.int64())])))


@F.arrow_udf(T.StringType())
def pretty_json(text: pa.Array) -> pa.Array:
    """JSON with two spaces a level."""
    return pa.array([None if t is None else json.dumps(json.loads(t), indent=2, ensure_ascii=False) for t in text.to_pylist()], pa.string())

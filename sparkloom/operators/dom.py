"""Snapshots of pages: title, headings, forms, buttons, links, frames, data attributes, state hints, summary."""

from __future__ import annotations

import re
from collections import Counter
from html.parser import HTMLParser
from itertools import islice

import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkloom.functions.urls import resolve

_S = T.ArrayType(T.StringType())
FORM = T.StructType([T.StructField("action", T.StringType()), T.StructField("method", T.StringType()), T.StructField("input_names", _S), T.StructField("input_types", _S), T.StructField("submit_labels", _S)])
SNAPSHOT = T.StructType([
    T.StructField("title", T.StringType()), T.StructField("headings", _S), T.StructField("description", T.StringType()), T.StructField("forms", T.ArrayType(FORM)), T.StructField("buttons", _S),
    T.StructField("links", _S), T.StructField("iframes", _S), T.StructField("inline_state_hints", _S), T.StructField("data_attribute_keys", _S), T.StructField("summary", T.StringType()),
])
# List caps.
CAPS = {"headings": 12, "buttons": 20, "links": 20, "iframes": 10, "data": 24, "inputs": 20, "labels": 8, "hints": 20}
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_SPACE = re.compile("[\\s ﻿]+")
# Where state hints are looked for.
_JSON_SCRIPT = re.compile(r"<script[^>]*type=[\"']application/(?:ld\+json|json)[\"'][^>]*?(?:id=[\"']([^\"']+)[\"'])?[^>]*>", re.I)
_GLOBAL = re.compile(r"(?:window|globalThis|self)\.([A-Z_$][A-Z0-9_$]{2,})")


def squeeze(text: str | None) -> str | None:
    return (_SPACE.sub(" ", text).strip() or None) if text else None


def state_hints(html: str) -> list[str]:
    found = {f"json-script:{m[1] or 'inline'}" for m in _JSON_SCRIPT.finditer(html)} | {f"global:{m[1]}" for m in _GLOBAL.finditer(html)}
    return sorted(found)[: CAPS["hints"]]


class _Element:
    __slots__ = ("tag", "named", "form", "start", "end")

    def __init__(self, tag: str, named: dict, form: int, start: int):
        self.tag, self.named, self.form, self.start, self.end = tag, named, form, start, None


class _Tree(HTMLParser):
    """Elements in document order. An element's text is a range of the page's pieces of text, so nothing is copied while it is open."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.elements: list[_Element] = []
        self.open: list[_Element] = []
        self.names: Counter = Counter()  # of what is open, so a stray end tag costs nothing
        self.pieces: list[str] = []
        self.solid = [0]  # pieces that are more than white space, before each place
        self.form = -1

    def handle_starttag(self, tag, attrs):
        named = {k: v or "" for k, v in reversed(attrs)}
        if tag == "form":
            self.form = len(self.elements)
        self.elements.append(_Element(tag, named, self.form, len(self.pieces)))
        if tag not in _VOID:
            self.open.append(self.elements[-1])
            self.names[tag] += 1

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in _VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        while self.names[tag] and (ended := self.open.pop()):
            ended.end = len(self.pieces)
            self.names[ended.tag] -= 1
            if ended.tag == tag:
                break
        if tag == "form":
            self.form = -1

    def handle_data(self, data):
        self.pieces.append(data)
        self.solid.append(self.solid[-1] + (not data.isspace()))

    def text(self, e: _Element) -> str | None:
        end = len(self.pieces) if e.end is None else e.end
        return squeeze("".join(self.pieces[e.start : end])) if self.solid[end] > self.solid[e.start] else None


def _first(items, n: int) -> list[str]:
    """The first n that are not empty; no more is looked at."""
    return list(islice((x for x in items if x), n))


def _of_tree(tree: _Tree, html: str, url: str | None) -> dict:
    by_tag: dict[str, list[_Element]] = {}
    by_form: dict[int, list[_Element]] = {}
    for k, e in enumerate(tree.elements):
        by_tag.setdefault(e.tag, []).append(e)
        if e.form >= 0 and e.form != k:
            by_form.setdefault(e.form, []).append(e)
    own = lambda *tags: [e for tag in tags for e in by_tag.get(tag, ())]
    label = lambda e: squeeze(e.named.get("value")) or tree.text(e) or squeeze(e.named.get("aria-label"))
    kind = lambda e: e.named.get("type", "").lower()
    titles, metas = own("title"), [e for e in own("meta") if e.named.get("name", "").lower() == "description"]
    forms = []
    for k, e in enumerate(tree.elements):
        if e.tag != "form":
            continue
        inside = by_form.get(k, [])
        fields = [x for tag in ("input", "textarea", "select") for x in inside if x.tag == tag]
        submits = [x for x in inside if x.tag == "button"] + [x for x in inside if x.tag == "input" and kind(x) == "submit"]
        forms.append({
            "action": (resolve(e.named["action"], url) if e.named.get("action") else None) or url, "method": (e.named.get("method") or "get").upper(),
            "input_names": _first((x.named.get("name") for x in fields), CAPS["inputs"]), "input_types": _first((x.named.get("type") for x in fields if x.tag == "input"), CAPS["inputs"]),
            "submit_labels": _first(map(label, submits), CAPS["labels"]),
        })
    keys = dict.fromkeys(name[5:] for e in tree.elements for name in e.named if name.startswith("data-") and len(name) > 5)
    return {
        "title": (titles and tree.text(titles[0])) or "", "headings": _first(map(tree.text, own("h1", "h2", "h3")), CAPS["headings"]), "description": squeeze(metas[0].named.get("content")) if metas else None, "forms": forms,
        "buttons": _first(map(label, own("button") + [e for e in own("input") if kind(e) in ("submit", "button")]), CAPS["buttons"]),
        "links": _first((tree.text(e) or squeeze(e.named.get("aria-label")) for e in own("a") if e.named.get("href", "").strip()), CAPS["links"]),
        "iframes": _first((resolve(e.named["src"], url) for e in own("iframe") if e.named.get("src")), CAPS["iframes"]), "inline_state_hints": state_hints(html), "data_attribute_keys": list(keys)[: CAPS["data"]],
    }


def snapshot(html: str | None, url: str | None) -> dict:
    """The page's surface; a page on which the parser fails has its state hints alone."""
    html = html or ""
    try:
        tree = _Tree()
        tree.feed(html)
        tree.close()
        out = _of_tree(tree, html, url)
    except (ValueError, AssertionError, RecursionError):
        hints = state_hints(html)
        empty = {c: [] for c in ("headings", "forms", "buttons", "links", "iframes", "data_attribute_keys")}
        return {"title": "", "description": None, **empty, "inline_state_hints": hints, "summary": f"Fallback DOM snapshot with {len(hints)} inline state hint(s)" if hints else "Fallback DOM snapshot only."}
    counts = ((len(out["headings"]), "heading(s)"), (len(out["forms"]), "form(s)"), (len(out["buttons"]), "button label(s)"), (len(out["iframes"]), "iframe(s)"), (len(out["inline_state_hints"]), "inline state hint(s)"))
    parts = ([f'title "{out["title"]}"'] if out["title"] else []) + [f"{n} {what}" for n, what in counts if n]
    return out | {"summary": ", ".join(parts) or "Minimal DOM surface detected."}


def closed_references(html):
    """html in which only the four references ``&lt; &gt; &quot; &amp;``, with their semicolons, are read as characters; a browser reads further ones, and ``&amp`` without its semicolon."""
    return F.regexp_replace(html, "&(?!(?:lt|gt|quot|amp);)", "&amp;")


@F.arrow_udf(SNAPSHOT)
def dom_snapshot(html: pa.Array, url: pa.Array) -> pa.Array:
    form = pa.struct([("action", pa.string()), ("method", pa.string()), *((c, pa.list_(pa.string())) for c in ("input_names", "input_types", "submit_labels"))])
    lists = pa.list_(pa.string())
    kinds = {"title": pa.string(), "headings": lists, "description": pa.string(), "forms": pa.list_(form), "buttons": lists, "links": lists, "iframes": lists, "inline_state_hints": lists, "data_attribute_keys": lists, "summary": pa.string()}
    return pa.array([snapshot(h, u) for h, u in zip(html.to_pylist(), url.to_pylist(), strict=True)], pa.struct(list(kinds.items())))


def inline_hints(html):
    """The state hints as a Catalyst expression."""
    scripts = F.transform(F.regexp_extract_all(html, F.lit(_JSON_SCRIPT.pattern.replace("<script", "(?i)<script", 1)), 1), lambda x: F.concat(F.lit("json-script:"), F.coalesce(F.nullif(x, F.lit("")), F.lit("inline"))))
    names = F.transform(F.regexp_extract_all(html, F.lit(_GLOBAL.pattern), 1), lambda x: F.concat(F.lit("global:"), x))
    return F.slice(F.array_sort(F.array_distinct(F.concat(scripts, names))), 1, CAPS["hints"])

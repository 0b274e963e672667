"""Linked artifacts: references in scripts by patterns, in HTML by streaming parser events, and what to follow."""

from __future__ import annotations

import re
from html.parser import HTMLParser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkloom.functions import urls
from sparkloom.functions.text import WS_CHARS
from sparkloom.operators import ordered

# Reference patterns in scripts, in order, with the type of what they name.
Q, NQ = "[\"'`]", "[^\"'`]"
JS_PATTERNS = (
    (rf"(?:import|export)\s+(?:{NQ}+?\s+from\s+)?{Q}({NQ}+){Q}", "script"),
    (rf"import\(\s*{Q}({NQ}+){Q}\s*\)", "script"),
    (rf"importScripts\(\s*{Q}({NQ}+){Q}\s*\)", "script"),
    (rf"navigator\.serviceWorker\.register\(\s*(?:new\s+URL\(\s*)?{Q}({NQ}+){Q}", "service-worker"),
    (rf"new\s+(?:SharedWorker|Worker)\(\s*(?:new\s+URL\(\s*)?{Q}({NQ}+){Q}", "worker"),
    (rf"new\s+URL\(\s*{Q}({NQ}+){Q}\s*,\s*import\.meta\.url\s*\)", "script"),
    (rf"{Q}({NQ}+\.(?:m?js|cjs|wasm|map)(?:\?{NQ}*)?){Q}", "script"),
    (rf"[@#]\s*sourceMappingURL=([^{WS_CHARS}]+)", "source-map"),
)
CANDIDATE = T.ArrayType(T.StructType([T.StructField("seq", T.LongType()), T.StructField("url", T.StringType()), T.StructField("kind", T.StringType())]))


def js_references(content: Column) -> Column:
    """[(raw, type)] of all references in a script, in order of patterns and places."""
    of = lambda pattern, type_: F.transform(F.regexp_extract_all(content, F.lit(pattern), 1), lambda raw: F.struct(raw.alias("raw"), F.lit(type_).alias("type")))
    return F.concat(*(of(pattern, type_) for pattern, type_ in JS_PATTERNS))


def js_candidates(sources: DataFrame, origin_label: Column, *by: str) -> DataFrame:
    """by, base_url, content, a row for each by, to by, seq, url, type, discovered_from: resolved, typed by ending, first wins.

    The explode is an outer one, as for others Spark infers a filter of their list, pushes it below and makes the list there once more, each of its parts anew wherever it is named.
    """
    refs = F.transform(js_references(F.col("content")), lambda x, i: F.struct(x["raw"].alias("raw"), x["type"].alias("type"), i.alias("seq")))
    raw = sources.select(*by, "base_url", origin_label.alias("discovered_from"), refs.alias("refs"))
    rows = _first_urls(raw, *by, "discovered_from").select(*by, "discovered_from", F.explode_outer("found").alias("c")).where("c is not null")
    return rows.select(*by, F.col("c.seq").alias("seq"), "c.url", "discovered_from", urls.asset_type(F.col("c.url"), F.col("c.type")).alias("type"))


def _first_urls(sources: DataFrame, *columns: str) -> DataFrame:
    """columns, base_url, refs [(raw, type, seq)] to columns, base_url, found [(url, seq, type)], the first of each URL.

    References are resolved and made unique in their own row: most by expressions, and only lists of the odd ones go to Python.
    """
    base = F.struct(*(c.alias(n) for n, c in urls.base_parts(F.col("base_url")).items()))
    raw = sources.select(*columns, "base_url", "refs", base.alias("base"))
    easy = F.transform("refs", lambda x: urls.resolve_plain(x["raw"], F.col("base")))
    raw = raw.select(*columns, "base_url", "refs", easy.alias("easy"))
    # the odd ones go and come back at their places, the others as nulls
    odd = F.zip_with("refs", "easy", lambda x, y: F.when(y.isNull(), x["raw"]))
    found = raw.select(*columns, "base_url", "refs", "easy", urls.candidate_resolve_list(F.when(F.exists("easy", lambda x: x.isNull()), odd), F.col("base_url")).alias("hard"))
    url = lambda x, i: F.coalesce(x, F.get("hard", i))
    entry = F.transform("easy", lambda x, i: F.struct(url(x, i).alias("url"), F.get("refs", i)["seq"].alias("seq"), F.get("refs", i)["type"].alias("type")))
    usable = F.filter(entry, lambda x: x["url"].isNotNull() & (x["url"] != "") & ~urls.is_asset(x["url"]))
    ordered_ = found.select(*columns, "base_url", F.array_sort(usable).alias("s"))
    once = F.filter("s", lambda x, i: (i == 0) | (F.get("s", i - 1)["url"] != x["url"]))
    return ordered_.select(*columns, "base_url", once.alias("found"))


class JsCandidates:
    """Table function for SQL: a script and its address to (seq, url, type), as ``js_candidates`` has them for a table.

    SELECT a.url, c.* FROM artifacts a, LATERAL js_candidates(a.content, a.url) c
    """

    schema = "seq int, url string, type string"

    def eval(self, content: str, base: str):
        seen, seq = set(), 0
        for pattern, kind in JS_PATTERNS:
            for found in re.finditer(pattern, content or "", re.ASCII):
                url = urls.resolve_candidate(found[1], base)
                if url and url not in seen:
                    seen.add(url)
                    yield seq, url, urls.type_of(url, kind)
                seq += 1


class HtmlReferences:
    """Table function for SQL: a page to (seq, reference, kind) of its scripts, preloads, links, frames and forms, as they are written."""

    schema = "seq int, reference string, kind string"

    def eval(self, html: str):
        parser = _References()
        parser.feed(html or "")
        parser.close()
        for seq, (_, _, reference, kind) in enumerate(sorted(parser.found)):
            yield seq, reference, kind


class _References(HTMLParser):
    """Script, preload and page references, and the code of inline scripts, each numbered by pass and place."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.found: list[tuple[int, int, str, str]] = []
        self.inline: list[str] = []
        self.code: list[str] | None = None

    def add(self, pass_: int, raw: str, kind: str) -> None:
        self.found.append((pass_, len(self.found), raw.strip(), kind))

    def handle_starttag(self, tag, attrs):
        named = {k: v or "" for k, v in reversed(attrs)}
        if tag == "script":
            if "src" in named:
                self.add(0, named["src"], "html:script")
            self.code = None if "src" in named else []
        elif tag == "link" and "href" in named:
            rel, as_ = named.get("rel", "").lower(), named.get("as", "").lower()
            if "modulepreload" in rel or "preload" in rel and as_ == "script":
                self.add(1, named["href"], "html:preload")
        elif (attr := {"a": "href", "iframe": "src", "form": "action"}.get(tag)) and attr in named:
            self.add(2, named[attr], f"html:{tag}")

    def handle_data(self, data):
        if self.code is not None:
            self.code.append(data)

    def handle_endtag(self, tag):
        if tag == "script" and self.code is not None:
            self.inline.append("".join(self.code))
            self.code = None

    def close(self):
        super().close()
        self.handle_endtag("script")


@F.udf(T.StructType([T.StructField("refs", CANDIDATE), T.StructField("inline", T.ArrayType(T.StringType()))]), useArrow=False)
def html_references(html: str | None, base: str | None):
    """A page's usable references, resolved, and the code of its inline scripts. No Arrow: its batches grow to 10,000 pages with all that is made of them, others are a hundred rows."""
    parser = _References()
    parser.feed(html or "")
    parser.close()
    found = ((n, urls.resolve_candidate(raw, base), kind) for n, (_, _, raw, kind) in enumerate(sorted(parser.found)))
    return [x for x in found if x[1] is not None], parser.inline


def html_candidates(pages: DataFrame, *by: str, inline: bool = True) -> DataFrame:
    """by, url, html to by, seq, url, type, discovered_from: scripts, preloads, same-origin pages, then inline code; first wins by URL.

    A page is parsed once for both: its references and those of its inline code become rows together, and only what is no filter below tells which rows are none.
    """
    label = "html:inline-script"
    parsed = pages.select(*by, F.col("url").alias("base_url"), html_references(F.col("html"), F.col("url")).alias("r"))
    listed = F.transform("r.refs", lambda x: F.struct(x["url"].alias("url"), x["seq"].alias("seq"), F.lit(None).cast("string").alias("type"), x["kind"].alias("discovered_from")))
    if inline:
        seq = lambda place, i: (place.cast("long") + 1) * (1 << 32) + i
        of_code = lambda code, place: F.transform(js_references(code), lambda x, i: F.struct(x["raw"].alias("raw"), x["type"].alias("type"), seq(place, i).alias("seq")))
        parsed = _first_urls(parsed.select(*by, "base_url", "r", F.flatten(F.transform("r.inline", of_code)).alias("refs")), *by, "r")
        listed = F.concat(listed, F.transform("found", lambda c: F.struct(c["url"].alias("url"), c["seq"].alias("seq"), c["type"].alias("type"), F.lit(label).alias("discovered_from"))))
    rows = parsed.select(*by, "base_url", F.explode_outer(listed).alias("x")).where("x is not null").select(*by, "base_url", "x.*")
    is_page = F.col("discovered_from").isin("html:a", "html:iframe", "html:form")
    rows = rows.where(~is_page | (urls.looks_like_page(urls.path(F.col("url"))) & (urls.origin(F.col("url")) == urls.origin(F.col("base_url")))))
    script = F.when(F.col("discovered_from") == label, F.col("type")).otherwise(F.lit("script"))
    type_ = F.when(is_page, "html").when(F.col("discovered_from") == "html:script", "script").otherwise(urls.asset_type(F.col("url"), script))
    return ordered.first_wins(rows.select(*by, "seq", "url", type_.alias("type"), "discovered_from"), [*by, "url"], [F.col("seq")])


def nested_filter(df: DataFrame, entry: Column, scope: Column) -> Column:
    """Which candidates a page-scoped crawl follows; a site-scoped one follows all. df has url, type, discovered_from."""
    p, e = F.lower(urls.path(F.col("url"))), F.lower(urls.path(entry))
    found = F.lower(F.col("discovered_from"))
    stem = F.regexp_replace(F.regexp_replace(e, r"(index)?\.html?$", ""), "/+$", "")
    stem = F.when(stem == "", e).otherwise(stem)
    folder = F.regexp_extract(e, "^(.*/)", 1)
    folder = F.when(folder == "", "/").otherwise(folder)
    return (
        F.when((scope == "site") | (F.col("type") != "html") | found.contains("iframe"), True)
        .when(found.contains("form"), urls.is_auth_like(p)).when(p == e, True)
        .when(folder != "/", p.startswith(folder)).when((stem != e) & p.startswith(stem), True).otherwise(p.startswith(F.concat(e, F.lit("/"))))
    )

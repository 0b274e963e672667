"""Breadth-first crawl over recorded responses, level by level, with depth, page and artifact budgets for each run.

The sequential queue's order is kept: within a level rows are numbered by their parent's place and their own, budgets are running
counts in that order, and a page that the page budget held back is not visited, so the same URL may come as a script later.
Any number of runs (sites) crawl at once, and a run's level is counted in ranges of rows (``ordered.running``), so neither is one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.functions import urls
from sparkloom.functions.parsing import source_map_text, wasm_summary
from sparkloom.operators import candidates, ordered
from sparkloom.sources.store import drop, keep

MAX_PAGES, MAX_ARTIFACTS, MAX_DEPTH = 20, 400, 3
#: Rows of a level, in the queue's order, that are counted together; a run's level is as many tasks.
RANGE = 4096


def fetched(frontier: DataFrame, responses: DataFrame) -> DataFrame:
    """Candidates with their recorded response: ok, resolved type, content and size; what is to be dropped is not ok."""
    own = responses.select(F.col("url").alias("_url"), "status", "content_type", "body", "body_bytes")
    met = frontier.join(own, frontier["url"] == own["_url"], "left").drop("_url")
    kind = F.lower(F.trim(F.coalesce("content_type", F.lit(""))))
    html = kind.contains("text/html") | kind.contains("application/xhtml+xml")
    wasm = (F.col("type") == "wasm") | kind.contains("application/wasm")
    ok = F.coalesce(F.col("status").between(200, 299), F.lit(False)) & ~urls.is_ignored_content(kind) & ~((F.col("type") == "html") & ~html)
    resolved = F.when(wasm, "wasm").when(kind.contains("text/html"), "html").when(kind.contains("json") & (F.col("type") == "source-map"), "source-map").otherwise(F.col("type"))
    met = met.withColumns({"ok": ok, "resolved": resolved})
    raw = F.coalesce("body_bytes", F.encode(F.coalesce("body", F.lit("")), "utf-8"))
    text = F.when(F.col("resolved") == "wasm", wasm_summary("url", raw)).when(F.col("resolved") == "source-map", source_map_text(F.col("body"), F.col("url"))).otherwise(F.coalesce("body", F.lit("")))
    met = met.withColumn("content", F.when(F.col("ok"), text))
    size = F.when(F.col("resolved") == "wasm", F.octet_length(raw)).otherwise(F.octet_length("content")).cast("long")
    return met.withColumn("size_bytes", F.when(F.col("ok"), size)).drop("status", "content_type", "body", "body_bytes")


def expand(visits: DataFrame) -> DataFrame:
    """The references of fetched artifacts: run_id, parent_seq, seq, parent_url, url, type, discovered_from."""
    source = visits.where("ok").select("run_id", F.col("seq").alias("parent_seq"), F.col("url").alias("parent_url"), "resolved", "content")
    by = ("run_id", "parent_seq", "parent_url")
    pages = source.where("resolved = 'html'").select(*by, F.col("parent_url").alias("url"), F.col("content").alias("html"))
    code = source.where("resolved in ('script', 'service-worker', 'worker', 'source-map')").select(*by, "resolved", F.col("parent_url").alias("base_url"), "content")
    from_html = candidates.html_candidates(pages, *by)
    from_code = candidates.js_candidates(code, F.concat("resolved", F.lit(":code")), *by)
    columns = [*by, F.col("seq").cast("long").alias("seq"), "url", "type", "discovered_from"]
    return from_html.select(*columns).unionByName(from_code.select(*columns))


def crawl(roots: DataFrame, responses: DataFrame, max_pages: int = MAX_PAGES, max_artifacts: int = MAX_ARTIFACTS, max_depth: int = MAX_DEPTH, sitemaps: DataFrame | None = None) -> DataFrame:
    """roots: run_id, url. Returns all visits: run_id, depth, seq, url, type, resolved, discovered_from, ok, content, size_bytes.

    sitemaps: run_id, seq, url of pages to add at depth 1 behind the root's own links, for site-scoped runs.
    """
    roots = keep(roots.select("run_id", F.col("url").alias("root"), urls.origin(F.col("url")).alias("root_origin"), urls.crawl_scope(urls.path(F.col("url"))).alias("scope")), "roots")
    frontier = roots.select("run_id", F.lit(1).cast("long").alias("seq"), F.col("root").alias("url"), F.lit("html").alias("type"), F.lit("entry").alias("discovered_from"))
    seen = totals = None
    levels = []
    for depth in range(max_depth + 1):
        level = frontier.join(roots, "run_id").where((F.col("type") != "html") | (urls.origin(F.col("url")) == F.col("root_origin")))
        if seen is not None:
            level = level.join(seen, ["run_id", "url"], "left_anti").join(totals, "run_id", "left")
        else:
            level = level.withColumns({"pages": F.lit(0), "found": F.lit(0)})
        level = keep(fetched(level, responses), f"fetched{depth}")
        page, part = F.col("ok") & (F.col("resolved") == "html"), F.col("ok") & (F.col("resolved") != "html")
        # budgets are counted without the texts; the first of a URL's rows that no budget holds back is the visit
        rows = level.withColumn("first", F.row_number().over(Window.partitionBy("run_id", "url").orderBy("seq")) == 1)
        rows = keep(rows.select("run_id", "seq", "url", "type", "ok", "resolved", "root", "pages", "found", "first"), f"queue{depth}")
        ranges = F.floor(F.col("seq") / RANGE)
        ahead = ordered.running(rows, ["run_id"], ranges, [F.col("seq")], counts={"ahead": page & F.col("first")})
        open_ = ahead.where((F.col("type") != "html") | (F.col("ahead") + F.coalesce("pages", F.lit(0)) < max_pages) | (F.col("url") == F.col("root")))
        open_ = keep(ordered.first_wins(open_.drop("ahead"), ["run_id", "url"], [F.col("seq")]), f"open{depth}")
        had = ordered.running(open_, ["run_id"], ranges, [F.col("seq")], counts={"had": part})
        taken = had.where(F.col("had") + F.coalesce("found", F.lit(0)) < max_artifacts).select("run_id", "seq")
        level_ = level.join(taken, ["run_id", "seq"], "left_semi")
        visits = keep(level_.select("run_id", F.lit(depth).alias("depth"), "seq", "url", "type", "resolved", "discovered_from", "ok", "content", "size_bytes", "root", "scope"), f"level{depth}")
        drop(level, rows, open_)
        levels.append(visits)
        if depth == max_depth:
            break
        seen = visits.select("run_id", "url") if seen is None else seen.union(visits.select("run_id", "url"))
        now = visits.groupBy("run_id").agg(F.count_if(page).alias("pages"), F.count_if(part).alias("found"))
        totals = keep(now if totals is None else totals.union(now).groupBy("run_id").agg(F.sum("pages").alias("pages"), F.sum("found").alias("found")), f"totals{depth}")
        links = expand(visits).join(roots, "run_id")
        links = links.where(candidates.nested_filter(links, F.col("root"), F.col("scope")))
        links = links.select("run_id", F.lit(1).alias("part"), "parent_seq", "seq", "url", "type", "discovered_from")
        if depth == 0 and sitemaps is not None:  # they were queued before the root was fetched
            site = sitemaps.join(roots.where("scope = 'site'").select("run_id"), "run_id")
            links = links.unionByName(site.select("run_id", F.lit(0).alias("part"), F.lit(0).cast("long").alias("parent_seq"), F.col("seq").cast("long").alias("seq"), "url", F.lit("html").alias("type"), F.lit("sitemap:loc").alias("discovered_from")))
        links = keep(links, f"links{depth}")
        numbered = ordered.running(links, ["run_id"], F.struct("part", "parent_seq"), [F.col("part"), F.col("parent_seq"), F.col("seq")], numbers="n")
        frontier = keep(numbered.select("run_id", F.col("n").alias("seq"), "url", "type", "discovered_from"), f"frontier{depth + 1}")
        drop(links)
        if frontier.isEmpty():
            break
    out = levels[0]
    for more in levels[1:]:
        out = out.unionByName(more)
    return out.drop("root", "scope")

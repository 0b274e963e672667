"""A whole run over recorded inputs: crawl, formatting, probes, surfaces, flows, plan, agents' replies, merging, and what the reports need."""

from __future__ import annotations

import json
from dataclasses import dataclass
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.functions import parsing, text, urls
from sparkloom.operators import candidates, dom, flows, ordered, planner, probes, retrieval, surface
from sparkloom.plans import agents, analysis, crawl, report
from sparkloom.plans.options import LEAST_FOR_RETRIEVAL, Options, concurrency_default, retrieval_default
from sparkloom.sources.files import MARK, write_files
from sparkloom.sources.store import keep

# Caps of a recorded browser session, and what its notes say by its status.
TRACE_CAPS = {"requests": 160, "console": 60, "page_errors": 20, "frames": 40}
SNIPPET_BYTES = 32_000
NOTES = {
    "captured": ("Playwright trace captured post-hydration DOM and network activity.", "Image, font, and media requests were aborted to keep tracing focused on application behavior."),
    "failed": ("Browser-assisted tracing failed and the static pipeline continued.",),
}
NO_ARTIFACTS = "No analyzable website artifacts were discovered on the target page."
NO_SUMMARY = "Artifact analysis completed."
SIGNALS = ("captcha_providers", "auth_request_urls", "challenge_request_urls", "fingerprinting_request_urls", "encryption_hints")
REQUEST_DETAILS = {"method": "string", "resource_type": "string", "status": "int", "content_type": "string", "content_length": "long", "response_body": "string"}


class EntryError(RuntimeError):
    """The page that a run starts from was not fetched."""


def capped_trace(requests: DataFrame, session: DataFrame | None = None, status: str = "captured") -> DataFrame:
    """A recorded session to one row a run: signals, storage names, messages, frames, and the first requests with their snippets.

    requests: run_id, seq, url, and what is known of ``flows.REQUEST_COLUMNS`` and ``REQUEST_DETAILS``; session: run_id and what is known
    of ``flows.SESSION_COLUMNS``, status, final_url and error. A failed trace keeps its rows but has no signals.
    """
    rows = flows.with_columns(requests, flows.REQUEST_COLUMNS | REQUEST_DETAILS)
    asked = ordered.cap(rows.where("url is not null"), ["run_id"], [F.col("seq")], TRACE_CAPS["requests"])
    silent = rows.where("url is null")
    signals = flows.runtime_signals(asked.drop("rank").unionByName(silent), session)
    reply = F.when(flows.wants_snippet(F.col("resource_type"), F.col("url")), response_snippet(F.coalesce("content_type", F.lit("")), F.col("content_length"), F.col("response_body")))
    detail = F.struct("url", F.coalesce("method", F.lit("GET")).alias("method"), "resource_type", "status", "frame_url", F.nullif(text.clip_dots(F.col("request_body_snippet")), F.lit("")).alias("request_body_snippet"), F.nullif(reply, F.lit("")).alias("response_body_snippet"), "content_type")
    details = asked.groupBy("run_id").agg(ordered.ordered_list(F.col("rank"), detail).alias("requests"))
    told = flows.with_columns(session if session is not None else rows.select("run_id").distinct(), {"status": "string", "final_url": "string", "error": "string"}).select("run_id", F.coalesce("status", F.lit(status)).alias("status"), "final_url", "error")
    out = signals.join(details, "run_id", "left").join(told, "run_id", "left").withColumn("status", F.coalesce("status", F.lit(status)))
    none = F.array().cast("array<string>")
    captured = F.col("status") == "captured"
    note = lambda key: F.array(*map(F.lit, NOTES[key]))
    return out.withColumns({**{c: F.when(captured, F.col(c)).otherwise(none) for c in SIGNALS}, "notes": F.when(captured, note("captured")).otherwise(note("failed"))})


def response_snippet(content_type, length, body):
    """The start of a recorded reply, of JSON or text of bounded length only."""
    return F.when(content_type.rlike("(?i)(json|text)") & (F.coalesce(length, F.lit(0)) <= SNIPPET_BYTES), text.clip_dots(body))


#: By which columns a run's tables are in order.
ORDER = {
    "html_pages": ("artifact_seq",), "artifacts": ("artifact_seq",), "dom_snapshots": ("page_seq",), "api_endpoints": ("rank",), "openapi_documents": ("rank",), "graphql_endpoints": ("rank",), "graphql_operations": ("rank",),
    "auth_flows": ("title",), "captcha_flows": ("rule",), "fingerprint_signals": ("rule",), "encryption_signals": ("rule",), "security_findings": ("rule",), "trace": (), "rag": (), "overview": (), "artifact_summaries": ("rank",),
    "graph_nodes": ("rank",), "manifest": ("artifact_seq",), "prompts": ("artifact_seq", "chunk_index", "agent_ord"), **{kind: ("rank",) for kind in report.ANALYSIS},
}
BODIES = ("content", "formatted_content")


def assembled(options: Options, url: str, parts: dict[str, list[dict]]) -> dict:
    """What a report of one run shows, from the rows of its tables."""
    rows = {name: parts.get(name) or [] for name in ORDER}
    rows |= {key: [r["value"] for r in rows[key]] for key in report.ANALYSIS}
    trace, rag = next(iter(rows.pop("trace")), None), next(iter(rows.pop("rag")), None)
    told = next(iter(rows.pop("overview")), {"overview": NO_ARTIFACTS, "analyzed_chunks": 0, "failed": 0})
    error = f"{told['failed']} chunk(s) without a valid analysis" if told["failed"] else None
    counts = {"htmlPages": len(rows["html_pages"]), "artifacts": len(rows["artifacts"]), "chunks": told["analyzed_chunks"], "browserRequests": len((trace or {}).get("requests") or [])}
    size = sum(a["size_bytes"] or 0 for a in rows["artifacts"])
    facts = {"model": options.model, "contextSize": options.context_size, "analysisConcurrency": concurrency_default(options, told["analyzed_chunks"]), "localRagEnabled": retrieval_default(options, size), "browserAssisted": options.browser_assisted}
    metadata = {"targetUrl": url, **facts, "browserTraceStatus": (trace or {}).get("status", "disabled"), "ragSummary": rag, "counts": counts}
    return {"url": url, "status": "partial" if error else "complete", "error": error, "overview": told["overview"], "analyzed_chunks": told["analyzed_chunks"], "trace": trace, "metadata": metadata, **rows}


def _read(parts) -> dict[str, list[dict]]:
    return {name: json.loads(rows) for name, rows in dict(parts).items()}


def _rendered(options: Options, name: str, outside: bool):
    """A run's documents from its data, a run at a time."""

    @F.arrow_udf("array<struct<name:string,content:string>>")
    def render(urls_: pa.Array, parts: pa.Array) -> pa.Array:
        made = ([{"name": n, "content": text_} for n, text_ in report.files(assembled(options, url.as_py(), _read(own.as_py())), name, outside).items()] for url, own in zip(urls_, parts, strict=True))
        return pa.array(list(made), pa.list_(pa.struct([("name", pa.string()), ("content", pa.string())])))

    return render


@dataclass
class Run:
    """Any number of runs: their entries, their tables by run_id, and those whose entry page was not fetched.

    ``data`` is what reports show, a row for each run, written once when the runs are made; the bodies of artifacts stay in ``tables``. All
    files are made and written by executors.
    """

    options: Options
    roots: DataFrame
    tables: dict[str, DataFrame]
    data: DataFrame
    missing: DataFrame

    def collect(self, run_id: int | None = None) -> dict:
        """What the report of one run shows, the only one if none is named: bounded by the crawl's budgets and the caps of all lists."""
        row = self.data.where(F.lit(True) if run_id is None else F.col("run_id") == run_id).first()
        return assembled(self.options, row.url, _read(row.parts))

    def files(self, folder, name: str = "report.md", outside: bool = False) -> DataFrame:
        """(folder, name, content) of all runs: documents, and the bodies of artifacts as fetched and as analysed. folder: of run_id."""
        whole = F.coalesce("content", F.lit(""))
        body = lambda kind, text_: F.struct(F.concat(F.lit(f"artifacts/{kind}/"), "file_name").alias("name"), F.concat(text_, F.lit("\n")).alias("content"))
        bodies = self.tables["artifacts"].select("run_id", F.explode(F.array(body("raw", whole), body("formatted", F.coalesce(F.nullif("formatted_content", F.lit("")), whole)))).alias("f"))
        documents = self.data.select("run_id", F.explode(_rendered(self.options, name, outside)("url", "parts")).alias("f"))
        return documents.unionByName(bodies).select(folder.alias("folder"), "f.name", "f.content")

    def _size(self) -> int:
        sizes = [F.coalesce(F.octet_length(c), F.lit(0)) for c in BODIES]
        return int(self.tables["artifacts"].agg(F.sum(sizes[0] + sizes[1])).first()[0] or 0)

    def write(self, directory: str | None = None) -> list[Path]:
        """All files of a single run; a name that ends in .md is the report's, and the rest goes beside it."""
        wanted = directory or self.options.output
        at = report.run_directory(self.options.url, wanted).absolute()
        outside = bool(wanted) and wanted.lower().endswith(".md")
        told = Path(wanted).absolute() if outside else at / "report.md"
        write_files(self.files(F.lit(at.name), told.name, outside), str(at.parent), self._size())
        if outside:
            report.write_report(self.collect(), told)
        return [told, *sorted(p for p in at.rglob("*") if p.is_file() and p != told and p.name != MARK)]

    def write_all(self, root: str) -> None:
        """A folder for each run, ``run_id=<id>``, under root, and the tables under root/tables, partitioned by run. What runs of other ids have there stays."""
        write_files(self.files(F.concat(F.lit("run_id="), F.col("run_id").cast("string"))), root, self._size())
        for name, df in self.tables.items():
            replace_runs(df, self.roots, f"{root}/tables/{name}")


def replace_runs(df: DataFrame, runs: DataFrame, path: str) -> None:
    """df as Parquet partitioned by run_id, in place of what the same runs had there; a run without rows now has none."""
    df.write.partitionBy("run_id").mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(path)
    spark = df.sparkSession
    there = spark.read.parquet(path) if not df.isEmpty() or _exists(spark, path) else None
    if there is None or "run_id" not in there.columns:
        return
    stale = there.select(F.col("run_id").cast("long")).distinct().join(runs.select("run_id"), "run_id", "left_semi").join(df.select("run_id").distinct(), "run_id", "left_anti")
    for r in stale.toLocalIterator():
        at = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/run_id={r.run_id}")
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def _exists(spark, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    store = at.getFileSystem(spark._jsc.hadoopConfiguration())
    return store.exists(at) and any("run_id=" in f.getPath().getName() for f in store.listStatus(at))


def rows_by_run(name: str, df: DataFrame, order: tuple[str, ...]) -> DataFrame:
    """A table as one JSON list for each run, in order: run_id, name, rows. Its rows are bounded by the caps and budgets of a run."""
    row = F.to_json(F.struct(*(c for c in df.columns if c != "run_id" and c not in BODIES)), {"ignoreNullFields": "false"})
    listed = F.array_sort(F.collect_list(F.struct(*(F.col(c).alias(f"o{k}") for k, c in enumerate(order)), row.alias("row"))))
    return df.groupBy("run_id").agg(F.concat(F.lit("["), F.array_join(F.transform(listed, lambda x: x["row"]), ","), F.lit("]")).alias("rows")).select("run_id", F.lit(name).alias("name"), "rows")


def data_of(roots: DataFrame, tables: dict[str, DataFrame]) -> DataFrame:
    """run_id, url, parts: each table's rows by its name."""
    parts = analysis.union_all([rows_by_run(name, df, ORDER[name]) for name, df in tables.items()])
    return roots.join(parts.groupBy("run_id").agg(F.map_from_entries(F.collect_list(F.struct("name", "rows"))).alias("parts")), "run_id", "left").withColumn("parts", F.coalesce("parts", F.map_from_entries(F.array().cast("array<struct<name:string,rows:string>>"))))


def formatted(artifacts: DataFrame) -> DataFrame:
    """No pretty-printer here: text passes, marked as not formatted, but WASM summaries, which need none."""
    wasm = F.col("type") == "wasm"
    return artifacts.withColumns({"formatted_content": F.col("content"), "formatting_skipped": ~wasm, "formatting_note": F.when(wasm, "binary summary").otherwise("no formatter for this type")})


def snapshots_of(pages: DataFrame) -> DataFrame:
    return pages.select("run_id", F.col("seq").cast("int").alias("page_seq"), "url", dom.dom_snapshot("content", "url").alias("s")).select("run_id", "page_seq", "url", "s.*")


def chunk_tasks(artifacts: DataFrame, context: int) -> DataFrame:
    """artifacts with chunks of their text, for the planner's counts and agents."""
    most = planner.chunk_bytes(F.lit(context))
    return artifacts.select("run_id", "artifact_seq", "priority", F.posexplode(parsing.text_chunks("content", most)).alias("chunk_index", "chunk")).withColumn("agents", planner.agent_plan(F.col("priority"), F.col("chunk_index")))


def merged_analysis(chunks: DataFrame) -> DataFrame:
    """chunk analyses (run_id, artifact_seq, chunk_index, lists of key and value by kind) to first-wins rows."""
    kinds = [c for c in chunks.columns if c not in ("run_id", "artifact_seq", "chunk_index", "summary")]
    # one explode of all lists, as analyses are computed anew for each read
    entry = lambda kind: F.transform(kind, lambda e, pos: F.struct(F.lit(kind).alias("kind"), pos.alias("pos"), e["key"].alias("key"), e["value"].alias("value")))
    none = F.array().cast("array<struct<kind:string,pos:int,key:string,value:string>>")
    rows = chunks.select("run_id", "artifact_seq", "chunk_index", F.explode_outer(F.concat(*(F.coalesce(entry(k), none) for k in kinds))).alias("e")).where("e is not null")
    return analysis.merge_first(rows.select("run_id", "e.kind", "artifact_seq", "chunk_index", "e.pos", "e.key", "e.value"))


def _of_kind(merged: DataFrame, kind: str, schema: str | None) -> DataFrame:
    """run_id, rank, value of a kind: parsed where they are objects."""
    value = F.from_json("value", schema) if schema else F.col("value")
    return merged.where(F.col("kind") == kind).select("run_id", "rank", value.alias("value"))


KINDS = {
    "entry_points": ("entryPoints", "symbol string, description string, evidence string"), "initialization_flow": ("initializationFlow", None), "call_graph": ("callGraph", "caller string, callee string, rationale string"),
    "restored_names": ("restoredNames", "originalName string, suggestedName string, justification string"), "notable_libraries": ("notableLibraries", None), "investigation_tips": ("investigationTips", None), "risks": ("risks", None),
}


def mentions(merged: DataFrame) -> DataFrame:
    """Merged analyses to what names their graph has: run_id, type, seq, id, meta, in the order of entries, renames and calls."""
    field_ = lambda name: F.get_json_object("value", f"$.{name}")
    part = lambda kind, place, type_, name, meta: merged.where(F.col("kind") == kind).select("run_id", F.lit(type_).alias("type"), (F.col("rank") * 2 + place).cast("long").alias("seq"), field_(name).alias("id"), field_(meta).alias("meta"))
    return analysis.union_all([
        part("entryPoints", 0, "entry", "symbol", "description"), part("restoredNames", 0, "restored", "suggestedName", "justification"), part("restoredNames", 1, "opaque", "originalName", "justification"),
        part("callGraph", 0, "function", "caller", "rationale"), part("callGraph", 1, "function", "callee", "rationale"),
    ])


def names_of(merged: DataFrame) -> DataFrame:
    """The names that artifacts are related by, in order: entries, then both names of renames, then both ends of calls."""
    field_ = lambda name: F.get_json_object("value", f"$.{name}")
    part = lambda kind, stage, place, name: merged.where(F.col("kind") == kind).select("run_id", (F.lit(stage) * (1 << 40) + F.col("rank") * 2 + place).cast("long").alias("name_seq"), field_(name).alias("name"))
    return analysis.union_all([part("entryPoints", 0, 0, "symbol"), part("restoredNames", 1, 0, "originalName"), part("restoredNames", 1, 1, "suggestedName"), part("callGraph", 2, 0, "caller"), part("callGraph", 2, 1, "callee")])


def analyse(
    options: Options, responses: DataFrame, introspected: DataFrame | None = None, requests: DataFrame | None = None, sitemaps: DataFrame | None = None, session: DataFrame | None = None,
    posts: DataFrame | None = None, replies: DataFrame | None = None, roots: DataFrame | None = None,
) -> Run:
    """Runs over recordings: of the site that options name, as run 1, or of all roots (run_id, url), with the other options for each.

    responses: HTTP replies to GET, the probes' well-known addresses among them; posts: replies to schema questions (url, status, body), or
    introspected: url, introspection_status; requests and session: recorded browser sessions by run_id; replies: what agents said (run_id,
    artifact_seq, chunk_index, agent, raw_text, and attempt if there are several; agent ``final`` speaks for the run). A run whose entry page was
    not fetched is an error if it is the only one that was asked for, and else a row of ``missing``.
    """
    spark, single = responses.sparkSession, roots is None
    roots = spark.createDataFrame([(1, options.url)], "run_id long, url string") if single else keep(roots.select(F.col("run_id").cast("long").alias("run_id"), "url"), "roots")
    found = probes.supplemental_pages(roots, responses)
    sitemaps = found if sitemaps is None else sitemaps.select("run_id", F.col("seq").cast("long").alias("seq"), "url")
    visits = keep(crawl.crawl(roots, responses, options.max_pages, options.max_artifacts, options.max_depth, sitemaps), "visits")
    begun = visits.where("depth = 0 and ok").select("run_id").distinct()
    told = responses.select("url", "status").groupBy("url").agg(F.max("status").alias("status"))
    missing = keep(roots.join(begun, "run_id", "left_anti").join(told, "url", "left").select("run_id", "url", "status"), "missing")
    if single and (lost := missing.first()):
        raise EntryError(f"the entry page {lost.url} was not fetched: {'no reply' if lost.status is None else f'status {lost.status} or no HTML'}")
    roots = keep(roots.join(begun, "run_id", "left_semi"), "runs")
    targets = roots.withColumnRenamed("url", "target_url")
    visits = visits.where("ok").join(targets, "run_id")
    order = [F.col("depth"), F.col("seq")]
    numbered = ordered.running(visits, ["run_id"], F.struct("depth", F.floor(F.col("seq") / crawl.RANGE)), order, numbers="artifact_seq")
    pages = numbered.where("resolved = 'html'").withColumn("seq", F.col("artifact_seq"))
    artifacts = numbered.where("resolved <> 'html'").withColumn("type", F.col("resolved"))
    artifacts = formatted(planner.relevance(artifacts)).withColumn("content", text.content_of(F.col("formatted_content"), F.col("content")))
    artifacts = keep(flows.scanned(artifacts), "artifacts")
    snaps = snapshots_of(pages)
    trace = None
    if requests is not None:
        trace = keep(capped_trace(requests, session).join(roots.select("run_id"), "run_id", "left_semi"), "trace")
        if session is not None and "page_text" in session.columns:  # the page as the session left it comes behind the crawled ones
            last = flows.with_columns(session, {"final_url": "string"}).where("page_text is not null").join(targets, "run_id")
            last = last.select("run_id", F.lit(2**31 - 1).alias("seq"), F.coalesce("final_url", "target_url").alias("url"), F.col("page_text").alias("content"))
            snaps = snaps.unionByName(snapshots_of(last))
    snaps = keep(snaps, "snapshots")
    ends = keep(surface.api_endpoints(artifacts, python_urls=True), "endpoints")
    gql = surface.graphql_endpoints(artifacts, python_urls=True)
    if introspected is None and posts is not None:
        introspected = probes.introspected(gql.join(targets, "run_id").where(F.col("url").startswith(urls.origin(F.col("target_url")))), posts)
    if introspected is not None:
        gql = surface.with_introspection(gql, introspected, targets)
    documents = surface.openapi_literals(artifacts, probes.openapi_documents(roots, responses), python_urls=True)
    auth, captcha = flows.auth_flows(snaps, ends, artifacts), flows.captcha_flows(snaps, ends, artifacts)
    traits, crypto = flows.fingerprint_signals(ends, artifacts), flows.encryption_signals(ends, artifacts)
    if trace is not None:
        auth, captcha, traits, crypto = flows.merge_auth(auth, trace), flows.merge_captcha(captcha, trace), flows.merge_fingerprint(traits, trace), flows.merge_encryption(crypto, trace)
    auth, captcha, traits, gql = (keep(df, name) for df, name in ((auth, "auth"), (captcha, "captcha"), (traits, "traits"), (gql, "graphql")))
    ranked = artifacts.withColumn("rank", planner.analysis_rank("run_id"))
    named = ranked.select(
        "run_id", "artifact_seq", "url", "type", "size_bytes", "discovered_from", "score", "priority", "rank", analysis.manifest_name(F.col("artifact_seq"), F.col("url"), F.col("type")).alias("file_name"),
        "content", "formatted_content", "formatting_skipped", "formatting_note",
    )
    tables = {
        "html_pages": pages.select("run_id", "artifact_seq", "url"), "artifacts": named, "dom_snapshots": snaps, "api_endpoints": ends, "openapi_documents": documents, "graphql_endpoints": gql,
        "graphql_operations": surface.graphql_operations(artifacts, python_urls=True), "auth_flows": auth, "captcha_flows": captcha, "fingerprint_signals": traits, "encryption_signals": crypto,
        "security_findings": flows.security_findings(auth, captcha, traits, gql),
    }
    if trace is not None:
        tables["trace"] = trace
    ranks = ranked.select("run_id", "artifact_seq", "rank")
    tables |= _agents(spark, options, artifacts.join(ranks, ["run_id", "artifact_seq"]), named, replies)
    return Run(options, roots, tables, keep(data_of(roots, tables), "data"), missing)


def with_retrieval(options: Options, artifacts: DataFrame) -> DataFrame | None:
    """run_id of the runs whose agents are given retrieved segments; None if none can be."""
    if options.local_rag is False or options.local_rag is None and options.headless:
        return None
    runs = artifacts.groupBy("run_id").agg(F.sum("size_bytes").alias("size"))
    return (runs if options.local_rag else runs.where(F.col("size") >= LEAST_FOR_RETRIEVAL)).select("run_id")


def _agents(spark, options: Options, artifacts: DataFrame, named: DataFrame, replies: DataFrame | None) -> dict[str, DataFrame]:
    """Chunks, tasks, recorded replies, fallbacks, retrieval and merging: the tables of the analysis."""
    if replies is None:
        replies = spark.createDataFrame([], "run_id long, artifact_seq long, chunk_index int, agent string, raw_text string")
    chunks = keep(chunk_tasks(artifacts, options.context_size), "chunks")
    retrieving = with_retrieval(options, artifacts)
    rows = keep(agents.tasks(chunks), "tasks")
    memo_rows = keep(agents.memos(rows, replies), "memos")
    analyses = keep(agents.chunk_analyses(rows, memo_rows, replies), "analyses")
    in_order = analyses.join(artifacts.select("run_id", "artifact_seq", "rank"), ["run_id", "artifact_seq"])
    lead = keep(agents.final_analysis(replies), "lead")
    # findings are merged in the order of analysis, so an artifact's rank stands for its number; where the lead agent merged, its reply takes their place
    own = merged_analysis(agents.keyed(in_order.withColumn("artifact_seq", F.col("rank").cast("long")))).join(lead.select("run_id"), "run_id", "left_anti")
    merged = keep(own.unionByName(merged_analysis(agents.keyed(lead))), "merged")
    summaries = analysis.artifact_summaries(analyses)
    counted = chunks.groupBy("run_id", "artifact_seq").agg(F.count("*").alias("chunk_count"))
    told = artifacts.select("run_id", "artifact_seq", "rank", "url", "type").join(summaries, ["run_id", "artifact_seq"], "left").join(counted, ["run_id", "artifact_seq"], "left")
    told = keep(told.withColumns({"summary": F.coalesce("summary", F.lit("")), "chunk_count": F.coalesce("chunk_count", F.lit(0))}), "summaries")
    joined = F.trim(F.array_join(ordered.ordered_list(F.col("rank"), F.col("summary")), " "))
    whole = told.groupBy("run_id").agg(F.coalesce(F.nullif(joined, F.lit("")), F.lit(NO_SUMMARY)).alias("joined"), F.sum("chunk_count").alias("analyzed_chunks"))
    whole = whole.join(lead.select("run_id", "overview"), "run_id", "left").withColumn("overview", F.coalesce("overview", "joined"))
    fell = analyses.groupBy("run_id").agg(F.count_if("fell_back").alias("failed"))
    related = artifacts.select("run_id", "artifact_seq", "url").join(told.select("run_id", "artifact_seq", "summary"), ["run_id", "artifact_seq"])
    relations = keep(analysis.artifact_relations(related, names_of(merged)), "relations")
    nodes = analysis.node_artifacts(analysis.graph_nodes(mentions(merged)), artifacts, relations)
    some = None if retrieving is None else artifacts.join(retrieving, "run_id", "left_semi")
    found = None if some is None else agents.retrieved_segments(rows.join(retrieving, "run_id", "left_semi"), some)
    tables = {
        **{name: _of_kind(merged, kind, schema) for name, (kind, schema) in KINDS.items()}, "artifact_summaries": told.select("run_id", "rank", "url", "type", "chunk_count", "summary"),
        "overview": whole.join(fell, "run_id", "left").select("run_id", "overview", "analyzed_chunks", F.coalesce("failed", F.lit(0)).alias("failed")), "graph_nodes": nodes,
        "manifest": analysis.manifest(named, told.select("run_id", "artifact_seq", "summary"), relations), "prompts": agents.prompts(rows, artifacts, memo_rows, agents.primers(analyses, artifacts), found),
    }
    if some is not None:
        tables["rag"] = retrieval.describe(retrieval.segment_rows(some, "content", "run_id", "artifact_seq"), "run_id")
    return tables


def counters(tables: dict[str, DataFrame]) -> DataFrame:
    """run_id and how many rows each table has of it, all counted in one pass: a run that some table lacks has 0 there."""
    rows = analysis.union_all([df.select("run_id", F.lit(name).alias("name")) for name, df in tables.items()])
    return rows.groupBy("run_id").agg(*(F.count_if(F.col("name") == name).alias(name) for name in tables))


def register(spark) -> None:
    """The parsing functions and table functions by name, for SQL."""
    for name, fn in {"url_resolve": urls.url_resolve, "chunk_text": parsing.text_chunks, "dom_snapshot": dom.dom_snapshot, "wasm_summary": parsing.wasm_summary, "extract_json": parsing.extract_json, "model_context": parsing.model_context}.items():
        spark.udf.register(name, fn)
    for name, table in {"js_candidates": candidates.JsCandidates, "html_references": candidates.HtmlReferences}.items():
        spark.udtf.register(name, F.udtf(table, returnType=table.schema))

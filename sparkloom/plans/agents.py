"""Agent tasks over recorded replies: validated memos and chunk analyses, fallbacks where a reply is missing or broken, retrieval queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.functions.parsing import extract_json, pretty_json
from sparkloom.operators.retrieval import EXCLUDE_CHARS, QUERY_CHARS, segment_rows, top_segments, with_segments

MEMO = "struct<role:string,summary:string,observations:array<string>,evidence:array<string>,nextQuestions:array<string>>"
CHUNK = (
    "struct<entryPoints:array<struct<symbol:string,description:string,evidence:string>>,initializationFlow:array<string>,callGraph:array<struct<caller:string,callee:string,rationale:string>>,"
    "restoredNames:array<struct<originalName:string,suggestedName:string,justification:string>>,summary:string,notableLibraries:array<string>,investigationTips:array<string>,risks:array<string>>"
)
# The words that an agent's retrieval query starts with.
KEYWORDS = {
    "scout": "imports exports framework runtime mount hydrate render boot start worker register fetch cache dom route manifest css wasm",
    "runtime": "entry init bootstrap mount hydrate listener event lifecycle schedule render message postMessage fetch call graph trigger",
    "naming": "function class variable module store client request response state cache token auth session api route handler service",
    "security": "auth token session cookie localStorage sessionStorage indexedDB cache service worker telemetry endpoint wasm trust dynamic import",
    "synthesizer": "entry points call graph restored names investigation tips risks runtime relationships architecture summary",
}


# The shapes that agents are asked for, what is added when a reply was no JSON, and how often one is asked.
MEMO_CONTRACT = '{"role":"string","summary":"string","observations":["string"],"evidence":["string"],"nextQuestions":["string"]}'
ATTEMPTS = 4
NO_REPLY = "No valid analysis of this chunk."
REPAIR = "\nPrevious attempt failed because the JSON was malformed or incomplete. Return a syntactically valid JSON object this time."


def tasks(chunks: DataFrame) -> DataFrame:
    """chunks with agents to a row for each agent, in order."""
    return chunks.select("run_id", "artifact_seq", "chunk_index", "chunk", F.posexplode("agents").alias("agent_ord", "agent"))


def valid(parsed: Column) -> Column:
    return parsed.isNotNull() & (F.coalesce(parsed["summary"], F.lit("")) != "")


def best_replies(outputs: DataFrame, attempts: int = ATTEMPTS, told_in: str = "summary") -> DataFrame:
    """Recorded replies (run_id, artifact_seq, chunk_index, agent, attempt from 1, raw_text) to one for each task: the first that is valid JSON with a text in told_in, else the last; tries: how many it took."""
    key = ["run_id", "artifact_seq", "chunk_index", "agent"]
    if "attempt" not in outputs.columns:
        return outputs.select(*key, "raw_text").withColumn("tries", F.lit(1))
    told = F.get_json_object(extract_json("raw_text"), f"$.{told_in}")
    seen = outputs.where(F.col("attempt") <= attempts).select(*key, "attempt", "raw_text", told.alias("told"))
    # one number places an attempt: good ones first, in order, then the others, the last first; tasks are dealt out before they are sorted
    place = F.when(F.coalesce("told", F.lit("")) != "", F.col("attempt").cast("long")).otherwise(F.lit(1 << 32) - F.col("attempt"))
    ranked = seen.select(*key, "attempt", "raw_text", place.alias("place")).withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy("place")))
    return ranked.where("_n = 1").select(*key, "raw_text", F.col("attempt").alias("tries"))


def system_prompt(mission: Column, contract: Column, attempt: Column) -> Column:
    """What an agent is told beside its task; from the second attempt on with the hint that its reply could not be read."""
    rules = F.lit("Return only one valid JSON object.\nDo not wrap the JSON in markdown fences.\nDo not add explanations before or after the JSON.")
    return F.concat(F.concat_ws("\n", mission, rules, contract), F.when(attempt > 1, REPAIR).otherwise(""))


def prompts(rows: DataFrame, artifacts: DataFrame, memo_rows: DataFrame | None = None, primers: DataFrame | None = None, retrieved: DataFrame | None = None) -> DataFrame:
    """Tasks with prompt, the text that each agent is given.

    artifacts: run_id, artifact_seq, url, type, discovered_from, formatting_note, target_url; memo_rows: memos of earlier agents;
    primers: run_id, artifact_seq, primer; retrieved: run_id, artifact_seq, chunk_index, agent, segments.
    """
    key = ["run_id", "artifact_seq", "chunk_index"]
    count = rows.groupBy("run_id", "artifact_seq").agg((F.max("chunk_index") + 1).alias("chunk_count"))
    met = rows.join(artifacts.select("run_id", "artifact_seq", "url", "type", "discovered_from", "formatting_note", "target_url"), ["run_id", "artifact_seq"]).join(count, ["run_id", "artifact_seq"])
    if memo_rows is not None:
        own = memo_rows.select(*key, "agent_ord", F.concat(F.lit('"'), "agent", F.lit('":'), F.to_json("memo")).alias("said"))
        said = own.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("agent_ord", "said"))).alias("said"))
        met = met.join(said, key, "left")
        earlier = F.transform(F.filter(F.coalesce("said", F.array().cast("array<struct<agent_ord:int,said:string>>")), lambda x: x["agent_ord"] < F.col("agent_ord")), lambda x: x["said"])
        memory = F.concat(F.lit("{"), F.array_join(earlier, ","), F.lit("}"))
    else:
        memory = F.lit("{}")
    met = met.withColumn("memory", pretty_json(memory))
    met = met.join(primers, ["run_id", "artifact_seq"], "left") if primers is not None else met.withColumn("primer", F.lit(None).cast("string"))
    met = met.join(retrieved, [*key, "agent"], "left") if retrieved is not None else met.withColumn("segments", F.lit(None).cast("array<string>"))
    primer = F.when((F.col("chunk_index") > 0) & F.col("primer").isNotNull(), F.concat(F.lit("Artifact primer from earlier chunk(s):\n"), "primer")).otherwise("Artifact primer from earlier chunk(s): none")
    segment = F.array_join(F.transform("segments", lambda x, i: F.concat(F.lit("Segment "), (i + 1).cast("string"), F.lit(":\n"), x)), "\n\n")
    evidence = F.when(F.size(F.coalesce("segments", F.array().cast("array<string>"))) > 0, F.concat(F.lit("Local RAG evidence:\n"), segment)).otherwise("Local RAG evidence: none")
    lines = [
        F.concat(F.lit("Target page: "), "target_url"), F.concat(F.lit("Artifact URL: "), "url"), F.concat(F.lit("Artifact type: "), "type"), F.concat(F.lit("Discovered from: "), "discovered_from"),
        F.concat(F.lit("Chunk "), (F.col("chunk_index") + 1).cast("string"), F.lit(" of "), F.col("chunk_count").cast("string")), F.concat(F.lit("Formatting note: "), F.coalesce(F.nullif("formatting_note", F.lit("")), F.lit("none"))),
        primer, F.concat(F.lit("Swarm memory:\n"), "memory"), evidence, F.lit("Artifact content:"), F.lit("```text"), F.col("chunk"), F.lit("```"),
    ]
    return met.select(*key, "agent_ord", "agent", F.concat_ws("\n\n", *lines).alias("prompt"))


def retrieved_segments(rows: DataFrame, artifacts: DataFrame) -> DataFrame:
    """For each task the segments of its artifact that its query finds: run_id, artifact_seq, chunk_index, agent, segments."""
    segs = segment_rows(artifacts, "content", "run_id", "artifact_seq")
    # a chunk may be longer than a segment, so its beginning tells the segment that has it
    asked = retrieval_queries(rows).withColumns({"query_id": F.struct("chunk_index", "agent"), "exclude": F.substring("exclude", 1, EXCLUDE_CHARS)})
    found = with_segments(top_segments(segs, asked, "run_id", "artifact_seq"), segs, "run_id", "artifact_seq")
    lists = found.groupBy("run_id", "artifact_seq", "query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "segment"))), lambda x: x["segment"]).alias("segments"))
    return lists.select("run_id", "artifact_seq", "query_id.chunk_index", "query_id.agent", "segments")


def primers(analyses: DataFrame, artifacts: DataFrame) -> DataFrame:
    """What later chunks are told of an artifact's first: run_id, artifact_seq, primer."""
    first = analyses.where("chunk_index = 0").join(artifacts.select("run_id", "artifact_seq", "priority"), ["run_id", "artifact_seq"])
    told = F.struct("priority", F.col("summary").alias("firstChunkSummary"), "entryPoints", "notableLibraries", "risks")
    return first.select("run_id", "artifact_seq", F.to_json(told).alias("primer"))


def memos(rows: DataFrame, outputs: DataFrame) -> DataFrame:
    """Tasks of all agents but the last with their reply (run_id, artifact_seq, chunk_index, agent, raw_text) as a memo, or a memo that says it failed."""
    met = rows.where("agent <> 'synthesizer'").join(best_replies(outputs).hint("merge"), ["run_id", "artifact_seq", "chunk_index", "agent"], "left")
    met = met.withColumn("parsed", F.from_json(extract_json("raw_text"), MEMO))
    failed = F.struct(F.col("agent").alias("role"), F.concat("agent", F.lit(" agent failed after retries: no valid reply")).alias("summary"), F.array().cast("array<string>").alias("observations"), F.array().cast("array<string>").alias("evidence"), F.array(F.concat(F.lit("Retry "), "agent", F.lit(" analysis for this chunk manually if the finding is important."))).alias("nextQuestions"))
    return met.withColumn("failed", ~valid(F.col("parsed"))).withColumn("memo", F.when(valid(F.col("parsed")), F.col("parsed")).otherwise(failed)).drop("parsed", "raw_text", "tries")


def chunk_analyses(rows: DataFrame, memo_rows: DataFrame, outputs: DataFrame) -> DataFrame:
    """The last agent's reply for each chunk; without a valid one, an empty analysis whose summary is that of the memos that were given."""
    key = ["run_id", "artifact_seq", "chunk_index"]
    given = F.when(~F.col("failed"), F.struct("agent_ord", F.trim("memo.summary").alias("s")))
    told = memo_rows.groupBy(*key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(given)), lambda x: x["s"]), " ").alias("told"))
    last = rows.where("agent = 'synthesizer'").join(best_replies(outputs).hint("merge"), [*key, "agent"], "left").withColumn("parsed", F.from_json(extract_json("raw_text"), CHUNK)).join(told, key, "left")
    ok = valid(F.col("parsed"))
    summary = F.when(ok, F.col("parsed.summary")).otherwise(F.coalesce(F.nullif("told", F.lit("")), F.lit(NO_REPLY)))
    lists = {f: F.when(ok, F.coalesce(F.col(f"parsed.{f}"), F.array())).otherwise(F.array()) for f in LISTS}
    return last.select(*key, (~ok).alias("fell_back"), summary.alias("summary"), *(c.alias(n) for n, c in lists.items()))


LISTS = ("entryPoints", "initializationFlow", "callGraph", "restoredNames", "notableLibraries", "investigationTips", "risks")
FINAL = CHUNK.replace("summary:string", "overview:string")


def final_analysis(replies: DataFrame, agent: str = "final") -> DataFrame:
    """What the lead agent's recorded reply for a whole run says, where it is valid: run_id, overview, and the lists of a chunk's analysis."""
    said = best_replies(replies.where(F.col("agent") == agent), told_in="overview").withColumn("p", F.from_json(extract_json("raw_text"), FINAL))
    said = said.where(F.coalesce("p.overview", F.lit("")) != "")
    return said.select("run_id", F.lit(0).cast("long").alias("artifact_seq"), F.lit(0).alias("chunk_index"), "p.overview", *(F.coalesce(f"p.{f}", F.array()).alias(f) for f in LISTS))


def keyed(analyses: DataFrame) -> DataFrame:
    """Chunk analyses with each list as (key, value): what ``run.merged_analysis`` merges first-wins."""
    entry = lambda column, key: F.transform(column, lambda x: F.struct(key(x).alias("key"), F.to_json(x).alias("value")))
    plain = lambda column: F.transform(column, lambda x: F.struct(x.alias("key"), x.alias("value")))
    return analyses.select(
        "run_id", "artifact_seq", "chunk_index", entry("entryPoints", lambda x: F.concat_ws(":", x["symbol"], x["description"])).alias("entryPoints"), plain("initializationFlow").alias("initializationFlow"),
        entry("callGraph", lambda x: F.concat_ws("->", x["caller"], x["callee"])).alias("callGraph"), entry("restoredNames", lambda x: F.concat_ws(":", x["originalName"], x["suggestedName"])).alias("restoredNames"),
        plain("notableLibraries").alias("notableLibraries"), plain("investigationTips").alias("investigationTips"), plain("risks").alias("risks"),
    )


def retrieval_queries(rows: DataFrame, memory: str | None = None) -> DataFrame:
    """What an agent asks the index: its keywords, the chunk and the memory so far; the chunk itself is not wanted back."""
    words = F.create_map(*(F.lit(x) for pair in KEYWORDS.items() for x in pair))[F.col("agent")]
    parts = [words, F.col("chunk"), F.col(memory) if memory else F.lit("")]
    return rows.withColumn("query", F.substring(F.concat_ws(" ", *parts), 1, QUERY_CHARS)).withColumn("exclude", F.col("chunk"))

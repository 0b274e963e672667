"""Analysis skeleton over recorded agent replies: tasks, summaries, merged snapshot, graph nodes, relations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.functions.text import file_name, preview, report_tokens
from sparkloom.functions.urls import host
from sparkloom.operators import ordered

GROUPS = ("entry", "restored", "function", "opaque")
MAX_NODES = 220


def merge_first(rows: DataFrame) -> DataFrame:
    """run_id, kind, artifact_seq, chunk_index, pos, key, value: first of each key in a run and kind, ranked in order."""
    order = [F.col(c) for c in ("artifact_seq", "chunk_index", "pos")]
    once = ordered.first_wins(rows, ["run_id", "kind", "key"], order)
    return once.withColumn("rank", F.row_number().over(Window.partitionBy("run_id", "kind").orderBy(*order, "key")))


def artifact_summaries(chunks: DataFrame) -> DataFrame:
    """A summary for each artifact: its chunks' summaries in order, joined by spaces."""
    return chunks.groupBy("run_id", "artifact_seq").agg(F.array_join(ordered.ordered_list(F.col("chunk_index"), F.col("summary")), " ").alias("summary"))


def primer(chunks: DataFrame) -> DataFrame:
    """Each chunk with the summary of its artifact's first chunk, for all but that chunk."""
    first = F.first("summary").over(Window.partitionBy("run_id", "artifact_seq").orderBy("chunk_index"))
    return chunks.withColumn("primer", F.when(F.col("chunk_index") > 0, first))


def agent_memory(outputs: DataFrame) -> DataFrame:
    """Each agent's reply with those of the agents before it on the same chunk, in order."""
    before = Window.partitionBy("run_id", "artifact_seq", "chunk_index").orderBy("agent_ord").rowsBetween(Window.unboundedPreceding, -1)
    return outputs.withColumn("memory", F.collect_list("reply").over(before))


def graph_nodes(mentions: DataFrame) -> DataFrame:
    """run_id, type, seq, id, meta: entries (last meta wins), restored and opaque names, functions (first wins), placed in columns.

    A node keeps the place where it was first mentioned; entries come first, then renames, then calls.
    """
    rank = F.array_position(F.array(F.lit("entry"), F.lit("rename"), F.lit("call")), F.col("stage"))
    rows = mentions.withColumn("stage", F.when(F.col("type") == "entry", "entry").when(F.col("type") == "function", "call").otherwise("rename")).withColumn("o", F.struct(rank.alias("stage"), F.col("seq")))
    is_entry = F.col("type") == "entry"
    nodes = rows.groupBy("run_id", "id").agg(
        F.min("o").alias("o"), F.min_by("type", "o").alias("type"),
        F.coalesce(F.max_by(F.when(is_entry, F.col("meta")), F.when(is_entry, F.col("o"))), F.min_by("meta", "o")).alias("meta"),
    )
    nodes = ordered.cap(nodes, ["run_id"], [F.col("o")], MAX_NODES)
    y = F.row_number().over(Window.partitionBy("run_id", "type").orderBy("rank")) - 1
    column = F.array_position(F.array(*map(F.lit, GROUPS)), F.col("type")) - 1
    return nodes.select("run_id", "rank", "id", "type", "meta", (F.lit(120) + column * 210).cast("long").alias("x"), (F.lit(44) + y * 48).cast("long").alias("y"))


#: Letters of a name that it is looked for by.
GRAM = 3


def _grams(text: Column, size: Column) -> Column:
    """The different pieces of so many characters of a text; of no characters, the empty one."""
    places = F.when(F.length(text) >= size, F.sequence(F.lit(1), F.length(text) - size + 1)).otherwise(F.array().cast("array<int>"))
    return F.when(size == 0, F.array(F.lit(""))).otherwise(F.array_distinct(F.transform(places, lambda at: F.substr(text, at, size))))


def artifact_relations(artifacts: DataFrame, names: DataFrame, most: int = 10) -> DataFrame:
    """Which of a run's names (run_id, name_seq, name) an artifact's summary or URL tells of, of the first ten that do.

    A name is told of as a token of either, whatever its case, or anywhere in the summary. Neither compares all names with all
    artifacts: tokens meet lower-cased names by a join, and a name is looked for in the summaries that hold the rarest of its pieces of three
    letters (or its own length), by an index of those, and only there compared. A name of which some piece is nowhere is done.
    """
    text = artifacts.select("run_id", "artifact_seq", "url", F.coalesce("summary", F.lit("")).alias("summary"))
    names = names.where("name is not null").select("run_id", "name_seq", "name", F.least(F.length("name"), F.lit(GRAM)).alias("size"))
    tokens = text.select("run_id", "artifact_seq", F.explode(F.array_distinct(F.concat(report_tokens(F.col("summary")), report_tokens(F.col("url"))))).alias("low"))
    by_token = tokens.join(names.withColumn("low", F.lower("name")), ["run_id", "low"]).select("run_id", "artifact_seq", "name_seq", "name")
    index = text.join(names.select("run_id", "size").distinct(), "run_id").select("run_id", "artifact_seq", F.explode(_grams(F.col("summary"), F.col("size"))).alias("gram"))
    often = index.groupBy("run_id", "gram").agg(F.count(F.lit(1)).alias("n"))
    pieces = names.select("run_id", "name_seq", "name", F.explode(_grams(F.col("name"), F.col("size"))).alias("gram")).join(often, ["run_id", "gram"], "left")
    rarest = pieces.groupBy("run_id", "name_seq", "name").agg(F.count_if(F.col("n").isNull()).alias("nowhere"), F.min_by("gram", F.struct("n", "gram")).alias("gram")).where("nowhere = 0")
    held = rarest.join(index, ["run_id", "gram"]).join(text.select("run_id", "artifact_seq", "summary"), ["run_id", "artifact_seq"]).where(F.col("summary").contains(F.col("name")))
    told = by_token.union(held.select("run_id", "artifact_seq", "name_seq", "name")).distinct()
    first = ordered.cap(told, ["run_id", "artifact_seq"], [F.col("name_seq"), F.col("name")], most)
    return first.groupBy("run_id", "artifact_seq").agg(F.array_distinct(ordered.ordered_list(F.col("rank"), F.col("name"))).alias("names"))


def node_artifacts(nodes: DataFrame, artifacts: DataFrame, relations: DataFrame, most: int = 8) -> DataFrame:
    """nodes with artifact_urls: the first artifacts, in their order, that tell of the node."""
    by_name = relations.select("run_id", "artifact_seq", F.explode("names").alias("id")).join(artifacts.select("run_id", "artifact_seq", "url"), ["run_id", "artifact_seq"])
    first = ordered.cap(by_name, ["run_id", "id"], [F.col("artifact_seq")], most, "nth")
    urls = first.groupBy("run_id", "id").agg(ordered.ordered_list(F.col("nth"), F.col("url")).alias("artifact_urls"))
    return nodes.join(urls, ["run_id", "id"], "left").withColumn("artifact_urls", F.coalesce("artifact_urls", F.array().cast("array<string>")))


def manifest(artifacts: DataFrame, summaries: DataFrame, relations: DataFrame) -> DataFrame:
    """artifacts as a report lists them: number, previews, the summary of the first artifact of that URL, and the names it tells of."""
    by_url = ordered.first_wins(summaries.join(artifacts.select("run_id", "artifact_seq", "url"), ["run_id", "artifact_seq"]), ["run_id", "url"], [F.col("artifact_seq")]).select("run_id", "url", "summary")
    met = artifacts.drop("summary").join(by_url, ["run_id", "url"], "left").join(relations, ["run_id", "artifact_seq"], "left")
    number = F.row_number().over(Window.partitionBy("run_id").orderBy("artifact_seq"))
    return met.select(
        "run_id", "artifact_seq", F.concat(F.lit("artifact-"), number.cast("string")).alias("id"), "url", "type", "size_bytes", "discovered_from", F.when(F.col("formatting_skipped"), "fallback").otherwise("formatted").alias("formatting"),
        "formatting_note", preview(F.col("content")).alias("raw_preview"), preview(F.col("formatted_content")).alias("formatted_preview"), F.coalesce("names", F.array().cast("array<string>")).alias("related_names"), F.coalesce("summary", F.lit("")).alias("summary"),
    )


def sorted_catalog(models: DataFrame) -> DataFrame:
    """Models in the order of their ids as people sort them: letters before their case."""
    return models.orderBy(F.collate("id", "UNICODE"))


def flow_relations(flow_urls: DataFrame, endpoints: DataFrame) -> DataFrame:
    """run_id, seq, url of a flow to the source artifact of that endpoint, the last one listed."""
    source = ordered.last_wins(endpoints, ["run_id", "url"], "source_artifact_url", F.col("rank"))
    return flow_urls.join(source, ["run_id", "url"])


def merge_catalog(curated: DataFrame, fetched: DataFrame) -> DataFrame:
    """Models by id: fetched values first, curated ones where those are missing; of a repeated fetched id the last."""
    last = fetched.groupBy("id").agg(F.max_by(F.struct("label", "context"), "seq").alias("f")).select("id", "f.*")
    both = curated.alias("c").join(last.alias("f"), "id", "full")
    return both.select("id", F.coalesce("f.label", "c.label").alias("label"), F.coalesce("f.context", "c.context").alias("context"))


def manifest_name(seq: Column, url: Column, type_: Column) -> Column:
    last = F.element_at(F.split(F.regexp_replace(F.regexp_extract(url, r"^[^?#]*", 0), "/+$", ""), "/"), -1)
    path = F.regexp_extract(url, r"^[a-z]+://[^/?#]*/+([^?#]*)", 1)
    name = F.when(path == "", type_).otherwise(F.coalesce(F.nullif(last, F.lit("")), type_))
    digits = seq.cast("string")  # three at least; lpad alone would cut longer ones
    return F.concat(file_name(F.concat_ws("-", F.lpad(digits, F.greatest(F.lit(3), F.length(digits)), F.lit("0")), host(url), name)), F.lit(".txt"))


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)

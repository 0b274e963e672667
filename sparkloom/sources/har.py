"""A source of recorded browser sessions: HAR captures as tables of responses, posts and requests.

    spark.read.format("sparkloom_har").option("table", "responses").load(FOLDER)

A partition is a file, so a folder of captures is read by as many tasks, and the driver only lists names. Paths may be URIs of shared
stores. ``columns`` (comma-separated) leaves all other columns null before anything is decoded; ``har`` gives tables of a folder with only the columns asked for.

responses: run_id, url, status, content_type, body (text) or body_bytes (binary bodies), of GET requests, the last of a URL within a
capture; posts: run_id, url, status, body, of POST requests; requests: run_id, seq, url, method, resource_type, status, content_type, content_length,
request_body_snippet, response_body, in the order of the capture. run_id is the capture's place in the sorted list of files, from 1; an
entry without a URL is left out; a file that is no capture is an error that names it.
"""

from __future__ import annotations

import base64
import json
import posixpath

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from sparkloom.sources.files import store_of

SCHEMAS = {
    "responses": "run_id long, url string, status int, content_type string, body string, body_bytes binary",
    "posts": "run_id long, url string, status int, body string",
    "requests": "run_id long, seq long, url string, method string, resource_type string, status int, content_type string, content_length long, request_body_snippet string, response_body string",
}
TEXTUAL = ("text/", "json", "javascript", "ecmascript", "xml", "html", "x-www-form-urlencoded")


class Capture(InputPartition):
    def __init__(self, run_id: int, path: str):
        self.run_id, self.path = run_id, path


def body_of(content: dict, kind: str) -> tuple[str | None, bytes | None]:
    """(text, bytes) of a recorded body: one of them, or none where nothing was recorded."""
    text = content.get("text")
    if text is None:
        return None, None
    if content.get("encoding") != "base64":
        return text, None
    raw = base64.b64decode(text)
    return (raw.decode("utf-8", "replace"), None) if any(t in kind for t in TEXTUAL) else (None, raw)


def entries(capture: dict):
    """(seq, request, response) of a capture."""
    for seq, e in enumerate(capture["log"]["entries"], 1):
        request, response = e.get("request") or {}, e.get("response") or {}
        if request.get("url"):
            yield seq, e, request, response


def _rows(table: str, run_id: int, capture: dict, wanted: set[str]):
    last = {}
    for seq, entry, request, response in entries(capture):
        content = response.get("content") or {}
        kind = (content.get("mimeType") or "").strip()
        method = (request.get("method") or "GET").upper()
        row = {"run_id": run_id, "seq": seq, "url": request["url"], "method": method, "status": response.get("status") or None, "content_type": kind or None, "resource_type": entry.get("_resourceType")}
        if {"body", "body_bytes", "response_body"} & wanted:
            row["body"], row["body_bytes"] = body_of(content, kind.lower())
            row["response_body"] = row["body"]
        size = content.get("size")
        row |= {"content_length": size if isinstance(size, int) and size >= 0 else None, "request_body_snippet": (request.get("postData") or {}).get("text")}
        if table == "responses" and method == "GET":
            last[row["url"]] = row
        elif table == "requests" or table == "posts" and method == "POST":
            yield row
    yield from last.values()


class Reader(DataSourceReader):
    def __init__(self, root: str, table: str, names: list[str], wanted: set[str]):
        self.root, self.table, self.names, self.wanted = root, table, names, wanted

    def partitions(self) -> list[Capture]:
        from pyarrow import fs

        store, root = store_of(self.root)
        info = store.get_file_info(root)
        found = [root] if info.type == fs.FileType.File else [f.path for f in store.get_file_info(fs.FileSelector(root)) if f.type == fs.FileType.File and f.base_name.endswith(".har")]
        return [Capture(k, path) for k, path in enumerate(sorted(found), 1)]

    def read(self, partition: Capture):
        store, _ = store_of(self.root)
        try:
            with store.open_input_stream(partition.path) as f:
                capture = json.loads(f.read().decode("utf-8-sig"))
            for row in _rows(self.table, partition.run_id, capture, self.wanted):
                yield tuple(row.get(c) if c in self.wanted else None for c in self.names)
        except (ValueError, KeyError, TypeError, AttributeError) as why:
            raise ValueError(f"no capture: {posixpath.basename(partition.path)}: {why}") from why


class Har(DataSource):
    @classmethod
    def name(cls) -> str:
        return "sparkloom_har"

    def _table(self) -> str:
        table = self.options.get("table", "responses")
        if table not in SCHEMAS:
            raise ValueError(f"no table {table} in a capture, but {', '.join(SCHEMAS)}")
        return table

    def schema(self) -> str:
        return SCHEMAS[self._table()]

    def reader(self, schema) -> Reader:
        names = schema.names
        asked = {c.strip() for c in self.options.get("columns", "").split(",") if c.strip()}
        return Reader(self.options["path"], self._table(), names, asked & {*names} if asked else {*names})


def har(spark: SparkSession, path: str, table: str, columns: list[str] | None = None) -> DataFrame:
    """A table of the captures in a folder, or of one file; with columns only these, and no body is decoded that none of them needs."""
    spark.dataSource.register(Har)
    read = spark.read.format(Har.name()).option("table", table)
    if columns:
        return read.option("columns", ",".join(columns)).load(path).select(*columns)
    return read.load(path)


def entry_urls(spark: SparkSession, path: str) -> DataFrame:
    """roots of a folder of captures: run_id and the first URL that each one asked for."""
    from pyspark.sql import functions as F

    return har(spark, path, "requests", ["run_id", "seq", "url"]).groupBy("run_id").agg(F.min_by("url", "seq").alias("url"))

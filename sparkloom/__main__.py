"""Runs from the command line: ``python -m sparkloom --url URL --responses DIR [--requests DIR] ...`` for one site, or
``--roots DIR --output DIR`` for a table of them (run_id, url); tables are Parquet. ``--captures DIR --output DIR`` takes a folder of HAR
captures instead, each a run of the first page that it asked for."""

from __future__ import annotations

import sys

from pyspark.sql import SparkSession

from sparkloom.plans import options, run
from sparkloom.plans.run import EntryError
from sparkloom.sources.har import entry_urls, har
from sparkloom.sources.store import keep

TABLES = ("responses", "posts", "requests", "session", "replies", "roots")


def parser():
    p = options.parser()
    p.add_argument("--config", help="file of saved options")
    for name in TABLES:
        p.add_argument(f"--{name}", help=f"Parquet table of recorded {name}")
    p.add_argument("--captures", help="folder of HAR captures, in place of tables and a URL")
    return p


def summary(got: dict, files: list) -> str:
    """What a run ends with on a terminal."""
    count = lambda key: len(got.get(key) or [])
    facts = {
        "Status": got["status"], "Target": got["url"], "Browser trace": got["metadata"]["browserTraceStatus"], "Pages": count("html_pages"), "Artifacts": count("artifacts"), "Chunks analyzed": got["analyzed_chunks"],
        "REST endpoints": count("api_endpoints"), "GraphQL endpoints": count("graphql_endpoints"), "Auth flows": count("auth_flows"), "Captcha flows": count("captcha_flows"), "Fingerprinting signals": count("fingerprint_signals"),
        "Encryption signals": count("encryption_signals"), "Analysis error": got["error"], "Report": files[0],
    }
    return "\n".join(f"{k}: {v}" for k, v in facts.items() if v is not None)


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    given = vars(parser().parse_args(argv))
    paths, config, captures = {name: given.pop(name) for name in TABLES}, given.pop("config"), given.pop("captures")
    chosen = options.resolved(given, options.read_config(config) if config else None)
    many = captures or paths["roots"]
    if (chosen.url is None) != bool(many) or many and not chosen.output or (captures is None) == (paths["responses"] is None):
        print("a URL is needed, or a table of roots and an output folder, with a table of responses; or a folder of captures and an output folder", file=sys.stderr)
        return 2
    spark = spark or SparkSession.builder.appName("sparkloom").getOrCreate()
    tables = {name: spark.read.parquet(path) for name, path in paths.items() if path}
    if captures:
        recorded = {name: keep(har(spark, captures, name), name) for name in ("responses", "posts", "requests")}
        recorded["responses"] = recorded["responses"].dropDuplicates(["url"])
        tables = recorded | {"roots": entry_urls(spark, captures)} | tables
    try:
        done = run.analyse(chosen, tables.pop("responses"), **tables)
    except EntryError as why:
        print(why, file=sys.stderr)
        return 1
    if many:
        done.write_all(chosen.output)
        lost = done.missing.count()
        print(f"Runs: {done.roots.count()}\nEntry pages not fetched: {lost}\nReports: {chosen.output}")
        return 1 if lost else 0
    got = done.collect()
    print(summary(got, done.write()))
    return 1 if got["status"] == "partial" else 0


if __name__ == "__main__":
    sys.exit(main())

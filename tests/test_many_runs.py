"""Many sites in one call, the files sink, and what a rerun replaces."""

import json
import os
import re
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from sparkloom.plans import run
from sparkloom.plans.options import Options
from sparkloom.sources.files import MARK, Writer, write_files

RESPONSES = "url string, status int, content_type string, body string, body_bytes binary"
SITES = [f"https://s{k}.example.com/login.html" for k in (1, 2)]


def site(k, extra=""):
    root = f"https://s{k}.example.com"
    page = f'<title>Login {k}</title><form action="/session"><input name=p type=password></form><script src="/app.js"></script>'
    return [(f"{root}/login.html", 200, "text/html", page, None), (f"{root}/app.js", 200, "application/javascript", f'fetch("/api/auth/{k}"); const g = "/graphql"; query Q{k} {{ a }} navigator.userAgent; turnstile{extra}', None)]


def test_two_sites_equal_two_runs(spark, tmp_path):
    frame = spark.createDataFrame(site(1) + site(2), RESPONSES)
    roots = spark.createDataFrame([(7, SITES[0]), (8, SITES[1]), (9, "https://s3.example.com/")], "run_id long, url string")
    both = run.analyse(Options(), frame, roots=roots)
    assert [tuple(r) for r in both.missing.collect()] == [(9, "https://s3.example.com/", None)]
    both.write_all(str(tmp_path / "all"))
    for run_id, url in ((7, SITES[0]), (8, SITES[1])):
        alone = run.analyse(Options(url=url), frame)
        assert both.collect(run_id) == alone.collect()
        files = alone.write(str(tmp_path / f"one{run_id}"))
        at = tmp_path / f"all/run_id={run_id}"
        assert {str(p.relative_to(tmp_path / f"one{run_id}")) for p in files} == {str(p.relative_to(at)) for p in at.rglob("*") if p.is_file() and p.name != MARK}
        text = lambda p: re.sub(r"\d{4}-\d\d-\d\dT[\d:.+]*", "now", p.read_text())
        for p in files:
            assert text(p) == text(at / p.relative_to(tmp_path / f"one{run_id}"))
    # a rerun of one run replaces that run alone
    (tmp_path / "all/run_id=7/extra.txt").write_text("old")
    before = (tmp_path / "all/run_id=8/report.md").stat().st_mtime_ns
    again = run.analyse(Options(), spark.createDataFrame(site(1, " expired")[:1] + site(2), RESPONSES), roots=roots.where("run_id = 7"))
    again.write_all(str(tmp_path / "all"))
    assert not (tmp_path / "all/run_id=7/extra.txt").exists() and (tmp_path / "all/run_id=8/report.md").stat().st_mtime_ns == before
    ends = spark.read.parquet(str(tmp_path / "all/tables/api_endpoints"))
    assert {r.run_id for r in ends.select("run_id").collect()} == {8}  # run 7 has no script now, and no endpoint
    assert json.loads((tmp_path / "all/run_id=7/artifacts/index.json").read_text()) == []


def test_sites_of_the_command_line(spark, tmp_path, capsys):
    from sparkloom.__main__ import main

    spark.createDataFrame(site(1) + site(2), RESPONSES).write.parquet(f"{tmp_path}/r")
    spark.createDataFrame([(1, SITES[0]), (2, SITES[1])], "run_id long, url string").write.parquet(f"{tmp_path}/roots")
    assert main(["--roots", f"{tmp_path}/roots", "--responses", f"{tmp_path}/r"], spark) == 2
    assert main(["--roots", f"{tmp_path}/roots", "--responses", f"{tmp_path}/r", "--output", f"{tmp_path}/o"], spark) == 0
    assert "Runs: 2" in capsys.readouterr().out and (tmp_path / "o/run_id=2/report.html").exists()


# --- the sink


def names(root):
    return {str(p.relative_to(root)) for p in Path(root).rglob("*") if p.is_file() and p.name != MARK}


FILES = "folder string, name string, content string"


def test_files_are_whole_and_in_many_tasks(spark, tmp_path):
    df = spark.range(40).select(F.concat(F.lit("f"), (F.col("id") % 3).cast("string")).alias("folder"), F.concat(F.lit("a/b"), F.col("id").cast("string")).alias("name"), F.repeat(F.lit("é"), 50_000).alias("content"))
    write_files(df, str(tmp_path / "o"), 500_000_000)
    assert len(names(tmp_path / "o")) == 40 and all((tmp_path / "o" / n).read_text() == "é" * 50_000 for n in names(tmp_path / "o"))
    assert not [p for p in (tmp_path / "o").iterdir() if p.name.startswith(".")]


def test_folders_of_this_sink_are_replaced_and_others_kept(spark, tmp_path):
    put = lambda rows: write_files(spark.createDataFrame(rows, FILES), str(tmp_path))
    (tmp_path / "mine").mkdir()
    (tmp_path / "mine/x").write_text("not the sink's")
    put([("a", "1", "one"), ("b", "1", None), ("mine", "1", "y")])
    put([("a", "2", "two"), ("a", "2", "two")])
    assert names(tmp_path) == {"a/2", "b/1", "mine/x", "mine/1"} and (tmp_path / "b/1").read_text() == ""


@pytest.mark.parametrize("row", [("..", "x", ""), ("a", "../x", ""), ("a/b", "x", ""), (None, "x", ""), ("a", None, ""), ("a", "/etc/x", "")])
def test_names_stay_in_their_folder(spark, tmp_path, row):
    with pytest.raises(Exception, match="no file of a folder"):
        write_files(spark.createDataFrame([row], FILES), str(tmp_path / "o"))
    assert not names(tmp_path) and not [p for p in tmp_path.rglob("*") if "staging" in p.name]


def test_a_failed_and_repeated_task_leaves_no_half_files(tmp_path):
    """The first attempt stops within its second file, as if its executor were lost."""
    import pyarrow as pa

    writer = Writer(str(tmp_path))
    batch = lambda rows: pa.RecordBatch.from_pylist([dict(zip(("folder", "name", "content"), r, strict=True)) for r in rows])

    class Lost(Exception):
        pass

    def stops():
        yield batch([("a", "1", "one")])
        raise Lost

    with pytest.raises(Lost):
        writer.write(stops())
    assert names(tmp_path) == {f"{writer.staging}/folders/a/1"}  # nothing is in place before the commit
    done = writer.write(iter([batch([("a", "1", "one"), ("a", "2", "two")])]))
    writer.commit([done])
    assert names(tmp_path) == {"a/1", "a/2"} and done.files == 2 and os.listdir(tmp_path) == ["a"]
    other = Writer(str(tmp_path))
    other.write(iter([batch([("a", "1", "new")])]))
    other.abort([])
    assert names(tmp_path) == {"a/1", "a/2"} and (tmp_path / "a/1").read_text() == "one"

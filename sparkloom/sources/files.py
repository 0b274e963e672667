"""A sink of named files: a row is a file, written by executors, a folder at a time put in place.

    df.write.format("sparkloom_files").mode("append").option("path", ROOT).save()      # df: folder, name, content (text or bytes)

Each task writes its files beside the target and renames them into the staged folder, whole; a failed and repeated task writes the same
names again, so no half file is ever seen. When all tasks are done the commit puts staged folders in place with one rename each. A
folder that this sink wrote before is replaced, others at ROOT stay, so a rerun replaces its own runs only; a folder of someone else's
files is added to. A job that fails leaves ROOT as it was. ROOT is a place that the driver and all executors share and that has
renames (a network file system, HDFS), as a path or URI.

Defined cases: a null name or folder is an error, as is a name that leaves its folder; null content is an empty file; of rows with one
folder and name one stays; without rows nothing changes.
"""

from __future__ import annotations

import posixpath
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

MARK = ".sparkloom-files"
STAGING = ".sparkloom-staging"
#: A task takes files of about so many bytes together, as their rows come to its worker at once.
TASK_BYTES = 32_000_000


def store_of(root: str):
    """(file system, path) of a path or URI."""
    from pyarrow import fs

    if "://" in root:
        return fs.FileSystem.from_uri(root)
    return fs.LocalFileSystem(), posixpath.abspath(root)


def _inside(folder: str | None, name: str | None) -> str:
    parts = [*(folder or "").split("/"), *(name or "").split("/")]
    if not folder or not name or "/" in folder or any(p in ("", ".", "..") for p in parts):
        raise ValueError(f"no file of a folder: {folder!r}, {name!r}")
    return f"{folder}/{name}"


@dataclass
class Written(WriterCommitMessage):
    files: int
    size: int


class Writer(DataSourceArrowWriter):
    def __init__(self, root: str):
        self.root = root
        self.staging = f"{STAGING}-{uuid.uuid4().hex}"

    def write(self, batches) -> Written:
        store, root = store_of(self.root)
        own, n, size = f"{root}/{self.staging}/task-{uuid.uuid4().hex}", 0, 0
        store.create_dir(own)
        made: set[str] = set()
        for batch in batches:
            for row in range(batch.num_rows):  # one file is held beside its batch
                folder, name, content = (batch.column(c)[row].as_py() for c in ("folder", "name", "content"))
                data = content.encode() if isinstance(content, str) else content or b""
                at = f"{root}/{self.staging}/folders/{_inside(folder, name)}"
                if (above := posixpath.dirname(at)) not in made:
                    store.create_dir(above)
                    made.add(above)
                with store.open_output_stream(f"{own}/{n}") as out:
                    out.write(data)
                store.move(f"{own}/{n}", at)
                n, size = n + 1, size + len(data)
        store.delete_dir(own)
        return Written(n, size)

    def commit(self, messages: list[Written | None]) -> None:
        from pyarrow import fs

        store, root = store_of(self.root)
        staged = f"{root}/{self.staging}"
        base = f"{staged}/folders"
        if store.get_file_info(base).type != fs.FileType.NotFound:
            for folder in store.get_file_info(fs.FileSelector(base)):
                self._place(store, folder.path, f"{root}/{folder.base_name}", f"{staged}/old-{folder.base_name}")
        self._gone(store, staged)

    def _place(self, store, new: str, at: str, aside: str) -> None:
        from pyarrow import fs

        with store.open_output_stream(f"{new}/{MARK}") as out:
            out.write(b"")
        there = store.get_file_info(at).type != fs.FileType.NotFound
        if there and store.get_file_info(f"{at}/{MARK}").type == fs.FileType.NotFound:  # not ours: nothing of it goes
            for file in store.get_file_info(fs.FileSelector(new, recursive=True)):
                if file.type == fs.FileType.File and file.base_name != MARK:
                    to = at + file.path[len(new) :]
                    store.create_dir(posixpath.dirname(to))
                    store.move(file.path, to)
            return
        if there:
            store.move(at, aside)
        store.move(new, at)

    def abort(self, messages) -> None:
        store, root = store_of(self.root)
        self._gone(store, f"{root}/{self.staging}")

    @staticmethod
    def _gone(store, path: str) -> None:
        from pyarrow import fs

        if store.get_file_info(path).type != fs.FileType.NotFound:
            store.delete_dir(path)


class Files(DataSource):
    @classmethod
    def name(cls) -> str:
        return "sparkloom_files"

    def writer(self, schema, overwrite: bool) -> Writer:
        if not {"folder", "name", "content"} <= {*schema.names}:
            raise ValueError("files need folder, name and content")
        if not self.options.get("path"):
            raise ValueError("files need a path")
        return Writer(self.options["path"])


def write_files(df: DataFrame, root: str, total_bytes: int = 0) -> None:
    """df (folder, name, content) as files; total_bytes: about how much it is, for the number of tasks. A folder's files are dealt to all of them."""
    df.sparkSession.dataSource.register(Files)
    tasks = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total_bytes // TASK_BYTES))
    df.select("folder", "name", "content").repartition(tasks, "folder", "name").write.format(Files.name()).mode("append").option("path", root).save()

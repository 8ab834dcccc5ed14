"""Landed responses of job boards as a data source of Spark (SRC1-SRC5, ST3).

A folder holds what was fetched: pages/board=<slug>/offset=<n>/ the bodies, and etags/ lines of JSON that name each board
and the ETag of its last response. register(spark) makes the format "boards" known:

    spark.read.format("boards").option("total", "totalFound").load(folder)      # all boards
    spark.readStream.format("boards").load(folder)                              # boards whose ETag has changed
    pages.write.format("boards").mode("append").save(folder)                    # rows of company_slug, offset, payload

Rows are (company_slug, offset, etag, payload), which the functions in readers turn into jobs. Every (board, page) is a
partition of its own, up to as many as the option "partitions" says (256 by itself); beyond, neighbouring pages share one. A page beyond the total that its own body states is not read on, as a listing that has shrunk
leaves such pages behind. Files are reached through pyarrow's file systems, so the folder may lie in any store they know.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, DataSourceWriter, InputPartition, WriterCommitMessage

SCHEMA = "company_slug string, offset int, etag string, payload string"


@dataclass
class Page:
    board: str
    offset: int
    etag: str | None
    files: list[str]


def _store(path: str) -> tuple[fs.FileSystem, str]:
    if "://" in path or path.startswith("file:"):
        return fs.FileSystem.from_uri(path.replace("file:///", "/").replace("file:/", "/") if path.startswith("file:") else path)
    return fs.LocalFileSystem(), path


@dataclass
class Pages(InputPartition):
    pages: list[Page]


class _Folder:
    def __init__(self, options: dict):
        self.path, self.total, self.most = options["path"].rstrip("/"), options.get("total"), int(options.get("partitions", 256))
        self.blocked = {b for b in options.get("blocked", "").split(",") if b}

    def _files(self, folder: str) -> list[str]:
        store, root = _store(f"{self.path}/{folder}")
        found = store.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True))
        own = [f for f in found if f.type is fs.FileType.File and not f.base_name.startswith(("_", "."))]
        return [f.path for f in sorted(own, key=lambda f: (f.mtime_ns or 0, f.path))]

    def _text(self, file: str) -> str:
        store, _ = _store(self.path)
        with store.open_input_stream(file, compression="detect") as f:
            return f.read().decode("utf-8", "replace")

    def etags(self) -> dict[str, str]:
        """The ETag of each board; a board that several lines name has the one written last."""
        lines = [json.loads(x) for file in self._files("etags") for x in self._text(file).splitlines() if x.strip()]
        return {x["board"]: x["etag"] for x in lines if x["board"] not in self.blocked}

    def pages(self, etags: dict[str, str], boards: set[str] | None = None) -> list[Pages]:
        """Partitions with the pages of the boards, or of all."""
        files: dict[tuple[str, int], list[str]] = {}
        if boards is None:
            found = self._files("pages")
        else:
            found = [f for b in sorted(boards) for f in self._files(f"pages/board={b}")]
        for file in found:
            at = dict(p.split("=", 1) for p in file.split("/") if "=" in p)
            if at["board"] not in self.blocked:
                files.setdefault((at["board"], int(at["offset"])), []).append(file)
        found = [Page(board, offset, etags.get(board), own) for (board, offset), own in sorted(files.items())]
        n = -(-len(found) // self.most)
        return [Pages(found[k : k + n]) for k in range(0, len(found), n or 1)]

    def rows(self, pages: Pages | None) -> Iterator[tuple]:
        """The bodies of pages; where there are no pages at all, Spark asks for one partition that is none."""
        for page, file in ((p, f) for p in (pages.pages if pages else []) for f in p.files):
            body = self._text(file).rstrip("\n")
            if self.total and page.offset:
                try:
                    if page.offset >= int(json.loads(body)[self.total]):
                        continue
                except (ValueError, KeyError, TypeError):
                    pass  # a page that can't be read is passed on as it is, like any broken payload
            yield page.board, page.offset, page.etag, body


class BoardReader(DataSourceReader):
    def __init__(self, options: dict):
        self.folder = _Folder(options)

    def partitions(self) -> list[Pages]:
        return self.folder.pages(self.folder.etags())

    def read(self, partition: Pages) -> Iterator[tuple]:
        return self.folder.rows(partition)


class BoardStreamReader(DataSourceStreamReader):
    """An offset is the ETag of every board; a board with another ETag than at the last one is read anew, the others not."""

    def __init__(self, options: dict):
        self.folder = _Folder(options)

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        return self.folder.etags()

    def partitions(self, start: dict, end: dict) -> list[Pages]:
        changed = {board for board, etag in end.items() if start.get(board) != etag}
        return self.folder.pages(end, changed) if changed else []

    def read(self, partition: Pages) -> Iterator[tuple]:
        return self.folder.rows(partition)

    def commit(self, end: dict) -> None:
        pass


class BoardWriter(DataSourceWriter):
    """A file for each row, put in its place when whole; the name is made of write, task and row, so a task that runs again, in whatever order, leaves nothing twice."""

    def __init__(self, options: dict):
        self.path, self.run = options["path"].rstrip("/"), uuid.uuid4().hex

    def write(self, iterator: Iterator) -> WriterCommitMessage:
        store, root = _store(self.path)
        task, attempt = TaskContext.get().partitionId(), TaskContext.get().taskAttemptId()
        written: Counter[bytes] = Counter()
        for row in iterator:
            folder, body = f"{root}/pages/board={row.company_slug}/offset={row.offset}", row.payload.encode()
            digest = hashlib.sha256(folder.encode() + b"\0" + body).digest()[:16]
            name = f"{self.run}-{task}-{digest.hex()}-{written[digest]}.txt"
            written[digest] += 1
            store.create_dir(folder)
            with store.open_output_stream(f"{folder}/.{attempt}-{name}") as f:
                f.write(body)
            store.move(f"{folder}/.{attempt}-{name}", f"{folder}/{name}")
        return WriterCommitMessage()


class BoardSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "boards"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> BoardReader:
        return BoardReader(self.options)

    def streamReader(self, schema) -> BoardStreamReader:
        return BoardStreamReader(self.options)

    def writer(self, schema, overwrite: bool) -> BoardWriter:
        if overwrite:
            raise ValueError("pages are only added")
        return BoardWriter(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(BoardSource)

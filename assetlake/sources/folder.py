"""A Spark data source over a folder of image files: its listing in parts, and its changes as a stream.

``spark.dataSource.register(FolderSource)``, then
``spark.read.format("asset_folder").option("root_id", 1).load(path)`` lists files
as ``files.scan_assets`` does, and ``spark.readStream`` of the same yields what
changed. Each folder is a part, read where it is dealt to: the path has to be
one that all executors mount. A stream's offset is a time; a file or folder
belongs to the batch in whose span its time of change falls, so a replayed
batch lists the same, and a restart goes on where the last one ended. A removed
or renamed file shows as a change of its folder.
"""

from __future__ import annotations

import os
import time
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from .. import schemas

#: Microseconds by which a stream stays behind the clock: later changes of that time could not be told apart.
BEHIND = 50_000


class _Folder(InputPartition):
    """One folder, without those below it."""

    def __init__(self, path: str, since: int = 0, until: int = 0):
        self.path, self.since, self.until = path, since, until


def _folders(top: str) -> Iterator[str]:
    """``top`` and all folders below it; links are not followed."""
    waiting = [top]
    while waiting:
        folder = waiting.pop()
        yield folder
        try:
            with os.scandir(folder) as entries:
                waiting += sorted(e.path for e in entries if e.is_dir(follow_symlinks=False) and not e.name.startswith((".", "_")))
        except OSError:  # gone or not ours to read: it has no files
            continue


def _images(folder: str) -> Iterator[tuple[str, str, os.stat_result]]:
    """(path, extension, facts) of a folder's own image files."""
    try:
        entries = sorted(os.scandir(folder), key=lambda e: e.name)
    except OSError:
        return
    for e in entries:
        stem, dot, extension = e.name.rpartition(".")
        extension = "".join(c.lower() if "A" <= c <= "Z" else c for c in extension)
        if dot and extension in schemas.EXTENSIONS and not e.name.startswith((".", "_")):
            try:
                if e.is_file():
                    yield e.path, extension, e.stat()
            except OSError:  # went away meanwhile
                continue


def _changed(facts: os.stat_result) -> int:
    """Microseconds of the last change of a file's content or a folder's entries."""
    return facts.st_mtime_ns // 1000


class FolderSource(DataSource):
    """Options: ``path``, ``root_id`` (0)."""

    @classmethod
    def name(cls) -> str:
        return "asset_folder"

    def schema(self) -> str:
        return "root_id long, rel_path string, filename string, extension string, size_bytes long, mtime long, path string, kind string, ts timestamp"

    def reader(self, schema) -> DataSourceReader:
        return _Listing(self.options)

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _Changes(self.options)


class _Listing(DataSourceReader):
    def __init__(self, options):
        self.top = os.path.abspath(options["path"].removeprefix("file://"))
        self.root_id = int(options.get("root_id", 0))

    def partitions(self) -> list[_Folder]:
        return [_Folder(f) for f in _folders(self.top)]

    def row(self, path: str, extension: str, facts: os.stat_result, kind: str) -> tuple:
        from datetime import UTC, datetime

        at = datetime.fromtimestamp(_changed(facts) / 1e6, UTC)
        return self.root_id, os.path.relpath(path, self.top).replace(os.sep, "/"), os.path.basename(path), extension, facts.st_size, int(facts.st_mtime), path, kind, at

    def read(self, partition: _Folder) -> Iterator[tuple]:
        for path, extension, facts in _images(partition.path):
            yield self.row(path, extension, facts, "file")


class _Changes(DataSourceStreamReader):
    def __init__(self, options):
        self.listing = _Listing(options)

    def initialOffset(self) -> dict:
        return {"until": 0}

    def latestOffset(self) -> dict:
        return {"until": time.time_ns() // 1000 - BEHIND}

    def partitions(self, start: dict, end: dict) -> list[_Folder]:
        return [_Folder(f, start["until"], end["until"]) for f in _folders(self.listing.top)]

    def read(self, partition: _Folder) -> Iterator[tuple]:
        within = lambda facts: partition.since < _changed(facts) <= partition.until
        for path, extension, facts in _images(partition.path):
            if within(facts):
                yield self.listing.row(path, extension, facts, "modify")
        try:
            own = os.stat(partition.path)
        except OSError:
            return
        if within(own):
            yield self.listing.row(partition.path, "", own, "remove")  # entries came or went

    def commit(self, end: dict) -> None:
        pass

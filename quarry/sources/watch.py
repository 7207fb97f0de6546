"""A streaming source of changes in a directory: files that come, change and go.

An offset is the number of a snapshot (path, time and size of every file), which lies in the ``state`` folder; a batch
is the difference of two snapshots, so it is the same whenever it is read again. A file counts once it has been left
alone for ``stability`` milliseconds; until then its former state stands.

    spark.dataSource.register(DirectoryChanges)
    spark.readStream.format("directory_changes").option("state", folder).load(path)
"""

from __future__ import annotations

import json
import re
import time

from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

#: Fixed value: hidden files and folders, and installed packages, are not watched.
IGNORED = r"(^|/)\..|node_modules"
STABILITY_MS = 200
#: Changes that one task passes on.
EVENTS = 10_000
SCHEMA = "path string, kind string, modified_ms long, size long, version long"


class DirectoryChanges(DataSource):
    """Options: ``path`` (a folder that the driver can list), ``state``, and perhaps ``stability`` (milliseconds), ``initial`` ("true": files that are there at the start come as "add") and ``ignored`` (a pattern of relative paths)."""

    @classmethod
    def name(cls) -> str:
        return "directory_changes"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> ChangeReader:
        return ChangeReader(self.options)


class Part(InputPartition):
    def __init__(self, events: list[tuple]):
        self.events = events


def difference(before: dict, after: dict, version: int) -> list[tuple]:
    """Events that lead from one snapshot to the other, by path."""
    out = []
    for path in sorted({*before, *after}):
        old, new = before.get(path), after.get(path)
        if old != new:
            kind = "add" if old is None else "unlink" if new is None else "change"
            out.append((path, kind, *(new or old), version))
    return out


def settled(before: dict, seen: dict, now_ms: float, stability: float) -> dict:
    """The snapshot that stands: what has changed too recently is as before."""
    out = {}
    for path, state in seen.items():
        if now_ms - state[0] >= stability:
            out[path] = state
        elif path in before:
            out[path] = before[path]
    return out


class ChangeReader(DataSourceStreamReader):
    def __init__(self, options: dict):
        if "path" not in options or "state" not in options:
            raise ValueError("the options path and state must be given")
        self.path, self.state = options["path"], options["state"].rstrip("/")
        self.stability = float(options.get("stability", STABILITY_MS))
        self.initial = str(options.get("initial", "false")).lower() == "true"
        self.ignored = options.get("ignored", IGNORED)

    def _fs(self, uri: str):
        from pyarrow import fs

        return fs.FileSystem.from_uri(uri)

    def scan(self) -> dict:
        """Relative path to [modified milliseconds, size] of every file."""
        from pyarrow import fs

        system, root = self._fs(self.path)
        out = {}
        for info in system.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True)):
            name = info.path[len(root.rstrip("/")) + 1 :]
            if info.type == fs.FileType.File and not re.search(self.ignored, name):
                out[name] = [info.mtime_ns // 1_000_000, info.size]
        return out

    def snapshot(self, version: int) -> dict:
        system, root = self._fs(self.state)
        with system.open_input_stream(f"{root}/{version:012d}.json") as f:
            return json.loads(f.read())

    def versions(self) -> list[int]:
        from pyarrow import fs

        system, root = self._fs(self.state)
        found = system.get_file_info(fs.FileSelector(root, allow_not_found=True))
        return sorted(int(i.base_name[:-5]) for i in found if re.fullmatch(r"\d{12}\.json", i.base_name))

    def keep(self, version: int, snapshot: dict) -> None:
        system, root = self._fs(self.state)
        system.create_dir(root, recursive=True)
        with system.open_output_stream(f"{root}/{version:012d}.tmp") as f:
            f.write(json.dumps(snapshot).encode())
        system.move(f"{root}/{version:012d}.tmp", f"{root}/{version:012d}.json")

    def initialOffset(self) -> dict:
        if 0 not in self.versions():
            self.keep(0, {} if self.initial else self.scan())
        return {"version": 0}

    def latestOffset(self) -> dict:
        last = (self.versions() or [self.initialOffset()["version"]])[-1]
        before = self.snapshot(last)
        after = settled(before, self.scan(), time.time() * 1000, self.stability)
        if after != before:
            last += 1
            self.keep(last, after)
        return {"version": last}

    def partitions(self, start: dict, end: dict) -> list[Part]:
        events = difference(self.snapshot(start["version"]), self.snapshot(end["version"]), end["version"])
        return [Part(events[i : i + EVENTS]) for i in range(0, len(events), EVENTS)] or [Part([])]

    def read(self, partition: Part):
        yield from partition.events

    def commit(self, end: dict) -> None:
        """Snapshots before the one that has been read are no longer needed."""
        system, root = self._fs(self.state)
        for v in self.versions():
            if 0 < v < end["version"]:
                system.delete_file(f"{root}/{v:012d}.json")

"""A streaming source of the files that come into a folder or change there: their names, not what they hold.

Each look at the folder that finds new or changed files (another time or size) is an entry of their names in a folder of its own;
offsets are the numbers of entries, so a stream that starts again goes on where it was, whatever the files' times are.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

_SCHEMA = pa.schema([("path", pa.string()), ("modified", pa.int64()), ("size", pa.int64())])


@dataclass
class _Entry(InputPartition):
    number: int


class FileChanges(DataSource):
    @classmethod
    def name(cls) -> str:
        return "tidemark_file_changes"

    def schema(self) -> str:
        return "path string, modified long, size long"

    def streamReader(self, schema) -> DataSourceStreamReader:  # noqa: N802  named by Spark
        return _Reader(self.options["folder"], self.options["state"], tuple(self.options["suffixes"].split(",")))


class _Reader(DataSourceStreamReader):
    def __init__(self, folder: str, state: str, suffixes: tuple[str, ...]):
        self.folder, self.state, self.suffixes = folder, state, suffixes
        self._known: dict[str, list[int]] | None = None
        self._number = 0

    def _entries(self) -> tuple[fs.FileSystem, str, list[int]]:
        files, root = fs.FileSystem.from_uri(self.state)
        names = [f.base_name for f in files.get_file_info(fs.FileSelector(root, allow_not_found=True))]
        return files, root, sorted(int(n[:-5]) for n in names if n.endswith(".json"))

    def _read(self, number: int) -> list[list]:
        files, root = fs.FileSystem.from_uri(self.state)
        with files.open_input_stream(f"{root}/{number:012d}.json") as f:
            return json.loads(f.read())

    def initialOffset(self) -> dict:  # noqa: N802
        return {"number": 0}

    def latestOffset(self) -> dict:  # noqa: N802
        files, root, numbers = self._entries()
        if self._known is None:
            self._known = {}
            for n in numbers:
                self._known |= {path: [modified, size] for path, modified, size in self._read(n)}
            self._number = numbers[-1] if numbers else 0
        watched, top = fs.FileSystem.from_uri(self.folder)
        prefix = self.folder[: len(self.folder) - len(self.folder.split(":", 1)[-1].lstrip("/")) - 1] if ":" in self.folder else ""
        found = watched.get_file_info(fs.FileSelector(top, recursive=True, allow_not_found=True))
        changed = []
        for f in found:
            now = [f.mtime_ns // 1_000_000, f.size]
            if f.type == fs.FileType.File and f.path.lower().endswith(self.suffixes) and self._known.get(prefix + f.path) != now:
                changed.append([prefix + f.path, *now])
        if changed:
            self._number += 1
            files.create_dir(root)
            aside = f"{root}/.{self._number}"
            with files.open_output_stream(aside) as out:
                out.write(json.dumps(sorted(changed)).encode())
            files.move(aside, f"{root}/{self._number:012d}.json")
            self._known |= {path: now for path, *now in changed}
        return {"number": self._number}

    def partitions(self, start: dict, end: dict) -> Sequence[InputPartition]:
        return [_Entry(n) for n in range(start["number"] + 1, end["number"] + 1)]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        rows = self._read(partition.number)
        columns = list(zip(*rows, strict=True)) or [(), (), ()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(columns, _SCHEMA, strict=True)], schema=_SCHEMA)

    def commit(self, end: dict) -> None:
        """Entries stay: they say what is known."""

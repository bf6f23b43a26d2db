"""A data source of files by their leading bytes: a partition is a list of paths, and of each file sixteen bytes are read."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

HEAD_BYTES, FILES_A_PARTITION = 16, 500


def _file_system(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


@dataclass
class Paths(InputPartition):
    """Paths and lengths that one task reads."""

    files: list[tuple[str, int]]


class HeadReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.per_task = int(options.get("filesPerPartition", FILES_A_PARTITION))

    def partitions(self) -> list[Paths]:
        from pyarrow import fs

        system, root = _file_system(self.path)
        found = system.get_file_info(root)
        listed = [found] if found.is_file else system.get_file_info(fs.FileSelector(root, recursive=True))
        files = sorted((f.path, f.size) for f in listed if f.is_file and not f.base_name.startswith(("_", ".")))
        return [Paths(files[i:i + self.per_task]) for i in range(0, len(files), self.per_task)] or [Paths([])]

    def read(self, partition: Paths) -> Iterator[tuple[str, int, bytes]]:
        system, _ = _file_system(self.path)
        for path, size in partition.files:
            with system.open_input_stream(path) as stream:
                yield path, size, stream.read(HEAD_BYTES)


class FileHeads(DataSource):
    """``spark.read.format("file_heads").load(folder)``: ``path, length, head`` of the files under a folder.

    Local paths and the schemes that Arrow's file systems know; hidden files are passed over, an empty folder has no rows.
    """

    @classmethod
    def name(cls) -> str:
        return "file_heads"

    def schema(self) -> str:
        return "path string, length long, head binary"

    def reader(self, schema) -> HeadReader:
        return HeadReader(self.options)

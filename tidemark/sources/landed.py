"""Landed JSON files as a data source of their own: `spark.read.format("landed_json")`, and the same as a stream.

Every file is a partition; its records become rows as JSON text, whatever they hold, so that loaders read them with
column expressions. A file that is no JSON gives one row that says so and stops nothing. The stream's offsets are file
names: files must land under rising names, as those that are named by time or number do.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from typing import Any

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

SCHEMA = "file string, place int, record string, error string"


class File(InputPartition):
    def __init__(self, path: str, name: str):
        self.path, self.name = path, name


def _files(folder: str) -> list[File]:
    """Files in the folder and below it, by name; hidden ones and markers are left out."""
    from pyarrow import fs

    system, root = fs.FileSystem.from_uri(folder)
    found = system.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True))
    names = {f.path[len(root) :].lstrip("/"): f.path for f in found if f.type == fs.FileType.File}
    return [File(path, name) for name, path in sorted(names.items()) if not any(p.startswith((".", "_")) for p in name.split("/"))]


def records_of(content: bytes, path: str) -> list[Any]:
    """The records under a path of names with dots between them; the empty path is the whole. One that is no list is one record."""
    found = json.loads(content)
    for name in filter(None, path.split(".")):
        found = [y for x in found for y in _under(x, name)] if isinstance(found, list) else found.get(name, [])
    return found if isinstance(found, list) else [found]


def _under(x: Any, name: str) -> list[Any]:
    held = x.get(name) if isinstance(x, dict) else None
    return held if isinstance(held, list) else [] if held is None else [held]


class _Reading:
    def __init__(self, options: dict[str, str]):
        if "path" not in options:
            raise ValueError("load needs the folder of the files")
        self.folder, self.records = options["path"], options.get("records", "")

    def read(self, partition: File | None) -> Iterator[tuple]:
        if partition is None:  # there are no files
            return
        from pyarrow import fs

        system, _ = fs.FileSystem.from_uri(self.folder)
        with system.open_input_stream(partition.path) as f:
            content = f.readall()
        try:
            records = records_of(content, self.records)
        except (ValueError, AttributeError) as e:
            yield partition.name, None, None, f"{type(e).__name__}: {e}"[:200]
            return
        for place, record in enumerate(records):
            yield partition.name, place, json.dumps(record, ensure_ascii=False), None


class _Reader(_Reading, DataSourceReader):
    def partitions(self) -> list[File]:
        return _files(self.folder)


class _StreamReader(_Reading, DataSourceStreamReader):
    def initialOffset(self) -> dict:
        return {"file": ""}

    def latestOffset(self) -> dict:
        files = _files(self.folder)
        return {"file": files[-1].name if files else ""}

    def partitions(self, start: dict, end: dict) -> list[File]:
        return [f for f in _files(self.folder) if start["file"] < f.name <= end["file"]]

    def commit(self, end: dict) -> None:
        pass


class LandedJson(DataSource):
    """Options: path (the folder), and records (where the records are, such as `hits` or `data.children`)."""

    @classmethod
    def name(cls) -> str:
        return "landed_json"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> _Reader:
        return _Reader(self.options)

    def streamReader(self, schema: StructType) -> _StreamReader:
        return _StreamReader(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(LandedJson)

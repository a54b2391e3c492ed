"""``spark.read.format("tmx")``: the whole-file reader as a Python data source, over any file system that Arrow reads."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.pandas.types import to_arrow_schema

from ..errors import TmxError
from .parser import Parser
from .tmx import UNITS, _rows


def _located(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or address (``file:``, ``hdfs:``, ``s3:``, ...), and the path there."""
    if path.startswith("file:"):
        path = "/" + path.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


class TmxReader(DataSourceReader):
    def __init__(self, path: str, schema, permissive: bool):
        self.path, self.schema, self.permissive = path, schema, permissive

    def partitions(self) -> list[InputPartition]:
        system, root = _located(self.path)
        info = system.get_file_info(root)
        if info.type == fs.FileType.NotFound:
            raise FileNotFoundError(self.path)
        if info.type == fs.FileType.File:
            return [InputPartition(self.path)]
        names = sorted(f.base_name for f in system.get_file_info(fs.FileSelector(root)) if f.type == fs.FileType.File and f.base_name[0] not in "._")
        return [InputPartition(f"{self.path.rstrip('/')}/{n}") for n in names]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        arrow, parser = to_arrow_schema(self.schema), Parser()
        system, path = _located(partition.value)
        with system.open_input_stream(path) as stream:
            raw = stream.read()
        try:
            rows = parser.document(raw)[1]
        except TmxError as error:
            if not self.permissive:
                raise
            rows = [{"_error": error.code}]
        for at in range(0, len(rows), 1000):
            yield _rows([{"memory_id": partition.value, "unit_pos": at + k, **r} for k, r in enumerate(rows[at : at + 1000])], arrow)


class TmxDataSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "tmx"

    def schema(self):
        return UNITS

    def reader(self, schema) -> DataSourceReader:
        return TmxReader(self.options["path"], schema, self.options.get("mode", "FAILFAST").upper() == "PERMISSIVE")


def register(spark: SparkSession) -> None:
    """Make the format known; files are read whole, one a task (``tmx.read_tmx`` splits them)."""
    spark.dataSource.register(TmxDataSource)

"""Incremental reading and writing of translation-memory files."""

from __future__ import annotations

import re
from collections.abc import Iterator, Mapping

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from ..errors import TmxError
from ..functions.markup import Dumper, Writer
from ..sources.parser import Override, Parser
from ..sources.tmx import _START, END, ODD, _rows, epilogue, prolog, unit_schema

_ODD = re.compile(ODD)


def _files(overrides: Mapping[str, Override] | None, schema: StructType):
    arrow = to_arrow_schema(schema)

    def units(parser: Parser, raw: bytes) -> Iterator[dict]:
        _, opening, splits = prolog(raw, overrides)
        text = raw.decode("utf-8-sig") if splits else ""
        if not splits or _ODD.search(text) or text.count("</body") != 1:
            yield from parser.document(raw)[1]
            return
        epilogue(text.partition("</body")[2], opening)
        *whole, last = text.partition("</body")[0].split(END)
        for record in [*(r + END for r in whole), last]:
            if found := _START.search(record):
                body = record[found.start() :]
                try:
                    yield from list(parser.units(body, opening))
                except TmxError as error:
                    yield {"_error": error.code, "_corrupt_record": body}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parser = Parser(overrides)
        for batch in batches:
            for memory, raw in zip(*batch.columns):
                memory, out = memory.as_py(), []
                at = 0
                try:
                    for row in units(parser, raw.as_py()):
                        out.append({"memory_id": memory, "unit_pos": at, **row})
                        at += 1
                        if len(out) == 1000:
                            yield _rows(out, arrow)
                            out = []
                except (TmxError, UnicodeDecodeError) as error:
                    out.append({"memory_id": memory, "unit_pos": at, "_error": getattr(error, "code", "malformed")})
                if out:
                    yield _rows(out, arrow)

    return run


def read_stream(spark: SparkSession, path: str, overrides: Mapping[str, Override] | None = None, files_per_trigger: int | None = None) -> DataFrame:
    """Units of files as they arrive in a folder, with faults in ``_error``.

    A file is read in one task, with the prolog's guards of a batch read: odd files are parsed whole, one that cannot be
    parsed gives a row with ``_error``. A file beyond 2 GB, which Spark's binary reader does not take, fails the stream.
    """
    reader = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary")
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    schema = unit_schema()
    return reader.load(path).select("path", "content").mapInArrow(_files(overrides, schema), schema)


def write_stream(units: DataFrame, path: str, checkpoint: str, overrides: Mapping[str, Dumper] | None = None, available_now: bool = True) -> StreamingQuery:
    """Units as ``<tu>`` lines, appended batch by batch; a replayed batch replaces its own folder."""
    column = Writer(overrides).unit().alias("value")

    def write(batch: DataFrame, number: int) -> None:
        batch.sortWithinPartitions("memory_id", "unit_pos").select(column).write.mode("overwrite").text(f"{path}/batch={number}")

    stream = units.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (stream.trigger(availableNow=True) if available_now else stream).start()


def items_per_language(units: DataFrame, window: str, watermark: str) -> DataFrame:
    """Variants by language and time of change, over windows that close behind a watermark."""
    rows = units.select(F.explode("variants").alias("v")).select(F.col("v.language").alias("language"), F.col("v.last_modified_at").alias("ts"))
    return rows.withWatermark("ts", watermark).groupBy(F.window("ts", window), "language").count()

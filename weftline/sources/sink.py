"""Writing units back as translation-memory documents."""

from __future__ import annotations

from collections.abc import Iterator, Mapping

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.markup import Dumper, Writer

DOCTYPE = '<!DOCTYPE tmx SYSTEM "tmx14.dtd">\n'


def _framed(opening: str, closing: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("value", pa.string())])
        yield pa.RecordBatch.from_arrays([pa.array([opening])], schema=schema)
        for batch in batches:
            yield pa.RecordBatch.from_arrays(batch.columns, schema=schema)
        yield pa.RecordBatch.from_arrays([pa.array([closing])], schema=schema)

    return run


def write_tmx(memory: DataFrame, units: DataFrame, path: str, overrides: Mapping[str, Dumper] | None = None, merge: bool = False, parts: int | None = None, doctype: str = DOCTYPE) -> None:
    """Write one memory's units, in the order of ``unit_pos``, below ``path``.

    Each part file is a complete document, so writing spreads over tasks; with ``merge`` the parts are one document,
    streamed into the file ``path`` by the driver in constant memory. ``memory`` has one row.
    """
    spark, writer = units.sparkSession, Writer(overrides)
    ends = memory.select(writer.opening(doctype).alias("o"), writer.closing().alias("c")).head(2)
    if len(ends) != 1:
        raise ValueError(f"{len(ends)} memories in place of one")
    if parts is not None and parts < 1:
        raise ValueError("parts must be at least 1")
    n = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    lines = units.repartitionByRange(n, "unit_pos").sortWithinPartitions("unit_pos").select(writer.unit().alias("value"))
    if not merge:
        lines.mapInArrow(_framed(ends[0].o, ends[0].c), "value string").write.text(path)
        return
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    folder = jvm.org.apache.hadoop.fs.Path(path + ".parts")
    fs = folder.getFileSystem(conf)
    lines.write.text(path + ".parts")
    out = fs.create(jvm.org.apache.hadoop.fs.Path(path), True)
    try:
        out.write(bytearray((ends[0].o + "\n").encode()))
        for status in sorted(fs.listStatus(folder), key=lambda s: s.getPath().getName()):
            if status.getPath().getName().startswith("part-"):
                part = fs.open(status.getPath())
                jvm.org.apache.hadoop.io.IOUtils.copyBytes(part, out, 1 << 16, False)
                part.close()
        out.write(bytearray(ends[0].c.encode()))
    finally:
        out.close()
    fs.delete(folder, True)


def write_elements(lines: DataFrame, path: str, opening: str, closing: str, doctype: str = "") -> None:
    """Write a text column of markup between the tags of a root; each part file is a document."""
    head = f'<?xml version="1.0" encoding="UTF-8"?>\n{doctype}{opening}'
    lines.select(F.col(lines.columns[0]).cast("string").alias("value")).mapInArrow(_framed(head, closing), "value string").write.text(path)

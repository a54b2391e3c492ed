"""Substring dedup: repeated fixed-length token windows become removal intervals.

Pass 1 hashes every window (Rabin-Karp, ``tokenhash``), keeps of those that a task
meets several times the ones of the smallest id, and deals them out by hash, in
arrays whose ids come in runs. Spark counts: a window aggregate over each hash gives
the smallest id that it starts in, and the later ones are the flags. Pass 2 joins
the flags to their rows, merges the windows that they mark into maximal intervals
and drops the words inside.

A hash leaves a task once for each row that has its smallest id there, however many
copies of a document there are, so no hash grows hot; flags are keyed by id and a tag
of the text, so a much repeated id does not either (whether a window goes depends on
its hash and id alone, so rows that share both keys share their flags rightly).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import tokenhash
from .common import trim, width

_DEALT = "bucket int, later boolean, ids array<long>, tags array<short>, hashes array<long>"
_OUT = "doc_id long, n_words long, n_removed long, kept_text string, removed array<struct<start:long,end:long>>"
def _first(*keys: np.ndarray) -> np.ndarray:
    """Where, in columns sorted together, a new combination begins."""
    new = np.zeros(len(keys[0]), bool)
    new[:1] = True
    for key in keys:
        new[1:] |= key[1:] != key[:-1]
    return new


def _split(hashes: np.ndarray, rows: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the windows of some rows with their ids: those with the smallest id of their hash, and the later ones; each once a row."""
    order = np.lexsort((rows, ids[rows], hashes))
    h, r = hashes[order], rows[order]
    order, h, r = (c[_first(h, r)] for c in (order, h, r))
    at = np.flatnonzero(_first(h))
    later = ids[r] > np.repeat(ids[r[at]], np.diff(np.append(at, len(h))))
    return order[~later], order[later]


def _deal(size: int, buckets: int, most: int):
    schema = pa.schema([("bucket", pa.int32()), ("later", pa.bool_()), ("ids", pa.list_(pa.int64())), ("tags", pa.list_(pa.int16())), ("hashes", pa.list_(pa.int64()))])

    def packed(later: bool, bucket: np.ndarray, rows: np.ndarray, hashes: np.ndarray, ids: np.ndarray, tags: np.ndarray) -> pa.RecordBatch:
        """A row for each bucket: its hashes in order of the rows that they come from."""
        order = np.lexsort((rows, bucket))
        bucket, rows, hashes = bucket[order], rows[order], hashes[order]
        at = np.flatnonzero(_first(bucket))
        offsets = pa.array(np.append(at, len(bucket)), pa.int32())
        lists = [pa.ListArray.from_arrays(offsets, pa.array(c)) for c in (ids[rows], tags[rows], hashes.view(np.int64))]
        return pa.RecordBatch.from_arrays([pa.array(bucket[at], pa.int32()), pa.array([later] * len(at)), *lists], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, rows, tags, ids = [], [], [], []
        words: list[bytes] = []
        lengths: list[int] = []
        held = 0

        def hash_words() -> None:
            n = np.array(lengths)
            whole = tokenhash.window_hashes(tokenhash.word_hashes(b" ".join(words)), size)
            # windows that run over a document's end do not count
            left = np.repeat(np.cumsum(n), n)[: len(whole)] - np.arange(len(whole)) >= size
            hashes.append(whole[left])
            rows.append(np.repeat(np.arange(len(ids) - len(n), len(ids), dtype=np.int32), n)[: len(whole)][left])
            words.clear(), lengths.clear()

        def flush() -> Iterator[pa.RecordBatch]:
            h, r = np.concatenate(hashes), np.concatenate(rows)
            d, t = np.array(ids, np.int64), np.array(tags, np.int16)
            first, later = _split(h, r, d)
            # by hash where it is compared further; what is flagged already goes by row
            by_hash = ((h[first] >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int32)
            by_row = (tokenhash.mix(d[r[later]].view(np.uint64) * np.uint64(65536) + t[r[later]].astype(np.uint64)) % np.uint64(buckets)).astype(np.int32)
            for flag, bucket, which in ((False, by_hash, first), (True, by_row, later)):
                if len(which):
                    yield packed(flag, bucket, r[which], h[which], d, t)
            hashes.clear(), rows.clear(), tags.clear(), ids.clear()

        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                for doc, tag, text in zip(*(c.to_pylist() for c in batch.slice(at, 256).columns)):
                    own = text.encode("utf-8", "surrogatepass").split()
                    if len(own) < size:
                        continue
                    words += own
                    lengths.append(len(own))
                    tags.append(tag)
                    ids.append(doc)
                    held += len(own)
                    if len(words) > 150_000:
                        hash_words()
                        if held >= most:
                            yield from flush()
                            held = 0
        if words:
            hash_words()
        if hashes:
            yield from flush()
        trim()

    return run


def _squeezed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts compressed one by one, for the shuffle; null stays null."""
    import zstandard

    squeeze = zstandard.ZstdCompressor(level=1).compress
    for batch in batches:
        for at in range(0, batch.num_rows, 512):
            part = batch.slice(at, 512)
            bodies = [None if t is None else squeeze(t.encode("utf-8", "surrogatepass")) for t in part.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(bodies, pa.binary())], names=["doc_id", "tag", "body"])
    trim()


def _strip(size: int, squeezed: bool = True):
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_text", pa.string()), ("removed", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        loose = zstandard.ZstdDecompressor().decompress if squeezed else lambda text: text.encode("utf-8", "surrogatepass")
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part, out = batch.slice(at, 512), {k: [] for k in schema.names}
                for doc, body, flags in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), part.column(2)):
                    words = loose(body).split() if body is not None else []
                    n, cuts = len(words), []
                    if flags.is_valid and n >= size:
                        own = flags.values.to_numpy().view(np.uint64)
                        hit = np.flatnonzero(np.isin(tokenhash.window_hashes(tokenhash.word_hashes(b" ".join(words)), size), own))
                        edge = np.flatnonzero(np.diff(hit) > size)
                        cuts = [(int(s), int(e)) for s, e in zip(hit[np.append(0, edge + 1)], hit[np.append(edge, len(hit) - 1)] + size)] if len(hit) else []
                        kept, last = [], 0
                        for s, e in cuts:
                            kept += words[last:s]
                            last = e
                        words = kept + words[last:]
                    for name, value in zip(schema.names, (doc, n, n - len(words), b" ".join(words).decode("utf-8", "surrogatepass"), [{"start": s, "end": e} for s, e in cuts])):
                        out[name].append(value)
                yield pa.RecordBatch.from_pydict(out, schema=schema)
        trim()

    return run


def flags(rows: DataFrame, size: int, combine: int) -> DataFrame:
    """``doc_id, tag, hash`` of every window of ``doc_id, tag, text`` (no nulls) that also starts in a row with a smaller id."""
    n = 2 * width(rows.sparkSession)  # a row a window is sorted, several times the bytes that are shuffled
    dealt = rows.mapInArrow(_deal(size, n, combine), _DEALT).repartition(n, "bucket")
    windows = dealt.select("bucket", "later", "ids", "tags", F.posexplode("hashes").alias("k", "hash"))
    windows = windows.select("bucket", "later", "hash", F.get("ids", "k").alias("doc_id"), F.get("tags", "k").alias("tag"))
    # the hash comes first in the sort; the bucket keeps what is dealt out where it is
    least = F.min("doc_id").over(Window.partitionBy("hash", "bucket"))
    return windows.withColumn("least", least).where(F.col("later") | (F.col("doc_id") > F.col("least"))).select("doc_id", "tag", "hash")


def dedup_substrings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 13, combine: int = 400_000) -> DataFrame:
    """Remove each word covered by a ``window``-word sequence that also starts in a document with a smaller id.

    Returns one row per input row: ``doc_id, n_words, n_removed, kept_text, removed`` (word intervals, end exclusive).
    ``combine`` bounds the windows a task holds before it combines and sends them.

    Null text has no words. A null id neither removes nor loses anything. Rows that repeat an id do not remove each
    other. Texts shorter than the window are kept. Other columns are not read. Windows are compared by a 61-bit hash.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    rows = rows.select("doc_id", F.shiftright(F.xxhash64("text"), 48).cast("short").alias("tag"), "text")
    known = F.col("doc_id").isNotNull() & F.col("text").isNotNull()
    found = flags(rows.where(known), window, combine).groupBy("doc_id", "tag").agg(F.collect_list("hash").alias("flags"))
    bodies = rows.where(known).mapInArrow(_squeezed, "doc_id long, tag short, body binary")
    some = bodies.join(found, ["doc_id", "tag"], "left").select("doc_id", "body", "flags")
    # what is not shuffled is not compressed: a task runs one Python worker at a time
    rest = rows.where(~known).select("doc_id", "text", F.lit(None).cast("array<long>").alias("flags"))
    return some.mapInArrow(_strip(window), _OUT).unionByName(rest.mapInArrow(_strip(window, squeezed=False), _OUT))

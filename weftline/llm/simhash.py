"""SimHash near-dedup by covering locality-sensitive hashing.

Each distinct 64-bit fingerprint goes into 7 tables. Table v keeps the bits whose
code word m(i) in {0,1}^3 has an odd inner product with v; for any two differing
bits some non-zero v is orthogonal to both code words, so every pair within two
bits meets in at least one table (a structured family for radius 2 has
2**(2+1) - 1 masks).

Buckets of two are tested directly. In larger buckets nobody is paired with
everybody: each fingerprint joins the 65 points of its radius-1 ball, and two
fingerprints are within two bits exactly when they share such a point, of which
each has 65 members at most. Links become components by alternating large-star
and small-star steps over distinct fingerprints.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tokenhash
from .common import discard, materialise

RADIUS = 2
#: Bits of a wide fingerprint, and of those the ones that a distance is measured on first.
WIDE, FIRST = 512, 128
#: Expected tables in which a pair at the similarity asked for meets: it meets in none with probability exp(-8), about.
MEETINGS = 8


def masks() -> list[int]:
    """The covering masks as signed 64-bit integers, one for each table."""
    out = []
    for v in range(1, 1 << (RADIUS + 1)):
        # bit i has the non-zero code word 1 + i mod 7, so each table keeps 36 or 37 of the 64 bits
        mask = sum(1 << i for i in range(64) if bin((1 + i % 7) & v).count("1") % 2)
        out.append(mask - (1 << 64) if mask >> 63 else mask)
    return out


def _fingerprints(shingle: int):
    schema = pa.schema([("doc_id", pa.int64()), ("bits", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        digest = xxhash.xxh64_intdigest
        for batch in batches:
            bits = []
            for at in range(0, batch.num_rows, 512):
                for text in batch.column(1).slice(at, 512).to_pylist():
                    joined = b" ".join(text.encode("utf-8", "surrogatepass").lower().split()) if text else b""
                    if not joined:
                        bits.append(0)
                        continue
                    start, end = tokenhash.spans(joined)
                    n = max(1, len(start) - shingle + 1)
                    cut = map(slice, start[:n].tolist(), end[-n:].tolist())
                    counts, total = np.zeros(64, np.int64), 0
                    hashes = np.fromiter(map(digest, map(joined.__getitem__, cut), repeat(42)), np.uint64, n)
                    for k in range(0, n, 65536):
                        counts += np.unpackbits(hashes[k : k + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
                    total = int(np.packbits(counts * 2 > n, bitorder="little").view(np.uint64)[0])
                    bits.append(total - (1 << 64) if total >> 63 else total)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(bits, pa.int64())], schema=schema)

    return run


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """``doc_id, bits``: the majority of the XXH64 bits of the lower-cased word shingles, repeats included."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(_fingerprints(shingle), "doc_id long, bits long")


def wide(sets: list[np.ndarray]) -> np.ndarray:
    """SimHash of WIDE bits of each of some non-empty sets of hashes, as 0 and 1: a bit's majority, in a tie that of the set's first hash."""
    every = np.concatenate(sets)
    starts = np.cumsum([0, *map(len, sets[:-1])])
    sizes = np.array([len(s) for s in sets])[:, None]
    out = np.zeros((len(sets), WIDE), np.uint8)
    for k in range(WIDE // 64):
        own = np.unpackbits(tokenhash.mix(every + np.uint64((k + 1) * 0x9E3779B97F4A7C15 % (1 << 64))).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        twice = 2 * np.add.reduceat(own, starts, axis=0, dtype=np.int32)
        out[:, 64 * k : 64 * (k + 1)] = (twice > sizes) | (twice == sizes) & (own[starts] == 1)
    return out


def tables(rows: int, similarity: float) -> np.ndarray:
    """Places of the bits that each table of bit-sampling LSH keeps: (tables, bits), for pairs of sets at a Jaccard index of ``similarity``.

    At that index the cosine is 2 s / (1 + s) at least and a bit agrees with probability 1 - arccos / pi. A table keeps so
    many bits that unlike texts rarely meet among ``rows`` rows (one in eight), and so many tables are made that a pair at
    the limit is expected in MEETINGS of them.
    """
    agree = 1 - np.arccos(2 * similarity / (1 + similarity)) / np.pi
    bits = min(48, max(16, int(np.ceil(np.log2(max(2, rows)))) + 3))
    rng = np.random.default_rng(42)
    return np.array([rng.choice(WIDE, bits, replace=False) for _ in range(int(np.ceil(MEETINGS / agree**bits)))])


def table_keys(bits: np.ndarray, places: np.ndarray) -> np.ndarray:
    """The key of each row of fingerprints in each table: (rows, tables); no two tables share a key."""
    count, kept = places.shape
    weights = np.zeros((WIDE, count))
    weights[places, np.arange(count)[:, None]] = 2.0 ** np.arange(kept)
    return (bits.astype(np.float64) @ weights).astype(np.int64) + (np.arange(count, dtype=np.int64) << kept)


def links(bits: DataFrame) -> DataFrame:
    """``u, v`` (u > v) from distinct fingerprints ``bits``: within two bits, and enough of them to connect all that are."""
    tables = F.array(*(F.struct(F.lit(k).alias("t"), F.col("bits").bitwiseAND(F.lit(m)).alias("key")) for k, m in enumerate(masks())))
    keyed = bits.select("bits", F.explode(tables).alias("b")).select("bits", "b.t", "b.key")
    buckets = keyed.groupBy("t", "key").agg(F.count("*").alias("n"), F.min("bits").alias("v"), F.max("bits").alias("u")).where("n > 1")
    buckets = materialise(buckets, "buckets")
    near = F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= RADIUS
    pairs = buckets.where("n = 2").where(near).select("u", "v")
    crowd = keyed.join(buckets.where("n > 2").select("t", "key"), ["t", "key"], "left_semi").select("bits").distinct()
    ball = F.array(F.lit(0).cast("long"), *(F.lit((1 << i) - (1 << 64) if i == 63 else 1 << i).cast("long") for i in range(64)))
    points = crowd.select("bits", F.explode(ball).alias("flip")).select("bits", F.col("bits").bitwiseXOR(F.col("flip")).alias("point"))
    met = points.groupBy("point").agg(F.collect_list("bits").alias("own")).where(F.size("own") > 1)  # 65 members at most
    met = met.select(F.array_min("own").alias("v"), F.explode("own").alias("u")).where("u <> v")
    return pairs.unionByName(met.select("u", "v")).distinct()


def _stars(edges: DataFrame) -> bool:
    """Whether each node ``u`` has one edge and is no other edge's ``v``: the ``v`` are the roots then."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("u").alias("node"), F.lit(1).alias("out"), F.lit(0).alias("into")), F.struct(F.col("v").alias("node"), F.lit(0).alias("out"), F.lit(1).alias("into")))).alias("e"))
    nodes = ends.groupBy("e.node").agg(F.sum("e.out").alias("out"), F.max("e.into").alias("into"))
    return not (nodes.agg(F.max(F.col("out") > 1 - F.col("into"))).first()[0] or False)


def components(edges: DataFrame) -> DataFrame:
    """``node, root``: the smallest node of each connected component, for each node that has an edge ``u, v``.

    Alternates large-star and small-star steps (map-reduce connected components) until only stars are left.
    Each round is written to the shared folder.
    """
    now = materialise(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct(), "edges")
    while not _stars(now):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = materialise(large, "large")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        after = materialise(small.select("e.u", "e.v").where("u <> v").distinct(), "edges")
        discard(large)
        discard(now)
        now = after
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """``doc_id, bits, component_id`` for each row: its SimHash and the smallest id reachable over links of at most two bits.

    Null or blank text has fingerprint zero and links like any other. Null ids get the smallest non-null id of their
    component (null if there is none). Rows that repeat an id or a text get one row each. Other columns are not read.
    """
    marked = materialise(fingerprints(docs, id_col, text_col, shingle), "simhash")
    nodes = marked.groupBy("bits").agg(F.min("doc_id").alias("low"))
    roots = components(links(nodes.select("bits")))
    rooted = nodes.join(roots, nodes.bits == roots.node, "left").select("bits", "low", F.coalesce("root", "bits").alias("root"))
    rooted = materialise(rooted, "roots")
    lows = rooted.groupBy("root").agg(F.min("low").alias("component_id"))
    named = rooted.join(lows, "root").select("bits", "component_id")
    return marked.join(named, "bits", "left").select("doc_id", "bits", "component_id")

"""Exact top-k by inner product over a pivot-distance index.

Vectors are scaled to integers. One more coordinate, sqrt(M**2 - |x|**2) with M
the largest length, gives all of them the same length, so that the largest inner
product is the smallest distance. Each vector is keyed by its nearest pivot and
its distance from it; sorted by that key, runs of vectors form blocks, each an
annulus [near, far] around its pivot. Queries are sorted and cut into blocks alike,
so that those of a block ask for much the same.

A search first opens the annuli around each query's own place, which gives a
bound r on the distance of its k-th best. By the triangle inequality a vector
within r of q lies at a distance between d(q, p) - r and d(q, p) + r from its
pivot p; only annuli that reach into that interval are opened then. Blocks are
paired by their numbers alone; a block of queries then travels to each annulus that
it opens, an annulus travels once. Scores are integers and exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, materialise, width

#: Bound of the sample that the pivots are chosen from. There is a pivot for every PER vectors of the root of their number.
SAMPLE, PIVOTS, PER = 1024, 16, 8
BLOCK, QUERIES = 512, 256
SCALE = 256


def _scaled(vectors: DataFrame, id_col: str, vec_col: str, scale: int) -> DataFrame:
    """``vec_id, x``: floor(scale * component) of the vectors that take part."""
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("v"))
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("v").isNotNull())
    bad = F.exists("v", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    return rows.where(~bad).select("vec_id", F.transform("v", lambda c: F.floor(c * scale).cast("long")).alias("x"))


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    out = np.zeros((len(column), dims), np.int64)
    for row, x in zip(out, column):
        own = x.values.to_numpy(zero_copy_only=False)
        row[: len(own)] = own
    return out


def _augmented(x: np.ndarray, most: float) -> np.ndarray:
    y = x.astype(np.float64)
    return np.hstack([y, np.sqrt(np.maximum(0, most - (y * y).sum(axis=1)))[:, None]])


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer products; by floating point where every sum stays below 2**53."""
    bound = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[1]
    return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64) if bound < 2**53 else a @ b.T


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0, (a * a).sum(1)[:, None] + (b * b).sum(1)[None] - 2 * a @ b.T))


def choose_pivots(sample: np.ndarray, n: int) -> np.ndarray:
    """Farthest-first traversal, from the first row on."""
    chosen, gap = [0], np.full(len(sample), np.inf)
    while len(chosen) < min(n, len(sample)):
        gap = np.minimum(gap, ((sample - sample[chosen[-1]]) ** 2).sum(axis=1))
        if gap.max() <= 0:
            break
        chosen.append(int(gap.argmax()))
    return sample[chosen]


def _keyed(pivots: np.ndarray, most: float, dims: int, more: tuple[str, ...] = ()):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            d = _distances(_augmented(_matrix(batch.column(1), dims), most), pivots)
            near = d.argmin(axis=1)
            columns = [batch.column(0), batch.column(1), pa.array(near, pa.int32()), pa.array(d[np.arange(len(d)), near], pa.float64()), *batch.columns[2:]]
            yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "x", "pivot", "far", *more])

    return run


_BLOCKS = "block long, pivot int, near double, far double, ids binary, xs binary"


def _blocks(size: int, dims: int, kind: str, bounded: bool = False):
    """Sorted rows in blocks of one pivot: ids and vectors as bytes (integers of ``kind``), and the bounds where there are any."""
    fields = [("block", pa.int64()), ("pivot", pa.int32()), ("near", pa.float64()), ("far", pa.float64()), ("ids", pa.binary()), ("xs", pa.binary())]
    schema = pa.schema([*fields, ("bounds", pa.binary())] if bounded else fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, made, rest = TaskContext.get().partitionId(), 0, None

        def pack(ids, xs, pivot, far, *bounds, last):
            nonlocal made
            rows, at = [], 0
            while at < len(ids):
                end = at + int(np.searchsorted(pivot[at : at + size], pivot[at], "right"))
                if end == len(ids) and end - at < size and not last:
                    break
                rows.append(((part << 32) + made, int(pivot[at]), far[at], far[end - 1], ids[at:end].tobytes(), xs[at:end].astype(kind).tobytes(), *(x[at:end].tobytes() for x in bounds)))
                made, at = made + 1, end
            return rows, at

        def batch_of(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

        for batch in batches:
            new = (batch.column(0).to_numpy(), _matrix(batch.column(1), dims), *(batch.column(k).to_numpy() for k in range(2, batch.num_columns)))
            rest = new if rest is None else tuple(np.concatenate(c) for c in zip(rest, new))
            rows, at = pack(*rest, last=False)
            rest = tuple(c[at:] for c in rest)
            if rows:
                yield batch_of(rows)
        if rest is not None and len(rest[0]):
            yield batch_of(pack(*rest, last=True)[0])

    return run


def _reach(y: np.ndarray, most: float, bounds: np.ndarray) -> np.ndarray:
    """The distance within which each query's better answers lie: |q|**2 + M**2 - 2 * score, widened against rounding."""
    return np.sqrt(np.maximum(0, (y * y).sum(1) + most - 2 * bounds.astype(np.float64))) * (1 + 1e-9) + 1e-3


def _flat(x: np.ndarray) -> np.ndarray:
    return np.hstack([x.astype(np.float64), np.zeros((len(x), 1))])


def _intervals(pivots: np.ndarray, most: float, dims: int, kind: str):
    """For each block of queries and each pivot the interval of distances that some query needs; without bounds, its own pivot and the distances from it."""
    schema = pa.schema([("qblock", pa.int64()), ("pivot", pa.int32()), ("low", pa.float64()), ("high", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, own, xs, *bounds in zip(*(c.to_pylist() for c in batch.columns)):
                y = _flat(np.frombuffer(xs, kind).reshape(-1, dims))
                d = _distances(y, pivots)
                which = np.arange(len(pivots)) if bounds else np.array([own])
                reach = _reach(y, most, np.frombuffer(bounds[0], np.int64))[:, None] if bounds else 0.0
                low, high = (d[:, which] - reach).min(axis=0), (d[:, which] + reach).max(axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(([block] * len(which), which, low, high), schema)], schema=schema)

    return run


def _score(pivots: np.ndarray, most: float, dims: int, k: int, kind: str):
    """The k best of a block for each query of a block whose interval the annulus reaches."""
    schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for pivot, near, far, ids, xs, qi, qx, *qb in zip(*batch.columns):
                pivot, near, far = pivot.as_py(), near.as_py(), far.as_py()
                q, v = np.frombuffer(qi.as_py(), np.int64), np.frombuffer(ids.as_py(), np.int64)
                qx, vx = (np.frombuffer(x.as_py(), kind).reshape(-1, dims).astype(np.int64) for x in (qx, xs))
                least = np.frombuffer(qb[0].as_py(), np.int64) if qb else np.full(len(q), -(1 << 62))
                need = np.arange(len(q))
                if qb:
                    y = _flat(qx)
                    d, reach = _distances(y, pivots[pivot : pivot + 1])[:, 0], _reach(y, most, least)
                    need = np.flatnonzero((d - reach <= far) & (d + reach >= near))
                if not len(need):
                    continue
                s = _products(qx[need], vx)
                out = {"query_id": [], "vec_id": [], "score": []}
                for row, own, bound in zip(s, q[need], least[need]):
                    ok = np.flatnonzero((row >= bound) & (v != own))
                    if len(ok) > k:
                        kth = -np.partition(-row[ok], k - 1)[k - 1]
                        ok = ok[row[ok] >= kth]
                        ok = ok[np.lexsort((v[ok], -row[ok]))[:k]]
                    out["query_id"] += [own] * len(ok)
                    out["vec_id"] += v[ok].tolist()
                    out["score"] += row[ok].tolist()
                yield pa.RecordBatch.from_pydict(out, schema=schema)

    return run


def _best(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.distinct().withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def search(vectors: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "vec_id", vec_col: str = "embedding", scale: int = SCALE) -> DataFrame:
    """``query_id, rank, vec_id, score``: each query's k highest integer inner products (all, if fewer), ties to the smaller id.

    ``queries`` have the columns of ``vectors``. A vector takes part unless it or its id is null or a component is null
    or not finite; shorter vectors count as filled up with zeros. A query is not its own candidate. Rows that repeat an
    id and a vector count once. Equal vectors tie, so of each only the k + 1 smallest ids can be answers, and the others
    are not indexed. Sums must stay within 64 bits.
    """
    spark = vectors.sparkSession
    n = width(spark)
    asked = _scaled(queries, id_col, vec_col, scale).distinct()
    every = _scaled(vectors, id_col, vec_col, scale).distinct()
    rank = F.row_number().over(Window.partitionBy("x").orderBy("vec_id"))
    every = materialise(every.withColumn("copy", rank).where(F.col("copy") <= k + 1).select("vec_id", "x"), "vectors")
    asked = materialise(asked, "queries")
    square = F.aggregate("x", F.lit(0.0), lambda s, c: s + c.cast("double") * c)
    largest = F.aggregate("x", F.lit(0).cast("long"), lambda s, c: F.greatest(s, F.abs(c)))
    (most, dims, top, count), (widest, highest) = every.agg(F.max(square), F.max(F.size("x")), F.max(largest), F.count("*")).first(), asked.agg(F.max(F.size("x")), F.max(largest)).first()
    if not dims or not widest:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    dims, top = max(dims, widest), max(top, highest)
    kind = "<i2" if top < 1 << 15 else "<i4" if top < 1 << 31 else "<i8"
    sample = every.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).select("x").toArrow()
    pivots = choose_pivots(_augmented(_matrix(sample.column(0).combine_chunks(), dims), most), min(SAMPLE, max(PIVOTS, int(count**0.5) // PER)))

    def sorted_(rows: DataFrame, parts: int, *more: str) -> DataFrame:
        placed = rows.select("vec_id", "x", *more).mapInArrow(_keyed(pivots, most, dims, more), "vec_id long, x array<long>, pivot int, far double" + "".join(f", {c} long" for c in more))
        return placed.repartitionByRange(parts, "pivot", "far", "vec_id").sortWithinPartitions("pivot", "far", "vec_id")

    index = materialise(sorted_(every, n).mapInArrow(_blocks(BLOCK, dims, kind), _BLOCKS), "annuli")
    discard(every)
    annuli = index.select("block", "pivot", "near", "far")

    def run(qs: DataFrame, bounded: bool) -> DataFrame:
        more = ("bound",) if bounded else ()
        asking = sorted_(qs, max(1, n // 4), *more).mapInArrow(_blocks(QUERIES, dims, kind, bounded), _BLOCKS + ", bounds binary" * bounded)
        asking = materialise(asking.withColumnRenamed("block", "qblock"), "asking")
        columns = ("xs", "bounds") if bounded else ("xs",)
        wanted = asking.select("qblock", "pivot", *columns).mapInArrow(_intervals(pivots, most, dims, kind), "qblock long, pivot int, low double, high double")
        wanted = wanted.select("qblock", F.col("pivot").alias("p"), "low", "high").join(annuli, F.col("p") == F.col("pivot"))
        if bounded:
            wanted = wanted.where("far >= low AND near <= high")
        else:
            # the annuli that hold, or lie nearest to, the query block's distances from its pivot
            gap = F.greatest(F.col("near") - F.col("high"), F.col("low") - F.col("far"), F.lit(0.0))
            middle = F.abs(F.col("near") + F.col("far") - F.col("low") - F.col("high"))
            near = Window.partitionBy("qblock").orderBy(gap, middle, "block")
            wanted = wanted.withColumn("turn", F.row_number().over(near)).where("turn <= 2")
        pairs = wanted.select("qblock", "block")
        carried = asking.select("qblock", F.col("ids").alias("qi"), F.col("xs").alias("qx"), *(("bounds",) if bounded else ()))
        # the queries of a block travel to the annuli that it opens; an annulus is joined where it lies
        met = pairs.join(carried, "qblock").join(index.hint("merge"), "block").select("pivot", "near", "far", "ids", "xs", "qi", "qx", *(("bounds",) if bounded else ()))
        return _best(met.mapInArrow(_score(pivots, most, dims, k, kind), "query_id long, vec_id long, score long"), k)

    bounds = run(asked, False).groupBy("query_id").agg(F.when(F.count("*") >= k, F.min("score")).alias("bound"))
    known = asked.join(bounds, asked.vec_id == bounds.query_id, "left").select("vec_id", "x", F.coalesce("bound", F.lit(-(1 << 62))).alias("bound"))
    return run(known, True).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")

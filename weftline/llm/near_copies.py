"""Near copies by SimHash: groups of texts linked by a Jaccard index of at least 0.8.

Texts with the same set of five-word shingles are one node. Each node has a SimHash of
512 bits over its set, and bit-sampling LSH over that proposes pairs: a table keeps the
more bits the more nodes there are, and so many tables are made that a pair at the limit
is expected in eight. Candidates must then be near in 128 bits of their SimHash and are
confirmed by the sets themselves; a bound that parities of the sets give on their
difference comes before, so that pairs that cannot reach the similarity are not made
rows (128 parities in small buckets, then 512 as in large ones). Nodes go to the tables
in packs of some 4 bytes a node and table, and texts are not moved. In buckets of more than SMALL nodes, rounds of 32-fold more leaders
are compared with those members that are not yet in the leader's component (the first
round takes an eighth of the tables, then the others); the rounds end when every bucket is one component or each of its pairs apart has been compared, so
no candidate is left out.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import simhash, tokenhash
from .common import among, batches_of, discard, materialise, trim, width
from .simhash import components

SHINGLE = 5
#: Similarity as a fraction; at 4/5, nine times the common shingles must be four times the sum of both sizes.
ABOVE, BELOW = 4, 5
SMALL, FIRST, GROWTH = 16, 2, 32
CELLS, FOLDED = 512, 128
#: Most of the first 128 fingerprint bits in which a candidate pair differs: at the limit 19 do on average, 4 the deviation; of unlike texts 64.
FAR = 44
_CHUNK = 1 << 15
#: Nodes that are packed together; nodes of a table that are brought together at a time, about.
PACK, PART = 1 << 13, 1 << 17


def shingles(text: str | None) -> np.ndarray:
    """Sorted distinct hashes of the lower-cased text's runs of five words; fewer words are one shingle, none are none."""
    joined = b" ".join(text.encode("utf-8", "surrogatepass").lower().split()) if text else b""
    words = tokenhash.word_hashes(joined)
    return np.unique(tokenhash.window_hashes(words, min(SHINGLE, len(words)))) if len(words) else np.zeros(0, np.uint64)


def _marked():
    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.list_(pa.int64()))
    schema = pa.schema(list(zip(("rid", "hash", "n", "simhash", "bits"), kinds)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            hashes, sizes, prints, odd, held, at, row, total = [], [], [None] * batch.num_rows, [None] * batch.num_rows, [], [], 0, 0

            def flush() -> None:
                if held:
                    for i, own in zip(at, np.packbits(simhash.wide(held), axis=1, bitorder="little")):
                        prints[i] = own.tobytes()
                    held.clear()
                    at.clear()

            for first in range(0, batch.num_rows, 512):
                for text in batch.column(1).slice(first, 512).to_pylist():
                    own = shingles(text)
                    hashes.append(xxhash.xxh64_intdigest(own.tobytes()))
                    sizes.append(len(own))
                    if len(own):
                        odd[row] = parities(own)
                        held.append(own)
                        at.append(row)
                        total += len(own)
                        if total > _CHUNK:
                            flush()
                            total = 0
                    row += 1
            flush()
            columns = [batch.column(0), np.array(hashes, np.uint64).view(np.int64), sizes, prints, odd]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) if c is not columns[0] else c for c, k in zip(columns, kinds)], schema=schema)
            trim()

    return run


def _squeezed(values: np.ndarray, size: int) -> bytes:
    """Integers of ``size`` bytes, compressed byte by byte: all lowest bytes first."""
    return pa.Codec("zstd", compression_level=1).compress(values.astype(np.int64).view(np.uint8).reshape(-1, 8)[:, :size].T.tobytes(), asbytes=True)


def _opened(held: bytes, count: int, size: int) -> np.ndarray:
    raw = np.zeros((count, 8), np.uint8)
    raw[:, :size] = np.frombuffer(pa.Codec("zstd").decompress(held, count * size), np.uint8).reshape(size, count).T
    return raw.view(np.int64).ravel()


def _bytes(places: np.ndarray, split: int) -> int:
    return -(-max(1, places.shape[1] - split) // 8)


def _packed(places: np.ndarray, split: int):
    """``part, n, nodes, keys`` from ``node, simhash``: for each table and value of its keys' lowest ``split`` bits the nodes, as differences, and the keys' other bits."""

    def packs(nodes: np.ndarray, prints: list[bytes]) -> pa.RecordBatch:
        order, out = np.argsort(nodes), ([], [], [], [])
        raw = np.frombuffer(b"".join(prints), np.uint8).reshape(len(nodes), -1)[order]
        nodes, kept, size = nodes[order], places.shape[1], _bytes(places, split)
        keys = np.concatenate([simhash.table_keys(np.unpackbits(raw[k : k + 1024], axis=1, bitorder="little"), places) for k in range(0, len(raw), 1024)])
        whole = None if split else _squeezed(np.diff(nodes, prepend=0), 8)
        for t in range(len(places)):
            own = keys[:, t] & ((1 << kept) - 1)
            low = own & ((1 << split) - 1)
            rows = np.argsort(low, kind="stable")
            ends = np.searchsorted(low[rows], np.arange((1 << split) + 1))
            for k in np.flatnonzero(np.diff(ends)):
                at = rows[ends[k] : ends[k + 1]]
                found = (t << split | int(k), len(at), whole or _squeezed(np.diff(nodes[at], prepend=0), 8), _squeezed(own[at] >> split, size))
                for column, value in zip(out, found):
                    column.append(value)
        kinds = (pa.int32(), pa.int32(), pa.binary(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], names=["part", "n", "nodes", "keys"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nodes, prints = [], []
        for batch in batches:
            nodes += batch.column(0).to_pylist()
            prints += batch.column(1).to_pylist()
            while len(nodes) >= PACK:
                yield packs(np.array(nodes[:PACK], np.int64), prints[:PACK])
                del nodes[:PACK], prints[:PACK]
        if nodes:
            yield packs(np.array(nodes, np.int64), prints)
        trim()

    return run


def _met(places: np.ndarray, split: int):
    """``key, node, size`` of the nodes that are not alone under a key, from packs in the order of ``part``."""
    kept, size = places.shape[1], _bytes(places, split)

    def buckets(part: int, held: list) -> pa.RecordBatch:
        nodes = np.concatenate([np.cumsum(_opened(a, n, 8)) for n, a, _ in held])
        keys = np.concatenate([_opened(b, n, size) for n, _, b in held]) << split | part & ((1 << split) - 1) | part >> split << kept
        order = np.argsort(keys)
        keys, nodes = keys[order], nodes[order]
        sizes = np.diff(np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1], [True]))))
        sizes = np.repeat(sizes, sizes)
        return pa.RecordBatch.from_arrays([pa.array(c[sizes > 1]) for c in (keys, nodes, sizes)], names=["key", "node", "size"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for batch in batches:
            for part, *pack in zip(*(c.to_pylist() for c in batch.columns)):
                if part != now and held:
                    yield buckets(now, held)
                    held = []
                now = part
                held.append(pack)
        if held:
            yield buckets(now, held)
        trim()

    return run


def met_in_tables(nodes: DataFrame, places: np.ndarray, count: int) -> DataFrame:
    """``key, node, size``: of ``node, simhash`` the nodes that meet others in a table, with the number of nodes there."""
    split = min(places.shape[1], max(0, (count // PART).bit_length()))
    packs = nodes.mapInArrow(_packed(places, split), "part int, n int, nodes binary, keys binary")
    packs = packs.repartition(width(nodes.sparkSession), "part").sortWithinPartitions("part")
    with batches_of(nodes.sparkSession, 256):
        return materialise(packs.mapInArrow(_met(places, split), "key long, node long, size long"), "met")


def parities(own: np.ndarray) -> np.ndarray:
    """Of each of CELLS cells of the hash space, whether it holds an odd number of the set, as CELLS / 64 integers.

    Two sets differ in at least as many elements as their parities in bits (the bitmap filter of exact similarity joins).
    """
    cells = (tokenhash.mix(own) >> np.uint64(32)) % np.uint64(CELLS)
    odd = np.bincount(cells.astype(np.int64), minlength=CELLS) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first in range(0, batch.num_rows, 512):
            part = batch.slice(first, 512)
            own = [shingles(t).view(np.int64) for t in part.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(own, pa.list_(pa.int64()))], names=["node", "own"])
        trim()


def confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those of the pairs ``u, v`` whose sets reach the similarity."""
    one, two = (sets.select(F.col("node").alias(x), F.col("own").alias(f"own_{x}")) for x in "uv")
    both = pairs.join(one, "u").join(two, "v")
    common, total = F.size(F.array_intersect("own_u", "own_v")), F.size("own_u") + F.size("own_v")
    return both.where(common * (ABOVE + BELOW) >= total * ABOVE).select(*pairs.columns)


def _merged(roots: DataFrame | None, joined: DataFrame) -> DataFrame:
    """``node, root`` after components of earlier ``roots`` were joined (``node, root``, over those roots and new nodes)."""
    if roots is None:
        return materialise(joined, "roots")
    further = joined.select(F.col("node").alias("root"), F.col("root").alias("further"))
    moved = roots.join(further, "root", "left").select("node", F.coalesce("further", "root").alias("root"))
    out = materialise(moved.unionByName(joined.join(roots, "node", "left_anti")), "roots")
    discard(roots)
    return out


def _rooted(rows: DataFrame, roots: DataFrame | None) -> DataFrame:
    """Adds ``root`` by ``node``: the node itself where nothing has linked it."""
    if roots is None:
        return rows.withColumn("root", F.col("node"))
    return rows.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))


def _within(met: DataFrame) -> DataFrame:
    """``u, v, u_root, v_root``: each pair of ``key, node, root`` that shares a key and no root, once; buckets are of SMALL nodes at most."""
    after = F.collect_list(F.struct("node", "root")).over(Window.partitionBy("key").orderBy("node").rowsBetween(1, SMALL - 1))
    apart = F.filter("after", lambda x: x.root != F.col("root"))
    pairs = met.withColumn("after", after).select(F.explode(apart).alias("x"), "node", "root")
    return pairs.select(F.col("x.node").alias("u"), F.col("node").alias("v"), F.col("x.root").alias("u_root"), F.col("root").alias("v_root")).repartition("u").dropDuplicates(["u", "v"])


def _alike(one: str, two: str) -> Column:
    """Whether sizes and SimHashes of the columns with both endings leave a pair a chance."""
    far = sum(F.bit_count(F.col(f"s{k}{one}").bitwiseXOR(F.col(f"s{k}{two}"))) for k in range(simhash.FIRST // 64))
    sizes = F.least(f"n{one}", f"n{two}") * BELOW >= F.greatest(f"n{one}", f"n{two}") * ABOVE
    return sizes & (far <= FAR)


def _bounded(one: str, two: str) -> Column:
    """Whether the parities leave a pair a chance."""
    differ = sum(F.bit_count(F.col(f"bits{one}")[k].bitwiseXOR(F.col(f"bits{two}")[k])) for k in range(CELLS // 64))
    return (F.col(f"n{one}") + F.col(f"n{two}")) * (BELOW - ABOVE) >= differ * (ABOVE + BELOW)


def _folded(one: str, two: str) -> Column:
    """``_bounded`` by a quarter of the parities, those of cells four of which are taken as one."""
    differ = sum(F.bit_count(F.col(f"f{k}{one}").bitwiseXOR(F.col(f"f{k}{two}"))) for k in range(FOLDED // 64))
    return (F.col(f"n{one}") + F.col(f"n{two}")) * (BELOW - ABOVE) >= differ * (ABOVE + BELOW)


def _folds() -> list[Column]:
    """``f0, f1`` from ``bits``."""
    step = FOLDED // 64
    return [functools.reduce(Column.bitwiseXOR, (F.col("bits")[j] for j in range(k, CELLS // 64, step))).alias(f"f{k}") for k in range(step)]


def _near(pairs: DataFrame, known: DataFrame) -> DataFrame:
    """Those of the pairs that may reach the similarity; the many that only share a bucket go before parities are fetched."""
    prints = [c for c in known.columns if c not in ("node", "bits")]
    of = lambda x, columns: known.select(F.col("node").alias(x), *(F.col(c).alias(f"{c}_{x}") for c in columns))
    out = pairs.join(of("u", prints), "u").join(of("v", prints), "v").where(_alike("_u", "_v") & _folded("_u", "_v")).select(*pairs.columns, "n_u", "n_v")
    out = out.join(of("v", ["bits"]), "v").join(of("u", ["bits"]), "u")
    return out.where(_bounded("_u", "_v")).select(*pairs.columns)


def _led(own: DataFrame, low: int, high: int) -> DataFrame:
    """``u, v, u_root, v_root`` of leaders, whose place is from ``low`` to ``high``, and members that are not yet in their component."""
    leads = own.where((F.col("place") >= low) & (F.col("place") < high))
    leads = leads.select("key", *(F.col(c).alias(f"{c}_lead") for c in own.columns if c not in ("key", "size", "place")))
    met = own.join(leads, "key").where("root <> root_lead").where(_alike("", "_lead")).where(_bounded("", "_lead"))
    one, two = F.struct(F.col("node").alias("k"), F.col("root").alias("r")), F.struct(F.col("node_lead").alias("k"), F.col("root_lead").alias("r"))
    met = met.select(F.greatest(one, two).alias("one"), F.least(one, two).alias("two"))
    return met.select(F.col("one.k").alias("u"), F.col("two.k").alias("v"), F.col("one.r").alias("u_root"), F.col("two.r").alias("v_root"))


def grouped(rows: DataFrame, text: str = "text") -> DataFrame:
    """``rid, root`` for each row of ``rid, text``: rows of one root are linked by near copies. Rids must be unique and stay.

    Null and blank texts are copies of each other.
    """
    spark = rows.sparkSession
    texts = rows.select("rid", F.col(text).cast("string").alias("text"))
    with batches_of(spark, 2048):
        marked = materialise(texts.mapInArrow(_marked(), "rid long, hash long, n int, simhash binary, bits array<long>"), "marked")
    # a node goes by its least rid
    nodes = materialise(marked.groupBy("hash").agg(F.min(F.struct("rid", "n", "simhash", "bits")).alias("m")).select("hash", F.col("m.rid").alias("node"), "m.n", "m.simhash", "m.bits"), "nodes")
    full = nodes.where("n > 0")
    count = full.count()
    places = simhash.tables(count, ABOVE / BELOW)
    met = met_in_tables(full.select("node", "simhash"), places, count)
    place = F.shiftrightunsigned(F.xxhash64("node"), 1) / float(1 << 63) * F.col("size")
    part = lambda k: F.conv(F.hex(F.substring("simhash", 8 * k + 1, 8)), 16, -10).cast("long").alias(f"s{k}")
    known = full.select("node", "n", *(part(k) for k in range(simhash.FIRST // 64)), *_folds(), "bits")
    # what is compared travels with each row of a large bucket, but with the distinct pairs of small ones
    live = materialise(met.where(F.col("size") > SMALL).join(known.drop(*(f"f{k}" for k in range(FOLDED // 64))), "node").withColumn("place", place), "live")
    most = live.agg(F.max("size")).first()[0] or 0
    early = F.shiftright("key", places.shape[1]) < len(places) // 8
    roots, low, high, parts = None, 0, FIRST, [early, ~early]
    while parts or low < most:
        # what an eighth of the tables has linked need not be compared in the others
        tables = parts.pop(0) if parts else None
        own = _rooted(live if tables is None else live.where(tables), roots)
        if roots is not None:
            own = materialise(own, "own")
            apart = own.groupBy("key").agg(F.min("root").alias("a"), F.max("root").alias("b")).where("a <> b").select("key")
            left = materialise(own.join(apart, "key", "left_semi"), "apart")
            discard(own)
            own = left
            if tables is None and own.isEmpty():
                discard(own)
                break
        pairs = _led(own, low, high)
        if tables is not None:
            pairs = pairs.unionByName(_near(_within(_rooted(met.where(F.col("size") <= SMALL).where(tables), roots)), known))
        pairs = materialise(pairs.distinct(), "pairs")
        if roots is not None:
            discard(own)
        needed = materialise(pairs.select(F.explode(F.array("u", "v")).alias("rid")), "needed")
        with batches_of(spark, 2048):
            sets = materialise(among(texts, needed).select(F.col("rid").alias("node"), "text").mapInArrow(_sets, "node long, own array<long>"), "sets")
        found = materialise(confirmed(pairs, sets).select(F.col("u_root").alias("u"), F.col("v_root").alias("v")).distinct(), "links")
        for done in (pairs, needed, sets):
            discard(done)
        if roots is None or not found.isEmpty():
            roots = _merged(roots, components(found))
        discard(found)
        if not parts:
            low, high = high, high * GROWTH
    for done in (met, live):
        discard(done)
    named = marked.select("rid", "hash").join(nodes.select("hash", "node"), "hash")
    if roots is None:
        return named.select("rid", F.col("node").alias("root"))
    return named.join(roots, "node", "left").select("rid", F.coalesce("root", "node").alias("root"))

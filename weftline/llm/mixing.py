"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

Sources get targets by weight, capped at a multiple of their size. A source's quota is
a number of blocks: whole passes over its blocks and, of one more pass in permuted
order, as many as its target takes. A binary tree splits the quotas of all sources
between equally long halves of the shards, each split a multivariate-hypergeometric
draw, so that each shard holds an exact number of blocks of each source. The shards
draw that many of the permuted blocks, disjointly; a document is taken as often as
its block was drawn. The block that crosses the target is cut into blocks again, and
again, until the one that crosses is a few thousand documents, which are resolved one
by one; then the shards shuffle locally.

Only DataFrame operations are used. Blocks are hashes of documents within their
source, a bounded number for a source, so a source of any size spreads over many
tasks, and what is ordered within a source is its blocks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, discard, materialise, width

WEIGHTS = (3, 1, 2)
SHARE, CAP = 1.5, 2.0
#: Least number of blocks of a large source, of blocks a shard, and of documents a block; levels of the tree.
BLOCKS, SHARD_BLOCKS, BLOCK_DOCS, LEVELS = 256, 16, 32, 4
#: Documents of a crossing block that are resolved one by one.
FINE = 4096


def _uniform(*parts: Column) -> Column:
    """A number in [0, 1) fixed by its arguments."""
    return F.shiftrightunsigned(F.xxhash64(*parts), 11).cast("double") / F.lit(float(1 << 53))


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """Adds ``target`` to ``src, source_size``: shares of ``share`` times all sizes by weight, at most ``cap`` times each size.

    Sources are weighed in the order of ``src``. The excess over a cap is reshared by weight. Filling the sources by
    rising ratio of cap to weight, the common level is the largest of the levels that each prefix of capped sources
    leaves. One row per source is ordered here.
    """
    index = F.row_number().over(Window.orderBy("src")) - 1
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (index % len(weights) + 1).cast("int"))
    out = sources.withColumn("weight", weight).withColumn("most", F.col("source_size") * F.lit(cap)).withColumn("ratio", F.col("most") / F.col("weight"))
    before = Window.orderBy("ratio", "src").rowsBetween(Window.unboundedPreceding, -1)
    after = Window.orderBy("ratio", "src").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    every = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    total = F.sum("source_size").over(every) * F.lit(share)
    level = (total - F.coalesce(F.sum("most").over(before), F.lit(0.0))) / F.sum("weight").over(after)
    out = out.withColumn("level", level).withColumn("level", F.max("level").over(every))
    return out.withColumn("target", F.least("most", F.greatest(F.lit(0.0), F.col("weight") * F.col("level")))).drop("weight", "most", "ratio", "level")


def _split(quotas: Column, node: Column, seed: int) -> Column:
    """Left halves of the quotas ``array<struct<src,n>>`` of a node: as many slots as half of all, drawn without regard to source."""
    total = F.aggregate(quotas, F.lit(0).cast("long"), lambda s, q: s + q.n)
    spare = F.when(_uniform(node, F.lit(seed)) < 0.5, 1).otherwise(0)
    start = F.struct(total.alias("rest"), F.floor((total + spare) / 2).cast("long").alias("want"), F.array().cast("array<long>").alias("left"))

    def source(state, q):
        def slot(inner, k):
            hit = _uniform(node, q.src, k, F.lit(seed)) * inner.rest < inner.want
            return F.struct((inner.rest - 1).alias("rest"), (inner.want - hit.cast("long")).alias("want"), (inner.got + hit.cast("long")).alias("got"))

        begin = F.struct(state.rest.alias("rest"), state.want.alias("want"), F.lit(0).cast("long").alias("got"))
        slots = F.filter(F.sequence(F.lit(0).cast("long"), q.n), lambda k: k < q.n)
        end = F.aggregate(slots, begin, slot)
        return F.struct(end.rest.alias("rest"), end.want.alias("want"), F.concat(state.left, F.array(end.got)).alias("left"))

    return F.aggregate(quotas, start, source, lambda s: s.left)


def shard_quotas(quotas: DataFrame, levels: int = LEVELS, seed: int = 42) -> DataFrame:
    """``src, shard, n`` from ``src, n``: exact numbers of slots for each of ``2**levels`` shards."""
    nodes = quotas.agg(F.sort_array(F.collect_list(F.struct("src", F.col("n").cast("long").alias("n")))).alias("q")).select(F.lit(0).alias("node"), "q")
    for level in range(levels):
        nodes = nodes.withColumn("left", _split(F.col("q"), F.col("node") + F.lit(1 << level), seed))
        left = F.zip_with("q", "left", lambda q, n: F.struct(q.src.alias("src"), n.alias("n")))
        right = F.zip_with("q", "left", lambda q, n: F.struct(q.src.alias("src"), (q.n - n).alias("n")))
        nodes = nodes.select(F.posexplode(F.array(left, right)).alias("side", "q"), "node").select((F.col("node") * 2 + F.col("side")).alias("node"), "q")
    return nodes.select(F.col("node").alias("shard"), F.explode("q").alias("x")).select("x.src", "shard", "x.n")


def row_keys(id_col: str, source_col: str, text_col: str) -> list[Column]:
    """Two 64-bit hashes of a row's id, source and text; rows that share both are copies of one document."""
    parts = [F.col(c).cast(t) for c, t in ((id_col, "long"), (source_col, "string"), (text_col, "string"))]
    return [F.xxhash64(F.lit(1), *parts).alias("k1"), F.xxhash64(F.lit(2), *reversed(parts)).alias("k2")]


def _sizes(docs: DataFrame, id_col: str, source_col: str, text_col: str) -> DataFrame:
    size = F.coalesce(F.size(F.regexp_extract_all(F.coalesce(F.col(text_col).cast("string"), F.lit("")), F.lit(WORD), F.lit(0))), F.lit(0)).cast("long")
    src = F.when(F.col(source_col).isNull(), "1").otherwise(F.concat(F.lit("0"), F.col(source_col).cast("string")))
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"), src.alias("src"), size.alias("size"), *row_keys(id_col, source_col, text_col))


def _blocks(placed: DataFrame, seed: int, *more: str) -> DataFrame:
    """``src, block, state, lack`` and the columns ``more``: the blocks of each source in permuted order, ``whole`` up to its ``lack``, then the one ``part`` that crosses it, with what lacks there."""
    blocks = placed.groupBy("src", "block").agg(F.sum("words").alias("words"), *(F.first(c).alias(c) for c in ("lack", *more)))
    through = Window.partitionBy("src").orderBy("turn", "block").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    blocks = blocks.withColumn("turn", F.xxhash64(F.lit(seed), "src", "block")).withColumn("sum", F.sum("words").over(through))
    start = F.col("sum") - F.col("words")
    state = F.when(F.col("sum") <= F.col("lack"), "whole").when(start < F.col("lack"), "part").otherwise("none")
    return blocks.select("src", "block", state.alias("state"), (F.col("lack") - start).alias("lack"), *more)


def _numbered(seed: Column | int, level: int, docs: Column, most: int) -> Column:
    """The block of a document among those of its source."""
    # a block that is cut again falls into two at least
    of = F.least(F.lit(most), F.greatest(F.lit(1 if level == 0 else 2), F.floor(docs / BLOCK_DOCS))).cast("int")
    return F.pmod(F.xxhash64(F.lit(seed), F.lit(level), "k1", "k2"), of)


def _resolved(crossing: DataFrame) -> DataFrame:
    """Of a few documents a source (``src, lack, words, key, k1, k2``) those that come nearest to what lacks, as ``k1, k2``.

    A prefix of their permutation up to three quarters; then, again and again, the largest of the rest that still fit;
    then the one that comes nearest.
    """
    whole = Window.partitionBy("src")
    upto = lambda *order: whole.orderBy(*order, "key", "k1", "k2").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    crossing = crossing.withColumn("in", F.sum("words").over(upto()) <= 0.75 * F.col("lack"))
    miss = F.col("lack") - F.sum(F.when(F.col("in"), F.col("words")).otherwise(0)).over(whole)
    for _ in range(3):
        crossing = crossing.withColumn("miss", miss)
        fits = F.when(~F.col("in") & (F.col("words") <= F.col("miss")), F.col("words"))
        crossing = crossing.withColumn("fits", fits).withColumn("sum", F.sum("fits").over(upto(F.desc("fits"))))
        crossing = crossing.withColumn("in", F.col("in") | (F.col("fits").isNotNull() & (F.col("sum") <= F.col("miss"))))
    crossing = crossing.withColumn("miss", miss)
    place = F.when(~F.col("in") & (F.col("words") > 0) & (F.col("words") < 2 * F.col("miss")), F.struct(F.abs(F.col("miss") - F.col("words")).alias("d"), "key", "k1", "k2"))
    crossing = crossing.withColumn("place", place).withColumn("best", F.min("place").over(whole))
    return crossing.where(F.col("in") | (F.col("place") == F.col("best"))).select("k1", "k2")


def _crossed(placed: DataFrame, blocks: DataFrame, seed: int, most: int) -> DataFrame:
    """``k1, k2`` of the documents that the crossing blocks give: cut again until few documents cross."""
    own = ("k1", "k2", "key", "src", "words")
    inside = lambda docs, of, state: docs.select(*own, "block").join(of.where(F.col("state") == state).select("src", "block", "lack"), ["src", "block"]).select(*own, "lack")
    crossing, given, level = materialise(inside(placed, blocks, "part"), "crossing"), None, 1
    while True:
        counts = crossing.groupBy("src").agg(F.count("*").alias("docs"))
        if (counts.agg(F.max("docs")).first()[0] or 0) <= FINE:
            last = _resolved(crossing)
            return last if given is None else given.unionByName(last)
        cut = crossing.join(counts, "src").withColumn("block", _numbered(seed, level, F.col("docs"), most)).drop("docs")
        cut = materialise(cut, "cut")
        of = materialise(_blocks(cut, seed + 1 + level), "cut_blocks")
        taken = materialise(inside(cut, of, "whole").select("k1", "k2"), "given")
        given = taken if given is None else given.unionByName(taken)
        after = materialise(inside(cut, of, "part"), "crossing")
        for done in (crossing, cut, of):
            discard(done)
        crossing, level = after, level + 1


def decide(sizes: DataFrame, levels: int = LEVELS, seed: int = 42) -> DataFrame:
    """``k1, k2, source_size, target, copies, shards`` for each distinct row of ``src, size, k1, k2``."""
    most = max(BLOCKS, SHARD_BLOCKS << levels)
    rows = sizes.groupBy("k1", "k2", "src", "size").agg(F.count("*").alias("rows")).withColumn("words", F.col("size") * F.col("rows"))
    sources = targets(rows.groupBy("src").agg(F.sum("words").alias("source_size"), F.count("*").alias("docs")))
    passes = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    sources = sources.withColumn("passes", passes).withColumn("lack", F.col("target") - F.col("passes") * F.col("source_size"))
    sources = materialise(sources, "sources")

    placed = rows.join(sources, "src").withColumn("key", F.xxhash64(F.lit(seed), "k1", "k2")).withColumn("block", _numbered(seed, 0, F.col("docs"), most))
    placed = materialise(placed.select("k1", "k2", "key", "src", "block", "words", "size", "source_size", "target", "passes", "lack"), "placed")
    blocks = materialise(_blocks(placed, seed + 1, "passes"), "blocks")
    drawn = _crossed(placed, blocks, seed, most).withColumn("drawn", F.lit(True))

    # each source's quota of blocks, split by the tree; the shards then take their shares off the permuted blocks
    slots = blocks.withColumn("n", F.col("passes") + F.when(F.col("state") == "none", 0).otherwise(1)).where("n > 0")
    slots = slots.select("src", "block", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))).alias("copy"))
    dealt = Window.partitionBy("src").orderBy(F.xxhash64(F.lit(seed + 2), "src", "block", "copy"), "block", "copy")
    slots = slots.withColumn("rank", F.row_number().over(dealt).cast("long"))
    quotas = shard_quotas(slots.groupBy("src").agg(F.count("*").alias("n")), levels, seed)
    through = F.sum("n").over(Window.partitionBy("src").orderBy("shard").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    seats = quotas.withColumn("upto", through).where("n > 0").select("src", "shard", F.explode(F.sequence(F.col("upto") - F.col("n") + 1, F.col("upto"))).alias("rank"))
    homes = slots.join(seats, ["src", "rank"]).groupBy("src", "block").agg(F.transform(F.sort_array(F.collect_list(F.struct("copy", "shard"))), lambda x: x.shard).alias("seats"))

    known = blocks.join(homes, ["src", "block"], "left").select("src", "block", "state", "seats")
    out = placed.join(known, ["src", "block"]).join(drawn, ["k1", "k2"], "left")
    # a document is taken as often as shards drew its block, but for the crossing one's last time
    without = F.when((F.col("state") == "part") & F.col("drawn").isNull(), 1).otherwise(0)
    out = out.withColumn("seats", F.coalesce("seats", F.array().cast("array<int>"))).withColumn("copies", (F.size("seats") - without).cast("long"))
    return out.select("k1", "k2", "source_size", "target", "copies", F.slice("seats", F.lit(1), F.col("copies").cast("int")).alias("shards"))


def mix(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", levels: int = LEVELS, seed: int = 42) -> DataFrame:
    """One row per input row: ``doc_id, source, size, source_size, target, copies, taken, shards``.

    ``copies`` times the document goes into the mix, once into each of ``shards``. Null text has size 0; a null source
    is a source of its own, weighed last; null ids are documents like any other. Rows that agree in id, source and text
    are drawn together; rows that share an id only are separate. Sources of size 0 have target 0; an empty table gives
    no rows. Reruns agree: every draw is a hash of a row's contents and ``seed``. Other columns are not read.
    """
    sizes = materialise(_sizes(docs, id_col, source_col, text_col), "sizes")
    out = sizes.join(decide(sizes, levels, seed), ["k1", "k2"])
    return out.select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"), "shards")


def draw(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", levels: int = LEVELS, seed: int = 42) -> DataFrame:
    """The mix itself: the rows of ``docs``, all columns, once per shard they go to, dealt out by shard and shuffled inside."""
    decided = decide(materialise(_sizes(docs, id_col, source_col, text_col), "sizes"), levels, seed).where("copies > 0").select("k1", "k2", "shards")
    boxed = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), *row_keys(id_col, source_col, text_col))
    out = boxed.join(decided, ["k1", "k2"]).select("row", "k1", "k2", F.posexplode("shards").alias("copy", "shard"))
    turn = F.xxhash64(F.lit(seed + 3), "k1", "k2", "copy")
    # a shard's documents spread over as many tasks as its share of the partitions
    spread = max(16, -(-2 * width(docs.sparkSession) // 2**levels))
    return out.repartition("shard", F.pmod(turn, F.lit(spread))).sortWithinPartitions("shard", turn).select("row.*")

"""Document fingerprints: threshold-scaled sketches of word shingles.

A sketch keeps every shingle hash below a fixed fraction of the hash range, so a
document keeps hashes in proportion to its length, the sketch of a union is the
union of sketches, and containment can be estimated between documents of very
unequal length. Only DataFrame operations are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ascii_lower, let, width

#: By default every hash is kept: of a short text's few shingles, a fraction may be none.
SHINGLE, SCALE = 5, 1
_LEAST = -(1 << 63)


def sketch(text: Column, shingle: int = SHINGLE, scale: int = SCALE) -> Column:
    """``struct<n, whole, kept>``: the number of shingles, repeats included, a hash of their sequence, and the sorted distinct hashes in the lowest 1/``scale`` of the range.

    Words are set apart by ASCII white space, A-Z lower-cased; fewer words than ``shingle`` are one shingle, none are none.
    """
    words = F.filter(F.split(ascii_lower(F.coalesce(text, F.lit(""))), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    hashed = F.transform(words, lambda w: F.xxhash64(w))

    def shingles(own: Column) -> Column:
        at = F.sequence(F.lit(0), F.size(own) - shingle)
        every = F.transform(at, lambda i: F.xxhash64(*(F.get(own, i + k) for k in range(shingle))))
        return F.when(F.size(own) >= shingle, every).when(F.size(own) > 0, F.array(F.xxhash64(own))).otherwise(F.array().cast("array<long>"))

    def kept(every: Column) -> Column:
        low = F.filter(every, lambda h: h <= F.lit(_LEAST + (1 << 64) // scale - 1)) if scale > 1 else every
        return F.struct(F.size(every).alias("n"), F.xxhash64(every).alias("whole"), F.array_sort(F.array_distinct(low)).alias("kept"))

    return let(let(hashed, shingles), kept)


def as_text(own: Column) -> Column:
    """The sketch as text: the number of shingles, a colon, and the leading ten hex digits of each kept hash."""
    return F.concat(own.n.cast("string"), F.lit(":"), F.array_join(F.transform(own.kept, lambda h: F.lower(F.substring(F.hex(h), 1, 10))), ""))


def likeness(a: Column, b: Column) -> Column:
    """Estimated share of common shingles (Jaccard); for two empty sketches 1 if their texts have the same shingles in the same order, else 0."""
    common = F.size(F.array_intersect(a.kept, b.kept))
    either = F.size(a.kept) + F.size(b.kept) - common
    return F.when(either > 0, common / either).otherwise(F.when((a.n == b.n) & (a.whole == b.whole), 1.0).otherwise(0.0))


def containment(a: Column, b: Column) -> Column:
    """Estimated share of a's shingles that b has; null for an empty sketch."""
    return F.when(F.size(a.kept) > 0, F.size(F.array_intersect(a.kept, b.kept)) / F.size(a.kept))


def merge(*sketches: Column) -> Column:
    """Kept hashes of the union of documents, from the kept hashes of each."""
    return F.array_sort(F.array_distinct(F.concat(*sketches)))


def _below(cuts: list[int], value: Column) -> Column:
    """How many of the sorted cuts lie below the value, by bisection."""
    listed, steps = F.array(*map(F.lit, cuts)), [1 << k for k in range(len(cuts).bit_length() - 1, -1, -1)]
    return F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), lambda at, n: F.when(F.get(listed, at + n - 1) < value, at + n).otherwise(at))


def with_next(docs: DataFrame, id_col: str, own: str) -> DataFrame:
    """Adds ``next``, the struct ``own`` of the following row by descending id (nulls last; of equal ids by hash of ``own``, then by it); the last row's is the first's.

    Rows are dealt out by ranges of that order, cut by quantiles of the ids; an id that many quantiles fall on, or null,
    is cut by its hashes. The first row of each range closes the range before it: of these the driver sees one id and
    hash a range, four ranges a partition. Each row is shuffled once.
    """
    spark = docs.sparkSession
    ranges = 4 * width(spark)
    got, rows_, nulls = docs.agg(F.percentile_approx(id_col, [k / ranges for k in range(1, ranges)], 10 * ranges), F.count("*"), F.count_if(F.col(id_col).isNull())).first()
    found = sorted(got or [])
    cuts = sorted(set(found))
    folds = [found.count(c) for c in cuts] if len(cuts) < len(found) else [1] * len(cuts)
    blank = 1 + nulls * ranges // max(1, rows_)
    hashed = F.xxhash64(own)
    fold = lambda n: F.least(n - 1, F.floor((hashed / F.lit(float(1 << 64)) + 0.5) * n)).cast("long")
    side = F.lit(1 << 32)
    place = F.lit(0).cast("long")
    if cuts:
        at = _below(cuts, F.col(id_col))
        top, n = F.get(F.array(*map(F.lit, cuts)), at), F.get(F.array(*map(F.lit, folds)), at)
        own_fold = F.when(F.col(id_col) == top, fold(n)).otherwise(n) if max(folds) > 1 else F.lit(0)
        place = (F.lit(len(cuts)) - at).cast("long") * side + F.coalesce(own_fold.cast("long"), F.lit(0).cast("long"))
    place = F.when(F.col(id_col).isNull(), F.lit(len(cuts) + 1).cast("long") * side + fold(F.lit(blank))).otherwise(place)
    rows = docs.select("*", place.alias("place"), hashed.alias("hash"))
    tops = rows.select("place", F.struct((-F.col(id_col)).alias("below"), "hash").alias("key")).groupBy("place").agg(F.min("key").alias("key")).collect()
    if not tops:
        return rows.withColumn("next", F.col(own)).drop("place", "hash")
    tops.sort(key=lambda r: r.place)
    heads = spark.createDataFrame([(r.place, r.key.below, r.key.hash, tops[k - 1].place) for k, r in enumerate(tops)], "place long, below long, hash long, above long")
    joined = rows.withColumn("below", -F.col(id_col)).join(F.broadcast(heads.withColumnsRenamed({"below": "least"})), ["place", "hash"])  # one row a range
    heads = joined.where(F.col("below").eqNullSafe(F.col("least"))).groupBy("above").agg(F.min(own).alias("head"))
    lead = F.lead(own).over(Window.partitionBy("place").orderBy(F.col(id_col).desc_nulls_last(), "hash", own))
    out = rows.withColumn("next", lead).join(heads, (F.col("place") == F.col("above")) & F.col("next").isNull(), "left")
    return out.withColumn("next", F.coalesce("next", "head")).drop("place", "hash", "above", "head")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, scale: int = SCALE) -> DataFrame:
    """One row per input row: ``doc_id, n_chars, sketch, edited, edited_sketch, next_sketch``.

    ``edited`` is the text whose last half (rounded down) is replaced by as many code points, or all, of the next
    document by descending id; after the last comes the first. Null text is empty. Null ids come last. Rows that repeat
    an id follow each other by hash of the text. Other columns are not read.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    rows = rows.select("doc_id", F.struct("text").alias("own"))  # sketches are made after the shuffle
    rows = with_next(rows, "doc_id", "own")
    text = F.col("own.text")
    n = F.length(text).cast("long")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring(text, F.lit(1), (n - half).cast("int")), F.substring(F.col("next.text"), F.lit(1), half))
    rows = rows.select("doc_id", n.alias("n_chars"), text.alias("text"), edited.alias("edited"), F.col("next.text").alias("next"))
    made = (sketch(F.col(c), shingle, scale).alias(name) for c, name in (("text", "sketch"), ("edited", "edited_sketch"), ("next", "next_sketch")))
    return rows.select("doc_id", "n_chars", "edited", *made)

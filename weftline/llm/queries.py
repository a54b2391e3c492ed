"""The registered queries of the training-data operators, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import language_id, license_scan, mixing, packing, pii, quality, simhash, sketch, substring_dedup, topk


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents")).drop("detections")


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup.dedup_substrings(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path(), keep_ids=False).drop("ids")


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lpad(F.lower(F.hex("bits")), 16, "0").alias("fingerprint"), "component_id")


def op5_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return topk.search(vectors, vectors.where(F.col("vec_id") % 50 == 0), 5)


def _remainder(modulus: int):
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % modulus


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = quality.fit(docs, labels.where(_remainder(3) != 1))
    held = F.coalesce(_remainder(3) == 1, F.lit(False))
    return quality.score(docs, model).select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    net = language_id.fit(docs.where(_remainder(4) != 2))
    held = F.coalesce(_remainder(4) == 2, F.lit(False))
    return language_id.predict(docs, net).select("doc_id", held.alias("held_out"), "lang_pred", "score")


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda x: x["kind"] < pii.BASE)
    count = lambda k: F.size(F.filter("spans", lambda x: x["kind"] == k)).cast("long")
    return found.select(
        "doc_id",
        *(count(k).alias(f"n_{kind.name}") for k, kind in enumerate(pii.KINDS[: pii.BASE])),
        F.sha2(pii.listed(base).cast("binary"), 256).alias("base_sha256"),
        pii.listed(F.col("spans")).alias("spans"),
    )


def op9_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    own, edited, after = (F.col(c) for c in ("sketch", "edited_sketch", "next_sketch"))
    return sketch.fingerprints(table(spark, sf_dir, "documents")).select(
        "doc_id",
        "n_chars",
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        sketch.as_text(own).alias("fingerprint"),
        sketch.as_text(edited).alias("edited_fingerprint"),
        sketch.likeness(own, edited).alias("near_edited"),
        sketch.likeness(own, after).alias("near_next"),
    )


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "copies", F.array_join(F.col("shards").cast("array<string>"), ",").alias("shards"))


def _license_sql() -> str:
    """The license scan in SQL: words doubled in their spaces, so that a match takes whole words without looking around."""
    from .license_rules import CONFIDENCE, rules

    text = lambda v: "'" + v.replace("'", "''") + "'"
    wide = lambda p: " (" + p.replace(" ?", "\0").replace("[^ ]", "\1").replace(" ", "  ").replace("\0", "(?:  )?").replace("\1", "[^ ]") + ") "
    listed = ", ".join(f"({r.rank}, {text(r.label)}, {text(r.keyword)}, {text(wide(r.pattern))}, {r.priority}, {str(r.base).lower()}, {CONFIDENCE[r.priority]})" for r in rules())
    return f"""
WITH rules(rank, label, keyword, pattern, priority, base, confidence) AS (VALUES {listed}),
d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\\x{{80}}-\\x{{10FFFF}}]+') AS w FROM documents),
lines AS (SELECT doc_id, len(w) AS n, ' ' || array_to_string(w, ' ') || ' ' AS narrow, ' ' || array_to_string(w, '  ') || ' ' AS wide FROM d),
gated AS (SELECT doc_id, wide, r.* FROM lines JOIN rules r ON contains(narrow, keyword)),
cut AS (SELECT *, string_split_regex(wide, pattern) AS rest, regexp_extract_all(wide, pattern) AS hit FROM gated),
size AS (SELECT *, list_transform(rest, lambda x: (length(x) - length(replace(x, ' ', ''))) // 2) AS a, list_transform(hit, lambda x: (length(x) - length(replace(x, ' ', ''))) // 2) AS b FROM cut WHERE len(hit) > 0),
det AS (SELECT doc_id, rank, label, priority, base, confidence, i, list_sum(a[1:i]) + coalesce(list_sum(b[1:i - 1]), 0) AS s, b[i] AS k FROM (SELECT *, unnest(range(1, len(b) + 1)) AS i FROM size)),
kept AS (SELECT * FROM det h WHERE base OR NOT EXISTS (SELECT 1 FROM det e WHERE e.doc_id = h.doc_id AND NOT e.base AND e.s <= h.s AND e.s + e.k >= h.s + h.k AND e.priority <= h.priority
  AND (e.s <> h.s OR e.k <> h.k OR e.priority < h.priority OR (e.priority = h.priority AND e.rank < h.rank)))),
one AS (SELECT doc_id, count(*) FILTER (WHERE base) AS n_base, min(s) FILTER (WHERE base) AS f, max(s) FILTER (WHERE base) AS l, array_to_string(list_sort(list(DISTINCT label) FILTER (WHERE base)), ',') AS base_labels,
  array_to_string(list_sort(list(DISTINCT label)), ',') AS labels, max(confidence) AS score FROM kept GROUP BY doc_id)
SELECT doc_id, n::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, f::BIGINT AS first_word, l::BIGINT AS last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0)::DOUBLE AS score
FROM lines LEFT JOIN one USING (doc_id)
"""


QUERIES = {f.__name__: f for f in (op1_license_scan, op2_substring_dedup, op3_packing, op4_simhash, op5_topk, op6_quality, op7_pii, op8_language_id, op9_fingerprints, op10_mixing)}

SQL = {
    "op1_license_scan": _license_sql(),
    "op5_topk": """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda c: floor(256 * c::DOUBLE)::BIGINT) AS x FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.x::DOUBLE[], c.x::DOUBLE[])::BIGINT AS score FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id)
SELECT query_id, rank::INTEGER AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5
""",
    "op2_substring_dedup": """
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
win AS (SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d)),
low AS (SELECT k, min(doc_id) AS m FROM win GROUP BY k),
gone AS (SELECT DISTINCT doc_id, i + j AS p FROM (SELECT doc_id, i, unnest(range(0, 13)) AS j FROM win JOIN low USING (k) WHERE m < doc_id)),
words AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM d),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS t, count(*) AS n FROM words ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
""",
}

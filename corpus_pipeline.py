"""A corpus pipeline of five of the training-data operators.

``STAGES`` lists (name, function); each function takes (spark, docs, sf_dir) and
returns a DataFrame, which is written as Parquet and read back as the next one's
``docs``. All but the last return the columns of ``documents``.

Nulls, empty and very long texts, repeated rows, empty tables and extra columns are
handled as the operators' docstrings say: a null or letterless text is rejected by
the first stage, repeated rows count as copies, extra columns are carried along
until the last stage.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm import language_id, mixing, near_copies, packing, pii, queries
from weftline.llm.common import among, batches_of, materialise, standing, sweep

#: Least mean probability of the predicted language: below, a document counts as of no known language.
SURE = 0.4


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the documents whose language the network knows; a null or letterless text has none."""
    net = language_id.fit(docs)
    columns = docs.columns
    boxed = docs.withColumn("_row", F.struct(*(F.col(f"`{c}`") for c in columns)))
    found = language_id.predict(boxed, net, carry=["_row"])
    sure = found.where((F.col("lang_pred") != "und") & (F.col("score") >= SURE)).select("_row.*")
    with batches_of(spark, 512):
        return materialise(sure, "identified")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near copies: the one with the smallest id (null ids last; of repeated ids, by hash of the content)."""
    boxed = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row"), F.monotonically_increasing_id().alias("rid"))
    boxed = materialise(boxed, "boxed")
    roots = near_copies.grouped(boxed.select("rid", F.col("_row.text").alias("text")))
    rank = F.struct(F.col("_row.doc_id").isNull().alias("last"), F.col("_row.doc_id").alias("id"), F.xxhash64(*(f"_row.{c}" for c in ("text", "lang", "source", "n_chars"))).alias("content"), "rid")
    ranked = boxed.select("rid", rank.alias("rank")).join(roots, "rid")
    kept = materialise(ranked.groupBy("root").agg(F.min("rank").alias("rank")).select(F.col("rank.rid").alias("rid")), "kept")
    return among(boxed, kept).select("_row.*")  # no document is moved


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace each span of personal data by its kind; the count of characters follows."""
    clean = pii.redact(docs)
    return clean.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.length("text").cast("long")).otherwise(F.col("n_chars")))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Draw the mix: each document as often as its source's target asks, dealt out to shards."""
    return mixing.draw(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack the mix into sequences of 2048 tokens; one row per piece."""
    return packing.pack(docs, queries.tokenizer_path(), keep_ids=False, rows=512, most=60_000).drop("ids")  # workers share the executor with what earlier stages hold


def _tidy(stage):
    """The stage, after what earlier stages have left in the shared folder is deleted (their outputs are written by then; what ``docs`` still reads stays)."""

    name = stage.__name__

    @functools.wraps(stage)
    def tidied(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        sweep(spark, docs, since=standing() - _left)
        before = standing()
        out = stage(spark, docs, sf_dir)
        if name != "pack_sequences":  # nothing tells when the last stage's output is written
            _left.update(standing() - before)
        return out

    return tidied


#: Paths of the intermediate tables that stages have written.
_left: set[str] = set()
STAGES = [
    ("language_id", _tidy(identify_language)),
    ("simhash_near_dedup", _tidy(drop_near_duplicates)),
    ("pii", _tidy(redact_personal_data)),
    ("mixing", _tidy(mix_sources)),
    ("best_fit_packing", _tidy(pack_sequences)),
]

#: The network and the tokenizer are beyond SQL; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again; what a stage has left there then goes, but for its output."""
    before, docs = standing(), spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialise(docs, name)
            sweep(spark, docs, since=before)
    return docs

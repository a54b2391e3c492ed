"""License scan: ordered signature rules over words, with keyword gates and suppression.

A text becomes its words joined by one space. A keyword that occurs opens the gate
of its rules; only then do their expressions run. Each match is an interval of
words. A match is suppressed if another rule of the same or a better priority
contains its interval (equal intervals: the better priority, then the lower rank
stays). Base phrases neither suppress nor are suppressed.

Only DataFrame operations are used: keywords, rules and matches are arrays of the
row; suppression is a running maximum over a document's ordered matches.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ascii_lower
from .license_rules import CONFIDENCE, Rule, rules

_MARK = "\u0001"  # no word holds it


def _matches(text: Column, rule: Column) -> Column:
    """Word intervals of a rule's matches: the first word of each match is marked, then found again by its place."""
    bounded = F.concat(F.lit("(?<= )("), rule.pattern, F.lit(")(?= )"))
    words = F.split(F.regexp_replace(text, bounded, F.lit(_MARK + "$1")), " ")
    starts = F.filter(F.transform(words, lambda w, i: F.when(w.startswith(_MARK), i)), lambda i: i.isNotNull())
    lengths = F.transform(F.regexp_extract_all(text, bounded, F.lit(0)), lambda m: F.length(m) - F.length(F.replace(m, F.lit(" "), F.lit(""))) + 1)
    return F.zip_with(starts, lengths, lambda i, n: F.struct((i - 1).cast("long").alias("start"), (i - 1 + n).cast("long").alias("end"), rule["rank"].alias("rank"), rule.label.alias("label"), rule.priority.alias("priority"), rule.base.alias("base")))


def _gates(listed: list[Rule]) -> Column:
    """The rules by keyword, as one constant. It is written as SQL, which is parsed at once, and holds no quotes."""
    by: dict[str, list[str]] = {}
    for r in listed:
        row = f"named_struct('rank', {r.rank}, 'label', r'{r.label}', 'pattern', r'{r.pattern}', 'priority', {r.priority}, 'base', {str(r.base).lower()})"
        by.setdefault(r.keyword, []).append(row)
    if any("'" in r.keyword + r.label + r.pattern for r in listed):
        raise ValueError("rules must not hold quotes: words do not")
    return F.expr("array(" + ", ".join(f"named_struct('keyword', r'{k}', 'rules', array({', '.join(rows)}))" for k, rows in by.items()) + ")")


def words_of(text: Column) -> Column:
    """The lower-cased words, each between single spaces (empty without words)."""
    return F.regexp_replace(ascii_lower(F.concat(F.lit(" "), F.coalesce(text.cast("string"), F.lit("")), F.lit(" "))), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", " ")


def detections(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", listed: list[Rule] | None = None) -> DataFrame:
    """Every match of every row: ``uid, doc_id, n_words, start, end, rank, label, priority, base, kept``; a row without a match once, with nulls.

    ``uid`` tells input rows apart. Words count from 0, ``end`` is exclusive.
    """
    listed = rules() if listed is None else listed
    rows = docs.select(F.monotonically_increasing_id().alias("uid"), F.col(id_col).cast("long").alias("doc_id"), words_of(F.col(text_col)).alias("text"))
    n_words = F.greatest(F.length("text") - F.length(F.replace(F.col("text"), F.lit(" "), F.lit(""))) - 1, F.lit(0)).cast("long")
    rows = rows.select("uid", "doc_id", "text", n_words.alias("n_words"), F.filter(_gates(listed), lambda g: F.contains(F.col("text"), g.keyword)).alias("gates"))
    found = F.flatten(F.transform(F.flatten(F.transform("gates", lambda g: g.rules)), lambda r: _matches(F.col("text"), r)))
    rows = rows.select("uid", "doc_id", "n_words", F.when(F.size("gates") > 0, found).alias("found"))
    rows = rows.select("uid", "doc_id", "n_words", F.explode_outer("found").alias("m")).select("uid", "doc_id", "n_words", "m.*")
    before = Window.partitionBy("uid").orderBy("start", F.desc("end"), "priority", "rank").rowsBetween(Window.unboundedPreceding, -1)
    covered = F.lit(False)
    for level in sorted({r.priority for r in listed if not r.base}):
        reach = F.max(F.when(~F.col("base") & (F.col("priority") <= level), F.col("end"))).over(before)
        covered = F.when(F.col("priority") == level, F.coalesce(reach >= F.col("end"), F.lit(False))).otherwise(covered)
    return rows.withColumn("kept", F.col("base") | ~covered)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", listed: list[Rule] | None = None) -> DataFrame:
    """One row per input row: ``doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score``, and ``detections``.

    ``score`` is the confidence of the best rule kept (0 without one). Null and empty texts have no words and no labels;
    null ids and repeated rows are scanned like any other; an empty table gives no rows. Other columns are not read.
    """
    listed = rules() if listed is None else listed
    confidence = F.lit(0.0)
    for priority, value in CONFIDENCE.items():
        confidence = F.when(F.col("priority") == priority, F.lit(value)).otherwise(confidence)
    base, start = F.col("base"), F.col("start")
    joined = lambda which: F.array_join(F.array_sort(F.collect_set(F.when(which, F.col("label")))), ",")
    return detections(docs, id_col, text_col, listed).groupBy("uid", "doc_id", "n_words").agg(
        F.count_if(base).alias("n_base"),
        F.min(F.when(base, start)).alias("first_word"),
        F.max(F.when(base, start)).alias("last_word"),
        joined(base).alias("base_labels"),
        joined(F.col("kept")).alias("labels"),
        F.max(F.when(F.col("kept"), confidence).otherwise(0.0)).alias("score"),
        F.sort_array(F.collect_list(F.when(F.col("kept"), F.struct("start", "end", "rank", "label", "priority")))).alias("detections"),
    ).drop("uid")

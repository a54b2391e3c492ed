"""Virtual corpora: the driver's tables seen through the data model."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.markup import Writer, to_bytes
from ..operators import build
from ..operators.items import folded, item
from ..schema import SEGMENT

TOKEN = "<[^>]*>|[^<]+"
_PLACED = "array<struct<t:string,kind:string,depth:int>>"
#: Elements without an end tag: fixed values.
VOID = "area base br col embed hr img input link meta source track wbr".split()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``doc_id, lang, source, segment``: a document's lines as text items."""
    segment = F.transform(F.split("text", "\n"), lambda t: item("text", 0, text=t)).cast(SEGMENT)
    return table(spark, sf_dir, "documents").select("doc_id", "lang", "source", segment.alias("segment"))


def _kind(token: Column) -> Column:
    """Text, an inline kind by the tag's name, or unknown for what no end tag closes."""
    name = F.lower(F.regexp_extract(token, "^</?([A-Za-z0-9]+)", 1))
    leaf = token.rlike("^<!|^<[?]|/>$") | name.isin(VOID)
    kind = F.when(name.isin("a", "span"), "ph").when(name.isin("b", "i", "em", "strong"), "hi").otherwise("sub")
    return F.when(~token.startswith("<"), "text").when(leaf, "unknown").otherwise(kind)


def tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``page_id, segment``: the tree of a page's tags; tags without end are unknown items, end tags close the innermost node."""
    tokens = F.transform(F.regexp_extract_all("html", F.lit(TOKEN), F.lit(0)), lambda t: F.struct(t.alias("t"), _kind(t).alias("kind"), t.startswith("</").alias("ends")))

    def step(depth: Column, x: Column) -> tuple[Column, Column]:
        after = F.when(x["ends"], F.greatest(depth - 1, F.lit(0))).when(x["kind"].isin("text", "unknown"), depth).otherwise(depth + 1)
        return after, F.when(x["ends"], F.array().cast(_PLACED)).otherwise(F.array(F.struct(x["t"].alias("t"), x["kind"].alias("kind"), depth.alias("depth"))))

    def made(x: Column) -> Column:
        t, kind = x["t"], x["kind"]
        name = F.when(~kind.isin("text", "unknown"), F.lower(F.regexp_extract(t, "^<([A-Za-z0-9]+)", 1)))
        return item(kind, x["depth"], text=F.when(kind == "text", t), payload=F.when(kind == "unknown", t), type=name)

    placed = folded(tokens, F.lit(0), step, _PLACED)
    return table(spark, sf_dir, "pages").select("page_id", F.transform(placed, made).cast(SEGMENT).alias("segment"))


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``source, props``: a unit per source whose props are its documents' labels, in order of id, with repetitions."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    joined = table(spark, sf_dir, "labels").join(docs, "doc_id")
    pair = F.array(F.struct(F.lit("quality").alias("kind"), F.col("quality").cast("string").alias("text")), F.struct(F.lit("toxic").alias("kind"), F.col("toxic").cast("string").alias("text")))
    rows = joined.select("source", "doc_id", F.posexplode(pair).alias("k", "p"))
    own = F.sort_array(F.collect_list(F.struct("doc_id", "k", "p")))
    return rows.groupBy("source").agg(F.transform(own, lambda x: x["p"]).alias("props"))


def rich_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A unit per document with every attribute, notes, props, unknown nodes, and a segment that holds each inline kind.

    ``memory_id`` is the source, ``unit_pos`` the document's id.
    """
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "lang", "source", F.length("text").cast("long").alias("n"))
    key, n = F.col("id").cast("string"), F.col("n")
    when = F.timestamp_seconds(F.lit(1_700_000_000) + F.col("id"))
    shared = {
        "original_encoding": "utf-8", "original_data_type": F.concat(F.lit("type "), key), "usage_count": n, "last_used_at": when, "creation_tool": "tool & <co>",
        "creation_tool_version": key, "created_at": when, "created_by": F.concat(F.lit('a"b'), key), "last_modified_at": when, "last_modified_by": "é", "original_tm_format": "fmt",
    }
    node = lambda tag: F.array(F.encode(F.concat(F.lit(f"<{tag} k=\""), key, F.lit(f"\">x</{tag}>")), "UTF-8"))
    extra = F.array(F.struct(F.lit("mine").alias("k"), key.alias("v")))
    note = build.note(F.concat(F.lit("note "), key), language=F.col("lang"), original_encoding="latin-1", extra=extra)
    prop = build.prop(F.concat(F.lit("prop & "), key), kind=F.col("source"), language="en", extra_nodes=node("deep"))
    segment = F.array(
        item("text", 0, text=F.concat(F.lit("a<b "), key)),
        item("bpt", 0, internal_id=F.col("id"), external_id=n, type="bold", extra=extra), item("sub", 1, data_type="html", type="t"), item("text", 2, text="in sub"),
        item("ept", 0, internal_id=F.col("id")), item("it", 0, position="begin", external_id=F.lit(7), type="x"),
        item("ph", 0, association="p", external_id=F.lit(8), type=key), item("text", 1, text="held"),
        item("hi", 0, external_id=F.lit(9), type="mark"), item("hi", 1, type="inner"), item("text", 2, text=key),
        item("unknown", 0, payload=F.concat(F.lit('<own k="'), key, F.lit('">y</own>'))), item("text", 0, text=" tail"),
    ).cast(SEGMENT)
    variant = build.variant(F.col("lang"), segment, notes=F.array(note), props=F.array(prop), extra=extra, extra_nodes=node("odd"), **shared)
    unit = build.unit(translation_unit_id=key, source_language=F.col("lang"), segmentation_type="sentence", variants=F.array(variant), notes=F.array(note), props=F.array(prop, prop), extra=extra, extra_nodes=node("tail"), **shared)
    return d.select(F.col("source").alias("memory_id"), F.col("id").alias("unit_pos"), unit.alias("u")).select("memory_id", "unit_pos", "u.*")


def rich_memories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A memory per source, with every attribute of its header."""
    d = table(spark, sf_dir, "documents").groupBy("source").agg(F.min("doc_id").alias("id")).where("source IS NOT NULL")
    key, when = F.col("id").cast("string"), F.timestamp_seconds(F.lit(1_600_000_000) + F.col("id"))
    note = build.note(F.concat(F.lit("about "), F.col("source")), language="en")
    prop = build.prop(key, kind="least id")
    header = build.header(
        creation_tool="t & c", creation_tool_version=key, segmentation_type="block", original_translation_memory_format="f", admin_language="en", source_language="de", original_data_type="d",
        original_encoding="utf-8", created_at=when, created_by="me", last_modified_at=when, last_modified_by="you", notes=F.array(note), props=F.array(prop, prop),
        extra=F.array(F.struct(F.lit("mine").alias("k"), key.alias("v"))), extra_nodes=F.array(F.encode(F.lit("<x>1</x>"), "UTF-8")),
    )
    extra = F.array(F.struct(F.lit("own").alias("k"), F.col("source").alias("v")))
    nodes = F.array(F.encode(F.concat(F.lit("<y>"), key, F.lit("</y>")), "UTF-8"))
    return d.select(F.col("source").alias("memory_id"), F.lit("1.4").alias("version"), header.alias("header"), extra.alias("extra"), nodes.alias("extra_nodes"))


def written(spark: SparkSession, sf_dir: str, encoding: str = "UTF-8") -> DataFrame:
    """``memory_id, content``: the rich corpora as whole documents in an encoding."""
    writer = Writer()
    units = rich_units(spark, sf_dir).select("memory_id", F.struct("unit_pos", writer.unit().alias("t")).alias("u"))
    bodies = units.groupBy("memory_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list("u")), lambda u: u["t"]), "").alias("body"))
    ends = rich_memories(spark, sf_dir).select("memory_id", F.regexp_replace(writer.opening(), r"^<\?xml[^>]*>\s*", "").alias("o"), writer.closing().alias("c"))
    return ends.join(bodies, "memory_id").select("memory_id", to_bytes(F.concat("o", "body", "c"), encoding).alias("content"))

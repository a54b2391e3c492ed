"""Traversal of segments and of structure."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .items import is_inline, is_text, is_unknown, within


def walk_content(seg: Column, yield_text: bool = True, recurse: bool = False, yield_unknown: bool = False) -> Column:
    """Items in document order (a node before its content): the top level, or all with ``recurse``."""
    level = within(recurse)

    def keep(x: Column) -> Column:
        test = level(x)
        if not yield_text:
            test = test & ~is_text(x)
        if not yield_unknown:
            test = test & ~is_unknown(x)
        return test

    return F.filter(seg, keep)


def walk_content_filtered(seg: Column, predicate: Callable[[Column], Column], recurse: bool = False) -> Column:
    """Items that satisfy ``predicate``, text and unknown items included."""
    level = within(recurse)
    return F.filter(seg, lambda x: level(x) & predicate(x))


def walk_inline_nodes(seg: Column, recurse: bool = False) -> Column:
    """Inline nodes alone."""
    return walk_content_filtered(seg, is_inline, recurse)


def explode_items(df: DataFrame, seg: str = "segment", parent_columns: list[str] | None = None) -> DataFrame:
    """One row per item: the other columns, ``pos`` and the item's fields."""
    keep = parent_columns if parent_columns is not None else [c for c in df.columns if c != seg]
    return df.select(*keep, F.posexplode(seg).alias("pos", "item")).select(*keep, "pos", "item.*")


_NODE = "struct<node:string,variant_pos:int,pos:int,name:string,text:string,language:string>"


def _node(node: str, variant: Column | None, pos: Column | None, name: Column | None = None, text: Column | None = None, language: Column | None = None) -> Column:
    none = lambda c, t: F.lit(None).cast(t) if c is None else c.cast(t)
    return F.struct(F.lit(node).alias("node"), none(variant, "int").alias("variant_pos"), none(pos, "int").alias("pos"), none(name, "string").alias("name"), none(text, "string").alias("text"), none(language, "string").alias("language"))


def walk_leaves(notes: Column, props: Column, variant: Column | None = None) -> Column:
    """Notes, then props, as nodes: what walking a header or a variant gives."""
    some = lambda c: F.coalesce(c, F.array())
    return F.concat(
        F.transform(some(notes), lambda x, i: _node("note", variant, i, None, x["text"], x["language"])).cast(f"array<{_NODE}>"),
        F.transform(some(props), lambda x, i: _node("prop", variant, i, x["kind"], x["text"], x["language"])).cast(f"array<{_NODE}>"),
    )


def walk_unit(notes: Column, props: Column, variants: Column, recurse: bool = False) -> Column:
    """Notes, props and variants of a unit in that order; each variant is followed by its own leaves with ``recurse``."""

    def one(v: Column, i: Column) -> Column:
        own = F.array(_node("variant", i, i, None, None, v["language"])).cast(f"array<{_NODE}>")
        return F.concat(own, walk_leaves(v["notes"], v["props"], i)) if recurse else own

    return F.concat(walk_leaves(notes, props), F.flatten(F.transform(variants, one)))


def walk_memory(memory: DataFrame, units: DataFrame, recurse: bool = False) -> DataFrame:
    """Header, its leaves with ``recurse``, then each unit and, with ``recurse``, what it holds: ``memory_id, step, unit_pos, place`` order the rows."""
    head = F.array(_node("header", None, None)).cast(f"array<{_NODE}>")
    if recurse:
        head = F.concat(head, walk_leaves(F.col("header.notes"), F.col("header.props")))
    unit = F.array(_node("unit", None, None, F.col("translation_unit_id"))).cast(f"array<{_NODE}>")
    if recurse:
        unit = F.concat(unit, walk_unit(F.col("notes"), F.col("props"), F.col("variants"), True))
    first = memory.select("memory_id", F.lit(0).alias("step"), F.lit(None).cast("long").alias("unit_pos"), F.posexplode(head).alias("place", "n"))
    rest = units.select("memory_id", F.lit(1).alias("step"), "unit_pos", F.posexplode(unit).alias("place", "n"))
    return first.unionByName(rest).select("memory_id", "step", "unit_pos", "place", "n.*")


def walk_filtered(walked: Column, predicate: Callable[[Column], Column]) -> Column:
    """Nodes of a structural walk that satisfy ``predicate``."""
    return F.filter(walked, predicate)

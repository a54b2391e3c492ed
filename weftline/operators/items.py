"""Building blocks over segments: item constructors, predicates, parents, subtrees."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import INLINE, ITEM, SEGMENT

#: Output items that a fold gathers before it sets them aside.
CHUNK = 64
Predicate = str | Iterable[str] | Callable[[Column], Column]


def item(kind: str, depth: int | Column = 0, **values: Column | str | int) -> Column:
    """One item; ``values`` name its other fields."""
    given = {"depth": depth, "kind": kind, **values}
    fields = [f.split(":")[0] for f in ITEM.removeprefix("struct<").split(",") if ":" in f and not f.startswith("v:")]
    types = {"depth": "int", "payload": "binary", "internal_id": "bigint", "external_id": "bigint", "extra": "array<struct<k:string,v:string>>"}
    columns = []
    for f in fields:
        value = given.get(f)
        column = value if isinstance(value, Column) else F.lit(value)
        if f == "extra" and value is None:
            column = F.array()
        columns.append(column.cast(types.get(f, "string")).alias(f))
    return F.struct(*columns)


def empty() -> Column:
    """A segment without items."""
    return F.array().cast(SEGMENT)


def is_text(x: Column) -> Column:
    return x["kind"] == "text"


def is_unknown(x: Column) -> Column:
    return x["kind"] == "unknown"


def is_inline(x: Column) -> Column:
    """An inline node: neither text nor an unknown element."""
    return x["kind"].isin(*INLINE)


def matching(predicate: Predicate) -> Callable[[Column], Column]:
    """A test of inline nodes from a kind, several kinds, or a function of the item."""
    if callable(predicate):
        return lambda x: is_inline(x) & predicate(x)
    kinds = [predicate] if isinstance(predicate, str) else list(predicate)
    return lambda x: is_inline(x) & x["kind"].isin(*kinds)


def within(recurse: bool) -> Callable[[Column], Column]:
    """Every item, or those of the top level."""
    return (lambda x: F.lit(True)) if recurse else (lambda x: x["depth"] == 0)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def folded(values: Column, state: Column, step: Callable[[Column, Column], tuple[Column, Column]], emits: str, finish: Callable[[Column, Column], Column] | None = None) -> Column:
    """A fold with output: ``step`` gives, from a state and a value, the next state and an array (type ``emits``) that goes out.

    What goes out is gathered in chunks, so that an append copies a chunk at most, however long the array is.
    ``finish`` makes the result of the last state and the output; by default it is the output. Null stays null.
    """

    def one(s: Column, x: Column) -> Column:
        after, out = step(s["state"], x)
        return F.struct(after.alias("state"), F.concat(s["out"], out).alias("out"))

    def every(all_: Column) -> Column:
        firsts = F.filter(F.sequence(F.lit(0), F.greatest(F.size(all_) - 1, F.lit(0)), F.lit(CHUNK)), lambda c: c < F.size(all_))

        def chunk(s: Column, c: Column) -> Column:
            own = F.aggregate(F.slice(all_, c + 1, F.lit(CHUNK)), F.struct(s["state"].alias("state"), F.array().cast(emits).alias("out")), one)
            return let(own, lambda r: F.struct(r["state"].alias("state"), F.concat(s["out"], F.array(r["out"])).alias("out")))

        done = (lambda s: F.flatten(s["out"])) if finish is None else (lambda s: finish(s["state"], F.flatten(s["out"])))
        return F.when(all_.isNotNull(), F.aggregate(firsts, F.struct(state.alias("state"), F.array().cast(f"array<{emits}>").alias("out")), chunk, done))

    return let(values, every)


def parents(seg: Column) -> Column:
    """Index (from 0) of the node that owns each item; -1 at the top level."""
    start = F.struct(F.array().cast("array<int>").alias("open"), F.lit(0).alias("n"))

    def step(s: Column, x: Column) -> tuple[Column, Column]:
        above = F.slice(s["open"], F.lit(1), x["depth"])
        owner = F.when(x["depth"] > 0, F.element_at(s["open"], x["depth"])).otherwise(F.lit(-1))
        return F.struct(F.concat(above, F.array(s["n"])).alias("open"), (s["n"] + 1).alias("n")), F.array(owner)

    return folded(seg, start, step, "array<int>")


def content_of(seg: Column, index: Column | int) -> Column:
    """Content of the inline node at ``index`` (from 0) as a segment of its own."""
    at = F.lit(index) if isinstance(index, int) else index
    node = F.get(seg, at)
    after = F.slice(seg, at + 2, F.greatest(F.size(seg) - at - 1, F.lit(0)))
    stop = F.array_position(F.transform(after, lambda x: x["depth"] <= node["depth"]), True).cast("int")
    own = F.slice(after, F.lit(1), F.when(stop > 0, stop - 1).otherwise(F.size(after)))
    return F.transform(own, lambda x: x.withField("depth", x["depth"] - node["depth"] - 1))

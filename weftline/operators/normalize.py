"""Normal forms of segments, and distinct props and notes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .items import is_text, let, parents, within

#: White space as Python strips it: fixed values.
WHITE = "[\\t-\\r\\x1c-\\x20\\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]"


def collapse_text(seg: Column, recurse: bool = False) -> Column:
    """Merge texts that follow each other in the same content; an empty text goes only by merging."""
    level = within(recurse)

    def runs(all_: Column) -> Column:
        def begins(x: Column, i: Column) -> Column:
            before = F.get(all_, i - 1)
            return F.when((i == 0) | ~(level(x) & is_text(x) & is_text(before) & (before["depth"] == x["depth"])), i)

        def merged(firsts: Column):
            def one(i: Column, k: Column) -> Column:
                n = F.coalesce(F.get(firsts, k + 1), F.size(all_)) - i
                text = F.array_join(F.transform(F.slice(all_, i + 1, n), lambda x: x["text"]), "")
                return F.when(n > 1, F.get(all_, i).withField("text", text)).otherwise(F.get(all_, i))

            return one

        firsts = F.filter(F.transform(all_, begins), lambda i: i.isNotNull())
        return let(firsts, lambda f: F.transform(f, merged(f)))

    return let(seg, runs)


def remove_empty_text(seg: Column, recurse: bool = False) -> Column:
    """Drop empty texts of the top level; ``recurse`` changes nothing."""
    return F.filter(seg, lambda x: ~((x["depth"] == 0) & is_text(x) & (x["text"] == "")))


def strip_whitespace(seg: Column, mode: str = "both", recurse: bool = False) -> Column:
    """Strip the first text of a content on its left and the last one on its right, wherever they stand in it."""
    if mode not in ("both", "leading", "trailing"):
        raise ValueError(f"no such mode: {mode!r}")
    level = within(recurse)
    # texts by owner, every other item by itself
    owner = lambda all_: F.zip_with(all_, parents(all_), lambda x, p: F.when(is_text(x), p))
    by = lambda all_: F.array_sort(F.transform(owner(all_), lambda p, i: F.struct(F.coalesce(p, -i - 2).alias("p"), i.alias("i"))))

    def edges(keys: Column) -> Column:
        """First and last of each owner's texts, in document order."""

        def one(e: Column, k: Column) -> Column:
            first, last = (k == 0) | (F.get(keys, k - 1)["p"] != e["p"]), (k == F.size(keys) - 1) | (F.get(keys, k + 1)["p"] != e["p"])
            return F.struct(e["i"].alias("i"), first.alias("first"), last.alias("last"))

        return F.array_sort(F.transform(keys, one))

    def one(x: Column, edge: Column) -> Column:
        text = x["text"]
        if mode != "trailing":
            text = F.when(edge["first"], F.regexp_replace(text, f"^{WHITE}+", "")).otherwise(text)
        if mode != "leading":
            text = F.when(edge["last"], F.regexp_replace(text, f"{WHITE}+\\z", "")).otherwise(text)
        return F.when(level(x) & is_text(x), x.withField("text", text)).otherwise(x)

    return let(seg, lambda all_: F.zip_with(all_, let(by(all_), edges), one))


def _distinct_in(df: DataFrame, column: str, recurse: bool) -> DataFrame:
    out = df.withColumn(column, F.array_distinct(column))
    if recurse and "variants" in df.columns:
        out = out.withColumn("variants", F.transform("variants", lambda v: v.withField(column, F.array_distinct(v[column]))))
    return out


def deduplicate_props(df: DataFrame, recurse: bool = False) -> DataFrame:
    """Keep the first of equal props of each row (unit, or any row with ``props``); with ``recurse`` those of its variants too."""
    return _distinct_in(df, "props", recurse)


def deduplicate_notes(df: DataFrame, recurse: bool = False) -> DataFrame:
    """Keep the first of equal notes, likewise."""
    return _distinct_in(df, "notes", recurse)

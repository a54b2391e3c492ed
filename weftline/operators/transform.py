"""Edits of segments; each returns a new array and visits every item once."""

from __future__ import annotations

import inspect
import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import SEGMENT
from .items import Predicate, empty, folded, is_text, item, matching, within
from .regex import java_pattern, java_replacement


def remove(seg: Column, predicate: Predicate, recurse: bool = False) -> Column:
    """Drop matching inline nodes with all they hold; text and unknown items never match."""
    test, level = matching(predicate), within(recurse)

    def step(under: Column, x: Column) -> tuple[Column, Column]:
        inside = (under >= 0) & (x["depth"] > under)
        hit = level(x) & test(x)
        return F.when(inside, under).when(hit, x["depth"]).otherwise(F.lit(-1)), F.when(inside | hit, empty()).otherwise(F.array(x))

    return folded(seg, F.lit(-1), step, SEGMENT)


def unwrap(seg: Column, predicate: Predicate, recurse: bool = False) -> Column:
    """Put the content of matching inline nodes in their place, and test it again.

    Without ``recurse`` a node goes if it matches and every node around it went; with it every match goes.
    """
    test = matching(predicate)

    def step(around: Column, x: Column) -> tuple[Column, Column]:
        gone = F.filter(around, lambda d: d < x["depth"])
        hit = test(x) if recurse else test(x) & (F.size(gone) == x["depth"])
        lifted = F.array(x.withField("depth", x["depth"] - F.size(gone)))
        return F.when(hit, F.concat(gone, F.array(x["depth"]))).otherwise(gone), F.when(hit, empty()).otherwise(lifted)

    return folded(seg, F.array().cast("array<int>"), step, SEGMENT)


def promote_match(seg: Column, pattern: str | re.Pattern, factory: Callable[..., Column], recurse: bool = False) -> Column:
    """Split each text at the pattern's matches and put ``factory(match)`` between the rest.

    The factory makes an item, or an array of items whose depths count from its own place. It gets the matched text and,
    if it takes two arguments, a function that gives a group by number or name (empty where it took no part). Empty
    rests go; a text without a match stays as it is, even if empty. What the factory makes is not searched again.
    """
    p, level = java_pattern(pattern), within(recurse)
    grouped = len(inspect.signature(factory).parameters) > 1
    compiled = re.compile(pattern) if grouped else None
    count = compiled.groups if grouped else 0

    def made(m: Column, depth: Column) -> Column:
        group = lambda g: m[f"g{compiled.groupindex[g] if isinstance(g, str) else g}"]
        out = factory(m["g0"], group) if grouped else factory(m["g0"])
        return F.transform(out, lambda y: y.withField("depth", y["depth"] + depth)).cast(SEGMENT)

    def matches(text: Column) -> Column:
        each = [F.regexp_extract_all(text, F.lit(p), F.lit(g)).alias(f"g{g}") for g in range(count + 1)]
        return F.arrays_zip(*each) if count else F.transform(each[0], lambda m: F.struct(m.alias("g0")))

    def split(x: Column) -> Column:
        rests = F.transform(F.split(x["text"], p, -1), lambda t: F.when(t != "", F.array(x.withField("text", t))).otherwise(empty()))
        new = F.transform(matches(x["text"]), lambda m: made(m, x["depth"]))
        return F.flatten(F.zip_with(rests, new, lambda r, n: F.concat(r, F.coalesce(n, empty()))))

    return F.flatten(F.transform(seg, lambda x: F.when(level(x) & is_text(x) & x["text"].rlike(p), split(x)).otherwise(F.array(x))))


def node_with_text(kind: str, text: Column, **values: Column | str | int) -> Column:
    """A factory's result: an inline node that holds one text."""
    return F.array(item(kind, 0, **values), item("text", 1, text=text))


def replace_text(seg: Column, pattern: str | re.Pattern, replacement: str, recurse: bool = False) -> Column:
    """Replace every match in every text; the replacement may refer to groups."""
    p, r, level = java_pattern(pattern), java_replacement(replacement), within(recurse)
    return F.transform(seg, lambda x: F.when(level(x) & is_text(x), x.withField("text", F.regexp_replace(x["text"], p, r))).otherwise(x))


def replace_text_with(seg: Column, pattern: str | re.Pattern, replacement: Callable[[re.Match], str] | str, recurse: bool = False) -> Column:
    """The same for a function of the match, or a pattern that only Python reads: texts alone cross to Python, in Arrow batches."""
    compiled = re.compile(pattern)

    @F.pandas_udf("array<string>")
    def changed(texts: pd.Series) -> pd.Series:
        return texts.map(lambda own: None if own is None else [None if t is None else compiled.sub(replacement, t) for t in own])

    level = within(recurse)
    new = changed(F.transform(seg, lambda x: F.when(level(x) & is_text(x), x["text"])))
    return F.zip_with(seg, new, lambda x, t: F.when(level(x) & is_text(x), x.withField("text", t)).otherwise(x))

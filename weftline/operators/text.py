"""Text of segments: fragments, search and joining."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .items import is_text, is_unknown, parents, within
from .regex import java_pattern

Formatter = Callable[[Column], Column]


def _fragment(x: Column, formatter: Formatter | None) -> Column:
    return x["text"] if formatter is None else F.when(is_unknown(x), formatter(x["payload"])).otherwise(x["text"])


def _counts(formatter: Formatter | None) -> Callable[[Column], Column]:
    return is_text if formatter is None else lambda x: is_text(x) | is_unknown(x)


def fragments(seg: Column, recurse: bool = False, formatter: Formatter | None = None) -> Column:
    """Texts in document order; an unknown item gives ``formatter(payload)`` where a formatter is given."""
    level, counts = within(recurse), _counts(formatter)
    return F.transform(F.filter(seg, lambda x: level(x) & counts(x)), lambda x: _fragment(x, formatter))


def fragments_with_source(seg: Column, recurse: bool = False, formatter: Formatter | None = None) -> Column:
    """``struct<text, source>``: a fragment and the index of the node that owns it (-1: the segment), or of the unknown item itself."""
    level, counts = within(recurse), _counts(formatter)
    both = F.zip_with(F.zip_with(seg, parents(seg), lambda x, p: F.struct(x.alias("x"), p.alias("p"))), F.sequence(F.lit(0), F.size(seg)), lambda a, i: F.struct(a["x"].alias("x"), a["p"].alias("p"), i.alias("i")))
    kept = F.filter(both, lambda a: a["x"].isNotNull() & level(a["x"]) & counts(a["x"]))
    return F.transform(kept, lambda a: F.struct(_fragment(a["x"], formatter).alias("text"), F.when(is_unknown(a["x"]), a["i"]).otherwise(a["p"]).alias("source")))


def is_empty(seg: Column, recurse: bool = False) -> Column:
    """Whether there is no fragment; an empty text counts as one, unknown items do not."""
    level = within(recurse)
    return ~F.exists(seg, lambda x: level(x) & is_text(x))


def find_all(seg: Column, target: str | re.Pattern, recurse: bool = False, formatter: Formatter | None = None) -> Column:
    """Fragments, whole, that contain a match of the pattern, in order."""
    pattern = java_pattern(target)
    return F.filter(fragments(seg, recurse, formatter), lambda t: t.rlike(pattern))


#: The lazy form is the same array; ``explode`` it for rows.
find_iter = find_all


def find(seg: Column, target: str | re.Pattern, recurse: bool = False, formatter: Formatter | None = None) -> Column:
    """The first of ``find_all``, or null."""
    return F.get(find_all(seg, target, recurse, formatter), F.lit(0))


def join(seg: Column, separator: str = "", recurse: bool = False, formatter: Formatter | None = None) -> Column:
    """The fragments in one text; empty without any."""
    return F.array_join(fragments(seg, recurse, formatter), separator)

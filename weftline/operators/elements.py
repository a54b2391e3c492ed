"""Single elements of a segment: names, attributes, text and children."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.names import Catalog
from ..schema import NAMES, SEGMENT
from .items import content_of, is_text, item


def create_element(kind: str, depth: int = 0, extra: dict[str, str] | None = None, **values: Column | str | int) -> Column:
    """An inline node with attributes; ``extra`` holds those that the model does not know."""
    pairs = F.array(*(F.struct(F.lit(k).alias("k"), F.lit(v).alias("v")) for k, v in sorted((extra or {}).items()))) if extra else None
    return item(kind, depth, extra=pairs, **values)


def get_tag(x: Column, notation: str = "local", catalog: Catalog | None = None) -> Column:
    """An item's tag; an unknown element's is read from its bytes, in ``local``, ``prefixed`` (as written) or ``qualified`` form."""
    written = F.regexp_extract(F.decode(x["payload"], "UTF-8"), r"^\s*<([^\s/>]+)", 1)
    if notation == "local":
        shown = F.substring_index(written, ":", -1)
    elif notation == "prefixed":
        shown = written
    elif notation == "qualified":
        shown = (catalog or Catalog()).resolved(written)["clark"]
    else:
        raise ValueError(f"no such notation: {notation!r}")
    return F.when(x["kind"] == "unknown", shown).when(~is_text(x), x["kind"])


def _known(name: str) -> set[str]:
    return {NAMES[k].get(name) for k in ("bpt", "ept", "it", "ph", "hi", "sub")} - {None}


def get_attribute(x: Column, name: str, default: str | None = None) -> Column:
    """An attribute by its markup name; ``default`` where it is missing."""
    extra = F.get(F.filter(x["extra"], lambda e: e["k"] == name), F.lit(0))["v"]
    return F.coalesce(*(x[c].cast("string") for c in sorted(_known(name))), extra, F.lit(default))


def set_attribute(x: Column, name: str, value: Column | str) -> Column:
    """The item with an attribute set; the unknown ones stay sorted by name."""
    new = value if isinstance(value, Column) else F.lit(value)
    for column in sorted(_known(name)):
        return x.withField(column, new.cast("bigint") if column.endswith("_id") else new.cast("string"))
    rest = F.filter(x["extra"], lambda e: e["k"] != name)
    return x.withField("extra", F.array_sort(F.concat(rest, F.array(F.struct(F.lit(name).alias("k"), new.cast("string").alias("v"))))))


def delete_attribute(x: Column, name: str) -> Column:
    """The item without an attribute; no error if it has none."""
    for column in sorted(_known(name)):
        return x.withField(column, F.lit(None).cast("bigint" if column.endswith("_id") else "string"))
    return x.withField("extra", F.filter(x["extra"], lambda e: e["k"] != name))


def attribute_map(x: Column, notation: str | None = None, catalog: Catalog | None = None) -> Column:
    """All attributes by markup name; those that are missing are left out. Names are as written, or in a ``notation``."""
    pairs = {}
    for kind in ("sub", "hi", "ph", "it", "ept", "bpt"):
        pairs.update({name: column for name, column in NAMES[kind].items()})
    known = F.array(*(F.struct(F.lit(name).alias("k"), x[column].cast("string").alias("v")) for name, column in sorted(pairs.items())))
    pairs_ = F.filter(F.concat(known, x["extra"]), lambda e: e["v"].isNotNull())
    if notation:
        pairs_ = F.transform(pairs_, lambda e: F.struct((catalog or Catalog()).shown(e["k"], notation).alias("k"), e["v"].alias("v")))
    return F.map_from_entries(pairs_)


def append_child(seg: Column, child: Column) -> Column:
    """The segment with an item, or an array of items, at its end."""
    return F.concat(seg, child.cast(SEGMENT))


def iter_children(seg: Column, index: int | None = None, kinds: Iterable[str] | str | None = None) -> Column:
    """Direct children of the segment or of the node at ``index``, of some kinds only."""
    own = seg if index is None else content_of(seg, index)
    wanted = [kinds] if isinstance(kinds, str) else list(kinds) if kinds is not None else None
    return F.filter(own, lambda x: (x["depth"] == 0) & ((x["kind"].isin(*wanted) if wanted else F.lit(False)) if wanted is not None else F.lit(True)))


def get_text(seg: Column, index: int) -> Column:
    """Text at the beginning of the node at ``index``; null if it begins otherwise."""
    after = F.get(seg, F.lit(index + 1))
    return F.when(is_text(after) & (after["depth"] == F.get(seg, F.lit(index))["depth"] + 1), after["text"])


def get_tail(seg: Column, index: int) -> Column:
    """Text right after the node at ``index``; null if something else follows."""
    after = F.get(seg, F.lit(index + 1) + F.size(content_of(seg, index)))
    return F.when(is_text(after) & (after["depth"] == F.get(seg, F.lit(index))["depth"]), after["text"])


def set_text(seg: Column, index: int, text: Column | str | None) -> Column:
    """The segment with the text at the beginning of the node at ``index`` replaced; null takes it away."""
    has = get_text(seg, index).isNotNull()
    return _replaced(seg, F.lit(index + 1), has, F.get(seg, F.lit(index))["depth"] + 1, text)


def set_tail(seg: Column, index: int, text: Column | str | None) -> Column:
    """The segment with the text right after the node at ``index`` replaced; null takes it away."""
    has = get_tail(seg, index).isNotNull()
    return _replaced(seg, F.lit(index + 1) + F.size(content_of(seg, index)), has, F.get(seg, F.lit(index))["depth"], text)


def _replaced(seg: Column, at: Column, has: Column, depth: Column, text: Column | str | None) -> Column:
    value = (text if isinstance(text, Column) else F.lit(text)).cast("string")
    own = F.when(value.isNotNull(), F.array(item("text", depth, text=value))).otherwise(F.array()).cast(SEGMENT)
    after = F.slice(seg, at + F.when(has, 2).otherwise(1), F.greatest(F.size(seg), F.lit(1)))
    return F.concat(F.slice(seg, F.lit(1), at), own, after)


def clear(seg: Column, index: int) -> Column:
    """The segment with the node at ``index`` emptied."""
    n = F.size(content_of(seg, index))
    return F.concat(F.slice(seg, 1, index + 1), F.slice(seg, F.lit(index + 2) + n, F.size(seg)))

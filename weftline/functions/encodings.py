"""Character encodings and paths."""

from __future__ import annotations

import codecs
from encodings import normalize_encoding as _plain
from pathlib import Path

from pyspark.sql import Column
from pyspark.sql import functions as F


def canonical_encoding(name: str | None) -> str:
    """Canonical name of an encoding; none and ``unicode`` mean UTF-8."""
    if name is None or name == "unicode":
        return "utf-8"
    try:
        return codecs.lookup(_plain(name).lower()).name
    except LookupError as error:
        raise ValueError(f"no such encoding: {name!r}") from error


def canonical(value: Column) -> Column:
    """The same for a column; null where there is no such encoding."""
    from encodings.aliases import aliases

    pairs = {}
    for alias in sorted({*aliases, *aliases.values()}):
        try:
            pairs[alias] = codecs.lookup(alias).name
        except LookupError:
            continue
    table = F.create_map(*(F.lit(x) for pair in pairs.items() for x in pair))
    key = F.lower(F.regexp_replace(value, "[^A-Za-z0-9.]+", "_"))
    return F.when(value.isNull() | (value == "unicode"), "utf-8").otherwise(F.element_at(table, key))


def usable_path(path: str, mkdir: bool = True) -> str:
    """An address as it is; a local path absolute, its folder made on demand."""
    if "://" in path:
        return path
    found = Path(path).expanduser().resolve()
    if mkdir:
        found.parent.mkdir(parents=True, exist_ok=True)
    return str(found)

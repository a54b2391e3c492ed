"""Qualified names: a namespace catalog, resolution, notations and name checks."""

from __future__ import annotations

import io
import unicodedata
import xml.etree.ElementTree as ET
from collections.abc import Mapping
from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import errors
from .uris import check_uri

XML_PREFIX, XML_URI = "xml", "http://www.w3.org/XML/1998/namespace"
#: General categories that a name may begin with, and those that may follow as well: fixed values of the XML standard.
FIRST, REST = "Lu Ll Lt Lm Lo Nl".split(), "Nd Mc Mn Pc".split()
_FIRST_CLASS = "_‌‍" + "".join(rf"\p{{{c}}}" for c in FIRST)
NCNAME = f"^[{_FIRST_CLASS}][{_FIRST_CLASS}·.\\-" + "".join(rf"\p{{{c}}}" for c in REST) + "]*$"


class Name(NamedTuple):
    prefix: str | None
    uri: str | None
    local: str
    clark: str


def is_ncname(name: Column) -> Column:
    """Whether a value is a name without colon."""
    return name.rlike(NCNAME)


def check_ncname(name: str) -> None:
    """Raise ``ValueError`` unless ``name`` is a name without colon."""
    kinds = [unicodedata.category(c) for c in name]
    first = [c in "_‌‍" or k in FIRST for c, k in zip(name, kinds)]
    if not name or not first[0] or not all(f or k in REST or c in "·.-" for c, k, f in zip(name, kinds, first)):
        raise ValueError(f"not a name without colon: {name!r}")


class Catalog:
    """Prefixes and addresses; ``xml`` is built in."""

    def __init__(self, prefixes: Mapping[str, str] | None = None):
        self.prefixes: dict[str, str] = {}
        for prefix, uri in (prefixes or {}).items():
            self.register(prefix, uri)

    def register(self, prefix: str, uri: str) -> None:
        """Add a prefix (empty for the default namespace)."""
        if prefix == XML_PREFIX:
            raise errors.RestrictedPrefixError(prefix)
        if uri == XML_URI:
            raise errors.RestrictedURIError(uri)
        if prefix in self.prefixes:
            raise errors.ExistingNamespaceError(prefix)
        if prefix:
            try:
                check_ncname(prefix)
            except ValueError as error:
                raise errors.InvalidNCNameError(prefix) from error
        check_uri(uri)
        self.prefixes[prefix] = uri

    def drop_prefix(self, prefix: str) -> None:
        """Remove one prefix; that of XML itself stays."""
        if prefix == XML_PREFIX:
            raise errors.RestrictedPrefixError(prefix)
        if prefix not in self.prefixes:
            raise errors.UnregisteredPrefixError(prefix)
        del self.prefixes[prefix]

    def drop_uri(self, uri: str) -> None:
        """Remove every prefix of an address; that of XML itself stays."""
        if uri == XML_URI:
            raise errors.RestrictedURIError(uri)
        found = [p for p, u in self.prefixes.items() if u == uri]
        if not found:
            raise errors.UnregisteredURIError(uri)
        for prefix in found:
            del self.prefixes[prefix]

    def gather(self, markup: bytes) -> None:
        """Add the prefixes that a document declares and that are not there yet."""
        for _, (prefix, uri) in ET.iterparse(io.BytesIO(markup), events=("start-ns",)):
            if prefix != XML_PREFIX and prefix not in self.prefixes:
                self.register(prefix, uri)

    def _maps(self, own: Mapping[str, str] | None) -> list[Mapping[str, str]]:
        return [m for m in (own, self.prefixes) if m is not None]

    def resolve(self, name: str, own: Mapping[str, str] | None = None) -> Name:
        """Parts of ``{uri}local``, ``prefix:local``, ``:local`` or ``local``; ``own`` prefixes come before the catalog's. Bare names have no namespace."""
        if name.startswith("{"):
            uri, closed, local = name[1:].partition("}")
            if not closed or not local:
                raise ValueError(f"malformed name: {name!r}")
            prefix = next((p for m in self._maps(own) for p, u in m.items() if u == uri), None)
            return Name(prefix, uri, local, name)
        parts = name.split(":")
        if len(parts) > 2:
            raise errors.MultiplePrefixesError(name)
        if not parts[-1]:
            raise ValueError(f"malformed name: {name!r}")
        if len(parts) == 1:
            return Name(None, None, name, name)
        prefix, local = parts
        uri = XML_URI if prefix == XML_PREFIX else next((m[prefix] for m in self._maps(own) if prefix in m), None)
        if uri is None:
            raise errors.UnregisteredPrefixError(prefix)
        return Name(prefix, uri, local, f"{{{uri}}}{local}")

    def formatted(self, name: Name | str, notation: str, own: Mapping[str, str] | None = None) -> str:
        """``qualified``, ``local`` or ``prefixed`` form; bare names stay bare."""
        found = self.resolve(name, own) if isinstance(name, str) else name
        if found.uri is None or notation == "local":
            return found.local
        if notation == "qualified":
            return found.clark
        if notation != "prefixed":
            raise ValueError(f"no such notation: {notation!r}")
        for prefixes in self._maps(own):
            fitting = [p for p, u in prefixes.items() if u == found.uri]
            if len(fitting) > 1:
                raise errors.MultiplePrefixesError(found.clark)
            if fitting:
                return f"{fitting[0]}:{found.local}"
        raise errors.UnregisteredURIError(found.uri)

    def shown(self, name: Column, notation: str) -> Column:
        """A column of names in ``qualified``, ``local`` or ``prefixed`` notation; null where there is no such form, or more than one prefix for it."""
        found = self.resolved(name)
        if notation == "local":
            return found["local"]
        if notation == "qualified":
            return found["clark"]
        if notation != "prefixed":
            raise ValueError(f"no such notation: {notation!r}")
        by: dict[str, list[str]] = {}
        for p, u in {**self.prefixes, XML_PREFIX: XML_URI}.items():
            by.setdefault(u, []).append(p)
        one = F.create_map(*(F.lit(x) for u, p in by.items() if len(p) == 1 for x in (u, p[0])))
        return F.when(found["uri"].isNull(), found["local"]).otherwise(F.concat(F.element_at(one, found["uri"]), F.lit(":"), found["local"]))

    def resolved(self, name: Column) -> Column:
        """``struct<prefix, uri, local, clark>`` of a column of names; null for malformed names and unknown prefixes."""
        known = {XML_PREFIX: XML_URI, **self.prefixes}
        uris = F.create_map(*(F.lit(x) for pair in known.items() for x in pair))
        back: dict[str, str] = {}
        for p, u in self.prefixes.items():
            back.setdefault(u, p)
        prefixes = F.create_map(*(F.lit(x) for pair in back.items() for x in pair)) if back else F.lit(None).cast("map<string,string>")
        clark, bare = name.rlike(r"^\{[^}]*\}.+$"), name.rlike(r"^[^:{][^:]*$")
        colon = name.rlike(r"^[^:{][^:]*:[^:]+$|^:[^:]+$")
        uri = F.when(clark, F.regexp_extract(name, r"^\{([^}]*)\}", 1)).when(colon, F.element_at(uris, F.substring_index(name, ":", 1)))
        local = F.when(clark, F.regexp_replace(name, r"^\{[^}]*\}", "")).when(bare, name).otherwise(F.substring_index(name, ":", -1))
        prefix = F.when(clark, F.element_at(prefixes, uri)).when(colon, F.substring_index(name, ":", 1))
        form = F.when(bare, name).otherwise(F.concat(F.lit("{"), uri, F.lit("}"), local))
        return F.when(bare | clark | (colon & uri.isNotNull()), F.struct(prefix.alias("prefix"), uri.alias("uri"), local.alias("local"), form.alias("clark")))

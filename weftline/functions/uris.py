"""Syntax of absolute addresses (RFC 3986) as one regular expression per part.

The parts compose to one expression that both Spark and Python evaluate, so a
column is checked without leaving the JVM. A path never begins with two slashes,
with or without an authority.
"""

from __future__ import annotations

import re

from pyspark.sql import Column

_PLAIN = r"A-Za-z0-9\-._~!$&'()*+,;="  # unreserved and sub-delims
_HEX = "%[0-9A-Fa-f]{2}"
SCHEME = r"[A-Za-z][A-Za-z0-9+\-.]*"
USERINFO = f"(?:[{_PLAIN}:]|{_HEX})*"
HOST = f"(?:[{_PLAIN}]|{_HEX})*"
PORT = "[0-9]*"
_PCHAR = f"(?:[{_PLAIN}:@]|{_HEX})"
PATH = f"(?:{_PCHAR}+(?:/{_PCHAR}*)*|/(?:{_PCHAR}+(?:/{_PCHAR}*)*)?)?"
TAIL = f"(?:[{_PLAIN}:@/?]|{_HEX})*"
_V4 = r"(?:(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"


def _v6() -> str:
    group, last = "[0-9A-Fa-f]{1,4}", f"(?:[0-9A-Fa-f]{{1,4}}:[0-9A-Fa-f]{{1,4}}|{_V4})"
    forms = [f"(?:{group}:){{6}}{last}", f"::(?:{group}:){{5}}{last}"]
    for before in range(5):  # groups before the gap, at most; the two last may be an IPv4 address
        head = f"(?:(?:{group}:){{0,{before}}}{group})?"
        forms.append(f"{head}::(?:{group}:){{{4 - before}}}{last}")
    forms += [f"(?:(?:{group}:){{0,5}}{group})?::{group}", f"(?:(?:{group}:){{0,6}}{group})?::"]
    # a gap stands for one group at least
    forms += [f"(?:{group}:){{1,{n}}}(?::{group}){{1,{7 - n}}}" for n in range(1, 7)]
    return "(?:" + "|".join(forms) + ")"


IP_LITERAL = rf"\[(?:{_v6()}(?:%[^%\]]+)?|[vV][0-9A-Fa-f]+\.[{_PLAIN}:]+)\]"
AUTHORITY = f"(?:{USERINFO}@)?(?:{IP_LITERAL}|{HOST})(?::{PORT})?"
URI = rf"^{SCHEME}:(?://{AUTHORITY}(?:/(?:{_PCHAR}+(?:/{_PCHAR}*)*)?)?|{PATH})(?:\?{TAIL})?(?:#{TAIL})?$"


def is_uri(value: Column) -> Column:
    """Whether a value is an absolute address."""
    return value.rlike(URI)


def check_uri(uri: str) -> None:
    """Raise ``ValueError`` unless ``uri`` is an absolute address."""
    if not re.fullmatch(URI[1:-1], uri):
        raise ValueError(f"not an absolute address: {uri!r}")

"""Patterns written for Python, in the syntax of the JVM."""

from __future__ import annotations

import re


def _name(name: str) -> str:
    """A group's name in letters and digits alone."""
    return name if name.isascii() and name.isalnum() and not name.startswith("gx") else "gx" + name.encode().hex()


def java_pattern(pattern: str | re.Pattern) -> str:
    """The pattern with named groups and references rewritten and its flags in front.

    As in Python, classes and letter case are those of Unicode unless ``re.ASCII`` says otherwise, only a line feed
    ends a line, and ``\\Z`` is the very end.
    """
    text, flags = (pattern, 0) if isinstance(pattern, str) else (pattern.pattern, pattern.flags)
    inner = re.match(r"\(\?([aimsux]+)\)", text)
    if inner:  # flags of the whole pattern
        text = text[inner.end() :]
        flags |= sum(f for c, f in (("a", re.A), ("i", re.I), ("m", re.M), ("s", re.S), ("x", re.X)) if c in inner[1])
    text = re.sub(r"\(\?P<(\w+)>", lambda m: f"(?<{_name(m[1])}>", text)
    text = re.sub(r"\(\?P=(\w+)\)", lambda m: f"\\\\k<{_name(m[1])}>".replace("\\\\", "\\"), text)
    text = re.sub(r"(?<!\\)((?:\\\\)*)\\Z", r"\1\\z", text)
    letters = "".join(c for c, f in (("i", re.I), ("m", re.M), ("s", re.S), ("x", re.X)) if flags & f)
    if re.search(r"[.$^]", text):
        letters += "d"
    if not flags & re.A and (flags & re.I or re.search(r"\\[wWdDsSbB]", text)):
        letters += "U"
    return f"(?{letters}){text}" if letters else text


def java_replacement(replacement: str) -> str:
    """The replacement with ``\\1`` and ``\\g<name>`` as ``$1`` and ``${name}``; dollars and other escapes are literal."""
    out = replacement.replace("$", r"\$")
    out = re.sub(r"\\g<([0-9]+)>|\\([1-9][0-9]?)", lambda m: "$" + (m[1] or m[2]), out)
    return re.sub(r"\\g<(\w+)>", lambda m: f"${{{_name(m[1])}}}", out)

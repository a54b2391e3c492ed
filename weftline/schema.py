"""Tables of the data model.

A unit is one row. Its variants hold their segments as pre-order arrays of items
with depth, which determines the tree: ``text`` and ``unknown`` items are leaves,
every other kind owns the deeper items that follow it. Attributes that the model
does not know are arrays of key and value, sorted by key, so that they compare
and deduplicate; elements that it does not know are kept as serialised bytes.
"""

from __future__ import annotations

_EXTRA = "extra:array<struct<k:string,v:string>>"
_NODES = "extra_nodes:array<binary>"

#: Kinds of inline nodes; a segment also holds ``text`` and ``unknown`` items.
INLINE = ("bpt", "ept", "it", "ph", "hi", "sub")
#: Kinds whose content may hold other inline nodes than ``sub``.
OPEN = ("hi", "sub")

ITEM = f"struct<depth:int,kind:string,text:string,payload:binary,internal_id:bigint,external_id:bigint,type:string,position:string,association:string,data_type:string,{_EXTRA}>"
SEGMENT = f"array<{ITEM}>"
NOTE = f"struct<text:string,language:string,original_encoding:string,{_EXTRA},{_NODES}>"
PROP = f"struct<text:string,kind:string,language:string,original_encoding:string,{_EXTRA},{_NODES}>"

_SHARED = (
    "original_encoding:string,original_data_type:string,usage_count:bigint,last_used_at:timestamp,creation_tool:string,"
    "creation_tool_version:string,created_at:timestamp,created_by:string,last_modified_at:timestamp,last_modified_by:string,original_tm_format:string"
)
_LEAVES = f"notes:array<{NOTE}>,props:array<{PROP}>,{_EXTRA},{_NODES}"
VARIANT = f"struct<language:string,{_SHARED},segment:{SEGMENT},{_LEAVES}>"
UNIT = f"struct<translation_unit_id:string,{_SHARED},source_language:string,segmentation_type:string,variants:array<{VARIANT}>,{_LEAVES}>"
HEADER = (
    "struct<creation_tool:string,creation_tool_version:string,segmentation_type:string,original_translation_memory_format:string,"
    "admin_language:string,source_language:string,original_data_type:string,original_encoding:string,created_at:timestamp,created_by:string,"
    f"last_modified_at:timestamp,last_modified_by:string,{_LEAVES}>"
)
MEMORY = f"struct<memory_id:string,version:string,header:{HEADER},{_EXTRA},{_NODES}>"


def ddl(struct: str) -> str:
    """A struct type as a table schema: a space in place of the colon after each of its own fields."""
    out, depth, field = [], 0, True
    for c in struct.removeprefix("struct<").removesuffix(">"):
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            field = True
        elif c == ":" and field:
            c, field = " ", False
        out.append(c)
    return "".join(out)


#: Markup attribute -> column, by element.
NAMES = {
    "header": {
        "creationtool": "creation_tool", "creationtoolversion": "creation_tool_version", "segtype": "segmentation_type", "o-tmf": "original_translation_memory_format",
        "adminlang": "admin_language", "srclang": "source_language", "datatype": "original_data_type", "o-encoding": "original_encoding",
        "creationdate": "created_at", "creationid": "created_by", "changedate": "last_modified_at", "changeid": "last_modified_by",
    },
    "tuv": {
        "xml:lang": "language", "o-encoding": "original_encoding", "datatype": "original_data_type", "usagecount": "usage_count", "lastusagedate": "last_used_at",
        "creationtool": "creation_tool", "creationtoolversion": "creation_tool_version", "creationdate": "created_at", "creationid": "created_by",
        "changedate": "last_modified_at", "changeid": "last_modified_by", "o-tmf": "original_tm_format",
    },
    "note": {"xml:lang": "language", "o-encoding": "original_encoding"},
    "prop": {"type": "kind", "xml:lang": "language", "o-encoding": "original_encoding"},
    "bpt": {"i": "internal_id", "x": "external_id", "type": "type"},
    "ept": {"i": "internal_id"},
    "it": {"pos": "position", "x": "external_id", "type": "type"},
    "ph": {"assoc": "association", "x": "external_id", "type": "type"},
    "hi": {"x": "external_id", "type": "type"},
    "sub": {"datatype": "data_type", "type": "type"},
}
NAMES["tu"] = {"tuid": "translation_unit_id", **{k: v for k, v in NAMES["tuv"].items() if k != "xml:lang"}, "srclang": "source_language", "segtype": "segmentation_type"}
REQUIRED = {
    "header": ("creationtool", "creationtoolversion", "segtype", "o-tmf", "adminlang", "srclang", "datatype"),
    "tuv": ("xml:lang",), "prop": ("type",), "bpt": ("i",), "ept": ("i",), "it": ("pos",), "tmx": ("version",),
}
#: Columns with values of their own kind.
ENUMS = {"segmentation_type": ("block", "paragraph", "sentence", "phrase"), "position": ("begin", "end"), "association": ("p", "f", "b")}
INTEGERS = ("usage_count", "internal_id", "external_id")
TIMES = ("created_at", "last_modified_at", "last_used_at")

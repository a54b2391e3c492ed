"""Documents from columns, elements of several tags, odd paths, namespaces, and long contents."""

import re

import pytest
from pyspark.sql import functions as F

from weftline import errors
from weftline.functions import markup, names
from weftline.operators import elements, items, normalize, text, transform
from weftline.schema import SEGMENT
from weftline.sources import tmx

HEAD = '<header creationtool="t" creationtoolversion="1" segtype="sentence" o-tmf="x" adminlang="en" srclang="fr" datatype="plaintext"/>'
UNIT = '<tu tuid="{}"><tuv xml:lang="en"><seg>a <hi>b<ph/></hi></seg></tuv></tu>'


def document(body: str, after: str = "", encoding: str = "UTF-8") -> bytes:
    return f'<?xml version="1.0" encoding="{encoding}"?><tmx version="1.4">{HEAD}<body>{body}</body>{after}</tmx>'.encode(encoding)


def test_documents_from_columns(spark):
    good, bad = document(UNIT.format("u"), "<x>1</x>", "UTF-16"), document("", "<body/>")
    df = spark.createDataFrame([("a", good), ("b", bad), ("c", None)], "id string, raw binary")
    got = tmx.parse_documents(df, "raw", "id", "PERMISSIVE")
    assert [(r.memory_id, [bytes(n) for n in r.extra_nodes]) for r in got.memories.collect()] == [("a", [b"<x>1</x>"])]
    assert {(r.memory_id, r.translation_unit_id, r._error) for r in got.units.collect()} == {("a", "u", None), ("b", None, "repeated_child")}
    with pytest.raises(Exception, match="repeated_child|body"):
        tmx.parse_documents(df, "raw", "id").units.collect()
    words = df.where("id = 'a'").select("id", F.lit(document(UNIT.format("v")).decode()).alias("t"))
    assert tmx.parse_documents(words, "t", "id").units.first().translation_unit_id == "v"


@pytest.mark.parametrize("n", [1, 4000])
def test_a_second_body_raises_at_every_size(spark, tmp_path, n):
    (tmp_path / "a.tmx").write_bytes(document("".join(UNIT.format(k) for k in range(n)), "<body/>"))
    with pytest.raises(Exception, match="repeated_child|body"):
        got = tmx.read_tmx(spark, str(tmp_path))
        got.memories.collect(), got.units.collect()


@pytest.mark.parametrize("n", [1, 4000])
def test_what_follows_the_body_is_kept_at_every_size_and_path(spark, tmp_path, n):
    folder = tmp_path / "a folder % with signs"
    folder.mkdir()
    (folder / "a b.tmx").write_bytes(document("".join(UNIT.format(k) for k in range(n)), '<x k="v">1</x>'))
    (folder / "odd é.tmx").write_bytes(document("<!-- </tu> -->" + UNIT.format("o"), "<y/>"))
    got = tmx.read_tmx(spark, str(folder))
    nodes = {r.memory_id: [bytes(x) for x in r.extra_nodes] for r in got.memories.collect()}
    assert sorted(map(str, nodes.values())) == sorted(map(str, [[b'<x k="v">1</x>'], [b"<y />"]]))
    assert got.units.count() == n + 1 and {r.memory_id for r in got.units.select("memory_id").distinct().collect()} == set(nodes)


def test_elements_of_several_tags_that_nest(spark, tmp_path):
    (tmp_path / "a.xml").write_text("<r><a>1<b>2</b></a><c/><a><a>3</a></a>x</r>")
    got = [r.element for r in tmx.read_elements(spark, str(tmp_path / "a.xml"), ("a", "b")).collect()]
    assert got == ["<b>2</b>", "<a>1<b>2</b></a>", "<a>3</a>", "<a><a>3</a></a>"]
    assert [r.element for r in tmx.read_elements(spark, str(tmp_path / "a.xml"), "c", nested=True).collect()] == ["<c />"]


def test_data_source_reads_folders_and_addresses(spark, tmp_path):
    from weftline.sources.datasource import register

    register(spark)
    for k in range(3):
        (tmp_path / f"{k}.tmx").write_bytes(document(UNIT.format(k)))
    (tmp_path / "_skipped").write_text("no")
    for path in (str(tmp_path), f"file://{tmp_path}"):
        assert sorted(r.translation_unit_id for r in spark.read.format("tmx").load(path).collect()) == ["0", "1", "2"]
    (tmp_path / "bad.tmx").write_bytes(document("", "<body/>"))
    assert spark.read.format("tmx").option("mode", "PERMISSIVE").load(str(tmp_path)).where("_error = 'repeated_child'").count() == 1


def test_names_of_xml_itself_stay():
    catalog = names.Catalog({"a": "urn:a"})
    with pytest.raises(errors.RestrictedPrefixError):
        catalog.drop_prefix("xml")
    with pytest.raises(errors.RestrictedURIError):
        catalog.drop_uri(names.XML_URI)
    catalog.gather(b'<r xmlns="urn:d" xmlns:b="urn:b"><s xmlns:a="urn:other"/></r>')
    assert catalog.prefixes == {"a": "urn:a", "": "urn:d", "b": "urn:b"}


def test_self_closing_markup(spark):
    given = '<a><b k="1>"></b><c> </c><d></d></a>'.replace(">\"", '&gt;"')
    row = spark.createDataFrame([(given,)], "t string").select(markup.to_string(F.col("t"), True).alias("s"), markup.to_bytes(F.col("t"), "UTF-16", True).alias("b")).first()
    assert row.s == given.replace("></b>", "/>").replace("></d>", "/>")
    assert bytes(row.b).decode("utf-16").endswith(row.s)


def brute(seg):
    """Items of a long content with texts that meet, as depth, kind and text."""
    return [(x["depth"], x["kind"], x["text"]) for x in seg]


def test_long_contents(spark):
    n = 20_000
    rows = [(k % 3 and k % 2, "hi" if k % 7 == 0 and not (k % 3 and k % 2) else "text", f" {k} ") for k in range(n)]
    for k in range(n):  # a depth only below a node
        if rows[k][0] and not any(r[1] == "hi" for r in rows[max(0, k - 1) : k]) and not (k and rows[k - 1][0]):
            rows[k] = (0, rows[k][1], rows[k][2])
    df = spark.createDataFrame([([(d, kind, t if kind == "text" else None) for d, kind, t in rows],)], "s array<struct<depth:int,kind:string,text:string>>")
    s = df.select(F.transform("s", lambda x: items.item(x["kind"], x["depth"], text=x["text"])).cast(SEGMENT).alias("s"))
    c = F.col("s")
    got = s.select(
        normalize.collapse_text(c, True).alias("one"), transform.remove(c, "hi", True).alias("without"), transform.unwrap(c, "hi", True).alias("flat"), normalize.strip_whitespace(c, "both", True).alias("bare"), items.parents(c).alias("up"), markup.segment(c).alias("m")
    ).first()
    want, gone = [], -1
    merged: list = []
    for d, kind, t in rows:
        if kind == "text" and merged and merged[-1][1] == "text" and merged[-1][0] == d:
            merged[-1] = (d, kind, merged[-1][2] + t)
        else:
            merged.append((d, kind, t if kind == "text" else None))
        inside = gone >= 0 and d > gone
        gone = gone if inside else d if kind == "hi" else -1
        if gone < 0:
            want.append((d, kind, t))
    assert brute(got.one) == merged and brute(got.without) == want
    assert brute(got.flat) == [(0, kind, t) for d, kind, t in rows if kind == "text"]
    last, parents = -1, []
    for k, (d, kind, _) in enumerate(rows):
        parents.append(last if d else -1)
        if kind == "hi":
            last = k
    assert got.up == parents
    owners = [p if rows[k][1] == "text" else None for k, p in enumerate(parents)]
    first, end = {p: k for k, p in reversed(list(enumerate(owners)))}, {p: k for k, p in enumerate(owners)}
    assert [x["text"] for x in got.bare] == [None if kind != "text" else (t.lstrip() if first[owners[k]] == k else t).rstrip() if end[owners[k]] == k else t.lstrip() if first[owners[k]] == k else t for k, (_, kind, t) in enumerate(rows)]
    assert re.sub("<[^>]*>", "", got.m) == "".join(t for _, kind, t in rows if kind == "text")


def test_texts_and_tails_are_set(spark):
    s = F.array(items.item("hi", 0), items.item("ph", 1), items.item("text", 2, text="in"), items.item("text", 0, text="after")).cast(SEGMENT)
    row = spark.range(1).select(
        elements.set_text(s, 0, "new").alias("a"), elements.set_text(s, 1, None).alias("b"), elements.set_tail(s, 0, "t").alias("c"), elements.set_tail(s, 1, "u").alias("d"), text.join(elements.set_tail(s, 0, None), "", True).alias("e")
    ).first()
    shape = lambda seg: [(x.depth, x.kind, x.text) for x in seg]
    assert shape(row.a) == [(0, "hi", None), (1, "text", "new"), (1, "ph", None), (2, "text", "in"), (0, "text", "after")]
    assert shape(row.b) == [(0, "hi", None), (1, "ph", None), (0, "text", "after")]
    assert shape(row.c)[-1] == (0, "text", "t") and shape(row.d) == [(0, "hi", None), (1, "ph", None), (2, "text", "in"), (1, "text", "u"), (0, "text", "after")]
    assert row.e == "in"

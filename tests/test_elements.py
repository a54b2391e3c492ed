"""Single elements, and runs of elements."""

import xml.etree.ElementTree as ET

import pytest
from pyspark.sql import functions as F

from weftline.functions.names import Catalog
from weftline.operators import elements, items
from weftline.schema import SEGMENT
from weftline.sources import sink, tmx


def one(spark, column, seg=None):
    df = spark.range(1)
    return (df if seg is None else df.select(seg.cast(SEGMENT).alias("s"))).select(column).first()[0]


def test_attributes(spark):
    x = elements.create_element("ph", type="t", external_id=2, extra={"own": "1"})
    assert one(spark, elements.attribute_map(x)) == {"type": "t", "x": "2", "own": "1"}
    assert one(spark, elements.get_attribute(x, "x")) == "2" and one(spark, elements.get_attribute(x, "own")) == "1"
    assert one(spark, elements.get_attribute(x, "none", "d")) == "d"
    assert one(spark, elements.attribute_map(elements.set_attribute(elements.set_attribute(x, "x", "7"), "a", "b"))) == {"type": "t", "x": "7", "a": "b", "own": "1"}
    assert one(spark, elements.attribute_map(elements.delete_attribute(elements.delete_attribute(x, "own"), "type"))) == {"x": "2"}
    assert one(spark, elements.attribute_map(elements.delete_attribute(x, "none"))) == {"type": "t", "x": "2", "own": "1"}


def test_tags(spark):
    unknown = items.item("unknown", payload=F.lit(b"<q:odd/>"))
    assert [one(spark, elements.get_tag(unknown, n, Catalog({"q": "urn:q"}))) for n in ("local", "prefixed", "qualified")] == ["odd", "q:odd", "{urn:q}odd"]
    assert one(spark, elements.get_tag(items.item("hi"))) == "hi" and one(spark, elements.get_tag(items.item("text", text="x"))) is None
    with pytest.raises(ValueError):
        elements.get_tag(unknown, "short")


def test_children(spark):
    seg = F.array(*(items.item(k, d, text=t) for d, k, t in [(0, "hi", None), (1, "text", "a"), (1, "ph", None), (0, "text", "b"), (0, "ph", None)]))
    s = F.col("s")
    kinds = lambda c: [i.kind for i in one(spark, c, seg)]
    assert kinds(elements.iter_children(s)) == ["hi", "text", "ph"]
    assert kinds(elements.iter_children(s, 0)) == ["text", "ph"] and kinds(elements.iter_children(s, None, "ph")) == ["ph"] and kinds(elements.iter_children(s, None, [])) == []
    assert one(spark, elements.get_text(s, 0), seg) == "a" and one(spark, elements.get_tail(s, 0), seg) == "b" and one(spark, elements.get_tail(s, 4), seg) is None
    assert kinds(elements.clear(s, 0)) == ["hi", "text", "ph"]
    assert kinds(elements.append_child(s, F.array(items.item("hi")))) == ["hi", "text", "ph", "text", "ph", "hi"]


def test_runs_of_elements(spark, tmp_path):
    df = spark.createDataFrame([(f'<tu tuid="{i}"><x/></tu>',) for i in range(10)], "m string").coalesce(1)
    sink.write_elements(df, str(tmp_path / "o"), "<body>", "</body>")
    part = next((tmp_path / "o").glob("part-*"))
    assert [e.attrib["tuid"] for e in ET.parse(part).getroot()] == [str(i) for i in range(10)]
    back = tmx.read_elements(spark, str(tmp_path / "o"), "tu").select("element").collect()
    assert sorted(ET.fromstring(r.element).attrib["tuid"] for r in back) == [str(i) for i in range(10)]

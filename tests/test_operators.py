"""Operators over segments, on small trees with exact results."""

import re

import pytest
from pyspark.sql import functions as F

from weftline.functions import coerce, encodings, names, uris
from weftline.operators import items, normalize, regex, text, transform, walk
from weftline.schema import SEGMENT
from weftline import errors

#: text, hi(text, ph(text), text), text, unknown
WALK = [(0, "text", "a"), (0, "hi", None), (1, "text", "b"), (1, "ph", None), (2, "text", "c"), (1, "text", "d"), (0, "text", "e"), (0, "unknown", "<z/>")]


def tree(spark, rows):
    made = [items.item(k, d, text=t if k == "text" else None, payload=F.lit((t or "").encode()) if k == "unknown" else None) for d, k, t in rows]
    return spark.range(1).select((F.array(*made) if made else F.array()).cast(SEGMENT).alias("s"))


def run(spark, rows, op):
    out = tree(spark, rows).select(op(F.col("s"))).first()[0]
    if isinstance(out, list) and out and hasattr(out[0], "kind"):
        return [(i.depth, i.kind, i.text if i.kind != "unknown" else bytes(i.payload).decode()) for i in out]
    return out


@pytest.mark.parametrize(
    "options, want",
    [
        ({}, [0, 1, 6]),
        ({"yield_unknown": True}, [0, 1, 6, 7]),
        ({"yield_text": False}, [1]),
        ({"recurse": True}, [0, 1, 2, 3, 4, 5, 6]),
        ({"recurse": True, "yield_text": False, "yield_unknown": True}, [1, 3, 7]),
    ],
)
def test_walk_content(spark, options, want):
    assert run(spark, WALK, lambda s: walk.walk_content(s, **options)) == [WALK[k] for k in want]


def test_walk_filtered_and_inline(spark):
    assert run(spark, WALK, lambda s: walk.walk_content_filtered(s, lambda x: x["text"] == "c", True)) == [WALK[4]]
    assert run(spark, WALK, lambda s: walk.walk_inline_nodes(s)) == [WALK[1]]
    assert run(spark, WALK, lambda s: walk.walk_inline_nodes(s, True)) == [WALK[1], WALK[3]]


def test_walk_structure(spark):
    leaf = "array<struct<text:string,language:string,kind:string>>"
    rows = spark.sql(f"SELECT from_json('[{{\"text\":\"n\"}}]', '{leaf}') n, from_json('[{{\"text\":\"p\",\"kind\":\"k\"}}]', '{leaf}') p")
    variants = F.array(F.struct(F.lit("en").alias("language"), F.col("n").alias("notes"), F.col("p").alias("props")))
    kinds = lambda c: [x.node for x in rows.select(c).first()[0]]
    assert kinds(walk.walk_unit(F.col("n"), F.col("p"), variants)) == ["note", "prop", "variant"]
    assert kinds(walk.walk_unit(F.col("n"), F.col("p"), variants, True)) == ["note", "prop", "variant", "note", "prop"]
    memory = spark.sql("SELECT 'm' memory_id").withColumn("header", F.struct(F.array().cast(leaf).alias("notes"), F.array().cast(leaf).alias("props")))
    units = rows.select(F.lit("m").alias("memory_id"), F.lit(0).cast("long").alias("unit_pos"), F.lit("u").alias("translation_unit_id"), F.col("n").alias("notes"), F.col("p").alias("props"), variants.alias("variants"))
    got = walk.walk_memory(memory, units, True).orderBy("step", "unit_pos", "place")
    assert [r.node for r in got.collect()] == ["header", "unit", "note", "prop", "variant", "note", "prop"]
    assert [r.node for r in walk.walk_memory(memory, units).orderBy("step").collect()] == ["header", "unit"]


def test_parents_and_content(spark):
    assert run(spark, WALK, items.parents) == [-1, -1, 1, 1, 3, 1, -1, -1]
    assert run(spark, WALK, lambda s: items.content_of(s, 1)) == [(0, "text", "b"), (0, "ph", None), (1, "text", "c"), (0, "text", "d")]
    assert run(spark, WALK, lambda s: items.content_of(s, 0)) == []


def test_text(spark):
    fmt = lambda payload: F.decode(payload, "UTF-8")
    assert run(spark, WALK, lambda s: text.fragments(s)) == ["a", "e"]
    assert run(spark, WALK, lambda s: text.fragments(s, True, fmt)) == ["a", "b", "c", "d", "e", "<z/>"]
    assert [(r.text, r.source) for r in run(spark, WALK, lambda s: text.fragments_with_source(s, True, fmt))] == [("a", -1), ("b", 1), ("c", 3), ("d", 1), ("e", -1), ("<z/>", 7)]
    assert run(spark, WALK, lambda s: text.find(s, "[bc]")) is None
    assert run(spark, WALK, lambda s: text.find(s, re.compile("[BC]", re.I), True)) == "b"
    assert run(spark, WALK, lambda s: text.find_all(s, "[bc]", True)) == ["b", "c"]
    assert run(spark, WALK, lambda s: text.join(s, "-", True)) == "a-b-c-d-e"
    assert run(spark, [], lambda s: text.join(s)) == ""


@pytest.mark.parametrize("rows, flat, deep", [([], True, True), ([(0, "text", "")], False, False), ([(0, "unknown", "x")], True, True), ([(0, "hi", None), (1, "text", "x")], True, False)])
def test_is_empty(spark, rows, flat, deep):
    assert (run(spark, rows, text.is_empty), run(spark, rows, lambda s: text.is_empty(s, True))) == (flat, deep)


REMOVE = [(0, "text", "a"), (0, "ph", None), (1, "text", "b"), (0, "hi", None), (1, "text", "c"), (1, "ph", None), (2, "text", "d"), (1, "text", "e"), (0, "text", "f")]


def test_remove(spark):
    assert run(spark, REMOVE, lambda s: transform.remove(s, "ph")) == [REMOVE[k] for k in (0, 3, 4, 5, 6, 7, 8)]
    assert run(spark, REMOVE, lambda s: transform.remove(s, "ph", True)) == [REMOVE[k] for k in (0, 3, 4, 7, 8)]
    assert run(spark, REMOVE, lambda s: transform.remove(s, ("ph", "hi"))) == [REMOVE[0], REMOVE[8]]
    assert run(spark, REMOVE, lambda s: transform.remove(s, lambda x: x["depth"] == 1, True)) == [REMOVE[k] for k in (0, 1, 2, 3, 4, 7, 8)]


NEST = [(0, "hi", None), (1, "hi", None), (2, "text", "x"), (1, "ph", None), (2, "hi", None), (3, "text", "y"), (0, "hi", None)]


def test_unwrap(spark):
    assert run(spark, NEST, lambda s: transform.unwrap(s, "hi")) == [(0, "text", "x"), (0, "ph", None), (1, "hi", None), (2, "text", "y")]
    assert run(spark, NEST, lambda s: transform.unwrap(s, "hi", True)) == [(0, "text", "x"), (0, "ph", None), (1, "text", "y")]
    assert run(spark, NEST, lambda s: transform.unwrap(s, "ph")) == NEST


def test_promote(spark):
    rows = [(0, "text", "12a3"), (0, "text", ""), (0, "hi", None), (1, "text", "b4")]
    ph = lambda m: transform.node_with_text("ph", m)
    flat = [(0, "ph", None), (1, "text", "12"), (0, "text", "a"), (0, "ph", None), (1, "text", "3"), (0, "text", ""), (0, "hi", None)]
    assert run(spark, rows, lambda s: transform.promote_match(s, "[0-9]+", ph)) == [*flat, (1, "text", "b4")]
    assert run(spark, rows, lambda s: transform.promote_match(s, "[0-9]+", ph, True)) == [*flat, (1, "text", "b"), (1, "ph", None), (2, "text", "4")]


def test_replace(spark):
    rows = [(0, "text", "a1"), (0, "hi", None), (1, "text", "b2")]
    assert run(spark, rows, lambda s: transform.replace_text(s, "(?P<d>[0-9])", r"<\g<d>$>"))[0] == (0, "text", "a<1$>")
    assert [t for *_, t in run(spark, rows, lambda s: transform.replace_text(s, "[0-9]", "x", True))] == ["ax", None, "bx"]
    assert [t for *_, t in run(spark, rows, lambda s: transform.replace_text_with(s, "[0-9]", lambda m: str(int(m[0]) + 1), True))] == ["a2", None, "b3"]


def test_collapse(spark):
    rows = [(0, "text", "a"), (0, "text", ""), (0, "hi", None), (1, "text", "b"), (1, "text", "c"), (0, "text", ""), (0, "text", "d")]
    assert run(spark, rows, normalize.collapse_text) == [(0, "text", "a"), (0, "hi", None), (1, "text", "b"), (1, "text", "c"), (0, "text", "d")]
    assert run(spark, rows, lambda s: normalize.collapse_text(s, True)) == [(0, "text", "a"), (0, "hi", None), (1, "text", "bc"), (0, "text", "d")]
    assert run(spark, rows, normalize.remove_empty_text) == [rows[k] for k in (0, 2, 3, 4, 6)]


def test_strip(spark):
    rows = [(0, "ph", None), (0, "text", " a\x1c"), (0, "hi", None), (1, "text", " b "), (0, "text", " c　")]
    got = lambda **o: [t for *_, t in run(spark, rows, lambda s: normalize.strip_whitespace(s, **o)) if t]
    assert got() == ["a\x1c", " b ", " c"]
    assert got(mode="leading") == ["a\x1c", " b ", " c　"]
    assert got(mode="trailing", recurse=True) == [" a\x1c", " b", " c"]
    assert got(recurse=True) == ["a\x1c", "b", " c"]
    with pytest.raises(ValueError):
        normalize.strip_whitespace(F.col("s"), "inside")


def test_deduplicate(spark):
    df = spark.sql("SELECT array('a', 'b', 'a') props, array('x', 'x') notes, array(named_struct('props', array('q', 'q'), 'notes', array('n', 'n'))) variants")
    assert normalize.deduplicate_props(df).first().props == ["a", "b"]
    assert normalize.deduplicate_props(df, True).first().variants[0].props == ["q"]
    assert normalize.deduplicate_notes(df).first().variants[0].notes == ["n", "n"]


def test_coercions(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    assert [one(coerce.to_integer(F.lit(v))) for v in (" 12 ", "+5", "x", "")] == [12, 5, None, None]
    written = [one(coerce.from_time(coerce.to_time(F.lit(v)))) for v in ("20240102T030405Z", "2024-01-02T05:04:05+02:00", "20240102", "2024-01-02T03:04:05", "soon")]
    assert written == ["20240102T030405Z", "20240102T030405Z", "20240102T000000Z", "20240102T030405Z", None]
    assert [one(coerce.is_encoding(F.lit(v))) for v in ("utf-8", "Latin-1", "klingon")] == [True, True, False]
    assert [encodings.canonical_encoding(v) for v in (None, "unicode", "UTF8")] == ["utf-8"] * 3
    with pytest.raises(ValueError):
        encodings.canonical_encoding("klingon")


def test_names(spark):
    c = names.Catalog({"a": "urn:a", "": "urn:d"})
    assert c.resolve("a:x") == ("a", "urn:a", "x", "{urn:a}x")
    assert c.resolve(":x").clark == "{urn:d}x" and c.resolve("x") == (None, None, "x", "x")
    assert c.resolve("{urn:b}x") == (None, "urn:b", "x", "{urn:b}x") and c.resolve("a:x", {"a": "urn:own"}).uri == "urn:own"
    assert c.formatted("{urn:a}x", "prefixed") == "a:x" and c.formatted("a:x", "local") == "x" and c.formatted("a:x", "qualified") == "{urn:a}x"
    for bad, error in (("b:x", errors.UnregisteredPrefixError), ("a:b:c", errors.MultiplePrefixesError), ("{urn:a", ValueError), ("a:", ValueError), ("", ValueError)):
        with pytest.raises(error):
            c.resolve(bad)
    for call, error in (
        (lambda: c.register("xml", "urn:x"), errors.RestrictedPrefixError), (lambda: c.register("p", names.XML_URI), errors.RestrictedURIError),
        (lambda: c.register("a", "urn:z"), errors.ExistingNamespaceError), (lambda: c.register("1", "urn:z"), errors.InvalidNCNameError),
        (lambda: c.register("z", "no uri"), ValueError), (lambda: c.drop_prefix("zz"), errors.UnregisteredPrefixError),
        (lambda: c.drop_uri("urn:zz"), errors.UnregisteredURIError), (lambda: c.formatted("{urn:q}x", "prefixed"), errors.UnregisteredURIError),
    ):
        with pytest.raises(error):
            call()
    c.register("b", "urn:a")
    with pytest.raises(errors.MultiplePrefixesError):
        c.formatted("{urn:a}x", "prefixed")
    c.drop_uri("urn:a")
    assert list(c.prefixes) == [""]
    for name, ok in (("a", True), ("é·-.1", True), ("_", True), ("1a", False), ("a b", False), ("", False), ("a:b", False)):
        assert spark.range(1).select(names.is_ncname(F.lit(name))).first()[0] is ok
        try:
            names.check_ncname(name)
            assert ok
        except ValueError:
            assert not ok


@pytest.mark.parametrize("uri, ok", [
    ("a:b", True), ("http://example.com:8080/path?q=1#f", True), ("http://[2001:db8::1]:80/", True), ("http://[v1.test]/", True), ("urn:", True), ("foo://", True), ("foo:?#", True),
    ("http://example.com:", True), ("https://e.com/p%20ath", True), ("", False), ("//e.com/p", False), ("1http://e.com", False), ("http://e.com//a", False), ("http://[]/", False),
    ("http://u@v@e.com/", False), ("http://e.com/%2", False), ("http://a:b:c/", False), ("http://[::1]x", False), ("http://e.com/ a", False), ("http://e.com/#a b", False),
])
def test_uris(spark, uri, ok):
    assert spark.range(1).select(uris.is_uri(F.lit(uri))).first()[0] is ok
    try:
        uris.check_uri(uri)
        assert ok
    except ValueError:
        assert not ok


def test_patterns():
    assert regex.java_pattern(re.compile(r"(?P<a>x)(?P=a)", re.I)) == r"(?iU)(?<a>x)\k<a>"
    assert regex.java_pattern(r"(?P<a_b>[0-9])") == f"(?<gx{'a_b'.encode().hex()}>[0-9])" and regex.java_replacement(r"\g<a_b>") == f"${{gx{'a_b'.encode().hex()}}}"
    assert regex.java_pattern(re.compile(r"\w", re.A)) == r"\w" and regex.java_pattern(r"a.\Z") == r"(?d)a.\z"
    assert regex.java_replacement(r"\1 $ \g<a>") == r"$1 \$ ${a}"

"""Registered queries over the driver's tables, and their DuckDB SQL.

Arrays are returned as joined texts, places as explicit columns, so that results
compare row by row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import coerce, encodings, markup, names, uris
from ..operators import build, elements, normalize, text, transform, walk
from ..operators.items import is_text
from ..sources import tmx
from . import virtual
from .virtual import table

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    """Register a query, with its SQL where there is one."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


_LINES = "lines AS (SELECT doc_id, lang, source, unnest(string_split(text, chr(10))) AS t, unnest(range(len(string_split(text, chr(10))))) AS pos FROM documents)"
#: Items of the tag trees: depth is the number of nodes that are open before an item (never below 0), parent the last node before it one level up.
_TREE = """
tok AS (SELECT page_id, unnest(regexp_extract_all(html, '<[^>]*>|[^<]+')) AS t, unnest(range(len(regexp_extract_all(html, '<[^>]*>|[^<]+')))) AS n FROM pages),
kinds AS (SELECT *, lower(regexp_extract(t, '^</?([A-Za-z0-9]+)', 1)) AS name, t LIKE '</%' AS ends FROM tok),
typed AS (SELECT *, CASE WHEN t NOT LIKE '<%' THEN 'text'
    WHEN regexp_matches(t, '^<!|^<[?]|/>$') OR name IN ('area', 'base', 'br', 'col', 'embed', 'hr', 'img', 'input', 'link', 'meta', 'source', 'track', 'wbr') THEN 'unknown'
    WHEN name IN ('a', 'span') THEN 'ph' WHEN name IN ('b', 'i', 'em', 'strong') THEN 'hi' ELSE 'sub' END AS kind FROM kinds),
raw AS (SELECT *, coalesce(sum(CASE WHEN ends THEN -1 WHEN kind IN ('text', 'unknown') THEN 0 ELSE 1 END) OVER (PARTITION BY page_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS h FROM typed),
tree AS (SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY n) - 1 AS pos, t, kind, name, depth FROM (
    SELECT *, (h - least(0, min(h) OVER (PARTITION BY page_id ORDER BY n)))::INTEGER AS depth FROM raw) WHERE NOT ends)"""


@query(f"WITH {_LINES} SELECT lang, count(*) AS n_items, count(*) FILTER (WHERE t = '') AS n_empty, sum(length(t))::BIGINT AS n_chars FROM lines GROUP BY lang")
def item_stats_by_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items, empty items and characters for each language."""
    rows = walk.explode_items(virtual.lines(spark, sf_dir), parent_columns=["lang"])
    return rows.groupBy("lang").agg(F.count("*").alias("n_items"), F.count_if(F.col("text") == "").alias("n_empty"), F.sum(F.length("text").cast("long")).alias("n_chars"))


def _items(df: DataFrame, key: str, seg) -> DataFrame:
    """An item a row: place, kind, depth and written form."""
    shown = F.coalesce(F.col("text"), F.decode("payload", "UTF-8"), F.col("type"))
    return walk.explode_items(df.select(key, seg.alias("segment"))).select(key, F.col("pos").cast("long").alias("pos"), "kind", "depth", shown.alias("shown"))


_SHOWN = "CASE WHEN kind IN ('text', 'unknown') THEN t ELSE name END AS shown"


@query(f"WITH {_TREE} SELECT page_id, pos, kind, depth, {_SHOWN} FROM tree")
def walk_content_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every item of every page's tree in document order."""
    return _items(virtual.tags(spark, sf_dir), "page_id", walk.walk_content(F.col("segment"), True, True, True))


@query(f"WITH {_TREE} SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY pos) - 1 AS pos, kind, depth, {_SHOWN} FROM tree WHERE depth = 0 AND kind <> 'unknown'")
def walk_content_flat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The top level without unknown items."""
    return _items(virtual.tags(spark, sf_dir), "page_id", walk.walk_content(F.col("segment")))


@query(f"WITH {_TREE} SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY pos) - 1 AS pos, kind, depth, {_SHOWN} FROM tree WHERE kind NOT IN ('text', 'unknown')")
def walk_inline_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inline nodes of every depth."""
    return _items(virtual.tags(spark, sf_dir), "page_id", walk.walk_inline_nodes(F.col("segment"), True))


@query(f"WITH {_TREE} SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY pos) - 1 AS pos, kind, depth, {_SHOWN} FROM tree WHERE (kind = 'text' AND length(t) > 20) OR depth > 4")
def walk_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items that satisfy a predicate."""
    return _items(virtual.tags(spark, sf_dir), "page_id", walk.walk_content_filtered(F.col("segment"), lambda x: (is_text(x) & (F.length(x["text"]) > 20)) | (x["depth"] > 4), True))


@query(f"WITH {_TREE} SELECT name AS type, count(*) AS n, count(*) FILTER (WHERE depth = 0) AS n_top FROM tree WHERE kind NOT IN ('text', 'unknown') GROUP BY name")
def element_attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An attribute of every inline node, counted by value."""
    rows = virtual.tags(spark, sf_dir).select(F.explode(walk.walk_inline_nodes(F.col("segment"), True)).alias("x"))
    return rows.select(elements.get_attribute(F.col("x"), "type").alias("type"), F.col("x.depth").alias("d")).groupBy("type").agg(F.count("*").alias("n"), F.count_if(F.col("d") == 0).alias("n_top"))


@query(f"WITH {_TREE} SELECT page_id, pos, lower(regexp_extract(t, '^<([^ \\t\\n/>]+)', 1)) AS tag FROM tree WHERE kind = 'unknown'")
def unknown_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tags of the elements that the model keeps as bytes."""
    rows = virtual.tags(spark, sf_dir).select("page_id", F.posexplode("segment").alias("pos", "x")).where("x.kind = 'unknown'")
    return rows.select("page_id", F.col("pos").cast("long").alias("pos"), F.lower(elements.get_tag(F.col("x"), "prefixed")).alias("tag"))


@query("""
WITH p AS (SELECT source, doc_id, k, kind, text FROM (SELECT d.source, d.doc_id, unnest([0, 1]) AS k, unnest(['quality', 'toxic']) AS kind, unnest([quality::VARCHAR, toxic::VARCHAR]) AS text FROM labels l JOIN documents d USING (doc_id))),
props AS (SELECT source, 'prop' AS node, NULL::INTEGER AS variant_pos, (row_number() OVER (PARTITION BY source ORDER BY doc_id, k) - 1)::INTEGER AS pos, kind AS name, text, NULL AS language, 0 AS step FROM p),
vars AS (SELECT source, 'variant' AS node, (row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1)::INTEGER AS pos, lang AS language FROM documents WHERE source IN (SELECT source FROM p)),
rows_ AS (SELECT source, node, variant_pos, pos, name, text, language, step FROM props UNION ALL SELECT source, node, pos, pos, NULL, NULL, language, 1 FROM vars)
SELECT source, row_number() OVER (PARTITION BY source ORDER BY step, pos) - 1 AS place, node, variant_pos, pos, name, text, language FROM rows_
""")
def walk_structure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Props and variants of each unit, a unit being a source."""
    variants = table(spark, sf_dir, "documents").groupBy("source").agg(F.transform(F.sort_array(F.collect_list(F.struct("doc_id", "lang"))), lambda x: F.struct(x["lang"].alias("language"))).alias("variants"))
    units = virtual.labelled(spark, sf_dir).join(variants, "source")
    none = F.array().cast("array<struct<text:string,language:string>>")
    props = F.transform("props", lambda p: F.struct(p["kind"].alias("kind"), p["text"].alias("text"), F.lit(None).cast("string").alias("language")))
    return units.select("source", F.posexplode(walk.walk_unit(none, props, F.col("variants"))).alias("place", "n")).select("source", F.col("place").cast("long").alias("place"), "n.*")


@query(f"WITH {_TREE} SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY pos) - 1 AS place, t AS fragment FROM tree WHERE kind = 'text'")
def iter_fragments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts of every depth."""
    pages = virtual.tags(spark, sf_dir)
    return pages.select("page_id", F.posexplode(text.fragments(F.col("segment"), True)).alias("place", "fragment")).withColumn("place", F.col("place").cast("long"))


@query(f"""WITH {_TREE}, f AS (SELECT page_id, pos, t, kind, depth FROM tree WHERE kind IN ('text', 'unknown'))
SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY f.pos) - 1 AS place, CASE WHEN kind = 'text' THEN t ELSE '?' || t END AS fragment,
  CASE WHEN kind = 'unknown' THEN f.pos WHEN depth = 0 THEN -1 ELSE (SELECT max(p.pos) FROM tree p WHERE p.page_id = f.page_id AND p.pos < f.pos AND p.depth = f.depth - 1) END AS source
FROM f""")
def fragments_with_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts with the place of the node that owns them; unknown items through a formatter."""
    pages = virtual.tags(spark, sf_dir)
    found = text.fragments_with_source(F.col("segment"), True, lambda payload: F.concat(F.lit("?"), F.decode(payload, "UTF-8")))
    return pages.select("page_id", F.posexplode(found).alias("place", "f")).select("page_id", F.col("place").cast("long").alias("place"), F.col("f.text").alias("fragment"), F.col("f.source").cast("long").alias("source"))


@query(f"WITH {_TREE} SELECT p.page_id, count(*) FILTER (WHERE kind = 'text' AND depth = 0) = 0 AS flat, count(*) FILTER (WHERE kind = 'text') = 0 AS deep FROM pages p LEFT JOIN tree USING (page_id) GROUP BY p.page_id")
def is_empty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages without any text, at the top level and at all."""
    return virtual.tags(spark, sf_dir).select("page_id", text.is_empty(F.col("segment")).alias("flat"), text.is_empty(F.col("segment"), True).alias("deep"))


@query("SELECT doc_id, list_filter(string_split(text, chr(10)), lambda t: regexp_matches(t, '[0-9]'))[1] AS first FROM documents")
def find_first_digit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first line that holds a digit."""
    return virtual.lines(spark, sf_dir).select("doc_id", text.find(F.col("segment"), "[0-9]").alias("first"))


@query("SELECT doc_id, len(l)::INTEGER AS n, array_to_string(l, '|') AS found FROM (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda t: regexp_matches(t, '[0-9]{3}|!!')) AS l FROM documents)")
def find_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All lines that match a pattern."""
    found = text.find_all(F.col("segment"), "[0-9]{3}|!!")
    return virtual.lines(spark, sf_dir).select("doc_id", F.size(found).alias("n"), F.array_join(found, "|").alias("found"))


@query("SELECT doc_id, unnest(l) AS line, unnest(range(len(l))) AS place FROM (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda t: regexp_matches(t, '^[A-Z]')) AS l FROM documents)")
def find_iter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same a row at a time."""
    return virtual.lines(spark, sf_dir).select("doc_id", F.posexplode(text.find_iter(F.col("segment"), "^[A-Z]")).alias("place", "line")).withColumn("place", F.col("place").cast("long"))


@query(f"WITH {_TREE} SELECT p.page_id, coalesce(string_agg(t, '/' ORDER BY pos) FILTER (WHERE kind = 'text'), '') AS joined FROM pages p LEFT JOIN tree USING (page_id) GROUP BY p.page_id")
def join_fragments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All text of a page."""
    return virtual.tags(spark, sf_dir).select("page_id", text.join(F.col("segment"), "/", True).alias("joined"))


@query(f"""WITH RECURSIVE {_TREE}, own AS (SELECT *, (SELECT max(q.pos) FROM tree q WHERE q.page_id = p.page_id AND q.pos < p.pos AND q.depth = p.depth - 1) AS parent FROM tree p),
gone AS (SELECT page_id, pos FROM own WHERE kind IN ('ph', 'hi') UNION SELECT o.page_id, o.pos FROM own o JOIN gone g ON o.page_id = g.page_id AND o.parent = g.pos)
SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY pos) - 1 AS pos, kind, depth, {_SHOWN} FROM own ANTI JOIN gone USING (page_id, pos)""")
def remove_inline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trees without two kinds and all they hold."""
    return _items(virtual.tags(spark, sf_dir), "page_id", transform.remove(F.col("segment"), ("ph", "hi"), True))


@query(f"""WITH RECURSIVE {_TREE}, own AS (SELECT *, (SELECT max(q.pos) FROM tree q WHERE q.page_id = p.page_id AND q.pos < p.pos AND q.depth = p.depth - 1) AS parent FROM tree p),
lift AS (SELECT page_id, pos, kind, t, name, depth, 0 AS up, kind = 'sub' AS goes FROM own WHERE parent IS NULL
  UNION ALL SELECT o.page_id, o.pos, o.kind, o.t, o.name, o.depth, l.up + l.goes::INTEGER, o.kind = 'sub' FROM own o JOIN lift l ON o.page_id = l.page_id AND o.parent = l.pos)
SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY pos) - 1 AS pos, kind, (depth - up)::INTEGER AS depth, {_SHOWN} FROM lift WHERE NOT goes""")
def unwrap_inline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trees in which the content of one kind takes its place."""
    return _items(virtual.tags(spark, sf_dir), "page_id", transform.unwrap(F.col("segment"), "sub", True))


@query(f"""WITH {_LINES}, pieces AS (SELECT doc_id, pos, t, CASE WHEN regexp_matches(t, '[0-9]') THEN regexp_extract_all(t, '[0-9]+|[^0-9]+') ELSE [t] END AS l FROM lines),
one AS (SELECT doc_id, pos, unnest(l) AS p, unnest(range(len(l))) AS k FROM pieces)
SELECT doc_id, count(*) + count(*) FILTER (WHERE regexp_matches(p, '^[0-9]+$')) AS n_items, coalesce(string_agg(p, '|' ORDER BY pos, k) FILTER (WHERE regexp_matches(p, '^[0-9]+$')), '') AS numbers FROM one GROUP BY doc_id""")
def promote_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of digits become placeholders that hold them."""
    made = transform.promote_match(F.col("segment"), "[0-9]+", lambda m: transform.node_with_text("ph", m, type="number"))
    inner = F.transform(F.filter(F.col("made"), lambda x: x["depth"] == 1), lambda x: x["text"])
    return virtual.lines(spark, sf_dir).select("doc_id", made.alias("made")).select("doc_id", F.size("made").cast("long").alias("n_items"), F.array_join(inner, "|").alias("numbers"))


@query("SELECT doc_id, regexp_replace(text, '([0-9])[0-9]*', '<\\1>', 'g') AS replaced FROM documents")
def replace_digits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each run of digits by its first, in brackets."""
    return virtual.lines(spark, sf_dir).select("doc_id", text.join(transform.replace_text(F.col("segment"), "([0-9])[0-9]*", r"<\1>"), "\n").alias("replaced"))


@query(f"""WITH {_TREE}, g AS (SELECT *, CASE WHEN kind = 'text' AND lag(kind) OVER w = 'text' AND lag(depth) OVER w = depth THEN 0 ELSE 1 END AS new FROM tree WHERE kind <> 'unknown' WINDOW w AS (PARTITION BY page_id ORDER BY pos)),
i AS (SELECT *, sum(new) OVER (PARTITION BY page_id ORDER BY pos) - 1 AS place FROM g)
SELECT page_id, place::BIGINT AS pos, min(kind) AS kind, min(depth) AS depth, CASE WHEN min(kind) = 'text' THEN string_agg(t, '' ORDER BY pos) ELSE min(name) END AS shown FROM i GROUP BY page_id, place""")
def collapse_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts that meet once unknown items are gone become one."""
    known = F.filter("segment", lambda x: x["kind"] != "unknown")
    return _items(virtual.tags(spark, sf_dir).withColumn("segment", known), "page_id", normalize.collapse_text(F.col("segment"), True))


@query("SELECT doc_id, len(l)::INTEGER AS n, array_to_string(l, chr(10)) AS rest FROM (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda t: t <> '') AS l FROM documents)")
def remove_empty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines without the empty ones."""
    rest = normalize.remove_empty_text(F.col("segment"))
    return virtual.lines(spark, sf_dir).select("doc_id", F.size(rest).alias("n"), text.join(rest, "\n").alias("rest"))


@query(f"""WITH {_TREE}, own AS (SELECT *, (SELECT max(q.pos) FROM tree q WHERE q.page_id = p.page_id AND q.pos < p.pos AND q.depth = p.depth - 1) AS parent FROM tree p),
txt AS (SELECT *, row_number() OVER (PARTITION BY page_id, parent ORDER BY pos) AS f, row_number() OVER (PARTITION BY page_id, parent ORDER BY pos DESC) AS l FROM own WHERE kind = 'text')
SELECT page_id, pos, CASE WHEN l = 1 THEN regexp_replace(x, '[ \\t\\n\\r]+$', '') ELSE x END AS stripped FROM (SELECT *, CASE WHEN f = 1 THEN regexp_replace(t, '^[ \\t\\n\\r]+', '') ELSE t END AS x FROM txt)""")
def strip_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts of every content, the first stripped on its left and the last on its right."""
    pages = virtual.tags(spark, sf_dir).select("page_id", normalize.strip_whitespace(F.col("segment"), "both", True).alias("segment"))
    rows = pages.select("page_id", F.posexplode("segment").alias("pos", "x"))
    return rows.where("x.kind = 'text'").select("page_id", F.col("pos").cast("long").alias("pos"), F.col("x.text").alias("stripped"))


@query("SELECT doc_id, regexp_replace(l[1], '^[ \\t\\r]+', '') AS first, l[len(l)] AS last FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)")
def strip_leading(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First line stripped on its left; the last line as it is, unless it is the first."""
    rows = virtual.lines(spark, sf_dir).select("doc_id", text.fragments(normalize.strip_whitespace(F.col("segment"), "leading")).alias("l"))
    return rows.select("doc_id", F.element_at("l", 1).alias("first"), F.element_at("l", -1).alias("last"))


@query("""WITH p AS (SELECT source, doc_id, unnest(['quality', 'toxic']) AS kind, unnest([quality::VARCHAR, toxic::VARCHAR]) AS text, unnest([0, 1]) AS k FROM labels JOIN documents USING (doc_id)),
f AS (SELECT source, kind, text, min(doc_id * 2 + k) AS place FROM p GROUP BY ALL)
SELECT source, string_agg(kind || '=' || text, ',' ORDER BY place) AS props FROM f GROUP BY source""")
def dedupe_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first of equal props of each source."""
    units = normalize.deduplicate_props(virtual.labelled(spark, sf_dir))
    return units.select("source", F.array_join(F.transform("props", lambda p: F.concat(p["kind"], F.lit("="), p["text"])), ",").alias("props"))


@query(f"WITH {_LINES}, f AS (SELECT doc_id, t, min(pos) AS p FROM lines GROUP BY doc_id, t) SELECT doc_id, count(*)::INTEGER AS n, string_agg(t, chr(10) ORDER BY p) AS notes FROM f GROUP BY doc_id")
def dedupe_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first of equal lines of each document."""
    rows = virtual.lines(spark, sf_dir).select("doc_id", text.fragments(F.col("segment")).alias("notes"))
    return normalize.deduplicate_notes(rows).select("doc_id", F.size("notes").alias("n"), F.array_join("notes", "\n").alias("notes"))


@query("SELECT doc_id::VARCHAR AS unit, lang AS language, regexp_replace(regexp_replace(text, '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F]', '', 'g'), '\\n', '', 'g') AS text FROM documents")
def tmx_roundtrip_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents written as units and read back: lines run together in one text."""
    docs = virtual.lines(spark, sf_dir)
    clean = F.transform("segment", lambda x: x.withField("text", F.regexp_replace(x["text"], r"[\x00-\x08\x0B\x0C\x0E-\x1F]", "")))
    marked = F.concat(F.lit('<tu tuid="'), F.col("doc_id").cast("string"), F.lit('"><tuv xml:lang="'), markup.quoted(F.col("lang")), F.lit('"><seg>'), markup.segment(clean), F.lit("</seg></tuv></tu>"))
    units = tmx.parse_units(docs.select(marked.alias("m")), "m")
    rows = units.select("translation_unit_id", F.explode("variants").alias("v"))
    return rows.select(F.col("translation_unit_id").alias("unit"), F.col("v.language").alias("language"), text.join(F.col("v.segment")).alias("text"))


@query("SELECT event_id, strftime(date_trunc('second', ts), '%Y%m%dT%H%M%SZ') AS written, date_trunc('second', ts) AS ts, user_id FROM events")
def attr_coercion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Times and integers, written and read."""
    events = table(spark, sf_dir, "events").select("event_id", coerce.from_time(F.col("ts")).alias("written"), F.col("user_id").cast("string").alias("u"))
    return events.select("event_id", "written", coerce.to_time(F.col("written")).cast("timestamp_ntz").alias("ts"), coerce.to_integer(F.col("u")).alias("user_id"))


@query("""SELECT page_id, name, CASE WHEN name LIKE '{%' THEN 'a' WHEN name LIKE 'a:%' THEN 'a' WHEN name LIKE 'xml:%' THEN 'xml' END AS prefix,
CASE WHEN name LIKE '{%' OR name LIKE 'a:%' THEN 'urn:a' WHEN name LIKE 'xml:%' THEN 'http://www.w3.org/XML/1998/namespace' END AS uri, 'p' || page_id AS local
FROM (SELECT page_id, CASE page_id % 4 WHEN 0 THEN '{urn:a}p' WHEN 1 THEN 'a:p' WHEN 2 THEN 'xml:p' ELSE 'p' END || page_id AS name FROM pages)""")
def qname_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names in every notation."""
    k = F.col("page_id") % 4
    name = F.concat(F.when(k == 0, "{urn:a}p").when(k == 1, "a:p").when(k == 2, "xml:p").otherwise("p"), F.col("page_id").cast("string"))
    found = names.Catalog({"a": "urn:a"}).resolved(F.col("name"))
    return table(spark, sf_dir, "pages").select("page_id", name.alias("name")).select("page_id", "name", found.alias("r")).select("page_id", "name", "r.prefix", "r.uri", "r.local")


@query("SELECT n_name AS name, regexp_matches(n_name, '^[A-Za-z_][A-Za-z0-9_.-]*$') AS ok FROM nation UNION ALL SELECT p_name, regexp_matches(p_name, '^[A-Za-z_][A-Za-z0-9_.-]*$') FROM part")
def ncname_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which names are names without colon (ASCII names, so that SQL can tell)."""
    both = table(spark, sf_dir, "nation").select(F.col("n_name").alias("name")).unionByName(table(spark, sf_dir, "part").select(F.col("p_name").alias("name")))
    return both.select("name", names.is_ncname(F.col("name")).alias("ok"))


@query("SELECT page_id, url, regexp_matches(url, '^[A-Za-z][A-Za-z0-9+.-]*:(//[A-Za-z0-9.-]*(:[0-9]*)?(/([A-Za-z0-9._~!$&''()*+,;=:@%-]+(/[A-Za-z0-9._~!$&''()*+,;=:@%-]*)*)?)?)([?][^#\\s]*)?(#\\S*)?$') AS ok FROM pages")
def uri_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which addresses are valid."""
    return table(spark, sf_dir, "pages").select("page_id", "url", uris.is_uri(F.col("url")).alias("ok"))


@query("SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'utf-8' WHEN 1 THEN 'iso8859-1' WHEN 2 THEN 'utf-8' END AS encoding FROM documents")
def encoding_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Canonical names of encodings; null where there is none."""
    k = F.col("doc_id") % 4
    given = F.when(k == 0, "UTF8").when(k == 1, "Latin-1").when(k == 2, "unicode").otherwise("klingon")
    return table(spark, sf_dir, "documents").select("doc_id", encodings.canonical(given).alias("encoding"))


#: Items of the rich segments: place, kind, depth, then what each is expected to hold.
_RICH = """
rich(pos, kind, depth, shown, internal_id, external_id, type, position, association, data_type, extra) AS (VALUES
  (0, 'text', 0, 'a<b #', NULL, NULL, NULL, NULL, NULL, NULL, ''), (1, 'bpt', 0, NULL, '#', 'n', 'bold', NULL, NULL, NULL, 'mine=#'), (2, 'sub', 1, NULL, NULL, NULL, 't', NULL, NULL, 'html', ''),
  (3, 'text', 2, 'in sub', NULL, NULL, NULL, NULL, NULL, NULL, ''), (4, 'ept', 0, NULL, '#', NULL, NULL, NULL, NULL, NULL, ''), (5, 'it', 0, NULL, NULL, '7', 'x', 'begin', NULL, NULL, ''),
  (6, 'ph', 0, NULL, NULL, '8', '#', NULL, 'p', NULL, ''), (7, 'text', 1, 'held', NULL, NULL, NULL, NULL, NULL, NULL, ''), (8, 'hi', 0, NULL, NULL, '9', 'mark', NULL, NULL, NULL, ''),
  (9, 'hi', 1, NULL, NULL, NULL, 'inner', NULL, NULL, NULL, ''), (10, 'text', 2, '#', NULL, NULL, NULL, NULL, NULL, NULL, ''), (11, 'unknown', 0, '<own k="#">y</own>', NULL, NULL, NULL, NULL, NULL, NULL, ''),
  (12, 'text', 0, ' tail', NULL, NULL, NULL, NULL, NULL, NULL, '')),
filled AS (SELECT doc_id, pos, kind, depth, replace(shown, '#', doc_id::VARCHAR) AS shown, replace(internal_id, '#', doc_id::VARCHAR)::BIGINT AS internal_id,
  CASE external_id WHEN 'n' THEN length(text) ELSE external_id::BIGINT END AS external_id, replace(type, '#', doc_id::VARCHAR) AS type, position, association, data_type, replace(extra, '#', doc_id::VARCHAR) AS extra FROM documents, rich)"""


def _reread(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rich units, written and read again."""
    return tmx.parse_units(virtual.rich_units(spark, sf_dir).select("unit_pos", markup.Writer().unit().alias("m")), "m")


@query(f"WITH {_RICH} SELECT * FROM filled")
def roundtrip_inline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each inline kind with its attributes, and an unknown element, through writer and parser."""
    rows = _reread(spark, sf_dir).select(F.col("translation_unit_id").cast("long").alias("doc_id"), F.posexplode(F.col("variants")[0]["segment"]).alias("pos", "x"))
    shown = F.when(F.col("x.kind") == "unknown", F.decode("x.payload", "UTF-8")).otherwise(F.col("x.text"))
    extra = F.array_join(F.transform("x.extra", lambda e: F.concat(e["k"], F.lit("="), e["v"])), ",")
    return rows.select("doc_id", "pos", "x.kind", "x.depth", shown.alias("shown"), *(f"x.{c}" for c in ("internal_id", "external_id", "type", "position", "association", "data_type")), extra.alias("extra"))


_TIMES = "strftime(to_timestamp(1700000000 + doc_id) AT TIME ZONE 'UTC', '%Y%m%dT%H%M%SZ')"


@query(f"""SELECT doc_id, 'utf-8|type ' || doc_id || '|' || length(text) || '|' || {_TIMES} || '|tool & <co>|' || doc_id || '|' || {_TIMES} || '|a"b' || doc_id || '|' || {_TIMES} || '|é|fmt' AS shared,
'utf-8|type ' || doc_id || '|' || length(text) || '|' || {_TIMES} || '|tool & <co>|' || doc_id || '|' || {_TIMES} || '|a"b' || doc_id || '|' || {_TIMES} || '|é|fmt' AS of_variant,
lang AS source_language, 'sentence' AS segmentation_type, lang AS language, 'mine=' || doc_id AS extra, 'mine=' || doc_id AS variant_extra, '<tail k="' || doc_id || '">x</tail>' AS nodes, '<odd k="' || doc_id || '">x</odd>' AS variant_nodes FROM documents""")
def roundtrip_attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All attributes of units and variants, those that the model does not know, and unknown children, through writer and parser."""

    def joined(row) -> F.col:
        times = ("last_used_at", "created_at", "last_modified_at")
        names_ = "original_encoding original_data_type usage_count last_used_at creation_tool creation_tool_version created_at created_by last_modified_at last_modified_by original_tm_format".split()
        return F.concat_ws("|", *((coerce.from_time(row(c)) if c in times else row(c).cast("string")) for c in names_))

    extra = lambda c: F.array_join(F.transform(c, lambda e: F.concat(e["k"], F.lit("="), e["v"])), ",")
    nodes = lambda c: F.array_join(F.transform(c, lambda b: F.decode(b, "UTF-8")), "")
    v = F.col("variants")[0]
    return _reread(spark, sf_dir).select(
        F.col("translation_unit_id").cast("long").alias("doc_id"), joined(F.col).alias("shared"), joined(lambda c: v[c]).alias("of_variant"), "source_language", "segmentation_type", v["language"].alias("language"),
        extra(F.col("extra")).alias("extra"), extra(v["extra"]).alias("variant_extra"), nodes(F.col("extra_nodes")).alias("nodes"), nodes(v["extra_nodes"]).alias("variant_nodes"),
    )


@query("""WITH leaves(place, owner, node) AS (VALUES (0, 'unit', 'note'), (1, 'unit', 'prop'), (2, 'unit', 'prop'), (3, 'variant', 'note'), (4, 'variant', 'prop'))
SELECT doc_id, place, owner, node, CASE node WHEN 'note' THEN 'note ' || doc_id ELSE 'prop & ' || doc_id END AS text, CASE node WHEN 'prop' THEN source END AS kind, CASE node WHEN 'note' THEN lang ELSE 'en' END AS language,
CASE node WHEN 'note' THEN 'latin-1' END AS encoding, CASE node WHEN 'note' THEN 'mine=' || doc_id ELSE '' END AS extra, CASE node WHEN 'prop' THEN '<deep k="' || doc_id || '">x</deep>' ELSE '' END AS nodes FROM documents, leaves""")
def roundtrip_notes_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Notes and props of units and variants through writer and parser."""

    def leaf(x, owner: str, node: str):
        extra = F.array_join(F.transform(x["extra"], lambda e: F.concat(e["k"], F.lit("="), e["v"])), ",")
        nodes = F.array_join(F.transform(x["extra_nodes"], lambda b: F.decode(b, "UTF-8")), "")
        kind = x["kind"] if node == "prop" else F.lit(None).cast("string")
        return F.struct(F.lit(owner).alias("owner"), F.lit(node).alias("node"), x["text"].alias("text"), kind.alias("kind"), x["language"].alias("language"), x["original_encoding"].alias("encoding"), extra.alias("extra"), nodes.alias("nodes"))

    each = lambda rows, owner, node: F.transform(rows, lambda x: leaf(x, owner, node))
    v = F.col("variants")[0]
    all_ = F.concat(each(F.col("notes"), "unit", "note"), each(F.col("props"), "unit", "prop"), each(v["notes"], "variant", "note"), each(v["props"], "variant", "prop"))
    return _reread(spark, sf_dir).select(F.col("translation_unit_id").cast("long").alias("doc_id"), F.posexplode(all_).alias("place", "x")).select("doc_id", "place", "x.*")


_HEAD = "SELECT source, min(doc_id) AS id, count(*) AS units FROM documents WHERE source IS NOT NULL GROUP BY source"
_SAID = "strftime(to_timestamp(1600000000 + id) AT TIME ZONE 'UTC', '%Y%m%dT%H%M%SZ')"
_MEMORY = f"""SELECT source AS memory_id, '1.4' AS version, 't & c|' || id || '|block|f|en|de|d|utf-8|' || {_SAID} || '|me|' || {_SAID} || '|you' AS header, 'about ' || source AS notes, 'least id=' || id || ',least id=' || id AS props,
'mine=' || id AS header_extra, '<x>1</x>' AS header_nodes, 'own=' || source AS extra, '<y>' || id || '</y>' AS nodes, units FROM ({_HEAD})"""


def _memories(got: tmx.Memory) -> DataFrame:
    h = F.col("header")
    head = "creation_tool creation_tool_version segmentation_type original_translation_memory_format admin_language source_language original_data_type original_encoding created_at created_by last_modified_at last_modified_by".split()
    extra = lambda c: F.array_join(F.transform(c, lambda e: F.concat(e["k"], F.lit("="), e["v"])), ",")
    nodes = lambda c: F.array_join(F.transform(c, lambda b: F.decode(b, "UTF-8")), "")
    rows = got.memories.select(
        "memory_id", "version", F.concat_ws("|", *((coerce.from_time(h[c]) if c.endswith("_at") else h[c]) for c in head)).alias("header"), F.array_join(h["notes"]["text"], ",").alias("notes"),
        F.array_join(F.transform(h["props"], lambda x: F.concat(x["kind"], F.lit("="), x["text"])), ",").alias("props"), extra(h["extra"]).alias("header_extra"), nodes(h["extra_nodes"]).alias("header_nodes"),
        extra(F.col("extra")).alias("extra"), nodes(F.col("extra_nodes")).alias("nodes"),
    )
    return rows.join(got.units.groupBy("memory_id").agg(F.count("*").alias("units")), "memory_id")


@query(_MEMORY)
def roundtrip_memories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole documents, one per source: headers, notes, props, unknown attributes and nodes, and the number of units."""
    return _memories(tmx.parse_documents(virtual.written(spark, sf_dir), "content", "memory_id"))


@query(_MEMORY)
def roundtrip_utf16(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same in another encoding."""
    return _memories(tmx.parse_documents(virtual.written(spark, sf_dir, "UTF-16"), "content", "memory_id"))


@query(f"""WITH m AS ({_HEAD}),
own AS (SELECT source AS memory_id, 0 AS step, NULL::BIGINT AS unit_pos, unnest([0, 1, 2, 3]) AS place, unnest(['header', 'note', 'prop', 'prop']) AS node, unnest([NULL, NULL, 'least id', 'least id']) AS name, unnest([NULL, 'about ' || source, id::VARCHAR, id::VARCHAR]) AS text FROM m),
of_units AS (SELECT source, 1, doc_id, unnest(range(7))::INTEGER, unnest(['unit', 'note', 'prop', 'prop', 'variant', 'note', 'prop']), unnest([doc_id::VARCHAR, NULL, source, source, NULL, NULL, source]), unnest([NULL, 'note ' || doc_id, 'prop & ' || doc_id, 'prop & ' || doc_id, NULL, 'note ' || doc_id, 'prop & ' || doc_id]) FROM documents WHERE source IS NOT NULL)
SELECT * FROM own UNION ALL SELECT * FROM of_units""")
def walk_memory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole memories walked: header, units, variants, their notes and props."""
    memories, units = virtual.rich_memories(spark, sf_dir), virtual.rich_units(spark, sf_dir).where("memory_id IS NOT NULL")
    return walk.walk_memory(memories, units, True).select("memory_id", "step", "unit_pos", "place", "node", "name", "text")


@query("""SELECT doc_id, unnest(['prop', 'prop', 'prop']) AS node, unnest([NULL, NULL, 0]) AS variant_pos, unnest([0, 1, 0]) AS pos, source AS name FROM documents""")
def walk_structure_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The props of a structural walk."""
    walked = walk.walk_unit(F.col("notes"), F.col("props"), F.col("variants"), True)
    rows = virtual.rich_units(spark, sf_dir).select(F.col("unit_pos").alias("doc_id"), F.explode(walk.walk_filtered(walked, lambda x: x["node"] == "prop")).alias("x"))
    return rows.select("doc_id", "x.node", "x.variant_pos", "x.pos", "x.name")


@query("SELECT doc_id, '<note>' || doc_id || '</note>' AS written, 'N' || doc_id AS loaded FROM documents")
def overridden(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A dumper of one's own for notes, then a loader of one's own for what it wrote."""
    writer = markup.Writer()
    writer.register_override("note", lambda x: F.concat(F.lit("<note>"), F.regexp_extract(x["text"], "([0-9]+)", 1), F.lit("</note>")))
    rows = virtual.rich_units(spark, sf_dir).select(F.col("unit_pos").cast("string").alias("id"), writer.unit().alias("m"), writer.dumper("note")(F.col("notes")[0]).alias("written"))
    empty = {"language": None, "original_encoding": None, "extra": [], "extra_nodes": []}
    got = tmx.parse_units(rows, "m", "id", {"note": lambda e: {"text": f"N{e.text}", **empty}})
    return got.select("memory_id", F.col("notes")[0]["text"].alias("loaded")).join(rows.select(F.col("id").alias("memory_id"), "written"), "memory_id").select(F.col("memory_id").cast("long").alias("doc_id"), "written", "loaded")


@query("SELECT doc_id, doc_id::VARCHAR || '|b|' || length(text) AS set, NULL AS gone, 'a=1,i=' || doc_id || ',mine=' || doc_id || ',type=bold,x=' || length(text) AS map, 'new' AS text, ' and ' AS tail, 'text,bpt,ept,it,ph,hi,unknown,text,sub' AS kinds, 'hi' AS inner_kinds, 0 AS emptied FROM documents")
def element_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attributes set, deleted and listed; texts and tails set; children listed, appended and cleared."""
    rows = virtual.rich_units(spark, sf_dir).select(F.col("unit_pos").alias("doc_id"), F.col("variants")[0]["segment"].alias("s"))
    x = F.get("s", F.lit(1))
    changed = elements.set_attribute(elements.set_attribute(x, "type", "b"), "a", "1")
    get = lambda e, name: elements.get_attribute(e, name)
    pairs = F.array_sort(F.transform(F.map_entries(elements.attribute_map(elements.set_attribute(x, "a", "1"))), lambda e: F.concat(e["key"], F.lit("="), e["value"])))
    kinds = lambda seg: F.array_join(F.transform(seg, lambda c: c["kind"]), ",")
    return rows.select(
        "doc_id", F.concat_ws("|", get(changed, "i"), get(changed, "type"), get(changed, "x")).alias("set"), get(elements.delete_attribute(x, "mine"), "mine").alias("gone"), F.array_join(pairs, ",").alias("map"),
        elements.get_text(elements.set_text(F.col("s"), 6, "new"), 6).alias("text"), elements.get_tail(elements.set_tail(F.col("s"), 8, " and "), 8).alias("tail"),
        kinds(elements.iter_children(elements.append_child(F.col("s"), F.array(elements.create_element("sub", type="t"))))).alias("kinds"), kinds(elements.iter_children(F.col("s"), 8, "hi")).alias("inner_kinds"),
        F.size(elements.iter_children(elements.clear(F.col("s"), 8), 8)).alias("emptied"),
    )


@query("""SELECT page_id, CASE page_id % 3 WHEN 0 THEN '{urn:a}p' WHEN 1 THEN 'a:p' ELSE 'p' END || page_id AS name, 'p' || page_id AS local, CASE WHEN page_id % 3 < 2 THEN '{urn:a}' ELSE '' END || 'p' || page_id AS qualified,
CASE WHEN page_id % 3 < 2 THEN 'a:' ELSE '' END || 'p' || page_id AS prefixed FROM pages""")
def name_notations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names in each notation, by a catalog from which other prefixes were dropped."""
    catalog = names.Catalog({"b": "urn:a", "c": "urn:c", "d": "urn:c"})
    catalog.drop_prefix("b")
    catalog.drop_uri("urn:c")
    catalog.gather(b'<r xmlns:a="urn:a"/>')
    k = F.col("page_id") % 3
    name = F.concat(F.when(k == 0, "{urn:a}p").when(k == 1, "a:p").otherwise("p"), F.col("page_id").cast("string"))
    return table(spark, sf_dir, "pages").select("page_id", name.alias("name")).select("page_id", "name", *(catalog.shown(F.col("name"), n).alias(n) for n in ("local", "qualified", "prefixed")))


@query("""WITH forms(form, ok) AS (VALUES ('http://u#:p@h/', true), ('http://h:#/', true), ('http://h:x#/', false), ('http://[::1]:#/', true), ('http://[::1/#', false), ('http://[v1.a:#]/', true), ('http://u@v@h/#', false),
('urn:#', true), ('1urn:#', false), ('http://h/%4#', NULL), ('http://h/%zz#', false), ('http://h/a b#', false), ('mailto:a#@b', true), ('//h/#', false), ('http://h?q=#&r', true), ('http://h#f#', NULL))
SELECT p_partkey, replace(form, '#', p_partkey::VARCHAR) AS uri, ok FROM part, forms WHERE ok IS NOT NULL""")
def uri_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User parts, ports, addresses in brackets, escapes and schemes, valid and not."""
    forms = ("http://u#:p@h/", "http://h:#/", "http://h:x#/", "http://[::1]:#/", "http://[::1/#", "http://[v1.a:#]/", "http://u@v@h/#", "urn:#", "1urn:#", "http://h/%zz#", "http://h/a b#", "mailto:a#@b", "//h/#", "http://h?q=#&r")
    rows = table(spark, sf_dir, "part").select("p_partkey", F.explode(F.array(*map(F.lit, forms))).alias("form"))
    return rows.select("p_partkey", F.replace("form", F.lit("#"), F.col("p_partkey").cast("string")).alias("uri")).withColumn("ok", uris.is_uri(F.col("uri")))


@query("SELECT doc_id, list_filter(string_split(text, chr(10)), lambda t: regexp_matches(t, '[\\p{L}\\p{N}_]{12}'))[1] AS long, len(regexp_extract_all(text, '[0-9]+'))::INTEGER AS numbers, array_to_string(list_transform(regexp_extract_all(text, '[0-9]+'), lambda m: m[1]), '') AS first FROM documents")
def unicode_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes of letters beyond ASCII; a factory that sees the groups of a match."""
    rows = virtual.lines(spark, sf_dir)
    made = transform.promote_match(F.col("segment"), r"(?P<the_first>[0-9])[0-9]*", lambda m, group: transform.node_with_text("ph", group("the_first"), type=m))
    inner = F.transform(F.filter("made", lambda x: x["depth"] == 1), lambda x: x["text"])
    return rows.select("doc_id", text.find(F.col("segment"), r"\w{12}").alias("long"), made.alias("made")).select("doc_id", "long", F.size(inner).alias("numbers"), F.array_join(inner, "").alias("first"))


@query("SELECT doc_id, lang IN ('de', 'en', 'es', 'fr') AS known, CASE doc_id % 3 WHEN 0 THEN 'block' WHEN 1 THEN 'sentence' END AS segtype, CASE WHEN doc_id % 2 = 0 THEN 'utf-8' END AS encoding FROM documents")
def enum_coercion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Enumerations, encodings and languages: inadmissible values become null."""
    k, e = F.col("doc_id") % 3, F.col("doc_id") % 2
    unit = build.unit(segmentation_type=F.when(k == 0, "block").when(k == 1, "sentence").otherwise("verse"), original_encoding=F.when(e == 0, "utf-8").otherwise("klingon"))
    rows = table(spark, sf_dir, "documents").select("doc_id", F.col("lang").isin("de", "en", "es", "fr").alias("known"), unit.alias("u"))
    return rows.select("doc_id", "known", F.col("u.segmentation_type").alias("segtype"), F.col("u.original_encoding").alias("encoding"))

"""Personal data by weak supervision.

Regular expressions propose spans. Five labelers vote on each: the strictness of
its form, gazetteers, the words before it, its edges and its variety. Expectation
maximisation over the counts of vote patterns estimates how reliable each labeler
is and how likely each pattern is true; a logistic span classifier is trained on
those soft labels and decides on the spans that go beyond the base kinds. Base
spans stay as they are.

Only DataFrame operations run on documents. What reaches the driver are counts of
patterns, at most kinds x 3**5 x 4 x 4 rows, however many documents there are.
"""

from __future__ import annotations

import math
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, materialise, running


class Kind(NamedTuple):
    name: str
    gate: str  #: a cheap expression that every text with a match matches
    pattern: str
    strict: str  #: form of a convincing match
    before: str  #: words that announce one
    against: str  #: words that announce something else


_OCTET = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})"
_LOCAL = "[A-Za-z0-9._%+-]"
#: Base kinds first, in the order of the contract. Quantifiers are possessive where that changes no match, so that long
#: runs are passed once; a match starts where its run starts, or where the match before ended.
KINDS = (
    Kind("email", "@", rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", r"^[A-Za-z0-9][^@]*@.*\.[A-Za-z]{2,}$", r"(?:mail|contact|write|reach|address|kontakt|correo|courriel)", r"(?:commit|git|ssh|scp)"),
    Kind("ip", r"[0-9]\.[0-9]", r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)", r"^(?:[1-9][0-9]?|1[0-9]{2}|2[0-4][0-9]|25[0-5])(?:\.(?:0|[1-9][0-9]{0,2})){3}$", r"(?:\bip\b|host|server|address|addr|from|client)", r"(?:version|release|section|chapter|\bv)"),
    Kind("card", r"[0-9](?:[ -]?[0-9]){11}", r"[0-9](?:[ -]?[0-9])++", r"^(?:4|5[1-5]|2[2-7]|3[47]|6)[0-9 -]+$", r"(?:card|visa|master|amex|credit|debit|karte|carte|tarjeta)", r"(?:order|isbn|serial|tracking|part|invoice)"),
    Kind("phone", r"\+[0-9]", r"\+[0-9][\x20().0-9-]+[0-9]", r"^\+[1-9][0-9]{0,2}[ (.-]", r"(?:phone|tel|call|mobile|fax|cell|whatsapp|anruf)", r"(?:sum|plus|score|offset)"),
    Kind("secret", r"(?i)(?:token|secret|passw|passwd|api.?key|access.?key|private.?key)", r"(?i)\b(?:(?:api|access|private|auth|secret)[ _-]?)?(?:token|secret|password|passwd|key)[ ]?[:=][ ]?[\x22']?[A-Za-z0-9+/_=-]{12,}[\x22']?", r"[A-Za-z0-9+/_=-]*[0-9][A-Za-z0-9+/_=-]{15,}[\x22']?$", r"(?:login|account|credential|config|export|set)", r"(?:example|placeholder|your|xxxx)"),
    Kind("ssn", r"[0-9]{3}-[0-9]{2}-[0-9]{4}", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", r"^(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}$", r"(?:ssn|social|security)", r"(?:part|serial|order|code)"),
    Kind("iban", r"[A-Z]{2}[0-9]{2} ?[A-Z0-9]{4}", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])", r"^(?:AT|BE|CH|CY|CZ|DE|DK|EE|ES|FI|FR|GB|GR|HR|HU|IE|IT|LT|LU|LV|MT|NL|NO|PL|PT|RO|SE|SI|SK)[0-9]{2}", r"(?:iban|account|bank|konto|cuenta|compte)", r"(?:part|serial|order|code)"),
    Kind("mac", r"[0-9A-Fa-f]{2}[:-][0-9A-Fa-f]{2}[:-]", r"(?<![0-9A-Za-z:-])[0-9A-Fa-f]{2}(?:([:-])[0-9A-Fa-f]{2})(?:\1[0-9A-Fa-f]{2}){4}(?![0-9A-Za-z:-])", r"[0-9]", r"(?:mac|ether|hardware|device|wlan|wifi)", r"(?:hash|finger|digest)"),
    Kind("local_phone", r"[0-9]{3}[ .-][0-9]{4}", r"(?<![0-9+().-])(?:\([0-9]{3}\) ?|[0-9]{3}[.-])[0-9]{3}[.-][0-9]{4}(?![0-9-])", r"^\(?[2-9]", r"(?:phone|tel|call|mobile|fax|cell)", r"(?:part|serial|order|code|isbn)"),
)
BASE = 4
#: Top-level domains and calling codes that the gazetteer labeler knows.
DOMAINS = "com org net edu gov mil int info io de fr es it uk eu nl be ch at se no dk fi pl pt ie us ca au nz jp in br mx"
CALLING = "1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 94 98"
_CANDIDATE = "array<struct<kind:int,start:long,end:long,valid:boolean,v0:int,v1:int,v2:int,v3:int,v4:int,size:int,digits:int>>"


def _places(pieces: Column, found: Column) -> Column:
    """Each match, from the matches and the pieces between them, with its place in code points, the forty characters before and the one after it."""

    def one(ends: Column):
        def own(m: Column, k: Column) -> Column:
            last = F.get(ends, k)
            return F.struct((last - F.length(m)).alias("start"), last.alias("end"), m.alias("text"), F.right(F.get(pieces, k), F.lit(40)).alias("before"), F.left(F.get(pieces, k + 1), F.lit(1)).alias("after"))

        return own

    lengths = F.zip_with(F.slice(pieces, F.lit(1), F.size(found)), found, lambda p, m: (F.length(p) + F.length(m)).cast("long"))
    return let(running(lengths, lambda x, y: x + y), lambda ends: F.transform(found, one(ends)))


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]+", "")


def _luhn(digits: Column) -> Column:
    def step(total, i):
        d = F.substring(digits, F.length(digits) - i + 1, F.lit(1)).cast("int")
        return total + F.when(i % 2 == 1, d).otherwise(d * 2 - F.when(d > 4, 9).otherwise(0))

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), step) % 10 == 0


def _by_kind(kind: Column, values: dict[int, Column], otherwise: Column) -> Column:
    """The value of a kind; only that one is computed."""
    (first, value), *rest = values.items()
    out = F.when(kind == first, value)
    for k, value in rest:
        out = out.when(kind == k, value)
    return out.otherwise(otherwise)


def _valid(kind: Column, text: Column) -> Column:
    """The contract's test of a base match; other kinds have none."""
    digits = _digits(text)
    tests = {
        1: text.rlike(rf"^{_OCTET}(?:\.{_OCTET}){{3}}$"),
        2: let(digits, lambda d: F.when(F.length(d).between(12, 19), _luhn(d)).otherwise(False)),
        3: F.length(digits).between(9, 15),
    }
    return _by_kind(kind, tests, F.lit(True))


def _votes(kind: Column, x: Column) -> list[Column]:
    """1 for, -1 against, 0 no opinion: form, gazetteer, context, edges, variety."""
    text, before, no = x["text"], F.lower(x["before"]), F.lit(False)
    known = {
        0: F.lower(F.regexp_extract(text, r"\.([A-Za-z0-9-]+)$", 1)).isin(DOMAINS.split()),
        1: text.rlike(r"^(?:10|127|169\.254|192\.168|172\.(?:1[6-9]|2[0-9]|3[01]))\."),
        2: _digits(text).rlike(r"^(?:4[0-9]{12}(?:[0-9]{3})?|5[1-5][0-9]{14}|3[47][0-9]{13}|6(?:011|5[0-9]{2})[0-9]{12})$"),
        3: text.rlike(rf"^\+(?:{'|'.join(CALLING.split())})"),
        4: text.rlike(r"(?i)^(?:(?:api|access|private|auth|secret)[ _-]?)?(?:token|secret|password|passwd|key)"),
    }
    said = lambda which: _by_kind(kind, {k: before.rlike(getattr(own, which)) for k, own in enumerate(KINDS)}, no)
    return [
        F.when(_by_kind(kind, {k: text.rlike(own.strict) for k, own in enumerate(KINDS)}, no), 1).otherwise(-1),
        F.when(_by_kind(kind, known, no), 1).otherwise(0),
        F.when(said("before"), 1).when(said("against"), -1).otherwise(0),
        F.when(before.rlike(r"[0-9A-Za-z]$") | x["after"].rlike("[0-9A-Za-z]"), -1).otherwise(1),
        F.when(_digits(text).rlike(r"^([0-9])\1{5,}$"), -1).otherwise(0),
    ]


def _described(kind: Column):
    def one(x: Column) -> Column:
        n, d = F.length(x["text"]), F.length(_digits(x["text"]))
        votes = [v.cast("int").alias(f"v{j}") for j, v in enumerate(_votes(kind, x))]
        size = F.when(n < 12, 0).when(n < 20, 1).when(n < 40, 2).otherwise(3)
        place = (kind.alias("kind"), x["start"].alias("start"), x["end"].alias("end"), _valid(kind, x["text"]).alias("valid"))
        return F.struct(*place, *votes, size.alias("size"), F.floor(d * 3 / n).cast("int").alias("digits"))

    return one


def candidates(text: Column) -> Column:
    """Every proposed span of a text, by kind, with its votes and features."""
    hits = []
    for k, kind in enumerate(KINDS):
        gate = F.contains(text, F.lit(kind.gate)) if kind.gate == "@" else text.rlike(kind.gate)
        cut = F.struct(F.lit(k).alias("kind"), F.split(text, kind.pattern, -1).alias("pieces"), F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0)).alias("found"))
        hits.append(F.when(gate, cut))
    found = F.filter(F.array(*hits), lambda h: h.isNotNull())
    return F.flatten(F.transform(found, lambda h: F.transform(_places(h["pieces"], h["found"]), _described(h["kind"])))).cast(_CANDIDATE)


_FEATURES = ("kind", "v0", "v1", "v2", "v3", "v4", "size", "digits")


class Model(NamedTuple):
    """Reliabilities of the labelers and weights of the span classifier, by feature and value."""

    reliability: dict[str, float]
    weights: dict[tuple[str, int], float]
    bias: float


def estimate(patterns: list[tuple[dict[str, int], int]], rounds: int = 25, steps: int = 300) -> Model:
    """EM over counted vote patterns, then the classifier on the soft labels; ``patterns`` are (features, count)."""
    votes = [f for f in _FEATURES if f.startswith("v")]
    belief = [1 / (1 + math.exp(-sum(p[v] for v in votes))) for p, _ in patterns]
    rate: dict[tuple[str, int, int], float] = {}
    for _ in range(rounds):
        mass = {y: 1.0 for y in (0, 1)}
        seen = {(v, x, y): 1.0 for v in votes for x in (-1, 0, 1) for y in (0, 1)}
        kinds: dict[int, list[float]] = {}
        for (p, n), b in zip(patterns, belief):
            own = kinds.setdefault(p["kind"], [1.0, 1.0])
            for y, share in ((1, b), (0, 1 - b)):
                mass[y] += n * share
                own[y] += n * share
                for v in votes:
                    seen[v, p[v], y] += n * share
        rate = {key: c / (mass[key[2]] + 2) for key, c in seen.items()}
        for i, (p, _) in enumerate(patterns):
            own = kinds[p["kind"]]
            odds = math.log(own[1] / own[0]) + sum(math.log(rate[v, p[v], 1] / rate[v, p[v], 0]) for v in votes)
            belief[i] = 1 / (1 + math.exp(-max(-30.0, min(30.0, odds))))
    weights, bias, total = {}, 0.0, sum(n for _, n in patterns) or 1
    for _ in range(steps):
        slope, lean = {}, 0.0
        for (p, n), b in zip(patterns, belief):
            z = bias + sum(weights.get((f, p[f]), 0.0) for f in _FEATURES)
            miss = (b - 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))) * n / total
            lean += miss
            for f in _FEATURES:
                slope[f, p[f]] = slope.get((f, p[f]), 0.0) + miss
        bias += lean
        for key, g in slope.items():
            weights[key] = weights.get(key, 0.0) * (1 - 1e-4) + g
    trust = {v: rate[v, 1, 1] / (rate[v, 1, 1] + rate[v, 1, 0]) if rate else 0.5 for v in votes}
    return Model(trust, weights, bias)


def fit(docs: DataFrame, text_col: str = "text") -> Model:
    """The model of all candidates of all documents."""
    return _fitted(docs.select(candidates(F.coalesce(F.col(text_col).cast("string"), F.lit(""))).alias("every")))


def _fitted(rows: DataFrame) -> Model:
    """The model of rows with their candidates in ``every``."""
    counted = rows.select(F.explode("every").alias("c")).groupBy(*(F.col(f"c.{f}").alias(f) for f in _FEATURES), F.col("c.valid").alias("valid")).count()
    rows = counted.orderBy(*_FEATURES, "valid").collect()  # bounded by the number of patterns
    return estimate([({f: r[f] if f != "v0" or r["valid"] else -1 for f in _FEATURES}, r["count"]) for r in rows])


def _marked(rows: DataFrame, model: Model | None) -> tuple[DataFrame, Model]:
    """Rows with their candidates, and the model; where it must be fitted first, the candidates are written once and read twice."""
    if model is None:
        rows = materialise(rows, "candidates")
        model = _fitted(rows)
    return rows, model


def _blocked(base: Column, extra: Column) -> Column:
    """The extra spans that overlap neither a base span nor a proposed extra span of an earlier kind.

    Starts of all spans and ends of the extra ones are sorted together; a running maximum, by kind, of the ends of the
    spans begun so far tells at each extra span's end whether one of them reaches beyond its start.
    """
    levels = range(BASE - 1, len(KINDS))
    long = lambda x: F.lit(x).cast("long") if isinstance(x, int) else x

    def event(place, opens, x, own):
        reach = (F.when(own == k, x["end"]).otherwise(long(-1)).alias(f"r{k}") if opens else long(-1).alias(f"r{k}") for k in levels)
        return F.struct(place.alias("at"), F.lit(int(opens)).alias("opens"), own.cast("int").alias("kind"), x["start"].alias("start"), F.struct(*reach).alias("reach"))

    begun = F.concat(F.transform(base, lambda x: event(x["start"], True, x, F.lit(BASE - 1))), F.transform(extra, lambda x: event(x["start"], True, x, x["kind"])))
    events = F.array_sort(F.concat(begun, F.transform(extra, lambda x: event(x["end"], False, x, x["kind"]))))

    def clear(events: Column) -> Column:
        reach = running(F.transform(events, lambda e: e["reach"]), lambda a, b: F.struct(*(F.greatest(a[f"r{k}"], b[f"r{k}"]).alias(f"r{k}") for k in levels)))

        def free(e: Column, r: Column) -> Column:
            before = F.greatest(*(F.when(e["kind"] > k, r[f"r{k}"]).otherwise(long(-1)) for k in levels))
            return F.when((e["opens"] == 0) & (before <= e["start"]), F.struct(e["start"].alias("start"), e["kind"].alias("kind"), e["at"].alias("end")))

        return F.filter(F.zip_with(events, reach, free), lambda x: x.isNotNull())

    return let(events, clear)


def _accepted(every: Column, model: Model) -> Column:
    """Base spans that hold, and the spans beyond them that the classifier takes and that overlap no other."""
    weight = lambda f, x: F.coalesce(F.element_at(F.create_map(*(F.lit(v) for (g, value), w in sorted(model.weights.items()) if g == f for v in (value, w))), x), F.lit(0.0)) if any(g == f for g, _ in model.weights) else F.lit(0.0)
    score = lambda x: sum((weight(f, x[f]) for f in _FEATURES), F.lit(model.bias))
    span = lambda x: F.struct(x["start"].alias("start"), x["kind"].alias("kind"), x["end"].alias("end"))

    def choose(base: Column, extra: Column) -> Column:
        none = F.array().cast("array<struct<start:long,kind:int,end:long>>")
        return F.array_sort(F.concat(F.transform(base, span), F.when(F.size(extra) > 0, _blocked(base, extra)).otherwise(none)))

    extra = F.filter(every, lambda x: (x["kind"] >= BASE) & (score(x) >= 0))
    return let(F.filter(every, lambda x: (x["kind"] < BASE) & x["valid"]), lambda base: let(extra, lambda own: choose(base, own)))


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: Model | None = None, carry: list[str] | None = None) -> DataFrame:
    """One row per input row: ``doc_id``, ``spans`` (start, kind, end; sorted) and the ``carry`` columns.

    Places count code points, ``end`` is exclusive. The model is fitted on ``docs`` unless given. Null text is empty and
    has no spans; null ids and repeated rows are treated like any other. No columns but those named are read. Work grows
    with the text and, but for a logarithm, with its matches.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), candidates(text).alias("every"), F.struct(F.lit(0).alias("_"), *(F.col(c) for c in carry or ())).alias("row"))
    rows, model = _marked(rows, model)
    return rows.select("doc_id", _accepted(F.col("every"), model).alias("spans"), *(F.col(f"row.`{c}`").alias(c) for c in carry or ()))


def listed(spans: Column) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    names = F.array(*(F.lit(k.name) for k in KINDS))
    return F.array_join(F.transform(spans, lambda x: F.concat(F.element_at(names, x["kind"] + 1), F.lit(":"), x["start"].cast("string"), F.lit(":"), x["end"].cast("string"))), ",")


#: Code points of a block that a text is cut into, so that a place in it is found without passing the whole text.
_BLOCK = 256


def _between(blocks: Column, start: Column, end: Column) -> Column:
    """Code points ``start`` to ``end`` of a text cut into blocks."""
    a, b = F.floor(start / _BLOCK).cast("int"), F.floor(end / _BLOCK).cast("int")
    part = lambda block, x, n: F.substring(F.coalesce(F.get(blocks, block), F.lit("")), x.cast("int"), n.cast("int"))
    inner = F.array_join(F.slice(blocks, a + 2, F.greatest(b - a - 1, F.lit(0))), "")
    return F.when(a == b, part(a, start % _BLOCK + 1, end - start)).otherwise(F.concat(part(a, start % _BLOCK + 1, F.lit(_BLOCK)), inner, part(b, F.lit(1), end % _BLOCK)))


def redact(docs: DataFrame, text_col: str = "text", model: Model | None = None) -> DataFrame:
    """The same columns; each span of the text replaced by its kind in brackets. Null text stays null. Spans that overlap are replaced as one, by the kind of the first."""
    names = F.array(*(F.lit(f"[{k.name.upper()}]") for k in KINDS))
    own = F.col(text_col).cast("string")
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), own.alias("body"), candidates(F.coalesce(own, F.lit(""))).alias("every"))
    if model is None:
        rows, model = _marked(rows.drop("body"), None)
        rows = rows.withColumn("body", F.col(f"row.`{text_col}`").cast("string"))
    text = F.col("body")

    def rebuilt(spans: Column) -> Column:
        reach = running(F.transform(spans, lambda x: x["end"]), lambda a, b: F.greatest(a, b))

        def written(reach: Column, blocks: Column) -> Column:
            firsts = F.filter(F.transform(spans, lambda x, k: F.when((k == 0) | (x["start"] >= F.get(reach, k - 1)), k)), lambda k: k.isNotNull())

            def joined(firsts: Column) -> Column:
                before = lambda k: F.when(k > 0, F.get(reach, k - 1)).otherwise(F.lit(0).cast("long"))
                parts = F.transform(firsts, lambda k: F.concat(_between(blocks, before(k), F.get(spans, k)["start"]), F.element_at(names, F.get(spans, k)["kind"] + 1)))
                return F.concat(F.array_join(parts, ""), _between(blocks, F.element_at(reach, -1), F.length(text).cast("long")))

            return let(firsts, joined)

        blocks = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{_BLOCK}}}"), F.lit(0))
        return F.when(F.size(spans) > 0, let(reach, lambda r: let(blocks, lambda b: written(r, b)))).otherwise(text)

    clean = let(_accepted(F.col("every"), model), rebuilt)
    out = rows.select("row", F.when(text.isNotNull(), clean).alias("clean"))
    return out.select(*((F.col("clean") if c == text_col else F.col(f"row.`{c}`")).alias(c) for c in docs.columns))

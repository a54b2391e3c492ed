"""Each operator against a brute-force version, on small tables with nulls, empty texts, ties, repeated rows and extra columns."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftline.llm import language_id, license_scan, mixing, packing, pii, quality, simhash, sketch, substring_dedup, tokenhash, topk
from weftline.llm.license_rules import rules

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def prose(seed: int, n: int) -> str:
    rng = random.Random(seed)
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 6))) for _ in range(n))


@pytest.fixture(scope="module")
def docs(spark):
    shared = prose(0, 40)
    rows = [(k, prose(k, 30 + k), "en", f"s{k % 3}") for k in range(1, 25)]
    rows += [(100, prose(100, 20) + " " + shared + "\n" + prose(101, 20), "en", "s0"), (101, shared, "en", "s1"), (102, prose(3, 33), "en", None), (103, prose(3, 33) + " tail", None, "s1")]
    rows += [(104, None, "en", "s2"), (105, "", "en", "s2"), (None, shared, "en", "s0"), (None, None, None, None), (106, "12 34 !!", "en", "s2"), (5, prose(5, 35), "en", "s2"), (107, "one", "en", "s0")]
    rows += [(108, "x " * 30000, "en", "s0")]
    return spark.createDataFrame([(*r, None if r[1] is None else len(r[1])) for r in rows], DOCS)


@pytest.fixture(scope="module")
def clash(docs):
    """Extra columns whose names the operators use inside."""
    return docs.select("*", *(F.lit(1).alias(c) for c in ("uid", "kind", "size", "key", "row", "next", "range", "bits", "home", "src", "block", "spans", "k1", "hashes")))


def none(spark):
    return spark.createDataFrame([], DOCS)


def test_substring_dedup(spark, docs, clash):
    rows = docs.collect()
    words = [(r.text or "").encode().split() for r in rows]
    low: dict = {}
    for r, w in zip(rows, words):
        if r.doc_id is not None:
            for i in range(len(w) - 12):
                k = tuple(w[i : i + 13])
                low[k] = min(low.get(k, r.doc_id), r.doc_id)
    want = []
    for r, w in zip(rows, words):
        gone = {j for i in range(len(w) - 12) if r.doc_id is not None and low[tuple(w[i : i + 13])] < r.doc_id for j in range(i, i + 13)}
        want.append((r.doc_id, len(w), len(gone), b" ".join(x for j, x in enumerate(w) if j not in gone).decode()))
    for df in (docs, clash.repartition(5)):
        got = [(r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in substring_dedup.dedup_substrings(df, combine=500).collect()]
        assert Counter(got) == Counter(want)
    assert sum(n for _, _, n, _ in want) > 50
    assert substring_dedup.dedup_substrings(none(spark)).count() == 0


def test_words_that_only_a_polynomial_confuses_are_told_apart(spark):
    one, two = "a", "b"
    for _ in range(10):
        one, two = one + two, two + one  # a Thue-Morse sequence and its complement: equal modulo 2**64 for every base
    shared = prose(1, 12)
    df = spark.createDataFrame([(1, f"{shared} {one}"), (2, f"{shared} {two}"), (3, f"{shared} {one}")], "doc_id long, text string")
    assert {r.doc_id: r.n_removed for r in substring_dedup.dedup_substrings(df).collect()} == {1: 0, 2: 0, 3: 13}


def test_window_hashes_are_polynomials_modulo_the_prime():
    words = tokenhash.word_hashes(" ".join(prose(5, 400).split()).encode())
    for size in (1, 2, 3, 5, 13, 31):
        want = [sum(int(w) % tokenhash.PRIME * pow(tokenhash.BASE, j, tokenhash.PRIME) for j, w in enumerate(words[i : i + size])) % tokenhash.PRIME for i in range(len(words) - size + 1)]
        assert (tokenhash.window_hashes(words, size) == tokenhash.mix(np.array(want, np.uint64))).all()


def test_substring_dedup_where_an_id_and_a_passage_repeat(spark):
    passage = prose(7, 15)
    rows = [(5 if k % 2 else k, f"{prose(k % 20, 10)} {passage} {prose(k, 3)}") for k in range(300)] + [(None, passage)] * 50
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    low: dict = {}
    for d, t in rows:
        w = t.split()
        for i in range(len(w) - 12):
            if d is not None:
                low[tuple(w[i : i + 13])] = min(low.get(tuple(w[i : i + 13]), d), d)
    want = Counter()
    for d, t in rows:
        w = t.split()
        gone = {j for i in range(len(w) - 12) if d is not None and low[tuple(w[i : i + 13])] < d for j in range(i, i + 13)}
        want[d, " ".join(x for j, x in enumerate(w) if j not in gone)] += 1
    for combine in (100, 1_000_000):
        assert Counter((r.doc_id, r.kept_text) for r in substring_dedup.dedup_substrings(df, combine=combine).collect()) == want


def test_window_hashes_are_of_windows():
    words = [b"a", b"bb", b"a", b"bb", b"a", b"c"]
    h = tokenhash.window_hashes(tokenhash.word_hashes(b" ".join(words)), 2)
    assert h[0] == h[2] and h[1] == h[3] and len(set(h.tolist())) == 3
    assert len(tokenhash.window_hashes(tokenhash.word_hashes(b"a b"), 3)) == 0


def test_masks_cover_every_pair_within_the_radius():
    masks = [m & (2**64 - 1) for m in simhash.masks()]
    assert len(masks) == 7
    for a in range(64):
        for b in range(a, 64):
            diff = 1 << a | 1 << b
            assert any(diff & m == 0 for m in masks)


def components(bits: list[int]) -> list[int]:
    root = list(range(len(bits)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(bits)):
        for j in range(i):
            if (bits[i] ^ bits[j]).bit_count() <= 2:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(bits))]


def test_links_and_components_of_crowded_fingerprints(spark):
    rng = random.Random(4)
    bits = [0]
    while len(bits) < 300:  # chains and clusters
        x = rng.choice(bits) if rng.random() < 0.8 else rng.getrandbits(64)
        for _ in range(rng.randint(1, 3)):
            x ^= 1 << rng.randrange(64)
        if x not in bits:
            bits.append(x)
    signed = [b - 2**64 if b >> 63 else b for b in bits]
    found = dict(simhash.components(simhash.links(spark.createDataFrame([(s,) for s in signed], "bits long"))).collect())
    want = components(bits)
    groups = lambda keys: sorted(sorted(g) for g in keys.values())
    a, b = defaultdict(list), defaultdict(list)
    for s, w in zip(signed, want):
        a[found.get(s, s)].append(s)
        b[w].append(s)
    assert groups(a) == groups(b)


def test_simhash(spark, docs, clash):
    import xxhash

    rows = [r for r in docs.collect()]
    bits = []
    for r in rows:
        w = (r.text or "").encode().lower().split()
        h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 3]), seed=42) for i in range(max(1, len(w) - 2))] if w else []
        bits.append(sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)))
    root = components(bits)
    low = defaultdict(list)
    for r, k in zip(rows, root):
        if r.doc_id is not None:
            low[k].append(r.doc_id)
    want = Counter((r.doc_id, b, min(low[k], default=None)) for r, b, k in zip(rows, bits, root))
    for df in (docs, clash):
        assert Counter((r.doc_id, r.bits & (2**64 - 1), r.component_id) for r in simhash.near_duplicates(df).collect()) == want
    assert simhash.near_duplicates(none(spark)).count() == 0


def test_license_scan(spark, clash):
    texts = ["Under the MIT License. x under the mit license", "Licensed under the Apache License, Version 2.0.", "CC BY-NC 4.0 cc by nc", "SPDX-License-Identifier: GPL-3.0-or-later", "no license", "", None, "É under the MİT license", "GNU General Public License, version 3 " * 50]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)] + [(0, texts[0])], "doc_id long, text string").withColumn("uid", F.lit(1)).withColumn("start", F.lit(1))
    listed = [(r, re.compile(f"(?<= )(?:{r.pattern})(?= )")) for r in rules()]
    got = Counter()
    for r in license_scan.scan(df).collect():
        got[r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels, r.score] += 1
    want = Counter()
    for k, t in [*enumerate(texts), (0, texts[0])]:
        w = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        line = f" {' '.join(w)} "
        hits = [(line[: m.start()].count(" ") - 1, line[: m.end()].count(" "), r) for r, p in listed if r.keyword in line for m in p.finditer(line)]
        better = lambda e, h: e[2].priority <= h[2].priority and ((e[0], e[1]) != (h[0], h[1]) or (e[2].priority, e[2].rank) < (h[2].priority, h[2].rank))
        kept = [h for h in hits if h[2].base or not any(not e[2].base and e is not h and e[0] <= h[0] and e[1] >= h[1] and better(e, h) for e in hits)]
        base = [h for h in hits if h[2].base]
        names = lambda hs: ",".join(sorted({h[2].label for h in hs}))
        want[k, len(w), len(base), min((h[0] for h in base), default=None), max((h[0] for h in base), default=None), names(base), names(kept), max((h[2].confidence for h in kept), default=0.0)] += 1
    assert got == want
    assert len(rules()) > 300
    assert license_scan.scan(none(spark)).count() == 0
    assert license_scan.scan(clash).count() == clash.count()


def luhn(d: str) -> bool:
    return sum(int(c) if i % 2 == 0 else int(c) * 2 - 9 * (int(c) > 4) for i, c in enumerate(reversed(d))) % 10 == 0


def base_spans(t: str):
    digits = lambda m: re.sub("[^0-9]", "", m[0])
    tests = (
        (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m[0].split("."))),
        (r"[0-9]([\x20-]?[0-9])+", lambda m: 12 <= len(digits(m)) <= 19 and luhn(digits(m))),
        (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(digits(m)) <= 15),
    )
    return sorted((m.start(), k, m.end()) for k, (p, ok) in enumerate(tests) for m in re.finditer(p, t) if ok(m))


PRIVATE = [
    "mail a.b@c.de, or x@y.z_q@w.v. 😀 +1 (017) 555-7713 now", "1.2.3.4.5.6.7.8 and 300.1.1.1 001.02.3.255", "4111 1111 1111 1111 or 4111-1111-1111-1112, 79927398713 0000000000000000", "", None,
    'é token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff" end', "@a.b a@b a@b. a@@b.c %+@x.y", "+49 30 1234567 8 9 + 1 +1()2", "clean words only", "call (415) 555-2671 or 078-05-1120",
]


def test_pii(spark, clash):
    df = spark.createDataFrame(list(enumerate(PRIVATE)) + [(0, PRIVATE[0])], "doc_id long, text string")
    model = pii.fit(df)
    for r in pii.find(df, model=model).collect():
        got = [(s.start, s.kind, s.end) for s in r.spans]
        assert [s for s in got if s[1] < pii.BASE] == base_spans(PRIVATE[r.doc_id] or ""), PRIVATE[r.doc_id]
    clean = {r.doc_id: r.text for r in pii.redact(df, model=model).collect()}
    assert clean[0].startswith("mail [EMAIL], or ") and clean[0].endswith("😀 [PHONE] now") and clean[4] is None and clean[8] == PRIVATE[8]
    assert "24be" not in clean[5]
    assert pii.find(none(spark)).count() == 0 and pii.redact(clash).columns == clash.columns


def test_pii_on_long_runs(spark):
    long = ["a" * 200_000, "1" * 200_000, "1 " * 100_000, "a." * 100_000 + "@b.c", "x@" + "b." * 50_000 + "c"]
    rows = {r.doc_id: r.spans for r in pii.find(spark.createDataFrame(list(enumerate(long)), "doc_id long, text string"), model=pii.Model({}, {}, 0.0)).collect()}
    assert [len(rows[k]) for k in range(5)] == [0, 0, 0, 1, 1]


def test_pii_work_grows_with_the_matches_alone(spark):
    import time

    df = spark.createDataFrame([(0, "12345 a " * 125_000), (1, "1.2.3.4 x " * 20_000), (2, "token=abcdefghijkl1234 " * 5_000)], "doc_id long, text string")
    start = time.perf_counter()
    model = pii.Model({}, {}, 0.0)
    rows = {r.doc_id: r.spans for r in pii.find(df, model=model).collect()}
    clean = {r.doc_id: r.text for r in pii.redact(df, model=model).collect()}
    assert time.perf_counter() - start < 60
    assert [len(rows[k]) for k in range(3)] == [0, 20_000, 5_000]
    assert [s.start for s in rows[1]] == list(range(0, 200_000, 10)) and clean[1] == "[IP] x " * 20_000 and clean[2] == "[SECRET] " * 5_000


def test_kinds_beyond_the_base_are_found_where_planted(spark):
    planted = {"ssn": "her social security number is 078-05-1120 on file", "iban": "please pay to the bank account DE89370400440532013000 today", "mac": "the device has mac 00:1A:2B:3C:4D:5E on wlan", "local_phone": "call my phone 415-555-2671 tonight", "secret": "set api_key = 'a8f5f167f44f4964e6c998dee827110c' in config"}
    other = ["part order code 123-45-67890 shipped", "nothing to see here", "release 1.2.3 of chapter 4"]
    df = spark.createDataFrame([(k, t) for k, t in enumerate([*planted.values(), *other] * 40)], "doc_id long, text string")
    got = Counter()
    for r in pii.find(df).collect():
        got[r.doc_id % 8, tuple(pii.KINDS[s.kind].name for s in r.spans)] += 1
    assert got == Counter({**{(k, (name,)): 40 for k, name in enumerate(planted)}, **{(k, ()): 40 for k in (5, 6, 7)}})


def test_overlapping_spans_beyond_the_base(spark):
    rng = random.Random(8)
    rows = []
    for _ in range(60):
        spans = [(rng.randrange(40), rng.randrange(pii.BASE - 1, len(pii.KINDS))) for _ in range(rng.randint(0, 9))]
        rows.append([(a, k, a + rng.randint(1, 8)) for a, k in {s[1]: s for s in spans}.values()])
    df = spark.createDataFrame([(k, [r for r in row if r[1] < pii.BASE], [r for r in row if r[1] >= pii.BASE]) for k, row in enumerate(rows)], "id int, base array<struct<start:long,kind:int,end:long>>, extra array<struct<start:long,kind:int,end:long>>")
    for r in df.select("id", pii._blocked(F.col("base"), F.col("extra")).alias("kept")).collect():
        meets = lambda a, b: a[0] < b[2] and b[0] < a[2]
        want = [x for x in rows[r.id] if x[1] >= pii.BASE and not any(meets(x, o) and o[1] < x[1] for o in rows[r.id])]
        assert sorted(tuple(x) for x in r.kept) == sorted(want)


def test_em_prefers_the_labelers_that_agree():
    votes = lambda *v: {"kind": 0, **{f"v{k}": x for k, x in enumerate(v)}, "size": 0, "digits": 0}
    model = pii.estimate([(votes(1, 1, 1, 1, -1), 50), (votes(-1, -1, -1, -1, -1), 50), (votes(1, 1, 1, 1, 1), 5), (votes(-1, -1, -1, -1, 1), 5)])
    assert model.reliability["v0"] > 0.8 and abs(model.reliability["v4"] - 0.5) < 0.2


def test_packing(spark, docs, clash):
    public = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path = public.path("byte_bpe_50k.json")
    t = Tokenizer.from_file(path)
    odd = ["a <|endoftext|> b", "  two  spaces", "tab\there", "don't can't", "naïve 12½ 漢字\nか", " lead", "trail ", "a\n\nb", "<|endoftext|>"]
    df = docs.unionByName(spark.createDataFrame([(200 + k, x, "en", "s", 1) for k, x in enumerate(odd)], DOCS))
    texts = defaultdict(list)
    for r in df.collect():
        texts[r.doc_id].append([*t.encode(r.text or "", add_special_tokens=False).ids, 0])
    rows = packing.pack(df, path, 64).collect()
    want = Counter()
    for d, own in texts.items():
        for ids in own:
            n, at, piece, size = len(ids), 0, 0, len(ids) if len(ids) <= 64 else len(ids) % 64 or 64
            while at < n:
                cut = ids[at : at + size]
                want[d, piece, at, len(cut), np.array(cut, "<u4").tobytes()] += 1
                at, piece, size = at + size, piece + 1, 64
    assert Counter((r.doc_id, r.piece, r.start, r.length, bytes(r.ids)) for r in rows) == want
    assert all(zlib.crc32(bytes(r.ids)) == r.ids_crc32 for r in rows)
    bins = defaultdict(list)
    for r in rows:
        bins[r.sequence_id].append((r.offset, r.length))
    for own in bins.values():
        at = 0
        for offset, n in sorted(own):
            assert offset == at
            at += n
        assert at <= 64
    assert len(bins) <= 1.05 * -(-sum(r.length for r in rows) // 64) + 1
    assert packing.pack(none(spark), path).count() == 0
    assert packing.pack(clash.limit(3), path).count() >= 3


@pytest.mark.parametrize("lengths", [[1] * 500, [1025] * 9, [2047, 1, 2047, 1], [700] * 7 + [600] * 7, list(range(1, 300)), [5]])
def test_placing(spark, lengths):
    df = spark.createDataFrame(list(enumerate(lengths)), "uid long, length long")
    rows = packing.place(df).collect()
    assert sorted(r.uid for r in rows) == list(range(len(lengths)))
    bins = defaultdict(list)
    for r in rows:
        bins[r.home].append((r.at, lengths[r.uid]))
    for own in bins.values():
        ends = [a + n for a, n in sorted(own)]
        assert [a for a, _ in sorted(own)] == [0, *ends[:-1]] and ends[-1] <= 2048
    free: list[int] = []
    for n in sorted(lengths, reverse=True):
        fit = min((g for g in free if g >= n), default=None)
        if fit is None:
            free.append(2048 - n)
        else:
            free.remove(fit)
            free.append(fit - n)
    assert len(bins) <= len(free) + max(1, len(free) // 50)


def test_topk(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(0, 1, (300, 12))
    x[50:60] = x[49]  # ties
    rows = [(k, v.tolist()) for k, v in enumerate(x)] + [(400, None), (401, [float("nan")] * 12), (402, [None] * 12), (403, [float("inf")] + [0.0] * 11), (404, [0.0] * 12), (405, [1.0] * 4), (7, x[7].tolist()), (None, x[7].tolist())]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("x", F.lit(1)).withColumn("pivot", F.lit(2))
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in topk.search(df, df.where("vec_id % 10 = 0"), 5).collect())
    ints = {k: np.floor(256 * np.array([*v, *[0.0] * (12 - len(v))])).astype(np.int64) for k, v in rows if k is not None and v and None not in v and np.isfinite(v).all()}
    want = []
    for q in sorted(k for k in ints if k % 10 == 0):
        best = sorted((-int(ints[q] @ v), k) for k, v in ints.items() if k != q)[:5]
        want += [(q, i + 1, k, -s) for i, (s, k) in enumerate(best)]
    assert got == want
    assert topk.search(df.where("vec_id < 0"), df, 5).count() == 0 and topk.search(df, df.where("vec_id < 0"), 5).count() == 0
    large = df.select("vec_id", F.transform("embedding", lambda c: c * 1000.0).alias("embedding"))  # beyond 16 bits
    assert topk.search(large, large.where("vec_id % 50 = 0"), 2).count() == 2 * len([k for k in ints if k % 50 == 0])


def test_topk_with_many_blocks_and_pivots(spark, monkeypatch):
    for name, value in (("BLOCK", 16), ("QUERIES", 8), ("PER", 1)):
        monkeypatch.setattr(topk, name, value)
    rng = np.random.default_rng(5)
    centres = rng.normal(0, 3, (12, 8))
    x = centres[rng.integers(0, 12, 900)] + rng.normal(0, 0.2, (900, 8))
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<double>")
    ints = np.floor(256 * x).astype(np.int64)
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in topk.search(df, df.where("vec_id % 7 = 0"), 4).collect())
    want = [(q, i + 1, k, -s) for q in range(0, 900, 7) for i, (s, k) in enumerate(sorted((-int(ints[q] @ ints[k]), k) for k in range(900) if k != q)[:4])]
    assert got == want


def test_quality(spark, clash):
    rng = random.Random(1)
    good, bad = "the river runs over old stones".split(), "!! ### buy $$$ WIN now".split()
    rows = [(k, " ".join(rng.choices(good + (bad if k % 2 else []), k=40)), k % 2) for k in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string, label int")
    labels = df.select("doc_id", (1 - F.col("label")).alias("quality")).unionByName(spark.createDataFrame([(None, 1), (0, 0), (1, None)], "doc_id long, quality int"))
    model = quality.fit(df.where("doc_id < 150"), labels)
    got = {r.doc_id: r.score for r in quality.score(df, model).collect()}
    assert all((got[k] >= 0.5) == (k % 2 == 0) for k in range(150, 200))
    assert all(0 <= r.score <= 1 for r in quality.score(clash, model).collect())
    assert quality.score(none(spark), model).count() == 0
    empty = quality.fit(none(spark), labels)
    assert {r.score for r in quality.score(df, empty).collect()} == {0.5}


def test_fits_are_bounded_by_rows_where_ids_repeat(spark, monkeypatch):
    df = spark.range(3000).select(F.lit(7).cast("long").alias("doc_id"), F.concat(F.lit("the text number "), "id").alias("text"), F.when(F.col("id") % 2 == 0, "aa").otherwise("bb").alias("lang"))
    seen = []
    monkeypatch.setattr(quality, "follow_the_leader", lambda rows: seen.append(len(rows)))
    quality.fit(df, spark.createDataFrame([(7, 1)], "doc_id long, quality int"), sample=50)
    monkeypatch.setattr(language_id.Network, "train", lambda self, text, label: seen.append(len(text)))
    language_id.fit(df, sample=50)
    assert seen == [50, 50]


def test_features_are_of_the_whole_text():
    index, value = quality.features("a b " * 50_000 + "last")
    other, _ = quality.features("a b " * 50_000 + "first")
    assert set(index) != set(other) and abs(float((value**2).sum()) - 1) < 1e-5
    assert len(quality.features(None)[0]) == len(quality.features("")[0]) == 0


def test_gradients_agree_with_differences():
    net = language_id.Network(["a", "b"])
    net.p = {k: w.astype(np.float64) for k, w in net.p.items()}
    rng = np.random.default_rng(0)
    text, label = rng.integers(97, 100, (7, 3)).astype(np.uint8), np.array([0, 1, 1])

    def loss():
        p = net.probabilities(net.states(text).astype(np.float64))
        return -np.log(p[:, np.arange(3), label]).mean()

    g = net.gradients(text, label)
    for k, at in (("x", (0, 98, 3)), ("x", (1, 97, 20)), ("u", (0, 2, 9)), ("u", (1, 5, 18)), ("v", (3, 1)), ("c", (0,))):
        was, step = net.p[k][at], 1e-2
        net.p[k][at] = was + step
        up = loss()
        net.p[k][at] = was - step
        down = loss()
        net.p[k][at] = was
        assert abs((up - down) / (2 * step) - g[k][at]) < 2e-3 * max(1, abs(g[k][at]))


def test_language_id(spark, clash):
    rng = random.Random(2)
    words = {"aa": "der die und nicht sich auf".split(), "bb": "the and with from this that".split(), "cc": "que les dans pour une avec".split()}
    rows = [(k, " ".join(rng.choices(words[lang], k=rng.randint(8, 300))), lang) for k in range(150) for lang in [("aa", "bb", "cc")[k % 3]]]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    net = language_id.fit(df.where("doc_id < 100"))
    got = {r.doc_id: (r.lang_pred, r.score) for r in language_id.predict(df.drop("lang"), net).collect()}
    assert sum(got[k][0] == rows[k][2] for k in range(100, 150)) >= 48
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "12 !!"), (4, "the and with " * 20000)], "doc_id long, text string")
    out = {r.doc_id: (r.lang_pred, r.score) for r in language_id.predict(odd, net).collect()}
    assert out[1] == out[2] == out[3] == ("und", 0.0) and out[4][0] == "bb"
    assert language_id.predict(clash, net, carry=["uid", "spans"]).columns == ["doc_id", "uid", "spans", "lang_pred", "score"]
    assert language_id.predict(none(spark), language_id.fit(none(spark))).count() == 0


def test_sketches(spark, docs, clash):
    hashed = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.xxhash64(F.struct(F.coalesce("text", F.lit("")))).alias("h")).collect()
    rows = [(r.doc_id, r.text) for r in sorted(hashed, key=lambda r: (r.doc_id is None, -(r.doc_id or 0), r.h))]
    want = Counter()
    for k, (d, t) in enumerate(rows):
        after, half = rows[(k + 1) % len(rows)][1], len(t) // 2
        want[d, len(t), t[: len(t) - half] + after[:half]] += 1
    for df in (docs, clash):
        got = sketch.fingerprints(df).collect()
        assert Counter((r.doc_id, r.n_chars, r.edited) for r in got) == want
    same = defaultdict(set)
    for r in got:
        same[r.edited].add((r.edited_sketch.n, tuple(r.edited_sketch.kept)))
    assert all(len(s) == 1 for s in same.values())
    assert sketch.fingerprints(none(spark)).count() == 0
    one = docs.where("doc_id = 1")
    assert sketch.fingerprints(one).first().next_sketch == sketch.fingerprints(one).first().sketch


def test_next_document_where_one_id_or_null_holds_most_rows(spark):
    rows = [(k if k % 3 else 500 if k % 2 else None, f"t{k} " * (k % 4)) for k in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    hashed = df.select("doc_id", "text", F.xxhash64(F.struct("text")).alias("h")).collect()
    order = [(r.doc_id, r.text) for r in sorted(hashed, key=lambda r: (r.doc_id is None, -(r.doc_id or 0), r.h))]
    want = Counter((*r, order[(k + 1) % len(order)][1]) for k, r in enumerate(order))
    out = sketch.with_next(df.select("doc_id", F.struct("text").alias("own")), "doc_id", "own")
    assert Counter((r.doc_id, r.own.text, r.next.text) for r in out.collect()) == want


def test_sketch_estimates_containment_between_unequal_texts(spark):
    small, large = prose(1, 2000), prose(1, 2000) + " " + prose(2, 20000)
    row = spark.createDataFrame([(small, large)], "a string, b string").select(sketch.sketch(F.col("a")).alias("a"), sketch.sketch(F.col("b")).alias("b"))
    a, b = F.col("a"), F.col("b")
    inside, back, like, merged = row.select(sketch.containment(a, b), sketch.containment(b, a), sketch.likeness(a, b), F.size(sketch.merge(a.kept, b.kept)) == F.size(b.kept)).first()
    assert inside > 0.99 and abs(back - 1 / 11) < 0.03 and abs(like - 1 / 11) < 0.03 and merged


def test_redaction_leaves_no_tail_of_overlapping_spans(spark):
    texts = ["at 10.0.0.4 111 1111 1111 1111 end", "pay 4111 1111 1111 1111@mail.com now", "a.b@mail.com 10.0.0.4 x"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = [r.text for r in pii.redact(df).orderBy("doc_id").collect()]
    assert got == ["at [IP] end", "pay [CARD] now", "[EMAIL] [IP] x"]


def test_likeness_of_short_texts_is_the_jaccard_index(spark):
    texts = [f"a{k} b{k} c d e f g h{k % 3}" for k in range(40)] + ["a b", "c d", ""]
    cut = lambda t: {tuple(t.split()[i : i + 5]) for i in range(max(1, len(t.split()) - 4))} if t else set()
    want = {(t, u): (len(cut(t) & cut(u)) / len(cut(t) | cut(u)) if t or u else 1.0) for t in texts for u in texts}
    made = spark.createDataFrame([(t,) for t in texts], "t string").select("t", sketch.sketch(F.col("t")).alias("s"), sketch.sketch(F.col("t"), scale=1 << 40).alias("none"))
    other = made.select(F.col("t").alias("u"), F.col("s").alias("r"), F.col("none").alias("void"))
    got = made.crossJoin(other).select("t", "u", sketch.likeness(F.col("s"), F.col("r")), sketch.likeness(F.col("none"), F.col("void"))).collect()
    assert all(abs(like - want[t, u]) < 1e-9 for t, u, like, _ in got)
    assert all(void == (t == u) for t, u, _, void in got)


def test_mixing(spark, docs, clash):
    rows = mixing.mix(docs).collect()
    assert Counter((r.doc_id, r.source) for r in rows) == Counter((r.doc_id, r.source) for r in docs.collect())
    assert Counter((r.doc_id, r.taken, tuple(r.shards)) for r in mixing.mix(clash.repartition(7)).collect()) == Counter((r.doc_id, r.taken, tuple(r.shards)) for r in rows)
    sizes = defaultdict(int)
    for r in docs.collect():
        sizes[r.source] += len((r.text or "").split())
    order = sorted(sizes, key=lambda s: (s is None, s))
    weight, capped = {s: (3, 1, 2)[k % 3] for k, s in enumerate(order)}, set()
    while True:
        free = [s for s in order if s not in capped]
        level = (1.5 * sum(sizes.values()) - sum(2 * sizes[s] for s in capped)) / sum(weight[s] for s in free)
        over = {s for s in free if weight[s] * level > 2 * sizes[s]}
        if not over:
            break
        capped |= over
    for r in rows:
        assert r.source_size == sizes[r.source] and r.taken == r.copies * r.size <= 2 * r.size and len(r.shards) == r.copies
        assert abs(r.target - (2 * sizes[r.source] if r.source in capped else weight[r.source] * level)) < 1e-6
    assert mixing.mix(none(spark)).count() == 0
    drawn = mixing.draw(clash)
    assert drawn.columns == clash.columns and drawn.count() == sum(r.copies for r in rows)


def test_taken_words_come_near_the_targets(spark):
    rng = random.Random(9)
    df = spark.createDataFrame([(k, "w " * int(rng.lognormvariate(5, 1)), f"s{k % 7}") for k in range(2000)], "doc_id long, text string, source string")
    by = defaultdict(lambda: [0, 0.0])
    for r in mixing.mix(df).collect():
        by[r.source][0] += r.taken
        by[r.source][1] = r.target
    assert all(abs(taken - target) <= 0.005 * target for taken, target in by.values())


def test_taken_words_come_near_the_targets_where_blocks_are_cut_again(spark, monkeypatch):
    monkeypatch.setattr(mixing, "FINE", 20)
    monkeypatch.setattr(mixing, "BLOCKS", 4)
    monkeypatch.setattr(mixing, "SHARD_BLOCKS", 2)
    rng = random.Random(9)
    df = spark.createDataFrame([(k, "w " * int(rng.lognormvariate(4, 1)), f"s{k % 3 if k % 4 else 0}") for k in range(3000)], "doc_id long, text string, source string")
    by = defaultdict(lambda: [0, 0.0])
    rows = mixing.mix(df, levels=1).collect()
    for r in rows:
        assert r.taken == r.copies * r.size <= 2 * r.size and len(r.shards) == r.copies
        by[r.source][0] += r.taken
        by[r.source][1] = r.target
    assert len(rows) == 3000 and all(abs(taken - target) <= 0.005 * target for taken, target in by.values())


def test_splitting_tree_deals_exact_quotas(spark):
    quotas = {"a": 100, "b": 37, "c": 1, "d": 0}
    got = mixing.shard_quotas(spark.createDataFrame(list(quotas.items()), "src string, n long"), 3).collect()
    total, shard = Counter(), Counter()
    for r in got:
        total[r.src] += r.n
        shard[r.shard] += r.n
        assert r.n >= 0
    assert all(total[k] == n for k, n in quotas.items()) and max(shard.values()) - min(shard[k] for k in range(8)) <= 1


def test_sha_of_kept_text_matches_the_contract(spark, docs):
    out = substring_dedup.dedup_substrings(docs).select("kept_text", F.sha2(F.col("kept_text").cast("binary"), 256).alias("h")).collect()
    assert all(hashlib.sha256(r.kept_text.encode()).hexdigest() == r.h for r in out)


def test_substring_dedup_runs_one_python_worker_a_task(spark, docs):
    stages = []

    def most(plan):
        """Python steps on one way through a stage."""
        if "AdaptiveSparkPlan" in plan.getClass().getName():
            return most(plan.initialPlan())
        if "Exchange" in plan.getClass().getName():
            stages.append(most(plan.child()))
            return 0
        below = [plan.children().apply(k) for k in range(plan.children().size())]
        return max((most(p) for p in below), default=0) + ("Arrow" in plan.nodeName())

    stages.append(most(substring_dedup.dedup_substrings(docs)._jdf.queryExecution().executedPlan()))
    assert max(stages) == 1


def test_language_id_holds_little_more_than_the_states():
    import tracemalloc

    net = language_id.Network([f"l{k}" for k in range(8)])
    rng = np.random.default_rng(3)
    texts = [rng.integers(97, 123, 4000, np.uint8).tobytes() for _ in range(100)] + [b"ab"]
    tracemalloc.start()
    got = net.documents(texts)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 1.6 * 2 * (language_id.CORE + 2 * language_id.EDGE) * 1024 * language_id.HIDDEN * 4
    assert np.allclose(got.sum(axis=1), 1, atol=1e-5)
    # one window: the mean of its probabilities
    p = net.probabilities(net.states(np.frombuffer(b"ab", np.uint8)[:, None]))
    assert np.allclose(got[-1], p[:, 0].mean(axis=0), atol=1e-6)


def test_packing_leaves_no_encoder_in_a_worker():
    import gc

    import pyarrow as pa

    public_tokenizers = pytest.importorskip("public_tokenizers")
    run = packing._cut(public_tokenizers.path("byte_bpe_50k.json"), 2048, False, False)
    batch = pa.RecordBatch.from_arrays([pa.array([1]), pa.array(["some words"])], names=["doc_id", "text"])
    assert sum(b.num_rows for b in run(iter([batch]))) == 1
    assert not [x for x in gc.get_objects() if isinstance(x, packing.WordEncoder)]

"""The pipeline's near-copy stage against brute force."""

import random

import numpy as np
import pytest

from weftline.llm import near_copies

pipeline = pytest.importorskip("corpus_pipeline")


def planted(n=40, group=60, seed=7):
    """Texts with near copies of few changed words, and one group of more than a small bucket."""
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(5000)}"
    out = []
    for _ in range(n):
        base = [word() for _ in range(rng.choice((4, 30, 120, 300)))]
        out.append(base)
        for changes in (0, 1, 2, 4, 8):
            copy = list(base)
            for _ in range(changes):
                copy[rng.randrange(len(copy))] = word()
            out.append(copy)
    base = [word() for _ in range(200)]
    for _ in range(group):
        copy = list(base)
        for _ in range(rng.randrange(8)):
            copy[rng.randrange(200)] = word()
        out.append(copy)
    rng.shuffle(out)
    return [" ".join(x) for x in out]


def brute(texts, least=0.8):
    """The smallest place in each text's component, over all pairs."""
    sets = []
    for t in texts:
        w = t.lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if not sets[i] | sets[j] or len(sets[i] & sets[j]) >= least * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [find(i) for i in range(len(texts))]


def test_near_copies_agree_with_brute_force(spark):
    texts = planted()
    docs = spark.createDataFrame([(k, t, "en", "s", len(t)) for k, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    want = brute(texts)
    assert len(set(want)) < len(set(texts))
    assert sorted(r.doc_id for r in pipeline.drop_near_duplicates(spark, docs, "").collect()) == sorted(set(want))


def test_large_buckets_leave_no_pair_apart(spark):
    shared = " ".join(f"s{i}" for i in range(100))
    texts = [shared + " " + " ".join(f"x{k // 2}y{i}" for i in range(30)) + (" z" if k % 2 else "") for k in range(60)]  # pairs at 0.99, others at 0.6
    rows = spark.createDataFrame(list(enumerate(texts)), "rid long, text string")
    roots = dict(near_copies.grouped(rows).select("rid", "root").collect())
    assert len(set(roots.values())) == 30 and all(roots[k] == roots[k + 1] for k in range(0, 60, 2))


def test_blank_and_null_texts_are_copies(spark):
    rows = spark.createDataFrame([(1, None), (2, " "), (3, "a b"), (4, "A  b")], "rid long, text string")
    roots = dict(near_copies.grouped(rows).collect())
    assert roots[1] == roots[2] != roots[3] == roots[4]


def test_one_row_of_each_group_whatever_its_ids(spark):
    long = [" ".join(f"{c}{i}" for i in range(20)) for c in "abcd"]
    rows = [(5, long[0]), (5, long[1]), (2, long[0]), (None, long[2]), (None, long[2]), (7, long[3]), (None, long[3]), (9, long[1])]
    docs = spark.createDataFrame([(d, t, "en", "s", len(t)) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = [(r.doc_id, r.text) for r in pipeline.drop_near_duplicates(spark, docs, "").collect()]
    assert sorted(got, key=lambda r: r[1]) == [(2, long[0]), (5, long[1]), (None, long[2]), (7, long[3])]


def test_parities_bound_the_difference():
    rng = np.random.default_rng(5)
    pool = rng.integers(0, 1 << 61, 3000, np.uint64)
    for n in (0, 1, 40, 300, 2500):
        a, b = (np.unique(rng.choice(pool, n)) for _ in range(2))
        bits = near_copies.parities(a) ^ near_copies.parities(b)
        assert sum(int(x).bit_count() for x in bits.view(np.uint64)) <= len(np.setxor1d(a, b))


def test_crowd_about_the_limit(spark):
    """Copies of one text with up to seven changed words: many pairs lie just below and just above the limit."""
    rng = np.random.default_rng(6)
    base, texts = [f"w{k}" for k in range(150)], []
    for i in range(120):
        words = list(base)
        for at in rng.choice(150, i % 8, replace=False):
            words[at] = f"x{i}y{at}"
        texts.append(" ".join(words))
    sets = [set(near_copies.shingles(t).tolist()) for t in texts]
    low = list(range(len(texts)))
    for i in range(len(texts)):
        for k in range(i):
            if len(sets[i] & sets[k]) * 9 >= 4 * (len(sets[i]) + len(sets[k])):
                a, b = low[i], low[k]
                low = [min(a, b) if x in (a, b) else x for x in low]
    rows = spark.createDataFrame(list(enumerate(texts)), "rid long, text string")
    got = {}
    for r in near_copies.grouped(rows).collect():
        got.setdefault(r.root, set()).add(r.rid)
    want = {}
    for i, x in enumerate(low):
        want.setdefault(x, set()).add(i)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values())) and 1 < len(want) < 120


def test_candidates_come_from_simhash_tables(spark, monkeypatch):
    words = [f"w{k}" for k in range(60)]
    rows = spark.createDataFrame([(1, " ".join(words)), (2, " ".join([*words, "x"])), (3, "a b c d e f")], "rid long, text string")
    roots = dict(near_copies.grouped(rows).select("rid", "root").collect())
    assert roots[1] == roots[2] != roots[3]
    monkeypatch.setattr(near_copies.simhash, "tables", lambda rows, similarity: np.zeros((0, 16), np.int64))
    roots = dict(near_copies.grouped(rows).select("rid", "root").collect())
    assert len(set(roots.values())) == 3


def test_tables_find_pairs_at_the_limit():
    """Recall of the tables on random pairs of sets at 0.8 exactly, for few rows and for many."""
    rng, one, two = np.random.default_rng(3), [], []
    for k in range(400):
        common = 8 * (3 + k % 40)  # as many more in each as an eighth of what both have
        pool = rng.integers(0, 1 << 63, common + common // 4, np.uint64)
        one.append(np.sort(pool[: common + common // 8]))
        two.append(np.sort(np.concatenate((pool[:common], pool[common + common // 8 :]))))
    a, b = near_copies.simhash.wide(one), near_copies.simhash.wide(two)
    assert (a[:, : near_copies.simhash.FIRST] != b[:, : near_copies.simhash.FIRST]).sum(axis=1).max() <= near_copies.FAR
    for rows in (1000, 250_000):
        places = near_copies.simhash.tables(rows, 0.8)
        met = (near_copies.simhash.table_keys(a, places) == near_copies.simhash.table_keys(b, places)).any(axis=1)
        unlike = (near_copies.simhash.table_keys(a, places) == near_copies.simhash.table_keys(np.roll(b, 1, axis=0), places)).mean()
        print(rows, places.shape, met.mean(), unlike)
        assert met.mean() >= 0.98 and unlike < 1e-4


def test_large_buckets_alone_carry_what_is_compared(spark, monkeypatch):
    """Small buckets become distinct pairs of ids; no wide row is written for their members."""
    sizes, write = {}, near_copies.materialise

    def written(df, name):
        out = write(df, name)
        sizes.setdefault(name, []).append(out.count())
        return out

    monkeypatch.setattr(near_copies, "materialise", written)
    words = [f"w{k}" for k in range(60)]
    rows = spark.createDataFrame([(k, " ".join([*words, *"x" * k])) for k in range(3)], "rid long, text string")
    assert len({r.root for r in near_copies.grouped(rows).collect()}) == 1
    assert sizes["met"][0] > 0 and sizes["live"] == [0] and sizes["pairs"][0] == 3 and not any(sizes["pairs"][1:])


def test_shuffle_files_go_once_a_table_is_written(spark):
    from weftline.llm.common import materialise

    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    context, before = spark._jsc.sc(), spark.conf.get(name)
    start = context.newShuffleId()
    assert materialise(spark.range(1000).repartition(3, "id"), "shuffled").count() == 1000
    blocks = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    import time

    for _ in range(50):
        left = [f for f in blocks.getAllFiles().mkString("|").split("|") if f"/shuffle_{start + 1}_" in f]
        if not left:
            break
        time.sleep(0.1)
    assert not left and spark.conf.get(name) == before


def test_texts_are_not_moved(spark, monkeypatch, tmp_path):
    """Neither the texts whose sets are compared nor the documents that stay are shuffled, whatever is too large to broadcast by itself."""
    plans, write, name = {}, near_copies.materialise, "spark.sql.autoBroadcastJoinThreshold"

    def written(df, name):
        plans.setdefault(name, df._jdf.queryExecution().executedPlan().toString())
        return write(df, name)

    monkeypatch.setattr(near_copies, "materialise", written)
    before = spark.conf.get(name)
    spark.conf.set(name, "-1")
    try:
        texts = planted(n=5, group=20)
        docs = spark.createDataFrame([(k, t, "en", "s", len(t)) for k, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
        out = pipeline.drop_near_duplicates(spark, docs, "")
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert sorted(r.doc_id for r in out.collect()) == sorted(set(brute(texts)))
    finally:
        spark.conf.set(name, before)
    assert "hashpartitioning(rid" not in plan and "hashpartitioning(rid" not in plans["sets"]


def test_rows_among_ids(spark):
    from pyspark.sql import functions as F

    from weftline.llm.common import among

    ids = [0, 63, 64, 65, (5 << 33) + 62, (5 << 33) + 63, -1, -64]
    rows = spark.createDataFrame([(k, str(k)) for k in [*ids, 1, 62, 66, 5 << 33, -2, 127, 63]], "rid long, a string")
    wanted = spark.createDataFrame([(k,) for k in [*ids, 63, 1 << 40]], "rid long")
    got = among(rows, wanted)
    assert got.columns == ["rid", "a"] and sorted(r.rid for r in got.collect()) == sorted([*ids, 63])
    assert among(rows, wanted.where(F.lit(False))).count() == 0


@pytest.mark.parametrize("split", [0, 3])
def test_packs_are_small_and_whole(split):
    """Nodes reach the tables in packs of few bytes a node and table; those that meet are those of equal keys."""
    import pyarrow as pa

    rng = np.random.default_rng(8)
    prints = rng.integers(0, 256, (9000, 64), np.uint8)
    prints[4000:4020] = prints[0]
    nodes = rng.permutation(np.concatenate([np.arange(4500), (3 << 33) + 2 * np.arange(4500)]))
    places = near_copies.simhash.tables(9000, 0.8)[:12]
    given = [pa.RecordBatch.from_arrays([pa.array(nodes[k : k + 700]), pa.array([p.tobytes() for p in prints[k : k + 700]])], names=["node", "simhash"]) for k in range(0, 9000, 700)]
    packs = pa.Table.from_batches(near_copies._packed(places, split)(iter(given))).sort_by("part")
    assert packs.nbytes < 6 * 12 * 9000 and sum(packs["n"].to_pylist()) == 12 * 9000
    got = sorted(zip(*(c.to_pylist() for c in pa.Table.from_batches(near_copies._met(places, split)(iter(packs.to_batches(50)))).columns)))
    keys, want = near_copies.simhash.table_keys(np.unpackbits(prints, axis=1, bitorder="little"), places), []
    for t in range(12):
        _, at, sizes = np.unique(keys[:, t], return_inverse=True, return_counts=True)
        want += [(int(keys[k, t]), int(nodes[k]), int(sizes[at[k]])) for k in np.flatnonzero(sizes[at] > 1)]
    assert got == sorted(want) and max(s for *_, s in got) >= 21


def test_pairs_of_small_buckets_are_bounded_while_joined(spark, monkeypatch):
    """Near in SimHash, apart as sets: such pairs go in the first join, before all parities are fetched."""
    from pyspark.sql import functions as F

    rng = np.random.default_rng(9)
    pool = rng.integers(0, 1 << 63, 4000, np.uint64)
    sets = [np.unique(np.concatenate((pool[:80], pool[100 + 40 * k : 140 + 40 * k]))) for k in range(8)] + [pool[:119], pool[:120]]  # 0.5 among the first eight
    bits = [near_copies.parities(s) for s in sets]
    known = spark.createDataFrame([(k, len(s), 0, 0, b.tolist()) for k, (s, b) in enumerate(zip(sets, bits))], "node long, n int, s0 long, s1 long, bits array<long>")
    known = known.select("node", "n", "s0", "s1", *near_copies._folds(), "bits")
    pairs = spark.createDataFrame([(u, v, u, v) for u in range(10) for v in range(u)], "u long, v long, u_root long, v_root long")
    monkeypatch.setattr(near_copies, "_bounded", lambda one, two: F.lit(True))
    left = {(r.u, r.v) for r in near_copies._near(pairs, known).collect()}
    assert (9, 8) in left and len(left) < 10

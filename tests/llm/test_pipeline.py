"""The corpus pipeline, stage by stage, and the registered queries against their SQL."""

import os
from collections import Counter
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from weftline.llm import queries

pipeline = pytest.importorskip("corpus_pipeline")
pytest.importorskip("public_tokenizers")
DATA = os.environ.get("WEFTLINE_DATA", "/root/testdata/sf0.001")
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.mark.skipif(not Path(DATA).is_dir(), reason="no tables")
@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_agrees_with_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for p in Path(DATA).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    got, want = queries.QUERIES[name](spark, DATA).toPandas(), con.execute(queries.SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    clean = lambda v: "none" if v is None or str(v) in ("nan", "<NA>") else str(int(v)) if isinstance(v, float) and v.is_integer() else str(v)
    flat = lambda f: sorted(tuple(map(clean, r)) for r in f[sorted(f.columns)].itertuples(index=False))
    assert flat(got) == flat(want)


def rows():
    english, german = "the quick river and the old stone with this and that from the north ", "der alte fluss und die steine nicht auf sich mit den und von der "
    out = [(k, (english if k % 2 else german) * (1 + k % 5) + f"w{k} x{k * 7} y{k * 11} " * 9, "en" if k % 2 else "de", f"s{k % 3}") for k in range(60)]
    out += [(100 + k, out[k][1], out[k][2], "s1") for k in range(6)]  # exact copies
    out += [(200, "mail me at a.b@mail.example.com or +1 (415) 555-2671 the old river " * 3, "en", "s0"), (201, None, "en", "s0"), (202, "12 34", "en", "s0"), (None, english, None, None), (3, out[3][1], "en", "s0")]
    return [(*r, None if r[1] is None else len(r[1])) for r in out]


def test_stages(spark, tmp_path):
    docs = spark.createDataFrame(rows(), "doc_id long, text string, lang string, source string, n_chars long")
    seen = {}
    for k, (name, stage) in enumerate(pipeline.STAGES):
        stage(spark, docs, DATA).write.parquet(str(tmp_path / str(k)))
        after = spark.read.parquet(str(tmp_path / str(k)))
        if k < len(pipeline.STAGES) - 1:
            assert after.columns == COLUMNS
        seen[name] = (docs.collect(), after.collect())
        docs = after
    before, after = seen["language_id"]
    assert Counter(r.doc_id for r in before) - Counter(r.doc_id for r in after) == Counter([201, 202])
    before, after = seen["simhash_near_dedup"]
    ids = [r.doc_id for r in after if r.doc_id is not None]
    assert len(ids) == len(set(ids)) and not any(r.doc_id is not None and 100 <= r.doc_id < 106 for r in after)
    assert any(r.doc_id is None for r in after)
    before, after = seen["pii"]
    assert Counter(r.doc_id for r in before) == Counter(r.doc_id for r in after)
    assert all(r.n_chars == len(r.text) and "@mail" not in r.text for r in after)
    changed = {r.doc_id for r in after} & {b.doc_id for b in before for r in after if b.doc_id == r.doc_id and b.text != r.text}
    assert changed <= {200}
    before, after = seen["mixing"]
    assert set(after) <= set(before) and all(n <= 2 for n in Counter(after).values())
    before, after = seen["best_fit_packing"]
    assert Counter(r.doc_id for r in after if r.piece == 0) == Counter(r.doc_id for r in before)


def test_run_leaves_only_what_its_result_reads(spark, tmp_path):
    from weftline.llm.common import standing, sweep

    spark.createDataFrame(rows(), "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    before = standing()
    assert pipeline.run(spark, str(tmp_path)).count() > 0
    names = {p.rsplit("/", 1)[1].rsplit("-", 1)[0] for p in standing() - before}
    assert "mixing" in names and not names & {"language_id", "simhash_near_dedup", "pii", "boxed", "candidates", "placed"}
    sweep(spark, since=before)
    assert standing() <= before


def test_empty(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in pipeline.STAGES:
        assert stage(spark, empty, DATA).count() == 0


def test_extra_columns_are_carried(spark):
    docs = spark.createDataFrame(rows(), "doc_id long, text string, lang string, source string, n_chars long").select("*", F.lit(1).alias("size"), F.lit(2).alias("_keep"), F.lit(3).alias("uid"), F.lit(4).alias("score"))
    for _, stage in pipeline.STAGES[:-1]:
        docs = stage(spark, docs, DATA)
        assert docs.columns == [*COLUMNS, "size", "_keep", "uid", "score"]


def test_encoder_keeps_a_whole_word_once():
    from weftline.llm import packing

    encoder = packing.WordEncoder(queries.tokenizer_path())
    import pyarrow as pa

    texts = ["plain words only", "words, with signs; words, again"]
    got = [ids.tolist() for ids in encoder.encode(pa.array(texts))]
    assert got == [encoder.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    assert not set(encoder.parts) & {"plain", " only", " with", " again"} and " words" in encoder.parts


def test_batches_are_bounded_while_tables_are_written(spark):
    from weftline.llm.common import batches_of, materialise

    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)

    def sizes(batches):
        for batch in batches:
            import pyarrow as pa

            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], names=["n"])

    with batches_of(spark, 100):
        found = materialise(spark.range(1000).coalesce(1).mapInArrow(sizes, "n long"), "sizes")
    assert max(r.n for r in found.collect()) <= 100 and spark.conf.get(name) == before


def test_encoder_remembers_words_that_recur():
    import pyarrow as pa

    from weftline.llm import packing

    encoder = packing.WordEncoder(queries.tokenizer_path(), most=50)
    often = [f"word{chr(97 + k)}" for k in range(20)]
    for turn in range(8):
        texts = [" ".join(["x", *often, *(f"only{chr(97 + turn)}{chr(97 + k)}{chr(97 + j)}" for k in range(5) for j in range(26))]), " ".join(["y", *often]), "", "a\nb, c"]
        got = [ids.tolist() for ids in encoder.encode(pa.array(texts))]
        assert got == [encoder.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
        names, ids = encoder.spaced
        assert set(often) <= set(names.to_pylist()) and len(names) == len(ids) <= 100
        assert not any(n.startswith("only") for n in names.to_pylist())

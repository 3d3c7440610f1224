from __future__ import annotations

import numpy as np
import pytest
from compare import differences, duck

import corpus_pipeline
from isoreach.llm.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", ORACLE_SQL)
def test_query_equals_its_sql(spark, con, name):
    assert not differences(QUERIES[name](spark, SF), con, ORACLE_SQL[name])


@pytest.mark.parametrize("name", QUERIES)
def test_one_row_per_row(spark, name):
    if name not in ("op4_packing", "op12_top_k", "op13_hard_negatives"):
        table = {"op1_warc": "pages", "op3_embedding_dedup": "embeddings"}.get(name, "documents")
        assert QUERIES[name](spark, SF).count() == spark.read.parquet(f"{SF}/{table}.parquet").count()


def test_pieces_give_the_texts_again(spark):
    assert QUERIES["op2_sentencepiece"](spark, SF).filter("NOT round_trip").count() == 0


def test_pipeline_stage_by_stage(spark, tmp_path):
    """Each stage against a plain computation on what it was given."""
    from test_dedup_and_shards import norm
    from test_simhash import brute_components, brute_fingerprint


    from isoreach.llm import quality, toxicity

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    for n, (name, stage) in enumerate(corpus_pipeline.STAGES):
        given = {r.doc_id: r for r in docs.collect()}
        ids = sorted(given)
        texts = [(given[i].text or "").encode() for i in ids]
        out = stage(spark, docs, SF)
        if name == "toxicity":
            score = toxicity.fit(docs, labels).score(texts)
            want = [i for i, x in zip(ids, score, strict=True) if x < 0.5]
        elif name == "quality":
            score = quality.fit(docs, labels).score(texts)
            want = [i for i, x in zip(ids, score, strict=True) if x >= 0.5]
        elif name == "exact_dedup":
            first = {}
            for i in ids:
                first.setdefault(norm(given[i].text), i)
            want = sorted(first.values())
        elif name == "near_dedup":
            fps = np.array([brute_fingerprint(t) for t in texts], np.uint64)
            want = [i for i, c in brute_components(fps, ids, 4).items() if i == c]
        else:
            assert {r.doc_id for r in out.collect()} == set(ids)
            break
        assert out.columns == docs.columns
        out.write.parquet(f"{tmp_path}/{n}")
        docs = spark.read.parquet(f"{tmp_path}/{n}")
        assert sorted(r.doc_id for r in docs.collect()) == want
        assert len(want) < len(ids) or name != "exact_dedup"


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages_take_odd_rows(spark, name, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    odd = [(1, None, None, None, None), (None, "only text", "en", None, 3), (2, "", "en", "s", 0), (2, "", "en", "s", 0)]
    stage = dict(corpus_pipeline.STAGES)[name]
    for n, rows in enumerate((odd, [])):
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{n}")
        out = stage(spark, spark.read.parquet(f"{tmp_path}/{n}"), SF).collect()
        assert not rows or out or name in ("toxicity", "quality")
        assert rows or not out


def test_run(spark):
    assert corpus_pipeline.run(spark, SF).count() > 0


@pytest.fixture
def unset(spark):
    spark.conf.unset(corpus_pipeline.BATCH[0])
    yield
    spark.conf.unset(corpus_pipeline.BATCH[0])


@pytest.mark.parametrize(("name", "within"), [("toxicity", 0.0), ("quality", 1.0)])
def test_a_stage_sends_texts_to_python_by_their_bytes(spark, tmp_path, monkeypatch, unset, name, within):
    """3,000 rows of 8 kB are fewer than Spark's rows of a batch, and 24 MB."""
    import pyarrow as pa

    from isoreach.llm import quality, toxicity

    most = 2 * corpus_pipeline.BATCH[1]  # a batch ends with the row that fills it

    def score_texts(docs, model, *, id_col, text_col):
        def each(batches):
            for rows in batches:
                score = within if rows.nbytes <= most else 1 - within
                yield pa.RecordBatch.from_arrays([rows.column(0), pa.array([score] * len(rows))], ["row", "score"])

        return docs.mapInArrow(each, f"row {dict(docs.dtypes)['row']}, score double")

    operator = {"toxicity": toxicity, "quality": quality}[name]
    monkeypatch.setattr(operator, "fit", lambda *_, **__: None)
    monkeypatch.setattr(operator, "score_texts", score_texts)
    docs = spark.range(0, 3000, 1, 1).selectExpr("id doc_id", "repeat('a b ', 2000) text", "'en' lang", "'s' source", "8000L n_chars")
    assert dict(corpus_pipeline.STAGES)[name](spark, docs, SF).count() == 3000


@pytest.mark.parametrize("name", ["near_dedup", "packing"])
def test_other_stages_bound_batches_too_and_keep_a_given_bound(spark, unset, name):
    key, most = corpus_pipeline.BATCH
    docs, stage = spark.read.parquet(f"{SF}/documents.parquet").limit(9), dict(corpus_pipeline.STAGES)[name]
    stage(spark, docs, SF)
    assert int(spark.conf.get(key)) == most
    spark.conf.set(key, 1000)
    stage(spark, docs, SF)
    assert int(spark.conf.get(key)) == 1000

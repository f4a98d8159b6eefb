"""The registered queries against their SQL, and the pipeline against brute force."""

import hashlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from conftest import SF001
from oracle_compare import compare, duck_connect

import __spark_entry__ as E
import corpus_pipeline
from llm.test_corpus_ops import components_of, judged, shingle_set
from llm.test_scans import hits
from navframe.llm import bpe, pii, quality, queries


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_its_sql(spark, name):
    r = compare(queries.QUERIES[name](spark, SF001), duck_connect(SF001), queries.ORACLE_SQL[name])
    assert r["ok"], r


def test_one_query_an_operator():
    names = [n for n in E.queries() if n.startswith("op")]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14))
    assert "pipeline" in E.queries() and len(corpus_pipeline.STAGES) == 5


def test_pipeline_stage_by_stage(spark):
    docs = spark.read.parquet(f"{SF001}/documents.parquet")
    bench = [tuple(r) for r in spark.read.parquet(f"{SF001}/benchmark.parquet").select("item_id", "text").collect()]
    rows = {r["doc_id"]: r.asDict() for r in docs.collect()}
    stages = dict(corpus_pipeline.STAGES)

    def run(name, docs):
        out = stages[name](spark, docs, SF001)
        assert out.columns == docs.columns or name == "token_ids"
        return out

    first = run("quality_rules", docs)
    kept = {r[0] for r in judged([(i, r["text"], r["source"]) for i, r in rows.items()], quality.MAX_TEXTS, quality.MIN_LEFT) if r[-1]}
    assert {r["doc_id"] for r in first.collect()} == kept
    second = run("near_duplicates", first)
    ids = sorted(kept)
    groups = components_of([shingle_set(rows[i]["text"], 5) for i in ids], ids, 80, 100)
    kept = {i for i, c in zip(ids, groups) if i == c}
    assert {r["doc_id"] for r in second.collect()} == kept
    third = run("decontamination", second)
    kept = {i for i in kept if not hits(rows[i]["text"], bench, 10)[1]}
    assert {r["doc_id"] for r in third.collect()} == kept
    fourth = run("personal_data", third)
    masked = {i: pii.masked(rows[i]["text"]) for i in kept}
    assert {r["doc_id"]: (r["text"], r["n_chars"], r["source"]) for r in fourth.collect()} == {i: (t, len(t), rows[i]["source"]) for i, t in masked.items()}
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(path), special_tokens={})
    want = {}
    for i, text in masked.items():
        ids = encoding.encode_ordinary(text)
        want[i] = (len(ids), hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())
    assert {r["doc_id"]: tuple(r)[1:] for r in run("token_ids", fourth).collect()} == want
    assert {r["doc_id"]: tuple(r)[1:] for r in corpus_pipeline.run(spark, SF001).collect()} == want


def test_token_ids_take_one_python_worker_a_task(spark):
    docs = spark.createDataFrame([(1, "one two"), (2, None)], "doc_id bigint, text string")
    out = corpus_pipeline.token_ids(spark, docs, SF001)
    assert out._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1
    empty = hashlib.sha256(b"").hexdigest()
    got = {r["doc_id"]: r for r in out.collect()}
    assert got[1]["decoded_sha256"] == hashlib.sha256(b"one two").hexdigest()
    assert tuple(got[2])[1:] == (0, empty, empty)

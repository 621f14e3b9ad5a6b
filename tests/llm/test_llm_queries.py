"""The registered queries and the pipeline over the smallest tables."""

from __future__ import annotations

import duckdb
import pandas as pd

import corpus_pipeline
from trajecta.llm import language_id, near_copies
from trajecta.llm.queries import QUERIES, SQL

SF = "/root/testdata/sf0.001"


def test_names():
    assert sorted({int(q[2:].split("_")[0]) for q in QUERIES}) == list(range(1, 11)) and set(SQL) <= set(QUERIES)


def test_sql(spark):
    con = duckdb.connect()
    for t in ("pages", "documents"):
        con.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    for name, sql in SQL.items():
        got, want = QUERIES[name](spark, SF).toPandas(), con.execute(sql).df()
        key = sorted(got.columns)
        a, b = ([tuple(None if v is None or v != v else v for v in r) for r in x[key].itertuples(index=False)] for x in (got, want))
        assert sorted(a, key=str) == sorted(b, key=str)


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    full = docs.toPandas()
    extra = docs.selectExpr("doc_id + 100000 as doc_id", "text", "lang", "source", "n_chars").limit(5).unionByName(docs.selectExpr("cast(null as long) as doc_id", "text", "lang", "source", "n_chars").limit(1)).unionByName(docs.selectExpr("200000L as doc_id", "cast(null as string) as text", "lang", "source", "n_chars").limit(1))
    start = docs.unionByName(extra)
    named = dict(corpus_pipeline.STAGES)
    with_language = named["language ID"](spark, start, SF).toPandas()
    assert set(full.doc_id) <= set(with_language.doc_id.dropna()) and 200000 not in set(with_language.doc_id)
    deduped = named["SimHash near-dedup"](spark, start, SF)
    kept = set(deduped.toPandas().doc_id.dropna())
    texts = {r.doc_id: r.text or "" for r in start.collect() if r.doc_id is not None}
    sets = {k: set(near_copies.shingles(t).tolist()) for k, t in texts.items()}
    keys = sorted(sets)
    root = {k: k for k in keys}

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for i, a in enumerate(keys):
        for b in keys[:i]:
            if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    assert kept == {k for k in keys if find(k) == k} and deduped.columns == docs.columns
    mixed = named["mixing"](spark, docs, SF).toPandas()
    words = full.assign(w=full.text.str.split().str.len())
    assert abs(mixed.text.str.split().str.len().sum() - words.w.sum()) < 0.15 * words.w.sum() and mixed.groupby("doc_id").size().max() <= 3


def test_run(spark):
    out = corpus_pipeline.run(spark, SF).toPandas()
    assert len(out) and {"doc_id", "n_tokens", "ids_sha256", "decoded_sha256"} <= set(out.columns) and (out.n_tokens > 0).all()


def test_held_out_accuracy(spark):
    out = QUERIES["op5_language_id"](spark, "/root/testdata/sf0.01").toPandas()
    lang = pd.read_parquet("/root/testdata/sf0.01/documents.parquet", columns=["doc_id", "lang"])
    tested = out[out.held_out].merge(lang, on="doc_id")
    assert len(tested) and (tested.lang == tested.lang_pred).mean() >= 0.97 and language_id.DIM == 1024

from __future__ import annotations

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")


def staged(spark, tmp_path, docs, sf_dir):
    """Each stage's input and output, written and read again."""
    out = [docs]
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        df = stage(spark, out[-1], sf_dir)
        df.write.parquet(f"{tmp_path}/{i}")
        out.append(spark.read.parquet(f"{tmp_path}/{i}"))
    return out


def test_stages_and_run(spark, small, tmp_path):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    frames = staged(spark, tmp_path, docs, small)
    assert all(f.columns == docs.columns for f in frames[:-1])
    ids = [{r.doc_id for r in f.select("doc_id").collect()} for f in frames]
    assert all(b <= a for a, b in zip(ids, ids[1:], strict=False)) and len(ids[-1]) > 100
    assert ids[3] == ids[4] == ids[5]
    got = {r.doc_id: (r.n_tokens, r.decoded) for r in corpus_pipeline.run(spark, small).collect()}
    assert got == {r.doc_id: (r.n_tokens, r.decoded) for r in frames[-1].collect()}
    texts = {r.doc_id: r.text for r in frames[4].collect()}
    assert all(texts[i] == decoded for i, (_, decoded) in got.items())


def test_odd_and_planted_rows(spark, small, tmp_path, make):
    item = spark.read.parquet(f"{small}/benchmark.parquet").first().text
    words = " ".join(f"clean words number w{i}" for i in range(30))
    rows = [
        (1, None),
        (2, ""),
        (3, "12 34 !!"),
        (4, words),
        (5, words),
        (6, words + " more"),
        (7, f"so {item} it goes"),
        (8, "write to a.b@c.example.org now please"),
        (8, "write to a.b@c.example.org now please"),
        (None, "without an id but with words"),
    ]
    got = {r.doc_id: r for r in staged(spark, tmp_path, make(rows), small)[-1].collect()}
    assert set(got) == {4, 8, None} and got[8].decoded == "write to [EMAIL] now please"
    assert got[4].decoded == words


def test_empty_table(spark, small, tmp_path, none):
    assert staged(spark, tmp_path, none, small)[-1].count() == 0

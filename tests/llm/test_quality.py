import zlib

import cases
import numpy as np

from pubag.llm import quality


def test_exact_neighbours_vote_by_similarity():
    rng = np.random.default_rng(0)
    counts = rng.integers(0, 5, (40, quality.TERMS)).astype(np.float32)
    counts[:, -1] = 50
    counts[5] = counts[4]
    idf = np.ones(quality.TERMS, np.float32)
    project = rng.normal(size=(quality.TERMS, quality.DIMS)).astype(np.float32)
    model = quality.Model(idf, project, np.zeros((0, quality.DIMS), np.float32), np.zeros(0))
    vectors, labels = model.latent(counts).astype(np.float32), (np.arange(40) % 3 == 0).astype(np.float32)
    model = quality.Model(idf, project, vectors, labels)
    asked = rng.integers(0, 5, (7, quality.TERMS)).astype(np.float32)
    for x, got in zip(model.latent(asked), model.score(asked)):
        near = x @ vectors.T
        best = np.argsort(-near, kind="stable")[: quality.NEIGHBOURS]
        w = np.maximum(near[best], 0) ** quality.POWER
        assert abs(got - (w @ labels[best]) / w.sum()) < 1e-4


def test_held_out_documents_are_told_apart(spark):
    from pubag.llm.queries import QUERIES

    sf = "/root/testdata/sf0.1"
    got = QUERIES["op2_quality"](spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "quality"), "doc_id")
    rows = [r for r in got.collect() if r.held_out]
    assert len(rows) > 500 and all(zlib.crc32(str(r.doc_id).encode()) % 5 == 0 for r in rows)
    junk, clean = ([r.predicted for r in rows if r.quality == y] for y in (0, 1))
    assert sum(junk) <= 0.05 * len(junk) and sum(clean) >= 0.99 * len(clean)


def test_edge_rows(spark):
    docs = cases.documents(spark)
    labels = spark.createDataFrame([(1, 1), (2, 1), (3, 0), (3, 0), (10, 0), (77, 1), (None, 1), (4, None)], "doc_id bigint, quality int")
    model = quality.fit(docs, labels)
    assert len(model.labels) == 4
    rows = quality.scored(docs, model).collect()
    assert len(rows) == len(cases.TEXTS) and all(0 <= r[quality.SCORE] <= 1 for r in rows)
    assert [r[quality.SCORE] for r in rows if not r.text] == [model.prior] * 2
    none = quality.fit(docs, labels.limit(0))
    assert {r.score for r in quality.score(docs, none).collect()} == {0.5}
    assert quality.score(cases.empty(spark), model).count() == 0

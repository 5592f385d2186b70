"""The document features: counts of whole texts, and a join that moves none of them."""

import random

from pubag.sources.fixtures import DIGITS, DOCS, PUNCT, UPPER, pu_docs

TEXTS = [None, "", " ", "\n\n \n", DIGITS, PUNCT, UPPER, "plain words only", "A1, b2; C3!\nÄ²٣ é 😀Z\x00^]-[\\", "\t\r\x0b", "ＡＢ１２．，"]


def _tables(spark, path):
    rng = random.Random(5)
    some = DIGITS + PUNCT + UPPER + "abcxyz  \n\n^]-[\\äß²😀"
    texts = TEXTS + ["".join(rng.choices(some, k=rng.randrange(200))) for _ in range(60)]
    rows = [(i, t, "en", "s", None if t is None else len(t)) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, i % 2) for i in range(0, 40)], "doc_id bigint, quality int").write.parquet(f"{path}/labels.parquet")
    return texts


def test_features_are_counts_of_whole_texts(spark, tmp_path):
    texts = _tables(spark, tmp_path)
    got = {r.doc_id: r for r in pu_docs(spark, str(tmp_path), materialize=False).collect()}
    count = lambda t, of: None if t is None else float(sum(c in of for c in t))
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        r = got[i]
        assert [r.f2, r.f3, r.f4, r.f5, r.f6] == [count(t, c) for c in (" ", DIGITS, PUNCT, "\n", UPPER)], t
        assert (r.y, r.y_true) == ((i % 2, i % 2) if i < 40 else (0, None))


def test_texts_stay_out_of_the_join(spark, tmp_path):
    _tables(spark, tmp_path)
    plan = pu_docs(spark, str(tmp_path), materialize=False)._jdf.queryExecution().optimizedPlan()
    while plan.getClass().getSimpleName() != "Join":
        plan = plan.children().head()
    names = {plan.left().output().apply(i).name() for i in range(plan.left().output().size())}
    assert set(DOCS.features) <= names and "text" not in names and "few" not in names

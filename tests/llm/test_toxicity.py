"""Toxicity: held-out accuracy, and odd rows."""

from donorlens.llm import toxicity
from donorlens.llm.common import documents


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = documents(spark, sf), spark.read.parquet(f"{sf}/labels.parquet")
    got = toxicity.classify(docs, labels).join(labels, "doc_id").filter("held_out").toPandas()
    accuracy = (got.predicted == got.toxic).mean()
    assert accuracy > max(got.toxic.mean(), 1 - got.toxic.mean()) + 0.02
    order = got.score.rank()
    p, n = (got.toxic == 1).sum(), (got.toxic == 0).sum()
    assert (order[got.toxic == 1].sum() - p * (p + 1) / 2) / (p * n) > 0.8
    assert ((got.score >= 0.5) == (got.predicted == 1)).all()
    assert got[got.predicted == 1].toxic.mean() > 0.7


def test_odd_rows(odd_docs, no_docs, labels):
    got = toxicity.classify(odd_docs, labels)
    assert got.columns == ["doc_id", "held_out", "score", "predicted"]
    rows = got.collect()
    assert len(rows) == odd_docs.count() and all(0 <= r["score"] <= 1 for r in rows)
    assert toxicity.classify(no_docs, labels).count() == 0
    kept = toxicity.reject_toxic(odd_docs, labels)
    assert kept.columns == odd_docs.columns
    assert kept.count() == sum(r["predicted"] == 0 for r in rows)
    blank = toxicity.classify(odd_docs, labels.filter("false")).collect()
    assert {r["score"] for r in blank} == {0.0}
    one_class = toxicity.classify(odd_docs, labels.filter("toxic = 0")).collect()
    assert {r["score"] for r in one_class} == {0.0}
